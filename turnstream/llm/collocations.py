"""Phrases that occur more often than their parts suggest, from count tries.

Each task counts its texts in tries of limited depth, one for each language and a bounded number of words: level k
holds the phrases of k words as (parent, last word, count), in path order.  A trie is serialised in blocks, one for
each of the ranges into which a bounded sample of the table's phrases divides all paths; so a frequent word's or
phrase's subtrie is spread over as many ranges as its size needs.  A block also carries the nodes above its first
path, so every range knows the whole counts of its open ancestors.  One task merges the sorted blocks of a range and
walks the merged trie: a node's ancestors are the left parts of its phrase.  Right parts are reached by suffix links,
joins from each frequent phrase to the one without its first word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_groups, materialize, text_buffer

#: Words of one shard's tries; a task's texts may fill several shards.
SHARD_WORDS = 1 << 20
#: Words of a range, about; their number stays under MOST_RANGES, as tasks hold all borders.
RANGE_WORDS, MOST_RANGES = 1 << 20, 1 << 14
#: Documents from which the borders of the ranges are drawn, and phrases drawn from one of them at most.
SAMPLE_DOCS, SAMPLE_PHRASES = 4096, 256
#: Parts in which a language's phrases are ranked first, so that one task sees `top` phrases of each at most.
TOP_PARTS = 32
UNKNOWN = "und"

# what the bytes of a text count as
_WORD, _SPACE, _BREAK = 0, 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = _SPACE
_KIND[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = _BREAK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words of a buffer of texts, lower-cased; the number of the piece that each is in; bounds of the texts' words."""
    kind = _KIND[data]
    inside = kind == _WORD
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    cuts = offsets[:-1][(offsets[:-1] < offsets[1:])]
    start[cuts] |= inside[cuts]
    end[cuts[cuts > 0] - 1] |= inside[cuts[cuts > 0] - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    breaks = kind == _BREAK
    piece = np.cumsum(breaks)[s] if len(s) else np.zeros(0, np.int64)
    row = np.searchsorted(cuts, s, side="right")
    ends = np.zeros(len(s) + 1, np.int32)
    np.cumsum(e - s, out=ends[1:])
    words = pa.Array.from_buffers(pa.binary(), len(s), [None, pa.py_buffer(ends), pa.py_buffer(_LOWER[data[inside]])])
    return words, piece + row, np.searchsorted(s, offsets)


class Trie:
    """Counts of phrases: words in byte order; by level the parent's index in the level above, the last word, the count; all in path order."""

    def __init__(self, words: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.words, self.levels = words, levels

    @property
    def size(self) -> int:
        return sum(len(x[0]) for x in self.levels)

    def path(self, level: int, at: int) -> tuple[bytes, ...]:
        out = []
        for k in range(level, -1, -1):
            parent, word, _ = self.levels[k]
            out.append(self.words[word[at]])
            at = parent[at]
        return tuple(reversed(out))

    def lower(self, border: tuple[bytes, ...]) -> list[tuple[int, int]]:
        """By level, the index of the first node not before border, and 1 if the node before it is an ancestor of border."""
        out, parent, known = [], 0, True  # known: the words of border so far are the path to `parent`
        for k, (above, word, _) in enumerate(self.levels):
            if known and k < len(border):
                lo, hi = (0, len(word)) if k == 0 else np.searchsorted(above, [parent, parent + 1])
                rank = int(np.searchsorted(self.words, border[k]))
                at = int(lo + np.searchsorted(word[lo:hi], rank))
                same = at < hi and rank < len(self.words) and self.words[rank] == border[k] and word[at] == rank
                if same and k + 1 < len(border):
                    out.append((at + 1, 1))
                    parent = at
                else:
                    out.append((at, 0))
                    known = False
            else:  # nodes under a parent that is not before the border
                out.append((int(np.searchsorted(above, out[-1][0])), 0))
        return out

    def cut(self, low: list[tuple[int, int]], high: list[tuple[int, int]]) -> tuple[Trie, list[int]] | None:
        """The nodes between two borders with the open ancestors of the first, and by level how many of those there are."""
        carry = [c for _, c in low]
        spans = [(lo - c, max(hi, lo)) for (lo, c), (hi, _) in zip(low, high, strict=True)]
        if not any(hi - lo for lo, hi in spans):
            return None
        levels, base = [], 0
        for k, (lo, hi) in enumerate(spans):
            parent, word, count = (x[lo:hi] for x in self.levels[k])
            levels.append([parent - base, word, count])
            base = lo
        used = np.unique(np.concatenate([x[1] for x in levels]))
        return Trie(self.words[used], [(p, np.searchsorted(used, w), c) for p, w, c in levels]), carry

    def dump(self) -> bytes:
        """Columns of steps (parents) and plain numbers, compressed."""
        text = b" ".join(self.words.tolist())
        parts = [np.array([len(text), *(len(x[0]) for x in self.levels)], np.uint32).tobytes(), text]
        for parent, word, count in self.levels:
            for column in (np.diff(parent, prepend=0), word, count):
                parts.append(column.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes())
        return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))

    @staticmethod
    def load(body: bytes, depth: int) -> Trie:
        body = zstandard.ZstdDecompressor().decompress(body)
        size, *counts = np.frombuffer(body, np.uint32, 1 + depth).tolist()
        at = 4 * (1 + depth)
        words = np.array(body[at : at + size].split(b" "), object) if size else np.array([], object)
        at += size
        levels = []
        for n in counts:
            columns = []
            for _ in range(3):
                columns.append(np.ascontiguousarray(np.frombuffer(body, np.uint8, 4 * n, at).reshape(4, n).T).view(np.uint32).ravel().astype(np.int64))
                at += 4 * n
            levels.append((np.cumsum(columns[0]), columns[1], columns[2]))
        return Trie(words, levels)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, the sums of their counts, and the place of each key among them; runs already in order are merged."""
    if not len(keys):
        return keys, counts, np.zeros(0, np.int32)
    order = np.argsort(keys, kind="stable").astype(np.int32)
    held = keys[order]
    fresh = np.empty(len(held), bool)
    fresh[0] = True
    np.not_equal(held[1:], held[:-1], out=fresh[1:])
    first = np.flatnonzero(fresh)
    found = held[first]
    del held
    where = np.empty(len(keys), np.int32)
    where[order] = np.cumsum(fresh, dtype=np.int32) - 1
    return found, np.add.reduceat(counts[order], first), where


def _ranked(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words in byte order, and each word's rank among them."""
    coded = words.dictionary_encode()
    distinct = np.array(coded.dictionary.to_pylist(), object)
    order = np.argsort(distinct) if len(distinct) else np.zeros(0, np.int64)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return distinct[order], rank[coded.indices.to_numpy()] if len(distinct) else np.zeros(0, np.int64)


def count_words(words: pa.Array, piece: np.ndarray, depth: int) -> Trie:
    """The trie of all phrases of up to `depth` words within pieces."""
    distinct, rank = _ranked(words)
    levels, where, n = [], np.zeros(len(rank), np.int32), len(rank)
    for k in range(depth):
        n = max(0, len(rank) - k)  # phrases that begin at the first n words, if they stay in one piece
        whole = piece[:n] == piece[k : k + n]
        starts = np.flatnonzero(whole) if k else np.arange(n)
        keys, counts, place = _summed(where[starts].astype(np.int64) * max(1, len(distinct)) + rank[starts + k], np.ones(len(starts), np.int64))
        levels.append((keys // max(1, len(distinct)), keys % max(1, len(distinct)), counts))
        where = np.zeros(len(rank), np.int32)
        where[starts] = place
        del place
    return Trie(distinct, levels)


def merge(tries: list[Trie]) -> Trie:
    """The sum of tries, level by level."""
    if len(tries) == 1:
        return tries[0]
    distinct, rank = _ranked(pa.array([w for t in tries for w in t.words.tolist()], pa.binary()))
    at = np.cumsum([0, *(len(t.words) for t in tries)])
    ranks = [rank[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    places = [np.zeros(1, np.int32) for _ in tries]
    levels = []
    for k in range(len(tries[0].levels)):
        keys = [places[i][t.levels[k][0]].astype(np.int64) * max(1, len(distinct)) + ranks[i][t.levels[k][1]] for i, t in enumerate(tries)]
        found, counts, place = _summed(np.concatenate(keys), np.concatenate([t.levels[k][2] for t in tries]))
        levels.append((found // max(1, len(distinct)), found % max(1, len(distinct)), counts))
        ends = np.cumsum([len(x) for x in keys])
        places = np.split(place, ends[:-1])
    return Trie(distinct, levels)


def _words_by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.Array, np.ndarray]]:
    languages = np.array(batch.column("lang").to_pylist(), object)
    for lang in sorted(set(languages)):
        column = batch.column("text").filter(pa.array(languages == lang))
        yield lang, *words_of(*text_buffer(column))[:2]


def _shards(depth: int, borders: dict[str, list[tuple[int, tuple[bytes, ...]]]], ranges: dict[str, tuple[int, int]]):
    """A function that turns texts into blocks of tries: range, lang, block, carried."""

    def blocks(lang: str, held: list[tuple[pa.Array, np.ndarray]]) -> Iterator[tuple]:
        words = pa.concat_arrays([w for w, _ in held])
        shift = np.cumsum([0, *(p[-1] + 2 if len(p) else 0 for _, p in held)])
        trie = count_words(words, np.concatenate([p + s for (_, p), s in zip(held, shift, strict=False)]), depth)
        first, last = ranges.get(lang, (0, 0))
        cuts = [(first, [(0, 0)] * depth), *((r, trie.lower(b)) for r, b in borders.get(lang, []))]
        whole = [(len(x[0]), 0) for x in trie.levels]
        for (r, low), (_, high) in zip(cuts, [*cuts[1:], (last, whole)], strict=True):
            if part := trie.cut(low, high):
                yield r, lang, part[0].dump(), part[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        sizes: dict[str, int] = {}

        def out(lang: str) -> Iterator[pa.RecordBatch]:
            for row in blocks(lang, held.pop(lang)):
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.string(), pa.binary(), pa.list_(pa.int32())), strict=True)], ["range", "lang", "block", "carried"])
            sizes.pop(lang)

        for batch in batches:
            for row in range(0, batch.num_rows, 256):
                for lang, words, piece in _words_by_language(batch.slice(row, 256)):
                    held.setdefault(lang, []).append((words, piece))
                    sizes[lang] = sizes.get(lang, 0) + len(words)
                    while sum(sizes.values()) > SHARD_WORDS:
                        yield from out(max(sizes, key=sizes.get))
        for lang in sorted(held):
            yield from out(lang)

    return run


def _draw(depth: int):
    """A function that draws phrases, evenly over each text, with the words that each stands for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for row in range(batch.num_rows):
                for lang, words, _ in _words_by_language(batch.slice(row, 1)):
                    n = max(1, min(len(words) // 16, SAMPLE_PHRASES))
                    for k in range(n if len(words) else 0):
                        at = (2 * k + 1) * len(words) // (2 * n)
                        rows.append((lang, words.slice(at, depth).to_pylist(), len(words) / n))
            if rows:
                lang, phrase, weight = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(phrase, pa.list_(pa.binary())), pa.array(weight)], ["lang", "phrase", "weight"])

    return run


def find_borders(rows: DataFrame, depth: int, range_words: int) -> tuple[dict, dict, int]:
    """Borders of the ranges, from a bounded sample: by language the (range, path) that begin within it, and its first and last range."""
    total = rows.count()
    sample = rows.sample(False, min(1.0, SAMPLE_DOCS / max(1, total)), seed=7)
    drawn = sorted((x["lang"], tuple(map(bytes, x["phrase"])), x["weight"]) for x in sample.mapInArrow(_draw(depth), "lang string, phrase array<binary>, weight double").collect())
    scale = max(1.0, total / SAMPLE_DOCS)
    words = scale * sum(w for _, _, w in drawn)
    n = int(min(MOST_RANGES, max(rows.sparkSession.sparkContext.defaultParallelism, words / range_words)))
    borders: dict[str, list] = {}
    ranges: dict[str, tuple[int, int]] = {}
    seen, at, last = 0.0, 0, None
    for lang, phrase, weight in drawn:
        if at < n - 1 and seen >= (at + 1) * words / n / scale and (lang, phrase) != last:
            at = min(n - 1, int(seen * scale * n / words))
            borders.setdefault(lang, []).append((at, phrase))
            last = (lang, phrase)
        low, _ = ranges.get(lang, (at, at))
        ranges[lang] = (low, at)
        seen += weight
    return borders, {k: (v[0] if not borders.get(k) else min(v[0], borders[k][0][0] - 1), v[1]) for k, v in ranges.items()}, n


def _merged(depth: int, least: int):
    """A function that merges the blocks of a range, sorted by language, and walks the sum: lang, phrase, f, left, total."""

    def walk(lang: str, trie: Trie, carried: list[int]) -> pa.RecordBatch:
        out = {"lang": [], "phrase": [], "f": [], "left": [], "total": []}
        paths: list[dict[int, tuple[tuple[bytes, ...], list[int]]]] = [{-1: ((), [])}]
        for k, (parent, word, count) in enumerate(trie.levels):
            often, here = np.flatnonzero(count >= least), {}
            for i in often.tolist():
                path, left = paths[k][int(parent[i]) if k else -1]  # a parent is at least as frequent
                here[i] = ((*path, trie.words[word[i]]), [*left, int(count[i])])
                if i >= carried[k]:
                    out["phrase"].append([w.decode() for w in here[i][0]])
                    out["f"].append(int(count[i]))
                    out["left"].append(left)
            paths.append(here)
        n = len(out["f"])
        total = int(trie.levels[0][2][carried[0] :].sum())
        out["phrase"].append([])
        out["f"].append(0)
        out["left"].append([])
        return pa.RecordBatch.from_arrays([pa.array([lang] * (n + 1)), pa.array(out["phrase"], pa.list_(pa.string())), pa.array(out["f"], pa.int64()), pa.array(out["left"], pa.list_(pa.int64())), pa.array([0] * n + [total], pa.int64())], ["lang", "phrase", "f", "left", "total"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, whole, waiting, carried = None, None, [], []

        def gather() -> Trie:
            return merge([*([whole] if whole else []), *waiting])

        for batch in batches:
            for r, lang, block, carry in zip(*(batch.column(c).to_pylist() for c in ("range", "lang", "block", "carried")), strict=True):
                if key != (r, lang):
                    if key:
                        yield walk(key[1], gather(), carried)
                    key, whole, waiting, carried = (r, lang), None, [], [0] * depth
                waiting.append(Trie.load(block, depth))
                carried = [max(a, b) for a, b in zip(carried, carry, strict=True)]
                if sum(t.size for t in waiting) > max(SHARD_WORDS, whole.size if whole else 0):
                    whole, waiting = gather(), []
        if key:
            yield walk(key[1], gather(), carried)

    return run


def frequent_phrases(docs: DataFrame, longest: int = 3, least: int = 10, range_words: int = RANGE_WORDS) -> DataFrame:
    """lang, phrase (words), f, left (counts of its first 1, 2, ... words) of all phrases of up to `longest` words found `least` times or more; and lang, an empty phrase, total: parts of the number of all words."""
    rows = docs.select(F.coalesce(F.col("lang"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    borders, ranges, n = find_borders(rows, longest, range_words)
    blocks = rows.mapInArrow(_shards(longest, borders, ranges), "range int, lang string, block binary, carried array<int>")
    dealt = blocks.repartitionById(n, F.col("range")).sortWithinPartitions("range", "lang")
    return dealt.mapInArrow(_merged(longest, least), "lang string, phrase array<string>, f long, left array<long>, total long")


def _exact(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(38,0)")


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, top: int = 2000, nested_share: int = 50, range_words: int = RANGE_WORDS) -> DataFrame:
    """The phrases of each language that score highest: lang, rank, phrase, a, l, r, n, score.

    docs: text, lang and any other columns, which are not read.  Texts have A-Z lower-cased, are cut at .,;:!? and line
    ends into pieces, and those at spaces and tabs into words; a null text is empty, a null language is `und`.
    Candidates have 2 to `longest` words and occur a >= `least` times within pieces, overlaps included.  Of the cuts of a
    candidate into a first part, found l times, and a rest, found r times, the one with the lowest score
    floor(10^6 a^2 / (l r)) counts; of equal ones that after the fewest words.  Candidates inside a longer one that occurs
    `nested_share` per cent as often or more are dropped.  Ranks go by score and a descending, then by the phrase's bytes;
    n is the language's number of words.  Rows that repeat count each; a text may be of any length; an empty table, and
    languages without candidates, give no rows.
    """
    found = materialize(frequent_phrases(docs, longest, least, range_words), "phrases")
    totals = found.groupBy("lang").agg(F.sum("total").alias("n"))
    nodes = found.where("f > 0").select("lang", F.array_join("phrase", " ").alias("phrase"), F.size("phrase").alias("k"), "phrase", "f", "left").toDF("lang", "phrase", "k", "words", "f", "left")
    # suffix links: right parts of a phrase are the node of its words but the first, and that node's right parts
    linked = nodes.where("k = 1").select("*", F.array().cast("array<long>").alias("right"))
    levels = []
    for k in range(2, longest + 1):
        own = nodes.where(F.col("k") == k).withColumn("link", F.struct("lang", F.array_join(F.slice("words", 2, k - 1), " ").alias("phrase")))
        sizes = own.groupBy("link").agg(F.count(F.lit(1)).alias("links"))
        ends = linked.select(F.struct("lang", "phrase").alias("link"), F.concat(F.array("f"), "right").alias("right"))
        groups = materialize(sizes.join(ends, "link"), f"links-{k}")
        linked = join_groups(own, groups, "link", "links", own.count()).drop("link", "links")
        levels.append(linked)
    whole = levels[0]
    for x in levels[1:]:
        whole = whole.unionByName(x)
    candidates = materialize(whole.select("lang", "phrase", "words", F.col("f").alias("a"), "left", "right"), "candidates")
    inside = F.flatten(F.transform(F.sequence(F.lit(2), F.size("words") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.size("words") - k + 1), lambda i: F.array_join(F.slice("words", i, k), " "))))
    longer = candidates.where(F.size("words") > 2).select("lang", F.explode(inside).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    free = candidates.join(longer, ["lang", "phrase"], "left").where(F.coalesce(100 * _exact("longer") < nested_share * _exact("a"), F.lit(True)))
    cuts = F.transform(F.arrays_zip("left", "right"), lambda x, i: F.struct((i + 1).alias("k"), x["left"].alias("l"), x["right"].alias("r")))
    cut = free.select("lang", "phrase", "a", F.explode(cuts).alias("cut")).select("lang", "phrase", "a", "cut.k", "cut.l", "cut.r")
    scored = cut.withColumn("score", F.expr("(1000000 * cast(a as decimal(38,0)) * cast(a as decimal(38,0))) div (cast(l as decimal(38,0)) * cast(r as decimal(38,0)))"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("best")).select("lang", "phrase", "best.*")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(TOP_PARTS)).alias("part")
    some = best.withColumn("place", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).where(F.col("place") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
