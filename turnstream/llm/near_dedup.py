"""Near-duplicate documents by improved consistent weighted sampling over TF-IDF shingles.

A document is the weighted set of its runs of five words, weighted by count and inverse document frequency.
Each of SAMPLES consistent samples of two documents agrees with a chance equal to their weighted Jaccard
similarity; samples are banded, documents that share a band are candidates, and candidates are verified by
their exact weighted Jaccard similarity.

Frequencies are counted over all documents in a fixed table of 2^18 cells by shingle hash, and smoothed by a
quarter of the documents, so that a cell's strangers, a few in 10,000 documents, do not matter.

Not all pairs of a band are compared.  First, every document is compared with the band's most central one,
that with most documents in its bands, so that n near copies of a document cost n comparisons.  Of bands that
this leaves with several groups, an exact bound then removes what cannot link: of a document in another group,
a document shares at most the weight c of its shingles that some other group of these bands has too, so that
documents of weights s and t link only if min(c1, c2) (1 + SIMILARITY) / SIMILARITY >= s + t.  The document with
the greatest share of such weight is compared with the others, the bound is taken anew with the groups that
result, and only pairs within it, each once, remain.  Known limit: n documents of one band that are almost
similar and share their differences too still cost n^2 (see the README).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_small_batches, join_groups, materialize, mix, possibly_in, row_key, row_slices, sum_tables, table_rows, text_buffer, without, word_hashes

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 10, 3
SAMPLES = BANDS * ROWS
CELL_BITS = 18
SEED = 20
#: Documents of a band that are compared with the others in one task.
BLOCK = 256
#: Shingles of a document in one row, at most.
RUN = 4096


def shingles(column: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per document the sorted 48-bit hashes of its different shingles, with counts.

    Returns hashes, counts, offsets by document, the number of words, and a 128-bit digest of the words.
    A text of fewer words than a shingle's, but not none, is one shingle.
    """
    data, offsets = text_buffer(column)
    hashes, bounds = word_hashes(data, offsets)
    n = np.diff(bounds)
    docs = len(n)
    sizes = np.where(n >= words, n - words + 1, (n > 0).astype(n.dtype))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    row = np.repeat(np.arange(docs), sizes)
    at = np.arange(starts[-1]) - starts[row] + bounds[row]
    mult = [np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64)) for k in range(words)]
    padded = np.concatenate([hashes, np.zeros(words, np.uint64)])
    end = bounds[row + 1]
    value = np.zeros(len(at), np.uint64)
    for k in range(words):
        value += np.where(at + k < end, padded[at + k], np.uint64(0)) * mult[k]
    value = mix(value) >> np.uint64(16)
    keys = (row.astype(np.uint64) << np.uint64(48)) | value
    keys.sort()
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    where = np.flatnonzero(first)
    counts = np.diff(np.append(where, len(keys)))
    keys = keys[where]
    inside = np.searchsorted((keys >> np.uint64(48)).astype(np.int64), np.arange(docs + 1))
    # the digest: two sums over words and positions
    place = mix(np.arange(len(hashes), dtype=np.uint64) - np.repeat(bounds[:-1], n).astype(np.uint64) + np.uint64(1))
    digest = np.zeros((docs, 2), np.uint64)
    for j, salt in enumerate((0x9FB21C651E98DF25, 0xA24BAED4963EE407)):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes * np.uint64(salt) + place), dtype=np.uint64)])
        digest[:, j] = mix(total[bounds[1:]] - total[bounds[:-1]] + n.astype(np.uint64))
    return keys & np.uint64((1 << 48) - 1), counts, inside, n, digest


def _cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(48 - CELL_BITS)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table, docs = np.zeros(1 << CELL_BITS, np.int64), 0
    for whole in batches:
        _, offsets = text_buffer(whole.column(0))
        for lo, hi in row_slices(offsets):
            table += np.bincount(_cells(shingles(whole.column(0).slice(lo, hi - lo))[0]), minlength=len(table))
        docs += whole.num_rows
    yield from table_rows(table, docs)


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """Smoothed inverse document frequency of each cell, float32: 1 MB whatever the number of documents."""
    table, n = sum_tables(docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text")), _count, 1 << CELL_BITS)
    return (1 + np.log(1.25 * max(n, 1) / (table + 0.25 * max(n, 1)))).clip(0.05).astype(np.float32)


_draws: dict[str, np.ndarray] = {}


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """65,536 draws each of r (gamma 2), ln c (gamma 2) and beta (uniform), and the multipliers of the samples."""
    if not _draws:
        rng = np.random.Generator(np.random.PCG64(SEED))
        u = rng.random((5, 1 << 16)) * (1 - 1e-9) + 5e-10
        _draws["r"] = (-np.log(u[0] * u[1])).astype(np.float32)
        _draws["c"] = np.log(-np.log(u[2] * u[3])).astype(np.float32)
        _draws["b"] = u[4].astype(np.float32)
        _draws["m"] = rng.integers(0, 1 << 64, SAMPLES, dtype=np.uint64) | np.uint64(1)
    return _draws["r"], _draws["c"], _draws["b"], _draws["m"]


def sample(hashes: np.ndarray, weights: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """SAMPLES consistent samples (32-bit names of shingle and level) of each document; documents must not be empty."""
    r_, c_, b_, multipliers = _tables()
    log_weight = np.log(weights).astype(np.float32)
    spread = mix(hashes)
    out = np.zeros((len(offsets) - 1, len(multipliers)), np.uint32)
    for i, m in enumerate(multipliers):
        h = spread * m
        r = r_[(h >> np.uint64(48)).astype(np.int64)]
        c = c_[((h >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.int64)]
        b = b_[((h >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.int64)]
        level = np.floor(log_weight / r + b)
        rank = c - r * (level - b) - r + np.float32(256)  # ln a, made positive so that its bits keep the order
        name = (h >> np.uint64(16)).astype(np.uint32) ^ (level.astype(np.int32).view(np.uint32) * np.uint32(0x9E3779B1))
        packed = (np.maximum(rank, np.float32(0)).view(np.uint32).astype(np.uint64) << np.uint64(32)) | name
        out[:, i] = np.minimum.reduceat(packed, offsets[:-1]).astype(np.uint32)
    return out


def _signer(idf):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            _, offsets = text_buffer(whole.column(0))
            for lo, hi in row_slices(offsets):
                batch = whole.slice(lo, hi - lo)
                hashes, counts, bounds, n, digest = shingles(batch.column(0))
                full = np.flatnonzero(n > 0)
                signs, totals = np.zeros((batch.num_rows, SAMPLES), np.uint32), np.zeros(batch.num_rows)
                if len(full):
                    weights, starts = counts * idf.value[_cells(hashes)], np.append(bounds[:-1][full], len(hashes))
                    signs[full] = sample(hashes, weights, starts)
                    totals[full] = np.add.reduceat(weights.astype(np.float64), starts[:-1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1), batch.column(2), pa.array(n, pa.int64()), pa.array([d.tobytes() for d in digest], pa.binary()), pa.array([s.tobytes() if k else None for s, k in zip(signs, n, strict=True)], pa.binary()), pa.array(totals)],
                    ["doc_id", "key", "n_words", "node", "signature", "total"],
                )

    return sign


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        signs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, BANDS, ROWS).astype(np.uint64)
        key = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
        for j in range(ROWS):
            key = mix(key + signs[:, :, j])
        nodes = pa.DictionaryArray.from_arrays(np.repeat(np.arange(batch.num_rows), BANDS), batch.column(0)).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([nodes, pa.array(key.ravel().view(np.int64))], ["node", "band"])


def similarity(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two (sorted hashes, weights)."""
    _, i, j = np.intersect1d(one[0], two[0], assume_unique=True, return_indices=True)
    low = float(np.minimum(one[1][i], two[1][j]).sum())
    return low / (float(one[1].sum()) + float(two[1].sum()) - low)


def _verifier(idf):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[bytes, tuple] = {}
        for whole in batches:
            _, offsets = text_buffer(whole.column(2))
            for lo, hi in row_slices(offsets):
                batch = whole.slice(lo, hi - lo)
                names = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                # of the texts on the hot side, each is read once in a run of pairs
                own = _weighted(batch.column(2), idf)
                fresh = [i for i, x in enumerate(names[1]) if x not in kept and (i == 0 or names[1][i - 1] != x)]
                if len(kept) > 64:
                    kept.clear()
                    fresh = [i for i, x in enumerate(names[1]) if i == 0 or names[1][i - 1] != x]
                for i, w in zip(fresh, _weighted(batch.column(3).take(pa.array(fresh, pa.int64())), idf), strict=True):
                    kept[names[1][i]] = w
                sims = [similarity(w, kept[x]) for w, x in zip(own, names[1], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sims, pa.float64())], ["a", "b", "similarity"])

    return verify


def _shingler(idf):
    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The different shingles of each document with their weights, in rows of RUN at most."""
        for whole in batches:
            _, offsets = text_buffer(whole.column(1))
            for lo, hi in row_slices(offsets):
                batch = whole.slice(lo, hi - lo)
                hashes, counts, bounds, _, _ = shingles(batch.column(1))
                weights = (counts * idf.value[_cells(hashes)]).astype(np.float64)
                pieces = -(-np.diff(bounds) // RUN)
                row = np.repeat(np.arange(batch.num_rows), pieces)
                start = bounds[row] + (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * RUN
                cuts = pa.array(np.append(start, len(hashes)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(cuts, x) for x in (pa.array(hashes.astype(np.int64)), pa.array(weights))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), *lists], ["node", "shingles", "weights"])

    return shingle


def mixed(rows: DataFrame, key: str) -> DataFrame:
    """The keys of rows that hold several classes.  Classes are compared by 64-bit hash, which needs no sorting."""
    name = F.xxhash64("class")
    return rows.groupBy(key).agg(F.min(name).alias("low"), F.max(name).alias("high")).where("low != high").select(key)


def common_weight(classes: DataFrame, tokens: DataFrame) -> DataFrame:
    """node, c: the weight of a node's shingles that a node of another class has too.  classes: node, class; tokens as in linkable.

    Shingles are joined with the classes as lists and taken apart after that, so that no task sorts them by node.
    """
    named = tokens.join(classes.select("node", F.xxhash64("class").alias("class")), "node")
    spread = named.select("node", "class", F.explode(F.arrays_zip("shingles", "weights")).alias("x")).select("node", "class", F.col("x.shingles").alias("shingle"), F.col("x.weights").alias("weight"))
    cross = spread.groupBy("shingle").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low != high").select("shingle")
    return spread.select("node", "shingle", "weight").join(cross, "shingle").groupBy("node").agg(F.sum("weight").alias("c"))


def linkable(rows: DataFrame, tokens: DataFrame, totals: DataFrame) -> DataFrame:
    """The rows (band, node, class and any others) that may link to another class in their band, with c and t.

    tokens: node, shingles, weights (lists, see RUN) of all nodes.  totals: node and its weight t.  c is the weight of
    a node's shingles that a node of another class in rows has too.  Bands in which one class remains go.
    """
    common = common_weight(rows.select("node", "class").distinct(), tokens)
    known = materialize(rows.join(common, "node").join(totals.toDF("node", "t"), "node"), "weights")
    least = known.groupBy("band").agg(F.min("t").alias("least"))
    some = known.join(least, "band").where(_bound(F.col("c"), F.col("t"), F.col("least"))).drop("least")
    return some.join(mixed(some, "band"), "band")


def _bound(c: Column, s: Column, t: Column) -> Column:
    """Whether documents of weights s and t may be similar if they share a weight of c at most."""
    return c * ((1 + SIMILARITY) / SIMILARITY) >= (s + t) * (1 - 1e-9)


def _weighted(column: pa.Array, idf) -> list[tuple[np.ndarray, np.ndarray]]:
    hashes, counts, bounds, _, _ = shingles(column)
    weights = (counts * idf.value[_cells(hashes)]).astype(np.float64)
    return [(hashes[i:j], weights[i:j]) for i, j in zip(bounds[:-1], bounds[1:], strict=True)]


def components(edges: DataFrame) -> DataFrame:
    """node, class: the least node of each connected component.  edges: a, b.

    Each round a node takes the least label near it and then that label's own label, so the rounds grow with
    the logarithm of the longest path; every round is written to the shared folder.
    """
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("class")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("class").alias("low"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", "class", F.least("class", "low").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("class").alias("root"))
        after = materialize(step.join(jump, "low").select("node", F.least("low", "root").alias("class"), (F.least("low", "root") != F.col("class")).alias("moved")), "labels")
        labels = after.select("node", "class")
        if after.where("moved").isEmpty():
            return labels


def joined(groups: DataFrame, pairs: DataFrame) -> DataFrame:
    """components of the pairs that made groups and of pairs (a, b), from the classes of groups and pairs alone."""
    of = lambda side: groups.toDF(side, f"{side}_class")
    links = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_class", "a").alias("a"), F.coalesce("b_class", "b").alias("b"))
    roots = components(links.where("a != b"))
    moved = groups.join(roots.toDF("class", "root"), "class", "left").select("node", F.coalesce("root", "class").alias("class"))
    return materialize(moved.unionByName(roots.join(groups.select("node"), "node", "left_anti")), "classes")


@in_small_batches
def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, class_id, class_size, keep_id, kept, n_words, key (see row_key).

    docs: doc_id, text and any other columns.  A class holds documents linked by chains of pairs of weighted
    similarity SIMILARITY or more, and documents of the same words; class_id and keep_id are its least doc_id.
    Documents without words - null and empty ones too - are classes of their own, of size 1.  Texts of one to
    four words are alike if their words are.  Null ids sort before all others; one row of each class stays.  Rows that repeat a doc_id and its
    text stay or go together.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    idf = spark.sparkContext.broadcast(inverse_frequencies(docs))
    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    rows = materialize(
        docs.select(text, F.col("doc_id").cast("long").alias("doc_id"), row_key(docs).alias("key")).mapInArrow(_signer(idf), "doc_id long, key string, n_words long, node binary, signature binary, total double"),
        "signatures",
    )
    full = rows.where("n_words > 0")
    nodes = materialize(full.groupBy("node").agg(F.min(F.struct("doc_id", "key")).alias("first"), F.first("signature").alias("signature"), F.max("total").alias("total"), F.count(F.lit(1)).alias("copies")), "nodes")
    totals = nodes.select("node", "total")
    bands = materialize(nodes.select("node", "signature").mapInArrow(_bands, "node binary, band long"), "bands")

    def texts_of(wanted: DataFrame, name: str) -> DataFrame:
        """node, text of the wanted nodes."""
        wanted = materialize(wanted.distinct().join(nodes.select("node", "first.key"), "node"), f"{name}-wanted")
        source = possibly_in(docs.select(row_key(docs).alias("key"), text), "key", wanted, "key")
        return source.join(wanted, "key").select("node", "text").dropDuplicates(["node"])

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs a, b that are similar; b is the side that repeats."""
        # a pair shares the lesser weight at most
        fits = F.least("wa", "wb") >= F.greatest("wa", "wb") * (SIMILARITY * (1 - 1e-9))
        close = materialize(pairs.join(totals.toDF("a", "wa"), "a").join(totals.toDF("b", "wb"), "b").where(fits).select("a", "b"), f"{name}-close")
        texts = materialize(texts_of(close.select(F.explode(F.array("a", "b")).alias("node")), name), f"{name}-texts")
        both = close.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b").select("a", "b", "ta", "tb")
        found = both.mapInArrow(_verifier(idf), "a binary, b binary, similarity double").where(F.col("similarity") >= SIMILARITY)
        return materialize(found.select("a", "b"), f"{name}-verified")

    sizes = bands.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = materialize(sizes, "sizes")
    entries = sizes.agg(F.sum("n")).first()[0] or 0
    shared = materialize(join_groups(bands, sizes, "band", "n", entries), "shared")
    central = shared.groupBy("node").agg(F.sum("n").alias("near"))
    leaders = shared.join(central, "node").groupBy("band").agg(F.max(F.struct("near", "node"))["node"].alias("b"), F.count(F.lit(1)).alias("size"))
    stars = join_groups(shared, materialize(leaders, "leaders"), "band", "size", entries)
    stars = materialize(stars.where("node != b").select(F.col("node").alias("a"), "b").distinct(), "stars")
    groups = components(verified(stars, "stars"))

    # bands that still hold several groups, without the documents that cannot link
    grouped = shared.where("n > 2").select("band", "node").join(groups, "node", "left").withColumn("class", F.coalesce("class", "node"))
    left = materialize(grouped.join(mixed(grouped, "band"), "band"), "mixed")
    tokens = materialize(texts_of(left.select("node"), "tokens").mapInArrow(_shingler(idf), "node binary, shingles array<long>, weights array<double>"), "tokens")
    left = materialize(linkable(left, tokens, totals), "linkable")
    hubs = left.groupBy("band").agg(F.max(F.struct(F.col("c") / F.col("t"), "node", "class", "c", "t")).alias("hub"))
    spokes = left.join(hubs, "band").where((F.col("class") != F.col("hub.class")) & _bound(F.least("c", "hub.c"), F.col("t"), F.col("hub.t")))
    groups = joined(groups, verified(spokes.select(F.col("node").alias("a"), F.col("hub.node").alias("b")).distinct(), "hubs"))

    # what remains is compared across groups, in blocks, each pair in the first band that both have
    left = left.select("band", "node").join(groups, "node", "left").withColumn("class", F.coalesce("class", "node"))
    left = materialize(linkable(left, tokens, totals), "remaining")
    blocks = left.groupBy("band").agg(F.expr(f"cast(ceil(count(1) / {BLOCK}) as int)").alias("blocks"))
    left = left.join(left.groupBy("node").agg(F.collect_set("band").alias("all")), "node").join(blocks, "band")
    near = left.select("band", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.struct("node", "class", "c", "t", "all").alias("y"))
    far = left.select("band", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), F.struct("node", "class", "c", "t", "all").alias("x"))
    may = _bound(F.least("x.c", "y.c"), F.col("x.t"), F.col("y.t"))
    first = F.array_min(F.array_intersect("x.all", "y.all")) == far["band"]
    met = (far["band"] == near["band"]) & (far["block"] == near["block"]) & (F.col("x.class") < F.col("y.class")) & may & first
    classes = joined(groups, verified(far.join(near, met).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")), "across"))

    # nodes of a class of several nodes are few; all others are classes by themselves
    least = nodes.select("node", F.col("first.doc_id").alias("doc_id"), "copies")
    ids = classes.join(least, "node").groupBy("class").agg(F.min("doc_id").alias("class_id"), F.sum("copies").alias("class_size"))
    named = materialize(classes.join(ids, "class").select("node", "class_id", "class_size"), "named")
    members = full.select("doc_id", "key", "n_words", "node").join(least.withColumnRenamed("doc_id", "least"), "node").join(named, "node", "left")
    some = members.select("doc_id", F.coalesce("class_id", "least").alias("class_id"), F.coalesce("class_size", "copies").alias("class_size"), "n_words", "key")
    none = rows.where("n_words = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), "n_words", "key")
    return some.unionByName(none).select("doc_id", "class_id", "class_size", F.col("class_id").alias("keep_id"), F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"), "n_words", "key")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of docs for each class of near_duplicates, with its columns; documents without words all stay."""
    found = materialize(near_duplicates(docs).where("n_words > 0").select("key", "kept", "doc_id"), "near")
    key = F.col("key").alias("__key")
    gone = found.where("not kept").select(key).distinct()
    return without(docs, gone, found.where("kept").groupBy("key").count().where("count > 1").select(key))
