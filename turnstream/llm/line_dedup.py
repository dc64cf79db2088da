"""Line deduplication by a segment-partition edit join.

Different lines are alike if k edits (insertions, deletions or substitutions of a code point) turn one into the
other, where k is one for each SHARE code points of the shorter line, and at least one.

Where one edit is allowed, a line is split into 2 segments: lines of n code points are filed under n and each
half, and lines of n or n + 1 probe those lists with their own first and last code points - for one edit the
intact segment lies at the same distance from the start or from the end.  Where more are allowed, a line is filed
under its rarest grams, so many that k edits cannot touch all of them: k + 1 of them do not overlap.  Of two lines
that are alike, take the one whose grams end at the lower rank: one of these is left in the other line, which is
filed under all its grams up to a higher rank, so under this one too, at places no further apart than k and with
lengths no further apart than k.  How rare grams are is told by a sample, which decides only where lines meet.
Texts of lines are shuffled once, so that each different line is filed once, however often it occurs.

The entries of long lines are many, so they travel packed: a task turns its lines into chunks, numbers the
lines of a chunk, and sends each bucket of grams one compressed list of (line, place, gram).  What a bucket holds
does not grow with the data, as the number of buckets does.  An entry also names the gram before it in its
line and the distance to it: two entries that agree in that have met in that gram's list already.  Pairs that
meet are first compared by the counts of their code points in BINS classes (k edits change them by 2 k at most),
then by the furthest places that edits reach on each diagonal.

Where more than NEAR entries of a list are as near to one of them in length and place as lines that are alike - many
variants of one long line - that entry and those near it at first meet only the most frequent lines of their own and
the next cells of length and place; lines that chains of links then join are not compared again, and what is left is
compared in blocks of like length and place.  All other entries meet those near them where the list is, however long
it is: a common phrase stands at any place of lines of any length.  Short lines in long lists are filed again under one half of the segment that is still open, until lists
are short or closed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CHUNK, materialize, mix, possibly_in, row_slices, sum_tables, table_rows, text_buffer
from .near_dedup import components

#: Code points of the shorter line for each edit that is allowed.
SHARE = 32
#: Shorter lines, in code points, are alike only if equal: one edit is then much of the line.
LEAST_CHARS = 8
#: Code points from which two edits or more are allowed.
LONG = 2 * SHARE
HOT = 64
#: Entries of a list of long lines up to which all later ones are tried in turn.
HOT_LONG = 64
#: Entries near one of a longer list up to which it meets all of them at once.
NEAR = 512
#: Code points in a gram of a long line.
GRAM = 12
#: Bits of a gram's hash that order it among those as frequent, and of both.
HASH_BITS, RANK_BITS = 28, 32
#: Code points of the sample that tells how frequent grams are, and cells that they are counted in.
SAMPLE_CHARS, GRAM_CELLS = 1 << 24, 1 << 21
#: Code points of a chunk; entries of a code point, about, and of a bucket on average.
CHUNK_CHARS = 8_000_000
DENSITY = 0.06
BUCKET_ENTRIES = 1_000_000
#: Pairs of entries that a task holds.
PAIRS = 1 << 20
#: Places of a gram in a block of a long list.
PLACES = 256
#: Edits up to which distances of many pairs are found at once.
MOST_AT_ONCE = 1024
#: Classes of code points that are counted in each line, a power of two.
BINS = 64

_BASE = 0x9E3779B97F4A7C15 | 1
_BLOBS = "bucket int, chunk long, body binary"
_MET = "key long, line long, spot long, other long, node binary, bins binary, n int, before int, home int"
_MET_NAMES = [x.split()[0] for x in _MET.split(", ")]
_KEYS = "key long, line long, n int, longer boolean, open_from int, open_to int"


def _prefix_hashes(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    steps = np.full(len(points) + 1, _BASE, np.uint64)
    steps[0] = 1
    up = np.cumprod(steps, dtype=np.uint64)
    steps[1:] = np.uint64(pow(_BASE, -1, 1 << 64))
    down = np.cumprod(steps, dtype=np.uint64)
    total = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:], dtype=np.uint64)
    return total, down


def _code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = column.to_pylist()
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def _span(total, down, lo, hi, salt):
    return mix((total[hi] - total[lo]) * down[lo] + mix((hi - lo).astype(np.uint64) * np.uint64(31) + salt))


def _file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each line's entries: (n, segment) of its own length, and as the longer line of those of length n - 1."""
    for whole in batches:
        _, offsets = text_buffer(whole.column(1))
        for lo, hi in row_slices(offsets, CHUNK):
            points, bounds = _code_points(whole.column(1).slice(lo, hi - lo))
            total, down = _prefix_hashes(points)
            names = whole.column(0).slice(lo, hi - lo).to_numpy()
            start, end = bounds[:-1], bounds[1:]
            out = []
            for longer in (0, 1):
                n = (end - start - longer).astype(np.int64)  # of the shorter line
                half = n // 2
                ok = n >= LEAST_CHARS
                salt = mix(n.astype(np.uint64) * np.uint64(2))
                first = _span(total, down, start, start + half, salt)
                last = _span(total, down, end - (n - half), end, salt + np.uint64(1))
                out.append((first[ok], names[ok], n[ok], longer, half[ok], n[ok]))
                out.append((last[ok], names[ok], n[ok], longer, np.zeros(ok.sum(), np.int64), half[ok]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([o[0] for o in out]).view(np.int64)),
                    pa.array(np.concatenate([o[1] for o in out])),
                    pa.array(np.concatenate([o[2] for o in out]).astype(np.int32)),
                    pa.array(np.concatenate([np.full(len(o[0]), bool(o[3])) for o in out])),
                    pa.array(np.concatenate([o[4] for o in out]).astype(np.int32)),
                    pa.array(np.concatenate([o[5] for o in out]).astype(np.int32)),
                ],
                ["key", "line", "n", "longer", "open_from", "open_to"],
            )


def _refile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of hot lists, each under its list and either half of its open part; of one code point, under that."""
    for batch in batches:
        out: list[tuple] = []
        for key, line, n, longer, lo, hi, text in zip(*(batch.column(k).to_pylist() for k in ("key", "line", "n", "longer", "open_from", "open_to", "text")), strict=True):
            more = int(longer)
            if hi - lo <= 1:
                # one code point is open, or two of a longer line: alike if one of them is the other's
                for c in set(text[lo : hi + more]):
                    out.append((hash((key, 2, ord(c))), line, n, longer, lo, lo))
                if hi > lo and not longer:  # lines of one length differ there in one code point at most
                    out.append((hash((key, 3)), line, n, longer, lo, lo))
                continue
            mid = (lo + hi) // 2
            for side, part, rest in ((0, text[lo:mid], (mid, hi)), (1, text[mid + more : hi + more], (lo, mid))):
                h = int(mix(np.array([key & (2**64 - 1)], np.uint64) + np.uint64(side + 1))[0])
                for c in part:
                    h = ((h ^ ord(c)) * _BASE) & (2**64 - 1)
                h = int(mix(np.array([h], np.uint64))[0])
                out.append((h - 2**64 if h >= 2**63 else h, line, n, longer, *rest))
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.int32()]
        columns = list(zip(*out, strict=True)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["key", "line", "n", "longer", "open_from", "open_to"])


def edits(n: int) -> int:
    """Edits allowed between lines of which the shorter has n code points."""
    return max(1, n // SHARE) if n >= LEAST_CHARS else 0


def gram_hashes(points: np.ndarray) -> np.ndarray:
    """Hash of the GRAM code points from each place on."""
    power, size, h = _BASE, 1, points.astype(np.uint64) + np.uint64(1)
    known = {1: h}
    while 2 * size <= GRAM:
        h = h[: len(h) - size] * np.uint64(power & (2**64 - 1)) + h[size:]
        size, power = 2 * size, power * power
        known[size] = h
    rest, at = GRAM - size, size
    while rest:
        part = max(s for s in known if s <= rest)
        n = max(len(points) - at - part + 1, 0)
        h = h[:n] * np.uint64(pow(_BASE, part, 2**64)) + known[part][at : at + n]
        at, rest = at + part, rest - part
    return mix(h)


def _prefixes(at: np.ndarray, rank: np.ndarray, row: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted places of each row's first grams by rank, so many that `need` of them do not overlap, and the rows that have too few.

    at: sorted places of grams, of which a row has all up to some rank.  Grams of equal rank are taken together.
    """
    bits = np.uint64(int(at[-1] + 1).bit_length() if len(at) else 1)
    names = np.sort((row.astype(np.uint64) << np.uint64(RANK_BITS) | rank) << bits | at.astype(np.uint64))
    place = np.uint64((1 << int(bits)) - 1)
    count = np.bincount(row, minlength=len(need))
    first = np.cumsum(count) - count
    size = np.minimum(count, need + need * 5 // 8 + 1)
    left, todo = [np.flatnonzero(count < need)], np.flatnonzero(count >= need)
    while len(todo):
        _, some = next(_ranges(first[todo], first[todo] + size[todo], 1 << 62))
        places = np.sort((names[some] & place).astype(np.int64))
        follow = np.append(np.searchsorted(places, places + GRAM), len(places))
        end, live, met = np.cumsum(size[todo]), np.arange(len(todo)), np.zeros(len(todo), np.int64)
        now = end - size[todo]
        for _ in range(int(need[todo].max())):
            met[live] += 1
            now = follow[now]
            on = now < end[live]
            now, live = now[on], live[on]
            if not len(live):
                break
        todo = todo[met < need[todo]]
        left.append(todo[size[todo] == count[todo]])
        todo = todo[size[todo] < count[todo]]
        size[todo] = np.minimum(count[todo], size[todo] + np.maximum(1, size[todo] // 8))
    short = np.concatenate(left)
    size[short] = 0
    full = np.flatnonzero(size)
    if not len(full):
        return np.zeros(0, np.int64), short
    last = np.searchsorted(names, names[first[full] + size[full] - 1] | place, side="right")
    _, some = next(_ranges(first[full], last, 1 << 62))
    return np.sort((names[some] & place).astype(np.int64)), short


def rare_grams(hashes: np.ndarray, bounds: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Sorted places of the rarest grams of each line, so many that the edits allowed in it cannot touch all of them.

    One edit touches none but grams that share a place, so edits(n) + 1 grams that do not overlap are enough.  classes: of
    each cell of the hashes, how frequent its grams are; then the hash decides.  Any classes give a right result.
    """
    n = np.diff(bounds)
    need = n // SHARE + 1
    whole = np.ones(len(hashes), bool)
    for k in range(1, GRAM):
        whole[bounds[1:-1] - k] = False
    low = hashes & np.uint64((1 << HASH_BITS) - 1)
    cell = np.uint64(64 - (len(classes) - 1).bit_length())
    # nearly always a quarter of the rarest class is enough
    at = np.flatnonzero(whole & (low < np.uint64(1 << (HASH_BITS - 2))))
    at = at[classes[(hashes[at] >> cell).astype(np.int64)] == 0]
    found, short = _prefixes(at, low[at], np.searchsorted(bounds, at, side="right") - 1, need)
    if not len(short):
        return found
    short = np.sort(short)
    which, at = next(_ranges(bounds[short], bounds[short + 1] - GRAM + 1, 1 << 62))
    rank = classes[(hashes[at] >> cell).astype(np.int64)].astype(np.uint64) << np.uint64(HASH_BITS) | low[at]
    more, _ = _prefixes(at, rank, which, need[short])
    return np.sort(np.concatenate([found, more]))


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Grams of a task's lines by cell, those that reach from line to line included."""
    table, lines = np.zeros(GRAM_CELLS, np.int64), 0
    for batch in batches:
        points, _ = _code_points(batch.column(0))
        lines += batch.num_rows
        for lo in range(0, len(points) - GRAM + 1, CHUNK):
            np.add.at(table, (gram_hashes(points[lo : lo + CHUNK + GRAM - 1]) >> np.uint64(64 - GRAM_CELLS.bit_length() + 1)).astype(np.int64), 1)
    yield from table_rows(table, lines)


def gram_classes(lines: DataFrame, chars: int) -> np.ndarray:
    """How frequent the grams of each of GRAM_CELLS cells are in a sample of lines, as powers of two above twice the mean.

    It decides only which grams lines are filed under, not which lines meet.  chars: of all lines.
    """
    counts, _ = sum_tables(lines.select("text").sample(False, min(1.0, SAMPLE_CHARS / max(1, chars)), seed=7), _count_grams, GRAM_CELLS)
    return np.clip(np.floor(np.log2(np.maximum(counts, 1) / max(1.0, 2 * counts.mean()))) + 1, 0, 15).astype(np.uint8)


def _planes(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(body: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(body, np.uint8).reshape(4, n).T).view("<u4").ravel().astype(np.int64)


class _Chunk:
    """Different long lines of one task, by length, and their entries."""

    def __init__(self, number: int, buckets: int, classes: np.ndarray):
        self.number, self.buckets, self.classes = number, buckets, classes
        self.lines: list[tuple[bytes, str, int]] = []
        self.chars = 0

    def add(self, node: bytes, line: str, times: int) -> None:
        self.lines.append((node, line, times))
        self.chars += len(line)

    def rows(self) -> Iterator[tuple[int, int, bytes]]:
        """(bucket, chunk, body): the entries of each bucket, and with bucket -1 the lines by number."""
        order = sorted(self.lines, key=lambda x: len(x[1]))
        lengths = np.array([len(x[1]) for x in order], np.int64)
        times = np.minimum([x[2] for x in order], 255).astype(np.uint8)
        keys, lines, spots, befores, bins = [], [], [], [], np.zeros((len(order), BINS), np.uint8)
        lo = 0
        ends = np.cumsum(lengths)
        while lo < len(order):
            before = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, before + CHUNK // 2, side="right")))
            points = np.frombuffer("".join(x[1] for x in order[lo:hi]).encode("utf-32-le", "surrogatepass"), np.uint32)
            n = lengths[lo:hi]
            bounds = np.concatenate([[0], np.cumsum(n)])
            row = np.repeat(np.arange(hi - lo), n)
            counts = np.bincount(row * BINS + (points & np.uint32(BINS - 1)), minlength=(hi - lo) * BINS)
            bins[lo:hi] = np.minimum(counts, 255).reshape(-1, BINS)
            hashes = gram_hashes(points)
            at = rare_grams(hashes, bounds, self.classes)
            key, line = mix(hashes[at] + np.uint64(1)), row[at]
            keys.append(key)
            lines.append(line + lo)
            spots.append(at - bounds[line])
            before = np.zeros(len(at), np.uint64)
            before[1:] = np.where(line[1:] == line[:-1], mix(key[:-1] + (at[1:] - at[:-1]).astype(np.uint64)) & np.uint64(0xFFFFFF) | np.uint64(1), np.uint64(0))
            befores.append(before)
            lo = hi
        if not order:
            return
        yield -1, self.number, zstandard.compress(b"".join(x[0] for x in order) + bins.tobytes() + _planes(lengths), 1)
        key, line, spot, before = (np.concatenate(c) for c in (keys, lines, spots, befores))
        bucket = ((key >> np.uint64(32)) * np.uint64(self.buckets) >> np.uint64(32)).astype(np.int64)
        # by bucket, then line: numbers, lengths and places are then nearly free
        by = np.argsort(bucket << np.int64(32) | line, kind="stable")
        line, spot, bucket = line[by], spot[by], bucket[by]
        marks = [np.ascontiguousarray(x[by].astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]) for x in (key & np.uint64(0xFFFFFF), before)]
        cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        for a, b in zip(cuts, np.r_[cuts[1:], len(bucket)], strict=True):
            some = line[a:b]
            parts = [_planes(np.diff(some, prepend=0)), _planes(np.diff(lengths[some], prepend=0)), _planes(spot[a:b]), *(m[a:b].tobytes() for m in marks), times[some].tobytes()]
            yield int(bucket[a]), self.number, zstandard.compress(b"".join(parts), 1)


def _pack(buckets: int, classes: Broadcast):
    most = CHUNK_CHARS

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Entries of the lines node, text, occurrences of a partition, in chunks; a line is named by partition, chunk and number."""
        task, seq = TaskContext.get().partitionId(), 0
        chunk = _Chunk(task << 16, buckets, classes.value)

        def batch_of(chunk: _Chunk) -> Iterator[pa.RecordBatch]:
            held: list[tuple[int, int, bytes]] = []
            for row in chunk.rows():
                held.append(row)
                if len(held) == 256:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), (pa.int32(), pa.int64(), pa.binary()), strict=True)], ["bucket", "chunk", "body"])
                    held = []
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), (pa.int32(), pa.int64(), pa.binary()), strict=True)], ["bucket", "chunk", "body"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                chunk.add(*row)
                if chunk.chars >= most:
                    yield from batch_of(chunk)
                    seq += 1
                    chunk = _Chunk(task << 16 | seq, buckets, classes.value)
        yield from batch_of(chunk)

    return pack


def _entries(chunk: int, body: bytes) -> tuple[np.ndarray, ...]:
    """key, line, n, spot, before, times of a packed list."""
    raw = zstandard.decompress(body)
    n = len(raw) // 19
    line, length, spot = (_from_planes(raw[4 * n * k : 4 * n * (k + 1)], n) for k in range(3))
    key, before = (np.frombuffer(raw[(12 + 3 * k) * n : (15 + 3 * k) * n], np.uint8).reshape(-1, 3).astype(np.int64) @ np.array([1, 1 << 8, 1 << 16]) for k in range(2))
    return key, np.cumsum(line) + (chunk << 24), np.cumsum(length), spot, before, np.frombuffer(raw[18 * n :], np.uint8).astype(np.int64)


def _table(chunk: int, body: bytes) -> tuple[np.ndarray, list[bytes], list[bytes], np.ndarray]:
    """line, node, bins, n of a chunk's lines."""
    raw = zstandard.decompress(body)
    n = len(raw) // (16 + BINS + 4)
    nodes = [raw[16 * i : 16 * i + 16] for i in range(n)]
    bins = [raw[16 * n + BINS * i : 16 * n + BINS * (i + 1)] for i in range(n)]
    return np.arange(n) + (chunk << 24), nodes, bins, _from_planes(raw[(16 + BINS) * n :], n)


def _near(n: np.ndarray, spot: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether entries i and j of one list can belong to lines that are alike."""
    most = np.minimum(n[i], n[j]) // SHARE
    return (np.abs(n[j] - n[i]) <= most) & (np.abs(spot[j] - spot[i]) <= most)


def _apart(before: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether entries i and j have not met in the list of the gram before."""
    return (before[i] != before[j]) | (before[i] == 0)


def _sweep(key: np.ndarray, n: np.ndarray, spot: np.ndarray, before: np.ndarray, i: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Entries i with each later one of their list, sorted by n, that can be alike and that they have not met."""
    d = 1
    while len(i):
        i = i[i + d < len(key)]
        i = i[(key[i + d] == key[i]) & (n[i + d] - n[i] <= n[i] // SHARE)]
        ok = i[_near(n, spot, i, i + d) & _apart(before, i, i + d)]
        yield ok, ok + d
        d += 1


def _centres(of: np.ndarray, line: np.ndarray, n: np.ndarray, spot: np.ndarray, times: np.ndarray) -> Iterator[np.ndarray]:
    """Of each entry the most frequent entry of its own cell of length and place, and that of the cells around it.

    Entries of one cell can all be alike.  of: the entries' lists.
    """
    high = np.floor(np.log2(n)).astype(np.int64)
    width = np.maximum((np.int64(1) << high) >> 6, 1)
    cell = of << 24 | high << 18 | n // width % 256 << 9 | np.minimum(spot // width, 510)
    order = np.lexsort((line, -times, cell))
    first = order[np.r_[True, cell[order][1:] != cell[order][:-1]]]
    cells = cell[first]
    own = first[np.searchsorted(cells, cell)]
    best = own.copy()
    for step in (a * 512 + b for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b):
        at = np.minimum(np.searchsorted(cells, cell + step), len(cells) - 1)
        other = first[at]
        best = np.where((cells[at] == cell + step) & (times[other] > times[best]), other, best)
    yield own
    yield best


def _unique_pairs(line: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    a = line[np.concatenate([f[0] for f in found])] if found else line[:0]
    b = line[np.concatenate([f[1] for f in found])] if found else line[:0]
    x, y = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    new = (x != y) & np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])][: len(x)]
    return x[new], y[new]


def _reach(key: np.ndarray, n: np.ndarray, spot: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Entries i and the ranges lo to hi of those of their list, as long or longer, that are near in length and place.

    Entries are sorted by key, n and spot.  An entry has a range for each length that occurs near its own.
    """
    if not len(key):
        return
    bits = int(max(n.max(), spot.max()) * 1.04).bit_length() + 1
    of = np.cumsum(np.r_[False, key[1:] != key[:-1]]).astype(np.int64)
    sizes = of << np.int64(bits) | n
    fresh = np.r_[True, sizes[1:] != sizes[:-1]]
    known = sizes[fresh]
    # of entries alike in list, length and place the first stands for all
    place = (np.cumsum(fresh) - 1) << np.int64(bits) | spot
    alike = np.r_[True, place[1:] != place[:-1]]
    i = np.flatnonzero(alike)
    most = n[i] // SHARE
    for own, size in _ranges(np.searchsorted(known, sizes[i]), np.searchsorted(known, sizes[i] + most, side="right")):
        at, near = spot[i[own]], most[own]
        lo = np.searchsorted(place, size << np.int64(bits) | np.maximum(at - near, 0))
        hi = np.searchsorted(place, size << np.int64(bits) | at + near, side="right")
        some = hi > lo
        yield own[some], lo[some], hi[some]


def _crowded(key: np.ndarray, n: np.ndarray, spot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether more than NEAR entries are near each one in its list, and whether it is one of those or near one."""
    place = np.r_[True, (key[1:] != key[:-1]) | (n[1:] != n[:-1]) | (spot[1:] != spot[:-1])][: len(key)]
    each = np.cumsum(place) - 1
    count = np.zeros(int(place.sum()), np.int64)
    for own, lo, hi in _reach(key, n, spot):
        np.add.at(count, own, hi - lo)
    crowded = count > NEAR
    edge = np.zeros(len(key) + 1, np.int64)
    if crowded.any():
        for own, lo, hi in _reach(key, n, spot):
            some = crowded[own]
            np.add.at(edge, lo[some], 1)
            np.add.at(edge, hi[some], -1)
    return crowded[each], crowded[each] | (np.cumsum(edge)[:-1] > 0)


def _pair_batches(line: np.ndarray, found: Iterable[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Rows of _MET of the pairs of entries, each pair of lines once in about PAIRS of them."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for last, (i, j) in chain(((False, f) for f in found), [(True, (line[:0], line[:0]))]):
        held.append((i, j))
        if last or sum(len(f[0]) for f in held) >= PAIRS:
            x, y = _unique_pairs(line, held)
            zero, none = pa.array(np.zeros(len(x), np.int64)), pa.nulls(len(x), pa.binary())
            none_here = pa.array(np.zeros(len(x), np.int32))
            yield pa.RecordBatch.from_arrays([zero, pa.array(x), zero, pa.array(y), none, none, none_here, none_here, none_here], _MET_NAMES)
            held = []


def _bucket_pairs(bucket: int, parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """Pairs of a bucket's lists; of entries that too many are near the entries themselves, paired with frequent lines near them."""
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
    order = np.argsort(columns[0])
    same = np.diff(columns[0][order]) == 0
    order = order[np.r_[False, same] | np.r_[same, False]]
    key, line, n, spot, before, times = (c[order] for c in columns)
    order = np.lexsort((spot, n, key))
    key, line, n, spot, before, times = (c[order] for c in (key, line, n, spot, before, times))
    start = np.flatnonzero(np.r_[len(key) > 0, key[1:] != key[:-1]])
    size = np.diff(np.r_[start, len(key)])
    of = np.repeat(np.arange(len(start)), size)
    hot = size[of] > HOT_LONG
    long = np.flatnonzero(hot)
    home, around = _crowded(key[long], n[long], spot[long])
    much = long[around]

    def found() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        yield from _sweep(key, n, spot, before, np.flatnonzero(~hot))
        if not home.all():
            for i, j in _near_pairs(key[long], n[long], spot[long], before[long], ~home):
                yield long[i], long[j]
        if len(much):
            for j in _centres(of[much], line[much], n[much], spot[much], times[much]):
                ok = _near(n, spot, much, much[j])
                yield much[ok], much[j][ok]

    yield from _pair_batches(line, found())
    if len(much):
        none = pa.nulls(len(much), pa.binary())
        named = [pa.array(key[much] + (bucket << 32)), pa.array(line[much]), pa.array(spot[much]), pa.nulls(len(much), pa.int64()), none, none]
        yield pa.RecordBatch.from_arrays([*named, *(pa.array(c.astype(np.int32)) for c in (n[much], before[much], home[around]))], _MET_NAMES)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _MET from packed lists sorted by bucket: pairs, entries of long lists, and the numbered lines."""
    bucket, held = -1, []
    for batch in batches:
        for b, chunk, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if b < 0:
                line, nodes, bins, n = _table(chunk, body)
                none = pa.nulls(len(line), pa.int64())
                yield pa.RecordBatch.from_arrays([none, pa.array(line), none, none, pa.array(nodes, pa.binary()), pa.array(bins, pa.binary()), pa.array(n.astype(np.int32)), pa.nulls(len(line), pa.int32()), pa.nulls(len(line), pa.int32())], _MET_NAMES)
                continue
            if b != bucket and held:
                yield from _bucket_pairs(bucket, held)
                held = []
            bucket = b
            held.append(_entries(chunk, body))
    if held:
        yield from _bucket_pairs(bucket, held)


def _runs(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[list]:
    """Columns of batches sorted by the first, cut only where it changes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        cut = int(np.searchsorted(key, key[-1]))
        if held and cut == 0 and held[-1].column(0)[-1].as_py() == key[0]:
            held.append(batch)
            continue
        yield [pa.chunked_array([*(h.column(i) for h in held), batch.column(i).slice(0, cut)]) for i in range(columns)]
        held = [batch.slice(cut)]
    if held:
        yield [pa.chunked_array([h.column(i) for h in held]) for i in range(columns)]


def _counts(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BINS).astype(np.int16)


def _may_be_alike(n: np.ndarray, other: np.ndarray, bins: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the counts of code points of i and j, which are n and other long, allow that they are alike."""
    most = 2 * (np.minimum(n, other) // SHARE)
    # a quarter of the classes first: their difference alone may be too great
    ok = np.flatnonzero(np.abs(bins[i, : BINS // 4] - bins[j, : BINS // 4]).sum(axis=1) <= most)
    out = np.zeros(len(i), bool)
    out[ok] = np.abs(bins[i[ok]] - bins[j[ok]]).sum(axis=1) <= most[ok]
    return out


def _ranges(lo: np.ndarray, hi: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of the range, place) for all places of some ranges, about `most` at a time."""
    ends, k = np.cumsum(hi - lo), 0
    while k < len(lo):
        to = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + most, side="right")))
        size = (hi - lo)[k:to]
        yield np.repeat(np.arange(k, to), size), np.repeat(lo[k:to] - np.cumsum(size) + size, size) + np.arange(size.sum())
        k = to


def _near_pairs(block: np.ndarray, n: np.ndarray, spot: np.ndarray, before: np.ndarray, home: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Entries at home with all of their block that are as long or longer, can be alike and have not met.

    Entries are sorted by block, n and spot.  Runs of entries that agree in `before` are passed over as one.
    """
    bits = max(int(n.max()).bit_length() + 1, 16)
    most_blocks = max(1, 1 << (62 - 2 * bits))
    cuts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    for first in range(0, len(cuts), most_blocks):
        begin = int(cuts[first])
        end = int(cuts[first + most_blocks]) if first + most_blocks < len(cuts) else len(block)
        of = np.cumsum(np.r_[False, block[begin + 1 : end] != block[begin : end - 1]]).astype(np.int64)
        length, at, last, here = n[begin:end], spot[begin:end], before[begin:end], home[begin:end]
        name = lambda b, size, where: (b << np.int64(bits) | size) << np.int64(bits) | where
        place = name(of, length, at)
        fresh = np.r_[True, last[1:] != last[:-1]]
        run, starts = np.cumsum(fresh) - 1, np.r_[np.flatnonzero(fresh), len(last)]
        # the lengths that occur in each block, and of each entry those that it can be like
        sizes = of << np.int64(bits) | length
        known = sizes[np.r_[True, sizes[1:] != sizes[:-1]]]
        i = np.flatnonzero(here)
        most = length[i] // SHARE
        for own, size in _ranges(np.searchsorted(known, sizes[i]), np.searchsorted(known, sizes[i] + most, side="right")):
            x, near = i[own], most[own]
            lo = np.searchsorted(place, known[size] << np.int64(bits) | np.maximum(at[x] - near, 0))
            hi = np.searchsorted(place, known[size] << np.int64(bits) | at[x] + near, side="right")
            some = np.flatnonzero(hi > lo)
            lo, hi, x = lo[some], hi[some], x[some]
            for which, r in _ranges(run[lo], run[hi - 1] + 1):
                ok = (last[starts[r]] != last[x[which]]) | (last[x[which]] == 0)
                which, r = which[ok], r[ok]
                for part, j in _ranges(np.maximum(starts[r], lo[which]), np.minimum(starts[r + 1], hi[which])):
                    y = x[which[part]]
                    ok = (length[j] > length[y]) | (j > y) | ~here[j]
                    yield y[ok] + begin, j[ok] + begin


def _across(block: np.ndarray, n: np.ndarray, spot: np.ndarray, before: np.ndarray, home: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Entries i at home with all j of their block, as long or longer, that can be alike and that they have not met.

    Entries that agree in all of this form a cell, and cells are paired first: entries that have met are many.
    """
    order = np.lexsort((home, before, spot, n, block))
    columns = [c[order] for c in (block, n, spot, before, home)]
    start = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in columns], axis=0)])
    size = np.diff(np.r_[start, len(order)])
    cells = [c[start] for c in columns]

    def spread(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All entries of cells x with all of cells y."""
        for which, own in _ranges(start[x], start[x] + size[x]):
            other = y[which]
            for part, j in _ranges(start[other], start[other] + size[other]):
                yield own[part], j

    for x, y in _near_pairs(*cells):
        for i, j in spread(x, y):
            yield order[i], order[j]
    alone = np.flatnonzero((cells[3] == 0) & cells[4] & (size > 1))
    for i, j in spread(alone, alone):
        yield order[i[i < j]], order[j[i < j]]


def _meet_across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs a, b (nodes) of blocks of long lists that no chain of links joins yet.  A pair is met in the block of its shorter line."""
    for columns in _runs(batches, 8):
        block, n, spot, group, home, before = (columns[i].to_numpy() for i in range(6))
        if len(n) < 2:
            continue
        nodes, bins = columns[6].combine_chunks(), _counts(columns[7])
        for i, j in _across(block, n, spot, before, home == 1):
            other = group[i] != group[j]
            i, j = i[other], j[other]
            ok = _may_be_alike(n[i], n[j], bins, i, j)
            if ok.any():
                yield pa.RecordBatch.from_arrays([nodes.take(pa.array(i[ok])), nodes.take(pa.array(j[ok]))], ["a", "b"])


def _alike_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs a, b whose counts of code points allow that they are alike."""
    for batch in batches:
        if batch.num_rows:
            bins, at = np.concatenate([_counts(batch.column(4)), _counts(batch.column(5))]), np.arange(batch.num_rows)
            ok = pa.array(_may_be_alike(batch.column(2).to_numpy(), batch.column(3).to_numpy(), bins, at, at + len(at)))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], ["a", "b"])


def edit_distance(a: str, b: str, most: int = 1) -> int:
    """Edit distance if it is at most `most`, else most + 1: bit-parallel, in a band of 2 most + 1 diagonals.

    Bits hold the differences between neighbours of a column of the table of distances, and the band moves down
    by one row with each column (Hyyro's form of Myers' method).  Common ends are cut first.
    """
    if abs(len(a) - len(b)) > most:
        return most + 1
    lo, end = 0, min(len(a), len(b))
    step = 64
    while lo < end:
        if a[lo : min(lo + step, end)] == b[lo : min(lo + step, end)]:
            lo = min(lo + step, end)
        elif step > 1:
            step = 1
        else:
            break
    cut = 0
    while cut < end - lo and a[len(a) - 1 - cut] == b[len(b) - 1 - cut]:
        cut += 1
    a, b = a[lo : len(a) - cut], b[lo : len(b) - cut]
    if len(a) < len(b):
        a, b = b, a
    gap = len(a) - len(b)
    band = (1 << (2 * most + 1)) - 1
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << (i + most)
    up, down, score = band & ~((1 << most) - 1), 0, gap
    for j, c in enumerate(b):
        equal = places.get(c, 0) >> j & band
        flat = ((((equal & up) + up) ^ up) | equal | down) & band
        rise, fall = down | band & ~(flat | up), flat & up
        score += not flat >> (most + gap) & 1
        if score > most:
            return most + 1
        down = flat >> 1 & rise
        up = fall | band & ~(flat >> 1 | rise)
    return score


def _joined(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the texts with a place behind each, their starts and lengths."""
    points = np.frombuffer(("\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t) for t in texts], np.int64)
    return points, np.cumsum(sizes + 1) - sizes - 1, sizes


def within(pairs: list[tuple[str, str]], most: np.ndarray) -> np.ndarray:
    """Whether the edit distance of each pair is `most` at most, by the furthest places that e edits reach on each diagonal.

    e edits reach no diagonal from which the end is out of reach of the rest, so most + 1 diagonals or fewer are held.
    """
    out = np.zeros(len(pairs), bool)
    points, starts, sizes = zip(*(_joined(t) for t in zip(*(sorted(p, key=len) for p in pairs), strict=True)), strict=True)
    # code points in as few bytes as hold them, beside two values that end the texts of either side
    kind = np.dtype(next(k for k in ("<u1", "<u2", "<u4") if max(int(p.max(initial=0)) for p in points) + 3 <= np.iinfo(k).max))
    words = []
    for k in (0, 1):
        body = np.zeros(len(points[k]) + 8, kind)
        body[: len(points[k])] = points[k] + np.uint32(2)
        body[starts[k] + sizes[k]] = k
        words.append(np.ndarray((len(points[k]) + 1,), "<u8", body.tobytes(), strides=(kind.itemsize,)).copy())
    step = int(kind.itemsize).bit_length() + 2  # 8, 16 or 32 bits of a code point, as a power of two
    m, n = sizes
    gap = n - m
    here = np.flatnonzero(gap <= most)
    if not len(here):
        return out
    # diagonals -slack to gap + slack: an edit off these would need as many back
    slack = (most[here] - gap[here]) // 2
    zero, wide = int(slack.max()), int((gap[here] + slack).max() + slack.max()) + 1
    diagonal = np.arange(-zero, wide - zero, dtype=np.int32)
    limit = np.minimum(m[here, None], n[here, None] - diagonal).astype(np.int32)
    limit[(diagonal < -slack[:, None]) | (diagonal > (gap[here] + slack)[:, None])] = -2
    far = np.full((len(here), wide + 2), -2, np.int32)  # a border on either side
    for e in range(int(most[here].max()) + 1):
        lo, hi = max(zero - e, 0), min(zero + e + 1, wide)
        old = far[:, lo + 1 : hi + 1]
        if e:
            reach = np.maximum(old, far[:, lo + 2 : hi + 2]) + np.int32(1)
            np.maximum(reach, far[:, lo:hi], out=reach)
            np.minimum(reach, limit[:, lo:hi], out=reach)
            reach[(reach < 0) | (reach < -diagonal[lo:hi])] = -2
        else:
            reach = np.zeros_like(old)
        row, column = np.nonzero((reach < limit[:, lo:hi]) & (reach > old))
        i = reach[row, column].astype(np.int64)
        a, b = starts[0][here[row]] + i, starts[1][here[row]] + i + diagonal[lo + column]
        begin, some = a.copy(), np.arange(len(row))
        while len(some):
            x = words[0][a[some]] ^ words[1][b[some]]
            same = (np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) >> step).astype(np.int64)
            a[some] += same
            on = same == 64 >> step
            some = some[on]
            b[some] += 64 >> step
        reach[row, column] = i + a - begin
        far[:, lo + 1 : hi + 1] = reach
        done = far[np.arange(len(here)), zero + 1 + gap[here]] >= m[here]
        out[here[done]] = True
        go = ~done & (most[here] > e)
        if not go.any():
            break
        if not go.all():
            here, limit, far = here[go], limit[go], far[go]
    return out


def alike(pairs: list[tuple[str, str]]) -> np.ndarray:
    """Whether each pair of lines is alike.  Pairs of about one length are taken together."""
    least = np.array([min(len(a), len(b)) for a, b in pairs], np.int64)
    most = np.array([edits(n) for n in least], np.int64)
    out = np.zeros(len(pairs), bool)
    some = np.flatnonzero((most > 0) & (most <= MOST_AT_ONCE))
    some = some[np.argsort(least[some], kind="stable")]
    lo, sizes = 0, least[some]
    ends = np.cumsum(sizes)
    while lo < len(some):  # of about one length, and so many that the texts and the places reached take some MB
        hi = min(lo + 2048, int(np.searchsorted(ends, ends[lo] - sizes[lo] + (1 << 19), side="right")), int(np.searchsorted(sizes, sizes[lo] * 5 // 4, side="right")))
        hi = max(hi, lo + 1)
        part = some[lo:hi]
        out[part] = within([pairs[i] for i in part], most[part])
        lo = hi
    for i in np.flatnonzero(most > MOST_AT_ONCE):
        out[i] = edit_distance(*pairs[i], int(most[i])) <= most[i]
    return out


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs a, b, ta, tb whose texts are alike."""
    for whole in batches:
        for lo in range(0, whole.num_rows, 16384):
            batch = whole.slice(lo, 16384)
            keep = pa.array(alike(list(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True))), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(keep) for k in (0, 1)], ["a", "b"])


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (from 1), line of every line of every document that is not blank."""
    split = F.split(F.coalesce(F.col("text"), F.lit("")), "\n")
    return docs.select("doc_id", F.posexplode(split).alias("at", "line")).where(F.trim("line") != "").select("doc_id", (F.col("at") + 1).alias("line_no"), "line")


def _md5(line: Column | str) -> Column:
    return F.unhex(F.md5(F.col(line).cast("binary") if isinstance(line, str) else line))


def _pairs(pairs: DataFrame) -> DataFrame:
    """Each pair a, b (nodes) once."""
    return materialize(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "line-pairs")


def _texts(wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """node, text of the wanted nodes.  texts: node, text of each line once."""
    wanted = wanted.distinct()
    return materialize(possibly_in(texts, "node", wanted, "node").join(wanted, "node", "left_semi"), "line-texts")


def _nodes(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node"))


def _links(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs a, b (nodes) of lines that are alike.  found: node, text of all of them."""
    both = pairs.join(found.toDF("a", "ta"), "a").join(found.toDF("b", "tb"), "b")
    return materialize(both.select("a", "b", "ta", "tb").mapInArrow(_verify, "a binary, b binary"), "line-links")


def long_links(lines: DataFrame, chars: int) -> DataFrame:
    """Links a, b (nodes) of different lines of LONG code points or more.  lines: node, text, occurrences; chars: of all of them."""
    buckets = max(16, -(-int(chars * DENSITY) // BUCKET_ENTRIES))
    classes = lines.sparkSession.sparkContext.broadcast(gram_classes(lines, chars))
    packed = lines.select("node", "text", "occurrences").mapInArrow(_pack(buckets, classes), _BLOBS)
    dealt = packed.repartition(buckets, F.when(F.col("bucket") < 0, F.xxhash64("chunk")).otherwise(F.col("bucket").cast("long")))
    found = materialize(dealt.sortWithinPartitions("bucket").mapInArrow(_meet, _MET), "long-lists")
    table = found.where("node is not null").select("line", "node", "bins", "n")
    pairs = found.where("other is not null").select(F.col("line").alias("x"), F.col("other").alias("y")).distinct()
    both = pairs.join(table.toDF("x", "a", "abins", "an"), "x").join(table.toDF("y", "b", "bbins", "bn"), "y")
    pairs = materialize(both.select("a", "b", "an", "bn", "abins", "bbins").mapInArrow(_alike_counts, "a binary, b binary"), "line-pairs")
    hot = found.where("node is null and other is null").select("key", "line", "spot", "n", "before", "home")
    none = hot.isEmpty()
    # texts are read once, for the lines that are compared later too
    wanted = _nodes(pairs) if none else _nodes(pairs).unionByName(table.join(hot.select("line").distinct(), "line").select("node"))
    texts = _texts(wanted, lines.select("node", "text"))
    links = _links(pairs, texts)
    if none:
        return links
    # where too many are near, lines that chains join already need not be compared
    groups = components(links).select("node", F.col("class").alias("group"))
    named = table.drop("n").join(groups, "node", "left").select("line", "node", "bins", F.xxhash64(F.coalesce("group", "node")).alias("group"))
    entries = materialize(hot.join(named, "line").drop("line"), "long-entries")
    mixed = entries.groupBy("key").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low != high").select("key")
    # blocks of lengths half as wide as the lengths themselves, and of PLACES places; a line also stands in the blocks
    # next to its own where a shorter one may be that is like it
    length = lambda n: F.floor(F.log(n.cast("double")) * 2.5).cast("int")
    most = F.floor(F.col("n") / SHARE)
    place = lambda c: F.floor(c / PLACES).cast("int")
    left = (
        entries.join(mixed, "key")
        .withColumn("lengths", F.explode(F.array_distinct(F.array(length(F.col("n")), length(F.col("n") - most)))))
        .withColumn("places", F.explode(F.sequence(place(F.col("spot") - most), place(F.col("spot") + most))))
    )
    home = (F.col("home") == 1) & (F.col("lengths") == length(F.col("n"))) & (F.col("places") == place(F.col("spot")))
    blocks = left.select(F.xxhash64("key", "lengths", "places").alias("key"), F.col("n").cast("long").alias("n"), "spot", "group", home.cast("int").alias("home"), F.col("before").cast("long").alias("before"), "node", "bins")
    across = blocks.repartition("key").sortWithinPartitions("key", "n", "spot").mapInArrow(_meet_across, "a binary, b binary")
    return links.unionByName(_links(_pairs(across), texts))


def short_pairs(lines: DataFrame) -> DataFrame:
    """Candidate pairs x, y of lines one edit apart.  lines: short, text."""
    entries = materialize(lines.select("short", "text").mapInArrow(_file, _KEYS), "entries")
    pairs: DataFrame | None = None
    while True:
        sizes = entries.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("longer").alias("all_longer")).where("size > 1 and not all_longer").select("key", "size")
        met = materialize(entries.join(sizes, "key"), "lists")
        hot = F.col("size") > HOT
        closed = F.col("open_to") <= F.col("open_from")
        few = met.where(~hot | closed)
        # a list is short, or closed: its lines of the shorter length are alike, and the one that longer lines
        # meet is like all of these; longer lines that are alike meet in lists of their own length
        least = few.where(hot & ~F.col("longer")).groupBy("key").agg(F.min("line").alias("other"))
        stars = few.where(hot).join(least, "key").select("line", "other")
        short = few.where(~hot)
        left = short.where("not longer").select("key", F.col("line").alias("other"))
        near = short.join(left, "key").where("longer or line < other").select("line", "other")
        found = near.unionByName(stars).where("line != other").select(F.least("line", "other").alias("x"), F.greatest("line", "other").alias("y"))
        pairs = found if pairs is None else pairs.unionByName(found)
        again = met.where(hot & ~closed)
        if again.isEmpty():
            break
        texts = possibly_in(lines.select(F.col("short").alias("line"), "text"), "line", again, "line")
        entries = materialize(again.drop("size").join(texts, "line").select("key", "line", "n", "longer", "open_from", "open_to", "text").mapInArrow(_refile, _KEYS), "entries")
    return pairs


def short_links(lines: DataFrame) -> DataFrame:
    """Links a, b (nodes) of different lines one edit apart.  lines: node, short, text."""
    pairs, named = short_pairs(lines), lines.select("short", "node")
    both = pairs.join(named.toDF("x", "a"), "x").join(named.toDF("y", "b"), "y").select("a", "b")
    found = _pairs(both)
    return _links(found, _texts(_nodes(found), lines.select("node", "text")))


def line_classes(docs: DataFrame) -> DataFrame:
    """One row per different line: where it first occurs, how often, its class, and whether it stays.

    docs: doc_id, text and any other columns.  Columns: doc_id, line_no, line_md5, n_chars, occurrences,
    class_doc_id, class_line_no, class_lines, kept.  A class holds lines linked by chains of likeness; it
    is named by, and keeps, the line that occurs first by (doc_id, line_no), null ids before all others.
    Lines of white space only are left alone and have no row; lines shorter than LEAST_CHARS form classes of
    equal lines only.  Null and empty texts have no lines; a very long line is compared whole.  An empty table
    gives an empty result.  docs is read once.
    """
    node = _md5("line").alias("node")
    n = F.char_length("line")
    found = lines_of(docs).select(node, "doc_id", "line_no", n.alias("n_chars"), F.when(n.between(LEAST_CHARS, LONG), F.col("line")).alias("short"), F.when(n >= LONG, F.col("line")).alias("long"))
    rows = materialize(
        found.groupBy("node").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count(F.lit(1)).alias("occurrences"), F.first("n_chars").alias("n_chars"), F.first("short").alias("short"), F.first("long").alias("long")),
        "lines",
    )
    chars = rows.where(F.col("n_chars") >= LONG).agg(F.sum("n_chars")).first()[0] or 0
    short = rows.where("short is not null").select("node", F.xxhash64("short").alias("short"), F.col("short").alias("text"))
    links = short_links(short)
    if chars:
        links = links.unionByName(long_links(rows.where("long is not null").select("node", F.col("long").alias("text"), "occurrences"), chars))
    groups, rows = components(links), rows.drop("short", "long")
    linked = rows.join(groups, "node")
    heads = linked.groupBy("class").agg(F.min("first").alias("head"), F.count(F.lit(1)).alias("class_lines"))
    classes = materialize(linked.join(heads, "class").select("node", "head", "class_lines"), "line-classes")
    out = rows.join(classes, "node", "left").withColumn("head", F.coalesce("head", "first"))
    return out.select(
        "first.doc_id",
        "first.line_no",
        F.lower(F.hex("node")).alias("line_md5"),
        "n_chars",
        "occurrences",
        F.col("head.doc_id").alias("class_doc_id"),
        F.col("head.line_no").alias("class_line_no"),
        F.coalesce("class_lines", F.lit(1)).cast("long").alias("class_lines"),
        (F.col("first") == F.col("head")).alias("kept"),
    )


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """docs with only the first line of each class left in their texts, and every blank line.

    Documents are told apart by doc_id; rows that repeat an id and a text come out once.
    """
    kept = line_classes(docs).where("kept").select("doc_id", "line_no")
    split = docs.select("doc_id", F.xxhash64("text").alias("hash"), F.posexplode(F.split(F.coalesce(F.col("text"), F.lit("")), "\n")).alias("at", "line")).distinct()
    marked = split.join(kept, split["doc_id"].eqNullSafe(kept["doc_id"]) & (split["at"] + 1 == kept["line_no"]), "left")
    lines = marked.where((F.trim("line") == "") | kept["line_no"].isNotNull()).select(split["doc_id"], "hash", "at", "line")
    texts = lines.groupBy("doc_id", "hash").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias("text"))
    rest = docs.withColumn("__hash", F.xxhash64("text")).drop("text").dropDuplicates(["doc_id", "__hash"])
    named = texts.toDF("__id", "__text_hash", "text")
    joined = rest.join(named, rest["doc_id"].eqNullSafe(named["__id"]) & (rest["__hash"] == named["__text_hash"]), "left")
    return joined.withColumn("text", F.coalesce("text", F.lit(""))).select(*docs.columns)
