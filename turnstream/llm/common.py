"""Helpers shared by the training-data operators: durable intermediates, ASCII case folding,
and byte-level word hashing over Arrow buffers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import stores

#: Word characters are everything but ASCII separators: digits, letters and all non-ASCII.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bytes hashed at a time; the work arrays of one step then stay in cache.
CHUNK = 1 << 18


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, with the scheme that Spark uses for it."""
    return stores.scratch(spark, name)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a batch that Python gets at once from the operators that run in small batches.
BATCH_ROWS = 1000


def in_small_batches(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The operator with Arrow batches of BATCH_ROWS rows for all jobs that it runs before it returns.

    Whole texts travel in them: a batch of the usual 10,000 rows takes tens of MB outside the heap of an executor, and
    as much in each of its Python workers, which keep what they once took.
    """

    @wraps(operator)
    def run(docs: DataFrame, *rest) -> DataFrame:
        conf, key = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
        before = conf.get(key)
        if not 0 < int(before) <= BATCH_ROWS:
            conf.set(key, str(BATCH_ROWS))
        try:
            return operator(docs, *rest)
        finally:
            conf.set(key, before)

    return run


def lower_ascii(c: Column | str) -> Column:
    """Lower-case A-Z only.  The engine's lower() is the same, and faster, where a text is all ASCII."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, _UPPER, _LOWER))


#: Cells of the filters below: what is broadcast is a row of one integer for each cell at most.
CELLS = 1 << 20


def _cell(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(CELLS)).cast("int").alias("__cell")


def possibly_in(df: DataFrame, key: str, wanted: DataFrame, wanted_key: str, how: str = "left_semi") -> DataFrame:
    """Rows of df whose key shares a cell with a wanted key (or, with left_anti, those that do not).

    All rows with a wanted key are among the former, and so few others, where few keys are wanted, that the
    join that follows need not shuffle the table.
    """
    cells = wanted.select(_cell(F.col(wanted_key))).distinct()
    return df.withColumn("__cell", _cell(F.col(key))).join(F.broadcast(cells), "__cell", how).drop("__cell")


#: A group is heavy if it holds more than one in SHARE rows; so at most SHARE groups are, and they may be broadcast.
SHARE = 4096


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """rows with the columns of their group; rows without one go.  groups: key, size (of `total` rows) and any others.

    Heavy groups are broadcast, so that their rows stay where they are; all others are joined by shuffle.
    """
    large = F.col(size) * SHARE > total
    heavy = groups.where(large)
    rest = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(groups.where(~large), key)
    return rows.join(F.broadcast(heavy), key).unionByName(rest)


def row_key(docs: DataFrame) -> Column:
    """A document's id and text as one value that is never null; rows that repeat both share it."""
    return F.concat_ws(":", docs["doc_id"].cast("string"), F.xxhash64(docs["text"]).cast("string"))


def without(docs: DataFrame, gone: DataFrame, once: DataFrame | None = None) -> DataFrame:
    """docs without the rows whose row_key is in gone.__key, and with one row for each key in once.__key.

    Only rows that share a cell with such a key are shuffled.
    """
    keyed = docs.withColumn("__key", row_key(docs))
    odd = gone if once is None else gone.unionByName(once)
    rest = possibly_in(keyed, "__key", odd, "__key", "left_anti")
    some = possibly_in(keyed, "__key", odd, "__key").join(gone, "__key", "left_anti")
    if once is not None:
        some = some.dropDuplicates(["__key"])
    return rest.unionByName(some).select(*docs.columns)


# ---------------------------------------------------------------- byte-level words

_FOLD = np.zeros(256, np.uint8)
_FOLD[0x30:0x3A] = np.arange(0x30, 0x3A)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _tables or len(_tables["up"]) < n:
        size = max(CHUNK + 1, n)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _tables[name] = np.cumprod(steps, dtype=np.uint64)
    return _tables["up"], _tables["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column, without a copy; a null row is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data, offsets - offsets[0] if len(offsets) else offsets


def _piece_hashes(data: np.ndarray, cuts: np.ndarray, stems: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a slice, a row each for the words and for each stem length, and the words' starts.

    cuts: sorted row starts within the slice; a stem's hash is 0 for words that are not longer.
    """
    codes = _FOLD[data]
    word = codes != 0
    start = word.copy()
    start[1:] &= ~word[:-1]
    end = word.copy()
    end[:-1] &= ~word[1:]
    cuts = cuts[cuts < len(data)]
    start[cuts] |= word[cuts]
    inner = cuts[cuts > 0] - 1
    end[inner] |= word[inner]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    up, down = _powers(len(data) + 1)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(codes * up[: len(data)], out=prefix[1:], dtype=np.uint64)
    out = [mix((prefix[e] - prefix[s]) * down[s] + (e - s).astype(np.uint64))]
    for k in stems:
        to = np.minimum(s + k, e)
        out.append(np.where(e - s > k, mix((prefix[to] - prefix[s]) * down[s] + np.uint64(1000 + k)), np.uint64(0)))
    return np.stack(out), s


def _cut(data: np.ndarray, offsets: np.ndarray, at: int) -> int:
    """End of the slice that begins at `at`: about CHUNK bytes on, at a separator or the end of a row."""
    to = at + CHUNK
    if to >= len(data):
        return len(data)
    row_end = int(offsets[np.searchsorted(offsets, to)])
    for lo in range(to, row_end, CHUNK):
        gap = np.flatnonzero(_FOLD[data[lo : min(lo + CHUNK, row_end)]] == 0)
        if len(gap):
            return lo + int(gap[0])
    return row_end


def word_hashes(data: np.ndarray, offsets: np.ndarray, stems: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all rows, and offsets of each row's words; with stems, see _piece_hashes, a matrix.

    Works through slices of about CHUNK bytes that end between words, so that a text of any length needs
    memory for its hashes only.
    """
    n, at, parts, starts = len(data), 0, [], []
    while at < n:
        to = _cut(data, offsets, at)
        lo, hi = np.searchsorted(offsets, [at, to])
        h, s = _piece_hashes(data[at:to], offsets[lo:hi] - at, stems)
        parts.append(h)
        starts.append(s + at)
        at = to
    hashes = np.concatenate(parts, axis=1) if parts else np.zeros((1 + len(stems), 0), np.uint64)
    where = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return hashes if stems else hashes[0], np.searchsorted(where, offsets)


def row_slices(offsets: np.ndarray, limit: int = CHUNK):
    """Ranges of rows of about limit bytes together, at least one row each."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        yield row, min(to, rows)
        row = min(to, rows)


# ---------------------------------------------------------------- tables of counts

#: Parts of a table that are summed apart.
PARTS = 64


def _packed(counts: np.ndarray) -> bytes:
    """Counts as compressed bytes: cells that a task has not met cost nearly nothing."""
    return zstandard.ZstdCompressor(level=1).compress(counts.astype(np.int64).tobytes())


def _unpacked(body: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.int64)


def table_rows(table: np.ndarray, docs: int) -> Iterator[pa.RecordBatch]:
    """A task's table of counts in PARTS rows, with its number of documents; nothing for no documents."""
    if docs:
        parts = np.array_split(table, PARTS)
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([_packed(p) for p in parts], pa.binary()), pa.array([docs if i == 0 else 0 for i in range(PARTS)], pa.int64())], ["part", "counts", "docs"])


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the tables' parts that a task reads."""
    total: dict[int, np.ndarray] = {}
    docs: dict[int, int] = {}
    for batch in batches:
        for part, counts, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            total[part] = total.get(part, 0) + _unpacked(counts)
            docs[part] = docs.get(part, 0) + n
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([_packed(x) for x in total.values()], pa.binary()), pa.array(list(docs.values()), pa.int64())], ["part", "counts", "docs"])


def sum_tables(rows: DataFrame, count, size: int) -> tuple[np.ndarray, int]:
    """Sum of the tables of `size` counts that `count` makes of each task's rows, and of their documents."""
    kind = "part int, counts binary, docs long"
    table = np.array_split(np.zeros(size, np.int64), PARTS)
    n = 0
    for r in rows.mapInArrow(count, kind).repartition(PARTS, "part").mapInArrow(_sum, kind).collect():
        table[r["part"]] = table[r["part"]] + _unpacked(bytes(r["counts"]))
        n += r["docs"]
    return np.concatenate(table), n
