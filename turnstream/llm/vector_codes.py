"""Product quantisation of vectors with exact integer arithmetic.

Vectors become columnar blocks, an array of one row for each component, and are written once.  Each round is one
treeAggregate over the blocks: a task assigns its parts to the nearest entries, adding up distances dimension by
dimension, and gathers the sums and counts of each entry with np.add.at; the tensors, whose size depends on the
codebooks alone, merge through a reduction tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_groups, materialize

#: Components are scaled by this and floored.
SCALE = 1024
#: Scaled components are held within this, so that distances of a few hundred components fit in 64 bits.
MOST = 1 << 27
#: Vectors of a block, and of the distance table that is worked on at a time.
BLOCK, TILE = 4096, 512
#: Levels of the reduction tree.
DEPTH = 3


def _usable(vectors: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector holds finite numbers only, as an array of doubles."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return vectors.withColumn(vector, F.col(vector).cast("array<double>")).where(F.col(vector).isNotNull() & F.forall(vector, finite))


def scaled(values: np.ndarray) -> np.ndarray:
    return np.floor(values * SCALE).clip(-MOST, MOST).astype(np.int64)


def _to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of vectors: ids and labels as lists, components as bytes of an int32 array (component, vector)."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            column = part.column("vector")
            n = len(column)
            block = np.ascontiguousarray(scaled(column.flatten().to_numpy(zero_copy_only=False)).reshape(n, -1).T.astype(np.int32))
            ids, labels = (pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), part.column(c)) for c in ("vec_id", "label"))
            yield pa.RecordBatch.from_arrays([ids, labels, pa.array([block.tobytes()], pa.binary())], ["ids", "labels", "block"])


def assign(block: np.ndarray, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each part (row) and vector the nearest entry, the lower of equal ones, and its squared distance.

    block: (parts, components of a part, vectors); codebooks: (parts, entries, components of a part).
    """
    parts, width, n = block.shape
    code, error = np.empty((parts, n), np.int64), np.empty((parts, n), np.int64)
    for at in range(0, n, TILE):
        some = slice(at, min(n, at + TILE))
        for p in range(parts):
            distance = np.zeros((block[p, 0, some].size, codebooks.shape[1]), np.int64)
            for d in range(width):
                gap = block[p, d, some, None] - codebooks[p, None, :, d]
                gap *= gap
                distance += gap
            code[p, some] = distance.argmin(axis=1)
            error[p, some] = distance[np.arange(len(distance)), code[p, some]]
    return code, error


def _blocks_of(rows, parts: int, width: int) -> Iterator[np.ndarray]:
    for row in rows:
        block = np.frombuffer(row, np.int32).reshape(parts, width, -1)
        yield block.astype(np.int64)


def _gather(codebooks: np.ndarray):
    """What a task adds to (sums, counts) for one block."""

    def add(total, row):
        parts, entries, width = codebooks.shape
        sums, counts = total if total else (np.zeros(codebooks.shape, np.int64), np.zeros((parts, entries), np.int64))
        for block in _blocks_of([row], parts, width):
            code, _ = assign(block, codebooks)
            for p in range(parts):
                np.add.at(sums[p], code[p], block[p].T)
                np.add.at(counts[p], code[p], 1)
        return sums, counts

    return add


def _join(a, b):
    if not a or not b:
        return a or b
    return a[0] + b[0], a[1] + b[1]


def train(blocks: DataFrame, codebooks: np.ndarray, rounds: int) -> np.ndarray:
    """Codebooks after `rounds` rounds of assignment and replacement by floored means; entries that nothing is nearest to stay."""
    payloads = blocks.select("block").rdd.map(lambda r: bytes(r[0]))
    for _ in range(rounds):
        found = payloads.treeAggregate((), _gather(codebooks), _join, DEPTH)
        if not found:
            break
        sums, counts = found
        codebooks = np.where(counts[..., None] > 0, sums // np.maximum(counts, 1)[..., None], codebooks)
    return codebooks


def first_entries(vectors: DataFrame, parts: int, entries: int) -> np.ndarray:
    """The parts of the vectors with the smallest ids, which are `entries` rows at most; of equal ids, that with the lesser components."""
    rows = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    width = len(rows[0][0]) // parts if rows else 0
    return scaled(np.array([r[0] for r in rows], np.float64)).reshape(len(rows), parts, width).transpose(1, 0, 2).copy()


def digest(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def kept_vectors(vectors: DataFrame, parts: int) -> DataFrame:
    """vec_id, label, vector of the rows that can be coded."""
    plain = _usable(vectors.select("vec_id", "label", F.col("embedding").alias("vector")), "vector").where((F.size("vector") > 0) & (F.size("vector") % parts == 0))
    width = plain.select("vec_id", F.size("vector").alias("width")).orderBy(F.col("vec_id").asc_nulls_last(), "width").limit(1).collect()
    return plain.where(F.size("vector") == (width[0]["width"] if width else 0))


def encode(blocks: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """vec_id, label, code, error of every vector of the blocks."""
    parts, _, width = codebooks.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block = next(_blocks_of([batch.column("block")[row].as_py()], parts, width))
                code, error = assign(block, codebooks)
                text = [bytes(x).hex() for x in code.T.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([batch.column("ids")[row].values, batch.column("labels")[row].values, pa.array(text), pa.array(error.sum(axis=0))], ["vec_id", "label", "code", "error"])

    return blocks.mapInArrow(run, f"vec_id {blocks.schema['ids'].dataType.elementType.simpleString()}, label {blocks.schema['labels'].dataType.elementType.simpleString()}, code string, error long")


def vector_codes(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4) -> DataFrame:
    """One row per vector that can be coded: vec_id, code, error, label_error, codebooks_sha256, label.

    vectors: vec_id, embedding, label and any other columns, which are not read.  Rows whose embedding is null, empty, or
    holds null or non-finite components are dropped, and so are those whose length `parts` does not divide or differs
    from that of the first kept one by vec_id.  Components become floor(1024 x), held within +-2^27.  The codebooks
    begin as the parts of the `entries` (up to 256) smallest kept vec_ids (fewer vectors: fewer entries; null ids come
    last; of rows that repeat an id, the lesser vector first) and are replaced `rounds` times by the floored means of
    what is nearest to each entry, ties to the lower.  code: an index of two hex digits for each part; error: squared
    distances summed over parts; label_error: error summed over equal labels, null labels being one.  An empty table
    gives an empty result.
    """
    if not 1 <= entries <= 256:
        raise ValueError("an index has two hex digits: 1 to 256 entries")
    kept = kept_vectors(vectors, parts)
    kinds = [vectors.schema[c].dataType.simpleString() for c in ("vec_id", "label")]
    blocks = materialize(kept.select("vec_id", "label", "vector").mapInArrow(_to_blocks, f"ids array<{kinds[0]}>, labels array<{kinds[1]}>, block binary"), "blocks")
    start = first_entries(kept, parts, entries)
    if not start.size:
        return kept.limit(0).select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"), "label")
    books = train(blocks, start, rounds)
    coded = materialize(encode(blocks, books).withColumn("group", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("none"))), "codes")
    groups = coded.groupBy("group").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("members"))
    joined = join_groups(coded, materialize(groups, "labels"), "group", "members", coded.count())
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"), "label")
