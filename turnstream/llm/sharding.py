"""Sharding by jump consistent hashing.

A key's shard follows from the key and the number of shards alone, with no table of a ring; when a shard is
appended, only the rows that it receives move.  Slots number the rows of a shard in key order: rows are cut
into ranges of keys by sampled quantiles, counted, and ranked within (shard, range), so that no task holds a
whole shard.  A key that fills a range alone is cut further by its rows' checksums.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Ranges of keys; at most SHARDS x RANGES counts are joined back.
RANGES = 256
#: Parts of the rows of a key that fills a range, by their checksum.
PARTS = 64
_STEP = np.uint64(2862933555777941757)


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shards of unsigned 64-bit keys, by the generator of Lamping and Veach."""
    keys = keys.astype(np.uint64)
    shard = np.full(len(keys), -1, np.int64)
    nxt = np.zeros(len(keys), np.int64)
    live = np.arange(len(keys))
    while len(live):
        shard[live] = nxt[live]
        keys[live] = keys[live] * _STEP + np.uint64(1)
        unit = (keys[live] >> np.uint64(33)).astype(np.int64) + 1
        nxt[live] = ((shard[live] + 1) * ((1 << 31) / unit)).astype(np.int64)
        live = live[nxt[live] < shards]
    return shard


def _placer(shards: int, bounds: list[int]):
    cuts, times = np.unique(np.array(bounds, np.int64), return_counts=True)
    full = cuts[times > 1]

    def place(key: pd.Series, crc: pd.Series) -> pd.DataFrame:
        known = key.fillna(0).astype("int64").to_numpy()
        raw = known.view(np.uint64)
        # rows of a full key come first in its range, by checksum
        part = np.where(np.isin(known, full), crc.to_numpy(np.int64) * PARTS >> 32, PARTS)
        return pd.DataFrame({
            "shard": jump_hash(raw, shards).astype("int32"),
            "grown": jump_hash(raw, shards + 1).astype("int32"),
            "range": (np.searchsorted(cuts, known, side="right") * (PARTS + 1) + part).astype("int32"),
        })

    place.__annotations__ = {"key": pd.Series, "crc": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(place, "shard int, grown int, range int")


def shard_documents(docs: DataFrame, shards: int = 16, key: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row.

    docs: an integer key, text, and any other columns.  law is `key`: rows with one key share a shard whatever
    their text; a null key is placed as 0.  size is the text's UTF-8 bytes plus 1; a null text counts as empty.
    Slots run from 0 in each shard in the order of key, CRC and size; rows alike in all three are numbered in
    any order; a null key stands with 0.  An empty table gives an empty result.  Texts of any length are read whole.
    grown_shard is the shard with one more; it differs from shard only where it is the new one.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias("key"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"))
    rows = materialize(rows, "sizes")
    found = rows.agg(F.percentile_approx(F.coalesce("key", F.lit(0)), [i / RANGES for i in range(1, RANGES)], 10 * RANGES)).first()[0] or []
    place = _placer(shards, found)
    rows = rows.withColumn("p", place("key", "crc")).select("key", "size", "crc", "p.*")
    counts = rows.groupBy("shard", "range").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "range").orderBy(F.coalesce("key", F.lit(0)), F.col("key").asc_nulls_first(), "crc", "size")
    ranked = rows.withColumn("rank", F.row_number().over(within) - 1)
    # at most shards x RANGES rows, and PARTS more for each key that fills a range
    return ranked.join(F.broadcast(offsets), ["shard", "range"]).select(
        F.col("key").alias("doc_id"),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        (F.col("rank") + F.col("offset")).cast("long").alias("slot"),
        F.col("grown").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = 16, key: str = "doc_id") -> None:
    """Write docs as Parquet under path, a folder `shard=<n>` for each shard."""
    place = _placer(shards, [])
    docs.withColumn("shard", place(F.col(key).cast("long"), F.lit(0).cast("long"))["shard"]).write.partitionBy("shard").mode("overwrite").parquet(path)
