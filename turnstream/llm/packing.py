"""Best-fit packing of documents into sequences of several permitted lengths.

Documents are cut into pieces of at most the largest length.  Pieces are packed by best-fit decreasing: each
goes to the open bin that it leaves fullest; if none has room, a bin is opened; at the end each bin shrinks to the
least permitted length that holds its contents.  What length to open is planned in several ways - by what the
pieces that are left can fill, by a least length, and by the tokens still to come - and the cheapest plan is taken.

Only the number of pieces of each size decides the plan.  So the driver plans on that histogram - as many
entries as the largest length, whatever the number of documents - and moves whole runs of equal pieces into
runs of equal bins.  Each piece then finds its move by its rank among the pieces of its size.
"""

from __future__ import annotations

import bisect
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

LENGTHS = (1024, 2048, 4096, 8192)
#: Pieces of one size that are ranked together; the more there are, the more parts they are dealt to.
PART_PIECES = 1 << 14


def bin_cost(length: int, quadratic: float = 32768.0) -> float:
    """Cost of one sequence: linear work, and attention that is quadratic in its length."""
    return length * (1 + length / quadratic)


class Plan:
    """moves: (size, first rank, bin of that rank, pieces a bin, room taken before); lengths: of each run of bins.

    least: no shorter bin is opened; look: bins are opened by what the pieces left can fill, see `looked`.
    """

    def __init__(self, histogram: dict[int, int], lengths: tuple[int, ...] = LENGTHS, cost=bin_cost, least: int = 0, look: bool = False):
        self.lengths = tuple(sorted(set(lengths)))
        self.cost = cost
        self.moves: list[tuple[int, int, int, int, int]] = []
        self.bins = 0
        rooms: list[int] = []  # sorted rooms that have open runs
        open_: dict[int, deque] = {}  # room -> runs (first bin, bins, taken)
        ahead = sum(s * n for s, n in histogram.items())
        self.least = least
        self.spare = dict(histogram)  # pieces that no bin was opened for
        self.sizes = sorted(histogram)

        def put_back(room: int, run: tuple[int, int, int]) -> None:
            if room not in open_:
                open_[room] = deque()
                bisect.insort(rooms, room)
            open_[room].append(run)

        for size in sorted(histogram, reverse=True):
            left, rank = histogram[size], 0
            while left:
                at = bisect.bisect_left(rooms, size)
                if at < len(rooms):
                    room = rooms[at]
                    first, count, taken = open_[room].popleft()
                    if not open_[room]:
                        del open_[room], rooms[at]
                else:
                    length, most = self.looked(size, left) if look else (self.opened(size, ahead), left)
                    room, taken, first = length, 0, self.bins
                    count = min(most, -(-left // (room // size)))
                    self.bins += count
                each = room // size
                full = min(count, left // each)
                if full:
                    self.moves.append((size, rank, first, each, taken))
                    put_back(room - each * size, (first, full, taken + each * size))
                    rank, left, ahead = rank + full * each, left - full * each, ahead - full * each * size
                if full < count:
                    rest = count - full
                    if 0 < left < each:
                        self.moves.append((size, rank, first + full, each, taken))
                        put_back(room - left * size, (first + full, 1, taken + left * size))
                        ahead -= left * size
                        rank, left, rest, full = rank + left, 0, rest - 1, full + 1
                    if rest:
                        open_.setdefault(room, deque())
                        if room not in rooms:
                            bisect.insort(rooms, room)
                        open_[room].appendleft((first + full, rest, taken))
        runs = sorted((first, count, taken) for runs in open_.values() for first, count, taken in runs)
        self.run_first = [r[0] for r in runs]
        self.run_length = [self.lengths[bisect.bisect_left(self.lengths, r[2])] for r in runs]
        self.total_cost = sum(r[1] * cost(n) for r, n in zip(runs, self.run_length, strict=True))

    def opened(self, size: int, ahead: int) -> int:
        """The permitted length of least cost for each token that it can be filled with."""
        return min((n for n in self.lengths if n >= max(size, self.least)), key=lambda n: (self.cost(n) / min(n, ahead), n))

    def looked(self, size: int, left: int) -> tuple[int, int]:
        """The length of least cost for each token that the largest spare pieces put in it, and how many bins they fill."""
        self.spare[size] = left
        best = None
        for n in self.lengths:
            if n < size:
                continue
            used, room, at = {}, n, bisect.bisect_right(self.sizes, size)
            while room and at:
                at = min(at, bisect.bisect_right(self.sizes, room)) - 1
                if at < 0:
                    break
                s = self.sizes[at]
                k = min(self.spare[s], room // s)
                if k:
                    used[s] = k
                    room -= k * s
            fill = n - room
            price = self.cost(self.lengths[bisect.bisect_left(self.lengths, fill)]) / fill
            if best is None or price < best[0]:
                best = (price, n, used)
        _, n, used = best
        count = min(self.spare[s] // k for s, k in used.items())
        for s, k in used.items():
            self.spare[s] -= k * count
        return n, count


def best_plan(histogram: dict[int, int], lengths: tuple[int, ...] = LENGTHS, cost=bin_cost) -> Plan:
    """The cheapest of the plans: the one that looks at what is left, and one for each least length of a bin."""
    plans = [Plan(histogram, lengths, cost, look=True), *(Plan(histogram, lengths, cost, least=n) for n in sorted(set(lengths)))]
    return min(plans, key=lambda p: p.total_cost)


def pieces_of(docs: DataFrame, length: Column, largest: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, piece, start, size: each document cut into pieces of the largest length and a rest."""
    rows = docs.select("doc_id", length.cast("long").alias("n"), *carry)
    cut = F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {largest}"))
    return rows.select("doc_id", *carry, "n", F.posexplode(cut).alias("piece", "k")).select(
        "doc_id", *carry, "piece", (F.col("k") * largest).alias("start"), F.least(F.lit(largest), F.col("n") - F.col("k") * largest).cast("int").alias("size")
    )


def _placer(plan: Plan):
    table = np.array(plan.moves, np.int64).reshape(-1, 5)
    order = np.lexsort((table[:, 1], table[:, 0]))
    table = table[order]
    keys = table[:, 0] * (1 << 44) + table[:, 1]
    first, length = np.array(plan.run_first, np.int64), np.array(plan.run_length, np.int64)
    return keys, table, first, length


def pack(docs: DataFrame, length: Column | None = None, lengths: tuple[int, ...] = LENGTHS, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per piece: doc_id, piece, start, size, bin_id, bin_start, bin_length.

    docs: doc_id, text and any other columns.  length: tokens of a document with its end mark, 1 or more; by
    default the UTF-8 bytes of its text plus 1, as byte-level models read it, so a null or empty text is one
    token.  The pieces of a document have consecutive starts; each piece lies whole in its bin at bin_start.
    Equal pieces are interchangeable: their order is that of (doc_id, piece); rows that repeat a doc_id are
    packed as often as they occur.  An empty table packs nothing.
    """
    spark = docs.sparkSession
    if length is None:
        length = F.octet_length(F.coalesce(F.col("text"), F.lit(""))) + 1
    rows = materialize(pieces_of(docs, F.greatest(length, F.lit(1)), max(lengths), carry), "pieces")
    # at most max(lengths) rows reach the driver, and go back to the tasks
    histogram = {r["size"]: r["n"] for r in rows.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = best_plan(histogram, lengths)
    parts = spark.createDataFrame([(s, -(-n // PART_PIECES)) for s, n in histogram.items()], "size int, parts long")
    salt = F.pmod(F.xxhash64("doc_id", "piece"), F.col("parts")).cast("long")
    rows = rows.join(F.broadcast(parts), "size").withColumn("salt", salt).drop("parts")
    counts = rows.groupBy("size", "salt").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("size", "salt", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    within = Window.partitionBy("size", "salt").orderBy(F.col("doc_id").asc_nulls_first(), "piece")
    ranked = rows.withColumn("rank", F.row_number().over(within) - 1).join(offsets, ["size", "salt"]).withColumn("rank", F.col("rank") + F.col("offset"))
    shared = spark.sparkContext.broadcast(_placer(plan))

    def place(size: pd.Series, rank: pd.Series) -> pd.DataFrame:
        keys, table, first, run_length = shared.value
        s, r = size.to_numpy(np.int64), rank.to_numpy(np.int64)
        move = table[np.searchsorted(keys, s * (1 << 44) + r, side="right") - 1]
        ahead = r - move[:, 1]
        bins = move[:, 2] + ahead // move[:, 3]
        return pd.DataFrame({"bin": bins, "at": move[:, 4] + ahead % move[:, 3] * s, "length": run_length[np.searchsorted(first, bins, side="right") - 1]})

    spot = F.pandas_udf(place, "bin long, at long, length long")
    placed = ranked.withColumn("p", spot(F.col("size").cast("long"), F.col("rank").cast("long")))
    return placed.select("doc_id", *carry, "piece", "start", "size", F.col("p.bin").alias("bin_id"), F.col("p.at").alias("bin_start"), F.col("p.length").alias("bin_length"))
