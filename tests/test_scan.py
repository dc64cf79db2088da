"""Running values in two levels equal those of one pass."""

import random

from pyspark.sql import functions as F

from turnstream.operators import timeline
from turnstream.operators.scan import Running, running


def test_blocks_give_the_values_of_one_pass(spark):
    r = random.Random(1)
    rows = [(k, t, i, r.choice([None, 1, 2, 5, -3])) for k in (1, 2, None) for i, t in enumerate(sorted(r.randint(0, 5000) for _ in range(r.choice([1, 300]))))]
    table = spark.createDataFrame(rows, "key long, at long, i long, v long").repartition(3)
    columns = {f"{kind}_{own}": Running(kind, F.col("v"), own) for kind in ("sum", "max", "last") for own in (True, False)}
    got = running(table.where("key is not null"), ["key"], F.expr("at div 250"), ["at", "i"], columns).collect()
    assert len(got) == sum(k is not None for k, *_ in rows)
    for x in got:
        for own in (True, False):
            past = [v for k, t, i, v in rows if k == x.key and ((t, i) < (x["at"], x.i) or own and (t, i) == (x["at"], x.i)) and v is not None]
            assert (x[f"sum_{own}"], x[f"max_{own}"], x[f"last_{own}"]) == (sum(past), max(past, default=None), past[-1] if past else None)


def test_one_long_recording_is_scanned_in_blocks(spark):
    step, n = 400, 20_000
    units = spark.range(n).select(F.lit(1).cast("long").alias("recording_id"), (F.col("id") * step).alias("start_ms"), (F.col("id") * step + 300).alias("end_ms"))
    chunks = spark.range(n * step // 20_000).select(F.lit(1).cast("long").alias("recording_id"), F.col("id").alias("chunk_idx"), (F.col("id") * 20_000).alias("keep_from_ms"), ((F.col("id") + 1) * 20_000).alias("keep_until_ms"))
    got = timeline.keep_window(units, chunks).collect()
    assert len(got) == n * step // 20_000 and {x.n_units for x in got} == {50} and all(x.first_ms == x.chunk_idx * 20_000 for x in got)
    blocks = units.groupBy(F.expr(f"start_ms div {timeline.BLOCK_MS}")).count()
    assert blocks.count() > 10 and blocks.agg(F.max("count")).first()[0] <= timeline.BLOCK_MS // step
