"""Vector codes against plain Python and SQL, and on nulls, ties, repeated rows, odd lengths and clashing columns."""

import hashlib
import math
import random
from collections import defaultdict

import duckdb
import numpy as np

from turnstream.llm import queries, vector_codes

KIND = "vec_id long, embedding array<float>, label int, code string, error long, block binary"


def table(spark, rows):
    return spark.createDataFrame([(i, v, y, "c", 1, b"x") for i, v, y in rows], KIND)


def coded(rows, parts=4, entries=256, rounds=4):
    """The contract, a vector at a time."""
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v], y) for i, v, y in rows if v is not None and not any(x is None or not math.isfinite(x) for x in v)]
    w = len(kept[0][1]) // parts
    cut = lambda v: [tuple(v[p * w : (p + 1) * w]) for p in range(parts)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0], r[1]))[:entries]
    books = [[cut(v)[p] for _, v, _ in first] for p in range(parts)]
    near = lambda p, x: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        mine = [defaultdict(list) for _ in range(parts)]
        for _, v, _ in kept:
            for p, x in enumerate(cut(v)):
                mine[p][near(p, x)[1]].append(x)
        books = [[tuple(sum(c) // len(mine[p][k]) for c in zip(*mine[p][k], strict=True)) if k in mine[p] else e for k, e in enumerate(b)] for p, b in enumerate(books)]
    found = [(i, [near(p, x) for p, x in enumerate(cut(v))], y) for i, v, y in kept]
    by = defaultdict(int)
    for _, n, y in found:
        by[y] += sum(d for d, _ in n)
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, "".join(f"{k:02x}" for _, k in n), sum(d for d, _ in n), by[y], sha) for i, n, y in found]


def test_against_plain_python(spark):
    r = random.Random(2)
    point = lambda: [r.choice([-0.5, 0.25, r.gauss(0, 1), -0.0004]) for _ in range(8)]
    rows = [(r.randint(0, 10**9), point(), r.choice([None, 1, 1, 2])) for _ in range(400)]
    rows += rows[:20]  # repeated rows
    rows += [(i, rows[0][1], 7) for i in range(60)]  # ties: many entries alike, most of them never used
    rows += [(-1, None, 1), (-2, [1.0, None, *[0.0] * 6], 1), (-3, [float("nan")] + [0.0] * 7, 1), (-4, [float("-inf")] * 8, None)]
    got = vector_codes.vector_codes(table(spark, rows).repartition(7), entries=100)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256", "label"]
    assert sorted(map(tuple, got.drop("label").collect())) == sorted(coded(rows, entries=100))


def test_fewer_vectors_than_entries_and_other_lengths(spark):
    rows = [(5, [1.0, 2.0, 3.0, 4.0], 1), (6, [1.0, 2.0, 3.0, 5.0], None), (None, [0.0] * 4, None)]
    odd = [(1, [], 1), (2, [1.0, 2.0], 1), (9, [1.0] * 8, 1)]
    got = vector_codes.vector_codes(table(spark, rows + odd)).drop("label").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(coded(rows), key=repr) and {x.error for x in got} == {0}
    far = vector_codes.vector_codes(table(spark, [(1, [3e38, -3e38, 0.0, 1.0], 1), (2, [0.0] * 4, 1)]), entries=1, rounds=0).collect()
    assert {x.vec_id: x.error for x in far} == {1: 0, 2: 2 * vector_codes.MOST**2 + 1024**2}


def test_empty(spark):
    got = vector_codes.vector_codes(table(spark, [(1, None, 1)]))
    assert got.count() == 0 and got.columns[0] == "vec_id"
    assert vector_codes.vector_codes(table(spark, [])).count() == 0


def test_sql(spark):
    con = duckdb.connect()
    con.execute("create view embeddings as select * from '/root/testdata/sf0.001/embeddings.parquet'")
    rel = con.execute(queries.ORACLE["op13_vector_codes"])
    names = [x[0] for x in rel.description]
    got = queries.op13_vector_codes(spark, "/root/testdata/sf0.001").select(*names)
    assert sorted(map(tuple, got.collect())) == sorted(rel.fetchall())
