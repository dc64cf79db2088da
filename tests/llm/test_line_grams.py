"""Long lines of op7: the grams they are filed under, how often they are filed, and their distances."""

import random

import numpy as np
import pyarrow as pa
import pytest

from turnstream.llm import line_dedup


def apart(places):
    """Grams of the places that do not overlap, at most."""
    count, end = 0, -1
    for p in places:
        if p >= end:
            count, end = count + 1, p + line_dedup.GRAM
    return count


@pytest.mark.parametrize("skewed", [False, True])
def test_lines_are_filed_under_all_grams_up_to_a_rank_that_the_allowed_edits_cannot_touch(skewed):
    r = random.Random(4)
    lines = ["".join(r.choice("abcdefgh ") for _ in range(n)) for n in (*range(64, 130), 200, 400, 3000) for _ in range(4)] + ["-" * 90, "ab" * 60]
    classes = np.random.default_rng(2).integers(0, 4 if skewed else 1, 1 << 12).astype(np.uint8)
    points = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32)
    bounds = np.cumsum([0, *map(len, lines)])
    hashes = line_dedup.gram_hashes(points)
    found = line_dedup.rare_grams(hashes, bounds, classes)
    rank = lambda at: (int(classes[int(hashes[at]) >> 52]), int(hashes[at]) % (1 << line_dedup.HASH_BITS))
    for k, line in enumerate(lines):
        here = [int(p) for p in found if bounds[k] <= p < bounds[k + 1]]
        assert apart(here) > line_dedup.edits(len(line)) and here == sorted(here)
        worst = max(map(rank, here))
        assert here == [p for p in range(bounds[k], bounds[k + 1] - line_dedup.GRAM + 1) if rank(p) <= worst]
    assert len(found) < 0.09 * len(points)


def test_frequent_grams_are_passed_over():
    phrase = "a phrase that every line has in it "
    r = random.Random(5)
    lines = ["".join(r.choice("bcdefghijk") for _ in range(60)) + phrase + "".join(r.choice("bcdefghijk") for _ in range(60)) for _ in range(50)]
    points = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32)
    hashes, bounds = line_dedup.gram_hashes(points), np.cumsum([0, *map(len, lines)])
    classes = np.zeros(1 << 22, np.uint8)
    classes[(line_dedup.gram_hashes(np.frombuffer(phrase.encode("utf-32-le"), np.uint32)) >> np.uint64(42)).astype(np.int64)] = 9
    found = line_dedup.rare_grams(hashes, bounds, classes)
    own = found - bounds[np.searchsorted(bounds, found, side="right") - 1]
    assert not ((own >= 60) & (own <= 60 + len(phrase) - line_dedup.GRAM)).any()


@pytest.mark.parametrize("letters", ["ab", "abcdefgh ", "aé€", "a😀b\0"])
def test_many_distances_at_once(letters):
    r = random.Random(6)
    pairs = []
    for _ in range(400):
        a = "".join(r.choice(letters) for _ in range(r.choice([1, 8, 20, 64, 65, 130, 300])))
        b = list(a)
        for _ in range(r.randint(0, len(a) // 20 + 1)):
            p = r.randrange(len(b) + 1)
            b[p : p + r.randint(0, 2)] = r.choice(["", r.choice(letters), 2 * r.choice(letters)])
        pairs.append((a, "".join(b))[:: r.choice([1, -1])])
    most = np.array([r.randint(0, 12) for _ in pairs])
    want = [line_dedup.edit_distance(a, b, int(k)) <= k for (a, b), k in zip(pairs, most, strict=True)]
    assert 0 < sum(want) < len(want) and line_dedup.within(pairs, most).tolist() == want


def test_a_line_that_many_partitions_hold_is_filed_once(spark, monkeypatch):
    seen = []
    links = line_dedup.long_links
    monkeypatch.setattr(line_dedup, "long_links", lambda lines, *rest: (seen.append(lines.count()), links(lines, *rest))[1])
    text = "a line that is found in every partition of the table, with many a copy in each of them"
    table = spark.range(0, 64, 1, 16).selectExpr("cast(id as string) doc_id", f"case when id % 2 = 0 then '{text}' else '{text}.' end as text")
    got = line_dedup.line_classes(table).collect()
    assert seen == [2] and {(x.class_doc_id, x.occurrences, x.class_lines) for x in got} == {("0", 32, 2)}


def test_no_lines_have_no_grams():
    assert line_dedup.within([("abc", "abcdefg")], np.array([2])).tolist() == [False]
    found, short = line_dedup._prefixes(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.array([3]))
    assert len(found) == 0 and short.tolist() == [0]
    assert sum(b.num_rows for b in line_dedup._count_grams(iter([pa.RecordBatch.from_arrays([pa.array(["short"])], ["text"])]))) > 0
