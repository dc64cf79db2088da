"""Phrase mining against brute force and SQL, over many ranges and shards, and on nulls, long texts and clashing columns."""

import random
import re
from collections import Counter

import duckdb
import pyarrow as pa
import pytest

from turnstream.llm import collocations, queries

KIND = "doc_id long, text string, lang string, phrase string, n long, link string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, x, "p", 1, "l") for i, t, x in rows], KIND)


def pieces(text):
    text = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return [w for p in re.split(r"[.,;:!?\x0A-\x0D]", text) if (w := re.findall(r"[^\x20\x09]+", p))]


def counted(rows, longest):
    found = {}
    for _, text, lang in rows:
        f = found.setdefault(lang or "und", Counter())
        for w in pieces(text):
            f.update(tuple(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    return found


def mined(rows, longest=3, least=10, top=2000, share=50):
    out = set()
    for lang, f in counted(rows, longest).items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        a = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        inside = Counter()
        for p, c in a.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], c)
        scored = []
        for p, c in a.items():
            if 100 * inside[p] < share * c or p not in inside:
                s, k = min((10**6 * c * c // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-s, -c, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out |= {(lang, i + 1, p.decode(), -c, left, right, n, -s) for i, (s, c, p, left, right) in enumerate(sorted(scored)[:top])}
    return out


def text_of(r, n, words="abcdefgh"):
    return "".join(r.choice(words) + r.choice(["", "", "É", "x"]) + r.choice([" "] * 8 + ["\t", ". ", ",", "\n", "  ", " :"]) for _ in range(n))


@pytest.fixture
def rows():
    r = random.Random(11)
    rows = [(i, text_of(r, r.choice([0, 5, 60, 300])), r.choice(["en", "en", "en", "de", None, "und"])) for i in range(120)]
    return [*rows, (900, None, "en"), (901, "", "fr"), (902, "the " * 5000, "en"), (903, "Of The " * 3000, "en"), *rows[:5]]


@pytest.mark.parametrize("range_words, shard", [(1 << 21, 1 << 21), (700, 900)])
def test_against_brute_force(spark, rows, monkeypatch, range_words, shard):
    monkeypatch.setattr(collocations, "SHARD_WORDS", shard)
    got = collocations.collocations(docs(spark, rows).repartition(5), range_words=range_words).collect()
    want = mined(rows)
    assert len(got) == len(want) > 100 and {tuple(x) for x in got} == want


def test_longer_phrases_few_and_ties(spark, rows):
    got = {tuple(x) for x in collocations.collocations(docs(spark, rows), longest=5, least=4, top=50, nested_share=70, range_words=900).collect()}
    assert got == mined(rows, 5, 4, 50, 70)


def test_nothing_to_find(spark):
    assert collocations.collocations(docs(spark, [])).count() == 0
    assert collocations.collocations(docs(spark, [(1, None, None), (2, " .\n", "en"), (3, "solo", "en")])).count() == 0


def test_one_long_text(spark):
    r = random.Random(3)
    rows = [(1, text_of(r, 200_000), "en")]
    assert {tuple(x) for x in collocations.collocations(docs(spark, rows)).collect()} == mined(rows)


def test_cut_tries_give_back_the_whole():
    r = random.Random(5)
    for _ in range(60):
        words, piece, _ = collocations.words_of(*collocations.text_buffer(pa.array([text_of(r, 40, "abc") for _ in range(4)])))
        trie = collocations.count_words(words, piece, 3)
        nodes = lambda t, skip=(0, 0, 0): [(t.path(k, i), int(t.levels[k][2][i])) for k in range(3) for i in range(skip[k], len(t.levels[k][0]))]
        borders = sorted(tuple(r.choice([b"a", b"ax", b"b", b"bb", b"c\xc3\x89", b"zz"]) for _ in range(r.randint(1, 3))) for _ in range(r.randint(0, 5)))
        borders = sorted(set(borders))
        cuts = [[(0, 0)] * 3, *(trie.lower(b) for b in borders), [(len(x[0]), 0) for x in trie.levels]]
        found = []
        for at, (low, high) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if part := trie.cut(low, high):
                back = collocations.Trie.load(part[0].dump(), 3)
                own = nodes(back, part[1])
                assert all((not at or p >= borders[at - 1]) and (at == len(borders) or p < borders[at]) for p, _ in own)
                found += own
                ancestors = [p for p, _ in nodes(back) if (p, 0) not in own and at and p == borders[at - 1][: len(p)] and p < borders[at - 1]]
                assert len(ancestors) == sum(part[1])
        assert sorted(found) == sorted(nodes(trie))


def test_sql(spark):
    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    rel = con.execute(queries.ORACLE["op12_collocations"])
    names = [x[0] for x in rel.description]
    got = queries.op12_collocations(spark, "/root/testdata/sf0.001").select(*names)
    assert sorted(map(tuple, got.collect())) == sorted(rel.fetchall())
