"""Host rules against brute force and SQL, and on nulls, empty and long texts, repeated rows and clashing columns."""

import random
import re
from collections import Counter

import duckdb
import pytest

from turnstream.llm import host_rules, queries

KIND = "doc_id long, text string, source string, n_words long, kept string, host string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, "x", "y") for i, t, s in rows], KIND)


def counts(text):
    """The counts of a text, a window at a time."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    hit = {k for i, w in enumerate(windows) if often[w] > 1 for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def some_text(r):
    words = [r.choice("ab") for _ in range(r.choice([0, 3, 8, 19, 40]))] + [r.choice(["é#", "c", "𝒳", "<p>", "\x00"]) + str(r.randint(0, 30)) for _ in range(r.choice([0, 5, 30]))]
    return "".join(w + r.choice([" ", " ", " ", "\n", "\t ", "\r\n", " \x0b", " "]) for w in words)


def test_counts_against_brute_force(spark):
    r = random.Random(4)
    rows = [(i, some_text(r), f"s{i % 3}") for i in range(300)]
    rows += [(900, None, "s0"), (901, "", None), (902, " \n\n ", ""), (903, "a b c d e f g h " * 3, "s1"), (904, "x\n\nx\n x\nx", "s1"), (905, "w" * 300_000, "s1"), (906, " ".join(f"v{i % 5000}" for i in range(60_000)), "s2")]
    got = {x.doc_id: x for x in host_rules.host_rules(docs(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        x = got[i]
        want = counts(t)
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == want, (i, t[:80] if t else t)
        assert x.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert x.kept == (not x.base_failed and not x.host_rejected)


def test_bad_hosts_take_their_documents_along(spark):
    good = " ".join(f"word{i}" for i in range(30))
    rows = [(i, good, f"good{i % 8}") for i in range(400)]
    rows += [(1000 + i, good if i % 10 == 0 else "spam " * 30, "bad") for i in range(200)]  # nine in ten fail
    rows += [(2000, "short", "new")]  # one failure says little
    rows += [(2001, good, "new"), (2002, good, None), (2003, "short", None)]
    got = {x.doc_id: x for x in host_rules.host_rules(docs(spark, rows)).collect()}
    assert not any(got[i].kept for i in range(1000, 1200)) and not got[1000].base_failed and got[1000].host_rejected
    assert all(got[i].kept for i in range(400)) and got[2001].kept and got[2002].kept and not got[2003].kept
    left = host_rules.drop_failed(docs(spark, [*rows, *rows[:3]]))
    assert left.columns == docs(spark, []).columns
    assert sorted({x.doc_id for x in left.collect()}) == [*range(400), 2001, 2002] and left.count() == 405


def test_rates_move_to_the_mean_by_evidence(spark):
    hosts = spark.createDataFrame([(f"h{i}", 100, i * 5) for i in range(11)] + [("small", 1, 1), ("large", 10_000, 3000)], "host string, n_docs long, bad long")
    got = {x.host: x.rate_bad for x in host_rules.shrunk_rates(hosts, ["bad"]).collect()}
    mean = (sum(i * 5 for i in range(11)) + 1 + 3000) / (1100 + 1 + 10_000)
    assert mean < got["small"] < 0.75 and abs(got["large"] - 0.3) < 0.005
    assert 0 < got["h0"] < mean and got["h10"] < 0.5 and all(got[f"h{i}"] < got[f"h{i + 1}"] for i in range(10))
    same = spark.createDataFrame([(f"h{i}", 100, 10) for i in range(5)], "host string, n_docs long, bad long")
    assert {round(x.rate_bad, 9) for x in host_rules.shrunk_rates(same, ["bad"]).collect()} == {0.1}


def test_empty_table(spark):
    assert host_rules.host_rules(docs(spark, [])).count() == 0
    assert host_rules.drop_failed(docs(spark, [])).count() == 0


def test_sql_where_hosts_fail(spark, tmp_path):
    r = random.Random(5)
    rows = [(i, (some_text(r) + " ") * r.choice([1, 1, 2]) if i % 7 else "bad " * 25, f"s{i % 7 if i % 5 else 7}") for i in range(400)] + [(999, None, None)]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select doc_id, text, source from '{tmp_path}/documents.parquet/*.parquet'")
    rel = con.execute(queries.ORACLE["op11_host_rules"])
    names = [x[0] for x in rel.description]
    got = queries.op11_host_rules(spark, str(tmp_path))
    assert sorted(map(tuple, got.select(*names).collect()), key=repr) == sorted(rel.fetchall(), key=repr)
    assert got.where("host_rejected").count() > 20


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    rel = con.execute(queries.ORACLE["op11_host_rules"])
    names = [x[0] for x in rel.description]
    assert sorted(map(tuple, queries.op11_host_rules(spark, sf).select(*names).collect())) == sorted(rel.fetchall())
