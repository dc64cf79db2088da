"""The training-data operators against brute force, and on nulls, empty tables, ties and repeated rows."""

import bisect
import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from turnstream.llm import decontaminate, exact_dedup, html_extract, line_dedup, near_dedup, packing, sharding, toxicity, url_filter, warc
from turnstream.llm.common import in_small_batches, word_hashes, text_buffer

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, kept string, node string"  # two columns clash with the operators' own


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], DOCS)


def test_word_hashes_follow_the_words():
    texts = ["Ab cé ab", "", None, "x" * 600_000 + " ab", "AB"]
    h, bounds = word_hashes(*text_buffer(pa.array(texts)))
    assert [int(n) for n in np.diff(bounds)] == [len(WORD.findall((t or "").translate(FOLD))) for t in texts]
    assert h[0] == h[2] == h[4] == h[-1] and h[0] != h[1]


def test_exact_dedup(spark):
    rows = [(1, "A b"), (2, "a B"), (3, None), (4, ""), (None, "a b"), (5, "É"), (6, "é"), (7, "z" * 200_000), (7, "z" * 200_000)]
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs(spark, rows)).collect()}
    assert got == {(1, 2, 3, False), (2, 2, 3, True), (None, 2, 3, False), (3, 4, 2, False), (4, 4, 2, True), (5, 5, 1, True), (6, 6, 1, True), (7, 7, 2, True)}
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0
    assert sorted(r.doc_id for r in exact_dedup.drop_duplicates(docs(spark, rows)).collect()) == [2, 4, 5, 6, 7]


def test_jump_hash_moves_rows_only_to_the_new_shard():
    keys = np.arange(20_000, dtype=np.uint64)
    a, b = sharding.jump_hash(keys, 16), sharding.jump_hash(keys, 17)
    assert ((a == b) | (b == 16)).all() and 800 < (b == 16).sum() < 1600


def test_shards_have_gapless_slots(spark):
    rows = [(i % 900, "t" * (i % 7)) for i in range(1000)] + [(None, None)]
    got = sharding.shard_documents(docs(spark, rows)).collect()
    for shard in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    assert sharding.shard_documents(docs(spark, [])).count() == 0


def jump(key, shards):
    """Shard of a key by the published loop, a step at a time."""
    key, b, j = key % 2**64, -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_shards_against_the_published_loop(spark):
    r = random.Random(8)
    rows = [(r.randint(-(10**12), 10**12), "t" * r.randint(0, 9)) for _ in range(300)] + [(77, f"copy {i}") for i in range(400)] + [(None, "n"), (0, ""), (5, None), (6, "é" * 100_000)]
    got = sharding.shard_documents(docs(spark, rows)).collect()
    key = lambda i: 0 if i is None else i
    size = lambda t: len((t or "").encode()) + 1
    crc = lambda t: zlib.crc32((t or "").encode())
    want = sorted((jump(key(i), 16), key(i), i is not None, crc(t), size(t), jump(key(i), 17)) for i, t in rows)
    slots, made = Counter(), []
    for shard, k, known, c, n, grown in want:
        made.append((k if known else None, n, c, shard, slots[shard], grown))
        slots[shard] += 1
    assert sorted(made, key=repr) == sorted(((x.doc_id, x["size"], x.text_crc32, x.shard, x.slot, x.grown_shard) for x in got), key=repr)


def test_written_shards_hold_every_row(spark, tmp_path):
    rows = [(i, f"t{i}") for i in range(50)]
    sharding.write_shards(docs(spark, rows), f"{tmp_path}/out", 4)
    back = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted((x.doc_id, x.shard) for x in back) == [(i, jump(i, 4)) for i in range(50)]


def test_warc_round_trip(spark, tmp_path):
    long = "<p>é</p>" * 200
    rows = [(1, "http://a", long), (2, None, long), (3, "u", ""), (4, "u", None), (None, "u", long), (5, "u", "short"), (6, "u", "short")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    index = warc.write_bundles(pages, f"file://{tmp_path}")
    got = {(r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc.read_bundles(index).collect()}
    size, sha = len(long.encode()), hashlib.sha1(long.encode()).hexdigest()
    assert (1, "revisit", 2, size, sha) in got and (2, "response", None, size, sha) in got and (None, "revisit", 2, size, sha) in got
    assert (5, "response", None, 5, hashlib.sha1(b"short").hexdigest()) in got and (4, "response", None, 0, hashlib.sha1(b"").hexdigest()) in got
    x = index.where("page_id = 2").first()
    assert warc.read_record(x.bundle, x.frame_at, x.frame_size, x.offset, x.length)["payload"].decode() == long
    assert warc.archive(pages.limit(0)).count() == 0


def test_bundles_in_a_folder_without_a_scheme(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "text"), (2, "u", None)], "page_id long, url string, html string")
    got = warc.read_bundles(warc.write_bundles(pages, f"{tmp_path}/ck")).collect()
    assert sorted(x.payload_bytes for x in got) == [0, 4] and all(x.bundle.startswith(f"file:{tmp_path}/ck/") for x in got)


def test_url_rules(spark):
    urls = {"http://A.example.net/en/1?x": "allow", "https://example.net/de": "block", "http://net": "allow", "http://x.org/fr/": "allow", "http://ads-track.example.org/en/": "block", "nonsense": "allow", None: "allow", "http://notexample.com/de/": "allow"}
    pages = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = {r.page_id: (r.verdict, r.rule) for r in url_filter.filter_urls(pages).collect()}
    assert [got[i][0] for i in range(len(urls))] == list(urls.values())
    assert got[0][1] == "example.net/en/" and got[1][1] == "net/" and got[4][1] is None
    assert url_filter.filter_urls(pages.limit(0)).count() == 0


def test_decontaminate_against_brute_force(spark):
    r = random.Random(1)
    word = lambda: r.choice("abcdefgh")
    items = [(i, " ".join(word() for _ in range(r.choice([0, 3, 9, 10, 14])))) for i in range(12)] + [(99, None)]
    rows = [(i, " ".join([word() for _ in range(30)] + (r.choice(items)[1] or "").upper().split() + [word() for _ in range(20)])) for i in range(60)] + [(None, items[0][1]), (100, None), (101, "")]
    got = {x.doc_id: x for x in decontaminate.decontaminate(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    windows = {(i, tuple(w[k : k + 10])) for i, t in items if t for w in [t.split()] for k in range(max(1, len(w) - 9)) if w}
    for i, t in rows:
        w = WORD.findall((t or "").translate(FOLD))
        hit, found = set(), set()
        for item, x in windows:
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit |= set(range(k, k + len(x)))
                    found.add(str(item))
        assert (got[i].n_words, got[i].n_hit, got[i].n_items) == (len(w), len(hit), len(found))
        assert got[i].items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    assert decontaminate.decontaminate(docs(spark, rows[:2]), spark.createDataFrame([], "item_id long, text string")).where("contaminated").count() == 0


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""), ("", ""), ("<p>", ""),
        ("<nav>menu</nav><article><h1>T &amp; u</h1><p>one\n two<br>three<p><b>four<aside>ad</aside></article><footer>f</footer>", "T & u\none two three\nfour"),
        ("<div class='cookie-notice'>We use cookies for many reasons here</div><div><p>Long text that is the body of the page.</p><p>Ok.</p></div><div id=comments><p>first comment of a reader</p></div>", "Long text that is the body of the page.\nOk."),
        ("<script>var t='<p>no</p>'</script><main><p>yes</p></main>", "yes"),
    ],
)
def test_main_text(page, text):
    assert html_extract.main_text(page) == text


LONG_TEXT = "A sentence of the body that goes on for quite a while, as sentences do. "


@pytest.mark.parametrize(
    "page, text",
    [
        ("<body><p>Short note.</p></body>", "Short note."),
        ("<h2>News</h2><ul><li><a>x</a><li><a>y</a><li><a>z</a></ul><p>" + LONG_TEXT * 3, "News\n" + (LONG_TEXT * 3).strip()),
        ("<div><p>" + LONG_TEXT * 5 + "</p><p><a>A link alone</a></p><p>" + LONG_TEXT * 5 + "</p></div><article><h3>Teaser</h3><p>Read on.</p></article>", f"{(LONG_TEXT * 5).strip()}\nA link alone\n{(LONG_TEXT * 5).strip()}"),
        ("<article><p>" + LONG_TEXT * 9 + "</p><nav><p>a</p><p>b</p><p>c</p></nav><p>End.</p></article><div>Outside.</div>", (LONG_TEXT * 9).strip() + "\nEnd."),
    ],
)
def test_distribution_decides_on_every_page(page, text):
    assert html_extract.main_text(page) == text


BODY = "<p>" + LONG_TEXT * 3 + "</p>"
KEPT = (LONG_TEXT * 3).strip()


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<div class='content-sidebar-wrap'><article>{BODY}</article><aside>x</aside></div>", KEPT),
        (f"<div class='has-sidebar'>{BODY}</div>", KEPT),
        (f"<div class='sidebar'><article>{BODY}</article></div>", KEPT),
        ("<p>Real <span style='display:none'>hidden junk</span> text <span class='share'>Share this</span> end.</p>", "Real text end."),
        ("<p class=it's>second</p><p>third don't stop</p>", "second\nthird don't stop"),
        ("<div><p>Short news item.</p></div>", "Short news item."),
        (f"<article><div class='post-header'><h1>Title</h1></div><p class='intro-alert'>Intro.</p>{BODY}<table class='notice-list'><tr><td>Cell</table><div class='share-box'>Share</div></article>", f"Title\nIntro.\n{KEPT}\nCell"),
        (f"<div class='site-header'>Site</div>{BODY}<div class='newsletter-signup'>Join us for more of this</div><ul class='comments'><li>{LONG_TEXT}</ul>", KEPT),
        (f"<div class='ad'><div class='wrap'>Buy this now</div></div>{BODY}", KEPT),
    ],
)
def test_noise_is_what_an_element_is_named(page, text):
    assert html_extract.main_text(page) == text


def test_hostile_pages_take_linear_time():
    for unit in ("<b>", "</i>", "<div class=ad>", "<h2>x", "<p>x<b>"):
        took = []
        for n in (4000, 16000):
            began = time.process_time()
            html_extract.main_text(unit * n + "</i>" * n)
            took.append(time.process_time() - began)
        assert took[1] < 12 * max(took[0], 0.02), (unit, took)


def test_extracted_table(spark):
    rows = [(1, "u", BODY, "x", 1), (1, "u", BODY, "x", 1), (None, None, None, None, None), (2, "u", "", "y", 2), (3, "u", "<p>" + "long text " * 60_000, "z", 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")
    got = html_extract.extract_text(pages).collect()
    assert sorted((r.page_id or 0, r.text[:9], r.n_chars) for r in got) == [(0, "", 0), (1, KEPT[:9], len(KEPT)), (1, KEPT[:9], len(KEPT)), (2, "", 0), (3, "long text", 599_999)]
    assert html_extract.extract_text(pages.limit(0)).count() == 0


def levenshtein(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def test_banded_edit_distance():
    r = random.Random(3)
    for _ in range(3000):
        a, b = ("".join(r.choice("ab") for _ in range(r.randint(0, 8))) for _ in range(2))
        for most in (1, 2, 3):
            assert line_dedup.edit_distance(a, b, most) == min(levenshtein(a, b), most + 1)


@pytest.mark.parametrize("hot", [64, 2])
def test_line_classes_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    r = random.Random(5)
    base = ["".join(r.choice("abcé ") for _ in range(r.randint(14, 24))) + "." for _ in range(8)]
    lines = []
    for _ in range(90):
        x = list(r.choice(base))
        for _ in range(r.randint(0, 2)):
            k = r.randrange(len(x))
            x[k : k + r.randint(0, 1)] = r.choice(["", "a", "z"])
        lines.append("".join(x))
    rows = [(i, "\n".join(lines[3 * i : 3 * i + 3])) for i in range(30)] + [(40, None), (41, "\n \n")]
    got = {(x.doc_id, x.line_no): (x.class_doc_id, x.class_line_no) for x in line_dedup.line_classes(docs(spark, rows)).collect()}
    first = {}
    for i, t in rows:
        for k, x in enumerate((t or "").split("\n"), 1):
            if x.strip(" "):
                first.setdefault(x, (i, k))
    label = dict(first)
    names, moved = list(first), True
    near = [(x, y) for n, x in enumerate(names) for y in names[:n] if min(len(x), len(y)) >= line_dedup.LEAST_CHARS and levenshtein(x, y) <= 1]
    while moved:
        moved = False
        for x, y in near:
            if label[x] != label[y]:
                label[x] = label[y] = min(label[x], label[y])
                moved = True
    assert got == {first[x]: label[x] for x in names}
    assert line_dedup.line_classes(docs(spark, [])).count() == 0


@pytest.mark.parametrize("hot", [64, 2])
def test_long_lines_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    monkeypatch.setattr(line_dedup, "HOT_LONG", hot)
    monkeypatch.setattr(line_dedup, "PLACES", 4 * hot)
    r = random.Random(11)
    base = ["".join(r.choice("abcdefé ") for _ in range(n)) + "." for n in (62, 63, 64, 80, 127, 128, 257)]
    lines = []
    for _ in range(60):
        x = list(r.choice(base))
        for _ in range(r.randint(0, len(x) // 24 + 1)):
            k = r.randrange(len(x))
            x[k : k + r.randint(0, 1)] = r.choice(["", "a", "zz"[: r.randint(1, 2)]])
        lines.append("".join(x))
    rows = list(enumerate(lines)) + [(900, "On Page 9"), (901, "On Page 8")]
    got = {x.doc_id: x.class_doc_id for x in line_dedup.line_classes(docs(spark, rows)).collect()}
    first = {}
    for i, t in rows:
        first.setdefault(t, i)
    label, moved = dict(first), True
    near = [(x, y) for x in first for y in first if x < y and abs(len(x) - len(y)) < 40 and levenshtein(x, y) <= max(1, min(len(x), len(y)) // 32)]
    assert any(levenshtein(x, y) > 5 for x, y in near)
    while moved:
        moved = False
        for x, y in near:
            if label[x] != label[y]:
                label[x] = label[y] = min(label[x], label[y])
                moved = True
    assert got == {first[x]: label[x] for x in first}


def test_pairs_of_long_lists_are_those_of_a_plain_search():
    r = np.random.default_rng(5)
    rows = sorted((int(r.integers(0, 4)), int(r.integers(64, 140)), int(r.integers(0, 6)), bool(r.integers(0, 2)), int(r.choice([0, 3, 5]))) for _ in range(250))
    rows += [rows[-1]] * 5 + [(9, 80, 3, True, 0)] * 4
    block, n, spot, home, before = (np.array(c) for c in zip(*rows, strict=True))
    pairs = [(int(i), int(j)) for a, b in line_dedup._across(block, n, spot, before, home) for i, j in zip(a, b, strict=True)]
    unordered = {frozenset(p) for p in pairs}
    apart = lambda i, j: before[i] != before[j] or before[i] == 0
    fits = lambda i, j: block[i] == block[j] and home[i] and 0 <= n[j] - n[i] <= n[i] // 32 and abs(spot[i] - spot[j]) <= n[i] // 32 and apart(i, j)
    assert unordered == {frozenset((i, j)) for i in range(len(rows)) for j in range(len(rows)) if i != j and fits(i, j)}


def _bucket(rows):
    """Pairs of lines that a bucket of one list of (line, n, spot, before) meets, and its entries that are left: (line, home)."""
    line, n, spot, before = (np.array(c, np.int64) for c in zip(*rows, strict=True))
    out = [r for b in line_dedup._bucket_pairs(0, [(np.zeros(len(rows), np.int64), line, n, spot, before, np.ones(len(rows), np.int64))]) for r in b.to_pylist()]
    return {(r["line"], r["other"]) for r in out if r["other"] is not None}, {(r["line"], r["home"]) for r in out if r["other"] is None}


def test_a_long_list_of_lines_that_are_not_near_meets_at_once():
    r = random.Random(2)
    rows = [(k, r.randint(64, 2000), r.randint(0, 60), r.choice([0, 0, 3])) for k in range(500)]
    pairs, left = _bucket(rows)
    near = lambda a, b: max(abs(a[1] - b[1]), abs(a[2] - b[2])) <= min(a[1], b[1]) // 32
    assert left == set() and pairs == {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and near(a, b) and (a[3] != b[3] or not a[3])}


def test_only_entries_near_too_many_are_left_for_later(monkeypatch):
    monkeypatch.setattr(line_dedup, "NEAR", 80)
    rows = [(k, 100, 5, 0) for k in range(90)] + [(90, 103, 6, 0), (91, 300, 5, 0), (92, 301, 5, 0)] + [(100 + k, 1000 + 50 * k, 5, 0) for k in range(20)]
    pairs, left = _bucket(rows)
    assert left == {(k, 1) for k in range(90)} | {(90, 0)} and (91, 92) in pairs
    assert {x for p in pairs for x in p if x < 90} == set(range(90))


def test_long_lines_that_are_left_for_later_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "NEAR", 1)
    test_long_lines_against_brute_force(spark, monkeypatch, 2)


@pytest.mark.parametrize("hot", [64, 2])
def test_many_insertions_at_neighbouring_places_are_one_class(spark, monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    base = "abcdefghijklmnopqrstuvwxyz0123456789ABCD"
    rows = [(0, base)] + [(1 + i * 80 + c, base[:k] + chr(0x400 + c) + base[k:]) for i, k in enumerate((18, 19, 20, 21)) for c in range(80)]
    got = line_dedup.line_classes(docs(spark, rows)).collect()
    assert len(got) == 321 and {(x.class_doc_id, x.class_lines) for x in got} == {(0, 321)}


def test_a_shorter_line_meets_all_its_variants_in_closed_lists(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT", 2)
    base = "abcdefghijklmnop"
    more = [base[:k] + z + base[k:] for k in (15, 16) for z in "uvwxyz"]
    lines = spark.createDataFrame([(k + (100 if k else 13), t) for k, t in enumerate([base, *more])], "short long, text string")
    shorts = {r.text: r.short for r in lines.collect()}
    for swap in (1, -1):
        got = {frozenset((x.x, x.y)) for x in line_dedup.short_pairs(lines.selectExpr(f"short * {swap} as short", "text")).collect()}
        assert all(frozenset((shorts[base] * swap, shorts[t] * swap)) in got for t in more)


def test_near_duplicates(spark):
    r = random.Random(7)
    vocabulary = ["w" + str(i) for i in range(3000)]
    rows, family = [], {}
    for g in range(12):
        base = [r.choice(vocabulary) for _ in range(300)]
        for k in range(4):
            w = list(base)
            for _ in range(k):
                w[r.randrange(300)] = "new" + str(r.random())
            family[len(rows)] = g
            rows.append((len(rows), " ".join(w)))
    rows += [(100 + i, " ".join(r.choice(vocabulary) for _ in range(300))) for i in range(20)] + [(200, None), (201, ""), (202, "one two"), (203, "One, two!"), (204, "one")]
    got = {x.doc_id: x.class_id for x in near_dedup.near_duplicates(docs(spark, rows)).collect()}
    for i, g in family.items():
        assert got[i] == min(j for j in family if family[j] == g)
    assert all(got[i] == i for i in (*range(100, 120), 200, 201, 202, 204)) and got[203] == 202
    assert near_dedup.drop_near_duplicates(docs(spark, rows)).count() == 12 + 20 + 4
    assert near_dedup.near_duplicates(docs(spark, [])).count() == 0


def test_common_weight_sorts_no_shingles_by_node(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "RUN", 3)  # so that documents take several rows
    texts = ["a b c d e f g h i j k l", "a b c d e f g h x y z w", "q r s t u v", ""]
    shingle = near_dedup._shingler(type("Idf", (), {"value": np.ones(1 << near_dedup.CELL_BITS, np.float32)}))
    batch = pa.RecordBatch.from_arrays([pa.array([b"1", b"2", b"3", b"4"]), pa.array(texts)], ["node", "text"])
    rows = [r for b in shingle([batch]) for r in b.to_pylist()]
    assert [(r["node"], len(r["shingles"])) for r in rows] == [(b"1", 3), (b"1", 3), (b"1", 2), (b"2", 3), (b"2", 3), (b"2", 2), (b"3", 2)]
    tokens = spark.createDataFrame([(bytearray(r["node"]), r["shingles"], r["weights"]) for r in rows], "node binary, shingles array<long>, weights array<double>")
    classes = spark.createDataFrame([(bytearray(b"1"), bytearray(b"1")), (bytearray(b"2"), bytearray(b"2")), (bytearray(b"3"), bytearray(b"3"))], "node binary, class binary")
    found = near_dedup.common_weight(classes, tokens)
    assert {bytes(r.node): r.c for r in found.collect()} == {b"1": 4.0, b"2": 4.0}
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()


def test_documents_reach_python_in_small_batches(spark, monkeypatch):
    seen, key = [], "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, count = spark.conf.get(key), near_dedup.sum_tables

    def watched(rows, *rest):
        seen.append(max(r.n for r in rows.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").collect()))
        return count(rows, *rest)

    monkeypatch.setattr(near_dedup, "sum_tables", watched)
    near_dedup.inverse_frequencies(docs(spark, [(1, "a")]))
    with pytest.raises(AttributeError):
        in_small_batches(lambda table: near_dedup.inverse_frequencies(table).missing)(docs(spark, [(i, "a b c") for i in range(2500)]).coalesce(1))
    assert seen == [1, 1000] and spark.conf.get(key) == before
    assert near_dedup.near_duplicates.__wrapped__ and toxicity.drop_toxic.__wrapped__


def test_sampling_estimates_weighted_jaccard():
    r = np.random.default_rng(1)
    h = np.unique(r.integers(0, 1 << 48, 4000, dtype=np.uint64))
    agree, true = [], []
    for k in range(60):
        a, b = np.sort(h[k * 40 : k * 40 + 100]), np.sort(h[k * 40 + 20 : k * 40 + 120])
        wa, wb = np.ones(100), np.ones(100) * 1.0
        s = [near_dedup.sample(x, w, np.array([0, len(x)]))[0] for x, w in ((a, wa), (b, wb))]
        agree.append((s[0] == s[1]).mean())
        true.append(near_dedup.similarity((a, wa), (b, wb)))
    assert abs(np.mean(agree) - np.mean(true)) < 0.06


@pytest.mark.parametrize("block", [16, 1024])
def test_block_max_neighbours_are_exact(monkeypatch, block):
    monkeypatch.setattr(toxicity, "BLOCK", block)
    r = np.random.default_rng(2)
    examples = [(i, np.sort(r.choice(50, r.integers(1, 9), replace=False)), None, int(r.integers(0, 2))) for i in range(400)]
    examples = [(i, t, r.integers(1, 4, len(t)).astype(float), y) for i, t, _, y in examples]
    index = toxicity.Index(examples, r.random(50) + 0.5)
    for _ in range(80):
        t = np.sort(r.choice(50, r.integers(1, 9), replace=False))
        c = r.integers(1, 4, len(t)).astype(float)
        rows, sims = index.nearest(t, c)
        q = dict(zip(t, index.vector(t, c), strict=True))
        cosine = {i: sum(q.get(x, 0) * y for x, y in zip(a, index.vector(a, b), strict=True)) for i, a, b, _ in examples}
        exact = sorted((x for x in cosine.values() if x), reverse=True)[: toxicity.NEIGHBOURS]
        assert np.allclose(sims, exact, atol=1e-6)
        assert np.allclose([cosine[int(i)] for i in index.ids[rows]], sims, atol=1e-6)


def test_vocabulary_finds_its_terms_alone():
    r = np.random.default_rng(3)
    keys = np.unique(np.r_[r.integers(0, 1 << 63, 5000, dtype=np.uint64), np.arange(50, dtype=np.uint64), np.uint64(2**64 - 1) - np.arange(50, dtype=np.uint64)])
    known, other = keys[::2], keys[1::2]
    vocabulary = toxicity.Vocabulary(known)
    assert (vocabulary.find(known) == np.arange(len(known))).all() and (vocabulary.find(other) == -1).all()
    assert (toxicity.Vocabulary(known[:0]).find(other) == -1).all()


def test_repeated_ids_and_the_bound_of_examples(spark, monkeypatch):
    rows = [(i, f"text number {i}") for i in range(60)] + [(3, "zebra"), (3, "aardvark"), (5, None)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(4, 1), (4, None)], "doc_id long, toxic int")
    got = {r.doc_id: (r.toxic, r.text) for r in toxicity.labelled_examples(docs(spark, rows), labels).collect()}
    free = {r.doc_id for r in labels.where(toxicity.learnable()).collect()}
    assert set(got) == free and all(got[i][0] == (1 if i == 4 else i % 2) for i in got)
    assert 3 not in got or got[3][1] == "zebra"
    monkeypatch.setattr(toxicity, "EXAMPLE_BYTES", 200)
    few = toxicity.labelled_examples(docs(spark, rows), labels).collect()
    assert 0 < len(few) < len(free) and sum(len(r.text) for r in few) <= 200


def test_a_text_beyond_the_byte_bound_leaves_the_others(spark, monkeypatch):
    learnt = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1]
    first = spark.createDataFrame([(i,) for i in learnt], "doc_id long").orderBy("doc_id").selectExpr("doc_id", "xxhash64(doc_id) AS at").orderBy("at").first().doc_id
    rows = [(i, "x" * 7200 if i == first else f"text of {i}") for i in range(60)]
    monkeypatch.setattr(toxicity, "EXAMPLE_BYTES", 5000)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    got = {x.doc_id for x in toxicity.labelled_examples(docs(spark, rows), labels).collect()}
    assert got == set(learnt) - {first}


def test_toxicity(spark):
    r = random.Random(4)
    text = lambda bad: " ".join(r.choice("the of and to in is it on".split()) for _ in range(40)) + (" scum idiot" if bad else "")
    rows = [(i, text(i % 5 == 0)) for i in range(400)] + [(None, None), (900, "")]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)], "doc_id long, toxic int")
    got = {x.doc_id: x for x in toxicity.score_toxicity(docs(spark, rows), labels).collect()}
    assert all(got[i].predicted == int(i % 5 == 0) for i in range(400)) and got[900].predicted == 0 and got[None].predicted == 0
    assert toxicity.score_toxicity(docs(spark, rows[:3]), labels.limit(0)).where("score = 0").count() == 3
    assert toxicity.score_toxicity(docs(spark, []), labels).count() == 0


def best_fit(sizes, lengths):
    bins, ahead = [], sum(sizes)
    for s in sorted(sizes, reverse=True):
        fits = [b for b in bins if b[0] >= s]
        b = min(fits, key=lambda b: b[0]) if fits else None
        if b is None:
            n = min((n for n in lengths if n >= s), key=lambda n: (packing.bin_cost(n) / min(n, ahead), n))
            b = [n, 0]
            bins.append(b)
        b[0], b[1], ahead = b[0] - s, b[1] + s, ahead - s
    return len(bins), sum(packing.bin_cost(lengths[bisect.bisect_left(lengths, b[1])]) for b in bins)


def test_plan_is_best_fit_decreasing():
    for seed in range(100):
        r = random.Random(seed)
        lengths = tuple(sorted(r.sample([8, 16, 24, 32, 64], 3)))
        sizes = [r.randint(1, lengths[-1]) if r.random() < 0.6 else r.choice([3, 5, 8]) for _ in range(r.randint(0, 120))]
        plan = packing.Plan(Counter(sizes), lengths)
        assert (plan.bins, round(plan.total_cost, 6)) == (best_fit(sizes, lengths)[0], round(best_fit(sizes, lengths)[1], 6))


def least_cost(sizes, lengths):
    """Cost of the best of all ways to deal a few pieces to bins."""
    total = [sum(s for i, s in enumerate(sizes) if m >> i & 1) for m in range(1 << len(sizes))]
    price = [packing.bin_cost(lengths[bisect.bisect_left(lengths, t)]) if t <= lengths[-1] else float("inf") for t in total]
    best = [0.0] * len(total)
    for m in range(1, len(total)):
        low, part, best[m] = m & -m, m, float("inf")
        while part:
            if part & low:
                best[m] = min(best[m], price[part] + best[m ^ part])
            part = (part - 1) & m
    return best[-1]


def test_best_plan_against_the_optimum():
    # one size: the optimum by the number of pieces in each bin
    for size, n in ((600, 3000), (700, 500), (1025, 300), (2731, 200), (5000, 50)):
        best = [0.0]
        for m in range(1, n + 1):
            best.append(min(best[m - j] + packing.bin_cost(packing.LENGTHS[bisect.bisect_left(packing.LENGTHS, size * j)]) for j in range(1, min(m, 8192 // size) + 1)))
        assert packing.best_plan({size: n}).total_cost <= 1.002 * best[n]
    # skewed sizes
    ratios = []
    for seed in range(30):
        r = random.Random(seed)
        sizes = [min(8192, int(r.paretovariate(0.8) * 300)) for _ in range(9)]
        ratios.append(packing.best_plan(Counter(sizes)).total_cost / least_cost(sizes, packing.LENGTHS))
        assert packing.best_plan(Counter(sizes)).total_cost <= packing.Plan(Counter(sizes)).total_cost
    assert min(ratios) > 0.9999 and max(ratios) < 1.3 and np.mean(ratios) < 1.1, (max(ratios), np.mean(ratios))


def test_packing_holds_every_token_once(spark):
    r = random.Random(6)
    rows = [(i, "x" * r.randint(0, 200)) for i in range(300)] + [(None, None), (7, "y" * 5000)]
    got = packing.pack(docs(spark, rows), lengths=(64, 128, 256)).collect()
    assert sum(x["size"] for x in got) == sum(len(t or "") + 1 for _, t in rows)
    for b in {x.bin_id for x in got}:
        inside = sorted((x.bin_start, x["size"], x.bin_length) for x in got if x.bin_id == b)
        ends = [0] + [s + n for s, n, _ in inside]
        assert [s for s, _, _ in inside] == ends[:-1] and ends[-1] <= inside[0][2]
    assert packing.pack(docs(spark, [])).count() == 0


def weighted(texts, words=5):
    """Weighted shingle sets of texts as the operator defines them, with plain Python counts."""
    column = pa.array(texts)
    n = len(texts)
    hashes, counts, bounds, _, _ = near_dedup.shingles(column)
    cells = near_dedup._cells(hashes)
    table = np.bincount(cells, minlength=1 << near_dedup.CELL_BITS)
    idf = (1 + np.log(1.25 * n / (table + 0.25 * n))).clip(0.05).astype(np.float32)
    weights = (counts * idf[cells]).astype(np.float64)
    return [dict(zip(hashes[a:b].tolist(), weights[a:b].tolist(), strict=True)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def test_near_duplicates_against_all_pairs(spark):
    r = random.Random(21)
    vocabulary = ["v" + str(i) for i in range(400)]
    texts = []
    for _ in range(25):
        base = [r.choice(vocabulary) for _ in range(r.choice([40, 120, 300]))]
        for _ in range(r.randint(1, 7)):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 40))):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            texts.append(" ".join(w))
    rows = list(enumerate(texts))
    sets = weighted(texts)

    def similar(x, y):
        low = sum(min(w, y.get(k, 0.0)) for k, w in x.items())
        return low / (sum(x.values()) + sum(y.values()) - low)

    links = [(i, j) for i in range(len(rows)) for j in range(i) if similar(sets[i], sets[j]) >= near_dedup.SIMILARITY]
    got = {x.doc_id: x.class_id for x in near_dedup.near_duplicates(docs(spark, rows)).collect()}
    label = {i: i for i, _ in rows}
    for _ in rows:
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    assert len(links) > 50 and sum(got[i] == got[j] for i, j in links) >= 0.99 * len(links)
    assert all(label[i] == label[got[i]] for i in got)  # no class joins what chains of links do not


def test_stages_drop_rows_and_keep_columns(spark, tmp_path, monkeypatch):
    import corpus_pipeline

    r = random.Random(9)
    prose = lambda n: " ".join(r.choice(["alpha", "beta", "gamma", "delta", "rho", "tau"]) + str(r.randint(0, 500)) for _ in range(n))
    clean = [(i, prose(60)) for i in range(120)]
    toxic = [(200 + i, prose(40) + " scum idiot moron") for i in range(60)]
    item = prose(12)
    near = clean[7][1].split()
    near[30] = "changed"
    near[-1] = "ends"
    rows = [*clean, *toxic, (300, clean[5][1].upper()), (301, " ".join(clean[6][1].split()[:40])), (302, prose(20) + " " + item + " " + prose(20)), (303, clean[8][1] + " extra"), (304, None), (305, "")]
    table = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, 1, int(200 <= i < 300)) for i, _ in rows[:180]], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, str(tmp_path))
        assert left.columns == table.columns
        seen.append({x.doc_id for x in left.collect()})
    want = {i for i, _ in rows} - set(range(200, 300))
    assert seen[0] == want
    want -= {5, 304}  # of equal texts the largest id stays
    assert seen[1] == want
    assert seen[2] == want - {303} or seen[2] == want - {8}
    assert seen[3] == seen[2] - {302}
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x.doc_id for x in packed} == seen[3]
    by_id = dict(rows)
    assert sum(x["size"] for x in packed) == sum(len((by_id[i] or "").encode()) + 1 for i in seen[3])


def test_dropped_lines_leave_the_rest_in_place(spark):
    rows = [(1, "a common line of text\n\nfirst"), (2, "second\na common line of text"), (3, None), (4, "a common lime of text")]
    got = {x.doc_id: x.text for x in line_dedup.drop_repeated_lines(docs(spark, rows)).collect()}
    assert got == {1: "a common line of text\n\nfirst", 2: "second", 3: "", 4: ""}


def test_very_long_texts(spark):
    long = "word " * 150_000
    rows = [(1, long), (2, long + "end"), (3, "short text of a few words")]
    table = docs(spark, rows)
    assert {x.doc_id: x.class_id for x in near_dedup.near_duplicates(table).collect()} == {1: 1, 2: 1, 3: 3}
    item = spark.createDataFrame([(1, "word " * 10), (2, "nothing of the kind")], "item_id long, text string")
    got = {x.doc_id: (x.n_words, x.n_hit) for x in decontaminate.decontaminate(table, item).collect()}
    assert got == {1: (150_000, 150_000), 2: (150_001, 150_000), 3: (6, 0)}
    labels = spark.createDataFrame([(3, 0)], "doc_id long, toxic int")
    assert toxicity.score_toxicity(table, labels).count() == 3
    assert sum(x["size"] for x in packing.pack(table).collect()) == sum(len(t) + 1 for _, t in rows)
    lines = line_dedup.line_classes(table).collect()
    assert {x.class_doc_id for x in lines} == {1, 3} and len(lines) == 3
    url = spark.createDataFrame([(1, "http://example.com/de/" + "a" * 100_000)], "page_id long, url string")
    assert url_filter.filter_urls(url).first().verdict == "block"


def test_a_larger_benchmark_is_joined_by_shuffle(spark, monkeypatch):
    items = spark.createDataFrame([(i, f"w{i} w{i + 1} w{i + 2}") for i in range(0, 30, 3)] + [(99, "solo")], "item_id long, text string")
    rows = [(1, "w0 w1 w2 x w3 w4 w5"), (2, "w1 w2 w3"), (3, "a solo b solo"), (4, "")]
    few = [tuple(x) for x in decontaminate.decontaminate(docs(spark, rows), items).orderBy("doc_id").collect()]
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    many = [tuple(x) for x in decontaminate.decontaminate(docs(spark, rows), items).orderBy("doc_id").collect()]
    assert few == many and [(x[0], x[2], x[3]) for x in few] == [(1, 6, 2), (2, 0, 0), (3, 2, 1), (4, 0, 0)]


def test_clashing_columns_and_frequent_payloads(spark):
    long = "<p>x</p>" * 200
    rows = [(i, "u", long, "d", i) for i in range(30)] + [(100 + i, "u", f"{long}{i // 2}", "d", i) for i in range(6)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string, bytes long")
    got = {x.page_id: x.refers_to for x in warc.archive(pages).collect()}
    assert got == {i: 29 if i < 29 else None for i in range(30)} | {100 + i: 101 + i if i % 2 == 0 else None for i in range(6)}
