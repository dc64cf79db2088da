"""The training-data queries, one for each operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import collocations, decontaminate, exact_dedup, host_rules, html_extract, line_dedup, near_dedup, packing, sharding, toxicity, url_filter, vector_codes, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"), 16)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_text(_table(spark, sf_dir, "pages"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_classes(_table(spark, sf_dir, "documents"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents")).drop("key")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op11_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.host_rules(_table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(_table(spark, sf_dir, "embeddings")).drop("label")


QUERIES = {f.__name__: f for f in (op1_warc, op2_sharding, op3_exact_dedup, op4_url_filter, op5_decontaminate, op6_html_extract, op7_line_dedup, op8_near_dedup, op9_toxicity, op10_packing, op11_host_rules, op12_collocations, op13_vector_codes)}


def _codes_sql(rounds: int = 4) -> str:
    """Product quantisation as a chain of tables: x are the vectors' parts, b0, b1, ... the entries, n0, n1, ... what is nearest to them."""
    steps = ["""
WITH v AS (SELECT row_number() OVER () AS id, vec_id, label, embedding FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
x AS (SELECT id, p, list_transform(embedding[p * len(embedding) // 4 + 1 : (p + 1) * len(embedding) // 4], lambda e: floor(e::DOUBLE * 1024)::BIGINT) AS x
      FROM v, range(0, 4) AS q(p)),
f AS (SELECT id, row_number() OVER (ORDER BY vec_id) - 1 AS c FROM v QUALIFY c < 256),
b0 AS (SELECT p, c, x AS b FROM x JOIN f ON x.id = f.id)"""]
    for k in range(rounds + 1):
        steps.append(f"""
n{k} AS (SELECT id, x.p, any_value(x) AS x, min({{'d': list_sum(list_transform(list_zip(x, b), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'c': c}}) AS near
         FROM x JOIN b{k} ON x.p = b{k}.p GROUP BY 1, 2)""")
        if k < rounds:
            steps.append(f"""
e{k} AS (SELECT p, c, i, floor(sum(e)::DOUBLE / count(*))::BIGINT AS e FROM (SELECT p, near.c AS c, unnest(x) AS e, generate_subscripts(x, 1) AS i FROM n{k}) GROUP BY 1, 2, 3),
s{k} AS (SELECT p, c, list(e ORDER BY i) AS b FROM e{k} GROUP BY 1, 2),
b{k + 1} AS (SELECT b{k}.p, b{k}.c, coalesce(s{k}.b, b{k}.b) AS b FROM b{k} LEFT JOIN s{k} ON b{k}.p = s{k}.p AND b{k}.c = s{k}.c)""")
    return ",".join(steps) + f""",
h AS (SELECT sha256(string_agg(list_aggregate(b, 'string_agg', ','), ',' ORDER BY p, c)) AS codebooks_sha256 FROM b{rounds}),
r AS (SELECT id, string_agg(lower(lpad(to_hex(near.c), 2, '0')), '' ORDER BY p) AS code, sum(near.d)::BIGINT AS error FROM n{rounds} GROUP BY 1)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM v JOIN r ON v.id = r.id, h"""


_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE = {
    "op1_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
o AS (SELECT payload_digest, max(page_id) AS original FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, p.payload_digest,
       CASE WHEN original IS NOT NULL AND page_id <> original THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> original THEN original END AS refers_to
FROM p LEFT JOIN o ON p.payload_digest = o.payload_digest""",
    "op3_exact_dedup": f"""
WITH d AS (SELECT doc_id, sha256({_FOLD.format("coalesce(text, '')")}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)""",
    "op4_url_filter": f"""
WITH r(rule, outcome, h, p) AS (VALUES ('net/', 'block', 'net', '/'), ('example.net/en/', 'allow', 'example.net', '/en/'),
                                       ('example.com/de/', 'block', 'example.com', '/de/'), ('org/fr/', 'allow', 'org', '/fr/')),
u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN url[strpos(url, '://') + 3:] ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, {_FOLD.format("regexp_extract(rest, '^[^/?#]*', 0)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
m AS (SELECT DISTINCT s.host, s.path, first_value(rule) OVER w AS rule, first_value(outcome) OVER w AS outcome
      FROM (SELECT DISTINCT host, path FROM s) s JOIN r ON (s.host = r.h OR s.host LIKE '%.' || r.h) AND starts_with(s.path, r.p)
      WINDOW w AS (PARTITION BY s.host, s.path ORDER BY length(rule) DESC)),
w(pattern) AS (VALUES ('ads-track'), ('spam-farm'), ('ad-server'), ('click-track'), ('link-farm'), ('doubleclick'), ('popunder')),
k AS (SELECT host, path, max_by(pattern, length(pattern)) AS pattern FROM (SELECT DISTINCT host, path FROM s)
      JOIN w ON regexp_matches(lower(host || path), '(^|[^a-z0-9])' || pattern || '([^a-z0-9]|$)') GROUP BY 1, 2)
SELECT s.page_id, s.host, s.path, m.rule,
       coalesce(m.outcome, CASE WHEN k.pattern IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
       CASE WHEN m.rule IS NULL THEN k.pattern END AS pattern
FROM s LEFT JOIN m ON s.host = m.host AND s.path = m.path LEFT JOIN k ON s.host = k.host AND s.path = k.path""",
    "op5_decontaminate": f"""
WITH dw AS (SELECT doc_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, list_aggregate(w[i : i + 9], 'string_agg', ' ') AS t
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (SELECT doc_id, i, n, list_aggregate(w[i : i + n - 1], 'string_agg', ' ') AS t
        FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, pos.n, item_id FROM pos JOIN win ON pos.t = win.t AND pos.n = win.n),
covered AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hit) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY 1)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM dw LEFT JOIN covered ON dw.doc_id = covered.doc_id LEFT JOIN items ON dw.doc_id = items.doc_id""",
    "op11_host_rules": r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
win AS (SELECT doc_id, i, list_aggregate(w[i : i + 7], 'string_agg', ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS k FROM again) GROUP BY 1),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
c AS (SELECT w.doc_id, source, len(w)::BIGINT AS n_words, length(coalesce(list_aggregate(w, 'string_agg', ''), ''))::BIGINT AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup, 0)::BIGINT AS n_dup_lines,
             coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN l ON w.doc_id = l.doc_id LEFT JOIN rep ON w.doc_id = rep.doc_id),
f AS (SELECT *, [n_words < 20, 100 * n_repeat_words > 30 * n_words, 10 * n_symbols > n_words, 10 * n_dup_lines > 3 * n_lines,
                 n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words)] AS failed FROM c),
h AS (SELECT source, r, count(*)::DOUBLE AS n, count(*) FILTER (failed[r])::DOUBLE AS x FROM f, range(1, 6) AS q(r) WHERE source IS NOT NULL GROUP BY 1, 2),
m AS (SELECT r, sum(x) / sum(n) AS mean, count(*) - 1 AS k, sum(n) AS n, sum(n) - sum(n * n) / sum(n) - (count(*) - 1) AS room FROM h GROUP BY 1),
q AS (SELECT m.r, mean, CASE WHEN mean > 0 AND mean < 1 AND any_value(room) > 0
             THEN (sum(h.n * (x / h.n - mean) ** 2) / (mean * (1 - mean)) - any_value(k)) / any_value(room) END AS rho FROM h JOIN m ON h.r = m.r GROUP BY 1, 2),
p AS (SELECT r, mean, CASE WHEN rho > 1e-9 THEN 1 / least(1, rho) - 1 END AS weight FROM q),
bad AS (SELECT source, bool_or(coalesce((x + mean * weight) / (n + weight), mean) > 0.5) AS bad FROM h JOIN p ON h.r = p.r GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed[1] OR failed[2] AS base_failed,
       NOT (failed[1] OR failed[2]) AND NOT coalesce(bad, false) AS kept, coalesce(bad, false) AS host_rejected
FROM f LEFT JOIN bad ON f.source = bad.source""",
    "op12_collocations": rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_FOLD.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
g AS (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 4) AS q(k) WHERE len(w) >= k),
f AS (SELECT lang, k, w[i : i + k - 1] AS words, count(*) AS f FROM g GROUP BY ALL),
c AS (SELECT lang, k, words, f AS a FROM f WHERE k > 1 AND f >= 10),
cuts AS (SELECT c.*, j, l.f AS l, r.f AS r, (1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f) AS score
         FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c
         JOIN f l ON l.lang = c.lang AND l.words = c.words[1 : j] JOIN f r ON r.lang = c.lang AND r.words = c.words[j + 1 :]),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, j) = 1),
sub AS (SELECT lang, words[i : i + 1] AS words, max(a) AS longer FROM (SELECT *, unnest([1, 2]) AS i FROM c WHERE k = 3) GROUP BY ALL),
free AS (SELECT best.*, list_aggregate(best.words, 'string_agg', ' ') AS phrase FROM best LEFT JOIN sub ON best.lang = sub.lang AND best.words = sub.words
         WHERE longer IS NULL OR 100 * longer < 50 * a),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY 1)
SELECT free.lang, row_number() OVER (PARTITION BY free.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM free JOIN n ON free.lang = n.lang QUALIFY rank <= 2000""",
    "op13_vector_codes": _codes_sql(),
}
