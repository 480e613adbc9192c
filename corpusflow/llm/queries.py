"""The queries of the ten operators over the driver's tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm import ann, decontaminate, html_text, jaccard_join, licenses, line_dedup, packing, quality, secrets, substring_dedup
from corpusflow.session import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(run):
        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return run

    return add


WS = r"chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

SECRETS_SQL = r"""
WITH re AS (SELECT '([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)' AS a,
  'AKIA[A-Z0-9]+' AS b, '[0-9a-f]+' AS c, '[A-Za-z0-9+/_-]{20,}' AS d),
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce(source, '') AS owner, coalesce(CAST(doc_id AS VARCHAR), '') AS repo FROM documents),
pats AS (SELECT 0 AS kind, 'assign' AS name, a AS p FROM re UNION ALL SELECT 1, 'access', b FROM re UNION ALL SELECT 2, 'hex', c FROM re UNION ALL SELECT 3, 'owned', d FROM re),
hits AS (SELECT r, kind, name, text, p, regexp_extract_all(text, p) AS ms, CASE WHEN kind = 0 THEN regexp_extract_all(text, p, 2) ELSE regexp_extract_all(text, p) END AS vs,
           string_split_regex(text, p) AS gaps FROM docs, pats WHERE regexp_matches(text, CASE kind WHEN 2 THEN '[0-9a-f]{16}' ELSE p END)),
each AS (SELECT r, kind, name, unnest(range(1, len(ms) + 1)) AS i, ms, vs, gaps FROM hits),
sized AS (SELECT r, kind, name, i, ms[i] AS m, vs[i] AS v, len(gaps[i]) AS gap, len(ms[i]) AS n FROM each),
placed AS (SELECT r, kind, name, v, n, sum(gap + n) OVER (PARTITION BY r, kind ORDER BY i) - n AS s FROM sized),
ok AS (SELECT r, kind, name, v, CAST(s AS BIGINT) AS s, CAST(s + n AS BIGINT) AS e FROM placed WHERE
  CASE kind WHEN 0 THEN len(v) >= 12 WHEN 1 THEN len(v) >= 18 WHEN 2 THEN len(v) >= 16
  ELSE len(regexp_replace(v, '[^0-9]', '', 'g')) >= 4 AND len(regexp_replace(v, '[^A-Za-z]', '', 'g')) >= 4 END),
cand AS (SELECT * FROM ok WHERE kind < 3 OR NOT EXISTS (SELECT 1 FROM ok o WHERE o.r = ok.r AND o.kind < 3 AND o.s < ok.e AND ok.s < o.e)),
freq AS (SELECT v, count(DISTINCT owner) AS owners, count(DISTINCT repo) AS repos FROM cand JOIN docs USING (r) GROUP BY v),
per AS (SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind) FILTER (kind < 3) AS base,
  string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind) FILTER (kind < 3 OR (owners < 2 AND repos < 8)) AS spans,
  count(*) FILTER (owners < 2 AND repos < 8) AS n_live, count(*) FILTER (owners >= 2 OR repos >= 8) AS n_shared, max(repos) AS max_repos
  FROM cand JOIN freq USING (v) GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_shared, 0) AS n_shared, coalesce(max_repos, 0) AS max_repos
FROM docs LEFT JOIN per USING (r)
"""


@query("op2_secret_scan", SECRETS_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(read_table(spark, sf_dir, "documents"))


LINES_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM docs),
keyed AS (SELECT *, translate(trim(line, {WS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
hot AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE len(k) >= 40 AND doc_id IS NOT NULL GROUP BY k HAVING count(DISTINCT r) >= 5),
marked AS (SELECT r, doc_id, line, i, coalesce(keeper <> doc_id, false) AS gone FROM keyed LEFT JOIN hot USING (k))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r
"""


@query("op6_line_dedup", LINES_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(read_table(spark, sf_dir, "documents"), digest=True)


PACK_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n FROM {docs}),
pieces AS (SELECT doc_id, piece, piece * 2048 AS start, least(2048, n - piece * 2048) AS n_tokens
  FROM (SELECT doc_id, n, unnest(range((n + 2047) // 2048)) AS piece FROM d WHERE n > 0)),
h AS (SELECT n_tokens AS l, count(*) AS c FROM pieces GROUP BY 1),
s AS (SELECT l, row_number() OVER (ORDER BY l) AS j, CAST(sum(c) OVER (ORDER BY l) AS BIGINT) AS cc, CAST(sum(c * l) OVER (ORDER BY l) AS BIGINT) AS tt FROM h),
dp AS (SELECT 1 AS k, j, l * cc - tt AS cost, CAST(0 AS BIGINT) AS prev FROM s
  UNION ALL
  SELECT k, j, least(cost, old), CASE WHEN cost < old THEN prev ELSE -1 END FROM (
    SELECT any_value(p.k) + 1 AS k, b.j AS j, any_value(o.cost) AS old,
      coalesce(min(p.cost + b.l * (b.cc - a.cc) - (b.tt - a.tt)) FILTER (a.j < b.j), 9000000000000000) AS cost,
      coalesce(arg_min(p.j, (p.cost + b.l * (b.cc - a.cc) - (b.tt - a.tt), p.j)) FILTER (a.j < b.j), -1) AS prev
    FROM dp p JOIN s a ON a.j = p.j JOIN s b ON a.j <= b.j JOIN dp o ON o.j = b.j WHERE p.k < least(16, (SELECT count(*) FROM s)) GROUP BY b.j)),
walk AS (SELECT least(16, (SELECT count(*) FROM s)) AS k, (SELECT max(j) FROM s) AS j, false AS cut
  UNION ALL
  SELECT w.k - 1, CASE WHEN p.prev >= 1 THEN p.prev ELSE w.j END, true FROM walk w JOIN dp p ON p.k = w.k AND p.j = w.j WHERE w.k > 1),
bounds AS (SELECT DISTINCT l AS bucket FROM walk JOIN s USING (j)),
own AS (SELECT p.*, (SELECT min(bucket) FROM bounds WHERE bucket >= p.n_tokens) AS bucket FROM pieces p),
placed AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY doc_id NULLS FIRST, piece, n_tokens) - 1 AS p FROM own)
SELECT doc_id, piece, start, n_tokens, bucket, p // (32768 // bucket) AS batch, p % (32768 // bucket) AS slot, bucket - n_tokens AS padding FROM placed
"""


@query("op10_packing", PACK_SQL.replace("{docs}", "documents"))
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


@query("op5_quality_classifier")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query("op1_decontamination")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@query("op8_license_scan")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat_ws("/", "source", "lang", F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("unknown")), F.lit(".txt")))
    return licenses.scan_licenses(read_table(spark, sf_dir, "documents"), path)


@query("op3_html_extraction")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(read_table(spark, sf_dir, "pages"))


@query("op7_nearest_neighbours")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


SUBSTRING_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, doc_id, p, array_to_string(w[p : p + 12], ' ') AS s FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM docs WHERE len(w) >= 13 AND doc_id IS NOT NULL)),
least AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT r, unnest(range(p, p + 13)) AS i FROM win JOIN least USING (s) WHERE m < doc_id),
each AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM docs),
kept AS (SELECT r, count(gone.i) AS n, string_agg(x, ' ' ORDER BY i) FILTER (gone.i IS NULL) AS t FROM each LEFT JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM docs LEFT JOIN kept USING (r)
"""


@query("op4_substring_dedup", SUBSTRING_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(read_table(spark, sf_dir, "documents"), digest=True)


JACCARD_SQL = r"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda p : array_to_string(w[p : p + 2], ' '))) END AS s FROM docs),
each AS (SELECT r, unnest(s) AS x FROM sets WHERE doc_id IS NOT NULL),
rare AS (SELECT x FROM each GROUP BY x HAVING count(*) > 1),
held AS (SELECT r, x FROM each JOIN rare USING (x)),
pairs AS (SELECT a.r AS a, b.r AS b, count(*) AS i FROM held a JOIN held b ON a.x = b.x AND a.r < b.r GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sets p ON p.r = a JOIN sets q ON q.r = b WHERE 100 * i >= 70 * (len(p.s) + len(q.s) - i)),
sym AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT r AS a, r AS b FROM docs UNION SELECT reach.a, sym.b FROM reach JOIN sym ON sym.a = reach.b),
comp AS (SELECT a AS r, min(d.doc_id) AS component_id FROM reach JOIN docs d ON d.r = reach.b GROUP BY 1),
deg AS (SELECT a AS r, count(*) AS n FROM sym GROUP BY 1)
SELECT doc_id, len(s) AS n_shingles, coalesce(n, 0) AS n_similar, component_id FROM sets LEFT JOIN deg USING (r) LEFT JOIN comp USING (r)
"""


@query("op9_jaccard_join", JACCARD_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_documents(read_table(spark, sf_dir, "documents"))
