"""Registered queries over the reference's operators, with their DuckDB oracles.

Every query runs over whole tables. Structs are flattened and ratios rounded, so
that both engines' rows can be compared by value.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpusflow.operators  # noqa: F401  (registers the components)
from corpusflow.functions.fields import field_type, get_field
from corpusflow.operators.aggregations import Counter, aggregate
from corpusflow.operators.gopher import STOP_WORDS
from corpusflow.operators.models import PROFILES
from corpusflow.operators.ocr import SHORT_WORDS
from corpusflow.operators.pii import ENTITIES, PLACEHOLDER, iban_pattern
from corpusflow.plans.base import FilterFn, apply_steps
from corpusflow.plans.registry import components
from corpusflow.session import read_table
from corpusflow.storage import shared_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return run

    return add


def step(category: str, kind: str, **params):
    return components.get(category, kind)(**params)


def flat(df: DataFrame, path: str, *keep: str) -> DataFrame:
    """The fields of a struct as columns; doubles rounded."""
    fields = field_type(df.schema, path).fields
    return df.select(*keep, *[(F.round(get_field(df, f"{path}.{f.name}"), 6) if f.dataType.typeName() == "double" else get_field(df, f"{path}.{f.name}")).alias(f.name) for f in fields])


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def quoted(xs) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in sorted(xs))


# ingest, extract, values

INGEST = "SELECT CAST(doc_id AS VARCHAR) AS id, text, source, lang AS subset, 'CC-BY' AS license, n_chars FROM documents"


@query("ingest_base", INGEST)
def ingest_base(spark, sf_dir):
    df = step("ingest", "base", id_column="doc_id", text_column="text", source_name_or_column="source", subset_name_or_column="lang", license_name_or_column="CC-BY", other=["n_chars"]).transform(docs(spark, sf_dir))
    return df.select("id", "text", "source", "metadata.subset", "metadata.license", "n_chars")


@query("extract_plain", "SELECT doc_id, text AS body FROM documents")
def extract_plain(spark, sf_dir):
    return step("extract", "plain", on="text", to="body").transform(docs(spark, sf_dir)).select("doc_id", "body")


@query("tag_value", "SELECT doc_id, 'v1' AS version, lang AS code, source AS origin FROM documents")
def tag_value(spark, sf_dir):
    df = step("tag", "value", to="m.version", value="v1").transform(docs(spark, sf_dir))
    df = step("tag", "value", on="lang", to="m.code").transform(df)
    df = step("tag", "value", to="source", value="unused", replace_if_present=False).transform(df)
    return df.select("doc_id", "m.version", "m.code", F.col("source").alias("origin"))


@query("extract_html")
def extract_html(spark, sf_dir):
    return step("extract", "html", on="html", to="text").transform(read_table(spark, sf_dir, "pages")).select("page_id", "url", "text")


_TEI = (
    '<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body><head>Top</head><p>One <hi>two</hi><lb/>three<note>gone</note>.</p><list><item>a</item></list></body></text></TEI>',
    "<TEI><text><body><p>x</p><list><item>a</item><item>b</item></list><lg><l>v</l><l>w</l></lg><table><row><cell>1</cell><cell>2</cell></row></table></body></text></TEI>",
)


@query("extract_tei", "SELECT * FROM (VALUES (0, 'Top | One twothree.'), (1, 'x | a. b. v w 1 2. ')) t(id, text)")
def extract_tei(spark, sf_dir):
    df = spark.createDataFrame(list(enumerate(_TEI)), "id int, text string")
    return step("extract", "tei").transform(df).select("id", F.regexp_replace(F.regexp_replace("text", "^\n+|\n+$", ""), "\n+", " | ").alias("text"))


def _as_tei(text):
    """A text as the one paragraph of a TEI document, without the characters that XML doesn't allow."""
    escaped = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.concat(F.lit("<TEI><text><body><p>"), F.regexp_replace(escaped, r"[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]", ""), F.lit("</p></body></text></TEI>"))


@query("extract_tei_documents", "SELECT doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS text FROM documents")
def extract_tei_documents(spark, sf_dir):
    df = step("extract", "tei").transform(docs(spark, sf_dir).withColumn("text", _as_tei(F.col("text"))))
    return df.select("doc_id", F.regexp_replace("text", "^[ \t\n\r]+|[ \t\n\r]+$", "").alias("text"))


# sources and sinks


def _round_trip(kind: str, columns: str, table: str = "customer", **params) -> Query:
    def run(spark, sf_dir):
        path = shared_path(spark, f"trip-{kind}")
        df = read_table(spark, sf_dir, table).selectExpr(*columns.split(", "))
        step("writer", kind).__call__(df, path)
        return step("reader", kind, **params)(spark, path).selectExpr(*columns.split(", "))

    return run


_CUSTOMER = "c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment"
query("round_trip_parquet", f"SELECT {_CUSTOMER} FROM customer")(_round_trip("parquet", _CUSTOMER))
query("round_trip_jsonl", f"SELECT {_CUSTOMER} FROM customer")(_round_trip("jsonl", _CUSTOMER))
query("round_trip_csv", f"SELECT {_CUSTOMER} FROM customer")(_round_trip("csv", _CUSTOMER, dtype={"c_custkey": "int64", "c_nationkey": "int", "c_acctbal": "float64"}))

_DOCUMENT = "doc_id, text, lang, source, n_chars"
query("round_trip_csv_documents", f"SELECT {_DOCUMENT} FROM documents")(_round_trip("csv", _DOCUMENT, "documents", dtype={"doc_id": "int64", "n_chars": "int64"}))
query("round_trip_jsonl_documents", f"SELECT {_DOCUMENT} FROM documents")(_round_trip("jsonl", _DOCUMENT, "documents"))


@query("read_text", "SELECT c_name AS text FROM customer")
def read_text(spark, sf_dir):
    path = shared_path(spark, "trip-text")
    read_table(spark, sf_dir, "customer").select("c_name").write.text(path)
    return step("reader", "text")(spark, path)


# format


@query("format_spacing", r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n\n\n+', chr(10) || chr(10), 'g'), '([\p{L}\p{N}_])-\s*\n\s*([\p{L}\p{N}_])', '\1\2', 'g'), '(^|[^\n])\n([^\n]|$)', '\1 \2', 'g'), '(^|[^\n])\n([^\n]|$)', '\1 \2', 'g'), '  +', ' ', 'g') AS text FROM documents")
def format_spacing(spark, sf_dir):
    return step("format", "spacing").transform(docs(spark, sf_dir)).select("doc_id", "text")


@query("format_ftfy", "SELECT * FROM (VALUES (0, 'fix \"it\"'), (1, 'über'), (2, 'a & b'), (3, 'ab'), (4, 'a\\nb'), (5, NULL)) t(id, text)".replace("'a\\nb'", "'a' || chr(10) || 'b'"))
def format_ftfy(spark, sf_dir):
    df = spark.createDataFrame([(0, "ﬁx “it”"), (1, "Ã¼ber"), (2, "a &amp; b"), (3, "a\x1b[31mb\x07"), (4, "a\r\nb"), (5, None)], "id int, text string")
    return step("format", "ftfy").transform(df).select("id", "text")


@query("format_ftfy_documents")
def format_ftfy_documents(spark, sf_dir):
    return step("format", "ftfy").transform(docs(spark, sf_dir)).select("doc_id", "text")


_S = r"[\p{Z}\t\n\x0b\f\r\x1c-\x1f]"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
_SQL_PII = {
    "CREDIT_CARD": rf"\b(?:\d{{4}}(?:-|{_S})?){{3}}\d{{4}}\b",
    "IBAN_CODE": iban_pattern(r"\d", _S),
    "EMAIL_ADDRESS": rf"(?:[.,?!;:)(@]|{_S})*([^\p{{Z}}\t\n\x0b\f\r\x1c-\x1f@]+@[^\p{{Z}}\t\n\x0b\f\r\x1c-\x1f@,?!;:)(]+?)(?:[.,?!;:)(@]|{_S})?{_S}",
    "PHONE_NUMBER": rf"{_S}+\(?(\d{{3}})\)?[-. ]*(\d{{3}})[-. ]?(\d{{4}})",
    "IP_ADDRESS": rf"(?:{_OCTET}\.){{3}}{_OCTET}",
}


def _pii_sql(entities, redact: bool = False) -> str:
    out = "text"
    for e in ENTITIES:
        if e in entities and e in _SQL_PII:
            out = f"regexp_replace({out}, '{_SQL_PII[e]}', '{'' if redact else PLACEHOLDER['en'][e]}', 'g')"
    return out


def _pii(entities, **params) -> Query:
    def run(spark, sf_dir):
        df = step("format", "pii_regex", language="en", entity_types=list(entities), **params).transform(docs(spark, sf_dir))
        return df.select("doc_id", "text", *[c for c in ("found",) if c in df.columns])

    return run


for _e in _SQL_PII:
    query(f"format_pii_{_e.lower()}", f"SELECT doc_id, {_pii_sql([_e])} AS text FROM documents")(_pii([_e]))
query("format_pii_all", f"SELECT doc_id, {_pii_sql(ENTITIES)} AS text, text IS DISTINCT FROM {_pii_sql(ENTITIES)} AS found FROM documents")(_pii(ENTITIES, flag="found"))
query("format_pii_redact", f"SELECT doc_id, {_pii_sql(ENTITIES, True)} AS text FROM documents")(_pii(ENTITIES, anonymization_method="redact"))


@query("format_pii_scored")
def format_pii_scored(spark, sf_dir):
    return step("format", "pii_presidio", language="en").transform(docs(spark, sf_dir)).select("doc_id", "text")


@query("dedup_exact_paragraph", """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ps FROM documents),
p AS (SELECT doc_id, unnest(ps) AS t, generate_subscripts(ps, 1) AS i FROM d WHERE text <> ''),
k AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id, i) AS n FROM p),
j AS (SELECT doc_id, string_agg(t, chr(10) ORDER BY i) AS text FROM k WHERE n = 1 GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL OR d.text = '' THEN d.text ELSE coalesce(j.text, '') END AS text FROM d LEFT JOIN j USING (doc_id)""")
def dedup_exact_paragraph(spark, sf_dir):
    return step("format", "deduplication", order_by="doc_id", near=False).transform(docs(spark, sf_dir)).select("doc_id", "text")


@query("dedup_minhash")
def dedup_minhash(spark, sf_dir):
    return step("format", "deduplication", order_by="doc_id").transform(docs(spark, sf_dir)).select("doc_id", "text")


# taggers


@query("tag_length", """SELECT doc_id, length(text) AS char_count, len(list_filter(string_split(text, ' '), lambda w : trim(w, ' ' || chr(9) || chr(10) || chr(13)) <> '')) AS word_count,
  CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + 1 END AS line_count,
  len(list_filter(string_split(text, chr(10) || chr(10)), lambda w : trim(w, ' ' || chr(9) || chr(10) || chr(13)) <> '')) AS paragraph_count FROM documents""")
def tag_length(spark, sf_dir):
    return flat(step("tag", "length", count_paragraphs=True).transform(docs(spark, sf_dir)), "metadata.length", "doc_id")


def _gopher_sql(language: str) -> str:
    return f"""
WITH d AS (SELECT doc_id, text, string_split(text, ' ') AS w, CASE WHEN right(text, 1) = chr(10) THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END AS l FROM documents),
r AS (SELECT *, list_filter(w, lambda x : regexp_matches(x, '[^!-/:-@\\[-`{{-~]')) AS s FROM d)
SELECT doc_id, CAST(len(s) AS BIGINT) AS word_count, round(coalesce(list_sum(list_transform(s, lambda x : length(x))), 0) / greatest(len(s), 1), 6) AS avg_word_length,
  round((length(text) - length(replace(text, '#', ''))) / len(w), 6) AS hash_ratio,
  round(((length(text) - length(replace(text, '...', ''))) / 3 + length(text) - length(replace(text, '…', ''))) / len(w), 6) AS ellipsis_ratio,
  round(len(list_filter(l, lambda x : regexp_matches(x, '^\\s*[•-]'))) / len(l), 6) AS bullet_line_ratio,
  round(len(list_filter(l, lambda x : regexp_matches(x, '(\\.\\.\\.|…)\\s*$'))) / len(l), 6) AS ellipsis_line_ratio,
  CAST(len(list_intersect(list_distinct(w), [{quoted(STOP_WORDS[language])}])) AS BIGINT) AS stop_word_count,
  round(len(list_filter(w, lambda x : regexp_matches(x, '\\p{{L}}'))) / len(w), 6) AS alpha_word_ratio FROM r WHERE text <> ''
UNION ALL SELECT doc_id, 0, 0, 0, 0, 0, 0, 0, 0 FROM documents WHERE coalesce(text, '') = ''"""


def _gopher(language: str) -> Query:
    def run(spark, sf_dir):
        return flat(step("tag", "gopher_quality", language=language).transform(docs(spark, sf_dir)), "metadata.gopher_quality", "doc_id")

    return run


for _l in ("en", "de"):
    query(f"tag_gopher_quality_{_l}", _gopher_sql(_l))(_gopher(_l))


def _gopher_filter(semantics: str) -> Query:
    def run(spark, sf_dir):
        steps = [step("tag", "gopher_quality", language="en"), step("filter", "gopher_quality", min_avg_word_length=3, min_stop_words=2, semantics=semantics)]
        return apply_steps(docs(spark, sf_dir), steps).select("doc_id", "lang")

    return run


for _m, _alpha in (("compat", "alpha_word_ratio > 0.99"), ("corrected", "1 - alpha_word_ratio > 0.99")):
    query(f"filter_gopher_quality_{_m}", f"""SELECT doc_id, lang FROM ({_gopher_sql('en')}) JOIN documents USING (doc_id) WHERE NOT (stop_word_count < 2 OR {_alpha} OR ellipsis_line_ratio > 0.3 OR bullet_line_ratio > 0.7
  OR avg_word_length > 7.3 OR avg_word_length < 3 OR ellipsis_ratio > 0.1 OR hash_ratio > 0.1)""")(_gopher_filter(_m))

_TOP_SQL = """
WITH d AS (SELECT doc_id, text, string_split(text, ' ') AS w, regexp_split_to_array(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\n\\n+') AS ps, regexp_split_to_array(text, '\\n+') AS ls FROM documents WHERE text <> ''),
g AS (SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (VALUES (2), (3), (4)) v(n) WHERE len(w) >= n)),
c AS (SELECT doc_id, n, g, count(*) AS c, min(p) AS p FROM g GROUP BY ALL),
t AS (SELECT doc_id, n, arg_max(length(g) * c, (c, -p)) AS chars FROM c GROUP BY ALL),
x AS (SELECT doc_id, max(chars) FILTER (n = 2) AS t2, max(chars) FILTER (n = 3) AS t3, max(chars) FILTER (n = 4) AS t4 FROM t GROUP BY doc_id)
SELECT doc_id, round((len(ps) - len(list_distinct(ps))) / len(ps), 6) AS dup_para_frac, round((list_sum(list_transform(ps, lambda x : length(x))) - coalesce(list_sum(list_transform(list_distinct(ps), lambda x : length(x))), 0)) / length(text), 6) AS dup_para_char_frac,
  round((len(ls) - len(list_distinct(ls))) / len(ls), 6) AS dup_line_frac, round((list_sum(list_transform(ls, lambda x : length(x))) - coalesce(list_sum(list_transform(list_distinct(ls), lambda x : length(x))), 0)) / length(text), 6) AS dup_line_char_frac,
  round(coalesce(t2, 0) / length(text), 6) AS top_2_gram_char_frac, round(coalesce(t3, 0) / length(text), 6) AS top_3_gram_char_frac, round(coalesce(t4, 0) / length(text), 6) AS top_4_gram_char_frac FROM d LEFT JOIN x USING (doc_id)
UNION ALL SELECT doc_id, 0, 0, 0, 0, 0, 0, 0 FROM documents WHERE coalesce(text, '') = ''"""


@query("tag_repetition_top", _TOP_SQL)
def tag_repetition_top(spark, sf_dir):
    return flat(step("tag", "gopher_repetition", dup_n_grams=()).transform(docs(spark, sf_dir)), "metadata.gopher_repetition", "doc_id")


@query("tag_gopher_repetition")
def tag_gopher_repetition(spark, sf_dir):
    return flat(step("tag", "gopher_repetition").transform(docs(spark, sf_dir)), "metadata.gopher_repetition", "doc_id")


def _then(tagger: str, kind: str, **params) -> Query:
    def run(spark, sf_dir):
        return apply_steps(docs(spark, sf_dir), [step("tag", tagger), step("filter", kind, **params)]).select("doc_id", "lang")

    return run


query("filter_gopher_repetition_top", f"""SELECT doc_id, lang FROM ({_TOP_SQL}) JOIN documents USING (doc_id) WHERE NOT (dup_line_frac > 0.25 OR dup_para_frac > 0.3 OR dup_line_char_frac > 0.15 OR dup_para_char_frac > 0.2
  OR top_2_gram_char_frac > 0.07 OR top_3_gram_char_frac > 0.1 OR top_4_gram_char_frac > 0.13)""")(_then("gopher_repetition", "gopher_repetition", semantics="corrected", dup_n_gram_thresholds=()))
query("filter_gopher_repetition_compat")(_then("gopher_repetition", "gopher_repetition"))
query("filter_gopher_repetition_corrected")(_then("gopher_repetition", "gopher_repetition", semantics="corrected"))
query("filter_ocr_quality_compat")(_then("ocr_quality", "ocr_quality"))
query("filter_ocr_quality_corrected")(_then("ocr_quality", "ocr_quality", semantics="corrected", filter_mode="maj"))


@query("tag_ocr_quality")
def tag_ocr_quality(spark, sf_dir):
    return flat(step("tag", "ocr_quality").transform(docs(spark, sf_dir)), "metadata.ocr_quality", "doc_id")


_OCR_SQL_FIELDS = ("word_fragment_ratio", "special_char_density", "numeric_context_errors", "word_length_avg", "word_length_std", "ratio_very_short_words", "ratio_very_long_words")


@query("tag_ocr_words", rf"""
WITH d AS (SELECT doc_id, text, regexp_extract_all(text, '[^\p{{Z}}\t\n\x0b\f\r\x1c-\x1f]+') AS w FROM documents WHERE regexp_matches(text, '[^\p{{Z}}\t\n\x0b\f\r\x1c-\x1f]')),
k AS (SELECT *, list_filter(list_transform(w, lambda x : regexp_replace(x, '[^\p{{L}}\p{{N}}_]', '', 'g')), lambda x : x <> '') AS c FROM d),
n AS (SELECT *, list_transform(c, lambda x : CAST(length(x) AS DOUBLE)) AS z FROM k)
SELECT doc_id, round(least(len(list_filter(c, lambda x : regexp_full_match(x, '\p{{L}}') OR (regexp_full_match(x, '\p{{L}}\p{{L}}') AND NOT list_contains([{quoted(SHORT_WORDS)}], lower(x))))) / len(w), 1), 6) AS word_fragment_ratio,
  round((length(text) - length(regexp_replace(text, '[''\x{{a1}}\x{{a6}}-\x{{ac}}\x{{ae}}-\x{{bf}}\x{{2000}}-\x{{206f}}\x{{20ac}}\x{{2122}}\x{{2700}}-\x{{27bf}}]', '', 'g'))) / length(text), 6) AS special_char_density,
  round(len(list_filter(w, lambda x : (regexp_matches(x, '[a-zA-Z]\d|d[a-zA-Z]') AND NOT regexp_full_match(x, '(?i)\d+(?:st|nd|rd|th)')) OR regexp_matches(x, '\d[a-zA-Z]+\d'))) / len(w), 6) AS numeric_context_errors,
  round(list_avg(z), 6) AS word_length_avg, round(CASE WHEN len(z) <= 1 THEN 0 ELSE list_stddev_pop(z) END, 6) AS word_length_std,
  round(len(list_filter(c, lambda x : length(x) <= 1)) / greatest(len(c), 1), 6) AS ratio_very_short_words, round(len(list_filter(c, lambda x : length(x) >= 15)) / greatest(len(c), 1), 6) AS ratio_very_long_words FROM n
UNION ALL SELECT doc_id, 0, 0, 0, 0, 0, 0, 0 FROM documents WHERE NOT coalesce(regexp_matches(text, '[^\p{{Z}}\t\n\x0b\f\r\x1c-\x1f]'), false)""")
def tag_ocr_words(spark, sf_dir):
    df = step("tag", "ocr_quality").transform(docs(spark, sf_dir))
    return flat(df, "metadata.ocr_quality", "doc_id").select("doc_id", *_OCR_SQL_FIELDS)


# word runs stand for what look-around sees: a run of one letter becomes chr(1), a longer one chr(2)
_OCR_LINES_SQL = rf"""
WITH d AS (SELECT doc_id, text, regexp_extract_all(text, '[^\p{{Z}}\t\n\x0b\f\r\x1c-\x1f]+') AS w, regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+') AS runs, regexp_split_to_array(text, '\r\n|[\n\r\x0b\f\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]') AS parts,
  regexp_replace(regexp_replace(text, '[\p{{L}}\p{{N}}_]{{2,}}', chr(2), 'g'), '[a-zA-Z]', chr(1), 'g') AS marks FROM documents WHERE regexp_matches(text, '[^\p{{Z}}\t\n\x0b\f\r\x1c-\x1f]')),
k AS (SELECT *, len(list_filter(w, lambda x : regexp_full_match(x, '\p{{L}}+'))) AS alpha, list_transform(CASE WHEN parts[-1] = '' THEN parts[:-2] ELSE parts END, lambda x : regexp_replace(x, '^[\p{{Z}}\t\n\x0b\f\r\x1c-\x1f\x{{85}}]+|[\p{{Z}}\t\n\x0b\f\r\x1c-\x1f\x{{85}}]+$', '', 'g')) AS ls FROM d)
SELECT doc_id, round(least((len(regexp_extract_all(text, '[a-z][A-Z]|[a-zA-Z]\p{{Nd}}|\p{{Nd}}[a-zA-Z]')) + len(regexp_extract_all(text, ' {{3,}}')) + (length(marks) - length(replace(marks, chr(1) || ' ' || chr(1) || ' ' || chr(1), ''))) / 5
    + len(list_filter(runs, lambda x : length(x) >= 25))) / len(w), 1), 6) AS spacing_anomaly_ratio,
  round(CASE WHEN alpha = 0 THEN 0 ELSE least((len(list_filter(runs, lambda x : regexp_full_match(x, '[a-z]+[A-Z][a-z]*'))) + len(list_filter(runs, lambda x : regexp_full_match(x, '[a-zA-Z]*[a-z][A-Z][a-zA-Z]*')))) / alpha, 1) END, 6) AS case_anomaly_ratio,
  round(len(list_filter(ls, lambda x : x <> '' AND (length(x) <= 2 OR regexp_matches(x, '^[^\p{{L}}\p{{N}}_\p{{Z}}\s]+$|^\p{{Nd}}+$|(?i:^[IVX]+$)|(?i:^Page[\p{{Z}}\t\n\x0b\f\r\x1c-\x1f]+\p{{Nd}}+)')))) / len(ls), 6) AS line_artifact_ratio FROM k
UNION ALL SELECT doc_id, 0, 0, 0 FROM documents WHERE NOT coalesce(regexp_matches(text, '[^\p{{Z}}\t\n\x0b\f\r\x1c-\x1f]'), false)"""


@query("tag_ocr_lines", _OCR_LINES_SQL)
def tag_ocr_lines(spark, sf_dir):
    df = step("tag", "ocr_quality").transform(docs(spark, sf_dir))
    return flat(df, "metadata.ocr_quality", "doc_id").select("doc_id", "spacing_anomaly_ratio", "case_anomaly_ratio", "line_artifact_ratio")


# without the limit on repeated characters, whose pattern refers back to itself
_BAD = "spacing_anomaly_ratio > 0.15; case_anomaly_ratio > 0.1; word_fragment_ratio > 0.2; line_artifact_ratio > 0.25; special_char_density > 0.03; numeric_context_errors > 0.08; word_length_avg > 9; coalesce(word_length_avg, 0) < 5; word_length_std > 5; {std}; ratio_very_short_words > 0.1; ratio_very_long_words > 0.1"
for _m, _std, _test in (("compat", "word_length_std > 1", "bad > 0"), ("corrected", "word_length_std < 1", "NOT bad * 2 >= 13")):
    _sum = " + ".join(f"coalesce(CAST({x} AS INT), 0)" for x in _BAD.format(std=_std).split("; "))
    _words = ORACLES["tag_ocr_words"]
    query(f"filter_ocr_quality_{_m}_unrepeated", f"SELECT doc_id, lang FROM (SELECT *, {_sum} AS bad FROM ({_words}) JOIN ({_OCR_LINES_SQL}) USING (doc_id)) JOIN documents USING (doc_id) WHERE {_test}")(
        _then("ocr_quality", "ocr_quality", max_repeated_char_ratio=1.0, **({} if _m == "compat" else {"semantics": "corrected", "filter_mode": "maj"})))


@query("tag_ocroscope")
def tag_ocroscope(spark, sf_dir):
    return step("tag", "ocroscope").transform(docs(spark, sf_dir)).select("doc_id", F.round("ocr_quality", 6).alias("ocr_rate"))


_NGRAM_SQL = """
WITH d AS (SELECT doc_id, lang, regexp_split_to_array(text, '[!-/:-@\\[-`{-~\\s\\x0b]+') AS w FROM documents WHERE trim(text, ' ' || chr(10)) <> ''),
g AS (SELECT doc_id, lang, array_to_string(w[p : p + 1], ' ') AS ngram, p FROM (SELECT doc_id, lang, w, unnest(range(1, len(w))) AS p FROM d WHERE len(w) >= 2)),
c AS (SELECT doc_id, lang, ngram, count(*) AS n, min(p) AS p FROM g GROUP BY ALL)
"""


@query("tag_ngrams", _NGRAM_SQL + "SELECT doc_id, string_agg(ngram || '=' || n, '|' ORDER BY n DESC, p) AS top FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, p) AS r FROM c) WHERE r <= 3 GROUP BY doc_id")
def tag_ngrams(spark, sf_dir):
    df = step("tag", "ngrams", ngram_size=2, top_k=3).transform(docs(spark, sf_dir)).filter(F.size("metadata.ngrams") > 0)
    return df.select("doc_id", F.array_join(F.transform("metadata.ngrams", lambda g: F.concat_ws("=", g["ngram"], g["count"])), "|").alias("top"))


@query("agg_counter", _NGRAM_SQL + "SELECT lang, ngram, CAST(s AS BIGINT) AS count FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY s DESC, ngram) AS r FROM (SELECT lang, ngram, sum(n) AS s FROM c GROUP BY lang, ngram)) WHERE r <= 20")
def agg_counter(spark, sf_dir):
    df = step("tag", "ngrams", ngram_size=2).transform(docs(spark, sf_dir))
    return Counter(name="top", on="metadata.ngrams", top_k=20).table(df, ["lang"])


def _language_sql(hits: str) -> str:
    return "WITH h AS (SELECT doc_id, " + hits + """ FROM (SELECT doc_id, lower(substr(trim(replace(text, chr(10), ' '), ' '), 1, 4096)) AS t FROM documents)),
u AS (SELECT doc_id, unnest(['de', 'en', 'es', 'fr']) AS name, unnest([de, en, es, fr]) AS n, de + en + es + fr AS total FROM h)
SELECT doc_id, CASE WHEN max(total) = 0 THEN 'unknown' ELSE arg_max(name, (n, -ascii(name) * 1000 - ascii(name[2]))) END AS name, round(max(n) / greatest(max(total), 1), 6) AS score FROM u GROUP BY doc_id"""


# function words at letter edges: each word is set off by spaces first, since RE2 can't look round
_LANGUAGE_HITS = ", ".join(
    f"len(list_filter(regexp_extract_all(t, '[\\p{{L}}\\p{{N}}_]+'), lambda x : list_contains([{quoted(ws.split())}], x))) AS {lang}" for lang, ws in PROFILES.items()
)


@query("tag_language", _language_sql(_LANGUAGE_HITS))
def tag_language(spark, sf_dir):
    df = step("tag", "language").transform(docs(spark, sf_dir))
    return df.select("doc_id", F.col("metadata.language.names")[0].alias("name"), F.round(F.col("metadata.language.scores")[0], 6).alias("score"))


@query("tag_token_count")
def tag_token_count(spark, sf_dir):
    path = TOKENIZER if os.path.exists(TOKENIZER) else None
    df = step("tag", "token_count", pretrained_tokenizer_name_or_path=path).transform(docs(spark, sf_dir))
    return df.select("doc_id", "metadata.token_count")


# a run of white space that ends in no blank counts twice, which takes a look-ahead in the pattern itself
_PRETOKEN_SQL = r"""SELECT doc_id, len(regexp_extract_all(text, '{Q}(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\x0b\p{L}\p{N}]+|[\s\x0b]+')) + len(regexp_extract_all(text, '[\s\x0b][\t\n\x0b\f\r][^\s\x0b]')) AS token_count FROM documents"""


@query("tag_pretoken_count", _PRETOKEN_SQL.replace("{Q}", "''"))
def tag_pretoken_count(spark, sf_dir):
    return step("tag", "token_count").transform(docs(spark, sf_dir)).select("doc_id", "metadata.token_count")


@query("tag_perplexity")
def tag_perplexity(spark, sf_dir):
    return step("tag", "perplexity").transform(docs(spark, sf_dir)).select("doc_id", "perplexity")


# filters


def _filter(table: str, columns: str, *steps: FilterFn) -> Query:
    def run(spark, sf_dir):
        df = read_table(spark, sf_dir, table)
        for s in steps:
            df = s.transform(df)
        return df.selectExpr(*columns.split(", "))

    return run


_VALUES = {"eq": ("lang", "en", "lang = 'en'"), "neq": ("lang", "en", "lang <> 'en'"), "gt": ("n_chars", 1000, "n_chars > 1000"), "lt": ("n_chars", 1000, "n_chars < 1000 AND n_chars <> 0"),
           "gte": ("n_chars", 1000, "n_chars >= 1000"), "lte": ("n_chars", 1000, "n_chars <= 1000 AND n_chars <> 0"), "inr": ("lang", ["de", "fr"], "lang IN ('de', 'fr')"), "ninr": ("lang", ["de", "fr"], "lang NOT IN ('de', 'fr')"),
           "inl": ("text", "the", "contains(text, 'the')"), "ninl": ("text", "the", "NOT contains(text, 'the') AND text <> ''")}
for _c, (_on, _v, _sql) in _VALUES.items():
    query(f"filter_value_{_c}", f"SELECT doc_id, lang, n_chars FROM documents WHERE {_sql}")(_filter("documents", "doc_id, lang, n_chars", step("filter", "value", on=_on, value=_v, comparator=_c, if_missing=False)))
query("filter_value_compat", "SELECT doc_id, lang FROM documents")(_filter("documents", "doc_id, lang", step("filter", "value", on="lang", value="en")))
query("filter_value_corrected", "SELECT doc_id, toxic FROM labels WHERE toxic IS NULL OR toxic = 0 OR toxic = 2")(_filter("labels", "doc_id, toxic", step("filter", "value", on="toxic", value=2, semantics="corrected")))
query("filter_exists", "SELECT doc_id, quality FROM labels WHERE quality IS NOT NULL")(_filter("labels", "doc_id, quality", step("filter", "exists", on="quality")))
query("filter_expr", "SELECT doc_id, lang FROM documents WHERE n_chars % 7 = 3")(_filter("documents", "doc_id, lang", step("filter", "expr", expr="n_chars % 7 = 3", if_missing=False)))
query("filter_token_count", "SELECT doc_id, n_chars FROM documents WHERE n_chars BETWEEN 200 AND 3000")(_filter("documents", "doc_id, n_chars", step("filter", "token_count", on="n_chars", min_tokens=200, max_tokens=3000)))


@query("filter_language", "SELECT doc_id, lang FROM documents WHERE lang IN ('de', 'fr') AND n_chars % 10 >= 5")
def filter_language(spark, sf_dir):
    tagged = docs(spark, sf_dir).withColumn("metadata", F.struct(F.struct(F.array("lang").alias("names"), F.array((F.col("n_chars") % 10) / 10.0).alias("scores")).alias("language")))
    return step("filter", "language", allowed_languages=["de", "fr"], min_confidence=0.5).transform(tagged).select("doc_id", "lang")


# aggregations

_AGG = ("sum", "count", "quantile", "mean", "min", "max", "std", "absmax")
_AGG_SQL = "round(sum({c}), 2) AS sum, count(*) AS count, round(quantile_cont({c}, 0.5), 4) AS quantile, round(avg({c}), 4) AS mean, min({c}) AS min, max({c}) AS max, round(stddev_samp({c}), 4) AS std, max(abs({c})) AS absmax"
_ROUND = {"sum": 2, "quantile": 4, "mean": 4, "std": 4}


def _aggregations(table: str, on: str, groupby: str | None, ignore: bool) -> Query:
    def run(spark, sf_dir):
        df = aggregate(read_table(spark, sf_dir, table), [step("aggregation", a, name=a, on=on, ignore_nulls=ignore) for a in _AGG], groupby)
        return df.select(*([groupby] if groupby else []), *[F.round(a, _ROUND[a]).alias(a) if a in _ROUND else F.col(a) for a in _AGG])

    return run


query("agg_global", f"SELECT {_AGG_SQL.format(c='l_extendedprice')} FROM lineitem")(_aggregations("lineitem", "l_extendedprice", None, False))
query("agg_grouped", f"SELECT l_returnflag, {_AGG_SQL.format(c='l_quantity')} FROM lineitem GROUP BY 1")(_aggregations("lineitem", "l_quantity", "l_returnflag", False))
query("agg_negative", f"SELECT c_mktsegment, {_AGG_SQL.format(c='c_acctbal')} FROM customer GROUP BY 1")(_aggregations("customer", "c_acctbal", "c_mktsegment", True))


@query("agg_nulls", "SELECT lang, CAST(NULL AS DOUBLE) AS poisoned, CAST(sum(quality) AS BIGINT) AS skipped, count(*) AS rows, count(quality) AS filled FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang HAVING count(*) > count(quality)")
def agg_nulls(spark, sf_dir):
    df = docs(spark, sf_dir).join(read_table(spark, sf_dir, "labels"), "doc_id", "left")
    steps = [step("aggregation", "mean", name="poisoned", on="quality"), step("aggregation", "sum", name="skipped", on="quality", ignore_nulls=True), step("aggregation", "count", name="rows", on="quality"), step("aggregation", "count", name="filled", on="quality", ignore_nulls=True)]
    return aggregate(df, steps, "lang").filter("rows > filled")


@query("agg_unique", "SELECT source, array_to_string(list_sort(list(DISTINCT lang)), ',') AS langs FROM documents GROUP BY source")
def agg_unique(spark, sf_dir):
    return aggregate(docs(spark, sf_dir), [step("aggregation", "unique", name="langs", on="lang")], "source").select("source", F.array_join("langs", ",").alias("langs"))


# pipelines


@query("slice_ingest_length_filter_mean", """SELECT lang, count(*) AS n, round(avg(w), 4) AS words FROM (SELECT lang, len(list_filter(string_split(text, ' '), lambda x : trim(x, ' ' || chr(10)) <> '')) AS w FROM documents) WHERE w >= 50 GROUP BY lang""")
def slice_mean(spark, sf_dir):
    steps = [step("ingest", "base", id_column="doc_id", text_column="text", source_name_or_column="source", other=["lang"]), step("tag", "length"),
             step("filter", "value", on="metadata.length.word_count", value=50, comparator="gte", if_missing=False, semantics="corrected")]
    df = apply_steps(docs(spark, sf_dir), steps)
    out = aggregate(df, [step("aggregation", "count", name="n", on="id"), step("aggregation", "mean", name="words", on="metadata.length.word_count")], "lang")
    return out.select("lang", "n", F.round("words", 4).alias("words"))


def default_steps(language: str = "en") -> list:
    """The nineteen steps of the reference's default configuration, in its order; filters with their evident intent."""
    c = {"semantics": "corrected"}
    return [step(category, kind, **params) for category, kind, params in (
        ("ingest", "base", {"id_column": "doc_id", "text_column": "text", "source_name_or_column": "source", "subset_name_or_column": "lang", "license_name_or_column": "unknown"}),
        ("extract", "tei", {}), ("format", "ftfy", {}), ("format", "spacing", {}), ("tag", "language", {"max_tokens": 65536}), ("tag", "token_count", {}), ("tag", "ocr_quality", {}),
        ("tag", "gopher_quality", {"language": language}), ("tag", "gopher_repetition", {}), ("filter", "language", {"allowed_languages": [language], "min_confidence": 0.5}), ("filter", "token_count", {}),
        ("filter", "ocr_quality", c | {"filter_mode": "lenient"}), ("filter", "gopher_quality", c | {"min_avg_word_length": 3, "min_stop_words": 2}), ("filter", "gopher_repetition", c | {"top_n_gram_thresholds": ((2, 0.2),)}),
        ("format", "pii_regex", {"language": language, "flag": "metadata.pii"}), ("tag", "token_count", {"to": "num_tokens"}), ("filter", "token_count", {"on": "num_tokens"}), ("tag", "perplexity", {}), ("tag", "ocroscope", {}),
    )]


@query("flagship")
def flagship(spark, sf_dir):
    """The default configuration over documents, each wrapped as a TEI text, since its extractor reads TEI."""
    df = apply_steps(docs(spark, sf_dir).withColumn("text", _as_tei(F.col("text"))), default_steps())
    return df.select("id", "source", "text", "num_tokens", F.col("metadata.pii").alias("pii"), "perplexity", "ocr_quality")


_SPACED = r"SELECT * REPLACE (regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n\n\n+', chr(10) || chr(10), 'g'), '([\p{L}\p{N}_])-\s*\n\s*([\p{L}\p{N}_])', '\1\2', 'g'), '  +', ' ', 'g') AS text) FROM main.documents"


@query("flagship_native", f"""WITH documents AS ({_SPACED})
SELECT doc_id, name AS language, score, word_count, stop_word_count, avg_word_length FROM ({_gopher_sql("en")}) JOIN ({_language_sql(_LANGUAGE_HITS)}) USING (doc_id)
WHERE name = 'en' AND score >= 0.5 AND NOT (stop_word_count < 2 OR 1 - alpha_word_ratio > 0.99 OR ellipsis_line_ratio > 0.3 OR bullet_line_ratio > 0.7 OR avg_word_length > 7.3 OR avg_word_length < 3 OR ellipsis_ratio > 0.1 OR hash_ratio > 0.1)""")
def flagship_native(spark, sf_dir):
    """The chain's part that SQL can express: spacing, language and quality tags, and the filters on them."""
    steps = [step("format", "spacing", collapse_paragraph_breaks=False), step("tag", "language"), step("tag", "gopher_quality", language="en"), step("filter", "language", allowed_languages=["en"], min_confidence=0.5),
             step("filter", "gopher_quality", semantics="corrected", min_avg_word_length=3, min_stop_words=2)]
    df = apply_steps(docs(spark, sf_dir), steps)
    g = "metadata.gopher_quality."
    return df.select("doc_id", F.col("metadata.language.names")[0].alias("language"), F.round(F.col("metadata.language.scores")[0], 6).alias("score"), g + "word_count", g + "stop_word_count", F.round(g + "avg_word_length", 6).alias("avg_word_length"))
