"""Operators against plain Python written from their definitions, with edge cases."""

import random
import re
import statistics
import string
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusflow.functions.fields import get_field
from corpusflow.operators import dedup, formats, gopher, lengths, markup, models, pii
from corpusflow.operators.aggregations import aggregate
from corpusflow.plans.registry import components

TEXTS = [
    None, "", " ", "word", "###", "The cat and the dog, to be with you.\nThat is of that.\n", "a  b   c\t\td\n\n\n\ne", "- item one\n• item two\n...\nend…  \n", "wort-\n  trennung über-\nß und mehr", "Ünï çödé ✓ 😀 é",
    "x\r\ny\x0bz w\x85", "lorem ipsum dolor " * 30, "HELLo wOrld l8tter t0 12th 3rd a1b2 e f g pneumonoultramicroscopicsilico Page 12\nIV\n42\n..\n«aaaa» abababab", "same line\nsame line\n\nsame para\n\nsame para", "don't ‘quote’ der du",
]


def step(category, kind, **params):
    return components.get(category, kind)(**params)


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string").repartition(3)


def values(df, path):
    return [r[0] for r in df.orderBy("id").select(get_field(df, path)).collect()]


def test_length(df):
    for got, t in zip(values(step("tag", "length", count_paragraphs=True).transform(df), "metadata.length"), TEXTS):
        t = t or ""
        assert tuple(got) == (len(t), sum(bool(w.strip()) for w in t.split(" ")) if t else 0, t.count("\n") + 1 if t else 0, sum(bool(p.strip()) for p in t.split("\n\n")))
    only = step("tag", "length", count_words=False, count_lines=False).transform(df)
    assert values(only, "metadata.length.word_count") == [None] * len(TEXTS)


def test_gopher_quality(df):
    for got, t in zip(values(step("tag", "gopher_quality", language="en").transform(df), "metadata.gopher_quality"), TEXTS):
        if not t:
            assert set(got) == {0}
            continue
        ws, ls = t.split(" "), t.splitlines()
        real = [w for w in ws if set(w) - set(string.punctuation)]
        want = (
            len(real), statistics.fmean(map(len, real)) if real else 0, t.count("#") / len(ws), (t.count("...") + t.count("…")) / len(ws), sum(x.lstrip()[:1] in ("•", "-") and x.lstrip() != "" for x in ls) / len(ls),
            sum(x.rstrip().endswith(("...", "…")) for x in ls) / len(ls), len(gopher.STOP_WORDS["en"] & set(ws)), sum(any(map(str.isalpha, w)) for w in ws) / len(ws),
        )
        assert tuple(got) == pytest.approx(want)
    assert len(gopher.STOP_WORDS["de"]) == 105 and len(gopher.STOP_WORDS["en"]) == 8


def test_gopher_repetition(df):
    def dup(xs):
        n = len(xs) - len(set(xs))
        return n / len(xs), sum(map(len, xs)) - sum(map(len, set(xs)))

    for got, t in zip(values(step("tag", "gopher_repetition").transform(df), "metadata.gopher_repetition"), TEXTS):
        if not t:
            assert set(got) == {0.0}
            continue
        a, b = dup(re.split(r"\n{2,}", t.strip())), dup(re.split("\n+", t))
        want = [a[0], a[1] / len(t), b[0], b[1] / len(t)]
        ws = t.split(" ")
        for n in (2, 3, 4):
            c = Counter(" ".join(ws[i : i + n]) for i in range(len(ws) - n + 1)).most_common(1)
            want.append(len(c[0][0]) * c[0][1] / len(t) if c else 0)
        for n in range(5, 11):
            seen, i, total = set(), 0, 0
            while i < len(ws) - n + 1:
                g = "".join(ws[i : i + n])
                total, i = (total + len(g), i + n) if g in seen else (total, i + 1)
                seen.add(g)
            want.append(total / len(t))
        assert tuple(got) == pytest.approx(want)


def test_ocr(df):
    short = set("ab ad am an as at au be by da do du eh ei er es ex go he if im in is it ja je la me my no ob of oh on or so to um up us we wo zu".split())
    odd = set("«»'‚„‹›¡¿¦§¨©ª¬®¯°±²³´µ¶·¸¹º»¼½¾•…‰€™")
    for got, t in zip(values(step("tag", "ocr_quality").transform(df), "metadata.ocr_quality"), TEXTS):
        if not t or not t.strip():
            assert set(got) == {0.0}
            continue
        ws = t.split()
        clean = [c for c in (re.sub(r"\W", "", w) for w in ws) if c]
        count = lambda *ps: sum(len(re.findall(p, t)) for p in ps)
        alpha = sum(w.isalpha() for w in ws)
        lines = [x.strip() for x in t.splitlines()]
        art = sum(bool(x) and (len(x) <= 2 or bool(re.match(r"^[^\w\s]+$|^\d+$|^[IVX]+\s*$|^Page\s+\d+", x, re.I))) for x in lines)
        rep = sum(len(m.group()) for p in (r"(.)\1{3,}", r"(.{2,5})\1{2,}") for m in re.finditer(p, t))
        num = sum(bool((re.search(r"[a-zA-Z]\d|d[a-zA-Z]", w) and not re.match(r"^\d+(st|nd|rd|th)$", w, re.I)) or re.search(r"\d[a-zA-Z]+\d", w)) for w in ws)
        want = (
            min(1, count(r"[a-z][A-Z]|[a-zA-Z]\d|\d[a-zA-Z]", " {3,}", r"\b[a-zA-Z] [a-zA-Z] [a-zA-Z]\b", r"\b\w{25,}\b") / len(ws)), min(1, count(r"\b[a-z]+[A-Z][a-z]*\b", r"\b[a-zA-Z]*[a-z][A-Z][a-zA-Z]*\b") / alpha) if alpha else 0,
            sum(c.isalpha() and (len(c) == 1 or len(c) == 2 and c.lower() not in short) for c in clean) / len(ws), art / len(lines), sum(c in odd or 0x2000 <= ord(c) <= 0x206F or 0x2700 <= ord(c) <= 0x27BF for c in t) / len(t),
            min(1, rep / len(t)), min(1, num / len(ws)), statistics.fmean(map(len, clean)) if clean else float("nan"), statistics.pstdev(map(len, clean)) if len(clean) > 1 else 0,
            sum(len(c) <= 1 for c in clean) / max(1, len(clean)), sum(len(c) >= 15 for c in clean) / max(1, len(clean)),
        )
        assert tuple(got) == pytest.approx(want, nan_ok=True), t


def test_ocr_filter_semantics(df):
    tagged = step("tag", "ocr_quality").transform(df)
    bad = {r[0] for r in step("filter", "ocr_quality").transform(tagged).select("id").collect()}
    good = {r[0] for r in step("filter", "ocr_quality", semantics="corrected", filter_mode="maj").transform(tagged).select("id").collect()}
    assert bad and good and bad != good
    assert step("filter", "ocr_quality", filter_mode="maj", if_missing=False).transform(tagged).count() == 0
    assert step("filter", "ocr_quality", semantics="corrected", filter_mode="all").transform(tagged).count() == len(TEXTS)


def test_filter_semantics_differ(spark):
    rep = spark.createDataFrame([((0.5, 0.1),), ((0.01, 0.9),)], "metadata struct<gopher_repetition:struct<top_2_gram_char_frac:double,dup_5_gram_char_frac:double>>".replace("metadata struct<gopher_repetition:struct<", "r struct<").replace(">>", ">"))
    args = {"on": "r", "top_n_gram_thresholds": ((2, 0.07),), "dup_n_gram_thresholds": ((5, 0.39),)}
    assert step("filter", "gopher_repetition", **args).transform(rep).count() == 1
    assert step("filter", "gopher_repetition", semantics="corrected", **args).transform(rep).count() == 0
    q = spark.createDataFrame([((1.0, 5.0, 9),), ((0.5, 5.0, 9),), ((0.0, 5.0, 9),), (None,)], "q struct<alpha_word_ratio:double,avg_word_length:double,stop_word_count:long>")
    keep = lambda **p: [r[0] is None or r[0][0] for r in step("filter", "gopher_quality", on="q", **p).transform(q).collect()]
    assert keep() == [0.5, 0.0, True] and keep(semantics="corrected") == [1.0, 0.5, True]
    v = spark.createDataFrame([("a",), ("b",), ("",), (None,)], "v string")
    rows = lambda **p: [r[0] for r in step("filter", "value", on="v", value="a", **p).transform(v).collect()]
    assert rows() == ["a", "b", "", None] and rows(semantics="corrected") == ["a", "", None] and rows(if_missing=False) == ["a"]


def test_value_filter_containers(spark):
    df = spark.createDataFrame([([1, 2], {"k": 1}, "hello"), ([3], {"z": 1}, "bye"), ([], {}, "")], "a array<int>, m map<string,int>, s string")
    n = lambda on, v, c: step("filter", "value", on=on, value=v, comparator=c, if_missing=False).transform(df).count()
    assert (n("a", 1, "inl"), n("a", 1, "ninl"), n("m", "k", "inl"), n("s", "ell", "inl"), n("s", ["bye"], "inr"), n("s", "goodbye", "inr"), n("s", ["bye"], "ninr")) == (1, 1, 1, 1, 1, 1, 1)


def test_language_filter(spark):
    df = spark.createDataFrame([(["en", "de"], [0.9, 0.8]), (["en", "fr"], [0.9, 0.8]), (["e"], [0.9]), (["en"], [0.1]), ([], []), (None, None), (["de", "en"], [0.9])], "names array<string>, scores array<double>").select(F.struct(F.struct("names", "scores").alias("language")).alias("metadata"))
    n = lambda **p: step("filter", "language", **p).transform(df).count()
    assert n(allowed_languages=["en"]) == 2 and n(allowed_languages="en") == 3 and n(allowed_languages=["en", "de"], allow_partial_match=False) == 2 and n(allowed_languages=["xx"], if_missing=True) == 2


def test_spacing(df):
    for got, t in zip(values(step("format", "spacing").transform(df), "text"), TEXTS):
        if t:
            t = re.sub(r"\n\n\n+", "\n\n", re.sub(r"[ \t]+", " ", t))
            t = re.sub(r"(\w)-\s*\n\s*(\w)", r"\1\2", t)
            t = re.sub("  +", " ", re.sub(r"(?<!\n)\n(?!\n)", " ", t))
        assert got == t
    off = {k: False for k in ("fix_hyphenation", "normalize_whitespace", "normalize_line_breaks", "collapse_paragraph_breaks")}
    assert values(step("format", "spacing", **off).transform(df), "text")[8] == re.sub("  +", " ", TEXTS[8])


def test_pii(spark):
    rows = ["card 4111 1111 1111 1111.", "iban DE89 3704 0044 0532 0130 00 end", "a bob@x.org.\nnext", "call 123-456-7890 now", "ip 10.0.0.1", "see https://a.example/x?y=1 there", None, "", "plain"]
    df = spark.createDataFrame(list(enumerate(rows)), "id int, text string")
    out = step("format", "pii_regex", language="en", flag="m.pii").transform(df)
    got = values(out, "text")
    assert got[0] == "card 4242 4242 4242 4242." and got[1] != rows[1] and got[2] == "aname@example.comnext" and got[3] == "call+1 123 456 7890 now" and got[4] == "ip 192.0.2.255" and got[5:] == rows[5:]
    assert values(out, "m.pii") == [True] * 5 + [False] * 4
    fixed = step("format", "pii_regex", language="en", semantics="corrected", entity_types=["URL"]).transform(df)
    assert values(fixed, "text")[5] == "see https://www.example.com there"
    assert values(step("format", "pii_regex", entity_types=["IP_ADDRESS"], anonymization_method="redact").transform(df), "text")[4] == "ip "
    iban = step("format", "pii_regex", entity_types=["IBAN_CODE"]).transform(df)
    assert values(iban, "text")[1] == "iban DE02 1203 0000 0000 2020 51 end"
    scored = values(step("format", "pii_presidio", language="en", entity_methods={"IP_ADDRESS": "redact"}).transform(df), "text")
    assert scored[0].startswith("card 4242") and "GB29" in scored[1] and "name@example.com" in scored[2] and scored[4] == "ip " and scored[6] is None and scored[8] == "plain"
    assert pii.luhn("4111 1111 1111 1111") and not pii.luhn("4111 1111 1111 1112") and pii.iban_valid("DE89370400440532013000")
    assert sum(len(c.split()) for c in pii.IBAN.values()) == 86


def test_unicode_repair(spark):
    pairs = [("Ã¼ber â€œx", "über \"x"), ("ﬁne ｗｉｄｅ", "fine wide"), ("a &lt; b", "a < b"), ("<b>&lt;</b>", "<b>&lt;</b>"), ("é", "é"), ("a\r\nb\rc", "a\nb\nc"), ("x\x1b[1mb\x00", "xb"), (None, None), ("", "")]
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(pairs)], "id int, text string")
    assert values(step("format", "ftfy").transform(df), "text") == [b for _, b in pairs]
    off = {f: False for f, k in formats.UnicodeRepair.model_fields.items() if k.annotation is bool}
    assert values(step("format", "ftfy", normalization=None, **off).transform(df), "text") == [a for a, _ in pairs]


def sequential(paragraphs, m, bands):
    """What a scan in order keeps: a paragraph goes if it shares a bucket with one kept before."""
    seen, kept = set(), []
    for k, p in enumerate(paragraphs):
        b = set(m.buckets(p, bands))
        if not b & seen:
            kept.append(k)
            seen |= b
    return kept


def test_dedup_matches_the_scan(spark):
    import random

    r = random.Random(3)
    base = [[f"w{r.randrange(400)}" for _ in range(60)] for _ in range(6)]
    texts = []
    for i in range(40):
        ps = []
        for _ in range(3):
            w = list(r.choice(base))
            for _ in range(r.randrange(0, 4)):
                w[r.randrange(60)] = f"x{r.randrange(50)}"
            ps.append(" ".join(w))
        texts.append("\n".join([*ps, ""]))
    df = spark.createDataFrame([*enumerate(texts), (40, None), (41, "")], "id int, text string").repartition(4)
    got = values(step("format", "deduplication", order_by="id").transform(df), "text")
    m, bands = dedup.MinHash(256, 8), dedup.optimal_bands(256, 0.8)[0]
    flat = [(i, p) for i, t in enumerate(texts) for p in t.split("\n")]
    kept = sequential([p for _, p in flat], m, bands)
    want = [[] for _ in texts]
    for k in kept:
        want[flat[k][0]].append(flat[k][1])
    assert got == ["\n".join(w) for w in want] + [None, ""]
    assert 3 < len(kept) < len(flat)
    again = step("format", "deduplication", order_by="id").transform(step("format", "deduplication", order_by="id").transform(df))
    assert values(again, "text") == got


def test_dedup_whole_documents(spark):
    long = " ".join(f"w{i}" for i in range(400))
    rows = ["a b c", "a b c", long, long.replace("w7 ", "zz "), "", None, "other"]
    df = spark.createDataFrame(list(enumerate(rows)), "id int, text string")
    assert values(step("format", "deduplication", split_char=None, order_by="id").transform(df), "text") == ["a b c", "", long, "", "", None, "other"]
    assert [dedup.optimal_bands(p, t) for p, t in ((256, 0.8), (64, 0.8), (64, 0.9), (64, 0.95), (128, 0.8))] == [(16, 16), (8, 8), (4, 16), (2, 32), (8, 16)]


def test_ngrams_and_counter(spark, df):
    for got, t in zip(values(step("tag", "ngrams", ngram_size=2, top_k=3).transform(df), "metadata.ngrams"), TEXTS):
        ws = re.split(f"[{re.escape(string.punctuation + string.whitespace)}]+", t) if t and t.strip() else []
        assert [tuple(x) for x in got] == Counter(" ".join(ws[i : i + 2]) for i in range(len(ws) - 1)).most_common(3)
    assert lengths.ngram_counts(None, 2, None) == []


def test_token_counts_of_batches_with_and_without_nulls(spark):
    path = "/opt/tokenizers/byte_bpe_50k.json"
    tok = pytest.importorskip("tokenizers").Tokenizer.from_file(path)
    for rows in ([(1, "some words"), (2, "")], [(1, "some words"), (2, None)], [(1, None), (2, None)]):
        df = step("tag", "token_count", pretrained_tokenizer_name_or_path=path).transform(spark.createDataFrame(rows, "id int, text string").coalesce(1))
        assert values(df, "metadata.token_count") == [None if t is None else len(tok.encode(t, add_special_tokens=False).ids) for _, t in rows]


def test_token_counts(df):
    import os

    assert values(step("tag", "token_count").transform(df), "metadata.token_count")[3:6] == [1, 1, 18]
    path = "/opt/tokenizers/byte_bpe_50k.json"
    if os.path.exists(path):
        got = values(step("tag", "token_count", pretrained_tokenizer_name_or_path=path).transform(df), "metadata.token_count")
        assert got[0] is None and got[1] == 0 and got[3] == 1
    with pytest.raises(ValueError):
        step("tag", "token_count", pretrained_tokenizer_name_or_path="/no/such/file").transform(df)
    kept = step("filter", "token_count", min_tokens=5, max_tokens=50).transform(step("tag", "token_count").transform(df))
    assert {r[0] for r in kept.select("id").collect()} >= {5}


def test_language(spark):
    df = spark.createDataFrame([(0, "the cat is on the mat and it was good"), (1, "der Hund und die Katze sind nicht da"), (2, "le chat est dans la maison avec les enfants"), (3, "el perro está en la casa con los niños"), (4, ""), (5, None), (6, "xyzzy")], "id int, text string")
    out = step("tag", "language", k=2).transform(df)
    assert [x[0] for x in values(out, "metadata.language.names")] == ["en", "de", "fr", "es", "unknown", "unknown", "unknown"]
    assert all(s == sorted(s, reverse=True) for s in values(out, "metadata.language.scores"))
    assert values(step("tag", "language", confidence_threshold=1.0).transform(df), "metadata.language.names")[6] == ["unknown"]


def test_language_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("n_chars > 200")
    out = step("tag", "language").transform(d).select("lang", F.col("metadata.language.names")[0].alias("n")).collect()
    assert sum(r["lang"] == r["n"] for r in out) >= 0.9 * len(out)


def test_perplexity(spark):
    df = spark.createDataFrame([(i, "the cat sat on the mat. " * 5) for i in range(20)] + [(20, "zq#xv!kj@w"), (21, ""), (22, None)], "id int, text string")
    got = values(step("tag", "perplexity").transform(df), "perplexity")
    assert got[0] == got[1] < got[20] and got[21:] == [-1.0, -1.0]
    norm = df.limit(1).select(models.normalise(F.lit("  Äb １２ 3“x” … \x07")).alias("t")).first()[0]
    assert norm == 'Äb 00 0"x" ... '


def test_perplexity_trains_on_whole_texts(spark):
    df = spark.createDataFrame([(0, "the cat sat " + "on a zebra " * 30), (1, "the zebra")], "id int, text string")
    whole = models.ByteBigrams.train(df)
    got = values(step("tag", "perplexity", max_chars=11).transform(df), "perplexity")
    assert got == [whole.perplexity("the cat sat"), whole.perplexity("the zebra")]


def test_value_ingest_and_plain(spark):
    df = spark.createDataFrame([(1, "t", "s", ""), (None, None, None, "lic")], "key int, body string, src string, lic string")
    out = step("ingest", "base", id_column="key", text_column="body", source_name_or_column="src", subset_name_or_column="part", license_name_or_column="lic", other=["key"]).transform(df).collect()
    assert out[0].asDict(True) == {"id": "1", "text": "t", "source": "s", "key": 1, "metadata": {"subset": "part", "license": "lic"}}
    assert len(out[1]["id"]) == 64 and out[1]["text"] == "" and out[1]["source"] == "src"
    plain = step("ingest", "base", id_column="key", text_column="body", source_name_or_column="x").transform(df)
    assert plain.columns == ["id", "text", "source"]
    assert step("extract", "plain", on="body", to="m.copy").transform(df).first()["m"]["copy"] == "t"
    tag = step("tag", "value", to="src", value="new", replace_if_present=False).transform(df).collect()
    assert [r["src"] for r in tag] == ["s", "new"]
    with pytest.raises(ValueError):
        step("tag", "value", to="x", on="a", value=1)


def test_markup():
    page = "<html><head><title>x</title></head><body><nav><a href=/>Home</a></nav><div class='sidebar'>no</div><article><h1>Head</h1><p>Some &amp; text</p><p>Some &amp; text</p><p><a href=x>only a link here</a></p></article><script>var a;</script></body></html>"
    assert markup.html_main_text(page) == "Head\nSome & text" and markup.html_main_text(None) is None and markup.html_main_text("<nav>x</nav>") is None
    assert markup.html_main_text(page, False, False).count("Some") == 2
    ns = '<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body>%s</body></text></TEI>'
    plain = "<TEI><text><body>%s</body></text></TEI>"
    clean, md = markup.TEIText(), markup.TEIText("markdown")
    right = markup.TEIText(semantics="corrected")
    assert clean(plain % "<head> A </head><p>x<lb/>y<note>n</note> z</p>") == "\n\nA\n\n\n\nxy z\n\n"
    assert md(plain % "<head>A</head><hi>b</hi><emph>c</emph><q>d</q>e<lb/>f<note>n</note><gap/><unclear>u</unclear><supplied>s</supplied>") == '\n\n## A\n\n**b***c*"d"e\nf [n] [gap][u?][s]'
    items = "<list><item>a</item><item>b</item></list>"
    assert clean(plain % items) == "a. b. " and clean(ns % items) == "" and right(ns % items) == "a. b. " and md(plain % items) == "- a\n- b\n"
    assert clean(plain % "<choice><sic>teh</sic><corr>the</corr></choice>") == "" and right(ns % "<choice><sic>teh</sic><corr>the</corr></choice>") == "the"
    assert clean(plain % "<table><row><cell>1</cell><cell>2</cell></row></table><lg><l>a</l><l>b</l></lg>") == "1 2. a b "
    assert clean("<r>no text <b>here</b></r>") == "no text here" and clean(plain % "<title>T</title>") == "T\n\n"
    with pytest.raises(ValueError):
        clean("<!DOCTYPE x><x/>")


def test_tei_errors(spark):
    df = spark.createDataFrame([(0, "<a>x</a>"), (1, "<a>x")], "id int, text string")
    assert values(step("extract", "tei", on_error="null").transform(df), "text") == ["x", None]
    with pytest.raises(Exception, match="ParseError"):
        step("extract", "tei").transform(df).collect()


def test_aggregations(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", -5.0), ("b", 2.0), ("c", 4.0)], "k string, v double")
    kinds = ("sum", "count", "quantile", "mean", "min", "max", "std", "absmax", "unique")
    run = lambda **p: {r["k"]: r for r in aggregate(df, [step("aggregation", a, name=a, on="v", **p) for a in kinds], "k").collect()}
    a, b = run(), run(ignore_nulls=True)
    assert a["a"]["sum"] is None and a["a"]["count"] == 2 and a["a"]["unique"] == [None, 1.0] and b["a"]["sum"] == 1.0 and b["a"]["count"] == 1 and b["a"]["unique"] == [1.0]
    assert (a["b"]["absmax"], a["b"]["quantile"], a["b"]["mean"], a["b"]["min"], a["b"]["max"]) == (5.0, -1.5, -1.5, -5.0, 2.0)
    assert a["c"]["std"] is None and a["b"]["std"] == pytest.approx(7 / 2**0.5)
    with pytest.raises(ValueError):
        aggregate(df, [], "nowhere")


def test_steps_on_an_empty_table(spark):
    df = spark.createDataFrame([], "id int, text string")
    for kind in components.components("tag"):
        if kind != "value":
            assert step("tag", kind).transform(df).count() == 0
    for kind in components.components("format"):
        assert step("format", kind).transform(df).count() == 0
    for kind in ("html", "plain", "tei"):
        assert step("extract", kind).transform(df).count() == 0


def test_keep_first_by_rounds_and_by_one_scan(spark):
    """The same nodes, whether rounds go on to the end or one task scans what shares a bucket; against a plain scan."""
    r = random.Random(4)
    pairs = [(n, r.randrange(60) if n % 3 else 1000 + n) for n in range(200) for _ in range(3)]
    taken, want = set(), []
    for n in range(200):
        own = {b for k, b in pairs if k == n}
        if not own & taken:
            taken |= own
            want.append(n)
    df = spark.createDataFrame(pairs, "node long, bucket long")
    for few in (0, 1_000_000):
        assert sorted(x.node for x in dedup.keep_first(df, few).collect()) == want


def test_minhash_of_many_texts():
    """Signatures without a division are those of the formula, in blocks of shingles too."""
    m = dedup.MinHash(64, 3)
    texts = ["", "a", "one two three four", " ".join(map(str, range(500)))]
    for got, t in zip(m.signatures(texts), texts):
        h = m.hashes(t)
        assert got.tolist() == min_of([[(int(x) * int(a) + int(b)) % 4294967311 % 0xFFFFFFFF for a, b in zip(m.a, m.b)] for x in h])
    edge = dedup.np.array([0, 1, 0xFFFFFFFE, 0xFFFFFFFF], dedup.np.uint64)
    assert m.permuted(edge).tolist() == [[(int(x) * int(a) + int(b)) % 4294967311 % 0xFFFFFFFF for a, b in zip(m.a, m.b)] for x in edge]
    assert [m.buckets(t, 8) for t in texts] == m.keys(texts, 8).tolist()


def min_of(rows):
    return [min(column) for column in zip(*rows)]
