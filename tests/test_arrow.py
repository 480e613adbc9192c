import sys
from functools import partial

import pyarrow as pa
import pytest

from corpusflow.functions import arrow
from corpusflow.plans.registry import components


def test_pieces_are_small_and_whole():
    texts = pa.array(["", "ä" * 50, None, "b" * 300, *["c" * 30] * 20, None])
    got = list(arrow.pieces(texts.slice(1), 100))
    assert [x for p in got for x in p.to_pylist()] == texts.to_pylist()[1:]
    assert all(len(p) == 1 or sum(len((x or "").encode()) for x in p.to_pylist()) <= 100 for p in got) and len(got) < 12
    assert list(arrow.pieces(pa.array([], pa.string()))) == []


def test_a_worker_holds_a_piece_of_a_batch(spark):
    """In one task and one batch, yet no call gets more than a piece; rows stay in their order."""
    df = spark.range(200).selectExpr("id", "if(id % 9 = 0, null, repeat(char(97 + id % 26), 5000)) AS text").coalesce(1)
    most = arrow.PIECE

    def make():
        def of(texts):
            assert len(texts) > 1 and sum(len(t or "") for t in texts) <= most
            return pa.array([t and t[:1] for t in texts], pa.string())

        return of

    got = df.select("id", arrow.text_udf("string", make)("text").alias("c")).collect()
    assert [(r.id, r.c) for r in got] == [(i, None if i % 9 == 0 else chr(97 + i % 26)) for i in range(200)]


def test_bytes_that_are_no_text():
    assert arrow.strings(pa.array([b"a\xff", None]).view(pa.string())) == ["a�", None]


@pytest.mark.parametrize("category, kind, params", [
    ("tag", "ngrams", {"ngram_size": 2}), ("tag", "token_count", {"pretrained_tokenizer_name_or_path": "/opt/tokenizers/byte_bpe_50k.json"}), ("tag", "perplexity", {}),
    ("extract", "tei", {"on_error": "null"}), ("extract", "html", {}), ("format", "ftfy", {}),
])
def test_texts_reach_the_workers_by_pieces(spark, monkeypatch, category, kind, params):
    """The result doesn't depend on how texts are cut into pieces, each of which is of one or a few."""
    texts = ["one two one two", None, "", "<p>x</p>" if kind == "html" else "ein zwei", "wörter “und” mehr " * 9] * 3
    df = spark.createDataFrame([(i, f"<TEI><text><body><p>{t}</p></body></text></TEI>" if kind == "tei" else t) for i, t in enumerate(texts)], "id int, text string").coalesce(1)
    step = components.get(category, kind)(**params)
    out = []
    for size in (1, 1 << 20):
        monkeypatch.setattr(sys.modules[type(step).__module__], "text_udf", partial(arrow.text_udf, size=size))
        out.append(step.transform(df).orderBy("id").collect())
    assert out[0] == out[1] and len(out[0]) == len(texts)
