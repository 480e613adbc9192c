import random
import re
import time

import numpy as np

from corpusflow.operators.ocr import METRICS, ocr_metrics

ALPHABETS = (["a", "b", "=", "-"], ["a", "B", "c ", " ", "1", "d", "st"], ["é", "ß", "x", "\n", "\r\n", "  ", "Page 3", "IV", "_", "€", "😀", "٣", "\x85", "\x1f"])


def texts(n):
    r = random.Random(8)
    return ["".join(r.choice(r.choice(ALPHABETS)) if k % 2 else r.choice(ALPHABETS[k % 3]) for _ in range(r.randrange(50))) for k in range(n)]


def by_patterns(t):
    """Three metrics by Python's own patterns, which refer back and look round."""
    n = len(t.split())
    edges = r"(?<![^\W]){}(?![^\W])"
    matched = sum(len(m[0]) for p in (r"([^\n])\1{3,}", r"([^\n]{2,5})\1{2,}") for m in re.finditer(p, t))
    spacing = sum(len(re.findall(p, t)) for p in (r"[a-z][A-Z]|[a-zA-Z]\d|\d[a-zA-Z]", " {3,}", edges.format("[a-zA-Z] [a-zA-Z] [a-zA-Z]"), edges.format(r"\w{25,}")))
    case = sum(len(re.findall(edges.format(p), t)) for p in ("[a-z]+[A-Z][a-z]*", "[a-zA-Z]*[a-z][A-Z][a-zA-Z]*"))
    alpha = sum(w.isalpha() for w in t.split())
    return min(spacing / max(n, 1), 1), min(case / alpha, 1) if alpha else 0, min(matched / max(len(t), 1), 1)


def test_ocr_metrics_of_many_texts_match_patterns():
    ts = texts(3000)
    got = ocr_metrics(ts)
    at = [METRICS.index(f"{m}_ratio") for m in ("spacing_anomaly", "case_anomaly", "repeated_char")]
    for t, row in zip(ts, got):
        assert tuple(row[at]) == (by_patterns(t) if t.strip() else (0, 0, 0)), repr(t)
    alone = np.concatenate([ocr_metrics([t], "corrected") for t in ts[:500]])
    assert np.array_equal(alone, ocr_metrics(ts[:500], "corrected"), equal_nan=True)


def test_ocr_metrics_are_fast():
    """4 MB of text; the cost is some passes over an array of its characters."""
    ts = ["Some words of prose, as they come, with a page 12 and the odd o'clock in them.\n" * 500] * 100
    ocr_metrics(ts[:1])
    began = time.thread_time()
    for k in range(0, 100, 5):
        ocr_metrics(ts[k : k + 5])
    assert time.thread_time() - began < 10
