import random
import re
import time
from collections import Counter

import numpy as np

from corpusflow.operators import gopher

ALPHABETS = (["a", "b", "ab", " ", " ", "a b c"], ["é", "😀", "\n", "\n\n", " ", "word ", "\0", " "], ["one ", "two ", "three ", "on ", "e ", "\n"])


def texts(n, most):
    r = random.Random(9)
    return ["", " ", "   ", "a", *("".join(r.choice(r.choice(ALPHABETS) if k % 2 else ALPHABETS[k % 3]) for _ in range(r.randrange(most))) for k in range(n))]


def top(ws, n):
    c = Counter(" ".join(ws[i : i + n]) for i in range(len(ws) - n + 1)).most_common(1)
    return len(c[0][0]) * c[0][1] if c else 0


def dup(ws, n):
    """A repeated n-gram, its words joined without spaces, counts and is jumped over."""
    seen, i, total = set(), 0, 0
    while i + n <= len(ws):
        g = "".join(ws[i : i + n])
        total += len(g) * (g in seen)
        i += n if g in seen else 1
        seen.add(g)
    return total


def check(ts, x):
    most = gopher.tops(x, (1, 2, 3, 4, 7))
    for n in most:
        assert most[n].tolist() == [top(t.split(" "), n) for t in ts], n
    for n in (1, 2, 5, 6, 10):
        assert gopher.repeated(x, n).tolist() == [dup(t.split(" "), n) for t in ts], n


def test_ngrams_of_many_texts_match_scans():
    ts = texts(1500, 90) + texts(40, 1500)
    check(ts, gopher._Texts(ts))


def test_equal_hashes_of_other_ngrams_do_no_harm():
    """Where all hashes are equal, each n-gram is compared as a string."""
    ts = texts(200, 60)
    x = gopher._Texts(ts)
    x.inverse = np.zeros_like(x.inverse)
    check(ts, x)


def test_lines_and_paragraphs():
    for t in texts(300, 90):
        for parts in (re.split(r"\n{2,}", t.strip()), re.split("\n+", t)):
            n = len(parts) - len(set(parts))
            assert gopher.twice(parts, max(len(t), 1)) == (n / len(parts), (sum(map(len, parts)) - sum(map(len, set(parts)))) / max(len(t), 1))


def test_repetition_is_fast():
    """Less than half the time that a scan of every n-gram takes."""
    r = random.Random(1)
    words = ["".join(r.choices("abcdefghijklmnop", k=r.randrange(2, 10))) for _ in range(3000)]
    ts = [" ".join(r.choices(words, k=4000)) for _ in range(10)]

    def seconds(run):
        took = []
        for _ in range(3):
            began = time.thread_time()
            run()
            took.append(time.thread_time() - began)
        return min(took)

    def scans():
        for t in ts:
            ws = t.split(" ")
            for n in (2, 3, 4):
                top(ws, n)
            for n in range(5, 11):
                dup(ws, n)

    def arrays():
        x = gopher._Texts(ts)
        gopher.tops(x, (2, 3, 4))
        for n in range(5, 11):
            gopher.repeated(x, n)

    assert seconds(arrays) < seconds(scans) / 2
