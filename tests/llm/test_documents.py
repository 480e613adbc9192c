"""Operators over documents, against brute force and on hard rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow.llm import ann, decontaminate, jaccard_join, licenses, line_dedup, mph, packing, quality, secrets, substring_dedup
from corpusflow.llm.common import hash_words, lower_ascii, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WS = "\x20\t\n\x0b\x0c\r"


def corpus(n=60, seed=3):
    """Random texts with copies, near copies, shared lines, nulls, empty and long texts, ties and repeated rows."""
    r = random.Random(seed)
    vocab = [f"{a}{b}" for a in ("al", "be", "ga", "dé", "ep", "ze") for b in ("fa", "ta", "ma", "lta", "ü", "no")]
    line = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    shared = [line(12) for _ in range(3)]
    rows = []
    for i in range(n):
        kind = i % 6
        if kind == 0 or not rows:
            t = "\n".join(line(r.randint(3, 30)) for _ in range(r.randint(1, 6)))
        elif kind == 1:
            t = r.choice(rows)[1]
        elif kind == 2:
            ws = (r.choice(rows)[1] or "x").split(" ")
            for _ in range(max(1, len(ws) // 25)):
                ws[r.randrange(len(ws))] = r.choice(vocab)
            t = " ".join(ws)
        elif kind == 3:
            t = line(20) + "\n  " + r.choice(shared).upper() + "\t\n" + line(9)
        elif kind == 4:
            t = (line(1) + " ") * r.randint(1, 40)
        else:
            t = line(40) + " " + r.choice(shared) + " " + line(30)
        rows.append((i, t, "en", f"s{i % 3}", len(t)))
    rows += [(n, None, None, None, None), (n + 1, "", "en", "s0", 0), (n + 2, " \t\n", "en", "s0", 3), (None, rows[0][1], "en", "s1", 1), (None, None, None, None, None)]
    rows += [(n + 3, " ".join(line(2000) for _ in range(3)), "en", "s2", 0), rows[5], (5, rows[4][1] + ' ' + rows[0][1], 'en', 's0', 1), (n + 4, "one two", "en", "s0", 7), (n + 5, "One TWO", "en", "s0", 7)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    # columns with names that the operators use inside must not matter
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("shard", "gone", "tkey", "row", "salt", "y", "c0", "n", "d1", "h1", "keeper", "score", "start", "bucket"):
        df = df.withColumn(c, F.lit("clash"))
    return df.repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def bag(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def brute_lines(rows):
    """(doc_id, lines, dropped lines, kept text) of each row."""
    key = lambda x: x.strip(WS).encode().lower().decode()
    held = {}
    for k, (i, t, *_) in enumerate(rows):
        if i is not None:
            for x in (t or "").split("\n"):
                if len(key(x)) >= 40:
                    held.setdefault(key(x), set()).add((i, k))
    want = []
    for i, t, *_ in rows:
        ls = (t or "").split("\n")
        drop = [i is not None and len(held.get(key(x), ())) >= 5 and max(held[key(x)])[0] != i for x in ls]
        want.append((i, len(ls), sum(drop), "\n".join(x for x, d in zip(ls, drop) if not d)))
    return want


def test_line_dedup(docs, rows, empty):
    want = [(*w[:3], sha(w[3])) for w in brute_lines(rows)]
    assert sum(w[2] for w in want) > 5
    assert bag(line_dedup.dedup_lines(docs, digest=True)) == sorted(want, key=repr)
    assert bag(line_dedup.dedup_lines(docs, digest=True, block_words=30)) == sorted(want, key=repr)
    kept = line_dedup.dedup_lines(docs, keep=("lang", "shard"))
    assert kept.columns == ["doc_id", "lang", "shard", "n_lines", "n_dropped", "kept"]
    assert kept.count() == len(rows)
    assert line_dedup.dedup_lines(empty, digest=True).count() == 0


def test_minimal_perfect_hash():
    r = np.random.default_rng(1)
    h = r.integers(0, 1 << 63, (5000, 2)).astype(np.uint64)
    f = mph.load(mph.dump(mph.build(h[:, 0], h[:, 1])))
    assert sorted(mph.lookup(f, h[:, 0], h[:, 1]).tolist()) == list(range(5000))
    assert len(mph.lookup(mph.build(h[:0, 0], h[:0, 1]), h[:3, 0], h[:3, 1])) == 3


def test_line_index():
    r = np.random.default_rng(4)
    h = r.integers(0, 1 << 63, (3000, 2)).astype(np.uint64)
    pick = r.integers(0, 2500, 8000)
    f = line_dedup.LineIndex(h[pick, 0], h[pick, 1])
    f.add(f.find(h[pick, 0], h[pick, 1]), np.ones(8000, np.int64), pick)
    at = f.find(h[:2500, 0], h[:2500, 1])
    assert [int(f.count[a]) if a >= 0 else 0 for a in at] == np.bincount(pick, minlength=2500).tolist()
    assert all(f.keeper[a] == k for k, a in enumerate(at) if a >= 0) and len(f.count) == len(set(pick.tolist()))
    assert (f.find(h[2500:, 0], h[2500:, 1]) < 0).mean() > 0.99  # 32-bit fingerprints


def brute_substrings(rows, width=13):
    least = {}
    for i, t, *_ in rows:
        w = (t or "").encode().split()
        if i is not None:
            for p in range(len(w) - width + 1):
                k = tuple(w[p : p + width])
                least[k] = min(least.get(k, i), i)
    out = []
    for i, t, *_ in rows:
        w = (t or "").encode().split()
        gone = set()
        for p in range(len(w) - width + 1):
            if i is not None and least[tuple(w[p : p + width])] < i:
                gone.update(range(p, p + width))
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest()))
    return sorted(out, key=repr)


def test_substring_dedup(docs, rows, empty, monkeypatch):
    want = brute_substrings(rows)
    assert sum(w[2] for w in want) > 500
    assert bag(substring_dedup.dedup_substrings(docs, digest=True)) == want
    assert substring_dedup.dedup_substrings(empty, digest=True).count() == 0
    got = substring_dedup.dedup_substrings(docs).filter("doc_id = 1").first()["kept"]
    assert sha(got) == next(w[3] for w in want if w[0] == 1)
    assert bag(substring_dedup.dedup_substrings(docs, width=4, digest=True)) == brute_substrings(rows, 4)


def test_substrings_in_many_blocks(docs, rows):
    """Blocks of a few words settle the same windows as one."""
    assert bag(substring_dedup.dedup_substrings(docs, digest=True, block_words=40)) == brute_substrings(rows)
    assert substring_dedup.doubling(13) == [7, 13] and substring_dedup.doubling(40) == [5, 10, 20, 40]
    assert bag(substring_dedup.dedup_substrings(docs, width=30, digest=True, block_words=300)) == brute_substrings(rows, 30)


def test_longest_repeats(docs, rows, empty):
    got = dict(bag(substring_dedup.longest_repeats(docs)))
    by_doc = {}
    for i, t, *_ in rows:
        if i is not None:
            by_doc.setdefault(i, []).append((t or "").split())
    names = {}
    for level in (13, 26, 52, 104, 208):
        for i, ws in by_doc.items():
            for w in ws:
                for p in range(len(w) - level + 1):
                    names.setdefault((level, tuple(w[p : p + level])), set()).add(i)
    want = {i: 0 for i in by_doc}
    for (level, _), ds in sorted(names.items(), key=lambda x: x[0][0]):
        if len(ds) > 1:
            for i in ds:
                want[i] = max(want[i], level)
    assert got == want
    assert substring_dedup.longest_repeats(empty).count() == 0


def brute_jaccard(rows, percent=70):
    sets = []
    for _, t, *_ in rows:
        w = lower_ascii((t or "").encode()).split()
        sets.append({tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    n = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is not None and rows[b][0] is not None and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                n[a] += 1
                n[b] += 1
                up[root(a)] = root(b)
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[root(k)] = min(least.get(root(k), r[0]), r[0])
    return sorted(((r[0], len(sets[k]), n[k], least[root(k)] if r[0] is not None else None) for k, r in enumerate(rows)), key=repr)


def test_jaccard_join(docs, rows, empty):
    want = brute_jaccard(rows)
    assert sum(w[2] for w in want) > 20
    assert bag(jaccard_join.similar_documents(docs)) == want
    assert jaccard_join.similar_documents(empty).count() == 0


def test_jaccard_join_of_rows_with_equal_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (1, a), (0, "z")]
    assert bag(jaccard_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"))) == brute_jaccard(rows)


def test_jaccard_join_of_many_copies(spark):
    r = random.Random(9)
    base = [f"w{r.randrange(500)}" for _ in range(60)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(r.randrange(4)):
            w[r.randrange(60)] = f"x{r.randrange(99)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for tile in (16, 512):  # many units, and one
        assert bag(jaccard_join.similar_documents(df, block_words=2000, tile=tile)) == brute_jaccard(rows)


def test_comparison_of_tiles():
    r = np.random.default_rng(2)
    base = r.integers(0, 1 << 62, 60).astype(np.uint64)
    sets = [np.unique(np.r_[base[: r.integers(30, 60)], r.integers(0, 1 << 62, r.integers(0, 12)).astype(np.uint64)]) for _ in range(40)]
    for threshold in (50, 70, 100):
        want = {(i, j) for i in range(40) for j in range(40) if 100 * len(np.intersect1d(sets[i], sets[j])) >= threshold * len(np.union1d(sets[i], sets[j]))}
        assert set(zip(*(x.tolist() for x in jaccard_join.compare(sets, None, threshold)))) == {(i, j) for i, j in want if i < j}
        assert set(zip(*(x.tolist() for x in jaccard_join.compare(sets[:15], sets[15:], threshold)))) == {(i, j - 15) for i, j in want if i < 15 <= j}


def test_components(spark):
    r = random.Random(4)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(180)]
    df = spark.createDataFrame(links, "a long, b long").repartition(4)
    want = {}
    for x in range(300):
        seen, todo = {x}, [x]
        while todo:
            y = todo.pop()
            for a, b in links:
                for p, q in ((a, b), (b, a)):
                    if p == y and q not in seen:
                        seen.add(q)
                        todo.append(q)
        if min(seen) != x:
            want[x] = min(seen)
    assert dict(bag(jaccard_join.components(df))) == want


def test_secrets(spark, docs, rows, empty):
    key = "aB3dE5fG7hI9kL1mN3pQ"
    texts = [f'x password = "{key}" y', f"Token:{key}{key} api_key='short' AKIA{'Z9' * 8}", f"free {key}X99 text", f"free {key}X99 text", "deadbeefdeadbeef secret=secret=\"abcdefghijkl\"", "é token=" + "a1" * 8, None, "", f"only {key}Q77 here"]
    df = spark.createDataFrame([(i, t, f"o{i}") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in secrets.scan_secrets(df).collect()}
    assert got[0]["spans"] == "assign:2:34" and got[0]["n_assign"] == 1 and got[0]["n_live"] == 1
    assert got[1]["n_assign"] == 1 and got[1]["n_access"] == 1
    assert got[2]["spans"] == "" and got[2]["n_shared"] == 1 and got[2]["max_repos"] == 2
    assert got[8]["spans"].startswith("owned:5:")
    assert got[4]["spans"] == "hex:0:16" and got[4]["n_assign"] == 0
    assert got[5]["spans"].split(",")[0].startswith("assign:2:24")
    for i, t in enumerate(texts):
        want = []
        for k, name, p, least in ((0, "assign", secrets.ASSIGN, 12), (1, "access", re.compile("AKIA[A-Z0-9]+"), 18), (2, "hex", re.compile("[0-9a-f]+"), 16)):
            want += [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for m in p.finditer(t or "") if len(m.group(2 if k == 0 else 0)) >= least]
        assert got[i]["base_sha256"] == sha(",".join(x for *_, x in sorted(want)))
    assert secrets.scan_secrets(docs).count() == len(rows)
    assert secrets.scan_secrets(empty).count() == 0


def test_packing(docs, rows, empty):
    got = packing.pack(docs, max_len=50, buckets=3, budget=200).collect()
    want = {}
    for i, t, *_ in rows:
        for p in range(0, len((t or "").split()), 50):
            want[(i, p)] = want.get((i, p), 0) + 1
    have = {}
    for r in got:
        have[(r["doc_id"], r["start"])] = have.get((r["doc_id"], r["start"]), 0) + 1
        assert r["n_tokens"] <= r["bucket"] and r["padding"] == r["bucket"] - r["n_tokens"] and r["slot"] < 200 // r["bucket"]
    assert have == want
    slots = [(r["bucket"], r["batch"], r["slot"]) for r in got]
    assert len(set(slots)) == len(slots)
    for b in {s[0] for s in slots}:
        per = 200 // b
        assert sorted(x * per + y for c, x, y in slots if c == b) == list(range(sum(s[0] == b for s in slots)))
    assert packing.pack(empty).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, max_len=10, budget=5)


def test_packing_in_many_ranges(docs):
    one = bag(packing.pack(docs, max_len=64, budget=256))
    old = packing.RANGE_ROWS
    packing.RANGE_ROWS = 7
    try:
        assert bag(packing.pack(docs, max_len=64, budget=256)) == one
    finally:
        packing.RANGE_ROWS = old


def test_boundaries_are_optimal():
    from itertools import combinations

    r = random.Random(2)
    for _ in range(30):
        ls = sorted(r.sample(range(1, 40), 7))
        cs = [r.randint(1, 9) for _ in ls]
        cost = lambda bs: sum(c * (min(b for b in bs if b >= n) - n) for n, c in zip(ls, cs))
        for k in (1, 2, 3, 9):
            best = min(cost((*c, ls[-1])) for c in combinations(ls[:-1], min(k, 7) - 1))
            assert cost(packing.boundaries(ls, cs, k)) == best
    assert packing.boundaries([], [], 4) == []


def test_quality(spark, docs, rows, empty):
    r = random.Random(5)
    good = lambda: " ".join(r.choice(("the", "river", "ran", "slowly", "by", "town")) for _ in range(90)) + "."
    bad = lambda: " ".join(r.choice(("buy%%%", "NOW!!", "$$$", "win&&&")) for _ in range(90))
    data = [(i, good() if i % 3 else bad(), int(i % 3 > 0)) for i in range(300)]
    df = spark.createDataFrame([d[:2] for d in data], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in data] + [(900, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(df, labels).collect()
    assert len(got) == 300
    truth = {i: y for i, _, y in data}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    model = quality.train(df, labels)
    assert quality.score(docs, model).count() == len(rows)
    assert quality.keep_good(docs, model).columns == docs.columns
    assert quality.classify(empty, labels).count() == 0
    assert quality.train(df, labels.filter("quality = 1")) == 1.0


def test_attention_gradient():
    r = np.random.default_rng(0)
    m = quality.GatedAttention(features=5, hidden=4, gate=3)
    x, n, y = r.normal(size=(7, 5)), np.array([3, 4]), np.array([1.0, 0.0])
    loss = lambda: -float(np.mean(y * np.log(m.forward(x, n)["y"]) + (1 - y) * np.log(1 - m.forward(x, n)["y"])))
    g = m.gradient(x, n, y)
    for k, v in m.p.items():
        i = tuple(0 for _ in v.shape)
        v[i] += 1e-6
        a = loss()
        v[i] -= 2e-6
        b = loss()
        v[i] += 1e-6
        assert abs((a - b) / 2e-6 - g[k][i]) < 1e-6


def brute_align(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_alignment():
    r = random.Random(8)
    for _ in range(40):
        a, b = [r.randrange(4) for _ in range(r.randint(1, 12))], [r.randrange(4) for _ in range(r.randint(1, 30))]
        s, first, last = decontaminate.align(np.array(a), np.array(b))
        assert s == brute_align(a, b) and brute_align(a, b[first:last]) == s


def test_alignment_of_long_texts():
    r = np.random.default_rng(3)
    item = r.integers(0, 1 << 40, 2000).astype(np.uint64)
    text = r.integers(0, 1 << 40, 60_000).astype(np.uint64)
    text[30_000:32_000] = item
    text[31_000] = 5
    assert decontaminate.align(item, text) == (2 * 1999 - 1, 30_000, 32_000)


def test_tokens_and_their_hashes():
    texts = ["A b-c_d\u2019s \u201cÉté\u201d 12.5", "", None, "ÉTÉ a B c_d", "\u00e9t\u00e9\u3000x\u0301y 日本"]
    words = [decontaminate.tokens(t) for t in texts]
    assert [decontaminate.plain(t).decode().split() for t in texts] == words
    got = decontaminate.hashes(texts)
    flat, hs = [w for ws in words for w in ws], np.concatenate(got)
    assert [len(h) for h in got] == [len(ws) for ws in words] and all((hs[i] == hs[j]) == (flat[i] == flat[j]) for i in range(len(flat)) for j in range(len(flat)))


def test_leaks_against_alignment_of_all_pairs(spark):
    """Every document that a test item aligns with at the threshold, by aligning each with each: what seeds miss."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text").collect()
    h, g = decontaminate.hashes([r[1] for r in docs]), decontaminate.hashes([r[1] for r in items])
    want = set()
    for d, a in zip(docs, h):
        for i, b in zip(items, g):
            if len(b) and np.isin(b, a).sum() >= 0.5 * len(b) and decontaminate.align(b, a)[0] >= 0.5 * 2 * len(b):
                want.add((d[0], i[0]))
    found = decontaminate.find_leaks(spark.createDataFrame(docs), spark.createDataFrame(items)).collect()
    assert want and {(r["doc_id"], r["item_id"]) for r in found} == want


def test_decontamination(spark, docs, rows, empty):
    r = random.Random(6)
    vocab = [f"w{k}" for k in range(300)]
    items = [(k, " ".join(r.choice(vocab) for _ in range(30))) for k in range(12)] + [(12, None), (13, ""), (14, "lonely wordx"), (None, "t1 t2 t3 t4 t5 t6")]
    fill = lambda: " ".join(r.choice(vocab) for _ in range(50))
    data, want = [], set()
    for i in range(40):
        t = fill()
        if i < 12:
            t += " " + items[i][1].upper() + ", " + fill()
            want.add((i, i))
        elif i < 20:
            w = items[i - 12][1].split()
            for k in (3, 9, 17, 25):
                w[k] = "edited"
            del w[12]
            t += " " + " ".join(w) + " " + fill()
            want.add((i, i - 12))
        elif i < 24:
            t += " " + " ".join(items[i - 20][1].split()[:9]) + " " + fill()  # a short quote isn't a leak
        data.append((i, t))
    data += [(50, None), (51, ""), (52, "a lonely wordx here")]
    want.add((52, 14))
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(data, "doc_id long, text string")
    found = decontaminate.find_leaks(df, bench)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == want
    kept = decontaminate.drop_leaking(df, bench)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in data} - {i for i, _ in want}
    assert decontaminate.drop_leaking(docs, bench.limit(0)).count() == len(rows)
    assert decontaminate.find_leaks(docs, bench.limit(0)).count() == 0
    assert decontaminate.find_leaks(empty, bench).count() == 0
    old = decontaminate.BLOCK_CHARS
    decontaminate.BLOCK_CHARS = 500
    try:
        assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(df, bench).collect()} == want
    finally:
        decontaminate.BLOCK_CHARS = old


@pytest.mark.parametrize("copies", [51, 2000])
def test_decontamination_of_a_form_that_leaked_widely(spark, copies):
    r = random.Random(7)
    items = [(k, [f"i{k}w{j}" for j in range(m)]) for k, m in enumerate((18, 30, 45, 59))]
    cut = lambda ws, at: [f"x{r.random()}" if j % 5 == at else w for j, w in enumerate(ws)]
    fill = lambda: [f"f{r.randrange(500)}" for _ in range(20)]
    wide = {k: cut(ws, 4) for k, ws in items}
    data, want = [], set()
    for i in range(copies):
        want |= {(4 * i + k, k) for k in wide}
        data += [(4 * i + k, " ".join(fill() + w + fill())) for k, w in wide.items()]
    for k, ws in items:  # one document has another form, with n-grams that the wide one broke
        data.append((-1 - k, " ".join(fill() + cut(ws, 2) + fill())))
        want.add((-1 - k, k))
    bench = spark.createDataFrame([(k, " ".join(ws)) for k, ws in items], "item_id long, text string")
    df = spark.createDataFrame(data + [(-9, " ".join(fill()))], "doc_id long, text string")
    assert {(x["doc_id"], x["item_id"]) for x in decontaminate.find_leaks(df, bench).collect()} == want
    assert [x["doc_id"] for x in decontaminate.drop_leaking(df, bench).collect()] == [-9]


def test_licenses(spark, docs, rows, empty):
    fill = "some words about nothing at all that go on"
    data = [
        ("a/LICENSE", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
        ("a/x.py", fill), ("a/b/c/y.py", fill), ("a/b/z.py", f"{fill}\nLicensed under the Apache License, Version 2.0.\n{fill}"), ("a/d/COPYING", "SPDX-License-Identifier: GPL-3.0-only"),
        ("a/d/e/f.c", None), ("g/h.c", fill), (None, fill), ("top.txt", ""), ("a/LICENSE", "SPDX-License-Identifier: MIT"),
    ]
    df = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(data)], "doc_id long, p string, text string").withColumn("dir", F.lit(1))
    got = {r["doc_id"]: r for r in licenses.scan_licenses(df, F.col("p")).collect()}
    assert len(got) == len(data)
    assert [got[i]["license"] for i in range(9)] == ["MIT", "MIT", "MIT", "Apache-2.0", "GPL-3.0", "GPL-3.0", None, None, None]
    assert got[2]["inherited_from"] == "a" and got[5]["inherited_from"] == "a/d" and got[3]["inherited_from"] is None
    assert abs(got[3]["cosine"] - 1) < 1e-9
    assert licenses.scan_licenses(docs, F.concat_ws("/", "source", "doc_id")).count() == len(rows)
    assert licenses.scan_licenses(empty, F.col("source")).count() == 0


def test_licenses_inside_a_line():
    t = licenses.Templates(licenses.TEMPLATES)
    df = np.full(len(t.vocab), 40)
    for w in (b"all", b"the", b"of", b"and", b"under", b"to", b"this", b"is"):
        df[t.vocab[w]] = 9000
    t.weigh(df, 10000, 0.6)
    fill = " ".join(f"word{k}" for k in range(60))
    for name, ts in licenses.TEMPLATES.items():
        for x in ts:
            for text in (f"{fill} {x} {fill}", f"{fill} {x.replace(' ', chr(10), 2)} {fill}", f"{x} {fill}", f"two {x} more"):
                own, cosine, n, _ = t.scan(text, 0.6)
                assert own == name and cosine > 0.99 and n >= len(licenses.flat(x).split()), text
    mit, gpl = "Released under the MIT License.", licenses.TEMPLATES["GPL-3.0"][1]
    assert t.scan(f"{fill} {mit} {fill} {gpl}", 0.6)[2] == 5 + len(licenses.flat(gpl).split())
    assert t.scan(f"{fill} Licensed under Apache License 2.0, {fill}", 0.6)[0] == "Apache-2.0"
    for prose in ("all the rights of the people", "he reserved a table", "released to the public", "a permission to the copy"):
        assert t.scan(f"{fill} {prose} {fill}", 0.6)[0] is None


@pytest.mark.parametrize(("text", "name"), [
    ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "GPL-2.0"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "GPL-3.0"),
    ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "LGPL-2.1"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "AGPL-3.0"),
    ("SPDX-License-Identifier: GPL-2.0-only", "GPL-2.0"), ("SPDX-License-Identifier: LGPL-3.0-or-later", "LGPL-3.0"), ("SPDX-License-Identifier: AGPL-3.0-only", "AGPL-3.0"), ("SPDX-License-Identifier: BSD-2-Clause", "BSD-2-Clause"), ("SPDX-License-Identifier: ISC", "ISC"),
    (licenses.TEMPLATES["BSD-2-Clause"][2], "BSD-2-Clause"), (licenses.TEMPLATES["BSD-3-Clause"][3], "BSD-3-Clause"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "ISC"),
    ("This is free and unencumbered software released into the public domain.", "Unlicense"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use", "MIT"),
])
def test_licenses_are_told_apart(text, name):
    t = licenses.Templates(licenses.TEMPLATES)
    df = np.full(len(t.vocab), 40)
    for w in (b"all", b"the", b"of", b"and", b"under", b"to", b"this", b"is", b"or", b"in", b"a", b"any", b"for", b"be", b"by", b"it", b"as", b"with"):
        df[t.vocab[w]] = 9000
    t.weigh(df, 10000, 0.6)
    fill = " ".join(f"word{k}" for k in range(40))
    words = text.split()
    for layout in (text, "\n".join(" * " + " ".join(words[k : k + 8]) for k in range(0, len(words), 8)), f"{fill}\n{text}\n{fill}"):
        assert t.scan(layout, 0.6)[0] == name, layout


def test_license_cosine_matches_brute_force():
    import math

    t = licenses.Templates(licenses.TEMPLATES)
    df = np.arange(len(t.vocab)) % 7
    t.weigh(df, 10, 0.6)
    for line in ("Licensed under the MIT License, dear reader", "Released under the Apache 2.0 License", "nothing here", "this work is licensed"):
        ws = licenses.flat(line).split()
        best = 0.0
        for k, (_, tw) in enumerate(t.rows):
            if any(g.isdisjoint(ws) for g in t.must[k]):
                continue
            idf = lambda w: math.log(11 / (1 + df[t.vocab[w]])) + 1 if w in t.vocab else math.log(11) + 1
            u, v = ({w: ws_.count(w) * idf(w) for w in set(ws_)} for ws_ in (ws, list(tw)))
            best = max(best, sum(x * v.get(w, 0) for w, x in u.items()) / math.sqrt(sum(x * x for x in u.values()) * sum(x * x for x in v.values())))
        assert abs(t.best(ws)[0] - best) < 1e-9
        if best >= 0.6:
            assert not t.cues.isdisjoint(ws)


def test_nearest(spark):
    r = np.random.default_rng(3)
    centre = r.normal(size=(8, 16))
    x = (centre[r.integers(0, 8, 600)] + 0.6 * r.normal(size=(600, 16))).astype(np.float32)
    rows = [(i, x[i].tolist(), "c") for i in range(600)]
    rows += [(600, None, "c"), (620, [0.0] * 16, "c"), (640, [float("nan")] * 16, "c"), (660, [1.0] * 5, "c"), (680, [None] * 16, "c"), (700, [float("inf")] + [0.0] * 15, "c"), (None, [1.0] * 16, "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, shard string")
    for shard_rows in (ann.SHARD_ROWS, 150):  # one shard, and several
        got = {}
        for q in ann.nearest(df, F.col("vec_id") % 20 == 0, shard_rows=shard_rows).collect():
            got.setdefault(q["query_id"], []).append((q["rank"], q["vec_id"], q["score"]))
        assert sorted(got) == list(range(0, 600, 20))
        hit = 0
        for q, found in got.items():
            s = x.astype(float) @ x[q].astype(float)
            s[q] = -1e9
            best = np.lexsort((np.arange(600), -s))[:20]
            found.sort()
            assert [k for k, *_ in found] == list(range(1, 21))
            assert all(abs(s[i] - v) < 1e-9 for _, i, v in found)
            hit += len({i for _, i, _ in found} & set(best.tolist()))
        assert hit >= 0.9 * 20 * len(got)
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in ann.nearest(few, F.col("vec_id") == 0).orderBy("rank").collect()] == [(0, 1, 1, 1.0), (0, 2, 3, 1.0), (0, 3, 2, 0.0)]
    assert ann.nearest(few.limit(0), F.col("vec_id") == 0).count() == 0
    mixed = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 2.0]), (1, [0.5, 0.1]), (2, [3.0]), (3, [2.0]), (20, [1e-9]), (4, None)], "vec_id long, embedding array<double>")
    want = [(0, 1, 1, 0.2), (0, 1, 1, 0.5), (20, 1, 2, 3.0 * 1e-9), (20, 2, 3, 2.0 * 1e-9)]  # by length; both rows of the id 0 ask
    assert sorted(tuple(r) for r in ann.nearest(mixed, F.col("vec_id") % 20 == 0).collect()) == want


def test_words_and_hashes():
    assert words("a b\x1cc d\x0be") == ["a b\x1cc".encode(), b"d", b"e"]
    assert words(None) == [] == words("")
    assert lower_ascii("AÉz".encode()) == "aÉz".encode()
    assert len(hash_words([])) == 0
