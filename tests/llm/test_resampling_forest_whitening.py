"""Resampling, the MinHash forest and whitening against brute force."""

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from auditlake.llm import forest, hot, queries, resampling, whitening

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
FEATURE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
EXTRA = "doc_id long, text string, n_words long, buckets string, score string, rank string, k string, g string"


def prose(seed, n, vocabulary=60):
    rnd = random.Random(seed)
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(n))


TEXTS = [(1, None), (2, ""), (3, " \n.,-"), (4, "One"), (5, "one TWO one two"), (6, prose(1, 25000)), (7, "Straße ÄPFEL d'été x1 y " * 6), (8, prose(2, 20)), (9, prose(2, 20)), (9, prose(2, 20)), (9, prose(3, 30)), (None, prose(4, 40))]
TEXTS += [(100 + i, prose(i % 40, 15 + i % 30)) for i in range(120)]
TARGET = ["w1 w2 w3 one two", None, "", "ÄPFEL Straße"]


def features(text):
    w = FEATURE_WORD.findall((text or "").translate(LOW))
    return len(w), w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]


def bucket(f):
    return zlib.crc32(f.encode()) % 10000


def expected(rows, target):
    have, want = [0] * 10000, [0] * 10000
    for texts, count in (([t for _, t in rows], have), (target, want)):
        for t in texts:
            for f in features(t)[1]:
                count[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((t + 1) * (sum(have) + 10000) / ((s + 1) * (sum(want) + 10000)))) for s, t in zip(have, want, strict=True)]
    out = []
    for i, t in rows:
        n, fs = features(t)
        weight = sum(gain[bucket(f)] for f in fs) // len(fs) if fs else 0
        h = None if i is None else int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(fs), weight, None if h is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    open_ = sorted((-r[3], r[0], k) for k, r in enumerate(out) if r[4] >= 20 and r[0] is not None)
    ranks = {k: p + 1 for p, (_, _, k) in enumerate(open_[: 25 * len(open_) // 100])}
    return [(*r[:4], ranks.get(k)) for k, r in enumerate(out)]


def test_resampling(spark):
    docs = spark.createDataFrame([(i, t, 0, "x", "x", "x", "x", "x") for i, t in TEXTS], EXTRA).repartition(5)
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    got = [tuple(r) for r in resampling.resample(docs, target).collect()]
    want = expected(TEXTS, TARGET)
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(want, key=key)
    ranks = sorted(r[4] for r in got if r[4] is not None)
    assert ranks == list(range(1, len(ranks) + 1)) and len(ranks) > 20
    assert resampling.resample(docs.limit(0), target).count() == 0
    assert resampling.resample(docs, target.limit(0)).count() == len(TEXTS)
    # an id in a third of all rows takes as many ranks as it is drawn, and shares no task's rows by its id alone
    often = spark.createDataFrame([(5, prose(9, 30))] * 200 + [(i, prose(i, 30)) for i in range(1000, 1400)], "doc_id long, text string")
    drawn = [r for r in resampling.resample(often, target).collect() if r["rank"] is not None]
    assert sorted(r["rank"] for r in drawn) == list(range(1, 151))
    order = sorted(drawn, key=lambda r: r["rank"])
    assert [(-r.score, r.doc_id) for r in order] == sorted((-r.score, r.doc_id) for r in drawn)


def test_scoring_has_no_explode(spark):
    rows = resampling.weigh(resampling.bucketed(spark.createDataFrame(TEXTS, "doc_id long, text string")), [0] * 10000)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Exchange" not in plan


def components(rows):
    sets = []
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOW))
        sets.append((i, {tuple(w[p : p + 2]) for p in range(len(w) - 1)} if len(w) >= 2 else {tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for x, (i, a) in enumerate(sets):
        for y, (j, b) in enumerate(sets[:x]):
            if None not in (i, j) and a and b and 100 * len(a & b) >= 80 * len(a | b):
                up[find(x)] = find(y)
    low = {}
    for x, (i, _) in enumerate(sets):
        if i is not None:
            low[find(x)] = min(i, low.get(find(x), i))
    return sorted((str(i), len(s), None if i is None else low[find(x)], None if i is None else low[find(x)] == i) for x, (i, s) in enumerate(sets))


def groups(rnd, most, stars):
    """Groups of texts around a base; in stars all are near the base and few near each other."""
    rows = []
    for _ in range(stars):
        base = [f"t{rnd.randrange(4000)}" for _ in range(120)]
        rows.append((9000 - len(rows), " ".join(base)))
        for _ in range(40):
            w = list(base)
            for _ in range(rnd.randrange(most)):
                w[rnd.randrange(120)] = f"r{rnd.randrange(900)}"
            rows.append((9000 - len(rows), " ".join(w)))
    return rows


def test_forest(spark, monkeypatch):
    rows = [*TEXTS, *groups(random.Random(3), 14, 6), (9001, "ONE"), (9002, "one two one two")]
    docs = spark.createDataFrame([(i, t, 0, "x", "x", "x", "x", "x") for i, t in rows], EXTRA).repartition(4)
    want = components(rows)
    got = forest.dedup(docs).collect()
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id, r.kept) for r in got) == want
    assert forest.dedup(docs.limit(0)).count() == 0
    # every key hot, regions cut as deep as they go, centres chosen in small blocks
    for name, value in (("LOOK", 1), ("LEAST", 1)):
        monkeypatch.setattr(hot, name, value)
    monkeypatch.setattr(forest, "ROOM", 2)
    again = forest.dedup(docs).collect()
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id, r.kept) for r in again) == want


def test_forest_without_neighbours(spark, monkeypatch):
    """What the first pass misses, the comparison across components finds."""
    rows = groups(random.Random(4), 12, 4)
    monkeypatch.setattr(forest, "neighbours", lambda members: members.selectExpr("id", "id as other", "0 as kind").limit(0))
    got = forest.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id, r.kept) for r in got) == components(rows)


def test_forest_sketches():
    """Sketches of sets of similarity 0.8 differ in a tenth of their bits; regions meet as often as the docstring says."""
    rnd = np.random.default_rng(1)
    pair = forest.words.mix(np.arange(1, 241, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
    a, b = (pair & np.uint64(0xFFFFFFFF)).astype(np.uint32) | np.uint32(1), (pair >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    bits, met = [], []
    for _ in range(300):
        common, own = rnd.integers(0, 2**63, 240).astype(np.uint64), rnd.integers(0, 2**63, (2, 30)).astype(np.uint64)
        g, r, w = forest.labels(np.stack([forest.minima(np.concatenate([common, x]), a, b) for x in own]))
        bits.append(int(np.bitwise_count((w[0] ^ w[1]).view(np.uint64)).sum()))
        met.append(int((g[0] == g[1]).sum()))
    assert 22 < np.mean(bits) < 26 and max(bits) < forest.FAR
    assert 0.36 < np.mean(met) / forest.TREES < 0.46 and min(met) > 0


def test_eigen():
    rnd = np.random.default_rng(0)
    for a in (rnd.normal(size=(40, 60)), rnd.normal(size=(5, 3)), np.zeros((4, 4)), np.diag([3.0, 3, 1, 0]), np.ones((6, 6))):
        v = a @ a.T
        value, axes = whitening.eigen(v)
        assert np.allclose(value, np.linalg.eigvalsh(v)[::-1], atol=1e-11 * max(1, abs(v).max()))
        assert np.allclose(axes @ axes.T, np.eye(len(v)), atol=1e-12) and np.allclose(axes.T @ np.diag(value) @ axes, v, atol=1e-11 * max(1, abs(v).max()))


def test_welford_merges():
    x = np.random.default_rng(2).normal(size=(500, 6)) * 100 + 1e5
    whole = whitening.State.empty(6)
    for part in np.array_split(x, [0, 7, 8, 300]):
        one = whitening.State.empty(6)
        one.add(part)
        whole = whole.merge(one)
    assert whole.n == 500 and np.allclose(whole.m / 500, np.cov(x.T, bias=True), rtol=1e-12, atol=1e-9)


@pytest.mark.parametrize(("d", "parts"), [(12, 90), (3, 2), (1, 1)])
def test_whitening(spark, d, parts):
    rnd = np.random.default_rng(d)
    good = [(i, [float(np.float32(x)) for x in rnd.normal(size=d) * np.arange(1, d + 1) * 0.1]) for i in range(400)]
    good += [good[5], (None, good[6][1])]
    bad = [(900, None), (901, [None] * d), (902, [float("nan")] * d), (903, [float("inf")] + [0.0] * (d - 1)), (904, []), (905, [0.5] * (d + 1)), (906, [0.0] * (d - 1) + [None])]
    table = spark.createDataFrame([(i, v, "x", "x") for i, v in good + bad], "vec_id long, embedding array<float>, n string, v string").repartition(parts)
    got = whitening.whiten(table).collect()
    k, n = min(8, d), len(good)
    assert len(got) == n * k and {r.n for r in got} == {n}
    x = np.array([[math.floor(1024 * c) + 100000 for c in v] for _, v in good])
    s = x.sum(axis=0)
    assert sorted((str(r.vec_id), int(r.deviation)) for r in got if r.component == 1) == sorted((str(i), sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s, strict=True))) for (i, _), row in zip(good, x, strict=True))
    v = np.cov(x.T.astype(float), bias=True).reshape(d, d)
    e, axes = np.linalg.eigh(v)
    e, axes = e[::-1], axes[:, ::-1]
    want = (x - s / n) @ axes / np.sqrt(e)
    rows = {(str(r.vec_id), r.component): r for r in got}
    for j in range(k):
        mine = np.array([rows[str(i), j + 1].whitened for i, _ in good])
        assert min(abs(mine - want[:, j]).max(), abs(mine + want[:, j]).max()) < 1e-8
        assert abs(rows["0", j + 1].explained - e[j] / np.trace(v)) < 1e-12
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_whitening_degenerate(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [float("nan")])], schema)).count() == 0
    same = whitening.whiten(spark.createDataFrame([(i, [0.25, 0.5]) for i in range(5)], schema)).collect()
    assert {(r.whitened, r.explained, r.deviation, r.identity_error) for r in same} == {(None, None, 0, 0.0)}
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), float(2 * i)]) for i in range(5)], schema)).collect()
    assert {r.component for r in line if r.whitened is None} == {2} and line[0].identity_error < 1e-9
    # deviations beyond a long stay exact
    x = np.array([[2**39, 0], [-(2**39), 5], [1, 7]])
    sums = [int(c) for c in x.sum(axis=0)]
    n = 10**9
    want = [sum((Fraction(n) * int(a) - b) ** 2 for a, b in zip(row, sums, strict=True)) for row in x]
    assert whitening.deviations(x, n, sums) == want


def test_registered():
    assert {"op11_importance_resampling", "op12_minhash_forest", "op13_embedding_whitening"} <= set(queries.QUERIES)
