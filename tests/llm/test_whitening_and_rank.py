"""Whitening against numpy, ranked lexical search against plain counting."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from prefgraph.llm import lexical_rank, qd_svd, queries, whitening


def covariance_of(distinct):
    n, s = len(distinct), distinct.astype(object).sum(axis=0)
    c = (n * distinct.astype(object) - s).astype(np.float64) / n
    return n, s, c, c.T @ c / n


def check_whitening(rows, got, most=16):
    """``rows``: (id, vector) that remain."""
    x = {k: np.array([math.floor(64 * float(c)) + 1000000 for c in v]) for k, v in enumerate(v for _, v in rows)}
    distinct = np.array(sorted({tuple(v) for v in x.values()}))
    n, s, c, v = covariance_of(distinct)
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    k = min(most, int((e > 1e-12 * e[0]).sum()))
    assert len(got) == len(rows) * k
    by_key = {}
    for r in got:
        by_key.setdefault((r["vec_id"], r["component"]), []).append(r)
    signs = {}
    for at, (key, _) in enumerate(rows):
        dev = int((((n * x[at].astype(object) - s)) ** 2).sum())
        w = ((n * x[at].astype(object) - s).astype(np.float64) / n) @ u[:, :k] / np.sqrt(e[:k])
        for m in range(k):
            found = [r for r in by_key[key, m + 1] if r["deviation"] == dev]
            assert found and all(r["n"] == n and r["identity_error"] < 1e-9 for r in found)
            assert found[0]["explained"] == pytest.approx(e[m] / e.sum(), rel=1e-9)
            if abs(w[m]) > 1e-6 and (m + 1 == len(e) or (e[m] - e[m + 1] > 1e-3 * e[m])) and (m == 0 or e[m - 1] - e[m] > 1e-3 * e[m]):
                sign = signs.setdefault(m, np.sign(found[0]["whitened"] * w[m]))
                assert any(r["whitened"] * sign == pytest.approx(w[m], abs=1e-7) for r in found)


def test_singular_values_and_vectors():
    rng = np.random.default_rng(4)
    turn = lambda n: np.linalg.qr(rng.normal(size=(n, n)))[0]
    cases = [rng.normal(size=(n, n)) for n in (1, 2, 3, 7, 40, 90)]
    cases += [np.eye(9), turn(30) @ np.diag([5.0] * 10 + [3.0] * 20) @ turn(30), np.diag(np.logspace(0, -14, 30)), turn(30) @ np.diag(np.r_[5 + np.arange(10) * 1e-11, np.linspace(1, 3, 20)]) @ turn(30)]
    for r in cases:
        n = len(r)
        squares, v = qd_svd.right_singular(r, n)
        want = np.linalg.svd(r, compute_uv=False)
        assert len(squares) == n and np.allclose(np.sqrt(squares), want, rtol=1e-11)
        assert np.abs(v.T @ v - np.eye(n)).max() < 1e-11
        assert np.abs(r.T @ (r @ v) - v * squares).max() < 1e-11 * squares[0]
    assert len(qd_svd.right_singular(np.zeros((4, 4)), 4)[0]) == 0
    low = rng.normal(size=(30, 5)) @ rng.normal(size=(5, 12))
    assert len(qd_svd.right_singular(np.linalg.qr(low, mode="r"), 12)[0]) == 5


def test_small_values_are_relatively_accurate():
    """A graded bidiagonal matrix, whose least singular value is far below the largest one's rounding."""
    a, b = np.logspace(0, -30, 25), np.logspace(-1, -31, 24)
    got = np.sqrt(qd_svd.dqds(a, b))
    import fractions

    exact = [fractions.Fraction(float(x)) for x in a]
    product = math.prod(exact)
    assert math.isclose(math.fsum(np.log(got)), float(sum(math.log(x) for x in exact)), rel_tol=1e-13) and product > 0


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(300, 20)) @ np.diag(np.linspace(3, 0.3, 20))
    rows = [(int(k), [float(c) for c in v]) for k, v in enumerate(base)]
    rows += [(900 + k, rows[3][1]) for k in range(200)] + [(5, rows[9][1]), (None, rows[11][1])]
    odd = [(1000, None), (1001, []), (1002, [1.0] * 3), (1003, [float("nan")] + [0.0] * 19), (1004, [None] + [0.0] * 19), (1005, [float("inf")] + [0.0] * 19)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows + odd], "vec_id long, embedding array<float>, n int, x string").repartition(7)
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in rows]
    check_whitening(rows, whitening.whiten(df).collect())


def test_whitening_of_few_rows(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert whitening.whiten(make([])).count() == 0
    assert whitening.whiten(make([(1, None), (2, [float("nan")])])).count() == 0
    assert whitening.whiten(make([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    two = [(1, [1.0, 2.0]), (2, [1.5, 4.0]), (3, [1.0, 2.0])]
    check_whitening(two, whitening.whiten(make(two)).collect())
    big = whitening.whiten(make([(1, [1e17, 0.0]), (2, [-1e17, 3.0]), (3, [5.0, 1.0])])).collect()
    assert big and {r["vec_id"] for r in big if r["deviation"] is None} == {1, 2}


def test_op12_whole_table(spark, sf):
    got = queries.op12_whitening(spark, sf).collect()
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check_whitening(rows, got)


def test_triangles_are_reduced_in_rounds(spark):
    rng = np.random.default_rng(2)
    rows = [(k, [float(c) for c in rng.normal(size=6)]) for k in range(400)]
    check_whitening(rows, whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(40)).collect())


PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def found_terms(text):
    return [t.encode() for t in PATTERN.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]


def plain_rank(docs, items, k):
    counts = [(d, Counter(found_terms(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked, out = {}, []
    for i, t in items:
        asked.setdefault(i, set()).update(found_terms(t))
    for i, ts in asked.items():
        scored = []
        for d, c in counts:
            m = 50 + 50 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in ts if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(i, r + 1, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(scored)[:k])]
    return out


def test_terms_are_the_pattern():
    rng = random.Random(1)
    for _ in range(2000):
        text = "".join(rng.choice("aZ9_-é\x85\x1c \x7f\x00@[`{ \nKİ") for _ in range(12))
        assert lexical_rank.terms(text) == found_terms(text)


def test_rank_equals_plain_counting(spark):
    rng = random.Random(7)
    words = [f"w{k}" for k in range(60)] + ["Über", "é", "X_y"]
    docs = [(k, " ".join(rng.choices(words, k=rng.randint(0, 40)))) for k in range(700)]
    docs += [(800 + k, "w1 w2 w3") for k in range(120)] + [(None, "w1 w2 w3"), (2000, None), (2001, ""), (2002, "..."), (3, docs[3][1]), (2003, "w5 " * 30000)]
    items = [(k, " ".join(rng.choices([*words, "nowhere"], k=rng.randint(1, 12)))) for k in range(30)] + [(50, None), (51, ""), (4, "w9 w9"), (None, "w1 w7"), (52, "W1 w2, w3!")]
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, score string, n int").repartition(6)
    q = spark.createDataFrame([(i, t, 3) for i, t in items], "item_id long, text string, rank int")
    want = Counter(plain_rank(docs, items, 50))
    rows = lambda df: Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect())
    assert rows(lexical_rank.rank(d, q)) == want
    # several groups of items, small tiles of documents
    assert rows(lexical_rank.rank(d, q, group=60, docs_a_tile=37)) == want
    assert lexical_rank.rank(d.limit(0), q).count() == 0 == lexical_rank.rank(d, q.limit(0)).count()


def test_tiles_stay_exact():
    weights = np.array([30000] * 50, np.int64)
    items = [np.arange(0, 20, dtype=np.int32), np.arange(10, 50, dtype=np.int32), np.array([], np.int32)]
    plan = lexical_rank.tiles(items, weights, most_terms=25)
    assert [first for first, _ in plan] == [0, 1, 2] and sum(t.items for _, t in plan) == 3
    owner, ids = np.repeat(np.arange(2), 50), np.tile(np.arange(50), 2).astype(np.int32)
    impact = np.full(100, 999_999, np.int64)
    for first, tile in plan:
        place = np.full(50, -1, np.int32)
        scores = tile.scores(2, owner, ids, impact, place)
        for c in range(tile.items):
            assert scores[:, c].tolist() == [30000 * 999_999 * len(items[first + c])] * 2
        assert (place == -1).all()
    huge = lexical_rank.Tile([np.arange(3, dtype=np.int32)], np.array([(2**52 + 2**30) // 10**6] * 3, np.int64))
    assert len(huge.chunks) == 3


def test_op13_equals_sql(spark, sf, duck, same):
    same(queries.op13_lexical_rank(spark, sf).toPandas(), duck.sql(queries.ORACLE_SQL["op13_lexical_rank"]).df())
