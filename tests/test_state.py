"""State that grows: triangles by batch, the kept user table; literal cells; clusters; logistic heads."""

import ast
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from prefgraph.functions.literals import to_json_text, with_json
from prefgraph.operators import clusters, logistic_heads
from prefgraph.operators.cycles import triplet_residual
from prefgraph.operators.edges import edge_flow
from prefgraph.sources import user_cache
from prefgraph.streaming.triangles import TriangleState


def observations(spark, seed, n, names="abcdef"):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        i, j = sorted(rng.sample(names, 2))
        rows.append((rng.choice(["p", "q"]), i, j, rng.choice([-1, 1]), rng.choice([0.5, 1.0])))
    return spark.createDataFrame(rows, "aspect string, i string, j string, sign int, weight double")


def table(df):
    return sorted((r["aspect"], r["i"], r["j"], r["k"], round(r["residual_energy"], 9), round(r["total_energy"], 9), r["cyclic"]) for r in df.collect())


def test_triangles_by_batch_equal_the_whole(spark, tmp_path):
    batches = [observations(spark, k, n, names) for k, (n, names) in enumerate([(40, "abcd"), (25, "abcdef"), (6, "ab"), (30, "cdef")])]
    state, seen = TriangleState(spark, str(tmp_path / "s"), ["aspect"]), None
    for k, batch in enumerate(batches):
        state.add(batch, k)
        seen = batch if seen is None else seen.unionByName(batch)
        whole = table(triplet_residual(edge_flow(seen, ["aspect"]), ["aspect"]))
        assert table(state.triangles()) == whole
    # the third batch has one pair: only triangles on it were made
    made = spark.read.parquet(str(tmp_path / "s/triangles/batch=2"))
    assert made.where("not (i = 'a' and j = 'b')").count() == 0 and made.count() > 0
    state.add(batches[1], 1)
    state.add(batches[3], 3)
    assert table(state.triangles()) == whole  # delivered again
    later = state.compact(str(tmp_path / "c"), 3)
    assert table(later.triangles()) == whole
    more = observations(spark, 9, 20)
    later.add(more, 4)
    assert table(later.triangles()) == table(triplet_residual(edge_flow(seen.unionByName(more), ["aspect"]), ["aspect"]))


def users(spark, ids, seed):
    rng = random.Random(seed)
    rows = [(u, rng.choice(["DE", "", "7"]), rng.randint(0, 1), rng.choice("xyz"), rng.randint(1, 4), seed * 1000 + k) for k, u in enumerate(rng.choice(ids) for _ in range(200))]
    return spark.createDataFrame(rows, "user_id long, country string, saved int, alternative string, cnt long, row_key long")


def result(df):
    return sorted((r["user_id"], r["country"], r["alternative"], r["n_scenarios"], round(r["beta"], 9)) for r in df.collect())


def test_user_table_reads_new_files_only(spark, tmp_path, monkeypatch):
    from prefgraph.operators.tournament import user_beta

    pattern, root = f"{tmp_path}/in/*.parquet", str(tmp_path / "cache")
    first, second = users(spark, range(12), 1), users(spark, range(6, 20), 2)
    first.repartition(3).write.parquet(f"{tmp_path}/in")
    out, read = user_cache.refresh(spark, pattern, root, 3)
    assert read == 3 and result(out) == result(user_beta(first, 3))
    second.repartition(2).write.mode("append").parquet(f"{tmp_path}/in")
    taken, plain = [], user_cache.partial_sums
    monkeypatch.setattr(user_cache, "partial_sums", lambda rows: taken.extend(rows.inputFiles()) or plain(rows))
    old = {r["path"] for r in spark.read.schema(user_cache.MANIFEST).parquet(f"{root}/manifest").collect()}
    out, read = user_cache.refresh(spark, pattern, root, 3)
    name = lambda path: path.rsplit("/", 1)[-1]
    assert read == 2 and len(taken) == 2 and not {name(p) for p in taken} & {name(p) for p in old}
    assert result(out) == result(user_beta(first.unionByName(second), 3))
    out, read = user_cache.refresh(spark, pattern, root, 3)
    assert read == 0 and result(out) == result(user_beta(first.unionByName(second), 3))
    gone = sorted((tmp_path / "in").glob("*.parquet"))[0]
    gone.unlink()
    left = spark.read.parquet(f"{tmp_path}/in")
    out, read = user_cache.refresh(spark, pattern, root, 3)
    assert read == 4 and result(out) == result(user_beta(left, 3))


def cell(rng, depth=0):
    kind = rng.randint(0, 9 if depth < 3 else 5)
    if kind == 0:
        return rng.choice([None, True, False])
    if kind == 1:
        return rng.randint(-10**12, 10**12)
    if kind == 2:
        return rng.choice([0.5, -1e-9, 1e300, 3.0])
    if kind <= 5:
        return "".join(rng.choice("ab'\"\\\n\té, :{}[]None") for _ in range(rng.randint(0, 8)))
    if kind <= 7:
        return [cell(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return {f"k{m}'": cell(rng, depth + 1) for m in range(rng.randint(0, 3))}


def test_literal_cells(spark):
    rng = random.Random(6)
    values = [[cell(rng) for _ in range(rng.randint(0, 4))] if k % 2 else {"a": cell(rng), 'b"': cell(rng)} for k in range(400)]
    for v in values:
        for text in (repr(v), json.dumps(v)):
            assert json.loads(to_json_text(text)) == v
        assert json.loads(to_json_text(repr(v))) == ast.literal_eval(repr(v))
    assert json.loads(to_json_text("(1, (2, 'x'))")) == [1, [2, "x"]] and json.loads(to_json_text("{1: 'x', None: 2}")) == {"1": "x", "null": 2}
    for bad in (None, "", " None ", "NaN", "null", "not json", "[1, 2", "__import__('os')", "[x for x in y]", "{1, 2}", "'text'", "3", "[" * 5000, "[b'x']"):
        assert to_json_text(bad) is None
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(["[1, 2]", "[1, None]", "{'a': 'it\\'s'}", '{"a": "x"}', "bad", None, "nan"])], "id long, c string").repartition(3)
    got = {r["id"]: r["j"] for r in with_json(rows, "c", "j").collect()}
    assert {k: None if v is None else json.loads(v) for k, v in got.items()} == {0: [1, 2], 1: [1, None], 2: {"a": "it's"}, 3: {"a": "x"}, 4: None, 5: None, 6: None}


def test_clusters_are_fixed_points(spark):
    rng = np.random.default_rng(3)
    means = [(0, 0, 9), (8, 0, 0), (0, 9, 0)]
    rows = [(int(k), *[float(v) for v in rng.normal(means[k % 3], 0.5)]) for k in range(300)] + [(900, None, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "user_id long, a double, b double, c double")
    vectors = clusters.standardised(df, "user_id", ["a", "b", "c"])
    got, centres = clusters.k_means(vectors, "user_id", 3)
    again, same = clusters.k_means(vectors.repartition(7), "user_id", 3)
    named = {r["user_id"]: r["cluster"] for r in got.collect()}
    assert named == {r["user_id"]: r["cluster"] for r in again.collect()} and np.allclose(centres, same)
    assert len({named[k] for k in range(3)}) == 3 and all(named[k] == named[k % 3] for k in range(300))
    points = {r["user_id"]: np.array(r["v"]) for r in vectors.collect()}
    for k, v in points.items():
        assert named[k] == int(((centres - v) ** 2).sum(axis=1).round(12).argmin())
    for c in range(3):
        assert np.allclose(centres[c], np.mean([points[k] for k in points if named[k] == c], axis=0), atol=1e-6)
    few, centres = clusters.k_means(vectors.where("user_id in (0, 3)").withColumn("v", F.array(F.lit(1.0), F.lit(2.0))), "user_id", 3)
    assert len(centres) == 1 and {r["cluster"] for r in few.collect()} == {0}
    assert clusters.k_means(vectors.limit(0), "user_id", 3)[0].count() == 0


def test_one_head_is_a_plain_logistic_fit():
    rng = np.random.default_rng(5)
    dense = rng.normal(size=(80, 12)) * (rng.random((80, 12)) < 0.4)
    dense[7] = 0
    y, w = (rng.random(80) < 1 / (1 + np.exp(-2 * dense[:, 0]))).astype(float), rng.integers(1, 4, 80).astype(float)
    index = [np.flatnonzero(r) for r in dense]
    x = logistic_heads.Rows(np.concatenate([[0], np.cumsum([len(i) for i in index])]), np.concatenate(index), np.concatenate([r[i] for r, i in zip(dense, index, strict=True)]), 14)
    coefficients, intercept, _, gradient = logistic_heads.fit_one(x, y, w, 1e-2)
    assert gradient < 1e-8 and (coefficients[12:] == 0).all()
    # Newton steps on the same loss
    m, beta = np.column_stack([dense, np.ones(80)]), np.zeros(13)
    penalty = np.diag([1e-2] * 12 + [0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-m @ beta))
        share = w / w.sum()
        beta -= np.linalg.solve(m.T @ (m * (share * p * (1 - p))[:, None]) + penalty, m.T @ (share * (p - y)) + penalty @ beta)
    assert np.allclose(np.append(coefficients[:12], intercept), beta, atol=1e-6)


def test_many_heads_in_one_job(spark):
    rng = np.random.default_rng(8)
    rows = [(f"r{k}", float(rng.integers(0, 2)), 1.0, sorted({int(i) for i in rng.integers(0, 9, 3)})) for k in range(60)] + [("r60", 1.0, 1.0, [])]
    df = spark.createDataFrame([(k, y, w, i, [1.0] * len(i)) for k, y, w, i in rows], "id string, y double, weight double, index array<int>, value array<double>")
    members = df.select(F.explode(F.array(F.lit("all"), F.concat(F.lit("h"), F.substring("id", 2, 1)))).alias("head"), "id").unionByName(df.where("y = 1").select(F.lit("onesided").alias("head"), "id"))
    heads = members.select("head").distinct()
    fitted = logistic_heads.fit_heads(df, members, heads, "id", 9)
    got = {(r["head"], r["feature"]): r["coefficient"] for r in fitted.collect()}
    assert not any(h == "onesided" for h, _ in got) and {h for h, _ in got} >= {"all", "h1", "h2"}
    chosen = {h: [r for r in rows if h == "all" or h == f"h{r[0][1]}"] for h in ("all", "h1")}
    for h, mine in chosen.items():
        x = logistic_heads.Rows(np.concatenate([[0], np.cumsum([len(r[3]) for r in mine])]), np.array([i for r in mine for i in r[3]]), np.ones(sum(len(r[3]) for r in mine)), 9)
        coefficients, intercept, _, _ = logistic_heads.fit_one(x, np.array([r[1] for r in mine]), np.ones(len(mine)))
        assert got[h, -1] == pytest.approx(intercept, abs=1e-6) and all(got.get((h, k), 0.0) == pytest.approx(c, abs=1e-6) for k, c in enumerate(coefficients))
    p = {(r["head"], r["id"]): r["p"] for r in logistic_heads.predict(df, members, fitted, "id").collect()}
    assert p["all", "r60"] == pytest.approx(1 / (1 + np.exp(-got["all", -1]))) and len(p) == members.join(fitted.select("head").distinct(), "head").count()
    z = got["all", -1] + sum(got.get(("all", i), 0.0) for i in rows[0][3])
    assert p["all", "r0"] == pytest.approx(1 / (1 + np.exp(-z)))
    assert logistic_heads.bounded(df, "id", 60).count() < 61
