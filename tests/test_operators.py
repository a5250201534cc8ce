"""Operators on small hand-made tables."""

import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from prefgraph.functions import labels
from prefgraph.functions.labels import response_id, safe_double, sign_and_weight
from prefgraph.functions.ranking import distributed_rank
from prefgraph.operators import cycles, logistic_heads, models, ordering, projection, resample, scopes, summaries, text_model
from prefgraph.operators import tournament as t
from prefgraph.operators.edges import user_edge_flow as user_flow
from prefgraph.operators.flatten import observations, with_signs
from prefgraph.operators.pairs import opening_pairs
from prefgraph.plans import comparisons, inference, tournaments
from prefgraph.sources import scans


def edges(spark, rows):
    return spark.createDataFrame([("s", *r) for r in rows], "scope string, i string, j string, margin double, support double")


def test_labels(spark):
    raw = ["A-is-clearly-better", "A is slightly better", "Tie", "B-is-slightly-better", "B_is_clearly_better", "response-1", "response-2", "0", "1", "2", "", None]
    s = sign_and_weight(F.col("x"))
    got = [tuple(r) for r in spark.createDataFrame([(k, x) for k, x in enumerate(raw)], "k int, x string").orderBy("k").select(s["sign"], s["weight"]).collect()]
    assert got == [(1, 1.0), (1, 0.5), (0, 0.0), (-1, 0.5), (-1, 1.0), (1, 1.0), (-1, 1.0), (1, 1.0), (-1, 1.0), (0, 0.0), (0, 0.0), (0, 0.0)]


def test_response_id_and_numbers(spark):
    row = spark.range(1).select(response_id(F.lit("p"), "A", F.lit("abc")).alias("a"), safe_double(F.lit("x")).alias("b"), safe_double(F.lit("NaN")).alias("c"), safe_double(F.lit("1.5")).alias("d")).first()
    assert tuple(row) == ("p::A_a9993e364706", None, None, 1.5)


def test_observations_are_canonical(spark):
    base = {f"{a}_pref": "Tie" for a in ("helpful", "truthful", "harmless")}
    rows = [{"prompt_id": 1, "alt_a": "y", "alt_b": "x", "overall_pref": "A-is-clearly-better", **base}, {"prompt_id": 1, "alt_a": "x", "alt_b": "x", "overall_pref": "A-is-clearly-better", **base}, {"prompt_id": 2, "alt_a": "x", "alt_b": "y", "overall_pref": "Tie", **base}]
    got = [tuple(r) for r in observations(with_signs(spark.createDataFrame(rows)), ["prompt_id"]).collect()]
    assert got == [(1, "overall", "x", "y", -1, 1.0)]


def test_triangle_of_a_pure_cycle_and_of_scores(spark):
    ring = cycles.triplet_residual(edges(spark, [("a", "b", 1.0, 2.0), ("b", "c", 1.0, 2.0), ("a", "c", -1.0, 2.0)]), ["scope"]).first()
    assert ring["rho"] == pytest.approx(1) and ring["cyclic"]
    s = {"a": 1.5, "b": 0.25, "c": -0.5, "d": -1.25}
    flat = projection.graph_projection(edges(spark, [(x, y, s[x] - s[y], 1.0 + k) for k, (x, y) in enumerate(combinations("abcd", 2))]), ["scope"]).first()
    assert flat["rho"] < 1e-9 and flat["gradient_norm"] < 1e-6


def test_graph_projection_equals_least_squares(spark):
    rng = np.random.default_rng(3)
    names = "abcdef"
    rows = [(x, y, float(rng.uniform(-1, 1)), float(rng.integers(1, 30))) for x, y in combinations(names, 2)]
    got = projection.graph_projection(edges(spark, rows), ["scope"], 120).first()
    a = np.array([[math.sqrt(w) * ((n == x) - (n == y)) for n in names] for x, y, _, w in rows])
    b = np.array([math.sqrt(w) * m for _, _, m, w in rows])
    fit = a @ np.linalg.lstsq(a, b, rcond=None)[0]
    assert got["residual_energy"] == pytest.approx(((b - fit) ** 2).sum(), rel=1e-7)
    assert got["gradient_energy"] + got["residual_energy"] == pytest.approx(got["total_energy"], rel=1e-6)


def test_margin_and_support_rules_differ(spark):
    e = edges(spark, [("a", "b", 0.5, 9.0), ("b", "c", 0.05, 9.0), ("a", "c", -0.5, 9.0)])
    assert cycles.margin_cycle_stats(e, ["scope"], 1, 0.1).first()["eligible"] == 0
    grid = {r["tau"]: (r["eligible_triples"], r["cyclic_triples"]) for r in cycles.support_cycle_grid(e, ["scope"], [1], [0.0, 0.1]).collect()}
    assert grid == {0.0: (1, 1), 0.1: (1, 0)}
    best = cycles.strongest_cycles(e, ["scope"], 1, 5).first()
    assert (best["model_1"], best["model_2"], best["model_3"]) == ("a", "b", "c")


def tournament(spark, beats, n):
    return spark.createDataFrame([("s", i, j, bool(beats[i][j])) for i, j in combinations(range(n), 2)], "scope string, i int, j int, beats boolean")


@pytest.mark.parametrize("seed", range(3))
def test_tournament_identities(spark, seed):
    n = 6
    rng = np.random.default_rng(seed)
    b = [[False] * n for _ in range(n)]
    for i, j in combinations(range(n), 2):
        b[i][j] = bool(rng.integers(2))
        b[j][i] = not b[i][j]
    cyclic = {c for c in combinations(range(n), 3) if b[c[0]][c[1]] == b[c[1]][c[2]] == b[c[2]][c[0]]}
    odd = sum(sum(x in cyclic for x in combinations(q, 3)) % 2 for q in combinations(range(n), 4))
    frame = tournament(spark, b, n)
    assert t.condorcet_count(frame, ["scope"], n).first()["cycles"] == len(cyclic)
    assert t.odd_parity(frame, ["scope"]).first()["odd_parity"] == odd
    assert odd <= (n - 3) * len(cyclic)


def test_ring_has_a_hole_and_order_has_none(spark):
    ring = tournament(spark, [[0, 1, 0], [0, 0, 1], [1, 0, 0]], 3)
    order = tournament(spark, [[0, 1, 1, 1], [0, 0, 1, 1], [0, 0, 0, 1], [0] * 4], 4)
    r, o = t.betti_1(ring, ["scope"], 3).first(), t.betti_1(order, ["scope"], 4).first()
    assert (r["acyclic"], r["betti_1"], o["betti_1"]) == (0, 1, 0)


def test_only_winner_edges(spark):
    rows = [(1, 7, "a", 10.0, 1), (1, 7, "b", 10.0, 2), (1, 7, "c", 4.0, 3), (2, 8, "a", 9.0, 1), (2, 8, "b", 1.0, 2)]
    got = opening_pairs(spark.createDataFrame(rows, "conversation_id int, user_id int, model_name string, score double, pos int"), [0.0])
    assert {(r["conversation_id"], r["is_winner_edge"]) for r in got.collect()} == {(1, False), (2, True)}


def test_bt_triplet_has_no_gradient(spark):
    row = spark.createDataFrame([(8.0, 2.0, 5.0, 5.0, 9.0, 0.0)], "w_ij double, l_ij double, w_jk double, l_jk double, w_ik double, l_ik double")
    got = models.bt_triplet(row).first()
    assert got["gradient_norm"] < 1e-9 and got["score_i"] + got["score_j"] + got["score_k"] == pytest.approx(0) and got["score_i"] > got["score_j"]


def test_bt_graph_recovers_scores(spark):
    s = {"a": 0.8, "b": 0.1, "c": -0.9}
    e = edges(spark, [(x, y, 2 / (1 + math.exp(s[y] - s[x])) - 1, 50.0) for x, y in combinations("abc", 2)])
    got = {r["node"]: r["theta"] for r in models.bt_graph(e, ["scope"]).collect()}
    assert all(got[k] == pytest.approx(v, abs=1e-3) for k, v in s.items())


def test_metric_orientation(spark):
    rows = spark.createDataFrame([(1, "x", "y", 1, 1.0, True, 0.9), (2, "x", "y", 1, 1.0, False, 0.1), (3, "x", "y", 1, 1.0, True, 0.5)], "g int, i string, j string, sign int, weight double, a_is_i boolean, p_a double")
    got = {r["g"]: (r["straight_error"], r["flipped_majority_error"]) for r in models.prediction_metrics(rows, ["g"]).collect()}
    assert got == {1: (0.0, 1.0), 2: (0.0, 1.0), 3: (0.5, 0.5)}


def test_q_values(spark):
    rows = spark.createDataFrame([(1, 0.01), (1, 0.04), (1, 0.03), (1, 0.20), (1, None)], "g int, p double")
    got = {r["p"]: r["q"] for r in summaries.bh_q(rows, ["g"], "p").collect()}
    assert got[None] is None and [round(got[p], 5) for p in (0.01, 0.04, 0.03, 0.2)] == [0.04, 0.05333, 0.05333, 0.2]


def test_rank_and_permutation_keep_sizes(spark):
    users = spark.createDataFrame([(k, "ab"[k % 3 == 0]) for k in range(60)], "user_id int, country string")
    dealt = resample.permuted_groups(users, "country", 3, 5)
    sizes = {(r["rep"], r["country"]): r["count"] for r in dealt.groupBy("rep", "country").count().collect()}
    assert sizes == {(rep, c): n for rep in range(3) for c, n in (("a", 40), ("b", 20))}
    assert dealt.groupBy("rep").agg(F.count_distinct("user_id").alias("n")).where("n <> 60").count() == 0
    ranked = distributed_rank(users.withColumn("k", F.lit(1)), ["k"], F.crc32(F.col("user_id").cast("string").cast("binary")), "user_id")
    assert sorted(r["rank"] for r in ranked.collect()) == list(range(1, 61))


def test_bootstrap_support_counts_draws(spark):
    ue = spark.createDataFrame([(u, "a", "b", 1.0) for u in range(20)], "user_id int, i string, j string, um double")
    assert {(r["margin"], r["support"]) for r in resample.user_bootstrap(ue, 4, 1).collect()} == {(1.0, 20)}


def test_binomial_draws_agree_between_runs(spark):
    rows = spark.range(200).select("id", F.lit(100).alias("n"), F.lit(0.3).alias("p"))
    draw = lambda: {r["id"]: r["wins"] for r in resample.binomial(rows, "n", "p", [F.col("id")], 9).collect()}
    first = draw()
    assert first == draw() and abs(sum(first.values()) / 200 - 30) < 1.5


def test_partial_beta_of_a_plane(spark):
    rng = np.random.default_rng(0)
    x, z = rng.normal(size=80), rng.normal(size=80)
    rows = spark.createDataFrame([("s", float(a), float(b), float(2 * a - b)) for a, b in zip(x, z)], "g string, x double, z double, y double")
    got = summaries.partial_beta(rows, ["g"], "y", ["x", "z"]).first()
    y = 2 * x - z
    assert got["beta_x"] == pytest.approx(2 * x.std() / y.std()) and got["beta_z"] == pytest.approx(-z.std() / y.std())


def test_dirty_csv(spark, tmp_path):
    (tmp_path / "r.csv").write_text("UserID,Saved,Man,Other\n1,1,2,z\n2,0,1,z\n3,2,1,z\n4,1,x,z\n5,,1,z\n6,1,0,z\n7,0,3,z\n")
    got = scans.scan_csv(spark, str(tmp_path / "r.csv"), ["UserID", "Saved", "Man"], {"UserID": "long", "Saved": "int", "Man": "int"}, "Saved in (0, 1)")
    assert sorted(r["UserID"] for r in got.collect()) == [1, 2, 6, 7] and dict(got.dtypes)["Man"] == "int"


def test_schema_resolution(spark):
    df = spark.createDataFrame([], "Prompt_ID string, x int, r struct<Text: string, meta: struct<model: string, x: int>>")
    assert scans.required(df.schema, ["prompt_id"]) == "Prompt_ID" and scans.locate(df.schema, ["x", "model"], 3) == ["x", "r.meta.x", "r.meta.model"]
    with pytest.raises(ValueError, match="no field named y"):
        scans.required(df.schema, ["y"])
    rows = spark.createDataFrame([((None, ("m1", " ")), "r1"), (("m2", ("m1", "q")), " "), ((None, None), None)], "r struct<model_id: string, meta: struct<model: string, source: string>>, t string")
    assert [tuple(x) for x in rows.select(scans.model_id(rows, "r"), scans.model_id(rows, "t")).collect()] == [("m1", "r1"), ("m1", None), (None, None)]
    roles = lambda rs: scans.placeholder_models(spark.createDataFrame(rs, "m string, n string"), "m", "n").first()["placeholder"]
    assert roles([("Response A", "response b"), (None, " 0")]) and not roles([]) and not roles([(None, None)]) and not roles([("a", "llama")])
    df = scans.with_defaults(spark.createDataFrame([("a", "B")], "m string, n string"), {"w": 1.0})
    assert df.first()["w"] == 1.0 and scans.placeholder_models(df, "m", "n").first()["placeholder"]


def test_shards_and_scopes(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "v int, scope string")
    scans.write_scoped(df, str(tmp_path / "o"), "scope", "csv")
    assert sorted(p.name for p in (tmp_path / "o").glob("scope=*")) == ["scope=a", "scope=b"]
    assert "| 1 | a |" in scans.markdown(df)
    with pytest.raises(ValueError):
        scans.markdown(df, 1)


def test_shards_are_joined_by_name(spark, tmp_path):
    for name, text in (("s0", "x,y\n1,2\n"), ("s1", "y,z\n8,9\n"), ("s2", "y,x\n4,3\n"), ("s3", ""), ("s4", "x,y\n")):
        (tmp_path / f"{name}.csv").write_text(text)
    got = scans.read_shards(spark, f"{tmp_path}/*.csv")
    assert {(r["source_file"][-6:-4], r["x"], r["y"], r["z"]) for r in got.collect()} == {("s0", "1", "2", None), ("s1", None, "8", "9"), ("s2", "3", "4", None)}


def test_labels_of_every_spelling(spark):
    want = {"A-is-clearly-better": 1, "A_clearly_better": 1, "clearly a": 1, "a": 1, " A ": 1, "response-a": 1, "option_a": 1, "LEFT": 1, "0": 1, "response-0": 1, "Response 1": 1, "0.0": 1, "a-is-slightly-better": 0.5, "slightly-a": 0.5, "a-slightly-better": 0.5, "answer-a-better": 1, "a-somewhat-better": 1, "a-slightly-much-better": 0.5}
    want |= {"B-is-clearly-better": -1, "clearly-b": -1, "b": -1, "response-b": -1, "option-b": -1, "right": -1, "1": -1, "response-2": -1, "1.0": -1, "b-is-slightly-better": -0.5, "slightly-b": -0.5, "answer-b-better": -1}
    want |= {"tie": 0, "": 0, "both": 0, "model-a": 0, "a>b": 0, "better": 0, "2": 0, "bad": 0}
    rows = spark.createDataFrame([(k,) for k in want] + [(None,)], "label string")
    got = {r["label"]: r["s"]["sign"] * r["s"]["weight"] for r in rows.select("label", labels.sign_and_weight(F.col("label")).alias("s")).collect()}
    assert got == want | {None: 0}


def test_numbered_rows_and_display_names(spark):
    rows = spark.range(1000).selectExpr("id * 7 % 1000 as k").repartition(5)
    assert [(r["k"], r["n"]) for r in ordering.numbered(rows, "k", "n", ranges=8).orderBy("k").collect()] == [(k, k) for k in range(1000)]
    names = spark.createDataFrame([("a b",), ("x",), ("a bc d",)], "t string").select(scopes.display_name(F.col("t"), {"x": "Ex"}))
    assert [r[0] for r in names.collect()] == ["B", "Ex", "D"]


def test_invariants_play_every_alternative(spark, monkeypatch):
    rng = np.random.default_rng(3)
    names = [f"Brand#{a}{b}" for a in range(1, 6) for b in range(1, 6)]
    rows = [(u, "FR", int(rng.random() < 0.7), names[rng.integers(25)], int(rng.integers(1, 4)), 100 * u + k) for u in range(30) for k in range(40)]
    frame = spark.createDataFrame(rows, "user_id int, country string, saved int, alternative string, cnt long, row_key long")
    monkeypatch.setattr(tournaments, "derived", lambda *_: frame)
    beta = np.zeros((30, 25))
    for u, _, saved, name, cnt, _ in rows:
        beta[u, names.index(name)] += cnt if saved else -cnt
    d = beta[:, :, None] - beta[:, None, :]
    more = (d > 0).sum(0) - (d < 0).sum(0)
    beats = lambda i, j: more[i, j] >= 0 if i < j else more[j, i] < 0
    cyclic = {c for c in combinations(range(25), 3) if beats(c[0], c[1]) == beats(c[1], c[2]) == beats(c[2], c[0])}
    odd = sum(sum(c in cyclic for c in combinations(q, 3)) % 2 for q in combinations(range(25), 4))
    got = tournaments.invariants(spark, "").first()
    assert (got["complete"], got["triples"], got["cycles"], got["odd_parity"]) == (True, 2300, len(cyclic), odd) and odd > 0
    assert tournaments.full_betti(spark, "").first()["acyclic"] == 2300 - len(cyclic)
    monkeypatch.setattr(tournaments, "derived", lambda *_: frame.limit(0))
    assert tournaments.invariants(spark, "").count() == 0


def test_text_features_go_beyond_frequent_words(spark):
    common = " ".join(f"c{k} " * 3 for k in range(80))
    rows = [(2 * k + g, f"{common} good{k // 2} rarely" if g else f"{common} bad{k // 2}") for k in range(30) for g in (0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    vectors = text_model.tfidf(docs, "doc_id", "text")
    numbers = text_model.term_numbers(vectors)
    assert {"good1", "bad2", "rarely"} <= {r["term"] for r in numbers.collect()} and numbers.count() > 180
    pairs = spark.createDataFrame([(f"p{k}", 2 * k + k % 2, 2 * k + 1 - k % 2, float(k % 2), 1.0) for k in range(30)] + [("none", 900, 901, 1.0, 1.0)], "pair_id string, id_a long, id_b long, y double, w double")
    feats = text_model.difference_rows(pairs, vectors, numbers)
    x = {(r["doc_id"], r["term"]): r["x"] for r in vectors.collect()}
    at = {r["term"]: r["number"] for r in numbers.collect()}
    got = {r["pair_id"]: dict(zip(r["index"], r["value"], strict=True)) for r in feats.collect()}
    want = {t: x.get((3, t), 0.0) - x.get((2, t), 0.0) for t in at}
    assert all(got["p1"].get(at[t], 0.0) == pytest.approx(v, abs=1e-12) for t, v in want.items()) and got["none"] == {}
    rows = feats.join(pairs.select("pair_id", "y", F.col("w").alias("weight")), "pair_id")
    members = rows.select(F.lit("all").alias("head"), "pair_id")
    head = logistic_heads.fit_heads(rows, members, members.select("head").distinct(), "pair_id", len(at))
    p = {r["pair_id"]: r["p"] for r in logistic_heads.predict(rows, members, head, "pair_id").collect()}
    y = {r["pair_id"]: r["y"] for r in pairs.collect()}
    assert len(p) == 31 and all((q > 0.5) == (y[k] > 0.5) for k, q in p.items() if k != "none")


def test_transitive_null_draws_as_often_as_the_reference(spark, monkeypatch):
    flow = spark.createDataFrame([(5, "a", "b", 0.2, 40), (5, "a", "c", -0.4, 30), (5, "b", "c", 0.3, 50)], "score_delta int, i string, j string, margin double, support long")
    monkeypatch.setattr(comparisons, "user_edges", lambda *_: flow)
    assert len({r["rep"] for r in inference.transitive(spark, "").select("rep").collect()}) == 200


@pytest.mark.parametrize("turned, flipped", [(False, False), (True, False), (False, True)])
def test_row_metrics_in_every_orientation(spark, turned, flipped):
    """Rows whose A is i or j and a predictor that is right or turned around: error and sanity metrics tell which."""
    data = []
    for a_is_i in (True, True, False):  # i wins every row
        row_sign = 1 if a_is_i else -1
        p = 0.9 if a_is_i != flipped else 0.1
        data.append(("k", "x", "y", a_is_i, 2.0, -1 if turned else 1, row_sign, p))
    frame = spark.createDataFrame(data, "k string, i string, j string, a_is_i boolean, weight double, sign int, row_sign int, p_a double")
    m = models.row_metrics(frame, ["k"]).first()
    assert m["n_obs"] == 3 and m["edges"] == 1 and m["weight"] == 6.0
    assert m["error_rate"] == (1.0 if flipped else 0.0) == 1 - m["flipped_error_rate"] == 1 - m["accuracy"]
    assert m["target_mismatch"] == (1.0 if turned else 0.0)
    assert m["majority_error"] == (1.0 if turned != flipped else 0.0) == 1 - m["flipped_majority_error"]
    assert abs(m["log_loss"] + math.log(0.1 if flipped else 0.9)) < 1e-12 and abs(m["brier"] - (0.81 if flipped else 0.01)) < 1e-12


def test_user_flow_rounds_exact_halves_one_way(spark):
    """Seven users at a seventh and 121 at none make 1/128 = 0.0078125, an exact half at six places, however the rows lie."""
    rows = [(u, "x", "y", s) for u in range(7) for s in (1, 1, 1, 1, -1, -1, -1)] + [(u, "x", "y", s) for u in range(7, 128) for s in (1, -1)]
    rows += [(u, "y", "z", -s) for u, _, _, s in rows]
    for parts in (1, 3, 7):
        flow = user_flow(spark.createDataFrame(rows, "user_id long, i string, j string, pair_sign int").repartition(parts), [])
        got = {r["i"]: tuple(r)[1:] for r in flow.select("i", "margin", F.round("margin", 6), "support", "total_observations").collect()}
        assert got == {"x": (0.0078125, 0.007813, 128, 291), "y": (-0.0078125, -0.007813, 128, 291)}
