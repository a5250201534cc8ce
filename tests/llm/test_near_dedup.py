"""Near duplicates against all pairs."""

import random

import numpy as np

from prefgraph.llm import near_dedup


def brute(rows, percent=85):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if both and 100 * both >= percent * len(sets[x] | sets[y]):
                parent[top(x)] = top(y)
    out = []
    for k, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if top(j) == top(k) and rows[j][0] is not None]
        c = min(ids) if ids and sets[k] else d
        out.append((str(d), len(sets[k]), str(c), str(d) == str(c)))
    return sorted(out)


def crowd(rng, n, edits):
    """Texts that differ from one original in up to ``edits`` words each."""
    base = [f"w{k}" for k in range(60)]
    out = []
    for k in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def check(spark, rows):
    frame = spark.createDataFrame([(d, t, 1, True) for d, t in rows], "doc_id long, text string, component_id int, kept boolean")
    got = near_dedup.near_duplicates(frame).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["kept"]) for r in got) == brute(rows)


def test_all_links_are_found(spark):
    rng = random.Random(4)
    rows = [(k, t) for k, t in enumerate(crowd(rng, 160, 3))]
    long = " ".join(f"v{rng.randrange(10**6)}" for _ in range(3000))
    rows += [(1000, long), (1001, long + " and more"), (1002, long.upper()), (1003, "a b"), (1004, "A B"), (1005, "a b c"), (1006, ""), (1007, None), (1008, " \n"), (1009, "one two three four five"), (1010, "one two  three four FIVE"), (None, long), (None, "alone here now"), (1003, "a b"), (1011, "é É " * 10), (1012, "É é " * 10)]
    check(spark, rows)


def test_rounds_of_few_pivots(spark, monkeypatch):
    """A crowd whose members are mostly below the threshold to each other, so that buckets stay divided for rounds."""
    monkeypatch.setattr(near_dedup, "PIVOTS", 6)
    monkeypatch.setattr(near_dedup, "FIRST", 1)
    rng = random.Random(11)
    check(spark, list(enumerate(crowd(rng, 40, 4))))


def test_a_large_group_makes_few_links(spark, monkeypatch):
    """The edges that components are found from stay a few times the group's size, whatever bands its members share."""
    seen, real = [], near_dedup.components
    monkeypatch.setattr(near_dedup, "components", lambda links: seen.append(links.count()) or real(links))
    rng, base = random.Random(12), [f"w{k}" for k in range(200)]
    rows = [(k, " ".join(w if j != rng.randrange(200) else f"z{k}" for j, w in enumerate(base)) + f" end{k}") for k in range(300)]
    check(spark, rows)
    assert max(seen) < 3 * 300


def test_a_crowd_below_the_threshold_makes_few_pairs(spark, monkeypatch):
    """Texts with two words of their own each, near their common original and not each other: pairs that aren't links aren't made."""
    made, real = spark.sparkContext.accumulator(0), near_dedup._confirm

    def counted(percent):
        def run(batches, confirm=real(percent)):
            def seen():
                for batch in batches:
                    made.add(batch.num_rows)
                    yield batch

            return confirm(seen())

        return run

    monkeypatch.setattr(near_dedup, "_confirm", counted)
    rng, rows = random.Random(13), []
    for k in range(200):
        words = [f"w{j}" for j in range(200)]
        for j in rng.sample(range(5, 195), 2):
            words[j] = f"z{k}x{j}"
        rows.append((k, " ".join(words)))
    check(spark, rows)
    assert made.value < 10 * 200  # 14,467 when sketches alone kept pairs apart


def test_least_hashes_bound_the_similarity(spark):
    """Exact for short sets; of longer ones no pair at the threshold is lost."""
    rng, rows = np.random.default_rng(9), []
    for n, both in ((100, 85), (100, 84), (5000, 4250), (5000, 3500)):
        u = rng.integers(-(2**63), 2**63 - 1, n)
        a, b = (np.sort(x)[: near_dedup.LEAST].tolist() for x in (u[: both + (n - both) // 2], np.concatenate([u[:both], u[both + (n - both) // 2 :]])))
        rows.append((a, b))
    frame = spark.createDataFrame(rows, "a array<long>, b array<long>")
    assert [r[0] for r in frame.selectExpr(near_dedup.similar("a", "b", 85)).collect()] == [True, False, True, False]


def test_empty_table(spark):
    assert near_dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_chain_has_one_component(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "x long, y long")
    got = {r["node"]: r["component"] for r in near_dedup.components(links).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100}


def test_sketches_agree_as_often_as_sets():
    rng = np.random.default_rng(2)
    agree = []
    for _ in range(40):
        u = rng.integers(0, 2**63, 60, dtype=np.uint64)
        a, b = np.unique(u[:55]), np.unique(u[5:])
        agree.append((near_dedup.sketch(a) == near_dedup.sketch(b)).mean())
    assert abs(np.mean(agree) - 50 / 60) < 0.03


def test_lower_thresholds_find_all_links(spark):
    rng = random.Random(6)
    rows = [(k, t) for k, t in enumerate(crowd(rng, 80, 3))]
    for g in range(60):
        w = [f"g{g}x{k}" for k in range(60)]
        rows += [(1000 + 2 * g, " ".join(w)), (1001 + 2 * g, " ".join([*w[:30], "other", *w[31:]]))]  # 51 of 61 shingles
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for percent in (80, 70):
        got = near_dedup.near_duplicates(frame, percent=percent).collect()
        assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["kept"]) for r in got) == brute(rows, percent)


def test_limits_follow_the_threshold():
    assert [near_dedup.bands_for(p) for p in (85, 80, 100)] == [25, 37, 1] and near_dedup.agree_for(85) == 902
    rng = np.random.default_rng(5)
    for percent in (70, 80, 85):
        n, lost = 2000, 0
        both = n * percent // 100
        for _ in range(100):
            u = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2)
            a, b = (np.sort(x) for x in (u[: both + (n - both) // 2], np.concatenate([u[:both], u[both + (n - both) // 2 :]])))
            x, y = (np.array(near_dedup.one_bits(h), np.int64).view(np.uint8) for h in (a, b))
            lost += near_dedup.BITS - np.unpackbits(x ^ y).sum() < near_dedup.agree_for(percent)
        assert lost == 0


def test_pipeline_drops_copies_from_four_fifths_on(spark):
    import corpus_pipeline

    w = [f"w{k}" for k in range(60)]
    docs = spark.createDataFrame([(1, " ".join(w)), (2, " ".join([*w[:30], "other", *w[31:]])), (3, "quite another text")], "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.without_copies(spark, docs, "").collect()} == {1, 3}


def test_pipeline_tells_rows_of_one_id_apart(spark):
    """Copies go under whatever id they come, other texts of that id stay, and near copies of one id are one."""
    import corpus_pipeline

    t, u, v = (" ".join(f"{c}{k}" for k in range(60)) for c in "tuv")
    near = " ".join(["changed", *v.split()[1:]])
    rows = [(3, t), (5, u), (5, t), (3, t), (7, v), (7, near), (None, t), (None, "no id " * 9), (None, "no id " * 9), (8, None), (8, ""), (9, "")]
    docs = spark.createDataFrame([(d, x, 1, 2) for d, x in rows], "doc_id long, text string, component long, text_key int").repartition(3)
    got = corpus_pipeline.without_copies(spark, docs, "")
    kept = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in got.collect()))
    assert got.columns == docs.columns
    assert [k[:2] for k in kept] == [(False, 3), (False, 5), (False, 7), (False, 8), (False, 8), (False, 9), (True, 0)]
    assert {k[2] for k in kept if k[1] in (3, 5)} == {t, u} and kept[2][2] in (v, near)
