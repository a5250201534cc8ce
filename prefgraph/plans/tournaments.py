"""Scenario choices: user utilities, country tournaments, invariants, latent profiles, dirty scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefgraph.operators import tournament as t
from prefgraph.operators.ordering import kept
from prefgraph.operators.projection import graph_projection
from prefgraph.sources import scans
from prefgraph.sources.fixtures import CHARACTER_ROWS, DIMENSION_ROWS, derived, plain, table

MIN_SCENARIOS, MIN_USERS = 8, 20
DIMS = ["d_intervention", "d_number", "d_law", "d_status", "d_species", "d_age"]
#: Fifty profiles of -1, 0 and 1 from the ternary digits of multiples of 37 modulo a prime.
PROFILES = [[float(37 * (p + 1) % 727 // 3**k % 3 - 1) for k in range(len(DIMS))] for p in range(50)]


def beta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.user_beta(derived(spark, sf_dir, CHARACTER_ROWS), MIN_SCENARIOS)


def brands(spark: SparkSession, sf_dir: str) -> list[str]:
    """All brands of the parts in code-point order: the alternatives, whether anybody chose them or not."""
    return t.alternatives_of(table(spark, sf_dir, "part").select(F.col("p_brand").alias("alternative")))


def country_users(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """Users of eligible countries with a value for every brand, and how many brands there are."""
    rows = kept(beta(spark, sf_dir), "user-beta")  # summed once, for the users and for their countries
    names = brands(spark, sf_dir)
    return t.densified(rows, names).join(t.eligible_groups(rows, MIN_USERS).select("country"), "country"), len(names)


def country_wins(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    users, n = country_users(spark, sf_dir)
    return t.wins(users, n, ["country"]), n


def full_country_wins(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """Country tournaments over all alternatives of the data, and how many those are."""
    rows = beta(spark, sf_dir)
    names = t.alternatives_of(rows)
    users = t.densified(rows, names).join(t.eligible_groups(rows, MIN_USERS).select("country"), "country")
    return t.wins(users, len(names), ["country"]), len(names)


def full_betti(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, n = full_country_wins(spark, sf_dir)
    return t.betti_1(w, ["country"], n)


def latent_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.utilities(t.latent_beta(derived(spark, sf_dir, DIMENSION_ROWS), DIMS, 8, 4), PROFILES)


def latent_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.wins(latent_users(spark, sf_dir), len(PROFILES), ["country"])


def global_tournament(spark, sf_dir):
    """Pooled majorities of all users and of those in eligible countries, with ties and the least margin."""
    rows = kept(beta(spark, sf_dir), "user-beta")
    groups = t.eligible_groups(rows, MIN_USERS).select("country", F.lit(True).alias("_e"))
    names = brands(spark, sf_dir)
    users = t.densified(rows, names).join(groups, "country", "left")
    scoped = users.withColumn("scope", F.explode(F.when(F.col("_e"), F.array(F.lit("all"), F.lit("eligible"))).otherwise(F.array(F.lit("all")))))
    w = t.wins(scoped, len(names), ["scope"])
    return w.groupBy("scope").agg(F.count("*").alias("n_pairs"), F.count_if(F.abs("margin") <= 1e-8).alias("ties"), F.round(F.min(F.abs("margin")), 6).alias("min_abs_margin"), F.round(F.avg(F.abs("margin")), 6).alias("mean_abs_margin"), F.sum("support").alias("support"))


def invariants(spark, sf_dir):
    """All invariants of every country's tournament over all alternatives."""
    w, n = full_country_wins(spark, sf_dir)
    strict = t.strict_cycles(w, ["country"]).select("country", F.col("triples").alias("strict_triples"), F.col("cycles").alias("strict_cycles"))
    rho = graph_projection(w.where("support > 0"), ["country"]).select("country", F.round("rho", 5).alias("rho"))
    size = w.groupBy("country").agg((F.count("*") == n * (n - 1) // 2).alias("complete"))
    out = t.condorcet_count(w, ["country"], n).join(t.odd_parity(w, ["country"]), "country").join(size, "country").join(rho, "country", "left").join(strict, "country", "left")
    return out.select("country", "complete", "cycles", "triples", F.round("fraction", 6).alias("fraction"), "odd_parity", "obstructed", "rho", F.coalesce("strict_triples", F.lit(0)).alias("strict_triples"), F.coalesce("strict_cycles", F.lit(0)).alias("strict_cycles"))


def obstructed(spark, sf_dir):
    """Countries with a parity obstruction, and whether odd parity stays within (K - 3) times the cycles."""
    w, n = country_wins(spark, sf_dir)
    w = kept(w, "country-wins")  # 300 rows a country, read by both
    both = t.odd_parity(w, ["country"]).join(t.condorcet_count(w, ["country"], n), "country")
    return both.where("obstructed").select("country", "odd_parity", "cycles", (F.col("odd_parity") > (n - 3) * F.col("cycles")).alias("violates"))


def dirty_scan(spark, sf_dir):
    """Character rows as dirty text, scanned back: rows read and kept."""
    rows = derived(spark, sf_dir, CHARACTER_ROWS)
    spoilt = rows.select(
        F.col("user_id").cast("string").alias("user_id"), "country",
        F.when(F.col("row_key") % 37 == 0, F.lit("2")).otherwise(F.col("saved").cast("string")).alias("saved"),
        F.when(F.col("row_key") % 41 == 0, F.lit("x")).when(F.col("row_key") % 43 == 0, F.lit("")).otherwise(F.col("cnt").cast("string")).alias("cnt"),
    )
    return scans.kept_rows(spoilt, {"user_id": "long", "saved": "int", "cnt": "long"}, "saved in (0, 1)").groupBy("country").agg(F.count("*").alias("n_raw"), F.count_if("_valid").alias("n_kept"), F.sum(F.when(F.col("_valid"), F.col("cnt"))).alias("cnt"))


QUERIES = {
    "dirty_scan": dirty_scan,
    "user_beta": lambda s, d: beta(s, d).withColumn("beta", F.round("beta", 6) + 0.0),
    "eligible_groups": lambda s, d: t.eligible_groups(beta(s, d), MIN_USERS),
    "country_tournament": lambda s, d: country_wins(s, d)[0].withColumn("margin", F.round("margin", 6) + 0.0),
    "global_tournament": global_tournament,
    "condorcet_count": lambda s, d: (lambda w, n: t.condorcet_count(w, ["country"], n))(*country_wins(s, d)).withColumn("fraction", F.round("fraction", 6)),
    "odd_parity": lambda s, d: t.odd_parity(country_wins(s, d)[0], ["country"]),
    "invariant_bundle": invariants,
    "obstructed_groups": obstructed,
    "latent_beta": lambda s, d: t.latent_beta(derived(s, d, DIMENSION_ROWS), DIMS, 8, 4).select("user_id", "country", *[F.round(F.get("beta", F.lit(k)), 6).alias(n) for k, n in enumerate(DIMS)]),
    "latent_majority_cycles": lambda s, d: t.strict_cycles(latent_wins(s, d), ["country"]),
    "betti1": full_betti,
}

BETA_SQL = f"""rows0 as ({plain(CHARACTER_ROWS)}), u as (select user_id, sum(saved)::bigint as n_scenarios, arg_min(country, row_key) as country from rows0 group by 1 having sum(saved) >= {MIN_SCENARIOS}),
beta as (select r.user_id, u.country, alternative, n_scenarios, sum(case when saved = 1 then cnt else -cnt end)::double / n_scenarios as beta from rows0 r join u on r.user_id = u.user_id group by 1, 2, 3, 4)"""
_ELIG = f"elig as (select country, count(distinct user_id) as n_users from beta group by 1 having count(distinct user_id) >= {MIN_USERS} and country not in ('', 'NaN', 'UNK'))"
_ALTS = "alts as (select alternative, row_number() over (order by alternative) - 1 as a from (select distinct p_brand as alternative from part where p_brand is not null))"
DENSE_SQL = f"{BETA_SQL}, {_ELIG}, {_ALTS}, dense as (select u.user_id, u.country, a, coalesce(b.beta, 0) as beta from u cross join alts left join beta b on b.user_id = u.user_id and b.alternative = alts.alternative)"
_WIN = "count(*) filter (where x.beta > y.beta) as wins_i, count(*) filter (where x.beta < y.beta) as wins_j"
WINS_SQL = f"""{DENSE_SQL}, w0 as (select x.country, x.a as i, y.a as j, {_WIN} from dense x join dense y on x.user_id = y.user_id and x.a < y.a where x.country in (select country from elig) group by 1, 2, 3),
w as (select *, wins_i + wins_j as support, case when wins_i + wins_j > 0 then (wins_i - wins_j) / (wins_i + wins_j) else 0 end as margin, wins_i >= wins_j as beats from w0)"""
_ARC = "arc as (select country, i as x, j as y, beats as b from w union all select country, j, i, not beats from w)"
_T3 = f"{_ARC}, t3 as (select p.country, p.x as i, p.y as j, q.y as k, (p.b and q.b and not r.b) or (not p.b and not q.b and r.b) as cyc from arc p join arc q on p.country = q.country and p.y = q.x and p.x < p.y and q.x < q.y join arc r on p.country = r.country and p.x = r.x and q.y = r.y)"
_T4 = f"""{_T3}, t4 as (select a.country, a.i, a.j, a.k, b.k as l, (a.cyc::int + b.cyc::int + c.cyc::int + d.cyc::int) % 2 as odd from t3 a join t3 b on a.country = b.country and a.i = b.i and a.j = b.j and a.k < b.k
join t3 c on a.country = c.country and a.i = c.i and a.k = c.j and b.k = c.k join t3 d on a.country = d.country and a.j = d.i and a.k = d.j and b.k = d.k), par as (select country, sum(odd)::bigint as odd_parity from t4 group by 1)"""
#: Odd 4-subsets by out-degrees: cyclic triples among those that a vertex beats, and among those that beat it.
_ODD = """won as (select country, x, y from arc where b), n as (select count(*) as n from alts), deg as (select country, x, count(*) as d from won group by 1, 2),
vs as (select country, v, coalesce(d, 0) as d from (select distinct country, x as v from arc) p left join (select country as c, x, d from deg) q on p.country = q.c and p.v = q.x),
below as (select country, v, sum(k * (k - 1) // 2) as s from (select a.country, a.x as v, a.y as u, count(*) as k from won a join won p on p.country = a.country and p.x = a.x join won q on q.country = a.country and q.x = a.y and q.y = p.y group by 1, 2, 3) group by 1, 2),
above as (select country, v, sum(k * (k - 1) // 2) as s from (select a.country, a.y as v, a.x as u, count(*) as k from won a join won p on p.country = a.country and p.x = a.x join won q on q.country = a.country and q.x = p.y and q.y = a.y group by 1, 2, 3) group by 1, 2),
par as (select vs.country, sum(d * (d - 1) * (d - 2) // 6 - coalesce(below.s, 0) + (n - 1 - d) * (n - 2 - d) * (n - 3 - d) // 6 - coalesce(above.s, 0))::bigint as odd_parity from vs cross join n left join below on below.country = vs.country and below.v = vs.v left join above on above.country = vs.country and above.v = vs.v group by 1)"""
_CC = "cc as (select country, count(*) filter (where cyc) as cycles, count(*) as triples, count(*) filter (where cyc) / count(*) as fraction from t3 group by 1)"
_STRICT = "st as (select p.country, count(*) as strict_triples, count(*) filter (where sign(p.margin) = sign(q.margin) and sign(p.margin) = -sign(r.margin)) as strict_cycles from w p join w q on p.country = q.country and p.j = q.i join w r on p.country = r.country and p.i = r.i and q.j = r.j where p.margin <> 0 and q.margin <> 0 and r.margin <> 0 group by 1)"
LATENT_SQL = f"""r as ({plain(DIMENSION_ROWS)}), lu as (select user_id, min(country) as country, {", ".join(f"sum({d})::double as p_{d}, count({d}) as t_{d}" for d in DIMS)} from r group by 1),
lb as (select user_id, country, {", ".join(f"p_{d} / nullif(t_{d}, 0) - 0.5 as {d}" for d in DIMS)} from lu where {" + ".join(f"t_{d}" for d in DIMS)} >= 8 and {" + ".join(f"(t_{d} > 0)::int" for d in DIMS)} >= 4)"""

ORACLE_SQL = {
    "dirty_scan": f"""with rows0 as ({plain(CHARACTER_ROWS)}), s as (select country, row_key % 37 <> 0 and row_key % 41 <> 0 and row_key % 43 <> 0 as ok, cnt from rows0)
select country, count(*) as n_raw, count(*) filter (where ok) as n_kept, sum(case when ok then cnt end)::bigint as cnt from s group by 1""",
    "user_beta": f"with {BETA_SQL} select user_id, country, alternative, n_scenarios, round(beta, 6) + 0.0 as beta from beta",
    "eligible_groups": f"with {BETA_SQL}, {_ELIG} select country, n_users from elig",
    "country_tournament": f"with {WINS_SQL} select country, i::int as i, j::int as j, wins_i, wins_j, support, round(margin, 6) + 0.0 as margin, beats from w",
    "global_tournament": f"""with {DENSE_SQL}, sc as (select 'all' as scope, * from dense union all select 'eligible', * from dense where country in (select country from elig)),
w0 as (select x.scope, x.a as i, y.a as j, {_WIN} from sc x join sc y on x.scope = y.scope and x.user_id = y.user_id and x.a < y.a group by 1, 2, 3), m as (select *, abs((wins_i - wins_j) / (wins_i + wins_j)) as m from w0)
select scope, count(*) as n_pairs, count(*) filter (where m <= 1e-8) as ties, round(min(m), 6) as min_abs_margin, round(avg(m), 6) as mean_abs_margin, sum(wins_i + wins_j)::bigint as support from m group by 1""",
    "condorcet_count": f"with {WINS_SQL}, {_T3}, {_CC} select country, cycles, triples, round(fraction, 6) as fraction from cc",
    "odd_parity": f"with {WINS_SQL}, {_T4} select country, odd_parity, odd_parity > 0 as obstructed from par",
    "obstructed_groups": f"with {WINS_SQL}, {_T4}, {_CC} select par.country, odd_parity, cycles, odd_parity > ((select count(*) from alts) - 3) * cycles as violates from par join cc on par.country = cc.country where odd_parity > 0",
    "latent_beta": f"with {LATENT_SQL} select user_id, country, {', '.join(f'round({d}, 6) as {d}' for d in DIMS)} from lb",
    "latent_majority_cycles": f"""with {LATENT_SQL}, util as (select user_id, country, unnest(range({len(PROFILES)})) as a, unnest([{", ".join("round(" + " + ".join(f"coalesce({d}, 0) * {v}" for d, v in zip(DIMS, p, strict=True)) + ", 12)" for p in PROFILES)}]) as beta from lb),
w0 as (select x.country, x.a as i, y.a as j, {_WIN} from util x join util y on x.user_id = y.user_id and x.a < y.a group by 1, 2, 3), w as (select *, (wins_i - wins_j) as margin from w0),
{_STRICT} select country, strict_triples as triples, strict_cycles as cycles from st""",
}
