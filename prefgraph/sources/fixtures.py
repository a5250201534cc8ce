"""Preference tables derived from order data, in SQL that Spark and DuckDB both take.

An order is a prompt, a pair of its lines a comparison, the lines' part types the alternatives, the customer the evaluator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ASPECTS = ("overall", "helpful", "truthful", "harmless")
_MEASURE = {"overall": ("l_quantity", 15), "helpful": ("l_extendedprice", 15000), "truthful": ("l_discount", 0.05), "harmless": ("l_tax", 0.04)}

LINES = """select l.l_orderkey, l.l_quantity, l.l_extendedprice, l.l_discount, l.l_tax, l.l_returnflag, l.l_linestatus,
  o.o_custkey, o.o_orderpriority, p.p_type, p.p_brand,
  row_number() over (partition by l.l_orderkey order by l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice) as pos
  from {lineitem} l join {orders} o on l.l_orderkey = o.o_orderkey join {part} p on l.l_partkey = p.p_partkey"""


def _label(column: str, clear: float) -> str:
    d = f"round(a.{column} - b.{column}, 6)"
    return f"case when {d} >= {clear} then 'A-is-clearly-better' when {d} > 0 then 'A-is-slightly-better' when {d} = 0 then 'Tie' when {d} > -{clear} then 'B-is-slightly-better' else 'B-is-clearly-better' end"


ANNOTATIONS = f"""with lines as ({LINES})
select a.l_orderkey as prompt_id, a.o_custkey as evaluator,
  case when a.o_orderpriority in ('1-URGENT', '2-HIGH') then 'expert' else 'normal' end as annotation_group,
  a.pos as pos_a, b.pos as pos_b, a.p_type as alt_a, b.p_type as alt_b,
  {", ".join(f"{_label(*_MEASURE[x])} as {x}_pref" for x in ASPECTS)}
  from lines a join lines b on a.l_orderkey = b.l_orderkey and a.pos < b.pos"""

OPENINGS = f"""with lines as ({LINES}),
ranked as (select *, row_number() over (partition by l_orderkey, p_type order by pos) as turn_rank from lines)
select l_orderkey as conversation_id, o_custkey as user_id, o_orderpriority as conversation_type, p_type as model_name,
  2 * l_quantity as score, pos, 1000 * l_discount as attr_values, 1000 * nullif(l_tax, 0) as attr_safety, l_extendedprice / 1000 as attr_helpfulness
  from ranked where turn_rank = 1"""

CHARACTER_ROWS = """select o.o_custkey as user_id, n.n_name as country, case when l.l_linestatus = 'F' then 1 else 0 end as saved,
  p.p_brand as alternative, cast(1 + floor(l.l_quantity / 25) as bigint) as cnt, l.l_orderkey as row_key
  from {lineitem} l join {orders} o on l.l_orderkey = o.o_orderkey join {part} p on l.l_partkey = p.p_partkey
  join {customer} c on o.o_custkey = c.c_custkey join {nation} n on c.c_nationkey = n.n_nationkey"""

DIMENSION_ROWS = """select o.o_custkey as user_id, n.n_name as country,
  case when l.l_discount > 0.05 then 1 else 0 end as d_intervention, case when l.l_quantity > 25 then 1 else 0 end as d_number,
  case when l.l_returnflag in ('A', 'R') then case when l.l_returnflag = 'A' then 1 else 0 end end as d_law,
  case when l.l_tax > 0.04 then 1 else 0 end as d_status, case when l.l_linestatus = 'F' then 1 else 0 end as d_species,
  case when o.o_orderpriority in ('1-URGENT', '5-LOW') then case when o.o_orderpriority = '1-URGENT' then 1 else 0 end end as d_age
  from {lineitem} l join {orders} o on l.l_orderkey = o.o_orderkey join {customer} c on o.o_custkey = c.c_custkey join {nation} n on c.c_nationkey = n.n_nationkey"""

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A fixture's SQL over the tables of a folder."""
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def plain(text: str) -> str:
    """The same SQL with table names as they are."""
    return text.format(**{t: t for t in TABLES})
