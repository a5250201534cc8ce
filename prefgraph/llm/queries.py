"""The corpus queries and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefgraph.llm import bm25, jpeg_media, lexical_rank, license_scan, mixture, near_dedup, piece_bpe, token_counts, token_files, toxicity, url_filter, warc, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg_media.media_features(jpeg_media.store_media(_table(spark, sf_dir, "documents")))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.license_scan(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_licenses", "best_license", F.round("best_coverage", 6).alias("best_coverage"), F.to_json("licenses").alias("licenses"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    quality = mixture.quality_weights(_table(spark, sf_dir, "labels"))
    return mixture.mix(_table(spark, sf_dir, "documents"), quality).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


OP4_SQL = f"""
with quality as (select doc_id, {mixture.BAD} + {mixture.GOOD - mixture.BAD} * avg(cast(quality as double)) as weight from labels
  where doc_id is not null and quality is not null group by doc_id),
d as (select documents.doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as size,
    pow((cast(cast('0x' || substr(md5('17|' || coalesce(cast(documents.doc_id as varchar), '')), 1, 12) as bigint) as double) + 0.5) / {2**48}.0::double, 1.0 / coalesce(weight, 1.0)) as u
  from documents left join quality on documents.doc_id = quality.doc_id),
s as (select source, sum(size)::double as source_size, row_number() over (order by source nulls last) as rn from d group by source),
w as (select *, 2 * source_size as cap, [5.0, 2.0, 1.0][((rn - 1) % 3 + 1)::int]::double as w from s),
l as (select *, (1.5::double * sum(source_size) over () - coalesce(sum(cap) over (order by cap / w, rn rows between unbounded preceding and 1 preceding), 0))
    / sum(w) over (order by cap / w, rn rows between current row and unbounded following) as level from w),
t as (select source, source_size, least(cap, (max(level) over ()) * w) as target from l),
e as (select *, case when source_size > 0 then floor(target / source_size) else 0 end as epochs from t),
p as (select d.doc_id, d.size, e.source_size, e.target, e.epochs, round(e.target - e.epochs * e.source_size) as rest,
    coalesce(sum(d.size) over (partition by d.source order by d.u desc, d.doc_id rows between unbounded preceding and 1 preceding), 0) as before
  from d join e on d.source is not distinct from e.source)
select doc_id, size::bigint as size, source_size::bigint as source_size, round(target, 6) as target,
  (epochs * size + greatest(0, least(size, rest - before)))::bigint as taken from p
"""


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(_table(spark, sf_dir, "pages"))
    return warc.read_archives(manifest, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, octet_length(encode(html)) as payload_bytes, sha1(html) as payload_digest from p),
m as (select *, max(page_id) over (partition by payload_digest) as chosen from d)
select page_id, payload_bytes::bigint as payload_bytes, payload_digest,
  case when payload_bytes >= 1000 and page_id <> chosen then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 1000 and page_id <> chosen then chosen end as refers_to
from m
"""


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), percent=85).select("doc_id", "n_shingles", "component_id", "kept")


OP7_SQL = """
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as ws from documents),
g as (select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
    else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) end) as shingle from w),
n as (select doc_id, count(*) as n from g group by doc_id),
i as (select a.doc_id as x, b.doc_id as y, count(*) as both_n from g a join g b on a.shingle = b.shingle and a.doc_id < b.doc_id group by 1, 2),
k as (select x, y from i join n p on p.doc_id = x join n q on q.doc_id = y where 100 * both_n >= 85 * (p.n + q.n - both_n)),
edges as (select x, y from k union all select y, x from k),
reach as (select doc_id as a, doc_id as b from w union select r.a, e.y from reach r join edges e on e.x = r.b),
c as (select a as doc_id, min(b) as component_id from reach group by a)
select c.doc_id, coalesce(n.n, 0)::bigint as n_shingles, c.component_id, c.doc_id = c.component_id as kept from c left join n on n.doc_id = c.doc_id
"""


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_token_files(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_token_files(manifest)


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.piece_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return bm25.top_k(docs, docs.where("doc_id % 50 = 0"))


OP10_SQL = """
with w as (select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')) as term from documents),
tf as (select doc_id, term, count(*)::double as tf from w group by 1, 2),
dl as (select doc_id, sum(tf) as dl from tf group by 1),
st as (select count(*)::double as n, avg(dl)::double as mean from dl),
df as (select term, count(*)::double as df from tf group by 1),
s as (select q.doc_id as query_id, d.doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * d.tf * 2.2 / (d.tf + 1.2 * (0.25 + 0.75 * dl / mean))), 6) as score
  from tf q join tf d on q.term = d.term join df on df.term = d.term join dl on dl.doc_id = d.doc_id cross join st where q.doc_id % 50 = 0 group by 1, 2),
r as (select query_id, row_number() over (partition by query_id order by score desc, doc_id) as rank, doc_id, score from s)
select query_id, rank::int as rank, doc_id, score from r where rank <= 10
"""


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op13_lexical_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_rank.rank(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
OP13_SQL = f"""
with d as (select doc_id, row_number() over () as row_id, {_TERMS} as ts from documents),
s as (select count(*) filter (len(ts) > 0) as docs, sum(len(ts))::bigint as words from d),
q as (select distinct item_id, unnest({_TERMS}) as term from benchmark),
w as (select doc_id, row_id, len(ts) as n, unnest(ts) as term from d),
tf as (select row_id, any_value(doc_id) as doc_id, any_value(n)::bigint as n, term, count(*)::bigint as tf from w where term in (select term from q) group by row_id, term),
df as (select term, count(*)::bigint as df from tf group by term),
k as (select term, floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)::double))::bigint as weight from df cross join s),
r as (select q.item_id, tf.row_id, any_value(tf.doc_id) as doc_id,
    sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // words))))::bigint as score
  from q join tf on q.term = tf.term join k on k.term = q.term cross join s group by 1, 2),
o as (select item_id, row_number() over (partition by item_id order by score desc, doc_id) as rank, doc_id, score from r where score > 0)
select item_id, rank::int as rank, doc_id, score from o where rank <= 50
"""

QUERIES = {f.__name__: f for f in (op1_media, op2_licenses, op3_token_counts, op4_mixture, op5_toxicity, op6_warc, op7_near_dedup, op8_token_files, op9_pieces, op10_bm25, op11_url_filter, op12_whitening, op13_lexical_rank)}
ORACLE_SQL = {"op4_mixture": OP4_SQL, "op6_warc": OP6_SQL, "op7_near_dedup": OP7_SQL, "op10_bm25": OP10_SQL, "op13_lexical_rank": OP13_SQL}
