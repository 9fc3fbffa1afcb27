"""The registered queries of this subpackage; each runs over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quizlens.llm import (chosen_path, length_histogram, merkle, mixing, piece_encoding,
                          secrets_ledger, seed_dedup, spelling, suffix_dedup, tiling,
                          token_files, topk, toxicity)
from quizlens.llm.oracles import OP11_SQL, OP13_SQL


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "domain", "lang", "source", "n_words", F.col("granted").cast("long"),
        F.col("copies").cast("long"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(
        table(spark, sf_dir, "documents"), keep_first=False, with_text=False)


def op4_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_seed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seed_dedup.remove_repeats(
        table(spark, sf_dir, "documents"), keep_first=False, with_text=False)


def op6_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram.with_quantiles(
        length_histogram.limits(length_histogram.histogram(table(spark, sf_dir, "documents"))))


def op7_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_shingles", "component_id", "kept")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.roundtrip(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_ledger.find_secrets(table(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify(merkle.manifest(table(spark, sf_dir, "documents")))


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_encoding.digests(table(spark, sf_dir, "documents"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES = {q.__name__: q for q in (
    op1_mixing, op2_topk, op3_suffix_dedup, op4_tiling, op5_seed_dedup, op6_length_histogram,
    op7_chosen_path, op8_token_files, op9_toxicity, op10_secrets,
    op11_merkle, op12_pieces, op13_spelling)}

#: floor(256 * x) of sound vectors, all pairs of a query and another row.
OP2_SQL = """
with ints as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
  from embeddings
  where vec_id is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
pairs as (
  select q.vec_id as query_id, c.vec_id as vec_id,
    list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score
  from ints q join ints c on q.vec_id <> c.vec_id and len(q.v) = len(c.v)
  where q.vec_id % 50 = 0),
ranked as (
  select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank
  from pairs)
select query_id, rank, vec_id, score from ranked where rank <= 5
"""


def shared_sql(nodes: str, parent: str, keys: str, weight: str) -> str:
    """Budgets of sibling nodes: the highest level per weight, or the capacity."""
    return f"""(
  select {keys}, least(capacity::double, weight * max(level) over (partition by {parent})) as budget
  from (
    select *, (budget - coalesce(sum(capacity) over (w rows between unbounded preceding
        and 1 preceding), 0)) / sum(weight) over (w rows between current row and
        unbounded following) as level
    from (select *, {weight} as weight from {nodes})
    window w as (partition by {parent} order by capacity / weight, {keys.split(', ')[-1]})))"""


OP1_SQL = f"""
with words as (
  select doc_id, md5(coalesce(text, '')) as text_key,
    regexp_extract(coalesce(source, ''), '([0-9]+)$', 1) as number,
    coalesce(lang, chr(0)) as lang, coalesce(source, chr(0)) as source,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as n_words
  from documents),
docs as (
  select *, case when number = '' then 'other'
    when right(number, 1) in ('0', '3', '6', '9') then 'books' else 'web' end as domain
  from words),
leaves as (
  select domain, lang, source, sum(n_words)::bigint as tokens, 2 * sum(n_words)::bigint as capacity
  from docs group by all),
total as (select floor(sum(tokens) * 0.6::double) as budget from leaves),
domains as (select * from {shared_sql(
    "(select domain, sum(capacity) as capacity, 0 as root from leaves group by domain), total",
    "root", "domain", "case domain when 'books' then 3.0::double else 2.0::double end")}),
langs as (select * from {shared_sql(
    "(select domain, lang, sum(capacity) as capacity from leaves group by domain, lang) "
    "join domains using (domain)", "domain", "domain, lang",
    "case lang when 'en' then 4.0::double else 2.0::double end")}),
sources as (select * from {shared_sql(
    "leaves join langs using (domain, lang)", "domain, lang", "domain, lang, source",
    "1.0::double")}),
granted as (
  select domain, lang, source, tokens, floor(round(budget, 4))::bigint as granted,
    case when tokens > 0 then granted // tokens else 0 end as whole,
    case when tokens > 0 then granted % tokens else 0 end as rest
  from sources join leaves using (domain, lang, source)),
placed as (
  select *, sum(n_words) over (partition by domain, lang, source
      order by draw, doc_id nulls first, text_key) as upto
  from (select *, md5('mix-1:' || whole || ':' || coalesce(doc_id::varchar, '') || ':' || text_key)
          as draw from docs join granted using (domain, lang, source)))
select doc_id, domain, nullif(lang, chr(0)) as lang, nullif(source, chr(0)) as source, n_words,
  granted, (whole + (upto <= rest)::bigint)::bigint as copies
from placed where whole > 0 or upto <= rest
"""

ORACLES: dict[str, str] = {"op1_mixing": OP1_SQL, "op2_topk": OP2_SQL,
                           "op11_merkle": OP11_SQL, "op13_spelling": OP13_SQL}
