"""The registered queries of this subpackage: thin digests over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(check: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if check is not None:
            CHECKS[fn.__name__] = check
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query()
def op2_byte_bpe(spark, sf_dir):
    """Ranks of the 50k byte vocabulary, encoded and decoded again."""
    import public_tokenizers

    from cutline.llm import bpe

    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query()
def op3_language_divergence(spark, sf_dir):
    """Base rules and distances to the language references of every document."""
    from cutline.llm import divergence

    return divergence.quality(table(spark, sf_dir, "documents"))


@query()
def op5_toxicity_ftrl(spark, sf_dir):
    """Scores of all documents by a model that never saw the held-out third."""
    from cutline.llm import toxicity

    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~held_out)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


@query()
def op6_simhash_ball(spark, sf_dir):
    """Components of fingerprints within four bits."""
    from cutline.llm import simhash

    return simhash.near_copies(table(spark, sf_dir, "documents"))


@query()
def op7_repeated_passages(spark, sf_dir):
    """What is left of every document without its repeated 100-byte strings."""
    from cutline.llm import suffix

    return suffix.digest(table(spark, sf_dir, "documents"))


@query()
def op8_id_shards(spark, sf_dir):
    """Every document's ids, read back from their shards by key."""
    from cutline.llm import idfile

    return idfile.stored(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), "word", 2, added=True)


@query()
def op9_configuration_packing(spark, sf_dir):
    """Every document's pieces in sequences of 1024 tokens."""
    from cutline.llm import packing

    return packing.packed(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), added=True)


@query()
def op4_posting_lists(spark, sf_dir):
    """Five nearest vectors of every fiftieth."""
    from cutline.llm import posting

    return posting.search(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


@query()
def op10_secret_scan(spark, sf_dir):
    """Secrets in every document, by shape and by entropy."""
    from cutline.llm import secrets

    return secrets.report(table(spark, sf_dir, "documents"), letters=True)


_PAIRS = """
turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text,
         row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as p
  from conversations where conv_id is not null),
replies as (select conv_id, max(p) as p from turns where role = 'assistant' group by conv_id),
swaps as (select r.conv_id, r.p, t.text from replies r join turns t on t.conv_id = r.conv_id and t.p = r.p),
sides as (
  select conv_id, 'chosen' as side, role, text, p from turns
  union all
  select t.conv_id, 'rejected', t.role, t.text, t.p from turns t left join replies r on t.conv_id = r.conv_id where t.p < coalesce(r.p, 9223372036854775807)
  union all
  select a.conv_id, 'rejected', 'assistant', b.text, a.p from swaps a join swaps b on b.conv_id = xor(a.conv_id, 1)),
placed as (select conv_id, side, role, text, row_number() over (partition by conv_id, side order by p) as p from sides),
"""

_OP1 = f"""
with {_PAIRS}
counted as (select conv_id, count(*) filter (side = 'chosen') as chosen_turns, count(*) filter (side = 'rejected') as rejected_turns from placed group by conv_id),
same as (
  select a.conv_id, a.p, a.p - row_number() over (partition by a.conv_id order by a.p) as gap
  from placed a join placed b on a.conv_id = b.conv_id and a.p = b.p and a.side = 'chosen' and b.side = 'rejected' and a.role = b.role and a.text = b.text),
common as (select c.conv_id, c.chosen_turns, c.rejected_turns, count(s.p) as prompt_turns from counted c left join same s on s.conv_id = c.conv_id and s.gap = 0 group by all),
shown as (
  select p.*, c.prompt_turns, '<|' || role || '|>' || chr(10) as head, text || '<|end|>' as body, p.p <= c.prompt_turns as is_prompt
  from placed p join common c using (conv_id)),
lengths as (
  select *, sum(length(head) + length(body) + 1) over (partition by conv_id, side, is_prompt order by p) - length(body) - 1 as begins from shown)
select c.conv_id, c.chosen_turns, c.rejected_turns, c.prompt_turns,
  coalesce(string_agg(head || body || chr(10), '' order by p) filter (is_prompt and side = 'chosen'), '') as prompt,
  coalesce(string_agg(head || body || chr(10), '' order by p) filter (not is_prompt and side = 'chosen'), '') as chosen,
  coalesce(string_agg(begins::bigint || ':' || (begins + length(body))::bigint, ',' order by p) filter (not is_prompt and side = 'chosen' and role = 'assistant'), '') as chosen_spans,
  coalesce(string_agg(head || body || chr(10), '' order by p) filter (not is_prompt and side = 'rejected'), '') as rejected,
  coalesce(string_agg(begins::bigint || ':' || (begins + length(body))::bigint, ',' order by p) filter (not is_prompt and side = 'rejected' and role = 'assistant'), '') as rejected_spans
from common c join lengths l using (conv_id) group by all
"""


@query(_OP1)
def op1_preference_pairs(spark, sf_dir):
    """Each conversation against itself with the last reply of its sibling (the id with its last bit flipped)."""
    from pyspark.sql import Window

    from cutline.llm import chat

    turns = table(spark, sf_dir, "conversations").where("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    turns = turns.withColumn("p", place.cast("long"))
    last = F.max(F.when(F.col("role") == "assistant", F.struct("p", "text")))
    replies = turns.groupBy("conv_id").agg(last.alias("last"))
    sibling = replies.where("last is not null").select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.col("last.text").alias("other"))
    swaps = replies.where("last is not null").join(sibling, "conv_id").select("conv_id", F.col("last.p").alias("turn"), F.lit("assistant").alias("role"), F.col("other").alias("text"))
    chosen = turns.select("conv_id", F.lit("chosen").alias("side"), F.col("p").alias("turn"), "role", "text")
    before = turns.join(replies, "conv_id").where(F.col("last").isNull() | (F.col("p") < F.col("last.p"))).select("conv_id", F.lit("rejected").alias("side"), F.col("p").alias("turn"), "role", "text")
    swapped = swaps.select("conv_id", F.lit("rejected").alias("side"), "turn", "role", "text")
    return chat.preference(chosen.unionByName(before).unionByName(swapped), "conv_id")


_OP11 = r"""
with tok as (
  select rid, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from (select row_number() over () as rid, doc_id, text from documents)),
post as (select rid, doc_id, term, count(*)::bigint as tf from tok group by all),
lens as (select rid, sum(tf)::bigint as n from post group by rid),
total as (select count(*)::bigint as nn, sum(n)::bigint as ll from lens),
freq as (select term, count(*)::bigint as df from post group by term),
asked as (
  select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
scored as (
  select a.item_id, p.rid, p.doc_id, sum(floor(1000 * ln((2.0::double * nn + 2) / (2.0::double * df + 1)))::bigint * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // ll))))::bigint as score
  from asked a join post p using (term) join lens using (rid) join freq using (term) cross join total group by all)
select item_id, rank::int as rank, doc_id, score from (
  select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scored where score > 0) where rank <= 10
"""


@query(_OP11)
def op11_impact_search(spark, sf_dir):
    """Ten documents of the highest score for each benchmark item."""
    from cutline.llm import lexical

    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_VALID = "embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and vec_id is not null"

_OP12 = f"""
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as e
  from embeddings where label is not null and {_VALID}),
s as (
  select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_inner_product(a.e, b.e)::bigint as score
  from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) where a.vec_id % 100 = 0),
pos as (select * from (select *, row_number() over (partition by anchor_id order by score desc, vec_id) as r from s where same) where r <= 5)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from (
  select p.anchor_id, p.vec_id as positive_id, n.vec_id as negative_id, p.score as positive_score, n.score as negative_score,
         row_number() over (partition by p.anchor_id, p.vec_id order by n.score desc, n.vec_id) as rank
  from pos p join s n on n.anchor_id = p.anchor_id and not n.same and 80 * p.score <= 100 * n.score and 100 * n.score <= 100 * p.score)
where rank <= 5
"""


@query(_OP12)
def op12_vertical_negatives(spark, sf_dir):
    """Five hard negatives for each of five positives of every hundredth vector."""
    from cutline.llm import bond

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return bond.mine(vectors, F.col("id") % 100 == 0)


_OP13 = f"""
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as e from embeddings where {_VALID})
select query_id, rank::int as rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from (
    select a.vec_id as query_id, b.vec_id, list_inner_product(a.e, b.e)::bigint as score
    from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) where a.vec_id % 100 = 0))
where rank <= 10
"""


@query(_OP13)
def op13_norm_buckets(spark, sf_dir):
    """Ten highest products of every hundredth vector."""
    from cutline.llm import normed

    return normed.search(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)
