"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    bytebpe, hardneg, htmltext, jaccard, langid, licenses, likelihood, merkle, neardup, packing, private, quality, topk,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.ngram_jaccard_join(_table(spark, sf_dir, "documents"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.cut(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(pieces)


def fold(of: int) -> Column:
    """Remainder of the checksum of the id's text."""
    return F.crc32(F.col("doc_id").cast("string")) % of


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.label(_table(spark, sf_dir, "documents"), fold(4) != 2)
    return found.select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score", "spans")


def quality_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "labels").where(fold(5) != 0).select("doc_id", F.col("quality").alias("label"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.score(_table(spark, sf_dir, "documents"), quality_labels(spark, sf_dir))
    return found.select("doc_id", (fold(5) == 0).alias("held_out"), "score", "predicted")


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private.digest(private.find(_table(spark, sf_dir, "documents")))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = htmltext.extract(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    both = bytebpe.round_trip(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return both.select(
        "doc_id", F.expr("cast(octet_length(ids) / 4 as long)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.detect(_table(spark, sf_dir, "documents")))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine(_table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = _table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return likelihood.apply_rules(_table(spark, sf_dir, "documents"), trusted)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    one_more = {"n_chars": F.col("n_chars").cast("decimal(38,0)") + 1}
    proved = merkle.manifest(
        _table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id", one_more, fold(7) == 0)
    return proved.withColumnRenamed("id", "doc_id")


QUERIES = {f.__name__: f for f in (
    op1_ngram_jaccard_join, op2_embedding_near_dedup, op3_packing, op4_language_id,
    op5_quality_classifier, op6_exact_top_k, op7_pii, op8_html_extraction, op9_byte_bpe, op10_license_scan,
    op11_hard_negatives, op12_quality_rules, op13_merkle_manifest,
)}

ORACLES: dict[str, str] = {
    "op6_exact_top_k": """
with whole as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id as vec_id,
    cast(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) as bigint) as score
  from whole as q join whole as c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0
)
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored) as ranked
where rank <= 5""",
    "op11_hard_negatives": """
with whole as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select a.vec_id as anchor_id, r.vec_id as id, a.label = r.label as same,
    cast(list_sum(list_transform(list_zip(a.v, r.v), lambda z: z[1] * z[2])) as bigint) as score
  from whole as a join whole as r on a.vec_id <> r.vec_id where a.vec_id % 100 = 0
), positives as (
  select anchor_id, id as positive_id, score as positive_score,
    row_number() over (partition by anchor_id order by score desc, id) as place from scored where same
)
select p.anchor_id, p.positive_id, p.positive_score, n.id as negative_id, n.score as negative_score,
  cast(row_number() over (partition by p.anchor_id, p.positive_id order by n.score desc, n.id) as integer) as rank
from positives as p join scored as n on n.anchor_id = p.anchor_id and not n.same
  and 30 * p.positive_score <= 100 * n.score and 100 * n.score <= 90 * p.positive_score
where p.place <= 5
qualify rank <= 10""",
    # Levels are lists of digests, one row a tree and level; crc32 is its bit-by-bit definition.
    "op13_merkle_manifest": """
with recursive keyed as (
  select *, list_reduce(list_prepend(4294967295, list_transform(string_split(cast(doc_id as varchar), ''), lambda c: cast(ascii(c) as bigint))),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]),
      lambda a, b: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end)) as crc from documents
), fields as (
  select doc_id, lang, crc,
    list_transform([cast(doc_id as varchar), source, lang, cast(n_chars as varchar), text],
      lambda x: coalesce(strlen(x) || ':' || x, '-')) as f, coalesce(strlen(cast(n_chars + 1 as varchar)) || ':' || (n_chars + 1), '-') as more from keyed
), leaves as (
  select doc_id, lang, sha256(array_to_string(f, '')) as leaf,
    case when xor(crc, 4294967295) % 7 = 0 then sha256(f[1] || f[2] || f[3] || more || f[5]) end as now from fields
), placed as (
  select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos from leaves
), levels as (
  select lang, 0 as level, list(leaf order by pos) as nodes from placed group by lang
  union all
  select lang, level + 1, list_transform(range(0, len(nodes), 2), lambda i: sha256(nodes[i + 1] || coalesce(nodes[i + 2], '')))
  from levels where len(nodes) > 1
), subroots as (
  select lang, nodes[1] as subroot, level as height, row_number() over (order by lang nulls first) - 1 as tree from levels where len(nodes) = 1
), tops as (
  select 0 as level, list(subroot order by tree) as nodes from subroots
  union all
  select level + 1, list_transform(range(0, len(nodes), 2), lambda i: sha256(nodes[i + 1] || coalesce(nodes[i + 2], ''))) from tops where len(nodes) > 1
), steps as (
  select p.doc_id, p.lang, p.leaf, l.level, (p.pos >> l.level) & 1 as right_hand, coalesce(l.nodes[xor(p.pos >> l.level, 1) + 1], '') as sibling
  from placed as p join levels as l on p.lang is not distinct from l.lang where len(l.nodes) > 1
  union all
  select p.doc_id, p.lang, p.leaf, s.height + t.level, (s.tree >> t.level) & 1, coalesce(t.nodes[xor(s.tree >> t.level, 1) + 1], '')
  from placed as p join subroots as s on p.lang is not distinct from s.lang cross join tops as t where len(t.nodes) > 1
), proofs as (
  select doc_id, leaf, string_agg(sibling, '' order by level) as siblings,
    list(case when right_hand = 1 then 'L' else 'R' end || sibling order by level) as steps from steps group by doc_id, lang, leaf
), folded as (
  select p.doc_id, p.leaf, s.subroot, (select nodes[1] from tops where len(nodes) = 1) as root, sha256(coalesce(q.siblings, '')) as proof_sha256,
    list_reduce(list_prepend(coalesce(p.now, p.leaf), coalesce(q.steps, [])),
      lambda d, x: sha256(case when x[1] = 'L' then x[2:] || d else d || x[2:] end)) as folded_root
  from placed as p join subroots as s on p.lang is not distinct from s.lang left join proofs as q on q.doc_id is not distinct from p.doc_id and q.leaf = p.leaf
)
select *, folded_root = root as verified from folded""",
}
