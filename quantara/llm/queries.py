"""The registered queries of the training-data operators, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantara.llm import attribution, decontaminate, language, license_scan, line_dedup, minhash, mixing, repetition, sharding, tokenfile
from quantara.llm._common import cut, delete_path, scratch_path, table

#: Name of the vocabulary in the folder of public tokenizers.
VOCABULARY = "byte_bpe_50k.json"


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_suffix_array_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.quality(table(spark, sf_dir, "documents"))


def op3_rare_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op4_offset_mapped_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each line of each document."""
    counts = attribution.section_tokens(table(spark, sf_dir, "documents"), vocabulary())
    return counts.withColumn("n_tokens", F.col("n_tokens").cast("long"))


def op5_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = sharding.shard_documents(docs.withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit("")))))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def shards_by_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of op5: all but the CRC-32 of the texts."""
    return op5_histogram_sort(spark, sf_dir).drop("text_crc32", "grown_shard")


def op6_arrow_fixed_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    manifest = tokenfile.write_tokens(table(spark, sf_dir, "documents"), path, vocabulary())
    out = cut(tokenfile.read_tokens(spark, manifest))
    delete_path(spark, path)
    return out


def op7_mixture_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", language.held_out(F.col("doc_id")))
    model = language.fit(docs.where("not held_out"))
    return language.predict(docs, model, keep=("held_out",))


def op8_hash_threshold_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op9_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_bagminhash, op2_suffix_array_repetition, op3_rare_token_index, op4_offset_mapped_tokens, op5_histogram_sort, op6_arrow_fixed_lists, op7_mixture_inference, op8_hash_threshold_mix,
        op9_cgk_decontamination, op10_fuzzy_lines, shards_by_bytes,
    )}


OP5_SQL = """
with d as (select doc_id, coalesce(text, '') as t, strlen(coalesce(text, '')) + 1 as size from documents),
k as (select doc_id, t, size, md5(t) as h1, md5(coalesce(cast(doc_id as varchar), '')) as h2, sum(size) over () as total from d),
g as (select *, sum(size) over (partition by h1) as group_size from k),
o as (select *, case when group_size > 0.01 * total / 8 then h2 else '' end as inner_key from g),
b as (select *, coalesce(sum(size) over (order by h1, inner_key range between unbounded preceding and current row), 0)
       - sum(size) over (partition by h1, inner_key) as before from o),
s as (select *, cast(before * 8 // total as integer) as shard from b)
select doc_id, cast(size as bigint) as size, 'bytes' as law, shard,
  cast(row_number() over (partition by shard order by h1, h2) - 1 as bigint) as slot from s
"""

OP8_SQL = r"""
with d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
    substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 12) as h from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
w as (select *, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as w,
    2.0::double * source_size as most from s),
l as (select *, (1.5::double * sum(source_size) over () - coalesce(sum(most) over b, 0)) / (sum(w) over () - coalesce(sum(w) over b, 0)) as level
    from w window b as (order by most / w, source nulls last rows between unbounded preceding and 1 preceding)),
t as (select source, source_size, least(most, max(level) over () * w) as target from l),
n as (select *, case when source_size > 0 then floor(target / source_size) else 0 end as times,
    greatest(0, target - (case when source_size > 0 then floor(target / source_size) else 0 end) * source_size) as rest from t),
h as (select source, h, sum(size) as size, sum(sum(size)) over (partition by source order by h) as upto from d group by source, h),
e as (select n.source, min(case when upto > rest then h.h end) as edge from n join h on n.source is not distinct from h.source group by n.source),
c as (select n.*, e.edge, h.upto - n.rest < n.rest - (h.upto - h.size) as nearer
    from n left join e on n.source is not distinct from e.source left join h on h.source is not distinct from n.source and h.h = e.edge)
select d.doc_id, d.size, c.source_size, c.target,
  cast(d.size * (c.times + case when d.h < c.edge or (d.h = c.edge and c.nearer) then 1 else 0 end) as bigint) as taken
from d join c on d.source is not distinct from c.source
"""


def oracle_sql() -> dict[str, str]:
    return {"op8_hash_threshold_mix": OP8_SQL, "shards_by_bytes": OP5_SQL}
