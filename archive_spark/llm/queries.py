"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, chat, decontaminate, line_dedup, ngram_join, packing, periodic, pii, quality, token_store, toxicity, url_filter, warc
from .common import shared_path

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"
#: The URL rules (host, path, verdict).
URL_RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: The conversation that is added.
EXTRA_CONVERSATION, EXTRA_TEXT = -7, "\\### Assistant: </turn> ok"

#: Fixed value: a word.
WORD = r"[^\x20\x09-\x0D]+"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_index(_table(spark, sf_dir, "pages"))


def op2_chat_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(EXTRA_CONVERSATION).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(EXTRA_TEXT).alias("text"))
    return chat.conversation_digests(chat.format_conversations(rows.unionByName(extra), public_tokenizers.path(BYTE_BPE)))


def op3_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), keep_ids=False)


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(_table(spark, sf_dir, "documents"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(_table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"), spark.sql(f"select * from values {values} as t(host, path, verdict)"))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "token-store")
    token_store.write_store(_table(spark, sf_dir, "documents"), path, public_tokenizers.path(WORD_BPE))
    return token_store.read_store(spark, path).select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents"), count_col="n_removed_lines")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_equal_average_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(_table(spark, sf_dir, "embeddings"))


def planted_periods(documents: DataFrame) -> DataFrame:
    """The contract's texts: where h, the crc32 of the decimal id, is divisible by 10, words from a on repeat with period p."""
    words = documents.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"), F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0)).alias("w"))
    words = words.withColumn("n", F.size("w")).withColumn("g", F.expr("h div 10")).withColumn("a", F.expr("if(n > 0, g % n, 0)")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    changed = F.array_join(F.expr("transform(w, (x, i) -> if(i >= a, w[cast(a + (i - a) % p as int)], x))"), " ")
    return words.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), changed).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_digests(periodic.periodic_runs(planted_periods(_table(spark, sf_dir, "documents"))))


def op13_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_passages(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict:
    found = (op1_warc_index, op2_chat_masks, op3_sum_of_squares_packing, op4_ngram_jaccard, op5_personal_data, op6_decontamination, op7_url_cascade, op8_token_store, op9_line_dedup, op10_quality)
    found += (op11_equal_average_clusters, op12_periodic_runs, op13_toxic_segments)
    return {f.__name__: f for f in found}


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP7_SQL = f"""
with parts as (
  select page_id, coalesce({_LOWER.format("regexp_extract(url, '://([^/?#]*)', 1)")}, '') as host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path from pages
), rules(h, p, v) as (values {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)}),
best as (
  select page_id, host, path, arg_max(h || p, length(h || p)) as rule, arg_max(v, length(h || p)) as verdict
  from parts, rules where (host = h or suffix(host, '.' || h)) and starts_with(path, p) group by page_id, host, path
)
select parts.page_id, parts.host, parts.path, best.rule, coalesce(best.verdict, 'allow') as verdict
from parts left join best using (page_id, host, path)
"""

OP4_SQL = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), shingles as (
  select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))
    when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from words
), sizes as (select doc_id, count(*) as n from shingles group by doc_id),
pairs as (
  select a.doc_id as x, b.doc_id as y, count(*) as common from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2
), links as (
  select x, y from pairs join sizes p on p.doc_id = x join sizes q on q.doc_id = y where 100 * common >= 75 * (p.n + q.n - common)
), edges as (select x, y from links union all select y, x from links),
reach(doc_id, other) as (select doc_id, doc_id from documents union select reach.doc_id, edges.y from reach join edges on reach.other = edges.x)
select doc_id, coalesce(any_value(sizes.n), 0) as n_shingles, min(other) as component_id from reach left join sizes using (doc_id) group by doc_id
"""

def _clusters_sql(k: int = 16, rounds: int = 3, dims: int = 64) -> str:
    """Each round finds the nearest centroid over all of them, and takes the exact floor of the means."""
    ctes = [
        f"v as (select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as x from embeddings where len(embedding) = {dims} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {dims})",
        "seeds as (select x, row_number() over (order by h, x) - 1 as c from (select x, sha256('1:' || coalesce(cast(vec_id as varchar), '')) as h from v) order by h, x limit " + str(k) + ")",
        "c0 as (select c, x from seeds)",
        "rows as materialized (select row_number() over () as r, vec_id, x from v)",
    ]
    for i in range(rounds + 1):
        ctes.append(f"d{i} as materialized (select r, arg_min(c, d * {k} + c) as c, min(d) as d from (select r, c, cast(list_sum(list_transform(list_zip(rows.x, c{i}.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as bigint) as d from rows, c{i}) group by r)")
        if i < rounds:
            ctes.append(f"s{i} as (select c, i, sum(e) as s, count(*) as n from (select c, generate_subscripts(x, 1) as i, unnest(x) as e from d{i} join rows using (r)) group by c, i)")
            ctes.append(f"m{i} as (select c, list(cast((s - ((s % n) + n) % n) // n as bigint) order by i) as x from s{i} group by c)")
            ctes.append(f"c{i + 1} as materialized (select c, coalesce(m{i}.x, c{i}.x) as x from c{i} left join m{i} using (c))")
    last = rounds
    return "with " + ",\n".join(ctes) + f"""
select vec_id, cast(d{last}.c as int) as cluster, d as distance, cast(sum(d) over (partition by d{last}.c) as bigint) as cluster_inertia, cast(sum(d) over () as bigint) as inertia,
  sha256(array_to_string(c{last}.x, ',')) as centroid_sha256
from d{last} join rows using (r) join c{last} using (c)
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_ngram_jaccard": OP4_SQL, "op7_url_cascade": OP7_SQL, "op11_equal_average_clusters": _clusters_sql()}
