"""An inverted index on disk for BM25: postings in blocks with the best that a block can score, and searches that skip blocks.

Documents are tokenised once, when the index is written. A document belongs to a chunk, of documents of similar length and of
about CHUNK_DOCS at most, so a block (the postings of one term in one chunk) is bounded however frequent the term is, and
short documents, which score higher, stand apart from long ones. Tables under the path of the index:

- docs: id, chunk, dl (terms of the document);
- terms: term, df, peak (the best part of a score, without idf, that the term has in any document);
- blocks, in partitions by hash of the term and sorted by term: term, chunk, peak, ids, tfs, dls;
- stats: one row, n_docs and avgdl.

A search with many postings bounds each query's result from below by its rarest terms, then reads postings of those terms only without which no
document reaches that bound, keeps the documents that may still reach it by the peaks of the other terms in their chunk,
and looks those terms up for these documents alone. No result is lost: what is skipped can't be among the best k.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import text as tx
from ..operators import scoring
from ..operators.retrieval import BROADCAST_ROWS, best, hit_schema, small
from ..operators.scoring import K1, B
from ..session import bound_batches

BUCKETS, CHUNK_DOCS = 32, 256
#: Documents whose blocks a task makes, and pairs of query and posting that a task scores, about.
TASK_DOCS, TASK_PAIRS = 3_000, 20_000_000
#: Terms that bound a query's result: the rarest ones, up to about so many postings for each of the best k.
SEED_POSTINGS = 40
#: From this many pairs of query and posting on a search skips blocks; below, bounding costs more than it saves. The result is
#: the same.
PRUNE_PAIRS = 50_000_000
#: Scores are rounded to six places; bounds are lower by this.
SLACK = 1e-5

_own_dir: dict[str, str] = {}


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share. Only a local session may do without `spark.checkpoint.dir`."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = _own_dir.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="archive-spark-index-"))
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _impact(tf: Column, dl: Column, avgdl: Column) -> Column:
    """A term's part of a document's score, without idf."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


@dataclass(frozen=True)
class Index:
    spark: SparkSession
    path: str

    def table(self, name: str) -> DataFrame:
        if name != "blocks":
            return self.spark.read.parquet(f"{self.path}/{name}")
        kind = self.table("docs").schema["id"].dataType.simpleString()  # an index of no terms has no file to tell
        return self.spark.read.schema(f"term string, chunk int, peak double, ids array<{kind}>, tfs array<int>, dls array<int>, bucket int").parquet(f"{self.path}/blocks")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The terms of each document, each once, with how often it has them."""
    for batch in batches:
        for at in range(0, len(batch), scoring.DOC_STEP):
            part = batch.slice(at, scoring.DOC_STEP)
            row, code, n, words = scoring.count_terms(part.column("terms"))
            ends = pa.array(np.searchsorted(row, np.arange(len(part) + 1)), pa.int32())
            counted = [pa.ListArray.from_arrays(ends, words.take(pa.array(code))), pa.ListArray.from_arrays(ends, pa.array(n, pa.int32()))]
            yield pa.RecordBatch.from_arrays([part.column("id"), pc.list_value_length(part.column("terms")), *counted], names=["id", "dl", "words", "tfs"])


def write_index(docs: DataFrame, path: str, chunk_docs: int = CHUNK_DOCS) -> Index:
    """docs: id (unique), text. A document without terms counts in the averages and is in no block."""
    spark = docs.sparkSession
    bound_batches(spark)
    kind = docs.schema["id"].dataType
    types = T.StructType([T.StructField("id", kind), T.StructField("dl", T.IntegerType()), T.StructField("words", T.ArrayType(T.StringType())), T.StructField("tfs", T.ArrayType(T.IntegerType()))])
    docs.select("id", tx.terms(F.col("text")).alias("terms")).mapInArrow(_count, types).write.parquet(f"{path}/counts")
    counts = spark.read.schema(types).parquet(f"{path}/counts").withColumn("class", F.floor(F.log2(F.col("dl") + 1) * 2).cast("int"))
    parts = counts.groupBy("class").agg(F.ceil(F.count(F.lit(1)) / chunk_docs).alias("parts"))  # a row for each half power of two
    chunk = (F.col("class") * (1 << 20) + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int").alias("chunk")
    placed = counts.join(F.broadcast(parts), "class").select("id", chunk, "dl", "words", "tfs")
    placed.select("id", "chunk", "dl").write.parquet(f"{path}/docs")
    counts.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl")).coalesce(1).write.parquet(f"{path}/stats")
    index = Index(spark, path)
    stats = index.table("stats")
    tasks = max(spark.sparkContext.defaultParallelism, stats.first()["n_docs"] // TASK_DOCS + 1)
    # a chunk is in one task, so its blocks are made there
    rows = placed.repartition(tasks, "chunk").select("chunk", "id", "dl", F.explode(F.arrays_zip("words", "tfs")).alias("w")).join(F.broadcast(stats))
    rows = rows.select(F.col("w.words").alias("term"), "chunk", F.struct("id", F.col("w.tfs").alias("tf"), "dl").alias("p"), _impact(F.col("w.tfs"), F.col("dl"), F.col("avgdl")).alias("impact"))
    blocks = rows.groupBy("term", "chunk").agg(F.array_sort(F.collect_list("p")).alias("p"), F.max("impact").alias("peak"))
    blocks = blocks.select("term", "chunk", "peak", F.col("p.id").alias("ids"), F.col("p.tf").alias("tfs"), F.col("p.dl").alias("dls"), _bucket(F.col("term")).alias("bucket"))
    blocks.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/blocks")
    index.table("blocks").groupBy("term").agg(F.sum(F.size("ids")).alias("df"), F.max("peak").alias("peak")).write.parquet(f"{path}/terms")
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/counts")
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
    return index


def _sent(table: DataFrame, rows: int):
    """To all tasks if it has no more rows than are few, else joined by shuffle."""
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table


def _postings(index: Index, terms: DataFrame, rows: int) -> DataFrame:
    """The blocks of the terms of a table with bucket, which prunes partitions."""
    return index.table("blocks").join(_sent(terms.select("bucket", "term").distinct(), rows), ["bucket", "term"], "left_semi")


def _scored(index: Index, wanted: DataFrame, rows: int, allowed: DataFrame | None) -> DataFrame:
    """query_id, id, chunk and the sum of parts over the wanted terms (query_id, bucket, term, idf, avgdl)."""
    blocks = _postings(index, wanted, rows).select("term", "chunk", F.inline(F.arrays_zip("ids", "tfs", "dls")))
    parts = blocks.select("term", "chunk", F.col("ids").alias("id"), F.col("tfs").alias("tf"), F.col("dls").alias("dl"))
    if allowed is not None:
        parts = parts.join(allowed, "id", "left_semi")
    part = F.col("idf") * _impact(F.col("tf"), F.col("dl"), F.col("avgdl"))
    return parts.join(_sent(wanted.select("query_id", "term", "idf", "avgdl"), rows), "term").groupBy("query_id", "id", "chunk").agg(F.sum(part).alias("partial"))


def _kth(scored: DataFrame, k: int) -> DataFrame:
    """The k-th best of each query, which bounds its result from below."""
    return best(scored.select("query_id", "id", F.col("partial").alias("score")), k).where(F.col("rank") == k).select("query_id", (F.col("score") - SLACK).alias("floor"))


def _terms(queries: DataFrame, index: Index) -> tuple[DataFrame, int, int]:
    """A row for each term of each query that the index has, with idf and bound, kept for this search; how many, and their
    postings."""
    asked = queries.select("query_id", F.explode(F.array_distinct("terms")).alias("term"))
    known = index.table("terms").join(small(asked.select("term").distinct()), "term", "left_semi")
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = asked.join(known, "term").join(F.broadcast(index.table("stats"))).withColumns({"idf": idf, "bucket": _bucket(F.col("term"))}).withColumn("bound", F.col("idf") * F.col("peak"))
    terms = terms.select("query_id", "bucket", "term", "df", "idf", "bound", "avgdl").persist()
    rows, postings = terms.agg(F.count(F.lit(1)), F.coalesce(F.sum("df"), F.lit(0))).first()
    return terms, rows, postings


def _essential(terms: DataFrame, rows: int, index: Index, k: int, allowed: DataFrame | None) -> DataFrame:
    """Adds whether all postings of a term must be read (essential)."""
    rare = Window.partitionBy("query_id").orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1)
    seeds = terms.withColumn("before", F.coalesce(F.sum("df").over(rare), F.lit(0))).where(F.col("before") < SEED_POSTINGS * k)
    floor = _kth(_scored(index, seeds, rows, allowed), k)
    spent = F.sum("bound").over(Window.partitionBy("query_id").orderBy("bound", "term").rowsBetween(Window.unboundedPreceding, 0))
    planned = terms.join(floor, "query_id", "left").withColumn("essential", spent >= F.coalesce("floor", F.lit(0.0))).drop("floor").persist()
    planned.count()
    return planned


def _by_chunks(index: Index, terms: DataFrame, rows: int, postings: int, k: int, allowed: DataFrame | None, schema: T.StructType) -> DataFrame:
    """Scores made chunk by chunk: the blocks of the terms are dealt by chunk as they are, and each task sends the best k of each query.

    Allowed documents come to their chunk as rows without a term."""
    bound_batches(index.spark)
    types = [to_arrow_type(f.dataType) for f in schema]
    given = scoring.asked(terms.select("query_id", "term", "idf", "avgdl").collect(), types[0])
    blocks, restricted = _postings(index, terms, rows).select("chunk", "term", "ids", "tfs", "dls"), allowed is not None
    if restricted:
        few = index.table("docs").join(allowed.select("id"), "id", "left_semi").groupBy("chunk").agg(F.collect_list("id").alias("ids"))
        blocks = blocks.unionByName(few, allowMissingColumns=True)

    def score_chunk(kept: scoring.Best, held: list[pa.RecordBatch]) -> None:
        every = pa.Table.from_batches(held).combine_chunks()
        own = every.filter(pc.is_valid(every["term"])).combine_chunks()
        lists = [own[c].combine_chunks() if own.num_rows else pa.array([], own[c].type) for c in ("ids", "tfs", "dls")]
        ids = lists[0].flatten().dictionary_encode(null_encoding="encode")
        doc, tf, dl = ids.indices.to_numpy(zero_copy_only=False), *(x.flatten().to_numpy(zero_copy_only=False) for x in lists[1:])
        term = np.repeat(pc.index_in(own["term"], given.terms).to_numpy(), pc.list_value_length(lists[0]).to_numpy(zero_copy_only=False))
        if restricted:
            some = pa.concat_arrays([x.flatten() for x in every.filter(pc.is_null(every["term"]))["ids"].chunks] or [ids.dictionary.slice(0, 0)])
            seen = pc.is_in(ids.dictionary, some).to_numpy(zero_copy_only=False)[doc]
            doc, term, tf, dl = doc[seen], term[seen], tf[seen], dl[seen]
        kept.add(ids.dictionary, doc, term, tf, dl)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, held, at = scoring.Best(given, k, types[1]), [], None
        for batch in batches:
            chunk = batch.column("chunk").to_numpy()
            begins = np.flatnonzero(np.diff(chunk, prepend=-1)) if len(chunk) else []
            for s, e in zip(begins, [*begins[1:], len(chunk)]):
                if held and chunk[s] != at:
                    score_chunk(kept, held)
                    held = []
                at = chunk[s]
                held.append(batch.slice(s, e - s))
        if held:
            score_chunk(kept, held)
        yield from kept.hits(schema.names)

    tasks = max(index.spark.sparkContext.defaultParallelism, postings // TASK_PAIRS + 1)
    return blocks.repartition(tasks, "chunk").sortWithinPartitions("chunk").mapInArrow(score, schema)


def keyword_topk(queries: DataFrame, index: Index, k: int, allowed: DataFrame | None = None, prune_pairs: int | None = None) -> DataFrame:
    """queries: query_id, terms (array). The same rows as retrieval.keyword_topk over the indexed documents; `allowed` (id)
    restricts hits only. prune_pairs: from how many pairs of query and posting on blocks are skipped; the result is the same.
    Unless given, terms that may be sent are scored chunk by chunk, and more than those are joined, with skipping from PRUNE_PAIRS on."""
    terms, rows, postings = _terms(queries, index)
    if rows <= BROADCAST_ROWS and (prune_pairs is None or postings < prune_pairs):
        return best(_by_chunks(index, terms, rows, postings, k, allowed, hit_schema(queries, index.table("docs"))), k)
    if postings < (PRUNE_PAIRS if prune_pairs is None else prune_pairs):
        scored = _scored(index, terms, rows, allowed).select("query_id", "id", F.round("partial", 6).alias("score"))
    else:
        scored, _ = _pruned(_essential(terms, rows, index, k, allowed), rows, index, k, allowed)
    return best(scored, k)


def _pruned(terms: DataFrame, rows: int, index: Index, k: int, allowed: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Scores of the documents that may be among the best, and these with what their essential terms gave."""
    other = terms.where("not essential")
    found = _scored(index, terms.where("essential"), rows, allowed)
    rest = terms.groupBy("query_id").agg(F.sum(F.when(~F.col("essential"), F.col("bound")).otherwise(0.0)).alias("rest")).join(_kth(found, k), "query_id", "left")
    near = found.join(_sent(rest, rows), "query_id").where(F.col("partial") + F.col("rest") >= F.coalesce("floor", F.lit(0.0)))
    # the peak of a term in a document's chunk is a closer bound than that of the term
    peaks = _postings(index, other, rows).select("term", "chunk", "peak")
    chunks = peaks.join(_sent(other.select("query_id", "term", "idf"), rows), "term").groupBy("query_id", "chunk").agg(F.sum(F.col("idf") * F.col("peak")).alias("chunk_rest"))
    near = near.join(chunks, ["query_id", "chunk"], "left").where(F.col("partial") + F.coalesce("chunk_rest", F.lit(0.0)) >= F.coalesce("floor", F.lit(0.0))).select("query_id", "id", "chunk", "partial")
    # a row without a term carries what was found so far, so that the candidates are made once
    itself = terms.select("query_id", F.lit("").alias("term"), F.lit(0.0).alias("idf"), "avgdl").distinct()
    asked = near.join(_sent(other.select("query_id", "term", "idf", "avgdl").unionByName(itself), rows), "query_id")
    blocks = _postings(index, other, rows).select("term", "chunk", "ids", "tfs", "dls")
    met = asked.join(blocks, ["term", "chunk"], "left").withColumn("at", F.array_position("ids", F.col("id")).cast("int"))
    part = F.col("idf") * _impact(F.element_at("tfs", F.col("at")), F.element_at("dls", F.col("at")), F.col("avgdl"))
    part = F.when(F.col("term") == "", F.col("partial")).when(F.col("at") > 0, part).otherwise(0.0)
    return met.groupBy("query_id", "id").agg(F.round(F.sum(part), 6).alias("score")), near


def pairs(queries: DataFrame, index: Index, k: int) -> DataFrame:
    """What a search works on: pairs of query and posting, those of essential terms, and the documents looked up after them."""
    terms, rows, _ = _terms(queries, index)
    terms = _essential(terms, rows, index, k, None)
    _, near = _pruned(terms, rows, index, k, None)
    counts = terms.agg(F.sum("df").alias("all_pairs"), F.sum(F.when(F.col("essential"), F.col("df")).otherwise(0)).alias("essential_pairs"))
    return counts.join(near.agg(F.count(F.lit(1)).alias("looked_up")))


def matched_terms(hits: DataFrame, queries: DataFrame, index: Index) -> DataFrame:
    """query_id, id, matched: how many of the query's terms an indexed document has, from the postings."""
    asked = hits.select("query_id", "id").distinct().join(index.table("docs").select("id", "chunk"), "id")
    words = queries.select("query_id", F.explode(F.array_distinct("terms")).alias("term")).withColumn("bucket", _bucket(F.col("term")))
    rows = words.count()
    blocks = _postings(index, words, rows).select("term", "chunk", "ids")
    met = asked.join(_sent(words.select("query_id", "term"), rows), "query_id").join(blocks, ["term", "chunk"]).where(F.array_contains("ids", F.col("id")))
    count = met.groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("matched"))
    return asked.select("query_id", "id").join(count, ["query_id", "id"], "left").withColumn("matched", F.coalesce("matched", F.lit(0)))
