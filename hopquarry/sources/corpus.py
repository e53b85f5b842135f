"""Corpora: documents, questions and gold titles as frames with explicit schemas."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..deploy import ship_code
from ..functions.text import extract_entities, join_sentences, normalize_whitespace

DOCS = "doc_id string, title string, text string"
QUERIES = "qid string, question string, gold_titles array<string>"
#: Context of multi-hop questions: titles with their sentences.
HOTPOT = "id string, question string, answer string, supporting_facts struct<title:array<string>>, context struct<title:array<string>, sentences:array<array<string>>>"

#: Words of a question that are looked up together, or characters of one too short for that.
ANCHOR = 5


@dataclass
class Corpus:
    """``docs`` (doc_idx, doc_id, title, text), ``queries`` (qid, question), ``gold`` (qid, doc_id)."""

    docs: DataFrame
    queries: DataFrame
    gold: DataFrame


def cleaned(docs: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """White space made single in texts and questions, not in ids and titles."""
    return (
        docs.withColumn("text", normalize_whitespace(F.col("text"))),
        queries.withColumn("question", normalize_whitespace(F.col("question"))),
    )


def with_doc_idx(docs: DataFrame, order: str = "doc_id") -> DataFrame:
    """Number documents from 0 in order of ``order``: positions in buckets of a range, then shifted.

    Only the ids are sorted as a whole (their count per range is small), not the texts.
    """
    ranged = docs.select(order).repartitionByRange(order).select(order, F.spark_partition_id().alias("part"))
    sizes = ranged.groupBy("part").count()
    shift = F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    numbered = ranged.withColumn("place", place).join(F.broadcast(sizes.select("part", shift.alias("shift"))), "part")
    return docs.join(numbered.select(order, (F.col("place") + F.col("shift")).cast("long").alias("doc_idx")), order)


def sample_queries(queries: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``n`` questions, the same ones each time: those with the least hashes."""
    return queries.orderBy(F.xxhash64("qid", F.lit(seed)), "qid").limit(n)


def read_multihop(spark: SparkSession, path: str, max_samples: int | None = None, seed: int = 42) -> Corpus:
    """Questions with paragraphs of their own (HotpotQA and 2WikiMultihopQA, as JSON lines or Parquet).

    A title that several questions bring along is one document: the first.
    """
    reader = spark.read.schema(HOTPOT)
    raw = reader.parquet(path) if path.endswith(".parquet") else reader.json(path)
    if max_samples:
        raw = sample_queries(raw.withColumnRenamed("id", "qid"), max_samples, seed).withColumnRenamed("qid", "id")
    paragraphs = raw.select("id", F.posexplode(F.arrays_zip("context.title", "context.sentences")).alias("pos", "p"))
    firsts = paragraphs.groupBy(F.col("p.title").alias("doc_id")).agg(F.min_by(F.struct("p.sentences"), F.struct("id", "pos"))["sentences"].alias("s"))
    docs = firsts.select("doc_id", F.col("doc_id").alias("title"), join_sentences(F.col("s")).alias("text"))
    queries = raw.select(F.col("id").alias("qid"), "question", F.array_distinct("supporting_facts.title").alias("gold_titles"))
    docs, queries = cleaned(docs, queries)
    return Corpus(with_doc_idx(docs), queries.drop("gold_titles"), queries.select("qid", F.explode("gold_titles").alias("doc_id")))


def read_jsonl(spark: SparkSession, docs: str, queries: str) -> Corpus:
    """``docs.jsonl`` and ``queries.jsonl``; blank lines are skipped, gold titles count once."""
    d = spark.read.schema(DOCS).json(docs).where("doc_id is not null")
    q = spark.read.schema(QUERIES).json(queries).where("qid is not null")
    d, q = cleaned(d, q)
    gold = q.select("qid", F.explode(F.array_distinct("gold_titles")).alias("doc_id"))
    return Corpus(with_doc_idx(d), q.drop("gold_titles"), gold)


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("id string, answer string").json(path)
    return rows.where("id is not null").select(F.col("id").alias("qid"), "answer")


def _runs(items: Column) -> Column:
    """What starts at each place: ``ANCHOR`` items, nulls after the last."""
    fields = ", ".join(f"c{i}: string" for i in range(1, ANCHOR + 1))
    return F.arrays_zip(*[F.slice(items, i, F.size(items)) for i in range(1, ANCHOR + 1)]).cast(f"array<struct<{fields}>>")


def _longest(items: Column, n: Column) -> Column:
    """Of all runs of ``n`` items, the one with most characters."""
    starts = F.sequence(F.lit(1), F.size(items) - n + 1)
    return F.array_max(F.transform(starts, lambda at: F.struct(F.length(F.array_join(F.slice(items, at, n), " ")).alias("length"), F.slice(items, at, n).alias("run"))))["run"]


def containing(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """``qid, doc_idx, doc_id``: the documents whose text contains a question's, as it stands.

    Where a text contains a question, all words of the question but the first and last stand whole in it.  The
    longest run of up to ``ANCHOR`` of them is the question's anchor; a question of fewer than three words has its
    first characters instead.  Documents meet questions by hashes of anchors, and texts are compared
    only for the pairs found, so no pair is lost and none is wrong.  An empty question is in every text;
    null questions and texts, and documents without a number, are in no pair.  Repeated rows count as often as they stand there.
    """
    words = queries.where("question is not null").select("qid", "question", F.split("question", " ").alias("words"))
    inner = words.select("qid", "question", F.expr("slice(words, 2, greatest(size(words) - 2, 0))").alias("inner"))
    inner = inner.select("*", (F.size("inner") == 0).alias("short"), F.least(F.lit(ANCHOR), F.size("inner")).alias("n"))
    chars = F.slice(F.split("question", ""), F.lit(1), F.least(F.lit(ANCHOR), F.length("question")))
    anchors = inner.select("qid", "short", F.when(F.col("short"), chars).otherwise(_longest(F.col("inner"), F.col("n"))).alias("run"))
    anchors = anchors.select("qid", "short", F.size("run").alias("n"), F.xxhash64("run").alias("anchor"))
    # the few lengths that anchors have, and whether any is of characters: texts are cut into such runs only
    lengths, short = anchors.agg(F.collect_set("n")).scalar(), anchors.agg(F.max("short")).scalar()
    texts = docs.select("doc_idx", "text", lengths.alias("lengths"), short.alias("short"))
    parts = texts.select("doc_idx", "lengths", "short", F.split("text", " ").alias("words"), F.when(F.col("short"), F.split("text", "")).alias("chars"))
    places = F.when(F.col("short"), F.concat(_runs(F.col("words")), _runs(F.col("chars")))).otherwise(_runs(F.col("words")))
    runs = parts.select("doc_idx", "lengths", F.explode(places).alias("run")).select("doc_idx", "run", F.explode("lengths").alias("n"))
    # a hash of several columns is that of an array with the same items
    anchor = F.xxhash64(F.array().cast("array<string>"))
    for n in range(1, ANCHOR + 1):
        anchor = F.when(F.col("n") == n, F.xxhash64(*[f"run.c{i}" for i in range(1, n + 1)])).otherwise(anchor)
    pairs = runs.select("doc_idx", anchor.alias("anchor")).join(anchors.select("qid", "anchor"), "anchor").select("doc_idx", "qid").distinct()
    both = docs.select("doc_idx", "doc_id", "text").join(pairs, "doc_idx").join(queries.select("qid", "question"), "qid")
    return both.where(F.contains("text", "question")).select("qid", "doc_idx", "doc_id")


def read_tables(spark: SparkSession, sf_dir: str) -> Corpus:
    """The test tables as a corpus: ``documents``, with ``benchmark`` as questions.

    A document is gold for a question whose text it contains.
    """
    ship_code(spark)
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    docs = documents.select(
        F.col("doc_id").alias("doc_idx"), F.col("doc_id").cast("string").alias("doc_id"), "lang", normalize_whitespace(F.col("text")).alias("text")
    )
    first = F.get(extract_entities(F.col("text")), F.lit(0))
    docs = docs.withColumn("title", F.concat(F.coalesce(first, F.lit("Untitled")), F.lit(" ("), F.col("lang"), F.lit(")")))
    queries = benchmark.select(F.col("item_id").alias("qid"), normalize_whitespace(F.col("text")).alias("question"))
    return Corpus(docs.select("doc_idx", "doc_id", "title", "text"), queries, containing(docs, queries))


SOURCES: dict[str, Callable[..., Corpus]] = {
    "hotpotqa": read_multihop,
    "2wikimultihopqa": read_multihop,
    "tables": read_tables,
}


def load(name: str, spark: SparkSession, path: str, **options) -> Corpus:
    if name not in SOURCES:
        raise ValueError(f"unknown dataset: {name}")
    return SOURCES[name](spark, path, **options)
