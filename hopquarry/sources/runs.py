"""Runs on disk: rankings, metrics, latencies, manifests and reports, written and read by Spark."""

from __future__ import annotations

import hashlib
import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RETRIEVED = "method string, qid string, rank int, doc_id string, score double"
LATENCY = "struct<total:double,mean:double,p50:double,p95:double,p99:double>"
RESULT = (
    f"struct<method:string,index_time_sec:double,query_time_sec:double,docs:long,queries:long,metrics:struct<mrr:double,"
    f"recall_at_k:map<string,double>,hit_at_k:map<string,double>>,latency_stats:{LATENCY},rss_peak_mb:double,seed_time_sec:double,"
    "ppr_time_sec:double,fallback_count:long,fallback_rate:double>"
)
CONFIG = "struct<dataset:string,split:string,max_samples:long,tag:string,seed:long>"
#: Digests of one node of a tree of hashes.
FAN = 1000
SEPARATOR = "\x1f"
METRICS = f"config {CONFIG}, results array<{RESULT}>"


def run_id(now: datetime | None = None) -> str:
    return (now or datetime.now(timezone.utc)).strftime("%Y%m%d-%H%M%S")


def output_name(*parts: str, limit: int = 200) -> str:
    """A folder name of the settings; a long one is cut and gets a digest."""
    slug = "_".join(str(p).replace("/", "-") for p in parts if p not in (None, ""))
    return slug if len(slug) <= limit else f"{slug[:180]}_{hashlib.md5(slug.encode()).hexdigest()[:8]}"


def ordered_digest(rows: DataFrame) -> str:
    """A digest of ``rows`` (at, digest) in order of ``at``: a tree of hashes over ranges of places.

    The places' range is cut in ``FAN`` equal parts a level, so for numbered rows no task holds more than
    ``FAN`` digests at once; equal places are in order of their digests.
    """
    span = rows.agg(F.min("at").alias("low"), F.max("at").alias("high"), F.count("*").alias("n")).first()
    if not span["n"]:
        return hashlib.sha256(b"").hexdigest()
    # places are scaled to as many buckets as there are rows
    width = max(1, -(-(span["high"] - span["low"] + 1) // span["n"]))
    level = rows.select(F.expr(f"(at - {span['low']}) div {width}").alias("at"), "digest")
    size = (span["high"] - span["low"]) // width + 1
    while True:
        bucket = F.expr(f"at div {FAN}").alias("bucket")
        ordered = F.transform(F.sort_array(F.collect_list(F.struct("at", "digest"))), lambda x: x["digest"])
        level = level.groupBy(bucket).agg(F.sha2(F.concat_ws("", ordered), 256).alias("digest")).select(F.col("bucket").alias("at"), "digest")
        size = -(-size // FAN)
        if size <= 1:
            return level.first()["digest"]


def content_key(model: str, docs: DataFrame) -> str:
    """A digest of the model and of all documents in order."""
    rows = docs.select(F.col("doc_idx").cast("long").alias("at"), F.sha2(F.concat_ws(SEPARATOR, "doc_id", "text"), 256).alias("digest"))
    return hashlib.sha256(f"{model}{SEPARATOR}{ordered_digest(rows)}".encode()).hexdigest()[:16]


def write_corpus(docs: DataFrame, queries: DataFrame, path: str) -> None:
    docs.select("doc_id", "title", "text").write.mode("overwrite").json(f"{path}/docs.jsonl")
    queries.write.mode("overwrite").json(f"{path}/queries.jsonl")


def write_retrieved(retrieved: DataFrame, path: str) -> None:
    """Rankings, one folder per method, so that readers prune."""
    retrieved.write.mode("overwrite").partitionBy("method").parquet(f"{path}/retrieved")


def read_retrieved(spark: SparkSession, path: str, methods: list[str] | None = None) -> DataFrame:
    rows = spark.read.parquet(f"{path}/retrieved")
    return rows.where(F.col("method").isin(methods)) if methods else rows


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_metrics(spark: SparkSession, config: dict, results: list[dict], path: str) -> None:
    row = spark.createDataFrame([(json.dumps({"config": config, "results": results}),)], "value string")
    row = row.select(F.from_json("value", METRICS).alias("m")).select("m.*")
    row.write.mode("overwrite").json(f"{path}/metrics.json")


def read_metrics(spark: SparkSession, pattern: str) -> DataFrame:
    """One row per run and method: the settings, times, and metric maps."""
    raw = spark.read.schema(METRICS).option("multiLine", True).json(pattern).select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("run_mtime"))
    rows = raw.select("file", "run_mtime", "config.*", F.explode("results").alias("r"))
    return rows.select(
        F.regexp_replace("file", "/metrics.json.*$", "").alias("run_dir"), "run_mtime", "dataset", "split", "max_samples", "tag",
        "r.method", "r.index_time_sec", "r.query_time_sec", "r.docs", "r.queries", "r.metrics.mrr", "r.metrics.recall_at_k", "r.metrics.hit_at_k",
        "r.latency_stats", "r.seed_time_sec", "r.ppr_time_sec", "r.fallback_count", "r.fallback_rate",
    )


def append_manifest(spark: SparkSession, entry: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(entry, sort_keys=True),)], "value string").write.mode("append").text(path)


def read_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def rebuild_manifest(spark: SparkSession, meta: DataFrame, metrics: DataFrame) -> DataFrame:
    """Run settings: those of the run's own description, else of its metrics."""
    other = metrics.join(meta, "run_dir", "left_anti")
    return meta.unionByName(other, allowMissingColumns=True)


def read_csv(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Several tables as one, with the file that each row comes from."""
    frames = [spark.read.schema(schema).option("header", True).csv(p).withColumn("source_dir", F.lit(p)) for p in paths]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def append_csv(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).csv(path)


def latex_table(rows: list[dict], columns: dict[str, str], digits: int = 3) -> str:
    """A table of a few collected rows."""

    def cell(value) -> str:
        if isinstance(value, float):
            return f"{value:.{digits}f}"
        return "" if value is None else str(value).replace("_", r"\_")

    lines = [rf"\begin{{tabular}}{{{'l' * len(columns)}}}", " & ".join(columns.values()) + r" \\", r"\hline"]
    lines += [" & ".join(cell(r.get(c)) for c in columns) + r" \\" for r in rows]
    return "\n".join([*lines, r"\end{tabular}"])
