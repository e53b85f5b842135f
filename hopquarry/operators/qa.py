"""Answers to questions read from retrieved documents, and their scores."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..deploy import ship_code
from .metrics import answer_scores

#: Characters of a window, and from one window's start to the next.
WINDOW, STRIDE = 1000, 750
#: Documents and characters of a context.
TOP_DOCS, CONTEXT_CHARS = 5, 4000

Reader = Callable[[list[str], list[str]], list[tuple[str, float]]]


def contexts(retrieved: DataFrame, docs: DataFrame, top_docs: int = TOP_DOCS, limit: int = CONTEXT_CHARS) -> DataFrame:
    """``method, qid, context``: the texts of the best documents in order, cut at ``limit``; none for questions without any text.

    A context holds ``top_docs`` texts, each cut at ``limit``, at most.
    """
    best = retrieved.where(F.col("rank") <= top_docs).join(docs.select("doc_idx", F.substring("text", 1, limit).alias("text")), "doc_idx").where("text != ''")
    texts = F.transform(F.sort_array(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"])
    return best.groupBy("method", "qid").agg(F.substring(F.array_join(texts, "\n"), 1, limit).alias("context"))


def windows(text: Column, size: int = WINDOW, stride: int = STRIDE) -> Column:
    """Overlapping windows of a text, in order; a short text is one."""
    last = F.greatest(F.lit(0), F.ceil((F.length(text) - size) / stride)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.substring(text, k * stride + 1, F.lit(size)))


def read_answers(asked: DataFrame, reader: Reader, size: int = WINDOW, stride: int = STRIDE) -> DataFrame:
    """``method, qid, pred``: the best answer (by score, then by place) of all windows of each ``context``.

    ``reader`` (any extractive model) gets a batch of questions and windows in a
    Python worker and gives an answer and a score for each.
    """
    ship_code(asked.sparkSession)

    @F.pandas_udf("struct<pred: string, score: double>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for questions, texts in batches:
            yield pd.DataFrame(reader(questions.tolist(), texts.tolist()), columns=["pred", "score"])

    cut = asked.select("method", "qid", "question", F.posexplode(windows(F.col("context"), size, stride)).alias("place", "window"))
    found = cut.select("method", "qid", "place", run(F.col("question"), F.col("window")).alias("r"))
    return found.groupBy("method", "qid").agg(F.min_by("r.pred", F.struct(-F.col("r.score"), "place")).alias("pred"))


def evaluate_answers(retrieved: DataFrame, docs: DataFrame, queries: DataFrame, answers: DataFrame, reader: Reader, methods: DataFrame | None = None, compat: bool = False, **cuts: int) -> DataFrame:
    """``method, qid, pred, gold, em, f1``: one row for each method and question that has an answer (qid, answer).

    Without any text to read, the answer is empty.  ``methods`` (method) names the
    methods; without it they are those of ``retrieved``.
    """
    size = {k: cuts.pop(k) for k in ("top_docs", "limit") if k in cuts}
    asked = queries.select("qid", "question").join(answers.select("qid", F.col("answer").alias("gold")).where("gold is not null"), "qid")
    methods = retrieved.select("method").distinct() if methods is None else methods
    read = read_answers(contexts(retrieved, docs, **size).join(asked, "qid"), reader, **cuts)
    every = asked.select("qid", "gold").crossJoin(F.broadcast(methods)).join(read, ["method", "qid"], "left")
    pairs = every.select("method", "qid", F.coalesce("pred", F.lit("")).alias("pred"), "gold")
    return answer_scores(pairs, compat).select("method", "qid", "pred", "gold", "em", "f1")


def answer_means(scored: DataFrame) -> DataFrame:
    """``method, em, f1, n``."""
    return scored.groupBy("method").agg(F.avg("em").alias("em"), F.avg("f1").alias("f1"), F.count("*").alias("n"))


def write_answers(scored: DataFrame, path: str) -> None:
    """Means and single answers of a run as JSON lines."""
    answer_means(scored).coalesce(1).write.mode("overwrite").json(f"{path}/qa_metrics.json")
    scored.write.mode("overwrite").partitionBy("method").json(f"{path}/qa_per_query.json")


def entity_reader(questions: list[str], texts: list[str]) -> list[tuple[str, float]]:
    """A stand-in for a reading model: the window's first capitalised run, by the share of the question's words that the window has."""
    out = []
    for question, text in zip(questions, texts, strict=True):
        words = set(re.split("[ \n]+", question.lower())) - {""}
        found = re.search(r"(?<!\w)[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,3}(?!\w)", text)
        held = len(words & set(re.split("[ \n]+", text.lower()))) / max(1, len(words))
        out.append((found[0], held) if found else ("", -1.0))
    return out

