"""Questions that arrive as a stream, scored against a static index in micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import lexical


def score_stream(questions: DataFrame, index: lexical.LexicalIndex, k: int, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Score each micro-batch of ``questions`` (qid, question) and hand the hits to ``sink`` with the batch's number."""

    def run(batch: DataFrame, number: int) -> None:
        sink(lexical.search(index, lexical.query_terms(batch), batch, k), number)

    writer = questions.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.start()
