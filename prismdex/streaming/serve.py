"""Requests answered as they arrive: each micro-batch is one search or suggest job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from prismdex.operators.response import assemble, suggestions_json, to_response_json
from prismdex.operators.suggest import suggest
from prismdex.plans.index import Index
from prismdex.plans.search import browse


def answer_stream(requests: DataFrame, answer: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str,
                  trigger: dict | None = None) -> StreamingQuery:
    """Write `answer(batch)` of every batch of requests to its own folder under `sink`.

    A batch that is run again after a failure replaces its folder: every request is
    answered exactly once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        answer(batch).write.mode("overwrite").json(f"{sink}/batch={batch_id}")

    writer = requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def serve_search(requests: DataFrame, index: Index, sink: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Answer a stream of (query_id, phrase) with the JSON of page and facets."""

    def answer(batch: DataFrame) -> DataFrame:
        found = browse(index, batch, keep=True)
        return to_response_json(assemble(batch, found.hits, found.facets, index.cfg.text, index.cfg.facets))

    return answer_stream(requests, answer, sink, checkpoint, trigger)


def serve_suggestions(requests: DataFrame, suggestions: DataFrame, sink: str, checkpoint: str,
                      trigger: dict | None = None, best: DataFrame | None = None) -> StreamingQuery:
    """Answer a stream of (input_id, text) with JSON arrays of suggested words, from the kept best ones if given."""
    return answer_stream(requests, lambda batch: suggestions_json(batch, suggest(suggestions, batch, best=best)), sink, checkpoint, trigger)
