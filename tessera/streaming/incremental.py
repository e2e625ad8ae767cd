"""Verification of a stream: each micro-batch's state is stored under its batch id and metrics come from merging all.

A batch that is run again after a failure replaces its own state, so every row counts once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..checks import Check, DetectionResult, evaluate
from ..plans.runner import AnalyzerContext
from ..repository import StateProvider


def monitor(stream: DataFrame, provider: StateProvider, *, checkpoint: str, checks: Iterable[Check] = (), on_result: Callable[[int, AnalyzerContext, DetectionResult], None] | None = None, trigger: dict[str, object] | None = None) -> StreamingQuery:
    """Starts the query; ``on_result`` gets the metrics of everything seen so far after each batch."""
    asked = list(checks)

    def batch(df: DataFrame, batch_id: int) -> None:
        provider.persist(df, batch_id)
        if on_result is not None:
            context = provider.compute()
            on_result(batch_id, context, evaluate(df.sparkSession, asked, context))

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()  # type: ignore[arg-type]
