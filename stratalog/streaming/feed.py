"""Streams as changes: every micro-batch becomes one atomic batch of an engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stratalog.engine import Engine, external_column
from stratalog.operators.body import Relation


def feed(stream: DataFrame, engine: Engine, predicate: str, checkpoint: str, columns: list[str] | None = None, deleted: str | None = None, **trigger: object) -> StreamingQuery:
    """Assert a streaming DataFrame's rows as facts of ``predicate``; rows where the column ``deleted`` is true are retracted.

    Batches are sets, and deletions come before insertions, so a batch that is delivered twice changes nothing the second
    time. Recursive predicates over them are maintained when they are next asked for. ``trigger``: as of writeStream.
    """
    columns = columns or [c for c in stream.columns if c != deleted]
    picked = [external_column(F.col(f"`{c}`"), stream.schema[c].dataType) for c in columns]
    types = tuple(t for _, t in picked)
    key = (predicate, len(columns))

    def take(batch: DataFrame, number: int) -> None:
        rows = batch.select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(picked)], (F.coalesce(F.col(f"`{deleted}`"), F.lit(False)) if deleted else F.lit(False)).alias("_gone")).na.drop()
        gone = Relation(rows.where("_gone").drop("_gone").distinct(), types)
        new = Relation(rows.where("NOT _gone").drop("_gone").distinct(), types)
        engine.apply_changes({key: new}, {key: gone} if deleted else {})

    writer = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
