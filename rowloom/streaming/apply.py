"""Run a fitted, stateless transform over a stream: scaling, encoding, cleaning, packing, embedding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def write_transformed(
    stream: DataFrame,
    transform: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str,
    once: bool = False,
    format: str = "parquet",
) -> StreamingQuery:
    """Append the transformed rows of ``stream`` to ``path``; ``once`` handles what is there and stops."""
    writer = transform(stream).writeStream.format(format).outputMode("append").option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)
