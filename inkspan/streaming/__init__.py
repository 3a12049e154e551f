"""Analysis of a stream of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame

from inkspan.operators.features import analyze
from inkspan.operators.inventory import top_items


def analyze_stream(stream: DataFrame, text: str = "text") -> DataFrame:
    """The analysis record of each text of a stream: a projection without state, so any output mode and trigger will do."""
    return analyze(stream, text)


def top_items_sink(path: str, items, keys: list[str], k: int = 20):
    """A foreachBatch function that appends each batch's inventories; a batch that is repeated replaces its own part."""

    def write(batch: DataFrame, batch_id: int) -> None:
        top_items(batch, items, keys, k).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write
