"""Conversion of records as they arrive: the lift is stateless once the annotation is joined, so a stream of files needs no more."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from loomspan.operators.lift import lift


def convert_stream(reads: DataFrame, tx: DataFrame, names: DataFrame, **options) -> DataFrame:
    """A streaming DataFrame of reads to one of lifted records; tx and names (rname, tx_id) are static."""
    return lift(reads.join(names, "rname"), tx, **options).where("status = 'converted'")


def write_stream(lifted: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """To Parquet, with exactly-once files."""
    writer = lifted.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
