"""Nodes over streams: the same stateless transformations, run by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tessera.plans import Node
from tessera.schema import Schema, schema_of


def read_files(spark: SparkSession, schema: type | Schema, path: str, kind: str = "parquet", **options: object) -> DataFrame:
    """New files of a folder as a stream of rows of a declared schema."""
    return spark.readStream.schema(schema_of(schema).struct).options(**options).format(kind).load(path)


def run_node(node: Node, rows: DataFrame, path: str, checkpoint: str, kind: str = "parquet", **options: object) -> StreamingQuery:
    """Starts a node of one input over a stream: what is there now is transformed and appended to a folder, once each, and
    the query ends. Started again with the same checkpoint, it goes on with what is new."""
    made = node.transform(rows)
    if not made.isStreaming:
        raise ValueError("the node gave no stream")
    writer = made.writeStream.format(kind).options(**options).option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(availableNow=True).start(path)
