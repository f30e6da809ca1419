"""Continuous import: CSV files that arrive in a folder become nodes.

Each micro-batch is one import of its own, all or nothing as for a file, and its
number is committed with its rows, so a batch that is run again after a failure
is taken in once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..session import CsvImportConfig, GraphSession
from ..sources import csv


def stream_nodes(graph: GraphSession, table: str, folder: str, checkpoint: str, config: CsvImportConfig | None = None, available_now: bool = False, max_files: int = 100) -> StreamingQuery:
    """Start the import; columns are taken in the order of the table's schema.

    ``available_now`` takes in what is there and ends.
    """
    config = config or CsvImportConfig()
    config.validate()
    schema = graph.catalog.node(table)
    fields = T.StructType([*(T.StructField(f"f{k}", T.StringType()) for k in range(len(schema.columns))), T.StructField(csv.CORRUPT, T.StringType())])
    files = (
        graph.spark.readStream.schema(fields)
        .option("sep", config.delimiter)
        .option("quote", config.quote)
        .option("escape", config.escape)
        .option("header", config.has_header)
        .option("columnNameOfCorruptRecord", csv.CORRUPT)
        .option("maxFilesPerTrigger", max_files)
        .csv(folder)
    )
    name = f"{table}:{folder}"

    def take(batch: DataFrame, epoch: int) -> None:
        if epoch <= graph._epochs.get(name, -1):
            return
        before = dict(graph._epochs)
        graph._epochs[name] = epoch
        try:
            raw = batch.withColumn(csv.ORDINAL, F.monotonically_increasing_id())
            graph._take_nodes(schema, raw, {c.name: F.col(f"f{k}") for k, c in enumerate(schema.columns)}, config, csv.Watch(graph.spark, None, None))
        except Exception:
            graph._epochs = before
            raise

    writer = files.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
