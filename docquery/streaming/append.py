"""Files that arrive in a folder, taken into a dataset exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from docquery.sources.catalog import Catalog


def follow(spark: SparkSession, folder: str, schema: StructType, root: str, name: str, progress: str, form: str = "json", forever: bool = False) -> StreamingQuery:
    """Append each new file's documents to dataset ``name``; ``progress`` is the folder of the stream's checkpoint.

    A batch has one source name, so a batch that is run again after a failure replaces its own rows.
    """
    catalog = Catalog(spark, root)
    reader = spark.readStream.schema(schema)
    stream = reader.csv(folder, header=True) if form == "csv" else reader.json(folder)

    def take(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            catalog.append(name, batch, f"stream-{number}")

    writer = stream.writeStream.foreachBatch(take).option("checkpointLocation", progress)
    return (writer if forever else writer.trigger(availableNow=True)).start()
