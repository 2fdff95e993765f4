"""Documents as they arrive: a stream of text rows through the batch plans, written once a micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quire.sources.corpus import Corpus

DOCUMENT = "doc_id long, text string, lang string, source string"


class Batch(Corpus):
    """A corpus over rows that are already at hand."""

    def __init__(self, documents: DataFrame):
        super().__init__(documents.sparkSession, "")
        self.__dict__["documents"] = documents.select("doc_id", "text", "lang", "source")


def follow(spark: SparkSession, path: str, plan: Callable[[Corpus], DataFrame], out: str, checkpoint: str, schema: str = DOCUMENT, files_per_batch: int = 1000) -> StreamingQuery:
    """Runs a plan over the Parquet files that arrive below a path.

    A batch goes to a folder of its own number, overwritten if the batch is run again after a failure,
    so its findings are there once. Documents are independent of each other; no state is kept.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)

    def write(batch: DataFrame, number: int) -> None:
        plan(Batch(batch)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
