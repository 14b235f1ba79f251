"""T16 as a stream: classify only keys not seen before and append the results.

Key files arriving in ``source_dir`` are read with Structured Streaming. The keys seen so
far are keyed state in the state store (``dropDuplicates``), so a batch costs what its own
files hold, however many results there are. New keys are looked up in the classifier table
and go to Parquet files through Spark's file sink, whose log commits each epoch once: an
epoch that runs again after a failure, or a restart from ``checkpoint_dir``, adds nothing
twice. For many keys choose the RocksDB state store of the session
(``spark.sql.streaming.stateStore.providerClass``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def classify_new_keys(spark: SparkSession, source_dir: str, key_schema: str, classifier: DataFrame,
                      results_dir: str, checkpoint_dir: str, key: str = "hash",
                      previous: DataFrame | None = None):
    """Start (and return) the streaming query; ``trigger(availableNow=True)`` drains
    the files present now and stops.

    ``previous`` holds results from before the stream (a fixed table, kept elsewhere: the
    sink owns ``results_dir``); its keys are left out. A key without a row in the classifier
    gets nulls, one with several rows all of them; a null key counts as one key.
    """
    keys = spark.readStream.schema(key_schema).parquet(source_dir).select(key)
    if previous is not None:
        keys = keys.join(previous.select(key), key, "left_anti")
    fresh = keys.dropDuplicates([key]).join(classifier, key, "left")
    return (fresh.writeStream.format("parquet").outputMode("append").option("path", results_dir)
            .option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start())
