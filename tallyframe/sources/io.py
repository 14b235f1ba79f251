"""Sources and sinks: run folders, heterogeneous CSVs, typed tables, FASTA, checkpoints."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators._util import as_list


def read_runs(spark: SparkSession, root: str, file_name: str, schema=None,
              run_pattern: str = r"Run_(\d+)", sep: str = ",", header: bool = True) -> DataFrame:
    """Read every ``file_name`` under ``root`` (recursively) as one table and tag each
    row with the run number taken from its folder name (not from file order)."""
    r = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", file_name) \
        .option("header", str(header).lower()).option("sep", sep).option("nullValue", "NA")
    r = r.schema(schema) if schema is not None else r.option("inferSchema", "true")
    df = r.csv(root)
    return df.withColumn("run", F.regexp_extract(F.col("_metadata.file_path"), run_pattern, 1).cast("int"))


def read_union(spark: SparkSession, paths, cols, sep: str = ",") -> DataFrame:
    """CSVs whose headers differ, as one table of ``cols`` (missing ones null). Each
    row keeps its file's path in ``source_file``.

    One job over all files finds every header: the first line with text of a file's first
    block. The values are read by position in one scan and meet a table of one row per file,
    which says where each wanted column stands there. Of two columns with one name in a
    header the first counts; files without a header have no rows; short rows end in nulls.
    """
    paths = as_list(paths)
    first = (spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("source_file"),
                                           F.col("_metadata.file_block_start").alias("__at"))
             .where((F.col("__at") == 0) & (F.trim("value") != ""))
             .withColumn("__line", F.monotonically_increasing_id())  # in order inside a block
             .groupBy("source_file").agg(F.min_by("value", "__line").alias("header")))
    width = first.agg(F.max(F.size(F.split("header", re.escape(sep), -1)))).first()[0] or 1
    fields = ", ".join(f"`{i}` string" for i in range(width))
    names = F.from_csv(F.regexp_replace("header", "^\ufeff", ""), fields, {"sep": sep})
    where = first.select("source_file", F.array(*[names[str(i)] for i in range(width)]).alias("__h"))
    where = where.select("source_file", *[F.array_position("__h", c).alias(f"__p{i}") for i, c in enumerate(cols)])
    values = (spark.read.schema(fields).option("header", "true").option("sep", sep).option("nullValue", "NA").csv(paths)
              .select(F.array(*[F.col(f"`{i}`") for i in range(width)]).alias("__v"),
                      F.col("_metadata.file_path").alias("source_file")))
    return values.join(where, "source_file").select(
        *[F.try_element_at("__v", F.nullif(F.col(f"__p{i}"), F.lit(0)).cast("int")).alias(c) for i, c in enumerate(cols)],
        "source_file")


def read_table(spark: SparkSession, path: str, schema, sep: str = ",", header: bool = True,
               na: str = "NA", date_format: str | None = None) -> DataFrame:
    """S3: CSV/TSV/headerless text with a given schema; ``na`` strings become null.
    String fields are trimmed so padded numbers cast cleanly."""
    r = (spark.read.schema(schema).option("sep", sep).option("header", str(header).lower())
         .option("nullValue", na).option("ignoreLeadingWhiteSpace", "true")
         .option("ignoreTrailingWhiteSpace", "true").option("mode", "PERMISSIVE"))
    if date_format:
        r = r.option("dateFormat", date_format)
    return r.csv(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by=None,
                mode: str = "overwrite") -> None:
    """Write a result (parquet by default; csv with a header)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*as_list(partition_by))
    if fmt == "csv":
        w.option("header", "true").option("nullValue", "NA").csv(path)
    else:
        w.format(fmt).save(path)


def fasta_records(df: DataFrame, id_col: str = "hash", seq_col: str = "sequence") -> DataFrame:
    """Two-line FASTA records ``>id\\nseq`` (one string per record)."""
    return df.select(F.concat(F.lit(">"), F.col(id_col), F.lit("\n"), F.col(seq_col)).alias("record"))


def write_fasta(df: DataFrame, path: str, id_col: str = "hash", seq_col: str = "sequence") -> None:
    """Write FASTA text files (one part file per partition)."""
    fasta_records(df, id_col, seq_col).write.mode("overwrite").text(path)


def stage_checkpoint(df: DataFrame, path: str) -> DataFrame:
    """Save an intermediate as parquet and continue from the saved copy.

    ``path`` must be on shared storage (e.g. below ``spark.checkpoint.dir``); the
    reloaded table has a fresh, short lineage and survives executor loss.
    """
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
