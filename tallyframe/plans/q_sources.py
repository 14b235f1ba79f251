"""Registered queries: sources and sinks round trips.

Each query writes a table derived from the driver data below the shared checkpoint
folder and returns what the reader gives back, so the reader is checked against the
table that was written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ..sources import io as S
from . import chain as C
from . import views as V
from .registry import query


def _scratch(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tallyframe-io/{uuid.uuid4().hex}/{name}"


@query("s1_read_runs", "SELECT run, sample, hash, n_reads FROM reads", ("reads",))
def s1(spark, d):
    path = _scratch(spark, "runs")
    S.write_table(V.reads(spark, d), path, fmt="csv", partition_by="run")
    df = S.read_runs(spark, path, "*.csv", schema="sample string, hash string, n_reads bigint",
                     run_pattern=r"run=(\d+)")
    return df.select("run", "sample", "hash", "n_reads")


@query("s2_read_union", """
SELECT hash, family, genus, NULL::VARCHAR AS species FROM taxonomy WHERE hash < '5'
UNION ALL
SELECT hash, NULL::VARCHAR, genus, species FROM taxonomy WHERE hash >= '5'""", ("taxonomy",))
def s2(spark, d):
    t = V.taxonomy(spark, d)
    # two files with different headers: every row lands in exactly one of them
    even = t.where(F.col("hash") < "5").select("hash", "family", "genus")
    odd = t.where(F.col("hash") >= "5").select("genus", "hash", "species", "kingdom")
    pa, pb = _scratch(spark, "a"), _scratch(spark, "b")
    S.write_table(even, pa, fmt="csv")
    S.write_table(odd, pb, fmt="csv")
    return S.read_union(spark, [pa, pb], ["hash", "family", "genus", "species"]).drop("source_file")


@query("s3_read_table", "SELECT hash, sequence FROM hash_key", ("hash_key",))
def s3(spark, d):
    path = _scratch(spark, "hash_key.tsv")
    (V.hash_key(spark, d).write.mode("overwrite").option("sep", "\t").option("header", "false")
     .option("nullValue", "NA").csv(path))
    return S.read_table(spark, path, "hash string, sequence string", sep="\t", header=False)


@query("s4_write_table", "SELECT * FROM taxonomy", ("taxonomy",))
def s4(spark, d):
    path = _scratch(spark, "taxonomy")
    S.write_table(V.taxonomy(spark, d), path)
    return spark.read.parquet(path)


@query("s6_stage_checkpoint", "SELECT run, sample, hash, n_reads, source FROM collapsed", ("collapsed",))
def s6(spark, d):
    return S.stage_checkpoint(C.collapsed(spark, d), _scratch(spark, "collapsed"))
