"""Test views: the reference's table shapes built from the driver's star schema.

Each view is a lazy DataFrame over the parquet tables, so its size grows with the
data. The same definitions are mirrored in SQL in ``oracle_views.py``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _rep_letter(flag: Column) -> Column:
    return (F.when(flag == "A", "A").when(flag == "N", "B").otherwise("C"))


def _base_rows(spark: SparkSession, d: str) -> DataFrame:
    """lineitem x supplier, every row; keeps helper columns. Some nations' replicates and
    some parts are relabelled, so that bottles have one, two or three replicates and some
    hashes are seen mostly in controls."""
    li = table(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_discount", "l_tax", "l_returnflag", "l_shipdate")
    su = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    j = li.join(su, li.l_suppkey == su.s_suppkey)
    k = F.col("l_orderkey") % 3 + 1
    nat = F.col("s_nationkey")
    control = F.col("l_suppkey") % 10 == 0
    rare = (F.col("l_partkey") % 50 == 0) & (F.col("l_orderkey") % 20 != 0)
    return (j.withColumn("is_control", control)
            .withColumn("k", F.when(~control & (nat % 11 == 2), 1)
                        .when(~control & (nat % 7 == 1) & (k == 3), 2).otherwise(k).cast("int"))
            .withColumn("l_partkey", F.when(~control & rare, F.col("l_partkey") - 1).otherwise(F.col("l_partkey")))
            .withColumn("site", F.lpad(nat.cast("string"), 2, "0"))
            .withColumn("yyyy", F.year("l_shipdate").cast("string"))
            .withColumn("biol", _rep_letter(F.col("l_returnflag"))))


def reads(spark: SparkSession, d: str) -> DataFrame:
    """(run int, sample string, hash string, n_reads bigint)."""
    b = _base_rows(spark, d)
    sample = F.when(F.col("is_control"), F.concat(F.lit("Kangaroo."), F.col("k").cast("string"))) \
        .otherwise(F.concat(F.col("site"), F.lit("_"), F.col("yyyy"), F.lit("01"), F.col("biol"),
                            F.lit("."), F.col("k").cast("string")))
    return b.select(F.col("l_linenumber").alias("run"), sample.alias("sample"),
                    F.col("l_partkey").cast("string").alias("hash"),
                    F.col("l_quantity").cast("bigint").alias("n_reads"))


def dirty_ids(spark: SparkSession, d: str) -> DataFrame:
    """Distinct (sample) strings carrying the five kinds of damage the id cleaner fixes."""
    b = _base_rows(spark, d)
    m = F.col("l_orderkey") % 6
    kk = F.col("k").cast("string")
    letters = F.concat(F.substring("site", 1, 1), F.substring("site", 2, 1))
    letters = F.translate(letters, "0123456789", "ABCDEFGHIJ")
    env_sample = (
        F.when(m == 0, F.concat("site", F.lit("_"), "yyyy", F.lit("0115"), "biol", F.lit("."), kk))
        .when(m == 1, F.concat("site", F.lit("_"), "yyyy", F.lit("01_"), "biol", F.lit("."), kk))
        .when(m == 2, F.concat(letters, "yyyy", F.lit("01"), "biol", F.lit("."), kk))
        .otherwise(F.concat("site", F.lit("_"), "yyyy", F.lit("01"), "biol", F.lit("."), kk)))
    ctl_sample = (F.when(m == 3, F.concat(F.lit("Ostrich"), kk))
                  .when(m == 4, F.lit("Kangaroo.4"))
                  .otherwise(F.concat(F.lit("Kangaroo."), kk)))
    return (b.select(F.when(F.col("is_control"), ctl_sample).otherwise(env_sample).alias("sample"))
            .distinct())


def taxonomy(spark: SparkSession, d: str) -> DataFrame:
    """(hash, kingdom, phylum, family, genus, species) with nulls at fine ranks."""
    p = table(spark, d, "part")
    pk = F.col("p_partkey")
    return p.select(
        pk.cast("string").alias("hash"),
        F.when(pk % 35 == 0, None).otherwise(F.concat(F.lit("K"), (F.col("p_size") / 10).cast("int").cast("string"))).alias("kingdom"),
        F.when(pk % 35 == 0, None).otherwise(F.concat(F.lit("P"), F.col("p_size").cast("string"))).alias("phylum"),
        F.when(pk % 35 == 0, None).otherwise(F.col("p_brand")).alias("family"),
        F.when(pk % 10 == 0, None).otherwise(F.col("p_type")).alias("genus"),
        F.when(pk % 5 == 0, None).otherwise(F.col("p_name")).alias("species"))


def traits(spark: SparkSession, d: str) -> DataFrame:
    """Distinct (species, genus, family, trait_a, trait_b) of all parts; the names of two
    thirds of them are not those of the taxonomy."""
    p = table(spark, d, "part")
    pk = F.col("p_partkey")
    other = pk % 3 != 0
    return p.select(
        F.when(pk % 5 == 0, None).when(other, F.concat("p_name", F.lit(" var"))).otherwise(F.col("p_name")).alias("species"),
        F.when(pk % 10 == 0, None).when(other, F.concat("p_type", F.lit(" var"))).otherwise(F.col("p_type")).alias("genus"),
        F.when(other, F.concat("p_brand", F.lit(" var"))).otherwise(F.col("p_brand")).alias("family"),
        F.concat(F.lit("T"), (F.col("p_size") % 4).cast("string")).alias("trait_a"),
        F.concat(F.lit("L"), (F.col("p_size") % 3).cast("string")).alias("trait_b")).distinct()


def env(spark: SparkSession, d: str) -> DataFrame:
    """(site, date, area, temperature, ph, salinity) per (nation, ship year)."""
    b = _base_rows(spark, d).where(~F.col("is_control"))
    g = b.groupBy("s_nationkey", "site", "yyyy").agg(
        (F.avg("l_discount") * 200).alias("temperature"),
        (F.lit(8.5) - F.avg("l_tax") * 10).alias("ph"),
        F.avg("l_quantity").alias("salinity"))
    nat = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    reg = table(spark, d, "region").select("r_regionkey", "r_name")
    g = g.join(nat, g.s_nationkey == nat.n_nationkey).join(reg, F.col("n_regionkey") == F.col("r_regionkey"))
    return g.select(
        "site",
        F.to_date(F.concat("yyyy", F.lit("-01-01"))).alias("date"),
        F.col("r_name").alias("area"),
        "temperature",
        F.when(F.col("s_nationkey") % 9 == 4, None).otherwise(F.col("ph")).alias("ph"),
        "salinity")


#: The letters of a text as bases, in turn.
BASE_LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
BASES = ("ACGT" * 13)


def hash_key(spark: SparkSession, d: str) -> DataFrame:
    """(hash, sequence): every letter A-Z of the whole text as a base, after one A."""
    doc = table(spark, d, "documents").select("doc_id", "text")
    return doc.select(F.col("doc_id").cast("string").alias("hash"),
                      F.concat(F.lit("A"), F.translate(F.regexp_replace("text", "[^A-Za-z]", ""), BASE_LETTERS, BASES)).alias("sequence"))


LINEAGE_RANKS = ["kingdom", "phylum", "family", "genus", "species"]


def lineage(spark: SparkSession, d: str) -> DataFrame:
    """(key, rank, name) rows; one extra 'no rank' row per key."""
    t = taxonomy(spark, d).withColumn("no rank", F.lit("cellular organisms"))
    cols = LINEAGE_RANKS + ["no rank"]
    return (t.unpivot("hash", cols, "rank", "name")
            .where(F.col("name").isNotNull())
            .withColumnRenamed("hash", "key"))


CLASSIFIER_LEVELS = [(0.95, 2), (0.9, 3), (0.85, 5), (0.8, 7)]


def classifier(spark: SparkSession, d: str, level: int) -> DataFrame:
    """Classifier output at one threshold: empty strings where it could not decide."""
    thr, m = CLASSIFIER_LEVELS[level]
    p = table(spark, d, "part")
    pk = F.col("p_partkey")
    ok = pk % m == 0
    return p.select(pk.cast("string").alias("hash"),
                    F.when(ok, F.col("p_brand")).otherwise(F.lit("")).alias("family"),
                    F.when(ok & (pk % 4 != 0), F.col("p_name")).otherwise(F.lit("")).alias("species"),
                    F.lit(thr).alias("threshold"))


def coef(spark: SparkSession, d: str) -> DataFrame:
    """(taxon, area, intercept, b_t, b_ph) for every taxon seen in an area.

    A fixed formula of the key, so projections need no fit; the (taxon, area) pairs
    come from the data (reads joined to env on site), so the table grows with it.
    """
    r = reads(spark, d).where(~F.col("sample").startswith("Kangaroo"))
    r = r.select("hash", F.substring_index("sample", "_", 1).alias("site")).distinct()
    areas = env(spark, d).select("site", "area").distinct()
    pairs = r.join(areas, "site").select(F.col("hash").alias("taxon"), "area").distinct()
    pk = F.col("taxon").cast("bigint")
    return pairs.select(
        "taxon", "area",
        ((pk % 7 - 3) / 2.0).alias("intercept"),
        ((pk % 5 - 2) / 10.0).alias("b_t"),
        ((pk % 3 - 1) / 2.0 + F.length("area") / 100.0).alias("b_ph"))


def unite(cols: list[str], sep: str = "|") -> Column:
    return F.concat_ws(sep, *[F.coalesce(F.col(c), F.lit("NA")) for c in cols])


def union_all(dfs: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)
