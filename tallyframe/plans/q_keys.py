"""Registered queries: key cleaning, parsing, labels and table rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys as K
from ..operators import rules as R
from ..sources import io as S
from . import views as V
from .registry import query


@query("n1_normalize_sample_id", r"""
WITH a AS (SELECT sample AS dirty,
             CASE WHEN length(sample) - length(replace(sample, '_', '')) = 2
                  THEN regexp_replace(sample, '_B', 'B') ELSE sample END AS s FROM dirty_ids),
b AS (SELECT dirty, CASE WHEN regexp_matches(s, 'Ostrich[123]') THEN regexp_replace(s, 'Ostrich', 'Ostrich.')
                         WHEN s = 'Kangaroo.4' THEN 'Kangaroo.3' ELSE s END AS s FROM a),
c AS (SELECT dirty, CASE WHEN regexp_matches(s, '[A-Z][A-Z]\d{4}')
                         THEN regexp_replace(s, '([A-Z][A-Z])(\d{4})', '\1_\2') ELSE s END AS s FROM b),
e AS (SELECT dirty, CASE WHEN regexp_matches(s, '_\d{8}') THEN regexp_replace(s, '_(\d{6})\d{2}', '_\1')
                         ELSE s END AS s FROM c)
SELECT dirty AS sample, s AS clean FROM e""", ("dirty_ids",))
def n1(spark, d):
    return V.dirty_ids(spark, d).select("sample", K.normalize_sample_id("sample").alias("clean"))


@query("n2_pad_tag", r"""
SELECT tag, regexp_replace(tag, '_(\d)$', '_0\1') AS padded FROM (
  SELECT DISTINCT 'Tag_' || CAST(s_suppkey % 12 + 1 AS VARCHAR) AS tag FROM supplier)""")
def n2(spark, d):
    su = V.table(spark, d, "supplier")
    tags = su.select(F.concat(F.lit("Tag_"), (F.col("s_suppkey") % 12 + 1).cast("string")).alias("tag")).distinct()
    return tags.select("tag", K.pad_tag("tag").alias("padded"))


_PARSE_SQL = r"""
p AS (SELECT sample, split_part(sample, '.', 1) AS bottle, regexp_extract(sample, '\.(.*)$', 1) AS tech
      FROM (SELECT DISTINCT sample FROM reads)),
q AS (SELECT *, split_part(bottle, '_', 1) AS site, regexp_extract(bottle, '_(.*)$', 1) AS rest,
             right(bottle, 1) AS biol FROM p),
parsed AS (SELECT sample, site, left(rest, greatest(length(rest) - 1, 0)) AS yyyymm, biol, tech, bottle,
                  site || '_' || left(rest, greatest(length(rest) - 1, 0)) AS event FROM q)
"""


@query("n6_parse_sample", "WITH " + _PARSE_SQL + " SELECT * FROM parsed", ("reads",))
def n6(spark, d):
    s = V.reads(spark, d).select("sample").distinct()
    return K.with_sample_parts(s)


AREA_CODES = {"AFRICA": "AF", "AMERICA": "AM", "ASIA": "AS", "EUROPE": "EU"}
AREA_ORDER = ["EUROPE", "ASIA", "AMERICA", "AFRICA", "MIDDLE EAST"]


@query("n7_recode", """
SELECT DISTINCT site, area,
  CASE area WHEN 'AFRICA' THEN 'AF' WHEN 'AMERICA' THEN 'AM' WHEN 'ASIA' THEN 'AS' WHEN 'EUROPE' THEN 'EU' ELSE area END AS area_code,
  CAST(CASE area WHEN 'EUROPE' THEN 1 WHEN 'ASIA' THEN 2 WHEN 'AMERICA' THEN 3 WHEN 'AFRICA' THEN 4
                 WHEN 'MIDDLE EAST' THEN 5 END AS INTEGER) AS area_rank
FROM env""", ("env",))
def n7(spark, d):
    e = V.env(spark, d)
    return e.select("site", "area", K.recode("area", AREA_CODES).alias("area_code"),
                    K.order_rank("area", AREA_ORDER).alias("area_rank")).distinct()


@query("n8_parse_partial_date", r"""
SELECT yyyymm, strptime(yyyymm || '01', '%Y%m%d')::DATE AS date,
       strftime(strptime(yyyymm || '01', '%Y%m%d'), '%b') AS month,
       CAST(year(strptime(yyyymm || '01', '%Y%m%d')) AS INTEGER) AS year
FROM (SELECT DISTINCT left(regexp_extract(split_part(sample, '.', 1), '_(.*)$', 1),
                           length(regexp_extract(split_part(sample, '.', 1), '_(.*)$', 1)) - 1) AS yyyymm
      FROM reads WHERE NOT starts_with(sample, 'Kangaroo'))""", ("reads",))
def n8(spark, d):
    r = V.reads(spark, d).where(~F.col("sample").startswith("Kangaroo"))
    y = r.select(K.parse_sample("sample")["yyyymm"].alias("yyyymm")).distinct()
    dt = K.parse_partial_date("yyyymm")
    return y.select("yyyymm", dt.alias("date"), F.date_format(dt, "MMM").alias("month"),
                    F.year(dt).alias("year"))


_ENV_COLS = ["site", "date", "area", "temperature", "ph", "salinity"]


@query("n9_quality_report", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) AS n_rows, CAST(count_if({c} IS NULL) AS BIGINT) AS n_null,
        CAST(count_if(CAST({c} AS VARCHAR) = '') AS BIGINT) AS n_empty, count(DISTINCT {c}) AS n_distinct FROM env"""
    for c in _ENV_COLS), ("env",))
def n9(spark, d):
    return R.quality_report(V.env(spark, d), _ENV_COLS)


_LABEL_SQL = """
SELECT hash,
  coalesce(family, 'NA') || '|' || coalesce(genus, 'NA') || '|' || coalesce(species, 'NA') AS taxon,
  CASE WHEN coalesce(species, 'NA') = 'NA' AND coalesce(genus, 'NA') = 'NA' THEN coalesce(family, 'NA') || ' sp.'
       WHEN coalesce(species, 'NA') = 'NA' THEN genus || ' sp.' ELSE species END AS label
FROM taxonomy"""


@query("n10_unite_label", f"""
SELECT hash, taxon, label, split_part(taxon, '|', 1) AS family2, split_part(taxon, '|', 2) AS genus2,
       split_part(taxon, '|', 3) AS species2 FROM ({_LABEL_SQL})""", ("taxonomy",))
def n10(spark, d):
    t = V.taxonomy(spark, d)
    t = t.select("hash", K.unite_label(["family", "genus", "species"]).alias("taxon"),
                 K.display_label("family", "genus", "species").alias("label"))
    parts = K.split_label("taxon", ["family2", "genus2", "species2"])
    return t.withColumns(parts)


SYNONYMS = {"T0": "none", "T1": "low", "L0": "none", "L1": "low"}


@query("n11_standardize_terms", """
SELECT species, genus, family,
  CASE trait_a WHEN 'T0' THEN 'none' WHEN 'T1' THEN 'low' WHEN 'L0' THEN 'none' WHEN 'L1' THEN 'low' ELSE trait_a END AS trait_a,
  CASE trait_b WHEN 'T0' THEN 'none' WHEN 'T1' THEN 'low' WHEN 'L0' THEN 'none' WHEN 'L1' THEN 'low' ELSE trait_b END AS trait_b
FROM traits""", ("traits",))
def n11(spark, d):
    return R.standardize_terms(V.traits(spark, d), ["trait_a", "trait_b"], SYNONYMS)


@query("n12_rule_cascade", """
SELECT hash, CASE WHEN phylum = 'P1' THEN 'BEN'
                  WHEN regexp_matches(coalesce(family, 'NA') || '|' || coalesce(genus, 'NA') || '|' || coalesce(species, 'NA'), 'ECONOMY') THEN 'PLK'
                  WHEN species IS NULL THEN family ELSE 'Unknown' END AS lifestyle
FROM taxonomy""", ("taxonomy",))
def n12(spark, d):
    t = V.taxonomy(spark, d)
    label = K.unite_label(["family", "genus", "species"])
    rules = [(F.col("phylum") == "P1", F.lit("BEN")),
             (label.rlike("ECONOMY"), F.lit("PLK")),
             (F.col("species").isNull(), F.col("family"))]
    return R.rule_cascade(t, "lifestyle", rules, F.lit("Unknown")).select("hash", "lifestyle")


@query("n13_patch_rows", """
SELECT t.hash, t.kingdom, t.phylum, t.family, coalesce(p.genus, t.genus) AS genus,
       coalesce(p.species, t.species) AS species
FROM taxonomy t LEFT JOIN (SELECT CAST(p_partkey AS VARCHAR) AS hash, 'G_' || p_type AS genus,
                                  p_name || ' var.' AS species FROM part WHERE p_size >= 48) p ON t.hash = p.hash""",
       ("taxonomy",))
def n13(spark, d):
    p = V.table(spark, d, "part").where(F.col("p_size") >= 48).select(
        F.col("p_partkey").cast("string").alias("hash"),
        F.concat(F.lit("G_"), "p_type").alias("genus"),
        F.concat("p_name", F.lit(" var.")).alias("species"))
    return R.patch_rows(V.taxonomy(spark, d), p, "hash")


BLANK_PATTERN = r"^(No |Not |In )"


@query("n14_null_pattern", f"""
SELECT conv_id, turn, CASE WHEN regexp_matches(text, '{BLANK_PATTERN}') THEN '' ELSE text END AS text
FROM conversations""")
def n14(spark, d):
    c = V.table(spark, d, "conversations")
    return c.select("conv_id", "turn", K.null_pattern("text", BLANK_PATTERN).alias("text"))


@query("s5_fasta_records", """
SELECT '>' || hash || chr(10) || sequence AS record FROM hash_key""", ("hash_key",))
def s5(spark, d):
    return S.fasta_records(V.hash_key(spark, d), "hash", "sequence")


@query("n9_replicate_levels", """
SELECT n_replicates, count(*) AS n_bottles FROM (
  SELECT split_part(sample, '.', 1) AS bottle, count(*) AS n_replicates
  FROM (SELECT DISTINCT sample FROM reads WHERE NOT starts_with(sample, 'Kangaroo')) GROUP BY 1)
GROUP BY n_replicates""", ("reads",))
def n9r(spark, d):
    r = V.reads(spark, d).where(~F.col("sample").startswith("Kangaroo"))
    return R.replicate_levels(r)
