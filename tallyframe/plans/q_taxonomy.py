"""Registered queries: taxonomy matching, traits and sequence annotation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys as K
from ..operators import abundance as A
from ..operators import taxonomy as T
from ..operators._util import round_cols, union_all
from . import chain as C
from . import oracle_chain  # noqa: F401
from . import views as V
from .oracle_views import VIEWS
from .registry import query

# ---- shared inputs ------------------------------------------------------------------


def lifestyle_rule():
    """Lifestyle from an ordered rule list (as the N12 query), as a column."""
    label = K.unite_label(["family", "genus", "species"])
    return (F.when(F.col("phylum") == "P1", "BEN").when(label.rlike("ECONOMY"), "PLK")
            .when(F.col("species").isNull(), F.col("family")).otherwise("Unknown"))


def lifestyle(spark, d):
    """Per-hash lifestyle."""
    return V.taxonomy(spark, d).select("hash", lifestyle_rule().alias("lifestyle"))


BEN_TOKEN, PLK_TOKEN = "STANDARD", "SMALL"


def tokens(spark, d):
    p = V.table(spark, d, "part")
    return T.source_tokens(p, "p_brand", "p_type", BEN_TOKEN, PLK_TOKEN)


def human_hashes(spark, d):
    return V.taxonomy(spark, d).where(F.col("family") == "Brand#1").select("hash")


EXCLUDED_EVENTS = "199501|199601"


def annotated(spark, d):
    annot = V.taxonomy(spark, d).withColumn("lifestyle", lifestyle_rule())
    return T.annotate_reads(C.step4(spark, d), annot, human_hashes(spark, d), keep=["lifestyle"])


def planktonic(spark, d):
    """Exclude dates and benthic (or unknown) rows, then the replicate-aware index."""
    def build():
        a = K.with_sample_parts(annotated(spark, d), parts=("event", "biol"))
        a = a.where(~F.col("event").rlike(EXCLUDED_EVENTS)).where(F.col("lifestyle") != "BEN")
        return A.edna_index(a, "event", "taxon", "n_reads", biol_rep="biol", out="edna_index")
    return C.materialized(spark, d, "planktonic", build)


VIEWS.update({
    "lifestyle": ("""
      SELECT hash, CASE WHEN phylum = 'P1' THEN 'BEN'
        WHEN regexp_matches(coalesce(family, 'NA') || '|' || coalesce(genus, 'NA') || '|' || coalesce(species, 'NA'), 'ECONOMY') THEN 'PLK'
        WHEN species IS NULL THEN family ELSE 'Unknown' END AS lifestyle FROM taxonomy""", ["taxonomy"]),
    "tokens": (f"""
      SELECT p_brand, ben, plk, CASE WHEN ben = 0 THEN 'PLK' WHEN plk = 0 THEN 'BEN' ELSE 'Both' END AS source FROM (
        SELECT p_brand,
          CAST(sum((length(p_type) - length(replace(p_type, '{BEN_TOKEN}', ''))) // {len(BEN_TOKEN)}) AS BIGINT) AS ben,
          CAST(sum((length(p_type) - length(replace(p_type, '{PLK_TOKEN}', ''))) // {len(PLK_TOKEN)}) AS BIGINT) AS plk
        FROM part GROUP BY p_brand)""", []),
    "consensus": ("""
      SELECT family, CASE WHEN count(DISTINCT genus) = 1 THEN min(genus) END AS genus FROM traits GROUP BY family""",
                  ["traits"]),
    "annotated": ("""
      SELECT taxon, sample, lifestyle, CAST(sum(n_reads) AS BIGINT) AS n_reads FROM (
        SELECT s.sample, s.n_reads, l.lifestyle,
               coalesce(t.family, 'NA') || '|' || coalesce(t.genus, 'NA') || '|' || coalesce(t.species, 'NA') AS taxon
        FROM step4 s LEFT JOIN taxonomy t ON s.hash = t.hash LEFT JOIN lifestyle l ON s.hash = l.hash
        WHERE s.hash NOT IN (SELECT hash FROM taxonomy WHERE family = 'Brand#1'))
      WHERE taxon <> 'NA|NA|NA' GROUP BY taxon, sample, lifestyle""", ["step4", "taxonomy", "lifestyle"]),
    "planktonic": (f"""
      WITH ev AS (SELECT split_part(split_part(sample, '.', 1), '_', 1) || '_' ||
                         left(split_part(split_part(sample, '.', 1), '_', 2), length(split_part(split_part(sample, '.', 1), '_', 2)) - 1) AS event,
                         right(split_part(sample, '.', 1), 1) AS biol, taxon, n_reads
                  FROM annotated WHERE lifestyle <> 'BEN'),
      ev2 AS (SELECT * FROM ev WHERE NOT regexp_matches(event, '{EXCLUDED_EVENTS}'))
      SELECT event, taxon, p / max(p) OVER (PARTITION BY taxon) AS edna_index FROM (
        SELECT event, taxon, sum(s / tot) / max(nrep) AS p FROM (
          SELECT *, sum(s) OVER (PARTITION BY event, biol) AS tot FROM (
            SELECT event, biol, taxon, sum(n_reads) AS s FROM ev2 GROUP BY event, biol, taxon)) x
        JOIN (SELECT event, count(DISTINCT biol) AS nrep FROM ev2 GROUP BY event) r USING (event)
        GROUP BY event, taxon)""", ["annotated"]),
})


# ---- T1 ---------------------------------------------------------------------------

_T1_KEYS = ["species", "genus", "family"]


def _t1_sql() -> str:
    parts, ctes = [], []
    prev = "(SELECT hash, family, genus, species FROM taxonomy)"
    for i, k in enumerate(_T1_KEYS):
        if i == 0:
            ctes.append(f"v{i} AS (SELECT {k}, trait_a, trait_b FROM traits WHERE {k} IS NOT NULL)")
        else:
            ctes.append(f"""d{i} AS (SELECT DISTINCT {k}, trait_a, trait_b FROM traits WHERE {k} IS NOT NULL),
n{i} AS (SELECT {k}, count(*) AS n FROM d{i} GROUP BY {k}),
v{i} AS (SELECT DISTINCT d.{k}, CASE WHEN n = 1 THEN trait_a ELSE 'undetermined' END AS trait_a,
                CASE WHEN n = 1 THEN trait_b ELSE 'undetermined' END AS trait_b FROM d{i} d JOIN n{i} USING ({k}))""")
        ctes.append(f"m{i} AS (SELECT l.hash, l.family, l.genus, l.species, v.trait_a, v.trait_b, '{k}' AS confidence "
                    f"FROM {prev} l JOIN v{i} v ON l.{k} = v.{k})")
        ctes.append(f"left{i} AS (SELECT * FROM {prev} l WHERE NOT EXISTS "
                    f"(SELECT 1 FROM traits r WHERE r.{k} = l.{k}))")
        parts.append(f"SELECT * FROM m{i}")
        prev = f"left{i}"
    parts.append(f"SELECT hash, family, genus, species, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), "
                 f"CAST(NULL AS VARCHAR) FROM {prev}")
    return "WITH " + ",\n".join(ctes) + "\n" + "\nUNION ALL ".join(parts)


@query("t1_sequential_join", _t1_sql(), ("taxonomy", "traits"))
def t1(spark, d):
    df1 = V.taxonomy(spark, d).select("hash", "family", "genus", "species")
    return T.sequential_join(df1, V.traits(spark, d), _T1_KEYS, ["trait_a", "trait_b"])


@query("t2_trait_conflicts", """
SELECT genus, 'trait_a' AS trait, count(DISTINCT trait_a) AS n_values FROM traits GROUP BY genus HAVING count(DISTINCT trait_a) > 1
UNION ALL
SELECT genus, 'trait_b', count(DISTINCT trait_b) FROM traits GROUP BY genus HAVING count(DISTINCT trait_b) > 1""",
       ("traits",))
def t2(spark, d):
    return T.trait_conflicts(V.traits(spark, d), "genus", ["trait_a", "trait_b"])


@query("t3_lineage_wide", "SELECT key, " + ", ".join(
    f"min(CASE WHEN rank = '{r}' THEN name END) AS {r}" for r in V.LINEAGE_RANKS)
    + " FROM lineage WHERE rank <> 'no rank' GROUP BY key", ("lineage",))
def t3(spark, d):
    return T.lineage_wide(V.lineage(spark, d), ranks=V.LINEAGE_RANKS)


@query("t4_backfill_rank", "SELECT hash, coalesce(species, genus, family) AS species FROM taxonomy", ("taxonomy",))
def t4(spark, d):
    return T.backfill_rank(V.taxonomy(spark, d), "species", ["genus", "family"]).select("hash", "species")


def _fix(spark, d):
    p = V.table(spark, d, "part").where(F.col("p_size") >= 48)
    return p.select(F.col("p_partkey").cast("string").alias("hash"), F.concat(F.lit("G_"), "p_type").alias("genus"),
                    F.when(F.col("p_size") == 50, None).otherwise(F.concat("p_name", F.lit(" var."))).alias("species"))


@query("t5_replace_matched", """
SELECT t.hash, t.kingdom, t.phylum, t.family,
       CASE WHEN f.hash IS NOT NULL THEN f.genus ELSE t.genus END AS genus,
       CASE WHEN f.hash IS NOT NULL THEN f.species ELSE t.species END AS species
FROM taxonomy t LEFT JOIN (SELECT CAST(p_partkey AS VARCHAR) AS hash, 'G_' || p_type AS genus,
    CASE WHEN p_size = 50 THEN NULL ELSE p_name || ' var.' END AS species FROM part WHERE p_size >= 48) f
  ON t.hash = f.hash""", ("taxonomy",))
def t5(spark, d):
    return T.replace_matched(V.taxonomy(spark, d), _fix(spark, d), "hash")


@query("t6_source_tokens", "SELECT * FROM tokens", ("tokens",))
def t6(spark, d):
    return tokens(spark, d)


@query("t7_group_consensus", "SELECT * FROM consensus", ("consensus",))
def t7(spark, d):
    return T.group_consensus(V.traits(spark, d), "family", "genus")


@query("t8_vote_lifestyle", """
SELECT hash, all_sources, CASE WHEN contains(all_sources, 'PLK') THEN 'PLK' WHEN contains(all_sources, 'BEN') THEN 'BEN'
  WHEN contains(all_sources, 'Both') THEN 'Both' ELSE 'None' END AS agreed FROM (
  SELECT t.hash, coalesce(l.lifestyle, 'NA') || '|' || coalesce(k.source, 'NA') AS all_sources
  FROM taxonomy t JOIN lifestyle l ON t.hash = l.hash LEFT JOIN tokens k ON t.family = k.p_brand)""",
       ("taxonomy", "lifestyle", "tokens"))
def t8(spark, d):
    t = V.taxonomy(spark, d).join(lifestyle(spark, d), "hash")
    t = t.join(tokens(spark, d).select(F.col("p_brand").alias("family"), "source"), "family", "left")
    return T.vote_lifestyle(t, ["lifestyle", "source"]).select("hash", "all_sources", "agreed")


@query("t9_fill_from_source", """
SELECT t.hash, t.family, coalesce(t.genus, c.genus) AS genus,
       CASE WHEN t.genus IS NOT NULL THEN 'original' WHEN c.genus IS NOT NULL THEN 'consensus' END AS genus_source
FROM taxonomy t LEFT JOIN consensus c ON t.family = c.family""", ("taxonomy", "consensus"))
def t9(spark, d):
    t = V.taxonomy(spark, d).select("hash", "family", "genus")
    cons = T.group_consensus(V.traits(spark, d), "family", "genus")
    return T.fill_from_source(t, cons, "family", "genus", "consensus")


@query("t10_contains_any", r"""
SELECT DISTINCT t.hash, s.term FROM
  (SELECT hash, ';' || regexp_replace(trim(concat_ws(';', kingdom, phylum, family, genus, species)), '[;|\s]+', ';', 'g') || ';' AS txt
   FROM taxonomy) t
JOIN (SELECT DISTINCT regexp_replace(trim(species), '\s+', ' ', 'g') AS term FROM traits
      WHERE species IS NOT NULL AND length(trim(species)) > 0) s
  ON contains(t.txt, ';' || replace(s.term, ' ', ';') || ';')""", ("taxonomy", "traits"))
def t10(spark, d):
    t = V.taxonomy(spark, d).select("hash", F.concat_ws(";", "kingdom", "phylum", "family", "genus", "species").alias("txt"))
    terms = V.traits(spark, d).where(F.col("species").isNotNull()).select(F.col("species").alias("term"))
    return T.contains_any(t, "hash", "txt", terms)


@query("t10_contains_substring", r"""
SELECT DISTINCT t.hash, s.term FROM
  (SELECT hash, concat_ws(';', kingdom, phylum, family, genus, species) AS txt FROM taxonomy) t
JOIN (SELECT DISTINCT regexp_replace(trim(species), '\s+', ' ', 'g') AS term FROM traits
      WHERE species IS NOT NULL AND length(trim(species)) > 0) s
  ON contains(t.txt, s.term)""", ("taxonomy", "traits"))
def t10s(spark, d):
    t = V.taxonomy(spark, d).select("hash", F.concat_ws(";", "kingdom", "phylum", "family", "genus", "species").alias("txt"))
    terms = V.traits(spark, d).where(F.col("species").isNotNull()).select(F.col("species").alias("term"))
    return T.contains_substring(t, "hash", "txt", terms)


@query("t11_membership_report", """
SELECT CASE WHEN d.v IS NOT NULL THEN 'present' ELSE 'absent' END AS status, count(*) AS n
FROM (SELECT DISTINCT genus AS v FROM taxonomy WHERE genus IS NOT NULL) x
LEFT JOIN (SELECT DISTINCT genus AS v FROM traits WHERE genus IS NOT NULL) d ON x.v = d.v GROUP BY 1""",
       ("taxonomy", "traits"))
def t11(spark, d):
    return T.membership_report(V.taxonomy(spark, d), "genus", V.traits(spark, d))


@query("t12_reads_by_status", """
SELECT coalesce(l.lifestyle, 'unassigned') AS status, count(DISTINCT s.hash) AS n_hashes,
       CAST(sum(s.n_reads) AS BIGINT) AS n_reads
FROM step4 s LEFT JOIN lifestyle l ON s.hash = l.hash GROUP BY 1""", ("step4", "lifestyle"))
def t12(spark, d):
    st = lifestyle(spark, d).withColumnRenamed("lifestyle", "status")
    return T.reads_by_status(C.step4(spark, d), st)


@query("t13_annotate_reads", "SELECT * FROM annotated", ("annotated",))
def t13(spark, d):
    return annotated(spark, d)


@query("t14_planktonic_events", "SELECT event, taxon, round(edna_index, 6) AS edna_index FROM planktonic",
       ("planktonic",))
def t14(spark, d):
    return round_cols(planktonic(spark, d), "edna_index")


@query("t15_join_environment", """
SELECT p.event, p.taxon, round(p.edna_index, 6) AS edna_index, e.area, e.temperature, e.ph, e.salinity
FROM (SELECT * FROM env WHERE site IS NOT NULL AND date IS NOT NULL AND area IS NOT NULL
      AND temperature IS NOT NULL AND ph IS NOT NULL AND salinity IS NOT NULL) e
RIGHT JOIN planktonic p
  ON e.site = split_part(p.event, '_', 1)
 AND e.date = strptime(split_part(p.event, '_', 2) || '01', '%Y%m%d')::DATE""", ("planktonic", "env"))
def t15(spark, d):
    from ..operators.scenario import join_environment
    out = join_environment(planktonic(spark, d), V.env(spark, d))
    return round_cols(out.select("event", "taxon", "edna_index", "area", "temperature", "ph", "salinity"),
                      "edna_index")


@query("t16_new_keys_append", """
SELECT hash, family, species, threshold FROM classifier_0 WHERE family <> ''
UNION ALL
SELECT n.hash, c.family, c.species, c.threshold
FROM (SELECT DISTINCT hash FROM reads WHERE hash NOT IN (SELECT hash FROM classifier_0 WHERE family <> '')) n
LEFT JOIN classifier_3 c ON n.hash = c.hash""", ("classifier_0", "classifier_3", "reads"))
def t16(spark, d):
    prev = V.classifier(spark, d, 0).where(F.col("family") != "")
    new = T.new_keys(V.reads(spark, d), prev)
    fresh = new.join(V.classifier(spark, d, 3), "hash", "left")
    return T.append_results(prev, fresh).select("hash", "family", "species", "threshold")


def _codes_sql() -> str:
    rows = ", ".join(f"('{k}', '{v}')" for k, v in T.codon_table().items())
    return f"codes(codon, aa) AS (VALUES {rows})"


@query("t17_translate_filter", f"""
WITH {_codes_sql()},
c AS (SELECT hash, unnest(l) AS codon, generate_subscripts(l, 1) AS i
      FROM (SELECT hash, regexp_extract_all(substring(sequence, 2), '...') AS l FROM hash_key)),
q AS (SELECT c.hash, string_agg(coalesce(k.aa, 'X'), '' ORDER BY c.i) AS aa FROM c LEFT JOIN codes k ON k.codon = c.codon GROUP BY c.hash),
p AS (SELECT h.hash, h.sequence, coalesce(q.aa, '') AS aa FROM hash_key h LEFT JOIN q ON q.hash = h.hash WHERE h.sequence IS NOT NULL)
SELECT hash, sequence, aa FROM p WHERE NOT contains(aa, '*')""", ("hash_key",))
def t17(spark, d):
    return T.translate_filter(V.hash_key(spark, d), "sequence", 2)


_THR = [lv[0] for lv in V.CLASSIFIER_LEVELS]


def _cascade_sql(col):
    vals = [f"nullif(c{i}.{col}, '')" for i in range(4)]
    thr = " ".join(f"WHEN {v} IS NOT NULL THEN CAST({_THR[i]} AS DOUBLE)" for i, v in enumerate(vals))
    return f"coalesce({', '.join(vals)}) AS {col}, CASE {thr} END AS {col}_threshold"


@query("t18_threshold_cascade", f"""
SELECT c0.hash, {_cascade_sql('family')}, {_cascade_sql('species')}
FROM classifier_0 c0 JOIN classifier_1 c1 ON c0.hash = c1.hash JOIN classifier_2 c2 ON c0.hash = c2.hash
JOIN classifier_3 c3 ON c0.hash = c3.hash""", ("classifier_0", "classifier_1", "classifier_2", "classifier_3"))
def t18(spark, d):
    runs = [V.classifier(spark, d, i) for i in range(4)]
    return T.threshold_cascade(runs, _THR)


@query("t19_merge_classifiers", """
SELECT a.hash, CASE WHEN coalesce(a.family, '') <> '' THEN a.family ELSE b.family END AS family, a.species, a.threshold
FROM classifier_0 a LEFT JOIN classifier_3 b ON a.hash = b.hash""", ("classifier_0", "classifier_3"))
def t19(spark, d):
    return T.merge_classifiers(V.classifier(spark, d, 0), V.classifier(spark, d, 3), cols=("family",))


RANK_ORDER = ["family", "species", "Not Assigned"]


@query("t20_rank_counts", """
WITH r AS (SELECT threshold, CASE WHEN coalesce(species, '') <> '' THEN 'species'
                                  WHEN coalesce(family, '') <> '' THEN 'family' ELSE 'Not Assigned' END AS rank
           FROM (SELECT * FROM classifier_0 UNION ALL SELECT * FROM classifier_1
                 UNION ALL SELECT * FROM classifier_2 UNION ALL SELECT * FROM classifier_3)),
g AS (SELECT threshold, rank, count(*) AS n FROM r GROUP BY threshold, rank)
SELECT threshold, rank, n,
       sum(CASE WHEN rank IN ('species', 'genus', 'family', 'order') THEN n ELSE 0 END) OVER (PARTITION BY threshold)
         / sum(n) OVER (PARTITION BY threshold) AS share_low,
       CAST(CASE rank WHEN 'family' THEN 1 WHEN 'species' THEN 2 WHEN 'Not Assigned' THEN 3 END AS INTEGER) AS rank_order
FROM g""", ("classifier_0", "classifier_1", "classifier_2", "classifier_3"))
def t20(spark, d):
    runs = union_all([V.classifier(spark, d, i) for i in range(4)])
    runs = runs.withColumn("rank", T.deepest_rank(["family", "species"]))
    return T.rank_counts(runs, "rank", ["threshold"], RANK_ORDER)


@query("t21_compare_classifiers", """
SELECT coalesce(a.species, b.species) AS species, a.reads_a, b.reads_b FROM
  (SELECT c.species, CAST(sum(s.n_reads) AS BIGINT) AS reads_a FROM step4 s JOIN classifier_0 c ON s.hash = c.hash
   WHERE coalesce(c.species, '') <> '' GROUP BY c.species) a
FULL JOIN
  (SELECT c.species, CAST(sum(s.n_reads) AS BIGINT) AS reads_b FROM step4 s JOIN classifier_3 c ON s.hash = c.hash
   WHERE coalesce(c.species, '') <> '' GROUP BY c.species) b
ON a.species = b.species""", ("step4", "classifier_0", "classifier_3"))
def t21(spark, d):
    return T.compare_classifiers(C.step4(spark, d), V.classifier(spark, d, 0), V.classifier(spark, d, 3))


@query("t22_reads_by_taxon_site", """
SELECT t.phylum, t.family, split_part(s.sample, '_', 1) AS site, CAST(sum(s.n_reads) AS BIGINT) AS n_reads
FROM step4 s JOIN taxonomy t ON s.hash = t.hash GROUP BY 1, 2, 3""", ("step4", "taxonomy"))
def t22(spark, d):
    return T.reads_by_taxon_site(C.step4(spark, d), V.taxonomy(spark, d))
