"""Registered queries: abundance index and denoising."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys as K
from ..operators import abundance as A
from ..operators import denoise as D
from ..operators._util import round_cols, union_all
from . import chain as C
from . import oracle_chain  # noqa: F401  (registers oracle views)
from . import views as V
from .registry import query


def flagship(spark, d):
    """eDNA index per sample (it sums repeated (run, sample, hash) rows itself, so the
    separate collapse step would only add a shuffle), then the top feature per sample."""
    idx = A.edna_index(V.reads(spark, d), "sample", "hash", "n_reads", out="edna_index")
    return round_cols(A.top_feature(idx, "sample", "hash", "edna_index"), "edna_index")


query("flagship_top_feature", """
SELECT sample, hash, round(idx, 6) AS edna_index FROM (
  SELECT *, row_number() OVER (PARTITION BY sample ORDER BY idx DESC, hash) AS rn FROM (
    SELECT sample, hash, p / max(p) OVER (PARTITION BY hash) AS idx FROM (
      SELECT sample, hash, s / sum(s) OVER (PARTITION BY sample) AS p FROM (
        SELECT sample, hash, sum(n_reads) AS s FROM collapsed GROUP BY sample, hash))))
WHERE rn = 1""", ("collapsed",))(flagship)


@query("n3_duplicate_keys", """
SELECT run, sample, hash, count(*) AS tot FROM reads GROUP BY run, sample, hash""", ("reads",))
def n3(spark, d):
    return A.duplicate_keys(V.reads(spark, d), ["run", "sample", "hash"])


@query("n4_collapse_counts", "SELECT run, sample, hash, n_reads FROM collapsed", ("collapsed",))
def n4(spark, d):
    return A.collapse_counts(V.reads(spark, d))


@query("n5_classify_source", """
SELECT DISTINCT sample, source FROM collapsed""", ("collapsed",))
def n5(spark, d):
    return V.reads(spark, d).select("sample", K.classify_source("sample").alias("source")).distinct()


@query("s7_first_per_key", """
SELECT hash, sample, n_reads FROM (
  SELECT hash, sample, n_reads, row_number() OVER (PARTITION BY hash ORDER BY n_reads DESC, sample, run) AS rn
  FROM collapsed) WHERE rn = 1""", ("collapsed",))
def s7(spark, d):
    c = C.collapsed(spark, d)
    return A.first_per_key(c, "hash", [("n_reads", False), "sample", "run"]).select("hash", "sample", "n_reads")


@query("u1_edna_index", """
SELECT sample, hash, round(p / max(p) OVER (PARTITION BY hash), 6) AS edna_index FROM (
  SELECT sample, hash, s / sum(s) OVER (PARTITION BY sample) AS p FROM (
    SELECT sample, hash, sum(n_reads) AS s FROM step3 GROUP BY sample, hash))""", ("step3",))
def u1(spark, d):
    return round_cols(A.edna_index(C.step3(spark, d), out="edna_index"), "edna_index")


_EVENT_SQL = """
  SELECT split_part(split_part(sample, '.', 1), '_', 1) || '_' ||
         left(split_part(split_part(sample, '.', 1), '_', 2), length(split_part(split_part(sample, '.', 1), '_', 2)) - 1) AS event,
         right(split_part(sample, '.', 1), 1) AS biol, hash, n_reads
  FROM step3"""


@query("u2_edna_index_biol", """
SELECT event, hash, round(p / max(p) OVER (PARTITION BY hash), 6) AS edna_index FROM (
  SELECT event, hash, sum(s / tot) / max(nrep) AS p FROM (
    SELECT *, sum(s) OVER (PARTITION BY event, biol) AS tot FROM (
      SELECT event, biol, hash, sum(n_reads) AS s FROM ev GROUP BY event, biol, hash)) x
  JOIN (SELECT event, count(DISTINCT biol) AS nrep FROM ev GROUP BY event) r USING (event)
  GROUP BY event, hash)""", ("step3",), ctes=[("ev", _EVENT_SQL)])
def u2(spark, d):
    df = K.with_sample_parts(C.step3(spark, d), parts=("event", "biol"))
    return round_cols(A.edna_index(df, "event", "hash", "n_reads", biol_rep="biol", out="edna_index"),
                      "edna_index")


@query("d1_stage_summary", """
SELECT run, stage, stat, number FROM (
  SELECT run, 'Step_0' AS stage, count(DISTINCT sample) AS nsamples, count(DISTINCT hash) AS nhashes,
         CAST(sum(n_reads) AS BIGINT) AS nreads FROM collapsed WHERE source = 'Samples' GROUP BY run
  UNION ALL
  SELECT run, 'Step_1.Jump', count(DISTINCT sample), count(DISTINCT hash), CAST(sum(n_reads) AS BIGINT)
  FROM step1 GROUP BY run
  UNION ALL
  SELECT run, 'Step_2.Low.nReads', count(DISTINCT sample), count(DISTINCT hash), CAST(sum(n_reads) AS BIGINT)
  FROM step2 GROUP BY run
  UNION ALL
  SELECT run, 'Step_3.Positives', count(DISTINCT sample), count(DISTINCT hash), CAST(sum(n_reads) AS BIGINT)
  FROM step3 GROUP BY run)
UNPIVOT (number FOR stat IN (nsamples, nhashes, nreads))""", ("step3",))
def d1(spark, d):
    return union_all([D.stage_summary(C.samples(spark, d), "0"),
                      D.stage_summary(C.step1(spark, d), "1.Jump"),
                      D.stage_summary(C.step2(spark, d), "2.Low.nReads"),
                      D.stage_summary(C.step3(spark, d), "3.Positives")])


@query("d2_otu_rank", """
SELECT hash, CAST(sum(n_reads) AS BIGINT) AS tot FROM collapsed WHERE source = 'Positives' GROUP BY hash""",
       ("collapsed",))
def d2(spark, d):
    return D.otu_rank(C.positives(spark, d))


@query("d3_contamination_vector", """
SELECT run, hash, round(vector_contamination, 6) AS vector_contamination FROM vec""", ("vec",))
def d3(spark, d):
    return round_cols(D.contamination_vector(C.positives(spark, d)), "vector_contamination")


@query("d4_subtract_contamination", "SELECT * FROM step1", ("step1",))
def d4(spark, d):
    return C.step1(spark, d)


@query("d5_normal_fit", """
SELECT run, round(avg(tot), 6) AS mean, round(stddev_pop(tot), 6) AS sd
FROM (SELECT run, sample, sum(n_reads) AS tot FROM step1 GROUP BY run, sample) GROUP BY run""", ("step1",))
def d5(spark, d):
    tot = C.step1(spark, d).groupBy("run", "sample").agg(F.sum("n_reads").alias("tot"))
    return round_cols(D.normal_fit(tot, "tot", "run"), ["mean", "sd"])


@query("d6_low_read_samples", "SELECT sample, tot FROM low_reads", ("low_reads",))
def d6(spark, d):
    return D.low_read_samples(C.step1(spark, d))


@query("d6_drop_low_reads", "SELECT * FROM step2", ("step2",))
def d6b(spark, d):
    return C.step2(spark, d)


@query("d7_origin_stats", """
SELECT hash, stat, round(positives, 6) AS positives, round(samples, 6) AS samples, origin, n_origins
FROM origin_stats""", ("origin_stats",))
def d7(spark, d):
    return round_cols(D.origin_stats(C.collapsed(spark, d)), ["positives", "samples"])


@query("d8_unanimous_fate", "SELECT hash FROM unanimous", ("unanimous",))
def d8(spark, d):
    return D.unanimous_fate(D.origin_stats(C.collapsed(spark, d)))


@query("d9_occurrence_fate", "SELECT * FROM fate", ("fate",))
def d9(spark, d):
    return C.fate(spark, d)


@query("d10_removed_sequences", """
SELECT f.hash, k.sequence FROM (SELECT DISTINCT hash FROM fate) f LEFT JOIN hash_key k ON f.hash = k.hash""",
       ("fate", "hash_key"))
def d10(spark, d):
    return D.removed_sequences(C.fate(spark, d), V.hash_key(spark, d))


@query("d11_drop_keys", "SELECT * FROM step3", ("step3",))
def d11(spark, d):
    return C.step3(spark, d)


@query("d11_keep_keys", """
SELECT * FROM step2 WHERE hash IN (SELECT hash FROM fate)""", ("step2", "fate"))
def d11b(spark, d):
    return D.keep_keys(C.step2(spark, d), C.fate(spark, d), "hash")


@query("d20_equal_width_bins", """
WITH t AS (SELECT hash, CAST(sum(n_reads) AS DOUBLE) AS tot FROM step3 GROUP BY hash),
mm AS (SELECT min(tot) AS mn, max(tot) AS mx FROM t),
b AS (SELECT tot, CAST(least(CASE WHEN mx = mn THEN 0 ELSE greatest(ceil((tot - mn) / ((mx - mn) / 20)) - 1, 0) END, 19) AS INTEGER) AS bin,
             mn, (mx - mn) / 20 AS w FROM t, mm)
SELECT bin, round(min(mn) + bin * min(w), 6) AS lo, round(min(mn) + (bin + 1) * min(w), 6) AS hi,
       count(*) AS count, round(sum(tot), 6) AS weight_sum FROM b GROUP BY bin""", ("step3",))
def d20(spark, d):
    t = C.step3(spark, d).groupBy("hash").agg(F.sum("n_reads").cast("double").alias("tot"))
    return round_cols(D.equal_width_bins(t, "tot", 20, "tot"), ["lo", "hi", "weight_sum"])


@query("d21_single_replicates", """
SELECT sample FROM (SELECT DISTINCT sample FROM step3)
WHERE split_part(sample, '.', 1) IN (
  SELECT b FROM (SELECT DISTINCT sample, split_part(sample, '.', 1) AS b FROM step3) GROUP BY b HAVING count(*) = 1)""",
       ("step3",))
def d21(spark, d):
    return D.single_replicates(C.step3(spark, d))
