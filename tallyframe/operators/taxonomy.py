"""Taxonomy, traits and sequence annotation operators (all joins and aggregates)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import unite_label
from ._util import as_list, is_small, small_list, spread, union_all

UNDETERMINED = "undetermined"


def sequential_join(df1: DataFrame, df2: DataFrame, keys, values, confidence: str = "confidence") -> DataFrame:
    """Match on the finest key first, leftovers on the next keys.

    Level 1 may fan out (every df2 row with that key). Later levels use distinct
    (key, values) rows of df2; a key with more than one distinct value combination gets
    ``undetermined`` in every value column. ``confidence`` records the key used; rows
    never matched are kept with null values. Null keys never match. Values come out as
    strings, since ``undetermined`` may stand among them.
    """
    keys, values = as_list(keys), as_list(values)
    left = df1
    parts = []
    for i, k in enumerate(keys):
        sub = df2.select(k, *[F.col(v).cast("string").alias(v) for v in values]).where(F.col(k).isNotNull())
        if i > 0:
            sub = sub.distinct()
            n = sub.groupBy(k).agg(F.count(F.lit(1)).alias("_n"))
            sub = sub.join(n, k)
            sub = sub.select(k, *[F.when(F.col("_n") == 1, F.col(v).cast("string")).otherwise(F.lit(UNDETERMINED)).alias(v)
                                  for v in values]).distinct()
        if i == 0:
            # equal rows of a key are met once, counted, and repeated at the end; the left rows are
            # spread over all tasks before they fan out (a few keys may hold them all)
            sub = small_list(sub.groupBy(k, *values).agg(F.count(F.lit(1)).alias("_n")))
            matched = spread(left).join(sub, k).withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))).drop("_n")
        else:
            matched = left.join(small_list(sub), k)
        matched = matched.withColumn(confidence, F.lit(k))
        parts.append(matched)
        left = left.join(small_list(df2.select(k).where(F.col(k).isNotNull()).distinct()), k, "left_anti")
    rest = left
    for v in values:
        rest = rest.withColumn(v, F.lit(None).cast("string"))
    parts.append(rest.withColumn(confidence, F.lit(None).cast("string")))
    cols = df1.columns + [v for v in values if v not in df1.columns] + [confidence]
    return union_all([p.select(*cols) for p in parts])


def trait_conflicts(df: DataFrame, by, traits) -> DataFrame:
    """(group, trait, n_values) for groups with more than one value of a trait."""
    by = as_list(by)
    g = df.groupBy(*by).agg(*[F.count_distinct(t).alias(t) for t in as_list(traits)])
    long = g.unpivot(by, as_list(traits), "trait", "n_values")
    return long.where(F.col("n_values") > 1)


def lineage_wide(df: DataFrame, key: str = "key", rank: str = "rank", name: str = "name",
                 ranks=("kingdom", "phylum", "family", "genus", "species"),
                 relabel: dict | None = None) -> DataFrame:
    """(key, rank, name) rows -> one column per rank (``no rank`` rows dropped),
    columns optionally renamed (``relabel``). An explicit rank list avoids the extra
    pass that discovers pivot values."""
    w = (df.where(F.col(rank) != "no rank").groupBy(key)
         .pivot(rank, list(ranks)).agg(F.min(name)))
    for old, new in (relabel or {}).items():
        w = w.withColumnRenamed(old, new)
    return w


def backfill_rank(df: DataFrame, target: str, fallbacks) -> DataFrame:
    """T4: ``target`` := target, else the first non-null fallback column."""
    return df.withColumn(target, F.coalesce(F.col(target), *[F.col(c) for c in as_list(fallbacks)]))


def replace_matched(df: DataFrame, fix: DataFrame, key) -> DataFrame:
    """T5: rows with a fix take all of the fix's columns (nulls included); others unchanged."""
    keys = as_list(key)
    cols = [c for c in fix.columns if c not in keys]
    f = fix.select(*keys, F.lit(True).alias("__hit"), *[F.col(c).alias(f"__f_{c}") for c in cols])
    j = df.join(f, keys, "left")
    return j.select(*[F.when(F.col("__hit"), F.col(f"__f_{c}")).otherwise(F.col(c)).alias(c) if c in cols
                      else F.col(c) for c in df.columns])


def _count_literal(text: Column, token: str) -> Column:
    return F.coalesce((F.length(text) - F.length(F.replace(text, F.lit(token), F.lit("")))) / len(token),
                      F.lit(0)).cast("bigint")


def source_tokens(df: DataFrame, by, text: str, ben: str = "Benthos", plk: str = "plankton",
                  out: str = "source") -> DataFrame:
    """Per group, count token hits; no benthic hit -> PLK, no planktonic hit -> BEN,
    else Both."""
    g = df.groupBy(*as_list(by)).agg(F.sum(_count_literal(F.col(text), ben)).alias("ben"),
                                     F.sum(_count_literal(F.col(text), plk)).alias("plk"))
    return g.withColumn(out, F.when(F.col("ben") == 0, "PLK").when(F.col("plk") == 0, "BEN").otherwise("Both"))


def group_consensus(df: DataFrame, by, value: str) -> DataFrame:
    """The group's value when all rows agree, else null."""
    return (df.groupBy(*as_list(by))
            .agg(F.when(F.count_distinct(value) == 1, F.min(value)).alias(value)))


def vote_lifestyle(df: DataFrame, cols, out: str = "agreed") -> DataFrame:
    """PLK over BEN over Both over None across several source columns."""
    allc = unite_label(as_list(cols))
    return df.withColumn("all_sources", allc).withColumn(
        out, F.when(allc.contains("PLK"), "PLK").when(allc.contains("BEN"), "BEN")
        .when(allc.contains("Both"), "Both").otherwise("None"))


def fill_from_source(df: DataFrame, src: DataFrame, key, col: str, label: str,
                     provenance: str | None = None) -> DataFrame:
    """Fill only null ``col`` values from ``src`` (joined on ``key``) and record where
    each value came from (``original``, ``label`` or null when still missing)."""
    keys = as_list(key)
    provenance = provenance or f"{col}_source"
    s = src.select(*keys, F.col(col).alias("__src"))
    j = df.join(s, keys, "left")
    filled = F.coalesce(F.col(col), F.col("__src"))
    prov = (F.when(F.col(col).isNotNull(), F.lit("original"))
            .when(F.col("__src").isNotNull(), F.lit(label)))
    return j.withColumn(provenance, prov).withColumn(col, filled).drop("__src")


def contains_any(df: DataFrame, key: str, text: str, terms: DataFrame, term: str = "term",
                 sep_regex: str = r"[;|\s]+") -> DataFrame:
    """Which terms occur in each text, as whole words or word sequences.

    The text is cut into word n-grams up to the longest term's length and equi-joined
    to the term list, so the match is a hash join rather than a regex of all terms or a
    nested loop. Output (key, term) pairs.
    """
    t = terms.select(F.regexp_replace(F.trim(F.col(term)), r"\s+", " ").alias(term)).where(F.length(term) > 0).distinct()
    max_words = t.select(F.max(F.size(F.split(term, " ")))).first()[0] or 1
    words = F.split(F.trim(F.col("__x")), sep_regex)
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(int(max_words))), lambda n: F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))),
        lambda i: F.array_join(F.slice(words, i, n), " "))))
    # few files may hold all texts: they are spread before their n-grams, and n-grams meet the
    # terms before equal ones are dropped
    g = spread(df.select(key, F.col(text).alias("__x"))).select(key, F.explode(F.array_distinct(grams)).alias(term))
    if is_small(t, 200_000):
        t = F.broadcast(t)
    return g.join(t, term).select(term, key).distinct()


def contains_substring(df: DataFrame, key: str, text: str, terms: DataFrame, term: str = "term",
                       q: int = 6) -> DataFrame:
    """Which terms occur anywhere in each text, inside longer words too, as the
    reference's pattern search finds them.

    A term is looked up by one of its character q-grams, the one that the fewest terms
    hold (a term shorter than ``q`` by itself), joined to the q-grams of the texts;
    ``contains`` decides. Output (key, term) pairs.
    """
    def grams(c, n):
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))),
                                            lambda i: F.substring(c, i, n)))
    t = terms.select(F.regexp_replace(F.trim(F.col(term)), r"\s+", " ").alias(term)).where(F.length(term) > 0).distinct()
    tg = t.select(term, F.explode(grams(F.col(term), F.lit(q))).alias("__g"))
    held = tg.groupBy("__g").agg(F.count(F.lit(1)).alias("__n"))
    t = tg.join(held, "__g").groupBy(term).agg(F.min_by("__g", F.struct("__n", "__g")).alias("__g"))
    sizes = [r[0] for r in t.select(F.length("__g")).distinct().collect()]  # q rows at most
    if is_small(t, 200_000):
        t = F.broadcast(t)
    g = df.select(key, F.col(text).alias("__x"), F.explode(F.concat(
        F.array().cast("array<string>"), *[grams(F.col(text), F.lit(n)) for n in sorted(sizes)])).alias("__g"))
    return g.join(t, "__g").where(F.col("__x").contains(F.col(term))).select(key, term).distinct()


def membership_report(df: DataFrame, col: str, dim: DataFrame, dim_col: str | None = None) -> DataFrame:
    """Distinct values of ``col`` present in / absent from ``dim``: (status, n)."""
    vals = df.select(F.col(col).alias("v")).where(F.col("v").isNotNull()).distinct()
    d = dim.select(F.col(dim_col or col).alias("v")).where(F.col("v").isNotNull()).distinct() \
        .withColumn("__in", F.lit(True))
    j = vals.join(d, "v", "left")
    return (j.groupBy(F.when(F.col("__in"), "present").otherwise("absent").alias("status"))
            .agg(F.count(F.lit(1)).alias("n")))


def reads_by_status(df: DataFrame, annot: DataFrame, key: str = "hash", status: str = "status",
                    n: str = "n_reads") -> DataFrame:
    """Hashes and reads per annotation status; unmatched hashes are ``unassigned``. Reads are
    summed per hash first, so one row per hash meets the annotation."""
    j = df.groupBy(key).agg(F.sum(n).alias(n)).join(annot.select(key, status), key, "left")
    s = F.coalesce(F.col(status), F.lit("unassigned"))
    return j.groupBy(s.alias(status)).agg(F.count_distinct(key).alias("n_hashes"),
                                          F.sum(n).alias("n_reads"))


def annotate_reads(asv: DataFrame, annot: DataFrame, drop: DataFrame | None = None,
                   key: str = "hash", ranks=("family", "genus", "species"),
                   keep=(), sample: str = "sample", n: str = "n_reads") -> DataFrame:
    """Remove listed hashes (e.g. human), attach the taxon label (``NA`` for missing
    ranks), drop hashes whose label is all ``NA``, and sum reads per (taxon, sample)."""
    a = asv if drop is None else asv.join(drop.select(key).distinct(), key, "left_anti")
    lab = annot.select(key, unite_label(list(ranks)).alias("taxon"), *as_list(keep))
    allna = "|".join(["NA"] * len(ranks))
    j = a.join(lab, key, "left").where(F.col("taxon") != allna)
    return j.groupBy("taxon", sample, *as_list(keep)).agg(F.sum(n).alias(n))


def new_keys(current: DataFrame, previous: DataFrame, key: str = "hash") -> DataFrame:
    """Keys of ``current`` not yet in ``previous`` (only these need new work)."""
    return current.select(key).distinct().join(previous.select(key), key, "left_anti")


def append_results(previous: DataFrame, new: DataFrame) -> DataFrame:
    """Previous results plus results for the new keys."""
    return previous.unionByName(new, allowMissingColumns=True)


# Fixed values that must equal the reference's for identical results:
# NCBI genetic code 5 (invertebrate mitochondrial), codons in TCAG order.
CODE5_AMINO = "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSSSSVVVVAAAADDEEGGGG"
_BASES = "TCAG"


def codon_table(amino: str = CODE5_AMINO) -> dict[str, str]:
    """Codon -> amino acid from a 64-letter code string in TCAG order."""
    return {a + b + c: amino[16 * i + 4 * j + k]
            for i, a in enumerate(_BASES) for j, b in enumerate(_BASES) for k, c in enumerate(_BASES)}


def translate(seq, start: int = 2, amino: str = CODE5_AMINO) -> Column:
    """Translate from 1-based ``start`` in complete codons (unknown codons -> X)."""
    s = F.col(seq) if isinstance(seq, str) else seq
    m = F.create_map(*[F.lit(x) for kv in codon_table(amino).items() for x in kv])
    # one pass over the text, whatever its length
    codons = F.regexp_extract_all(F.substring(s, start, 2**31 - 1), F.lit("(?s)..."), F.lit(0))
    return F.array_join(F.transform(codons, lambda c: F.coalesce(m[c], F.lit("X"))), "")


def translate_filter(df: DataFrame, seq: str = "sequence", start: int = 2, out: str = "aa") -> DataFrame:
    """Keep sequences whose translation has no stop codon (``*``)."""
    return df.withColumn(out, translate(seq, start)).where(~F.col(out).contains("*"))


def threshold_cascade(runs: list[DataFrame], thresholds: list, key: str = "hash",
                      cols=("family", "species")) -> DataFrame:
    """Per key and column, the first non-empty value over runs ordered from the
    strictest threshold, with the threshold that supplied it."""
    base = runs[0].select(key)
    for r in runs[1:]:
        base = base.join(r.select(key), key, "full")
    base = base.distinct()
    j = base
    for i, r in enumerate(runs):
        j = j.join(r.select(key, *[F.col(c).alias(f"{c}__{i}") for c in cols]), key, "left")
    out = [F.col(key)]
    for c in cols:
        vals = [F.nullif(F.col(f"{c}__{i}"), F.lit("")) for i in range(len(runs))]
        out.append(F.coalesce(*vals).alias(c))
        thr = None
        for i, v in enumerate(vals):
            thr = F.when(v.isNotNull(), F.lit(thresholds[i])) if thr is None else thr.when(v.isNotNull(), F.lit(thresholds[i]))
        out.append(thr.alias(f"{c}_threshold"))
    return j.select(*out)


def merge_classifiers(a: DataFrame, b: DataFrame, key: str = "hash", cols=("family",)) -> DataFrame:
    """a's value when not empty, else b's."""
    bb = b.select(key, *[F.col(c).alias(f"__b_{c}") for c in cols])
    j = a.join(bb, key, "left")
    return j.select(*[(F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c)).otherwise(F.col(f"__b_{c}")).alias(c)
                       if c in cols else F.col(c)) for c in a.columns])


def deepest_rank(ranks) -> Column:
    """Name of the finest non-empty rank column ('' when none)."""
    expr = None
    for r in reversed(as_list(ranks)):
        cond = F.coalesce(F.col(r), F.lit("")) != ""
        expr = F.when(cond, F.lit(r)) if expr is None else expr.when(cond, F.lit(r))
    return expr.otherwise(F.lit(""))


def rank_counts(df: DataFrame, rank: str = "rank", by=("threshold",), order=None,
                low=("species", "genus", "family", "order")) -> DataFrame:
    """Hashes per rank (empty -> ``Not Assigned``) per threshold, with the rank's
    position in ``order`` and the share of hashes at ``low`` ranks."""
    r = F.when(F.col(rank) == "", "Not Assigned").otherwise(F.col(rank))
    g = df.groupBy(*as_list(by), r.alias(rank)).agg(F.count(F.lit(1)).alias("n"))
    tot = g.groupBy(*as_list(by)).agg(F.sum("n").alias("_t"),
                                      F.sum(F.when(F.col(rank).isin(*low), F.col("n")).otherwise(0)).alias("_l"))
    g = g.join(tot, as_list(by)).withColumn("share_low", F.col("_l") / F.col("_t")).drop("_t", "_l")
    if order:
        pos = F.array_position(F.array(*[F.lit(o) for o in order]), F.col(rank)).cast("int")
        g = g.withColumn("rank_order", F.nullif(pos, F.lit(0)))
    return g


def compare_classifiers(reads: DataFrame, a: DataFrame, b: DataFrame, key: str = "hash",
                        col: str = "species", n: str = "n_reads") -> DataFrame:
    """Reads per value of ``col`` under two classifiers, full outer join."""
    def agg(c, name):
        return (reads.join(c.select(key, col).where(F.coalesce(F.col(col), F.lit("")) != ""), key)
                .groupBy(col).agg(F.sum(n).alias(name)))
    return agg(a, "reads_a").join(agg(b, "reads_b"), col, "full")


def reads_by_taxon_site(reads: DataFrame, annot: DataFrame, key: str = "hash", sample: str = "sample",
                        ranks=("phylum", "family"), n: str = "n_reads") -> DataFrame:
    """Reads summed by rank columns and site (site = sample id before ``_``)."""
    j = reads.join(annot.select(key, *ranks), key)
    return (j.groupBy(*ranks, F.substring_index(sample, "_", 1).alias("site"))
            .agg(F.sum(n).alias(n)))
