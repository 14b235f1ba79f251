"""Column functions for composite keys: cleaning, parsing, labels (all JVM-side).

Sample ids follow ``<site>_<YYYYMM><biol>.<tech>``, e.g. ``TW_201703A.1``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's for identical results.
# Positive-control sample name pattern (sample vs control split).
POSITIVE_PATTERN = "Kangaroo|K\\+|k\\+|Ostrich"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def count_char(col, ch: str) -> Column:
    c = _c(col)
    return F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))


def normalize_sample_id(col, year: str = r"\d{4}") -> Column:
    """Apply the five id repairs in order.

    (a) two underscores: first ``_B`` -> ``B``; (b) ``Ostrich[123]`` -> ``Ostrich.N``;
    (c) ``Kangaroo.4`` -> ``Kangaroo.3``; (d) two capitals glued to a year get an
    underscore; (e) an 8-digit date after ``_`` keeps its first 6 digits.
    ``year`` is the pattern of the years that (d) repairs: any by default; the reference's
    own files need ``"2017"`` only.
    """
    c = _c(col)
    c = F.when(count_char(c, "_") == 2, F.regexp_replace(c, r"^(.*?)_B", "$1B")).otherwise(c)
    c = (F.when(c.rlike("Ostrich[123]"), F.regexp_replace(c, r"^(.*?)Ostrich", "$1Ostrich."))
         .when(c == "Kangaroo.4", F.lit("Kangaroo.3"))
         .otherwise(c))
    c = F.when(c.rlike(f"[A-Z][A-Z](?:{year})"),
               F.regexp_replace(c, f"^(.*?[A-Z][A-Z])({year})", "$1_$2")).otherwise(c)
    c = F.when(c.rlike(r"_\d{8}"), F.regexp_replace(c, r"^(.*?)_(\d{6})\d{2}", "$1_$2")).otherwise(c)
    return c


def pad_tag(col) -> Column:
    """``Tag_1`` -> ``Tag_01`` (a single trailing digit gets a leading zero)."""
    return F.regexp_replace(_c(col), r"_(\d)$", "_0$1")


def classify_source(col, pattern: str = POSITIVE_PATTERN) -> Column:
    return F.when(_c(col).rlike(pattern), F.lit("Positives")).otherwise(F.lit("Samples"))


def parse_sample(col) -> dict[str, Column]:
    """Split a sample id into named parts (missing parts become empty strings).

    bottle = before the first '.', tech = after it, biol = last char of the bottle,
    site = before the first '_', yyyymm = between '_' and biol, event = site_yyyymm.
    """
    c = _c(col)
    bottle = F.substring_index(c, ".", 1)
    tech = F.regexp_extract(c, r"\.(.*)$", 1)
    site = F.substring_index(bottle, "_", 1)
    rest = F.regexp_extract(bottle, r"_(.*)$", 1)
    yyyymm = F.substring(rest, F.lit(1), F.greatest(F.length(rest) - 1, F.lit(0)))
    biol = F.substring(bottle, -1, 1)
    event = F.concat(site, F.lit("_"), yyyymm)
    return {"site": site, "yyyymm": yyyymm, "biol": biol, "tech": tech,
            "bottle": bottle, "event": event}


def with_sample_parts(df, col: str = "sample", parts=("site", "yyyymm", "biol", "tech", "bottle", "event")):
    p = parse_sample(col)
    return df.withColumns({k: p[k] for k in parts})


def parse_partial_date(col) -> Column:
    """``YYYYMM`` (or ``YYYYMMDD``) -> DateType; invalid strings -> null."""
    c = _c(col)
    s = F.when(F.length(c) == 6, F.concat(c, F.lit("01"))).otherwise(c)
    return F.try_to_timestamp(s, F.lit("yyyyMMdd")).cast("date")


def unite_label(cols, sep: str = "|") -> Column:
    """Join columns writing missing values as the literal ``NA`` (as ``unite`` does)."""
    return F.concat_ws(sep, *[F.coalesce(_c(c), F.lit("NA")) for c in cols])


def split_label(col, names, sep: str = "|") -> dict[str, Column]:
    parts = F.split(_c(col), "\\" + sep if sep in "|.^$*+?()[]{}\\" else sep)
    return {n: F.get(parts, i) for i, n in enumerate(names)}


def display_label(family, genus, species) -> Column:
    """species; else ``genus sp.``; else ``family sp.`` (``NA`` counts as missing)."""
    fa, ge, sp = _c(family), _c(genus), _c(species)
    sp_na = F.coalesce(sp, F.lit("NA")) == "NA"
    ge_na = F.coalesce(ge, F.lit("NA")) == "NA"
    return (F.when(sp_na & ge_na, F.concat(F.coalesce(fa, F.lit("NA")), F.lit(" sp.")))
            .when(sp_na, F.concat(ge, F.lit(" sp.")))
            .otherwise(sp))


def null_pattern(col, pattern: str = r"^(No |Not )") -> Column:
    """Blank out placeholder values (``No ...``/``Not ...``) as empty strings."""
    c = _c(col)
    return F.when(c.rlike(pattern), F.lit("")).otherwise(c)


def recode(col, mapping: dict, default=None) -> Column:
    """Map values through a literal dict; unmapped values -> ``default`` (or kept if None)."""
    c = _c(col)
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(m[c], F.lit(default) if default is not None else c)


def order_rank(col, levels: list) -> Column:
    """Rank of a value in an explicit level order (1-based; unknown -> null)."""
    pos = F.array_position(F.array(*[F.lit(v) for v in levels]), _c(col)).cast("int")
    return F.nullif(pos, F.lit(0))
