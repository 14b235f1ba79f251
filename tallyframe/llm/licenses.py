"""Op 1. Licence scan: ordered signature rules with a keyword gate and suppression.

The text is normalised once (lower-case words, single spaces). A rule's regex runs only
where the text contains the rule's keyword; every place where it matches is a detection
with its word interval. A detection is suppressed if another one of the same or higher
priority contains its interval (of equal intervals the higher priority, then the earlier
rule, stays): detections sorted by start and falling end are swept once, keeping the
farthest end per priority. All of it is one projection of built-in expressions over
arrays of one row: no shuffle, and rows with many detections cost in proportion.

Defined results: a null or empty text has no words, no detections and score 0; null ids
and repeated rows pass through row by row; an empty table gives an empty result; other
columns stay unless they bear an output name, then they are replaced.
"""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_rules import rules

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OUT = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections")


def fold_ascii(text: Column) -> Column:
    """A-Z to a-z. ``lower`` does the same to every word that ASCII rules can see, except
    for two letters that it maps into ASCII; texts with those go through ``translate``."""
    odd = text.contains("K") | text.contains("İ")
    return F.when(odd, F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.lower(text))


def normalise(text: Column) -> Column:
    """`` word word `` with one space around every word; one space if there is none."""
    padded = F.concat(F.lit(" "), fold_ascii(F.coalesce(text, F.lit(""))), F.lit(" "))
    return F.regexp_replace(padded, NOT_WORD, " ")


def anchors(rule_list) -> list[str]:
    """A few substrings of which every match contains one: ``licen`` where a rule's regex
    has it outside every group, else the rule's keyword. One cheap test of these spares most
    texts the test of every keyword."""
    found = set()
    for _, _, _, key, rx, _ in rule_list:
        while (bare := re.sub(r"\((?:\?[:=])?[^()]*\)[?*+]?(?:\{[^}]*\})?", "", rx)) != rx:
            rx = bare
        found.add("licen" if "licen" in rx or "licen" in key else key)
    return sorted(a for a in found if not any(o != a and o in a for o in found))


def _rule_array(rule_list) -> Column:
    """The rules as one constant (a JSON literal that the optimizer folds)."""
    named = [dict(no=i, label=label, prio=prio, conf=conf, key=key, rx=rx, base=base)
             for i, (label, prio, conf, key, rx, base) in enumerate(rule_list)]
    return F.from_json(F.lit(json.dumps(named)),
                       "array<struct<no:int,label:string,prio:int,conf:double,key:string,rx:string,base:boolean>>")


# Every match starts with the space before its first word, so the words of a piece of text
# are its spaces. Detections sort by start, falling end, falling priority, rule.
_DETECT = """
flatten(transform(filter(if(__gate, __rules, slice(__rules, 1, 0)), r -> contains(__norm, r.key)), r ->
  aggregate(
    zip_with(regexp_extract_all(__norm, r.rx, 0), split(__norm, r.rx, -1),
             (m, p) -> named_struct('hit', m is not null, 'gap', cast(length(p) - length(replace(p, ' ', '')) as bigint),
                                    'len', cast(length(m) - length(replace(m, ' ', '')) as bigint))),
    named_struct('at', 0L, 'out', cast(array() as array<struct<s:bigint,ne:bigint,np:int,no:int,label:string,conf:double,base:boolean>>)),
    (a, x) -> if(x.hit,
      named_struct('at', a.at + x.gap + x.len, 'out', concat(a.out, array(named_struct(
        's', a.at + x.gap, 'ne', -(a.at + x.gap + x.len), 'np', -r.prio, 'no', r.no, 'label', r.label, 'conf', r.conf, 'base', r.base)))),
      a),
    a -> a.out)))
"""

_SWEEP = """
aggregate(__dets,
  named_struct('m1', -1L, 'm2', -1L, 'm3', -1L, 'm4', -1L, 'kept', 0L, 'score', 0D, 'labels', cast(array() as array<string>)),
  (a, d) -> if(case d.np when -1 then a.m1 when -2 then a.m2 when -3 then a.m3 else a.m4 end >= -d.ne, a,
    named_struct('m1', greatest(a.m1, -d.ne),
                 'm2', if(d.np <= -2, greatest(a.m2, -d.ne), a.m2),
                 'm3', if(d.np <= -3, greatest(a.m3, -d.ne), a.m3),
                 'm4', if(d.np <= -4, greatest(a.m4, -d.ne), a.m4),
                 'kept', a.kept + 1L, 'score', greatest(a.score, d.conf),
                 'labels', array_union(a.labels, array(d.label)))))
"""


def scan_licenses(docs: DataFrame, text_col: str = "text", rule_list=None) -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word, base_labels, labels, score and
    detections (number left after suppression)."""
    kept = [c for c in docs.columns if c.lower() not in OUT]
    names = {c: f"__in{i}" for i, c in enumerate(kept)}  # no clash with columns of the scan
    rule_list = rule_list or rules()
    d = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], normalise(F.col(f"`{text_col}`")).alias("__norm"))
    gate = reduce(lambda a, b: a | b, [F.col("__norm").contains(a) for a in anchors(rule_list)])
    d = d.withColumn("__gate", gate).withColumn("__rules", _rule_array(rule_list))
    d = d.withColumn("__dets", F.expr(f"sort_array({_DETECT})"))
    d = d.withColumn("__sum", F.expr(_SWEEP)).withColumn("__base", F.expr("filter(__dets, d -> d.base)"))
    spaces = F.length("__norm") - F.length(F.replace(F.col("__norm"), F.lit(" ")))
    base_labels = F.array_sort(F.array_distinct(F.transform("__base", lambda x: x["label"])))
    return d.select(
        *[F.col(n).alias(c) for c, n in names.items()],
        (spaces - 1).cast("bigint").alias("n_words"),
        F.size("__base").cast("bigint").alias("n_base"),
        F.array_min(F.transform("__base", lambda x: x["s"])).alias("first_word"),
        F.array_max(F.transform("__base", lambda x: x["s"])).alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(F.col("__sum.labels"), base_labels)), ",").alias("labels"),
        F.col("__sum.score").alias("score"), F.col("__sum.kept").alias("detections"))
