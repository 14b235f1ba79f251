"""Op 3. Quality rules on repetition coverage.

Words are split and hashed for a whole slice of rows at once (``_text``); n-grams are
rolling hashes of word hashes. A document's n-grams are compared only with its own, by one
sort of (document, hash) keys per length. Coverage is measured in characters: those in
n-grams that occurred before in the text (each word counted once), those of the most
frequent short n-gram, and those of lines equal to an earlier line. Equality is that of
64-bit hashes. Memory is bounded by the slice (2 MB of text, or one document).

Defined results: a null, empty or white text has no words and fails the base rule; null
ids and repeated rows pass row by row; an empty table gives an empty result; every other
column stays (a column that bears an output name is replaced).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _text as X

#: Least words and most percent of words in repeated 3-word windows.
MIN_WORDS, MAX_REPEAT = 50, 50
#: Most share of characters in the most frequent n-gram (n of 2 to 4) and in n-grams seen
#: before (n of 5 to 10). The second are the published limits for web text and 0.10 more:
#: a short clean text that quotes one of its lines stays.
TOP_GRAM = {2: 0.20, 3: 0.18, 4: 0.16}
DUP_GRAM = {5: 0.25, 6: 0.24, 7: 0.23, 8: 0.22, 9: 0.21, 10: 0.20}
#: Most share of characters in repeated lines; most symbols a word (a table with a bar
#: between its cells has about half a symbol a word).
MAX_DUP_LINE, MAX_SYMBOLS = 0.30, 1.0

SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
OUT = {"n_words": T.LongType(), "word_chars": T.LongType(), "n_symbols": T.LongType(), "n_dup_lines": T.LongType(),
       "n_repeat_words": T.LongType(), "base_failed": T.BooleanType(), "kept": T.BooleanType(),
       "dup_gram_share": T.DoubleType(), "top_gram_share": T.DoubleType(), "dup_line_share": T.DoubleType()}


def _groups(key: np.ndarray, place: np.ndarray):
    """Equal keys among ``place``: (order, start of each group in the order, its size, its
    smallest place)."""
    order = np.argsort(key)
    k = key[order]
    begin = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return order, begin, np.diff(np.append(begin, len(k))), np.minimum.reduceat(place[order], begin)


def _covered(n_words: int, starts: np.ndarray, n: int) -> np.ndarray:
    """Words that lie in one of the n-word windows at ``starts``."""
    first = np.zeros(n_words + n, bool)
    first[starts] = True
    covered = first.copy()
    for j in range(1, n):
        covered[j:] |= first[:-j]
    return covered[:n_words]


def measure(texts) -> dict[str, np.ndarray]:
    """The output columns for a string array."""
    data, off = X.doc_bytes(texts)
    docs = len(off) - 1
    s, e, wo = X.spans(data, off, ~X.SPACE[data])
    h = X.span_hash(data, s, e)
    n = np.diff(wo)
    points = np.concatenate([np.zeros(1, np.int64), np.cumsum((data & 0xC0) != 0x80)])
    wchars = points[e] - points[s]
    chars = X.per_doc(wchars, wo)
    size = np.maximum(chars, 1)
    doc_salt = X.mix(np.arange(docs, dtype=np.uint64) + np.uint64(1))

    # An n-gram that occurs twice starts with an (n-1)-gram that occurs twice and ends with
    # another, so each length looks only at words left by the one before.
    wdoc = np.repeat(np.arange(docs), n)
    cum = np.concatenate([np.zeros(1, np.int64), np.cumsum(wchars)])
    left = wo[1:][wdoc] - np.arange(len(s)) if len(s) else np.zeros(0, np.int64)
    twice = np.ones(len(s) + 1, bool)
    repeat = np.zeros(docs, np.int64)
    top_bad, top_share = np.zeros(docs, bool), np.zeros(docs)
    dup_bad, dup_share = np.zeros(docs, bool), np.zeros(docs)
    for k in range(2, max(DUP_GRAM) + 1):
        at = np.flatnonzero(twice[:-1] & twice[1:] & (left >= k))
        twice = np.zeros(len(s) + 1, bool)
        if not len(at):
            break
        order, begin, count, low = _groups(X.gram_hash_at(h, at, k) ^ doc_salt[wdoc[at]], at)
        many = np.repeat(count >= 2, count)
        twice[at[order[many]]] = True
        if k == 3:
            repeat = X.per_doc(_covered(len(s), np.flatnonzero(twice), 3), wo)
        if k in TOP_GRAM:
            mass = np.where(count >= 2, count * (cum[low + k] - cum[low]), 0)
            top = np.zeros(docs, np.int64)
            np.maximum.at(top, wdoc[low], mass)
            share = np.minimum(top / size, 1.0)
            top_share = np.maximum(top_share, share)
            top_bad |= share > TOP_GRAM[k]
        if k in DUP_GRAM:
            again = twice.copy()
            again[low] = False
            share = X.per_doc(np.where(_covered(len(s), np.flatnonzero(again), k), wchars, 0), wo) / size
            dup_share = np.maximum(dup_share, share)
            dup_bad |= share > DUP_GRAM[k]

    # lines: between newlines, whole, those with a word
    ls, le, lo = X.spans(data, off, data != 10)
    nonspace = np.concatenate([np.zeros(1, np.int64), np.cumsum(~X.SPACE[data])])
    full = nonspace[le] > nonspace[ls]
    ldoc = np.repeat(np.arange(docs), np.diff(lo))[full]
    ls, le = ls[full], le[full]
    dup_lines, dup_chars = np.zeros(docs, np.int64), np.zeros(docs, np.int64)
    if len(ls):
        _, _, _, low = _groups(X.span_hash(data, ls, le) ^ doc_salt[ldoc], np.arange(len(ls)))
        again = np.ones(len(ls), bool)
        again[low] = False
        dup_lines = np.bincount(ldoc[again], minlength=docs)
        dup_chars = np.bincount(ldoc[again], weights=(points[le] - points[ls])[again], minlength=docs)
    total = np.maximum(points[off[1:]] - points[off[:-1]], 1)
    line_share = dup_chars / total
    symbols = X.per_doc(SYMBOL[data], off)
    failed = (n < MIN_WORDS) | (100 * repeat > MAX_REPEAT * n)
    bad = top_bad | dup_bad | (line_share > MAX_DUP_LINE) | (symbols > MAX_SYMBOLS * np.maximum(n, 1))
    return {"n_words": n.astype(np.int64), "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup_lines.astype(np.int64),
            "n_repeat_words": repeat.astype(np.int64), "base_failed": failed, "kept": ~failed & ~bad,
            "dup_gram_share": dup_share, "top_gram_share": top_share, "dup_line_share": line_share}


def quality(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the measures, base_failed and kept."""
    names = {c: f"__in{i}" for i, c in enumerate(c for c in docs.columns if c.lower() not in OUT)}
    kept = list(names.values())  # plain names: mapInArrow takes none with dots
    text = next(n for c, n in names.items() if c.lower() == text_col.lower())
    d = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    schema = T.StructType([*d.schema.fields, *[T.StructField(k, t) for k, t in OUT.items()]])

    def run(batches):
        for batch in batches:
            for part in X.slices(batch, text):
                out = measure(part.column(part.schema.get_field_index(text)))
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(out[k]) for k in OUT]], [*kept, *OUT])
    return d.mapInArrow(run, schema).select(*[F.col(n).alias(c) for c, n in names.items()], *OUT)


def filter_quality(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, columns unchanged."""
    names = {c: f"__c{i}" for i, c in enumerate(docs.columns)}
    out = quality(docs.toDF(*names.values()), names[text_col]).where("kept")
    return out.select(*[F.col(n).alias(c) for c, n in names.items()])
