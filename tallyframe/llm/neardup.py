"""Op 10. Near-duplicate groups with SetSketch registers.

A document's set is its distinct word n-grams (64-bit hashes). Register i keeps
``floor(1 - log_b(min h_i / a))`` over the set, h_i a hash taken as an exponential value
(b = 1.001, a = 20, 16 bits): registers of a union are maxima, and two sets agree in a
register with a probability close to their similarity J.

1. One pass over the texts gives each document its set size, registers and a 128-bit
   fingerprint of the set. Documents of equal sets form a class; only classes go on, so
   copies are never paired.
2. Bands of ``ROWS`` registers are hashed into buckets. At J = 0.8 a pair shares none of
   the ``BANDS`` buckets with probability 5e-6; at J = 0.2 it shares one with 0.003.
3. Pairs from buckets: first every member with the bucket's hub (the member that meets most
   others); groups that hang together are then known, and only pairs of different groups are
   looked at further. Those that meet in a bucket are listed, less those that the triangle
   inequality for distances to the hub excludes; within a large family of classes around one
   hub all of them are compared in blocks, and only links leave the tasks. Thousands of near
   copies so cost a few rows a copy, and no link between groups is lost.
4. For each pair the joint likelihood of the registers (counts of larger, smaller, equal)
   estimates J; pairs more than ``MARGIN`` (6 standard errors) below the limit end here.
   All others are confirmed by counting their whole sets.
5. Connected components of confirmed links; a component's id is its smallest document id.

Sizes whose ratio is below the limit cannot be linked and are not paired. Everything is a
shuffle on bucket, class or node keys; intermediate tables are in the shared folder.

Defined results: a null text, or one without words, has an empty set and is linked with
nothing; a text with fewer words than n has its whole word sequence as one element; rows
that repeat an id or a text fall into one class each by set; rows without an id take part
but name no component (null if it has no other row); an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from ._graph import components
from ._store import stored

SHINGLE, PERCENT = 5, 80
BASE_B, RATE_A = 1.001, 20.0
BANDS, ROWS = 40, 6
REGISTERS = BANDS * ROWS
MARGIN = 0.2
#: Families of more classes are compared in blocks of about BLOCK classes.
FAMILY, BLOCK = 64, 512
_G = np.random.Generator(np.random.PCG64(10))
_MUL = _G.integers(1, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _G.integers(0, 2**63, REGISTERS, dtype=np.uint64)


def shingle_sets(texts, n: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text."""
    data, off = X.doc_bytes(texts)
    data = X.LOWER[data]
    s, e, wo = X.spans(data, off, ~X.SPACE[data])
    h = X.span_hash(data, s, e)
    g = X.gram_hash(h, n)
    out = []
    for a, b in zip(wo[:-1].tolist(), wo[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(g[a:b - n + 1]))
        elif b > a:
            out.append(X.gram_hash(h[a:b], b - a) ^ np.uint64(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """SetSketch registers (uint16), one row per set."""
    low = np.full((len(sets), REGISTERS), 2**64 - 1, np.uint64)
    with np.errstate(over="ignore"):
        for i, g in enumerate(sets):
            for c in range(0, len(g), 1024):
                v = g[c:c + 1024, None] * _MUL
                v += _ADD
                low[i] = np.minimum(low[i], v.min(axis=0))
    u = (low.astype(np.float64) + 0.5) * 2.0**-64
    x = -np.log1p(-np.minimum(u, 1 - 2**-53)) / RATE_A
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE_B)), 0, 65535).astype("<u2")


def estimate(ku: np.ndarray, kv: np.ndarray, nu: np.ndarray, nv: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity of set pairs from their registers and sizes."""
    ku, kv = ku.astype(np.int64), kv.astype(np.int64)
    more, less = (ku > kv).sum(axis=1), (ku < kv).sum(axis=1)
    same = ku.shape[1] - more - less
    u, v = nu / (nu + nv), nv / (nu + nv)
    c, lb = (BASE_B - 1) / BASE_B, np.log(BASE_B)

    def p(x):
        return -np.log1p(-x * c) / lb

    def slope(x):
        return c / (1 - x * c) / lb
    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):  # the derivative falls from left to right
        j = (lo + hi) / 2
        x, y = u - v * j, v - u * j
        d = -more * v * slope(x) / np.maximum(p(x), 1e-12) - less * u * slope(y) / np.maximum(p(y), 1e-12) \
            + same * (v * slope(x) + u * slope(y)) / np.maximum(1 - p(x) - p(y), 1e-12)
        up = d > 0
        lo, hi = np.where(up, j, lo), np.where(up, hi, j)
    return (lo + hi) / 2


def _fingerprint(g: np.ndarray) -> bytes:
    with np.errstate(over="ignore"):
        a = np.uint64(np.add.reduce(X.mix(g ^ np.uint64(0x5BD1E995)))) + np.uint64(len(g)) * X._BASE
        b = np.uint64(np.add.reduce(X.mix(g + X._BASE)))
    return np.array([a, b], ">u8").tobytes()


def sketch(docs: DataFrame, text_col: str, n: int, out: dict[str, str], regs: bool = True, sets: bool = False) -> DataFrame:
    """``docs`` with its set's size, class (null if empty), and registers or whole set.
    ``out``: names of the new columns n, cls, regs, shingles."""
    cols = [("n", "bigint"), ("cls", "binary")] + [("regs", "binary")] * regs + [("shingles", "binary")] * sets
    names = docs.columns
    from pyspark.sql import types as T
    kinds = {"bigint": T.LongType(), "binary": T.BinaryType()}
    schema = T.StructType([*docs.schema.fields, *[T.StructField(out[c], kinds[t]) for c, t in cols]])

    def run(batches):
        for batch in batches:
            for part in X.slices(batch, text_col):
                made = shingle_sets(part.column(part.schema.get_field_index(text_col)), n)
                new = [pa.array([len(g) for g in made], pa.int64()),
                       pa.array([_fingerprint(g) if len(g) else None for g in made], pa.binary())]
                if regs:
                    new.append(pa.array([r.tobytes() for r in registers(made)], pa.binary()))
                if sets:
                    new.append(pa.array([g.astype("<u8").tobytes() for g in made], pa.binary()))
                yield pa.RecordBatch.from_arrays([*part.columns, *new], [*names, *[out[c] for c, _ in cols]])
    return docs.mapInArrow(run, schema)


def _measure(pairs: DataFrame, sides: DataFrame, percent: int, every: bool) -> DataFrame:
    """(a, b, link, dist) of pairs (a, b): dist is the exact Jaccard distance. Unless ``every``
    is set, pairs whose estimate is far below the limit are left out."""
    a = sides.select(F.col("cls").alias("a"), F.col("regs").alias("ra"), F.col("shingles").alias("sa"))
    b = sides.select(F.col("cls").alias("b"), F.col("regs").alias("rb"), F.col("shingles").alias("sb"))
    both = pairs.select("a", "b").join(a, "a").join(b, "b").select("a", "b", "ra", "rb", "sa", "sb")

    def run(batches):
        for batch in batches:
            for c in range(0, batch.num_rows, 256):
                part = batch.slice(c, 256)
                ra, rb = (np.stack([np.frombuffer(x.as_py(), "<u2") for x in part.column(i)]) for i in (2, 3))
                sa, sb = ([np.frombuffer(x.as_py(), "<u8") for x in part.column(i)] for i in (4, 5))
                na, nb = (np.array([len(x) for x in s]) for s in (sa, sb))
                keep = np.arange(len(na))
                if not every:
                    keep = np.flatnonzero(estimate(ra, rb, na, nb) >= percent / 100 - MARGIN)
                common = np.array([len(np.intersect1d(sa[i], sb[i], assume_unique=True)) for i in keep], np.int64)
                union = na[keep] + nb[keep] - common
                rows = pa.array(keep)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(rows), part.column(1).take(rows), pa.array(100 * common >= percent * union),
                     pa.array(1 - common / np.maximum(union, 1))], ["a", "b", "link", "dist"])
    return both.mapInArrow(run, "a binary, b binary, link boolean, dist double")


def _family_links(members: DataFrame, sides: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between classes of one family and different groups. ``members``: cls, n,
    root, family, blocks. A class goes to one task for each block of its family; a task holds
    two blocks of about ``BLOCK`` classes whatever the family's size, and emits links only."""
    own = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
    m = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    m = m.select("cls", "root", "family", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    m = m.join(sides, "cls").select("cls", "root", "family", "own", "i", "j", "regs", "shingles")

    def links(table: pa.Table) -> pa.Table:
        cls, regs = table.column("cls").to_pylist(), np.stack([np.frombuffer(x, "<u2") for x in table.column("regs").to_pylist()])
        sets = [np.frombuffer(x, "<u8") for x in table.column("shingles").to_pylist()]
        size = np.array([len(x) for x in sets])
        _, root = np.unique(np.array(table.column("root").to_pylist(), object), return_inverse=True)
        own = table.column("own").to_numpy()
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        a, b = [], []
        cols = np.flatnonzero(own == j)
        for x in np.flatnonzero(own == i):
            y = cols[(root[cols] != root[x]) & (np.minimum(size[cols], size[x]) * 100 >= np.maximum(size[cols], size[x]) * percent)]
            if i == j:
                y = y[y > x]
            if len(y):
                y = y[estimate(np.broadcast_to(regs[x], (len(y), REGISTERS)), regs[y], np.full(len(y), size[x]), size[y]) >= percent / 100 - MARGIN]
            for k in y:
                common = len(np.intersect1d(sets[x], sets[k], assume_unique=True))
                if 100 * common >= percent * (size[x] + size[k] - common):
                    a.append(min(cls[x], cls[k]))
                    b.append(max(cls[x], cls[k]))
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})
    return m.groupBy("family", "i", "j").applyInArrow(links, "a binary, b binary")


def group_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                          percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(rows, groups): rows has id, th (text hash), n and cls of each row of ``docs``;
    groups has cls, root and low (the smallest id of the whole component) of each class."""
    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("th"),
                       F.col(f"`{text_col}`").alias("text"))
    names = {c: c for c in ("n", "cls", "regs", "shingles")}
    rows = stored(sketch(base, "text", shingle, names).drop("text"), "sketches")
    classes = rows.where("cls is not null").groupBy("cls").agg(
        F.min("id").alias("low"), F.min(F.struct("id", "th")).alias("rep"), F.max("n").alias("n"), F.max("regs").alias("regs"))
    classes = stored(classes, "classes")
    band = F.expr(f"explode(transform(sequence(0, {BANDS - 1}), i -> xxhash64(i, substring(regs, i * {2 * ROWS} + 1, {2 * ROWS}))))")
    bands = classes.select("cls", "n", band.alias("key"))
    # buckets of one class go at once; the rest is a small table
    shared = bands.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    met = stored(bands.join(shared, "key"), "members")
    # a bucket's hub: the member that meets most others over all its buckets, as the origin of
    # a family of copies does
    degree = met.groupBy("cls").agg(F.sum("c").alias("degree"))
    met = met.join(degree, "cls")
    hubs = met.groupBy("key").agg(F.max(F.struct("degree", "cls")).alias("h")).select("key", F.col("h.cls").alias("hub"))
    members = stored(met.join(hubs, "key").select("key", "cls", "n", "degree", "hub"), "members")
    fits = f"least({{0}}, {{1}}) * 100 >= greatest({{0}}, {{1}}) * {percent}"
    reach = 1 - percent / 100 + 1e-9

    # whole sets of the classes that meet another one, from the texts of their representatives
    wanted = classes.join(members.select("cls").distinct(), "cls").select("rep.id", "rep.th", "cls", "regs")
    texts = base.join(wanted.select("id", "th"), base["id"].eqNullSafe(wanted["id"]) & (base["th"] == wanted["th"]), "left_semi")
    whole = sketch(texts.select("text"), "text", shingle, names, regs=False, sets=True).drop("text", "n")
    whole = whole.groupBy("cls").agg(F.max("shingles").alias("shingles"))
    sides = stored(wanted.select("cls", "regs").join(whole, "cls"), "sets")
    sizes = classes.select(F.col("cls").alias("other"), F.col("n").alias("other_n"))

    def pair(x, y):
        return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")

    # first hub: every member with its bucket's hub, measured exactly
    first = members.where(F.col("cls") != F.col("hub")).select("cls", "n", F.col("hub").alias("other")).distinct() \
        .join(sizes, "other").where(fits.format("n", "other_n")).select(*pair(F.col("cls"), F.col("other"))).distinct()
    first = stored(_measure(first, sides, percent, True), "measured")
    links = first.where("link").select("a", "b")
    root = components(links)
    # how far each member is from its hub. Jaccard distance is a metric: two members whose
    # distances to one hub differ by more than the limit's distance cannot be linked.
    far = first.select("a", "b", "dist")
    far = far.union(far.select(F.col("b"), F.col("a"), F.col("dist"))).toDF("x", "y", "dist")
    labelled = members.join(far, (members["cls"] == far["x"]) & (members["hub"] == far["y"]), "left") \
        .join(root, members["cls"] == root["node"], "left") \
        .select("key", "cls", "n", "degree", "hub", F.coalesce("root", "cls").alias("root"),
                F.when(F.col("cls") == F.col("hub"), 0.0).otherwise(F.col("dist")).alias("dist"))
    labelled = stored(labelled, "members")
    near = F.coalesce(F.abs(F.col("x.dist") - F.col("y.dist")) <= reach, F.lit(True))
    # a family: the classes whose best-connected hub is the same. Large families with several
    # groups left are compared in blocks, each pair of blocks in one task, and only their
    # links come out; all other pairs that still meet in a bucket are listed.
    strong = members.select("key", "hub").distinct().join(degree.select(F.col("cls").alias("hub"), "degree"), "hub")
    lead = labelled.select("key", "cls", "n", "root").join(strong, "key").groupBy("cls").agg(
        F.max(F.struct("degree", "hub")).alias("h"), F.max("n").alias("n"), F.max("root").alias("root")) \
        .select("cls", "n", "root", F.col("h.hub").alias("family"))
    lead = stored(lead, "families")
    large = lead.groupBy("family").agg(F.count(F.lit(1)).alias("size"), F.min("root").alias("r1"), F.max("root").alias("r2")) \
        .where((F.col("size") > FAMILY) & (F.col("r1") < F.col("r2"))).select("family", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    within = _family_links(lead.join(large, "family"), sides, percent)
    both = labelled.join(lead.select("cls", "family"), "cls").join(large.select("family", F.lit(True).alias("large")), "family", "left")
    open_ = both.groupBy("key").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 < r2").select("key")
    both = stored(both.where(F.col("cls") != F.col("hub")).join(open_, "key")  # hubs are done
                  .select("key", "cls", "n", "dist", "root", "family", "large"), "members")
    near = F.coalesce(F.abs(F.col("x.dist") - F.col("y.dist")) <= reach, F.lit(True))
    x, y = both.alias("x"), both.alias("y")
    done = F.coalesce(F.col("x.large"), F.lit(False)) & (F.col("x.family") == F.col("y.family"))
    rest = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.cls") < F.col("y.cls")) & (F.col("x.root") != F.col("y.root"))
                  & ~done & F.expr(fits.format("x.n", "y.n")) & near) \
        .select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b")).distinct() \
        .join(first.select("a", "b"), ["a", "b"], "left_anti")
    last = _measure(rest, sides, percent, False).where("link").select("a", "b").union(within)
    last = stored(last, "links")
    if last.limit(1).count():
        root = components(links.union(last))
    groups = classes.select("cls", "low").join(root, classes["cls"] == root["node"], "left") \
        .select("cls", "low", F.coalesce("root", "cls").alias("root"))
    lowest = groups.groupBy("root").agg(F.min("low").alias("least_id"))
    return rows, groups.join(lowest, "root").select("cls", "root", F.col("least_id").alias("low"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    rows, groups = group_near_duplicates(docs, id_col, text_col, shingle, percent)
    groups = stored(groups.select("cls", "low"), "groups")
    out = rows.select("id", "n", "cls").join(groups, "cls", "left")
    comp = F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("low"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), comp.alias("component_id"),
                      F.col("id").eqNullSafe(comp).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                         percent: int = PERCENT) -> DataFrame:
    """One row of ``docs`` for each group (the one of the smallest id; of several, the one
    with the smallest text hash) and every row without words, columns unchanged."""
    rows, groups = group_near_duplicates(docs, id_col, text_col, shingle, percent)
    first = rows.where("cls is not null").join(groups.select("cls", "root"), "cls").groupBy("root").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("r")).select("r.id", "r.th")
    keep = stored(first.withColumn("one", F.lit(True)).union(
        rows.where("cls is null").select("id", "th", F.lit(False).alias("one"))).distinct(), "kept")
    names = {c: f"__c{i}" for i, c in enumerate(docs.columns)}
    d = docs.toDF(*names.values())
    d = d.withColumn("__th", F.xxhash64(F.col(names[text_col])))
    hit = d.join(keep, d[names[id_col]].eqNullSafe(keep["id"]) & (d["__th"] == keep["th"]))
    # rows equal in id and text are one document
    twice = hit.where("one").groupBy("id", "th").count().where("count > 1").limit(1).count()
    if twice:
        singles = hit.where("one").dropDuplicates(["id", "th"])
        hit = singles.unionByName(hit.where("not one"))
    return hit.select(*[F.col(n).alias(c) for c, n in names.items()])
