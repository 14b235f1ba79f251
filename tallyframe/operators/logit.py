"""Logistic regressions of many groups at once.

Every group (a taxon, an area, a taxon under one of several predictor sets) has a model of its
own: classes against the first one, an intercept per class and level, a slope per class and
predictor, an optional L2 penalty. All groups are fitted together by Newton steps: a round is
one pass over the data that adds gradient and Hessian per group, then one small solve per
group. Coefficients stay a table; groups that have converged leave the rounds.

Rows are packed once into blocks of bounded size (equal rows become one with a weight), so a
group with a third of all rows is many blocks, and a round joins coefficients to blocks on
(group, block), never on the group alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ._util import as_list

#: Rows of a block, and sums that a task holds before it passes them on.
BLOCK_ROWS, HELD_SUMS = 4096, 1 << 20
STATE = ("gid bigint, blocks bigint, k int, levels int, dim int, n double, beta array<double>, loss double, trial array<double>, "
         "delta array<double>, step double, status int, gradient double")
RUNNING, CONVERGED, STALLED = 0, 1, 2


def _block_sums(trial, k, levels, dim, y, level, w, x):
    """Log-likelihood, gradient and (upper) Hessian of one block."""
    import numpy as np
    q = levels + dim
    z = np.zeros((len(y), q))
    z[np.arange(len(y)), level] = 1.0
    z[:, levels:] = x.reshape(len(y), dim)
    eta = z @ trial.reshape(k, q).T
    top = np.maximum(eta.max(axis=1, initial=0.0), 0.0)
    e = np.exp(eta - top[:, None])
    total = e.sum(axis=1) + np.exp(-top)
    p = e / total[:, None]
    own = np.where(y > 0, np.take_along_axis(eta, np.maximum(y - 1, 0)[:, None], 1)[:, 0] if k else 0.0, 0.0)
    loglik = float((w * (own - top - np.log(total))).sum())
    hit = y[:, None] == np.arange(1, k + 1)
    gradient = ((hit - p) * w[:, None]).T @ z
    hessian = np.zeros((k, q, k, q))
    for a in range(k):
        for b in range(a, k):
            v = w * p[:, a] * ((a == b) - p[:, b])
            hessian[a, :, b, :] = (z * v[:, None]).T @ z
            hessian[b, :, a, :] = hessian[a, :, b, :].T
    return np.concatenate([[loglik], gradient.ravel(), hessian.reshape(k * q, k * q)[np.triu_indices(k * q)]])


def _sums(batches):
    import numpy as np
    import pyarrow as pa

    def out():
        size = np.array([len(v) for v in held.values()])
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.fromiter(held, np.int64), size)), pa.array(np.concatenate([np.arange(s) for s in size]).astype(np.int32)),
             pa.array(np.concatenate(list(held.values())))], ["gid", "pos", "s"])

    held, size = {}, 0
    for batch in batches:
        for r in batch.to_pylist():
            s = _block_sums(np.array(r["trial"]), r["k"], r["levels"], r["dim"], np.array(r["y"]), np.array(r["level"]),
                            np.array(r["w"], float), np.array(r["x"], float))
            if r["gid"] in held:
                held[r["gid"]] += s
            else:
                held[r["gid"]] = s
                size += len(s)
            if size > HELD_SUMS:
                yield out()
                held, size = {}, 0
    if held:
        yield out()


def _newton(reg: float, tol: float):
    """The state after the sums at the trial point are known: accept it and take a Newton step,
    or halve the step that led there."""
    def step(r):
        import numpy as np
        p = r["k"] * (r["levels"] + r["dim"])
        s, trial, ridge = np.array(r["sums"]), np.array(r["trial"]), reg * r["n"]
        loss = -s[0] + 0.5 * ridge * float(trial @ trial)
        if r["loss"] is not None and not loss <= r["loss"] + 1e-12 * abs(r["loss"]):
            half = r["step"] / 2
            if half < 1e-9:
                return {**r, "status": STALLED}
            return {**r, "step": half, "trial": (np.array(r["beta"]) + half * np.array(r["delta"])).tolist()}
        gradient = s[1:1 + p] - ridge * trial
        hessian = np.zeros((p, p))
        hessian[np.triu_indices(p)] = s[1 + p:]
        hessian = np.triu(hessian, 1).T + hessian + ridge * np.eye(p)
        most = float(np.abs(gradient).max(initial=0.0))
        new = {**r, "beta": trial.tolist(), "loss": loss, "gradient": most, "step": 1.0}
        if most <= tol * r["n"]:
            return {**new, "status": CONVERGED}
        delta = np.linalg.lstsq(hessian, gradient, rcond=1e-14)[0]
        return {**new, "delta": delta.tolist(), "trial": (trial + delta).tolist()}

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            rows = [step(r) for r in batch.to_pylist()]
            for r in rows:
                del r["sums"]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, batch.schema.remove(batch.schema.get_field_index("sums")))
    return run


class GroupedLogit:
    """The fits: ``groups`` (group columns, n, n_params, rounds' outcome) and ``coefficients``."""

    def __init__(self, meta: DataFrame, state: DataFrame, keys: list):
        self._j = meta.join(state.select("gid", "beta", "loss", "status", "gradient"), "gid")
        self.keys = keys
        self.groups = self._j.select(
            "g.*", "n", ((F.size("classes") - 1) * (F.size("level_names") + F.col("dim"))).alias("n_params"),
            F.col("status").isin(CONVERGED).alias("converged"), F.col("gradient").alias("max_gradient"), F.col("loss").alias("penalised_loss"))

    def coefficients(self, label: str = "label", level: str | None = None) -> DataFrame:
        """(group columns, label, [level,] intercept, slopes): a row per class and level; the
        first class of a group has zeros."""
        d = self._j.select("g.*", "beta", "level_names", "dim", F.size("level_names").alias("__a"), F.posexplode("classes").alias("__c", label))
        d = d.select(*self.keys, label, "beta", "dim", "__a", "__c", F.posexplode("level_names").alias("__l", "__level"))
        first = (F.col("__c") - 1) * (F.col("__a") + F.col("dim"))
        zero = F.col("__c") == 0
        return d.select(*self.keys, label, *([F.col("__level").alias(level)] if level else []),
                        F.when(zero, 0.0).otherwise(F.get("beta", first + F.col("__l"))).alias("intercept"),
                        F.when(zero, F.array_repeat(F.lit(0.0), F.col("dim")))
                         .otherwise(F.slice("beta", F.greatest(first, F.lit(0)) + F.col("__a") + 1, F.col("dim"))).alias("slopes"))


def fit_grouped_logit(df: DataFrame, group, label: str, x: Column, level: str | None = None, reg: float = 0.0, tol: float = 1e-11,
                      max_rounds: int = 100, block_rows: int = BLOCK_ROWS, classes: list | None = None) -> GroupedLogit:
    """One multinomial logistic regression per ``group`` of ``label`` on the array ``x``, with an
    intercept for each ``level``. The penalty is ``reg * n / 2`` times the squared coefficients.
    ``classes`` fixes the classes of every group, the baseline first; else they are those of its
    rows, sorted.

    Rows with a null label, level or predictor are left out; a group with one class has no
    parameters; without a penalty, classes that the predictors separate perfectly have no
    finite optimum, and the rounds end when the gradient is below ``tol`` per row.
    """
    ensure_checkpoint_dir(df.sparkSession)
    keys = as_list(group)
    names = F.col(level).cast("string") if level else F.lit("")
    d = df.select(F.struct(*keys).alias("g"), F.col(label).alias("label"), names.alias("level"), x.cast("array<double>").alias("x"))
    d = d.where(F.col("label").isNotNull() & F.col("level").isNotNull() & ~F.exists("x", lambda v: v.isNull() | F.isnan(v)))
    if classes:
        d = d.where(F.col("label").isin(classes))
    d = d.groupBy("g", "label", "level", "x").agg(F.count(F.lit(1)).alias("w")).checkpoint()
    meta = d.groupBy("g").agg(
        F.sum("w").cast("double").alias("n"), F.ceil(F.count(F.lit(1)) / block_rows).alias("blocks"), F.max(F.size("x")).alias("dim"),
        (F.array(*[F.lit(c) for c in classes]) if classes else F.array_sort(F.collect_set("label"))).alias("classes"), F.array_sort(F.collect_set("level")).alias("level_names"))
    meta = meta.withColumn("gid", F.monotonically_increasing_id()).checkpoint()
    own = meta.select(F.col("g").alias("__g"), "gid", "blocks", "classes", "level_names")
    rows = d.join(own, d["g"].eqNullSafe(own["__g"])).select(
        "gid", F.pmod(F.xxhash64("label", "level", "x"), F.col("blocks")).alias("blk"),
        F.struct((F.array_position("classes", F.col("label")) - 1).cast("int").alias("y"),
                 (F.array_position("level_names", F.col("level")) - 1).cast("int").alias("l"), "w", "x").alias("r"))
    blocks = rows.groupBy("gid", "blk").agg(F.collect_list("r").alias("r")).select(
        "gid", "blk", F.transform("r", lambda r: r["y"]).alias("y"), F.transform("r", lambda r: r["l"]).alias("level"),
        F.transform("r", lambda r: r["w"]).alias("w"), F.flatten(F.transform("r", lambda r: r["x"])).alias("x")).checkpoint()
    p = (F.size("classes") - 1) * (F.size("level_names") + F.col("dim"))
    zeros = F.array_repeat(F.lit(0.0), p)
    start = meta.select(
        "gid", "blocks", (F.size("classes") - 1).alias("k"), F.size("level_names").alias("levels"), F.col("dim").cast("int").alias("dim"), "n",
        zeros.alias("beta"), F.lit(None).cast("double").alias("loss"), zeros.alias("trial"), zeros.alias("delta"), F.lit(1.0).alias("step"),
        F.when(p == 0, CONVERGED).otherwise(RUNNING).alias("status"), F.lit(0.0).alias("gradient"))
    open_, done = start.where(F.col("status") == RUNNING), [start.where(F.col("status") != RUNNING)]
    newton = _newton(reg, tol)
    for _ in range(max_rounds):
        at = open_.select("gid", "k", "levels", "dim", "trial", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("blk"))
        sums = blocks.join(at, ["gid", "blk"]).select("gid", "k", "levels", "dim", "trial", "y", "level", "w", "x").mapInArrow(
            _sums, "gid bigint, pos int, s double").groupBy("gid", "pos").agg(F.sum("s").alias("s"))
        sums = sums.groupBy("gid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda v: v["s"]).alias("sums"))
        state = open_.join(sums, "gid").mapInArrow(newton, STATE).checkpoint()
        done.append(state.where(F.col("status") != RUNNING))
        open_ = state.where(F.col("status") == RUNNING)
        if open_.limit(1).count() == 0:
            break
    out = done[0]
    for part in [*done[1:], open_]:  # what still runs counts as not converged
        out = out.unionByName(part)
    return GroupedLogit(meta, out.checkpoint(), keys)
