"""The reference's second and third entry points as compositions of operators.

``prepare_model_data``: cleaned reads -> taxon table -> planktonic eDNA index per
event -> presence matrix with standardised environment -> prevalence filter ->
integer codes (T13 -> T14 -> T15 -> M3 -> M1 -> M4 -> M5).

``project_scenarios``: environment -> scenario parameters per area and year ->
draws -> tail trimming -> probabilities of presence of every taxon at every draw ->
Bernoulli means -> expected richness per draw (M11 -> M12 -> M13 -> M9 -> M10 -> M19).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import with_sample_parts
from ..operators import abundance as A
from ..operators import scenario as M
from ..operators import taxonomy as T
from ..operators._util import product_by, with_group_agg
from ..operators.sparse import SparseTable
from ..session import ensure_checkpoint_dir


def planktonic_index(reads: DataFrame, annot: DataFrame, drop: DataFrame | None = None,
                     excluded_events: str | None = None, benthic: str = "BEN") -> DataFrame:
    """T13 + T14: (event, taxon, edna_index) for non-benthic taxa."""
    a = T.annotate_reads(reads, annot, drop, keep=["lifestyle"])
    a = with_sample_parts(a, parts=("event", "biol"))
    if excluded_events:
        a = a.where(~F.col("event").rlike(excluded_events))
    a = a.where(F.col("lifestyle") != benthic)
    return A.edna_index(a, "event", "taxon", "n_reads", biol_rep="biol", out="edna_index")


def model_table(presence: SparseTable, env: DataFrame, lo: int = 7, hi: int = 69, predictors=("temperature", "ph")) -> SparseTable:
    """M4 -> T15 -> M1 -> M5 on a sparse presence table: its rows carry the environment, the
    standardised predictors and codes. Means and deviations over the dense rows follow from the
    event list, in which every event stands for as many rows as there are taxa."""
    p = presence.prevalent(lo, hi)
    events = M.join_environment(p.rows, env, p.row).where(F.col("area").isNotNull())
    taxa = p.cols.select(F.count(F.lit(1)).alias("n")).scalar()
    aggs = {}
    for c in predictors:
        aggs |= {f"__m_{c}": F.avg(c), f"__v_{c}": F.var_pop(c)}
    events = with_group_agg(events, "area", __e=F.count(F.lit(1)), **aggs)
    for c in predictors:
        n = taxa * F.col("__e")
        sd = F.sqrt(F.try_divide(n * F.col(f"__v_{c}"), n - 1))
        z = F.when(sd.isNull() | (sd == 0), F.col(c)).otherwise((F.col(c) - F.col(f"__m_{c}")) / sd)
        events = events.withColumn(f"{c}_std", z)
    return p.keep_rows(events.drop("__e", *aggs).checkpoint()).coded("event_id", "taxon_id")


def prepare_model_data(index: DataFrame, env: DataFrame, exclude_taxa: str | None = None,
                       lo: int = 7, hi: int = 69, predictors=("temperature", "ph")) -> DataFrame:
    """M3 -> M4 -> T15 -> M1 -> M5 on an (event, taxon, edna_index) table; the dense matrix is
    formed last, of the prevalent taxa and the events with environment only."""
    p = M.presence_table(index, "event", "taxon", "edna_index", exclude=exclude_taxa)
    return model_table(p, env, lo, hi, predictors).dense()


def project_scenarios(env: DataFrame, coef: DataFrame, groups: DataFrame, years, n_draws: int = 100,
                      seed: int = 1, presence_draws: int = 100, lo: float = 0.03,
                      hi: float = 0.98) -> DataFrame:
    """Expected richness per scenario draw and group (e.g. phylum).

    ``coef`` is (taxon, area, intercept, b_t, b_ph); ``groups`` maps taxon -> group.
    Draws are keyed (area, year, draw); every taxon of an area is scored at every draw of that
    area, in even pieces of the product (a few areas hold all rows). The group goes with the
    coefficients, so a piece's scored pairs are summed at once: they are never rows of a table.
    """
    ensure_checkpoint_dir(env.sparkSession)
    params = M.scenario_params(env, years)
    draws = M.scenario_draws(params, n_draws, seed)
    draws = M.trim_tails(draws, ("temperature", "ph"), ("year", "area"), lo, hi).checkpoint()
    own = coef.join(groups, "taxon", "left").checkpoint()
    scored = product_by(own, draws, "area", laid_out=False)
    scored = scored.with_value("p", M.logistic_of_pairs("temperature", "ph"))
    scored = M.binomial_mean(scored, "p", ["taxon", "area", "year", "draw"], presence_draws, seed)
    return M.richness_by_point(scored, ["area", "year", "draw"], "phylum", "mean_presence")
