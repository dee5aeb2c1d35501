"""Spend-response curves: Hill fit by variable projection, operating point, diagnostics.

For a fixed (k, n) the best ceiling v is a ratio of two sums, so the fit is a search over two
parameters only: a coarse log grid, then shrinking grids around the incumbent.  Statistics, fallback
and diagnostics are JVM aggregates.  The search itself evaluates hundreds of candidates per row,
which Spark expressions would do one exploded row at a time; it runs as vectorised numpy per
campaign instead, after ONE shuffle by campaign for all rounds: the rows of a partition are sorted by
campaign, and a task cuts them apart itself.  A campaign's rows are its days, so a group is bounded
by the length of the history (3 653 rows per decade), not by the data volume.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import curves as C
from tidemark.functions.exprs import is_mature, ratio0, require_columns
from tidemark.functions.text import fill, fixed
from tidemark.roles import PANEL, Roles

# --- fixed values: fit thresholds, parameter bounds, reason texts -----------------------
MIN_POINTS = 8
MIN_SPEND_CV = 0.05
RELIABLE_R2 = 0.25
V_BOUNDS = (0.1, 5.0)       # times the highest revenue (at least 1.0)
K_BOUNDS = (0.001, 200.0)   # times the highest spend
N_BOUNDS = (0.3, 6.0)
OPERATING_ROWS = 30
REASON_OK = "ok"
REASON_LOW_R2 = "low R² ({r2})"
REASON_FEW = "linear fallback: too few nonzero points ({n})"
REASON_FLAT = "linear fallback: spend variance too low"
# ---------------------------------------------------------------------------------------

COARSE_K = [round(10 ** (-3 + i * 5.301 / 11), 6) for i in range(11)] + [K_BOUNDS[1]]
COARSE_N = [0.3, 0.5, 0.75, 1.0, 1.35, 1.8, 2.4, 3.2, 4.4, 6.0]
REFINE_STEPS, REFINEMENTS, SHRINK = 7, 10, 0.5
FIT_BLOCK = 256            # rows of a campaign that meet all candidates at once


def _fit_rows(df: DataFrame, roles: Roles) -> DataFrame:
    """Mature, clean rows with the two measures."""
    keep = is_mature(df, roles.mature)
    s, r = F.col(roles.spend).cast("double"), F.col(roles.revenue).cast("double")
    finite = (s >= 0) & (r >= 0) & (s < float("inf")) & (r < float("inf"))
    return df.filter(keep & finite).select(
        F.col(roles.entity).alias("campaign_id"), s.alias("s"), r.alias("r")
    )


def fit_statistics(df: DataFrame, roles: Roles = PANEL) -> DataFrame:
    """Per campaign: what the fit and its fallback need to know about the data."""
    rows = _fit_rows(df, roles)
    spent = F.col("s") > 0
    s, r = F.when(spent, F.col("s")), F.when(spent, F.col("r"))
    return rows.groupBy("campaign_id").agg(
        F.count(s).alias("n_points"),
        F.avg(s).alias("spend_mean"),
        F.stddev_pop(s).alias("spend_std"),
        F.max("s").alias("max_spend"),
        F.greatest(F.max(r), F.lit(1.0)).alias("max_revenue"),
        (F.var_pop(r) * F.count(r)).alias("ss_total"),
        F.sum("s").alias("sum_spend"),
        F.sum("r").alias("sum_revenue"),
    )


def _grid_search(refinements: int):
    """Best (relative k, n, v) and its error for one campaign's spend and revenue; None if they cannot be fitted.

    Everything it needs is bound here, so that it travels to the executors by value.
    """
    k_grid, n_grid = np.array(COARSE_K), np.array(COARSE_N)
    k_step, n_step = math.log(K_BOUNDS[1] / K_BOUNDS[0]) / (len(COARSE_K) - 1), 0.3
    (k_lo, k_hi), (n_lo, n_hi), (v_lo, v_hi) = K_BOUNDS, N_BOUNDS, V_BOUNDS
    min_points, min_cv, shrink = MIN_POINTS, MIN_SPEND_CV, SHRINK
    offsets, block = np.linspace(-1.0, 1.0, REFINE_STEPS), FIT_BLOCK

    def best_of(share, r, top, kr, n):
        # (share / k) ** -n is share ** -n times k ** n: one power per row and n serves every k.
        scale = kr[:, None] ** n
        hh, rh = np.zeros(scale.shape), np.zeros(scale.shape)
        for lo in range(0, len(r), block):
            h = scale[:, :, None] * share[lo:lo + block] ** -n[:, None]
            h += 1.0
            np.divide(1.0, h, out=h)
            hh += np.einsum("kni,kni->kn", h, h)
            rh += h @ r[lo:lo + block]
        v = np.clip(np.divide(rh, hh, out=np.zeros_like(rh), where=hh > 0), v_lo * top, v_hi * top)
        sse = (r * r).sum() - 2.0 * v * rh + v * v * hh
        i, j = np.unravel_index(int(np.argmin(sse)), sse.shape)  # candidates ascend in (k, n): ties go to the smallest
        return kr[i], n[j], v[i, j], sse[i, j]

    def search(s, r):
        if len(s) < min_points or s.std() < s.mean() * min_cv:
            return None
        top = max(r.max(), 1.0)
        with np.errstate(over="ignore", divide="ignore"):
            share = s / s.max()
            best = best_of(share, r, top, k_grid, n_grid)
            dk, dn = k_step, n_step
            for _ in range(refinements):
                best = best_of(
                    share, r, top,
                    np.clip(best[0] * np.exp(offsets * dk), k_lo, k_hi),
                    np.clip(best[1] * np.exp(offsets * dn), n_lo, n_hi),
                )
                dk, dn = dk * shrink, dn * shrink
        return best

    return search


def _best_fits(rows: DataFrame, refinements: int) -> DataFrame:
    """(campaign_id, kr, n, v_max, sse) of every campaign of (campaign_id, s, r) that can be fitted."""
    search, measures = _grid_search(refinements), ["kr", "n", "v_max", "sse"]

    def found(ident: pa.Array, pieces: list) -> list:
        best = search(*(np.concatenate(c) for c in zip(*pieces)))
        return [] if best is None else [(ident, best)]

    def packed(fits: list) -> Iterator[pa.RecordBatch]:
        if fits:
            idents, best = zip(*fits)
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays(idents), *[pa.array(c, pa.float64()) for c in zip(*best)]], ["campaign_id", *measures])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ident, pieces = None, []  # the campaign that may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            s, r = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("s", "r"))
            runs = pc.run_end_encode(batch.column("campaign_id"))
            fits, lo = [], 0
            for i, hi in enumerate(runs.run_ends.to_pylist()):
                now = runs.values.slice(i, 1)
                if pieces and not now.equals(ident):
                    fits += found(ident, pieces)
                    pieces = []
                ident = now
                pieces.append((s[lo:hi], r[lo:hi]))
                lo = hi
            yield from packed(fits)
        if pieces:
            yield from packed(found(ident, pieces))

    id_type = rows.schema["campaign_id"].dataType.simpleString()
    return rows.repartition("campaign_id").sortWithinPartitions("campaign_id").mapInArrow(
        run, f"campaign_id {id_type}, {', '.join(f'{c} double' for c in measures)}")


def fit_hill(df: DataFrame, roles: Roles = PANEL, refinements: int = REFINEMENTS) -> DataFrame:
    """Curve parameters and diagnostics per campaign; ``refinements=0`` is the fixed grid alone."""
    return finish_fit(fit_statistics(df, roles), _best_fits(_fit_rows(df, roles).filter("s > 0"), refinements))


def finish_fit(stats: DataFrame, best: DataFrame) -> DataFrame:
    """Diagnostics of fitted campaigns, straight lines for the others."""
    joined = stats.join(best, "campaign_id", "left")
    fitted = F.col("sse").isNotNull()
    r2 = F.when(F.col("ss_total") == 0, F.lit(1.0)).otherwise(
        F.least(F.lit(1.0), F.greatest(F.lit(-1.0), 1.0 - F.try_divide(F.col("sse"), F.col("ss_total"))))
    )
    roas = F.when(F.col("sum_spend") > 0, F.col("sum_revenue") / F.col("sum_spend")).otherwise(F.lit(1.0))
    line_k = F.greatest(F.coalesce(F.col("max_spend") * 1000.0, F.lit(1.0)), F.lit(1e6))
    line_reason = F.when(
        F.col("n_points") < MIN_POINTS, fill(REASON_FEW, n=F.col("n_points"))
    ).otherwise(F.lit(REASON_FLAT))
    out = joined.select(
        "campaign_id",
        F.when(fitted, F.col("v_max")).otherwise(line_k * F.greatest(roas, F.lit(0.0))).alias("v_max"),
        F.when(fitted, F.col("kr") * F.col("max_spend")).otherwise(line_k).alias("k"),
        F.when(fitted, F.col("n")).otherwise(F.lit(1.0)).alias("n"),
        F.when(fitted, r2).otherwise(F.lit(0.0)).alias("r_squared"),
        "n_points",
        fitted.alias("_fitted"),
        line_reason.alias("_line"),
    )
    reliable = F.col("_fitted") & (F.col("r_squared") >= RELIABLE_R2)
    reason = (
        F.when(~F.col("_fitted"), F.col("_line"))
        .when(F.col("r_squared") >= RELIABLE_R2, REASON_OK)
        .otherwise(fill(REASON_LOW_R2, r2=fixed("r_squared", 3)))
    )
    return out.withColumn("is_reliable", reliable).withColumn("fit_reason", reason).drop("_fitted", "_line")


def operating_points(df: DataFrame, window: int = OPERATING_ROWS, roles: Roles = PANEL) -> DataFrame:
    """Mean spend and revenue over the last mature rows; a campaign without any uses all its rows.

    Only the first ``window`` rows per campaign (mature ones first, newest first) leave the map side:
    Spark limits a ranked window before its shuffle.  Names and row counts are hash aggregates.
    """
    rows = df.select(
        F.col(roles.entity).alias("campaign_id"), F.col(roles.platform).alias("platform"),
        F.col(roles.name).alias("campaign_name"), F.col(roles.date).alias("_d"),
        F.col(roles.spend).alias("_s"), F.col(roles.revenue).alias("_r"), is_mature(df, roles.mature).alias("_m"),
    )
    newest = Window.partitionBy("campaign_id").orderBy(F.col("_m").desc(), F.col("_d").desc())
    recent = rows.withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") <= window)

    def level(c):
        mature = F.avg(F.when(F.col("_m"), F.col(c)))
        return F.greatest(F.coalesce(mature, F.avg(c), F.lit(0.0)), F.lit(0.0))

    levels = recent.groupBy("campaign_id").agg(
        level("_s").alias("avg_daily_spend"), level("_r").alias("avg_daily_revenue")
    )
    spellings = rows.groupBy("campaign_id", "platform", "campaign_name").agg(
        F.count_if("_m").alias("_n"), F.min("_d").alias("_since")
    )
    named = spellings.groupBy("campaign_id", "platform").agg(
        F.min_by("campaign_name", F.struct("_since", "campaign_name")).alias("campaign_name"),
        F.sum("_n").alias("n_training_rows"),
    )
    return named.join(levels, "campaign_id")


def response_curves(df: DataFrame, roles: Roles = PANEL, refinements: int = REFINEMENTS) -> DataFrame:
    """One row per campaign: curve, diagnostics and current operating point."""
    require_columns(df, [roles.entity, roles.platform, roles.date, roles.spend, roles.revenue])
    if roles.name not in df.columns:
        df = df.withColumn(roles.name, F.col(roles.entity).cast("string"))
    params = fit_hill(df, roles, refinements)
    return attach_operating_point(params, operating_points(df, roles=roles))


def attach_operating_point(params: DataFrame, points: DataFrame) -> DataFrame:
    """Campaigns without any clean mature row get the empty-data line (ROAS 1, k = 1e6)."""
    joined = points.join(params, "campaign_id", "left").fillna(
        {"v_max": 1e6, "k": 1e6, "n": 1.0, "r_squared": 0.0, "n_points": 0, "is_reliable": False,
         "fit_reason": REASON_FEW.format(n=0)}
    )
    return joined.select(
        "campaign_id", "campaign_name", "platform", "v_max", "k", "n", "r_squared", "is_reliable",
        "fit_reason", "n_points", "n_training_rows", "avg_daily_spend", "avg_daily_revenue",
        C.saturation("avg_daily_spend").alias("saturation_score"),
        C.marginal_roas("avg_daily_spend").alias("current_marginal_roas"),
        ratio0("avg_daily_revenue", "avg_daily_spend").alias("current_roas"),
    )


def current_spend(curves: DataFrame) -> DataFrame:
    return curves.select("campaign_id", "avg_daily_spend")
