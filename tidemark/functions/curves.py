"""Hill response curve: revenue = v * r / (1 + r), r = (x / k) ** n."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.exprs import col


def _params(v, k, n):
    return col(v), col(k), col(n)


def hill(x: Column | str, v="v_max", k="k", n="n") -> Column:
    x = col(x)
    v, k, n = _params(v, k, n)
    return F.when(x > 0, v / (1.0 + F.pow(x / k, -n))).otherwise(F.lit(0.0))


def marginal_roas(x: Column | str, v="v_max", k="k", n="n") -> Column:
    """d revenue / d spend.  r / (1 + r)^2 is written s * (1 - s) so that it cannot overflow."""
    x = col(x)
    v, k, n = _params(v, k, n)
    s = 1.0 / (1.0 + F.pow(x / k, -n))
    return F.when(x > 0, v * n * s * (1.0 - s) / x).otherwise(v * n / k)


def saturation(x: Column | str, v="v_max", k="k", n="n") -> Column:
    x = col(x)
    v, k, n = _params(v, k, n)
    return F.when((x > 0) & (v > 0), 1.0 / (1.0 + F.pow(x / k, -n))).otherwise(F.lit(0.0))


def spend_for_saturation(target: Column | float = 0.80, k="k", n="n") -> Column:
    target = F.lit(target) if isinstance(target, (int, float)) else target
    s = F.least(F.greatest(target, F.lit(1e-6)), F.lit(1.0 - 1e-6))
    return col(k) * F.pow(s / (1.0 - s), 1.0 / col(n))


def lift_pct(projected: Column | str, baseline: Column | str) -> Column:
    """Lift over a baseline in percent; +infinity when something grows out of nothing."""
    projected, baseline = col(projected), col(baseline)
    return F.when(baseline > 0, F.try_divide((projected - baseline) * 100.0, baseline)).otherwise(
        F.when(projected <= 0, F.lit(0.0)).otherwise(F.lit(float("inf")))
    )
