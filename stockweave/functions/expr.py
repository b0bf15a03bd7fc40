"""Column expressions that several operators share."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

from stockweave.params import ABC_CUTS, ADI_CUT, CV2_CUT, XYZ_CUTS, Costs


def ratio(num: Column, den: Column) -> Column:
    """num / den, null where den is 0."""
    return num / F.nullif(den, F.lit(0).cast("double"))


def not_negative(x: Column) -> Column:
    return F.when(x.isNotNull(), F.greatest(x, F.lit(0.0)))


def z_score(level: float) -> float:
    """The standard normal quantile; ValueError outside (0, 1)."""
    if not 0 < level < 1:
        raise ValueError(f"service level {level} is not between 0 and 1")
    return NormalDist().inv_cdf(level)


def quantile_at(ordered: Column, level: Column) -> Column:
    """Linear interpolation in a sorted array; a level may differ from row to row, which percentile() forbids."""
    h = (F.size(ordered) - 1) * level
    lo = F.floor(h).cast("int")
    low = F.get(ordered, lo)
    return F.when(F.size(ordered) > 0, low + (h - lo) * (F.coalesce(F.get(ordered, lo + 1), low) - low))


def conformal_level(n: Column, q: float) -> Column:
    """Finite-sample level of a residual quantile; the lower tail mirrors the upper one."""
    if q >= 0.5:
        return F.least(F.lit(1.0), F.ceil((n + 1) * F.lit(q)) / n)
    return F.greatest(F.lit(0.0), 1.0 - F.ceil((n + 1) * (F.lit(1.0) - F.lit(q))) / n)


def upper_level(n: Column, q: Column) -> Column:
    """Finite-sample level for stock: the upper form for every q."""
    return F.least(F.lit(1.0), F.ceil((n + 1) * q) / n)


def eoq(annual: Column, order_cost: Column, holding: Column) -> Column:
    return F.when((annual > 0) & (holding > 0), F.sqrt(2.0 * annual * order_cost / holding)).otherwise(0.0)


def lot_size(daily: Column, price: Column, costs: Costs = Costs(), order_cost: Column | None = None, holding_rate: Column | None = None) -> Column:
    """Economic lot between one day and max_cover_days of demand, whole units, 1 at least."""
    order_cost = F.lit(costs.order_cost) if order_cost is None else order_cost
    holding_rate = F.lit(costs.holding_rate_annual) if holding_rate is None else holding_rate
    d = F.greatest(daily, F.lit(0.0))
    q = eoq(d * 365.0, order_cost, price * costs.unit_cost_ratio * holding_rate)
    return F.greatest(whole_up(F.least(F.greatest(q, d), d * costs.max_cover_days)), F.lit(1.0))


def whole_up(x: Column) -> Column:
    """Ceiling as a double, blind to noise beyond the sixth decimal, so that sums in another order agree."""
    return F.ceil(F.round(x, 6)).cast("double")


def abc_class(share_before: Column) -> Column:
    return F.when(share_before < ABC_CUTS[0], "A").when(share_before < ABC_CUTS[1], "B").otherwise("C")


def xyz_class(cv: Column) -> Column:
    return F.when(cv <= XYZ_CUTS[0], "X").when(cv <= XYZ_CUTS[1], "Y").otherwise("Z")


def demand_pattern(adi: Column, cv2: Column) -> Column:
    often, even = adi < ADI_CUT, cv2 < CV2_CUT
    return F.when(often & even, "suave").when(often, "errática").when(even, "intermitente").otherwise("irregular")


def let(value: Column, body) -> Column:
    """body(value) with value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def sample_std(values: Column) -> Column:
    """Standard deviation (n - 1) of an array; null under two values."""
    n = F.size(values)
    spread = let(total(values) / F.nullif(n, F.lit(0)), lambda m: F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)))
    return F.when(n > 1, F.sqrt(spread / F.nullif(n - 1, F.lit(0))))


def rolling_sums(values: Column, k: Column) -> Column:
    """Sums of every k values in a row, whole runs only."""
    runs = F.when(F.size(values) >= k, F.sequence(F.lit(1), F.size(values) - k + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(runs, lambda i: total(F.slice(values, i, k)))


def order_quantity(position: Column, rop: Column, lot: Column) -> Column:
    return F.when(position <= rop, F.ceil(F.greatest(rop + lot - position, F.lit(0.0))).cast("double")).otherwise(0.0)
