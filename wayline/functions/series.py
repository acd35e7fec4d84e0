"""Window functions over ordered series. Each takes the partition and order columns (`by`, `i`)."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from .scalar import haversine_m, wrap_deg

BY, I = "trip_key", "i"  # noqa: E741


def over(by: str = BY, i: str = I) -> WindowSpec:
    return Window.partitionBy(by).orderBy(i)


def upto(by: str = BY, i: str = I) -> WindowSpec:
    return over(by, i).rowsBetween(Window.unboundedPreceding, 0)


def since(by: str = BY, i: str = I) -> WindowSpec:
    """From the row to the last, backwards: a frame that shrinks forwards would be added up anew for each row."""
    return Window.partitionBy(by).orderBy(F.col(i).desc()).rowsBetween(Window.unboundedPreceding, 0)


def diff(x: Column, w: WindowSpec | None = None) -> Column:
    w = w or over()
    return x - F.lag(x).over(w)


def cum(x: Column, w: WindowSpec | None = None) -> Column:
    return F.sum(x).over(w or upto())


def step_m(lat: Column, lon: Column, w: WindowSpec | None = None) -> Column:
    """Metres from the row before; null at the first row or beside a missing fix."""
    w = w or over()
    return haversine_m(F.lag(lat).over(w), F.lag(lon).over(w), lat, lon)


def forward_fill(x: Column, w: WindowSpec | None = None) -> Column:
    return F.last(x, ignorenulls=True).over(w or upto())


def interpolate(x: Column, i: Column, before: WindowSpec | None = None, after: WindowSpec | None = None) -> Column:
    """Linear over the row index, held at the ends. after: the frame from the last row back to this one, as since() gives it."""
    before, after = before or upto(), after or since()
    here = F.when(x.isNotNull(), i)
    x0, i0 = F.last(x, True).over(before), F.last(here, True).over(before)
    x1, i1 = F.last(x, True).over(after), F.last(here, True).over(after)
    return F.coalesce(x, F.when(i1 > i0, x0 + (x1 - x0) * (i - i0) / (i1 - i0)), x0, x1)


def gradient(f: Column, t: Column, w: WindowSpec | None = None) -> Column:
    """Second order inside, first order at the ends, for uneven steps."""
    w = w or over()
    f0, f1, t0, t1 = F.lag(f).over(w), F.lead(f).over(w), F.lag(t).over(w), F.lead(t).over(w)
    a, b = t - t0, t1 - t
    inner = (a * a * f1 + (b * b - a * a) * f - b * b * f0) / (a * b * (a + b))
    return F.when(f0.isNull(), (f1 - f) / b).when(f1.isNull(), (f - f0) / a).otherwise(inner)


def smooth(x: Column, k: int = 20, by: str = BY, i: str = I) -> Column:
    """Centred moving sum over k rows divided by k; missing values and rows beyond the ends count as 0."""
    return F.sum(F.coalesce(x, F.lit(0.0))).over(over(by, i).rowsBetween(-(k // 2), k - 1 - k // 2)) / k


def first_valid(value: Column, valid: Column, by: str = BY, i: str = I) -> Column:
    return F.first(F.when(valid, value), ignorenulls=True).over(over(by, i).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))


def unwrap_step(a: Column, w: WindowSpec | None = None) -> Column:
    """What to add from the row before on, so that no step is 180 degrees or more."""
    d = diff(a, w)
    to = wrap_deg(d)
    return F.when(F.abs(d) < 180, 0.0).otherwise(F.when((to == -180) & (d > 0), 180.0).otherwise(to) - d)


def trapezoid(v: Column, dt: Column, w: WindowSpec | None = None) -> Column:
    """Area of a step."""
    return (v + F.lag(v).over(w or over())) * 0.5 * dt


def reflected_sum(v0: Column, sums: Column, w: WindowSpec | None = None) -> Column:
    """v[k] = max(v[k-1] + step, 0) from v0, given the steps' running sums: the closed form of the recursion."""
    return sums + F.greatest(v0, -F.min(sums).over(w or upto()))


def islands(flag: Column, by: str = BY, i: str = I) -> Column:
    """Number of the run of equal flags that a row is in."""
    return F.sum(F.when(flag == F.lag(flag).over(over(by, i)), 0).otherwise(1)).over(upto(by, i))


def pearson(x: str | Column, y: str | Column) -> Column:
    """Correlation; null where either side is constant."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.covar_pop(x, y) / F.when(spread > 0, spread)
