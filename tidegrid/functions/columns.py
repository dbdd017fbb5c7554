"""Column expressions: cleaning, rules, cell algebra and geometry. All of them stay inside the JVM."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Missing-value marks of the raw tables.
SENTINELS = (-9999.0, -9.0, -9999999.0, -2147483648.0, -32768.0)
#: Fixed value: cubic metres per cubic foot.
CUBIC_FOOT = 0.028316846592
#: Fixed value: square kilometres per square mile.
SQUARE_MILE = 2.58999
#: Radii of the earth in metres, for distances and for the equidistant projection.
EARTH, EQUATOR = 6_371_000.0, 6_378_137.0


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b; NULL where b is 0."""
    return F.try_divide(_c(a).cast("double"), _c(b).cast("double"))


def corr(x: str | Column, y: str | Column) -> Column:
    """Pearson r over the rows where both are given, as an aggregate; NULL where one of them doesn't vary."""
    y, x = _c(y), _c(x)
    return ratio(F.regr_sxy(y, x), F.sqrt(F.regr_sxx(y, x) * F.regr_syy(y, x)))


def slope(y: str | Column, x: str | Column) -> Column:
    """Slope of y on x, as an aggregate; NULL where x doesn't vary."""
    return ratio(F.regr_sxy(_c(y), _c(x)), F.regr_sxx(_c(y), _c(x)))


def sentinel_to_null(x: str | Column, sentinels: Sequence[float] = SENTINELS) -> Column:
    """NULL for a sentinel, NaN or an infinite value."""
    x = _c(x)
    return F.when(x.isin(*sentinels) | F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def has_sentinel(cols: Sequence[str | Column], sentinels: Sequence[float] = SENTINELS) -> Column:
    """True if any of ``cols`` is a sentinel or NULL."""
    return F.exists(F.array(*[_c(x).cast("double") for x in cols]), lambda v: v.isNull() | v.isin(*sentinels))


def to_cubic_metres(value: str | Column, unit: str | Column, area: str | Column | None = None) -> Column:
    """Discharge by unit: CFS by the foot's volume, PER_AREA by the drainage area, else as it is."""
    value, unit = _c(value), _c(unit)
    out = F.when(unit == "CFS", value * CUBIC_FOOT)
    if area is not None:
        out = out.when(unit == "PER_AREA", value * _c(area))
    return out.otherwise(value)


def decimals(text: str | Column) -> Column:
    """Number of decimals of a written number."""
    return F.length(F.regexp_extract(_c(text), r"\.(.*)$", 1))


def more_precise(a: str | Column, b: str | Column) -> Column:
    """The one with more decimals; ``a`` on a tie."""
    return F.when(_c(b).isNotNull() & (_c(a).isNull() | (decimals(b) > decimals(a))), _c(b)).otherwise(_c(a))


def in_box(x: str | Column, y: str | Column, west: float, east: float, south: float, north: float) -> Column:
    return _c(x).between(west, east) & _c(y).between(south, north)


def shift_dateline(x: str | Column, in_mask: Column, edge: float = -169.0) -> Column:
    """Cells west of ``edge`` and in the mask go to the far east side."""
    return F.when(in_mask & (_c(x) < edge), _c(x) + 360).otherwise(_c(x))


def trimmed_mean(cols: Sequence[str | Column]) -> Column:
    """Mean of the values without the least and the greatest one."""
    a = F.array_sort(F.array(*[_c(x).cast("double") for x in cols]))
    inner = F.slice(a, 2, len(cols) - 2)
    return F.aggregate(inner, F.lit(0.0), lambda s, v: s + v) / (len(cols) - 2)


def minmax(x: str | Column, low: str | Column, high: str | Column) -> Column:
    """(x - low) / (high - low), clipped to 0..1; NULL if low equals high."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (_c(x) - _c(low)) / F.nullif(_c(high) - _c(low), F.lit(0.0))))


def instability(norm_avg: str | Column, std: str | Column) -> Column:
    return F.log(1 + ratio(std, _c(norm_avg) + 0.05))


def topographic_wetness(area: str | Column, slope_deg: str | Column) -> Column:
    return F.log(_c(area) / (F.tan(F.radians(_c(slope_deg))) + 0.01)) * 1e8


def stream_power(area: str | Column, slope_deg: str | Column) -> Column:
    return _c(area) * (F.tan(F.radians(_c(slope_deg))) + 0.01) * 1e3


def sediment_transport(area: str | Column, slope_deg: str | Column) -> Column:
    return F.floor(1.4 * F.pow(_c(area) / 22.13, F.lit(0.4)) * F.pow(F.sin(F.radians(_c(slope_deg))) / 0.0896, F.lit(1.3)) * 1e3)


def normalized_difference(a: str | Column, b: str | Column, scale: float = 1e6) -> Column:
    return (_c(a) - _c(b)) / F.nullif(_c(a) + _c(b), F.lit(0.0)) * scale


def per_area(x: str | Column, area: str | Column) -> Column:
    """x / area; NULL where the area is 0."""
    return _c(x) / F.nullif(_c(area).cast("double"), F.lit(0.0))


def cell_row(y: str | Column, origin: float, size: float) -> Column:
    return F.floor((_c(y) - origin) / size)


def cell_id(col: str | Column, row: str | Column, n_cols: int) -> Column:
    """Number of a cell, counted from 1 along rows."""
    return _c(col) + 1 + _c(row) * n_cols


def great_circle(lon1: str | Column, lat1: str | Column, lon2: str | Column, lat2: str | Column) -> Column:
    """Great-circle distance in metres."""
    f1, f2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    a = F.pow(F.sin((f2 - f1) / 2), 2) + F.cos(f1) * F.cos(f2) * F.pow(F.sin(F.radians(_c(lon2) - _c(lon1)) / 2), 2)
    return 2 * EARTH * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def haversine(lon1: str | Column, lat1: str | Column, lon2: str | Column, lat2: str | Column) -> Column:
    """Great-circle distance in whole metres."""
    return F.floor(great_circle(lon1, lat1, lon2, lat2)).cast("long")


def plate_carree(lon: str | Column, lat: str | Column) -> tuple[Column, Column]:
    """Equidistant X and Y in metres."""
    return F.radians(_c(lon)) * EQUATOR, F.radians(_c(lat)) * EQUATOR


def ratio_class(a: str | Column, b: str | Column, low: float = 0.8, high: float = 1.2) -> Column:
    """missing, similar, larger or smaller: a over b."""
    r = per_area(a, b)
    return F.when(r.isNull(), "missing").when(r > high, "larger").when(r < low, "smaller").otherwise("similar")


def within_share(a: str | Column, b: str | Column, share: float = 0.1) -> Column:
    """True if a differs from b by at most ``share`` of b."""
    return F.abs(_c(a) - _c(b)) <= share * F.abs(_c(b))


def two_sided(z: str | Column) -> Column:
    """Chance of a standard normal value at least as far from 0 as ``z``: the error function by its series of positive terms up to
    |z| = 5, its complement by a continued fraction beyond. The error is below 1e-11 of the value."""
    x = F.abs(_c(z)) / math.sqrt(2)
    term = lambda s, k: F.struct((s["t"] * 2 * x * x / (2 * k + 1)).alias("t"), (s["s"] + s["t"] * 2 * x * x / (2 * k + 1)).alias("s"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(90)), F.struct(x.alias("t"), x.alias("s")), term, lambda s: s["s"])
    near = 1 - series * F.exp(-x * x) * (2 / math.sqrt(math.pi))
    below = F.aggregate(F.sequence(F.lit(60), F.lit(1)), x, lambda f, k: x + (k / 2.0) / f)
    return F.when(x < 5 / math.sqrt(2), near).otherwise(F.exp(-x * x) / (below * math.sqrt(math.pi)))


def months(date: str | Column) -> Column:
    """Months since year 0."""
    return F.year(_c(date)) * 12 + F.month(_c(date))


def row_median(cols: Sequence[str | Column]) -> Column:
    a = F.array_sort(F.array(*[_c(x).cast("double") for x in cols]))
    n = len(cols)
    return (F.element_at(a, (n + 1) // 2) + F.element_at(a, n // 2 + 1)) / 2


def in_latitudes(lat: str | Column, south: float = -60.0, north: float = 85.0) -> Column:
    """True from ``south`` to ``north``, both included; NULL without a latitude."""
    return _c(lat).between(south, north)


def inside(x: str | Column, low: float, high: float) -> Column:
    """1 from ``low`` to ``high``, both included, otherwise 0; 0 for NULL."""
    return F.when(_c(x).between(low, high), 1).otherwise(0)


def class_flags(x: str | Column, classes: dict[str, Sequence]) -> dict[str, Column]:
    """A 0/1 column per named set of classes; NULL stays NULL."""
    return {n: _c(x).isin(*members).cast("int") for n, members in classes.items()}


def area_weighted(x: str | Column, area: str | Column, offset: float = 0.0) -> Column:
    """x times the cell's area, plus an offset that keeps small values whole."""
    return _c(x) * _c(area) + offset


def sum_and_mean(cols: Sequence[str | Column]) -> tuple[Column, Column]:
    """Sum and mean of columns, as of a month and the months before it; NULL if any of them is."""
    total = _c(cols[0])
    for x in cols[1:]:
        total = total + _c(x)
    return total, total / len(cols)


def season(date: str | Column) -> Column:
    """DJF, MAM, JJA or SON."""
    m = F.month(_c(date))
    return F.when(m.isNull(), None).when(m.isin(12, 1, 2), "DJF").when(m < 6, "MAM").when(m < 9, "JJA").otherwise("SON")
