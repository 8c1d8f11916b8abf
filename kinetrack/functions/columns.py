"""Column expressions: scalar functions and window features of one track."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from ..schemas import KEY


def W() -> WindowSpec:
    """Rows of a track in time order."""
    return Window.partitionBy(*KEY).orderBy("position_t")


def WT() -> WindowSpec:
    """All rows of a track."""
    return Window.partitionBy(*KEY)


#: Motility phenotypes by code. Fixed values.
PHENOTYPES = ("immotile", "twitching", "motile")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def step(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def heading_deg(dx: Column, dy: Column) -> Column:
    """Heading in degrees; x comes first, so 90 is along x."""
    return F.degrees(F.atan2(dx, dy))


def fold_angle(a: Column) -> Column:
    """An angle of 0 to 360 degrees as one of 0 to 180."""
    return F.least(a, 360 - a)


def safe_ratio(n: Column, d: Column) -> Column:
    return F.when(d != 0, n / d).otherwise(F.lit(0.0))


def area(w: str | Column = "width", h: str | Column = "height") -> Column:
    return col(w) * col(h)


def side_ratio(w: str | Column = "width", h: str | Column = "height") -> Column:
    """Short side through long side; NULL where both are 0."""
    return F.try_divide(F.least(col(w), col(h)), F.greatest(col(w), col(h)))


def to_um(c: str | Column, px_per_um: float) -> Column:
    return col(c) / F.lit(px_per_um)


def is_start(w: WindowSpec | None = None) -> Column:
    return F.row_number().over(w or W()) == 1


def is_stop(w: WindowSpec | None = None) -> Column:
    return F.lead(F.lit(1)).over(w or W()).isNull()


def delta(c: str, first: float, w: WindowSpec | None = None) -> Column:
    return F.coalesce(F.col(c) - F.lag(c).over(w or W()), F.lit(first))


def since_first(c: str, w: WindowSpec | None = None) -> Column:
    return F.col(c) - F.first(c).over(w or W())


def binary_median(c: str, kernel: int, w: WindowSpec | None = None) -> Column:
    """Median filter of a 0/1 column with an odd kernel; beyond the ends are zeros."""
    half = kernel // 2
    return (F.sum(c).over((w or W()).rowsBetween(-half, half)) > half).cast("int")


def row_range(reach: Column) -> WindowSpec:
    """Rows of a track by number over a reach of their own, which a RANGE frame of one unit back or ahead covers.

    ``reach`` is a number of rows, the same in a whole track; ``row_number`` must be there. Half a row more keeps the
    rows at the ends of the frame clear of rounding.
    """
    return Window.partitionBy(*KEY).orderBy(F.col("row_number") / (reach + 0.5))


def binary_median_within(c: str, half: Column) -> Column:
    """``binary_median`` with half the kernel in a column: each track has a kernel of its own."""
    return (F.sum(c).over(row_range(half).rangeBetween(-1, 1)) > half).cast("int")


def lag_within(c: str, rows: Column) -> Column:
    """The value a column's number of rows before; NULL before there are so many."""
    return F.when(F.col("row_number") > rows, F.first(c).over(row_range(rows).rangeBetween(-1, 0)))


def local_max(c: str, order: int = 10, w: WindowSpec | None = None) -> Column:
    """1 where a value other than 0 is not below any neighbour within ``order`` rows; plateaus all count."""
    return ((F.col(c) == F.max(c).over((w or W()).rowsBetween(-order, order))) & (F.col(c) != 0)).cast("int")


def local_extreme(c: str, order: int = 10, least: bool = False, strict: bool = False, fill: object = 0, w: WindowSpec | None = None) -> Column:
    """The value where no neighbour within ``order`` rows is above it (``least``: below it), ``fill`` elsewhere.

    ``strict`` also excludes equal neighbours, and with them the first and the last row.
    """
    w, find = w or W(), F.min if least else F.max
    if not strict:
        return F.when(F.col(c) == find(c).over(w.rowsBetween(-order, order)), F.col(c)).otherwise(F.lit(fill))
    sides = [find(c).over(w.rowsBetween(-order, -1)), find(c).over(w.rowsBetween(1, order))]
    beats = [F.col(c) < v if least else F.col(c) > v for v in sides]
    return F.when(beats[0] & beats[1], F.col(c)).otherwise(F.lit(fill))


def rolling_mean_centered(c: str, n: int, w: WindowSpec | None = None) -> Column:
    """Mean over n rows around each row, with fewer at the ends; of an even n the odd row lies before."""
    return F.avg(c).over((w or W()).rowsBetween(-(n // 2), (n - 1) // 2))


def shift(c: str, n: int, fill: object, w: WindowSpec | None = None) -> Column:
    """The value n rows before (after, if n is below 0), ``fill`` beyond the ends."""
    return F.lag(c, n, fill).over(w or W()) if n >= 0 else F.lead(c, -n, fill).over(w or W())


def lsf_predict(c: str, n: int, w: WindowSpec | None = None) -> Column:
    """The next value on the straight line through the last n values by least squares; NULL before there are n."""
    if n < 2:
        raise ValueError("a line needs two values")
    terms = [F.lag(c, n - k).over(w or W()) * (2.0 * (3 * k - n + 1) / (n * (n - 1))) for k in range(n)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def moving_threshold(fps: float, offset: float, dark: bool = False, w: WindowSpec | None = None) -> Column:
    """Grey threshold of a frame: mean + std + offset (dark cells: mean - std + offset), averaged over 5 s, truncated."""
    w = w or Window.partitionBy("recording_id").orderBy("frame")
    one = F.col("grey_mean") + (-F.col("grey_std") if dark else F.col("grey_std")) + F.lit(float(offset))
    return F.avg(one).over(w.rowsBetween(-int(5 * fps), 0)).cast("int")


def recorded_at(name: Column) -> Column:
    """The time in the first 12 digits of a name (yymmddHHMMSS); NULL if there is none."""
    return F.when(name.rlike("^[0-9]{12}"), F.try_to_timestamp(F.substring(name, 1, 12), F.lit("yyMMddHHmmss")))


def display_name(name: Column) -> Column:
    """Underscores as spaces, without a trailing ' selected data', the date in front."""
    plain = F.regexp_replace(F.translate(name, "_", " "), " selected data$", "")
    when = recorded_at(name)
    return F.when(when.isNotNull(), F.concat(F.date_format(when, "yyyy-MM-dd HH:mm:ss"), F.lit(" "), F.trim(F.substr(plain, F.lit(13))))).otherwise(plain)


def phenotype_name(code: Column) -> Column:
    return F.element_at(F.array(*[F.lit(p) for p in PHENOTYPES]), code + 1)
