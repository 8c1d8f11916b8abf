"""Summaries of recordings and categories, and tables for plots and overlays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import PHENOTYPES, W, since_first, to_um
from ..schemas import KEY
from ..settings import Settings

#: Metrics of the statistics in the order in which they are looked up: display name and our column. Fixed values.
METRICS = {
    "Turn Points (TP/s)": "turn_points_per_s",
    "Distance (µm)": "distance_um",
    "Speed (µm/s)": "speed_um_s",
    "Time (s)": "time_s",
    "Displacement (µm)": "displacement_um",
    "Perc. Motile": "perc_motile",
    "Arc-Chord Ratio": "arc_chord_ratio",
    "Bacteria Length": "bac_length_um",
    "Displacement divided by length": "displacement_by_length",
    "Motility Phenotype": "motility_phenotype",
    "TRACK_ID": "track_id",
    "Median Speed": "median_speed",
}
#: Metrics of the category summary.
SUMMARISED = ("turn_points_per_s", "distance_um", "speed_um_s", "time_s", "displacement_um", "perc_motile", "arc_chord_ratio", "bac_length_um")


def resolve_metric(text: str) -> str:
    """The column whose display name contains ``text``, the case ignored; percent motile if none does."""
    return next((c for name, c in METRICS.items() if text.lower() in name.lower()), "perc_motile")


def recording_summary(stats: DataFrame) -> DataFrame:
    """Shares of the phenotypes and the quartiles of the track times of each recording."""
    q = F.percentile("time_s", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    shares = [F.avg((F.col("motility_phenotype") == k).cast("double")).alias(f"{p}_share") for k, p in enumerate(PHENOTYPES)]
    out = stats.groupBy("recording_id").agg(F.count("*").alias("tracks"), *shares, F.min("time_s").alias("time_min"), F.max("time_s").alias("time_max"), q.alias("q"))
    return out.withColumns({f"time_q{p}": F.col("q")[i] for i, p in enumerate((25, 50, 75))}).drop("q")


def category_bins(metric: str, cuts: tuple[float, ...]) -> list[tuple[str, float, float]]:
    """Label, lower (included) and upper bound (excluded) of each category."""
    if metric == "motility_phenotype":
        return [(p, k, k + 1) for k, p in enumerate(PHENOTYPES)]
    percent = metric == "perc_motile"
    name = (lambda a, b: f"{a:.1f}% - {min(b, 100):.1f}%") if percent else (lambda a, b: f"{a:.2f} - {b:.2f}")
    return [(name(a, b), a, b) for a, b in zip(cuts, cuts[1:])]  # noqa: B905


def category_label(metric: str, cuts: tuple[float, ...]) -> tuple[Column, Column]:
    """Label and order of the category of each row; a value in two categories has the later one."""
    label, order = F.lit(None).cast("string"), F.lit(None).cast("int")
    for k, (name, low, high) in enumerate(category_bins(metric, cuts), 1):
        inside = (F.col(metric) >= low) & (F.col(metric) < high)
        label, order = F.when(inside, name).otherwise(label), F.when(inside, k).otherwise(order)
    return label, order


def categorise(stats: DataFrame, by: str, cuts: tuple[float, ...]) -> DataFrame:
    """All rows labelled 'All', and again by category; rows outside every category are missing from the second part."""
    label, order = category_label(resolve_metric(by), cuts)
    both = F.array(F.struct(F.lit("All").alias("category"), F.lit(0).alias("category_order")), F.struct(label.alias("category"), order.alias("category_order")))
    found = stats.withColumn("__c", F.explode(both)).where("__c.category is not null")
    return found.withColumns({"category": F.col("__c.category"), "category_order": F.col("__c.category_order")}).drop("__c")


def order_categories(categorised: DataFrame) -> DataFrame:
    return categorised.orderBy("category_order", *KEY)


def _unpivoted(df: DataFrame, ids: list[str]) -> DataFrame:
    return df.unpivot(ids, list(SUMMARISED), "metric", "value")


def category_summary(categorised: DataFrame) -> DataFrame:
    """Count, percent of all, median and mean by category and metric."""
    long = _unpivoted(categorised, ["recording_id", "category", "category_order"])
    out = long.groupBy("recording_id", "metric", "category", "category_order").agg(F.count("*").alias("n"), F.median("value").alias("median"), F.avg("value").alias("mean"))
    total = F.max(F.when(F.col("category_order") == 0, F.col("n"))).over(Window.partitionBy("recording_id", "metric"))
    return out.withColumn("percent", F.col("n") / total * 100)


def category_summary_sets(stats: DataFrame, by: str, cuts: tuple[float, ...]) -> DataFrame:
    """The same with the total as a grouping set; rows outside the categories count in the total alone."""
    label, _ = category_label(resolve_metric(by), cuts)
    long = _unpivoted(stats.withColumn("category", label), ["recording_id", "category"])
    out = long.groupingSets([[F.col("recording_id"), F.col("metric")], [F.col("recording_id"), F.col("metric"), F.col("category")]], "recording_id", "metric", "category")
    out = out.agg(F.grouping("category").alias("total"), F.count("*").alias("n"), F.median("value").alias("median"), F.avg("value").alias("mean"))
    out = out.where("total = 1 or category is not null")
    return out.withColumn("category", F.when(F.col("total") == 1, "All").otherwise(F.col("category"))).drop("total")


def distance_colour(found: DataFrame) -> DataFrame:
    """Path of each track, and (path - least) / largest of that in its recording."""
    paths = found.groupBy(*KEY).agg(F.sum("travelled_dist").alias("path"))
    r = Window.partitionBy("recording_id")
    shifted = F.col("path") - F.min("path").over(r)
    return paths.withColumn("shifted", shifted).withColumn("colour", F.try_divide("shifted", F.max("shifted").over(r))).drop("shifted")


def overview_points(found: DataFrame, s: Settings) -> DataFrame:
    """All positions in micrometres with the track's start and colour, longest paths first within a recording."""
    out = found.withColumns({"x_um": to_um("position_x", s.px_per_um), "y_um": to_um("position_y", s.px_per_um)})
    out = out.withColumns({"start_x_um": F.first("x_um").over(W()), "start_y_um": F.first("y_um").over(W())})
    return out.join(distance_colour(found), KEY).select(*KEY, "position_t", "x_um", "y_um", "start_x_um", "start_y_um", "colour")


def rose_points(found: DataFrame, s: Settings) -> DataFrame:
    """All paths moved to one origin, in micrometres, with the track's colour."""
    out = found.withColumns({"x_rel": to_um(since_first("position_x"), s.px_per_um), "y_rel": to_um(since_first("position_y"), s.px_per_um)})
    return out.join(distance_colour(found), KEY).select(*KEY, "position_t", "x_rel", "y_rel", "colour")


def longest_tracks(stats: DataFrame, n: int) -> DataFrame:
    """The n tracks with the longest paths."""
    return stats.orderBy(F.desc("distance_um"), *KEY).limit(n)


def overlay(found: DataFrame, subtype: str | None = None) -> DataFrame:
    """What to draw on each frame: positions in whole pixels and a colour by state, optionally of one phenotype."""
    rows = found if subtype is None else found.where(F.col("motility_phenotype") == PHENOTYPES.index(subtype))
    colour = F.when(F.col("moving") == 0, "orange").when(F.col("turn_points") == 1, "white").otherwise("green")
    mark = F.struct("track_id", F.col("position_x").cast("int").alias("x"), F.col("position_y").cast("int").alias("y"), colour.alias("colour"))
    return rows.groupBy("recording_id", "position_t").agg(F.sort_array(F.collect_list(mark)).alias("marks"))


def overlay_for_frames(frames: DataFrame, drawn: DataFrame) -> DataFrame:
    """The overlay of a frame index (``recording_id, position_t``); frames without tracks stay."""
    return frames.join(drawn, ["recording_id", "position_t"], "left")
