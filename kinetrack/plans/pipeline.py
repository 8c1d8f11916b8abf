"""The analysis from detections or tracks to summaries, one job for all recordings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators import evaluate, select, summary, tracking
from ..settings import Settings
from ..sources.tables import written

STAGES = ("track", "select", "evaluate", "summarise")


@dataclass
class Results:
    tracks: DataFrame
    selected: DataFrame | None = None
    analysed: DataFrame | None = None
    stats: DataFrame | None = None
    summary: DataFrame | None = None
    failed: DataFrame | None = None


def run_pipeline(source: DataFrame, recordings: DataFrame, s: Settings, start_at: str = "select", stop_after: str = "summarise") -> Results:
    """Run the stages from ``start_at`` (detections for ``track``, else tracks) to ``stop_after``.

    A recording without acceptable tracks has no rows and is listed in ``failed``.
    """
    order = STAGES.index
    tracks = source
    if start_at == "track":
        detections = select.with_recording(source, recordings, s).join(recordings.select("recording_id", "frame_count"), "recording_id", "left")
        tracks = written(tracking.track(detections, s))
    out = Results(tracks)
    if order(stop_after) < order("select"):
        return out
    out.selected = select.select_tracks(select.with_recording(tracks, recordings, s), s) if order(start_at) <= order("select") else tracks
    out.selected = written(out.selected)
    out.failed = tracks.select("recording_id").distinct().join(out.selected, "recording_id", "left_anti")
    if order(stop_after) < order("evaluate"):
        return out
    found = evaluate.features(select.with_recording(out.selected, recordings, s), s)
    out.analysed, out.stats = evaluate.analysed(found), evaluate.track_stats(found)
    if order(stop_after) >= order("summarise"):
        out.summary = summary.recording_summary(out.stats)
    return out
