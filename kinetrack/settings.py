"""Settings with the defaults of the analysis."""

from __future__ import annotations

from dataclasses import dataclass

#: Width to length bounds by cell shape. Fixed values.
RATIO_BOUNDS = {"rod": (0.125, 0.67), "coccoid": (0.8, 1.0)}


@dataclass(frozen=True)
class Settings:
    px_per_um: float = 1.41888781
    fps: float = 30.0
    frame_height: int = 922
    frame_width: int = 1228
    shape: str = "rod"
    ratio_bounds: tuple[float, float] | None = None
    minimal_length_s: float = 20
    limit_length_s: float = 20
    minimal_angle: float = 30
    area_lower: float = 2
    area_upper: float = 50
    max_holes: int = 5
    max_empty_percent: float = 5
    area_quantile_percent: float = 10
    omit_outliers: bool = True
    outlier_stop_percent: float = 5
    area_factor: float = 1.5
    edge_percent: float = 5
    max_recursion_depth: int = 960
    limit_exactly: bool = False
    angle_rows: int = 10
    force_fps: bool = False
    filters: int = 3
    min_horizon: int = 0
    max_horizon: int | None = 30
    split_by: str = "perc. motile"
    split_on: tuple[float, ...] = (0, 20, 40, 60, 80, 100.01)
    minimal_frame_count: int = 600

    def __post_init__(self) -> None:
        positive = (self.px_per_um, self.fps, self.frame_height, self.frame_width)
        if min(positive) <= 0:
            raise ValueError("pixel size, frame rate and frame size must be above 0")
        if self.area_lower >= self.area_upper:
            raise ValueError("the lower area bound must be below the upper one")
        if self.filters <= 1 or self.min_horizon < 0 or (self.max_horizon is not None and self.max_horizon <= 0):
            raise ValueError("at least two filters, and horizons of at least 0")
        if self.ratio_bounds is None and self.shape not in RATIO_BOUNDS:
            raise ValueError(f"shape is one of {sorted(RATIO_BOUNDS)}")

    @property
    def ratios(self) -> tuple[float, float]:
        return self.ratio_bounds or RATIO_BOUNDS[self.shape]

    def frames(self, seconds: float, fps: float | None = None) -> int:
        """Whole frames of a duration at the rounded frame rate (halves to even)."""
        return int(seconds * int(round(self.fps if fps is None else fps)))

    @property
    def lag_seconds(self) -> float:
        """Time of the long displacement: 10 s, or half a length limit if that is between 0 and 10 s."""
        return min([10, *(x / 2 for x in (self.minimal_length_s, self.limit_length_s) if 0 < x / 2 < 10)])

    def lag_rows(self, fps: float) -> int:
        """Rows of the long displacement."""
        return int(round(fps * self.lag_seconds))


def odd_kernel(fps: float) -> int:
    """The rounded frame rate, made odd."""
    n = int(round(fps))
    return n if n % 2 else n + 1
