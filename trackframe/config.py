"""Parameters of the operators, checked when made.

Defaults that results depend on are fixed values of the data model.
"""

from __future__ import annotations

from dataclasses import dataclass, field


def _check(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


@dataclass(frozen=True)
class Range:
    low: float
    high: float

    def __post_init__(self):
        _check(self.low <= self.high, f"range {self.low}..{self.high} is empty")


@dataclass(frozen=True)
class FilterConfig:
    """Bounds of plausible boxes; all inclusive.  Zones go by the centre's height in the picture."""

    min_confidence: float = 0.15
    area: Range = Range(150, 7500)
    aspect: Range = Range(0.25, 1.75)
    top_y: Range = Range(10, 974)
    overlap_iou: float = 0.45
    #: Grid by which boxes are blocked before they are compared, about the size of a box.
    overlap_cell: float = 60.0
    near_y: float = 734
    far_y: float = 250
    near_area: Range = Range(350, 10000)
    mid_area: Range = Range(250, 7500)
    far_area: Range = Range(150, 7500)
    near_aspect: Range = Range(0.2, 1.75)
    mid_aspect: Range = Range(0.25, 1.75)
    far_aspect: Range = Range(0.2, 1.75)
    grid: int = 500
    area_jump: float = 2.5
    area_history: int = 5

    def __post_init__(self):
        _check(0 <= self.min_confidence <= 1, "min_confidence must lie in 0..1")
        _check(self.far_y <= self.near_y, "far_y must not exceed near_y")
        _check(self.grid > 0 and self.area_history > 0, "grid and area_history must be positive")


@dataclass(frozen=True)
class TrackerConfig:
    track_high: float = 0.25
    track_low: float = 0.1
    new_track: float = 0.25
    match_cost: float = 0.75
    buffer_frames: int = 30
    max_gap: int = 10
    fps: float = 30.0

    def __post_init__(self):
        _check(0 <= self.track_low <= self.track_high <= 1, "need 0 <= track_low <= track_high <= 1")
        _check(0 < self.match_cost < 1, "match_cost must lie between 0 and 1")
        _check(self.fps > 0, "fps must be positive")


@dataclass(frozen=True)
class MergeConfig:
    min_points: int = 10
    max_gap: int = 45
    max_distance: float = 150.0
    crowd_radius: float = 200.0
    crowd_limit: int = 4
    min_score: float = 0.25
    max_merges: int = 2
    #: Weights of distance, gap, direction and size; they need not sum to 1.
    weights: tuple[float, float, float, float] = (0.4, 0.3, 0.3, 0.3)

    def __post_init__(self):
        _check(self.max_gap > 0 and self.max_distance > 0, "gap and distance limits must be positive")


@dataclass(frozen=True)
class MotionConfig:
    inlier_pixels: float = 3.0
    min_points: int = 6
    min_inliers: float = 0.4
    scale: Range = Range(0.90, 1.10)
    max_shift: float = 100.0
    window: int = 5
    #: Below these a motion is none.
    still_pixels: float = 1.0
    still_scale: float = 0.002
    still_angle: float = 0.002


@dataclass(frozen=True)
class FieldConfig:
    min_length: float = 450.0
    bin_degrees: int = 5
    line_bins: Range = Range(65, 90)
    valid_angle: float = 40.0
    full_count: int = 20


@dataclass(frozen=True)
class SkillConfig:
    min_detections: int = 30
    min_forward: float = -50.0
    buffer: float = 100.0
    sideline_share: float = 0.2
    max_players: int = 8
    min_displacement: float = 50.0


@dataclass(frozen=True)
class RouteConfig:
    points: int = 64
    min_points: int = 10
    width: float = 1920.0
    height: float = 1080.0

    def __post_init__(self):
        _check(self.points >= 2, "a route needs two points at least")


LOS_METHODS = ("clustering", "vertical", "minimal_movement")


def los_method(name: str) -> str:
    _check(name in LOS_METHODS, f"line method must be one of {LOS_METHODS}")
    return name


#: The route classes, in order.
ROUTE_TYPES = ("streak", "slant", "post", "corner", "drag", "curl", "dig", "out", "comeback", "flat", "wheel")
#: How many synthetic routes of each class the preset makes, in the same order.
PRESET_COUNTS = (600, 500, 500, 500, 600, 500, 300, 400, 300, 200, 300)


@dataclass(frozen=True)
class PipelineConfig:
    filter: FilterConfig = field(default_factory=FilterConfig)
    tracker: TrackerConfig = field(default_factory=TrackerConfig)
    merge: MergeConfig = field(default_factory=MergeConfig)
    motion: MotionConfig = field(default_factory=MotionConfig)
    field_lines: FieldConfig = field(default_factory=FieldConfig)
    skill: SkillConfig = field(default_factory=SkillConfig)
    route: RouteConfig = field(default_factory=RouteConfig)
    min_track: int = 30
    in_field_share: float = 0.25
