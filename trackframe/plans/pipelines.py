"""End-to-end plans over all videos at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..config import PipelineConfig
from ..operators import detections as d
from ..operators import field, linking, merge, motion, routes, teams, tracks
from ..storage import drop_tables, materialize


def detections_to_tracks(raw: DataFrame, matches: DataFrame | None = None, segments: DataFrame | None = None, cfg: PipelineConfig = PipelineConfig(), link: bool = True) -> DataFrame:
    """Raw boxes to clean tracks: filter, suppress, steady sizes, link, fill gaps, merge, stabilise, rotate, drop poor tracks.

    Without camera matches or line segments those steps are left out; with
    ``link`` false the input has ``track_id`` already.
    """
    # Each of the next steps reads its input several times, so it is written once instead of made again.
    kept = materialize(d.zone_filter(d.filter_detections(raw, cfg.filter), cfg.filter), "kept")
    steady = materialize(d.constrain_area(d.suppress_overlaps(kept, cfg.filter.overlap_iou), cfg.filter), "steady")
    drop_tables(kept)
    kept = steady
    linked = linking.assign_track_ids(kept, cfg.tracker) if link else d.ghost_filter(kept, cfg.tracker)
    out = materialize(tracks.fill_gaps(tracks.one_per_frame(linked), cfg.tracker.max_gap), "filled")
    out = merge.merge_tracks(out, cfg.merge).drop("orig_track_id")
    if matches is not None:
        moved = motion.smooth_motion(motion.fit_frame_motion(matches, cfg.motion), cfg.motion)
        out = motion.stabilize(out, motion.cumulative_transform(moved))
    if segments is not None:
        out = field.rotate_field(out, field.dominant_angle(segments, cfg.field_lines))
    return tracks.drop_off_field(tracks.drop_short_tracks(out, cfg.min_track), share=cfg.in_field_share)


@dataclass
class Extraction:
    """What :func:`tracks_to_skill` finds."""

    los: DataFrame
    teams: DataFrame
    skill: DataFrame
    limited: DataFrame
    statistics: DataFrame


def tracks_to_skill(df: DataFrame, videos: DataFrame, method: str = "minimal_movement", cfg: PipelineConfig = PipelineConfig()) -> Extraction:
    """Tracks to sides, skill players and the limited selection of them."""
    los = teams.fit_los(df, videos, method)
    sides = teams.assign_team(tracks.track_summary(df), los)
    skill = teams.classify_skill(sides, cfg=cfg.skill)
    limited = teams.limit_skill(skill.where("is_skill"), cfg.skill)
    return Extraction(los, sides, skill, limited, teams.extraction_result(sides, skill, los))


def skill_routes(df: DataFrame, videos: DataFrame, method: str = "minimal_movement", cfg: PipelineConfig = PipelineConfig()) -> DataFrame:
    """Normalised routes of the players that :func:`tracks_to_skill` keeps."""
    kept = tracks_to_skill(df, videos, method, cfg).limited.where("kept").select("video_id", "track_id")
    return routes.normalized_routes(df.join(kept, ["video_id", "track_id"], "left_semi"), videos, cfg.route)
