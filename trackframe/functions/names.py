"""Names of files, videos and frames."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts of the names of files that hold the results of many videos.
AGGREGATES = "all_skill_positions|extraction_statistics|all_normalized"


def video_of(file: Column) -> Column:
    """A trajectory file's path to its video: the file's name without ``_trajectories`` and ending."""
    return F.regexp_replace(F.element_at(F.split(file, "/"), -1), r"(_trajectories)?\.json$", "")


def is_aggregate(name: Column, ignore_case: bool = True) -> Column:
    return (F.lower(name) if ignore_case else name).rlike(AGGREGATES)


def frame_name(number: Column) -> Column:
    return F.format_string("frame_%06d", number)


def unique_name(video: Column, frame: Column) -> Column:
    """One name for a frame among all videos."""
    return F.concat_ws("_", video, frame)
