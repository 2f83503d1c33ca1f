"""Line between the sides, sides, skill players, and the limit on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import SkillConfig, los_method
from ..functions import geometry as g
from .tracks import first_n, track_summary

FIRST_FRAMES, TEAM = 15, 11


def _gap_line(points: DataFrame, videos: DataFrame, least: int) -> DataFrame:
    """Line in the middle of the widest gap between neighbouring x; with fewer than ``least`` points the picture's middle, confidence 0."""
    w = Window.partitionBy("video_id").orderBy("x", "track_id")
    rows = points.withColumns({"_next": F.lead("x").over(w), "_k": F.row_number().over(w)})
    best = rows.groupBy("video_id").agg(
        F.count("*").alias("n"), (F.max("x") - F.min("x")).alias("range"),
        F.max_by(F.struct("x", "_next"), F.struct(F.col("_next") - F.col("x"), -F.col("_k"))).alias("g"),
    )
    out = videos.select("video_id", "width").join(best, "video_id", "left")
    gap = F.col("g._next") - F.col("g.x")
    few = (F.coalesce("n", F.lit(0)) < least)
    x = F.when(few, F.col("width") / 2).otherwise((F.col("g.x") + F.col("g._next")) / 2)
    sure = F.when(few, 0.0).when(F.col("range") > 0, F.least(gap / (F.col("range") * 0.1), F.lit(1.0))).otherwise(0.5)
    return out.select("video_id", F.lit(0.0).alias("slope"), x.alias("intercept"), x.alias("x_value"), sure.alias("confidence"))


def fit_los(df: DataFrame, videos: DataFrame, method: str = "minimal_movement") -> DataFrame:
    """One line x = slope * y + intercept for each video.

    ``clustering``: widest gap between first positions (four players at least).
    ``vertical``: their median, confidence 0.8 (none: the middle, 0).
    ``minimal_movement``: through the players who move least along x in their
    first frames, then shifted so that eleven lie on its high side; with fewer
    than six players, the gap between the mean positions.
    """
    los_method(method)
    if method == "minimal_movement":
        return _still_line(df, videos)
    first = track_summary(df).select("video_id", "track_id", F.col("first_x").alias("x"))
    if method == "clustering":
        return _gap_line(first, videos, 4)
    middle = first.groupBy("video_id").agg(F.percentile("x", F.lit(0.5)).alias("m"))
    out = videos.select("video_id", "width").join(middle, "video_id", "left")
    x = F.coalesce("m", F.col("width") / 2)
    return out.select("video_id", F.lit(0.0).alias("slope"), x.alias("intercept"), x.alias("x_value"), F.when(F.col("m").isNull(), 0.0).otherwise(0.8).alias("confidence"))


def _still_line(df: DataFrame, videos: DataFrame) -> DataFrame:
    early = first_n(df, FIRST_FRAMES)
    stats = early.groupBy("video_id", "track_id").agg(F.count("*").alias("n"), F.avg(g.center_x()).alias("x"), F.avg(g.center_y()).alias("y"), F.var_pop(g.center_x()).alias("v")).where("n >= 3").drop("n")
    in_video = Window.partitionBy("video_id")
    ranked = stats.withColumns({"total": F.count("*").over(in_video), "k": F.row_number().over(in_video.orderBy("v", "track_id"))})
    enough = ranked.where("total >= 6").withColumn("_line", F.col("k") <= F.least(F.lit(12), F.greatest(F.lit(6), F.col("total") - 4)))
    on = lambda c: F.when(F.col("_line"), F.col(c))
    line = enough.groupBy("video_id").agg(
        F.regr_slope(on("x"), on("y")).alias("s"), F.regr_intercept(on("x"), on("y")).alias("i"), F.avg(on("x")).alias("m"), F.stddev_pop(on("y")).alias("sd"),
        F.var_pop(on("x")).alias("vc"), F.var_pop("x").alias("va"), F.count("*").alias("n"),
    )
    steep = F.col("sd") > 1.0
    line = line.select("video_id", "n", F.when(steep, F.col("s")).otherwise(0.0).alias("slope"), F.when(steep, F.col("i")).otherwise(F.col("m")).alias("base"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("vc") / (F.col("va") + 1e-6))).alias("confidence"))
    off = enough.join(line, "video_id").withColumn("off", F.col("x") - F.col("slope") * F.col("y") - F.col("base"))
    eleventh = off.withColumn("r", F.row_number().over(in_video.orderBy(F.desc("off"), "track_id"))).where(F.col("r") == TEAM).select("video_id", "off")
    fitted = line.join(eleventh, "video_id", "left").select("video_id", "slope", (F.col("base") + F.coalesce("off", F.lit(0.0))).alias("intercept"), F.lit(None).cast("double").alias("x_value"), "confidence")
    rest = _gap_line(ranked.where("total < 6").select("video_id", "track_id", "x"), videos.join(fitted.select("video_id"), "video_id", "left_anti"), 2)
    return fitted.unionByName(rest)


def assign_team(summary: DataFrame, los: DataFrame) -> DataFrame:
    """Offense if a track starts left of the line, else defense; unknown without a position or line."""
    line = los.select("video_id", "slope", "intercept")
    rows = summary.join(line, "video_id", "left")
    at = F.col("slope") * F.col("first_y") + F.col("intercept")
    team = F.when(F.col("first_x").isNull() | at.isNull(), "unknown").when(F.col("first_x") < at, "offense").otherwise("defense")
    return rows.withColumns({"los_x": at, "team": team}).drop("slope", "intercept")


def classify_skill(teams: DataFrame, height: float = 984.0, cfg: SkillConfig = SkillConfig()) -> DataFrame:
    """For offense rows, whether a track is a skill player and why; rules in order, the first that fits decides."""
    net = F.col("last_x") - F.col("first_x")
    bottom, top = F.col("first_y") < cfg.sideline_share * height, F.col("first_y") > (1 - cfg.sideline_share) * height
    behind = F.col("first_x") <= F.col("los_x")
    rules = [
        (F.col("num_detections") < cfg.min_detections, "too short"), (net <= cfg.min_forward, "moved backward"), (net > cfg.buffer, "route runner"),
        (behind & bottom, "backfield near bottom"), (behind & top, "backfield near top"),
    ]
    reason = F.lit("stayed near the line")
    for rule, text in reversed(rules):
        reason = F.when(rule, text).otherwise(reason)
    out = teams.where("team = 'offense'").withColumn("reason", reason)
    return out.withColumn("is_skill", F.col("reason").isin("route runner", "backfield near bottom", "backfield near top"))


def extraction_result(teams: DataFrame, skill: DataFrame, los: DataFrame, height: float = 984.0) -> DataFrame:
    """Counts of each video and the line's x (at mid-height where it slopes)."""
    n = teams.groupBy("video_id").agg(F.count("*").alias("total"), F.count_if(F.col("team") == "offense").alias("offense"), F.count_if(F.col("team") == "defense").alias("defense"))
    s = skill.groupBy("video_id").agg(F.count_if("is_skill").alias("skill"))
    x = F.coalesce("x_value", F.col("slope") * height / 2 + F.col("intercept"))
    return n.join(s, "video_id", "left").join(los.select("video_id", x.alias("los_x")), "video_id", "left").withColumn("skill", F.coalesce("skill", F.lit(0)))


def limit_skill(summary: DataFrame, cfg: SkillConfig = SkillConfig()) -> DataFrame:
    """The ``max_players`` of each video that got farthest stay; the rest are kept with the reason they went.

    ``exclusion_rank`` counts all that are far enough; those below the least
    displacement have none.
    """
    far = F.col("displacement") >= cfg.min_displacement
    rank = F.row_number().over(Window.partitionBy("video_id", far).orderBy(F.desc("displacement"), "track_id"))
    out = summary.withColumns({"_far": far, "_rank": rank})
    reason = F.when(~F.col("_far"), "below_min_displacement").when(F.col("_rank") > cfg.max_players, "exceeded_max_players")
    return out.withColumns({"kept": reason.isNull(), "exclusion_reason": reason, "exclusion_rank": F.when(F.col("_far"), F.col("_rank"))}).drop("_far", "_rank")


def limiter_stats(limited: DataFrame, cfg: SkillConfig = SkillConfig()) -> DataFrame:
    """What the limit does to each video, and the least displacement that stays."""
    return limited.groupBy("video_id").agg(
        F.count("*").alias("original"), F.count_if(F.col("exclusion_reason") == "below_min_displacement").alias("excluded_by_displacement"),
        F.count_if(F.col("exclusion_reason") == "exceeded_max_players").alias("excluded_by_count"), F.count_if("kept").alias("final"), F.min(F.when(F.col("kept"), F.col("displacement"))).alias("threshold_displacement"),
    ).withColumn("affected", F.col("original") > F.col("final"))


def position_breakdown(rows: DataFrame, column: str = "position") -> DataFrame:
    """Rows of each position; none counts as UNKNOWN."""
    return rows.groupBy(F.coalesce(F.col(column), F.lit("UNKNOWN")).alias("position")).agg(F.count("*").alias("n"))


def pick(rows: DataFrame, track_id: int | None = None, team: str | None = None, skill_only: bool = False) -> DataFrame:
    """rows of a track, a team, or skill players."""
    if track_id is not None:
        rows = rows.where(F.col("track_id") == track_id)
    if team is not None:
        rows = rows.where(F.col("team") == team)
    return rows.where("is_skill") if skill_only else rows
