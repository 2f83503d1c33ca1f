"""Row checks of tables: what breaks a rule is reported by the rule's name and set aside, or stops the job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..config import RouteConfig

Rules = dict[str, Column]


def _number(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c)


def detection_rules(videos: bool = False) -> Rules:
    """What every box must satisfy; with ``videos``, of a table joined to its video's width, height and total_frames."""
    rules = {
        "ids": F.col("video_id").isNotNull() & F.col("det_id").isNotNull(),
        "frame": F.col("frame_id").isNotNull() & (F.col("frame_id") >= 0),
        "place": _number("x") & _number("y"),
        "size": _number("width") & _number("height") & (F.col("width") > 0) & (F.col("height") > 0),
        "confidence": _number("confidence") & F.col("confidence").between(0, 1),
    }
    if videos:
        rules["in_video"] = F.col("frame_id") < F.col("total_frames")
        rules["in_picture"] = (F.col("x") < F.col("video_width")) & (F.col("y") < F.col("video_height")) & (F.col("x") + F.col("width") > 0) & (F.col("y") + F.col("height") > 0)
    return rules


def route_rules(cfg: RouteConfig = RouteConfig()) -> Rules:
    """Coordinates of a route: both there, as many, enough of them, all within 0..1."""
    inside = lambda c: F.forall(c, lambda v: v.isNotNull() & v.between(0, 1))
    return {
        "coordinates": F.col("x_coords").isNotNull() & F.col("y_coords").isNotNull(),
        "lengths": F.size("x_coords") == F.size("y_coords"),
        "points": F.size("x_coords") >= cfg.min_points,
        "bounds": inside("x_coords") & inside("y_coords"),
    }


def broken(rules: Rules) -> Column:
    """Names of the rules that a row breaks, in their order; a rule that is null counts as broken."""
    return F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items())), lambda n: n.isNotNull())


def checked(df: DataFrame, rules: Rules) -> DataFrame:
    """``df`` with ``broken``."""
    return df.withColumn("broken", broken(rules))


def quarantine(df: DataFrame, rules: Rules) -> tuple[DataFrame, DataFrame]:
    """Rows that keep all rules, and the others with the names of those they break."""
    rows = checked(df, rules)
    return rows.where(F.size("broken") == 0).drop("broken"), rows.where(F.size("broken") > 0)


def required(df: DataFrame, rules: Rules) -> DataFrame:
    """``df``; a job that reads a row which breaks a rule fails, naming the rule and the row."""
    row = F.to_json(F.struct(*df.columns))
    fails = F.when(F.size("_broken") > 0, F.raise_error(F.concat(F.lit("row breaks "), F.array_join("_broken", ", "), F.lit(": "), row)))
    return df.withColumn("_broken", broken(rules)).where(F.coalesce(fails.cast("string"), F.lit("")) == "").drop("_broken")


def observed(df: DataFrame, rules: Rules, name: str = "rules") -> tuple[DataFrame, Observation]:
    """``df``, and counts of rows and of breaches of each rule, filled by the first job that reads it (no pass of its own)."""
    seen = Observation(name)
    counts = (F.sum((~F.coalesce(ok, F.lit(False))).cast("long")).alias(rule) for rule, ok in rules.items())
    return df.observe(seen, F.count("*").alias("rows"), *counts), seen
