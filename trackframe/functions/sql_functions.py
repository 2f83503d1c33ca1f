"""SQL names for the scalar functions, and a table function for route points."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``value`` computed once under ``name``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


#: Path lengths up to each point: running sums of blocks of 64 steps, so that an append copies a block at most.
_STEPS = "transform(sequence(1, size(x) - 1), i -> sqrt(pow(element_at(x, i+1) - element_at(x, i), 2) + pow(element_at(y, i+1) - element_at(y, i), 2)))"
_SUMS = "aggregate({values}, array(0D), (acc, v) -> array_append(acc, element_at(acc, -1) + v))"
_BLOCKS = "transform(sequence(0, greatest(0, (size(d) - 1) div 64)), b -> slice(d, b*64 + 1, 64))"
_ARC = _let(_STEPS, "d", _let(_BLOCKS, "blocks", _let(_SUMS.format(values="transform(blocks, b -> aggregate(b, 0D, (s, v) -> s + v))"), "bases",
    "concat(array(0D), flatten(zip_with(blocks, slice(bases, 1, size(blocks)), (b, base) -> slice(transform(" + _SUMS.format(values="b") + ", v -> v + base), 2, size(b)))))")))
#: Places before each point; then every segment yields the places that lie on it, so the work grows with points plus places.
_BEFORE = "transform(a, c -> CASE WHEN element_at(a, -1) <= 0 THEN 0 ELSE least(int(ceil(c*(n-1)/element_at(a, -1))), n-1) END)"


def _along(v: str) -> str:
    on = f"element_at({v}, i) + (element_at({v}, i+1) - element_at({v}, i)) * (element_at(a, -1)*j/(n-1) - element_at(a, i)) / (element_at(a, i+1) - element_at(a, i))"
    each = f"CASE WHEN element_at(before, i+1) > element_at(before, i) THEN transform(sequence(element_at(before, i), element_at(before, i+1) - 1), j -> {on}) ELSE CAST(array() AS ARRAY<DOUBLE>) END"
    return f"CASE WHEN element_at(a, -1) <= 0 THEN array_repeat(element_at({v}, 1), n) ELSE concat(flatten(transform(sequence(1, size(a) - 1), i -> {each})), array(element_at({v}, -1))) END"


#: Fixed names; bodies are plain SQL, so they are inlined and stay in the JVM.
_FUNCTIONS = {
    "tf_iou": (
        "ax DOUBLE, ay DOUBLE, aw DOUBLE, ah DOUBLE, bx DOUBLE, bs DOUBLE, bw DOUBLE, bh DOUBLE", "DOUBLE",
        "CASE WHEN aw*ah + bw*bh - greatest(least(ax+aw,bx+bw)-greatest(ax,bx),0D)*greatest(least(ay+ah,bs+bh)-greatest(ay,bs),0D) > 0 THEN greatest(least(ax+aw,bx+bw)-greatest(ax,bx),0D)*greatest(least(ay+ah,bs+bh)-greatest(ay,bs),0D)"
        " / (aw*ah + bw*bh - greatest(least(ax+aw,bx+bw)-greatest(ax,bx),0D)*greatest(least(ay+ah,bs+bh)-greatest(ay,bs),0D)) ELSE 0D END",
    ),
    "tf_pad_edge": ("v ARRAY<DOUBLE>, n INT", "ARRAY<DOUBLE>", "CASE WHEN size(v) >= n THEN slice(v, 1, n) ELSE concat(v, array_repeat(coalesce(try_element_at(v, -1), 0D), n - size(v))) END"),
    "tf_softmax": ("v ARRAY<DOUBLE>", "ARRAY<DOUBLE>", _let(_let("array_max(v)", "top", "transform(v, x -> exp(x - top))"), "r", _let("aggregate(r, 0D, (s, q) -> s + q)", "t", "transform(r, q -> q / t)"))),
    "tf_clip": ("v DOUBLE, low DOUBLE, high DOUBLE", "DOUBLE", "greatest(least(v, high), low)"),
    "tf_gaussian_smooth": (
        "v ARRAY<DOUBLE>, sigma DOUBLE", "ARRAY<DOUBLE>",
        "transform(sequence(1, size(v)), i -> aggregate(sequence(-int(floor(4*sigma+0.5)), int(floor(4*sigma+0.5))), 0D, (s, k) -> s + exp(-0.5D*(k/sigma)*(k/sigma)) * element_at(v, greatest(1, least(size(v), i+k))))"
        " / aggregate(sequence(-int(floor(4*sigma+0.5)), int(floor(4*sigma+0.5))), 0D, (s, k) -> s + exp(-0.5D*(k/sigma)*(k/sigma))))",
    ),
    "tf_resample": (
        "x ARRAY<DOUBLE>, y ARRAY<DOUBLE>, n INT", "STRUCT<x: ARRAY<DOUBLE>, y: ARRAY<DOUBLE>>",
        "CASE WHEN size(x) < 2 THEN named_struct('x', array_repeat(element_at(x, 1), n), 'y', array_repeat(element_at(y, 1), n)) ELSE "
        + _let(_ARC, "a", _let(_BEFORE, "before", f"named_struct('x', {_along('x')}, 'y', {_along('y')})")) + " END",
    ),
    "tf_center": ("p DOUBLE, s DOUBLE", "DOUBLE", "p + s / 2"),
}


@udtf(returnType="i int, x double, y double")
class RoutePoints:
    """The points of a route: ``SELECT * FROM route_points(x_coords, y_coords)``."""

    def eval(self, x: list, y: list):
        for i, (a, b) in enumerate(zip(x or [], y or [])):
            yield i, a, b


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to the session's SQL; returns their names."""
    for name, (args, kind, body) in _FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    spark.udtf.register("route_points", RoutePoints)
    return [*_FUNCTIONS, "route_points"]
