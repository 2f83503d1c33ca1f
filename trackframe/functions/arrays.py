"""Column expressions on coordinate arrays: padding, resampling, smoothing, softmax.

All are higher-order functions, so rows stay in the JVM.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once for a row, however often and deep the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def pad_edge(values: Column, n: int) -> Column:
    """First ``n`` entries; a shorter array is continued with its last one (empty: zeros)."""
    short = F.concat(values, F.array_repeat(F.coalesce(F.try_element_at(values, F.lit(-1)), F.lit(0.0)), n - F.size(values)))
    return F.when(F.size(values) >= n, F.slice(values, 1, n)).otherwise(short)


def diff(values: Column) -> Column:
    """Differences of neighbours; one entry fewer."""
    n = F.size(values)
    return F.when(n < 2, F.slice(values, 1, 0)).otherwise(F.zip_with(F.slice(values, 2, F.greatest(n - 1, F.lit(0))), F.slice(values, 1, F.greatest(n - 1, F.lit(0))), lambda b, a: b - a))


def cumsum(values: Column) -> Column:
    """Running sums, carried along once."""
    start = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("out"))
    return F.aggregate(values, start, lambda acc, v: F.struct((acc["sum"] + v).alias("sum"), F.array_append(acc["out"], acc["sum"] + v).alias("out")), lambda acc: acc["out"])


def argsort(values: Column) -> Column:
    """Zero-based places in ascending order of value; ties by place."""
    return F.transform(F.array_sort(F.transform(values, lambda v, i: F.struct(v.alias("v"), i.alias("i")))), lambda s: s["i"])


def arc_lengths(x: Column, y: Column) -> Column:
    """Length of the path up to each point."""
    steps = F.zip_with(diff(x), diff(y), lambda dx, dy: F.sqrt(dx * dx + dy * dy))
    return F.concat(F.array(F.lit(0.0)), cumsum(steps))


def interpolate(at: Column, knots: Column, values: Column) -> Column:
    """Piecewise linear interpolation at one place; constant beyond the ends."""
    last = F.size(knots)
    k = F.size(F.filter(knots, lambda c: c <= at))
    low, high = F.greatest(k, F.lit(1)), F.least(k + 1, last)
    c0, c1 = F.element_at(knots, low), F.element_at(knots, high)
    v0, v1 = F.element_at(values, low), F.element_at(values, high)
    return F.when((k <= 0) | (k >= last), F.when(k <= 0, F.element_at(values, 1)).otherwise(F.element_at(values, -1))).otherwise(v0 + (v1 - v0) * ((at - c0) / (c1 - c0)))


def resample(x: Column, y: Column, n: int = 64) -> Column:
    """A struct of arrays ``x``, ``y``: the path at ``n`` places equally far along it.

    A path of ``n`` points stays; one of no length repeats its first point.  Each
    segment of the path yields the places that lie on it, so the work grows with
    points plus places.
    """
    last = n - 1

    def along(p: Column) -> Column:
        total = F.element_at(p["arc"], -1)
        # Number of places before each point of the path.
        before = F.transform(p["arc"], lambda c: F.least(F.ceil(c * last / total).cast("int"), F.lit(last)))

        def place(q: Column) -> Column:
            def segment(i: Column) -> Column:
                low, high = F.element_at(q["before"], i), F.element_at(q["before"], i + 1)
                c0, c1 = F.element_at(p["arc"], i), F.element_at(p["arc"], i + 1)

                def at(values: Column, j: Column) -> Column:
                    v0, v1 = F.element_at(values, i), F.element_at(values, i + 1)
                    return v0 + (v1 - v0) * ((j / F.lit(float(last)) * total - c0) / (c1 - c0))

                here = F.transform(F.sequence(low, high - 1), lambda j: F.struct(at(p["x"], j).alias("x"), at(p["y"], j).alias("y")))
                return F.when(high > low, here).otherwise(F.array().cast("array<struct<x:double,y:double>>"))

            end = F.array(F.struct(F.element_at(p["x"], -1).alias("x"), F.element_at(p["y"], -1).alias("y")))
            points = F.concat(F.flatten(F.transform(F.sequence(F.lit(1), F.size(p["arc"]) - 1), segment)), end)
            return let(points, lambda z: F.struct(F.transform(z, lambda v: v["x"]).alias("x"), F.transform(z, lambda v: v["y"]).alias("y")))

        line = let(F.struct(before.alias("before")), place)
        same = F.struct(p["x"].alias("x"), p["y"].alias("y"))
        still = F.struct(F.array_repeat(F.element_at(p["x"], 1), n).alias("x"), F.array_repeat(F.element_at(p["y"], 1), n).alias("y"))
        return F.when(F.size(p["x"]) == n, same).when(total <= 0, still).otherwise(line)

    return let(F.struct(x.alias("x"), y.alias("y"), arc_lengths(x, y).alias("arc")), along)


def interp_uniform(control: Column, n: int = 64) -> Column:
    """``n`` places equally spread over control values."""

    def spread(c: Column) -> Column:
        last = F.size(c) - 1

        def at(k: Column) -> Column:
            t = k * last / F.lit(float(n - 1))
            i = F.least(F.floor(t).cast("int"), last - 1)
            p, q = F.element_at(c, i + 1), F.element_at(c, i + 2)
            return p + (q - p) * (t - i)

        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at)

    return let(control, spread)


def gaussian_smooth(values: Column, sigma: float) -> Column:
    """Convolution with a normal kernel cut at four sigma; beyond the ends the end values continue."""
    radius = int(4 * sigma + 0.5)
    weights = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    total = sum(weights)
    kernel = F.array(*(F.lit(w / total) for w in weights))
    return _convolve(values, kernel, F.lit(radius))


def _convolve(values: Column, kernel: Column, radius: Column) -> Column:
    def run(p: Column) -> Column:
        window = lambda i: F.zip_with(F.slice(p["v"], i + 1, 2 * p["r"] + 1), p["k"], lambda v, w: v * w)
        return F.transform(F.sequence(F.lit(0), F.size(p["v"]) - 2 * p["r"] - 1), lambda i: F.aggregate(window(i), F.lit(0.0), lambda s, v: s + v))

    padded = let(values, lambda v: F.concat(F.array_repeat(F.element_at(v, 1), radius), v, F.array_repeat(F.element_at(v, -1), radius)))
    return let(F.struct(padded.alias("v"), kernel.alias("k"), radius.alias("r")), run)


def gaussian_smooth_by(values: Column, sigma: Column) -> Column:
    """The same with a width that differs by row."""
    radius = F.floor(4 * sigma + 0.5).cast("int")
    raw = F.transform(F.sequence(-radius, radius), lambda k: F.exp(-0.5 * (k / sigma) * (k / sigma)))
    kernel = let(raw, lambda r: let(F.aggregate(r, F.lit(0.0), lambda s, v: s + v), lambda t: F.transform(r, lambda v: v / t)))
    return _convolve(values, kernel, radius)


def softmax(values: Column) -> Column:
    raised = let(values, lambda x: let(F.array_max(x), lambda top: F.transform(x, lambda v: F.exp(v - top))))
    return let(raised, lambda r: let(F.aggregate(r, F.lit(0.0), lambda s, v: s + v), lambda t: F.transform(r, lambda v: v / t)))


def top_classes(probabilities: Column, names: list[str], k: int = 3) -> Column:
    """The ``k`` likeliest as structs (name, probability), likeliest first; ties by class order."""
    entries = F.transform(probabilities, lambda p, i: F.struct((-p).alias("o"), i.alias("i")))
    ranked = F.slice(F.array_sort(entries), 1, k)
    table = F.array(*(F.lit(n) for n in names))
    return F.transform(ranked, lambda s: F.struct(F.element_at(table, s["i"] + 1).alias("name"), (-s["o"]).alias("probability")))


def monotonic(values: Column) -> Column:
    """Running maximum."""
    return let(values, lambda x: F.transform(x, lambda _, i: F.array_max(F.slice(x, 1, i + 1))))


def truncate_at_boundary(x: Column, y: Column) -> Column:
    """Both arrays up to the first point after the start whose y leaves (0, 1), that point included."""
    out = F.filter(F.transform(y, lambda v, i: F.when((i >= 1) & ((v <= 0) | (v >= 1)), i)), lambda i: i.isNotNull())
    n = F.coalesce(F.try_element_at(out, F.lit(1)) + 1, F.size(y))
    return F.struct(F.slice(x, 1, n).alias("x"), F.slice(y, 1, n).alias("y"))
