"""Class weights, model search, pictures, row checks, capped merges, components and splits against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackframe.operators import checks, images, labels, merge, ml, stars
from trackframe.operators import routes as rt
from trackframe.operators import synthetic as syn

CLASSES = ["curl", "flat", "streak"]


@pytest.fixture(scope="module")
def uneven(spark):
    """Generated routes, one class far rarer than the others, with noise so that classes overlap."""
    ids = spark.range(260).select((F.col("id") + 1).alias("route_id"), F.when(F.col("id") < 12, "flat").when(F.col("id") < 130, "streak").otherwise("curl").alias("route_type"))
    shake = lambda c: F.transform(c, lambda v, i: v * 0.2 + F.pmod(F.xxhash64(F.col("route_id"), i), F.lit(1000)) / 1000.0 * 0.8)
    rows = syn.routes_of(ids).withColumns({"x_coords": shake("x_coords"), "y_coords": shake("y_coords")})
    return rows.drop("params").cache()


@pytest.mark.parametrize("kind, params", [("perceptron", {"maxIter": 8, "hidden": 4}), ("forest", {"numTrees": 5, "maxDepth": 3}), ("logistic", {"maxIter": 15, "regParam": 0.1}), ("one_vs_rest", {"maxIter": 3})])
def test_balanced_changes_every_model(uneven, kind, params):
    scores = {}
    for balanced in (False, True):
        model = ml.train_classifier(uneven, kind, CLASSES, balanced=balanced, **params)
        scores[balanced] = {r.route_id: (r.pred, round(r.confidence, 9)) for r in ml.predict(model, uneven, CLASSES).collect()}
    assert scores[False] != scores[True]
    rare = lambda s: sum(p == "flat" for p, _ in s.values())
    assert rare(scores[True]) >= rare(scores[False])


def test_resampling_keeps_expected_weights(spark):
    rows = spark.range(3000).select(F.col("id").alias("route_id"), (F.col("id") % 4 * 0.7).alias("weight"))
    counts = {r.weight: r.n for r in ml.resampled(rows).groupBy("weight").agg(F.count("*").alias("n")).collect()}
    assert 0.0 not in counts and all(abs(n / 750 - w) < 0.1 for w, n in counts.items()) and len(counts) == 3
    assert ml.resampled(rows.limit(0)).count() == 0


def test_search_keeps_the_best(uneven):
    split = labels.random_split(uneven)
    model, scores = ml.search(split, [("logistic", {"maxIter": 1}), ("logistic", {"maxIter": 30}), ("forest", {"numTrees": 3, "maxDepth": 2})], CLASSES)
    rows = scores.collect()
    (chosen,) = [r for r in rows if r.chosen]
    assert chosen.accuracy == max(r.accuracy for r in rows) and chosen.model == min(r.model for r in rows if r.accuracy == chosen.accuracy)
    again = ml.evaluate({"best": model}, split.where("split = 'val'"), CLASSES).first()
    assert again.accuracy == chosen.accuracy
    with pytest.raises(ValueError):
        ml.train_classifier(split, "logistic", CLASSES, depth=3)
    with pytest.raises(ValueError):
        ml.features_of(split, inputs="sound")


def test_pictures_hold_their_pixels(uneven):
    some = uneven.where("route_id < 20")
    want = {}
    for r in rt.route_pixels(some).collect():
        want.setdefault(r.route_id, np.full((3, 64, 64), 255, np.uint8))[:, r.r, r.c] = images.COLOURS[1 + images.KINDS.index(r.channel)]
    got = {r.route_id: np.frombuffer(r.image, np.uint8).reshape(3, 64, 64) for r in images.route_images(some).collect()}
    assert got.keys() == want.keys() and all((got[k] == want[k]).all() for k in want)


def test_bars_see_their_direction(spark):
    def line(route, dx, dy):
        t = np.linspace(0.1, 0.9, 64)
        return (route, [float(v) for v in (t if dx else np.full(64, 0.5))], [float(v) for v in (t if dy else np.full(64, 0.5))])

    rows = spark.createDataFrame([line(1, 1, 0), line(2, 0, 1)], "route_id long, x_coords array<double>, y_coords array<double>")
    seen = {r.route_id: r.features.toArray()[: 8 * 64].reshape(8, 64).sum(1) for r in images.image_features(images.route_images(rows)).collect()}
    assert seen[1].argmax() == 0 and seen[2].argmax() == 4 and len(images.edge_filters()) == 8
    assert images.image_features(images.route_images(rows.limit(0))).count() == 0


def test_row_checks(spark):
    schema = "video_id long, det_id long, frame_id long, x double, y double, width double, height double, confidence double"
    good, bad = (1, 1, 0, 5.0, 5.0, 4.0, 4.0, 0.5), [(None, 2, 0, 5.0, 5.0, 4.0, 4.0, 0.5), (1, 3, -1, None, 5.0, 4.0, -4.0, 0.5), (1, 4, 0, float("nan"), 5.0, 4.0, 4.0, 2.0)]
    rows = spark.createDataFrame([good, *bad], schema)
    kept, broken = checks.quarantine(rows, checks.detection_rules())
    assert [tuple(r) for r in kept.collect()] == [good]
    assert {r.det_id: r.broken for r in broken.collect()} == {2: ["ids"], 3: ["frame", "place", "size"], 4: ["place", "confidence"]}
    assert checks.required(kept, checks.detection_rules()).count() == 1
    with pytest.raises(Exception, match="row breaks frame, place, size"):
        checks.required(rows.where("det_id = 3"), checks.detection_rules()).collect()
    seen_rows, seen = checks.observed(rows, checks.detection_rules())
    seen_rows.collect()
    assert seen.get == {"rows": 4, "ids": 1, "frame": 1, "place": 2, "size": 1, "confidence": 1}
    routes = spark.createDataFrame([(1, [0.0] * 10, [1.0] * 10), (2, [0.0], [0.0, 1.0]), (3, [0.5] * 10, [1.5] * 10), (4, None, [0.0] * 10)], "route_id long, x_coords array<double>, y_coords array<double>")
    found = {r.route_id: r.broken for r in checks.checked(routes, checks.route_rules()).collect()}
    assert found == {1: [], 2: ["lengths", "points"], 3: ["bounds"], 4: ["coordinates", "lengths", "points", "bounds"]}


def in_turn(pairs, limit):
    used, kept = {}, []
    for p in sorted(pairs, key=lambda p: (p[0], p[3], p[1], p[4], p[2])):
        a, b = (p[0], p[1]), (p[0], p[2])
        if used.get(a, 0) < limit and used.get(b, 0) < limit:
            used[a], used[b] = used.get(a, 0) + 1, used.get(b, 0) + 1
            kept.append(p)
    return sorted(kept)


@pytest.mark.parametrize("limit", [1, 2])
def test_capped_merges_by_rounds(spark, limit):
    r = np.random.default_rng(limit)
    pairs = {(int(v), int(a), int(b)) for v, a, b in zip(r.integers(0, 3, 400), r.integers(0, 40, 400), r.integers(40, 80, 400), strict=True)}
    pairs |= {(9, k, k + 1) for k in range(60)} | {(8, 0, k) for k in range(1, 30)}
    rows = [(v, a, b, a // 3, b // 5, 0.5) for v, a, b in sorted(pairs)]
    schema = "video_id long, a_track_id long, b_track_id long, a_start_frame long, b_start_frame long, score double"
    got = merge.cap_merges(spark.createDataFrame(rows, schema), limit)
    assert sorted(map(tuple, got.collect())) == in_turn(rows, limit)
    assert merge.cap_merges(spark.createDataFrame([], schema)).count() == 0


def reached(edges):
    near = {}
    for g, a, b in edges:
        near.setdefault((g, a), set()).add((g, b))
        near.setdefault((g, b), set()).add((g, a))
    out = {}
    for start in sorted(near):
        if start not in out:
            todo = [start]
            while todo:
                n = todo.pop()
                if n not in out:
                    out[n] = start[1]
                    todo += near[n]
    return {(g, n, c) for (g, n), c in out.items()}


def test_components_by_stars(spark):
    r = np.random.default_rng(6)
    edges = [(int(g), int(a), int(b)) for g, a, b in zip(r.integers(0, 4, 500), r.integers(0, 300, 500), r.integers(0, 300, 500), strict=True)]
    edges += [(7, k, k + 1) for k in range(300)] + [(8, 5000, k) for k in range(3000)] + [(9, 3, 3)] + edges[:50]
    got = stars.components(spark.createDataFrame(edges, "v long, a long, b long"), "v", "a", "b")
    rows = [tuple(x) for x in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == reached(edges)
    assert stars.components(spark.createDataFrame([], "v long, a long, b long"), "v", "a", "b").count() == 0


def test_a_hub_is_dealt_over_tasks(spark):
    """Edges of a star meet its least neighbour in many tasks."""
    total = 100_000
    edges = spark.range(total).select(F.lit(0).alias("g"), F.lit(-1).cast("long").alias("u"), F.col("id").alias("v"))
    least = edges.groupBy("g", "u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    sizes = [x.n for x in stars._met(edges, least, total).groupBy("salt").agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == total and len(sizes) == stars.HOT_A_TASK * 4 and max(sizes) < 1.5 * total / len(sizes)


def test_split_ranks_are_exact_in_any_ranges(spark, monkeypatch):
    rows = spark.range(5000).select(F.col("id").alias("route_id"))
    one = {(r.route_id, r.split) for r in labels.random_split(rows).collect()}
    monkeypatch.setattr(labels, "RANGE_ROWS", 100)
    many = {(r.route_id, r.split) for r in labels.random_split(rows).collect()}
    assert one == many and sorted(sum(s == n for _, s in one) for n in ("train", "val", "test")) == [500, 500, 4000]
    assert labels.random_split(rows.limit(0)).count() == 0


def test_sql_functions_equal_the_columns(spark):
    """Paths of up to 200 points, of no length, and of one point; softmax of large scores."""
    from trackframe.functions import arrays, sql_functions

    sql_functions.register(spark)
    r = np.random.default_rng(9)
    walk = lambda n: [float(v) for v in np.cumsum(r.standard_normal(n))]
    rows = [(k, walk(n), walk(n)) for k, n in enumerate((2, 3, 63, 64, 65, 66, 129, 130, 200))] + [(90, [1.0, 1.0, 1.0], [2.0, 2.0, 2.0]), (91, [1.0, 1.0, 2.0, 2.0], [0.0] * 4)]
    df = spark.createDataFrame(rows, "id long, x array<double>, y array<double>")
    made = spark.sql("SELECT id, tf_resample(x, y, 50) AS s, tf_softmax(x) AS p, x, y FROM {d}", d=df)
    for q in made.withColumns({"r": arrays.resample(F.col("x"), F.col("y"), 50), "q": arrays.softmax(F.col("x"))}).collect():
        assert len(q.s.x) == 50 and np.allclose(q.s.x, q.r.x) and np.allclose(q.s.y, q.r.y) and np.allclose(q.p, q.q)
    one = spark.sql("SELECT tf_resample(array(3D), array(4D), 4) AS s, tf_softmax(array(1000D, 1000D)) AS p").first()
    assert one.s.x == [3.0] * 4 and one.s.y == [4.0] * 4 and one.p == [0.5, 0.5]
