"""Steps whose intermediate rows must not grow with the square of a crowd."""

import math

from trackframe.config import FilterConfig, MergeConfig
from trackframe.operators import crowds, detections, linking, merge, motion

BOX = "video_id bigint, track_id bigint, det_id bigint, frame_id bigint, x double, y double, width double, height double, confidence double"


def _tracks(spark, starts):
    """A track of two boxes from each (frame, x, y)."""
    rows = []
    for k, (frame, x, y) in enumerate(starts):
        rows += [(1, k, 2 * k + i, frame + i, float(x + i), float(y), 10.0, 10.0, 0.9) for i in range(2)]
    return spark.createDataFrame(rows, BOX)


def test_crowds_make_no_pairs(spark, monkeypatch):
    """Pairs inside a crowd are left out before they are made, all others stay."""
    crowd = [(3 * (k % 40), k % 20, k // 20) for k in range(160)]
    lonely = [(0, 2000, 0), (9, 2010, 5), (20, 2030, 0), (0, 260, 0), (9, 290, 3), (0, 0, 900), (7, 140, 900)]
    cfg, made = MergeConfig(min_points=2, crowd_limit=4, min_score=0.0), []
    near = merge.near_pairs

    def counted(*args, **more):
        out = near(*args, **more)
        made.append(out.count())
        return out

    df = _tracks(spark, crowd + lonely)
    ends = merge.endpoint_features(df)
    pairs = near(ends, cfg).collect()
    points = [(e[f"{p}_x"], e[f"{p}_y"]) for e in ends.collect() for p in ("start", "end")]
    want = set()
    for p in pairs:
        mx, my = (p.a_end_x + p.b_start_x) / 2, (p.a_end_y + p.b_start_y) / 2
        if sum(math.hypot(mx - x, my - y) <= cfg.crowd_radius for x, y in points) <= cfg.crowd_limit:
            want.add((p.a_track_id, p.b_track_id))
    monkeypatch.setattr(merge, "near_pairs", counted)
    got = {(r.a_track_id, r.b_track_id) for r in merge.merge_candidates(df, cfg).collect()}
    assert want
    assert got == want
    assert len(pairs) > 3000 and made[0] < 30


def _copies(spark, copies):
    """Boxes of three frames, each of them so many times."""
    rows = [(1, k * copies + c, k * copies + c, k % 3, float(11 * k % 37), float(7 * k % 23), 20.0 + k % 4, 15.0 + k % 5, 0.9) for k in range(24) for c in range(copies)]
    return spark.createDataFrame(rows, BOX)


def _iou(a, b):
    wide, high = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]), min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    common = max(wide, 0.0) * max(high, 0.0)
    return common / (a[2] * a[3] + b[2] * b[3] - common)


def test_copies_of_boxes_are_compared_once(spark, monkeypatch):
    """Pairs made in joins don't grow with copies; results are those of all pairs."""
    made = []
    real = detections.blocked

    def counted(*args):
        out = real(*args)
        made.append(out.count())
        return out

    df = _copies(spark, 5)
    monkeypatch.setattr(detections, "blocked", counted)
    monkeypatch.setattr(linking, "blocked", counted)
    boxes = {r.det_id: (r.frame_id, (r.x, r.y, r.width, r.height)) for r in df.collect()}
    over = {(a, b) for a in boxes for b in boxes if a < b and boxes[a][0] == boxes[b][0] and _iou(boxes[a][1], boxes[b][1]) > 0.35}
    for cell in (60.0, 7.0, None):
        got = [(r.det_a, r.det_b) for r in detections.overlap_pairs(df, 0.35, cell).collect()]
        assert len(got) == len(set(got)) and set(got) == over
    area = {k: b[2] * b[3] for k, (_, b) in boxes.items()}
    dead = {a if area[b] > area[a] else b for a, b in over}
    assert {r.det_id for r in detections.suppress_overlaps(df, 0.35).collect()} == boxes.keys() - dead
    near = {(a, b): s for a in boxes for b in boxes if boxes[a][0] + 1 == boxes[b][0] and (s := _iou(boxes[a][1], boxes[b][1])) >= 0.25}
    best_a = {a: min((-s, b) for (x, b), s in near.items() if x == a)[1] for a in {p[0] for p in near}}
    best_b = {b: min((-s, a) for (a, x), s in near.items() if x == b)[1] for b in {p[1] for p in near}}
    assert {(r.det_a, r.det_b) for r in linking.link_detections(df).collect()} == {(a, b) for a, b in best_a.items() if best_b[b] == a}
    assert max(made) <= 24 * 24
    few, many = _copies(spark, 1), {r.det_id for r in detections.suppress_overlaps(df, 0.35, mode="greedy").collect()}
    assert {r.det_id // 5 for r in detections.suppress_overlaps(df, 0.35, mode="greedy").collect()} == {r.det_id for r in detections.suppress_overlaps(few, 0.35, mode="greedy").collect()} and len(many) < 24


def test_more_copies_than_a_row_holds(spark, monkeypatch):
    monkeypatch.setattr(detections, "COPIES_A_ROW", 2)
    df = _copies(spark, 5).where("det_id < 30")
    got = [(r.det_a, r.det_b) for r in detections.overlap_pairs(df, 0.35).collect()]
    boxes = {r.det_id: (r.frame_id, (r.x, r.y, r.width, r.height)) for r in df.collect()}
    assert sorted(got) == sorted((a, b) for a in boxes for b in boxes if a < b and boxes[a][0] == boxes[b][0] and _iou(boxes[a][1], boxes[b][1]) > 0.35)


def test_links_hold_few_overlaps(monkeypatch):
    """overlaps are computed some at a time; the links are those of all at once."""
    import numpy as np

    from trackframe.config import TrackerConfig
    from trackframe.streaming import ordered

    r, live, most = np.random.default_rng(1), {}, []
    real = np.zeros_like
    monkeypatch.setattr(np, "zeros_like", lambda v, *a, **k: most.append(v.size) or real(v, *a, **k))
    frames = [{"det_id": list(range(100 * f, 100 * f + 60)), **{c: r.integers(lo, hi, 60).astype(float).tolist() for c, lo, hi in (("x", 0, 60), ("y", 0, 60), ("width", 20, 40), ("height", 20, 40))}, "confidence": (r.integers(0, 100, 60) / 100).tolist()} for f in range(4)]
    whole = [ordered.link_frame(f, rows, live, TrackerConfig()) for f, rows in enumerate(frames)]
    monkeypatch.setattr(ordered, "OVERLAPS_AT_ONCE", 500)
    live, most[:] = {}, []
    assert [ordered.link_frame(f, rows, live, TrackerConfig()) for f, rows in enumerate(frames)] == whole
    assert max(most) <= 500 and sum(map(len, whole)) > 150


def test_pictures_leave_in_small_batches():
    """a task doesn't hold all pictures of an Arrow batch."""
    import pyarrow as pa

    from trackframe.operators import images

    rows = pa.RecordBatch.from_arrays([pa.array(range(600)), pa.array([[4 * (k % 4096) + 1 + k % 3] for k in range(600)], pa.list_(pa.int32()))], names=["route_id", "painted"])
    made = list(images.paint(iter([rows]), 64))
    assert max(b.num_rows for b in made) < 300 and [i for b in made for i in b.column("route_id").to_pylist()] == list(range(600))
    for k, picture in zip(range(600), (p for b in made for p in b.column("image").to_pylist()), strict=True):
        assert len(picture) == 3 * 4096 and tuple(picture[c * 4096 + k % 4096] for c in range(3)) == tuple(images.COLOURS[1 + k % 3])


def test_crowded_pairs_shuffle_only_ends(spark, monkeypatch):
    """near pairs are made and counted where their ends meet, in parts, and are those of the join with all points."""
    cfg = MergeConfig(min_points=2, crowd_limit=4, max_gap=30, max_distance=60.0, crowd_radius=50.0)
    crowd = [(3 * (k % 40), 37 * k % 90 - 45, k // 20) for k in range(160)] + [(5 * (k % 9), 1000 + 50 * k, -400 + 7 * k) for k in range(40)]
    ends = merge.endpoint_features(_tracks(spark, crowd + [(4, 30.0, float("nan")), (9, float("inf"), 2.0)]))
    want = sorted(map(tuple, merge.crowded_pairs(merge.near_pairs(ends, cfg), ends, cfg).collect()))
    assert len(want) > 1000
    plan = crowds.crowded_near_pairs(ends, cfg)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("FlatMapGroupsInArrow") < plan.index("Exchange")
    for held in (16_384, 7):
        monkeypatch.setattr(crowds, "ENDS_A_GROUP", held)
        assert sorted(map(tuple, crowds.crowded_near_pairs(ends, cfg).collect())) == want


def test_rings_hold_the_work(monkeypatch):
    """distances computed for a crowd are few of all, and counts are exact at the radius itself."""
    import numpy as np

    r, made, real = np.random.default_rng(3), [], np.count_nonzero
    x, y, n = r.integers(0, 400, 4000) / 2, r.integers(0, 400, 4000) / 2, r.integers(1, 3, 4000)
    mx, my = r.integers(0, 800, 3000) / 4, r.integers(0, 800, 3000) / 4
    want = [int(n[np.sqrt((a - x) ** 2 + (b - y) ** 2) <= 50.0].sum()) for a, b in zip(mx, my, strict=True)]
    assert crowds.count_near(mx, my, x, y, n, 50.0).tolist() == want
    monkeypatch.setattr(np, "count_nonzero", lambda v, **k: made.append(v.size) or real(v, **k))
    assert crowds.count_near(np.tile(mx, 20), np.tile(my, 20), x, y, np.ones(4000, np.int64), 50.0).sum() > 0
    assert sum(made) < 20 * 3000 * 4000 / 10
    monkeypatch.setattr(crowds, "DISTANCES_AT_ONCE", 50)
    assert crowds.count_near(mx, my, x, y, n, 50.0).tolist() == want
    monkeypatch.setattr(crowds, "COMPARED_AT_ONCE", 100)
    af, bf = r.integers(0, 50, 300), np.sort(r.integers(0, 50, 200))
    near = [(i, j) for a, b in crowds._pairs_of((mx[:300], my[:300], af), (x[:200], y[:200], bf), 9, 40.0) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    assert near == [(i, j) for i in range(300) for j in range(200) if 0 < bf[j] - af[i] <= 9 and np.hypot(mx[i] - x[j], my[i] - y[j]) <= 40.0]


def test_routes_are_made_by_many_tasks(spark, tmp_path):
    """one small file of ids is spread before routes are made, and ids are split, not routes."""
    from pyspark.sql import functions as F

    from trackframe.fixtures import Fixtures
    from trackframe.plans import route_queries

    spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    split = route_queries._synthetic_split(Fixtures(spark, str(tmp_path)))
    sizes = [r["count"] for r in split.select(F.spark_partition_id().alias("task"), F.col("x_coords")[0].alias("x")).where("x IS NOT NULL").groupBy("task").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2 * sum(sizes) / 4
    kinds = {r["split"]: r["count"] for r in split.groupBy("split").count().collect()}
    assert kinds == {"train": 400, "val": 50, "test": 50}
    plan = split._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("noise") < plan.index("Window")


def test_zone_filter_names_each_column_once(spark):
    """F16: what columns are made of is not repeated in the filter, which would make its compiled loop too long to leave the interpreter."""
    rows = [(k, float(v), w, h) for k, (v, w, h) in enumerate((v, w, h) for v in (-200, 200, 300, 690, 900) for w in (5.0, 12.0, 20.0, 90.0) for h in (0.0, 12.0, 25.0, 100.0))] + [(900, None, 20.0, 20.0), (901, float("nan"), 20.0, 20.0), (902, 300.0, None, 20.0)]
    made = spark.createDataFrame(rows, "det_id bigint, v double, width double, height double").selectExpr("det_id", "v + 7919 AS y", "width", "height")
    plan = detections.zone_filter(made)._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in plan and sum(line.count("7919") for line in plan.splitlines() if "Filter" in line) == 1
    cfg, keep = FilterConfig(), set()
    for k, v, w, h in rows:
        if w is None:
            continue
        y = None if v is None else v + 7919 + h / 2
        zone = "mid" if y is None else "near" if y != y or y >= cfg.near_y else "far" if y <= cfg.far_y else "mid"
        area, aspect = getattr(cfg, f"{zone}_area"), getattr(cfg, f"{zone}_aspect")
        if area.low <= w * h <= area.high and aspect.low <= (w / h if h > 0 else 0.0) <= aspect.high:
            keep.add(k)
    assert {r.det_id for r in detections.zone_filter(made).collect()} == keep and 5 < len(keep) < len(rows)


def test_motion_is_fitted_once(spark, tmp_path):
    """F16: the accumulated motion reads fits that were written, not the matched points again and again."""
    rows = [(v, f, k, float(37 * k % 190), float(59 * k % 98), 37 * k % 190 + 3.0 + k % 5 / 4 + 80 * (k % 10 == 0), 59 * k % 98 - 2.0) for v in (0, 1) for f in range(3) for k in range(40)]
    spark.createDataFrame(rows, "video_id bigint, frame_id bigint, pt_id bigint, px double, py double, cx double, cy double").write.parquet(f"{tmp_path}/points")
    fit = motion.fit_frame_motion(spark.read.parquet(f"{tmp_path}/points"))
    assert not any("/points/" in f for f in fit.inputFiles())
    assert motion.cumulative_transform(motion.smooth_motion(fit))._jdf.queryExecution().optimizedPlan().toString().count("pt_id") == 0
    got = fit.collect()
    assert len(got) == 6 and all(r.ok and r.points == 40 and r.inliers == 36 and abs(r.dy + 2) < 0.1 for r in got)


def test_boxes_are_filtered_once(spark, tmp_path, monkeypatch):
    """F16: suppression, which reads its input several times, gets boxes that were written."""
    from trackframe.config import PipelineConfig
    from trackframe.plans import pipelines

    rows = [(1, t, 20 * t + f, f, 100.0 * t + f, 300.0, 20.0, 25.0, 0.9) for t in range(3) for f in range(20)]
    spark.createDataFrame(rows, BOX).write.parquet(f"{tmp_path}/boxes")
    seen, real = [], detections.suppress_overlaps
    monkeypatch.setattr(detections, "suppress_overlaps", lambda df, *a, **k: seen.extend(df.inputFiles()) or real(df, *a, **k))
    out = pipelines.detections_to_tracks(spark.read.parquet(f"{tmp_path}/boxes"), cfg=PipelineConfig(min_track=2), link=False)
    assert out.count() == 60 and seen and not any("/boxes/" in f for f in seen)


def _crowd(spark, n, frames=2, seed=5, size=(10, 50)):
    """So many boxes, all but a few different, in each of some frames; some without place or size."""
    import numpy as np

    r = np.random.default_rng(seed)
    rows = [(1, k, k, k % frames, *map(float, (*r.integers(-90, 150, 2), *r.integers(*size, 2))), 0.9) for k in range(n * frames)]
    odd = [(1, 0, 90_001, 0, None, 5.0, 20.0, 20.0, 0.9), (1, 0, 90_002, 0, 5.0, 5.0, 0.0, 20.0, 0.9), (1, 0, 90_003, 1, 5.0, float("nan"), 20.0, 20.0, 0.9), (1, 0, 90_004, 1, 5.0, 5.0, 20.0, -20.0, 0.9), (1, 0, 90_005, 1, 0.0, float("inf"), 20.0, 20.0, 0.9)]
    boxes = {row[2]: (row[3], row[4:8]) for row in rows}
    return spark.createDataFrame(rows + odd, BOX), boxes


def test_links_meet_in_tiles(spark, monkeypatch):
    """best overlaps are found inside tiles by bounds, also when a tile is dealt to groups; no join makes pairs."""
    from trackframe.operators import overlaps

    df, boxes = _crowd(spark, 220, frames=3)
    near = {(a, b): s for a in boxes for b in boxes if boxes[a][0] + 1 == boxes[b][0] and (s := _iou(boxes[a][1], boxes[b][1])) >= 0.25}
    best_a = {a: min((-s, b) for (x, b), s in near.items() if x == a)[1] for a in {p[0] for p in near}}
    best_b = {b: min((-s, a) for (a, x), s in near.items() if x == b)[1] for b in {p[1] for p in near}}
    want = {(a, b): near[a, b] for a, b in best_a.items() if best_b[b] == a}
    found = linking.link_detections(df)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "SortMergeJoin" not in plan
    for held, cell in ((detections.BOXES_A_GROUP, 60.0), (9, 60.0), (9, 11.0)):
        monkeypatch.setattr(detections, "BOXES_A_GROUP", held)
        assert {(r.det_a, r.det_b): r.iou for r in linking.link_detections(df, cell=cell).collect()} == want and len(want) > 100
    assert overlaps.LEAF < 220


def test_bounds_leave_few_overlaps(monkeypatch):
    """of all overlaps of a crowd few are computed, and the best, the larger and the pairs are those of all."""
    import numpy as np

    from trackframe.operators import overlaps

    r, made, real = np.random.default_rng(7), [], overlaps._share
    x, y, w, h = (r.integers(lo, hi, 6000).astype(float) for lo, hi in ((0, 300), (0, 200), (10, 60), (20, 100)))
    one, two = slice(0, 3000), slice(3000, 6000)
    a, b = (overlaps.Boxes(x[s], y[s], w[s], h[s], np.arange(6000)[s]) for s in (one, two))
    wide = np.minimum.outer((x + w)[one], (x + w)[two]) - np.maximum.outer(x[one], x[two])
    high = np.minimum.outer((y + h)[one], (y + h)[two]) - np.maximum.outer(y[one], y[two])
    common = np.maximum(wide, 0) * np.maximum(high, 0)
    share = common / (np.add.outer((w * h)[one], (w * h)[two]) - common)

    def counted(p, q):
        made.append((out := real(p, q)).size)
        return out

    monkeypatch.setattr(overlaps, "_share", counted)
    top, other = overlaps.best(a, b, 0.25)
    most, who = share.max(axis=1)[a.order], 3000 + share.argmax(axis=1)[a.order]
    assert (top == np.where(most >= 0.25, most, 0)).all() and (other[top > 0] == who[top > 0]).all() and (top > 0).sum() > 2900
    assert sum(made) < 3000 * 3000 / 5
    made.clear()
    found, least = overlaps.larger(a, b, 0.35)
    over, area = share > 0.35, w * h
    assert (found == (over & (area[two] > area[one, None])).any(axis=1)[a.order]).all()
    same = np.where(over & (area[two] == area[one, None]), np.arange(3000, 6000), np.iinfo(np.int64).max).min(axis=1)[a.order]
    assert (least[~found] == same[~found]).all() and sum(made) < 3000 * 3000 / 5
    whole = overlaps.Boxes(x[one], y[one], w[one], h[one], np.arange(3000))
    got = {(min(p), max(p)) for i, j, _ in overlaps.pairs(whole, np.ones(3000, bool), 0.35) for p in zip(whole.order[i].tolist(), whole.order[j].tolist(), strict=True) if p[0] != p[1]}
    wide = np.minimum.outer((x + w)[one], (x + w)[one]) - np.maximum.outer(x[one], x[one])
    high = np.minimum.outer((y + h)[one], (y + h)[one]) - np.maximum.outer(y[one], y[one])
    common = np.maximum(wide, 0) * np.maximum(high, 0)
    p, q = np.nonzero(common / (np.add.outer(area[one], area[one]) - common) > 0.35)
    assert got == {(i, j) for i, j in zip(p.tolist(), q.tolist(), strict=True) if i < j} and len(got) > 20_000


def test_pairs_are_made_in_tiles(spark, monkeypatch):
    """pairs leave the tiles in which boxes meet, each once, rounded as Spark rounds; no join makes them."""
    from pyspark.sql import functions as F

    from trackframe.operators import overlaps

    df, boxes = _crowd(spark, 200)
    df = df.unionByName(df.where("det_id % 7 = 0").withColumn("det_id", F.col("det_id") + 1000))
    boxes |= {k + 1000: v for k, v in boxes.items() if k % 7 == 0}
    want = {(a, b): s for a in boxes for b in boxes if a < b and boxes[a][0] == boxes[b][0] and (s := _iou(boxes[a][1], boxes[b][1])) > 0.35}
    area = lambda k: boxes[k][1][2] * boxes[k][1][3]
    found = detections.overlap_pairs(df, 0.35)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "SortMergeJoin" not in plan
    for held, cell, batch in ((9, 60.0, 50), (9, 5.0, 1 << 17), (detections.BOXES_A_GROUP, None, 3)):
        monkeypatch.setattr(detections, "BOXES_A_GROUP", held)
        monkeypatch.setattr(overlaps, "PAIRS_A_BATCH", batch)
        rows = detections.overlap_pairs(df, 0.35, cell).collect()
        assert len(rows) == len(want) > 200 and {(r.det_a, r.det_b): r.iou for r in rows} == want
        assert all((r.area_a, r.area_b) == (area(r.det_a), area(r.det_b)) for r in rows)
    near = [0.3500005, 0.5, 2 / 3, 0.123456499999, 0.1234565, 0.12345650000001, 1.0, 1 / 7, 0.9999995, 0.99999949]
    spark_round = [r[0] for r in spark.createDataFrame([(v,) for v in near], "v double").select(F.round("v", 6)).collect()]
    import numpy as np

    assert overlaps._round(np.array(near), 6).tolist() == spark_round


def test_only_linked_boxes_are_chained(spark, monkeypatch):
    """pointers double over linked boxes, not over all; boxes by themselves are tracks if confident enough."""
    rows = [(1, t, 10 * t + f, f, 100.0 * t, 0.0, 20.0, 20.0, 0.9) for t in range(3) for f in range(5)]  # three tracks of five boxes
    rows += [(1, 9, 100 + k, 7, 50.0 * k, 500.0, 20.0, 20.0, 0.05 * k) for k in range(8)] + [(1, 9, None, 7, 900.0, 900.0, 20.0, 20.0, 0.9), (None, 9, 200, 7, 900.0, 900.0, 20.0, 20.0, 0.9)]
    made, real = [], linking.materialize
    monkeypatch.setattr(linking, "materialize", lambda df, name: made.append((name, (out := real(df, name)).count())) or out)
    got = {(r.det_id, r.track_id) for r in linking.assign_track_ids(spark.createDataFrame(rows, BOX)).collect()}
    assert got == {(10 * t + f, 10 * t) for t in range(3) for f in range(5)} | {(100 + k, 100 + k) for k in (5, 6, 7)}
    assert {n for name, n in made if name == "chain"} == {12}


def test_links_of_a_crowd_keep_few_pairs(monkeypatch):
    """F8: pairs of lower overlap are looked for only among what higher ones leave; links are those of all pairs in order."""
    import numpy as np

    from trackframe.config import TrackerConfig
    from trackframe.operators import overlaps
    from trackframe.streaming import ordered

    r, kept, real = np.random.default_rng(11), [], overlaps.above
    monkeypatch.setattr(ordered, "CROWD", 50)

    def counted(*args):
        for found in real(*args):
            kept.append(len(found[0]))
            yield found

    monkeypatch.setattr(overlaps, "above", counted)
    frames = [{"det_id": (1000 * f + r.permutation(400)).tolist(), **{c: r.integers(lo, hi, 400).astype(float).tolist() for c, lo, hi in (("x", 0, 90), ("y", 0, 60), ("width", 20, 40), ("height", 20, 40))}, "confidence": (r.integers(0, 100, 400) / 100).tolist()} for f in range(3)]
    frames[1]["x"][0], frames[2]["width"][1] = None, 0.0
    cfg, live, state, every = TrackerConfig(), {}, {}, 0
    for f, rows in enumerate(frames):
        box = list(zip(*(rows[c] for c in ("x", "y", "width", "height")), strict=True))
        near = [(-s, rows["det_id"][i], t, i) for i in range(400) for t, b in state.items() if None not in (*box[i], *b) and box[i][2] * box[i][3] > 0 and b[2] * b[3] > 0 and (s := _iou(box[i], b)) >= 0.25]
        every, want, used = every + len(near), {}, set()
        for low, high in ((cfg.track_high, 2.0), (cfg.track_low, cfg.track_high)):
            part = [i for i in range(400) if low <= rows["confidence"][i] < high]
            for _, det, t, i in sorted(n for n in near if n[3] in set(part)):
                if det not in want and t not in used:
                    want[det] = t
                    used.add(t)
            for i in part:
                if rows["det_id"][i] not in want and rows["confidence"][i] >= cfg.new_track:
                    want[rows["det_id"][i]] = rows["det_id"][i]
        assert dict(ordered.link_frame(f, rows, live, cfg)) == want
        state |= {want[d]: box[i] for i, d in enumerate(rows["det_id"]) if d in want}
    assert 0 < sum(kept) < every / 5


def test_a_part_of_the_stream_is_one_file(spark, tmp_path):
    """F8: of several files the first would move the watermark past boxes of the others, which would be dropped as late."""
    from pyspark.sql import functions as F

    from trackframe.fixtures import Fixtures
    from trackframe.plans import stream_queries

    rows = spark.range(30_000).select(F.lit(1).cast("bigint").alias("video_id"), F.lit(1).cast("bigint").alias("track_id"), F.col("id").alias("det_id"), (F.col("id") % 600).alias("frame_id"), *(F.rand(3).alias(c) for c in ("x", "y", "width", "height", "confidence")))
    size = "spark.sql.adaptive.coalescePartitions.minPartitionSize"
    spark.conf.set(size, "1b")
    try:
        stream_queries._shuffled(Fixtures(spark, str(tmp_path)), rows)
    finally:
        spark.conf.unset(size)
    folder = max((f for f in __import__("pathlib").Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")).glob("stream-*")), key=lambda f: f.stat().st_mtime)
    assert len(list(folder.glob("part-*.parquet"))) == 6
