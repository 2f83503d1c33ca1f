"""Queries on boxes and tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import FilterConfig, MergeConfig
from ..operators import detections as d
from ..operators import checks, crowds, field, linking, merge, motion, teams, tracks
from ..storage import materialize
from .catalog import query, rounded

_KEEP = "confidence >= 0.15 AND width*height BETWEEN 150 AND 7500 AND width/height BETWEEN 0.25 AND 1.75 AND y BETWEEN 10 AND 974"
_SUMMARY = """WITH s AS (SELECT *, x+width/2 cx, y+height/2 cy, lag(x+width/2) OVER w px, lag(y+height/2) OVER w py,
    row_number() OVER w k, count(*) OVER (PARTITION BY video_id, track_id) n FROM {t} WINDOW w AS (PARTITION BY video_id, track_id ORDER BY frame_id, det_id)),
  summary AS (SELECT video_id, track_id, count(*) num_detections, min(frame_id) first_frame, max(frame_id) last_frame,
    coalesce(sum(sqrt((cx-px)*(cx-px)+(cy-py)*(cy-py))), 0.0) total_distance,
    max(CASE WHEN k=1 THEN cx END) first_x, max(CASE WHEN k=1 THEN cy END) first_y, max(CASE WHEN k=n THEN cx END) last_x, max(CASE WHEN k=n THEN cy END) last_y
    FROM s GROUP BY video_id, track_id),
  tracks AS (SELECT *, sqrt((last_x-first_x)*(last_x-first_x)+(last_y-first_y)*(last_y-first_y)) displacement FROM summary)
"""
DET_TRACKS = _SUMMARY.format(t="det")


@query("p1_bbox_geometry", "det", sql="SELECT det_id, x+width/2 AS center_x, y+height/2 AS center_y, width*height AS area, x+width AS x2, y+height AS y2, round(CASE WHEN height>0 THEN width/height ELSE 0 END, 6) AS aspect FROM det")
def _(f):
    return rounded(d.bbox_geometry(f.det).select("det_id", "center_x", "center_y", "area", "x2", "y2", "aspect"))


@query("f1_filter_detections", "det", sql=f"SELECT video_id, track_id, det_id FROM det WHERE {_KEEP}")
def _(f):
    return d.filter_detections(f.det).select("video_id", "track_id", "det_id")


@query("f2_zone_filter", "det", sql="""SELECT det_id, CASE WHEN y+height/2 >= 734 THEN 'near' WHEN y+height/2 <= 250 THEN 'far' ELSE 'mid' END AS zone FROM det
  WHERE CASE WHEN y+height/2 >= 734 THEN width*height BETWEEN 350 AND 10000 AND width/height BETWEEN 0.2 AND 1.75
             WHEN y+height/2 <= 250 THEN width*height BETWEEN 150 AND 7500 AND width/height BETWEEN 0.2 AND 1.75
             ELSE width*height BETWEEN 250 AND 7500 AND width/height BETWEEN 0.25 AND 1.75 END""")
def _(f):
    return d.zone_filter(f.det).select("det_id", d.zone().alias("zone"))


@query("f3_class_conf_filter", "det", sql="SELECT det_id FROM det WHERE det_id % 4 IN (0) AND confidence >= 0.25")
def _(f):
    return d.class_conf_filter(f.det.withColumn("class_id", (F.col("det_id") % 4).cast("int"))).select("det_id")


@query("f4_ghost_filter", "det", sql="SELECT det_id FROM det WHERE confidence >= 0.1")
def _(f):
    return d.ghost_filter(f.det).select("det_id")


@query("f5_drop_short_tracks", "det", sql="SELECT det_id FROM det QUALIFY count(*) OVER (PARTITION BY video_id, track_id) >= 30")
def _(f):
    return tracks.drop_short_tracks(f.det, 30).select("det_id")


@query("f6_drop_off_field", "det", sql="SELECT det_id FROM det QUALIFY avg(CASE WHEN x+width/2 BETWEEN 0 AND 1920 AND y+height/2 BETWEEN 50 AND 500 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id, track_id) >= 0.45")
def _(f):
    return tracks.drop_off_field(f.det, max_y=500, share=0.45).select("det_id")


@query("f7_limit_frames", "det", sql="SELECT det_id FROM det WHERE frame_id < 1000")
def _(f):
    return d.limit_frames(f.det, 1000).select("det_id")


@query("f8_min_points", "det", sql="SELECT video_id, track_id, count(*) AS n FROM det GROUP BY 1, 2 HAVING count(*) >= 10")
def _(f):
    return tracks.drop_short_tracks(f.det, 10).groupBy("video_id", "track_id").agg(F.count("*").alias("n"))


@query("f9_active_at", "det", sql="SELECT video_id, track_id FROM det GROUP BY 1, 2 HAVING min(frame_id) <= 2000 AND max(frame_id) >= 2000")
def _(f):
    return tracks.active_at(tracks.track_summary(f.det), 2000).select("video_id", "track_id")


@query("f12_sample_every_n", "det", sql="SELECT video_id, frame_id FROM (SELECT DISTINCT video_id, frame_id FROM det WHERE frame_id % 10 = 0) QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY frame_id) <= 20")
def _(f):
    return d.sample_every_n(f.det, 10, 20)


_PAIRS = """WITH p AS (SELECT a.video_id, a.frame_id, a.det_id det_a, b.det_id det_b, a.width*a.height area_a, b.width*b.height area_b,
  greatest(least(a.x+a.width,b.x+b.width)-greatest(a.x,b.x),0)*greatest(least(a.y+a.height,b.y+b.height)-greatest(a.y,b.y),0) common
  FROM det_dense a JOIN det_dense b ON a.video_id=b.video_id AND a.frame_id=b.frame_id AND a.det_id<b.det_id),
 pairs AS (SELECT *, common/(area_a+area_b-common) iou FROM p WHERE common/(area_a+area_b-common) > 0.35)"""


@query("j1_overlap_pairs", "det_dense", sql=_PAIRS + " SELECT frame_id, det_a, det_b, round(iou, 6) AS iou FROM pairs")
def _(f):
    return d.overlap_pairs(f.det_dense, 0.35, digits=6, areas=False).select("frame_id", "det_a", "det_b", "iou")


@query("j1_overlap_pairs_blocked", "det_dense", sql=_PAIRS + " SELECT frame_id, det_a, det_b, round(iou, 6) AS iou FROM pairs")
def _(f):
    return d.overlap_pairs(f.det_dense, 0.35, cell=25.0, digits=6, areas=False).select("frame_id", "det_a", "det_b", "iou")


@query("j1_overlap_pairs_unblocked", "det_dense", sql=_PAIRS + " SELECT frame_id, det_a, det_b, round(iou, 6) AS iou FROM pairs")
def _(f):
    return d.overlap_pairs(f.det_dense, 0.35, cell=None, digits=6, areas=False).select("frame_id", "det_a", "det_b", "iou")


@query("j2_suppress_dominance", "det_dense", sql=_PAIRS + " SELECT det_id FROM det_dense WHERE det_id NOT IN (SELECT CASE WHEN area_b > area_a THEN det_a ELSE det_b END FROM pairs)")
def _(f):
    return d.suppress_overlaps(f.det_dense, 0.35).select("det_id")


#: Steps of the scan of each frame: ``i`` scans with box ``h`` from ``h`` on; the first larger box carries it on, smaller ones before that are gone.
_GREEDY = _PAIRS.replace("WITH ", "WITH RECURSIVE ", 1) + """, adj AS (SELECT frame_id, det_a h, area_a ah, {'j': det_b, 'a': area_b} s FROM pairs UNION ALL SELECT frame_id, det_b, area_b, {'j': det_a, 'a': area_a} FROM pairs),
  near AS (SELECT frame_id, h, any_value(ah) ah, list(s) js FROM adj GROUP BY 1, 2), ids AS (SELECT frame_id, list(h) ids FROM near GROUP BY 1),
  r AS (SELECT frame_id, list_min(ids) i, list_min(ids) h, []::BIGINT[] gone FROM ids
   UNION ALL SELECT frame_id, CASE WHEN c IS NULL THEN list_min(list_filter(ids, lambda x: x > i AND NOT list_contains(after, x))) ELSE i END,
     CASE WHEN c IS NULL THEN list_min(list_filter(ids, lambda x: x > i AND NOT list_contains(after, x))) ELSE c END, after
   FROM (SELECT frame_id, ids, i, c, list_concat(gone, list_concat(list_transform(list_filter(cand, lambda s: c IS NULL OR s.j < c), lambda s: s.j), CASE WHEN c IS NULL THEN [] ELSE [i] END)) AS after
    FROM (SELECT *, list_min(list_transform(list_filter(cand, lambda s: s.a > ah), lambda s: s.j)) c
     FROM (SELECT r.*, ids, ah, list_filter(js, lambda s: s.j > r.h AND NOT list_contains(r.gone, s.j)) cand FROM r JOIN near ON near.frame_id = r.frame_id AND near.h = r.h JOIN ids ON ids.frame_id = r.frame_id)))),
  dead AS (SELECT DISTINCT unnest(gone) AS det_id FROM r WHERE i IS NULL)"""


@query("j2_suppress_greedy", "det_dense", sql=_GREEDY + " SELECT det_id FROM det_dense WHERE det_id NOT IN (SELECT det_id FROM dead)")
def _(f):
    return d.suppress_overlaps(f.det_dense, 0.35, mode="greedy").select("det_id")


#: One step of the area limit for each box of a cell in turn; ``m`` are the last areas as adjusted.
_STEADY = """WITH RECURSIVE o AS (SELECT *, floor((x+width/2)/500) gx, floor((y+height/2)/500) gy FROM det), k AS (SELECT *, row_number() OVER (PARTITION BY video_id, gx, gy ORDER BY frame_id, det_id) k FROM o),
  r(video_id, gx, gy, k, det_id, x, y, width, height, m) AS (SELECT DISTINCT video_id, gx, gy, 0::BIGINT, 0::BIGINT, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, []::DOUBLE[] FROM k
   UNION ALL SELECT video_id, gx, gy, k, det_id, x+(width-width*s)/2, y+(height-height*s)/2, width*s, height*s, list_concat(m, [width*s*height*s])[-5:]
    FROM (SELECT k.*, r.m, CASE WHEN len(r.m) > 0 AND k.width*k.height/list_avg(r.m) > 2.5 THEN sqrt(list_avg(r.m)/(k.width*k.height)) ELSE 1.0 END s FROM r JOIN k ON k.video_id=r.video_id AND k.gx=r.gx AND k.gy=r.gy AND k.k=r.k+1))"""


@query("w9_constrain_area", "det", sql=_STEADY + " SELECT det_id, round(x, 6) AS x, round(y, 6) AS y, round(width, 6) AS width, round(height, 6) AS height FROM r WHERE k > 0")
def _(f):
    return rounded(d.constrain_area(f.det).select("det_id", "x", "y", "width", "height"))


@query("j9_detections_by_frame", "det", sql="SELECT video_id, frame_id, count(*) AS boxes, min(track_id) AS first_track FROM det GROUP BY 1, 2")
def _(f):
    return d.detections_by_frame(f.det).select("video_id", "frame_id", F.size("boxes").cast("bigint").alias("boxes"), F.element_at("boxes", 1)["track_id"].alias("first_track"))


@query("j12_link_detections", "det_dense", sql="""WITH p AS (SELECT a.frame_id + 1 frame_id, a.det_id det_a, b.det_id det_b, a.width*a.height+b.width*b.height both_,
  greatest(least(a.x+a.width,b.x+b.width)-greatest(a.x,b.x),0)*greatest(least(a.y+a.height,b.y+b.height)-greatest(a.y,b.y),0) common
  FROM det_dense a JOIN det_dense b ON a.video_id=b.video_id AND a.frame_id+1=b.frame_id),
 q AS (SELECT *, common/(both_-common) iou FROM p WHERE common/(both_-common) >= 0.25),
 r AS (SELECT *, row_number() OVER (PARTITION BY frame_id, det_a ORDER BY iou DESC, det_b) ra, row_number() OVER (PARTITION BY frame_id, det_b ORDER BY iou DESC, det_a) rb FROM q)
 SELECT frame_id, det_a, det_b, round(iou, 6) AS iou FROM r WHERE ra = 1 AND rb = 1""")
def _(f):
    return rounded(linking.link_detections(f.det_dense).select("frame_id", "det_a", "det_b", "iou"))


def _links(name: str, a: str, b: str) -> str:
    """Mutually best overlaps of boxes in ``a`` and boxes of the next frame in ``b``."""
    return f"""{name}_p AS (SELECT a.video_id, a.frame_id + 1 frame_id, a.det_id det_a, b.det_id det_b, a.width*a.height+b.width*b.height both_,
   greatest(least(a.x+a.width,b.x+b.width)-greatest(a.x,b.x),0)*greatest(least(a.y+a.height,b.y+b.height)-greatest(a.y,b.y),0) common FROM {a} a JOIN {b} b ON a.video_id=b.video_id AND a.frame_id+1=b.frame_id),
  {name}_q AS (SELECT *, common/(both_-common) iou FROM {name}_p WHERE common/(both_-common) >= 0.25),
  {name} AS (SELECT * FROM {name}_q QUALIFY row_number() OVER (PARTITION BY video_id, frame_id, det_a ORDER BY iou DESC, det_b) = 1 AND row_number() OVER (PARTITION BY video_id, frame_id, det_b ORDER BY iou DESC, det_a) = 1)"""


_CHAINS = f"""WITH RECURSIVE sure AS (SELECT * FROM det_dense WHERE confidence >= 0.25), weak AS (SELECT * FROM det_dense WHERE confidence >= 0.1 AND confidence < 0.25), {_links('l1', 'sure', 'sure')},
  rest AS (SELECT * FROM sure WHERE det_id NOT IN (SELECT det_a FROM l1) UNION ALL SELECT * FROM weak), {_links('l2', 'rest', 'rest')},
  link AS (SELECT det_a, det_b FROM l1 UNION ALL SELECT det_a, det_b FROM l2 WHERE det_b NOT IN (SELECT det_b FROM l1) AND det_b IN (SELECT det_id FROM weak)),
  chain(det_id, root) AS (SELECT det_id, det_id FROM det_dense WHERE confidence >= 0.25 AND det_id NOT IN (SELECT det_b FROM link) UNION ALL SELECT det_b, root FROM chain JOIN link ON det_a = det_id)"""


@query("w13_assign_track_ids", "det_dense", sql=_CHAINS + " SELECT det_id, root AS track_id FROM chain")
def _(f):
    return linking.assign_track_ids(f.det_dense).select("det_id", "track_id")


@query("s6_to_flat", "det", sql="SELECT video_id, track_id, det_id, frame_id, x+width/2 AS center_x, y+height/2 AS center_y FROM det")
def _(f):
    return tracks.to_flat(tracks.to_nested(f.det)).select("video_id", "track_id", "det_id", "frame_id", "center_x", "center_y")


@query("a1_track_summary", "det", sql=DET_TRACKS + "SELECT video_id, track_id, num_detections, first_frame, last_frame, round(total_distance, 4) AS total_distance, first_x, first_y, last_x, last_y, round(displacement, 4) AS displacement FROM tracks")
def _(f):
    return rounded(tracks.track_summary(f.det), 4)


@query("a2_store_stats", "det", sql="WITH t AS (SELECT video_id, track_id, count(*) n FROM det GROUP BY 1, 2) SELECT video_id, count(*) AS num_tracks, CAST(sum(n) AS BIGINT) AS num_detections, round(avg(n), 6) AS mean_detections FROM t GROUP BY 1")
def _(f):
    return rounded(tracks.store_stats(f.det))


@query("a3_dataset_stats", "det", sql="""WITH t AS (SELECT video_id, count(DISTINCT track_id) k, count(*) n FROM det GROUP BY 1)
  SELECT count(*) AS num_videos, CAST(sum(k) AS BIGINT) AS num_tracks, CAST(sum(n) AS BIGINT) AS num_detections, round(avg(k), 6) AS tracks_per_video FROM t""")
def _(f):
    return rounded(tracks.dataset_stats(f.det))


@query("a3_dataset_rollup", "det", sql="WITH t AS (SELECT video_id, track_id, count(*) n FROM det GROUP BY 1, 2) SELECT video_id, count(*) AS num_tracks, CAST(sum(n) AS BIGINT) AS num_detections FROM t GROUP BY ROLLUP (video_id)")
def _(f):
    return tracks.dataset_rollup(f.det)


@query("a4_funnel_stats", "det", sql=f"""WITH a AS (SELECT video_id, count(*) AS raw, count(DISTINCT frame_id) frames, count(*) FILTER ({_KEEP}) AS filtered FROM det GROUP BY 1)
  SELECT video_id, raw, filtered, round(filtered/raw, 6) AS filter_ratio, round(filtered/frames, 6) AS per_frame FROM a""")
def _(f):
    return rounded(tracks.funnel_stats(f.det, d.filter_detections(f.det)))


@query("a6_field_position", "det", sql=DET_TRACKS + """, v AS (SELECT *, last_x-first_x dx, last_y-first_y dy, num_detections < 2 one FROM tracks)
  SELECT video_id, track_id, round(CASE WHEN one THEN 0.5 ELSE first_x/1920 END, 6) AS start_x, round(CASE WHEN one THEN 0.5 ELSE first_y/984 END, 6) AS start_y,
   round(CASE WHEN one THEN 0.5 ELSE last_x/1920 END, 6) AS end_x, round(CASE WHEN one THEN 0.5 ELSE last_y/984 END, 6) AS end_y, dx, dy,
   CASE WHEN one THEN 'unknown' WHEN abs(dx) >= abs(dy) THEN 'vertical' ELSE 'horizontal' END AS direction_by_length,
   CASE WHEN one THEN 'unknown' WHEN abs(dy) >= abs(dx) THEN 'vertical' ELSE 'horizontal' END AS direction_by_picture FROM v""")
def _(f):
    return rounded(tracks.field_position(f.det))


@query("w1_velocities", "det1", sql="""WITH s AS (SELECT *, (frame_id - lag(frame_id) OVER w)/30.0::DOUBLE dt, x+width/2 - lag(x+width/2) OVER w dx, y+height/2 - lag(y+height/2) OVER w dy FROM det1
   WINDOW w AS (PARTITION BY video_id, track_id ORDER BY frame_id, det_id))
  SELECT det_id, round(dx/dt, 4) + 0.0 AS vx, round(dy/dt, 4) + 0.0 AS vy, round(sqrt((dx/dt)*(dx/dt)+(dy/dt)*(dy/dt)), 4) AS speed FROM s WHERE dt > 0""")
def _(f):
    return rounded(tracks.velocities(f.det1).select("det_id", "vx", "vy", "speed"), 4)


@query("w2_top_speed", "det1", sql="""WITH s AS (SELECT *, (frame_id - lag(frame_id) OVER w)/30.0::DOUBLE dt, x+width/2 - lag(x+width/2) OVER w dx, y+height/2 - lag(y+height/2) OVER w dy FROM det1
   WINDOW w AS (PARTITION BY video_id, track_id ORDER BY frame_id, det_id))
  SELECT video_id, track_id, round(max(sqrt((dx/dt)*(dx/dt)+(dy/dt)*(dy/dt))), 4) AS top_speed FROM s WHERE dt > 0 GROUP BY 1, 2""")
def _(f):
    return rounded(tracks.velocities(f.det1).groupBy("video_id", "track_id").agg(F.max("speed").alias("top_speed")), 4)


@query("w3_arc_length", "det", sql="""WITH s AS (SELECT *, coalesce(sqrt(pow(x+width/2 - lag(x+width/2) OVER w, 2) + pow(y+height/2 - lag(y+height/2) OVER w, 2)), 0.0) step FROM det
   WINDOW w AS (PARTITION BY video_id, track_id ORDER BY frame_id, det_id)),
  r AS (SELECT det_id, sum(step) OVER (PARTITION BY video_id, track_id ORDER BY frame_id, det_id ROWS UNBOUNDED PRECEDING) arc, sum(step) OVER (PARTITION BY video_id, track_id) whole FROM s)
  SELECT det_id, round(arc, 4) AS arc, round(CASE WHEN whole > 0 THEN arc/whole ELSE 0 END, 4) AS arc_share FROM r""")
def _(f):
    return rounded(tracks.arc_length(f.det).select("det_id", "arc", "arc_share"), 4)


@query("w4_first_n_frames", "det", sql="SELECT det_id FROM det QUALIFY row_number() OVER (PARTITION BY video_id, track_id ORDER BY frame_id, det_id) <= 15")
def _(f):
    return tracks.first_n(f.det, 15).select("det_id")


@query("w5_fill_gaps", "det1", sql="""WITH s AS (SELECT *, lead(frame_id) OVER w nf, lead(x) OVER w nx, lead(y) OVER w ny, lead(width) OVER w nw, lead(height) OVER w nh FROM det1
   WINDOW w AS (PARTITION BY video_id, track_id ORDER BY frame_id, det_id)),
  g AS (SELECT *, nf-frame_id gap, unnest(range(1, nf-frame_id)) k FROM s WHERE nf-frame_id BETWEEN 2 AND 30)
  SELECT video_id, track_id, det_id, frame_id, x, y, width, height, confidence FROM det1
  UNION ALL SELECT video_id, track_id, NULL, frame_id+k, round(x+(nx-x)*(k/gap), 6), round(y+(ny-y)*(k/gap), 6), round(width+(nw-width)*(k/gap), 6), round(height+(nh-height)*(k/gap), 6), 0.0 FROM g""")
def _(f):
    return rounded(tracks.fill_gaps(f.det1, 30))


@query("w6_track_history", "det", sql="""SELECT det_id, min(frame_id) OVER (PARTITION BY video_id, track_id) AS first_seen,
   count(*) OVER w AS points, round(avg(x+width/2) OVER w, 4) AS mean_x FROM det WINDOW w AS (PARTITION BY video_id, track_id ORDER BY frame_id, det_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""")
def _(f):
    rows = tracks.track_history(f.det)
    mean = F.aggregate("history", F.lit(0.0), lambda s, p: s + p["x"]) / F.size("history")
    return rounded(rows.select("det_id", "first_seen", F.size("history").cast("bigint").alias("points"), mean.alias("mean_x")), 4)


@query("p2_flip_x", "det", sql="SELECT det_id, 1920 - x - width AS x FROM det")
def _(f):
    return tracks.flip_x(f.det).select("det_id", "x")


_H = (1.02, 0.03, -5.0, -0.01, 0.98, 12.0, 0.00001, 0.00002, 1.0)


@query("p3_apply_homography", "det", sql="""WITH c AS (SELECT *, x+width/2 cx, y+height/2 cy FROM det),
  h AS (SELECT *, 1.02::DOUBLE*cx+0.03::DOUBLE*cy-5.0 u, -0.01::DOUBLE*cx+0.98::DOUBLE*cy+12.0 v, 0.00001::DOUBLE*cx+0.00002::DOUBLE*cy+1.0 w FROM c)
  SELECT det_id, round(u/w - width/2, 4) AS x, round(v/w - height/2, 4) AS y FROM h""")
def _(f):
    return rounded(field.apply_homography(f.det, _H).select("det_id", "x", "y"), 4)


@query("p4_transform_envelope", "det", sql="""WITH c AS (SELECT det_id, 0.9::DOUBLE*x-0.2::DOUBLE*y+3 x1, 0.2::DOUBLE*x+0.9::DOUBLE*y-2 y1, width w, height h FROM det),
  e AS (SELECT det_id, least(x1, x1+0.9*w, x1-0.2*h, x1+0.9*w-0.2*h) lx, greatest(x1, x1+0.9*w, x1-0.2*h, x1+0.9*w-0.2*h) hx, least(y1, y1+0.2*w, y1+0.9*h, y1+0.2*w+0.9*h) ly, greatest(y1, y1+0.2*w, y1+0.9*h, y1+0.2*w+0.9*h) hy FROM c)
  SELECT det_id, round(lx, 4) AS x, round(ly, 4) AS y, round(hx-lx, 4) AS width, round(hy-ly, 4) AS height FROM e""")
def _(f):
    rows = f.det.withColumns({"a": F.lit(0.9), "b": F.lit(0.2), "tx": F.lit(3.0), "ty": F.lit(-2.0)})
    return rounded(motion.transform_envelope(rows).select("det_id", "x", "y", "width", "height"), 4)


@query("p5_rotate_about_center", "det", sql="""WITH c AS (SELECT *, x+width/2-960 cx, y+height/2-492 cy, radians(7.5) a FROM det)
  SELECT det_id, round(cos(a)*cx - sin(a)*cy + 960 - width/2, 4) AS x, round(sin(a)*cx + cos(a)*cy + 492 - height/2, 4) AS y FROM c""")
def _(f):
    return rounded(field.rotate_about_center(f.det, F.lit(7.5), 1920.0, 984.0).select("det_id", "x", "y"), 4)


@query("j3_near_pairs", "frag", sql="""WITH big AS (SELECT *, x+width/2 cx, y+height/2 cy FROM frag QUALIFY count(*) OVER (PARTITION BY video_id, track_id) >= 2),
  e AS (SELECT video_id, track_id, min(frame_id) sf, max(frame_id) ef, arg_min(cx, frame_id*1000000+det_id) sx, arg_min(cy, frame_id*1000000+det_id) sy, arg_max(cx, frame_id*1000000+det_id) ex, arg_max(cy, frame_id*1000000+det_id) ey FROM big GROUP BY 1, 2)
  SELECT a.video_id, a.track_id AS a_track_id, b.track_id AS b_track_id, b.sf-a.ef AS gap, round(sqrt((b.sx-a.ex)*(b.sx-a.ex)+(b.sy-a.ey)*(b.sy-a.ey)), 4) AS distance
  FROM e a JOIN e b ON a.video_id=b.video_id AND b.sf > a.ef AND b.sf-a.ef <= 200 AND sqrt((b.sx-a.ex)*(b.sx-a.ex)+(b.sy-a.ey)*(b.sy-a.ey)) <= 150""")
def _(f):
    cfg = MergeConfig(min_points=2, max_gap=200)
    ends = merge.endpoint_features(merge.long_tracks(f.frag, cfg.min_points))
    return rounded(merge.near_pairs(ends, cfg).select("video_id", "a_track_id", "b_track_id", "gap", "distance"), 4)


_MERGE = MergeConfig(min_points=2, max_gap=200, crowd_limit=25)
_CAND = """WITH big AS (SELECT *, x+width/2 cx, y+height/2 cy, width*height a, row_number() OVER (PARTITION BY video_id, track_id ORDER BY frame_id, det_id) i, row_number() OVER (PARTITION BY video_id, track_id ORDER BY frame_id DESC, det_id DESC) j FROM frag QUALIFY count(*) OVER (PARTITION BY video_id, track_id) >= 2),
  e AS (SELECT video_id, track_id, min(frame_id) sf, max(frame_id) ef, max(CASE WHEN i=1 THEN cx END) sx, max(CASE WHEN i=1 THEN cy END) sy, max(CASE WHEN j=1 THEN cx END) ex, max(CASE WHEN j=1 THEN cy END) ey,
    max(CASE WHEN i=2 THEN cx END)-max(CASE WHEN i=1 THEN cx END) sdx, max(CASE WHEN i=2 THEN cy END)-max(CASE WHEN i=1 THEN cy END) sdy, max(CASE WHEN j=1 THEN cx END)-max(CASE WHEN j=2 THEN cx END) edx, max(CASE WHEN j=1 THEN cy END)-max(CASE WHEN j=2 THEN cy END) edy,
    avg(CASE WHEN i<=3 THEN a END) sa, avg(CASE WHEN j<=3 THEN a END) ea FROM big GROUP BY 1, 2),
  p AS (SELECT a.video_id, a.track_id ta, b.track_id tb, b.sf-a.ef gap, sqrt((b.sx-a.ex)*(b.sx-a.ex)+(b.sy-a.ey)*(b.sy-a.ey)) dist, (a.ex+b.sx)/2 mx, (a.ey+b.sy)/2 my,
    sqrt(a.edx*a.edx+a.edy*a.edy) ma, sqrt(b.sdx*b.sdx+b.sdy*b.sdy) mb, a.edx*b.sdx+a.edy*b.sdy dot, a.ea ea, b.sa sa
    FROM e a JOIN e b ON a.video_id=b.video_id AND b.sf > a.ef AND b.sf-a.ef <= 200 AND sqrt((b.sx-a.ex)*(b.sx-a.ex)+(b.sy-a.ey)*(b.sy-a.ey)) <= 150),
  pts AS (SELECT video_id, sx x, sy y FROM e UNION ALL SELECT video_id, ex, ey FROM e),
  crowd AS (SELECT p.video_id, ta, tb, count(*) nearby FROM p JOIN pts ON p.video_id=pts.video_id AND sqrt((mx-x)*(mx-x)+(my-y)*(my-y)) <= 200 GROUP BY 1, 2, 3),
  s AS (SELECT p.*, CASE WHEN ma < 1e-6 OR mb < 1e-6 THEN 0.5 ELSE (dot/(ma*mb)+1)/2 END ds, CASE WHEN ea < 1e-6 THEN 0.5 ELSE least(ea,sa)/greatest(ea,sa) END ss FROM p),
  c AS (SELECT s.*, 0.4*(1-dist/150)+0.3*(1-gap/200)+0.3*ds+0.3*ss score FROM s JOIN crowd USING (video_id, ta, tb) WHERE nearby <= 25)"""


@query("j4_crowded_pairs", "frag", sql=_CAND + " SELECT video_id, ta AS a_track_id, tb AS b_track_id, nearby FROM crowd WHERE nearby > 25")
def _(f):
    ends = materialize(merge.endpoint_features(merge.long_tracks(f.frag, 2)), "merge-ends")
    return crowds.crowded_near_pairs(ends, _MERGE)


@query("w10_endpoint_features", "frag", sql=_CAND + " SELECT video_id, track_id, sf AS start_frame, ef AS end_frame, sx AS start_x, ey AS end_y, sdx AS start_dx, edy AS end_dy, round(sa, 4) AS start_area, round(ea, 4) AS end_area FROM e")
def _(f):
    ends = merge.endpoint_features(merge.long_tracks(f.frag, 2))
    return rounded(ends.select("video_id", "track_id", "start_frame", "end_frame", "start_x", "end_y", "start_dx", "end_dy", "start_area", "end_area"), 4)


@query("w11_score_candidates", "frag", sql=_CAND + " SELECT video_id, ta AS a_track_id, tb AS b_track_id, gap, round(ds, 4) AS direction_score, round(ss, 4) AS size_score, round(score, 4) AS score FROM c WHERE score >= 0.25")
def _(f):
    return rounded(merge.merge_candidates(f.frag, _MERGE).select("video_id", "a_track_id", "b_track_id", "gap", "direction_score", "size_score", "score"), 4)


@query("k3_best_candidates", "frag", sql=_CAND + " SELECT video_id, ta AS a_track_id, tb AS b_track_id, round(score, 4) AS score FROM c WHERE score >= 0.25 QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY score DESC, ta, tb) <= 5")
def _(f):
    from pyspark.sql import Window

    c = merge.merge_candidates(f.frag, _MERGE)
    w = Window.partitionBy("video_id").orderBy(F.desc("score"), "a_track_id", "b_track_id")
    return rounded(c.withColumn("k", F.row_number().over(w)).where("k <= 5").select("video_id", "a_track_id", "b_track_id", "score"), 4)


#: Candidates in order; a pair is accepted if neither track has two accepted pairs.
_CAPPED = _CAND.replace("WITH ", "WITH RECURSIVE ", 1) + """, cand AS (SELECT c.video_id, c.ta, c.tb, row_number() OVER (PARTITION BY c.video_id ORDER BY a.sf, c.ta, b.sf, c.tb) k FROM c JOIN e a ON a.video_id=c.video_id AND a.track_id=c.ta JOIN e b ON b.video_id=c.video_id AND b.track_id=c.tb WHERE score >= 0.25),
  cap(video_id, k, ta, tb, used, good) AS (SELECT DISTINCT video_id, 0::BIGINT, 0::BIGINT, 0::BIGINT, []::BIGINT[], false FROM cand
   UNION ALL SELECT video_id, k, ta, tb, CASE WHEN good THEN list_concat(used, [ta, tb]) ELSE used END, good
    FROM (SELECT cand.*, cap.used, len(list_filter(cap.used, lambda t: t = cand.ta)) < 2 AND len(list_filter(cap.used, lambda t: t = cand.tb)) < 2 AS good FROM cap JOIN cand ON cand.video_id=cap.video_id AND cand.k=cap.k+1)),
  took AS (SELECT video_id, ta, tb FROM cap WHERE good),
  edge AS (SELECT video_id, ta s, tb t FROM took UNION SELECT video_id, tb, ta FROM took),
  reach(video_id, s, t) AS (SELECT video_id, s, s FROM edge UNION SELECT reach.video_id, reach.s, edge.t FROM reach JOIN edge ON edge.video_id=reach.video_id AND edge.s=reach.t),
  grp AS (SELECT video_id, s AS track_id, min(t) AS group_id FROM reach GROUP BY 1, 2)"""


@query("w12_cap_merges", "frag", sql=_CAPPED + " SELECT video_id, ta AS a_track_id, tb AS b_track_id FROM took")
def _(f):
    return merge.cap_merges(merge.merge_candidates(f.frag, _MERGE), 2).select("video_id", "a_track_id", "b_track_id")


@query("a25_merge_groups", "frag", sql=_CAPPED + " SELECT video_id, track_id, group_id FROM grp")
def _(f):
    return merge.merge_groups(merge.cap_merges(merge.merge_candidates(f.frag, _MERGE), 2))


@query("a26_apply_merge", "frag", sql=_CAPPED + """, size AS (SELECT video_id, track_id, count(*) n FROM frag GROUP BY 1, 2), top AS (SELECT video_id, max(track_id) top FROM frag WHERE video_id IN (SELECT video_id FROM grp) GROUP BY 1),
  fresh AS (SELECT video_id, track_id, top + row_number() OVER (PARTITION BY video_id ORDER BY track_id) AS new_id FROM size JOIN top USING (video_id) WHERE n < {short})
  SELECT video_id, coalesce(group_id, new_id, track_id) AS track_id, sum(n)::BIGINT AS n, count(*) AS parts FROM size LEFT JOIN grp USING (video_id, track_id) LEFT JOIN fresh USING (video_id, track_id) GROUP BY 1, 2""".replace("{short}", str(_MERGE.min_points)))
def _(f):
    return merge.merge_tracks(f.frag, _MERGE).groupBy("video_id", "track_id").agg(F.count("*").alias("n"), F.countDistinct("orig_track_id").alias("parts"))


_ANGLES = """WITH g AS (SELECT *, degrees(atan2(y2-y1, x2-x1)) t FROM segments WHERE sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)) >= 450),
  h AS (SELECT *, CASE WHEN t < 0 THEN t+180 WHEN t >= 180 THEN t-180 ELSE t END u FROM g),
  b AS (SELECT video_id, line_id, CAST(round_even((CASE WHEN u >= 90 THEN 180-u ELSE u END)/5, 0)*5 AS BIGINT) bin FROM h),
  hist AS (SELECT video_id, bin, count(*) AS lines, min(line_id) AS first_line FROM b GROUP BY 1, 2)"""


@query("a7_line_angle_histogram", "segments", sql=_ANGLES + " SELECT * FROM hist")
def _(f):
    return field.line_angle_histogram(f.segments)


_DOMINANT = _ANGLES + """, t AS (SELECT video_id, CAST(sum(lines) AS BIGINT) AS lines, first(bin ORDER BY lines DESC, first_line) top, sum(CASE WHEN bin BETWEEN 65 AND 90 THEN bin*lines END) s, sum(CASE WHEN bin BETWEEN 65 AND 90 THEN lines END) n, max(CASE WHEN bin BETWEEN 65 AND 90 THEN lines END) most FROM hist GROUP BY 1),
  a AS (SELECT *, CASE WHEN top = 0 AND most >= 2 THEN s/n ELSE top::DOUBLE END ang FROM t),
  orientation AS (SELECT video_id, lines, ang AS line_angle, lines >= 2 AND ang > 0 AND ang <= 40 AS valid, CASE WHEN lines >= 2 AND ang > 0 AND ang <= 40 THEN ang ELSE 0 END AS rotation,
    CASE WHEN lines >= 2 AND ang > 0 AND ang <= 40 THEN least(1.0, lines/20.0)::DOUBLE ELSE 0 END AS confidence FROM a)"""


@query("a8_dominant_angle", "segments", sql=_DOMINANT + " SELECT video_id, lines, round(line_angle, 6) AS line_angle, valid, round(rotation, 6) AS rotation, round(confidence, 6) AS confidence FROM orientation")
def _(f):
    return rounded(field.dominant_angle(f.segments))


@query("j8_rotate_field", "segments", "det", sql=_DOMINANT + """, c AS (SELECT det_id, width, height, x+width/2-960 cx, y+height/2-492 cy, radians(coalesce(rotation, 0.0)) a FROM det LEFT JOIN orientation USING (video_id))
  SELECT det_id, round(cos(a)*cx - sin(a)*cy + 960 - width/2, 4) + 0.0 AS x, round(sin(a)*cx + cos(a)*cy + 492 - height/2, 4) + 0.0 AS y FROM c""")
def _(f):
    return rounded(field.rotate_field(f.det, field.dominant_angle(f.segments)).select("det_id", "x", "y"), 4)


def _fit_sql(name: str, points: str) -> str:
    return f"""{name}_s AS (SELECT video_id, frame_id, count(*)::DOUBLE n, sum(px) sx, sum(py) sy, sum(cx) su, sum(cy) sv, sum(px*px+py*py) ss, sum(px*cx+py*cy) sd, sum(px*cy-py*cx) sc FROM {points} GROUP BY 1, 2),
  {name}_t AS (SELECT *, ss-(sx*sx+sy*sy)/n w FROM {name}_s), {name}_u AS (SELECT *, CASE WHEN w > 0 THEN (sd-(sx*su+sy*sv)/n)/w END a, CASE WHEN w > 0 THEN (sc-(sx*sv-sy*su)/n)/w END b FROM {name}_t),
  {name} AS (SELECT video_id, frame_id, n, a, b, (su-a*sx+b*sy)/n tx, (sv-b*sx-a*sy)/n ty FROM {name}_u)"""


def _error_sql(name: str, fit: str) -> str:
    return f"{name} AS (SELECT m.*, sqrt(pow(cx-(a*px-b*py+tx), 2)+pow(cy-(b*px+a*py+ty), 2)) error FROM matches m JOIN {fit} USING (video_id, frame_id))"


_MOTION_FIT = ", ".join(
    ["WITH " + _fit_sql("f0", "matches")]
    + [
        f"{_error_sql(f'e{k}', f'f{k}')}, m{k} AS (SELECT video_id, frame_id, quantile_cont(error, 0.5) middle FROM e{k} GROUP BY 1, 2), p{k} AS (SELECT e{k}.* FROM e{k} JOIN m{k} USING (video_id, frame_id) WHERE error <= greatest(middle, 3.0)), {_fit_sql(f'f{k + 1}', f'p{k}')}"
        for k in range(3)
    ]
    + [_error_sql("last", "f3"), "good AS (SELECT * FROM last WHERE error <= 3.0)", _fit_sql("g", "good")]
) + """, c AS (SELECT video_id, frame_id, count(*) points FROM matches GROUP BY 1, 2), v AS (SELECT c.*, coalesce(n, 0)::BIGINT inliers, tx, ty, sqrt(a*a+b*b) s, atan2(b, a) th FROM c LEFT JOIN g USING (video_id, frame_id)),
  o AS (SELECT *, coalesce(points >= 6 AND inliers >= 2 AND inliers/points >= 0.4 AND s BETWEEN 0.9 AND 1.1 AND sqrt(tx*tx+ty*ty) <= 100, false) ok FROM v)"""


@query("a9_fit_frame_motion", "matches", sql=_MOTION_FIT + """ SELECT video_id, frame_id, points, inliers, ok, round(CASE WHEN ok THEN tx ELSE 0 END, 4) + 0.0 AS dx, round(CASE WHEN ok THEN ty ELSE 0 END, 4) + 0.0 AS dy, round(CASE WHEN ok THEN th ELSE 0 END, 4) + 0.0 AS theta, round(ln(CASE WHEN ok THEN s ELSE 1 END), 4) + 0.0 AS log_s FROM o""")
def _(f):
    return rounded(motion.fit_frame_motion(f.matches), 4)


#: A made-up motion of each frame, so that the windows after the fit have an exact SQL form.
_MOTION = """WITH f AS (SELECT DISTINCT video_id, frame_id FROM matches),
  m AS (SELECT video_id, frame_id, (frame_id*7 % 11 - 5)*CASE WHEN frame_id % 4 = 0 THEN 0.1 ELSE 1.0 END::DOUBLE AS dx, (frame_id*5 % 7 - 3)*CASE WHEN frame_id % 4 = 0 THEN 0.1 ELSE 1.0 END::DOUBLE AS dy,
    CASE WHEN frame_id % 4 = 0 THEN 0.0 ELSE (frame_id*3 % 5 - 2)*0.01 END::DOUBLE AS theta, CASE WHEN frame_id % 4 = 0 THEN 0.0 ELSE (frame_id % 3 - 1)*0.005 END::DOUBLE AS log_s FROM f)"""


def _made_motion(f):
    still = "CASE WHEN frame_id % 4 = 0 THEN 0.1D ELSE 1D END"
    return f.matches.select("video_id", "frame_id").distinct().selectExpr(
        "video_id", "frame_id", f"(frame_id*7 % 11 - 5)*{still} AS dx", f"(frame_id*5 % 7 - 3)*{still} AS dy",
        "CASE WHEN frame_id % 4 = 0 THEN 0D ELSE (frame_id*3 % 5 - 2)*0.01D END AS theta", "CASE WHEN frame_id % 4 = 0 THEN 0D ELSE (frame_id % 3 - 1)*0.005D END AS log_s",
    )


@query("a5_motion_stats", "matches", sql=_MOTION + " SELECT video_id, round(sum(sqrt(dx*dx+dy*dy)), 4) AS total_motion, round(CASE WHEN count(*) > 1 THEN sum(sqrt(dx*dx+dy*dy))/(count(*)-1) ELSE 0 END, 4) AS mean_motion FROM m GROUP BY 1")
def _(f):
    return rounded(motion.motion_stats(_made_motion(f)), 4)


@query("w7_smooth_motion", "matches", sql=_MOTION + """, t AS (SELECT *, sqrt(dx*dx+dy*dy) < 1 AND abs(exp(log_s)-1) < 0.002 AND abs(theta) < 0.002 still FROM m),
  s AS (SELECT video_id, frame_id, avg(dx) OVER w dx, avg(dy) OVER w dy, atan2(avg(sin(theta)) OVER w, avg(cos(theta)) OVER w) theta, avg(log_s) OVER w log_s FROM t WHERE NOT still WINDOW w AS (PARTITION BY video_id ORDER BY frame_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
  SELECT video_id, frame_id, round(dx, 6) + 0.0 AS dx, round(dy, 6) + 0.0 AS dy, round(theta, 6) + 0.0 AS theta, round(log_s, 6) + 0.0 AS log_s FROM s UNION ALL SELECT video_id, frame_id, 0.0, 0.0, 0.0, 0.0 FROM t WHERE still""")
def _(f):
    return rounded(motion.smooth_motion(_made_motion(f)))


_CUM = _MOTION + """, r AS (SELECT *, sum(log_s) OVER w l, sum(theta) OVER w p FROM m WINDOW w AS (PARTITION BY video_id ORDER BY frame_id ROWS UNBOUNDED PRECEDING)),
  q AS (SELECT *, exp(-l)*(dx*cos(p)+dy*sin(p)) qx, exp(-l)*(dy*cos(p)-dx*sin(p)) qy FROM r),
  s AS (SELECT *, sum(qx) OVER w sx, sum(qy) OVER w sy FROM q WINDOW w AS (PARTITION BY video_id ORDER BY frame_id ROWS UNBOUNDED PRECEDING)),
  h AS (SELECT video_id, frame_id, exp(l)*cos(p) a, exp(l)*sin(p) b, exp(l)*(sx*cos(p)-sy*sin(p)) tx, exp(l)*(sx*sin(p)+sy*cos(p)) ty, exp(-l)*cos(p) ia, -exp(-l)*sin(p) ib, -sx itx, -sy ity FROM s)"""


@query("w8_cumulative_transform", "matches", sql=_CUM + " SELECT video_id, frame_id, round(a, 4) + 0.0 AS a, round(b, 4) + 0.0 AS b, round(tx, 4) + 0.0 AS tx, round(ty, 4) + 0.0 AS ty, round(ia, 4) + 0.0 AS inv_a, round(ib, 4) + 0.0 AS inv_b, round(itx, 4) + 0.0 AS inv_tx, round(ity, 4) + 0.0 AS inv_ty FROM h")
def _(f):
    return rounded(motion.cumulative_transform(_made_motion(f)), 4)


@query("j7_stabilize", "matches", "det", sql=_CUM + """, l AS (SELECT video_id, arg_max(ia, frame_id) la, arg_max(ib, frame_id) lb, arg_max(itx, frame_id) lx, arg_max(ity, frame_id) ly FROM h GROUP BY 1),
  j AS (SELECT det.det_id, x, y, width w, height hh, coalesce(ia, la, 1.0) a, coalesce(ib, lb, 0.0) b, coalesce(itx, lx, 0.0) tx, coalesce(ity, ly, 0.0) ty FROM det LEFT JOIN h USING (video_id, frame_id) LEFT JOIN l USING (video_id)),
  c AS (SELECT det_id, a*x-b*y+tx p1, b*x+a*y+ty q1, a*(x+w)-b*y+tx p2, b*(x+w)+a*y+ty q2, a*x-b*(y+hh)+tx p3, b*x+a*(y+hh)+ty q3, a*(x+w)-b*(y+hh)+tx p4, b*(x+w)+a*(y+hh)+ty q4 FROM j)
  SELECT det_id, round(least(p1,p2,p3,p4), 4) + 0.0 AS x, round(least(q1,q2,q3,q4), 4) + 0.0 AS y, round(greatest(p1,p2,p3,p4)-least(p1,p2,p3,p4), 4) AS width, round(greatest(q1,q2,q3,q4)-least(q1,q2,q3,q4), 4) AS height FROM c""")
def _(f):
    return rounded(motion.stabilize(f.det, motion.cumulative_transform(_made_motion(f))).select("det_id", "x", "y", "width", "height"), 4)


_LINE = DET_TRACKS + """, g AS (SELECT video_id, track_id, first_x x, lead(first_x) OVER (PARTITION BY video_id ORDER BY first_x, track_id) nx, row_number() OVER (PARTITION BY video_id ORDER BY first_x, track_id) k FROM tracks),
  b AS (SELECT video_id, count(*) n, max(x)-min(x) rng, first(x ORDER BY nx-x DESC NULLS LAST, k) x, first(nx ORDER BY nx-x DESC NULLS LAST, k) nx FROM g GROUP BY 1),
  los AS (SELECT video_id, CASE WHEN n < 4 THEN 960.0 ELSE (x+nx)/2 END AS x_value, CASE WHEN n < 4 THEN 0.0 WHEN rng > 0 THEN least((nx-x)/(rng*0.1), 1.0) ELSE 0.5 END AS confidence FROM b)"""


@query("a10_fit_los_clustering", "det", sql=_LINE + " SELECT video_id, round(x_value, 4) AS x_value, round(confidence, 4) AS confidence FROM los")
def _(f):
    return rounded(teams.fit_los(f.det, f.videos, "clustering").select("video_id", "x_value", "confidence"), 4)


@query("a11_fit_los_vertical", "det", sql=DET_TRACKS + " SELECT video_id, round(quantile_cont(first_x, 0.5), 4) AS x_value, 0.8::DOUBLE AS confidence FROM tracks GROUP BY 1")
def _(f):
    return rounded(teams.fit_los(f.det, f.videos, "vertical").select("video_id", "x_value", "confidence"), 4)


@query("a12_fit_los_minimal_movement", "det", sql="""WITH e AS (SELECT *, x+width/2 cx, y+height/2 cy FROM det QUALIFY row_number() OVER (PARTITION BY video_id, track_id ORDER BY frame_id, det_id) <= 15),
  st AS (SELECT video_id, track_id, avg(cx) x, avg(cy) y, var_pop(cx) v FROM e GROUP BY 1, 2 HAVING count(*) >= 3),
  r AS (SELECT *, count(*) OVER (PARTITION BY video_id) total, row_number() OVER (PARTITION BY video_id ORDER BY v, track_id) k FROM st),
  en AS (SELECT *, k <= least(12, greatest(6, total-4)) onl FROM r WHERE total >= 6),
  li AS (SELECT video_id, count(*) n, CASE WHEN stddev_pop(y) FILTER (onl) > 1 THEN regr_slope(x, y) FILTER (onl) ELSE 0 END slope, CASE WHEN stddev_pop(y) FILTER (onl) > 1 THEN regr_intercept(x, y) FILTER (onl) ELSE avg(x) FILTER (onl) END base,
    greatest(0.0, least(1.0, 1 - var_pop(x) FILTER (onl)/(var_pop(x)+1e-6))) confidence FROM en GROUP BY 1),
  o AS (SELECT en.video_id, x - slope*y - base AS off FROM en JOIN li USING (video_id) QUALIFY row_number() OVER (PARTITION BY en.video_id ORDER BY x - slope*y - base DESC, track_id) = 11),
  g AS (SELECT video_id, x, lead(x) OVER (PARTITION BY video_id ORDER BY x, track_id) nx, row_number() OVER (PARTITION BY video_id ORDER BY x, track_id) k FROM r WHERE total < 6),
  b AS (SELECT video_id, count(*) n, max(x)-min(x) rng, first(x ORDER BY nx-x DESC NULLS LAST, k) x, first(nx ORDER BY nx-x DESC NULLS LAST, k) nx FROM g GROUP BY 1),
  vids AS (SELECT DISTINCT video_id FROM det)
  SELECT video_id, round(slope, 4) + 0.0 AS slope, round(base + coalesce(off, 0), 3) AS intercept, round(confidence, 4) AS confidence FROM li LEFT JOIN o USING (video_id)
  UNION ALL SELECT video_id, 0.0, round(CASE WHEN coalesce(n, 0) < 2 THEN 960.0 ELSE (x+nx)/2 END, 3), round(CASE WHEN coalesce(n, 0) < 2 THEN 0.0 WHEN rng > 0 THEN least((nx-x)/(rng*0.1), 1.0) ELSE 0.5 END, 4) FROM vids LEFT JOIN b USING (video_id) WHERE video_id NOT IN (SELECT video_id FROM li)""")
def _(f):
    los = teams.fit_los(f.det, f.videos, "minimal_movement")
    return rounded(los.select("video_id", "slope", F.round("intercept", 3).alias("intercept"), "confidence"), 4)


_TEAMS = _LINE + ", t AS (SELECT tracks.*, los.x_value los_x, CASE WHEN first_x < los.x_value THEN 'offense' ELSE 'defense' END team FROM tracks JOIN los USING (video_id))"
_SKILL = _TEAMS + """, k AS (SELECT *, CASE WHEN num_detections < 30 THEN 'too short' WHEN last_x-first_x <= -50 THEN 'moved backward' WHEN last_x-first_x > 100 THEN 'route runner'
    WHEN first_x <= los_x AND first_y < 0.2*984 THEN 'backfield near bottom' WHEN first_x <= los_x AND first_y > 0.8*984 THEN 'backfield near top' ELSE 'stayed near the line' END reason FROM t WHERE team = 'offense')"""


def _with_teams(f):
    los = teams.fit_los(f.det, f.videos, "clustering")
    return teams.assign_team(tracks.track_summary(f.det), los), los


@query("a13_assign_team", "det", sql=_TEAMS + " SELECT video_id, track_id, team FROM t")
def _(f):
    return _with_teams(f)[0].select("video_id", "track_id", "team")


@query("f10_offense_tracks", "det", sql=_TEAMS + " SELECT video_id, track_id FROM t WHERE team = 'offense'")
def _(f):
    return teams.pick(_with_teams(f)[0], team="offense").select("video_id", "track_id")


@query("f10_one_track", "det", sql=_TEAMS + " SELECT video_id, track_id, team FROM t WHERE track_id = 7 OR track_id = 12 AND team = 'defense'")
def _(f):
    """A track by its id, in any team and in one."""
    found = _with_teams(f)[0]
    return teams.pick(found, track_id=7).unionByName(teams.pick(found, track_id=12, team="defense")).select("video_id", "track_id", "team")


@query("f10_skill_only", "det", sql=_SKILL + " SELECT video_id, track_id, reason FROM k WHERE reason IN ('route runner', 'backfield near bottom', 'backfield near top')")
def _(f):
    return teams.pick(teams.classify_skill(_with_teams(f)[0]), skill_only=True).select("video_id", "track_id", "reason")


@query("a14_classify_skill", "det", sql=_SKILL + " SELECT video_id, track_id, reason, reason IN ('route runner', 'backfield near bottom', 'backfield near top') AS is_skill FROM k")
def _(f):
    return teams.classify_skill(_with_teams(f)[0]).select("video_id", "track_id", "reason", "is_skill")


@query("a15_extraction_result", "det", sql=_SKILL + """, sk AS (SELECT video_id, count(*) FILTER (reason IN ('route runner', 'backfield near bottom', 'backfield near top')) n_skill FROM k GROUP BY 1)
  SELECT t.video_id, count(*) AS total, count(*) FILTER (team = 'offense') AS offense, count(*) FILTER (team = 'defense') AS defense, coalesce(max(n_skill), 0) AS skill, round(max(los_x), 4) AS los_x FROM t LEFT JOIN sk USING (video_id) GROUP BY 1""")
def _(f):
    rows, los = _with_teams(f)
    return rounded(teams.extraction_result(rows, teams.classify_skill(rows), los), 4)


@query("a18_position_breakdown", "det", sql=_SKILL + " SELECT CASE WHEN reason LIKE 'backfield%' THEN 'BACK' WHEN reason = 'route runner' THEN 'WR' ELSE 'UNKNOWN' END AS position, count(*) AS n FROM k GROUP BY 1")
def _(f):
    rows = teams.classify_skill(_with_teams(f)[0])
    return teams.position_breakdown(rows.withColumn("position", F.when(F.col("reason").startswith("backfield"), "BACK").when(F.col("reason") == "route runner", "WR")))


_LIMIT = DET_TRACKS + """, r AS (SELECT *, displacement >= 50 far, row_number() OVER (PARTITION BY video_id, displacement >= 50 ORDER BY displacement DESC, track_id) k FROM tracks),
  lim AS (SELECT *, CASE WHEN NOT far THEN 'below_min_displacement' WHEN k > 8 THEN 'exceeded_max_players' END exclusion_reason, CASE WHEN far THEN k END exclusion_rank FROM r)"""


@query("k1_limit_skill", "det", sql=_LIMIT + " SELECT video_id, track_id, round(displacement, 4) AS displacement, exclusion_reason IS NULL AS kept, exclusion_reason, exclusion_rank FROM lim")
def _(f):
    rows = teams.limit_skill(tracks.track_summary(f.det))
    return rounded(rows.select("video_id", "track_id", "displacement", "kept", "exclusion_reason", F.col("exclusion_rank").cast("bigint").alias("exclusion_rank")), 4)


@query("a16_limiter_stats", "det", sql=_LIMIT + """ SELECT video_id, count(*) AS original, count(*) FILTER (exclusion_reason = 'below_min_displacement') AS excluded_by_displacement, count(*) FILTER (exclusion_reason = 'exceeded_max_players') AS excluded_by_count,
   count(*) FILTER (exclusion_reason IS NULL) AS final, round(min(displacement) FILTER (exclusion_reason IS NULL), 4) AS threshold_displacement, count(*) > count(*) FILTER (exclusion_reason IS NULL) AS affected FROM lim GROUP BY 1""")
def _(f):
    return rounded(teams.limiter_stats(teams.limit_skill(tracks.track_summary(f.det))), 4)


@query("u3_kept_and_reclassified", "det", sql=_LIMIT + " SELECT exclusion_reason, count(*) AS n FROM lim GROUP BY 1")
def _(f):
    return teams.limit_skill(tracks.track_summary(f.det)).groupBy("exclusion_reason").agg(F.count("*").alias("n"))


#: Boxes of which some are spoiled by their ids: no size, no place, a confidence beyond 1, outside the picture, a frame too late.
_SPOILED = """SELECT det.video_id, det_id, CASE WHEN det_id % 31 = 0 THEN frame_id + 100000 ELSE frame_id END AS frame_id, CASE WHEN det_id % 37 = 0 THEN NULL WHEN det_id % 41 = 0 THEN 5000.0 ELSE x END AS x, y,
  CASE WHEN det_id % 43 = 0 THEN 0.0 ELSE det.width END AS width, det.height, CASE WHEN det_id % 47 = 0 THEN 1.5 ELSE confidence END AS confidence, videos.width AS video_width, videos.height AS video_height, total_frames FROM det JOIN videos ON det.video_id = videos.video_id"""


@query("x12_quarantine", "det", "videos", sql=f"""WITH p AS ({_SPOILED}), b AS (SELECT det_id, list_filter([CASE WHEN NOT coalesce(frame_id >= 0, false) THEN 'frame' END, CASE WHEN x IS NULL OR y IS NULL THEN 'place' END, CASE WHEN NOT (width > 0 AND height > 0) THEN 'size' END,
  CASE WHEN NOT confidence BETWEEN 0 AND 1 THEN 'confidence' END, CASE WHEN NOT frame_id < total_frames THEN 'in_video' END, CASE WHEN NOT coalesce(x < video_width AND y < video_height AND x + width > 0 AND y + height > 0, false) THEN 'in_picture' END], lambda n: n IS NOT NULL) n FROM p)
  SELECT det_id, array_to_string(n, ',') AS broken, (SELECT count(*) FROM b WHERE len(n) = 0) AS kept FROM b WHERE len(n) > 0""")
def _(f):
    spoiled = f.spark.sql(_SPOILED.replace("FROM det JOIN videos", "FROM {det} AS det JOIN {videos} AS videos"), det=f.det, videos=f.videos)
    good, bad = checks.quarantine(spoiled, checks.detection_rules(videos=True))
    return bad.select("det_id", F.array_join("broken", ",").alias("broken")).crossJoin(F.broadcast(good.agg(F.count("*").alias("kept"))))  # one row


@query("top_movers", "det", sql="WITH fd AS (SELECT * FROM det WHERE " + _KEEP + "), " + _SUMMARY.format(t="fd")[5:] + """
  SELECT video_id, track_id, round(displacement, 4) AS displacement, row_number() OVER (PARTITION BY video_id ORDER BY displacement DESC, track_id) AS place FROM tracks QUALIFY place <= 8""")
def _(f):
    from pyspark.sql import Window

    s = tracks.track_summary(d.zone_filter(d.filter_detections(f.det), FilterConfig(near_area=FilterConfig().area, mid_area=FilterConfig().area, near_aspect=FilterConfig().aspect, far_aspect=FilterConfig().aspect)))
    w = Window.partitionBy("video_id").orderBy(F.desc("displacement"), "track_id")
    return rounded(s.withColumn("place", F.row_number().over(w).cast("bigint")).where("place <= 8").select("video_id", "track_id", "displacement", "place"), 4)


@query("e1_detections_to_tracks")
def _(f):
    from ..config import PipelineConfig
    from .pipelines import detections_to_tracks

    out = detections_to_tracks(f.det, f.matches, f.segments, PipelineConfig(min_track=2), link=False)
    return out.groupBy("video_id", "track_id").agg(F.count("*").alias("n"))


#: Skill players by displacement, the far ones first.
_KEPT = _SKILL + """, sk AS (SELECT * FROM k WHERE reason IN ('route runner', 'backfield near bottom', 'backfield near top')), r AS (SELECT *, displacement >= 50 far, row_number() OVER (PARTITION BY video_id, displacement >= 50 ORDER BY displacement DESC, track_id) p FROM sk)"""


@query("e2_tracks_to_skill", "det", sql=_KEPT + " SELECT video_id, track_id, reason, far AND p <= 8 AS kept FROM r")
def _(f):
    from .pipelines import tracks_to_skill

    return tracks_to_skill(f.det, f.videos, "clustering").limited.select("video_id", "track_id", "reason", "kept")


@query("e3_skill_routes", "det", sql=_KEPT + """, n AS (SELECT video_id, track_id, count(*) c, arg_min(nx, (frame_id, det_id)) x1, arg_max(nx, (frame_id, det_id)) x64 FROM (SELECT *, greatest(least((x+width/2)/1920, 1.0), 0.0) nx FROM det) GROUP BY 1, 2)
  SELECT video_id, track_id, c AS original_num_detections, round(x1, 4) AS x1, round(x64, 4) AS x64 FROM r JOIN n USING (video_id, track_id) WHERE far AND p <= 8 AND c >= 10""")
def _(f):
    from .pipelines import skill_routes

    return rounded(skill_routes(f.det, f.videos, "clustering").select("video_id", "track_id", "original_num_detections", F.element_at("x_coords", 1).alias("x1"), F.element_at("x_coords", -1).alias("x64")), 4)
