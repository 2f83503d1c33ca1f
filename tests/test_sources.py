"""Files in folders, storage, and streams that arrive out of order."""

import pytest
from pyspark.sql import functions as F

from trackframe.operators import detections
from trackframe.sources import files
from trackframe.storage import drop_tables, materialize, shared_dir
from trackframe.streaming import ordered, streams

DET = "video_id bigint, track_id bigint, det_id bigint, frame_id bigint, x double, y double, width double, height double, confidence double"


def test_labelled_frames(spark, tmp_path):
    for name in ("a/f1.jpg", "a/f1.txt", "a/f2.JPEG", "b/f1.jpg", "b/other.txt", "b/notes.md"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    got = {(r.video, r.stem, r.labelled) for r in files.labelled_frames(spark, f"file://{tmp_path}").collect()}
    assert got == {("a", "f1", True), ("a", "f2", False), ("b", "f1", False)}


def test_written_tables_are_dropped(spark):
    df = materialize(spark.range(5), "some").union(materialize(spark.range(3), "more"))
    assert df.count() == 8
    folders = {p.rsplit("/", 1)[0] for p in df.inputFiles()}
    drop_tables(df)
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(next(iter(folders))).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    assert len(folders) == 2 and not any(fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)) for p in folders)


class Cluster:
    """A session without a checkpoint folder on a cluster."""

    class conf:  # noqa: N801
        @staticmethod
        def get(key, default=None):
            return default

    class sparkContext:  # noqa: N801
        master = "spark://host:7077"


def test_a_cluster_must_name_its_folder():
    with pytest.raises(ValueError):
        shared_dir(Cluster)


def stream(spark, tmp_path, batches):
    path = f"file://{tmp_path}/in"
    for rows in batches:
        spark.createDataFrame(rows, DET).coalesce(1).write.mode("append").parquet(path)
    return streams.read_detections(spark, path)


def box(i, frame, x=0.0, video=0):
    return (video, 0, i, frame, x, 0.0, 20.0, 40.0, 0.9)


def test_links_end_with_the_buffer(spark, tmp_path):
    """A box comes back to a track within the buffer and starts a new one beyond it; the last frames wait for the watermark."""
    rows = stream(spark, tmp_path, [[box(1, 0), box(2, 1)], [box(3, 20)], [box(4, 400)], [box(5, 2000, video=1)], [box(6, 2010)], [box(7, 9000)]])
    got = {r.det_id: r.track_id for r in streams.run_once(streams.online_links(rows), "links_end").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6}


def test_links_do_not_depend_on_order(spark, tmp_path):
    """Boxes of three videos, dealt to batches up to four seconds late, link as in the batch operator; boxes beyond the watermark are dropped."""
    boxes = [(v, 0, 1000 * v + 10 * f + k, f, 40.0 * k + 2.0 * (f % 7), 5.0 * v, 20.0, 40.0, (0.9, 0.15, 0.3)[(f + k) % 3]) for v in range(3) for f in range(0, 60, 1 + v) for k in range(4)]
    boxes = boxes[: len(boxes) // 2 * 2]
    shuffled = sorted(boxes, key=lambda b: b[3] + b[2] * 7919 % 100)
    batches = [shuffled[at : at + 40] for at in range(0, len(shuffled), 40)]
    rows = stream(spark, tmp_path, [*batches, [(v, 0, 10**6 + v, 10_000, 0.0, 0.0, 9.0, 9.0, 0.9) for v in range(3)], [box(10**6 + 9, 10_001)], [box(10**7, 0)]])
    got = sorted(map(tuple, streams.run_once(streams.online_links(rows), "links_any_order").collect()))
    want = sorted(map(tuple, ordered.batch_links(spark.createDataFrame(boxes, DET)).collect()))
    assert got == want and len({t for *_, t in want}) < len(want) / 3


def test_frames_come_in_order(spark, tmp_path):
    rows = stream(spark, tmp_path, [[box(5, 70), box(1, 0)], [box(4, 69), box(3, 1), box(2, 1)], [box(9, 500, video=1)], [box(6, 80)], [box(8, 2000)], [box(10, 2001)], [box(7, 1500, video=1)]])
    got = sorted((r.place, r.video_id, r.det_id) for r in streams.run_once(streams.in_frame_order(rows), "in_order").select("place", "video_id", "det_id").collect())
    assert got == [(1, 0, 1), (1, 1, 9), (2, 0, 2), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 0, 6)]  # 7 was late, 8 and 10 wait


def test_areas_do_not_depend_on_order(spark, tmp_path):
    """A box that arrives in a later batch takes its frame's place, so the areas equal those of the batch operator."""
    wide = lambda i, frame, w: (0, 0, i, frame, 100.0, 100.0, w, 40.0, 0.9)
    boxes = [wide(k, k, (20.0, 90.0, 22.0, 25.0, 70.0)[k % 5]) for k in range(60)]
    late = stream(spark, tmp_path, [boxes[0::3], boxes[2::3], boxes[1::3], [wide(100, 5000, 20.0)]])
    widths = lambda df: {r.det_id: round(r.width, 6) for r in df.collect()}
    assert widths(streams.run_once(streams.steady_areas(late), "areas_late")) == widths(detections.constrain_area(spark.createDataFrame(boxes, DET)))


def test_duplicates_in_a_later_batch_are_dropped(spark, tmp_path):
    rows = stream(spark, tmp_path, [[box(1, 0), box(2, 1)], [box(2, 1), box(3, 2)], [box(1, 0)]])
    got = [r.det_id for r in streams.run_once(streams.deduplicated(rows).select("det_id"), "dropped").select(F.col("det_id")).collect()]
    assert sorted(got) == [1, 2, 3]
