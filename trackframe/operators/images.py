"""Pictures of routes as dense records, and what a fixed convolution sees in them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .routes import route_pixels

#: Colours (red, green, blue) of the background, the line, the start and the end.
COLOURS = np.array([(255, 255, 255), (30, 100, 255), (0, 210, 0), (220, 30, 30)], np.uint8)
KINDS = ("line", "start", "end")
#: Pictures of a batch that leaves a task.
PAINTED_AT_ONCE = 256


def paint(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Pictures of routes whose painted cells are listed, ``PAINTED_AT_ONCE`` at a time."""
    for batch in (whole.slice(at, PAINTED_AT_ONCE) for whole in batches for at in range(0, whole.num_rows, PAINTED_AT_ONCE)):
        cells = batch.column(1)
        grid = np.zeros((batch.num_rows, size * size), np.int8)
        at = np.asarray(cells.flatten())
        grid[np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(cells.offsets))), at // 4] = at % 4
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([COLOURS[g].T.tobytes() for g in grid], pa.binary())], names=["route_id", "image"])


def route_images(routes: DataFrame, size: int = 64) -> DataFrame:
    """route_id and ``image``: 3 x size x size bytes, channel by channel, rows from the top.

    Only painted pixels are shuffled, at most size * size for a route.  A task
    holds ``PAINTED_AT_ONCE`` pictures, however many rows come in a batch.
    """
    kind = F.element_at(F.create_map(*(x for k, name in enumerate(KINDS) for x in (F.lit(name), F.lit(k + 1)))), F.col("channel"))
    painted = route_pixels(routes, size).groupBy("route_id").agg(F.collect_list((F.col("r") * size + F.col("c")) * 4 + kind).alias("painted"))

    return painted.mapInArrow(lambda batches: paint(batches, size), "route_id bigint, image binary")


def edge_filters(directions: int = 8, width: int = 7) -> np.ndarray:
    """Bars of each direction: bright along the line, dark beside it, sum zero."""
    at = np.arange(width) - width // 2
    y, x = np.meshgrid(at, at, indexing="ij")
    bars = []
    for k in range(directions):
        angle = np.pi * k / directions
        aside = x * np.sin(angle) - y * np.cos(angle)
        bar = np.exp(-(aside**2) / 2) * (x**2 + y**2 <= (width // 2 + 0.5) ** 2)
        bars.append((bar - bar.mean()) / np.abs(bar - bar.mean()).sum())
    return np.array(bars)


def image_features(images: DataFrame, size: int = 64, grid: int = 8, directions: int = 8) -> DataFrame:
    """``features`` of each image: the line through a bank of bars, rectified and averaged over a grid, and where the start and the end lie."""
    bank, step = edge_filters(directions), size // grid

    def pooled(x: np.ndarray) -> np.ndarray:
        return x.reshape(*x.shape[:-2], grid, step, grid, step).mean((-3, -1))

    def see(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pad = bank.shape[1] // 2
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                pixels = np.stack([np.frombuffer(b, np.uint8) for b in part.column("image").to_pylist()]).reshape(-1, 3, size, size)
                line, start, end = ((pixels == COLOURS[k][:, None, None]).all(1).astype(np.float32) for k in (1, 2, 3))
                line = np.maximum(line, np.maximum(start, end))
                windows = np.lib.stride_tricks.sliding_window_view(np.pad(line, ((0, 0), (pad, pad), (pad, pad))), bank.shape[1:], (1, 2))
                seen = np.maximum(np.einsum("nijxy,fxy->nfij", windows, bank.astype(np.float32), optimize=True), 0)
                found = [10 * pooled(seen), pooled(start)[:, None], pooled(end)[:, None]]
                flat = np.concatenate(found, 1).reshape(part.num_rows, -1).astype(np.float64)
                offsets = pa.array(np.arange(part.num_rows + 1) * flat.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("route_id"), pa.ListArray.from_arrays(offsets, pa.array(flat.ravel()))], names=["route_id", "seen"])

    from pyspark.ml.functions import array_to_vector

    return images.select("route_id", "image").mapInArrow(see, "route_id bigint, seen array<double>").select("route_id", array_to_vector("seen").alias("features"))


#: Length of ``features`` at the default size.
N_FEATURES = 8 * 8 * 10
