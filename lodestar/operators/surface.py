"""Distances between the surfaces of predicted and true masks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def near_any(x: np.ndarray, size: int, before: int) -> np.ndarray:
    """Whether any pixel is set in the window of ``size`` by ``size`` that begins ``before`` pixels up and left of each one; nothing is set beyond the edge.

    Down each axis the array is cut into blocks of ``size``: a window is the end of one block and the start of the next, and what these hold
    is carried along within the blocks, so the time doesn't depend on ``size``.
    """
    for _ in range(2):
        x = x.T
        n = len(x)
        blocks = -(-(n + size - 1) // size)
        wide = np.zeros((blocks * size, x.shape[1]), bool)
        wide[before : before + n] = x
        cut = wide.reshape(blocks, size, x.shape[1])
        starts = np.logical_or.accumulate(cut, axis=1).reshape(wide.shape)
        ends = np.logical_or.accumulate(cut[:, ::-1], axis=1)[:, ::-1].reshape(wide.shape)
        x = ends[:n] | starts[size - 1 : size - 1 + n]
    return x


def erode(mask: np.ndarray) -> np.ndarray:
    """Pixels of which all nine neighbours are set; there is nothing beyond the edge."""
    wide = np.pad(mask.astype(bool), 1)
    return ~near_any(~wide, 3, 1)[1:-1, 1:-1]


def surface(mask: np.ndarray) -> np.ndarray:
    mask = mask.astype(bool)
    return mask & ~erode(mask)


def squared_distances(points: np.ndarray, spacing: tuple[float, float]) -> np.ndarray:
    """Squared Euclidean distance of each pixel to the nearest one set in ``points``; inf if none is.

    Down each column the nearest set pixel is carried along both ways. Along each row that gives a parabola for every column; of their
    lower envelope a stack holds the parabolas and where each begins, so a row takes time in proportion to its pixels. All rows go at once.
    """
    h, w = points.shape
    rows, far = np.arange(h)[:, None], np.inf
    above = np.maximum.accumulate(np.where(points, rows, -far), axis=0)
    below = np.minimum.accumulate(np.where(points, rows, far)[::-1], axis=0)[::-1]
    down = (np.minimum(rows - above, below - rows) * spacing[0]) ** 2
    own, at = np.arange(h), np.arange(w) * spacing[1]
    apex, start, top = np.zeros((h, w), int), np.full((h, w + 1), far), np.full(h, -1)
    for q in range(w):
        live = own[np.isfinite(down[:, q])]
        begins = np.full(len(live), -far)
        wait = np.arange(len(live))[top[live] >= 0]
        while len(wait):  # those whose last parabola may be hidden
            r = live[wait]
            p = apex[r, top[r]]
            cross = ((down[r, q] + at[q] ** 2) - (down[r, p] + at[p] ** 2)) / (2 * (at[q] - at[p]))
            hidden = cross <= start[r, top[r]]
            begins[wait] = np.where(hidden, -far, cross)
            top[r[hidden]] -= 1
            wait = wait[hidden]
            wait = wait[top[live[wait]] >= 0]
        top[live] += 1
        apex[live, top[live]], start[live, top[live]], start[live, top[live] + 1] = q, begins, far
    out, k = np.full((h, w), far), np.zeros(h, int)
    some = own[top >= 0]
    for q in range(w) if len(some) else ():
        while len(late := some[start[some, k[some] + 1] < at[q]]):
            k[late] += 1
        p = apex[some, k[some]]
        out[some, q] = down[some, p] + ((q - p) * spacing[1]) ** 2
    return out


def distance_to(points: np.ndarray, spacing: tuple[float, float], at: np.ndarray) -> np.ndarray:
    """Euclidean distance of the pixels that are set in ``at`` to the nearest one set in ``points``."""
    return np.sqrt(squared_distances(points, spacing)[at.astype(bool)])


#: Distances where neither mask has a surface, and where only one has.
NO_SURFACE, ONE_SURFACE = 0.0, float("inf")


def surface_distances(pred: np.ndarray, true: np.ndarray, spacing: tuple[float, float]) -> np.ndarray:
    """Distances from each surface to the other; 0 if both are empty, inf if one is."""
    edges = [surface(pred), surface(true)]
    empty = sum(not e.any() for e in edges)
    if empty:
        return np.array([NO_SURFACE if empty == 2 else ONE_SURFACE])
    return np.concatenate([distance_to(to, spacing, own) for own, to in (edges, edges[::-1])])


def metrics_of(pred: np.ndarray | None, true: np.ndarray | None, spacing: tuple[float, float], tolerance: float) -> tuple[float | None, float | None, float | None, float | None]:
    """ASD, HD, HD95 and NSD; nulls if a mask is null."""
    if pred is None or true is None:
        return None, None, None, None
    d = surface_distances(pred, true, spacing)
    summary = (np.full(3, d[0]) if np.isinf(d[0]) else np.array([d.mean(), d.max(), np.percentile(d, 95)])).tolist()
    return (*summary, float(np.mean(d <= tolerance)))


def surface_metrics(rows: DataFrame, key: str, pred: str, true: str, shape: tuple[int, int], spacing: tuple[float, float], tolerance: float) -> DataFrame:
    """(key, asd, hd, hd95, nsd) of masks that are flat arrays of one shape; null for null masks."""
    kind = rows.schema[key].dataType.simpleString()
    image = lambda x: None if x is None else np.reshape(x, shape)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = [metrics_of(image(p), image(t), spacing, tolerance) for p, t in zip(f[pred], f[true], strict=True)]
            yield pd.DataFrame(out, columns=["asd", "hd", "hd95", "nsd"], dtype="Float64").assign(**{key: f[key].to_numpy()})[[key, "asd", "hd", "hd95", "nsd"]]

    return rows.select(key, pred, true).mapInPandas(run, f"`{key}` {kind}, asd double, hd double, hd95 double, nsd double")


def mean_distance(x: Column, policy: str, diagonal: Column | None = None) -> Column:
    """Mean under a policy for infinite distances: propagate, exclude (inf if all are), or max_distance."""
    finite = F.abs(x) < float("inf")
    if policy == "propagate":
        return F.avg(x)
    if policy == "exclude":
        return F.coalesce(F.avg(F.when(finite, x)), F.lit(float("inf")))
    if policy == "max_distance":
        return F.avg(F.when(finite, x).otherwise(diagonal))
    raise ValueError(f"unknown policy {policy!r}")


def infinite(x: Column) -> Column:
    return F.sum((F.abs(x) == float("inf")).cast("bigint"))


def boundary_band(mask: np.ndarray, kernel: int = 5) -> np.ndarray:
    """Pixels whose kernel-sized neighbourhood within the image holds set and unset ones."""
    before, mask = (kernel - 1) // 2, mask.astype(bool)
    return near_any(mask, kernel, before) & near_any(~mask, kernel, before)


def resized(image: np.ndarray, shape: tuple[int, int], nearest: bool) -> np.ndarray:
    """An image at another size: ``nearest`` takes the pixel at the scaled place, else neighbours are weighted by half-pixel centres."""
    if nearest:
        at = [np.minimum((np.arange(new) * (old / new)).astype(int), old - 1) for old, new in zip(image.shape, shape, strict=True)]
        return image[np.ix_(*at)]
    out = image.astype(float)
    for axis, (old, new) in enumerate(zip(image.shape, shape, strict=True)):
        place = np.clip((np.arange(new) + 0.5) * (old / new) - 0.5, 0, old - 1)
        low = np.floor(place).astype(int)
        part = (place - low).reshape([-1 if k == axis else 1 for k in range(2)])
        out = np.take(out, low, axis) * (1 - part) + np.take(out, np.minimum(low + 1, old - 1), axis) * part
    return out


def map_images(rows: DataFrame, key: str, image: str, height: str, width: str, work, kind: str = "double") -> DataFrame:
    """(key, height, width, image): ``work`` on each flat array as an image of its own size; null images stay null."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = [None if x is None else work(np.reshape(x, (h, w))) for x, h, w in zip(f[image], f[height], f[width], strict=True)]
            yield pd.DataFrame({key: f[key], height: [None if o is None else o.shape[0] for o in out], width: [None if o is None else o.shape[1] for o in out], image: [None if o is None else o.ravel().tolist() for o in out]})

    return rows.select(key, height, width, image).mapInPandas(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, `{height}` int, `{width}` int, `{image}` array<{kind}>")


def boundary_bands(rows: DataFrame, key: str, mask: str, height: str, width: str, kernel: int = 5) -> DataFrame:
    """Masks as their boundary bands of 0 and 1."""
    return map_images(rows, key, mask, height, width, lambda x: boundary_band(x > 0, kernel).astype(int), "int")


def resize_images(rows: DataFrame, key: str, image: str, height: str, width: str, shape: tuple[int, int], nearest: bool = False) -> DataFrame:
    """Images linearly, or masks (``nearest``) by nearest pixels, at one size."""
    return map_images(rows, key, image, height, width, lambda x: resized(x, shape, nearest), "int" if nearest else "double")
