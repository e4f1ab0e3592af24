"""Moments of all pairs of columns, pairwise complete, from one scan of any width.

Columns are put into blocks. Every task multiplies the arrays of its rows block by block, values
and presence alike, and ends up with one row per pair of blocks; these are merged in groups of
a bounded number, so neither a plan nor a task nor the driver grows with the number of pairs
and tasks at once. Means are taken out before products are summed, so large values with
little spread lose nothing.

Of either column of a pair its least, its greatest and one value between are kept over the rows where
both are present, which tells whether there are three distinct ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .columns import finite_frame

BLOCK = 64
MERGED_AT_ONCE = 256
SUMS = ("n", "mean_x", "mean_y", "var_x", "var_y", "cov")
ENDS = ("lo_x", "mid_x", "hi_x", "lo_y", "mid_y", "hi_y")
PARTS = "bx int, by int, part bigint, data binary"
PAIRS = "x int, y int, n bigint, " + ", ".join(f"{c} double" for c in ("mean_x", "mean_y", "var_x", "var_y", "cov")) + ", varied boolean"


def _between(lo: np.ndarray, hi: np.ndarray, *values: np.ndarray) -> np.ndarray:
    """Of each cell one value strictly between the ends, or NaN."""
    out = np.full(lo.shape, np.nan)
    for v in values:
        out = np.where((v > lo) & (v < hi), v, out)
    return out


def _ends(x: np.ndarray, seen: np.ndarray) -> list[np.ndarray]:
    """(column, condition): least, between and greatest of each column over the rows that a condition sees."""
    def over(part):
        if not len(part):
            return [np.full(x.shape[1], np.nan)] * 3
        gone = np.isnan(part)
        lo, hi = np.where(gone, np.inf, part).min(axis=0), np.where(gone, -np.inf, part).max(axis=0)
        mid = np.where(gone | (part >= hi), -np.inf, part).max(axis=0)
        none = np.isinf(lo)
        return [np.where(none, np.nan, lo), np.where(none | ~(mid > lo), np.nan, mid), np.where(none, np.nan, hi)]

    every = over(x)
    columns = [every if seen[:, k].all() else over(x[seen[:, k]]) for k in range(seen.shape[1])]
    return [np.stack([c[e] for c in columns], axis=1) for e in range(3)]


def _measured(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """What is known of a pair of blocks from some rows: arrays of (column of x, column of y)."""
    mx, my = ~np.isnan(x), ~np.isnan(y)
    px, py = (np.where(m.any(axis=0), np.where(m, v, 0).sum(axis=0) / np.maximum(m.sum(axis=0), 1), 0) for v, m in ((x, mx), (y, my)))
    zx, zy = np.where(mx, x - px, 0), np.where(my, y - py, 0)
    fx, fy = mx.astype(float), my.astype(float)
    n = fx.T @ fy
    each = np.maximum(n, 1)
    sx, sy = zx.T @ fy, fx.T @ zy
    with np.errstate(invalid="ignore", over="ignore"):
        out = {"n": n, "mean_x": px[:, None] + sx / each, "mean_y": py[None, :] + sy / each,
               "var_x": (zx * zx).T @ fy - sx * sx / each, "var_y": fx.T @ (zy * zy) - sy * sy / each, "cov": zx.T @ zy - sx * sy / each}
    out.update(zip(ENDS[:3], _ends(x, my)))
    out.update(zip(ENDS[3:], (e.T for e in _ends(y, mx))))
    return out


def _merged(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    n = a["n"] + b["n"]
    each = np.maximum(n, 1)
    dx, dy, weight = b["mean_x"] - a["mean_x"], b["mean_y"] - a["mean_y"], a["n"] * b["n"] / each
    out = {"n": n, "mean_x": a["mean_x"] + dx * b["n"] / each, "mean_y": a["mean_y"] + dy * b["n"] / each,
           "var_x": a["var_x"] + b["var_x"] + dx * dx * weight, "var_y": a["var_y"] + b["var_y"] + dy * dy * weight,
           "cov": a["cov"] + b["cov"] + dx * dy * weight}
    for s in "xy":
        lo, hi = np.fmin(a[f"lo_{s}"], b[f"lo_{s}"]), np.fmax(a[f"hi_{s}"], b[f"hi_{s}"])
        out[f"lo_{s}"], out[f"hi_{s}"] = lo, hi
        out[f"mid_{s}"] = _between(lo, hi, *[side[f"{e}_{s}"] for side in (a, b) for e in ("lo", "mid", "hi")])
    return out


def pair_moments(df: DataFrame, columns: Sequence[str], block: int = BLOCK) -> DataFrame:
    """``x, y, n, mean_x, mean_y, var_x, var_y, cov, varied`` for all pairs x <= y of places in ``columns``, over the rows
    where both are present. Variances and covariance are sums of products; ``varied`` tells
    whether both columns have three distinct values there. An empty table gives no rows."""
    width = len(columns)
    starts = list(range(0, width, block))
    names = [f"c{i}" for i in range(width)]
    frame = finite_frame(df, list(columns)).toDF(*names)

    def packed(d: dict[str, np.ndarray]) -> bytes:
        return np.stack([d[k] for k in SUMS + ENDS]).tobytes()

    def unpacked(data: bytes, bx: int, by: int) -> dict[str, np.ndarray]:
        sizes = [min(block, width - starts[b]) for b in (bx, by)]
        return dict(zip(SUMS + ENDS, np.frombuffer(data).reshape(len(SUMS + ENDS), *sizes)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[int, int], dict[str, np.ndarray]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.column_stack([np.asarray(c.to_numpy(zero_copy_only=False), float) for c in batch.columns[:-1]])
            part = batch.columns[-1][0].as_py()
            for bx, x in enumerate(starts):
                for by, y in enumerate(starts[bx:], bx):
                    made = _measured(rows[:, x : x + block], rows[:, y : y + block])
                    known[bx, by] = _merged(known[bx, by], made) if (bx, by) in known else made
        for (bx, by), d in known.items():
            yield pa.RecordBatch.from_pydict({"bx": pa.array([bx], pa.int32()), "by": pa.array([by], pa.int32()),
                                              "part": pa.array([part], pa.int64()), "data": pa.array([packed(d)], pa.binary())})

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        bx, by = int(group["bx"].iloc[0]), int(group["by"].iloc[0])
        total = None
        for data in group.sort_values("part")["data"]:
            made = unpacked(data, bx, by)
            total = made if total is None else _merged(total, made)
        return pd.DataFrame({"bx": [bx], "by": [by], "part": [int(group["part"].min()) // MERGED_AT_ONCE], "data": [packed(total)]})

    def cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in frames:
            for bx, by, data in zip(group["bx"], group["by"], group["data"]):
                d = unpacked(data, bx, by)
                i, j = (v.ravel() for v in np.meshgrid(*(np.arange(d["n"].shape[k]) for k in (0, 1)), indexing="ij"))
                x, y = i + starts[bx], j + starts[by]
                some = (x <= y) & (d["n"][i, j] > 0)
                varied = ~np.isnan(d["mid_x"]) & ~np.isnan(d["mid_y"])
                yield pd.DataFrame({"x": x, "y": y, **{k: d[k][i, j] for k in SUMS}, "varied": varied[i, j]})[some].astype({"n": "int64"})

    # Neighbouring tasks merge first, so that no group holds more than a bounded number of rows.
    parts = frame.withColumn("part", F.spark_partition_id().cast("bigint")).mapInArrow(run, PARTS)
    for group in (F.expr(f"part div {MERGED_AT_ONCE}"), F.lit(0)):
        parts = parts.groupBy("bx", "by", group.alias("_group")).applyInPandas(lambda g: merge(g), PARTS)
    return parts.mapInPandas(cells, PAIRS)
