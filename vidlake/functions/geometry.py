"""Integer box and point geometry as Columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, functions as F


def div(a: Column, b: int) -> Column:
    """Integer division that truncates toward zero."""
    return F.when(a >= 0, F.floor(a / b)).otherwise(-F.floor(-a / b)).cast("int")


def rect_center(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct((x + div(w, 2)).alias("x"), (y + div(h, 2)).alias("y"))


def track_point(x: Column, y: Column, w: Column, h: Column) -> Column:
    """Where a box stands: the middle of its lower edge."""
    return F.struct((x + div(w, 2)).alias("x"), (y + h).alias("y"))


def distance(p: Column, q: Column) -> Column:
    return F.sqrt(F.pow(p["x"] - q["x"], 2) + F.pow(p["y"] - q["y"], 2))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of boxes (x, y, width, height); 0 for an empty union."""
    w = F.greatest(F.lit(0), F.least(a["x"] + a["width"], b["x"] + b["width"]) - F.greatest(a["x"], b["x"]))
    h = F.greatest(F.lit(0), F.least(a["y"] + a["height"], b["y"] + b["height"]) - F.greatest(a["y"], b["y"]))
    inter = (w * h).cast("double")
    union = a["width"] * a["height"] + b["width"] * b["height"] - inter
    return F.when(union <= 0, F.lit(0.0)).otherwise(inter / union)


def side_of_line(p: Column, line: Column) -> Column:
    """Which side of the infinite line through two points p is on; line: array of two points."""
    a, b = F.get(line, 0), F.get(line, 1)
    lo, hi = F.when(a["x"] <= b["x"], a).otherwise(b), F.when(a["x"] <= b["x"], b).otherwise(a)
    cross = (hi["x"] - lo["x"]).cast("long") * (p["y"] - lo["y"]) - (hi["y"] - lo["y"]).cast("long") * (p["x"] - lo["x"])
    return F.when(a["x"] == b["x"], p["x"] < a["x"]).when(a["y"] == b["y"], p["y"] < a["y"]).otherwise(cross > 0)


def point_in_polygon(p: Column, ring: Column, corners: int | None = None) -> Column:
    """Even-odd rule with integer division that truncates; ring: array of points.

    corners: as many as any ring has, where that is known and they are few; the edges are
    then spelled out, which Spark compiles, as it does not compile functions of arrays.
    """

    def crosses(a: Column, b: Column) -> Column:
        spans = (a["y"] > p["y"]) != (b["y"] > p["y"])
        num, den = (b["x"] - a["x"]).cast("long") * (p["y"] - a["y"]), (b["y"] - a["y"]).cast("long")
        ratio = num / F.when(den != 0, den)
        at = F.when(ratio >= 0, F.floor(ratio)).otherwise(F.ceil(ratio)) + a["x"]
        return (spans & (p["x"] < at)).cast("int")

    if corners is not None:
        edges = [(F.get(ring, F.lit(k)), F.get(ring, F.lit(k - 1)) if k else F.get(ring, F.size(ring) - 1)) for k in range(corners)]
        crossed = reduce(Column.__add__, [F.coalesce(crosses(a, b), F.lit(0)) for a, b in edges], F.lit(0))
        return F.when(ring.isNotNull(), crossed % 2 == 1)
    edges = F.zip_with(ring, F.concat(F.slice(ring, F.size(ring), 1), F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0)))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.aggregate(F.transform(edges, lambda e: crosses(e["a"], e["b"])), F.lit(0), lambda s, c: s + F.coalesce(c, F.lit(0))) % 2 == 1


def homography(src: Sequence[tuple[float, float]], dst: Sequence[tuple[float, float]]) -> list[float]:
    """The nine numbers of the perspective map that takes four points to four others."""
    rows, right = [], []
    for (x, y), (u, v) in zip(src, dst):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    return [*np.linalg.solve(np.array(rows, float), np.array(right, float)).tolist(), 1.0]


def project_point(x: Column, y: Column, h: Sequence[float]) -> Column:
    k = [F.lit(float(v)) for v in h]
    scale = k[6] * x + k[7] * y + k[8]
    return F.struct(((k[0] * x + k[1] * y + k[2]) / scale).alias("x"), ((k[3] * x + k[4] * y + k[5]) / scale).alias("y"))
