"""Shape figures of annotations with polygons."""

from __future__ import annotations

import json
import math

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions import polygons as P
from ..functions.runs import shapes_of
from ..manifest import Manifest

_COLUMNS = ("n_shapes", "n_vertices", "area", "perimeter", "rt_area", "hull_rt_area", "obox_major", "obox_minor", "obox_ratio")


def _figures(text: str) -> tuple:
    """Of all shapes of a segmentation together; holes are taken off the area. Run lengths have none."""
    shapes = [[[tuple(p) for p in ring.tolist()] for ring in s] for s in shapes_of(json.loads(text)) if not isinstance(s, dict)]
    if not shapes:
        return (None,) * len(_COLUMNS)
    rings = [r for s in shapes for r in s]
    area = sum(P.area(s[0]) - sum(P.area(r) for r in s[1:]) for s in shapes)
    corners = P.hull([p for s in shapes for p in s[0]])
    major, minor = P.smallest_box(corners)
    return (
        len(shapes), sum(map(len, rings)), area, sum(map(P.length, rings)), math.sqrt(max(0.0, area)), math.sqrt(P.area(corners)), major, minor,
        major / minor if minor else None,
    )


def polygon_shapes(m: Manifest) -> DataFrame:
    """``id`` with figures of each annotation's polygons: numbers of shapes and vertices, area, perimeter, square roots of its area and its hull's, sides of the smallest box at any angle and their ratio.

    Null without polygons; the ratio is null for polygons without extent.
    """
    rows = m.annotations.where("segmentation is not null").select("id", "segmentation")

    def run(batches):
        for b in batches:
            found = list(zip(*map(_figures, b.column(1).to_pylist()))) or [()] * len(_COLUMNS)
            kinds = [pa.int64()] * 2 + [pa.float64()] * (len(_COLUMNS) - 2)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(found, kinds))], ["id", *_COLUMNS])

    return rows.mapInArrow(run, "id long, n_shapes long, n_vertices long, " + ", ".join(f"{c} double" for c in _COLUMNS[2:]))
