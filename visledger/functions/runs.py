"""Masks as sorted runs of pixels: polygon fill, run-length codes, set operations. Pixels are never drawn.

A mask is three arrays ``line, start, stop``: the pixels ``start`` to ``stop -
1`` of a pixel column ``line``, in order of line and start, disjoint and not
touching. A pixel belongs to a polygon if its centre does, by the even-odd rule.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain

import numpy as np

Runs = tuple[np.ndarray, np.ndarray, np.ndarray]
NOTHING: Runs = (np.zeros(0, np.int64),) * 3
#: Crossings of edges and columns, or runs, that are held at a time where many masks are made at once.
HELD = 1 << 18


def union(line: np.ndarray, start: np.ndarray, stop: np.ndarray) -> Runs:
    """Runs of any order and overlap as a mask."""
    if not len(line):
        return NOTHING
    stride = int(stop.max()) + 2
    a, b = line * stride + start, line * stride + stop
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    reach = np.maximum.accumulate(b)
    new = np.ones(len(a), bool)
    new[1:] = a[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(a)) - 1
    lines = a[first] // stride
    return lines, a[first] - lines * stride, reach[last] - lines * stride


def fill(rings: list[np.ndarray], width: int, height: int) -> Runs:
    """The pixels inside of closed rings (arrays of points x, y), even-odd over all of them, within an image.

    Each edge gives a crossing for every column of pixel centres it passes; the
    crossings of a column, sorted, are the ends of its runs in turn.
    """
    columns, crossings = [], []
    for ring in rings:
        if len(ring) < 3:
            continue
        x1, y1 = ring[:, 0], ring[:, 1]
        x2, y2 = np.roll(x1, -1), np.roll(y1, -1)
        swap = x1 > x2
        x1, x2, y1, y2 = np.where(swap, x2, x1), np.where(swap, x1, x2), np.where(swap, y2, y1), np.where(swap, y1, y2)
        begin = np.clip(np.ceil(x1 - 0.5), 0, width).astype(np.int64)
        end = np.clip(np.ceil(x2 - 0.5), 0, width).astype(np.int64)
        n = np.maximum(end - begin, 0)
        edge = np.repeat(np.arange(len(n)), n)
        column = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + begin[edge]
        slope = (y2 - y1)[edge] / (x2 - x1)[edge]
        columns.append(column)
        crossings.append(y1[edge] + (column + 0.5 - x1[edge]) * slope)
    if not columns:
        return NOTHING
    column, y = np.concatenate(columns), np.concatenate(crossings)
    order = np.lexsort((y, column))
    column, y = column[order], y[order]
    at = np.clip(np.ceil(y - 0.5), 0, height).astype(np.int64)
    line, start, stop = column[::2], at[::2], at[1::2]
    some = stop > start
    return union(line[some], start[some], stop[some])


def area(runs: Runs) -> int:
    return int((runs[2] - runs[1]).sum())


def intersection_area(a: Runs, b: Runs) -> int:
    """Pixels that two masks share: what both hold less what their union holds."""
    both = union(*(np.concatenate(p) for p in zip(a, b)))
    return area(a) + area(b) - area(both)


def to_counts(runs: Runs, width: int, height: int) -> np.ndarray:
    """Lengths of the stretches outside and inside of a mask in turn, column by column, the first outside."""
    a, b = runs[0] * height + runs[1], runs[0] * height + runs[2]
    joined = np.zeros(len(a), bool)
    joined[1:] = a[1:] == b[:-1]  # from the foot of a column to the head of the next
    keep = ~joined
    a, b = a[keep], b[np.append(keep[1:], True)] if len(b) else b
    ends = np.column_stack([a, b]).ravel()
    counts = np.diff(ends, prepend=0, append=width * height)
    return counts[:-1] if len(counts) > 1 and counts[-1] == 0 else counts


def from_counts(counts: np.ndarray, height: int) -> Runs:
    """The mask of :func:`to_counts`; stretches over several columns are parted."""
    ends = np.cumsum(counts)
    a, b = ends[:-1:2], ends[1::2]
    a = a[: len(b)]
    a, b = a[b > a], b[b > a]
    if not len(a):
        return NOTHING
    first, last = a // height, (b - 1) // height
    n = last - first + 1
    of = np.repeat(np.arange(len(n)), n)
    line = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[of]
    return line, np.maximum(a[of] - line * height, 0), np.minimum(b[of] - line * height, height)


def to_text(counts: np.ndarray) -> str:
    """Counts as text: from the fourth on less that before the last, in groups of five bits from the lowest, each with a bit for more to come, above code point 48."""
    x = counts.astype(np.int64).copy()
    x[3:] -= counts[1:-2]
    places, values, at, k = [], [], np.arange(len(x)), 0
    while len(at):
        low = x & 31
        x = x >> 5
        more = np.where(low & 16, x != -1, x != 0)
        places.append(at * 16 + k)
        values.append(low | more.astype(np.int64) << 5)
        at, x, k = at[more], x[more], k + 1
    if not places:
        return ""
    order = np.argsort(np.concatenate(places))
    return (np.concatenate(values)[order] + 48).astype(np.uint8).tobytes().decode("ascii")


def from_text(text: str) -> np.ndarray:
    """The counts of :func:`to_text`."""
    v = np.frombuffer(text.encode("ascii"), np.uint8).astype(np.int64) - 48
    if not len(v):
        return np.zeros(0, np.int64)
    last = (v & 32) == 0
    first = np.append(True, last[:-1])
    begin = np.flatnonzero(first)
    of = np.cumsum(first) - 1
    place = np.arange(len(v)) - begin[of]
    x = np.add.reduceat((v & 31) << 5 * place, begin)
    end = np.flatnonzero(last)
    x = np.where(v[end] & 16, x | np.int64(-1) << 5 * (place[end] + 1), x)
    x[1::2] = np.cumsum(x[1::2])
    x[2::2] = np.cumsum(x[2::2])
    return x


def _points(flat) -> np.ndarray:
    return np.asarray(flat, float).reshape(-1, 2)


def _flat_shapes(value) -> list:
    """Shapes of a segmentation: lists of rings as they are written, or a run-length dict."""
    if isinstance(value, dict):
        if "counts" in value:
            return [value]
        return [[value.get("exterior") or [], *(value.get("interiors") or [])]]
    if value and isinstance(value[0], (int, float)):
        return [[value]]
    return [s for v in value or [] for s in _flat_shapes(v)]


def shapes_of(value) -> list:
    """Shapes of a segmentation: lists of rings (even-odd within a shape), or a run-length dict."""
    return [s if isinstance(s, dict) else [_points(r) for r in s] for s in _flat_shapes(value)]


def of_segmentation(text: str | None, width: int, height: int) -> Runs:
    """The mask of a segmentation in JSON: polygons (flat lists, or dicts of exterior and interiors) or run lengths (list or text).

    Several shapes are united. Run lengths have a size of their own; of another
    size than the image's they are cut to it. Null is nothing.
    """
    if text is None:
        return NOTHING
    parts = []
    for shape in shapes_of(json.loads(text)):
        if isinstance(shape, dict):
            counts = shape["counts"]
            runs = from_counts(from_text(counts) if isinstance(counts, str) else np.asarray(counts, np.int64), int(shape["size"][0]))
            keep = (runs[0] < width) & (runs[1] < height)
            parts.append((runs[0][keep], runs[1][keep], np.minimum(runs[2][keep], height)))
        else:
            parts.append(fill(shape, width, height))
    return union(*(np.concatenate(p) for p in zip(*parts))) if parts else NOTHING


def spans(n: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Stretches of consecutive items of sizes ``n`` of at most so much together, or of one item."""
    ends, first = np.cumsum(n), 0
    while first < len(n):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + most, "right")))
        yield first, last
        first = last


def of_segmentations(texts: list, widths: list, heights: list) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The masks of :func:`of_segmentation` of many segmentations at once: pieces ``row, line, start, stop``.

    All polygons of a piece are filled together. A row that has pixels is whole in
    one piece, in order of line and start, and rows ascend in a piece.
    """
    w, h = np.asarray(widths, np.int64), np.asarray(heights, np.int64)
    coded, rings, shape_of, row_of = [], [], [], []
    for i, text in enumerate(texts):
        shapes = [] if text is None else _flat_shapes(json.loads(text))
        if any(isinstance(s, dict) for s in shapes):
            coded.append(i)
            continue
        for shape in shapes:
            for ring in shape:
                ring = list(chain.from_iterable(ring)) if ring and isinstance(ring[0], (list, tuple)) else ring
                if len(ring) % 2:
                    raise ValueError("a ring of a polygon has an odd number of coordinates")
                if len(ring) >= 6:
                    rings.append(ring)
                    shape_of.append(len(row_of))
            row_of.append(i)
    for i in coded:
        found = of_segmentation(texts[i], widths[i], heights[i])
        yield np.full(len(found[0]), i, np.int64), *found
    if not rings:
        return
    n = np.fromiter(map(len, rings), np.int64, len(rings)) // 2
    xy = np.asarray(list(chain.from_iterable(rings)), float)
    x1, y1 = xy[::2], xy[1::2]
    after, last = np.arange(1, len(x1) + 1), np.cumsum(n)
    after[last - 1] = last - n
    x2, y2 = x1[after], y1[after]
    swap = x1 > x2
    x1, x2, y1, y2 = np.where(swap, x2, x1), np.where(swap, x1, x2), np.where(swap, y2, y1), np.where(swap, y1, y2)
    shape = np.repeat(np.asarray(shape_of, np.int64), n)
    row = np.asarray(row_of, np.int64)
    begin = np.clip(np.ceil(x1 - 0.5), 0, w[row[shape]]).astype(np.int64)
    end = np.clip(np.ceil(x2 - 0.5), 0, w[row[shape]]).astype(np.int64)
    some = end > begin
    shape, begin, n, x1, x2, y1, y2 = shape[some], begin[some], (end - begin)[some], x1[some], x2[some], y1[some], y2[some]
    if not len(n):
        return
    slope = (y2 - y1) / (x2 - x1)
    starts = np.flatnonzero(np.diff(row[shape], prepend=-1))
    across, down = int(w.max()).bit_length(), int(h.max()).bit_length()
    for a, b in spans(np.add.reduceat(n, starts), HELD):
        lo, hi = starts[a], starts[b] if b < len(starts) else len(n)
        base, many = shape[lo], n[lo:hi]
        edge = np.repeat(np.arange(lo, hi), many)
        column = np.arange(len(edge)) + np.repeat(begin[lo:hi] - np.cumsum(many) + many, many)
        y = y1[edge] + (column + 0.5 - x1[edge]) * slope[edge]
        at = np.clip(np.ceil(y - 0.5), 0, h[row[shape[edge]]]).astype(np.int64)
        crossing = (shape[edge] - base << across | column) << down | at  # what sorts by shape, column and place
        crossing.sort()
        cell, at = crossing >> down, crossing & (1 << down) - 1
        start, stop = at[::2], at[1::2]
        some = stop > start
        cell = cell[::2][some]
        place = row[base + (cell >> across)]
        lines, start, stop = union(place - place[:1] << across | cell & (1 << across) - 1, start[some], stop[some])
        yield (lines >> across) + place[:1], lines & (1 << across) - 1, start, stop


def to_texts(row: np.ndarray, runs: Runs, widths: np.ndarray, heights: np.ndarray) -> list[str]:
    """The texts of :func:`to_text` of the counts of many masks: a text for each width and height, whose runs have its place as ``row``, in order."""
    n, h = len(widths), heights[row]
    a, b = runs[0] * h + runs[1], runs[0] * h + runs[2]
    joined = np.zeros(len(a), bool)
    joined[1:] = (a[1:] == b[:-1]) & (row[1:] == row[:-1])
    a, row, b = a[~joined], row[~joined], b[np.append(~joined[1:], True)] if len(b) else b
    k = 2 * np.bincount(row, minlength=n)
    first = np.cumsum(k + 1) - k - 1
    ends = np.repeat((widths * heights).astype(np.int64), k + 1)
    inside = np.ones(len(ends), bool)
    inside[first + k] = False
    ends[inside] = np.column_stack([a, b]).ravel()
    counts = np.diff(ends, prepend=0)
    counts[first] = ends[first]
    full = (counts[first + k] == 0) & (k > 0)
    keep = np.ones(len(counts), bool)
    keep[(first + k)[full]] = False
    counts, k = counts[keep], k + 1 - full
    first = np.cumsum(k) - k
    x, nth = counts.copy(), np.arange(len(counts)) - np.repeat(first, k)
    late = np.flatnonzero(nth > 2)
    x[late] -= counts[late - 2]
    places, values, at, step = [], [], np.arange(len(x)), 0
    while len(at):
        low = x & 31
        x = x >> 5
        more = np.where(low & 16, x != -1, x != 0)
        places.append(at << 4 | step)
        values.append(low | more.astype(np.int64) << 5)
        at, x, step = at[more], x[more], step + 1
    place = np.concatenate(places)
    order = np.argsort(place, kind="stable")
    text = (np.concatenate(values)[order] + 48).astype(np.uint8).tobytes().decode("ascii")
    cut = np.searchsorted(place[order] >> 4, np.append(first, len(counts))).tolist()
    return [text[i:j] for i, j in zip(cut, cut[1:])]


def from_texts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The counts of :func:`from_text` of many texts, one after another, and where those of each begin, with the end."""
    v = np.frombuffer("".join(texts).encode("ascii"), np.uint8).astype(np.int64) - 48
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    last = (v & 32) == 0
    if not last[ends[ends > 0] - 1].all():
        raise ValueError("a run-length text ends within a count")
    end = np.flatnonzero(last)
    begin = np.append(0, end + 1)[: len(end)]
    at = np.append(0, np.searchsorted(end, ends))
    if not len(end):
        return np.zeros(0, np.int64), at
    place = np.arange(len(v)) - np.repeat(begin, end - begin + 1)
    x = np.add.reduceat((v & 31) << 5 * place, begin)
    x = np.where(v[end] & 16, x | np.int64(-1) << 5 * (place[end] + 1), x)
    k = np.diff(at)
    nth = np.arange(len(x)) - np.repeat(at[:-1], k)
    text = np.repeat(np.arange(len(texts)), k)
    for part in (np.flatnonzero(nth % 2 == 1), np.flatnonzero((nth % 2 == 0) & (nth > 0))):
        so_far, new = np.cumsum(x[part]), np.diff(text[part], prepend=-1) != 0
        before = (so_far - x[part])[new]
        x[part] = so_far - before[np.cumsum(new) - 1] if len(part) else so_far
    return x, at
