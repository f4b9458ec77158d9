"""Shapes of polygons: convex hull and smallest box at any angle, of one polygon at a time."""

from __future__ import annotations

import math

Point = tuple[float, float]


def _turn(o: Point, a: Point, b: Point) -> float:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def area(ring: list[Point]) -> float:
    """Area inside of a simple ring by the shoelace rule."""
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, [*ring[1:], *ring[:1]]))) / 2


def length(ring: list[Point]) -> float:
    return sum(math.dist(a, b) for a, b in zip(ring, [*ring[1:], *ring[:1]]))


def hull(points: list[Point]) -> list[Point]:
    """Corners of the convex hull in order, by a monotone chain: points by x, a lower and an upper side that only turn left."""
    left = sorted(set(points))
    if len(left) < 3:
        return left
    sides = []
    for ordered in (left, left[::-1]):
        side: list[Point] = []
        for p in ordered:
            while len(side) > 1 and _turn(side[-2], side[-1], p) <= 0:
                side.pop()
            side.append(p)
        sides += side[:-1]
    return sides


def smallest_box(corners: list[Point]) -> tuple[float, float]:
    """Longer and shorter side of the smallest box around a convex polygon (corners of :func:`hull`).

    A side of that box lies on an edge. While the edge goes round, the corners
    that are farthest along it, across it and back only move on (rotating
    calipers), so all edges take one round of the corners.
    """
    n = len(corners)
    if n == 0:
        return 0.0, 0.0
    if n < 3:
        return math.dist(corners[0], corners[-1]), 0.0
    best = (math.inf, 0.0, 0.0)
    right = top = left = 0
    for i in range(n):
        (x0, y0), (x1, y1) = corners[i], corners[(i + 1) % n]
        size = math.hypot(x1 - x0, y1 - y0)
        ux, uy = (x1 - x0) / size, (y1 - y0) / size

        def along(k: int) -> float:
            return corners[k % n][0] * ux + corners[k % n][1] * uy

        def across(k: int) -> float:
            return corners[k % n][1] * ux - corners[k % n][0] * uy

        right = max(right, i + 1)
        while along(right + 1) > along(right):
            right += 1
        top = max(top, right)
        while across(top + 1) > across(top):
            top += 1
        left = max(left, top)
        while along(left + 1) < along(left):
            left += 1
        wide, high = along(right) - along(left), across(top) - across(i)
        best = min(best, (wide * high, max(wide, high), min(wide, high)))
    return best[1], best[2]
