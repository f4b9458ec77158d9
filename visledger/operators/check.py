"""Validation: every check is a query whose rows are the problems found."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..manifest import Manifest
from .select import assets, channel_list

#: Table, column and whether a value is required.
UNIQUE = (
    ("categories", "id", True), ("categories", "name", True), ("videos", "id", True), ("videos", "name", True),
    ("images", "id", True), ("images", "name", False), ("images", "file_name", False), ("annotations", "id", True), ("tracks", "id", True),
    ("tracks", "name", True), ("keypoint_categories", "id", True), ("keypoint_categories", "name", True),
)
#: Child table, column, parent table, and how bad a value without a parent is.
POINTERS = (
    ("annotations", "category_id", "categories", "error"), ("annotations", "image_id", "images", "error"),
    ("images", "video_id", "videos", "warning"), ("annotations", "track_id", "tracks", "warning"),
)


def not_unique(df: DataFrame, col: str, required: bool = True) -> DataFrame:
    """``value, n``: values of a column that occur more than once, and null if it is required."""
    bad = (F.col("n") > 1) & F.col("value").isNotNull()
    if required:
        bad = bad | F.col("value").isNull()
    return df.groupBy(F.col(col).cast("string").alias("value")).agg(F.count("*").alias("n")).where(bad)


def missing_values(df: DataFrame, cols: list[str]) -> DataFrame:
    """``attribute, n``: columns with nulls."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("attribute"), F.col(c).alias("n")) for c in cols]))
    return counts.select(rows.alias("r")).select("r.*").where("n > 0")


def dangling(m: Manifest, child: str, col: str, parent: str) -> DataFrame:
    """``value, n``: values of a pointer without a row to point to; null points nowhere and is no fault."""
    c = m.table(child).where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n"))
    return c.join(m.table(parent).select(F.col("id").alias("value")), "value", "left_anti").select(F.col("value").cast("string").alias("value"), "n")


def repeated_channels(m: Manifest) -> DataFrame:
    """``image_id, channel, n``: channels that an image's files hold more than once."""
    c = assets(m.images).select("image_id", F.explode(channel_list(F.col("channels"))).alias("channel"))
    return c.groupBy("image_id", "channel").agg(F.count("*").alias("n")).where("n > 1")


def outside_paths(m: Manifest) -> DataFrame:
    """``image_id, file_name`` of files with an absolute path or one that leaves the folder."""
    f = F.col("file_name")
    return assets(m.images).where(f.startswith("/") | F.array_contains(F.split(f, "/"), "..")).select("image_id", "file_name")


def unnamed_images(m: Manifest) -> DataFrame:
    """Images that neither a file nor a name with assets identifies."""
    named = F.col("file_name").isNotNull() | (F.col("name").isNotNull() & (F.coalesce(F.size("assets"), F.lit(0)) > 0))
    return m.images.where(~named).select("id")


def unused_tracks(m: Manifest) -> DataFrame:
    """Tracks of the table that no annotation names."""
    seen = m.annotations.where("track_id is not null").select(F.col("track_id").alias("id"))
    return m.tracks.join(seen, "id", "left_anti").select("id")


def validate(m: Manifest) -> DataFrame:
    """All checks: ``level, what, value, n``, one row for each problem."""
    found = []

    def add(level: str, what: str, rows: DataFrame) -> None:
        found.append(rows.select(F.lit(level).alias("level"), F.lit(what).alias("what"), F.col("value").cast("string"), F.col("n").cast("long")))

    for table, col, required in UNIQUE:
        add("error", f"{table}.{col} is not unique", not_unique(m.table(table), col, required))
    for child, col, parent, level in POINTERS:
        add(level, f"{child}.{col} points nowhere", dangling(m, child, col, parent))
    one = F.lit(1).alias("n")
    add("error", "a channel twice", repeated_channels(m).select(F.concat_ws(":", "image_id", "channel").alias("value"), "n"))
    add("warning", "path outside of the folder", outside_paths(m).select(F.col("file_name").alias("value"), one))
    add("error", "image without name", unnamed_images(m).select(F.col("id").alias("value"), one))
    add("warning", "unused track", unused_tracks(m).select(F.col("id").alias("value"), one))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def difference(a: DataFrame, b: DataFrame, digits: int = 6) -> DataFrame:
    """Rows of one table that the other lacks, doubles rounded: ``side`` and the columns as JSON."""

    def plain(df):
        cols = [F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes]
        return df.select(F.to_json(F.struct(*sorted(cols, key=str))).alias("row"))

    x, y = plain(a), plain(b)
    return x.exceptAll(y).select(F.lit("left").alias("side"), "row").unionByName(y.exceptAll(x).select(F.lit("right").alias("side"), "row"))
