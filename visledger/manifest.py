"""The manifest: an immutable bundle of Spark tables.

Tables and their known columns (further attributes travel in ``extra``, a JSON
string, so every operator keeps what it doesn't know):

=====================  =====================================================
categories             id, name, supercategory, alias, keypoints
keypoint_categories    id, name, reflection_id
videos                 id, name, caption
images                 id, name, file_name, video_id, frame_index, timestamp, width, height, channels, assets
tracks                 id, name
annotations            id, image_id, category_id, track_id, bbox, segmentation, keypoints, score, weight, iscrowd, prob, extra
=====================  =====================================================
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BBOX = "struct<x:double,y:double,w:double,h:double>"
KEYPOINTS = "array<struct<x:double,y:double,visible:int,keypoint_category_id:bigint>>"
ASSETS = "array<struct<file_name:string,channels:string,width:bigint,height:bigint>>"

SCHEMAS = {
    "categories": "id bigint, name string, supercategory string, alias array<string>, keypoints array<string>, extra string",
    "keypoint_categories": "id bigint, name string, reflection_id bigint, extra string",
    "videos": "id bigint, name string, caption string, extra string",
    "images": "id bigint, name string, file_name string, video_id bigint, frame_index bigint, timestamp timestamp, "
    f"width bigint, height bigint, channels string, assets {ASSETS}, extra string",
    "tracks": "id string, name string, extra string",
    "annotations": f"id bigint, image_id bigint, category_id bigint, track_id string, bbox {BBOX}, segmentation string, "
    f"keypoints {KEYPOINTS}, score double, weight double, iscrowd int, prob array<double>, extra string",
}
TABLES = tuple(SCHEMAS)


@dataclass(frozen=True)
class Manifest:
    """Six tables, the folder that their paths are relative to, and free information about the whole."""

    categories: DataFrame
    keypoint_categories: DataFrame
    videos: DataFrame
    images: DataFrame
    tracks: DataFrame
    annotations: DataFrame
    root: str = ""
    info: dict = field(default_factory=dict)

    def with_tables(self, **tables: DataFrame) -> "Manifest":
        return replace(self, **tables)

    def table(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise KeyError(f"no table {name!r}; there are {', '.join(TABLES)}")
        return getattr(self, name)

    def only(self, name: str, *columns: str) -> DataFrame:
        """Some columns of a table; a manifest that makes its tables when asked makes no others where it can."""
        return self.table(name).select(*columns)

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in TABLES}

    def register(self, prefix: str = "") -> None:
        """Make every table a temporary view, so that ``spark.sql`` reads it."""
        for name, df in self.tables().items():
            df.createOrReplaceTempView(prefix + name)


class DeferredManifest(Manifest):
    """A manifest whose tables are made when they are asked for, each once.

    ``makers`` has a function for each table; so a caller who wants the names of
    images doesn't pay for the numbers of annotations. ``parts`` has functions
    that make some columns of a table (:meth:`only`).
    """

    def __init__(self, makers: dict[str, Callable[[], DataFrame]], root: str = "", info: dict | None = None, parts: dict[str, Callable[..., DataFrame]] | None = None):
        for name, value in (("makers", makers), ("root", root), ("info", info or {}), ("parts", parts or {})):
            object.__setattr__(self, name, value)

    def only(self, name: str, *columns: str) -> DataFrame:
        part = self.parts.get(name)
        return self.table(name).select(*columns) if part is None or name in self.__dict__ else part(columns).select(*columns)

    def __getattr__(self, name: str):
        if name not in TABLES:
            raise AttributeError(name)
        made = self.makers[name]()
        object.__setattr__(self, name, made)
        return made

    def with_tables(self, **tables: DataFrame) -> "Manifest":
        rest = {name: functools.partial(getattr, self, name) for name in TABLES if name not in tables}
        return DeferredManifest(rest | {n: functools.partial(lambda df: df, df) for n, df in tables.items()}, self.root, self.info)


def empty(spark: SparkSession) -> Manifest:
    return Manifest(**{name: spark.createDataFrame([], ddl) for name, ddl in SCHEMAS.items()})


def conform_table(df: DataFrame, name: str) -> DataFrame:
    """Bring a table to its known columns; others are gathered into ``extra``, absent ones are null."""
    from pyspark.sql.types import StructType

    want = StructType.fromDDL(SCHEMAS[name]) if hasattr(StructType, "fromDDL") else df.sparkSession.createDataFrame([], SCHEMAS[name]).schema
    known = {f.name for f in want}
    others = [c for c in df.columns if c not in known]
    cols = []
    for f in want:
        if f.name == "extra" and others:
            had = [F.col("extra")] if "extra" in df.columns else []
            cols.append(F.coalesce(*had, F.to_json(F.struct(*others))).alias("extra"))
        elif f.name in df.columns:
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return df.select(*cols)


def from_rows(spark: SparkSession, data: dict[str, list[dict]], root: str = "") -> Manifest:
    """A manifest from lists of dicts, as one JSON document holds them; unknown tables are ignored."""
    from .sources.documents import rows_to_table

    return Manifest(**{name: rows_to_table(spark, data.get(name) or [], name) for name in TABLES}, root=root, info=data.get("info") or {})
