"""Files behind a manifest: which are there, how large they are, which are damaged.

Folders are listed by Spark's ``binaryFile`` source, so any store that Spark
reads will do; contents are read only where they are asked for.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..manifest import Manifest
from ..storage import open_shared
from .select import assets

#: First and last bytes of image files by ending (fixed by the formats), as hexadecimal text.
SIGNATURES = {
    "png": ("89504E470D0A1A0A", "49454E44AE426082"),
    "jpg": ("FFD8FF", "FFD9"),
    "jpeg": ("FFD8FF", "FFD9"),
    "gif": ("47494638", "3B"),
    "bmp": ("424D", ""),
    "tif": ("49492A00", ""),
}


def present(spark: SparkSession, folder: str) -> DataFrame:
    """``file_name, bytes`` of all files below a folder, names relative to it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    top = F.lit(folder.rstrip("/") + "/")
    name = F.substring(F.col("path"), F.instr("path", top) + F.length(top), F.length("path"))
    return files.select(name.alias("file_name"), F.col("length").alias("bytes"))


def missing(m: Manifest, there: DataFrame) -> DataFrame:
    """``image_id, file_name`` of registered files that aren't among ``there``."""
    return assets(m.images).select("image_id", "file_name").join(there.select("file_name"), "file_name", "left_anti").select("image_id", "file_name")


def disk_usage(m: Manifest, there: DataFrame) -> DataFrame:
    """One row ``files, bytes, missing``: each file counted once."""
    names = assets(m.images).select("file_name").distinct()
    seen = names.join(there, "file_name", "left")
    return seen.agg(F.count("bytes").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.count_if(F.col("bytes").isNull()).alias("missing"))


def damaged(spark: SparkSession, folder: str) -> DataFrame:
    """``file_name`` of files whose first or last bytes are not those of their ending's format; other endings pass.

    Each file is opened in a task and nothing but its two ends is read.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    top = F.lit(folder.rstrip("/") + "/")
    name = F.substring(F.col("path"), F.instr("path", top) + F.length(top), F.length("path"))
    known = listed.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*SIGNATURES)).select("path", "length", name.alias("file_name"))

    def run(batches):
        for b in batches:
            bad = []
            for path, size, short in zip(*(c.to_pylist() for c in b.columns)):
                first, last = (bytes.fromhex(x) for x in SIGNATURES[path.rpartition(".")[2].lower()])
                with open_shared(path, "rb") as f:
                    head = f.read(len(first))
                    f.seek(max(0, size - len(last)))
                    if head != first or f.read(len(last)) != last:
                        bad.append(short)
            yield pa.RecordBatch.from_arrays([pa.array(bad, pa.string())], ["file_name"])

    return known.mapInArrow(run, "file_name string")


def drop_files(m: Manifest, gone: DataFrame) -> Manifest:
    """Without the files ``file_name`` among images' own and assets; images left without any file go, with their annotations."""
    from .edit import remove_images

    names = gone.select("file_name").distinct()
    held = assets(m.images).join(names, "file_name", "left_anti")
    nothing = m.images.select("id").join(held.select(F.col("image_id").alias("id")), "id", "left_anti")
    left = held.groupBy("image_id").agg(F.collect_set("file_name").alias("_held"))
    im = m.images.join(left.withColumnRenamed("image_id", "id"), "id", "left")
    im = im.withColumns({
        "file_name": F.when(F.array_contains("_held", F.col("file_name")), F.col("file_name")),
        "assets": F.filter("assets", lambda a: F.array_contains("_held", a["file_name"])),
    }).select(*m.images.columns)
    return remove_images(m.with_tables(images=im), nothing)
