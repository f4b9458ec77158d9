"""SimHash near-duplicates through deletion-variant signatures.

Two fingerprints of 64 bits that differ in at most three bits, cut into two
halves, have one half that differs in at most one bit. Each half is therefore
indexed under 32 variants, each with one bit position taken out; two
fingerprints meet under an equal variant, and the whole distance is verified.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower_words, connected_components, forget, hot_keys, materialize, maybe_broadcast, skewed_join, small_batches, with_row_key

SHINGLE = 3
SEED = 42
MAX_BITS = 3
#: Buckets up to this many different fingerprints are joined with themselves.
PLAIN_BUCKET = 48
#: Parts of a larger bucket up to this many are chained in one task; beyond it they are divided further.
CHAIN = 4096
#: Fingerprints whose variants one task makes.
TASK_FPS = 16_384


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a UTF-8 text over word shingles; 0 for a text without words."""
    import xxhash

    words = ascii_lower_words(text)
    if not words:
        return 0
    if len(words) < shingle:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    n = max(1, len(words) - shingle + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 65536):
        block = hashes[i : i + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Rows ``id, fp`` (long, the fingerprint's bits) of every document; a null text has no words."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t"))

    def run(batches):
        for b in batches:
            fps = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", shingle) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["id", "fp"])

    id_type = rows.schema["id"].dataType.simpleString()
    return small_batches(rows).mapInArrow(run, f"id {id_type}, fp long")


def _variants(fps: DataFrame) -> DataFrame:
    """Rows ``key, fp``: 64 one-wildcard variants of each fingerprint, the half and bit position in the low six bits."""
    keys = []
    for half in range(2):
        part = F.shiftrightunsigned("fp", 32) if half == 0 else F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
        for bit in range(32):
            held = part.bitwiseAND(F.lit(0xFFFFFFFF ^ (1 << bit)))
            keys.append(F.shiftleft(held, 6).bitwiseOR(F.lit(half * 32 + bit).cast("long")))
    return fps.select(F.explode(F.array(*keys)).alias("key"), "fp")


def _chain(key_rows):
    """A spanning forest of the fingerprints of one bucket, as rows a, b."""
    fps = np.unique(key_rows["fp"].to_numpy()).view(np.uint64)
    left = np.ones(len(fps), bool)
    a, b = [], []
    for start in range(len(fps)):
        if not left[start]:
            continue
        left[start] = False
        todo = [start]
        while todo:
            k = todo.pop()
            rest = np.flatnonzero(left)
            if not len(rest):
                break
            near = rest[np.bitwise_count(fps[rest] ^ fps[k]) <= MAX_BITS]
            left[near] = False
            a += [k] * len(near)
            b += near.tolist()
            todo += near.tolist()
    signed = fps.view(np.int64)
    import pandas as pd

    return pd.DataFrame({"a": signed[np.array(a, np.int64)], "b": signed[np.array(b, np.int64)]})


def _parts(members: DataFrame, nibbles: int) -> DataFrame:
    """``key, piece, fp``: members of large buckets under what they must share of their other half.

    Of its eight nibbles at most three differ, so two fingerprints that link
    share at least five. ``piece`` is one of two neighbouring nibbles (a byte:
    one of four is shared), or one of the 56 choices of five.
    """
    first_half = F.col("key").bitwiseAND(F.lit(63)) < 32
    other = F.when(first_half, F.col("fp")).otherwise(F.shiftrightunsigned("fp", 32))
    choices = [(i, i + 1) for i in range(0, 8, 2)] if nibbles == 2 else list(combinations(range(8), nibbles))
    pieces = [
        other.bitwiseAND(F.lit(sum(15 << 4 * k for k in c))).bitwiseOR(F.lit(i << 32).cast("long")) for i, c in enumerate(choices)
    ]
    return members.select("key", F.explode(F.array(*pieces)).alias("piece"), "fp")


def links(fps: DataFrame) -> DataFrame:
    """Links ``a, b`` that keep every component of different fingerprints ``fp`` within three bits.

    Buckets of two are compared as they are aggregated; buckets up to
    ``PLAIN_BUCKET`` by an equality join; larger ones, as a large group of near
    copies makes, are divided by the bytes of their other half (three differing
    bits leave one of four bytes equal) and give a spanning forest instead of
    all their pairs, so rows grow with a group's size and not its square. Parts
    of more than ``CHAIN`` are divided by five nibbles of that half: such a part
    shares 51 of 64 bits, so it has 8192 members at most. Repeated rows don't
    matter; an empty table gives an empty one.
    """
    spark = fps.sparkSession
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = fps.repartition(max(shuffled, -(-fps.count() // TASK_FPS)), "fp")
    variants = _variants(dealt).repartition(max(shuffled, -(-fps.count() // (4 * TASK_FPS))), "key")  # hardly any repeat within a task
    counted = variants.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")
    counted = materialize(counted, "simhash-buckets")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS
    found = counted.where("n = 2").where(near).select("a", "b")

    more = counted.where("n > 2").select("key", "n")
    if more.isEmpty():
        return materialize(found, "simhash-links")
    members, sizes = materialize(_variants(dealt).join(maybe_broadcast(more), "key"), "simhash-members"), None
    some = members.where(f"n <= {PLAIN_BUCKET}").select("key", "fp")
    pairs = some.withColumnRenamed("fp", "a").join(some.withColumnRenamed("fp", "b"), "key").where("a < b")
    found = found.union(pairs.where(near).select("a", "b"))

    large = members.where(f"n > {PLAIN_BUCKET}").select("key", "fp")
    if not large.isEmpty():
        parts = _parts(large, 2)
        sizes = materialize(parts.groupBy("key", "piece").count(), "simhash-parts")
        small = parts.join(sizes.where(F.col("count") <= CHAIN).select("key", "piece"), ["key", "piece"])
        found = found.union(small.groupBy("key", "piece").applyInPandas(_chain, "a long, b long"))
        beyond = sizes.where(F.col("count") > CHAIN).select("key", "piece")
        if not beyond.isEmpty():
            crowded = parts.join(beyond, ["key", "piece"]).select("key", "fp").distinct()
            found = found.union(_parts(crowded, 5).groupBy("key", "piece").applyInPandas(_chain, "a long, b long"))
    found = materialize(found, "simhash-links")
    forget(counted, members, sizes)
    return found


def _groups(each: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``fp, root`` of the fingerprints of ``each`` (``fp`` of a row) that link with others, and ``fp, n`` of all."""
    fps = materialize(each.groupBy("fp").agg(F.count("*").alias("n")), "simhash-fps")
    edges = links(fps.select("fp"))
    comps = connected_components(edges).select(F.col("node").alias("fp"), "root")
    forget(edges)
    return comps, fps


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Every document's SimHash and near-duplicate component.

    Returns one row per input row: the id column, ``fingerprint`` (16 hex
    digits) and ``component_id``, the least id reachable through links of at
    most three bits, itself included. Texts that are null, empty or without
    words have fingerprint zero and link like any other. Repeated rows stay
    repeated. A null id is passed over when a least id is sought (null only if a
    component has no other). An empty table gives an empty one. Columns besides
    the two named are not read.
    """
    each = materialize(fingerprints(docs, id_col, text_col, shingle), "simhash-docs")
    comps, fps = _groups(each)
    least = each.groupBy("fp").agg(F.min("id").alias("least"))
    of = comps.join(least, "fp")
    roots = materialize(of.groupBy("root").agg(F.min("least").alias("comp"), F.count("*").alias("n")), "simhash-roots")
    moved = skewed_join(of, roots.select("root", "comp"), ["root"], hot_keys(roots, ["root"]), "fp").select("fp", "comp")
    known = least.join(moved, "fp", "left").select("fp", F.coalesce("comp", "least").alias("component_id"))
    return skewed_join(each, known, ["fp"], hot_keys(fps, ["fp"]), "id").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the one with the least id.

    Rows are told apart by numbers of their own, so each has its own decision:
    of rows that share an id, in one group or in several, one stays for each
    group; a null id comes after all others, and of equal ids the row whose text
    hashes lowest stays. Null, empty and wordless texts are one group. Further
    columns pass through, whatever their names; an empty table gives an empty one.
    """
    rows, row = with_row_key(docs, "simhash-input")
    text = F.col(text_col).cast("binary")
    prints = rows.select(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), F.col(row).alias("row")).alias("key"), text.alias("text"))
    each = materialize(fingerprints(prints, "key", "text").select(F.col("id").alias("key"), "fp"), "simhash-docs")
    comps, fps = _groups(each)
    first = each.groupBy("fp").agg(F.min("key").alias("first"))
    grouped = first.join(comps, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("kept"))
    kept = grouped.select(F.col("kept.row").alias(row))
    gone = materialize(each.select(F.col("key.row").alias(row)).join(kept, row, "left_anti"), "simhash-gone")
    forget(each, fps, comps)
    return rows.join(maybe_broadcast(gone), row, "left_anti").select(*docs.columns)
