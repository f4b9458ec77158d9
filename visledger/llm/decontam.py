"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The alphabet is whole words. A block of two words selects how far the search
may move on; blocks that end some test window select a bucket of windows, which
are compared word by word.
"""

from __future__ import annotations

import hashlib
import pickle
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialize, small_batches, with_row_key

WINDOW = 10
BLOCK = 2
#: Bytes of the search tables that a worker holds at a time; larger benchmarks are searched portion after portion.
TABLE_BYTES = 64 << 20
#: Words of an item that stay together in one portion (with the words that a window needs beyond them).
PIECE = 2048
#: Bytes of the tables for each word of a portion (its number, its window's start, holders and slots), and beside the letters of each different word.
WORD_BYTES, VOCABULARY_BYTES = 48, 130

#: ASCII letters and digits (upper case lowered) and all bytes from 0x80 stay; the rest becomes a space.
_FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text: runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z."""
    return (text or b"").translate(_FOLD).split()


class WuManber:
    """Search tables for word windows of one length, in flat arrays.

    ``text`` has the numbers of all words of the portion, ``starts`` a place in
    it for each different window. A block of words is hashed to a slot; of each
    slot, ``shift`` has the least distance from such a block to the end of a
    window, and ``heads`` the bucket of the windows that end with such a block,
    sorted by content. ``owners`` and ``holders`` list the items of each window.
    """

    def __init__(self, text: np.ndarray, begins: np.ndarray, items: np.ndarray, length: int):
        self.length, self.block = length, min(BLOCK, length)
        self.far = length - self.block + 1
        windows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(text, length)[begins])
        content = windows.view(np.dtype((np.void, 4 * length))).ravel()
        _, first, which = np.unique(content, return_index=True, return_inverse=True)
        self.mask = (1 << int(2 * len(first)).bit_length()) - 1
        slot = self._slots(windows[first, length - self.block], windows[first, length - 1])
        order = np.lexsort((np.arange(len(first)), slot))  # np.unique has sorted the contents
        self.starts = begins[first[order]].astype(np.int32)
        self.heads = np.searchsorted(slot[order], np.arange(self.mask + 2)).astype(np.int32)
        place = np.empty(len(first), np.int64)
        place[order] = np.arange(len(first))
        pairs = np.unique(np.stack([place[which.ravel()], items], 1), axis=0)
        self.owners = np.searchsorted(pairs[:, 0], np.arange(len(first) + 1)).astype(np.int32)
        self.holders = pairs[:, 1].astype(np.int32)
        shift = np.full(self.mask + 1, self.far, np.uint8)
        for end in range(self.block, length + 1):
            np.minimum.at(shift, self._slots(windows[:, end - self.block], windows[:, end - 1]), np.uint8(length - end))
        self.shift = shift.tobytes()

    def _slots(self, a, b):
        return (a.astype(np.int64) * 0x9E3779B1 + b.astype(np.int64) * 0x85EBCA77) & self.mask

    def nbytes(self) -> int:
        return len(self.shift) + sum(x.nbytes for x in (self.starts, self.heads, self.owners, self.holders))

    def find(self, words: list[bytes], number, text: bytes):
        """Starts of windows in ``words`` with the numbers of the items that hold them; ``number`` gives a word's, ``text`` is the portion's as bytes."""
        n, m, far, shift, mask, back = len(words), self.length, self.far, self.shift, self.mask, self.block
        starts, heads, size = self.starts, self.heads, 4 * self.length
        end = m
        while end <= n:
            a, b = number(words[end - back]), number(words[end - 1])
            if b is None:  # no window holds this word
                end += m
                continue
            if a is None:
                end += far
                continue
            slot = (a * 0x9E3779B1 + b * 0x85EBCA77) & mask
            move = shift[slot]
            if move:
                end += move
                continue
            ids = [number(w) for w in words[end - m : end]]
            if None not in ids:
                here, lo, hi = np.array(ids, np.int32).tobytes(), int(heads[slot]), int(heads[slot + 1])
                at = bisect_left(range(hi - lo), here, key=lambda i: text[4 * starts[lo + i] : 4 * starts[lo + i] + size]) + lo
                if at < hi and text[4 * starts[at] : 4 * starts[at] + size] == here:
                    yield end - m, self.holders[self.owners[at] : self.owners[at + 1]]
            end += 1


class Tables:
    """Search tables of one portion: a vocabulary, the portion's words by number, and a machine for each window length."""

    def __init__(self, pieces: list[tuple[str, int, list[bytes]]]):
        """``pieces``: item, window length, words; every run of so many words is a window."""
        numbers: dict[bytes, int] = {}
        names: dict[str, int] = {}
        flat, by_length, at = [], {}, 0
        for item, size, words in pieces:
            flat += [numbers.setdefault(w, len(numbers)) for w in words]
            begins = np.arange(at, at + len(words) - size + 1)
            by_length.setdefault(size, []).append((begins, np.full(len(begins), names.setdefault(item, len(names)))))
            at += len(words)
        text = np.array(flat, np.int32)
        self.words, self.items = list(numbers), list(names)
        self.text = text.tobytes()
        self.machines = [
            WuManber(text, np.concatenate([b for b, _ in found]), np.concatenate([i for _, i in found]), size)
            for size, found in sorted(by_length.items())
        ]
        self.number = numbers

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "number"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.number = dict(zip(self.words, range(len(self.words))))

    def nbytes(self) -> int:
        """About what the tables take in memory."""
        vocabulary = sum(VOCABULARY_BYTES + len(w) for w in self.words) + sum(60 + len(x) for x in self.items)
        return vocabulary + len(self.text) + sum(m.nbytes() for m in self.machines)

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit stretches of ``words`` and the items whose windows hit."""
        marks, held = [], set()
        for machine in self.machines:
            for start, found in machine.find(words, self.number.get, self.text):
                marks.append((start, start + machine.length))
                held.update(found.tolist())
        return _merged(marks), {self.items[i] for i in held}


def _merged(marks: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[list[int]] = []
    for start, stop in sorted(marks):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], stop)
        else:
            merged.append([start, stop])
    return [(s, e) for s, e in merged]


def cut(item: str | None, text: bytes | None, window: int = WINDOW, piece: int | None = None) -> list[tuple[str, int, list[bytes]]]:
    """Pieces of an item whose windows are together those of the item; a null item id is an empty string."""
    words, piece = words_of(text), piece or PIECE
    size = min(window, len(words))
    return [(item or "", size, words[i : i + piece + size - 1]) for i in range(0, len(words) - size + 1, piece)] if words else []


def build(items: list[tuple], window: int = WINDOW) -> Tables:
    """Search tables of (item id, UTF-8 text) rows."""
    return Tables([p for item, text in items for p in cut(item, text, window)])


def _portions(bench: DataFrame, item_col: str, text_col: str, window: int) -> tuple[DataFrame, int]:
    """``portion, tables``: search tables built in tasks from portions of the benchmark's pieces, each of about ``TABLE_BYTES`` at most."""
    rows = bench.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("binary").alias("text"))

    def pieces(batches):
        for b in batches:
            found = [p for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for p in cut(item, text, window)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _, _ in found], pa.string()), pa.array([n for _, n, _ in found], pa.int32()),
                 pa.array([len(w) for _, _, w in found], pa.int64()), pa.array([b" ".join(w) for _, _, w in found], pa.binary())],
                ["item", "size", "n", "words"],
            )

    cuts = materialize(small_batches(rows).mapInArrow(pieces, "item string, size int, n long, words binary").distinct(), "decontam-pieces")
    total = cuts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.octet_length("words")), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    different = cuts.select(F.explode(F.split(F.col("words").cast("string"), " ")).alias("w")).agg(F.approx_count_distinct("w")).first()[0]
    letters = total[1] / max(1, total[0])
    n = 1
    while total[0] / n * WORD_BYTES + min(different, total[0] / n) * (VOCABULARY_BYTES + letters) > TABLE_BYTES and total[0] / n > total[2]:
        n += 1 + n // 8

    def tables(pdf):
        import pandas as pd

        found = Tables([(i, int(k), bytes(w).split(b" ")) for i, k, w in zip(pdf["item"], pdf["size"], pdf["words"])])
        return pd.DataFrame({"portion": [pdf["portion"].iloc[0]], "tables": [pickle.dumps(found)]})

    dealt = cuts.withColumn("portion", F.pmod(F.xxhash64("item", "words"), F.lit(n)).cast("int"))
    built = materialize(dealt.groupBy("portion").applyInPandas(tables, "portion int, tables binary"), "decontam-tables")
    forget(cuts)
    return built, n


def _load(built: DataFrame, portion: int):
    """A broadcast of one portion's tables, of about ``TABLE_BYTES``; a portion that got no piece has empty ones."""
    held = built.where(F.col("portion") == portion).first()
    return built.sparkSession.sparkContext.broadcast(pickle.loads(held["tables"]) if held else Tables([]))


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
_FOUND = "n_words long, spans array<struct<start:int,stop:int>>, items array<string>"


def _search(rows: DataFrame, shared, everything: bool) -> DataFrame:
    """``id, n_words, spans, items`` of rows ``id, t``; only of those with a hit unless ``everything``."""

    def run(batches):
        tables = shared.value
        for b in batches:
            ids, counts, spans, items = [], [], [], []
            for i, text in enumerate(b.column(1)):
                words = words_of(text.as_py())
                marks, names = tables.search(words)
                if marks or everything:
                    ids.append(i)
                    counts.append(len(words))
                    spans.append([{"start": s, "stop": e} for s, e in marks])
                    items.append(sorted(names, key=str.encode))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(ids, pa.int64())), pa.array(counts, pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))],
                ["id", "n_words", "spans", "items"],
            )

    return small_batches(rows).mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, {_FOUND}")


def find_overlap(
    docs: DataFrame,
    bench: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    bench_col: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """Which words of each document stand in a passage of a benchmark.

    A window is ``window`` consecutive words of an item (an item with fewer, but
    not none, is one window). Returns one row per input row: the id column,
    ``n_words``, ``spans`` (array of struct ``start, stop``: merged runs of hit
    words, in order) and ``items`` (item ids as strings, sorted). Null and empty
    texts have no words; null item ids are written as an empty string; items
    without words never occur; repeated items count once. Texts are read whole.

    Tables are built in tasks from bounded portions of the benchmark, and one
    portion's are held at a time. One portion is one pass without a shuffle;
    with more, rows get a number, further passes give only the rows that hit,
    and these are joined. An empty table, or benchmark, gives rows without hits.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t"))
    built, n = _portions(bench, item_col, bench_col, window)
    if n == 1:
        return _search(rows, _load(built, 0), True).select(F.col("id").alias(id_col), "n_words", "spans", "items")
    keyed, row = with_row_key(rows, "decontam-rows")
    keyed = keyed.select(F.struct(F.col(row).alias("row"), "id").alias("id"), "t")
    parts = []
    for k in range(n):
        shared = _load(built, k)
        parts.append(materialize(_search(keyed, shared, not k).withColumn("row", F.col("id.row")), "decontam-hits"))
        shared.destroy()
    first, others = parts[0], parts[1]
    for part in parts[2:]:
        others = others.unionByName(part)
    more = others.groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("more"), F.flatten(F.collect_list("items")).alias("names"))  # a row of each portion at most
    both = first.join(more, "row", "left")
    sorted_spans = F.array_sort(F.concat("spans", F.coalesce("more", F.array().cast(first.schema["spans"].dataType))))
    names = F.array_sort(F.array_distinct(F.concat("items", F.coalesce("names", F.array().cast("array<string>")))))
    return both.select(F.col("id.id").alias(id_col), "n_words", _joined(sorted_spans).alias("spans"), names.alias("items"))


def _joined(spans):
    """Sorted stretches with those that touch or overlap made one."""
    empty = F.array().cast("array<struct<start:int,stop:int>>")

    def add(done, s):
        last = F.try_element_at(done, F.lit(-1))
        longer = F.struct(last["start"].alias("start"), F.greatest(last["stop"], s["stop"]).alias("stop"))
        joined = F.concat(F.slice(done, F.lit(1), F.greatest(F.lit(0), F.size(done) - 1)), F.array(longer))
        return F.when((F.size(done) > 0) & (last["stop"] >= s["start"]), joined).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(spans, empty, add)


def summary(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digest of :func:`find_overlap` per document."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["stop"] - s["start"])
    return found.select(
        id_col, "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", bench_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` without the documents that hold a benchmark window.

    Decided row by row within the search itself: null ids, repeated ids and
    repeated rows have each their own decision. Null and empty texts stay.
    Further columns pass through, whatever their names. Of a benchmark of more
    than one portion, each further pass reads what the one before it kept.
    """
    built, n = _portions(bench, item_col, bench_col, window)
    for k in range(n):
        shared = _load(built, k)
        left = small_batches(docs).mapInArrow(_clean(shared, text_col), docs.schema)
        if k == n - 1:
            return left
        last, docs = docs if k else None, materialize(left, "decontam-left")
        shared.destroy()
        forget(last)


def _clean(shared, text_col: str):
    def run(batches):
        tables = shared.value
        for b in batches:
            keep = [not (t.is_valid and tables.search(words_of(t.as_buffer().to_pybytes()))[0]) for t in b.column(text_col)]
            yield b.filter(pa.array(keep, pa.bool_()))

    return run


def brute_force(text: bytes | None, items: list[tuple], window: int = WINDOW) -> tuple[int, int, list[str], str]:
    """The same result by trying every window at every place; for tests."""
    words, hit, names = words_of(text), set(), set()
    for item, passage in items:
        w = words_of(passage)
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            for j in range(len(words) - size + 1):
                if words[j : j + size] == w[i : i + size]:
                    hit.update(range(j, j + size))
                    names.add(item or "")
    ordered = sorted(names)
    return len(words), len(hit), ordered, hashlib.sha256(",".join(ordered).encode()).hexdigest()
