"""Token ids in word-aligned Simple-8b files.

A file holds the ids of consecutive documents in blocks of ``BLOCK`` ids. Each
64-bit word has a selector in its top four bits that says how many ids of how
many bits follow; selector 0 is an escape: the next word is one whole id. A
table of block offsets at the end lets any block be decoded alone, and a table
of documents gives their ids and lengths::

    magic | words of all blocks | word offset of each block (uint64, one more)
    | document ids (int64) | 1 where the id is null (uint8) | ids per document (uint64)
    | n_words, n_ids, n_docs (uint64) | magic
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from array import array
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, new_path, open_shared, rename_shared, small_batches

MAGIC = b"S8BTOK01"
BLOCK = 4096
#: Ids that are decoded or packed at a time.
CHUNK = 24 * BLOCK
#: Ids in a word by selector, and bits of each; 0 is the escape.
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
BITS = np.array([64, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)


def _hops(step: np.ndarray, n_ids: int) -> np.ndarray:
    """Places where words start: each block's first, and from each of them ``step`` further, up to the block's end.

    Places count ids. Only each eighth is followed one after another; those
    between are found for all of them at once.
    """
    n_blocks, width = step.shape
    first = np.arange(n_blocks, dtype=np.int32)[:, None] * width
    after = np.full(n_blocks * width + 1, n_ids, np.int32)
    place = first + np.arange(width, dtype=np.int32) + step
    after[:-1] = np.where(place < np.minimum(first + width, n_ids), place, n_ids).reshape(-1)
    two = after[after]
    four = two[two]
    far, eighths = memoryview(four[four]), []
    for at in first[:, 0].tolist():
        while at < n_ids:
            eighths.append(at)
            at = far[at]
    found = np.array(eighths, np.int32)[:, None]
    for jump in (four, two, after):
        found = np.stack([found, jump[found]], axis=2).reshape(len(found), 2 * found.shape[1])
    found = found.reshape(-1)
    return found[found < n_ids].astype(np.int64)


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of ``ids`` (unsigned), and the word offset of each block of ``BLOCK`` ids, the end last."""
    ids = np.asarray(ids, np.uint64)
    n_blocks = -(-len(ids) // BLOCK)
    flat = np.zeros((n_blocks, BLOCK + 60), np.uint64)
    for i in range(n_blocks):
        part = ids[i * BLOCK : (i + 1) * BLOCK]
        flat[i, : len(part)] = part
    top = int(ids.max()) if len(ids) else 0
    narrow = flat.astype(next(t for t in (np.uint16, np.uint32, np.uint64) if top <= np.iinfo(t).max))
    fitting = np.zeros((n_blocks, BLOCK), np.uint8)  # a selector with fewer and wider ids fits wherever one with more does
    for sel in range(14, 0, -1):
        n, bits = int(COUNTS[sel]), int(BITS[sel])
        if top >> bits == 0:
            fitting += 1
            continue
        ok = narrow < narrow.dtype.type(1 << bits)
        have = 1
        while have < n:  # all of the next ``n`` are narrow enough
            more = min(have, n - have)
            ok = ok[:, : ok.shape[1] - more] & ok[:, more:]
            have += more
        ok = ok[:, :BLOCK]
        if not ok.any():
            break
        fitting += ok
    best = np.array([0, *range(14, 0, -1)], np.uint8)[fitting]
    starts = _hops(COUNTS.astype(np.int32)[best], len(ids))
    block = starts // BLOCK
    sels, starts = best.reshape(-1)[starts], starts + block * 60
    sizes = np.bincount(block, 1 + (sels == 0), n_blocks).astype(np.int64)
    offsets = np.append(0, np.cumsum(sizes)).astype(np.uint64)
    place = np.concatenate([[0], np.cumsum(1 + (sels == 0))])[:-1]
    words, flat = np.zeros(int(offsets[-1]), np.uint64), flat.reshape(-1)
    for sel in np.unique(sels):
        mine = sels == sel
        if sel == 0:
            words[place[mine] + 1] = flat[starts[mine]]
            continue
        at, word = starts[mine], np.full(int(mine.sum()), np.uint64(int(sel) << 60))
        for k in range(int(COUNTS[sel])):
            word |= flat[at + k] << np.uint64(k * int(BITS[sel]))
        words[place[mine]] = word
    return words, offsets


def unpack(words: np.ndarray, offsets: np.ndarray, n_ids: int) -> np.ndarray:
    """Ids of whole consecutive blocks; ``offsets`` counts from the first of ``words``; only the last block may be short."""
    sels = (words >> np.uint64(60)).astype(np.int64)
    real = np.ones(len(words), bool)
    escapes = np.flatnonzero(sels == 0)
    for i in escapes:  # an escaped id may look like an escape itself
        if real[i]:
            real[i + 1] = False
    at = np.flatnonzero(real)
    sels = sels[at]
    counts = COUNTS[sels]
    block = np.searchsorted(offsets[1:].astype(np.int64), at, side="right")
    ends = np.flatnonzero(np.append(block[1:] != block[:-1], True)) if len(at) else at
    total = np.cumsum(counts)
    held = np.diff(np.append(0, total[ends])) if len(at) else total
    full = np.minimum(BLOCK, n_ids - block[ends] * BLOCK)
    counts[ends] -= held - full
    begin = np.cumsum(counts) - counts
    out = np.zeros(n_ids, np.uint64)
    for sel in np.unique(sels):
        mine = np.flatnonzero(sels == sel)
        if sel == 0:
            out[begin[mine]] = words[at[mine] + 1]
            continue
        body, mask = words[at[mine]], np.uint64((1 << int(BITS[sel])) - 1)
        for k in range(int(COUNTS[sel])):
            ok = counts[mine] > k
            out[begin[mine[ok]] + k] = (body[ok] >> np.uint64(k * int(BITS[sel]))) & mask
    return out


class FileWriter:
    """Writes one file; documents come in the order in which they are to stand."""

    def __init__(self, stream):
        self.stream, self.waiting, self.n_waiting = stream, [], 0
        self.n_words, self.n_ids = 0, 0
        self.offsets, self.doc_ids, self.nulls, self.lengths = [0], [], [], []
        stream.write(MAGIC)

    def add(self, doc_id: int | None, *ids: np.ndarray) -> None:
        n = sum(map(len, ids))
        self.doc_ids.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.lengths.append(n)
        self.waiting += ids
        self.n_waiting += n
        if self.n_waiting >= CHUNK:
            self._flush(self.n_waiting // BLOCK * BLOCK)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint32)
        for i in range(0, n, CHUNK):
            part = ids[i : min(i + CHUNK, n)]
            words, offsets = pack(part)
            self.stream.write(words.astype("<u8").tobytes())
            self.offsets += (offsets[1:].astype(np.int64) + self.n_words).tolist()
            self.n_words += len(words)
        self.n_ids += n
        self.waiting, self.n_waiting = [ids[n:]], len(ids) - n

    def close(self) -> None:
        self._flush(self.n_waiting)
        for values, kind in ((self.offsets, "<u8"), (self.doc_ids, "<i8"), (self.nulls, "u1"), (self.lengths, "<u8")):
            self.stream.write(np.array(values, kind).tobytes())
        self.stream.write(np.array([self.n_words, self.n_ids, len(self.doc_ids)], "<u8").tobytes() + MAGIC)
        self.stream.close()


def read_file(stream, chunk: int = CHUNK):
    """Yields ``doc_id, start, ids`` of each document of a file; ``start`` counts the file's ids before it.

    ``ids`` is an iterator of arrays; a long document comes in several. It must
    be used up before the next document is asked for.
    """
    size = stream.seek(0, 2)
    stream.seek(size - 32)
    tail = stream.read(32)
    if tail[24:] != MAGIC:
        raise ValueError("not a whole token file")
    n_words, n_ids, n_docs = (int(x) for x in np.frombuffer(tail[:24], "<u8"))
    n_blocks = -(-n_ids // BLOCK)
    stream.seek(8 + 8 * n_words)
    offsets = np.frombuffer(stream.read(8 * (n_blocks + 1)), "<u8")
    doc_ids = np.frombuffer(stream.read(8 * n_docs), "<i8")
    nulls = np.frombuffer(stream.read(n_docs), "u1")
    lengths = np.frombuffer(stream.read(8 * n_docs), "<u8").astype(np.int64)

    def chunks():
        per = chunk // BLOCK
        for i in range(0, n_blocks, per):
            some = offsets[i : i + per + 1]
            stream.seek(8 + 8 * int(some[0]))
            words = np.frombuffer(stream.read(8 * int(some[-1] - some[0])), "<u8")
            yield unpack(words, some - some[0], min(n_ids, (i + per) * BLOCK) - i * BLOCK)

    source, rest = chunks(), np.zeros(0, np.uint64)

    def take(n):
        nonlocal rest
        while n:
            if not len(rest):
                rest = next(source)
            part, rest = rest[:n], rest[n:]
            n -= len(part)
            yield part

    start = 0
    for doc, null, n in zip(doc_ids.tolist(), nulls.tolist(), lengths.tolist()):
        yield (None if null else doc), start, take(n)
        start += n


# ---------------------------------------------------------------- tokenizing

#: Words that a worker remembers, about 150 bytes each.
MEMORY = 1_300_000
#: Documents that are encoded together; each different word of theirs is looked up once.
TOGETHER = 1500
#: Texts with other characters are given to the tokenizer whole; up to here word cuts are the same (tested for each).
_OTHER = r"[^\x{0}-\x{24f}]"
_SPACE, _LETTER, _NUMBER, _SIGN = range(4)
_loaded: dict[str, "WordEncoder"] = {}


def _kind(c: int) -> int:
    """Kind of a character in the pattern of byte-level pre-tokens."""
    if chr(c) in "\t\n\v\f\r \x85\xa0":
        return _SPACE
    return {"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(chr(c))[0], _SIGN)


#: Kinds of the characters of one or two bytes.
_KINDS = np.array([_kind(c) for c in range(0x800)], np.uint8)


def cut_words(texts: pa.LargeStringArray) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """Pre-tokens of all texts, as byte-level BPE cuts them, and the place of each text's first one, the end last.

    The pattern is ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``:
    one starts wherever the kind of character changes, but not behind a space,
    which goes with what follows. The last white space before other characters
    starts one too, and a contraction ends one. Texts are null-free, their
    characters of one or two bytes.
    """
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends, n = ends - ends[0], len(raw)
    kind = np.append(_KINDS[:256][raw], np.uint8(_SPACE))
    lead = np.flatnonzero(raw >= 0xC0)
    kind[lead] = kind[lead + 1] = _KINDS[(raw[lead] & 0x1F).astype(np.int64) << 6 | raw[lead + 1] & 0x3F]
    edge = np.zeros(n + 1, bool)
    edge[ends] = True
    start = edge.copy()
    start[1:n] |= (kind[1:n] != kind[: n - 1]) & (raw[:-1] != 32)
    last = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & ~edge[1:])
    start[last - (raw[last] >= 0x80)] = True
    quote = np.flatnonzero((raw == 39) & start[:-1])
    for short in (b"s", b"t", b"m", b"d", b"re", b"ve", b"ll"):
        at = quote[quote + len(short) < n]
        for i, c in enumerate(short, 1):
            at = at[(raw[at + i] == c) & ~edge[at + i]]
        start[at + 1], start[at + len(short) + 1] = False, True
    places = np.flatnonzero(start)
    words = pa.Array.from_buffers(pa.large_binary(), len(places) - 1, [None, pa.py_buffer(places), pa.py_buffer(raw)])
    return words, np.searchsorted(places, ends)


def _cuts_as_known(tokenizer: dict) -> bool:
    """Whether a tokenizer file is byte-level BPE without anything that works across pre-tokens."""
    model, before = tokenizer["model"], tokenizer.get("pre_tokenizer") or {}
    plain = not tokenizer.get("normalizer") and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    kept = not (model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("ignore_merges") or model.get("byte_fallback"))
    whole = not (tokenizer.get("truncation") or tokenizer.get("padding"))
    added = all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in tokenizer.get("added_tokens") or [])
    return plain and model.get("type") == "BPE" and kept and whole and added


class WordEncoder:
    """A byte-level BPE tokenizer with a memory of words.

    Such a tokenizer treats each pre-token alone, so texts are cut into
    pre-tokens, a batch at a time, and the ids of pre-tokens are remembered and
    joined. Texts for which that does not hold (characters outside Latin script,
    or the content of a special token, which the tokenizer takes for that token)
    are encoded whole, and so is every text where the file is of another kind.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.by_words = _cuts_as_known(json.loads(self.tok.to_str()))
        added = [re.escape(t.content) for t in self.tok.get_added_tokens_decoder().values()]
        self.whole = "|".join([_OTHER, *added])
        self.model = self.tok.model
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.pieces: dict[str, bytes] = {}
        self.words: dict[bytes, bytes] = {}

    def _coded(self, texts: pa.LargeStringArray) -> tuple[bytes, np.ndarray]:
        """Ids of texts that hold nothing which is to be encoded whole, and where each text's begin, the end last; each different word is looked up once."""
        cut, begin = cut_words(texts)
        coded = cut.dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.words.get, names))
        fresh = [i for i, ids in enumerate(found) if ids is None]
        if len(self.words) + len(fresh) > MEMORY:
            self.words.clear()
        tokenize, letters = self.model.tokenize, self.letters
        new, ends = [], [0]
        for i in fresh:
            word = names[i]
            new += [t.id for t in tokenize(word.decode() if word.isalpha() else word.decode("latin-1").translate(letters))]
            ends.append(4 * len(new))
        data = array("I", new).tobytes()
        for i, at, end in zip(fresh, ends, ends[1:]):
            self.words[names[i]] = found[i] = data[at:end]
        data, ends = _taken(found, coded.indices)
        return data, ends[begin]

    def _learn(self, pieces: Sequence[str]) -> None:
        """Keep the ids of pieces, each with a space before it, for those who look up single pieces; :meth:`encode` needs words alone."""
        data, ends = self._coded(pa.array([" " + p for p in pieces], pa.large_string()))
        self.pieces.update((p, data[i:j]) for p, i, j in zip(pieces, ends, ends[1:]))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        out: list = [None] * len(texts)
        for lo in range(0, len(texts), TOGETHER):
            some = pa.array(texts[lo : lo + TOGETHER], pa.large_string())
            whole = np.asarray(pc.match_substring_regex(some, self.whole)) if self.by_words else np.ones(len(some), bool)
            for i in np.flatnonzero(whole).tolist():
                out[lo + i] = np.array(self.tok.encode(texts[lo + i], add_special_tokens=False).ids, np.uint32)
            usual = np.flatnonzero(~whole)
            if len(usual):
                data, ends = self._coded(some if len(usual) == len(some) else some.take(pa.array(usual)))
                for i, ids in zip(usual.tolist(), np.split(np.frombuffer(data, np.uint32), ends[1:-1] // 4)):
                    out[lo + i] = ids
        return out


def _taken(parts: list[bytes], which: pa.Array) -> tuple[bytes, np.ndarray]:
    """The parts of given numbers one after another, and where each begins, the end last."""
    taken = pa.array(parts, pa.large_binary()).take(which)
    ends = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset : taken.offset + len(taken) + 1]
    return (taken.buffers()[2] or pa.py_buffer(b"")).to_pybytes()[: ends[-1]], ends


def encoder(path: str) -> WordEncoder:
    if path not in _loaded:
        _loaded[path] = WordEncoder(path)
    return _loaded[path]


# ------------------------------------------------------------------- dataset


def write_tokens(
    docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 0, shards: int | None = None,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Encode every whole text and write token files in ascending order of ids.

    ``tokenizer`` is the path of a tokenizer file on every executor. Documents
    are divided by ranges of their ids into ``shards`` (the session's shuffle
    partitions unless given), each written by one task under a name of that
    attempt and renamed when whole, so a lost executor leaves no half file.
    Returns the manifest, one row per file: ``shard, path, base`` (ids in all
    files before it), ``n_docs, n_ids``.

    Null texts are empty and hold the end id alone; null ids stand first; rows
    with equal ids stand in the order of their texts' hashes, each with its own
    entry. An empty table gives a manifest without rows.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "tokens")
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t"), F.xxhash64(text_col).alias("h")
    )
    rows = rows.repartitionByRange(shards, "id", "h").sortWithinPartitions("id", "h").select("id", "t")

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        shard = task.partitionId()
        final = f"{folder}/part-{shard:06d}.s8b"
        tried = f"{folder}/_tried-{shard:06d}-{task.taskAttemptId()}.s8b"
        words, out, end = encoder(tokenizer), None, np.array([end_id], np.uint32)
        for b in batches:
            texts = [(t or b"").decode("utf-8", "replace") for t in b.column(1).to_pylist()]
            for doc, ids in zip(b.column(0).to_pylist(), words.encode(texts)):
                out = out or FileWriter(open_shared(tried, "wb"))
                out.add(doc, ids, end)
        if out:
            out.close()
            rename_shared(tried, final)
            yield pa.RecordBatch.from_pydict(
                {"shard": [shard], "path": [final], "n_docs": [len(out.doc_ids)], "n_ids": [out.n_ids]},
                pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]),
            )

    manifest = materialize(small_batches(rows).mapInArrow(run, "shard int, path string, n_docs long, n_ids long"), "tokens-manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long")))


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Per document of the files of a manifest: ``doc_id, start, n_tokens, ids_crc32``, from the files alone.

    ``start`` counts the ids of all documents before it over all files;
    ``ids_crc32`` is the CRC-32 of the ids as little-endian unsigned 32-bit integers.
    """
    files = manifest.select("path", "base").repartition(max(1, manifest.count()), "path")

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = []
                with open_shared(path, "rb") as stream:
                    for doc, start, parts in read_file(stream):
                        n = crc = 0
                        for part in parts:
                            n += len(part)
                            crc = zlib.crc32(part.astype("<u4").tobytes(), crc)
                        rows.append((doc, base + start, n, crc))
                        if len(rows) >= 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=schema)

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
