"""Phrase collocations through generalised suffix automata.

A shard is a bounded stretch of a partition's texts. Its automaton has a state
for each set of end positions: the state's longest string, the length of its
suffix link's longest string, and the number of its end positions. Strings
longer than the depth are not told apart, so the automaton is built from the
tree of its suffix links, level by level: a node of depth k is split by the word
before it, and a node whose only child ends wherever it ends is the same state.
The substrings of a state are the suffixes of its longest string that are longer
than its link's; all states together enumerate each substring once, with its
count, and shards are summed by Spark.

A phrase is no more frequent than what it consists of. Shards are therefore
searched length by length, and a phrase is only counted where its parts of one
word less are among those that were frequent over all shards. A filter of
bounded size tells: it may let rare ones through, which costs time, not results.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_batches

#: Words of the longest phrases; occurrences that make a phrase a candidate; rows for each language.
DEPTH, LEAST, TOP = 3, 10, 2000
#: Words of a shard.
SHARD_WORDS = 1 << 20
#: Phrases of a batch that a task hands on.
ROWS = 1 << 16
#: Filter bits for each frequent phrase, and at most (a filter is broadcast: 16 MB).
FILTER_BITS, MOST_BITS = 16, 1 << 27
#: Parts that a language's candidates are ranked in before they meet.
RANK_PARTS = 64
#: A candidate goes where a longer one has so large a share of its occurrences.
SUBSUMED = 0.5

_SLICE = 1 << 20
_BETWEEN = re.compile(rb"[\x09-\x0d .,;:!?]")
_ROTATE = 21
_BREAK, _NOTHING = 0, 1


def _table() -> bytes:
    """Bytes as the operator reads them: A-Z lower-cased, the ends of pieces as line feeds, tabs as spaces."""
    out = bytearray(bytes(range(256)).lower())
    for c in b".,;:!?\n\x0b\x0c\r":
        out[c] = 10
    out[9] = 32
    return bytes(out)


_READ = _table()


class Automaton(NamedTuple):
    """States of a generalised suffix automaton whose strings have at most ``depth`` words."""

    words: np.ndarray  #: of the shard: word numbers, 0 between pieces
    end: np.ndarray  #: per state: a position where its strings end
    length: np.ndarray  #: words of its longest string
    link: np.ndarray  #: words of the longest string of its suffix link
    count: np.ndarray  #: its end positions


def _distinct(values: np.ndarray, inverse: bool):
    """The different values, a place of each, the number of each value among them (if asked for), and how many there are of each."""
    order = np.argsort(values)
    ranged = values[order]
    new = np.ones(len(values), bool)
    new[1:] = ranged[1:] != ranged[:-1]
    start = np.flatnonzero(new)
    number = None
    if inverse:
        number = np.empty(len(values), np.int64)
        number[order] = np.cumsum(new) - 1
    return ranged[start], order[start], number, np.diff(start, append=len(values))


def automaton(words: np.ndarray, depth: int, context: int = 0, allowed=None) -> Automaton:
    """The automaton of a shard; strings that end in the first ``context`` places belong to the shard before.

    ``allowed(k, ends)`` tells which of the strings of k words that end at
    ``ends`` are wanted; what is not is in no state, nor is what ends in it.
    """
    at = np.flatnonzero(words > _NOTHING)
    at = at[at >= context]
    node = words[at].astype(np.int64)
    states = []
    parent_of, first, count = None, None, None
    for k in range(1, depth + 1):
        if k > 1:
            back = at - (k - 1)
            left = np.where(back >= 0, words[np.maximum(back, 0)], 0)
            keep = left > _NOTHING
            at, node, left = at[keep], node[keep], left[keep].astype(np.int64)
            node = node << 32 | left
        if allowed is not None and len(at):
            keep = allowed(k, at)
            at, node = at[keep], node[keep]
        names, where, inverse, size = _distinct(node, k < depth)
        if k > 1:  # a node that one child takes over whole is that child's state
            up = names >> 32
            most = np.zeros(len(count), np.int64)
            np.maximum.at(most, up, size)
            own = most < count
            states.append((first[own], k - 1, parent_of[own], count[own]))
            # the link of a child is its parent's state, whose longest string is the parent itself
            link = np.where(own, k - 1, parent_of)[up]
        else:
            link = np.zeros(len(names), np.int64)
        first, count, parent_of, node = at[where], size, link, inverse
    states.append((first, depth, parent_of, count))
    sizes = [len(s[0]) for s in states]
    return Automaton(
        words, np.concatenate([s[0] for s in states]), np.repeat([s[1] for s in states], sizes),
        np.concatenate([s[2] for s in states]), np.concatenate([s[3] for s in states]),
    )


def substrings(found: Automaton, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the different substrings of k words end, and how often each occurs."""
    has = (found.link < k) & (k <= found.length)
    return found.end[has], found.count[has]


class _Shards:
    """Reads texts into shards of word numbers; numbers belong to a language and a word."""

    def __init__(self, depth: int):
        self.keep = depth - 1
        self.clear()

    def clear(self, carry: tuple = ()) -> None:
        self.names: list[tuple] = [("", b""), ("", b"")]
        self.numbers: dict[str, dict[bytes, int]] = {}
        self.blocks: list[np.ndarray] = [np.array([self._of(lang)[w] for lang, w in carry], np.int32)]
        self.size = self.context = len(carry)

    def _of(self, lang: str) -> dict:
        known = self.numbers.get(lang)
        if known is None:
            names = self.names

            class Numbers(dict):
                def __missing__(self, word):
                    names.append((lang, word))
                    self[word] = len(names) - 1
                    return len(names) - 1

            known = self.numbers[lang] = Numbers({b"\n": _BREAK, b"": _NOTHING})
        return known

    def read(self, lang: str, text: bytes):
        """Adds a text; yields whenever a shard is full."""
        self._add(np.zeros(1, np.int32))
        at = 0
        while at < len(text):
            end = min(at + _SLICE, len(text))
            gap = _BETWEEN.search(text, end)
            end = gap.end() if gap else len(text)
            tokens = text[at:end].translate(_READ).replace(b"\n", b" \n ").split(b" ")
            of = self._of(lang)
            numbers = np.fromiter(map(of.__getitem__, tokens), np.int32, len(tokens))
            self._add(numbers[numbers != _NOTHING])
            at = end
            if self.size >= SHARD_WORDS:
                yield
                last = np.concatenate(self.blocks)[-self.keep :] if self.keep else []
                self.clear(tuple((lang, b"\n") if w == _BREAK else self.names[w] for w in last))

    def _add(self, numbers: np.ndarray) -> None:
        self.blocks.append(numbers)
        self.size += len(numbers)

    def words(self) -> np.ndarray:
        return np.concatenate(self.blocks)


def _rotated(h, k: int):
    by = np.uint64(_ROTATE * k % 64)
    return h if not by else h << by | h >> (np.uint64(64) - by)


def _word_hashes(names: list[tuple]) -> np.ndarray:
    """As :func:`_spot` has them: XXH64 of the word, seeded with that of the language."""
    import xxhash

    seeds: dict = {}
    out = np.zeros(len(names), np.uint64)
    for i, (lang, word) in enumerate(names[2:], 2):
        seed = seeds.get(lang)
        if seed is None:
            seed = seeds[lang] = xxhash.xxh64_intdigest(lang.encode(), 42)
        out[i] = xxhash.xxh64_intdigest(word, seed)
    return out


def _spot(words, lang, bits: int, depth: int):
    """The filter's bit of a phrase (an array column of ``depth`` words), in Spark."""
    total = None
    for k in range(depth):
        h = F.xxhash64(lang, words[k])
        by = _ROTATE * k % 64
        h = F.shiftleft(h, by).bitwiseOR(F.shiftrightunsigned(h, 64 - by)) if by else h
        total = h if total is None else total.bitwiseXOR(h)
    return F.shiftrightunsigned(total, 64 - bits)


def _filter(frequent: DataFrame, depth: int) -> np.ndarray:
    """A bitmap of the phrases of ``lang, phrase``, bounded by ``MOST_BITS``; its 64-bit words are what the driver gets."""
    bits = int(max(16, min(np.ceil(np.log2(1 + frequent.count() * FILTER_BITS)), np.log2(MOST_BITS))))
    spot = _spot(F.split("phrase", " "), F.col("lang"), bits, depth)
    spots = frequent.select(spot.alias("spot"))
    marks = spots.select(F.shiftright("spot", 6).alias("at"), F.expr("shiftleft(1L, cast(spot & 63L as int))").alias("mark"))
    found = marks.groupBy("at").agg(F.bit_or("mark").alias("mark")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[found.column("at").to_numpy()] = found.column("mark").to_numpy()
    return out.view(np.uint64)


def _phrases(langs: pa.Array, spelled: pa.Array, words: np.ndarray, ends: np.ndarray, k: int) -> tuple[pa.Array, pa.Array]:
    """Languages and phrases (space-joined) of the k words up to each end, from those of each word number."""
    parts = [spelled.take(pa.array(words[ends - back])) for back in range(k - 1, -1, -1)]
    joined = parts[0] if k == 1 else pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.binary()))
    return langs.take(pa.array(words[ends])), joined.cast(pa.string())


def _count(rows: DataFrame, k: int, known: np.ndarray | None) -> DataFrame:
    """``lang, phrase, n`` of all phrases of k words (of those whose parts the filter has)."""
    shared = None if known is None else rows.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        def counted():
            words, names = shards.words(), shards.names
            shift = None if shared is None else np.uint64(64 - int(np.log2(len(shared.value) * 64)))
            hashes = None if shared is None else _word_hashes(names)

            def allowed(length, ends):
                """Whether a part of k - 1 words is frequent; as for k words, the part they begin with as well."""
                if length < k - 1:
                    return np.ones(len(ends), bool)
                ends = ends if length == k - 1 else ends - 1
                total = np.zeros(len(ends), np.uint64)
                for i in range(k - 1):
                    total ^= _rotated(hashes[words[ends - (k - 2 - i)]], i)
                spot = total >> shift
                return (shared.value[(spot >> np.uint64(6)).astype(np.int64)] >> (spot & np.uint64(63)) & np.uint64(1)).astype(bool)

            found = automaton(words, k, shards.context, allowed if k > 1 else None)
            ends, n = substrings(found, k)
            del found
            langs, spelled = pa.array([g for g, _ in names], pa.string()), pa.array([w for _, w in names], pa.binary())
            for i in range(0, len(ends), ROWS):
                of, phrases = _phrases(langs, spelled, words, ends[i : i + ROWS], k)
                yield pa.RecordBatch.from_arrays([of, phrases, pa.array(n[i : i + ROWS])], ["lang", "phrase", "n"])

        shards = _Shards(k)
        for b in batches:
            for lang, t in zip(b.column(0).to_pylist(), b.column(1)):
                for _ in shards.read(lang, t.as_buffer().to_pybytes()):
                    yield from counted()
        yield from counted()

    counts = small_batches(rows).mapInArrow(run, "lang string, phrase string, n long")
    return counts.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", depth: int = DEPTH, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, k, n`` of all phrases of up to ``depth`` words with at least ``least`` occurrences, and ``lang, n`` of all words.

    Texts have A-Z lower-cased; they are cut at ``[.,;:!?\\x0A-\\x0D]`` into
    pieces, those at spaces and tabs into words; no phrase spans two pieces.
    Occurrences may overlap. A null language is ``und``; a null text is empty.
    """
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).cast("binary").alias("t")).where("t is not null")
    every = materialize(_count(rows, 1, None), "collocation-words")
    totals = every.groupBy("lang").agg(F.sum("n").alias("n"))
    found = [materialize(every.where(F.col("n") >= least), "collocation-1")]
    for k in range(2, depth + 1):
        known = _filter(found[-1], k - 1)
        found.append(materialize(_count(rows, k, known).where(F.col("n") >= least), f"collocation-{k}"))
    whole = found[0].withColumn("k", F.lit(1))
    for k, part in enumerate(found[1:], 2):
        whole = whole.union(part.withColumn("k", F.lit(k)))
    return whole.select("lang", "phrase", "k", "n"), totals


def mine(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", depth: int = DEPTH, least: int = LEAST, top: int | None = TOP, subsumed: float = SUBSUMED) -> DataFrame:
    """The collocations of each language: its first ``top`` phrases of 2 to ``depth`` words by score.

    A phrase that occurs ``a`` times, cut into parts that occur l and r times,
    has the score floor(1000000 a a / (l r)) of its lowest cut (of equal ones
    that after the fewest words). A phrase inside a longer one that has at least
    ``subsumed`` of its occurrences goes: along suffix links for what ends it,
    and along the words it continues with for what begins it, link after link.
    Equal scores go by a, then by phrase in byte order. Returns ``lang, rank,
    phrase, a, l, r, n, score``; n is the number of the language's words. All
    counts are exact. An empty table, or one without phrases so frequent, gives
    an empty one; repeated rows count again; further columns are not read.
    """
    whole, totals = frequent_phrases(docs, text_col, lang_col, depth, least)
    words = F.split("phrase", " ")
    many = whole.where("k > 1")

    inner = F.expr(
        "flatten(transform(sequence(2, greatest(k - 1, 2)), m -> transform(sequence(1, greatest(k - m + 1, 1)), i -> "
        "array_join(slice(split(phrase, ' '), i, m), ' '))))"
    )
    longer = many.where("k > 2").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "n")
    longer = longer.groupBy("lang", "phrase").agg(F.max("n").alias("most"))
    alone = many.join(longer, ["lang", "phrase"], "left")
    share = F.lit(round(subsumed * 100)).cast("long")
    alone = alone.where(F.col("most").isNull() | (F.col("most") * 100 < F.col("n") * share)).select("lang", "phrase", "k", F.col("n").alias("a"))

    cut = F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")
    cuts = alone.select("lang", "phrase", "a", "k", cut)
    cuts = cuts.select(
        "lang", "phrase", "a", "cut", F.array_join(F.slice(words, F.lit(1), F.col("cut")), " ").alias("head"),
        F.array_join(F.slice(words, F.col("cut") + 1, F.col("k") - F.col("cut")), " ").alias("tail"),
    )
    parts = whole.where(f"k < {depth}")
    heads = parts.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l"))
    tails = parts.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r"))
    score = F.expr("cast(a as decimal(15,0)) * cast(a as decimal(15,0)) * 1000000 div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    scored = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).withColumn("score", score)
    least_cut = F.min(F.struct("score", "cut", "l", "r")).alias("c")
    scored = scored.groupBy("lang", "phrase", "a").agg(least_cut).select("lang", "phrase", "a", "c.l", "c.r", "c.score")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    if top is not None:  # of each part of a language its first ones, then those of all parts
        part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))).orderBy(*order)
        scored = scored.withColumn("_first", F.row_number().over(part)).where(F.col("_first") <= top).drop("_first")
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.join(F.broadcast(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
