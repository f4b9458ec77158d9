"""Spelling variants through anagram hashing.

A word's anagram key is the sum of the fifth powers of its letters, so that all
orders of the same letters share it. Taking one letter out lowers the key by
that letter's value: words that differ by one added or removed letter meet where
the key of one equals a lowered key of the other, words that differ by one
exchanged letter where two lowered keys are equal. What meets is then verified
in the order of its letters.
"""

from __future__ import annotations

import re
from collections import Counter
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, hot_keys, materialize, maybe_broadcast, skewed_join, small_batches

#: Least code points of a word, and least occurrences in all documents.
LEAST_CHARS, LEAST_COUNT = 6, 5
#: A form is at least so many times as frequent as its variants.
RATIO = 5
#: One in so many words of a document loses a letter.
TYPO_EVERY = 199
#: Different words whose counts a task holds at a time.
HELD_WORDS = 200_000
#: Words under one key that are compared pair by pair; beyond it, the order of letters joins the key.
PLAIN_BUCKET = 64
#: Keys are sums modulo this prime, so that words of any length have one.
MODULUS = (1 << 61) - 1

_SLICE = 1 << 20
_BETWEEN = re.compile(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]")


def _runs(text: bytes, least: int):
    """Lists of the runs of letters of at least ``least``, A-Z lower-cased, of pieces of a text cut where no letter is."""
    pattern = re.compile(r"[A-Za-zÀ-ÿ]{%d,}" % least)
    at = 0
    while at < len(text):
        gap = _BETWEEN.search(text, at + _SLICE)
        end = gap.end() if gap else len(text)
        yield pattern.findall(text[at:end].lower().decode("utf-8", "replace"))
        at = end


def _altered(word: str, prefix: int) -> str:
    """The word as the document is taken to have it: one in ``TYPO_EVERY`` loses a letter. ``prefix``: crc32 of the id and a colon."""
    h = crc32(word.encode(), prefix)
    if h % TYPO_EVERY:
        return word
    k = h % len(word)
    return word[:k] + word[k + 1 :]


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least: int = LEAST_COUNT, typos: bool = True) -> DataFrame:
    """``word, n`` of the words of at least ``least_chars`` letters with at least ``least`` occurrences in all documents.

    Words are maximal runs of ``A-Za-z`` and U+00C0 to U+00FF with A-Z
    lower-cased. With ``typos``, a run of which the crc32 of ``<id>:<run>`` is a
    multiple of 199 loses a letter. A null text has no words, a null id is the
    empty text. Repeated rows count again.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).cast("binary").alias("t")).where("t is not null")

    def run(batches):
        held: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                prefix = crc32(f"{i}:".encode())
                for found in _runs(t.as_buffer().to_pybytes(), least_chars):
                    for word, n in Counter(found).items():
                        word = _altered(word, prefix) if typos else word
                        if len(word) >= least_chars:
                            held[word] += n
                    if len(held) > HELD_WORDS:
                        yield out()
                        held.clear()
        if held:
            yield out()

    counts = small_batches(rows).mapInArrow(run, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _key(letters):
    """The anagram key of an array of code points."""
    return F.aggregate(letters, F.lit(0).cast("long"), lambda s, c: (s + c * c * c * c * c) % F.lit(MODULUS))


def _entries(words: DataFrame) -> DataFrame:
    """``key, word, taken``: each word under its key (``taken`` null) and under that without one of its letters, for each different letter."""
    letters = F.transform(F.split("word", ""), lambda c: F.ascii(c).cast("long"))
    keyed = words.select("word", letters.alias("letters")).withColumn("whole", _key(F.col("letters")))
    lowered = F.transform(F.array_distinct("letters"), lambda c: F.struct(F.pmod(F.col("whole") - c * c * c * c * c, F.lit(MODULUS)).alias("key"), c.alias("taken")))
    every = F.concat(F.array(F.struct(F.col("whole").alias("key"), F.lit(None).cast("long").alias("taken"))), lowered)
    return keyed.select("word", F.explode(every).alias("e")).select("e.key", "word", "e.taken")


def near_pairs(words: DataFrame) -> DataFrame:
    """``a, b`` (a < b): the words of ``word`` (different ones) that differ by exactly one inserted, deleted or replaced code point.

    Keys of up to ``PLAIN_BUCKET`` words are joined with themselves and each
    meeting is verified. Under a larger key, as many orders of the same letters
    make it, what is left of a word without its letter joins the key, once for
    each place of that letter: words then meet only where the order agrees too,
    and as many as there are letters and places at most.
    """
    entries = materialize(_entries(words), "spelling-keys")
    sizes = materialize(entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "spelling-sizes")
    met = entries.join(sizes, "key")

    plain = met.where(f"n <= {PLAIN_BUCKET}")
    left = plain.where("taken is not null").select("key", F.col("word").alias("a"), F.col("taken").alias("ta"))
    right = plain.select("key", F.col("word").alias("b"), F.col("taken").alias("tb"))
    both = left.join(right, "key").where("tb is null or a < b and ta <> tb")
    found = both.where(F.abs(F.length("a") - F.length("b")) <= 1).where(F.levenshtein("a", "b", 1) == 1)
    found = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    crowded = met.where(f"n > {PLAIN_BUCKET}").select("key", "word", "taken")
    if not crowded.isEmpty():
        places = F.filter(F.sequence(F.lit(1), F.length("word")), lambda i: F.ascii(F.substring(F.col("word"), i, F.lit(1))) == F.col("taken"))
        places = F.when(F.col("taken").isNull(), F.array(F.lit(0))).otherwise(places)
        ordered = crowded.select("key", "word", "taken", F.explode(places).alias("place"))
        rest = F.when(F.col("place") == 0, F.col("word")).otherwise(F.concat(F.expr("substring(word, 1, place - 1)"), F.expr("substring(word, place + 1)")))
        ordered = ordered.select("key", rest.alias("rest"), "word", "taken", "place")
        left = ordered.where("place > 0").select("key", "rest", F.col("word").alias("a"), F.col("taken").alias("ta"), F.col("place").alias("pa"))
        right = ordered.select("key", "rest", F.col("word").alias("b"), F.col("taken").alias("tb"), F.col("place").alias("pb"))
        both = left.join(right, ["key", "rest"]).where("pb = 0 or pa = pb and a < b and ta <> tb")
        found = found.union(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    found = materialize(found.distinct(), "spelling-pairs")
    forget(entries, sizes)
    return found


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root``: where the forms of ``word, form`` lead to. Each round doubles the way that is known; frequencies grow fivefold a step, so few rounds suffice."""
    roots, held = forms.select("word", F.col("form").alias("root")), None
    while True:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = roots.join(on, "root")
        if further.isEmpty():
            return roots
        roots = materialize(roots.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "spelling-roots")
        forget(held)
        held = roots


def group(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """The spelling variants among ``word, n`` (one row a word).

    Returns per word: ``word``, ``form`` (its near word of largest n, of equal
    ones the smallest, if that n is at least ``ratio`` times its own; else
    null), ``root`` (the last form that forms lead to; the word itself if it has
    none), ``n``, ``n_near`` (0 if none is near), ``form_n`` (null with the
    form). An empty table gives an empty one; further columns are not read.
    """
    words = materialize(words.select("word", "n"), "spelling-words")
    pairs = near_pairs(words)
    ways = pairs.select(F.col("a").alias("word"), F.col("b").alias("other")).union(pairs.select("b", "a"))
    many = ways.groupBy("other").agg(F.count("*").alias("n"))
    numbered = skewed_join(ways, words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), ["other"], hot_keys(many, ["other"]), "word")
    best = numbered.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other"))).alias("best"))
    counted = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.other").alias("other"), (-F.col("best.less")).alias("other_n"))
    has = F.col("other_n") >= F.col("n") * ratio
    formed = materialize(counted.select("word", F.when(has, F.col("other")).alias("form"), "n", "n_near", F.when(has, F.col("other_n")).alias("form_n")), "spelling-forms")
    roots = _roots(formed.where("form is not null"))
    forget(words, pairs)
    return formed.join(maybe_broadcast(roots), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
