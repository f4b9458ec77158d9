"""Language identification by words first, backing off to shorter character n-grams.

A known word adds its log frequency in each language. An unseen word adds the
mean log frequency of its longest character n-grams that are known: lengths from
``MAX_GRAM`` down to 1 are tried until one is met.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialize, small_batches

MAX_GRAM = 5
#: Bound of the labelled rows that are learned from: expected documents of each language. All that they hold is counted and kept.
SAMPLE_DOCS = 1500
#: Words that a posterior counts at most: a long text is not more certain than so many words.
EVIDENCE = 12
#: Unseen words that a worker remembers.
MEMORY = 100_000
UNKNOWN = "und"

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters; a run counts if it holds a letter proper."""
    return [w for w in _WORD.findall((text or "").lower()) if w.isalpha() or any(map(str.isalpha, w))]


def grams_of(word: str, n: int) -> list[str]:
    marked = f"<{word}>" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def _count(batches):
    """Counts of words by language within each batch."""
    for b in batches:
        counts: dict[str, Counter] = {}
        for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
            counts.setdefault(lang, Counter()).update(words_of(_decoded(text)))
        rows = [(lang, w, n) for lang, words in counts.items() for w, n in words.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows) if rows else ((), (), ()), (pa.string(), pa.string(), pa.int64()))], ["lang", "key", "n"]
        )


def _decoded(value) -> str | None:
    """Text of an Arrow scalar, whatever its bytes."""
    return value.as_buffer().to_pybytes().decode("utf-8", "replace") if value.is_valid else None


def _gram_columns():
    """All n-grams of the column ``key``, as :func:`grams_of` gives them."""
    marked = F.concat(F.lit("<"), "key", F.lit(">"))

    def each(text, n: int):
        last = F.length(text) - (n - 1)
        found = F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, F.lit(n)))
        return F.when(last >= 1, found).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.array(each(F.col("key"), 1), *[each(marked, n) for n in range(2, MAX_GRAM + 1)]))


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", seed: int = 0) -> dict:
    """A model from rows with a language; null languages and null texts are passed over.

    Learns from an expected ``SAMPLE_DOCS`` documents of each language, chosen by
    a hash of their ids and texts (rows alike in both are drawn together).
    Words are counted in the executors, n-grams from the different words; every
    word and n-gram of the sample is in the model, which reaches the driver as
    Arrow columns. Repeated rows count as often as they occur. An empty table
    gives a model without languages.
    """
    rows = labelled.select(
        F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"), F.col(lang_col).alias("lang")
    ).where("lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return {"langs": [], "w": (pa.array([], pa.string()), np.zeros((0, 0), np.float32)), "g": (pa.array([], pa.string()), np.zeros((0, 0), np.float32))}
    chance = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, SAMPLE_DOCS / sizes[lang]))])[F.col("lang")]
    draw = F.pmod(F.xxhash64("id", "text", F.lit(seed)), F.lit(1_000_000)) / 1e6
    words = small_batches(rows.where(draw < chance).select("lang", "text")).mapInArrow(_count, "lang string, key string, n long")
    words = materialize(words.groupBy("lang", "key").agg(F.sum("n").alias("n")), "lang-words")
    grams = words.select("lang", F.explode(_gram_columns()).alias("key"), "n").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    model = {"langs": langs}
    for kind, counts in (("w", words), ("g", grams)):
        by_lang = F.map_from_entries(F.collect_list(F.struct("lang", "n")))  # an entry for each language at most
        each = F.transform(F.array(*[F.lit(x) for x in langs]), lambda x: F.coalesce(F.element_at("m", x), F.lit(0)))
        table = counts.groupBy("key").agg(by_lang.alias("m")).select("key", each.alias("n")).toArrow().combine_chunks()
        keys = pa.concat_arrays(table.column("key").chunks) if table.num_rows else pa.array([], pa.string())
        n = np.asarray(pa.concat_arrays(table.column("n").chunks).flatten()).reshape(-1, len(langs)) if table.num_rows else np.zeros((0, len(langs)))
        total = np.maximum(1, n.sum(0))
        unseen = (0.1 if kind == "w" else 0.5) / total.max()  # alike in all languages, however much was seen of each
        model[kind] = (keys, np.log(n / total + unseen).astype(np.float32))
    forget(words)
    return model


class Scorer:
    """Applies a model; remembers the scores of unseen words up to a bound."""

    def __init__(self, model: dict):
        self.langs = model["langs"]
        keys, table = model["w"]
        self.known = dict(zip(keys.to_pylist(), range(len(keys))))
        keys, self.gram_table = model["g"]
        self.grams = dict(zip(keys.to_pylist(), range(len(keys))))
        self.base = len(self.known)
        self.table = np.zeros((self.base + MEMORY, len(self.langs)), np.float32)
        self.table[: self.base] = table
        self.extra: dict[str, int] = {}

    def _unseen(self, word: str) -> int:
        at = self.extra.get(word)
        if at is None:
            if len(self.extra) >= MEMORY:
                self.extra.clear()
            at = self.extra[word] = self.base + len(self.extra)
            self.table[at] = 0
            for n in range(MAX_GRAM, 0, -1):
                found = [self.grams[g] for g in grams_of(word, n) if g in self.grams]
                if found:
                    self.table[at] = self.gram_table[found].sum(0) / len(found)
                    break
        return at

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and its share of the posterior; ``und`` and 0 without letters or without learned languages."""
        words = words_of(text)
        if not words or not self.langs:
            return UNKNOWN, 0.0
        total = np.zeros(len(self.langs))
        for i in range(0, len(words), MEMORY // 2):  # a portion's unseen words all fit
            part = words[i : i + MEMORY // 2]
            at = list(map(self.known.get, part))
            if None in at:
                if len(self.extra) + len(part) > MEMORY:
                    self.extra.clear()
                at = [self._unseen(w) if k is None else k for w, k in zip(part, at)]
            total += self.table[at].sum(0, dtype=np.float64)
        mean = total / len(words) * min(len(words), EVIDENCE)
        best = int(mean.argmax())
        return self.langs[best], 1.0 / sum(math.exp(x - mean[best]) for x in mean)


def _scorer(shared) -> Scorer:
    """The scorer of a broadcast model: one for each worker, gone with the broadcast."""
    model = shared.value
    if "scorer" not in model:
        model["scorer"] = Scorer(model)
    return model["scorer"]


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``id, lang_pred, score`` for every row of ``docs``, from its whole text alone.

    ``und`` with score 0 for null texts and texts without a letter; ties go to
    the language that sorts first. Bytes that aren't UTF-8 are read as
    replacement characters. Repeated rows are scored alike, an empty table gives
    an empty one, and columns besides the two named are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample of SAMPLE_DOCS
    rows = docs.select(F.col(id_col).alias(id_col), F.col(text_col).cast("binary").alias("t"))

    def run(batches):
        scorer = _scorer(shared)
        for b in batches:
            found = [scorer.predict(_decoded(t)) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())],
                [id_col, "lang_pred", "score"],
            )

    kind = rows.schema[id_col].dataType.simpleString()
    return small_batches(rows).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")


def keep_known(docs: DataFrame, model: dict, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """``docs`` without those in no known language: ``und``, or a posterior below ``least``.

    Decided row by row within one pass, so null and repeated ids play no part;
    null texts and texts without letters go. Bytes that aren't UTF-8 are read as
    :func:`predict` reads them and kept as they are. Further columns pass
    through, whatever their names. An empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = _scorer(shared)
        for b in batches:
            keep = []
            for t in b.column(text_col):
                lang, score = scorer.predict(_decoded(t))
                keep.append(lang != UNKNOWN and score >= least)
            yield b.filter(pa.array(keep, pa.bool_()))

    return small_batches(docs).mapInArrow(run, docs.schema)
