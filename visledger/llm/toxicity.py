"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word's vector is the mean of the vectors of its hashed subwords (the word and
its character n-grams); a passage's vector is the mean over its words; two
classes follow by a linear softmax. Embeddings and softmax are trained jointly
in numpy, first on passages from anywhere in the documents, then on the passage of
each document that the model finds worst (a toxic document need not be toxic
throughout). The score of a document is that of its worst passage, so long texts
are not diluted. Tasks look for the passages in whole texts; the driver, which
trains, gets nothing but passages.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialize, maybe_broadcast, small_batches

BUCKETS = 1 << 17
DIM = 8
GRAMS = (3, 4, 5)
#: Words of a passage; passages start at every word.
PASSAGE = 3
#: Passages of a document that a round takes for its worst.
WORST = 3
#: Bounds of the training sample: toxic and clean documents (expected, and twice as many rows at most), whatever their length.
SAMPLE_DOCS, SAMPLE_CLEAN = 1200, 3600
#: How much a clean document blamed counts against a toxic one caught when the threshold is placed.
BLAME = 2
#: Words whose scores a worker remembers.
MEMORY = 400_000

_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def subwords(word: str) -> list[int]:
    """Buckets of a word's subwords."""
    marked = f"<{word}>"
    parts = [marked] + [marked[i : i + n] for n in GRAMS for i in range(len(marked) - n + 1)]
    return [zlib.crc32(p.encode()) % BUCKETS for p in parts]


class Model:
    def __init__(self, embedding: np.ndarray, weight: np.ndarray, bias: float, scale: float = 1.0):
        self.embedding, self.weight, self.bias, self.scale = embedding, weight, bias, scale
        #: Of two classes a softmax needs the difference alone: one number for each subword.
        self.table = (embedding @ (weight[:, 1] - weight[:, 0])).astype(np.float64)
        self.memory: dict[str, float] = {}

    def __reduce__(self):
        return Model, (self.embedding, self.weight, self.bias, self.scale)

    def word(self, w: str) -> float:
        found = self.memory.get(w)
        if found is None:
            if len(self.memory) >= MEMORY:
                self.memory.clear()
            parts = subwords(w)
            found = self.memory[w] = float(self.table[parts].sum() / len(parts))
        return found

    def passages(self, words: list[str]) -> np.ndarray:
        """Mean word score of the passage that starts at each word."""
        return _means(np.fromiter(map(self.word, words), np.float64, len(words)))

    def logit(self, words: list[str]) -> float:
        if not words:
            return -self.scale * abs(self.bias) - 1.0
        return self.scale * (float(self.passages(words).max()) + self.bias)

    def score(self, text: str | None) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.logit(words_of(text)), -30, 30))))


class _Words:
    """Word numbers of the training texts and the subword buckets of each word."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.parts: list[list[int]] = []

    def numbers(self, words: list[str]) -> np.ndarray:
        for w in words:
            if w not in self.number:
                self.number[w] = len(self.parts)
                self.parts.append(subwords(w))
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))

    def close(self) -> None:
        self.count = np.array([len(p) for p in self.parts], np.int64)
        self.begin = np.cumsum(self.count) - self.count
        self.flat = np.array([x for p in self.parts for x in p], np.int64)

    def bags(self, passages: list[np.ndarray]):
        """Buckets, weights and passage of each subword of some passages."""
        size = np.array([len(p) for p in passages])
        words = np.concatenate(passages)
        n = self.count[words]
        at = np.repeat(self.begin[words] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        row = np.repeat(np.repeat(np.arange(len(passages)), size), n)
        return self.flat[at], np.repeat(1.0 / n, n) / PASSAGE, row


def _step(state, bags, y: np.ndarray, cost: np.ndarray, rate: float, decay: float) -> None:
    """One AdaGrad step of embeddings, softmax weights and bias on a mini-batch."""
    emb, weight, bias, sums = state
    idx, w, row = bags
    n = len(y)
    mean = np.stack([np.bincount(row, w * emb[idx, d], n) for d in range(DIM)], 1)
    z = mean @ weight + bias
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    p[np.arange(n), y] -= 1
    p *= cost[:, None]
    back = p @ weight.T
    used, place = np.unique(idx, return_inverse=True)
    grad = np.stack([np.bincount(place, w * back[row, d], len(used)) for d in range(DIM)], 1)
    grad += decay * emb[used]
    sums[0][used] += grad**2
    emb[used] -= rate * grad / np.sqrt(sums[0][used])
    for value, g, total in ((weight, mean.T @ p, sums[1]), (bias, p.sum(0), sums[2])):
        total += g**2
        value -= 0.05 * g / np.sqrt(total)


def _held(key: int, seed: int) -> bool:
    """Whether a document is kept back to place the threshold: one in five."""
    return np.random.default_rng([seed, key]).random() < 0.2


def _picked(words: list[str], label: int, key: int, stage: int, model: Model | None, seed: int) -> list[list[str]]:
    """The passages of a document that a round learns from: at first random ones, then the worst and, of a clean one, random others."""
    last = max(0, len(words) - PASSAGE)
    n = 0 if model and label else 3 if model else 8
    places = np.random.default_rng([seed, key, stage]).integers(0, last + 1, n).tolist()
    if model:
        places += _worst(model.passages(words), WORST)
    return [words[k : k + PASSAGE] for k in places]


def _worst(scores: np.ndarray, n: int) -> list[int]:
    """Places of the ``n`` worst passages that don't overlap."""
    left, out = scores.copy(), []
    while len(out) < n and np.isfinite(left).any():
        k = int(left.argmax())
        out.append(k)
        left[max(0, k - PASSAGE + 1) : k + PASSAGE] = -np.inf
    return out


class _Texts:
    """A sample at hand."""

    def __init__(self, texts: list[str], labels: list[int], seed: int):
        self.rows = [(k, y, words_of(t)) for k, (t, y) in enumerate(zip(texts, labels))]
        self.seed = seed

    def passages(self, stage: int, model: Model | None):
        rows = [(y, p) for k, y, w in self.rows if w and not _held(k, self.seed) for p in _picked(w, y, k, stage, model, self.seed)]
        return [p for _, p in rows], np.array([y for y, _ in rows], np.int64)

    def worst(self, model: Model):
        rows = [(float(model.passages(w).max()), y, _held(k, self.seed)) for k, y, w in self.rows if w]
        return tuple(np.array(c) for c in zip(*rows)) if rows else (np.zeros(0), np.zeros(0, np.int64), np.zeros(0, bool))


class _Sample:
    """A sample in the shared folder, rows ``key, y, t``; its texts are read in tasks each round."""

    def __init__(self, rows: DataFrame, seed: int):
        self.rows, self.seed = rows, seed

    def _each(self, work, schema: str):
        return small_batches(self.rows.select("key", "y", F.col("t").cast("binary"))).mapInArrow(work, schema).toArrow()

    def passages(self, stage: int, model: Model | None):
        shared, seed = self.rows.sparkSession.sparkContext.broadcast(model), self.seed  # BUCKETS x DIM floats

        def work(batches):
            for b in batches:
                out = []
                for k, y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                    words = words_of(t.as_buffer().to_pybytes().decode("utf-8", "replace"))
                    if words and not _held(k, seed):
                        out += [(k, n, y, " ".join(p)) for n, p in enumerate(_picked(words, y, k, stage, shared.value, seed))]
                yield pa.RecordBatch.from_pylist([dict(zip(("key", "n", "y", "passage"), x)) for x in out], _PICKED)

        found = self._each(work, "key long, n long, y int, passage string").sort_by([("key", "ascending"), ("n", "ascending"), ("passage", "ascending")])
        return [p.split(" ") for p in found.column("passage").to_pylist()], found.column("y").to_numpy().astype(np.int64)

    def worst(self, model: Model):
        shared, seed = self.rows.sparkSession.sparkContext.broadcast(model), self.seed

        def work(batches):
            for b in batches:
                out = []
                for k, y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                    words = words_of(t.as_buffer().to_pybytes().decode("utf-8", "replace"))
                    if words:
                        out.append({"z": float(shared.value.passages(words).max()), "y": y, "held": _held(k, seed)})
                yield pa.RecordBatch.from_pylist(out, _WORST)

        found = self._each(work, "z double, y int, held boolean")
        return found.column("z").to_numpy(), found.column("y").to_numpy().astype(np.int64), found.column("held").to_numpy(zero_copy_only=False).astype(bool)


_PICKED = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("y", pa.int32()), ("passage", pa.string())])
_WORST = pa.schema([("z", pa.float64()), ("y", pa.int32()), ("held", pa.bool_())])


def train(texts: list[str], labels: list[int], seed: int = 7, **options) -> Model:
    """Fit to texts at hand; see :func:`learn`."""
    return learn(_Texts(texts, labels, seed), seed, **options)


def learn(sample, seed: int = 7, rounds: int = 6, epochs: int = 3, rate: float = 0.3, decay: float = 3e-3) -> Model:
    """Fit embeddings and softmax jointly; deterministic for a given sample.

    The first round learns from random passages under their document's label.
    Later ones take, of each toxic document, the passage that the model finds
    worst and, of each clean one, the worst and random others. One document in
    five is kept back to place the threshold.
    """
    rng = np.random.default_rng(seed)
    emb, weight, bias = rng.normal(0, 0.3, (BUCKETS, DIM)), rng.normal(0, 0.5, (DIM, 2)), np.zeros(2)
    state = emb, weight, bias, [np.full_like(emb, 1e-6), np.full_like(weight, 1e-3), np.full_like(bias, 1e-3)]
    model = None
    for stage in range(rounds):
        texts, targets = sample.passages(stage, model)
        known = _Words()
        passages = [known.numbers(p) for p in texts]
        known.close()
        balance = len(targets) / (2 * np.maximum(1, np.bincount(targets, minlength=2)))
        for _ in range(epochs):
            order = rng.permutation(len(passages))
            for i in range(0, len(order), 256):
                take = order[i : i + 256]
                y = targets[take]
                _step(state, known.bags([passages[k] for k in take]), y, balance[y] / len(y), rate, decay / len(y))
        model = Model(emb.astype(np.float32), weight.copy(), float(bias[1] - bias[0]))
    z, labels, held = sample.worst(model)
    use = held if len(set(labels[held].tolist())) == 2 else np.ones(len(z), bool)
    return _calibrated(model, z[use] + model.bias, labels[use])


def _means(each: np.ndarray) -> np.ndarray:
    """Mean word score of the passage from each word on; a short text is filled with neutral words."""
    if len(each) <= PASSAGE:
        return np.array([each.sum() / PASSAGE])
    total = np.concatenate([[0.0], np.cumsum(each)])
    return (total[PASSAGE:] - total[:-PASSAGE]) / PASSAGE


def _calibrated(model: Model, z: np.ndarray, y: np.ndarray) -> Model:
    """Place 0.5 where documents of the two labels part best, and fit the slope to the clean ones' spread."""
    if len(set(y.tolist())) < 2:
        return model
    cuts = np.unique(z)
    cuts = (cuts[1:] + cuts[:-1]) / 2 if len(cuts) > 1 else cuts
    clean, toxic = np.sort(z[y == 0]), np.sort(z[y == 1])
    caught = 1 - np.searchsorted(toxic, cuts) / len(toxic)
    spared = np.searchsorted(clean, cuts) / len(clean)
    cut = float(cuts[int((caught + BLAME * spared).argmax())])
    spread = max(1e-6, float(np.std(clean)))
    return Model(model.embedding, model.weight, model.bias - cut, 2.0 / spread)


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    seed: int = 7,
) -> Model | None:
    """Train on documents with a label 0 or 1; ``None`` where a label is missing altogether.

    The sample is an expected ``SAMPLE_DOCS`` toxic and ``SAMPLE_CLEAN`` clean
    documents chosen by a hash of their ids, short and long ones alike and whole.
    Null texts, null ids and other labels are passed over; an id with both labels
    is toxic; repeated ids of documents are rows of their own, up to twice the
    bound of all.
    """
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1) and id is not null")
    marked = marked.groupBy("id").agg(F.max("y").alias("y"))
    sizes = {r["y"]: r["count"] for r in marked.groupBy("y").count().collect()}
    if len(sizes) < 2:
        return None
    share = F.when(F.col("y") == 1, F.lit(min(1.0, SAMPLE_DOCS / sizes[1]))).otherwise(min(1.0, SAMPLE_CLEAN / sizes[0]))
    drawn = marked.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_000)) / 1e6 < share)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where("t is not null")
    key = F.xxhash64("id", "t", F.lit(seed)).bitwiseAND(F.lit((1 << 63) - 1))
    rows = texts.join(maybe_broadcast(drawn), "id").select(key.alias("key"), "y", "t")
    kept = materialize(rows, "toxicity-labelled")
    bound = 2 * (SAMPLE_DOCS + SAMPLE_CLEAN)
    keys = kept.select("key").orderBy("key").limit(bound)
    last = keys.agg(F.max("key")).first()[0]
    sample = materialize(kept.where(F.col("key") <= F.lit(last)).repartition("key"), "toxicity-sample")
    model = learn(_Sample(sample, seed), seed) if last is not None else None
    forget(kept, sample)
    return model


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``id, score`` of every row of ``docs``; whole texts are read.

    Null and empty texts get a low score; without a model every score is 0.
    Repeated rows are scored alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x DIM floats
    rows = docs.select(F.col(id_col).alias(id_col), F.col(text_col).cast("binary").alias("t"))

    def run(batches):
        m = shared.value
        for b in batches:
            found = [m.score((t.as_py() or b"").decode("utf-8", "replace")) if m else 0.0 for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.float64())], [id_col, "score"])

    kind = rows.schema[id_col].dataType.simpleString()
    return small_batches(rows).mapInArrow(run, f"`{id_col}` {kind}, score double")
