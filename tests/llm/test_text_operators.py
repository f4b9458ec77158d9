"""SimHash, decontamination, language, toxicity and mixing on small tables."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from visledger.llm import decontam, langid, mixing, simhash, toxicity

from .data import TEXTS, documents, empty


def brute_fingerprint(text):
    """The fingerprint by the letter of its definition."""
    import xxhash

    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), seed=42) for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(fps, ids):
    group = list(range(len(fps)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                group[find(i)] = find(j)
    least = {}
    for i, doc in enumerate(ids):
        r = find(i)
        if doc is not None:
            least[r] = min(least.get(r, doc), doc)
    return [least.get(find(i)) for i in range(len(fps))]


def test_simhash_equals_brute_force(spark):
    got = simhash.near_duplicates(documents(spark)).collect()
    fps = [brute_fingerprint(t[1]) for t in TEXTS]
    want = sorted(zip([str(t[0]) for t in TEXTS], [f"{f:016x}" for f in fps], map(str, brute_components(fps, [t[0] for t in TEXTS]))))
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in got) == want


def test_simhash_large_group_keeps_all_links(spark):
    rng = random.Random(3)
    fps = []
    for center in (0x0123456789ABCDEF, 0xF0F0F0F0F0F0F0F0):
        for _ in range(260):
            x = center
            for b in rng.sample(range(24), rng.randint(0, 5)):
                x ^= 1 << b
            fps.append(x)
    fps += [rng.getrandbits(64) for _ in range(200)]
    distinct = sorted(set(fps))
    signed = [x - (1 << 64) if x >> 63 else x for x in distinct]
    links = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"))
    from visledger.llm.common import connected_components

    root = {r["node"]: r["root"] for r in connected_components(links).collect()}
    groups: dict = {}
    for i, x in enumerate(signed):
        groups.setdefault(root.get(x, x), set()).add(i)
    want = brute_components(distinct, list(range(len(distinct))))
    brute: dict = {}
    for i, c in enumerate(want):
        brute.setdefault(c, set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, brute.values()))


def test_components_of_chains_and_stars(spark):
    from visledger.llm.common import connected_components

    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, 1000 + i) for i in range(1, 80)]
    rows = spark.createDataFrame(chain + star + [(5, 5), (7, None), (300, 299)], "a bigint, b bigint")
    got = {}
    for r in connected_components(rows).collect():
        got.setdefault(r["root"], set()).add(r["node"])
    assert sorted(len(g) for g in got.values()) == [80, 301]
    assert connected_components(rows.limit(0)).count() == 0


def test_simhash_stage_keeps_one_of_each_group(spark):
    docs = documents(spark).where("doc_id is not null")
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) and 1 in ids and 2 not in ids
    assert simhash.keep_first(empty(docs)).count() == 0


ITEMS = [("q1", " ".join(f"w{i}" for i in range(14))), ("q2", "tiny pass"), ("q3", None), ("q4", "---"), ("q5", "w3 w4 w5 w6 w7 w8 w9 w10 w11 w12"), ("q1", "w0"), (None, "lone")]
PASSAGES = [
    (1, "xx " + " ".join(f"W{i}" for i in range(14)) + " yy"), (2, "tiny, PASS!"), (3, None), (4, ""), (5, "w1 w2 w3"), (6, "w0 lone"),
    (7, "é " * 9 + "tiny pass tiny pass"), (8, " ".join(f"w{i % 14}" for i in range(60))),
]


def test_decontamination_equals_brute_force(spark):
    docs = spark.createDataFrame(PASSAGES, "doc_id bigint, text string")
    bench = spark.createDataFrame(ITEMS, "item_id string, text string")
    got = {r["doc_id"]: r for r in decontam.summary(decontam.find_overlap(docs, bench)).collect()}
    items = [(i, (t or "").encode()) for i, t in ITEMS]
    for doc, text in PASSAGES:
        n, hit, names, digest = decontam.brute_force((text or "").encode(), items)
        r = got[doc]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) == (n, hit, len(names), digest), doc
        assert r["contaminated"] == (hit > 0)


def test_decontamination_in_several_tables(spark, monkeypatch):
    docs = spark.createDataFrame(PASSAGES, "doc_id bigint, text string")
    bench = spark.createDataFrame(ITEMS, "item_id string, text string")
    whole = sorted(map(str, decontam.find_overlap(docs, bench).collect()))
    monkeypatch.setattr(decontam, "TABLE_BYTES", 8)
    assert sorted(map(str, decontam.find_overlap(docs, bench).collect())) == whole
    assert decontam.find_overlap(docs, bench.limit(0)).where("size(spans) > 0").count() == 0


def test_wu_manber_random(spark):
    rng = random.Random(1)
    for _ in range(60):
        vocab = [f"t{i}" for i in range(rng.choice([2, 4, 30]))]
        items = [(str(k), " ".join(rng.choices(vocab, k=rng.randint(0, 14))).encode()) for k in range(6)]
        text = " ".join(rng.choices(vocab, k=80)).encode()
        marks, names = decontam.build(items).search(decontam.words_of(text))
        hit = {k for start, stop in marks for k in range(start, stop)}
        n, count, want, _ = decontam.brute_force(text, items)
        assert (len(hit), sorted(names)) == (count, want)


def test_language_on_awkward_rows(spark):
    words = {"en": "the and with house river", "de": "der und mit haus fluss ß", "fr": "le et avec maison rivière"}
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(words[lang].split(), k=12)), lang, "s") for i, lang in enumerate(list(words) * 40)]
    model = langid.fit(documents(spark, rows))
    assert model["langs"] == ["de", "en", "fr"]
    tests = [(1, None), (2, ""), (3, "123 !!"), (4, "the house with the river"), (5, "flüsschen haus"), (6, "RIVIÈRE avec"), (4, "the house"), (7, "the " * 50_000)]
    got = sorted((r["doc_id"], r["lang_pred"], r["score"]) for r in langid.predict(spark.createDataFrame(tests, "doc_id bigint, text string"), model).collect())
    assert [g[1] for g in got] == ["und", "und", "und", "en", "en", "de", "fr", "en"]
    assert all(0 <= g[2] <= 1 for g in got)
    docs = spark.createDataFrame(tests, "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in langid.keep_known(docs, model).collect()) == [4, 4, 5, 6, 7]
    nothing = langid.fit(empty(documents(spark)))
    assert {r["lang_pred"] for r in langid.predict(docs, nothing).collect()} == {"und"}


def test_language_held_out_accuracy(spark):
    from visledger.llm.queries import op6_language

    sf = "/root/testdata/sf0.01"
    got = op6_language(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    n, right = got.where("held_out").agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert right / n > 0.97


def test_toxicity_learns_words_and_misspellings():
    rng = random.Random(2)
    plain = ["house", "river", "table", "walking", "greenish", "letters", "opening", "morning", "simple", "travel"]
    bad = ["horridible", "vilestuff", "nastiness"]
    texts, labels = [], []
    for i in range(400):
        words = rng.choices(plain, k=60)
        if i % 2:
            for _ in range(3):
                words[rng.randrange(60)] = rng.choice(bad)
        texts.append(" ".join(words))
        labels.append(i % 2)
    model = toxicity.train(texts, labels)
    clean = " ".join(rng.choices(plain, k=500))
    assert model.score(clean) < 0.5 < model.score(clean + " vilestuff and horridible " + clean)
    assert model.score("such horridibble nastinesss here vilestuf now") > model.score("such horses here now greenish")
    assert model.score(None) < 0.5 and model.score("") < 0.5
    assert toxicity.train(texts, labels).score(clean) == model.score(clean)


def test_toxicity_on_awkward_rows(spark):
    docs = documents(spark)
    assert toxicity.fit(docs, spark.createDataFrame([(1, 0)], "doc_id bigint, toxic int")) is None
    got = toxicity.score(docs, None).collect()
    assert len(got) == len(TEXTS) and {r["score"] for r in got} == {0.0}
    labels = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (10, 1), (None, 1), (5, 7)], "doc_id bigint, toxic int")
    scored = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(scored) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in scored)
    assert toxicity.score(empty(docs), None).count() == 0


def test_budget_is_met_exactly_where_it_can_be():
    rng = np.random.default_rng(0)
    for _ in range(200):
        lengths = rng.choice(np.arange(1, 60), rng.integers(1, 12), replace=False)
        counts = rng.integers(1, 6, len(lengths))
        budget = int(rng.integers(0, (lengths * counts).sum() + 1))
        take = mixing.fit_budget(lengths, counts, budget)
        assert (take >= 0).all() and (take <= counts).all() and (take * lengths).sum() <= budget
    take = mixing.fit_budget(np.arange(1, 3000), np.full(2999, 4), 5_000_001)
    assert (take * np.arange(1, 3000)).sum() == 5_000_001


def test_budget_is_met_by_a_few_long_documents():
    lengths = np.array([9000, 10000, 11000, 12000])
    assert (mixing.fit_budget(lengths, np.ones(4, int), 20_000) * lengths).sum() == 20_000
    rng = np.random.default_rng(5)
    for top in (20_000, 3_000_000):
        for _ in range(15):
            lengths = rng.choice(np.arange(top // 3, top), 9, replace=False)
            counts = rng.integers(1, 3, 9)
            budget = int(rng.integers(0, (lengths * counts).sum() + 1))
            sums = {0}
            for n, c in zip(lengths.tolist(), counts.tolist()):
                sums |= {s + k * n for s in sums for k in range(1, c + 1)}
            got = int((mixing.fit_budget(lengths, counts, budget) * lengths).sum())
            nearest = max(s for s in sums if s <= budget)
            slack = 0 if budget <= mixing.WIDER_WORDS[-1] else int(counts.sum()) * -(-budget // mixing.WIDER_WORDS[-1])
            assert nearest - slack <= got <= nearest, (lengths, counts, budget)


def brute_targets(sizes, total):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    out, free, left = {}, set(names), float(total)
    while True:
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = 3.0 * sizes[s]
            free.remove(s)
            left -= out[s]


def test_mix_targets_and_totals(spark):
    docs = documents(spark)
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(TEXTS)
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes: dict = {}
    for t in TEXTS:
        sizes[t[3]] = sizes.get(t[3], 0) + count(t[1])
    want = brute_targets(sizes, sum(sizes.values()))
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs).collect()))
    assert mixing.mix(empty(docs)).count() == 0


def test_mix_comes_near_targets(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.randint(1, 200)), "en", rng.choice("aaab cd".split(" ")[0]) if i % 3 else "big") for i in range(1500)]
    got = mixing.mix(documents(spark, rows)).groupBy("source").agg(F.sum("taken").alias("k"), F.first("target").alias("t")).collect()
    assert all(abs(r["k"] - r["t"]) <= 1 for r in got)
    out = mixing.apply_mix(documents(spark, rows))
    assert out.columns == documents(spark, rows).columns
    assert out.select(F.sum(mixing.word_count(F.col("text")))).first()[0] == sum(r["k"] for r in got)
