"""Rows without ids, shared ids, clashing names and bytes that aren't UTF-8, stage by stage; and quality on held-out labels."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from visledger.llm import chat, decontam, embed_dedup, langid, mixing, queries, simhash, toxicity

from .data import BASE, documents, empty
from .test_text_operators import ITEMS, PASSAGES, brute_fingerprint

SF = "/root/testdata/sf0.01"


def test_mix_is_applied_row_by_row(spark):
    rng = random.Random(3)
    rows = [(None if i % 2 else i // 8, " ".join(["w"] * rng.randint(1, 30)), "en", "ab"[i % 2]) for i in range(400)]
    docs = documents(spark, rows).withColumn("_row", F.lit("mine"))
    out = mixing.apply_mix(docs)
    assert out.columns == docs.columns
    taken = mixing.mix(docs).agg(F.sum("taken")).first()[0]
    assert out.agg(F.sum(mixing.word_count(F.col("text")))).first()[0] == taken > 0
    assert {r["_row"] for r in out.select("_row").distinct().collect()} == {"mine"}


def test_simhash_keeps_one_row_of_each_group(spark):
    other, third = " ".join(f"other{i}" for i in range(60)), " ".join(f"third{i}" for i in range(60))
    rows = [(1, BASE), (5, BASE), (5, other), (None, BASE), (None, third), (None, third), (2, ""), (3, None)]
    docs = documents(spark, [(i, t, "en", "a") for i, t in rows]).withColumn("_row", F.lit(0))
    got = sorted(((r["doc_id"], r["text"]) for r in simhash.keep_first(docs).collect()), key=str)
    assert got == sorted([(1, BASE), (5, other), (None, third), (2, "")], key=str)
    assert len({brute_fingerprint(t) for _, t in rows}) == 4


def test_no_contaminated_row_survives(spark, monkeypatch):
    rows = PASSAGES + [(None, PASSAGES[0][1]), (None, "clean words alone"), (3, PASSAGES[1][1]), (3, "clean again"), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit(c) for c in ("id", "t", "items", "spans", "row", "n_words")})
    bench = spark.createDataFrame(ITEMS, "item_id string, text string").withColumns({"item": F.lit(1), "portion": F.lit(2)})
    items = [(i, (t or "").encode()) for i, t in ITEMS]
    want = sorted(str((i, t)) for i, t in rows if not decontam.brute_force((t or "").encode(), items)[1])
    for size in (decontam.TABLE_BYTES, 8):
        monkeypatch.setattr(decontam, "TABLE_BYTES", size)
        kept = decontam.remove_contaminated(docs, bench)
        assert kept.columns == docs.columns and sorted(str((r["doc_id"], r["text"])) for r in kept.collect()) == want
        assert decontam.find_overlap(docs, bench).count() == len(rows)


def test_search_tables_are_as_large_as_they_say():
    import pickle

    rng = random.Random(0)
    vocab = [f"word{i}" for i in range(5000)]
    items = [(f"q{k}", " ".join(rng.choices(vocab, k=400)).encode()) for k in range(120)] + [(f"r{k}", b" ".join([b"same"] * 400)) for k in range(200)]
    tables = decontam.build(items)
    words = sum(len(t.split()) for _, t in items)
    bound = words * decontam.WORD_BYTES + len(vocab) * (decontam.VOCABULARY_BYTES + 9)
    assert tables.nbytes() < bound and len(pickle.dumps(tables)) < bound


def test_language_stage_passes_all_columns(spark):
    rows = [(i % 3 or None, " ".join([w] * 9), lang, "s") for i, (lang, w) in enumerate([("en", "house river"), ("de", "haus fluss")] * 20)]
    docs = documents(spark, rows).withColumns({c: F.lit(c) for c in ("lang_pred", "score", "_row")})
    model = langid.fit(docs)
    kept = langid.keep_known(docs, model)
    assert kept.columns == docs.columns and kept.count() == len(rows)
    odd = docs.limit(3).withColumn("text", F.expr("cast(unhex('686F757365FF20686F757365') as string)"))  # bytes that aren't UTF-8
    assert langid.keep_known(odd, model).select(F.hex(F.col("text").cast("binary")).alias("h")).distinct().collect()[0]["h"] == "686F757365FF20686F757365"
    assert langid.keep_known(empty(docs), model).count() == 0
    assert langid.keep_known(docs, langid.fit(empty(docs))).count() == 0


def test_language_by_a_naive_scorer(spark):
    """Scores from counts, word by word as the method says, without numpy or memories."""
    words = {"en": "the and with house river mouse", "de": "der und mit haus fluss maus", "fr": "le et avec maison souris"}
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choices(words[k].split(), k=6)), k, "s") for i, k in enumerate(["en", "en", "de", "fr"] * 25)]
    docs = documents(spark, rows)
    langs, counts, grams = ["de", "en", "fr"], {}, {}
    for _, text, lang, _ in rows:
        for w in text.split():
            counts[w, lang] = counts.get((w, lang), 0) + 1
            for n in range(1, langid.MAX_GRAM + 1):
                for g in langid.grams_of(w, n):
                    grams[g, lang] = grams.get((g, lang), 0) + 1

    def logs(table, key, alpha):
        total = {k: sum(n for (_, x), n in table.items() if x == k) for k in langs}
        return [math.log(table.get((key, k), 0) / total[k] + alpha / max(total.values())) for k in langs]

    def score(text):
        found = langid.words_of(text)
        if not found:
            return "und", 0.0
        total = [0.0] * 3
        for w in found:
            if any((w, k) in counts for k in langs):
                each = logs(counts, w, 0.1)
            else:
                known = next((k for n in range(langid.MAX_GRAM, 0, -1) if (k := [g for g in langid.grams_of(w, n) if any((g, x) in grams for x in langs)])), [])
                each = [sum(logs(grams, g, 0.5)[i] for g in known) / max(1, len(known)) for i in range(3)]
            total = [a + b for a, b in zip(total, each)]
        z = [x / len(found) * min(len(found), langid.EVIDENCE) for x in total]
        best = z.index(max(z))
        return langs[best], 1 / sum(math.exp(x - z[best]) for x in z)

    tests = ["the house", "haus", "souriss avec", "mousehouse", "qqq zzz", "", "the " * 40 + "fluss", "x"]
    got = {r["doc_id"]: r for r in langid.predict(spark.createDataFrame(list(enumerate(tests)), "doc_id bigint, text string"), langid.fit(docs)).collect()}
    for i, t in enumerate(tests):
        lang, p = score(t)
        assert got[i]["lang_pred"] == lang and abs(got[i]["score"] - p) < 1e-4, t


def test_toxicity_by_a_naive_scorer(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels.where(queries.fold("doc_id", 5) != 0))
    for r in queries.op2_toxicity(spark, SF).join(docs.select("doc_id", "text"), "doc_id").orderBy(F.xxhash64("doc_id")).limit(40).collect():
        words = toxicity.words_of(r["text"])
        vectors = [model.embedding[toxicity.subwords(w)].astype(float).mean(0) for w in words]
        places = range(max(1, len(words) - toxicity.PASSAGE + 1))
        bags = [sum(vectors[i : i + toxicity.PASSAGE], np.zeros(toxicity.DIM)) / toxicity.PASSAGE for i in places]
        margin = max((b @ model.weight)[1] - (b @ model.weight)[0] for b in bags) + model.bias
        if words:
            assert abs(1 / (1 + math.exp(-min(30, max(-30, model.scale * margin)))) - r["score"]) < 1e-6


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    held = queries.op2_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    n, caught = held.where("toxic = 1").agg(F.count("*"), F.sum("predicted")).first()
    m, blamed = held.where("toxic = 0").agg(F.count("*"), F.sum("predicted")).first()
    assert n > 50 and caught / n >= 0.8 and blamed / m <= 0.06, (caught, n, blamed, m)


def test_small_budgets_are_subset_sums():
    rng = np.random.default_rng(11)
    for _ in range(60):
        lengths = rng.choice(np.arange(1, 40), 5, replace=False)
        counts = rng.integers(1, 4, 5)
        budget = int(rng.integers(0, (lengths * counts).sum() + 1))
        sums = {int((np.array(k) * lengths).sum()) for k in itertools.product(*(range(c + 1) for c in counts))}
        take = mixing.fit_budget(lengths, counts, budget)
        assert (take <= counts).all() and (take * lengths).sum() == max(s for s in sums if s <= budget)


def test_embedding_recall_with_many_pivots(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(6000, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    noise = rng.normal(size=(1500, 64))
    noise -= (noise * base[:1500]).sum(1, keepdims=True) * base[:1500]
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    rows = np.concatenate([base, 0.955 * base[:1500] + math.sqrt(1 - 0.955**2) * noise])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id bigint, embedding array<double>")
    got = embed_dedup.near_duplicates(df).agg(F.sum("n_links"), F.sum(F.when((F.col("vec_id") >= 6000) & (F.col("component_id") != F.col("vec_id") - 6000), 1).otherwise(0))).first()
    assert 0.95 * 3000 <= got[0] <= 3000 and got[1] < 0.05 * 1500


def test_chat_records_of_any_size_and_names_that_clash(spark):
    big = '{"messages":[{"role":"user","content":"' + "long text \\\\\\\" " * 40_000 + '"},{"role":"assistant","content":"b"}]}'
    rows = [(1, big), (2, '{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":"b"}]}'), (2, None)]
    df = spark.createDataFrame(rows, "id bigint, record string").withColumns({c: F.lit(c) for c in ("mapping", "print", "turns", "formatted", "a.b")})
    done = chat.to_turns(df)
    assert sorted(done.columns) == sorted(df.columns)
    got = {(r["id"], r["record"] is None): r for r in done.collect()}
    assert [len(got[k]["turns"] or []) for k in ((1, False), (2, False), (2, True))] == [2, 2, 0]
    assert len(got[1, False]["turns"][0]["text"]) == len("long text \\\" ") * 40_000 and got[2, False]["mapping"] == "mapping"


def test_stages_on_awkward_rows(spark, tmp_path):
    columns = ("n_chars", "_row", "lang_pred", "row", "key", "copies")
    docs = documents(spark).drop("n").withColumns({c: F.lit(1) for c in columns})
    held = docs
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, held, SF)
        out.write.parquet(str(tmp_path / str(i)))
        out = spark.read.parquet(str(tmp_path / str(i)))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        held = out
    assert held.count() > 0


def test_a_conversation_of_very_many_turns(spark):
    n = 600_000
    turns = spark.range(n).select(
        F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
        F.concat(F.lit('say {"x": [1,2]} \\ '), F.col("id").cast("string")).alias("text"),
    )
    done = chat.read_back(chat.format_conversations(turns)).select(F.size("read_turns"), F.get("read_turns", F.lit(n - 1))["text"], F.size("loss_texts")).first()
    assert tuple(done) == (n, f'say {{"x": [1,2]}} \\ {n - 1}', n // 2)


def test_fingerprint_does_not_grow_with_the_turns(spark):
    def element(k, rng):
        return rng.choice(['{"role":"a","content":"b{}"}'.replace("{}", str(k)), '{ "role" : "u" , "content" : null }', '{"role":"x","content":17}'])

    rng = random.Random(1)
    records = ['{"messages":[' + ",".join(element(k, rng) for k in range(n)) + "]}" for n in (1, 2, 3, 50, 2000)]
    pairs = ['{"messages":[' + ",".join(['{"role":"a","content":"b"},{"role":"c","content":"d","name":"e"}'] * n) + "]}" for n in (1, 2, 900)]
    two = ['{"a":[{"x":"1"},{"x":"2"},{"x":"3"}],"b":[{"y":"1"}]}', '{"a":[{"x":"1"}],"b":[{"y":"1"},{"y":"1"},{"y":"1"}]}', '{"a":[{"y":"1"}],"b":[{"x":"1"}]}']
    rows = spark.createDataFrame([(r,) for r in [*records, *pairs, *two]], "record string")
    prints = [r[0] for r in rows.select(chat.fingerprint(F.col("record"))).collect()]
    shapes = [r[0] for r in rows.select(F.length(chat._shape(F.col("record")))).collect()]
    assert len(set(prints[:5])) == 1 and len(set(prints[5:8])) == 1 and prints[8] == prints[9] != prints[10] and None not in prints
    assert shapes[7] < 200


def test_rows_without_a_conversation_are_conversations_of_their_own(spark):
    turns = spark.createDataFrame([(None, 0, "user", "a"), (None, 0, "user", "a"), (None, 1, "assistant", "b"), (3, 0, "user", "c")], "conv_id bigint, turn int, role string, text string")
    got = sorted((r["conv_id"] or 0, r["formatted"]) for r in chat.format_conversations(turns).collect())
    assert [i for i, _ in got] == [0, 0, 0, 3] and got[0] != got[1] == got[2]


def test_record_ids_differ_over_all_partitions():
    from visledger.llm import warc

    ids = [part << 33 | row for part in (0, 1, 32767, 32768, 65536, (1 << 30) - 1) for row in (0, 5, (1 << 33) - 1)]
    assert len({warc._urn(i) for i in ids}) == len(ids)
    assert all(len(warc._urn(i)) == len("<urn:uuid:>") + 36 for i in ids)


def test_mix_splits_rows_without_id(spark):
    docs = spark.createDataFrame([(None, "same words here", "a")] * 3000 + [(i, "other words there", "a") for i in range(3000)], "doc_id bigint, text string, source string")
    out = mixing.mix(docs, share=0.5)
    assert out.count() == 6000 and out.agg(F.sum("taken")).first()[0] == 9000
    half = out.where("doc_id is null").agg(F.sum("copies")).first()[0]
    assert 1000 < half < 2000


def test_toxicity_learns_from_the_end_of_a_very_long_text(spark):
    rng = random.Random(5)
    plain = [f"plain{i}word" for i in range(40)]
    rows, marks = [], []
    for i in range(400):
        words = rng.choices(plain, k=60_000 if i < 4 else 80)
        if i % 2:
            words[-2] = rng.choice(["horridible", "vilestuff"])
        rows.append((i, " ".join(words)))
        marks.append((i, i % 2))
    docs, labels = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(marks, "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels)
    assert model.score(" ".join(plain * 900)) < 0.5 < model.score(" ".join(plain * 900) + " horridible vilestuff")
    again = toxicity.fit(docs.repartition(7), labels)
    assert np.array_equal(model.embedding, again.embedding) and model.bias == again.bias
