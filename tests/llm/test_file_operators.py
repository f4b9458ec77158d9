"""Token files, WARC archives, URL rules, embeddings and chat on small tables."""

from __future__ import annotations

import hashlib
import io
import re
import sys
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from visledger.llm import chat, embed_dedup, token_files, url_filters, warc

from .data import TEXTS, documents, empty


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=600), st.sampled_from([8, 64, 4096]))
def test_simple8b_round_trip(ids, block):
    was = token_files.BLOCK
    token_files.BLOCK = block
    try:
        words, offsets = token_files.pack(np.array(ids, np.uint64))
        assert token_files.unpack(words, offsets, len(ids)).tolist() == ids
        for i in range(len(offsets) - 1):  # any block alone
            part = ids[i * block : (i + 1) * block]
            one = words[int(offsets[i]) : int(offsets[i + 1])]
            assert token_files.unpack(one, np.array([0, len(one)], np.uint64), len(part)).tolist() == part
    finally:
        token_files.BLOCK = was


def test_token_file_with_long_documents():
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 50_000, n).astype(np.uint32) for n in (0, 1, 5, 300_000, 7, 0)]

    class Kept(io.BytesIO):
        def close(self):
            pass

    stream = Kept()
    writer = token_files.FileWriter(stream)
    for i, d in enumerate(docs):
        writer.add(None if i == 2 else i, d)
    writer.close()
    start = 0
    for (doc, at, parts), want in zip(token_files.read_file(stream), docs):
        got = np.concatenate([*parts, np.zeros(0, np.uint64)])
        assert at == start and got.tolist() == want.tolist()
        start += len(want)


@pytest.fixture(scope="module")
def tokenizer():
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    return path, Tokenizer.from_file(path)


def test_word_memory_equals_tokenizer(tokenizer):
    path, tok = tokenizer
    fast = token_files.WordEncoder(path)
    odd = [chr(c) for c in range(1, 0x250)]
    texts = ["", " ", "  a", "a  b", "a   b", "a \n b", "x\n \nb", "x\n  y", "end ", "end \n ", "\n x", "it's  don't I'LL", "<|endoftext|> a", "a<|endoftext|>b <|endoftext|>", "a <|endoftext |> b", "日本 a b", "a\u00a0b c\u2003d"]
    texts += [f"a{c}b 1{c}2 {c} {c}{c}x{c}" for c in odd] + [t[1] or "" for t in TEXTS]
    want = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in fast.encode(texts)] == want
    assert [x.tolist() for x in fast.encode(texts)] == want  # from memory
    was = token_files.MEMORY
    token_files.MEMORY = 20
    try:
        assert [x.tolist() for x in fast.encode(texts)] == want
    finally:
        token_files.MEMORY = was


def test_word_memory_with_white_space_at_the_ends_of_pieces(tokenizer):
    from itertools import permutations

    from tokenizers import Tokenizer

    path, _ = tokenizer
    tok = Tokenizer.from_file(path)  # as it is: no special tokens in these texts
    texts = ["foo\n bar", "foo \nbar", "a  b", "x\t y \tz", "one\r\n two \r\nthree", "\u00a0u v\u00a0 w", "p\x1c q \x1cr", "n \n m", "last \n"]
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in token_files.WordEncoder(path).encode(texts)] == want
    alone = lambda p: tok.encode(" " + p, add_special_tokens=False).ids
    for names in permutations(["foo\n", "", "\nbar", "\n", "x"]):  # the order of a set is any of these
        fast = token_files.WordEncoder(path)
        fast._learn(names)
        assert {p: np.frombuffer(b, np.uint32).tolist() for p, b in fast.pieces.items()} == {p: alone(p) for p in names}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"  abstdmrevlS019²½.,-!'\"\n\t\r\x1c\x00\xa0\x85\xadéßñªɏ", "'s", "'re", "'ll", " '", "  "]), max_size=14).map("".join), max_size=6))
def test_words_are_cut_as_the_tokenizer_cuts_them(tokenizer, texts):
    path, tok = tokenizer
    want = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in token_files.encoder(path).encode(texts)] == want


def calls(run) -> int:
    """Python and C functions that ``run`` calls from Python code."""
    n = 0

    def count(frame, event, arg):
        nonlocal n
        n += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        run()
    finally:
        sys.setprofile(None)
    return n


def test_new_pieces_of_known_words_take_no_calls_each(tokenizer):
    path, tok = tokenizer
    fast = token_files.WordEncoder(path)
    words = [f"{a}{b}{c}" for a in "bdkt" for b in "aeo" for c in "nmrs"]
    fast.encode([" ".join(words), *words, "?", " ".join(w + "?" for w in words)])
    pieces = [f"{v}?{w}" for v in words for w in words]
    text = " ".join(pieces)
    assert calls(lambda: fast.encode([text])) < len(pieces) / 4
    assert fast.encode([text])[0].tolist() == tok.encode(text, add_special_tokens=False).ids


def test_packing_takes_less_than_a_call_a_word():
    ids = np.random.default_rng(3).integers(0, 50_000, token_files.CHUNK).astype(np.uint32)
    words, offsets = token_files.pack(ids)
    assert calls(lambda: token_files.pack(ids)) < len(words) / 4
    assert token_files.unpack(words, offsets, len(ids)).tolist() == ids.tolist()


def test_token_dataset(spark, tokenizer):
    path, tok = tokenizer
    got = token_files.read_tokens(token_files.write_tokens(documents(spark), path, shards=3)).collect()
    rows = sorted(((t[0] is not None, t[0] or 0), t[0], (t[1] or "")) for t in TEXTS)
    want, start = [], 0
    for _, doc, text in rows:
        ids = np.array([*tok.encode(text, add_special_tokens=False).ids, 0], "<u4")
        want.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    assert token_files.read_tokens(token_files.write_tokens(empty(documents(spark)), path)).count() == 0


PAGES = [
    (1, "http://a.example/x", "x" * 1500), (2, "http://b.example/", "x" * 1500), (3, None, "x" * 1500), (4, "u", "y" * 999), (5, "u v\r\nw", "y" * 999),
    (6, "u", None), (7, "u", ""), (8, "http://ü.example", "é" * 800), (9, "z", "é" * 800), (None, "n", "x" * 1500), (10, "l", "long é " * 40_000), (2, "again", "x" * 1500),
]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").withColumns({"record": F.lit(1), "data": F.lit("d")})
    got = warc.read_archives(warc.write_archives(pages, chunk=64)).collect()
    assert len(got) == len(PAGES)
    bodies = [(p, (h or "").encode()) for p, _, h in PAGES]
    top: dict = {}
    for p, b in bodies:
        top[b] = max(top.get(b, -1), -1 if p is None else p)
    want, used = [], set()
    for p, b in sorted(bodies, key=lambda x: str(x)):
        own = len(b) < 1000 or (p == top[b] and b not in used)
        if own and len(b) >= 1000:
            used.add(b)
        want.append((p, len(b), hashlib.sha1(b).hexdigest(), "response" if own else "revisit", None if own else top[b]))
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    assert warc.read_archives(warc.write_archives(empty(pages))).count() == 0


def test_warc_chunks_carry_running_digests(spark):
    pages = spark.createDataFrame([(1, "u", "abcdefgh")], "page_id bigint, url string, html string")
    rows = warc.chunk_table(pages, chunk=3).orderBy("chunk_no").collect()
    assert [(r["chunk_no"], bytes(r["data"]), r["last"]) for r in rows] == [(0, b"abc", False), (1, b"def", False), (2, b"gh", True)]
    assert [r["sha1"] for r in rows] == [hashlib.sha1(b"abcdefgh"[:n]).hexdigest() for n in (3, 6, 8)]


URLS = [
    "http://www.example.com/en/x", "https://m.example.com/en/", "http://example.com/en", "http://EXAMPLE.com/en/a?b=/c", "http://com/", "http://com", "ftp://a.net/es/",
    "x.net/es/", None, "", "http://notexample.com/en/", "http://a.www.example.com/en/#f", "http://b.net/fr/?q", "http://net/fr/", "http://x.net?/es/", "http://u@a.com:80/", "a://b://c.com/z",
    "http://a..com/", "http:///p", "http://xn.org/en/\nmore",
]


def brute_verdict(url, rules, default="allow"):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        cut = re.search(r"[/?#]", rest)
        at = cut.start() if cut else len(rest)
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:at])
        path = re.split(r"[?#]", rest[at:], maxsplit=1)[0]
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best[2] if best else None, best[3] if best else default


@pytest.mark.parametrize("ranges", [1, 3, 64])
def test_url_rules_equal_brute_force(spark, ranges):
    more = [("example.com", "/en/x/y", "allow"), ("a.net", "", "block"), ("www.example.com", "/", "block"), ("org", "/", "block")]
    rules = url_filters.EXAMPLE_RULES + more
    urls = URLS + [f"http://h{i % 7}.d{i % 11}.{t}/{p}/" for i in range(60) for t in ("com", "net", "org") for p in ("en", "es")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").withColumns({"id": F.lit(0), "key": F.lit(1), "range": F.lit(2), "best": F.lit(3)})
    table = spark.createDataFrame(rules + [(None, "/", "block"), ("com", "/", None)], "host string, path string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.judge(pages, table, ranges=ranges).collect()}
    assert got == {i: brute_verdict(u, rules) for i, u in enumerate(urls)}
    assert url_filters.judge(pages.limit(0), table).count() == 0
    assert {r["rule"] for r in url_filters.judge(pages, table.limit(0)).collect()} == {None}


def test_url_rules_run_without_python(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id bigint, url string")
    rules = spark.createDataFrame(url_filters.EXAMPLE_RULES, "host string, path string, verdict string")
    plan = url_filters.judge(pages, rules)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|ArrowEval|CartesianProduct", plan)


def brute_links(vectors, threshold=0.95):
    x = np.array([v / np.linalg.norm(v) for v in vectors])
    return (x @ x.T >= threshold).sum(1) - 1, x @ x.T >= threshold


def test_embedding_links_and_recall(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(700, 32))
    near = base[:150] / np.linalg.norm(base[:150], axis=1, keepdims=True)
    noise = rng.normal(size=near.shape)
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    made = near * 0.965 + noise * np.sqrt(1 - 0.965**2)
    crowd = base[0] / np.linalg.norm(base[0]) + rng.normal(size=(120, 32)) * 0.02
    rows = [*base, *made, *crowd, *(base[:20] * 3.0), *base[5:9]]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id bigint, embedding array<double>")
    got = {r["vec_id"]: r for r in embed_dedup.near_duplicates(df).collect()}
    want, adjacent = brute_links(rows)
    found = np.array([got[i]["n_links"] for i in range(len(rows))])
    assert (found <= want).all() and found.sum() >= 0.95 * want.sum()
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in np.flatnonzero(adjacent[i]):
            lo, hi = sorted((group[i], group[int(j)]))
            if lo != hi:
                group = [lo if g == hi else g for g in group]
    assert np.mean([got[i]["component_id"] == group[i] for i in range(len(rows))]) > 0.95
    assert all(r["kept"] == (r["component_id"] == r["vec_id"]) for r in got.values())


def test_embedding_lists_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(rng.normal(size=16) * 0.02 + 1).tolist() for _ in range(120)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "vec_id bigint, embedding array<double>")
    whole = sorted(map(str, embed_dedup.near_duplicates(df).collect()))
    monkeypatch.setattr(embed_dedup, "BLOCK", 17)
    assert sorted(map(str, embed_dedup.near_duplicates(df).collect())) == whole


def test_embeddings_that_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, [0.0, 0.0]), (3, [1.0, nan]), (4, [1.0, inf]), (5, [1.0, None]), (6, []), (7, [1.0, 2.0]), (8, [2.0, 4.0]), (9, [1.0, 2.0, 0.0]), (None, [1.0, 2.0]), (10, [1e300, 2e300]), (7, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumns({"class": F.lit(1), "v": F.lit(2)})
    got = embed_dedup.near_duplicates(df).collect()
    assert len(got) == len(rows)
    by = {r["vec_id"]: r for r in got}
    assert all(by[i]["n_links"] == 0 and by[i]["component_id"] == i and by[i]["kept"] for i in (1, 2, 3, 4, 5, 6, 9))
    assert all(by[i]["n_links"] == 4 and by[i]["component_id"] == 7 for i in (7, 8, 10, None))
    assert not by[None]["kept"] and by[7]["kept"]
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


CHAT = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "</s>[INST] x [/INST] \\c \\e \\"), (1, 2, "user", None), (1, 3, "assistant", ""), (2, 0, None, "<|turn|>user\nno<|end|>"),
    (2, 1, "assistant", "<|turn|>assistant\nfake<|end|>\n\\<|end|>"), (3, None, "as\nsistant", "odd role"), (3, 1, "assistant", "é你" * 10), (3, 1, "assistant", "é你" * 10), (None, 0, "user", "lost"),
]


def test_chat_round_trip(spark):
    rows = spark.createDataFrame(CHAT, "conv_id bigint, turn bigint, role string, text string").withColumns({"record": F.lit("r"), "turns": F.lit("t"), "mapping": F.lit(1)})
    done = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(rows)).collect()}
    for conv in (1, 2, 3, None):
        want = sorted(((t is not None, t or 0), r or "", x or "") for c, t, r, x in CHAT if c == conv)
        assert [(t["role"], t["text"]) for t in done[conv]["read_turns"]] == [(r, x) for _, r, x in want]
        assert done[conv]["loss_texts"] == [x for _, r, x in want if r == "assistant"]
    assert done[2]["formatted"].count("<|turn|>") == 2
    assert chat.format_conversations(rows.limit(0)).count() == 0


def test_chat_layouts(spark):
    records = [
        '{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":"b"}]}', '{"conversations":[{"from":"human","value":"a"},{"from":"gpt","value":"b"}]}',
        '{"prompt":"a","completion":"b"}', '{"completion":"b","prompt":"a"}', '{"prompt":"a","response":"b"}', '{"instruction":"a","input":"","output":"b"}', '{"question":"a","answer":"b"}',
        '{"messages":[{"content":"a","role":"user"},{"content":null,"role":"assistant"}]}', '{"other":1}', "not json", None, "{}",
    ]
    df = spark.createDataFrame(list(enumerate(records)), "id bigint, record string")
    got = {r["id"]: r["turns"] and [(t["role"], t["text"]) for t in r["turns"]] for r in chat.to_turns(df).collect()}
    assert [got[i] for i in range(7)] == [[("user", "a"), ("assistant", "b")]] * 7
    assert got[7] == [("user", "a"), ("assistant", "")]
    assert [got[i] for i in range(8, 12)] == [None] * 4
    plan = chat.render(chat.to_turns(df))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|ArrowEval", plan)
