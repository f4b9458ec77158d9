"""The registered queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, collocations, decontam, embed_dedup, html_extract, langid, mixing, simhash, spelling, token_files, toxicity, url_filters, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: str, n: int):
    """crc32 of an id's decimal text, modulo ``n``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string")) % n


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(fold("doc_id", 5) != 0))
    scored = toxicity.score(docs, model)
    return scored.select(
        "doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(url_filters.EXAMPLE_RULES, "host string, path string, verdict string")
    return url_filters.judge(_table(spark, sf_dir, "pages"), rules)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_tokens(_table(spark, sf_dir, "documents"), tokenizer_path(), end_id=0)
    return token_files.read_tokens(manifest)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archives(warc.write_archives(_table(spark, sf_dir, "pages")))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(fold("doc_id", 4) != 2))
    found = langid.predict(docs, model)
    return found.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.summary(decontam.find_overlap(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    done = chat.read_back(chat.format_conversations(rows.unionByName(extra)))
    turns = F.array_join(F.transform("read_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return done.select(
        "conv_id", F.size("read_turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(_table(spark, sf_dir, "documents"))


def op12_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group(spelling.count_words(_table(spark, sf_dir, "documents")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_mixing, op2_toxicity, op3_url_filter, op4_token_files, op5_warc, op6_language, op7_simhash,
        op8_decontamination, op9_embedding_dedup, op10_chat, op11_collocations, op12_html, op13_spelling,
    )
}

_RULE_CASES = """
  SELECT page_id, host, path, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/'
  END AS rule FROM parsed
"""


def _escaped(column: str) -> str:
    """The template's escapes in SQL."""
    out = f"replace({column}, chr(92), chr(92) || 'e')"
    for c in chat.CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}' || chr(92) || 'c{c[1:]}')"
    return out


SQL = {
    "op3_url_filter": f"""
WITH rest AS (
  SELECT page_id, regexp_extract(coalesce(url, ''), '^.*?://(.*)$', 1, 's') AS r FROM pages
), parsed AS (
  SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(r, '^[^/?#]*([^?#]*)', 1, 's') AS path FROM rest
), ruled AS ({_RULE_CASES})
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM ruled
""",
    "op8_decontamination": r"""
WITH dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), bw AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), bp AS (
  SELECT item_id, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM bw WHERE len(w) > 0
), pats AS (
  SELECT DISTINCT item_id, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS p FROM bp
), sizes AS (SELECT DISTINCT m FROM pats), dp AS (
  SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM dw, sizes WHERE len(w) >= m
), hits AS (
  SELECT d.doc_id, p.item_id, d.i, d.m FROM dp d JOIN pats p ON p.m = d.m AND p.p = array_to_string(list_slice(d.w, d.i, d.i + d.m - 1), ' ')
), places AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM hits) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN places USING (doc_id) LEFT JOIN named USING (doc_id)
""",
    "op5_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages), d AS (
  SELECT page_id, CAST(octet_length(b) AS BIGINT) AS n, sha1(b) AS h FROM p), k AS (
  SELECT *, row_number() OVER (PARTITION BY n, h ORDER BY page_id DESC NULLS LAST) AS r, max(page_id) OVER (PARTITION BY n, h) AS top FROM d)
SELECT page_id, n AS payload_bytes, h AS payload_digest, CASE WHEN n < 1000 OR r = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN n >= 1000 AND r > 1 THEN top END AS refers_to FROM k
""",
    "op10_chat": f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (SELECT *, {_escaped('role')} AS er, {_escaped('text')} AS et FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|turn|>' || replace(er, chr(10), '\\n') || chr(10) || et || '<|end|>' || chr(10))) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
""",
    "op11_collocations": r"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents
), pieces AS (
  SELECT lang, unnest(regexp_split_to_array(x, '[.,;:!?\x0A-\x0D]')) AS piece FROM t
), words AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
), places AS (
  SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k
), f AS (
  SELECT lang, list_slice(w, i, i + k - 1) AS p, k, count(*) AS c FROM places GROUP BY ALL
), totals AS (SELECT lang, CAST(sum(c) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang), many AS (
  SELECT * FROM f WHERE k > 1 AND c >= 10
), longer AS (
  SELECT lang, p, max(c) AS most FROM (SELECT lang, c, unnest([list_slice(p, 1, 2), list_slice(p, 2, 3)]) AS p FROM many WHERE k = 3) GROUP BY ALL
), alone AS (
  SELECT m.lang, m.p, m.k, m.c AS a FROM many m LEFT JOIN longer g ON g.lang = m.lang AND g.p = m.p WHERE most IS NULL OR 100 * most < 50 * m.c
), cuts AS (
  SELECT *, unnest(range(1, k)) AS cut FROM alone
), scored AS (
  SELECT c.lang, c.p, c.a, cut, h.c AS l, r.c AS r, (1000000 * c.a::HUGEINT * c.a::HUGEINT) // (h.c::HUGEINT * r.c::HUGEINT) AS score
  FROM cuts c JOIN f h ON h.lang = c.lang AND h.p = list_slice(c.p, 1, cut) JOIN f r ON r.lang = c.lang AND r.p = list_slice(c.p, cut + 1, c.k)
), least AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) = 1
), ranked AS (
  SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, score FROM least
), first AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM ranked QUALIFY rank <= 2000
)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score
FROM first JOIN totals USING (lang)
""",
    "op13_spelling": r"""
WITH RECURSIVE bits(b, v, k) AS (
  SELECT range, range, 0 FROM range(256)
  UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8
), crc AS (SELECT list(v ORDER BY b) AS t FROM bits WHERE k = 8), runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), each AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS named, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY ALL
), bytes AS (
  SELECT run, n, list_prepend(4294967295, flatten(list_transform(string_split(named, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [192 + (ord(c)::BIGINT >> 6), 128 + (ord(c)::BIGINT & 63)] END))) AS b FROM each
), hashed AS (
  SELECT run, n, xor(list_reduce(b, lambda s, x: xor(s >> 8, t[(xor(s, x) & 255) + 1])), 4294967295) AS h FROM bytes, crc
), altered AS (
  SELECT CASE WHEN h % 199 = 0 THEN run[: h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word, n FROM hashed
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM altered WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), holes AS (
  SELECT word, n, i, word[: i - 1] AS head, word[i + 1 :] AS tail FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM holes a JOIN holes b ON a.i = b.i AND a.head = b.head AND a.tail = b.tail AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM holes a JOIN words b ON b.word = a.head || a.tail
  UNION SELECT b.word, a.word, a.n FROM holes a JOIN words b ON b.word = a.head || a.tail
), best AS (
  SELECT word, other, other_n, count(*) OVER (PARTITION BY word) AS n_near FROM near QUALIFY row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) = 1
), formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * w.n THEN other END AS form, CASE WHEN other_n >= 5 * w.n THEN other_n END AS form_n
  FROM words w LEFT JOIN best b USING (word)
), ways(word, here) AS (
  SELECT word, word FROM formed UNION ALL SELECT ways.word, f.form FROM ways JOIN formed f ON f.word = ways.here WHERE f.form IS NOT NULL
), roots AS (
  SELECT ways.word, here AS root FROM ways JOIN formed f ON f.word = ways.here WHERE f.form IS NULL
)
SELECT f.word, f.form, root, f.n, CAST(n_near AS BIGINT) AS n_near, form_n FROM formed f JOIN roots USING (word)
""",
}
