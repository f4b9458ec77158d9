"""Chat formatting by schema fingerprints, in DataFrame operations alone.

Records are JSON objects of unknown layout. The nested field paths of a record
are hashed; the fingerprint selects a declarative mapping that turns the record
into canonical turns. Turns are written with a template whose control strings
are escaped inside texts, and read back from the output.

Escapes: a backslash becomes ``\\e``; a control string gets ``\\c`` behind its
first character. No text can hold ``\\c`` otherwise, so removing it and then
turning ``\\e`` back gives the text again.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>"
#: Strings that mark structure in this template or in common chat templates.
CONTROL = (
    "<|turn|>", "<|end|>", "<|im_start|>", "<|im_end|>", "<|endoftext|>",
    "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<s>", "</s>",
)


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns.

    ``example`` is a record of the layout, whose fingerprint selects the mapping.
    Either ``messages`` names an array with the fields ``role`` and ``text``, or
    ``fields`` lists (role, JSON path) pairs in the order of turns; empty and
    missing fields give no turn there. ``roles`` are (name, canonical role) pairs;
    other roles stay as they are.
    """

    name: str
    example: str
    messages: str = ""
    role: str = ""
    text: str = ""
    fields: tuple = ()
    roles: tuple = ()


#: Layouts known from public instruction and chat sets.
MAPPINGS = (
    Mapping("messages", '{"messages":[{"role":"a","content":"b"}]}', "$.messages", "$.role", "$.content"),
    Mapping(
        "from_value", '{"conversations":[{"from":"a","value":"b"}]}', "$.conversations", "$.from", "$.value",
        roles=(("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant")),
    ),
    Mapping("prompt_completion", '{"prompt":"a","completion":"b"}', fields=(("user", "$.prompt"), ("assistant", "$.completion"))),
    Mapping("prompt_response", '{"prompt":"a","response":"b"}', fields=(("user", "$.prompt"), ("assistant", "$.response"))),
    Mapping(
        "instruction", '{"instruction":"a","input":"b","output":"c"}',
        fields=(("user", "$.instruction"), ("user", "$.input"), ("assistant", "$.output")),
    ),
    Mapping("question_answer", '{"question":"a","answer":"b"}', fields=(("user", "$.question"), ("assistant", "$.answer"))),
)

#: Characters of a record's shape that the variant parser takes for certain.
SHAPE_CHARS = 8 << 20


def _shape(record):
    """A record of the same layout that is short: values are empty, names cut to 255 characters, elements of an array that repeat side by side stand once.

    So a record of any size, and with any number of turns, has a fingerprint,
    though the variant parser has a bound. Elements whose layouts alternate
    without end are an error beyond ``SHAPE_CHARS``, never an unknown layout.
    """
    for escaped in ("\\\\", '\\"', "\\"):
        record = F.replace(record, F.lit(escaped), F.lit(""))
    record = F.translate(record, "\1\2", "")
    record = F.regexp_replace(record, '"([^"]{0,255})[^"]*+"', "\1$1\2")  # ends of strings that can't be taken for beginnings
    record = F.regexp_replace(record, "\1[^\2]*+\2(?!\\s*+:)", '""')
    record = F.regexp_replace(record, "\1([^\2]*+)\2", '"$1"')
    record = F.regexp_replace(record, r"\s*+([{}\[\],:])\s*+", "$1")
    record = F.regexp_replace(record, r"(?<=[:,\[])-?[0-9][0-9.eE+-]*+(?=[,}\]])", "0")
    flat = r"\{[^{}]*+\}"
    for elements in (flat, flat, f"{flat},{flat}", flat):  # alternating pairs once what repeats has gone
        record = F.regexp_replace(record, f"({elements}),(?=\\1[,\\]])", "")
    return F.when(F.length(record) > SHAPE_CHARS, F.raise_error(F.lit("a record has too many layouts of elements to be told by its fingerprint"))).otherwise(record)


def fingerprint(record):
    """Hash of the sorted nested field paths of a JSON string column; null if it isn't JSON.

    Types don't count, so a null or number where others have a string is the same
    layout. A record is the first JSON value of its string; what follows it is
    passed over. An object that has a field twice is not a record.
    """
    layout = F.schema_of_variant(F.try_parse_json(_shape(record)))
    paths = F.regexp_replace(layout, r": (?!OBJECT<|ARRAY<)[A-Z]+(\([0-9,]*\))?", ":")
    return F.xxhash64(F.regexp_replace(paths, r"ARRAY<[A-Z]+>", "ARRAY<>"))


def _layout(paths: dict[str, str]) -> str:
    """The type of a record that has something (path to type) at some JSON paths."""
    heads: dict[str, dict[str, str]] = {}
    for path, kind in paths.items():
        head, _, rest = path.removeprefix("$.").partition(".")
        heads.setdefault(head, {})[rest] = kind
    return "struct<" + ",".join(f"`{h}`:{rest[''] if '' in rest else _layout(rest)}" for h, rest in heads.items()) + ">"


def _read(record, paths: dict[str, str]):
    """A record's values at some paths; null where it is malformed."""
    layout = _layout({**paths, "$._malformed": "string"})
    value = F.from_json(record, layout, {"columnNameOfCorruptRecord": "_malformed", "maxStringLen": str((1 << 31) - 1)})
    return F.when(value["_malformed"].isNull(), value)


def _at(value, path: str):
    for name in path.removeprefix("$.").split("."):
        value = value[name]
    return value


def mapping_table(spark, mappings=MAPPINGS) -> DataFrame:
    """Fingerprint and number of each mapping; a row for each, so always small."""
    rows = spark.createDataFrame([(i, m.example) for i, m in enumerate(mappings)], "mapping int, example string")
    return rows.select("mapping", fingerprint(F.col("example")).alias("print"))


def to_turns(records: DataFrame, record_col: str = "record", mappings=MAPPINGS) -> DataFrame:
    """``records`` with ``turns``: array of struct ``role, text`` in canonical roles, null where no mapping fits.

    Null roles and texts are empty. Records that are null, malformed or of an
    unknown layout have null turns; an array without elements has the layout of
    no mapping unless the mapping's example is without elements too, so an empty
    conversation has null turns as well. Further columns pass through, whatever
    their names, but for ``turns``, which is replaced. Repeated rows are
    converted alike; an empty table gives an empty one.
    """
    table = mapping_table(records.sparkSession, mappings).select(F.col("print").alias("_chat_print"), F.col("mapping").alias("_chat_mapping"))
    text = F.col(record_col)
    known = records.withColumn("_chat_print", fingerprint(text)).join(F.broadcast(table), "_chat_print", "left")
    turns = F.lit(None).cast("array<struct<role:string,text:string>>")

    def turn(role, text, names=()):
        for name, canonical in names:
            role = F.when(role == name, canonical).otherwise(role)
        return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))

    def from_item(m, value):
        return turn(_at(value, m.role), _at(value, m.text), m.roles)

    for i, m in enumerate(mappings):
        if m.messages:
            item = _layout({m.role: "string", m.text: "string"})
            items = _at(_read(text, {m.messages: f"array<{item}>"}), m.messages)
            each = F.transform(items, functools.partial(from_item, m))
        else:
            value = _read(text, {path: "string" for _, path in m.fields})
            every = F.array(*[turn(F.lit(r), _at(value, path)) for r, path in m.fields])
            each = F.when(value.isNotNull(), F.filter(every, lambda t: (t["text"] != "") | (t["role"] == "assistant")))
        turns = F.when(F.col("_chat_mapping") == i, each).otherwise(turns)
    others = [c for c in records.columns if c != "turns"]
    return known.select(*[F.col(f"`{c}`") for c in others], turns.alias("turns"))


def escape(text):
    out = F.replace(text, F.lit("\\"), F.lit("\\e"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\c" + c[1:]))
    return out


def unescape(text):
    return F.replace(F.replace(text, F.lit("\\c"), F.lit("")), F.lit("\\e"), F.lit("\\"))


def _role_out(role):
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def _role_back(role):
    return unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))


def render(turned: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """Adds ``formatted`` and ``loss_mask`` to rows with ``turns``.

    A turn is ``<|turn|>role``, a line feed, the escaped text, ``<|end|>`` and a
    line feed. ``loss_mask`` lists the stretches of ``formatted`` that are trained
    on, as struct ``turn, begin, length``: ``length`` code points (escapes
    included) from the ``begin``-th behind that turn's marker. Null turns, as
    those of an unknown layout, and empty ones give an empty string and mask.
    Further columns pass through; repeated rows are alike; an empty table gives
    an empty one.
    """
    text = F.transform("turns", lambda t: F.struct(_role_out(t["role"]).alias("r"), escape(t["text"]).alias("t"), t["role"].alias("role")))
    rows = turned.withColumn("_parts", F.coalesce(text, F.array().cast("array<struct<r:string,t:string,role:string>>")))
    pieces = F.transform("_parts", lambda p: F.concat(F.lit(TURN), p["r"], F.lit("\n"), p["t"], F.lit(END + "\n")))
    marks = F.transform(
        "_parts",
        lambda p, i: F.struct(i.alias("turn"), (F.length(p["r"]) + 1).alias("begin"), F.length(p["t"]).alias("length"), p["role"].alias("role")),
    )
    mask = F.transform(
        F.filter(marks, lambda m: m["role"] == trained_role),
        lambda m: F.struct(m["turn"].alias("turn"), m["begin"].alias("begin"), m["length"].alias("length")),
    )
    return rows.withColumns({"formatted": F.array_join(pieces, ""), "loss_mask": mask}).drop("_parts")


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds ``read_turns`` and ``loss_texts`` (unescaped, by the mask), from ``formatted`` and ``loss_mask`` alone.

    An empty string has neither turns nor texts. Further columns pass through;
    repeated rows are alike; an empty table gives an empty one.
    """
    cut = F.filter(F.split("formatted", "<\\|turn\\|>"), lambda s: s != "")
    rows = formatted.withColumn("_cut", cut)
    turns = F.transform(
        "_cut",
        lambda s: F.struct(
            _role_back(F.substring_index(s, "\n", 1)).alias("role"),
            unescape(F.substring(
                s, F.instr(s, "\n") + 1, F.length(s) - F.instr(s, "\n") - F.lit(len(END) + 1)
            )).alias("text"),
        ),
    )
    trained = F.transform(
        "loss_mask", lambda m: unescape(F.substring(F.get("_cut", m["turn"]), m["begin"] + 1, m["length"]))
    )
    return rows.withColumns({"read_turns": turns, "loss_texts": trained}).drop("_cut")


def gather_turns(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One JSON record for each conversation from rows of turns: the id and ``record``.

    Turns stand by number, null first, then role and text; null roles and texts
    are empty. Rows without an id can't be told to belong together: each is a
    conversation of one turn. Repeated rows are turns of their own.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    item = F.struct(F.col(turn_col).alias("n"), role.alias("role"), text.alias("content"))
    alone = F.when(F.col(id_col).isNull(), F.monotonically_increasing_id())
    rows = turns.select(F.col(id_col).alias("id"), item.alias("item"), alone.alias("alone")).groupBy("id", "alone").agg(F.array_sort(F.collect_list("item")).alias("items"))
    messages = F.transform("items", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))
    return rows.select(F.col("id").alias(id_col), F.to_json(F.struct(messages.alias("messages"))).alias("record"))


def format_conversations(turns: DataFrame, **columns) -> DataFrame:
    """Rows of turns to formatted conversations: id, ``formatted``, ``loss_mask``.

    Each conversation becomes a record, its fingerprint selects the mapping, and
    the template is applied. An empty table gives an empty one.
    """
    records = gather_turns(turns, **columns)
    rendered = render(to_turns(records))
    return rendered.select(columns.get("id_col", "conv_id"), "formatted", "loss_mask")
