"""Chat formatting: layouts found by a fingerprint of their field paths, one template, reversible escapes, a loss mask."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"
LEARNED_ROLE = "assistant"
_TURN = "array<struct<role:string,text:string>>"


def _turn(role: Column | str, text: Column) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(F.coalesce(role.cast("string"), F.lit("")).alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def _messages(column: str, role: str, text: str, names: dict[str, str]) -> Callable[[], Column]:
    def turns() -> Column:
        def one(x):
            named = x[role]
            for old, new in names.items():
                named = F.when(x[role] == old, new).otherwise(named)
            return _turn(named, x[text])

        return F.coalesce(F.transform(F.col(column), one), F.array().cast(_TURN))

    return turns


@dataclass(frozen=True)
class Layout:
    """Field paths of a layout and the mapping of its fields to canonical turns."""

    name: str
    paths: frozenset[str]
    turns: Callable[[], Column]
    schema: str

    @property
    def fingerprint(self) -> str:
        return path_fingerprint(self.paths)


def path_fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def field_paths(schema: T.DataType, head: str = "") -> set[str]:
    """Leaf paths: a.b for a field of a struct, a[] for an array's elements."""
    if isinstance(schema, T.StructType):
        return set().union(*[field_paths(f.dataType, f"{head}.{f.name}" if head else f.name) for f in schema.fields])
    if isinstance(schema, T.ArrayType):
        return field_paths(schema.elementType, head + "[]")
    return {head}


def _layout(name: str, schema: str, turns: Callable[[], Column]) -> Layout:
    return Layout(name, frozenset(field_paths(T._parse_datatype_string(schema))), turns, schema)


def layouts() -> dict[str, Layout]:
    """The declared layouts by fingerprint."""
    known = [
        _layout("prompt", "prompt string, completion string", lambda: F.array(_turn("user", F.col("prompt")), _turn(LEARNED_ROLE, F.col("completion")))),
        _layout("prompt_response", "prompt string, response string", lambda: F.array(_turn("user", F.col("prompt")), _turn(LEARNED_ROLE, F.col("response")))),
        _layout("instruction", "instruction string, output string", lambda: F.array(_turn("user", F.col("instruction")), _turn(LEARNED_ROLE, F.col("output")))),
        _layout(
            "instruction_input",
            "instruction string, input string, output string",
            lambda: F.array(_turn("user", F.concat_ws("\n", F.col("instruction"), F.nullif(F.col("input"), F.lit("")))), _turn(LEARNED_ROLE, F.col("output"))),
        ),
        _layout("messages", "messages array<struct<role:string,content:string>>", _messages("messages", "role", "content", {})),
        _layout("turns", "turns array<struct<role:string,text:string>>", _messages("turns", "role", "text", {})),
        _layout("shared", "conversations array<struct<from:string,value:string>>", _messages("conversations", "from", "value", {"human": "user", "gpt": LEARNED_ROLE})),
    ]
    return {x.fingerprint: x for x in known}


def find_layout(df: DataFrame, id_col: str) -> Layout:
    """The layout whose fingerprint the frame's field paths have; the id and fields that no layout knows are left out."""
    known = layouts()
    fields = set().union(*[x.paths for x in known.values()])
    own = {p for p in field_paths(df.drop(id_col).schema) if p in fields}
    try:
        return known[path_fingerprint(own)]
    except KeyError:
        raise ValueError(f"no layout has the field paths {sorted(own)}") from None


def canonical_turns(df: DataFrame, id_col: str) -> DataFrame:
    """``conv_id`` and ``turns`` (array of role, text) of a frame in any declared layout; null fields count as empty.

    A null list of turns stays null.
    """
    return df.select(F.col(id_col).alias("conv_id"), find_layout(df, id_col).turns().cast(_TURN).alias("turns"))


def _list_paths(json: Column, field: str, below: list[str]) -> Column:
    """Which of the paths ``below`` a list has; one without elements may have them all."""
    none = F.array().cast("array<string>")
    elements = F.coalesce(F.from_json(F.get_json_object(json, f"$.{field}"), "array<string>"), none)
    names = F.flatten(F.transform(elements, lambda x: F.coalesce(F.json_object_keys(x), none)))
    every = F.array(*map(F.lit, below))
    return F.when(F.size(elements) == 0, every).otherwise(F.filter(every, lambda p: F.array_contains(names, F.substring_index(p, ".", -1))))


def _record_paths(json: Column) -> Column:
    """The field paths of a JSON record that some layout knows, in order."""
    value, none = F.try_parse_json(json), F.array().cast("array<string>")
    declared, paths = sorted(set().union(*[x.paths for x in layouts().values()])), none
    for field in sorted({p.split("[")[0] for p in declared}):
        kind = F.schema_of_variant(F.try_variant_get(value, f"$.{field}", "variant"))
        below = [p for p in declared if p.startswith(field + "[].")]
        if below:
            own = F.when(kind.startswith("ARRAY"), _list_paths(json, field, below))
        else:
            own = F.when(~kind.rlike("^(OBJECT|ARRAY)"), F.array(F.lit(field)))
        paths = F.concat(paths, F.coalesce(own, none))
    return F.sort_array(paths)


def canonical_json(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """``conv_id``, ``layout`` and ``turns`` of JSON records of mixed layouts, each row by its own fingerprint.

    As with frames, fields that no layout knows are left out, so a record may have an id or a source of its own. A list
    without elements gives no turns. A record that no layout fits, null or not JSON has a null layout and no turns.
    """
    key = F.sha2(F.array_join(_record_paths(F.col(json_col)), "\n"), 256)
    name, turns = F.lit(None).cast("string"), F.array().cast(_TURN)
    for mark, layout in layouts().items():
        mapped = _on_record(layout, F.from_json(F.col(json_col), layout.schema), T._parse_datatype_string(layout.schema).names)
        name = F.when(key == mark, layout.name).otherwise(name)
        turns = F.when(key == mark, mapped).otherwise(turns)
    return df.select(F.col(id_col).alias("conv_id"), name.alias("layout"), turns.alias("turns"))


def _on_record(layout: Layout, record: Column, names: list[str]) -> Column:
    if layout.name in ("messages", "turns", "shared"):
        role, text = ("from", "value") if layout.name == "shared" else ("role", "content" if layout.name == "messages" else "text")

        def one(x):
            named = x[role]
            if layout.name == "shared":
                named = F.when(named == "human", "user").when(named == "gpt", LEARNED_ROLE).otherwise(named)
            return _turn(named, x[text])

        return F.coalesce(F.transform(record[names[0]], one), F.array().cast(_TURN)).cast(_TURN)
    asked = F.concat_ws("\n", record[names[0]], F.nullif(record["input"], F.lit(""))) if "input" in names else record[names[0]]
    return F.array(_turn("user", asked), _turn(LEARNED_ROLE, record[names[-1]])).cast(_TURN)


def escape(text: Column) -> Column:
    """No control string survives: each has a bar, and bars and backslashes get a backslash."""
    return F.regexp_replace(text, r"([\\|])", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def format_chat(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``formatted`` and ``loss_spans`` (start and length in code points of each assistant's escaped text).

    A turn is ``<|role|>``, a newline, the escaped text, ``<|end|>`` and a newline. No turns give an empty string and no spans, null turns nulls.
    """
    parts = turns.select(
        "conv_id",
        F.transform("turns", lambda x: F.struct(F.concat(F.lit(OPEN), escape(x["role"]), F.lit(CLOSE)).alias("head"), escape(x["text"]).alias("body"), (x["role"] == LEARNED_ROLE).alias("learned"))).alias("parts"),
    )
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(state, x):
        start = state["at"] + F.length(x["head"])
        span = F.struct(start.cast("long").alias("start"), F.length(x["body"]).cast("long").alias("length"))
        return F.struct(
            (start + F.length(x["body"]) + len(END)).cast("long").alias("at"),
            F.when(x["learned"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"),
        )

    return parts.select(
        "conv_id",
        F.array_join(F.transform("parts", lambda x: F.concat(x["head"], x["body"], F.lit(END))), "").alias("formatted"),
        F.aggregate("parts", empty, step)["spans"].alias("loss_spans"),
    )


def read_chat(formatted: DataFrame) -> DataFrame:
    """``conv_id``, ``turns`` and ``loss_text`` (unescaped text under the mask), read back from ``format_chat``'s output."""
    raw = F.split(F.col("formatted"), r"<\|end\|>\n", -1)
    raw = F.slice(raw, 1, F.size(raw) - 1)
    role = lambda x: unescape(F.regexp_extract(x, r"(?s)\A<\|((?:[^\\|]|\\.)*)\|>\n", 1))
    turn = lambda x: F.struct(role(x).alias("role"), unescape(F.regexp_replace(x, r"(?s)\A<\|(?:[^\\|]|\\.)*\|>\n", "")).alias("text"))
    return formatted.select(
        "conv_id",
        "formatted",
        F.transform(raw, turn).alias("turns"),
        F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "").alias("loss_text"),
    )


def gather_turns(rows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Rows by turn (id, turn, role, text) as one record of the layout ``turns`` an id, by turn, then role and text.

    Null roles and texts are empty. A conversation is one value of the result, so its rows meet in one task.
    """
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(turn)), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


#: Fixed value: the conversation that the query adds.
EXTRA = "</s>[INST] ok [/INST]"


def query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(EXTRA).alias("text"))
    read = read_chat(format_chat(canonical_turns(gather_turns(rows.unionByName(extra)), "conv_id")))
    digest = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(digest, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(13 + 2 * (length(role) + length(text))
                - length(replace(replace(role || text, '|', ''), '\', ''))) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""
