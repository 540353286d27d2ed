"""Chat formatting with schema fingerprints, on SQL functions alone.

A record is a JSON text.  Its fingerprint is a hash of its nested field paths (names and nesting, not value types or order);
it selects a declarative mapping that reads the record's turns.  Turns are rendered with marks, the characters that marks
are made of being escaped inside texts, so the rendered text can be read back exactly.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridecast.llm.common import fields

TURNS = "array<struct<role: string, text: string>>"
#: Records of up to so many characters are within the limits of the JSON parser.
PARSED = 20_000_000
SCALARS = "(: |ARRAY<)(?:STRING|BIGINT|DOUBLE|BOOLEAN|VOID|VARIANT|DATE|FLOAT|BINARY|DECIMAL\\(\\d+,\\d+\\))(?=[,>]|$)"


@dataclass(frozen=True)
class Mapping:
    """How the turns of one layout are read.

    shape: the nested field names, as in ``OBJECT<messages:ARRAY<OBJECT<content:,role:>>>`` (names sorted).
    turns: for flat layouts, (role, field) in order; fields that are empty and named in ``optional`` make no turn.
    items: for list layouts, (list field, role field, text field).  roles: names to be replaced."""
    name: str
    shape: str
    turns: tuple[tuple[str, str], ...] = ()
    items: tuple[str, str, str] | None = None
    roles: dict[str, str] = field(default_factory=dict)
    optional: tuple[str, ...] = ()

    @property
    def fingerprint(self) -> str:
        return hashlib.sha256(self.shape.encode()).hexdigest()


def flat(name: str, *turns: tuple[str, str], optional: tuple[str, ...] = ()) -> Mapping:
    names = sorted(f for _, f in turns)
    return Mapping(name, "OBJECT<" + ",".join(f"{n}:" for n in names) + ">", turns=turns, optional=optional)


def listed(name: str, items: str, role: str, text: str, roles: dict[str, str] | None = None) -> Mapping:
    inner = ",".join(f"{n}:" for n in sorted((role, text)))
    return Mapping(name, f"OBJECT<{items}:ARRAY<OBJECT<{inner}>>>", items=(items, role, text), roles=roles or {})


MAPPINGS = (
    listed("messages", "messages", "role", "content"),
    listed("speakers", "conversations", "from", "value", {"human": "user", "gpt": "assistant", "bot": "assistant"}),
    flat("prompt_response", ("user", "prompt"), ("assistant", "response")),
    flat("system_prompt_response", ("system", "system"), ("user", "prompt"), ("assistant", "response")),
    flat("prompt_completion", ("user", "prompt"), ("assistant", "completion")),
    flat("instruction", ("user", "instruction"), ("assistant", "output")),
    flat("instruction_input", ("user", "instruction"), ("user", "input"), ("assistant", "output"), optional=("input",)),
    flat("question_answer", ("user", "question"), ("assistant", "answer")),
)


def fingerprint(record: Column) -> Column:
    """Hash of the nested field paths of a JSON text; null if it isn't JSON."""
    return F.sha2(F.regexp_replace(F.regexp_replace(
        F.schema_of_variant(F.try_parse_json(record)), SCALARS, "$1"), "([:,]) ", "$1"), 256)


def _turns(record: Column, m: Mapping, beside: Column | None = None) -> Column:
    """The turns of a record in layout ``m``; its strings are read from ``beside`` (field, role, text), if given."""
    v = F.try_parse_json(record)
    if m.items:
        items, role, text = m.items
        if beside is None:
            got = F.try_variant_get(v, f"$.{items}", f"array<struct<`{role}`: string, `{text}`: string>>")
        else:
            got, role, text = F.filter(beside, lambda x: x["field"] == items), "role", "text"
        name = lambda r: F.coalesce(*[F.when(r == k, F.lit(n)) for k, n in m.roles.items()], r)       # noqa: E731
        return F.transform(got, lambda x: F.struct(F.coalesce(name(x[role]), F.lit("")).alias("role"),
                                                   F.coalesce(x[text], F.lit("")).alias("text"))).cast(TURNS)
    said = lambda f: (F.try_variant_get(v, f"$.{f}", "string") if beside is None else                 # noqa: E731
                      F.get(F.filter(beside, lambda x: x["field"] == f), F.lit(0))["text"])
    text = lambda f: F.coalesce(said(f), F.lit(""))                                                   # noqa: E731
    one = [F.when(text(f) == "", F.array().cast(TURNS)).otherwise(F.array(F.struct(
        F.lit(r).alias("role"), text(f).alias("text"))).cast(TURNS)) if f in m.optional else F.array(F.struct(
            F.lit(r).alias("role"), text(f).alias("text"))).cast(TURNS) for r, f in m.turns]
    return F.concat(*one)


def canonical_turns(records: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """``records`` with ``layout`` (the mapping's name) and ``turns`` (role, text), from the JSON text in ``record``.

    A record whose fingerprint no mapping has (or that isn't JSON, or null) gets a null layout and no turns.  A null
    text or role counts as empty.  ``record`` is dropped.  With a column ``beside`` (``records_of_turns``), which is dropped
    too, the record tells the layout alone and the strings come from there.  A record of over PARSED characters that doesn't
    parse raises an error, as the parser's limits (a string of 20,000,000 characters, 128 MiB) may be the reason."""
    record, beside = F.col("record"), F.col("beside") if "beside" in records.columns else None
    known = records.withColumn("_print", F.when(
        (F.length(record) > PARSED) & F.try_parse_json(record).isNull(),
        F.raise_error(F.lit("a record is beyond the limits of the JSON parser, or a long text that isn't JSON")).cast("string"))
        .otherwise(fingerprint(record)))
    layout, turns = F.lit(None).cast("string"), F.array().cast(TURNS)
    for m in mappings:
        own = F.col("_print") == m.fingerprint
        layout = F.when(own, F.lit(m.name)).otherwise(layout)
        turns = F.when(own, _turns(record, m, beside)).otherwise(turns)
    return known.withColumn("layout", layout).withColumn("turns", turns).drop("_print", "record", "beside")


def records_of_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, record, beside) of rows (conv_id, turn, role, text): one JSON record per conversation, in the plainest layout
    that holds it: prompt and response, the same with a system text, otherwise a list of messages.

    The record is a skeleton with empty strings and, of a list, one item, so no text meets the parser's limits; ``beside``
    has the strings (field, role, text).  Turns go by turn, then role and text; a null text is empty."""
    t = (fields(rows, "conv_id", "turn", "role", "text").groupBy("conv_id")
         .agg(F.sort_array(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"),
                                                   F.coalesce("text", F.lit("")).alias("text")))).alias("t")))
    def layout(record: str, *names: str) -> Column:
        name = lambda i: F.get(F.array(*[F.lit(n) for n in names]), i) if len(names) > 1 else F.lit(names[0])
        return F.struct(F.lit(record).alias("record"), F.transform("t", lambda x, i: F.struct(
            name(i).alias("field"), x["role"].alias("role"), x["text"].alias("text"))).alias("beside"))

    roles = F.transform("t", lambda x: x["role"])
    exact = lambda *r: (F.size("t") == len(r)) & (roles == F.array(*[F.lit(x) for x in r]))           # noqa: E731
    pair = layout('{"prompt":"","response":""}', "prompt", "response")
    three = layout('{"system":"","prompt":"","response":""}', "system", "prompt", "response")
    many = layout('{"messages":[{"role":"","content":""}]}', "messages")
    return t.select("conv_id", F.when(exact("user", "assistant"), pair).when(exact("system", "user", "assistant"), three)
                    .otherwise(many).alias("r")).select("conv_id", "r.record", "r.beside")


#: The template: each turn opens with its role and closes with a mark of its own.
OPEN, MIDDLE, CLOSE = '<turn role="', '">\n', "</turn>\n"
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ('"', "&quot;"))


def escape(text: Column) -> Column:
    """No ``<`` and no quote is left, so nothing inside reads as a mark."""
    for plain, safe in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for plain, safe in reversed(ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def render(conversations: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """``conversations`` with ``formatted``, and ``loss_spans`` [start, end) in its characters: the escaped texts of
    ``loss_role``; ``turns`` is dropped.  No turns: the empty text."""
    head = lambda t: F.concat(F.lit(OPEN), escape(t["role"]), F.lit(MIDDLE))                          # noqa: E731
    sizes = F.transform("turns", lambda t: F.struct(
        (t["role"] == loss_role).alias("loss"), F.length(head(t)).alias("head"), F.length(escape(t["text"])).alias("body")))
    state = "struct<at: int, spans: array<struct<start: int, end: int>>>"
    spans = F.aggregate(sizes, F.struct(F.lit(0).alias("at"), F.array().alias("spans")).cast(state), lambda s, x: F.struct(
        (s["at"] + x["head"] + x["body"] + len(CLOSE)).alias("at"),
        F.when(x["loss"], F.concat(s["spans"], F.array(F.struct(
            (s["at"] + x["head"]).alias("start"), (s["at"] + x["head"] + x["body"]).alias("end"))))).otherwise(s["spans"])
        .alias("spans")).cast(state))
    text = F.array_join(F.transform("turns", lambda t: F.concat(head(t), escape(t["text"]), F.lit(CLOSE))), "")
    return conversations.withColumn("formatted", text).withColumn("loss_spans", spans["spans"]).drop("turns")


def read_turns(formatted: Column) -> Column:
    """The turns of a rendered text."""
    parts = F.filter(F.split(formatted, CLOSE), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(
        unescape(F.regexp_extract(p, '(?s)^<turn role="([^"]*)">\\n(.*)$', 1)).alias("role"),
        unescape(F.regexp_extract(p, '(?s)^<turn role="([^"]*)">\\n(.*)$', 2)).alias("text")))


def read_loss(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the loss mask."""
    return F.array_join(F.transform(spans, lambda s: unescape(
        F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))), "")


def digest(rendered: DataFrame) -> DataFrame:
    """conv_id with counts and hashes of what is read back from ``formatted`` and ``loss_spans``."""
    read = rendered.withColumn("_turns", read_turns(F.col("formatted"))).withColumn(
        "_loss", read_loss(F.col("formatted"), F.col("loss_spans")))
    told = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("_turns").cast("long").alias("n_turns"),
                       F.sha2(told, 256).alias("turns_sha256"), F.length("_loss").cast("long").alias("loss_chars"),
                       F.sha2(F.col("_loss"), 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))
