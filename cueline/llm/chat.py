r"""Chat formatting by schema fingerprints, in DataFrame functions only.

Records come in many layouts: lists of messages, prompt and response, instruction with
input and output, one row for each turn. Those nested field paths of a record that any
layout declares are hashed to a fingerprint; the fingerprint selects a declarative mapping
to canonical turns (conversation, position, role, text). Other fields don't matter, and
records that no layout fits are given back as they are. Turns are then written in one
template::

    <|im_start|>role\ntext<|im_end|>\n

Control strings of this and other usual templates inside a text get a backslash after
their first character and every backslash of the text is doubled, so texts can't close
a turn and the formatted text can be read back exactly. The loss mask comes with the
formatted text, as runs of code points that are left out and trained on.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from itertools import chain, combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>\n"
#: Where a control string begins: its first character, if the rest follows.
CONTROL = r"([<\[])(?=\|[A-Za-z_]+\|>|/?s>|/?INST\]|<SYS>>|</SYS>>|\|)"
PLAIN_ROLE = r"\A[A-Za-z0-9_\-]+\z"


@dataclass(frozen=True)
class Layout:
    """Field paths that identify a layout, and where its turns are.

    ``turns``: (role or path of the role, path of the text) pairs; with ``each`` they are
    read from every element of that array, else from the record itself. A record may have
    or lack the ``optional`` paths; a turn whose text path it lacks is left out.
    """

    name: str
    paths: tuple[str, ...]
    turns: tuple[tuple[str, str], ...]
    each: str | None = None
    optional: tuple[str, ...] = ()

    def fingerprints(self) -> list[str]:
        """One for each choice of the optional paths."""
        some = chain.from_iterable(combinations(self.optional, n) for n in range(len(self.optional) + 1))
        return [fingerprint_paths((*self.paths, *more)) for more in some]


LAYOUTS = (
    Layout("turn_rows", ("role", "text"), (("$.role", "$.text"),)),
    Layout("messages", ("messages[].content", "messages[].role"), (("$.role", "$.content"),), each="messages"),
    Layout("conversations", ("conversations[].from", "conversations[].value"), (("$.from", "$.value"),), each="conversations"),
    Layout("prompt_response", ("prompt", "response"), (("system", "$.system"), ("user", "$.prompt"), ("assistant", "$.response")), optional=("system",)),
    Layout("prompt_completion", ("completion", "prompt"), (("user", "$.prompt"), ("assistant", "$.completion"))),
    Layout("question_answer", ("answer", "question"), (("user", "$.question"), ("assistant", "$.answer"))),
    Layout("instruction", ("instruction", "output"), (("user", "$.instruction"), ("assistant", "$.output"))),
    Layout("instruction_input", ("input", "instruction", "output"), (("system", "$.instruction"), ("user", "$.input"), ("assistant", "$.output"))),
)
#: Other names of the roles in from fields.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def fingerprint_paths(paths) -> str:
    return hashlib.md5("\n".join(sorted(paths)).encode()).hexdigest()


def schema_paths(kind: T.DataType, prefix: str = "") -> list[str]:
    """Nested field paths of a Spark type; an array adds ``[]`` to its path."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in schema_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{prefix}[]")
    return [prefix]


def declared_paths(layouts: tuple[Layout, ...]) -> list[str]:
    return sorted({p for x in layouts for p in (*x.paths, *x.optional)})


def _has(value: Column, path: str) -> Column:
    """Whether a variant has a path, be it with a null; of an array, whether any element has it."""
    head, each, rest = path.partition("[].")
    if not each:
        return F.try_variant_get(value, f"$.{path}", "variant").isNotNull()
    items = F.try_variant_get(value, f"$.{head}", "array<variant>")
    return F.coalesce(F.exists(items, lambda v: _has(v, rest)), F.lit(False))


def json_fingerprint(value: Column, layouts: tuple[Layout, ...]) -> Column:
    """Fingerprint of a variant: MD5 of those of the declared paths that it has, sorted."""
    found = F.array_compact(F.array(*[F.when(_has(value, p), F.lit(p)) for p in declared_paths(layouts)]))
    return F.md5(F.array_join(found, "\n").cast("binary"))


def _role(name: Column, path: str) -> Column:
    """Roles of ``from`` fields by their usual names; others as they are, null as empty."""
    if not path.endswith("from"):
        return F.coalesce(name, F.lit(""))
    low = F.lower(F.trim(name))
    known = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, low), name, F.lit(""))


def _turns(value: Column, layout: Layout) -> Column:
    """Array of (role, text) that a layout's mapping takes from a variant."""

    def turn(v: Column, role: str, text: str) -> Column:
        made = F.struct(
            (_role(F.try_variant_get(v, role, "string"), role) if role.startswith("$") else F.lit(role)).alias("role"),
            F.coalesce(F.try_variant_get(v, text, "string"), F.lit("")).alias("text"),
        )
        return F.when(_has(v, text[2:]), made) if text[2:] in layout.optional else made

    def pick(v: Column) -> list[Column]:
        return [turn(v, role, text) for role, text in layout.turns]

    if layout.each is None:
        return F.array_compact(F.array(*pick(value)))
    items = F.coalesce(F.try_variant_get(value, f"$.{layout.each}", "array<variant>"), F.array().cast("array<variant>"))
    return F.flatten(F.transform(items, lambda v: F.array(*pick(v))))


def _read(df: DataFrame, record: str, conv: str, layouts: tuple[Layout, ...]) -> DataFrame:
    """(conv_id, record, layout, turns), the last two null where no layout fits."""
    rows = df.select(F.col(f"`{conv}`").alias("conv_id"), F.col(f"`{record}`").alias("record"))
    rows = rows.select("conv_id", "record", F.try_parse_json("record").alias("v"))
    rows = rows.select("*", json_fingerprint(F.col("v"), layouts).alias("fp"))
    name, turns = F.lit(None).cast("string"), F.lit(None).cast("array<struct<role:string,text:string>>")
    for layout in layouts:
        hit = F.col("v").isNotNull() & F.col("fp").isin(layout.fingerprints())
        name = F.when(hit, F.lit(layout.name)).otherwise(name)
        turns = F.when(hit, _turns(F.col("v"), layout)).otherwise(turns)
    return rows.select("conv_id", "record", name.alias("layout"), turns.alias("turns"))


def turns_from_json(df: DataFrame, record: str, conv: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Canonical turns (conv_id, turn, role, text, layout) of JSON records, one conversation a record.

    Records that no layout fits aren't in it; :func:`rejected_records` has them whole. Null
    texts are empty. Fields that no layout declares are ignored.
    """
    rows = _read(df, record, conv, layouts).where("layout IS NOT NULL")
    return rows.select("conv_id", "layout", F.posexplode("turns").alias("turn", "x")).select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"), F.col("x.role").alias("role"), F.col("x.text").alias("text"), "layout"
    )


def rejected_records(df: DataFrame, record: str, conv: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(conv_id, record, reason) of the records that :func:`turns_from_json` has no turns of, as they came.

    Reasons: null record, broken JSON, no layout with these fields, no turns.
    """
    reason = F.when(F.col("record").isNull(), "null record").when(F.try_parse_json("record").isNull(), "broken JSON").when(F.col("layout").isNull(), "no layout with these fields").otherwise("no turns")
    rows = _read(df, record, conv, layouts).where(F.col("layout").isNull() | (F.size("turns") < 1))
    return rows.select("conv_id", "record", reason.alias("reason"))


def turns_from_rows(df: DataFrame, conv: str = "conv_id", turn: str = "turn", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Canonical turns of a typed table, whose fingerprint is that of its schema.

    Columns that are neither in a layout nor the conversation or turn column are left
    out; the largest layout that the rest covers is taken. Null roles and texts are empty.
    """
    rest = T.StructType([f for f in df.schema.fields if f.name not in (conv, turn)])
    paths = set(schema_paths(rest))
    known = {p: x for x in layouts for p in x.fingerprints()}
    layout = known.get(fingerprint_paths(paths & set(declared_paths(layouts))))
    if layout is None:
        # several layouts' fields: the largest one that they cover
        fits = sorted((x for x in layouts if set(x.paths) <= paths), key=lambda x: (-len(x.paths), x.name))
        if not fits:
            raise ValueError(f"no layout has the fields {sorted(paths)}")
        layout = fits[0]
    pairs = [(r, t) for r, t in layout.turns if t[2:] not in layout.optional or t[2:] in paths]
    at = lambda p, of=None: (of[p[2:]] if of is not None else F.col(p[2:]))
    pick = lambda of: [F.struct((_role(at(r, of), r) if r.startswith("$") else F.lit(r)).alias("role"), F.coalesce(at(t, of).cast("string"), F.lit("")).alias("text")) for r, t in pairs]
    order = F.col(f"`{turn}`").cast("bigint") if turn in df.columns else F.lit(0).cast("bigint")
    turns = F.array(*pick(None)) if layout.each is None else F.flatten(F.transform(layout.each, lambda x: F.array(*pick(x))))
    rows = df.select(F.col(f"`{conv}`").alias("conv_id"), order.alias("turn"), F.posexplode(turns).alias("pos", "x"))
    width = len(pairs) if layout.each is None else 1
    place = F.col("turn") * width + F.col("pos")
    return rows.select("conv_id", place.alias("turn"), F.col("x.role").alias("role"), F.col("x.text").alias("text"), F.lit(layout.name).alias("layout"))


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def format_turns(turns: DataFrame, trained: str = "assistant") -> DataFrame:
    """(conv_id, n_turns, formatted, loss_runs) from canonical turns, one row for each conversation.

    Turns are in the order of turn, then role, then text; repeated turns stay. A role that
    isn't a plain name is written as ``#`` and its hex digits. Turns with a null ``conv_id`` are
    one conversation, in their order; leave them out first where they belong to many. ``loss_runs`` is the loss mask
    over the code points of ``formatted``: for each turn how many are left out, trained on,
    and left out again; the text of turns with role ``trained`` is trained on. A conversation's
    text has to be in one row, so the longest conversation has to fit into a task's memory.
    """
    text = escape(F.coalesce("text", F.lit("")))
    role = F.when(F.col("role").rlike(PLAIN_ROLE), F.col("role")).otherwise(F.concat(F.lit("#"), F.hex(F.encode(F.coalesce("role", F.lit("")), "UTF-8"))))
    rows = turns.select("conv_id", "turn", "role", "text", F.concat(F.lit(START), role, F.lit("\n")).alias("head"), text.alias("body"))
    on = F.coalesce(F.col("role") == trained, F.lit(False))
    size = F.length("body")
    run = F.struct(F.length("head").alias("before"), F.when(on, size).otherwise(0).alias("train"), (F.when(on, 0).otherwise(size) + len(END)).alias("after"))
    rows = rows.select("conv_id", F.struct("turn", "role", "text", F.concat("head", "body", F.lit(END)).alias("block"), run.alias("run")).alias("x"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return grouped.select(
        "conv_id",
        F.size("xs").cast("bigint").alias("n_turns"),
        F.array_join(F.transform("xs", lambda x: x["block"]), "").alias("formatted"),
        F.transform("xs", lambda x: x["run"]).alias("loss_runs"),
    )


def loss_spans(conversations: DataFrame) -> DataFrame:
    """(conv_id, begin, end) of the spans of ``formatted`` that are trained on, in code points; the end is exclusive."""
    runs = conversations.select("conv_id", F.posexplode("loss_runs").alias("pos", "r"))
    total = F.sum(F.col("r.before") + F.col("r.train") + F.col("r.after")).over(Window.partitionBy("conv_id").orderBy("pos"))
    end = total - F.col("r.after")
    return runs.select("conv_id", (end - F.col("r.train")).alias("begin"), end.alias("end")).where("begin < end")


def _blocks(formatted: Column) -> Column:
    """The turns of a formatted conversation, each without its end."""
    parts = F.split(formatted, re.escape("<|im_end|>").replace("\\|", "[|]") + "\n")
    return F.filter(parts, lambda p: p != "")


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) read back from a formatted conversation."""

    def one(part: Column) -> Column:
        body = F.substr(part, F.lit(len(START) + 1))
        role = F.substring_index(body, "\n", 1)
        plain = F.when(role.startswith("#"), F.decode(F.unhex(F.substr(role, F.lit(2))), "UTF-8")).otherwise(role)
        return F.struct(plain.alias("role"), unescape(F.substr(body, F.length(role) + 2)).alias("text"))

    return F.transform(_blocks(formatted), one)


def masked_text(formatted: Column, runs: Column) -> Column:
    """What the loss mask leaves of a formatted conversation, unescaped: all texts that are trained on, in order."""
    # every turn has a run of its own, so each is cut within its turn and not from the conversation's begin
    parts = F.zip_with(_blocks(formatted), runs, lambda p, r: F.when(r["train"] > 0, unescape(F.substr(p, r["before"] + 1, r["train"]))).otherwise(""))
    return F.array_join(parts, "")


def with_loss(conversations: DataFrame) -> DataFrame:
    """Append ``turns`` (read back) and ``loss_text`` (what the mask leaves) to formatted conversations."""
    read = conversations.withColumn("turns", read_turns(F.col("formatted")))
    return read.withColumn("loss_text", masked_text(F.col("formatted"), F.col("loss_runs")))
