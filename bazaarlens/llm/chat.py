"""Chat records of many layouts as canonical turns, formatted with a reversible template and a loss mask.

A record is a row of nested columns, in the wide schema in which Spark reads mixed JSON: each layout fills its
own fields and leaves the others null. The nested paths a record fills are hashed to its fingerprint, and the
fingerprint selects one of the declared mappings (``LAYOUTS``), which names where roles and texts are. Only paths
that some mapping mentions take part, so further fields do not matter.

The template encloses each turn in markers. A backslash is put before every backslash of a text and into
every control string, so no text can close its turn, and removing the backslashes gives the text back.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bazaarlens.llm.shared import fresh

START, MIDDLE, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
# The control strings of common chat templates, by their beginnings and ends.
_CONTROL = r"([<\[])(\||/?s>|</?SYS>>|/?INST\])"
_TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Turn:
    """One turn: its role, and the fields whose texts it joins (absent ones left out)."""

    role: str
    fields: tuple[str, ...]


@dataclass(frozen=True)
class Layout:
    """Where a layout keeps its turns: in a list of records, or in fields of its own.

    ``paths`` must be filled; ``may`` are paths it may fill or not.
    """

    name: str
    paths: tuple[str, ...]
    may: tuple[str, ...] = ()
    turns: tuple[Turn, ...] = ()
    each: tuple[str, str, str] | None = None  # list, its role field, its text field
    roles: dict[str, str] = field(default_factory=dict)  # other names of roles

    def fingerprint_sources(self) -> list[str]:
        every = [c for n in range(len(self.may) + 1) for c in combinations(self.may, n)]
        return ["\n".join(sorted({*self.paths, *more})) for more in every]


LAYOUTS: tuple[Layout, ...] = (
    Layout("messages", ("messages[]",), ("messages[].role", "messages[].content"), each=("messages", "role", "content")),
    Layout(
        "from_value",
        ("conversations[]",),
        ("conversations[].from", "conversations[].value"),
        each=("conversations", "from", "value"),
        roles={"human": "user", "gpt": "assistant", "bot": "assistant"},
    ),
    Layout("instruction", ("instruction",), ("input", "output", "system"), (Turn("system", ("system",)), Turn("user", ("instruction", "input")), Turn("assistant", ("output",)))),
    Layout("prompt_completion", ("prompt",), ("completion", "system"), (Turn("system", ("system",)), Turn("user", ("prompt",)), Turn("assistant", ("completion",)))),
    Layout("prompt_response", ("prompt", "response"), ("system",), (Turn("system", ("system",)), Turn("user", ("prompt",)), Turn("assistant", ("response",)))),
    Layout("question_answer", ("question",), ("answer", "system"), (Turn("system", ("system",)), Turn("user", ("question",)), Turn("assistant", ("answer",)))),
)


def _known_paths(layouts: tuple[Layout, ...]) -> list[str]:
    return sorted({p for one in layouts for p in (*one.paths, *one.may)})


def _has(name: str) -> Callable[[Column], Column]:
    return lambda record: record[name].isNotNull()


def _filled_paths(df: DataFrame, layouts: tuple[Layout, ...]) -> Column:
    """The known paths that a record fills, in order."""
    filled = []
    for path in _known_paths(layouts):
        top, _, inner = path.partition("[].")
        top = top.removesuffix("[]")
        kind = next((f.dataType for f in df.schema if f.name == top), None)
        if kind is None:
            continue
        if "[]" not in path:
            there = F.col(top).isNotNull() if isinstance(kind, T.StringType) else F.lit(False)
        elif not isinstance(kind, T.ArrayType) or not isinstance(kind.elementType, T.StructType):
            there = F.lit(False)
        elif not inner:
            there = F.col(top).isNotNull()
        elif inner in kind.elementType.names:
            there = F.exists(F.col(top), _has(inner))
        else:
            there = F.lit(False)
        filled.append(F.when(F.coalesce(there, F.lit(False)), F.lit(path)))
    return F.array_compact(F.array(*filled)) if filled else F.array().cast("array<string>")


def fingerprint(df: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """Hash of the nested field paths a record fills."""
    return F.xxhash64(F.array_join(_filled_paths(df, layouts), "\n"))


def _canonical(df: DataFrame, layout: Layout) -> Column:
    if layout.each:
        name, role, text = layout.each
        kind = next((f.dataType for f in df.schema if f.name == name), None)
        if not isinstance(kind, T.ArrayType) or not isinstance(kind.elementType, T.StructType):
            return F.lit(None).cast(_TURNS)
        names = kind.elementType.names

        def turn(m: Column) -> Column:
            given = m[role] if role in names else F.lit(None).cast("string")
            said = m[text] if text in names else F.lit(None).cast("string")
            other = given
            for old, new in layout.roles.items():
                other = F.when(given == old, new).otherwise(other)
            return F.struct(F.coalesce(other.cast("string"), F.lit("")).alias("role"), F.coalesce(said.cast("string"), F.lit("")).alias("text"))

        return F.transform(F.col(name), turn)
    turns = []
    for one in layout.turns:
        texts = [F.col(f) for f in one.fields if f in df.columns]
        if texts:
            there = F.coalesce(*texts).isNotNull()
            turns.append(F.when(there, F.struct(F.lit(one.role).alias("role"), F.concat_ws("\n", *texts).alias("text"))))
    return F.array_compact(F.array(*turns)) if turns else F.lit(None).cast(_TURNS)


def canonical_turns(df: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS, into: str = "turns", layout_into: str = "layout") -> DataFrame:
    """``df`` with the record's turns (role, text) and the name of its layout; both null for unknown layouts.

    Null roles and texts in a list are empty; an absent field of a layout gives no turn. A record with no turns
    has an empty list.
    """
    hold = fresh(df, "_fingerprint")[0]
    seen = fingerprint(df, layouts)
    turns, name = F.lit(None).cast(_TURNS), F.lit(None).cast("string")
    for layout in layouts:
        prints = [F.xxhash64(F.lit(source)) for source in layout.fingerprint_sources()]
        chosen = F.col(hold).isin(*prints)
        turns = F.when(chosen, _canonical(df, layout)).otherwise(turns)
        name = F.when(chosen, F.lit(layout.name)).otherwise(name)
    return df.withColumn(hold, seen).withColumns({into: turns, layout_into: name}).drop(hold)


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL, r"$1\\$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def formatted_text(turns: Column) -> Column:
    """All turns in the template, one string."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), escaped(t["role"]), F.lit(MIDDLE), escaped(t["text"]), F.lit(END))), "")


def loss_runs(turns: Column, learned: str = "assistant") -> Column:
    """The loss mask of ``formatted_text`` as runs (chars, loss): for each turn its head, its text and its tail."""

    def of_turn(t: Column) -> Column:
        head = F.length(escaped(t["role"])) + len(START) + len(MIDDLE)
        run = [(head, F.lit(False)), (F.length(escaped(t["text"])), t["role"] == learned), (F.lit(len(END)), F.lit(False))]
        return F.array(*(F.struct(n.cast("long").alias("chars"), on.alias("loss")) for n, on in run))

    return F.flatten(F.transform(turns, of_turn))


def read_back(formatted: Column, runs: Column) -> Column:
    """Turns (role, text, loss) read from the formatted string and its mask.

    ``loss`` is whether the run that covers the turn's text is masked in; null if the mask does not fit the string.
    """
    parts = F.split(formatted, r"<\|im_end\|>", -1)
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def turn(part: Column, k: Column) -> Column:
        inside = F.split(F.substring(part, len(START) + 1, 2147483647), r"<\|im_sep\|>", 2)
        run = F.get(runs, k * 3 + 1)
        fits = run["chars"] == F.length(inside[1])
        return F.struct(unescaped(inside[0]).alias("role"), unescaped(inside[1]).alias("text"), F.when(fits, run["loss"]).alias("loss"))

    return F.transform(parts, turn)


def chat_format(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS, learned: str = "assistant") -> DataFrame:
    """``records`` with columns layout, turns, formatted and loss_runs (null for unknown layouts).

    The row stays as it is otherwise; one record is one training example and is formatted in its row.
    """
    turned = canonical_turns(records, layouts)
    return turned.withColumns({"formatted": formatted_text(F.col("turns")), "loss_runs": loss_runs(F.col("turns"), learned)})


def conversation_records(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as one record of messages per conversation, in order of turn.

    Turns without a number come first; rows with the same number are ordered by role and text, and repeated rows
    are repeated turns. Rows without a conversation are one conversation, of id null.
    """
    message = F.struct("turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("content"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(message)).alias("messages"))
    return grouped.select("conv_id", F.transform("messages", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """Columns conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the output."""
    back = formatted.withColumn("back", read_back(F.col("formatted"), F.col("loss_runs")))
    lines = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join(F.transform(F.filter("back", lambda t: t["loss"]), lambda t: t["text"]), "")
    return back.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
