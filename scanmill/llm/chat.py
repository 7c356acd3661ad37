"""Chat formatting: records of any known layout become canonical turns, then one string with a loss mask."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
ESCAPE = "␛"
_TURN = "struct<role: string, text: string>"


@dataclass(frozen=True)
class Layout:
    """A record layout: the nested field paths that name it, and how to get turns from it. A path is `field`, or `list[].field`
    for a field of the objects in a list."""

    name: str
    paths: tuple[str, ...]
    turns: Callable[[Column], Column]


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _items(record: Column, path: str) -> Column:
    return F.try_variant_get(record, f"$.{path}", "array<variant>")


def _listed(path: str, role: str, text: str, roles: dict[str, str] | None = None) -> Callable[[Column], Column]:
    """Turns from a list of messages."""

    def turns(record: Column) -> Column:
        get = lambda item, name: F.try_variant_get(item, f"$.{name}", "string")
        named = (lambda r: F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in roles.items() for x in pair)), r), r)) if roles else (lambda r: r)
        return F.transform(_items(record, path), lambda m: _turn(named(get(m, role)), get(m, text)))

    return turns


def _pair(question: str, answer: str, extra: str | None = None, system: str | None = None) -> Callable[[Column], Column]:
    """A user turn and an assistant turn from flat fields; empty extra input and system prompts add nothing."""

    def turns(record: Column) -> Column:
        get = lambda name: F.coalesce(F.try_variant_get(record, f"$.{name}", "string"), F.lit(""))
        asked = get(question)
        if extra:
            asked = F.when(get(extra) == "", asked).otherwise(F.concat(asked, F.lit("\n\n"), get(extra)))
        both = F.array(_turn(F.lit("user"), asked), _turn(F.lit("assistant"), get(answer)))
        if system is None:
            return both
        return F.when(get(system) == "", both).otherwise(F.concat(F.array(_turn(F.lit("system"), get(system))), both))

    return turns


# The first layout whose paths a record has is its own, so those that ask for more stand before those that ask for less.
LAYOUTS = (
    Layout("turn rows", ("turns[].role", "turns[].text", "turns[].turn"), _listed("turns", "role", "text")),
    Layout("messages", ("messages[].content", "messages[].role"), _listed("messages", "role", "content")),
    Layout(
        "from and value", ("conversations[].from", "conversations[].value"),
        _listed("conversations", "from", "value", {"human": "user", "gpt": "assistant"}),
    ),
    Layout("system prompt", ("prompt", "response", "system"), _pair("prompt", "response", system="system")),
    Layout("preference", ("chosen", "prompt", "rejected"), _pair("prompt", "chosen")),
    Layout("instruction", ("input", "instruction", "output"), _pair("instruction", "output", extra="input")),
    Layout("bare instruction", ("instruction", "output"), _pair("instruction", "output")),
    Layout("completion", ("completion", "prompt"), _pair("prompt", "completion")),
    Layout("response", ("prompt", "response"), _pair("prompt", "response")),
)


def _has(record: Column, path: str) -> Column:
    """Whether a record has a path, be its value null; an empty list has the path `list[]`."""
    outer, _, inner = path.partition("[]")
    if "[]" not in path:
        return F.try_variant_get(record, f"$.{path}", "variant").isNotNull()
    items = _items(record, outer)
    if not inner:
        return F.coalesce(F.size(items) == 0, F.lit(False))
    return F.coalesce(F.exists(items, lambda i: F.try_variant_get(i, f"${inner}", "variant").isNotNull()), F.lit(False))


def field_paths(record: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """Those of the layouts' nested field paths that a record has, in order. Other fields and all values change nothing."""
    known = sorted({p for layout in layouts for p in layout.paths} | {p.partition("[]")[0] + "[]" for layout in layouts for p in layout.paths if "[]" in p})
    return F.array_compact(F.array(*(F.when(_has(record, p), F.lit(p)) for p in known)))


def fingerprint(paths: Column) -> Column:
    """A hash of a set of paths in order."""
    return F.xxhash64(F.array_join(paths, ","))


def _is(layout: Layout, paths: Column) -> Column:
    """Whether the record's paths, cut to the layout's own, have the layout's fingerprint; an empty list is a list of any items."""
    own = fingerprint(F.filter(paths, lambda p: p.isin(*layout.paths))) == fingerprint(F.array(*map(F.lit, sorted(layout.paths))))
    lists = {p.partition("[]")[0] + "[]" for p in layout.paths if "[]" in p}
    return reduce(or_, (F.array_contains(paths, name) for name in sorted(lists)), own)


def _escaped(text: Column) -> Column:
    """No control string of this or of other common templates is left: each loses its first character to an escape."""
    text = F.replace(text, F.lit(ESCAPE), F.lit(f"{ESCAPE}0"))
    text = F.regexp_replace(text, r"<(?=\||/?s>)", f"{ESCAPE}1")
    return F.regexp_replace(text, r"\[(?=/?INST\])", f"{ESCAPE}2")


def _plain(text: Column) -> Column:
    marks = (("3", "\n"), ("2", "["), ("1", "<"), ("0", ESCAPE))
    return reduce(lambda t, m: F.replace(t, F.lit(ESCAPE + m[0]), F.lit(m[1])), marks, text)


def canonical(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(conv_id, layout, turns) of `records` (conv_id, record: variant). The fingerprint of a record's nested field
    paths picks the layout; fields that the layout does not need are passed over, empty lists give no turns; records of no layout
    have a null layout and null turns."""
    marked = records.select("conv_id", "record", field_paths(F.col("record"), layouts).alias("paths"))
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(f"array<{_TURN}>")
    for layout in reversed(layouts):
        same = _is(layout, F.col("paths"))
        name, turns = F.when(same, F.lit(layout.name)).otherwise(name), F.when(same, layout.turns(F.col("record"))).otherwise(turns)
    return marked.select("conv_id", name.alias("layout"), turns.alias("turns"))


def formatted(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(conv_id, layout, formatted, segments) of `records` (conv_id, record: variant).

    A turn is START, its role, a line feed, its text and END. `segments` (text, loss) are the formatted string cut
    where the loss mask changes; only texts of assistant turns are under the mask. Control strings inside roles and
    texts are escaped and come back in `read_back`. Null roles and texts are empty; a record without turns gives an
    empty string; an unknown layout gives null. Repeated records are formatted each."""

    def segments(turn: Column) -> Column:
        role = F.replace(_escaped(turn["role"]), F.lit("\n"), F.lit(f"{ESCAPE}3"))
        part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(
            part(F.concat(F.lit(START), role, F.lit("\n")), F.lit(False)),
            part(_escaped(turn["text"]), turn["role"] == "assistant"),
            part(F.lit(END), F.lit(False)),
        )

    cut = canonical(records, layouts).select("conv_id", "layout", F.flatten(F.transform("turns", segments)).alias("segments"))
    return cut.select("conv_id", "layout", F.array_join(F.col("segments.text"), "").alias("formatted"), "segments")


def turns_of(text: Column) -> Column:
    """The turns of a formatted string."""
    chunks = F.filter(F.split(text, START.replace("|", r"\|"), -1), lambda c: c != "")

    def turn(chunk: Column) -> Column:
        role = F.substring_index(chunk, "\n", 1)
        body = F.substr(chunk, F.length(role) + 2, F.length(chunk) - F.length(role) - 1 - len(END))
        return F.struct(_plain(role).alias("role"), _plain(body).alias("text"))

    return F.transform(chunks, turn)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: _plain(s["text"])), "")


def records_of_rows(rows: DataFrame) -> DataFrame:
    """(conv_id, record) of a table of turns (conv_id, turn, role, text): one nested record per conversation, by turn;
    rows of one turn stand by role and text. Null texts are empty."""
    turn = F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns")).select(
        "conv_id", F.to_variant_object(F.struct("turns")).alias("record")
    )


def digests(chats: DataFrame) -> DataFrame:
    """What `formatted` wrote, read back from it and summed up."""
    read = chats.select("conv_id", turns_of(F.col("formatted")).alias("turns"), loss_text(F.col("segments")).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )
