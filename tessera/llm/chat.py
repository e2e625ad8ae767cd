"""Chat formatting: schema fingerprints choose declarative mappings to canonical turns; DataFrame operations only.

A row may hold a conversation in one of several layouts, each a set of nested fields.  The fingerprint of a row hashes
the sorted paths of the fields that are filled in; a mapping is declared for a set of paths and is found by its hash,
so a new layout is a new entry of ``MAPPINGS`` and no code.  A row that leaves some of a mapping's fields empty has the
fingerprint of fewer paths: it is a mapping's own, if there is one, else that of the first mapping (in order) that
the schema allows and that has these paths.  Rows without a known fingerprint have no turns and are marked unmapped.

The template marks a turn as ``<|turn|>role<|text|>text<|end|>`` plus a line feed, wrapped in ``<s>`` and ``</s>``.  Control strings
(these and other common ones) inside roles and texts are escaped by a backslash after their first character, one more
wherever backslashes stand there already, so that unescaping gives back every text exactly.  The loss mask covers the
texts of assistant turns, as (start, length) in code points of the formatted string.

Defined results: a null text or role is empty (so an unanswered prompt keeps an empty answer); turns are ordered by (turn, role, text), so ties and repeated rows have
one order and stay; rows with a null conversation id are one conversation; other columns are ignored; an empty table
has no conversations.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURNS = "array<struct<role:string,text:string>>"
#: A control string: its first character, backslashes, and what makes it one.
_REST = r"\|(?:turn|text|end|im_start|im_end|endoftext|startoftext|system|user|assistant)\||/?INST\]|/?s>|<?/?SYS>>|start_of_turn>|end_of_turn>"
ESCAPE = rf"([<\[])(\\*)({_REST})"
UNESCAPE = rf"([<\[])\\(\\*)({_REST})"
HEAD, TAIL, TURN, TEXT, END = "<s>", "</s>", "<|turn|>", "<|text|>", "<|end|>\n"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, ESCAPE, r"$1\\$2$3")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, UNESCAPE, "$1$2$3")


# --- layouts ------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Mapping:
    """Turns of a layout: fixed (role, path) pairs, or a list with the paths of its items' role and text."""

    paths: frozenset[str]
    pairs: tuple[tuple[str, str], ...] = ()
    items: str = ""
    role: str = ""
    text: str = ""
    roles: tuple[tuple[str, str], ...] = ()


_SPEAKERS = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("chatgpt", "assistant"))


def _pairs(*pairs: tuple[str, str]) -> Mapping:
    return Mapping(frozenset(p for _, p in pairs), pairs)


MAPPINGS = (
    _pairs(("user", "prompt"), ("assistant", "completion")),
    _pairs(("user", "prompt"), ("assistant", "response")),
    _pairs(("system", "system"), ("user", "prompt"), ("assistant", "response")),
    _pairs(("user", "question"), ("assistant", "answer")),
    _pairs(("user", "instruction"), ("assistant", "output")),
    _pairs(("user", "instruction"), ("user", "input"), ("assistant", "output")),
    Mapping(frozenset({"messages[].role", "messages[].content"}), items="messages", role="role", text="content"),
    Mapping(frozenset({"conversations[].from", "conversations[].value"}), items="conversations", role="from", text="value", roles=_SPEAKERS),
)


def leaf_paths(schema: T.StructType, prefix: str = "") -> list[str]:
    """Paths of all scalar fields; ``[]`` stands for a list's items."""
    out = []
    for f in schema.fields:
        path, kind = f"{prefix}{f.name}", f.dataType
        while isinstance(kind, T.ArrayType):
            path, kind = f"{path}[]", kind.elementType
        out += leaf_paths(kind, f"{path}.") if isinstance(kind, T.StructType) else [path]
    return out


def _filled(path: str) -> Column:
    """Whether a path holds any value in this row."""
    head, _, rest = path.partition("[]")
    if not rest:
        return F.col(head).isNotNull()

    def inside(item: Column, tail: str) -> Column:
        name, _, more = tail.lstrip(".").partition("[]")
        field = item
        for part in filter(None, name.split(".")):
            field = field[part]
        return F.exists(field, lambda x: inside(x, more)) if more else field.isNotNull()

    return F.coalesce(F.exists(F.col(head), lambda x: inside(x, rest)), F.lit(False))


def fingerprint(docs: DataFrame, layout: list[str]) -> Column:
    """XXH64 of the sorted, filled paths below the layout columns."""
    wanted = T.StructType([f for f in docs.schema.fields if f.name in layout])
    return F.xxhash64(F.concat_ws("\n", *[F.when(_filled(p), F.lit(p)) for p in sorted(leaf_paths(wanted))]))


def _turns(m: Mapping) -> Column:
    if m.pairs:
        return F.array(*[F.struct(F.lit(role).alias("role"), F.coalesce(F.col(path).cast("string"), F.lit("")).alias("text")) for role, path in m.pairs])
    speaker = {a: b for a, b in m.roles}

    def role(x: Column) -> Column:
        named = F.coalesce(x[m.role], F.lit(""))
        out = named
        for a, b in speaker.items():
            out = F.when(named == a, b).otherwise(out)
        return out

    return F.transform(m.items, lambda x: F.struct(role(x).alias("role"), F.coalesce(x[m.text], F.lit("")).alias("text")))


def canonical(docs: DataFrame, *, keep: tuple[str, ...] = ("conv_id",), mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """keep, turns, mapped: the row's conversation by the mapping of its fingerprint."""
    layout = [c for c in docs.columns if c not in keep]
    usable = set(leaf_paths(T.StructType([f for f in docs.schema.fields if f.name in layout])))
    known = [m for m in mappings if m.paths <= usable]
    of = {}
    for m in known:
        of.setdefault(m.paths, m)
    for m in known:
        for n in range(len(m.paths) - 1, 0, -1):
            for paths in combinations(sorted(m.paths), n):
                of.setdefault(frozenset(paths), m)
    cases = {m: [F.xxhash64(F.concat_ws("\n", *[F.lit(p) for p in sorted(paths)])) for paths, x in of.items() if x is m] for m in known}
    turns = None
    for m, prints in cases.items():
        case = (F.col("__fp").isin(*prints), _turns(m).cast(TURNS))
        turns = F.when(*case) if turns is None else turns.when(*case)
    got = F.lit(None).cast(TURNS) if turns is None else turns
    marked = docs.withColumn("__fp", fingerprint(docs, layout))
    return marked.select(*keep, F.coalesce(got, F.array().cast(TURNS)).alias("turns"), got.isNotNull().alias("mapped"))


def from_rows(rows: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation from rows by turn, in the layouts that canonical() knows: a user turn and an answer become
    prompt and completion, all else a list of messages."""
    item = F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("content"))
    whole = rows.groupBy(F.col(conv).alias("conv_id")).agg(F.array_sort(F.collect_list(item)).alias("t"))
    at = lambda k: F.get("t", F.lit(k))
    pair = (F.size("t") == 2) & (at(0)["role"] == "user") & (at(1)["role"] == "assistant")
    messages = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    return whole.select("conv_id", F.when(pair, at(0)["content"]).alias("prompt"), F.when(pair, at(1)["content"]).alias("completion"), F.when(~pair, messages).alias("messages"))


# --- template -----------------------------------------------------------------------------------------------------


def formatted(convs: DataFrame, *, turns: str = "turns", loss_role: str = "assistant") -> DataFrame:
    """Adds formatted (string) and loss (array of (start, length), code points)."""
    safe = F.transform(turns, lambda t: F.struct(t["role"].alias("role"), escape(t["role"]).alias("r"), escape(t["text"]).alias("x")))
    lead = len(TURN) + len(TEXT)
    zero = F.struct(F.lit(len(HEAD)).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("loss"))

    def step(a: Column, t: Column) -> Column:
        start = a["at"] + lead + F.char_length(t["r"])
        span = F.array(F.struct(start.alias("start"), F.char_length(t["x"]).alias("length")))
        return F.struct((start + F.char_length(t["x"]) + len(END)).alias("at"), F.when(t["role"] == loss_role, F.concat(a["loss"], span)).otherwise(a["loss"]).alias("loss"))

    body = F.array_join(F.transform("__safe", lambda t: F.concat(F.lit(TURN), t["r"], F.lit(TEXT), t["x"], F.lit(END))), "")
    out = convs.withColumn("__safe", safe)
    return out.withColumns({"formatted": F.concat(F.lit(HEAD), body, F.lit(TAIL)), "loss": F.aggregate("__safe", zero, step, lambda a: a["loss"])}).drop("__safe")


def parsed(c: Column) -> Column:
    """Turns read back from a formatted string."""
    inner = F.substr(c, F.lit(len(HEAD) + 1), F.char_length(c) - len(HEAD) - len(TAIL))
    pieces = F.slice(F.split(inner, r"<\|turn\|>", -1), 2, 1 << 30)

    def turn(p: Column) -> Column:
        halves = F.split(p, r"<\|text\|>", 2)
        text = F.get(halves, F.lit(1))
        return F.struct(unescape(F.get(halves, F.lit(0))).alias("role"), unescape(F.substr(text, F.lit(1), F.char_length(text) - len(END))).alias("text"))

    return F.transform(pieces, turn)


def report(rows: DataFrame) -> DataFrame:
    """Digests of what is read back from the formatted conversations."""
    out = formatted(canonical(from_rows(rows)))
    back = out.select("conv_id", "formatted", "loss", parsed(F.col("formatted")).alias("turns"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join(F.transform("loss", lambda s: unescape(F.substr("formatted", s["start"] + 1, s["length"]))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.char_length(learnt).cast("bigint").alias("loss_chars"),
        F.sha2(learnt, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )
