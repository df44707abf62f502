"""Chat formatting by schema fingerprints, in DataFrame functions only.

A layout is a set of nested field paths; the hash of the paths that an input has selects a
declarative mapping to canonical turns (role, text). Turns are set into one marked-up string.
Control strings inside texts get a backslash and lose it again on reading, so that no text can
end its turn. The loss mask holds, for each turn, how many code points precede the trained
text and how many are trained.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>\n"
TRAINED_ROLE = "assistant"


@dataclass(frozen=True)
class Layout:
    """Field paths and what they stand for: turns in rows, in a list, or one field for each role."""

    name: str
    rows: tuple[str, str, str] = ()  # order, role, text of a table with a row a turn
    items: tuple[str, str, str] = ()  # list, role, text
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()  # role and the fields joined for it
    renamed: bool = False  # whether roles have names of the layout's own (ROLE_NAMES)

    def paths(self) -> tuple[str, ...]:
        if self.items:
            return tuple(f"{self.items[0]}[].{f}" for f in self.items[1:])
        return self.rows or tuple(f for _, fields in self.fields for f in fields)


LAYOUTS = (
    Layout("turn rows", rows=("turn", "role", "text")),
    Layout("messages", items=("messages", "role", "content")),
    Layout("exchanges", items=("conversations", "from", "value"), renamed=True),
    Layout("prompt", fields=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("preference", fields=(("user", ("prompt",)), ("assistant", ("chosen",)))),
    Layout("instruction", fields=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("instruction only", fields=(("user", ("instruction",)), ("assistant", ("output",)))),
)
#: Names that layouts with role names of their own give to the canonical roles; elsewhere a role stays as it is.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
_KNOWN = sorted({p for layout in LAYOUTS for p in layout.paths()})
_RECORD = ", ".join([f"{x.items[0]} array<struct<`{x.items[1]}`:string, `{x.items[2]}`:string>>" for x in LAYOUTS if x.items]
                    + [f"{f} string" for f in sorted({f for x in LAYOUTS for _, fs in x.fields for f in fs})])


def path_hash(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


BY_HASH = {path_hash(x.paths()): x for x in LAYOUTS}


#: Paths that JSON records may have, in the order in which they are hashed.
RECORD_PATHS = sorted({p for layout in LAYOUTS if not layout.rows for p in layout.paths()})


def _signatures() -> dict[str, str]:
    """Fingerprint of every set of known paths that holds a whole layout -> the first such layout of LAYOUTS."""
    out = {}
    for bits in range(1 << len(RECORD_PATHS)):
        paths = [p for i, p in enumerate(RECORD_PATHS) if bits >> i & 1]
        if layout := next((x for x in LAYOUTS if not x.rows and set(x.paths()) <= set(paths)), None):
            out[path_hash(paths)] = layout.name
    return out


SIGNATURES = _signatures()


def field_paths(kind: T.DataType, prefix: str = "") -> set[str]:
    """Nested field paths of a schema; [] stands for the items of a list."""
    if isinstance(kind, T.StructType):
        return set().union(*(field_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name) for f in kind.fields))
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{prefix}[]")
    return {prefix}


def layout_of(schema: T.StructType) -> Layout:
    """The layout whose fingerprint is that of the schema's known paths; other columns don't matter."""
    known = field_paths(schema) & set(_KNOWN)
    if path_hash(known) not in BY_HASH:
        raise ValueError(f"no layout has the fields {sorted(known)}")
    return BY_HASH[path_hash(known)]


def _role(role: Column, layout: Layout) -> Column:
    role, out = F.coalesce(role, F.lit("")), F.coalesce(role, F.lit(""))
    for name, canonical in ROLE_NAMES.items() if layout.renamed else ():
        out = F.when(role == name, F.lit(canonical)).otherwise(out)
    return out


def _turn(role: Column, text: Column) -> Column:
    return F.struct(role.alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _row_turns(layout: Layout, source=F.col) -> Column:
    """Turns of a layout that keeps a whole conversation in a row."""
    if layout.items:
        name, role, text = layout.items
        return F.coalesce(F.transform(source(name), lambda m: _turn(_role(m[role], layout), m[text])), F.array().cast("array<struct<role:string,text:string>>"))
    return F.array(*(_turn(F.lit(role), F.concat_ws("\n", *(F.when(source(f) != "", source(f)) for f in fields))) for role, fields in layout.fields))


def canonical_turns(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, turns) of a table in any known layout.

    Turn rows of a conversation are put in order of turn, then role and text (nulls first), so
    that ties and repeated rows have one defined order; a null role or text counts as empty.
    """
    layout = layout_of(df.schema)
    if not layout.rows:
        return df.select(F.col(id_col).alias("id"), _row_turns(layout).alias("turns"))
    order, role, text = layout.rows
    rows = df.select(F.col(id_col).alias("id"), F.struct(F.col(order).alias("turn"), _role(F.col(role), layout).alias("role"),
                                                         F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"))
    turns = F.transform(F.array_sort(F.collect_list("t")), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return rows.groupBy("id").agg(turns.alias("turns"))


def record_turns(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(id, layout, turns, problem) of JSON records whose layouts differ from row to row.

    A record's paths are those of its fields and of all its list items, null values included. The
    hash of the known ones among them, in their order, is its fingerprint, looked up in the table
    SIGNATURES. A record without a layout gets a null layout, no turns, and problem says why (else null).
    """
    line = F.when(F.try_parse_json(F.col(json_col)).isNotNull(), F.col(json_col))

    def item_paths(name: str) -> Column:
        items = F.from_json(F.get_json_object(line, f"$.{name}"), "array<string>")
        keys = F.flatten(F.transform(items, lambda x: F.coalesce(F.json_object_keys(x), F.array().cast("array<string>"))))
        return F.coalesce(F.transform(keys, lambda k: F.concat(F.lit(f"{name}[]."), k)), F.array().cast("array<string>"))

    paths = F.concat(F.json_object_keys(line), *(item_paths(x.items[0]) for x in LAYOUTS if x.items))
    known = F.array(*map(F.lit, RECORD_PATHS))
    digest = F.sha2(F.concat_ws("\n", F.array_intersect(known, "paths")), 256)
    rows = df.select(F.col(id_col).alias("id"), F.from_json(line, _RECORD).alias("r"), paths.alias("paths")).withColumn("digest", digest)
    # a row for each set of known paths: the table's size is fixed, so broadcasting it is bounded
    mappings = df.sparkSession.createDataFrame(sorted(SIGNATURES.items()), "digest string, found string")
    rows = rows.join(F.broadcast(mappings), "digest", "left")
    name, turns = F.lit(None).cast("string"), F.array().cast("array<struct<role:string,text:string>>")
    for layout in LAYOUTS:
        if not layout.rows:
            fits = F.col("paths").isNotNull() & (F.col("found") == layout.name)
            if layout.items:
                fits = fits & F.col("r")[layout.items[0]].isNotNull()
            name = F.when(fits, F.lit(layout.name)).otherwise(name)
            turns = F.when(fits, _row_turns(layout, lambda f: F.col("r")[f])).otherwise(turns)
    problem = F.when(F.col("paths").isNull(), F.lit("no JSON object")).when(name.isNull(), F.lit("no known layout"))
    return rows.select("id", name.alias("layout"), turns.alias("turns"), problem.alias("problem"))


def in_layouts(df: DataFrame, id_col: str = "conv_id") -> list[DataFrame]:
    """(id, turns) as tables of three layouts that give the same turns: messages, exchanges and prompt.

    A conversation goes, by its id's hash, to one whose form it can take: prompts are one user
    turn and the answer; exchanges have role names of their own, which no role may have already.
    """
    share, turns = F.pmod(F.xxhash64("id"), F.lit(3)), F.col("turns")
    own_names = F.array(*(F.lit(n) for n in ROLE_NAMES))
    pair = (F.size("turns") == 2) & (turns[0]["role"] == "user") & (turns[1]["role"] == "assistant")
    renamed = ~F.exists("turns", lambda t: F.array_contains(own_names, t["role"]))
    form = F.when(pair & (share == 0), "prompt").when(renamed & (share == 1), "exchanges").otherwise("messages")
    rows = df.withColumn("form", form)
    name = lambda r: F.when(r == "user", "human").when(r == "assistant", "gpt").otherwise(r)
    own = F.col("id").alias(id_col)
    return [
        rows.where("form = 'messages'").select(own, F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"))).alias("messages")),
        rows.where("form = 'exchanges'").select(own, F.transform("turns", lambda t: F.struct(name(t["role"]).alias("from"), t["text"].alias("value"))).alias("conversations")),
        rows.where("form = 'prompt'").select(own, turns[0]["text"].alias("prompt"), turns[1]["text"].alias("completion")),
    ]


def escape(text: Column) -> Column:
    """One backslash more between < and | wherever only backslashes stand between them."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def format_turns(df: DataFrame, trained_role: str = TRAINED_ROLE) -> DataFrame:
    """(id, turns) -> (id, formatted, loss): loss has (skip, take) code points of each turn."""
    def marked(t):
        return F.concat(F.lit(START), F.url_encode(t["role"]), F.lit("\n"), escape(t["text"]), F.lit(END))

    def span(t):
        skip = F.char_length(F.url_encode(t["role"])) + (len(START) + 1)
        take = F.when(t["role"] == trained_role, F.char_length(escape(t["text"]))).otherwise(F.lit(0))
        return F.struct(skip.cast("long").alias("skip"), take.cast("long").alias("take"))

    return df.select("id", F.array_join(F.transform("turns", marked), "").alias("formatted"), F.transform("turns", span).alias("loss"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted string: array of (role, text)."""
    chunks = F.filter(F.split(formatted, START.replace("|", r"\|"), -1), lambda c: c != "")

    def turn(chunk):
        role = F.substring_index(chunk, "\n", 1)
        start = F.char_length(role) + 2
        text = chunk.substr(start, F.char_length(chunk) - (start - 1) - len(END))
        return F.struct(F.url_decode(role).alias("role"), unescape(text).alias("text"))

    return F.transform(chunks, turn)


def read_loss(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped: the mask's spans cut out of the marked-up turns."""
    chunks = F.filter(F.split(formatted, START.replace("|", r"\|"), -1), lambda c: c != "")
    cut = F.zip_with(chunks, loss, lambda c, s: unescape(c.substr((s["skip"] - (len(START) - 1)).cast("int"), s["take"].cast("int"))))
    return F.array_join(cut, "")
