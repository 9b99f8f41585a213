"""Chat formatting with DataFrame functions only.

Records come in many layouts. The nested field paths of a record, sorted and hashed, are its
schema fingerprint; the fingerprint selects a declarative mapping that says where the turns, the
roles and the texts are. Canonical turns are written with a template whose control strings are
escaped inside texts, so that the formatted string can be read back without loss.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.llm.common import fresh

TURNS = "array<struct<role: string, text: string>>"


# -- layouts ---------------------------------------------------------------------


@dataclass(frozen=True)
class Mapping:
    """How a layout's fields become turns.

    ``fixed``: (role, path) pairs, read in order; a turn whose field is null is left out, unless
    it is among ``required``. ``each``: path of an array of messages, whose elements have ``role``
    and ``text`` fields, renamed by ``roles``.
    """

    name: str
    fixed: tuple[tuple[str, str], ...] = ()
    required: tuple[str, ...] = ()
    each: str = ""
    role: str = "role"
    text: str = "content"
    roles: tuple[tuple[str, str], ...] = ()

    def paths(self) -> list[str]:
        """Field paths a record of this layout has at least."""
        if self.each:
            return sorted([self.each, f"{self.each}[].{self.role}", f"{self.each}[].{self.text}"])
        return sorted(p for _, p in self.fixed if p in self.required)

    def all_paths(self) -> list[list[str]]:
        """The path sets this mapping answers for: the required fields with any of the others."""
        if self.each:
            return [self.paths()]
        sets = [set(self.paths())]
        for _, p in self.fixed:
            if p not in self.required:
                sets += [s | {p} for s in sets]
        return [sorted(s) for s in sets]


MAPPINGS = (
    Mapping("rows", each="turns", role="role", text="text"),
    Mapping("messages", each="messages", role="role", text="content"),
    Mapping("messages_text", each="messages", role="role", text="text"),
    Mapping("conversations", each="conversations", role="from", text="value",
            roles=(("human", "user"), ("gpt", "assistant"))),
    Mapping("prompt_completion", fixed=(("system", "system"), ("user", "prompt"), ("assistant", "completion")),
            required=("prompt", "completion")),
    Mapping("prompt_response", fixed=(("system", "system"), ("user", "prompt"), ("assistant", "response")),
            required=("prompt", "response")),
    Mapping("question_answer", fixed=(("system", "system"), ("user", "question"), ("assistant", "answer")),
            required=("question", "answer")),
    Mapping("instruction", fixed=(("system", "system"), ("user", "instruction"), ("user", "input"),
                                  ("assistant", "output")), required=("instruction", "output")),
)


def fingerprint(paths: list[str] | Column) -> Column:
    """Hash of sorted field paths."""
    joined = F.array_join(F.array_sort(paths), "\n") if isinstance(paths, Column) else F.lit("\n".join(sorted(paths)))
    return F.xxhash64(joined)


def field_paths(schema: T.StructType, names: list[str]) -> Column:
    """Nested paths of the fields a row actually has: null fields and what is below them are absent."""

    def below(kind: T.DataType, value: Column, path: str) -> list[Column]:
        own = [F.when(value.isNotNull(), F.lit(path))]
        if isinstance(kind, T.StructType):
            return own + [c for f in kind for c in below(f.dataType, value[f.name], f"{path}.{f.name}")]
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            # the fields of an array's elements belong to the layout, whatever single values are
            return own + [
                F.when(value.isNotNull(), F.lit(f"{path}[].{f.name}")) for f in kind.elementType
            ]
        return own

    found = [c for f in schema if f.name in names for c in below(f.dataType, F.col(f"`{f.name}`"), f.name)]
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def canonical(records: DataFrame, id_col: str, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """``conv_id, layout, turns`` per record: role and text of each turn in order.

    Fields that no mapping mentions are ignored, whatever their names. A record whose
    fingerprint no mapping answers for has a null ``layout`` and no turns. Null texts become
    empty, null roles stay null, repeated records are kept.
    """
    fields = {f.name: f.dataType for f in records.schema}
    known = sorted({p.split(".")[0].split("[")[0] for m in mappings for s in m.all_paths() for p in s} - {id_col})
    mark, = fresh(records, "_mark")
    marked = records.withColumn(mark, fingerprint(field_paths(records.schema, [n for n in known if n in fields])))
    layout, turns = F.lit(None).cast("string"), F.array().cast(TURNS)
    for m in reversed(mappings):
        if m.each:
            kind = fields.get(m.each)
            if not isinstance(kind, T.ArrayType) or not isinstance(kind.elementType, T.StructType):
                continue
            if not {m.role, m.text} <= set(kind.elementType.names):
                continue
            sets = [sorted([m.each, *(f"{m.each}[].{n}" for n in kind.elementType.names)])]
            roles = F.create_map(*(F.lit(x) for pair in m.roles for x in pair)) if m.roles else None
            made = _each(m, roles)
        else:
            fixed = [(r, p) for r, p in m.fixed if p in fields]
            if not set(m.required) <= {p for _, p in fixed}:
                continue
            sets = m.all_paths()
            made = F.array_compact(F.array(*(
                F.when(F.col(f"`{p}`").isNotNull(), F.struct(
                    F.lit(r).alias("role"), F.col(f"`{p}`").cast("string").alias("text"))) for r, p in fixed
            )))
        fits = F.col(mark).isin([])
        for s in sets:
            fits = fits | (F.col(mark) == fingerprint(s))
        layout = F.when(fits, F.lit(m.name)).otherwise(layout)
        turns = F.when(fits, made.cast(TURNS)).otherwise(turns)
    return marked.select(F.col(f"`{id_col}`").alias("conv_id"), layout.alias("layout"), turns.alias("turns"))


def _each(m: Mapping, roles: Column | None) -> Column:
    def turn(t: Column) -> Column:
        role = t[m.role].cast("string")
        named = F.coalesce(roles[role], role) if roles is not None else role
        return F.struct(named.alias("role"), F.coalesce(t[m.text].cast("string"), F.lit("")).alias("text"))

    return F.transform(F.col(f"`{m.each}`"), turn)


# -- template --------------------------------------------------------------------
# A turn of the assistant is "<s>" text "</s>"; any other is "[INST] " role newline text " [/INST]".

_CONTROL = [(r"<", r"(\\*)(/?s>)"), (r"\[", r"(\\*)(/?INST\])")]


def escape(text: Column) -> Column:
    """Put one more backslash into every control string, which is then none: undone by ``unescape``."""
    for first, rest in _CONTROL:
        text = F.regexp_replace(text, f"{first}{rest}", f"{first[-1]}\\\\$1$2")
    return text


def unescape(text: Column) -> Column:
    for first, rest in _CONTROL:
        text = F.regexp_replace(text, rf"{first}\\{rest}", f"{first[-1]}$1$2")
    return text


def _line(role: Column) -> Column:
    """A role as one line; backslashes first, so that it can be read back."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _unline(role: Column) -> Column:
    parts = F.split(unescape(role), r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def render(role: Column, text: Column) -> Column:
    """One turn as formatted text. A null role counts as empty, a null text as empty."""
    role, body = F.coalesce(role, F.lit("")), escape(F.coalesce(text, F.lit("")))
    return F.when(role == "assistant", F.concat(F.lit("<s>"), body, F.lit("</s>"))).otherwise(
        F.concat(F.lit("[INST] "), _line(role), F.lit("\n"), body, F.lit(" [/INST]"))
    )


def format_turns(conversations: DataFrame) -> DataFrame:
    """Add ``formatted`` and ``loss``: the mask as (start, chars), one span per assistant text.

    ``turns`` as made by ``canonical``. No turns give an empty text and an empty mask.
    """
    parts = F.transform("turns", lambda t: F.struct(
        (F.coalesce(t["role"], F.lit("")) == "assistant").alias("own"), render(t["role"], t["text"]).alias("piece"),
    ))
    df = conversations.withColumn("_parts", parts)
    df = df.withColumn("formatted", F.array_join(F.transform("_parts", lambda p: p["piece"]), ""))
    walk = F.aggregate(
        "_parts",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start: bigint, chars: bigint>>").alias("spans")),
        lambda s, p: F.struct(
            (s["at"] + F.length(p["piece"])).alias("at"),
            F.when(p["own"], F.array_append(s["spans"], F.struct(
                (s["at"] + 3).alias("start"), (F.length(p["piece"]) - 7).cast("long").alias("chars")
            ))).otherwise(s["spans"]).alias("spans"),
        ),
    )
    return df.withColumn("loss", walk["spans"]).drop("_parts")


def read_back(formatted: Column) -> Column:
    """Turns of a formatted text, as they were before (a null role comes back empty)."""
    pieces = F.regexp_extract_all(formatted, F.lit(r"(?s)<s>.*?</s>|\[INST\] .*? \[/INST\]"), F.lit(0))

    def turn(p: Column) -> Column:
        own = F.startswith(p, F.lit("<s>"))
        inner = F.when(own, F.substring(p, F.lit(4), F.length(p) - 7)).otherwise(
            F.substring(p, F.lit(8), F.length(p) - 15)
        )
        cut = F.locate("\n", inner)
        return F.struct(
            F.when(own, F.lit("assistant")).otherwise(_unline(F.substring(inner, F.lit(1), cut - 1))).alias("role"),
            unescape(F.when(own, inner).otherwise(F.substring(inner, cut + 1, F.length(inner)))).alias("text"),
        )

    return F.transform(pieces, turn)


def masked(formatted: Column, loss: Column) -> Column:
    """The text under the loss mask, unescaped, span after span."""
    return F.array_join(
        F.transform(loss, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["chars"].cast("int")))), ""
    )


def gather_rows(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                text_col: str = "text") -> DataFrame:
    """Records of the layout ``rows``: one per conversation, its rows by turn.

    Rows of one turn number are ordered by role and text, a null turn comes first. One
    conversation is one record, as long as its turns are.
    """
    turns = F.array_sort(F.collect_list(F.struct(
        F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))))
    return rows.groupBy(F.col(conv_col).alias("conv_id")).agg(turns.alias("turns")).select(
        "conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns")
    )


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted texts hold, read back from them."""
    back = formatted.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"),
                            masked(F.col("formatted"), F.col("loss")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
