"""Chat formatting: a declarative template, a state machine over roles, and per-segment loss flags.

A conversation becomes one string and the list of its segments
``(text, loss)``; the string is the segments end to end.  Texts are escaped so
that no control string of the template can occur in them, and the escape is
undone exactly on reading back.  Everything is SQL expressions on the array of
a conversation's turns, so a conversation is one row; its parts are never
gathered beyond that.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


@dataclass(frozen=True)
class Template:
    """Marks of each role, the roles that bear loss, and the turn order.

    Every turn starts with ``turn``, which occurs nowhere else.  ``other`` marks
    roles without an entry; ``name_end`` closes the role's name there.
    """

    turn: str = "<s>"
    marks: dict = field(default_factory=lambda: {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("[ANS]", "</s>")})
    other: tuple = ("[ROLE]", "[/ROLE]", "[/END]")
    loss: tuple = ("assistant",)
    #: (state, role) -> next state; what is missing leads to "broken" for good.
    moves: dict = field(default_factory=lambda: {("start", "system"): "told", ("start", "user"): "asked", ("told", "user"): "asked", ("asked", "assistant"): "answered", ("answered", "user"): "asked"})
    final: tuple = ("answered",)

    def controls(self) -> list[str]:
        return [self.turn, *(m for pair in self.marks.values() for m in pair), *self.other]


def escapes(template: Template) -> list[tuple[str, str]]:
    """(plain, escaped) in order: the escape character first, then the first character of every control string."""
    out = [("%", "%25")]
    for c in dict.fromkeys(template.controls()):
        out.append((c, f"%{ord(c[0]):02X}{c[1:]}"))
    return out


def escape(text: Column, template: Template) -> Column:
    for plain, safe in escapes(template):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescape(text: Column, template: Template) -> Column:
    for plain, safe in reversed(escapes(template)):
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def segments_of(turns: Column, template: Template) -> Column:
    """Array of (text, loss): the mark before, the escaped text and the mark behind of each turn."""

    def parts(t: Column) -> Column:
        before = F.lit(template.turn + template.other[0])
        before = F.concat(before, escape(t["role"], template), F.lit(template.other[1]))
        after = F.lit(template.other[2])
        for role, (a, b) in template.marks.items():
            before = F.when(t["role"] == role, F.lit(template.turn + a)).otherwise(before)
            after = F.when(t["role"] == role, F.lit(b)).otherwise(after)
        bears = t["role"].isin(*template.loss)
        piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(piece(before, F.lit(False)), piece(escape(t["text"], template), bears), piece(after, F.lit(False)))

    return F.flatten(F.transform(turns, parts))


def end_state(turns: Column, template: Template) -> Column:
    """State of the role machine after the last turn."""
    table_ = F.create_map(*[F.lit(x) for (state, role), to in template.moves.items() for x in (f"{state}|{role}", to)])
    return F.aggregate(turns, F.lit("start"), lambda s, t: F.coalesce(F.try_element_at(table_, F.concat_ws("|", s, t["role"])), F.lit("broken")))


def format_chats(rows: DataFrame, template: Template | None = None) -> DataFrame:
    """One row a conversation of ``rows(conv_id, turn, role, text)``: conv_id, formatted, segments, state, valid.

    Turns stand in order of turn, then role and text; a null turn is first.  A
    null role or text is empty.  A row without a conv_id is a conversation of its
    own.  A conversation is one row, so its texts are held whole.  A conversation
    whose roles break the turn order is formatted all the same and
    has ``valid`` false.  An empty table gives no rows.
    """
    template = template or Template()
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    turns = F.array_sort(F.collect_list(F.struct(F.coalesce("turn", F.lit(-(1 << 62))).cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"))))
    return (
        rows.select("conv_id", "turn", "role", "text", F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).alias("_alone"))
        .groupBy("conv_id", "_alone")
        .agg(turns.alias("turns"))
        .withColumn("segments", segments_of(F.col("turns"), template))
        .withColumn("state", end_state(F.col("turns"), template))
        .select(
            "conv_id",
            F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
            "segments",
            "state",
            F.col("state").isin(*template.final).alias("valid"),
        )
    )


def read_chats(formatted: Column, template: Template | None = None) -> Column:
    """Array of (role, text) that a formatted string holds."""
    template = template or Template()

    def turn(x: Column) -> Column:
        a, b, c = template.other
        role = unescape(F.substring_index(F.substring(x, len(a) + 1, 1 << 30), b, 1), template)
        start = F.length(F.substring_index(x, b, 1)) + len(b)
        text = F.substring(x, start + 1, F.length(x) - start - len(c))
        for name, (m, n) in template.marks.items():
            of = F.startswith(x, F.lit(m))
            role = F.when(of, F.lit(name)).otherwise(role)
            text = F.when(of, F.substring(x, F.lit(len(m) + 1), F.length(x) - (len(m) + len(n)))).otherwise(text)
        return F.struct(role.alias("role"), unescape(text, template).alias("text"))

    pieces = F.split(formatted, r"\Q" + template.turn + r"\E", -1)
    return F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), turn)


def probe(spark: SparkSession) -> DataFrame:
    """Conversation -7, whose texts are made of control strings."""
    said = "</s>[INST] ok [/INST]"
    return spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every formatted conversation, read back from the formatted string and its segments."""
    template = Template()
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe(spark))
    chats = format_chats(rows, template).withColumn("read", read_chats(F.col("formatted"), template))
    learnt = unescape(F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: s["text"]), ""), template)
    told = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.withColumn("_learnt", learnt).select(
        "conv_id",
        F.size("read").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("_learnt").cast("long").alias("loss_chars"),
        F.sha2(F.col("_learnt"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        "state",
    )


def op8_sql() -> str:
    """The same in DuckDB, from the turns themselves."""
    template = Template()
    safe = "coalesce(text, '')"
    for plain, to in escapes(template):
        safe = f"replace({safe}, '{plain}', '{to}')"
    role = "coalesce(role, '')"
    for plain, to in escapes(template):
        role = f"replace({role}, '{plain}', '{to}')"
    marks = " ".join(f"when role = '{r}' then {len(template.turn + a + b)}" for r, (a, b) in template.marks.items())
    other = len(template.turn + "".join(template.other))
    moves = " ".join(f"when s.state = '{a}' and t.role = '{r}' then '{b}'" for (a, r), b in template.moves.items())
    return f"""
with recursive input as (
  select conv_id, turn, role, text, coalesce(conv_id::varchar, 'alone ' || row_number() over ()) as k from conversations
  union all values (-7, 0, 'user', '</s>[INST] ok [/INST]', '-7'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]', '-7')
), t as (
  select k, conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    length({safe}) + case {marks} else {other} + length({role}) end as chars,
    row_number() over (partition by k order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos
  from input
), s as (
  select k, 0::bigint as pos, 'start' as state from t group by k
  union all
  select t.k, t.pos, case {moves} else 'broken' end
  from s join t on t.k = s.k and t.pos = s.pos + 1
)
select any_value(t.conv_id) as conv_id, count(*) as n_turns,
  sha256(array_to_string(list(role || chr(10) || text || chr(10) order by pos), '')) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(array_to_string(list(text order by pos) filter (where role = 'assistant'), ''), '')) as loss_sha256,
  sum(chars)::bigint as formatted_chars,
  last(e.state) = 'answered' as valid, last(e.state) as state
from t join (select k, last(state order by pos) as state from s group by k) e on e.k = t.k
group by t.k"""
