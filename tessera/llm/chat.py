"""Chat formatting: a finite-state machine over roles and a declarative template.

The template names, for each role, the marks before and after its text and
whether the text counts for the loss; the machine's transitions say which role
may follow which. Each conversation becomes segments of text with a loss flag,
their concatenation, and a verdict on its turn order. Control strings inside
texts are escaped so that no text can end a turn, and the escape is undone when
a formatted conversation is read back.

Everything is DataFrame work on one row a conversation.

Defined cases: null text is empty; a null role is the empty role; a role that
the template doesn't know is formatted with its name and makes the order
invalid; rows are ordered by turn (null first), then role, then text, so
repeated rows give repeated turns; rows without conv_id form one conversation;
an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Mark:
    before: str
    after: str
    loss: bool


@dataclass(frozen=True)
class Template:
    begin: str
    roles: dict[str, Mark]
    #: for roles that ``roles`` lacks: the name stands between the first two
    other: tuple[str, str, str]
    #: strings that no text may hold as they are
    control: tuple[str, ...]
    #: state -> roles that may come next; a role is also the state after it
    follows: dict[str, tuple[str, ...]] = field(default_factory=dict)
    final: tuple[str, ...] = ("assistant",)


INSTRUCT = Template(
    begin="<s>",
    roles={"system": Mark("<<SYS>>\n", "\n<</SYS>>\n", False), "user": Mark("[INST] ", " [/INST]", False), "assistant": Mark(" ", "</s>", True)},
    other=("<<ROLE:", ">>\n", "\n<</ROLE>>\n"),
    control=("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<ROLE:", "<</ROLE>>"),
    follows={"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
)


def quoted(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def broken(control: str) -> str:
    return control[0] + "\\" + control[1:]


def escape(text: str, t: Template) -> str:
    """SQL for ``text`` with every backslash doubled and one put into every control string."""
    out = f"replace({text}, {quoted(chr(92))}, {quoted(chr(92) * 2)})"
    for c in t.control:
        out = f"replace({out}, {quoted(c)}, {quoted(broken(c))})"
    return out


def unescape(text: str, t: Template) -> str:
    """Undo ``escape``: runs of backslashes from the text are even, so a single one is the escape's."""
    out = text
    for c in t.control:
        out = f"replace({out}, {quoted(broken(c))}, {quoted(c)})"
    return f"replace({out}, {quoted(chr(92) * 2)}, {quoted(chr(92))})"


def turn_segments(t: Template) -> Column:
    """Segments of the turn ``x``: mark, text, mark."""
    text = escape("x.text", t)

    def parts(before: str, after: str, loss: bool) -> str:
        return (f"array(named_struct('text', {before}, 'loss', false), named_struct('text', {text}, 'loss', {str(loss).lower()}), "
                f"named_struct('text', {after}, 'loss', false))")

    first, second, after = t.other
    name = f"replace({escape('x.role', t)}, '>', {quoted(chr(92) + '>')})"
    cases = " ".join(f"when x.role = {quoted(r)} then {parts(quoted(m.before), quoted(m.after), m.loss)}" for r, m in t.roles.items())
    unknown = parts(f"concat({quoted(first)}, {name}, {quoted(second)})", quoted(after), False)
    return F.expr(f"flatten(transform(turns, x -> case {cases} else {unknown} end))")


def order_is_valid(t: Template) -> Column:
    moves = ", ".join(f"{quoted(f'{state}>{role}')}, {quoted(role)}" for state, roles in t.follows.items() for role in roles)
    last = f"aggregate(turns, 'start', (s, x) -> coalesce(element_at(map({moves}), concat(s, '>', x.role)), 'error'))"
    return F.expr(f"{last} in ({', '.join(map(quoted, t.final))})")


def formatted(conversations: DataFrame, t: Template = INSTRUCT) -> DataFrame:
    """(conv_id, valid, segments, formatted, loss_spans), one row a conversation.

    segments: array of (text, loss); loss_spans: start and length, in code
    points, of the segments under the loss in ``formatted``.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    out = rows.select("conv_id", order_is_valid(t).alias("valid"), F.concat(
        F.array(F.struct(F.lit(t.begin).alias("text"), F.lit(False).alias("loss"))), turn_segments(t)).alias("segments"))
    spans = F.expr("""aggregate(segments, named_struct('at', 0, 'spans', cast(array() as array<struct<start: int, n: int>>)),
        (a, x) -> named_struct('at', a.at + char_length(x.text),
                               'spans', if(x.loss, concat(a.spans, array(named_struct('start', a.at, 'n', char_length(x.text)))), a.spans)),
        a -> a.spans)""")
    return out.select("conv_id", "valid", "segments", F.expr("array_join(transform(segments, x -> x.text), '')").alias("formatted"), spans.alias("loss_spans"))


def pattern(t: Template) -> str:
    """Regular expression of one turn."""
    def literal(s: str) -> str:
        return "".join("\\n" if c == "\n" else c if c.isalnum() or c in " _:" else "\\" + c for c in s)

    first, second, after = t.other
    turns = [literal(first) + ".*?" + literal(second) + ".*?" + literal(after)]
    # the longest opening mark is tried first
    turns += [literal(m.before) + ".*?" + literal(m.after) for m in sorted(t.roles.values(), key=lambda m: -len(m.before))]
    return "(?s)" + "|".join(turns)


def read_back(rows: DataFrame, t: Template = INSTRUCT) -> DataFrame:
    """(conv_id, turns, loss_texts) of formatted conversations; turns are (role, text)."""
    first, second, after = t.other

    def inner(x: str, before: str, end: str) -> str:
        return f"substring({x}, {len(before) + 1}, char_length({x}) - {len(before) + len(end)})"

    cases = f"when startswith(x, {quoted(first)}) then named_struct('role', " + unescape(
        f"replace(substring(x, {len(first) + 1}, locate({quoted(second)}, x) - {len(first) + 1}), {quoted(chr(92) + '>')}, '>')", t) + (
        f", 'text', {unescape(f'substring(x, locate({quoted(second)}, x) + {len(second)}, char_length(x) - locate({quoted(second)}, x) - {len(second) + len(after) - 1})', t)})")
    for role, m in sorted(t.roles.items(), key=lambda r: -len(r[1].before)):
        cases += f" when startswith(x, {quoted(m.before)}) then named_struct('role', {quoted(role)}, 'text', {unescape(inner('x', m.before, m.after), t)})"
    found = F.regexp_extract_all("formatted", F.lit(pattern(t)), F.lit(0)).alias("raw")
    under = F.expr(f"transform(loss_spans, s -> {unescape('substring(formatted, s.start + 1, s.n)', t)})").alias("loss_texts")
    return rows.select("conv_id", "valid", found, under, F.char_length("formatted").cast("long").alias("formatted_chars")).select(
        "conv_id", "valid", F.expr(f"transform(raw, x -> case {cases} end)").alias("turns"), "loss_texts", "formatted_chars")


def digests(rows: DataFrame, t: Template = INSTRUCT) -> DataFrame:
    """Counts and digests of what is read back."""
    back = read_back(rows, t)
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.expr("array_join(transform(turns, x -> concat(x.role, '\\n', x.text, '\\n')), '')"), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars", "valid")


def oracle(t: Template = INSTRUCT) -> str:
    """DuckDB statement for ``digests`` over all conversations and the made one."""
    def q(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def esc(text: str) -> str:
        out = f"replace({text}, {q(chr(92))}, {q(chr(92) * 2)})"
        for c in t.control:
            out = f"replace({out}, {q(c)}, {q(broken(c))})"
        return out

    first, second, after = t.other
    marks = " ".join(f"when role = {q(r)} then {len(m.before) + len(m.after)}" for r, m in t.roles.items())
    loss = ", ".join(q(r) for r, m in t.roles.items() if m.loss)
    moves = " or ".join(f"(before = {q(s)} and role in ({', '.join(map(q, r))}))" for s, r in t.follows.items())
    return f"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
d as (select *, lag(role, 1, 'start') over w as before, lead(role) over w is null as is_last from c window w as (partition by conv_id order by turn nulls first, role, text))
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role in ({loss})), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role in ({loss})), '')) as loss_sha256,
  cast({len(t.begin)} + sum(length({esc('text')}) + case {marks} else {len(first) + len(second) + len(after)} + length(replace({esc('role')}, '>', {q(chr(92) + '>')})) end) as bigint) as formatted_chars,
  bool_and({moves}) and bool_or(is_last and role in ({', '.join(map(q, t.final))})) as valid
from d group by conv_id
"""
