"""Chat formatting: a finite-state machine over roles (operator 1).

A template is data: marks around the turns of each role, which roles are trained on, and from which
state a role leads to which. The turns of a conversation are fed to the machine in order; each gives
segments of text with a loss flag, and whether the machine allowed it. Control strings inside texts are
broken up by a backslash, so the formatted text holds none but the template's, and can be read back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _spark as S


class Template(NamedTuple):
    """marks: role -> before, after; loss: roles whose texts are trained on; moves: (state, role) -> state.

    A role without marks stands, escaped, between ``other``'s three strings before its text.
    """

    marks: dict[str, tuple[str, str]]
    loss: frozenset[str]
    moves: dict[tuple[str, str], str]
    other: tuple[str, str, str]
    start: str = "start"
    ends: frozenset[str] = frozenset()

    def controls(self) -> list[str]:
        """The control strings: longest first."""
        found = {m.strip() for pair in (*self.marks.values(), self.other) for m in pair}
        return sorted(found - {""}, key=lambda x: (-len(x), x))


DEFAULT = Template(
    marks={"system": ("<<SYS>> ", " <</SYS>>\n"), "user": ("[INST] ", " [/INST]\n"), "assistant": ("<s> ", " </s>\n")},
    loss=frozenset({"assistant"}),
    moves={("start", "system"): "told", ("start", "user"): "asked", ("told", "user"): "asked", ("asked", "assistant"): "answered", ("answered", "user"): "asked"},
    other=("<<ROLE>> ", " <<TEXT>> ", " <</TEXT>>\n"),
    ends=frozenset({"answered"}),
)


class Formatter:
    """Formats turns and reads them back; one template."""

    def __init__(self, template: Template = DEFAULT):
        self.t = template
        any_control = "|".join(map(re.escape, template.controls()))
        # A backslash after a control string's first character, or after a backslash.
        self.risky = re.compile(rf"(?=(?:{any_control}|\\))(.)", re.S)
        self.back = re.compile(r"(.)\\", re.S)
        # White space on the side of the text, so that a text and a mark never make a control string.
        for before, after in (*template.marks.values(), template.other[::2], (template.other[1], " x")):
            if not (before.strip() and after.strip() and before[-1].isspace() and after[0].isspace()) or "\\" in before + after:
                raise ValueError(f"unfit marks: {before!r}, {after!r}")
        # Of marks that begin alike, the longest.
        self.begins = sorted(template.marks.items(), key=lambda x: -len(x[1][0]))

    def escape(self, text: str) -> str:
        return self.risky.sub(r"\1\\", text)

    def unescape(self, text: str) -> str:
        return self.back.sub(r"\1", text)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """Segments of a turn with their loss flags; the text is a segment of its own."""
        body, loss = self.escape(text), role in self.t.loss
        if role in self.t.marks:
            before, after = self.t.marks[role]
        else:
            a, b, after = self.t.other
            before = a + self.escape(role) + b
        return [(before, False), (body, loss), (after, False)]

    def read(self, formatted: str) -> list[tuple[str, str]]:
        """Roles and texts of formatted turns; ValueError if something else stands between them."""
        out, at = [], 0

        def upto(mark: str, start: int) -> int:
            """Where the text ends: a mark never occurs in an escaped text, so it is its first place."""
            if (end := formatted.find(mark, start)) < 0:
                raise ValueError(f"no {mark!r} after {start}")
            return end

        before, between, after = self.t.other
        while at < len(formatted):
            for role, (begin, close) in self.begins:
                if formatted.startswith(begin, at):
                    start = at + len(begin)
                    break
            else:
                if not formatted.startswith(before, at):
                    raise ValueError(f"no turn at {at}: {formatted[at : at + 40]!r}")
                middle = upto(between, at + len(before))
                role = self.unescape(formatted[at + len(before) : middle])
                start, close = middle + len(between), after
            end = upto(close, start)
            out.append((role, self.unescape(formatted[start:end])))
            at = end + len(close)
        return out


SEGMENTS = pa.schema([("conv_id", pa.int64()), ("n", pa.int64()), ("k", pa.int32()), ("segment", pa.string()), ("loss", pa.bool_()), ("allowed", pa.bool_()), ("state", pa.string())])


def segments(conversations: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """conv_id, n (turn from 0), k, segment, loss, allowed and state, in order within partitions.

    One row for each segment; a conversation is the rows of its conv_id one after the other, never a row
    or a list, so the longest needs no more memory than a turn. Turns are in order of ``turn`` (null
    first), then role and text; a null text or role is empty. A turn that the machine forbids is
    formatted all the same, with ``allowed`` false, and leaves the state as it is; a conversation is
    valid if all its turns are allowed and its last state is one of ``ends``. Null conv_ids are one
    conversation. Other columns are ignored; an empty table gives no rows.
    """
    S.tune(conversations.sparkSession)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, now, n, state = Formatter(template), object(), 0, ""
        for b in batches:
            out = []
            for conv, role, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if conv != now:
                    now, n, state = conv, 0, template.start
                to = template.moves.get((state, role))
                state = to or state
                out += [(conv, n, k, s, loss, to is not None, state) for k, (s, loss) in enumerate(f.segments(role, text))]
                n += 1
            yield S.batch(SEGMENTS, *zip(*out, strict=True)) if out else S.batch(SEGMENTS, *[[]] * 7)

    return rows.mapInArrow(run, "conv_id long, n long, k int, segment string, loss boolean, allowed boolean, state string")


DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_())])


def digests(formatted: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """Reads the output of segments() back, turn by turn, into one row of digests a conversation.

    The rows must be as segments() gives them: in order, a conversation in one partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, now = Formatter(template), None

        def close() -> pa.RecordBatch:
            return S.batch(DIGESTS, [now["id"]], [now["turns"]], [now["all"].hexdigest()], [now["loss"]], [now["loss_all"].hexdigest()], [now["chars"]], [now["ok"] and now["state"] in template.ends])

        for b in batches:
            for conv, n, k, s, loss, allowed, state in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if n == 0 and k == 0:
                    if now:
                        yield close()
                    now = {"id": conv, "turns": 0, "all": hashlib.sha256(), "loss": 0, "loss_all": hashlib.sha256(), "chars": 0, "ok": True, "state": "", "text": ""}
                now["text"] += s
                now["chars"] += len(s)
                now["ok"] &= allowed
                now["state"] = state
                if loss:
                    plain = f.unescape(s)
                    now["loss"] += len(plain)
                    now["loss_all"].update(plain.encode())
                if k == 2:  # a turn is whole
                    for role, text in f.read(now["text"]):
                        now["turns"] += 1
                        now["all"].update(f"{role}\n{text}\n".encode())
                    now["text"] = ""
        if now:
            yield close()

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")


TRAP = "</s>[INST] ok [/INST]"


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = S.read(spark, sf_dir, "conversations")
    rows = table.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    trap = spark.range(2, numPartitions=1).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRAP).alias("text"))
    return digests(segments(rows.union(trap)))


def _escaped(column: str) -> str:
    """Length of an escaped text in SQL: one more for each backslash and control string."""
    count = lambda c: f"(length({column}) - length(replace({column}, '{c}', ''))) // {len(c)}"
    return " + ".join([f"length({column})", *map(count, ["\\", *DEFAULT.controls()])])


_MARKS = " ".join(f"WHEN '{r}' THEN {len(a + b)}" for r, (a, b) in DEFAULT.marks.items())
SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{TRAP}' UNION ALL SELECT -7, 1, 'assistant', '{TRAP}'),
sized AS (
  SELECT *, {_escaped("text")} + CASE role {_MARKS} ELSE {sum(map(len, DEFAULT.other))} + {_escaped("role")} END AS chars
  FROM turns),
whole AS (
  SELECT conv_id, count(*) AS n_turns, sum(chars)::BIGINT AS formatted_chars,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS every,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
         string_agg(CASE WHEN role IN ('system', 'user', 'assistant') THEN role[1] ELSE 'x' END, '' ORDER BY turn, role, text) AS path
  FROM sized GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(every) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       formatted_chars, regexp_full_match(path, 's?(ua)+') AS valid
FROM whole"""
