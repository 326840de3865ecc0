"""Chat formatting: a hidden Markov model recovers the speaker of every line of a transcript.

A transcript is a sequence of lines. States are the roles, each once for the first line of a turn and
once for its further lines. A line is observed through its speaker marker (a name and a colon, a
chat tag, or the role that a row of a conversation table gives) and a few features of the line itself.
A role that a table's row names binds: only its states are left to that row. Transition and marker weights are
fixed priors, the line features' emissions are estimated over the whole corpus and mixed with a uniform one, so that
no line outweighs a marker however large the corpus is; Viterbi gives the roles, and turns are rendered in
one canonical form.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ROLES = ("system", "user", "assistant", "tool")
#: Speaker names that mark a role; fixed values.
NAMES = {
    "system": ("system", "instruction", "instructions", "context", "developer"),
    "user": ("user", "human", "prompter", "customer", "question", "q", "client", "me"),
    "assistant": ("assistant", "ai", "bot", "gpt", "model", "answer", "a", "agent", "chatbot"),
    "tool": ("tool", "function", "observation", "result"),
}
_ROLE_OF = {n: r for r, names in enumerate(NAMES.values()) for n in names}
_TAG = re.compile(r"[ \t\r\v\f]*(?:<\|(?:im_start\|>)?[ \t]*(\w+)\|?>?|\[(\w+)\]|###?[ \t]*(\w+)[ \t]*:?|\*{0,2}(\w+)\*{0,2}[ \t]*:)[ \t\r\v\f]*")
#: Features of a line, as one small number: ends with a question mark, short, long, starts with a list sign.
N_FEATURES = 16
NO_MARKER = len(ROLES)


def marker(line: str) -> tuple[int, str]:
    """(role that the line's marker names, or NO_MARKER; the line without that marker)."""
    got = _TAG.match(line)
    if got:
        role = _ROLE_OF.get(next(g for g in got.groups() if g).lower())
        if role is not None:
            return role, line[got.end() :]
    return NO_MARKER, line


def named_role(name: str | None) -> int:
    """The role that a table's role column names, or NO_MARKER."""
    return _ROLE_OF.get((name or "").strip().strip(":<>|[]#*").lower(), NO_MARKER)


def feature(line: str) -> int:
    n = len(line.split())
    return (line.rstrip().endswith("?")) + 2 * (n <= 6) + 4 * (n >= 40) + 8 * line.lstrip().startswith(("-", "*", "1.", "```", "{"))


def _log(x) -> np.ndarray:
    return np.log(np.asarray(x, float))


#: First role: mostly the system's or the user's.
START = _log([0.4, 0.5, 0.08, 0.02])
#: Role of the next turn given this one's.
NEXT = _log([[0.02, 0.9, 0.07, 0.01], [0.02, 0.06, 0.87, 0.05], [0.02, 0.85, 0.05, 0.08], [0.01, 0.07, 0.9, 0.02]])
#: A marker is right, or wrong, with these weights; a line without one rarely opens a turn.
MARKED, MISMARKED, CONTINUED, OPENED_BARE, MARKED_ON = np.log(0.9999), np.log(0.0001 / 3), np.log(0.98), np.log(0.05), np.log(0.001)
#: Further lines of a turn resemble each other: their features count by this much.
FURTHER = 0.25


def viterbi(marks: np.ndarray, sure: np.ndarray, features: np.ndarray, opens: np.ndarray, closed: np.ndarray, emission: np.ndarray) -> np.ndarray:
    """States of all lines: role r opening a turn is r, going on is r + number of roles.

    sure says that the mark comes from outside the text (a table's role column) and binds.
    opens says that a turn starts on the line for certain (a row of a table); elsewhere a marker, or its
    lack, tells; a closed line opens no turn (a further line of a row whose role is named). emission: log probability of a line feature [role, feature].
    """
    k, n = len(ROLES), len(marks)
    right, wrong = np.where(sure, 0.0, MARKED)[:, None], np.where(sure, -1e9, MISMARKED)[:, None]
    see = (emission - np.log(np.exp(emission).mean(0))).T[features]  # [line, role], beside what all roles show together
    open_ = np.where(marks[:, None] == NO_MARKER, np.where(opens[:, None], 0.0, OPENED_BARE), np.where(marks[:, None] == np.arange(k), right, wrong)) + see
    open_ = np.where(closed[:, None], -1e9, open_)
    on = np.where(opens[:, None], -1e9, np.where(marks[:, None] == NO_MARKER, CONTINUED, MARKED_ON)) + FURTHER * see
    best = np.r_[START + open_[0], np.full(k, -1e9)]
    back = np.zeros((n, 2 * k), np.int32)
    for i in range(1, n):
        last = np.maximum(best[:k], best[k:])
        which = np.where(best[:k] >= best[k:], np.arange(k), np.arange(k) + k)
        to = last[:, None] + NEXT
        new, keep = to.max(0) + open_[i], last + on[i]
        back[i, :k], back[i, k:] = which[to.argmax(0)], which
        best = np.r_[new, keep]
    out = np.empty(n, np.int32)
    out[-1] = best.argmax()
    for i in range(n - 1, 0, -1):
        out[i - 1] = back[i, out[i]]
    return out


def render(turns: list[tuple[int, str]]) -> str:
    """The canonical form: <|role|>, a line break, the text, <|end|>, a line break."""
    return "".join(f"<|{ROLES[r]}|>\n{t}\n<|end|>\n" for r, t in turns)


def recover(lines: list[str], given: list[int], opens: list[bool], emission: np.ndarray, closed: list[bool] | None = None) -> list[tuple[int, str]]:
    """Turns (role, text) of one transcript's lines. given: role named outside the line, or NO_MARKER."""
    closed = closed or [False] * len(lines)
    if not lines:
        return []
    seen = [(g, line) if g != NO_MARKER else (NO_MARKER, line) if c else marker(line) for line, g, c in zip(lines, given, closed, strict=True)]
    marks, bare = np.array([m for m, _ in seen]), [b for _, b in seen]
    states = viterbi(marks, np.array(given) != NO_MARKER, np.array([feature(b) for b in bare]), np.array(opens), np.array(closed), emission)
    turns: list[tuple[int, list[str]]] = []
    for s, text in zip(states, bare, strict=True):
        if s < len(ROLES) or not turns:
            turns.append((int(s) % len(ROLES), [text]))
        else:
            turns[-1][1].append(text)
    return [(r, "\n".join(t).strip(" \t\n\r\x0b\x0c")) for r, t in turns]


def emissions(conversations: DataFrame) -> np.ndarray:
    """Log probabilities [role, line feature] over all lines of rows whose role is named: counted in one
    pass, a row per role, feature and task reaching the shuffle; half of each is uniform, whatever the counts."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = np.zeros((len(ROLES), N_FEATURES), np.int64)
        for role, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            r = named_role(role)
            if r != NO_MARKER:
                for line in (text or "").split("\n"):
                    n[r, feature(line)] += 1
        r, f = np.nonzero(n)
        return pa.RecordBatch.from_arrays([pa.array(r, pa.int64()), pa.array(f, pa.int64()), pa.array(n[r, f])], ["r", "f", "n"])

    n = np.ones((len(ROLES), N_FEATURES))
    for r, f, c in common.map_arrow(conversations.select("role", "text"), count, "r long, f long, n long", 100_000).groupBy("r", "f").agg(F.sum("n")).collect():
        n[r, f] += c
    return np.log(0.5 * n / n.sum(1, keepdims=True) + 0.5 / N_FEATURES)


_OUT = "n_turns long, roles string, n_recovered long, rendered string"


def _format(rows: list[tuple], emission: np.ndarray) -> tuple:
    """rows: (role name, text) in order, each opening a turn."""
    lines, given, opens, closed = [], [], [], []
    for name, text in rows:
        role = named_role(name)
        for i, line in enumerate((text or "").split("\n")):
            # a marker inside a row counts where the row names no role; else the row's role holds for all its lines
            lines.append(line)
            given.append(role if role != NO_MARKER and i == 0 else NO_MARKER)
            opens.append(i == 0)
            closed.append(i > 0 and role != NO_MARKER)
    turns = recover(lines, given, opens, emission, closed)
    hidden = sum(named_role(name) == NO_MARKER for name, _ in rows)
    return len(turns), ",".join(ROLES[r] for r, _ in turns), hidden, render(turns)


def format_conversations(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, n_turns, roles, n_recovered (rows whose role was not named), rendered.

    Rows are ordered by turn, then role and text, so ties have one order; a null turn comes first, a null text
    is empty, repeated rows are repeated turns, a null conv_id is a conversation; an empty table gives no rows;
    other columns are ignored. A conversation is rendered whole by one task, as its rendering is one value.
    """
    emission = emissions(conversations)
    kind = conversations.schema["conv_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            got = [_format([(x["role"], x["text"]) for x in rows], emission) for rows in batch.column(1).to_pylist()]
            columns = [pa.array([g[i] for g in got], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["conv_id", "n_turns", "roles", "n_recovered", "rendered"])

    rows = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("rows"))
    return rows.mapInArrow(run, f"conv_id {kind}, {_OUT}")


def format_transcripts(transcripts: DataFrame, emission: np.ndarray | None = None) -> DataFrame:
    """Parse raw transcripts (id, text): one row each with id, n_turns, roles, n_recovered (lines without a
    marker that open a turn), rendered. Null and empty texts have no turns."""
    kind = transcripts.schema["id"].dataType.simpleString()
    weights = np.full((len(ROLES), N_FEATURES), -np.log(N_FEATURES)) if emission is None else emission

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text in batch.column(1).to_pylist():
            lines = (text or "").split("\n") if (text or "").strip() else []
            turns = recover(lines, [NO_MARKER] * len(lines), [False] * len(lines), weights)
            out.append((len(turns), ",".join(ROLES[r] for r, _ in turns), sum(marker(line)[0] == NO_MARKER for line in lines), render(turns)))
        columns = [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.string()))]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "n_turns", "roles", "n_recovered", "rendered"])

    return common.map_arrow(transcripts.select("id", "text"), kernel, f"id {kind}, {_OUT}")


def transcripts(conversations: DataFrame) -> DataFrame:
    """(id, text): each conversation as one raw transcript: its rows in order, each led by a marker where its role is a
    known name, and by none elsewhere. Rows are ordered as in format_conversations; nulls are empty texts."""
    known = F.lower(F.trim("x.role")).isin(*_ROLE_OF)
    line = F.concat(F.when(known, F.concat(F.initcap(F.trim("x.role")), F.lit(": "))).otherwise(F.lit("")), F.coalesce("x.text", F.lit("")))
    rows = conversations.select("conv_id", F.struct("turn", "role", "text").alias("x")).withColumn("line", line)
    rows = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("x", "line"))).alias("rows"))
    return rows.select(F.col("conv_id").alias("id"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("text"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations as raw transcripts, whose turns and roles the model recovers from markers and lines; the role
    column only estimates the emissions. n_recovered counts the lines without a marker. Nulls, empty texts, ties and
    repeated rows as in transcripts and format_transcripts."""
    conversations = common.table(spark, sf_dir, "conversations")
    out = format_transcripts(transcripts(conversations), emissions(conversations))
    return out.withColumnRenamed("id", "conv_id")


#: Where every row names its role and no further line looks like a marker (as in the tables), the truth is plain SQL.
ORACLE_SQL = r"""
WITH t AS (SELECT conv_id, turn, role, trim(coalesce(text, ''), E' \t\n\r\x0b\x0c') AS text, len(string_split(coalesce(text, ''), chr(10))) - 1 AS further FROM conversations)
SELECT conv_id, count(*)::BIGINT AS n_turns, string_agg(role, ',' ORDER BY turn, role, text) AS roles, sum(further)::BIGINT AS n_recovered,
       string_agg('<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10), '' ORDER BY turn, role, text) AS rendered
FROM t GROUP BY conv_id"""
