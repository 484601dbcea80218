"""Chat formatting: speaker roles of transcripts by a hidden Markov model, then canonical turns.

A transcript is lines in order. Hidden states are (role, begins or goes on). A line's features are its speaker marker
(role words of several styles, or none), its length class, whether it ends as a question and whether it begins a row
of the source; they are independent given the state. Start, transition and feature chances are counted on labelled
transcripts (``MAX_TRAIN`` conversations at most, the least by a hash of the id, each with all its turns and lines),
smoothed, with some of the markers taken as lost, so that unmarked turns are recovered from the rest. The counting is
distributed; only the tables of counts, one a partition, come to the driver. The Viterbi path gives the roles; each turn
is rendered as ``<|role|>``, text, ``<|end|>``.

A row's role, where it is one of the known words, is the marker of its first line and its text stays as it is. Else a
marker that the line itself begins with counts; if the line begins a turn, the marker and one space after it are cut off.

Long conversations: rows are put in order by a range partitioning over (conversation, turn, role, text) and each
partition's part of a conversation is a fragment, so a conversation of any length is spread over tasks. The best scores
from every state to every state over a fragment are a small matrix; a conversation's matrices, one a fragment, are
combined to find the states at the cuts, and then every fragment's path is found on its own with its ends fixed. The
pieces of a turn that fragments cut are put together again, so the result is that of one pass over the whole
conversation, however it is dealt out.

Defined cases: null text is one empty line; a null or unknown role gives no marker; rows with equal turn are ordered
by role and text; null ids form a conversation; repeated rows are kept; other columns are ignored; without labelled rows
the model knows only its priors; an empty table gives an empty result. ``begins`` is false for a turn that a path
begins with a state that goes on, which the chances make all but impossible.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

ROLES = ("system", "user", "assistant", "tool")
#: The words that mark a speaker, by role.
MARKERS = {
    "system": "system", "sys": "system", "instruction": "system", "instructions": "system", "context": "system",
    "user": "user", "human": "user", "customer": "user", "question": "user", "q": "user", "me": "user", "prompter": "user",
    "assistant": "assistant", "ai": "assistant", "bot": "assistant", "answer": "assistant", "a": "assistant", "model": "assistant", "gpt": "assistant", "agent": "assistant",
    "tool": "tool", "function": "tool", "observation": "tool", "result": "tool",
}
MARKER = re.compile(r"^\s*(?:#+\s*|\*\*|\[|<\|?)?(" + "|".join(sorted(MARKERS, key=len, reverse=True)) + r")(?:\s?\d+)?(?:(?:\*\*|\]|\|?>)\s*:?|\s*:(?:\*\*)?) ?", re.IGNORECASE)
MAX_TRAIN = 2_000
#: Part of the labelled turns whose marker counts as lost.
LOST = 0.15
STATES = 2 * len(ROLES)  # 2 r begins a turn of role r, 2 r + 1 goes on with it
_LENGTHS = np.array([1, 20, 60, 150, 400, 1000])


def features(line: str, first: bool, role: str | None = None) -> tuple[int, int, int, int]:
    """(marker: role or 4 for none, length class, question, first line of its row); ``role``: the row's, known already."""
    m = None if role else MARKER.match(line)
    body = line[m.end() :] if m else line
    marker = ROLES.index(role or MARKERS[m[1].lower()]) if role or m else 4
    return marker, int(np.searchsorted(_LENGTHS, len(body), "right")), int(body.rstrip().endswith("?")), int(first)


_SIZES = (5, 7, 2, 2)


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    say: list[np.ndarray]  # by feature: log chance of (state, value)

    def emissions(self, seen: np.ndarray) -> np.ndarray:
        return sum(t[:, seen[:, i]].T for i, t in enumerate(self.say))

    def matrix(self, seen: np.ndarray) -> np.ndarray:
        """Best score of paths over the lines, from the state before them (row) to the last line's state."""
        said = self.emissions(seen)
        best = self.move + said[0]
        for e in said[1:]:
            best = (best[:, :, None] + self.move[None]).max(1) + e
        return best

    def path(self, seen: np.ndarray, before: int | None = None, last: int | None = None) -> np.ndarray:
        """The Viterbi path; ``before``: state of the line ahead; ``last``: the state it ends in. Ties go to the lower state."""
        said = self.emissions(seen)
        score = (self.start if before is None else self.move[before]) + said[0]
        back = np.zeros((len(said), STATES), np.int64)
        for t in range(1, len(said)):
            step = score[:, None] + self.move
            back[t] = step.argmax(0)
            score = step.max(0) + said[t]
        out = np.empty(len(said), np.int64)
        out[-1] = int(score.argmax()) if last is None else last
        for t in range(len(said) - 1, 0, -1):
            out[t - 1] = back[t, out[t]]
        return out


def cut_states(model: Model, matrices: list[np.ndarray]) -> list[int]:
    """The state at the end of each fragment on the best path; the first matrix's rows are equal to its start's score."""
    score = matrices[0][0]
    backs = []
    for m in matrices[1:]:
        step = score[:, None] + m
        backs.append(step.argmax(0))
        score = step.max(0)
    out = [int(score.argmax())]
    for back in reversed(backs):
        out.append(int(back[out[-1]]))
    return out[::-1]


_CELLS = STATES + STATES * STATES + STATES * sum(_SIZES)


def _tables(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Views of ``_CELLS`` numbers as the tables of starts, moves and features."""
    start, move, rest = np.split(counts, [STATES, STATES + STATES * STATES])
    say = np.split(rest, np.cumsum([STATES * n for n in _SIZES])[:-1])
    return start, move.reshape(STATES, STATES), [x.reshape(STATES, n) for x, n in zip(say, _SIZES, strict=True)]


def fitted(counts: np.ndarray) -> Model:
    """A model from the counts of labelled conversations."""
    start, move, say = _tables(counts.astype(float))
    for r in range(len(ROLES)):  # a part of the markers counts as lost
        lost = LOST * say[0][2 * r, r]
        say[0][2 * r, r] -= lost
        say[0][2 * r, 4] += lost
    start, move, say = start + 0.1, move + 0.1, [x + 0.1 for x in say]
    start[1::2] = 1e-9  # a transcript begins with a turn
    for r in range(len(ROLES)):  # a turn goes on only as itself
        move[:, 2 * r + 1] = np.where(np.arange(STATES) // 2 == r, move[:, 2 * r + 1], 1e-9)
    norm = lambda x: np.log(x / x.sum(-1, keepdims=True))
    return Model(norm(start), norm(move), [norm(x) for x in say])


def counted(rows: list[tuple], counts: np.ndarray) -> tuple[int, int]:
    """Adds labelled rows (conversation, role, text), in order, to the counts; the first one's start or move isn't.

    Returns the states of the first row's first line and of the last row's last one.
    """
    start, move, say = _tables(counts)
    begin, last, before = -1, -1, object()
    for conv, role, text in rows:
        state = 2 * ROLES.index(role)
        lines = (text or "").split("\n")
        for i, line in enumerate(lines):
            for k, value in enumerate(features(line, i == 0, role if i == 0 else None)):
                say[k][state + (i > 0), value] += 1
        if last < 0:
            begin = state
        elif conv == before:
            move[last, state] += 1
        else:
            start[state] += 1
        before, last = conv, state
        if len(lines) > 1:
            move[state, state + 1] += 1
            move[state + 1, state + 1] += len(lines) - 2
            last = state + 1
    return begin, last


def count(conversations: list[list[tuple[str, str]]]) -> Model:
    """A model from labelled conversations: lists of (role, text)."""
    counts = np.zeros(_CELLS, np.int64)
    for turns in conversations:
        if turns:
            _tables(counts)[0][counted([(0, *t) for t in turns], counts)[0]] += 1
    return fitted(counts)


def _lines(roles: list, texts: list) -> tuple[list[str], list[int], np.ndarray]:
    """(lines, the row of each, features) of rows, the lines without their markers."""
    lines, rows, seen = [], [], []
    for i, (role, text) in enumerate(zip(roles, texts, strict=True)):
        known = MARKERS.get(role.strip().lower()) if role else None
        for k, line in enumerate((text or "").split("\n")):
            seen.append(features(line, k == 0, known if k == 0 else None))
            lines.append(line)
            rows.append(i if known or k else ~i)
    return lines, rows, np.array(seen)


def _in_order(rows: DataFrame) -> DataFrame:
    """Rows dealt out and sorted by conversation, turn, role and text; a conversation may lie in many partitions."""
    order = ["conv_id", "turn", "role", F.xxhash64("text"), "text"]
    return rows.repartitionByRange(*order[:4]).sortWithinPartitions(*order)


def train(conversations: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    rows = conversations.where(F.col("role").isin(*ROLES) & F.col("conv_id").isNotNull()).select("conv_id", "turn", "role", "text")
    some = rows.select("conv_id").distinct().orderBy(F.xxhash64("conv_id", F.lit("train")), "conv_id").limit(max_train)
    sample = _in_order(rows.join(F.broadcast(some), "conv_id")).withColumn("part", F.spark_partition_id())

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, part, begin, head, held = np.zeros(_CELLS, np.int64), None, None, None, None
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True))
            if not rows:
                continue
            first, last = counted(rows, counts)
            if part is None:
                part, begin, head = batch.column("part")[0].as_py(), first, rows[0][0]
            else:  # between two batches
                start, move, _ = _tables(counts)
                target = move[held[1]] if held[0] == rows[0][0] else start
                target[first] += 1
            held = rows[-1][0], last
        if part is not None:
            row = [(part, pa.int32()), (str(head), pa.string()), (begin, pa.int64()), (str(held[0]), pa.string()), (held[1], pa.int64()), (counts.tolist(), pa.list_(pa.int64()))]
            yield pa.record_batch([pa.array([x], kind) for x, kind in row], ["part", "head", "begin", "tail", "last", "counts"])

    total, before = np.zeros(_CELLS, np.int64), None
    for r in sorted(sample.mapInArrow(add, "part int, head string, begin bigint, tail string, last bigint, counts array<bigint>").collect()):  # one a partition
        total += np.array(r.counts)
        start, move, _ = _tables(total)
        target = move[before[1]] if before is not None and before[0] == r.head else start
        target[r.begin] += 1
        before = r.tail, r.last
    return fitted(total)


def parsed(conversations: DataFrame, model: Model) -> DataFrame:
    """conv_id, turn, line (where the recovered turn begins: source turn and line), begins, role, n_lines, text, rendered."""
    kind = conversations.schema["conv_id"].dataType.simpleString()
    sent = conversations.sparkSession.sparkContext.broadcast(model)  # a few hundred numbers
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.col("text"))
    placed = checkpointed(_in_order(rows).withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()))
    cut = placed.groupBy("conv_id").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select(F.col("conv_id").alias("cut_id"))

    def matrix(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        _, _, seen = _lines(table["role"].to_pylist(), table["text"].to_pylist())
        begin = sent.value
        inner = begin.matrix(seen)
        first = (begin.start + begin.emissions(seen[:1])[0])[None]
        for e in begin.emissions(seen)[1:]:
            first = (first[:, :, None] + begin.move[None]).max(1) + e
        return pa.table({"conv_id": table["conv_id"][:1], "part": table["part"][:1], "inner": pa.array([inner.ravel().tolist()]), "first": pa.array([first.ravel().tolist()])})

    def ends(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        inner = [np.array(x).reshape(STATES, STATES) for x in table["inner"].to_pylist()]
        found = cut_states(sent.value, [np.array(table["first"][0].as_py())[None], *inner[1:]])
        return pa.table({"conv_id": table["conv_id"], "part": table["part"], "before": pa.array([None, *found[:-1]], pa.int32()), "last": pa.array(found, pa.int32())})

    many = placed.join(cut, F.col("conv_id").eqNullSafe(F.col("cut_id")), "left_semi")
    parts = many.groupBy("conv_id", "part").applyInArrow(matrix, f"conv_id {kind}, part int, inner array<double>, first array<double>")
    bounds = parts.groupBy("conv_id").applyInArrow(ends, f"conv_id {kind}, part int, before int, last int").withColumnsRenamed({"conv_id": "cut_id", "part": "cut_part"})

    def turns(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        lines, rows, seen = _lines(table["role"].to_pylist(), table["text"].to_pylist())
        before, last = table["before"][0].as_py(), table["last"][0].as_py()
        states = sent.value.path(seen, before, last)
        at = [i for i, s in enumerate(states) if i == 0 or s % 2 == 0 or s // 2 != states[i - 1] // 2]
        turn, begin = table["turn"].to_pylist(), {}
        for i, r in enumerate(rows):
            begin.setdefault(r if r >= 0 else ~r, i)
        out: dict[str, list] = {k: [] for k in ("turn", "line", "begins", "role", "n_lines", "text")}
        for a, b in zip(at, [*at[1:], len(lines)], strict=True):
            row = rows[a] if rows[a] >= 0 else ~rows[a]
            unnamed = rows[a] < 0 or a != begin[row]  # the row's role isn't this line's marker
            said = [lines[a][m.end() :] if unnamed and (m := MARKER.match(lines[a])) else lines[a], *lines[a + 1 : b]]
            for k, v in zip(out, (turn[row], a - begin[row], bool(states[a] % 2 == 0), ROLES[states[a] // 2], b - a, "\n".join(said)), strict=True):
                out[k].append(v)
        n = len(at)
        goes_on = before is not None and states[0] % 2 == 1 and states[0] // 2 == before // 2
        if goes_on:  # the piece is no turn's beginning, so nothing is cut off its line
            out["text"][0] = "\n".join(lines[: at[1] if n > 1 else None])
        edge = [last is not None and i in (0, n - 1) for i in range(n)]  # pieces that other fragments may hold more of
        return pa.table({"conv_id": pa.array([table["conv_id"][0].as_py()] * n, table["conv_id"].type), "part": pa.array([table["part"][0].as_py()] * n, pa.int32()), "piece": pa.array(range(n), pa.int32()), "edge": pa.array(edge), "goes_on": pa.array([goes_on and i == 0 for i in range(n)]),
                         "turn": pa.array(out["turn"], pa.int64()), "line": pa.array(out["line"], pa.int32()), "begins": pa.array(out["begins"]), "role": pa.array(out["role"]), "n_lines": pa.array(out["n_lines"], pa.int32()), "text": pa.array(out["text"], pa.string())})

    whole = placed.join(bounds, F.col("conv_id").eqNullSafe(F.col("cut_id")) & (F.col("part") == F.col("cut_part")), "left").select("conv_id", "part", "place", "turn", "role", "text", "before", "last")
    made = ["turn", "line", "begins", "role", "n_lines", "text"]
    pieces = checkpointed(whole.groupBy("conv_id", "part").applyInArrow(turns, f"conv_id {kind}, part int, piece int, edge boolean, goes_on boolean, turn bigint, line int, begins boolean, role string, n_lines int, text string"))
    # a fragment has at most two pieces at its edges; those of one turn become one row
    lane = Window.partitionBy("conv_id").orderBy("part", "piece")
    edges = pieces.where("edge").withColumn("number", F.sum(F.when(F.col("goes_on"), 0).otherwise(1)).over(lane))
    mended = edges.groupBy("conv_id", "number").agg(F.sort_array(F.collect_list(F.struct("part", "piece", *made))).alias("all"))
    head = F.col("all")[0]
    mended = mended.select("conv_id", head["turn"].alias("turn"), head["line"].alias("line"), head["begins"].alias("begins"), head["role"].alias("role"),
                           F.aggregate("all", F.lit(0), lambda n, x: n + x["n_lines"]).alias("n_lines"), F.array_join(F.transform("all", lambda x: x["text"]), "\n").alias("text"))
    out = pieces.where("not edge").select("conv_id", *made).unionByName(mended)
    return out.withColumn("rendered", F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("\n<|end|>")))
