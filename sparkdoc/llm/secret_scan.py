"""Secret scans: patterns, then automata inferred from labelled credentials.

The base patterns find assignments, access keys and hex runs. The credentials that they find are the labels: up to
``MAX_TRAIN`` distinct ones per kind of at most ``MAX_LENGTH`` characters each (the least by hash, so partitions don't
matter). From each kind's strings a prefix tree with counts is built, and states whose outgoing frequencies are
compatible by the Hoeffding bound are merged, red-blue order, into a probabilistic automaton (ALERGIA). Characters are
read as classes within a format: digits, lower a-f, lower g-z, upper, other; with the automaton over classes, a
character's chance is its class's chance divided by the class's size. A class that a state never saw has a small smoothed
chance and goes back to the first state.

Candidates are all runs of the credential characters ``[A-Za-z0-9+/_.=-]`` of the whole text, and the parts of a run
between ``=``, between ``=`` and ``/``, and between ``=``, ``/`` and ``.``, each without marks at its end, of
``SHORTEST`` characters or more, which is the least length of a label. Every one is scored: log likelihood under each
automaton against a background, the class transitions of all texts' runs of such characters outside credentials. A
candidate is added as kind ``learned`` if the likelihood ratio is ``EVIDENCE`` in all (a credential is rare among runs, so
a short one must fit its format well) and ``MARGIN`` a character, and it overlaps no base span. Of a run and its parts
the largest that qualify count. All candidates of a batch are scored together, character by character.

Defined cases: null is the empty text, which has no spans; candidates of any length are scored whole; a corpus without
credentials adds nothing; spans are in code points, end exclusive; repeated ids and other columns don't matter.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed
from .textkit import pieces

#: The base kinds, in their order, their patterns and least lengths.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: A text without one of these has no assignment; they are looked for first.
_NAMES = re.compile(r"password|passwd|secret|token|api_?key", re.ASCII | re.IGNORECASE)

MAX_TRAIN = 2_000
MAX_LENGTH = 1_000
SHORTEST = min(LEAST.values())
MARGIN = 0.4
#: Log of the odds against a run being a credential.
EVIDENCE = 14.0
#: Candidates that are longer than all but so many others are scored one by one from there on.
FEW = 16
ALPHA = 0.05
#: Times that a class counts as seen where it was not.
UNSEEN = 0.1
LEARNED = "learned"

#: Character classes: 0 digit, 1 a-f, 2 g-z, 3 A-Z, 4 other; and how many characters each has.
_CLASS = np.full(256, 4, np.int8)
_CLASS[48:58], _CLASS[97:103], _CLASS[103:123], _CLASS[65:91] = 0, 1, 2, 3
_WIDTH = np.array([10.0, 6.0, 20.0, 26.0, 6.0])
_TABLE = {i: int(c) for i, c in enumerate(_CLASS[:128])}
_TRAIL = np.zeros(256, bool)
_TRAIL[[*b".=-"]] = True  # at a run's end these belong to the sentence
_RUN = np.zeros(256, bool)
_RUN[[*range(48, 58), *range(65, 91), *range(97, 123), *b"+/_.=-"]] = True


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, leftmost and non-overlapping within a kind, by start then kind."""
    out = []
    if _NAMES.search(text):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def credential(text: str, start: int, kind: int, end: int) -> str:
    """What a base span holds; of an assignment its value."""
    return ASSIGN.match(text, start)[2] if kind == 0 else text[start:end]


@dataclass
class Automaton:
    """``goto[s, c]`` is the next state; ``logp[s, c]`` the log chance per character; ``end[s]`` of ending."""

    goto: np.ndarray
    logp: np.ndarray
    end: np.ndarray

    def scores(self, classes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Log likelihoods of the spans of a sequence of character classes, all spans a character at a time."""
        length = ends - starts
        order = np.argsort(-length, kind="stable")
        at, length = starts[order], length[order]
        state, total = np.zeros(len(at), np.int64), np.zeros(len(at))
        t, alive = 0, len(at)
        while (alive := int(np.searchsorted(-length[:alive], -t))) > FEW:
            c = classes[at[:alive] + t]
            total[:alive] += self.logp[state[:alive], c]
            state[:alive] = self.goto[state[:alive], c]
            t += 1
        if alive:
            goto, logp = self.goto.tolist(), self.logp.tolist()
            for i in range(alive):
                s, add = int(state[i]), 0.0
                for c in classes[at[i] + t : at[i] + length[i]].tolist():
                    add += logp[s][c]
                    s = goto[s][c]
                state[i], total[i] = s, total[i] + add
        out = np.empty(len(at))
        out[order] = total + self.end[state]
        return out

    def score(self, text: str) -> float:
        classes = _CLASS[np.frombuffer(text.encode("latin-1", "replace"), np.uint8)]
        return float(self.scores(classes, np.array([0]), np.array([len(classes)]))[0])


def infer(words: list[str], alpha: float = ALPHA) -> Automaton:
    """ALERGIA: a prefix tree of class sequences whose compatible states are merged."""
    kids: list[dict[int, int]] = [{}]
    count, stop = [0], [0]
    flow: list[Counter] = [Counter()]
    for w in words:
        s = 0
        count[0] += 1
        for ch in w:
            c = _TABLE.get(ord(ch), 4)
            flow[s][c] += 1
            if c not in kids[s]:
                kids[s][c] = len(kids)
                kids.append({})
                count.append(0)
                stop.append(0)
                flow.append(Counter())
            s = kids[s][c]
            count[s] += 1
        stop[s] += 1
    bound = math.sqrt(0.5 * math.log(2 / alpha))

    def differ(f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def compatible(p: int, q: int) -> bool:
        todo = [(p, q)]
        while todo:
            a, b = todo.pop()
            if differ(stop[a], count[a], stop[b], count[b]) or any(differ(flow[a][c], count[a], flow[b][c], count[b]) for c in flow[a].keys() | flow[b].keys()):
                return False
            todo += [(kids[a][c], kids[b][c]) for c in kids[a].keys() & kids[b].keys() if kids[a][c] != kids[b][c]]
        return True

    def fold(p: int, q: int) -> None:
        """q, the root of a tree, goes into p."""
        todo = [(p, q)]
        while todo:
            a, b = todo.pop()
            count[a] += count[b]
            stop[a] += stop[b]
            flow[a].update(flow[b])
            for c, t in kids[b].items():
                if c in kids[a]:
                    todo.append((kids[a][c], t))
                else:
                    kids[a][c] = t

    red = [0]
    while True:
        blue = sorted({(s, c, t) for s in red for c, t in kids[s].items() if t not in red}, key=lambda x: (-count[x[2]], x))
        if not blue:
            break
        s, c, t = blue[0]
        for r in red:
            if compatible(r, t):
                kids[s][c] = r
                fold(r, t)
                break
        else:
            red.append(t)
    at = {s: i for i, s in enumerate(red)}
    n = len(red)
    goto, logp, end = np.zeros((n, 5), np.int64), np.zeros((n, 5)), np.zeros(n)
    for s, i in at.items():
        total = count[s] + 6 * UNSEEN
        for c in range(5):
            logp[i, c] = math.log((flow[s][c] + UNSEEN) / total / _WIDTH[c])
        for c, t in kids[s].items():
            goto[i, c] = at[t]
        end[i] = math.log((stop[s] + UNSEEN) / total)
    return Automaton(goto, logp, end)


@dataclass
class Formats:
    """The automata, and the background: log chance per character of a class after a class (row 5: at the start)."""

    automata: list[Automaton]
    background: np.ndarray

    def sums(self, classes: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Running sums of the background's score, and of the most that each automaton may give."""
        summed = lambda x: np.concatenate([[0.0], np.cumsum(x)])
        return summed(self.background[before, classes]), [summed(a.logp.max(0)[classes]) for a in self.automata]

    def evidence(self, classes: np.ndarray, sums: tuple[np.ndarray, list[np.ndarray]], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Log likelihood ratio of the best automaton to the background for spans; -inf where it can't qualify."""
        out = np.full(len(starts), -np.inf)
        least = np.maximum(EVIDENCE, MARGIN * (ends - starts))
        plain = sums[0][ends] - sums[0][starts]
        for a, most in zip(self.automata, sums[1], strict=True):
            maybe = np.flatnonzero(most[ends] - most[starts] + a.end.max() - plain >= least - 1e-6)
            out[maybe] = np.maximum(out[maybe], a.scores(classes, starts[maybe], ends[maybe]) - plain[maybe])
        return out


def _before(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether a byte is a credential character, class of such a one right before it in its text, or 5)."""
    run = _RUN[data]
    before = np.full(len(data), 5, np.int64)
    before[1:][run[:-1]] = _CLASS[data[:-1]][run[:-1]]
    inner = bounds[:-1]
    before[inner[inner < len(data)]] = 5
    return run, before


def class_pairs(column: pa.Array) -> np.ndarray:
    """Counts of (class before or 5, class) over all runs of credential characters of all texts."""
    out = np.zeros(36, np.int64)
    for _, _, data, bounds in pieces(column):
        run, before = _before(data, bounds)
        out += np.bincount((before * 6 + _CLASS[data])[run], minlength=36)
    return out


def background(pairs: dict[int, int]) -> np.ndarray:
    """Add-one smoothed transition log chances per character."""
    n = np.ones((6, 5))
    for k, v in pairs.items():
        if k % 6 < 5:
            n[k // 6, k % 6] += v
    return np.log(n / n.sum(1, keepdims=True) / _WIDTH)


def candidates(data: np.ndarray, bounds: np.ndarray, run: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(starts, ends) of the runs, and then of their parts at finer and finer cuts."""
    last = np.maximum.accumulate(np.where(_TRAIL[data], -1, np.arange(len(data))))  # the last place so far that is no mark
    ink = run.copy()
    border = np.zeros(len(data) + 1, bool)  # one text's run ends where the next one's begins
    border[bounds] = True
    for cut in (0, *b"=/."):
        ink &= data != cut
        starts = ink.copy()
        starts[1:] &= ~ink[:-1] | border[1:-1]
        ends = ink.copy()
        ends[:-1] &= ~ink[1:] | border[1:-1]
        starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        if cut:  # parts beside such a cut are new
            new = np.zeros(len(starts), bool)
            new[starts > 0] = data[starts[starts > 0] - 1] == cut
            new[ends < len(data)] |= data[ends[ends < len(data)]] == cut
            starts, ends = starts[new], ends[new]
        ends = np.minimum(ends, last[ends - 1] + 1)
        ok = ends - starts >= SHORTEST
        yield starts[ok], ends[ok]


def learned_spans(column: pa.Array, formats: Formats) -> Iterator[tuple[int, int, int]]:
    """(row, start, end) in bytes of the candidates that qualify, the largest ones first within a row."""
    for i, _, data, bounds in pieces(column):
        run, before = _before(data, bounds)
        classes = _CLASS[data].astype(np.int64)
        sums = formats.sums(classes, before)
        for starts, ends in candidates(data, bounds, run):
            good = formats.evidence(classes, sums, starts, ends) >= np.maximum(EVIDENCE, MARGIN * (ends - starts))
            rows = np.searchsorted(bounds, starts[good], "right") - 1
            for r, a, b in zip(rows.tolist(), starts[good].tolist(), ends[good].tolist(), strict=True):
                base = int(bounds[r])
                yield i + r, a - base, b - base


def train(docs: DataFrame, max_train: int = MAX_TRAIN, text_col: str = "text") -> Formats:
    """An automaton per base kind that occurs, from a bounded sample of its distinct credentials; the background from all texts."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [(text, a, k, b) for text in batch.column(0).to_pylist() if text for a, k, b in base_spans(text)]
            found = sorted({(k, credential(text, a, k, b)) for text, a, k, b in spans})
            known = pa.array([text[a:b] for text, a, _, b in spans], pa.string())
            pairs = np.maximum(class_pairs(batch.column(0)) - class_pairs(known), 0)  # the background has no credentials
            kinds = [*(k for k, _ in found), *(10 + i for i in range(36))]
            yield pa.record_batch([pa.array(kinds, pa.int32()), pa.array([*(w for _, w in found), *[None] * 36], pa.string()), pa.array([*[1] * len(found), *pairs.tolist()], pa.int64())], ["kind", "word", "n"])

    found = docs.select(F.col(text_col).alias("text")).mapInArrow(find, "kind int, word string, n bigint")
    # one pass: the least hashes of each kind's distinct credentials, and 36 sums
    counted = checkpointed(found.groupBy("kind", "word").agg(F.sum("n").alias("n")))
    pairs = {r.kind - 10: r.n for r in counted.where("kind >= 10").collect()}
    out = []
    for kind in range(len(KINDS)):
        words = [r.word for r in counted.where((F.col("kind") == kind) & (F.length("word") <= MAX_LENGTH)).orderBy(F.xxhash64("word"), "word").limit(max_train).collect()]
        if words:
            out.append(infer(sorted(words)))
    return Formats(out, background(pairs))


def scan_batch(column: pa.Array, formats: Formats) -> list[tuple[list[int], str, str]]:
    """Per text: base counts, base spans as text, all spans as text."""
    texts = [x or "" for x in column.to_pylist()]
    base = [base_spans(x) for x in texts]
    more: dict[int, list] = {}
    for row, a, b in learned_spans(column, formats) if formats.automata else ():
        text = texts[row]
        if not text.isascii():  # spans are in code points
            raw = text.encode()
            a, b = len(raw[:a].decode()), len(raw[:b].decode())
        taken = [*base[row], *more.get(row, ())]
        if not any(x < b and a < y for x, _, y in taken):
            more.setdefault(row, []).append((a, len(KINDS), b))
    names = (*KINDS, LEARNED)
    said = lambda spans: ",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans)
    return [([sum(k == i for _, k, _ in spans) for i in range(3)], said(spans), said(sorted([*spans, *more.get(row, ())]))) for row, spans in enumerate(base)]


def scanned(docs: DataFrame, formats: Formats, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, n_learned and spans."""
    model = docs.sparkSession.sparkContext.broadcast(formats)  # three automata of at most MAX_TRAIN strings each

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "n_learned", "spans"]
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                rows = scan_batch(part.column(1), model.value)
                n = [pa.array([r[0][k] for r in rows], pa.int64()) for k in range(3)]
                digest = pa.array([hashlib.sha256(r[1].encode()).hexdigest() for r in rows], pa.string())
                learned = pa.array([r[2].count(LEARNED) for r in rows], pa.int64())
                yield pa.record_batch([part.column(0), *n, digest, learned, pa.array([r[2] for r in rows], pa.string())], names)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(scan, f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, n_learned bigint, spans string")
