"""Secret scan by grammar inference.

Fixed patterns find the base spans. Their values are labelled credentials; other runs of credential characters are the
background. Of each label a bounded sample (smallest hashes of all values in the table) gives a prefix tree, whose
statistically compatible states are merged (Hoeffding bound) into a probabilistic automaton. Then every run in every text
is scored: the log likelihood of its characters under each label's automaton less that under the background's. Runs
beyond the threshold that touch no base span are added.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheafwork.llm.common import BYTE_CODES, STEP, mix, pieces, powers, text_buffers

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(rb"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HINTS = (b"passw", b"secret", b"token", b"api")
LEAST = {"assign": 12, "access": 18, "hex": 16}
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
#: Shortest candidate; values of each label in the sample; longest value learned from; Hoeffding level; smoothing; log odds to add;
#: how far below the least likely sample value a character may lie.
RUN, SAMPLE, LONGEST, LEVEL, SMOOTH, ODDS, MARGIN = 12, 400, 96, 0.05, 0.05, 12.0, 0.5

SYMBOL_OF = np.full(256, -1, np.int64)
SYMBOL_OF[[ord(c) for c in SYMBOLS]] = np.arange(len(SYMBOLS))
HEX = np.zeros(256, bool)
HEX[[ord(c) for c in "0123456789abcdef"]] = True


class Automaton:
    """A probabilistic automaton merged from the prefix tree of sample values (ALERGIA, in breadth-first order)."""

    def __init__(self, values: list[str], level: float = LEVEL):
        self.seen, self.ends, self.next = [0], [0], [{}]
        for value in values:
            s = 0
            self.seen[0] += 1
            for c in value:
                t = self.next[s].get(c)
                if t is None:
                    t = len(self.seen)
                    self.seen.append(0)
                    self.ends.append(0)
                    self.next.append({})
                    self.next[s][c] = t
                s = t
                self.seen[s] += 1
            self.ends[s] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / level))
        self.arcs = [dict.fromkeys(n, 0) for n in self.next]  # arc counts
        for s, n in enumerate(self.next):
            for c, t in n.items():
                self.arcs[s][c] = self.seen[t]
        red, blue = [0], [(0, c) for c in sorted(self.next[0])]
        while blue:
            s, c = blue.pop(0)
            t = self.next[s][c]
            if t in red:
                continue
            for r in red:
                if self.compatible(r, t):
                    self.next[s][c] = r
                    self.fold(r, t)
                    break
            else:
                red.append(t)
            # arcs from settled states to unsettled ones
            held = set(red)
            blue = [(r, x) for r in red for x in sorted(self.next[r]) if self.next[r][x] not in held]
        self.red = red

    def differ(self, a: int, na: int, b: int, nb: int) -> bool:
        return abs(a / na - b / nb) > self.bound * (1 / math.sqrt(na) + 1 / math.sqrt(nb))

    def compatible(self, r: int, t: int) -> bool:
        stack = [(r, t)]
        while stack:
            r, t = stack.pop()
            nr, nt = self.seen[r], self.seen[t]
            if not nr or not nt:
                continue
            if self.differ(self.ends[r], nr, self.ends[t], nt):
                return False
            for c in self.arcs[r].keys() | self.arcs[t].keys():
                if self.differ(self.arcs[r].get(c, 0), nr, self.arcs[t].get(c, 0), nt):
                    return False
            stack.extend((self.next[r][c], self.next[t][c]) for c in self.next[t] if c in self.next[r])
        return True

    def fold(self, r: int, t: int) -> None:
        """Adds the tree below t to what r leads to."""
        stack = [(r, t)]
        while stack:
            r, t = stack.pop()
            self.seen[r] += self.seen[t]
            self.ends[r] += self.ends[t]
            for c, n in self.arcs[t].items():
                self.arcs[r][c] = self.arcs[r].get(c, 0) + n
            for c, child in self.next[t].items():
                if c in self.next[r]:
                    stack.append((self.next[r][c], child))
                else:
                    self.next[r][c] = child

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log probabilities and next states by (state, symbol), and log probabilities of ending; smoothed."""
        place = {s: i for i, s in enumerate(self.red)}
        n, a = len(self.red), len(SYMBOLS)
        logs, steps, ends = np.zeros((n, a)), np.tile(np.arange(n)[:, None], (1, a)), np.zeros(n)
        for s, i in place.items():
            total = self.seen[s] + SMOOTH * (a + 1)
            ends[i] = math.log((self.ends[s] + SMOOTH) / total)
            for j, c in enumerate(SYMBOLS):
                logs[i, j] = math.log((self.arcs[s].get(c, 0) + SMOOTH) / total)
                if c in self.next[s]:
                    steps[i, j] = place[self.next[s][c]]
        return logs, steps, ends


@dataclass(frozen=True)
class Grammar:
    """Tables of each label with a sample, and of the background (last)."""

    labels: tuple[str, ...]
    tables: tuple[tuple[np.ndarray, np.ndarray, np.ndarray], ...]
    #: Least log likelihood a character of each label: that of its sample less MARGIN.
    floors: tuple[float, ...]

    def score(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best log odds of each run and the label that has it; a run far less likely, by character, than every value of
        a label's sample is not of that label."""
        total = self.likelihoods(data, starts, ends)
        unlike = total[:-1] < np.array(self.floors)[:, None] * (ends - starts + 1)[None, :]
        odds = np.where(unlike, -np.inf, total[:-1] - total[-1])
        return odds.max(axis=0), odds.argmax(axis=0)

    def likelihoods(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Log likelihood by table and run; all runs advance together, longest first."""
        size = ends - starts
        order = np.argsort(-size, kind="stable")
        start, length = starts[order], size[order]
        total = np.zeros((len(self.tables), len(start)))
        state = np.zeros((len(self.tables), len(start)), np.int64)
        live = np.searchsorted(-length, -np.arange(int(length.max(initial=0))), "left")
        for p, n in enumerate(live):
            symbol = SYMBOL_OF[data[start[:n] + p]]
            for k, (logs, steps, _) in enumerate(self.tables):
                s = state[k, :n]
                total[k, :n] += logs[s, symbol]
                state[k, :n] = steps[s, symbol]
        for k, (_, _, last) in enumerate(self.tables):
            total[k] += last[state[k]]
        out = np.zeros_like(total)
        out[:, order] = total
        return out


def runs(inside: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of at least ``least`` bytes that stay in one text."""
    edge = np.zeros(len(inside) + 1, bool)
    edge[offsets] = True
    around = np.zeros(len(inside) + 2, bool)
    around[1:-1] = inside
    starts = np.flatnonzero(inside & (~around[:-2] | edge[:-1]))
    ends = np.flatnonzero(inside & (~around[2:] | edge[1:])) + 1
    long = ends - starts >= least
    return starts[long], ends[long]


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(first, size)
    codes = BYTE_CODES[data[np.repeat(starts, size) + place]]
    return mix(np.add.reduceat(codes * powers(STEP, int(size.max()))[place], first))


def base_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kind numbers and byte ranges of the fixed patterns' spans, ordered by start and kind. An assignment's span is its value."""
    found = [(s, 2, e) for s, e in zip(*(x.tolist() for x in runs(HEX[data], offsets, LEAST["hex"])))]
    held = data.tobytes()
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        text = held[a:b]
        if b"AKIA" in text:
            found += [(a + m.start(), 1, a + m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
        low = text.lower()
        if any(h in low for h in HINTS):
            found += [(a + m.start(2), 0, a + m.end(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    out = np.array(sorted(found), np.int64).reshape(-1, 3)
    return out[:, 1], out[:, 0], out[:, 2]


def free_runs(data: np.ndarray, offsets: np.ndarray, base: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Candidate runs that touch no base span."""
    starts, ends = runs(SYMBOL_OF[data] >= 0, offsets, RUN)
    _, low, high = base
    marked = np.zeros(len(data) + 1, np.int64)
    np.add.at(marked, low, 1)
    np.add.at(marked, high, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(marked[:-1]) > 0)])
    free = covered[ends] == covered[starts]
    return starts[free], ends[free]


def sampler(sample: int):
    """The values with the smallest hashes of each label, and of the background, in one task's texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, dict[int, str]] = {k: {} for k in (*KINDS, "")}
        for batch in pieces(batches):
            data, offsets = text_buffers(batch.column("text"))
            base = base_spans(data, offsets)
            groups = [(k, base[1][base[0] == i], base[2][base[0] == i]) for i, k in enumerate(KINDS)]
            for label, starts, ends in [*groups, ("", *free_runs(data, offsets, base))]:
                short = ends - starts <= LONGEST
                starts, ends = starts[short], ends[short]
                hashes, at = np.unique(run_hashes(data, starts, ends), return_index=True)
                for h, i in zip(hashes[:sample].tolist(), at[:sample].tolist()):
                    kept[label][h] = data[starts[i]:ends[i]].tobytes().decode("ascii")
                if len(kept[label]) > sample:
                    kept[label] = {h: kept[label][h] for h in heapq.nsmallest(sample, kept[label])}
        rows = [(label, np.uint64(h).view(np.int64).item(), v) for label, d in kept.items() for h, v in d.items()]
        yield pa.RecordBatch.from_pydict({"label": pa.array([r[0] for r in rows], pa.string()), "hash": pa.array(
            [r[1] for r in rows], pa.int64()), "value": pa.array([r[2] for r in rows], pa.string())})

    return run


def learn(docs: DataFrame, sample: int = SAMPLE) -> Grammar:
    """Automata of the labels found in ``docs``; the driver gets at most ``sample`` values of each label."""
    drawn = docs.mapInArrow(sampler(sample), "label string, hash bigint, value string").distinct()
    first = Window.partitionBy("label").orderBy(F.col("hash").bitwiseXOR(F.lit(-(1 << 63))), "value")
    values: dict[str, list[str]] = {}
    for r in drawn.withColumn("n", F.row_number().over(first)).where(F.col("n") <= sample).orderBy("label", "n").collect():
        values.setdefault(r.label, []).append(r.value)
    labels = tuple(k for k in KINDS if k in values)
    background = values.get("") or ["".join(SYMBOLS)]
    tables = tuple(Automaton(v).tables() for v in [*(values[k] for k in labels), background])
    floors = []
    for i, k in enumerate(labels):
        size = np.array([len(v) for v in values[k]])
        stops = np.cumsum(size)
        each = Grammar((), (tables[i],), ()).likelihoods(np.frombuffer("".join(values[k]).encode(), np.uint8), stops - size, stops)
        floors.append(float((each[0] / (size + 1)).min()) - MARGIN)
    return Grammar(labels, tables, tuple(floors))


def scanner(grammar: Grammar, odds: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            data, offsets = text_buffers(batch.column("text"))
            base = base_spans(data, offsets)
            starts, ends = free_runs(data, offsets, base)
            _, at, same = np.unique(run_hashes(data, starts, ends), return_index=True, return_inverse=True)
            kinds, lows, highs = base
            scores = np.zeros(len(kinds))
            if grammar.labels and len(starts):
                best, label = (x[same] for x in grammar.score(data, starts[at], ends[at]))
                add = best >= odds
                names = np.array([KINDS.index(k) for k in grammar.labels])
                kinds = np.concatenate([kinds, len(KINDS) + names[label[add]]])
                lows, highs = np.concatenate([lows, starts[add]]), np.concatenate([highs, ends[add]])
                scores = np.concatenate([scores, best[add]])
            order = np.lexsort((kinds, lows))
            kinds, lows, highs, scores = kinds[order], lows[order], highs[order], scores[order]
            points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            text = np.searchsorted(offsets, lows, "right") - 1
            base_at = points[offsets[:-1]]
            cut = np.searchsorted(text, np.arange(batch.num_rows + 1))
            spans = pa.StructArray.from_arrays(
                [pa.array([NAMES[k] for k in kinds], pa.string()), pa.array(points[lows] - base_at[text], pa.int64()),
                 pa.array(points[highs] - base_at[text], pa.int64()), pa.array(scores, pa.float64())],
                names=["kind", "start", "end", "score"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), spans)], names=["doc_id", "spans"])

    return run


NAMES = (*KINDS, *(f"like_{k}" for k in KINDS))
SPANS = "array<struct<kind: string, start: bigint, end: bigint, score: double>>"


def find_secrets(docs: DataFrame, sample: int = SAMPLE, odds: float = ODDS) -> DataFrame:
    """One row per row of ``docs``: doc_id and spans (kind, start, end in code points, score), by start, then kind.

    Kinds assign, access and hex are the fixed patterns' (score 0; the span of an assignment is its value); like_assign,
    like_access and like_hex are added by the automata, with their log odds. Null and empty texts have no spans; rows
    without doc_id and repeated rows are scanned each. A table without labelled credentials gets no added spans. Other
    columns are not read.
    """
    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(scanner(learn(docs, sample), odds), f"doc_id bigint, spans {SPANS}")
