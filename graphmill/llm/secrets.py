"""Secret scans: fixed patterns and a character convolutional network over candidates in context.

Findings of the patterns always stay. Candidates are all runs of CANDIDATE token characters or more; each that
no pattern covers is judged, with the text around it, by a small network in numpy: a convolution over the
characters' classes, its largest values before, in and after the run, whatever its length, and a logistic unit.

The network learns from every candidate of every document. The labels are the patterns' findings: runs that a
pattern covers, against runs that none does. By a hash of its window each candidate belongs to one fold of five:
one calibrates, one sets the threshold, and the other three are learned from, EPOCHS times over, in PARTS steps by
a hash of the documents, with sums over all executors. Runs that no pattern covers, but that score above half of
the findings, may be secrets beyond the patterns: from the second time on they are not taught as clean. Calibration
and threshold come from counts of all candidates of their folds by score; the threshold is the highest step of
these counts that keeps the wanted recall. All sums are of whole numbers, so that the network doesn't depend on
how the documents are dealt out.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.llm.common import bounded_batches, slices, text_buffer
from graphmill.llm.minhash import _INVERSE, PRIME, _powers
from graphmill.llm.minhash import mix as _mixed

KINDS = ("assign", "access", "hex", "model")
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HEX_LONG = re.compile(r"[0-9a-f]{32,}")
#: Length of a candidate at least, the patterns' own least length.
CANDIDATE = 8
#: A text needs a run of so many for the patterns without a key word.
LONG_RUN = 16
#: Distinct windows of each label that labelled() draws for Network.train, at most; no query uses them.
TRAIN_ROWS = 3_000
#: How often every candidate is learned from, in how many steps each time, and the first step's size.
EPOCHS, PARTS, RATE = 2, 8, 0.06
#: Of each label, the candidates that the network needs.
LEAST_ROWS = 5
#: Characters around a candidate that the network sees.
BEFORE, AFTER = 24, 8
#: Of a candidate that is learned from, the ends of half as many characters each where it is longer.
LEARNED = 256
RECALL = 0.98

TOKEN = np.zeros(256, bool)
TOKEN[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"]] = True
#: Character classes of the network: 0 none, digits, letters by halves of the alphabet and case, marks, others.
CLASS = np.full(256, 31, np.uint8)
for _i, _c in enumerate("0123456789"):
    CLASS[ord(_c)] = 1 + _i % 5
for _i, _c in enumerate("abcdefghijklmnopqrstuvwxyz"):
    CLASS[ord(_c)] = 6 + (_i if _i < 6 else 6 + _i % 4)
    CLASS[ord(_c) - 32] = 17 + (0 if _i < 6 else 1)
for _i, _c in enumerate(" =:\"'+/_.-@#"):
    CLASS[ord(_c)] = 19 + _i
CLASSES = 32


def patterns(text: str, has_run: bool = True) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' findings: leftmost, non-overlapping for each kind, in code points;
    matches that are too short are dropped. has_run: whether a run of 16 token characters may occur."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    if has_run:
        if "AKIA" in text:
            out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
        out += [(m.start(), 2, m.end()) for m in HEX_LONG.finditer(text)]  # runs are maximal, so short ones hide none
    return sorted(out)


def runs(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of consecutive texts: text, first byte and end of each run of CANDIDATE token characters or more."""
    mask = TOKEN[raw]
    inner = mask.copy()
    inner[:1] = False
    inner[1:] &= mask[:-1]
    edge = at[1:-1]
    edge = edge[edge < len(raw)]
    inner[edge] = False  # runs end with their text
    start = np.flatnonzero(mask & ~inner)
    over = ~mask
    over[edge] = True
    stops = np.concatenate([np.flatnonzero(over), [len(raw)]])
    end = stops[np.searchsorted(stops, start, "right")]
    long = end - start >= CANDIDATE
    start, end = start[long], end[long]
    return np.searchsorted(at, start, "right") - 1, start, end


SPAN = 5
#: Characters that are convolved at a time, about, so that their values stay in the cache.
CONVOLVED = 1 << 14


def surroundings(raw: np.ndarray, low: np.ndarray, high: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The character classes around candidates whose texts lie from low to high, end to end, with 0 beyond
    their text, and the first place and end of each candidate there. Surroundings that meet stand there once."""
    first = np.ones(len(start), bool)
    first[1:] = (low[1:] != low[:-1]) | (start[1:] - BEFORE > end[:-1] + AFTER + SPAN)
    at = np.flatnonzero(first)
    left = start[at] - BEFORE
    size = end[np.append(at[1:], len(start)) - 1] + AFTER + SPAN - left
    begin = np.cumsum(size) - size
    place = np.arange(int(size.sum())) + np.repeat(left - begin, size)
    inside = (place >= np.repeat(low[at], size)) & (place < np.repeat(high[at], size))
    classes = np.where(inside, CLASS[raw[np.clip(place, 0, len(raw) - 1)]], 0).astype(np.uint8)
    moved = (begin - left)[np.cumsum(first) - 1]
    return classes, start + moved, end + moved


def window(raw: np.ndarray, low: int, high: int, start: int, end: int) -> bytes:
    """What training keeps of a candidate in its text, which lies from low to high: the classes before it, its
    own (both ends of a very long one) and those after it."""
    left, right = raw[max(low, start - BEFORE) : start], raw[end : min(high, end + AFTER + SPAN)]
    body = raw[start:end] if end - start <= LEARNED else np.concatenate([raw[start : start + LEARNED // 2], raw[end - LEARNED // 2 : end]])
    return bytes(BEFORE - len(left)) + CLASS[left].tobytes() + CLASS[body].tobytes() + CLASS[right].tobytes() + bytes(AFTER + SPAN - len(right))


def side_by_side(windows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows in one array of classes, and the first place and end of each candidate in it."""
    size = np.array([len(w) for w in windows], np.int64)
    begin = np.cumsum(size) - size
    return np.frombuffer(b"".join(windows), np.uint8), begin + BEFORE, begin + size - AFTER - SPAN


@dataclass
class Network:
    """Classes -> convolution of SPAN -> largest value before, in and after the candidate, at least 0 -> logistic."""

    kernel: np.ndarray  # SPAN, CLASSES, filters
    bias: np.ndarray
    out: np.ndarray
    shift: float
    slope: float = 1.0  # calibration of the logit
    offset: float = 0.0
    threshold: float = 2.0

    FILTERS = 16

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """The values of three characters with the bias, and of the two after them; kept while the weights stay."""
        k, b = self.kernel.astype(np.float32), self.bias.astype(np.float32)
        kept = self.__dict__.get("kept")
        if kept is None or not (np.array_equal(kept[0], k) and np.array_equal(kept[1], b)):
            three = (k[0][:, None, None] + k[1][None, :, None] + k[2][None, None, :] + b).reshape(-1, self.FILTERS)
            kept = self.__dict__["kept"] = (k, b, three, (k[3][:, None] + k[4][None, :]).reshape(-1, self.FILTERS))
        return kept[2:]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "kept"}

    def convolved(self, classes: np.ndarray) -> np.ndarray:
        """A row of FILTERS values for each place with SPAN characters, from tables of three and two characters."""
        three, two = self.tables()
        c = np.concatenate([classes, np.zeros(SPAN - 1, np.uint8)]).astype(np.int32)
        n = len(classes)
        code = (c[: n + 3] << 5) | c[1 : n + 4]
        z = three[(code[:n] << 5) | c[2 : n + 2]]
        z += two[code[3 : n + 3]]
        return z

    def highest(self, z: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """For each candidate the largest of the convolved values before, in and after it."""
        of = {1: z}  # the largest of so many places from each place on
        for n in (1, 2, 4, 8):
            of[2 * n] = np.maximum(of[n][:-n], of[n][n:])
        top = np.empty((len(start), 3, self.FILTERS), np.float32)
        for part, i, size in ((0, start - BEFORE, BEFORE), (2, end, AFTER)):
            n = 1 << min(4, size.bit_length() - 1)
            top[:, part] = of[n][i]
            for more in range(n, size, n):
                np.maximum(top[:, part], of[n][i + min(more, size - n)], out=top[:, part])
        short = end - start < 16
        for n, r in ((8, np.flatnonzero(short)), (16, np.flatnonzero(~short))):
            top[r, 1] = np.maximum(of[n][start[r]], of[n][end[r] - n])
        long = np.flatnonzero(end - start > 32)
        if len(long):
            top[long, 1] = np.maximum.reduceat(z, np.stack([start[long], end[long]], 1).ravel(), axis=0)[::2]
        return top

    def largest(self, classes: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each candidate the largest values before, in and after it, and the first places where they are. A
        very long one is convolved in pieces."""
        shape = (len(start), 3, self.FILTERS)
        if int((end - start).max()) <= 4 * CONVOLVED:
            z = self.convolved(classes)
            top = self.highest(z, start, end)
            size = np.stack([np.full(len(start), BEFORE), end - start, np.full(len(start), AFTER)], 1).ravel()
            cell = np.repeat(np.arange(len(size)), size)
            place = np.arange(len(cell)) + np.repeat(np.stack([start - BEFORE, start, end], 1).ravel() - np.cumsum(size) + size, size)
            same = np.flatnonzero(z[place] == top.reshape(-1, self.FILTERS)[cell])[::-1]
            row = same // self.FILTERS
            where = np.empty(top.size, np.int64)
            where[cell[row] * self.FILTERS + same % self.FILTERS] = place[row]  # the first place is written last
            return top, where.reshape(shape)
        top, where = np.full(shape, -np.inf, np.float32), np.zeros(shape, np.int64)
        for r, (s, e) in enumerate(zip(start.tolist(), end.tolist())):
            for part, (i, j) in enumerate(((s - BEFORE, s), (s, e), (e, e + AFTER))):
                for a in range(i, j, CONVOLVED):
                    b = min(j, a + CONVOLVED)
                    z = self.convolved(classes[a : b + SPAN - 1])[: b - a]
                    best, more = z.argmax(axis=0), z.max(axis=0)
                    where[r, part] = np.where(more > top[r, part], a + best, where[r, part])
                    top[r, part] = np.maximum(more, top[r, part])
        return top, where

    def tops(self, classes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """For each candidate the largest values before, in and after it, 0 at least, side by side."""
        if not len(start):
            return np.zeros((0, 3 * self.FILTERS), np.float32)
        if int((end - start).max()) > 4 * CONVOLVED:
            top = self.largest(classes, start, end)[0]
        else:
            top = self.highest(self.convolved(classes), start, end)
        return np.maximum(top, 0).reshape(len(start), -1)

    def logits(self, classes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.tops(classes, start, end) * self.out).sum(axis=1) + self.shift  # row by row, whatever the batch

    def scores(self, classes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Calibrated probabilities."""
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(classes, start, end) + self.offset, -30, 30)))

    @classmethod
    def untrained(cls) -> Network:
        rng = np.random.default_rng(5)
        return cls(rng.normal(0, 0.3, (SPAN, CLASSES, cls.FILTERS)), np.zeros(cls.FILTERS), rng.normal(0, 0.3, 3 * cls.FILTERS), 0.0)

    @classmethod
    def learned(cls, windows: list[bytes], y: np.ndarray, epochs: int) -> Network:
        """The weights alone, without calibration and threshold."""
        net = cls.untrained()
        params = [net.kernel, net.bias, net.out, np.zeros(1)]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        rng, step = np.random.default_rng(6), 0
        ty = y.astype(float)
        weight = np.where(ty > 0, 0.5 / ty.mean(), 0.5 / (1 - ty.mean()))
        for _ in range(epochs):
            for rows in np.array_split(rng.permutation(len(windows)), max(1, len(windows) // 64)):
                # findings also stand in other surroundings: some lose theirs
                own = [bytes(BEFORE - 2) + windows[r][BEFORE - 2 :] if rng.random() < 0.3 else windows[r] for r in rows]
                x, start, end = side_by_side(own)
                x = np.concatenate([x, np.zeros(SPAN - 1, np.uint8)])
                z = net.bias + sum(net.kernel[k][x[k : len(x) - SPAN + 1 + k]] for k in range(SPAN))
                at = np.empty((len(rows), 3, cls.FILTERS), np.int64)
                for r, (s, e) in enumerate(zip(start, end)):
                    for part, (i, j) in enumerate(((s - BEFORE, s), (s, e), (e, e + AFTER))):
                        at[r, part] = z[i:j].argmax(axis=0) + i
                f = np.broadcast_to(np.arange(cls.FILTERS), at.shape)
                top = np.maximum(z[at, f], 0).reshape(len(rows), -1)
                g = (1 / (1 + np.exp(-np.clip(top @ params[2] + params[3], -30, 30))) - ty[rows]) * weight[rows] / len(rows)
                g_top = (g[:, None] * params[2] * (top > 0)).reshape(at.shape)
                grads = [np.zeros_like(params[0]), g_top.sum(axis=(0, 1)), top.T @ g, np.array([g.sum()])]
                for k in range(SPAN):
                    np.add.at(grads[0][k], (x[at + k], f), g_top)
                step += 1
                for p, d, (m, v) in zip(params, grads, moments):
                    m += 0.1 * (d - m)
                    v += 0.001 * (d * d - v)
                    p -= 0.005 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
                net.shift = float(params[3][0])
        return net

    @classmethod
    def train(cls, windows: list[bytes], y: np.ndarray, recall: float = RECALL, epochs: int = 12) -> Network:
        """Rows in a stated order give the same network. With under five rows of a label it accepts nothing.

        Of the rows of each label, every fifth calibrates, every fifth sets the threshold and the others are
        learned from. Rows taken for clean that a network of the other half scores above half of its findings
        are left out of learning and calibration."""
        y = np.asarray(y, np.int64)
        if min((y > 0).sum(), (y == 0).sum()) < 5:
            return cls.untrained()
        place = np.where(y > 0, np.cumsum(y), np.cumsum(1 - y)) - 1  # a row's number among those of its label
        sure = np.ones(len(y), bool)
        half = place % 2 == 0
        if min((y[half] > 0).sum(), (y[~half] > 0).sum(), (y[half] == 0).sum(), (y[~half] == 0).sum()) >= 5:
            for one in (half, ~half):
                z = cls.learned([w for w, o in zip(windows, one) if o], y[one], max(1, epochs // 3)).logits(*side_by_side(windows))
                sure &= one | (y > 0) | (z < np.median(z[~one & (y > 0)]))
        learn = sure & (place % 5 > 1)
        net = cls.learned([w for w, o in zip(windows, learn) if o], y[learn], epochs)
        z, t = net.logits(*side_by_side(windows)), y.astype(float)
        own = sure & (place % 5 == 0)
        for _ in range(400):  # Platt's two parameters
            p = 1 / (1 + np.exp(-np.clip(net.slope * z[own] + net.offset, -30, 30)))
            net.slope = max(0.05, net.slope - 0.05 * float(((p - t[own]) * z[own]).mean()))
            net.offset -= 0.05 * float((p - t[own]).mean())
        good = np.sort(net.scores(*side_by_side(windows))[(y > 0) & (place % 5 == 1)])
        net.threshold = float(good[int((1 - recall) * len(good))])  # the highest that keeps the recall
        return net


def examined(own: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of consecutive texts: text, first byte and end of each candidate, whether it is in a finding of the
    patterns, and a 63-bit hash of the classes in it and around it."""
    of, start, end = runs(own, off)
    found = np.zeros(len(of), np.int64)
    if not len(of):
        return of, start, end, found, found
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((CLASS[own].astype(np.uint64) + np.uint64(1)) * _powers(len(own), int(PRIME)))])
    low, high = np.maximum(off[of], start - BEFORE), np.minimum(off[of + 1], end + AFTER + SPAN)
    h = (_mixed((sums[high] - sums[low]) * _powers(len(own), _INVERSE)[low] + (start - low).astype(np.uint64) * PRIME) >> np.uint64(1)).astype(np.int64)
    for d in np.flatnonzero(worth_a_look(own, off, of, start, end)[0]):
        mark = covered(own[off[d] : off[d + 1]])
        if mark.any():
            first, last = np.searchsorted(of, [d, d + 1])
            sofar = np.concatenate([[0], np.cumsum(mark)])
            found[first:last] = sofar[end[first:last] - off[d]] > sofar[start[first:last] - off[d]]
    return of, start, end, found, h


def labelled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_rows: int = TRAIN_ROWS) -> tuple[list[bytes], np.ndarray]:
    """Windows and labels for Network.train, which fit() doesn't need: of all documents, for each label the
    most_rows distinct windows with the smallest hash. So findings are drawn from all findings, however rare they
    are, and clean runs from all clean runs.

    Each partition keeps its own most_rows smallest, and these are merged, so that memory is bounded."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        kept: list[dict[bytes, int]] = [{}, {}]
        limit = [(1 << 63) - 1] * 2

        def shrink(y: int) -> None:
            best = sorted((h, w) for w, h in kept[y].items())[:most_rows]
            kept[y] = {w: h for h, w in best}
            if len(best) == most_rows:
                limit[y] = best[-1][0]

        for b in batches:
            raw, at = text_buffer(b.column(0))
            for i, j in slices(at):
                own, off = raw[at[i] : at[j]], at[i : j + 1] - at[i]
                of, start, end, found, h = examined(own, off)
                for y in (0, 1):
                    for r in np.flatnonzero((found == y) & (h < limit[y])).tolist():
                        kept[y][window(own, off[of[r]], off[of[r] + 1], start[r], end[r])] = int(h[r])
                    if len(kept[y]) >= 2 * most_rows:
                        shrink(y)
        for y in (0, 1):
            shrink(y)
            yield pa.RecordBatch.from_arrays([pa.array(list(kept[y]), pa.binary()), pa.array(list(kept[y].values()), pa.int64()), pa.array([y] * len(kept[y]), pa.int32())], names=["w", "h", "y"])

    rows = docs.select(text_col).mapInArrow(run, "w binary, h long, y int").groupBy("w").agg(F.min("h").alias("h"), F.max("y").alias("y"))
    got = [rows.where(F.col("y") == y).orderBy("h", "w").limit(most_rows).toPandas() for y in (0, 1)]
    both = sorted((h, bytes(w), y) for y, g in enumerate(got) for h, w in zip(g["h"], g["w"]))
    return [w for _, w, _ in both], np.array([y for _, _, y in both], np.int64)


#: Scores are counted in steps of 1 / GRID of the logit, BINS of them with 0 in the middle.
GRID, BINS = 256, 1 << 15
#: Gradients are summed in units of 1 / UNIT.
UNIT = 1 << 20
#: One label's part of the sums: kernel, bias, output weights, shift.
WEIGHTS = SPAN * CLASSES * Network.FILTERS + Network.FILTERS + 3 * Network.FILTERS + 1


def score_bin(z: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(z * GRID).astype(np.int64) + BINS // 2, 0, BINS - 1)


def in_parts(raw: np.ndarray, at: np.ndarray, of: np.ndarray, start: np.ndarray, end: np.ndarray, do) -> list:
    """What do(classes, start, end) gives for some CONVOLVED characters with candidates at a time."""
    if not len(of):
        return []
    done = np.cumsum(end - start + BEFORE + AFTER + SPAN)
    cuts = np.unique(np.searchsorted(done, np.arange(CONVOLVED, done[-1], CONVOLVED)))
    return [do(*surroundings(raw, at[of[p]], at[of[p] + 1], start[p], end[p])) for p in np.split(np.arange(len(of)), cuts) if len(p)]


def summed(docs: DataFrame, text_col: str, slots: int, add) -> np.ndarray:
    """Whole sums in `slots` places over all documents; add(sums, raw, at) adds those of consecutive texts."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        sums = np.zeros(slots, np.int64)
        for b in batches:
            raw, at = text_buffer(b.column(0))
            for i, j in slices(at):
                add(sums, raw[at[i] : at[j]], at[i : j + 1] - at[i])
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(sums[some], pa.int64())], names=["slot", "n"])

    got = docs.select(text_col).mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(slots, np.int64)
    out[got.column("slot").to_numpy()] = got.column("n").to_numpy()
    return out


def add_slopes(net: Network, sums: np.ndarray, classes: np.ndarray, start: np.ndarray, end: np.ndarray, sign: int) -> None:
    """Adds the gradient of half the square of max(0, 1 - sign * logit), in units, for some candidates of a label."""
    top, where = net.largest(classes, start, end)
    top = np.maximum(top, 0)
    flat = top.reshape(len(start), -1)
    g = -sign * np.maximum(0, 1 - sign * ((flat * net.out).sum(axis=1) + net.shift))
    g_top = np.rint(g[:, None] * net.out * (flat > 0) * UNIT).reshape(top.shape)
    f = np.broadcast_to(np.arange(net.FILTERS), where.shape)
    c = np.concatenate([classes, np.zeros(SPAN, np.uint8)])
    n = CLASSES * net.FILTERS
    for k in range(SPAN):
        code = c[where + k].astype(np.int64) * net.FILTERS + f
        sums[k * n : (k + 1) * n] += np.bincount(code.ravel(), g_top.ravel(), n).astype(np.int64)
    rest = np.concatenate([g_top.sum(axis=(0, 1)), np.rint(flat * g[:, None] * UNIT).sum(axis=0), [np.rint(g * UNIT).sum()]])
    sums[SPAN * n :] += rest.astype(np.int64)


def step_sums(docs: DataFrame, text_col: str, net: Network, cut: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Over every candidate of the documents: for each label the gradient and the number of candidates of the folds
    that are learned from, and how many findings of any fold are in each bin of score. Clean candidates that score
    `cut` or more are not taught."""

    def add(sums: np.ndarray, raw: np.ndarray, at: np.ndarray) -> None:
        of, start, end, found, h = examined(raw, at)
        if not len(of):
            return
        look = np.flatnonzero((found > 0) | (h % 5 > 1))
        of, start, end, found, h = of[look], start[look], end[look], found[look], h[look]
        if not len(of):
            return
        z = np.concatenate(in_parts(raw, at, of, start, end, net.logits))
        learn = (h % 5 > 1) & ((found > 0) | (z < cut))
        for y, sign in enumerate((-1, 1)):
            r = np.flatnonzero(learn & (found == y))
            sums[2 * WEIGHTS + y] += len(r)
            r = r[sign * z[r] < 1]  # the others have no slope
            in_parts(raw, at, of[r], start[r], end[r], lambda *x: add_slopes(net, sums[y * WEIGHTS : (y + 1) * WEIGHTS], *x, sign))  # noqa: B023
        np.add.at(sums, 2 * WEIGHTS + 2 + score_bin(z[found > 0]), 1)

    got = summed(docs, text_col, 2 * WEIGHTS + 2 + BINS, add)
    return got[: 2 * WEIGHTS].reshape(2, -1), got[2 * WEIGHTS : 2 * WEIGHTS + 2], got[2 * WEIGHTS + 2 :]


def score_counts(docs: DataFrame, text_col: str, net: Network) -> np.ndarray:
    """How many candidates of all documents are in each bin of score: clean ones and findings of fold 0, findings of
    fold 1 and other findings."""

    def add(sums: np.ndarray, raw: np.ndarray, at: np.ndarray) -> None:
        of, start, end, found, h = examined(raw, at)
        if not len(of):
            return
        look = np.flatnonzero((found > 0) | (h % 5 == 0))
        of, start, end, found, fold = of[look], start[look], end[look], found[look], h[look] % 5
        if len(of):
            z = np.concatenate(in_parts(raw, at, of, start, end, net.logits))
            sums += np.bincount((found * (1 + np.minimum(fold, 2))) * BINS + score_bin(z), minlength=4 * BINS)

    return summed(docs, text_col, 4 * BINS, add).reshape(4, BINS)


def median_score(counts: np.ndarray) -> float:
    """The lower end of the bin that holds the middle of the counted scores."""
    return float(np.searchsorted(np.cumsum(counts), (counts.sum() + 1) // 2) - BINS // 2) / GRID


def learned_from_all(docs: DataFrame, id_col: str, text_col: str) -> Network | None:
    """The network after EPOCHS passes over every candidate that is learned from, each in PARTS steps of Adam by a hash of
    the documents, whose loss is a squared hinge with both labels of equal weight. None with under LEAST_ROWS of a
    label."""
    part = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(PARTS))
    net, cut = Network.untrained(), np.inf
    params = np.concatenate([net.kernel.ravel(), net.bias, net.out, [net.shift]])
    m, v = np.zeros(WEIGHTS), np.zeros(WEIGHTS)
    counts, bins = np.zeros((PARTS, 2)), np.zeros(BINS)
    for step in range(EPOCHS * PARTS):
        p = step % PARTS
        slopes, counts[p], now = step_sums(docs.where(part == p), text_col, net, cut)
        bins = bins / 2 + now  # mostly by the newest weights
        if step + 1 >= PARTS:
            if counts.sum(axis=0).min() < LEAST_ROWS:
                return None
            cut = median_score(bins)
        seen = counts[: step + 1].mean(axis=0)  # of a step; one part alone may hold no finding
        d = (slopes / UNIT / np.maximum(2 * seen, 1)[:, None]).sum(axis=0)
        m += 0.1 * (d - m)
        v += 0.01 * (d * d - v)
        params = params - RATE * (1 - step / (EPOCHS * PARTS)) * (m / (1 - 0.9 ** (step + 1))) / (np.sqrt(v / (1 - 0.99 ** (step + 1))) + 1e-4)
        kernel, bias, out, shift = np.split(params, np.cumsum([net.kernel.size, net.bias.size, net.out.size]))
        net = Network(kernel.reshape(net.kernel.shape), bias, out, float(shift[0]))
    return net


def calibrated(net: Network, counts: np.ndarray, recall: float = RECALL) -> Network:
    """The network with slope, offset and threshold by the counts of score_counts()."""
    lower = (np.arange(BINS) - BINS // 2) / GRID
    findings = next((c for c in (counts[2], counts[1]) if c.any()), counts[1:].sum(axis=0))
    # Platt's two parameters and targets, by Newton's steps
    clean, good = counts[0] * (lower < median_score(counts[1:].sum(axis=0))), counts[1] if counts[1].any() else findings
    n0, n1 = float(clean.sum()), float(good.sum())
    z, n, t = lower + 0.5 / GRID, clean + good, np.divide(good * (n1 + 1) / (n1 + 2) + clean / (n0 + 2), np.maximum(clean + good, 1))
    ab, loss = np.array([1.0, np.log((n1 + 1) / (n0 + 1))]), np.inf
    x = np.stack([z, np.ones(BINS)], 1)
    cost = lambda ab: float((n * (np.logaddexp(0, x @ ab) - t * (x @ ab))).sum())
    for _ in range(50):
        loss, q = cost(ab), 1 / (1 + np.exp(-np.clip(x @ ab, -30, 30)))
        move = np.linalg.solve((x * (n * q * (1 - q))[:, None]).T @ x + 1e-9 * np.eye(2), x.T @ (n * (q - t)))
        size = next((s for s in 0.5 ** np.arange(30) if cost(ab - s * move) < loss), 0)
        ab = ab - size * move
        if not size:
            break
    net.slope, net.offset = max(0.05, float(ab[0])), float(ab[1])
    # the highest lower end of a bin that keeps the recall
    above = np.cumsum(findings[::-1])[::-1]
    at = int(np.flatnonzero(above >= recall * findings.sum())[-1])
    net.threshold = 1 / (1 + np.exp(-np.clip(net.slope * lower[at] + net.offset, -30, 30))) if at else 0.0
    return net


def covered(raw: np.ndarray) -> np.ndarray:
    """Which bytes of a text lie in a pattern's finding."""
    text = raw.tobytes().decode()
    out = np.zeros(len(raw) + 1, bool)
    spans = patterns(text)
    if spans:
        byte = np.flatnonzero((raw & 0xC0) != 0x80)
        byte = np.append(byte, len(raw))
        for s, _, e in spans:
            out[byte[s] : byte[e]] = True
    return out


def worth_a_look(raw: np.ndarray, at: np.ndarray, of: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of consecutive texts with their runs: which the patterns may find something in, and which have a long run."""
    long = np.zeros(len(at) - 1, bool)
    long[of[end - start >= LONG_RUN]] = True
    marks = np.concatenate([[0], np.cumsum((raw == 58) | (raw == 61))])
    return long | (marks[at[1:]] > marks[at[:-1]]), long


def findings(raw: np.ndarray, at: np.ndarray, net: Network) -> list[list[tuple[int, int, int]]]:
    """For each of some consecutive texts its (start, kind, end), the patterns' and the network's."""
    of, start, end = runs(raw, at)
    look, long = worth_a_look(raw, at, of, start, end)
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(at) - 1)]
    for d in np.flatnonzero(look):
        out[d] = patterns(raw[at[d] : at[d + 1]].tobytes().decode(), bool(long[d]))
    if len(of) and net.threshold <= 1:
        good = np.flatnonzero(np.concatenate(in_parts(raw, at, of, start, end, net.scores)) >= net.threshold)
        for part in np.split(good, np.flatnonzero(np.diff(of[good])) + 1):
            if len(part):
                d = int(of[part[0]])
                points = np.cumsum((raw[at[d] : at[d + 1]] & 0xC0) != 0x80)
                p, q = points[start[part] - at[d]] - 1, points[end[part] - 1 - at[d]]
                new = apart(p, q, out[d])
                out[d] = sorted([*out[d], *((int(x), 3, int(y)) for x, y in zip(p[new], q[new]))])
    return out


def apart(p: np.ndarray, q: np.ndarray, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of the stretches from p to q overlap none of spans (start, kind, end)."""
    if not spans:
        return np.ones(len(p), bool)
    x, _, y = np.array(sorted(spans)).T
    before = np.searchsorted(x, q)  # spans that begin before q; the furthest end of these decides
    return (before == 0) | (np.maximum.accumulate(y)[before - 1] <= p)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Network:
    """The network by all documents; with under LEAST_ROWS candidates of a label to learn from it accepts nothing."""
    net = learned_from_all(docs, id_col, text_col)
    return calibrated(net, score_counts(docs, text_col, net)) if net else Network.untrained()


def _per_batch(b_text: pa.Array, net: Network) -> list[list[tuple[int, int, int]]]:
    raw, at = text_buffer(b_text)
    return [f for i, j in slices(at) for f in findings(raw[at[i] : at[j]], at[i : j + 1] - at[i], net)]


def scan(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, spans (array of kind, start, end in code points; by start, then kind).

    Null and empty texts have no spans; null ids stay null; repeated rows give a row each; other columns are
    not read; an empty table gives an empty result."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(id_col, text_col)

    def run(batches):
        for b in batches:
            spans = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in f] for f in _per_batch(b.column(1), net)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))], names=[id_col, "spans"])

    return rows.mapInArrow(run, f"{id_col} {rows.schema[0].dataType.simpleString()}, spans array<struct<kind:string,start:long,end:long>>")


def digest(spans: DataFrame) -> DataFrame:
    """Counts, the digest of the patterns' spans and all spans as text, of what scan() returns."""
    written = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("spans", lambda x: x["kind"] != "model")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    return spans.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS[:3]), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), count("model").alias("n_model"))


MASK = "[SECRET]"


def mask(docs: DataFrame, net: Network, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The documents with every finding in text_col replaced by MASK (overlapping ones by one), chars_col, if
    there, counted again for changed texts, and all other columns as they are. Null texts stay null."""
    bounded_batches(docs.sparkSession)
    schema = docs.schema
    t = docs.columns.index(text_col)
    c = docs.columns.index(chars_col) if chars_col in docs.columns else None

    def run(batches):
        for b in batches:
            found = _per_batch(b.column(t), net)
            cols = list(b.columns)
            if any(found):
                texts = b.column(t).to_pylist()
                counts = b.column(c).to_pylist() if c is not None else []
                for i in (i for i, f in enumerate(found) if f):
                    out, at = [], 0
                    for s, _, e in found[i]:
                        if s >= at:
                            out += [texts[i][at:s], MASK]
                        at = max(at, e)
                    texts[i] = "".join([*out, texts[i][at:]])
                    if c is not None:
                        counts[i] = len(texts[i])
                cols[t] = pa.array(texts, b.column(t).type)
                if c is not None:
                    cols[c] = pa.array(counts, b.column(c).type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return docs.mapInArrow(run, schema)
