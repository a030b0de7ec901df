"""Maximal periodic runs of words, and texts with their repetitions collapsed.

Words are runs without ASCII white space. A run is a stretch of words with smallest period q, of length at least
max(LEAST, POWER * q), that no neighbouring word extends keeping period q.

The runs of a text come from Lyndon arrays, after Ellert and Fischer, over the words as an ordered alphabet: only
comparisons of words, no suffix array and no hash of words or stretches. For an order of the words, and for its
reverse, the array gives for each place t the next place i whose suffix is smaller; the words from t to i are then
the longest Lyndon word at t, and every run has its roots among those of one of the two orders. The suffixes of t
and i are compared from left to right, and the extension matched furthest to the right is kept: a comparison within
it was made before, at a distance of the match, and its result is reused; only one that reaches the end of the
match goes on from there, and moves that end. So the words are looked at a linear number of times.

Before that, stretches without a long run are left out, by comparisons as well: within a run of period q all words
after the first q have their last occurrence at most q words before. For the periods from Q to 2 * Q - 1 such
stretches have at least (POWER - 1) * Q words; the runs lie within these and the 2 * Q - 1 words before them.

Each document is a task's own small work: linear in its words but for the sort that numbers them, and nothing is
shuffled. A very long text takes memory of some hundred bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.llm.common import bounded_batches

#: A run has at least this number of words, and this number of periods.
LEAST = 6
POWER = 4

Run = tuple[int, int, int]  # start, length, period


def ranks(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The rank of each word among the different words, and how far back it occurred last (0: never), by sorting."""
    n = len(words)
    at = sorted(range(n), key=words.__getitem__)  # stable: equal words stay in order
    order = np.array(at, np.int64)
    same = np.zeros(n, bool)
    same[1:] = [words[x] == words[y] for x, y in zip(at, at[1:])]
    rank, back = np.empty(n, np.int64), np.zeros(n, np.int64)
    rank[order] = np.cumsum(~same)
    back[order[1:]] = np.where(same[1:], np.diff(order), 0)
    return rank, back


def stretches(back: np.ndarray) -> list[tuple[int, int]]:
    """Stretches (begin, end), disjoint and in order, that hold all runs whole."""
    n = len(back)
    parts = []
    low = 1
    while POWER * low <= n:
        near = np.zeros(n + 2, np.int8)
        near[1:-1] = (back > 0) & (back < 2 * low)
        turn = np.diff(near)
        begin, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        long = end - begin >= max((POWER - 1) * low, LEAST - 2 * low + 1)
        parts.append(np.stack([np.maximum(begin[long] - 2 * low + 1, 0), end[long]], 1))
        low *= 2
    spans = np.concatenate(parts) if parts else np.zeros((0, 2), np.int64)
    out: list[tuple[int, int]] = []
    for a, b in spans[np.argsort(spans[:, 0])].tolist():
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def long_roots(s: list[int]) -> Iterator[Run]:
    """(t, p, e): the Lyndon words s[t : t + p], longest at their place, that equal what follows for e > 2 * p."""
    n = len(s)
    following, ahead = [n] * n, [0] * n  # the next smaller suffix, and how far it is equal
    before, behind = [-1] * n, [0] * n  # the previous smaller suffix, and how far it is equal
    begin = shift = end = 0  # the match furthest to the right: s[begin:end] equals what is `shift` words earlier
    for i in range(1, n):
        t = i - 1
        e, exact = 0, False  # the suffixes of t and i are equal for e words, or for exactly e
        while t >= 0:
            if not exact and i + e < n and s[t + e] == s[i + e]:
                x, y = t - shift, i - shift
                k = -1
                if t >= begin and i < end:  # x and y were compared, and what follows them is the same up to `end`
                    k = ahead[x] if following[x] == y else behind[y] if before[y] == x else -1
                if 0 <= k < end - i:
                    e = k
                else:
                    if k >= 0:
                        e = end - i
                    while i + e < n and s[t + e] == s[i + e]:
                        e += 1
                    if i + e > end:
                        begin, shift, end = i, i - t, i + e
            if i + e < n and s[t + e] < s[i + e]:
                break
            following[t], ahead[t] = i, e  # the suffix of i is smaller
            if e > 2 * (i - t):
                yield t, i - t, e
            # the suffix of the next t equals that of this one for behind[t] words, then is smaller
            exact = e != behind[t]
            e, t = min(e, behind[t]), before[t]
        before[i], behind[i] = t, e


def runs(words: list[bytes]) -> list[Run]:
    """All runs (start, length, period) of the words, by start, then period."""
    found: set[Run] = set()
    if len(words) < LEAST:
        return []
    rank, back = ranks(words)
    for a, b in stretches(back):
        part = rank[a:b].tolist()
        for s in (part, [-x for x in part]):
            for t, p, e in long_roots(s):
                left = 0
                while left < p and t - left > 0 and s[t - left - 1] == s[t - left - 1 + p]:
                    left += 1
                if left < p and left + p + e >= max(LEAST, POWER * p):  # else an earlier root is the run's first
                    found.add((a + t - left, left + p + e, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], found: list[Run]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not found:
        return words
    cover = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        cover[start + period] += 1
        cover[start + length] -= 1
    return [w for w, c in zip(words, np.cumsum(cover).tolist()) if not c]


def recurring(words: list[bytes], id_: int | None) -> list[bytes]:
    """The words, with the tail of every tenth document, by its id's CRC-32, made periodic."""
    n = len(words)
    if id_ is None or not n:
        return words
    h = crc32(str(id_).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * ((n - a) // p + 1))[: n - a]


def _strongest(found: list[Run]) -> tuple[int | None, ...]:
    if not found:
        return (None,) * 4
    start, length, period = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]))
    return start, length, period, 1000 * length // period


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", planted: bool = False) -> DataFrame:
    """Per row: id, n_runs, start, length, period and exponent_milli of the run of greatest length / period (ties:
    smallest start, then period; no run: nulls), runs (all, as structs), collapsed (the kept words, one space apart).

    planted: repeat words first as recurring() does. A null or empty text has no words and no run; a null id
    stays null, and its text is left as it is. Rows are judged each by itself, so repeated rows give repeated
    results; a very long text is one row's work, linear in its words. Other columns are not read. An empty table gives an empty result."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            cols: list[list] = [[] for _ in range(8)]
            for id_, text in zip(b.column(0), b.column(1)):
                key = id_.as_py()
                words = text.as_buffer().to_pybytes().split() if text.is_valid else []
                if planted:
                    words = recurring(words, key)
                found = runs(words)
                row = (key, len(found), *_strongest(found), [{"start": s, "length": n, "period": p} for s, n, p in found], b" ".join(collapsed(words, found)))
                for c, v in zip(cols, row):
                    c.append(v)
            one = pa.struct([(x, pa.int64()) for x in ("start", "length", "period")])
            types = [pa.int64()] * 6 + [pa.list_(one), pa.binary()]
            arrays = [pa.array(c, t) for c, t in zip(cols, types)]
            arrays[7] = arrays[7].cast(pa.string())
            yield pa.RecordBatch.from_arrays(arrays, names=[id_col, "n_runs", "start", "length", "period", "exponent_milli", "runs", "collapsed"])

    schema = f"{id_col} long, n_runs long, start long, length long, period long, exponent_milli long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col)).mapInArrow(run, schema)


def digest(found: DataFrame) -> DataFrame:
    """find_runs() with runs and collapsed as SHA-256: each run as `start,length,period` and a line feed."""
    line = lambda r: F.concat_ws(",", *(r[x].cast("string") for x in ("start", "length", "period")))
    text = F.concat_ws("", F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))))
    return found.withColumns({"runs_sha256": F.sha2(text, 256), "collapsed_sha256": F.sha2("collapsed", 256)}).drop("runs", "collapsed")
