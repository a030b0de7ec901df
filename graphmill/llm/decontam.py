"""Benchmark decontamination by q-gram filtering and banded alignment.

Texts are normalised over code points: letters are lower-cased, and each run of characters that are no letters,
digits or marks becomes one space. A benchmark item is found where a window of WINDOW or of PASSAGE characters
of it, beginning at any of its characters (an item that is shorter: the whole item), has a stretch of the text
within EDITS. So every quote of PASSAGE characters is found, wherever it begins. By the q-gram lemma a stretch
within k edits of a window of m characters shares m - q + 1 - k * q of its q-grams, all on diagonals at most k
apart.

1. A bitmap over hashed q-grams marks where a document holds any benchmark q-gram, and a sliding count drops
   all stretches in which no window can reach its bound.
2. What is left is looked up in the postings of the items' q-grams (one for each character of an item); hits
   are sorted by bands of diagonals, each 2 * (k + 1) wide and half overlapping with the next, so that the
   diagonals of a match always lie in one band together. Windows in which a band has the bound's number of
   distinct q-grams are retained.
3. A window all of whose q-grams lie on one diagonal is an exact match. Where an item has none, its retained
   windows are verified by alignment in the band, end gaps of the document free.
"""

from __future__ import annotations

from functools import lru_cache
from unicodedata import category

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.llm.common import bounded_batches, slices, stored, text_buffer

Q = 8
WINDOW = 96
#: Shorter windows for quotes of a part of an item; they have their own, smaller number of edits.
PASSAGE = 64
#: Edits allowed in a window, as a share of its characters.
EDITS = 0.09
#: Items of fewer normalised characters are no evidence inside a text: they are found as a whole text only.
LEAST = 24
#: Characters of benchmark text in one index; larger benchmarks are worked in several passes over the documents.
INDEX_CHARS = 1 << 21
BITS = 22
#: Postings that are counted, and windows that are aligned, at a time, about.
POSTINGS = 1_000_000
ALIGNED = 2048
#: Of a run of retained windows every so many are aligned first.
STRIDE = 8
U64 = np.uint64
MULT = U64(0x9E3779B97F4A7C15)


@lru_cache(1)
def _folding() -> tuple[np.ndarray, np.ndarray]:
    """For every code point the one that stands for it, and whether it is part of a word."""
    every = [chr(c) for c in range(0x110000)]
    fold = np.array([ord(x) if len(x := c.lower()) == 1 else ord(c) for c in every], np.uint32)
    return fold, np.array([c.isalnum() or category(c)[0] == "M" for c in every], bool)


def points(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of consecutive UTF-8 texts, and their offsets (n + 1)."""
    sofar = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32), sofar[at]


def normalised(text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised code points of consecutive texts, their offsets (n + 1), and each one's place in text."""
    fold, word = _folding()
    space = ~word[text]
    keep = ~space
    keep[1:] |= ~space[:-1]  # the first space of a run
    edge = at[:-1][at[:-1] < len(text)]
    keep[edge] = ~space[edge]  # none at a text's start
    place = np.flatnonzero(keep)
    return np.where(space[place], np.uint32(32), fold[text[place]]), np.searchsorted(place, at), place


def gram_codes(text: np.ndarray) -> np.ndarray:
    """Hashes of the Q-grams at each code point; the last Q - 1 have none."""
    n = len(text) - Q + 1
    if n <= 0:
        return np.zeros(0, U64)
    code = (text.astype(U64) + U64(1)) * MULT
    size, power = 1, int(MULT)
    while size < Q:  # 1, 2, 4, 8 side by side
        code = code[:-size] * U64(power) + code[size:]
        size, power = size * 2, power * power % (1 << 64)
    return code ^ (code >> U64(29))


def slots(codes: np.ndarray, bits: int = BITS) -> np.ndarray:
    return ((codes * MULT) >> U64(64 - bits)).astype(np.int64)


def plain(text: str) -> np.ndarray:
    """One text normalised, without a space at its end."""
    own = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    own = normalised(own, np.array([0, len(own)]))[0] if len(own) else own
    return own[:-1] if len(own) and own[-1] == 32 else own


class Index:
    """Some benchmark items and the postings of their q-grams."""

    def __init__(self, items: list[tuple[int, str]]):
        self.short: dict[bytes, list[int]] = {}
        self.item: list[int] = []
        texts: list[np.ndarray] = []
        for item, text in items:
            own = plain(text or "")
            if len(own) >= LEAST:
                self.item.append(item)
                texts.append(own)
            elif len(own):
                self.short.setdefault(own.tobytes(), []).append(item)
        self.size = np.array([len(t) for t in texts], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.text = np.concatenate(texts) if texts else np.zeros(0, np.uint32)
        codes = [gram_codes(t) for t in texts]
        flat = np.concatenate(codes) if codes else np.zeros(0, U64)
        order = np.argsort(flat, kind="stable")
        self.codes = flat[order]
        self.of = np.repeat(np.arange(len(codes), dtype=np.int32), [len(c) for c in codes])[order]
        self.place = (np.concatenate([np.arange(len(c), dtype=np.int32) for c in codes]) if codes else np.zeros(0, np.int32))[order]
        self.bitmap = np.zeros(1 << BITS, bool)
        self.bitmap[slots(self.codes)] = True
        #: Window size, edits and bound of each item, for long and for short windows.
        self.rules = []
        for size in (WINDOW, PASSAGE):
            m = np.minimum(self.size, size)
            k = np.floor(m * EDITS).astype(np.int64)
            self.rules.append((m, k, m - Q + 1 - k * Q))
        self.widest = int(max(((m + k).max() for m, k, _ in self.rules), default=0)) if texts else 0
        self.least = int(min((b.min() for *_, b in self.rules), default=0)) if texts else 0

    def matches(self, text: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
        """(text, item's number, first, end, edits, windows) of all items found in consecutive normalised texts:
        of the windows compared those of fewest edits, from the first to the last."""
        if not len(self.item) or len(text) < Q:
            return []
        codes = gram_codes(text)
        hit = self.bitmap[slots(codes)]
        for k in range(1, Q):  # grams that reach into the next text
            e = at[1:-1] - k
            hit[e[(e >= 0) & (e < len(hit))]] = False
        total = np.concatenate([[0], np.cumsum(hit, dtype=np.int32)])
        n, span = len(hit), self.widest
        lo = np.arange(n)
        dense = (total[np.minimum(lo + span, n)] - total[:-1]) >= self.least
        if not dense.any():
            return []
        cover = np.zeros(n + 1, np.int32)
        first = np.flatnonzero(dense)
        cover[first] += 1
        cover[first[first + span < n] + span] -= 1
        spots = np.flatnonzero(hit & (np.cumsum(cover)[:n] > 0))
        lo, hi = np.searchsorted(self.codes, codes[spots], "left"), np.searchsorted(self.codes, codes[spots], "right")
        count = hi - lo
        spots, lo, count = spots[count > 0], lo[count > 0], count[count > 0]
        best: dict[tuple[int, int], list[int]] = {}
        for part in np.split(np.arange(len(spots)), self._cuts(spots, count)):
            for d, i, s, e, c, w in self._found(text, at, spots[part], lo[part], count[part]):
                old = best.get((d, i))
                if old is None or c < old[2]:
                    best[d, i] = [s, e, c, w]
                elif c == old[2]:
                    best[d, i] = [min(s, old[0]), max(e, old[1]), c, w + old[3]]
        return [(d, i, *best[d, i]) for d, i in sorted(best)]

    def _cuts(self, spots: np.ndarray, count: np.ndarray) -> list[int]:
        """Places between hits that no match reaches over, where over POSTINGS postings have come together."""
        done = np.cumsum(count)
        cuts, last = [], 0
        if len(done) and done[-1] > POSTINGS:
            for g in np.flatnonzero(np.diff(spots) > self.widest) + 1:
                if done[g - 1] - last > POSTINGS:
                    cuts.append(int(g))
                    last = done[g - 1]
        return cuts

    def _found(self, text, at, spots, lo, count):
        if not len(spots):
            return []
        pos = np.repeat(spots, count)
        post = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(len(pos))
        item, place = self.of[post].astype(np.int64), self.place[post].astype(np.int64)
        doc = np.searchsorted(at, pos, "right") - 1
        # a pair of text and item with too few hits for any window is left out first
        key = (doc - doc[0]) * len(self.item) + item
        if (doc[-1] - doc[0] + 1) * len(self.item) <= 8 * POSTINGS:
            hits = np.bincount(key)
            pair_key = np.flatnonzero(hits)
            hits = hits[pair_key]
            number = np.zeros(int(pair_key[-1]) + 1, np.int64)
            number[pair_key] = np.arange(len(pair_key))
            pair = number[key]
        else:
            pair_key, pair, hits = np.unique(key, return_inverse=True, return_counts=True)
        enough = (hits >= np.minimum(self.rules[0][2], self.rules[1][2])[pair_key % len(self.item)])[pair]
        pair, item, place, pos = pair[enough], item[enough], place[enough], pos[enough]
        pair_key = pair_key + int(doc[0]) * len(self.item)
        if not len(pair):
            return []
        diag = pos - place
        out, exact = [], np.zeros(len(pair_key), bool)
        for m, *_ in self.rules:
            for p, a, d in self._exact(pair, diag, place, m[item]):
                exact[p] = True
                i = int(pair_key[p] % len(self.item))
                out.append((int(pair_key[p] // len(self.item)), i, a + d, a + d + int(m[i]), 0, 1))
        rest = ~exact[pair]
        if rest.any():
            out += self._aligned(text, at, pair_key, pair[rest], item[rest], diag[rest], place[rest])
        return out

    @staticmethod
    def _exact(pair, diag, place, m) -> list[tuple[int, int, int]]:
        """(pair, first place, diagonal) of windows whose q-grams all lie on the diagonal: of each run of them
        the first and the last window."""
        order = np.lexsort((place, diag, pair))
        p, d, s, m = pair[order], diag[order], place[order], m[order]
        new = np.concatenate([[True], (p[1:] != p[:-1]) | (d[1:] != d[:-1]) | (s[1:] != s[:-1] + 1)])
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, len(p)))
        good = size >= m[head] - Q + 1
        head, size = head[good], size[good]
        last = s[head] + size - (m[head] - Q + 1)
        return [(int(p[h]), int(a), int(d[h])) for h, z in zip(head, last) for a in sorted({int(s[h]), int(z)})]

    def _aligned(self, text, at, pair_key, pair, item, diag, place):
        """Retained windows of pairs without an exact match, verified by alignment."""
        want: list[tuple] = []
        for rule, (m, k, bound) in enumerate(self.rules):
            if rule and not (m != self.rules[0][0])[item].any():
                continue
            for shift in (0, 1):
                half = k[item] + 1
                band = (diag + shift * half) // (2 * half)
                floor = int(band.min())
                wide = int(band.max()) - floor + 1
                group, of, hits = np.unique(pair * wide + band - floor, return_inverse=True, return_counts=True)
                many = (hits >= bound[pair_key[group // wide] % len(self.item)])[of]
                far = int(self.size.max()) + WINDOW
                key = np.unique(of[many] * far + place[many])  # a q-gram of the item counts once
                if not len(key):
                    continue
                g, s = key // far, key % far
                i = (pair_key[group[g] // wide] % len(self.item)).astype(np.int64)
                last = np.arange(len(key)) + bound[i] - 1
                fits = last < len(key)
                fits[fits] = (g[last[fits]] == g[fits]) & (s[last[fits]] - s[fits] <= (m[i] - Q)[fits])
                f = np.flatnonzero(fits)
                low = np.maximum(s[last[f]] - (m[i[f]] - Q), 0)
                high = np.minimum(s[f], self.size[i[f]] - m[i[f]])
                f, low, high = f[low <= high], low[low <= high], high[low <= high]
                if not len(f):
                    continue
                size = high - low + 1
                a = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                window = np.unique(np.repeat(g[f], size) * far + a)  # windows of the group, each once
                g, a = window // far, window % far
                first = np.concatenate([[True], (g[1:] != g[:-1]) | (a[1:] != a[:-1] + 1)])
                p, b = group[g] // wide, group[g] % wide + floor
                i = (pair_key[p] % len(self.item)).astype(np.int64)
                origin = b * 2 * (k[i] + 1) - shift * (k[i] + 1)
                ahead = first | np.append(first[1:], True) | (a % STRIDE == 0)
                want.append((p, i, a, origin, m[i], k[i], ahead))
        if not want:
            return []
        p, i, a, origin, m, k, ahead = (np.concatenate(c) for c in zip(*want))
        out: list[tuple] = []
        done = np.zeros(len(pair_key), bool)
        for now in (ahead, ~ahead):  # the others only where the first found nothing
            now = np.flatnonzero(now & ~done[p])
            for size in np.unique(m[now]):
                own = now[m[now] == size]
                for r in range(0, len(own), ALIGNED):
                    part = own[r : r + ALIGNED]
                    for n, s, e, c in self._verify(text, at, pair_key[p[part]] // len(self.item), i[part], a[part], origin[part], int(size), int(k[part[0]])):
                        done[p[part[n]]] = True
                        out.append((int(pair_key[p[part[n]]] // len(self.item)), int(i[part[n]]), s, e, c, 1))
        return out

    def _verify(self, text, at, doc, item, a, origin, m, k):
        width = 2 * (k + 1) + 2 * k  # the band, and k to either side for paths that leave it
        start = origin + a - k
        place = start[:, None] + np.arange(m + width)[None, :]
        inside = (place >= at[doc][:, None]) & (place < at[doc + 1][:, None])
        segment = np.where(inside, text[np.clip(place, 0, len(text) - 1)], 0)
        windows = self.text[(self.begin[item] + a)[:, None] + np.arange(m)[None, :]]
        cost, first, last = align(windows, segment, width)
        for n in np.flatnonzero(cost <= k):
            d = int(doc[n])
            yield int(n), max(int(start[n] + first[n]), int(at[d])), min(int(start[n] + last[n]), int(at[d + 1])), int(cost[n])


def align(windows: np.ndarray, segments: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least edits of each window within its segment along diagonals 0 to width, with the match's first and
    end byte in the segment. Row by row over all pairs at once; cell j of row i is diagonal j."""
    n, m = windows.shape
    big = np.int32(1 << 14)
    j = np.arange(width + 1, dtype=np.int32)
    scale = np.int32(1 << 12)  # the start diagonal rides along below the cost
    cell = np.broadcast_to(j, (n, width + 1)).astype(np.int32).copy()  # cost 0, start j
    for i in range(m):
        step = cell + (segments[:, i : i + width + 1] != windows[:, i : i + 1]) * scale
        up = np.full_like(cell, scale * big)
        up[:, :-1] = cell[:, 1:] + scale  # a byte of the window left out: one diagonal less
        best = np.minimum(step, up)
        # a byte of the document left out: one diagonal more
        lifted = best - j * scale
        cell = np.minimum.accumulate(lifted, axis=1) + j * scale
    at = cell.argmin(axis=1)
    value = cell[np.arange(n), at]
    return value // scale, value % scale, at + m


def blocks(benchmark: DataFrame, id_col: str, text_col: str):
    """Indexes of the benchmark, each of INDEX_CHARS at most or one item, read one after another, and whether
    another one follows."""
    own: list[tuple[int, str]] = []
    size = 0
    for r in benchmark.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long"), text_col).distinct().orderBy(id_col, text_col).toLocalIterator():
        if own and size + len(r[1]) > INDEX_CHARS:
            yield Index(own), True
            own, size = [], 0
        own.append((r[0], r[1]))
        size += len(r[1])
    yield Index(own), False


def _scan(batch_text: pa.Array, index: Index):
    """Matches of a column of texts: (row, item, first code point, end, edits, windows) by row and item."""
    raw, at = text_buffer(batch_text)
    for i, j in slices(at):
        if at[j] == at[i]:
            continue
        text, off = points(raw[at[i] : at[j]], at[i : j + 1] - at[i])
        plain_text, of, place = normalised(text, off)
        got = [(d, index.item[n], int(place[s]) - int(off[d]), int(place[e - 1]) + 1 - int(off[d]), c, w) for d, n, s, e, c, w in index.matches(plain_text, of)]
        if index.short:
            for d in np.flatnonzero((np.diff(of) <= LEAST) & (np.diff(of) > 0)):
                own = plain_text[of[d] : of[d + 1]]
                own = own[:-1] if own[-1] == 32 else own
                for item in index.short.get(own.tobytes(), ()):
                    got.append((int(d), item, int(place[of[d]]) - int(off[d]), int(place[of[d] + len(own) - 1]) + 1 - int(off[d]), 0, 1))
        for d, *m in sorted(got):
            yield (i + d, *m)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document row and benchmark item found in it: id, item_id, edits (of the best window that was
    compared), start and end (code points, from the first to the last such window), windows (such ones).

    Null and empty texts match nothing; texts of any length are searched as a whole; an item of under LEAST
    normalised characters is found where it is the whole text, an empty one nowhere; repeated rows give a row
    each; equal items with different ids each match; null ids stay null; an empty table or benchmark gives no
    row; other columns are not read. A benchmark of several indexes is worked in as many jobs."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(id_col, text_col)
    schema = f"{id_col} {rows.schema[0].dataType.simpleString()}, item_id long, start long, end long, edits int, windows int"
    out = None
    for index, more in blocks(benchmark, item_col, item_text):
        sent = spark.sparkContext.broadcast(index)

        def run(batches, sent=sent):
            for b in batches:
                got = list(_scan(b.column(1), sent.value))
                if got:
                    r, *cols = zip(*got)
                    types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(r)), *(pa.array(c, t) for c, t in zip(cols, types))], names=[id_col, "item_id", "start", "end", "edits", "windows"])

        part = rows.mapInArrow(run, schema)
        if more:  # one index at a time stays in the workers' memory
            part = stored(part)
            sent.destroy()
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents in which no benchmark item is found, with all their columns."""
    spark = docs.sparkSession
    bounded_batches(spark)
    for index, more in blocks(benchmark, item_col, item_text):
        sent = spark.sparkContext.broadcast(index)
        t = docs.columns.index(text_col)

        def run(batches, sent=sent, t=t):
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                keep[[r for r, *_ in _scan(b.column(t), sent.value)]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
        if more:
            docs = stored(docs)
            sent.destroy()
    return docs
