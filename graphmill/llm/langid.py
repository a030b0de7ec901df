"""Language identification by error-correcting output codes.

Each language has a codeword of bits. One binary logistic classifier per bit over hashed byte n-grams
predicts it; decoding takes the language whose codeword has the least loss, each bit weighted by how well
its classifier does on held-out training rows, and flags documents whose two nearest codewords are close.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.llm.common import bounded_batches, slices, smallest_hashes, text_buffer

#: Labelled documents that training takes, those of the smallest hash: of each language, and of all together.
#: All languages are learned; of very many, each has fewer documents, LEAST_DOCS at least.
TRAIN_DOCS = 1200
TRAIN_TOTAL = 40_000
LEAST_DOCS = 20
BITS = 13
DIM = 1 << BITS
ORDERS = (1, 2, 3)
#: A document is ambiguous if the best language's share is below this.
AMBIGUOUS = 0.5
UND = "und"

_FOLD = np.full(256, 32, np.uint8)
for _c in "abcdefghijklmnopqrstuvwxyz":
    _FOLD[ord(_c)] = _FOLD[ord(_c) - 32] = ord(_c)
_FOLD[128:] = np.arange(128, 256)


def features(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row per text of n-gram counts, square roots at length one. Letters are lower-cased (ASCII and
    Latin-1), other ASCII characters become one space."""
    n = len(at) - 1
    out = np.zeros((n, DIM), np.float32)
    if not len(raw):
        return out
    text = _FOLD[raw]
    upper = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
    text[1:][upper] += 0x20
    keep = np.ones(len(raw), bool)
    keep[1:] = (text[1:] != 32) | (text[:-1] != 32)
    place = np.flatnonzero(keep)
    text, of = text[place].astype(np.uint32), np.searchsorted(place, at)
    for order in ORDERS:
        if len(text) < order:
            continue
        code = text[: len(text) - order + 1].copy()
        for k in range(1, order):
            code = (code << np.uint32(8)) | text[k : len(text) - order + 1 + k]
        slot = ((code + np.uint32(order * 0x3C6EF35F)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
        slot = slot.astype(np.int64)
        for i in range(n):
            own = slot[of[i] : max(of[i], of[i + 1] - order + 1)]
            if len(own):
                out[i] += np.bincount(own, minlength=DIM)
    np.sqrt(out, out=out)
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
    return out


def codewords(n: int) -> np.ndarray:
    """A row of -1 and 1 per class. Up to seven classes have the exhaustive code of 2 ** (n - 1) - 1 bits;
    more have the code of 15 bits per doubling whose nearest rows lie farthest apart of 200 drawn."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 7:
        bits = [[1 if i == 0 else (-1 if (b >> (i - 1)) & 1 else 1) for i in range(n)] for b in range(1, 1 << (n - 1))]
        return np.array(bits, float).T
    rng, size = np.random.default_rng(11), 15 * int(np.ceil(np.log2(n)))
    best, far = None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, size))
        near = ((size - code @ code.T) / 2 + np.eye(n) * size).min()
        if near > far and (np.abs(code.sum(axis=0)) < n).all():
            best, far = code, near
    return best


@dataclass
class Sparse:
    """Rows of features by their places and values; only those asked for are spread out."""

    slots: list[np.ndarray]
    values: list[np.ndarray]

    def __len__(self) -> int:
        return len(self.slots)

    def __getitem__(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), DIM), np.float32)
        for k, r in enumerate(rows):
            out[k, self.slots[r]] = self.values[r]
        return out


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray  # languages, bits
    weight: np.ndarray  # DIM, bits
    bias: np.ndarray
    trust: np.ndarray  # of each bit

    @classmethod
    def train(cls, x: np.ndarray | Sparse, lang: list[str], epochs: int = 30) -> Model:
        langs = sorted(set(lang))
        code = codewords(len(langs))
        place = {v: k for k, v in enumerate(langs)}
        y = code[[place[v] for v in lang]] if lang else np.zeros((0, code.shape[1] if len(code) else 1))
        bits = y.shape[1]
        w, b = np.zeros((DIM, bits), np.float32), np.zeros(bits, np.float32)
        trust = np.ones(bits)
        if len(langs) > 1:
            number = {v: 0 for v in langs}
            held = np.zeros(len(x), bool)  # every fifth row of each language
            for k, v in enumerate(lang):
                number[v] += 1
                held[k] = number[v] % 5 == 0
            rng = np.random.default_rng(3)
            gw, gb = np.full_like(w, 1e-6), np.full_like(b, 1e-6)
            rows = np.flatnonzero(~held)
            size = np.array([number[v] for v in langs])
            share = (len(lang) / len(langs) / size)[[place[v] for v in lang]]  # languages count alike
            for _ in range(epochs):
                for r in np.array_split(rng.permutation(rows), max(1, len(rows) // 128)):
                    own = x[r]
                    z = own @ w + b
                    g = (-y[r] / (1 + np.exp(np.clip(y[r] * z, -30, 30))) * share[r, None]).astype(np.float32)
                    dw, db = own.T @ g / len(r) + 1e-6 * w, g.mean(axis=0)
                    gw += dw * dw
                    gb += db * db
                    w -= 0.5 * dw / np.sqrt(gw)
                    b -= 0.5 * db / np.sqrt(gb)
            parts = [p for p in np.array_split(np.flatnonzero(held), held.sum() // 1024 + 1) if len(p)]
            if parts:
                right = np.concatenate([(x[p] @ w + b) * y[p] > 0 for p in parts]).mean(axis=0)
                trust = np.clip(2 * right - 1, 0.05, 1)
        return cls(langs, code, w, b, trust / trust.sum())

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best language (its place) and score from 0 to 1 of each row: its share among all by loss."""
        z = x @ self.weight + self.bias
        loss = np.log1p(np.exp(np.clip(-z[:, None, :] * self.code[None], -30, 30))) @ self.trust
        loss *= self.code.shape[1]
        e = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
        p = e / e.sum(axis=1, keepdims=True)
        best = loss.argmin(axis=1)
        return best, p[np.arange(len(p)), best]


def has_letter(raw: np.ndarray) -> bool:
    lower = raw | 0x20
    if ((lower >= 97) & (lower <= 122) & (raw < 128)).any():
        return True
    return bool((raw >= 128).any()) and any(c.isalpha() for c in raw.tobytes().decode())


def judged(model: Model, col: pa.Array) -> tuple[list[str], list[float], list[bool]]:
    """Language, score and ambiguity of each text of a column."""
    raw, at = text_buffer(col)
    langs, scores, vague = [], [], []
    for i, j in slices(at):
        for k in range(i, j, 256):
            m = min(k + 256, j)
            own, off = raw[at[k] : at[m]], at[k : m + 1] - at[k]
            if model.langs:
                best, share = model.predict(features(own, off))
            for r in range(m - k):
                known = bool(model.langs) and has_letter(own[off[r] : off[r + 1]])
                langs.append(model.langs[best[r]] if known else UND)
                scores.append(float(share[r]) if known else 0.0)
                vague.append(not known or float(share[r]) < AMBIGUOUS)
    return langs, scores, vague


def held_out(id_col: str = "doc_id"):
    """Documents that are never learned from: crc32 of the id as text leaves 1 when divided by 3. A null id
    is not held out, nor learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def per_language(langs: int, most: int = TRAIN_DOCS) -> int:
    """Documents that each of so many languages may teach."""
    return max(LEAST_DOCS, min(most, TRAIN_TOTAL // max(1, langs)))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = TRAIN_DOCS) -> Model:
    """Learn from labelled documents that are not held out: of each language the per_language() ones with the
    smallest hash of the id, however many there are. Labels without a drawn document would be an error."""
    bounded_batches(docs.sparkSession)
    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & ~held_out(id_col))
    rows = rows.select(F.col(id_col).alias("i"), F.col(text_col).alias("text"), F.col(lang_col).alias("l"), F.xxhash64(id_col).bitwiseAND(F.lit((1 << 63) - 1)).alias("h"))
    size = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not size:
        return Model.train(np.zeros((0, DIM), np.float32), [])
    most = per_language(len(size), most)
    # the sketch's count may be a tenth too high, so the bound is drawn for fewer rows than it says
    bounds = docs.sparkSession.createDataFrame([(v, smallest_hashes(n * 0.8, most)) for v, n in size.items()], "l string, bound long")

    def run(batches):
        for b in batches:
            raw, at = text_buffer(b.column(1))
            for i, j in slices(at):
                for k in range(i, j, 256):
                    m = min(k + 256, j)
                    x = features(raw[at[k] : at[m]], at[k : m + 1] - at[k])
                    own = [np.flatnonzero(v).astype(np.uint16) for v in x]
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).slice(k, m - k), pa.array([o.tobytes() for o in own], pa.binary()), pa.array([v[o].astype(np.float16).tobytes() for v, o in zip(x, own)], pa.binary()), b.column(2).slice(k, m - k)],
                        names=["h", "slots", "values", "l"],
                    )

    low = rows.join(F.broadcast(bounds), "l").where("h <= bound").select("h", "text", "l")
    got = low.mapInArrow(run, "h long, slots binary, values binary, l string").distinct().toPandas()
    got = got.sort_values(["l", "h", "slots"]).groupby("l", sort=True).head(most)
    if set(got["l"]) != set(size):
        raise RuntimeError(f"no labelled document was drawn for {set(size) - set(got['l'])}")
    got = got.sort_values(["h", "l", "slots"])
    x = Sparse([np.frombuffer(bytes(v), np.uint16) for v in got["slots"]], [np.frombuffer(bytes(v), np.float16) for v in got["values"]])
    return Model.train(x, got["l"].tolist())


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, lang_pred, score, ambiguous. Texts that are null or without a letter are `und`
    with score 0; without any labelled document all are. Of languages of equal loss the first by name is
    taken, and the score shows the tie. Whole texts are judged, whatever their length. Repeated rows give a row
    each; null ids stay null; an empty table gives an empty result; no other column is read."""
    spark = docs.sparkSession
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast(model)
    rows = docs.select(id_col, held_out(id_col).alias("held_out"), text_col)

    def run(batches):
        for b in batches:
            langs, scores, vague = judged(sent.value, b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(vague, pa.bool_())], names=[id_col, "held_out", "lang_pred", "score", "ambiguous"])

    return rows.mapInArrow(run, f"{id_col} {rows.schema[0].dataType.simpleString()}, held_out boolean, lang_pred string, score double, ambiguous boolean")


def known_language(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The documents whose language is found, with all their columns: those that are neither `und` nor
    flagged as ambiguous. A model of no language can't tell, and all texts with a letter stay."""
    spark = docs.sparkSession
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast(model)
    t = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            langs, _, vague = judged(sent.value, b.column(t))
            if sent.value.langs:
                keep = [v != UND and not x for v, x in zip(langs, vague)]
            else:
                raw, at = text_buffer(b.column(t))
                keep = [has_letter(raw[at[k] : at[k + 1]]) for k in range(b.num_rows)]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
