"""BPE encoding and decoding with contiguous rank arrays.

A text is cut into words by the vocabulary's pattern. A short word holds the ids of its parts and the
ranks of adjacent pairs in flat arrays: the smallest rank is searched, the boundary under it deleted and
the two neighbouring ranks refreshed, until no pair can merge. The arrays of all words of a batch that
are not known yet lie below one another, so that each step is one numpy operation over all of them.
Words over LONG_WORD bytes (white space, unbroken symbols) take a heap over linked parts instead, with
the same merges in the same order, so that a long text without spaces stays n log n.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from graphmill.llm.common import bounded_batches, rows_text

NONE = np.iinfo(np.int32).max
LONG_WORD = 128
#: Words and chunks kept with their ids by a worker; a table is emptied when full.
CACHE_WORDS = 200_000
CACHE_CHUNKS = 400_000
CACHE_CHARS = 48
BLOCK_CHARS = 1 << 22

# fixed values: the split pattern of byte-level BPE vocabularies, with Unicode white space written out
SPACE = r"\t-\r\x20\x85\xa0  -     　"
PATTERN = (
    rf"'s|'t|'re|'ve|'m|'ll|'d|\x20?\p{{L}}+|\x20?\p{{N}}+|\x20?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)


#: Whether white space of two characters or more may occur.
two_spaces = re.compile(r"\s\s").search


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in byte-level vocabularies: printable ones stand for
    themselves, the others take code points from 256 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class PairRanks:
    """Rank of a pair of ids for arrays of pairs: a cuckoo table with two places for each key."""

    BITS = 18

    def __init__(self, rank: dict[tuple[int, int], int]):
        keys = np.array([a << 32 | b for a, b in rank], np.uint64)
        ranks = np.fromiter(rank.values(), np.int32, len(rank))
        rng = np.random.default_rng(0)
        while not self._build(keys, ranks, rng.integers(0, 2**63, 2, np.uint64) * np.uint64(2) + np.uint64(1)):
            pass

    def _slots(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shift = np.uint64(64 - self.BITS)
        return keys * self.mult[0] >> shift, keys * self.mult[1] >> shift

    def _build(self, keys: np.ndarray, ranks: np.ndarray, mult: np.ndarray) -> bool:
        self.mult = mult
        self.keys = np.full((2, 1 << self.BITS), np.iinfo(np.uint64).max, np.uint64)
        self.ranks = np.full((2, 1 << self.BITS), NONE, np.int32)
        slots = np.stack(self._slots(keys)).tolist()
        at: list[dict[int, int]] = [{}, {}]
        for k in range(len(keys)):
            side = 0
            for _ in range(200):
                slot = slots[side][k]
                k, at[side][slot] = at[side].get(slot, -1), k
                if k < 0:
                    break
                side = 1 - side
            else:
                return False
        for side in (0, 1):
            slot, k = np.array(list(at[side]), np.int64), np.array(list(at[side].values()), np.int64)
            if len(k):
                self.keys[side, slot], self.ranks[side, slot] = keys[k], ranks[k]
        return True

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
        s, t = self._slots(keys)
        return np.where(self.keys[0][s] == keys, self.ranks[0][s], np.where(self.keys[1][t] == keys, self.ranks[1][t], NONE))


class Bpe:
    """Encoder and decoder of one byte-level BPE vocabulary in the tokenizers JSON format."""

    def __init__(self, spec: str):
        d = json.loads(spec)
        alphabet = byte_alphabet()
        vocab = d["model"]["vocab"]
        self.tokens: list[bytes] = [b""] * (max([*vocab.values(), *(t["id"] for t in d["added_tokens"])]) + 1)
        for t, i in vocab.items():
            self.tokens[i] = bytes(alphabet[c] for c in t)
        self.byte_ids = [vocab[c] for c, _ in sorted(alphabet.items(), key=lambda x: x[1])]
        self.rank: dict[tuple[int, int], int] = {}
        self.merged: list[int] = []
        for pair in d["model"]["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[vocab[a], vocab[b]] = len(self.merged)
            self.merged.append(vocab[a + b])
        self.added = {t["content"]: t["id"] for t in d["added_tokens"]}
        for t, i in self.added.items():
            self.tokens[i] = t.encode()
        self.added_at = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.byte_id = np.array(self.byte_ids, np.int32)
        self.merged_id = np.array([*self.merged, 0], np.int32)
        self.ranks = PairRanks(self.rank)
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.long_keys: list[tuple[dict, str]] = []  # not kept beyond a block
        self.find = regex.compile(PATTERN).findall
        self.space_runs = regex.compile(rf"([{SPACE}]{{2,}})")

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word as little-endian uint32 bytes."""
        raw = [w.encode() for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        out: list[bytes] = [b""] * len(raw)
        for i in np.flatnonzero(size > LONG_WORD):
            out[i] = np.asarray(self._heap(raw[i]), "<u4").tobytes()
        for width in range(8, LONG_WORD + 8, 8):
            for rows in np.array_split(own := np.flatnonzero((size > width - 8) & (size <= width)), len(own) // 20_000 + 1):
                if len(rows):
                    for i, ids in zip(rows, self._arrays([raw[i] for i in rows], width)):
                        out[i] = ids
        return out

    def _arrays(self, raw: list[bytes], width: int) -> list[bytes]:
        text = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in raw), np.uint8).reshape(len(raw), width)
        left = np.fromiter(map(len, raw), np.int64, len(raw))  # parts of each word
        ids = self.byte_id[text]
        ranks = np.full((len(raw), width), NONE, np.int32)  # ranks[:, i]: of parts i and i + 1
        ranks[:, :-1] = self.ranks(ids[:, :-1], ids[:, 1:])
        ranks[np.arange(width) >= left[:, None] - 1] = NONE
        done: list[bytes] = [b""] * len(raw)
        of = np.arange(len(raw))
        place = np.arange(width)
        while len(of):
            row = np.arange(len(of))
            i = ranks.argmin(axis=1)
            r = ranks[row, i]
            if (over := r == NONE).any():
                flat = ids[over].astype("<u4").tobytes()
                for at, j, n in zip(range(0, len(flat), 4 * width), of[over].tolist(), left[over].tolist()):
                    done[j] = flat[at : at + 4 * n]
                go = ~over
                of, ids, ranks, left, i, r = of[go], ids[go], ranks[go], left[go], i[go], r[go]
                if not len(of):
                    break
                row = row[: len(of)]
            ids[row, i] = self.merged_id[r]
            gone = np.minimum(place + (place > i[:, None]), width - 1)  # without the part right of the boundary
            ids = np.take_along_axis(ids, gone, 1)
            ranks = np.take_along_axis(ranks, np.minimum(place + (place >= i[:, None]), width - 1), 1)
            left -= 1
            after = np.minimum(i + 1, width - 1)
            ranks[row, i] = np.where(i + 1 < left, self.ranks(ids[row, i], ids[row, after]), NONE)
            before = np.maximum(i - 1, 0)
            ranks[row, before] = np.where(i > 0, self.ranks(ids[row, before], ids[row, i]), ranks[row, before])
        return done

    def _heap(self, raw: bytes) -> list[int]:
        ids: list[int] = [self.byte_ids[b] for b in raw]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank, merged = self.rank.get, self.merged
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank((ids[i], ids[i + 1]), NONE)) != NONE]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # one of the parts has merged meanwhile
            ids[i], ids[j] = merged[r], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (s := rank((ids[i], ids[k]), NONE)) != NONE:
                    heapq.heappush(heap, (s, i, ids[i], ids[k]))
            if (h := before[i]) >= 0 and (s := rank((ids[h], ids[i]), NONE)) != NONE:
                heapq.heappush(heap, (s, h, ids[h], ids[i]))
        return [x for x in ids if x >= 0]

    def _cut(self, text: str) -> list[tuple[str, list[str]]]:
        """The text as (head, chunks): each chunk stands for a space and itself, and no word reaches over
        the end of a head or chunk. That holds after a single space; longer white space is a head of its
        own, but for its last character, which goes to what follows."""
        if not two_spaces(text):
            head, *chunks = text.split(" ")
            return [(head, chunks)]
        parts = self.space_runs.split(text)  # texts and runs by turns; a text comes last, empty after a final run
        out, before = [], ""
        for k in range(0, len(parts), 2):
            head, *chunks = (before + parts[k]).split(" ")
            out.append((head, chunks))
            before = ""
            if k + 1 < len(parts):
                run = parts[k + 1]
                kept = len(run) - (k + 2 < len(parts) - 1 or parts[-1] != "")
                out.append((run[:kept], []))
                before = run[kept:]
        return [x for x in out if x[0] or x[1]]

    def _know(self, table: dict[str, bytes], keys: set[str], encode, most: int) -> None:
        missing = [k for k in keys if k not in table]
        if len(table) + len(missing) > most:
            table.clear()
            missing = list(keys)
        table.update(zip(missing, encode(missing)))
        self.long_keys += [(table, k) for k in missing if len(k) > CACHE_CHARS]

    def _encode_keys(self, keys: list[str]) -> list[bytes]:
        found = [self.find(k) for k in keys]
        self._know(self.words, set().union(*found), self.encode_words, CACHE_WORDS)
        get = self.words.__getitem__
        return [b"".join(map(get, f)) for f in found]

    def _plain(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        at = 0
        while at < len(texts):  # so many characters at a time that the tables hold all their chunks
            upto, size = at, 0
            while upto < len(texts) and (upto == at or size + len(texts[upto]) <= BLOCK_CHARS):
                size += len(texts[upto])
                upto += 1
            cut = [self._cut(t) for t in texts[at:upto]]
            self._know(self.chunks, {c for parts in cut for _, chunks in parts for c in chunks}, lambda keys: self._encode_keys([" " + k for k in keys]), CACHE_CHUNKS)
            heads = [h for parts in cut for h, _ in parts]
            head_ids = iter(self._encode_keys(heads))
            get = self.chunks.__getitem__
            for parts in cut:
                one: list[bytes] = []
                for _, chunks in parts:
                    one.append(next(head_ids))
                    one += map(get, chunks)
                out.append(b"".join(one))
            for table, k in self.long_keys:
                table.pop(k, None)
            self.long_keys.clear()
            at = upto
        return out

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian uint32 bytes; strings of added tokens become those tokens."""
        if self.added_at is None or not any(t in text for text in texts for t in self.added):
            return self._plain(texts)
        parts = [self.added_at.split(t) for t in texts]
        marks = [[np.uint32(self.added[m]).tobytes() for m in self.added_at.findall(t)] for t in texts]
        ids = iter(self._plain([p for own in parts for p in own]))
        return [b"".join(next(ids) + m for _, m in zip(own, [*mark, b""])) for own, mark in zip(parts, marks)]

    def encode_ordinary_batch(self, texts: list[str]) -> list[bytes]:
        """The same, but strings of added tokens are ordinary text."""
        return self._plain(texts)

    def encode(self, text: str) -> bytes:
        return self.encode_batch([text])[0]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_MADE: dict[str, Bpe] = {}


def loader(spark, vocabulary: str):
    """A function that gives the encoder in any worker. The vocabulary file's content, a few MB whatever the
    input, is broadcast, so that no executor needs its path; a worker keeps the last two encoders by a digest
    of their content, so that two vocabularies never stand for each other."""
    with open(vocabulary, encoding="utf-8") as f:
        content = f.read()
    digest = hashlib.sha256(content.encode()).hexdigest()
    sent = spark.sparkContext.broadcast(content)

    def load() -> Bpe:
        if digest not in _MADE:
            while len(_MADE) > 1:
                del _MADE[next(iter(_MADE))]
            _MADE[digest] = Bpe(sent.value)
        return _MADE[digest]

    return load


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ids (binary, little-endian uint32), n_tokens, decoded text.

    Null and empty texts have no ids and decode to an empty text; null ids stay null; repeated rows each
    give a row; other columns are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    load = loader(spark, vocabulary)
    rows = docs.select(id_col, text_col)

    def run(batches):
        bpe = load()
        for b in batches:
            ids = bpe.encode_batch(rows_text(b.column(1)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(map(bpe.decode, ids), pa.string())],
                names=[id_col, "ids", "n_tokens", "decoded"],
            )

    return rows.mapInArrow(run, f"{id_col} {rows.schema[0].dataType.simpleString()}, ids binary, n_tokens long, decoded string")


def token_digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode_documents() with digests in place of ids and texts, made in the same pass:
    id, n_tokens, ids_sha256, decoded_sha256."""
    spark = docs.sparkSession
    bounded_batches(spark)
    load = loader(spark, vocabulary)
    rows = docs.select(id_col, text_col)

    def run(batches):
        bpe = load()
        for b in batches:
            ids = bpe.encode_batch(rows_text(b.column(1)))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in ids], pa.string()),
                ],
                names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return rows.mapInArrow(run, f"{id_col} {rows.schema[0].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
