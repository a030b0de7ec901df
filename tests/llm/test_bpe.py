import hashlib
import os
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from graphmill.llm import bpe
from graphmill.llm.queries import VOCABULARY

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary")
ALPHABET = [" ", "  ", "\n", "\t", "\r\n", "\x1c", "\x85", "\xa0", "\u200b", "\u3000", "'s", "'T", "'ll", "<|endoftext|>", "<|endoftext", "é", "日本", "😀", "e\u0301", "x", "ab", "123", "²", "!!", "--", "the", " the", "\ufeff", "ſ", "\x00"]


@pytest.fixture(scope="module")
def own():
    with open(VOCABULARY, encoding="utf-8") as f:
        return bpe.Bpe(f.read())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def texts():
    r = random.Random(1)
    made = ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 14))) for _ in range(1500)]
    return [*made, "", "a" * 3000, " " * 999, "=-" * 700 + "x", "thetion" * 400, "a  b\n\n\nc  ", "x\n y \n  z"]


def test_same_as_the_library(own, library):
    t = texts()
    for text, ids, want in zip(t, own.encode_batch(t), library.encode_batch(t, add_special_tokens=False)):
        assert np.frombuffer(ids, "<u4").tolist() == want.ids, text
        assert own.decode(ids) == library.decode(want.ids, skip_special_tokens=False)


def test_arrays_and_heap_agree(own):
    r = random.Random(2)
    for _ in range(200):
        raw = bytes(r.choice(b"the on ing\xc3\xa9ab") for _ in range(r.randint(1, 60)))
        assert np.frombuffer(own._arrays([raw], 64)[0], "<u4").tolist() == own._heap(raw)


def test_small_caches_and_blocks(library, monkeypatch):
    for name, n in (("CACHE_WORDS", 3), ("CACHE_CHUNKS", 3), ("BLOCK_CHARS", 10), ("CACHE_CHARS", 4)):
        monkeypatch.setattr(bpe, name, n)
    with open(VOCABULARY, encoding="utf-8") as f:
        own = bpe.Bpe(f.read())
    t = texts()[:200]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode_batch(t)] == [x.ids for x in library.encode_batch(t, add_special_tokens=False)]


def test_digests(spark, library):
    rows = [(1, "hello world", "n"), (2, None, None), (3, "", "n"), (None, "x", "n"), (1, "hello world", "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(map(tuple, bpe.token_digests(df, VOCABULARY).collect()), key=str)
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.encode_documents(df.limit(0), VOCABULARY).collect() == []
    assert [r.decoded for r in bpe.encode_documents(df.where("doc_id = 2"), VOCABULARY).collect()] == [""]


def test_two_vocabularies_of_one_name(spark, tmp_path, library):
    import json

    with open(VOCABULARY, encoding="utf-8") as f:
        other = json.load(f)
    other["model"]["merges"] = []  # bytes only
    (tmp_path / "byte_bpe_50k.json").write_text(json.dumps(other), encoding="utf-8")
    df = spark.createDataFrame([(1, "hello world", 5)], "id long, body string, doc_id int")
    n = [bpe.token_digests(df, v, "id", "body").first().n_tokens for v in (VOCABULARY, str(tmp_path / "byte_bpe_50k.json"), VOCABULARY)]
    assert n == [2, 11, 2]
    assert bpe.token_digests(df.limit(0), VOCABULARY, "id", "body").collect() == []
