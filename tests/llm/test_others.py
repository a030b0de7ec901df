import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from graphmill.llm import decontam, langid, licences, maxscore, secrets, token_files, urlfilter, warc
from graphmill.llm.common import text_buffer

WORDS = ["alpha", "beta", "gamma", "delta", "stone", "river", "cloud", "ember", "field", "grass", "house", "light"]


def sentence(r, n):
    return " ".join(r.choice(WORDS) + r.choice(["", "", "s", "ing"]) for _ in range(n))


# --- decontamination


def distances(windows, text):
    """Least edits of each window (rows of code points) against any stretch of the text."""
    n = len(text)
    j = np.arange(n + 1)
    row = np.zeros((len(windows), n + 1), np.int64)
    for i in range(windows.shape[1]):
        step = np.concatenate([np.full((len(windows), 1), 1 << 20), row[:, :-1] + (text[None, :] != windows[:, i : i + 1])], axis=1)
        best = np.minimum(step, row + 1)
        row = np.minimum.accumulate(best - j, axis=1) + j
    return row.min(axis=1)


def brute_contaminated(docs, items):
    want = set()
    for item, text in items:
        own = decontam.plain(text or "")
        for d, t, *_ in docs:
            body = decontam.plain(t or "")
            if len(own) < decontam.LEAST:
                hit = len(own) > 0 and own.tolist() == body.tolist()
            else:
                hit = False
                for m in {min(len(own), decontam.WINDOW), min(len(own), decontam.PASSAGE)}:
                    windows = np.lib.stride_tricks.sliding_window_view(own, m)
                    hit = hit or (len(body) > 0 and bool((distances(windows, body) <= int(m * decontam.EDITS)).any()))
            if hit:
                want.add((d, item))
    return want


@pytest.mark.parametrize("alphabet", ["latin", "cyrillic"])
def test_contaminated_like_brute_force(spark, alphabet):
    r = random.Random(5)
    turn = (lambda t: t) if alphabet == "latin" else (lambda t: t.translate({ord(a): chr(0x430 + k) for k, a in enumerate("abcdefghijklmnopqrstuvwxyz")}))
    items = [(i, turn(sentence(r, n))) for i, n in enumerate((8, 20, 45, 12))] + [(9, None), (10, turn("short one")), (11, ""), (12, turn(sentence(r, 4)))]
    docs = []
    for k in range(24):
        t = list(items[k % 4][1])
        for _ in range(r.choice([0, 0, 2, 4, 30])):
            p = r.randrange(len(t))
            t[p : p + 1] = r.choice([[], ["q"], [t[p], "z"]])
        docs.append((k, turn(sentence(r, 20)) + " " + "".join(t).upper() + "! " + turn(sentence(r, 15)), "x"))
    docs += [(100, None, "x"), (101, "", "x"), (None, items[1][1], "x"), (102, turn(sentence(r, 900)) + items[2][1] + turn(sentence(r, 900)), "x"), (3, docs[3][1], "x"), (103, turn("short").upper() + " - " + turn("one") + "!", "x"), (104, turn("a short one"), "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontam.contaminated(df, bench).collect()
    got = {(g.doc_id, g.item_id) for g in rows}
    want = brute_contaminated(docs, items)
    assert got == want and {(0, 0), (None, 1), (102, 2), (103, 10)} <= got and (104, 10) not in got
    assert sum((g.doc_id, g.item_id) == (3, 3) for g in rows) == 2  # repeated rows
    kept = {x.doc_id for x in decontam.clean(df, bench).collect()}
    assert kept == {d for d, *_ in docs} - {d for d, _ in want}
    assert decontam.contaminated(df, bench.limit(0)).collect() == [] and decontam.contaminated(df.limit(0), bench).collect() == []


def test_benchmark_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontam, "INDEX_CHARS", 10)
    monkeypatch.setattr(decontam, "POSTINGS", 5)
    test_contaminated_like_brute_force(spark, "latin")


def test_partial_quotes_at_all_offsets(spark):
    r = random.Random(12)
    item = sentence(r, 40)
    least = decontam.PASSAGE
    docs, quotes = [], {}
    for n in (least, 80, 96, 120, 143):
        for p in range(len(item) - n + 1):
            quotes[len(docs)] = item[p : p + n]
            docs.append((len(docs), f"{'x' * 30} {item[p : p + n].upper()} {'y' * 30}"))
    edited = len(docs)
    for p in range(len(item) - 80 + 1):  # a letter changed, one left out and one put in
        q = item[p : p + 80]
        docs.append((len(docs), f"{'x' * 30} {q[:20] + '0' + q[21:40] + q[41:60] + '1' + q[60:]} {'y' * 30}"))
    none = len(docs)
    docs += [(none + i, f"{'x' * 30} {sentence(r, 14)} {'y' * 30}") for i in range(50)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")
    got = {g.doc_id: g for g in decontam.contaminated(df, bench).collect()}
    assert set(got) >= set(range(none)) and not set(got) & set(range(none, len(docs)))
    assert all(got[d].edits == 0 for d in range(edited))
    assert {x.doc_id for x in decontam.clean(df, bench).collect()} == set(range(none, len(docs)))


def test_spans_are_code_points(spark):
    item = "the quick brown fox jumps over the lazy dog again and again"
    text = "ééé 😀 " + item.title() + " ñ"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    g = decontam.contaminated(df, spark.createDataFrame([(7, item)], "item_id long, text string")).first()
    assert text[g.start : g.end].lower() == item and g.edits == 0


# --- WARC


def test_warc_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "SEGMENT_BYTES", 3000)
    same, long = "x" * 150, "<p>é</p>" * 4000
    rows = [(5, "http://a/5", same), (2, "http://a/2", same), (9, None, same), (1, "u", "short"), (3, "u 2", "short"), (4, "u", None), (6, "u", long), (7, "u", long), (8, "u", long + "!\r\n\r\nWARC/1.1\r\n"), (None, "u", same), (10, "u", ""), (6, "u", long)]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "page_id long, url string, html string, record_type string")
    got = sorted([tuple(x) for x in warc.round_trip(df).collect()], key=str)
    first = {}
    for p, _, h in rows:
        h = h or ""
        if p is not None and len(h.encode()) >= 100:
            first[h] = min(p, first.get(h, p))
    want = []
    for p, _, h in rows:
        h = h or ""
        again = p is not None and h in first and first[h] != p
        want.append((p, len(h.encode()), hashlib.sha256(h.encode()).hexdigest(), "revisit" if again else "response", first[h] if again else None))
    assert got == sorted(want, key=str)
    assert warc.round_trip(df.limit(0)).collect() == []


def test_broken_segments_are_noticed(spark, tmp_path):
    full = warc.records(1, "u", b"y" * 200_000, hashlib.sha256(b"y" * 200_000).hexdigest(), 0)
    assert len(full) > 2
    for name, parts in (("gap", full[:1] + full[2:]), ("end", full[:-1]), ("twice", [*full, full[1]])):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.warc").write_bytes(b"".join(p + b"\r\n\r\n" for p in parts))
        with pytest.raises(Exception, match="segments"):
            warc.read(spark, str(tmp_path / name)).collect()
    (tmp_path / "good").mkdir()
    for i, p in enumerate(reversed(full)):  # over several files, in any order
        (tmp_path / "good" / f"{i}.warc").write_bytes(p + b"\r\n\r\n")
    assert warc.read(spark, str(tmp_path / "good")).first().payload == b"y" * 200_000


def test_all_gzip_members_are_read(spark, tmp_path):
    import gzip

    sha = lambda b: hashlib.sha256(b).hexdigest()
    own = [r for i, p in enumerate((b"one", b"two" * 90, b"")) for r in warc.records(i, "u", p, sha(p), i)]
    other = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: 2\r\n\r\nhi"
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(r + b"\r\n\r\n") for r in [other, *own]))
    assert sorted((x.page_id, bytes(x.payload)) for x in warc.read(spark, str(tmp_path)).collect()) == [(0, b"one"), (1, b"two" * 90), (2, b"")]
    ids = [h["warc-record-id"] for r in own for h, _ in warc.parse(r + b"\r\n\r\n")]
    assert len(set(ids)) == 3 and all(re.search(rb"\r\nWARC-Date: \d{4}-", r) for r in own)
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(own[0] + b"\r\n\r\n")[:-9])
    with pytest.raises(Exception, match="gzip"):
        warc.read(spark, str(tmp_path)).collect()


def test_revisits_need_their_response(spark, tmp_path):
    p = b"z" * 200
    d = hashlib.sha256(p).hexdigest()
    whole, again = warc.records(1, "u", p, d, 5)[0], warc.records(2, "u", p, d, 6, warc.urn(1, f"{d}/5"))[0]
    for name, parts in (("both", [again, whole]), ("lost", [again]), ("wrong", [again, warc.record("response", warc.urn(1, f"{d}/5"), b"HTTP/1.1 200 OK\r\n\r\nother")])):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.warc").write_bytes(b"".join(x + b"\r\n\r\n" for x in parts))
    got = {x.page_id: x for x in warc.read(spark, str(tmp_path / "both")).collect()}
    assert (got[2].record_type, got[2].refers_to, got[2].payload_bytes, got[2].payload_digest) == ("revisit", 1, 200, d)
    for name in ("lost", "wrong"):
        with pytest.raises(Exception, match="no response"):
            warc.read(spark, str(tmp_path / name)).collect()


def test_chunked_framing():
    for p in (b"", b"a", b"\r\n" * 9000, bytes(range(256)) * 300):
        assert warc.dechunked(warc.chunked(p, 777)) == p
    assert warc.dechunked(b"3;x=y\r\nabc\r\n0\r\nT: v\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nabc\r\n0\r\n\r\n")


# --- language ID


def test_languages(spark):
    r = random.Random(2)
    vocab = {"aa": "lorem ipsum dolor amet", "bb": "über schön gruß straße", "cc": "niño mañana señor año"}
    rows = [(i, " ".join(r.choice(vocab[k].split()) for _ in range(20)), k, "s") for i, k in enumerate(list(vocab) * 60)]
    rows += [(900, None, "aa", "s"), (901, "123 !!", "aa", "s"), (902, "", None, "s"), (None, "lorem ipsum", None, "s"), (903, "ÜBER SCHÖN GRUß " * 2000, None, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = langid.fit(df)
    got = {x.doc_id: x for x in langid.identify(df, model).collect()}
    import zlib

    held = [i for i in range(180) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert {i for i in got if i is not None and got[i].held_out} == {i for i in [*range(180), 900, 901, 902, 903] if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum(got[i].lang_pred == rows[i][2] for i in held) / len(held) > 0.98
    assert [got[i].lang_pred for i in (900, 901, 902, 903, None)] == ["und", "und", "und", "bb", "aa"]
    assert all(0 <= x.score <= 1 for x in got.values())
    assert {x.doc_id for x in langid.known_language(df, model).collect()} == set(got) - {900, 901, 902}
    none = langid.fit(df.where("lang is null"))
    assert {x.lang_pred for x in langid.identify(df, none).collect()} == {"und"}
    assert {x.doc_id for x in langid.known_language(df, none).collect()} == set(got) - {900, 901, 902}
    assert langid.identify(df.limit(0), model).collect() == [] and langid.known_language(df.limit(0), model).collect() == []
    twice = [tuple(x) for x in langid.identify(df.where("doc_id = 0").unionByName(df.where("doc_id = 0")), model).collect()]
    assert len(twice) == 2 and twice[0] == twice[1]


def test_every_language_is_learned_and_sampled(spark):
    from graphmill.llm.common import smallest_hashes

    rows = [(i, f"{'abcdefghij'[i % 70 // 10]}{'klmnopqrst'[i % 10]} " * 12, f"l{i % 70:02d}", "s") for i in range(70 * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = langid.fit(df)
    assert len(model.langs) == 70
    got = [(x.lang_pred, x.doc_id) for x in langid.identify(df, model).collect()]
    assert sum(v == f"l{i % 70:02d}" for v, i in got) / len(got) > 0.9
    few = langid.fit(df, most=3)  # drawn, but not all
    assert len(few.langs) == 70
    for n in (10, 1_000, 2e9, 1e10, 1e13):  # the share never becomes nothing
        bound = smallest_hashes(n, 1200)
        assert bound / 2**63 * n >= min(n, 1200) * 0.999


def test_decoding_like_brute_force():
    rng = np.random.default_rng(4)
    code = langid.codewords(5)
    m = langid.Model(list("abcde"), code, rng.normal(size=(langid.DIM, code.shape[1])).astype(np.float32), np.zeros(code.shape[1], np.float32), np.full(code.shape[1], 1 / code.shape[1]))
    x = rng.random((6, langid.DIM)).astype(np.float32) / 40
    best, share = m.predict(x)
    for row, b, s in zip(x, best, share):
        z = [float(sum(row * m.weight[:, k])) for k in range(code.shape[1])]
        loss = [sum(m.trust[k] * np.log(1 + np.exp(-z[k] * c[k])) for k in range(len(z))) * len(z) for c in code]
        assert int(b) == int(np.argmin(loss)) and abs(s - 1 / sum(np.exp(min(loss) - v) for v in loss)) < 1e-3


@pytest.mark.parametrize("n", [2, 4, 7, 12])
def test_codewords_correct_errors(n):
    code = langid.codewords(n)
    d = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
    assert d >= (1 if n == 2 else 2 if n == 3 else 3)


# --- token counts


@pytest.mark.parametrize("seed", range(4))
def test_separator_scan(spark, seed, monkeypatch):
    monkeypatch.setattr(token_files, "GROUP_BLOCKS", 3)
    r = random.Random(seed)
    rows, want = [], []
    for f in range(6):
        ids = [r.choice([0, 1, 2, 3, 9] if f % 2 else [1, 2, 3, 4, 5, 6, 7, 8, 0]) for _ in range(r.choice([0, 1, 40, 97]))]
        size = r.choice([1, 2, 7])
        for b in range(max(1, -(-len(ids) // size))):
            rows.append((f"f{f}", b, np.array(ids[b * size : (b + 1) * size], "<u2").tobytes()))
        docs = "".join(map(str, ids)).split("0")
        want += [(f"f{f}", i, len(x)) for i, x in enumerate(docs[:-1])] + ([(f"f{f}", len(docs) - 1, len(docs[-1]))] if docs[-1] else [])
    r.shuffle(rows)
    df = spark.createDataFrame([(a, b, bytearray(c)) for a, b, c in rows], "file string, block long, payload binary")
    assert sorted(tuple(x) for x in token_files.scan(df, 0).collect()) == sorted(want)


def test_flat_files(spark, tmp_path):
    (tmp_path / "a").write_bytes(np.array([5, 6, 0, 7, 0, 0, 8], "<u2").tobytes())
    df = token_files.file_blocks(spark, str(tmp_path), 2, 2)
    assert sorted((x.ordinal, x.n_tokens) for x in token_files.scan(df, 0).collect()) == [(0, 2), (1, 1), (2, 0), (3, 1)]
    assert token_files.scan(df.limit(0), 0).collect() == []
    with pytest.raises(ValueError, match="two bytes"):
        token_files.two_bytes(np.array([1, 70_000]))


def test_document_tokens(spark):
    from tokenizers import Tokenizer

    from graphmill.llm.queries import SEPARATOR, VOCABULARY

    r = random.Random(1)
    rows = [(i, sentence(r, r.randint(0, 60))) for i in range(70)] + [(100, None), (None, "x y"), (3, "again"), (101, "a<|endoftext|>b")]
    lib = Tokenizer.from_file(VOCABULARY)
    lib.encode_special_tokens = True
    want = sorted(((i, len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t in rows), key=str)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    token_files.BLOCK_TOKENS, before = 50, token_files.BLOCK_TOKENS
    try:
        assert sorted((tuple(x) for x in token_files.document_tokens(df, VOCABULARY, SEPARATOR).collect()), key=str) == want
    finally:
        token_files.BLOCK_TOKENS = before
    assert token_files.document_tokens(df.limit(0), VOCABULARY, SEPARATOR).collect() == []
    clash = df.selectExpr("doc_id", "text", "1 as file", "2 as ordinal", "'x' as n_tokens")
    assert sorted((tuple(x) for x in token_files.document_tokens(clash, VOCABULARY, SEPARATOR).collect()), key=str) == want


# --- URL filters


def test_urls(spark):
    from graphmill.llm.queries import RULES

    words = "cheap flights best casino bonus news paper " * 50
    rows = [(1, "https://WWW.Example.ORG/es/1?x=1", words), (2, "http://a.org#f", None), (3, "http://org/x", ""), (4, "ftp://b.com/de/", words), (5, "no scheme", words), (6, None, words), (7, "http://notorg/x", words), (8, "http://x.net/en/12", words), (9, "http://example.org/en/19", words), (10, "http://c.com/fr/a#b", words), (None, "http://c.com/FR/", words), (11, "http://é.org/" + "a" * 5000, words), (12, "x://h?q/p", words), (13, "http://evilexample.org/es/", words)]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "page_id long, url string, html string, verdict string")
    got = {x.page_id: (x.host, x.path, x.rule, x.verdict if x.rule else None) for x in urlfilter.judge(df, RULES).collect()}
    assert got[1] == ("www.example.org", "/es/1", "example.org/es/", "block")
    assert got[2] == ("a.org", "", None, None) and got[3] == ("org", "/x", "org/", "allow")
    assert got[4] == ("b.com", "/de/", "com/de/", "block") and got[5] == got[6] == ("", "", None, None)
    assert got[7] == ("notorg", "/x", None, None) and got[8][2] is None
    assert got[9] == ("example.org", "/en/19", "example.org/en/1", "block") and got[10] == ("c.com", "/fr/a", "com/fr/", "allow")
    assert got[None] == ("c.com", "/FR/", None, None) and got[11][2] == "org/" and got[12] == ("h", "", None, None)
    assert got[13] == ("evilexample.org", "/es/", "org/", "allow")
    assert urlfilter.judge(df.limit(0), RULES).collect() == []
    long = spark.createDataFrame([(1, "http://a.org/" + "x" * 30_000, words)] * 2, "page_id long, url string, html string")
    assert [(len(x.path), x.verdict) for x in urlfilter.judge(long, RULES).collect()] == [(30_001, "allow")] * 2


def test_rules_like_brute_force():
    r = random.Random(6)
    hosts = ["", "a.b", "b", "c.a.b", "x.b", "ab"]
    for _ in range(60):
        rules = [urlfilter.Rule(r.choice(urlfilter.VERDICTS), r.choice(hosts), "/" + "".join(r.choice("xy/") for _ in range(r.randrange(4)))) for _ in range(8)]
        known = urlfilter.Rules(rules)
        for _ in range(20):
            host, path = r.choice(["", "a.b", "b", "c.a.b", "d.c.a.b", "cab", "x.b"]), r.choice(["", "/"]) + "".join(r.choice("xy/") for _ in range(r.randrange(5)))
            fit = [x for x in rules if (x.host in ("", host) or host.endswith("." + x.host)) and path.startswith(x.path)]
            assert known.fitting(host, path) == max(fit, key=lambda x: len(x.text), default=None)


def test_viterbi_like_brute_force(monkeypatch):
    from itertools import combinations as some

    r = random.Random(3)
    s = urlfilter.Segmenter(urlfilter.Words.of({w: r.randint(1, 50) for w in ("ab", "abc", "bca", "ca", "cab", "aa", "b" * 25)}))
    price = lambda w: min(float(s.costs([w])[0]), s.log_total + urlfilter.LETTER * len(w))
    for _ in range(60):
        run = "".join(r.choice("abc") for _ in range(r.randint(1, 9)))
        ways = [[run[i:j] for i, j in zip((0, *cut), (*cut, len(run)))] for n in range(len(run)) for cut in some(range(1, len(run)), n)]
        assert abs(sum(map(price, s.split(run))) - min(sum(map(price, w)) for w in ways)) < 1e-9
    assert "".join(s.split("abcca" * 3000)) == "abcca" * 3000 and s.split("q" * 50) == ("q" * 50,)
    long = ("abcca" * 500 + "b" * 25) * 3
    whole = s.split(long)
    assert "b" * 25 in whole  # words of any length are known
    monkeypatch.setattr(urlfilter, "LOOKED_UP", 20)
    assert s._split(long) == whole


def test_only_shown_words_count(spark):
    page = "<html lang='en'><style>red blue</style><Script src=x>var hidden</scRipt><p class=big>Alpha alpha</p> beta " + "z" * 30
    got = urlfilter.word_counts(spark.createDataFrame([(page,), (None,)], "text string"), "text")
    assert {w: int(got.counts([w])[0]) for w in ("alpha", "beta", "html", "hidden", "red", "class", "z" * 20, "z" * 30)} == {"alpha": 2, "beta": 1, "html": 0, "hidden": 0, "red": 0, "class": 0, "z" * 20: 0, "z" * 30: 1}
    assert got.total == int(got.count.sum()) == 4 and got.lengths.tolist() == [4, 5, 30]


def test_many_distinct_words_do_not_fill_the_table(spark):
    from pyspark.sql import functions as F

    # 5 million words that occur once, each of 12 letters by its number, among frequent ones
    letters = [F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), (F.floor(F.col("w") / 26**i) % 26 + 1).cast("int"), F.lit(1)) for i in range(5)]
    rare = spark.range(0, 5_000_000, 1, 8).withColumn("w", (F.col("id") * 7919) % 11881376).select(F.concat(F.lit("qx"), *letters).alias("t"))
    often = spark.range(200).select(F.lit("best casino cheap flights " * 20).alias("t"))
    got = urlfilter.word_counts(rare.unionByName(often), "t")
    s = urlfilter.Segmenter(got)
    assert got.total == 5_000_000 + 200 * 80 and len(got.key) == 4
    exact = urlfilter.Segmenter(urlfilter.Words.of({w: 4000 for w in ("best", "casino", "cheap", "flights")}))
    for name in ("bestcasinoxqzwv", "cheapflights", "xqzwvkjh"):
        assert s.split(name) == exact.split(name), name
    assert s.split("bestcasinoxqzwv") == ("best", "casino", "xqzwv")


def test_names_are_split_into_words():
    s = urlfilter.Segmenter(urlfilter.Words.of({"cheap": 50, "flights": 40, "fl": 3, "best": 30, "bestial": 1}))
    assert s.split("cheapflights") == ("cheap", "flights") and s.split("bestcheap") == ("best", "cheap")
    assert s.tokens("cheapflights.com", "/A1/22") == ["h:cheap", "h:flights", *s.tokens("com", ""), *s.tokens("", "/A"), "p:#1", "p:#2"]


def test_bayes_like_brute_force():
    docs = [("block", "122"), ("block", "23"), ("allow", "41")]
    c = {v: Counter(t for w, ts in docs if w == v for t in ts) for v in urlfilter.VERDICTS}
    key = list("1234")
    counts = np.array([[c[v][t] for t in key] for v in urlfilter.VERDICTS], float)
    m = urlfilter.Bayes.of(np.array([1.0, 2.0]), urlfilter.fingerprints(key), counts, counts.sum(axis=1))
    z = {v: np.log((n + 1) / 5) + sum(np.log((c[v][t] + 1) / (c[v].total() + 4)) for t in "2495") for v, n in (("allow", 1), ("block", 2))}
    assert abs(m.block_score(list("2495")) - (z["block"] - z["allow"])) < 1e-9
    empty = urlfilter.Bayes.of(np.zeros(2), np.zeros(0, np.int64), np.zeros((2, 0)), np.zeros(2))
    assert empty.block_score(["a"]) == empty.block_score([]) == 0.0


# --- licences


def test_licences(spark):
    r = random.Random(4)
    notes = {n: t[0] for n, t in licences.TEMPLATES.items()}
    rows = [(i, sentence(r, 30) + ". " + t + ".\n" + sentence(r, 10), n) for i, (n, t) in enumerate(notes.items())]
    rows += [(60, rows[0][1], rows[0][2])]
    rows += [(50, None, None), (51, "", None), (52, sentence(r, 4000), None), (None, "RELEASED under the -- mit LICENSE", "MIT"), (53, "Released under the MIT License. Licensed under the Apache License, Version 2.0.", "two")]
    df = spark.createDataFrame(rows, "doc_id long, text string, licence string")
    got = {}
    for x in licences.scan(df).collect():
        got.setdefault(x.doc_id, []).append((x.licence, round(x.dice, 3)))
    assert {k: v for k, v in got.items() if k != 53} == {i: [(n, 1.0)] for i, _, n in rows if n and n != "two"}
    assert sorted(got[53]) == [("Apache-2.0", 1.0), ("MIT", 1.0)]
    assert licences.scan(df.limit(0)).collect() == []
    twice = df.where("doc_id = 60").unionByName(df.where("doc_id = 60"))
    assert len(licences.scan(twice).collect()) == 2


def test_alike_licences_are_told_apart(spark):
    rows = [(1, licences.TEMPLATES["BSD-2-Clause"][2]), (2, licences.TEMPLATES["BSD-3-Clause"][2]), (3, "This software is distributed under the MIT License and comes with no support"), (4, (licences.TEMPLATES["MIT"][2] + " ") * 40)]
    got = licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(x.licence, x.dice) for x in got if x.doc_id < 3] == [("BSD-2-Clause", 1.0), ("BSD-3-Clause", 1.0)]
    assert [(x.licence, round(x.dice, 3)) for x in got if x.doc_id == 3] == [("MIT", 0.857)]
    assert [(x.licence, x.dice) for x in got if x.doc_id == 4] == [("MIT", 1.0)] * 40


def test_licence_stretches_like_brute_force():
    r = random.Random(7)
    t = licences.Templates({"L": ("one two three four five six seven eight nine ten",), "M": ("red green blue red green blue",)})
    vocab = "one two three four five six seven eight nine ten red green blue x y".split()
    for _ in range(40):
        words, k = [], r.choice([3, 12, 30])
        while len(words) < k:
            words += r.choice([["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten"], ["red", "green", "blue"] * 2, [r.choice(vocab)]])
        raw = np.frombuffer(" ".join(words).encode(), np.uint8)
        got = t.matches(raw, np.array([0, len(raw)]), 0.8)
        grams = licences.bigrams(licences.words(raw, np.array([0, len(raw)]))[0])
        best = max([licences.dice(grams[i : i + len(g)], g) for g in t.grams for i in range(max(1, len(grams) - len(g) + 1))], default=0)
        assert bool(got) == (best >= 0.8) or (got and best < 0.8 and len(words) < 12)
        if got and best >= 0.8:
            assert max(s for _, _, s, _, _ in got) >= best - 1e-9


def test_licence_stretches_of_all_sizes_like_brute_force():
    r = random.Random(11)
    t = licences.Templates({"L": ("one two three four five six seven eight nine ten",), "M": ("red green blue red green blue",)})
    notes = [x.split() for x in ("one two three four five six seven eight nine ten", "red green blue red green blue")]
    for _ in range(150):
        words = []
        for _ in range(r.choice([1, 3])):
            own = list(r.choice(notes))
            i = r.choice([0, 0, 2, 3])
            own = own[i:] if r.random() < 0.5 else own[: len(own) - i]
            for _ in range(r.choice([0, 1, 2])):
                own.insert(r.randrange(len(own) + 1), r.choice("xyz"))
            words += [r.choice("uvw") for _ in range(r.choice([0, 2, 6]))] + own
        raw = np.frombuffer(" ".join(words).encode(), np.uint8)
        got = t.matches(raw, np.array([0, len(raw)]), 0.8)
        grams = licences.bigrams(licences.words(raw, np.array([0, len(raw)]))[0])
        best = max(licences.dice(grams[i:j], g) for g in t.grams for i in range(len(grams)) for j in range(i + 1, len(grams) + 1))
        assert bool(got) == (best >= 0.8)
        assert not got or abs(max(s for _, _, s, _, _ in got) - best) < 1e-12


def test_shortened_licences(spark):
    notice = licences.TEMPLATES["MIT"][2]
    first = notice.split(":")[0]
    rows = [(1, first), (2, "a b c. " + first + ". d e f"), (3, notice.replace("to deal in", "x y z to deal u v in")), (4, notice[:200])]
    got = {x.doc_id: (x.licence, round(x.dice, 2)) for x in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == got[2] == ("MIT", 0.87) and got[3][0] == "MIT" and 4 not in got


# --- top-k


@pytest.mark.parametrize("seed", [1, 2])
def test_top_k_like_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(maxscore, "SHARD_CELLS", 60 * 8)
    monkeypatch.setattr(maxscore, "BLOCK_CELLS", 2 * 8)
    monkeypatch.setattr(maxscore, "SEED", 10)
    monkeypatch.setattr(maxscore, "STEP", 20)
    r = random.Random(seed)
    values = [0.0] * 9 if seed == 2 else [0.25, -0.5]  # mostly 0: postings are short
    rows = [(i, [r.choice([r.gauss(0, 0.3), *values]) for _ in range(8)]) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(30)] + [(900, None), (901, [0.1, None] * 4), (902, [float("nan")] * 8), (903, [float("inf")] * 8), (None, [0.5] * 8), (50, rows[3][1]), (950, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")
    vectors = maxscore.quantised(df, "vec_id", "embedding")
    got = sorted(tuple(x) for x in maxscore.top_k(vectors, vectors.where("id % 50 = 0"), 5).collect())
    fine = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, a in fine:
        if q % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in fine if i != q and len(a) == len(b))[:5]
            want += [(q, k, i, -s) for k, (s, i) in enumerate(best, 1)]
    assert got == sorted(want)
    assert maxscore.top_k(vectors.limit(0), vectors.limit(0), 5).collect() == []


# --- secrets


def brute(text):
    out = []
    for m in re.finditer(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def test_patterns_like_brute_force(spark):
    r = random.Random(8)
    bits = ["password", "PassWd", "token", "api_key", "APIKEY", "ſecret", "=", ": ", " = '", '"', "abc", "0123456789abcdef" * 2, "AKIA", "AKIAABCDEFGHIJKL", "Z9", " ", "é", "😀", "deadbeef", "-x.", "\n", ":token:"]
    rows = [(i, "".join(r.choice(bits) for _ in range(r.randint(0, 12)))) for i in range(400)] + [(500, None), (501, ""), (None, "token=abcdefgh1"), (502, "token=" + "a1" * 50_000)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, spans string")
    got = {x.doc_id: x for x in secrets.digest(secrets.scan(df, secrets.Network.untrained())).collect()}
    for i, t in rows:
        want = brute(t or "")
        text = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in want)
        assert got[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest() and got[i].spans == text, t
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(k == j for _, k, _ in want) for j in range(3))


def test_network_learns_and_base_spans_stay(spark):
    r = random.Random(9)
    hexes = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    rows = []
    for i in range(400):
        kind = i % 4
        tail = {0: f"password={hexes(18)}", 1: f'token = "{hexes(40)}"', 2: f"on 2021-03-{i % 28 + 1:02d}-release-notes-{i}", 3: sentence(r, 3)}[kind]
        rows.append((i, f"{sentence(r, 8)} {tail} {sentence(r, 6)}"))
    rows += [(1000 + i, f"{sentence(r, 8)} pwd {hexes(28)} {sentence(r, 5)}") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    net = secrets.fit(df.where("doc_id < 1000"))
    x, y = secrets.labelled(df.where("doc_id < 1000"))
    p = secrets.Network.train(x, y).scores(*secrets.side_by_side(x))
    assert ((p >= 0.5) == (y > 0)).mean() > 0.97
    got = {g.doc_id: g for g in secrets.digest(secrets.scan(df, net)).collect()}
    assert sum(got[1000 + i].n_model for i in range(20)) >= 10 and sum(g.n_model for i, g in got.items() if i % 4 > 1 and i < 1000) == 0
    masked = {m.doc_id: m.text for m in secrets.mask(df, net).collect()}
    assert secrets.MASK in masked[0] and masked[3] == rows[3][1] and "password" not in masked[0]


def test_threshold_keeps_the_recall_of_findings_hard_to_tell_apart():
    rng = np.random.default_rng(3)
    size = secrets.BEFORE + 20 + secrets.AFTER + secrets.SPAN
    x = [rng.integers(0, secrets.CLASSES, size).astype(np.uint8).tobytes() for _ in range(800)]
    y = (rng.random(800) < 0.1).astype(np.int64)  # labels without any pattern
    net = secrets.Network.train(x, y)
    held = (y > 0) & ((np.cumsum(y) - 1) % 5 == 1)
    assert (net.scores(*secrets.side_by_side(x))[held] >= net.threshold).mean() >= secrets.RECALL


def test_network_like_brute_force():
    import pyarrow as pa

    rng = np.random.default_rng(8)
    net = secrets.Network.untrained()
    net.bias = rng.normal(size=net.FILTERS)
    texts = ["x abcdefgh1 é password= Zz9-Zz9-Zz9", "", "12345678", "a" * 400 + " b"]
    raw, at = text_buffer(pa.array(texts))
    of, start, end = secrets.runs(raw, at)
    assert [(int(d), raw[a:b].tobytes().decode()) for d, a, b in zip(of, start, end)] == [(0, "abcdefgh1"), (0, "password="), (0, "Zz9-Zz9-Zz9"), (2, "12345678"), (3, "a" * 400)]
    got = net.logits(*secrets.surroundings(raw, at[of], at[of + 1], start, end))
    for d, a, b, z in zip(of, start, end, got):
        cls = lambda p: int(secrets.CLASS[raw[p]]) if at[d] <= p < at[d + 1] else 0  # noqa: B023, E731
        parts = []
        for i, j in ((a - secrets.BEFORE, a), (a, b), (b, b + secrets.AFTER)):
            v = np.array([net.bias + sum(net.kernel[k][cls(p + k)] for k in range(secrets.SPAN)) for p in range(i, j)])
            parts.append(np.maximum(v.max(axis=0), 0))
        assert abs(float(np.concatenate(parts) @ net.out + net.shift) - float(z)) < 1e-3
    win = [secrets.window(raw, at[d], at[d + 1], a, b) for d, a, b in zip(of[:4], start, end)]  # as training sees them
    assert np.allclose(net.logits(*secrets.side_by_side(win)), got[:4], atol=1e-3)


def test_rare_findings_are_drawn_from_all_documents(spark, monkeypatch):
    r = random.Random(5)
    rows = [(i, sentence(r, 30) + (f" password=abc{i:06d}" if i % 100 == 0 else "")) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    x, y = secrets.labelled(df, most_rows=20)
    assert y.sum() == 20 and len(y) == 40
    x, y = secrets.labelled(df)
    assert y.sum() == 30  # every one, though one document in a hundred has any
    assert secrets.labelled(df.limit(0))[0] == [] and secrets.fit(df.limit(0)).threshold > 1
    net = secrets.fit(df)
    again = df.where("doc_id = 0").unionByName(df.where("doc_id = 0"))
    assert len(secrets.scan(again, net).collect()) == 2 and secrets.scan(df.limit(0), net).collect() == []
    assert secrets.mask(df.limit(0), net).collect() == [] and len(secrets.mask(again, net).collect()) == 2


def test_network_learns_calibrates_and_sets_its_threshold_by_every_candidate(spark):
    r = random.Random(6)
    hexes = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    tails = [lambda: f"password={hexes(18)}", lambda: f"token = {hexes(40)}", lambda: f"on 2021-03-{r.randint(10, 28)}-release-{r.randint(100, 999)}", lambda: "", lambda: "", lambda: ""]
    rows = [(i, f"{sentence(r, 12)} {tails[i % 6]()} {sentence(r, 5)}") for i in range(1800)] + [(None, None), (1800, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    net, same = secrets.fit(df.coalesce(1)), secrets.fit(df.repartition(5))
    assert (net.kernel == same.kernel).all() and (net.out == same.out).all() and (net.slope, net.offset, net.threshold) == (same.slope, same.offset, same.threshold)
    scores, fold, found = [], [], []
    for _, t in rows:
        raw = np.frombuffer((t or "").encode(), np.uint8)
        _, start, end, _, h = secrets.examined(raw, np.array([0, len(raw)]))
        assert [(m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9+/_.=-]{8,}", t or "")] == list(zip(start, end))
        if len(start):
            scores += net.scores(*secrets.surroundings(raw, np.zeros(len(start), int), np.full(len(start), len(raw)), start, end)).tolist()
            fold += (h % 5).tolist()
            found += [any(s < y and x < e for s, _, e in brute(t)) for x, y in zip(start, end)]
    scores, fold, found = np.array(scores), np.array(fold), np.array(found)
    counts = secrets.score_counts(df, "text", net)
    assert counts.sum(axis=1).tolist() == [(~found & (fold == 0)).sum(), (found & (fold == 0)).sum(), (found & (fold == 1)).sum(), (found & (fold > 1)).sum()]
    _, learned, bins = secrets.step_sums(df, "text", net, 1e9)
    assert learned.tolist() == [(~found & (fold > 1)).sum(), (found & (fold > 1)).sum()] and bins.sum() == found.sum()
    held = scores[found & (fold == 1)]
    logit = np.log(net.threshold / (1 - net.threshold))
    above = 1 / (1 + np.exp(-logit - net.slope * 1.01 / secrets.GRID))  # a step higher
    assert (held >= net.threshold).mean() >= secrets.RECALL > (held >= above).mean()
    # a mean score like the share of findings, among the candidates that calibrate
    assert abs(scores[fold == 0].mean() - found[fold == 0].mean()) < 0.02
    # clean runs that a small draw hardly holds
    extra = lambda n: sum(g.n_model for g in secrets.digest(secrets.scan(df, n)).collect())
    assert extra(net) < 20 < extra(secrets.Network.train(*secrets.labelled(df, most_rows=20)))


def test_many_findings_in_one_text():
    import time

    r = random.Random(8)
    for _ in range(300):
        spans = sorted((s, r.randrange(3), s + r.randint(1, 9)) for s in (r.randrange(60) for _ in range(r.randrange(6))))
        p = np.array([r.randrange(60) for _ in range(5)])
        q = p + np.array([r.randint(1, 9) for _ in range(5)])
        assert secrets.apart(p, q, spans).tolist() == [not any(a < y and x < b for x, _, y in spans) for a, b in zip(p, q)]
    net = secrets.Network.untrained()
    net.threshold = 0.0  # every run is a finding
    n = 100_000
    raw = np.frombuffer(b"".join(b"token=abcdefgh12 lonelyrun%07d " % i for i in range(n)), np.uint8)
    began = time.perf_counter()
    parts = secrets.patterns(raw.tobytes().decode())
    of, start, end = secrets.runs(raw, np.array([0, len(raw)]))
    new = secrets.apart(start, end, parts)
    assert len(parts) == n and int(new.sum()) == n and time.perf_counter() - began < 20
    got = secrets.findings(raw[: 34 * 2000], np.array([0, 34 * 2000]), net)[0]
    assert [k for _, k, _ in got] == [0, 3] * 2000


def test_slopes_like_differences_of_the_loss():
    import copy

    import pyarrow as pa

    r, rng = random.Random(4), np.random.default_rng(4)
    net = secrets.Network.untrained()
    net.bias, net.shift = rng.normal(0, 0.1, net.FILTERS), 0.1
    raw, at = text_buffer(pa.array([sentence(r, 20) + " é " + "a1" * r.randint(4, 40) for _ in range(20)]))
    of, start, end = secrets.runs(raw, at)
    args = secrets.surroundings(raw, at[of], at[of + 1], start, end)
    for sign in (-1, 1):
        sums = np.zeros(secrets.WEIGHTS, np.int64)
        secrets.add_slopes(net, sums, *args, sign)
        loss = lambda n: float((np.maximum(0, 1 - sign * n.logits(*args)) ** 2).sum() / 2)  # noqa: B023, E731
        for _ in range(20):
            moves = [rng.normal(size=x.shape) for x in (net.kernel, net.bias, net.out, np.zeros(1))]
            ends = []
            for eps in (1e-4, -1e-4):
                n = copy.deepcopy(net)
                n.kernel, n.bias, n.out, n.shift = n.kernel + eps * moves[0], n.bias + eps * moves[1], n.out + eps * moves[2], n.shift + eps * moves[3][0]
                ends.append(loss(n))
            want = sums / secrets.UNIT @ np.concatenate([m.ravel() for m in moves])
            assert abs((ends[0] - ends[1]) / 2e-4 - want) < 0.02 * np.abs(sums / secrets.UNIT).max() + 0.02 * abs(want)


def test_very_long_candidates_in_pieces(monkeypatch):
    rng = np.random.default_rng(7)
    net = secrets.Network.untrained()
    text = np.frombuffer(b"abcdefghijkl0123456789+/_.=-", np.uint8)[rng.integers(0, 28, 5000)]
    raw = np.concatenate([np.frombuffer(b"the word abcdefgh1 ", np.uint8), text, np.frombuffer(b" and more words1234", np.uint8)])
    of, start, end = secrets.runs(raw, np.array([0, len(raw)]))
    args = secrets.surroundings(raw, np.zeros(len(of), int), np.full(len(of), len(raw)), start, end)
    want, tops = net.largest(*args), net.tops(*args)
    monkeypatch.setattr(secrets, "CONVOLVED", 97)
    assert len(of) == 3 and all((a == b).all() for a, b in zip(net.largest(*args), want)) and (net.tops(*args) == tops).all()
    assert (tops == np.maximum(want[0], 0).reshape(3, -1)).all()
