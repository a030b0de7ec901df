import random
import re
import zlib
from fractions import Fraction
from hashlib import sha256

from graphmill.llm import periodic


def brute_runs(w):
    out = set()
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if j > i and n >= max(6, 4 * q) and not any(all(w[x] == w[x + r] for x in range(i, i + n - r)) for r in range(1, q)):
                out.add((i, n, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(id_, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = zlib.crc32(str(id_).encode()) if id_ is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    kept = [x for i, x in enumerate(w) if not any(s + p <= i < s + n for s, n, p in runs)]
    sha = lambda s: sha256(s.encode()).hexdigest()
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (id_, len(runs), *four, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(" ".join(kept)))


def words(rng, letters, most):
    out = []
    while len(out) < most:
        out += [rng.choice(letters) for _ in range(rng.randint(1, 6))] * rng.randint(1, 8)
        if rng.random() < 0.3:
            out *= rng.randint(1, 4)
    return out[:most]


def test_runs_equal_brute_force():
    rng = random.Random(13)
    for _ in range(4000):
        w = words(rng, [b"a", b"b", b"c", b"dd", b"d"][: rng.choice([1, 2, 3, 5])], rng.randint(0, 120))
        assert periodic.runs(w) == brute_runs(w)


def test_words_are_looked_at_a_linear_number_of_times():
    class Counted(list):
        looks = 0

        def __getitem__(self, k):
            Counted.looks += 1
            return list.__getitem__(self, k)

    a, b = [0], [1]
    while len(b) < 20000:
        a, b = b, b + a
    rng = random.Random(1)
    unit = [rng.randrange(3) for _ in range(500)]
    for s in (b, [0] * 20000, unit * 40, [rng.randrange(2) for _ in range(20000)], ([0] * 99 + [1]) * 200, ([1] * 99 + [0]) * 200):
        Counted.looks = 0
        list(periodic.long_roots(Counted(s)))
        assert Counted.looks < 15 * len(s)


def test_rows_equal_brute_force(spark):
    rng = random.Random(7)
    texts = ["", None, " \t ", "a", "a a a a a a", "a a a a a", "x y " * 4, "x y\x0bx\ny x y x  y", "Ä ä Ä ä Ä ä Ä ä ende", "a a a a a a b b b b b b", "a\x1ca a\x1ca a\x1ca a\x1ca a\x1ca a\x1ca"]
    texts += [" ".join(words(rng, ["a", "b", "ç", "dd"], rng.randint(0, 80))) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "k k k k k k k"), (5, "again again"), (5, "again again")]
    docs = spark.createDataFrame([(i, t, "r", 1) for i, t in rows], "doc_id long, text string, runs string, period int")
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = [tuple(r[c] for c in names) for r in periodic.digest(periodic.find_runs(docs, planted=True)).collect()]
    assert sorted(got, key=str) == sorted((brute_row(i, t) for i, t in rows), key=str)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows if i is not None) > 10
    plain = {r.doc_id: r for r in periodic.find_runs(docs.where("doc_id in (4, 9)")).collect()}
    assert plain[4].collapsed == "a" and plain[9].collapsed == "a b" and [tuple(x) for x in plain[9].runs] == [(0, 6, 1), (6, 6, 1)]
    assert periodic.find_runs(docs.limit(0)).collect() == []


def test_a_very_long_text(spark):
    text = "p q r " * 100_000 + "end " + "z " * 300_000
    r = periodic.find_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(x) for x in r.runs] == [(0, 300_000, 3), (300_001, 300_000, 1)] and r.collapsed == "p q r end z"
