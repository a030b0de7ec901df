"""URL filters: rules first, then words of host and path under a naive Bayes model.

Concatenated names (`cheapflights`) are split by Viterbi over unigram word frequencies of the pages' own
text; a multinomial naive Bayes model over segmented host and path tokens, learned from the URLs that rules
decide, judges the URLs that none does.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphmill.llm.common import bounded_batches, drop_stored, stored

#: What makes up less than this share of all occurrences is unknown, words of the pages and tokens of the model
#: alike, so that a table has at most as many entries as the share's inverse, whatever the corpus. Up to that many
#: occurrences, everything that occurs is known.
WORD_SHARE = 1 / (1 << 20)
TOKEN_SHARE = 1 / (1 << 18)
#: Substrings of a run that one step looks up.
LOOKED_UP = 1 << 16
VERDICTS = ("allow", "block")

#: What each letter of an unknown word costs, as a negative log probability.
LETTER = 2.3

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path

    @classmethod
    def parse(cls, verdict: str, text: str) -> Rule:
        host, slash, path = text.partition("/")
        return cls(verdict, host.lower(), slash + path)


def host_of(url: str) -> Column:
    rest = F.expr(f"substring({url}, instr({url}, '://') + 3)")
    return F.when(F.col(url).contains("://"), F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)).otherwise("")


def path_of(url: str) -> Column:
    rest = F.expr(f"substring({url}, instr({url}, '://') + 3)")
    return F.when(F.col(url).contains("://"), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


class Rules:
    """Rules by host and path, so that a url costs a look for each end of its host and each length of a rule's
    path there, however many rules there are."""

    def __init__(self, rules: list[Rule]):
        self.rules = rules
        self.by_host: dict[str, dict[str, int]] = {}
        for n, r in enumerate(rules):
            self.by_host.setdefault(r.host, {}).setdefault(r.path, n)  # of equal rules the first
        self.lengths = {h: sorted({len(p) for p in paths}, reverse=True) for h, paths in self.by_host.items()}

    def fitting(self, host: str, path: str) -> Rule | None:
        """The longest rule that fits; of equally long ones the first given."""
        ends = [host]
        while ends[-1]:
            ends.append(ends[-1].partition(".")[2])
        best = None
        for end in ends:
            for n in self.lengths.get(end, ()):
                at = self.by_host[end].get(path[:n]) if n <= len(path) else None
                if at is not None:
                    size = -len(self.rules[at].text)
                    best = min(best or (size, at), (size, at))
                    break
        return None if best is None else self.rules[best[1]]


def fingerprints(texts: list[str]) -> np.ndarray:
    """XXH64 of each text as Spark's xxhash64 has it: a word is told by all 64 bits, not by a bucket of them."""
    return np.array([xxhash.xxh64_intdigest(t, seed=42) for t in texts], np.uint64).view(np.int64)


@dataclass
class Words:
    """Occurrences of words by their fingerprint, and of all words together."""

    key: np.ndarray  # sorted
    count: np.ndarray
    total: int
    lengths: np.ndarray  # that words of the table have, ascending

    @classmethod
    def of(cls, counts: dict[str, int]) -> Words:
        key = fingerprints(list(counts))
        order = np.argsort(key)
        return cls(key[order], np.array(list(counts.values()), np.int64)[order], sum(counts.values()), np.unique([len(w) for w in counts]).astype(np.int64))

    def counts(self, words: list[str]) -> np.ndarray:
        if not len(self.key):
            return np.zeros(len(words), np.int64)
        f = fingerprints(words)
        at = np.minimum(np.searchsorted(self.key, f), len(self.key) - 1)
        return np.where(self.key[at] == f, self.count[at], 0)


def word_counts(pages: DataFrame, text_col: str) -> Words:
    """Occurrences of a-z words of two or more letters in the text of all pages, without markup, scripts and
    styles; all are counted, and those of WORD_SHARE of all occurrences or more are kept."""
    shown = F.regexp_replace(F.regexp_replace(F.translate(text_col, UPPER, LOWER), r"<(script|style)\b[^>]*>(?s:.*?)</\1\s*>", " "), r"<[^>]*>", " ")
    words = pages.select(F.explode(F.regexp_extract_all(shown, F.lit(r"[a-z]{2,}"), 0)).alias("w"))
    every = stored(words.groupBy(F.xxhash64("w").alias("k"), F.length("w").alias("letters")).agg(F.count("*").alias("n")))
    total = every.agg(F.sum("n")).first()[0] or 0
    got = every.where(F.col("n") >= total * WORD_SHARE).toArrow()
    drop_stored(every)
    key, n, letters = (got.column(c).to_numpy() for c in ("k", "n", "letters"))
    order = np.argsort(key)
    return Words(key[order], n[order], total, np.unique(letters).astype(np.int64))


@dataclass
class Segmenter:
    """Splits a run of letters into its most probable words. Unknown words cost more the longer they are."""

    words: Words
    log_total: float = field(init=False)

    def __post_init__(self):
        self.log_total = float(np.log(self.words.total + 1))
        self.split = lru_cache(100_000)(self._split)

    def __reduce__(self):
        return Segmenter, (self.words,)

    def costs(self, words: list[str]) -> np.ndarray:
        """Of words of the table; infinite for others."""
        n = self.words.counts(words)
        return np.where(n > 0, self.log_total - np.log(np.maximum(n, 1)), np.inf)

    def _split(self, run: str) -> tuple[str, ...]:
        # best: the cheapest split of the first letters; open: the cheapest whose last word is unknown, and
        # where that word begins. An unknown word costs once, and again for each letter.
        best, back, open_, since = [0.0], [0], float("inf"), 0
        lengths = [int(n) for n in self.words.lengths if n <= len(run)]
        step = max(1, LOOKED_UP // max(1, len(lengths)))
        for first in range(1, len(run) + 1, step):
            spans = [(end, end - n) for end in range(first, min(first + step, len(run) + 1)) for n in lengths if n <= end]
            price: dict[int, list[tuple[float, int]]] = {}
            costs = self.costs([run[start:end] for end, start in spans])
            for i in np.flatnonzero(costs < np.inf):
                price.setdefault(spans[i][0], []).append((float(costs[i]), spans[i][1]))
            for end in range(first, min(first + step, len(run) + 1)):
                if best[end - 1] + self.log_total < open_:
                    open_, since = best[end - 1] + self.log_total, end - 1
                open_ += LETTER
                c, s = min([(open_, since), *((best[start] + c, start) for c, start in price.get(end, ()))])
                best.append(c)
                back.append(s)
        out, end = [], len(run)
        while end:
            out.append(run[back[end] : end])
            end = back[end]
        return tuple(out[::-1])

    def tokens(self, host: str, path: str) -> list[str]:
        """Words of host and path; digits stand as their number, whatever they are."""
        out = []
        for side, text in (("h", host), ("p", path.translate(_TO_LOWER))):
            for run in re.findall(r"[a-z]+|[0-9]+", text):
                out += [f"{side}:#{len(run)}"] if run[0].isdigit() else [f"{side}:{w}" for w in self.split(run)]
        return out


_TO_LOWER = str.maketrans(UPPER, LOWER)


@dataclass
class Bayes:
    """Multinomial naive Bayes over tokens, told by their fingerprints, with add-one smoothing. A token that is
    not in the table counts as one that never occurred."""

    prior: np.ndarray  # log, by verdict
    key: np.ndarray  # sorted
    weight: np.ndarray  # log, verdict x keys, the last for tokens without a key

    @classmethod
    def of(cls, docs: np.ndarray, key: np.ndarray, counts: np.ndarray, totals: np.ndarray) -> Bayes:
        """docs and totals (of all tokens) by verdict; counts verdict x keys."""
        order = np.argsort(key)
        seen = np.concatenate([counts[:, order], np.zeros((2, 1))], axis=1)
        return cls(np.log(docs + 1.0) - np.log(docs.sum() + 2.0), key[order], np.log(seen + 1.0) - np.log(totals[:, None] + max(1, len(key))))

    def block_score(self, tokens: list[str]) -> float:
        """Log odds of block against allow."""
        f = fingerprints(tokens)
        at = np.searchsorted(self.key, f)
        here = np.minimum(at, max(0, len(self.key) - 1))
        at = np.where(self.key[here] == f, here, len(self.key)) if len(self.key) else at
        z = self.prior + self.weight[:, at].sum(axis=1)
        return float(z[1] - z[0])


def fit(pages: DataFrame, sent: Broadcast) -> Bayes:
    """From all of `pages` (host, path) that a rule decides; sent holds the segmenter and the rules. All tokens
    are counted, and those of TOKEN_SHARE of all occurrences or more are kept."""

    def run(batches):
        for b in batches:
            docs = [0, 0]
            count: dict[str, list[int]] = {}
            seg, known = sent.value
            for host, path in zip(*(c.to_pylist() for c in b.columns)):
                rule = known.fitting(host, path)
                if rule is None:
                    continue
                v = VERDICTS.index(rule.verdict)
                docs[v] += 1
                for t in seg.tokens(host, path):
                    count.setdefault(t, [0, 0])[v] += 1
            if any(docs):
                key = [None, *fingerprints(list(count)).tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), *(pa.array([docs[v], *(n[v] for n in count.values())], pa.int64()) for v in (0, 1))], names=["k", *VERDICTS])

    every = stored(pages.select("host", "path").mapInArrow(run, "k long, allow long, block long").groupBy("k").agg(*(F.sum(v).alias(v) for v in VERDICTS)))
    sums = every.groupBy(F.isnull("k").alias("docs")).agg(*(F.sum(v).alias(v) for v in VERDICTS)).collect()  # two rows
    docs, totals = (next((np.array([x.allow, x.block], float) for x in sums if x.docs == d), np.zeros(2)) for d in (True, False))
    got = every.where(F.col("k").isNotNull() & (F.col("allow") + F.col("block") >= float(totals.sum()) * TOKEN_SHARE)).toArrow()
    drop_stored(every)
    return Bayes.of(docs, got.column("k").to_numpy(), np.stack([got.column(v).to_numpy() for v in VERDICTS]), totals)


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", text_col: str = "html") -> DataFrame:
    """Per row: id, host, path, rule (its text, or null), verdict, score (log odds of block; null under a rule).

    A url that is null or without `://` has an empty host and path, no rule fits it but one for every host,
    and the model judges it by its prior. Of equally long rules that fit the first given counts. Urls of any
    length are judged as a whole. Repeated rows give a row each; null ids stay null; null texts count no words;
    an empty table gives an empty result; other columns are not read; without any URL that a rule decides, all
    else is allowed."""
    spark = pages.sparkSession
    bounded_batches(spark)
    segmenter = Segmenter(word_counts(pages.select(F.col(text_col).alias("text")), "text"))
    split = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).select("id", host_of("url").alias("host"), path_of("url").alias("path"))
    sent = spark.sparkContext.broadcast((segmenter, Rules(rules)))  # at most 1 / WORD_SHARE words, and the caller's rules
    model = spark.sparkContext.broadcast(fit(split, sent))

    def run(batches):
        for b in batches:
            seg, known = sent.value
            texts, verdicts, scores = [], [], []
            for host, path in zip(*(b.column(c).to_pylist() for c in (1, 2))):
                rule = known.fitting(host, path)
                s = None if rule else model.value.block_score(seg.tokens(host, path))
                texts.append(rule.text if rule else None)
                scores.append(s)
                verdicts.append(rule.verdict if rule else VERDICTS[s > 0])
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(texts, pa.string()), pa.array(verdicts, pa.string()), pa.array(scores, pa.float64())], names=[id_col, "host", "path", "rule", "verdict", "score"])

    kind = split.schema["id"].dataType.simpleString()
    return split.mapInArrow(run, f"{id_col} {kind}, host string, path string, rule string, verdict string, score double")
