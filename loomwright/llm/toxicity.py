"""Toxicity scoring with a weighted lexicon, matched by an Aho-Corasick automaton.

Texts are folded first: case, accents, homoglyphs and digits or signs that stand for letters, with
all else as single spaces. The lexicon (words and word stems with weights), the phrases that excuse
a term, and the final logistic curve are learned from labelled texts: terms and phrases are counted
by aggregations, and the driver gets those that count and three features of each training text. A
text's features are the weights of its hits, in total and normalised by its length.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import math
import unicodedata
from collections import Counter
from collections.abc import Container, Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import pick, sized, stored, values

if TYPE_CHECKING:
    import numpy as np

#: Default bound of the training sample: texts for each label, whole texts of any length.
TRAIN_TEXTS = 3_000
#: Least texts with a term, least weight, and the lengths of stems.
LEAST_TEXTS, LEAST_WEIGHT, STEMS = 5, 1.5, range(4, 9)
#: Least harmless texts with a phrase that excuses a term, and so many times the toxic ones.
EXCUSE_TEXTS, EXCUSE_RATIO = 5, 4
#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = dict(zip("абвгдеёзикмнопрстухіјѕԁԛԝαβεηικνορτυχω", "abbrdeeeukmhonpctyxijsdqwabenikvoptuxw", strict=True))
#: Digits and signs that stand for letters.
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i"}


@functools.cache
def _folding() -> dict[int, str]:
    table = {}
    for code in [*range(0x250), *range(0x370, 0x530), *range(0x1E00, 0x2100), *range(0x3000, 0x3040), *range(0xFF00, 0xFFF0)]:
        low = unicodedata.normalize("NFKD", chr(code)).lower()
        out = "".join(HOMOGLYPHS.get(c, SIGNS.get(c, c)) for c in low if not unicodedata.combining(c) and c not in "​‌‍")
        table[code] = "".join(c if c.isalpha() else " " for c in out) if out else ("" if low else " ")
    return table


def fold(text: str) -> str:
    """The folded text, with one space at either end and between words."""
    return f" {' '.join(text.translate(_folding()).split())} "


@dataclass
class ToxicityModel:
    lexicon: dict[str, float]  # " stem" or " word " to its weight
    excuses: list[str]  # " word word "
    curve: tuple[float, ...]  # bias, and a factor for each feature

    @functools.cached_property
    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for term, weight in self.lexicon.items():
            found.add_word(term, (len(term), weight))
        for phrase in self.excuses:
            found.add_word(phrase, (len(phrase), None))
        if len(found):
            found.make_automaton()
        return found

    def features(self, text: str) -> list[float]:
        """Greatest weight, sum of weights by the root of the length, and hits for each 100 words."""
        folded = fold(text)
        hits = list(self.automaton.iter(folded)) if len(self.automaton) else []
        excused = sorted((end - n + 1, end) for end, (n, weight) in hits if weight is None)
        begins, reach = [a for a, _ in excused], list(itertools.accumulate((z for _, z in excused), max))
        best: dict[int, float] = {}  # by the word's start: the heaviest term there
        for end, (n, weight) in hits:
            start = end - n + 1
            if weight is None:
                continue
            before = bisect.bisect_right(begins, start)  # phrases that begin there or earlier, and how far they reach
            if not before or reach[before - 1] < start + n - 2:
                best[start] = max(best.get(start, 0.0), weight)
        words = folded.count(" ") - 1 or 1
        return [max(best.values(), default=0.0), sum(best.values()) / math.sqrt(words), 100 * len(best) / words]

    def score(self, text: str) -> float:
        z = self.curve[0] + sum(f * x for f, x in zip(self.curve[1:], self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _terms(words: list[str]) -> set[str]:
    known = set(words)
    return {f" {w} " for w in known} | {f" {w[:k]}" for w in known for k in STEMS if len(w) >= k}


def _pairs(words: list[str], lexicon: Container[str]) -> set[str]:
    """Phrases of two words of which one at least has a term of the lexicon."""
    named = [any(t in lexicon for t in (f" {w} ", *(f" {w[:k]}" for k in STEMS))) for w in words]
    return {f" {a} {b} " for a, b, x, y in zip(words, words[1:], named, named[1:], strict=False) if x or y}


def _lexicon(counts: dict[str, tuple[int, int]], totals: tuple[int, int]) -> dict[str, float]:
    """Terms and their weights, by the numbers of harmless and toxic texts with each term."""
    weight = lambda n: math.log((n[1] + 0.5) / (totals[1] + 1)) - math.log((n[0] + 0.5) / (totals[0] + 1))
    rated = {t: w for t, n in counts.items() if n[1] >= LEAST_TEXTS and (w := weight(n)) >= LEAST_WEIGHT}
    # A stem that (nearly) always goes on in one way gives way to the longer term.
    stem_of = lambda t: t[: 1 + min(len(t) - 2, STEMS[-1])] if t[-1] == " " else t[:-1]
    implied = {s for t in rated if (s := stem_of(t)) != t and s in rated and counts[t][1] >= 0.9 * counts[s][1]}
    return {t: w for t, w in sorted(rated.items()) if t not in implied}


def _excuses(counts: dict[str, tuple[int, int]]) -> list[str]:
    """The phrases that excuse a term, by the numbers of harmless and toxic texts with each."""
    return sorted(p for p, (n, bad) in counts.items() if n >= EXCUSE_TEXTS and n >= EXCUSE_RATIO * (bad + 1))


def _curve(features: np.ndarray, toxic: np.ndarray, weights: np.ndarray) -> tuple[float, ...]:
    """The logistic curve over the features of the training texts."""
    import numpy as np

    x = np.concatenate([np.ones((len(features), 1)), features], axis=1)
    y, share = toxic.astype(float), weights / weights.mean()
    size = np.maximum(np.abs(x).max(axis=0), 1e-9)
    curve = np.zeros(x.shape[1])
    for _ in range(50):  # Newton's method, with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x / size @ curve, -30, 30)))
        slope = (x / size).T @ (share * (y - p)) - 0.01 * curve
        bend = ((x / size) * (share * p * (1 - p))[:, None]).T @ (x / size) + 0.01 * np.eye(x.shape[1])
        curve += np.clip(np.linalg.solve(bend, slope), -5, 5)
    return tuple((curve / size).tolist())


def _one_sided(harmless: int, bad: int) -> ToxicityModel:
    """Without texts of both labels, the share of toxic ones is all there is to learn."""
    share = min(max(bad / max(harmless + bad, 1), 0.01), 0.99)
    return ToxicityModel({}, [], (math.log(share / (1 - share)), 0.0, 0.0, 0.0))


def fit(texts: list[str], toxic: list[int], weights: list[float]) -> ToxicityModel:
    """The model of labelled texts that are at hand; ``weights`` are the numbers of texts that each stands for."""
    import numpy as np

    totals = (toxic.count(0), toxic.count(1))
    if not all(totals):
        return _one_sided(*totals)
    folded = [fold(t).split() for t in texts]

    def counted(found: list[set[str]]) -> dict[str, tuple[int, int]]:
        each = (Counter(), Counter())
        for terms, label in zip(found, toxic, strict=True):
            each[label].update(terms)
        return {t: (each[0][t], each[1][t]) for t in {*each[0], *each[1]}}

    lexicon = _lexicon(counted([_terms(words) for words in folded]), totals)
    excuses = _excuses(counted([_pairs(words, lexicon) for words in folded]))
    plain = ToxicityModel(lexicon, excuses, (0.0,) * 4)
    return ToxicityModel(lexicon, excuses, _curve(np.array([plain.features(t) for t in texts]), np.array(toxic), np.array(weights)))


def _found(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """(term, toxic) of each text: its terms, or with a lexicon the phrases with one of its terms."""
    lexicon = shared.value if shared is not None else None
    for b in batches:
        for text, label in zip(values(b.column(0)), values(b.column(1)), strict=True):
            words = fold(text).split()
            terms = sorted(_terms(words) if lexicon is None else _pairs(words, lexicon))
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([label] * len(terms), pa.int32())], names=["term", "toxic"])


def _featured(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [shared.value.features(t) for t in values(b.column(0))]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), b.column(1)], names=["features", "toxic"])


def learn(
    docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_texts: int = TRAIN_TEXTS
) -> ToxicityModel:
    """A model of at most about ``train_texts`` usable labelled texts of each label, drawn by a hash of their id.

    ``usable`` is a condition on ``doc_id``. A document with several labels counts as toxic if any
    label says so; of several texts of an id the least one counts. Texts are taken whole, however long.
    Null labels, null ids and null texts are passed over, empty texts count as texts. Without texts of
    both labels, or with empty tables, the model knows no terms. Columns are found by exact name;
    others are not looked at. The driver gets the terms and phrases that occur in LEAST_TEXTS or
    EXCUSE_TEXTS training texts at least, and three features of each training text.
    """
    import numpy as np

    spark = docs.sparkSession
    rated = pick(labels, doc_id=id_col, toxic=label_col).where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & usable)
    rated = rated.groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
    there = {r["toxic"]: r["count"] for r in rated.groupBy("toxic").count().collect()}
    share = {k: min(1.0, train_texts / n) for k, n in there.items()}
    part = F.when(F.col("toxic") == 1, share.get(1, 1.0)).otherwise(share.get(0, 1.0))
    drawn = stored(rated.where(F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1_000_000)) < part * 1_000_000), "toxicity-draw")
    rows = pick(docs, doc_id=id_col, text=text_col).where(F.col("text").isNotNull())
    rows = rows.join(sized(drawn), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    sample = stored(rows.select("text", "toxic"), "toxicity-sample")
    totals = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not (totals.get(0) and totals.get(1)):
        return _one_sided(totals.get(0, 0), totals.get(1, 0))

    def counted(lexicon: dict[str, float] | None, enough: Column) -> dict[str, tuple[int, int]]:
        shared = None if lexicon is None else spark.sparkContext.broadcast(frozenset(lexicon))  # terms of the sample
        found = sample.mapInArrow(functools.partial(_found, shared=shared), "term string, toxic int")
        counts = found.groupBy("term").agg(F.sum(1 - F.col("toxic")).alias("harmless"), F.sum("toxic").alias("bad"))
        return {r["term"]: (r["harmless"], r["bad"]) for r in counts.where(enough).collect()}

    lexicon = _lexicon(counted(None, F.col("bad") >= LEAST_TEXTS), (totals[0], totals[1]))
    excuses = _excuses(counted(lexicon, F.col("harmless") >= EXCUSE_TEXTS))
    shared = spark.sparkContext.broadcast(ToxicityModel(lexicon, excuses, (0.0,) * 4))
    # A row of four numbers for each training text.
    got = sample.mapInArrow(functools.partial(_featured, shared=shared), "features array<double>, toxic int").orderBy("features", "toxic").collect()
    toxic = np.array([r["toxic"] for r in got])
    return ToxicityModel(lexicon, excuses, _curve(np.array([r["features"] for r in got]), toxic, np.array([1 / share[t] for t in toxic.tolist()])))


def _score(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    model = shared.value
    for b in batches:
        scores = [model.score(t or "") for t in values(b.column(1))]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of each whole text.

    A null text counts as empty; a text without a hit gets the curve's value for none. A very long text
    is read whole, in time that grows with its length and its hits. Of terms that begin at one word the
    heaviest counts. Repeated rows repeat their result, a null id keeps it, an empty table gives an
    empty result; columns are found by exact name, and others are not looked at.
    """
    rows = pick(docs, doc_id=id_col, text=text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # terms and phrases of the training sample
    return rows.mapInArrow(functools.partial(_score, shared=shared), "doc_id long, score double")
