"""Language identification with error-correcting output codes.

Every language gets a codeword of +1 and -1. For each bit a binary classifier over hashed byte
trigrams (smoothed log ratios of the two sides' trigram rates, averaged over the text) predicts the
side a text belongs to. Decoding weighs each bit's logistic loss by how well its classifier does on
that language's training texts, and takes the nearest codeword; a text whose two nearest codewords
are almost equally near is flagged as ambiguous.

Trigrams of training texts are counted on the executors, a language in one task; the driver takes
the counts of one language at a time and keeps two sums for each bit.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import TYPE_CHECKING

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import lean, pick, shuffle_partitions, sized, stored, values

if TYPE_CHECKING:
    import numpy as np

#: Default bound of the training sample: texts for each language, whole texts of any length.
TRAIN_TEXTS = 1_500
#: Up to so many languages, every possible split of them is a bit; beyond, BITS random splits are.
EXHAUSTIVE, BITS = 6, 64
HASH_BITS = 16
CHUNK_BYTES = 1_000_000
UNDETERMINED = "und"
#: Least difference of the two smallest weighted mean losses that isn't ambiguous.
MARGIN = 0.05


@dataclass
class LanguageModel:
    languages: list[str]
    codes: np.ndarray = field(repr=False)  # language x bit, of +1 and -1
    weights: np.ndarray = field(repr=False)  # bit x hashed trigram
    trust: np.ndarray = field(repr=False)  # language x bit, rows sum to 1

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(nearest language, its share of the likelihood, ambiguous) of each row of margins."""
        import numpy as np

        losses = np.stack([np.logaddexp(0, -margins * code) @ trust for code, trust in zip(self.codes, self.trust, strict=True)], axis=1)
        order = np.argsort(losses, axis=1, kind="stable")
        likely = np.exp(-4 * (losses - losses.min(axis=1, keepdims=True)))
        score = likely.max(axis=1) / likely.sum(axis=1)
        if losses.shape[1] == 1:
            return order[:, 0], score, np.zeros(len(losses), dtype=bool)
        gap = np.take_along_axis(losses, order[:, 1:2], 1)[:, 0] - losses.min(axis=1)
        return order[:, 0], score, gap < MARGIN


def codewords(n: int) -> np.ndarray:
    """Codewords of n languages as rows: all splits into two sides if few, else seeded random ones."""
    import numpy as np

    if n <= EXHAUSTIVE:
        columns = [(1, *c) for c in itertools.product((1, -1), repeat=n - 1) if -1 in c]
        return np.array(columns or [(1,) * n], dtype=np.float64).T
    draw = np.random.default_rng(7)
    best = max((draw.choice([-1.0, 1.0], size=(n, BITS)) for _ in range(50)), key=lambda c: -np.max(c @ c.T - np.diag(np.full(n, 2.0 * BITS))))
    return best[:, np.abs(best.sum(axis=0)) < n]


_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def _trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of all texts, and how many each has: one at least. None goes across texts."""
    import numpy as np

    raw = [b" " + t.lower().encode("utf-8", "replace").translate(_FOLD) + b"  " for t in texts]
    x = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.uint32)
    grams = x[:-2] | (x[1:-1] << np.uint32(8)) | (x[2:] << np.uint32(16))
    ends = np.cumsum(list(map(len, raw)))
    own = np.ones(len(x), dtype=bool)
    own[ends - 1] = own[ends - 2] = False
    return (grams[own[:-2]] * np.uint32(2654435761)) >> np.uint32(32 - HASH_BITS), np.diff(ends, prepend=0) - 2


def _means(texts: list[str], weights: np.ndarray) -> np.ndarray:
    """Mean weight of the trigrams of each text (row) for each bit (column)."""
    import numpy as np

    grams, counts = _trigrams(texts)
    starts = np.cumsum(counts) - counts
    return np.stack([np.add.reduceat(w[grams], starts, dtype=np.float64) / counts for w in weights], axis=1)


def _counts(texts: Iterable[str]) -> np.ndarray:
    """How often each hashed trigram occurs in the texts, which are looked at one by one."""
    import numpy as np

    out = np.zeros(1 << HASH_BITS)
    for text in texts:
        out += np.bincount(_trigrams([text])[0], minlength=1 << HASH_BITS)
    return out


def _weights(languages: list[str], codes: np.ndarray, counted: Iterable[tuple[str, np.ndarray]]) -> np.ndarray:
    """bit x hashed trigram: log ratio of the mean rates of the languages on the two sides of a bit."""
    import numpy as np

    place = {x: i for i, x in enumerate(languages)}
    sides = np.zeros((2, codes.shape[1], 1 << HASH_BITS))
    for lang, counts in counted:
        rate = (counts + 0.5) / (counts + 0.5).sum()
        code = codes[place[lang]]
        sides[0, code > 0] += rate
        sides[1, code < 0] += rate
    members = np.stack([(codes > 0).sum(axis=0), (codes < 0).sum(axis=0)])[:, :, None]
    sides = np.where(members > 0, sides / np.maximum(members, 1), 1.0)
    return (np.log(sides[0]) - np.log(sides[1])).astype(np.float32)


def _agreement(texts: list[str], code: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each bit, how many of a language's texts are put on its side, and the sum of the margins' sizes."""
    import numpy as np

    means = _means(texts, weights)
    return (means * code > 0).sum(axis=0).astype(np.float64), np.abs(means).sum(axis=0)


def _model(languages: list[str], codes: np.ndarray, weights: np.ndarray, judged: Iterable[tuple[str, int, np.ndarray, np.ndarray]]) -> LanguageModel:
    """The model, by rows of (language, number of its texts, agreement, sizes of margins)."""
    import numpy as np

    place, n, agree = {x: i for i, x in enumerate(languages)}, np.zeros(len(languages)), np.zeros(codes.shape)
    size = np.zeros(codes.shape[1])
    for lang, count, right, large in judged:
        n[place[lang]] += count
        agree[place[lang]] += right
        size += large
    scale = 4 / np.maximum(size / max(n.sum(), 1), 1e-6)
    trust = agree / np.maximum(n, 1)[:, None] + 1e-6
    return LanguageModel(languages, codes, (weights * scale[:, None]).astype(np.float32), trust / trust.sum(axis=1, keepdims=True))


def fit(texts: list[str], langs: list[str]) -> LanguageModel:
    """The model of labelled training texts that are at hand."""
    languages = sorted(set(langs))
    codes = codewords(len(languages))
    own = {x: [t for t, lang in zip(texts, langs, strict=True) if lang == x] for x in languages}
    weights = _weights(languages, codes, ((x, _counts(own[x])) for x in languages))
    return _model(languages, codes, weights, ((x, len(own[x]), *_agreement(own[x], codes[k], weights)) for k, x in enumerate(languages)))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The trigram counts of each language, of rows that are sorted by language."""
    pairs = (pair for b in batches for pair in zip(values(b.column(0)), values(b.column(1)), strict=True))
    for lang, rows in itertools.groupby(pairs, key=lambda pair: pair[0]):
        counts = _counts(text for _, text in rows)
        yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([counts.tobytes()], pa.binary())], names=["lang", "counts"])


def _judged(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """(lang, n, agreement, sizes), partial sums of each language of a partition."""
    languages, codes, weights = shared.value
    place, out = {x: i for i, x in enumerate(languages)}, {}
    for b in batches:
        for lang, text in zip(values(b.column(0)), values(b.column(1)), strict=True):
            right, large = _agreement([text], codes[place[lang]], weights)
            n, r, s = out.get(lang, (0, 0.0, 0.0))
            out[lang] = (n + 1, r + right, s + large)
    if out:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(out)), pa.array([x[0] for x in out.values()], pa.int64()), *(pa.array([x[k].tolist() for x in out.values()], pa.list_(pa.float64())) for k in (1, 2))],
            names=["lang", "n", "agree", "size"],
        )


def learn(docs: DataFrame, usable: Column, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", train_texts: int = TRAIN_TEXTS) -> LanguageModel | None:
    """A model of at most about ``train_texts`` usable texts of each language; None if there are none.

    ``usable`` is a condition on ``doc_id``. Texts are drawn by a hash of their id and taken whole, however
    long; every language with a usable text is learned. Null texts and null languages are passed
    over, empty texts count as texts. Rows that repeat an id are drawn together and count each. An
    empty table gives None. Columns are found by exact name; others are not looked at. The driver
    holds the counts of one language and two sums for each bit, 2**16 numbers each, however many
    languages there are.
    """
    import numpy as np

    rows = pick(docs, doc_id=id_col, text=text_col, lang=lang_col).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & usable)
    rows = rows.withColumn("at", F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1_000_000)))
    there = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("least")).collect()
    if not there:
        return None
    spark, languages = docs.sparkSession, sorted(r["lang"] for r in there)
    # A row for each language, each with the place up to which its texts are drawn: the first at least.
    cuts = spark.createDataFrame([(r["lang"], max(r["least"], math.ceil(1_000_000 * min(1.0, train_texts / r["n"])) - 1)) for r in there], "lang string, cut long")
    drawn = stored(rows.join(sized(cuts), "lang").where(F.col("at") <= F.col("cut")).select("lang", "text"), "language-sample")
    codes = codewords(len(languages))
    counted = drawn.repartition(shuffle_partitions(spark), "lang").sortWithinPartitions("lang").mapInArrow(_counted, "lang string, counts binary")
    weights = _weights(languages, codes, ((r["lang"], np.frombuffer(r["counts"])) for r in counted.toLocalIterator()))
    shared = spark.sparkContext.broadcast((languages, codes, weights))  # bits x 2**HASH_BITS: of fixed size
    judged = drawn.mapInArrow(functools.partial(_judged, shared=shared), "lang string, n long, agree array<double>, size array<double>")
    return _model(languages, codes, weights, ((r["lang"], r["n"], np.array(r["agree"]), np.array(r["size"])) for r in judged.toLocalIterator()))


def _predict(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    import numpy as np
    import regex

    letter, model = regex.compile(r"\p{L}"), shared.value
    names = ["doc_id", "lang_pred", "score", "ambiguous"]

    def batch(keys: list, texts: list) -> pa.RecordBatch:
        lang, score, unsure = np.full(len(keys), UNDETERMINED, dtype=object), np.zeros(len(keys)), np.ones(len(keys), dtype=bool)
        told = [i for i, t in enumerate(texts) if t and letter.search(t)] if model else []
        if told:
            best, likely, close = model.decode(_means([texts[i] for i in told], model.weights))
            lang[told], score[told], unsure[told] = np.array(model.languages, dtype=object)[best], likely, close
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(lang, pa.string()), pa.array(score), pa.array(unsure)], names=names)

    for b in batches:
        keys, texts, size = [], [], 0
        for key, text in zip(values(b.column(0)), values(b.column(1)), strict=True):
            keys.append(key)
            texts.append(text)
            size += len(text or "")
            if size >= CHUNK_BYTES:
                yield batch(keys, texts)
                keys, texts, size = [], [], 0
        if keys:
            yield batch(keys, texts)


def predict_language(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (0 to 1) and ambiguous of each whole text.

    A text that is null, empty or without a letter, and any text if there is no model, gives ``und``
    with score 0, flagged as ambiguous. Ties go to the language that sorts first. A very long text is
    read whole, in time and memory that grow with its length. Repeated rows repeat their result, a
    null id keeps it, an empty table gives an empty result; columns are found by exact name, and
    others, whatever their names, are not looked at.
    """
    rows = pick(docs, doc_id=id_col, text=text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x bits and bits x 2**HASH_BITS: of fixed size
    return rows.mapInArrow(functools.partial(_predict, shared=shared), "doc_id long, lang_pred string, score double, ambiguous boolean")


def _known(batches: Iterator[pa.RecordBatch], shared, text: str) -> Iterator[pa.RecordBatch]:
    import pyarrow.compute as pc

    for b in lean(batches):
        keys = pa.array(range(b.num_rows), pa.int64())
        told = _predict(iter([pa.RecordBatch.from_arrays([keys, b.column(b.schema.get_field_index(text))], names=["k", "t"])]), shared)
        langs = [x.column(1) for x in told]
        if langs:
            yield b.filter(pc.not_equal(pa.concat_arrays(langs), UNDETERMINED))


def drop_undetermined(docs: DataFrame, model: LanguageModel | None, text_col: str = "text") -> DataFrame:
    """The rows, with all columns, whose text has a language: all but those predicted as ``und``.

    Without a model (no labelled texts) nothing can be told, and all rows stay. Null, empty and very
    long texts, ties and repeated rows as in :func:`predict_language`; an empty table stays empty, and
    columns with clashing names come back as they were.
    """
    if model is None:
        return docs
    names = docs.columns
    plain = docs.toDF(*[f"__c{i}" for i in range(len(names))])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    known = functools.partial(_known, shared=shared, text=f"__c{names.index(text_col)}")
    return plain.mapInArrow(known, plain.schema).toDF(*names)
