"""SentencePiece codec and packing against the libraries."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
import sentencepiece
import tokenizers

from loomwright.llm import packing
from loomwright.llm.queries import tokenizer_file
from loomwright.llm.sentencepiece_codec import marked_words, sentencepiece_encode

ODD = [None, "", " ", "  ", "a", " a", "a ", "a  b", "▁", "x ▁y", "▁▁z", "a\n\nb \n c", "\t tab", " \n x", "é ﬁ ½ ² x²", "你好 世界 🎉🎉", "<|endoftext|>", "a <|endoftext|> b", "it's 's 'S ''s ’s",
       "\x00\x1c \x85y　z", "0123 ４５", "w" * 5000, " ".join(["it's"] * 3000), "a\xa0b \xa0 c", "\r\n a", "  x 　y", "a \tb", "</s><s><unk>"]


def corpus():
    draw = random.Random(2)
    bits = ["a", "the", " ", " ", "  ", "\n", "▁", "é", "'s", "12", ".", "🎉", "\xa0", "ab-c", "\t", "Straße"]
    return [*ODD, *("".join(draw.choice(bits) for _ in range(draw.randint(1, 60))) for _ in range(300))]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x") for i, t in enumerate(corpus())] + [(None, "no id", "x"), (3, corpus()[3], "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, IDS string")


def test_sentencepiece_as_the_library(docs):
    path = tokenizer_file("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = sentencepiece_encode(docs, path).collect()
    assert len(got) == len(corpus()) + 2
    for r in got:
        text = "no id" if r["doc_id"] is None else corpus()[r["doc_id"]] or ""
        assert r["ids"] == sp.encode(text) and r["decoded"] == sp.decode(sp.encode(text)), repr(text)
    assert sentencepiece_encode(docs.limit(0), path).count() == 0


def test_marked_words_cover_the_text():
    for text in corpus():
        if text:
            assert " " + " ".join(marked_words(text)) == " " + text.replace("▁", " ")


def test_packing(docs):
    path = tokenizer_file("byte_bpe_50k.json")
    tok = tokenizers.Tokenizer.from_file(path)
    texts = [t or "" for t in corpus()]
    want = collections.Counter()
    for key, text in [*enumerate(texts), (None, "no id"), (3, texts[3])]:
        ids = np.array([*tok.encode(text, add_special_tokens=False).ids, 2], dtype="<u4")
        first, start = (len(ids) - 1) % 64 + 1, 0
        for k, stop in enumerate(range(first, len(ids) + 1, 64)):
            want[key, k, start, stop - start, zlib.crc32(ids[start:stop].tobytes())] += 1
            start = stop
    got = packing.pack_documents(docs, path, 2, 64).collect()
    assert collections.Counter(tuple(r)[:5] for r in got) == want
    check_sequences(got, 64)


def check_sequences(rows, size):
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= size
    return bins


def test_tree_of_many_groups_packs_well(spark, monkeypatch):
    monkeypatch.setattr(packing, "FAN_IN", 3)
    draw = random.Random(1)
    lengths = [draw.randint(1, 100) for _ in range(3000)]
    pieces = spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate(lengths)], packing.PIECE_FIELDS).repartition(20)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        got = packing.best_fit_pack(pieces, 100).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(r["doc_id"] for r in got) == list(range(3000))
    bins = check_sequences(got, 100)
    assert len(bins) <= 1.03 * len(packing.best_fit(lengths, 100))  # groups of 150 pieces, of which bins are merged whole


def test_all_open_bins_that_can_be_needed_go_up(spark, monkeypatch):
    """Every group but the last ones has open bins of 60 alone, which only what the last ones leave fits into."""
    monkeypatch.setattr(packing, "LOCAL_ITEMS", 30)
    sizes = [60] * 500 + [40] * 40
    pieces = spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate(sizes)], packing.PIECE_FIELDS).coalesce(2)
    got = packing.best_fit_pack(pieces, 100).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(540))
    assert len(check_sequences(got, 100)) <= 520
    assert packing.best_fit_pack(pieces.limit(0), 100).count() == 0


def test_what_is_handed_on_loses_no_place(spark, monkeypatch):
    draw = random.Random(8)
    lengths = [draw.choice([51, 52, 60, 75, 30, 20, 7]) for _ in range(2000)]
    pieces = spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate(lengths)], packing.PIECE_FIELDS).coalesce(3)
    monkeypatch.setattr(packing, "LOCAL_ITEMS", 40)
    monkeypatch.setattr(packing, "FAN_IN", 2)
    bounded = len(check_sequences(packing.best_fit_pack(pieces, 100).collect(), 100))
    assert max(collections.Counter(f for f, up in zip([60] * 500, packing._handed_on([60] * 500, 100), strict=True) if up).values()) == 32
    monkeypatch.setattr(packing, "LEVELS", 10**9)
    assert len(check_sequences(packing.best_fit_pack(pieces, 100).collect(), 100)) == bounded


def test_best_fit_fills_exactly():
    assert [sorted(b) for b in packing.best_fit([6, 4, 7, 3, 10], 10)] == [[4], [2, 3], [0, 1]]
    assert packing.best_fit([], 10) == []


def test_query_digests(spark, tmp_path):
    from loomwright.llm.queries import op3_sentencepiece

    rows = [(i, t) for i, t in enumerate(corpus()[:30])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    for r in op3_sentencepiece(spark, f"file://{tmp_path}").collect():
        ids = sp.encode(rows[r["doc_id"]][1] or "")
        digests = [hashlib.sha256(s.encode()).hexdigest() for s in (",".join(map(str, ids)), sp.decode(ids))]
        assert [r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]] == [len(ids), *digests]
