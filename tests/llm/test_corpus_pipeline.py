"""The pipeline's stages, one after the other, against plain versions."""

import collections
import re
import zlib

import numpy as np
import pytest
import tokenizers

import corpus_pipeline as cp
from loomwright.llm import simhash
from loomwright.llm.queries import tokenizer_file

LANGS = {"en": "the quick thing over that other thing with them all", "de": "und der die das nicht auch schön für über alle"}


def rows():
    out = []
    for i in range(60):
        lang = "de" if i % 3 == 0 else "en"
        words = LANGS[lang].split()
        body = " ".join(words[(i * k + k // 7) % len(words)] + str(i * k) for k in range(1, 80))
        out.append((i, body, lang, "s", 1))
    text = out[7][1]
    out += [(100, text, "en", "s", 1), (101, text, "en", None, 1), (102, text.replace("the", "THE", 1), "en", "s", 1)]
    out += [(103, "mail me at a.b@c.org or +1 (017) 555-7713 soon, thing", "en", "s", None), (104, None, "en", "s", 0), (105, "", None, "s", 0), (106, "12 34 !!", "en", "s", 8)]
    return out


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows(), SCHEMA).repartition(3).write.parquet(f"file://{path}/documents.parquet")
    return f"file://{path}"


def plain_run():
    docs = [r for r in rows() if re.search(r"[^\W\d_]", r[1] or "")]
    last = {}
    for r in docs:
        last[r[1]] = max(last.get(r[1], r), r)
    docs = sorted(last.values())
    kept = []
    shingles = {r[0]: set(simhash.shingle_hashes(r[1], 5)) for r in docs}
    prints = {r[0]: simhash.fingerprint(r[1], 5) for r in docs}
    for r in docs:
        near = [k for k in kept if prints[k[0]] == prints[r[0]] or (prints[k[0]] ^ prints[r[0]]).bit_count() <= 8 and len(shingles[k[0]] & shingles[r[0]]) >= 0.8 * len(shingles[k[0]] | shingles[r[0]])]
        if not near:
            kept.append(r)
    clean = [(r[0], r[1].replace("a.b@c.org", "[EMAIL]").replace("+1 (017) 555-7713", "[PHONE]")) for r in kept]
    tok = tokenizers.Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    return {(key, k, len(ids), zlib.crc32(ids.tobytes())) for key, text in clean for k, ids in [(0, np.array([*tok.encode(text, add_special_tokens=False).ids, 2], dtype="<u4"))]}


def test_run(spark, folder):
    got = cp.run(spark, folder).collect()
    assert {(r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in got} == plain_run()
    fill = collections.Counter()
    for r in got:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 1024 and len(fill) <= 1.2 * sum(fill.values()) / 1024 + 1


def test_stages_return_the_columns_of_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), folder).count() == 0
    assert cp.STAGES[-1][1](spark, docs.limit(0), folder).count() == 0
    assert [n for n, _ in cp.STAGES] == ["language", "exact_dedup", "near_dedup", "pii", "packing"]


def test_stages_stand_very_long_texts_and_clashing_columns(spark, folder):
    long = " ".join(f"the thing {i} over" for i in range(40_000)) + " mail a@b.co"
    schema = SCHEMA.replace("source string", "source string, TEXT string, node long, Th int")
    rows = [(1, long, "en", "s", "x", 1, 2, 3), (2, long.replace("a@b", "z@b") + " end", "en", "s", "y", 4, 5, 6), (3, "a short thing", "en", "s", "z", 7, 8, 9)]
    docs = spark.createDataFrame(rows, schema).toDF("doc_id", "text", "lang", "source", "Text", "node", "digest", "n_chars")
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        got = {r["doc_id"]: r for r in out.collect()}
        assert sorted(got) == ([1, 3] if name == "near_dedup" else [1, 2, 3]) and got[3]["text"] == "a short thing" and (got[3]["node"], got[3]["digest"]) == (7, 8)
        assert got[1]["text"] == (long.replace("a@b.co", "[EMAIL]") if name == "pii" else long)
    packed = cp.STAGES[-1][1](spark, docs, folder).collect()
    assert {r["doc_id"] for r in packed} == {1, 2, 3} and max(r["length"] for r in packed) == 1024


def test_stages_stand_nulls_and_repeated_rows(spark, folder):
    odd = spark.createDataFrame([(None, None, None, None, None)] * 3 + [(1, "same", None, None, None)] * 3 + [(None, "x y z", "en", "s", 5)], SCHEMA)
    for _, stage in cp.STAGES:
        assert stage(spark, odd, folder).count() >= 1
