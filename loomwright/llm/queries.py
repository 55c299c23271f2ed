"""The registered queries of the corpus operators and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm import language_id, pii, toxicity
from loomwright.llm.common import held_out, table
from loomwright.llm.exact_dedup import exact_dedup
from loomwright.llm.packing import pack_documents
from loomwright.llm.sentencepiece_codec import sentencepiece_encode
from loomwright.llm.simhash import near_duplicates
from loomwright.llm.substring_dedup import substring_dedup
from loomwright.llm.topk import exact_top_k
from loomwright.llm.warc import warc_round_trip

#: Tokens of a packed sequence, and the id that ends a document.
SEQUENCE_TOKENS, END_ID = 1024, 2


def tokenizer_file(name: str) -> str:
    """The path of one of the public tokenizer files."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact dedup of all documents; of equal texts the largest doc_id stays."""
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


OP1_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY body ORDER BY doc_id DESC) = 1 AS kept, sha256(body) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS body FROM documents)
WINDOW g AS (PARTITION BY body)
"""


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learned from the four fifths that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = language_id.learn(docs, ~held_out(F.col("doc_id")))
    told = language_id.predict_language(docs, model)
    return told.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded again, as digests."""
    coded = sentencepiece_encode(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: shingles of 4 words, 4 differing bits."""
    found = near_duplicates(table(spark, sf_dir, "documents"), words=4, distance=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written to archives and read back."""
    return warc_round_trip(table(spark, sf_dir, "pages"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the passages of 50 words or more that an earlier document has."""
    left = substring_dedup(table(spark, sf_dir, "documents"), 50)
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from the labels of the four fifths that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")))
    scored = toxicity.score_toxicity(docs, model)
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The personal data of all documents, and the terms around it that disclose it."""
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < 4)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == pii.KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *map(count, ("email", "ip", "card", "phone")), F.sha2(pii.listed(base).cast("binary"), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans")
    )


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows, by inner product, of every twentieth embedding."""
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), END_ID, SEQUENCE_TOKENS)


# SHA-1 in base32: DuckDB gives it in hexadecimal, of which five digits make four.
OP5_SQL = """
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + ((('0x' || substr(sha, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first_id THEN first_id END AS refers_to,
       CASE WHEN page_id > first_id THEN NULL ELSE true END AS digest_ok
FROM (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS sha,
             min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id FROM pages)
"""

OP6_SQL = """
WITH d AS (
    SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents
), windows AS (
    SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50)
), first AS (
    SELECT s, min(doc_id) AS first_id FROM windows GROUP BY s HAVING min(doc_id) < max(doc_id)
), starts AS (
    SELECT doc_id, list(p) AS ps FROM windows JOIN first USING (s) WHERE doc_id > first_id GROUP BY doc_id
), covered AS (
    SELECT DISTINCT doc_id, p + k AS p FROM (SELECT doc_id, unnest(ps) AS p FROM starts), range(50) AS r(k)
), gone AS (
    SELECT doc_id, list(p) AS gone, count(*) AS n FROM covered GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed,
       sha256(CASE WHEN n IS NULL THEN array_to_string(w, ' ') WHEN n = len(w) THEN '' ELSE (
           SELECT coalesce(string_agg(x, ' ' ORDER BY i), '') FROM (SELECT unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i) WHERE NOT list_contains(gone, i)) END) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)
"""
OP9_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_language_id": op2_language_id,
        "op3_sentencepiece": op3_sentencepiece,
        "op4_simhash": op4_simhash,
        "op5_warc": op5_warc,
        "op6_substring_dedup": op6_substring_dedup,
        "op7_toxicity": op7_toxicity,
        "op8_pii": op8_pii,
        "op9_exact_top_k": op9_exact_top_k,
        "op10_best_fit_packing": op10_best_fit_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL, "op5_warc": OP5_SQL, "op6_substring_dedup": OP6_SQL, "op9_exact_top_k": OP9_SQL}
