"""Exact deduplication by content sort, with DataFrame operations only.

Sampled splitters range-partition the texts by their first characters and a hash, each partition is
sorted externally by (those, whole text, id), and a window over the sorted rows compares each text
in full with its neighbour. One row of each run of equal texts stays.

A text that alone outweighs a partition (its copies, in bytes, exceed the mean partition) would
make one task too large. Such texts are found by an exact count over all rows; there are fewer of
them than partitions. Their rows are sorted by (text, salt), so that every run is at most about
one partition, and the heads of the runs, a few per partition, are sorted by content once more to
join the runs of one text.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from loomwright.llm.common import pick, shuffle_partitions

#: Bytes that a row counts for besides its text, so that many empty texts weigh something too.
ROW_BYTES = 64
#: Characters of a text that splitters hold, with a hash of the whole text: whole texts, sampled for
#: every partition, would be too much for the driver.
LEAD = 16


def _hot_texts(base: DataFrame, parts: int) -> list[tuple[int, int]]:
    """(hash, number of salts) of the texts that outweigh the mean partition; fewer than ``parts``."""
    weights = base.groupBy("h").agg(F.sum(F.octet_length("body") + F.lit(ROW_BYTES)).alias("w"))
    seen = Observation()
    # At most ``parts`` values can each exceed total / parts, so the limit loses none of them.
    top = weights.observe(seen, F.sum("w").alias("total")).orderBy(F.desc("w"), "h").limit(parts).collect()
    if not top:
        return []
    mean = max(seen.get["total"] / parts, 1.0)
    return [(r["h"], 2 * math.ceil(r["w"] / mean)) for r in top if r["w"] > mean and r["w"] > ROW_BYTES]


def _in_order(rows: DataFrame, parts: int, largest: bool, *salt: str) -> DataFrame:
    """Rows range-partitioned and sorted by content, with place, size and first id of their run."""
    order = F.col("id").desc_nulls_last() if largest else F.col("id").asc_nulls_last()
    run = Window.partitionBy("lead", "h", "body", *salt).orderBy(order)
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.repartitionByRange(parts, "lead", "h", *salt).select(
        *rows.columns,
        F.row_number().over(run).alias("place"),
        F.count(F.lit(1)).over(whole).alias("n"),
        F.first("id").over(whole).alias("best"),
    )


def _judged(base: DataFrame, largest: bool) -> DataFrame:
    """The rows of ``base`` (id, body and others) with place (1: the row stays), n and best (size and id of its group)."""
    parts, others = shuffle_partitions(base.sparkSession), list(base.columns)
    base = base.withColumns({"h": F.xxhash64("body"), "lead": F.substring("body", 1, LEAD)})
    hot = _hot_texts(base, parts)
    if not hot:
        return _in_order(base, parts, largest).select(*others, "place", "n", "best")
    listed = F.broadcast(base.sparkSession.createDataFrame(hot, "h long, salts int"))
    cold = _in_order(base.join(listed, "h", "left_anti"), parts, largest)
    salted = base.join(listed, "h").withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.col("salts"))).drop("salts")
    runs = _in_order(salted, parts, largest, "salt").withColumn("sha", F.sha2(F.col("body").cast("binary"), 256))
    heads = runs.where("place = 1").select(F.col("best").alias("id"), "lead", "h", "body", "salt", "sha", F.col("n").alias("run_n"))
    across = Window.partitionBy("lead", "h", "body").orderBy(F.col("id").desc_nulls_last() if largest else F.col("id").asc_nulls_last(), "salt")
    whole = across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # One head for each salt of each hot text: at most 4 * parts rows, without their texts.
    totals = heads.repartitionByRange(parts, "lead", "h").select(
        "sha", "salt", F.row_number().over(across).alias("head"), F.sum("run_n").over(whole).alias("total"), F.first("id").over(whole).alias("first_id")
    )
    place = F.when(F.col("head") == 1, F.col("place")).otherwise(F.lit(2)).alias("place")
    joined = runs.drop("n", "best").join(F.broadcast(totals), ["sha", "salt"])
    joined = joined.select(*others, place, F.col("total").alias("n"), F.col("first_id").alias("best"))
    return cold.select(*others, "place", "n", "best").unionByName(joined)


def _largest(keep: str) -> bool:
    if keep not in ("smallest", "largest"):
        raise ValueError("keep must be smallest or largest")
    return keep == "largest"


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per document: its id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; null counts as empty, and empty texts are equal. Of equal
    texts one row stays: that with the smallest id (``keep="largest"``: the largest), null ids last.
    Rows that repeat an id and a text count as copies, of which one stays. Very long texts are compared
    whole, in the sort's memory, which spills. An empty table gives an empty result; columns are found by
    exact name, and others, whatever their names, are not looked at.
    """
    base = pick(docs, id=id_col, text=text_col).select("id", F.coalesce("text", F.lit("")).alias("body"))
    return _judged(base, _largest(keep)).select(
        F.col("id").alias(id_col), F.col("best").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("place") == 1).alias("kept"), F.sha2(F.col("body").cast("binary"), 256).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows, with all columns, that :func:`exact_dedup` keeps.

    Null and empty texts are equal, and the row that stays keeps its own. Of rows equal in text and id any
    one stays, whatever its other columns hold. Very long texts are compared whole. An empty table stays
    empty, and columns with clashing names come back as they were.
    """
    names, text = docs.columns, docs.columns.index(text_col)
    plain = docs.toDF(*[f"__c{i}" for i in range(len(names))])
    rest = [f"__c{i}" for i in range(len(names)) if i != text]
    body = F.col(f"__c{text}")
    base = plain.select(F.col(f"__c{names.index(id_col)}").alias("id"), F.coalesce(body, F.lit("")).alias("body"), body.isNull().alias("none"), *rest)
    kept = _judged(base, _largest(keep)).where("place = 1")
    back = F.when(~F.col("none"), F.col("body")).alias(f"__c{text}")
    return kept.select(*[back if i == text else f"__c{i}" for i in range(len(names))]).toDF(*names)
