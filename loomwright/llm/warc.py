"""WARC archives: writing with revisit records, and reading with boundary-chain verification.

Writing: payloads are grouped by digest; of equal payloads the smallest key's record is the response
and the others revisit it. Records are written with Spark's text sink, so the archives go wherever
Spark writes.

Reading: Spark splits the archives at every occurrence of the magic line, real record or payload.
Each task emits its candidates, with the offset where the record that a candidate claims to be would
be followed by the next. Inside a split the candidates are chained at once; between splits, pointer
jumping from the start of each file doubles the distance with every round. Only what is reachable
is a record; other occurrences of the magic are pieces of the record that they lie in.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwright.llm.common import pick, shared_path, stored, values

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
KEY = "urn:x-page:"
#: Groups of equal payloads (about 60 bytes each) that are broadcast; more are joined by a shuffle.
BROADCAST_GROUPS = 300_000
SEGMENT = (
    "file string, block long, idx long, rel long, len long, head long, content long, kind string, key long, refers long, "
    "declared string, payload_bytes long, digest string, complete boolean, exit long, tail long"
)


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column, without Python: 20 bits at a time."""
    digits = F.sha1(payload)
    quads = [F.lpad(F.conv(F.substring(digits, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.lower(F.concat(*quads)), "0123456789abcdefghijklmnopqrstuv", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_warc(pages: DataFrame, path: str, key_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> None:
    """Writes a record for each page to archives under ``path``.

    The payload is the text in UTF-8; null counts as empty. Of equal payloads of at least
    ``least_bytes`` bytes, the pages with the smallest key (null keys last) are responses, and the
    others revisit that key. Smaller ones are all responses. A null key or url is left out of the
    record. White space and control characters of a url become %XX. Repeated rows are written each; of
    rows that tie for the smallest key all are responses. A very long payload is one record, held whole
    by one task. An empty table gives archives without a record; columns are found by exact name, and
    others, whatever their names, are not looked at.
    """
    rows = pick(pages, key=key_col, url=url_col, html=html_col).select("key", "url", F.coalesce("html", F.lit("")).alias("body"))
    rows = rows.withColumns({"sha": F.sha1(F.col("body").cast("binary")), "n": F.octet_length("body").cast("long")})
    groups = rows.where(F.col("n") >= least_bytes).groupBy("sha", "n").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("copies"))
    groups = stored(groups.where("copies > 1").drop("copies"), "warc-groups")
    few = groups.count() <= BROADCAST_GROUPS
    rows = rows.join(F.broadcast(groups) if few else groups, ["sha", "n"], "left")
    revisit = F.col("first").isNotNull() & (F.col("key").isNull() | (F.col("key") > F.col("first")))
    url = F.col("url")
    for c in (*range(0x21), 0x7F):
        url = F.replace(url, F.lit(chr(c)), F.lit(f"%{c:02X}"))
    block = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(END),
        F.when(revisit, "").otherwise(F.col("body")),
    )
    named = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    identity = lambda c: F.concat(F.lit(f"<{KEY}"), c.cast("string"), F.lit(">"))
    record = F.concat(
        F.lit(MAGIC), F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit("\r\n"),
        named("WARC-Record-ID", identity(F.col("key"))), F.lit("WARC-Date: 2020-01-01T00:00:00Z\r\n"), named("WARC-Target-URI", url),
        named("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_sha1(F.col("body").cast("binary")))),
        F.when(revisit, F.concat(named("WARC-Profile", F.lit(PROFILE)), named("WARC-Refers-To", identity(F.col("first"))))).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length("block").cast("string"), F.lit(END), F.col("block"),
    )
    rows.withColumn("block", block).select(record.alias("value")).write.option("lineSep", END).text(path)


_FIELD = re.compile(rb"^([A-Za-z-]+):[ \t]*(.*?)[ \t]*$", re.M)


def _fields(head: bytes) -> dict[bytes, bytes]:
    return {k.lower(): v for k, v in _FIELD.findall(head.replace(b"\r\n", b"\n"))}


def _number(digits: bytes | None) -> int | None:
    return int(digits) if digits and re.fullmatch(rb"[0-9]{1,18}", digits) else None


def _page_key(value: bytes | None) -> int | None:
    found = re.fullmatch(rb"<%s(-?[0-9]{1,19})>" % KEY.encode(), value or b"")
    return int(found[1]) if found else None


def _payload(kind: bytes, block: bytes) -> tuple[int | None, str]:
    """Length and digest of the payload of a whole block: of an HTTP message, what follows its header."""
    body = block
    if kind.startswith(b"application/http"):
        head, _, body = block.partition(END.encode())
        if not body and (told := _number(_fields(head).get(b"content-length"))) is not None:
            return told, base64.b32encode(hashlib.sha1(b"").digest()).decode()
    return len(body), base64.b32encode(hashlib.sha1(body).digest()).decode()


def _segment(data: bytes) -> dict:
    """What follows an occurrence of the magic line, as the record that it claims to be."""
    out = dict.fromkeys(("head", "content", "kind", "key", "refers", "declared", "payload_bytes", "digest"))
    out["complete"] = False
    cut = data.find(END.encode())
    fields = _fields(data[:cut]) if cut >= 0 else {}
    content = _number(fields.get(b"content-length"))
    if content is None or b"warc-type" not in fields:
        return out
    head = cut + len(END)
    out |= {"head": head, "content": content, "kind": fields[b"warc-type"].decode("utf-8", "replace"), "key": _page_key(fields.get(b"warc-record-id"))}
    out |= {"refers": _page_key(fields.get(b"warc-refers-to")), "declared": fields.get(b"warc-payload-digest", b"").decode("utf-8", "replace").removeprefix("sha1:") or None}
    if len(data) >= head + content:
        out["complete"] = True
        out["payload_bytes"], out["digest"] = _payload(fields.get(b"content-type", b""), data[head : head + content])
    return out


def _batches(rows: list[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), 10_000):
        yield pa.RecordBatch.from_pylist(rows[i : i + 10_000], schema=schema)


_ARROW = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}


def _schema(fields: str) -> pa.Schema:
    return pa.schema([(name, _ARROW[kind]) for name, kind in (x.split() for x in fields.split(", "))])


def _chain(rows: list[dict]) -> list[dict]:
    """Sets exit (first claimed offset beyond the split) and tail (last record before it) along the chains."""
    beyond = rows[-1]["rel"] + rows[-1]["len"] + len(MAGIC)  # where the next split's first candidate starts
    at = {r["rel"]: r for r in rows}
    for r in reversed(rows):
        r["exit"] = r["tail"] = None
        if r["head"] is not None:
            after = r["rel"] + len(MAGIC) + r["head"] + r["content"] + len(END)
            if after >= beyond:
                r["exit"], r["tail"] = after, r["rel"]
            elif after in at:
                r["exit"], r["tail"] = at[after]["exit"], at[after]["tail"]
    return rows


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates of each split. rel: offset of the magic, from the end of the first magic before or in the split."""
    schema, held, now, idx, rel = _schema(SEGMENT), [], None, 0, 0
    for b in batches:
        for file, block, data in zip(*map(values, b.columns), strict=True):
            if (file, block) != now:
                if held:
                    yield from _batches(_chain(held), schema)
                # A file's first segment is what precedes its first magic; elsewhere a magic came before.
                held, now, idx, rel = [], (file, block), 0, -len(MAGIC)
            if block == 0 and idx == 0:
                parsed = _segment(b"") | {"len": len(data)}
            else:
                parsed = _segment(data) | {"len": len(data)}
            held.append(parsed | {"file": file, "block": block, "idx": idx, "rel": rel})
            idx, rel = idx + 1, rel + len(data) + len(MAGIC)
    if held:
        yield from _batches(_chain(held), schema)


def _walk(pdf):
    """The records of one split, from its entry on; owner is the record that a segment belongs to."""
    import numpy as np

    pdf = pdf.sort_values("off", kind="stable").reset_index(drop=True)
    offs, after, entry = pdf["off"].to_numpy(), pdf["after"], pdf["entry"].iloc[0]
    real, owner = np.zeros(len(pdf), dtype=bool), [None] * len(pdf)
    at = dict(zip(offs.tolist(), range(len(offs)), strict=True))
    here, last = (None if entry != entry or entry is None else int(entry)), None
    while here is not None and here in at:
        real[at[here]] = True
        nxt = after.iloc[at[here]]
        here = None if nxt != nxt or nxt is None else int(nxt)
    for i in range(len(pdf)):
        last = int(offs[i]) if real[i] else last
        owner[i] = last
    pdf["real"] = real
    pdf["owner"] = pa.array(owner, pa.int64()).to_pandas(integer_object_nulls=True)
    return pdf[["file", "block", "idx", "off", "real", "owner"]]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The segments of each split with their number."""
    now, idx = None, 0
    for b in batches:
        numbers = []
        for file, block in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            idx, now = (idx + 1, now) if (file, block) == now else (0, (file, block))
            numbers.append(idx)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(numbers, pa.int64()), b.column(2)], names=["file", "block", "idx", "data"])


def _assembled(pdf):
    """One record whose payload holds the magic, put together from its segments."""
    import pandas as pd

    pdf = pdf.sort_values("off")
    data = MAGIC.encode().join(map(bytes, pdf["data"]))
    parsed = _segment(data)
    return pd.DataFrame({"file": [pdf["file"].iloc[0]], "off": [pdf["owner"].iloc[0]], "payload_bytes2": [parsed["payload_bytes"]], "digest2": [parsed["digest"]]})


def _reachable(entries: DataFrame, name: str) -> DataFrame:
    """The (file, off) reachable from offset 0 of each file by jumps from off to exit, by doubling them."""
    jumps = stored(entries.select("file", "off", "exit"), name)
    found = stored(jumps.where("off = 0").select("file", "off"), name)
    known, before = found.count(), -1
    while known != before:
        before = known
        further = found.join(jumps, ["file", "off"]).where("exit is not null").select("file", F.col("exit").alias("off"))
        found = stored(found.union(further).distinct(), name)
        known = found.count()
        if known != before:
            second = jumps.select("file", F.col("off").alias("exit"), F.col("exit").alias("exit2"))
            jumps = stored(jumps.join(second, ["file", "exit"]).select("file", "off", F.col("exit2").alias("exit")), name)
    return found


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives under ``path``: page_id, payload_bytes, payload_digest, record_type, refers_to, digest_ok.

    Archives are uncompressed and may be split anywhere. Payload length and digest are computed from
    the bytes read; those of a revisit are what its headers say. digest_ok tells whether the digest
    equals the header's (null without one). Records without a page key have a null page_id, and repeated
    records are read each. A file that doesn't start with a record, or an empty one, has none; a chain
    that breaks ends there. A very long payload is put together in one task if it holds the magic line.
    """
    lines = spark.read.option("lineSep", MAGIC).text(path)
    split = lines.select("_metadata.file_path", "_metadata.file_block_start", F.col("value").cast("binary"))
    meta = stored(split.mapInArrow(_segments, SEGMENT), "warc-meta")
    # A split starts where the ones before it in the file end; a file has few splits, and a row for each is small.
    sizes = meta.groupBy("file", "block").agg(F.sum(F.col("len") + len(MAGIC)).alias("size"))
    order = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("file", "block", F.coalesce(F.sum("size").over(order), F.lit(0)).alias("base"))
    meta = meta.join(base, ["file", "block"])
    absolute = {c: F.col(c) + F.col("base") for c in ("exit", "tail")} | {"off": F.col("rel") + F.col("base")}
    after = F.col("off") + len(MAGIC) + F.col("head") + F.col("content") + len(END)
    meta = stored(meta.withColumns(absolute).withColumn("after", after).drop("rel", "base"), "warc-meta")
    exits = meta.where("exit is not null").select("file", F.col("exit").alias("off")).distinct()
    entries = meta.where("head is not null").join(exits.unionByName(meta.select("file", F.lit(0).cast("long").alias("off")).distinct()).distinct(), ["file", "off"], "left_semi")
    reached = _reachable(entries, "warc-entries")
    entered = entries.join(reached, ["file", "off"]).select("file", "block", F.col("off").alias("entry"), "tail", "exit")
    walked = meta.select("file", "block", "idx", "off", "after").join(entered.groupBy("file", "block").agg(F.min("entry").alias("entry")), ["file", "block"], "left")
    walked = stored(walked.groupBy("file", "block").applyInPandas(_walk, "file string, block long, idx long, off long, real boolean, owner long"), "warc-walked")
    records = meta.join(walked.where("real").select("file", "off"), ["file", "off"])
    broken = records.where("not complete").select("file", F.col("off").alias("owner"))
    if broken.limit(1).count():
        spans = entered.where("tail is not null").select("file", "tail", "exit")
        leading = walked.where("owner is null").join(spans, "file").where("off > tail and off < exit").select("file", "block", "idx", "off", F.col("tail").alias("owner"))
        owned = walked.where("owner is not null").select("file", "block", "idx", "off", "owner").unionByName(leading).join(broken, ["file", "owner"], "left_semi")
        pieces = split.mapInArrow(_pieces, "file string, block long, idx long, data binary").join(owned, ["file", "block", "idx"])
        whole = pieces.groupBy("file", "owner").applyInPandas(_assembled, "file string, off long, payload_bytes2 long, digest2 string")
        records = records.join(whole, ["file", "off"], "left")
        records = records.withColumns({"payload_bytes": F.coalesce("payload_bytes", "payload_bytes2"), "digest": F.coalesce("digest", "digest2")})
    told = F.when(F.col("kind") == "revisit", F.coalesce("declared", "digest")).otherwise(F.col("digest"))
    return records.select(
        F.col("key").alias("page_id"), "payload_bytes", told.alias("payload_digest"), F.col("kind").alias("record_type"),
        F.col("refers").alias("refers_to"), F.when(F.col("kind") != "revisit", F.col("digest") == F.col("declared")).alias("digest_ok"),
    )


def warc_round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes all pages to new archives in the shared folder and reads them back.

    Nulls, empty and very long payloads, ties, repeated rows, an empty table and columns with clashing
    names as in :func:`write_warc` and :func:`read_warc`.
    """
    path = shared_path(pages.sparkSession, "warc")
    write_warc(pages, path, least_bytes=least_bytes)
    return read_warc(pages.sparkSession, path)
