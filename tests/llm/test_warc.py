import base64
import hashlib

import pytest

from loomwright.llm.warc import END, MAGIC, _chain, read_warc, warc_round_trip, write_warc

FAKE = f"{MAGIC}WARC-Type: response\r\nWARC-Record-ID: <urn:x-page:99>\r\nContent-Length: 3{END}abc{END}"
LIAR = f"{MAGIC}WARC-Type: response\r\nContent-Length: 100000{END}"


def expected(pages, least=0):
    first = {}
    for key, _, html in pages:
        body = (html or "").encode()
        if key is not None:
            first[body] = min(first.get(body, key), key)
    rows = []
    for key, _, html in pages:
        body = (html or "").encode()
        again = len(body) >= least and body in first and (key is None or key > first[body])
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        rows.append((key, len(body), digest, "revisit" if again else "response", first[body] if again else None))
    return sorted(rows, key=str)


def result(df):
    rows = df.collect()
    assert all(r["digest_ok"] in (True, None) for r in rows)
    return sorted((tuple(r)[:5] for r in rows), key=str)


PAGES = [
    (1, "http://a/", "plain"), (2, "http://a/ b\n", "plain"), (3, None, None), (4, "u", ""), (5, "u", FAKE), (6, "u", f"x{FAKE}y{LIAR}z" * 3),
    (7, "u", MAGIC), (8, "u", MAGIC * 4), (9, "u", "é" * 5000 + FAKE * 40 + "ü" * 300), (10, "u", END), (None, "n", "null key"), (None, "n", "plain"),
    (2, "http://a/ b\n", "plain"), (11, "u", FAKE), (12, "u", LIAR + "w" * 3000), (13, "u", "WARC/1.0"), (14, "u", "WARC/1.0\r"), (15, "u", "\n" * 50),
]


@pytest.mark.parametrize("split", ["500", "128m"])
def test_round_trip_wherever_files_are_split(spark, split):
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(2)
        assert result(warc_round_trip(pages)) == expected(PAGES)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_least_bytes_and_clashing_columns(spark):
    pages = spark.createDataFrame([(*p, "x", 1) for p in PAGES[:5]], "page_id long, url string, html string, HTML string, block int")
    assert result(warc_round_trip(pages, least_bytes=6)) == expected(PAGES[:5], least=6)


def test_empty_table(spark):
    assert warc_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_chain_that_breaks_ends_there(spark, tmp_path):
    write_warc(spark.createDataFrame(PAGES[:2], "page_id long, url string, html string").coalesce(1), f"file://{tmp_path}/w", least_bytes=10)
    whole = b"".join(p.read_bytes() for p in sorted((tmp_path / "w").glob("part-*")))
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.warc").write_bytes(whole + b"garbage" + whole)
    (tmp_path / "b" / "y.warc").write_bytes(b"garbage" + whole)
    assert sorted(r["page_id"] for r in read_warc(spark, f"file://{tmp_path}/b").collect()) == [1, 2]


def test_chain_of_one_split():
    rows = [{"rel": -10, "len": 0, "head": None, "content": None}, {"rel": 0, "len": 20, "head": 10, "content": 6}, {"rel": 30, "len": 50, "head": 10, "content": 6}]
    assert [(r["exit"], r["tail"]) for r in _chain(rows)] == [(None, None), (None, None), (None, None)]
    rows[2]["len"] = 20
    assert [(r["exit"], r["tail"]) for r in _chain(rows)] == [(None, None), (60, 30), (60, 30)]
