import hashlib

import pytest
from conftest import TESTDATA
from odd import same_rows

from sylvaframe.llm import warc
from sylvaframe.llm.queries import op10_warc


def brute(pages):
    least = {}
    for page, html in pages:
        raw = (html or "").encode()
        if len(raw) >= 100 and page is not None:
            least[raw] = min(page, least.get(raw, page))
    out = []
    for page, html in pages:
        raw = (html or "").encode()
        revisit = raw in least and page != least[raw]
        out.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", least[raw] if revisit else None))
    return out


def test_whole_table(spark):
    pages = spark.read.parquet(f"{TESTDATA}/sf0.01/pages.parquet").collect()
    same_rows(op10_warc(spark, f"{TESTDATA}/sf0.01"), brute([(r.page_id, r.html) for r in pages]))


@pytest.fixture
def pages(spark):
    long = "é" * 50
    rows = [(1, "http://a", None), (2, None, ""), (3, "u\r\nX: y", "short"), (4, "u", "short"), (9, "u", long), (8, "u", long), (7, None, long + "!"), (8, "again", long), (None, "u", long), (5, "u", "x" * 99), (6, "u", "x" * 99), (10, "u", "a\r\n\r\nWARC/1.1\r\n" * 30), (11, "u", "z" * 100_000)]
    return spark.createDataFrame([(*r, "d", "p", 1) for r in rows], "page_id bigint, url string, html string, digest string, payload string, payload_bytes int"), rows


def test_odd_rows(spark, tmp_path, pages):
    df, rows = pages
    warc.write_archive(df, str(tmp_path / "a"))
    records = warc.read_records(spark, str(tmp_path / "a"))
    read = warc.parsed(records)
    same_rows(read.selectExpr("page_id", "payload_bytes", "payload_digest", "record_type", "cast(refers_to as bigint)"), brute([(p, h) for p, _, h in rows]))
    assert read.where("header_digest <> payload_digest").count() == 0
    stored = spark.read.parquet(str(tmp_path / "a" / "payloads"))
    assert stored.count() == len({h or "" for _, _, h in rows})
    for r in records.collect():
        assert r.record.startswith(b"WARC/1.1\r\n") and r.record.endswith(b"\r\n\r\n")


def test_plain_files(spark, tmp_path, pages):
    df, rows = pages
    warc.write_archive(df, str(tmp_path / "a"))
    records = warc.read_records(spark, str(tmp_path / "a"))
    warc.write_warc_files(records, str(tmp_path / "w"))
    again = warc.read_warc_files(spark, str(tmp_path / "w"))
    assert sorted(bytes(r.header) + bytes(r.block) + b"\r\n\r\n" for r in again.collect()) == sorted(bytes(r.record) for r in records.collect())


def test_changed_payload_is_noticed(spark, tmp_path, pages):
    df, _ = pages
    warc.write_archive(df, str(tmp_path / "a"))
    bad = spark.read.parquet(str(tmp_path / "a" / "payloads")).selectExpr("digest", "concat(payload, X'00') as payload")
    bad.write.parquet(str(tmp_path / "b" / "payloads"))
    spark.read.parquet(str(tmp_path / "a" / "headers")).write.parquet(str(tmp_path / "b" / "headers"))
    with pytest.raises(Exception, match="changed"):
        warc.read_records(spark, str(tmp_path / "b")).collect()


def test_no_pages(spark, tmp_path):
    warc.write_archive(spark.createDataFrame([], "page_id bigint, url string, html string"), str(tmp_path / "a"))
    assert warc.parsed(warc.read_records(spark, str(tmp_path / "a"))).count() == 0
