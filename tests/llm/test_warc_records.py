import pytest
from odd import same_rows
from pyspark.sql import functions as F
from test_warc import brute, pages  # noqa: F401

from sylvaframe.llm import warc


def test_facts_come_from_the_bytes_of_the_records(spark, tmp_path, pages):  # noqa: F811
    df, rows = pages
    warc.write_archive(df, str(tmp_path / "a"))
    records = warc.read_records(spark, str(tmp_path / "a")).select("page_id", "record")
    got = warc.facts(records).selectExpr("page_id", "payload_bytes", "payload_digest", "record_type", "cast(nullif(refers_to, '') as bigint)")
    same_rows(got, brute([(p, h) for p, _, h in rows]))
    longer = records.withColumn("record", F.expr("case when page_id = 11 then concat(record, X'00') else record end"))
    with pytest.raises(Exception, match="not the length"):
        warc.facts(longer).collect()
    other = records.withColumn("record", F.expr("case when page_id = 11 then cast(replace(cast(record as string), 'zz', 'zy') as binary) else record end"))
    with pytest.raises(Exception, match="not the payload"):
        warc.facts(other).collect()
    with pytest.raises(Exception, match="not the payload"):  # the response that revisits name is gone
        warc.facts(records.where("page_id is null or page_id <> 8").where("page_id = 9")).collect()


def test_record_without_a_length(spark, tmp_path):
    (tmp_path / "x.warc").write_bytes(b"WARC/1.1\r\nWARC-Type: response\r\n\r\nabc\r\n\r\n")
    with pytest.raises(Exception, match="Content-Length"):
        warc.read_warc_files(spark, str(tmp_path)).collect()
