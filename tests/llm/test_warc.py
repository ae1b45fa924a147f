import base64
import hashlib
from collections import defaultdict

import pytest
from pyspark.errors import PySparkException

from payloom.llm.common import shared_path
from payloom.llm.warc import read_headers, reconstruct, verified_payloads, write_archive

ROWS = [(1, "u1", "<p>é</p>"), (2, "u2", "<p>é</p>"), (3, None, None), (4, "u\r\n4", ""), (5, "u5", "x" * 100_000), (6, "u6", "<p>é</p>"), (7, "u7", "other"), (7, "u7", "other"), (None, "n", "other"), (None, "n", "alone")]
SCHEMA = "page_id bigint, url string, html string, id int, payload string, address string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA).repartition(3)


def expected(rows, least):
    by = defaultdict(list)
    for i, _, h in rows:
        by[h or ""].append(i)
    first = {h: min((i for i in ids if i is not None), default=None) for h, ids in by.items()}
    out = []
    for i, _, h in rows:
        body = (h or "").encode()
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        response = i == first[h or ""] or len(body) < least
        out.append((i, digest, "response" if response else "revisit", None if response else first[h or ""]))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 6])
def test_records(spark, least):
    path = shared_path(spark, "t")
    write_archive(table(spark, ROWS), path, min_revisit_bytes=least)
    got = sorted(((r["id"], r["digest"], r["record_type"], r["refers_to"]) for r in read_headers(spark, path).collect()), key=str)
    assert got == expected(ROWS, least)
    assert verified_payloads(spark, path).count() == len({h or "" for _, _, h in ROWS})
    for r in reconstruct(spark, path).collect():
        head, _, rest = bytes(r["record"]).partition(b"\r\n\r\n")
        size = int(head.rsplit(b"Content-Length: ", 1)[1])
        assert rest[size:] == b"\r\n\r\n"
        if b"WARC-Type: response" in head:
            assert rest[:size].partition(b"\r\n\r\n")[2] == bytes(r["payload"])


def test_empty_and_damaged(spark):
    path = shared_path(spark, "t")
    write_archive(table(spark, []), path)
    assert read_headers(spark, path).count() == 0 and reconstruct(spark, path).count() == 0
    path = shared_path(spark, "t")
    write_archive(table(spark, ROWS), path)
    bad = spark.read.parquet(f"{path}/payloads").selectExpr("address", "first_id", "concat(payload, X'00') AS payload")
    bad.write.parquet(f"{path}-bad/payloads")
    with pytest.raises(PySparkException):
        verified_payloads(spark, f"{path}-bad").collect()
