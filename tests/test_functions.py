import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from payloom import parsing as R
from payloom.functions import hashing as H
from payloom.functions import measures as M

# Published test values of FNV.
GOLDEN = {
    ("1", 64): {b"": "cbf29ce484222325", b"a": "af63bd4c8601b7be", b"foobar": "340d8765a4dda9c2"},
    ("1a", 64): {b"": "cbf29ce484222325", b"a": "af63dc4c8601ec8c", b"foobar": "85944171f73967e8"},
    ("0", 64): {b"": "0000000000000000"},
    ("1", 32): {b"": "811c9dc5", b"a": "050c5d7e", b"foobar": "31f0b262"},
    ("1a", 32): {b"": "811c9dc5", b"a": "e40c292c", b"foobar": "bf9cf968"},
}


def plain(data, variant, bits):
    basis, prime = {32: (0x811C9DC5, 16777619), 64: (0xCBF29CE484222325, 1099511628211)}[bits]
    h = 0 if variant == "0" else basis
    for b in data:
        if variant == "1a":
            h = (h ^ b) * prime % (1 << bits)
        else:
            h = h * prime % (1 << bits) ^ b
    return h


def test_fnv(spark):
    rng = random.Random(1)
    data = [b"", b"a", b"foobar"] + [rng.randbytes(rng.randint(0, 40)) for _ in range(100)]
    df = spark.createDataFrame([(d,) for d in data], "d binary")
    for variant in ("0", "1", "1a"):
        got = df.select("d", H.fnv64(F.col("d"), variant).alias("l"), H.fnv32(F.col("d"), variant).alias("s")).collect()
        for r in got:
            d = bytes(r["d"])
            assert r["l"] == f"{plain(d, variant, 64):016x}" and r["s"] == plain(d, variant, 32)
            assert GOLDEN[variant, 64].get(d, r["l"]) == r["l"]
            assert GOLDEN.get((variant, 32), {}).get(d, f"{r['s']:08x}") == f"{r['s']:08x}"


def test_prefix_hashes_equal_direct_ones(spark):
    df = spark.createDataFrame([(random.Random(i).randbytes(i),) for i in range(0, 30)], "d binary")
    for r in df.select("d", H.fnv64_prefixes(F.col("d"), 2, 9).alias("p")).collect():
        d = bytes(r["d"])
        assert [(x["n"], x["hi"] << 32 | x["lo"]) for x in r["p"]] == [(n, plain(d[:n], "1", 64)) for n in range(2, min(9, len(d)) + 1)]


@pytest.mark.parametrize(
    ("text", "c", "b", "want"),
    [
        (b"", 0, 0, (0xDEADBEEF, 0xDEADBEEF)),
        (b"", 0, 0xDEADBEEF, (0xBD5B7DDE, 0xDEADBEEF)),
        (b"", 0xDEADBEEF, 0xDEADBEEF, (0x9C093CCD, 0xBD5B7DDE)),
        (b"Four score and seven years ago", 0, 0, (0x17770551, 0xCE7226E6)),
        (b"Four score and seven years ago", 0, 1, (0xE3607CAE, 0xBD371DE4)),
        (b"Four score and seven years ago", 1, 0, (0xCD628161, 0x6CBEA4B3)),
    ],
)
def test_lookup3(text, c, b, want):
    assert H.lookup3(text, c, b) == want


def test_entropy_and_rendering(spark):
    rows = [(b"",), (b"aaaa",), (bytes(range(256)),), (None,), (b"ab\x00~",)]
    got = spark.createDataFrame(rows, "d binary").select(M.byte_entropy("d").alias("e"), M.printable(F.col("d")).alias("p"), M.nonzero_byte(F.col("d")).alias("z")).collect()
    assert [r["e"] for r in got] == [0, 0, 8, None, 2]
    assert got[4]["p"] == "ab(0)~" and [r["z"] for r in got] == [False, True, True, None, True]


def test_ranges():
    assert R.int_ranges("80") == [R.Span(80, 80)]
    assert R.int_ranges("2-6,34-90") == R.int_ranges("2:6;34-90") == [R.Span(2, 6), R.Span(34, 90)]
    assert R.int_ranges("0x50 010") == [R.Span(80, 80), R.Span(8, 8)]
    assert R.port_ranges("http;ftp-ssh") == [R.Span(80, 80), R.Span(21, 22)]
    assert R.protocol_ranges("tcp,17") == [R.Span(6, 6), R.Span(17, 17)]
    assert R.int_ranges("5-0")[0].holds(10**9) and not R.int_ranges("5-0")[0].holds(4)
    assert R.int_ranges("0")[0].holds(7) and R.int_ranges("") == [] and R.double_ranges("3.5-4")[0] == R.Span(3.5, 4.0)


def test_flags_times_networks():
    assert all(map(R.yes, "yes true on in select 1 5".split()))
    assert not any(map(R.yes, "no off out deselect 0 -1 banana".split()))
    assert R.time("2014-03-01 10:20") == dt.datetime(2014, 3, 1, 10, 20) and R.time("nonsense") is None
    assert R.time_range("20140101,") == (dt.datetime(2014, 1, 1), None)
    assert R.day_range("20140101-20150101") == (dt.date(2014, 1, 1), dt.date(2015, 1, 1))
    assert R.next_day(dt.date(2024, 2, 28)) == dt.date(2024, 2, 29) and R.previous_day(dt.date(2024, 3, 1)) == dt.date(2024, 2, 29)
    assert R.window_of(dt.datetime(2024, 1, 10)) == (dt.date(2024, 1, 3), dt.date(2024, 1, 11))
    assert R.cidr("10.0.0.5/28") == (167772160, 0xFFFFFFF0) and R.cidr("1.2.3.4")[1] == 0xFFFFFFFF and R.cidr("1.2.3.4/0") == (0, 0)
    assert R.address("0x7f000001") == R.address("127.0.0.1") == 2130706433 and R.address6("::1") == 1


def test_lists_and_numbers(tmp_path):
    (tmp_path / "l").write_text("a b\nc\n")
    assert R.list_or_file(f"file={tmp_path / 'l'}") == "a;b;c" and R.list_or_file("x,y") == "x,y"
    assert R.tokens(",a;;b c") == ["a", "b", "c"] and R.quoted_tokens('a "b c" d') == ["a", "b c", "d"]
    assert R.word_tokens("10.0.0.1:80->x", ".") == ["10.0.0.1", "80", "x"]
    assert R.is_number("") and R.is_number("12") and not R.is_number("1a")
    assert R.hexadecimal("ffz") == 255 and R.integer("-0x10") == -16
    assert R.to_fixed("1.25", 100) == 125 and R.to_fixed("-1.255", 100) == -126 and R.from_fixed(-1256, 1000, 2) == "-1.25"
