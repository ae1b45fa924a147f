import datetime as dt
import os
import struct

import pytest

from payloom.operators import packets as P
from payloom.parsing import protocol_ranges
from payloom.plans import analysis
from payloom.sources import captures, texts

UTC = dt.timezone.utc


def ip(proto, body, version=4, ihl=5, total=None, options=b""):
    total = 4 * ihl + len(body) if total is None else total
    head = struct.pack(">BBHHHBBHII", version << 4 | ihl, 0, total, 0, 0, 64, proto, 0, 0x0A000001, 0x81060102)
    return head + options + body


def tcp(payload, sport=33000, dport=80, doff=5, flags=0, urgent=0):
    return struct.pack(">HHIIBBHHH", sport, dport, 0, 0, doff << 4, flags, 0, 0, urgent) + b"\0" * max(0, 4 * doff - 20) + payload


def udp(payload, size=None, sport=53, dport=40000):
    return struct.pack(">HHHH", sport, dport, 8 + len(payload) if size is None else size, 0) + payload


def frame(body, kind=0x0800):
    return b"\1" * 12 + struct.pack(">H", kind) + body


CASES = [
    ("tcp", frame(ip(6, tcp(b"hello"))), (6, 80, b"hello")),
    ("udp", frame(ip(17, udp(b"dns"))), (17, 53, b"dns")),
    ("icmp", frame(ip(1, b"\x08\0\0\0\0\0\0\0ping")), (1, 8, b"ping")),
    ("short icmp", frame(ip(1, b"\x03\0\0")), (1, 3, b"")),
    ("version", frame(ip(6, tcp(b"x"), version=5)), None),
    ("ihl", frame(ip(6, tcp(b"x"), ihl=4)), None),
    ("total", frame(ip(6, tcp(b"x"), total=10)), None),
    ("options", frame(ip(6, tcp(b"opt"), ihl=6, options=b"\0" * 4)), (6, 80, b"opt")),
    ("tcp options", frame(ip(6, tcp(b"opt", doff=7))), (6, 80, b"opt")),
    ("doff small", frame(ip(6, tcp(b"x", doff=4))), None),
    ("doff large", frame(ip(6, tcp(b"", doff=5)[:-4])), None),
    ("urgent", frame(ip(6, tcp(b"abc", flags=0x20, urgent=9))), None),
    ("udp short", frame(ip(17, udp(b"abc", size=7))), None),
    ("udp long", frame(ip(17, udp(b"abc", size=99))), None),
    ("udp trailing", frame(ip(17, udp(b"abc", size=9) + b"zz")), (17, 53, b"abczz")),
    ("padding", frame(ip(6, tcp(b""))) + b"\0" * 10, (6, 80, b"")),
    ("cut", frame(ip(6, tcp(b"abcdef")))[:-2], (6, 80, b"abcd")),
    ("vlan", frame(ip(6, tcp(b"x")), 0x8100), None),
    ("arp", frame(b"\0" * 40, 0x0806), None),
    ("ipv6", frame(b"\0" * 40, 0x86DD), None),
    ("nested", frame(ip(4, ip(6, tcp(b"in")))), (6, 80, b"in")),
    ("nested twice", frame(ip(4, ip(4, ip(17, udp(b"deep"))))), (17, 53, b"deep")),
    ("nested deep", frame(ip(4, ip(4, ip(4, ip(4, ip(4, ip(6, tcp(b"deepest")))))))), (6, 80, b"deepest")),
    ("nested broken", frame(ip(4, ip(4, b"\x45" * 12))), None),
    ("other", frame(ip(89, b"x" * 30)), None),
]


@pytest.fixture(scope="module")
def capture(tmp_path_factory):
    folder = tmp_path_factory.mktemp("pcap")
    captures.write_capture(str(folder / "a.pcap"), [(1_400_000_000_000_000 + i * 1_000_000, c[1]) for i, c in enumerate(CASES)])
    (folder / "sub").mkdir()
    captures.write_capture(str(folder / "sub" / "b.pcap"), [(1_400_000_100_000_000, CASES[0][1])])
    (folder / "junk").write_bytes(b"no capture")
    return folder


def test_decoding(spark, capture):
    for raw in (captures.read_captures(spark, str(capture / "a.pcap")), captures.read_captures_anywhere(spark, str(capture / "a.pcap"))):
        got = {r["pkt_no"]: (r["proto"], r["port"], bytes(r["payload"])) for r in P.decode(raw).collect()}
        assert got == {i: c[2] for i, c in enumerate(CASES) if c[2]}


def test_protocol_selection_applies_to_the_outer_header(spark, capture):
    raw = captures.read_captures(spark, str(capture / "a.pcap"))
    got = {r["pkt_no"] for r in P.decode(raw, protocol_ranges("tcp")).collect()}
    assert got == {i for i, c in enumerate(CASES) if c[2] and c[2][0] == 6 and "nested" not in c[0]}


def test_capture_files(spark, capture):
    rows = captures.read_captures(spark, str(capture))
    assert rows.groupBy("file").count().count() == 2 and rows.count() == len(CASES) + 1
    first = {r["file"].rsplit("/", 1)[1]: r["first_ts"] for r in captures.first_times(spark, str(capture)).collect()}
    assert first == {"a.pcap": dt.datetime(2014, 5, 13, 16, 53, 20), "b.pcap": dt.datetime(2014, 5, 13, 16, 55)}
    with pytest.raises(ValueError):
        list(captures.read_records(str(capture / "junk"), strict=True))


def test_file_selection(spark):
    day = lambda d: dt.datetime(2024, 1, d)
    files = spark.createDataFrame([(f"f{d}", day(d)) for d in range(1, 9)], "file string, first_ts timestamp")
    assert [r["file"] for r in P.select_files(files, dt.datetime(2024, 1, 3, 12), dt.datetime(2024, 1, 5, 12)).orderBy("file").collect()] == ["f3", "f4", "f5", "f6"]
    assert [r["file"] for r in P.select_files(files, dt.datetime(2024, 1, 3, 12), dt.datetime(2024, 1, 5, 12), limits=True).orderBy("file").collect()] == ["f3", "f6"]
    assert [r["file"] for r in P.select_files(files.limit(1), None, None, limits=True).collect()] == ["f1"]
    assert P.select_files(files.limit(0), None, None, limits=True).count() == 0


def test_late_packets_end_a_file(spark):
    rows = [("a", i, dt.datetime(2024, 1, 2 if i % 2 else 1)) for i in range(40)] + [("b", i, dt.datetime(2024, 1, 1)) for i in range(5)]
    got = P.stop_after(spark.createDataFrame(rows, "file string, pkt_no long, ts timestamp"), dt.datetime(2024, 1, 1, 12)).collect()
    assert sum(r["file"] == "a" for r in got) == 21 and sum(r["file"] == "b" for r in got) == 5


LOG = """[**] [1:17317:4] SPECIFIC-THREATS sample [**]
[Classification: Attempted Administrator Privilege Gain] [Priority: 1]
06/23-06:21:24.680462 129.6.140.210:33619 -> 129.6.100.251:22
TCP TTL:59 TOS:0x0 ID:3894 IpLen:20 DgmLen:100

06/24-00:00:00.5 10.0.0.1 -> 10.0.0.2
ICMP TTL:1
12/31-23:59:59.000001 1.2.3.4:1 -> 5.6.7.8:2"""


def test_alerts(spark, tmp_path):
    (tmp_path / "alert").write_text(LOG)
    rows = texts.read_alerts(spark, str(tmp_path), dt.date(2014, 6, 1), dt.date(2014, 7, 1)).orderBy("line_no").collect()
    assert [(r["ts"], r["dgmlen"], r["src"], r["dst"]) for r in rows] == [
        (dt.datetime(2014, 6, 23, 6, 21, 24, 680462), 100, 2164690130, 2164679931),
        (dt.datetime(2014, 6, 24, 0, 0, 0, 500000), 0, 167772161, 167772162),
    ]
    late = texts.read_alerts(spark, str(tmp_path), dt.date(2013, 12, 1), dt.date(2014, 2, 1)).collect()
    assert [(r["ts"].year, r["dgmlen"]) for r in late] == [(2013, 0)]


def test_alert_days_come_from_the_file(spark, tmp_path):
    (tmp_path / "alert").write_text(LOG)
    for day, want in ((dt.datetime(2015, 1, 2, tzinfo=UTC), [(2014, 12, 31)]), (dt.datetime(2013, 6, 24, tzinfo=UTC), [(2013, 6, 23), (2013, 6, 24)]), (dt.datetime(2013, 6, 23, tzinfo=UTC), [(2013, 6, 23)])):
        os.utime(tmp_path / "alert", (day.timestamp(), day.timestamp()))
        got = [r["ymd"] for r in texts.read_alerts(spark, str(tmp_path)).orderBy("ts").collect()]
        assert got == [dt.date(*d) for d in want]


def test_captures_of_other_stores(spark, capture):
    near, far = captures.read_captures(spark, str(capture)), captures.read_captures(spark, f"file://{capture}")
    assert sorted(map(tuple, near.drop("file").collect())) == sorted(map(tuple, far.drop("file").collect()))
    assert captures.read_captures(spark, captures.files_of(str(capture))).count() == near.count()
    first = {r["file"].rsplit("/", 1)[1]: r["first_ts"] for r in captures.first_times(spark, f"file://{capture}").collect()}
    assert first == {"a.pcap": dt.datetime(2014, 5, 13, 16, 53, 20), "b.pcap": dt.datetime(2014, 5, 13, 16, 55)}


def test_alert_labels(spark):
    t = dt.datetime(2024, 1, 1, 12)
    hour = dt.timedelta(hours=1)
    packets = spark.createDataFrame([(i, t + d, 1, 2) for i, d in enumerate([0 * hour, hour, -hour, 2 * hour, dt.timedelta(microseconds=1)])], "id int, ts timestamp, src long, dst long")
    alerts = spark.createDataFrame([(t, 9, 2), (t, 9, 2)], "ts timestamp, src long, dst long")
    assert sorted(r["id"] for r in P.match_alert_times(packets, alerts).collect()) == [0, 1, 2]
    assert sorted(r["id"] for r in P.match_alert_times(packets, alerts, False).collect()) == [3, 4]
    assert P.match_hosts(packets, P.alert_hosts(alerts, [])).count() == 5
    assert P.match_hosts(packets, P.alert_hosts(alerts, [(2, 0xFFFFFFFF)]), False).count() == 5
    assert P.match_hosts(packets, P.alert_hosts(alerts, [(0, 0)]), False, most=0).count() == 5


def test_hosts_and_numbers(spark, tmp_path):
    (tmp_path / "h").write_text("1.2.3.4\nbad\n1.2.3.4\n")
    assert [r["host"] for r in texts.hosts(spark, "1.2.3.4,5.6.7.8;1.2.3.4").orderBy("host").collect()] == [16909060, 84281096]
    assert [r["host"] for r in texts.read_hosts(spark, str(tmp_path / "h")).collect()] == [16909060]
    (tmp_path / "n").write_text("1 2.5\n x -3e2\n")
    assert [(r["pos"], r["x"]) for r in texts.read_numbers(spark, str(tmp_path / "n")).orderBy("pos").collect()] == [(0, 1.0), (1, 2.5), (3, -300.0)]


def test_analysis_of_captures(spark, capture, tmp_path):
    options = {"P": "tcp,udp,4", "N": "array", "n": "2-3", "T": "2014-05-13 16:53:20,2014-05-13 16:54:30"}
    rows = {r["n"]: r for r in analysis.run(spark, options, str(capture)).collect()}
    assert set(rows) == {2, 3} and rows[2]["mu"] * 65536 == pytest.approx(sum(max(0, len(c[2][2]) - 1) for c in CASES if c[2] and c[2][0] in (6, 17)))
    spec = analysis.Spec.parse({"I": "no", "P": "tcp", "E": "yes", "e": "3-5", "S": "0", "h": "10.0.0.0/8", "n": "3"})
    assert (spec.protocols_wanted, spec.entropy_wanted, spec.alerts_wanted, spec.low, spec.high, spec.store) == (False, True, False, 3, 3, "bloom")


@pytest.mark.parametrize("kind", ["array", "bloom"])
def test_analysis_keeps_stores(spark, capture, tmp_path, kind):
    packets = P.decode(captures.read_captures(spark, str(capture / "a.pcap")))
    store, dump = str(tmp_path / "store"), str(tmp_path / "dump")
    options = {"N": kind, "n": "2", "D": dump}
    once = analysis.analyse(packets, analysis.Spec.parse(options | {"A": store})).first()
    twice = analysis.analyse(packets, analysis.Spec.parse(options | {"a": store})).first()
    assert twice["mu"] == pytest.approx(2 * once["mu"]) and twice["max"] == 2 * once["max"]
    counters = [line.value.split(" ") for line in spark.read.text(dump).collect()]
    assert len(counters) > 10 and {int(c[0]) for c in counters} == {2} and max(int(c[2]) for c in counters) == twice["max"]
    again = analysis.analyse(packets, analysis.Spec.parse(options | {"A": store})).first()
    assert again["mu"] == pytest.approx(once["mu"])
    assert analysis.Spec.parse({"N": "small"}).size.k == 14 and analysis.Spec.parse({"N": "small"}).store == "bloom"
