"""Queries over the test tables, each with SQL that gives the same rows.

Packets are made from documents: the text's bytes in blocks of 1460, header columns by arithmetic on doc_id, times from events.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from payloom.functions import hashing as H
from payloom.functions import measures as M
from payloom.operators import corpora as C
from payloom.operators import grams as G
from payloom.operators import packets as P
from payloom.operators import statistics as S
from payloom.operators.stores import BloomStore, ExactStore, bloom_distinct
from payloom.parsing import Span, cidrs, int_ranges, port_ranges, protocol_ranges
from payloom.plans.analysis import Spec, analyse, services
from payloom.sources.captures import parse_captures
from payloom.sources.texts import parse_alerts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

BLOCK = 1460
SAFE = "10.0.0.0/28,129.6.64.0/18"
#: A small filter, so that both engines fill it in seconds.
BLOOM = {"k": 5, "m_of": {3: 1_000_003, 5: 1_000_003}}
START, END = dt.datetime(2024, 1, 1, 6), dt.datetime(2024, 1, 2, 12)


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- the packets, in both engines


def packets(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select("doc_id", F.col("source").alias("file"), F.col("text").cast("binary").alias("payload"))
    rows = G.chunks(docs, BLOCK, keep=("doc_id", "file")).withColumn("seq", F.col("seq").cast("long"))
    times = read(spark, sf, "events").select(F.col("event_id").alias("doc_id"), F.col("ts").alias("t"))
    d = F.col("doc_id")
    port = F.when(d % 10 >= 9, d % 19).otherwise(F.least(F.lit(1024) + (d * 7919) % 60000, reduce(lambda acc, p: F.when(d % 5 == p[0], p[1]).otherwise(acc), enumerate((80, 443, 22, 53, 25)), F.lit(None).cast("long"))))
    return rows.join(times, "doc_id").select(
        (d * 1000 + F.col("seq")).alias("pkt_id"), "seq", "doc_id", "file", (F.col("t") + F.make_dt_interval(secs=F.col("seq") / 1000)).alias("ts"),
        F.when(d % 10 < 7, 6).when(d % 10 < 9, 17).otherwise(1).alias("proto"), (F.lit(167772160) + d % 500).alias("src"), (F.lit(2164654080) + (d * 31) % 65536).alias("dst"), port.alias("port"), "payload",
    )


PACKETS = """packets AS (
  SELECT d.doc_id * 1000 + seq AS pkt_id, seq, d.doc_id, d.source AS file, e.ts + to_milliseconds(seq) AS ts,
    CASE WHEN d.doc_id % 10 < 7 THEN 6 WHEN d.doc_id % 10 < 9 THEN 17 ELSE 1 END AS proto,
    167772160 + d.doc_id % 500 AS src, 2164654080 + (d.doc_id * 31) % 65536 AS dst,
    CASE WHEN d.doc_id % 10 >= 9 THEN d.doc_id % 19 ELSE least(1024 + (d.doc_id * 7919) % 60000, CASE d.doc_id % 5 WHEN 0 THEN 80 WHEN 1 THEN 443 WHEN 2 THEN 22 WHEN 3 THEN 53 ELSE 25 END) END AS port,
    substring(h, seq * 2920 + 1, 2920) AS p
  FROM (SELECT doc_id, source, hex(text) AS h, unnest(range(0, greatest(1, ceil(strlen(text) / 1460.0)::BIGINT))) AS seq FROM documents) d
  JOIN events e ON e.event_id = d.doc_id)"""
ALERTS = "alerts AS (SELECT ts + (event_id % 3 - 1) * INTERVAL 1 HOUR AS ts, 167772160 + event_id % 500 AS src, 2164654080 + (event_id * 31) % 65536 AS dst FROM events WHERE event_type = 'error')"
LISTED = "listed AS (SELECT DISTINCT 167772160 + doc_id % 500 AS host FROM labels WHERE toxic = 1)"
ENTROPY = """ent AS (
  SELECT pkt_id, round(sum(c * log2(l / c::DOUBLE)) / any_value(l), 6) AS entropy
  FROM (SELECT pkt_id, b, count(*) AS c, any_value(l) AS l FROM (SELECT pkt_id, length(p) / 2 AS l, substring(p, 2 * i + 1, 2) AS b FROM (SELECT pkt_id, p, unnest(range(0, length(p) // 2)) AS i FROM packets)) GROUP BY pkt_id, b)
  GROUP BY pkt_id)"""
IDS = "pkt_id, file, ts, proto, src, dst, port, length(p) // 2 AS size"


def alerts(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "events").where("event_type = 'error'")
    return rows.select((F.col("ts") + F.make_dt_interval(hours=(F.col("event_id") % 3 - 1).cast("int"))).alias("ts"), (F.lit(167772160) + F.col("event_id") % 500).alias("src"), (F.lit(2164654080) + (F.col("event_id") * 31) % 65536).alias("dst"))


def listed(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "labels").where("toxic = 1").select((F.lit(167772160) + F.col("doc_id") % 500).alias("host")).distinct()


def ids(df: DataFrame) -> DataFrame:
    return df.select("pkt_id", "file", "ts", "proto", "src", "dst", "port", F.length("payload").cast("long").alias("size"))


def grams_sql(n: int, source: str = "packets", payload: str = "p", keep: str = "") -> str:
    return f"SELECT {keep}{n} AS n, i AS pos, substring({payload}, 2 * i + 1, {2 * n}) AS g FROM (SELECT {keep}{payload}, unnest(range(0, length({payload}) // 2 - {n} + 1)) AS i FROM {source} WHERE length({payload}) // 2 >= {n})"


def docs_sql(n: int) -> str:
    """Whole texts in overlapping blocks, so that each gram of n bytes starts in one block."""
    return f"docs AS (SELECT substring(h, s * 2920 + 1, 2920 + {2 * (n - 1)}) AS p FROM (SELECT hex(text) AS h, unnest(range(0, greatest(1, ceil(strlen(text) / 1460.0)::BIGINT))) AS s FROM documents))"


def counts_sql(n: int, **more) -> str:
    return f"SELECT n, g, count(*) AS cnt FROM ({grams_sql(n, **more)}) GROUP BY n, g"


def hexed(counts: DataFrame) -> DataFrame:
    return counts.withColumn("g", F.hex("g"))


def r6(*names: str) -> list:
    return [F.round(F.col(c), 6).alias(c) for c in names]


# --- grams


def _count_query(n: int) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return hexed(G.gram_counts(packets(spark, sf), n))

    run.__name__ = f"gram_count_n{n}"
    query(f"WITH {PACKETS} {counts_sql(n)}")(run)


for _n in (1, 2, 3, 4, 5, 10):
    _count_query(_n)


@query(f"WITH {PACKETS} {' UNION ALL '.join(counts_sql(n) for n in (2, 3, 4))}")
def gram_count_range(spark, sf):
    return hexed(G.gram_counts(packets(spark, sf), 2, 4))


@query(f"WITH {PACKETS}, long AS (SELECT p FROM packets WHERE length(p) // 2 >= 39) {' UNION ALL '.join(counts_sql(n, source='long') for n in (2, 40))}")
def gram_count_compat(spark, sf):
    return hexed(G.gram_counts(packets(spark, sf), 2, 40, compat=True, only=(2, 40)))


@query(f"WITH {PACKETS} SELECT n, count(*) AS rows_, sum(pos)::BIGINT AS positions, count(DISTINCT g) AS grams FROM ({grams_sql(6)}) GROUP BY n")
def gram_explode(spark, sf):
    return G.explode_grams(packets(spark, sf), 6).groupBy("n").agg(F.count("*").alias("rows_"), F.sum("pos").cast("long").alias("positions"), F.count_distinct("g").alias("grams"))


_STATS = "round(s / m, 6) AS mu, round(sqrt((q - s * s / m) / (m - 1)), 6) AS sigma, max, CASE WHEN nz < m THEN 0 ELSE least END AS min, round((q - s * s / m) / (s / m), 3) AS chi_square, nz AS nonzero"


def stats_sql(counts: str, m: float) -> str:
    return f"SELECT n, {_STATS} FROM (SELECT n, sum(cnt)::DOUBLE AS s, sum(cnt::DOUBLE * cnt) AS q, max(cnt) AS max, min(cnt) AS least, count(*) AS nz, {float(m)}::DOUBLE AS m FROM ({counts}) GROUP BY n)"


def _stats(df: DataFrame) -> DataFrame:
    return df.select("n", *r6("mu", "sigma"), "max", F.col("min").cast("long").alias("min"), F.round("chi_square", 3).alias("chi_square"), "nonzero")


@query(f"WITH {docs_sql(3)} {stats_sql(counts_sql(3, source='docs'), 256**3)}")
def gram_summary_exact(spark, sf):
    docs = read(spark, sf, "documents").select(F.col("text").cast("binary").alias("payload"))
    return _stats(ExactStore.build(docs, 3).stats())


@query(f"WITH {PACKETS} SELECT n, sum(cnt)::BIGINT AS total, count(*) AS distinct_grams, count(*) FILTER (cnt >= 100) AS ge_100, count(*) FILTER (cnt >= 1000) AS ge_1000, count(*) FILTER (cnt >= 10000) AS ge_10000 FROM ({counts_sql(3)}) GROUP BY n")
def gram_thresholds(spark, sf):
    return S.gram_thresholds(G.gram_counts(packets(spark, sf), 3))


@query(f"WITH {PACKETS} SELECT g, cnt FROM ({counts_sql(4)}) ORDER BY cnt DESC, g LIMIT 50")
def gram_top(spark, sf):
    return hexed(G.gram_counts(packets(spark, sf), 4)).orderBy(F.desc("cnt"), "g").limit(50).select("g", "cnt")


@query(f"WITH {PACKETS} SELECT n, g, least(cnt, 65520) AS counter, greatest(cnt - 65520, 0) AS overflow FROM ({counts_sql(1)})")
def gram_saturated(spark, sf):
    return hexed(ExactStore.build(packets(spark, sf), 1).counters())


@query(f"WITH {PACKETS} SELECT g, cnt, list_aggregate(list_transform([substring(g, 2 * i + 1, 2) FOR i IN range(0, 3)], lambda b: CASE WHEN b >= '20' AND b <= '7E' THEN chr(('0x' || b)::INT) ELSE '(' || ('0x' || b)::INT || ')' END), 'string_agg', '') AS shown FROM ({counts_sql(3)}) WHERE cnt >= 100")
def gram_report(spark, sf):
    counts = G.gram_counts(packets(spark, sf), 3).where("cnt >= 100")
    return hexed(counts.withColumn("shown", M.printable(F.col("g")))).select("g", "cnt", "shown")


@query(f"WITH {PACKETS} SELECT g, cnt, ('0x' || g)::BIGINT AS number FROM ({counts_sql(4)})")
def gram_packed(spark, sf):
    counts = G.gram_counts(packets(spark, sf), 4)
    rows = counts.select(F.col("g"), "cnt", M.packed(F.col("g")).alias("number"))
    return rows.select(F.hex(M.unpacked(F.col("number"), 4)).alias("g"), "cnt", "number")


# --- selection


@query(f"WITH {PACKETS}, {ENTROPY} SELECT pkt_id, coalesce(entropy, 0) AS entropy FROM packets LEFT JOIN ent USING (pkt_id)")
def payload_entropy(spark, sf):
    return packets(spark, sf).select("pkt_id", F.round(M.byte_entropy(F.col("payload")), 6).alias("entropy"))


def _select(name: str, where: str, f: Callable[[DataFrame], DataFrame], ctes: str = "") -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return ids(f(packets(spark, sf)))

    run.__name__ = name
    query(f"WITH {PACKETS}{ctes} SELECT {IDS} FROM packets WHERE {where}")(run)


_select("entropy_select", "length(p) = 0 OR pkt_id IN (SELECT pkt_id FROM ent WHERE entropy BETWEEN 4.1 AND 4.4)", lambda p: P.select_entropy(p, [Span(4.1, 4.4)], True), f", {ENTROPY}")
_select("entropy_deselect", "length(p) = 0 OR pkt_id NOT IN (SELECT pkt_id FROM ent WHERE entropy BETWEEN 4.1 AND 4.4)", lambda p: P.select_entropy(p, [Span(4.1, 4.4)], False), f", {ENTROPY}")
_select("proto_select", "proto IN (6, 17)", lambda p: P.select_spans(p, "proto", protocol_ranges("tcp,udp"), True))
_select("proto_deselect", "proto <> 6", lambda p: P.select_spans(p, "proto", protocol_ranges("tcp"), False))
_select("port_select", "port BETWEEN 22 AND 80 OR port >= 400", lambda p: P.select_spans(p, "port", int_ranges("22-80,400-0"), True))
_select("port_deselect", "NOT (port = 80 OR port BETWEEN 21 AND 25)", lambda p: P.select_spans(p, "port", port_ranges("http,ftp-smtp"), False))
_select("time_range", f"ts BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'", lambda p: P.select_time(p, START, END))


@query(f"WITH {PACKETS} SELECT {IDS} FROM (SELECT *, sum(CASE WHEN ts > TIMESTAMP '{END}' THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY pkt_id) AS late FROM packets) WHERE late <= 10")
def after_cutoff(spark, sf):
    return ids(P.stop_after(packets(spark, sf), END, order="pkt_id"))


_FIRST = "firsts AS (SELECT file, min(ts) AS first_ts FROM packets GROUP BY file)"


@query(f"WITH {PACKETS}, {_FIRST}, n AS (SELECT *, lead(first_ts) OVER (ORDER BY first_ts, file) AS nx, lag(first_ts) OVER (ORDER BY first_ts, file) AS bf FROM firsts) SELECT file, first_ts FROM n WHERE (nx >= TIMESTAMP '2024-01-01 00:30:00' OR (nx IS NULL AND first_ts >= TIMESTAMP '2024-01-01 00:30:00')) AND (bf <= TIMESTAMP '2024-01-01 01:30:00' OR (bf IS NULL AND first_ts <= TIMESTAMP '2024-01-01 01:30:00'))")
def file_prune(spark, sf):
    firsts = packets(spark, sf).groupBy("file").agg(F.min("ts").alias("first_ts"))
    return P.select_files(firsts, dt.datetime(2024, 1, 1, 0, 30), dt.datetime(2024, 1, 1, 1, 30))


def _label(name: str, where: str, f: Callable, ctes: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return ids(f(spark, sf, packets(spark, sf)))

    run.__name__ = name
    query(f"WITH {PACKETS}, {ctes} SELECT {IDS} FROM packets WHERE {where}")(run)


_TIMES = f"{ALERTS}, times AS (SELECT ts FROM alerts UNION SELECT ts - INTERVAL 1 HOUR FROM alerts UNION SELECT ts + INTERVAL 1 HOUR FROM alerts)"
_BAD = f"{ALERTS}, bad AS (SELECT host FROM (SELECT src AS host FROM alerts UNION SELECT dst FROM alerts) WHERE NOT ((host & 4294967280) = 167772160 OR (host & 4294950912) = 2164670464))"
_label("alert_semi", "ts IN (SELECT ts FROM times)", lambda s, d, p: P.match_alert_times(p, alerts(s, d)), _TIMES)
_label("alert_anti", "ts NOT IN (SELECT ts FROM times)", lambda s, d, p: P.match_alert_times(p, alerts(s, d), False), _TIMES)
_label("host_semi", "src IN (SELECT host FROM listed) OR dst IN (SELECT host FROM listed)", lambda s, d, p: P.match_hosts(p, listed(s, d)), LISTED)
_label("host_anti", "NOT (src IN (SELECT host FROM listed) OR dst IN (SELECT host FROM listed))", lambda s, d, p: P.match_hosts(p, listed(s, d), False), LISTED)
_label("alerted_host_semi", "src IN (SELECT host FROM bad) OR dst IN (SELECT host FROM bad)", lambda s, d, p: P.match_hosts(p, P.alert_hosts(alerts(s, d), cidrs(SAFE))), _BAD)


@query(f"WITH {_BAD} SELECT host FROM bad")
def safe_cidr_anti(spark, sf):
    return P.alert_hosts(alerts(spark, sf), cidrs(SAFE))


@query(f"WITH {PACKETS} SELECT pkt_id, (dst & 4294950912) = 2164670464 AS inside FROM packets")
def cidr_member(spark, sf):
    return packets(spark, sf).select("pkt_id", P.in_networks(F.col("dst"), cidrs("129.6.64.0/18")).alias("inside"))


@query(f"WITH {PACKETS} SELECT p.port, service, count(*) AS packets FROM packets p JOIN (VALUES (80, 'http'), (443, 'https'), (22, 'ssh'), (53, 'dns'), (25, 'smtp')) s(port, service) ON p.port = s.port WHERE proto <> 1 GROUP BY ALL")
def service_names(spark, sf):
    rows = packets(spark, sf).where("proto <> 1").join(F.broadcast(services(spark)), "port")
    return rows.groupBy("port", "service").agg(F.count("*").alias("packets"))


@query(f"WITH {PACKETS}, s AS (SELECT pkt_id, p FROM packets WHERE regexp_matches(p, '^(..)*(0[1-9A-F]|[1-9A-F].)')) SELECT (SELECT count(*) FROM packets) AS packets, (SELECT count(*) FROM s) AS nonzero")
def nonzero_payloads(spark, sf):
    return packets(spark, sf).agg(F.count("*").alias("packets"), F.count_if(M.nonzero_byte(F.col("payload"))).alias("nonzero"))


# --- captures: frames as hexadecimal text by expressions that both engines read, whole and broken ones


def _u(x: str, digits: int) -> str:
    return f"lpad(hex({x}), {digits}, '0')"


def _le(x: str) -> str:
    return "concat(" + ", ".join(f"substring({_u(x, 8)}, {i}, 2)" for i in (7, 5, 3, 1)) + ")"


_HALF = "CAST(length({}) / 2 AS BIGINT)"
_PORTS = f"{_u('1024 + (doc_id * 7919) % 60000', 4)}, {_u('20 + doc_id % 500', 4)}"
_ADDRESSES = f"{_u('167772160 + doc_id % 500', 8)}, {_u('2164654080 + (doc_id * 31) % 65536', 8)}"
_FRAME = [
    ("seg", f"""CASE WHEN doc_id % 10 < 7 THEN concat({_PORTS}, repeat('00', 8), CASE WHEN doc_id % 31 = 0 THEN '40' WHEN doc_id % 3 = 0 THEN '60' ELSE '50' END, CASE WHEN doc_id % 11 = 0 THEN '38' ELSE '18' END,
      'FFFF0000', CASE WHEN doc_id % 22 = 0 THEN 'FFFF' ELSE '0000' END, CASE WHEN doc_id % 3 = 0 THEN '01010101' ELSE '' END, h)
      WHEN doc_id % 10 < 9 THEN concat({_PORTS}, {_u(f"CASE WHEN doc_id % 13 = 0 THEN 65535 ELSE 8 + {_HALF.format('h')} END", 4)}, '0000', h)
      ELSE concat({_u('doc_id % 19', 2)}, repeat('00', 7), h) END"""),
    ("ip", f"""concat(CASE WHEN doc_id % 37 = 0 THEN '65' WHEN doc_id % 7 = 0 THEN '46' ELSE '45' END, '00', {_u(f"{_HALF.format('seg')} + CASE WHEN doc_id % 7 = 0 THEN 24 ELSE 20 END", 4)}, '0000000040',
      CASE WHEN doc_id % 41 = 0 THEN '59' WHEN doc_id % 10 < 7 THEN '06' WHEN doc_id % 10 < 9 THEN '11' ELSE '01' END, '0000', {_ADDRESSES}, CASE WHEN doc_id % 7 = 0 THEN '01010101' ELSE '' END, seg)"""),
    *[("ip", f"CASE WHEN doc_id % {m} = 0 THEN concat('4500', {_u(_HALF.format('ip') + ' + 20', 4)}, '00000000400400000A0000010A000002', ip) ELSE ip END") for m in (5, 6, 10, 20, 40)],
    ("f", "concat(repeat('0A', 12), CASE WHEN doc_id % 17 = 0 THEN '0806' ELSE '0800' END, ip, repeat('00', CAST(doc_id % 3 AS INT)))"),
    ("f", "CASE WHEN doc_id % 23 = 0 THEN substring(f, 1, CAST(length(f) - 2 * (doc_id % 40) AS INT)) ELSE f END"),
]


def _framed() -> str:
    out = "SELECT doc_id, seq, ts, p AS h, '' AS seg, '' AS ip, '' AS f FROM packets"
    for name, value in _FRAME:
        out = f"SELECT * REPLACE ({value} AS {name}) FROM ({out})"
    return out


def decoded_sql() -> str:
    b = lambda x, at, width: f"TRY_CAST('0x' || substring({x}, {2 * at + 1}, {2 * width}) AS BIGINT)"
    heads = f"""(SELECT *, substring(ip, 2 * ihl + 1, 2 * (least(length(ip) // 2, total) - ihl)) AS body FROM (SELECT *, ({b('ip', 0, 1)} & 15) * 4 AS ihl, {b('ip', 0, 1)} >> 4 AS version, {b('ip', 2, 2)} AS total, {b('ip', 9, 1)} AS proto, {b('ip', 12, 4)} AS src, {b('ip', 16, 4)} AS dst
      FROM ips WHERE length(ip) >= 40) WHERE version = 4 AND ihl >= 20 AND total >= ihl AND least(length(ip) // 2, total) > ihl)"""
    return f"""WITH RECURSIVE {PACKETS}, frames AS ({_framed()}),
      ips AS (SELECT doc_id, seq, ts, substring(f, 29) AS ip FROM frames WHERE length(f) >= 68 AND substring(f, 25, 4) = '0800' UNION ALL SELECT doc_id, seq, ts, body FROM {heads} WHERE proto = 4)
      SELECT doc_id || '-' || seq // 64 AS file, seq % 64 AS pkt_no, ts, proto::INT AS proto, src, dst, CASE WHEN proto <> 1 THEN sport::INT END AS sport, CASE WHEN proto <> 1 THEN dport::INT END AS dport,
        (CASE WHEN proto = 1 THEN {b('body', 0, 1)} ELSE least(sport, dport) END)::INT AS port, md5(substring(body, 2 * header + 1)) AS payload_md5
      FROM (SELECT *, length(body) // 2 AS size, CASE WHEN proto = 6 THEN ({b('body', 12, 1)} >> 4) * 4 ELSE 8 END AS header, {b('body', 0, 2)} AS sport, {b('body', 2, 2)} AS dport FROM {heads})
      WHERE (proto = 6 AND size >= 20 AND header BETWEEN 20 AND size AND (({b('body', 13, 1)} & 32) = 0 OR {b('body', 18, 2)} <= size - header))
        OR (proto = 17 AND size >= 8 AND {b('body', 4, 2)} BETWEEN 8 AND size) OR (proto = 1 AND size >= 1)"""


def capture_files(spark: SparkSession, sf: str) -> DataFrame:
    """(file, content): captures of up to 64 packets of a document each."""
    rows = packets(spark, sf).select("doc_id", "seq", "ts", F.hex("payload").alias("h"))
    for name, value in _FRAME:
        rows = rows.withColumn(name, F.expr(value))
    rows = rows.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).withColumns({"s": F.expr("us div 1000000"), "us": F.col("us") % 1_000_000, "n": F.expr(_HALF.format("f"))})
    rows = rows.select("doc_id", F.expr("seq div 64").alias("part"), F.struct("seq", F.expr(f"concat({_le('s')}, {_le('us')}, {_le('n')}, {_le('n')}, f)").alias("r")).alias("x"))
    files = rows.groupBy("doc_id", "part").agg(F.array_join(F.array_sort(F.collect_list("x"))["r"], "").alias("r"))
    return files.select(F.concat_ws("-", "doc_id", "part").alias("file"), F.unhex(F.concat(F.lit("D4C3B2A1020004000000000000000000FFFF000001000000"), F.col("r"))).alias("content"))


@query(decoded_sql())
def capture_decode(spark, sf):
    """Captures read and decoded: options, paddings, cuts, nests of up to five, and frames that don't hold together."""
    rows = P.decode(parse_captures(capture_files(spark, sf)))
    return rows.select("file", "pkt_no", F.col("ts").cast("timestamp_ntz").alias("ts"), "proto", "src", "dst", "sport", "dport", "port", F.md5(F.hex("payload").cast("binary")).alias("payload_md5"))


# --- hashes

_FNV64 = "list_reduce(list_prepend({basis}::HUGEINT, [('0x' || substring({g}, 2 * i + 1, 2))::HUGEINT FOR i IN range(0, length({g}) // 2)]), lambda h, b: {step})"
_STEP1 = "xor((h * 1099511628211) % 18446744073709551616, b)"
_STEP1A = "(xor(h, b) * 1099511628211) % 18446744073709551616"
_HEX = "lower(lpad(hex({x}::UBIGINT), 16, '0'))"


def fnv64_sql(g: str, step: str = _STEP1, basis: int = H.BASIS_64) -> str:
    return _FNV64.format(g=g, basis=basis, step=step)


def fnv32_sql(g: str, step: str, basis: int = H.BASIS_32) -> str:
    return _FNV64.format(g=g, basis=basis, step=step)


_ITEMS = "(SELECT item_id, hex(text) AS g FROM benchmark)"


def _items(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "benchmark").select("item_id", F.col("text").cast("binary").alias("payload"))


@query(f"SELECT item_id, {_HEX.format(x=fnv64_sql('g'))} AS hash FROM {_ITEMS}")
def fnv1_64(spark, sf):
    return _items(spark, sf).select("item_id", H.fnv64(F.col("payload")).alias("hash"))


@query(f"SELECT item_id, {_HEX.format(x=fnv64_sql('g', _STEP1A))} AS hash FROM {_ITEMS}")
def fnv1a_64(spark, sf):
    return _items(spark, sf).select("item_id", H.fnv64(F.col("payload"), "1a").alias("hash"))


@query(f"SELECT item_id, {_HEX.format(x=fnv64_sql('g', basis=0))} AS hash FROM {_ITEMS}")
def fnv0_64(spark, sf):
    return _items(spark, sf).select("item_id", H.fnv64(F.col("payload"), "0").alias("hash"))


@query(f"SELECT item_id, ({fnv32_sql('g', 'xor((h * 16777619) % 4294967296, b)')})::BIGINT AS hash, ({fnv32_sql('g', 'xor((h * 16777619) % 4294967296, b)')} % 65536)::BIGINT AS low16 FROM {_ITEMS}")
def fnv1_32(spark, sf):
    return _items(spark, sf).select("item_id", H.fnv32(F.col("payload")).alias("hash"), H.fnv32(F.col("payload"), bits=16).alias("low16"))


@query(f"SELECT item_id, ({fnv32_sql('g', '(xor(h, b) * 16777619) % 4294967296')})::BIGINT AS hash FROM {_ITEMS}")
def fnv1a_32(spark, sf):
    return _items(spark, sf).select("item_id", H.fnv32(F.col("payload"), "1a").alias("hash"))


@query(f"SELECT item_id, n, {_HEX.format(x=fnv64_sql('q'))} AS hash FROM (SELECT item_id, n, substring(g, 1, 2 * n) AS q FROM (SELECT item_id, g, unnest(range(3, 9)) AS n FROM {_ITEMS}) WHERE length(g) // 2 >= n)")
def fnv_prefix_range(spark, sf):
    rows = _items(spark, sf).select("item_id", F.explode(H.fnv64_prefixes(F.col("payload"), 3, 8)).alias("x"))
    return rows.select("item_id", F.col("x.n").alias("n"), H.hex64(F.col("x")).alias("hash"))


@query(f"SELECT item_id, n, ({fnv32_sql('q', 'xor((h * 16777619) % 4294967296, b)')})::BIGINT AS hash FROM (SELECT item_id, n, substring(g, 1, 2 * n) AS q FROM (SELECT item_id, g, unnest(range(3, 9)) AS n FROM {_ITEMS}) WHERE length(g) // 2 >= n)")
def fnv32_prefix_range(spark, sf):
    rows = _items(spark, sf).select("item_id", F.explode(H.fnv32_prefixes(F.col("payload"), 3, 8)).alias("x"))
    return rows.select("item_id", "x.n", "x.hash")


def lookup3_sql(items: str) -> str:
    """Blocks of 12 bytes by recursion, a subselect for each turn of a round."""
    state = "item_id, g, n, pos"
    rot = lambda x, k: f"((({x} << {k}) & {H.MASK}) | ({x} >> {32 - k}))"
    word = lambda i: "('0x' || " + " || ".join(f"substring(w, {8 * i + 2 * j + 1}, 2)" for j in (3, 2, 1, 0)) + ")::BIGINT"

    def turns(source: str, first: str, final: bool) -> str:
        out = f"SELECT {state}, " + ", ".join(f"({v} + {word(i)}) & {H.MASK} AS {v}" for i, v in enumerate("abc")) + f" FROM (SELECT *, rpad(substring(g, 2 * pos + 1, 24), 24, '0') AS w FROM {source} WHERE {first})"
        for k in H.FINAL if final else H.MIX:
            new = f"b AS a, (xor(c, b) - {rot('b', k)}) & {H.MASK} AS b, a AS c" if final else f"b AS a, (c + b) & {H.MASK} AS b, xor((a - c) & {H.MASK}, {rot('c', k)}) AS c"
            out = f"SELECT {state}, {new} FROM ({out})"
        return out

    start = f"({H.START} + n) & {H.MASK}"
    signed = "(CASE WHEN {b} >= 2147483648 THEN {b} - 4294967296 ELSE {b} END) * 4294967296 + {c}"
    return f"""WITH RECURSIVE s AS (SELECT item_id, g, length(g) // 2 AS n, 0::BIGINT AS pos, {start} AS a, {start} AS b, {start} AS c FROM {items}
      UNION ALL SELECT item_id, g, n, pos + 12, a, b, c FROM ({turns('s', 'n - pos > 12', False)}))
      SELECT item_id, {signed.format(b='a', c='b')} AS hash FROM ({turns('s', 'n > 0 AND n - pos <= 12', True)})
      UNION ALL SELECT item_id, {signed.format(b='b', c='c')} FROM s WHERE n = 0"""


@query(lookup3_sql(_ITEMS))
def lookup3(spark, sf):
    return _items(spark, sf).select("item_id", H.lookup3_column(F.col("payload")).alias("hash"))


# --- stores


def slots_sql(counts: str, k: int = 5, m: int = 1_000_003) -> str:
    hashed = f"SELECT n, g, cnt, ({fnv64_sql('g')}) AS h FROM ({counts})"
    return f"SELECT n, (((h % 4294967296) + i * (h // 4294967296)) % {m})::BIGINT AS spot, g, cnt FROM (SELECT *, unnest(range(0, {k})) AS i FROM ({hashed}))"


def slot_counts_sql(counts: str) -> str:
    return f"SELECT n, spot, sum(cnt)::BIGINT AS cnt FROM ({slots_sql(counts)}) GROUP BY n, spot"


@query(f"WITH {PACKETS} SELECT n, spot, least(cnt, 65520) AS counter, greatest(cnt - 65519, 0) AS overflow FROM ({slot_counts_sql(counts_sql(3))})")
def bloom_slots(spark, sf):
    return BloomStore.build(packets(spark, sf), 3, **BLOOM).counters()


@query(f"WITH {PACKETS} {stats_sql(slot_counts_sql(counts_sql(3)), 1_000_003)}")
def bloom_summary(spark, sf):
    return _stats(BloomStore.build(packets(spark, sf), 3, **BLOOM).stats())


_B = "items AS (SELECT item_id, hex(text) AS p FROM benchmark)"


@query(f"WITH {PACKETS}, {_B}, slots AS MATERIALIZED ({slot_counts_sql(counts_sql(3))}), probes AS ({slots_sql('SELECT DISTINCT n, g, 1 AS cnt FROM (' + grams_sql(3, source='items') + ')')}) SELECT n, g, least(min(coalesce(s.cnt, 0)), 65520) AS found FROM probes LEFT JOIN slots s USING (n, spot) GROUP BY n, g")
def bloom_probe(spark, sf):
    store = BloomStore.build(packets(spark, sf), 3, **BLOOM)
    grams = G.gram_counts(_items(spark, sf), 3).select("n", "g")
    return hexed(store.find(grams))


@query(f"WITH {_B}, seqs AS (SELECT n, g, min(item_id * 1000000 + pos) AS cnt FROM ({grams_sql(3, source='items', keep='item_id, ')}) GROUP BY n, g), firsts AS (SELECT n, spot, min(cnt) AS cnt FROM ({slots_sql('SELECT * FROM seqs')}) GROUP BY n, spot) SELECT n, count(DISTINCT cnt) AS distinct_estimate FROM firsts GROUP BY n")
def bloom_distinct_estimate(spark, sf):
    items = G.explode_grams(_items(spark, sf), 3, keep=("item_id",)).withColumn("seq", F.col("item_id") * 1_000_000 + F.col("pos"))
    empty = spark.createDataFrame([], "n int, spot long, cnt long")
    return bloom_distinct(items, BloomStore(empty, 3, 3, **BLOOM))


@query(f"WITH {PACKETS}, {_B} SELECT n, g, sum(cnt)::BIGINT AS cnt FROM ({counts_sql(3)} UNION ALL {counts_sql(3, source='items')}) GROUP BY n, g")
def store_merge(spark, sf):
    return hexed(ExactStore.build(packets(spark, sf), 3).merge(ExactStore.build(_items(spark, sf), 3)).table)


@query(f"WITH {PACKETS}, tcp AS (SELECT p FROM packets WHERE proto = 6), a AS ({counts_sql(2)}), b AS ({counts_sql(2, source='tcp')}) SELECT a.n, a.g, CASE WHEN a.cnt >= 65520 THEN 65520 ELSE a.cnt - coalesce(b.cnt, 0) END AS cnt FROM a LEFT JOIN b USING (n, g) WHERE a.cnt >= 65520 OR a.cnt > coalesce(b.cnt, 0)")
def store_delete(spark, sf):
    rows = packets(spark, sf)
    return hexed(ExactStore.build(rows, 2).delete(rows.where("proto = 6")).table)


@query(f"WITH {PACKETS}, a AS ({counts_sql(4)}) SELECT n, 'ExactStore' AS kind, 4294967296::BIGINT AS m, sum(cnt)::BIGINT AS total, count(*) AS distinct_counters, sum(greatest(cnt - 65520, 0))::BIGINT AS overflow FROM a GROUP BY n")
def store_label(spark, sf):
    return ExactStore.build(packets(spark, sf), 4).label()


_TAKEN = f"tcp AS (SELECT p FROM packets WHERE proto = 6), slots AS MATERIALIZED ({slot_counts_sql(counts_sql(3))}), taken AS MATERIALIZED ({slots_sql(counts_sql(3, source='tcp'))}), may AS (SELECT n, g FROM taken LEFT JOIN slots s USING (n, spot) GROUP BY n, g HAVING least(min(coalesce(s.cnt, 0)), 65520) >= any_value(taken.cnt)), gone AS (SELECT n, spot, sum(cnt)::BIGINT AS cnt FROM taken JOIN may USING (n, g) GROUP BY n, spot)"


@query(f"WITH {PACKETS}, {_TAKEN} SELECT n, spot, CASE WHEN s.cnt >= 65520 THEN 65520 ELSE s.cnt - coalesce(gone.cnt, 0) END AS cnt FROM slots s LEFT JOIN gone USING (n, spot) WHERE s.cnt >= 65520 OR s.cnt > coalesce(gone.cnt, 0)")
def store_delete_bloom(spark, sf):
    rows = packets(spark, sf)
    return BloomStore.build(rows, 3, **BLOOM).delete(rows.where("proto = 6")).table


@query(f"WITH {PACKETS} SELECT n, 'BloomStore' AS kind, 1000003::BIGINT AS m, (SELECT count(*) FROM ({grams_sql(3)})) AS total, count(*) AS distinct_counters, sum(greatest(cnt - 65519, 0))::BIGINT AS overflow FROM ({slot_counts_sql(counts_sql(3))}) GROUP BY n")
def bloom_label(spark, sf):
    return BloomStore.build(packets(spark, sf), 3, **BLOOM).label()


# --- comparison and chains

_COMPARE = f"{_B}, {docs_sql(5)}, a AS ({counts_sql(5, source='items')}), b AS ({counts_sql(5, source='docs')}), j AS (SELECT b.n, b.g, b.cnt AS weight, least(coalesce(a.cnt, 0), 65520) AS found FROM b LEFT JOIN a USING (n, g))"


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", F.col("text").cast("binary").alias("payload"))


@query(f"WITH {_COMPARE} SELECT n, sum(CASE WHEN found > 0 THEN weight ELSE 0 END)::BIGINT AS found, sum(CASE WHEN found = 0 THEN weight ELSE 0 END)::BIGINT AS not_found, sum(weight)::BIGINT AS total, round(sum(CASE WHEN found > 0 THEN weight ELSE 0 END) / sum(weight)::DOUBLE, 6) AS fraction FROM j GROUP BY n")
def compare_fraction(spark, sf):
    rows = C.compare(_texts(spark, sf), ExactStore.build(_items(spark, sf), 5))
    return rows.select("n", "found", "not_found", "total", *r6("fraction"))


@query(f"WITH {_COMPARE}, w AS (SELECT greatest(1, ceil(least(max(cnt), 65520) / 1024.0)::BIGINT) AS width FROM a) SELECT n, least(found // width, 1023)::BIGINT AS bin, sum(weight)::BIGINT AS weight FROM j, w GROUP BY ALL")
def compare_histogram(spark, sf):
    return C.compare_histogram(_texts(spark, sf), ExactStore.build(_items(spark, sf), 5))


@query(f"""WITH {_B}, {PACKETS}, a AS ({counts_sql(3)}),
p AS (SELECT item_id, pos, least(coalesce(cnt, 0), 65520)::DOUBLE AS x FROM ({grams_sql(3, source='items', keep='item_id, ')}) LEFT JOIN a USING (n, g)),
l AS (SELECT item_id, x, lag(x) OVER (PARTITION BY item_id ORDER BY pos) AS y, avg(x) OVER (PARTITION BY item_id) AS mu FROM p WHERE pos < 10240)
SELECT item_id, count(*) AS n, round(avg(x), 6) AS mu, round(stddev_samp(x), 6) AS sigma, round(sum((x - mu) * (y - mu)) / nullif(sum(CASE WHEN y IS NOT NULL THEN (y - mu) ** 2 END), 0), 6) AS rho FROM l GROUP BY item_id""")
def probe_dist(spark, sf):
    store = ExactStore.build(packets(spark, sf), 3)
    found = store.probe(_items(spark, sf), keep=("item_id",), limit=10240)
    return S.sequence_stats(found, "found", "pos", "item_id").select("item_id", "n", *r6("mu", "sigma", "rho"))


@query(f"WITH {_B}, {PACKETS}, a AS ({counts_sql(3)}) SELECT item_id, n, sum(least(coalesce(cnt, 0), 65520))::BIGINT AS total FROM ({grams_sql(3, source='items', keep='item_id, ')}) LEFT JOIN a USING (n, g) GROUP BY item_id, n")
def item_totals(spark, sf):
    return ExactStore.build(packets(spark, sf), 3).totals(_items(spark, sf), ("item_id",))


@query(f"WITH blocks AS (SELECT substring(h, s * 1024 + 1, 1024) AS p FROM (SELECT hex(text) AS h, unnest(range(0, greatest(1, ceil(strlen(text) / 512.0)::BIGINT))) AS s FROM documents)) {counts_sql(4, source='blocks')}")
def block_gram_count(spark, sf):
    docs = read(spark, sf, "documents").select(F.col("text").cast("binary").alias("payload"))
    return hexed(G.gram_counts(G.chunks(docs, 512), 4))


@query(f"WITH {PACKETS}, t AS (SELECT substring(g, 1, 4) AS prefix, ('0x' || substring(g, 5, 2))::INT AS byte, cnt FROM ({counts_sql(3)})), c AS (SELECT *, sum(cnt) OVER (PARTITION BY prefix) AS total, sum(cnt) OVER (PARTITION BY prefix ORDER BY byte) AS cumulative FROM t) SELECT prefix, byte, cnt, total::BIGINT AS total, cumulative::BIGINT AS cumulative, greatest(0, cumulative * 65536 // total - 1)::BIGINT AS code FROM c")
def markov_cdf(spark, sf):
    return C.cumulative_codes(G.gram_counts(packets(spark, sf), 3)).withColumn("prefix", F.hex("prefix"))


@query(f"WITH {PACKETS}, t AS (SELECT substring(g, 1, 4) AS prefix, ('0x' || substring(g, 5, 2))::INT AS byte, cnt FROM ({counts_sql(3)})), c AS (SELECT prefix, byte, greatest(0, sum(cnt) OVER (PARTITION BY prefix ORDER BY byte) * 65536 // sum(cnt) OVER (PARTITION BY prefix) - 1) AS code FROM t), k AS (SELECT DISTINCT prefix, (('0x' || prefix)::INT * 7919) % 65536 AS target FROM t) SELECT prefix, target, coalesce(min(CASE WHEN code >= target THEN byte END), max(byte)) AS next FROM k JOIN c USING (prefix) GROUP BY ALL")
def markov_next(spark, sf):
    counts = G.gram_counts(packets(spark, sf), 3)
    targets = C.transitions(counts).select("prefix").distinct().select("prefix", ((M.packed(F.col("prefix")) * 7919) % 65536).cast("int").alias("target"))
    return C.next_bytes(counts, targets).withColumn("prefix", F.hex("prefix"))


@query("SELECT range AS walk, 200::BIGINT AS size, 197::BIGINT AS grams, 197::BIGINT AS known FROM range(20)")
def markov_walk(spark, sf):
    """Walks have the length asked for, and each of their grams occurs."""
    counts = G.gram_counts(_items(spark, sf), 4)
    walks = C.walk(counts, 4, 200, walks=20, seed=1)
    rows = G.explode_grams(walks, 4, payload="text", keep=("walk",)).join(counts.select("g", "cnt"), "g", "left")
    return rows.groupBy("walk").agg((F.count("*") + 3).alias("size"), F.count("*").alias("grams"), F.count("cnt").alias("known"))


# --- statistics

_SEQ = "SELECT {keys}count(*) AS n, round(avg(x), 6) AS mu, round(stddev_samp(x), 6) AS sigma, min(x) AS min, max(x) AS max, round(sum((x - mu) * (y - mu)) / sum(CASE WHEN y IS NOT NULL THEN (y - mu) ** 2 END), 6) AS rho FROM (SELECT {keys}value AS x, lag(value) OVER ({part}ORDER BY event_id) AS y, avg(value) OVER ({over}) AS mu FROM events) {group}"


@query(_SEQ.format(keys="", part="", over="", group=""))
def seq_stats(spark, sf):
    return S.sequence_stats(read(spark, sf, "events"), "value", "event_id").select("n", *r6("mu", "sigma"), "min", "max", *r6("rho"))


@query(_SEQ.format(keys="event_type, ", part="PARTITION BY event_type ", over="PARTITION BY event_type", group="GROUP BY event_type"))
def seq_stats_by_key(spark, sf):
    return S.sequence_stats(read(spark, sf, "events"), "value", "event_id", "event_type").select("event_type", "n", *r6("mu", "sigma"), "min", "max", *r6("rho"))


@query("SELECT count(*) AS n, round(avg(l_discount), 6) AS mu, round(stddev_samp(l_discount), 6) AS sigma FROM lineitem WHERE l_discount <> 0")
def nonzero_stats(spark, sf):
    return S.nonzero_stats(read(spark, sf, "lineitem"), "l_discount").select("n", *r6("mu", "sigma"))


_DIST = "SELECT sum(c)::BIGINT AS n, round(sum(v * c) / sum(c), 6) AS mu, round(sqrt((sum(v * v * c) - sum(v * c) ** 2 / sum(c)) / (sum(c) - 1)), 6) AS sigma FROM (SELECT l_quantity AS v, count(*) AS c FROM lineitem GROUP BY 1) {where}"


def _quantities(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "lineitem").groupBy(F.col("l_quantity").alias("v")).agg(F.count("*").alias("c"))


@query(_DIST.format(where=""))
def dist_stats(spark, sf):
    return S.weighted_stats(_quantities(spark, sf), "v", "c").select("n", *r6("mu", "sigma"))


@query(_DIST.format(where="WHERE c >= 1200"))
def thresh_dist_stats(spark, sf):
    return S.weighted_stats(_quantities(spark, sf), "v", "c", 1200).select("n", *r6("mu", "sigma"))


@query("SELECT round(log2(sum(c)) - sum(c * log2(c)) / sum(c), 6) AS entropy FROM (SELECT l_quantity, count(*) AS c FROM lineitem GROUP BY 1)")
def count_entropy(spark, sf):
    return S.count_entropy(_quantities(spark, sf), "c").select(*r6("entropy"))


@query("SELECT sum(c)::BIGINT AS total FROM (SELECT l_quantity AS v, count(*) AS c FROM lineitem GROUP BY 1) WHERE v BETWEEN 10 AND 20")
def plus_reduction(spark, sf):
    return S.range_sum(_quantities(spark, sf), "v", "c", 10, 20)


_BINS = "bins AS (SELECT round_even(o_totalprice / 1000, 0)::BIGINT AS bin, count(*) AS cnt FROM orders GROUP BY 1)"


@query(f"WITH {_BINS}, t AS (SELECT (SELECT bin FROM bins ORDER BY cnt DESC, bin LIMIT 1) AS mode, (SELECT sum(cnt) FROM bins) AS total), f AS (SELECT abs(bin - mode) AS fuzz, mode, total, sum(cnt) AS cnt FROM bins, t GROUP BY ALL), m AS (SELECT *, sum(cnt) OVER (ORDER BY fuzz) AS mass FROM f) SELECT mode, fuzz, round(mass / total::DOUBLE, 6) AS fraction FROM m WHERE mass > total // 2 ORDER BY fuzz LIMIT 1")
def mode(spark, sf):
    rows = read(spark, sf, "orders").select((F.col("o_totalprice") / 1000).alias("x"))
    return S.mode(rows, "x").select("mode", "fuzz", *r6("fraction"))


@query(f"WITH {_BINS}, w AS (SELECT bin, cnt, sum(cnt) OVER (ORDER BY bin RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS mass FROM bins) SELECT arg_min(bin, -mass * 1000000 + bin) AS mode, max(mass)::BIGINT AS mass, round(max(mass) / sum(cnt)::DOUBLE, 6) AS fraction FROM w")
def fuzz_mode(spark, sf):
    rows = read(spark, sf, "orders").select((F.col("o_totalprice") / 1000).alias("x"))
    return S.fuzz_mode(rows, "x", 5).select("mode", "mass", *r6("fraction"))


# --- dates, addresses, alerts


@query("SELECT event_id, strftime(ts, '%Y%m%d')::INT AS ymd, strftime(ts + INTERVAL 1 DAY, '%Y%m%d')::INT AS next_day, strftime(ts - INTERVAL 1 DAY, '%Y%m%d')::INT AS previous_day, ts + INTERVAL 1 HOUR AS next_hour, ts - INTERVAL 1 HOUR AS previous_hour FROM events")
def ymd_next_prev(spark, sf):
    day, hour = F.to_date("ts"), F.expr("INTERVAL 1 HOUR")
    return read(spark, sf, "events").select("event_id", M.day_number(day).alias("ymd"), M.day_number(F.date_add(day, 1)).alias("next_day"), M.day_number(F.date_sub(day, 1)).alias("previous_day"), (F.col("ts") + hour).alias("next_hour"), (F.col("ts") - hour).alias("previous_hour"))


@query("SELECT event_id, ts::DATE >= DATE '2024-01-02' AND ts::DATE < DATE '2024-01-03' AS inside FROM events")
def ymd_range(spark, sf):
    day = F.to_date("ts")
    return read(spark, sf, "events").select("event_id", ((day >= F.lit(dt.date(2024, 1, 2))) & (day < F.lit(dt.date(2024, 1, 3)))).alias("inside"))


@query("SELECT event_id, (10 * 16777216 + (event_id % 256) * 65536 + 7) AS host, '10.' || event_id % 256 || '.0.7' AS text FROM events")
def address_parse(spark, sf):
    text = F.concat(F.lit("10."), (F.col("event_id") % 256).cast("string"), F.lit(".0.7"))
    rows = read(spark, sf, "events").select("event_id", M.address(text).alias("host"))
    return rows.select("event_id", "host", M.dotted(F.col("host")).alias("text"))


@query("SELECT event_id, CASE WHEN w <= 32 THEN (10 * 16777216 + (event_id % 256) * 65536 + 7) & (4294967295 - ((1::BIGINT << (32 - w)) - 1)) END AS subnet, CASE WHEN w <= 32 THEN 4294967295 - ((1::BIGINT << (32 - w)) - 1) END AS mask FROM (SELECT event_id, CASE WHEN event_id % 35 = 34 THEN 32 ELSE event_id % 35 END AS w FROM events)")
def cidr_parse(spark, sf):
    bits = F.col("event_id") % 35
    text = F.concat(F.lit("10."), (F.col("event_id") % 256).cast("string"), F.lit(".0.7"), F.when(bits == 34, "").otherwise(F.concat(F.lit("/"), bits.cast("string"))))
    return read(spark, sf, "events").select("event_id", M.network(text).alias("x")).select("event_id", "x.subnet", "x.mask")


@query("SELECT width, count(*) AS n, round(avg(x::DOUBLE), 3) AS mu, min(x)::DOUBLE AS min, max(x)::DOUBLE AS max FROM (SELECT width, ('0x' || list_aggregate([substring(g, 2 * (i * width + width - k) - 1, 2) FOR k IN range(0, width)], 'string_agg', ''))::UBIGINT AS x FROM (SELECT g, width, unnest(range(0, length(g) // 2 // width)) AS i FROM (SELECT hex(text) AS g, unnest([1, 2, 4, 8]) AS width FROM benchmark))) GROUP BY width")
def unsigned_stats(spark, sf):
    items = _items(spark, sf)
    rows = [items.select(F.lit(w).alias("width"), F.explode(M.unsigned(F.col("payload"), w)).alias("x")) for w in (1, 2, 4, 8)]
    x = F.col("x").cast("double")
    return reduce(DataFrame.unionByName, rows).groupBy("width").agg(F.count("*").alias("n"), F.round(F.avg(x), 3).alias("mu"), F.min(x).alias("min"), F.max(x).alias("max"))


@query("SELECT event_id AS line_no, ts, ts::DATE AS ymd, (event_id % 1400)::INT AS dgmlen, 167772160 + event_id % 256 AS src, 2164654080 + event_id % 256 AS dst FROM events WHERE event_type = 'error'")
def alert_parse(spark, sf):
    e = read(spark, sf, "events").where("event_type = 'error'")
    byte = (F.col("event_id") % 256).cast("string")
    port = F.when(F.col("event_id") % 2 == 0, ":33619").otherwise("")
    head = F.concat(F.date_format("ts", "MM/dd-HH:mm:ss.SSSSSS"), F.lit(" 10.0.0."), byte, port, F.lit(" -> 129.6.0."), byte, port)
    body = F.concat(F.lit("TCP TTL:59 TOS:0x0 ID:3894 IpLen:20 DgmLen:"), (F.col("event_id") % 1400).cast("string"))
    lines = e.select(F.concat(F.lit("f"), (F.col("event_id") % 8).cast("string")).alias("file"), F.posexplode(F.array(head, body)).alias("nth", "line"), "event_id")
    lines = lines.select("file", (F.col("event_id") * 2 + F.col("nth")).alias("line_no"), "line")
    rows = parse_alerts(lines, dt.date(2023, 12, 25), dt.date(2024, 12, 1))
    return rows.select((F.col("line_no") / 2).cast("long").alias("line_no"), F.col("ts").cast("timestamp_ntz").alias("ts"), "ymd", "dgmlen", "src", "dst")


_FULL = f"""WITH {PACKETS}, {_TIMES}, {LISTED}, {ENTROPY},
kept AS (SELECT p FROM packets LEFT JOIN ent USING (pkt_id) WHERE ts BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}' AND proto IN (6, 17) AND NOT (port = 25)
  AND ts NOT IN (SELECT ts FROM times) AND NOT (src IN (SELECT host FROM listed) OR dst IN (SELECT host FROM listed)) AND (length(p) = 0 OR entropy BETWEEN 3 AND 6))
SELECT n, mu, sigma, max, min, round(sigma_ ** 2 / mu_, 6) AS dispersion FROM (SELECT n, {_STATS}, s / m AS mu_, sqrt((q - s * s / m) / (m - 1)) AS sigma_ FROM (SELECT n, sum(cnt)::DOUBLE AS s, sum(cnt::DOUBLE * cnt) AS q, max(cnt) AS max, min(cnt) AS least, count(*) AS nz, 256.0::DOUBLE ** n AS m FROM ({counts_sql(2, source='kept')} UNION ALL {counts_sql(3, source='kept')}) GROUP BY n))"""


@query(_FULL)
def full_pipeline(spark, sf):
    spec = Spec(low=2, high=3, protocols=protocol_ranges("tcp,udp"), ports=port_ranges("smtp"), ports_wanted=False, entropy=[Span(3, 6)], entropy_wanted=True, alerts_wanted=False, listed_wanted=False, start=START, end=END, store="exact")
    rows = analyse(packets(spark, sf), spec, alerts=alerts(spark, sf), listed=listed(spark, sf))
    return rows.select("n", *r6("mu", "sigma"), "max", F.col("min").cast("long").alias("min"), *r6("dispersion"))
