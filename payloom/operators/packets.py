"""Packets: header decoding, selection, and labels from alerts and host lists."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from payloom.functions.measures import byte_entropy, in_network, in_spans
from payloom.parsing import Span

ICMP, IPIP, TCP, UDP = 1, 4, 6, 17
IPV4 = 0x0800
HEAD = "struct<at:bigint,end:bigint,proto:bigint,src:bigint,dst:bigint>"
#: Packets after the end of a time range that a file may have before it is left.
AFTER_MAX = 10
#: Distinct hosts up to which a host set is broadcast (16 bytes each).
BROADCAST_HOSTS = 2_000_000


def _u(data: Column, at: Column | int, width: int) -> Column:
    """Big-endian unsigned number of width bytes, at counted from 0."""
    start = (at if isinstance(at, Column) else F.lit(at)) + 1
    return F.conv(F.hex(F.substring(data, start.cast("int"), F.lit(width))), 16, 10).cast("long")


def _head(data: Column, at: Column, end: Column, protocols: list[Span] | None, want: bool) -> Column:
    """What an IPv4 header from at to before end says: where its body is, protocol and addresses; null if it doesn't hold together or isn't selected."""
    ihl, total = _u(data, at, 1).bitwiseAND(F.lit(15)) * 4, _u(data, at + 2, 2)
    proto = _u(data, at + 9, 1)
    last = F.least(end.cast("long"), at + total)
    good = (end - at >= 20) & (F.shiftright(_u(data, at, 1), 4) == 4) & (ihl >= 20) & (total >= ihl) & (last > at + ihl) & (in_spans(proto, protocols) == F.lit(want))
    return F.when(good, F.struct((at + ihl).alias("at"), last.alias("end"), proto.alias("proto"), _u(data, at + 12, 4).alias("src"), _u(data, at + 16, 4).alias("dst"))).cast(HEAD)


def decode(raw: DataFrame, protocols: list[Span] | None = None, want: bool = True) -> DataFrame:
    """Frames (file, pkt_no, ts, caplen, data, ...) -> file, pkt_no, ts, proto, src, dst, sport, dport, port, payload.

    Ethernet with IPv4 alone; IP in IP is entered however deep it goes, if protocol 4 itself is selected. Frames that don't
    hold together are left out. port: the smaller port, or the ICMP type.
    """
    data = F.col("data")
    rows = raw.where((F.length(data) >= 34) & (_u(data, 12, 2) == IPV4)).withColumn("ip", _head(data, F.lit(14).cast("long"), F.length(data), protocols, want))
    deeper = F.when(F.col("ip.proto") == IPIP, F.sequence(F.lit(1), F.floor(F.length(data) / 20).cast("int"))).otherwise(F.array().cast("array<int>"))
    enter = lambda ip, _: F.when(ip["proto"] == IPIP, _head(data, ip["at"], ip["end"], protocols, want)).otherwise(ip)
    rows = rows.withColumn("ip", F.aggregate(deeper, F.col("ip"), enter)).where(F.col("ip.proto").isin(ICMP, TCP, UDP))
    size = F.col("ip.end") - F.col("ip.at")
    return _transport(rows.select("file", "pkt_no", "ts", F.col("ip.proto").cast("int").alias("proto"), "ip.src", "ip.dst", size.alias("size"), F.substring(data, (F.col("ip.at") + 1).cast("int"), size.cast("int")).alias("body")))


def _transport(rows: DataFrame) -> DataFrame:
    body, proto, size = F.col("body"), F.col("proto"), F.col("size")
    tcp, udp = proto == TCP, proto == UDP
    long_enough = size >= F.when(tcp, 20).otherwise(F.when(udp, 8).otherwise(1))
    rows = rows.where(long_enough)
    header = F.when(tcp, F.shiftright(_u(body, 12, 1), 4) * 4).otherwise(F.lit(8))
    rows = rows.withColumns({"header": header, "udp_size": F.when(udp, _u(body, 4, 2)), "urgent": F.when(tcp, _u(body, 13, 1).bitwiseAND(F.lit(0x20)) > 0), "urgent_at": F.when(tcp, _u(body, 18, 2))})
    good_tcp = (F.col("header") >= 20) & (F.col("header") <= size) & (~F.col("urgent") | (F.col("urgent_at") <= size - F.col("header")))
    good_udp = (F.col("udp_size") >= 8) & (F.col("udp_size") <= size)
    rows = rows.where(F.when(tcp, good_tcp).when(udp, good_udp).otherwise(F.lit(True)))
    two = tcp | udp
    sport, dport = F.when(two, _u(body, 0, 2)), F.when(two, _u(body, 2, 2))
    payload = F.when(size > F.col("header"), F.substring(body, (F.col("header") + 1).cast("int"), (size - F.col("header")).cast("int"))).otherwise(F.lit(b""))
    return rows.select("file", "pkt_no", "ts", "proto", "src", "dst", sport.cast("int").alias("sport"), dport.cast("int").alias("dport"), F.when(two, F.least(sport, dport)).otherwise(_u(body, 0, 1)).cast("int").alias("port"), payload.alias("payload"))


# --- selection


def select_spans(df: DataFrame, column: str, spans: list[Span] | None, want: bool = True) -> DataFrame:
    """Rows whose value is in the ranges (want) or isn't; without ranges everything is in them."""
    return df.where(in_spans(F.col(column), spans) == F.lit(want))


def select_entropy(df: DataFrame, spans: list[Span] | None, want: bool | None, payload: str = "payload") -> DataFrame:
    """Rows whose payload's entropy is in the ranges or isn't; empty payloads pass, and all do if want is None."""
    if want is None:
        return df
    empty = F.coalesce(F.length(payload), F.lit(0)) == 0
    return df.where(empty | (in_spans(byte_entropy(F.col(payload)), spans or [Span(0, 0)]) == F.lit(want)))


def select_time(df: DataFrame, start: dt.datetime | None, end: dt.datetime | None, ts: str = "ts") -> DataFrame:
    """Rows from start to end, both included."""
    if start is not None:
        df = df.where(F.col(ts) >= F.lit(start))
    return df if end is None else df.where(F.col(ts) <= F.lit(end))


def stop_after(df: DataFrame, end: dt.datetime, *, ts: str = "ts", file: str = "file", order: str = "pkt_no", most: int = AFTER_MAX) -> DataFrame:
    """Rows of each file up to where more than `most` of its packets so far were later than end.

    The place is the (most + 1)-th smallest order among late packets, found by an aggregate that keeps that many a file.
    """
    late = df.where(F.col(ts) > F.lit(end))
    nth = late.withColumn("__nth", F.row_number().over(Window.partitionBy(file).orderBy(order))).where(F.col("__nth") == most + 1)
    cut = nth.select(F.col(file), F.col(order).alias("__cut"))
    return df.join(cut, file, "left").where(F.col("__cut").isNull() | (F.col(order) < F.col("__cut"))).drop("__cut")


def select_files(files: DataFrame, start: dt.datetime | None, end: dt.datetime | None, *, file: str = "file", first: str = "first_ts", limits: bool = False) -> DataFrame:
    """Files in order of their first packet: the last one before start, those within, and the first one after end; limits: of these the first and the last alone."""
    w = Window.orderBy(first, file)
    rows = files.select(file, first, F.lead(first).over(w).alias("next"), F.lag(first).over(w).alias("before"))
    if start is not None:
        rows = rows.where(F.col("next").isNull() & (F.col(first) >= F.lit(start)) | (F.col("next") >= F.lit(start)))
    if end is not None:
        rows = rows.where(F.col("before").isNull() & (F.col(first) <= F.lit(end)) | (F.col("before") <= F.lit(end)))
    if limits:
        ends = rows.agg(F.min(F.struct(first, file)).alias("a"), F.max(F.struct(first, file)).alias("b")).select(F.explode(F.array_distinct(F.array("a", "b"))).alias("x"))
        rows = ends.where("x IS NOT NULL").select("x.*")
    return rows.select(file, first)


# --- labels


def bounded(df: DataFrame, most: int) -> DataFrame:
    """df with a broadcast hint if it has no more than `most` rows, else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def alert_times(alerts: DataFrame, ts: str = "ts") -> DataFrame:
    """The distinct times of alerts and an hour before and after each."""
    hour = F.expr("INTERVAL 1 HOUR")
    return alerts.select(F.explode(F.array(F.col(ts), F.col(ts) - hour, F.col(ts) + hour)).alias("__ts")).distinct()


def match_alert_times(packets: DataFrame, alerts: DataFrame, want: bool = True, *, ts: str = "ts") -> DataFrame:
    """Packets with (or without) an alert at exactly their time, or an hour off."""
    times = alert_times(alerts)
    return packets.join(times, packets[ts] == times["__ts"], "left_semi" if want else "left_anti")


def match_hosts(packets: DataFrame, hosts: DataFrame, want: bool = True, *, most: int = BROADCAST_HOSTS) -> DataFrame:
    """Packets whose source or destination is (or neither is) among hosts (column host)."""
    known = bounded(hosts.select("host").where("host IS NOT NULL").distinct(), most)
    joined = packets.join(known.select(F.col("host").alias("__s")), F.col("src") == F.col("__s"), "left").join(known.select(F.col("host").alias("__d")), F.col("dst") == F.col("__d"), "left")
    hit = F.col("__s").isNotNull() | F.col("__d").isNotNull()
    return joined.where(hit == F.lit(want)).drop("__s", "__d")


def drop_networks(hosts: DataFrame, networks: list[tuple[int, int]], column: str = "host") -> DataFrame:
    """Hosts outside all (subnet, mask) networks; one look-up per distinct mask, 33 at most."""
    if not networks:
        return hosts
    safe = F.lit(False)
    for mask in sorted({m for _, m in networks}):
        safe = safe | F.col(column).bitwiseAND(F.lit(mask).cast("long")).isin([s for s, m in networks if m == mask])
    return hosts.where(~safe)


def in_networks(host: Column, networks: list[tuple[int, int]]) -> Column:
    out = F.lit(False)
    for subnet, mask in networks:
        out = out | in_network(host, F.lit(subnet).cast("long"), F.lit(mask).cast("long"))
    return out


def alert_hosts(alerts: DataFrame, safe: list[tuple[int, int]]) -> DataFrame:
    """The distinct endpoints of alerts (src, dst) that are in no safe network."""
    ends = alerts.select(F.explode(F.array("src", "dst")).alias("host")).where("host IS NOT NULL")
    return drop_networks(ends, safe).distinct()
