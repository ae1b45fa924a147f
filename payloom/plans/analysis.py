"""The whole analysis as one plan: scan, select, label, count grams, summarise."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from payloom import parsing
from payloom.operators import packets as P
from payloom.operators.stores import LARGE, SMALL, BloomSize, BloomStore, ExactStore, GramStore
from payloom.parsing import Span
from payloom.sources.captures import first_times, read_captures
from payloom.sources.texts import hosts, read_alerts

#: Ports and ICMP types that have a name, with the entropy that their payloads usually have (bits per byte).
SERVICES = [(20, "ftp-data", "any"), (21, "ftp", "text, 4-5"), (22, "ssh", "encrypted, 6.5-8"), (23, "telnet", "text, 4-5"), (25, "smtp", "text, 4-6"), (53, "dns", "binary, 4.5-6"), (67, "bootps", "binary"), (68, "bootpc", "binary"), (79, "finger", "text"), (80, "http", "text or compressed, 4-8"), (113, "auth", "text"), (123, "ntp", "binary"), (143, "imap", "text"), (161, "snmp", "binary"), (443, "https", "encrypted, near 8"), (993, "imaps", "encrypted, near 8")]
ICMP_TYPES = [(0, "echo reply"), (3, "unreachable"), (4, "source quench"), (5, "redirect"), (8, "echo"), (11, "time exceeded"), (12, "parameter problem")]


@dataclass(frozen=True)
class Spec:
    """What an analysis selects and counts. A None flag switches its test off."""

    low: int = 4
    high: int | None = None
    protocols: list[Span] | None = None
    protocols_wanted: bool = True
    ports: list[Span] | None = None
    ports_wanted: bool = True
    entropy: list[Span] | None = None
    entropy_wanted: bool | None = None
    alerts_wanted: bool | None = None
    alerted_hosts_wanted: bool | None = None
    safe: list[tuple[int, int]] = field(default_factory=list)
    listed_wanted: bool | None = None
    start: dt.datetime | None = None
    end: dt.datetime | None = None
    stop_late: bool = False
    store: str = "bloom"
    size: BloomSize = LARGE
    bloom: dict = field(default_factory=dict)
    keep_at: str | None = None
    append: bool = False
    dump_to: str | None = None

    @staticmethod
    def parse(options: dict[str, str]) -> Spec:
        """From the letters of the command line: I P i p E e S H h L N n T, and a A D.

        N: bloom, small (a filter of fewer counters and hashes) or any other word for exact counts. a or A: the folder of a
        store that the grams are added to, or that they replace. D: a folder for the dump of all counters.
        """
        flag = lambda k: parsing.yes(options[k]) if k in options else None
        spans = lambda k, read: read(parsing.list_or_file(options[k])) if k in options else None
        n = parsing.int_ranges(options.get("n", "4"))[0]
        start, end = parsing.time_range(options["T"]) if "T" in options else (None, None)
        default = lambda k: True if flag(k) is None else flag(k)
        return Spec(
            low=int(n.low), high=int(n.high), protocols=spans("P", parsing.protocol_ranges), protocols_wanted=default("I"), ports=spans("p", parsing.port_ranges), ports_wanted=default("i"), entropy=spans("e", parsing.double_ranges), entropy_wanted=flag("E"),
            alerts_wanted=flag("S"), alerted_hosts_wanted=flag("H"), safe=parsing.cidrs(parsing.list_or_file(options.get("h", ""))), listed_wanted=flag("L"), start=start, end=end, store=options.get("N", "bloom").replace("small", "bloom"), size=SMALL if options.get("N") == "small" else LARGE,
            keep_at=options.get("a") or options.get("A"), append="a" in options, dump_to=options.get("D"),
        )


def select(packets: DataFrame, spec: Spec, *, alerts: DataFrame | None = None, listed: DataFrame | None = None) -> DataFrame:
    """The packets that a spec keeps; cheap tests first, entropy last."""
    if spec.stop_late and spec.end is not None:
        packets = P.stop_after(packets, spec.end)
    rows = P.select_time(packets, spec.start, spec.end)
    rows = P.select_spans(rows, "proto", spec.protocols, spec.protocols_wanted)
    rows = P.select_spans(rows, "port", spec.ports, spec.ports_wanted)
    if spec.alerts_wanted is not None and alerts is not None:
        rows = P.match_alert_times(rows, alerts, spec.alerts_wanted)
    if spec.alerted_hosts_wanted is not None and alerts is not None:
        rows = P.match_hosts(rows, P.alert_hosts(alerts, spec.safe), spec.alerted_hosts_wanted)
    if spec.listed_wanted is not None and listed is not None:
        rows = P.match_hosts(rows, listed, spec.listed_wanted)
    return P.select_entropy(rows, spec.entropy, spec.entropy_wanted)


def count(rows: DataFrame, spec: Spec) -> GramStore:
    if spec.store == "bloom":
        return BloomStore.build(rows, spec.low, spec.high, **_sizes(spec))
    return ExactStore.build(rows, spec.low, spec.high)


def _sizes(spec: Spec) -> dict:
    return {"k": spec.size.k, "per_entry": spec.size.per_entry} | spec.bloom


def keep(store: GramStore, spec: Spec) -> GramStore:
    """Saves a store where the spec says, and dumps it: n, address in hexadecimal or slot, counter. What the folder then has is given back."""
    if spec.keep_at:
        store.save(spec.keep_at, mode="append" if spec.append else "overwrite")
        spark = store.table.sparkSession
        store = BloomStore.load(spark, spec.keep_at, spec.low, spec.high, **_sizes(spec)) if spec.store == "bloom" else ExactStore.load(spark, spec.keep_at, spec.low, spec.high)
    if spec.dump_to:
        rows = store.dump()
        rows = rows if spec.store == "bloom" else rows.withColumn("g", F.hex("g"))
        rows.write.mode("overwrite").option("sep", " ").csv(spec.dump_to)
    return store


def summary(store: GramStore) -> DataFrame:
    """n, mu, sigma, max, min, variance over mean: one row per n."""
    return store.stats().select("n", "mu", "sigma", "max", "min", (F.col("sigma") ** 2 / F.col("mu")).alias("dispersion")).orderBy("n")


def analyse(packets: DataFrame, spec: Spec, **sides: DataFrame | None) -> DataFrame:
    return summary(keep(count(select(packets, spec, **sides), spec), spec))


def run(spark: SparkSession, options: dict[str, str], path: str) -> DataFrame:
    """The analysis of captures at path with command-line options; -s alert paths, -t days (else those that the alert files' own times allow), -l listed hosts."""
    spec = Spec.parse(options)
    if spec.start or spec.end:
        chosen = P.select_files(first_times(spark, path), spec.start, spec.end)
        path = [r["file"] for r in chosen.collect()]
    alerts = read_alerts(spark, options["s"], *(parsing.day_range(options["t"]) if "t" in options else ())) if "s" in options else None
    listed = hosts(spark, options["l"]) if "l" in options else None
    packets = P.decode(read_captures(spark, path), spec.protocols, spec.protocols_wanted)
    return analyse(packets, spec, alerts=alerts, listed=listed)


def services(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SERVICES, "port int, service string, expected_entropy string")


def icmp_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ICMP_TYPES, "port int, icmp_type string")
