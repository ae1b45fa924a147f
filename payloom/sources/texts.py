"""Text and whole-file sources: alert logs, host lists, numbers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from payloom.functions.measures import address, unsigned
from payloom.parsing import list_or_file, tokens

TIME = r"(\d\d)/(\d\d)-(\d\d:\d\d:\d\d\.\d{1,6})"
HOSTS = r"(\d+\.\d+\.\d+\.\d+)(?::\d+)? -> (\d+\.\d+\.\d+\.\d+)(?::\d+)?"


def alert_time(month: Column, day: Column, rest: Column, begin: dt.date, end: dt.date) -> Column:
    """The time of an alert without a year: the first year that puts its day into [begin, end); null if none does."""
    out = F.lit(None).cast("timestamp")
    for year in range(end.year, begin.year - 1, -1):
        made = F.try_to_timestamp(F.concat(F.lit(f"{year:04d}/"), month, F.lit("/"), day, F.lit(" "), F.rpad(rest, 15, "0")), F.lit("yyyy/MM/dd HH:mm:ss.SSSSSS"))
        date = made.cast("date")
        out = F.when((date >= F.lit(begin)) & (date < F.lit(end)), made).otherwise(out)
    return out


def parse_alerts(lines: DataFrame, begin: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
    """(file, line_no, line) -> file, line_no, ts, ymd, dgmlen, src, dst: alerts on the days from begin to before end.

    A line with a time is an alert; its datagram length is in the line after it, 0 if it isn't. Without days lines need
    another column, modified, and the days are those from a week before it to before the day after, as parsing.window_of has them.
    """
    after = F.lead("line").over(Window.partitionBy("file").orderBy("line_no"))
    more = [] if begin else ["modified"]
    rows = lines.select("file", "line_no", "line", *more, after.alias("after")).where(F.col("line").rlike(TIME))
    got = lambda p, i, c="line": F.regexp_extract(c, p, i)
    parts = [got(TIME, i) for i in (1, 2, 3)]
    if begin:
        ts = alert_time(*parts, begin, end)
    else:
        # of the window's two years, that of its last day and that of its first
        low, high = F.date_sub("modified", 7), F.date_add("modified", 1)
        made = [F.try_to_timestamp(F.concat(year.cast("string"), F.lit("/"), parts[0], F.lit("/"), parts[1], F.lit(" "), F.rpad(parts[2], 15, "0")), F.lit("yyyy/MM/dd HH:mm:ss.SSSSSS")) for year in (F.year(low), F.year(high))]
        ts = F.coalesce(*[F.when((m.cast("date") >= low) & (m.cast("date") < high), m) for m in made])
    size = F.coalesce(F.nullif(got(r"DgmLen:(\d+)", 1, "after"), F.lit("")).cast("int"), F.lit(0))
    out = rows.select("file", "line_no", ts.alias("ts"), size.alias("dgmlen"), address(got(HOSTS, 1)).alias("src"), address(got(HOSTS, 2)).alias("dst"))
    return out.where("ts IS NOT NULL").select("file", "line_no", "ts", F.col("ts").cast("date").alias("ymd"), "dgmlen", "src", "dst")


def read_lines(spark: SparkSession, paths: str) -> DataFrame:
    """(file, line_no, line, modified) of text files and folders; whole files, as line numbers are the file's."""
    files = spark.read.option("recursiveFileLookup", "true").text(tokens(list_or_file(paths)), wholetext=True)
    meta = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").cast("date").alias("modified")]
    rows = files.select(*meta, F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))
    return rows.select("file", F.col("line_no").cast("long").alias("line_no"), "line", "modified")


def read_alerts(spark: SparkSession, paths: str, begin: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
    """Alerts on the days from begin to before end, or on those that each file's modification time allows."""
    return parse_alerts(read_lines(spark, paths), begin, end)


def hosts(spark: SparkSession, text: str) -> DataFrame:
    """A list of hosts, or file=path with them, as (host)."""
    names = [(t,) for t in tokens(list_or_file(text))]
    return spark.createDataFrame(names, "name string").select(address(F.col("name")).alias("host")).where("host IS NOT NULL").distinct()


def read_hosts(spark: SparkSession, path: str) -> DataFrame:
    """A host per line."""
    return spark.read.text(path).select(address(F.trim("value")).alias("host")).where("host IS NOT NULL").distinct()


def read_numbers(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, x): numbers between white space, in the order of the file."""
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    rows = files.select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.filter(F.split("value", r"\s+"), lambda t: t != "")).alias("pos", "t"))
    return rows.select("file", F.col("pos").cast("long").alias("pos"), F.expr("try_cast(t AS double)").alias("x")).where("x IS NOT NULL")


def read_whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, payload): grams cross no seam, as a file is one payload."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path.split(","))
    return files.select(F.col("path").alias("file"), F.col("content").alias("payload"))


def read_unsigned(spark: SparkSession, path: str, width: int, order: str = "little") -> DataFrame:
    """(file, pos, x): unsigned numbers of 1, 2, 4 or 8 bytes that files hold one after the other; bytes left over at an end are no number."""
    rows = read_whole_files(spark, path).select("file", F.posexplode(unsigned(F.col("payload"), width, order)).alias("pos", "x"))
    return rows.select("file", F.col("pos").cast("long").alias("pos"), "x")
