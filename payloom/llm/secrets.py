r"""Secret scans over a trigram inverted index, with DataFrame functions only.

Each rule's regular expression gives a Boolean trigram query (see trigrams). The index holds a posting (trigram, row)
for each trigram that the rules ask for and each text in which it occurs, sorted by trigram in its files; the
postings of a row are brought together, the queries are evaluated on them, and only rows that satisfy a rule's query are
scanned with its expression. Rules without mandatory trigrams (hex runs) scan every text.

Postings and candidates are narrow. Up to `BROADCAST_CANDIDATES` candidates (counted first) come back to the texts by
broadcast, and no text is shuffled; beyond that, texts in which some query holds are shuffled to them, and no others.

Spans are code points, end exclusive, found as running sums over the parts between matches and the matches themselves;
sums are made over blocks of blocks of `BLOCK` matches, each level a column of its own, so a text with very many matches
costs time in proportion to them (and to the square of their number over BLOCK^2). A rule's matches are leftmost and
don't overlap; those that fail its least length are dropped afterwards.

Defined results: a null text is empty and has no spans; rows with a null or repeated id are scanned like others; an
empty table gives an empty one. Other columns are ignored, whatever their names. Redaction puts [kind] in the place of
each span (spans that overlap count as one, under the first's kind).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from payloom.llm.common import stored, table
from payloom.llm.trigrams import Query, trigram_query

BLOCK = 64
#: Candidate rows (some 60 bytes each) that are broadcast at most.
BROADCAST_CANDIDATES = 1_000_000


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: Characters that group `group` must have.
    least: int = 0
    group: int = 0

    @property
    def query(self) -> Query:
        return trigram_query(self.pattern)


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(map(_either_case, ("password", "passwd", "secret", "token"))) + "|" + _either_case("api") + "_?" + _either_case("key")
BASE = (
    Rule("assign", rf"""({_KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE = (
    Rule("github", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("private", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
)
RULES = BASE + MORE


def row_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col).cast("string"), F.col(text_col).cast("string"))


def build_index(docs: DataFrame, trigrams: list[str], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings (trigram, key), stored in the shared folder."""
    low = docs.select(row_key(id_col, text_col).alias("key"), F.lower(F.col(text_col).cast("string")).alias("low"))
    present = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]))
    return stored(low.select("key", F.explode(present).alias("trigram")).sortWithinPartitions("trigram"), "postings")


def candidates(postings: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(key, kinds): the rows whose postings satisfy the queries of the named rules."""
    asked = [r for r in rules if r.query]
    wanted = sorted({t for r in asked for clause in r.query for s in clause for t in s})
    place = {t: i for i, t in enumerate(wanted)}
    width = 63
    words = [[t for t in wanted if place[t] // width == w] for w in range(len(wanted) // width + 1)]
    rows = postings.where(F.col("trigram").isin(wanted))
    bits = [F.bit_or(F.when(F.col("trigram").isin(ts), reduce(lambda acc, t: F.when(F.col("trigram") == t, F.lit(1 << place[t] % width)).otherwise(acc), ts, F.lit(0))).otherwise(F.lit(0)).cast("long")).alias(f"w{w}") for w, ts in enumerate(words) if ts]
    merged = rows.groupBy("key").agg(*bits)

    def all_of(s: frozenset[str]) -> Column:
        masks: dict[int, int] = {}
        for t in s:
            masks[place[t] // width] = masks.get(place[t] // width, 0) | 1 << place[t] % width
        return reduce(lambda a, b: a & b, [F.col(f"w{w}").bitwiseAND(F.lit(m)) == F.lit(m) for w, m in masks.items()])

    def holds(query: Query) -> Column:
        return reduce(lambda a, b: a & b, [reduce(lambda a, b: a | b, map(all_of, clause)) for clause in query])

    kinds = F.array_compact(F.array(*[F.when(holds(r.query), F.lit(r.kind)) for r in asked]))
    return merged.select("key", kinds.alias("kinds")).where(F.size("kinds") > 0)


def with_running(rows: DataFrame, names: dict[str, str], most: bool = False) -> DataFrame:
    """Adds, for each array column of longs (names: new -> given), the sums (most: the maxima, 0 at least) of all earlier elements.

    Blocks, and blocks of blocks, are columns of their own; each is named more than once, so that Spark doesn't put its
    expression into the lambdas that read it.
    """
    zero = F.lit(0).cast("long")
    plus = (lambda x, y: F.greatest(x, y)) if most else (lambda x, y: x + y)
    total = lambda a: F.aggregate(a, zero, plus)
    empty = F.array().cast("array<bigint>")

    def blocks(c: str) -> Column:
        n = F.ceil(F.size(c) / F.lit(BLOCK)).cast("int")
        return F.when(F.size(c) > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda b: total(F.slice(c, b * BLOCK + 1, F.lit(BLOCK))))).otherwise(empty)

    def one(c: str, i: Column) -> Column:
        block, top = F.floor(i / BLOCK).cast("int"), F.floor(i / (BLOCK * BLOCK)).cast("int")
        within = total(F.slice(f"{c}_b", top * BLOCK + 1, block - top * BLOCK))
        return plus(plus(F.element_at(f"{c}_t", top + 1), within), total(F.slice(c, block * BLOCK + 1, i - block * BLOCK)))

    def reader(c: str) -> Callable:
        return lambda x, i: one(c, i)

    rows = rows.select("*", *[blocks(c).alias(f"{c}_b") for c in names.values()])
    rows = rows.select("*", *[blocks(f"{c}_b").alias(f"{c}_c") for c in names.values()])
    before = lambda c: F.when(F.size(c) > 0, F.transform(c, lambda x, k: total(F.slice(c, F.lit(1), k)))).otherwise(empty)
    rows = rows.select("*", *[before(f"{c}_c").alias(f"{c}_t") for c in names.values()])
    made = [F.when((F.size(f"{c}_t") > 0) & (F.size(f"{c}_b") > 0), F.transform(c, reader(c))).otherwise(empty).alias(new) for new, c in names.items()]
    return rows.select("*", *made).drop(*[f"{c}_{x}" for c in names.values() for x in "bct"])


SPAN = "array<struct<start:bigint,rank:int,end:bigint,kind:string>>"


def _holds(query: Query, low: Column) -> Column:
    """Whether a trigram query holds for a lower-cased text."""
    all_of = lambda s: reduce(lambda a, b: a & b, [F.contains(low, F.lit(t)) for t in sorted(s)])
    return reduce(lambda a, b: a & b, [reduce(lambda a, b: a | b, map(all_of, clause)) for clause in query])


def _with_kinds(rows: DataFrame, named: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """rows (key, body, ...) with the kinds that the index named for them, or null."""
    if named.count() <= BROADCAST_CANDIDATES:
        return rows.join(F.broadcast(named), "key", "left")
    some = F.coalesce(reduce(lambda a, b: a | b, [_holds(r.query, F.lower("body")) for r in rules if r.query]), F.lit(False))
    asked = rows.withColumn("asked", some)
    none = F.lit(None).cast("array<string>").alias("kinds")
    return asked.where("asked").drop("asked").join(named, "key", "left").unionByName(asked.where("NOT asked").drop("asked").select("*", none))


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, carry: bool = False) -> DataFrame:
    """row (the id) and found: the spans (start, rank, end, kind) in order of start, then of the rules.

    carry: row is a struct of all columns, body has the text, and spans are bytes of its UTF-8, not code points.
    """
    trigrams = sorted({t for r in rules for clause in r.query for s in clause for t in s})
    named = stored(candidates(build_index(docs, trigrams, id_col=id_col, text_col=text_col), rules), "candidates")
    rows = docs.select(F.struct("*").alias("row") if carry else F.col(id_col).alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"), row_key(id_col, text_col).alias("key"))
    rows = _with_kinds(rows, named, rules)
    hit = lambda r: F.array_contains("kinds", r.kind) if r.query else F.lit(True)
    none = F.array().cast("array<string>")
    rows = rows.select("row", "body", *[F.when(hit(r), F.regexp_extract_all("body", F.lit(r.pattern), F.lit(0))).otherwise(none).alias(f"m{i}") for i, r in enumerate(rules)])
    parts = [F.when(F.size(f"m{i}") > 0, F.split("body", r.pattern, -1)).otherwise(none).alias(f"p{i}") for i, r in enumerate(rules)]
    rows = rows.select("row", *["body"] * carry, *[f"m{i}" for i in range(len(rules))], *parts)
    size = lambda x: (F.octet_length(x) if carry else F.length(x)).cast("long")
    lengths = [F.zip_with(F.slice(f"p{i}", 1, F.size(f"m{i}")), f"m{i}", lambda p, m: size(p) + size(m)).alias(f"l{i}") for i in range(len(rules))]
    rows = with_running(rows.select("*", *lengths), {f"s{i}": f"l{i}" for i in range(len(rules))})

    def spans(i: int, r: Rule) -> Column:
        at = F.zip_with(f"s{i}", F.slice(f"p{i}", 1, F.size(f"m{i}")), lambda s, p: s + size(p))
        made = F.zip_with(at, f"m{i}", lambda s, m: F.struct(s.alias("start"), F.lit(i).alias("rank"), (s + size(m)).alias("end"), F.lit(r.kind).alias("kind"), m.alias("match")))
        if r.least:
            made = F.filter(made, lambda x: F.length(F.regexp_extract(x["match"], r.pattern, r.group)) >= r.least)
        made = F.transform(made, lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"), x["kind"].alias("kind")))
        return F.when(F.size(f"m{i}") > 0, made).otherwise(F.array().cast(SPAN))

    found = F.sort_array(F.concat(*[spans(i, r) for i, r in enumerate(rules)])).alias("found")
    return rows.select("row", *["body"] * carry, found)


def redact(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents with [kind] in the place of each secret; chars_col, where there is such a column, counts anew."""
    scanned = scan_secrets(docs, id_col=id_col, text_col=text_col, rules=rules, carry=True)
    scanned = scanned.select("row", "found", F.col("body").cast("binary").alias("raw"), F.transform("found", lambda x: x["end"]).alias("ends"))
    scanned = with_running(scanned, {"before": "ends"}, most=True)  # where the spans before each one end
    cut = lambda a, b: F.decode(F.substring("raw", (a + 1).cast("int"), (b - a).cast("int")), "UTF-8")
    first = F.filter(F.arrays_zip("found", "before"), lambda x: x["found"]["start"] >= x["before"])
    marks = F.transform(first, lambda x: F.concat(cut(x["before"], x["found"]["start"]), F.lit("["), x["found"]["kind"], F.lit("]")))
    clean = F.concat(F.array_join(marks, ""), cut(F.array_max("ends"), F.length("raw")))
    scanned = scanned.select("row", F.when(F.size("found") > 0, clean).otherwise(F.col("row").getField(text_col)).alias("clean"))
    out = []
    for field in docs.schema.fields:
        own = F.col("row").getField(field.name)
        if field.name == text_col:
            own = F.col("clean")
        elif field.name == chars_col:
            own = F.when(F.col("clean").eqNullSafe(F.col("row").getField(text_col)), own).otherwise(F.length("clean")).cast(field.dataType)
        out.append(own.alias(field.name))
    return scanned.select(*out)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    count = lambda i: F.size(F.filter("found", lambda s: s["rank"] == i)).cast("long").alias(f"n_{BASE[i].kind}")
    base = F.filter("found", lambda s: s["rank"] < len(BASE))
    return found.select(F.col("row").alias("doc_id"), *map(count, range(len(BASE))), F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))


def _rule_sql(i: int, r: Rule) -> str:
    pattern = r.pattern.replace("'", "''")
    keep = f"WHERE length(regexp_extract(m[k], '{pattern}', {r.group})) >= {r.least}" if r.least else ""
    return f"""
  SELECT n, {i} AS rank, '{r.kind}' AS kind, list_sum(list_transform(p[1 : k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1 : k - 1], lambda x: length(x))), 0) AS a, length(m[k]) AS size
  FROM (SELECT n, m, string_split_regex(body, '{pattern}') AS p, unnest(range(1, len(m) + 1)) AS k
        FROM (SELECT n, body, regexp_extract_all(body, '{pattern}') AS m FROM d) WHERE len(m) > 0) {keep}"""


OP5_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS body FROM documents),
s AS ({" UNION ALL ".join(_rule_sql(i, r) for i, r in enumerate(RULES))}),
g AS (
  SELECT n, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
    string_agg(one, ',' ORDER BY a, rank) FILTER (rank < 3) AS base, string_agg(one, ',' ORDER BY a, rank) AS spans
  FROM (SELECT n, rank, a, kind || ':' || a::BIGINT || ':' || (a + size)::BIGINT AS one FROM s) GROUP BY n)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (n)
"""

QUERIES = {"op5_secrets": op5_secrets}
ORACLES = {"op5_secrets": OP5_SQL}
