"""Mixing sources to target weights by minimum-cost flow.

A document may belong to several sources. Documents are summed by membership pattern;
the patterns and sources form a flow network: a pattern sends words to the sources it
belongs to, a source takes its target. Sending a pattern's words a first, second and
third time costs 0, 1 and 2 a word (convex), nothing is sent a fourth time. Because costs
stand on the patterns alone, filling the network one repetition level after the other is
optimal: an augmenting path never takes back what an earlier level sent.

A pattern that sends r whole rounds and a part of the next gives every document r copies
and one more to those first in a seeded order. The cut in that order is found from a
histogram of the order's 4,096 stretches and from the rows of one stretch; what is then
missing is filled with one more document of each size class, the largest first. Only
sums by pattern, by (pattern, stretch) and by (pattern, size class) are shuffled; the cuts
are a broadcast table with one row a pattern (number checked), so texts never move.

Defined results: null text has size 0 and is never taken; null source is a source of its
own, last in order; rows with equal id and size are taken together; an empty table gives
no rows; more than MAX_PATTERNS patterns raise an error; other columns pass through.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpoint, fresh, n_words, table

WEIGHTS = (5, 2, 1)
MAX_TIMES = 3
SEED = "mix-1"
#: The driver holds one sum a pattern; the bound is checked, never cut.
MAX_PATTERNS = 200_000
STRETCH_BITS = 12


class Network:
    """Maximum flow by shortest augmenting paths, with capacities that may grow."""

    def __init__(self, n: int):
        self.out: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.free: list[int] = []

    def arc(self, a: int, b: int, capacity: int) -> int:
        for x, y, c in ((a, b, capacity), (b, a, 0)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.free.append(c)
        return len(self.to) - 2

    def augment(self, source: int, sink: int) -> None:
        while True:
            depth = {source: 0}
            queue = deque([source])
            while queue:
                v = queue.popleft()
                for e in self.out[v]:
                    if self.free[e] and self.to[e] not in depth:
                        depth[self.to[e]] = depth[v] + 1
                        queue.append(self.to[e])
            if sink not in depth:
                return
            at = [0] * len(self.out)
            path: list[int] = []
            v = source
            while True:
                if v == sink:
                    sent = min(self.free[e] for e in path)
                    for e in path:
                        self.free[e] -= sent
                        self.free[e ^ 1] += sent
                    path, v = [], source
                    continue
                while at[v] < len(self.out[v]):
                    e = self.out[v][at[v]]
                    if self.free[e] and depth.get(self.to[e]) == depth[v] + 1:
                        break
                    at[v] += 1
                else:
                    if v == source:
                        break
                    v = self.to[path.pop() ^ 1]
                    at[v] += 1
                    continue
                path.append(e)
                v = self.to[e]


def targets(sizes: dict[str | None, int], whole: int, weight: Callable[[int], float]) -> dict[str | None, float]:
    """Shares of whole by weight; none above MAX_TIMES its size, the excess reshared."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weights = {s: weight(i) for i, s in enumerate(order)}
    caps = {s: MAX_TIMES * sizes[s] for s in order}
    out: dict[str | None, float] = {}
    rest, heavy = whole, sum(weights.values())
    for s in sorted(order, key=lambda s: caps[s] / weights[s]):
        if caps[s] * heavy < rest * weights[s]:
            out[s] = float(caps[s])
            rest, heavy = rest - caps[s], heavy - weights[s]
        else:
            out[s] = rest * weights[s] / heavy
    return out


def route(patterns: dict[tuple, int], wanted: dict[str | None, float]) -> dict[tuple, dict[str | None, int]]:
    """Words that each pattern sends to each of its sources, at least cost."""
    keys, sources = sorted(patterns, key=repr), sorted(wanted, key=lambda s: (s is None, s))
    at = {s: 1 + len(keys) + i for i, s in enumerate(sources)}
    sink = 1 + len(keys) + len(sources)
    net = Network(sink + 1)
    supply = [net.arc(0, 1 + i, 0) for i in range(len(keys))]
    arcs = {(k, s): net.arc(1 + i, at[s], MAX_TIMES * patterns[k]) for i, k in enumerate(keys) for s in k}
    for s in sources:
        net.arc(at[s], sink, round(wanted[s]))
    for _ in range(MAX_TIMES):  # a level costs more than all before it
        for i, k in enumerate(keys):
            net.free[supply[i]] += patterns[k]
        net.augment(0, sink)
    return {k: {s: net.free[arcs[k, s] ^ 1] for s in k} for k in keys}


def _pattern(members: Column) -> Column:
    """One string for a set of sources; '-' is the null source, '+' begins a name."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(members, lambda s: F.coalesce(F.concat(F.lit("+"), s), F.lit("-"))))), "\x00")


def _sources(pattern: str) -> tuple:
    return tuple(None if s == "-" else s[1:] for s in pattern.split("\x00"))


def _place(doc_id: Column, seed: str) -> Column:
    """32 bits that order the documents for a seed."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 8), 16, 10).cast("long")


def planned(
    docs: DataFrame, members: Column, size: Column, weight: Callable[[int], float] = lambda i: WEIGHTS[i % len(WEIGHTS)], seed: str = SEED
) -> tuple[DataFrame, DataFrame, dict[str | None, float]]:
    """Narrow rows (doc_id, pattern, size, place), the cut of each pattern, the targets.

    A cut row: pattern, rounds, the last key (place, id, size) taken once more, and the
    keys of the documents that fill what is still missing.
    """
    spark = docs.sparkSession
    rows = checkpoint(docs.select(F.col("doc_id"), _pattern(members).alias("pattern"), size.alias("size"), _place(F.col("doc_id"), seed).alias("place")))
    sums = rows.groupBy("pattern").agg(F.sum("size").alias("s")).limit(MAX_PATTERNS + 1).collect()
    if len(sums) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    held = {_sources(r.pattern): r.s for r in sums}
    by_source: dict[str | None, int] = {}
    for k, s in held.items():
        for x in k:
            by_source[x] = by_source.get(x, 0) + s
    wanted = targets(by_source, sum(held.values()), weight)
    flow = route(held, wanted)
    plan = []
    for r in sums:
        sent = sum(flow[_sources(r.pattern)].values())
        rounds = sent // r.s if r.s else 0
        plan.append((r.pattern, int(rounds), int(sent - rounds * r.s)))
    rounds = F.broadcast(spark.createDataFrame(plan, "pattern string, rounds long, part long"))

    stretch = F.shiftright("place", 32 - STRETCH_BITS)
    hist = rows.groupBy("pattern", stretch.alias("stretch")).agg(F.sum("size").alias("s"))
    upto = F.sum("s").over(Window.partitionBy("pattern").orderBy("stretch").rowsBetween(Window.unboundedPreceding, 0))
    crossing = hist.withColumn("upto", upto).join(rounds, "pattern").where((F.col("upto") > F.col("part")) & (F.col("upto") - F.col("s") <= F.col("part")))
    # One row a pattern: the stretch in which its part ends. A pattern without words has none.
    crossing = crossing.select("pattern", "stretch", (F.col("upto") - F.col("s")).alias("before"))
    key = F.struct(F.col("place"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), F.col("size"))
    inside = rows.withColumn("stretch", stretch).join(F.broadcast(crossing), ["pattern", "stretch"]).withColumn("key", key)
    running = F.sum("size").over(Window.partitionBy("pattern").orderBy("key").rangeBetween(Window.unboundedPreceding, 0))
    fits = inside.withColumn("upto", F.col("before") + running).join(rounds, "pattern").where(F.col("upto") <= F.col("part"))
    fits = fits.groupBy("pattern").agg(F.max("key").alias("last"), F.max("upto").alias("got"))
    cuts = rounds.join(crossing, "pattern", "left").join(fits, "pattern", "left")
    first = F.struct(F.shiftleft(F.col("stretch"), 32 - STRETCH_BITS).alias("place"), F.lit(-(1 << 63)).alias("id"), F.lit(-1).cast("long").alias("size"))
    cuts = checkpoint(
        cuts.select("pattern", "rounds", F.coalesce("last", first).alias("last"), (F.col("part") - F.coalesce("got", "before", F.lit(0))).alias("gap"))
    )
    left = rows.withColumn("key", key).join(F.broadcast(cuts), "pattern").where((F.col("key") > F.col("last")) & (F.col("size") > 0) & (F.col("size") <= F.col("gap")))
    # Equal rows would be taken together, so they count together as one candidate.
    whole = left.groupBy("pattern", "key", "gap").agg(F.sum("size").alias("weight")).where("weight <= gap")
    one = whole.groupBy("pattern", "gap", F.length(F.bin("weight")).alias("class")).agg(F.min(F.struct("key", "weight")).alias("c"))
    listed = one.groupBy("pattern", "gap").agg(F.sort_array(F.collect_list(F.struct("class", "c")), asc=False).alias("cs"))  # 63 classes at most
    chosen = F.aggregate(
        "cs",
        F.struct(F.col("gap").alias("gap"), F.array().cast("array<struct<place:bigint,id:bigint,size:bigint>>").alias("keys")),
        lambda a, x: F.when(x["c"]["weight"] <= a["gap"], F.struct((a["gap"] - x["c"]["weight"]).alias("gap"), F.array_append(a["keys"], x["c"]["key"]).alias("keys"))).otherwise(a),
    )
    return rows, cuts.join(listed.select("pattern", chosen["keys"].alias("fill")), "pattern", "left").drop("gap"), wanted


def copies(rows: DataFrame, cuts: DataFrame, doc_id: str, size: str, place: str, pattern: str, name: str) -> DataFrame:
    """rows with the number of times each is taken as column name."""
    own = fresh(rows, "c_pattern", "c_rounds", "c_last", "c_fill")
    cuts = F.broadcast(cuts.select(*(F.col(a).alias(b) for a, b in zip(("pattern", "rounds", "last", "fill"), own, strict=True))))
    key = F.struct(F.col(place).alias("place"), F.coalesce(F.col(doc_id), F.lit(-(1 << 63))).alias("id"), F.col(size).alias("size"))
    again = (key <= F.col(own[2])) | F.coalesce(F.array_contains(own[3], key), F.lit(False))
    taken = F.when(F.col(size) > 0, F.col(own[1]) + F.coalesce(again, F.lit(False)).cast("long")).otherwise(F.lit(0).cast("long"))
    return rows.join(cuts, F.col(pattern) == F.col(own[0])).withColumn(name, taken).drop(*own)


def mix(docs: DataFrame, members: Sequence[str] = ("source",), seed: str = SEED) -> DataFrame:
    """Rows of docs, each as many times as the mix takes it; columns unchanged.

    members: columns that each name a source of the document.
    """
    size, place, pattern, times = fresh(docs, "m_size", "m_place", "m_pattern", "m_times")
    own = F.array(*(F.col(c) for c in members))
    _, cuts, _ = planned(docs, own, n_words(F.col("text")), seed=seed)
    df = docs.withColumns({size: n_words(F.col("text")), place: _place(F.col("doc_id"), seed), pattern: _pattern(own)})
    df = copies(df, cuts, "doc_id", size, place, pattern, times)
    again = fresh(df, "m_again")[0]
    return df.withColumn(again, F.explode(F.array_repeat(F.lit(1), F.col(times).cast("int")))).select(*(F.col(c) for c in docs.columns))


def op3_mixing_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows, cuts, wanted = planned(docs, F.array("source"), n_words(F.col("text")))
    df = copies(rows, cuts, "doc_id", "size", "place", "pattern", "times")
    by_source = rows.groupBy("pattern").agg(F.sum("size").alias("source_size"))
    goals = spark.createDataFrame([(_plain(s), float(t)) for s, t in wanted.items()], "pattern string, target double")
    df = df.join(F.broadcast(by_source), "pattern").join(F.broadcast(goals), "pattern")
    return df.select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"))


def _plain(source: str | None) -> str:
    return "-" if source is None else "+" + source


def oracle(documents: str = "documents") -> str:
    """The same mix in DuckDB: with one source a document the flow is the target."""
    return f"""
WITH rows AS MATERIALIZED (
  SELECT doc_id, source, coalesce(doc_id, -9223372036854775808) AS id, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
    CAST('0x' || left(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 8) AS BIGINT) AS place FROM {documents}),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, {MAX_TIMES} * CAST(sum(size) AS BIGINT) AS cap,
    [{', '.join(map(str, WEIGHTS))}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS w FROM rows GROUP BY source),
filled AS (
  SELECT *, (SELECT sum(source_size) FROM sources) - coalesce(sum(cap) OVER o, 0) AS rest, (SELECT sum(w) FROM sources) - coalesce(sum(w) OVER o, 0) AS heavy
  FROM sources WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT min(CAST(rest AS DOUBLE) / heavy) AS per FROM filled WHERE NOT cap * heavy < rest * w),
goals AS (
  SELECT f.source, source_size, CASE WHEN cap * heavy < rest * w THEN CAST(cap AS DOUBLE) ELSE
    (SELECT any_value(rest) FROM filled g WHERE heavy = (SELECT max(heavy) FROM filled h WHERE NOT h.cap * h.heavy < h.rest * h.w)) * CAST(w AS DOUBLE)
    / (SELECT max(heavy) FROM filled h WHERE NOT h.cap * h.heavy < h.rest * h.w) END AS target FROM filled f),
parts AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(round_even(target, 0) AS BIGINT) // source_size END AS rounds,
    CASE WHEN source_size = 0 THEN 0 ELSE CAST(round_even(target, 0) AS BIGINT) % source_size END AS part FROM goals),
ordered AS MATERIALIZED (
  SELECT r.*, source_size, target, rounds, part, sum(size) OVER (PARTITION BY r.source ORDER BY place, id, size) AS upto
  FROM rows r JOIN parts p ON r.source IS NOT DISTINCT FROM p.source),
gaps AS (SELECT source, any_value(part) - coalesce(max(upto) FILTER (upto <= part), 0) AS gap FROM ordered GROUP BY source),
keys AS (
  SELECT o.source, place, id, size, gap, sum(size) AS weight FROM ordered o JOIN gaps g ON o.source IS NOT DISTINCT FROM g.source
  WHERE upto > part AND size > 0 AND size <= gap GROUP BY ALL),
classes AS (
  SELECT source, gap, length(bin(CAST(weight AS BIGINT))) AS class, min({{'place': place, 'id': id, 'size': size, 'weight': CAST(weight AS BIGINT)}}) AS c
  FROM keys WHERE weight <= gap GROUP BY ALL),
lists AS (SELECT source, gap, list(c ORDER BY class DESC) AS cs FROM classes GROUP BY source, gap),
walk AS (
  SELECT source, unnest(range(1, len(cs) + 1)) AS i, cs, gap FROM lists),
recursive_fill AS (
  SELECT source, list_reduce(cs, lambda a, x: CASE WHEN x.weight <= a.gap THEN {{'gap': a.gap - x.weight, 'keys': list_append(a.keys, {{'place': x.place, 'id': x.id, 'size': x.size}})}} ELSE a END,
    {{'gap': CAST(gap AS BIGINT), 'keys': CAST([] AS STRUCT(place BIGINT, id BIGINT, size BIGINT)[])}}) AS f FROM lists),
fill AS (SELECT source, unnest(f.keys) AS k FROM recursive_fill)
SELECT o.doc_id, o.size, o.source_size, o.target,
  CAST(CASE WHEN o.size = 0 THEN 0 ELSE o.size * (rounds + CASE WHEN upto <= part OR k IS NOT NULL THEN 1 ELSE 0 END) END AS BIGINT) AS taken
FROM ordered o LEFT JOIN fill ON o.source IS NOT DISTINCT FROM fill.source AND k.place = o.place AND k.id = o.id AND k.size = o.size"""
