"""Sharding along a Hilbert curve (DataFrame functions only).

Language, source, size and id of a document are quantised to BITS bits each and
woven into one index on a Hilbert curve. Documents sorted by that index are cut into
runs; each run covers a compact box of the metadata space, so a reader that filters on
any of the dimensions skips most files. Law: ``rows``; the runs' lengths differ by one
at most.

The global rank needs no global sort in one task: equal rows become one with their number,
rows are counted by cell of the curve, a cell of many rows is cut into sub-buckets of some
CELL_ROWS by a hash, the counts are summed first over 2 ** STRETCH_BITS stretches of the
curve and then inside each stretch, and a row adds its rank inside its own sub-bucket. Only
narrow columns are shuffled, never the text; they are written once to the checkpoint
folder, so the text is read once.

Defined results: null language, source or id takes the lowest level of its dimension
and sorts first; null text has size 1 and checksum 0; equal rows are interchangeable and
each gets a slot of its own; an empty table gives no rows; columns beyond the five that
are read are ignored by ``assign`` and kept by ``write_shards``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpoint, fresh, table

DIMS, BITS = 4, 5
STATE_BITS = DIMS + 2
#: Rows of a cell that one sub-bucket is meant to hold.
CELL_ROWS = 1 << 16
STRETCH_BITS = 14
N_SHARDS = 8
LEVELS = (1 << BITS) - 2  # levels 1 .. LEVELS + 1; 0 is for null


def _turn(x: int, k: int) -> int:
    """x, of DIMS bits, rotated right by k."""
    k %= DIMS
    return ((x >> k) | (x << (DIMS - k))) & ((1 << DIMS) - 1)


def curve_table() -> list[int]:
    """For each (state, corner): the corner's place on the curve and the next state.

    A state is the entry corner and the direction of the sub-cube's curve; an entry is
    place << STATE_BITS | next state.
    """

    def gray(i: int) -> int:
        return i ^ (i >> 1)

    def ones(i: int) -> int:
        return (~i & (i + 1)).bit_length() - 1

    place = {gray(i): i for i in range(1 << DIMS)}
    out = []
    for state in range(1 << STATE_BITS):
        entry, way = state >> 2, state & 3
        for corner in range(1 << DIMS):
            w = place[_turn(corner ^ entry, way + 1)]
            first = 0 if w == 0 else gray(2 * ((w - 1) // 2))
            along = 0 if w == 0 else ones(w - 1 if w % 2 == 0 else w) % DIMS
            nxt = (entry ^ _turn(first, -(way + 1))) << 2 | (way + along + 1) % DIMS
            out.append(w << STATE_BITS | nxt)
    return out


def curve_index(levels: list[Column]) -> Column:
    """Place on the Hilbert curve of a point with DIMS levels of BITS bits each."""
    steps = F.lit(curve_table())

    def step(acc: Column, bit: Column) -> Column:
        corner = sum(
            (F.call_function("shiftleft", F.call_function("shiftright", p, bit).bitwiseAND(F.lit(1)), F.lit(j)) for j, p in enumerate(levels)),
            F.lit(0),
        )
        at = F.shiftleft(acc.bitwiseAND(F.lit((1 << STATE_BITS) - 1)), DIMS).cast("int") + corner
        return F.shiftleft(F.shiftright(acc, STATE_BITS), DIMS + STATE_BITS) + F.get(steps, at)

    walked = F.aggregate(F.sequence(F.lit(BITS - 1), F.lit(0), F.lit(-1)), F.lit(0).cast("long"), step)
    return F.shiftright(walked, STATE_BITS)


def _common(a: str, b: str) -> int:
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def _bytes_value(text: Column, skip: int) -> Column:
    """First four UTF-8 bytes after the common prefix as a number; keeps the order."""
    code = F.rpad(F.hex(F.encode(F.substring(text, skip + 1, 4), "UTF-8")), 8, "0")
    return F.conv(code, 16, 10).cast("long").cast("double")


def _level(value: Column, low: float, high: float) -> Column:
    scaled = F.floor((value - F.lit(float(low))) / F.lit(max(float(high) - float(low), 1.0)) * LEVELS).cast("int") + 1
    return F.coalesce(scaled, F.lit(0))


def _string_level(column: str, low: str | None, high: str | None) -> Column:
    if low is None:
        return F.lit(0)
    skip = _common(low, high)
    value = lambda s: int(s[skip : skip + 4].encode().hex().upper().ljust(8, "0")[:8], 16)
    return _level(_bytes_value(F.col(column), skip), value(low), value(high))


def _levels(docs: DataFrame) -> tuple[DataFrame, int]:
    """docs with size, text_crc32 and curve, and their number."""
    at = docs.agg(
        F.count(F.lit(1)).alias("n"),
        *(f(c).alias(f"{k}_{c}") for c in ("lang", "source", "doc_id") for k, f in (("lo", F.min), ("hi", F.max))),
    ).first()
    names = fresh(docs, "size", "text_crc32", "curve")
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long") + 1
    levels = [
        _string_level("lang", at.lo_lang, at.hi_lang),
        _string_level("source", at.lo_source, at.hi_source),
        F.least(F.length(F.bin(size)) - 1, F.lit((1 << BITS) - 1)),
        _level(F.col("doc_id").cast("double"), at.lo_doc_id or 0, at.hi_doc_id or 0),
    ]
    return docs.withColumns(dict(zip(names, (size, F.crc32(F.coalesce("text", F.lit(""))), curve_index(levels)), strict=True))), at.n


KEY = ["doc_id", "size", "text_crc32", "curve"]


def _ranked(docs: DataFrame) -> tuple[DataFrame, int]:
    """Distinct KEY rows with their number c and the place `at` of the first; the number of docs."""
    df, n = _levels(docs.select("doc_id", "text", "lang", "source"))
    rows = checkpoint(df.groupBy(*KEY).agg(F.count(F.lit(1)).alias("c")))
    # A row a cell: at most 2 ** (DIMS * BITS), about a million, whatever the input.
    cells = rows.groupBy("curve").agg(F.ceil(F.count(F.lit(1)) / CELL_ROWS).alias("subs"))
    rows = rows.join(F.broadcast(cells), "curve").withColumn("sub", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.col("subs"))).drop("subs")
    counts = rows.groupBy("curve", "sub").agg(F.sum("c").alias("c")).withColumn("stretch", F.shiftright("curve", DIMS * BITS - STRETCH_BITS))
    # At most 2 ** STRETCH_BITS rows.
    stretches = counts.groupBy("stretch").agg(F.sum("c").alias("c"))
    before = stretches.select("stretch", (F.sum("c").over(Window.orderBy("stretch")) - F.col("c")).alias("base"))
    running = F.sum("c").over(Window.partitionBy("stretch").orderBy("curve", "sub").rowsBetween(Window.unboundedPreceding, 0))
    offsets = counts.withColumn("run", running - F.col("c")).join(F.broadcast(before), "stretch").select("curve", "sub", (F.col("run") + F.col("base")).alias("start"))
    upto = F.sum("c").over(Window.partitionBy("curve", "sub").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, 0))
    at = rows.withColumn("upto", upto - F.col("c")).join(offsets, ["curve", "sub"])
    return at.select(*KEY, "c", (F.col("start") + F.col("upto")).alias("at")), n


def _sharded(at: Column, n: int, n_shards: int) -> tuple[Column, Column]:
    """Shard and slot of the place `at` among n."""
    total = F.lit(max(n, 1)).cast("long")
    shard = F.call_function("div", n_shards * (at + 1) - 1, total).cast("int")
    return shard, at - F.call_function("div", shard.cast("long") * total, F.lit(n_shards).cast("long"))


def assign(docs: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, curve of every row."""
    rows, n = _ranked(docs)
    nth = F.explode(F.sequence(F.lit(0).cast("long"), F.col("c") - 1))
    rows = rows.select(*KEY, "at", nth.alias("nth")).withColumn("at", F.col("at") + F.col("nth"))
    shard, slot = _sharded(F.col("at"), n, n_shards)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.alias("shard"), slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve")


def write_shards(docs: DataFrame, path: str, n_shards: int = N_SHARDS, files_per_shard: int = 1) -> DataFrame:
    """Writes whole documents to path/shard=N, in curve order; returns shard boxes.

    Every row of docs is written once, with all its columns (a column named shard as shard
    of the input: _shard); the boxes hold the least and greatest value of each dimension
    for file pruning.
    """
    df, _ = _levels(docs)
    own = dict(zip(KEY[1:], df.columns[len(docs.columns) :], strict=True)) | {"doc_id": "doc_id"}
    ranked, n = _ranked(docs)
    names = fresh(df, "r_doc_id", "r_size", "r_text_crc32", "r_curve", "r_c", "r_at", "r_nth")
    ranked = ranked.toDF(*names[:6])
    same = [df[own[k]].eqNullSafe(ranked[r]) for k, r in zip(KEY, names, strict=False)]
    # Equal rows take the places from `at` on, in any order.
    nth = F.row_number().over(Window.partitionBy(*names[:4]).orderBy(names[5])) - 1
    at = F.col(names[5]) + F.col(names[6])
    shard, slot = _sharded(at, n, n_shards)
    given = {c: "_" + c for c in docs.columns if c.lower() == "shard"}
    df = df.join(ranked, same[0] & same[1] & same[2] & same[3]).withColumn(names[6], nth)
    placed = df.select(*(F.col(c).alias(given.get(c, c)) for c in docs.columns), shard.alias("shard"), slot.alias(names[6]))
    parts = placed.repartitionByRange(n_shards * files_per_shard, "shard", names[6]).sortWithinPartitions("shard", names[6])
    parts.drop(names[6]).write.partitionBy("shard").parquet(path)
    size = F.octet_length(F.coalesce("text", F.lit("")))
    return (
        docs.sparkSession.read.parquet(path)
        .groupBy("shard")
        .agg(F.count(F.lit(1)).alias("rows"), *(f(c).alias(f"{k}_{a}") for a, c in (("lang", F.col("lang")), ("source", F.col("source")), ("doc_id", F.col("doc_id")), ("bytes", size)) for k, f in (("min", F.min), ("max", F.max))))
    )


def op1_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"))


def oracle() -> str:
    """The same shards in DuckDB while no cell holds over CELL_ROWS distinct rows; the checksum
    runs over bytes by its lookup table."""
    crc = []
    for i in range(256):
        for _ in range(8):
            i = (i >> 1) ^ (0xEDB88320 if i & 1 else 0)
        crc.append(i)
    steps, mask = curve_table(), (1 << STATE_BITS) - 1
    text = lambda c: f"coalesce(cast(('0x' || left(rpad(hex(encode(substr({c}, k_{c} + 1, 4))), 8, '0'), 8)) as bigint), 0)"
    end = lambda c, m: f"cast(('0x' || left(rpad(hex(encode(substr({m}_{c}, k_{c} + 1, 4))), 8, '0'), 8)) as bigint)"
    prefix = lambda c: f"(select max(i) from range(0, 200) t(i) where left(lo_{c}, i) = left(hi_{c}, i) and i <= least(length(lo_{c}), length(hi_{c})))"
    level = lambda c: f"case when {c} is null then 0 else 1 + cast(floor(cast({text(c)} - {end(c, 'lo')} as double) / greatest({end(c, 'hi')} - {end(c, 'lo')}, 1) * {LEVELS}) as int) end"
    corner = " + ".join(f"((({p} >> i) & 1) << {j})" for j, p in enumerate(("a", "b", "c", "d")))
    return f"""
WITH bounds AS (
  SELECT count(*) AS n, min(lang) AS lo_lang, max(lang) AS hi_lang, min(source) AS lo_source, max(source) AS hi_source,
         min(doc_id) AS lo_id, max(doc_id) AS hi_id FROM documents),
skips AS (SELECT *, {prefix('lang')} AS k_lang, {prefix('source')} AS k_source FROM bounds),
sized AS (
  SELECT doc_id, lang, source, strlen(coalesce(text, '')) + 1 AS size,
    list_reduce(list_transform(string_split(regexp_replace(hex(encode(coalesce(text, ''))), '(..)', '\\1,', 'g'), ','),
      lambda x: CASE WHEN x = '' THEN CAST(-1 AS BIGINT) ELSE CAST('0x' || x AS BIGINT) END),
      lambda r, x: CASE WHEN x < 0 THEN r ELSE xor(r >> 8, ({crc}::BIGINT[])[(xor(r, x) & 255) + 1]) END, CAST(4294967295 AS BIGINT)) AS r
  FROM documents),
levels AS (
  SELECT doc_id, size, xor(r, CAST(4294967295 AS BIGINT)) AS text_crc32, n,
    {level('lang')} AS a, {level('source')} AS b, least(length(bin(size)) - 1, {(1 << BITS) - 1}) AS c,
    CASE WHEN doc_id IS NULL THEN 0 ELSE 1 + CAST(floor((CAST(doc_id AS DOUBLE) - lo_id) / greatest(CAST(hi_id AS DOUBLE) - lo_id, 1) * {LEVELS}) AS INT) END AS d
  FROM sized, skips),
walked AS (
  SELECT *, list_reduce([{', '.join(map(str, range(BITS - 1, -1, -1)))}],
    lambda acc, i: ((acc >> {STATE_BITS}) << {DIMS + STATE_BITS}) + ({steps}::BIGINT[])[((acc & {mask}) << {DIMS}) + {corner} + 1], CAST(0 AS BIGINT)) >> {STATE_BITS} AS curve
  FROM levels),
placed AS (
  SELECT *, row_number() OVER (ORDER BY curve, doc_id NULLS FIRST, text_crc32, size) - 1 AS pos FROM walked),
cut AS (SELECT *, CAST(({N_SHARDS} * (pos + 1) - 1) // n AS INT) AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard, pos - (CAST(shard AS BIGINT) * n) // {N_SHARDS} AS slot,
       CAST(NULL AS INT) AS grown_shard, curve
FROM cut"""
