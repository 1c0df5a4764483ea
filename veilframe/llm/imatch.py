"""I-Match fingerprints over randomised lexicon subsets (DataFrame functions only).

Terms are the words in lower case. The lexicon holds the terms whose document frequency
lies in a band (LOW to HIGH of all documents, all rows counted). It has at most
mean distinct terms / LOW entries however many documents there are, so it is a constant of
the plan; that bound is checked. A text is reduced to its distinct lexicon terms, sorted by
their 64-bit hashes (any fixed order serves). Each of 80 random lexicon subsets (terms kept
with probability 1/8, 1/64 or 1/512) hashes what it keeps of them; a subset that keeps
nothing has no hash. All subsets of one round come out of one sort by bucket. Likeness
of two fingerprints is the share of equal hashes among the subsets that have a hash on
either side, taken from the sparsest of the three scales that has MIN_SUBSETS such subsets.

The next document is found on narrow rows (id, hash of text, length): they are dealt into
ranges of ids, a hot id into several by the hash, and a range's first row is that which
follows the range above. Texts then meet by key in two joins over one and the same
exchange; only the part of the next text that is needed travels a second time.

Defined results: null text counts as empty; texts without lexicon terms have the empty
fingerprint, like each other by 1, like others by 0; null ids come last; equal ids follow
each other by a hash of their texts; repeated rows (id and text) are one document in that
order and get equal results; a single document is its own next; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from itertools import accumulate
from math import ceil, isqrt

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpoint, table, words

LOW, HIGH = 0.003, 0.2
MIN_SUBSETS = 6
#: Bits of a term's hash that pick its subset, rounds of them, subsets used a round.
SCALES = ((3, 2, 8), (6, 1, 32), (9, 1, 32))
#: Checked, never cut: the lexicon is a literal of the plan, 8 bytes a term.
MAX_LEXICON = 1_000_000
#: The driver holds a cut a range; rows of a range are narrow.
ROWS_PER_RANGE, MAX_RANGES = 100_000, 10_000
LAST_ID = -(1 << 63)


def _bound(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def lexicon(texts: DataFrame, n: int) -> list[int]:
    """Hashes of the terms of column text in the band of document frequency."""
    low, high = max(2, ceil(LOW * n)), int(HIGH * n)
    df = texts.select(F.explode(F.array_distinct(F.transform(words(F.lower("text")), lambda w: F.xxhash64(w)))).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    band = sorted(r.h for r in df.where(F.col("n").between(low, high)).select("h").limit(MAX_LEXICON + 1).collect())
    if len(band) > MAX_LEXICON:
        raise ValueError(f"over {MAX_LEXICON} terms in the band: raise LOW")
    return band


def with_terms(df: DataFrame, text: str, band: list[int]) -> DataFrame:
    """df with the sorted distinct hashes of the terms of a text that the lexicon holds."""
    if not band:
        return df.withColumn("terms", F.array().cast("array<long>"))
    listed = ", ".join(f"{h}L" if h > LAST_ID else f"bigint('{h}')" for h in band)  # one text, not a call a term
    df = df.withColumn("terms", F.transform(words(F.lower(text)), lambda w: F.xxhash64(w))).withColumn("terms", F.expr(f"filter(terms, h -> h in ({listed}))"))
    return df.withColumn("terms", F.sort_array(F.array_distinct("terms")))


def pieces(kept: Column) -> Column:
    """For each scale the hashes of its subsets, 16 bits below the subset's number, in order."""

    def hashed(shift: int, bits: int, used: int, first: int) -> Column:
        bucket = lambda h: F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << bits) - 1))
        own = F.filter(kept, lambda h: bucket(h) < used) if used < 1 << bits else kept
        # Bucket first, so that a subset's terms stand together.
        dealt = F.sort_array(F.transform(own, lambda h: F.shiftleft(bucket(h), 57).bitwiseOR(h.bitwiseAND(F.lit((1 << 57) - 1)))))

        def runs(ts: Column) -> Column:
            begins = F.filter(F.transform(ts, lambda t, i: F.when((i == 0) | (F.shiftright(t, 57) != F.shiftright(F.get(ts, i - 1), 57)), i)), lambda i: i.isNotNull())

            def each(starts: Column) -> Column:
                mine = lambda q, j: F.slice(ts, q + 1, F.coalesce(F.get(starts, j + 1), F.size(ts)) - q)
                return F.transform(
                    starts, lambda q, j: F.shiftleft(F.shiftright(F.get(ts, q), 57) + first, 16).bitwiseOR(F.xxhash64(mine(q, j)).bitwiseAND(F.lit(0xFFFF))).cast("int")
                )

            return _bound(begins, each)

        return _bound(dealt, runs)

    out, shift = [], 0
    for bits, rounds, used in SCALES:
        parts = [hashed(shift + r * bits, bits, used, r * used) for r in range(rounds)]
        out.append(F.concat(*parts))
        shift += rounds * bits
    return F.array(*out)


def printed(fp: Column) -> Column:
    hexed = lambda s: F.array_join(F.transform(s, lambda x: F.lower(F.lpad(F.hex(x), 6, "0"))), "")
    return F.array_join(F.transform(fp, hexed), "-")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes, 0 to 1."""
    out = F.lit(0.0)
    for i in range(len(SCALES)):
        x, y = F.get(a, F.lit(i)), F.get(b, F.lit(i))
        subsets = lambda s: F.transform(s, lambda v: F.shiftright(v, 16))
        used, same = F.size(F.array_union(subsets(x), subsets(y))), F.size(F.array_intersect(x, y))
        share = lambda n, same=same: same / F.greatest(n, F.lit(1)).cast("double")
        out = _bound(used, (lambda o, share, least: lambda n: F.when(n >= least, share(n)).otherwise(o))(out, share, MIN_SUBSETS if i else 0))
    return F.when(a == b, F.lit(1.0)).otherwise(out)


def ranges(doc_id: Column, tie: Column, cuts: list[int]) -> Column:
    """Number of the range of a key: ids between two cuts; an id that is m cuts has m ranges."""
    cuts = cuts or [LAST_ID]
    own = sorted(set(cuts))
    times = [cuts.count(c) for c in own] if len(own) < len(cuts) else [1] * len(own)
    before = [0, *accumulate(times)]
    wide = max(1, isqrt(len(own)))
    ints = lambda xs: F.lit(np.array(xs, dtype=np.int64))
    key = F.coalesce(doc_id, F.lit(LAST_ID))
    full = F.size(F.filter(ints(own[wide - 1 :: wide]), lambda c: c < key))
    at = full * wide + F.size(F.filter(F.slice(ints(own), full * wide + 1, F.lit(wide)), lambda c: c < key))

    def place(i: Column) -> Column:
        m = F.get(ints(times), i)
        nth = F.least(m - 1, F.floor((tie / F.lit(2.0**64) + 0.5) * m))
        return F.get(ints(before), i) + F.when(F.get(ints(own), i) == key, nth).otherwise(F.lit(0))

    return _bound(at, place)


def successors(keys: DataFrame, n: int) -> DataFrame:
    """keys (doc_id, tie; distinct, checkpointed) with next_id and next_tie by descending id."""
    count = min(MAX_RANGES, max(1, ceil(n / ROWS_PER_RANGE)))
    cuts = []
    if count > 1:
        key = F.coalesce("doc_id", F.lit(LAST_ID))
        cuts = sorted(keys.agg(F.percentile_approx(key, [i / count for i in range(1, count)], 20 * count)).first()[0] or [])
    own = F.struct("doc_id", "tie")
    dealt = keys.withColumn("range", ranges(F.col("doc_id"), F.col("tie"), cuts))
    # A row a range: the greatest key, which follows the least of the range above.
    tops = dealt.groupBy("range").agg(F.max(own).alias("top"))
    rising = Window.orderBy("range")
    whole = rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    below = tops.select("range", F.coalesce(F.lag("top").over(rising), F.last("top").over(whole)).alias("below"))
    inside = F.lag(own).over(Window.partitionBy("range").orderBy(F.asc_nulls_first("doc_id"), "tie"))
    out = dealt.withColumn("next", inside).join(F.broadcast(below), "range").withColumn("next", F.coalesce("next", "below"))
    return out.drop("range", "below").withColumns({"next_id": F.col("next.doc_id"), "next_tie": F.col("next.tie")}).drop("next")


def fingerprinted(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, the fingerprints of text and edited text, and both likenesses."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    tie = F.xxhash64("text")
    n = docs.select("doc_id").count()
    keys = texts.select("doc_id", tie.alias("tie"), F.length("text").alias("size"))
    keys = checkpoint(keys.groupBy("doc_id", "tie").agg(F.min("size").alias("size")))
    band = lexicon(texts.select("text"), n)
    # The key by which texts meet; a null id is a part of it.
    key = lambda doc_id, tie, *names: dict(zip(names, (F.coalesce(doc_id, F.lit(0)), F.isnull(doc_id), tie), strict=True))
    rows = texts.withColumns(key("doc_id", tie, "id", "lost", "tie"))
    rows = with_terms(rows, "text", band).select("id", "lost", "tie", "text", pieces(F.col("terms")).alias("fp"))
    due = successors(keys, n).withColumn("k", F.floor(F.col("size") / 3).cast("int"))
    due = due.select(*(c.alias(a) for side in (key("doc_id", F.col("tie"), "to_id", "to_lost", "to_tie"), key("next_id", F.col("next_tie"), "id", "lost", "tie")) for a, c in side.items()), "k")
    sent = rows.join(due, ["id", "lost", "tie"])
    sent = sent.select("to_id", "to_lost", "to_tie", "k", F.substring(F.col("text"), F.lit(1), F.col("k")).alias("head"), F.col("fp").alias("next_fp"))
    # A repeated document sends the same more than once.
    again = F.lag(F.lit(1)).over(Window.partitionBy("to_id", "to_lost", "to_tie").orderBy("k"))
    sent = sent.withColumn("again", again).where("again is null").drop("again").withColumnsRenamed({"to_id": "id", "to_lost": "lost", "to_tie": "tie"})
    rows = rows.join(sent, ["id", "lost", "tie"])
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - F.col("k")), F.col("head")))
    rows = with_terms(rows, "edited", band).withColumn("edited_fp", pieces(F.col("terms")))
    return rows.select(
        F.when(~F.col("lost"), F.col("id")).alias("doc_id"),
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        printed(F.col("fp")).alias("fingerprint"),
        printed(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and the fingerprint of text."""
    n = docs.select("doc_id").count()
    band = lexicon(docs.select(F.coalesce("text", F.lit("")).alias("text")), n)
    found = with_terms(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text", band)
    return found.select("doc_id", printed(pieces(F.col("terms"))).alias("fingerprint"))


def op9_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprinted(table(spark, sf_dir, "documents"))
