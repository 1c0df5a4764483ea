"""SimHash near-duplicates, joined by Golay-code fuzzy hashing.

The 64 bits of a fingerprint are cut into segments of 22, 21 and 21 bits, each a word of
the perfect (23, 12) Golay code with the missing bits zero. K(x), the codewords to which
x and its one-bit neighbours decode (up to six), meets K(y) whenever x and y differ in two
bits or fewer; the codeword of x alone lies in K(y) if they differ in one.

Four errors over three segments leave these cases:
- a segment without error, and one of the others with two errors at most: the key is the
  segment itself and a codeword of K of another (33 or 34 bits);
- no segment without error, then two segments with exactly one and a third with two at
  most: the key is a codeword of each (36 bits). Of the first two, each side gives its own
  codeword in one and all of K in the other, in both ways, so x's own meets y's K and y's
  own x's K; of the third both give all of K.
So no link is missed, and every candidate is verified on the fingerprints. A fingerprint
has some 185 keys; keys are wide enough that chance meetings stay few: at 10^10
fingerprints about one other in a bucket.

The pipeline's near-duplicates are sets of shingles with a similarity of 0.8, at which 64 bits
differ in ten on average. There fingerprints are longer, and the neighbours of a segment are
chosen by the margins of its bits (``Soft``); candidates are verified on the sets.

Equal fingerprints are one row before keys are made, so copies never meet each other. In
a bucket all are compared to the least fingerprint, then to the least of those not linked
to it, and then every two that are still in different components to each other; a bucket
of near copies thus gives as many rows as it has members, not their pairs. Results go back
to the documents by a join on the fingerprint, whose hot keys Spark may split.

Defined results: null or empty texts have fingerprint zero and are linked like any other;
a null id never is the least unless all of a component are null; repeated rows get equal
results; an empty table gives no rows; other columns pass through ``dedup`` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpoint, fresh, in_arrow, table
from .common import held as held_on_disk
from .components import components, starred

SHINGLE, SEED, MAX_BITS = 4, 42, 4
#: Near-duplicates elsewhere: five words, a similarity of 0.8 or more.
STAGE_SHINGLE, STAGE_SIMILARITY = 5, 0.8
#: Of the long fingerprints of a set: words, keys a word and bits tried a segment. At a similarity
#: of 0.8 two sets of 50 shingles or more share no key in 1 of 20,000 pairs (see the README).
FINGERPRINTS, LIST, PROBES = 20, 16, 6
#: More than any sum of margins.
FAR = 1 << 40
#: Fingerprints whose keys one task makes.
FPS_A_TASK = 100_000
#: Of so many buckets one is used to find hubs.
HUB_BUCKETS = 16
#: Keys of rows, 8 or 16 bytes each, that may be broadcast.
BROADCAST_ROWS = 1_000_000
#: Bytes of shingle sets that one task holds on disk.
SET_BYTES = 1 << 25
BLOCK = 1 << 15
SEGMENTS = ((42, 22), (21, 21), (0, 21))
#: Of the Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0xC75


def hashes(text: str | None, shingle: int) -> Iterator[bytes]:
    """Hashes of all shingles of a text in order, 8 bytes each, in blocks."""
    import xxhash

    ws = (text or "").encode().lower().split()  # bytes: ASCII letters and white space only
    if not ws:
        return
    whole = b" ".join(ws)
    sizes = np.fromiter(map(len, ws), dtype=np.int64, count=len(ws)) + 1
    stop = np.cumsum(sizes)
    start = (stop - sizes).tolist()
    ends = (stop - 1).tolist()[min(shingle, len(ws)) - 1 :]
    digest = xxhash.xxh64_digest
    for at in range(0, len(ends), BLOCK):
        yield b"".join([digest(whole[a:b], SEED) for a, b in zip(start[at : at + BLOCK], ends[at : at + BLOCK], strict=False)])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bits set in over half of the shingles' hashes."""
    counts, n = np.zeros(64, dtype=np.int64), 0
    for block in hashes(text, shingle):
        bits = np.unpackbits(np.frombuffer(block, dtype=np.uint8).reshape(-1, 8), axis=1)
        counts, n = counts + bits.sum(axis=0, dtype=np.int64), n + len(bits)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Columns of docs but text, and the fingerprint as a signed long fp."""
    at = docs.columns.index("text")
    keep, places = [c for c in docs.columns if c != "text"], [i for i, c in enumerate(docs.columns) if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(x.as_py(), shingle) for x in batch.column(at)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in places), pa.array(made)], names=[*keep, "fp"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "text")
    return in_arrow(docs, run, ", ".join([kinds, "fp long"]))


class Golay:
    """Decoding of 23-bit words to the 12-bit index of the codeword within three bits."""

    def __init__(self) -> None:
        def rest(x: np.ndarray) -> np.ndarray:
            for bit in range(22, 10, -1):
                x = np.where(x >> bit & 1, x ^ (GENERATOR << (bit - 11)), x)
            return x

        self.low, self.high = rest(np.arange(1 << 12)), rest(np.arange(1 << 11) << 12)
        self.error = np.zeros(1 << 11, dtype=np.int64)
        for n in range(4):
            for bits in combinations(range(23), n):
                e = sum(1 << b for b in bits)
                self.error[self.low[e & 4095] ^ self.high[e >> 12]] = e

    def decode(self, x: np.ndarray) -> np.ndarray:
        return (x ^ self.error[self.low[x & 4095] ^ self.high[x >> 12]]) >> 11

    def around(self, x: np.ndarray, bits: int) -> np.ndarray:
        """Codewords of x and its neighbours, a row each, repeats as -1."""
        found = np.sort(self.decode(np.concatenate([x[:, None], x[:, None] ^ (1 << np.arange(bits))], axis=1)), axis=1)
        found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
        return found


def products(*lists: tuple[np.ndarray, np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and packed codewords (12 bits each) of all combinations inside each row.

    A list holds (row, codeword) pairs, sorted by row.
    """
    rows, words = lists[0]
    for r, w in lists[1:]:
        size = np.bincount(r, minlength=n)
        first, times = np.cumsum(size) - size, size[rows]
        more = np.repeat(rows, times)
        nth = np.arange(len(more)) - np.repeat(np.cumsum(times) - times, times)
        words, rows = np.repeat(words, times) << 12 | w[first[more] + nth], more
    return rows, words


def keys(fps: np.ndarray, code: Golay) -> tuple[np.ndarray, np.ndarray]:
    """Bucket keys, and the row of fps that each is of; a row has no key twice."""
    x = fps.view(np.uint64)
    part = [((x >> np.uint64(s)) & np.uint64((1 << n) - 1)).astype(np.int64) for s, n in SEGMENTS]
    every = np.arange(len(x))
    own = [(every, code.decode(p)) for p in part]
    near, rest = [], []  # K as (row, codeword), and K without the own codeword
    for p, (_, n), (_, mine) in zip(part, SEGMENTS, own, strict=True):
        k = code.around(p, n)
        r, c = np.nonzero(k >= 0)
        near.append((r, k[r, c]))
        other = k[r, c] != mine[r]
        rest.append((r[other], k[r, c][other]))
    out, rows = [], []
    for a in range(3):
        for b in range(3):
            if a != b:
                r, w = near[b]
                out.append(np.int64(3 * a + b) << 36 | part[a][r] << 12 | w)
                rows.append(r)
    for a, b, c in ((0, 1, 2), (0, 2, 1), (1, 2, 0)):
        for first, second in ((own[a], near[b]), (rest[a], own[b])):
            r, w = products(first, second, near[c], n=len(x))
            out.append(np.int64(9 + c) << 36 | w)
            rows.append(r)
    return np.concatenate(out), np.concatenate(rows)


def keyed(nodes: DataFrame) -> DataFrame:
    """(key, fp) of each node."""
    at = nodes.columns.index("fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Golay()
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                fps = np.ascontiguousarray(batch.slice(i, 1024).column(at).to_numpy(zero_copy_only=False))
                k, r = keys(fps, code)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(fps[r])], names=["key", "fp"])

    return in_arrow(nodes, run, "key long, fp long")


def linked(nodes: DataFrame, limit: int = MAX_BITS) -> DataFrame:
    """(node, root) of the components of distinct fps, for those with a link: at most limit bits differ."""
    bucket = Window.partitionBy("key")
    close = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= limit
    rows = keyed(nodes).withColumns({"n": F.count(F.lit(1)).over(bucket), "held": F.min("fp").over(bucket)})
    rows = rows.where("n > 1").withColumn("tied", close("fp", "held"))  # a bucket with one member holds no candidates
    rows = rows.withColumn("open", F.sum((~F.col("tied")).cast("long")).over(bucket))
    # Of the rest of a bucket, pairs are due only if there are two, one not yet tied.
    rows = held_on_disk(rows.where("fp <> held and (tied or (open > 0 and n > 2))").selectExpr("key", "fp", "held", "tied", "open > 0 and n > 2 as due"))
    links = rows.where("tied").select(F.col("fp").alias("u"), F.col("held").alias("v"))
    rest = rows.where("due").withColumn("held", F.min(F.when(~F.col("tied"), F.col("fp"))).over(bucket)).where("held is not null")
    rest = held_on_disk(rest.where("fp <> held").withColumn("near", close("fp", "held")).select("key", "fp", "held", "near"))
    links = links.union(rest.where("near").select("fp", "held"))
    found = checkpoint(components(starred(links)))  # a node has few links of its own, one a key
    last = rest.join(found, F.col("fp") == F.col("node"), "left").select("key", "fp", F.coalesce("root", "fp").alias("root"))
    # Both least ones have met all; the others meet wherever their components differ.
    last = last.withColumns({"low": F.min("root").over(bucket), "high": F.max("root").over(bucket)})
    last = held_on_disk(last.where("low < high").select("key", "fp", "root"))
    a, b = last.toDF("key", "u", "ru"), last.toDF("key", "v", "rv")
    more = checkpoint(a.join(b, "key").where((F.col("ru") < F.col("rv")) & close("u", "v")).select(F.col("ru").alias("u"), F.col("rv").alias("v")).distinct())
    for df in (last, rest, rows):
        df.unpersist()
    if more.isEmpty():
        return found
    # Roots that the last links join; the rest keep theirs.
    joined = components(more).select(F.col("node").alias("root"), F.col("root").alias("over"))
    alone = more.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(found, "node", "left_anti").select("node", F.col("node").alias("root"))
    whole = found.union(alone).join(joined, "root", "left")
    return whole.select("node", F.coalesce("over", "root").alias("root"))


def grouped(rows: DataFrame) -> DataFrame:
    """fp and component_id (least doc_id) for each distinct fp of rows (doc_id, fp)."""
    fps = checkpoint(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    # Each gives some 185 keys, so a task gets few of them; the number of tasks follows theirs.
    parts = max(fps.sparkSession.sparkContext.defaultParallelism, fps.count() // FPS_A_TASK)
    found = linked(fps.select("fp").repartition(parts))
    rooted = fps.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(ids, "root").select("fp", "component_id")


def op8_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = checkpoint(fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text")))
    out = rows.join(grouped(rows), "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(text: str | None, shingle: int) -> tuple[int, np.ndarray]:
    """Hash of a text's set of shingles, and their hashes, sorted."""
    import xxhash

    found = np.unique(np.frombuffer(b"".join(hashes(text, shingle)), dtype=np.uint64))
    return xxhash.xxh64_intdigest(found.tobytes(), SEED), found


def sized(docs: DataFrame, shingle: int) -> DataFrame:
    """Columns of docs but text; node, a hash of the text's set of shingles; n, their number (as
    32-bit hashes)."""
    at = docs.columns.index("text")
    keep, places = [c for c in docs.columns if c != "text"], [i for i, c in enumerate(docs.columns) if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = (shingle_set(x.as_py(), shingle) for x in batch.column(at))
            node, n = zip(*((node, len(np.unique(h.astype(np.uint32)))) for node, h in found), strict=True) if batch.num_rows else ((), ())
            made = [pa.array(np.array(node, dtype=np.uint64).view(np.int64)), pa.array(n, type=pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in places), *made], names=[*keep, "node", "n"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "text")
    return in_arrow(docs, run, f"{kinds}, node long, n long")


class Soft:
    """Bucket keys of sets by Golay codewords near their long SimHash fingerprints.

    A fingerprint has FINGERPRINTS words of three segments of 23 bits. A bit's margin is how many
    shingles' hashes set it, less those that don't; its sign is the bit, and bits of small
    margins are those in which similar sets differ. So the neighbours of a segment are those
    with its PROBES least margins turned in all ways (Chase's rule) rather than each single
    bit; they decode to codewords, and a word's keys are the LIST triples of codewords whose
    bits turn the least margins in sum.
    """

    def __init__(self) -> None:
        self.code = Golay()
        rng = np.random.default_rng(SEED)
        self.words = -(-FINGERPRINTS * 69 // 64)
        self.flip, self.times = (rng.integers(0, 1 << 64, self.words, dtype=np.uint64) | np.uint64(1) for _ in range(2))
        bits = self.code.error[:, None] >> np.arange(23) & 1
        self.places = np.sort(np.where(bits, np.arange(23), 23), axis=1)[:, :3]  # of an error's bits; 23 for none
        self.pairs = np.array([(i, j) for i in range(LIST) for j in range(LIST) if (i + 1) * (j + 1) <= LIST]).T

    def margins(self, found: np.ndarray) -> np.ndarray:
        """A row of 23 for each segment."""
        ones = np.zeros(self.words * 64, dtype=np.int64)
        for i in range(0, len(found), 255):  # sums of bytes
            h = (found[i : i + 255, None] ^ self.flip) * self.times
            h = (h ^ h >> np.uint64(32)) * np.uint64(0x9FB21C651E98DF25)
            h ^= h >> np.uint64(32)
            ones += np.add.reduce(np.unpackbits(h.view(np.uint8), axis=1), axis=0, dtype=np.uint8)
        return (2 * ones - len(found))[: FINGERPRINTS * 69].reshape(-1, 23)

    def near(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """LIST codewords for each row of 23 margins, and the margins that they turn, least first."""
        a = np.abs(margins)
        x = (margins > 0) @ (1 << np.arange(23))
        turned, cost = np.zeros((len(a), 1), dtype=np.int64), np.zeros((len(a), 1), dtype=np.int64)
        for bit in np.argsort(a, axis=1, kind="stable")[:, :PROBES].T:
            turned = np.concatenate([turned, turned | 1 << bit[:, None]], axis=1)
            cost = np.concatenate([cost, cost + np.take_along_axis(a, bit[:, None], axis=1)], axis=1)
        y = x[:, None] ^ turned
        rest = self.code.low[y & 4095] ^ self.code.high[y >> 12]
        a = np.concatenate([a, np.zeros((len(a), 1), dtype=np.int64)], axis=1)
        for place in np.moveaxis(self.places[rest], 2, 0):
            more = np.take_along_axis(a, place, axis=1)
            cost += np.where(turned >> place & 1, -more, more)  # turned twice: as it was
        both = np.sort(cost << 12 | (y ^ self.code.error[rest]) >> 11, axis=1)
        both[:, 1:][both[:, 1:] == both[:, :-1]] = FAR << 12
        both = np.sort(both, axis=1)[:, :LIST]
        return both & 4095, both >> 12

    def keys(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Keys, and the number of the set that each is of; a set has no key twice."""
        words, cost = self.near(np.concatenate([self.margins(x) for x in sets]))
        words, cost = words.reshape(-1, 3, LIST), cost.reshape(-1, 3, LIST)
        out, total, (i, j) = words[:, 0], cost[:, 0], self.pairs
        for k in (1, 2):
            out, total = out[:, i] << 12 | words[:, k][:, j], total[:, i] + cost[:, k][:, j]
            first = np.argsort(total, axis=1, kind="stable")[:, :LIST]
            out, total = np.take_along_axis(out, first, axis=1), np.take_along_axis(total, first, axis=1)
        out |= (np.arange(len(out)) % FINGERPRINTS << 36)[:, None]
        row, at = np.nonzero(total < FAR)
        return out[row, at], row // FINGERPRINTS


def soft_keyed(texts: DataFrame, shingle: int) -> DataFrame:
    """(key, node) of each text's set of shingles; of equal sets a task gives one.

    Sets of up to three shingles have none: no other set has a similarity of 0.8 to them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        soft, seen = Soft(), set()
        for whole in batches:
            for i in range(0, whole.num_rows, 64):
                new = {}
                for x in whole.slice(i, 64).column(0):
                    node, found = shingle_set(x.as_py(), shingle)
                    if node not in seen and len(found) > 3:
                        new[node] = found
                seen.update(new)
                if new:
                    k, row = soft.keys(list(new.values()))
                    node = np.array(list(new), dtype=np.uint64).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(node[row])], names=["key", "node"])

    return in_arrow(texts.select("text"), run, "key long, node long")


def set_rows(texts: DataFrame, shingle: int) -> DataFrame:
    """node, and held, the 32-bit hashes of its shingles, sorted; of equal sets a task gives one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                rows = []
                for x in whole.slice(i, 256).column(0):
                    node, found = shingle_set(x.as_py(), shingle)
                    if node not in seen:
                        seen.add(node)
                        rows.append((node, np.unique(found.astype(np.uint32)).tobytes()))
                if rows:
                    node, held = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(node, dtype=np.uint64).view(np.int64)), pa.array(held, type=pa.binary())], names=["node", "held"])

    return in_arrow(texts.select("text"), run, "node long, held binary")


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of pairs (u, v) whose sets (node, held) have the Jaccard similarity or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(c.as_py(), dtype=np.uint32) for c in (a, b))
                both = len(np.intersect1d(x, y, assume_unique=True))
                take.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(take, type=pa.bool_()))

    both = pairs.join(sets.toDF("u", "x"), "u").join(sets.toDF("v", "y"), "v").select("u", "v", "x", "y")
    return in_arrow(both, run, "u long, v long")


def shingles(sets: DataFrame) -> DataFrame:
    """A row (node, h, n) for each shingle of sets (node, held); n is their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, held in zip(batch.column(0), batch.column(1), strict=True):
                found = np.frombuffer(held.as_py(), dtype=np.int32)
                same = (pa.array(np.full(len(found), x, dtype=np.int64)) for x in (node.as_py(), len(found)))
                yield pa.RecordBatch.from_arrays([next(same), pa.array(found), next(same)], names=["node", "h", "n"])

    return in_arrow(sets.select("node", "held"), run, "node long, h int, n long")


def due_pairs(nodes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (u, v) of nodes (node, root) with different roots that can still be a link.

    Each node's shingles are put in one order for all, the rarest first. Two sets of sizes
    n1 >= n2 need an overlap of s / (1 + s) (n1 + n2), so they share a shingle before so many
    are left of either; only such beginnings meet, by shingle and level of size, and what
    both still have after the shingle bounds the overlap. In a family of near copies the
    rarest shingles are each copy's own changes, so copies too far apart never meet. Where
    a shingle is common to a large component, its members are not held against each other.
    """
    s, level = similarity, lambda n: F.floor(F.log(n) / np.log(1.05)).cast("int")
    nodes = nodes.join(nodes.groupBy("root").agg(F.count(F.lit(1)).alias("weight")), "root")
    rows = shingles(sets.join(nodes.select("node"), "node", "left_semi"))
    rows = rows.join(rows.groupBy("h").agg(F.count(F.lit(1)).alias("c")), "h")
    rows = rows.withColumn("at", F.row_number().over(Window.partitionBy("node").orderBy("c", "h")) - 1).where("c > 1").withColumn("left", F.col("n") - F.col("at"))
    most = F.col("left") * ((1 + s) / s) - F.col("n") + 1e-6  # the size of a partner
    rows = rows.withColumn("most", F.least(F.col("n").cast("double"), most)).where(F.col("most") >= F.col("n") * s)
    rows = checkpoint(rows.join(nodes, "node").select("node", "h", "n", "root", "weight", "left", "most"))
    names = ["node", "n", "root", "left", "weight", "h", "level"]
    seeks = rows.withColumn("level", F.explode(F.sequence(level(F.col("n") * s - 1e-6), level(F.col("most"))))).select(*names)
    stays = rows.where(F.col("left") * (1 + s) >= F.col("n") * (2 * s) - 1e-6).withColumn("level", level(F.col("n"))).select(*names)
    largest = F.max(F.struct("weight", "root"))["root"].alias("main")
    groups = seeks.select("h", "level", "root", "weight").union(stays.select("h", "level", "root", "weight")).groupBy("h", "level")
    groups = groups.agg(F.min("root").alias("low"), F.max("root").alias("high"), largest).where("low < high").select("h", "level", "main")
    a = seeks.join(groups, ["h", "level"]).withColumn("own", F.col("root") == F.col("main")).drop("main", "weight").toDF("h", "level", "u", "n1", "ru", "left1", "own1")
    b = stays.join(groups, ["h", "level"]).withColumn("own", F.col("root") == F.col("main")).drop("main", "weight").toDF("h", "level", "v", "n2", "rv", "left2", "own2")
    smaller = (F.col("n2") < F.col("n1")) | ((F.col("n2") == F.col("n1")) & (F.col("v") < F.col("u")))
    fits = (F.col("ru") != F.col("rv")) & smaller & (F.least("left1", "left2") * (1 + s) >= (F.col("n1") + F.col("n2")) * s - 1e-6)
    at = ["h", "level"]
    return a.where("not own1").join(b, at).where(fits).select("u", "v").union(a.where("own1").join(b.where("not own2"), at).where(fits).select("u", "v"))


def alike(nodes: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(node, root) of the components of nodes (node, n, text_hash), for those with a link.

    texts: text and text_hash of the documents, from which keys are made, and the sets of those
    nodes that share a bucket. In one bucket of HUB_BUCKETS, all are compared to its hub, the
    member that shares such buckets with the most others (the middle of a family of near
    copies). In all buckets that then hold more than one component, all are compared to the head
    of one, the hub with the most links. Both give a row for each member, not for their pairs.
    Of what is still apart then, those pairs meet that could still be links (``due_pairs``): a
    copy too far from the head of its family can be near another only by changes that both have,
    or by its size. Hubs come from sums that are made before the shuffle and are joined back.
    Whether a bucket has several members or components is found by windows, so one bucket is
    one task.
    """
    fits = lambda a, b: F.least(a, b) >= similarity * F.greatest(a, b) - 1e-9
    bucket = Window.partitionBy("key")
    # Most keys are of one node, and go where they were dealt to; tasks may give a node twice.
    members = soft_keyed(texts, shingle).withColumns({"low": F.min("node").over(bucket), "high": F.max("node").over(bucket)})
    # Checkpoints, not caches: what follows starts from short plans, which the driver has to hold.
    members = checkpoint(members.where("low < high").select("key", "node").distinct())
    asked = checkpoint(nodes.select("node", "n", "text_hash").join(members.select("node").distinct(), "node"))
    n_sets, n_words = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if n_sets <= BROADCAST_ROWS:
        texts = texts.join(F.broadcast(asked.select("text_hash").distinct()), "text_hash", "left_semi")
    # Dealt once by node; the joins below find them in place.
    parts = max(nodes.sparkSession.sparkContext.defaultParallelism, n_words * 4 // SET_BYTES)
    sets = set_rows(texts, shingle).repartition(parts, "node").dropDuplicates(["node"])
    sets = held_on_disk(sets.join(asked.select("node"), "node", "left_semi"))
    some = members.where(F.pmod(F.xxhash64("key"), F.lit(HUB_BUCKETS)) == 0)
    central = some.join(some.groupBy("key").agg(F.count(F.lit(1)).alias("size")), "key").groupBy("node").agg(F.sum("size").alias("near"))
    some = checkpoint(some.join(asked.select("node", "n").join(central, "node"), "node"))
    hubs = some.groupBy("key").agg(F.min(F.struct((-F.col("near")).alias("rank"), "node", "n")).alias("hub"))
    now = some.join(hubs, "key").where((F.col("node") != F.col("hub.node")) & fits(F.col("n"), F.col("hub.n")))
    links = checkpoint(similar(now.select(F.col("node").alias("u"), F.col("hub.node").alias("v")).distinct(), sets, similarity))
    found = checkpoint(components(links))
    head = F.max(F.struct("size", "node", "n", "root")).alias("head")
    heads = links.groupBy(F.col("v").alias("node")).agg(F.count(F.lit(1)).alias("size")).join(found, "node").join(asked.select("node", "n"), "node").groupBy("root").agg(head)
    rooted = asked.select("node", "n").join(found, "node", "left").select("node", "n", F.coalesce("root", "node").alias("root")).join(heads, "root", "left")
    mixed = members.join(rooted, "node").withColumns({"low": F.min("root").over(bucket), "high": F.max("root").over(bucket), "head": F.max("head").over(bucket)})
    # Near copies share many buckets, mostly with the same head.
    now = checkpoint(mixed.where("low < high").select("node", "n", "root", "head").distinct())
    asks = now.where((F.col("root") != F.col("head.root")) & fits(F.col("n"), F.col("head.n"))).select(F.col("node").alias("u"), F.col("head.node").alias("v"))
    found = checkpoint(components(found.toDF("u", "v").union(similar(asks.distinct(), sets, similarity))))
    apart = now.select("node").distinct().join(found, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    more = checkpoint(similar(due_pairs(checkpoint(apart), sets, similarity).distinct(), sets, similarity))
    found = found if more.isEmpty() else checkpoint(components(found.toDF("u", "v").union(more)))
    sets.unpersist()
    return found


def dedup(docs: DataFrame, shingle: int = STAGE_SHINGLE, similarity: float = STAGE_SIMILARITY) -> DataFrame:
    """One row of docs for each group of near-duplicates: that with the least doc_id.

    Texts link if their sets of shingles have the Jaccard similarity or more: Golay keys of long
    SimHash fingerprints (Soft) find the candidates, and each is verified on the sets. Copies
    are one row before any join on their set. The keys (id, hash of text) of the rows that go are broadcast while
    they are BROADCAST_ROWS at most, and texts stay where they are; beyond that the texts are
    shuffled once, by key.
    """
    id_key, text_key = fresh(docs, "d_id", "d_text")
    at = [id_key, text_key]
    marked = docs.withColumns({id_key: F.coalesce("doc_id", F.lit(-(1 << 63))), text_key: F.xxhash64(F.coalesce("text", F.lit("")))})
    own = (F.col("doc_id").isNull().alias("lost"), F.col(id_key).alias("id"), F.col(text_key).alias("text_hash"))
    nodes = sized(marked.select(*own, "text"), shingle).groupBy("node")
    # Null ids stay only where a group has no others.
    nodes = checkpoint(nodes.agg(F.first("n").alias("n"), F.min(F.struct("lost", "id", "text_hash")).alias("s")))
    found = alike(nodes.select("node", "n", F.col("s.text_hash").alias("text_hash")), marked.select(own[2], "text"), shingle, similarity)
    rooted = nodes.select("node", "s").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    stays = rooted.groupBy("root").agg(F.min("s").alias("s")).select(F.col("s.id").alias(id_key), F.col("s.text_hash").alias(text_key)).distinct()
    found = marked.groupBy(*at).agg(F.count(F.lit(1)).alias("c")).join(stays.withColumn("stays", F.lit(True)), at, "left")
    # Rows that go, and those of which one of several equal ones stays.
    changed = checkpoint(found.where("stays is null or c > 1").select(*at, F.col("stays").isNotNull().alias("stays")))
    n, n_several = changed.agg(F.count(F.lit(1)), F.count_if("stays")).first()
    if n > BROADCAST_ROWS:
        return marked.join(stays, at, "left_semi").dropDuplicates(at).select(*docs.columns)
    out = marked.join(F.broadcast(changed.select(*at)), at, "left_anti")
    if n_several:
        out = out.union(marked.join(F.broadcast(changed.where("stays").select(*at)), at, "left_semi").dropDuplicates(at))
    return out.select(*docs.columns)
