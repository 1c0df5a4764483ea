"""Byte-level BPE by a monoid tree reduction.

The encoding of a byte string is the reduction of its halves' encodings: to join two,
a window at the boundary is decoded and encoded again, and grows until both seams hold.
A seam between two tokens holds if the two, encoded together, stay the two tokens. The
result is then exact: the first merge that crossed a seam in an encoding of the whole
would cross it in an encoding of the two tokens beside it as well, since until then the
merges on either side are the same. A window that has grown to everything is exact anyway.
Decoding concatenates up the tree of ids.

Every pattern match is encoded by itself; a match that is a token as a whole is that token.
A bounded cache holds the matches' encodings, so the work per match is one look-up. Long
texts are handled a block of matches at a time; memory does not grow with a text beyond
the text itself.

Defined results: null and empty texts have no ids (checksums of the empty string);
lone surrogates cannot occur in Spark strings; repeated rows give equal results; an
empty table gives no rows; other columns are not read by the query and kept by ``encode``.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import fresh, in_arrow, table

CACHE = 120_000
MATCHES = 250_000
#: A longer match is encoded anew each time, so the cache's memory is bounded.
CACHED_BYTES = 64
LEAF = 2
#: Halves up to this length are kept as well; words share their beginnings and ends.
SHORT = 8
BLOCK = 65_536
ROWS = 256


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class TreeEncoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.seams: dict[tuple[bytes, bytes], list[bytes]] = {}
        self.same: list[bytes] = []  # stands for a pair that stays as it is
        self.cache: dict[str, bytes] = {}
        self.short: dict[bytes, list[bytes]] = {}
        self.packed = {token: struct.pack("<I", rank) for token, rank in ranks.items()}

    def merged(self, parts: list[bytes]) -> list[bytes]:
        """The lowest-ranked neighbours merged, leftmost first, until none is left."""
        rank, none = self.ranks.get, 1 << 31
        costs = [rank(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while costs and (best := min(costs)) < none:
            at = costs.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del costs[at]
            if at:
                costs[at - 1] = rank(parts[at - 1] + parts[at], none)
            if at < len(costs):
                costs[at] = rank(parts[at] + parts[at + 1], none)
        return parts

    def pair(self, a: bytes, b: bytes) -> list[bytes]:
        """Encoding of two tokens put together; not to be changed by the caller."""
        got = self.seams.get((a, b))
        if got is None:
            if len(self.seams) >= CACHE:
                self.seams.clear()
            whole = a + b
            got = self.merged([whole[i : i + 1] for i in range(len(whole))])
            self.seams[a, b] = got = self.same if got == [a, b] else got
        return got

    def holds(self, a: bytes, b: bytes) -> bool:
        """Whether a and b, encoded together, stay the tokens a and b."""
        return self.pair(a, b) is self.same

    def join(self, left: list[bytes], right: list[bytes]) -> list[bytes]:
        """Encoding of two encoded strings put together."""
        if not left or not right or self.holds(left[-1], right[0]):
            return left + right
        width = 1
        while True:
            if width == 1:
                new = self.pair(left[-1], right[0])
            else:
                window = b"".join(left[-width:] + right[:width])
                new = self.merged([window[i : i + 1] for i in range(len(window))])
            before, after = left[:-width], right[width:]
            if (not before or self.holds(before[-1], new[0])) and (not after or self.holds(new[-1], after[0])):
                return before + new + after
            width *= 2

    def reduced(self, piece: bytes) -> list[bytes]:
        if (got := self.short.get(piece)) is not None:
            return got
        if len(piece) <= LEAF:
            got = self.merged([piece[i : i + 1] for i in range(len(piece))])
        else:
            half = len(piece) // 2
            got = self.join(self.reduced(piece[:half]), self.reduced(piece[half:]))
        if len(piece) <= SHORT:
            if len(self.short) >= CACHE:
                self.short.clear()
            self.short[piece] = got
        return got

    def piece(self, match: str) -> bytes:
        """Ids of one match as little-endian 32-bit integers."""
        data = match.encode()
        parts = [data] if data in self.ranks else self.reduced(data)
        out = b"".join(map(self.packed.__getitem__, parts))
        if len(data) <= CACHED_BYTES:
            if len(self.cache) >= MATCHES:
                self.cache.clear()
            self.cache[match] = out
        return out

    def blocks(self, text: str) -> Iterator[bytes]:
        """Ids of a whole text, a block of matches at a time."""
        matches = (m.group() for m in self.pattern.finditer(text)) if len(text) > BLOCK else iter(self.pattern.findall(text))
        get, miss = self.cache.get, self.piece
        while block := list(islice(matches, BLOCK)):
            yield b"".join([get(m) or miss(m) for m in block])

    def decode(self, ids: bytes) -> bytes:
        """Bytes of the ids: the tree of concatenations, whose leaves are one block each."""
        n = len(ids) // 4
        if n > BLOCK:
            half = n // 2 * 4
            return self.decode(ids[:half]) + self.decode(ids[half:])
        return b"".join(map(self.tokens.__getitem__, memoryview(ids).cast("I")))


def _column(values: tuple, kind: pa.DataType) -> pa.Array:
    """Arrow column; a list of ids comes as its bytes, never as Python numbers."""
    if not pa.types.is_list(kind):
        return pa.array(values, type=kind)
    offsets = np.zeros(len(values) + 1, dtype=np.int32)
    np.cumsum([len(v) // 4 for v in values], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(values), dtype="<i4"))).cast(kind)


def _batched(docs: DataFrame, ranks: dict[bytes, int], pattern: str, schema: str, row) -> DataFrame:
    """docs.text through row(encoder, text) -> tuple; other selected columns first."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # the vocabulary, of fixed size
    out = docs.select([c for c in docs.columns]).schema.fields
    text = next(i for i, f in enumerate(out) if f.name == "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TreeEncoder(shared.value, pattern)  # a task's own: an idle worker holds no caches
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):  # the ids of a few texts at a time
                batch = whole.slice(at, ROWS)
                made = zip(*[row(encoder, t.as_py() or "") for t in batch.column(text)], strict=True)
                yield pa.RecordBatch.from_arrays([*batch.columns, *map(_column, made, kinds)], names=[*batch.schema.names, *names])

    extra = StructType.fromDDL(schema)
    kinds, names = [f.type for f in to_arrow_schema(extra)], extra.names
    return in_arrow(docs, run, StructType([*docs.schema.fields, *extra.fields]))


def _digest(encoder: TreeEncoder, text: str) -> tuple:
    n, ids_sum, text_sum = 0, hashlib.sha256(), hashlib.sha256()
    for ids in encoder.blocks(text):
        n += len(ids) // 4
        ids_sum.update(ids)
        text_sum.update(encoder.decode(ids))
    return n, ids_sum.hexdigest(), text_sum.hexdigest()


def _ids(encoder: TreeEncoder, text: str) -> tuple:
    return (b"".join(encoder.blocks(text)),)


def encode(docs: DataFrame, path: str, pattern: str, name: str = "ids") -> DataFrame:
    """docs with the ids of text as an array column (renamed if docs has the name)."""
    return _batched(docs, read_ranks(path), pattern, f"{fresh(docs, name)[0]} array<int>", _ids)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and the checksums of the ids and of the bytes decoded from them."""
    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _batched(docs.select("doc_id", "text"), read_ranks(path), pattern, schema, _digest).drop("text")


def _whole(encoder: TreeEncoder, text: str) -> tuple:
    ids = b"".join(encoder.blocks(text))
    return len(ids) // 4, ids, hashlib.sha256(encoder.decode(ids)).hexdigest()


def tokenised(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs without text, with the number of ids, the ids, the checksum of their bytes (renamed if taken)."""
    n, ids, decoded = fresh(docs, "n_tokens", "ids", "decoded_sha256")
    return _batched(docs, read_ranks(path), pattern, f"{n} long, {ids} array<int>, {decoded} string", _whole).drop("text")


def vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), *vocabulary())
