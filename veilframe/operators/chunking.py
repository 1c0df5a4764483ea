"""Chunks of long texts, packed up to a target size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pack(parts: Column, target: int, glue: str) -> Column:
    """Parts joined greedily; a chunk closes when the next part would pass the target."""
    n = len(glue)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("open"), F.lit(0).alias("size"))

    def add(acc: Column, part: Column) -> Column:
        size = F.length(part) + n
        full = (acc["size"] + size > target) & (F.size(acc["open"]) > 0)
        return F.struct(
            F.when(full, F.array_append(acc["done"], F.array_join(acc["open"], glue))).otherwise(acc["done"]).alias("done"),
            F.when(full, F.array(part)).otherwise(F.array_append(acc["open"], part)).alias("open"),
            F.when(full, size).otherwise(acc["size"] + size).alias("size"),
        )

    return F.aggregate(parts, start, add, lambda acc: F.when(F.size(acc["open"]) > 0, F.array_append(acc["done"], F.array_join(acc["open"], glue))).otherwise(acc["done"]))


def by_paragraphs(text: Column, target: int) -> Column:
    """Paragraphs (blank line between) packed; a longer paragraph stays whole."""
    return pack(F.split(text, "\n\n"), target, "\n\n")


def by_sentences(text: Column, target: int) -> Column:
    """Sentences end at . ! or ?; packed with a space between."""
    sentences = F.transform(F.regexp_extract_all(text, F.lit(r"(?s)(?:[.!?][^.!?]*|[^.!?]+)[.!?]|[.!?]?[^.!?]+\z|[.!?]\z"), F.lit(0)), lambda s: F.btrim(F.regexp_replace(s, r"(?U)^\s+|\s+$", "")))
    out = pack(sentences, target, " ")
    return F.when(F.size(out) > 0, out).otherwise(F.array(text))


def overlapped(chunks: Column, overlap: int) -> Column:
    """Each chunk but the first begins with the end of the one before it."""
    if overlap <= 0:
        return chunks
    return F.transform(chunks, lambda c, i: F.when(i > 0, F.concat(F.right(F.get(chunks, i - 1), F.lit(overlap)), c)).otherwise(c))


def chunked(requests: DataFrame, target: int = 8000, overlap: int = 200, enabled: bool = True, sentences: bool = False) -> DataFrame:
    """request_id, chunk_idx, n_chunks, chunk; texts up to the target are one chunk."""
    split = (by_sentences if sentences else by_paragraphs)(F.col("text"), target)
    parts = F.when(F.lit(enabled) & (F.length("text") > target), split).otherwise(F.array("text"))
    df = requests.where(F.col("text").isNotNull()).select("request_id", parts.alias("parts"))
    df = df.select("request_id", F.size("parts").alias("n_chunks"), F.posexplode(overlapped(F.col("parts"), overlap)).alias("chunk_idx", "chunk"))
    return df.select("request_id", "chunk_idx", "n_chunks", "chunk")
