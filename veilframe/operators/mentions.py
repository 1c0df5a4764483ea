"""Mentions of entities: union, first-wins deduplication, noise filter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.rules import noise
from ..functions.text import Canon, canon


def merged(*sources: DataFrame) -> DataFrame:
    """All mentions; their order is (src_rank, chunk_idx, ordinal)."""
    out = sources[0]
    for df in sources[1:]:
        out = out.unionByName(df)
    return out


def deduplicated(mentions: DataFrame, policy: Canon = Canon(), ascii_only: bool = False) -> DataFrame:
    """The first mention of each (request, entity, canonical form), with canon and rank.

    Mentions without a canonical form could never be found and are dropped.
    """
    keyed = mentions.withColumn("canon", canon(F.col("text"), policy, ascii_only)).where(F.col("canon") != "")
    first = Window.partitionBy("request_id", "entity_id", "canon").orderBy("src_rank", "chunk_idx", "ordinal")
    return keyed.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")


def filtered(mentions: DataFrame) -> DataFrame:
    return mentions.where(~noise(F.col("entity_id"), F.col("text")))


def per_request(mentions: DataFrame) -> DataFrame:
    """request_id and its mentions in order, as an array of (ordinal, entity_id, text)."""
    order = F.struct("src_rank", "chunk_idx", "ordinal", "entity_id", "text")
    listed = mentions.groupBy("request_id").agg(F.array_sort(F.collect_list(order)).alias("m"))
    return listed.select("request_id", F.transform("m", lambda x, i: F.struct(i.alias("ordinal"), x["entity_id"].alias("entity_id"), x["text"].alias("text"))).alias("mentions"))
