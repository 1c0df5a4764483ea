"""Occurrences of entities in texts, overlap resolution, placeholders."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.text import OUTER_PUNCTUATION, Canon, View, canon_text, is_ascii
from ..schemas import SPAN


def with_candidates(requests: DataFrame, policy: Canon = Canon(), mentions: str = "mentions") -> DataFrame:
    """requests with every occurrence of their mentions; ordinal is a mention's place.

    Only the texts of rows with mentions go to Python, and no other column does.
    """
    shape = f"array<struct<{', '.join(f.replace(' ', ': ', 1) for f in SPAN.split(', '))}>>"
    kind = to_arrow_schema(StructType.fromDDL(f"c {shape}")).field("c").type

    def found_in(text: str, found: list[dict]) -> list[dict]:
        view = View(text, policy)
        return [{"entity_id": m["entity_id"], "text": text[a:b], "start": a, "end": b, "ordinal": i, "canon": canon_text(text[a:b], policy)} for i, m in enumerate(found) if m is not None for a, b in view.find(m["text"])]

    @F.arrow_udf(shape)
    def occurrences(texts: pa.Array, founds: pa.Array) -> pa.Array:
        return pa.array([found_in(t, f) if t and f else [] for t, f in zip(texts.to_pylist(), founds.to_pylist(), strict=True)], type=kind)

    some = F.col(mentions).isNotNull() & (F.size(mentions) > 0)
    return requests.withColumn("candidates", F.when(some, occurrences(F.when(some, F.col("text")), F.col(mentions))).otherwise(F.array().cast(shape)))


def possible(mentions: Column, text: Column) -> Column:
    """Null in place of each of mentions (with field text) that a text cannot hold; places stay.

    Says so only where both are ASCII and the mention has no white space, in the JVM.
    """
    low = F.lower(text)
    sure = lambda m: is_ascii(m["text"]) & ~m["text"].rlike("[\\s\\x1c-\\x1f]") & ~F.contains(low, F.lower(F.btrim(m["text"], F.lit(OUTER_PUNCTUATION))))
    kept = F.transform(mentions, lambda m: F.when(~(is_ascii(text) & sure(m)), m))
    return F.when(F.exists(kept, lambda m: m.isNotNull()), kept)


def resolved(candidates: Column, priority: Column | None = None) -> Column:
    """Disjoint spans: longest first, then leftmost, then priority, then ordinal.

    Spans that touch are both kept. priority: map of entity id to a number.
    """
    rank = lambda x: F.coalesce(F.try_element_at(priority, x["entity_id"]), F.lit(0)) if priority is not None else F.lit(0)
    keyed = F.array_sort(F.transform(candidates, lambda x: F.struct((x["start"] - x["end"]).alias("a"), x["start"].alias("b"), (-rank(x)).alias("c"), x["ordinal"].alias("d"), x.alias("x"))))
    none = F.filter(candidates, lambda x: F.lit(False))
    kept = F.aggregate(keyed, none, lambda acc, k: F.when(F.exists(acc, lambda u: (k["x"]["end"] > u["start"]) & (k["x"]["start"] < u["end"])), acc).otherwise(F.array_append(acc, k["x"])))
    return F.transform(F.array_sort(F.transform(kept, lambda x: F.struct(x["start"].alias("s"), x.alias("x")))), lambda y: y["x"])


def spliced(text: Column, spans: Column, value) -> Column:
    """text with value(span) in place of each span; spans in order."""
    pieces = F.transform(
        spans,
        lambda s, i: F.concat(
            F.substring(text, F.coalesce(F.get(spans, i - 1)["end"], F.lit(0)) + 1, s["start"] - F.coalesce(F.get(spans, i - 1)["end"], F.lit(0))), value(s)
        ),
    )
    tail = F.substring(text, F.coalesce(F.try_element_at(spans, F.lit(-1))["end"], F.lit(0)) + 1, F.length(text))
    return F.concat(F.array_join(pieces, ""), tail)
