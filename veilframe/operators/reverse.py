"""From anonymised texts back to the originals."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def deanonymized(text: Column, token_to_original: Column, fake_to_token: Column | None = None) -> Column:
    """Every token, then every fake, replaced in the order of the maps (compatible mode)."""
    out = F.aggregate(F.map_entries(token_to_original), text, lambda acc, e: F.replace(acc, e["key"], e["value"]))
    if fake_to_token is None:
        return out
    known = F.coalesce(F.filter(F.map_entries(fake_to_token), lambda e: F.map_contains_key(token_to_original, e["value"])), F.array().cast("array<struct<key:string,value:string>>"))
    return F.aggregate(known, out, lambda acc, e: F.replace(acc, e["key"], F.element_at(token_to_original, e["value"])))


@F.pandas_udf(StringType())
def deanonymized_safe(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """(text, token_to_original, fake_to_token): one pass, longest first, nothing twice."""
    for texts, originals, fakes in parts:
        out = []
        for text, original, fake in zip(texts, originals, fakes, strict=True):
            original, fake = dict(original or {}), dict(fake or {})
            table = original | {f: original[t] for f, t in fake.items() if t in original}
            keys = sorted((k for k in table if k), key=len, reverse=True)
            out.append(text if text is None or not keys else re.sub("|".join(map(re.escape, keys)), lambda m, t=table: t[m.group()], text))
        yield pd.Series(out, dtype=object)


def unspliced(text: Column, spans: Column) -> Column:
    """The lossless way back: each token of the span table replaced by its own surface."""
    step = lambda acc, s: F.struct(
        F.concat(acc["done"], F.substring(acc["rest"], F.lit(1), F.instr(acc["rest"], s["token"]) - 1), s["text"]).alias("done"),
        F.substring(acc["rest"], F.instr(acc["rest"], s["token"]) + F.length(s["token"]), F.length(acc["rest"])).alias("rest"),
    )
    return F.aggregate(spans, F.struct(F.lit("").alias("done"), text.alias("rest")), step, lambda acc: F.concat(acc["done"], acc["rest"]))
