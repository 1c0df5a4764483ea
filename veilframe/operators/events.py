"""Playback events of a result, their wire format, and coverage figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVENT = "array<struct<event:string,data:string>>"


def pieces(text: Column) -> Column:
    """Words, each with the white space after it; leading white space is lost."""
    return F.regexp_extract_all(text, F.lit(r"(?U)\S+\s*"), F.lit(0))


def token_events(name: str, text: Column) -> Column:
    """One event a piece, with the text so far: the pieces stand side by side in the text, so
    that is its beginning up to the piece's end."""
    body = F.regexp_replace(text, r"(?U)\A\s+", "")

    def listed(ps: Column) -> Column:
        ends = F.aggregate(ps, F.array().cast("array<int>"), lambda acc, p: F.array_append(acc, F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + F.length(p)), lambda acc: acc)
        return F.get(F.transform(F.array(ends), lambda es: F.transform(ps, lambda p, i: event(p, F.get(es, i)))), F.lit(0))

    def event(p: Column, end: Column) -> Column:
        data = F.to_json(F.struct(p.alias("token"), F.substring(body, F.lit(1), end).alias("text_so_far"), end.alias("length")))
        return F.struct(F.lit(name).alias("event"), data.alias("data"))

    return F.get(F.transform(F.array(pieces(text)), listed), F.lit(0))


def one(name: str, *fields: Column) -> Column:
    return F.array(F.struct(F.lit(name).alias("event"), F.to_json(F.struct(*fields)).alias("data")))


def playback(results: DataFrame) -> DataFrame:
    """(request_id, seq, event, data, delay_ms) rows: structural text, realistic text, done.

    results: session_id, template_id, structural_text, realistic_text, the three maps,
    token_delay_ms and error; a failed request gives start and an error event.
    """
    start = one("phase", F.lit("start").alias("phase"), "template_id", "session_id")
    empty = lambda c: F.coalesce(c, F.create_map().cast("map<string,string>")).alias(c)
    good = F.concat(
        token_events("structured_token", F.col("structural_text")),
        one("structured_done", F.col("structural_text").alias("anonymized_text"), F.col("token_to_original").alias("mapping")),
        token_events("realistic_token", F.col("realistic_text")),
        one("realistic_done", F.col("realistic_text").alias("anonymized_text"), empty("token_to_fake"), empty("fake_to_token")),
        one("done", F.lit(True).alias("ok")),
    )
    events = F.concat(start, F.when(F.col("error").isNull(), good).otherwise(one("error", F.col("error").alias("detail"))))
    rows = results.select("request_id", "token_delay_ms", F.posexplode(events).alias("seq", "e"))
    delay = F.when(F.col("e.event").endswith("_token"), F.coalesce("token_delay_ms", F.lit(25))).otherwise(F.lit(0))
    return rows.select("request_id", "seq", "e.event", "e.data", delay.alias("delay_ms"))


def wire(event: Column, data: Column) -> Column:
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), data, F.lit("\n\n"))


def parsed(stream: Column) -> Column:
    """(event, data) of a text of wire-format events."""
    blocks = F.filter(F.split(stream, "\n\n"), lambda b: F.length(F.btrim(b)) > 0)
    line = lambda b, k: F.regexp_extract(b, f"(?m)^{k}: ?(.*)$", 1)
    return F.transform(blocks, lambda b: F.struct(line(b, "event").alias("event"), line(b, "data").alias("data")))


def utf16_units(text: Column) -> Column:
    """Length as browsers count it: characters beyond the basic plane are two units."""
    return F.octet_length(F.encode(text, "UTF-16BE")) / 2


def coverage(text: Column, token_to_original: Column) -> Column:
    """Percent of the text that distinct tokens cover, 100 at most, halves rounded up."""
    hidden = F.aggregate(F.map_values(token_to_original), F.lit(0.0), lambda a, v: a + utf16_units(v))
    return F.least(F.lit(100), F.floor(F.lit(100.0) * hidden / F.greatest(utf16_units(text), F.lit(1.0)) + 0.5).cast("int"))


def entity_name(typed: Column) -> Column:
    """A typed entity id in the form that templates use."""
    return F.regexp_replace(F.upper(F.btrim(typed)), "[^A-Z0-9_]", "_")


def listed_examples(typed: Column) -> Column:
    """Examples typed with commas or line breaks between."""
    return F.filter(F.transform(F.split(typed, "[\n,]"), lambda x: F.btrim(x)), lambda x: x != "")
