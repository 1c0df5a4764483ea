"""Templates: reading, overriding, validating, saving, prompts, installed models."""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..schemas import TEMPLATES

# Ids that may be saved, and the prefix of bundled templates.
EDITABLE, PROTECTED = r"^[a-z0-9][a-z0-9._-]*\z", "default-"
NORMAL_FORMS = ["NFC", "NFD", "NFKC", "NFKD"]
PLACEHOLDER = "<<{ENTITY}:{ID}>>"


def schema() -> StructType:
    return StructType.fromDDL(TEMPLATES)


def _or(column: str, value) -> Column:
    return F.coalesce(F.col(column), F.lit(value))


def with_defaults(raw: DataFrame) -> DataFrame:
    """Missing options of templates filled in."""
    entity = lambda e: F.struct(
        e["id"].alias("id"),
        F.coalesce(e["enabled"], F.lit(True)).alias("enabled"),
        F.coalesce(e["instructions"], F.lit("")).alias("instructions"),
        e["fake_provider"].alias("fake_provider"),
        F.coalesce(e["use_pseudo_entities"], F.lit(False)).alias("use_pseudo_entities"),
        e["pseudo_entities"].alias("pseudo_entities"),
        e["examples"].alias("examples"),
    )
    part = lambda name, kv: F.struct(*(_or(f"{name}.{k}", v).alias(k) for k, v in kv.items()))
    canon = part("canon", {"unicode_normalize": "NFKC", "collapse_whitespace": True, "casefold": True, "strip_outer_punct": True})
    llm = F.struct(F.col("llm.model").alias("model"), F.col("llm.system").alias("system"), _or("llm.max_entities", 200).alias("max_entities"))
    own = F.col("replacement.pseudonym")
    pseudonym = F.when(own.isNotNull(), F.struct(own["mode"].alias("mode"), F.coalesce(own["id_len"], F.lit(6)).alias("id_len"), own["secret_env"].alias("secret_env"), own["providers"].alias("providers")))
    alias = F.struct(
        _or("postpass_alias.enabled", False).alias("enabled"),
        F.coalesce("postpass_alias.entity_ids", F.array().cast("array<string>")).alias("entity_ids"),
        *(_or(f"postpass_alias.{k}", v).alias(k) for k, v in {"min_token_len": 3, "window_size": 3, "min_overlap_tokens": 2, "session_ttl_seconds": 3600, "max_aliases_per_entity": 50}.items()),
    )
    return raw.withColumns({
        "entities": F.transform("entities", entity),
        "llm": llm,
        "canon": canon,
        "replacement": F.struct(_or("replacement.placeholder_format", PLACEHOLDER).alias("placeholder_format"), pseudonym.alias("pseudonym")),
        "postpass_alias": F.when(F.col("postpass_alias").isNotNull(), alias),
    })


def read(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Templates of a folder or file with their file's stem; invalid files are left out.

    strict raises on a malformed file instead (for reading one template).
    """
    shape = schema() if strict else StructType([*schema().fields, *StructType.fromDDL("_corrupt_record string").fields])
    reader = spark.read.schema(shape).option("multiLine", True)
    raw = reader.option("mode", "FAILFAST" if strict else "PERMISSIVE").option("pathGlobFilter", "*.json").json(path)
    raw = raw.withColumn("stem", F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", ""))
    if not strict:
        raw = raw.where("_corrupt_record is null and template_id is not null and version is not null and entities is not null and llm is not null").drop("_corrupt_record")
    return with_defaults(raw)


def template_ids(spark: SparkSession, path: str) -> DataFrame:
    """Stems of the template files of a folder, in order; none for a missing folder."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "stem string")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path)
    return files.select(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.json$", "").alias("stem")).orderBy("stem")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def override(bundled: DataFrame, custom: DataFrame) -> DataFrame:
    """Templates of both; a custom file replaces the bundled file of the same stem."""
    both = bundled.withColumn("rank", F.lit(1)).unionByName(custom.withColumn("rank", F.lit(0)))
    first = F.row_number().over(Window.partitionBy("stem").orderBy("rank"))
    return both.withColumn("n", first).where("n = 1").drop("n", "rank")


def listed(templates: DataFrame) -> DataFrame:
    return templates.select(F.col("stem").alias("template_id"), "version", "description").orderBy("template_id")


def errors(df: DataFrame | None = None) -> Column:
    """All violations of the rules for a template row, as messages; empty if valid."""
    ids = F.transform("entities", lambda e: e["id"])
    alias = F.col("postpass_alias")
    if_ = lambda bad, message: F.when(bad, message if isinstance(message, Column) else F.lit(message))
    each = lambda bad, message: F.transform(F.filter("entities", bad), message)
    named = lambda before, after: lambda e: F.concat(F.lit(before), F.coalesce(e["id"], F.lit("")), F.lit(after))
    pool = lambda e: F.coalesce(e["pseudo_entities"], F.array().cast("array<string>"))
    empty = F.coalesce(F.size("entities"), F.lit(0)) < 1
    unknown = F.array_sort(F.array_except(alias["entity_ids"], ids))
    flat = [
        if_(F.coalesce(F.col("template_id"), F.lit("")) == "", "template_id is empty"),
        if_(F.coalesce(F.col("version"), F.lit(0)) < 1, "version is below 1"),
        if_(empty, "there are no entities"),
        if_(F.coalesce(F.col("llm.model"), F.lit("")) == "", "llm.model is empty"),
        if_(F.col("llm.max_entities") < 1, "llm.max_entities is below 1"),
        if_(~F.col("canon.unicode_normalize").isin(NORMAL_FORMS), F.concat(F.lit("unknown normal form "), F.col("canon.unicode_normalize"))),
        if_(~F.contains(F.col("replacement.placeholder_format"), F.lit("{ENTITY}")), "placeholder_format lacks {ENTITY}"),
        if_(~F.contains(F.col("replacement.placeholder_format"), F.lit("{ID}")), "placeholder_format lacks {ID}"),
        if_(alias.isNotNull() & (F.size(unknown) > 0), F.concat(F.lit("postpass_alias names unknown ids: "), F.array_join(unknown, ", "))),
        *(if_(alias[k] < 1, f"postpass_alias.{k} is below 1") for k in ("min_token_len", "window_size", "min_overlap_tokens", "session_ttl_seconds", "max_aliases_per_entity")),
        if_(alias["min_overlap_tokens"] > alias["window_size"], "postpass_alias.min_overlap_tokens is above window_size"),
    ]
    again = F.filter(F.transform(ids, lambda x, i: F.when((i > 0) & F.array_contains(F.slice(ids, F.lit(1), i), x), x)), lambda x: x.isNotNull())
    by_entity = [
        each(lambda e: F.coalesce(e["id"], F.lit("")) == "", lambda e: F.lit("an entity id is empty")),
        F.transform(again, lambda x: F.concat(F.lit("duplicate entity id: "), x)),
        each(lambda e: ~F.coalesce(e["fake_provider"], F.lit("")).isin("", "faker", "llm"), named("entity ", ": fake_provider is neither faker nor llm")),
        each(lambda e: e["use_pseudo_entities"] & (F.size(pool(e)) == 0), named("entity ", ": pseudo_entities are missing")),
        each(lambda e: F.exists(pool(e), lambda v: v.isNull()), named("entity ", ": pseudo_entities are not all strings")),
        each(lambda e: F.exists(pool(e), lambda v: F.btrim(v) == ""), named("entity ", ": pseudo_entities hold an empty value")),
    ]
    return F.concat(F.array_compact(F.array(*flat)), *(F.coalesce(x, F.array().cast("array<string>")) for x in by_entity))


def validated(templates: DataFrame) -> DataFrame:
    found = templates.withColumn("errors", errors())
    return found.select("template_id", (F.size("errors") == 0).alias("valid"), "errors")


def check_id(template_id: str) -> None:
    """Raises for ids that may not be saved or deleted."""
    if template_id.startswith(PROTECTED):
        raise PermissionError(f"{template_id} is a bundled template")
    if not re.fullmatch(EDITABLE.removesuffix("\\z"), template_id):
        raise ValueError(f"{template_id!r} is no valid template id")


def editable(template_id: Column) -> Column:
    return ~template_id.startswith(PROTECTED) & template_id.rlike(EDITABLE)


def save(spark: SparkSession, template: dict, folder: str) -> None:
    """Validates a template and writes it to the folder as JSON, replacing its file."""
    check_id(template.get("template_id", ""))
    given = spark.createDataFrame([(json.dumps(template),)], "value string")
    one = with_defaults(given.select(F.from_json("value", schema(), {"mode": "FAILFAST"}).alias("t")).select("t.*"))
    found = one.select(errors().alias("e")).first().e
    if found:
        raise ValueError("; ".join(found))
    Path(folder).mkdir(parents=True, exist_ok=True)
    Path(folder, f"{template['template_id']}.json").write_text(json.dumps(template, ensure_ascii=False, indent=2))


def delete(template_id: str, folder: str) -> None:
    check_id(template_id)
    Path(folder, f"{template_id}.json").unlink()  # FileNotFoundError if there is none


def literal(entities: list[dict]) -> Column:
    """A template's entities as a literal column."""
    return F.from_json(F.lit(json.dumps(entities)), schema()["entities"].dataType)


def enabled_ids(entities: Column) -> Column:
    return F.transform(F.filter(entities, lambda e: e["enabled"]), lambda e: e["id"])


def definitions(entities: Column) -> Column:
    """A line for each enabled entity, with up to three examples of either kind."""

    def examples(e: Column, kind: str, label: str) -> Column:
        some = F.coalesce(F.try_element_at(e["examples"], F.lit(kind)), F.array().cast("array<string>"))
        return F.when(F.size(some) > 0, F.concat(F.lit(f"\n  {label}: "), F.array_join(F.slice(some, 1, 3), ", "))).otherwise(F.lit(""))

    line = lambda e: F.concat(F.lit("\n"), e["id"], F.lit(": "), e["instructions"], examples(e, "positive", "Such as"), examples(e, "negative", "But not"))
    return F.array_join(F.concat(F.array(F.lit("Entities:")), F.transform(F.filter(entities, lambda e: e["enabled"]), line)), "\n")


def prompt(entities: Column, text: Column, chunk: Column, chunks: Column) -> Column:
    """The message that asks a model for the entities of one chunk."""
    constraints = F.concat(
        F.lit('Answer with JSON only: {"entities": [{"entity_id": "<ID>", "text": "<AS WRITTEN>"}]}\nAllowed ids: '),
        F.array_join(enabled_ids(entities), ", "),
        F.lit("\nGive each text exactly as it is written; no offsets, scores or further fields; invent nothing."),
    )
    head = F.when(chunks > 1, F.concat(F.lit("TEXT (chunk "), (chunk + 1).cast("string"), F.lit(" of "), chunks.cast("string"), F.lit("):"))).otherwise(F.lit("TEXT:"))
    return F.concat_ws("\n\n", F.lit("Find the sensitive entities in the text."), definitions(entities), constraints, F.concat(head, F.lit("\n"), text))


def model_names(catalogue: DataFrame, raw: str = "raw") -> DataFrame:
    """(ordinal, name, quantization) of a model server's JSON catalogue."""
    shape = "models array<struct<name: string, quantization_level: string, details: struct<quantization_level: string>>>"
    models = catalogue.select(F.posexplode(F.from_json(raw, shape)["models"]).alias("ordinal", "m"))
    return models.select("ordinal", F.col("m.name").alias("name"), F.coalesce("m.details.quantization_level", "m.quantization_level").alias("quantization"))


def resolved_models(requested: DataFrame, installed: DataFrame, column: str = "model", prefer_latest: bool = True) -> DataFrame:
    """requested with resolved and quantization: exact, base:latest, first of the base, as is.

    With prefer_latest off (runtime information) :latest has no priority and what is not
    installed resolves to null.
    """
    base = lambda c: F.split_part(c, F.lit(":"), F.lit(1))
    pairs = requested.select(column).distinct().join(F.broadcast(installed), base(F.col(column)) == base(F.col("name")), "left")
    rank = F.when(F.col("name") == F.col(column), 0).when(F.lit(prefer_latest) & (F.col("name") == F.concat(base(F.col(column)), F.lit(":latest"))), 1).otherwise(2)
    best = pairs.withColumn("n", F.row_number().over(Window.partitionBy(column).orderBy(rank, "ordinal"))).where("n = 1")
    best = best.select(column, (F.coalesce("name", column) if prefer_latest else F.col("name")).alias("resolved"), "quantization")
    return requested.join(best, column, "left")
