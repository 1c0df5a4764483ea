"""The whole plan: requests in, anonymised texts and mappings out."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import Canon
from ..functions.tokens import PLACEHOLDER, format_token, token_id
from ..operators import alias, chunking, events, mentions, render, spans
from ..settings import Settings
from ..sources import extractors, templates


@dataclass
class Template:
    """What the plan needs of one template row, held on the driver."""

    template_id: str
    version: int = 1
    entities: list[dict] = field(default_factory=list)
    canon: Canon = field(default_factory=Canon)
    alias: alias.AliasPolicy = field(default_factory=alias.AliasPolicy)
    placeholder: str = PLACEHOLDER
    providers: dict[str, str] = field(default_factory=dict)
    model: str | None = None
    system: str = ""

    @classmethod
    def of(cls, row) -> Template:
        r = row.asDict(recursive=True)
        replacement = r.get("replacement") or {}
        return cls(
            r["template_id"], r["version"], r["entities"] or [], Canon.of(r.get("canon")), alias.AliasPolicy.of(r.get("postpass_alias")),
            replacement.get("placeholder_format") or PLACEHOLDER, (replacement.get("pseudonym") or {}).get("providers") or {},
            (r.get("llm") or {}).get("model"), (r.get("llm") or {}).get("system") or "",
        )

    @property
    def enabled(self) -> list[str]:
        return [e["id"] for e in self.entities if e.get("enabled", True)]


class Engine:
    """Anonymises requests under one or more templates."""

    def __init__(self, spark: SparkSession, settings: Settings, rows: list[Template] | DataFrame, collisions: bool = False, strict_ids: bool = False, refilter_aliases: bool = False):
        self.spark, self.settings = spark, settings
        held = rows if isinstance(rows, list) else [Template.of(r) for r in rows.collect()]  # a small dimension
        self.templates = {t.template_id: t for t in held}
        self.collisions, self.strict_ids, self.refilter = collisions, strict_ids, refilter_aliases

    def chunks(self, requests: DataFrame) -> DataFrame:
        s = self.settings
        return chunking.chunked(requests, s.chunk_target, s.chunk_overlap, s.chunk_enabled)

    def model_mentions(self, requests: DataFrame, template: Template, client=extractors.ModelClient) -> DataFrame:
        """Mentions by a model server, chunk by chunk; failed chunks carry an error."""
        entities = templates.literal(template.entities)
        prompts = self.chunks(requests).select(
            "request_id", "chunk_idx", F.lit(template.system).alias("system"),
            templates.prompt(entities, F.col("chunk"), F.col("chunk_idx"), F.col("n_chunks")).alias("prompt"), F.lit(template.model).alias("model"),
        )
        return extractors.model_mentions(prompts, self.settings, client)

    def located(self, requests: DataFrame, template: Template, found: DataFrame | None = None) -> DataFrame:
        """requests with their disjoint spans, each with canon, token_id and token."""
        enabled = F.lit(template.enabled) if template.enabled else F.array().cast("array<string>")
        sources = [extractors.rule_mentions(requests, enabled)]
        if found is not None:
            own = found.where(F.col("entity_id").isNotNull())
            if self.strict_ids:
                own = own.where(F.array_contains(enabled, F.col("entity_id")))
            sources.append(own.select(*sources[0].columns))
        kept = mentions.filtered(mentions.deduplicated(mentions.merged(*sources), template.canon))
        df = requests.join(mentions.per_request(kept), "request_id", "left")
        if template.alias.active:
            df = alias.with_aliases(df, template.canon, template.alias)
            more = F.coalesce(F.col("aliases"), F.array().cast("array<struct<entity_id:string,text:string>>"))
            if self.refilter:
                from ..functions.rules import noise

                more = F.filter(more, lambda m: ~noise(m["entity_id"], m["text"]))
            own = F.coalesce("mentions", F.array().cast("array<struct<ordinal:int,entity_id:string,text:string>>"))
            both = F.concat(own, F.transform(more, lambda m, i: F.struct((F.size(own) + i).alias("ordinal"), m["entity_id"].alias("entity_id"), m["text"].alias("text"))))
            df = df.withColumn("mentions", both).drop("aliases")
        else:
            df = df.withColumn("group_keys", F.lit(None).cast("array<string>"))
        df = spans.with_candidates(df, template.canon)
        df = df.withColumn("spans", spans.resolved(F.col("candidates"))).drop("candidates", "mentions")
        return self._tokenised(df, template)

    def _tokenised(self, df: DataFrame, template: Template) -> DataFrame:
        ident = lambda s, suffix=None: token_id(self.settings.pseudonym_secret, F.col("session_id"), s["entity_id"], s["canon"], self.settings.token_id_len, suffix)
        extra = lambda s: F.coalesce(F.try_element_at(F.col("suffixes"), F.concat_ws("|", s["entity_id"], s["canon"])), F.lit(0)) if self.collisions else None
        if self.collisions:
            df = df.join(self._suffixes(df, ident), "session_id", "left")
        with_id = F.transform("spans", lambda s: F.struct(*(s[c].alias(c) for c in ("entity_id", "text", "start", "end", "ordinal", "canon")), ident(s, extra(s)).alias("token_id")))
        token = lambda s: format_token(template.placeholder, s["entity_id"], s["token_id"])
        group = lambda s: F.coalesce(F.get(F.col("group_keys"), s["ordinal"]), s["canon"])
        df = df.withColumn("spans", with_id)
        done = F.transform("spans", lambda s: F.struct(*(s[c].alias(c) for c in ("entity_id", "text", "start", "end", "canon", "token_id")), token(s).alias("token"), group(s).alias("group_key")))
        return df.withColumn("spans", done).drop("group_keys", "suffixes")

    def _suffixes(self, df: DataFrame, ident) -> DataFrame:
        """For each session, the suffix of every canon whose id another canon had first."""
        order = ["seq", "request_id"] if "seq" in df.columns else ["request_id"]
        rows = df.select("session_id", *order, F.explode("spans").alias("s"))
        first = rows.groupBy("session_id", F.col("s.entity_id").alias("e"), F.col("s.canon").alias("c")).agg(F.min(F.struct(*order, F.col("s.start"))).alias("at"))
        s = F.struct(F.col("e").alias("entity_id"), F.col("c").alias("canon"))
        ranked = first.withColumn("n", F.row_number().over(Window.partitionBy("session_id", "e", ident(s)).orderBy("at")) - 1).where("n > 0")
        return ranked.groupBy("session_id").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "e", "c"), "n"))).alias("suffixes"))

    @staticmethod
    def tokens(found: Column) -> Column:
        """Distinct tokens in order of appearance, each with its last span."""
        keys = F.array_distinct(F.transform(found, lambda s: s["token"]))
        return F.transform(keys, lambda k: F.element_at(F.filter(found, lambda s: s["token"] == k), -1))

    def _one(self, requests: DataFrame, template: Template, found: DataFrame | None, client, extractor, installed: DataFrame | None) -> DataFrame:
        if extractor is not None:
            asked = self.model_mentions(requests, template, extractor)
            found = asked if found is None else asked.unionByName(found, allowMissingColumns=True)
        df = self.located(requests, template, found)
        df = df.withColumn("structural_text", spans.spliced(F.col("text"), F.col("spans"), lambda s: s["token"])).withColumn("tokens", self.tokens(F.col("spans")))
        df = df.withColumn("token_to_original", F.map_from_arrays(F.transform("tokens", lambda t: t["token"]), F.transform("tokens", lambda t: t["text"])))
        realistic = F.col("render_mode") == "realistic"
        key = lambda t: render.model_key(t["entity_id"], F.coalesce(t["group_key"], t["token_id"]))
        parts = ("token", "token_id", "entity_id", "text", "group_key")
        df = df.withColumn("tokens", F.when(realistic, F.transform("tokens", lambda t: F.struct(*(t[c].alias(c) for c in parts), key(t).alias("model_key")))))
        llm = None
        if client is not None:
            groups = df.select("session_id", F.explode("tokens").alias("t")).select("session_id", "t.entity_id", F.coalesce("t.group_key", "t.token_id").alias("group_key"), "t.model_key")
            by_session = render.model_fakes(groups, self.settings, template.model, client).where("fake is not null").groupBy("session_id").agg(
                F.map_from_entries(F.collect_list(F.struct("model_key", "fake"))).alias("llm")
            )
            df, llm = df.join(by_session, "session_id", "left"), "llm"
        df = render.with_fakes(df, template.entities, template.providers, llm)
        to_fake = F.when(realistic, F.map_from_arrays(F.transform("fakes", lambda f: f["token"]), F.transform("fakes", lambda f: f["fake"])))
        to_token = F.when(realistic, F.map_from_arrays(F.transform("fakes", lambda f: f["fake"]), F.transform("fakes", lambda f: f["token"])))
        resolved, quantization = self.runtime(template, installed)
        meta = F.struct(
            "session_id", "template_id", F.lit(template.version).alias("template_version"), "render_mode", "fake_provider",
            F.struct(F.lit(template.model).alias("requested_model"), F.lit(resolved).cast("string").alias("resolved_model"), F.lit(quantization).cast("string").alias("quantization_level")).alias("model_runtime"),
        )
        out = df.select(
            "request_id", "session_id",
            F.when(realistic, render.replaced(F.col("structural_text"), F.col("fakes"))).otherwise(F.col("structural_text")).alias("anonymized_text"),
            "structural_text", "spans", "token_to_original", to_fake.alias("token_to_fake"), to_token.alias("fake_to_token"), meta.alias("meta"),
            F.lit(None).cast("string").alias("error"), F.col("fake_error").alias("failed"),
        )
        if found is not None and "error" in found.columns:
            chunk = found.where("error is not null").groupBy("request_id").agg(F.min("error").alias("chunk_error"))
            out = out.join(chunk, "request_id", "left").withColumn("failed", F.coalesce("chunk_error", "failed")).drop("chunk_error")
        return self._failed(out)

    def runtime(self, template: Template, installed: DataFrame | None) -> tuple[str | None, str | None]:
        """Name and quantisation of the installed model that a template's model stands for."""
        if installed is None or template.model is None:
            return None, None
        asked = self.spark.createDataFrame([(template.model,)], "model string")
        row = templates.resolved_models(asked, installed, prefer_latest=False).first()
        return row.resolved, row.quantization

    @staticmethod
    def _failed(out: DataFrame) -> DataFrame:
        """A request with a failed chunk keeps its ids and the error, nothing else."""
        keep = ("request_id", "session_id", "meta", "error")
        return out.select(*(F.coalesce("failed", "error").alias(c) if c == "error" else F.col(c) if c in keep else F.when(F.col("failed").isNull(), F.col(c)).alias(c) for c in out.columns if c != "failed"))

    def anonymize(self, requests: DataFrame, found: DataFrame | None = None, client=None, extractor=None, installed: DataFrame | None = None) -> DataFrame:
        """Results of all requests; those with an unknown template carry an error.

        found: mentions of schemas.MENTIONS from a model, with an error column or without.
        extractor: model client class that finds mentions, chunk by chunk; a request with a
        failed chunk carries its error. client: model client class for fake_provider llm.
        installed: templates.model_names() of the model server, for the runtime information.
        """
        parts = [self._one(requests.where(F.col("template_id") == t.template_id), t, found, client, extractor, installed) for t in self.templates.values()]
        known = F.coalesce(F.col("template_id").isin(list(self.templates)), F.lit(False)) if self.templates else F.lit(False)
        out = mentions.merged(*parts) if parts else None
        lost = requests.where(~known)
        if out is None:
            return lost.select("request_id", "session_id", F.lit("template_not_found").alias("error"))
        lost = lost.select(*(F.col(c) if c in ("request_id", "session_id") else F.lit("template_not_found").alias(c) if c == "error" else F.lit(None).cast(out.schema[c].dataType).alias(c) for c in out.columns))
        return out.unionByName(lost)

    def playback(self, requests: DataFrame, *args, **options) -> DataFrame:
        """Events of structural and realistic results, both from one extraction.

        requests: as for anonymize, whose other arguments follow; token_delay_ms where it exists.
        """
        delay = F.col("token_delay_ms") if "token_delay_ms" in requests.columns else F.lit(None).cast("int")
        given = requests.select("request_id", F.col("template_id").alias("asked"), delay.alias("token_delay_ms"))
        out = self.anonymize(requests.withColumn("render_mode", F.lit("realistic")), *args, **options).join(given, "request_id")
        return events.playback(out.withColumns({"realistic_text": F.col("anonymized_text"), "template_id": F.col("asked")}))
