"""Extractors: where mentions come from. Each gives rows of schemas.MENTIONS.

Rules and gazetteers are DataFrame operations, model output may come as a table, and the
HTTP extractor calls a model server from the executors with a bounded pool per task.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..schemas import MENTION, MENTIONS, MODEL_OUTPUT
from ..settings import Settings

STRICT = "\nAnswer with one raw JSON object of that shape: no Markdown, no further keys, no other words."


def rule_mentions(requests: DataFrame, enabled: Column | None = None) -> DataFrame:
    """E-mail addresses, then .at. forms, then phone numbers; only ids that are enabled."""
    on = (lambda i: F.array_contains(enabled, i)) if enabled is not None else (lambda i: F.lit(True))
    none = F.array().cast("array<struct<entity_id:string,text:string>>")
    as_entity = lambda found, i: F.transform(found, lambda m: F.struct(F.lit(i).alias("entity_id"), m.alias("text")))
    found = F.concat(
        F.when(on("EMAIL"), as_entity(F.concat(rules.emails(F.col("text")), rules.emails_at(F.col("text"))), "EMAIL")).otherwise(none),
        F.when(on("PHONE"), as_entity(rules.phones(F.col("text")), "PHONE")).otherwise(none),
    )
    rows = requests.where(F.col("text").isNotNull()).select("request_id", F.posexplode(found).alias("ordinal", "m"))
    return rows.select("request_id", F.lit(0).alias("src_rank"), F.lit(0).alias("chunk_idx"), "ordinal", "m.entity_id", "m.text")


def table_mentions(mentions: DataFrame) -> DataFrame:
    """Mentions that a model gave earlier: request_id, chunk_idx, ordinal, entity_id, text."""
    return mentions.select("request_id", F.lit(1).alias("src_rank"), "chunk_idx", "ordinal", "entity_id", "text")


def gazetteer_mentions(requests: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Mentions of one-word names: the words of a text joined to (name, entity_id).

    Equi-join on the word; the gazetteer may be of any size.
    """
    words = requests.select("request_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+(?:['-][\p{L}\p{N}]+)*"), F.lit(0))).alias("ordinal", "word"))
    found = words.join(gazetteer.select(F.col("name").alias("word"), "entity_id"), "word")
    return found.select("request_id", F.lit(2).alias("src_rank"), F.lit(0).alias("chunk_idx"), "ordinal", "entity_id", F.col("word").alias("text"))


def json_text(raw: Column) -> Column:
    """Model output without a code fence around it."""
    out = F.btrim(F.regexp_replace(raw, r"^\s+|\s+$", ""))
    return F.regexp_replace(F.regexp_replace(out, r"^```(?:json)?\s*", ""), r"\s*```\z", "")


def parsed_output(raw: DataFrame) -> DataFrame:
    """Model output (request_id, chunk_idx, raw) with mentions, or an error where it is no valid JSON."""
    parsed = F.from_json(json_text(F.col("raw")), MODEL_OUTPUT, {"mode": "PERMISSIVE"})
    found = raw.withColumn("entities", parsed["entities"])
    bad = F.col("entities").isNull() | F.exists("entities", lambda e: e.isNull() | e["entity_id"].isNull() | e["text"].isNull())
    return found.withColumn("error", F.when(bad, F.lit("model output does not fit the schema")))


def output_mentions(parsed: DataFrame) -> DataFrame:
    rows = parsed.where("error is null").select("request_id", "chunk_idx", F.posexplode("entities").alias("ordinal", "m"))
    return rows.select("request_id", F.lit(1).alias("src_rank"), "chunk_idx", "ordinal", "m.entity_id", "m.text")


class ModelClient:
    """A chat server with fallback addresses; the address that answers is tried first."""

    def __init__(self, settings: Settings):
        self.settings = settings
        self.urls = list(dict.fromkeys(u.rstrip("/") for u in (settings.llm_base_url, *settings.llm_fallback_urls)))
        self.names: dict[str, str] = {}

    def call(self, method: str, path: str, payload: dict | None = None, timeout: float | None = None) -> dict:
        last: Exception | None = None
        for url in list(self.urls):
            request = urllib.request.Request(url + path, None if payload is None else json.dumps(payload).encode(), {"Content-Type": "application/json"}, method=method)
            try:
                with urllib.request.urlopen(request, timeout=timeout or self.settings.llm_timeout_s) as reply:
                    out = json.loads(reply.read() or b"{}")
            except urllib.error.HTTPError:
                raise  # the server was reached; another would answer the same
            except OSError as e:
                last = e
                continue
            self.urls.remove(url)
            self.urls.insert(0, url)
            return out
        raise ConnectionError(f"no model server answers: {last}")

    def model(self, requested: str) -> str:
        if requested not in self.names:
            try:
                names = [m.get("name", "") for m in self.call("GET", "/api/tags", timeout=5).get("models", [])]
            except (OSError, ValueError):
                names = []
            base = requested.split(":")[0]
            near = [n for n in names if n.split(":")[0] == base]
            self.names[requested] = requested if requested in names else f"{base}:latest" if f"{base}:latest" in names else near[0] if near else requested
        return self.names[requested]

    def chat(self, system: str, user: str, model: str) -> str:
        s = self.settings
        options = {"temperature": s.llm_temperature} | ({"num_predict": s.llm_max_tokens} if s.llm_max_tokens > 0 else {})
        messages = [{"role": "system", "content": system}, {"role": "user", "content": user}]
        reply = self.call("POST", "/api/chat", {"model": self.model(model), "messages": messages, "stream": False, "options": options, "keep_alive": s.llm_keep_alive})
        return (reply.get("message") or {}).get("content") or ""

    def extract(self, system: str, user: str, model: str) -> list[dict]:
        """Entities of one prompt; one retry with a stricter wording."""
        last: Exception | None = None
        for message in (user, user + STRICT):
            raw = self.chat(system, message, model).strip()
            for fence in ("```json", "```"):
                raw = raw.removeprefix(fence)
            try:
                entities = json.loads(raw.removesuffix("```").strip())["entities"]
                return [{"entity_id": str(e["entity_id"]), "text": str(e["text"])} for e in entities]
            except (ValueError, KeyError, TypeError) as e:
                last = e
        raise ValueError(f"model output does not fit the schema: {last}")

    def fake(self, entity_id: str, value: str, model: str) -> str:
        out = " ".join(self.chat("You invent harmless stand-ins for sensitive values.", f"Give one {entity_id} to stand for: {value}\nAnswer with the value alone.", model).split())
        if not out:
            raise ValueError("the model gave no value")
        return out


def model_mentions(prompts: DataFrame, settings: Settings, client=ModelClient) -> DataFrame:
    """Calls a model for (request_id, chunk_idx, system, prompt, model).

    Rows of MENTIONS and an error column; a failed chunk gives one row with its error.
    Tasks share no state, so a lost executor only repeats its own calls.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = client(settings)

        def one(row) -> list[tuple]:
            try:
                found = model.extract(row.system, row.prompt, row.model)
                return [(row.request_id, 1, row.chunk_idx, i, e["entity_id"], e["text"], None) for i, e in enumerate(found)]
            except (OSError, ValueError) as e:
                return [(row.request_id, 1, row.chunk_idx, 0, None, None, str(e))]

        with ThreadPoolExecutor(settings.parallelism) as pool:
            for frame in frames:
                rows = [r for part in pool.map(one, frame.itertuples()) for r in part]  # in order
                yield pd.DataFrame(rows, columns=["request_id", "src_rank", "chunk_idx", "ordinal", *(f.split()[0] for f in MENTION.split(", ")), "error"])

    return prompts.mapInPandas(run, MENTIONS + ", error string")
