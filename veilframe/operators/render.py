"""Realistic rendering: one fake per token, consistent inside a group, unique in a request."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fakes import chosen_of, is_link, link_fake_of, made, projected, provider_of, seed_of
from ..sources.extractors import ModelClient

ATTEMPTS = 100


class RequestFakes:
    """Fakes of one request, in the order in which its tokens appear."""

    def __init__(self, session: str, overlay: dict[str, str] | None = None):
        self.session, self.overlay = session, overlay
        self.used: dict[str, set[str]] = {}
        self.bases: dict[tuple[str, str], str] = {}
        self.views: dict[tuple[str, str, str], str] = {}

    def _base(self, entity: str, group: str, original: str, attempt: int) -> str:
        n = seed_of(self.session, entity, group, attempt)
        if is_link(entity):
            return link_fake_of(original, n)
        return made(provider_of(entity, original, self.overlay), n)

    def fake(self, entity: str, token_id: str, original: str, group: str) -> str:
        group = group or token_id
        view = (entity, group, (original or token_id).strip().casefold())
        if view not in self.views:
            used, base = self.used.setdefault(entity, set()), self.bases.get((entity, group))
            for attempt in range(ATTEMPTS):
                base = base or self._base(entity, group, original, attempt)
                out = projected(entity, original, group, base)
                if out not in used:
                    break
                if out != base:  # a part of a fake already taken: other attempts keep it
                    base = out = f"{entity}_{token_id}"
                    break
                base = None
            else:
                base = out = f"{entity}_{token_id}"
            used.add(out)
            self.bases[entity, group], self.views[view] = base, out
        return self.views[view]


def distinct(fake: str, token: str, token_id: str, taken: dict[str, str]) -> str:
    """fake, or where another token of the request has it, fake with a growing part of the id,
    then with a number."""
    ends = [""] + [f"-{token_id[:k]}" for k in range(3, max(4, len(token_id) + 1))]
    n = 0
    while taken.get(out := fake + (ends[n] if n < len(ends) else f"{ends[-1]}-{n - len(ends) + 2}"), token) != token:
        n += 1
    taken[out] = token
    return out


FAKES = "struct<fakes: array<struct<token: string, fake: string>>, error: string>"


def with_fakes(
    requests: DataFrame, entities: list[dict], overlay: dict[str, str] | None = None, llm: str | None = None
) -> DataFrame:
    """requests (session_id, fake_provider, tokens) with fakes: (token, fake) in order, and fake_error.

    tokens: array of (token, token_id, entity_id, text, group_key, model_key) in order of
    appearance; of rows without tokens Python sees a null. An entity's own pool
    goes before its provider, that before the request's. llm names a map column from model_key
    to a model's fake; a request that lacks one has an error and no fakes.
    """
    config = {e["id"]: e for e in entities}

    def one(session: str | None, default: str | None, tokens: list[dict], given: dict[str, str] | None) -> dict:
        session, given = session or "", given or {}
        fakes, taken, out = RequestFakes(session, overlay), {}, []
        for t in tokens:
            e = config.get(t["entity_id"], {})
            pool = [v.strip() for v in (e.get("pseudo_entities") or ()) if v and v.strip()] if e.get("use_pseudo_entities") else []
            group = t["group_key"] or t["token_id"]
            if pool:
                fake = chosen_of(session, t["entity_id"], t["token"], pool)
            elif (e.get("fake_provider") or default or "faker").lower() == "llm":
                base = given.get(t["model_key"])
                if base is None:
                    return {"fakes": None, "error": f"no model value for {t['entity_id']}"}
                fake = projected(t["entity_id"], t["text"], group, base)
            else:
                fake = fakes.fake(t["entity_id"], t["token_id"], t["text"], group)
            out.append({"token": t["token"], "fake": distinct(fake, t["token"], t["token_id"], taken)})
        return {"fakes": out, "error": None}

    @F.pandas_udf("string")
    def made_of(asked: pd.Series) -> pd.Series:  # JSON both ways: one short string a request
        return asked.map(lambda x: None if x is None else json.dumps(one(**json.loads(x))))

    fields = {"session": F.col("session_id"), "default": F.col("fake_provider"), "tokens": F.col("tokens"), "given": F.col(llm) if llm else F.lit(None).cast("map<string,string>")}
    asked = F.to_json(F.struct(*(c.alias(k) for k, c in fields.items())), {"ignoreNullFields": "false"})
    out = requests.withColumn("fakes", F.from_json(made_of(F.when(F.size("tokens") > 0, asked)), FAKES))
    none = F.when(F.size("tokens") == 0, F.array().cast("array<struct<token:string,fake:string>>"))
    return out.withColumns({"fake_error": F.col("fakes.error"), "fakes": F.coalesce("fakes.fakes", none)})


def model_key(entity_id: Column, group_key: Column) -> Column:
    """By which a model's fake is asked for and found again."""
    return F.concat_ws("|", entity_id, F.lower(F.btrim(group_key)))


def model_fakes(groups: DataFrame, settings, model: str, client=ModelClient) -> DataFrame:
    """(session_id, model_key) with a model's fake: one call for each; null where it fails.

    groups: session_id, entity_id, group_key, model_key.
    """

    def run(frames):
        server = client(settings)

        def one(entity: str, value: str) -> str | None:
            try:
                return server.fake(entity, value, model)
            except (OSError, ValueError):
                return None

        for frame in frames:
            frame["fake"] = [one(e, g) for e, g in zip(frame.entity_id, frame.group_key, strict=True)]
            yield frame[["session_id", "model_key", "fake"]]

    once = groups.groupBy("session_id", "model_key").agg(F.min("entity_id").alias("entity_id"), F.lower(F.min("group_key")).alias("group_key"))
    return once.mapInPandas(run, "session_id string, model_key string, fake string")


def replaced(text: Column, pairs: Column, old: str = "token", new: str = "fake") -> Column:
    """text with pairs applied one after the other."""
    return F.aggregate(pairs, text, lambda acc, p: F.replace(acc, p[old], p[new]))
