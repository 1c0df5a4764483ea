"""Session memory of names, and aliases found by it.

What a session knows at a request is a function of the entities of its requests so far
(aliases are not learned), each set cut to its `cap` least members. The memory of one
session is therefore bounded, and a partition sorted by (session, order) is folded row by
row: no session is ever held as a group.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..functions.text import Canon, canon_text

# Fixed value: tokens that aliases are made of.
TOKEN = r"[A-Za-z0-9]+(?:['-][A-Za-z0-9]+)*"
_TOKEN = re.compile(TOKEN)


@dataclass(frozen=True)
class AliasPolicy:
    enabled: bool = False
    entity_ids: tuple[str, ...] = ()
    min_token_len: int = 3
    window_size: int = 3
    min_overlap_tokens: int = 2
    session_ttl_seconds: int = 3600
    max_aliases_per_entity: int = 50

    @classmethod
    def of(cls, row) -> AliasPolicy:
        given = row.asDict() if hasattr(row, "asDict") else dict(row or {})
        got = {k: v for k, v in given.items() if v is not None and k in cls.__dataclass_fields__}
        return cls(**got | {"entity_ids": tuple(got.get("entity_ids", ()))})

    @property
    def active(self) -> bool:
        return self.enabled and bool(self.entity_ids)


def _least(values, n: int) -> list:
    return sorted(set(values))[:n]


@dataclass
class Known:
    """What a session knows of one entity id; plain lists, so that state stores take it."""

    words: list[str] = field(default_factory=list)
    ngrams: list[tuple[str, ...]] = field(default_factory=list)
    anchors: list[str] = field(default_factory=list)
    by_word: dict[str, list[str]] = field(default_factory=dict)

    def learn(self, words: list[str], phrase: str, policy: AliasPolicy) -> None:
        cap = policy.max_aliases_per_entity
        grams = [tuple(words[i : i + n]) for n in range(2, min(policy.window_size, len(words)) + 1) for i in range(len(words) - n + 1)]
        self.words, self.ngrams = _least([*self.words, *words], cap), _least([*self.ngrams, *grams], cap)
        if len(words) > 1 and phrase:
            self.anchors = _least([*self.anchors, phrase], cap)
            for w in words:
                self.by_word[w] = sorted({*self.by_word.get(w, ()), phrase})
            self.by_word = {w: self.by_word[w] for w in _least(self.by_word, cap)}


class SessionMemory:
    """The fold over one session's requests."""

    def __init__(self, canon: Canon, policy: AliasPolicy, state: dict | None = None):
        self.canon, self.policy = canon, policy
        self.last_seen: float | None = None
        self.known: dict[str, Known] = {}
        if state:
            self.last_seen = state["last_seen"]
            self.known = {i: Known(k["words"], [tuple(g) for g in k["ngrams"]], k["anchors"], {w: list(a) for w, a in k["by_word"].items()}) for i, k in state["known"].items()}

    def state(self) -> dict:
        return {"last_seen": self.last_seen, "known": {i: {"words": k.words, "ngrams": [list(g) for g in k.ngrams], "anchors": k.anchors, "by_word": k.by_word} for i, k in self.known.items()}}

    def tokens(self, text: str, least: int) -> list[tuple[str, str]]:
        pairs = ((canon_text(m.group(), self.canon).strip(), m.group()) for m in _TOKEN.finditer(text))
        return [(c, raw) for c, raw in pairs if len(c) >= least]

    def augment(self, text: str, entities: list[tuple[str, str]], now: float) -> list[tuple[str, str]]:
        """Learns a request's entities, then gives the aliases in its text."""
        p = self.policy
        if not p.active:
            return []
        if self.last_seen is not None and now - self.last_seen > p.session_ttl_seconds:
            self.known = {}
        self.last_seen = now
        for entity, value in entities:
            words = [c for c, _ in self.tokens(value, p.min_token_len)] if entity in p.entity_ids else []
            if words:
                self.known.setdefault(entity, Known()).learn(words, canon_text(value, self.canon).strip(), p)
        found, pairs = [], self.tokens(text, p.min_token_len)
        for entity in sorted(set(p.entity_ids) & self.known.keys()):
            known = self.known[entity]
            vocabulary = set(known.words)
            grams: dict[str, list[set]] = {}  # only n-grams that share a token are looked at
            for g in known.ngrams:
                for w in set(g):
                    grams.setdefault(w, []).append(set(g))
            values = {raw for c, raw in pairs if c in vocabulary}
            for n in range(2, min(p.window_size, len(pairs)) + 1):
                for i in range(len(pairs) - n + 1):
                    window = {c for c, _ in pairs[i : i + n]}
                    if len(window & vocabulary) >= p.min_overlap_tokens and self._shares(window, grams, known, p.min_overlap_tokens):
                        values.add(" ".join(raw for _, raw in pairs[i : i + n]))
            found += [(entity, v) for v in sorted(values)]
        return found

    @staticmethod
    def _shares(window: set[str], grams: dict[str, list[set]], known: Known, least: int) -> bool:
        if least < 1:
            return bool(known.ngrams)
        return any(len(window & g) >= least for w in window for g in grams.get(w, ()))

    def group_key(self, entity: str, text: str) -> str:
        """The full phrase that a mention belongs to, if there is just one; else itself."""
        phrase = canon_text(text, self.canon).strip()
        words = [c for c, _ in self.tokens(text, 1)]
        known = self.known.get(entity)
        if not phrase or not words or known is None or phrase in known.anchors:
            return phrase
        sets = [set(known.by_word[w]) for w in set(words) if known.by_word.get(w)]
        common = set.intersection(*sets) if sets else set()
        return next(iter(common)) if len(common) == 1 else phrase


def with_aliases(requests: DataFrame, canon: Canon, policy: AliasPolicy, session: str = "session_id", order: tuple[str, ...] = ("ts", "seq", "request_id")) -> DataFrame:
    """requests (text, mentions) with aliases and a group_keys entry for mentions and aliases.

    One shuffle by session; inside a partition rows arrive in order and are folded one at
    a time. Time is the column ts (null: 0), compared to the session's last request.
    """
    schema = StructType([*requests.schema.fields, *StructType.fromDDL("aliases array<struct<entity_id: string, text: string>>, group_keys array<string>").fields])
    places = {c: requests.columns.index(c) for c in (session, "text", "mentions")}
    at = requests.columns.index("ts") if "ts" in requests.columns else None
    kinds, names = [f.type for f in to_arrow_schema(schema)], schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, memory = None, SessionMemory(canon, policy)
        for batch in batches:
            aliases, keys = [], []
            for i in range(batch.num_rows):
                own = batch.column(places[session])[i].as_py()
                if (own,) != current:
                    current, memory = (own,), SessionMemory(canon, policy)
                text = batch.column(places["text"])[i].as_py() or ""
                mentions = [(m["entity_id"], m["text"]) for m in batch.column(places["mentions"])[i].as_py() or ()]
                ts = batch.column(at)[i].as_py() if at is not None else None
                more = memory.augment(text, mentions, ts.timestamp() if ts is not None else 0.0)
                aliases.append([{"entity_id": e, "text": t} for e, t in more])
                keys.append([memory.group_key(e, t) for e, t in (*mentions, *more)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(aliases, type=kinds[-2]), pa.array(keys, type=kinds[-1])], names=names)

    ordered = requests.repartition(session).sortWithinPartitions(session, *(c for c in order if c in requests.columns))
    return ordered.mapInArrow(run, schema)


def tokens(text: Column, least: int) -> Column:
    """(canonical, raw) tokens of ASCII names, in the JVM."""
    pairs = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda r: F.struct(F.lower(r).alias("canon"), r.alias("raw")))
    return F.filter(pairs, lambda p: F.length(p["canon"]) >= least)


def ngrams(words: Column, window: int) -> Column:
    """All runs of 2 to window words, as strings joined by a space."""
    runs = lambda n: F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*(runs(n) for n in range(2, window + 1)))) if window > 1 else F.array().cast("array<string>")


def epochs(events: DataFrame, session: str, ts: str, ttl_seconds: float, *ties: str) -> DataFrame:
    """events with epoch, which counts the gaps above the lifetime in each session."""
    w = Window.partitionBy(session).orderBy(ts, *ties)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    gap = micros - F.lag(micros).over(w)
    broken = F.coalesce((gap > int(ttl_seconds * 1_000_000)).cast("int"), F.lit(0))
    return events.withColumn("_broken", broken).withColumn("epoch", F.sum("_broken").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_broken")
