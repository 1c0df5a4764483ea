"""Session memory over a stream of requests: the batch fold with state in Spark's store."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import Canon
from ..operators.alias import AliasPolicy, SessionMemory

OUTPUT = "request_id long, session_id string, aliases string, group_keys string"


class MemoryProcessor(StatefulProcessor):
    """Requests of a session in order of (ts, seq, request_id) inside a batch."""

    def __init__(self, canon: Canon, policy: AliasPolicy):
        self.canon, self.policy = canon, policy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.memory = handle.getValueState("memory", StructType([StructField("json", StringType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(rows)
        frame = frame.sort_values([c for c in ("ts", "seq", "request_id") if c in frame.columns])
        state = json.loads(self.memory.get()[0]) if self.memory.exists() else None
        memory, out = SessionMemory(self.canon, self.policy, state), []
        for r in frame.itertuples():
            mentions = [(m["entity_id"], m["text"]) for m in json.loads(r.mentions or "[]")]
            ts = getattr(r, "ts", None)
            more = memory.augment(r.text or "", mentions, ts.timestamp() if ts is not None and not pd.isna(ts) else 0.0)
            keys = [memory.group_key(e, t) for e, t in (*mentions, *more)]
            out.append((r.request_id, key[0], json.dumps([{"entity_id": e, "text": t} for e, t in more]), json.dumps(keys)))
        self.memory.update((json.dumps(memory.state()),))
        yield pd.DataFrame(out, columns=["request_id", "session_id", "aliases", "group_keys"])

    def close(self) -> None:
        pass


def with_aliases(requests: DataFrame, canon: Canon, policy: AliasPolicy) -> DataFrame:
    """Streaming requests (request_id, session_id, text, mentions as JSON, ts) with aliases.

    Needs the RocksDB state store. A session's lifetime counts from its last request, by
    the requests' own times, as in batch.
    """
    return requests.groupBy("session_id").transformWithStateInPandas(
        statefulProcessor=MemoryProcessor(canon, policy), outputStructType=OUTPUT, outputMode="Append", timeMode="None"
    )
