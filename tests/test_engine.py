"""Behaviours of the whole plan on small requests."""

import json

import pytest
from pyspark.sql import functions as F

from veilframe.functions.text import Canon, View, canon_text
from veilframe.functions.tokens import token_id
from veilframe.operators import alias, chunking, events, reverse
from veilframe.operators.alias import AliasPolicy
from veilframe.plans.engine import Engine, Template
from veilframe.settings import Settings
from veilframe.sources import extractors, templates

IDS = ("PERSON", "ORG", "EMAIL", "PHONE", "LINKS", "PRODUCT")
POLICY = AliasPolicy(True, ("PERSON", "ORG", "PRODUCT"), 3, 3, 2)


def run(spark, requests, found=(), policy=POLICY, entities=None, client=None, **options):
    """requests: (id, session, text, mode, seconds); found: (id, entity, text)."""
    t = Template("t", 1, entities or [{"id": i, "enabled": True} for i in IDS], alias=policy, model="m")
    req = spark.createDataFrame(
        [(i, s, "t", x, mode, "faker", i, float(ts)) for i, s, x, mode, ts in requests],
        "request_id long, session_id string, template_id string, text string, render_mode string, fake_provider string, seq long, at double",
    ).withColumn("ts", F.timestamp_seconds("at"))
    m = spark.createDataFrame([(i, 1, 0, k, e, x) for k, (i, e, x) in enumerate(found)], "request_id long, src_rank int, chunk_idx int, ordinal int, entity_id string, text string")
    out = Engine(spark, Settings("test-secret"), [t], **options).anonymize(req, m, client)
    return {r.request_id: r for r in out.collect()}


def surfaces(row):
    return [s.text for s in row.spans]


def test_token_vectors(spark):
    df = spark.createDataFrame([("session-A", "PERSON", "john doe"), ("s", "ORG", "josé garcía")], "s string, e string, c string")
    got = [r.t for r in df.select(token_id("test-secret", F.col("s"), F.col("e"), F.col("c")).alias("t")).collect()]
    assert got == ["QZYBH4", "KVT7QI"]


def test_canon_and_view():
    assert canon_text(" ﬁ  Straße. ") == "fi strasse"
    assert canon_text("José García") == canon_text("José García")
    assert View("company become computing .com com", Canon()).find("com") == [(26, 29), (30, 33)]
    assert View("anana", Canon(strip_outer_punct=True)).find("@") == []
    assert View("a\n\n  b c", Canon()).find("A B") == [(0, 6)]


def test_longest_and_repeats(spark):
    r = run(spark, [(1, "s", "John Doe Smith works at ABC", "structural", 0), (2, "s2", "John Doe and John Doe met", "structural", 0)],
            [(1, "PERSON", "John"), (1, "PERSON", "John Doe Smith"), (2, "PERSON", "John Doe")], AliasPolicy())
    assert surfaces(r[1]) == ["John Doe Smith"]
    assert surfaces(r[2]) == ["John Doe", "John Doe"]
    assert len(r[2].token_to_original) == 1


def test_alias_across_requests_and_lifetime(spark):
    req = [(1, "a", "Jensen Huang", "structural", 1000), (2, "a", "Huang announced a roadmap.", "structural", 1001)]
    found = [(1, "PERSON", "Jensen Huang")]
    assert surfaces(run(spark, req, found)[2]) == ["Huang"]
    late = [req[0], (2, "a", req[1][2], "structural", 1002)]
    short = AliasPolicy(True, ("PERSON",), 3, 3, 2, 1)
    assert surfaces(run(spark, late, found, short)[2]) == []
    assert surfaces(run(spark, [req[0], (2, "b", req[1][2], "structural", 1001)], found)[2]) == []


def test_noise_is_dropped(spark):
    found = [(1, "LINKS", "com"), (1, "LINKS", "www.tech-private.com"), (2, "EMAIL", "chatbot"), (2, "EMAIL", "alice@example.com"), (2, "EMAIL", "bob.at.example.com")]
    r = run(spark, [(1, "s", "com www.tech-private.com", "structural", 0), (2, "t", "chatbot alice@example.com bob.at.example.com", "structural", 0)], found)
    assert surfaces(r[1]) == ["www.tech-private.com"]
    assert surfaces(r[2]) == ["alice@example.com", "bob.at.example.com"]


def test_realistic_is_consistent_and_reversible(spark):
    r = run(spark, [(1, "s", "Jensen Huang spoke.", "realistic", 0), (2, "s", "Huang confirmed; see https://www.tech-private.com/a", "realistic", 1)],
            [(1, "PERSON", "Jensen Huang"), (2, "LINKS", "https://www.tech-private.com/a")])
    full, short = next(iter(r[1].token_to_fake.values())), r[2].token_to_fake
    assert any(v in full.split() for v in short.values())
    link = next(v for v in short.values() if "://" in v)
    assert link.startswith("https://www.") and link.endswith(".com/a") and " " not in link
    back = spark.createDataFrame([(x.anonymized_text, x.token_to_original, x.fake_to_token) for x in r.values()], "t string, o map<string,string>, f map<string,string>")
    want = ["Jensen Huang spoke.", "Huang confirmed; see https://www.tech-private.com/a"]
    assert [x.a for x in back.select(reverse.deanonymized(F.col("t"), F.col("o"), F.col("f")).alias("a")).collect()] == want
    assert [x.a for x in back.select(reverse.deanonymized_safe("t", "o", "f").alias("a")).collect()] == want


def test_pool_beats_model_and_model_called_once(spark):
    class Client:
        def __init__(self, settings):
            pass

        def fake(self, entity, value, model):
            return "Blue Harbor LLC"

    entities = [{"id": "PERSON", "enabled": True, "use_pseudo_entities": True, "pseudo_entities": [" Alpha", "Beta", ""]}, {"id": "ORG", "enabled": True, "fake_provider": "llm"}]
    r = run(spark, [(1, "s", "Ann Lee at Novatec Inc", "realistic", 0)], [(1, "PERSON", "Ann Lee"), (1, "ORG", "Novatec Inc")], AliasPolicy(), entities, Client)
    assert set(r[1].token_to_fake.values()) & {"Alpha", "Beta"}
    assert "Blue Harbor LLC" in r[1].anonymized_text


def test_collisions_and_lost_template(spark):
    t = Template("t", 1, [{"id": "W", "enabled": True}])
    words = [chr(97 + i) * 4 for i in range(26)] * 2
    req = spark.createDataFrame([(1, "s", "t", " ".join(words[:26]), "structural", "", 1), (2, "s", "no", "x", "structural", "", 2)], "request_id long, session_id string, template_id string, text string, render_mode string, fake_provider string, seq long")
    m = spark.createDataFrame([(1, 1, 0, i, "W", w) for i, w in enumerate(words[:26])], "request_id long, src_rank int, chunk_idx int, ordinal int, entity_id string, text string")
    out = {r.request_id: r for r in Engine(spark, Settings("k", token_id_len=1), [t], collisions=True).anonymize(req, m).collect()}
    plain = {r.request_id: r for r in Engine(spark, Settings("k", token_id_len=1), [t]).anonymize(req, m).collect()}
    assert len(out[1].token_to_original) > len(plain[1].token_to_original)
    assert out[2].error == "template_not_found" and out[2].anonymized_text is None


def test_chunks(spark):
    df = spark.createDataFrame([("aaaa\n\nbbbb\n\ncccccccccccc\n\nd", "A. B! ..C")], "p string, s string")
    r = df.select(chunking.by_paragraphs(F.col("p"), 12).alias("p"), chunking.by_sentences(F.col("s"), 3).alias("s")).first()
    assert r.p == ["aaaa\n\nbbbb", "cccccccccccc", "d"]
    assert r.s[0] == "A." and "".join(r.s).replace(" ", "") == "A.B!..C"


def test_model_output(spark):
    rows = [(1, 0, "This is not JSON"), (2, 0, '```json\n{"entities": [{"entity_id": "P", "text": "x", "confidence": 1}]}\n```'), (3, 0, '{"entities": []}')]
    parsed = extractors.parsed_output(spark.createDataFrame(rows, "request_id long, chunk_idx int, raw string"))
    assert [r.request_id for r in parsed.where("error is not null").collect()] == [1]
    assert [tuple(r)[-2:] for r in extractors.output_mentions(parsed).collect()] == [("P", "x")]


def test_model_extractor_errors(spark):
    class Client:
        def __init__(self, settings):
            pass

        def extract(self, system, prompt, model):
            if "bad" in prompt:
                raise ValueError("no")
            return [{"entity_id": "P", "text": model}]

    prompts = spark.createDataFrame([(1, 0, "", "good", "m"), (2, 0, "", "bad", "m")], "request_id long, chunk_idx int, system string, prompt string, model string")
    got = {r.request_id: r for r in extractors.model_mentions(prompts, Settings("k"), Client).collect()}
    assert got[1].text == "m" and got[2].error == "no"


def template(**more):
    return {"template_id": "own", "version": 1, "entities": [{"id": "P"}], "llm": {"model": "m", "system": ""}} | more


def test_templates_on_disk(spark, tmp_path):
    bundled, custom = str(tmp_path / "b"), str(tmp_path / "c")
    templates.save(spark, template(), bundled)
    templates.save(spark, template(version=2), custom)
    (tmp_path / "b" / "broken.json").write_text("{")
    (tmp_path / "b" / "other.json").write_text(json.dumps(template(template_id="other")))
    both = templates.override(templates.read(spark, bundled), templates.read(spark, custom))
    assert {(r.stem, r.version) for r in both.collect()} == {("own", 2), ("other", 1)}
    assert [r.stem for r in templates.template_ids(spark, bundled).collect()] == ["broken", "other", "own"]
    assert Template.of(both.where("stem = 'own'").first()).enabled == ["P"]
    templates.delete("own", custom)
    with pytest.raises(FileNotFoundError):
        templates.delete("own", custom)
    with pytest.raises(PermissionError):
        templates.check_id("default-x")
    for bad in (template(entities=[{"id": "P"}, {"id": "P"}]), template(replacement={"placeholder_format": "{ID}"}), template(postpass_alias={"entity_ids": ["Q"], "enabled": True}),
                template(entities=[{"id": "P", "fake_provider": "x"}]), template(entities=[{"id": "P", "use_pseudo_entities": True}])):
        with pytest.raises(ValueError):
            templates.save(spark, bad, custom)


def test_events(spark):
    df = spark.createDataFrame([(" Web page ", "a, b\nc,,")], "i string, x string")
    r = df.select(events.entity_name(F.col("i")).alias("i"), events.listed_examples(F.col("x")).alias("x")).first()
    assert (r.i, r.x) == ("WEB_PAGE", ["a", "b", "c"])


def test_batch_memory_equals_stream(spark, tmp_path):
    from veilframe.streaming import memory

    rows = [(1, "a", "Jensen Huang leads", [("PERSON", "Jensen Huang")], 10.0), (2, "a", "Huang said", [], 20.0), (3, "b", "Huang said", [], 30.0)]
    shape = "request_id long, session_id string, text string, mentions array<struct<entity_id:string,text:string>>, s double"
    df = spark.createDataFrame(rows, shape).withColumn("ts", F.timestamp_seconds("s")).drop("s")
    batch = {r.request_id: [(a.entity_id, a.text) for a in r.aliases] for r in alias.with_aliases(df, Canon(), POLICY).collect()}
    assert batch[2] == [("PERSON", "Huang")] and batch[3] == []
    flat = df.withColumn("mentions", F.to_json("mentions"))
    flat.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = memory.with_aliases(spark.readStream.schema(flat.schema).parquet(str(tmp_path / "in")), Canon(), POLICY)
    q = stream.writeStream.format("memory").queryName("aliases").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).outputMode("append").start()
    assert q.awaitTermination(90)
    got = {r.request_id: [(a["entity_id"], a["text"]) for a in json.loads(r.aliases)] for r in spark.table("aliases").collect()}
    assert got == batch
