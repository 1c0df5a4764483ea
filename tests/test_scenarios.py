"""Further scenarios of the whole plan, and its parts against their column twins."""

import json
import random
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F
from test_engine import run, surfaces

from veilframe.functions import fakes
from veilframe.functions.text import Canon, View, canon_text
from veilframe.operators import events, spans
from veilframe.operators.alias import AliasPolicy
from veilframe.plans.engine import Engine, Template
from veilframe.settings import Settings
from veilframe.sources import extractors, templates

REQUEST = "request_id long, session_id string, template_id string, text string, render_mode string, fake_provider string, seq long"


def test_punctuated_mentions_keep_word_boundaries():
    assert View("Johnson met John. ok", Canon()).find("John.") == [(12, 16)]
    assert View("John's. (John) johns", Canon()).find("'John'") == [(0, 4), (9, 13)]


def test_views_of_all_shapes():
    """The quick view against character by character, by the places of every needle."""
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice(["a", "B", "ß", "ﬁ", " ", "  ", "\n", "é", "é", " ", "İ", "🙂", "-"]) for _ in range(rng.randint(1, 30)))
        for policy in (Canon(), Canon(collapse_whitespace=False), Canon(casefold=False, unicode_normalize="NFC")):
            view = View(text, policy)
            pos = view.pos if view.pos is not None else list(range(len(text)))
            assert len(pos) == len(view.norm)
            for i, c in zip(pos, view.norm, strict=True):
                assert c in View(text[i], policy)._folded(text[i]) or (c == " " and text[i].isspace()) or (c == " " and View(text[i], policy)._folded(text[i])[:1].isspace())


def test_a_pool_of_one_value(spark):
    words = [f"w{i:03d}x" for i in range(600)]
    entities = [{"id": "W", "enabled": True, "use_pseudo_entities": True, "pseudo_entities": ["Alpha"]}]
    r = run(spark, [(1, "s", " ".join(words), "realistic", 0)], [(1, "W", w) for w in words], AliasPolicy(), entities)[1]
    assert len(r.token_to_fake) == len(set(r.token_to_fake.values())) == len(r.fake_to_token) == len(r.token_to_original)
    assert "Alpha" in r.fake_to_token


def test_a_missing_model_value_is_one_request_s_error(spark):
    class Client:
        def __init__(self, settings):
            pass

        def fake(self, entity, value, model):
            if "bad" in value:
                raise ValueError("no")
            return "Blue Harbor"

    entities = [{"id": "ORG", "enabled": True, "fake_provider": "llm"}]
    req = [(1, "a", "Straße AG", "realistic", 0), (2, "b", "Bad Firm", "realistic", 0)]
    r = run(spark, req, [(1, "ORG", "Straße AG"), (2, "ORG", "Bad Firm")], AliasPolicy(), entities, Client)
    assert "Blue Harbor" in r[1].anonymized_text and r[1].error is None
    assert r[2].error == "no model value for ORG" and r[2].anonymized_text is None and r[2].session_id == "b"


def test_links_and_projections_against_their_columns(spark):
    links = ["https://www.Tech-private.com/a?b=1#c", "http://x.org", "ftp://a.b.c.museum:21/x", "HTTPS://www.y.x1/", "https://h./p", "https://example.co.uk?q#f"]
    rows = [(u, n) for u in links for n in (0, 7, 8, 63, 12345)]
    got = spark.createDataFrame(rows, "u string, n long").select("u", "n", fakes.link_fake(F.col("u"), F.col("n")).alias("f")).collect()
    assert all(r.f == fakes.link_fake_of(r.u, r.n) for r in got)
    assert fakes.link_fake_of("www.tech-private.com", 0) == "www.portal-insight.com" and fakes.link_fake_of("a.org/x?y", 0) == "portal-insight.org/x?y"
    assert fakes.link_fake_of("/only/path", 0) == "www.portal-insight.com" and fakes.link_fake_of("a.org?", 0) == "portal-insight.org"
    rng, words = random.Random(2), ["ann", "Lee", "ann", "Bo", "of"]
    pick = lambda k: " ".join(rng.choice(words) for _ in range(rng.randint(0, k)))
    rows = [(pick(3), pick(4), pick(4)) for _ in range(400)]
    got = spark.createDataFrame(rows, "o string, g string, b string").select("*", fakes.projection(F.col("o"), F.col("g"), F.col("b")).alias("p")).collect()
    assert all(r.p == fakes.projected("PERSON", r.o, r.g, r.b) for r in got)
    assert fakes.projected("WEB_URL", "a", "a b", "x y") == "x y"


def test_possible_mentions_lose_none(spark):
    texts = ["The mill.", "the  old\nmill", "Straße MILL", "nothing", "x.mill", ""]
    named = ["mill", "Mill.", "old mill", "straße", "zzz"]
    listed = F.array(*(F.struct(F.lit(i).alias("ordinal"), F.lit("W").alias("entity_id"), F.lit(w).alias("text")) for i, w in enumerate(named)))
    df = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("mentions", listed)
    cells = lambda d: {r.text: [tuple(c) for c in r.candidates] for r in spans.with_candidates(d).collect()}
    assert cells(df) == cells(df.withColumn("mentions", spans.possible(F.col("mentions"), F.col("text"))))
    assert {t: len(c) for t, c in cells(df).items()}["the  old\nmill"] == 3


def test_coverage_counts_units_of_browsers(spark):
    df = spark.createDataFrame([("🙂a", {"t": "🙂"})], "x string, m map<string,string>")
    assert df.select(events.coverage(F.col("x"), F.col("m")).alias("c")).first().c == 67


@pytest.mark.parametrize(
    ("entity", "full", "later", "alias"),
    [("ORG", "Acme Corporation", "Acme announced quarterly revenue.", "Acme"), ("PRODUCT", "Air Max", "Max demand increased this quarter.", "Max")],
)
def test_aliases_of_other_kinds(spark, entity, full, later, alias):
    r = run(spark, [(1, "s", f"{full} is here.", "structural", 0), (2, "s", later, "structural", 1)], [(1, entity, full)])
    assert surfaces(r[2]) == [alias] and alias not in r[2].anonymized_text


def test_other_scripts_and_address_shapes(spark):
    arabic = "اتصل أحمد العلي بالمكتب"
    r = run(spark, [(1, "s", arabic, "structural", 0), (2, "t", "Lives at Brigit Macaron Avenue 17 New York", "realistic", 0)],
            [(1, "PERSON", "أحمد العلي"), (2, "ADDRESS", "Brigit Macaron Avenue 17 New York")], AliasPolicy(),
            [{"id": "PERSON", "enabled": True}, {"id": "ADDRESS", "enabled": True}])
    assert surfaces(r[1]) == ["أحمد العلي"]
    fake = next(iter(r[2].token_to_fake.values()))
    assert not fake.isalpha() and any(c.isdigit() for c in fake)


class Server:
    """A model server that answers from a function and keeps what it was asked."""

    def __init__(self, answer):
        asked = self.asked = []

        class Handler(BaseHTTPRequestHandler):
            def reply(self, body):
                data = json.dumps(body).encode()
                self.send_response(200)
                self.end_headers()
                self.wfile.write(data)

            def do_GET(self):
                self.reply({"models": [{"name": "m:7b", "details": {"quantization_level": "Q4"}}, {"name": "m:latest"}]})

            def do_POST(self):
                body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
                asked.append(body)
                self.reply({"message": {"content": answer(body)}})

            def log_message(self, *args):
                pass

        self.http = HTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.http.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.http.server_port}"


def test_client_against_a_server():
    answers = iter(["no JSON", '```json\n{"entities": [{"entity_id": "P", "text": "x"}]}\n```', "nothing", "nothing", " A  B ", ""])
    server = Server(lambda body: next(answers))
    client = extractors.ModelClient(Settings("k", llm_base_url="http://127.0.0.1:9", llm_fallback_urls=(server.url + "/",)))
    assert client.extract("s", "u", "m:9") == [{"entity_id": "P", "text": "x"}]
    assert [a["model"] for a in server.asked] == ["m:latest", "m:latest"] and extractors.STRICT in server.asked[1]["messages"][1]["content"]
    assert client.urls[0] == server.url  # the one that answered goes first
    with pytest.raises(ValueError):
        client.extract("s", "u", "m:7b")
    assert server.asked[-1]["model"] == "m:7b"
    assert client.fake("P", "x", "m") == "A B"
    with pytest.raises(ValueError):
        client.fake("P", "x", "m")
    with pytest.raises(ConnectionError):
        extractors.ModelClient(Settings("k", llm_base_url="http://127.0.0.1:9")).call("GET", "/")


def test_extraction_inside_the_plan(spark):
    """Rules, chunks, a model server, merge, aliases once, errors, runtime information, playback."""

    def answer(body):
        prompt = body["messages"][1]["content"]
        if "broken" in prompt:
            return "nothing"
        found = [n for n in ("Jensen Huang", "NVIDIA") if n in prompt.split("TEXT")[-1]]
        return json.dumps({"entities": [{"entity_id": "PERSON" if " " in n else "ORG", "text": n} for n in found]})

    server = Server(answer)
    settings = Settings("test-secret", chunk_target=30, chunk_overlap=0, llm_base_url=server.url)
    ids = [{"id": i, "enabled": True} for i in ("PERSON", "ORG", "EMAIL")]
    engine = Engine(spark, settings, [Template("t", 1, ids, alias=AliasPolicy(True, ("PERSON", "ORG"), 3, 2, 2), model="m:7b", system="find")])
    rows = [(1, "s", "t", "Jensen Huang spoke on Monday.\n\nNVIDIA wrote to a@b.example.", "structural", "faker", 1), (2, "s", "t", "Huang left.", "structural", "faker", 2),
            (3, "u", "t", "broken text", "structural", "faker", 3), (4, "u", "lost", "x", "structural", "faker", 4)]
    requests = spark.createDataFrame(rows, REQUEST)
    installed = templates.model_names(spark.createDataFrame([('{"models": [{"name": "m:7b", "details": {"quantization_level": "Q4"}}]}',)], "raw string"))
    r = {x.request_id: x for x in engine.anonymize(requests, extractor=extractors.ModelClient, installed=installed).collect()}
    assert surfaces(r[1]) == ["Jensen Huang", "NVIDIA", "a@b.example"] and surfaces(r[2]) == ["Huang"]
    assert {a["model"] for a in server.asked} == {"m:7b"} and any("chunk 2 of 2" in a["messages"][1]["content"] for a in server.asked)
    assert r[1].meta.model_runtime.resolved_model == "m:7b" and r[1].meta.model_runtime.quantization_level == "Q4"
    assert r[3].error and r[3].anonymized_text is None and r[4].error == "template_not_found"
    played = engine.playback(requests, extractor=extractors.ModelClient).orderBy("request_id", "seq").collect()
    one = [(x.event, json.loads(x.data)) for x in played if x.request_id == 1]
    assert one[0][1]["phase"] == "start" and one[-1] == ("done", {"ok": True})
    assert dict(one)["structured_done"]["anonymized_text"] == r[1].anonymized_text
    last = [d for e, d in one if e == "realistic_token"][-1]
    assert last["text_so_far"] == dict(one)["realistic_done"]["anonymized_text"] and last["length"] == len(last["text_so_far"])
    assert [x.event for x in played if x.request_id == 4] == ["phase", "error"]


def test_settings_from_the_environment(monkeypatch):
    with pytest.raises(ValueError):
        Settings.from_env("VF_NONE_")
    for k, v in {"PSEUDONYM_SECRET": "x", "CHUNK_ENABLED": "no", "CHUNK_TARGET": "5", "LLM_TEMPERATURE": "0.5", "LLM_FALLBACK_URLS": "a, b,"}.items():
        monkeypatch.setenv("VF_" + k, v)
    s = Settings.from_env("VF_")
    assert (s.pseudonym_secret, s.chunk_enabled, s.chunk_target, s.llm_temperature, s.llm_fallback_urls) == ("x", False, 5, 0.5, ("a", "b"))


def test_runtime_of_models_that_are_not_installed(spark):
    asked = spark.createDataFrame([("a:7b",), ("b:1",)], "model string")
    installed = spark.createDataFrame([(0, "b:2", "Q8"), (1, "b:latest", "Q4")], "ordinal int, name string, quantization string")
    got = {r.model: (r.resolved, r.quantization) for r in templates.resolved_models(asked, installed, prefer_latest=False).collect()}
    assert got == {"a:7b": (None, None), "b:1": ("b:2", "Q8")}


def test_canon_of_both_paths(spark):
    from veilframe.functions.text import canon

    texts = ["  A b ", "Straße.", "ﬁ x", "", "'q'"]
    got = {r.t: r.c for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", canon(F.col("t")).alias("c")).collect()}
    assert got == {t: canon_text(t) for t in texts}
