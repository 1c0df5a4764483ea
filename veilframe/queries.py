"""Registered queries of the engine, each with an independent DuckDB statement if SQL can say it.

Every query reads its whole tables. Sessions are conversations, market segments or users.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import fakes, rules
from .functions.text import Canon, canon_ascii
from .functions.tokens import format_token, token_id
from .operators import alias, chunking, events, mentions, reverse, spans
from .operators.alias import AliasPolicy
from .plans.engine import Engine, Template
from .settings import Settings
from .sources import extractors, templates

SECRET = "test-secret"
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
RULES_ONLY = Template("rules", 1, [{"id": "EMAIL", "enabled": True}, {"id": "PHONE", "enabled": True}])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    home, path = str(Path(__file__).parents[1]), spark.sparkContext.environment.get("PYTHONPATH", "")
    if home not in path.split(":"):  # Python workers import the package from here
        spark.sparkContext.environment["PYTHONPATH"] = f"{home}:{path}".rstrip(":")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_EMAIL = rules.EMAIL
_PHONE = rules.PHONE.removeprefix("(?U)")
_POS = "generate_subscripts(m, 1) - 1 AS pos"


@query(f"SELECT doc_id, unnest(m) AS value, {_POS} FROM (SELECT doc_id, regexp_extract_all(text, '{_EMAIL}') AS m FROM documents)")
def rule_email(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(rules.emails(F.col("text"))).alias("pos", "value"))


@query(f"SELECT doc_id, unnest(m) AS value, {_POS} FROM (SELECT doc_id, regexp_extract_all(replace(text, '@', '.at.'), '{rules.EMAIL_AT}') AS m FROM documents)")
def rule_email_at(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(rules.emails_at(F.replace("text", F.lit("@"), F.lit(".at.")))).alias("pos", "value"))


_PHONES = f"list_filter(list_transform(regexp_extract_all(text, '{_PHONE}'), lambda x: trim(x)), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) >= 7)"


@query(f"SELECT doc_id, unnest(m) AS value, {_POS} FROM (SELECT doc_id, {_PHONES} AS m FROM documents)")
def rule_phone(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(rules.phones(F.col("text"))).alias("pos", "value"))


@query("""SELECT c_custkey AS id, 'customer' AS kind, trim(lower(trim(regexp_replace('  ' || c_name || ' ' || c_mktsegment || '!', '\\s+', ' ', 'g'))), '.,;:!?''"') AS canon FROM customer
UNION ALL SELECT page_id, 'page', trim(lower(trim(regexp_replace(url, '\\s+', ' ', 'g'))), '.,;:!?''"') FROM pages""")
def canon_text(spark, sf_dir):
    name = F.concat(F.lit("  "), F.col("c_name"), F.lit(" "), F.col("c_mktsegment"), F.lit("!"))
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("kind"), canon_ascii(name).alias("canon"))
    return a.union(table(spark, sf_dir, "pages").select("page_id", F.lit("page"), canon_ascii(F.col("url"))))


@query()
def canon_unicode(spark, sf_dir):
    from .functions.text import canon

    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(canon(F.col("text"))).alias("canon_md5"))


def _requests(docs: DataFrame, mode: str = "structural") -> DataFrame:
    return docs.select(
        F.col("doc_id").alias("request_id"), F.col("source").alias("session_id"), F.lit("rules").alias("template_id"), "text",
        F.lit(mode).alias("render_mode"), F.lit("faker").alias("fake_provider"), F.col("doc_id").alias("seq"),
    )


_FOUND = f"""SELECT doc_id, 'EMAIL' AS entity_id, unnest(m) AS text, generate_subscripts(m, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{_EMAIL}') AS m FROM documents)
UNION ALL SELECT doc_id, 'PHONE', unnest(m), 1000000 + generate_subscripts(m, 1) FROM (SELECT doc_id, {_PHONES} AS m FROM documents)"""


@query(f"""SELECT doc_id, entity_id, text, canon FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, entity_id, canon ORDER BY i) AS n
  FROM (SELECT *, trim(lower(regexp_replace(trim(text), '\\s+', ' ', 'g')), '.,;:!?''"') AS canon FROM ({_FOUND}))) WHERE n = 1 AND canon <> ''""")
def entity_dedupe_first(spark, sf_dir):
    found = extractors.rule_mentions(_requests(table(spark, sf_dir, "documents")))
    return mentions.deduplicated(found, ascii_only=True).select(F.col("request_id").alias("doc_id"), "entity_id", "text", "canon")


@query(f"""SELECT page_id AS id, 'LINKS' AS entity_id, pos, part AS text FROM (
  SELECT page_id, unnest(p) AS part, generate_subscripts(p, 1) - 1 AS pos FROM (SELECT page_id, string_split_regex(url, '[/.:?&=#]') AS p FROM pages))
WHERE NOT regexp_full_match(trim(part), '[A-Za-z]{{2,6}}')
UNION ALL SELECT doc_id, 'EMAIL', pos, w FROM (
  SELECT doc_id, unnest(p) AS w, generate_subscripts(p, 1) - 1 AS pos FROM (SELECT doc_id, string_split_regex(text, '[ \\n]') AS p FROM documents))
WHERE regexp_full_match(trim(w), '{_EMAIL}') OR regexp_full_match(trim(w), '{rules.EMAIL_AT}')""")
def structured_filter(spark, sf_dir):
    links = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.lit("LINKS").alias("entity_id"), F.posexplode(F.split("url", "[/.:?&=#]")).alias("pos", "text"))
    words = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("EMAIL").alias("entity_id"), F.posexplode(F.split("text", "[ \n]")).alias("pos", "text"))
    return mentions.filtered(links.union(words))


def _pad(x: int) -> str:
    return bytes(b ^ x for b in SECRET.encode().ljust(64, b"\0")).hex()


_HMAC = f"sha256(unhex('{_pad(0x5C)}') || unhex(sha256(unhex('{_pad(0x36)}') || encode(msg))))"
_B32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, 1, 10) AS BIGINT) >> {35 - 5 * i}) & 31 AS INT) + 1, 1)" for i in range(6))


@query(f"""SELECT c_custkey, {_B32} AS token_id, '<<PERSON:' || {_B32} || '>>' AS token
FROM (SELECT c_custkey, {_HMAC} AS h FROM (SELECT c_custkey, c_mktsegment || '|PERSON|' || lower(c_name) AS msg FROM customer))""")
def token_ids(spark, sf_dir):
    ident = token_id(SECRET, F.col("c_mktsegment"), F.lit("PERSON"), F.lower("c_name"))
    c = table(spark, sf_dir, "customer").select("c_custkey", ident.alias("token_id"))
    return c.withColumn("token", format_token("<<{ENTITY}:{ID}>>", F.lit("PERSON"), F.col("token_id")))


_WORDS = ["idiot", "Moron", "that", "the."]


@query(f"""WITH places AS (SELECT doc_id, text, shown, w, unnest(range(1, length(text) - length(w) + 2)) AS i FROM documents, (VALUES {', '.join(f"('{w}', '{w.strip('.')}')" for w in _WORDS)}) e(shown, w))
SELECT doc_id, shown AS entity, CAST(i - 1 AS INT) AS start, CAST(i - 1 + length(w) AS INT) AS "end" FROM places
WHERE lower(substr(text, i, length(w))) = lower(w) AND NOT regexp_matches(CASE WHEN i > 1 THEN substr(text, i - 1, 1) ELSE '' END, '[\\p{{L}}\\p{{N}}]') AND NOT regexp_matches(substr(text, i + length(w), 1), '[\\p{{L}}\\p{{N}}]')""")
def find_spans(spark, sf_dir):
    listed = F.array(*(F.struct(F.lit(i).alias("ordinal"), F.lit("WORD").alias("entity_id"), F.lit(w).alias("text")) for i, w in enumerate(_WORDS)))
    df = spans.with_candidates(table(spark, sf_dir, "documents").select("doc_id", "text", spans.possible(listed, F.col("text")).alias("mentions")))
    return df.select("doc_id", F.explode("candidates").alias("c")).select("doc_id", F.get(F.lit(_WORDS), F.col("c.ordinal")).alias("entity"), "c.start", "c.end")


@query("""WITH c AS (SELECT o_custkey, list({'neg': -(o_orderkey % 17 + 1), 's': o_orderkey % 200, 'o': o_orderkey} ORDER BY -(o_orderkey % 17 + 1), o_orderkey % 200, o_orderkey) AS xs FROM orders GROUP BY o_custkey),
kept AS (SELECT o_custkey, list_reduce(list_transform(xs, lambda x: [x]), lambda a, x: CASE WHEN len(list_filter(a, lambda u: x[1].s - x[1].neg > u.s AND x[1].s < u.s - u.neg)) > 0 THEN a ELSE a || x END) AS k FROM c)
SELECT o_custkey, CAST(u.s AS INT) AS start, CAST(u.s - u.neg AS INT) AS "end", u.o AS ordinal FROM (SELECT o_custkey, unnest(k) AS u FROM kept)""")
def resolve_overlaps(spark, sf_dir):
    start, length = (F.col("o_orderkey") % 200).cast("int"), (F.col("o_orderkey") % 17 + 1).cast("int")
    span = F.struct(F.lit("X").alias("entity_id"), F.lit("").alias("text"), start.alias("start"), (start + length).alias("end"), F.col("o_orderkey").alias("ordinal"), F.lit("").alias("canon"))
    grouped = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(span).alias("c"))  # one customer's orders
    kept = grouped.select("o_custkey", F.explode(spans.resolved(F.col("c"))).alias("s"))
    return kept.select("o_custkey", "s.start", "s.end", "s.ordinal")


def _engine(spark: SparkSession, *more: Template) -> Engine:
    return Engine(spark, Settings(SECRET), [RULES_ONLY, *more])


@query()
def anonymize_structural(spark, sf_dir):
    out = _engine(spark).anonymize(_requests(table(spark, sf_dir, "documents")))
    return out.select(F.col("request_id").alias("doc_id"), "anonymized_text", F.size("spans").alias("n_entities"))


@query()
def anonymize_realistic(spark, sf_dir):
    out = _engine(spark).anonymize(_requests(table(spark, sf_dir, "documents"), "realistic"))
    return out.select(F.col("request_id").alias("doc_id"), "anonymized_text", "token_to_original", "token_to_fake", "fake_to_token")


@query("SELECT doc_id, text FROM documents")
def deanonymize_roundtrip(spark, sf_dir):
    """Structural text put back by the span table: every original text, exactly."""
    out = _engine(spark).anonymize(_requests(table(spark, sf_dir, "documents")))
    return out.select(F.col("request_id").alias("doc_id"), reverse.unspliced(F.col("structural_text"), F.col("spans")).alias("text"))


@query("SELECT c_custkey, c_name || ' wrote to ' || c_mktsegment AS text FROM customer")
def deanonymize_tokens(spark, sf_dir):
    """Tokens and fakes replaced in map order give back the text."""
    c = table(spark, sf_dir, "customer")
    a = token_id(SECRET, F.lit("s"), F.lit("PERSON"), F.lower("c_name"))
    b = token_id(SECRET, F.lit("s"), F.lit("ORG"), F.lower("c_mktsegment"))
    c = c.select("c_custkey", "c_name", "c_mktsegment", format_token("<<{ENTITY}:{ID}>>", F.lit("PERSON"), a).alias("a"), format_token("<<{ENTITY}:{ID}>>", F.lit("ORG"), b).alias("b"))
    text = F.concat(F.col("a"), F.lit(" wrote to Zeta Labs"))
    originals, given = F.create_map("a", "c_name", "b", "c_mktsegment"), F.create_map(F.lit("Zeta Labs"), F.col("b"))
    return c.select("c_custkey", reverse.deanonymized(text, originals, given).alias("text"))


@query("""SELECT user_id, event_type AS token, CAST(max_by(value, event_id) AS VARCHAR) AS original, row_number() OVER (PARTITION BY user_id ORDER BY min(event_id)) - 1 AS pos
FROM (SELECT user_id, event_id, event_type, CAST(event_id % 1000 AS VARCHAR) AS value FROM events) GROUP BY user_id, event_type""")
def token_to_original(spark, sf_dir):
    s = F.struct("event_id", F.col("event_type").alias("token"), (F.col("event_id") % 1000).cast("string").alias("text"))
    seen = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(s)).alias("spans"))  # one user's events
    return seen.select("user_id", F.posexplode(Engine.tokens(F.col("spans"))).alias("pos", "t")).select("user_id", F.col("pos").cast("long").alias("pos"), "t.token", F.col("t.text").alias("original"))


_PACKED = """WITH p AS (SELECT doc_id, list_transform(string_split(replace(text, '. ', '.' || chr(10) || chr(10)), chr(10) || chr(10)), lambda x: {'done': CAST([] AS VARCHAR[]), 'cur': x, 'n': length(x) + 2}) AS ps FROM documents),
f AS (SELECT doc_id, list_reduce(ps, lambda a, x: CASE WHEN a.n + x.n > 800 THEN {'done': list_append(a.done, a.cur), 'cur': x.cur, 'n': x.n}
  ELSE {'done': a.done, 'cur': a.cur || chr(10) || chr(10) || x.cur, 'n': a.n + x.n} END) AS r FROM p),
c AS (SELECT doc_id, list_append(r.done, r.cur) AS cs FROM f),
u AS (SELECT doc_id, unnest(cs) AS chunk, generate_subscripts(cs, 1) - 1 AS chunk_idx FROM c)
"""


def _paragraphs(spark, sf_dir) -> DataFrame:
    """Documents with a paragraph for each sentence, so that each has many."""
    return table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit(". "), F.lit(".\n\n")).alias("text"))


@query(_PACKED + "SELECT doc_id, chunk_idx, md5(chunk) AS chunk_md5 FROM u")
def chunk_pack(spark, sf_dir):
    df = _paragraphs(spark, sf_dir).select("doc_id", F.posexplode(chunking.by_paragraphs(F.col("text"), 800)).alias("chunk_idx", "chunk"))
    return df.select("doc_id", F.col("chunk_idx").cast("long").alias("chunk_idx"), F.md5("chunk").alias("chunk_md5"))


@query(_PACKED + "SELECT doc_id, chunk_idx, md5(coalesce(right(lag(chunk) OVER (PARTITION BY doc_id ORDER BY chunk_idx), 200), '') || chunk) AS chunk_md5 FROM u")
def chunk_overlap(spark, sf_dir):
    df = _paragraphs(spark, sf_dir).withColumn("cs", chunking.by_paragraphs(F.col("text"), 800))
    df = df.select("doc_id", F.posexplode(chunking.overlapped(F.col("cs"), 200)).alias("chunk_idx", "chunk"))
    return df.select("doc_id", F.col("chunk_idx").cast("long").alias("chunk_idx"), F.md5("chunk").alias("chunk_md5"))


@query("""WITH p AS (SELECT doc_id, text, list_transform(list_filter(regexp_extract_all(text, '(?s)(?:[.!?][^.!?]*|[^.!?]+)[.!?]|[.!?]?[^.!?]+$|[.!?]$'), lambda x: x <> ''),
  lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')) AS ss FROM documents),
q AS (SELECT doc_id, text, list_transform(ss, lambda x: {'done': CAST([] AS VARCHAR[]), 'cur': x, 'n': length(x) + 1}) AS ps FROM p),
f AS (SELECT doc_id, text, len(ps) AS k, list_reduce(ps, lambda a, x: CASE WHEN a.n + x.n > 2000 THEN {'done': list_append(a.done, a.cur), 'cur': x.cur, 'n': x.n}
  ELSE {'done': a.done, 'cur': a.cur || ' ' || x.cur, 'n': a.n + x.n} END) AS r FROM q WHERE len(ps) > 0),
c AS (SELECT doc_id, list_append(r.done, r.cur) AS cs FROM f UNION ALL SELECT doc_id, [text] FROM q WHERE len(ps) = 0)
SELECT doc_id, CAST(generate_subscripts(cs, 1) - 1 AS INT) AS chunk_idx, md5(unnest(cs)) AS chunk_md5 FROM c""")
def chunk_sentences(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunking.by_sentences(F.col("text"), 2000)).alias("chunk_idx", "chunk"))
    return df.select("doc_id", "chunk_idx", F.md5("chunk").alias("chunk_md5"))


_TOK = "[A-Za-z0-9]+(?:[''-][A-Za-z0-9]+)*"


@query(f"""SELECT conv_id, array_to_string(list_sort(list_distinct(list(w)))[1:50], ' ') AS words FROM (
  SELECT conv_id, unnest(regexp_extract_all(text, '{_TOK}')) AS r, lower(r) AS w FROM conversations) WHERE length(w) >= 3 GROUP BY conv_id""")
def alias_vocab(spark, sf_dir):
    words = table(spark, sf_dir, "conversations").select("conv_id", F.explode(alias.tokens(F.col("text"), 3)).alias("t"))
    least = words.select("conv_id", "t.canon").distinct().groupBy("conv_id").agg(F.slice(F.array_sort(F.collect_list("canon")), 1, 50).alias("w"))
    return least.select("conv_id", F.array_join("w", " ").alias("words"))


@query(f"""WITH t AS (SELECT conv_id, turn, list_filter(list_transform(regexp_extract_all(text, '{_TOK}'), lambda x: lower(x)), lambda x: length(x) >= 3) AS ws FROM conversations),
g AS (SELECT conv_id, turn, ws[i] || ' ' || ws[i + 1] AS g FROM (SELECT *, unnest(range(1, len(ws))) AS i FROM t)
UNION SELECT conv_id, turn, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] FROM (SELECT *, unnest(range(1, len(ws) - 1)) AS i FROM t))
SELECT conv_id, turn, g AS ngram FROM g""")
def alias_ngrams(spark, sf_dir):
    words = F.transform(alias.tokens(F.col("text"), 3), lambda t: t["canon"])
    df = table(spark, sf_dir, "conversations").withColumn("ws", words)
    return df.select("conv_id", "turn", F.explode(alias.ngrams(F.col("ws"), 3)).alias("ngram"))


_FIRST = "regexp_extract(text, '[A-Z][a-z]{2,}')"


def _talk(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    first = F.regexp_extract("text", "[A-Z][a-z]{2,}", 0)
    named = F.when(first != "", F.array(F.struct(F.lit(0).alias("ordinal"), F.lit("PERSON").alias("entity_id"), first.alias("text")))).otherwise(F.array().cast("array<struct<ordinal:int,entity_id:string,text:string>>"))
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"), F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("seq"), "text", named.alias("mentions"))


@query(f"""WITH k AS (SELECT conv_id, turn, text, list_sort(list_distinct(list_filter(list(lower({_FIRST})) OVER (PARTITION BY conv_id ORDER BY turn), lambda x: x <> '')))[1:50] AS known FROM conversations),
t AS (SELECT conv_id, turn, known, unnest(regexp_extract_all(text, '{_TOK}')) AS w FROM k)
SELECT DISTINCT conv_id * 1000 + turn AS request_id, w AS alias FROM t WHERE length(w) >= 3 AND list_contains(known, lower(w))""")
def alias_candidates(spark, sf_dir):
    policy = AliasPolicy(True, ("PERSON",), 3, 1, 1)
    out = alias.with_aliases(_talk(spark, sf_dir), Canon(), policy)
    return out.select("request_id", F.explode("aliases").alias("a")).select("request_id", F.col("a.text").alias("alias"))


@query()
def alias_windows(spark, sf_dir):
    policy = AliasPolicy(True, ("PERSON",), 2, 2, 2)
    out = alias.with_aliases(_talk(spark, sf_dir), Canon(), policy)
    return out.select("request_id", F.size("aliases").alias("n_aliases"), "group_keys")


@query("""SELECT event_id, user_id, CAST(sum(broken) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS epoch FROM (
  SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 3600000000 THEN 1 ELSE 0 END AS broken FROM events)""")
def session_ttl(spark, sf_dir):
    out = alias.epochs(table(spark, sf_dir, "events"), "user_id", "ts", 3600, "event_id")
    return out.select("event_id", "user_id", "epoch")


_SEED = "(CAST('0x' || substr(sha256({}), 9, 8) AS BIGINT) & 2147483647)"


@query(f"SELECT c_custkey, {_SEED.format("c_mktsegment || '|PERSON|' || lower(c_name) || '|0'")} AS seed FROM customer")
def fake_seed(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", fakes.seed(F.col("c_mktsegment"), F.lit("PERSON"), F.lower("c_name")).alias("seed"))


_IDS = ["PERSON", "HOME_ADDR", "CITY_X", "ZIPCODE", "COUNTRY", "WORK_MAIL", "TELEFAX", "COMPANY", "NICKNAME", "WEB_LINK", "THING"]


@query("""SELECT id, original, CASE id WHEN 'PERSON' THEN 'name' WHEN 'HOME_ADDR' THEN 'street_address' WHEN 'CITY_X' THEN 'city' WHEN 'ZIPCODE' THEN 'postcode' WHEN 'COUNTRY' THEN 'country'
  WHEN 'WORK_MAIL' THEN 'email' WHEN 'TELEFAX' THEN 'phone_number' WHEN 'COMPANY' THEN 'company' WHEN 'NICKNAME' THEN 'name' WHEN 'WEB_LINK' THEN 'url'
  ELSE CASE WHEN contains(original, '@') THEN 'email' ELSE 'word' END END AS provider
FROM (VALUES ('PERSON'), ('HOME_ADDR'), ('CITY_X'), ('ZIPCODE'), ('COUNTRY'), ('WORK_MAIL'), ('TELEFAX'), ('COMPANY'), ('NICKNAME'), ('WEB_LINK'), ('THING')) v(id),
  (SELECT n_name AS original FROM nation UNION ALL SELECT n_name || '@x' FROM nation)""")
def provider_choice(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    both = n.select(F.explode(F.array("n_name", F.concat("n_name", F.lit("@x")))).alias("original"))
    ids = both.select(F.explode(F.lit(_IDS)).alias("id"), "original")
    return ids.withColumn("provider", fakes.provider(F.col("id"), F.col("original")))


@query("SELECT c_custkey, ['Alpha', 'Beta', 'Gamma'][CAST(CAST('0x' || substr(sha256(c_mktsegment || '|PERSON|' || c_name), 9, 8) AS BIGINT) % 3 AS INT) + 1] AS fake FROM customer")
def pseudo_entity(spark, sf_dir):
    pool = fakes.pseudo_pool(F.lit([" Alpha", "Beta ", "", "Gamma"]), F.lit(True))
    return table(spark, sf_dir, "customer").select("c_custkey", fakes.chosen(F.col("c_mktsegment"), F.lit("PERSON"), F.col("c_name"), pool).alias("fake"))


def _sql_list(xs: list[str]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


@query(f"""SELECT page_id, split_part(url, '://', 1) || '://' || CASE WHEN host LIKE 'www.%' THEN 'www.' ELSE '' END || {_sql_list(fakes.LINK_PREFIXES)}[CAST(n % 8 AS INT) + 1] || '-' || {_sql_list(fakes.LINK_NOUNS)}[CAST(n // 8 % 8 AS INT) + 1]
  || '.' || CASE WHEN regexp_full_match(tld, '[A-Za-z]{{2,10}}') THEN lower(tld) ELSE 'com' END || substr(url, length(split_part(url, '://', 1)) + 4 + length(auth)) AS fake
FROM (SELECT *, split_part(auth, ':', 1) AS host, list_last(string_split(split_part(auth, ':', 1), '.')) AS tld FROM (
  SELECT page_id, url, regexp_extract(url, '^[^:]+://([^/?#]*)', 1) AS auth, {_SEED.format("'s|LINKS|' || url || '|0'")} AS n FROM pages))""")
def link_fake(spark, sf_dir):
    n = fakes.seed(F.lit("s"), F.lit("LINKS"), F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", fakes.link_fake(F.col("url"), n).alias("fake"))


@query("""WITH p AS (SELECT p_partkey, string_split(p_name || ' of ' || p_type, ' ') AS ws FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN CASE WHEN ws[2] = ws[1] THEN 'Junior' ELSE 'Carver' END WHEN p_partkey % 3 = 1 THEN 'Carver Junior' ELSE 'Alex Carver Junior' END AS fake FROM p""")
def alias_projection(spark, sf_dir):
    group = F.concat("p_name", F.lit(" of "), "p_type")
    ws = F.split(group, " ")
    own = F.when(F.col("p_partkey") % 3 == 0, F.upper(F.get(ws, F.lit(1)))).when(F.col("p_partkey") % 3 == 1, F.array_join(F.slice(ws, 1, 2), " ")).otherwise(group)
    return table(spark, sf_dir, "part").select("p_partkey", fakes.projection(own, group, F.lit("Alex Carver Junior")).alias("fake"))


@query("""SELECT conv_id, turn, i - 1 AS seq, ps[i] AS token, CAST(length(array_to_string(ps[1:i], '')) AS INT) AS length FROM (
  SELECT conv_id, turn, ps, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT conv_id, turn, regexp_extract_all(text, '\\S+\\s*') AS ps FROM conversations))""")
def sse_tokens(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(events.token_events("structured_token", F.col("text"))).alias("seq", "e"))
    data = F.from_json("e.data", "token string, text_so_far string, length int")
    return c.select("conv_id", "turn", F.col("seq").cast("long").alias("seq"), data["token"].alias("token"), data["length"].alias("length"))


@query("SELECT event_id, event_type AS event, props AS data FROM events")
def sse_parse(spark, sf_dir):
    sent = table(spark, sf_dir, "events").select("event_id", F.concat(events.wire(F.lit("phase"), F.lit("{}")), events.wire(F.col("event_type"), F.col("props"))).alias("s"))
    return sent.select("event_id", F.explode(F.slice(events.parsed(F.col("s")), 2, 9)).alias("e")).select("event_id", "e.event", "e.data")


@query()
def playback(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    req = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"), F.col("conv_id").cast("string").alias("session_id"), F.lit("rules").alias("template_id"), "text", F.lit("realistic").alias("render_mode"), F.lit("faker").alias("fake_provider"), F.col("turn").alias("seq"))
    return _engine(spark).playback(req)


@query(f"""SELECT doc_id, CAST(least(100, floor(100.0 * coalesce(list_sum(list_transform(list_distinct(m), lambda x: length(x))), 0) / greatest(units, 1) + 0.5)) AS INT) AS coverage
FROM (SELECT doc_id, length(text) + length(regexp_replace(text, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')) AS units, regexp_extract_all(text, '{_EMAIL}') AS m FROM documents)""")
def coverage_kpi(spark, sf_dir):
    own = F.array_distinct(rules.emails(F.col("text")))
    return table(spark, sf_dir, "documents").select("doc_id", events.coverage(F.col("text"), F.map_from_arrays(own, own)).alias("coverage"))


_DEMO = [{"id": "PERSON", "enabled": True, "instructions": "Names of people.", "examples": {"positive": ["Ann", "Bo", "Cy", "Di"], "negative": ["May"]}}, {"id": "ORG", "enabled": False, "instructions": "Companies."}]


@query("""SELECT conv_id, turn, md5('Find the sensitive entities in the text.' || chr(10) || chr(10) || 'Entities:' || chr(10) || chr(10) || 'PERSON: Names of people.' || chr(10) || '  Such as: Ann, Bo, Cy' || chr(10) || '  But not: May' || chr(10) || chr(10)
  || 'Answer with JSON only: {"entities": [{"entity_id": "<ID>", "text": "<AS WRITTEN>"}]}' || chr(10) || 'Allowed ids: PERSON' || chr(10) || 'Give each text exactly as it is written; no offsets, scores or further fields; invent nothing.' || chr(10) || chr(10)
  || CASE WHEN turn = 0 THEN 'TEXT:' ELSE 'TEXT (chunk ' || turn || ' of ' || (turn + 1) || '):' END || chr(10) || text) AS prompt_md5 FROM conversations""")
def prompt_compile(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.md5(templates.prompt(templates.literal(_DEMO), F.col("text"), F.col("turn") - 1, F.col("turn") + 1)).alias("prompt_md5"))


@query("""SELECT 't' || n_nationkey AS template_id, (n_regionkey % 2 = 1 AND n_nationkey % 3 > 0) AS valid, CAST((n_regionkey % 2 = 0)::INT + (n_nationkey % 3 = 0)::INT * 2 AS INT) AS n_errors FROM nation""")
def template_validate(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    entity = lambda i: F.named_struct(F.lit("id"), i)
    raw = n.select(F.to_json(F.struct(
        F.concat(F.lit("t"), "n_nationkey").alias("template_id"), (F.col("n_regionkey") % 2).alias("version"),
        F.when(F.col("n_nationkey") % 3 == 0, F.array(entity(F.lit("A")), entity(F.lit("A")))).otherwise(F.array(entity(F.lit("A")))).alias("entities"),
        F.struct(F.when(F.col("n_nationkey") % 3 == 0, F.lit("")).otherwise(F.lit("m")).alias("model")).alias("llm"),
    )).alias("j"))
    rows = templates.with_defaults(raw.select(F.from_json("j", templates.schema()).alias("t")).select("t.*"))
    return templates.validated(rows).select("template_id", "valid", F.size("errors").alias("n_errors"))


@query("""SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'a:7b' WHEN 1 THEN 'b:latest' WHEN 2 THEN 'c:1' ELSE 'd:2' END AS resolved FROM nation""")
def model_resolve(spark, sf_dir):
    raw = '{"models": [{"name": "a:13b"}, {"name": "a:7b", "details": {"quantization_level": "Q4"}}, {"name": "b:2"}, {"name": "b:latest"}, {"name": "c:1"}]}'
    installed = templates.model_names(spark.createDataFrame([(raw,)], "raw string"))
    asked = table(spark, sf_dir, "nation").select("n_nationkey", F.get(F.lit(["a:7b", "b:9", "c:5", "d:2"]), F.col("n_nationkey") % 4).alias("model"))
    return templates.resolved_models(asked, installed).select("n_nationkey", "resolved")


@query("SELECT event_id AS request_id, upper(event_type) AS entity_id, 'v' || user_id AS text FROM events WHERE event_id % 10 > 0")
def model_output_parse(spark, sf_dir):
    body = F.concat(F.lit('{"entities": [{"entity_id": "'), F.upper("event_type"), F.lit('", "text": "v'), F.col("user_id").cast("string"), F.lit('", "confidence": 1}]}'))
    raw = F.when(F.col("event_id") % 10 == 0, F.lit("this is no JSON")).when(F.col("event_id") % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), F.lit(0).alias("chunk_idx"), raw.alias("raw"))
    return extractors.output_mentions(extractors.parsed_output(e)).select("request_id", "entity_id", "text")


_NAMES = [("moron", "SLUR"), ("idiot", "SLUR"), ("the", "ARTICLE")]


@query("""SELECT doc_id AS request_id, pos AS ordinal, CASE WHEN w = 'the' THEN 'ARTICLE' ELSE 'SLUR' END AS entity_id, w AS text FROM (
  SELECT doc_id, unnest(m) AS w, generate_subscripts(m, 1) - 1 AS pos FROM (SELECT doc_id, regexp_extract_all(text, '[\\p{L}\\p{N}]+(?:[''-][\\p{L}\\p{N}]+)*') AS m FROM documents))
WHERE w IN ('moron', 'idiot', 'the')""")
def gazetteer_mentions(spark, sf_dir):
    names = spark.createDataFrame(_NAMES, "name string, entity_id string")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("request_id"), "text")
    return extractors.gazetteer_mentions(docs, names).select("request_id", F.col("ordinal").cast("long").alias("ordinal"), "entity_id", "text")


