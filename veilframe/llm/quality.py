"""Quality rules by distribution divergence (DataFrame functions only).

Each document yields two histograms: shares of nine character classes, and shares of
the common words of its language against all other words. A language's reference is
the mean share over its documents of MIN_WORDS words or more, from all rows; it is four
rows of some thirty integers, whatever the input. A document is rejected if the
Jensen-Shannon distance of its characters or of its words to the reference is above a
limit; histograms of too few characters or words are not judged.

The base rules come first: fewer than MIN_WORDS words, or more than half of the words in
three-word windows that occur twice or more, fail. Repeated windows are found by sorting
64-bit hashes of the windows inside the row, so long texts cost n log n and no shuffle.

Defined results: null or empty text has no words and fails the base rules; a null or
unknown language is held against the mean of all documents by its characters only; equal
rows are judged alike and all kept; with no reference at all nothing is rejected
by divergence; other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, fresh, table, words

MIN_WORDS = 50
#: Guards: a histogram with fewer characters or words than these is not judged.
MIN_CHARS, MIN_COMMON = 200, 100
#: Rejected above these distances (0 to 1).
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.30, 0.29
SCALE = 1_000_000
# Twenty frequent function words of each language.
COMMON_WORDS = {
    "en": "the of and to in a is that it for on with as was be by at are this from",
    "fr": "le la les de des du et en un une que qui dans pour par sur est pas avec au",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als",
    "es": "de la que el en y a los se del las un por con no una su para es al",
}
COMMON_WORDS = {k: v.split() for k, v in COMMON_WORDS.items()}
SYMBOLS = "#*$%&|<>"
#: Character classes, each counted in what those before it have left over.
CLASSES = ["[a-z]+", " +", "[^\\x00-\\x7f]+", "[A-Z]+", "[.,;:!?'\"()-]+", "[0-9]+", "[\\n\\r]+", "[#*$%&|<>]+"]


def _bound(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def repeated_words(ws: Column) -> Column:
    """Words inside three-word windows that occur twice or more in the array."""
    hashes = F.transform(F.sequence(F.lit(0), F.size(ws) - 3), lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)))

    def covered(starts: Column) -> Column:
        reach = F.transform(starts, lambda q, j: F.least(F.lit(3), F.coalesce(F.get(starts, j + 1) - q, F.lit(3))))
        return F.aggregate(reach, F.lit(0), lambda a, x: a + x)

    def twins(pairs: Column) -> Column:
        same = F.transform(
            pairs,
            lambda x, j: F.when(x["h"].eqNullSafe(F.get(pairs, j - 1)["h"]) | x["h"].eqNullSafe(F.get(pairs, j + 1)["h"]), x["i"]),
        )
        return _bound(F.sort_array(F.array_compact(same)), covered)

    def count(hs: Column) -> Column:
        pairs = F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(_bound(pairs, twins))

    return F.when(F.size(ws) < 4, F.lit(0)).otherwise(_bound(hashes, count)).cast("long")


def measured(docs: DataFrame, prefix: str = "q_") -> tuple[DataFrame, dict[str, str]]:
    """docs and the counts behind the rules, under names that docs does not use.

    The mark is no count: a filter that names it stays above this projection, else
    Catalyst would push it down and compute every count in it a second time.
    """
    keys = ["text", "words", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "chars", "common", "mark"]
    name = dict(zip(keys, fresh(docs, *(prefix + k for k in keys)), strict=True))
    df = docs.withColumn(name["text"], F.coalesce("text", F.lit("")))
    left = [name["text"], *fresh(docs, *(f"{prefix}left_{i}" for i in range(len(CLASSES))))]
    for i, kind in enumerate(CLASSES):
        rest = F.replace(F.col(left[i]), F.lit(" "), F.lit("")) if kind == " +" else F.regexp_replace(left[i], kind, "")
        df = df.withColumn(left[i + 1], rest)
    lengths = [F.length(c).cast("long") for c in left]
    df = df.withColumn(name["chars"], F.array(*(a - b for a, b in zip(lengths, lengths[1:], strict=False)), lengths[-1]))
    df = df.withColumn(name["words"], words(F.col(name["text"])))
    ws = F.col(name["words"])
    text = F.col(name["text"])
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\x0b\x0c\r"))) > 0)
    dup = _bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    every = sorted({w for ws_ in COMMON_WORDS.values() for w in ws_})
    known = F.filter(F.transform(ws, F.lower), lambda x: x.isin(every))

    def tally(found: Column) -> Column:
        of = lambda terms: F.transform(F.lit(terms), lambda t: F.size(F.filter(found, lambda x: x == t)).cast("long"))
        out = F.lit(None).cast("array<long>")
        for lang, terms in COMMON_WORDS.items():
            out = F.when(F.col("lang") == lang, of(terms)).otherwise(out)
        return out

    df = df.withColumns({
        name["n_words"]: F.size(ws).cast("long"),
        name["word_chars"]: F.aggregate(ws, F.lit(0).cast("long"), lambda a, x: a + F.length(x)),
        name["n_symbols"]: F.get(name["chars"], F.lit(7)),
        name["n_dup_lines"]: dup.cast("long"),
        name["n_repeat_words"]: repeated_words(ws),
        name["common"]: _bound(known, tally),
        name["mark"]: F.monotonically_increasing_id(),
    })
    return df.drop(name["text"], name["words"], *left[1:]), name


def references(df: DataFrame, name: dict[str, str]) -> dict[str | None, tuple[list[int], list[int]]]:
    """For each known language, and None for all: summed shares of characters, words.

    df, name: as measured() gives them; only the histograms are computed for this.
    """
    total = F.aggregate(name["chars"], F.lit(0).cast("long"), lambda a, x: a + x)
    lang = F.when(F.col("lang").isin(*COMMON_WORDS), F.col("lang"))
    df = df.where((F.col(name["n_words"]) >= MIN_WORDS) & (F.col(name["mark"]) >= 0)).select(lang.alias("l"), name["chars"], name["common"], name["n_words"], total.alias("t"))
    n_terms = max(map(len, COMMON_WORDS.values()))
    sums = [F.sum((F.get(name["chars"], F.lit(i)) * SCALE / F.col("t")).cast("long")).alias(f"c{i}") for i in range(len(CLASSES) + 1)]
    sums += [F.sum((F.get(name["common"], F.lit(i)) * SCALE / F.col(name["n_words"])).cast("long")).alias(f"w{i}") for i in range(n_terms)]
    out: dict = {}
    for row in df.groupBy("l").agg(F.count(F.lit(1)).alias("n"), *sums).collect():  # five rows at most
        chars, common = [row[f"c{i}"] for i in range(len(CLASSES) + 1)], [row[f"w{i}"] or 0 for i in range(n_terms)]
        if row.l is not None:
            out[row.l] = (chars, [*common[: len(COMMON_WORDS[row.l])], row.n * SCALE - sum(common)])
        out[None] = ([a + b for a, b in zip(out.get(None, ([0] * len(chars),))[0], chars, strict=True)], [])
    return out


def distance(counts: Column, total: Column, reference: list[int]) -> Column:
    """Jensen-Shannon distance (base 2 logarithm) of counts / total to a reference."""
    whole = float(sum(reference))
    shares = F.lit([x / whole for x in reference])
    side = lambda a, b: F.when(a > 0, a * F.log(2 * a / (a + b))).otherwise(F.lit(0.0))
    terms = F.zip_with(counts, shares, lambda c, q: _bound(c / total, lambda p: side(p, q) + side(q, p)))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / F.lit(1.3862943611198906), F.lit(0.0)))


def judged(df: DataFrame, name: dict[str, str], refs: dict) -> tuple[DataFrame, dict[str, str]]:
    """A measured frame with base_failed, kept and both distances."""
    extra = dict(zip(("base_failed", "kept", "char_distance", "word_distance"), fresh(df, "q_base_failed", "q_kept", "q_char_distance", "q_word_distance"), strict=True))
    name = name | extra
    n, chars, common = F.col(name["n_words"]), F.col(name["chars"]), F.col(name["common"])
    total = F.aggregate(chars, F.lit(0).cast("long"), lambda a, x: a + x)
    by_char = distance(chars, total, refs[None][0]) if None in refs else F.lit(0.0)
    by_word = F.lit(0.0)
    for lang in sorted(k for k in refs if k is not None):
        here = F.col("lang") == lang
        by_char = F.when(here, distance(chars, total, refs[lang][0])).otherwise(by_char)
        rest = F.concat(common, F.array(n - F.aggregate(common, F.lit(0).cast("long"), lambda a, x: a + x)))
        by_word = F.when(here, distance(rest, n, refs[lang][1])).otherwise(by_word)
    failed = (n < MIN_WORDS) | (100 * F.col(name["n_repeat_words"]) > 50 * n)
    df = df.withColumns({
        name["char_distance"]: F.when(total >= MIN_CHARS, by_char).otherwise(F.lit(0.0)),
        name["word_distance"]: F.when(n >= MIN_COMMON, by_word).otherwise(F.lit(0.0)),
        name["base_failed"]: failed,
    })
    fits = (F.col(name["char_distance"]) <= MAX_CHAR_DISTANCE) & (F.col(name["word_distance"]) <= MAX_WORD_DISTANCE)
    return df.withColumn(name["kept"], ~F.col(name["base_failed"]) & fits), name


def keep(docs: DataFrame) -> DataFrame:
    """Rows of docs that pass the base rules and both distances, columns unchanged.

    The texts are read twice: for the references' histograms, then for the verdicts.
    """
    refs = references(*measured(docs.select("text", "lang")))
    df, name = judged(*measured(docs), refs)
    return df.where(F.col(name["kept"]) & (F.col(name["mark"]) >= 0)).select(*(df[c] for c in docs.columns))


def op2_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, name = measured(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    df = checkpoint(df.drop("text"))  # some forty integers a document, so the texts are read once
    df, name = judged(df, name, references(df, name))
    out = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return df.select("doc_id", *(F.col(name[c]).alias(c) for c in out))


def oracle(documents: str = "documents") -> str:
    """The same verdicts in DuckDB, from words and windows as rows."""
    count = lambda kind: f"CAST(length(t) - length(regexp_replace(t, '{kind}', '', 'g')) AS BIGINT)"
    kinds = [k.replace("'", "''") for k in CLASSES]
    chars = ", ".join(f"{count(k)} AS c{i}" for i, k in enumerate(kinds))
    rest = " + ".join(f"{count(k)}" for k in kinds)
    share = lambda e, n: f"CAST(floor({e} * CAST({SCALE} AS DOUBLE) / {n}) AS BIGINT)"
    n_c = len(CLASSES) + 1
    values = ", ".join(f"('{k}', {i}, '{w}')" for k, v in COMMON_WORDS.items() for i, w in enumerate(v))
    side = lambda a, b: f"(CASE WHEN {a} > 0 THEN {a} * ln(2 * {a} / ({a} + {b})) ELSE 0 END)"
    return f"""
WITH terms(lang, k, w) AS (VALUES {values}),
docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t FROM {documents}),
base AS MATERIALIZED (
  SELECT r, doc_id, lang, length(t) AS n_chars, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls,
    {chars}, CAST(length(t) - ({rest}) AS BIGINT) AS c{n_c - 1} FROM docs),
tokens AS MATERIALIZED (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i, lang FROM base),
grams AS (SELECT r, i, w || ' ' || lead(w, 1) OVER p || ' ' || lead(w, 2) OVER p AS g FROM tokens WINDOW p AS (PARTITION BY r ORDER BY i)),
twice AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM grams WHERE g IS NOT NULL),
covered AS MATERIALIZED (SELECT r, count(DISTINCT i + d) AS n FROM twice, (VALUES (0), (1), (2)) o(d) WHERE n > 1 GROUP BY r),
common AS MATERIALIZED (SELECT r, k, count(*) AS n FROM tokens JOIN terms ON tokens.lang = terms.lang AND lower(tokens.w) = terms.w GROUP BY r, k),
counts AS MATERIALIZED (
  SELECT base.*, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars,
    len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
    len(ws) < {MIN_WORDS} OR 100 * coalesce(covered.n, 0) > 50 * len(ws) AS base_failed
  FROM base LEFT JOIN covered USING (r)),
char_rows AS MATERIALIZED (SELECT r, lang, n_chars, n_words, unnest([{', '.join(f'c{i}' for i in range(n_c))}]) AS n, unnest(range({n_c})) AS k FROM counts),
char_sums AS (SELECT lang, k, sum({share('n', 'n_chars')}) AS s FROM char_rows WHERE n_words >= {MIN_WORDS} GROUP BY lang, k),
char_refs AS MATERIALIZED (SELECT lang, k, s / sum(s) OVER (PARTITION BY lang) AS q FROM char_sums WHERE lang IN (SELECT lang FROM terms)
  UNION ALL SELECT '?', k, sum(s) / (SELECT sum(s) FROM char_sums) FROM char_sums GROUP BY k),
char_far AS (
  SELECT r, sum({side('p', 'q')} + {side('q', 'p')}) AS x FROM (
    SELECT r, n / CAST(n_chars AS DOUBLE) AS p, q FROM char_rows c JOIN char_refs f ON c.k = f.k
      AND f.lang = CASE WHEN c.lang IN (SELECT lang FROM terms) THEN c.lang ELSE '?' END
    WHERE n_chars >= {MIN_CHARS}) GROUP BY r),
word_rows AS MATERIALIZED (
  SELECT c.r, c.lang, terms.k, n_words, coalesce(common.n, 0) AS n FROM counts c JOIN terms ON c.lang = terms.lang LEFT JOIN common ON common.r = c.r AND common.k = terms.k),
word_sums AS (SELECT lang, k, sum({share('n', 'n_words')}) AS s, CAST({SCALE} AS BIGINT) * count(*) AS whole FROM word_rows WHERE n_words >= {MIN_WORDS} GROUP BY lang, k),
word_refs AS (SELECT lang, k, s / whole AS q FROM word_sums UNION ALL SELECT lang, -1, (any_value(whole) - sum(s)) / any_value(whole) FROM word_sums GROUP BY lang),
word_all AS MATERIALIZED (SELECT r, lang, k, n_words, n FROM word_rows UNION ALL SELECT r, lang, -1, n_words, n_words - sum(n) FROM word_rows GROUP BY r, lang, n_words),
word_far AS (
  SELECT r, sum({side('p', 'q')} + {side('q', 'p')}) AS x FROM (
    SELECT r, n / CAST(n_words AS DOUBLE) AS p, q FROM word_all JOIN word_refs USING (lang, k) WHERE n_words >= {MIN_COMMON}) GROUP BY r)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, c7 AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND sqrt(greatest(coalesce(char_far.x, 0) / (2 * ln(2)), 0)) <= {MAX_CHAR_DISTANCE}
    AND sqrt(greatest(coalesce(word_far.x, 0) / (2 * ln(2)), 0)) <= {MAX_WORD_DISTANCE} AS kept
FROM counts LEFT JOIN char_far USING (r) LEFT JOIN word_far USING (r)"""
