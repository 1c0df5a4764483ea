"""Toxicity by a counterfactual-regularised logistic classifier.

The classifier reads which distinct words a text has, and which words stand right before
and after each mention of a group ("muslims|scum"). It is fitted on the driver on a bounded
sample of labelled rows (SAMPLE, by a hash of the id) with terms chosen by their association
with the label. Of every sentence of these rows that names a group a counterfactual is
made by swapping each identity term for another of its kind (for rows that name none,
one sentence gets a mention). The squared change of the sentence's score (0 to 1, all its
features counted) is added to the loss, so that naming one group or another does not move
a score; what a sentence says beside a mention decides how much the mention could.

Scoring reads whole texts in one pass with no shuffle; the model is a few thousand
weights. Labels are learned only from rows with crc32(doc_id as text) mod 5 not 0.

Defined results: null and empty texts get the score of no words; unlabelled rows are
scored alike; a null id counts as held out; without any usable labels every score is
that of a prior of one half less one step (0.25) and nothing is toxic; repeated rows get
equal scores; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, in_arrow, split_words, table

#: Labelled rows that the fit may use at most; all of them if there are fewer.
SAMPLE = 6_000
MAX_TERMS = 3_000
MIN_DOCS = 4
RIDGE, COUNTERFACTUAL, STEPS = 2.0, 16.0, 250
SENTENCE = re.compile(r"[^.!?\n]+")
EDGE = ".,;:!?\"'()[]{}<>*#$%&|_-+=~`“”‘’«»¡¿…"
# Terms that name groups, by kind and language.
IDENTITY_TERMS = [
    "women men girls boys transgender nonbinary".split(),
    "muslims christians jews hindus buddhists atheists".split(),
    "muslim christian jewish hindu buddhist atheist".split(),
    "black white asian latino african european".split(),
    "gay lesbian straight bisexual queer".split(),
    "immigrants refugees foreigners natives citizens".split(),
    "disabled blind deaf elderly young".split(),
    "femmes hommes musulmans chrétiens juifs immigrés".split(),
    "frauen männer muslime christen juden ausländer".split(),
    "mujeres hombres musulmanes cristianos judíos inmigrantes".split(),
]
GROUP = {t: i for i, ts in enumerate(IDENTITY_TERMS) for t in ts}


def terms(text: str | None) -> set[str]:
    """Distinct words in lower case without punctuation at their ends."""
    return {w.strip(EDGE) for w in set(split_words((text or "").lower()))} - {""}


def ordered_terms(text: str) -> list[str]:
    return [t for w in split_words(text.lower()) if (t := w.strip(EDGE))]


def neighbours(words: list[str]) -> set[str]:
    """An identity term with the word before or after it."""
    out = set()
    for i, w in enumerate(words):
        if w in GROUP:
            out |= {f"{w}|{words[j]}" for j in (i - 1, i + 1) if 0 <= j < len(words)}
    return out


def features(text: str | None) -> set[str]:
    """Terms, and for texts that name a group its neighbours."""
    found = terms(text)
    return found if found.isdisjoint(GROUP) else found | neighbours(ordered_terms(text))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def chosen_terms(docs: list[np.ndarray], names: list[str], labels: np.ndarray) -> list[str]:
    """Terms by their chi-square with the label, identity terms first.

    docs hold places in names. Of M terms some look telling by chance; those below
    2 ln M are left out.
    """
    n1, n = float(labels.sum()), float(len(labels))
    whole = np.bincount(np.concatenate(docs), minlength=len(names))
    toxic = np.bincount(np.concatenate([d for d, y in zip(docs, labels, strict=True) if y] or [np.zeros(0, int)]), minlength=len(names))
    common = np.nonzero(whole >= MIN_DOCS)[0]
    expected = whole[common] * n1 / n
    square = (toxic[common] - expected) ** 2 / (expected * (1 - n1 / n))
    telling = sorted((-x, names[i]) for x, i in zip(square, common, strict=True) if x > 2 * np.log(len(common)) and names[i] not in GROUP)
    return [*GROUP, *(w for _, w in telling[: MAX_TERMS - len(GROUP)])]


def counterfactual_pairs(texts: list[str], rng: np.random.Generator) -> list[tuple[set[str], set[str]]]:
    """Features of sentences and of their counterfactuals: every sentence that names a group,
    with each mention swapped for another of its kind; of a text without any, one sentence
    with a mention at a random place, swapped likewise."""
    out = []

    def other(t: str) -> str:
        kind = [x for x in IDENTITY_TERMS[GROUP[t]] if x != t]
        return kind[int(rng.integers(len(kind)))]

    for text in texts:
        sentences = [ordered_terms(x) for x in SENTENCE.findall(text)]
        named = [x for x in sentences if not GROUP.keys().isdisjoint(x)]
        if not named and (said := [x for x in sentences if x]):
            one = said[int(rng.integers(len(said)))]
            kind = IDENTITY_TERMS[int(rng.integers(len(IDENTITY_TERMS)))]
            at = int(rng.integers(len(one) + 1))
            named = [[*one[:at], kind[int(rng.integers(len(kind)))], *one[at:]]]
            out.append((set(one), set(named[0]) | neighbours(named[0])))  # nor does a mention as such
        for words in named:
            swapped = [other(w) if w in GROUP else w for w in words]
            out.append((set(words) | neighbours(words), set(swapped) | neighbours(swapped)))
    return out


def fit(rows: list[tuple[str, int]]) -> dict[str, float]:
    """Weights by feature; the bias is under the empty string."""
    labels = np.array([y for _, y in rows], dtype=float)
    if not len(rows) or labels.min() == labels.max():
        return {"": -1.0986122886681098}
    places: dict[str, int] = {}
    docs = []
    for text, _ in rows:
        docs.append(np.array(sorted(places.setdefault(w, len(places)) for w in sorted(features(text))), dtype=np.int64))
    names = chosen_terms(docs, list(places), labels)
    at = {w: i for i, w in enumerate(names)}
    pairs = counterfactual_pairs([text for text, _ in rows], np.random.default_rng(7))
    column = np.full(len(places), -1)
    for w, i in places.items():
        column[i] = at.get(w, -1)
    row = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    col = column[np.concatenate(docs)]
    row, col = row[col >= 0], col[col >= 0]

    def matrix(sets: list[set[str]]) -> tuple[np.ndarray, np.ndarray]:
        cells = [(i, at[w]) for i, words in enumerate(sets) for w in sorted(words) if w in at]
        return np.array([r for r, _ in cells], dtype=np.int64), np.array([c for _, c in cells], dtype=np.int64)

    def score(z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))

    sides = [matrix([p[k] for p in pairs]) for k in (0, 1)]
    w, bias = np.zeros(len(names)), float(np.log(labels.mean() / (1 - labels.mean())))
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean())) / len(labels)
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, STEPS + 1):  # Adam, all rows in each step
        g = (score(np.bincount(row, w[col], len(docs)) + bias) - labels) * weight
        gw = np.bincount(col, g[row], len(names)) + RIDGE / len(labels) * w * 0.5
        gb = g.sum()
        p, q = (score(np.bincount(r, w[c], len(pairs)) + bias) for r, c in sides)
        change = COUNTERFACTUAL * 2 * (p - q) / max(1, len(pairs))
        for (r, c), s, sign in ((sides[0], p, 1), (sides[1], q, -1)):
            gs = sign * change * s * (1 - s)
            gw += np.bincount(c, gs[r], len(names))
            gb += gs.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        rate = 0.1 / (1 + 3 * step / STEPS)
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        bias -= rate * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.99**step)) + 1e-8)
    return {"": bias} | {t: float(x) for t, x in zip(names, w, strict=True) if abs(x) > 1e-6}


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = SAMPLE) -> list[tuple[str, int]]:
    """Texts and labels of at most `most` rows that may be learned from, by hash of id."""
    usable = labels.where(~held_out(F.col("doc_id")) & F.col(label).isNotNull())
    picked = usable.groupBy("doc_id").agg(F.max(label).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").where(F.col("text").isNotNull())
    one = texts.groupBy("doc_id", "y").agg(F.min("text").alias("text"))  # an id may repeat
    return sorted((r.text, r.y) for r in one.collect())


def scored(docs: DataFrame, weights: dict[str, float], name: str = "score") -> DataFrame:
    """docs with a score for text (0 to 1) as a further column."""
    name = fresh(docs, name)[0]
    bias, known = weights.get("", 0.0), {t: w for t, w in weights.items() if t}
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A word as it stands to its term; words are far fewer than their occurrences.
        kept: dict[str, str] = {}
        for batch in batches:
            z = []
            for x in batch.column(at):
                found = set()
                for word in set(split_words((x.as_py() or "").lower())):
                    term = kept.get(word)
                    if term is None:
                        term = word.strip(EDGE)
                        term = term if term in known or term in GROUP else ""
                        if len(kept) >= 200_000:
                            kept.clear()
                        kept[word] = term
                    if term:
                        found.add(term)
                if not found.isdisjoint(GROUP):
                    found |= {f for f in neighbours(ordered_terms(x.as_py())) if f in known}
                z.append(bias + sum(known.get(t, 0.0) for t in sorted(found)))
            p = 1 / (1 + np.exp(-np.clip(np.array(z, dtype=float), -50, 50)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], names=[*batch.schema.names, name])

    return in_arrow(docs, run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), f"{name} double"]))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights = fit(labelled_sample(docs, table(spark, sf_dir, "labels")))
    out = scored(docs.select("doc_id", "text"), weights)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
