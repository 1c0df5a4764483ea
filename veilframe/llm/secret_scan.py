"""Secret scan: pattern findings and other candidates, each judged by a character network.

Base findings come from three patterns. Every run of CANDIDATE or more key characters with
a letter and a digit outside of them is a candidate too (near misses of the patterns, keys of
other formats, and a lot of harmless text). The network (a numpy convolution over a candidate's
characters and those around it, with max and mean pooling) scores every candidate, base
findings too; of a long candidate overlapping windows are scored, and the greatest score
counts. Base findings always stay, with their score; another candidate is a finding, as a whole,
if its score reaches the threshold. The network is trained on labelled findings, calibrated on
others (Platt), and the threshold is the highest that keeps RECALL of the secrets of the
calibration set. The data has no labels for secrets, so the labelled findings are generated
from known formats and their near misses, by a seed; a user with findings of their own passes
them to ``train``.

Whole texts are read once; nothing is shuffled. The model is some ten thousand numbers.

Defined results: null text counts as empty; texts without findings have the checksum
and lists of an empty string, and a null greatest score if they have no candidate either;
repeated rows get equal results; an empty table gives no rows; other columns are not read
by the query and kept by ``scanned``.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import fresh, in_arrow, table

KINDS = ("assign", "access", "hex", "learned")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A run of 16 or more: shorter runs fail, and a run is left as a whole either way.
HEX = re.compile(r"[0-9a-f]{16,}")
CANDIDATE = 12
RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{CANDIDATE},}}")
HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
BEFORE, INSIDE, AFTER = 20, 44, 8
WIDTH, FILTERS = 5, 24
RECALL = 0.98
ALPHABET = {c: i + 1 for i, c in enumerate(string.ascii_letters + string.digits + "+/_.=-:\"' @#$%&|<>()[]{}\\,;!?*")}


def base_findings(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the pattern findings, in order."""
    out = []
    low = text.lower()
    if any(h in low for h in HINTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    if any(len(w) >= 16 and HEX.search(w) for w in set(text.split())):
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Runs of key characters, with letter and digit, outside the findings taken."""
    if not any(len(w) >= CANDIDATE and any(c.isdigit() for c in w) for w in set(text.split())):
        return []
    out, spans, i = [], sorted((a, b) for a, _, b in taken), 0
    for m in RUN.finditer(text):
        a, b = m.span()
        while i < len(spans) and spans[i][1] <= a:
            i += 1
        run = m[0]
        if (i == len(spans) or spans[i][0] >= b) and any(c.isdigit() for c in run) and any(c.isalpha() for c in run):
            out.append((a, b))
    return out


def window(text: str, a: int, b: int, at: int = 0) -> list[int]:
    """Character codes: what stands before the candidate, a part of it from at on, what stands after it."""
    inside = text[a + at : min(b, a + at + INSIDE)]
    parts = ((text[max(0, a - BEFORE) : a], BEFORE, True), (inside, INSIDE, False), (text[b : b + AFTER], AFTER, False))
    out = []
    for part, n, right in parts:
        codes = [ALPHABET.get(c, len(ALPHABET) + 1) for c in part]
        pad = [0] * (n - len(codes))
        out += pad + codes if right else codes + pad
    return out


def windows(text: str, a: int, b: int) -> Iterator[list[int]]:
    """Windows over the whole candidate, each half over the next, the last up to its end."""
    for at in range(0, b - a - INSIDE, INSIDE // 2):
        yield window(text, a, b, at)
    yield window(text, a, b, max(0, b - a - INSIDE))


def labelled_findings(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Generated findings: secrets of known formats, and near misses and look-alikes that are none."""
    rng = np.random.default_rng(seed)
    pick = lambda alphabet, k: "".join(alphabet[i] for i in rng.integers(len(alphabet), size=k))
    size = lambda low, high: int(rng.integers(low, high))
    syllables = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve ung ment ción".split()
    word = lambda: "".join(syllables[i] for i in rng.integers(len(syllables), size=size(1, 5)))
    b64, alnum, hexa = string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits, "0123456789abcdef"
    date = lambda: f"20{pick('012', 1)}{pick(string.digits, 1)}-{pick('01', 1)}{pick(string.digits, 1)}-{pick('0123', 1)}{pick(string.digits, 1)}"
    keyword = lambda: str(rng.choice(["password", "passwd", "secret", "token", "api_key", "apikey", "Password", "TOKEN", "API_KEY"]))
    between = lambda: str(rng.choice(["=", ": ", " = ", ":", '": "', "='"]))
    secret = [
        lambda: pick(b64, size(24, 64)) + "=" * size(0, 3),
        lambda: pick(alnum, size(20, 48)),
        lambda: "ghp_" + pick(alnum, 36),
        lambda: "sk-" + pick(alnum, size(32, 48)),
        lambda: "xoxb-" + pick(string.digits, 12) + "-" + pick(alnum, 24),
        lambda: "AIza" + pick(alnum + "_-", 35),
        lambda: "eyJ" + pick(alnum + "_-", size(30, 60)),
        lambda: pick(hexa.upper(), int(rng.choice([32, 40, 64]))),
        lambda: "glpat-" + pick(alnum + "_-", 20),
        lambda: pick(alnum, size(14, 20)),
        lambda: keyword() + between() + pick(alnum + "+/_.-", size(12, 40)),
        lambda: keyword() + between() + word() + pick(string.digits, 3) + pick(alnum, size(8, 12)),
        lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, size(14, 19)),
        lambda: pick(hexa, size(16, 65)),
    ]
    harmless = [
        lambda: "_".join(word() for _ in range(4)) + pick(string.digits, 2),
        lambda: "-".join(word() for _ in range(5)) + "-" + pick(string.digits, 4),
        lambda: "/".join(word() for _ in range(4)) + "/" + pick(string.digits, 3),
        lambda: "".join(word().title() for _ in range(4)) + pick(string.digits, 1),
        lambda: f"{date()}T{pick('01', 1)}{pick(string.digits, 1)}-00-00Z",
        lambda: word() * 6 + pick(string.digits, 1),
        lambda: pick(string.digits, 12) + "-" + word() + "-" + pick(string.digits, 8),
        lambda: "=" * 18 + word() + pick(string.digits, 1),
        lambda: pick(alnum, 1) * size(19, 30) + pick(string.digits, 1),
        lambda: "".join(word() for _ in range(7))[:40] + pick(string.digits, 1),
        lambda: word() + "+" + word() + "+" + word() + "+" + word() + pick(string.digits, 2),
        lambda: keyword() + "=" + (word() + pick(string.digits, 3))[-size(5, 9) :],
        lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, size(8, 13)),
        lambda: pick(hexa, size(12, 16)),
        lambda: pick(string.ascii_uppercase, 2) + pick(string.digits, size(14, 24)),
        lambda: f"{word()}_{date()}",
        lambda: f"{date()}_{word()}-{word()}",
        lambda: "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12)),
        lambda: f"v{size(0, 9)}_{size(0, 20)}-{word()}-rc{size(1, 9)}",
        lambda: word() + pick(string.digits, 4) + "-" + word() + "_" + word(),
        lambda: word().upper() + "-" + pick(string.digits, 8),
        lambda: pick(string.digits, size(16, 20)),
    ]
    lead = ["key = ", "Authorization: Bearer ", "auth=", "credential: ", '"', "export KEY=", "(", "", "", ""]
    x, y = [], []
    for _ in range(n):
        is_secret = bool(rng.random() < 0.5)
        kind = secret if is_secret else harmless
        run = kind[size(0, len(kind))]().ljust(CANDIDATE, "0" if is_secret else "e")
        case = (str.lower, str.title, str.upper)[min(size(0, 5), 2) if rng.random() < 0.5 else 0]
        before = case(str(rng.choice([" ", "!! ", ", "])).join(word() for _ in range(3))) + " " + lead[size(0, len(lead))]
        text = before + run + str(rng.choice([" ", '" ', ". ", ", ", "!! ", ".\n"])) + case(word())
        x.append(window(text, len(before), len(before) + len(run)))
        y.append(float(is_secret))
    return np.array(x, dtype=np.int64), np.array(y)


class Network:
    """score = sigmoid(a * (pooled ReLU convolution . w + bias) + c)."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.kernel = rng.normal(0, 0.3, (WIDTH, len(ALPHABET) + 2, FILTERS)).astype(np.float32)
        self.kernel[:, 0] = 0
        self.shift = np.zeros(FILTERS, dtype=np.float32)
        self.dense = rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
        self.bias = np.zeros(1, dtype=np.float32)
        self.slope, self.offset, self.threshold = 1.0, 0.0, 0.5

    def forward(self, x: np.ndarray) -> tuple:
        n = x.shape[1] - WIDTH + 1
        conv = sum(self.kernel[k][x[:, k : k + n]] for k in range(WIDTH)) + self.shift
        hot = np.maximum(conv, 0)
        pooled = np.concatenate([hot.max(axis=1), hot.mean(axis=1)], axis=1)
        return conv, hot, pooled, pooled @ self.dense + self.bias[0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.concatenate([self.forward(x[i : i + 512])[3] for i in range(0, len(x), 512)]) if len(x) else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.offset, -50, 50)))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 8, batch: int = 128, rate: float = 0.01) -> None:
        rng = np.random.default_rng(5)
        params = [self.kernel, self.shift, self.dense, self.bias]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        step, n = 0, x.shape[1] - WIDTH + 1
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                xs, ys = x[order[at : at + batch]], y[order[at : at + batch]]
                conv, hot, pooled, z = self.forward(xs)
                g = ((1 / (1 + np.exp(-z)) - ys) / len(xs)).astype(np.float32)
                up = g[:, None] * self.dense
                d = np.repeat((up[:, FILTERS:] / n)[:, None, :], n, axis=1)
                top = hot.argmax(axis=1)
                np.put_along_axis(d, top[:, None, :], np.take_along_axis(d, top[:, None, :], 1) + up[:, None, :FILTERS], 1)
                d *= conv > 0
                gk = np.zeros_like(self.kernel)
                for k in range(WIDTH):
                    np.add.at(gk[k], xs[:, k : k + n].ravel(), d.reshape(-1, FILTERS))
                gk[:, 0] = 0
                grads = [gk + 1e-4 * self.kernel, d.sum(axis=(0, 1)), pooled.T @ g + 1e-4 * self.dense, np.array([g.sum()], dtype=np.float32)]
                step += 1
                for p, gr, mi, vi in zip(params, grads, m, v, strict=True):
                    mi[:] = 0.9 * mi + 0.1 * gr
                    vi[:] = 0.999 * vi + 0.001 * gr * gr
                    p -= rate * (mi / (1 - 0.9**step)) / (np.sqrt(vi / (1 - 0.999**step)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray, recall: float = RECALL) -> None:
        """Platt scaling by Newton's method, then the recall-constrained threshold."""
        z = np.concatenate([self.forward(x[i : i + 512])[3] for i in range(0, len(x), 512)])
        a, c = 1.0, 0.0
        goal = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(a * z + c, -50, 50)))
            g = np.array([((p - goal) * z).sum(), (p - goal).sum()])
            s = p * (1 - p) + 1e-9
            h = np.array([[(s * z * z).sum() + 1e-3, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-3]])
            da, dc = np.linalg.solve(h, g)
            a, c = a - np.clip(da, -1, 1), c - np.clip(dc, -1, 1)
        self.slope, self.offset = float(a), float(c)
        self.threshold = float(np.quantile(self.scores(x)[y == 1], 1 - recall, method="lower"))


def train(x: np.ndarray, y: np.ndarray, calibration: tuple[np.ndarray, np.ndarray]) -> Network:
    net = Network()
    net.fit(x, y)
    net.calibrate(*calibration)
    return net


@lru_cache(maxsize=1)
def generated_network() -> Network:
    return train(*labelled_findings(8_000, 11), labelled_findings(3_000, 12))


def judged(texts: list[str], net: Network) -> list[tuple[list[tuple[int, int, int, float]], int, float | None]]:
    """Of each text (start, kind, end, score) of all findings in order, the number of candidates, their greatest score."""
    spans, owner, some, best = [], [], [], {}

    def score() -> None:
        for o, p in zip(owner, net.scores(np.array(some)).tolist(), strict=True):
            best[o] = max(best.get(o, 0.0), p)
        owner.clear()
        some.clear()

    for i, text in enumerate(texts):
        base = base_findings(text)
        spans.append(base + [(a, 3, b) for a, b in candidates(text, base)])
        for a, k, b in spans[-1]:
            for w in windows(text, a, b):
                owner.append((i, a, k, b))
                some.append(w)
                if len(some) == 4096:
                    score()
    if some:
        score()
    out = []
    for i, own in enumerate(spans):
        all_ = [(*s, best[i, *s]) for s in own]
        out.append((sorted(s for s in all_ if s[1] < 3 or s[3] >= net.threshold), len(all_), max((s[3] for s in all_), default=None)))
    return out


def findings(texts: list[str], net: Network) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) of all findings of each text, in order."""
    return [[s[:3] for s in found] for found, _, _ in judged(texts, net)]


def scanned(docs: DataFrame, net: Network | None = None, name: str = "findings") -> DataFrame:
    """docs with an array of (kind, start, end, score), code points, end exclusive, the number
    of candidates and their greatest score."""
    (name, n_name, best_name), net = fresh(docs, name, "n_candidates", "max_score"), net or generated_network()
    at = docs.columns.index("text")
    extra = f"{name} array<struct<kind: string, start: int, end: int, score: double>>, {n_name} long, {best_name} double"
    schema = StructType([*docs.schema.fields, *StructType.fromDDL(extra).fields])
    kind, names = to_arrow_schema(schema).field(name).type, schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, made = batch.column(at), []
            for i in range(0, len(column), 256):
                made += judged([x.as_py() or "" for x in column[i : i + 256]], net)
            rows = [[{"kind": KINDS[k], "start": a, "end": b, "score": p} for a, k, b, p in s] for s, _, _ in made]
            columns = [pa.array(rows, type=kind), pa.array([n for _, n, _ in made], type=pa.int64()), pa.array([p for _, _, p in made], type=pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=names)

    return in_arrow(docs, run, schema)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scanned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    rank = lambda x: F.array_position(F.lit(list(KINDS)), x["kind"])
    shown = lambda some: F.array_join(F.transform(some, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    many = lambda k: F.size(F.filter("findings", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id",
        *(many(k) for k in KINDS),
        F.sha2(shown(F.filter("findings", lambda x: rank(x) < len(KINDS))), 256).alias("base_sha256"),
        shown(F.col("findings")).alias("spans"),
        F.array_join(F.transform("findings", lambda x: F.format_number(x["score"], 4)), ",").alias("scores"),
        "n_candidates",
        "max_score",
    )
