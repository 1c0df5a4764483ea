"""Surrogates for personal data: keyed, of the same type, script and format.

Found entities are replaced by a keyed permutation of the values that have the same
form: x becomes the value after x on one keyed cycle through all of them. A permutation
keeps distinct values distinct over the whole corpus with no table to look up or shuffle,
the same value gets the same surrogate everywhere (coreference), and a cycle has no fixed
point, so nothing stands for itself. Where only a part of the values of a form is of the
same kind (numbers that pass their check digits or fail them, names off the lists), the
cycle is followed to the next value of that part, which is a permutation of the part again.

A card number or IBAN that passes its check gets one that passes, one that fails gets one
that fails; phone numbers keep their grouping and country code, letters their case and
script, vowels stay vowels, common consonants common ones. First names on the lists move
within the list of their gender and script. Names are found by a form of address, by a
listed first name, by words that name people beside them (met, wrote, name:), or joined by
"and" or a comma to a name found; later mentions of a name's parts in the same text follow it.

Surrogates that coincide inside a text although their originals differ (of two kinds, since
one kind cannot) are moved on along their cycle until they differ; their number is reported.

Only whole texts are read, one at a time; nothing is shuffled or collected. The key comes
from the setting ``spark.veilframe.pii.key``; without it a session makes a random one, and its
surrogates cannot be joined to those of another run.

Defined results: null text stays null, with no entities; empty text stays empty; equal
rows give equal results; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import fresh, in_arrow, table

KEY_SETTING = "spark.veilframe.pii.key"
ROUNDS = 6

# Letters of the scripts by kind, each kind closed under case.
VOWELS = ["aeiou", "аеиоуыэюя", "αεηιουω"]
CONSONANTS = ["bdfghklmnprstv", "cjqwxyz", "бвгдзклмнпрст", "жфхцчшщ", "βγδκλμνπρστ", "ζθξφχψ"]
ACCENTED = ["àáâãäåèéêëìíîïòóôõöùúûü", "ёй", "άέήίόύώ"]
LETTERS = {c: (kind, group) for kind, groups in enumerate((VOWELS, CONSONANTS, ACCENTED)) for group in groups for c in group}
# Common first names by gender and script.
FIRST_NAMES = {
    "male latin": "James John Robert Michael William David Richard Thomas Charles Daniel Matthew Anthony Mark Paul Steven Andrew George Peter Hans Karl Jürgen Klaus Wolfgang Pierre Jean Michel François Louis José Juan Carlos Luis Miguel Pedro",
    "female latin": "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Emily Emma Anna Alice Laura Julia Ingrid Ursula Monika Sabine Marie Sophie Camille Isabelle Carmen María Lucía Pilar Rosa",
    "male cyrillic": "Александр Дмитрий Сергей Андрей Алексей Иван Михаил Николай Владимир Павел",
    "female cyrillic": "Анна Елена Мария Ольга Наталья Татьяна Ирина Светлана Екатерина Юлия",
    "male greek": "Γιώργος Δημήτρης Κώστας Νίκος Γιάννης Παναγιώτης Χρήστος",
    "female greek": "Μαρία Ελένη Κατερίνα Βασιλική Σοφία Αγγελική Ιωάννα",
}
FIRST_NAMES = {k: v.split() for k, v in FIRST_NAMES.items()}
KNOWN = {name: kind for kind, names in FIRST_NAMES.items() for name in names}
# Words right before or right after the name of a person.
CUES_BEFORE = "met contact dear author patient client customer employee named called told asked thanked signed name traf rencontré conoció".split()
CUES_AFTER = "met said says wrote writes asked told replied signed joined lives lived works worked sagte schrieb traf dit écrit dijo escribió vive".split()
# Country calling codes of one and two digits; all others have three.
CALLING_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
# Forms of address before a name.
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Monsieur Madame Mme Mlle Señor Señora Sr Sra Srta Doña Господин Госпожа Κύριος Κυρία".split()

_NAME = r"\p{Lu}\p{Ll}+(?:['’-]\p{Lu}\p{Ll}+)*"
_FULL = rf"{_NAME}(?:\x20{_NAME}){{1,2}}"
PATTERNS = {
    "CREDENTIAL": regex.compile(r"(?:\b(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?(?P<v>[A-Za-z0-9+/_.=-]{12,}))|(?<![A-Za-z0-9])(?P<v>AKIA[A-Z0-9]{12,})"),
    "EMAIL": regex.compile(r"(?<![A-Za-z0-9._%+-])(?P<v>[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})"),
    "IBAN": regex.compile(r"(?<![A-Za-z0-9])(?P<v>[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])"),
    "SSN": regex.compile(r"(?<![0-9-])(?P<v>[0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])"),
    "IP": regex.compile(r"(?<![0-9.])(?P<v>(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]))(?![0-9]|\.[0-9])"),
    "PHONE": regex.compile(
        r"(?<![0-9A-Za-z])(?P<v>\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[\x20./-]?[0-9]{2,4}){1,4}|\([0-9]{3}\)\x20?[0-9]{3}[\x20.-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9])"
    ),
    "CARD": regex.compile(r"(?<![0-9])(?P<v>[0-9]{4}(?:[\x20-]?[0-9]{4}){2}[\x20-]?[0-9]{1,7}|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5})(?![0-9])"),
    "PERSON": regex.compile(rf"\b(?:(?:{'|'.join(TITLES)})\.?\x20(?P<v>{_NAME}(?:\x20{_NAME}){{0,2}})|(?P<v>(?:{'|'.join(KNOWN)})(?:\x20{_NAME}){{1,2}}))(?!\p{{L}})"),
}
#: Full names beside a cue.
CUED = regex.compile(rf"\b(?i:{'|'.join(CUES_BEFORE)})(?::\x20?|\x20)(?P<v>{_FULL})(?!\p{{L}})|\b(?P<v>{_NAME}\x20{_NAME})(?=\x20(?:{'|'.join(CUES_AFTER)})\b)")
CUES = {w + mark for w in (*CUES_BEFORE, *CUES_AFTER) for mark in ("", ":", ".", ",")}
#: A further full name, joined to one that was found.
JOINED = regex.compile(rf"(?:\x20(?:and|und|et|y|e|&)\x20|,\x20(?:and\x20)?)({_FULL})(?!\p{{L}})")
#: A cheap look for what a pattern cannot do without.
HINTS = {"EMAIL": regex.compile("@"), "PERSON": regex.compile("|".join([*TITLES, *KNOWN]))} | {k: regex.compile("[0-9]{2}") for k in ("IBAN", "SSN", "PHONE", "CARD")} | {"IP": regex.compile(r"[0-9]\.[0-9]")}


class Cipher:
    """A keyed permutation of range(n), and the one-cycle permutation made of it."""

    def __init__(self, key: bytes):
        self.key = key

    def _mix(self, tweak: bytes, half: int, value: int, bits: int) -> int:
        data = half.to_bytes(1, "big") + value.to_bytes((bits + 7) // 8 or 1, "big")
        size = min(64, (bits + 7) // 8 or 1)
        out = b"".join(hashlib.blake2b(data + i.to_bytes(2, "big"), key=self.key[:64], person=hashlib.blake2b(tweak, digest_size=16).digest(), digest_size=size).digest() for i in range((bits + 511) // 512 or 1))
        return int.from_bytes(out, "big") & ((1 << bits) - 1)

    def permute(self, x: int, n: int, tweak: bytes, back: bool = False) -> int:
        bits = max(1, ((n - 1).bit_length() + 1) // 2)
        low = (1 << bits) - 1
        while True:
            a, b = x >> bits, x & low
            if not back:
                for r in range(ROUNDS):
                    a, b = b, a ^ self._mix(tweak, r, b, bits)
            else:
                for r in reversed(range(ROUNDS)):
                    a, b = b ^ self._mix(tweak, r, a, bits), a
            x = a << bits | b
            if x < n:
                return x

    def after(self, x: int, n: int, tweak: bytes) -> int:
        """The value after x on one keyed cycle through range(n)."""
        if n < 2:
            return x
        return self.permute((self.permute(x, n, tweak) + 1) % n, n, tweak, back=True)


def luhn(digits: str) -> bool:
    total = sum(int(d) if i % 2 == 0 else (2 * int(d) - 9 if int(d) > 4 else 2 * int(d)) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def iban_check(country: str, account: str) -> str:
    """The two check digits that make an IBAN valid (remainder 1 of 97)."""
    number = "".join(str(int(c, 36)) for c in account + country + "00")
    return f"{98 - int(number) % 97:02d}"


class Surrogates:
    def __init__(self, key: bytes):
        self.cipher = Cipher(key)
        self.of = lru_cache(maxsize=50_000)(self._of)

    def letters(self, text: str, tweak: str) -> str:
        """Another text with letters for letters and digits for digits, place by place."""
        n, x, wheels = 1, 0, []
        for c in text:
            low = c.lower()
            kind = LETTERS.get(low) if len(low) == 1 else None
            wheel = "0123456789" if c in "0123456789" else kind[1] if kind and (low == c or low.upper() == c) else ""
            wheels.append(wheel)
            if wheel:
                n, x = n * len(wheel), x * len(wheel) + wheel.index(low)
        form = "".join(w[:1] or c for w, c in zip(wheels, text, strict=True))
        x = self.cipher.after(x, n, f"{tweak}|{form}".encode())
        out = []
        for c, wheel in zip(reversed(text), reversed(wheels), strict=True):
            if wheel:
                x, d = divmod(x, len(wheel))
                out.append(wheel[d].upper() if c != c.lower() else wheel[d])
            else:
                out.append(c)
        return "".join(reversed(out))

    def plain(self, text: str, kind: str) -> str:
        """letters() of the whole with a to z as one wheel; case kept."""
        n, x, wheels = 1, 0, []
        for c in text:
            wheel = "0123456789" if c in "0123456789" else "abcdefghijklmnopqrstuvwxyz" if c.isascii() and c.isalpha() else ""
            wheels.append(wheel)
            if wheel:
                n, x = n * len(wheel), x * len(wheel) + wheel.index(c.lower())
        form = "".join(w[:1] or c for w, c in zip(wheels, text, strict=True))
        x = self.cipher.after(x, n, f"{kind}|{form}".encode())
        out = []
        for c, wheel in zip(reversed(text), reversed(wheels), strict=True):
            if wheel:
                x, d = divmod(x, len(wheel))
                c = wheel[d].upper() if c.isupper() else wheel[d]
            out.append(c)
        return "".join(reversed(out))

    def digits(self, digits: str, kind: str) -> str:
        """Another number with as many digits, by its digits alone."""
        step = lambda d, k: str(self.cipher.after(int(d), 10 ** len(d), f"{k}|{len(d)}".encode())).zfill(len(d))
        if kind != "CARD":
            return step(digits, kind)
        if luhn(digits):
            head = step(digits[:-1], "CARD+")
            return head + next(c for c in "0123456789" if luhn(head + c))
        out = step(digits, "CARD-")
        while luhn(out):  # on along the cycle: still one value for each, and none twice
            out = step(out, "CARD-")
        return out

    def iban(self, value: str) -> str:
        """Country, grouping and form stay; valid check digits stay valid, invalid ones invalid."""
        plain = value.replace(" ", "")
        country, account = plain[:2], plain[4:]
        if iban_check(country, account) == plain[2:4]:
            new = self.plain(account, f"IBAN+{country}")
            new = country + iban_check(country, new) + new
        else:
            tail = self.plain(plain[2:], f"IBAN-{country}")
            while iban_check(country, tail[2:]) == tail[:2]:
                tail = self.plain(tail, f"IBAN-{country}")
            new = country + tail
        made = iter(new)
        return "".join(c if c == " " else next(made) for c in value)

    def first(self, name: str, kind: str) -> str:
        names = FIRST_NAMES[kind]
        return names[self.cipher.after(names.index(name), len(names), f"NAME|{kind}".encode())]

    def _of(self, kind: str, value: str) -> str:
        if kind in ("PHONE", "CARD", "SSN"):
            number = "".join(c for c in value if c in "0123456789")
            country = next((n for n in (1, 2) if number[:n] in CALLING_CODES), 3) if value[0] == "+" else 0  # stays
            new = iter(number[:country] + self.digits(number[country:], kind))
            return "".join(next(new) if c in "0123456789" else c for c in value)
        if kind == "IP":  # octets keep their number of digits
            spans = {1: (0, 10), 2: (10, 90), 3: (100, 156)}
            parts = value.split(".")
            n, x = 1, 0
            for p in parts:
                low, size = spans[len(p)]
                n, x = n * size, x * size + int(p) - low
            x = self.cipher.after(x, n, f"IP|{[len(p) for p in parts]}".encode())
            out = []
            for p in reversed(parts):
                low, size = spans[len(p)]
                x, d = divmod(x, size)
                out.append(str(low + d))
            return ".".join(reversed(out))
        if kind == "EMAIL":  # the top-level domain stays
            head, _, top = value.rpartition(".")
            return f"{self.plain(head, 'EMAIL')}.{top}"
        if kind == "IBAN":
            return self.iban(value)
        if kind == "CREDENTIAL":
            if regex.fullmatch("[0-9a-f]+", value):
                size = 16 ** len(value)
                return f"{self.cipher.after(int(value, 16), size, f'HEX|{len(value)}'.encode()):x}".zfill(len(value))
            return ("AKIA" + self.plain(value[4:], "AKIA")) if value.startswith("AKIA") else self.plain(value, "CREDENTIAL")
        return " ".join(self.name(p) for p in value.split(" "))

    def name(self, part: str) -> str:
        if part in KNOWN:
            return self.first(part, KNOWN[part])
        out = self.letters(part, "SURNAME")
        while out in KNOWN:  # listed names are for listed names
            out = self.letters(out, "SURNAME")
        return out


def find(text: str) -> list[tuple[int, int, str]]:
    """start, end, kind of the entities, no two overlapping; the first and longest win."""
    found = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        if kind in HINTS and not HINTS[kind].search(text):
            continue
        found += [(*m.span("v"), rank, kind) for m in pattern.finditer(text)]
    if not CUES.isdisjoint(text.lower().split()):
        found += [(*m.span("v"), len(PATTERNS) - 1, "PERSON") for m in CUED.finditer(text)]
    found = _disjoint(found)
    todo = [s for s in found if s[3] == "PERSON"]
    while todo:  # "... and Ann Lee", from name to name
        more = [(*m.span(1), len(PATTERNS) - 1, "PERSON") for s in todo if (m := JOINED.match(text, s[1]))]
        before, found = found, _disjoint(found + more, keep=found)
        todo = [s for s in more if s in found and s not in before]
    parts = {p for a, b, _, kind in found if kind == "PERSON" for p in text[a:b].split(" ") if len(p) > 2}
    if parts:  # later mentions by one part of the name
        again = regex.compile(rf"(?<!\p{{L}})(?:{'|'.join(map(regex.escape, sorted(parts)))})(?!\p{{L}})")
        found = _disjoint(found + [(*m.span(), len(PATTERNS), "PERSON") for m in again.finditer(text)], keep=found)
    return [(a, b, kind) for a, b, _, kind in found]


def _disjoint(spans: list, keep: list = ()) -> list:
    sure, out, end = set(keep), [], 0
    for s in sorted(set(spans), key=lambda s: (s[0], s not in sure, -s[1], s[2])):
        if s[0] >= end:
            out.append(s)
            end = s[1]
    return out


def replaced(text: str, by: Surrogates) -> tuple[str, list[tuple[int, int, str]], int]:
    """Text with surrogates, the spans found, and how many surrogates coincided and were moved on."""
    spans = find(text)
    out, at, seen, taken, moved = [], 0, {}, {}, 0
    for a, b, kind in spans:
        value = text[a:b]
        if (kind, value) not in seen:
            new = by.of(kind, value)
            while taken.get(new, value) != value:
                new, moved = by.of(kind, new), moved + 1
            seen[kind, value] = new
            taken[new] = value
        out += [text[at:a], seen[kind, value]]
        at = b
    return "".join([*out, text[at:]]), spans, moved


def key_of(spark: SparkSession) -> bytes:
    """The key of KEY_SETTING, or a random one that the session keeps."""
    given = spark.conf.get(KEY_SETTING, None) or spark.sparkContext.getConf().get(KEY_SETTING, None)
    if not given:
        given = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, given)
    return given.encode()


def pseudonymised(docs: DataFrame, key: bytes, text: str = "text", entities: str = "entities", clashes: str = "clashes") -> DataFrame:
    """docs with text replaced, and columns for the spans found and the number of clashes mended.

    entities: array of (kind, start, end) in the original text, code points; the
    original values are nowhere in the result.
    """
    at = docs.columns.index(text)
    entities, clashes = fresh(docs, entities, clashes)
    schema = StructType([*docs.schema.fields, *StructType.fromDDL(f"{entities} array<struct<kind: string, start: int, end: int>>, {clashes} int").fields])
    kinds = [f.type for f in to_arrow_schema(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = Surrogates(key)
        for batch in batches:
            texts, spans, counts = [], [], []
            for x in batch.column(at):
                new, found, n = (None, [], 0) if not x.is_valid else replaced(x.as_py(), by)
                texts.append(new)
                spans.append([{"kind": k, "start": a, "end": b} for a, b, k in found])
                counts.append(n)
            columns = list(batch.columns)
            columns[at] = pa.array(texts, type=kinds[at])
            columns += [pa.array(spans, type=kinds[-2]), pa.array(counts, type=kinds[-1])]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return in_arrow(docs, run, schema)


def clean(docs: DataFrame, key: bytes) -> DataFrame:
    """docs with surrogates in text; n_chars, where it exists, follows the text."""
    out = pseudonymised(docs, key).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), key_of(spark))
    return df.select("doc_id", "text", F.size("entities").cast("long").alias("n_entities"), "entities", "clashes")
