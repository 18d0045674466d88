"""Surrogates for personal data.

Detected entities get made-up values of their own kind and form: an address for an address, a card number that passes its check for
a card number, a name of the same gender and script for a name, letter for letter and digit for digit. A surrogate is drawn with a
secret key from the entity's canonical value, so that all mentions of an entity, in any document, get the same one. A check over all
entities of the corpus makes sure that no two share a surrogate and that no surrogate is itself an entity; who fails draws again.
"""

from __future__ import annotations

import hashlib
import hmac
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.frames import Scratch, extend, row_key
from lumenframe.llm.words import slices, trim

#: Entities that had to draw again: up to so many go to every task; beyond, they are joined to the documents that need them.
MOST_SENT = 50_000
#: After so many draws a surrogate may be longer than its entity, as its form may have no free values left: draws come to an end.
DRAWS_IN_FORM = 8

# Titles, with the gender of the person they name.
TITLES = {
    "Mr": "m", "Mr.": "m", "Sir": "m", "Herr": "m", "Herrn": "m", "Monsieur": "m", "Señor": "m", "Sr.": "m", "Господин": "m", "Κύριος": "m",
    "Mrs": "f", "Mrs.": "f", "Ms": "f", "Ms.": "f", "Miss": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Mademoiselle": "f", "Señora": "f", "Sra.": "f", "Госпожа": "f", "Κυρία": "f",
    "Dr.": "x", "Prof.": "x", "Professor": "x",
}
# Syllables and endings of made-up names, by script.
SYLLABLES = {
    "latin": (["ba", "de", "fi", "go", "ka", "le", "mi", "no", "pa", "re", "si", "to", "va", "zu", "lo", "ne"], {"m": ["n", "r", "s", "k"], "f": ["a", "ia", "ina", "elle"], "x": ["l", "t", "is", "en"]}),
    "cyrillic": (["ба", "ве", "ди", "ко", "ла", "ми", "но", "ру", "се", "та", "фо", "жу"], {"m": ["н", "р", "й", "в"], "f": ["а", "ия", "ина", "ова"], "x": ["л", "т", "ко", "ин"]}),
    "greek": (["βα", "δε", "κι", "λο", "μα", "νε", "πι", "ρο", "σα", "τε", "φι", "χο"], {"m": ["ς", "ος", "ης", "ας"], "f": ["α", "η", "ια", "ινα"], "x": ["ου", "ω", "ι", "ε"]}),
}

# Given names that are people's without a title, with their gender.
GIVEN = {
    "m": "Alexander Andreas Andrew Anthony Antonio Benjamin Carlos Charles Christian Christopher Daniel David Edward Fernando François Frank George Hans Henry Jacques James Javier Jean Johannes John José Joseph Juan Jürgen Kenneth Klaus Louis Luis Manuel Mark Markus Martin Matthew Michael Michel Miguel Nicolas Patrick Paul Pedro Peter Philippe Pierre Richard Robert Ronald Stefan Stephen Steven Thomas Timothy Walter William Wolfgang",
    "f": "Alice Amanda Ana Andrea Angela Anna Anne Barbara Birgit Brigitte Carmen Catherine Charlotte Christine Claudia Cristina Deborah Dorothy Elena Elizabeth Emily Emma Gabriele Helen Isabel Isabelle Jennifer Jessica Julia Karen Katharina Laura Linda Lisa Lucía Maria María Margaret Marie Martina Mary Monika Nancy Nathalie Olivia Patricia Petra Rebecca Renate Ruth Sabine Sandra Sarah Sophie Stephanie Susan Susanne Teresa Ursula",
}
_GENDER = {name: gender for gender, names in GIVEN.items() for name in names.split()}

_NAME = r"[^\W\d_a-zà-öø-ÿа-яα-ω][^\W\d_]+(?:[-'’][^\W\d_]+)*"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_HEX = r"[0-9A-Fa-f]{1,4}"
_CAPITAL = r"[A-ZÀ-ÖØ-Þ][\w'’-]+"
_PATTERNS = [
    ("email", re.compile(r"(?<![\w.+-])[\w+][\w.+-]*@[^\W_][\w-]*(?:\.[\w-]*[^\W_])+")),
    ("secret", re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----\s*([A-Za-z0-9+/=\s]+?)\s*-----END (?:[A-Z]+ )*PRIVATE KEY-----")),
    ("secret", re.compile(r"(?<![\w-])(eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]+)")),
    ("secret", re.compile(r"\bBearer +([\w.~+/-]{16,}=*)")),
    ("secret", re.compile(r"(?i:\b(?:password|passwd|pwd|token|secret|api[_-]?key)\b)(\s*[=:]\s*)[\"']?([^\s\"']{6,})")),
    ("secret", re.compile(r"(?<![A-Za-z0-9])((?:AKIA|ASIA)[A-Z0-9]{16})(?![A-Za-z0-9])")),
    ("secret", re.compile(r"(?<![\w-])((?:gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk-|sk_live_|rk_live_|AIza)[\w-]{16,})(?![\w-])")),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    ("ip", re.compile(rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\w|\.\d)")),
    ("ipv6", re.compile(rf"(?<![\w:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}}|(?:{_HEX}:){{2,7}}:|::(?:{_HEX}:){{1,6}}{_HEX})(?![\w:]|\.\d)")),
    ("card", re.compile(r"(?<![\w.-])(?:[2-6]\d{12,18}|[2-6]\d{3}([ -])\d{4}\1\d{4}\1\d{1,7}|3\d{3}([ -])\d{6}\2\d{5})(?![\w-]|[. ]\d)")),
    ("ssn", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")),
    ("phone", re.compile(
        r"(?<![\w.+(-])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}"  # with a country code
        r"|\(\d{2,5}\)[ .-]?\d{2,4}(?:[ .-]\d{2,4}){1,3}"  # with an area code in brackets
        r"|\d{3}([.-])\d{3}\1\d{4}"
        r"|0\d{1,4}(?:[ ./-]\d{2,8}){1,4})(?![\w-]|\.\d)"  # with a trunk zero
    )),
    ("address", re.compile(
        rf"(?<![\w.,])\d{{1,5}}[a-z]? (?:{_CAPITAL} ){{1,3}}(?:Street|St\.|Avenue|Ave\.|Road|Rd\.|Lane|Drive|Boulevard|Blvd\.|Court|Square|Terrace)(?!\w)"
        rf"|(?<!\w)[A-ZÄÖÜ][\wäöüß-]+(?:straße|strasse|str\.|gasse|allee|platz) \d{{1,4}}[a-z]?(?!\w)"
        rf"|(?<![\w.,])\d{{1,4}},? (?:rue|avenue|boulevard|place) (?:(?:de|du|des|la|le|les|l'|d') ?)*{_CAPITAL}(?: {_CAPITAL})?"
        rf"|(?<!\w)(?:[Cc]alle|[Aa]venida|[Pp]laza) (?:(?:de|del|la|las|los) )*{_CAPITAL}(?: {_CAPITAL})?,? \d{{1,4}}(?!\w)"
    )),
]
#: What a text must hold for each pattern to be worth a search: one of these.
_MARKS = [
    ("@",), ("PRIVATE KEY",), ("eyJ",), ("Bearer",), ("=", ":"), ("AKIA", "ASIA"), ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "xox", "sk-", "sk_live_", "rk_live_", "AIza"),
    ("",), (".",), (":",), ("",), ("-",), ("",),
    ("Street", "St.", "Avenue", "Ave.", "Road", "Rd.", "Lane", "Drive", "Boulevard", "Blvd.", "Court", "Square", "Terrace", "straße", "strasse", "str.", "gasse", "allee", "platz", "rue ", "avenue ", "boulevard ", "place ", "alle ", "venida ", "laza "),
]
# Words and endings of street names.
_STREETS = set("Street St Avenue Ave Road Rd Lane Drive Boulevard Blvd Court Square Terrace Calle Avenida Plaza".split())
_STREET_WORD = re.compile(r"(\d+|[A-ZÀ-ÖØ-Þ][\w'’-]*?)(straße|strasse|str|gasse|allee|platz)?(?![\w'’-])")
_WITHOUT_DIGITS = ("email", "secret", "ip", "ipv6", "address")
_TWO_DIGITS = re.compile(r"\d\d")
_PERSON = re.compile(rf"(?<!\w)({'|'.join(re.escape(t) for t in sorted(TITLES, key=len, reverse=True))}) ({_NAME}(?: {_NAME}){{0,2}})")
_NAMED = re.compile(rf"(?<!\w)(?:{'|'.join(sorted(_GENDER, key=len, reverse=True))})(?: [A-Z]\.)?(?: {_NAME}){{1,2}}")
_CAPITALISED = re.compile(r"(?<!\w)[A-Z][^\W\d_]+")
_SOME = re.compile(r"[\d@=:]|PRIVATE KEY|eyJ|Bearer")
# First digits and lengths of card numbers.
_CARD = re.compile(r"4\d{12}|4\d{15}|4\d{18}|5[1-5]\d{14}|2(?:22[1-9]|2[3-9]\d|[3-6]\d\d|7[01]\d|720)\d{12}|3[47]\d{13}|3(?:0[0-5]|[689]\d)\d{11}|35\d{14}|6(?:011|4[4-9]\d|5\d\d)\d{12}")
_DATE = re.compile(r"(?:(?:1[6-9]|2\d)\d\d[-./](?:0?[1-9]|1[0-2])[-./](?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])[-./](?:0?[1-9]|[12]\d|3[01])[-./](?:(?:1[6-9]|2\d)\d\d|\d\d))(?!\d)")
_VERSION = re.compile(r"(?i:\b(?:version|release|rev|build)|\bv)\.?[ :]*$")


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def _secret_like(assigned: str, value: str) -> bool:
    """Whether what follows a word like token is a value, and not the next word of a sentence."""
    return "=" in assigned or any(c.isdigit() for c in value) or not value.rstrip(".,;:!?)").isalpha()


def _accepted(kind: str, m: re.Match, value: str, digits: str) -> bool:
    if kind == "secret" and m.re.groups == 2:
        return _secret_like(m[1], value)
    if kind == "card":
        return _CARD.fullmatch(digits) is not None and _luhn(digits)
    if kind == "phone":
        return 8 <= len(digits) <= 15 and not _DATE.match(value.lstrip("(")) and (value[0] in "+(" or len(digits) >= 9)
    if kind == "iban":
        return _iban_ok(value)
    if kind == "ip":
        return not _VERSION.search(m.string, max(0, m.start() - 12), m.start())
    if kind == "ipv6":
        return len(digits) + sum(c in "abcdefABCDEF" for c in value) >= 4
    return True


def _luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _iban_ok(value: str) -> bool:
    value = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def script_of(name: str) -> str:
    first = ord(name[0])
    return "cyrillic" if 0x400 <= first < 0x530 else "greek" if 0x370 <= first < 0x400 else "latin"


def _words_of(at: int, rank: int, names: list[str], kinds: list[str]) -> Iterator[tuple[int, int, int, str, str]]:
    for name, kind in zip(names, kinds, strict=True):
        yield at, rank, at + len(name), kind, name.lower()
        at += len(name) + 1


def _people(text: str) -> Iterator[tuple[int, list[str], list[str]]]:
    """Names after a title, and those that begin with a listed given name: where, the words and their kinds."""
    if any(t in text for t in TITLES):
        for m in _PERSON.finditer(text):
            names = m[2].split(" ")
            yield m.start(2), names, [f"given-{TITLES[m[1]]}"] * (len(names) - 1) + ["family"]
    at = 0
    for word in _CAPITALISED.finditer(text):
        if word[0] in _GENDER and word.start() >= at and (m := _NAMED.match(text, word.start())):
            names = m[0].split(" ")
            at = m.end()
            yield m.start(), names, [f"given-{_GENDER[names[0]]}"] * (len(names) - 1) + ["family"]


def detect(text: str | None) -> list[tuple[int, int, str, str]]:
    """Entities in order, without overlaps: begin, end, kind and canonical value. A name counts word by word, the last word as a
    family name. It is found after a title, or where it begins with a listed given name and has a family name; then all mentions of
    the full name or of the family name alone, anywhere in the text, are the same entities. Dates, plain rows of numbers, versions
    and words after "token:" are no entities."""
    if not text:
        return []
    found: list[tuple[int, int, int, str, str]] = []
    if _SOME.search(text):
        two = _TWO_DIGITS.search(text) is not None
        for rank, (kind, pattern) in enumerate(_PATTERNS):
            if not any(mark in text for mark in _MARKS[rank]) or kind not in _WITHOUT_DIGITS and not two:
                continue
            for m in pattern.finditer(text):
                g = m.re.groups if kind == "secret" else 0
                value = m[g]
                digits = _digits(value)
                if not _accepted(kind, m, value, digits):
                    continue
                canonical = value
                if kind in ("card", "ssn"):
                    canonical = digits
                elif kind == "phone":
                    canonical = digits[-10:]
                elif kind == "iban":
                    canonical = value.replace(" ", "")
                elif kind in ("email", "ipv6"):
                    canonical = value.lower()
                found.append((m.start(g), rank, m.end(g), kind, canonical))
    people: dict[str, list[str]] = {}
    for at, names, kinds in _people(text):
        found += _words_of(at, 99, names, kinds)
        for k in {0, len(names) - 1}:
            for spelled in (" ".join(names[k:]), " ".join(names[k:]).upper()):
                people.setdefault(spelled, kinds[k:])
    if people:
        longest = sorted(people, key=lambda p: (-len(p), p))
        for m in re.finditer(rf"(?<!\w)(?:{'|'.join(re.escape(p) for p in longest)})(?!\w)", text):
            found += _words_of(m.start(), 100, m[0].split(" "), people[m[0]])
    out: list[tuple[int, int, str, str]] = []
    for begin, _, end, kind, canonical in sorted(found):
        if not out or begin >= out[-1][1]:
            out.append((begin, end, kind, canonical))
    return out


class _Draw:
    """An endless stream of numbers that only the key's holder can tell from chance."""

    def __init__(self, key: bytes, kind: str, canonical: str, attempt: int):
        self.seed = hmac.new(key, f"{kind}\0{canonical}\0{attempt}".encode(), hashlib.sha256).digest()
        self.count, self.pool = 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool += hashlib.sha256(self.seed + self.count.to_bytes(4, "big")).digest()
            self.count += 1
        out, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return out % n


def _in_form(text: str, draw: _Draw) -> str:
    out = []
    for c in text:
        if c.isdigit():
            out.append(str(draw.below(10)))
        elif "a" <= c <= "f" and re.fullmatch("[0-9a-f]+", text):
            out.append("0123456789abcdef"[draw.below(16)])
        elif c.isalpha() and c.isascii():
            letter = chr(97 + draw.below(26))
            out.append(letter.upper() if c.isupper() else letter)
        elif c.isalpha():
            letter = chr(0xE0 + [0, 2, 7, 8, 9, 10, 14, 20][draw.below(8)])
            out.append(letter.upper() if c.isupper() else letter)
        else:
            out.append(c)
    return "".join(out)


def surrogate(kind: str, canonical: str, key: bytes, attempt: int = 0) -> str:
    """The canonical value that stands for an entity at its attempt-th draw. Never the entity itself."""
    draw = _Draw(key, kind, canonical, attempt)
    more = "".join(str(draw.below(10)) for _ in range(max(0, attempt - DRAWS_IN_FORM + 1)))
    while True:
        if kind == "email":
            local, _, domain = canonical.rpartition("@")
            labels = domain.split(".")
            out = _in_form(local, draw) + more + "@" + ".".join([*(_in_form(x, draw) if x not in ("example", "co", "com") else x for x in labels[:-1]), labels[-1]])
        elif kind == "ip":
            a, b = canonical.split(".")[:2]
            private = a in ("10", "127") or (a, b) == ("192", "168") or a == "172" and 16 <= int(b) < 32
            head = [a, b] if private else [str([11, 23, 37, 45, 58, 66, 74, 81, 93, 104, 129, 144, 151, 163, 178, 185, 199, 207, 216][draw.below(19)]), str(draw.below(256))]
            out = ".".join([*head, str(draw.below(256)), str(1 + draw.below(254))])
        elif kind == "ipv6":
            out = "".join("0123456789abcdef"[draw.below(16)] if c in "0123456789abcdef" else c for c in canonical)
        elif kind == "address":
            out = _STREET_WORD.sub(lambda m: m[0] if m[0] in _STREETS else _in_form(m[1], draw) + (m[2] or ""), canonical) + more
        elif kind == "card":
            body = canonical[0] + "".join(str(draw.below(10)) for _ in canonical[1:-1])
            out = next(body + str(d) for d in range(10) if _luhn(body + str(d)))
        elif kind == "iban":
            body = _in_form(canonical[4:], draw)
            check = 98 - int("".join(str(int(c, 36)) for c in body + canonical[:2] + "00")) % 97
            out = f"{canonical[:2]}{check:02d}{body}"
        elif kind.startswith(("given", "family")):
            syllables, endings = SYLLABLES[script_of(canonical)]
            gender = kind[-1] if kind.startswith("given") else "x"
            out = "".join(syllables[draw.below(len(syllables))] for _ in range(2 + draw.below(2) + len(more))) + endings[gender][draw.below(4)]
        else:
            out = _in_form(canonical, draw) + more
        if out != canonical:
            return out


def render(mention: str, kind: str, value: str) -> str:
    """A surrogate in the form of a mention: its separators, its case."""
    if kind in ("card", "ssn", "phone"):
        left = list(value)
        out = []
        for c in reversed(mention):
            out.append(left.pop() if c.isdigit() and left else c)
        return "".join(reversed(out)) if not left else value
    if kind == "iban":
        parts, at = [], 0
        for c in mention:
            if c == " ":
                parts.append(c)
            else:
                parts.append(value[at : at + 1])
                at += 1
        return "".join(parts) + value[at:]
    if kind == "email" and mention.isupper():
        return value.upper()
    if kind.startswith(("given", "family")):
        return value.upper() if mention.isupper() else value[0].upper() + value[1:]
    return value


def _entity_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "__text"):
            seen = sorted({(kind, canonical) for t in part.column("__text") if t.is_valid for _, _, kind, canonical in detect(t.as_py())})
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in seen], pa.string()), pa.array([c for _, c in seen], pa.string())], names=["kind", "canonical"])


def _draw_batches(key: bytes, attempt: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, values = batch.column("kind").to_pylist(), batch.column("canonical").to_pylist()
            drawn = [surrogate(k, c, key, attempt) for k, c in zip(kinds, values, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("kind"), batch.column("canonical"), pa.array(drawn, pa.string())], names=["kind", "canonical", "surrogate"])

    return run


_DRAWN = "kind string, canonical string, surrogate string"


def assign(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """kind, canonical, surrogate and attempt for every distinct entity of the documents: surrogates of a kind are distinct, and none
    is an entity of that kind. Names of all genders are one kind in this."""
    scratch = Scratch(docs.sparkSession, "pii")
    group = F.when(F.col("kind").startswith("given") | (F.col("kind") == "family"), "name").otherwise(F.col("kind"))
    texts = docs.select(F.col(f"`{text_col}`").alias("__text"))
    entities = scratch.save(texts.mapInArrow(_entity_batches, "kind string, canonical string").distinct(), "entities", docs.count())
    real = entities.select(group.alias("group"), F.col("canonical").alias("surrogate")).distinct()
    taken, pending = None, entities
    for attempt in itertools.count():  # from DRAWS_IN_FORM on there are ten times as many values with each round
        drawn = scratch.save(pending.mapInArrow(_draw_batches(key, attempt), _DRAWN).withColumn("group", group), "drawn", pending.count())
        free = drawn.join(real, ["group", "surrogate"], "left_anti")
        if taken is not None:
            free = free.join(taken.select("group", "surrogate"), ["group", "surrogate"], "left_anti")
        first = free.groupBy("group", "surrogate").agg(F.min(F.struct("kind", "canonical")).alias("e"))
        won = scratch.save(first.select("e.kind", "e.canonical", "surrogate", "group", F.lit(attempt).alias("attempt")), "won", drawn.count())
        taken = won if taken is None else taken.union(won)
        pending = scratch.save(drawn.join(won, ["kind", "canonical"], "left_anti").select("kind", "canonical"), "pending", drawn.count())
        if pending.isEmpty():
            return taken.drop("group")


def replace(text: str | None, key: bytes, attempts: dict[tuple[str, str], int]) -> tuple[str | None, list[str]]:
    """The text with every entity replaced, and the kinds of the replaced mentions."""
    if text is None:
        return None, []
    out, at, kinds = [], 0, []
    for begin, end, kind, canonical in detect(text):
        out.append(text[at:begin])
        out.append(render(text[begin:end], kind, surrogate(kind, canonical, key, attempts.get((kind, canonical), 0))))
        kinds.append(kind)
        at = end
    return "".join([*out, text[at:]]), kinds


def _replace_batches(key: bytes, sent: dict[tuple[str, str], int], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                own = part.column("__again").to_pylist() if "__again" in part.schema.names else [None] * part.num_rows
                done = [replace(t.as_py(), key, {(a["kind"], a["canonical"]): a["attempt"] for a in o} if o else sent) for t, o in zip(part.column("__text"), own, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array([t for t, _ in done], pa.string()), pa.array([k for _, k in done], pa.list_(pa.string()))], names=[*names, "__out", "__kinds"])
        trim()

    return run


def _mention_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "__text"):
            rows = [(i, h, k, c) for i, h, t in zip(part.column("__id").to_pylist(), part.column("__hash").to_pylist(), part.column("__text"), strict=True) if t.is_valid for k, c in {(k, c) for _, _, k, c in detect(t.as_py())}]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["__id", "__hash", "kind", "canonical"])


def pseudonymise(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", most_sent: int = MOST_SENT) -> DataFrame:
    """Per row: id_col, text (entities replaced; null stays null) and kinds (of the replaced mentions, in order).

    A text without entities comes back as it is. Almost every entity keeps its first draw, which a task makes by itself; only the
    others are looked up. Rows of one id, equal rows and a null id are rows like any other; no other column is looked at.
    """
    again = Scratch(docs.sparkSession, "pii").save(assign(docs, key, text_col).where("attempt > 0").select("kind", "canonical", "attempt"), "again")
    rows = docs.select(F.col(f"`{id_col}`").alias("__k"), *row_key(id_col, text_col), F.col(f"`{text_col}`").alias("__text"))
    sent: dict[tuple[str, str], int] = {}
    if again.limit(most_sent + 1).count() <= most_sent:
        sent = {(r.kind, r.canonical): r.attempt for r in again.collect()}
    else:
        mentions = rows.select("__id", "__hash", "__text").mapInArrow(_mention_batches, "__id long, __hash long, kind string, canonical string").distinct()
        need = mentions.join(again, ["kind", "canonical"]).groupBy("__id", "__hash").agg(F.collect_list(F.struct("kind", "canonical", "attempt")).alias("__again"))
        rows = rows.join(need, ["__id", "__hash"], "left")
    rows = rows.drop("__id", "__hash")
    out = rows.mapInArrow(_replace_batches(key, sent, ["__k"]), extend(rows.select("__k").schema, "__out string, __kinds array<string>"))
    return out.withColumnsRenamed({"__k": id_col, "__out": text_col, "__kinds": "kinds"})
