"""Surrogates for personal data.

Entities: e-mail addresses, IPv4 addresses, phone and card numbers, social security numbers, bank accounts (IBAN),
secrets after a key word, long hexadecimal keys, and persons' names after a title. Each is replaced by a surrogate drawn from a
keyed hash (HMAC-SHA256) of its type and normal form, so an entity has one surrogate in all documents (coreference). It
keeps the format: separators, lengths, letter case, the script of letters and digits, the gender of a name, valid Luhn and IBAN check
digits where there were. Numbers, and the letters and digits of addresses, accounts and secrets, go through a keyed Feistel permutation of all
values of their shape, so different entities stay different by construction; names are drawn, the surname from the surname alone and the
given name from gender and given name, so "Mr Smith" or "Dr Smith" has the surname that "Mr John Smith" has. Collisions are checked over
the whole corpus: an entity whose surrogate is another's, or is an entity that occurs itself, is drawn again until none is. Names get longer
with each attempt, and what is still not settled at the attempt GROWN is drawn longer than its shape. A surname alone, anywhere else in the
same document, becomes the surname of its surrogate. A secret without letters or digits, such as a row of asterisks, is no entity.
Decimal digits of any script are digits: a number has one surrogate however it is written, in the digits of the mention.

Null and empty texts stay as they are; repeated rows get the same text; very long texts and values cost time in proportion to their
length; of mentions that overlap the one of the earlier type in PATTERNS counts, of one type the first; all columns pass through, whatever
their names; an empty table gives no rows. n_chars, where the table has it, becomes the new text's.
"""

from __future__ import annotations

import hashlib
import hmac
import math
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatehouse.llm import common

#: From the attempt GROWN on, a surrogate is drawn with more characters than its value, one more with each attempt, so a full shape can't block it.
KEY, GROWN = b"surrogates-1", 4
#: So many entities that need another draw are handed to every task; more are joined to their documents.
HANDED = 10_000

_DIGITS = "0123456789"
_LOWER, _HEX = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"
# Titles by gender, and given names by script and gender, from which surrogates are drawn.
TITLES = {
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа", "Κυρία"),
    "m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος"),
    "n": ("Dr", "Prof"),
}
GIVEN = {
    ("latin", "f"): ("Anna", "Clara", "Emma", "Julia", "Laura", "Maria", "Nora", "Paula", "Rosa", "Sofia", "Teresa", "Vera"),
    ("latin", "m"): ("Adrian", "Bruno", "Carl", "David", "Felix", "Hugo", "Leon", "Martin", "Oscar", "Paul", "Simon", "Victor"),
    ("latin", "n"): ("Alex", "Andrea", "Charlie", "Dominique", "Kim", "Robin", "Sascha", "Toni"),
    ("cyrillic", "f"): ("Анна", "Вера", "Елена", "Ирина", "Мария", "Нина", "Ольга", "Софья"),
    ("cyrillic", "m"): ("Антон", "Борис", "Иван", "Максим", "Николай", "Олег", "Павел", "Юрий"),
    ("cyrillic", "n"): ("Саша", "Женя", "Валя", "Слава"),
    ("greek", "f"): ("Άννα", "Ελένη", "Μαρία", "Σοφία"),
    ("greek", "m"): ("Γιώργος", "Νίκος", "Παύλος", "Πέτρος"),
    ("greek", "n"): ("Αλέξης", "Φώτης"),
}
SYLLABLES = {
    "latin": ("ba", "den", "fer", "gor", "hal", "kin", "lar", "men", "nor", "pel", "ros", "sten", "tam", "vel", "wen", "zar"),
    "cyrillic": ("ба", "вер", "гор", "дан", "кар", "лен", "мар", "нов", "пет", "рос", "сер", "тин"),
    "greek": ("βα", "γιο", "δη", "κα", "λα", "μα", "νι", "πα", "ρο", "στα", "τσι", "φα"),
}
PARTICLES = ("van", "von", "de", "del", "la", "le")

_NAME = r"[^\W\d_a-z][^\W\d_]+"
_titles = "|".join(sorted((t for ts in TITLES.values() for t in ts), key=len, reverse=True))
#: Cheap test -> pattern. In a text earlier types win over later ones that overlap.
PATTERNS: list[tuple[str, Callable[[str], bool], re.Pattern]] = [
    ("email", lambda t: "@" in t, re.compile(r"[A-Za-z0-9][\w.+\-]*@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+")),
    ("secret", lambda t: "=" in t or ":" in t, re.compile(r"(?i)\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\b[\"']?\s*[:=]\s*[\"']?(?P<v>[^\s\"']{6,})")),
    ("ip", lambda t: "." in t, re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\d]|\.\d)")),
    ("iban", lambda t: True, re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b")),
    ("ssn", lambda t: "-" in t, re.compile(r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])")),
    ("card", lambda t: True, re.compile(r"(?<![\d\-])(?:\d{13,19}|\d{4}(?:[ \-]\d{4}){2}[ \-]\d{1,7})(?![\d\-])")),
    ("phone", lambda t: True, re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,4}\)[ .\-]?|\d{2,4}[ .\-])\d{3,4}(?:[ .\-]\d{2,4}){1,3}(?![\w\-])|(?<![\w+])\+\d{1,3}(?:[ .\-]\(?\d{1,8}\)?){2,5}(?!\w)|(?<![\w+])\+\d{8,14}(?!\w)")),
    ("key", lambda t: True, re.compile(r"(?<![0-9a-zA-Z])(?=[0-9a-fA-F]*\d)(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![0-9a-zA-Z])")),
    ("name", lambda t: any(x in t for xs in TITLES.values() for x in xs), re.compile(rf"\b(?:{_titles})\b\.?\s+(?P<v>{_NAME}(?:[ \t]+(?:(?:{'|'.join(PARTICLES)})[ \t]+)*{_NAME})?)")),
]
_WORD = re.compile(r"\w+")
_SOME_DIGITS = re.compile(r"\d\D{0,2}\d\D{0,2}\d|@|[0-9a-fA-F]{32}")
_BY_TITLE = {t: g for g, ts in TITLES.items() for t in ts}


def _draw(key: bytes, kind: str, value: str, attempt: int, size: int) -> bytes:
    out, n = b"", 0
    while len(out) < size:
        out += hmac.new(key, f"{kind}\0{value}\0{attempt}\0{n}".encode("utf-8", "surrogatepass"), hashlib.sha256).digest()
        n += 1
    return out[:size]


def permute(key: bytes, kind: str, number: int, size: int) -> int:
    """A keyed permutation of 0 .. size - 1: eight Feistel rounds over the next square, walked until the result is below size."""
    side = math.isqrt(size - 1) + 1
    while True:
        left, right = divmod(number, side)
        for r in range(8):
            f = int.from_bytes(hmac.new(key, f"{kind}\0{size}\0{r}\0{right}".encode(), hashlib.sha256).digest(), "big")
            left, right = right, (left + f) % side
        number = left * side + right
        if number < size:
            return number


def _digits(text: str) -> str:
    """The decimal digits of a text, of any script, in ASCII."""
    return "".join(str(unicodedata.decimal(c)) for c in text if c.isdecimal())


def _written(like: str, digit: str) -> str:
    """An ASCII digit in the script of another one."""
    return digit if like.isascii() else chr(ord(like) - unicodedata.decimal(like) + int(digit))


def _fill(like: str, digits: str) -> str:
    """`like` with its digits replaced in order, each in its script; digits beyond its own follow its last one."""
    it = iter(digits)
    out = [_written(c, next(it)) if c.isdecimal() else c for c in like]
    last = max(i for i, c in enumerate(like) if c.isdecimal())
    return "".join([*out[: last + 1], *(_written(like[last], d) for d in it), *out[last + 1 :]])


def _luhn(digits: str) -> int:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 if k % 2 else 2)
        total += n - 9 if n > 9 else n
    return -total % 10


def _numbers(key: bytes, kind: str, digits: str) -> str:
    """Another number of as many digits; card numbers with a valid check digit get a valid one."""
    if kind == "card" and int(digits[-1]) == _luhn(digits[:-1]):
        body = _numbers(key, "card-body", digits[:-1])
        return body + str(_luhn(body))
    return str(permute(key, f"{kind}{len(digits)}", int(digits), 10 ** len(digits))).zfill(len(digits))


def _longer(key: bytes, kind: str, value: str, attempt: int, size: int, pool: str) -> str:
    """Characters of the pool drawn for a value from the attempt GROWN on: more than size, one more with each attempt."""
    return "".join(pool[b % len(pool)] for b in _draw(key, kind, value, attempt, size + attempt - GROWN + 1))


def _kind(c: str) -> tuple[int, str, str]:
    """What a character shares with those that may stand for it: 256 neighbours, category, and the script its name begins with."""
    return ord(c) >> 8, unicodedata.category(c), unicodedata.name(c, "").partition(" ")[0]


@cache
def _block(kind: tuple[int, str, str]) -> str:
    """The characters beyond ASCII of a kind."""
    return "".join(c for c in map(chr, range(max(128, kind[0] << 8), (kind[0] + 1) << 8)) if _kind(c) == kind)


def _pool(c: str) -> tuple[str, str]:
    """The characters that may stand for c, c among them, and their name. Others than letters and digits stay."""
    if not c.isalnum():
        return c, c
    if c.isascii():
        return (_DIGITS, "9") if c in _DIGITS else (_LOWER, "a") if c in _LOWER else (_LOWER.upper(), "A")
    kind = _kind(c)
    return _block(kind), f"{{{kind}}}"


def _alike(key: bytes, kind: str, text: str, attempt: int) -> str:
    """Other characters of the same classes, by a permutation of all strings of that shape: hexadecimal stays so, letters keep script and case.

    Eight Feistel rounds over the two halves, each character moved within its own pool: linear in the length.
    """
    if attempt >= GROWN and any(map(str.isalnum, text)):
        return _longer(key, kind, text, attempt, len(text), _LOWER)
    if len(text) >= 8 and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text) and not text.isdecimal():
        pools = [(_HEX.upper(), "F") if text.isupper() else (_HEX, "f")] * len(text)
    else:
        pools = [_pool(c) for c in text]
    shape = hashlib.sha256("".join(name for _, name in pools).encode()).hexdigest()
    sizes = [len(pool) for pool, _ in pools]
    places = [pool.index(c) for c, (pool, _) in zip(text, pools, strict=True)]
    half = len(places) // 2
    parts, widths = [places[:half], places[half:]], [sizes[:half], sizes[half:]]
    for r in range(8):
        fixed, moved = parts[r % 2], 1 - r % 2
        seed = hmac.new(key, f"{kind}/{shape}/{attempt}/{r}/{fixed}".encode(), hashlib.sha256).digest()
        stream = hashlib.shake_256(seed).digest(4 * len(parts[moved]))
        parts[moved] = [(x + int.from_bytes(stream[4 * k : 4 * k + 4], "big")) % n for k, (x, n) in enumerate(zip(parts[moved], widths[moved], strict=True))]
    return "".join(pool[x] for x, (pool, _) in zip([*parts[0], *parts[1]], pools, strict=True))


def _account(key: bytes, value: str, attempt: int) -> str:
    """Another account of the same country and shape; as far as its check digits are from the valid ones, so are the new ones."""
    off = (int(value[2:4]) - _iban_check(value[:2], value[4:])) % 100
    body = _alike(key, f"iban{value[:2]}", value[4:], attempt).upper()
    return f"{value[:2]}{(_iban_check(value[:2], body) + off) % 100:02d}{body}"


def _iban_check(country: str, body: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in f"{body}{country}00".upper())) % 97


def script(name: str) -> str:
    c = ord(name[0])
    return "cyrillic" if 0x400 <= c < 0x530 else "greek" if 0x370 <= c < 0x400 or 0x1F00 <= c < 0x2000 else "latin"


def _surname(key: bytes, value: str, attempt: int) -> str:
    """A made-up surname of the same script, from the surname alone."""
    syllables = SYLLABLES[script(value)]
    return "".join(syllables[b % len(syllables)] for b in _draw(key, "surname", value, attempt, 3 + attempt)).capitalize()


def _given(key: bytes, value: str, attempt: int) -> str:
    """value: gender and given name. A given name of the same gender and script; one more is joined to it with each attempt."""
    gender, name = value.split(":", 1)
    pool = GIVEN[script(name), gender]
    return "".join(pool[b % len(pool)] for b in _draw(key, "given", value, attempt, 1 + attempt)).capitalize()


def _parts(value: str) -> list[tuple[str, str]]:
    """The entities that a name is made of: its surname and, where it has one, its given name with the gender."""
    gender, name = value.split(":", 1)
    words = name.split()
    return [("surname", words[-1])] + ([("given", f"{gender}:{words[0]}")] if len(words) > 1 else [])


def _person(key: bytes, value: str, attempts: dict[tuple[str, str], int]) -> str:
    """value: gender and name. Surname and given name each have their surrogate; a single name is a surname."""
    made = [surrogate(k, v, attempts.get((k, v), 0), key) for k, v in _parts(value)]
    return " ".join([*made[1:], *[p for p in value.split(":", 1)[1].split()[1:-1] if p in PARTICLES], made[0]])


def _lower(c: str) -> str:
    """One character for one, so that places in an address stay."""
    low = c.lower()
    return low if len(low) == 1 else c


def normal(kind: str, value: str, title: str = "") -> str:
    """An entity's normal form: what makes two mentions one entity."""
    if kind in ("card", "phone", "ssn"):
        country = re.match(r"\+(\d{1,3})[ .\-(]", value) if kind == "phone" else None
        digits = _digits(value)
        return f"{digits[: len(country[1])]}+{digits[len(country[1]) :]}" if country else digits
    if kind == "email":
        return "".join(map(_lower, value))
    if kind in ("ip", "iban"):
        return "".join(_digits(c) or c for c in value if c != " ")
    if kind == "name":
        return f"{_BY_TITLE[title]}:{' '.join(value.split())}"
    return value


def surrogate(kind: str, value: str, attempt: int = 0, key: bytes = KEY) -> str:
    """The surrogate of a normal form, in normal form. A phone number keeps its country code."""
    if kind == "phone" and "+" in value:
        country, rest = value.split("+")
        return f"{country}+{_longer(key, kind, value, attempt, len(rest), _DIGITS) if attempt >= GROWN else _numbers(key, f'phone{country}/{attempt}', rest)}"
    if kind in ("card", "phone", "ssn"):
        if attempt >= GROWN:
            return _longer(key, kind, value, attempt, len(value), _DIGITS)
        return _numbers(key, f"{kind}{attempt or ''}" if kind != "card" or attempt else "card", value)
    if kind == "ip":
        n = permute(key, f"ip{attempt or ''}", int.from_bytes(bytes(map(int, value.split("."))), "big"), 1 << 32)
        return ".".join(map(str, n.to_bytes(4, "big")))
    if kind == "email":
        local, domain = value.rsplit("@", 1)
        host, _, end = domain.rpartition(".")
        return f"{_alike(key, 'email', local, attempt)}@{_alike(key, 'domain', host, 0)}.{end}"
    if kind == "iban":
        return _account(key, value, attempt)
    if kind == "name":
        return _person(key, value, dict.fromkeys(_parts(value), attempt))
    if kind == "surname":
        return _surname(key, value, attempt)
    if kind == "given":
        return _given(key, value, attempt)
    return _alike(key, kind, value, attempt)


def _dress(kind: str, mention: str, made: str) -> str:
    """The surrogate in the mention's own format."""
    if kind in ("card", "phone", "ssn"):
        return _fill(mention, made.replace("+", ""))
    if kind == "ip":
        first = mention[0]
        return "".join(c if c == "." else _written(first, c) for c in made)
    if kind == "iban":
        it, out = iter(made), []
        for c in mention:
            x = c if c == " " else next(it)
            out.append(_written(c, x) if c.isdecimal() and x.isdecimal() else x)
        return "".join([*out, *it])
    if kind == "email":
        if len(mention) != len(made):
            return made
        return "".join(up if c.isupper() and len(up := m.upper()) == 1 else m for c, m in zip(mention, made, strict=True))
    return made


def find(text: str) -> list[tuple[int, int, str, str]]:
    """Spans of entities in order: start, end, type and normal form, without overlaps."""
    out: list[tuple[int, int, str, str]] = []
    numbers = _SOME_DIGITS.search(text) is not None
    for kind, maybe, pattern in PATTERNS:
        if (kind not in ("name", "secret") and not numbers and "@" not in text) or not maybe(text):
            continue
        new = []
        for m in pattern.finditer(text):
            a, b = m.span("v") if kind in ("secret", "name") else m.span()
            if kind == "secret" and not any(map(str.isalnum, m["v"])):
                continue
            at = bisect_left(out, (a,))  # spans of earlier types are disjoint and sorted, so two neighbours tell
            if (at == len(out) or b <= out[at][0]) and (at == 0 or out[at - 1][1] <= a):
                title = re.match(r"\w+", m[0])[0] if kind == "name" else ""
                new.append((a, b, kind, normal(kind, text[a:b], title)))
        if new:
            out = sorted([*out, *new])
    return _one_gender(out)


def _one_gender(spans: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """Spans where a name after a title without gender has the gender that the same full name has elsewhere in the text, if it is only one."""
    genders: dict[str, set[str]] = {}
    for _, _, kind, value in spans:
        if kind == "name" and value[0] != "n":
            genders.setdefault(value[2:], set()).add(value[0])
    return [(a, b, k, min(genders[v[2:]]) + v[1:] if k == "name" and v[0] == "n" and len(genders.get(v[2:], ())) == 1 else v) for a, b, k, v in spans]


def replace(text: str, attempts: dict[tuple[str, str], int] | None = None, key: bytes = KEY) -> tuple[str, int]:
    """The text with surrogates, and the number of replaced mentions."""
    spans = find(text)
    if not spans:
        return text, 0
    made, surnames, count = [], {}, len(spans)
    for a, b, kind, value in spans:
        made.append(_person(key, value, attempts or {}) if kind == "name" else surrogate(kind, value, (attempts or {}).get((kind, value), 0), key))
        if kind == "name":
            surnames[value.split()[-1].split(":")[-1]] = made[-1].split()[-1]

    def alone(m: re.Match) -> str:
        nonlocal count
        count += m[0] in surnames
        return surnames.get(m[0], m[0])

    out, at = [], 0
    for (a, b, kind, _), new in zip([*spans, (len(text), len(text), "", "")], [*made, ""], strict=True):
        out += [_WORD.sub(alone, text[at:a]) if surnames else text[at:a], _dress(kind, text[a:b], new)]
        at = b
    return "".join(out), count


def _mentions(key: bytes):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, kinds, values, made = [], [], [], []
            seen: set = set()
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found = find(text.as_py() or "")
                for kind, value in (x for _, _, k, v in found for x in (_parts(v) if k == "name" else [(k, v)])):
                    if (doc_id, kind, value) not in seen:
                        seen.add((doc_id, kind, value))
                        ids.append(doc_id)
                        kinds.append(kind)
                        values.append(value)
                        made.append(surrogate(kind, value, 0, key))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds, pa.string()), pa.array(values, pa.string()), pa.array(made, pa.string())], names=["doc_id", "kind", "value", "made"])

    return run


def _again(key: bytes):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(zip(*(c.to_pylist() for c in b.columns), strict=True))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([surrogate(k, v, n, key) for k, v, n in rows], pa.string())], names=["kind", "value", "attempt", "made"])

    return run


def _collisions(table: DataFrame) -> DataFrame:
    """Entities (kind, value, attempt) whose surrogate another one keeps, or that occurs as an entity itself. A given name may: its surname's surrogate doesn't."""
    first = table.groupBy("kind", "made").agg(F.min("value").alias("keeper"), F.max("value").alias("most")).where("keeper <> most")
    shared = table.join(first.select("kind", "made", "keeper"), ["kind", "made"]).where("value <> keeper").select("kind", "value", "attempt")
    bare = F.when(F.col("kind") == "name", F.expr("substring(value, 3)")).otherwise(F.col("value"))
    own = table.where("kind <> 'given'").select("kind", bare.alias("made")).distinct()
    return shared.unionByName(table.join(own, ["kind", "made"], "left_semi").select("kind", "value", "attempt")).distinct()


def exceptions(mentions: DataFrame, key: bytes = KEY) -> DataFrame | None:
    """Entities that need another attempt than the first: kind, value, attempt. None if no surrogate collides."""
    table = common.cut(mentions.select("kind", "value", "made").distinct().withColumn("attempt", F.lit(0)))
    again = common.cut(_collisions(table))
    if not again.limit(1).count():
        return None
    while True:
        moved = again.withColumn("attempt", F.col("attempt") + 1).mapInArrow(_again(key), "kind string, value string, attempt int, made string")
        kept = table.join(again.select("kind", "value"), ["kind", "value"], "left_anti").select("kind", "value", "attempt", "made")
        table = common.cut(kept.unionByName(moved))
        again = common.cut(_collisions(table))
        if not again.limit(1).count():
            return table.where("attempt > 0").select("kind", "value", "attempt")


def _replaced(key: bytes, handed: dict[tuple[str, str], int], counted: str | None, joined: bool = False):
    """joined: the last column holds each row's own attempts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.schema.names[:-1] if joined else b.schema.names
            each = b.column(b.num_columns - 1).to_pylist() if joined else [None] * b.num_rows
            texts, counts = [], []
            for text, again in zip(b.column(b.schema.get_field_index("text")), each, strict=True):
                text = text.as_py()
                attempts = {(x["kind"], x["value"]): x["attempt"] for x in again or ()} if joined else handed
                made, n = (text, 0) if text is None else replace(text, attempts, key)
                texts.append(made)
                counts.append(n)
            columns = dict(zip(names, b.columns, strict=False))
            columns["text"] = pa.array(texts, pa.string())
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(columns["n_chars"].type)
            if counted:
                columns[counted] = pa.array(counts, pa.int64())
            yield pa.RecordBatch.from_pydict(columns)

    return run


def with_surrogates(docs: DataFrame, key: bytes = KEY, counted: str | None = "n_replaced") -> DataFrame:
    """docs with every entity in text replaced, and how many mentions were, in a column `counted` (which replaces one of that name; None adds none).

    The texts are read twice and aren't shuffled as long as at most HANDED entities collide; beyond that, those entities' mentions are
    joined to their documents.
    """
    if counted:
        docs = common.dropped_names(docs, counted)
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), *([f"`{counted}` long"] if counted else [])])
    mentions = common.cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_mentions(key), "doc_id long, kind string, value string, made string"))
    again = exceptions(mentions, key)
    if again is None or again.count() <= HANDED:
        handed = {} if again is None else {(r["kind"], r["value"]): r["attempt"] for r in again.collect()}
        return docs.mapInArrow(_replaced(key, handed, counted), fields)
    own, at = common.free_name(docs, "again"), common.free_name(docs, "id")
    kind = "array<struct<kind: string, value: string, attempt: int>>"
    by_doc = mentions.select("doc_id", "kind", "value").distinct().join(again, ["kind", "value"]).groupBy(F.col("doc_id").alias(at)).agg(F.collect_list(F.struct("kind", "value", "attempt")).cast(kind).alias(own))
    rows = docs.join(common.cut(by_doc), F.col("doc_id").cast("long").eqNullSafe(F.col(at)), "left")
    return rows.select(*docs.columns, own).mapInArrow(_replaced(key, {}, counted, True), fields)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_surrogates(common.table(spark, sf_dir, "documents")).select("doc_id", "text", "n_chars", "n_replaced")
