"""PII surrogates: keyed, type-consistent replacements of detected entities.

Every kind of entity has a format (its separators, letter case, length, country
or issuer prefix, check digit, script, gender).  A replacement is the image of
the entity under a keyed permutation of all entities of the same format:

* two entities never share a replacement (a permutation is injective) and no
  entity is its own (the permutation is a conjugated shift, without fixed
  points), so distinctness holds without a table of all entities;
* the image depends on the key and the canonical entity alone, so every mention
  of one entity, in any document and any notation, gets the same replacement;
* images that break the format's rules are walked on until one keeps them,
  which stays injective on the valid entities.

First names map within lists of the same gender and script.  Surnames map
letter by letter class, so script, case and length stay; a gendered ending
stays too, so the forms of one family name stay forms of one.  Letters outside
the listed classes move among the letters of their script and block.  Images
are walked on until they are of the entity's own sort (a listed name or not,
with or without a gendered ending, hexadecimal or not, a reserved domain or
not), so the sorts can't meet.

:func:`collisions` checks all of this over the whole corpus: it returns the
replacements that two different entities share.  :func:`replace_pii` moves to
the next tweak of the key if there are any (two digests may agree by chance)
and raises when the last one has some too.
"""

from __future__ import annotations

import bisect
import hashlib
import ipaddress
import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import bound_batches

#: First names by (script, gender), titles by gender, letter classes by script.
FIRST_NAMES = {
    ("latin", "f"): "Alice Amelia Anna Barbara Carla Caroline Charlotte Clara Diana Elena Elizabeth Emily Emma Eva Hannah Helen Isabel Jane Jessica Julia Karen Katherine Laura Linda Lisa Lucia Maria Marie Martha Mary Monika Nancy Olivia Patricia Rachel Sarah Sofia Sophie Susan Teresa".split(),
    ("latin", "m"): "Adam Albert Andrew Anthony Brian Carlos Charles Christian Daniel David Edward Eric Felix Francis Frank George Hans Henry Jack Jacob James John Jose Joseph Karl Kevin Louis Luis Marco Mark Martin Michael Miguel Oliver Paul Peter Philip Richard Robert Thomas William".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Екатерина Елена Ирина Ксения Людмила Мария Наталья Ольга Светлана Татьяна Юлия".split(),
    ("cyrillic", "m"): "Александр Алексей Андрей Борис Виктор Владимир Дмитрий Иван Игорь Максим Михаил Николай Олег Павел Сергей".split(),
}
TITLES = {"m": "Mr Herr Monsieur Señor Sr Sir Lord г-н господин".split(), "f": "Mrs Ms Miss Frau Madame Mme Señora Sra Lady г-жа госпожа".split(), "": "Dr Prof Doctor Professor Доктор".split()}
PARTICLES = frozenset("al bin da de del den der des di do dos du la le ten ter van von y zu".split())
LETTER_CLASSES = ("aeiou", "bcdfghjklmnpqrstvwxyz", "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "0123456789", "áàâäãåéèêëíìîïóòôöõøúùûü", "çñšžčćřłđ", "ъь", "ёєії", "αεηιουω", "άέήίόύώ", "βγδζθκλμνξπρστφχψ")
GENDERED_ENDINGS = ("ова", "ева", "ина", "ская", "цкая", "ов", "ев", "ин", "ский", "цкий")
RESERVED_DOMAINS = ("example.com", "example.org", "example.net")

CLASS_OF = {c: k for k in LETTER_CLASSES for c in k}
NAMES = {name: (where, k) for where, names in FIRST_NAMES.items() for k, name in enumerate(names)}
_WORD = r"[^\W\d_](?:[^\W\d_]|['’-](?=[^\W\d_]))*"
_TITLE = "|".join(sorted((re.escape(t) for ts in TITLES.values() for t in ts), key=len, reverse=True))
NUMBER = re.compile(r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?)?\d(?:[ .-]?\d){6,18}(?!\w|\.\d)")
IPV4 = re.compile(r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d)")
ACCESS_KEY = re.compile(r"(?<!\w)(AKIA|ASIA)([A-Z0-9]{16})(?!\w)")
SECRET = re.compile(r"(?i)(?<!\w)(?:password|passwd|pwd|secret|token|api[_-]?key)(?!\w)[\"']?\s*[:=]\s*[\"']?([\w+/=.~-]{6,})")
IBAN = re.compile(r"(?<!\w)([A-Z]{2})([0-9]{2})((?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?!\w)")
MAIL_SIGNS, MAIL_RIGHT = "_.+%-", re.compile(r"(?:[\w-]+\.)+[A-Za-z]{2,}")
_PARTICLE = "|".join(sorted(PARTICLES, key=len, reverse=True))
TITLED = re.compile(rf"(?<!\w)(?:(?:{_TITLE})\.?\s+)+((?:[^\W\d_]\.\s*)*(?:(?:{_PARTICLE})\s+)*({_WORD}))(?:\s+(?!(?:{_TITLE})(?!\w))({_WORD}))?")
NAMED = re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, sorted(NAMES, key=len, reverse=True)))})(?= )")
MORE = re.compile(rf"(?: +[^\W\d_]\.)*(?: +(?:{_PARTICLE}))* +({_WORD})")
WORD, PIECE = re.compile(_WORD), re.compile(r"[^\W\d_]+")
TITLE_WORDS = frozenset(t for ts in TITLES.values() for t in ts)
HEX = re.compile(r"[0-9a-f]+")
PHONE_LEAD = re.compile(r"[2-9]\d\d[2-9]")


class Permutation:
    """Keyed permutations of ranges, without fixed points."""

    def __init__(self, key: bytes, tweak: int = 0):
        self.key = hashlib.blake2b(tweak.to_bytes(8, "little"), key=key[:64], digest_size=32).digest()

    def _round(self, label: bytes, r: int, x: int, bits: int) -> int:
        size = (bits + 7) // 8
        data = label + bytes([r]) + x.to_bytes(size, "little")
        out = b"".join(hashlib.blake2b(data + bytes([k]), key=self.key, digest_size=64).digest() for k in range(-(-size // 64)))
        return int.from_bytes(out[:size], "little") & (1 << bits) - 1

    def _mix(self, label: bytes, x: int, n: int, back: bool) -> int:
        """Feistel network over the least even number of bits, walked until below n."""
        half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        while True:
            left, right = x >> half, x & (1 << half) - 1
            for r in range(7, -1, -1) if back else range(8):
                if back:
                    left, right = right ^ self._round(label, r, left, half), left
                else:
                    left, right = right, left ^ self._round(label, r, right, half)
            x = left << half | right
            if x < n:
                return x

    def shifted(self, label: str, x: int, n: int, valid: Callable[[int], bool] = lambda x: True) -> int:
        """Image of x in [0, n): the next valid one on a keyed cycle through all of them."""
        if n < 2:
            return x
        tag = f"{label}|{n}|".encode()
        to = x
        while True:
            to = self._mix(tag, (self._mix(tag, to, n, False) + 1) % n, n, True)
            if valid(to) or to == x:
                return to


def _digits(text: str) -> str:
    return "".join(str(int(c)) for c in text if c.isdecimal())


def _refill(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def luhn(digits: str) -> int:
    """Luhn sum modulo 10; 0 for a valid number."""
    return sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits))) % 10


@cache
def _others(block: int, script: str, category: str, lower: bool) -> str:
    """Letters and digits of a block of 256 code points, a script and a category that are in none of the classes."""
    return "".join(c for c in map(chr, range(block << 8, block + 1 << 8)) if c.isalnum() and not _listed(c) and _sort(c) == (block, script, category, lower))


def _sort(c: str) -> tuple[int, str, str, bool]:
    return ord(c) >> 8, unicodedata.name(c, "").split(" ")[0], unicodedata.category(c), c.lower() == c


def _listed(c: str) -> str:
    """The class of a letter in either case, or nothing."""
    low = c.lower()
    return CLASS_OF.get(low, "") if c in (low, low.upper()) else ""


@cache
def _class(c: str) -> str:
    """The letters or digits among which a character moves; nothing for other characters."""
    return _listed(c) or (_others(*_sort(c)) if c.isalnum() else "")


def movable(text: str) -> bool:
    """Whether any character has others in its class."""
    return any(len(_class(c)) > 1 for c in text)


def _by_class(p: Permutation, label: str, text: str, valid: Callable[[str], bool] | None = None) -> str:
    """Letters and digits permuted within their classes, to a valid image; other characters, case and length stay."""
    kinds = [_class(c) for c in text]
    radix, value = 1, 0
    for c, kind in zip(text, kinds, strict=True):
        if kind:
            value, radix = value * len(kind) + kind.index(c if c in kind else c.lower()), radix * len(kind)

    def image(value: int) -> str:
        out = []
        for c, kind in zip(reversed(text), reversed(kinds), strict=True):
            if kind:
                value, k = divmod(value, len(kind))
                out.append(kind[k] if c in kind else kind[k].upper())
            else:
                out.append(c)
        return "".join(reversed(out))

    shape = "".join(k[0] if k else c for k, c in zip(kinds, text, strict=True))
    return image(p.shifted(f"{label}|{shape}", value, radix, *([] if valid is None else [lambda v: valid(image(v))])))


def _alphabet(p: Permutation, label: str, text: str, letters: str) -> str:
    """A string over an alphabet permuted among those of its length."""
    value = 0
    for c in text:
        value = value * len(letters) + letters.index(c)
    value, out = p.shifted(f"{label}|{len(text)}", value, len(letters) ** len(text)), []
    for _ in text:
        value, k = divmod(value, len(letters))
        out.append(letters[k])
    return "".join(reversed(out))


def phone(p: Permutation, text: str) -> str:
    """Country code stays; the national number of ten digits, or all other digits, are permuted."""
    digits = _digits(text)
    keep = len(digits) - 10 if len(digits) > 10 else 0
    tail = digits[keep:]
    well = bool(PHONE_LEAD.match(tail)) and len(tail) == 10
    to = p.shifted(f"phone|{digits[:keep] if keep and digits[:keep] != '1' else ''}|{well}", int(tail), 10 ** len(tail), lambda x: (bool(PHONE_LEAD.match(f"{x:0{len(tail)}d}")) and len(tail) == 10) == well)
    return _refill(text, digits[:keep] + f"{to:0{len(tail)}d}")


def card(p: Permutation, text: str) -> str:
    """Issuer digit and check digit's validity stay."""
    digits = _digits(text)
    body = digits[1:-1]
    to = p.shifted(f"card|{digits[0]}|{len(digits)}", int(body), 10 ** len(body))
    stem = f"{digits[0]}{to:0{len(body)}d}"
    off = luhn(digits)
    return _refill(text, stem + next(str(c) for c in range(10) if luhn(f"{stem}{c}") == off))


def _space(ip: int) -> str:
    a = ipaddress.IPv4Address(ip)
    return "special" if a.is_multicast or a.is_reserved or a.is_loopback or a.is_unspecified or a.is_link_local else "private" if a.is_private else "public"


def ip(p: Permutation, text: str) -> str:
    """Public addresses stay public, private ones private."""
    x = int(ipaddress.IPv4Address(".".join(str(int(o)) for o in text.split("."))))
    kind = _space(x)
    if kind == "private":  # within its own block: 10/8, 172.16/12, 192.168/16 and the rest by /16
        bits = 24 if x >> 24 == 10 else 20 if x >> 20 == 0xAC1 else 16
        block = x >> bits << bits
        return str(ipaddress.IPv4Address(block | p.shifted(f"ip|{x >> bits}", x & (1 << bits) - 1, 1 << bits, lambda y: _space(block | y) == kind)))
    return str(ipaddress.IPv4Address(p.shifted("ip", x, 1 << 32, lambda y: _space(y) == kind)))


def _reserved(domain: str) -> bool:
    return any(domain == x or domain.endswith("." + x) for x in RESERVED_DOMAINS)


def email(p: Permutation, text: str) -> str:
    """Local part and domain labels by letter class, lower-cased; top-level and reserved domains stay."""
    local, _, domain = text.lower().rpartition("@")
    if _reserved(domain):
        return _by_class(p, f"mail|{domain}", local) + "@" + domain
    head, _, top = domain.rpartition(".")
    return _by_class(p, f"mail|{top}", f"{local}@{head}", lambda x: not _reserved(f"{x.rpartition('@')[2]}.{top}")) + "." + top


def secret(p: Permutation, text: str) -> str:
    """Hexadecimal strings stay hexadecimal, others keep their letter classes."""
    if HEX.fullmatch(text):
        return _alphabet(p, "hex", text, "0123456789abcdef")
    return _by_class(p, "secret", text, lambda x: not HEX.fullmatch(x))


def access_key(p: Permutation, text: str) -> str:
    """Prefix stays."""
    return text[:4] + _alphabet(p, text[:4], text[4:], "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")


def iban_valid(text: str) -> bool:
    """The remainder rule of international account numbers, whose check digits run from 02 to 98."""
    t = text.replace(" ", "")
    return 2 <= int(t[2:4]) <= 98 and int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1


def iban(p: Permutation, text: str) -> str:
    """Country stays; check digits are made anew."""
    t = text.replace(" ", "")
    body = _by_class(p, f"iban|{t[:2]}", t[4:])
    check = 98 - int("".join(str(int(c, 36)) for c in body + t[:2] + "00")) % 97
    it = iter(f"{t[:2]}{check:02d}{body}")
    return "".join(c if c == " " else next(it) for c in text)


def _ending(text: str) -> str:
    return next((e for e in GENDERED_ENDINGS if text.lower().endswith(e) and len(text) > len(e) + 1), "")


def surname(p: Permutation, text: str) -> str:
    """Script, case, length and a gendered ending stay; the image is no listed first name."""
    ending = _ending(text)
    stem, rest = text[: len(text) - len(ending)], text[len(text) - len(ending) :]
    return _by_class(p, "surname", stem, lambda x: x + rest not in NAMES and _ending(x + rest) == ending) + rest


def first_name(p: Permutation, text: str) -> str:
    """Another name of the same gender and script; unknown names map as surnames do."""
    if text not in NAMES:
        return surname(p, text)
    where, k = NAMES[text]
    return FIRST_NAMES[where][p.shifted(f"first|{where}", k, len(FIRST_NAMES[where]))]


def person(p: Permutation, text: str) -> str:
    """Parts map one by one, wherever they stand, so a later mention by one part still refers to the same person; particles stay."""
    return "".join(part if part.isspace() or part in PARTICLES else first_name(p, part) for part in re.split(r"(\s+)", text))


KINDS: dict[str, Callable[[Permutation, str], str]] = {"email": email, "ip": ip, "access_key": access_key, "secret": secret, "iban": iban, "card": card, "phone": phone, "person": person}


def canonical(kind: str, text: str) -> str:
    """The entity behind a mention, whatever its notation."""
    if kind in ("card", "phone"):
        digits = _digits(text)
        return digits[-10:] if kind == "phone" and (len(digits) == 10 or len(digits) == 11 and digits[0] == "1") else digits
    if kind == "ip":
        return ".".join(str(int(o)) for o in text.split("."))
    if kind == "iban":
        return text.replace(" ", "")
    return text.lower() if kind == "email" else " ".join(text.split()) if kind == "person" else text


def _name_word(word: str) -> bool:
    return word[0].isupper() and len(word) > 1 and word not in TITLE_WORDS


def _name_end(text: str, start: int, end: int) -> int:
    """End of the name [start, end) with the capitalised words, particles and initials that follow, without a possessive."""
    while (m := MORE.match(text, end)) and _name_word(m[1]):
        end = m.end()
    return end - 2 if end - start > 3 and text[end - 2 : end] in ("'s", "’s") else end


def _mentions(text: str, names: list[str]) -> Iterator[tuple[int, int]]:
    """Where a word of the names, or a piece of a joined word, stands in the text."""
    parts = {w for name in names for w in name.split() if _name_word(w)}
    for m in WORD.finditer(text) if parts else ():
        word = m[0][:-2] if m[0][-2:] in ("'s", "’s") else m[0]
        if word in parts:
            yield m.start(), m.start() + len(word)
        elif len(word) > 1 and not word.isalpha():
            yield from ((m.start() + x.start(), m.start() + x.end()) for x in PIECE.finditer(word) if x[0] in parts)


def detect(text: str) -> list[tuple[int, int, str]]:
    """Disjoint (start, end, kind) in order of start; of overlapping finds the kind listed first wins.

    Persons are found by a title or a listed first name, and then wherever a
    word of their names stands in the same text.
    """
    found: list[tuple[int, int, str]] = []
    at, floor = text.find("@"), 0
    while at >= 0:
        start = at  # of a local part of any length, but not over another @, so each character is looked at once
        while start > floor and (text[start - 1].isalnum() or text[start - 1] in MAIL_SIGNS):
            start -= 1
        while start < at and text[start] == ".":
            start += 1
        right = MAIL_RIGHT.match(text, at + 1)
        if start < at and right and movable(text[start:at] + right[0].rpartition(".")[0] * (not _reserved(right[0].lower()))):
            found.append((start, right.end(), "email"))
        at, floor = text.find("@", at + 1), at + 1
    low = any(c in text for c in "0123456789")
    if low:
        found += [(*m.span(), "ip") for m in IPV4.finditer(text) if all(int(o) < 256 for o in m[0].split("."))]
        found += [(*m.span(), "access_key") for m in ACCESS_KEY.finditer(text)]
    if "=" in text or ":" in text:
        found += [(*m.span(1), "secret") for m in SECRET.finditer(text) if movable(m[1])]  # dots or dashes only stand for a secret
    if low:
        found += [(*m.span(), "iban") for m in IBAN.finditer(text) if iban_valid(m[0])]
        for m in NUMBER.finditer(text):
            digits, plain = _digits(m[0]), m[0].isdigit()
            if 13 <= len(digits) <= 19 and m[0][0] not in "+(" and (luhn(digits) == 0 or len(digits) == 16 and digits[0] in "3456"):
                found.append((*m.span(), "card"))
            elif 7 <= len(digits) <= 15 and not plain and (m[0][0] in "+(" or re.fullmatch(r"\d{3}[ .-]\d{3}[ .-]\d{4}", m[0])):
                found.append((*m.span(), "phone"))
    for m in TITLED.finditer(text):
        if m[2][0].isupper():
            found.append((m.start(1), _name_end(text, m.start(1), m.end(3) if m[3] and m[3][0].isupper() else m.end(1)), "person"))
    for m in NAMED.finditer(text):
        more = MORE.match(text, m.end())
        if more and _name_word(more[1]):
            found.append((m.start(), _name_end(text, *m.span()), "person"))
    ranks = {k: r for r, k in enumerate(KINDS)}
    taken: list[tuple[int, int, str]] = []

    def take(s: int, e: int, kind: str) -> None:
        k = bisect.bisect(taken, (s, e, kind))
        if (not k or taken[k - 1][1] <= s) and (k == len(taken) or taken[k][0] >= e) and movable(text[s:e]):
            taken.insert(k, (s, e, kind))

    for s, e, kind in sorted(found, key=lambda x: (ranks[x[2]], x[0])):
        take(s, e, kind)
    for s, e in _mentions(text, [text[s:e] for s, e, kind in taken if kind == "person"]):
        take(s, e, "person")
    return taken


@dataclass(frozen=True)
class PiiParams:
    """key: secret of the replacements; most_tweaks: how often collisions may move the key on."""

    key: bytes = b"plumbline surrogate key"
    most_tweaks: int = 8


def rewrite(text: str, p: Permutation) -> tuple[str, list[tuple[int, int, str]]]:
    """Text with every entity replaced, and the finds in the original."""
    found, parts, at = detect(text), [], 0
    for s, e, kind in found:
        parts += [text[at:s], KINDS[kind](p, text[s:e])]
        at = e
    return "".join(parts) + text[at:], found


def _entities(key: bytes, tweak: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Permutation(key, tweak)

        def digest(x: str) -> int:
            return int.from_bytes(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), key=key[:64], digest_size=8).digest(), "little", signed=True)

        for batch in batches:
            seen = set()
            for text in batch.column("text").to_pylist():
                for s, e, kind in detect(text or ""):
                    seen.add((kind, digest(canonical(kind, text[s:e])), digest(canonical(kind, KINDS[kind](p, text[s:e])))))
            rows = sorted(seen)
            yield pa.RecordBatch.from_pydict({"kind": pa.array([r[0] for r in rows], pa.string())} | {n: pa.array([r[k] for r in rows], pa.int64()) for k, n in ((1, "entity"), (2, "surrogate"))})

    return run


def collisions(docs: DataFrame, params: PiiParams | None = None, tweak: int = 0) -> DataFrame:
    """(kind, surrogate, entities) of replacements that several entities of a kind share, or that equal their entity; by keyed digests, so no entity is stored."""
    p = params or PiiParams()
    pairs = docs.select("text").mapInArrow(_entities(p.key, tweak), "kind string, entity long, surrogate long").distinct()
    return (
        pairs.groupBy("kind", "surrogate")
        .agg(F.count(F.lit(1)).alias("entities"), F.max((F.col("entity") == F.col("surrogate")).cast("int")).alias("same"))
        .filter("entities > 1 OR same = 1")
        .select("kind", "surrogate", "entities")
    )


def replace_pii(docs: DataFrame, params: PiiParams | None = None) -> DataFrame:
    """``docs`` (text and any other columns) with texts rewritten and ``n_entities`` and ``kinds`` appended.

    A null text stays null, an empty one empty, both without entities; texts
    without entities come back unchanged; repeated rows get equal results;
    columns named n_entities or kinds are replaced; an empty table gives no rows.
    """
    p = params or PiiParams()
    bound_batches(docs.sparkSession)
    for tweak in range(p.most_tweaks):
        if (left := collisions(docs, p, tweak)).isEmpty():
            break
    else:
        counts = {r.kind: r["count"] for r in left.groupBy("kind").count().collect()}
        raise ValueError(f"replacements still collide after {p.most_tweaks} tweaks of the key: {counts}")
    fields = [f for f in docs.schema.fields if f.name not in ("n_entities", "kinds")]
    names = [f.name for f in fields]
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        perm = Permutation(p.key, tweak)
        for batch in batches:
            done = [(None, []) if t is None else rewrite(t, perm) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array([d[0] for d in done], pa.string())
            columns += [pa.array([len(d[1]) for d in done], pa.int64()), pa.array([[f[2] for f in d[1]] for d in done], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, [*names, "n_entities", "kinds"])

    schema = T.StructType([*fields, T.StructField("n_entities", T.LongType()), T.StructField("kinds", T.ArrayType(T.StringType()))])
    return docs.select(*names).mapInArrow(run, schema)


def op4_surrogates(spark, sf_dir: str) -> DataFrame:
    """All of ``documents`` with personal data and secrets replaced."""
    return replace_pii(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
