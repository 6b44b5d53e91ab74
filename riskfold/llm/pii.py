"""Operator 7: personal data replaced by keyed surrogates.

1. Every whole text is searched once; a text with entities is staged with their
   places, kinds and canonical forms, other texts are never stored or shuffled.
2. The distinct (kind, canonical form) rows get a surrogate drawn from an HMAC of
   a secret key.  Two forms with one surrogate, or a surrogate that occurs as a
   real value in the corpus, are redrawn until no collision is left, so that
   distinct values stay distinct.  Later draws of names, mailboxes and secrets are
   longer, so there are always enough.  Numbers cannot grow: where a block of them
   (say 192.168.0.0/16) has more than a quarter of its values in the corpus, its
   values are permuted by the key.  Then a surrogate may be another real value of
   the block, but never the value that it replaces.
3. Surrogates are joined back to the places and written over the texts, in the
   format of each place (digits into the same separators, letters in the same
   script and case).  Equal canonical forms get equal surrogates in all documents
   (coreference): +1 (212) 555-0100 and 212.555.0100 are one number.

A surrogate is of the kind of what it replaces: card numbers pass the Luhn test
and keep their first digit, IBANs their mod-97 test and country, private IP
addresses stay private, phone numbers keep country code and grouping, secrets the
class of each character.  Names (found after a form of address, and then wherever
the same text repeats them) keep script, case and the gender of the form of
address: female ones end in a vowel, male ones in a consonant.

Defined results: null text is an empty text without entities; overlapping finds
are settled in the order of ``KINDS``, then by place; repeated rows and ids are
rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import hmac
import math
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskfold.llm.common import join_groups, ship_package, stage, text_of

WIDEN_EVERY = 2  # draws after which surrogates that can grow get longer
PERMUTED = -1  # the turn of values whose block is permuted
LEAST_BLOCK = 1 << 16  # values of the smallest block

_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
#: Kinds in the order in which overlapping finds are settled; group ``v`` is the value.
KINDS = {
    "email": r"(?P<v>[\w.%+\-]+@(?:[A-Za-z0-9\-]+\.)+[A-Za-z]{2,})",
    "secret": r"""(?i:pass(?:word|wd)?|secret|token|api[_-]?key)\s*[:=]\s*["']?(?P<v>(?=[^\s"']*\d)[^\s"',;]{6,})""",
    "access_key": r"(?<![0-9A-Za-z])(?P<v>(?:AKIA|ASIA)[0-9A-Z]{16})(?![0-9A-Za-z])",
    "hex_key": r"(?<![0-9A-Za-z])(?P<v>(?=[0-9a-f]*\d)(?=[0-9a-f]*[a-f])[0-9a-f]{32,})(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])(?P<v>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![0-9A-Za-z])",
    "ip": rf"(?<![\d.])(?P<v>(?:{_OCTET}\.){{3}}{_OCTET})(?!\d|\.\d)",
    "card": r"(?<![\d-])(?P<v>\d{13,19}|\d{4}(?:[ -]\d{4}){2}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?![\d-])",
    "ssn": r"(?<![\d-])(?P<v>\d{3}-\d{2}-\d{4})(?![\d-])",
    "phone": r"(?<![\w+])(?P<v>(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}|\+\d{8,15})(?!\d)",
}
#: Forms of address before a name.
FEMALE = ("Mrs", "Ms", "Miss", "Madam", "Mme", "Mlle", "Madame", "Frau", "Señora", "Sra", "Signora", "Госпожа")
MALE = ("Mr", "Mister", "Sir", "Monsieur", "Herr", "Herrn", "Señor", "Sr", "Signor", "Господин")
_NAME = r"[^\W\d_a-zа-я][^\W\d_]+(?:-[^\W\d_]+)?"
_PERSON = {kind: re.compile(rf"\b(?:{'|'.join(forms)})\.? (?P<a>{_NAME})(?: (?P<b>{_NAME}))?")
           for kind, forms in (("female", FEMALE), ("male", MALE))}
_FIND = {kind: re.compile(pattern) for kind, pattern in KINDS.items()}
_HINT = re.compile(r"[0-9@]")
_ADDRESSED = re.compile("|".join(rf"\b{x}\b" for x in (*FEMALE, *MALE)))
_VOWELS = {"latin": "aeio", "cyrillic": "аеио", "greek": "αειο"}
_CONSONANTS = {"latin": "bdfgklmnprstv", "cyrillic": "бвгдзклмнпрст", "greek": "βγδζκλμνπρστ"}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def canonical(kind: str, value: str) -> str | None:
    """The form that all mentions of one thing share; None if it is no such thing."""
    digits = "".join(str(int(c)) for c in value if c.isdecimal())
    if kind == "email" or kind in _PERSON:
        return value.casefold() if kind in _PERSON else value.lower()
    if kind == "card":
        return digits if luhn(digits) and len(set(digits)) > 1 else None
    if kind == "phone":
        return digits[-10:] if len(digits) >= 7 else None
    if kind == "ssn":
        return digits
    if kind == "iban":
        plain = value.replace(" ", "")
        return plain if _mod97(plain) == 1 else None
    if kind == "ip":
        return ".".join(str(int(x)) for x in value.split("."))
    return value


def find_entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical form) of the entities of a text, in order, none overlapping."""
    found: list[tuple[int, int, str, str]] = []
    if _HINT.search(text):
        for kind, pattern in _FIND.items():
            for m in pattern.finditer(text):
                if (form := canonical(kind, m["v"])) is not None:
                    found.append((*m.span("v"), kind, form))
    if _ADDRESSED.search(text):
        names: dict[str, str] = {}
        for kind, pattern in _PERSON.items():
            for m in pattern.finditer(text):
                for group in ("a", "b"):
                    if m[group]:
                        names.setdefault(m[group], kind)
        if names:
            said = re.compile(r"(?<!\w)(?:" + "|".join(sorted(map(re.escape, names), key=len, reverse=True)) + r")(?!\w)")
            found += [(*m.span(), names[m[0]], canonical(names[m[0]], m[0])) for m in said.finditer(text)]
    taken: list[tuple[int, int, str, str]] = []
    covered = bytearray(len(text)) if found else b""
    for one in found:  # in the order of KINDS
        if not any(covered[one[0]:one[1]]):
            covered[one[0]:one[1]] = b"\1" * (one[1] - one[0])
            taken.append(one)
    return sorted(taken)


class _Draw:
    """Numbers from HMAC-SHA256 of a key and a message."""

    def __init__(self, key: bytes, *message: str):
        self.key, self.message, self.block, self.pool = key, "\0".join(message).encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 8:
            self.pool = hmac.new(self.key, self.message + self.block.to_bytes(4, "big"), hashlib.sha256).digest()
            self.block += 1
        number, self.pool = int.from_bytes(self.pool[:8], "big"), self.pool[8:]
        return number % n

    def of(self, choices: str) -> str:
        return choices[self.below(len(choices))]


def _script(c: str) -> str | None:
    low = c.lower()
    return "latin" if low < "ɐ" else "greek" if "α" <= low <= "ω" else "cyrillic" if "а" <= low <= "я" else None


def _like(draw: _Draw, c: str, hexadecimal: bool = False) -> str:
    """A character of the same class, script and case."""
    if c.isdigit():
        return draw.of("0123456789")
    if not c.isalpha():
        return c
    if hexadecimal:
        return draw.of("abcdef") if c.islower() else draw.of("ABCDEF")
    script = _script(c)
    if script is None:  # a letter near it in its own block
        near = [x for x in map(chr, range(ord(c) & ~31, (ord(c) & ~31) + 32)) if x.isalpha() and x.islower() == c.islower()]
        return near[draw.below(len(near))]
    new = draw.of(_VOWELS[script] + _CONSONANTS[script])
    return new.upper() if c.isupper() else new


def _kept_octets(parts: list[str]) -> int:
    """The leading octets that make an address a private one; 0 for a public one."""
    a, b = parts[:2]
    return 1 if a in ("10", "127") else 2 if (a, b) in {("192", "168"), *(("172", str(x)) for x in range(16, 32))} else 0


def _with_luhn(body: str) -> str:
    return next(body + d for d in "0123456789" if luhn(body + d))


def _with_mod97(country: str, body: str) -> str:
    return f"{country}{98 - _mod97(country + '00' + body):02d}{body}"


_DIGITS, _CAPITALS, _OCTETS = list("0123456789"), list("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), [str(x) for x in range(256)]


def _block(kind: str, form: str) -> tuple[str, list[list[str]], list[str], Callable[[list[str]], str]] | None:
    """The values that can stand for ``form`` where they cannot grow: a name of the
    block, the choices of each free place, what ``form`` has there, and the form
    that such parts make."""
    if not form.isascii():
        return None
    if kind == "ip" and form.count(".") == 3:
        parts = form.split(".")
        keep = _kept_octets(parts)
        return ".".join(parts[:keep]), [_OCTETS] * (4 - keep), parts[keep:], lambda new: ".".join(parts[:keep] + new)
    if kind == "phone" and len(form) == 10:
        return form[3:6], [_DIGITS] * 7, list(form[:3] + form[6:]), lambda new: "".join(new[:3]) + form[3:6] + "".join(new[3:])
    if kind in ("phone", "ssn"):
        return str(len(form)), [_DIGITS] * len(form), list(form), "".join
    if kind == "card":
        return f"{len(form)} {form[0]}", [_DIGITS] * (len(form) - 2), list(form[1:-1]), lambda new: _with_luhn(form[0] + "".join(new))
    if kind == "iban":
        shape = "".join("0" if c.isdigit() else "A" for c in form[4:])
        return form[:2] + shape, [_DIGITS if c == "0" else _CAPITALS for c in shape], list(form[4:]), lambda new: _with_mod97(form[:2], "".join(new))
    return None


def _permute(key: bytes, name: str, size: int, number: int) -> int:
    """A keyed permutation of 0 .. size - 1 that is one cycle, so that no number stays:
    a step of fixed width in the order that a Feistel network gives the numbers."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1

    def keyed(*message: object) -> int:
        return int.from_bytes(hmac.new(key, "\0".join(map(str, ("permute", name, *message))).encode(), hashlib.sha256).digest(), "big")

    def network(n: int, back: bool) -> int:
        while True:
            left, right = n >> half, n & mask
            for k in range(8):
                if back:
                    left, right = right ^ keyed(7 - k, left) & mask, left
                else:
                    left, right = right, left ^ keyed(k, right) & mask
            n = left << half | right
            if n < size:
                return n

    step = 1 + keyed("step") % (size - 1)
    while math.gcd(step, size) > 1:
        step = step % (size - 1) + 1
    return network((network(number, False) + step) % size, True)


def _permuted(key: bytes, kind: str, form: str) -> str:
    name, choices, parts, make = _block(kind, form)
    size, number = math.prod(map(len, choices)), 0
    for own, part in zip(choices, parts):
        number = number * len(own) + own.index(part)
    while True:
        number = rest = _permute(key, f"{kind} {name}", size, number)
        new = []
        for own in reversed(choices):
            rest, at = divmod(rest, len(own))
            new.append(own[at])
        made = make(new[::-1])
        if kind != "ip" or name or not _kept_octets(made.split(".")):  # a public address stays public
            return made


def surrogate(key: bytes, kind: str, form: str, turn: int) -> str:
    """The ``turn``-th draw of a canonical form to put in the place of ``form``."""
    if turn == PERMUTED:
        return _permuted(key, kind, form)
    longer = turn // WIDEN_EVERY
    draw = _Draw(key, kind, form, str(turn))
    if kind == "email":
        local, domain = form.split("@", 1)
        labels = domain.split(".")
        place = _Draw(key, "domain", domain)  # one domain stays one domain
        return "".join(_like(draw, c) for c in local + "a" * longer) + "@" + ".".join(
            ["".join(_like(place, c) for c in x) for x in labels[:-1]] + labels[-1:])
    if kind in _PERSON:
        script = _script(form[0]) or "latin"
        out = "".join(draw.of(_CONSONANTS[script]) + draw.of(_VOWELS[script]) for _ in range(max(2, len(form) // 2) + longer))
        return out if kind == "female" else out + draw.of(_CONSONANTS[script])
    if kind == "ip":
        parts = form.split(".")
        keep = _kept_octets(parts)
        while True:
            new = (parts[:keep] + [str(1 + draw.below(223))] * (keep == 0) + [str(draw.below(256)) for _ in range(4)])[:4]
            if keep or not _kept_octets(new):
                return ".".join(new)
    if kind == "card":
        return _with_luhn(form[0] + "".join(draw.of("0123456789") for _ in form[2:]))
    if kind == "iban":
        return _with_mod97(form[:2], "".join(draw.of("0123456789") if c.isdigit() else draw.of("ABCDEFGHJKLMNPRSTUVWXYZ")
                                             for c in form[4:]))
    if kind == "phone":
        new = "".join(draw.of("0123456789") for _ in form)
        return (draw.of("23456789") + new[1:3] + form[3:6] + new[6:]) if len(form) == 10 else draw.of("23456789") + new[1:]
    if kind == "access_key":
        return form[:4] + "".join(draw.of("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in form[4:])
    hexadecimal = kind == "hex_key" or re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", form) is not None
    return "".join(_like(draw, c, hexadecimal) for c in form + "a" * (longer if kind == "secret" else 0))


def render(kind: str, place: str, new: str) -> str:
    """``new``, a canonical form, in the format of the text it replaces."""
    if kind in ("card", "phone", "ssn", "iban"):
        rest, out = list(new), []
        for c in reversed(place):  # from the right, so that a country code stays
            out.append(rest.pop() if rest and c.isalnum() else c)
        return "".join(reversed(out))
    if kind == "email":
        old, parts = place.split("@", 1), new.split("@", 1)
        return "@".join("".join(n.upper() if c.isupper() else n for c, n in zip(o, p)) + p[len(o):] for o, p in zip(old, parts))
    if kind in _PERSON:
        return new.upper() if place.isupper() and len(place) > 1 else new[0].upper() + new[1:]
    return new


def _redraw(forms: DataFrame, key: bytes) -> DataFrame:
    """(kind, form, n, turn, fresh) with ``fresh``, the surrogate of that turn."""
    def run(batches):
        for batch in batches:
            yield batch.assign(fresh=[surrogate(key, k, f, t) for k, f, t in zip(batch["kind"], batch["form"], batch["turn"])])

    return forms.mapInPandas(run, "kind string, form string, n long, turn int, fresh string")


def _first_turns(forms: DataFrame) -> DataFrame:
    """(kind, form, n, turn): ``PERMUTED`` for the values of a block of which more
    than a quarter are in the corpus, else 0.  There are few such blocks, as each
    has at least ``LEAST_BLOCK`` / 4 rows."""
    sizes = forms.where(F.col("kind").isin("ip", "phone", "ssn", "card", "iban")).groupBy("kind").count().collect()
    large = [r["kind"] for r in sizes if 4 * r["count"] > LEAST_BLOCK]
    if not large:
        return forms.withColumn("turn", F.lit(0))

    def blocks(batches):
        for batch in batches:
            found = [_block(k, f) for k, f in zip(batch["kind"], batch["form"])]
            yield pd.DataFrame({"kind": batch["kind"], "name": [b and b[0] for b in found],
                                "size": [float(math.prod(map(len, b[1]))) if b else None for b in found]})

    counted = (forms.where(F.col("kind").isin(large)).select("kind", "form").mapInPandas(blocks, "kind string, name string, size double")
               .where("name is not null").groupBy("kind", "name", "size").count())
    dense = {(r["kind"], r["name"]) for r in counted.where("4 * count > size").collect()}

    def turns(batches):
        for batch in batches:
            found = [k in large and _block(k, f) for k, f in zip(batch["kind"], batch["form"])]
            yield batch.assign(turn=[PERMUTED if b and (k, b[0]) in dense else 0 for k, b in zip(batch["kind"], found)])

    return forms.select("kind", "form", "n").mapInPandas(turns, "kind string, form string, n long, turn int")


def assign_surrogates(forms: DataFrame, key: bytes) -> DataFrame:
    """(kind, form, n, fresh) for distinct (kind, form, n): the surrogates are
    distinct within a kind and none, but for permuted blocks, is a form of the corpus."""
    drawn = stage(_redraw(_first_turns(forms), key), "drawn")
    while True:
        first = drawn.groupBy("kind", "fresh").agg(F.min(F.struct((F.col("turn") != PERMUTED).alias("drawn"), "form")).alias("first"),
                                                   F.count(F.lit(1)).alias("sharing"))
        shared = (drawn.join(first.where("sharing > 1"), ["kind", "fresh"]).where("form <> first.form").select("kind", "form"))
        real = drawn.where(F.col("turn") != PERMUTED).join(
            forms.select("kind", F.col("form").alias("fresh")), ["kind", "fresh"], "left_semi")
        bad = stage(shared.unionByName(real.select("kind", "form")).distinct(), "collisions")
        if bad.isEmpty():
            return drawn.select("kind", "form", "n", "fresh")
        again = drawn.join(bad, ["kind", "form"], "left_semi").select("kind", "form", "n", (F.col("turn") + 1).alias("turn"))
        drawn = stage(drawn.join(bad, ["kind", "form"], "left_anti").unionByName(_redraw(again, key)), "drawn")


def replace_entities(docs: DataFrame, key: bytes) -> DataFrame:
    """(doc_id, text, n_entities, kinds) for every row: the text with surrogates."""
    ship_package(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))

    def search(batches):
        for batch in batches:
            found = [find_entities(t) for t in batch["text"]]
            some = [bool(x) for x in found]
            batch = batch.assign(found=[[{"start": a, "end": b, "kind": k, "form": f} for a, b, k, f in x] for x in found])
            yield batch.loc[some].astype({"doc_id": "Int64"})

    def without(batches):
        for batch in batches:
            yield batch.loc[[not find_entities(t) for t in batch["text"]]].astype({"doc_id": "Int64"})

    def write(batches):
        for batch in batches:
            texts = []
            for text, places in zip(batch["text"], batch["places"]):
                out, at = [], 0
                for p in sorted(places, key=lambda p: p["start"]):
                    out += [text[at:p["start"]], render(p["kind"], text[p["start"]:p["end"]], p["fresh"])]
                    at = p["end"]
                texts.append("".join(out) + text[at:])
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "text": texts,
                                "n_entities": [len(p) for p in batch["places"]],
                                "kinds": [",".join(sorted({x["kind"] for x in p})) for p in batch["places"]]})

    entity = "struct<start: int, end: int, kind: string, form: string>"
    found = stage(plain.mapInPandas(search, f"doc_id long, text string, found array<{entity}>")
                  .withColumn("row", F.monotonically_increasing_id()), "texts-with-entities")
    places = found.select("row", F.inline("found")).withColumn("id", F.concat_ws("\0", "kind", "form"))
    forms = stage(places.groupBy("kind", "form").agg(F.count(F.lit(1)).alias("n")), "forms")
    total = int(forms.agg(F.sum("n")).first()[0] or 0)
    given = stage(assign_surrogates(forms, key).select(F.concat_ws("\0", "kind", "form").alias("id"), "n", "fresh"), "given")
    per_row = join_groups(places.select("row", "start", "end", "kind", "id"), given, "id", "n", total).groupBy("row").agg(
        F.collect_list(F.struct("start", "end", "kind", "fresh")).alias("places"))
    schema = "doc_id long, text string, n_entities long, kinds string"
    replaced = found.select("row", "doc_id", "text").join(per_row, "row").drop("row").mapInPandas(write, schema)
    untouched = plain.mapInPandas(without, "doc_id long, text string").select(
        "doc_id", "text", F.lit(0).cast("long").alias("n_entities"), F.lit("").alias("kinds"))
    return replaced.unionByName(untouched)
