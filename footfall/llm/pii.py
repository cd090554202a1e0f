"""Personal data: every entity gets a keyed surrogate of its own kind and shape.

Found are e-mail addresses, telephone numbers, card numbers that pass the Luhn check, bank accounts (IBAN)
that pass theirs, IPv4 and IPv6 addresses, social security numbers, secrets (long hex strings, access keys with a
known prefix) and persons: names of one to four words after a title or several, with initials, `Mc`, `O'`, `van`
and the like, or two words in capitals after a title in capitals. White space is any, and a title
may be at the end of a line. In a text with such a name the same full name, its family name and its first given
name are found without a title, too; a given name of two persons counts as the first one's. Names in
scripts without case, and names that no title introduces anywhere in the text, are not found. Telephone numbers
begin with a plus or 00, have an area code with a nought or in brackets, are of the shape 555-123-4567,
or follow a word such as `tel`; other groups of digits, such as years, are not.

A surrogate is drawn from a keyed hash of the entity's canonical form: letters stay letters of the
same script and case, digits stay digits, hex stays hex, separators and known prefixes stay; cards keep their issuer
and telephones and accounts their country; cards and accounts still pass their checks; addresses
stay valid and in their private range, while that has any left. The canonical form has no title, separators
or case where these don't distinguish, so one entity gets one surrogate however it is written.

A person's given and family names have surrogates of their own, the family name one for all who bear
it and the given names one for each full name, of the gender that titles (or else the name) tell over
the whole corpus. So `Mr Thomas Braun`, `Thomas Braun` and `Herr Braun` stay one person.

All surrogates are checked over the whole corpus: where two of a kind coincide (given names: of one
family), or one is itself an entity of the corpus, all but the first draw again until none do. After
some draws the forms get longer, so that short ones don't run out; addresses, which have no longer
form, have four billion.

Null and empty texts stay as they are; very long ones are read whole. Overlapping finds are resolved
by kind, in the order of `KINDS`, then by place. Null ids and ids that repeat make no difference:
rows that agree in doc_id and text are changed alike, others by their own text. Other columns stay,
whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable, plain

#: Given names by gender and script.
GIVEN = {
    ("m", "latin"): ["Adam", "Bruno", "Carlos", "David", "Emil", "Felix", "George", "Hugo", "Ivan", "Jonas", "Karl", "Louis", "Martin", "Oscar", "Paul", "Thomas"],
    ("f", "latin"): ["Anna", "Bianca", "Clara", "Diana", "Emma", "Flora", "Greta", "Helena", "Irene", "Julia", "Laura", "Maria", "Nora", "Olivia", "Paula", "Sofia"],
    ("m", "cyrillic"): ["Алексей", "Борис", "Виктор", "Дмитрий", "Иван", "Николай", "Павел", "Сергей"],
    ("f", "cyrillic"): ["Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Ольга", "Софья"],
    ("m", "greek"): ["Γιώργος", "Δημήτρης", "Κώστας", "Νίκος", "Παύλος", "Πέτρος"],
    ("f", "greek"): ["Άννα", "Ελένη", "Ειρήνη", "Κατερίνα", "Μαρία", "Σοφία"],
}
#: Titles by gender.
TITLES = {"m": ["Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος"], "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа", "Κυρία"], "n": ["Dr", "Prof"]}
#: Words within a family name, and prefixes of access keys.
PARTICLES = ["van", "von", "de", "der", "den", "da", "di", "la", "le", "dos", "del", "du"]
PREFIXES = ["AKIA", "ASIA", "ghp_", "gho_", "ghs_", "ghu_", "glpat-", "xoxb-", "xoxp-", "sk_live_", "sk-"]

UPPER, LOWER = "A-ZÀ-ÖØ-ÞА-ЯЁΆΈ-ΏΑ-Ω", "a-zß-öø-ÿа-яёάέ-ώα-ω"
SPACE = r"[^\S\n]+"
#: White space that may end a line, but no paragraph.
GAP = r"(?:[^\S\n]+(?:\n[^\S\n]*)?|\n[^\S\n]*)"
PART = rf"(?:(?:Mc|Mac|O['’]|D['’])(?=[{UPPER}]))?[{UPPER}][{LOWER}]+"
NAME = rf"{PART}(?:-{PART})?"
INITIALS = rf"[{UPPER}]\.(?:[^\S\n]?[{UPPER}]\.)*"
NAMES = rf"(?:{INITIALS}{SPACE})?{NAME}(?:{SPACE}(?:{INITIALS}{SPACE})?{NAME}|(?:{SPACE}(?:{'|'.join(PARTICLES)}))+{SPACE}{NAME}){{0,3}}"
CAPITALS = rf"[{UPPER}]{{2,}}(?:[-'’][{UPPER}]{{2,}})?"
ALL_TITLES = [t for v in TITLES.values() for t in v]
DEGREES = r"(?:-Ing\.)?(?:[^\S\n]*(?:med|phil|rer|nat|jur|ing|pol|oec|vet|dent|habil|h|c)\.)*"
INTRODUCED = [
    re.compile(rf"(?<!\w)((?:(?:{'|'.join(ALL_TITLES)})\.?{DEGREES}{GAP})+)({NAMES})(?!\w)"),
    re.compile(rf"(?<!\w)((?:(?:{'|'.join(t.upper() for t in ALL_TITLES)})\.?{GAP})+)({CAPITALS}(?:{SPACE}{CAPITALS})?)(?!\w)"),
]
#: Country codes of telephones with one or two digits; all others have three.
COUNTRIES = {"1", "7", *"20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()}
#: Telephone numbers, the number as the group: with a country, with an area code, of American shape, after a word.
PHONES = [
    re.compile(r"(?<![\w+])((?:\+|00)[1-9](?:[ ./-]?\(?\d+\)?)+)(?![\w-])"),
    re.compile(r"(?<![\w+])(\(0?\d{2,4}\)[ ./-]?\d{3,4}[ .-]?\d{3,5})(?![\w-])"),
    re.compile(r"(?<![\w+.,/-])(0\d{2,4}[ /-]\d{3,4}[ -]?\d{3,4})(?![\w-])"),
    re.compile(r"(?<![\w+.,-])(\d{3}([.-])\d{3}\2\d{4})(?![\w-])"),
    re.compile(r"(?i)(?<!\w)(?:tel|telephone|phone|call|fax|mobile|cell|mobil|telefon|téléphone|teléfono|móvil)\.?:?[^\S\n]{1,2}(\(?\d{2,5}\)?(?:[ ./-]?\d{2,5}){1,3})(?![\w-])"),
]
#: What every telephone number has; texts without it are not searched for any.
DIGITS = re.compile(r"\d[\d ()./-]{5,}")
YEAR = re.compile(r"(?<!\d)(?:19|20)\d\d(?!\d)")
OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
HEX4 = r"[0-9A-Fa-f]{1,4}"
KINDS = {
    "email": r"(?<![\w.+-])[\w][\w.+-]*@(?:[^\W_](?:[\w-]*[^\W_])?\.)+[^\W\d_]{2,}(?![\w-])",
    "token": rf"(?<![0-9A-Za-z_-])(?:{'|'.join(map(re.escape, PREFIXES))})[0-9A-Za-z_-]{{16,}}(?![0-9A-Za-z])",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z])",
    "ip6": rf"(?<![\w:.])(?:(?:{HEX4}:){{7}}{HEX4}|(?:{HEX4}:){{1,6}}(?::{HEX4}){{1,6}}|(?:{HEX4}:){{2,7}}:)(?![\w:.])",
    "ip": rf"(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?![\d.]\d|\d)",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?:[ ]?[0-9A-Z]{4}){2,7}(?:[ ]?[0-9A-Z]{1,3})?(?!\w)",
    "card": r"(?<![\d-])(?:3[47]\d{2}[ -]?\d{6}[ -]?\d{5}|\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7})(?![\d-])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": PHONES[0].pattern,
    "person": INTRODUCED[0].pattern,
}
FINDERS = {k: re.compile(p) for k, p in KINDS.items()}
#: What a text must contain for a kind to be searched in it.
HINTS = {"email": ["@"], "token": PREFIXES, "ip6": [":"], "ip": ["."], "ssn": ["-"], "person": [*ALL_TITLES, *map(str.upper, ALL_TITLES)]}
#: First and last letters of scripts, small ones where there is case.
SCRIPTS = ["az", "ая", "αω", "աֆ", "את", "ابي", "अह", "กฮ", "აჰ", "ぁん", "ァン", "가힣", "一龥"]
#: Entities with their surrogates that may be broadcast, and rows to leave alone or change; more are joined by a shuffle.
MOST_BROADCAST = 200_000
#: From this draw on forms get longer.
LONGER = 8


def luhn(digits: str) -> bool:
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def sums_up(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def cased(word: str) -> str:
    """A word in capitals as it is usually written."""
    return word.title() if len(word) > 1 and word.isupper() and "." not in word else word


def canonical(kind: str, found: str) -> str:
    if kind == "phone":
        digits = re.sub(r"\D", "", found)
        return "+" + digits.removeprefix("00") if found.startswith(("+", "00")) else digits
    if kind in ("card", "ssn"):
        return re.sub(r"\D", "", found)
    if kind == "iban":
        return found.replace(" ", "")
    if kind in ("given", "family"):
        return " ".join(map(cased, found.split()))
    return found.lower() if kind in ("email", "secret", "ip6") else found


def phones(text: str) -> list[tuple[int, int, str, str, str, str]]:
    out = []
    for n, finder in enumerate(PHONES if DIGITS.search(text) else ()):
        for m in finder.finditer(text):
            digits = re.sub(r"\D", "", m[1])
            if 7 <= len(digits) - 2 * (n == 0 and m[1][0] == "0") <= 15 and not (n in (2, 4) and YEAR.search(m[1])):
                out.append((*m.span(1), "phone", m[1], canonical("phone", m[1]), "n"))
    return apart(sorted(out, key=lambda x: (x[0], -x[1])))


def apart(finds: list[tuple]) -> list[tuple]:
    """The finds that don't begin before an earlier one ends."""
    out: list[tuple] = []
    for x in finds:
        if not out or x[0] >= out[-1][1]:
            out.append(x)
    return out


def divided(name: str) -> tuple[str, str]:
    """Given and family names; particles belong to the family name, and so does a name of one word."""
    words = name.split(" ")
    at = next((i for i, w in enumerate(words) if w in PARTICLES), len(words) - 1)
    return " ".join(words[:at]), " ".join(words[at:])


def gender_of(titles: str, given: str) -> str:
    first, words = given.split(" ")[0], {cased(w) for w in re.findall(r"\w+", titles)}
    own = [g for g in "mf" if words & set(TITLES[g])] or [g for g, script in GIVEN if first in GIVEN[g, script]]
    return own[0] if own else "n"


def persons(text: str) -> list[tuple[int, int, str, str, str, str]]:
    """Names that a title introduces, and these, their family and first given names wherever else they are in the text."""
    genders: dict[str, str] = {}
    for finder in INTRODUCED:
        for m in finder.finditer(text):
            name = canonical("family", m[2])
            if genders.get(name, "n") == "n":
                genders[name] = gender_of(m[1], divided(name)[0])
    forms: dict[str, tuple[str, str]] = {}
    for name in genders:
        forms[name] = ("full", name)
    for name in genders:
        forms.setdefault(divided(name)[1], ("family", divided(name)[1]))
    for name in genders:
        first = divided(name)[0].split(" ")[0]
        if len(first) > 2 and "." not in first:
            forms.setdefault(first, ("given", name))
    if not forms:
        return []
    spelt = {v for form in forms for v in (form, form.upper())}
    known = re.compile(r"(?<![\w-])(?:" + "|".join(GAP.join(map(re.escape, v.split(" "))) for v in sorted(spelt, key=lambda v: (-len(v), v))) + r")(?![\w-])")
    out = []
    for m in known.finditer(text):
        how, name = forms[canonical("family", m[0])] if canonical("family", m[0]) in forms else forms[next(f for f in forms if f.upper() == " ".join(m[0].split()))]
        given, family = divided(name)
        words = [(m.start() + w.start(), m.start() + w.end()) for w in re.finditer(r"\S+", m[0])]
        n = len(words) if how == "given" else len(given.split()) if how == "full" else 0
        for kind, some, canon, gender in (("given", words[:n], name, genders.get(name, "n")), ("family", words[n:], family, "n")):
            if some:
                s, e = some[0][0], some[-1][1]
                out.append((s, e, kind, text[s:e], canon, gender))
    return out


def found_in(text: str) -> list[tuple[int, int, str, str, str, str]]:
    """(start, end, kind, as written, canonical, gender), in order and apart from each other."""
    out: list[tuple[int, int, str, str, str, str]] = []
    taken: list[tuple[int, int]] = []
    for kind, finder in FINDERS.items():
        if not any(h in text for h in HINTS.get(kind, [""])):
            continue
        if kind in ("person", "phone"):
            finds = persons(text) if kind == "person" else phones(text)
        else:
            finds = [(*m.span(), kind, m[0], canonical(kind, m[0]), "n") for m in finder.finditer(text)]
            finds = [x for x in finds if (kind != "ip6" or re.search(r"\d", x[4])) and (kind != "iban" or sums_up(x[4]))]
        own, at = [], 0
        for x in finds:
            while at < len(taken) and taken[at][1] <= x[0]:
                at += 1
            if at == len(taken) or taken[at][0] >= x[1]:
                own.append(x)
        out += [x for x in own if kind != "card" or luhn(x[4])]  # other numbers of that shape stay, and aren't telephones
        taken = sorted([*taken, *[x[:2] for x in own]])
    return sorted(out)


def draws(key: str, kind: str, canon: str, attempt: int) -> Iterator[int]:
    secret, n = hashlib.blake2b(key.encode()).digest(), 0  # keys of any length count in full
    while True:
        yield from hashlib.blake2b(f"{kind}\0{canon}\0{attempt}\0{n}".encode(), key=secret).digest()
        n += 1


@cache
def letters_of(script: str) -> str:
    low, high = script
    return "".join(c for c in map(chr, range(ord(low), ord(high) + 1)) if c.isalpha() and (c.islower() or low.lower() == low.upper()))


def like(c: str, draw: Iterator[int], letters: str = "") -> str:
    """A character of the same script, case and sort; `letters` are those of hex digits."""
    if c.isdigit():
        return str(next(draw) % 10)
    if not c.isalpha():
        return c
    letters = letters or letters_of(next((s for s in SCRIPTS if s[0] <= c.lower() <= s[1]), SCRIPTS[0]))
    new = letters[(next(draw) * 256 + next(draw)) % len(letters)]
    return new.upper() if c.isupper() else new


def given_names(canon: str, scope: str, gender: str, attempt: int, draw: Iterator[int]) -> str:
    """As many given names as there were, of the same script and gender; later draws have double names."""
    own = canon[: -len(scope) - 1]
    script = "cyrillic" if re.search("[А-яЁё]", own) else "greek" if re.search("[Ά-ώ]", own) else "latin"
    pool = GIVEN.get((gender, script)) or GIVEN["m", script] + GIVEN["f", script]
    while True:
        new = ["".join(like(c, draw) for c in w) if "." in w else pool[next(draw) % len(pool)] for w in own.split(" ")]
        more = [pool[next(draw) % len(pool)] for _ in range(attempt // LONGER)]
        new[-1] = new[-1] + "".join(f"{x[0]}." for x in more) if "." in new[-1] else "-".join([new[-1], *more])
        if " ".join(new) != own:
            return " ".join(new)


def private(address: str) -> list[str]:
    """The leading octets that make an address private, local or shared."""
    a, b = address.split(".")[:2]
    pair = (a, b) in (("192", "168"), ("169", "254")) or a == "172" and 16 <= int(b) < 32 or a == "100" and 64 <= int(b) < 128
    return [a] if a in ("10", "127", "0") else [a, b] if pair else []


def country(digits: str) -> str:
    return next((digits[:n] for n in (1, 2) if digits[:n] in COUNTRIES), digits[:3])


def surrogate(key: str, kind: str, canon: str, attempt: int, scope: str = "", gender: str = "n") -> str:
    """The canonical surrogate of a canonical entity."""
    draw = draws(key, kind, canon, attempt)
    longer = lambda c, letters="": "".join(like(c, draw, letters) for _ in range(attempt // LONGER))
    if kind == "given":
        return given_names(canon, scope, gender, attempt, draw)
    if kind == "ip":
        own = private(canon) if attempt < 2 * LONGER else []
        while True:
            new = [*own, *[str(1 + next(draw) % 254) for _ in range(4 - len(own))]]
            if own or not private(".".join(new)) and int(new[0]) < 224:
                return ".".join(new)
    if kind == "email":
        local, domain = canon.split("@")
        *labels, last = domain.split(".")
        return "".join(like(c, draw) for c in local) + longer("a") + "@" + ".".join("".join(like(c, draw) for c in x) for x in labels) + "." + last
    if kind in ("secret", "ip6"):
        return "".join(like(c, draw, "abcdef") for c in canon) + (longer("a", "abcdef") if kind == "secret" else "")
    if kind == "token":
        start = next(p for p in PREFIXES if canon.startswith(p))
        return start + "".join(like(c, draw) for c in canon[len(start) :]) + longer("0")
    if kind == "card":
        issuer = {"3": 2, "5": 2, "6": 4, "2": 4}.get(canon[0], 1)
        out = canon[:issuer] + "".join(like(c, draw) for c in canon[issuer:-1])
        return next(out + str(d) for d in range(10) if luhn(out + str(d)))
    if kind == "iban":
        rest = "".join(like(c, draw) for c in canon[4:])
        return next(x for n in range(2, 99) if sums_up(x := f"{canon[:2]}{n:02d}{rest}"))
    if kind in ("phone", "ssn"):
        keep = 1 + len(country(canon[1:])) if canon[0] == "+" else canon[0] == "0"
        return canon[:keep] + "".join(like(c, draw) for c in canon[keep:]) + longer("0")
    return " ".join(w if w in PARTICLES else "".join(like(c, draw) for c in w) for w in canon.split(" ")) + longer("a")


def shaped(kind: str, canon: str, written: str) -> str:
    """A canonical surrogate in the shape of what it replaces."""
    if kind in ("card", "phone", "ssn", "iban"):
        signs = iter(canon.removeprefix("+"))
        begin = 2 if kind == "phone" and written.startswith("00") else 0
        return written[:begin] + re.sub(r"[0-9A-Z]" if kind == "iban" else r"\d", lambda _: next(signs), written[begin:]) + "".join(signs)
    if kind in ("email", "secret", "ip6"):
        return canon.upper() if written.isupper() else canon
    if kind in ("given", "family"):
        new, parts = canon.split(" "), re.split(r"(\s+)", written)
        words = len(parts) // 2 + 1
        if words <= len(new):  # a given name may stand for all of a person's
            parts[::2] = new[:words]
            canon = "".join(parts)
        return canon.upper() if written.isupper() and len(written) > 1 and "." not in written else canon
    return canon


FOUND = {"start": "int", "end": "int", "kind": "string", "written": "string", "canon": "string", "scope": "string", "gender": "string"}
SPANS = f"array<struct<{','.join(f'{k}:{v}' for k, v in FOUND.items())}>>"
ENTITY = ["kind", "canon", "scope", "gender", "attempt"]


def finds(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, spans) for the texts that have any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(k, pa.int32() if v == "int" else pa.string()) for k, v in FOUND.items()]))
        for b in batches:
            keep, spans = [], []
            for i, text in enumerate(b.column(2).to_pylist()):
                if text and (own := found_in(text)):
                    keep.append(i)
                    spans.append([dict(zip(FOUND, (s, e, k, w, c, divided(c)[1] if k == "given" else "", g), strict=True)) for s, e, k, w, c, g in own])
            some = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(some), b.column(1).take(some), pa.array(spans, kind)], ["doc_id", "row_key", "spans"])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(run, f"doc_id long, row_key long, spans {SPANS}")


def row_key():
    return F.xxhash64("doc_id", "text")


def drawn(entities: DataFrame, key: str) -> DataFrame:
    """The entities with `new`, their surrogates of this attempt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b.column(i) for i in range(len(ENTITY))]
            new = [surrogate(key, kind, canon, attempt, scope, gender) for kind, canon, scope, gender, attempt in zip(*(c.to_pylist() for c in cols), strict=True)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(new, pa.string())], [*ENTITY, "new"])

    return entities.select(*ENTITY).mapInArrow(run, "kind string, canon string, scope string, gender string, attempt int, new string")


def surrogates(entities: DataFrame, key: str, rounds: int = 64) -> DataFrame:
    """(kind, canon, new) for distinct entities (kind, canon, and scope and gender of given names).

    No two entities of a kind and scope share a surrogate, and none is itself an entity.
    """
    entities = entities.withColumns({c: F.lit(v) for c, v in (("scope", ""), ("gender", "n")) if c not in entities.columns})
    now = durable(drawn(entities.withColumn("attempt", F.lit(0)), key))
    for _ in range(rounds):
        shared = now.groupBy("kind", "scope", "new").agg(F.min("canon").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
        again = now.join(shared, ["kind", "scope", "new"]).filter("canon <> first").select("kind", "canon")
        taken = now.select("kind", F.col("canon").alias("new")).distinct()
        bad = durable(again.union(now.join(taken, ["kind", "new"], "left_semi").select("kind", "canon")).distinct())
        if bad.isEmpty():
            return now.select("kind", "canon", "new")
        stay = now.join(bad, ["kind", "canon"], "left_anti")
        redone = now.join(bad, ["kind", "canon"], "left_semi").withColumn("attempt", F.col("attempt") + 1)
        now = durable(stay.union(drawn(redone, key)))
    raise ValueError("surrogates still coincide; a kind without longer forms has about as many entities as there are")


def replace(docs: DataFrame, key: str) -> DataFrame:
    """docs with the surrogates in their texts, and `entities replaced` at the end, for a column of that name."""
    docs = docs.drop("entities replaced")
    spans = durable(finds(docs))
    each = spans.select("doc_id", "row_key", F.explode(F.array_distinct("spans")).alias("s"))
    has = lambda g: F.max(F.col("s.gender") == g)
    gender = F.when(has("m") & ~has("f"), "m").when(has("f") & ~has("m"), "f").otherwise("n")
    table = surrogates(each.groupBy("s.kind", "s.canon", "s.scope").agg(gender.alias("gender")), key).withColumnsRenamed({"kind": "kind_of", "canon": "canon_of"})
    small = lambda df: F.broadcast(df) if df.count() <= MOST_BROADCAST else df
    known = each.join(small(table), (F.col("s.kind") == F.col("kind_of")) & (F.col("s.canon") == F.col("canon_of")))
    edits = known.groupBy(F.col("doc_id").alias("id of"), F.col("row_key").alias("key of")).agg(F.array_sort(F.collect_set(F.struct("s.start", "s.end", "s.kind", "s.written", "new"))).alias("edits made"))
    edits = durable(edits)

    names = [*docs.columns, "entities replaced"]
    renamed = plain(docs, "doc_id", "text")
    all_of = [F.col(p).alias(c) for p, c in zip(renamed.columns, docs.columns, strict=True)]
    keyed = renamed.withColumn("row key", row_key())
    same = lambda of: F.col("doc_id").cast("long").eqNullSafe(F.col(of[0])) & (F.col("row key") == F.col(of[1]))
    if edits.count() <= MOST_BROADCAST:  # only texts with finds are shuffled
        keys = F.broadcast(edits.select(F.col("id of").alias("touched id"), F.col("key of").alias("touched key")))
        rest = keyed.join(keys, same(("touched id", "touched key")), "left_anti").select(*all_of, F.lit(0).alias("entities replaced"))
        both = keyed.join(keys, same(("touched id", "touched key")), "left_semi").join(edits, same(("id of", "key of")))
    else:
        rest, both = None, keyed.join(edits, same(("id of", "key of")), "left")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, counts = [], []
            for text, edits in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                parts, done = [], 0
                for e in edits or []:
                    parts += [text[done : e["start"]], shaped(e["kind"], e["new"], e["written"])]
                    done = e["end"]
                texts.append("".join([*parts, text[done:]]) if edits else text)
                counts.append(len(edits or []))
            cols = [b.column(i) for i in range(b.num_columns - 1)]
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(counts, pa.int32())], names=names)

    schema = T.StructType([*docs.schema.fields]).add("entities replaced", "integer")
    done = both.select(*renamed.columns, "edits made").mapInArrow(run, schema)
    return done if rest is None else rest.union(done)
