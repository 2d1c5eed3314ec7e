"""Personal data: keyed, type-consistent surrogates that stay distinct across the corpus."""

from __future__ import annotations

import hashlib
import ipaddress
import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textguard.llm.common import Columns, append, texts
from textguard.session import written

#: Surrogates that had to be drawn again, as many as are sent to all workers; more are joined.
BROADCAST = 100_000
#: Draws after which a name that meets no free surrogate is an error.
DRAWS = 64
#: Parts or letters by which made-up names and emails grow at most, one a draw.
LONGER = 16
#: Draws in which an email keeps its length; from then on it grows as names do.
SAME = 3
#: Draws after which an entity of a kind of fixed size takes a free surrogate by walking.
WALK = 6
#: Kinds whose first surrogates are a permutation of all their forms.
_PERMUTED = ("card", "ip", "ip6", "national", "phone", "secret", "ssn")

#: Titles that tell a name, by gender (f, m, or x for either).
TITLES = {
    "f": "Mrs Ms Miss Madam Lady Frau Madame Mme Mademoiselle Señora Sra Señorita Doña Signora Г-жа Госпожа Κυρία",
    "m": "Mr Mister Sir Lord Herr Monsieur Señor Sr Don Signor Г-н Господин Κύριος",
    "x": "Dr Prof Professor",
}
#: Given names that tell a name and its gender without a title.
GIVEN = {
    "f": "Alice Barbara Carol Claudia Diana Elizabeth Emily Emma Françoise Gabriele Helen Isabel Jennifer Jessica "
    "Julia Karen Katharina Laura Linda Lucía Margaret Maria Mary Michelle Monika Nancy Olivia Patricia Petra Rachel "
    "Rebecca Sabine Sandra Sarah Sophie Susan Ursula Victoria Aisha Ananya Carmen Chiara Elif Fatima Giulia Ingrid Mei "
    "Priya Yuki Zeynep Анна Елена Мария Наталья Ольга Татьяна",
    "m": "Alexander Andrew Anthony Benjamin Carlos Charles Christopher Daniel David Edward Frank George Henry Jack "
    "James John Joseph Jürgen Kevin Klaus Luis Mark Matthew Michael Miguel Oliver Patrick Paul Peter Philippe Richard "
    "Robert Samuel Stephen Thomas Walter William Wolfgang Ahmed Arjun Erik Giovanni Hassan Hiroshi Jorge José Juan "
    "Kenji Lars Marco Mehmet Mohammed Muhammad Mustafa Omar Pedro Piotr Rahul Sven Wei Алексей Андрей Дмитрий Иван Михаил Сергей",
}
_GENDER = {name.lower(): g for g, names in GIVEN.items() for name in names.split()}
_TITLED = {title.lower(): g for g, titles in TITLES.items() for title in titles.split()}
#: Titles that also tell a name where they are written in capitals.
_CAPITAL_TITLES = "DR MR MRS PROF Г-Н Г-ЖА".split()


def _letters(category: str) -> str:
    """The Latin, Cyrillic and Greek letters of a category, as the inside of a class."""
    named = re.compile("(?:LATIN|CYRILLIC|GREEK) (?:CAPITAL|SMALL) ")
    return "".join(c for c in map(chr, range(0x10000)) if unicodedata.category(c) == category and named.match(unicodedata.name(c, "")))


_UPPER, _LOWER = _letters("Lu"), _letters("Ll")
#: A part of a name, as in McDonald or O'Brien, and parts joined by hyphens or apostrophes.
_NAME_PART = rf"(?:[{_UPPER}]['’])?(?:[{_UPPER}][{_LOWER}]+)+"
_NAME = rf"{_NAME_PART}(?:[-'’]{_NAME_PART})*"
#: A name in capitals only; two letters are rather an abbreviation.
_CAPITALS = rf"(?:[{_UPPER}]['’])?[{_UPPER}]{{3,}}(?:[-'’][{_UPPER}]{{2,}})*"


def _any(words: list[str]) -> str:
    """A pattern of any of the words, the longest first."""
    return "|".join(sorted(map(re.escape, words), key=len, reverse=True))


_TITLE_WORDS, _GIVEN_WORDS = " ".join(TITLES.values()).split() + _CAPITAL_TITLES, " ".join(GIVEN.values()).split()
_CAPITAL_GIVEN = [name.upper() for name in _GIVEN_WORDS]
_PERSON = re.compile(
    rf"(?<!\w)(?:(?P<title>{_any(_TITLE_WORDS)})\.?[ \t]+"
    rf"(?P<first>{_NAME}(?!\w)|{_CAPITALS})(?:[ \t]+(?P<last>{_NAME}(?!\w)|{_CAPITALS}(?!\w)))?"
    rf"|(?P<given>{_any(_GIVEN_WORDS)})[ \t]+(?P<family>{_NAME}(?!\w)|{_CAPITALS})"
    # In a line of capitals the next word need not be a name: the pair has to end the run.
    rf"|(?P<loud_given>{_any(_CAPITAL_GIVEN)})[ \t]+(?P<loud_family>{_CAPITALS})(?!\w|[ \t]+(?!(?:AND|ET|OR|UND|Y)\b)[{_UPPER}]+(?!\w))"
    rf")(?!\w)"
)
#: A text without any of these words names nobody.
_TELLING = re.compile(rf"(?:{_any(_TITLE_WORDS + _GIVEN_WORDS + _CAPITAL_GIVEN)})(?!\w)")
#: Words that may be a later mention of a name, and words in small letters.
_MENTION = re.compile(rf"(?<!\w)(?:{_NAME}|{_CAPITALS})(?!\w)")
_SMALL = re.compile(rf"(?<!\w)[{_LOWER}]+(?:['’-][{_LOWER}]+)*(?!\w)")
_GAP = r"[\s!*#$%&|.()/-]{0,6}"
#: Patterns by kind, the surest first; a later one takes nothing of an earlier one's match.
_PATTERNS = (
    ("email", "@", re.compile(r"(?<![\w.+%-])[\w.+%-]+@(?:[\w-]+\.)+[^\W\d_]{2,}")),
    ("iban", "", re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")),
    ("secret", "", re.compile(r"(?<!\w)(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?!\w)")),
    ("phone", "+", re.compile(rf"\+1(?:{_GAP}\d){{10}}(?!\d)|\+[2-9]\d{{0,2}}(?:[ ().-]{{0,2}}\d){{7,12}}(?!\d)")),
    ("ip", ".", re.compile(r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d)")),
    ("ip6", ":", re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){1,7}(?::|(?::?[0-9A-Fa-f]{1,4}){1,7})(?![\w:]|\.\d)")),
    (
        "card",
        "",
        re.compile(
            r"(?<![\w-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{5})(?![\w-])"
        ),
    ),
    ("ssn", "-", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")),
    ("phone", "", re.compile(r"(?<![\w+])(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[.-]\d{4}(?!\w)")),
    # With the zero that is dialled inside a country.
    (
        "national",
        "0",
        re.compile(
            r"(?<![\w+.,/-])(?:\(0\d{2,4}\) ?|0\d{2,4}[ -])(?:\d{3,4}[ -]\d{4}|\d{6,8})(?![\w/]|[.,-]\d)"
            r"|(?<![\w+.,/-])(?<!\d )0[1-9](?:([ .])\d{2})(?:\1\d{2}){3}(?![\w/]|[ .,-]\d)"
        ),
    ),
    (
        "street",
        "",
        re.compile(
            rf"(?<![\w.,/-])(?!(?:19|20)\d\d )\d{{1,5}} {_NAME}(?: {_NAME})?"
            r"(?= (?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Boulevard|Blvd|Terrace|Crescent)(?!\w))"
        ),
    ),
)
_DIGIT = re.compile(r"\d")


@dataclass(frozen=True)
class Entity:
    """A mention: its span, its kind, and the form that all mentions of one entity share."""

    start: int
    end: int
    kind: str
    form: str


def detect(text: str) -> list[Entity]:
    """The entities of a text, in order and without overlap."""
    found: list[Entity] = []
    rest = text
    if "@" in text or _DIGIT.search(text):
        for kind, needed, pattern in _PATTERNS:
            if needed and needed not in rest:
                continue
            new = [Entity(*m.span(), kind, form) for m in pattern.finditer(rest) if (form := _form(kind, m[0]))]
            # What is taken is blanked, so that a later pattern can start right behind it.
            for e in new:
                rest = f"{rest[: e.start]}{chr(0) * (e.end - e.start)}{rest[e.end :]}"
            found += new
    if _TELLING.search(rest):
        found += _people(rest)
    return sorted(found, key=lambda e: e.start)


def _people(text: str) -> list[Entity]:
    """Names behind titles and given names, then all other mentions of their parts in the text.

    A part is looked for wherever it stands with a capital letter or in capitals, unless the
    text also has it in small letters, as a word that is no name; known given names are names.
    """
    found: list[Entity] = []
    for m in _PERSON.finditer(text):
        given = "given" if m["given"] else "loud_given" if m["loud_given"] else ""
        if given:
            parts = [(given, _GENDER[m[given].lower()]), (given.replace("given", "family"), "")]
        else:
            gender = _TITLED[m["title"].lower()]
            first = _GENDER.get(m["first"].lower())
            gender = first or gender if gender == "x" else gender
            parts = [("first", gender), ("last", "")] if m["last"] else [("first", "")]
        for group, sex in parts:
            kind = f"given_{sex}" if sex else "surname"
            found.append(Entity(*m.span(group), f"{kind}_{_script(m[group])}", _name_form(m[group])))
    if not found:
        return found
    kinds: dict[str, str] = {}
    for e in found:
        kinds.setdefault(e.form, e.kind)
    taken = {e.start for e in found}
    later = [m for m in _MENTION.finditer(text) if m.start() not in taken and _name_form(m[0]) in kinds]
    if later:
        words = {m[0].replace("’", "'") for m in _SMALL.finditer(text)} - _GENDER.keys()
        found += [Entity(*m.span(), kinds[form], form) for m in later if (form := _name_form(m[0])) not in words]
    return found


def _name_form(surface: str) -> str:
    return surface.lower().replace("’", "'")


def _form(kind: str, surface: str) -> str:
    """What is the same in all spellings of an entity; empty if it is none."""
    if kind in ("email", "secret"):
        return surface.lower()
    if kind == "ip":
        octets = [int(o) for o in surface.split(".")]
        return ".".join(map(str, octets)) if max(octets) < 256 else ""
    if kind == "ip6":
        try:
            address = ipaddress.IPv6Address(surface)
        except ValueError:
            return ""
        return address.compressed if _block(address) else ""
    if kind == "street":
        return _name_form(_ascii(surface))
    if kind == "iban":
        form = _ascii(surface.replace(" ", ""))
        return form if _mod97(form[4:] + form[:4]) == 1 else ""
    digits = _ascii(re.sub(r"\D", "", surface))
    if kind == "phone" and not surface.startswith("+"):
        return "1" + digits  # a local spelling of the same number
    return digits


#: Blocks of addresses that serve one purpose; a surrogate stays in its block.
_BLOCKS = [
    ipaddress.ip_network(block)
    for block in "0.0.0.0/8 10.0.0.0/8 100.64.0.0/10 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.168.0.0/16 224.0.0.0/4 240.0.0.0/4 "
    "2001:db8::/32 2000::/3 fc00::/8 fd00::/8 fe80::/64".split()
]


def _block(address: ipaddress.IPv4Address | ipaddress.IPv6Address) -> ipaddress.IPv4Network | ipaddress.IPv6Network | None:
    """The first listed block that holds the address; IPv6 addresses outside all are no entity."""
    return next((b for b in _BLOCKS if b.version == address.version and address in b), None)


def _ascii(text: str) -> str:
    """The text with the decimal digits of every script as 0 to 9."""
    return text if text.isascii() else "".join(str(int(c)) if c.isdecimal() else c for c in text)


def _script(name: str) -> str:
    return unicodedata.name(name[0]).split(" ")[0].lower()


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


_ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω")
_ALPHABET_OF = {c: a for a in _ALPHABETS for c in a}


def _trait(c: str) -> tuple[str, str, bool]:
    """What the characters of an alphabet have in common: script, category, and keeping both cases apart from others."""
    return unicodedata.name(c, "").split(" ")[0].split("-")[0], unicodedata.category(c), c.lower() == c == c.upper().lower()


@lru_cache(maxsize=2000)
def _alphabet(c: str) -> str:
    """The characters that a character moves among; empty for one that is neither letter nor number.

    Beside the listed alphabets these are the ten digits of a script, and the letters or other
    numbers of one script among 256 neighbouring characters.
    """
    if c in _ALPHABET_OF or not c.isalnum():
        return _ALPHABET_OF.get(c, "")
    if c.isdecimal():
        return "".join(chr(ord(c) - int(c) + i) for i in range(10))
    page, trait = ord(c) & ~255, _trait(c)
    near = map(chr, range(page, page + 256))
    return "".join(n for n in near if n.isalnum() and n not in _ALPHABET_OF and not n.isdecimal() and _trait(n) == trait)


def _round(key: bytes, tweak: str, step: int, value: int) -> int:
    data = f"{tweak}|{step}|{value}".encode()
    return int.from_bytes(hashlib.blake2b(data, key=key, digest_size=32).digest(), "big")


def permuted(key: bytes, tweak: str, value: int, size: int) -> int:
    """A keyed permutation of the numbers below ``size``: a Feistel network, walked until inside."""
    half = max(1, (size - 1).bit_length() + 1 >> 1)
    mask = (1 << half) - 1
    while True:
        left, right = value >> half, value & mask
        for step in range(8):
            # Halves wider than a digest take several.
            wide = sum(_round(key, tweak, step * 64 + i, right) << 256 * i for i in range(half // 256 + 1))
            left, right = right, left ^ wide & mask
        value = left << half | right
        if value < size:
            return value


def _rewritten(key: bytes, tweak: str, text: str, alphabets: list[str]) -> str:
    """The text with each character moved within its alphabet (an empty one keeps it).

    Texts of one pattern of alphabets are permuted, so different ones stay different.
    """
    value, size = 0, 1
    for c, a in zip(text, alphabets, strict=True):
        if a:
            value, size = value * len(a) + a.index(c), size * len(a)
    value = permuted(key, f"{tweak}|{''.join(c if not a else a[0] for c, a in zip(text, alphabets, strict=True))}", value, size)
    out = []
    for c, a in zip(reversed(text), reversed(alphabets), strict=True):
        if a:
            value, at = divmod(value, len(a))
            c = a[at]
        out.append(c)
    return "".join(reversed(out))


def _plain(key: bytes, tweak: str, text: str) -> str:
    return _rewritten(key, tweak, text, [_alphabet(c) for c in text])


def _luhn(digits: str) -> int:
    """The check digit that follows the digits."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


#: Parts of made-up names by script, and endings by gender.
_PARTS = {
    "latin": "al bar cor dan el fin gar hol is jor kal lor mar nor or pel quin ros sel tor ul val wen yor zan bri cle dro fra gri".split(),
    "cyrillic": "ал бар вол гор дан ел жар зор ил кол лад мир нор ор пол рад сол тар ул фад хол чар".split(),
    "greek": "αλ βαρ γορ δαν ελ ζορ ηλ θαλ ιρ καλ λορ μαρ νορ ορ πελ ροσ σελ τορ φιλ χαρ".split(),
}
_ENDS = {
    "latin": {"f": "a ia ine ette", "m": "o an us ert", "x": "e is", "": "son er ley ton ski man"},
    "cyrillic": {"f": "а ия ина", "m": "ей ор ан", "x": "и", "": "ов ин ский енко"},
    "greek": {"f": "α ια ινη", "m": "ος ης ων", "x": "ι", "": "ιδης οπουλος ακης"},
}


def surrogate(key: bytes, kind: str, form: str, draw: int = 0) -> str:
    """The replacement of an entity's form, of the same kind and format, at a draw."""
    tweak = f"{kind}|{draw}"
    if kind == "email":
        local, _, domain = form.rpartition("@")
        name, _, top = domain.rpartition(".")
        if name == "example" or name.endswith(".example"):
            name, top = name[: -len("example")], f"example.{top}"
            name = name.removesuffix(".")
        host = f"{_plain(key, 'host' + tweak, name)}.{top}" if name else top
        # A short name, or one without letters, can be out of free surrogates; it grows.
        seed = _round(key, tweak, 1, int.from_bytes(hashlib.sha256(form.encode()).digest(), "big"))
        grown = "".join(chr(ord("a") + (seed >> 8 * i) % 26) for i in range(min(max(0, draw - SAME), LONGER)))
        return f"{_plain(key, f'{tweak}|{domain}', local)}{grown}@{host}"
    if kind == "secret":
        return _rewritten(key, tweak, form, ["0123456789abcdef"] * len(form))
    if kind in ("ip", "ip6"):
        return _address(key, tweak, ipaddress.ip_address(form)).compressed
    if kind == "national":
        return form[:2] + _plain(key, tweak, form[2:])
    if kind == "street":
        number, _, street = form.partition(" ")
        words = [_made_up(key, f"{tweak}|{i}|{number}", word, "latin", 2 + min(draw, LONGER)) for i, word in enumerate(street.split())]
        return " ".join([_plain(key, f"{tweak}|{street}", number), *words])
    if kind == "iban":
        upper = ["0123456789" if c.isdigit() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in form[4:]]
        body = _rewritten(key, tweak, form[4:], upper)
        return f"{form[:2]}{98 - _mod97(body + form[:2] + '00'):02d}{body}"
    if kind == "card":
        # The distance to the check digit stays, so a valid number stays valid.
        body = _plain(key, tweak, form[:-1])
        return body + str((_luhn(body) + int(form[-1]) - _luhn(form[:-1])) % 10)
    if kind == "phone":
        code = 1 if form[0] in "17" else 2
        return form[:code] + _plain(key, tweak, form[code:])
    if kind == "ssn":
        return _plain(key, tweak, form)
    base, _, script = kind.rpartition("_")
    # Each draw has names one part longer, so that however many are taken some are free.
    count = (2 if base.startswith("given") else 3) + min(draw, LONGER)
    return _made_up(key, tweak, form, script, count, base.removeprefix("given").removeprefix("_") if base != "surname" else "")


def _made_up(key: bytes, tweak: str, form: str, script: str, count: int, gender: str = "") -> str:
    """A name of so many parts and an ending."""
    parts, ends = _PARTS[script], _ENDS[script][gender].split()
    seed = _round(key, tweak, 0, int.from_bytes(hashlib.sha256(form.encode()).digest(), "big"))
    made = []
    for _ in range(count):
        seed, at = divmod(seed, len(parts))
        made.append(parts[at])
    return "".join(made) + ends[seed % len(ends)]


def _address(
    key: bytes, tweak: str, address: ipaddress.IPv4Address | ipaddress.IPv6Address
) -> ipaddress.IPv4Address | ipaddress.IPv6Address:
    """The address moved inside its block, or among those outside all blocks."""
    block = _block(address)
    # An inner block (the documentation prefix) is no target of the block around it.
    base, size = (int(block[0]), block.num_addresses) if block else (0, 1 << 32)
    tweak, value = f"{tweak}|{block}", int(address) - base
    while True:
        value = permuted(key, tweak, value, size)
        moved = type(address)(base + value)
        if _block(moved) == block:
            return moved


def written_as(kind: str, surface: str, made: str) -> str:
    """A surrogate in the spelling of the mention: its case, separators and grouping."""
    if kind in ("email", "secret"):
        return made.upper() if surface.isupper() else made
    if kind == "ip6":
        made = ipaddress.IPv6Address(made).exploded if len(surface) == 39 else made
        return made.upper() if surface.isupper() else made
    if kind == "street":
        # The number may be in other digits; words start with a capital.
        number, _, street = made.partition(" ")
        return " ".join(["".join(_digit_as(d, surface[0]) for d in number), *(w[:1].upper() + w[1:] for w in street.split())])
    if kind == "ip":
        return made if surface.isascii() else "".join(_digit_as(c, surface[0]) for c in made)
    if "_" in kind:
        return made.upper() if surface.isupper() and len(surface) > 1 else made[:1].upper() + made[1:]
    if kind == "phone" and not surface.startswith("+"):
        made = made[1:]
    rest = iter(made)
    return "".join(_digit_as(next(rest), c) if c.isalnum() else c for c in surface)


def _digit_as(digit: str, like: str) -> str:
    """A digit in the script of another one."""
    return chr(ord(like) - int(like) + int(digit)) if digit.isdecimal() and not like.isascii() else digit


@lru_cache(maxsize=50_000)
def _remembered(key: bytes, kind: str, form: str, draw: int) -> str:
    return surrogate(key, kind, form, draw)


def replaced(text: str, key: bytes, draws: dict[str, int | str]) -> tuple[str, int]:
    """The text with surrogates for its entities, and how many mentions it has.

    ``draws`` has a draw, or a surrogate itself, for entities that do not have the first one.
    """
    entities = detect(text)
    if not entities:
        return text, 0
    out, at = [], 0
    for e in entities:
        drawn = draws.get(f"{e.kind}:{e.form}", 0)
        made = drawn if isinstance(drawn, str) else _remembered(key, e.kind, e.form, drawn)
        out += [text[at : e.start], written_as(e.kind, text[e.start : e.end], made)]
        at = e.end
    return "".join([*out, text[at:]]), len(entities)


_FOUND = T.StructField("found", T.ArrayType(T.StringType()))


def entities(frame: DataFrame, text: str = "text") -> DataFrame:
    """Each row's different entities as ``kind:form`` in ``found``."""

    def make() -> Callable[[pa.RecordBatch], Columns]:
        return lambda batch: {
            "found": pa.array(
                [sorted({f"{e.kind}:{e.form}" for e in detect(t)}) for t in texts(batch, text)], pa.list_(pa.string())
            )
        }

    return append(frame, make, [_FOUND])


def redrawn(known: DataFrame, key: bytes) -> DataFrame:
    """``entity``, ``draw`` and ``made`` of the entities that cannot have their first surrogate.

    ``known`` has each entity once in ``entity`` and is a table. A surrogate may be neither an
    entity of the corpus nor another entity's surrogate; of those that meet in one, an entity
    settled earlier keeps it, else the first by name. The others draw again. Names, emails and
    streets grow with the draws, so that a free one exists. Kinds of fixed size can be full of
    known entities: from draw ``WALK`` on their open entities take a surrogate that no other has,
    though the corpus may know it, and ``made`` names it (it is null for drawn ones).
    All checks are joins on the surrogate; nothing is collected. Only kinds that do not grow and
    are not permuted (bank numbers) could run out; that is an error after ``DRAWS`` draws.
    """
    spark = known.sparkSession
    settled, open_, draw = None, known, 0
    while not open_.isEmpty():
        if draw == DRAWS:
            raise RuntimeError(f"no free surrogate in {DRAWS} draws")
        place = F.row_number().over(Window.partitionBy("made").orderBy("entity"))
        tried = _drawn(open_.select("entity"), "entity", key, draw).withColumn("place", place)
        tried = tried.join(known.select(F.col("entity").alias("made"), F.lit(True).alias("real")), "made", "left")
        if settled is not None:
            tried = tried.join(settled.select("made", F.lit(True).alias("had")), "made", "left")
        else:
            tried = tried.withColumn("had", F.lit(None).cast("boolean"))
        tried = written(tried, "surrogates")
        good = (F.col("place") == 1) & F.col("real").isNull() & F.col("had").isNull()
        fine = tried.filter(good).select("entity", "made", F.lit(draw).alias("draw"), F.lit(False).alias("walked"))
        settled = fine if settled is None else settled.unionByName(fine)
        open_, draw = tried.filter(~good).select("entity"), draw + 1
        if draw == WALK:
            permuted_kind = F.substring_index("entity", ":", 1).isin(*_PERMUTED)
            settled = settled.unionByName(_walked(open_.filter(permuted_kind), settled, key))
            open_ = open_.filter(~permuted_kind)
    if settled is None:
        return spark.createDataFrame([], "entity string, draw int, made string")
    made = F.when(F.col("walked"), F.expr("substring(made, locate(':', made) + 1)"))
    return settled.filter("draw > 0 or walked").select("entity", "draw", made.alias("made"))


def _drawn(frame: DataFrame, entity: str, key: bytes, draw: int) -> DataFrame:
    """The frame with the surrogate of an entity at a draw in ``made``, with its kind."""

    def make() -> Callable[[pa.RecordBatch], Columns]:
        def columns(batch: pa.RecordBatch) -> Columns:
            parts = [e.partition(":") for e in batch.column(batch.schema.get_field_index(entity)).to_pylist()]
            return {"made": pa.array([f"{k}:{surrogate(key, k, f, draw)}" for k, _, f in parts], pa.string())}

        return columns

    return append(frame, make, [T.StructField("made", T.StringType())])


def _walked(open_: DataFrame, settled: DataFrame, key: bytes) -> DataFrame:
    """Surrogates of entities of permuted kinds, different from all settled ones and each other.

    An entity tries its first surrogate; where that is taken, it goes on with the first surrogate
    of the entity that has it. First surrogates are a permutation and settled ones are different,
    so no two walks meet and each ends. At most half of a kind's forms are settled, as these
    are no known entities, so the walks still open halve with every step.
    """
    owners = settled.select("made", F.col("entity").alias("owner"))
    at, done = open_.select("entity", F.col("entity").alias("at")), None
    while done is None or not at.isEmpty():
        step = written(_drawn(at, "at", key, 0).join(owners, "made", "left"), "walks")
        free = step.filter("owner is null").select("entity", "made", F.lit(0).alias("draw"), F.lit(True).alias("walked"))
        done = free if done is None else done.unionByName(free)
        at = step.filter("owner is not null").select("entity", F.col("owner").alias("at"))
    return done


def pseudonymised(frame: DataFrame, key: bytes, text: str = "text", count: str = "n_entities") -> DataFrame:
    """The frame with surrogates in its text, and the number of mentions in ``count``.

    Emails, phone, card, bank and social security numbers, addresses of machines and streets,
    long hex secrets and names of people are found by pattern. Names are found behind titles and
    listed given names; once found, all mentions of their parts in the text are. The same entity
    gets the same surrogate everywhere, whatever its spelling, and different ones stay different.
    Names keep gender and script, numbers their grouping and check digits, addresses of machines
    their block. Without the key surrogates tell nothing.
    A null text stays null with 0 mentions, text outside mentions stays as it is, repeated rows
    give repeated results; a column named as ``count`` is replaced. The frame is read twice.
    """
    found = entities(frame.select(text), text).select(F.explode("found").alias("entity")).distinct()
    exceptions = written(redrawn(written(found, "entities"), key), "redrawn")
    fields = [T.StructField(text, T.StringType()), T.StructField(count, T.LongType())]
    if exceptions.limit(BROADCAST + 1).count() <= BROADCAST:
        draws = {r.entity: r.made or r.draw for r in exceptions.collect()}
        shared = frame.sparkSession.sparkContext.broadcast(draws)
        return append(frame, lambda: _replacer(key, text, count, shared.value), fields)
    # Too many for every worker: each text gets the draws of its own entities.
    hashed, own = _unused(frame, "__text"), _unused(frame, "__draws")
    marked = frame.withColumn(hashed, F.sha2(F.col(text), 256))
    found = entities(marked.select(hashed, text).dropDuplicates([hashed]), text)
    found = found.select(hashed, F.explode("found").alias("entity")).join(exceptions, "entity")
    drawn = F.struct("entity", F.struct("draw", "made").alias("drawn"))
    found = found.groupBy(hashed).agg(F.map_from_entries(F.collect_list(drawn)).alias(own))
    joined = marked.join(found, hashed, "left")
    return append(joined, lambda: _replacer(key, text, count, None, own), fields).drop(hashed, own)


def _unused(frame: DataFrame, name: str) -> str:
    """The name, made longer until the frame has no column of it in any letter case."""
    taken = {c.lower() for c in frame.columns}
    while name in taken:
        name += "_"
    return name


def _replacer(
    key: bytes, text: str, count: str, draws: dict[str, int | str] | None, own_draws: str = ""
) -> Callable[[pa.RecordBatch], Columns]:
    def columns(batch: pa.RecordBatch) -> Columns:
        values = batch.column(batch.schema.get_field_index(text)).to_pylist()
        if draws is None:
            rows = batch.column(batch.schema.get_field_index(own_draws)).to_pylist()
            own = [{entity: drawn["made"] or drawn["draw"] for entity, drawn in r or []} for r in rows]
        else:
            own = [draws] * len(values)
        made = [(None, 0) if v is None else replaced(v, key, d) for v, d in zip(values, own, strict=True)]
        new, counts = zip(*made, strict=True)
        return {text: pa.array(new, pa.string()), count: pa.array(counts, pa.int64())}

    return columns
