"""Personal data: entities are found and replaced by keyed surrogates of the same type and format."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructType

from .shared import Workspace, map_batches, pieces, table

KEY = "tidemark-surrogates"
#: Entities with a surrogate of another that are moved in one round.
MOVED = 100_000

#: Given names by (script, gender) and family names by script. A name is replaced by another of its own list.
GIVEN = {
    ("latin", "f"): "Alice Anna Carmen Charlotte Clara Elena Emily Emma Heidi Ingrid Isabel Jane Julia Laura Lucia Maria Marie Mary Nina Olivia Sarah Sofia Susan Ursula".split(),
    ("latin", "m"): "Adam Antonio Carlos Daniel David Felix Hans Henry Jack James Jean John Jorge Juan Klaus Louis Luis Michael Oliver Pablo Peter Pierre Robert Thomas".split(),
    ("cyrillic", "f"): "Анна Вера Дарья Елена Ирина Мария Наталья Ольга Светлана Татьяна".split(),
    ("cyrillic", "m"): "Алексей Андрей Борис Виктор Дмитрий Иван Михаил Николай Павел Сергей".split(),
}
FAMILY = {
    "latin": "Becker Bernard Brown Davis Dubois Evans Fischer Garcia Johnson Jones Laurent Lopez Martin Martinez Meyer Miller Moreau Schmidt Schneider Smith Taylor Weber Williams Wilson".split(),
    "cyrillic": "Волков Иванов Козлов Кузнецов Новиков Петров Попов Смирнов Соколов Фёдоров".split(),
}
#: Titles that a name may follow.
TITLES = frozenset("mr mrs ms miss dr prof sir herr frau mme mlle monsieur madame señor señora don doña господин госпожа".split())
#: Words that are capitalised without being names: they end a run of capitalised words.
COMMON = frozenset(
    "a an and are as at be but by can could did do does for from had has have he her here his how i if in into is it its may my no not of on or our she should so some such that the their them then there these they this those to was we were what when where which who why will with would you your "
    "der die das den dem des ein eine einer und oder ist sind war hat mit von zu im am auf für als auch es er sie wir ihr nicht "
    "le la les un une des du de et ou est sont était avec pour dans sur par il elle nous vous ils ne pas que qui "
    "el los las una unos y o es son fue con para en por su se que no del al "
    "january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday".split()
)
#: Words of names of other things: licences, firms, places, offices.
THINGS = frozenset(
    "license licence public general university institute college school company corporation inc ltd llc gmbh ag foundation association society committee department ministry office agency bank church museum library hospital street avenue road square park river lake mountain island city county state states republic kingdom union "
    "north south east west new great international national world terms service services privacy policy agreement software copyright version chapter section table figure part volume press journal news times house project".split()
)
#: Words before and after a name.
BEFORE = frozenset("by from contact named name called author dear hi hello signed with to and met ask told von für par por a".split())
AFTER = frozenset("said says wrote asked born lives lived works worked met called told replied thinks went is was has had will who lebt sagte dit dijo vit".split())
#: What each feature of a run of capitalised words adds; a run of LEAST or more is a name.
WEIGHTS = {"several": 1.5, "title": 3.0, "given": 2.0, "before": 0.5, "after": 0.5, "starts": -1.0, "alone": -1.0, "ordinary": -2.0, "thing": -4.0, "capitals": -2.0, "short": -1.5, "again": -4.0, "heading": -1.5}
LEAST = 1.0

_ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω")
_CLASS = {c: a for a in _ALPHABETS for c in a}
_HEX = "0123456789abcdef"
#: Blocks of scripts without case whose letters take each other's place; elsewhere blocks have 128 code points.
_BLOCKS = ((0x4E00, 0xA000), (0x3400, 0x4DC0), (0xAC00, 0xD7A4), (0x20000, 0x2A6E0))
_PREFIXES = ("AKIA", "ASIA", "ghp_", "sk-", "xoxb-", "xoxp-")

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_EMAIL = re.compile(r"(?<![\w.%+-])[\w.%+-]++@[\w-]++(?:\.[\w-]++)+")
_NUMBER = re.compile(
    rf"(?P<ip>(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?![\w]|\.\d))"
    r"|(?P<phone>(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<![\w(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-]))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<account>(?<![\w.])\d(?:[ -]?\d){12,18}(?!\d))"
)
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_SECRET = re.compile(r"(?i:(?<![a-z])(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key))[\"']?\s*[=:]\s*[\"']?(?P<value>[A-Za-z0-9_/+=.-]{6,})|(?P<aws>(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9]))|(?P<key>(?<![A-Za-z0-9])(?:ghp_|sk-|xox[bp]-)[A-Za-z0-9-]{16,})")
_UPPER = "A-ZÀ-ÖØ-ÞĀ-ŽΑ-ΩА-ЯЁ"
#: Runs of words, the first of which is capitalised, as later ones are.
_RUN = re.compile(rf"(?<![\w'’-])[{_UPPER}][\w'’-]*+(?:\.? [{_UPPER}][\w'’-]*+)*+")
_WORD = re.compile(r"[^\W\d_][\w'’-]*+")
_DIGIT = re.compile(r"\d")


@lru_cache(maxsize=1 << 14)
def alphabet(c: str) -> str | None:
    """The characters that may take c's place: those of its script and kind, c included. None where c stays."""
    if c in _CLASS:
        return _CLASS[c]
    kind = unicodedata.category(c)
    if kind[0] != "L" and kind != "Nd":
        return None
    low, high = next((b for b in _BLOCKS if b[0] <= ord(c) < b[1]), (ord(c) & ~0x7F, (ord(c) & ~0x7F) + 0x80))
    return _members(low, high, kind, _folds(c))


def _folds(c: str) -> bool:
    """Whether a letter comes back from its upper case."""
    return len(c.upper()) == 1 and c.upper().lower() == c


@lru_cache(maxsize=1 << 10)
def _members(low: int, high: int, kind: str, folds: bool) -> str:
    return "".join(c for c in map(chr, range(low, high)) if unicodedata.category(c) == kind and _folds(c) == folds and c not in _CLASS)


class Permutation:
    """Keyed one-to-one maps of whole numbers under n onto each other, without fixed points.

    A balanced Feistel network over the next even number of bits, walked until the result is under n, gives a
    keyed order; a number's surrogate is the next one in that order, and the last one's is the first.
    """

    ROUNDS = 4

    def __init__(self, key: str):
        self.key = hashlib.blake2b(key.encode(), digest_size=32).digest()

    def _round(self, i: int, tweak: bytes, x: int, bits: int) -> int:
        size = (bits + 7) // 8
        out, block = b"", 0
        while len(out) < size:
            out += hashlib.blake2b(b"%d|%d|%b|%b" % (i, block, tweak, x.to_bytes(size, "big")), key=self.key, digest_size=min(64, max(8, size))).digest()
            block += 1
        return int.from_bytes(out, "big") & ((1 << bits) - 1)

    def _walk(self, x: int, n: int, tweak: bytes, back: bool) -> int:
        bits = max(1, ((n - 1).bit_length() + 1) // 2)
        while True:
            left, right = x >> bits, x & ((1 << bits) - 1)
            for i in reversed(range(self.ROUNDS)) if back else range(self.ROUNDS):
                if back:
                    left, right = right ^ self._round(i, tweak, left, bits), left
                else:
                    left, right = right, left ^ self._round(i, tweak, right, bits)
            x = left << bits | right
            if x < n:
                return x

    def __call__(self, x: int, n: int, tweak: str, good: Callable[[int], bool] = lambda _: True) -> int:
        """The surrogate of x: the next number in the keyed order that is good. One-to-one among good numbers, if x is one."""
        if n < 2:
            return x
        t = tweak.encode()
        place = self._walk(x, n, t, True)
        while True:
            place = (place + 1) % n
            y = self._walk(place, n, t, False)
            if good(y) or y == x:
                return y


def luhn(digits: str) -> bool:
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def like(surface: str, text: str) -> str:
    """text in the letter case of surface: all upper case, or letter by letter where lengths agree, or capitalised."""
    if surface.isupper() and len(surface) > 1:
        return text.upper()
    if len(surface) == len(text):
        return "".join(c.upper() if s.isupper() else c.lower() for s, c in zip(surface, text, strict=True))
    return text if surface[:1].isupper() else text.lower()


class Surrogates:
    """Replacements under one key. Equal entities have equal surrogates in every text, different ones different.

    Each format's map is one-to-one. Where formats meet in one output space a later check may still find two entities
    with one surrogate; again (digest of an entity -> how often it was moved) then takes one of them elsewhere.
    """

    def __init__(self, key: str = KEY, again: dict[bytes, int] | None = None):
        self.permute = Permutation(key)
        self.again = again or {}
        self.listed = {n.lower(): (n, names) for lists in (GIVEN, FAMILY) for names in lists.values() for n in names}
        self.given = {n.lower() for names in GIVEN.values() for n in names}
        self.of = lru_cache(maxsize=1 << 14)(self._checked)

    def digest(self, s: str) -> bytes:
        """A keyed name of an entity, which tells nothing of it."""
        return hashlib.blake2b(s.encode("utf-8", "surrogatepass"), key=self.permute.key, digest_size=16).digest()

    def _checked(self, kind: str, s: str) -> tuple[str, bytes]:
        """The surrogate and the digest of an entity. A surrogate is never the entity itself."""
        digest = self.digest(s if kind != "name" else s.lower())
        new = self._of(kind, s)
        for i in range(self.again.get(digest, 0)):
            new = self.moved(new, i)
        return (new if new != s else self.moved(s, 0)), digest

    def moved(self, value: str, i: int) -> str:
        """Another string of the same shape; digits and letters without company in their block become Latin letters."""
        if any(len(alphabet(c) or "") > 1 for c in value.lower()):
            return self.shaped(value, f"moved{i}")
        n = max(1, len(value))
        raw = hashlib.blake2b(f"{i}|{value}".encode("utf-8", "surrogatepass"), key=self.permute.key, digest_size=min(64, n)).digest()
        return "".join(_ALPHABETS[1][b % 26] for b in raw) + value[64:]

    def shaped(self, value: str, tweak: str, good: Callable[[str], bool] = lambda _: True) -> str:
        """Every letter or digit replaced by one of its own alphabet, everything else kept, as one number.

        good judges the surrogate in the letter case of value.
        """
        low = value.lower() if len(value.lower()) == len(value) and value.lower().upper().lower() == value.lower() else value
        classes = [alphabet(c) for c in low]
        pattern = "".join(c if a is None else a[0] for c, a in zip(low, classes, strict=True))
        return like_each(value, self._mixed(low, classes, f"{tweak}|{pattern}", lambda y: good(like_each(value, y))))

    def _mixed(self, low: str, classes: list, tweak: str, good: Callable[[str], bool]) -> str:
        x, n = 0, 1
        for c, a in zip(low, classes, strict=True):
            if a is not None:
                x, n = x * len(a) + a.index(c), n * len(a)

        def back(y: int) -> str:
            out = []
            for c, a in zip(reversed(low), reversed(classes), strict=True):
                if a is None:
                    out.append(c)
                else:
                    y, k = divmod(y, len(a))
                    out.append(a[k])
            return "".join(reversed(out))

        return back(self.permute(x, n, tweak, lambda y: good(back(y))))

    def digits(self, surface: str, kind: str, good: Callable[[str], bool] = lambda _: True) -> str:
        """The digits of surface replaced as one number, its separators kept."""
        d = re.sub(r"\D", "", surface)
        new = f"{self.permute(int(d), 10 ** len(d), f'{kind}|{len(d)}', lambda y: good(f'{y:0{len(d)}d}')):0{len(d)}d}"
        it = iter(new)
        return "".join(next(it) if c.isdigit() else c for c in surface)

    def _of(self, kind: str, s: str) -> str:
        if kind == "email":
            local, _, domain = s.rpartition("@")
            *labels, top = domain.split(".")
            return f"{self.shaped(local, 'local')}@{self.shaped('.'.join(labels), 'domain')}.{top}"
        if kind == "ip":
            return self._ip(s)
        if kind == "phone":
            code = re.match(r"\+\d{1,3}(?=[ .(-])|\+\d|", s)[0]
            rest = s[len(code) :]
            first = re.sub(r"\D", "", rest)[0]
            return code + self.digits(rest, f"phone{code}{'0' * (first == '0')}", lambda d: (d[0] == "0") == (first == "0"))
        if kind == "account":
            d = re.sub(r"\D", "", s)
            valid = luhn(d)
            return self.digits(s, f"account{valid}", lambda y: luhn(y) == valid)
        if kind == "ssn":
            return self.digits(s, kind)
        if kind == "iban":
            return s[:4] + self.shaped(s[4:], f"iban{s[:4]}")
        if kind == "secret":
            return self._secret(s)
        if kind == "name":
            return self._name(s)
        raise ValueError(kind)

    def _ip(self, s: str) -> str:
        octets = [int(x) for x in s.split(".")]
        fixed = 1 if octets[0] in (10, 127) else 2 if octets[:2] == [192, 168] or octets[0] == 172 and 16 <= octets[1] < 32 or octets[:2] == [169, 254] else 0
        x = int.from_bytes(bytes(octets[fixed:]), "big")
        special = lambda b: b[0] in (0, 10, 127) or b[0] >= 224 or b[:2] in (b"\xc0\xa8", b"\xa9\xfe") or b[0] == 172 and 16 <= b[1] < 32
        good = lambda y: bool(fixed) or octets[0] in (0,) or octets[0] >= 224 or not special(y.to_bytes(4, "big"))
        y = self.permute(x, 256 ** (4 - fixed), f"ip{octets[:fixed]}", good)
        return ".".join(map(str, octets[:fixed] + list(y.to_bytes(4 - fixed, "big"))))

    def _secret(self, s: str) -> str:
        """Hex digits become hex digits, anything else what is neither hex nor begins like a known key: no two formats share a surrogate."""
        for prefix in _PREFIXES:
            if s.startswith(prefix) and len(s) > len(prefix):
                return prefix + self.shaped(s[len(prefix) :], prefix)
        if set(s) <= set(_HEX):
            return self._mixed(s, [_HEX] * len(s), f"hex{len(s)}", lambda _: True)
        if set(s) <= set(_HEX.upper()):
            return self._mixed(s, [_HEX.upper()] * len(s), f"HEX{len(s)}", lambda y: not y.isdigit())
        other = lambda y: not set(y) <= set(_HEX) and not set(y) <= set(_HEX.upper()) and not y.startswith(_PREFIXES)
        return self.shaped(s, "secret", other)

    def _name(self, s: str) -> str:
        """A listed name becomes another of its list, of its gender and script; any other word an unlisted one, vowels for vowels.

        The last letter of an unlisted name stays where it is a vowel, as it often tells the gender.
        """
        low = s.lower()
        if low in self.listed:
            name, names = self.listed[low]
            return like(s, names[self.permute(names.index(name), len(names), f"name{names[0]}")])
        if len(low) != len(s):
            return self.shaped(s, "name")
        classes = [(_VOWELS if c in _VOWELS else _CONSONANTS) if c in _ALPHABETS[1] else alphabet(c) for c in low]
        if low[-1] in _VOWELS and len(low) > 2:
            classes[-1] = None
        pattern = "".join(c if a is None else a[0] for c, a in zip(low, classes, strict=True))
        return like_each(s, self._mixed(low, classes, f"name|{pattern}", lambda y: y not in self.listed))

    # ------------------------------------------------------------------------------------------------ entities
    def find(self, text: str) -> list[tuple[int, int, str, str, bytes]]:
        """(start, end, type, surrogate, digest), ascending and apart: of overlapping ones the first found, in the order of types below."""
        found: list[tuple[int, int, str]] = []
        if "=" in text or ":" in text or "A" in text or "_" in text or "-" in text:
            found = _beside(found, _secrets(text))
        if "@" in text:
            found = _beside(found, [(m.start(), m.end(), "email") for m in _EMAIL.finditer(text)])
        if _DIGIT.search(text):
            found = _beside(found, [(m.start(), m.end(), "iban") for m in _IBAN.finditer(text)])
            found = _beside(found, [(m.start(), m.end(), m.lastgroup) for m in _NUMBER.finditer(text)])
        found = _beside(found, self.names(text))
        return [(a, b, kind, *self.of(kind, text[a:b])) for a, b, kind in found]

    def names(self, text: str) -> list[tuple[int, int, str]]:
        """Words of personal names. What is a name in one place of a text is one wherever it stands capitalised."""
        words: set[str] = set()
        ordinary = None
        for m in _RUN.finditer(text):
            if " " not in m[0]:
                continue
            if ordinary is None:
                ordinary = {w for w in _WORD.findall(text) if w[0].islower()}
            words |= self._people(text, m, ordinary)
        if not words:
            return []
        return [(m.start(), m.end(), "name") for m in _WORD.finditer(text) if m[0] in words]

    def _people(self, text: str, run: re.Match, ordinary: set[str]) -> set[str]:
        """The names in a run of capitalised words: the parts between common words and titles whose features add up to LEAST."""
        out: set[str] = set()
        words = [(m[0], run.start() + m.start(), run.start() + m.end()) for m in _WORD.finditer(run[0])]
        line = text[text.rfind("\n", 0, run.start()) + 1 : (text.find("\n", run.end()) + 1 or len(text) + 1) - 1] if len(words) > 2 else ""
        part: list[tuple[str, int, int]] = []
        title = False
        for w in [*words, ("", run.end(), run.end())]:
            low = w[0].lower()
            if w[0] and low not in COMMON and low not in TITLES and not (part and text[part[-1][2] : w[1]] != " "):
                part.append(w)
                continue
            if part and len(part) <= 4:
                if self._score(text, part, title, ordinary, len(line) == len(run[0])) >= LEAST:
                    out |= {x for x, _, _ in part if len(x) > 1}
            title = low in TITLES
            part = [w] if w[0] and low not in COMMON and not title else []
        return out

    def _score(self, text: str, part: list[tuple[str, int, int]], title: bool, ordinary: set[str], heading: bool) -> float:
        lows = [w.lower() for w, _, _ in part]
        before = text[max(0, part[0][1] - 24) : part[0][1]].rstrip(" ")
        after = _WORD.match(text, part[-1][2] + 1)
        last = _WORD.findall(before)[-1:] if before[-1:].isalpha() else []
        starts = before[-1:] != "" and before[-1] in ".!?:;\n\"“„"
        features = {
            "several": 2 <= len(part) <= 3, "title": title, "given": lows[0] in self.given, "starts": starts and not title, "alone": len(part) == 1, "before": bool(last) and last[0].lower() in BEFORE,
            "after": bool(after) and after[0] in AFTER, "thing": not THINGS.isdisjoint(lows), "capitals": any(w.isupper() and len(w) > 1 for w, _, _ in part), "again": len(set(lows)) < len(lows),
            "short": any(len(w) < 3 for w in lows), "heading": heading}
        return sum(WEIGHTS[k] for k, v in features.items() if v) + WEIGHTS["ordinary"] * sum(w in ordinary for w in lows)

    def replace(self, text: str | None) -> tuple[str | None, list[tuple[str, str, bytes]]]:
        """The text with all entities replaced, and their types, surrogates and digests."""
        if not text:
            return text, []
        out, at, entities = [], 0, []
        for a, b, kind, new, digest in self.find(text):
            out += [text[at:a], new]
            at = b
            entities.append((kind, new, digest))
        return ("".join(out) + text[at:], entities) if entities else (text, entities)


_VOWELS, _CONSONANTS = "aeiou", "bcdfghjklmnpqrstvwxyz"


def _secrets(text: str) -> list[tuple[int, int, str]]:
    out = []
    for m in _SECRET.finditer(text):
        group = m.lastgroup or "value"
        value = m[group].rstrip(".-") if group == "value" else m[group]
        if len(value) >= 6 and (group != "value" or any(c.isdigit() for c in value) or "=" in m[0]):
            out.append((m.start(group), m.start(group) + len(value), "secret"))
    return out


def _beside(found: list[tuple[int, int, str]], more: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Both lists, without those of the second that overlap one of the first. Each is ascending and apart."""
    if not found or not more:
        return found or more
    out, i = [], 0
    for x in more:
        while i < len(found) and found[i][0] < x[1] and found[i][1] <= x[0]:
            out.append(found[i])
            i += 1
        if i == len(found) or found[i][0] >= x[1]:
            out.append(x)
    return out + found[i:]


def like_each(surface: str, text: str) -> str:
    return "".join(c.upper() if s.isupper() and s.lower() != s and len(c.upper()) == 1 else c for s, c in zip(surface, text, strict=True))


def pseudonymise(ws: Workspace, docs: DataFrame, columns: list[str], text_col: str = "text", key: str = KEY) -> DataFrame:
    """The named columns of docs, with text_col (one of them) replaced, and n_entities and entities (their types, in order of place).

    Surrogates are functions of the key and the entity: the same entity has the same one in every document and every
    run. The replaced texts are written once, with a keyed digest beside each surrogate. Then comes the check: a surrogate
    with two digests stands for two entities; all of them but one are moved elsewhere, and the texts that hold
    them are replaced anew, until no surrogate has two. Formats are one-to-one in themselves, so there is seldom any.

    Null and empty texts stay. A text without entities is unchanged. Repeated rows each give a row. An empty table gives
    no rows. Columns may have any name, n_entities and entities included.
    """
    names = [f"__c{i}" for i in range(len(columns))]
    place = columns.index(text_col)
    kept = docs.select(*[F.col(c).alias(n) for c, n in zip(columns, names, strict=True)])
    out = StructType(kept.schema.fields[:]).add("n_entities", "long").add("entities", "string").add("new", ArrayType(StringType())).add("digests", ArrayType(BinaryType()))

    def replaced(again: dict[bytes, int]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            surrogates = Surrogates(key, again)
            for b in pieces(batches, 128):
                texts, found = zip(*(surrogates.replace(t) for t in b.column(place).to_pylist()), strict=True)
                arrays = list(b.columns)
                arrays[place] = pa.array(texts, pa.string())
                kinds = pa.array([",".join(k for k, _, _ in x) for x in found], pa.string())
                new, digests = (pa.array([[e[i] for e in x] for x in found], pa.list_(t)) for i, t in ((1, pa.string()), (2, pa.binary())))
                yield pa.RecordBatch.from_arrays([*arrays, pa.array([len(x) for x in found], pa.int64()), kinds, new, digests], out.names)

        return map_batches(kept, run, out)

    again: dict[bytes, int] = {}
    while True:
        done = ws.save(replaced(again), "replaced")
        pairs = done.where("n_entities > 0").select(F.explode(F.arrays_zip("new", "digests")).alias("e")).select("e.new", "e.digests")
        shared = pairs.groupBy("new").agg(F.min("digests").alias("first"), F.max("digests").alias("last")).where("first <> last").select("new", "first")
        # So many are moved at a time; those left are found by the next check.
        moving = pairs.join(shared, "new").where("digests <> first").select("digests").distinct().limit(MOVED).collect()
        if not moving:
            return done.drop("new", "digests").toDF(*columns, "n_entities", "entities")
        for r in moving:
            again[bytes(r.digests)] = again.get(bytes(r.digests), 0) + 1
        ws.drop(done)


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with private data replaced; n_chars, where there is one, is counted anew."""
    names = [f"__d{i}" for i in range(len(docs.columns))]
    text = names[docs.columns.index("text")]
    done = pseudonymise(Workspace(spark), docs.toDF(*names), names, text)
    counted = [F.length(text).cast(docs.schema["n_chars"].dataType).alias(n) if c == "n_chars" else F.col(n) for n, c in zip(names, docs.columns, strict=True)]
    return done.select(*counted).toDF(*docs.columns)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(Workspace(spark), table(spark, sf_dir, "documents"), ["doc_id", "text"])
