"""PII surrogates: keyed, type-consistent replacements that keep gender, script and format.

E-mail addresses, telephone numbers, payment cards, IPv4 addresses, US social
security numbers and IBANs are found by patterns. Persons are found in two
passes over a document: names are learnt from listed given names with what
follows them, titles, introductions and salutations, and patronymics; then every
word of the document that is such a name, in any case or with a genitive s, is a
mention. A surrogate is the image of the normalised entity under a keyed
permutation of all values of its form: the place of the entity in that set is
enciphered (a balanced Feistel network over the next power of four, walked until
it is inside), moved on by one, and deciphered. So within a form no two entities
share a surrogate, none keeps its own, and the same entity gets the same one in
every document, without a table of entities or a shuffle. Digits stay digits,
letters stay vowels or consonants of their script and case, separators stay; a
card keeps passing or failing its check digit, an IBAN stays valid; the local
part and the domain of an address move apart, so that addresses of one domain
still share one. Listed given names stay in the list of their gender and script.
Other names keep their length, doubled letters, kinds of sounds and the ending
that tells script and gender (Petrova and Petrov share a stem, before and after);
a permutation is walked on where its image would read as another form, and short
forms are gone through in the order of a keyed hash, so that none keeps its own;
where a form has one name alone, its letters move among all vowels or consonants.

Before anything is replaced, ``collisions`` checks this on the corpus at hand:
surrogates that two entities of a kind share, from distinct pairs of surrogates
and keyed fingerprints of entities, never texts. One found is an error.
``confusions`` counts surrogates that are other entities of the corpus.

Defined results: null texts stay null, empty ones empty; without entities a
text is unchanged; overlapping finds give way to the leftmost, then the longest;
further columns are kept as they are, one of the made column's name gives way to
it; repeated rows stay; an empty table gives an empty table. A name that nothing
in its document marks as one is not found, nor are inflected forms but the
genitive s. A name whose document also uses the word in lower case ("Lisa Long
took a long walk. Long ago ...") is replaced where it is marked, nowhere else, so
a later bare mention of it stays.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import product
from math import prod

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, slices, with_field

# Given names by script and gender.
NAMES = {
    ("latin", "f"): "Alice Amanda Amelia Andrea Anna Barbara Beatrice Camille Caroline Charlotte Claire Clara Claudia Diana Elena Elisabeth Emily Emma Eva Hannah Helen Ingrid Isabel Jane Jennifer Jessica Julia Karen Katharina Laura Linda Lisa Lucia Margaret Maria Marie Martha Monika Nicole Olivia Patricia Petra Rachel Rebecca Sabine Sandra Sarah Sofia Susan Ursula Victoria".split(),
    ("latin", "m"): "Adam Alexander Andrew Anthony Antonio Benjamin Carlos Charles Christian Daniel David Diego Dieter Edward Eric Fernando Francis Frank George Hans Henry Jack Jacques James Jean John Jonathan Joseph Juan Karl Kevin Lars Louis Luis Manuel Marco Mark Martin Matthew Michael Miguel Nicolas Oliver Pablo Patrick Paul Peter Philip Pierre Richard Robert Samuel Stefan Stephen Thomas Walter William".split(),
    ("cyrillic", "f"): "Анна Дарья Екатерина Елена Ирина Мария Наталья Ольга Светлана Татьяна".split(),
    ("cyrillic", "m"): "Алексей Андрей Борис Виктор Владимир Дмитрий Иван Михаил Николай Сергей".split(),
    ("greek", "f"): "Αικατερίνη Βασιλική Ελένη Μαρία Σοφία".split(),
    ("greek", "m"): "Γεώργιος Δημήτριος Ιωάννης Κωνσταντίνος Νικόλαος".split(),
}
_LISTED = {name.lower(): (group, k) for group, names in NAMES.items() for k, name in enumerate(names)}
_GIVEN = frozenset(name for names in NAMES.values() for name in names)
# What stands before a name. After a title the last word is a surname, after the others the first is a given name.
TITLES = frozenset("Mr Mrs Ms Miss Mister Dr Prof Professor Herr Herrn Frau Monsieur Madame Mme Mlle Señor Señora Sr Sra Господин Госпожа господин госпожа Κύριος Κυρία".split())
GREETINGS = frozenset("Dear Liebe Lieber Cher Chère Querido Querida Дорогой Дорогая".split())
_LABEL = re.compile(r"(?<!\w)(?:[Nn]ame|[Cc]ontact|[Aa]uthor|[Nn]om|[Nn]ombre|[Ии]мя)\s?:\s?$|(?:[Mm]y name is|[Ii]ch heiße|[Mm]ein Name ist|[Jj]e m['’]appelle|[Mm]e llamo|[Mm]i nombre es|[Мм]еня зовут) $")
_LABEL_WORDS = frozenset("name Name contact Contact author Author nom Nom nombre Nombre имя Имя heiße appelle llamo зовут".split())
# What stands before or after a name in scripts without case.
_BARE_BEFORE = "姓名|名字|联系人|聯絡人|名前|氏名|お名前|이름|성명|الاسم|اسم|שם|नाम"
_BARE_TITLES = "السيد|السيدة|الدكتور|الأستاذ|מר|גברת|גב|श्री|श्रीमती|डॉ"
_BARE_AFTER = "先生|女士|小姐|さん|様|씨|선생님"
_NO_NAME = frozenset("Sir Madam Sirs All Team Customer Friend Friends Colleagues Reader Readers Herr Frau Dr Prof".split())
# Endings of names that are kept, the longer ones first tried.
ENDINGS = tuple(sorted("mann berg stein son sen ski ska sky skaya ova ov eva ev ina in ez es er ini elli etti ard ман берг ова ева ёва ина ына ская цкая ов ев ёв ин ын ский цкий енко ович евич овна евна πουλος πούλου ίδης άκης ης ου ας".split(), key=len, reverse=True))
# Letters of a kind of sound; others move as in any text.
_SOUNDS = {c: letters for letters in ("aeiouy", "lmnr", "bcdgkpt", "fsvwz", "hjqx", "аеиоу", "эыюя", "лмнр", "бвгдзкпст", "жфхцчшщ", "αεηιουω", "βγδζθκ", "λμνρ", "πστφχ", "äöü", "áéíóú", "àèìòù", "âêîôû") for c in letters}
# Letters that stand for each other, by script.
_LETTERS = ("aeiouy", "bcdfghjklmnpqrstvwxz", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ", "äöü", "áéíóú", "àèìòù", "âêîôû")
_CLASS = {c: letters for letters in (*_LETTERS, "0123456789") for c in letters}


@lru_cache(maxsize=10_000)
def _class_of(c: str) -> str | None:
    """The letters or digits that a character in lower case may become: those of its class, or of its aligned block of 64 in other scripts."""
    if c in _CLASS:
        return _CLASS[c]
    if len(c) != 1 or not c.isalpha():
        return None
    start = ord(c) & ~63
    block = "".join(x for x in map(chr, range(start, start + 64)) if x.isalpha() and x.lower() == x and len(x.upper()) == 1 and x not in _CLASS)
    return block if c in block else None

_PATTERNS = (
    ("email", re.compile(r"(?<![\w.+-])[\w.+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), "@"),
    ("iban", re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"), None),
    ("ssn", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"), "-"),
    ("ipv4", re.compile(r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d)"), "."),
    ("card", re.compile(r"(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-])"), None),
    ("phone", re.compile(r"(?<!\w)\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\w)"), "+"),
    ("phone", re.compile(r"(?<![\w+(-])(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w-])"), None),
)
_WORD = re.compile(r"[^\W\d_]+")
#: A middle initial, particles, and a surname of one or two parts, as what follows a given name.
_SURNAME = re.compile(r"(?: [^\W\d_]\.)?(?: (?:von|van|de|der|den|del|della|di|da|dos|la|le|du|ten|ter|zu|zum|al|bin)){0,3} ([^\W\d_]{2,})(?:-([^\W\d_]{2,}))?")
_CALLED = re.compile(r"\.? ?([^\W\d_]{2,})(?: ([^\W\d_]{2,}))?(?: ([^\W\d_]{2,}))?")
_PATRONYMIC = re.compile(r"([А-ЯЁ][а-яё]+) ([А-ЯЁ][а-яё]+(?:вич|вна))(?: ([А-ЯЁ][а-яё]+))?")
#: A word of a script without case, with its marks: two to four characters where words are not spaced, else up to three words.
_BARE = r"(?:[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]{2,4}(?![\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af])|[\u0590-\u08ff\u0900-\u0dff]{2,}(?: [\u0590-\u08ff\u0900-\u0dff]{2,}){0,2})"
_BARE_NAME = re.compile(rf"(?:(?:{_BARE_BEFORE})\s?[:：]\s?|(?<!\w)(?:{_BARE_TITLES})[.'׳]? )({_BARE})|([\u3400-\u9fff\uac00-\ud7af]{{2,3}}) ?(?:{_BARE_AFTER})")
_BARE_LETTER = re.compile(r"[\u0590-\u08ff\u0900-\u0dff\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")
_STOPS = frozenset(".!?…:;\n\r")
_DIGIT = re.compile(r"\d")


def _luhn(digits: str) -> bool:
    return sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0


def _iban(value: str) -> bool:
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def _holds(kind: str, value: str) -> bool:
    if kind == "ipv4":
        return all(int(x) < 256 for x in value.split("."))
    digits = "".join(str(int(c)) for c in value if c.isdecimal())
    if kind == "card":
        return len(digits) == 16 or len(digits) >= 13 and _luhn(digits)
    if kind == "phone":
        return 8 <= len(digits) <= 15
    return kind != "iban" or _iban(value.replace(" ", ""))


def _begins(text: str, at: int) -> bool:
    """Whether a sentence begins there: behind the start, a stop or a line's end, with spaces, quotes and brackets between."""
    k = at - 1
    while k >= 0 and text[k] not in _STOPS and not text[k].isalnum() and text[k] != ",":
        k -= 1
    return k < 0 or text[k] in _STOPS


def _alone(text: str, at: int) -> bool:
    """Whether no word follows there, but the end, a line's end or a mark."""
    return not re.match(r" ?[^\W_]", text[at : at + 2])


def _marks(text: str, words: set[str]) -> list[tuple[str, int, int]]:
    """The names (kind, start, end) that a text marks as such."""
    found: list[tuple[str, int, int]] = []

    def add(m: re.Match, first: int, first_is_given: bool) -> None:
        kept = []
        for k in range(first, m.re.groups + 1):
            name = m[k]
            if not name or not name[0].isupper() or name in _NO_NAME or name in TITLES:
                break
            kept.append((name, *m.span(k)))
        if kept and (first_is_given or len(kept) > 1 or kept[0][0].lower() in _LISTED):
            found.append(("given", *kept.pop(0)[1:]))
        found.extend(("surname", a, b) for _, a, b in kept)

    listed, titles, greetings = words & _GIVEN, words & TITLES, words & GREETINGS
    shouted = {w for w in words if w.isupper() and len(w) > 2 and w.lower() in _LISTED}
    if listed or shouted or titles or greetings or not words.isdisjoint(_LABEL_WORDS):
        for m in _WORD.finditer(text):
            word = m[0]
            if word in listed or word in shouted:
                after = _SURNAME.match(text, m.end())
                own = [(k, *after.span(k)) for k in (1, 2) if after[k] and after[k][0].isupper() and after[k] not in _GIVEN and after[k] not in _NO_NAME] if after else []
                inside = not _begins(text, m.start())
                if own and (inside or word in listed) or word.lower() not in words and (inside or _alone(text, m.end())):
                    found.append(("given", *m.span()))
                found.extend(("surname", a, b) for _, a, b in own if inside or word in listed)
            elif word in titles:
                if called := _CALLED.match(text, m.end()):
                    add(called, 1, False)
            elif word in greetings:
                if (called := _CALLED.match(text, m.end())) and text[called.end() : called.end() + 1] in (",", "!"):
                    add(called, 1, True)
            elif word[0].isupper() and _LABEL.search(text, max(0, m.start() - 20), m.start()) and (called := _CALLED.match(text, m.start())):
                if called[2] and called[2][0].isupper() or text[m.start() - 2] != ":":
                    add(called, 1, True)
    if any(w.endswith(("вич", "вна")) for w in words):
        for m in _PATRONYMIC.finditer(text):
            found += [("given", *m.span(1)), *(("surname", *m.span(k)) for k in (2, 3) if m[k])]
    return found


def _bare(text: str) -> list[tuple[str, int, int]]:
    """Names in scripts without case: marked ones, and their further mentions."""
    marked = [(k, *m.span(k)) for m in _BARE_NAME.finditer(text) for k in (1, 2) if m[k]]
    names = {w for _, a, b in marked for w in text[a:b].split(" ")}
    if not names:
        return []
    spaced = "|".join(sorted((re.escape(n) for n in names if n < "\u3000"), key=len, reverse=True))
    dense = "|".join(sorted((re.escape(n) for n in names if n >= "\u3000"), key=len, reverse=True))
    letter = r"[\u0590-\u08ff\u0900-\u0dff]"
    patterns = [p for p in (f"(?<!{letter})(?:{spaced})(?!{letter})" if spaced else "", dense) if p]
    return [("surname", *m.span()) for m in re.finditer("|".join(patterns), text)]


def find(text: str) -> list[tuple[str, int, int]]:
    """Entities (kind, start, end) from left to right, without overlap."""
    found = []
    if "@" in text:
        found += [("email", *m.span()) for m in _PATTERNS[0][1].finditer(text)]
    if _DIGIT.search(text):
        for kind, pattern, needs in _PATTERNS[1:]:
            if needs is None or needs in text:
                found += [(kind, *m.span()) for m in pattern.finditer(text) if _holds(kind, m[0])]
    words = set(_WORD.findall(text))
    if marked := _marks(text, words):
        found += marked
        kinds: dict[str, str] = {}
        for kind, a, b in marked:
            name = text[a:b].lower()
            if name not in words:  # a word that is also used in lower case is no name elsewhere
                kinds[name] = "given" if kind == "given" else kinds.get(name, kind)
        for m in _WORD.finditer(text) if kinds else ():
            if m[0][0].isupper():
                for b in (m.end(), m.end() - 1):
                    if (kind := kinds.get(text[m.start() : b].lower())) and (b == m.end() or text[b] == "s"):
                        found.append((kind, m.start(), b))
                        break
    if _BARE_LETTER.search(text):
        found += _bare(text)
    kinds_at = {(a, b): kind for kind, a, b in found if kind == "given"}
    found = [(kinds_at.get((a, b), kind) if kind == "surname" else kind, a, b) for kind, a, b in found]
    out, end = [], 0
    for kind, a, b in sorted(found, key=lambda s: (s[1], -s[2])):
        if a >= end:
            out.append((kind, a, b))
            end = b
    return out


class Cipher:
    """Keyed permutations of 0..size-1 without fixed points."""

    def __init__(self, key: bytes, rounds: int = 8):
        self.key, self._key, self._rounds = key, hashlib.blake2b(key, digest_size=32).digest(), rounds

    def _round(self, tweak: bytes, k: int, half: int, width: int) -> int:
        data = k.to_bytes(1, "big") + half.to_bytes((width + 7) // 8 + 1, "big")
        out, block = b"", 0
        while 8 * len(out) < width:
            out += hashlib.blake2b(data, key=self._key, salt=block.to_bytes(16, "big"), person=tweak).digest()
            block += 1
        return int.from_bytes(out, "big") & ((1 << width) - 1)

    def _walk(self, x: int, size: int, tweak: bytes, order) -> int:
        width = max(1, ((size - 1).bit_length() + 1) // 2)
        while True:
            left, right = x >> width, x & ((1 << width) - 1)
            for k in order:
                if order.step > 0:
                    left, right = right, left ^ self._round(tweak, k, right, width)
                else:
                    left, right = right ^ self._round(tweak, k, left, width), left
            x = left << width | right
            if x < size:
                return x

    def move(self, x: int, size: int, kind: str) -> int:
        if size < 2:
            return x
        tweak = hashlib.blake2b(f"{kind}:{size}".encode(), digest_size=16).digest()
        y = (self._walk(x, size, tweak, range(0, self._rounds, 1)) + 1) % size
        return self._walk(y, size, tweak, range(self._rounds - 1, -1, -1))

    def fingerprint(self, value: str) -> bytes:
        return hashlib.blake2b(value.encode("utf-8", "surrogatepass"), key=self._key, digest_size=16).digest()


def _relettered(value: str, kind: str, cipher: Cipher) -> str:
    """Moves the characters that have a class within it, case by case kept; one number for the whole value in lower case."""
    classes = [_class_of(c.lower()) for c in value]
    number, size = 0, 1
    for c, letters in zip(value, classes, strict=True):
        if letters:
            number, size = number * len(letters) + letters.index(c.lower()), size * len(letters)
    form = "|".join(letters[0] if letters else f"={c}" for c, letters in zip(value, classes, strict=True))
    number, out = cipher.move(number, size, f"{kind}:{hashlib.blake2b(form.encode('utf-8', 'surrogatepass'), digest_size=8).hexdigest()}"), list(value)
    for k in range(len(value) - 1, -1, -1):
        if letters := classes[k]:
            number, at = divmod(number, len(letters))
            out[k] = letters[at].upper() if value[k].isupper() else letters[at]
    return "".join(out)


def _split(kind: str, name: str) -> tuple[str, str]:
    """Stem and kept ending of a name in lower case: of a given name a vowel that tells its gender."""
    for e in ENDINGS if kind == "surname" else "aeoаяηα":
        if name.endswith(e) and len(name) - len(e) >= 2:
            return name[: -len(e)], e
    return name, ""


def _form(stem: str) -> tuple[str, ...]:
    """For each letter the letters that it can become, "=" for one that repeats the one before."""
    return tuple("=" if k and c == stem[k - 1] else _SOUNDS.get(c) or _class_of(c) or c for k, c in enumerate(stem))


#: Forms of so many names at most are gone through in an order, larger ones by a permutation.
_ORDERED = 4_096


def _reads_as(new: str, form: tuple[str, ...], kind: str, ending: str) -> bool:
    """Whether a new stem has that form, and with its ending is no listed name."""
    return _form(new) == form and _split(kind, new + ending) == (new, ending) and new + ending not in _LISTED


def _stems(form: tuple[str, ...], letters: tuple[str, ...]) -> Iterator[str]:
    for some in product(*letters):
        new = ""
        for c in some:
            new += new[-1] if c == "=" else c
        yield new


@lru_cache(maxsize=2_000)
def _order(form: tuple[str, ...], kind: str, ending: str, key: bytes) -> dict[str, str]:
    """The next of each stem of a form in a keyed order, round and round."""
    cipher = Cipher(key)
    stems = sorted((s for s in _stems(form, form) if _reads_as(s, form, kind, ending)), key=lambda s: cipher.fingerprint(f"{kind}|{s}"))
    return dict(zip(stems, stems[1:] + stems[:1], strict=True))


def _single(stem: str, kind: str, ending: str, key: bytes) -> bool:
    """Whether a stem is the only one of its form."""
    form = _form(stem)
    return prod(map(len, form)) <= _ORDERED and len(_order(form, kind, ending, key)) == 1


@lru_cache(maxsize=2_000)
def _wide_order(letters: tuple[str, ...], kind: str, ending: str, key: bytes) -> dict[str, str]:
    """The next of each stem that is the only one of its form, among those whose letters are of the same wide classes."""
    cipher = Cipher(key)
    some = {s for s in _stems(letters, letters) if _reads_as(s, _form(s), kind, ending) and _single(s, kind, ending, key)}
    stems = sorted(some, key=lambda s: cipher.fingerprint(f"wide|{kind}|{s}|{ending}"))
    return dict(zip(stems, stems[1:] + stems[:1], strict=True))


def _renamed(value: str, kind: str, cipher: Cipher) -> str:
    """A name of the same form and ending; letters move within their kind of sound."""
    name = value.lower()
    stem, ending = _split(kind, name)
    form, new = _form(stem), stem
    size = prod(map(len, form))
    if size <= _ORDERED:
        new = _order(form, kind, ending, cipher.key).get(stem, stem)
        if new == stem:
            new = _wide_order(tuple(_class_of(c) or c for c in stem), kind, ending, cipher.key).get(stem, stem) if len(stem) < 4 else stem
    else:
        tweak = f"{kind}:{hashlib.blake2b('|'.join(form).encode('utf-8', 'surrogatepass'), digest_size=8).hexdigest()}"
        while True:
            number, out = 0, []
            for c, letters in zip(new, form, strict=True):
                number = number * len(letters) + (letters.index(c) if len(letters) > 1 else 0)
            number = cipher.move(number, size, tweak)
            for letters in reversed(form):
                number, at = divmod(number, len(letters))
                out.append(letters[at])
            new = ""
            for c in reversed(out):
                new += new[-1] if c == "=" else c
            if new == stem or _reads_as(new, form, kind, ending):
                break
    new += ending
    return "".join(n.upper() if v.isupper() else n for n, v in zip(new, value, strict=True)) if len(new) == len(value) else new


def _redigited(value: str, digits: str, start: int = 0) -> str:
    """``value`` with its digits from the start-th on replaced in turn, each in its own script."""
    new, seen, out = iter(digits), 0, []
    for c in value:
        if c.isdecimal():
            out.append(chr(ord(c) - int(c) + int(next(new))) if seen >= start else c)
            seen += 1
        else:
            out.append(c)
    return "".join(out)


def normal(kind: str, value: str) -> str:
    """What makes two finds the same entity."""
    return ".".join(str(int(x)) for x in value.split(".")) if kind == "ipv4" else value.lower()


def surrogate(kind: str, value: str, cipher: Cipher) -> str:
    """The replacement of an entity; equal normalised entities have equal ones, others of the same form never."""
    digits = "".join(str(int(c)) for c in value if c.isdecimal())
    n = len(digits)
    if kind in ("given", "surname") and value.lower() in _LISTED:
        group, k = _LISTED[value.lower()]
        name = NAMES[group][cipher.move(k, len(NAMES[group]), "|".join(group))]
        return name.upper() if value.isupper() else name.lower() if value.islower() else name
    if kind in ("given", "surname"):
        return _renamed(value, kind, cipher)
    if kind == "ipv4":
        a, b, c, d = map(int, value.split("."))
        moved = cipher.move(a << 24 | b << 16 | c << 8 | d, 1 << 32, kind)
        return ".".join(str(moved >> s & 255) for s in (24, 16, 8, 0))
    if kind == "ssn":
        return _redigited(value, str(cipher.move(int(digits), 10**n, kind)).zfill(n))
    if kind == "phone":
        kept = n - 10 if value.startswith("+") and n > 10 else 0  # the country's code stays
        size = 10 ** (n - kept)
        return _redigited(value, str(cipher.move(int(digits[kept:]), size, kind)).zfill(n - kept), kept)
    if kind == "card":
        if _luhn(digits):
            body = str(cipher.move(int(digits[:-1]), 10 ** (n - 1), "card:valid")).zfill(n - 1)
            return _redigited(value, next(body + c for c in "0123456789" if _luhn(body + c)))
        while True:  # a number that fails its check moves on among those that do
            digits = str(cipher.move(int(digits), 10**n, "card:other")).zfill(n)
            if not _luhn(digits):
                return _redigited(value, digits)
    if kind == "iban":
        plain = value.replace(" ", "")
        body = "".join(str(int(c)) if c.isdecimal() else c for c in plain[4:])
        places = [k for k, c in enumerate(body) if c.isdecimal()]
        number = str(cipher.move(int("".join(body[k] for k in places) or "0"), 10 ** len(places), f"iban:{plain[:2]}{re.sub(r'[0-9]', '0', body)}")).zfill(len(places))
        body = _redigited(body, number)
        check = 98 - int("".join(str(int(c, 36)) for c in body + plain[:2] + "00")) % 97
        new = iter(f"{plain[:2]}{check:02d}{body}")
        return "".join(c if c == " " else next(new) for c in value)
    if kind == "email":
        name, _, domain = value.rpartition("@")
        host, _, top = domain.rpartition(".")
        return f"{_relettered(name, 'local', cipher)}@{_relettered(host, 'domain', cipher)}.{top}"
    return _relettered(value, kind, cipher)


@lru_cache(maxsize=2)
def _remembering(key: bytes) -> Callable[[str, str], str]:
    cipher = Cipher(key)
    return lru_cache(maxsize=50_000)(lambda kind, value: surrogate(kind, value, cipher))


def replace(text: str, key: bytes) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with surrogates, and the entities found in the original."""
    found, out, at, put = find(text), [], 0, _remembering(key)
    for kind, a, b in found:
        out += [text[at:a], put(kind, text[a:b])]
        at = b
    return "".join([*out, text[at:]]), found


def pseudonymize(docs: DataFrame, key: bytes, text_col: str = "text", count_col: str = "n_entities", check: bool = True) -> DataFrame:
    """Replaces the entities of every whole text and adds their number; the check reads the texts once more, the replacement needs no shuffle."""
    if check and (clash := collisions(docs, key, text_col).first()) is not None:
        raise ValueError(f"{clash['entities']} entities of kind {clash['kind']} share a surrogate")
    schema = with_field(docs, count_col, "int")
    names = [f.name for f in schema][:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            done = [(None, ()) if t is None else replace(t, key) for t in part.column(text_col).to_pylist()]
            new = pa.array([t for t, _ in done], pa.string())
            yield pa.RecordBatch.from_arrays([*(new if n == text_col else part.column(n) for n in names), pa.array([len(f) for _, f in done], pa.int32())], [*names, count_col])

    return docs.select(*(F.col(f"`{n}`") for n in names)).mapInArrow(run, schema)


def collisions(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """(kind, surrogate, entities): surrogates that more than one entity of a kind has; empty if all is well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cipher, put = Cipher(key), _remembering(key)
        for part in slices(batches, text_col):
            rows = {(kind, normal(kind, put(kind, t[a:b])), cipher.fingerprint(normal(kind, t[a:b]))) for t in part.column(text_col).to_pylist() if t for kind, a, b in find(t)}
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.binary())], ["kind", "surrogate", "entity"])

    pairs = docs.select(F.col(f"`{text_col}`")).mapInArrow(run, "kind string, surrogate string, entity binary").distinct()
    return pairs.groupBy("kind", "surrogate").agg(F.count("*").alias("entities")).filter("entities > 1")


def confusions(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """(kind, entities): how many entities of a kind have a surrogate that is another entity of the corpus; such a text still names nobody of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cipher, put = Cipher(key), _remembering(key)
        for part in slices(batches, text_col):
            rows = {(kind, cipher.fingerprint(normal(kind, t[a:b])), cipher.fingerprint(normal(kind, put(kind, t[a:b])))) for t in part.column(text_col).to_pylist() if t for kind, a, b in find(t)}
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary())], ["kind", "entity", "surrogate"])

    pairs = materialize(docs.select(F.col(f"`{text_col}`")).mapInArrow(run, "kind string, entity binary, surrogate binary").distinct())
    real = pairs.select("kind", F.col("entity").alias("surrogate")).distinct()
    return pairs.join(real, ["kind", "surrogate"], "left_semi").groupBy("kind").agg(F.count("*").alias("entities"))
