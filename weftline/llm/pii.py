"""PII: surrogates for detected entities by keyed permutations.

Each entity is replaced by a keyed permutation of its own kind's values, so the
same entity has the same surrogate wherever it stands (coreference) and two
entities never share one (distinctness): the collision check is the permutation
itself, which walks on until its value is a valid one of the same kind.  No
table of entities is built and nothing is shuffled.

* e-mail: letters and digits of the local part, and of the domain but its last
  label, each permuted within their class; case and separators stay.
* phone: the national digits (without country code, trunk zero and leading zeros)
  are permuted, whatever the layout, so that +4915112345678, +49 151 12345678 and
  0151 12345678 get the same ones; country code, brackets and separators stay.
* card (Luhn-valid, 13 to 19 digits): first digit and grouping stay, the check
  digit is made anew.  IBAN (valid): country and layout stay, check digits anew.
* IPv4: permuted within its class (private ranges, loopback, public, other).
* social security number (3-2-4 digits): digits permuted.
* secrets: values named token, secret, password or api, access or secret key, and hexadecimal strings
  of 32 to 64 digits: permuted within each character's class.
* names: after a title, or a known given name with another
  capitalised word.  A known given name becomes another one of the same gender
  (or another that both have) and script, also after a title of the other gender:
  the name alone has to have the same surrogate.  Other names are permuted letter
  by letter, vowels and consonants apart, within their script, past the known ones,
  and keep an ending that tells a gender (-a, -ova, -ский, -ος); letters of a script
  without classes here within their part of the code table.  Case and length of
  such names stay.

Digits that fail a kind's check (Luhn, octets above 255) are left alone.  A match
that ran on into its neighbours is tried with shorter ends, at its groups' ends,
and where none holds the search goes on just after its first group.  Entities may
have any length: letters are permuted in runs of CHUNK, each under what stands
before it, in time proportional to the length.
Results for odd input: a null text stays null; an empty one stays; texts
without entities stay as they are; a key of no bytes is refused; equal rows give
equal rows; extra columns pass through.  No value is its own surrogate
where its kind has another of its form.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import id_type, rows

#: For tests and checks; a production run passes a secret of its own.
DEFAULT_KEY = b"weftline surrogate key"

GIVEN = {
    ("f", "latin"): "anna emma maria laura sofia julia elena lucia clara marie sarah alice jane mary susan linda karen nancy helga ingrid carmen pilar juliette emily olivia sophia isabella charlotte amelia evelyn abigail elizabeth emilia hannah natalie zoe leah audrey claire samantha caroline naomi jessica jennifer patricia barbara margaret lisa betty sandra kimberly donna michelle amanda melissa deborah stephanie rebecca sharon cynthia kathleen amy angela shirley brenda pamela nicole katherine catherine christine rachel carolyn janet diane heather julie lauren christina joanna evelina judith megan cheryl jacqueline martha teresa sara janice kathryn gloria priya anjali pooja neha divya kavya ananya deepika lakshmi sunita fatima aisha zainab khadija maryam leila yasmin amina yuki sakura hana aiko keiko yoko akiko minji jiwoo sofía lucía martina paula valentina camila ximena rosa beatriz inês mariana gabriela fernanda larissa chiara giulia francesca alessandra elisa federica katharina sabine petra monika ursula heike birgit claudia johanna lena leonie amélie chloé léa manon inès océane hélène élodie céline agnieszka katarzyna małgorzata magdalena ewa zofia ingeborg astrid freja sigrid kirsten annika ayşe fatma zeynep elif emine".split(),
    ("m", "latin"): "john james peter paul mark david daniel thomas michael robert william hans karl jürgen wolfgang carlos josé miguel pierre louis antoine luca marco liam noah oliver benjamin lucas henry theodore alexander jacob ethan samuel joseph matthew jackson sebastian aiden owen dylan luke gabriel anthony isaac julian christopher joshua andrew nathan aaron ryan adam kevin brian george edward ronald timothy jason jeffrey gary nicholas eric jonathan stephen larry justin scott brandon gregory raymond patrick dennis jerry tyler jose henrik douglas zachary kyle walter harold keith roger arthur gerald lawrence sean albert joe bruce raj arjun rahul amit vikram sanjay rohan anil sunil suresh ramesh rajesh krishna mohammed muhammad mohamed ahmed ali omar hassan hussein ibrahim yusuf khalid abdullah hiroshi kenji takashi haruto yuto satoshi minjun jihoon juan luis jorge pedro alejandro fernando javier antonio manuel francisco diego rafael sergio andrés joão paulo tiago rodrigo gustavo giuseppe giovanni francesco alessandro matteo lorenzo andreas stefan jens uwe klaus dieter markus tobias florian lukas felix maximilian fritz heinrich étienne françois jacques philippe nicolas guillaume olivier laurent rené thierry piotr krzysztof tomasz paweł marcin lars sven björn erik nils magnus anders mehmet mustafa ahmet emre".split(),
    ("", "latin"): "andrea camille robin kim alex sascha dominique claude jamie taylor jordan morgan casey leslie ashley kelly shannon ariel noa toni charlie sam riley avery quinn rowan jean nicola simone noor wei jun ling mei joyce".split(),
    ("f", "cyrillic"): "анна мария елена ольга наталья ирина татьяна светлана юлия екатерина александра анастасия вера виктория галина дарья ксения людмила маргарита надежда оксана полина софья валентина алина".split(),
    ("m", "cyrillic"): "иван пётр алексей дмитрий сергей андрей николай михаил владимир олег александр антон борис виктор виталий георгий денис евгений игорь кирилл константин максим никита павел роман юрий артём".split(),
    ("f", "greek"): "μαρία ελένη άννα σοφία κατερίνα ιωάννα ειρήνη βασιλική δήμητρα αικατερίνη χριστίνα παναγιώτα ευαγγελία".split(),
    ("m", "greek"): "γιώργος δημήτρης νίκος κώστας γιάννης παύλος χρήστος βασίλης αλέξανδρος σπύρος θανάσης μιχάλης στέλιος".split(),
}
_KNOWN = {name: (place, i) for place, names in GIVEN.items() for i, name in enumerate(names)}
_TITLES = "Mr Herr Señor Sr Monsieur господин Господин κύριος Κύριος Sir Lord Signor Senhor السيد Mrs Ms Miss Frau Señora Sra Señorita Madame Mme госпожа Госпожа κυρία Κυρία Lady Dame Mlle Mademoiselle Signora Senhora السيدة الآنسة Dr Prof Professor Mx Docteur Doctor Doktor доктор Доктор профессор Профессор Δρ الدكتور الدكتورة".split()
#: Endings that tell a gender, longest first.
_ENDINGS = sorted("a á e o ova eva ová ina ska ská cka ski ský cki sky ov ev а я ова ева ёва ина ская ский ой ов ев ёв ин οπούλου όπουλος ου ος ης ας ός ής άς α η ά ή".split(), key=len, reverse=True)
_CLASSES = ["0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "áéíóúàèìòùâêîôûäöüëï", "ñçß", "аеиоуыэюяё", "бвгджзйклмнпрстфхцчшщъь", "αεηιουωάέήίόύώ", "βγδζθκλμνξπρστφχψς"]


class _ByScript(dict):
    """The class of every letter: one of _CLASSES, or letters of its kind in its part of the code table."""

    def __contains__(self, c: object) -> bool:
        return isinstance(c, str) and (dict.__contains__(self, c) or c.isalpha())

    def __missing__(self, c: str) -> str:
        code, kind = ord(c), unicodedata.category(c)
        low, high = next((r for r in ((0x3400, 0x4DB6), (0x4E00, 0x9FA6), (0xAC00, 0xD7A4)) if r[0] <= code < r[1]), (code & ~127, (code & ~127) + 128))
        same = [x for x in map(chr, range(low, high)) if unicodedata.category(x) == kind and not dict.__contains__(self, x) and unicodedata.normalize("NFKC", x) == x and x.lower() == x and (kind == "Lo" or (len(x.upper()) == 1 and x.upper().lower() == x))]
        self[c] = "".join(same) if c in same else c
        return self[c]


_VOWELED = _ByScript({c: k for k in _CLASSES for c in k})
_PLAIN = {c: k for k in ("0123456789", "abcdefghijklmnopqrstuvwxyz") for c in k}

_NAME_WORD = r"[^\W\d_a-zа-яα-ω][^\W\d_]+(?:-[^\W\d_]+)?"
_KNOWN_RE = "|".join(sorted((re.escape(n[0].upper() + n[1:]) for n in _KNOWN), key=len, reverse=True))
_PARTS = [
    r"(?P<email>(?<![\w.+%-])[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9_%+-])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}(?![\w@]))",
    r"(?i:\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key|secret[_-]?key)\b[\"']?\s*[:=]\s*[\"']?)(?P<secret>[A-Za-z0-9_+/=.-]{8,})",
    r"(?P<hex>(?<![0-9A-Za-z])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z]))",
    r"(?P<ip>(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\w|\.\d))",
    r"(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w))",
    r"(?P<card>(?<![\w.])\d(?:[ -]?\d){12,18}(?!\w))",
    r"(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))",
    r"(?P<phone>(?<![\w+(])(?:(?:(?:\+\d{1,3}[ .-]?)|00\d{1,3}[ .-])(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|\d{3}[ .-]\d{3}[ .-]\d{4}|0\d{2,4}[ /-]\d{3,8}(?:[ -]\d{2,8}){0,3})(?!\w))",
    rf"(?P<title>\b(?:{'|'.join(sorted(_TITLES, key=len, reverse=True))})\b\.? )(?P<name>{_NAME_WORD}(?: {_NAME_WORD})?)",
    rf"(?P<full>\b(?:{_KNOWN_RE}) {_NAME_WORD})",
]
PATTERN = re.compile("|".join(_PARTS))
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_QUAD = re.compile(rf"(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\w|\.\d)")
#: What may stand at a card's start in its place.
_NOT_CARD = re.compile("|".join(x for x in _PARTS if x.startswith(("(?P<ssn>", "(?P<phone>"))))
#: Layouts of cards; shorter ends and later starts than those of a match that failed are held to them, as each further try passes Luhn once in ten.
_CARD_SHAPE = re.compile(r"\d{13,19}|\d{4}([ -]?)\d{4}\1\d{4}\1\d{1,4}(?:\1\d{1,3})?|\d{4}([ -])\d{6}\2\d{4,5}|\d{4}([ -])\d{3}\3\d{3}\3\d{3}")
#: Entities of digits alone, at whose start a number before them ends.
_NEXT = re.compile(rf"{_QUAD.pattern}|\d{{3}}-\d{{2}}-\d{{4}}(?![\w-])|\(?\d{{3}}\)?[ .-]\d{{3}}[ .-]\d{{4}}(?!\w)|\d{{4}}[ -]?(?:\d{{4}}[ -]?\d{{4}}[ -]?\d{{4}}|\d{{6}}[ -]?\d{{5}})(?!\w)")
#: A text that this linear-time expression doesn't match holds no entity; it only spares work.
_MAYBE = "[0-9@]|" + "|".join(rf"{t}\.? " for t in _TITLES) + "|(?i:token|secret|passw|key)|" + "|".join(rf"{n[0].upper() + n[1:]} " for n in _KNOWN)


#: Characters that are permuted together: 2**15 to this power is within the 64 bytes of the two halves' pseudo-random function.
CHUNK = 32


def _prf(key: bytes, tweak: str, turn: int, value: int) -> int:
    data = b"%s\0%d\0%s" % (tweak.encode("utf-8", "surrogatepass"), turn, value.to_bytes((value.bit_length() + 7) // 8, "big"))
    return int.from_bytes(hashlib.blake2b(data, key=key, digest_size=64).digest(), "big")


def _network(key: bytes, tweak: str, value: int, domain: int, back: bool = False) -> int:
    """A keyed bijection of range(domain), or its inverse: a Feistel network that walks its cycle until it is inside."""
    bits = max(2, (domain - 1).bit_length())
    low = bits // 2
    high = bits - low
    while True:
        a, b, wa, wb = value >> low, value & ((1 << low) - 1), high, low
        for turn in range(9, -1, -1) if back else range(10):
            if back:
                a, b, wa, wb = b ^ (_prf(key, tweak, turn, a) & ((1 << wb) - 1)), a, wb, wa
            else:
                a, b, wa, wb = b, a ^ (_prf(key, tweak, turn, b) & ((1 << wa) - 1)), wb, wa
        value = (a << low) | b
        if value < domain:
            return value


def permute(key: bytes, tweak: str, value: int, domain: int, valid: Callable[[int], bool] | None = None) -> int:
    """A keyed bijection of range(domain), or of its valid values, in which none of two or more is its own image: the next one in a keyed order."""
    if domain < 2:
        return value
    tweak = f"{tweak}|{domain}"
    while True:
        value = _network(key, tweak, (_network(key, tweak, value, domain) + 1) % domain, domain, back=True)
        if valid is None or valid(value):
            return value


def _letters(key: bytes, tweak: str, text: str, classes: dict[str, str], valid: Callable[[str], bool] | None = None) -> str:
    """text with each character of a class permuted, all together, within its class; case stays, other characters too.

    A longer text than CHUNK goes run by run under a digest of what stands before, which is a bijection of the whole as well.
    """
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    done, before = [], b""
    for at in range(0, len(low), CHUNK):
        part = low[at : at + CHUNK]
        last = at + CHUNK >= len(low)
        ok = (lambda w: valid("".join([*done, w]))) if valid and last else None
        done.append(_run_of_letters(key, f"{tweak}|{before.hex()}", part, classes, ok))
        before = hashlib.blake2b(before + part.encode("utf-8", "surrogatepass"), digest_size=16).digest()
    return "".join(n.upper() if o != lo and len(n.upper()) == 1 else n for n, o, lo in zip("".join(done), text, low))


def _run_of_letters(key: bytes, tweak: str, low: str, classes: dict[str, str], valid: Callable[[str], bool] | None) -> str:
    places = [i for i, c in enumerate(low) if c in classes]
    radix = [classes[low[i]] for i in places]
    value, domain = 0, 1
    for i, r in zip(places, radix):
        value, domain = value * len(r) + r.index(low[i]), domain * len(r)

    def written(v: int) -> str:
        out = list(low)
        for i, r in zip(reversed(places), reversed(radix)):
            v, k = divmod(v, len(r))
            out[i] = r[k]
        return "".join(out)

    shape = "".join(classes[c][0] if c in classes else c for c in low)
    return written(permute(key, f"{tweak}|{shape}", value, domain, (lambda v: valid(written(v))) if valid else None))


def _digits(text: str, new: str) -> str:
    """text with its digits replaced by those of new."""
    it = iter(new)
    return "".join(next(it) if c.isdigit() else c for c in text)


def luhn(digits: str) -> bool:
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def _card(key: bytes, text: str) -> str | None:
    d = re.sub(r"\D", "", text)
    if not d.isascii() or not luhn(d) or len(set(d)) == 1:
        return None
    middle = f"{permute(key, f'card|{d[0]}', int(d[1:-1]), 10 ** (len(d) - 2), lambda v: len(set(_checked(d[0] + f'{v:0{len(d) - 2}d}'))) > 1):0{len(d) - 2}d}"
    return _digits(text, _checked(d[0] + middle))


def _checked(digits: str) -> str:
    return next(digits + c for c in "0123456789" if luhn(digits + c))


def _iban_mod(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _iban(key: bytes, text: str) -> str | None:
    s = text.replace(" ", "")
    if not 15 <= len(s) <= 34 or _iban_mod(s) != 1:
        return None
    account = _letters(key, f"iban|{s[:2]}", s[4:], _PLAIN)
    new = s[:2] + f"{98 - _iban_mod(s[:2] + '00' + account):02d}" + account
    it = iter(new)
    return "".join(c if c == " " else next(it) for c in text)


def _ip_class(v: int) -> int:
    a, b = v >> 24, v >> 16 & 255
    if a == 10:
        return 1
    if a == 172 and 16 <= b < 32:
        return 2
    if a == 192 and b == 168:
        return 3
    if a == 127:
        return 4
    return 5 if 0 < a < 224 else 6


def _ip(key: bytes, text: str) -> str | None:
    octets = text.split(".")
    if any(int(o) > 255 or (len(o) > 1 and o[0] == "0") for o in octets):
        return None
    v = int.from_bytes(bytes(map(int, octets)), "big")
    kind = _ip_class(v)
    # The narrow classes are permuted within their own range; a walk over all addresses would be long.
    fixed = {1: (0x0A000000, 24), 2: (0xAC100000, 20), 3: (0xC0A80000, 16), 4: (0x7F000000, 24)}
    if kind in fixed:
        base, bits = fixed[kind]
        new = base + permute(key, f"ip|{kind}", v - base, 1 << bits)
    else:
        new = permute(key, f"ip|{kind}", v, 1 << 32, lambda x: _ip_class(x) == kind)
    return ".".join(map(str, new.to_bytes(4, "big")))


def _email(key: bytes, text: str) -> str:
    local, _, domain = text.partition("@")
    labels = domain.split(".")
    return _letters(key, "local", local, _PLAIN) + "@" + ".".join([*(_letters(key, "domain", x, _PLAIN) for x in labels[:-1]), labels[-1]])


#: The country calling codes: no one begins another.
_COUNTRY = re.compile(r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9]\d\d")


def _phone(key: bytes, text: str) -> str | None:
    plus = re.match(r"\+|00", text)
    at = plus.end() if plus else 0
    if plus and (country := _COUNTRY.match(text, at)):
        at = country.end()
        if trunk := re.match(r"[ .-]?\(0\)", text[at:]):
            at += trunk.end()
    head, rest = text[:at], text[at:]
    d = re.sub(r"\D", "", rest)
    if not d.isascii() or not (7 <= len(d) <= 14 if plus or d[0] != "0" else 9 <= len(d) <= 12):
        return None
    # One number in two layouts, with or without its country code or trunk zero, has one surrogate.
    number = d.lstrip("0")
    if len(number) < 6:
        return None
    low = 10 ** (len(number) - 1)
    return head + _digits(rest, "0" * (len(d) - len(number)) + str(low + permute(key, f"phone|{len(number)}", int(number) - low, 9 * low)))


def _ssn(key: bytes, text: str) -> str:
    d = text.replace("-", "")
    return _digits(text, f"{permute(key, 'ssn', int(d), 10**9):09d}")


def _ending(low: str) -> str:
    """The ending that tells a gender, if at least two letters stand before it."""
    return next((e for e in _ENDINGS if low.endswith(e) and len(low) >= len(e) + 2), "")


def _word(key: bytes, word: str) -> str:
    low = word.lower()
    if low in _KNOWN:
        (g, script), i = _KNOWN[low]
        names = GIVEN[g, script]
        new = names[permute(key, f"given|{g}|{script}", i, len(names))]
        return new.upper() if word.isupper() and len(word) > 1 else new[0].upper() + new[1:]
    end = _ending(low) if len(low) == len(word) else ""
    stem = len(word) - len(end)
    return _letters(key, f"name|{end}", word[:stem], _VOWELED, lambda w: w + end not in _KNOWN and _ending(w + end) == end) + word[stem:]


def _name(key: bytes, text: str) -> str:
    return " ".join(_word(key, w) for w in text.split(" "))


def surrogate(key: bytes, kind: str, text: str) -> str | None:
    """The surrogate of an entity, or None if it isn't a valid one of its kind."""
    if kind == "email":
        return _email(key, text)
    if kind == "phone":
        return _phone(key, text)
    if kind == "card":
        return _card(key, text)
    if kind == "iban":
        return _iban(key, text)
    if kind == "ip":
        return _ip(key, text)
    if kind == "ssn":
        return _ssn(key, text)
    if kind in ("secret", "hex"):
        hexadecimal = {c: "0123456789abcdef" for c in "0123456789abcdef"}
        return _letters(key, "secret", text, hexadecimal if re.fullmatch("[0-9a-f]+|[0-9A-F]+", text) else _PLAIN)
    return _name(key, text)


_remembered = lru_cache(50_000)(surrogate)


def _cached(key: bytes, kind: str, text: str) -> str | None:
    return (_remembered if len(text) <= 64 else surrogate)(key, kind, text)


def _ends(kind: str, text: str, a: int, b: int) -> list[int]:
    """Ends that the entity from a may have, best first: before another entity, then the latest; none lies inside an address."""
    ends = [b, *(e for e in range(b - 1, a, -1) if text[e] in " .-" and text[e - 1].isalnum())]
    quads = [q.span() for q in _QUAD.finditer(text, a, min(len(text), b + 16))]
    ends = [e for e in ends if not any(x < e < y for x, y in quads)]
    # A number of the North American plan has ten digits.
    ten = kind == "phone" and re.match(r"\+1(?=[ .(-])", text[a:b])
    return sorted(ends, key=lambda e: (not (e + 1 < len(text) and _NEXT.match(text, e + 1)), not (ten and sum(c.isdigit() for c in text[a:e]) == 11), -e))


def _entity(key: bytes, kind: str, text: str, a: int, b: int, again: bool) -> tuple[str, int, str] | None:
    """(kind, end, surrogate) of the entity at a, whose pattern ends at b; again: a match over a failed before."""
    if kind not in ("phone", "card", "iban"):
        new = _cached(key, kind, text[a:b])
        return None if new is None else (kind, b, new)
    other = _NOT_CARD.match(text, a) if kind == "card" else None
    for e in _ends(kind, text, a, b):
        part = text[a:e]
        if kind == "card" and (again or other or e < b) and not _CARD_SHAPE.fullmatch(part):
            continue
        if kind == "card" and not 13 <= sum(c.isdigit() for c in part) <= 19:
            continue
        new = _cached(key, kind, part)
        if new is not None:
            return kind, e, new
    return _entity(key, other.lastgroup, text, a, other.end(), again) if other else None


def replace(text: str, key: bytes) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with surrogates, and (kind, start, length) of each in it."""
    out, found, at, size, pos, failed = [], [], 0, 0, 0, 0
    while m := PATTERN.search(text, pos):
        kind = m.lastgroup
        a, b = m.span(kind)
        entity = _entity(key, kind, text, a, b, a < failed)
        if entity is None:
            pos, failed = next((i for i in range(a + 1, b) if text[i] in " .-"), b), max(failed, b)
            continue
        kind, b, new = entity
        out += [text[at:a], new]
        size += a - at
        found.append(({"hex": "secret", "full": "name"}.get(kind, kind), size, len(new)))
        size += len(new)
        at = pos = b
    if not found:
        return text, found
    return "".join([*out, text[at:]]), found


def _batch(texts: pa.Array, key: bytes) -> tuple[pa.Array, list[list[tuple[str, int, int]]]]:
    maybe = pc.fill_null(pc.match_substring_regex(texts, _MAYBE), False).to_numpy(zero_copy_only=False)
    found: list[list[tuple[str, int, int]]] = [[] for _ in range(len(texts))]
    changed, values = maybe & False, []
    for i in maybe.nonzero()[0].tolist():
        new, found[i] = replace(texts[i].as_py(), key)
        if found[i]:
            changed[i] = True
            values.append(new)
    if values:
        texts = pc.replace_with_mask(texts, pa.array(changed), pa.array(values, texts.type))
    return texts, found


def _key(key: bytes) -> bytes:
    if not key:
        raise ValueError("surrogates need a key")
    return hashlib.sha256(key).digest()


def _entities(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("length", pa.int32())]))
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                texts, found = _batch(part.column(1), key)
                lists = pa.array([[dict(zip(("kind", "start", "length"), e)) for e in x] for x in found], kind)
                yield pa.RecordBatch.from_arrays([part.column(0), texts, lists], names=["doc_id", "text", "entities"])

    return run


def surrogates(docs: DataFrame, key: bytes = DEFAULT_KEY) -> DataFrame:
    """doc_id, text with surrogates, entities (kind, start, length in characters of the new text) of every row."""
    return rows(docs).mapInArrow(_entities(_key(key)), f"doc_id {id_type(docs)}, text string, entities array<struct<kind: string, start: int, length: int>>")


def _replaced(key: bytes, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                texts, _ = _batch(part.column(at), key)
                yield pa.RecordBatch.from_arrays([texts if k == at else c for k, c in enumerate(part.columns)], schema=part.schema)

    return run


def replace_all(docs: DataFrame, key: bytes = DEFAULT_KEY) -> DataFrame:
    """docs, all columns, with surrogates in text; n_chars, if there, is the new text's length."""
    out = docs.mapInArrow(_replaced(_key(key), docs.columns.index("text")), docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out
