"""Labelled personal data planted into texts, to learn from and to measure with.

For each kind there are spans that are personal data and look-alikes that are not. Both are set into the
texts of a table between two words, most with a word before them that such data have in the four
languages of the corpus, and some of either with one that belongs to the other.
"""

from __future__ import annotations

import random
import string
from collections.abc import Callable

# Words before a span, of each kind and of look-alikes.
CUE_WORDS = {
    "account": ["IBAN", "account", "Konto", "compte", "cuenta", "bank"],
    "address6": ["from", "host", "client", "login from", "IP"],
    "local_phone": ["call", "phone", "Tel.", "mobile", "Telefon", "teléfono", "téléphone", "fax"],
    "number": ["card", "customer", "account", "member", "passport", "Karte", "tarjeta", "carte", "id"],
    "secret": ["token", "api key", "password", "secret", "Passwort", "clave", "key"],
    "spelled_email": ["mail", "e-mail", "write to", "contact", "correo", "courriel"],
}
PLAIN_WORDS = ["version", "page", "chapter", "on", "at", "since", "section", "see", "about", "ISBN", "file", "time"]
_JOINS = [" ", ": ", " = ", ' = "', " is ", "="]
_DIGITS, _HEX = "0123456789", "0123456789abcdef"
_OPEN = string.ascii_letters + _DIGITS


def _some(rng: random.Random, letters: str, n: int) -> str:
    return "".join(rng.choice(letters) for _ in range(n))


def _word(rng: random.Random, words: list[str]) -> str:
    """One of ``words``, or one of made-up syllables, as a text may have few words of its own."""
    if words and rng.random() < 0.5:
        return rng.choice(words)
    syllables = (_some(rng, "bcdfghklmnprstvw", rng.randint(0, 2)) + rng.choice("aeiou") + _some(rng, "lmnrst", rng.randint(0, 1)) for _ in range(rng.randint(1, 3)))
    return "".join(syllables)


def _grouped(text: str, n: int, by: str = " ") -> str:
    return by.join(text[i : i + n] for i in range(0, len(text), n))


def _account(rng: random.Random, words: list[str], wrong: int = 0) -> str:
    country = _some(rng, string.ascii_uppercase, 2)
    own = _some(rng, _DIGITS + rng.choice(["", "", string.ascii_uppercase]), rng.randint(11, 26))
    check = 98 - int("".join(str(int(c, 36)) for c in own + country + "00")) % 97
    text = f"{country}{(check + wrong) % 97 if wrong else check:02}{own}"
    return _grouped(text, 4) if rng.random() < 0.5 else text


def _product(rng: random.Random, words: list[str]) -> str:
    return _account(rng, words, rng.randint(2, 90))


def _address6(rng: random.Random, words: list[str]) -> str:
    groups = [_some(rng, _HEX, rng.randint(1, 4)) for _ in range(8)]
    if rng.random() < 0.5:
        a = rng.randint(1, 5)
        return ":".join(groups[:a]) + "::" + ":".join(groups[rng.randint(max(a + 1, 4), 7) :])
    return ":".join(groups)


def _clock(rng: random.Random, words: list[str]) -> str:
    return ":".join(f"{rng.randrange(60):02}" if rng.random() < 0.8 else str(rng.randrange(10)) for _ in range(rng.randint(4, 6)))


def _local_phone(rng: random.Random, words: list[str]) -> str:
    first, by = "0" * (rng.random() < 0.7) + _some(rng, "123456789", rng.randint(2, 3)), rng.choice(" -/ ")
    if rng.random() < 0.3:
        first = f"({first})"
    return first + by + by.join(_some(rng, _DIGITS, rng.randint(3, 4)) for _ in range(2))


def _date(rng: random.Random, words: list[str]) -> str:
    day, month, year = f"{rng.randint(1, 28):02}", f"{rng.randint(1, 12):02}", str(rng.randint(1900, 2035))
    by = rng.choice(".-/ ")
    return by.join(rng.choice([[day, month, year], [year, month, day], [year, str(int(year) + rng.randint(1, 30))], [day, month, year, day]]))


def _quantity(rng: random.Random, words: list[str]) -> str:
    return f"{rng.randint(10, 999)} " + " ".join(f"{rng.randrange(1000):03}" if rng.random() < 0.4 else "000" for _ in range(rng.randint(1, 3)))


def _number(rng: random.Random, words: list[str]) -> str:
    own = _some(rng, _DIGITS, rng.choice([9, 11, 12, 14, 15, 16, 16, 16, 17, 18, 19]))
    return _grouped(own, 4, rng.choice(" -")) if rng.random() < 0.3 else own


def _moment(rng: random.Random, words: list[str]) -> str:
    seconds = str(rng.randint(1_000_000_000, 1_999_999_999))
    return seconds + _some(rng, _DIGITS, 3) if rng.random() < 0.5 else seconds


def _book(rng: random.Random, words: list[str]) -> str:
    own = rng.choice(["978", "979"]) + _some(rng, _DIGITS, 9)
    own += str(-sum(int(d) * (1 + 2 * (i % 2)) for i, d in enumerate(own)) % 10)
    return rng.choice([own, f"{own[:3]}-{own[3]}-{own[4:8]}-{own[8:12]}-{own[12]}"])


def _secret(rng: random.Random, words: list[str]) -> str:
    form = rng.randrange(5)
    if form == 0:
        return _some(rng, rng.choice([_HEX, _HEX.upper()]), rng.choice([16, 24, 32, 40, 64]))
    if form == 1:
        return _some(rng, _OPEN + "-_", rng.randint(18, 90))
    if form == 2:
        return _some(rng, string.ascii_letters, rng.randint(18, 48))
    if form == 3:
        return rng.choice(["key_", "sk-", "tok_", "pat-"]) + _some(rng, _OPEN, rng.randint(16, 40))
    return _some(rng, rng.choice([string.ascii_uppercase, string.ascii_lowercase]) + _DIGITS, rng.randint(20, 52))


def _name(rng: random.Random, words: list[str]) -> str:
    parts = [_word(rng, words) for _ in range(rng.randint(3, 7))]
    text = rng.choice(["_", "-", "_", ""]).join(rng.choice([parts, [p.capitalize() for p in parts], [p.upper() for p in parts]]))
    text += rng.choice(["", "", f"_{rng.randrange(2000)}", f"-v{rng.randrange(20)}"])
    while len(text) < 16:
        text += f"_{_word(rng, words)}"
    return text


def _rule(rng: random.Random, words: list[str]) -> str:
    return _some(rng, rng.choice(["-", "_", "a", "=-", "0", "x"]), 1) * rng.randint(16, 60)


def _spelled_email(rng: random.Random, words: list[str]) -> str:
    name, site = _word(rng, words).lower(), _word(rng, words).lower()
    if rng.random() < 0.4:
        name += rng.choice([".", "_", ""]) + str(rng.randrange(100))
    at, dot = rng.choice([(" at ", " dot "), ("(at)", "."), ("[at]", "[dot]"), (" (at) ", " dot "), (" @ ", "."), ("@", " dot "), (" [at] ", " [dot] ")])
    return f"{name}{at}{site}{dot}{rng.choice(['com', 'org', 'net', 'de', 'fr', 'es', 'io'])}"


def _meeting(rng: random.Random, words: list[str]) -> str:
    one, two, three = (_word(rng, words) for _ in range(3))
    return rng.choice([f"{one} @ {two}. {three.capitalize()}", f"{one} @{two} . {three}", f"{one} at {two} dot {three}s", f"{one} (at) {two}. {three.capitalize()}"])


Maker = Callable[[random.Random, list[str]], str]
PERSONAL: dict[str, Maker] = {
    "account": _account,
    "address6": _address6,
    "local_phone": _local_phone,
    "number": _number,
    "secret": _secret,
    "spelled_email": _spelled_email,
}
ALIKE: dict[str, list[Maker]] = {
    "account": [_product],
    "address6": [_clock],
    "local_phone": [_date, _quantity],
    "number": [_moment, _book, _quantity],
    "secret": [_name, _name, _rule],
    "spelled_email": [_meeting],
}
_REACH = 80


def planted(text: str, seed: object, kind: str, personal: bool) -> tuple[str, int, int]:
    """(stretch of ``text`` with a span set into it, the span's start, its end); the same for the same seed.

    The span stands between two words of the text, or alone where it has none.
    """
    rng = random.Random(f"{seed}:{kind}:{personal}")
    at = rng.randrange(len(text)) if text else 0
    at = text.rfind(" ", 0, at + 1) + 1
    around = text[max(0, at - _REACH) : at], text[at : at + _REACH]
    words = [w for w in " ".join(around).split() if w.isascii() and w.isalpha() and len(w) <= 12]
    make = PERSONAL[kind] if personal else rng.choice(ALIKE[kind])
    span = make(rng, words)
    chance = rng.random()
    own, other = CUE_WORDS[kind], PLAIN_WORDS
    if not personal:
        own, other = other, own
    cue = "" if chance < 0.35 else rng.choice(own if chance < 0.9 else other) + rng.choice(_JOINS)
    before = f"{around[0]}{cue}"
    after = rng.choice([" ", ". ", ", "]) if not cue.endswith('"') else '" '
    return f"{before}{span}{after}{around[1]}", len(before), len(before) + len(span)
