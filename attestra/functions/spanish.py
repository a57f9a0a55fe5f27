"""Stems of Spanish words by the published Snowball algorithm.

A word is cut in regions: ``RV`` (after the second letter's consonant, or after
vowels and a consonant, or after the third letter), ``R1`` (after the first consonant
that follows a vowel) and ``R2`` (the same again, inside R1).  Pronouns hung on to
verb forms go first, then one derivational ending or, if there was none, one verb
ending, then what is left over; at last the acute accents go.
"""

from __future__ import annotations

from functools import cache

VOWELS = set("aeiouáéíóúü")
_PLAIN = str.maketrans("áéíóú", "aeiou")

# The endings of the published algorithm, as it lists them.
PRONOUNS = ("me", "se", "sela", "selo", "selas", "selos", "la", "le", "lo", "las", "les", "los", "nos")
ACCENTED_FORMS = ("iéndo", "ándo", "ár", "ér", "ír")
PLAIN_FORMS = ("ando", "iendo", "ar", "er", "ir")
DELETED = ("anza", "anzas", "ico", "ica", "icos", "icas", "ismo", "ismos", "able", "ables", "ible", "ibles", "ista", "istas", "oso", "osa", "osos", "osas", "amiento", "amientos", "imiento", "imientos")
WITH_IC = ("adora", "ador", "ación", "adoras", "adores", "aciones", "ante", "antes", "ancia", "ancias")
TO_LOG = ("logía", "logías")
TO_U = ("ución", "uciones")
TO_ENTE = ("encia", "encias")
Y_VERBS = ("ya", "ye", "yan", "yen", "yeron", "yendo", "yo", "yó", "yas", "yes", "yais", "yamos")
E_VERBS = ("en", "es", "éis", "emos")
VERBS = (
    "arían", "arías", "arán", "arás", "aríais", "aría", "aréis", "aríamos", "aremos", "ará", "aré",
    "erían", "erías", "erán", "erás", "eríais", "ería", "eréis", "eríamos", "eremos", "erá", "eré",
    "irían", "irías", "irán", "irás", "iríais", "iría", "iréis", "iríamos", "iremos", "irá", "iré",
    "aba", "ada", "ida", "ía", "ara", "iera", "ad", "ed", "id", "ase", "iese", "aste", "iste", "an", "aban", "ían", "aran", "ieran", "asen", "iesen", "aron", "ieron", "ado", "ido", "ando", "iendo", "ió", "ar", "er", "ir", "as",
    "abas", "adas", "idas", "ías", "aras", "ieras", "ases", "ieses", "ís", "áis", "abais", "íais", "arais", "ierais", "aseis", "ieseis", "asteis", "isteis", "ados", "idos", "amos", "ábamos", "íamos", "imos", "áramos", "iéramos", "iésemos", "ásemos",
)
RESIDUAL = ("os", "a", "o", "á", "í", "ó")


def regions(word: str) -> tuple[int, int, int]:
    """Where RV, R1 and R2 begin."""

    def after(start: int) -> int:
        for i in range(start + 1, len(word)):
            if word[i] not in VOWELS and word[i - 1] in VOWELS:
                return i + 1
        return len(word)

    rv = len(word)
    if len(word) > 2:
        if word[1] not in VOWELS:
            rv = next((i + 1 for i in range(2, len(word)) if word[i] in VOWELS), len(word))
        elif word[0] in VOWELS:
            rv = next((i + 1 for i in range(2, len(word)) if word[i] not in VOWELS), len(word))
        else:
            rv = 3
    r1 = after(0)
    return rv, r1, after(r1)


def _longest(word: str, endings: tuple[str, ...], start: int = 0) -> str:
    """The longest of the endings that lies in the word from ``start`` on."""
    return max((e for e in endings if word.endswith(e) and len(word) - len(e) >= start), key=len, default="")


def _pronouns(word: str, rv: int) -> str:
    pronoun = _longest(word, PRONOUNS)
    if not pronoun or len(word) - len(pronoun) < rv:
        return word
    verb = word[: len(word) - len(pronoun)]
    form = _longest(verb, ACCENTED_FORMS, rv)
    if form:
        return verb[: len(verb) - len(form)] + form.translate(_PLAIN)
    if _longest(verb, PLAIN_FORMS, rv) or (verb.endswith("yendo") and len(verb) - 5 >= rv and verb.endswith("uyendo")):
        return verb
    return word


def _derived(word: str, r1: int, r2: int) -> str | None:
    """The word without a derivational ending; nothing, if it has none to remove."""
    every = (*DELETED, *WITH_IC, *TO_LOG, *TO_U, *TO_ENTE, "amente", "mente", "idad", "idades", "iva", "ivo", "ivas", "ivos")
    end = _longest(word, every)
    at = len(word) - len(end)
    if not end or at < (r1 if end == "amente" else r2):
        return None
    rest = word[:at]

    def also(*endings: str) -> str:
        found = _longest(rest, endings, r2)
        return rest[: len(rest) - len(found)]

    if end in DELETED:
        return rest
    if end in WITH_IC:
        return also("ic")
    if end in TO_LOG:
        return rest + "log"
    if end in TO_U:
        return rest + "u"
    if end in TO_ENTE:
        return rest + "ente"
    if end == "amente":
        found = _longest(rest, ("iv", "os", "ic", "ad"), r2)
        rest = rest[: len(rest) - len(found)]
        return also("at") if found == "iv" else rest
    if end == "mente":
        return also("ante", "able", "ible")
    if end in ("idad", "idades"):
        return also("abil", "ic", "iv")
    return also("at")


def _verb(word: str, rv: int) -> str:
    end = _longest(word, Y_VERBS, rv)
    if end and word[: len(word) - len(end)].endswith("u"):
        return word[: len(word) - len(end)]
    end = _longest(word, (*VERBS, *E_VERBS), rv)
    rest = word[: len(word) - len(end)]
    return rest[:-1] if end in E_VERBS and rest.endswith("gu") else rest


def _residual(word: str, rv: int) -> str:
    end = _longest(word, (*RESIDUAL, "e", "é"), rv)
    rest = word[: len(word) - len(end)]
    if end in ("e", "é") and rest.endswith("gu") and len(rest) - 1 >= rv:
        return rest[:-1]
    return rest


@cache
def _stem(word: str) -> str:
    rv, r1, r2 = regions(word)
    word = _pronouns(word, rv)
    shorter = _derived(word, r1, r2)
    word = shorter if shorter is not None else _verb(word, rv)
    return _residual(word, rv).translate(_PLAIN)


def stem(word: str) -> str:
    """The stem of a lower-case word."""
    return _stem.__wrapped__(word)
