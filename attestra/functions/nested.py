"""Secrets in nested JSON, and words of any Latin spelling, in built-in functions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SECRET_KEYS

_TOKENS = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|[{}\[\],:]|[^\s{}\[\],:"]+'
REDACTED = '"[redacted]"'


def redacted_json(c: Column, keys: Sequence[str] = SECRET_KEYS) -> Column:
    """JSON text without the values of secret keys, at any depth and inside arrays, in
    compact form; text that isn't JSON gives null.  One pass over the tokens: after a
    secret key the next value is left out, however deep it is, and a mark stands for it."""

    def name(token: Column) -> Column:
        escaped = F.from_json(F.concat(F.lit("["), token, F.lit("]")), "array<string>")[0]
        return F.lower(F.when(F.contains(token, F.lit("\\")), escaped).otherwise(token.substr(F.lit(2), F.length(token) - 2)))

    def state(out: Column, depth: Column, skip: Column, last: Column, pending: Column) -> Column:
        return F.struct(out.alias("out"), depth.alias("depth"), skip.alias("skip"), last.alias("last"), pending.alias("pending"))

    def step(s: Column, t: Column) -> Column:
        opens, closes = t.isin("{", "["), t.isin("}", "]")
        depth = s["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        skipping = s["skip"] >= 0
        left = F.when(closes & (depth == s["skip"]), -1).otherwise(s["skip"])
        secret = (t == ":") & F.coalesce(name(s["last"]).isin(*keys), F.lit(False))
        return (
            F.when(skipping, state(s["out"], depth, left, s["last"], F.lit(False)))
            .when(s["pending"], state(F.concat(s["out"], F.lit(REDACTED)), depth, F.when(opens, s["depth"]).otherwise(-1), F.lit(""), F.lit(False)))
            .otherwise(state(F.concat(s["out"], t), depth, F.lit(-1), F.when(t.startswith('"'), t).otherwise(F.lit("")), secret))
        )

    start = state(F.lit(""), F.lit(0), F.lit(-1), F.lit(""), F.lit(False))
    walked = F.aggregate(F.regexp_extract_all(c, F.lit(_TOKENS), F.lit(0)), start, step, lambda s: s["out"])
    return F.when(F.try_parse_json(c).isNotNull(), walked)


@cache
def _decompositions() -> tuple[str, str, dict[str, str], str]:
    """From the standard library's tables: characters that stand for one letter or digit and
    what for; those that stand for several; and the combining marks."""
    one, several, marks = {}, {}, []
    for c in map(chr, range(0x80, 0x20000)):
        if 0xD800 <= ord(c) < 0xE000:
            continue
        if unicodedata.combining(c):
            marks.append(c)
            continue
        plain = "".join(x for x in unicodedata.normalize("NFKD", c.casefold()) if not unicodedata.combining(x)).casefold()
        if plain != c and re.search("[a-z0-9]", plain):
            if len(plain) == 1:
                one[c] = plain
            else:
                several[c] = plain
    one |= {chr(k): chr(k + 32) for k in range(ord("A"), ord("Z") + 1)}
    return "".join(one), "".join(one.values()), several, "".join(marks)


def folded_words(c: Column) -> Column:
    """Words of a-z and 0-9 after compatibility decomposition: accents go, ligatures,
    Roman numerals, fractions and full-width letters become plain ones."""
    these, those, several, marks = _decompositions()
    plain = F.translate(c, these + marks, those)  # what has no counterpart goes
    # what isn't plain by then is looked up, in texts that have such characters
    pairs = F.create_map(*[F.lit(x) for kv in several.items() for x in kv])
    spelled = F.array_join(F.transform(F.split(plain, ""), lambda x: F.when(F.ascii(x) < 128, x).otherwise(F.coalesce(F.try_element_at(pairs, x), x))), "")
    return F.regexp_extract_all(F.when(plain.rlike(r"[^\x00-\x7f]"), spelled).otherwise(plain), F.lit("[a-z0-9]+"), F.lit(0))
