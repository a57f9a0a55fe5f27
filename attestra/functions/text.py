"""Text expressions.  All are native columns unless said otherwise."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accents folded one to one, so that offsets survive.
ACCENTED = "áéíóúüñÁÉÍÓÚÜÑ"
PLAIN = "aeiouunAEIOUUN"

# Phrases that address a system instead of a reader (finding).
DIRECTIVE_PATTERNS = (
    r"ignore\s+(all\s+)?previous\s+instructions",
    r"disregard\s+(all\s+)?(prior|previous)",
    r"you\s+are\s+now\s+in\s+\w+\s+mode",
    r"\bsystem\s*:",
    r"</?document>",
    r"assistant\s*:",
    r"approve\s+(this\s+)?dossier",
    r"delete\s+the\s+audit",
    r"set\s+every\s+finding",
)

# Phrases that keep a passage out of a prompt (English, Spanish).
SCREEN_PATTERNS = (
    r"ignore\s+(all\s+)?(previous|prior)\s+instructions",
    r"disregard\s+(all\s+)?(prior|previous)",
    r"olvida\s+(todas\s+)?las\s+instrucciones",
    r"ignora\s+(todo|las\s+instrucciones)",
    r"you\s+are\s+now\s+in\s+\w+\s+mode",
    r"ahora\s+est[áa]s\s+en\s+modo\s+\w+",
    r"^\s*(system|assistant|user)\s*:",
    r"^\s*(sistema|asistente|usuario)\s*:",
    r"approve\s+(this\s+)?dossier",
    r"aprueba\s+(este\s+)?expediente",
    r"marca\s+(todas\s+)?las\s+incidencias",
    r"set\s+every\s+finding",
    r"delete\s+the\s+audit",
    r"borra\s+(la\s+)?auditor[íi]a",
    r"call\s+the\s+tool",
    r"llama\s+a\s+la\s+herramienta",
    r"</\s*evidencia",
)

# Characters with which a spreadsheet begins a formula.
FORMULA_START = r"^[=+\-@\t\r]"

# Keys whose values never reach a log.
SECRET_KEYS = ("api_key", "authorization", "password", "token", "secret", "x-api-key", "llm_api_key")


#: White space, Unicode's included.
SPACES = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def lower(c: Column) -> Column:
    """Lower case, letter by letter: a capital I with dot gets no mark of its own."""
    return F.lower(F.replace(c, F.lit("İ"), F.lit("i")))


def fold(c: Column) -> Column:
    """Lower case without accents, as long as the original."""
    return F.lower(F.translate(c, ACCENTED, PLAIN))


def collapse_spaces(c: Column) -> Column:
    """Runs of spaces and tabs (not line ends) become one space."""
    return F.trim(F.regexp_replace(c, "[ \\t\\u00A0\\u202F]+", " "))


def label_pattern(label: str) -> tuple[str, int]:
    """The expression of a label and its value on folded text, and the value's group."""
    # folded text needs no case flag; naming the Unicode spaces is much faster than the flag for them
    spaced = label.replace("\\s", SPACES)
    groups = len([1 for i, x in enumerate(label) if x == "(" and label[i + 1 : i + 2] != "?" and label[i - 1 : i] != "\\"])
    return f"{spaced}{SPACES}*:?{SPACES}*([^\\n\\r]+)", groups + 1


def labelled_match(folded: Column, label: str) -> Column:
    """A label with its value, or the empty text.  Texts that lack a word of the
    label are passed over before any expression."""
    return F.when(F.contains(folded, F.lit(certain_word(label))), F.regexp_extract(folded, label_pattern(label)[0], 0)).otherwise("")


def labelled_value(c: Column, label: str) -> Column:
    """Struct of the value after a label, and its start and end in the text;
    null where the label is missing.  The value may stand on the next line."""
    folded = fold(c)
    whole = labelled_match(folded, label)
    value = F.regexp_extract(whole, *label_pattern(label))  # of the short match, not of the text
    start = F.instr(folded, whole) - 1 + F.length(whole) - F.length(value)
    found = F.struct(collapse_spaces(F.substring(c, start + 1, F.length(value))).alias("value"), start.alias("start"), (start + F.length(value)).alias("end"))
    return F.when(F.length(whole) > 0, found)


def certain_word(pattern: str) -> str:
    """The longest run of letters that every match of a label holds; empty if
    there is none.  Labels have no alternatives but in brackets."""
    outer = re.sub(r"\[[^]]*\][?*+]?", " ", pattern)
    while "(" in outer:
        outer = re.sub(r"(?<!\\)\([^()]*\)[?*+]?", " ", outer.replace("\\(", " ").replace("\\)", " "))
    if "|" in outer:
        return ""
    outer = re.sub(r"\\.|.[?*]|\{[^}]*\}", " ", outer)
    return max(re.findall("[a-z]+", outer), key=len, default="")


def reference_key(c: Column) -> Column:
    return F.regexp_replace(F.upper(c), "[^A-Z0-9-]", "")


def strip_dashes(c: Column) -> Column:
    return F.btrim(c, F.lit("- "))


def alternatives(patterns: Sequence[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def directive_hits(c: Column, patterns: Sequence[str] = DIRECTIVE_PATTERNS, most: int = 10) -> Column:
    """Distinct matches in lower case, sorted, the first ``most``.  Texts that lack
    a word of each pattern are passed over before any expression."""
    found = F.regexp_extract_all(c, F.lit(f"(?i){alternatives(patterns)}"), F.lit(0))
    hits = F.slice(F.array_sort(F.array_distinct(F.transform(found, F.lower))), 1, most)
    needed = sorted({certain_word(p) for p in patterns})
    possible = F.exists(F.array(F.lower(c)), lambda t: reduce(lambda a, b: a | b, [F.contains(t, F.lit(w)) for w in needed]))  # an array: lower case is made once
    return F.when(~possible, F.array().cast("array<string>")).otherwise(hits)


def screened(c: Column, patterns: Sequence[str] = SCREEN_PATTERNS) -> Column:
    """Whether a passage has to stay out of a prompt."""
    return c.rlike(f"(?im){alternatives(patterns)}")


def _plain(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def grounded(text: Column, quote: Column, value: Column) -> Column:
    """The quote stands in the text and the value in the quote."""
    return F.contains(_plain(text), _plain(quote)) & F.contains(_plain(quote), _plain(value))


def weighted_score(c: Column, signals: Sequence[tuple[str, float]]) -> Column:
    """Sum of the weights of the patterns that occur, 1 at most."""
    return _weighted([(c.rlike(pattern), weight) for pattern, weight in signals])


def _weighted(signals: Sequence[tuple[Column, float]]) -> Column:
    total = F.lit(0).cast("decimal(6,3)")
    for occurs, weight in signals:
        total = total + F.when(occurs, F.lit(weight).cast("decimal(6,3)")).otherwise(F.lit(0).cast("decimal(6,3)"))
    return F.least(total.cast("decimal(6,3)"), F.lit(1).cast("decimal(6,3)"))


def between_spaces(c: Column, letters: str) -> Column:
    """The words of a text, each between two spaces.  ``letters`` are the characters
    of words, as in a bracket expression.  One pass, after which a word is found
    without an expression of its own."""
    return F.concat(F.lit(" "), F.regexp_replace(c, f"[^{letters}]+", " "), F.lit(" "))


def weighted_words(spaced: Column, signals: Sequence[tuple[str, float]]) -> Column:
    """``weighted_score`` of whole words in a text of words between spaces."""
    return _weighted([(F.contains(spaced, F.lit(f" {word} ")), weight) for word, weight in signals])


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(?U)\w+"), F.lit(0))


def plain_words(c: Column) -> Column:
    """Words of a-z and 0-9 after folding the accents of Latin letters."""
    folded = F.lower(F.translate(c, "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ", "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"))
    return F.regexp_extract_all(F.regexp_replace(folded, "ß", "ss"), F.lit("[a-z0-9]+"), F.lit(0))


def trigrams(word: Column) -> Column:
    """Three-letter strings of a word between the marks ^ and $."""
    marked = F.concat(F.lit("^"), word, F.lit("$"))
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(marked) - 2)), lambda i: F.substring(marked, i, F.lit(3)))


def clip(c: Column, most: int) -> Column:
    return F.substring(c, 1, most)


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./\\]+)$", 1))


def breakable(c: Column) -> Column:
    """HTML-escaped url with break opportunities after / : and ?."""
    safe = F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    return F.regexp_replace(safe, "(?<=[/:?])", "<wbr>")


def redacted(c: Column, keys: Sequence[str] = SECRET_KEYS) -> Column:
    """A map whose secret values are hidden."""
    return F.transform_values(c, lambda k, v: F.when(F.lower(k).isin(*keys), F.lit("[redacted]")).otherwise(v))


def spanish_amount(c: Column) -> Column:
    return F.translate(F.format_number(c, 2), ",.", ".,")


def fixed_point(c: Column) -> Column:
    """Whole numbers bare, others with two decimals."""
    return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(F.bround(c, 2).cast("decimal(18,2)").cast("string"))


def neutralised(c: Column) -> Column:
    """An exported cell that no spreadsheet takes for a formula."""
    return F.when(c.rlike(FORMULA_START), F.concat(F.lit("'"), c)).otherwise(c)


def display_name(c: Column, most: int = 255) -> Column:
    """Last component of a path without control and reserved characters."""
    last = F.regexp_extract(c, r"([^/\\]*)$", 1)
    clean = F.trim(F.regexp_replace(last, r'[\x00-\x1f\x7f<>:"|?*]', ""))
    return clip(F.when(clean == "", F.lit("unnamed")).otherwise(clean), most)


def content_disposition(c: Column) -> Column:
    """Header value with an ASCII name and the exact name in UTF-8."""
    ascii_name = F.regexp_replace(F.translate(c, ACCENTED, PLAIN), r'[^ -~]|["\\]', "_")
    exact = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    return F.concat(F.lit('attachment; filename="'), ascii_name, F.lit("\"; filename*=UTF-8''"), exact)


def label_of(c: Column, labels: Mapping[str, str]) -> Column:
    """Label of a code; codes without one stay."""
    pairs = [F.lit(x) for kv in labels.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c), c)
