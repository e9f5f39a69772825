"""Bank descriptions and merchant keys as Column expressions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark.functions.tables import (
    BRAND_ALIASES, CATEGORY_WORDS, KNOWN_BRANDS, NOISE_TOKENS, PAYMENT_WORDS, PROCESSOR_PREFIXES, STAR_AGGREGATORS,
)

#: Word edges and space that treat letters outside ASCII as no word characters, as Java's \w does. Beside a word
#: character one half of an edge will do: START before it, END behind it.
EDGE = r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))"
START, END = r"(?<!\w)", r"(?!\w)"
SPACE = r"[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"


def _bare(letter: str) -> str:
    """A letter decomposed, without the marks from U+0300 to U+036F."""
    return "".join(c for c in unicodedata.normalize("NFD", letter) if not "\u0300" <= c <= "\u036f")


#: Every letter or sign that decomposes into one of ASCII and marks, with what is left of it. None lies beyond U+2300.
MARKED = {c: _bare(c) for c in map(chr, range(0x80, 0x2300)) if len(_bare(c)) == 1 and _bare(c).isascii()}


def strip_marks(text: Column) -> Column:
    """Letters without their marks; combining marks go too."""
    return F.regexp_replace(F.translate(text, "".join(MARKED), "".join(MARKED.values())), r"[̀-ͯ]", "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often the body reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _word(pattern: str) -> str:
    """A pattern that begins and ends with word characters, as a word."""
    return f"{START}{pattern}{END}"


def normalize_description(raw: Column) -> Column:
    """The description without processor wording, references, dates and card tails; empty for null."""
    s = F.lower(strip_marks(F.coalesce(raw, F.lit(""))))
    star = rf"^(?:{'|'.join(STAR_AGGREGATORS)}){SPACE}*\*+{SPACE}*([^\n\r  ]+)\z"
    s = let(s, lambda x: F.when(x.rlike(star), F.regexp_extract(x, star, 1)).otherwise(x))
    # fixed values, in a fixed order
    steps = [
        r"\*+", _word(r"x{2,}[0-9]{2,}"), _word(r"[0-9]{1,2}[/.\-][0-9]{1,2}([/.\-][0-9]{2,4})?"), _word(r"[0-9]{1,2}:[0-9]{2}(:[0-9]{2})?"), rf"#{SPACE}*[0-9]+",
        START + r"(ref|reference|auth|authcode|trn|trace|id|inv|invoice|order|ord|txn|tx)[:. ]*[a-z0-9\-]{3,}" + EDGE,
        r"(?=[a-z0-9])" + START + r"(?=[a-z0-9]{4,}(?!\w))[a-z0-9]*[0-9][a-z0-9]*" + END,
        START + rf"[a-z]{{3}}{SPACE}?[0-9.,]+" + EDGE, r"[^a-z0-9]+",
    ]
    for pattern in steps:
        s = F.regexp_replace(s, pattern, " ")
    s = F.trim(s)
    s = F.regexp_replace(s, rf"^(?:(?:{'|'.join(PROCESSOR_PREFIXES)}) )+", "")
    return let(s, lambda x: F.when(x.isin(*PROCESSOR_PREFIXES), "").otherwise(x))


def _strings(values) -> Column:
    return F.array(*(F.lit(v) for v in values))


def normalize_merchant(raw: Column) -> Column:
    """The merchant's comparison key: aliases expanded, a known brand alone, else the words that tell merchants apart."""
    return merchant_key(normalize_description(raw))


def merchant_key(base: Column) -> Column:
    """`normalize_merchant` of a normalized description."""
    return let(base, _merchant_key)


def _merchant_key(base: Column) -> Column:
    aliases = F.create_map(*(F.lit(x) for pair in BRAND_ALIASES.items() for x in pair))
    long_names = [(a, real) for a, real in BRAND_ALIASES.items() if " " in a]
    starts = F.coalesce(*(F.when(base.startswith(a + " "), real) for a, real in long_names))
    words = F.flatten(F.transform(F.split(base, " "), lambda t: F.split(F.coalesce(F.try_element_at(aliases, t), t), " ")))
    padded = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    # which brand is asked only where there is one
    first = lambda p: F.trim(F.try_element_at(F.filter(_strings(f" {b} " for b in KNOWN_BRANDS), lambda b: F.contains(p, b)), F.lit(1)))
    brand = let(padded, lambda p: F.when(p.rlike(f" (?:{'|'.join(KNOWN_BRANDS)}) "), first(p)))
    rest = F.array_join(F.filter(words, lambda t: (F.length(t) > 1) & ~t.isin(*NOISE_TOKENS)), " ")
    return F.when(base == "", "").otherwise(F.coalesce(F.try_element_at(aliases, base), starts, brand, F.nullif(rest, F.lit("")), base))


def extract_reference(raw: Column) -> Column:
    """A payment reference in upper case, or null."""
    found = F.regexp_extract(raw, rf"(?i){EDGE}(?:ref|reference|inv|invoice|order|ord)[:.# ]*([a-z0-9][a-z0-9\-]{{2,}}){EDGE}", 1)
    return F.upper(F.nullif(found, F.lit("")))


def _first_word(text: Column, rules) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(rules):
        out = F.when(text.rlike(_word(f"(?:{pattern})")), name).otherwise(out)
    return out


def payment_method(raw: Column) -> Column:
    """card, cash, transfer or direct_debit where the wording tells it, else null."""
    return _first_word(F.lower(raw), PAYMENT_WORDS)


def suggest_category(merchant: Column, description: Column | None = None) -> Column:
    """A category by keyword, or null."""
    text = F.lower(F.concat_ws(" ", F.coalesce(merchant, F.lit("")), F.coalesce(description if description is not None else F.lit(None).cast("string"), F.lit(""))))
    return F.when(F.trim(text) != "", _first_word(text, CATEGORY_WORDS))


def like_term(column: Column, term: str) -> Column:
    """Substring search without case; % and _ in the term are wildcards, a backslash is itself."""
    return F.lower(column).like("%" + re.sub(r"\\", r"\\\\", term.lower()) + "%")


def safe_filename(name: Column) -> Column:
    """The last path part with odd characters replaced, at most 120 characters; `receipt` if nothing is left."""
    base = F.regexp_extract(F.regexp_replace(name, r"/+\z", ""), r"([^/]*)\z", 1)
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(base, r"[^A-Za-z0-9_.\- ]+", "_"), 1, 120), F.lit("")), F.lit("receipt"))
