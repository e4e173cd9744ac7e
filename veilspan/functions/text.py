"""Text scalars as Column functions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import LABELS

#: An ASCII word boundary: Java's \b also counts accented letters as word characters.
BOUNDARY = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


#: White space of every kind, also no-break and typographic spaces, as the inside of a class; Java's \s has ASCII ones only.
SPACES = r"\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"


def spaced(pattern: str) -> str:
    """A pattern whose \\s and \\S mean white space of every kind, inside and outside of classes."""
    out, at, inside = [], 0, False
    while at < len(pattern):
        two = pattern[at : at + 2]
        if two in (r"\s", r"\S"):
            out.append(SPACES if inside else f"[{'^' if two == chr(92) + 'S' else ''}{SPACES}]")
        elif two[0] == "\\":
            out.append(two)
        else:
            inside = two[0] == "[" or (inside and two[0] != "]")
            out.append(two[0])
            at -= 1
        at += 2
    return "".join(out)


_SPACE_RUN, _OUTER_SPACE = spaced(r"\s+"), spaced(r"^\s+|\s+$")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: inside a lambda an expression would be computed for every element."""
    return F.get(F.transform(F.array(value), body), 0)


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Every element joined with all before it (sums, maxima), by doubling strides: n log n steps, and no array grows."""

    def doubled(v: Column) -> Column:
        strides = F.slice(F.array(*[F.lit(1 << k) for k in range(31)]), F.lit(1), F.ceil(F.log2(F.greatest(F.size(v), F.lit(1)).cast("double"))).cast("int"))
        return F.aggregate(strides, v, lambda a, d: F.transform(a, lambda x, i: F.coalesce(join(x, F.get(a, i - d)), x)))

    return let(values, doubled)


def strip(text: Column) -> Column:
    """Without outer white space of any kind."""
    return F.regexp_replace(text, _OUTER_SPACE, "")


def normalize(text: Column) -> Column:
    """Trimmed, lower-cased, white space collapsed."""
    return F.lower(normalize_whitespace(text))


def normalize_whitespace(text: Column) -> Column:
    return F.regexp_replace(strip(text), _SPACE_RUN, " ")


def texts_match(a: Column, b: Column) -> Column:
    return normalize(a) == normalize(b)


@lru_cache(maxsize=1)
def _accents() -> tuple[str, str]:
    """Letters of every script whose canonical decomposition without marks is one letter, with those letters."""
    pairs = [(c, p) for c, p in _decompositions() if len(p) == 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


@lru_cache(maxsize=1)
def _decompositions() -> list[tuple[str, str]]:
    """Characters that canonical decomposition and the removal of U+0300 to U+036F change, Hangul aside."""
    every = [chr(c) for c in range(0x80, 0x30000) if not (0xD800 <= c < 0xE000 or 0xAC00 <= c < 0xD7A4)]
    return [(c, p) for c in every if (p := re.sub("[\u0300-\u036f]", "", unicodedata.normalize("NFD", c))) != c and p]


def _syllable(c: Column) -> Column:
    """The two or three letters that a Hangul syllable is made of: its number among the syllables says which."""
    n = F.ascii(c) - 0xAC00
    letter = lambda code: F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 4, "0")), "UTF-16BE")
    return F.concat(letter(F.floor(n / 588) + 0x1100), letter(F.floor(n % 588 / 28) + 0x1161), F.when(n % 28 > 0, letter(n % 28 + 0x11A7)).otherwise(""))


def remove_diacritics(text: Column) -> Column:
    """The canonical decomposition without combining marks U+0300 to U+036F; ASCII texts take the fast way."""
    marked, plain = _accents()
    several = [(c, p) for c, p in _decompositions() if len(p) > 1]
    # characters that become several ones are rare: only texts that have some are looked at character by character
    parts = F.create_map(*[F.lit(x) for pair in several for x in pair])
    apart = lambda c: F.when(c.rlike("[\uac00-\ud7a3]"), _syllable(c)).otherwise(F.coalesce(F.try_element_at(parts, c), c))
    rare = F.regexp_replace(F.array_join(F.transform(F.split(text, ""), apart), ""), "[\u0300-\u036f]", "")
    is_rare = text.rlike("[\uac00-\ud7a3" + "".join(c for c, _ in several) + "]")
    bare = lambda t: F.regexp_replace(F.translate(t, marked, plain), "[\u0300-\u036f]", "")
    return F.when(~text.rlike(r"[^\x00-\x7F]"), text).when(is_rare, bare(rare)).otherwise(bare(text))


def normalize_fuzzy(text: Column) -> Column:
    """Without diacritics, case, punctuation and repeated white space."""
    return strip(F.regexp_replace(F.regexp_replace(F.lower(remove_diacritics(text)), spaced(r"[^A-Za-z0-9_\s]"), ""), _SPACE_RUN, " "))


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length of the fuzzy forms, from 0 to 1; two empty ones are alike."""
    return normalized_similarity(normalize_fuzzy(a), normalize_fuzzy(b))


def normalized_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / F.greatest(longest, F.lit(1)))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def siren_checksum(text: Column) -> Column:
    """Whether there are nine or fourteen digits of which the first nine pass the Luhn sum that doubles every second digit."""
    def passes(d: Column) -> Column:
        at = lambda i: F.substring(d, i, F.lit(1)).cast("int")
        doubled = lambda i: F.when(i % 2 == 0, F.when(at(i) > 4, 2 * at(i) - 9).otherwise(2 * at(i))).otherwise(at(i))
        total = F.aggregate(F.sequence(F.lit(1), F.lit(9)), F.lit(0), lambda a, i: a + doubled(i))
        return F.when(F.length(d).isin(9, 14), total % 10 == 0).otherwise(F.lit(False))

    return let(digits(text), passes)


def entity_label(label: Column) -> Column:
    """A current label as it is; labels of older files and unknown ones are identifiers."""
    return F.when(label.isin(*LABELS), label).otherwise(F.lit("IDENTIFIER"))


def escape_regex(text: Column) -> Column:
    return F.regexp_replace(text, r"([.*+?^${}()|\[\]\\])", r"\\$1")


# French month names.
MONTHS = ("janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre")
MONTHS_PLAIN = ("fevrier", "aout", "decembre")
_MONTH = "(?:" + "|".join(MONTHS) + ")"
DATE_NUMERIC = r"(?:0?[1-9]|[12][0-9]|3[01])[/-](?:0?[1-9]|1[012])[/-](?:19|20)[0-9]{2}"
DATE_WRITTEN = rf"(?:0?[1-9]|[12][0-9]|3[01])\s+{_MONTH}\s+(?:19|20)[0-9]{{2}}"


def looks_like_date_part(text: Column) -> Column:
    """A month's name or a year."""
    t = F.lower(strip(text))
    return t.isin(*MONTHS, *MONTHS_PLAIN) | t.rlike(r"^(19|20)[0-9]{2}$")


def looks_like_date(text: Column) -> Column:
    t = strip(text)
    return t.rlike(BOUNDARY + DATE_NUMERIC + BOUNDARY) | t.rlike(spaced("(?iu)" + BOUNDARY + DATE_WRITTEN + BOUNDARY))


def ends_with_date(text: Column) -> Column:
    return text.rlike(spaced(rf"(?iu){_MONTH}\s+[0-9]{{4}}[,\s]*$")) | text.rlike(spaced(r"[0-9]{1,2}[/-][0-9]{1,2}[/-](19|20)[0-9]{2}[,\s]*$"))


def matches(text: Column, pattern: str | Column) -> Column:
    """Every match as (start, stop, text) in order.

    One pass of the pattern sets a mark before and after each match; the offsets
    are the running lengths of the pieces between the marks. A text that has a
    mark of its own takes two passes.
    """
    regex = F.lit(pattern) if isinstance(pattern, str) else pattern
    empty = F.array().cast("array<struct<start:int,stop:int,text:string>>")

    def spans(pieces: Column) -> Column:
        """Of gaps and matches in turn."""
        place = lambda e: F.transform(F.sequence(F.lit(1), F.size(pieces) - 2, F.lit(2)), lambda i: F.struct(F.get(e, i - 1).alias("start"), F.get(e, i).alias("stop"), F.get(pieces, i).alias("text")))
        return let(running(F.transform(pieces, F.length), lambda x, y: x + y), place)

    marked = F.regexp_replace(text, regex, F.lit("\x01$0\x02"))
    once = let(marked, lambda m: F.when(F.contains(m, F.lit("\x01")), let(F.split(m, "[\x01\x02]", -1), spans)).otherwise(empty))
    pairs = F.arrays_zip(F.split(text, regex, -1).alias("gap"), F.regexp_extract_all(text, regex, F.lit(0)).alias("hit"))
    listed = F.filter(F.flatten(F.transform(pairs, lambda p: F.array(p["gap"], p["hit"]))), lambda x: x.isNotNull())
    twice = F.when(F.rlike(text, regex), let(listed, spans)).otherwise(empty)
    own = F.contains(text, F.lit("\x01")) | F.contains(text, F.lit("\x02"))
    return F.when(own, twice).when(text.isNotNull(), once).otherwise(empty)


def occurrences(text: Column, needle: Column) -> Column:
    """0-based starts of a needle in a text, letter case aside, overlaps included; none for an empty needle.

    The text is cut before every occurrence, so the starts are the running
    lengths of the pieces; one at the very begin makes no cut.
    """
    low, small = F.lower(text), F.lower(needle)
    pieces = F.split(low, F.concat(F.lit(r"(?=\Q"), F.replace(small, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E)")), -1)
    ends = running(F.transform(pieces, F.length), lambda x, y: x + y)
    cuts = let(ends, lambda e: F.slice(e, 1, F.size(e) - 1))
    starts = F.when(F.startswith(low, small), F.concat(F.array(F.lit(0)), cuts)).otherwise(cuts)
    return F.when((F.length(small) > 0) & F.contains(low, small), starts).otherwise(F.array().cast("array<int>"))


def format_bytes(n: Column) -> Column:
    """B, KB without decimals, MB with one."""
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024 * 1024, F.concat(F.round(n / 1024, 0).cast("long").cast("string"), F.lit(" KB"))).otherwise(F.concat(F.format_string("%.1f", n / (1024 * 1024)), F.lit(" MB")))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def rounded(value: Column) -> Column:
    """Half up, also below zero."""
    return F.floor(value + 0.5)


def shortened(text: Column) -> Column:
    """Over 32 characters: the first 22, an ellipsis, the last 10."""
    return F.when(F.length(text) > 32, F.concat(F.substring(text, 1, 22), F.lit("…"), F.right(text, F.lit(10)))).otherwise(text)


def sanitized(text: Column) -> Column:
    """Control characters dropped, characters beyond Latin-1 as question marks."""
    return F.regexp_replace(F.regexp_replace(text, r"[\x00-\x1F\x7F]", ""), r"[^\x20-\x7E -ÿ]", "?")


def confidence_band(score: Column) -> Column:
    return F.when(score >= 0.8, "high").when(score >= 0.5, "medium").otherwise("low")


def stable_id(*parts: Column | str) -> Column:
    """An id that the same input gives again."""
    return F.concat_ws("-", *parts)
