"""Text functions: whitespace, paragraphs, names, tokens and diacritic folding."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from brightloom.functions.shaping import let

# The characters counted as white space, for a regular-expression class.
WHITESPACE = "\\t\\n\\x0B\\f\\r \\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}"


# The same characters one by one.
WHITESPACE_CHARS = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def trim_all(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE_CHARS))


def trim_end(text: Column) -> Column:
    return F.rtrim(text, F.lit(WHITESPACE_CHARS))


def collapse_whitespace(text: Column) -> Column:
    """Tidy text but keep its lines: single blanks, clean line ends, at most one empty line.

    The patterns match only what has to change, so ordinary prose is read and not rebuilt.
    """
    blanks = F.regexp_replace(text, "\\t[ \\t]*| [ \\t]+", " ")
    line_ends = F.regexp_replace(blanks, f"[{WHITESPACE.replace(chr(92) + 'n', '')}]+\\n", "\n")
    return trim_all(F.regexp_replace(line_ends, "\\n{3,}", "\n\n"))


def first_paragraph(text: Column, max_chars: int) -> Column:
    """First paragraph that is not blank, cut to `max_chars`; empty text if there is none."""
    first = trim_all(F.get(F.split(trim_all(text), f"\\n[{WHITESPACE}]*\\n", 2), F.lit(0)))
    return F.when(F.length(first) > max_chars, trim_end(F.substring(first, 1, max_chars))).otherwise(first)


def normalize_name(text: Column) -> Column:
    """Matching form of a name: lower case, no leading article, ASCII letters and digits only."""
    bare = F.regexp_replace(F.lower(text), f"^(the|a|an)[{WHITESPACE}]+", "")
    return F.trim(F.regexp_replace(bare, "[^a-z0-9]+", " "))


def strip_suffix(text: Column, suffix_pattern: Column) -> Column:
    """Title without its site suffix, trimmed; without a pattern only trimmed."""
    return trim_all(F.coalesce(F.regexp_replace(text, suffix_pattern, F.lit("")), text))


def _folding_table() -> tuple[str, str]:
    """Precomposed Latin letters and the base letter each decomposes to."""
    accented, plain = [], []
    for code in [*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)]:
        base = [c for c in unicodedata.normalize("NFD", chr(code)) if not unicodedata.combining(c)]
        if len(base) == 1 and base[0] != chr(code):
            accented.append(chr(code))
            plain.append(base[0])
    return "".join(accented), "".join(plain)


FOLD_FROM, FOLD_TO = _folding_table()


def fold(text: Column) -> Column:
    """Lower case without diacritics."""
    return F.regexp_replace(F.translate(F.lower(text), FOLD_FROM, FOLD_TO), "\\p{Mn}", "")


def index_tokens(text: Column) -> Column:
    """Words of the text index: runs of letters and digits of the folded text."""
    return F.regexp_extract_all(fold(text), F.lit("([\\p{L}\\p{N}]+)"), F.lit(1))


def spaced_words(text: Column) -> Column:
    """The folded text with the words of `index_tokens` parted by blanks, unless it is plain ASCII, where it stays as it is."""

    def parted(lower: Column) -> Column:
        return F.when(F.octet_length(lower) == F.length(lower), lower).otherwise(F.regexp_replace(fold(lower), "[^\\p{L}\\p{N}]+", " "))

    return let(F.lower(text), parted)


def query_tokens(text: Column, strict_ascii: bool = False) -> Column:
    """Terms of a search query, folded like the index.

    `strict_ascii` keeps ASCII runs of the lower-cased text only, which breaks words at
    accented letters.
    """
    if strict_ascii:
        return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))
    return index_tokens(text)
