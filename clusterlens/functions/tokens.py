"""Quote-aware splitting of accounting-log lines into fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import as_col

# A field is a maximal run of non-space characters and "quoted" sections
# (which may hold spaces). Possessive quantifiers keep the match linear.
TOKEN_PATTERN = r'((?:[^ "]++|"[^"]*+")++)'

# Characters Python's str.strip() removes at the ends of a line.
_WS = r"[\s\x1c-\x1f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


# The same characters as a list.
_WS_CHARS = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200b))) + "\u2028\u2029\u202f\u205f\u3000"


def strip_ws(c) -> Column:
    """Without white space at the ends. The regular expression, which tries every character of
    a line, is left to text that is no valid UTF-8, as trimming by characters may cut into that."""
    c = as_col(c)
    return (F.when(F.is_valid_utf8(c), F.btrim(c, F.lit(_WS_CHARS)))
            .otherwise(F.regexp_replace(c, f"^{_WS}+|{_WS}+$", "")))


def strip_left(c) -> Column:
    return F.regexp_replace(as_col(c), f"^{_WS}+", "")


def quote_count(c) -> Column:
    c = as_col(c)
    return F.length(c) - F.length(F.replace(c, F.lit('"'), F.lit("")))


def quoted_tokens(c) -> Column:
    """Split on spaces that lie outside double-quoted sections.

    A space splits when the rest of the line holds an even number of
    quotes. For an odd total a quote is put in front (making the parity
    rule the plain "outside quotes" rule) and taken off the first field
    again. Empty fields (two spaces in a row) are not returned; test them
    with :func:`has_empty_segment`.
    """
    c = as_col(c)
    odd = (quote_count(c) % 2) == 1
    src = F.when(odd, F.concat(F.lit('"'), c)).otherwise(c)
    toks = F.regexp_extract_all(src, F.lit(TOKEN_PATTERN), 1)
    fixed = F.when(odd & (F.size(toks) > 0),
                   F.concat(F.array(F.substring(F.get(toks, 0), F.lit(2), F.length(F.get(toks, 0)))),
                            F.slice(toks, F.lit(2), F.size(toks))))
    return fixed.otherwise(toks)


def has_empty_segment(line, tokens) -> Column:
    """True when splitting ``line`` on spaces outside quotes would yield an
    empty field: the fields joined by single spaces no longer rebuild it. That is
    compared only where a space lies beside another one or at an end, and for invalid UTF-8."""
    line, tokens = as_col(line), as_col(tokens)
    doubtful = F.contains(line, F.lit("  ")) | line.startswith(" ") | line.endswith(" ") | ~F.is_valid_utf8(line)
    return (F.size(tokens) == 0) | (doubtful & (F.length(line) != F.length(F.array_join(tokens, " "))))


def unquote(t) -> Column:
    """A field that starts with a quote loses all its leading and trailing
    quotes; inner (doubled) quotes stay. Other fields are unchanged."""
    t = as_col(t)
    return F.when(t.startswith('"'), F.btrim(t, F.lit('"'))).otherwise(t)


def strip_quotes(tokens) -> Column:
    """:func:`unquote` applied to every field of an array."""
    return F.transform(as_col(tokens), unquote)
