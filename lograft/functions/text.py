"""String helpers with JavaScript semantics, as plain Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# --- Fixed values: white space and line ends as JavaScript defines them ------
JS_WHITESPACE = (
    "\t\n\x0b\x0c\r \u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
# The same set, and the line ends, for use inside a Java character class.
WS = r"\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
LINE_END = r"\n\r\u2028\u2029"

# Zero-width test for "at the start of a line"; unlike Java's (?m)^ it ignores U+0085.
LINE_START = rf"(?<![^{LINE_END}])"


def js_trim(text: Column) -> Column:
    """Strip all white space, not only blanks; no regex involved."""
    return F.btrim(text, F.lit(JS_WHITESPACE))


def first_non_empty(*texts: Column) -> Column:
    """``a || b || c`` for strings: the first that is neither NULL nor ''."""
    return F.coalesce(*(F.nullif(t, F.lit("")) for t in texts))


def has(text: Column, needle: str) -> Column:
    """Contains, with false instead of NULL for a missing text."""
    return F.coalesce(text.contains(needle), F.lit(False))


def has_any_case(text: Column, *needles: str) -> Column:
    """Case-blind contains of any needle (given in lower case)."""
    lowered = F.lower(text)
    return reduce(lambda a, b: a | b, (has(lowered, n) for n in needles))


def is_true(flag: Column) -> Column:
    """Tri-state to two-state: NULL counts as false."""
    return F.coalesce(flag, F.lit(False))


def int_div(a: Column, b: Column | int) -> Column:
    """Exact BIGINT division."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def drop_first(text: Column, literal: Column) -> Column:
    """Remove the first literal occurrence, if any."""
    at = F.instr(text, literal)
    return F.when(at == 0, text).otherwise(
        F.concat(
            F.substring(text, F.lit(1), at - 1),
            F.substring(text, at + F.length(literal), F.length(text)),
        )
    )
