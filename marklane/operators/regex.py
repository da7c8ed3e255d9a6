"""Python's regular expressions as Java's, where both agree.

A pattern is parsed by Python and written out for Java piece by piece: classes of digits, words and white space as the code points that
Python has in them, line ends and the dot as Python means them, all groups by number. What the two engines do
differently is not translated, and such patterns run in Python workers.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable
from functools import lru_cache
from re import _constants as K
from re import _parser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class _Differs(Exception):
    """A piece on which the engines may differ."""


@lru_cache
def _ranges(kind: str) -> str:
    """The inside of a Java class of Python's digits (d), word characters (w), white space (s) or characters that are shown escaped (p)."""
    inside = {"d": str.isdecimal, "s": str.isspace, "w": lambda c: c.isalnum() or c == "_", "p": lambda c: not c.isprintable() and not 0xD800 <= ord(c) < 0xE000}[kind]
    out, first = [], None
    for i in range(sys.maxunicode + 2):
        hit = i <= sys.maxunicode and inside(chr(i))
        if hit and first is None:
            first = i
        elif not hit and first is not None:
            out.append(_char(first) if first == i - 1 else f"{_char(first)}-{_char(i - 1)}")
            first = None
    return "".join(out)


def _char(code: int) -> str:
    return f"\\x{{{code:X}}}"


_CLASSES = {K.CATEGORY_DIGIT: "d", K.CATEGORY_SPACE: "s", K.CATEGORY_WORD: "w", K.CATEGORY_NOT_DIGIT: "^d", K.CATEGORY_NOT_SPACE: "^s", K.CATEGORY_NOT_WORD: "^w"}


def _category(of) -> str:
    kind = _CLASSES[of]
    return f"[^{_ranges(kind[1])}]" if kind[0] == "^" else f"[{_ranges(kind)}]"


def _in(items) -> str:
    out, negated = [], False
    for op, arg in items:
        if op is K.NEGATE:
            negated = True
        elif op is K.LITERAL:
            out.append(_char(arg))
        elif op is K.RANGE:
            out.append(f"{_char(arg[0])}-{_char(arg[1])}")
        elif op is K.CATEGORY:
            out.append(_category(arg))
        else:
            raise _Differs(op)
    return f"[{'^' if negated else ''}{''.join(out)}]" if not negated else f"(?![{''.join(out)}])(?s:.)"


def _at(where, flags: int) -> str:
    many = flags & re.MULTILINE
    word = f"[{_ranges('w')}]"
    edge = f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))"
    known = {
        K.AT_BEGINNING: "(?:\\A|(?<=\\n))" if many else "\\A", K.AT_BEGINNING_STRING: "\\A", K.AT_END: "(?=\\n|\\z)" if many else "(?=\\n?\\z)", K.AT_END_STRING: "\\z",
        K.AT_BOUNDARY: edge, K.AT_NON_BOUNDARY: f"(?!{edge})",
    }
    if where not in known:
        raise _Differs(where)
    return known[where]


def _written(parsed, flags: int) -> str:
    out = []
    for op, arg in parsed:
        if op is K.LITERAL:
            out.append(_char(arg))
        elif op is K.NOT_LITERAL:
            out.append(f"[^{_char(arg)}]")
        elif op is K.ANY:
            out.append("(?s:.)" if flags & re.DOTALL else "[^\\n]")
        elif op is K.IN:
            out.append(f"(?:{_in(arg)})")
        elif op is K.AT:
            out.append(_at(arg, flags))
        elif op is K.BRANCH:
            out.append("(?:" + "|".join(_written(p, flags) for p in arg[1]) + ")")
        elif op is K.SUBPATTERN:
            group, add, drop, inner = arg
            if add or drop:
                raise _Differs("flags inside")
            out.append(f"({'?:' if group is None else f'?<g{group}>'}{_written(inner, flags)})")
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT):
            least, most, inner = arg
            if inner.getwidth()[0] == 0:
                raise _Differs("repeats of what may be empty")
            times = f"{{{least},{'' if most is K.MAXREPEAT else most}}}"
            out.append(f"(?:{_written(inner, flags)}){times}{'?' if op is K.MIN_REPEAT else '+' if op is K.POSSESSIVE_REPEAT else ''}")
        elif op is K.ATOMIC_GROUP:
            out.append(f"(?>{_written(arg, flags)})")
        elif op in (K.ASSERT, K.ASSERT_NOT):
            direction, inner = arg
            out.append(f"(?{'<' if direction < 0 else ''}{'=' if op is K.ASSERT else '!'}{_written(inner, flags)})")
        elif op is K.GROUPREF:
            out.append(f"(?:\\k<g{arg}>)")
        else:
            raise _Differs(op)
    return "".join(out)


def java_pattern(pattern: str) -> str | None:
    """The pattern for Java, null where the engines may differ: case folding, ASCII and locale flags, flags inside of groups, repeats of what may be empty, conditions."""
    parsed = _parser.parse(pattern)
    flags = parsed.state.flags
    if flags & ~(re.UNICODE | re.VERBOSE | re.MULTILINE | re.DOTALL):
        return None
    try:
        return _written(parsed, flags)
    except _Differs:
        return None


def java_replacement(pattern: str, replacement: str) -> str | None:
    """The replacement for ``java_pattern``; null where that is, or where the pattern may match the empty text."""
    if java_pattern(pattern) is None or _parser.parse(pattern).getwidth()[0] == 0:
        return None
    parts = _parser.parse_template(replacement, re.compile(pattern))
    return "".join(f"${{g{p}}}" if isinstance(p, int) else re.sub(r"([\\$])", r"\\\1", p) for p in parts)


def found(pattern: str) -> Callable[[Column], Column]:
    """Whether Python's ``re.search`` finds the pattern in a text."""
    compiled = re.compile(pattern)
    if (java := java_pattern(pattern)) is not None:
        return lambda c: c.rlike(java)

    @F.pandas_udf("boolean")
    def fn(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: compiled.search(t) is not None).astype(bool)

    return fn


def substituted(pattern: str, replacement: str) -> Callable[[Column], Column]:
    """Python's ``re.sub`` of a text."""
    compiled = re.compile(pattern)
    if (java := java_replacement(pattern, replacement)) is not None:
        return lambda c: F.regexp_replace(c, F.lit(f"(?<g0>{java_pattern(pattern)})"), F.lit(java))

    @F.pandas_udf("string")
    def fn(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: compiled.sub(replacement, t))

    return fn


def literal(text: Column) -> Column:
    """A text as in a Python string literal, without its quotes: backslashes, line ends, tabs and what cannot be printed are escaped, single quotes only beside double ones.

    Texts without any of these, nearly all, pass by one test.
    """
    hidden = f"[{_ranges('p')}]"
    plain = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    plain = F.when(F.contains(text, F.lit("'")) & F.contains(text, F.lit('"')), F.replace(plain, F.lit("'"), F.lit("\\'"))).otherwise(plain)

    def shown(c: Column) -> Column:
        code = F.ascii(c)
        digits = lambda n: F.lower(F.lpad(F.hex(code), n, F.lit("0")))
        escaped = F.when(code < 256, F.concat(F.lit("\\x"), digits(2))).when(code < 65536, F.concat(F.lit("\\u"), digits(4))).otherwise(F.concat(F.lit("\\U"), digits(8)))
        named = F.when(c == "\n", F.lit("\\n")).when(c == "\r", F.lit("\\r")).when(c == "\t", F.lit("\\t")).otherwise(escaped)
        return F.when(c.rlike(hidden), named).otherwise(c)

    each = F.array_join(F.transform(F.split(plain, ""), shown), "")
    return F.when(text.rlike(hidden), each).when(text.rlike("[\\\\']"), plain).otherwise(text)
