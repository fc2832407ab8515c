"""What text a pattern needs: strings of which any match holds at least one. They make an index of texts useful for patterns.

``needed_literals`` reads a pattern as Python's own parser of patterns lays it out. It is cautious: what it doesn't know
breaks a literal off, and a pattern without one of ``LEAST`` characters needs nothing, as far as it says.
"""

from __future__ import annotations

import functools
import re
import warnings

with warnings.catch_warnings():
    warnings.simplefilter("ignore", DeprecationWarning)
    from re import _constants as C
    from re import _parser as parser

from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST = 3
#: What Python knows in patterns and Java doesn't.
FOREIGN = re.compile(r"\(\?(?:P|#|\()|\\Z|\\N\{")


def portable(pattern: str | None) -> bool:
    """Whether the pattern can be compiled, here and in the JVM."""
    try:
        return bool(pattern) and re.compile(pattern) is not None and not FOREIGN.search(pattern)
    except (re.error, OverflowError, RecursionError):
        return False


def needed_literals(pattern: str) -> list[str]:
    """Literals of which every match has one at least; none if there may be a match without any. Ignore case when comparing."""
    return sorted(best(parser.parse(pattern)) or ())


def best(parts) -> frozenset[str] | None:
    """Of the sets of literals that a sequence needs, the one whose shortest is longest."""
    found: list[frozenset[str]] = []
    run = ""
    for op, value in [*parts, (None, None)]:
        if op is C.LITERAL:
            run += chr(value)
            continue
        if len(run) >= LEAST:
            found.append(frozenset([run]))
        run = ""
        inner = None
        if op is C.SUBPATTERN:
            inner = best(value[-1])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and value[0] >= 1:
            inner = best(value[2])
        elif op is C.ATOMIC_GROUP:
            inner = best(value)
        elif op is C.BRANCH:
            each = [best(b) for b in value[1]]
            inner = frozenset().union(*each) if each and all(each) else None
        if inner:
            found.append(inner)
    return max(found, key=lambda s: (min(map(len, s)), sorted(s)), default=None)


@functools.cache
def small_forms() -> tuple[str, str]:
    """Small letters that share their capital with another one, and that one; a combining dot that a capital I leaves goes."""
    forms = {c: c.upper().lower() for c in map(chr, range(0x80, 0x20000)) if len(c.upper()) == 1 and len(c.upper().lower()) == 1 and c.upper().lower() != c == c.lower()}
    return "".join(forms) + "\u0307", "".join(forms.values())


def folded(text: Column) -> Column:
    """Texts that agree but for case, as the JVM's patterns see it, are equal."""
    return F.translate(F.lower(text), *small_forms())


def trigrams(text: Column) -> Column:
    """The distinct runs of three characters."""
    last = F.char_length(text) - 2
    return F.when(last > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substr(text, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))
