"""Words as plain letters: compatibility decomposition without its marks, in JVM expressions.

The tables come from Python's Unicode data by rule: every code point whose decomposition (NFKD), without combining marks, has one
of a-z or 0-9 in it. Those that become one character go through translate(), which also deletes the marks; the few that become
several (ligatures, fractions, units) are spelt out, only in texts that have one.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: the marks that are dropped
MARKS = "".join(map(chr, range(0x300, 0x370)))


@cache
def tables() -> tuple[str, str, dict[str, str]]:
    """Letters, what each of them becomes (none: it is deleted), and those that become several characters."""
    single, several = {}, {}
    for code in range(0x80, 0x20000):
        c = chr(code)
        plain = unicodedata.normalize("NFKD", c)
        if plain != c and any(x.isascii() and (x.islower() or x.isdigit()) for x in plain):
            plain = "".join(x for x in plain if x not in MARKS)
            (single if len(plain) == 1 else several)[c] = plain
    return "".join(single) + MARKS, "".join(single.values()), several


def folded(text: Column) -> Column:
    """Lower case, accents and compatibility forms of a-z and 0-9 as these; other letters stay as they are."""
    letters, bases, several = tables()
    low = F.lower(text)
    spelt = F.create_map(*(F.lit(x) for pair in several.items() for x in pair))
    each = F.transform(F.split(low, ""), lambda c: F.coalesce(spelt[c], c))
    # a look-up a character; a pattern with hundreds of characters tries them one after another
    has_some = F.translate(low, "".join(several), "") != low
    plain = F.translate(F.when(has_some, F.array_join(each, "")).otherwise(low), letters, bases)
    return F.when(F.octet_length(text) == F.length(text), low).otherwise(plain)


def words(text: Column) -> Column:
    """Runs of plain letters and digits longer than one, in order; none of null."""
    return F.filter(F.split(F.regexp_replace(folded(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "), " "), lambda w: F.length(w) > 1)


def sql_folded(text: str) -> str:
    """folded() as a DuckDB expression, for texts without letters that become several characters."""
    letters, bases, _ = tables()
    return f"translate(lower({text}), '{letters}', '{bases}')"


def sql_words(text: str) -> str:
    return f"list_filter(string_split(regexp_replace({sql_folded(f"coalesce({text}, '')")}, '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: length(w) > 1)"
