"""Text expressions: every one takes and gives a Column and stays in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

ELLIPSIS = "…"
UNTITLED = "(untitled session)"
TOKEN = r"[\p{L}\p{N}]+"


def _accents() -> tuple[str, str]:
    """Accented Latin letters and their bases, by canonical decomposition."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x250)]
    pairs = [(a, b) for a, b in pairs if a != b and a == a.lower() and b.isascii()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_ACCENTED, _BASE = _accents()


def once(c: Column, f) -> Column:
    """``f(c)``, with ``c`` computed once however often ``f`` names it, also where Spark moves a filter below ``c``."""
    return F.transform(F.array(c), f)[0]


def fold(c: Column) -> Column:
    """Lower case without accents; texts without any are not searched for them."""
    return once(F.lower(c), lambda low: F.when(F.octet_length(low) == F.length(low), low).otherwise(F.translate(low, _ACCENTED, _BASE)))


def fold_text(s: str) -> str:
    """``fold`` for a string on the driver."""
    return s.lower().translate(str.maketrans(_ACCENTED, _BASE))


def tokens(c: Column) -> Column:
    """Runs of letters and digits, folded."""
    return F.regexp_extract_all(fold(c), F.lit(TOKEN), F.lit(0))


def words(c: Column) -> Column:
    """The tokens as text, a blank before and one after each: " a  b ".  A search of it is a search for substrings."""
    bare = F.trim(F.regexp_replace(fold(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", "  "))
    return once(bare, lambda b: F.when(b == "", b).otherwise(F.concat(F.lit(" "), b, F.lit(" "))))


def word_count(w: Column) -> Column:
    """How many tokens ``words`` made."""
    return once(w, lambda x: F.when(x == "", 0).otherwise((F.length(x) - F.length(F.replace(x, F.lit("  "), F.lit("")))) / 2 + 1).cast("int"))


def word_list(w: Column) -> Column:
    return F.when(w == "", F.array().cast("array<string>")).otherwise(F.split(F.trim(w), "  "))


def flatten(c: Column) -> Column:
    """White space as single spaces, none at the ends; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def truncate(c: Column, n: int, suffix: str = ELLIPSIS) -> Column:
    """At most ``n`` characters, cut at a space among the last fifth if there is one."""
    if n <= 0:
        return c
    window = max(1, n // 5)
    back = F.instr(F.reverse(F.substring(c, n - window + 1, window)), " ")
    cut = F.when((back > 0) & (back < n), n - back).otherwise(n)
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.regexp_replace(F.substring(c, F.lit(1), cut), r"(?U)\s+$", ""), F.lit(suffix)))


def begun(c: Column, n: int) -> Column:
    """The start of ``flatten(c)``: more than ``n`` of its characters, or all it has.  Of a long text only the start is searched, unless that is mostly blank."""
    return once(flatten(F.substring(c, 1, 2 * n)), lambda start: F.when(F.length(start) > n, start).otherwise(flatten(c)))


def preview(c: Column, n: int) -> Column:
    return once(begun(c, n), lambda start: truncate(start, n)) if n > 0 else flatten(c)


def derive_title(c: Column, n: int = 80) -> Column:
    """The first sentence if it ends among the first ``n`` characters but not too early, else a preview."""

    def of(flat: Column) -> Column:
        stop = F.regexp_instr(F.substring(flat, 1, n), F.lit(r"[.?!]"))
        return F.when(F.length(flat) == 0, F.lit(UNTITLED)).when(stop > 13, F.substring(flat, F.lit(1), stop)).otherwise(truncate(flat, n))

    return once(begun(c, n), of)


def output_cap(c: Column, n: int) -> Column:
    """A tool's output cut to ``n`` characters, and how many more there were."""
    more = F.format_number(F.length(c) - n, 0)
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.substring(c, 1, n), F.lit("\n… ["), more, F.lit(" more characters]")))


def tag_name(c: Column) -> Column:
    """A tag as stored: trimmed, lower case, blanks as hyphens."""
    return F.regexp_replace(F.lower(F.trim(c)), r"\s+", "-")


def role_name(c: Column) -> Column:
    """One of the known roles; anything else speaks as the assistant."""
    r = F.lower(c)
    return F.when(r.isin("user", "assistant", "system", "tool", "info"), F.initcap(r)).otherwise(F.lit("Assistant"))


def highlight(c: Column, terms: list[str], open_: str = "<<", close: str = ">>") -> Column:
    """Marks terms, the longest first, whatever their case."""
    kept = highlight_terms(terms)
    if not kept:
        return c
    import re

    pattern = "(?iu)(" + "|".join(re.escape(t) for t in sorted(kept, key=lambda t: (-len(t), t))) + ")"
    return F.regexp_replace(c, pattern, f"{open_}$1{close}")


def highlight_terms(terms: list[str]) -> list[str]:
    out: dict[str, str] = {}
    for t in terms:
        t = t.strip("\"'*(),`")
        if len(t) >= 2:
            out.setdefault(t.lower(), t)
    return list(out.values())


def contains_ci(c: Column, value: str) -> Column:
    """Whether a text holds a value literally, whatever the case; null holds nothing."""
    return F.coalesce(F.lower(c).contains(value.lower()), F.lit(False))


def same_ci(c: Column, value: str) -> Column:
    return F.lower(c) == value.lower()
