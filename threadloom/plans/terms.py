"""Search text to terms."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..functions.text import TOKEN, fold_text

#: Words that are no terms, and limits.
STOP_WORDS = frozenset(
    "a an and are as at be but by for from how i if in is it of on or that the then there these this to was what when where which who why will with you your".split()
)
MAX_TERMS = 24
PREFIX_FROM = 4
_RUN = re.compile(TOKEN.replace(r"\p{L}\p{N}", r"^\W_"))


@dataclass(frozen=True)
class QueryTerm:
    """A run of tokens to be found one after another; with ``prefix`` the last may be longer."""

    tokens: tuple[str, ...]
    prefix: bool


def words(query: str) -> list[tuple[str, bool]]:
    """(word or phrase, whether it was quoted) in order; an open quote runs to the end."""
    out: list[tuple[str, bool]] = []
    for k, part in enumerate(query.split('"')):
        quoted = k % 2 == 1
        if quoted:
            if part.strip():
                out.append((part.strip(), True))
            continue
        for word in re.findall(r"(?:[^\W_]|[_\-./\\])+", part):
            if len(word) >= 2 and word.lower() not in STOP_WORDS:
                out.append((word, False))
    return out


def parse(query: str, prefix_match: bool = True, quoted_is_exact: bool = True) -> list[QueryTerm]:
    """Terms of a query; a document needs any of them.

    Words become tokens as documents do, so ``foo_bar`` is a phrase of two.  With ``quoted_is_exact=False`` a quoted
    single word matches longer ones as well.
    """
    out = []
    for word, quoted in words(query)[:MAX_TERMS]:
        long_enough = len(word) >= PREFIX_FROM and " " not in word
        prefix = prefix_match and long_enough and not (quoted and quoted_is_exact)
        out.append(QueryTerm(tuple(_RUN.findall(fold_text(word))), prefix))
    return out
