"""Tokenizers as column expressions: delimiter sets, two-level records, n-grams.

Delimiters are a set of single ASCII characters; runs of them collapse, so no
token is empty. N-grams stay within one text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Default delimiters of records (lines), of words, and of white space (fixed values).
LINES = "\n\r"
WORDS = " .-_\t\n\r'\"?,;`:!*()"
BLANKS = " \n\r\t"


def char_class(delimiters: str) -> str:
    """A regular expression for runs of the delimiters."""
    if not delimiters:
        raise ValueError("a delimiter set needs at least one character")
    return "[" + "".join(re.escape(c) if c in r"\]^-[&~|" else c for c in delimiters) + "]+"


def tokens(text: Column, delimiters: str = WORDS) -> Column:
    """The tokens of a text; null for a null text."""
    return F.filter(F.split(text, char_class(delimiters)), lambda x: x != "")


def records(text: Column, first: str, second: str) -> Column:
    """Two levels: the first set cuts records, the second cuts each into fields; records without a field are left out."""
    return F.filter(F.transform(tokens(text, first), lambda r: tokens(r, second)), lambda r: F.size(r) > 0)


def ngrams(words: Column, n: int, joiner: str = "-") -> Column:
    """Each n consecutive tokens, joined; none where there are fewer."""
    if n < 1:
        raise ValueError("n must be positive")
    if n == 1:
        return words

    def joined(w: Column) -> Column:
        grams = F.transform(w, lambda x, i: F.concat(x, *[part for k in range(1, n) for part in (F.lit(joiner), F.get(w, i + k))]))
        return F.slice(grams, F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(0)))

    # as the element of an array, the tokens are made once and not once for each place that reads them
    return F.get(F.transform(F.array(words), joined), F.lit(0))
