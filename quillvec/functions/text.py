"""Text columns: stripping, sentence and paragraph splitting, word wrap.

Everything is built from Spark SQL functions, so it stays inside the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The splitting rule and its thresholds.
# White space is what Unicode calls so, plus the four ASCII separators U+001C-001F.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
SPACE = f"[{WHITESPACE}]"
# U+10400 is a letter already; naming it makes Java look behind by code points, not
# by UTF-16 units, so letters outside the basic plane count as one as well.
WORD = "[\\p{L}\\p{N}_\U00010400]"
# A sentence ends at white space after . ? or !, but not after "e.g." or "Mr."
# The cheap test for the mark comes first; the others only run where it holds.
SENTENCE_BOUNDARY = (
    rf"(?<=[.?!]){SPACE}(?<!{WORD}\.{WORD}[.?!]{SPACE})(?<![A-Z][a-z]\.{SPACE})"
)
PARAGRAPH_BREAK = "\n\n"
LONG_PARAGRAPH = 20  # blocks must be longer than this to be cut into sentences
MIN_SENTENCE = 10
MIN_PARAGRAPH = 20
SENTENCES_PER_PARAGRAPH = 3
MAX_PARAGRAPH = 1024


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    """Remove Unicode white space from both ends (plain ``trim`` only knows U+0020)."""
    return F.btrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    return F.length(strip(text)) == 0


def _pieces(text: Column, pattern: str) -> Column:
    return F.transform(F.split(text, pattern, -1), strip)


def sentences(text: Column, min_len: int = MIN_SENTENCE) -> Column:
    """Array of sentences of at least ``min_len`` characters, in text order."""
    blocks = F.filter(_pieces(text, PARAGRAPH_BREAK), lambda b: F.length(b) > LONG_PARAGRAPH)
    cut = F.flatten(F.transform(blocks, lambda b: _pieces(b, SENTENCE_BOUNDARY)))
    return F.filter(cut, lambda s: F.length(s) >= min_len)


def wrap(text: Column, max_chars: int = MAX_PARAGRAPH) -> Column:
    """Array of pieces of at most ``max_chars``, broken at the last space that fits.

    A text already short enough comes back as it is, even when empty.
    """
    line = (
        rf"(?s)(.{{1,{max_chars}}}\z"
        + (rf"|.{{1,{max_chars - 1}}}(?= )" if max_chars > 1 else "")
        + rf"|.{{{max_chars}}}){SPACE}*"
    )
    return F.when(F.length(text) <= max_chars, F.array(text)).otherwise(
        F.regexp_extract_all(text, F.lit(line), F.lit(1))
    )


def _joined_group(group: Column, max_chars: int) -> Column:
    """One string for the group, or two halves when it is too long."""

    def fit(whole: Column) -> Column:
        half = F.floor(F.size(group) / 2).cast("int")
        halves = F.array(
            F.concat_ws(" ", F.slice(group, F.lit(1), half)),
            F.concat_ws(" ", F.slice(group, half + 1, F.size(group))),
        )
        too_long = (F.length(whole) > max_chars) & (F.size(group) > 1)
        return F.when(too_long, halves).otherwise(F.array(whole))

    return bind(F.concat_ws(" ", group), fit)


def _grouped(sents: Column, per: int, max_chars: int, min_len: int) -> Column:
    starts = F.sequence(F.lit(1), F.size(sents), F.lit(per))
    groups = F.transform(starts, lambda i: F.slice(sents, i, F.lit(per)))
    joined = F.flatten(F.transform(groups, lambda g: _joined_group(g, max_chars)))
    wrapped = F.flatten(F.transform(joined, lambda c: wrap(c, max_chars)))
    return F.filter(wrapped, lambda c: F.length(c) >= min_len)


def paragraphs(
    text: Column,
    delimiter: str = PARAGRAPH_BREAK,
    min_len: int = MIN_PARAGRAPH,
    sentences_per_paragraph: int = SENTENCES_PER_PARAGRAPH,
    max_chars: int = MAX_PARAGRAPH,
) -> Column:
    """Array of paragraphs.

    Two or more delimited blocks are taken as they are. Otherwise sentences are
    grouped, over-long groups halved, and what is still too long wrapped.
    """
    delimited = F.filter(
        _pieces(text, r"\Q" + delimiter + r"\E"), lambda p: F.length(p) >= min_len
    )

    def choose(parts: Column) -> Column:
        def from_sentences(sents: Column) -> Column:
            return F.when(F.size(sents) == 0, parts).otherwise(
                _grouped(sents, sentences_per_paragraph, max_chars, min_len)
            )

        return F.when(F.size(parts) > 1, parts).otherwise(bind(sentences(text), from_sentences))

    return bind(delimited, choose)
