"""Text analysis: character classes, tokens, normal forms and the logarithm that scores use."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A token's as-is form is cut at this length. Lengths of tokens count characters here, so a word of accented letters is never cut
#: inside one and is as long as it looks.
LONGEST = 49


def _escaped(chars: str) -> str:
    return "".join("\\x%02x" % ord(c) if c in "\t\n\x0b\f\r" else "\\" + c if c in "[]\\^-" else c for c in chars)


@dataclass(frozen=True)
class CharClasses:
    """Characters that separate words, that form words of their own, and that bind within words; all others are word characters.

    Fixed values: the defaults below are the engine's standard classes."""

    space: str = "\t\n\x0b\f\r "
    delimiter: str = "!\"#$%&'()*/<=>?[\\]^`{|}~"
    glue: str = "+,-.:;@"

    @property
    def pattern(self) -> str:
        """A token: a run of word and glue characters, or a run of delimiters."""
        return f"[^{_escaped(self.space)}{_escaped(self.delimiter)}]+|[{_escaped(self.delimiter)}]+"

    @property
    def delimiter_class(self) -> str:
        return f"[{_escaped(self.delimiter)}]"

    def tokens(self, text: Column) -> Column:
        return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(self.pattern), F.lit(0))

    def as_is(self, token: Column) -> Column:
        return F.substring(token, 1, LONGEST)

    def normal(self, token: Column) -> Column:
        """Empty for a run of delimiters; else A-Z lower-cased and without glue at the end."""
        delimiters = F.contains(F.lit(self.delimiter), F.substring(token, 1, 1))
        return F.when(delimiters, "").otherwise(F.rtrim(fold(self.as_is(token)), F.lit(self.glue)))

    def normal_word(self, word: Column) -> Column:
        """The normal form of a single word: empty only if every character is a delimiter."""
        return F.when(word.rlike(f"^{self.delimiter_class}*$"), "").otherwise(F.rtrim(fold(word), F.lit(self.glue)))

    def parts(self, text: Column) -> Column:
        """Tokens of the plain splitter: runs over 48 characters are dropped, not cut."""
        return F.filter(self.tokens(text), lambda t: F.char_length(t) <= LONGEST - 1)

    # the same for query texts, on the driver
    def tokenize(self, text: str) -> tuple[list[str], list[str]]:
        tokens = [t[:LONGEST] for t in re.findall(self.pattern, text)]
        return tokens, [self.normalize(t) for t in tokens]

    def normalize(self, token: str) -> str:
        return "" if token[:1] and token[0] in self.delimiter else token.translate(str.maketrans(UPPER, LOWER)).rstrip(self.glue)


STANDARD = CharClasses()


def fold(text: Column) -> Column:
    """A-Z lower-cased, nothing else."""
    return F.translate(text, UPPER, LOWER)


def score_log(x: Column) -> Column:
    """ceil(10 ln x) / 10, and 0 up to 1."""
    return F.when(x <= 1, F.lit(0.0)).otherwise(F.ceil(F.lit(10.0) * F.ln(x)) / F.lit(10.0))
