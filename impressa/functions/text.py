"""Text helpers: tokenising and length measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default token pattern: words of any script, numbers with inner separators, and every other visible
# character alone (as punctuation).  Callers may pass another pattern, or use ``tokenize_rules``.
DEFAULT_TOKEN_PATTERN = r"[\p{L}\p{M}]+|\p{N}+(?:[.,]\p{N}+)*|[^ \t\n\x0B\f\r\p{L}\p{M}\p{N}]"

# Rewrite rules in the manner of the published Treebank tokenizer, applied in order to a
# lower-cased text whose white space is one space and which begins and ends with one.  ``$1`` is the
# first group.  They use only what Java's and RE2's patterns have in common.
TOKEN_RULES = (
    # opening quotes
    ('([ (\\[{<])"', "$1`` "), ("([ (\\[{<])''", "$1`` "),
    # commas and colons that stand in no number, ellipses, other marks
    ("([:,])([^0-9])", " $1 $2"), ("[.][.][.]+", " ... "), ("([;@#$%&?!])", " $1 "),
    # brackets and dashes
    ("([\\]\\[(){}<>])", " $1 "), ("(---?)", " $1 "),
    # closing quotes
    ('"', " '' "), ("([^' ])' ", "$1 ' "), ("([^' ])'' ", "$1 '' "),
    # possessives and contractions
    ("([^' ])('s|'m|'d) ", "$1 $2 "), ("([^' ])('ll|'re|'ve|n't) ", "$1 $2 "),
    (" can(not) ", " can $1 "), (" (gim|lem)(me) ", " $1 $2 "), (" (gon|wan)(na) ", " $1 $2 "), (" got(ta) ", " got $1 "),
    (" d('ye) ", " d $1 "), (" more('n) ", " more $1 "), (" ('t)(is|was) ", " $1 $2 "),
)
# Words that keep their full stop.
ABBREVIATIONS = ("mr", "mrs", "ms", "dr", "prof", "st", "sr", "jr", "vs", "etc", "inc", "ltd", "co", "corp", "dept", "gen", "gov",
                 "sen", "rep", "rev", "hon", "lt", "col", "sgt", "capt", "no", "vol", "fig", "jan", "feb", "mar", "apr", "jun",
                 "jul", "aug", "sept", "sep", "oct", "nov", "dec")
SPACE_RUN = r"[ \t\n\x0B\f\r]+"
# A word with one full stop behind it; letters with stops between them ("u.s.") are one word.
STOPPED, INITIALS = r"^(.*[^.])[.]$", r"^(?:\p{L}[.])+$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokenize(col, pattern: str = DEFAULT_TOKEN_PATTERN) -> Column:
    """V1: tokens of the lower-cased, trimmed text, in order."""
    return F.regexp_extract_all(F.lower(F.trim(F.coalesce(_c(col), F.lit("")))), F.lit(pattern), F.lit(0))


def tokenize_rules(col, rules=TOKEN_RULES, abbreviations=ABBREVIATIONS) -> Column:
    """V1 by a cascade of rewrite rules: the lower-cased text is rewritten rule by rule until its tokens
    stand between spaces ("don't" -> "do", "n't"; quotes -> `` and ''), then a full stop behind a word is a
    token of its own unless the word is an abbreviation or initials.  Null or blank text has no token."""
    # spaces are doubled while rules run, so that neighbouring matches never share one
    t = F.regexp_replace(F.concat(F.lit(" "), F.lower(F.coalesce(_c(col), F.lit(""))), F.lit(" ")), SPACE_RUN, "  ")
    for pattern, new in rules:
        t = F.regexp_replace(t, pattern, new)
    parts = F.filter(F.split(t, " +"), lambda w: w != "")
    known = F.array(*[F.lit(a) for a in abbreviations]).cast("array<string>")

    def cut(w: Column) -> Column:
        stem = F.regexp_extract(w, STOPPED, 1)
        return F.when((stem == "") | w.rlike(INITIALS) | F.array_contains(known, stem), F.array(w)).otherwise(F.array(stem, F.lit(".")))
    return F.flatten(F.transform(parts, cut))


def rule_words(col) -> Column:
    """The words of a text between white space.  No rule of TOKEN_RULES looks beyond the white space around a word, so
    the tokens of a text are those that ``tokenize_rules`` gives for each of its words, in order."""
    return F.filter(F.split(F.coalesce(_c(col), F.lit("")), SPACE_RUN), lambda w: w != "")


def word_count(col) -> Column:
    """G1: number of whitespace-separated words; empty or blank text has 0."""
    return F.size(F.filter(F.split(F.trim(F.coalesce(_c(col), F.lit(""))), r"\s+"), lambda x: x != ""))


def token_count(col, pattern: str = DEFAULT_TOKEN_PATTERN) -> Column:
    """G2."""
    return F.size(tokenize(col, pattern))
