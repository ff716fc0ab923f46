"""Words, identifier parts, token counts, comments and classifiers as column expressions."""

from __future__ import annotations

import math
import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .stemmer import stem

# Patterns of titles without a code reference, and of the further title buckets.
MERGE_NOISE = r"(?i)^(merge\b|apply suggestions from code review)"
DEPENDENCY_NOISE = r"(?i)^(bump|upgrade)\b|\bdependabot\b|\bfrom\s+v?\d[\w.\-]*\s+to\s+v?\d[\w.\-]*"
CI_NOISE = r"(?i)^(ci|build|chore)(\(|:|\b)"
FORMATTING = r"(?i)\b(format|formatting|whitespace|typo|nitpick|cleanup|style|rename)\b"
ROUTE_WORDS = r"(?i)\b(route|routes|routing|endpoint|controller|http|api|minimal api)\b"
TEST_WORDS = r"(?i)\b(test|tests|spec|specs|unit test)\b"
IDENTIFIER = r"[a-z][A-Z]|[A-Z][a-z]+[A-Z]|\w+\(\)|\.cs\b|\b[A-Z]\w*\.[A-Z]\w*"
BUCKETS = (
    ("no-signal", MERGE_NOISE), ("dependency-bump", DEPENDENCY_NOISE), ("config-ci", CI_NOISE), ("formatting", FORMATTING),
    ("route-api", ROUTE_WORDS), ("test-only", TEST_WORDS), ("identifier-rich", IDENTIFIER),
)

def _latin() -> tuple[str, str]:
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)] if chr(c).islower()]
    marked = [(c, base) for c, base in pairs if base != c and "a" <= base <= "z"]
    return "".join(c for c, _ in marked), "".join(base for _, base in marked)


#: Latin letters with diacritics, and the letters under them by the decompositions of Unicode.
LATIN = _latin()


def plain(text: Column) -> Column:
    """Lower case, without diacritics: those of Latin letters of one sign, and combining ones anywhere."""
    return F.regexp_replace(F.translate(F.lower(text), *LATIN), r"\p{Mn}+", "")


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits, without diacritics."""
    return F.regexp_extract_all(plain(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def identifier_parts(name: Column) -> Column:
    """Parts of an identifier at case, digit and sign changes: lower case, two characters or more, each once, in order."""
    found = F.regexp_extract_all(name, F.lit(r"\p{Lu}+(?=\p{Lu}\p{Ll})|\p{Lu}?\p{Ll}+|\p{Lu}+|\p{Nd}+"), F.lit(0))
    return F.array_distinct(F.filter(F.transform(found, F.lower), lambda p: F.length(p) >= 2))


def split_identifier(name: str) -> list[str]:
    found = re.findall(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+", name)
    return list(dict.fromkeys(p.lower() for p in found if len(p) >= 2))


def match_terms(query: str) -> list[list[str]]:
    """Phrases of a full-text query: each term, the parts of it and the stem of each part, once, OR-ed by the search.

    Terms keep '_'; such a term is a phrase of several words.
    """
    phrases: dict[str, None] = {}
    for term in re.findall(r"\w+", query):
        for phrase in (term, *split_identifier(term), *(stem(p) for p in split_identifier(term))):
            phrases.setdefault(phrase.lower())
    return [p for phrase in phrases if (p := re.findall(r"[^\W_]+", phrase))]


def token_estimate(text: Column) -> Column:
    return F.floor((F.length(text) + 3) / 4).cast("long")


def approximate_tokens(text: Column, chars_per_token: float = 4.0) -> Column:
    """A token for each started ``chars_per_token`` characters of a run of letters and digits, one for each other sign."""
    runs = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0))
    total = F.aggregate(F.transform(runs, lambda r: F.ceil(F.length(r) / F.lit(chars_per_token))), F.lit(0).cast("long"), lambda a, x: a + x)
    return F.coalesce(total + F.regexp_count(text, F.lit(r"[^\p{L}\p{Nd}\s]")), F.lit(0)).cast("long")


def reduced_token_cost(raw: Column, extension: Column, level: str) -> Column:
    """Tokens expected after reduction: fixed retention by level for C#, 0.95 for others; half away from zero."""
    kept = {"none": 92, "standard": 92, "aggressive": 70, "skeleton": 15, "publicApi": 10}[level]
    percent = F.when(F.lower(extension) == ".cs", F.lit(kept)).otherwise(F.lit(95))
    return F.floor((raw * percent + 50) / 100).cast("long")


#: What is a comment, and its markers.
COMMENT = r"/\*[\s\S]*?\*/|(?://[^\n]*\n?)+|(?:#[^\n]*\n?)+"
COMMENT_MARKERS = r"(?m)/\*+|\*+/|^\s*\*|///?|#"


def comments(text: Column) -> Column:
    """Prose of the comments: block comments, runs of // lines, runs of # lines; markers and tags removed, white space as one space."""
    found = F.regexp_extract_all(text, F.lit(COMMENT), F.lit(0))
    plain = F.transform(found, lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, COMMENT_MARKERS, " "), r"<[^>]+>", " "), r"\s+", " ")))
    return F.array_join(F.filter(plain, lambda c: c != ""), " ")


def title_bucket(title: Column) -> Column:
    """First bucket whose pattern is found in a title; empty titles carry no signal."""
    t = F.trim(F.coalesce(title, F.lit("")))
    out = F.when(t == "", F.lit("no-signal"))
    for name, pattern in BUCKETS:
        out = out.when(t.rlike(pattern), F.lit(name))
    return out.otherwise(F.lit("nl-domain"))


def low_signal(title: Column, structured: Column | None = None) -> Column:
    """Whether a request without structured inputs points at nothing in code."""
    t = F.trim(F.coalesce(title, F.lit("")))
    low = (t == "") | t.rlike(MERGE_NOISE) | t.rlike(DEPENDENCY_NOISE) | t.rlike(CI_NOISE)
    return low if structured is None else ~F.coalesce(structured, F.lit(False)) & low


def is_test_path(path: Column) -> Column:
    low = F.lower(path)
    return low.rlike(r"(tests|specs|test)\.cs$") | low.rlike(r"(^|/)(tests?|specs?)/") | low.rlike(r"\.tests?/")


def is_generated(path: Column, prefix: Column) -> Column:
    low = F.lower(path)
    return low.rlike(r"\.(g|designer|generated)(\.i)?\.cs$") | (low.contains("/migrations/") & low.endswith("modelsnapshot.cs")) | F.coalesce(prefix, F.lit("")).contains("<auto-generated")


def is_trivial(content: Column) -> Column:
    t = F.trim(F.coalesce(content, F.lit("")))
    return t.isin("", "{}", "[]") | ((F.length(t) <= 120) & t.rlike(r"^<[^<>]*/>$"))


def density(score: float, tokens: int, overhead: int = 30) -> float:
    return score / math.fsum((tokens, overhead))
