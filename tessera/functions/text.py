"""Tokenisers and content hashes as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The default English stop words. Those with an apostrophe never match a token, which has none.
STOPWORDS = (
    "a about above after again against all am an and any are aren't as at be because been before being below between both but by "
    "can can't cannot could couldn't did didn't do does doesn't doing don't down during each few for from further had hadn't has hasn't "
    "have haven't having he he'd he'll he's her here here's hers herself him himself his how how's i i'd i'll i'm i've if in into is "
    "isn't it it's its itself let's me more most mustn't my myself no nor not of off on once only or other ought our ours ourselves "
    "out over own same shan't she she'd she'll she's should shouldn't so some such than that that's the their theirs them themselves "
    "then there there's these they they'd they'll they're they've this those through to too under until up very was wasn't we we'd "
    "we'll we're we've were weren't what what's when when's where where's which while who who's whom why why's with won't would "
    "wouldn't you you'd you'll you're you've your yours yourself yourselves"
).split()

# Words that faithfulness does not count.
FUNCTION_WORDS = "the a an is are was were and or to in of for with that this it".split()


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often and wherever it is used."""
    return F.transform(F.array(value), use)[0]


def _ascii_words(text: Column | str) -> Column:
    """Lower case, with every letter and digit beyond ASCII as ``Z``: a word character that no lower-cased ASCII word has.

    Word boundaries then fall alike wherever the pattern runs.
    """
    return F.regexp_replace(F.lower(_col(text)), r"[\p{L}\p{N}&&[^\x00-\x7F]]", "Z")


def terms(text: Column | str, stopwords: Iterable[str] | None = None) -> Column:
    """Index terms: runs of ASCII letters, digits, ``_`` and ``-`` of two characters and more, without stop words."""
    stop = list(STOPWORDS if stopwords is None else stopwords)
    found = F.filter(F.regexp_extract_all(_ascii_words(text), F.lit(r"\b[a-z0-9_-]+\b"), F.lit(0)), lambda t: F.length(t) > 1)
    return F.filter(found, lambda t: ~t.isin(stop)) if stop else found


def word_runs(text: Column | str) -> Column:
    """Runs of letters, digits and ``_`` of any script, lower-cased."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def plain_words(text: Column | str) -> Column:
    """ASCII words of three letters and more."""
    return F.regexp_extract_all(_ascii_words(text), F.lit(r"\b[a-z]{3,}\b"), F.lit(0))


def cited_sources(answer: Column | str) -> Column:
    """The numbers in ``[Source n]`` tags, as strings."""
    return F.regexp_extract_all(_col(answer), F.lit(r"\[Source\s+(\d+)\]"), F.lit(1))


def stripped(text: Column | str) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(_col(text), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def content_hash(source: Column | str, text: Column | str) -> Column:
    """sha256 of ``source:text``, null counting as empty."""
    return F.sha2(F.concat(F.coalesce(_col(source), F.lit("")), F.lit(":"), F.coalesce(_col(text), F.lit(""))), 256)


def document_key(source: Column | str, text: Column | str) -> Column:
    return F.substring(content_hash(source, text), 1, 16)


def chunk_hash(text: Column | str) -> Column:
    return F.substring(F.sha2(_col(text), 256), 1, 16)
