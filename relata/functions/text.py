"""Text and title expressions; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import functions as F

# Patterns of tokens, sentence links and redirects, and the title prefixes of namespaces that aren't articles.
TOKEN = r"[\p{L}\p{N}_]+"
SENTENCE_LINK = r"(?d)\[(.+?)\|(.*?)\]"
REDIRECT = r"(?iud)^(?:#|＃)(?:REDIRECT|転送)[:\s]*(?:\[\[(.*)\]\]|(.*))"
IGNORED_NAMESPACES = ("wikipedia", "file", "portal", "template", "mediawiki", "user", "help", "book", "draft")


def tokens(text):
    """All tokens, case kept; a null text has null."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def lowered(array):
    """Tokens are lowered one by one, after cutting, so that places never shift."""
    return F.transform(array, F.lower)


def title(text):
    """First letter in upper case (one letter: ß stays), underscores as spaces; an empty title stays empty."""
    first = F.substring(text, 1, 1)
    return F.translate(F.concat(F.when(first == "ß", first).otherwise(F.upper(first)), F.substring(text, 2, 2147483647)), "_", " ")


def redirect(text):
    """The title that a page's text redirects to, or null (also for an empty one)."""
    linked, plain = F.regexp_extract(text, REDIRECT, 1), F.regexp_extract(text, REDIRECT, 2)
    found = F.when(linked != "", linked).when(plain != "", plain)
    return title(found)


def spaced(text):
    """Underscores as spaces, and nothing else; what sentence links' titles get."""
    return F.translate(text, "_", " ")


def collapsed(text):
    """Each run of white space as one space."""
    return F.regexp_replace(text, r"\s+", " ")


def article(name, ignored=IGNORED_NAMESPACES):
    """Whether a title is outside the ignored namespaces."""
    return ~F.lower(name).rlike(f"^({'|'.join(ignored)}):")


def last(ids, size: int):
    """The last `size` ids."""
    return F.slice(ids, F.greatest(F.size(ids) - size + 1, F.lit(1)), size)


def padded(ids, size: int):
    """The last `size` ids, with 0 in front of fewer."""
    return F.concat(F.array_repeat(F.lit(0).cast("int"), F.greatest(F.lit(size) - F.size(ids), F.lit(0))), last(ids, size))


def sanitized(value):
    """NaN as 0, and infinities as the largest 32-bit floats."""
    most = 3.4028234663852886e38
    return F.least(F.lit(most), F.greatest(F.lit(-most), F.nanvl(value, F.lit(0.0))))


def rounded(prediction):
    """A relevance from 0 to 7; halves go away from zero."""
    return F.greatest(F.lit(0), F.least(F.lit(7), F.round(prediction))).cast("int")
