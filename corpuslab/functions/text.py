"""Column expressions over texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns of words, CJK characters, entities and citations.
WORD = r"[A-Za-z0-9][A-Za-z0-9_.:\-/]*"
CJK = r"[㐀-䶿一-鿿豈-﫿]+"
HAN = r"[一-鿿]"
ENTITY = r"[A-Za-z][A-Za-z0-9_.\-]{2,}|\d+(?:\.\d+)?%?"
CITATION = r"\[\d{1,2}\]"
#: White space as Unicode has it.
SPACE = r"(?U)\s+"


#: Escapes of markup inside a script string and what they stand for, in the order they are undone (fixed values).
ESCAPES = (('\\"', '"'), ("\\n", "\n"), ("\\t", "\t"), ("\\/", "/"), ("\\\\", "\\"))


def unescaped(page: Column) -> Column:
    """A page whose markup sits in a script string, as markup; one without escaped quotes or line ends as it is."""
    plain = page
    for mark, stands_for in ESCAPES:
        plain = F.replace(plain, F.lit(mark), F.lit(stands_for))
    return F.when(F.contains(page, F.lit(ESCAPES[0][0])) | F.contains(page, F.lit(ESCAPES[1][0])), plain).otherwise(page)


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches of a pattern; none in a null text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group))


def tokens(text: Column) -> Column:
    """Search tokens with repeats: lower-cased ASCII words without trailing punctuation, and of every
    run of CJK characters all single ones and all neighbouring pairs. Null gives an empty array."""
    words = F.transform(matches(text, WORD), lambda w: F.lower(F.rtrim(w, F.lit("./:-_"))))

    def grams(run: Column, n: int) -> Column:
        count = F.length(run) - (n - 1)
        cut = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.substr(run, i, F.lit(n)))
        return F.when(count >= 1, cut).otherwise(F.array().cast("array<string>"))

    runs = F.transform(matches(text, CJK), lambda r: F.concat(grams(r, 1), grams(r, 2)))
    return F.concat(words, F.flatten(runs))


def token_count(text: Column) -> Column:
    """How many search tokens a text has, without making them: n CJK characters in r runs give 2n - r."""
    text = F.coalesce(text, F.lit(""))
    words, characters, runs = (F.regexp_count(text, F.lit(p)) for p in (WORD, CJK.rstrip("+"), CJK))
    return (words + 2 * characters - runs).cast("long")


def estimated_tokens(text: Column) -> Column:
    """0.6 for each Han character and 1.3 for each ASCII word, rounded down."""
    han, words = F.size(matches(text, HAN)), F.size(matches(text, "[A-Za-z]+"))
    return F.floor(han * 0.6 + words * 1.3).cast("long")


def collapse(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def squeezed(text: Column) -> Column:
    """The text without white space."""
    return F.regexp_replace(text, SPACE, "")


def plain_text(html: Column) -> Column:
    """A page's text: scripts, styles and tags removed, white space collapsed."""
    text = F.regexp_replace(F.regexp_replace(html, r"(?s)<script.*?</script>", " "), r"(?s)<style.*?</style>", " ")
    return collapse(F.regexp_replace(text, r"(?s)<[^>]+>", " "))


def faithfulness_floor(answer: Column, context: Column, strip_citations: bool = True) -> Column:
    """Share of an answer's distinct entities that occur in the context; 1.0 if it names none."""
    if strip_citations:
        answer, context = (F.regexp_replace(c, CITATION, " ") for c in (answer, context))
    named = F.array_distinct(matches(answer, ENTITY))
    held = F.filter(named, lambda e: F.coalesce(F.contains(context, e), F.lit(False)))
    return F.when(F.size(named) == 0, F.lit(1.0)).otherwise(F.size(held) / F.size(named))
