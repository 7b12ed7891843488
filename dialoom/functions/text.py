"""Cleaning rules and text measures as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode whitespace, with the separators U+001C to U+001F.
SPACE = "(?U)[\\s\\x1c-\\x1f]"

# Typography, in this order (later replacements see the results of earlier ones).
TYPOGRAPHY = [
    ("’", "'"),
    ("‘", "'"),
    ("“", '"'),
    ("”", '"'),
    ("¡¦", "..."),
    ("…", "..."),
    ("¨", '"'),
    ("–", "-"),
    ("—", "-"),
    ("''", '"'),
]
# Tokens in which a capital I was read as l; words that were run together.
OCR_TOKENS = [("l", "I"), ("ls", "Is"), ("ln", "In"), ("lt", "It"), ("lf", "If")]
MERGED = [("NewYork", "New York")]
# Words without content.
STOPWORDS = """
a about after again all also an and any are as at be because been before being both but by can could
did do does doing during each for from had has have having he her here hers him his how i if in into
is it its just me more most my no nor not of off on once only or other our out over own same she
should so some such than that the their them then there these they this those through to too under
until up very was we were what when where which while who whom why will with would you your s t d ll
re ve m don doesn didn isn wasn won
""".split()

Rule = tuple[str, Callable[[Column], Column]]


def collapse_whitespace(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACE + "+", " "))


def plain_typography(c: Column) -> Column:
    for old, new in TYPOGRAPHY:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def l_as_i(c: Column) -> Column:
    for token, right in OCR_TOKENS:
        c = F.regexp_replace(c, rf"(?U)\b{token}\b", right)
    return c


def caps_l(c: Column) -> Column:
    """Words of capitals and l, with two capitals or more: l becomes I."""
    word = r"(?U)\b[A-Zl]{3,}\b"

    def mend(piece: Column) -> Column:
        odd = piece.rlike("^[A-Zl]{3,}$") & piece.contains("l") & piece.rlike("[A-Z].*[A-Z]")
        return F.when(odd, F.translate(piece, "l", "I")).otherwise(piece)

    pieces = F.regexp_extract_all(c, F.lit(word + r"|[\s\S]"), F.lit(0))
    return F.when(c.rlike(r"(?U)\b[A-Zl]*l[A-Zl]*\b") & c.rlike(word), F.array_join(F.transform(pieces, mend), "")).otherwise(c)


def part_merged(c: Column) -> Column:
    for old, new in MERGED:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def missing_space(c: Column) -> Column:
    return F.regexp_replace(c, "(?<=[a-z])([.?!])(?=[A-Z][a-z])", "$1 ")


def orphan_quote(c: Column) -> Column:
    return F.regexp_replace(c, '^"[\\s\\x1c-\\x1f]+', "")


def leading_dash(c: Column) -> Column:
    """Dashes at the start go, unless they are all there is or stick to a digit."""
    dashes = F.regexp_extract(c, r"^-[-\s]*", 0)
    after = F.substr(c, F.length(dashes) + 1, F.lit(1))
    keep = (dashes == "") | (F.length(dashes) == F.length(c)) | (after.rlike(r"^\p{Nd}") & ~dashes.rlike(r"\s"))
    return F.when(keep, c).otherwise(F.substr(c, F.length(dashes) + 1, F.length(c)))


def trailing_dash(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+-\s*$", "")


ROW_RULES: list[Rule] = [
    ("whitespace", collapse_whitespace),
    ("typography", plain_typography),
    ("ocr_l_as_I", l_as_i),
    ("ocr_caps_l", caps_l),
    ("merged_words", part_merged),
    ("missing_space", missing_space),
    ("orphan_quote", orphan_quote),
]
TURN_RULES: list[Rule] = [("leading_dash", leading_dash), ("trailing_dash", trailing_dash), ("whitespace", collapse_whitespace)]


def with_rules(c: Column, rules: list[Rule]) -> Column:
    """Struct (text, rules): the text after all rules, and the names of those that changed it.

    Each step is bound once, so the expression grows with the number of rules only.
    """
    state = F.struct(c.alias("text"), F.array().cast("array<string>").alias("rules"))
    for name, rule in rules:
        state = F.element_at(F.transform(F.transform(F.array(state), lambda s: F.struct(s.alias("s"), rule(s["text"]).alias("new"))), lambda x: F.struct(
            x["new"].alias("text"), F.when(x["new"] == x["s"]["text"], x["s"]["rules"]).otherwise(F.concat(x["s"]["rules"], F.array(F.lit(name)))).alias("rules"))), 1)
    return state


def split_turns(c: Column) -> Column:
    return F.split(c, r'(?<=[.?!"\-])\s+-\s*(?=\S)', -1)


def has_content(c: Column) -> Column:
    return c.rlike("(?U)[^\\W_]")


def search_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def count_tokens(c: Column) -> Column:
    """Words and punctuation marks."""
    return F.size(F.regexp_extract_all(c, F.lit(r"(?U)\w+|[^\w\s]"), F.lit(0)))


def match_form(c: Column) -> Column:
    """The form in which quotes are compared: lower case, letters a-z and digits, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "['’.]", ""), "[^a-z0-9]+", " "))


def content_words(c: Column) -> Column:
    """Distinct words of the match form with two characters or more that aren't stopwords."""
    words = F.filter(F.split(match_form(c), " "), lambda w: F.length(w) > 1)
    return F.array_except(words, F.array(*[F.lit(w) for w in STOPWORDS]))


def mentions(c: Column, name: str, variants: tuple[str, ...] = ()) -> Column:
    import re

    return c.rlike("|".join(rf"(?U)\b{re.escape(n)}\b" for n in (name, *variants)))


def slug(c: Column) -> Column:
    last = F.element_at(F.split(c, "/"), -1)
    return F.regexp_replace(F.regexp_replace(F.lower(last), "[^a-z0-9]+", "-"), "^-|-$", "")


def line_id(season: Column, episode: Column, row: Column, part: Column) -> Column:
    return F.format_string("s%02de%02d-r%03d-%d", season, episode, row, part)


def shown_line(speaker: Column, text: Column, unknown: str = "(unknown)") -> Column:
    return F.concat(F.coalesce(F.nullif(speaker, F.lit("")), F.lit(unknown)), F.lit(": "), text)
