"""String normalisation as column expressions (JVM only, no Python rows)."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# ASCII punctuation, the number mask, and the extra characters
# blanked between links.
PUNCTUATION_OR_SPACE = r"[!-/:-@\[-`{-~ \t\n\r\f\x0B]+"
OUTSIDE_LINKS = r"[!-/:-@\[-`{-~ \t\n\r\f\x0B –°]+"
NUMBER_MASK = "dddddd"


def _mask_number(token: Column) -> Column:
    return F.when(token.rlike("^[0-9]+$"), F.lit(NUMBER_MASK)).otherwise(token)


def phrase_tokens(text: Column) -> Column:
    """Lower-cased tokens with punctuation as separators and numbers masked."""
    spaced = F.lower(F.trim(F.regexp_replace(text, PUNCTUATION_OR_SPACE, " ")))
    return F.transform(F.filter(F.split(spaced, " "), lambda t: t != ""), _mask_number)


def normalize_phrase(text: Column) -> Column:
    return F.array_join(phrase_tokens(text), " ")


def normalize_between_links(text: Column) -> Column:
    """The untrimmed form used for the text around links and for link labels."""
    spaced = F.split(F.regexp_replace(text, OUTSIDE_LINKS, " "), " ")
    return F.lower(F.array_join(F.transform(spaced, _mask_number), " "))


def entity_title(label: Column) -> Column:
    """Drop a trailing bracketed qualifier: ``Mercury (planet)`` -> ``Mercury``."""
    return F.trim(F.regexp_replace(label, r"\(.*?\)$", ""))


def entity_title_prefix(label: Column) -> Column:
    """Cut at the first bracket and one space before it."""
    return F.regexp_extract(label, r"^(.*?)(?: ?\(.*)?$", 1)


def upper_first(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text)))


def normalize_title(title: Column, known_namespaces: list[str]) -> Column:
    """Canonical title: single spaces, capital first letter, canonical namespace prefix."""
    plain = F.regexp_replace(F.trim(title, F.lit(" _")), r"[\s_]+", " ")
    parts = r"^([^:]*):(\s*)(\S.*)$"
    space = F.regexp_extract(plain, parts, 2)
    prefix = upper_first(F.regexp_extract(plain, parts, 1))
    rest = upper_first(F.regexp_extract(plain, parts, 3))
    gap = F.when(prefix.isin(known_namespaces) | (space == ""), "").otherwise(" ")
    return F.when(plain.rlike(parts), F.concat(prefix, F.lit(":"), gap, rest)).otherwise(upper_first(plain))


def page_url(base: str, page_id: Column) -> Column:
    return F.format_string(base.replace("%", "%%") + "?curid=%s", page_id.cast("string"))


def title_text_form(title: Column) -> Column:
    return F.translate(title, "\t", " ")


def string_features(mention: Column, title: Column) -> list[Column]:
    """Edit distance, equality, containment, prefix and suffix, as numbers."""
    return [
        F.levenshtein(mention, title).cast("double").alias("str_sim1"),
        (mention == title).cast("double").alias("str_sim2"),
        title.contains(mention).cast("double").alias("str_sim3"),
        title.startswith(mention).cast("double").alias("str_sim4"),
        title.endswith(mention).cast("double").alias("str_sim5"),
    ]


def escape_markup(text: Column) -> Column:
    """Escape the three characters that matter in HTML text."""
    amp = F.regexp_replace(text, "&", "&amp;")
    return F.regexp_replace(F.regexp_replace(amp, "<", "&lt;"), ">", "&gt;")


def clean_tagged_line(line: Column) -> Column:
    """Words of a ``word#TAG`` line, or null when the line is too short to keep.

    Numbers become the mask, repeated masks collapse, and lines need five items
    before cleaning and five words after.
    """
    items = F.split(F.trim(line), " ")
    tagged = F.filter(F.transform(items, lambda i: F.split(i, "#")), lambda p: F.size(p) == 2)
    words = F.transform(
        tagged,
        lambda p: F.when(p[1] == "NUMBER", F.lit(NUMBER_MASK)).otherwise(
            F.trim(F.regexp_replace(p[0], PUNCTUATION_OR_SPACE, " "))
        ),
    )
    single = F.filter(words, lambda w, i: (i == 0) | (w != NUMBER_MASK) | (F.get(words, i - 1) != NUMBER_MASK))
    return F.when((F.size(items) >= 5) & (F.size(single) > 4), F.array_join(single, " "))
