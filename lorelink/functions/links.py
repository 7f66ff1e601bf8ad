"""Cutting text into link and non-link pieces.

Flat links are cut by regular expressions in the JVM. Only texts in which a
link opens inside another one go to the small stack scanner, as every other row
hands it a null.
"""

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEGMENTS = T.ArrayType(T.StructType([T.StructField("is_link", T.BooleanType()), T.StructField("text", T.StringType())]))

_NESTED = r"(?s)\[\[(?:(?!\]\]).)*?\[\["
_FLAT = r"(?s)\[\[(?:(?!\[\[|\]\]).)*?\]\]"
_DELIMITER = re.compile(r"\[\[|\]\]")


def balanced_spans(text: str) -> list[tuple[int, int]]:
    """Outermost ``[[...]]`` spans in order; inner links belong to the outer one."""
    spans, depth, start = [], 0, 0
    for mark in _DELIMITER.finditer(text):
        if mark.group() == "[[":
            if depth == 0:
                start = mark.start()
            depth += 1
        elif depth:
            depth -= 1
            if depth == 0:
                spans.append((start, mark.end()))
    return spans


@F.pandas_udf(SEGMENTS)
def _scan_segments(texts: pd.Series) -> pd.Series:
    def cut(text):
        if text is None:
            return None
        pieces, at = [], 0
        for start, end in balanced_spans(text):
            pieces.append({"is_link": False, "text": text[at:start]})
            pieces.append({"is_link": True, "text": text[start:end]})
            at = end
        return [*pieces, {"is_link": False, "text": text[at:]}]

    return texts.map(cut)


def link_segments(text: Column) -> Column:
    """Pieces of the text in order, links alternating with the text between them."""
    links = F.regexp_extract_all(text, F.lit(_FLAT), F.lit(0))
    between = F.split(text, _FLAT, -1)
    flat = F.flatten(
        F.zip_with(
            between,
            links,
            lambda b, l: F.filter(
                F.array(
                    F.struct(F.lit(False).alias("is_link"), b.alias("text")),
                    F.struct(F.lit(True).alias("is_link"), l.alias("text")),
                ),
                lambda p: p["text"].isNotNull(),
            ),
        )
    )
    return F.coalesce(_scan_segments(F.when(text.rlike(_NESTED), text)), flat)


def link_title(link: Column) -> Column:
    """Part before the first bar of ``[[title|label]]``."""
    return F.substring_index(_inner(link), "|", 1)


def link_label(link: Column) -> Column:
    """Part after the first bar, or the title when there is no bar."""
    inner = _inner(link)
    return F.when(F.instr(inner, "|") > 0, F.substring(inner, F.instr(inner, "|") + 1, F.length(inner))).otherwise(inner)


def _inner(link: Column) -> Column:
    return F.substring(link, F.lit(3), F.length(link) - 4)
