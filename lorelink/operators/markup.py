"""Wiki markup to text: tags, tables, links, sections and lists.

Flat rules are regular expressions in the JVM. Rules that depend on nesting
(templates, tables, elements, links in links) first split off the rows that
nest at all; only those reach the small scanners, the others get a regular
expression.
"""

import re
from collections.abc import Callable
from html.entities import name2codepoint
from string import ascii_letters

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorelink.functions.links import balanced_spans
from lorelink.functions.text import OUTSIDE_LINKS, normalize_between_links

# Fixed values of the markup language.
SELF_CLOSING = ["br", "hr", "nobr", "ref", "references", "nowiki"]
IGNORED = [
    "abbr", "b", "big", "blockquote", "center", "cite", "em", "font", "h1", "h2", "h3", "h4", "hiero", "i", "kbd", "nowiki",
    "p", "plaintext", "s", "span", "strike", "strong", "tt", "u", "var",
]
DISCARDED = [
    "gallery", "timeline", "noinclude", "pre", "table", "tr", "td", "th", "caption", "div", "form", "input", "select", "option",
    "textarea", "ul", "li", "ol", "dl", "dt", "dd", "menu", "dir", "ref", "references", "img", "imagemap", "source", "small", "sub", "sup",
]
PLACEHOLDERS = {"math": "formula", "code": "codice"}
ACCEPTED_NAMESPACES = ["w", "wiktionary", "wikt"]
URL_START = (
    r"(?:bitcoin:|ftp://|ftps://|geo:|git://|gopher://|http://|https://|irc://|ircs://|magnet:|mailto:|mms://|news:|nntp://|redis://|"
    r"sftp://|sip:|sips:|sms:|ssh://|svn://|tel:|telnet://|urn:|worldwind://|xmpp:|//)"
)
SWITCHES = (
    "__NOTOC__|__FORCETOC__|__TOC__|__NEWSECTIONLINK__|__NONEWSECTIONLINK__|__NOGALLERY__|__HIDDENCAT__|__NOCONTENTCONVERT__|__NOCC__|"
    "__NOTITLECONVERT__|__NOTC__|__START__|__END__|__INDEX__|__NOINDEX__|__STATICREDIRECT__|__DISAMBIG__"
)
LIST_MARKS = "*#;:"
CODE = "(?s)&lt;syntaxhighlight .*?&gt;(.*?)&lt;/syntaxhighlight&gt;"


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, also where Spark puts the steps before this one in its place."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _outside(text: str, opener: re.Pattern, closer: re.Pattern) -> str:
    """Text outside the outermost pairs; an opener that is never closed stays."""
    marks = sorted(
        [(m.start(), m.end(), 1) for m in opener.finditer(text)] + [(m.start(), m.end(), -1) for m in closer.finditer(text)]
    )
    kept, depth, start, at = [], 0, 0, 0
    for begin, end, step in marks:
        if step == 1:
            if depth == 0:
                start = begin
            depth += 1
        elif depth:
            depth -= 1
            if depth == 0:
                kept.append(text[at:start])
                at = end
    return "".join([*kept, text[at:]])


def drop_nested(text: Column, opener: str, closer: str) -> Column:
    """Remove everything between matching delimiters, however deep they nest."""
    first, last = re.compile(opener, re.IGNORECASE), re.compile(closer, re.IGNORECASE)

    @F.pandas_udf(T.StringType())
    def scan(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else _outside(t, first, last))

    pair = f"(?is){opener}(?:(?!{opener})(?!{closer}).)*+{closer}"
    nests = f"(?is){opener}(?:(?!{closer}).)*?{opener}"
    return F.coalesce(scan(_once(text, lambda t: F.when(t.rlike(nests), t))), F.regexp_replace(text, pair, ""))


def replace_external_links(text: Column) -> Column:
    """``[url anchor]`` -> anchor."""
    return F.regexp_replace(text, r"(?is)\[" + URL_START + r"""[^\]\[<>"\x00-\x20\x7F\s]+\s*([^\]\[\x00-\x08\x0a-\x1F]*?)\]""", "$1")


def unescape_entities(text: Column) -> Column:
    """Numeric and named character references, each decoded once; unknown ones stay."""
    pieces = F.split(text, r"(?=&#(?:[0-9]{1,7}|x[0-9a-fA-F]{1,6});)")
    pattern = r"(?s)^&#(x?)([0-9a-fA-F]+);(.*)$"

    def decode(piece: Column) -> Column:
        digits = F.regexp_extract(piece, pattern, 2)
        code = F.when(F.regexp_extract(piece, pattern, 1) == "x", F.conv(digits, 16, 10)).otherwise(digits).cast("long")
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        sound = piece.rlike(pattern) & (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        return F.when(sound, F.concat(char, F.regexp_extract(piece, pattern, 3))).otherwise(piece)

    plain = F.when(text.contains("&#"), F.array_join(F.transform(pieces, decode), "")).otherwise(text)
    names = F.create_map(*[F.lit(x) for name, code in name2codepoint.items() for x in (name, chr(code))])
    named = r"(?s)^&([A-Za-z][A-Za-z0-9]{1,9});(.*)$"

    def replaced(piece: Column) -> Column:
        char = F.try_element_at(names, F.regexp_extract(piece, named, 1))
        return F.when(char.isNotNull(), F.concat(char, F.regexp_extract(piece, named, 2))).otherwise(piece)

    parts = F.transform(F.split(plain, r"(?=&[A-Za-z][A-Za-z0-9]{1,9};)"), replaced)
    return F.when(plain.rlike(r"&[A-Za-z][A-Za-z0-9]{1,9};"), F.array_join(parts, "")).otherwise(plain)


def unescape_outside_code(text: Column) -> Column:
    """Character references decoded, but not in ``syntaxhighlight`` elements that were escaped themselves: these leave their content."""

    def outside(t: Column) -> Column:
        code = F.concat(F.regexp_extract_all(t, F.lit(CODE), F.lit(1)), F.array(F.lit("")))
        pieces = F.zip_with(F.transform(F.split(t, CODE, -1), unescape_entities), code, lambda piece, inside: F.concat(piece, inside))
        return F.when(t.contains("&lt;syntaxhighlight "), F.array_join(pieces, "")).otherwise(unescape_entities(t))

    return _once(text, outside)


def _numbered_placeholders(text: Column, tag: str, word: str) -> Column:
    """Elements such as ``<math>`` become formula_1, formula_2, ... by first appearance of their content."""
    pattern = rf"(?is)<\s*{tag}(?:\s*| [^>]+?)>.*?<\s*/\s*{tag}\s*>"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    names = F.transform(found, lambda x: F.concat(F.lit(f"{word}_"), F.array_position(F.array_distinct(found), x).cast("string")))
    pieces = F.zip_with(F.split(text, pattern, -1), F.concat(names, F.array(F.lit(""))), lambda b, n: F.concat(b, n))
    return F.when(text.rlike(pattern), F.array_join(pieces, "")).otherwise(text)


@F.pandas_udf(T.StringType())
def _rewrite_links(texts: pd.Series, keep: pd.Series) -> pd.Series:
    tail = re.compile(r"\w+")

    def last_bar(inner: str) -> int:
        """The last bar outside links of the inner text."""
        at, found = 0, -1
        for start, end in [*balanced_spans(inner), (len(inner), len(inner))]:
            found = max(found, inner.rfind("|", at, start))
            at = end
        return found

    def rewrite(text, kept):
        if text is None:
            return None
        out, at = [], 0
        for start, end in balanced_spans(text):
            inner = text[start + 2 : end - 2]
            bar = inner.find("|")
            title = inner if bar < 0 else inner[:bar].rstrip()
            label = inner if bar < 0 else inner[last_bar(inner) + 1 :].strip()
            # Letters glued to a link go; a blank parts it from what stands before, be it another link or that link's tail.
            before = text[at:start].rstrip(ascii_letters)
            if (before or at) and not before.endswith(" "):
                before += " "
            trail = tail.match(text, end)
            out.append(before + _link_text(title.replace("\t", " "), _plain_label(label), kept))
            at = trail.end() if trail else end
        return "".join([*out, text[at:]])

    return pd.Series([rewrite(t, k) for t, k in zip(texts, keep)])


_LABEL_GAP = re.compile(OUTSIDE_LINKS)


def _plain_label(label: str) -> str:
    return " ".join("dddddd" if re.fullmatch("[0-9]+", w) else w for w in _LABEL_GAP.sub(" ", label).split(" ")).lower()


# An optional leading colon and a namespace.
_NAMESPACE = re.compile("(:?)([^:]+):")


def _link_text(title: str, label: str, keep: bool) -> str:
    """A kept link, or its label, or nothing for pages of other namespaces; sister projects leave the label."""
    place = _NAMESPACE.match(title)
    sister = bool(place) and place[2] in ACCEPTED_NAMESPACES
    if place and not sister:
        return ""
    if not keep or (sister and not place[1]):
        return label
    return "[[" + "|".join(dict.fromkeys([title, label])) + "]]"


def rewrite_internal_links(text: Column, keep_links: bool = True) -> Column:
    """``[[title|...|label]]`` with a normalised label, or the label alone.

    Links into other namespaces vanish, accepted sister projects leave their
    label; letters glued to either side of a link go. Texts without a link are
    not sent to Python.
    """
    scanned = _rewrite_links(_once(text, lambda t: F.when(t.contains("[["), t)), F.lit(keep_links))
    return F.coalesce(scanned, text)


def drop_elements(text: Column, tags: list[str] = DISCARDED) -> Column:
    """Remove elements with their content, tag by tag; only nesting ones are scanned."""
    open_close = [(rf"<\s*{t}\b[^>/]*>", rf"<\s*/\s*{t}>") for t in tags]
    compiled = [(re.compile(o, re.IGNORECASE), re.compile(c, re.IGNORECASE)) for o, c in open_close]

    @F.pandas_udf(T.StringType())
    def scan(texts: pd.Series) -> pd.Series:
        def drop(text):
            for opener, closer in compiled if text is not None else ():
                text = _outside(text, opener, closer)
            return text

        return texts.map(drop)

    def flat(t: Column) -> Column:
        out = t
        for opener, closer in open_close:
            out = F.regexp_replace(out, f"(?is){opener}(?:(?!{closer}).)*+{closer}", "")
        return F.when(t.contains("<"), out).otherwise(t)

    nests = rf"(?is)<\s*({'|'.join(tags)})\b[^>/]*>(?:(?!<\s*/\s*\1>).)*?<\s*\1\b[^>/]*>"
    return F.coalesce(scan(_once(text, lambda t: F.when(t.rlike(nests), t))), _once(text, flat))


def _quotes(text: Column) -> Column:
    """Bold and italic marks go, quoting ones become quotation marks."""
    rules = [("'''''(.*?)'''''", "$1"), ("'''(.*?)'''", "$1"), ("''\"([^\"]*?)\"''", '"$1"'), ("''(.*?)''", '"$1"'), ('""([^"]*?)""', '"$1"'), ("'''", ""), ("''", '"')]
    for pattern, put in rules:
        text = F.regexp_replace(text, pattern, put)
    return text


def _tags(text: Column) -> Column:
    text = F.regexp_replace(text, r"(?s)<!--.*?-->", "")
    text = F.regexp_replace(text, rf"(?is)<\s*(?:{'|'.join(SELF_CLOSING)})\b[^>]*/\s*>", "")
    return F.regexp_replace(text, rf"(?is)<(?:{'|'.join(IGNORED)})\b[^>]*>|</\s*(?:{'|'.join(IGNORED)})>", "")


def _tidy(text: Column) -> Column:
    rules = [
        ("<<", "«"), (">>", "»"), ("\t", " "), (" {2,}", " "), (r"\.{4,}", "..."), (r" ([,:.)\]»])", "$1"), (r"([\[(«]) ", "$1"),
        (r"(?U)\n\W+?\n", "\n"), (",,", ","), (r",\.", "."),
    ]
    for pattern, put in rules:
        text = F.regexp_replace(text, pattern, put)
    return text


def strip_markup(pages: DataFrame, text: str = "text", keep_links: bool = True) -> DataFrame:
    """Plain text of wiki pages; internal links stay in ``[[..]]`` form when kept.

    Steps look at their input once, or once more for what goes to Python: Spark may put the steps before a step
    in the place of its input, each time it is named.
    """
    steps = [
        lambda c: drop_nested(c, r"\{\{", r"\}\}"),
        lambda c: drop_nested(c, r"\{\|", r"\|\}"),
        replace_external_links,
        lambda c: rewrite_internal_links(c, keep_links),
        lambda c: F.regexp_replace(c, SWITCHES, ""),
        unescape_outside_code,
        _quotes,
        _tags,
        drop_elements,
        # Names its input more than once, so Spark leaves the scanner's step apart; it cannot call Python inside of ``_once``.
        unescape_entities,
        *[lambda c, t=tag, w=word: _numbered_placeholders(c, t, w) for tag, word in PLACEHOLDERS.items()],
        _tidy,
    ]
    for step in steps:
        pages = pages.withColumn(text, step(F.col(text)))
    return pages


_LINES = T.ArrayType(T.StringType())
_KINDS = {
    "heading": r"(?P<marks>==+)\s*(?P<title>.*?)\s*(?P=marks)",
    "indent": r":",
    "item": rf"(?P<bullets>[{LIST_MARKS}]+)(?P<body>.*)",
    "residue": r"[{|]|.*\}$|\(.*\)$|[.-]+$",
    "text": r"",
}
_KINDS = {kind: re.compile(pattern, re.DOTALL) for kind, pattern in _KINDS.items()}


def _classified(text: str) -> list[tuple[str, str, re.Match]]:
    """(kind, line, match) of the lines that are not empty. Right behind a list anything but a heading is a tail of it."""
    out, before = [], ""
    for line in text.split("\n"):
        if not line:
            continue
        kind, found = next((k, m) for k, p in _KINDS.items() if (m := p.match(line)))
        if kind in ("residue", "text") and before == "item":
            kind = "tail"
        if kind != "indent":
            out.append((kind, line, found))
            before = kind
    return out


def _compact(text: str, keep_sections: bool, keep_lists: bool) -> list[str]:
    """Section by section: what comes first in a section, text or a kept list, decides about the rest of it."""
    lines = _classified(text)
    starts = [i for i, (kind, _, _) in enumerate(lines) if kind == "heading"]
    out: list[str] = []
    open_titles: list[tuple[int, str]] = []  # headings whose sections have shown nothing so far
    for start, end in zip([-1, *starts], [*starts, len(lines)]):
        if start >= 0:
            heading = lines[start][2]
            title, level = heading["title"], len(heading["marks"])
            title += "" if title.endswith(("!", "?")) or not title else "."
            open_titles = [t for t in open_titles if t[0] < level] + [(level, title)]
        first = "" if start >= 0 else "text"
        for kind, line, found in lines[start + 1 : end]:
            if kind == "tail":
                out.append(line)
                continue
            body = found["body"].strip() if kind == "item" else line
            if kind == "residue" or (kind == "item" and not (keep_lists and body)):
                continue
            if not first:
                first = kind
                out += [t for _, t in open_titles if keep_sections]
                open_titles = []
            elif kind == "text" and (first == "item" or line.startswith(" ")):
                continue
            if kind == "item":
                bullets = found["bullets"]
                body = ("1. " if bullets.endswith("#") else "- ").ljust(len(bullets)) + body
            out.append(body)
    return out


def compact_sections(text: Column, keep_sections: bool = True, keep_lists: bool = False) -> Column:
    """Lines worth keeping: headings only of sections with text, lists on request."""

    @F.pandas_udf(_LINES)
    def lines(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else _compact(t, keep_sections, keep_lists))

    return lines(text)


def clean_pages(pages: DataFrame, text: str = "text", keep_links: bool = True, keep_sections: bool = True, keep_lists: bool = False) -> DataFrame:
    """page_id, line_no, line: cleaned lines, normalised outside their links."""
    from lorelink.functions.links import link_segments

    bare = strip_markup(pages.select("page_id", F.col(text).alias("_t")), "_t", keep_links)
    lines = bare.select("page_id", F.posexplode(compact_sections(F.col("_t"), keep_sections, keep_lists)).alias("line_no", "_l"))
    pieces = F.transform(link_segments(F.col("_l")), lambda s: F.when(s["is_link"], s["text"]).otherwise(normalize_between_links(s["text"])))
    return lines.select("page_id", F.col("line_no").cast("long").alias("line_no"), F.array_join(pieces, "").alias("line"))
