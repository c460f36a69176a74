"""Readable text and safe paths from markup, as columns."""

from __future__ import annotations

import html as references
import re
from collections import Counter
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements whose content is not reading text.
IGNORED_ELEMENTS = frozenset({"script", "style", "table", "figure"})
# Fixed values of HTML: elements that end an open paragraph where they begin or end.
PARAGRAPH_ENDS = frozenset("""
address article aside blockquote body details div dl fieldset figcaption footer form h1 h2 h3 h4 h5 h6 header hgroup hr
html main menu nav ol pre section ul
""".split())
_LISTS = ("ul", "ol", "menu")
# Unicode's white space.
_SPACES = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
_MARK = re.compile(r"\[[0-9]+\]")
_TAG = re.compile(
    r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)(?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*(?:>|$)", re.S)


def _clean(text: str) -> str:
    return _MARK.sub("", _SPACES.sub(" ", text).strip(" "))


def _blocks(page: str) -> list[str]:
    """One pass over the tags with the open paragraphs, items and lists on a stack."""
    found: list[str] = []
    open_: list[str] = []  # p, li and lists
    lists: Counter[str] = Counter()  # open lists by name
    parts: list[str] = []
    depth = ignored = at = 0  # open p and li; open ignored elements

    def end(name: str, below: tuple[str, ...] = ()) -> None:
        """End the innermost ``name`` and what is open in it, unless one of ``below`` is nearer."""
        nonlocal depth
        for place in range(len(open_) - 1, -1, -1):
            if open_[place] == name:
                depth -= sum(x in ("p", "li") for x in open_[place:])
                lists.subtract(x for x in open_[place:] if x in _LISTS)
                del open_[place:]
                break
            if open_[place] in below:
                return
        if not depth and parts:
            text = _clean("".join(parts))
            parts.clear()
            if text:
                found.append(text)

    for tag in _TAG.finditer(page):
        if depth and not ignored and tag.start() > at:
            parts.append(references.unescape(page[at:tag.start()]))
        if tag.start() < at:  # inside a script or style
            continue
        at = tag.end()
        name = (tag.group(2) or "").lower()
        if name in IGNORED_ELEMENTS:
            if tag.group(1):
                ignored = max(ignored - 1, 0)
            elif name in ("script", "style"):
                last = re.compile(rf"</{name}(?:[\s/][^>]*)?(?:>|$)", re.I).search(page, at)
                at = last.end() if last else len(page)
            else:
                ignored += 1
        elif ignored or not name:
            continue
        elif name == "p":
            end("p", ("li", *_LISTS))
            if not tag.group(1):
                open_.append("p")
                depth += 1
        elif name == "li":
            end("li", _LISTS)
            if not tag.group(1):
                end("p", ("li", *_LISTS))
                open_.append("li")
                depth += 1
        elif name in PARAGRAPH_ENDS:
            end("p", ("li", *_LISTS))
            if name in _LISTS:
                if not tag.group(1):
                    open_.append(name)
                    lists[name] += 1
                elif lists[name]:
                    end(name)
    if depth:
        if not ignored:
            parts.append(references.unescape(page[at:]))
        open_[:] = ["p"]
        depth = 1
        end("p")
    return found


@F.pandas_udf(T.ArrayType(T.StringType()))
def _reading_blocks(pages: pd.Series) -> pd.Series:
    return pages.map(lambda page: None if page is None else _blocks(page))


def reading_blocks(html: Column) -> Column:
    """Texts of the outermost p and li blocks outside ignored elements, in page order.

    A paragraph also ends where another block begins or the element around it
    ends, an item where the next one of its list begins, both at the end of the
    page. White space is collapsed, all character references are decoded once,
    [n] marks removed, empty blocks dropped. The whole page is read; null gives null.
    """
    return _reading_blocks(html.cast("string"))


# Character references in headings.
REFERENCES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def _plain(text: Column) -> Column:
    text = F.regexp_replace(text, r"<[^>]*>", "")
    for reference, sign in REFERENCES:
        text = F.replace(text, F.lit(reference), F.lit(sign))
    text = F.btrim(F.regexp_replace(text, r"[\s\p{Z}]+", " "))
    return F.regexp_replace(text, r"\[[0-9]+\]", "")


def section_text(html: Column, blocks: int | None = None, length: int | None = None) -> Column:
    """Text of a page; a report may take its first blocks, up to a length."""
    found = reading_blocks(html)
    text = F.array_join(found if blocks is None else F.slice(found, 1, blocks), "\n\n")
    return text if length is None else F.substring(text, 1, length)


def wanted_section(sections: Column, chapter: str = "chinese", titles: tuple[str, ...] = ("glyph origin", "glyph origins")) -> Column:
    """Index of the first section with a wanted title inside the level-2 chapter.

    ``sections`` is array<struct<level, line, index>> in page order.
    """
    def title(s: Column) -> Column:
        return F.lower(_plain(s["line"]))

    start = F.struct(F.lit(False).alias("inside"), F.lit(None).cast("string").alias("found"))

    def step(state: Column, s: Column) -> Column:
        top = s["level"] == 2
        hit = ~top & state["inside"] & title(s).isin(*titles)
        return F.struct(
            F.when(top, title(s) == chapter).otherwise(state["inside"]).alias("inside"),
            F.coalesce(state["found"], F.when(hit, s["index"].cast("string"))).alias("found"))

    return F.aggregate(sections, start, step, lambda s: s["found"])


# Characters a stroke path may hold.
PATH_PATTERN = r"^[MmLlHhVvCcSsQqTtAaZzEe0-9.,+\-\s]+$"


def _path_data(document: str) -> list[str] | None:
    """The d attributes of all path elements in order, whatever their prefixes."""
    if not document:
        return None
    found: list[str] = []

    def local(name: str) -> str:
        return name.partition(":")[2] or name

    def start(name: str, attributes: dict[str, str]) -> None:
        if local(name) == "path":
            found.extend(value for key, value in sorted(attributes.items()) if local(key) == "d" and not key.startswith("xmlns:"))

    parser = expat.ParserCreate("utf-8")
    parser.StartElementHandler = start
    parser.Parse(document.encode(), True)
    return found


@F.pandas_udf(T.ArrayType(T.StringType()))
def _paths(documents: pd.Series) -> pd.Series:
    return documents.map(_path_data, na_action="ignore")


def stroke_paths(xml: Column, paths: int | None = None, length: int | None = None) -> Column:
    """Safe path data of an SVG document; a report may take the first ``paths``
    of those no longer than ``length``. One pass of a parser over its tags, no
    tree; null or empty gives null, and what is no XML is an error."""
    found = F.transform(_paths(xml.cast("string")), lambda d: F.btrim(d))
    safe = F.filter(found, lambda d: d.rlike(PATH_PATTERN))
    if length is not None:
        safe = F.filter(safe, lambda d: F.length(d) <= length)
    return safe if paths is None else F.slice(safe, 1, paths)


def stroke_components(xml: Column, character: Column) -> Column:
    """Distinct 'element|position' pairs of an SVG document, in order, without
    the character itself."""
    groups = F.regexp_extract_all(xml, F.lit(r"<[A-Za-z][^<>]*\belement=\"[^\"]*\"[^<>]*>"), 0)

    def pair(tag: Column) -> Column:
        element = F.btrim(F.regexp_extract(tag, r"\belement=\"([^\"]*)\"", 1))
        position = F.btrim(F.regexp_extract(tag, r"\bposition=\"([^\"]*)\"", 1))
        return F.struct(element.alias("element"), position.alias("position"))

    kept = F.filter(F.transform(groups, pair), lambda p: (F.length(p["element"]) > 0) & (p["element"] != character))
    return F.transform(F.array_distinct(kept), lambda p: F.concat_ws("|", p["element"], p["position"]))
