"""Main text of web pages by the distribution of text over their lines.

Markup is stripped to lines: one per block of the page, in page order. Blocks
that say what they are (navigation, headers, footers, sidebars, notices,
adverts, forms, comments of readers, scripts and styles) give no line; a form
with most of the page's text is the page, not a form. A class or id says so by
whole names only ("cookie-notice", not "section-header" or "share-prices"), and
never on headings and tables, nor on paragraphs of an article; of a header inside
an article the headings belong to it. Over the rest the text lengths are summed in sliding
windows of lines; where the sums surge above the threshold a text body begins,
where they dive to nothing it ends, and the lines between are kept.

* The threshold is relative to the page (a share of its greatest window), so
  short and long pages behave alike; a body's own short lines stay in it, since
  a dive needs a whole window without text.
* A line counts a bounded length for the threshold, so one huge block sets none
  that ordinary paragraphs miss.
* Of several bodies the one with most text is kept, by bounded and by whole
  lengths, with every other that reaches a share of it or stands in the same
  element as a kept one. Lines between kept bodies of one container stay too.
* An article that the page names is evidence of where a body begins and ends,
  no filter: articles that a kept body reaches are taken with every line, alone
  if they hold at least as much text as the kept lines outside them. An article
  that no kept body reaches is a card or teaser.

Character references are decoded once. White space inside a block becomes one
space, ends are trimmed, empty blocks give no line, blocks are joined by one
line feed. White space is Unicode's, so information separators (U+001C to U+001F) are
text. Null, empty or markup-only pages give an empty text. Broken markup
(unclosed tags and comments, stray ``<``) never fails: an unclosed element ends
with its parent, an unclosed tag is text if it is no tag name. The cost is
linear in the page, however deep or broken its markup is.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolytics.llm.shared import small_batches

WINDOW = 3
SURGE_SHARE = 0.05
BODY_SHARE = 0.3
# What one line counts at most (code points) where surges are decided.
LINE = 400

# Fixed values of HTML: elements that begin a block of their own.
BLOCKS = frozenset("""
address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure
footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre
section summary table tbody td tfoot th thead title tr ul
""".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements whose content is no markup.
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
# Elements that never hold main text.
ASIDE = frozenset("""
head nav header footer aside menu script style noscript iframe template textarea select button svg canvas object
video audio dialog title map datalist
""".split())
# Elements that hold blocks of text, below the page itself.
CONTAINERS = frozenset("article center details div fieldset form main section table td th".split())
# Words that mark a block as no main text if its class, id or role has a name of nothing but these
MARKS = frozenset("""
ad ads adv advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs comment comments
commentlist complementary consent contentinfo cookie cookies copyright disqus footer form gdpr header masthead menu
modal nav navbar navigation navigationbar newsletter notice notices pagination pager popup promo promoted related
replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget
widgets
""".split())
# and of these, which say where or how.
PLACES = frozenset("""
area articles bar block bottom box buttons column container content desktop fixed floating footnote global group
icons inline inner item items left link links list main media mobile overlay page panel policy post posts primary
reader readers right secondary section site slot sticky stories sub thread top unit user users web website wrap
wrapper
""".split())
# Elements whose names say nothing of the kind: headings, tables and their parts,
UNMARKED = HEADINGS | frozenset("html body main article table caption thead tbody tfoot tr td th".split())
# and inside an article those that are text of it.
ARTICLE_TEXT = frozenset("p blockquote pre figure figcaption dt dd hgroup a b i em strong code".split())
# What an article has of its own.
ARTICLE_PARTS = frozenset({"header", "masthead"})
# What closes by itself when one of the right begins.
CLOSED_BY = {
    "p": BLOCKS - {"br"}, "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}),
    "tr": frozenset({"tr"}), "td": frozenset({"td", "th", "tr"}), "th": frozenset({"td", "th", "tr"}),
    "option": frozenset({"option", "optgroup"}),
}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|"
    r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*'|[\"'])*)(?:>|(?=<)|$)", re.S)
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
# Unicode's white space.
_SPACES = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
_PARTS = re.compile(r"[^a-z]+")


def _marked(name: str, attributes: str, article: bool) -> bool:
    """Whether an element says that it holds no main text."""
    if name in ASIDE:
        return True
    if not attributes:
        return False
    if name not in ("html", "body", "main") and _HIDDEN.search(attributes):
        return True
    if name in UNMARKED or article and name in ARTICLE_TEXT:
        return False
    for values in _NAMES.finditer(attributes):
        value = next(v for v in values.groups() if v is not None)
        for whole in _SPACES.split(value):
            words = [w for w in _PARTS.split(_CAMEL.sub("-", whole).lower()) if w]
            marks = MARKS.intersection(words)
            if article:
                marks -= ARTICLE_PARTS
            if name == "form":  # whether a form is the page is said by its text
                marks -= {"form"}
            if marks and all(w in MARKS or w in PLACES for w in words):
                return True
    return False


def lines(page: str) -> tuple[list[tuple[str, int, bool, int]], list[int]]:
    """(text, outermost article or 0, heading, container) of each block that may
    hold main text, and the container around each container; 0 is the page."""
    found: list[tuple[str, int, bool, int]] = []
    forms: list[int] = []  # the form around each line, or 0
    outer_of = [0]
    held: list[str] = []
    # element, no main text (None: headings only), outermost article, container, form
    open_: list[tuple[str, bool | None, int, int, int]] = []
    times: Counter[str] = Counter()  # open elements by name

    def flush() -> None:
        if held:
            text = _SPACES.sub(" ", "".join(held)).strip(" ")
            if text:
                heading = any(x[0] in HEADINGS for x in open_[-3:])
                _, _, article, container, form = open_[-1] if open_ else ("", False, 0, 0, 0)
                found.append((text, article, heading, container))
                forms.append(form)
            held.clear()

    def text(part: str) -> None:
        if part and (not open_ or open_[-1][1] is False):
            held.append(html.unescape(part))

    at = 0
    while True:
        tag = _TOKEN.search(page, at)
        if tag is None:
            text(page[at:])
            break
        text(page[at:tag.start()])
        at = tag.end()
        name = (tag.group(2) or "").lower()
        if not name:
            continue
        if name in BLOCKS:
            flush()
        if tag.group(1):
            if times[name]:
                while open_:
                    if open_[-1][0] in BLOCKS:
                        flush()
                    ended = open_.pop()[0]
                    times[ended] -= 1
                    if ended == name:
                        break
            continue
        while open_ and name in CLOSED_BY.get(open_[-1][0], ()):
            flush()
            times[open_.pop()[0]] -= 1
        attributes = tag.group(3) or ""
        if name in VOID or attributes.endswith("/") and name in ("svg", "path"):
            continue
        outer = open_[-1] if open_ else ("", False, 0, 0, 0)
        aside = outer[1]
        if name == "header" and outer[2] and aside is False:
            aside = None  # an article's header: its headings belong to the text
        elif not aside and _marked(name, attributes, bool(outer[2])):
            aside = True
        elif aside is None and name in HEADINGS:
            aside = False
        container, form = outer[3], outer[4]
        if name in CONTAINERS:
            outer_of.append(container)
            container = len(outer_of) - 1
            if name == "form":
                form = form or container
        article = outer[2] or (container if name == "article" else 0)
        open_.append((name, aside, article, container, form))
        times[name] += 1
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            inner, at = (page[at:end.start()], end.end()) if end else (page[at:], len(page))
            text(inner)
            times[open_.pop()[0]] -= 1
    flush()
    # A form is no main text, unless it is the page.
    held_by: dict[int, int] = {}
    for line, form in zip(found, forms, strict=True):
        held_by[form] = held_by.get(form, 0) + len(line[0])
    total = sum(held_by.values())
    good = {form for form, size in held_by.items() if not form or 2 * size > total}
    return [line for line, form in zip(found, forms, strict=True) if form in good], outer_of


def _bodies(sizes: np.ndarray, window: int, surge: float) -> list[tuple[int, int]]:
    """(first, last) line of each run between a surge and a dive of the window sums."""
    n = len(sizes)
    padded = np.concatenate([np.zeros(window - 1), sizes, np.zeros(window - 1)])
    sums = np.convolve(padded, np.ones(window), "valid")  # sums[i] ends at line i
    high = (sums >= surge * sums.max()) & (sums > 0)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], high, [False]]).astype(np.int8)))
    # A surge at `first` is text in that line; a dive after `last` ended a window before.
    return [(min(first, n - 1), min(last - 1, n - 1)) for first, last in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]


def _around(one: int, other: int, outer_of: list[int]) -> int:
    """Least container around both; a container's number is above that of the one around it."""
    while one != other:
        if one > other:
            one = outer_of[one]
        else:
            other = outer_of[other]
    return one


def body_lines(
    sizes: np.ndarray, places: list[int], outer_of: list[int],
    window: int = WINDOW, surge: float = SURGE_SHARE, share: float = BODY_SHARE,
) -> np.ndarray:
    """Which lines belong to the bodies with most text.

    ``sizes`` are the text lengths of the lines, ``places`` their containers.
    """
    keep = np.zeros(len(sizes), bool)
    if not len(sizes) or not sizes.sum():
        return keep
    bounded = np.minimum(sizes, LINE)
    bodies = _bodies(bounded, window, surge)
    whole = [sizes[start:end + 1].sum() for start, end in bodies]
    level = [bounded[start:end + 1].sum() for start, end in bodies]
    # The container of a body is that of its longest line.
    homes = [places[start + int(sizes[start:end + 1].argmax())] for start, end in bodies]
    good = [w >= share * max(whole) or v >= share * max(level) for w, v in zip(whole, level, strict=True)]
    kept_homes = {home for home, is_good in zip(homes, good, strict=True) if is_good}
    kept = [body for body, home in zip(bodies, homes, strict=True) if home in kept_homes]
    at = [home for home in homes if home in kept_homes]
    for turn, (start, end) in enumerate(kept):
        # The window that surged began before: its lines of the same container are the body's title and lead.
        for before in range(start - 1, max(start - window, -1), -1):
            if places[before] != at[turn]:
                break
            start = before
        keep[start:end + 1] = True
        if turn and (_around(at[turn - 1], at[turn], outer_of) or at[turn - 1] == at[turn]):
            keep[kept[turn - 1][1]:start] = True
    return keep


def main_text(page: str | None) -> str:
    found, outer_of = lines(page or "")
    texts = [line[0] for line in found]
    sizes = np.array([len(t) for t in texts], np.int64)
    articles = np.array([line[1] for line in found], np.int64)
    kept = body_lines(sizes, [line[3] for line in found], outer_of)
    # Articles that a kept body reaches are whole.
    whole = np.isin(articles, articles[kept & (articles > 0)])
    if whole.any() and sizes[whole].sum() >= sizes[kept & ~whole].sum():
        kept = whole
    for at in range(len(found) - 1, 0, -1):  # a body's headings stand right before it
        kept[at - 1] |= kept[at] & found[at - 1][2]
    return "\n".join(t for t, good in zip(texts, kept, strict=True) if good)


def extract(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` (code points) per row of ``pages``."""
    small_batches(pages.sparkSession)

    def strip(batches):
        for batch in batches:
            texts = [main_text(page) for page in batch.column(2).to_pylist()]
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    rows = pages.select(
        F.col("`page_id`").cast("long").alias("page_id"), F.col("`url`").cast("string").alias("url"),
        F.col(f"`{html_column}`").cast("string").alias("html"))
    return rows.mapInArrow(strip, "page_id long, url string, text string, n_chars long")
