"""Main text of web pages by line-block distribution."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Comments, declarations, tags (quoted attribute values may hold '>').
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>", re.DOTALL
)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Elements whose content is no text of the page.
_RAW = frozenset("script style noscript template svg math iframe object canvas audio video textarea select title".split())
#: Those of them that take everything up to their own closing tag as text.
_SWALLOW = frozenset("script style textarea title iframe".split())
_HEADINGS = frozenset(("h1", "h2"))
#: A line that begins so tells who owns the page.
_LEGAL = re.compile(r"(?:©|(?:\(c\)|copyright)\s+(?:©|\(c\)|\d))", re.IGNORECASE)
#: Elements that hold no main text by their meaning.
_BOILER = frozenset("head nav header footer aside form button menu dialog fieldset label".split())
#: What may stand in a head; anything else ends it.
_HEAD = frozenset("base link meta title style script noscript template".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements inside a line; every other one begins and ends a block.
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr img".split()
)
#: Words in class, id and role that name surroundings of the main text.
_NAMES = re.compile(
    r"(?:^|[-_\s])(?:teasers?|nav|navbar|navigation|menu|breadcrumbs?|header|masthead|banner|footer|sidebar|side|widget|ads?|advert|"
    r"advertisement|adsense|sponsor(?:ed)?|promo|cookies?|consent|notice|popup|modal|newsletter|subscribe|signup|login|"
    r"comments?|comment-?list|disqus|replies|respond|share|sharing|social|related|recommended|pagination|pager|toolbar|"
    r"search|complementary|contentinfo)(?:$|[-_\s\d])", re.IGNORECASE
)
#: The same for an article or main element: only whole words that name it, since its classes
#: also tell what it has or allows ("has-sidebar", "comments-open").
_PIECES = re.compile(
    r"(?:^|\s)(?:(?:article|block|c|card|entry|item|list|news|post|story|user)[-_]+)*(?:teasers?|comments?|repl(?:y|ies)|related|"
    r"recommended|promo|sponsor(?:ed)?|ads?|advert|advertisement|widget|newsletter|cookies?|consent|popup|modal|banner|sidebar|"
    r"complementary|contentinfo|navigation|search)(?:[-_]+(?:article|block|body|box|card|content|entry|item|list|post|story|wrap(?:per)?|\d+))*"
    r"(?:--[-\w]+)?(?:\s|$)", re.IGNORECASE
)
_KEEPERS = frozenset(("html", "body"))
#: A closing tag that is missing is implied when one of these opens.
_IMPLIED_END = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
                "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

BOILER, BODY, MAIN = 0, 1, 2


def _named_boiler(attributes: str, names: re.Pattern = _NAMES) -> bool:
    for m in _ATTRIBUTE.finditer(attributes):
        name = m[1].lower()
        value = m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role") and names.search(value):
            return True
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none", value, re.IGNORECASE):
            return True
    return False


def lines_of(page: str) -> list[tuple[str, int, int, bool]]:
    """Markup stripped: one (text, letters outside links, place, heading) per non-empty block.

    ``place`` says whether the block stands in the page's surroundings (BOILER), in its
    body, or inside an article or main element; ``heading`` whether in an h1 or h2.  An
    element that is never closed ends with its parent; only script, style, textarea, title
    and iframe take the rest of the page.  Time is linear in the page, however deep it nests.
    """
    out: list[tuple[str, int, int, bool]] = []
    opened: Counter[str] = Counter()
    endless: set[str] = set()  # elements without a closing tag from here on
    stack: list[tuple[str, int]] = [("", BODY)]  # open elements and the place inside them
    parts: list[str] = []
    links = open_links = 0

    def flush() -> None:
        nonlocal links
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((text, max(len(text) - links, 0), stack[-1][1], any(opened[h] for h in _HEADINGS)))
            parts.clear()
        links = 0

    def leave() -> None:
        opened[stack.pop()[0]] -= 1

    def word(raw: str) -> None:
        nonlocal links
        parts.append(raw)
        if open_links:
            links += len(" ".join(raw.split()))

    at = 0
    while m := _MARKUP.search(page, at):
        if m.start() > at:
            word(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag not in _INLINE:
                flush()
            if opened[tag]:
                while stack[-1][0] != tag:
                    leave()
                leave()
            if tag == "a":
                open_links = max(0, open_links - 1)
            continue
        if tag not in _INLINE:
            flush()
            open_links = 0
        if tag in _VOID:
            continue
        if tag in _RAW:
            if m[3].rstrip().endswith("/"):
                continue
            closing = None if tag in endless else re.compile(rf"</{tag}(?:[\s/][^>]*)?>", re.IGNORECASE).search(page, at)
            if closing or tag in _SWALLOW:
                at = closing.end() if closing else len(page)
            else:
                endless.add(tag)
                stack.append((tag, BOILER))
                opened[tag] += 1
            continue
        if stack[-1][0] == "head" and tag not in _HEAD:
            leave()
        while len(stack) > 1 and stack[-1][0] in _IMPLIED_END.get(tag, ()):
            leave()
        place = stack[-1][1]
        if tag in ("article", "main") and place != BOILER:
            place = BOILER if m[3] and _named_boiler(m[3], _PIECES) else MAIN
        elif tag in _BOILER and not (tag == "header" and place == MAIN):
            place = BOILER
        elif tag not in _KEEPERS and m[3] and _named_boiler(m[3]):
            place = BOILER
        if tag == "a":
            open_links += 1
        stack.append((tag, place))
        opened[tag] += 1
    if at < len(page):
        word(page[at:])
    flush()
    return out


def block_sums(lengths: np.ndarray, window: int) -> np.ndarray:
    """Text in the ``window`` lines from each line on."""
    total = np.concatenate([[0], np.cumsum(lengths), np.full(window, lengths.sum())])
    return total[window : window + len(lengths)] - total[: len(lengths)]


def main_text(page: str | None, window: int = 3, surge: int = 86) -> str:
    """The page's main text, blocks joined by one line feed.

    The text begins where the sum over a sliding window of lines surges past ``surge``
    letters outside links and ends where the sums dive to 0.  Text may surge again, after an
    insert or a list of links: everything from the first surge to the last dive is kept,
    without the lines of the surroundings and the owner's line, which have length 0.  The text
    opens with the heading next to its first surge; what stands before it (the site's name, a
    notice) is left out.  A line inside an article or main element weighs more, with its
    links and by ``surge`` letters, so it surges by itself; lines elsewhere are measured all
    the same.  A page where nothing surges is short: all outside its surroundings is its text.
    """
    if not page:
        return ""
    lines = lines_of(page)
    inside = np.array([place == MAIN or place != BOILER and not _LEGAL.match(t) for t, _, place, _ in lines], dtype=bool)
    if not inside.any():
        return ""
    lengths = np.array([len(t) + surge if place == MAIN else n for t, n, place, _ in lines]) * inside
    sums = block_sums(lengths, window)
    ranges, at = [], 0
    while at < len(sums):
        if sums[at] > surge:
            dive = at
            while dive < len(sums) and sums[dive] > 0:
                dive += 1
            ranges.append((at, dive))
            at = dive
        at += 1
    if not ranges:  # a short page: nothing surges, everything outside the surroundings is its text
        ranges = [(0, len(lines))]
    # Every stretch past the surge is body: what lies between the first and the last belongs to it.
    begin, end = ranges[0][0], ranges[-1][1]
    while begin < end - 1 and not lengths[begin]:
        begin += 1
    # The text opens with its heading: short lines before it, a notice or the site's name, do
    # not belong to it.  Without a heading it opens where it surges.
    first = begin
    while first < end - 1 and lengths[first] <= surge:
        first += 1
    near = first + 2 if lengths[first] <= 2 * surge else first + 1  # a notice may be long enough to surge
    heads = [i for i in range(max(0, first - 2 * window), min(near, end)) if lines[i][3] and inside[i] and lines[i][2] != MAIN]
    if heads and lines[first][2] != MAIN:
        begin = heads[0]
    while begin and inside[begin - 1] and lines[begin - 1][2] == MAIN:
        begin -= 1
    return "\n".join(t for (t, _, _, _), kept in zip(lines[begin:end], inside[begin:end], strict=True) if kept)


def extract(pages: DataFrame) -> DataFrame:
    """Main text of every row of ``pages`` (``page_id``, ``url``, ``html``).

    Returns ``page_id``, ``url``, ``text``, ``n_chars`` (code points), one row per input row.
    A null or empty page, or one without main text, gives the empty text; rows that repeat
    give equal texts; other columns are ignored; an empty table gives no rows.
    """

    @F.pandas_udf("string")
    def text_of(pages_html: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in pages_html:
            yield pd.Series([main_text(x) for x in part], dtype="object")

    out = pages.select("page_id", "url", text_of("html").alias("text"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
