"""Main text of HTML pages by line-block distribution.

Markup is stripped into lines, one per block element. Script, style and other raw
elements disappear; lines of menus, headers, footers, sidebars, notices, adverts,
forms and reader comments count as empty. Text lengths, without those of links, are
summed over windows of WINDOW lines. A
block ends where the sum dives to nothing: at WINDOW lines or more without text
outside links, for which the edges of the page, listed elements, the bounds of
holders and the step from a container of several lines to the next container also
stand. A block is main text, whole, if the sum surges to the threshold in it.

Article and main elements, and those whose class, id or role says so, are holders:
an aid, not a verdict. Inside one only link lists make the sum dive, and the
threshold is at most half of a largest sum, that of the element itself for article
and main and that of the page's densest holder for a class name, so a short article
is main text; outside, on a page with a holder, text has to be as dense as half of
the largest sum in a holder too.

What a class or id says is held against the element's text. A clear name (``ad``,
``main-menu``, ``post-share``) makes boilerplate unless the element has most of the
page's text; a doubtful one (``cookies-recipe``, ``social``, ``sidebar-layout``) only where links
outweigh the rest or the text is short; headings, paragraphs and cells are asked
for clear classes alone. A form with most of the page's text is a container. Names
that tell a state (``has-sidebar``) and headers of content (``entry-header``) say nothing.

Edge cases: null and empty pages, and pages without text, give an empty text.
Unclosed elements end with what holds them; unclosed boilerplate also ends where an
article begins, closed boilerplate keeps the articles in it. A link without an end tag ends
at the next link or block. A notice or a footer line without any element, role or
name that says so is judged by the distribution alone. Repeated rows give repeated
results. Other columns are ignored, whatever their names. Work grows with the
page's length, whatever is left open in it.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonepulse.llm.common import id_type, text_slices

WINDOW = 3
#: Characters outside links in a window that make a block main text.
SURGE = 80

#: Elements whose content is no text of the page.
_RAW = frozenset("script style noscript template textarea select button svg iframe object canvas audio video title datalist".split())
_NAMED = re.compile(r"(?i)\b(class|id|role|style|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_HIDDEN = re.compile(r"(?i)(?:^|\s)hidden(?:\s|=|/|$)")
_HREF = re.compile(r"(?i)(?:^|\s)href\s*=")
_PARTS = re.compile(r"[^a-z0-9]+")
_HUMPS = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_NAME = re.compile("/?[A-Za-z][A-Za-z0-9:-]*")
_SIGN = re.compile("[>\"']")
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose end may be left out, and what begins in their place.
_IMPLIED = {"p": _BLOCK, "li": frozenset(["li"]), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "td": frozenset(("td", "th", "tr")), "th": frozenset(("td", "th", "tr")), "tr": frozenset(["tr"])}
_BOILER = frozenset("nav footer aside menu dialog head".split())
_HOLDERS = frozenset(("article", "main"))
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words of class and id names that say boilerplate; those of the second list have other meanings too.
_SAYING = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promoted consent gdpr nav navbar navigation menu menus sidebar sidebars aside footer masthead topbar breadcrumb breadcrumbs"
    " comment comments commentlist disqus sharing related newsletter subscribe signup popup toolbar pagination pager login".split()
)
_AMBIGUOUS = frozenset("promotion banner cookie cookies notice notices alert rail header respond reply replies discussion share social recommended modal overlay widget widgets search skip disclaimer copyright".split())
_WORDS = _SAYING | _AMBIGUOUS
_COMMENTS = frozenset("comment comments commentlist disqus".split())
_CONTENT = frozenset("article content entry post story main body".split())
#: Words beside them that say where or what kind of part, and those of plain layout.
_PLACES = _CONTENT | frozenset("site page top bottom left right upper lower primary secondary global mobile desktop sticky fixed links link list item items box block bar area button buttons icons icon meta form text title heading inner posts articles stories news section body area unit slot 1 2 3 4".split())
_LAYOUT = frozenset("container layout wrapper wrap column columns col row grid outer page".split())
_STATES = frozenset("has have no not is with without show hide hidden".split())
_HEADS = frozenset(("header", "masthead"))
#: Elements that are text themselves: no id and no doubtful class of theirs is asked.
_TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre td th tr tbody table dd dt".split())
#: Class, id or role words that make a plain element hold the article.
_HOLDING = frozenset("content maincontent main article articlebody story storybody post postbody entry".split())
#: Containers: the step from one of several lines to another of them ends a block.
_GROUPS = frozenset("div section td".split())
_LISTS = _GROUPS | frozenset("table ul ol dl".split())
#: An element named as boilerplate is none if it has this share of the page's text, by clear words and by doubtful ones; doubtful words also need links, or few characters.
MOST, SOME, BRIEF = 0.6, 0.3, 500

#: Text, characters outside links, number of its holder (0: none, negative: by class name), boilerplate, behind a step.
Line = tuple[str, int, int, bool, bool]
#: Kind (0 text, 1 start, 2 end), text or name, attributes.
Token = tuple[int, str, str]


@functools.cache
def _raw_end(name: str) -> re.Pattern:
    return re.compile(rf"(?i)</{name}(?=[\s>/])")


def tokens(page: str) -> list[Token]:
    """Texts and tags of a page, without what raw elements and comments hold; no character is looked at more than a few times."""
    out: list[Token] = []
    at, begin, last, quotes = 0, 0, page.rfind(">"), True
    gone: set[str] = set()  # quotes of which there is none further on

    def tag_end(place: int) -> int:
        """Behind the > that ends a tag, or -1; a quote counts where a value begins and is closed somewhere."""
        while m := _SIGN.search(page, place):
            place, sign = m.end(), m[0]
            if sign == ">":
                return place
            k = m.start() - 1
            while page[k].isspace():
                k -= 1
            if quotes and page[k] == "=" and sign not in gone:
                close = page.find(sign, place)
                if close < 0:
                    gone.add(sign)
                else:
                    place = close + 1
        return -1

    while (at := page.find("<", at)) >= 0:
        m = _NAME.match(page, at + 1)
        special = page[at + 1 : at + 2]
        if not m and special not in ("!", "?"):
            at += 1
            continue
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = len(page) if end < 0 else end + 3
        elif page.startswith("<![CDATA[", at):
            end = at + 9
        elif at > last:
            # no tag ends any more: the rest up to the next one is none
            end = page.find("<", at + 1) if m else at + 1
            end = len(page) if end < 0 else end
        elif not m:
            end = page.find(">", at) + 1
        else:
            end = tag_end(m.end())
            if end < 0:
                quotes = False
                end = tag_end(m.end())
        if at > begin:
            out.append((0, page[begin:at], ""))
        if m and at <= last:
            closing, name = m[0][0] == "/", m[0].lstrip("/").lower()
            inside = page[m.end() : end - 1]
            out.append((2 if closing else 1, name, "" if closing else inside))
            if not closing and name in _RAW and not inside.endswith("/"):
                found = _raw_end(name).search(page, end)
                end = found.start() if found else len(page)
        at = begin = end
    if begin < len(page):
        out.append((0, page[begin:], ""))
    return out


class Page:
    """The elements of a page: where each ends, whether by an end tag, and the characters in and outside links before each token."""

    def __init__(self, page: str):
        self.tokens = tokens(page)
        n = len(self.tokens)
        self.ends, self.closed = [n] * n, [False] * n
        self.linked = [False] * n
        self.plain, self.links = [0] * (n + 1), [0] * (n + 1)
        self.article = [n] * (n + 1)  # the next start of an article or main element
        self._close_elements()
        self._count()

    def _close_elements(self) -> None:
        stack: list[tuple[str, int]] = []
        depth: dict[str, int] = {}

        def pop(at: int, by_tag: bool) -> str:
            tag, k = stack.pop()
            depth[tag] -= 1
            self.ends[k], self.closed[k] = at, by_tag or tag in _IMPLIED
            return tag

        for at, (kind, tag, attributes) in enumerate(self.tokens):
            if kind == 1 and tag not in _VOID and not attributes.endswith("/"):
                while stack and tag in _IMPLIED.get(stack[-1][0], ()):
                    pop(at, True)
                stack.append((tag, at))
                depth[tag] = depth.get(tag, 0) + 1
            elif kind == 2 and depth.get(tag):
                while pop(at, stack[-1][0] == tag) != tag:
                    pass
        while stack:
            pop(len(self.tokens), False)

    def _count(self) -> None:
        # a link ends at its end tag; one without, where another or a block begins or ends
        after, unclosed = 0, set()
        for k in range(len(self.tokens) - 1, -1, -1):
            kind, tag, _ = self.tokens[k]
            self.article[k] = k if kind == 1 and tag in _HOLDERS else self.article[k + 1]
            if kind and tag == "a":
                if kind == 1 and after != 2:
                    unclosed.add(k)
                after = kind
        link, loose = False, False
        for k, (kind, tag, attributes) in enumerate(self.tokens):
            if kind and tag == "a":
                link, loose = kind == 1 and bool(_HREF.search(attributes)), k in unclosed
            elif kind and link and loose and tag in _BLOCK:
                link = False
            self.linked[k] = link
            size = len(self.tokens[k][1].strip()) if kind == 0 else 0
            self.plain[k + 1] = self.plain[k] + (0 if link else size)
            self.links[k + 1] = self.links[k] + (size if link else 0)

    def inside(self, at: int) -> tuple[int, int, float]:
        """(characters outside links, in links, share of the page's outside) of an element; one that is never closed ends at the next article."""
        end = self.ends[at] if self.closed[at] else min(self.ends[at], self.article[at + 1])
        plain = self.plain[end] - self.plain[at]
        return plain, self.links[end] - self.links[at], plain / max(1, self.plain[-1])


def _names(attributes: str, ids: bool = True) -> Iterator[list[str]]:
    """The parts of each class or id name: ``main-menu`` and ``mainMenu`` are main, menu."""
    for name, *values in _NAMED.findall(attributes):
        if name.lower() == "class" or ids and name.lower() == "id":
            for token in "".join(values).split():
                parts = [x for x in _PARTS.split(_HUMPS.sub("-", token).lower()) if x]
                if parts and not (len(parts) > 1 and parts[0] in _STATES):
                    yield parts


def _named_boilerplate(parts: list[str]) -> bool:
    found = _WORDS.intersection(parts)
    return bool(found - _HEADS) or bool(found) and not _CONTENT.intersection(parts)


def _says(parts: list[str], holder: bool) -> int:
    """What a name says: 2 boilerplate, 1 perhaps, 0 nothing."""
    found, rest = _WORDS.intersection(parts), set(parts) - _WORDS
    if not found or found <= _HEADS and _CONTENT.intersection(rest):
        return 0
    clear = bool(found & _SAYING) and rest <= _PLACES and not (rest & _LAYOUT)
    return 2 if clear and not (holder and rest) else 1


def boilerplate(page: Page, at: int, holder: bool) -> bool:
    """Whether an element is boilerplate: by its kind, or by a role, class or id that its text does not belie."""
    _, tag, attributes = page.tokens[at]
    if tag in _BOILER or tag == "header" and not holder:
        return True
    if tag in ("html", "body") or tag != "form" and not attributes:
        return False
    if _HIDDEN.search(attributes):
        return True
    roles, textual = [], tag in _TEXTUAL
    for name, *values in _NAMED.findall(attributes):
        value = "".join(values).lower()
        if name.lower() == "style" and "display:none" in value.replace(" ", ""):
            return True
        roles += [value] if name.lower() == "role" else []
    names = list(_names(attributes, ids=not textual))
    says = max([0, *(_says(x, holder) for x in names)])
    comments = any(_COMMENTS.intersection(x) and set(x) - _COMMENTS <= _PLACES for x in names)
    # a name that says content and nothing else outweighs others beside it
    if not comments and (tag in _HOLDERS or any(_HOLDING.issuperset(x) for x in names)):
        says = 0
    if textual and says < 2:
        says = 0
    named = tag == "form" or not _ROLES.isdisjoint(roles)
    if not says and not named:
        return False
    plain, links, share = page.inside(at)
    if comments:
        return share < 0.9
    if says == 2 or named:
        return share < MOST
    return links >= plain or plain <= BRIEF and share <= SOME


def _holds(tag: str, attributes: str) -> bool:
    if tag in _HOLDERS:
        return True
    if tag not in ("div", "section") or not attributes:
        return False
    if any(name.lower() == "role" and "".join(values).lower() in _HOLDERS for name, *values in _NAMED.findall(attributes)):
        return True
    return any(_HOLDING.intersection(x) and not _named_boilerplate(x) for x in _names(attributes))


def lines(text_of_page: str) -> list[Line]:
    """The page's block elements with text."""
    page, out, text, plain = Page(text_of_page), [], [], 0
    skip, loose = -1, False  # where the boilerplate at hand ends, and whether it is never closed
    holders: list[int] = []  # ends of open holders
    groups: list[tuple[str, int]] = []  # open containers: element and lines before it
    left = step = False  # a container of several lines was left, and another entered behind it
    holder, named = 0, False

    def end() -> None:
        nonlocal text, plain, left, step
        if text:
            whole = " ".join(html.unescape("".join(text)).split())
            if whole:
                out.append((whole, min(plain, len(whole)), (-holder if named else holder) if holders else 0, skip >= 0, step))
                left = step = False
        text, plain = [], 0

    for at, (kind, tag, attributes) in enumerate(page.tokens):
        if kind == 0:
            text.append(tag)
            plain += 0 if page.linked[at] else len(tag.strip())
            continue
        closing = kind == 2
        if tag in _BLOCK or at == skip:
            end()
        if at == skip:
            skip = -1
            if closing and tag not in _GROUPS:
                continue
        if tag == "br":
            text.append(" ")
        if closing and tag in _GROUPS and any(g == tag for g, _ in groups):
            while groups:
                group, before = groups.pop()
                if group == tag:
                    left = left or len(out) - before > 1
                    break
        elif not closing and tag in _LISTS:
            step = step or left
            if tag in _GROUPS:
                groups.append((tag, len(out)))
        while holders and holders[-1] <= at:
            holders.pop()
        if skip >= 0:
            if not (loose and not closing and tag in _HOLDERS and not holders):
                continue
            skip = -1
        if closing or tag in _VOID or attributes.endswith("/"):
            continue
        if boilerplate(page, at, bool(holders)):
            end()
            skip, loose = page.ends[at], not page.closed[at]
        elif _holds(tag, attributes):
            if not holders:
                holder, named = holder + 1, tag not in _HOLDERS
            elif tag in _HOLDERS:
                named = False
            holders.append(page.ends[at])
    end()
    return out


def _blocks(rows: list[tuple[str, int] | None], window: int, edge: int) -> Iterator[tuple[int, list[str]]]:
    """(largest window sum, texts) of each stretch between dives; None is an empty line."""
    found: list[tuple[str, int]] = []
    quiet = edge  # lines without text outside links so far; the edge counts for some

    def closed(block: list[tuple[str, int]]) -> tuple[int, list[str]]:
        return max(sum(n for _, n in block[i : i + window]) for i in range(len(block))), [t for t, _ in block if t]

    waiting: list[tuple[str, int]] = []
    for row in [*rows, *[None] * edge]:
        text, n = row or ("", 0)
        if not n:
            quiet += 1
            waiting.append((text, n))
            continue
        if quiet >= window:
            if found:
                yield closed(found)
            found = []
        else:
            found += waiting
        found.append((text, n))
        quiet, waiting = 0, []
    if found:
        yield closed(found if quiet >= window else found + waiting)


def main_text(page: str, window: int = WINDOW, surge: int = SURGE) -> str:
    # stretches inside one holder or outside all, in the page's order
    parts: list[tuple[int, list[tuple[str, int] | None]]] = []
    for text, plain, holder, skipped, step in lines(page):
        if not parts or parts[-1][0] != holder:
            parts.append((holder, []))
        rows = parts[-1][1]
        if skipped:
            rows += [] if holder else [None] * window
        else:
            rows += [None] * window if step and not holder else []
            rows.append((text, plain))
    found: list[tuple[int, list[tuple[int, list[str]]]]] = []
    for holder, rows in parts:
        if holder and not any(n for _, n in rows):
            rows = [(t, len(t)) for t, _ in rows]  # nothing but links: they are its text
        found.append((holder, list(_blocks(rows, window, 0 if holder else window))))
    peaks: dict[int, int] = {}
    for holder, blocks in found:
        peaks[holder] = max([peaks.get(holder, 0), *(peak for peak, _ in blocks)])
    held = max((peak for holder, peak in peaks.items() if holder), default=0)
    out: list[str] = []
    for holder, blocks in found:
        if holder:
            need = min(surge, max(1, (peaks[holder] if holder > 0 else held) // 2))
        else:
            need = max(surge, held // 2) if held else min(surge, max(1, peaks[0] // 2))
        for peak, texts in blocks:
            if peak >= need:
                out += texts
    return "\n".join(out)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Per row: id, text, n_chars (code points)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_slices(batches, "html"):
            found = [main_text(t.decode("utf-8", "replace")) for t in texts]
            carried = rows.columns[:-1]
            yield pa.RecordBatch.from_arrays([*carried, pa.array(found, pa.string()), pa.array(list(map(len, found)), pa.int64())], [*rows.schema.names[:-1], "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast(id_type(pages, id_col)).alias("id"), F.col("url").cast("string").alias("url") if "url" in pages.columns else F.lit(None).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, f"id {id_type(pages, id_col)}, url string, text string, n_chars long")
