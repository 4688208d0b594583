"""Block trees of web pages, read in one pass over markup of any quality."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

# Elements by what they mean for text. Elements not named here are inline.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup p pre search section summary table"
    " caption colgroup tbody thead tfoot tr td th ul".split()
)
#: A paragraph ends where one of these begins.
ENDS_PARAGRAPH = BLOCKS - frozenset("body caption colgroup html legend optgroup tbody thead tfoot tr td th".split())
#: Their content is text up to their own end tag, and never shown as text of the page.
RAW = frozenset("iframe noembed noframes noscript script style textarea title".split())
#: Marked-up content that is not text of the page.
DROPPED = frozenset("audio button canvas datalist map math meter object progress select svg template video".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: End tags do not reach beyond these.
BORDERS = frozenset("button caption object table td template th".split())
#: An element of the key ends an open one of the values, back to the nearest element of the last set.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dd": (("dd", "dt"), ("dl",)),
    "dt": (("dd", "dt"), ("dl",)),
    "td": (("td", "th", "caption"), ("table",)),
    "th": (("td", "th", "caption"), ("table",)),
    "tr": (("tr", "caption"), ("table",)),
    "tbody": (("tbody", "thead", "tfoot", "caption"), ("table",)),
    "thead": (("tbody", "thead", "tfoot", "caption"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot", "caption"), ("table",)),
}
#: Outside of the body, and without meaning for blocks.
IGNORED = frozenset("html head body".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""[\s/]*+(?:(=?[^\s/>=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|(?!["'])[^\s>]*+))?+)""")
_UNENDED = re.compile(r"""\s*+=\s*+["']""")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Page:
    """Nodes in page order: block elements that hold text, and runs of text (tag ``#text``).

    A node's descendants are those up to ``stops``; ``words`` are names out of class, id and role.
    """

    tags: list[str] = field(default_factory=list)
    words: list[str] = field(default_factory=list)
    marks: list[str | None] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    depths: list[int] = field(default_factory=list)
    stops: list[int] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)

    def add(self, tag: str, words: str, mark: str | None, parent: int, text: str = "", linked: int = 0) -> int:
        self.tags.append(tag)
        self.words.append(words)
        self.marks.append(mark)
        self.parents.append(parent)
        self.depths.append(self.depths[parent] + 1 if parent >= 0 else 0)
        self.stops.append(len(self.tags))
        self.texts.append(text)
        self.linked.append(linked)
        return len(self.tags) - 1


class _Open:
    __slots__ = ("dropped", "mark", "node", "tag", "words")

    def __init__(self, tag: str, words: str, mark: str | None, dropped: bool):
        self.tag, self.words, self.mark, self.dropped, self.node = tag, words, mark, dropped, -1


class _Builder:
    """Open elements, by name too, so that a look for one costs the same at any depth."""

    def __init__(self) -> None:
        self.page = Page()
        self.stack: list[_Open] = [_Open("body", "", None, False)]
        self.places: dict[str, list[int]] = {}
        self.borders: list[int] = [0]
        self.dropping = 0
        self.run: list[str] = []
        self.in_link: list[str] = []
        self.link_at = -1

    def last(self, names: tuple[str, ...]) -> int:
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=-1)

    def flush(self) -> None:
        """The run of text so far becomes a node, and so do open elements above it."""
        if not self.run:
            return
        text = " ".join("".join(self.run).split())
        linked = len("".join("".join(self.in_link).split()))
        self.run, self.in_link = [], []
        if not text or self.dropping:
            return
        above = len(self.stack)
        while above and self.stack[above - 1].node < 0:
            above -= 1
        parent = self.stack[above - 1].node if above else -1
        for element in self.stack[above:]:
            parent = element.node = self.page.add(element.tag, element.words, element.mark, parent)
        self.page.add("#text", "", None, parent, text, linked)

    def text(self, text: str) -> None:
        if text and not self.dropping:
            self.run.append(text)
            if self.link_at >= 0:
                self.in_link.append(text)

    def close_to(self, place: int) -> None:
        """Ends the element at a place of the stack and all within it."""
        self.flush()
        while len(self.stack) > place:
            element = self.stack.pop()
            if element.node >= 0:
                self.page.stops[element.node] = len(self.page.tags)
            self.dropping -= element.dropped
            self.places[element.tag].pop()
            if element.tag in BORDERS:
                self.borders.pop()
        if self.link_at >= place:
            self.link_at = -1

    def open(self, tag: str, words: str, mark: str | None, dropped: bool) -> None:
        self.flush()
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in BORDERS:
            self.borders.append(len(self.stack))
        self.stack.append(_Open(tag, words, mark, dropped))
        self.dropping += dropped

    def start(self, tag: str, attributes: dict[str, str], closed: bool) -> None:
        if tag == "br":
            self.text(" ")
            return
        if tag == "a":
            self.link_at = len(self.stack) if "href" in attributes else -1
            return
        if tag in DROPPED:
            if not closed:
                self.open(tag, "", None, True)
            return
        if tag not in BLOCKS or tag in IGNORED:
            return
        if tag in ENDS_PARAGRAPH:
            paragraph = self.places.get("p")
            if paragraph and paragraph[-1] > self.borders[-1]:
                self.close_to(paragraph[-1])
        if tag in HEADINGS and self.stack[-1].tag in HEADINGS:
            self.close_to(len(self.stack) - 1)
        if tag in ENDS:
            ended, within = ENDS[tag]
            place = min((p for n in ended if (p := self.last((n,))) > self.last(within)), default=-1)
            if place > 0:
                self.close_to(place)
        if tag == "hr":
            self.flush()
            return
        words = " ".join(attributes.get(k, "") for k in ("class", "id", "role"))
        hidden = "hidden" in attributes or bool(_HIDDEN.search(attributes.get("style", "")))
        self.open(tag, words, attributes.get("data-main"), hidden)

    def end(self, tag: str) -> None:
        if tag == "a":
            self.link_at = -1
        elif tag == "br":
            self.text(" ")
        elif tag in BLOCKS or tag in DROPPED:
            place = self.last(tuple(HEADINGS)) if tag in HEADINGS else self.last((tag,))
            if place > 0 and (place >= self.borders[-1] or tag in BORDERS or tag in ("tr", "tbody", "thead", "tfoot")):
                self.close_to(place)


def _attributes(markup: str, at: int) -> tuple[dict[str, str], bool, int]:
    """Attributes from behind a tag's name, whether it closes itself, and the place behind it; -1 if
    the page ends within the tag."""
    found: dict[str, str] = {}
    if markup.startswith(">", at):
        return found, False, at + 1
    while True:
        match = _ATTRIBUTE.match(markup, at)
        if not match:
            close = markup.find(">", at)
            return found, close > 0 and markup[close - 1] == "/", close + 1 if close >= 0 else -1
        at = match.end()
        name, value = match.group(1).lower(), match.group(2)
        if value is None and _UNENDED.match(markup, at):
            return found, False, -1
        if value is not None and value[:1] in ('"', "'"):
            value = value[1:-1]
        if name not in found:
            found[name] = html.unescape(value or "")


def parse(markup: str) -> Page:
    """The block tree of a page, in time linear in its length.

    Elements end where the rules of the markup let them; end tags without a start are passed
    over; comments, scripts, styles, form controls, hidden elements and what else is no text of the page
    are left out. White space of a run is one space each, character references are decoded.
    A page that ends within a tag or comment loses that tag or comment.
    """
    builder = _Builder()
    at, size = 0, len(markup)
    while at < size:
        tag = markup.find("<", at)
        if tag < 0:
            tag = size
        if tag > at:
            piece = markup[at:tag]
            builder.text(html.unescape(piece) if "&" in piece else piece)
        if tag + 1 >= size:
            if tag < size:
                builder.text("<")
            break
        mark = markup[tag + 1]
        if mark == "!" or mark == "?":
            if markup.startswith("<!--", tag):
                short = 5 if markup.startswith("<!-->", tag) else 6 if markup.startswith("<!--->", tag) else 0
                close = tag + short if short else markup.find("-->", tag + 4) + 3
                at = close if close > tag else size
            else:
                at = markup.find(">", tag) + 1 or size
            continue
        name = _NAME.match(markup, tag + 1 + (mark == "/"))
        if not name:
            if mark == "/":
                at = markup.find(">", tag) + 1 or size
            else:
                builder.text("<")
                at = tag + 1
            continue
        word = name.group().lower()
        attributes, closed, at = _attributes(markup, name.end())
        if at < 0:
            break
        if mark == "/":
            builder.end(word)
        elif word in RAW:
            close = _RAW_END[word].search(markup, at)
            at = close.start() if close else size
        else:
            builder.start(word, attributes, closed)
    builder.close_to(1)
    builder.flush()
    if builder.stack[0].node >= 0:
        builder.page.stops[builder.stack[0].node] = len(builder.page.tags)
    return builder.page
