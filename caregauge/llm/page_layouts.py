"""Pages laid out anew around given text, with known labels, to learn from."""

from __future__ import annotations

import html
import random

# Words for made-up text, link texts, and names that sites use.
WORDS = "river market letter winter garden system people report season answer village music paper number science".split()
LINKS = ["Home", "News", "About", "Contact", "Sport", "Archive", "Next", "Previous", "Login", "Privacy", "Terms", "Help", "Culture"]
MAIN_NAMES = ["content", "post", "entry-content", "article-body", "main", "story", "post-content", "mainText", ""]
MENU_NAMES = ["menu", "navbar", "nav main-nav", "breadcrumbs", "navigation", "topMenu"]
HEADER_NAMES = ["header", "masthead", "site-header", "topbar"]
FOOTER_NAMES = ["footer", "site-footer", "copyright", "legal"]
SIDE_NAMES = ["sidebar", "widget", "related-posts", "side", "recommended", "share-links", "tags"]
AD_NAMES = ["ad", "ads", "advert", "ad-slot", "sponsored", "promo", "banner-ad"]
NOTICE_NAMES = ["cookie-notice", "cookies", "notice", "newsletter", "consent-banner", "alert", "popup", "subscribe"]
COMMENT_NAMES = ["comments", "comment-list", "discussion", "replies", "disqus_thread", "respond"]


def made_up(pages: int, seed: int) -> list[list[str]]:
    """Blocks of text for pages where none are given."""
    r = random.Random(seed)

    def sentence() -> str:
        return " ".join(r.choice(WORDS) for _ in range(r.randint(3, 14))).capitalize() + r.choice([".", ".", ".", "?", "!"])

    def block() -> str:
        return " ".join(sentence() for _ in range(r.randint(1, 6)))

    return [[sentence()] + [block() for _ in range(r.randint(1, 12))] for _ in range(pages)]


def layout(r: random.Random, blocks: list[str], others: list[list[str]], rest: list[list[str]]) -> str:
    """A page with ``blocks`` as its main text, marked by ``data-main``; text for what stands
    around it comes from ``others`` (main text of other pages) and ``rest`` (text around theirs)."""

    def some(n: int) -> list[str]:
        page = r.choice(others)
        begin = r.randrange(max(1, len(page) - n + 1))
        return page[begin : begin + n]

    def short() -> str:
        page = r.choice(rest)
        return r.choice(page) if page and r.random() < 0.5 else " ".join(r.choice(some(1)).split()[: r.randint(2, 25)])

    def tag(name: str, inside: str, words: str = "", mark: str = "", close: bool = True) -> str:
        key = "id" if r.random() < 0.25 else "class"
        shown = f' {key}="{words}"' if words else ""
        return f"<{name}{shown}{mark}>{inside}" + (f"</{name}>" if close else "")

    def paragraph(text: str, escaped: bool = True) -> str:
        return tag("p", html.escape(text) if escaped else text, close=r.random() < 0.9)

    def link(text: str) -> str:
        return f'<a href="/x">{html.escape(text)}</a>'

    def links(n: int) -> str:
        page = some(n)
        names = [r.choice(LINKS) if r.random() < 0.5 else " ".join(r.choice(page or LINKS).split()[: r.randint(1, 3)]) for _ in range(n)]
        if r.random() < 0.7:
            return tag("ul", "".join(tag("li", link(n), close=r.random() < 0.8) for n in names))
        return r.choice([" | ", " ", " &middot; "]).join(link(n) for n in names)

    def div_or(name: str) -> str:
        return name if r.random() < 0.5 else "div"

    def menu() -> str:
        name = div_or("nav")
        return tag(name, links(r.randint(2, 9)), r.choice(MENU_NAMES) if name == "div" or r.random() < 0.3 else "")

    def header() -> str:
        name = div_or("header")
        inside = tag(r.choice(["h1", "p", "div"]), html.escape(short())) + (menu() if r.random() < 0.5 else "")
        return tag(name, inside, r.choice(HEADER_NAMES) if name == "div" or r.random() < 0.3 else "")

    def footer() -> str:
        name = div_or("footer")
        inside = r.choice(["", "&copy; 2024 ", "&copy; "]) + html.escape(short()) + (links(3) if r.random() < 0.4 else "")
        return tag(name, paragraph(inside, False) if r.random() < 0.4 else inside, r.choice(FOOTER_NAMES) if name == "div" or r.random() < 0.3 else "")

    def boxed(names: list[str], inside: str, name: str = "div") -> str:
        return tag(name, inside, r.choice(names))

    def side() -> str:
        inside = tag("h3", html.escape(short())) + (links(r.randint(2, 6)) if r.random() < 0.7 else "".join(map(paragraph, some(2))))
        return tag("aside", inside) if r.random() < 0.5 else boxed(SIDE_NAMES, inside)

    def advert() -> str:
        text = html.escape(short())
        return boxed(AD_NAMES, paragraph(text, False) if r.random() < 0.5 else link(text) if r.random() < 0.3 else text, r.choice(["div", "div", "section", "aside"]))

    def notice() -> str:
        text = paragraph(short()) if r.random() < 0.6 else html.escape(short())
        return boxed(NOTICE_NAMES, text + r.choice(["", "<button>OK</button>"]), r.choice(["div", "div", "section", "dialog", "aside"]))

    def form() -> str:
        inside = r.choice(["<label>Search</label>", paragraph(short()), html.escape(short())]) + "<input name=q><button>Go</button>"
        return tag("form", inside, r.choice(["", "search", "login-form"]))

    def comments() -> str:
        each = [tag(r.choice(["li", "div", "article"]), html.escape(short()) + paragraph(t), r.choice(["comment", "reply", "comment-body"])) for t in some(r.randint(1, 4))]
        name = r.choice(["section", "div"])
        inside = tag("h3", "Comments") + (tag("ol", "".join(each)) if r.random() < 0.4 else "".join(each))
        return boxed(COMMENT_NAMES, inside + (form() if r.random() < 0.4 else ""), name)

    if r.random() < 0.25:  # a short one
        blocks = [" ".join(t.split()[: r.randint(1, 12)]) for t in blocks[: r.randint(1, 2)]]

    def main() -> str:
        parts = []
        for k, text in enumerate(blocks):
            shown = html.escape(text)
            if r.random() < 0.1:
                words = text.split()
                cut = r.randrange(len(words))
                shown = " ".join(map(html.escape, words[:cut])) + " " + link(" ".join(words[cut : cut + 3])) + " " + " ".join(map(html.escape, words[cut + 3 :]))
            if k == 0 and r.random() < 0.8:
                parts.append(tag(r.choice(["h1", "h1", "h2"]), shown))
            else:
                kind = r.random()
                if kind < 0.75:
                    parts.append(tag("p", shown, close=r.random() < 0.9))
                elif kind < 0.8:
                    parts.append(tag("blockquote", tag("p", shown)))
                elif kind < 0.86:
                    parts.append(tag("ul", tag("li", shown) + "".join(tag("li", html.escape(w)) for w in text.split()[:3])))
                elif kind < 0.9:
                    parts.append(tag("h2", " ".join(shown.split()[:6])) + tag("p", shown))
                elif kind < 0.93:
                    parts.append(tag("table", tag("tr", tag("td", shown) + tag("td", html.escape(text.split()[0])))))
                elif kind < 0.96:
                    parts.append(tag("figure", "<img src=x>" + tag("figcaption", shown)))
                else:
                    parts.append(tag("div", shown))
        apart = [f() for f in (advert, side, notice, form, lambda: tag("nav", links(3))) if r.random() < 0.15]
        for piece in apart:  # what stands within the main text without being part of it
            parts.insert(r.randint(0, len(parts)), f'<div data-main="0">{piece}</div>' if r.random() < 0.3 else piece.replace(">", ' data-main="0">', 1))
        inside = "".join(parts)
        name = r.choice(["article", "article", "main", "div", "div", "section"])
        whole = tag(name, inside, r.choice(MAIN_NAMES) if name in ("div", "section") or r.random() < 0.3 else "", ' data-main="1"')
        for _ in range(r.choice([0, 0, 1, 2])):
            whole = tag(r.choice(["div", "div", "main", "section"]), whole + (side() if r.random() < 0.2 else ""), r.choice(["", "wrapper", "content", "container", "row"]))
        return whole

    before = [f() for f, p in ((notice, 0.25), (header, 0.5), (menu, 0.6), (form, 0.15), (advert, 0.4), (side, 0.15)) if r.random() < p]
    after = [f() for f, p in ((side, 0.35), (comments, 0.4), (advert, 0.3), (notice, 0.15), (form, 0.15), (menu, 0.15), (footer, 0.8)) if r.random() < p]
    r.shuffle(before)
    page = "".join(before) + main() + "".join(after)
    if r.random() < 0.03:
        page = tag("form", page)
    return f"<!DOCTYPE html><html><head><title>{html.escape(blocks[0] if blocks else '')}</title></head><body>{page}</body></html>"
