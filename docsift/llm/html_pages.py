"""HTML leaf blocks, and labelled pages to learn from.

``blocks`` splits a page into leaf blocks: runs of text not interrupted by the start or end of a block element,
with the elements above them.  ``labelled_pages`` writes pages of many layouts in invented words, each block marked
as main text or not.
"""

from __future__ import annotations

import functools
import html
import random
import re

#: Fixed values of the HTML standard: elements that break lines, whose content is no text, that have no end tag.
BLOCK = set("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption "
            "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol option p pre "
            "section select summary table tbody td tfoot th thead tr ul".split())
SILENT = set("script style template iframe textarea head title".split())
RAW = set("script style textarea title iframe".split())
#: Elements in which a tag may end itself.
FOREIGN = {"svg", "math"}
VOID = set("area base br col embed hr img input link meta source track wbr".split())
#: An open element of the key is ended by the start of these.
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr"},
            "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']*(?:\"[^\"]*\"|'[^']*'))*[^>\"']*)(?:>|$)|[^<]+|<",
                    re.S)
_NAMES = re.compile(r"(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[a-z]+")


@functools.lru_cache(maxsize=10_000)
def _marks(tag: str, attributes: str) -> tuple[str, ...]:
    names = {p for m in _NAMES.finditer(attributes) for p in _PART.findall((m[1] or m[2] or m[3] or "").lower())}
    return ("t:" + tag, *sorted("c:" + n for n in names))


def blocks(page: str) -> list[tuple[str, tuple[str, ...], str, int]]:
    """(text, marks of all elements above, innermost block element, characters inside links) of every leaf block.

    Character references are decoded, white space runs are one space, blocks without text are left out.  Missing end
    tags end with their parent or where the standard implies it; stray end tags are ignored.
    """
    out: list = []
    open_: list[tuple[str, tuple[str, ...]]] = []
    text: list[str] = []
    linked, in_link = 0, 0
    silent = ""
    closing = re.compile("")

    def flush():
        nonlocal linked
        words = " ".join(html.unescape("".join(text)).split())
        if words:
            inner = next((t for t, _ in reversed(open_) if t in BLOCK), "")
            out.append((words, open_[-1][1] if open_ else (), inner, linked))
        text.clear()
        linked = 0

    at = 0
    while at < len(page):
        if silent:  # text of a raw element runs to its end tag
            m = closing.search(page, at)
            at = m.end() if m else len(page)
            silent = ""
            continue
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = m[2]
        if not tag:
            if not m[0].startswith(("<!", "<?")):
                text.append(m[0])
                linked += len(m[0]) * bool(in_link)
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "a":
                in_link = 0
            level = next((i for i in range(len(open_) - 1, -1, -1) if open_[i][0] == tag), None)
            if level is not None:
                if any(t in BLOCK for t, _ in open_[level:]):
                    flush()
                    in_link = 0
                del open_[level:]
            elif tag in BLOCK:
                flush()
            continue
        if tag in ("br", "hr"):
            text.append(" ")
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in SILENT:
            if m[3].rstrip().endswith("/"):
                continue
            if tag != "head":
                silent, closing = tag, re.compile(f"</{tag}[^>]*(?:>|$)", re.I)
                continue
        if m[3].rstrip().endswith("/") and (tag in FOREIGN or any(t in FOREIGN for t, _ in open_)):
            continue
        if tag in BLOCK:
            flush()
            if any(t == "p" for t, _ in open_[-4:]) and tag not in ("button", "label", "option", "select"):
                level = max(i for i, (t, _) in enumerate(open_) if t == "p")
                del open_[level:]
            for i in range(len(open_) - 1, -1, -1):
                if tag in ENDED_BY.get(open_[i][0], ()):
                    del open_[i:]
                    break
                if open_[i][0] in ("ul", "ol", "table", "dl", "select", "div", "section"):
                    break
        if tag == "a":
            in_link = 1
        marks = _marks(tag, m[3])
        above = open_[-1][1] if open_ else ()
        open_.append((tag, tuple(dict.fromkeys(above + marks))))
    flush()
    return out


# -- labelled pages -----------------------------------------------------------

def labelled_pages(n: int, seed: int = 11) -> list[tuple[str, list[tuple[str, int]]]]:
    """(html, [(block text, 1 for main text)]) of ``n`` invented pages, blocks in page order."""
    return [_Page(random.Random(seed * 100_003 + i)).make() for i in range(n)]


class _Page:
    SIDES = {
        "nav": ("nav", "menu", "navbar", "navigation", "breadcrumb", "topnav", "main-menu", "links"),
        "head": ("header", "masthead", "site-header", "top-bar", "branding", "page-header"),
        "ad": ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner", "ad-slot"),
        "notice": ("cookie-notice", "cookie-banner", "consent", "gdpr", "notice", "alert", "newsletter", "subscribe", "popup",
                   "message", "warning", "paywall"),
        "side": ("sidebar", "related", "widget", "recommended", "popular", "trending", "side", "more-stories"),
        "form": ("search", "login", "signup", "contact-form", "search-box"),
        "share": ("share", "social", "share-buttons", "tags", "toolbar"),
        "comments": ("comments", "comment-list", "replies", "discussion", "responses", "user-comments", "reviews"),
        "foot": ("footer", "site-footer", "copyright", "colophon", "legal", "bottom"),
    }
    TAGS = {"nav": "nav", "head": "header", "side": "aside", "form": "form", "foot": "footer"}
    MAIN = ("content", "post", "entry-content", "article-body", "story", "main", "post-body", "text", "entry", "article")

    def __init__(self, rng: random.Random):
        self.rng, self.html, self.labels = rng, [], []
        parts = ["".join(rng.choice("abcdefghilmnoprstuvwéüñß") for _ in range(rng.randint(1, 3))) for _ in range(40)]
        self.words = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(300)]

    def sentence(self, low=4, high=18) -> str:
        text = " ".join(self.rng.choice(self.words) for _ in range(self.rng.randint(low, high)))
        return text.capitalize() + self.rng.choice(["."] * 6 + ["?", "!", ","])

    def prose(self, most=8) -> str:
        return " ".join(self.sentence() for _ in range(self.rng.randint(1, most)))

    def label(self, low=1, high=4) -> str:
        return " ".join(self.rng.choice(self.words) for _ in range(self.rng.randint(low, high)))

    def block(self, tag: str, text: str, main: int, link=False, end=True) -> None:
        inner = f'<a href="/{self.rng.choice(self.words)}">{text}</a>' if link else text
        if main and not link and self.rng.random() < 0.2 and " " in text:
            first, rest = text.split(" ", 1)
            wrap = self.rng.choice(["b", "i", "em", "a href='#'", "strong", "span"])
            inner = f"<{wrap}>{first}</{wrap.split()[0]}> {rest}"
        self.html.append(f"<{tag}>{inner}" + (f"</{tag.split()[0]}>" if end else ""))
        self.labels.append((" ".join(text.split()), main))

    def side(self, kind: str) -> None:
        rng = self.rng
        name = rng.choice(self.SIDES[kind])
        plain = kind in self.TAGS and rng.random() < 0.5
        tag = self.TAGS[kind] if plain or kind == "form" else rng.choice(["div", "section", "div"])
        attribute = "" if plain and rng.random() < 0.6 else f' {rng.choice(["class", "class", "id"])}="{name}"'
        self.html.append(f"<{tag}{attribute}>")
        if kind in ("nav", "share") or kind in ("side", "foot") and rng.random() < 0.6:
            if kind == "side":
                self.block(rng.choice(["h2", "h3", "h4"]), self.label(), 0)
            self.html.append("<ul>")
            for _ in range(rng.randint(2, 8)):
                self.block("li", self.label() if kind != "side" else self.label(2, 9), 0, link=True)
            self.html.append("</ul>")
        if kind == "head":
            self.block(rng.choice(["div", "p", "h1", "h2"]), self.label(), 0, link=rng.random() < 0.5)
            if rng.random() < 0.5:
                self.block("p", self.sentence(3, 8), 0)
        elif kind in ("ad", "notice"):
            if rng.random() < 0.4:
                text = self.prose(3)
                self.html.append(text)
                self.labels.append((text, 0))
            else:
                self.block("p", self.prose(3), 0)
            if kind == "notice" and rng.random() < 0.6:
                self.block("button", self.label(1, 2), 0)
        elif kind == "form":
            self.block("label", self.label(1, 2), 0)
            self.html.append("<input type=text>")
            self.block("button", self.label(1, 2), 0)
        elif kind == "side" and rng.random() < 0.5:
            self.block("p", self.prose(3), 0)
        elif kind == "comments":
            self.block(rng.choice(["h2", "h3"]), self.label(1, 3), 0)
            inner = rng.choice(['div class="comment"', "li", 'article class="comment"', 'div class="reply"', "div", 'p class="comment"'])
            for _ in range(rng.randint(1, 5)):
                if inner.startswith("p "):
                    self.block(inner, self.prose(4), 0)
                    continue
                self.html.append(f"<{inner}>")
                self.block("p", self.prose(4), 0)
                self.html.append(f"</{inner.split()[0]}>")
        elif kind == "foot":
            text = rng.choice(["© ", "&copy; ", "Copyright ", ""]) + self.label(1, 3) + rng.choice([" · ", " | ", " &middot; ", " "]) + self.sentence(2, 9)
            self.html.append(text)
            self.labels.append((" ".join(html.unescape(text).split()), 0))
        self.html.append(f"</{tag}>")

    def main(self) -> None:
        rng = self.rng
        style = rng.random()
        tags = (["article"] if style < 0.45 else ["main"] if style < 0.6 else ["main", "article"] if style < 0.7 else
                [f'div class="{rng.choice(self.MAIN)}"'] if style < 0.9 else [f'div id="{rng.choice(self.MAIN)}"'])
        self.html += [f"<{t}>" for t in tags]
        end = rng.random() < 0.7
        if rng.random() < 0.8:
            self.block(rng.choice(["h1", "h1", "h2"]), self.label(3, 10), 1)
        for _ in range(rng.randint(1, 10)):
            kind = rng.random()
            if kind < 0.72:
                text = self.prose() if rng.random() < 0.85 else self.sentence(1, 5)
                if rng.random() < 0.1:  # odd prose: signs at words, or bars between them
                    sign = rng.choice([" | ", "*** ", "%%% ", "!! "])
                    text = sign.join(self.rng.choice(self.words) for _ in range(rng.randint(3, 30))) + sign.rstrip()
                self.block("p", text, 1, end=end)
            elif kind < 0.8:
                self.block(rng.choice(["h2", "h3"]), self.label(1, 6), 1)
            elif kind < 0.87:
                self.html.append("<ul>")
                for _ in range(rng.randint(2, 4)):
                    self.block("li", self.sentence(2, 12), 1)
                self.html.append("</ul>")
            elif kind < 0.92:
                self.block(rng.choice(["blockquote", "pre", "figcaption"]), self.sentence(), 1)
            elif kind < 0.96:
                self.side(rng.choice(["ad", "share", "notice", "side", "form"]))
            else:
                self.html.append("<table><tr>")
                for _ in range(rng.randint(2, 4)):
                    self.block("td", self.label(1, 3), 1)
                self.html.append("</tr></table>")
        if rng.random() < 0.15:
            self.side("comments")
        self.html += [f"</{t.split()[0]}>" for t in reversed(tags)]

    def make(self):
        rng = self.rng
        self.html.append(f"<!DOCTYPE html><html><head><title>{self.label()}</title><style>p{{}}</style></head><body>")
        wrap = rng.random() < 0.3
        if wrap:
            self.html.append(f'<div class="{rng.choice(["container", "wrapper", "page", "layout"])}">')
        before = [k for k in ("head", "nav", "notice", "ad", "form") if rng.random() < 0.55]
        rng.shuffle(before)
        for k in before:
            self.side(k)
        self.main()
        for k in ("share", "side", "ad", "comments", "notice", "form", "foot"):
            if rng.random() < (0.8 if k == "foot" else 0.35):
                self.side(k)
        self.html.append("</div></body></html>" if wrap else "</body></html>")
        return "".join(self.html), self.labels
