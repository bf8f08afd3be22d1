"""Reads a page's markup into blocks of text, each piece with its place in the element tree."""

from __future__ import annotations

import html
import re
from functools import lru_cache

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")

RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark",
    "nobr", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
#: Elements that never hold an article's text.
APART = {"nav", "footer", "aside", "form", "noscript", "template", "svg", "math", "canvas", "object", "select", "button", "dialog", "menu", "head", "audio", "video", "datalist", "map"}
APART_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "alertdialog", "form", "menu", "menubar", "toolbar", "status"}
#: Words of a class or id that set an element apart.
APART_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promos", "promotion", "banner", "sidebar", "rail", "nav",
    "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "footer", "masthead", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "popup", "modal",
    "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "share", "sharing", "social", "comment", "comments", "disqus", "respond", "replies", "related",
    "recommended", "recommendations", "widget", "widgets", "pagination", "pager", "toolbar", "skip", "paywall", "disclaimer", "toc", "tags", "search", "topbar", "alert",
}
#: Words of a class or id that name the article where no element does.
MAIN_NAMES = {"article", "articlebody", "post", "entry", "story", "content", "main", "body", "text"}
#: Words that say nothing of what an element is for.
NEUTRAL = {
    "box", "bar", "block", "list", "wrap", "wrapper", "container", "section", "area", "link", "links", "button", "buttons", "top", "bottom", "left", "right", "site", "page", "header", "inner", "outer", "item", "items", "form", "primary", "secondary", "global",
    "main", "post", "posts", "article", "articles", "entry", "content", "col", "row", "slot", "unit", "zone", "panel", "group", "icons", "icon", "text", "title", "body", "desktop", "mobile", "sticky", "fixed", "header", "policy", "message", "center", "middle", "google", "the",
}
#: How words begin that set an element apart inside an article too, unless it holds most of the article; those of readers' comments always do.
COMMENT_STEMS = ("comment", "disqus", "guestbook", "comentario", "commentaire", "kommentare")
#: Words that begin so and mean opinion pieces.
NOT_COMMENTS = ("commentary", "commentaries", "commentator")
APART_STEMS = (
    "advert", "adsense", "sponsor", "promo", "banner", "sidebar", "breadcrumb", "footer", "masthead", "cookie", "consent", "gdpr", "popup", "modal", "newsletter", "subscri", "signup", "login", "sharet", "sharei", "shareb", "sharing",
    "social", "related", "recommend", "pagination", "paywall", "disclaimer", "outbrain", "taboola", "trending", "teaser", "followus", "mostread", "mostpopular", "readmore", "nextup", "relacionad", "recomend",
)
#: Pairs of words with the same effect, and words that are adverts by themselves.
APART_PAIRS = {("most", "read"), ("most", "popular"), ("most", "viewed"), ("read", "more"), ("read", "next"), ("read", "also"), ("up", "next"), ("more", "stories"), ("more", "from"), ("more", "on"), ("further", "reading"), ("also", "like"), ("sign", "up"), ("follow", "us"), ("author", "bio"), ("skip", "link")}
AD_WORDS = {"ad", "ads", "adslot", "adunit", "dfp", "gpt"}
#: Words before which a name tells of a page's state and not of an element's purpose.
STATES = {"has", "no", "with", "without", "is", "not", "hide", "show", "enable", "enabled", "disable", "disabled", "allow"}
#: How headings begin whose section is no part of the article.
APART_HEADING = re.compile(
    r"\W*(?:[0-9]+\s+)?(?:(?:reader|user|leave a|post a|add a|your|latest)\s+)?(?:comments?|replies|responses|comentarios?|commentaires?|kommentare?|"
    r"(?:related|recommended|more|similar|popular|latest|trending)\s+(?:articles?|stories|posts?|news|content|reading|links?|topics?)|most\s+(?:read|popular|viewed)|you (?:may|might) (?:also )?like|read (?:more|next|also)|see also|"
    r"share this(?: \w+)?|follow us|sign up(?: .{0,40})?|subscribe(?: .{0,40})?|newsletter|advertisements?|sponsored(?: \w+)?|artículos relacionados|articles liés|à lire aussi|ähnliche artikel|mehr zum thema|lea también)(?:\s*\([0-9]+\))?\W*$",
    re.I,
)
_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
_CLOSES_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
_SAME_CLOSES = {"li", "option", "tr", "td", "th", "dt", "dd"}


@lru_cache(maxsize=64)
def _ends(tag: str) -> re.Pattern:
    return re.compile(f"</{tag}", re.I | re.A)


def _sets_apart(token: str) -> int:
    """What a class or id says of an element inside an article: 2 that it holds comments or an advert, 1 that it is apart for
    another purpose, 0 neither. All its words are names or neutral, or one begins as such names do."""
    words = [x for x in _NAME.findall(_CAMEL.sub(" ", token).lower()) if x]
    if not words or words[0] in STATES:
        return 0
    if any(x.startswith(COMMENT_STEMS) and not x.startswith(NOT_COMMENTS) or x in ("respond", "replies") for x in words) or AD_WORDS & set(words):
        return 2
    if any(x.startswith(APART_STEMS) or x == "share" for x in words) or any(pair in APART_PAIRS for pair in zip(words, words[1:], strict=False)):
        return 1
    return int(bool(APART_NAMES & set(words)) and all(x in APART_NAMES or x in NEUTRAL or len(x) < 3 or x.isdigit() for x in words))


_TEASER = re.compile(r"(?:^|[-_])(?:teaser|card|preview|summary|promo|related|recommended|comment|reply)s?(?:$|[-_])")


class Page:
    """``blocks``: lists of (text, element); per element its parent, whether it is set apart and how, and its rank as the article.

    Apart is 2 for what an element is, its readers' comments or its heading, 1 for a name that may be wrong, and 3 for what holds links only.
    """

    def __init__(self, source: str | None):
        self.parent, self.apart, self.rank, self.tag, self.teasers = [-1], [0], [0], [""], set()
        self.blocks: list[list[tuple[str, int]]] = []
        self._block: list[tuple[str, int]] = []
        self._read(source or "")
        self._end_block()
        self._settle()

    def _end_block(self) -> None:
        if self._block:
            self.blocks.append(self._block)
            self._block = []

    def _text(self, raw: str, element: int) -> None:
        if raw:
            self._block.append((html.unescape(raw) if "&" in raw else raw, element))

    def _read(self, source: str) -> None:
        stack, at = [0], 0
        for m in iter(lambda: _TOKEN.search(source, at), None):
            self._text(source[at : m.start()], stack[-1])
            at = m.end()
            tag = m[2] or m[5]
            if not tag:
                continue
            tag, closing, rest = tag.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
            if tag not in INLINE:
                self._end_block()
            if closing:
                for k in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[k]] == tag:
                        del stack[k:]
                        break
                continue
            if tag in RAW:
                end = _ends(tag).search(source, at)
                at = end.start() if end else len(source)
                continue
            if tag in VOID:
                continue
            if tag in _CLOSES_P or tag in _SAME_CLOSES:
                shut = "p" if tag in _CLOSES_P else tag
                for k in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[k]] == shut:
                        del stack[k:]
                        break
                    if self.tag[stack[k]] in ("div", "article", "section", "main", "ul", "ol", "table", "dl", "body", "aside", "nav", "footer", "header", "form"):
                        break
            self._open(tag, rest, stack)
            if rest.endswith("/") and tag in ("svg", "path"):
                stack.pop()
        self._text(source[at:], stack[-1])

    def _open(self, tag: str, rest: str, stack: list[int]) -> None:
        apart = 2 if tag in APART else 0
        rank = 3 if tag == "article" else 2 if tag == "main" else 0
        if tag == "header" and not any(self.rank[e] >= 2 for e in stack):
            apart = 2
        if rest and not rest.isspace():
            given = {k.lower(): html.unescape(a or b or c or "") for k, a, b, c in _ATTRIBUTE.findall(rest)}
            tokens = f"{given.get('class', '')} {given.get('id', '')}".split()
            names = set(_NAME.findall(_CAMEL.sub(" ", " ".join(tokens)).lower()))
            inside = any(self.rank[e] >= 2 for e in stack)
            role = given.get("role", "").lower()
            if role in APART_ROLES or "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", "").lower():
                apart = 2
            elif tag not in ("html", "body") and rank < 3 and (said := max(map(_sets_apart, tokens), default=0)):
                apart = max(apart, said)
            elif tag not in ("html", "body") and not inside and names & APART_NAMES and not names & STATES:
                apart = max(apart, 1)
            elif rank == 3 and any(_TEASER.search(t.lower()) for t in tokens):
                self.teasers.add(len(self.parent))
            if role == "main":
                rank = max(rank, 2)
            elif given.get("itemprop") == "articleBody":
                rank = max(rank, 2)
            elif names & MAIN_NAMES and tag in ("div", "section", "td"):
                rank = max(rank, 1)
        self.parent.append(stack[-1])
        self.apart.append(apart)
        self.rank.append(rank)
        self.tag.append(tag)
        stack.append(len(self.parent) - 1)

    def _below(self, count) -> list[int]:
        """For each element the sum of count(block's text, element) over what is in or below it."""
        out = [0] * len(self.parent)
        for block in self.blocks:
            for text, e in block:
                out[e] += count(text, e)
        for e in range(len(out) - 1, 0, -1):
            out[self.parent[e]] += out[e]
        return out

    def _flags(self, own: list[bool]) -> list[bool]:
        """Whether an element or one above it has its own flag."""
        for e in range(1, len(own)):
            own[e] = own[e] or own[self.parent[e]]
        return own

    def _heads(self) -> None:
        """Sets apart what stands under a heading of comments, related articles and the like: the section that the heading opens, or what
        follows it among its siblings up to the next heading of its level."""
        started: set[int] = set()  # elements that have shown text already
        until: dict[int, int] = {}  # parent: level of the heading under which its children go
        level = {e: int(t[1]) for e, t in enumerate(self.tag) if t in _HEADINGS}
        said: dict[int, str] = {}
        for block in self.blocks:
            for text, e in block:
                while e > 0 and e not in level:
                    e = self.parent[e]
                if e > 0:
                    said[e] = said.get(e, "") + text
        text_at: dict[int, None] = {}
        for block in self.blocks:
            for text, e in block:
                if not text.isspace():
                    text_at[e] = None
        seen = sorted(text_at)
        at = 0
        for e in range(1, len(self.parent)):
            while at < len(seen) and seen[at] < e:
                up = seen[at]
                while up > 0 and up not in started:
                    started.add(up)
                    up = self.parent[up]
                at += 1
            p = self.parent[e]
            if e in level and p in until and level[e] <= until[p]:
                del until[p]
            if e in level and APART_HEADING.match(" ".join(said.get(e, "").split())):
                if p not in started and self.rank[p] < 2 and self.tag[p] not in ("", "body", "html"):
                    self.apart[p] = 2
                until[p] = min(level[e], until.get(p, 9))
                self.apart[e] = 2
            elif p in until:
                self.apart[e] = 2

    def _settle(self) -> None:
        """For each element: set apart or not; and is it in the page's main part."""
        size = len(self.parent)
        self._heads()
        links = self._flags([t == "a" for t in self.tag])
        hard = self._flags([a == 2 for a in self.apart])
        chars = self._below(lambda text, e: 0 if hard[e] else len(text.strip()))  # of text that no element sets apart for what it is
        linked = self._below(lambda text, e: len(text.strip()) if links[e] and not hard[e] else 0)
        items = [0] * size
        for e in range(1, size):
            if self.tag[e] == "li":
                items[self.parent[e]] += 1
        for e in range(1, size):  # lists of three links or more, and little else
            if self.tag[e] in ("ul", "ol", "dl") and items[e] >= 3 and chars[e] and 10 * linked[e] >= 9 * chars[e]:
                self.apart[e] = max(self.apart[e], 3)
        home = 0
        for e in range(1, size):  # a name sets nothing apart that holds most of the page in an article
            if self.rank[e] >= 2 and self.apart[e] not in (2, 3) and 2 * chars[e] >= chars[0]:
                home = e
                up = e
                while up > 0:
                    self.apart[up] -= self.apart[up] == 1
                    up = self.parent[up]
        for e in range(1, size):  # nor what holds most of the article
            if home and self.apart[e] == 1 and 2 * chars[e] > chars[home]:
                self.apart[e] = 0
        self.away = self._flags([a > 0 for a in self.apart])
        shown = self._below(lambda text, e: 0 if self.away[e] else len(text.strip()))
        for e in range(1, size):  # a name makes an article only of what has most of the text
            if self.rank[e] == 1 and 2 * shown[e] < shown[0]:
                self.rank[e] = 0
        self.best = max((r for r, n in zip(self.rank, shown, strict=True) if n), default=0)
        largest = max((n for r, n in zip(self.rank, shown, strict=True) if r == self.best), default=0)
        own = [False] * size
        for e in range(1, size):  # teasers of other articles are shorter than the page's own, and are named so or link there
            short = 10 * shown[e] < 3 * largest
            own[e] = self.best > 0 and self.rank[e] == self.best and not (short and (e in self.teasers or 3 * linked[e] >= shown[e]))
        self.inside = self._flags(own)
