"""Text blocks of an HTML page, and made pages whose blocks are labelled."""

from __future__ import annotations

import html
import random
import re

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+(?:>|\Z))", re.S)
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_PART = re.compile(r"[a-zA-Z]+")

INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
                   "strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MATH = frozenset("math mi mn mo ms mspace mtext mrow mfrac msqrt mroot mstyle merror mpadded mphantom menclose msub msup msubsup munder mover "
                 "munderover mmultiscripts mprescripts mtable mtr mtd maction semantics".split())
RAW = frozenset("script style iframe title textarea xmp noembed noframes".split())
SKIPPED = frozenset("noscript template svg object canvas audio video select annotation annotation-xml".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre "
                     "section table ul".split())
SIBLING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
           "option": ("option",)}
_LEAVES_SVG = re.compile(r"<(?:" + "|".join(sorted(CLOSES_P - {"address", "details"})) + r")(?=[\s/>])", re.I)
_FOREIGN = re.compile(r"<foreignobject(?=[\s/>])", re.I)


class _Ends:
    """Where elements without running text end, each kind's tags paired once a page."""

    def __init__(self, page: str):
        self.page, self.pairs, self.seen = page, {}, {}

    def raw(self, name: str, at: int) -> int | None:
        """Behind the end tag of an element whose content is plain text: the next one of exactly its name."""
        m = re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(self.page, at)
        return m.end() if m else None

    def paired(self, name: str, at: int) -> int | None:
        """Behind the end tag that belongs to the start tag ending at ``at``; None where it has none."""
        if name not in self.pairs:
            ends, open_ = {}, []
            for m in re.finditer(rf"<(/?){re.escape(name)}(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>", self.page, re.I):
                if not m[1]:
                    if not m[0].endswith("/>"):
                        open_.append(m.end())
                elif open_:
                    ends[open_.pop()] = m.end()
            self.pairs[name] = ends
        return self.pairs[name].get(at)

    def _next(self, pattern: re.Pattern, at: int) -> int:
        got = self.seen.get(pattern, -1)
        if got < at:
            m = pattern.search(self.page, at)
            got = self.seen[pattern] = m.start() if m else len(self.page)
        return got

    def svg(self, at: int) -> int | None:
        """As ``paired``, but a block element leaves the drawing unless it stands in a foreign object."""
        end, out = self.paired("svg", at), self._next(_LEAVES_SVG, at)
        if out < (len(self.page) if end is None else end) and not (end and self._next(_FOREIGN, at) < out):
            return out
        return end


def blocks(page: str) -> list[tuple[tuple[str, ...], str, float]]:
    """(tag path, text, share of linked characters) of each non-empty block, in page order.

    A path entry is a tag with the words of its class, id and role.  Comments,
    declarations and elements that hold no running text are left out;
    character references are decoded, white space becomes single spaces.
    Formulas are text of their block.  Where its end tag is missing, an element
    of plain text (scripts, styles, titles ...) reaches to the page's end, as in
    browsers; of any other kind only the tag itself is left out."""
    out: list[tuple[tuple[str, ...], str, float]] = []
    stack: list[tuple[str, str]] = []
    parts: list[str] = []
    linked = links = at = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            raw = "".join(parts)
            text = " ".join(html.unescape(raw).split())
            if text:
                out.append((tuple(x for _, x in stack if x), text, linked / max(len(raw), 1)))
            parts.clear()
            linked = 0

    def pop_to(k: int) -> None:
        del stack[k:]

    ends = _Ends(page)
    while True:
        m = _TOKEN.search(page, at)
        chunk = page[at: m.start()] if m else page[at:]
        if chunk:
            parts.append(chunk)
            if links:
                linked += len(chunk)
        if not m:
            break
        at = m.end()
        if m["name"] is None:
            continue
        name, closing = m["name"].lower(), m["close"]
        if name in INLINE or name in MATH:
            if name == "a":
                links = 0 if closing else 1
            elif name == "br":
                parts.append(" ")
            continue
        flush()
        links = 0
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    pop_to(k)
                    break
            continue
        if name in RAW:
            if not m.group().endswith("/>"):
                at = ends.raw(name, at) or len(page)
            continue
        if name in SKIPPED:
            if not m.group().endswith("/>"):
                at = (ends.svg(at) if name == "svg" else ends.paired(name, at)) or at
            continue
        if name in VOID:
            continue
        if name in CLOSES_P:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    pop_to(k)
                    break
                if stack[k][0] in CLOSES_P:
                    break
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in SIBLING.get(name, ()):
                pop_to(k)
                break
            if stack[k][0] in ("ul", "ol", "dl", "table", "select", "article", "section", "div"):
                break
        words = [w.lower() for x in _NAMED.finditer(m["attrs"]) for w in _PART.findall(x[2] or x[3] or x[4] or "")]
        stack.append((name, name if not words else " ".join([name, *words])))
    flush()
    return [b for b in out if not b[0] or b[0][-1] != "head"]


# ---- made pages ---------------------------------------------------------------

_MAIN = ("<article>|</article>", "<main>|</main>", "<main><article>|</article></main>", '<div class="content">|</div>', '<div id="content">|</div>',
         '<div class="post"><div class="entry-content">|</div></div>', '<section class="article-body">|</section>', '<div class="story">|</div>',
         '<div id="main"><div class="text">|</div></div>', "|")
_MENU = ("<nav>|</nav>", '<div class="menu">|</div>', '<div id="nav">|</div>', '<ul class="breadcrumb">|</ul>', '<div class="navbar">|</div>')
_HEAD = ("<header>|</header>", '<div class="header">|</div>', '<div id="top">|</div>', '<div id="masthead">|</div>')
_FOOT = ("<footer>|</footer>", '<div class="footer">|</div>', '<div id="footer">|</div>', '<div class="site-info">|</div>')
_SIDE = ("<aside>|</aside>", '<div class="sidebar">|</div>', '<div id="sidebar">|</div>', '<div class="related">|</div>', '<div class="widget">|</div>')
_ADS = ('<div class="ad">|</div>', '<div class="advert">|</div>', '<div class="ads">|</div>', '<div id="banner-ad">|</div>',
        '<div class="sponsored">|</div>', '<div class="promo">|</div>', '<aside class="advertisement">|</aside>')
_NOTE = ('<div class="cookie-notice">|</div>', '<div class="notice">|</div>', '<div id="consent">|</div>', '<div class="alert">|</div>',
         '<div class="cookie-banner">|</div>', '<div role="dialog">|</div>', '<div class="newsletter">|</div>', '<div class="share">|</div>')
_TALK = ('<section class="comments">|</section>', '<div id="comments">|</div>', '<div class="comment-list">|</div>', '<ol class="commentlist">|</ol>',
         '<div class="discussion">|</div>', '<div class="reader-comments">|</div>')


def made_page(rng: random.Random, words: list[str]) -> tuple[str, list[int]]:
    """A page of a random layout and its blocks' labels (1: main text)."""
    labels: list[int] = []

    def text(lo: int, hi: int, label: int, stop: bool = True) -> str:
        n = rng.randint(lo, hi)
        got = [rng.choice(words) for _ in range(n)]
        if rng.random() < 0.2:
            k = rng.randrange(n)
            got[k] = f"<{(t := rng.choice(['b', 'em', 'a href=x', 'i', 'span']))}>{got[k]}</{t.split()[0]}>"
        if label is not None:
            labels.append(label)
        return " ".join(got).capitalize() + ("." if stop else "")

    def inside(shapes, body) -> str:
        a, b = rng.choice(shapes).split("|")
        return a + body() + b

    def items(label: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{k}">{text(1, 4, label, False)}</a></li>' for k in range(rng.randint(2, 9))) + "</ul>"

    def para(label: int, tag: str = "p") -> str:
        close = f"</{tag}>" if rng.random() < 0.85 else ""
        lo, hi = rng.choice(((1, 6), (5, 25), (20, 90), (60, 200)))
        extra = rng.choice(("", "", "", "<b>", "<br>"))
        return f"<{tag}>{extra}{text(lo, hi, label)}{close}"

    def ad() -> str:
        return inside(_ADS, lambda: rng.choice((lambda: text(2, 30, 0), lambda: para(0))) ())

    def note() -> str:
        return inside(_NOTE, lambda: para(0) + (f"<button>{text(1, 2, 0, False)}</button>" if rng.random() < 0.4 else ""))

    def form() -> str:
        return f"<form>{para(0)}<div>{text(1, 4, 0, False)}<input name=q></div><button>{text(1, 2, 0, False)}</button></form>"

    def talk() -> str:
        def body() -> str:
            out = f"<h3>{text(1, 4, 0, False)}</h3>" if rng.random() < 0.7 else ""
            for _ in range(rng.randint(1, 7)):
                a, b = rng.choice(('<div class="comment">|</div>', "<li>|</li>", "<article class=\"comment\">|</article>")).split("|")
                out += a + (f"<div class=\"author\">{text(1, 3, 0, False)}</div>" if rng.random() < 0.5 else "") + para(0) + b
            return out
        return inside(_TALK, body)

    def side() -> str:
        return inside(_SIDE, lambda: (f"<h3>{text(1, 5, 0, False)}</h3>" if rng.random() < 0.6 else "") + rng.choice((lambda: items(0), lambda: para(0) + para(0)))())

    def article() -> str:
        out = f"<h1>{text(2, 14, 1, rng.random() < 0.3)}</h1>" if rng.random() < 0.85 else ""
        for _ in range(rng.choice((1, 2, 4, 8, 15, 30))):
            r = rng.random()
            if r < 0.78:
                out += para(1)
            elif r < 0.84:
                out += f"<h{(k := rng.randint(2, 4))}>{text(1, 8, 1, False)}</h{k}>"
            elif r < 0.88:
                out += "<ul>" + "".join(f"<li>{text(2, 25, 1, False)}</li>" for _ in range(rng.randint(1, 6))) + "</ul>"
            elif r < 0.91:
                out += f"<blockquote>{para(1)}</blockquote>"
            elif r < 0.93:
                out += f"<table><tr><td>{text(1, 5, 1, False)}</td><td>{text(1, 5, 1, False)}</td></tr></table>"
            elif r < 0.96:
                out += ad()
            elif r < 0.98:
                out += note()
            else:
                out += form()
        return out

    def some(p: float, f) -> str:
        return f() if rng.random() < p else ""

    page = "<!DOCTYPE html><html><head><title>" + text(2, 8, None) + "</title><style>p{}</style></head><body>"
    wrap = rng.random() < 0.3
    page += '<div class="container">' if wrap else ""
    page += some(0.3, note)
    page += some(0.5, lambda: inside(_HEAD, lambda: f"<p>{text(1, 6, 0, False)}</p>" + some(0.5, lambda: items(0))))
    page += some(0.7, lambda: inside(_MENU, lambda: items(0)))
    page += some(0.4, ad) + some(0.2, side)
    page += inside(_MAIN, article)
    page += some(0.15, form) + some(0.35, talk) + some(0.4, side) + some(0.2, ad)
    page += some(0.85, lambda: inside(_FOOT, lambda: rng.choice((lambda: "&copy; " + text(1, 12, 0), lambda: para(0), lambda: items(0) + para(0)))()))
    page += some(0.15, note)
    return page + ("</div>" if wrap else "") + "</body></html>", labels
