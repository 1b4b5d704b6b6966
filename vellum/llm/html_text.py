"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: the text between the tags of block elements, with the chain of elements
that are open around it. Each block has features of its ancestor tags, of words in their class, id and
role, and of its text: length, share of linked characters, punctuation, letters. Two labels, main text
and other; the chain's potentials are unary weights and one weight for each pair of labels in a row.
Weights are trained on labelled pages by gradient ascent on the log likelihood with forward and backward
sums, and a page is decoded by Viterbi. Scripts, styles and other elements without readable text never
become blocks.

The labelled pages are made by a generator with varied layouts, TRAINING of them, from a fixed seed; the
fit takes a few seconds on the driver and its weights are sent to the tasks. Every page is decoded whole.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Labelled pages, their seed, steps of the fit.
TRAINING, SEED, STEPS = 240, 17, 120
#: Element names of HTML.
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul select button textarea label iframe".split())
SILENT = frozenset("script style noscript template svg annotation annotation-xml head title iframe object canvas audio video textarea select option datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())
#: Start tags that leave an open head open; start tags that end an open svg or math; elements of these two that hold HTML again.
IN_HEAD = frozenset("base basefont bgsound link meta title noscript noframes style script template head html".split())
LEAVES = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
FOREIGN = frozenset(("svg", "math"))
HOLDS_HTML = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
CLOSES = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements that tell what the blocks inside them are.
TELLING = frozenset("article main section nav header footer aside form ul ol table blockquote pre figure a button label h1 h2 h3 h4 details dialog fieldset menu p li td dl".split())
NO_DIGITS = str.maketrans("", "", "0123456789")
#: Words of class, id and role names, by what they point to.
HINTS = {
    "menu": "nav menu breadcrumb breadcrumbs tabs pagination pager toc skip navbar navigation sitemap links",
    "frame": "header footer masthead banner topbar bottom copyright legal site colophon",
    "side": "sidebar aside side rail widget related recommended popular trending more tags tag categories share social",
    "notice": "notice cookie cookies consent gdpr alert popup modal newsletter subscribe signup login promo",
    "advert": "ad ads adv advert advertisement sponsor sponsored banner promo commercial adsense",
    "talk": "comment comments respond reply replies discussion disqus thread reviews",
    "form": "form search input field login",
    "main": "article main content post entry story text body page prose",
}
HINT_OF: dict[str, list[str]] = {}
for _kind, _words in HINTS.items():
    for _word in _words.split():
        HINT_OF.setdefault(_word, []).append(_kind)

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:\"[^\"]*+\"|'[^']*+'|[^'\">]++)*+)>")
PLAIN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
RAW_END = {t: re.compile(rf"</{t}\s*+>", re.I) for t in RAW}
NAMES = re.compile(r"""(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
PARTS = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")


def named(attributes: str) -> tuple[str, ...]:
    words = PARTS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", " ".join("".join(m) for m in NAMES.findall(attributes))).lower())
    return tuple(sorted({k for w in words for k in HINT_OF.get(w, ())}))


def hidden(attributes: str) -> bool:
    """Whether a hidden attribute, aria-hidden="true" or a style with display: none makes the element silent."""
    low = attributes.lower()
    if "hidden" not in low and "display" not in low:
        return False
    first: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(low):
        first.setdefault(m[1], m[2] or m[3] or m[4] or "")
    shown, fixed = "", False
    for declaration in unescape(first.get("style", "")).split(";"):
        name, _, value = declaration.partition(":")
        if name.strip() == "display":
            value, mark, _ = value.partition("!")
            if mark or not fixed:  # the last one holds, but an important one holds against others
                shown, fixed = value.strip(), bool(mark)
    return "hidden" in first or first.get("aria-hidden", "").strip() == "true" or shown == "none"


def closed(attributes: str) -> bool:
    """Whether the tag closes itself; a slash at the end of a bare value is part of the value."""
    if not attributes.endswith("/"):
        return False
    cut = max(attributes.rfind(c) for c in " \t\n\r\f\"'>") + 1
    return not ("=" in attributes[cut:-1] or attributes[:cut].rstrip().endswith("=") and attributes[cut - 1 : cut].isspace())


class Node:
    """An open element, with what its blocks need to know of all elements around it, so that a block keeps one link."""

    __slots__ = ("block", "hints", "inside", "own", "pair", "quiet", "tag")

    def __init__(self, tag: str, own: tuple[str, ...], quiet: bool, outer: Node | None):
        self.tag, self.own, self.quiet = tag, own, quiet
        self.block = tag if tag in BLOCK else outer.block if outer else "none"
        inside, hints = (outer.inside, outer.hints) if outer else (frozenset(), frozenset())
        self.inside = inside | {tag} if tag in TELLING and tag not in inside else inside
        self.hints = hints | set(own) if not hints.issuperset(own) else hints
        self.pair = (outer.own if outer else ()) + own  # of the innermost two elements


class Block:
    __slots__ = ("linked", "node", "text")

    def __init__(self, node: Node | None, text: str, linked: int):
        self.node, self.text, self.linked = node, text, linked


class Open:
    """The stack of open elements, and where on it the elements of each name and of some groups are."""

    def __init__(self) -> None:
        self.stack: list[Node] = []
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.walls: list[int] = []  # blocks but p
        self.foreign: list[int] = []
        self.holders: list[int] = []
        self.links = self.silent = 0

    def places(self, tag: str) -> list[list[int]]:
        groups = [self.at.setdefault(tag, [])]
        if tag in BLOCK:
            groups.append(self.blocks)
            if tag != "p":
                groups.append(self.walls)
        if tag in FOREIGN:
            groups.append(self.foreign)
        if tag in HOLDS_HTML:
            groups.append(self.holders)
        return groups

    def push(self, tag: str, names: tuple[str, ...], quiet: bool) -> None:
        for group in self.places(tag):
            group.append(len(self.stack))
        self.stack.append(Node(tag, names, quiet, self.stack[-1] if self.stack else None))
        self.links += tag == "a"
        self.silent += quiet

    def pop(self, to: int) -> None:
        while len(self.stack) > to:
            node = self.stack.pop()
            for group in self.places(node.tag):
                group.pop()
            self.links -= node.tag == "a"
            self.silent -= node.quiet

    def last(self, tag: str) -> int:
        """The place of the innermost element of a name, -1 if none is open."""
        places = self.at.get(tag)
        return places[-1] if places else -1

    def top(self) -> str:
        return self.stack[-1].tag if self.stack else ""


def blocks(html: str | None) -> list[Block]:
    """The page's leaf blocks with readable text, in page order; each step takes constant time but for the characters it reads.

    A tag whose quotes do not end before the page does ends at its first ">", and from there on quotes no
    longer hide a ">"; a "<" after the last ">" is text.
    """
    out: list[Block] = []
    now, pieces, linked = Open(), [], 0
    html = html or ""

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = SPACE.sub(" ", unescape("".join(pieces))).strip()
            if text:
                out.append(Block(now.stack[-1] if now.stack else None, text, linked))
            pieces.clear()
        linked = 0

    def say(text: str) -> None:
        nonlocal linked
        if now.silent and now.top() == "head" and not text.isspace():
            now.pop(len(now.stack) - 1)
        if not now.silent:
            pieces.append(text)
            if now.links:
                linked += len(text)

    at, end, close, rule = 0, len(html), html.rfind(">"), TAG
    while at < end:
        if html.startswith("<!--", at):
            done = html.find("-->", at + 2)
            at = end if done < 0 else done + 3
            continue
        if html[at] != "<" or at > close:
            start, at = at, html.find("<", at + 1)
            at = end if at < 0 else at
            say(html[start:at])
            continue
        if html[at + 1 : at + 2] in ("!", "?"):
            at = html.index(">", at) + 1
            continue
        m = rule.match(html, at)
        if m is None and rule is TAG and html[at + 1 : at + 3].strip("/")[:1].isalpha():
            m = PLAIN.match(html, at)
            rule = PLAIN if m else rule
        if m is None:
            say("<")
            at += 1
            continue
        at = m.end()
        tag = m[2].lower()
        if m[1]:
            place = now.last(tag)
            if tag in BLOCK:
                flush()
            if place >= 0 and (tag in BLOCK or not now.blocks or now.blocks[-1] <= place):
                now.pop(place)  # an inline end tag does not close blocks
            continue
        if now.silent:
            heads = now.at.get("head")
            if tag == "body":
                if heads and not now.at.get("template"):
                    now.pop(heads[0])
            elif now.top() == "head" and tag not in IN_HEAD:
                now.pop(len(now.stack) - 1)
        if now.foreign and tag in LEAVES and (not now.holders or now.holders[-1] < now.foreign[0]):
            now.pop(now.foreign[0])
        if tag in BLOCK:
            flush()
            ends = CLOSES.get(tag, () if tag == "body" else ("p",))
            near = max(map(now.last, ends), default=-1)
            if near >= 0 and (not now.walls or now.walls[-1] <= near):
                now.pop(near)
        elif tag == "br" and not now.silent:
            pieces.append(" ")
        if tag in VOID or (now.foreign or tag in FOREIGN) and closed(m[3]):
            continue
        if tag in RAW:
            found = RAW_END[tag].search(html, at)
            at = found.end() if found else end
            continue
        now.push(tag, named(m[3]), tag in SILENT or hidden(m[3]))
    flush()
    return out


def block_features(b: Block) -> list[str]:
    text, n, node = b.text, len(b.text), b.node
    words = text.count(" ") + 1
    dense = b.linked / max(1, n)
    out = ["bias", f"tag={node.block if node else 'none'}", f"size={min(words.bit_length(), 8)}", f"links={'none' if dense == 0 else 'some' if dense < 0.5 else 'most'}"]
    if node:
        out += [f"in={t}" for t in node.inside]
        out += [f"hint={h}" for h in node.hints]
        out += [f"near={h}" for h in node.pair]
    if text[-1] in ".!?…:;\"”»。":
        out.append("ends")
    commas = text.count(",") + text.count(". ")
    out.append(f"commas={min(commas, 3)}")
    if re.search(r"(?i)©|\bcopyright\b|all rights reserved", text):
        out.append("copyright")
    if re.search(r"(?i)\b(cookie|cookies|subscribe|sign up|log in|newsletter|advertis|sponsored|share this|read more|related|comments?|reply|posted by|privacy policy|terms of)", text):
        out.append("stock")
    if 3 * (n - len(text.translate(NO_DIGITS))) > n:
        out.append("digits")
    return out


class Field:
    """The chain: unary weights by feature and label, pair weights, start weights."""

    def __init__(self, names: list[str]):
        self.at = {n: i for i, n in enumerate(names)}
        self.unary = np.zeros((len(names), 2))
        self.pair = np.zeros((2, 2))
        self.start = np.zeros(2)

    def rows(self, page: list[Block]) -> list[list[int]]:
        return [[self.at[f] for f in block_features(b) if f in self.at] for b in page]

    def scores(self, rows: list[list[int]]) -> np.ndarray:
        return np.array([self.unary[r].sum(axis=0) for r in rows]).reshape(-1, 2)

    def decode(self, page: list[Block]) -> list[int]:
        """The likeliest labels, by Viterbi."""
        if not page:
            return []
        s = self.scores(self.rows(page))
        (a00, a01), (a10, a11) = self.pair.tolist()
        b0, b1 = (s[0] + self.start).tolist()
        back = []
        for u0, u1 in s[1:].tolist():
            from0, from1 = b0 + a00 < b1 + a10, b0 + a01 < b1 + a11
            back.append((from0, from1))
            b0, b1 = u0 + (b1 + a10 if from0 else b0 + a00), u1 + (b1 + a11 if from1 else b0 + a01)
        label = int(b1 > b0)
        out = [label]
        for step in reversed(back):
            label = int(step[label])
            out.append(label)
        return out[::-1]


def fit(pages: list[tuple[list[Block], list[int]]], steps: int = STEPS, rate: float = 0.2, l2: float = 1e-3) -> Field:
    """Weights that maximise the penalised log likelihood of labelled pages, by scaled gradient ascent."""
    names = sorted({f for page, _ in pages for b in page for f in block_features(b)})
    field = Field(names)
    data = [(field.rows(p), np.array(y)) for p, y in pages if p]
    flat = np.array([i for rows, _ in data for r in rows for i in r])
    owner = np.repeat(np.arange(sum(len(r) for r, _ in data)), [len(r) for rows, _ in data for r in rows])
    truth = np.eye(2)[np.concatenate([y for _, y in data])]
    starts = np.cumsum([0] + [len(r) for r, _ in data])
    square = [np.full(w.shape, 1e-6) for w in (field.unary, field.pair, field.start)]
    for _ in range(steps):
        s = np.stack([np.bincount(owner, field.unary[flat, k], minlength=starts[-1]) for k in (0, 1)], axis=1)
        gap = np.zeros_like(s)
        g_pair, g_start = np.zeros((2, 2)), np.zeros(2)
        for (lo, hi), (_, y) in zip(zip(starts[:-1], starts[1:], strict=True), data, strict=True):
            u = s[lo:hi]
            fwd, bwd = np.empty_like(u), np.zeros_like(u)
            fwd[0] = u[0] + field.start
            for i in range(1, len(u)):
                fwd[i] = u[i] + np.logaddexp(fwd[i - 1][0] + field.pair[0], fwd[i - 1][1] + field.pair[1])
            for i in range(len(u) - 2, -1, -1):
                nxt = u[i + 1] + bwd[i + 1]
                bwd[i] = np.logaddexp(field.pair[:, 0] + nxt[0], field.pair[:, 1] + nxt[1])
            total = np.logaddexp(*fwd[-1])
            gap[lo:hi] = truth[lo:hi] - np.exp(fwd + bwd - total)
            g_start += gap[lo]
            if len(u) > 1:
                both = np.exp(fwd[:-1, :, None] + field.pair[None] + (u[1:] + bwd[1:])[:, None, :] - total)
                g_pair += np.bincount(2 * y[:-1] + y[1:], minlength=4).reshape(2, 2) - both.sum(axis=0)
        g_unary = np.stack([np.bincount(flat, gap[owner, k], minlength=len(names)) for k in (0, 1)], axis=1)
        for w, g, q in zip((field.unary, field.pair, field.start), (g_unary, g_pair, g_start), square, strict=True):
            g = g / len(data) - l2 * w
            q += g * g
            w += rate * g / np.sqrt(q)
    return field


def made_page(rnd: random.Random) -> tuple[str, str]:
    """A page of a random layout and its main text, one line per block."""
    syllables = "an be co da el fi go hu in ka lo mi no os pe qui ra sé tu ver wo ß ü ción".split()
    word = lambda: "".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 4)))

    def phrase(lo, hi):
        words = [word() + ("," if rnd.random() < 0.12 else "") for _ in range(rnd.randint(lo, hi))]
        return " ".join(words).capitalize().rstrip(",")

    sentence = lambda: phrase(1, 24) + rnd.choice(".....!?")
    escape = lambda t: t.replace("&", "&amp;").replace("<", "&lt;")
    name = lambda *options: rnd.choice(options)
    parts, main = [], []
    title = phrase(1, 10)
    url = lambda: f"/{word()}"

    def menu(tag):
        items = "".join(f'<li><a href="{url()}">{phrase(1, 3)}</a></li>' for _ in range(rnd.randint(2, 9)))
        return f"<{tag}{name('', ' class="menu"', ' id="nav"', ' role="navigation"')}><ul>{items}</ul></{tag}>"

    def say(text, how):
        main.append(" ".join(text.split()))
        parts.append(how.replace("{}", escape(text)))

    def article():
        for _ in range(rnd.randint(1, 14)):
            kind = rnd.random()
            if kind < 0.62:
                say(" ".join(sentence() for _ in range(rnd.choice([1, 1, 2, 3, 5, 8]))), name("<p>{}</p>", "<p>{}", "<p><b>{}<br>", "<p><em>{}</em></p>", "<p class=lead>{}</p>"))
            elif kind < 0.72:
                say(phrase(1, 8), name("<h2>{}</h2>", "<h3>{}</h3>", "<h2><a href='#x'>{}</a></h2>"))
            elif kind < 0.8:
                parts.append(name("<ul>", "<ol>"))
                for _ in range(rnd.randint(2, 5)):
                    say(name(sentence(), phrase(1, 6)), name("<li>{}</li>", "<li>{}"))
                parts.append("</ul>")
            elif kind < 0.86:
                say(sentence(), name("<blockquote>{}</blockquote>", "<blockquote><p>{}</p></blockquote>", "<pre>{}</pre>"))
            elif kind < 0.9:
                parts.append("<table>")
                for _ in range(rnd.randint(1, 3)):
                    parts.append("<tr>")
                    for _ in range(2):
                        say(phrase(1, 4), "<td>{}</td>")
                    parts.append("</tr>")
                parts.append("</table>")
            elif kind < 0.94:
                parts.append(f'<div class="{name("ad", "advert", "ad-slot", "sponsored")}">{sentence()}</div>')
            elif kind < 0.97:
                parts.append(f'<aside class="{name("related", "sidebar", "pullout widget")}"><h4>{phrase(1, 3)}</h4><p>{sentence()}</p></aside>')
            else:
                say(phrase(2, 9), "<figure><img src=x><figcaption>{}</figcaption></figure>")

    head = rnd.random() < 0.6
    if head:
        parts.append(f"<header{name('', ' class="site-header"', ' id="masthead"')}><{name('div', 'p', 'h1')}>{phrase(1, 4)}</div>{menu('nav') if rnd.random() < 0.5 else ''}</header>")
    if not head or rnd.random() < 0.6:
        parts.append(menu(name("nav", "nav", "div")))
    if rnd.random() < 0.35:
        parts.append(f'<div class="{name("cookie-notice", "notice", "alert banner", "consent", "newsletter")}"><p>{sentence()}</p><button>{phrase(1, 2)}</button></div>')
    if rnd.random() < 0.5:
        parts.append(f'<div class="{name("ad", "ads", "advert top", "ad-banner", "promo")}">{" ".join(sentence() for _ in range(rnd.randint(1, 2)))}</div>')
    if rnd.random() < 0.25:
        parts.append(f'<form class="search" action="/s"><label>{phrase(1, 2)}</label><input name=q><button>{phrase(1, 1)}</button></form>')
    side = rnd.random()
    if side < 0.2:
        parts.append(f'<{name("aside", "div")} class="sidebar"><h3>{phrase(1, 3)}</h3>{menu("div")}<p>{sentence()}</p></aside>')
    outer = name("article", "article", "article", "main", "main><article", "div class='content'", "div id=main class=post", "section class='entry-content'", "div")
    parts.append(f"<{outer}>")
    if rnd.random() < 0.85:
        say(title, name("<h1>{}</h1>", "<h1 class='entry-title'>{}</h1>", "<header><h1>{}</h1></header>"))
    article()
    if "article" in outer and rnd.random() < 0.3:
        parts.append(f'<footer class="{name("meta", "tags", "share")}"><a href=x>{phrase(1, 2)}</a> <a href=y>{phrase(1, 2)}</a></footer>')
    parts.append("</article></main>" if "main><article" in outer else f"</{outer.split()[0]}>")
    if 0.2 <= side < 0.4:
        parts.append(f'<{name("aside", "div")} class="{name("sidebar", "side", "related posts")}"><h3>{phrase(1, 3)}</h3><p>{sentence()}</p>{menu("div")}</aside>')
    if rnd.random() < 0.35:
        said = "".join(f'<{name("div", "li", "article")} class="comment"><b>{word()}</b><p>{" ".join(sentence() for _ in range(rnd.randint(1, 3)))}</p></div>' for _ in range(rnd.randint(1, 5)))
        parts.append(f'<{name("section", "div")} id="comments" class="{name("comments", "comment-list", "discussion")}"><h3>{phrase(1, 2)}</h3>{said}</section>')
        if rnd.random() < 0.5:
            parts.append(f"<form class='respond'><p>{sentence()}</p><textarea>{word()}</textarea></form>")
    if rnd.random() < 0.85:
        parts.append(f"<footer{name('', ' class="site-footer"', ' id=footer')}>{name('&copy; ', '', 'Copyright ')}{word()}.example &middot; {sentence()}{menu('div') if rnd.random() < 0.3 else ''}</footer>")
    return f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{margin:0}}</style><script>var t='<p>';</script></head><body>{''.join(parts)}</body></html>", "\n".join(main)


def labelled(page: str, text: str) -> tuple[list[Block], list[int]]:
    """The page's blocks, labelled by a walk along the lines of its main text."""
    found, lines, at = blocks(page), text.split("\n"), 0
    labels = []
    for b in found:
        hit = at < len(lines) and b.text == lines[at]
        labels.append(int(hit))
        at += hit
    return found, labels


@lru_cache(maxsize=1)
def trained(pages: int = TRAINING, seed: int = SEED) -> Field:
    rnd = random.Random(seed)
    return fit([labelled(*made_page(rnd)) for _ in range(pages)])


def main_text(html: str | None, field: Field) -> str:
    page = blocks(html)
    return "\n".join(b.text for b, y in zip(page, field.decode(page), strict=True) if y)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page; an empty text where no block is main text or the html is null.

    Character references are decoded, white space inside a block is one space, blocks are joined in page
    order by one newline. Repeated rows give repeated rows; other columns are left out.
    """
    field = pages.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = field.value
        for b in batches:
            texts = [main_text(h, model) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
