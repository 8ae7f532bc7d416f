"""Main text of web pages: boosted trees over the features of DOM nodes, and a consistent choice over the tree.

A node's label is 1 if it or a node below it holds main text. The trees give each node's log-odds from its own and its
subtree's text, links, attribute tokens, depth and siblings. What a token speaks for is learnt, too: each hashes to a slot
whose weight is the log ratio of labels seen with it. A page's labels are then the likeliest ones in which no node is
1 below a node that is 0, found from the leaves up. Kept is the own text of nodes labelled 1, block by block.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, lru_cache
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.llm.boosting import BoostedTrees

MARKUP = re.compile(r"<!--(?:.*?-->|.*)|<[!?][^>]*+>?|</?[a-zA-Z](?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+>?", re.DOTALL)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"(?:^|\s)(?:class|id|role|itemprop|aria-label|data-[\w-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
HIDDEN = re.compile(r"\shidden(?:[\s=>/]|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.IGNORECASE)
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Elements without content, elements whose content is no text, and elements that begin a block.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style iframe textarea title".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = set("table ul ol dl article section div body nav aside header footer form main td th".split())

#: Slots of attribute tokens.
SLOTS = 4096
#: Element groups, one feature each.
GROUPS = [{"p"}, {"h1", "h2", "h3", "h4", "h5", "h6"}, {"li", "dt", "dd"}, {"ul", "ol", "dl"}, {"div"}, {"section"}, {"article", "main"}, {"nav", "menu"}, {"header"}, {"footer"}, {"aside"}, {"form", "button", "label", "fieldset", "input"}, {"table", "tbody", "tr", "td", "th"}, {"a"}, {"span", "b", "i", "em", "strong", "u", "small", "font", "code"}, {"blockquote", "pre", "figure"}, {"body", "html"}]
GROUP_OF = {tag: i for i, tags in enumerate(GROUPS) for tag in tags}


@lru_cache(maxsize=50_000)
def slot(token: str) -> int:
    return zlib.crc32(token.encode()) % SLOTS


class Page:
    """The nodes of a page in document order, and its text runs as (node, block, text) with references decoded."""

    __slots__ = ("tags", "parents", "tokens", "hidden", "runs", "size", "_stack", "_open", "_scopes")

    def __init__(self, source: str) -> None:
        self.tags, self.parents, self.tokens, self.hidden = ["html"], [-1], [()], [False]
        self.runs: list[tuple[int, int, str]] = []
        self.size = max(1, len(source))
        self._stack, self._open, self._scopes = [0], {}, []  # open nodes, their places by name, and the places of scopes
        block, at = 0, 0
        while at < len(source):
            begin = source.find("<", at)
            match = MARKUP.match(source, begin) if begin >= 0 else None
            if match is None:  # text up to the next possible tag, a lone "<" included
                end = len(source) if begin < 0 else begin + 1
                self._text(self._stack[-1], block, source[at:end])
                at = end
                continue
            if begin > at:
                self._text(self._stack[-1], block, source[at:begin])
            at, markup = match.end(), match[0]
            if markup.startswith("<!"):
                continue
            name = NAME.match(markup)
            if name is None:
                continue
            tag = name[1].lower()
            if tag in BLOCK:
                block += 1
            if markup[1] == "/":
                self._close(tag)
                continue
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}(?:[\s/>]|$)", re.IGNORECASE).search(source, at)
                at = close.start() if close else len(source)
                continue
            if tag == "br":
                self._text(self._stack[-1], block, " ")
            if tag in VOID or tag in ("html", "head"):
                continue
            self._imply(tag)
            tokens = {t.lower() for a in ATTRIBUTE.findall(markup) for t in TOKEN.findall(" ".join(a))} if "=" in markup else ()
            self.tags.append(tag)
            self.parents.append(self._stack[-1])
            self.tokens.append(tuple(sorted({slot(t) for t in tokens})))
            self.hidden.append(tag == "template" or HIDDEN.search(markup) is not None)
            if not markup.endswith("/>"):
                self._push(tag)

    def _text(self, node: int, block: int, text: str) -> None:
        self.runs.append((node, block, html.unescape(text) if "&" in text else text))

    def _close(self, tag: str) -> None:
        """End the innermost open element of this name, unless a scope that its end tag can't leave lies between."""
        places = self._open.get(tag)
        if places and (tag in SCOPE or not self._scopes or self._scopes[-1] <= places[-1]):
            self._cut(places[-1])

    def _imply(self, tag: str) -> None:
        """Close all that ``tag`` ends without an end tag: an open paragraph before a block, an item and its rest before the next."""
        ends = [*CLOSES.get(tag, ()), *(("p",) if tag in BLOCK else ())]
        while places := [self._open[e][-1] for e in ends if self._open.get(e)]:
            inner = max(places)
            if self._scopes and self._scopes[-1] > inner:
                return
            self._cut(inner)

    def _push(self, tag: str) -> None:
        self._open.setdefault(tag, []).append(len(self._stack))
        if tag in SCOPE:
            self._scopes.append(len(self._stack))
        self._stack.append(len(self.tags) - 1)

    def _cut(self, place: int) -> None:
        """Close all open elements from this place of the stack on."""
        while len(self._stack) > place:
            own = self.tags[self._stack.pop()]
            self._open[own].pop()
            if own in SCOPE:
                self._scopes.pop()


def features(page: Page, weights: np.ndarray) -> np.ndarray:
    """A row for each node; see the names of the columns at the end. ``weights`` has one number a token slot."""
    n = len(page.tags)
    parents, tags = page.parents, page.tags
    own, marks, position = [0] * n, [0] * n, [-1] * n
    total = 0
    for node, _, text in page.runs:
        if size := len(text.strip()):
            own[node] += size
            marks[node] += text.count(",") + text.count(".")
            if position[node] < 0:
                position[node] = total
            total += size
    text, links, below, dots, first = own[:], [own[i] if tags[i] == "a" else 0 for i in range(n)], [1] * n, marks[:], position[:]
    children, paragraphs = [0] * n, [1 if t == "p" else 0 for t in tags]
    for i in range(n - 1, 0, -1):
        p = parents[i]
        if tags[i] == "a":
            links[i] = text[i]
        text[p] += text[i]
        links[p] += links[i]
        below[p] += below[i]
        dots[p] += dots[i]
        paragraphs[p] += paragraphs[i]
        children[p] += 1
        if first[i] >= 0 and (first[p] < 0 or first[i] < first[p]):
            first[p] = first[i]
    depth, against, place, seen, link, hidden, article = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    said, path, worst, best = [0.0] * n, [0.0] * n, [0.0] * n, [0.0] * n
    plain = {7, 9, 10, 11}
    for i in range(n):
        p = parents[i]
        group = GROUP_OF.get(tags[i], -1)
        if p >= 0:
            depth[i], against[i] = depth[p] + 1, against[p] + (group in plain)
            place[i], link[i] = seen[p], link[p] or tags[i] == "a"
            seen[p] += 1
            hidden[i] = hidden[p] or page.hidden[i]
            article[i] = article[p] or group == 6
            path[i], worst[i], best[i] = path[p], worst[p], best[p]
        if page.tokens[i]:
            spoken = [weights[t] for t in page.tokens[i]]
            said[i] = sum(spoken)
            path[i] += said[i]
            worst[i], best[i] = min(worst[i], *spoken), max(best[i], *spoken)
    size = np.array([own, text, links, below, dots, children, paragraphs], float)
    up = np.maximum(np.array(parents), 0)
    whole = max(1, text[0])
    columns = [np.log1p(size[0]), np.log1p(size[1]), size[2] / np.maximum(1, size[1]), size[1] / size[3], size[4] / np.maximum(1, size[1]), size[5], size[6], size[1] / whole, size[1] / np.maximum(1, size[1][up]), np.array(first, float) / whole, np.array(place, float), np.array(place, float) / np.maximum(1, size[5][up]), np.array(depth, float), np.array(against, float), np.array(said), np.array(path), np.array(worst), np.array(best), np.array([len(t) for t in page.tokens], float), np.array(link, float), np.array(hidden, float), np.array(article, float), size[2][up] / np.maximum(1, size[1][up]), np.log1p(size[1][up]), np.array([GROUP_OF.get(t, -1) for t in tags], float)]
    kinds = np.zeros((n, len(GROUPS)))
    known = [(i, g) for i, t in enumerate(tags) if (g := GROUP_OF.get(t, -1)) >= 0]
    for i, g in known:
        kinds[i, g] = 1
    return np.column_stack([*columns, kinds])


def consistent(parents: list[int], odds: list[float]) -> list[bool]:
    """The likeliest labels with no 1 below a 0, for log-odds of each node; parents come before their children."""
    n = len(parents)
    gain = list(odds)  # of label 1 over label 0 for the whole subtree
    for i in range(n - 1, 0, -1):
        if gain[i] > 0:
            gain[parents[i]] += gain[i]
    label = [gain[0] > 0] * n
    for i in range(1, n):
        label[i] = label[parents[i]] and gain[i] > 0
    return label


def kept_text(page: Page, label: list[bool]) -> str:
    """Own text of nodes labelled 1: white space within a block as one space, blocks joined by a line end."""
    blocks: list[list[str]] = []
    last = -1
    for node, block, text in page.runs:
        if label[node]:
            if block != last:
                blocks.append([])
                last = block
            blocks[-1].append(text)
    return "\n".join(b for parts in blocks if (b := " ".join("".join(parts).split())))


# --- training pages ---------------------------------------------------------------------------------------------------


def _words(rng: Random, n: int, han: bool = False) -> str:
    out, rest = [], n
    while rest > 0:
        k = min(rest, rng.randint(4, 18))
        if han:
            out.append("".join(chr(0x4E00 + int(rng.random() ** 2 * 3000)) for _ in range(2 * k)) + rng.choice("。。。？！，"))
            rest -= k
            continue
        words = ["".join(rng.choice("aeiou" if j % 2 else "bcdfglmnprstv") for j in range(rng.randint(2, 9))) for _ in range(k)]
        out.append(" ".join(words).capitalize() + rng.choice([".", ".", ".", "?", "!", ","]))
        rest -= k
    return " ".join(out)


def training_page(seed: int) -> str:
    """A made page whose main text nodes carry the attribute ``x-main``, in one of many layouts.

    Tokens mislead on a part of the pages: names of other parts stand on main text, and those of main text elsewhere. Others
    have no class, id or role at all, or only ones without meaning.
    """
    rng = Random(seed)
    han, plain = rng.random() < 0.15, rng.random() < 0.25
    pick, words = rng.choice, lambda a, b: _words(rng, rng.randint(a, b), han).rstrip(".。" if b <= 3 else "")
    links = lambda k: "".join(f'<li><a href="/{i}">{words(1, 3)}</a></li>' for i in range(k))
    nav = pick(['<nav><ul>{}</ul></nav>', '<div class="nav menu"><ul>{}</ul></div>', '<ul id="navigation">{}</ul>', '<header class="site-header"><a href="/">Home</a><ul>{}</ul></header>', '<div id="top-bar" role="navigation"><ul>{}</ul></div>', '<div><ul>{}</ul></div>', "<ul>{}</ul>", "<div>" + words(1, 1) + "<ul>{}</ul></div>"]).format(links(rng.randint(3, 10)))
    anchors = lambda k, by: by.join(f'<a href="/{i}">{words(1, 2)}</a>' for i in range(k))
    nav = pick([nav, nav, nav, f'<div>{anchors(rng.randint(1, 8), pick([" ", " | ", "<br>"]))}</div>', f'<div><a href="/">{words(1, 1)}</a></div>', f"<div>{words(1, 2)}</div>", f'<center>{anchors(rng.randint(2, 6), " - ")}</center>', f"<div>{''.join(f'<div>{words(1, 1)}</div>' for _ in range(rng.randint(1, 6)))}</div>"])
    small = [
        lambda: f'<div class="{pick(["ad", "ads", "advert", "banner", "sponsored", "promo-box"])}">{words(3, 40)}</div>',
        lambda: f'<div id="cookie-{pick(["notice", "banner", "consent"])}"><p>{words(8, 40)}</p><button>{words(1, 2)}</button></div>',
        lambda: f'<form action="/s" class="{pick(["search", "newsletter", "login"])}"><label>{words(1, 4)}</label><input name="q"><p>{words(3, 12)}</p><button>{words(1, 2)}</button></form>',
        lambda: f'<div class="{pick(["share", "social", "related", "recommended", "tags", "breadcrumb"])}"><span>{words(1, 4)}</span><ul>{links(rng.randint(2, 6))}</ul></div>',
        lambda: f'<p class="{pick(["notice", "disclaimer", "copyright"])}">{words(5, 30)}</p>',
        lambda: f'<div class="modal popup" style="display:none"><p>{words(5, 40)}</p></div>',
    ]
    if plain:  # without names, only what shape or place tells apart
        small = [small[2], small[5], lambda: f"<div><ul>{links(rng.randint(2, 6))}</ul></div>", lambda: f"<div>{anchors(rng.randint(2, 5), ' ')}</div>"]
    side = "<aside>{}</aside>" if plain else pick(['<aside>{}</aside>', '<div class="sidebar">{}</div>', '<div id="right-rail" class="widget">{}</div>', '<section class="widget-area">{}</section>']).format(f"<h3>{words(1, 4)}</h3><p>{words(5, 60)}</p><ul>{links(rng.randint(2, 8))}</ul>")
    foot = pick(['<footer>{}</footer>', '<div class="footer">{}</div>', '<div id="foot"><p>{}</p></div>', '<div role="contentinfo">{}</div>']).format(f"&copy; {words(3, 40)}" + pick(["", f'<a href="/p">{words(1, 2)}</a>']))
    comment = lambda: pick([f'<li class="comment"><b>{words(1, 2)}</b><p>{words(5, 80)}</p></li>', f'<div class="reply"><span>{words(1, 2)}</span><p>{words(5, 80)}</p></div>', f"<article><header>{words(1, 3)}</header><p>{words(5, 60)}</p></article>"])
    comments = pick(['<section id="comments"><h2>{}</h2>{}</section>', '<div class="comments-area"><h3>{}</h3>{}</div>', '<ol class="comment-list"><li>{}</li>{}</ol>']).format(words(1, 3), "".join(comment() for _ in range(rng.randint(1, 6))))
    body, n = [], pick([1, 2, 3, 5, 8, 14])
    if rng.random() < 0.8:
        body.append(f"<{(h := pick(['h1', 'h1', 'h2']))} x-main>{words(2, 14)}</{h}>")
    for _ in range(n):
        kind = rng.random()
        if kind < 0.7:
            inner = words(*pick([(1, 4), (10, 60), (30, 160)]))
            inner = pick([inner, inner, f"<b x-main>{inner}", f"<b x-main>{inner}</b>", f'{inner} <a x-main href="/x">{words(1, 3)}</a> {words(3, 20)}', f"<em x-main>{words(1, 3)}</em> {inner}"])
            body.append(f"<p x-main>{inner}" + pick(["</p>", "</p>", "<br>", ""]))
        elif kind < 0.78:
            body.append("<ul x-main>" + "".join(f"<li x-main>{words(2, 25)}</li>" for _ in range(rng.randint(2, 6))) + "</ul>")
        elif kind < 0.84:
            body.append(f"<blockquote x-main><p x-main>{words(8, 60)}</p></blockquote>")
        elif kind < 0.9:
            body.append(f"<{(h := pick(['h2', 'h3']))} x-main>{words(1, 8)}</{h}>")
        elif kind < 0.95:
            body.append("<table x-main>" + "".join(f"<tr x-main><td x-main>{words(1, 6)}</td><td x-main>{words(1, 12)}</td></tr>" for _ in range(rng.randint(1, 5))) + "</table>")
        else:
            body.append(pick(small)())
    main = pick(["<article x-main>{}</article>", "<article x-main>{}</article>", '<main x-main><article x-main class="post">{}</article></main>', '<div x-main class="content">{}</div>', '<div x-main id="main-content"><div x-main class="entry-content">{}</div></div>', '<section x-main class="story-body">{}</section>', "<div x-main><div x-main>{}</div></div>", '<td x-main class="text">{}</td>'])
    if main.startswith("<td"):
        beside = pick([links(rng.randint(1, 6)), words(1, 2), f"{words(1, 2)}<br>{anchors(rng.randint(1, 6), '<br>')}", anchors(rng.randint(1, 5), " ")])
        main = f"<table x-main><tr x-main><td>{beside}</td>{main}</tr></table>"
    inside = "".join(body) + (pick(small)() if rng.random() < 0.2 else "") + (comments if (held := rng.random() < 0.1 and not plain) else "")
    parts = [nav, *(pick(small)() for _ in range(rng.randint(0, 3))), main.format(inside), *(pick(small)() for _ in range(rng.randint(0, 2)))]
    if rng.random() < 0.5:
        parts.insert(rng.randint(1, len(parts)), side)
    if rng.random() < 0.4 and not held and not plain:
        parts.append(comments)
    if rng.random() < 0.9:
        parts.append(foot)
    inner = "".join(parts)
    inner = pick(["{}", "{}", '<div x-main class="page">{}</div>', '<div x-main id="wrapper"><div x-main class="container">{}</div></div>']).format(inner)
    inner = re.sub(r' (?:class|id|role)="[^"]*"', "", inner) if plain else _misled(rng, inner)
    return f"<!DOCTYPE html><html><head><title>{words(2, 8)}</title><style>p{{margin:0}}</style></head><body x-main>{inner}" + pick(["</body></html>", ""])


#: Tokens that the made pages deal out against their meaning.
STRAY = "ad header style free meta promo share top bottom tag related footer sidebar menu nav social sign up tool bar widget banner comment reply notice content post entry story body text main article page block box inner wrap grid col row item module light dark large small active first last".split()


def _misled(rng: Random, source: str) -> str:
    """The page with its tokens as they are, or with stray ones."""
    if rng.random() < 0.2:
        return source
    often = rng.choice([0.05, 0.15, 0.4])

    def stray(m: re.Match) -> str:
        if rng.random() >= often:
            return m[0]
        names = "-".join(rng.choice(STRAY) for _ in range(rng.randint(1, 2)))
        held = re.search(r'class="([^"]*)"', m[0])
        return m[0].replace(held[0], f'class="{held[1]} {names}"') if held else f'{m[1]} class="{names}"{m[2]}'

    return re.sub(r"(<(?:div|article|section|p|ul|td|main|aside|li|span|h[1-3])(?: x-main)?)([^>]*>)", stray, source)


@dataclass
class MainTextModel:
    """Weights of attribute tokens and the trees over the nodes' features."""

    weights: np.ndarray
    trees: BoostedTrees


@cache
def main_text_model(pages: int = 900) -> MainTextModel:
    """A model fitted on ``pages`` made pages, a third for the tokens and the rest for the trees; the same on every machine."""
    seen = np.full((2, SLOTS), 0.0)
    rest = []
    for seed in range(pages):
        marked, plain = _marked(training_page(seed))
        if seed % 3:
            rest.append((marked, plain))
            continue
        for label, tokens in zip(marked, plain.tokens, strict=True):
            seen[label, list(tokens)] += 1
    ratio = np.log((seen[1] + 2) / (seen[0] + 2)) - np.log((seen[1].sum() + 2) / (seen[0].sum() + 2))
    weights = np.where(seen.sum(axis=0) > 0, ratio, 0.0)
    labels = np.array([x for marked, _ in rest for x in marked], float)
    return MainTextModel(weights, BoostedTrees(rounds=80).fit(np.vstack([features(page, weights) for _, page in rest]), labels))


def _marked(source: str) -> tuple[list[int], Page]:
    """Whether each node of a made page was marked, and the page as it is without the marks."""
    plain = Page(source.replace(" x-main", ""))
    with_marks = Page(re.sub(r"<(\w+) x-main", r'<\1 data-x="xmainmark"', source))
    found = []
    names = iter(re.finditer(r"<(\w+)( x-main)?", source))
    for tag in with_marks.tags[1:]:
        for m in names:
            if m[1].lower() == tag:
                found.append(int(m[2] is not None))
                break
    return [1, *found], plain


def main_texts(sources: list[str], model: MainTextModel) -> list[str]:
    pages = [Page(s) for s in sources]
    if not pages:
        return []
    rows = [features(p, model.weights) for p in pages]
    odds = model.trees.log_odds(np.vstack(rows))
    out, at = [], 0
    for page, own in zip(pages, rows, strict=True):
        out.append(kept_text(page, consistent(page.parents, odds[at : at + len(own)].tolist())))
        at += len(own)
    return out


def extract_main_text(pages: DataFrame, source: str = "html", model: MainTextModel | None = None, key: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, url, text and n_chars (code points) of each row; a null or empty page has the empty text.

    Rows are independent; repeated rows and other columns change nothing. A page is parsed in one pass whose time and
    memory grow with its length; a long page is read whole.
    """
    held = pages.sparkSession.sparkContext.broadcast(model or main_text_model())

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                texts = main_texts([s or "" for s in piece.column(2).to_pylist()], held.value)
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(source).alias("html"))
    return rows.mapInArrow(extract, "page_id long, url string, text string, n_chars long")
