"""Main text of web pages by a linear-chain conditional random field over the leaf blocks of the DOM.

A leaf block is a run of text between boundaries of block elements, with the elements it stands in. Features
are tags, classes and ids of ancestors, the share of text in links, sizes, ends and a few words that boilerplate
uses. Labels are main text or not; blocks are decoded together by Viterbi.

Training pages are a bounded sample of the pages that mark their article (one ``article`` or ``main``): blocks
inside are main text, except those in navigation, asides, forms, footers and the like. As marked pages would teach
only their own marks, each is learned from in several skins too: the same blocks in other containers, and
menus, notices, adverts, forms, sidebars and reader comments whose sentences come from other sample pages. All pages
are then decoded whole.

Defined results: null and empty pages and pages without main text give an empty text; broken markup (unclosed
or crossed elements, comments and quotes) is read as far as it goes, what cannot be a tag is text; repeated rows each
get a row; time and memory grow in proportion to a page, however long or broken it is; white space is what Python's ``split``
takes for it, no-break spaces included; without any marked page the skins are filled with a fixed sentence; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StringType, StructField, StructType

from tagloom.llm.common import bounded_sample

#: Pages that are learned from, characters of each at most, skins of each, and passes over them.
TRAIN_PAGES, TRAIN_CHARS, SKINS, PASSES = 240, 200_000, 5, 4
#: Elements whose start and end separate blocks, that have no end, and whose content is no text; fixed values.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html iframe label legend li main menu nav ol option p pre section select summary table tbody td "
    "tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template textarea svg math object canvas iframe".split())
#: A start of the key closes an open element of the value.
CLOSES = {
    "p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, **{t: {"p"} for t in BLOCKS - {"li", "dt", "dd", "tr", "td", "th", "option", "body", "html", "head", "button", "label"}},
}
OUTSIDE = frozenset("nav aside footer form button select label dialog menu".split())
CUES = frozenset(
    "cookie cookies subscribe newsletter login register share comment comments reply advertisement sponsored privacy terms copyright rights "
    "menu search related more consent accept sign posted".split()
)
#: Where markup may start, the name of a tag, and what matters inside a tag.
_START, _NAME, _SPECIAL = re.compile(r"<(?:!--|[!?]|/?[A-Za-z])"), re.compile(r"[^\s/>]*"), re.compile(r"[>\"']")
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")


#: Elements that say nothing about their content.
PLAIN = frozenset("html body b i em strong span u font small".split())


class Node:
    """An open element, linked to the one around it. ``fresh`` are the features that no element around it has."""

    __slots__ = ("parent", "tag", "names", "fresh", "last", "marked", "hidden")

    def __init__(self, parent: Node | None, tag: str, names: tuple[str, ...], fresh: tuple[str, ...]):
        self.parent, self.tag, self.names, self.fresh = parent, tag, names, fresh
        above = parent.last if parent else ()
        self.last = above if tag in PLAIN else (*above[-1:], tag)
        self.marked = bool(names) or tag in OUTSIDE or (parent is not None and parent.marked)
        self.hidden = tag in ("head", "title") or (parent is not None and parent.hidden)

    def path(self) -> list[Node]:
        """From the outermost element to this one."""
        found, node = [], self
        while node is not None:
            found.append(node)
            node = node.parent
        return found[::-1]


class Block:
    __slots__ = ("text", "node", "linked")

    def __init__(self, text: str, node: Node | None, linked: int):
        self.text, self.node, self.linked = text, node, linked


def _tag_ends(page: str) -> Callable[[int], int]:
    """A function from the end of a tag's name to its closing bracket.

    That is the first one outside of quotes, or the very first where the quotes do not close. Places from which
    quotes were found not to close are remembered, so a page of such tags is passed over once for each place.
    """
    final = {c: page.rfind(c) for c in "\"'>"}
    open_ended: set[int] = set()

    def end_of(name_end: int) -> int:
        at, passed = name_end, []
        while at <= final[">"]:
            m = _SPECIAL.search(page, at)
            mark, start = m.group(), m.start()
            if mark == ">":
                return start
            if start == final[mark]:
                break
            at = page.find(mark, start + 1) + 1
            if at in open_ended:
                break
            passed.append(at)
        open_ended.update(passed)
        return page.find(">", name_end)

    return end_of


def blocks_of(page: str) -> list[Block]:
    """Leaf blocks in page order, each with the innermost element it stands in; one pass over the page."""
    found: list[Block] = []
    stack: list[tuple[Node, list[str]]] = []
    held: dict[str, int] = defaultdict(int)  # features of the open elements
    opened: dict[str, int] = defaultdict(int)  # open elements by tag
    blocks_at: list[int] = []  # places of block elements in the stack
    parts: list[str] = []
    state = {"links": 0, "linked": 0, "silent": 0}

    def flush() -> None:
        text = " ".join("".join(parts).split())
        node = stack[-1][0] if stack else None
        if text and not (node and node.hidden):
            found.append(Block(text, node, min(len(text), state["linked"])))
        parts.clear()
        state["linked"] = 0

    def say(data: str) -> None:
        if data and not state["silent"]:
            data = entities.unescape(data)
            parts.append(data)
            if state["links"]:
                state["linked"] += len(data.strip())

    def push(tag: str, names: tuple[str, ...]) -> None:
        own = ([] if tag in PLAIN else [f"in:{tag}"]) + [f"name:{n}" for n in dict.fromkeys(names)]
        node = Node(stack[-1][0] if stack else None, tag, names, tuple(f for f in own if not held[f]))
        for f in own:
            held[f] += 1
        opened[tag] += 1
        if tag in BLOCKS:
            blocks_at.append(len(stack))
        stack.append((node, own))
        state["links"] += tag == "a"
        state["silent"] += tag in SILENT

    def drop(size: int) -> None:
        while len(stack) > size:
            node, own = stack.pop()
            for f in own:
                held[f] -= 1
            opened[node.tag] -= 1
            if node.tag in BLOCKS:
                blocks_at.pop()
            state["links"] -= node.tag == "a"
            state["silent"] -= node.tag in SILENT

    end_of, last_end = _tag_ends(page), page.rfind(">")
    at = said = 0
    while (m := _START.search(page, at)) is not None:
        start, opening, tag = m.start(), m.group(), ""
        if opening == "<!--":
            at = page.find("-->", m.end()) + 3
            at = at if at > 2 else len(page)
        elif start > last_end:  # no tag ends any more, but comments still may
            at = m.end()
            continue
        elif opening in ("<!", "<?"):
            at = page.find(">", m.end()) + 1
        else:
            name = _NAME.match(page, m.end() - 1)
            stop = end_of(name.end())
            tag, attributes, at = name.group().lower(), page[name.end() : stop], stop + 1
        say(page[said:start])
        said = at
        if not tag:
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCKS:
            flush()
        if opening[1] == "/":
            if opened[tag]:
                drop(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0].tag == tag))
            continue
        if blocks_at and stack[blocks_at[-1]][0].tag in CLOSES.get(tag, ()):
            drop(blocks_at[-1])
        if tag in VOID:
            continue
        if tag in ("script", "style", "textarea"):  # their content has no tags
            stop = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            if stop is None:
                said = len(page)
                break
            at = said = page.find(">", stop.start()) + 1 or len(page)
            continue
        if attributes.rstrip().endswith("/") and tag in SILENT:
            continue
        push(tag, tuple(w for g in _NAMED.findall(attributes) for w in _WORD.findall("".join(g).lower())))
    say(page[said:])
    flush()
    return found


def _size(n: int, steps: tuple[int, ...]) -> int:
    return sum(n >= s for s in steps)


def _place(node: Node | None) -> list[str]:
    """Features of the innermost elements and of the whole path, which are not handed down."""
    last = node.last if node else ()
    return [f"last:{'>'.join(last[-1:])}", f"two:{'>'.join(last)}", "marked" if node and node.marked else "plain"]


def own_features(blocks: list[Block]) -> list[list[str]]:
    """Names of the features that each block has by its text and place in the page."""
    rows = []
    for i, b in enumerate(blocks):
        words = b.text.split()
        size = _size(len(words), (2, 4, 8, 16, 32, 64))
        share = _size(10 * b.linked // len(b.text), (1, 4, 8))
        row = [f"size:{size}", f"links:{share}", f"size:{size}:links:{share}", f"end:{b.text[-1] in '.!?:…\"”»'}:{size > 2}"]
        row += [f"cue:{w}" for w in sorted(CUES.intersection(_WORD.findall(b.text.lower())))] if len(words) < 40 else []
        if any(c in b.text for c in "©®·|»"):
            row.append("sign")
        if i == 0:
            row.append("first")
        if i == len(blocks) - 1:
            row.append("final")
        row.append("bias")
        rows.append(row)
    return rows


def features(blocks: list[Block]) -> list[list[str]]:
    """All features of each block, those of its elements first; for learning, where pages are bounded."""
    rows = own_features(blocks)
    return [[*(f for n in (b.node.path() if b.node else ()) for f in n.fresh), *_place(b.node), *row] for b, row in zip(blocks, rows, strict=True)]


class Chain:
    """A two-label linear-chain field: weights per feature (for label 1 against 0) and per pair of labels."""

    def __init__(self):
        self.weights: dict[str, float] = {}
        self.pairs = [[0.0, 0.0], [0.0, 0.0]]

    def _unary(self, rows: list[list[str]]) -> list[float]:
        get = self.weights.get
        return [sum([get(f, 0.0) for f in row]) for row in rows]

    def block_scores(self, blocks: list[Block]) -> list[float]:
        """Summed weights of all features of each block; what elements hand down is summed once for each of them."""
        get = self.weights.get
        down: dict[Node | None, float] = {None: 0.0}
        here: dict[Node | None, float] = {}
        scores = []
        for b, own in zip(blocks, self._unary(own_features(blocks)), strict=True):
            if b.node not in here:
                climb, node = [], b.node
                while node not in down:
                    climb.append(node)
                    node = node.parent
                for node in reversed(climb):
                    down[node] = down[node.parent] + sum([get(f, 0.0) for f in node.fresh])
                here[b.node] = down[b.node] + sum([get(f, 0.0) for f in _place(b.node)])
            scores.append(here[b.node] + own)
        return scores

    def decode(self, rows: list[list[str]]) -> list[int]:
        """The likeliest labels of rows of features."""
        return self.viterbi(self._unary(rows))

    def viterbi(self, unary: list[float]) -> list[int]:
        """The likeliest labels of blocks with these scores."""
        pairs, back = self.pairs, []
        a0, a1 = 0.0, unary[0]
        for u in unary[1:]:
            s00, s10, s01, s11 = a0 + pairs[0][0], a1 + pairs[1][0], a0 + pairs[0][1], a1 + pairs[1][1]
            back.append((s10 > s00, s11 > s01))
            a0, a1 = max(s00, s10), max(s01, s11) + u
        labels = [int(a1 > a0)]
        for choice in reversed(back):
            labels.append(int(choice[labels[-1]]))
        return labels[::-1]

    def _marginals(self, unary: list[float]) -> tuple[np.ndarray, np.ndarray]:
        n, t = len(unary), np.exp(np.array(self.pairs))
        local = np.column_stack([np.ones(n), np.exp(np.clip(unary, -30, 30))])
        local /= local.sum(axis=1, keepdims=True)
        ahead, behind = np.empty((n, 2)), np.ones((n, 2))
        ahead[0] = local[0] / local[0].sum()
        for i in range(1, n):
            ahead[i] = (ahead[i - 1] @ t) * local[i]
            ahead[i] /= ahead[i].sum()
        for i in range(n - 2, -1, -1):
            behind[i] = t @ (local[i + 1] * behind[i + 1])
            behind[i] /= behind[i].sum()
        single = ahead * behind
        single /= single.sum(axis=1, keepdims=True)
        double = ahead[:-1, :, None] * t[None] * (local[1:] * behind[1:])[:, None, :]
        return single, double / double.sum(axis=(1, 2), keepdims=True)

    def learn(self, pages: list[tuple[list[list[str]], list[int]]], passes: int = PASSES, rate: float = 0.4, decay: float = 2e-3) -> Chain:
        """Maximum likelihood by gradient steps page by page, step sizes adapted to each feature."""
        squares: dict[str, float] = defaultdict(float)
        pair_squares = np.full((2, 2), 1e-3)
        order, rng = list(range(len(pages))), random.Random(7)
        for _ in range(passes):
            rng.shuffle(order)
            for k in order:
                rows, labels = pages[k]
                single, double = self._marginals(self._unary(rows))
                slope: dict[str, float] = defaultdict(float)
                for row, label, p in zip(rows, labels, single[:, 1].tolist(), strict=True):
                    for f in row:
                        slope[f] += label - p
                for f, g in slope.items():
                    g -= decay * self.weights.get(f, 0.0)
                    squares[f] += g * g
                    self.weights[f] = self.weights.get(f, 0.0) + rate * g / (squares[f] + 1e-3) ** 0.5
                pair = -double.sum(axis=0)
                for a, b in zip(labels, labels[1:], strict=False):
                    pair[a, b] += 1
                pair_squares += pair * pair
                self.pairs = (np.array(self.pairs) + rate * pair / np.sqrt(pair_squares)).tolist()
        return self


def marked_labels(blocks: list[Block]) -> list[int]:
    """Labels of a page that marks its article: inside it and in nothing that stands beside the text."""
    labels = []
    for b in blocks:
        path = b.node.path() if b.node else []
        tags = [n.tag for n in path]
        inside = next((k for k, t in enumerate(tags) if t in ("article", "main")), None)
        labels.append(int(inside is not None and not OUTSIDE & set(tags[inside:]) and not BESIDE & {w for n in path[inside + 1 :] for w in n.names}))
    return labels


#: Class and id words of containers, by what they hold; used to make skins.
ARTICLE = [
    "article", "main", "div class=content", "div id=main-content", "div class=post", "div class='entry-content'", "section class=story",
    "div class='article-body'", "div", "section", "td", "div id=content", "div class='post-body'", "div class='page text'", "main id=main",
]
BOILER = {
    "menu": ["nav", "div class=menu", "div class=navbar", "ul class=navigation", "div id=nav", "div class=breadcrumb", "div class='top-links'", "ul"],
    "header": ["header", "div id=header", "div class=masthead", "div class='site-header'", "div class=topbar", "div class=banner"],
    "footer": ["footer", "div class=footer", "div id=footer", "div class='site-footer'", "div class=bottom", "div class=copyright"],
    "sidebar": ["aside", "div class=sidebar", "div id=sidebar", "div class=related", "div class=widget", "section class=recommended", "div class=trending"],
    "notice": ["div class='cookie-notice'", "div class=consent", "div class=notice", "div class=alert", "div id=gdpr", "dialog", "div role=alert", "div class=popup", "div class=disclaimer"],
    "advert": ["div class=ad", "div class=ads", "div class=advert", "div class=advertisement", "div class=sponsored", "aside class=promo", "div id='ad-banner'", "ins class=adsbygoogle"],
    "form": ["form", "form class=search", "div class=newsletter", "div class=subscribe", "div class=login", "form id=signup"],
    "comments": ["section class=comments", "div id=comments", "ol class=commentlist", "div class='comment-section'", "section id=respond", "div class=discussion", "div class=replies"],
    "share": ["div class=share", "div class=social", "ul class='share-buttons'", "div class=tags", "div class=byline", "div class=meta"],
}
BESIDE = frozenset(w for skins in BOILER.values() for s in skins for w in _WORD.findall(s.partition("=")[2].lower()) if w not in ("top", "site", "section", "bottom", "meta", "tags"))


def _wrap(container: str, body: str) -> str:
    return f"<{container}>{body}</{container.split()[0]}>"


def _boiler(kind: str, rng: random.Random, sentence) -> str:
    few = lambda n: " ".join(sentence().split()[:n])
    esc = entities.escape
    if kind in ("menu", "share"):
        items = "".join(f"<li><a href=/x>{esc(few(rng.randint(1, 3)))}</a></li>" for _ in range(rng.randint(2, 7)))
        body = items if rng.random() < 0.3 else f"<ul>{items}</ul>"
    elif kind == "header":
        body = f"<{rng.choice(['h1', 'h2', 'div', 'p'])}>{esc(few(3))}</p><a href=/>{esc(few(2))}</a>"
        body = body.replace("</p>", f"</{body[1:body.index('>')]}>")
    elif kind == "footer":
        body = rng.choice([f"&copy; {esc(few(3))} &middot; {esc(few(6))}", f"<p>{esc(sentence())}</p><p><a href=/t>{esc(few(2))}</a></p>", f"<p>Copyright 2020 {esc(few(4))}. All rights reserved.</p>"])
    elif kind == "form":
        body = f"<label>{esc(few(3))}</label><input name=q><p>{esc(few(9))}</p><button>{esc(few(1))}</button>"
    elif kind == "comments":
        body = "<h3>Comments</h3>" * rng.randint(0, 1) + "".join(
            _wrap(rng.choice(["div class=comment", "li", "div", "article class=comment"]), f"<b>{esc(few(2))}</b><p>{esc(' '.join(sentence() for _ in range(rng.randint(1, 3))))}</p>")
            for _ in range(rng.randint(1, 4))
        )
    elif kind == "sidebar":
        body = f"<h3>{esc(few(3))}</h3>" + "".join(rng.choice([f"<p>{esc(sentence())}</p>", f"<li><a href=/y>{esc(few(6))}</a></li>"]) for _ in range(rng.randint(1, 4)))
    else:
        body = rng.choice([esc(sentence()), f"<p>{esc(sentence())}</p>", f"<p>{esc(few(12))}</p><button>OK</button>"])
    return _wrap(rng.choice(BOILER[kind]), body)


def skin(main: list[tuple[str, str]], rng: random.Random, sentence) -> tuple[list[Block], list[int]]:
    """A page of (tag, text) main blocks in drawn containers among drawn boilerplate, and its labels."""
    inner = []
    for tag, text in main:
        drawn = rng.random()
        if tag == "p" and drawn < 0.1:  # texts also hold headings, lists, quotations and tables
            heading = rng.choice(["h2", "h3", "h4"])
            inner.append(f"<{heading}>\x01{entities.escape(' '.join(sentence().split()[: rng.randint(1, 7)]))}</{heading}>")
        elif tag == "p" and drawn < 0.18:
            items = [" ".join(sentence().split()[: rng.randint(2, 40)]) for _ in range(rng.randint(2, 5))]
            inner.append(_wrap(rng.choice(["ul", "ol"]), "".join(f"<li>\x01{entities.escape(i)}</li>" for i in items)))
        elif tag == "p" and drawn < 0.22:
            cells = [" ".join(sentence().split()[: rng.randint(1, 5)]) for _ in range(rng.randint(2, 6))]
            inner.append("<table><tr>" + "".join(f"<td>\x01{entities.escape(c)}</td>" for c in cells) + "</tr></table>")
        if tag == "p" and drawn > 0.94:
            tag = rng.choice(["blockquote", "pre", "figcaption", "dd"])
        inner.append(f"<{tag}>\x01{entities.escape(text)}</{tag}>")
        if rng.random() < 0.1:
            inner.append(_boiler(rng.choice(["advert", "share", "form", "sidebar", "notice"]), rng, sentence))
    body = _wrap(rng.choice(ARTICLE), "".join(inner))
    for _ in range(rng.randint(0, 2)):
        body = _wrap(rng.choice(["div", "div class=wrapper", "div id=page", "section", "div class=container", "main", "div class=row"]), body)
    before = [_boiler(k, rng, sentence) for k in ("header", "menu", "notice", "advert", "form", "sidebar") if rng.random() < 0.5]
    after = [_boiler(k, rng, sentence) for k in ("share", "comments", "sidebar", "advert", "form", "notice", "menu", "footer") if rng.random() < 0.55]
    rng.shuffle(before)
    blocks = blocks_of("<html><body>" + "".join(before) + body + "".join(after))
    labels = [int(b.text.startswith("\x01")) for b in blocks]
    for b in blocks:
        b.text = b.text.lstrip("\x01") or "."
    return blocks, labels


def train(pages: list[str]) -> Chain:
    """A field from marked pages and their skins."""
    rng, examples, mains = random.Random(11), [], []
    for page in pages:
        blocks = blocks_of(page)
        labels = marked_labels(blocks)
        if blocks and sum(labels):
            examples.append((features(blocks), labels))
            mains.append([(b.node.tag if b.node and b.node.tag in ("h1", "h2", "h3", "p", "li", "blockquote") else "p", b.text) for b, y in zip(blocks, labels, strict=True) if y])
    if not mains:
        mains = [[("h1", "A plain heading")] + [("p", "This is a sentence of the text, and here it ends. " * k) for k in (1, 3, 2, 5)]] * 60
    pool = [s for main in mains for _, text in main for s in re.split(r"(?<=[.!?]) ", text) if s.strip()]
    sentence = lambda: rng.choice(pool)
    for main in mains:
        for _ in range(SKINS):
            blocks, labels = skin(main, rng, sentence)
            examples.append((features(blocks), labels))
    return Chain().learn(examples)


def main_text(chain: Chain, page: str) -> str:
    blocks = blocks_of(page)
    if not blocks:
        return ""
    return "\n\n".join(b.text for b, y in zip(blocks, chain.viterbi(chain.block_scores(blocks)), strict=True) if y)


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> Chain:
    """Train on at most TRAIN_PAGES marked pages, chosen by a hash of their ids."""
    marked = pages.select(F.col(id_col).alias("_id"), F.col(html_col).alias("_html")).where(
        (F.length("_html") <= TRAIN_CHARS) & (F.size(F.regexp_extract_all("_html", F.lit(r"(?i)<(article|main)[\s>]"), F.lit(0))) == 1)
    )
    drawn = bounded_sample(marked, pages.count(), TRAIN_PAGES, "_id").collect()
    return train([r["_html"] for r in drawn])


def extract(pages: DataFrame, chain: Chain, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Per page: its id and text."""
    sent = pages.sparkSession.sparkContext.broadcast(chain)  # weights of some hundreds of features
    kind = pages.schema[id_col].dataType
    arrow_kind = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(sent.value, page.as_py() or "") for page in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(arrow_kind), pa.array(texts, pa.string())], [id_col, "text"])

    return pages.select(id_col, html_col).mapInArrow(run, StructType([StructField(id_col, kind), StructField("text", StringType())]))
