"""Main text of web pages: a linear-chain conditional random field over leaf blocks."""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafquire.llm.shared import table

#: The field is trained on at most this many pages, of at most so many characters in all, each laid out anew with known labels.
TRAIN_PAGES, TRAIN_CHARS = 400, 20_000_000
LAYOUTS = 3
STEPS = 120
FEATURES = 1 << 14

# HTML elements by their role in parsing.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = set("script style title textarea".split())  # raw text: skipped up to the end tag, or to the end of the page
FOREIGN = {"svg", "math"}
POINTS = set("foreignobject desc annotation-xml mi mo mn ms mtext".split())  # hold HTML inside svg and math
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup "
    "time tt u var wbr img input svg math".split()
)
CLOSES_P = set(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul figure details menu".split()
)
#: Start tags that end an open svg or math.
BREAKS_OUT = CLOSES_P | set("b big body br center code dd dt em embed head i img li meta nobr p ruby s small span strike strong sub sup tt u var tr td th".split())
#: An end tag left out is not looked for beyond these.
HOLDS = set("div table ul ol article section body blockquote main aside dl".split())
SAME_CLOSES = {"option": {"option"}, "optgroup": {"option", "optgroup"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}

_TOKEN = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>?""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_NAME = re.compile(r"[a-z]+")


class Node:
    """An open element. Blocks share their ancestors; what features ask of all of them is kept along the way."""

    __slots__ = ("tag", "names", "parent", "depth", "leaf", "inside", "linked", "drawn", "foreign", "in_foreign")

    def __init__(self, tag: str, names: frozenset[str], parent: Node | None):
        self.tag, self.names, self.parent = tag, names, parent
        up = parent or self
        self.depth = parent.depth + 1 if parent else 0
        self.leaf = "" if not parent else up.leaf if tag in INLINE else tag  # the innermost block element
        self.inside = bool(parent) and (up.inside or tag in ("article", "main"))
        self.linked = bool(parent) and (up.linked or tag == "a")
        self.drawn = bool(parent) and (up.drawn or tag == "svg")
        self.in_foreign = bool(parent) and (up.in_foreign or tag in FOREIGN)
        self.foreign = bool(parent) and (tag in FOREIGN or up.foreign and tag not in POINTS)


ROOT = Node("", frozenset(), None)


@dataclass
class Block:
    text: str
    node: Node
    linked: int  # characters inside links

    def _up(self) -> Iterator[Node]:
        node = self.node
        while node.parent:
            yield node
            node = node.parent

    @property
    def tags(self) -> tuple[str, ...]:
        """Ancestors, from the page down."""
        return tuple(n.tag for n in self._up())[::-1]

    @property
    def names(self) -> frozenset[str]:
        """Words of the ancestors' classes, ids and roles."""
        return frozenset().union(*(n.names for n in self._up()))


class Open:
    """The open elements, with the places of each tag, so that looking for one takes no walk."""

    def __init__(self):
        self.stack: list[Node] = []
        self.places: dict[str, list[int]] = {}
        self.holding: list[int] = []
        self.top = ROOT

    def push(self, tag: str, names: frozenset[str]) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in HOLDS:
            self.holding.append(len(self.stack))
        self.top = Node(tag, names, self.top)
        self.stack.append(self.top)

    def last(self, tag: str) -> int:
        """The place of the innermost open ``tag``, -1 if there is none."""
        at = self.places.get(tag)
        return at[-1] if at else -1

    def cut(self, depth: int) -> None:
        """Close all elements from place ``depth`` on."""
        while len(self.stack) > depth:
            node = self.stack.pop()
            self.places[node.tag].pop()
            if node.tag in HOLDS:
                self.holding.pop()
        self.top = self.stack[-1] if self.stack else ROOT


def _names(attributes: str) -> frozenset[str]:
    if "=" not in attributes:
        return frozenset()
    found: set[str] = set()
    for m in _ATTRIBUTE.finditer(attributes):
        found.update(_NAME.findall((m[2] or m[3] or m[4] or "").lower()))
    return frozenset(found)


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order, with white space folded and references decoded.

    Linear in the page, however deep its tags are nested and whether they are closed.
    """
    out: list[Block] = []
    open_ = Open()
    text: list[str] = []
    linked, where, frames = 0, ROOT, True

    def flush() -> None:
        nonlocal text, linked
        joined = " ".join("".join(text).split())
        if joined:
            out.append(Block(joined, where, linked))
        text, linked = [], 0

    def say(piece: str) -> None:
        nonlocal linked, where
        if not piece:
            return
        if text and where.drawn != open_.top.drawn:
            if not piece.strip():
                text.append(piece)
                return
            flush()  # a drawing's text is a block of its own
        if not text:
            where = open_.top
        piece = entities.unescape(piece)
        text.append(piece)
        if open_.top.linked:
            linked += len(piece.strip())

    at = 0
    while m := _TOKEN.search(page, at):
        say(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            depth = open_.last(name)
            if name not in INLINE and not (depth > 0 and open_.stack[depth - 1].in_foreign):
                flush()
            if depth >= 0:
                open_.cut(depth)
            continue
        empty = m[3].rstrip().endswith("/")
        if name in HIDDEN or name == "iframe" and frames:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            if name == "iframe" and not end:
                frames = False  # none of the following ones is closed either
            elif empty and open_.top.foreign:
                continue  # only inside a drawing or a formula a slash closes them
            else:
                at = end.end() if end else len(page)
                continue
        if open_.top.foreign:
            if name not in BREAKS_OUT:
                if not empty:
                    open_.push(name, _names(m[3]))
                continue
            while open_.top.foreign:
                open_.cut(len(open_.stack) - 1)
        elif name in FOREIGN and empty:
            continue
        if name not in INLINE:
            flush()
            closed = max(map(open_.last, SAME_CLOSES.get(name) or ({"p"} if name in CLOSES_P else ())), default=-1)
            if closed >= 0 and closed > (open_.holding[-1] if open_.holding else -1):
                open_.cut(closed)
        if name not in VOID:
            open_.push(name, _names(m[3]))
    say(page[at:])
    flush()
    return out


_slots: dict[str, int] = {}
_node_slots: dict[tuple[str, frozenset[str]], frozenset[int]] = {}


def _slot(feature: str) -> int:
    got = _slots.get(feature)
    if got is None:
        got = zlib.crc32(feature.encode()) % FEATURES
        if len(_slots) < 100_000:
            _slots[feature] = got
    return got


def _size(n: int) -> int:
    return min(n.bit_length(), 12)


class Ancestors:
    """The features that the current block's ancestors switch on, and the sum of their weights, moved from block to block."""

    def __init__(self, weights: tuple[list[float], list[float]] | None = None):
        self.path: list[Node] = []
        self.counts: dict[int, int] = {}
        self.weights, self.a, self.b = weights, 0.0, 0.0

    def _slots_of(self, node: Node) -> frozenset[int]:
        found = _node_slots.get((node.tag, node.names))
        if found is None:
            found = frozenset({_slot(f"tag={node.tag}"), *(_slot(f"name={x}") for x in node.names)})
            if len(_node_slots) < 20_000:
                _node_slots[node.tag, node.names] = found
        return found

    def move(self, node: Node) -> None:
        path, new = self.path, []
        while node.depth > len(path) or node.depth and path[node.depth - 1] is not node:
            new.append(node)
            node = node.parent
        counts, weights = self.counts, self.weights
        while len(path) > node.depth:
            for s in self._slots_of(path.pop()):
                counts[s] -= 1
                if not counts[s]:
                    del counts[s]
                    if weights:
                        self.a, self.b = self.a - weights[0][s], self.b - weights[1][s]
        for n in reversed(new):
            path.append(n)
            for s in self._slots_of(n):
                if s not in counts and weights:
                    self.a, self.b = self.a + weights[0][s], self.b + weights[1][s]
                counts[s] = counts.get(s, 0) + 1


def own_features(page: list[Block], i: int) -> list[int]:
    """The features of a block's place and text."""
    b = page[i]
    text, n = b.text, len(b.text)
    share, last = (round(4 * b.linked / n) if n else 0), b.node.leaf
    return [_slot(f) for f in (
        "always", f"leaf={last}", f"chars={_size(n)}", f"words={_size(text.count(' ') + 1)}", f"links={share}",
        f"leaf={last} chars={_size(n) // 2}", f"leaf={last} links={share > 1}",
        f"end={text[-1] in '.!?:;…。' if text else False}", f"mark={'©' in text or '|' in text[:40]}",
        f"first={i == 0}", f"final={i == len(page) - 1}", f"inside={b.node.inside}",
    )]


def features(page: list[Block]) -> list[list[int]]:
    """The active features of each block: ancestors, their names, and the text's shape. For training pages."""
    out, above = [], Ancestors()
    for i, b in enumerate(page):
        above.move(b.node)
        out.append([*above.counts, *own_features(page, i)])
    return out


@dataclass
class Field:
    """Weights of a chain with the labels 0 (left out) and 1 (main text)."""

    unary: np.ndarray  # features x 2
    step: np.ndarray  # label before x label
    start: np.ndarray
    lists: tuple[list[float], list[float]] | None = None  # ``unary`` once more, made where it is first used

    def decode(self, active: list[list[int]]) -> list[int]:
        """The best sequence of labels for blocks with these features."""
        if not active:
            return []
        lengths = np.fromiter(map(len, active), np.int64, len(active))
        return self.best(np.add.reduceat(self.unary[np.concatenate(active)], np.cumsum(lengths) - lengths).tolist())

    def label(self, page: list[Block]) -> list[int]:
        """The best sequence of labels for a page; ancestors' weights are summed once, not for each block."""
        if self.lists is None:
            self.lists = tuple(self.unary.T.tolist())
        a, b = self.lists
        above, scores = Ancestors(self.lists), []
        for i, block in enumerate(page):
            above.move(block.node)
            own = own_features(page, i)
            scores.append((above.a + sum(a[s] for s in own), above.b + sum(b[s] for s in own)))
        return self.best(scores)

    def best(self, scores: list) -> list[int]:
        """The sequence of labels with the greatest sum (Viterbi)."""
        if not scores:
            return []
        (a, b), (c, d) = self.step.tolist()
        x, y = scores[0][0] + self.start[0], scores[0][1] + self.start[1]
        back = []
        for s in scores[1:]:
            back.append((int(y + c > x + a), int(y + d > x + b)))
            x, y = max(x + a, y + c) + s[0], max(x + b, y + d) + s[1]
        label = int(y > x)
        path = [label]
        for pair in reversed(back):
            label = pair[label]
            path.append(label)
        return path[::-1]


def fit(pages: list[tuple[list[list[int]], list[int]]], steps: int = STEPS, penalty: float = 3e-4) -> Field:
    """Maximum likelihood with a quadratic penalty, by Adam on all pages at once."""
    pages = [p for p in pages if p[1]]
    unary, step, start = np.zeros((FEATURES, 2)), np.zeros((2, 2)), np.zeros(2)
    if not pages:
        return Field(unary, step, start)
    longest = max(len(y) for _, y in pages)
    widest = max(len(f) for x, _ in pages for f in x)
    index = np.full((len(pages), longest, widest), FEATURES, np.int64)
    gold = np.zeros((len(pages), longest, 2))
    there = np.zeros((len(pages), longest), bool)
    for p, (x, y) in enumerate(pages):
        for i, f in enumerate(x):
            index[p, i, : len(f)] = f
            gold[p, i, y[i]] = 1
            there[p, i] = True
    total = there.sum()
    both = there[:, 1:, None, None] * gold[:, :-1, :, None] * gold[:, 1:, None, :]
    used = np.unique(index[index < FEATURES])
    place = np.full(FEATURES + 1, len(used))
    place[used] = np.arange(len(used))
    flat = place[index]
    theta = np.zeros((len(used) + 1) * 2 + 6)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, steps + 1):
        w, t, s = theta[:-6].reshape(-1, 2), theta[-6:-2].reshape(2, 2), theta[-2:]
        score = w[flat].sum(2)
        score[:, 0] += s
        ahead = np.zeros_like(score)
        ahead[:, 0] = score[:, 0]
        for i in range(1, longest):
            step_in = np.logaddexp(ahead[:, i - 1, 0, None] + t[0], ahead[:, i - 1, 1, None] + t[1]) + score[:, i]
            ahead[:, i] = np.where(there[:, i, None], step_in, ahead[:, i - 1])
        behind = np.zeros_like(score)
        for i in range(longest - 2, -1, -1):
            x = score[:, i + 1] + behind[:, i + 1]
            back = np.logaddexp(t[:, 0] + x[:, 0, None], t[:, 1] + x[:, 1, None])
            behind[:, i] = np.where(there[:, i + 1, None], back, 0)
        z = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
        mean = np.exp(ahead + behind - z[:, None, None]) * there[:, :, None]
        pair = np.exp(ahead[:, :-1, :, None] + t + (score + behind)[:, 1:, None, :] - z[:, None, None, None]) * there[:, 1:, None, None]
        miss = mean - gold
        grad_w = np.stack([np.bincount(flat.ravel(), np.repeat(miss[:, :, c].ravel(), widest), len(used) + 1) for c in (0, 1)], 1)
        grad_w[-1] = 0
        grad = np.concatenate((grad_w.ravel(), (pair - both).sum((0, 1)).ravel(), miss[:, 0].sum(0))) / total + penalty * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta -= 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    unary[used] = theta[:-6].reshape(-1, 2)[:-1]
    return Field(unary, theta[-6:-2].reshape(2, 2).copy(), theta[-2:].copy())


# Names that page templates give to their parts. Training layouts draw from them.
PARTS = {
    "menu": ("nav", "nav menu navigation navbar topnav breadcrumb breadcrumbs tabs toc mainnav submenu"),
    "header": ("header", "header masthead site-header topbar branding banner-top logo tagline"),
    "footer": ("footer", "footer site-footer colophon copyright legal bottom imprint"),
    "sidebar": ("aside", "sidebar side widget related rail recommended popular trending more-stories"),
    "notice": ("div", "cookie consent notice gdpr cookie-banner alert popup modal overlay newsletter subscribe paywall"),
    "advert": ("div", "ad ads advert advertisement sponsored promo promotion banner adsbox adslot sponsor"),
    "form": ("form", "form search login signup contact-form searchbox"),
    "comments": ("section", "comments comment reader-comments discussion replies reply disqus comment-list responses"),
    "share": ("div", "share social sharing tags pager pagination byline-tools meta-links"),
}
BODY = "content article post entry post-body article-body entry-content story main text body page".split()


def lay_out(words: list[str], paragraphs: list[str], rng: random.Random) -> tuple[str, list[int]]:
    """A labelled page: the given text in a template drawn at random, with a label per block."""
    parts: list[tuple[str, int]] = []

    def some(n: int) -> str:
        return " ".join(rng.choice(words) for _ in range(n)) if words else "x"

    def part(kind: str) -> None:
        tag, names = PARTS[kind]
        names = names.split()
        tag = rng.choice((tag, tag, "div", "section", "aside" if kind in ("sidebar", "advert") else "div"))
        mark = rng.choice((f' class="{rng.choice(names)}"', f' id="{rng.choice(names)}"', f' class="{rng.choice(names)} {rng.choice(names)}"', "" if tag not in ("div", "section") else f' class="{rng.choice(names)}"'))
        inner, count = "", 0
        if kind in ("menu", "share", "sidebar") and rng.random() < 0.8:
            for _ in range(rng.randint(2, 8)):
                inner += f'<li><a href="/x">{some(rng.randint(1, 4))}</a></li>'
                count += 1
            inner = f"<ul>{inner}</ul>"
        elif kind == "form":
            for _ in range(rng.randint(1, 4)):
                inner += f"<p><label>{some(rng.randint(1, 3))}</label> <input name=x></p>"
                count += 1
            inner += f"<button>{some(1)}</button>"
            count += 1
        elif kind == "comments":
            for _ in range(rng.randint(1, 5)):
                inner += f'<div class="{rng.choice(names)}"><p>{some(rng.randint(4, 40))}</p></div>'
                count += 1
        else:
            for _ in range(rng.randint(1, 2)):
                lead = rng.choice(("", "", "&copy; ")) if kind == "footer" else ""
                inner += rng.choice(("<p>{}</p>", "<div>{}</div>", "{}<br>")).format(lead + some(rng.randint(2, 25)) + ".")
                count += 1
        parts.append((f"<{tag}{mark}>{inner}</{tag}>", -count))

    for kind in rng.sample(("header", "menu", "notice", "advert", "form", "sidebar"), rng.randint(1, 5)):
        part(kind)
    name = rng.choice(BODY) if rng.random() < 0.7 else f"{rng.choice(BODY)} {rng.choice(BODY)}"
    plain = f'<div class="{name}">', f'<div id="{name}">', f'<section class="{name}">', f'<div class="wrapper"><div class="{name}">'
    opening = rng.choice(("<article>", "<main>", rng.choice(("<main><article>", f'<div id="{name}"><article>')), *plain, *plain[:3]))
    parts.append((opening, 0))
    if rng.random() < 0.8:
        parts.append((f"<{rng.choice(('h1', 'h1', 'h2'))}>{some(rng.randint(2, 9))}</h1>", 1))
    for i, p in enumerate(paragraphs or [some(30)]):
        shape = rng.choice(("<p>{}</p>",) * 6 + ("<p>{}", "<div>{}</div>", "<blockquote>{}</blockquote>", "<li>{}</li>", "<p><b>{}<br>", "<br>{}<br><br>", "<br>{}<br>", "<pre>{}</pre>", "<h2>{}</h2>", '<p><a href="/y">x</a> {}</p>'))
        parts.append((shape.format(entities.escape(p)), 1))
        if i and rng.random() < 0.06:
            part(rng.choice(("advert", "sidebar", "share", "notice")))
    inside = opening.startswith(("<article", "<main")) and rng.random() < 0.3
    if inside:
        part(rng.choice(("comments", "share", "form")))
    parts.append(("".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", opening))), 0))
    for kind in rng.sample(("comments", "sidebar", "advert", "share", "form", "footer", "footer"), rng.randint(1, 4)):
        part(kind)
    page = "<!DOCTYPE html><html><head><title>x</title></head><body>" + "".join(h for h, _ in parts) + ("</body></html>" if rng.random() < 0.8 else "")
    return page, [label for _, n in parts for label in ([1] * n if n > 0 else [0] * -n)]


def labelled(pages: list[str], seed: int = 5) -> Iterator[tuple[list[list[int]], list[int]]]:
    """Training pages: each page's own words in ``LAYOUTS`` templates, labelled as they are laid out."""
    rng = random.Random(seed)
    for page in pages:
        texts = [b.text for b in blocks(page or "")]
        words = " ".join(texts).split()
        long = [t for t in texts if len(t) > 60]
        for _ in range(LAYOUTS):
            body = rng.sample(long, min(len(long), rng.randint(1, 12)))
            body += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(0, 3)) if words]
            made, labels = lay_out(words, body, rng)
            found = blocks(made)
            if len(found) == len(labels):
                yield features(found), labels


def train(pages: DataFrame, html: str = "html", key: str = "page_id", limit: int = TRAIN_PAGES, chars: int = TRAIN_CHARS) -> Field:
    """Fit the field on ``limit`` whole pages of ``chars`` characters in all, picked by a hash of their key: a bounded sample."""
    size = F.length(html)
    sizes = pages.where((size > 0) & F.col(key).isNotNull()).groupBy(key).agg(F.max(size).alias("size")).orderBy(F.xxhash64(key), key).limit(limit)
    chosen, total = [], 0
    for r in sizes.collect():  # ids and sizes alone are ordered; then the chosen pages are read
        if not chosen or total + r["size"] <= chars:
            chosen.append(r[0])
            total += r["size"]
    picked = pages.where(F.col(key).isin(chosen)).dropDuplicates([key]).orderBy(key).select(html)
    return fit(list(labelled([r[0] for r in picked.collect()])))


def extract(pages: DataFrame, field: Field, html: str = "html", into: str = "text") -> DataFrame:
    """Add ``into``: the blocks labelled main text, joined by one space; empty if there are none.

    The whole page is read; a null or empty page, or one without text, gives the empty
    text. Broken markup is read as far as it goes. Other columns stay; a column named
    like the new one is replaced. A map over partitions.
    """
    shared = pages.sparkSession.sparkContext.broadcast(field)  # features x 2 numbers
    pages = pages.drop(into) if into != html else pages
    schema = T.StructType([*pages.schema.fields, T.StructField(into, T.StringType())])

    def run(batches):
        model = shared.value
        for batch in batches:
            texts = []
            for page in batch.column(html):
                found = blocks(page.as_py() or "")
                labels = model.label(found)
                texts.append(" ".join(b.text for b, y in zip(found, labels) if y))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, into])

    return pages.mapInArrow(run, schema)


def op5_html(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    out = extract(pages, train(pages))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
