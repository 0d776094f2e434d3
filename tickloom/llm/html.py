"""Main text of web pages by gradient-boosted trees over the nodes of their DOM.

Every block of a page (and every inline element whose attributes look like an advert) is a node with
features of its subtree, its depth, its siblings, and how far above it stand telling elements and
attribute tokens. Trees learned from pages that mark their article give each node a score; hierarchical
decoding then picks the best set of nodes in which nothing below a dropped node is kept.

Tokens and elements tell little about what holds most of a page: the largest article, what is around it,
and any node with most of the page's text are never taken for boilerplate by name.

The training rows are the nodes of at most `sample_pages` pages, those first by a hash of their id. A
node is labelled by markup alone: main text inside article or main elements, boilerplate inside nav,
footer, aside, form and the like or under telling attribute tokens. Sites differ more than any sample, so
each page's own text is also laid out anew: without wrappers or with misleading ones, among menus, link
lists, forms and reader comments under names that tell nothing. There labels are known by construction.
The names are also hidden in copies, so that the trees use shape where names are missing.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.boosting import BoostedTrees
from tickloom.llm.tables import bounded_batches

SAMPLE_PAGES, LAYOUTS = 300, 6

# fixed values: element and token names of HTML
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = set("script style head title template noscript iframe object svg math canvas audio video select option button textarea datalist".split())
RAW = set("script style textarea title noscript iframe template".split())
BOILER_TAGS = set("nav footer aside form menu dialog fieldset".split())
MAIN_TAGS = set("article main".split())
BOILER_TOKENS = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright discussion disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted reactions related replies reply respond responses search share sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar widget widgets".split()
)
MAIN_TOKENS = set("article articlebody body content entry main post story text".split())
STATE_WORDS = set("has hide is js no show sticky with without".split())
CLOSES_P = BLOCKS - {"html", "body", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "summary", "figcaption"}
CLOSES_SAME = {"li": {"ul", "ol", "menu", "dir"}, "dd": {"dl"}, "dt": {"dl"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "tr": {"table", "tbody", "thead", "tfoot"}}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>\"'<]*)((?:[^>\"'<]|\"[^\"<]*\"|'[^'<]*')*)>|<(/?)([A-Za-z][^\s/>\"'<]*)([^<>]*)>|<[!?][^>]*>", re.S)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_TRUTH = re.compile(r"\btruth=([01])")
_WORD = re.compile(r"[a-z]+")
#: Levels to a telling element where there is none.
FAR = 32.0
N_FEATURES = 36
_BOILER_MARKS, _MAIN_MARKS = slice(20, 23), slice(23, 25)


class Node:
    __slots__ = ("tag", "parent", "children", "parts", "depth", "boiler_tag", "main_tag", "boiler_token", "main_token", "truth", "own", "links", "tags", "marks", "digits", "times", "start", "total", "paragraphs", "items", "controls", "size", "number")

    def __init__(self, tag: str, parent: Node | None, tokens: set[str], truth: int = -1):
        self.tag, self.parent, self.children, self.parts, self.truth = tag, parent, [], [], truth
        self.depth = parent.depth + 1 if parent else 0
        self.main_tag, self.boiler_tag = tag in MAIN_TAGS, tag in BOILER_TAGS
        self.boiler_token, self.main_token = bool(tokens & BOILER_TOKENS), bool(tokens & MAIN_TOKENS)
        self.own = self.links = self.marks = self.tags = self.controls = self.digits = self.times = 0
        if parent:
            parent.children.append(self)
            parent.parts.append(self)


def _tokens(attributes: str) -> set[str]:
    """Words of class, id and role; names of states, such as has-sidebar, do not count."""
    out: set[str] = set()
    for found in _NAMES.findall(attributes):
        for name in "".join(found).lower().split():
            words = _WORD.findall(name)
            if words and words[0] not in STATE_WORDS:
                out.update(words)
    return out


def parse(page: str, known: bool = False) -> list[Node]:
    """Nodes in page order, the root first. Unclosed, crossed and stray tags and quotes are tolerated. known: truth attributes give labels."""
    root = Node("html", None, set())
    nodes, top, at, in_link, unseen = [root], root, 0, 0, None

    def text(raw: str) -> None:
        if raw and unseen is None:
            own = entities.unescape(raw)
            n = len(own) - own.count(" ")
            top.parts.append(own)
            top.own += n
            top.links += n if in_link else 0
            top.marks += sum(map(own.count, ".,;:!?"))
            top.digits += sum(map(own.count, "0123456789"))

    for m in _TAG.finditer(page):
        if m.start() < at:
            continue
        text(page[at : m.start()])
        at = m.end()
        name, attributes = m[2] or m[5], m[3] or m[6] or ""
        if not name:
            continue
        tag, closing = name.lower(), bool(m[1] or m[4])
        if unseen is not None:
            if closing and tag == unseen or tag == "body":
                unseen = None
            if tag != "body":
                continue
        if tag in UNSEEN:
            if closing:
                continue
            top.controls += tag in ("button", "select", "textarea")
            if tag in RAW:
                end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            elif not attributes.rstrip().endswith("/"):
                unseen = tag
            continue
        if tag == "a":
            in_link = 0 if closing else 1
        if not closing:
            top.tags += 1
        if tag == "br":
            top.parts.append("\n")
        if tag == "input" and not closing:
            top.controls += 1
        if tag == "time" and not closing:
            top.times += 1
        tokens = _tokens(attributes) if attributes and not closing else set()
        if tag not in BLOCKS and not (tokens & BOILER_TOKENS and tag not in VOID):
            if closing and top.tag == tag and top.parent:  # an inline node
                top = top.parent
            continue
        if closing:
            scope = top
            while scope and scope.tag != tag:
                scope = scope.parent
            if scope and scope.parent:
                top = scope.parent
            continue
        if tag in ("html", "body"):
            if tag == "html" or any(n.tag == "body" for n in nodes[:3]):
                continue
        if tag in CLOSES_P:
            scope = top
            while scope.parent and scope.tag not in BLOCKS:
                scope = scope.parent
            if scope.tag == "p":
                top = scope.parent
        if tag in CLOSES_SAME:
            scope = top
            while scope.parent and scope.tag != tag and scope.tag not in CLOSES_SAME[tag]:
                scope = scope.parent
            if scope.tag == tag:
                top = scope.parent
        if tag in BLOCKS:
            in_link = 0 if tag in ("article", "section", "nav", "footer", "main", "aside") else in_link
        truth = _TRUTH.search(attributes) if known else None
        new = Node(tag, top, tokens, int(truth[1]) if truth else -1)
        nodes.append(new)
        if tag not in VOID:
            top = new
    text(page[at:])
    return nodes


def _measure(nodes: list[Node]) -> None:
    """Sums of every subtree."""
    seen = 0
    for i, n in enumerate(nodes):
        n.number, n.start, n.total, n.size = i, seen, n.own, n.tags
        seen += n.own
        n.paragraphs, n.items = int(n.tag == "p"), int(n.tag == "li")
    for n in reversed(nodes):  # children come after their parents
        if n.parent:
            p = n.parent
            p.total += n.total
            for name in ("links", "marks", "digits", "times", "size", "paragraphs", "items", "controls"):
                setattr(p, name, getattr(p, name) + getattr(n, name))


def _names_above(nodes: list[Node]) -> np.ndarray:
    """For each node the levels up to the nearest boilerplate element and token and that node's share of the page, then to main ones.

    What holds most of the page, the largest article and what is around it count as nothing of this kind.
    """
    whole = max(nodes[0].total, 1)
    primes = [n for n in nodes if n.main_tag and not n.boiler_token]
    spine, at = set(), max(primes, key=lambda n: n.total, default=None)
    while at:
        spine.add(at.number)
        at = at.parent
    out = np.full((len(nodes), 5), FAR, np.float32)
    for i, n in enumerate(nodes):
        if n.parent:
            above = out[n.parent.number]
            out[i] = np.minimum(above + 1, FAR)
            out[i, 2] = above[2]
        outermost = n.tag in ("html", "body") or i in spine or n.total > 0.6 * whole
        tag, token = n.boiler_tag or n.tag == "header" and out[i, 3] >= FAR, n.boiler_token
        if (tag or token) and not outermost:
            out[i, 2] = n.total / whole
            out[i, 0], out[i, 1] = 0.0 if tag else out[i, 0], 0.0 if token else out[i, 1]
        if n.main_tag and not n.boiler_token or i in spine and n.main_tag:
            out[i, 3] = 0.0
        if n.main_token and (not token or outermost):
            out[i, 4] = 0.0
    return out


def _features(nodes: list[Node]) -> np.ndarray:
    _measure(nodes)
    whole = max(nodes[0].total, 1)
    log, above = math.log1p, _names_above(nodes)
    prose = [sum(c.own for c in n.children if c.tag == "p") for n in nodes]
    core = nodes[int(np.argmax(prose))]  # the node with most prose right in it
    first, last = core.start, core.start + core.total
    shape = [(n.tag, tuple(c.tag for c in n.children[:6])) for n in nodes]
    alike: list[int] = []  # siblings of the same make, if they are more than single blocks of text
    inside = [False] * len(nodes)
    rows = []
    for i, n in enumerate(nodes):
        siblings = n.parent.children if n.parent else [n]
        up = n.parent.number if n.parent else 0
        k = next(k for k, c in enumerate(siblings) if c is n) if len(siblings) < 64 else -1
        same = sum(shape[c.number] == shape[i] for c in siblings) if n.children and len(siblings) < 512 else len(siblings) if n.children else 0
        alike.append(max(same, alike[up] if n.parent else 0))
        inside[i] = n is core or bool(n.parent) and inside[up]
        parent = n.parent or n
        rows.append(
            [
                n.depth, log(n.own), log(n.total), n.links / max(n.total, 1), log(n.total / (n.size + 1)), sum(c.tag == n.tag for c in siblings[:512]) / min(len(siblings), 512), n.marks / max(n.total, 1), log(n.paragraphs), log(n.items), log(len(siblings)),
                k / max(len(siblings) - 1, 1), n.total / max(parent.total, 1), log(siblings[k - 1].total) if k > 0 else -1, log(siblings[k + 1].total) if 0 <= k < len(siblings) - 1 else -1, n.total / whole, n.start / whole,
                n.tag == "p", len(n.tag) == 2 and n.tag[0] == "h" and n.tag[1].isdigit(), n.tag in ("li", "ul", "ol"), n.tag in ("div", "section", "td"), *above[i].tolist(),
                log(n.controls), log(same), log(alike[i]), inside[i], max(0, n.start - last) / whole if n.start >= last else 0, max(0, first - n.start) / whole, log(n.times), n.digits / max(n.total, 1), log(n.total / (n.paragraphs + 1)), parent.links / max(parent.total, 1), log(parent.total / (parent.paragraphs + 1)),
            ]
        )
    return np.array(rows, np.float32)


def _labels(nodes: list[Node], x: np.ndarray) -> np.ndarray:
    """1 for main text, 0 for boilerplate, -1 where neither truth attributes nor names say."""
    boiler, main = x[:, _BOILER_MARKS][:, :2].min(1) < FAR, x[:, _MAIN_MARKS].min(1) < FAR
    out = np.where(boiler, 0, np.where(main, 1, -1)).astype(np.int8)
    if any(n.truth >= 0 for n in nodes):
        known = np.full(len(nodes), -1, np.int8)
        for i, n in enumerate(nodes):
            known[i] = n.truth if n.truth >= 0 else known[n.parent.number] if n.parent else -1
        return known
    return out


def _laid_out(blocks: list[str], seed: int) -> str:
    """A page of another layout whose main text is the given blocks and whose boilerplate quotes them; truth attributes tell them apart."""
    rng = random.Random(seed)
    words = " ".join(blocks).split() or ["text"]
    some = lambda lo, hi: entities.escape(" ".join(words[(k := rng.randrange(len(words))) : k + rng.randint(lo, hi)]))
    many = lambda part, lo, hi: "".join(part() for _ in range(rng.randint(lo, hi)))
    nothing = lambda: f"class='{''.join(rng.choice('bcdfgklmrvz') + rng.choice('aeiou') for _ in range(3))}'"
    box = lambda: rng.choice(["div", "section", "div", "ul" if rng.random() < 0.2 else "div"])
    prose = lambda: many(lambda: f"<p>{some(5, 60)}</p>", 1, 4)
    linked = lambda: "<ul>" + many(lambda: f"<li><a href='#'>{some(1, 6)}</a></li>", 2, 8) + "</ul>"
    title = lambda: f"<h{(n := rng.randint(1, 4))}>{some(1, 8)}</h{n}>"
    filling = lambda: rng.choice([prose, linked, lambda: title() + prose(), lambda: title() + linked(), lambda: some(2, 30)])()
    form = lambda: f"{some(0, 8)}<label>{some(1, 3)}</label><input name='q'><button>{some(1, 2)}</button>"

    def comments() -> str:
        item, by, when = rng.choice(["li", "div", "article", "section"]), rng.choice(["<b>{}</b>", "<a href='#'>{}</a>", "<cite>{}</cite>", "<span>{}</span>", "<h4>{}</h4>", "<p>{}</p>"]), rng.choice(["<time>{}</time>", "<small>{}</small>", " {}"])
        dated = lambda: when.format(f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.20{rng.randint(10, 25)} {rng.randint(0, 23)}:{rng.randint(10, 59)}") if rng.random() < 0.8 else ""
        reply = rng.choice(["", "<a href='#'>Reply</a>", f"<p><a href='#'>{some(1, 2)}</a></p>", "<button>+1</button>"])
        one = lambda: f"<{item}>{by.format(some(1, 2))}{dated()}{rng.choice([f'<p>{some(3, 30)}</p>', f'<div>{some(3, 30)}</div>', prose()])}{reply}</{item}>"
        return rng.choice(["", f"<h3>{some(1, 4)}</h3>"]) + (f"<ol>{many(one, 2, 9)}</ol>" if item == "li" else many(one, 2, 9))

    token = lambda: f"{rng.choice(['class', 'id'])}='{rng.choice(['', 'site-', 'c-'])}{rng.choice(sorted(BOILER_TOKENS))}'"
    named = lambda: f"<{(t := box())} truth=0 {token()}>{rng.choice([filling, filling, comments, form])()}</{t}>"
    tagged = lambda: f"<{(t := rng.choice(sorted(BOILER_TAGS) + ['header']))} truth=0>{rng.choice([filling, form] if t == 'form' else [filling])()}</{t}>"
    nameless = lambda: f"<{(t := box())} truth=0 {nothing()}>{rng.choice([linked, linked, comments, comments, form, lambda: title() + linked(), lambda: f'<a href="#">{some(1, 5)}</a> | {some(1, 4)}'])()}</{t}>"
    before = lambda: many(lambda: rng.choice([named, tagged, nameless])() if rng.random() < 0.8 else f"<div truth=0 {nothing()}>{linked()}</div>", 0, 3)
    after = lambda: many(lambda: rng.choice([named, tagged, nameless, nameless])(), 0, 3)
    kinds = rng.choice([["p"], ["p", "p", "p", "h2"], ["p", "p", "p", "p", "h2", "blockquote", "pre", "li", "div"]])
    own = [f"<{(t := rng.choice(kinds))} truth=1>{entities.escape(b)}</{t}>" for b in blocks]
    if rng.random() < 0.7:
        head = f"<h1 truth=1>{some(1, 8)}</h1>"
        own.insert(0, rng.choice([head, head, f"<header truth=1>{head}</header>", f"<div truth=1>{head}</div>"]))
    if rng.random() < 0.2:  # something else amid the text
        own.insert(rng.randrange(len(own) + 1), named())
    outer = rng.choice(["article", "article", "main", "div class='content'", "div class='post'", "div id='main'", "section class='entry'", f"div {nothing()}", f"article {token()}", "", ""])
    if rng.random() < 0.15:  # nothing but the text
        before = after = lambda: ""
    tail = after() if rng.random() < 0.3 else ""
    main = f"<{outer} truth=1>{''.join(own)}{tail}</{outer.split()[0]}>" if outer else "".join(own) + tail
    if rng.random() < 0.5:
        main = f"<div {rng.choice([nothing(), token(), 'class=layout'])}>{main}{after()}</div>"
    return f"<html><body {rng.choice(['', nothing(), token()])}>{before()}{main}{after()}</body></html>"


def _decode(nodes: list[Node], logit: np.ndarray) -> list[bool]:
    """The nodes kept in the best cut of the tree: below a dropped node everything is dropped."""
    gain = [float(x) * (0.1 + math.log1p(n.own)) for n, x in zip(nodes, logit, strict=True)]
    for i in range(len(nodes) - 1, 0, -1):
        gain[nodes[i].parent.number] += max(gain[i], 0.0)
    keep = [False] * len(nodes)
    for i, n in enumerate(nodes):
        keep[i] = gain[i] > 0 and (n.parent is None or keep[n.parent.number])
    return keep


def _text(nodes: list[Node], keep: list[bool]) -> str:
    kept = {id(n) for n, k in zip(nodes, keep, strict=True) if k}
    blocks: list[str] = []
    line: list[str] = []

    def close() -> None:
        if own := " ".join("".join(line).split()):
            blocks.append(own)
        line.clear()

    stack: list[tuple[Node, int]] = [(nodes[0], 0)] if id(nodes[0]) in kept else []
    while stack:
        node, k = stack.pop()
        block = node.tag in BLOCKS
        if k == 0 and block:
            close()
        while k < len(node.parts):
            part = node.parts[k]
            k += 1
            if isinstance(part, str):
                line.append(part)
            elif id(part) in kept:
                stack += [(node, k), (part, 0)]
                break
            elif part.tag in BLOCKS:
                close()
        else:
            if block:
                close()
    close()
    return "\n\n".join(blocks)


def _training(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, marks = [], []
        for page in batch.column("html"):
            if not page.is_valid:
                continue
            nodes = parse(page.as_py())
            x = _features(nodes)
            label = _labels(nodes, x)
            main = _text(nodes, [n.parent is None or mark != 0 for n, mark in zip(nodes, label, strict=True)])
            copies = [(x, label, hidden) for hidden in ([], [_MAIN_MARKS], [_BOILER_MARKS])]
            for k in range(LAYOUTS):
                other = parse(_laid_out(main.split("\n\n"), zlib.crc32(main.encode()) + k), True)
                own = _features(other)
                copies.append((own, _labels(other, own), [[], [_MAIN_MARKS], [_MAIN_MARKS, _BOILER_MARKS]][k % 3]))
            for own, mark, hidden in copies:
                own = own[mark >= 0].copy()
                for columns in hidden:
                    own[:, columns] = FAR
                rows.append(own)
                marks.append(mark[mark >= 0])
        x = np.concatenate(rows) if rows else np.zeros((0, N_FEATURES), np.float32)
        y = np.concatenate(marks) if marks else np.zeros(0, np.int8)
        yield pa.RecordBatch.from_arrays([pa.array(y, pa.int8()), pa.array([r.tobytes() for r in x], pa.binary())], ["y", "x"])


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample_pages: int = SAMPLE_PAGES) -> BoostedTrees:
    """Trees from the nodes of at most sample_pages pages; without labelled nodes every node scores 0."""
    ids = pages.where(F.col(id_col).isNotNull() & F.col(html_col).isNotNull()).select(F.col(id_col).alias("id"))
    chosen = [r["id"] for r in ids.distinct().orderBy(F.xxhash64("id"), "id").limit(sample_pages).collect()]
    sample = pages.where(F.col(id_col).isin(chosen)).select(F.col(html_col).cast("string").alias("html"))
    rows = sample.mapInArrow(_training, "y byte, x binary").collect()
    y = np.array([r["y"] for r in rows], np.float64)
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in rows), np.float32).reshape(-1, N_FEATURES)
    order = np.lexsort((*x.T, y)) if len(y) else np.zeros(0, np.int64)  # the same trees whatever order tasks end in
    return BoostedTrees().fit(x[order], y[order])


def _extract(batches: Iterator[pa.RecordBatch], model: BoostedTrees) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 128):
            part = batch.slice(lo, 128)
            trees = [parse(p.as_py()) if p.is_valid else [] for p in part.column("html")]
            x = [_features(t) for t in trees if t]
            logit = model.logit(np.concatenate(x)) if x else np.zeros(0)
            texts, at = [], 0
            for nodes in trees:
                texts.append(_text(nodes, _decode(nodes, logit[at : at + len(nodes)])) if nodes else "")
                at += len(nodes)
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame, model: BoostedTrees, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every page: id_col, url_col, text and n_chars (code points).

    Character references are decoded, white space inside a block becomes one space, blocks are joined in
    page order by an empty line. A null or empty page, or one of boilerplate only, has an empty text.
    Repeated rows give a row each; pages are taken whole; an empty table gives no rows.
    """
    bounded_batches(pages.sparkSession)
    source = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    kinds = [source.schema[c].dataType.simpleString() for c in ("id", "url")]
    out = source.mapInArrow(lambda it: _extract(it, model), f"id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
    return out.withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
