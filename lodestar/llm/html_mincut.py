"""Main-text extraction by minimum cut.

A page becomes text blocks in page order.  A logistic classifier over features of
a block (length, links, punctuation, tag, and what class names around it say) is
fitted by Spark on blocks whose place is told by semantic tags; its weights are
drawn to a prior, so that pages without such tags are judged as well.  The logit,
with what the nearest semantic tag tells, is a block's cost of being called
content or boilerplate and becomes its terminal capacity.  Neighbouring blocks and
blocks of one parent are joined by smoothness edges.  The minimum cut parts
content from boilerplate.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textarrays import pieces_of

SAMPLE_PAGES = 2000  # the classifier is fitted on about so many pages, one in every count / SAMPLE_PAGES by hash
ADJACENT = 0.6
SAME_PARENT = 0.9
APART = 0.3  # of an edge between blocks of which different things are told
TOLD = 6.0
SHAPE_LIMIT = 3.0
WRAPPER_SHARE = 0.8
ROUNDS = 300
PRIOR_BLOCKS = 100  # weight of the prior against so many placed blocks
PIECE_BYTES = 4 << 20

# prior weights: constant, log of words, share of links, sentence ends, commas, p, li, heading; then names of content, names of other parts
PRIOR = np.array([0.0, 0.4, -4.0, 1.0, 0.3, 0.6, -0.5, 1.0, 1.5, -4.0])
SHAPES = 8

# fixed values: elements by role
_HIDDEN = frozenset("head script style noscript template svg math iframe object select option button textarea canvas audio video map datalist".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CONTENT_TAGS = frozenset(["article", "main"])
_OTHER_TAGS = frozenset(["nav", "footer", "aside", "form", "menu", "dialog", "header"])
_RAW = frozenset(["script", "style", "textarea", "title", "noscript", "iframe"])
_CLOSED_BY = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
_ROLES = {"navigation": -1, "banner": -1, "contentinfo": -1, "complementary": -1, "search": -1, "form": -1, "dialog": -1, "alert": -1, "main": 1, "article": 1}

# fixed values: parts of class names and ids
_CONTENT_PARTS = frozenset("article content entry story post main body text maincontent".split())
_OTHER_PARTS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising nav navbar navigation menu foot footer head header masthead topbar side sidebar aside banner promo promotion sponsor sponsored cookie cookies consent gdpr notice alert share sharing social related recommend recommended recommendations breadcrumb breadcrumbs subscribe newsletter signup login popup modal overlay widget pagination pager tags toolbar copyright legal search form comment comments disqus reply replies respond".split()
)
_HEAD_PARTS = frozenset(["head", "header"])
# a name with one of these tells of a state of the page, not of a part of it
_STATE_PARTS = frozenset("no not has with without open opened closed enabled disabled on off hide hidden show active fixed".split())

_ATTR = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NAME = re.compile(r"/?[a-zA-Z][a-zA-Z0-9:-]*")
_END_OF_TAG = re.compile(r"""[>"']""")
_PARTS = re.compile(r"[-_]+")
_ENDS_ITSELF = re.compile(r"""(?:^|[\s"'])/$""")
_NONE_SHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Block:
    """A text block: told is what the nearest telling element says by its tag, named what the nearest name says (1 content, -1 other)."""

    __slots__ = ("text", "tag", "told", "named", "parent", "depth", "link")

    def __init__(self, text, tag, told, named, parent, depth, link):
        self.text, self.tag, self.told, self.named, self.parent, self.depth, self.link = text, tag, told, named, parent, depth, link


def _named(names: str, in_content: bool) -> int:
    """What class names and ids say: 1 content, -1 another part, 0 nothing.

    A name is taken by its parts between hyphens and underscores; a header in
    the content is the content's.
    """
    found = 0
    for name in names.lower().split():
        parts = set(_PARTS.split(name))
        if parts & _STATE_PARTS:
            continue
        other, content = parts & _OTHER_PARTS, bool(parts & _CONTENT_PARTS)
        if other and not (other <= _HEAD_PARTS and (content or in_content)):
            return -1
        if content:
            found = 1
    return found


def _attributes(attrs: str) -> tuple[str, int | None, bool]:
    """Class names and ids, what a role tells, and whether the element is hidden."""
    names, role, hidden = "", None, False
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            names += " " + value
        elif name == "role":
            role = _ROLES.get(value.lower(), role)
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _NONE_SHOWN.search(value)):
            hidden = True
    return names, role, hidden


def _markup(page: str):
    """(text before, tag name with a slash if it ends an element, attributes) of each tag; the last has no tag.

    One pass: a quote opens a value only after an equals sign and where it is
    closed, and what has once been looked for in vain is not looked for again.
    """
    at, start, n = 0, 0, len(page)
    closed = {'"': True, "'": True}
    while True:
        lt = page.find("<", at)
        if lt < 0 or page.find(">", lt) < 0:
            break
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            yield page[start:lt], "", ""
            at = start = n if end < 0 else end + 3
            continue
        if page[lt + 1] in "!?":
            yield page[start:lt], "", ""
            at = start = page.find(">", lt) + 1
            continue
        m = _NAME.match(page, lt + 1)
        if not m:
            at = lt + 1
            continue
        k = m.end()
        while (q := _END_OF_TAG.search(page, k)) and q[0] != ">":
            end = -1
            if closed[q[0]] and page[k : q.start()].rstrip().endswith("="):
                end = page.find(q[0], q.end())
                closed[q[0]] = end >= 0
            k = q.end() if end < 0 else end + 1
        if not q:
            break
        yield page[start:lt], m[0].lower(), page[m.end() : q.start()]
        at = start = q.end()
        if m[0].lower() in _RAW:
            end = re.compile(rf"</{m[0]}\b[^>]*>", re.I).search(page, at)
            at = start = end.end() if end else n
    yield page[start:], None, ""


def blocks(page: str) -> list[Block]:
    """Text blocks of a page in order; hidden elements, comments and markup have none."""
    # elements by number: parent, tag, what the tag tells, what the names say, length of the text
    parent, tags, told, named, size = [0], [""], [0], [0], [0]
    found: list[tuple[str, int, int, int]] = []  # text, number of the block element, depth, length in links
    # an open element: (tag, number, hidden, place of the nearest block element in the stack, inside content)
    stack: list[tuple[str, int, bool, int, bool]] = [("", 0, False, 0, False)]
    open_: Counter = Counter()
    text: list[str] = []
    link = in_link = 0

    def flush():
        nonlocal text, link
        if text:
            joined = "".join(text)
            if "&" in joined:
                joined = html.unescape(joined)
            joined = " ".join(joined.split())
            if joined:
                k = stack[-1][3]
                found.append((joined, stack[k][1], k, min(link, len(joined))))
                size[stack[k][1]] += len(joined)
        text, link = [], 0

    def close(k):
        for tag, *_ in stack[k:]:
            open_[tag] -= 1
        del stack[k:]

    for before, tag, attrs in _markup(page):
        if before and not stack[-1][2]:
            text.append(before)
            if in_link:
                link += len(before)
        if not tag:
            continue
        if tag[0] == "/":
            tag = tag[1:]
            if open_[tag]:
                if tag in _BLOCK:
                    flush()
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                close(k)
            if tag == "a":
                in_link = max(0, in_link - 1)
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in _VOID:
            if tag == "hr":
                flush()
            continue
        block = tag in _BLOCK
        if block:
            flush()
            shut = _CLOSED_BY.get(tag, ())
            k = stack[-1][3]  # a block ends an open paragraph, an item the last item
            if k and (stack[k][0] == "p" or stack[k][0] in shut):
                close(k)
        if tag in _RAW or (not block and _ENDS_ITSELF.search(attrs)):
            continue
        _, above, hidden, last, inside = stack[-1]
        names, role, unseen = _attributes(attrs) if attrs and not attrs.isspace() else ("", None, False)
        say = _named(names, inside) if names and tag not in ("html", "body") else 0
        tell = 0
        if role is not None:
            tell = role
        elif tag in _OTHER_TAGS and not (tag == "header" and inside):
            tell = -1
        elif tag in _CONTENT_TAGS and say >= 0:
            tell = 1
        number = len(parent)
        for column, value in zip((parent, tags, told, named, size), (above, tag, tell, say, 0)):
            column.append(value)
        inside = tell > 0 or say > 0 or (inside and not tell and say >= 0)
        stack.append((tag, number, hidden or unseen or tag in _HIDDEN, len(stack) if block else last, inside))
        open_[tag] += 1
        if tag == "a":
            in_link += 1
    flush()

    for e in range(len(parent) - 1, 0, -1):
        size[parent[e]] += size[e]
    # what holds nearly all text is a wrapper, whatever its name or form says
    for e in range(1, len(parent)):
        if size[e] > WRAPPER_SHARE * size[0]:
            named[e] = max(named[e], 0)
            if tags[e] in ("form", "header", "dialog"):
                told[e] = 0
        up = parent[e]
        if not told[e]:
            told[e] = 0 if named[e] else told[up]
        named[e] = named[e] or named[up]
        if told[up] < 0 and not told[e] and named[e] > 0:  # no name makes content of what a tag above puts aside
            told[e] = -1
    return [Block(t, tags[e], told[e], named[e], parent[e], depth, n) for t, e, depth, n in found]


def features(b: Block) -> list[float]:
    """Shape of a block, then what names around it say."""
    n = len(b.text)
    words = b.text.count(" ") + 1
    stops = b.text.count(". ") + b.text.count("? ") + b.text.count("! ") + (b.text[-1] in ".?!")
    shape = [1.0, math.log1p(words), b.link / n, min(1.0, stops / words * 4), min(1.0, b.text.count(",") / words * 4), float(b.tag == "p"), float(b.tag == "li"), float(b.tag in ("h1", "h2", "h3"))]
    return [*shape, float(b.named > 0), float(b.named < 0)]


def fit(pages: DataFrame) -> np.ndarray:
    """Weights of the classifier, from blocks that semantic tags place.

    ``pages(page_id, html)``; about ``SAMPLE_PAGES`` pages, of which only the
    features of placed blocks come to the driver.  Where only one kind of block
    is found the weights stay at ``PRIOR``.
    """

    def run(batches):
        for batch in pieces_of(batches, 0, PIECE_BYTES):
            x, y = [], []
            for page in batch.column("html").to_pylist():
                for b in blocks(page or ""):
                    if b.told:
                        x.append(features(b))
                        y.append(b.told > 0)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), pa.array(y, pa.bool_())], names=["x", "y"])

    every = max(1, pages.count() // SAMPLE_PAGES)
    some = pages.where(F.pmod(F.xxhash64("page_id", F.length("html")), F.lit(every)) == 0)
    got = some.select("html").mapInArrow(run, "x array<double>, y boolean").toArrow()
    y = got["y"].to_numpy(zero_copy_only=False).astype(float)
    w = PRIOR.copy()
    if len(y) == 0 or y.min() == y.max():
        return w
    x = np.array(got["x"].to_pylist())
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    ridge = min(1.0, 0.01 + PRIOR_BLOCKS / len(y))
    for _ in range(ROUNDS):  # gradient steps with a ridge towards the prior
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += 0.5 * (x.T @ (weight * (y - p)) / len(y) - ridge * (w - PRIOR))
    return w


def min_cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels that minimise the cost: a block with gain g costs g to leave out, or -g to take; an edge costs its weight when its ends differ.

    A block whose gain outweighs all its edges keeps its sign in a minimum cut;
    such blocks are settled first and their edges passed on as gains; ``_settle``
    does the others.  Ties take.
    """
    n = len(gain)
    gain = list(gain)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is None and abs(gain[i]) > sum(near[i].values()):
            label[i] = gain[i] > 0
            for j, w in near[i].items():
                del near[j][i]
                gain[j] += w if label[i] else -w
                todo.append(j)
            near[i] = {}
    _settle(label, gain, near)
    return label  # type: ignore[return-value]


def _settle(label: list[bool | None], gain: list[float], near: list[dict[int, float]]) -> None:
    """Labels of the blocks that have none yet.

    A block with at most two neighbours is replaced by what it costs at best for
    each of their labels; the edges of a page, to the block before and to the last
    one of the same parent, do not cross, so this takes page after page apart to
    nothing, in time proportional to its blocks.  What a graph of another kind has
    left over is settled by maximum flow.  Labels are then read back, last first.
    """
    free = [i for i in range(len(label)) if label[i] is None]
    cost = {i: [max(0.0, gain[i]), max(0.0, -gain[i])] for i in free}  # of leaving out, of taking
    pair = {i: {j: ((0.0, w), (w, 0.0)) for j, w in near[i].items()} for i in free}
    order, todo, gone = [], deque(i for i in free if len(pair[i]) <= 2), set()
    while todo:
        i = todo.popleft()
        if i in gone or len(pair[i]) > 2:
            continue
        gone.add(i)
        own, ends = cost[i], list(pair[i].items())
        order.append((i, own, ends))
        for j, _ in ends:
            del pair[j][i]
        if len(ends) == 1:
            ((a, p),) = ends
            for x in (0, 1):
                cost[a][x] += min(own[0] + p[0][x], own[1] + p[1][x])
        elif ends:
            (a, p), (b, q) = ends
            t = [[min(own[0] + p[0][x] + q[0][y], own[1] + p[1][x] + q[1][y]) for y in (0, 1)] for x in (0, 1)]
            old = pair[a].get(b, ((0.0, 0.0), (0.0, 0.0)))
            t = [[t[x][y] + old[x][y] for y in (0, 1)] for x in (0, 1)]
            pair[a][b] = ((t[0][0], t[0][1]), (t[1][0], t[1][1]))
            pair[b][a] = ((t[0][0], t[1][0]), (t[0][1], t[1][1]))
        todo.extend(j for j, _ in ends if len(pair[j]) <= 2)
    left = [i for i in free if i not in gone]
    if left:
        _flow(label, left, cost, pair)
    for i, own, ends in reversed(order):
        total = [own[x] + sum(p[x][int(label[j])] for j, p in ends) for x in (0, 1)]
        label[i] = total[1] <= total[0] + 1e-12


def _flow(label: list[bool | None], left: list[int], cost: dict[int, list[float]], pair: dict[int, dict[int, tuple]]) -> None:
    """Labels by maximum flow along shortest augmenting paths."""
    # the source stands for boilerplate, so that what it cannot reach is content
    source, sink = -1, -2
    room: dict[int, dict[int, float]] = {i: {} for i in left}
    room[source], room[sink] = {}, {}
    lean = {i: cost[i][1] - cost[i][0] for i in left}
    for a in left:
        for b, ((p, q), (r, s)) in pair[a].items():
            if a < b:  # p + (r - p) a + (s - r) b + (q + r - p - s) (1 - a) b
                lean[a] += r - p
                lean[b] += s - r
                room[a][b] = room[a].get(b, 0.0) + max(0.0, q + r - p - s)
                room[b].setdefault(a, 0.0)
    for i in left:
        if lean[i] > 0:
            room[source][i] = lean[i]
        elif lean[i] < 0:
            room[i][sink] = -lean[i]
    while True:
        back, queue = {source: source}, deque([source])
        while queue and sink not in back:
            i = queue.popleft()
            for j, c in room[i].items():
                if c > 1e-12 and j not in back:
                    back[j] = i
                    queue.append(j)
        if sink not in back:
            break
        path, j = [], sink
        while j != source:
            path.append((back[j], j))
            j = back[j]
        flow = min(room[a][b] for a, b in path)
        for a, b in path:
            room[a][b] -= flow
            room[b][a] = room[b].get(a, 0.0) + flow
    for i in left:
        label[i] = i not in back


def main_text(page: str, weights: np.ndarray) -> str:
    """The content blocks of a page, joined by spaces; an empty page has none."""
    bs = blocks(page)
    if not bs:
        return ""
    w = weights.tolist()
    gain, edges, last = [], [], {}
    alike = lambda a, b: 1.0 if (a.told, a.named) == (b.told, b.named) else APART
    for i, b in enumerate(bs):
        x = features(b)
        shape = sum(a * v for a, v in zip(w[:SHAPES], x))
        names = sum(a * v for a, v in zip(w[SHAPES:], x[SHAPES:]))
        gain.append(max(-SHAPE_LIMIT, min(SHAPE_LIMIT, shape)) + names + TOLD * b.told)
        if i:
            edges.append((i - 1, i, ADJACENT / (1 + abs(b.depth - bs[i - 1].depth)) * alike(b, bs[i - 1])))
        if b.parent in last:
            edges.append((last[b.parent], i, SAME_PARENT * alike(b, bs[last[b.parent]])))
        last[b.parent] = i
    return " ".join(b.text for b, keep in zip(bs, min_cut(gain, edges)) if keep)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages(page_id, url, html)``.

    Null or empty html, or a page without content, gives the empty text.
    Character references are decoded; white space within a block is one space;
    nothing is capped.  Repeated rows stay rows; further columns are ignored.
    """
    weights = fit(pages.select("page_id", F.col("html").cast("string")))

    def run(batches):
        for batch in pieces_of(batches, 2, PIECE_BYTES):
            texts = [main_text(p or "", weights) for p in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
