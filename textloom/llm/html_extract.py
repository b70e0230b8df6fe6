"""Main text of web pages by wrapper induction.

Pages of a host are aligned by simple tree matching: two nodes match if their labels (tag and first class) agree, and their children are
matched in order by dynamic programming for the largest number of matching nodes, at every size and depth. A host's wrapper has the trees
of its layouts, taken from at most REFERENCES of its pages (those with the smallest hashes): the page most like the others, and each that is
unlike all layouts so far. Every page of the host is then aligned with the layout that it matches best, and votes for the text that it has at
each node; pages with the same main text have one vote between them. A text that two thirds of a layout's pages have at a node,
and three at least, is constant there and belongs to the template. All else is slots, and blocks in slots are content.

Elements that can't be content whatever they hold (menus, footers, forms, scripts, comments and so on) are left out by tag, role
and class. Where a page marks its article or main part, content is what stands there; paragraphs, headings and lists of it count as
content even if other pages repeat them.

Votes are summed in each task by (host, layout, node, text) before they are shuffled, so a hot host gathers no more than the texts of its
nodes. Layouts and wrappers are joined to pages by broadcast if they are small, else by a join that splits hot keys.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, lean, materialize, table

REFERENCES = 5
LIKE = 0.6  # of the nodes of two pages, that a page of a layout matches
LEAST_VOTES, OF_VOTES = 3, (2, 3)
FLUSH = 200_000
CELLS = 20_000  # cells of a table of children that are held at once; larger ones are split, with the same best matching
BROADCAST_BYTES = 16_000_000
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
BARRIER = frozenset("article aside body button div main nav section table td th ul ol dl footer header form blockquote".split())
NEVER = frozenset("head script style noscript template nav footer aside form button select textarea title iframe object svg canvas audio video dialog menu datalist input noembed noframes".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
MARKED = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|masthead|header|footer|sidebar|notice|notices|banner|cookie|cookies|consent|ad|ads|advert|adverts|advertisement|promo|sponsor|sponsored|comment|comments|reply|replies|disqus"
    r"|related|recommended|share|sharing|social|breadcrumb|breadcrumbs|pagination|pager|newsletter|subscribe|signup|login|popup|modal|overlay|widget|skip|toolbar)(?:$|[\s_-])"
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXTUAL = HEADINGS | frozenset("p li blockquote pre td th dd dt figcaption article main".split())
WHOLE = frozenset("html body article main".split())


class Page:
    """A parsed page: nodes in document order, with label, children, own text by block, and where they stand."""

    def __init__(self, source: str):
        self.label, self.children, self.tag = ["#"], [[]], ["#"]
        self.out, self.inside, self.headings = [False], [False], [False]  # left out, within an article or main part, headings only
        self.blocks: list[tuple[int, list[str]]] = []  # node, pieces of text
        self.text: dict[int, list[str]] = {}
        self.marked: set[str] = set()
        self._parse(source)
        self.blocks = [(node, text) for node, pieces in self.blocks if (text := " ".join("".join(pieces).split()))]
        for node, text in self.blocks:
            self.text.setdefault(node, []).append(text)

    def _parse(self, source: str) -> None:
        stack, at, end = [0], 0, len(source)
        block: list[str] | None = None
        blocked = 0  # the node whose block is open

        def text(piece: str) -> None:
            nonlocal block
            if not piece:
                return
            if block is None:
                if not piece.strip():
                    return
                block = []
                self.blocks.append((blocked, block))
            block.append(html.unescape(piece) if "&" in piece else piece)

        def close(level: int) -> None:
            nonlocal block, blocked
            if any(self.tag[n] not in INLINE for n in stack[level:]):
                block = None
            del stack[level:]
            blocked = next((n for n in reversed(stack) if self.tag[n] not in INLINE), 0)

        def close_open(names, barrier) -> None:
            for level in range(len(stack) - 1, 0, -1):
                if self.tag[stack[level]] in names:
                    close(level)
                    return
                if self.tag[stack[level]] in barrier:
                    return

        while at < end:
            m = TOKEN.search(source, at)
            if m is None:
                text(source[at:])
                break
            text(source[at : m.start()])
            at = m.end()
            name = (m[2] or m[5] or "").lower()
            if not name:
                continue
            if m[1] or m[4]:
                for level in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[level]] == name:
                        close(level)
                        break
                continue
            if name == "br":
                text(" ") if block is not None else None
                continue
            if name in CLOSES_P:
                close_open(("p",), BARRIER)
            if name in SIBLINGS:
                close_open(SIBLINGS[name], ("ul", "ol", "dl", "table", "select"))
                if name in ("tr", "tbody", "tfoot", "thead") and self.tag[stack[-1]] in SIBLINGS[name]:
                    close_open(SIBLINGS[name], ("table",))
            attributes = (m[3] if m[2] else m[6]) or ""
            node = self._add(stack[-1], name, attributes)
            if name in VOID or attributes.endswith("/") and name in INLINE:
                if name not in INLINE:
                    block = None
                continue
            if name in RAW:
                stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(source, at)
                at = stop.start() if stop else end
            stack.append(node)
            if name not in INLINE:
                block, blocked = None, node
            elif self.out[node] != self.out[stack[-2]]:
                block, blocked = None, node

    def _add(self, parent: int, name: str, attributes: str) -> int:
        found = {k.lower(): (a or b or c or "") for k, a, b, c in ATTRIBUTE.findall(attributes)} if "=" in attributes or "hidden" in attributes else {}
        kind = (found.get("class", "") + " " + found.get("id", "")).lower()
        node = len(self.label)
        first = found.get("class", "").split()
        self.label.append(f"{name}.{first[0]}" if first else name)
        self.tag.append(name)
        self.children.append([])
        self.children[parent].append(node)
        out = self.out[parent] or name in NEVER
        if not out and name not in WHOLE and name not in HEADINGS:
            out = bool(found) and (found.get("role", "").lower() in ROLES or bool(kind.strip()) and bool(MARKED.search(kind)) or "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower())
        if not out and name in ("article", "section") and MARKED.search(kind):
            out = True
        if not out and name == "header" and not self.inside[parent]:
            out = True
        if not out and name in ("article", "main"):
            self.marked.add(name)
        self.out.append(out)
        self.inside.append(self.inside[parent] or name in ("article", "main"))
        self.headings.append(self.headings[parent] or name == "header")
        return node

    def signature(self) -> tuple:
        """The tree for a wrapper: label, text of its own blocks as a number, children."""

        trees = []
        for node, label in enumerate(self.label):
            own = self.text.get(node)
            trees.append([label, zlib.crc32("\n".join(own).encode("utf-8", "surrogatepass")) if own else None, []])
        for tree, children in zip(trees, self.children, strict=True):
            tree[2] = [trees[c] for c in children]
        return trees[0]


# ------------------------------------------------------------------------------------------------------------- alignment
_SHAPES: dict[tuple, int] = {}
_NODES: list[int] = []  # nodes of a tree of each shape
_SIZES: dict[tuple[int, int], int] = {}


def shape(tree) -> int:
    """Numbers a tree of labels; equal trees have equal numbers. Adds the number to each node as its fourth entry."""
    order = [tree]
    for node in order:
        order += node[2]
    for node in reversed(order):
        if len(node) == 3:
            key = (node[0], tuple(c[3] for c in node[2]))
            number = _SHAPES.setdefault(key, len(_SHAPES))
            if number == len(_NODES):
                _NODES.append(1 + sum(_NODES[c] for c in key[1]))
            node.append(number)
    return tree[3]


def matching(a, b) -> int:
    """Nodes in the largest simple matching of two trees: roots match, children match in order."""
    if a[0] != b[0]:
        return 0
    todo = [(a, b)]
    while todo:
        x, y = todo[-1]
        key = (x[3], y[3])
        if key in _SIZES:
            todo.pop()
            continue
        if x[3] == y[3]:
            _SIZES[key] = _NODES[x[3]]
            continue
        ours, theirs = {c[3]: c for c in x[2]}.values(), {c[3]: c for c in y[2]}.values()
        lacking = [(c, d) for c in ours for d in theirs if c[0] == d[0] and (c[3], d[3]) not in _SIZES]
        if lacking:
            todo += lacking
            continue
        if len(x[2]) * len(y[2]) > CELLS:
            _SIZES[key] = 1 + int(last_row(x[2], y[2])[-1])
        else:
            _SIZES[key] = 1 + (table_of(x[2], y[2])[-1][-1] if x[2] and y[2] else 0)
    return _SIZES[(a[3], b[3])]


def table_of(a, b) -> list[list[int]]:
    """Best matches of the first i nodes of a with the first j of b."""
    above = [0] * (len(b) + 1)
    out = [above]
    for x in a:
        row = [0]
        left = 0
        for j, y in enumerate(b):
            best = above[j + 1]
            if left > best:
                best = left
            if x[0] == y[0]:
                w = above[j] + (_SIZES.get((x[3], y[3])) or matching(x, y))
                if w > best:
                    best = w
            row.append(best)
            left = best
        out.append(row)
        above = row
    return out


def last_row(a, b) -> np.ndarray:
    """Best matches of all nodes of a with the first j of b, in memory of one row."""
    kinds = {}
    at = np.array([kinds.setdefault(y[3], (len(kinds), y))[0] for y in b], np.int64)
    row, weights = np.zeros(len(b) + 1, np.int64), {}
    for x in a:
        w = weights.get(x[3])
        if w is None:
            w = weights[x[3]] = np.array([matching(x, y) for _, y in kinds.values()], np.int64)
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + w[at]))
    return row


def in_order(a, b):
    """Pairs of the largest matching of two lists of nodes in order. Lists whose table is too large are halved where the best
    matchings of both halves add up to the most (Hirschberg), once their equal beginnings and ends are off."""
    todo = [(a, b)]
    while todo:
        a, b = todo.pop()
        if len(a) * len(b) > CELLS:
            least = min(len(a), len(b))
            head = next((i for i in range(least) if a[i][3] != b[i][3]), least)
            tail = next((i for i in range(least - head) if a[-1 - i][3] != b[-1 - i][3]), least - head)
            if head or tail:
                yield from zip(a[:head], b[:head], strict=True)
                yield from zip(a[len(a) - tail :], b[len(b) - tail :], strict=True)
                todo.append((a[head : len(a) - tail], b[head : len(b) - tail]))
                continue
            if len(a) == 1:
                j = max(range(len(b)), key=lambda j: matching(a[0], b[j]))
                if a[0][0] == b[j][0]:
                    yield a[0], b[j]
                continue
            half = len(a) // 2
            k = int(np.argmax(last_row(a[:half], b) + last_row(a[half:][::-1], b[::-1])[::-1]))
            todo += [(a[:half], b[:k]), (a[half:], b[k:])]
            continue
        if not a or not b:
            continue
        best = table_of(a, b)
        i, j = len(a), len(b)
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                yield a[i], b[j]


def aligned(a, b):
    """Pairs of nodes in the largest matching of two trees with shapes."""
    todo = [(a, b)] if a[0] == b[0] else []
    while todo:
        x, y = todo.pop()
        yield x, y
        todo += zip(x[2], y[2], strict=True) if x[3] == y[3] else in_order(x[2], y[2])


_CLEARED = [0]


def _fresh() -> None:
    if len(_SHAPES) > 200_000 or len(_SIZES) > 1_000_000:
        _CLEARED[0] += 1
        _SHAPES.clear()
        _NODES.clear()
        _SIZES.clear()


def layouts(sources: list[str]) -> list[list]:
    """Flat trees of the layouts of some pages, that of the page most like the others first; none of fewer than three pages, as two
    that agree may be copies."""
    if len(sources) < 3:
        return []
    _fresh()
    trees = [Page(s).signature() for s in sources]
    for t in trees:
        shape(t)
    closeness = [sum(matching(t, o) for o in trees) - 2 * matching(t, t) for t in trees]
    chosen: list = []
    for i in sorted(range(len(trees)), key=lambda i: (-closeness[i], i)):
        if all(_like(trees[i], c) < LIKE for c in chosen):
            chosen.append(trees[i])
    return [[[x[0], None, len(x[2])] for x in nodes(t)] for t in chosen]


def _like(a, b) -> float:
    return 2 * matching(a, b) / (_NODES[a[3]] + _NODES[b[3]])


class Wrapper:
    """Layouts of a host, as flat trees, and by layout and node (its place in the tree) the hashes of the texts that are constant there."""

    def __init__(self, flat: list[list], constant: list[tuple[int, int, int]] = ()):
        self.flat, self.made, self.constant = flat, None, {}
        for layout, node, text in constant:
            self.constant.setdefault((layout, node), set()).add(text)

    def trees(self) -> list[tuple[list, dict[int, int]]]:
        """The trees with their shapes, which hold until the tables of shapes are cleared, and the places of their nodes."""
        if self.made is None or self.made[0] != _CLEARED[0]:
            trees = [unflatten(f) for f in self.flat]
            for t in trees:
                shape(t)
            self.made = _CLEARED[0], [(t, {id(x): i for i, x in enumerate(nodes(t))}) for t in trees]
        return self.made[1]

    def align(self, page: Page) -> tuple[int, list[tuple[int, int, int]]]:
        """The layout that a page matches best, and (node of the layout, node of the page, hash of its text) of aligned nodes with text."""
        _fresh()
        own = page.signature()
        shape(own)
        trees = self.trees()
        best = max(range(len(trees)), key=lambda j: (_like(trees[j][0], own), -j)) if len(trees) > 1 else 0
        numbers, todo = {}, [(own, 0)]
        while todo:
            t, node = todo.pop()
            numbers[id(t)] = node
            todo += zip(t[2], page.children[node], strict=False)
        tree, places = trees[best]
        return best, [(places[id(x)], numbers[id(y)], y[1]) for x, y in aligned(tree, own) if y[1] is not None]

    def constant_nodes(self, page: Page) -> set[int]:
        """The page's nodes whose text belongs to the template."""
        if not self.constant:
            return set()
        layout, found = self.align(page)
        return {own for node, own, text in found if text in self.constant.get((layout, node), ())}


def induce(sources: list[str]) -> Wrapper | None:
    """The wrapper of some distinct pages of a host, by the votes of these pages alone; null with fewer than three."""
    flat = layouts(sources)
    if not flat:
        return None
    bare = Wrapper(flat)
    pages = {content(p): p for p in map(Page, sources)}
    votes: dict[tuple, int] = {}
    voters = [0] * len(flat)
    for page in pages.values():
        layout, found = bare.align(page)
        voters[layout] += 1
        for node, _, text in found:
            votes[layout, node, text] = votes.get((layout, node, text), 0) + 1
    return Wrapper(flat, [key for key, n in votes.items() if n >= max(LEAST_VOTES, -(-OF_VOTES[0] * voters[key[0]] // OF_VOTES[1]))])


def nodes(tree):
    """The nodes of a tree in document order."""
    todo = [tree]
    while todo:
        node = todo.pop()
        yield node
        todo += reversed(node[2])


def unflatten(flat: list) -> list:
    """A tree of its own, without shape numbers, which hold only until the tables are cleared."""
    top: list = []
    todo = [(top, 1)]
    for label, text, n in flat:
        while len(todo[-1][0]) == todo[-1][1]:
            todo.pop()
        children: list = []
        todo[-1][0].append([label, text, children])
        todo.append((children, n))
    return top[0]


def content(page: Page, constant: set[int] = frozenset()) -> str:
    """The article's blocks in page order, joined by one space; white space within a block counts as one space."""
    within = "article" if "article" in page.marked else "main" if "main" in page.marked else None
    if within:
        part = [False] * len(page.label)
        for node in range(len(page.label)):
            here = part[node] or page.tag[node] == within and not page.out[node]
            part[node] = here
            for c in page.children[node]:
                part[c] = here
    kept = []
    for node, text in page.blocks:
        if page.out[node] or page.headings[node] and page.tag[node] not in HEADINGS:
            continue
        if within and not part[node]:
            continue
        if node in constant and not (within and page.tag[node] in TEXTUAL):
            continue
        kept.append(text)
    return " ".join(kept)


def main_text(source: str, wrapper: Wrapper | None = None) -> str:
    """The content of a page, less what its host's wrapper has as template."""
    page = Page(source)
    return content(page, wrapper.constant_nodes(page) if wrapper else frozenset())


# ----------------------------------------------------------------------------------------------------------------- Spark
def _decode(raw: bytes) -> str:
    return raw.decode("utf-8", "replace")


def _layouts(group: pa.Table) -> pa.Table:
    sources = sorted({_decode(x) for x in as_bytes(group.column("html"))}, key=lambda s: (zlib.crc32(s.encode()), s))
    flat = layouts(sources)
    host = group.column("host").slice(0, 1 if flat else 0)
    return pa.table({"host": host.cast(pa.string()), "layouts": pa.array([json.dumps(flat, separators=(",", ":"))] if flat else [], pa.string())})


class _Known(dict):
    """Wrappers by their JSON; the last ones are kept."""

    def __missing__(self, text: str) -> Wrapper:
        if len(self) > 500:
            self.clear()
        found = json.loads(text)
        self[text] = made = Wrapper(found["layouts"], [(c["layout"], c["node"], c["text"]) for c in found.get("constant", ())])
        return made


@lean
def _vote(batches):
    """Rows (host, html, layouts): what each page has at the nodes of its layout, as pairs of 32-bit numbers, and a hash of its main text."""
    known = _Known()
    for batch in batches:
        layout, main, votes = [], [], []
        for raw, text in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            page = Page(_decode(raw))
            best, found = known['{"layouts":' + text + "}"].align(page)
            layout.append(best)
            main.append(int.from_bytes(hashlib.blake2b(content(page).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True))
            votes.append(np.array([(node, text) for node, _, text in found], "<u4").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(layout, pa.int32()), pa.array(main, pa.int64()), pa.array(votes, pa.binary())], ["host", "layout", "main", "votes"])


@lean
def _add_votes(batches):
    """Sums of votes (host, layout, votes) by host, layout, node and text, as far as a task sees them."""
    sums: dict[tuple, int] = {}

    def rows():
        columns = zip(*[(*key, n) for key, n in sums.items()], strict=True)
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["host", "layout", "node", "text", "n"])

    for batch in batches:
        for host, layout, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2)), strict=True):
            for node, text in np.frombuffer(raw, "<u4").reshape(-1, 2).tolist():
                key = host, layout, node, text
                sums[key] = sums.get(key, 0) + 1
            if len(sums) > FLUSH:
                yield rows()
                sums.clear()
    if sums:
        yield rows()


def _small(rows: DataFrame, column: str) -> DataFrame:
    """rows (host and a column of text), to broadcast if its bytes, which are counted, are few."""
    weight = rows.agg(F.sum(F.length("host") + F.octet_length(column))).first()[0] or 0
    return F.broadcast(rows) if weight <= BROADCAST_BYTES else rows


def wrappers(rows: DataFrame) -> DataFrame:
    """host and wrapper (JSON) of the hosts of rows (host, html) that have a constant node."""
    digest = F.xxhash64("html").alias("digest")
    order = F.row_number().over(Window.partitionBy("host").orderBy("digest"))
    chosen = rows.select("host", digest).distinct().withColumn("r", order).where(F.col("r") <= REFERENCES).select("host", "digest")
    chosen = materialize(chosen, "references")
    references = rows.select("host", "html", digest).join(chosen, ["host", "digest"], "left_semi").dropDuplicates(["host", "digest"])
    found = materialize(references.select("host", "html").groupBy("host").applyInArrow(_layouts, "host string, layouts string"), "layouts")
    voting = rows.join(_small(found, "layouts"), "host").select("host", "html", "layouts")
    votes = voting.mapInArrow(_vote, "host string, layout int, main long, votes binary").groupBy("host", "layout", "main").agg(F.min("votes").alias("votes"))
    votes = materialize(votes, "votes")
    voters = votes.groupBy("host", "layout").agg(F.count("*").alias("voters"))
    sums = votes.select("host", "layout", "votes").mapInArrow(_add_votes, "host string, layout int, node long, text long, n long")
    sums = sums.groupBy("host", "layout", "node", "text").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_VOTES)
    constant = sums.join(voters, ["host", "layout"]).where(OF_VOTES[1] * F.col("n") >= OF_VOTES[0] * F.col("voters"))
    constant = constant.groupBy("host").agg(F.to_json(F.sort_array(F.collect_list(F.struct("layout", "node", "text")))).alias("constant"))  # as many as a host's layouts have nodes
    whole = F.concat(F.lit('{"layouts":'), "layouts", F.lit(',"constant":'), "constant", F.lit("}"))
    return materialize(found.join(constant, "host").select("host", whole.alias("wrapper")), "wrappers")


def _extract(batches, names: list[str]):
    known = _Known()
    for batch in batches:
        texts = []
        for raw, wrapper in zip(as_bytes(batch.column(len(names))), batch.column(len(names) + 1).to_pylist(), strict=True):
            texts.append(main_text(_decode(raw), None if wrapper is None else known[wrapper]))
        yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(names))], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*names, "text", "n_chars"])


def extract(pages: DataFrame, keep: list[str], url: str = "url", source: str = "html") -> DataFrame:
    """The columns `keep` with text (empty if there is none) and n_chars, one row for each row of pages. A null page counts as
    empty; pages without a host share one. Copies of a page, and pages with the same main text, vote once."""
    host = F.lower(F.coalesce(F.regexp_extract(F.col(f"`{url}`"), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1), F.lit("")))
    rows = pages.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], host.alias("host"), F.coalesce(F.col(f"`{source}`"), F.lit("")).alias("html"))
    small = _small(wrappers(rows.select("host", "html")), "wrapper")
    names = [f"k{i}" for i in range(len(keep))]
    schema = T.StructType([*[T.StructField(n, pages.schema[c].dataType) for n, c in zip(names, keep, strict=True)], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    found = rows.join(small, "host", "left").select(*names, "html", "wrapper").mapInArrow(partial(_extract, names=names), schema)
    return found.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], "text", "n_chars")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"), ["page_id", "url"])
