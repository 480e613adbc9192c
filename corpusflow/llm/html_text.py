"""Main text of HTML pages by a tree-structured graphical model.

Each element is a node with a hidden label, content or boilerplate. Its tag, its
class and id words and the shape of its own text give it a unary potential; each
parent-child edge has a potential that depends on the child's kind of tag. The sum-
product algorithm passes messages upward and downward through the tree and yields
each node's exact marginal; text whose element is content with a probability of
one half or more is kept. All potentials, the root's among them, are estimated from
labelled pages (those of ``html_pages``, or the caller's), in closed form.

Text inside a block is joined without the inline tags; white space becomes one
space; blocks are joined in page order. Character references are decoded.

Defined cases: a null or empty page has an empty text; markup cut off at the end
is dropped; unclosed and stray tags are tolerated; text without any element is
content; repeated rows each get a row; extra columns are ignored.
"""

from __future__ import annotations

import functools
import html
import itertools
import math
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import lists, record
from corpusflow.llm.html_pages import labelled_pages

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*+)>|<[!?/a-zA-Z][^>]*(?:>|\Z)""", re.S)
ATTR = re.compile(r"""(?:^|\s)(class|id|role|data-y)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORDS = re.compile(r"[a-z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
RAW = frozenset("script style noscript template textarea title iframe svg xmp".split())
SILENT = frozenset("script style noscript template iframe svg xmp textarea".split())
CLOSES = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]),
    "option": frozenset(["option"]),
}
SCOPES = frozenset("table ul ol dl article section div main aside nav form footer header body html td th".split())
REGIONS = frozenset("nav footer header aside form head menu dialog button select fieldset".split())
MAINS = frozenset("article main".split())
HINTED = frozenset("div section table ul ol span td".split())
WHOLES = frozenset("article main section".split())
HEADS = frozenset("head title meta style script link base".split())
TELLING = frozenset("cookie cookies privacy copyright reserved imprint advertisement sponsored newsletter subscribe login comments share tweet javascript".split())
SHORT = 200
TEMPERS = (0.1, 0.25, 0.5, 1.0)
SPACE = re.compile(r"\s+")


class Page:
    """A page's elements (parents first) and its text runs in page order: (element, text or a break)."""

    __slots__ = ("parent", "tag", "hints", "mark", "runs")

    def __init__(self, page: str | None):
        self.parent, self.tag, self.hints, self.mark = [-1], ["#page"], [()], [None]
        self.runs: list[tuple[int, str | None]] = []
        s, at, stack, end = page or "", 0, [0], len(page or "")
        low = None
        while at < end:
            m = TAG.search(s, at)
            if m is None:
                self.runs.append((stack[-1], s[at:]))
                break
            if m.start() > at:
                self.runs.append((stack[-1], s[at : m.start()]))
            at = m.end()
            name = m.group(2)
            if name is None:
                continue
            name = name.lower()
            if m.group(1):
                self._close(stack, name)
                continue
            if name not in INLINE:
                self._imply(stack, name)
            words, mark = (), None
            if m.group(3):
                found = [(k.lower(), a or b or c) for k, a, b, c in ATTR.findall(m.group(3))]
                words = tuple(sorted({w for k, v in found if k != "data-y" for w in WORDS.findall(v.lower())}))
                mark = next((v == "1" for k, v in found if k == "data-y"), None)
            self.parent.append(stack[-1])
            self.tag.append(name)
            self.hints.append(words)
            self.mark.append(mark)
            node = len(self.tag) - 1
            if name not in INLINE:
                self.runs.append((node, None))
            if name in VOID or m.group(3).endswith("/"):
                continue
            if name in RAW:
                low = s.lower() if low is None or len(low) != len(s) else low
                stop = low.find(f"</{name}", at)
                stop = end if stop < 0 else stop
                if name not in SILENT:
                    self.runs.append((node, s[at:stop]))
                    self.runs.append((node, None))
                gt = s.find(">", stop)
                at = end if gt < 0 else gt + 1
                continue
            stack.append(node)

    def _close(self, stack: list[int], name: str) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if self.tag[stack[k]] == name:
                del stack[k:]
                if name not in INLINE:
                    self.runs.append((stack[-1], None))
                return
            if name in INLINE and self.tag[stack[k]] in SCOPES:
                return
        if name in ("p", "br"):
            self.runs.append((stack[-1], None))

    def _imply(self, stack: list[int], name: str) -> None:
        """Start tags that end open elements: a block ends an open p, an item the item before."""
        ends = CLOSES.get(name, frozenset()) | (frozenset(["p"]) if name not in VOID else frozenset())
        for k in range(len(stack) - 1, 0, -1):
            t = self.tag[stack[k]]
            if t in ends:
                del stack[k:]
                return
            if t in SCOPES:
                return


def _kind(p: Page, i: int, known: frozenset[str] | None = None) -> str:
    """What an edge's potential depends on: the child's kind of tag; of regions, the tag and whether they lie in an article."""
    tag = p.tag[i]
    if tag in INLINE:
        return "inline"
    if tag in REGIONS:
        return f"{tag}/{p.tag[p.parent[i]] in WHOLES}"
    if tag in RAW:
        return "raw"
    if tag in MAINS:
        return "main"
    return "hinted" if tag in HINTED and (p.hints[i] if known is None else known.intersection(p.hints[i])) else "block"


def _features(p: Page) -> list[list[str]]:
    """Of each element: its tag (regions also by what they lie in), hints, shape of its own text and of all text below, its share of the page's plain text, telling words of short texts."""
    n = len(p.tag)
    own, linked, said = [0] * n, [0] * n, defaultdict(set)
    for node, t in p.runs:
        if t:
            size, k, link = len(t.strip()), node, 0
            while k > 0 and p.tag[k] in INLINE:
                if p.tag[k] == "a":
                    link = size
                k = p.parent[k]
            for at in {node, k}:
                own[at] += size
                linked[at] += link
            if 0 < size < SHORT:
                said[k].update(TELLING.intersection(WORDS.findall(t.lower())))
                if "&copy;" in t or "©" in t:
                    said[k].add("copyright")
    below, below_linked = [0 if p.tag[i] in INLINE else x for i, x in enumerate(own)], [0 if p.tag[i] in INLINE else x for i, x in enumerate(linked)]
    for i in range(n - 1, 0, -1):
        below[p.parent[i]] += below[i]
        below_linked[p.parent[i]] += below_linked[i]
    plain = max(1, below[0] - below_linked[0]) * 1.0001
    out = []
    for i, tag in enumerate(p.tag):
        f = [f"tag={tag}"] + [f"hint={h}" for h in p.hints[i]]
        if tag in REGIONS and i:
            f.append(f"in={tag}/{p.tag[p.parent[i]] if p.tag[p.parent[i]] in WHOLES else ''}")
        if own[i]:
            f.append(f"size={min(3, int(math.log10(own[i] + 1)))}")
            f.append(f"link={min(2, int(3 * linked[i] / own[i]))}")
            if own[i] < SHORT:
                f += [f"word={w}" for w in said[i]]
        if below[i] and tag not in INLINE:
            f.append(f"below={min(4, int(math.log10(below[i] + 1)))}/{min(3, int(4 * below_linked[i] / below[i]))}")
            f.append(f"share={int(5 * (below[i] - below_linked[i]) / plain)}")
        out.append(f)
    return out


def labels(p: Page) -> list[int]:
    """Each element's label: its nearest mark's; without one, that of most of the text below it."""
    n = len(p.tag)
    y: list[int | None] = [None] * n
    own = [[0, 0] for _ in range(n)]
    for i in range(n):
        y[i] = int(p.mark[i]) if p.mark[i] is not None else y[p.parent[i]] if i else None
    for node, t in p.runs:
        if t:
            own[node][y[node] or 0] += len(t.strip())
    for i in range(n - 1, 0, -1):
        for k in (0, 1):
            own[p.parent[i]][k] += own[i][k]
    return [int(own[i][1] > own[i][0]) if v is None and p.tag[i] not in HEADS else v or 0 for i, v in enumerate(y)]


class TreeModel:
    def __init__(self, pages: list[str], smooth: float = 0.5):
        """Estimate the potentials from pages whose data-y attributes label elements and what is inside them.

        Features of an element go together, so each counts for less than an independent sign would: the
        exponents of hints and of other features are those with the fewest characters misjudged on a
        third of the pages by a model of the others.
        """
        parsed = [(p := Page(x), labels(p)) for x in pages]
        parts = [q for k, q in enumerate(parsed) if k % 3], [q for k, q in enumerate(parsed) if k % 3 == 0]
        self._estimate(parts[0] or parsed, smooth)
        costs = []
        for self.temper in itertools.product(TEMPERS, TEMPERS):
            costs.append((sum(self._misjudged(p, y) for p, y in parts[1]), self.temper))
        self.temper = min(costs)[1]
        self._estimate(parsed, smooth)

    def _estimate(self, parsed: list[tuple[Page, list[int]]], smooth: float) -> None:
        seen, counts = [Counter(), Counter()], [0, 0]
        edge = defaultdict(lambda: [[smooth, smooth], [smooth, smooth]])
        roots = [smooth, smooth]
        for p, y in parsed:
            roots[y[0]] += 1
            for i, f in enumerate(_features(p)):
                counts[y[i]] += 1
                seen[y[i]].update(f)
                if i:
                    edge[_kind(p, i)][y[p.parent[i]]][y[i]] += 1
        names = set(seen[0]) | set(seen[1])
        self.odds = {f: math.log((seen[1][f] + smooth) / (counts[1] + 2 * smooth)) - math.log((seen[0][f] + smooth) / (counts[0] + 2 * smooth)) for f in names}
        self.known = frozenset(f[5:] for f in names if f[:5] == "hint=")
        self.edge = {k: tuple(tuple(c / sum(row) for c in row) for row in m) for k, m in edge.items()}
        self.default = ((0.8, 0.2), (0.2, 0.8))
        self.root = (roots[0] / sum(roots), roots[1] / sum(roots))

    def _misjudged(self, p: Page, y: list[int]) -> int:
        at = self.marginals(p)
        return sum(len(t.strip()) for node, t in p.runs if t and (at[node] >= 0.5) != y[node])

    def unary(self, p: Page) -> list[tuple[float, float]]:
        out, (hint, other) = [], self.temper
        for f in _features(p):
            o = max(-30.0, min(30.0, sum(self.odds.get(x, 0.0) * (hint if x[:5] == "hint=" else other) for x in f)))
            a = 1 / (1 + math.exp(-o))
            out.append((1 - a, a))
        return out

    def marginals(self, p: Page) -> list[float]:
        """P(content) of every element, by one upward and one downward pass."""
        n = len(p.tag)
        psi = [self.edge.get(_kind(p, i, self.known), self.default) for i in range(n)]
        up = [[u0, u1] for u0, u1 in self.unary(p)]  # unary times the messages of the children, scaled
        msg = [(1.0, 1.0)] * n
        for i in range(n - 1, 0, -1):  # children come after their parents
            b0, b1 = up[i]
            (a00, a01), (a10, a11) = psi[i]
            m0, m1 = a00 * b0 + a01 * b1, a10 * b0 + a11 * b1
            s = m0 + m1
            m0, m1 = max(m0 / s, 1e-300), max(m1 / s, 1e-300)
            msg[i] = (m0, m1)
            q = up[p.parent[i]]
            q0, q1 = q[0] * m0, q[1] * m1
            s = q0 + q1
            q[0], q[1] = max(q0 / s, 1e-300), max(q1 / s, 1e-300)
        b0, b1 = up[0][0] * self.root[0], up[0][1] * self.root[1]
        belief = [(b0 / (b0 + b1), b1 / (b0 + b1))] * n
        out = [belief[0][1]] * n
        for i in range(1, n):
            c0, c1 = belief[p.parent[i]]
            c0, c1 = c0 / msg[i][0], c1 / msg[i][1]  # without what this child said
            (a00, a01), (a10, a11) = psi[i]
            d0, d1 = c0 * a00 + c1 * a10, c0 * a01 + c1 * a11
            b0, b1 = up[i][0] * d0, up[i][1] * d1
            s = b0 + b1
            belief[i] = (b0 / s, b1 / s) if s > 0 else (0.5, 0.5)
            out[i] = belief[i][1]
        if n == 1:
            out[0] = 1.0
        return out

    def text(self, page: str | None) -> str:
        p = Page(page)
        keep = self.marginals(p)
        blocks, block = [], []
        for node, t in p.runs:
            if t is None:
                if block:
                    blocks.append("".join(block))
                    block = []
            elif keep[node] >= 0.5:
                block.append(t)
        if block:
            blocks.append("".join(block))
        return " ".join(x for x in (SPACE.sub(" ", html.unescape(b)).strip() for b in blocks) if x)


@functools.cache
def default_model() -> TreeModel:
    return TreeModel(labelled_pages())


def _extract(model: TreeModel):
    def run(batches):
        for b in batches:
            ids, urls, pages = lists(b, "page_id", "url", "html")
            texts = [model.text(p) for p in pages]
            yield record(page_id=(ids, pa.int64()), url=(urls, pa.string()), text=(texts, pa.string()), n_chars=([len(t) for t in texts], pa.int64()))

    return run


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", labelled: list[str] | None = None) -> DataFrame:
    """One row per page: page_id, url, text, n_chars. ``labelled`` pages mark elements with data-y."""
    d = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").alias("html"))
    return d.mapInArrow(_extract(default_model() if labelled is None else TreeModel(labelled)), "page_id long, url string, text string, n_chars long")
