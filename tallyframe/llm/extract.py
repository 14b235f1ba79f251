"""Op 8. Main text of web pages by sum-product on the DOM tree.

A page is parsed to a tree: block elements, inline elements that bear a class, id or role,
and the text runs under them. Every node has a hidden state, content or not. A region's own
potential comes from its tag and its class, id and role words, a text run's from its length
and share of linked characters; an edge potential couples a node with its parent, one for
regions (which often differ from their parent) and one for plain nodes. All are estimated from labelled pages (``extract_pages``, counts with add-one smoothing). Messages
go up the tree and down again; a text run is kept when its content marginal is over 1/2.
The messages of a whole slice of pages are computed together, one tree level at a time.

Kept runs form the text: blocks in page order joined by a newline, references decoded,
white space inside a block as one space. Nothing is dropped or capped otherwise.

Defined results: null or empty html gives an empty text; unclosed and truncated markup is
closed at the end of the page; other columns stay (a column that bears an output name is
replaced); repeated rows give equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _text as X
from .extract_pages import pages

BLOCK = frozenset("html head body div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre "
                  "article section main header footer nav aside form fieldset figure figcaption address details summary hr menu "
                  "center dialog search legend".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose whole inside is no text of the page.
RAW = frozenset("script style title template noscript iframe textarea select".split())
#: Elements whose inside stands in for what cannot be shown, if they are closed at all.
MEDIA = frozenset("svg object canvas audio video".split())
#: Controls count as nodes of their own.
CONTROL = frozenset("button label option output input".split())
#: Elements that by themselves mark a region of a page. Those and elements with class, id
#: or role words are region nodes; all others are plain and mostly share their parent's state.
REGION = frozenset("html body nav header footer aside form main article menu dialog address fieldset search".split()) | CONTROL
CLOSED_BY = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
             "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
P_SCOPE = frozenset("td th table button html body".split())
SPACES = re.compile(r"[\s\x00]+")
TAG = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|$)"
                 r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)|<[!?/][^>]*(?:>|$)", re.S)
ATTR = re.compile(r"""(?<![\w-])(class|id|role|y)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD = re.compile(r"[a-z]+")


class Page:
    """Nodes in document order (parents first): parent, depth, features; text runs with
    their node and block; ``marks``: the labels, on training pages."""

    def __init__(self, html: str, labelled: bool = False):
        self.parent, self.depth, self.feats, self.marks = [-1], [0], [("tag:#root",)], [1]
        self.region = [0]  # the nearest region node, itself included
        self.runs: list[list] = []  # node, block, pieces, linked characters
        stack: list[tuple[str, int]] = [("#root", 0)]
        block, links, at, n = 0, 0, 0, len(html)
        fresh = True

        def text(piece: str) -> None:
            nonlocal fresh
            if not piece:
                return
            piece = unescape(piece) if "&" in piece else piece
            if self.runs and not fresh and self.runs[-1][1] == block:
                run = self.runs[-1]
            elif piece.strip(" \t\n\r\f\v\0") or (self.runs and self.runs[-1][1] == block):
                run = [len(self.parent), block, [], 0]
                self._node(stack[-1][1], None)
                self.runs.append(run)
                fresh = False
            else:
                return
            run[2].append(piece)
            run[3] += len(piece) if links else 0

        while m := TAG.search(html, at):  # from the place reached: what a script holds is no tag
            text(html[at:m.start()])
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            name, closing, attrs = name.lower(), m[1] or m[4], m[3] or m[6] or ""
            if closing:
                if name == "a":
                    links = max(0, links - 1)
                if name in BLOCK:
                    block, fresh = block + 1, True
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == name:
                        fresh = True
                        del stack[i:]
                        break
                    if name not in BLOCK and stack[i][0] in BLOCK:
                        break
                continue
            if name in RAW or name in MEDIA:
                if not attrs.endswith("/"):
                    end = re.compile(rf"</{name}\s*(?:>|$)", re.I).search(html, at)
                    at = end.end() if end else at if name in MEDIA else n
                continue
            if name == "br":
                text(" ")
                continue
            if name == "a":
                links += 1
            words, mark = (), None
            if attrs and ("=" in attrs):
                found = ATTR.findall(attrs)
                words = tuple(f"word:{w}" for k, *v in found if k.lower() != "y" for w in WORD.findall("".join(v).lower()))
                if labelled:
                    mark = next((int("".join(v)) for k, *v in found if k == "y"), None)
            if name in BLOCK:
                block, fresh = block + 1, True
                if name in CLOSED_BY:
                    ends, scope = CLOSED_BY[name]
                    self._close(stack, ends, scope)
                self._close(stack, {"p"}, P_SCOPE)
                links = 0 if name in ("p", "div", "article", "section", "main") else links
            elif not (words or name in CONTROL):
                continue
            if name in VOID:
                continue
            fresh = True
            stack.append((name, len(self.parent)))
            own = (f"tag:{name}",) if name in REGION else ()
            self._node(stack[-2][1], (*own, *dict.fromkeys(words)), mark)
        text(html[at:])

    def _node(self, parent: int, feats, mark=None) -> None:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.feats.append(feats)
        self.marks.append(self.marks[parent] if mark is None else mark)
        self.region.append(len(self.parent) - 1 if feats else self.region[parent])

    @staticmethod
    def _close(stack, ends, scope) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in ends:
                del stack[i:]
                return
            if stack[i][0] in scope:
                return

    def finish(self) -> None:
        """Features of the text runs."""
        for run in self.runs:
            body = SPACES.sub(" ", "".join(run[2]))
            run[2] = body
            size = len(body.strip())
            linked = 2 * run[3] > max(1, size)
            self.feats[run[0]] = (f"run:{min(int(size).bit_length(), 8)}:{int(linked)}",)

    def potentials(self, odds: dict[str, float]) -> list[float]:
        """Log odds of each node by itself. The text runs of a region count as their mean:
        they are far from independent, and a long list must not outvote its region."""
        out = [sum(odds.get(f, 0.0) for f in fs or ()) for fs in self.feats]
        many = Counter(self.region[r[0]] for r in self.runs)
        for r in self.runs:
            out[r[0]] /= many[self.region[r[0]]]
        return out

    def text(self, keep) -> str:
        blocks: dict[int, list[str]] = {}
        for run, k in zip(self.runs, keep):
            if k:
                blocks.setdefault(run[1], []).append(run[2])
        out = (SPACES.sub(" ", "".join(b)).strip() for b in blocks.values())
        return "\n".join(b for b in out if b)


def train(labelled: list[str]) -> tuple[dict[str, float], np.ndarray]:
    """(log odds of each feature, log edge potentials [plain or region child, parent, child]) from marked pages."""
    seen, edge, prior = Counter(), np.ones((2, 2, 2)), np.ones(2)
    for html in labelled:
        page = Page(html, labelled=True)
        page.finish()
        y = page.marks
        for i in range(len(y)):
            if i:
                edge[int(page.region[i] == i), y[page.parent[i]], y[i]] += 1
            prior[y[i]] += 1
            for f in page.feats[i] or ():
                seen[f, y[i]] += 1
    feats = {f for f, _ in seen}
    odds = {f: float(np.log((seen[f, 1] + 1) / (prior[1] + 2)) - np.log((seen[f, 0] + 1) / (prior[0] + 2))) for f in feats}
    return odds, np.log(edge / edge.sum(axis=2, keepdims=True))


_MODEL: list = []


def model():
    if not _MODEL:
        _MODEL.append(train(pages()))
    return _MODEL[0]


def marginals(parent: np.ndarray, depth: np.ndarray, kind: np.ndarray, odds: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Content marginals of a forest (roots have parent -1; parents come first)."""
    own = np.zeros((len(parent), 2))
    own[:, 1] = odds
    order = np.argsort(depth, kind="stable")
    cuts = np.searchsorted(depth[order], np.arange(int(depth.max(initial=0)) + 2))
    levels = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
    up = own.copy()  # potential times messages of the children
    to_parent = np.zeros_like(own)
    for nodes in levels[:0:-1]:
        e = edge[kind[nodes]]
        msg = np.logaddexp(e[:, :, 0] + up[nodes, :1], e[:, :, 1] + up[nodes, 1:])
        msg -= msg.max(axis=1, keepdims=True)
        to_parent[nodes] = msg
        for c in (0, 1):
            up[:, c] += np.bincount(parent[nodes], weights=msg[:, c], minlength=len(parent))
    belief = up.copy()
    for nodes in levels[1:]:
        rest = belief[parent[nodes]] - to_parent[nodes]
        e = edge[kind[nodes]]
        msg = np.logaddexp(rest[:, :1] + e[:, 0], rest[:, 1:] + e[:, 1])
        belief[nodes] = up[nodes] + msg - msg.max(axis=1, keepdims=True)
    d = belief[:, 1] - belief[:, 0]
    return 1 / (1 + np.exp(-np.clip(d, -500, 500)))


def main_texts(htmls: list[str | None]) -> list[str]:
    odds, edge = model()
    made, parent, depth, kind, score, runs, base = [], [], [], [], [], [], 0
    for html in htmls:
        page = Page(html or "")
        page.finish()
        made.append(page)
        parent.append(np.array(page.parent) + base)
        parent[-1][0] = -1
        depth.append(page.depth)
        score.extend(page.potentials(odds))
        kind.extend(int(r == i) for i, r in enumerate(page.region))
        runs.append([r[0] + base for r in page.runs])
        base += len(page.parent)
    if not made:
        return []
    p = marginals(np.concatenate(parent), np.concatenate([np.array(d) for d in depth]), np.array(kind), np.array(score), edge)
    return [page.text(p[r] > 0.5 if r else []) for page, r in zip(made, runs)]


OUT = {"text": T.StringType(), "n_chars": T.LongType()}


def extract(pages_df: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages_df`` without its html, with text and n_chars."""
    kept = [c for c in pages_df.columns if c.lower() not in OUT and c.lower() != html_col.lower()]
    names = {c: f"__in{i}" for i, c in enumerate(kept)}  # plain names: mapInArrow takes none with dots
    d = pages_df.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], F.col(f"`{html_col}`").alias("__html"))
    schema = T.StructType([*d.schema.fields[:-1], *[T.StructField(k, t) for k, t in OUT.items()]])

    def run(batches):
        for batch in batches:
            for part in X.slices(batch, "__html", 1_000_000):
                texts = main_texts(part.column(len(kept)).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string()),
                                                  pa.array([len(t) for t in texts], pa.int64())], [*names.values(), *OUT])
    return d.mapInArrow(run, schema).select(*[F.col(n).alias(c) for c, n in names.items()], *OUT)
