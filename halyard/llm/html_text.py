"""Main text of web pages by boosted trees over the nodes of the page.

A page becomes a tree of block elements with runs of text as leaves.  Gradient-
boosted trees give each node log odds of holding main text, from its subtree's
density, the tokens of its attributes and its ancestors', its depth and its
siblings.  Decoding then takes, of all choices in which a node is chosen only
together with its parent, the one of the largest total log odds: no text is kept
inside a rejected element.  The trees are trained here, on pages that a seeded
generator lays out in many ways and labels as it writes them.
"""

from __future__ import annotations

import functools
import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.llm.common import per_batch, pick, table

TRAIN_PAGES = 300
SEED = 3
TREES = 40
DEPTH = 4
RATE = 0.3
BINS = 32

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea template noscript iframe svg title xmp noembed noframes object".split())
BLOCK = frozenset(
    "html head body article section main nav header footer aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption form fieldset legend button select option address details summary dialog hgroup center menu search".split()
)
CLOSES_ITSELF = frozenset("li dt dd tr td th option".split())
TAG_KINDS = {
    "nav": "nav menu", "header": "header", "footer": "footer", "aside": "aside dialog", "form": "form fieldset button select option legend search",
    "article": "article", "main": "main", "section": "section", "div": "div center", "p": "p", "heading": "h1 h2 h3 h4 h5 h6 hgroup", "item": "li dt dd",
    "list": "ul ol dl", "table": "table thead tbody tfoot tr td th caption", "quote": "blockquote pre", "figure": "figure figcaption", "page": "html body", "head": "head",
}
TOKEN_KINDS = {
    "t_nav": "nav navbar navigation menu menubar breadcrumb breadcrumbs toc pager pagination toolbar skip",
    "t_head": "header masthead topbar banner logo branding head",
    "t_foot": "footer foot copyright legal colophon contentinfo bottom",
    "t_side": "sidebar aside side complementary widget widgets rail related recommended recommendations more popular trending",
    "t_ad": "ad ads adv advert advertisement advertising sponsor sponsored promo promotion promoted adsense dfp teaser affiliate",
    "t_notice": "cookie cookies consent gdpr notice alert popup modal overlay dialog privacy paywall warning hidden",
    "t_form": "form search login signup subscribe newsletter share sharing social follow contact register",
    "t_comment": "comment comments respond reply replies discussion disqus feedback reviews",
    "t_main": "article content main post entry story body text prose page document blog news",
}
_TAG_KIND = {t: k for k, ts in TAG_KINDS.items() for t in ts.split()}
_TOKEN_KIND = {t: k for k, ts in TOKEN_KINDS.items() for t in ts.split()}
_KINDS = [*TAG_KINDS, *TOKEN_KINDS]
_AT = {k: i for i, k in enumerate(_KINDS)}
_AWAY = ("nav", "header", "footer", "aside", "form", "head", *(k for k in TOKEN_KINDS if k != "t_main"))
_TOWARDS = ("article", "main", "t_main")

_TAG = re.compile(r"/?([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)")
_ATTR = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_SPLIT = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Page:
    """Nodes in page order: ``parent`` (-1 at the top), ``tag`` (None for text), ``tokens``, ``text``, ``linked``."""

    def __init__(self, source: str):
        self.parent: list[int] = []
        self.tag: list[str | None] = []
        self.tokens: list[list[str]] = []
        self.text: list[str] = []
        self.linked: list[int] = []
        self._stack: list[int] = []
        self._open: dict[str, int] = {}
        self._run: list[str] = []
        self._run_linked, self._in_link = 0, False
        self._read(source)
        self._flush()

    def _add(self, tag, tokens, text, linked) -> int:
        self.parent.append(self._stack[-1] if self._stack else -1)
        self.tag.append(tag)
        self.tokens.append(tokens)
        self.text.append(text)
        self.linked.append(linked)
        return len(self.parent) - 1

    def _flush(self) -> None:
        if self._run:
            text = " ".join(entities.unescape("".join(self._run)).split())
            if text:
                self._add(None, [], text, min(len(text), self._run_linked))
            self._run = []
        self._run_linked, self._in_link = 0, False

    def _words(self, text: str) -> None:
        self._run.append(text)
        if self._in_link:
            self._run_linked += len(text)

    def _pop(self) -> str:
        tag = self.tag[self._stack.pop()]
        self._open[tag] -= 1
        return tag

    def _start(self, tag: str, attributes: str) -> None:
        self._flush()
        while self._stack and (self.tag[self._stack[-1]] == "p" or (tag in CLOSES_ITSELF and self.tag[self._stack[-1]] == tag) or (tag != "head" and self.tag[self._stack[-1]] == "head")):
            self._pop()
        tokens = []
        for name, a, b, c in _ATTR.findall(attributes):
            tokens += ["hidden"] if name.lower() == "hidden" else [t.lower() for t in _SPLIT.findall(a or b or c)]
        self._stack.append(self._add(tag, tokens, "", 0))
        self._open[tag] = self._open.get(tag, 0) + 1

    def _end(self, tag: str) -> None:
        if self._open.get(tag):
            self._flush()
            while self._pop() != tag:
                pass
        elif tag == "p":
            self._flush()

    def _read(self, s: str) -> None:
        at, end = 0, len(s)
        while at < end:
            lt = s.find("<", at)
            if lt < 0:
                self._words(s[at:])
                return
            if lt > at:
                self._words(s[at:lt])
            if s.startswith("<!--", lt):
                close = s.find("-->", lt + 4)
                at = end if close < 0 else close + 3
                continue
            found = _TAG.match(s, lt + 1)
            if not found:
                if s[lt + 1 : lt + 2] in ("!", "?", "/"):
                    close = s.find(">", lt)
                    at = end if close < 0 else close + 1
                else:
                    self._words("<")
                    at = lt + 1
                continue
            close = s.find(">", found.end())
            at = end if close < 0 else close + 1
            tag, closing = found.group(1).lower(), s[lt + 1] == "/"
            if tag in BLOCK:
                self._end(tag) if closing else self._start(tag, found.group(2))
            elif tag in VOID:
                if tag == "hr":
                    self._flush()
                elif tag == "br":
                    self._words(" ")
            elif tag in RAW and not closing:
                if found.group(2).endswith("/") and tag in ("svg", "object"):
                    continue
                done = re.compile(f"</{tag}[^>]*>?", re.I).search(s, at)
                at = done.end() if done else end
            elif tag == "a":
                self._in_link = not closing

    def features(self) -> np.ndarray:
        """One row per node."""
        n = len(self.parent)
        size, linked, tags, leaves, marks = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
        depth, away, towards, kinds = [0] * n, [0] * n, [0] * n, []
        place, start = [0] * n, [0] * n
        siblings: dict[int, int] = {}
        alike: dict[tuple, int] = {}
        for k in range(n):
            up, tag = self.parent[k], self.tag[k]
            own = {_AT[_TOKEN_KIND[t]] for t in self.tokens[k] if t in _TOKEN_KIND}
            if tag in _TAG_KIND:
                own.add(_AT[_TAG_KIND[tag]])
            kinds.append(own)
            near = {_KINDS[i] for i in own}
            depth[k] = depth[up] + 1 if up >= 0 else 0
            away[k] = (away[up] if up >= 0 else 0) + any(a in near for a in _AWAY)
            towards[k] = (towards[up] if up >= 0 else 0) + any(a in near for a in _TOWARDS)
            place[k] = siblings.get(up, 0)
            siblings[up] = place[k] + 1
            alike[up, tag] = alike.get((up, tag), 0) + 1
            if tag is None:
                text = self.text[k]
                size[k], linked[k], leaves[k] = len(text), self.linked[k], 1
                marks[k] = text.count(".") + text.count(",") + text.count("!") + text.count("?")
            else:
                tags[k] = 1
        before = 0
        for k in range(n):
            start[k] = before
            before += size[k]
        for k in range(n - 1, -1, -1):
            up = self.parent[k]
            if up >= 0:
                size[up] += size[k]
                linked[up] += linked[k]
                tags[up] += tags[k]
                leaves[up] += leaves[k]
                marks[up] += marks[k]
        out = np.zeros((n, 15 + 2 * len(_KINDS)), np.float32)
        total, base = max(1, before), 15
        for k in range(n):
            up, s = self.parent[k], max(1, size[k])
            out[k, :15] = (
                self.tag[k] is None, depth[k], np.log1p(size[k]), linked[k] / s, leaves[k], size[k] / total, size[k] / (1 + tags[k]), 100 * marks[k] / s,
                size[k] / max(1, leaves[k]), start[k] / total, away[k], towards[k], siblings[up], place[k] / siblings[up], alike[up, self.tag[k]],
            )
            for i in kinds[k]:
                out[k, base + i] = 1
            if up >= 0:
                out[k, base + len(_KINDS) :] = np.maximum(out[up, base : base + len(_KINDS)], 0.5 * out[up, base + len(_KINDS) :])
        return out

    def decode(self, odds: np.ndarray) -> list[int]:
        """Text nodes of the best choice in which each node's parent is chosen too."""
        gain = odds.astype(float).tolist()
        for k in range(len(gain) - 1, -1, -1):
            up = self.parent[k]
            if up >= 0 and gain[k] > 0:
                gain[up] += gain[k]
        chosen = [False] * len(gain)
        for k, up in enumerate(self.parent):
            chosen[k] = gain[k] > 0 and (up < 0 or chosen[up])
        return [k for k, yes in enumerate(chosen) if yes and self.tag[k] is None]


class Trees:
    """Gradient-boosted complete trees for a yes-or-no target, log loss, second-order gains."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, ridge: float = 1.0):
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = [np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)]
        n, m = x.shape
        self.depth, self.base = depth, float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        self.feature = np.zeros((trees, 2**depth - 1), np.int32)
        self.limit = np.full((trees, 2**depth - 1), np.inf, np.float32)
        self.value = np.zeros((trees, 2**depth), np.float32)
        odds = np.full(n, self.base)
        for t in range(trees):
            p = 1 / (1 + np.exp(-odds))
            g, h = y - p, p * (1 - p)
            node = np.zeros(n, np.int64)
            for level in range(depth):
                wide = 2**level
                best, split = np.full(wide, 1e-6), np.zeros((wide, 2), np.int64) - 1
                for f in range(m):
                    if not len(edges[f]):
                        continue
                    key = node * BINS + binned[f]
                    sg = np.bincount(key, g, wide * BINS).reshape(wide, BINS).cumsum(1)
                    sh = np.bincount(key, h, wide * BINS).reshape(wide, BINS).cumsum(1)
                    gt, ht = sg[:, -1:], sh[:, -1:]
                    gains = sg**2 / (sh + ridge) + (gt - sg) ** 2 / (ht - sh + ridge) - gt**2 / (ht + ridge)
                    gains = gains[:, : len(edges[f])]
                    at = gains.argmax(1)
                    better = gains[np.arange(wide), at] > best
                    best[better] = gains[np.arange(wide), at][better]
                    split[better] = np.stack([np.full(wide, f), at], 1)[better]
                first = wide - 1
                for k in range(wide):
                    if split[k, 0] >= 0:
                        self.feature[t, first + k] = split[k, 0]
                        self.limit[t, first + k] = edges[split[k, 0]][split[k, 1]]
                right = x[np.arange(n), self.feature[t, first + node]] > self.limit[t, first + node]
                node = 2 * node + right
            sg, sh = np.bincount(node, g, 2**depth), np.bincount(node, h, 2**depth)
            self.value[t] = rate * sg / (sh + ridge)
            odds += self.value[t][node]

    def odds(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, limit, value in zip(self.feature, self.limit, self.value):
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = 2**level - 1 + node
                node = 2 * node + (x[rows, feature[at]] > limit[at])
            out += value[node]
        return out


#: Stands in the main text of generated pages, to label it
MARK = "\ue000"


#: Invented words for generated pages
_WORDS = ["".join("abdefghiklmnoprstuvwz"[(k * 7919 + j * j * 104729 + k // (j + 2)) % 21] for j in range(2 + k % 7)) for k in range(3000)]


def training_page(rng: np.random.Generator) -> str:
    """A generated page whose runs of main text hold MARK."""
    pick_one = lambda xs: xs[int(rng.integers(len(xs)))]
    chance = lambda p: rng.random() < p
    loud = chance(0.15)

    def words(n):
        out = []
        for k, mark in zip(rng.integers(len(_WORDS), size=n).tolist(), rng.random(n).tolist()):
            out.append(_WORDS[k] + ("###", "$$$", "%%%")[k % 3] * (loud and k % 2) + (",."[k % 2] if mark < 0.12 else ""))
        return " ".join(out) + pick_one([".", ".", ""])

    def element(tag, inner, tokens=(), by_class=True):
        names = [t for t in tokens]
        at = f' {"class" if by_class else "id"}="{pick_one([" ", "-"]).join(names)}"' if names else ""
        return f"<{tag}{at}>{inner}</{tag}>"

    kinds = {k: v.split() for k, v in TOKEN_KINDS.items()}
    some = lambda k: [pick_one(kinds[k]), *([pick_one(["wrap", "box", "area", "block", "left", "top"])] if chance(0.4) else [])]
    links = lambda n: "".join(element("li", f'<a href="/x">{words(int(rng.integers(1, 4)))}</a>') for _ in range(n))

    def away(kind):
        n = int(rng.integers(1, 3))
        prose = "".join(element("p", words(int(rng.integers(3, 60)))) for _ in range(n)) if chance(0.6) else words(int(rng.integers(3, 25)))
        listed = element("ul", links(int(rng.integers(2, 9))))
        tag = {"t_nav": ["nav", "div", "ul"], "t_head": ["header", "div"], "t_foot": ["footer", "div"], "t_side": ["aside", "div", "section"], "t_ad": ["div", "aside", "section"], "t_notice": ["div", "section", "dialog"], "t_form": ["form", "div"], "t_comment": ["section", "div", "ol"]}[kind]
        tag = pick_one(tag)
        plain = tag in ("nav", "header", "footer", "aside", "form", "dialog") and chance(0.5)
        inner = {"t_nav": listed if tag != "ul" else links(5), "t_head": pick_one([listed, words(4), element("h1", words(3)) + words(6), prose]), "t_side": pick_one([listed, prose, element("h3", words(2)) + listed])}.get(kind, prose)
        if kind == "t_form":
            inner = words(3) + "<input><button>" + words(1) + "</button>"
        if kind == "t_comment":
            inner = element("h3", words(1)) + "".join(element(pick_one(["div", "p", "li", "article"]), pick_one([words(20), element("p", words(20))]), some("t_comment") if chance(0.7) else ()) for _ in range(n + 1))
        return element(tag, inner, () if plain else some(kind), chance(0.7))

    def main(n):
        out = [element("h1", MARK + words(int(rng.integers(1, 8))))] if chance(0.8) else []
        for _ in range(n):
            text = MARK + words(int(rng.integers(1, 120)) if chance(0.8) else int(rng.integers(1, 6)))
            if chance(0.2):
                text = f"<b>{text}</b>"
            if chance(0.15):
                text += f' <a href="/y">{words(3)}</a>'
            if chance(0.1):
                text += "<br>"
            kind = rng.random()
            if kind < 0.75:
                out.append(f"<p>{text}" + ("</p>" if chance(0.85) else ""))
            elif kind < 0.8:
                out.append(element(pick_one(["h2", "h3"]), MARK + words(3)))
            elif kind < 0.85:
                out.append(element(pick_one(["ul", "ol"]), "".join(element("li", MARK + words(int(rng.integers(2, 15)))) for _ in range(3))))
            elif kind < 0.9:
                out.append(element("blockquote", text if chance(0.5) else element("p", text)))
            elif kind < 0.93:
                out.append(element("table", "".join(element("tr", element("td", MARK + words(2)) + element("td", MARK + words(3))) for _ in range(3))))
            elif kind < 0.96:
                out.append(element("pre", text))
            else:
                out.append(element("div", text))
            if chance(0.05):
                out.append(away(pick_one(["t_ad", "t_ad", "t_side", "t_form", "t_notice"])))
        return "".join(out)

    n = int(rng.integers(1, 12))
    layout = rng.random()
    if layout < 0.4:
        body = element("article", main(n), some("t_main") if chance(0.3) else ())
    elif layout < 0.75:
        body = element(pick_one(["div", "section", "main"]), main(n), some("t_main"), chance(0.6))
    elif layout < 0.85:
        body = element("main", element(pick_one(["article", "div"]), main(n)))
    else:
        body = element("div", main(n)) if chance(0.5) else main(n)
    if layout > 0.97:
        return MARK + words(n * 5)
    pre = [away(k) for k in ("t_head", "t_nav", "t_notice", "t_ad", "t_form") if chance(0.45)]
    post = [away(k) for k in ("t_side", "t_ad", "t_comment", "t_form", "t_nav", "t_foot", "t_foot", "t_notice") if chance(0.35)]
    if chance(0.3):
        body = element("div", "".join(pre) + body + "".join(post), ["wrapper"] if chance(0.5) else ())
        pre, post = [], []
    return f"<!DOCTYPE html><html><head><title>{words(3)}</title></head><body>{''.join(pre)}{body}{''.join(post)}</body></html>"


def labels_of(page: Page) -> np.ndarray:
    """1 for runs of text with MARK and for the elements around them."""
    y = np.array([MARK in t for t in page.text], float)
    for k in range(len(y) - 1, -1, -1):
        if y[k] and page.parent[k] >= 0:
            y[page.parent[k]] = 1
    return y


@functools.lru_cache(maxsize=2)
def trained(pages: int = TRAIN_PAGES, seed: int = SEED) -> Trees:
    """Trees fitted on ``pages`` generated pages, a bound that no input changes."""
    rng = np.random.default_rng(seed)
    made = [Page(training_page(rng)) for _ in range(pages)]
    return Trees(np.concatenate([p.features() for p in made]), np.concatenate([labels_of(p) for p in made]))


def main_text(sources: list[str | None], trees: Trees) -> list[str]:
    """Main text of each page, blocks joined by an empty line."""
    pages = [Page(s or "") for s in sources]
    rows = [p.features() for p in pages]
    odds = trees.odds(np.concatenate(rows)) if rows else []
    out, at = [], 0
    for page, x in zip(pages, rows):
        out.append("\n\n".join(page.text[k] for k in page.decode(odds[at : at + len(x)])))
        at += len(x)
    return out


def extract(pages: DataFrame, trees: Trees, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars), one row per input row, without any shuffle.

    A null or empty html, and a page without main text, give an empty text.
    Null ids and urls stay null; repeated rows each get their row; other columns
    are not read; an empty table gives an empty result.
    """
    shared = pages.sparkSession.sparkContext.broadcast(trees)  # TREES trees of DEPTH levels
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batch):
        texts = main_text(batch.column(2).to_pylist(), shared.value)
        return {"page_id": batch.column(0), "url": batch.column(1), "text": texts, "n_chars": [len(t) for t in texts]}

    rows = pick(pages, page_id=id_col, url=url_col, html=html_col).select(F.col("page_id").cast("long"), "url", "html")
    return rows.mapInArrow(per_batch(run, schema, 128), "page_id long, url string, text string, n_chars long")


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"), trained())
