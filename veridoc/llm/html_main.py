"""Main text of web pages by a tree-structured graphical model.

The page becomes a tree of block elements and text leaves.  Every node carries a hidden label,
content or not; node potentials come from its features (element, words of class, id and role,
amount of text, links), parent-child potentials connect labels along the tree.  Sum-product
messages, upward and then downward, give exact marginals; a leaf with a marginal of at least one half is
content.  The weights are fitted by gradient ascent of the conditional likelihood on labelled
pages, for which the same messages give the expected counts.  The labelled pages are drawn from
a seeded generator of page layouts (LABELLED pages: the documented bound of the sample), since
the tables carry no such labels.

Defined cases: null or empty html gives an empty text; a tag that has begun ends at the next ``>`` outside a closed quoted value,
or with the page, and is never text; repeated rows give equal rows; an empty table gives no rows; extra columns are ignored;
whole pages of any length and depth are read, in linear time.
"""

from __future__ import annotations

import html as entities
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from veridoc.llm.common import small_batches

LABELLED = 300
#: Comments and the like, or a tag: closing sign, name, attributes.  A quote counts only after "=" and only if it is closed, so a
#: tag that has begun ends at the next ">" outside such quotes, or with the page.
TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</(?=[^a-zA-Z])[^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z)", re.S,
)
ATTRIBUTE = re.compile(r"(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SLICE = 200  # pages whose trees are worked on at once
SLICE_CHARS = 16 << 20  # of their html; a longer page goes alone
# Elements by their role.
BLOCKS = "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption header footer nav aside form fieldset address details summary hr center dialog menu legend".split()
HIDDEN = "script style noscript template title textarea select option button svg iframe object canvas math audio video datalist head".split()
RAW = "script style title textarea noscript iframe".split()
VOID = "area base br col embed hr img input link meta source track wbr".split()
CLOSES_P = set(BLOCKS)
# An element that ends these before it if they are open inside the nearest of those.
ENDS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr",)), "th": (("td", "th"), ("tr",))}
SHUT = {t: re.compile(f"</{t}(?=[\\s/>]|\\Z)", re.I | re.A) for t in HIDDEN}
TAGS = "body main article section div p heading list li table quote pre figure header footer nav aside form address dialog leaf other".split()
KIND = {"h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading", "ul": "list", "ol": "list", "dl": "list", "dt": "li", "dd": "li", "table": "table", "thead": "table", "tbody": "table", "tfoot": "table", "tr": "table", "td": "table", "th": "table", "blockquote": "quote", "figcaption": "figure", "fieldset": "form", "legend": "form", "menu": "nav", "html": "body"}
# Words of class, id and role that tell what an element is for.
HINTS = {
    "ad": "ad ads advert advertisement adverts sponsor sponsored promo promotion banner adsense dfp",
    "nav": "nav navigation menu navbar breadcrumb breadcrumbs pager pagination toc tabs skip",
    "foot": "footer foot bottom copyright colophon legal contentinfo",
    "head": "header masthead topbar logo branding hero",
    "side": "sidebar side aside widget widgets related recommended trending popular rail complementary teaser more",
    "social": "share sharing social follow twitter facebook tags meta byline",
    "comment": "comment comments reply replies respond disqus discussion reader readers feedback thread",
    "notice": "notice cookie cookies consent gdpr popup modal overlay alert newsletter subscribe signup warning paywall banner message",
    "form": "form search login signin register input contact",
    "main": "article content post entry story main body text page articlebody maincontent",
}
HINT_OF = {w: k for k, ws in HINTS.items() for w in ws.split()}
HINT_NAMES = list(HINTS)
BUCKETS = (1, 20, 80, 250)
N_FEATURES = 1 + len(TAGS) + len(HINT_NAMES) + len(BUCKETS) + 5
CLUTTER = {1 + TAGS.index(t) for t in ("aside", "nav", "footer", "header", "form", "dialog")} | {1 + len(TAGS) + i for i, h in enumerate(HINT_NAMES) if h != "main"}
EDGE_KINDS = 3  # by the child: an element of running text or a leaf, a plain container, a container with a purpose
PLAIN = {"div", "section", "body", "table", "figure"}
RUNNING = {"p", "heading", "list", "li", "quote", "pre"}


class Page:
    """The tree: parents, features as index lists, and the text of the leaves."""

    def __init__(self, source: str, labelled: bool = False):
        self.labelled = labelled
        self.parent: list[int] = [-1]
        self.features: list[list[int]] = [[0]]
        self.edge: list[int] = [0]
        self.leaves: list[tuple[int, str]] = []
        self.clutter: list[bool] = [False]
        self.open: list[tuple[str, int]] = [("html", 0)]
        self.places: dict[str, list[int]] = {}  # of each tag, where in ``open`` it stands
        self.text: list[str] = []
        self.marks: dict[int, int] = {}  # only labelled pages have marks
        self.linked = self.link = 0
        self.read(source)

    def element(self, tag: str, attributes: str) -> int:
        f = [0, 1 + TAGS.index(KIND.get(tag, tag if tag in TAGS else "other"))]
        hints = set()
        if attributes:
            for m in ATTRIBUTE.finditer(attributes):
                hints |= {HINT_OF[w] for x in WORDS.findall(m[1] or m[2] or m[3] or "") if (w := x.lower()) in HINT_OF}
        f += [1 + len(TAGS) + HINT_NAMES.index(h) for h in hints]
        if self.clutter[self.open[-1][1]]:  # somewhere above is an element that tends not to hold content
            f.append(N_FEATURES - 1)
        self.clutter.append(self.clutter[self.open[-1][1]] or bool(CLUTTER & set(f)))
        self.parent.append(self.open[-1][1])
        self.features.append(f)
        kind = TAGS[f[1] - 1]
        self.edge.append(2 if hints or kind not in PLAIN | RUNNING else 0 if kind in RUNNING else 1)
        if self.labelled and "data-label" in attributes:
            self.marks[len(self.parent) - 1] = int(attributes[attributes.index("data-label") + 12])
        return len(self.parent) - 1

    def flush(self):
        """Ends the current run of inline text; a run with text becomes a leaf."""
        if self.text:
            run = " ".join(entities.unescape("".join(self.text)).split())
            if run:
                n = len(run)
                base = 1 + len(TAGS) + len(HINT_NAMES)
                f = [0, 1 + TAGS.index("leaf"), *[base + i for i, b in enumerate(BUCKETS) if n >= b]]
                base += len(BUCKETS)
                if self.linked * 2 >= n:
                    f.append(base)
                if run[-1] in ".!?:\"”…":
                    f.append(base + 1)
                if "©" in run or "cookie" in run.lower():
                    f.append(base + 2)
                if self.open[-1][0] == "p":
                    f.append(base + 3)
                self.parent.append(self.open[-1][1])
                self.clutter.append(False)
                self.features.append(f)
                self.edge.append(0)
                self.leaves.append((len(self.parent) - 1, run))
        self.text, self.linked = [], 0

    def last(self, tags: tuple[str, ...]) -> int:
        """Where the innermost open element with one of the tags stands, or 0."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def cut(self, k: int):
        """Ends the open elements from place ``k`` on."""
        while len(self.open) > k:
            self.places[self.open.pop()[0]].pop()

    def close(self, tag: str):
        if self.places.get(tag):
            self.cut(self.places[tag][-1])

    def read(self, source: str):
        at, end = 0, len(source)
        unshut = set()  # hidden elements without a closing tag from here on
        while at < end:
            m = TOKEN.search(source, at)
            if not m:
                self.put(source[at:])
                break
            if m.start() > at:
                self.put(source[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            tag, closing = m[2].lower(), m[1]
            if tag in SHUT and not closing and tag != "head" and not m[3].rstrip().endswith("/"):
                stop = None if tag in unshut else SHUT[tag].search(source, at)
                if stop:
                    shut = source.find(">", stop.end())
                    at = end if shut < 0 else shut + 1
                elif tag in RAW:
                    break
                else:
                    unshut.add(tag)
            elif tag == "br":
                self.text.append(" ")
            elif tag == "a":
                self.link = 0 if closing else 1
            elif tag in CLOSES_P:
                self.flush()
                if closing:
                    self.close(tag)
                    continue
                self.close("p")
                if tag in ENDS:
                    same, limit = map(self.last, ENDS[tag])
                    if same > limit:
                        self.cut(same)
                if tag != "hr":
                    self.places.setdefault(tag, []).append(len(self.open))
                    self.open.append((tag, self.element(tag, m[3])))
        self.flush()

    def put(self, text: str):
        self.text.append(text)
        if self.link:
            self.linked += len(text.strip())


class Forest:
    """Pages as one forest of arrays, for messages by depth."""

    def __init__(self, pages: list[Page]):
        counts = [len(p.parent) for p in pages]
        self.offset = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        self.n = int(self.offset[-1])
        self.parent = np.concatenate([np.array(p.parent) + o for p, o in zip(pages, self.offset)]) if pages else np.zeros(0, np.int64)
        roots = self.offset[:-1]
        self.parent[roots] = -1
        self.edge = np.concatenate([p.edge for p in pages]).astype(np.int64) if pages else np.zeros(0, np.int64)
        self.rows = np.repeat(np.arange(self.n), [len(f) for p in pages for f in p.features])
        self.cols = np.array([x for p in pages for f in p.features for x in f], np.int64)
        depth = np.zeros(self.n, np.int64)  # parents come before their children
        for p, o in zip(pages, self.offset):
            own = [0] * len(p.parent)
            for i, q in enumerate(p.parent[1:], 1):
                own[i] = own[q] + 1
            depth[o : o + len(own)] = own
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.searchsorted(depth[order], np.arange(1, int(depth.max(initial=0)) + 1)))[1:]

    def marginals(self, weights: np.ndarray, edges: np.ndarray):
        """P(label = content) of each node, and of each edge the joint of (parent, child); also the log partition."""
        node = np.zeros((self.n, 2))
        np.add.at(node[:, 1], self.rows, weights[self.cols])
        up = np.zeros((self.n, 2))  # message of each node to its parent
        belief = node.copy()
        for level in reversed(self.levels):
            m = belief[level][:, None, :] + edges[self.edge[level]]  # (node, parent's label, own label)
            top = m.max(axis=2)
            up[level] = top + np.log(np.exp(m - top[:, :, None]).sum(axis=2))
            np.add.at(belief, self.parent[level], up[level])
        roots = self.parent < 0
        top = belief[roots].max(axis=1)
        log_z = (top + np.log(np.exp(belief[roots] - top[:, None]).sum(axis=1))).sum()
        joint = np.zeros((self.n, 2, 2))
        for level in self.levels:
            down = belief[self.parent[level]] - up[level]
            m = down[:, :, None] + belief[level][:, None, :] + edges[self.edge[level]]
            m -= m.max(axis=(1, 2), keepdims=True)
            e = np.exp(m)
            joint[level] = e / e.sum(axis=(1, 2), keepdims=True)
            m = down[:, :, None] + edges[self.edge[level]]
            top = m.max(axis=1)
            belief[level] += top + np.log(np.exp(m - top[:, None, :]).sum(axis=1))
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500))), joint, log_z


def fit(pages: list[Page], labels: list[list[int]], steps: int = 150, rate: float = 1.5, ridge: float = 1e-5):
    """Node weights and parent-child potentials that maximise the conditional likelihood."""
    forest = Forest(pages)
    y = np.array([x for own in labels for x in own])
    weights, edges = np.zeros(N_FEATURES), np.zeros((EDGE_KINDS, 2, 2))
    has = np.flatnonzero(forest.parent >= 0)
    seen_w = np.bincount(forest.cols, weights=y[forest.rows], minlength=N_FEATURES)
    seen_e = np.zeros_like(edges)
    np.add.at(seen_e, (forest.edge[has], y[forest.parent[has]], y[has]), 1)
    sq_w, sq_e = np.full(N_FEATURES, 1e-8), np.full_like(edges, 1e-8)
    for _ in range(steps):
        p, joint, _ = forest.marginals(weights, edges)
        g_w = (seen_w - np.bincount(forest.cols, weights=p[forest.rows], minlength=N_FEATURES)) / forest.n - ridge * weights
        g_e = np.zeros_like(edges)
        np.add.at(g_e, forest.edge[has], joint[has])
        g_e = (seen_e - g_e) / forest.n - ridge * edges
        sq_w += g_w**2
        sq_e += g_e**2
        weights += rate * g_w / np.sqrt(sq_w)
        edges += rate * g_e / np.sqrt(sq_e)
    return weights, edges


# --- labelled pages ----------------------------------------------------------------------------


def sample_page(rng: random.Random) -> tuple[str, set[str]]:
    """A page of a random layout, and the texts of its content blocks."""
    syllables = "ka ro mi ten sol ver an di lu pra est or ne chi bo".split()
    content: set[str] = set()

    def word():
        return "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))

    def sentence(n=None):
        return " ".join(word() for _ in range(n or rng.randint(4, 18))).capitalize() + rng.choice([".", ".", ".", "", "!", "?"])

    def prose(lo=1, hi=5):
        return " ".join(sentence() for _ in range(rng.randint(lo, hi)))

    def attr(*names):
        kind = rng.choice(["class", "class", "id"])
        return f' {kind}="{rng.choice(names)}"'

    def links(n=None):
        return "<ul>" + "".join(f'<li><a href="/{word()}">{sentence(rng.randint(1, 3))}</a></li>' for _ in range(n or rng.randint(2, 9))) + "</ul>"

    def plain(tag, body, at=""):
        return f"<{tag}{at}>{body}</{tag}>"

    def marked(label, source):
        """The outermost element of ``source`` with its label."""
        return re.sub(r"^<\w+", lambda m: f'{m[0]} data-label="{label}"', source)

    def block(tag, text, at=""):
        content.add(text)
        return plain(tag, f"<b>{text}</b>" if rng.random() < 0.1 else text, at)

    def noise():
        return marked(0, clutter())

    def clutter():
        body = rng.choice([prose(1, 1), plain("p", prose(1, 3)), plain("h3", sentence(2)) + links(), plain("p", sentence()) + links(2)])
        pick = rng.randrange(9)
        if pick == 0:
            return plain("div", body, attr("ad", "ads", "advert", "ad-slot", "sponsored", "promo-box", "banner"))
        if pick == 1:
            return plain(rng.choice(["aside", "aside", "div"]), body, attr("sidebar", "side", "widget", "related", "sidebar-right"))
        if pick == 2:
            return plain("div", plain("p", prose(1, 2)), attr("notice", "cookie-notice", "cookie-banner", "consent", "alert", "newsletter"))
        if pick == 3:
            return plain("form", f"<label>{sentence(2)}</label><input><p>{prose(1, 1)}</p><button>{word()}</button>", rng.choice(["", attr("search", "login", "contact-form", "subscribe")]))
        if pick == 4:
            return plain("div", links(), attr("menu", "breadcrumbs", "share", "social", "pagination", "tags"))
        if pick == 5:
            return plain("aside", body)
        if pick == 6:
            return plain("nav", links())
        if pick == 7:
            return remarks()
        return plain("form", f"<p>{prose(1, 1)}</p><input>")

    def comments():
        return marked(0, remarks())

    def remarks():
        each = "".join(plain(rng.choice("div div div div li li li article".split()), plain("p", prose(1, 3)), rng.choice(["", attr("comment", "reply", "comment-body")])) for _ in range(rng.randint(1, 4)))
        return plain(rng.choice(["section", "div", "ol"]), plain("h3", sentence(1)) + each, attr("comments", "comment-list", "replies", "discussion", "reader-comments"))

    def story():
        out = [block(rng.choice(["h1", "h1", "h2"]), sentence(rng.randint(1, 30)))] if rng.random() < 0.7 else []
        short = rng.random() < 0.25
        for _ in range(rng.choice([1, 1, 2, 20]) if short else rng.randint(1, 9)):
            if short and rng.random() < 0.8:
                out.append(block("p", sentence(rng.randint(1, 3))))
                continue
            pick = rng.random()
            if pick < 0.72:
                out.append(block("p", prose(1, 6)))
            elif pick < 0.8:
                out.append(block(rng.choice(["h2", "h3"]), sentence(rng.randint(1, 5))))
            elif pick < 0.86:
                out.append("<ul>" + "".join(block("li", sentence()) for _ in range(rng.randint(2, 4))) + "</ul>")
            elif pick < 0.9:
                out.append(rng.choice([lambda: plain("blockquote", block("p", prose(1, 2))), lambda: block("pre", prose(1, 1)), lambda: plain("table", plain("tr", block("td", sentence(2)) + block("td", sentence(1))))])())
            elif pick < 0.93:
                text = prose(1, 2)
                content.add(text)
                out.append(f"<div>{text}</div>")
            else:
                out.append(noise())
        return "".join(out)

    top = marked(0, rng.choice([" ", plain("header", plain("a", word()) + links(3)), plain("div", plain("p", sentence(2)) + links(4), attr("header", "site-header", "masthead", "topbar")), plain("nav", links()), plain("header", plain("h1", word()) + plain("nav", links()))]))
    end = marked(0, rng.choice([plain("footer", f"&copy; {word()} &middot; {prose(1, 1)}"), plain("footer", plain("p", prose(1, 2)) + links(3)), plain("div", prose(1, 1) + links(3), attr("footer", "site-footer", "bottom")), " "]))
    body = story()
    body = marked(1, rng.choice([
        lambda: plain("article", body), lambda: plain("main", plain("article", body)), lambda: plain("main", body), lambda: plain("article", body, attr("post", "story")),
        lambda: plain("div", body, attr("content", "article-body", "post-content", "entry", "main-content", "story")), lambda: plain("div", plain("div", body), attr("content", "main", "page")),
        lambda: plain("article", plain("section", body)), lambda: plain("section", body, attr("story", "post-body", "entry-content")),
    ])())
    if rng.random() < 0.3:
        body = plain("div", body, rng.choice(["", attr("container", "wrapper", "page", "row")]))
    page = top + "".join(noise() for _ in range(rng.randint(0, 3))) + body + "".join(noise() for _ in range(rng.randint(0, 3))) + rng.choice(["", "c"]).replace("c", comments()) + end
    return f"<html><head><title>{sentence()}</title></head><body>{page}</body></html>", content


def labelled(n: int = LABELLED, seed: int = 7) -> tuple[list[Page], list[list[int]]]:
    rng = random.Random(seed)
    pages, labels = [], []
    while len(pages) < n:
        source, content = sample_page(rng)
        page = Page(source, labelled=True)
        own = [0] * len(page.parent)
        for i in range(1, len(own)):  # parents come first
            own[i] = page.marks.get(i, own[page.parent[i]])
        pages.append(page)
        labels.append(own)
    return pages, labels


@lru_cache(1)
def trained() -> tuple[np.ndarray, np.ndarray]:
    return fit(*labelled())


def extract(sources: list[str | None], weights: np.ndarray, edges: np.ndarray) -> list[str]:
    pages = [Page(s or "") for s in sources]
    forest = Forest(pages)
    p = forest.marginals(weights, edges)[0]
    return ["\n\n".join(text for i, text in page.leaves if p[o + i] >= 0.5) for page, o in zip(pages, forest.offset)]


def portions(sizes: list[int]):
    """Ranges of at most SLICE pages and, unless it is one page, SLICE_CHARS of html."""
    lo = held = 0
    for i, size in enumerate(sizes):
        if i > lo and (i - lo >= SLICE or held + size > SLICE_CHARS):
            yield lo, i
            lo, held = i, 0
        held += size
    if sizes:
        yield lo, len(sizes)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page; extra columns are ignored."""
    small_batches(pages.sparkSession)
    weights, edges = trained()

    def run(batches):
        for batch in batches:
            sources = batch.column(2).to_pylist()
            for lo, hi in portions([len(s or "") for s in sources]):
                b, texts = batch.slice(lo, hi - lo), extract(sources[lo:hi], weights, edges)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.selectExpr(f"cast(`{id_col}` as bigint) as page_id", f"cast(`{url_col}` as string) as url", f"`{html_col}` as html").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
