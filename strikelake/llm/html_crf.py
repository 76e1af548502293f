"""Main-text extraction by a linear-chain conditional random field over the leaf blocks of a page.

``blocks`` walks the markup once with a stack of open elements and yields the page's leaf blocks: the text between two
block-level tags, with its ancestors. Each block has features of its ancestors' tags and class names and of its
text (words, share of links, punctuation). The field has two labels, content and the rest, with a weight per
(feature, label) and per pair of neighbouring labels. It is trained by the gradient of the likelihood
(forward-backward) on labelled pages and decoded by Viterbi. What it takes for content is the main text.

The labelled pages are composed by a fixed seed (``compose``) from layouts with menus, headers, footers, sidebars,
notices, adverts, forms and reader comments around articles in different containers. ``train`` takes any others.

Defined results: a null or empty page has an empty text; formulas are text, drawings aren't; broken and cut-off
markup is read as far as it goes; a page is judged alike however often it stands in the table; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGES, EPOCHS, RATE, DECAY, SEED = 240, 6, 0.5, 1e-4, 11

# Element names of HTML by how they shape text.
RAW = "script|style|title|template|noscript|svg|iframe|object|canvas|select|textarea|audio|video"
MATH = frozenset(("math semantics mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom menclose mfenced msub "
                  "msup msubsup munder mover munderover mmultiscripts mprescripts mtable mtr mtd maction").split())
INLINE = MATH | frozenset(("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark nobr q "
                           "rp rt ruby s samp small span strike strong sub sup time tt u var wbr").split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
          "option": ("option",)}  # an element that these open ones can't hold

_ATTRIBUTES = r"(?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*+"
# In turn: a comment, a drawing that ends at its "/>", a formula's source beside it, an element with all it holds, any other
# tag, and scraps. A name ends at white space, "/" or ">": after a hyphen goes on that of another element.
_MARKUP = re.compile(
    rf"<!--.*?(?:-->|\Z)|<svg(?=[\s/>])(?:{_ATTRIBUTES}(?<=/)>|(?!{_ATTRIBUTES}>)[^<>]*/>)|<annotation\s[^>]*>[^<]*</annotation\s*>"
    rf"|<({RAW})(?=[\s/>])[^>]*>.*?(?:</\1(?=[\s/>])[^>]*>|\Z)|<(/?)([a-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|</?[a-z][^>]*>|<[!?][^>]*(?:>|\Z)|</?[a-z][^>]*\Z", re.S | re.I)
_NAMES = re.compile(r"(?:\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))|(\bhidden\b|display\s*:\s*none)", re.I)
_PART = re.compile(r"[a-z]+")


class Block:
    __slots__ = ("path", "text", "linked")

    def __init__(self, path: tuple, text: str, linked: int):
        self.path, self.text, self.linked = path, text, linked


def _names(attributes: str) -> tuple[str, ...]:
    found = []
    for a, b, c, hidden in _NAMES.findall(attributes):
        found += ["hidden"] if hidden else _PART.findall((a or b or c).lower())
    return tuple(found)


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order, their text decoded and its white space made single."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked = links = at = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(tuple(e for e in stack if e[0] not in INLINE or e[1]), text, linked))
        parts.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        text = entities.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if links:
            linked += len(text)

    for m in _MARKUP.finditer(page):
        if m.start() > at:
            say(page[at:m.start()])
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if tag not in INLINE:
            flush()
        elif tag == "br" or tag in MATH:  # the parts of a formula are words
            parts.append(" ")
        if not m[2]:
            if tag not in INLINE:
                ends = CLOSES.get(tag, ())
                for depth in range(len(stack) - 1, -1, -1):
                    open_tag = stack[depth][0]
                    if open_tag == "p" or open_tag in ends:
                        links -= sum(e[0] == "a" for e in stack[depth:])
                        del stack[depth:]
                        break
                    if open_tag not in INLINE:
                        break
            if tag not in VOID and not m[4].endswith("/"):
                stack.append((tag, _names(m[4]) if m[4] else ()))
                links += tag == "a"
        else:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    links -= sum(e[0] == "a" for e in stack[depth:])
                    del stack[depth:]
                    break
                if tag in INLINE and stack[depth][0] not in INLINE:
                    break
    say(page[at:])
    flush()
    return out


def path_features(path: tuple) -> list[str]:
    found = {f"in:{tag}" for tag, _ in path} | {f"name:{n}" for _, names in path for n in names}
    inner = [tag for tag, _ in path if tag not in INLINE]
    return [*sorted(found), f"own:{inner[-1] if inner else ''}", f"under:{inner[-2] if len(inner) > 1 else ''}"]


def text_features(b: Block) -> list[str]:
    n = b.text.count(" ") + 1
    share = b.linked / len(b.text)
    found = ["words:" + ("1" if n < 2 else "few" if n < 5 else "some" if n < 12 else "many" if n < 40 else "lots"),
             "links:" + ("none" if share == 0 else "part" if share < 0.5 else "most")]
    if b.text[-1] in ".!?:;\"”":
        found.append("ends")
    if "©" in b.text or "opyright" in b.text:
        found.append("copyright")
    return found


class Field:
    """Weights by feature and label, and of label pairs; label 1 is content."""

    def __init__(self, weights: dict[str, tuple[float, float]], pairs: list[list[float]]):
        self.weights, self.pairs = weights, pairs
        self._paths: dict[tuple, tuple[float, float]] = {}

    def __getstate__(self):
        return self.weights, self.pairs

    def __setstate__(self, state):
        self.__init__(*state)

    def _sum(self, features: list[str]) -> tuple[float, float]:
        found = [self.weights[f] for f in features if f in self.weights]
        return sum(w[0] for w in found), sum(w[1] for w in found)

    def score(self, b: Block) -> tuple[float, float]:
        path = self._paths.get(b.path)
        if path is None:
            if len(self._paths) > 50_000:
                self._paths.clear()
            path = self._paths[b.path] = self._sum(path_features(b.path))
        text = self._sum(text_features(b))
        return path[0] + text[0], path[1] + text[1]

    def viterbi(self, page: list[Block]) -> list[int]:
        """The most probable labels; of equal ones the rest wins."""
        if not page:
            return []
        (p00, p01), (p10, p11) = self.pairs
        back = []
        a, b = self.score(page[0])
        for block in page[1:]:
            s0, s1 = self.score(block)
            from0, from1 = (a + p00, a + p01), (b + p10, b + p11)
            back.append((from1[0] > from0[0], from1[1] > from0[1]))
            a, b = max(from0[0], from1[0]) + s0, max(from0[1], from1[1]) + s1
        label = int(b > a)
        labels = [label]
        for step in reversed(back):
            label = int(step[label])
            labels.append(label)
        return labels[::-1]


def train(pages: list[tuple[list[Block], list[int]]], epochs: int = EPOCHS, rate: float = RATE, decay: float = DECAY) -> Field:
    """Maximum likelihood by adaptive gradient steps, page by page."""
    number: dict[str, int] = {}
    coded = []
    for page, labels in pages:
        if page:
            rows = [[number.setdefault(f, len(number)) for f in path_features(b.path) + text_features(b)] for b in page]
            coded.append((rows, np.array(labels)))
    w, pairs = np.zeros((len(number), 2)), np.zeros((2, 2))
    w2, pairs2 = np.full_like(w, 1e-6), np.full_like(pairs, 1e-6)
    for _ in range(epochs):
        for rows, labels in coded:
            n = len(rows)
            s = np.array([w[r].sum(axis=0) for r in rows])
            forward, backward = np.empty((n, 2)), np.zeros((n, 2))
            forward[0] = s[0]
            for i in range(1, n):
                forward[i] = np.logaddexp(forward[i - 1][0] + pairs[0], forward[i - 1][1] + pairs[1]) + s[i]
            for i in range(n - 2, -1, -1):
                step = pairs + s[i + 1] + backward[i + 1]
                backward[i] = np.logaddexp(step[:, 0], step[:, 1])
            total = np.logaddexp(*forward[-1])
            one = np.exp(forward + backward - total)
            miss = np.eye(2)[labels] - one
            two = np.exp(forward[:-1, :, None] + pairs + (s[1:] + backward[1:])[:, None, :] - total)
            grad = np.zeros((2, 2))
            np.add.at(grad, (labels[:-1], labels[1:]), 1)
            grad -= two.sum(axis=0)
            flat = np.concatenate(rows)
            g = np.zeros_like(w)
            np.add.at(g, flat, np.repeat(miss, [len(r) for r in rows], axis=0))
            used = np.unique(flat)
            g[used] -= decay * w[used]
            w2[used] += g[used] ** 2
            w[used] += rate * g[used] / np.sqrt(w2[used])
            pairs2 += grad ** 2
            pairs += rate * grad / np.sqrt(pairs2)
    return Field({f: (float(w[i, 0]), float(w[i, 1])) for f, i in number.items()}, pairs.tolist())


# --- labelled pages --------------------------------------------------------------------------------

def compose(n: int = PAGES, seed: int = SEED) -> list[tuple[list[Block], list[int]]]:
    """``n`` labelled pages of varied layouts."""
    rng = random.Random(seed)
    serial = [0]

    def words(low: int, high: int) -> str:
        serial[0] += 1
        text = " ".join("".join(rng.choice(("an", "re", "ti", "on", "sta", "le", "mi", "so", "ver", "da")) for _ in range(rng.randint(1, 4)))
                        for _ in range(rng.randint(low, high)))
        return f"{text.capitalize()} {serial[0]}"

    def link(text: str) -> str:
        return f'<a href="/{serial[0]}">{text}</a>'

    def links(k: int, close: bool = True) -> str:
        return "<ul>" + "".join(f"<li>{link(words(1, 2))}" + "</li>" * close for _ in range(k)) + "</ul>"

    def some(*choices: str) -> str:
        return rng.choice(choices)

    def sentences(k: int) -> str:
        return " ".join(words(2, 25) + some(".", ".", ".", "?", "!") for _ in range(k))

    def rest() -> list[str]:
        """Parts that stand before or after the article."""
        return [
            f"<nav{some('', ' class=menu', ' id=\"main-menu\"')}>{links(rng.randint(2, 8))}</nav>",
            f"<div class=\"{some('menu', 'navbar', 'nav-links', 'breadcrumb', 'breadcrumbs', 'navigation')}\">{links(rng.randint(2, 6))}</div>",
            f"<header{some('', ' class=site-header')}><p>{words(1, 6)}</p>{link(words(1, 2))}</header>",
            f"<div class=\"{some('header', 'site-header', 'masthead', 'banner', 'top-bar')}\">{words(1, 8)}</div>",
            f"<aside{some('', ' class=sidebar')}><h3>{words(1, 4)}</h3><p>{sentences(rng.randint(1, 3))}</p>{links(rng.randint(1, 4))}</aside>",
            f"<div class=\"{some('sidebar', 'side', 'widget', 'related', 'related-posts', 'recommended', 'share', 'social', 'promo')}\">"
            f"<h4>{words(1, 4)}</h4><p>{sentences(rng.randint(1, 3))}</p></div>",
            f"<div class=\"{some('ad', 'ads', 'advert', 'advertisement', 'sponsored', 'ad-banner', 'sponsor')}\">{sentences(rng.randint(1, 4))}</div>",
            f"<div {some('class', 'id')}=\"{some('cookie', 'cookie-notice', 'cookie-banner', 'consent', 'gdpr', 'notice', 'alert', 'popup', 'modal')}\">"
            f"<p>{sentences(rng.randint(1, 3))}</p><button>{words(1, 2)}</button></div>",
            f"<form action=\"/{serial[0]}\"><label>{words(1, 3)}</label><input name=q><p>{sentences(1)}</p><button>{words(1, 2)}</button></form>",
            f"<div class=\"{some('newsletter', 'subscribe', 'signup', 'login', 'search')}\"><p>{sentences(rng.randint(1, 2))}</p></div>",
        ]

    def after() -> list[str]:
        """Parts that stand only behind the article."""
        comment = "".join(f"<{some('div', 'li')} class=comment><p>{sentences(rng.randint(1, 4))}</p>" + "</div>" for _ in range(rng.randint(1, 4)))
        return [
            f"<footer{some('', ' class=site-footer')}>{some('&copy;', 'Copyright', '')} {words(1, 4)} &middot; {sentences(1)}</footer>",
            f"<div class=\"{some('footer', 'site-footer', 'copyright', 'legal', 'bottom')}\"><p>{some('&copy; ', '')}{sentences(rng.randint(1, 2))}</p></div>",
            f"<section {some('class', 'id')}=\"{some('comments', 'comment-list', 'responses', 'discussion', 'replies')}\"><h3>{words(1, 3)}</h3>{comment}</section>",
            f"<div {some('class', 'id')}=\"{some('comments', 'disqus', 'reader-comments', 'comment-section')}\">{comment}</div>",
        ]

    out = []
    for _ in range(n):
        content: set[str] = set()

        def keep(text: str) -> str:
            content.add(" ".join(text.split()))
            return text

        inner = f"<h1>{keep(words(1, 10) + some('', '.', '?'))}</h1>" if rng.random() < 0.9 else ""
        for _ in range(rng.randint(1, 12)):
            kind, k = rng.random(), rng.randint(1, 6)
            if kind < 0.6:
                inner += f"<p>{keep(sentences(k))}</p>"
            elif kind < 0.7:
                inner += f"<p>{keep(words(1, 1) + '.')}</p>"
            elif kind < 0.75:
                inner += f"<p><b>{keep(sentences(k))}<br>"  # left open, as careless pages do
            elif kind < 0.82:
                inner += f"<h2>{keep(words(1, 6))}</h2>"
            elif kind < 0.87:
                inner += "<ul>" + "".join(f"<li>{keep(words(2, 12))}</li>" for _ in range(rng.randint(1, 4))) + "</ul>"
            elif kind < 0.91:
                inner += f"<blockquote>{keep(sentences(k))}</blockquote>"
            elif kind < 0.94:
                inner += f"<pre>{keep(words(3, 12))}</pre>"
            elif kind < 0.97:
                inner += f"<div>{keep(sentences(k))}</div>"
            else:
                inner += "<table>" + "".join(f"<tr><td>{keep(words(1, 3))}</td><td>{keep(words(1, 3))}</td></tr>" for _ in range(2)) + "</table>"
            if rng.random() < 0.06:  # an advert or a box within the article
                inner += some(*rest()[4:8])
        name = some("content", "post", "entry", "post-content", "entry-content", "article-body", "story", "main", "text", "page-content")
        holder = some(f"<article>{inner}</article>", f"<article>{inner}</article>", f"<article class=\"{name}\">{inner}</article>",
                      f"<main>{inner}</main>", f"<main><article>{inner}</article></main>", f"<div {some('class', 'id')}=\"{name}\">{inner}</div>",
                      f"<section class=\"{name}\">{inner}</section>")
        before = [some(*rest()) for _ in range(rng.randint(0, 4))]
        behind = [some(*rest(), *after(), *after()) for _ in range(rng.randint(0, 4))]
        page = "<html><head><title>x</title></head><body>" + "".join(before) + holder + "".join(behind) + "</body></html>"
        if rng.random() < 0.3:
            page = page.replace("<body>", "<body><div class=\"wrapper\">")
        found = blocks(page)
        out.append((found, [int(b.text in content) for b in found]))
    return out


@lru_cache(maxsize=1)
def field() -> Field:
    return train(compose())


def main_text(page: str | None, model: Field) -> str:
    found = blocks(page or "")
    return "\n".join(b.text for b, label in zip(found, model.viterbi(found)) if label)


def extract(pages: DataFrame, model: Field | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    model = model or field()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # pages can be long
                part = batch.slice(at, 256)
                texts = [main_text(p.as_py(), model) for p in part.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html").mapInArrow(
        run, "page_id bigint, url string, text string, n_chars bigint")
