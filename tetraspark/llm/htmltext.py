"""Main text of web pages by a linear-chain conditional random field over leaf blocks (operator 7).

A page is cut into leaf blocks: runs of text between block-level tags. Each block has features of its
ancestors' tags and names and of its text. The field is trained on labelled pages, which page_maker() writes
in many layouts together with the truth, and decoded by Viterbi.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .memory import tidy

# Block-level elements, elements whose contents aren't text, those whose contents go on to the end of
# the page where no end tag follows, and elements without an end.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table "
    "tbody td textarea tfoot th thead title tr ul".split()
)
SKIPPED_TAGS = frozenset("script style noscript template iframe svg noembed noframes".split())
RAW_TAGS = frozenset("script style".split())
EMPTY_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Start tags that end an open element of their own kind.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
#: What follows a tag's name. Quotes count only after an equals sign, and those that don't close only for themselves.
_REST = re.compile(r"""(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+>""")
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_PARTS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")
_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in SKIPPED_TAGS}

# Tags and names that page authors commonly give to parts of a page.
ASIDE_TAGS = frozenset("nav header footer aside form menu dialog".split())
MAIN_TAGS = frozenset("article main".split())
ASIDE_NAMES = (
    "nav navbar navigation menu header masthead topbar banner footer bottom copyright sidebar side aside rail widget related recommended "
    "popular trending ad ads advert advertisement adslot sponsor sponsored promo promotion cookie cookies consent gdpr notice alert popup modal overlay "
    "comment comments reply replies respond disqus discussion form newsletter subscribe signup login search breadcrumb breadcrumbs share sharing social "
    "tags pagination pager toolbar skip hidden legal disclaimer"
).split()
MAIN_NAMES = "article content main post entry body story text page maincontent bodytext articlebody".split()
_ASIDE, _MAIN = frozenset(ASIDE_NAMES) | {"!hidden"}, frozenset(MAIN_NAMES)


def _part(tag: str, names: frozenset[str]) -> str:
    """The part of a page that an element says it is, or nothing."""
    aside, main = tag in ASIDE_TAGS or bool(names & _ASIDE), tag in MAIN_TAGS or bool(names & _MAIN)
    return "both" if aside and main else "aside" if aside else "main" if main else ""


def _markup(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest) of a page's pieces: kind is text, plain (not to be decoded), start or end. Takes time in proportion to the page."""
    at, size, last = 0, len(page), page.rfind(">")
    endless: set[str] = set()  # elements that no end tag follows any more
    quoted = True
    while at < size:
        sign = page.find("<", at)
        if sign < 0 or sign > last:  # no tag ends after this
            if (open_comment := page.find("<!--", at)) >= 0:
                yield "text", "", page[at:open_comment]
            else:
                yield "text", "", page[at:]
            return
        if sign > at:
            yield "text", "", page[at:sign]
        if page.startswith("<!--", sign):
            end = page.find("-->", sign + 4)
            at = size if end < 0 else end + 3
            continue
        if page.startswith("<![CDATA[", sign):
            end = page.find("]]>", sign)
            yield "plain", "", page[sign + 9 : size if end < 0 else end]
            at = size if end < 0 else end + 3
            continue
        if page[sign + 1 : sign + 2] in ("!", "?"):
            at = page.find(">", sign) + 1
            continue
        name = _NAME.match(page, sign + 1)
        if not name:
            yield "text", "", "<"
            at = sign + 1
            continue
        rest = _REST.match(page, name.end()) if quoted else None
        quoted = rest is not None  # from here on every > is within quotes: they count for nothing
        at = rest.end() if rest else page.find(">", name.end()) + 1
        tag = name[2].lower()
        inside = page[name.end() : at - 1]
        yield "end" if name[1] else "start", tag, inside
        if not name[1] and tag in SKIPPED_TAGS and not inside.rstrip().endswith("/"):
            end = None if tag in endless else _END[tag].search(page, at)
            if end:
                at = page.find(">", end.end()) + 1 or size
            elif tag in RAW_TAGS:
                at = size
            else:
                endless.add(tag)


@dataclass
class Block:
    text: str
    own: str
    tags: frozenset[str]
    names: frozenset[str]
    near: frozenset[str]
    part: str
    asides: int
    link_share: float


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order, character references decoded and white space made single."""
    out: list[Block] = []
    stack: list[tuple[str, frozenset[str], str]] = []
    held: list[str] = []
    linked = links = 0

    def close() -> None:
        nonlocal linked
        text = " ".join("".join(held).split())
        if text:
            names = frozenset().union(*[n for _, n, _ in stack])
            near = next((n for _, n, _ in reversed(stack) if n), frozenset())
            parts = [p for *_, p in stack if p]
            within = len(parts) - next((k for k, p in enumerate(reversed(parts)) if p == "main"), len(parts))
            out.append(Block(text, stack[-1][0] if stack else "", frozenset(t for t, *_ in stack), names, near, parts[-1] if parts else "", sum(p == "aside" for p in parts[within:]), min(1.0, linked / max(1, len(text)))))
        held.clear()
        linked = 0

    def pop_to(tags: set[str] | frozenset[str], stop: frozenset[str] = frozenset()) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in tags:
                del stack[i:]
                return
            if stack[i][0] in stop:
                return

    for kind, tag, rest in _markup(page):
        if kind in ("text", "plain"):
            held.append(entities.unescape(rest) if kind == "text" else rest)
            linked += len(rest) if links else 0
        elif kind == "end":
            if tag == "a":
                links = 0
            if tag in BLOCK_TAGS:
                close()
                pop_to({tag})
        elif tag in SKIPPED_TAGS or tag == "br":
            held.append(" ")
        elif tag == "a":
            links = 1
        elif tag in BLOCK_TAGS:
            close()
            pop_to({"p"}, frozenset({"td", "th", "li", "div", "section", "article", "blockquote"}))
            if tag in CLOSES:
                pop_to(CLOSES[tag], frozenset({"ul", "ol", "dl", "table"}))
            if tag not in EMPTY_TAGS:
                names = {p.lower() for m in _NAMES.finditer(rest) for p in _PARTS.findall(m[1] or m[2] or m[3] or "")}
                if _HIDDEN.search(rest):
                    names.add("!hidden")
                stack.append((tag, frozenset(names), _part(tag, frozenset(names))))
    close()
    return out


def _bin(value: float, edges: tuple[float, ...]) -> int:
    return sum(value >= e for e in edges)


def describe(found: list[Block]) -> list[list[str]]:
    """Feature names of each block."""
    marked = any(b.tags & {"article", "main"} for b in found)
    out = []
    for i, b in enumerate(found):
        words = b.text.count(" ") + 1
        inside = bool(b.tags & {"article", "main"})
        f = ["bias", f"own:{b.own}", f"len:{_bin(words, (4, 9, 21, 61))}", f"link:{_bin(b.link_share, (0.01, 0.4, 0.8))}"]
        # the nearest part of the page that says what it is, alone and with the text's form
        f += [f"part:{b.part}", f"part:{b.part}:{b.own}", f"part:{b.part}:{_bin(words, (4, 9, 21, 61))}", f"asides:{b.asides > 0}:{marked}", f"asides:{b.asides > 0}:{b.own}"]
        f += [f"in:{t}" for t in b.tags] + [f"name:{n}" for n in b.names] + [f"near:{n}" for n in b.near]
        f.append(f"{b.own}:{len(b.near) > 0}:{_bin(words, (5, 15))}")
        f.append("stop" if b.text[-1:] in ".!?:;…\"')”»" else "nostop")
        f.append("marked:" + ("inside" if inside else "outside") if marked else "unmarked")
        if "©" in b.text or "|" in b.text and words < 20:
            f.append("sign")
        if i == 0 or i == len(found) - 1:
            f.append("edge")
        out.append(f)
    return out


@dataclass
class Field:
    """Weights of a chain with two labels, 0 boilerplate and 1 main text."""

    index: dict[str, int]
    weights: np.ndarray
    steps: np.ndarray

    def scores(self, features: list[list[str]]) -> np.ndarray:
        return np.array([sum((self.weights[self.index[f]] for f in row if f in self.index), np.zeros(2)) for row in features]).reshape(-1, 2)

    def decode(self, features: list[list[str]]) -> list[int]:
        """Viterbi; of equal paths the one with boilerplate earlier."""
        if not features:
            return []
        (s00, s01), (s10, s11) = self.steps.tolist()
        rows = self.scores(features).tolist()
        a, b = rows[0]
        back = []
        for x, y in rows[1:]:
            fa, fb = (b + s10 > a + s00), (b + s11 > a + s01)
            back.append((fa, fb))
            a, b = (b + s10 if fa else a + s00) + x, (b + s11 if fb else a + s01) + y
        label = int(b > a)
        path = [label]
        for fa, fb in reversed(back):
            label = int(fb if label else fa)
            path.append(label)
        return path[::-1]


#: Pages that must have a feature for it to get a weight.
LEAST_PAGES = 3


def fit(pages: list[tuple[list[list[str]], list[int]]], rounds: int = 150, rate: float = 0.1, decay: float = 2e-4) -> Field:
    """Maximum likelihood by forward and backward sums over padded pages, with Adam."""
    seen_in = Counter(f for features, _ in pages for f in {f for row in features for f in row})
    names = sorted(f for f, n in seen_in.items() if n >= LEAST_PAGES)
    index = {n: i for i, n in enumerate(names)}
    longest = max(len(labels) for _, labels in pages)
    y, there = np.zeros((len(pages), longest), np.int64), np.zeros((len(pages), longest), bool)
    for p, (_, labels) in enumerate(pages):
        y[p, : len(labels)], there[p, : len(labels)] = labels, True
    rows = np.flatnonzero(there)
    flat = np.zeros((len(rows), len(names)), np.float32)
    for at, row in enumerate(row for features, _ in pages for row in features):
        flat[at, [index[f] for f in row if f in index]] = 1
    truth = np.eye(2)[y] * there[..., None]
    w = [np.zeros((len(names), 2)), np.zeros((2, 2))]
    m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
    total = there.sum()
    pair_there = there[:, 1:] & there[:, :-1]
    for step in range(1, rounds + 1):
        s = np.zeros((*there.shape, 2))
        s.reshape(-1, 2)[rows] = flat @ w[0].astype(np.float32)
        alpha, beta = np.zeros_like(s), np.zeros_like(s)
        alpha[:, 0] = s[:, 0]
        for t in range(1, longest):
            alpha[:, t] = s[:, t] + np.logaddexp(alpha[:, t - 1, 0, None] + w[1][0], alpha[:, t - 1, 1, None] + w[1][1])
        for t in range(longest - 2, -1, -1):
            after = s[:, t + 1] + beta[:, t + 1]
            beta[:, t] = np.where(there[:, t + 1, None], np.logaddexp(w[1][:, 0] + after[:, 0, None], w[1][:, 1] + after[:, 1, None]), 0)
        last = there.sum(1) - 1
        z = np.logaddexp.reduce(alpha[np.arange(len(pages)), last], axis=1)
        node = np.exp(alpha + beta - z[:, None, None]) * there[..., None]
        pair = np.exp(alpha[:, :-1, :, None] + w[1] + (s + beta)[:, 1:, None, :] - z[:, None, None, None]) * pair_there[..., None, None]
        seen = np.einsum("pta,ptb->ab", truth[:, :-1], truth[:, 1:])
        grads = [flat.T @ (node - truth).reshape(-1, 2)[rows].astype(np.float32) / total + decay * w[0], (pair.sum((0, 1)) - seen) / total + decay * w[1]]
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            w[i] -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return Field(index, w[0], w[1])


def page_maker(seed: int) -> list[tuple[str, int]]:
    """A labelled page: (markup piece, label) where a label other than -1 marks the leaf block that the piece holds."""
    rng = np.random.Generator(np.random.PCG64(seed))
    pick = lambda options: options[int(rng.integers(len(options)))]
    word = lambda: "".join(pick("bcdfghklmnprstvw") + pick("aeiouéä") for _ in range(int(rng.integers(1, 4))))

    def phrase(low: int, high: int, stop: str = "") -> str:
        style = rng.random()
        words = [word() for _ in range(int(rng.integers(low, high)))]
        if style < 0.08:
            words = [w.upper() + "!!" for w in words]
        elif style < 0.16:
            words = [w + pick(["***", "###", " |", "&amp;&amp;", "%%"]) for w in words]
        return " ".join(words) + stop

    def named(tag: str, names: list[str], plain: float) -> str:
        if rng.random() < plain:
            return f"<{tag}>"
        return f'<{tag} {pick(["class", "id"])}="{pick([pick(names), pick(names) + "-" + word(), word() + " " + pick(names), "the" + pick(names).title()])}">'

    out: list[tuple[str, int]] = []
    add = lambda piece, label=-1: out.append((piece, label))

    def aside(tag: str, names: list[str], plain: float) -> None:
        add(named(tag, names, plain))
        kind = rng.random()
        if kind < 0.25:  # prose as in an article
            if rng.random() < 0.4:
                add(f"<{(h := pick(['h2', 'h3']))}>{phrase(2, 10)}</{h}>", 0)
            for _ in range(int(rng.integers(1, 5))):
                add(f"<p>{phrase(5, 80, pick(['.', '.', '']))}</p>", 0)
        elif kind < 0.35:
            add("<div>")
            add(phrase(8, 60, "."), 0)
            add("</div>")
        elif kind < 0.5:
            add("<ul>")
            for _ in range(int(rng.integers(2, 7))):
                add(f'<li><a href="/{word()}">{phrase(1, 4)}</a></li>', 0)
            add("</ul>")
        elif kind < 0.65:
            add(f"<h3>{phrase(1, 5)}</h3>", 0)
            for _ in range(int(rng.integers(1, 4))):
                add(f"<p>{phrase(4, 40, '.')}</p>", 0)
        elif kind < 0.75:
            add(f"<label>{phrase(1, 4)}</label><input type=text><button>", 0)
            add(f"{phrase(1, 3)}</button>", 0)
        else:
            add(pick(["&copy; 2021 ", "", "", ""]) + phrase(2, 30, pick([".", ""])), 0)
        add(f"</{tag}>")

    add("<html><head><title>" + phrase(3, 9) + "</title><script>var a = '<p>';</script></head>" + pick(["<body>", "<body>", named("body", [*MAIN_NAMES, *ASIDE_NAMES], 0.0)]), 0)
    wrapped = rng.random() < 0.1  # some servers put the whole page into a form
    if wrapped:
        add(named("form", ["form", "aspnet"], 0.3))
    for _ in range(int(rng.integers(0, 4))):
        tag = pick(["nav", "header", "div", "div", "section", "form"])
        aside(tag, ASIDE_NAMES, 0.0 if tag in ("div", "section") else 0.5)
    layout = rng.random()
    tag = "article" if layout < 0.45 else "main" if layout < 0.6 else pick(["div", "section"])
    add(named(tag, MAIN_NAMES, 0.5 if tag in ("article", "main") else 0.15))
    if rng.random() < 0.8:
        add(f"<{(h := pick(['h1', 'h2']))}>{phrase(2, 10)}</{h}>", 1)
    for _ in range(int(rng.integers(1, 14))):
        kind = rng.random()
        if kind < 0.52:
            add("<p>" + pick(["", "<b>", "<em>"]) + phrase(1 if rng.random() < 0.2 else 5, 80, pick([".", ".", ".", ""])) + pick(["</p>", "</p>", "<br>", ""]), 1)
        elif kind < 0.61:
            add(f"<h2>{phrase(1, 7)}</h2>", 1)
        elif kind < 0.67:
            add("<ul>")
            for _ in range(int(rng.integers(1, 5))):
                add(f"<li>{phrase(1, 14, pick(['.', '']))}</li>", 1)
            add("</ul>")
        elif kind < 0.71:
            add(f"<blockquote>{phrase(4, 30, '.')}</blockquote>", 1)
        elif kind < 0.74:
            add(f"<pre>{phrase(4, 20)}</pre>", 1)
        elif kind < 0.77:
            add(f"<table><tr><td>{phrase(1, 5)}</td>", 1)
            add(f"<td>{phrase(1, 5)}</td></tr></table>", 1)
        else:
            tag_in = pick(["div", "div", "aside", "section", "form", "header", "footer", "nav"])
            aside(tag_in, ASIDE_NAMES, 0.0 if tag_in in ("div", "section") else 0.6)
    if rng.random() < 0.35:
        aside(pick(["section", "div"]), ["comments", "comment", "replies", "discussion"], 0.0)
    add(f"</{tag}>")
    for _ in range(int(rng.integers(0, 4))):
        tag = pick(["footer", "aside", "div", "section", "form"])
        aside(tag, ASIDE_NAMES, 0.0 if tag in ("div", "section") else 0.5)
    add(("</form>" if wrapped else "") + "</body></html>")
    return out


def labelled_pages(first: int, n: int) -> Iterator[tuple[str, list[Block], list[int]]]:
    """n made pages as (html, blocks, labels); those whose blocks don't fall as made are left out."""
    for seed in range(first, first + n):
        pieces = page_maker(seed)
        page = "".join(p for p, _ in pieces)
        found, labels = blocks(page), [label for _, label in pieces if label >= 0]
        if len(found) == len(labels):
            yield page, found, labels


#: Pages that the field is trained on.
TRAINING_PAGES = 1000


@cache
def trained() -> Field:
    return fit([(describe(found), labels) for _, found, labels in labelled_pages(1, TRAINING_PAGES)])


def main_text(field: Field, page: str) -> str:
    found = blocks(page)
    return "\n\n".join(b.text for b, label in zip(found, field.decode(describe(found)), strict=True) if label)


def extract(pages: DataFrame, field: Field | None = None, keep: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """`keep` columns with text and n_chars: one row for each row of pages.

    A null or empty page, and one without main text, has an empty text. Rows are read one by one, so repeated
    rows and equal ids have a row each. Other columns are left out; no rows give none.
    """
    model = pages.sparkSession.sparkContext.broadcast(field or trained())  # a few hundred features
    rows = pages.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(html_col).alias("html"))
    schema = T.StructType([T.StructField(f"k{i}", pages.schema[c].dataType) for i, c in enumerate(keep)] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [main_text(model.value, page or "") for page in pdf["html"]]
            yield pdf.drop(columns="html").assign(text=texts, n_chars=[len(t) for t in texts])

    return rows.mapInPandas(run, schema).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "text", "n_chars")
