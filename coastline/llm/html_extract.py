"""Main text of HTML pages: a conditional random field over the page's leaf blocks.

A page is cut into leaf blocks, each with the chain of elements it stands in.
Features are those elements' tags and the words of their class, id and role
names; the block's length, end, share of linked text and words that boilerplate
uses; its place in the page; and the kinds of its neighbours. A linear-chain
field, trained on labelled pages, says by Viterbi decoding which blocks are the
article; their texts are joined.

The labelled pages are ``TRAINING_PAGES`` pages made from layouts: with telling
tags, names or roles, with other names around them, in tables, and, in a third of
them, with none, where only menus and footers stand beside the article. They are
fitted on the driver in some seconds. Pages are handled one by one where they lie;
there is no shuffle.

Rows: a null or empty page has an empty text; broken markup, unclosed elements of
any depth and cut-off pages are read as far as they go, in time linear in their
length; repeated rows get the same answer; labels that are equally probable go to
boilerplate; an empty table gives an empty result; further columns pass through,
but for the page and one named main_text, which is replaced.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from coastline.llm.crf import ChainCRF
from coastline.llm.html_blocks import Block, Node, blocks

TRAINING_PAGES = 800


#: Words that boilerplate uses.
SAYS = {
    "legal": "© (c) copyright reserved privacy terms imprint impressum disclaimer",
    "cookie": "cookie cookies consent gdpr tracking",
    "ask": "subscribe newsletter signup login register password search sign log",
    "social": "share tweet follow facebook twitter instagram whatsapp",
    "reply": "reply replies comment comments",
    "ad": "advert advertisement sponsored sponsor promoted promotion buy shop offer trial",
    "more": "related trending popular recommended tags categories recent also",
    "menu": "home about contact menu news archive sitemap skip next previous",
}
_CUE = {w: k for k, words in SAYS.items() for w in words.split()}
#: Blocks of as many characters or more are prose, whatever words they use.
PROSE = 400
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


def _size(n: int) -> int:
    return 0 if n < 12 else 1 if n < 40 else 2 if n < 120 else 3 if n < 400 else 4


def path_features(node: Node | None) -> set[str]:
    return (node.features() if node else set()) | {"bias", f"last:{node.tag if node else ''}"}


def text_codes(found: list[Block]) -> list[tuple]:
    """For each block of a page what its text, its place and its neighbours say, as one key of few values."""
    n = len(found)
    kinds, stops, says = [], [], []
    most = 0
    for b in found:
        text = b.text
        size = len(text)
        most = max(most, size)
        kinds.append((_size(size), 0 if not b.linked else 1 if 2 * b.linked < size else 2, b.node is not None and b.node.tag in HEADINGS))
        stops.append(text[-1] in ".!?…\"”»)")
        met = _CUE.keys() & {w.strip(".,:;!?") for w in text.lower().split()} if size < PROSE else ()
        says.append(tuple(sorted({_CUE[w] for w in met})) if met else ())
    out, last = [], None
    for i, b in enumerate(found):
        node, before = b.node, found[i - 1].node if i else None
        beside = before is not None and node is not None and node.parent is before.parent
        out.append((kinds[i], stops[i], 8 * i // n, min(i, 2), min(n - 1 - i, 2), last, kinds[i + 1] if i + 1 < n else None, 4 * len(b.text) >= most, bool(i) and node is before, beside, says[i]))
        last = kinds[i]
    return out


@cache
def spelled(code: tuple) -> tuple[str, ...]:
    """The features of a key by name."""
    kind, stop, place, first, last, before, after, long, same, beside, says = code
    return (
        f"size:{kind[0]}", f"links:{kind[1]}", f"stop:{stop}", f"kind:{kind}:{stop}", f"place:{place}", f"edge:{first}:{last}", f"before:{before}", f"after:{after}", f"most:{long}", f"same:{same}", f"beside:{beside}",
        *(f"says:{k}" for k in says),
    )


def labelled_pages(n: int = TRAINING_PAGES, seed: int = 5) -> list[tuple[str, list[int]]]:
    """(page, label of each of its blocks): pages made from layouts."""
    rng = random.Random(seed)
    pick = rng.choice
    unnamed = False
    plain_letters = str.maketrans("äéñ", "aen")

    def words(a: int, b: int) -> str:
        return " ".join("".join(pick("bcdfghklmnprstvwz") + pick("aeiouäéñ") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(a, b)))

    def sentences(a: int, b: int) -> str:
        return " ".join(f"{words(4, 14).capitalize()}{pick('...!?')}" for _ in range(rng.randint(a, b)))

    odd = lambda: pick([words(1, 1).lower().translate(plain_letters) + pick(["", "-x", "2", "_box"]), "row", "col-md-8", "inner", "wrap", "clearfix", "css-1x9", "block"])

    def wrapped(tags: list[str], names: list[str], inner: str, semantic: float = 0.5, role: str = "") -> str:
        """The inner part in an element with a telling tag, name or role, with telling and other names, or with none of them."""
        if unnamed and rng.random() < 0.8:
            return pick(["<div>{}</div>", "<section>{}</section>", "<td>{}</td>", '<div class="{}">{{}}</div>'.format(odd()), '<div id="{}">{{}}</div>'.format(odd())]).format(inner)
        tag = pick(tags) if tags and rng.random() < semantic else pick(["div", "section", "div", "td"])
        if tag in tags and rng.random() < 0.6:
            return f"<{tag}>{inner}</{tag}>"
        if role and rng.random() < 0.25:
            return f'<{tag} role="{role}">{inner}</{tag}>'
        around = [odd() for _ in range(rng.choice([0, 0, 1, 4]))]
        return f'<{tag} {pick(["class", "class", "id"])}="{" ".join([*around, pick(names)])}">{inner}</{tag}>'

    def links(a: int, b: int) -> tuple[str, int]:
        k = rng.randint(a, b)
        return "<ul>" + "".join(f'<li><a href="/{i}">{words(1, 3)}</a></li>' for i in range(k)) + "</ul>", k

    def notes(a: int, b: int) -> tuple[str, int]:
        k = rng.randint(a, b)
        return "".join(f"<p>{sentences(1, 3)}</p>" for _ in range(k)), k

    def boiler(kind: str) -> tuple[str, list[int]]:
        if kind == "nav":
            inner, k = links(3, 8)
            return wrapped(["nav"], ["nav", "menu", "navbar", "topnav", "breadcrumb", "navigation", "toc"], inner, role="navigation"), [0] * k
        if kind == "header":
            return wrapped(["header"], ["header", "site-header", "masthead", "banner"], f"<h1>{words(1, 3)}</h1><p>{words(2, 8)}</p>", role="banner"), [0, 0]
        if kind == "footer":
            mark = pick(["&copy; {}", "&copy; {} All rights reserved.", "Copyright {}", "{} Privacy policy.", "{}"]) if not unnamed else pick(["&copy; {}", "Copyright {}", "&copy; 20{} Terms of use"])
            inner, k = (f"<p>{mark.format(words(1, 3))} {sentences(1, 3) if rng.random() < 0.6 else ''}</p>", 1)
            if rng.random() < 0.3:
                more, n_more = links(2, 5)
                inner, k = inner + more, k + n_more
            return wrapped(["footer"], ["footer", "site-footer", "copyright", "colophon"], inner, role="contentinfo"), [0] * k
        if kind == "ad":
            if rng.random() < 0.5:
                return wrapped([], ["ad", "ads", "advert", "sponsored", "promo", "advertisement", "ad-box", "banner-ad"], pick(["", "", "Sponsored. ", "Special offer: "]) + sentences(1, 3), 0), [0]
            inner, k = notes(1, 2)
            return wrapped([], ["ad", "ads", "advert", "sponsored", "promo"], inner, 0), [0] * k
        if kind == "notice":
            said = pick(["We use cookies. ", "This site uses cookies. ", "Please accept. ", ""]) + sentences(1, 2)
            return wrapped([], ["cookie", "cookies", "notice", "alert", "consent", "gdpr", "popup", "modal", "cookie-banner"], f"<p>{said}</p><button>{words(1, 2)}</button>", 0), [0, 0]
        if kind == "aside":
            if rng.random() < 0.5:
                inner, k = links(2, 6)
                return wrapped(["aside"], ["sidebar", "related", "widget", "recommended", "trending"], f"<h3>{words(1, 3)}</h3>{inner}"), [0] * (k + 1)
            inner, k = notes(1, 3)
            return wrapped(["aside"], ["sidebar", "related", "widget", "share", "social"], inner), [0] * k
        if kind == "form":
            return wrapped(["form"], ["form", "search", "newsletter", "subscribe", "login", "signup"], f"<p>{pick(['Subscribe to our newsletter. ', 'Sign up. ', 'Search ', ''])}{sentences(1, 2)}</p><label>{words(1, 3)}</label><input><button>{words(1, 2)}</button>", 0.7, role="search"), [0, 0, 0]
        inner, k = "", rng.randint(1, 5)
        for _ in range(k):
            said = pick([sentences(1, 5), words(1, 4) + ".", sentences(1, 2) + " Reply"])
            inner += pick([f"<p>{said}</p>", f'<div class="{pick(["comment", "comment-body", "reply"])}"><p>{said}</p></div>'])
        return wrapped([], ["comments", "comment-list", "discussion", "responses", "disqus"], inner, 0), [0] * k

    def article() -> tuple[str, list[int]]:
        inner, labels = "", []
        if rng.random() < 0.8:
            inner, labels = f"<h1>{words(2, 9)}{pick(['', '', '.'])}</h1>", [1]
            if rng.random() < 0.15:  # a headline has its own header
                more = pick(["", f"<p>{words(3, 9)}</p>"])
                inner, labels = f"<header>{inner}{more}</header>", [1, 1] if more else [1]
                if rng.random() < 0.5:
                    return f"<{(outer := pick(['article', 'main', 'article']))}>{inner}<p>{sentences(1, 8)}</p><p>{sentences(1, 8)}</p></{outer}>", [*labels, 1, 1]
        for _ in range(rng.randint(1, 9)):
            r = rng.random()
            if r < 0.62:
                text = pick([sentences(1, 8), words(1, 3) + ".", sentences(1, 2), words(1, 12)])
                if not unnamed and rng.random() < 0.15:  # an article may say what boilerplate says
                    said = pick(["All rights reserved.", "Share this", "Read more", "We use cookies.", "Subscribe to our newsletter.", "Copyright", "Terms of use", "Home", "Sign up", "Comments", "Buy now"])
                    text = pick([said, said, f"{text} {said}", f"{said} {text}"])
                if rng.random() < 0.2:
                    text = f"<b>{text}</b>"
                if rng.random() < 0.15:
                    text += f' <a href="/x">{words(1, 3)}</a>'
                inner, labels = inner + f"<p>{text}</p>", [*labels, 1]
            elif r < 0.7:
                inner, labels = inner + f"<h2>{words(1, 5)}</h2>", [*labels, 1]
            elif r < 0.77:
                inner, labels = inner + f"<ul><li>{sentences(1, 1)}</li><li>{words(1, 6)}</li></ul>", [*labels, 1, 1]
            elif r < 0.8:
                inner, labels = inner + f"<blockquote>{sentences(1, 3)}</blockquote>", [*labels, 1]
            elif r < 0.82:
                inner, labels = inner + f"<pre>{words(2, 8)}</pre>", [*labels, 1]
            else:
                if unnamed:
                    continue
                more, own = boiler(pick(["ad", "aside", "form", "comments", "notice"]))
                inner, labels = inner + more, labels + own
        return wrapped(["article", "main", "article"], ["content", "post", "entry", "article", "story", "main-content", "post-body", "bodyContent", "page-content", "text", "body-text"], inner, 0.6, role="main"), labels

    out = []
    for _ in range(n):
        page, labels = "", []
        if rng.random() < 0.04:  # nothing but text and line breaks
            unnamed = True
            broken = pick(["<br>", "<br><br>"]).join(sentences(1, 6) for _ in range(rng.randint(1, 4)))
            out.append((f"<html><body>{wrapped([], ['content', 'text', 'entry'], broken, 0)}</body></html>", [1]))
            continue
        unnamed = rng.random() < 0.35  # then only what can be told without names
        before = [k for k in ("notice", "header", "nav", "ad", "aside") if rng.random() < 0.55 and (not unnamed or k == "nav")]
        after = [k for k in ("aside", "comments", "form", "ad", "footer", "notice") if rng.random() < 0.5 and (not unnamed or k == "footer")]
        rng.shuffle(before)
        for make in [*before, None, *after]:
            html, own = article() if make is None else boiler(make)
            page, labels = page + pick(["", "\n", " "]) + html, labels + own
        if rng.random() < 0.3:
            page = f'<div class="{pick(["wrapper", "container", "page", "row"])}">{page}</div>'
        elif rng.random() < 0.2 or "<td" in page:
            page = f"<table><tr>{page}</tr></table>"
        out.append((f"<html><head><title>{words(1, 4)}</title></head><body>{page}</body></html>", labels))
    return out


def page_features(found: list[Block]) -> list[list[str]]:
    return [[*sorted(path_features(b.node)), *spelled(code)] for b, code in zip(found, text_codes(found), strict=True)]


@cache
def trained(n: int = TRAINING_PAGES) -> ChainCRF:
    return ChainCRF().fit([(page_features(blocks(html)), labels) for html, labels in labelled_pages(n)])


class Extractor:
    def __init__(self, model: ChainCRF):
        self.model = model
        self.known: dict[tuple, float] = {}  # keys have few values, so there are not many

    def _code(self, code: tuple) -> float:
        score = self.known.get(code)
        if score is None:
            score = self.known[code] = self.model.score(spelled(code))
        return score

    def _path(self, node: Node | None) -> float:
        """The score of an element: that of its parent and of what it adds."""
        todo = []
        while node is not None and node.score is None:
            todo.append(node)
            node = node.parent
        score = node.score if node is not None else self.model.score(("bias",))
        for n in reversed(todo):
            score = n.score = score + self.model.score(n.fresh)
        return score

    def labels(self, found: list[Block]) -> list[int]:
        last = {t: self.model.score((f"last:{t}",)) for t in {b.node.tag if b.node else "" for b in found}}
        scores = [self._path(b.node) + last[b.node.tag if b.node else ""] + self._code(code) for b, code in zip(found, text_codes(found), strict=True)]
        return self.model.decode(scores)

    def text(self, html: str | None) -> str:
        found = blocks(html)
        return " ".join(b.text for b, y in zip(found, self.labels(found), strict=True) if y)


def extract(pages: DataFrame, html_col: str = "html", training_pages: int = TRAINING_PAGES) -> DataFrame:
    """``pages`` with main_text instead of the page."""
    shared = pages.sparkSession.sparkContext.broadcast(trained(training_pages))
    kept = [f for f in pages.schema.fields if f.name not in (html_col, "main_text")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extractor = Extractor(shared.value)
        for batch in batches:
            texts = [extractor.text(h.as_py()) for h in batch.column(batch.schema.get_field_index(html_col))]
            old = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            yield pa.RecordBatch.from_arrays([*old, pa.array(texts, pa.string())], names=[*(f.name for f in kept), "main_text"])

    return pages.mapInArrow(each, "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept) + "main_text string")
