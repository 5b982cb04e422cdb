"""Main text of web pages: a conditional random field over DOM leaf blocks.

A page becomes a list of blocks, the text between two block-level tags, each with its
ancestors.  Features are the ancestors' tags, word groups of their classes and ids, and
the text's length, share of link text, marks and place; a linear chain labels every
block ``main`` or ``other``.  It is trained on labelled pages (``training_pages``: made
here from a seed over many layouts; at most ``MAX_LABELLED`` pages, a documented bound)
and decoded by Viterbi for many pages at once.

Scripts, styles, templates, the head, form controls and comments of the markup are no
text; the head ends with its tag or before the first tag or text that cannot be in it.
Character references are decoded; white space inside a block, ``<br>``
included, is one space; blocks are joined by a line feed; nothing else is dropped.

Defined cases: a null or empty html has an empty text; broken markup is read as far as
it goes (unclosed tags end with their parents, a cut-off tag at the end is dropped, a
quote counts only right after ``=``, and none does any more once one never ends);
repeated rows are read each on its own; an empty table gives an empty result.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import cache
from html import unescape

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import map_rows, table
from tidewatch.llm.crf import LinearChain, train

LABELS = ["other", "main"]
MAX_LABELLED = 1_000

# Possessive throughout: a token is read once, forward.  Quotes count right after "=" only.
_NAME = r"<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)"
_QUOTED = re.compile(_NAME + r"""(?P<attr>(?:=\s*+"[^"]*+"|=\s*+'[^']*+'|[^>])*+)>""")
_PLAIN = re.compile(_NAME + r"(?P<attr>[^>]*+)>")
_OTHER = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(?=/?[a-zA-Z!?])[^<]*+\Z|[^<]++|<", re.S)
_OPENS = re.compile("</?[a-zA-Z]")
_REST = re.compile(r"<[^<]*+\Z|<")
_ATTR = re.compile(r"""(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_SILENT = frozenset("script style template noscript head title svg math iframe object select option button textarea datalist".split())
_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
_FOREIGN = frozenset(["svg", "math"])
_RAW = frozenset("script style textarea title iframe noscript".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split()
)
_CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
)
# Groups of words in classes, ids and roles.
GROUPS = {
    "advert": "ad ads adv advert advertisement adverts sponsor sponsored promo promotion banner",
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc tabs skip",
    "header": "header masthead topbar logo",
    "footer": "footer foot copyright legal colophon contentinfo",
    "side": "sidebar side aside widget related recommended recommendations popular trending more complementary",
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription signup warning message",
    "comment": "comment comments disqus reply replies discussion responses thread feedback review reviews",
    "share": "share social sharing follow tags meta byline author",
    "form": "form search login contact",
    "body": "content article post entry story text body main",
}
_GROUP = {word: group for group, words in GROUPS.items() for word in words.split()}


class Block:
    __slots__ = ("parts", "links", "tags", "groups")

    def __init__(self, tags: tuple, groups: tuple):
        self.parts: list[str] = []
        self.links, self.tags, self.groups = 0, tags, groups

    def text(self) -> str:
        return " ".join("".join(self.parts).split())


def blocks(html: str | None) -> list[tuple[str, Block]]:
    """(text, block) of every leaf block with text, in page order."""
    out: list[tuple[str, Block]] = []
    stack: list[tuple[str, tuple]] = []
    current: Block | None = None
    silent = links = 0
    at, html = 0, html or ""
    last, quotes = html.rfind(">"), True

    def flush() -> None:
        nonlocal current
        if current is not None:
            text = current.text()
            if text:
                out.append((text, current))
        current = None

    while at < len(html):
        m = None
        if at < last and _OPENS.match(html, at):
            m = _QUOTED.match(html, at) if quotes else None
            if m is None:
                # A quote here never ends before the text does: quotes count no more.
                quotes, m = False, _PLAIN.match(html, at)
        elif at > last and html.startswith(("<!", "<?"), at) and not html.startswith("<!--", at):
            m = _REST.match(html, at)
        tag = m.group("tag") if m and m.re is not _REST else None
        m = m or _OTHER.match(html, at)
        at = m.end()
        if tag is None:
            piece = m.group()
            if stack and stack[-1][0] == "head" and not piece.isspace() and (piece[0] != "<" or len(piece) == 1):
                stack.pop()
                silent -= 1
            if silent or (piece[0] == "<" and len(piece) > 1):
                continue
            if current is None:
                if piece.isspace():
                    continue
                current = Block(tuple(t for t, _ in stack), tuple(g for _, gs in stack for g in gs))
            piece = unescape(piece)
            current.parts.append(piece)
            if links:
                current.links += len(piece)
            continue
        tag = tag.lower()
        if stack and stack[-1][0] == "head" and not m.group("end") and tag not in _HEAD:
            stack.pop()
            silent -= 1
        if tag == "br":
            if current is not None:
                current.parts.append(" ")
            continue
        if tag not in _INLINE:
            flush()
        if m.group("end"):
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    for name, _ in stack[depth:]:
                        silent -= name in _SILENT
                        links -= name == "a"
                    del stack[depth:]
                    break
            continue
        if tag in _VOID or m.group("attr").endswith("/") and (
            tag not in _SILENT or tag in _FOREIGN or any(name in _FOREIGN for name, _ in stack)
        ):
            continue
        if tag in _CLOSES_P or tag in ("li", "dt", "dd", "tr", "td", "th"):
            _close_implied(stack, tag)
            links = sum(name == "a" for name, _ in stack)
            silent = sum(name in _SILENT for name, _ in stack)
        if tag in _RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        groups = ()
        if m.group("attr"):
            names = " ".join(v.strip("\"'") for _, v in _ATTR.findall(m.group("attr")))
            if names:
                groups = tuple({_GROUP[w] for w in re.split(r"[^a-z]+", names.lower()) if w in _GROUP})
        stack.append((tag, groups))
        silent += tag in _SILENT
        links += tag == "a"
    flush()
    return out


def _close_implied(stack: list, tag: str) -> None:
    """An open paragraph ends at a block; a list item or cell at the next one."""
    ends = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th")}.get(tag, ("p",))
    stops = ("ul", "ol", "dl", "table", "div", "article", "section", "aside", "main", "body", "nav", "form", "header", "footer")
    stops += ("template", "object", "select", "button", "foreignobject")
    for depth in range(len(stack) - 1, -1, -1):
        name = stack[depth][0]
        if name in ends:
            del stack[depth:]
            return
        if name in stops:
            return


def features(found: list[tuple[str, Block]]) -> list[tuple[str, ...]]:
    """Feature names of every block of a page."""
    tags_in = {t for _, b in found for t in b.tags}
    whole = "article" if "article" in tags_in else "main" if "main" in tags_in else "none"
    rows = []
    for i, (text, block) in enumerate(found):
        words = text.count(" ") + 1
        stops = sum(text.count(c) for c in ".,;!?")
        structure = [t for t in block.tags if t not in _INLINE]
        own = structure[-1] if structure else ""
        rows.append(
            (
                "one",
                f"own={own}",
                *sorted({f"in={t}" for t in block.tags if t in _TELLING}),
                *sorted({f"group={g}" for g in block.groups}),
                f"frame={whole}:{'in' if whole in block.tags else 'out'}",
                f"words={min(words.bit_length(), 7)}",
                f"links={min(4 * block.links // max(len(text), 1), 4)}",
                f"marks={min(8 * stops // words, 4)}",
                f"place={'first' if i == 0 else 'last' if i == len(found) - 1 else 'inside'}",
            )
        )
    return rows


_TELLING = frozenset("nav header footer aside form article main section ul ol table figure blockquote figcaption h1 h2 h3 p dialog menu address".split())


def training_pages(seed: int = 11, count: int = 400) -> list[list[tuple[str, Block, str]]]:
    """Labelled pages: blocks of generated layouts with their labels.

    Every generated text carries its label as its first word, which is cut off before
    features are taken.
    """
    rng = random.Random(seed)
    syllables = ["an", "er", "on", "the", "in", "re", "und", "que", "os", "la", "mi", "to", "é", "ver", "ch"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))

    def text(label: str, low: int, high: int) -> str:
        words = [word() + rng.choice(["", "", "", "", ",", "."]) for _ in range(rng.randint(low, high))]
        return f"{label} {' '.join(words)}."

    def item(label: str, inner: str) -> str:
        return rng.choice([f"<p>{inner}</p>", f"<div>{inner}</div>", f"<ul><li>{inner}</li></ul>", inner])

    def links(label: str) -> str:
        return "<ul>" + "".join(f'<li><a href="/x">{text(label, 1, 2)}</a></li>' for _ in range(rng.randint(2, 7))) + "</ul>"

    def junk() -> str:
        kind = rng.choice(list(GROUPS)[:9])
        name = rng.choice(GROUPS[kind].split())
        name = rng.choice([name, f"{name}-box", f"site-{name}", f"{name} wide"])
        mark = rng.choice([f'class="{name}"', f'id="{name}"', f'class="x" id="{name}"'])
        tag = rng.choice(["div", "section", "div", "aside", "ul" if kind == "comment" else "div"])
        body = rng.choice([text("other", 1, 40), links("other"), "".join(item("other", text("other", 3, 60)) for _ in range(rng.randint(1, 4)))])
        return f"<{tag} {mark}>{body}</{tag}>" if tag != "ul" else f"<ul {mark}>" + "".join(f"<li>{text('other', 2, 50)}</li>" for _ in range(3)) + "</ul>"

    def plain_junk() -> str:
        tag = rng.choice(["nav", "footer", "aside", "header", "form"])
        return f"<{tag}>{rng.choice([text('other', 2, 30), links('other'), item('other', text('other', 1, 30))])}</{tag}>"

    def body() -> str:
        parts = [f"<h1>{text('main', 1, 12)}</h1>"] if rng.random() < 0.8 else []
        for _ in range(rng.randint(0, 8)):
            low, high = rng.choice([(1, 3), (5, 60), (30, 120)])
            inner = text("main", low, high)
            tag = rng.choice(["p", "p", "p", "p", "h2", "blockquote", "pre", "li", "div"])
            parts.append(rng.choice([f"<ul><li>{inner}</li></ul>" if tag == "li" else f"<{tag}>{inner}</{tag}>", f"<p><b>{inner}<br>" if tag == "p" else f"<{tag}>{inner}</{tag}>"]))
            if rng.random() < 0.2:
                parts.append(rng.choice([junk, plain_junk])())
        return "".join(parts) or f"<p>{text('main', 1, 40)}</p>"

    pages = []
    for _ in range(min(count, MAX_LABELLED)):
        frame = rng.choice(["article", "article", "article", "main", "main", "content", "article in main", "none"])
        inner = body()
        if frame == "content":
            inner = f'<div class="{rng.choice(["content", "post-body", "entry", "story"])}">{inner}</div>'
        elif frame == "article in main":
            inner = f"<main>{junk() if rng.random() < 0.4 else ''}<article>{inner}</article></main>"
        elif frame != "none":
            inner = f"<{frame}>{inner}</{frame}>"
        before = "".join(rng.choice([junk, plain_junk])() for _ in range(rng.randint(0, 3)))
        after = "".join(rng.choice([junk, plain_junk])() for _ in range(rng.randint(0, 3)))
        row = []
        for found, block in blocks(f"<html><body>{before}{inner}{after}</body></html>"):
            label, _, rest = found.partition(" ")
            row.append((re.sub(r"(?<!\S)(?:main|other) ", "", rest), block, label))
        if row:
            pages.append(row)
    return pages


@cache
def model() -> LinearChain:
    """Trained once, on the driver, from the labelled pages; tasks receive it."""
    rows = []
    for page in training_pages():
        rows.append(([list(f) for f in features([(t, b) for t, b, _ in page])], [label for _, _, label in page]))
    return train(rows, LABELS)


def main_texts(pages: list[str | None], chain: LinearChain) -> list[str]:
    """Main text of each page."""
    found = [blocks(html) for html in pages]
    scores: dict[tuple, np.ndarray] = {}
    rows = []
    for page in found:
        for names in features(page):
            if names not in scores:
                scores[names] = chain.emit[chain.numbers(list(names))].sum(axis=0)
            rows.append(scores[names])
    lengths = np.array([len(p) for p in found if p])
    labels = iter(chain.viterbi(np.array(rows), lengths) if rows else [])
    return ["\n".join(text for text, _ in page if LABELS[next(labels)] == "main") for page in found]


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every page."""
    chain = model()

    def run(batches: Iterator[dict]) -> Iterator[list[tuple]]:
        for batch in batches:
            rows = []
            for at in range(0, len(batch["page_id"]), 256):
                part = slice(at, at + 256)
                rows += zip(batch["page_id"][part], batch["url"][part], main_texts(batch["html"][part], chain), strict=True)
            yield rows

    return map_rows(pages.select("page_id", "url", "html"), run, "page_id long, url string, text string")


def op2_html(spark, sf_dir) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
