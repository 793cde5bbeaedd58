"""Operator 4: main text of web pages by the maximum-scoring subsequence of words and tags.

A page is a row of tokens: words score positive, tags negative, and words inside menus, footers,
adverts, forms and the like score negative too. One linear scan finds the contiguous region of the
highest sum; its words of positive score, joined block by block, are the main text.

Weights are log-odds of a token inside against outside the article, learned on a bounded sample of
pages that label themselves by ``article`` or ``main`` markup; the signs of words and tags are kept
as above, but for tags inside an article that the page itself marks, which cost nothing: such an article is
not cut at its lists and links. Words of class, id and role get log-odds too, from the text in such elements, on
``LEAST_PAGES`` or more labelled pages: a name whose words lie outside marks what is not of the article,
one whose words lie inside is trusted whatever the prior list below says. Without labelled pages the weights are ``DEFAULT_WEIGHTS``.

A name alone never takes away the page's principal ``article`` or ``main`` (that of most words), whatever it
lies in; nor does a name of the prior list take away more than half of the words of the article (or page)
around, but for reader comments. Where names leave nothing, they do not count.

Pages are read as browsers do where it matters: scripts and the like end at their own closing tag,
paragraphs, list items and table cells end where the next one begins, closing tags end what is open
inside of them. An element left open that would hide an ``article`` or ``main`` does not; a form
around the page (with a heading, page structure or paragraphs of text inside) is no form. Reading
takes time linear in the page.

Defined results: a null or empty page, or one without words, gives an empty text of 0 characters.
Unclosed tags end with the page. Repeated rows give repeated rows. Columns of ``df`` other than the
kept ones may have any name; a kept column called text or n_chars is replaced by the result.
"""

from __future__ import annotations

import html as references
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import hash_sample, prepare

TRAIN_PAGES = 500
TRAIN_PAGE_CHARS = 200_000
WORD, LINK_WORD, OUTER_WORD = "#word", "#link-word", "#outer-word"
DEFAULT_WEIGHTS = {WORD: 1.0, LINK_WORD: 0.2, OUTER_WORD: -0.25}
DEFAULT_TAG_WEIGHT = -0.3
#: Bounds of the learned weights: cleanly labelled pages give log-odds that would let one advert cut an article in two.
LEAST, MOST_WORD, MOST_TAG, MOST_OUTER = 0.01, 2.0, 1.0, 0.25
#: A name is not of the article if its log-odds lie this far below those of all words.
SURE = 3.0

#: Elements whose content is never text, elements that are never the article, and inline elements. Fixed by HTML.
RAW = frozenset("script style noscript template textarea title svg math iframe object canvas audio video".split())
OUTER = frozenset("nav aside footer form header menu dialog button select fieldset head".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words in class, id or role that mark a container as not of the article without being seen on labelled pages.
_OUTER_NAME = re.compile(
    r"ad|ads|advert\w*|banner|sponsor\w*|promo\w*|sidebar|comments?|disqus|repl(?:y|ies)|cookie\w*|consent|notice\w*|alert|popup|modal|newsletter|subscribe|"
    r"related|recommended|share|sharing|social|breadcrumbs?|menu|nav|navbar|navigation|footer|foot|masthead|topbar|toolbar|widget|complementary|contentinfo|search")  # fmt: skip
_NAME_WORD = re.compile(r"[^\s_-]+")
#: A quoted value starts after "=" and ends before a space, "/" or ">"; any other quote is stray, and the tag ends at its first ">".
_TAG_END = re.compile(r"[^>=]*+(?:=\s*+(?:\"[^\"]*+\"(?=[\s/>])|'[^']*+'(?=[\s/>])|)[^>=]*+)*+>")
_TAG_START = re.compile(r"<(?=[a-zA-Z/!?])")
#: Where the content of elements ends that holds no tags: at their own closing tag and nowhere else.
_ENDS = {name: re.compile(rf"</{name}(?:[\s/][^>]*)?>", re.I) for name in ("script", "style", "textarea", "title", "iframe")}
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"\shidden(?=[\s>=/])|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
#: What ends an open paragraph; what ends its like, up to the element around them; what may stand in a head; what shows that a form is the page. Fixed by HTML.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
ENDS_LIKE = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)),
    "td": (("td", "th"), ("table",)), "th": (("td", "th"), ("table",)), "tr": (("tr",), ("table",)), "p": (("p",), ("td", "th", "table", "button")),
}
IN_HEAD = frozenset("base link meta noscript script style template title".split())
STRUCTURE = frozenset("article main h1 nav header footer".split())
FORM_TEXT_WORDS, LEAST_PAGES = 25, 25
_COMMENTS = re.compile(r"comments?|disqus|repl(?:y|ies)")

Token = tuple[str, str, bool]  # kind or tag name, text, whether in the article by markup


def pieces(page: str) -> Iterator[tuple[str, str]]:
    """Each text with the tag or comment after it. Scripts and the like are one piece from opening to closing tag."""
    at, last, quotes = 0, page.rfind(">"), True
    while found := _TAG_START.search(page, at):
        start = found.start()
        if page.startswith("<!--", start):
            close = page.find("-->", start + 4)
            end, piece = (close + 3, "") if close >= 0 else (len(page), "")
        elif start > last:
            break
        else:
            whole = _TAG_END.match(page, start) if quotes else None
            quotes = whole is not None  # once quoted values run to the page's end, quotes are stray from there on
            end = whole.end() if whole else page.find(">", start) + 1
            piece = page[start:end]
            tag = _TAG.match(piece)
            ends = _ENDS.get(tag[2].lower()) if tag and not tag[1] and not piece.endswith("/>") else None
            if ends:
                close, piece = ends.search(page, end), ""
                end = close.end() if close else len(page)
        yield page[at:start], piece
        at = end
    yield page[at:], ""


class Element:
    """An open element: its names, whether its own closing tag comes, its words, and, for a form, whether it is the page."""

    __slots__ = ("name", "names", "hidden", "closed", "page", "words", "outer", "raw", "parent", "size", "comments", "principal")

    def __init__(self, name: str, tag: str, parent: Element | None) -> None:
        self.name, self.names, self.hidden = name, (), False
        if " " in tag or "\n" in tag:
            self.names = tuple(_NAME_WORD.findall(" ".join(a or b or c for a, b, c in _NAMES.findall(tag)).lower()))
            self.hidden = bool(_HIDDEN.search(tag))
        self.closed = self.page = self.raw = self.principal = False
        self.words = self.size = 0
        self.parent = parent
        self.comments = (parent is not None and parent.comments) or any(map(_COMMENTS.fullmatch, self.names))
        self.outer: Element | None = None


Event = tuple[str, object]  # ("text", text), ("open", element), ("close", element), ("tag", name)


def events(page: str) -> tuple[list[Event], int]:
    """Texts, elements that open and close, implied ends included, and tags that open nothing or close nothing; and the words of all texts.

    Afterwards each element knows its words (without the principal article's, if it lies inside), and the principal article is marked.
    """
    out: list[Event] = []
    stack: list[Element] = []
    places: dict[str, list[int]] = {}  # of the open elements, by name
    form: Element | None = None
    principals: list[Element | None] = [None, None]  # outside of reader comments, and inside
    total = raw = 0

    def end(depth: int) -> None:
        nonlocal form, raw
        while len(stack) > depth:
            element = stack.pop()
            places[element.name].pop()
            raw -= element.name in RAW
            element.size = total - element.size
            if element is form:
                form = None
            best = principals[element.comments]
            if element.name in ("article", "main") and (best is None or element.size >= best.size):
                principals[element.comments] = element
            out.append(("close", element))

    def find(names: tuple[str, ...], bounds: tuple[str, ...]) -> int | None:
        """The innermost open element of the names, unless one of the bounds is open inside of it."""
        depth = max((places[n][-1] for n in names if places.get(n)), default=-1)
        return depth if depth > max((places[n][-1] for n in bounds if places.get(n)), default=-1) else None

    for text, piece in pieces(page):
        if text:
            out.append(("text", text))
            n = 0 if raw else len(text.split())
            total += n
            if form is not None and places.get("p"):
                form.words += n
        tag = _TAG.match(piece)
        if not tag:
            continue
        name = tag[2].lower()
        if tag[1]:
            if places.get(name):
                depth = places[name][-1]
                stack[depth].closed = True
                end(depth)
            out.append(("tag", name))
            continue
        if stack and stack[-1].name == "head" and name not in IN_HEAD:
            end(len(stack) - 1)
        if name in ENDS_P and (depth := find(*ENDS_LIKE["p"])) is not None:
            end(depth)
        if name in ENDS_LIKE and (depth := find(*ENDS_LIKE[name])) is not None:
            end(depth)
        out.append(("tag", name))
        if name in STRUCTURE and form is not None:
            form.page = True
        if name in VOID or (piece.endswith("/>") and name in RAW) or (name == "form" and form is not None):
            continue
        element = Element(name, piece, stack[-1] if stack else None)
        element.size = total
        raw += name in RAW
        if name == "form":
            form = element
        places.setdefault(name, []).append(len(stack))
        stack.append(element)
        out.append(("open", element))
    end(0)
    principal = principals[0] or (principals[1] if principals[1] and 2 * principals[1].size > total else None)
    if principal:
        principal.principal, around = True, principal.parent
        while around:  # has what is beside the principal article
            around.size, around = around.size - principal.size, around.parent
    return out, total


def prior(name: str) -> bool:
    """Whether a tag (``tag:…``) or a word of a class, id or role (``name:…``) marks what is not of the article, before labelled pages are seen."""
    kind, _, word = name.partition(":")
    return word in OUTER if kind == "tag" else bool(_OUTER_NAME.fullmatch(word))


def features(element: Element) -> list[str]:
    return [f"tag:{element.name}", *(f"name:{n}" for n in element.names), *(f"name:{a}{b}" for a, b in zip(element.names, element.names[1:], strict=False) if a + b in ("sidebar",))]


def marked(element: Element, weights: dict[str, float], around: int, named: bool = True) -> bool:
    """Whether an element is not of the article, by its tag, or by its names' weights or the prior where names count (``named``).

    ``around`` is the number of words of the article, or page, around it.
    """
    if element.name in ("body", "html", "main") or (element.name == "form" and (element.page or element.words >= FORM_TEXT_WORDS)):
        return False
    if element.hidden or element.name in OUTER:
        return True
    names = [f for f in features(element) if f.startswith("name:")] if named and not element.principal else []
    if any(weights.get(f, 0.0) < 0 for f in names) or any(map(_COMMENTS.fullmatch, element.names)) and names:
        return True
    return 2 * element.size <= around and any(f not in weights and prior(f) for f in names)


def tokens(page: str, weights: dict[str, float], seen: list[tuple[tuple[str, ...], int, bool | None]] | None = None, named: bool = True) -> Iterator[Token]:
    """Text and tags in page order. Texts are of kind WORD, LINK_WORD or OUTER_WORD.

    ``seen`` collects, for each text, the features around it, its words, and whether it is inside the article (None: in doubt).
    """
    stack: list[Element] = []
    around: Counter[str] = Counter()
    link = article = raw = 0
    found, total = events(page)
    articles: list[int] = [total]
    for kind, value in found:
        if kind == "text":
            outer = stack[-1].outer if stack else None
            if not raw:
                yield OUTER_WORD if outer else LINK_WORD if link else WORD, value, article > 0 and outer is None
                if seen is not None and (n := len(value.split())):
                    seen.append((tuple(f for f, c in around.items() if c), n, article > 0 if outer is None else None if article else False))
        elif kind == "tag":
            if not raw:
                yield value, "", article > 0 and not (stack and stack[-1].outer)
        else:
            element: Element = value
            step = 1 if kind == "open" else -1
            raw += step * (element.name in RAW)
            link += step * (element.name == "a")
            if element.name in ("article", "main"):
                article += step
                if kind == "close":
                    articles.pop()
            if seen is not None:
                for f in features(element):
                    around[f] += step
            if kind == "open":
                element.outer = stack[-1].outer if stack else None
                if element.outer and not element.outer.hidden and (element.name == "main" or element.name == "article" and (not element.outer.closed or element.principal and element.outer.name not in OUTER)):
                    element.outer = None
                if element.outer is None and marked(element, weights, articles[-1], named):
                    element.outer = element
                stack.append(element)
                if element.name in ("article", "main"):
                    articles.append(element.size)
            else:
                stack.pop()


def learn(pages: list[str]) -> dict[str, float]:
    """Log-odds inside against outside of self-labelled articles, words kept positive and tags negative, and those of names."""
    inside: Counter[str] = Counter()
    outside: Counter[str] = Counter()
    names: dict[str, list[int]] = {}  # feature: pages, words inside, words outside
    for page in pages:
        seen: list[tuple[tuple[str, ...], int, bool | None]] = []
        row = list(tokens(page, DEFAULT_WEIGHTS, seen))
        if not any(labelled for *_, labelled in row):
            continue
        for kind, text, labelled in row:
            (inside if labelled else outside)[kind] += len(text.split()) if kind[0] == "#" else 1
        met = set()
        for around, n, labelled in seen:
            if labelled is not None:
                for f in around:
                    own = names.setdefault(f, [0, 0, 0])
                    own[0] += f not in met
                    own[1 if labelled else 2] += n
                    met.add(f)
    if not inside or not outside:
        return dict(DEFAULT_WEIGHTS)
    kinds = set(inside) | set(outside)
    all_in, all_out = sum(inside.values()) + len(kinds), sum(outside.values()) + len(kinds)
    odds = {k: math.log((inside[k] + 1) / all_in * all_out / (outside[k] + 1)) for k in kinds}
    weights = {k: max(-MOST_TAG, min(-LEAST, w)) for k, w in odds.items() if k[0] != "#"}
    weights[WORD] = max(0.5, min(odds.get(WORD, 1.0), MOST_WORD))
    weights[LINK_WORD] = max(LEAST, min(odds.get(LINK_WORD, 0.2), weights[WORD]))
    weights[OUTER_WORD] = max(-MOST_OUTER, min(-LEAST, odds.get(OUTER_WORD, -MOST_OUTER)))
    words_in, words_out = (sum(own[n] for f, own in names.items() if f == "tag:body") + 1 for n in (1, 2))
    for f, (n_pages, n_in, n_out) in names.items():
        if n_pages >= LEAST_PAGES and f.startswith("name:"):  # tags alone say too little: a page's only div may be an advert
            odds_of = math.log((n_in + 1) / words_in * words_out / (n_out + 1))
            if odds_of + SURE < 0 or odds_of > 0 and n_in and prior(f):
                weights[f] = odds_of
    return weights


def best_region(scores: list[float]) -> tuple[int, int]:
    """The contiguous region [start, end) of the highest sum, the first and shortest such; empty if none is positive."""
    best, at, total, start = 0.0, (0, 0), 0.0, 0
    for n, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, n
        total += score
        if total > best + 1e-12:
            best, at = total, (start, n + 1)
    return at


def main_text(page: str | None, weights: dict[str, float]) -> str:
    """The article's text: references decoded, white space within a block collapsed, blocks joined by a space."""
    if not page:
        return ""
    return _region_text(page, weights, True) or _region_text(page, weights, False)


def _region_text(page: str, weights: dict[str, float], named: bool) -> str:
    row = list(tokens(page, weights, named=named))
    scores = []
    for kind, text, own in row:
        if kind[0] == "#":
            scores.append(weights[kind] * len(text.split()))
        else:
            scores.append(0.0 if own else weights.get(kind, DEFAULT_TAG_WEIGHT))
    start, end = best_region(scores)
    out = []
    for kind, text, _ in row[start:end]:
        if kind[0] != "#":
            if kind not in INLINE:
                out.append(" ")
        elif weights[kind] > 0:
            out.append(references.unescape(text) if "&" in text else text)
    return " ".join("".join(out).split())


def fit(df: DataFrame, html_column: str = "html", id_column: str = "page_id", pages: int = TRAIN_PAGES) -> dict[str, float]:
    """Weights from at most ``pages`` self-labelled pages of bounded length, chosen by a hash of the id."""
    rows = df.filter(F.col(html_column).rlike("(?i)<(article|main)[\\s>]") & (F.length(html_column) <= TRAIN_PAGE_CHARS))
    sample = hash_sample(rows.select(F.col(id_column).alias("o"), F.col(html_column).alias("h")), pages, "o").collect()
    return learn([row["h"] for row in sample])


def extract(df: DataFrame, weights: dict[str, float], html_column: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The kept columns, ``text`` and ``n_chars``."""
    prepare(df.sparkSession)
    keep = tuple(c for c in keep if c not in ("text", "n_chars"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page, weights) for page in batch.column(0).to_pylist()]
            made = [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *made], names=[*batch.schema.names[1:], "text", "n_chars"])

    rows = df.select(F.col(html_column).alias("__html"), *keep)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[1:])
    return rows.mapInArrow(run, f"{kept}, text string, n_chars long")
