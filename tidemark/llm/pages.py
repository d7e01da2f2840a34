"""Main text of web pages: the contiguous region of words and tags with the greatest score."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Collection, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_ids, fields

SAMPLE = 2_000  # labelled pages
KINDS = 20_000  # keys that are learned

# Names that say what an element is for (fixed values of the HTML standard).
MAIN = frozenset({"article", "main"})
VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"})
RAW = frozenset({"script", "style", "textarea", "title", "noscript", "iframe", "noembed", "noframes", "xmp"})
# Elements without text of the page: code, controls, embedded and alternative content.
NEVER = frozenset({
    "script", "style", "noscript", "template", "iframe", "svg", "canvas", "object", "form", "button", "select", "option", "textarea",
    "dialog", "title", "head", "noembed", "noframes", "xmp", "audio", "video", "annotation",
})
INLINE = frozenset({
    "a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q",
    "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "big", "img",
    "math", "semantics", "mrow", "mi", "mn", "mo", "mtext", "msup", "msub", "msubsup", "mfrac", "msqrt", "mroot", "mover", "munder",
})
# Names of elements, classes and roles that count as seen ``PRIOR`` times outside of an article before any page is read.
FURNITURE = frozenset({
    "article", "main", "nav", "footer", "aside", "menu", "navbar", "navigation", "breadcrumb", "breadcrumbs", "pagination", "sidebar",
    "ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "cookie", "cookies", "consent", "newsletter",
    "subscribe", "signup", "comment", "comments", "reply", "replies", "disqus", "related", "share", "sharing", "social",
    "complementary", "contentinfo",
})
# Names that say so only outside of an article; within one they are names of its own parts.
OUTER = frozenset({"header", "banner", "notice", "notices", "widget", "search", "toolbar", "login", "modal", "popup"})
# Names that say so as a part of a longer name as well.
TELLING = frozenset({
    "ad", "ads", "advert", "advertisement", "comment", "comments", "cookie", "cookies", "footer", "nav", "navbar", "navigation",
    "newsletter", "sidebar", "sponsored",
})
PRIOR = 8
# What holds or names the article is not judged by its class.
WHOLE = frozenset({"html", "body", "h1", "h2", "h3", "h4", "h5", "h6"})
MOST = 40.0  # words that a tag costs which is only found outside of articles
UNSEEN = -0.25  # of a tag that labelled pages do not have
WORD = 1.0  # of a word; less within elements that are also found outside
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"([^\s=>\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_STATE = re.compile(r"(?:no|has|with|without|is|not)[-_]", re.I)
_WHITE = re.compile(r"\s+")
_WORDS = re.compile(r"\S+")


@dataclass
class Piece:
    """A tag or a run of text."""

    kind: str  # name of a tag with / for its end, or "" for text
    text: str
    inside: bool  # of an article by its markup
    hidden: bool  # within an element that has no text of the page
    keys: tuple[str, ...] = ()  # what a tag is scored by; its name if empty
    end: int = -1  # of an opening tag: the place after its element
    holds: bool = False  # an opening tag: its element has an article in it
    share: float = WORD  # of a word


def pieces(page: str) -> list[Piece]:
    """The tags and texts of a page in one pass, with the state of open elements.

    A close tag closes up to its nearest open element, one without is ignored.  Elements that are left
    open end with the element around them, so a paragraph that is never closed does no harm.
    """
    out: list[Piece] = []
    # (name, its text is hidden, it is the article, its opening tag); how many of them are open
    stack: list[tuple[str, bool, bool, Piece]] = []
    names: Counter[str] = Counter()
    hidden = mains = 0
    at, n = 0, len(page)

    def pop() -> str:
        nonlocal hidden, mains
        top, dark, main, opening = stack.pop()
        names[top] -= 1
        hidden -= dark
        mains -= main
        opening.end = len(out)
        return top

    while at < n:
        m = _TOKEN.match(page, at)
        at = m.end()
        name = (m.group(2) or "").lower()
        if not name:
            text = m.group()
            if text[:2] not in ("<!", "<?"):
                out.append(Piece("", text, mains > 0, hidden > 0))
            continue
        if m.group(1):
            closing = Piece("/" + name, "", mains > 0, hidden > 0)
            if names[name]:
                while stack[-1][0] != name:
                    pop()
                closing.keys = stack[-1][3].keys
                out.append(closing)
                pop()
            else:
                out.append(closing)
            continue
        keys, dark = _named(name, m.group(3), mains > 0)
        dark = dark or name in NEVER
        if name == "p" and names["p"] and stack[-1][0] == "p":
            pop()
        opening = Piece(name, "", mains > 0, hidden > 0 or dark, keys, len(out) + 1)
        main = name in MAIN and not hidden and not dark
        if main:
            for _, _, _, around in reversed(stack):
                if around.holds:  # and so do all around it
                    break
                around.holds = True
        out.append(opening)
        if name in VOID or m.group(3).rstrip().endswith("/") and name not in RAW and name not in MAIN:
            continue
        stack.append((name, dark, main, opening))
        names[name] += 1
        hidden += dark
        mains += main
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            stop = end.start() if end else n
            if stop > at:
                out.append(Piece("", page[at:stop], mains > 0, True))
            at = stop
    while stack:
        pop()
    return out


def _named(element: str, attributes: str, within: bool) -> tuple[tuple[str, ...], bool]:
    """The keys of an element, and whether its attributes hide it.

    Keys are its classes and roles, telling parts of them, and its id if it is no section's anchor in an
    article; an element without any has its name.  ``OUTER`` names are other keys ``within`` an article.
    """
    words: list[str] = []
    if attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            name, value = m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or ""
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                return (element,), True
            if element in WHOLE or element in MAIN and not within or name not in ("class", "id", "role"):
                continue
            if name == "id" and within and element == "section":
                continue
            for word in value.lower().split():
                words.append(word)
                if name != "id" and not _STATE.match(word):
                    words += [part for part in re.split(r"[-_]+", word) if part in TELLING and part != word]
    # An element of a telling name keeps it beside its classes.
    if not words or element in FURNITURE or element in OUTER:
        words.append(element)
    return tuple(f"article {w}" if within and w in OUTER else w for w in dict.fromkeys(words)), False


def _outermost(parts: list[Piece]) -> list[tuple[int, int]]:
    """Where the markup has articles: the outermost ``article`` elements, without any the ``main`` elements."""
    for name in ("article", "main"):
        found: list[tuple[int, int]] = []
        for i, p in enumerate(parts):
            if p.kind == name and not p.hidden and (not found or i >= found[-1][1]):
                found.append((i, p.end))
        if found:
            return found
    return []


def count(page: str) -> Counter:
    """How often each key stands inside and outside of the articles of a labelled page; nothing on others.

    Elements around an article are on neither side.  What is within an element outside is explained by that
    element and not counted, nor is what the fixed names take out of an article.  The tags of an article are
    outside of it.
    """
    found: Counter = Counter()
    parts = pieces(page)
    left_out = judge(parts, weights({}))
    spans = [(i, j) for i, j in _outermost(parts) if left_out[i] is None]
    i = 0
    for start, stop in [*spans, (len(parts), len(parts))] if spans else []:
        while i < start:
            p = parts[i]
            if p.end < 0 or i < start < p.end:
                i += 1
                continue
            if not p.hidden:
                found.update((k, False) for k in p.keys)
            i = p.end
        if start < len(parts):
            found.update((k, False) for k in parts[start].keys)
        inside = [p for p, cost in zip(parts[start + 1 : stop], left_out[start + 1 : stop], strict=True) if cost is None and p.end >= 0 and not p.hidden]
        found.update((k, True) for p in inside for k in p.keys)
        i = stop
    return found


def weights(table: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Scores of keys in words, 0 to ``-MOST``, by how much more often labelled pages have them outside of articles.

    ``FURNITURE`` and ``OUTER`` names start with ``PRIOR`` elements outside.
    """
    keys = {k for k, _ in table} | FURNITURE | OUTER
    out = {}
    for k in keys:
        inside = table.get((k, True), 0)
        outside = table.get((k, False), 0) + (PRIOR if k in FURNITURE or k in OUTER else 0)
        out[k] = -MOST * max(0.0, 2 * outside / (inside + outside + 1) - 1)
    return out


def _of(p: Piece, score: dict[str, float]) -> float:
    """The score of a tag: its least key that is known."""
    known = [score[k] for k in p.keys or (p.kind.lstrip("/"),) if k in score]
    return min(known) if known else UNSEEN


def judge(parts: list[Piece], score: dict[str, float]) -> list[float | None]:
    """What each piece costs that is left out wherever it stands, null for the others; sets the ``share`` of words.

    An element is left out if it costs over half of ``MOST``: three of four like it are outside of articles.  Where that would take every
    article of the page's markup, these and the elements around them stay.
    """
    articles = {i for i, _ in _outermost(parts)}
    out = _left_out(parts, score, frozenset())
    if articles and all(out[i] is not None for i in articles):
        out = _left_out(parts, score, articles)
    return out


def _left_out(parts: list[Piece], score: dict[str, float], spared: Collection[int]) -> list[float | None]:
    out: list[float | None] = [None] * len(parts)
    stop = 0
    around: list[tuple[int, float]] = []  # ends of open elements and the shares of words in them
    for i, p in enumerate(parts):
        while around and around[-1][0] <= i:
            around.pop()
        if i < stop:
            out[i] = 0.0
        elif not p.kind:
            p.share = around[-1][1] if around else WORD
        elif p.end > i + 1 and not p.hidden:
            known = [score[k] for k in p.keys if k in score and k not in MAIN]
            least = min(known, default=0.0)
            if least < -MOST / 2 and p.kind not in WHOLE and not (spared and (p.holds or i in spared)):
                out[i], stop = 0.0 if p.inside else 2 * least, p.end
            elif not p.holds:
                share = WORD * (1 + least / MOST)
                around.append((p.end, min(share, around[-1][1]) if around else share))
    return out


def region(parts: list[Piece], score: dict[str, float]) -> tuple[int, int]:
    """The contiguous run of pieces with the greatest total score, by one scan; the first of equals.

    Words score their share, tags what they have learned.  An element that is left out costs its two tags, but
    nothing within an article of the markup, which it does not split.
    """
    return _best(parts, score, judge(parts, score))[:2]


def _best(parts: list[Piece], score: dict[str, float], left_out: list[float | None]) -> tuple[int, int, float]:
    """The best run and its score."""
    best, best_at, total, start = 0.0, (0, 0), 0.0, 0
    for i, (p, cost) in enumerate(zip(parts, left_out, strict=True)):
        if p.hidden:
            s = 0.0
        elif cost is not None:
            s = cost
        else:
            s = _of(p, score) if p.kind else p.share * len(_WORDS.findall(p.text))
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, best_at = total, (start, i + 1)
    return (*best_at, best)


def content(parts: list[Piece], score: dict[str, float]) -> list[list[Piece]]:
    """The pieces of the main text, one list for each region; those that are left out are hidden.

    One region, that of the greatest score; where the markup has several articles, the best one of each, unless
    one region anywhere scores more than all of them.
    """
    left_out = judge(parts, score)
    a, b, best = _best(parts, score, left_out)
    chosen = [(a, b)]
    articles = [(i, j) for i, j in _outermost(parts) if left_out[i] is None]
    if len(articles) > 1:
        each = [(i, *_best(parts[i:j], score, left_out[i:j])) for i, j in articles]
        if sum(s for *_, s in each) >= best:
            chosen = [(i + a, i + b) for i, a, b, _ in each]
    for p, cost in zip(parts, left_out, strict=True):
        p.hidden |= cost is not None
    return [parts[a:b] for a, b in chosen]


def extract(page: str | None, score: dict[str, float]) -> str:
    """The blocks of the best regions, joined by an empty line.

    Character references are decoded, white space within a block is one space.
    """
    blocks, now = [], []

    def close() -> None:
        text = _WHITE.sub(" ", html.unescape("".join(now))).strip()
        if text:
            blocks.append(text)
        now.clear()

    for run in content(pieces(page or ""), score):
        for p in run:
            if p.hidden:
                if p.kind and p.kind.lstrip("/") not in INLINE:
                    close()
            elif not p.kind:
                now.append(p.text)
            elif p.kind == "br":
                now.append(" ")
            elif p.kind.lstrip("/") not in INLINE:
                close()
        close()
    return "\n\n".join(blocks)


def train(pages: DataFrame, sample: int = SAMPLE, kinds: int = KINDS) -> dict[str, float]:
    """Scores of keys from labelled pages: those whose own markup names articles (``article`` or ``main``).

    At most ``sample`` pages, the smallest by hash of page_id; only counts of keys reach the driver, of the
    ``kinds`` most frequent ones.  Without any labelled page all scores are those of the fixed names.
    """
    bare = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["html"].cast("string").alias("html"))
    few = bounded_ids(bare, "page_id", sample)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            total: Counter = Counter()
            for page in batch["html"].dropna():
                found = count(page)
                if any(inside for _, inside in found):
                    total += found
            yield pd.DataFrame([(k, w, n) for (k, w), n in total.items()], columns=["kind", "inside", "n"])

    labelled = bare.join(F.broadcast(few), "page_id", "left_semi")  # a bounded number of ids
    counts = labelled.mapInPandas(run, fields(kind="string", inside="boolean", n="bigint")).groupBy("kind", "inside").agg(F.sum("n").alias("n"))
    # Keys of a bounded number of pages; a page can make up names, so their number is bounded too.
    rows = counts.orderBy(F.desc("n"), "kind", "inside").limit(kinds).collect()
    return weights({(r["kind"], r["inside"]): r["n"] for r in rows})


def texts(pages: DataFrame, score: dict[str, float] | None = None) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of each row of ``pages(page_id, url, html)``.

    A null or empty page, and one without words outside of menus and the like, has the text "".  Repeated
    rows are treated alike, nulls of page_id and url are kept, other columns are ignored.
    """
    known = train(pages) if score is None else score

    @F.pandas_udf("string")
    def main(html_: pd.Series) -> pd.Series:
        return pd.Series([extract(x, known) for x in html_], dtype=object)

    bare = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"], main(pages["html"].cast("string")).alias("text"))
    return bare.withColumn("n_chars", F.length("text").cast("long"))
