"""HTML extraction (operator 8).

A page is cut into flat text blocks at its block-level tags. Each block has its word count and link density, those of
the blocks before and after it, and what its open elements say: inside an article or main element, inside page furniture, under
a class, id or role that names furniture, outside the article that holds most of the page's text, a paragraph, or a list item. A decision tree, trained on the small labelled table
below, keeps or drops each block; the kept ones, one to a line, are the text. On pages without an article the counts of the block
and its neighbours decide: a short line before a long paragraph is a heading, between links it is a menu.

A class or id names furniture only as a whole (`share-buttons`, not `skip-lines` or `has-sidebar`), or where a part of it names reader comments or
adverts (`user-comment`, `comment-body`), not on a wrapper that holds a main element or the longest article, and inside an article not on a
paragraph, heading, list item or cell.

The scanner goes through a page once, without backtracking, and open elements are found by name, so time and memory are in proportion
to the page, whatever its markup.

Within a block, inline tags vanish, line breaks count as white space, character references are decoded after the tags are gone, and
white space becomes one space. Scripts, styles and other elements without running text are left out whole; of those other than
raw text, one whose end tag is missing ends at the next block-level tag. A head without end tag ends before the first tag or text
that can't be in it.

Defined results: null or blank html gives an empty text. Unclosed and truncated markup is read as far as it goes:
a cut-off tag at the end is dropped. Repeated rows each come out; page_id and url may be null. Pages are read whole.
Other columns of the input are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercadia.llm.common import spread, table

FEATURES = ["words", "links", "words_before", "links_before", "words_after", "links_after", "place", "paragraph", "item"]
PLACE = FEATURES.index("place")
#: The marks of LABELLED.
MARKS = "afhopt"
#: The labelled table, a page to a line: words/linked words of each block in page order, + where it belongs to the text, a inside an article or main
#: element, f inside furniture, h where a name says so, o outside the article, p a paragraph, t a list item. Pages are made up after common layouts; most of them mark up nothing.
LABELLED = """
1/1f 1/1f 8h +6a +45a +1a +70a +30a 9f
2/2f +9a +120a +40/30a +5/5a +60a 12f
1/1f +4a +2/2a 2ah +50a 1ah 40ah 10/10f
1/1f 45f 15af +44a 3/2af 60f
1/1f +6a +1a +2a +1a +3a 2ah 1ah 9ah 5f
+9a
+1a +2/2a
+12a +3a +2/2a +1/1a 3/3ah 12ah 4f
2f 12af +8a 20af
+5a +6/6a +12/12a 7/5ah +3a +30a 14af
+10a +11/9a +16/14a 30ah 8f
2/2 1/1 +5a +33a +1a +28a 18h 60h
20h 3/3h +7 +55 +40 25h 60h 7/2h
1/1 2/2 +3 +80 +60 +6 +75 3/3 1/1 12
18 2/2 1/1 +9 +45 +30 +12 +50 5/5 3/3 8
1/1 3/3 1/1 +14 +95/4 +50/6 2/2 6/6 9/9 20/18
2 5/5 4/4 +5 +38 +7 +42 +25 30/28 3
+60 +50 +9 +70
6/6 8/8 12/12 9/9 3 10 5
+40
+5 +26 4
1/1 1/1 +70 1/1
3/3 +48 +33 2/2
2/2 8/8 +55
15 4 9 2/2 3/3 +8 +64 +18/2 +58 10 1/1 22 5
30/22 2/2 +6 +130 +4 +20 +90 3 8
+2 +35 +28 40/33 60/55 9
3 8 1/1 6 12
1/1 6 1/1 +11 +46 +3 +49 +27 7/7 14 4
16 7 4/4 +8 +85 +37 9 13
1/1t 1/1t 1/1t +6 +45p +70p +30p 9
2/2t 3/3t +5 +12p +14p +9p 4
+12p +14p +9p
+8p +5p +11p
1/1t 2/2t +7 +40p +3t +2t +4t +42p 5
+4 +60p +6p 3/3t 2/2t
+38p +6p 2/2 5/5
+5 +20p +6p
3/3 2/2 +8 +80p +9/9p +50p +6p 7
+9/9ap +40ap +3at +2at +12/12at +6ap
+40ap +9/9ap +5ap 60o 30o 1o 4/4o
+6a +50ap +8ap 3o 45op 70op 12op
2/2o 14op +9a +30ap +3/3a +25ap 6/6ot 60o 8of
+4a +4/4ap +2/2at +90ap 20apf 30ah 25aph
1/1t 1/1t +41p +4t +6t +1t +3/3t +38p 2/2t 2/2t
30ph 2/2pf 40pf +25p +35p 9/9t 8/8t
+50ap +20ap
+33ap +90ap +13ap
+35a +80a +28a
+8a +45ap +20/8ap +16/9ap +14ap
+44ap +30/12a +18ap 5of 9of
+15/6ap +7/3ap +12/5at +4/2a
+22/11a +3/1ap +60/30ap +1/1a +1/1ap
+40p +25p
+52p +15p
+30p +70p +12p
+40p +30/10p +22p
+19p +8/4p +33/9p +14p
+80ap 20o 12op 30o 6o 15/5op
+60a 12o 55/20o 9/4op 80o 3ot
6h 40h 12ph 90/9h 33ah 18/6aph 25f 70f 35pf 4af 50/10af 22ft 5/5ah 2/1h 30/15pf
+60p 12h 8pf 70/20h
+24/18a +10/8at +40/31ap +12/10at +5/4a +16/12ap +3/2at +90/80a +7/6at +30/23ap
1/1 2/2 +8 +50 +40 3/3 20/16 4/4 14
25 4/4 2/2 +5 +60 +44 7/7 18/15 2/2 11
"""
_SKETCH = re.compile(rf"(\+?)(\d+)(?:/(\d+))?([{MARKS}]*)")

_BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_FURNITURE = set("nav footer aside form menu dialog fieldset".split())
_ARTICLE = set("article main".split())
_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
_NAMES = set(
    "ad ads adv advert adverts advertisement adsense adslot sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe signup login sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead pagination comment comments disqus reply replies respond "
    "share sharing social related recommended trending".split()
)
#: Names of which one part of a class or id is enough.
_SURE = set("comment comments commentlist commenter commentary disqus replies advert adverts advertisement advertisements advertising sponsored".split())
#: Words that may stand beside a name in a class or id.
_FILLERS = set("area bar block box btn button buttons container content form group holder icons item items left link links list main message module panel post posts right section site slot text top bottom widget widgets wrap wrapper".split())
_TEXT_TAGS = set("p h1 h2 h3 h4 h5 h6 li dt dd td th tr pre blockquote figcaption caption legend address span a b i em strong".split())
_RAW = "script|style|textarea|iframe"
_SKIPPED = set("noscript template select button svg object canvas".split())
_IN_HEAD = set("title meta link base script style noscript template head html".split())
_HEAD_END = re.compile(r"</(noscript|template)\s*>|<body\b|</head\b", re.I)
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*)")
_RAW_TAG = re.compile(rf"<({_RAW})(?![^\s/>])", re.I)
_ANGLE = re.compile("[<>]")
_QUOTE = re.compile("[>\"']")
_NAMED = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_PARTS = re.compile(r"[a-z]+")
#: A new block ends an open paragraph, but not beyond one of these.
_SCOPE = set("table td th caption object button svg dialog blockquote figure".split())
_KINDS = {"p": "p", "li": "t", "dd": "t", "dt": "t"}
_CLOSES = {"li": "li", "dt": "dd", "dd": "dt", "tr": "tr", "td": "td", "th": "th", "option": "option"}


def grow(rows: np.ndarray, labels: np.ndarray, depth: int = 12) -> tuple:
    """A binary decision tree: (feature, limit, tree up to the limit, tree above it), or a leaf (label,). Splits by Gini impurity."""
    if depth == 0 or labels.min() == labels.max():
        return (int(labels.mean() >= 0.5),)
    best = (np.inf, 0, 0.0)
    for f in range(rows.shape[1]):
        values = np.unique(rows[:, f])
        for limit in (values[1:] + values[:-1]) / 2:
            low = labels[rows[:, f] <= limit]
            high = labels[rows[:, f] > limit]
            impurity = sum(2 * len(x) * x.mean() * (1 - x.mean()) for x in (low, high))
            if impurity < best[0] - 1e-12:
                best = (impurity, f, float(limit))
    if best[0] == np.inf:
        return (int(labels.mean() >= 0.5),)
    _, f, limit = best
    low = rows[:, f] <= limit
    return f, limit, grow(rows[low], labels[low], depth - 1), grow(rows[~low], labels[~low], depth - 1)


def place_of(article: int, furniture: int, hinted: int, outside: int) -> int:
    """What a block's open elements say: -1 against it, 1 for it, 0 nothing."""
    return -1 if furniture or hinted or outside else int(article)


def rows_of(found: list[tuple]) -> list[tuple]:
    """FEATURES of each block of a page, from its words, link density and marks."""
    near = [(0, 0.0), *(x[:2] for x in found), (0, 0.0)]
    return [(*near[k + 1], *near[k], *near[k + 2], place_of(*x[2:6]), *x[6:]) for k, x in enumerate(found)]


def labelled(table: str = LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """FEATURES and labels of a table like LABELLED."""
    rows, labels = [], []
    for line in table.strip().splitlines():
        found = _SKETCH.findall(line)
        labels += [plus == "+" for plus, *_ in found]
        rows += rows_of([(int(n), int(linked or 0) / int(n), *(int(c in marks) for c in MARKS)) for _, n, linked, marks in found])
    return np.array(rows, float), np.array(labels, float)


def trained() -> tuple:
    """The tree asks first for the place, where that tells, and then for the counts; each part is grown from the labelled table."""
    rows, labels = labelled()
    place = rows[:, PLACE]
    part = lambda these: grow(rows[these], labels[these])
    return PLACE, -0.5, part(place < 0), (PLACE, 0.5, part(place == 0), part(place > 0))


def classify(tree: tuple, row: tuple) -> int:
    while len(tree) > 1:
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree[0]


def _names_furniture(value: str) -> bool:
    parts = _PARTS.findall(value)
    return not _SURE.isdisjoint(parts) or not _NAMES.isdisjoint(parts) and all(x in _NAMES or x in _FILLERS for x in parts)


def pieces(page: str) -> Iterator[tuple[int, int, str | None, bool, str]]:
    """What is markup: where it starts and ends, a tag's name, whether it closes, and its attributes. Comments and declarations have no name; raw text elements come whole, and so does a tag that the page's end cuts off.

    A tag ends at the first `>`; in tags of raw text elements not within quotes, as long as the page's quotes come in pairs."""
    at, size = 0, len(page)
    paired, last = True, page.rfind(">")
    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            found = page.find("-->", at + 4)
            end = found + 3 if found >= 0 else size
            yield at, end, None, False, ""
        elif page[at + 1 : at + 2] in ("!", "?"):
            end = page.find(">", at) + 1 if at < last else size
            yield at, end, None, False, ""
        elif page[at + 1 : at + 2] != "/" and not page[at + 1 : at + 2].isalpha():
            end = at + 1
        elif raw := _RAW_TAG.match(page, at):
            end, found = raw.end(), None
            if at < last:
                while paired and (found := _QUOTE.search(page, end)) and found[0] != ">":
                    end = page.find(found[0], found.end()) + 1
                    paired = end > 0
                end = found.end() if paired and found else 0
                paired = end > 0
                end = end or page.find(">", at) + 1
                found = _END_OF[raw[1].lower()].search(page, end)
                end = found.end() if found else size
                yield at, end, raw[1].lower(), False, ""
            else:
                end = _unended(page, at)
                if end == size:
                    yield at, end, None, False, ""
        elif tag := _TAG.match(page, at):
            found = _ANGLE.search(page, tag.end())
            end = found.start() if found else size
            if found and found[0] == ">":
                end += 1
                yield at, end, tag[2].lower(), bool(tag[1]), page[tag.end() : end - 1]
            elif not found:
                yield at, end, None, False, ""
        elif page[at + 1 : at + 2] == "/" and _unended(page, at) == size:
            end = size
            yield at, end, None, False, ""
        else:
            end = at + 1
        at = end


def _unended(page: str, at: int) -> int:
    """Where the next angle bracket after `at` stands, or the page's end."""
    found = _ANGLE.search(page, at + 1)
    return found.start() if found else len(page)


_END_OF = {name: re.compile(rf"</{name}\s*>", re.I) for name in _RAW.split("|")}
_RAW_NAMES = set(_END_OF)


class Open:
    """The open elements, innermost last; the depth of the innermost of a name is found at once."""

    def __init__(self) -> None:
        self.stack: list[tuple] = []  # the name first
        self.depths: dict[str, list[int]] = {}

    def push(self, entry: tuple) -> None:
        self.depths.setdefault(entry[0], []).append(len(self.stack))
        self.stack.append(entry)

    def innermost(self, name: str) -> int:
        found = self.depths.get(name)
        return found[-1] if found else -1

    def cut(self, depth: int) -> Iterator[tuple]:
        """Closes the elements from `depth` on, innermost first."""
        while len(self.stack) > depth:
            entry = self.stack.pop()
            self.depths[entry[0]].pop()
            yield entry

    def close(self, depth: int) -> None:
        for _ in self.cut(depth):
            pass


def _hint(name: str, attributes: str, holds: bool, inside: bool) -> tuple[bool, bool]:
    """Do the attributes name furniture, unless the element holds the text? Is the element hidden?"""
    hinted = hidden = False
    for key, value in _NAMED.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "role":
            hinted |= value in _ROLES
        elif key == "hidden" or key == "aria-hidden" and value == "true":
            hidden = True
        elif key == "style":
            hidden |= "display:none" in value.replace(" ", "")
        elif key in ("class", "id") and not holds and name not in ("html", "body", "article", "main"):
            hinted |= not (inside and name in _TEXT_TAGS) and any(map(_names_furniture, value.split()))
    return hinted, hidden


def layout(page: str) -> tuple[dict[int, int], set[int]]:
    """Where each head and each closed skipped element ends, by where it starts; and where the elements start that hold a main element or the longest article."""
    ends: dict[int, int] = {}
    holders: set[int] = set()
    parents: dict[int, int] = {}  # by where elements start; -1 for none
    longest, article = -1, -1
    open_ = Open()
    head, after, last, resume = -1, 0, "", 0
    stop: re.Match | None = None  # where the next thing stands that ends a head, while it is ahead
    stops = True

    def hold(start: int) -> None:
        while start >= 0 and start not in holders:
            holders.add(start)
            start = parents[start]

    def pop(depth: int, end: int) -> None:
        nonlocal longest, article
        for name, start in open_.cut(depth):
            if name == "article" and end - start >= longest:
                longest, article = end - start, start

    for start, end, name, close, attributes in pieces(page):
        if start < resume:
            continue
        name = name or ""
        if head >= 0:
            if last != "title" and page[after:start].strip():
                ends[head], head = after, -1
            elif close and name == "head":
                ends[head], head = end, -1
                continue
            elif name and not close and name not in _IN_HEAD:
                ends[head], head = start, -1
            else:
                after, last = end, name if not close else ""
                if name in ("noscript", "template") and not close:
                    if stops and (stop is None or stop.start() < after):
                        stop = _HEAD_END.search(page, after)
                        stops = stop is not None
                    if stop and (stop[1] or "").lower() == name:
                        resume = after = stop.end()
                continue
        if not name or name in _RAW_NAMES:
            continue
        if close:
            depth = open_.innermost(name)
            if depth >= 0:
                if name in _SKIPPED:
                    ends[open_.stack[depth][1]] = end
                pop(depth, start)
        elif name == "head":
            head, after, last = start, end, ""
        elif name not in _VOID and name != "p" and not attributes.endswith("/"):
            parents[start] = open_.stack[-1][1] if open_.stack else -1
            if name == "main":
                hold(parents[start])
            open_.push((name, start))
    if head >= 0:
        ends[head] = after if last != "title" and page[after:].strip() else len(page)
    pop(0, len(page))
    if article >= 0:
        hold(parents[article])
    return ends, holders


def blocks(page: str) -> list[tuple]:
    """Text, words, link density and marks (as in MARKS) of each block of the page that has text."""
    out: list[list] = []
    open_ = Open()  # name, how many open elements are article, furniture, hinted, links and hidden, and the kind of the innermost block
    nothing = (0, 0, 0, 0, 0, "")
    parts: list[str] = []
    linked = 0
    state = nothing

    def end_block() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                words = text.count(" ") + 1
                out.append([text, words, min(1.0, linked / words), int(state[0] > 0), int(state[1] > 0), int(state[2] > 0), 0, int(state[5] == "p"), int(state[5] == "t")])
            parts.clear()
        linked = 0

    def take(text: str) -> None:
        nonlocal linked
        if text and not state[4]:
            parts.append(text)
            if state[3]:
                linked += len(text.split())

    def now() -> tuple:
        return open_.stack[-1][1:] if open_.stack else nothing

    ends, holders = layout(page)
    at = 0
    quiet = -1  # how many elements were open where a skipped element began that has no end tag
    for start, end, name, close, attributes in pieces(page):
        if start < at:
            continue
        if quiet < 0:
            take(page[at:start])
        at = end
        if name is None or name in _RAW_NAMES and not close:
            if name:
                take(" ")
            continue
        if not close and start in ends:
            at = ends[start]
            end_block() if name == "head" else take(" ")
            continue
        if name in _SKIPPED:
            take(" ")
            if not close and not attributes.endswith("/"):
                quiet = len(open_.stack)
            continue
        if name == "br":
            take(" ")
            continue
        block = name in _BLOCK
        if block:
            end_block()
            quiet = -1
        if close:
            depth = open_.innermost(name)
            if depth >= 0:
                quiet = -1 if depth < quiet else quiet
                open_.close(depth)
                state = now()
            continue
        if name in _VOID:
            continue
        if block and (depth := open_.innermost("p")) >= 0 and all(open_.innermost(x) < depth for x in _SCOPE):
            open_.close(depth)
        if name in _CLOSES and open_.stack and open_.stack[-1][0] in (name, _CLOSES[name]):
            open_.close(len(open_.stack) - 1)
        state = now()
        a, f, h, links, hidden, kind = state
        hinted, hides = _hint(name, attributes, start in holders, a > 0) if attributes else (False, False)
        if not attributes.endswith("/"):
            furniture = name in _FURNITURE or name == "header" and not a
            state = (a + (name in _ARTICLE), f + furniture, h + hinted, links + (name == "a"), hidden + hides, _KINDS.get(name, "") if block else kind)
            open_.push((name, *state))
    if quiet < 0:
        take(page[at:])
    end_block()
    plain = [x for x in out if not x[4] and not x[5]]
    inside = sum(x[1] for x in plain if x[3])
    if inside and inside >= sum(x[1] for x in plain if not x[3]):  # the article is the page's text, what is plain beside it is not
        for x in out:
            x[6] = int(not x[3])
    return [tuple(x) for x in out]


def extract(page: str, tree: tuple) -> str:
    found = blocks(page)
    rows = rows_of([x[1:] for x in found])
    return "\n".join(x[0] for x, row in zip(found, rows, strict=True) if classify(tree, row))


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages(page_id, url, html), without a shuffle."""
    tree = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                texts = [extract(x.as_py() or "", tree) for x in part.column("html")]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return slim.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(spread(table(spark, sf_dir, "pages")))
