"""Main text of web pages as a maximum-scoring run of tokens (operator 7).

A page becomes a row of tokens: words score above zero, tags below, with weights
learned from pages whose markup labels the main text, by element and by the words of
its class and id.  One scan finds the contiguous run with the largest sum.  Containers
that name themselves boilerplate count little in it and lose their text, unless they
hold the main text themselves.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_sample, slices

# Elements by how they are treated.
HIDDEN = frozenset("script style noscript template head title svg math iframe object audio video canvas select textarea button datalist".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter output progress q ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split())
BOILERPLATE = frozenset("nav footer header aside form dialog menu".split())
# Words of a class or id that mark boilerplate; words that go with them; words that turn them into something else.
MARKS = frozenset("ad ads advert advertisement advertising banner promo promotion sponsor sponsored sponsors sidebar nav navbar navigation menu breadcrumb breadcrumbs footer header masthead comment comments respond disqus reply replies cookie cookies consent notice notices notification popup modal overlay newsletter subscribe signup share sharing social related recommended widget toolbar pagination pager skip".split())
FILLERS = frozenset("area articles aside bar block bottom box buttons container content form global group icons inner item items left link links list main media page panel posts primary right rounded secondary section site slot stories thread top unit wrap wrapper".split())
OTHERWISE = frozenset("article entry has no post title with without".split())
# Marks, and elements, that are boilerplate even where they hold most of a page's words.
ALWAYS = frozenset("comment comments respond disqus reply replies nav navbar navigation menu footer".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
# Elements that an opening tag closes, as HTML has it.
CLOSES = {"p": frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_ATTR = re.compile(r"([^\s=/\"'>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?+")
_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
_PART = re.compile(r"[a-z]+")


def marks_of(value: str) -> tuple[set[str], str | None]:
    """The marks among the names of a class or id, and its first word.

    ``site-footer`` is a mark, as every part is a mark or goes with one; ``has-sidebar``,
    ``post-header`` and ``related-work`` are not.
    """
    found, first = set(), None
    for name in value.split():
        parts = _PART.findall(name)
        first = first or (parts[0] if parts else None)
        own = MARKS.intersection(parts)
        if own and not OTHERWISE.intersection(parts) and all(x in MARKS or x in FILLERS for x in parts):
            found |= own
    return found, first


class Tags:
    """The pieces of a page, in one pass: each is looked at a bounded number of times, whatever is left open."""

    def __init__(self, html: str):
        self.html, self.last, self.cdata, self.quotes = html, html.rfind(">"), True, True

    def next(self, at: int) -> tuple[int, int, tuple | None]:
        """Start, end and content of the next piece of markup: (closing, name, attributes), (text,) of CDATA or () of others."""
        html = self.html
        while True:
            at = html.find("<", at)
            if at < 0 or (at > self.last and not html.startswith("<!--", at)):
                return len(html), len(html), None
            if html.startswith("<!--", at):
                end = html.find("-->", at + 4)
                return at, len(html) if end < 0 else end + 3, ()
            if self.cdata and html.startswith("<![CDATA[", at):
                end = html.find("]]>", at)
                if end >= 0:
                    return at, end + 3, (html[at + 9 : end],)
                self.cdata = False
            if html[at + 1 : at + 2] in ("!", "?"):
                return at, html.find(">", at) + 1, ()
            name = _NAME.match(html, at)
            if name:
                rest = _REST.match(html, name.end()) if self.quotes else None
                if not rest:  # a quote is left open: from here on quotes are no help
                    self.quotes = False
                    end = html.find(">", name.end()) + 1
                else:
                    end = rest.end()
                return at, end, (name[1], name[2].lower(), html[name.end() : end - 1])
            at += 1


@dataclass
class Page:
    """A page's tokens: per token its kind, text (None for tags), and state."""

    kinds: list = field(default_factory=list)
    texts: list = field(default_factory=list)
    dropped: list = field(default_factory=list)  # inside a boilerplate container
    main: list = field(default_factory=list)  # inside the element that labels the main text
    labelled: bool = False


@dataclass
class _Open:
    """An element on the stack."""

    name: str
    kind: str
    box: int  # the innermost container marked as boilerplate, -1 for none
    main: bool
    hidden: bool
    link: bool
    article: bool


def parse(html: str | None) -> Page:
    """Tokens of a page: one per opening or closing tag and one per piece of visible text."""
    page, stack, at = Page(), [], 0
    html = html or ""
    tags, n_open = Tags(html), Counter()
    boxes: list[list] = []  # per marked container: the one around it, holds the main element, marked for good, words
    owner: list[int] = []
    top = _Open("", "", -1, False, False, False, False)

    def add(kind, text, box):
        page.kinds.append(kind)
        page.texts.append(text)
        page.main.append((stack[-1] if stack else top).main)
        owner.append(box)

    def close(k: int) -> None:
        for e in stack[k:]:
            n_open[e.name] -= 1
        del stack[k:]

    def text(piece: str) -> None:
        here = stack[-1] if stack else top
        if piece and not here.hidden:
            if here.box >= 0:
                boxes[here.box][3] += len(piece.split())
            add("w:a" if here.link else "w", piece, here.box)

    while at < len(html):
        start, end, found = tags.next(at)
        text(html[at:start])
        at = end
        if not found:
            continue
        if len(found) == 1:
            text(found[0].replace("&", "&amp;"))
            continue
        closing, name, attributes = found
        if closing:
            if n_open[name]:
                k = next(k for k in range(len(stack) - 1, -1, -1) if stack[k].name == name)
                own = stack[k]
                close(k + 1)
                add("/" + own.kind, None, own.box)
                close(k)
            continue
        while stack and stack[-1].name in CLOSES and name in CLOSES[stack[-1].name]:
            close(len(stack) - 1)
        if name in CLOSES["p"] and n_open["p"]:  # a block also ends inline elements left open in a paragraph
            k = next(k for k in range(len(stack) - 1, -1, -1) if stack[k].name == "p" or stack[k].name not in INLINE)
            if stack[k].name == "p":
                close(k)
        marks, role, hidden, prop, first = set(), "", False, "", None
        for key, x, y, z in _ATTR.findall(attributes):
            key = key.lower()
            if key in ("class", "id"):
                own, word = marks_of((x or y or z).lower())
                marks |= own
                first = first or word
            elif key == "role":
                role = (x or y or z).lower()
            elif key == "itemprop":
                prop = (x or y or z).lower()
            elif key == "hidden" or key == "aria-hidden" and (x or y or z).lower() == "true":
                hidden = True
        here = stack[-1] if stack else top
        if name in RAW:
            found = _END[name].search(html, at)
            at = found.end() if found else len(html)
            continue
        boiler = name in BOILERPLATE and not (name == "header" and here.article) or bool(marks) and name not in ("html", "body", "main", "article") or role in ROLES or hidden
        main = name in ("article", "main") or role in ("main", "article") or prop == "articlebody"
        if main and not boiler:
            page.labelled = True
            b = here.box
            while b >= 0 and not boxes[b][1]:
                boxes[b][1] = True
                b = boxes[b][0]
        box = here.box
        if boiler:
            boxes.append([here.box, False, hidden or name in ALWAYS or bool(marks & ALWAYS), 0])
            box = len(boxes) - 1
        kind = f"{name}#{first}" if first else name
        add(kind, None, box)
        if name not in VOID and not attributes.endswith("/"):
            stack.append(_Open(name, kind, box, here.main or main, here.hidden or name in HIDDEN, here.link or name == "a", here.article or name == "article"))
            n_open[name] += 1
    total = sum(len(t.split()) for t in page.texts if t is not None)
    for b in range(len(boxes) - 1, -1, -1):  # what is inside a container counts for those around it
        if boxes[b][0] >= 0:
            boxes[boxes[b][0]][3] += boxes[b][3]
    out: list[bool] = []
    for above, holds_main, for_good, words in boxes:
        alive = holds_main or not page.labelled and not for_good and 2 * words > total
        out.append(not alive or above >= 0 and out[above])
    page.dropped = [b >= 0 and out[b] for b in owner]
    page.kinds = [("w.x" if t is not None else f"{k.partition('#')[0]}.x") if d else k for k, t, d in zip(page.kinds, page.texts, page.dropped)]
    return page


#: Scores before anything is learned: words (plain, in links, in boilerplate) and tags.
WORD_PRIORS = {"w": 1.0, "w:a": 0.2, "w.x": 0.01}
_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 header hgroup br blockquote pre ul ol li dl dt dd table thead tbody tr td th figure figcaption hr section div article main".split())
#: The lowest score of a tag, and the tags seen that outweigh the prior.
LOWEST, STRENGTH = -3.0, 20


def prior(kind: str) -> float:
    """Score of a kind of token that no labelled page has shown."""
    if kind in WORD_PRIORS:
        return WORD_PRIORS[kind]
    name = kind.lstrip("/").partition("#")[0]
    if name.endswith(".x"):
        return -0.5
    return -0.05 if name in INLINE else -0.3 if name in _BLOCKS else -2.0


@dataclass(frozen=True)
class Weights:
    """Score per token kind; words above zero, tags below."""

    scores: dict = field(default_factory=dict)

    def of(self, kind: str, n: int | None) -> float:
        """Score of a tag (``n`` is None) or of a text of ``n`` words."""
        score = self.scores.get(kind)
        if score is None:
            kind = kind.partition("#")[0]
            score = self.scores.get(kind)
        if score is None:
            score = prior(kind)
        return score if n is None else score * n


def best_run(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run with the largest sum (the first such, none if all are below zero)."""
    best, run, start, found = 0.0, 0.0, 0, (0, 0)
    for k, s in enumerate(scores):
        if run <= 0:
            run, start = 0.0, k
        run += s
        if run > best:
            best, found = run, (start, k + 1)
    return found


def run_of(page: Page, weights: Weights) -> tuple[int, int]:
    return best_run([weights.of(k, len(t.split()) if t is not None else None) for k, t in zip(page.kinds, page.texts)])


def text_of(page: Page, run: tuple[int, int]) -> str:
    """The run's blocks in page order, joined by one space, white space collapsed."""
    out = []
    for k in range(*run):
        if page.texts[k] is None:
            if re.split("[.#]", page.kinds[k].lstrip("/"), maxsplit=1)[0] not in INLINE:
                out.append(" ")
        elif not page.dropped[k]:
            out.append(unescape(page.texts[k]))
    return " ".join("".join(out).split())


#: Bounds of the sample that weights are learned from: pages, characters of one page and of all, and passes over them.
SAMPLE, PAGE_CHARS, ALL_CHARS, PASSES = 400, 500_000, 40_000_000, 8


def learn(htmls: list[str], passes: int = PASSES) -> Weights:
    """Weights by a structured perceptron over pages whose markup labels the main text.

    Start: the log-odds of each tag inside against outside the main text.  Where the
    best run is not the labelled one, kinds of tokens that it wrongly has go down and
    those it lacks go up; words stay above zero and tags below.
    """
    from math import log

    pages = [p for p in map(parse, htmls) if p.labelled]
    inside, outside = {}, {}
    for p in pages:
        for kind, text, main in zip(p.kinds, p.texts, p.main):
            side = inside if main else outside
            for k in {kind, kind.partition("#")[0]}:
                side[k] = side.get(k, 0) + 1
    n_in, n_out = sum(inside.values()) + 1, sum(outside.values()) + 1
    scores = dict(WORD_PRIORS)
    for kind in sorted(inside.keys() | outside.keys(), key=lambda k: ("#" in k, k)):
        seen = inside.get(kind, 0) + outside.get(kind, 0)
        if kind not in WORD_PRIORS and ("#" not in kind or seen >= STRENGTH):
            odds = log((inside.get(kind, 0) + 0.5) / n_in) - log((outside.get(kind, 0) + 0.5) / n_out) - 0.3
            base = scores[kind.partition("#")[0]] if "#" in kind else prior(kind)
            score = (seen * odds + STRENGTH * base) / (seen + STRENGTH)
            scores[kind] = min(max(score, LOWEST), -0.05)
    for _ in range(passes):
        wrong = 0
        for p in pages:
            lo, hi = run_of(p, Weights(scores))
            for k, (kind, text, main) in enumerate(zip(p.kinds, p.texts, p.main)):
                if (got := lo <= k < hi) == main:
                    continue
                if text is None:
                    wrong += 1
                    kind = kind if kind in scores else kind.partition("#")[0]
                    scores[kind] = min(scores.get(kind, prior(kind)) + (-0.5 if got else 0.1), -0.01)
                elif text.strip():
                    wrong += 1
                    step = len(text.split()) * 0.01
                    scores[kind] = max(scores[kind] + (-step if got else step), 0.01)
        if not wrong:
            break
    return Weights(scores)


def train(pages: DataFrame, sample: int = SAMPLE) -> Weights:
    """Weights from the labelled pages among at most ``sample`` pages, those of least id hash.

    Of pages that share an id the least counts; pages of over ``PAGE_CHARS`` characters
    are not learned from, and in the order of the hash no more than ``ALL_CHARS`` in all.
    An empty table, or one without labelled pages, gives the priors.
    """
    ids = pages.select("page_id").where("page_id is not null and html is not null").where(F.length("html") <= PAGE_CHARS).distinct()
    picked = bounded_sample(ids, "page_id", sample)
    rows = pages.select("page_id", "html").where(F.length("html") <= PAGE_CHARS).join(F.broadcast(picked), "page_id").groupBy("page_id").agg(F.min("html").alias("html"))
    upto = Window.orderBy(F.xxhash64("page_id"), "page_id").rowsBetween(Window.unboundedPreceding, 0)  # over the sample
    rows = rows.withColumn("_chars", F.sum(F.length("html")).over(upto)).where(F.col("_chars") <= ALL_CHARS).collect()
    return learn([r.html for r in sorted(rows, key=lambda r: (r.page_id, r.html))])


def extract(pages: DataFrame, weights: Weights) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages`` (``page_id, url, html``).

    One pass without a shuffle, in time linear in the length of a page, however long.
    A null or empty page, or one without visible words, has the empty text; of runs that
    score alike the first counts; repeated rows give equal texts; an empty table gives
    an empty result; other columns, whatever their names, are ignored.
    """
    sent = pages.sparkSession.sparkContext.broadcast(weights)

    def rows(batches):
        own = sent.value
        for batch in slices(batches):
            texts = [text_of(p, run_of(p, own)) for p in map(parse, batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(rows, "page_id long, url string, text string, n_chars long")
