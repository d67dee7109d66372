"""Operator 7: main text of web pages by the maximum-scoring subsequence.

A page becomes a sequence of words and tags. Words score positive and tags negative, and a
linear scan finds the contiguous run with the largest sum: the content region. It is rounded up to the
innermost element that holds it, unless that is the body, and else to whole blocks.

Weights come from labelled pages: those that mark their content with one <article>, or else one
<main>. In scoring the mark is no input but for its two tags, which have a weight like any tag: as they never
stand within the content, learning makes a run that goes past them dear. Without them the marked element
counts as a <div>. A feature is a tag's name or a word of its class or id, and
its evidence is the log ratio of its elements inside and outside the marked one; outside, only outermost
elements count, so that a list in a menu says nothing against lists. An element's evidence e is the least of its
features', its start and end tag score log P(inside) = -log(1 + exp(-e)) each, and the score of a word is the one
of WORD_SCORES whose best runs agree most with the marked elements. An element with e under CUT (but no <article> or <main>) is cut out: its
words score nothing and are not in the text, wherever it stands.

For kinds of elements that the labelled pages lack, lists of common names (menus, footers, adverts,
notices, forms, sharing, reader comments) count as PRIOR elements seen outside; within a marked element they
label what is not content. The header of an article, main or section is no header of the page. Scripts, styles and other raw elements hold no text.

Character references are decoded, white space inside a block becomes one space, blocks are
trimmed, empty ones dropped, and the rest joined in page order by one newline. Null, empty and
wordless pages give an empty text; of equal runs the first and shortest is taken. Repeated rows give repeated
results. Unclosed elements end with the block or element around them. Every step is linear in the page.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from math import exp, log, log1p

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm.common import arrow_map
from pointloom.session import table

#: Labelled pages that weights are learned from, in expectation.
MAX_LABELLED = 2000
#: Elements seen outside that a listed name counts for; evidence under which an element is cut out.
PRIOR, CUT = 30, -3.0
#: Scores of a word that are tried, and the labelled pages that they are tried on.
WORD_SCORES, MAX_SEARCHED = tuple(2.0**k for k in range(-4, 5)), 256
# No alternative but a comment or CDATA section runs past the next "<", so scanning is linear.
_TOKEN = re.compile(r"<!--(?:.*?-->|.*\Z)|<!\[CDATA\[(?:.*?\]\]>|.*\Z)|<[!?][^<>]*+>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"<]*+\"|'[^'<]*+')*+)/?>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*+)>", re.S)
_MARK = re.compile(r"<(article|main)\b", re.I)
_ATTRIBUTE = re.compile(r"""(class|id|role|aria-hidden|hidden|style|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[a-z0-9]+")
_EMPTY = re.compile(r"(?:^|[\s\"'])/\Z")
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "canvas", "xmp"}
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_NEVER = {"nav", "aside", "form", "header", "footer", "button", "select", "dialog", "menu", "input", "label", "fieldset"}
#: A header in one of these belongs to it and not to the page.
_PARTS = ("article", "main", "section")
_MARKS = ("article", "main")
_FRAME = {"html", "head", "body"}
_HINT = re.compile(
    r"(?:ad|ads|advert\w*|adverts?|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|notices|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|comments?|commentlist|respond|replies|reply|disqus|discussion|sidebar|side-bar|widget\w*|related|recommended|share|sharing|social|breadcrumbs?|navigation|navbar|nav|menu|footer|toolbar|pagination|pager|skip-link|masthead|site-header|page-header|topbar|outbrain|taboola|toc|tags|byline-links)",
    re.I,
)
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar", "toolbar"}
#: Raw elements whose text is never content, even if their end tag is missing; "/>" does not end them.
_CODE = {"script", "style"}
#: Elements that a start tag of the same kind ends.
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, **dict.fromkeys(("tbody", "thead", "tfoot"), {"tbody", "thead", "tfoot", "tr", "td", "th"}), "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


def features(name: str, attributes: str) -> list[str]:
    """What is known of an element: its name, words of class and id (after "."), role and hiding (after "@")."""
    out = [name]
    if attributes:
        for key, value in _ATTRIBUTE.findall(attributes):
            value, key = value.strip("\"'").strip().lower(), key.lower()
            if key in ("class", "id"):
                out += {"." + x for token in value.split() for x in (token, *_WORD.findall(token))}
            elif key == "role":
                out.append("@" + value)
            elif key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
                out.append("@hidden")
        if "hidden" in attributes and re.search(r"(?:^|\s)hidden(?:\s|$)", re.sub(r"\"[^\"]*\"|'[^']*'", "", attributes)):
            out.append("@hidden")
    return out


@lru_cache(1 << 14)
def listed(feature: str) -> bool:
    """Whether a feature is in the lists of names that seldom hold content."""
    if feature[0] == ".":
        return _HINT.fullmatch(feature, 1) is not None
    return feature in _NEVER or feature == "@hidden" or feature[0] == "@" and feature[1:] in _ROLES


def logodds(inside: int, outside: int) -> float:
    return log((inside + 0.5) / (outside + 0.5))


def evidence(weights: dict[str, float], own: list[str]) -> float:
    """The least evidence of the known features; none is no evidence."""
    known = [weights[x] if x in weights else logodds(0, PRIOR) for x in own if x in weights or listed(x)]
    return min(known, default=0.0)


def marked_by(html: str) -> str:
    """The element that marks the content: article if there is just one, else main, else none."""
    seen = Counter(x.lower() for x in _MARK.findall(html))
    return next((x for x in ("article", "main") if seen[x] == 1), "")


def tokens(html: str, weights: dict[str, float], mark: str = "") -> Iterator[tuple[str, str, float, bool, list[str] | bool]]:
    """(kind, text or tag name, evidence, cut out, features); kind: text, open, close. Every element that is no void one is closed.

    Of the element named `mark`, the last part is True instead of features.
    """
    stack: list[tuple[str, float, bool, list[str] | bool]] = []  # name, evidence, cut out, features
    bad = at = 0
    opened: Counter = Counter()  # names on the stack
    endless: set[str] = set()  # raw elements without another end tag
    known: dict[tuple[str, str], tuple[float, list[str]]] = {}

    def pop() -> tuple[str, str, float, bool, list[str] | bool]:
        nonlocal bad
        name, e, cut, own = stack.pop()
        opened[name] -= 1
        bad -= cut
        return "close", name, e, bad > 0, own

    while True:
        m = _TOKEN.search(html, at)
        stop = m.start() if m else len(html)
        if stop > at:
            yield "text", html[at:stop], 0.0, bad > 0, False
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            if opened[name]:
                while stack[-1][0] != name:
                    yield pop()
                yield pop()
            continue
        attributes = m[3] or m[6] or ""
        if name in _RAW:
            if name not in _CODE and _EMPTY.search(attributes):
                continue
            end = None if name in endless else re.compile(rf"</{name}\s*>", re.I).search(html, at)
            if end:
                at = end.end()
            elif name in _CODE:
                at = len(html)
            else:
                endless.add(name)
            continue
        if stack and name in _BLOCK:
            while stack and stack[-1][0] in ("p", "b", "i", "em", "strong", "span", "a", "font", "u") and (stack[-1][0] == "p" or name in ("p", "div", "section", "article", "ul", "ol", "table")):
                if stack[-1][2]:
                    break
                yield pop()
        while stack and stack[-1][0] in _CLOSES.get(name, ()):
            yield pop()
        kind = "title of a part" if name == "header" and any(opened[x] for x in _PARTS) else name
        if (kind, attributes) not in known:
            own = [] if name in _FRAME else [name] if name in _MARKS else features(kind, attributes)
            known[kind, attributes] = evidence(weights, own), own
        e, own = known[kind, attributes]
        yield "open", name, e, bad > 0, True if name == mark else own
        if name not in _VOID:
            cut = e < CUT and name not in _MARKS
            stack.append((name, e, cut, True if name == mark else own))
            opened[name] += 1
            bad += cut
            if attributes.endswith("/"):
                yield pop()
    while stack:
        yield pop()


def learn(pages: list[str]) -> dict[str, float]:
    """Evidence of each feature and the score of a word (key ""), from pages that mark their content once."""
    inside, outside = Counter(), Counter()
    for html in pages:
        if not (mark := marked_by(html)):
            continue
        path: list[list] = []  # features, whether the mark is within, features of the outermost elements in it
        in_mark, own_in, own_out = 0, Counter(), Counter()

        def leave() -> None:
            own, holds, below = path.pop()
            # An element without the mark stands for all that is in it; one with it for nothing.
            for x in below if holds else [own]:
                (path[-1][2] if path else loose).append(x)

        loose: list[list[str]] = []
        for kind, x, e, cut, own in tokens(html, {}, mark):
            if kind == "text":
                continue
            if own is True:
                in_mark += 1 if kind == "open" else -1
                for above in path if kind == "open" else ():
                    above[1] = True
            elif in_mark:
                if kind == "open" and not cut:
                    (own_in if e >= CUT else own_out).update(own)
            elif kind == "open":
                if x not in _VOID:
                    path.append([own, False, []])
            elif path:
                leave()
        while path:
            leave()
        for own in loose:
            own_out.update(own)
        own_in["div"] += 1  # the marked element, had it no mark
        own_out[mark] += 1  # its tags never stand within the content
        inside.update(own_in)
        outside.update(own_out)
    out = {x: logodds(inside[x], outside[x] + PRIOR * listed(x)) for x in {*inside, *outside} if inside[x] + outside[x] > 1}
    out[""] = word_score(pages[:MAX_SEARCHED], out)
    return out


def word_score(pages: list[str], weights: dict[str, float]) -> float:
    """The score of a word with which the best runs agree most with what labelled pages mark; the middle one of equally good ones."""
    agree = [0.0] * len(WORD_SCORES)
    for html in pages:
        if not (mark := marked_by(html)):
            continue
        sizes, costs, within, in_mark = [], [], [], 0
        for kind, x, e, cut, own in tokens(html, weights, mark):
            if own is True:
                in_mark += 1 if kind == "open" else -1
            if not cut:
                sizes.append(len(x.split()) if kind == "text" else 0)
                costs.append(0.0 if kind == "text" else -log1p(exp(-e)))
                within.append(sizes[-1] if in_mark else 0)
        for k, word in enumerate(WORD_SCORES):
            begin, end = region([word * n + c for n, c in zip(sizes, costs)])
            shared = sum(within[begin:end])
            agree[k] += shared / max(sum(sizes[begin:end]) + sum(within) - shared, 1)
    good = [x for x, n in zip(WORD_SCORES, agree) if n >= max(agree) - 1e-9]
    return good[(len(good) - 1) // 2]


def region(scores: list[float]) -> tuple[int, int]:
    """The contiguous run with the largest sum; the first and shortest of equal ones."""
    best, begin, end, total, start = 0.0, 0, 0, 0.0, 0
    for k, x in enumerate(scores):
        if total <= 0:
            total, start = 0.0, k
        total += x
        if total > best:
            best, begin, end = total, start, k + 1
    return begin, end


def extract(html: str | None, weights: dict[str, float]) -> str:
    """Blocks of the content region, joined by newlines."""
    blocks: list[list[str]] = [[]]
    scores, place, owner = [], [], []  # of each token; owner: the element that it lies in
    above, span, frame = [-1], [[0, 0]], [True]  # of each element: the one around it, its tokens, whether it is the page
    now = 0
    word = weights.get("", 1.0)
    for kind, x, e, cut, _ in tokens(html or "", weights):
        if cut:
            continue
        if kind == "text":
            blocks[-1].append(x)
            scores.append(word * len(x.split()))
        else:
            if x in _BLOCK:
                blocks.append([])
            elif x == "br":
                blocks[-1].append(" ")
            scores.append(-log1p(exp(-e)))
            if kind == "open" and x not in _VOID:
                above.append(now)
                span.append([len(scores), len(scores)])
                frame.append(x in _FRAME)
                now = len(above) - 1
            elif kind == "close":
                span[now][1] = len(scores) - 1
                now = above[now]
        place.append(len(blocks) - 1)
        owner.append(now)
    span[0][1] = len(scores)
    begin, end = region(scores)
    if begin == end:
        return ""
    # The run is rounded up to the element that holds it: what it ends short of is a few words after something cut out.
    at = owner[begin]
    while span[at][1] < end:
        at = above[at]
    if not frame[at]:
        begin, end = span[at]
    chosen = blocks[place[begin] : place[end - 1] + 1]
    lines = (_SPACE.sub(" ", unescape("".join(x))).strip() for x in chosen)
    return "\n".join(x for x in lines if x)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",), max_labelled: int = MAX_LABELLED) -> DataFrame:
    """id, kept columns, text, n_chars. Weights come from max_labelled pages in expectation, drawn by hash (documented bound)."""
    n = pages.count()
    share = int(min(1.0, max_labelled / n) * (1 << 20)) + 1 if n else 1
    drawn = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.col(html_col)), F.lit(1 << 20)) < share
    sample = pages.where(drawn).where(f"`{html_col}` rlike '(?i)<(article|main)[ >]'").select(html_col)
    weights = learn([row[0] for row in sample.toLocalIterator()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [extract(x.as_py(), weights) for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=[id_col, *keep, "text", "n_chars"])

    kinds = ", ".join(f"`{x}` {pages.schema[x].dataType.simpleString()}" for x in (id_col, *keep))
    return arrow_map(pages, [id_col, *keep, html_col], run, f"{kinds}, text string, n_chars bigint")


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))
