"""Main text of page observations: containers scored per page, paths voted per host, pages read by the winning paths."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stridemill.llm.batches import bound_batches
from stridemill.scale import BROADCAST_BYTES, checkpoint

PATHS_PER_HOST = 5

# fixed values: element names and the words that mark what is not the article
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINER = set("article body center details div main section table tbody td tr".split())
RAW = set("script style noscript template textarea title iframe svg math object noembed noframes xmp".split())
DROPPED = RAW | set("head nav header footer aside form button select option input menu dialog canvas audio video map datalist".split())
ROLES = set("navigation banner complementary contentinfo search dialog alertdialog alert form menu menubar toolbar".split())
CLUTTER = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navigation navbar menu menus "
    "breadcrumb breadcrumbs sidebar sidebars aside rail footer foot header masthead topbar comment comments commentlist reply replies "
    "disqus respond cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup share "
    "sharing social related recommended recommendations widget widgets toolbar pagination pager login search form".split()
)
# elements and attributes that mark clutter but may also wrap the whole article
MARKED = set("form header footer aside".split())
UNREAD = DROPPED - MARKED
BESIDE = set("header footer aside".split())
# how much a mark weighs against what only one side of it holds: the landmarks of an article
LANDMARK_FACTOR = 4
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
BONUS = {"article": 1.3, "main": 1.2}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?:(?P<attributes>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)|[^>]*)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b")
_DIGITS = re.compile(r"\d+")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass(slots=True)
class Node:
    tag: str
    path: int
    parent: int
    dropped: bool
    mark: int = 0  # innermost element at or above this one that is marked as clutter; 0 for none
    link: bool = False  # inside a link, a paragraph, however deep
    paragraph: bool = False
    value: float = 0.0
    every: float = 0.0


@dataclass
class Page:
    """Elements, text blocks, and the paths of the elements: a path is its parent's number and one more step."""

    nodes: list[Node] = field(default_factory=list)
    blocks: list[tuple[int, str]] = field(default_factory=list)
    paths: dict[tuple[int, str], int] = field(default_factory=dict)
    steps: list[tuple[int, str]] = field(default_factory=lambda: [(-1, "")])

    def path_below(self, parent: int, step: str) -> int:
        known = self.paths.setdefault((parent, step), len(self.steps))
        if known == len(self.steps):
            self.steps.append((parent, step))
        return known

    def spelled(self, path: int) -> str:
        """A path as text: its steps from the root, which hold no blanks."""
        out = []
        while path > 0:
            path, step = self.steps[path]
            out.append(step)
        return " ".join(reversed(out))

    def numbered(self, path: str) -> int | None:
        at: int | None = 0
        for step in path.split(" ") if path else ():
            at = self.paths.get((at, step))
            if at is None:
                return None
        return at


def _attributes(text: str | None) -> dict[str, str]:
    if not text or not text.strip():
        return {}
    out = {}
    for m in _ATTRIBUTE.finditer(text):
        name = (m[1] or m[5]).lower()
        out.setdefault(name, next((g for g in (m[2], m[3], m[4]) if g is not None), ""))
    return out


def _is_unread(tag: str, attributes: dict[str, str]) -> bool:
    if tag in ("html", "body"):
        return False
    if tag in UNREAD:
        return True
    if "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return True
    return "style" in attributes and re.search(r"display\s*:\s*none", attributes["style"]) is not None


def _is_clutter(tag: str, attributes: dict[str, str]) -> bool:
    if tag in ("html", "body"):
        return False
    if tag in MARKED or attributes.get("role", "").lower() in ROLES:
        return True
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}"
    return any(w.lower() in CLUTTER for w in _WORDS.findall(names))


# node, text, length in the source, length inside links
Piece = tuple[int, str, int, int]
# node, whether it is in a paragraph, pieces
Block = tuple[int, bool, list[Piece]]


def _wrappers(nodes: list[Node], read: list[Block]) -> set[int]:
    """The elements marked as clutter that wrap the article all the same.

    A mark is a penalty: what it holds is weighed, in unlinked text and in unlinked text of paragraphs, against the
    rest of the page, and it stays if it holds the greater part of either. An article, main or h1 on one side only
    makes that side count ``LANDMARK_FACTOR`` times; an element with the page's only landmarks, an article or main
    among them, always stays, and a header, footer or aside beside an article or main never does. The smallest are
    settled first, and what is dropped no longer counts for the rest; so comments, sidebars and adverts inside a
    wrapper are judged by themselves and the largest never falls to their sum.
    """
    # by mark: unlinked text, that of paragraphs, articles and mains, first headings
    held = {i: [0.0, 0.0, 0, 0] for i, node in enumerate(nodes) if i == 0 or node.mark == i}
    if len(held) == 1:
        return set()
    for _, paragraph, pieces in read:
        sums: dict[int, float] = {}
        for at, text, _, linked in pieces:
            mark = nodes[at].mark
            sums[mark] = sums.get(mark, 0.0) + len(text.strip()) - 2.0 * linked
        for mark, unlinked in sums.items():
            if unlinked > 0:
                held[mark][0] += unlinked
                if paragraph:
                    held[mark][1] += unlinked
    landmarks = {i: 2 if node.tag in BONUS else 3 for i, node in enumerate(nodes) if (node.tag in BONUS or node.tag == "h1") and not node.dropped and node.mark != i}
    for i, kind in landmarks.items():
        held[nodes[i].mark][kind] += 1
    above = {m: nodes[nodes[m].parent].mark for m in held if m}
    for m in sorted(above, reverse=True):
        held[above[m]] = [a + b for a, b in zip(held[above[m]], held[m], strict=True)]
    kept = set()
    for m in sorted(above, key=lambda m: (held[m][0], -m)):  # what lies inside comes first
        inside = held[m]
        text, paragraphs, articles, heads = inside
        if text:
            outside = [a - b for a, b in zip(held[0], inside, strict=True)]
            up = nodes[m].parent
            while up > 0:  # what holds the element as well is no rival
                if up in landmarks:
                    outside[landmarks[up]] -= 1
                up = nodes[up].parent
            mine, other = articles or heads, outside[2] or outside[3]
            factor = LANDMARK_FACTOR if mine and not other or articles and not outside[2] else 1 / LANDMARK_FACTOR if other and not mine else 1
            most = text * factor > outside[0] or paragraphs * factor > outside[1]
            beside = nodes[m].tag in BESIDE and outside[2] and not articles
            if articles and not other or most and not beside:
                kept.add(m)
                continue
        up = m
        while up:
            up = above[up]
            held[up] = [a - b for a, b in zip(held[up], inside, strict=True)]
    return kept


def _settle(page: Page, read: list[Block]) -> None:
    """Drops what is marked as clutter and no wrapper of the article, and joins the text blocks of the rest."""
    nodes = page.nodes
    kept = _wrappers(nodes, read)
    gone = {0: False}
    for i, node in enumerate(nodes):
        if node.mark == i and i:
            gone[i] = gone[nodes[node.parent].mark] or i not in kept
        if gone[node.mark]:
            node.dropped = True
    for at, _, pieces in read:
        stay = []
        for piece in pieces:
            if gone[nodes[piece[0]].mark]:
                nodes[piece[0]].every += piece[2]
            else:
                stay.append(piece)
        text = " ".join("".join([piece[1] for piece in stay]).split())
        if text:
            page.blocks.append((at, text))
            nodes[at].value += max(0.0, len(text) - 2.0 * sum([piece[3] for piece in stay]))
            nodes[at].every += len(text)


def parse(source: str) -> Page:
    """Elements and text blocks of a page, unclosed and stray tags included.

    A block is the text between two block-level tags; character references are decoded and white space,
    line breaks included, becomes one space. Text of dropped elements counts against its containers only,
    but headings in an article's own header stay. An element marked as clutter is dropped unless it wraps the
    article, which is decided once the whole page is read (``_settle``).
    """
    page = Page()
    nodes = page.nodes
    nodes.append(Node("html", 0, -1, False))
    stack = [0]
    opened: Counter[str] = Counter()
    read: list[Block] = []
    pieces: list[Piece] = []

    def flush() -> None:
        if pieces:
            read.append((stack[-1], nodes[stack[-1]].paragraph, pieces.copy()))
            pieces.clear()

    def spoken(raw: str) -> None:
        if not raw:
            return
        top = nodes[stack[-1]]
        if top.dropped:
            top.every += len(raw.strip())
            return
        text = entities.unescape(raw) if "&" in raw else raw
        linked = len(text.strip()) if top.link else 0
        pieces.append((stack[-1], text, len(raw.strip()), linked))

    def close_to(depth: int) -> None:
        opened.subtract(nodes[i].tag for i in stack[max(1, depth):])
        del stack[max(1, depth):]

    at = 0
    while True:
        m = _TOKEN.search(source, at)
        spoken(source[at : m.start()] if m else source[at:])
        if not m:
            break
        at = m.end()
        tag = (m["name"] or "").lower()
        if not tag:
            continue
        if tag == "br":
            if not nodes[stack[-1]].dropped:
                pieces.append((stack[-1], " ", 0, 0))
            continue
        if tag in BLOCK:
            flush()
        if m["end"]:
            if not opened[tag]:
                continue
            for depth in range(len(stack) - 1, 0, -1):
                if nodes[stack[depth]].tag == tag:
                    close_to(depth)
                    break
            continue
        if tag in VOID or tag == "html":
            continue
        if tag == "body" and opened["body"]:
            continue
        ends = opened["p"] > 0 or tag in HEADINGS | {"p"} and any(opened[h] for h in HEADINGS)
        if tag in BLOCK and ends:  # an open paragraph or heading ends, with what is open inside it
            for depth in range(len(stack) - 1, 0, -1):
                open_tag = nodes[stack[depth]].tag
                if open_tag == "p" or open_tag in HEADINGS and tag in HEADINGS | {"p"}:
                    close_to(depth)
                    break
                if open_tag in CONTAINER or open_tag in ("li", "blockquote", "ul", "ol"):
                    break
        if tag in CLOSES and any(opened[t] for t in CLOSES[tag]):
            for depth in range(len(stack) - 1, 0, -1):
                if nodes[stack[depth]].tag in CLOSES[tag]:
                    close_to(depth)
                    break
                if nodes[stack[depth]].tag in SCOPE[tag]:
                    break
        if tag == "body":
            close_to(1)
        attributes = _attributes(m["attributes"])
        if tag in RAW:
            if not (m["attributes"] or "").rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(source, at)
                at = end.end() if end else len(source) if tag in ("script", "style") else at
            continue
        up = nodes[stack[-1]]
        dropped = up.dropped or _is_unread(tag, attributes)
        mark = len(nodes) if not dropped and _is_clutter(tag, attributes) else up.mark
        if tag in HEADINGS and up.tag == "header" and any(nodes[i].tag in BONUS for i in stack):
            dropped = any(nodes[i].dropped for i in stack[:-1])
            mark = nodes[stack[-2]].mark
        names = ".".join(sorted(set(_DIGITS.sub("0", attributes.get("class", "")).split())))
        path = page.path_below(up.path, f"{tag}.{names}" if names else tag)
        nodes.append(Node(tag, path, stack[-1], dropped, mark, up.link or tag == "a", up.paragraph or tag == "p"))
        if not ((m["attributes"] or "").rstrip().endswith("/") and tag not in BLOCK):
            stack.append(len(nodes) - 1)
            opened[tag] += 1
    flush()
    _settle(page, read)
    for node in reversed(nodes[1:]):  # children come behind their parents
        nodes[node.parent].value += node.value
        nodes[node.parent].every += node.every
    return page


def best_path(page: Page) -> tuple[str, float] | None:
    """Path and vote of the page's best container: much own text, little of it links or dropped parts.

    The vote is the score over the page's own text, so that a long page has no more say than a short one.
    """
    best = None
    for node in page.nodes:
        if node.tag in CONTAINER and not node.dropped and node.value > 0:
            score = node.value * BONUS.get(node.tag, 1.0) * node.value / node.every
            if best is None or score >= best[1]:  # of equals the innermost, which holds the same text
                best = (node.path, score)
    return best and (page.spelled(best[0]), best[1] / page.nodes[0].value)


def text_at(page: Page, paths: list[str]) -> str:
    """Blocks inside the elements of the first path the page has text at, else inside its own best container, else all."""
    own = best_path(page)
    for path in [*paths, *([own[0]] if own else []), ""]:
        number = page.numbered(path)
        if number is None:
            continue
        inside: list[bool] = []
        for node in page.nodes:
            inside.append(node.path == number and not node.dropped or node.parent >= 0 and inside[node.parent])
        blocks = [text for at, text in page.blocks if inside[at]]
        if blocks:
            return "\n".join(blocks)
    return ""


def extract_text(steps: DataFrame, observation: str = "observation", url: str = "url", paths_per_host: int = PATHS_PER_HOST) -> DataFrame:
    """Adds ``text``, the main text of the HTML page in ``observation``, to ``steps`` (a column of that name is replaced).

    Every page votes, by its score, for the generalised tag-class path of its best container; votes are
    added up per host of ``url`` in Spark, and every page is read again at the first of its host's
    ``paths_per_host`` strongest paths that it has, or at its own best container if it has none. Pages without a
    host use their own. Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader
    comments are dropped; an element that is only named like one and wraps the article is not. A null or empty
    observation has an empty text. Each page is parsed in place and a hot host
    only adds to its partial sums; the table of winning paths is broadcast when its measured size is small, and
    joined by host, with adaptive skew handling, beyond that.
    """
    bound_batches(steps.sparkSession, 128)
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    hosted = steps.withColumn("_host", F.when(host != "", host))

    @F.pandas_udf("path string, score double")
    def voted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            votes = [best_path(parse(t)) if t else None for t in batch]
            yield pd.DataFrame({"path": [v[0] if v else None for v in votes], "score": [v[1] if v else None for v in votes]})

    votes = (
        hosted.filter("_host is not null").select("_host", voted(observation).alias("v")).select("_host", "v.*")
        .filter("path is not null").groupBy("_host", "path").agg(F.sum("score").alias("score"))
    )
    strongest = F.row_number().over(Window.partitionBy("_host").orderBy(F.desc("score"), "path"))
    winners = (
        votes.withColumn("_rank", strongest).filter(F.col("_rank") <= paths_per_host)
        .groupBy("_host").agg(F.array_sort(F.collect_list(F.struct("_rank", "path"))).alias("_ranked"))
        .select("_host", F.transform("_ranked", lambda x: x["path"]).alias("_paths"))
    )

    @F.pandas_udf("string")
    def read(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for pages, paths in batches:
            yield pd.Series([
                text_at(parse(t), [] if p is None else list(p)) if t else "" for t, p in zip(pages, paths, strict=True)
            ], dtype=object)

    stored = checkpoint(winners)
    length = F.aggregate("_paths", F.lit(64).cast("long"), lambda a, p: a + F.octet_length(p) + 32)
    size = stored.agg(F.sum(F.octet_length("_host") + length)).first()[0] or 0
    few = F.broadcast(stored) if size <= BROADCAST_BYTES else stored
    return hosted.join(few, "_host", "left").withColumn("text", read(observation, "_paths")).drop("_host", "_paths")
