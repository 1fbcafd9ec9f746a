"""Main text of web pages: streaming parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clustering."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm.common import bounded_batches

# Fixed values of HTML: elements that begin a new line, that hold no readable text, that hold other blocks, that a head
# may hold, and what an open element's end tag may be left out before, up to an enclosing boundary.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split())
UNREAD = frozenset("audio button canvas datalist head iframe math noembed noframes noscript object option script select style svg template textarea title video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("article aside body details dialog div fieldset footer form header html main nav search section table td".split())
HEAD_ONLY = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
CLOSES_P = BLOCKS - frozenset("body caption dd dt frameset head html legend li summary tbody td tfoot th thead title tr".split())
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select", "datalist"}), "body": ({"head"}, {"html"})}
BOILERPLATE_TAGS = frozenset("aside dialog footer header legend label menu nav output progress meter search".split())
BOILERPLATE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog menu menubar navigation search toolbar".split())
#: Words of class and id. Those of the first kind mark boilerplate unless the element holds the article; those of the
#: second kind, which articles use too, only lower the ratio of an element's lines, and smoothing and clustering decide.
STRONG_NAMES = frozenset("ad ads advert adverts advertisement advertising breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notification pager pagination paywall popup promo promotion recommended replies share sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser toolbar widget notice banner related respond disclaimer".split())
WEAK_NAMES = frozenset("header discussion reply".split())
WEAK_SHARE = 0.25
_NAME = re.compile(r"[^a-z0-9]+")
_NEGATED = re.compile(r"\b(?:no|non|not|without|has|have|with|hide|is)[-_][a-z0-9]+(?:[-_](?:open|closed|on|off|enabled|disabled))?|\b[a-z0-9]+[-_](?:open|closed|on|off|enabled|disabled|allowed)\b")


@dataclass
class Box:
    """An element that holds lines, with what it says of itself and whether an article, main or form control stands in it."""

    tag: str
    up: "Box | None"
    named: str = ""
    aside: bool = False
    unread: bool = False
    holds: bool = False
    content: bool = False
    chars: int = 0


@dataclass
class Line:
    text: str
    tags: int
    linked: int
    box: Box
    region: object = None
    boilerplate: bool = False
    weak: bool = False


@dataclass
class _State:
    pieces: list[str] = field(default_factory=list)
    tags: int = 0
    linked: int = 0


class LineParser(HTMLParser):
    """Cuts a page into lines, one a block, each with its tags, its linked characters and the box it stands in.

    End tags that HTML lets one leave out are implied, so an unclosed paragraph, item, cell or head holds no more than
    it does in a browser.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.stack = [Box("", None)]
        self.linked = False
        self.now = _State()

    def end_line(self) -> None:
        text = " ".join("".join(self.now.pieces).split())
        if text:
            self.lines.append(Line(text, self.now.tags, self.now.linked, self.stack[-1]))
        self.now = _State()

    def close_to(self, tags: set | frozenset, bounds: set | frozenset) -> None:
        """Close the outermost open element of ``tags`` within the nearest of ``bounds``, and all in it."""
        at = None
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag in bounds:
                break
            if self.stack[k].tag in tags:
                at = k
        if at is not None:
            self.end_line()
            del self.stack[at:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in HEAD_ONLY and tag != "head" and self.stack[-1].tag == "head":
            self.close_to({"head"}, frozenset())
        if tag in CLOSES_P:
            self.close_to({"p"}, CONTAINERS | {"button", "object"})
        if tag in SIBLINGS:
            self.close_to(*SIBLINGS[tag])
        if tag in BLOCKS:
            self.end_line()
        if tag == "br":
            self.now.pieces.append(" ")
        self.now.tags += 1
        if tag == "a":
            self.linked = True
        if tag in VOID or not (tag in BLOCKS or tag in UNREAD or tag in BOILERPLATE_TAGS):
            return
        box = Box(tag, self.stack[-1])
        said = {k: (v or "").lower() for k, v in attrs}
        role = said.get("role", "")
        if tag not in ("html", "body", "main", "article"):
            words = set(_NAME.split(_NEGATED.sub(" ", f"{said.get('class', '')} {said.get('id', '')}")))
            box.named = "strong" if words & STRONG_NAMES else "weak" if words & WEAK_NAMES and tag not in ("h1", "h2", "h3", "h4", "h5", "h6") else ""
        box.aside = tag in BOILERPLATE_TAGS or role in BOILERPLATE_ROLES
        box.unread = self.stack[-1].unread or tag in UNREAD or "hidden" in said or said.get("aria-hidden") == "true" or "display:none" in said.get("style", "").replace(" ", "")
        box.content = not box.unread and (tag in ("article", "main") or role in ("article", "main"))
        if box.content or tag == "body":
            for up in self.stack:
                up.holds = True
        self.stack.append(box)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        # outside foreign content a browser takes <div/> as <div>
        self.handle_starttag(tag, attrs)
        if tag in UNREAD:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.end_line()
        if tag == "a":
            self.linked = False
        self.now.tags += 1
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == tag:
                self.end_line()
                self.linked = False
                del self.stack[k:]
                break
            if tag not in CONTAINERS and self.stack[k].tag in CONTAINERS and tag not in ("ul", "ol", "dl", "head"):
                break

    def handle_data(self, data: str) -> None:
        if self.stack[-1].tag == "head" and data.strip():
            self.close_to({"head"}, frozenset())
        if self.stack[-1].unread:
            return
        self.now.pieces.append(data)
        if self.linked:
            self.now.linked += len(data.strip())


def placed(lines: list[Line]) -> set[int]:
    """Give each line its region and whether it is boilerplate; the regions that are articles.

    A region is what one container holds, or a whole article or main element. Names, tags and roles mark boilerplate
    unless the element holds an article or main element; a form is boilerplate unless it holds one or half of
    the page's characters. An element with a weak name is a region of its own.
    """
    total = sum(len(x.text) for x in lines)
    for line in lines:
        box = line.box
        while box is not None:
            box.chars += len(line.text)
            box = box.up
    known: dict[int, tuple[bool, int, bool, bool]] = {}
    articles: set[int] = set()

    def of(box: Box) -> tuple[bool, int, bool, bool]:
        """boilerplate, region, in an article, weak."""
        trail = []
        while id(box) not in known and box.up is not None:
            trail.append(box)
            box = box.up
        got = known.get(id(box), (False, 0, False, False))
        for box in reversed(trail):
            bad, region, article, weak = got
            if not box.holds:
                bad |= box.named == "strong" or box.aside and not (box.tag == "header" and article)
                bad |= box.tag == "form" and 2 * box.chars < total
            if box.content and not bad and not article:
                article, region = True, id(box)
                articles.add(region)
            elif box.named == "weak" and not box.holds and box.tag in CONTAINERS:
                region, weak = id(box), True
                if article:
                    articles.add(region)
            elif box.tag in CONTAINERS and not article:
                region = id(box)
            got = known[id(box)] = bad, region, article, weak
        return got

    for line in lines:
        line.boilerplate, line.region, _, line.weak = of(line.box)
    return articles


def smoothed_ratios(lines: list[Line], sigma: float) -> np.ndarray:
    """Characters a tag in each line, without linked ones, nought in boilerplate; smoothed by a Gaussian."""
    raw = np.array([0.0 if x.boilerplate else (WEAK_SHARE if x.weak else 1.0) * max(0, len(x.text) - x.linked) / max(1, x.tags) for x in lines])
    radius = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(raw)), kernel, "same") if len(raw) > 2 * radius else None
    if weight is None:
        offsets = np.arange(len(raw))
        full = np.exp(-0.5 * ((offsets[:, None] - offsets[None, :]) / sigma) ** 2)
        return full @ raw / full.sum(axis=1)
    return np.convolve(raw, kernel, "same") / weight


def main_text(html: str | None, sigma: float = 1.0) -> str:
    """The page's main text: the blocks of the regions whose smoothed ratio reaches the threshold, joined by blank lines.

    The threshold is the standard deviation of the smoothed ratios. A region (``placed``) is
    taken whole, so short blocks between long ones stay. Where an article or main element reaches it, other regions go.
    Null, empty and text-free pages give the empty string.
    """
    if not html:
        return ""
    parser = LineParser()
    parser.feed(html)
    parser.close()
    parser.end_line()
    lines = parser.lines
    if not lines:
        return ""
    articles = placed(lines)
    ratios = smoothed_ratios(lines, sigma)
    threshold = ratios.std()
    best: dict[object, float] = {}
    chars: dict[object, int] = {}
    linked: dict[object, int] = {}
    for line, ratio in zip(lines, ratios):
        if not line.boilerplate:
            best[line.region] = max(best.get(line.region, 0.0), ratio)
            chars[line.region] = chars.get(line.region, 0) + len(line.text)
            linked[line.region] = linked.get(line.region, 0) + line.linked
    chosen = {r for r, ratio in best.items() if ratio >= threshold and 2 * linked[r] <= chars[r]}
    if chosen & articles:
        chosen &= articles
    return "\n\n".join(x.text for x in lines if x.region in chosen and not x.boilerplate)


def extracted_pages(pages: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default page_id, url) and ``text``, the main text of each row's whole HTML.

    Narrow: one pass over the rows, no shuffle, one page at a time in a worker. A null or empty page gives an empty
    text; repeated rows give repeated results; columns not kept don't matter, whatever their names.
    """
    keep = ["page_id", "url"] if keep is None else keep
    bounded_batches(pages.sparkSession)
    rows = pages.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{html}`").alias("h"))
    schema = ", ".join([*(f"k{i} {rows.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keep))), "text string"])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string())], names=[*(f"k{i}" for i in range(len(keep))), "text"])

    return rows.mapInArrow(extract, schema).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "text")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all ``pages``."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extracted_pages(pages).withColumn("n_chars", F.char_length("text").cast("long"))
