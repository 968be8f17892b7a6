"""Main text of web pages: the contiguous region of tokens with the greatest sum of weights."""

from __future__ import annotations

import html
import json
import math
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts_of

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|select|svg|math|iframe|object|title)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>(?:.*?</(?P=raw)\s*>|.*\Z)"
    r"|<(?P<close>/)?(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"\b(?:class|id|role|aria-label|itemprop|data-role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"\bhidden\b(?!\s*=\s*[\"']?until)|display\s*:\s*none|visibility\s*:\s*hidden|aria-hidden\s*=\s*[\"']?true", re.I)
_WORDS = re.compile(r"[a-z]+|\d+")
_SPACE = re.compile(r"\s+")

#: Elements whose text is inline; all others begin and end a block. `br` is white space in a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br nobr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are never part of an article's text.
DROPPED = frozenset("head nav footer aside form button menu dialog fieldset".split())
#: Words in class, id or role that name such parts, as far as the labelled pages do not say otherwise.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright "
    "disqus footer form gdpr header login masthead menu menubar nav navbar navigation newsletter notice notices overlay pagination pager popup promo "
    "promoted related recommended respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget "
    "complementary contentinfo dialog alert".split()
)
#: Words beside them in a class that say nothing of what a part holds.
PLAIN = frozenset("area bar block box buttons container group inner items links list outer panel posts section slot unit wrap wrapper".split())
_P_CLOSERS = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_SELF_CLOSERS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}


@dataclass
class Block:
    """A run of text between block tags: its words, and the open parts around it."""

    text: str
    tags: list[str]  # tags since the block before, as features
    parts: int  # dropped parts that hold it
    inside: bool  # within article or main
    marks: tuple[str, ...] = ()  # words of class, id and role of the elements that hold it, if asked for


#: Log odds from which a word of a class names a part that is dropped, and those of NAMES and of other words without evidence.
NAMED, PRIOR = 2.0, 4.0


def odds(word: str, outside: int = 0, inside: int = 0) -> float:
    """Log odds that a class word is of a part outside the article, from blocks of labelled pages that it holds."""
    known = word in NAMES
    return math.log((outside + PRIOR * known + 0.5) / (inside + PRIOR * (not known) + 0.5))


def _classes(attrs: str) -> list[str]:
    """Names in class, id, role and the like, in lower case."""
    return [w for m in _ATTR.finditer(attrs) for w in (m[1] or m[2] or m[3] or "").lower().split()]


def _part(name: str, attrs: str, within: bool, named: dict[str, float]) -> str | None:
    """The kind of boilerplate that an element is, if any; a header within an article is its own.

    Within an article a class must name boilerplate with all of its words but plain ones: `ad-box`
    does, `entry-header` does not.
    """
    if name in DROPPED:
        return name
    if name == "header" and not within:
        return name
    if attrs:
        if "hid" in attrs.lower() or "display" in attrs.lower():
            if _HIDDEN.search(attrs):
                return "hidden"
        if name not in ("html", "body", "article", "main"):
            for k in _classes(attrs):
                words = _WORDS.findall(k)
                hit = [w for w in words if (named[w] if w in named else odds(w)) >= NAMED]
                if hit and (not within or all(w in hit or w in PLAIN or w.isdigit() for w in words)):
                    return hit[0]
    return None


def blocks(page: str, named: dict[str, float] | None = None, marked: bool = False) -> list[Block]:
    """The blocks of a page in order. Unclosed and stray tags are resolved as browsers do, roughly.

    The time is linear in the page: where a close tag's element is, and the nearest one that it may
    not cross, is known from the places of the open elements by name.
    """
    out: list[Block] = []
    stack: list[tuple[str, str | None, int]] = []  # name, part, number of marks
    opened: dict[str, list[int]] = {}  # places in the stack by name
    walls: list[int] = []  # places of the elements that no inline close tag crosses
    marks: list[str] = []
    tags: list[str] = []
    text: list[str] = []
    named = named or {}
    parts = within = 0

    def flush() -> None:
        nonlocal tags
        if text:
            whole = _SPACE.sub(" ", html.unescape("".join(text))).strip()
            text.clear()
            if whole:
                out.append(Block(whole, tags, parts, within > 0, tuple(marks) if marked else ()))
                tags = []

    def pop_to(k: int) -> None:
        nonlocal parts, within
        while len(stack) > k:
            name, part, n = stack.pop()
            opened[name].pop()
            if name in _P_CLOSERS:
                walls.pop()
            within -= name in ("article", "main")
            parts -= part is not None
            if n:
                del marks[-n:]

    def last(names) -> int:
        return max((opened[n][-1] for n in names if opened.get(n)), default=-1)

    def close(names, stop) -> None:
        at = last(names)
        if at >= 0 and at > last(stop):
            pop_to(at)

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        name = m["name"]
        if m["cdata"] is not None:
            text.append(m["cdata"].replace("&", "&amp;"))
            continue
        if not name:
            continue
        name = name.lower()
        if name == "br":
            text.append(" ")
            continue
        if name not in INLINE:
            flush()
            tags.append(("/" if m["close"] else "") + name)
        if m["close"]:
            k = last((name,))
            if k >= 0 and (name not in INLINE or k > (walls[-1] if walls else -1)):
                pop_to(k)
            continue
        if name in _P_CLOSERS:
            close(("p",), ("td", "th", "button", "object", "article", "div", "section", "li"))
        elif name in _SELF_CLOSERS:
            close((name, *(("dd", "dt") if name in ("dd", "dt") else ("td", "th") if name in ("td", "th", "tr") else ())), _SELF_CLOSERS[name])
        if name in VOID or m["attrs"].rstrip().endswith("/") and name not in INLINE and name not in _P_CLOSERS:
            continue
        part = _part(name, m["attrs"], within > 0, named)
        if part and name in INLINE:
            flush()
        own = [w for k in _classes(m["attrs"]) for w in _WORDS.findall(k)] if marked and m["attrs"] and name not in ("html", "body", "article", "main") else []
        marks += own
        opened.setdefault(name, []).append(len(stack))
        if name in _P_CLOSERS:
            walls.append(len(stack))
        stack.append((name, part, len(own)))
        within += name in ("article", "main")
        if part:
            parts += 1
            tags.append("#" + part)
    if at < len(page):
        text.append(page[at:])
    flush()
    return out


@dataclass
class Weights:
    """A word's weight, and what a tag between blocks, or a part around words, takes from it."""

    word: float = 1.0
    tags: dict[str, float] = field(default_factory=lambda: {"/article": -30.0, "/main": -30.0, "article": -6.0})
    other: float = -0.2
    part: float = -1.0
    named: dict[str, float] = field(default_factory=dict)  # log odds of class words that were seen

    def block(self, b: Block) -> tuple[float, float]:
        """Weights of the tags before a block and of its words; words in a part, which go anyway, have none."""
        words = b.text.count(" ") + 1
        gate = sum(self.tags.get(t, self.part if t[0] == "#" else self.other) for t in b.tags)
        return gate, 0.0 if b.parts else words * self.word


def region(found: list[Block], weights: Weights) -> tuple[int, int]:
    """First block and end of the contiguous run with the greatest sum; (0, 0) if none is positive.

    A run's first block enters without its tags; one linear scan; ties go to the earliest run.
    """
    best = run = 0.0
    first, ends = 0, (0, 0)
    for k, b in enumerate(found):
        gate, words = weights.block(b)
        if run + gate > 0:
            run += gate + words
        else:
            run, first = words, k
        if run > best:
            best, ends = run, (first, k + 1)
    return ends


def extract(page: str, weights: Weights) -> str:
    """The text of the best region: its blocks outside boilerplate parts, joined by two newlines."""
    found = blocks(page, weights.named)
    begin, end = region(found, weights)
    return "\n\n".join(b.text for b in found[begin:end] if not b.parts)


def fit(pages: DataFrame, rows: int = 400, rounds: int = 6) -> Weights:
    """Weights from pages that mark their article, by the averaged perceptron of regions.

    The fit uses at most `rows` whole pages, those of smallest hashed page_id, and of them the ones
    with an article or main element; words outside it are not content. The bound makes it independent
    of the size of the table. Executors parse the pages: the driver gets counts of the class words in
    and outside the articles, which say what words name boilerplate, and the tags and sizes of the
    blocks. Of repeated rows of a page_id the first html in order counts. Without such pages the
    weights are the starting ones.
    """
    ids = pages.filter("html is not null and page_id is not null").select("page_id").distinct().orderBy(F.xxhash64("page_id")).limit(rows)
    chosen = pages.select("page_id", "html").join(F.broadcast(ids), "page_id").groupBy("page_id").agg(F.min("html").alias("html"))

    def count(batches):
        for batch in batches:
            seen: dict[str, list[int]] = {}
            for page in texts_of(batch, "html"):
                found = blocks(page, marked=True)
                if any(b.inside and not b.parts for b in found):
                    for b in found:
                        for w in set(b.marks):
                            seen.setdefault(w, [0, 0])[b.inside] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([n[0] for n in seen.values()], pa.int64()), pa.array([n[1] for n in seen.values()], pa.int64())], ["word", "outside", "inside"])

    words = chosen.mapInArrow(count, "word string, outside long, inside long").groupBy("word").agg(F.sum("outside").alias("outside"), F.sum("inside").alias("inside"))
    named = {r["word"]: odds(r["word"], r["outside"], r["inside"]) for r in words.collect()}

    def parse(batches):
        for batch in batches:
            made = [[[" ".join("w" * (b.text.count(" ") + 1)), b.tags, b.parts, b.inside] for b in blocks(h, named)] for h in texts_of(batch, "html")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([json.dumps(x) for x in made], pa.string())], ["page_id", "blocks"])

    parsed = chosen.mapInArrow(parse, "page_id long, blocks string").orderBy("page_id").collect()
    sample = [[Block(*b) for b in json.loads(r["blocks"])] for r in parsed]
    sample = [s for s in sample if any(b.inside and not b.parts for b in s)]
    weights, total, steps = Weights(named=named), {}, 0

    for _ in range(rounds):
        wrong = 0
        for found in sample:
            true = [k for k, b in enumerate(found) if b.inside and not b.parts]
            want, got = (true[0], true[-1] + 1), region(found, weights)
            if want != got:
                wrong += 1
                for ends, sign in ((want, 1.0), (got, -1.0)):
                    for b in found[ends[0] + 1 : ends[1]]:
                        for t in b.tags:
                            start = weights.part if t[0] == "#" else weights.other
                            weights.tags[t] = min(0.0, weights.tags.get(t, start) + sign)
            steps += 1
            for t, w in weights.tags.items():
                total[t] = total.get(t, 0.0) + w
        if not wrong:
            break
    if steps and wrong:  # not separable: the average is steadier than the last
        weights.tags = {t: w / steps for t, w in total.items()}
    return weights


def main_text(pages: DataFrame, weights: Weights) -> DataFrame:
    """page_id, url and text of every page's main content, from the whole html.

    Null and empty pages, and pages without words, give the empty text; repeated rows give repeated
    results; an empty table an empty one; other columns are not read.
    """

    def run(batches):
        for batch in batches:
            text = [extract(h, weights) for h in texts_of(batch, "html")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string())], ["page_id", "url", "text"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string")
