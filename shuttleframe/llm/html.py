"""Main text of web pages by the maximum-scoring subsequence (operator 7).

A page is a sequence of words and tags. Every word scores a positive weight and every tag a negative one; the contiguous
run with the largest sum, found in one linear scan, is the content region, widened to the borders of the blocks that it
starts and ends in. Weights come from labelled pages: those whose article is marked up as such tell which tags stand inside
content and which outside, each tag told apart by whether an article stands around it and whether its block is mostly
links. A kind of tag has bounds in words, so that no list, link or table of an article outweighs its prose.

Elements that never hold article text (scripts, menus and the like, or so named) don't take part in the scan and are left out of
the region, and so do forms and parts with a second name, unless they hold nearly all of the page's words; blocks of the region are
its text.
"""

from __future__ import annotations

import heapq
import html
import math
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, texts

#: Labelled pages that weights are fitted on, at most, and the characters of a page that may count among them.
SAMPLE_PAGES = 400
SAMPLE_CHARS = 200_000

# Elements by role, and words that name page parts besides the article.
SKIPPED_TO_THE_END = ("script", "style", "textarea", "title")  # raw text: without an end tag, the rest of the page is theirs
RAW = (*SKIPPED_TO_THE_END, "noscript", "template", "iframe", "svg")
NEVER = frozenset(
    {*RAW, "head", "nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "object", "canvas", "audio", "video", "map"}
)
OUTSIDE = frozenset({"header"})  # left out unless it stands inside an article
ARTICLE = frozenset({"article", "main"})
BLOCKS = frozenset(
    "address article blockquote body center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 header hr html legend li main"
    " ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
OUTER = frozenset("article main body html header section div".split())
#: Elements that another block ends.
ENDED = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
PARTS = frozenset(
    "ad ads advert advertisement advertising advertorial adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice"
    " notices popup modal newsletter subscribe signup sidebar widget widgets related recommended recommendations share sharing social comment"
    " comments disqus respond reply replies breadcrumb breadcrumbs menu submenu navbar nav navigation pagination pager footer masthead toolbar"
    " complementary contentinfo search skip".split()
)
#: Words that may stand beside one of PARTS in a name; another one ("share-price") makes it a name of something else.
BESIDE = frozenset(
    "area articles aside bar block body bottom box button buttons bg btn card center col column container content count entry form foot footer group"
    " head header holder icons image inline inner item items js large layer left link links list main message mobile module more news no off on outer"
    " overlay page panel post posts primary right row secondary section site slot small static sticky story stories tags text thread to tool tools top"
    " unit user wrap wrapper zone".split()
)

#: Words that begin the name of a state ("no-sidebar", "has-menu"), not of a part.
STATES = frozenset("no not has is with without".split())
#: Parts that are never taken for the article, however long they are.
COMMENTS = frozenset("comment comments disqus respond reply replies".split())
#: Words that a form, or a part whose name has another side to it, must have to be kept as the page's main text, and how many times
#: what stands outside all parts.
MAIN_WORDS, MAIN_TIMES = 40, 4

# Quotes count after "=" only; a quoted value may hold "<" or ">" but not both, so that a quote that is never closed ends with
# its tag. A tag has 4096 runs and values at most, which bounds every attempt to read one.
TAG = regex.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)"
    r"(?P<attrs>(?:[^<>\"'=]++|=\s*(?:\"(?:[^\"<]*|[^\">]*)\"|'(?:[^'<]*|[^'>]*)')|[\"'=]){0,4096}+)>|<[!?/][^<>]*>",
    regex.S,
)
ATTR = regex.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", regex.I)
SUBWORDS = regex.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: Share of words in links from which a block counts as links.
LINKS = 0.75


@dataclass
class Weights:
    """Scores in words: a word is ``word``, a tag that of its feature, or that of its kind."""

    word: float = 1.0
    tags: dict[str, float] = field(default_factory=dict)

    def of(self, feature: str) -> float:
        low, high = bounds(feature)
        return max(low, min(high, self.tags.get(feature, (low + high) / 2))) * self.word


def bounds(feature: str) -> tuple[float, float]:
    """Least and greatest score of a tag, in words: markup inside a marked article says little, inline markup of prose hardly
    more, tags of blocks of links a lot, and an article's own tags the most."""
    name, _, links = feature.removeprefix("in:").partition(":")
    if name in ARTICLE:
        return -40.0, -5.0
    if feature.startswith("in:"):
        return -0.1, -0.02
    if links:
        return -5.0, -1.0
    if name in OUTER:
        return -3.0, -0.1
    return (-0.5, -0.1) if name in BLOCKS else (-0.2, -0.02)


Node = tuple[str, str, str]  # (kind: text, open, close; tag name or text; attributes)


def nodes(page: str) -> list[Node]:
    """Text, open and close nodes in order; comments, declarations and raw elements are gone.

    A raw element that closes itself, or one with markup inside and no end tag, is gone alone.
    """
    out, at, ended = [], 0, set()
    while m := TAG.search(page, at):
        if m.start() > at:
            out.append(("text", page[at : m.start()], ""))
        at = m.end()
        if not m["name"]:
            continue
        name = m["name"].lower()
        if name not in RAW:
            out.append(("close" if m["end"] else "open", name, m["attrs"] or ""))
        elif not m["end"] and not (m["attrs"] or "").endswith("/"):
            end = None if name in ended else _ends(name).search(page, at)
            if end:
                at = end.end()
            else:
                ended.add(name)
                if name in SKIPPED_TO_THE_END:
                    at = len(page)
    if at < len(page):
        out.append(("text", page[at:], ""))
    return out


@cache
def _ends(name: str):
    return regex.compile(rf"</{name}\b[^<>]*>", regex.I)


def pairs(seq: list[Node]) -> dict[int, int]:
    """Index of the last node of each element that isn't void: its end tag, or the node before the one that ends it.

    p, li and table cells end where the next of their kind, or the element around them, does; other elements without an end
    tag end at the next block, so that they never take the rest of the page.
    """
    out: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    within: list[int] = []  # places of the open blocks in the stack
    unclosed: list[int] = []
    deep: Counter[str] = Counter()

    def pop(last: int, closed: bool) -> None:
        name, i = stack.pop()
        deep[name] -= 1
        if name in BLOCKS:
            within.pop()
        if closed or name in ENDED:
            out[i] = last
        else:
            unclosed.append(i)

    for i, (kind, name, _) in enumerate(seq):
        if kind == "open" and name not in VOID:
            while name in BLOCKS and within and name in ENDED.get(stack[within[-1]][0], ()):
                for _ in range(len(stack) - within[-1]):
                    pop(i - 1, False)
            if name in BLOCKS:
                within.append(len(stack))
            stack.append((name, i))
            deep[name] += 1
        elif kind == "close" and deep[name]:
            while stack[-1][0] != name:
                pop(i - 1, False)
            pop(i, True)
    while stack:
        pop(len(seq) - 1, False)
    following, block = [len(seq)] * len(seq), len(seq)
    for i in range(len(seq) - 1, -1, -1):
        following[i] = block
        if seq[i][0] != "text" and seq[i][1] in BLOCKS:
            block = i
    for i in unclosed:
        out[i] = following[i] - 1
    return out


@cache
def _part(word: str) -> bool:
    """Whether a word names a part, alone or put together with another such word ("commentlist")."""
    return word in PARTS or any(word[:k] in PARTS and (word[k:] in BESIDE or word[k:] in PARTS) for k in range(2, len(word) - 1))


def named(attrs: str) -> set[str]:
    """Words of a class, id or role that name a part besides the article: all words of a name do, or stand beside one that does.
    With "" if another name of the element doesn't, so that it may be a part of another kind."""
    found, others = set(), False
    for values in ATTR.findall(attrs) if attrs else ():
        for token in "".join(values).split():
            words = [w.lower() for w in SUBWORDS.findall(token)]
            parts = {w for w in words if _part(w)}
            if words and words[0] not in STATES and parts and all(w in parts or w in BESIDE or w.isdigit() for w in words):
                found |= parts
            else:
                others = True
    return found | {""} if found and others else found


def main_parts(seq: list[Node], ends: dict[int, int], left: dict[int, bool]) -> set[int]:
    """Of the elements that would be left out (whether one may be kept, by its node) those that hold the page's main text.

    They are asked from the longest on, by words outside links: one is kept if it has MAIN_WORDS and MAIN_TIMES as many as stand
    outside all such elements so far; its other words are outside then, and the elements in it are asked, too.
    """
    upto, linked = [0], 0
    for kind, name, _ in seq:
        if kind != "text" and name == "a":
            linked = max(0, linked + (1 if kind == "open" else -1))
        upto.append(upto[-1] + (len(name.split()) if kind == "text" and not linked else 0))
    size = {i: upto[ends.get(i, i) + 1] - upto[i] for i in left}
    inner: dict[int, list[int]] = {-1: []}
    around: list[int] = []
    for i in sorted(left):
        while around and ends.get(around[-1], around[-1]) < i:
            around.pop()
        inner.setdefault(around[-1] if around else -1, []).append(i)
        around.append(i)
    own = lambda i, whole: whole - sum(size[k] for k in inner.get(i, ()))
    outside, kept = own(-1, upto[-1]), set()
    queue = [(-size[i], i) for i in inner[-1] if left[i]]
    heapq.heapify(queue)
    while queue:
        n, i = heapq.heappop(queue)
        if -n >= MAIN_WORDS and -n > MAIN_TIMES * outside:
            kept.add(i)
            outside += own(i, -n)
            for k in inner.get(i, ()):
                if left[k]:
                    heapq.heappush(queue, (-size[k], k))
    return kept


def live(seq: list[Node], ends: dict[int, int]) -> list[bool]:
    """Which nodes stand outside elements that never hold article text. What holds an article, a main part or a top heading isn't
    left out for its name, nor is a form, or what has another name as well, if it holds the page's main text."""
    out = [True] * len(seq)
    tops = [i for i, (kind, name, _) in enumerate(seq) if kind == "open" and (name in ARTICLE or name == "h1")]
    left: dict[int, bool] = {}
    for i, (kind, name, attrs) in enumerate(seq):
        if kind != "open" or name in ("body", "html", "main"):
            continue
        if name in NEVER or name in OUTSIDE:
            left[i] = name == "form"
        elif parts := named(attrs):
            after = bisect_right(tops, i)
            if not (after < len(tops) and tops[after] <= ends.get(i, i)):
                left[i] = "" in parts and not any(p in COMMENTS or any(p.startswith(x) for x in COMMENTS) for p in parts)
    kept = main_parts(seq, ends, left) if any(left.values()) else set()
    in_article, until = 0, -1
    for i, (kind, name, _) in enumerate(seq):
        if i <= until:
            out[i] = False
            continue
        if name in ARTICLE and kind != "text":
            in_article += 1 if kind == "open" else -1
        if i in left and i not in kept and not (name in OUTSIDE and in_article > 0 and not named(seq[i][2])):
            if name in ARTICLE:
                in_article -= 1
            until, out[i] = ends.get(i, i), False
    return out


def features(seq: list[Node], ok: list[bool]) -> list[str]:
    """The feature of each tag: its name, whether an article stands around it, and whether its block is mostly links."""
    n = len(seq)
    part, of_part, words, linked, depth = 0, [0] * n, [0], [0], 0
    for i, (kind, name, _) in enumerate(seq):
        if kind != "text" and name in BLOCKS:
            part += 1
            words.append(0)
            linked.append(0)
        of_part[i] = part
        if kind == "text":
            if ok[i]:
                k = len(name.split())
                words[part] += k
                linked[part] += k if depth > 0 else 0
        elif name == "a":
            depth = max(0, depth + (1 if kind == "open" else -1))
    full = [w > 0 for w in words]
    nxt, prv = [-1] * (part + 2), [-1] * (part + 2)
    for k in range(part, -1, -1):
        nxt[k] = k if full[k] else nxt[k + 1] if k < part else -1
    for k in range(part + 1):
        prv[k] = k if full[k] else prv[k - 1] if k else -1
    inside, out = 0, []
    for i, (kind, name, _) in enumerate(seq):
        if kind == "text":
            out.append("")
            continue
        if name in ARTICLE and ok[i] and kind == "close":
            inside = max(0, inside - 1)
        block = of_part[i]
        if name in BLOCKS:
            block = nxt[block] if kind == "open" else prv[block - 1] if block else -1
        dense = block >= 0 and words[block] > 0 and linked[block] >= LINKS * words[block]
        out.append(("in:" if inside else "") + name + (":links" if dense and not inside else ""))
        if name in ARTICLE and ok[i] and kind == "open":
            inside += 1
    return out


def region(scores: list[float], words: list[int]) -> tuple[int, int]:
    """First and last node of the maximum-scoring subsequence, which starts and ends with words; (0, -1) if no word scores."""
    best, low, high, run, start = 0.0, 0, -1, 0.0, 0
    for i, score in enumerate(scores):
        if words[i] and run <= 0:
            run, start = 0.0, i
        run += score
        if words[i] and run > best:
            best, low, high = run, start, i
    return low, high


def scored(seq: list[Node], ok: list[bool], weights: Weights) -> tuple[list[float], list[int]]:
    """Score and words of each node; what isn't live has neither."""
    words = [len(name.split()) if ok[i] and kind == "text" else 0 for i, (kind, name, _) in enumerate(seq)]
    tags = features(seq, ok)
    return [0.0 if not ok[i] else weights.word * words[i] if not f else weights.of(f) for i, f in enumerate(tags)], words


def widened(seq: list[Node], low: int, high: int) -> tuple[int, int]:
    """The region up to the borders of the blocks that it starts and ends in: no sentence is cut at inline markup."""
    while low > 0 and not (seq[low - 1][0] != "text" and seq[low - 1][1] in BLOCKS):
        low -= 1
    while 0 <= high < len(seq) - 1 and not (seq[high + 1][0] != "text" and seq[high + 1][1] in BLOCKS):
        high += 1
    return low, high


def blocks(seq: list[Node], ok: list[bool], low: int, high: int) -> list[str]:
    out, part = [], []
    for i in range(low, high + 1):
        kind, name, _ = seq[i]
        if kind == "text":
            if ok[i]:
                part.append(name)
        elif name in BLOCKS:
            if part:
                out.append("".join(part))
                part = []
        elif name == "br":
            part.append(" ")
    out.append("".join(part))
    return [t for b in out if (t := " ".join(html.unescape(b).split()))]


def extract(page: str, weights: Weights) -> str:
    """Main text of a page: blocks joined by an empty line; empty for an empty page or one without words."""
    seq = nodes(page)
    ok = live(seq, pairs(seq))
    low, high = region(*scored(seq, ok, weights))
    return "\n\n".join(blocks(seq, ok, *widened(seq, low, high))) if high >= low else ""


def fit(pages: list[str]) -> Weights:
    """Log odds of tags inside and outside the article, in those of a word, from pages that mark up exactly one."""
    inside, outside, used = Counter(), Counter(), 0
    for page in pages:
        seq = nodes(page)
        ends = pairs(seq)
        marked = [i for i, (kind, name, _) in enumerate(seq) if kind == "open" and name == "article" and seq[ends[i]][:2] == ("close", "article")]
        if len(marked) != 1:
            continue
        used += 1
        low, high = marked[0], ends[marked[0]]
        tags = features(seq, [True] * len(seq))
        for i, (kind, name, _) in enumerate(seq):
            to = inside if low < i < high else outside
            if kind == "text":
                to["#word"] += len(name.split())
            else:
                to[tags[i]] += 1
                if tags[i].startswith("in:"):  # pages without a marked article have these tags, too
                    to[tags[i].removeprefix("in:")] += 1
    if not used:
        return Weights()
    n1, n0 = sum(inside.values()) + 1, sum(outside.values()) + 1
    odds = {t: math.log((inside[t] + 0.5) / n1) - math.log((outside[t] + 0.5) / n0) for t in inside | outside}
    word = max(0.05, odds.pop("#word", 0.5))
    return Weights(1.0, {t: s / word for t, s in odds.items()})


def train(pages: DataFrame) -> Weights:
    """Fits on a sample by hash of SAMPLE_PAGES pages with one article at most."""
    has = pages.where(F.col("html").contains("<article") & (F.length("html") <= SAMPLE_CHARS)).select("html")
    rows = has.orderBy(F.xxhash64("html"), "html").limit(SAMPLE_PAGES).toLocalIterator()
    return fit([r["html"] for r in rows])


def main_text(pages: DataFrame, keep: list[str], weights: Weights) -> DataFrame:
    """``keep`` columns and text of every row; null and empty pages have an empty text, repeated rows equal ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, 200):
            out = [extract(t, weights) for t in texts(b, "html")]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keep))], pa.array(out, pa.string())], names=[*keep, "text"])

    kept = pages.select(*keep, F.coalesce("html", F.lit("")).alias("html"))
    types = dict(kept.dtypes)
    return kept.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in keep) + ", text string")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return main_text(pages, ["page_id", "url"], train(pages)).withColumn("n_chars", F.length("text").cast("long"))
