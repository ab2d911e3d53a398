"""Operator 9, HTML extraction: the maximum-scoring contiguous run of a page.

A page becomes units of text with the tags between them. Each word of a unit has the weight of the place where it
stands, each tag a negative weight, and one linear scan finds the contiguous run with the highest sum; its units of
positive weight are the main text. What scores negative between two positive units costs at most ``GAP`` words, so that
it does not end the run by its length alone; a part that is known to stand beside the content (an advert in the article)
costs nothing there, and neither do tags in an article, whose mark already counts.

The weights come from labelled pages, at most ``SAMPLE_PAGES`` with the least hash, of which the first ``SAMPLE_CHARS``
characters are read. Labels say nothing of names: a block is dense if it has ``DENSE`` words and few links, or if it
repeats the page's title; the contiguous run of blocks with the most dense words is the labelled content, with the blocks
of the same elements that follow it. A logistic
regression, held towards priors, learns what a word's place says: its innermost block element, the innermost element or
name around it that says something (article, nav, a class such as ``ad``), whether its block is mostly links and whether
it is long. Names that a sample shows to stand beside the content are learned with them. Tags get the log-odds of
standing outside the content.

Names lower a weight and never decide alone: only a whole class, id or role counts (``comments`` or ``comments-area``,
not ``comments-open``), and a name may stand on a wrapper of the content. That is decided for each wrapper, and only where
no article or main element outside named parts holds text: a wrapper is not heeded if it holds one article, longer than
what is left, or nearly all dense text of a page without articles; what is named inside it, or elsewhere, stays named. A
part with several articles is a list of them, and one with the name of reader comments never holds the content.

Text: character references decoded, white space inside a block one space, blocks in page order joined by one space.
Scripts, styles and comments are never text. An inline tag does not separate words, any other does.

Defined results: a null or empty page, and one without a positive word, give an empty text with 0 characters. Repeated
rows get equal results. An empty table gives an empty result. Other columns are ignored. Unclosed tags, quotes and
comments are tolerated; long pages are read whole, in time linear in their length.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import least_hashed, sliced

SAMPLE_PAGES, SAMPLE_CHARS = 256, 65_536
#: Words from which a block is dense, and the most that one block without them costs the labelled run.
DENSE, LOOSE = 25, 10
#: What the scan loses at most between two units of positive weight, in words.
GAP = 20.0
#: A named part holds the content if outside it stands less than one word in so many of its dense ones.
WRAPPED = 10
#: A name is learned from so many words on so many pages.
NAME_WORDS, NAME_PAGES = 50, 5

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|textarea)\b.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^<>]*>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^<>\"'])*+)>",
    re.S | re.I,
)
NAMED = re.compile(r"(?:^|[\s\"'/])(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Elements that stand inside a line of text; that have no end tag, and of those the ones inside a line.
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark math q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
IN_LINE_VOID = frozenset("br embed img input wbr".split())
#: Elements whose content is never text; what a head may hold.
HIDDEN = frozenset("button head iframe noscript object select svg template title".split())
HEAD = frozenset("base basefont link meta noscript script style template title".split())
#: Elements that hold the main part, and elements that stand beside it.
MAIN = frozenset(("article", "main"))
BESIDE = frozenset("aside dialog footer form header menu nav".split())
#: Fixed values, the prior of names: what a part beside the content is called, and words that add nothing to such a name.
NAMES = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disqus footer header login masthead menu modal"
    " nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted recommended related remark replies reply respond search share sharing sidebar signup social sponsor"
    " sponsored subscribe subscription teaser toolbar widget".split()
)
READERS = frozenset("comment commentlist comments disqus remark replies reply respond".split())
NAMES |= READERS
PLAIN = frozenset("area bar block body bottom box buttons container content form global group inner item items left links list main message module page panel primary right secondary section site slot strip thread top unit wrap wrapper".split())

#: Prior means of the regression by kind of feature, and how many words the labelled ones count as in all. What every place
#: and block says is held more firmly than what names, links and length say, as few pages show all kinds of blocks.
PRIOR = {"all": 0.5, "main": 3.0, "beside": -6.0, "linked": -3.0, "long": 2.0, "p": 1.0, "heading": 1.0}
PRECISION, FIRM, EVIDENCE = 0.25, 20.0, 2000


@dataclass
class Unit:
    """A stretch of text in one block and place, and the tags since the one before."""

    block: str
    mark: str
    tags: list[str]
    main: int = 0
    wrapper: int = 0
    texts: list[str] = field(default_factory=list)
    words: int = 0
    linked: int = 0

    @property
    def beside(self) -> bool:
        return self.mark[:1] == "." or self.mark in BESIDE

    @property
    def dense(self) -> bool:
        return self.words >= DENSE and 4 * self.linked <= self.words


@dataclass
class Wrappers:
    """The elements of a page that a name puts beside the content, numbered from 1: the one around each, and its name; and
    of each element of MAIN in or at one, the innermost around it, and itself or that one."""

    around: list[int] = field(default_factory=lambda: [0])
    names: list[str] = field(default_factory=lambda: [""])
    mains: dict[int, tuple[int, int]] = field(default_factory=dict)

    def chain(self, k: int) -> list[int]:
        out = []
        while k:
            out.append(k)
            k = self.around[k]
        return out


@dataclass
class Weights:
    place: dict[str, float]
    tag: dict[str, float]
    names: frozenset[str]


def names_of(attrs: str) -> list[str]:
    return [w for v in NAMED.findall(attrs) for w in "".join(v).lower().split()] if "=" in attrs else []


def beside_name(name: str, learned: frozenset[str] = frozenset()) -> str | None:
    """The word for which a name stands beside the content; of a name of several words all must say so or nothing."""
    if name in learned:
        return name
    parts = [p for p in re.split(r"[^a-z]+", name) if p]
    said = [p for p in parts if p in NAMES]
    return said[0] if said and all(p in NAMES or p in PLAIN for p in parts) else None


def units(page: str | None, learned: frozenset[str] = frozenset(), unheeded: frozenset[int] = frozenset(), each_name=None, wrappers: Wrappers | None = None) -> Iterator[Unit]:
    """The units of a page in order. ``mark`` is the innermost element or name that says something of the place: an
    element of MAIN or BESIDE, or a dot and a name; inside a part that stands beside, that of the part. ``main`` numbers
    the elements of MAIN in or at a part that a name puts beside, ``wrapper`` the innermost named element. The names of
    ``unheeded`` elements say nothing. ``each_name`` gets the names around each unit."""
    page, wrappers = page or "", wrappers or Wrappers()
    # an entry: tag, hidden, mark, number of the main element, in a link, block, index of the paragraph that a block would
    # end, in a main element, names, innermost named element
    stack: list[tuple] = [("", False, "", 0, False, "body", -1, False, (), 0)]
    opened: Counter[str] = Counter()
    at, mains, tags = 0, 0, []
    unit: Unit | None = None
    done: list[Unit] = []

    def text(part: str) -> None:
        nonlocal unit, tags
        _, hidden, mark, main, linked, block, _, _, names, wrapper = stack[-1]
        if hidden:
            return
        n = len(part.split())
        if unit is None or (unit.mark, unit.main) != (mark, main) and n:
            if not n:
                return
            if unit is not None:
                done.append(unit)
            unit, tags = Unit(block, mark, tags, main, wrapper), []
            if each_name:
                each_name(unit, names)
        unit.texts.append(part)
        unit.words += n
        unit.linked += n * linked

    def pop(i: int) -> None:
        for entry in stack[i:]:
            opened[entry[0]] -= 1
        del stack[i:]

    def end_head() -> None:
        """What a head cannot hold ends it, since its end tag may be left out."""
        if stack[-1][0] == "head":
            pop(len(stack) - 1)

    for t in TOKEN.finditer(page):
        if t.start() > at:
            if stack[-1][0] == "head" and not page[at : t.start()].isspace():
                end_head()
            text(page[at : t.start()])
        at = t.end()
        name = t["tag"]
        if not name:
            continue
        name = name.lower()
        tags.append(name)
        inline = name in INLINE or name in IN_LINE_VOID
        if not inline and unit is not None:
            done.append(unit)
            unit = None
        elif name in IN_LINE_VOID and unit is not None:
            unit.texts.append(" ")
        if done:
            yield from done
            done.clear()
        if t["end"]:
            if opened[name] > 0:
                i = len(stack) - 1
                while stack[i][0] != name:
                    i -= 1
                pop(i)
            continue
        if name == "body" or stack[-1][0] in ("head", "title") and name not in HEAD:
            if stack[-1][0] == "title" and stack[-2][0] == "head":
                pop(len(stack) - 1)
            end_head()
        attrs = t["attrs"]
        if name in VOID or attrs.endswith("/"):
            continue
        if not inline and name not in HIDDEN and stack[-1][6] > 0:  # a block ends an open paragraph
            pop(stack[-1][6])
        _, hidden, mark, main, linked, block, para, within, names, wrapper = stack[-1]
        own, outside = names_of(attrs), wrapper
        said = next((b for n in own if (b := beside_name(n, learned))), None) if name not in ("body", "html", "main") else None
        if said:
            wrappers.around.append(wrapper)
            wrappers.names.append(said)
            wrapper = len(wrappers.names) - 1
            said = None if wrapper in unheeded else said
        if not (mark[:1] == "." or mark in BESIDE):
            if said:
                mark = "." + said
            elif name in MAIN or name in BESIDE and not (name == "header" and within):
                mark = name
        if name in MAIN:
            mains, within = mains + 1, True
            main = mains if mark[:1] == "." else 0
            if main:
                wrappers.mains[main] = (outside, wrapper)
        para = len(stack) if name == "p" else para if name in INLINE else -1
        stack.append((name, hidden or name in HIDDEN, mark, main, linked or name == "a", block if name in INLINE else name, para, within, (*names, *own) if each_name else (), wrapper))
        opened[name] += 1
    if at < len(page):
        if stack[-1][0] == "head" and not page[at:].isspace():
            end_head()
        text(page[at:])
    yield from done
    if unit is not None:
        yield unit


def features(u: Unit) -> list[str]:
    """What a unit's place says. Beside the content a long block says nothing for itself, in an article links nothing against."""
    out = ["all", f"block {u.block}"]
    if u.mark:
        out.append(f"mark {u.mark}")
    if 2 * u.linked > u.words:
        out += [] if u.mark in MAIN else ["linked"]
    elif u.words >= DENSE and not u.beside:
        out.append("long")
    return out


def prior(name: str) -> float:
    kind, _, value = name.partition(" ")
    if kind == "mark":
        return PRIOR["main"] if value in MAIN else PRIOR["beside"]
    if kind == "block":
        return PRIOR["p"] if value == "p" else PRIOR["heading"] if re.fullmatch("h[1-6]", value) else 0.0
    return PRIOR.get(kind, 0.0)


TITLE = re.compile(r"<title\b[^<>]*>([^<]*)", re.I)


def labels(page: str, found: list[Unit]) -> list[bool]:
    """By density and the title alone: which units belong to the page's content. All False if there is no dense one."""
    m = TITLE.search(page)
    title = html.unescape(m[1]).split() if m else []
    gain = []
    for u in found:
        own = html.unescape("".join(u.texts)).split()
        repeats = len(own) >= 3 and len(title) >= 3 and (own == title[: len(own)] or title == own[: len(title)])
        gain.append(u.words if repeats or u.words >= DENSE and 4 * u.linked <= u.words else -1 - min(u.words, LOOSE))
    first, last = best_run(gain)
    # short blocks of the same element go on where the dense ones end
    kinds = {u.block for u, g in zip(found[first:last], gain[first:last], strict=True) if g > 0}
    while first < last < len(found) and found[last].block in kinds and 2 * found[last].linked <= found[last].words:
        last += 1
    return [first <= i < last and 2 * u.linked <= u.words for i, u in enumerate(found)]


def best_run(gain: list[float]) -> tuple[int, int]:
    """[first, last) of the contiguous run with the greatest positive sum; of equal ones the first. Empty if none."""
    best = total = 0.0
    start, run = 0, (0, 0)
    for i, g in enumerate(gain):
        if total <= 0:
            total, start = 0.0, i
        total += g
        if total > best:
            best, run = total, (start, i + 1)
    return run


def train(pages: list[str]) -> Weights:
    """Weights of places, tags, and names that stand beside the content."""
    inside, outside, on = Counter(), Counter(), defaultdict(set)
    labelled = []
    for k, page in enumerate(pages):
        around: list[tuple] = []
        found = list(units(page, each_name=lambda u, names: around.append(names)))  # noqa: B023
        good = labels(page, found)
        if not any(good):
            continue
        labelled.append((page, good))
        for u, g, names in zip(found, good, around, strict=True):
            for n in set(names):
                (inside if g else outside)[n] += u.words
                on[n].add(k)
    learned = frozenset(n for n in outside if len(on[n]) >= NAME_PAGES and outside[n] >= NAME_WORDS and outside[n] > 20 * inside[n])
    rows: Counter[tuple] = Counter()
    tag_in, tag_out = Counter(), Counter()
    for page, good in labelled:
        again = list(units(page, learned))
        good = good if len(again) == len(good) else labels(page, again)
        for u, g in zip(again, good, strict=True):
            rows[(*features(u), g)] += u.words
            (tag_in if g else tag_out).update(u.tags)
    names = sorted({f for r in rows for f in r[:-1]})
    at = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(rows), len(names)))
    for i, r in enumerate(rows):
        x[i, [at[f] for f in r[:-1]]] = 1
    y, n = np.array([r[-1] for r in rows], float), np.array([float(c) for c in rows.values()])
    n *= EVIDENCE / max(n.sum(), 1)
    mean = np.array([prior(f) for f in names])
    w = mean.copy()
    held = np.array([FIRM if f == "all" or f.startswith("block ") else PRECISION for f in names])
    for _ in range(30 if len(rows) else 0):  # Newton steps, held to the prior
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * q * (1 - q))[:, None]).T @ x + np.diag(held), x.T @ (n * (q - y)) + held * (w - mean))
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return Weights(dict(zip(names, w.tolist(), strict=True)), {t: tag_weight(tag_in[t], tag_out[t]) for t in {*tag_in, *tag_out}}, learned)


def tag_weight(good: int = 0, bad: int = 0) -> float:
    """Never positive: from a hair under 0 for tags that stand in the content to -2 for those that never do."""
    return -max(0.001, min(2.0, math.log((bad + 1) / (good + 1))))


def word_weight(u: Unit, weights: Weights) -> float:
    return max(-3.0, min(1.0, sum(weights.place.get(f, prior(f)) for f in features(u))))


def extract(page: str | None, weights: Weights) -> str:
    """The main text. Where names put it beside, those on its wrappers are not heeded, and all others are."""
    wrappers = Wrappers()
    text, found, chosen = _extract(page, weights, wrappers)
    if len(wrappers.names) > 1 and not any(u.mark in MAIN and u.words for u in chosen):
        if unheeded := wrapping(found, chosen, wrappers):
            return _extract(page, weights, Wrappers(), unheeded)[0]
    return text


def wrapping(found: list[Unit], chosen: list[Unit], wrappers: Wrappers) -> frozenset[int]:
    """The named elements around the content, where none of it stands in an article or main element."""
    kept = sum(u.words for u in chosen)
    mains, dense = Counter(), Counter()
    for u in found:
        if u.main and u.wrapper:
            mains[u.main] += u.words - u.linked
        elif u.wrapper and u.dense:
            dense[u.wrapper] += u.words
    held = Counter(wrappers.mains[m][0] for m in mains)
    readers = lambda k: any(wrappers.names[w] in READERS for w in wrappers.chain(k))
    whole = any(u.dense for u in chosen)
    alone = [m for m in mains if held[wrappers.mains[m][0]] == 1 and not readers(wrappers.mains[m][0]) and not (whole and readers(wrappers.mains[m][1]))]
    best = max(alone, key=lambda m: mains[m], default=0)
    if best and mains[best] > kept:
        return frozenset(wrappers.chain(wrappers.mains[best][1]))
    best = max(dense, key=lambda w: dense[w], default=0)
    if dense[best] > WRAPPED * kept and not readers(best) and not whole:
        around = wrappers.chain(best)
        return frozenset(around) | {w for w in dense if wrappers.names[w] == wrappers.names[best] and wrappers.around[w] == wrappers.around[best]}
    return frozenset()


def _extract(page: str | None, weights: Weights, wrappers: Wrappers, unheeded: frozenset[int] = frozenset()) -> tuple[str, list[Unit], list[Unit]]:
    """The text, all units, and those of the text."""
    found = list(units(page, weights.names, unheeded, wrappers=wrappers))
    weight = [word_weight(u, weights) for u in found]
    gain: list[float] = []
    owner: list[int] = []
    loss = 0.0
    for i, (u, w) in enumerate(zip(found, weight, strict=True)):
        cost = -0.001 * len(u.tags) if u.mark else sum(weights.tag.get(t, tag_weight()) for t in u.tags)
        loss = min(GAP, loss - cost - (0.0 if u.beside else min(0.0, w * u.words)))
        if w > 0 and u.words:
            gain += [-loss, w * u.words]
            owner += [-1, i]
            loss = 0.0
    first, last = best_run(gain)
    chosen = [k for k in owner[first:last] if k >= 0]
    out, before = [], None
    for k in chosen:
        if before is not None:
            out.append(" " if k != before + 1 or any(t not in INLINE for t in found[k].tags) else "")
        out.append(html.unescape("".join(found[k].texts)))
        before = k
    return " ".join("".join(out).split()), found, [found[k] for k in chosen]


def training_pages(pages: DataFrame) -> list[str]:
    least = least_hashed(pages.filter("html IS NOT NULL").select("page_id", "html"), "page_id", SAMPLE_PAGES, 9)
    piece = F.substr("html", F.lit(1), F.lit(SAMPLE_CHARS)).alias("piece")
    return [r["piece"] for r in least.select("__h", "page_id", piece).orderBy("__h", "page_id", "piece").limit(SAMPLE_PAGES).collect()]


def extract_main(pages: DataFrame, weights: Weights) -> DataFrame:
    """page_id, url, text, n_chars; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = [extract(h.as_py(), weights) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract_main(pages, train(training_pages(pages)))
