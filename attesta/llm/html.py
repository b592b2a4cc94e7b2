"""Main text of web pages by the maximum-scoring subsequence of words and tags.

Tags score negative; words score positive, less the charge of the elements around them. All weights are learned from labelled pages: a page labels itself where it has exactly one <article> or <main>. These two
names are the label and are never seen by the model. Each labelled page counts twice, as it is and with its sectioning names and attributes taken away, so that what is left (paragraphs, links, headings, mass) has weights too.
A linear scan finds the contiguous run of events with the greatest sum: that is the region, whatever elements it begins and ends in. Within the region only words of the least possible score are left
out, those that an element's weights hold to be boilerplate beyond doubt (an advert between two paragraphs); such an element costs GAP in the scan.

An element's weights are those of its tag, of the tokens and parts of tokens of its class, id and role, and of three properties: most words are links (#links), it has a large part of the page's words (#mass), it holds a first-level
heading (#h1). The sum, if below 0, is the charge on each of its words; of nested elements the lowest counts. A learned weight is the log of how much likelier a key is inside the label than outside, held within bounds; PRIOR is added to it."""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.base import map_arrow

#: Different pages to learn weights from, those with the least hashes; keys of class and id that are kept, the most frequent ones.
SAMPLE_PAGES, MOST_KEYS = 2000, 5000
_RAW = frozenset("script style noscript template textarea iframe svg math object select title".split())
_SECTIONS = frozenset("nav aside footer header section article main form menu dialog".split())
_LABELS = ("article", "main")
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
_KNOWN = _RAW | _SECTIONS | _VOID | _INLINE | frozenset("html body head div p ul ol li dl dt dd table tbody thead tfoot tr td th h1 h2 h3 h4 h5 h6 button figure figcaption blockquote pre address center details summary".split())
_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
#: The rest of a tag with whole quoted values; quoted values without "<" need no look far ahead.
_NEAR = re.compile(r"""(?:"[^"<]*+"|'[^'<]*+'|[^'"<>])*+>""")
_FAR = re.compile(r"""(?:"[^"]*+"|'[^']*+'|[^'">])*+""")
_ATTR = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
_PIECES = re.compile(r"[^a-z0-9]+")
#: What is known of names before any page is seen.
_SURE = "ad ads adv advert adverts advertisement advertising sponsor sponsored cookie cookies consent gdpr notice notices alert popup modal newsletter subscribe subscription signup login sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer masthead".split()
_READERS = "comment comments disqus reply replies respond".split()  # often longer than the article
_LIKELY = "promo promotion banner overlay toolbar share sharing social related recommended pagination pager widget".split()
PRIOR = (
    {f".{x}": -6.0 for x in _SURE} | {f".{x}": -10.0 for x in _READERS} | {f".{x}": -1.5 for x in _LIKELY} | {f"~{x}": -0.5 for x in _SURE}
    | {f"@{x}": -6.0 for x in ("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar")}
    | {x: -6.0 for x in ("nav", "aside", "footer", "form", "button", "menu", "dialog")} | {"header": -3.0, "p": 3.0, "blockquote": 3.0, "pre": 3.0, "ul": 2.0, "ol": 2.0, "li": 2.0, "table": 2.0, "#links": -3.0, "#mass": 3.0, "#h1": 7.0}
)
#: Bounds of a learned weight by the first character of its key; ":" is the last block tag before a word, "#" a property, "." a token, "~" a part of one, "@" a role, others tags.
BOUNDS = {":": (-2.5, 1.0), "#": (-3.0, 1.0), ".": (-4.0, 2.0), "~": (-0.5, 0.5), "@": (-4.0, 2.0)}
TAG_BOUNDS = (-2.0, 2.0)
LINKS, MASS = 0.6, 0.4
#: A word's score is 1 with no charge and -1 at this one and below.
DOUBTLESS = -4.0
#: A tag's cost is at most CEILING and at least FLOORS of its name, else FLOOR: an article may have links and lists even where no labelled page has them. COSTS: before any page is seen.
FLOOR, CEILING = -6.0, -0.05
FLOORS = {x: -0.5 for x in _INLINE} | {x: -1.0 for x in "p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tbody thead tfoot tr td th figure figcaption blockquote pre".split()} | {x: -0.5 for x in ("div", "section", "header")} | {x: -0.1 for x in _RAW}
COSTS = {f"{s}{x}": -0.1 for x in FLOORS for s in ("", "/")}
#: An element that is boilerplate beyond doubt costs this in all, however long: it may stand between two paragraphs.
GAP = -0.5


@dataclass
class Weights:
    """costs: of tags, '/'-led if they close. keys: of elements and of ':' contexts."""

    costs: dict[str, float]
    keys: dict[str, float]


def tokens(html: str) -> list[tuple[str, str]]:
    """(kind, value): kind 't' with text, or a tag's name ('/'-led if it closes) with its attributes. Comments and the content of scripts and the like are left out.

    One pass: a search that finds nothing is not made again, and looks beyond a '<' inside a tag are bounded by the page's length in all."""
    out: list[tuple[str, str]] = []
    at, n, begin = 0, len(html), 0
    last_gt, budget, no_end = html.rfind(">"), 2 * n, set()

    def text(upto: int) -> None:
        if upto > begin:
            out.append(("t", html[begin:upto]))

    while (lt := html.find("<", at)) >= 0:
        nxt = html[lt + 1 : lt + 2]
        if nxt in ("!", "?"):
            text(lt)
            if html.startswith("<!--", lt):
                end = html.find("-->", lt + 4) if "-->" not in no_end else -1
                if end < 0:
                    no_end.add("-->")
                    end = html.find(">", lt) - 2 if lt < last_gt else n
                at = begin = min(n, end + 3)
            else:
                at = begin = html.find(">", lt) + 1 if lt < last_gt else n
            continue
        closes = nxt == "/"
        name = _NAME.match(html, lt + 1 + closes)
        if not name or lt > last_gt:
            at = lt + 1  # a lone '<' is text
            continue
        rest = _NEAR.match(html, name.end())
        end = rest.end() - 1 if rest else -1
        if end < 0 and budget > 0:
            far = _FAR.match(html, name.end()).end()
            budget -= far - lt
            end = far if html[far : far + 1] == ">" else -1
        if end < 0:
            end = html.find(">", name.end())
        text(lt)
        at = begin = end + 1
        tag = name[0].lower()
        out.append((f"/{tag}" if closes else tag, html[name.end() : end]))
        if tag in _RAW and not closes and tag not in no_end:
            m = re.compile(rf"</{tag}\s*+>", re.I).search(html, at)
            if m:
                at = begin = m.end()
                out.append((f"/{tag}", ""))
            else:
                no_end.add(tag)
    text(n)
    return out


def neutral(found: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The same page with div for the sectioning names, and without attributes."""
    return [(k, v) if k == "t" else ("/div" if k[0] == "/" and k[1:] in _SECTIONS else "div" if k in _SECTIONS else k, "") for k, v in found]


def _tag(kind: str) -> str:
    name = kind.lstrip("/")
    return kind if name in _KNOWN and name not in _LABELS else kind.replace(name, "div" if name in _LABELS else "other")


def _pairs(found: list[tuple[str, str]]) -> dict[int, int]:
    """Where each element closes; an element that is never closed is not here and charges nothing."""
    closing: dict[int, int] = {}
    open_: dict[str, list[int]] = {}
    for k, (kind, _) in enumerate(found):
        if kind == "t" or kind in _VOID:
            continue
        if kind[0] == "/":
            if stack := open_.get(kind[1:]):
                closing[stack.pop()] = k
        else:
            open_.setdefault(kind, []).append(k)
    return closing


def _named(attrs: str) -> set[str]:
    out: set[str] = set()
    for m in _ATTR.finditer(attrs):
        name = m[1].lower()
        if name in ("class", "id", "role"):
            value = (m[2] or m[3] or m[4] or "").lower()
            whole = value.split()
            out.update(f"@{x}" if name == "role" else f".{x}" for x in whole)
            if name != "role":
                out.update(f"~{p}" for x in whole for p in _PIECES.split(x) if p and p != x)
    return out


def features(found: list[tuple[str, str]]) -> tuple[list[int], list[str], list[tuple[int, int, set[str]]]]:
    """Words of each event, the context of each event (the last block tag), and the elements that hold words: (opens, closes, keys)."""
    words, contexts, links, heads = [], [], [], []
    context, inside, n_words, n_links, n_heads = ":", 0, 0, 0, 0
    for kind, value in found:
        w = len(value.split()) if kind == "t" else 0
        if kind == "a":
            inside = 1
        elif kind == "/a":
            inside = 0
        elif kind == "h1":
            n_heads += 1
        if kind != "t" and kind.lstrip("/") not in _INLINE:
            context = f":{_tag(kind)}"
        n_words += w
        n_links += w * inside
        words.append(w)
        contexts.append(context)
        links.append(n_links)
        heads.append(n_heads)
    ends, total = [], 0
    for w in words:
        total += w
        ends.append(total)
    elements = []
    for a, b in _pairs(found).items():
        held = ends[b] - ends[a]
        if not held:
            continue
        kind, attrs = found[a]
        keys = _named(attrs) if attrs else set()
        if kind in _INLINE:
            if keys:
                elements.append((a, b, keys))
            continue
        keys.add(_tag(kind))
        if links[b] - links[a] >= LINKS * held:
            keys.add("#links")
        if held >= MASS * total:
            keys.add("#mass")
        if kind == "h1" or heads[b] > heads[a]:
            keys.add("#h1")
        elements.append((a, b, keys))
    return words, contexts, elements


def labelled_span(found: list[tuple[str, str]]) -> tuple[int, int] | None:
    """From the opening to the closing tag of the one article (or main) element, if there is exactly one."""
    for name in _LABELS:
        a, b = [k for k, e in enumerate(found) if e[0] == name], [k for k, e in enumerate(found) if e[0] == f"/{name}"]
        if len(a) == 1 and len(b) == 1 and a[0] < b[0]:
            return a[0], b[0]
    return None


def count_labels(html: str) -> Counter:
    """How often keys are inside and outside the labelled span, by (kind, inside, key): 'e' elements, ':' words by context, 't' tags. Empty if the page has no label."""
    out: Counter = Counter()
    found = tokens(html)
    if span := labelled_span(found):
        for page in (found, neutral(found)):
            words, contexts, elements = features(page)
            for a, b, keys in elements:
                inside = span[0] <= a and b <= span[1]
                if inside or b < span[0] or a > span[1]:
                    out.update(("e", inside, x) for x in keys)
            for k, (kind, _) in enumerate(page):
                inside = span[0] < k < span[1]
                if kind != "t":
                    out["t", inside, _tag(kind)] += 1
                elif words[k]:
                    out[":", inside, contexts[k]] += words[k]
    return out


def weights_from(counts: dict[tuple[str, bool, str], int]) -> Weights:
    sums: Counter = Counter()
    for (kind, inside, _), n in counts.items():
        sums[kind, inside] += n
    ratio = lambda kind, x: math.log((counts.get((kind, True, x), 0) + 1) / (sums[kind, True] + 2)) - math.log((counts.get((kind, False, x), 0) + 1) / (sums[kind, False] + 2))
    held = lambda x, low, high: min(high, max(low, x))
    costs = COSTS | {x: held(ratio("t", x), FLOORS.get(x.lstrip("/"), FLOOR), CEILING) for x in {k[2] for k in counts if k[0] == "t"}}
    keys = {x: held(ratio(kind, x), *BOUNDS.get(x[0], TAG_BOUNDS)) for kind, _, x in counts if kind != "t"}
    return Weights(costs, {x: keys.get(x, 0.0) + PRIOR.get(x, 0.0) for x in keys.keys() | PRIOR.keys()})


def word_scores(found: list[tuple[str, str]], weights: Weights) -> tuple[list[float], list[float]]:
    """The score of each event, and that of each of an event's words: from 1 down to -1."""
    words, contexts, elements = features(found)
    charge = {a: (c, b) for a, b, keys in elements if (c := sum(weights.keys.get(x, 0.0) for x in keys)) < 0}
    other, closed = weights.costs.get("other", -2.0), -1
    events, each, active = [], [], []
    for k, ((kind, _), w) in enumerate(zip(found, words, strict=True)):
        if k in charge:
            heapq.heappush(active, charge[k])
        while active and active[0][1] < k:
            heapq.heappop(active)
        x = (active[0][0] if active else 0.0) + weights.keys.get(contexts[k], 0.0) if w else 0.0
        each.append(max(-1.0, min(1.0, 1 - 2 * x / DOUBTLESS)))
        if k <= closed:
            events.append(0.0)
        elif k in charge and charge[k][0] <= DOUBTLESS:
            closed = charge[k][1]
            events.append(GAP)
        else:
            events.append(w * each[-1] if kind == "t" else weights.costs.get(_tag(kind), other))
    return events, each


def best_run(scores: list[float]) -> tuple[int, int]:
    """First and last index of the contiguous run with the greatest sum; (0, -1) if no score is positive. The earliest of equal runs."""
    best, span, total, start = 0.0, (0, -1), 0.0, 0
    for k, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, k
        total += s
        if total > best:
            best, span = total, (start, k)
    return span


def main_text(html: str, weights: Weights) -> str:
    found = tokens(html)
    events, each = word_scores(found, weights)
    first, last = best_run(events)
    blocks, now = [], []
    for k in range(first, last + 1):
        kind, value = found[k]
        if kind == "t":
            if each[k] > -1.0:
                now.append(value)
        elif kind == "br":
            now.append(" ")
        elif kind.lstrip("/") not in _INLINE:
            blocks.append("".join(now))
            now = []
    blocks.append("".join(now))
    clean = (" ".join(unescape(b).split()) for b in blocks)
    return "\n\n".join(b for b in clean if b)


def learn(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> Weights:
    """Weights from at most sample_pages different pages."""
    hashed = pages.where("html is not null").select(F.xxhash64("html").alias("h"), "html")
    last = hashed.select("h").distinct().orderBy("h").limit(sample_pages).agg(F.max("h")).first()[0]  # the hash alone is sorted, not the pages
    sample = hashed.where(F.col("h") <= F.lit(last)) if last is not None else hashed.limit(0)
    sample = sample.groupBy("h").agg(F.first("html").alias("html")).select("html")  # a page that is repeated is read once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            for html in b.column(0).to_pylist():
                total.update(count_labels(html))
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.string()), pa.array([k[1] for k in total], pa.bool_()), pa.array([k[2] for k in total], pa.string()), pa.array(list(total.values()), pa.int64())], ["kind", "inside", "key", "n"])

    rows = map_arrow(sample, run, "kind string, inside boolean, key string, n long").groupBy("kind", "key").agg(F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("i"), F.sum(F.when(F.col("inside"), 0).otherwise(F.col("n"))).alias("o"))
    rows = rows.orderBy(F.desc(F.col("i") + F.col("o")), "kind", "key").limit(MOST_KEYS).collect()
    return weights_from({(r["kind"], inside, r["key"]): r["i" if inside else "o"] for r in rows for inside in (True, False)})


def extract(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> DataFrame:
    """page_id, url and text for every row of pages(page_id, url, html).

    Null or empty html, or a page without words that score positive: the empty text. Of runs with equal sums the earliest. Without labelled pages the prior weights alone decide. Repeated rows are extracted each; other columns are ignored; no rows in, no rows out. Work is linear in a page's length but for the depth of nested charges."""
    weights = pages.sparkSession.sparkContext.broadcast(learn(pages, sample_pages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([main_text(h or "", weights.value) for h in b.column(2).to_pylist()], pa.string())], ["page_id", "url", "text"])

    return map_arrow(pages.select("page_id", "url", "html"), run, "page_id long, url string, text string")
