"""Main text of web pages as the maximum-scoring runs of words and tags.

A page is read as words and tags in page order. Words score by where they stand, tags cost; a linear scan finds the
contiguous region of the highest sum. All weights are log odds from labelled pages: a bounded sample of pages whose article
or main element marks the content. Scans decide all that is left out; no other filter follows.

1. best_region gives the score of the best contiguous region.
2. best_runs gives the regions of the highest sum, each at a price of REGION_SHARE of that score: a second article far from
   the first is a region of its own, a stray line is none.
3. Inside a region the same scan on negated word scores, at CUT a run, gives what is cut out: an advert, a comment.

- Words below a page's article or main element, outside it, and of pages without one have a weight each.
- An element's name, if it is one of ROLES, and the words of its class, id and role are keys. A key's weight is the log odds
  of its words lying in content. Names in HINTS, alone or with other such words (cookie-notice, but not share-price), start
  with PRIOR words outside content, so pages without examples of them profit too. Words below an element with a key of
  DROP or less score by it; for the regions not at all below article or main, as what is cut later must not part an article.
- Names in LINKING tell of lists of links. An element with such a name that holds at least PROSE words outside links, and
  under a quarter of its words in links, is prose, and the name says nothing (a section on related work). Names of quoting
  elements say nothing either: a quotation may have the class comment.
- Tags cost by their share outside content, at most TAG_MOST, and next to nothing below article or main.

Only what is no text at all (scripts, styles, the head and the like) is left out before the scan.

The text of the region: character references decoded, white space inside a block turned into one space, blocks trimmed
and joined by one space. Null and empty pages, and pages without content, give the empty text. A tag that never ends, an
open comment and an open script take the rest of the page. Reading takes time in proportion to a page's length. Repeated
rows are handled one by one; a column of the input named text is replaced.
"""

import html as entities
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessaxis.llm.common import in_slices, put, with_field

SAMPLE_PAGES = 1000
PRIOR, TAG_MOST, CLIP, DROP = 50, 0.3, 3.0, -1.0
REGION_SHARE, CUT, PROSE = 0.2, 0.5, 12

# Names of HTML elements and what they are for.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "noembed", "xmp"}
NO_TEXT = {"head", "object", "canvas", "audio", "video", "map"} | RAW
ROLES = {"nav", "footer", "aside", "form", "menu", "button", "select", "dialog", "header", "search"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
ENDS_ITSELF = {"p", "li", "dd", "dt", "tr", "td", "th", "option"}
LISTS = {"table", "ul", "ol", "dl"}
CONTENT = {"article", "main"}
QUOTING = {"blockquote", "q", "cite", "pre", "code"}
# Words in names of elements that are no article text, and words that go with them.
HINTS = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "comment", "comments", "respond", "disqus", "replies", "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "masthead", "share", "social", "related", "recommended", "pagination", "pager", "toolbar", "complementary", "contentinfo", "search"}
LINKING = {"breadcrumb", "breadcrumbs", "menu", "nav", "navbar", "navigation", "pager", "pagination", "recommended", "related", "search", "share", "social", "toolbar"}
GENERIC = {"area", "bar", "block", "box", "btn", "button", "buttons", "container", "content", "form", "header", "inner", "item", "items", "left", "link", "links", "list", "main", "message", "outer", "page", "panel", "primary", "right", "secondary", "section", "site", "slot", "top", "bottom", "unit", "widget", "wrap", "wrapper"}

NAME = re.compile(r"</?([A-Za-z][A-Za-z0-9:-]*)")
REST = re.compile(r"(?:\"[^\"]*\"|'[^']*'|[^'\">])*>")
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)

#: text, weight key of its place ("in", "out" or "free", "" for a tag), tag name, keys of elements around it, in content
Token = tuple[str, str, str, frozenset, bool]


def lexed(page: str):
    """Yields (text, name, closing, attributes): text with name "", else a tag."""
    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield page[at:], "", False, ""
            return
        m = NAME.match(page, lt)
        if not m and page[lt + 1 : lt + 2] not in ("!", "?"):
            nxt = page.find("<", lt + 1)
            nxt = n if nxt < 0 else nxt
            yield page[at:nxt], "", False, ""
            at = nxt
            continue
        if lt > at:
            yield page[at:lt], "", False, ""
        comment = page.startswith("<!--", lt)
        end = page.find("-->" if comment else ">", lt)
        if end < 0:
            return
        if not m:
            at = end + (3 if comment else 1)
            continue
        # a quote that never ends is no quote: the tag ends at the next bracket
        rest = REST.match(page, m.end())
        at = rest.end() if rest else end + 1
        name, attributes, closing = m[1].lower(), page[m.end() : at - 1], page[lt + 1] == "/"
        yield "", name, closing, attributes
        if name in RAW and not closing and not attributes.endswith("/"):
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.IGNORECASE).search(page, at)
            if not close:
                return
            at = close.start()


def hinted(name: str) -> bool:
    parts = [x for x in re.split(r"[-_]+|(?<=[a-z])(?=[A-Z])", name) if x]
    low = {x.lower() for x in parts}
    return bool(low & HINTS) and low <= HINTS | GENERIC


def of_links(key: str) -> bool:
    """Whether a key of a name is one of lists of links only."""
    low = {x.lower() for x in re.split(r"[-_.]+|(?<=[a-z])(?=[A-Z])", key) if x}
    return key.startswith(".") and bool(low & LINKING) and not low & (HINTS - LINKING) and hinted(key[1:])


def keys_of(name: str, attributes: str) -> set[str]:
    found = {name} if name in ROLES else set()
    if attributes and name not in QUOTING:
        for m in NAMED.finditer(attributes):
            found.update("." + x for x in "".join(m.groups("")).split())
    return found


def tokens(page: str) -> list[Token]:
    out: list[Token] = []
    stack: list[tuple[str, bool, frozenset, bool]] = []  # name, no text, keys, in content
    opened: Counter = Counter()
    # of the outermost element with a name of link lists: its depth, first token, keys, words and words in links before it
    listed: tuple[int, int, frozenset, int, int] | None = None
    n_words = n_linked = 0

    def pop(size):
        nonlocal listed
        for x in stack[size:]:
            opened[x[0]] -= 1
        del stack[size:]
        if listed and size < listed[0]:
            _, first, names, words, linked = listed
            words, linked, listed = n_words - words, n_linked - linked, None
            if words - linked < PROSE or 4 * linked >= words:
                out[first:] = [(*x[:3], x[3] | names, x[4]) for x in out[first:]]

    labelled = False
    for text, name, closing, attributes in lexed(page):
        _, silent, keys, content = stack[-1] if stack else ("", False, frozenset(), False)
        if not name:
            if not silent:
                out.append((text, "in" if content else "out", "", keys, content))
                words = len(text.split())
                n_words, n_linked = n_words + words, n_linked + words * (opened["a"] > 0)
            continue
        if closing:
            if opened[name]:
                size = len(stack) - 1
                while stack[size][0] != name:
                    size -= 1
                pop(size)
            if not (stack and stack[-1][1]):
                above = stack[-1] if stack else ("", False, frozenset(), False)
                out.append(("", "", name, above[2], above[3]))
            continue
        if name in ENDS_ITSELF and opened[name]:
            for i in range(len(stack) - 1, max(len(stack) - 7, -1), -1):
                if stack[i][0] == name:
                    pop(i)
                    break
                if stack[i][0] in LISTS:
                    break
            _, silent, keys, content = stack[-1] if stack else ("", False, frozenset(), False)
        own = keys_of(name, attributes)
        if content:
            own.discard("header")  # of the article
        if name in CONTENT:
            labelled = labelled or not keys & ROLES
            keys, content = keys & ROLES, True
        links = frozenset(x for x in own if of_links(x)) if own else frozenset()
        own -= links
        state = (name, silent or name in NO_TEXT, keys | own if own else keys, content)
        if not state[1]:
            out.append(("", "", name, keys, content))
        if name not in VOID and not attributes.endswith("/"):
            stack.append(state)
            opened[name] += 1
            if links and not listed and not state[1]:
                listed = (len(stack), len(out), links, n_words, n_linked)
    pop(0)
    return out if labelled else [(t, "free" if k else "", name, keys, False) for t, k, name, keys, _ in out]


def worst(keys: frozenset, weights: dict[str, float]) -> float:
    """The least weight of the keys; a name with a hint starts low, others count for nothing unless they were seen."""
    return min((weights.get(k, -CLIP if k in ROLES or hinted(k[1:]) else 0.0) for k in keys), default=0.0)


def word_score(token: Token, weights: dict[str, float]) -> float:
    """The score of a token's words; a tag has none."""
    text, place, _, keys, _ = token
    if not place:
        return 0.0
    low = worst(keys, weights)
    return (low if low <= DROP else weights.get(place, {"in": 1.0, "free": 1.0, "out": -1.0}[place])) * len(text.split())


def score(token: Token, weights: dict[str, float]) -> float:
    """What a token counts for the regions: words that are cut later do not part them, tags cost."""
    text, place, name, keys, content = token
    if not place:
        return -0.01 if content else -min(weights.get("<" + name, 0.1), TAG_MOST)
    words = word_score(token, weights)
    return words * {"in": 0.0, "free": 1 / CLIP, "out": 1.0}[place] if worst(keys, weights) <= DROP else words


def best_region(scores: list[float]) -> tuple[int, int]:
    """The contiguous run of the highest sum, as a half-open range; of equal sums the first, and of these the shortest."""
    best, region, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, region = total, (start, i + 1)
    return region


def best_runs(scores: list[float], price: float) -> list[tuple[int, int]]:
    """The disjoint runs, as half-open ranges in order, whose sums less a price each are highest together; one linear scan.

    Of equal choices the one with fewer tokens inside."""
    # the best sums so far with the last token outside and inside a run, and how each came about
    out, inside, opened, closed = 0.0, -math.inf, [], []
    for s in scores:
        starts, ends = out - price >= inside, inside > out
        opened.append(starts)
        closed.append(ends)
        out, inside = max(out, inside), max(out - price, inside) + s
    runs, i, within = [], len(scores), inside > out
    end = i
    while i:
        i -= 1
        if within:
            if opened[i]:
                runs.append((i, end))
                within = False
        elif closed[i]:
            # token i lies outside, and the run before it ends here
            within, end = True, i
    return runs[::-1]


def regions(scores: list[float]) -> list[tuple[int, int]]:
    """The regions of a page: of those that score over REGION_SHARE of the best contiguous one, the best together."""
    a, b = best_region(scores)
    return best_runs(scores, REGION_SHARE * math.fsum(scores[a:b])) if a < b else []


def main_text(page: str | None, weights: dict[str, float]) -> str:
    found, parts = tokens(page or ""), []
    for a, b in regions([score(t, weights) for t in found]):
        cut = [False] * (b - a)
        for x, y in best_runs([-word_score(t, weights) for t in found[a:b]], CUT):
            cut[x:y] = [True] * (y - x)
        parts += ["" if place and gone else text if place else "" if name in INLINE else "\n" for (text, place, name, _, _), gone in zip(found[a:b], cut, strict=True)]
        parts.append("\n")
    # references are decoded after the tags are gone, so that decoded brackets stay text
    return " ".join(entities.unescape("".join(parts)).split())


def counts_of(page: str) -> Counter:
    """Words (tags for keys with <) by key and whether they lie in content, of one labelled page."""
    counts: Counter = Counter()
    for text, place, name, keys, content in tokens(page):
        if not place:
            counts["<" + name, content] += 1
        elif n := len(text.split()):
            counts[place, content] += n
            for k in keys:
                counts[k, content] += n
    return counts


def learn_weights(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Log odds of lying in content, clipped, from counts of (key, in content); costs of tags by their share outside."""
    out, inside, outside = {}, counts.get(("in", True), 0), counts.get(("out", False), 0)
    for k in {k for k, _ in counts}:
        a, b = counts.get((k, True), 0), counts.get((k, False), 0)
        if k.startswith("<"):
            out[k] = TAG_MOST * (b + 0.1) / (a + b + 1)
        elif k not in ("in", "out", "free"):
            low = PRIOR if k in ROLES or hinted(k[1:]) else 0
            out[k] = max(-CLIP, min(CLIP, math.log((a + 1) / (b + low + 1))))
    if inside:
        # a word of a page whose place says nothing: its odds over all words
        out |= {"in": 1.0, "out": -CLIP, "free": max(0.2, min(1.0, math.log((inside + 1) / (outside + 1))))}
    return out


def fit(pages: DataFrame, sample: int = SAMPLE_PAGES) -> dict[str, float]:
    """Weights from at most `sample` pages with an article or main element, chosen by a hash of their keys; the sum of the sample's counts comes to the driver."""
    labelled = pages.where(F.col("html").rlike("(?i)<(article|main)[\\s>]")).select("html", F.xxhash64("page_id", "url").alias("h"))
    last = labelled.select("h").orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if last is None:
        return {}

    def run(batches):
        for batch in in_slices(batches, "html"):
            counts: Counter = Counter()
            for page in batch.column("html"):
                counts.update(counts_of(page.as_py()))
            k = list(counts)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in k], pa.string()), pa.array([x for _, x in k], pa.bool_()), pa.array([counts[x] for x in k], pa.int64())], ["key", "content", "n"])

    counted = labelled.where(F.col("h") <= last).limit(sample).select("html").mapInArrow(run, "key string, content boolean, n long")
    return learn_weights({(r["key"], r["content"]): r["n"] for r in counted.groupBy("key", "content").agg(F.sum("n").alias("n")).collect()})


def extract(pages: DataFrame, sample: int = SAMPLE_PAGES) -> DataFrame:
    """pages with the column text: the main text of html."""
    weights = fit(pages, sample)

    def run(batches):
        for batch in in_slices(batches, "html"):
            yield put(batch, "text", pa.array([main_text(x.as_py(), weights) for x in batch.column("html")], pa.string()))

    return pages.mapInArrow(run, with_field(pages, "text", T.StringType()))
