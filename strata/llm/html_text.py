"""HTML extraction by minimum-cut labelling.

A page is split into text blocks.  A linear classifier gives each block a cost
for being labelled against its evidence (tags, class and id words of its
ancestors, share of link text, length, final punctuation, whether the page has an article that it stands outside of); the costs are the
terminal capacities of a graph.  Smoothness edges join blocks that follow each other, the stronger the nearer they stand in the
document's tree, and blocks of the same parent element.  A maximum flow from source to
sink leaves a minimum cut: blocks on the source's side are the main text.

Evidence of class and id words comes in two strengths.  Words that name nothing but side parts outweigh what edges can bring
together.  Words that name sections of an article as well (``DOUBTFUL_WORDS``) leave a block near the border, and so do short lines and
paragraphs outside the article: there the cut decides by the neighbours.

Nodes whose cost outweighs their edges are settled first, and their edges become costs of the neighbours; what is left of a page falls into
small components, cut by blocking flows (Dinic).  So a page takes time about in proportion to its blocks.

Block text: character references decoded, white space runs turned into one
space, trimmed; kept blocks are joined in page order by two line feeds.  Only links with a target count as such, and a
link ends with the element it began in.

Defined results.  Null or empty html, or a page without text: text ``""`` and 0
characters.  Pages are whole, however long; a page is one task's work.  Repeated
rows are all returned.  Columns other than key, url and html are ignored, whatever their names.
"""

from __future__ import annotations

import html as html_lib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)(?:((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|([^>]*+)(?:>|\Z))""", re.S)
_ATTR = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden|href)\b\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+(?![a-z])")

# Elements by their role in HTML.  Raw ones hold no markup and nothing of an article.
RAW = frozenset("script style textarea title template iframe noembed noframes".split())
DROPPED = frozenset("head select button datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
# Elements closed by the next of their kind, and the blocks that may stand open in them.
OPEN_ENDED = {"li": ("p", "div", "address"), "dt": ("p", "div"), "dd": ("p", "div"), "tr": ("p", "div", "td", "th"), "td": ("p", "div"), "th": ("p", "div")}
CONTENT_TAGS = frozenset("article main".split())
SIDE_TAGS = frozenset("nav footer aside form menu dialog fieldset".split())
# Words of class, id and role attributes that name parts beside the article.
SIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promoted sidebar menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer masthead topbar toolbar "
    "cookie cookies consent gdpr notice notices notification popup modal paywall newsletter subscribe subscription signup signin login search share sharing social related recommended recommendations widget "
    "comment comments disqus respond hidden complementary contentinfo dialog copyright".split()
)
# Words that name sections of articles as often.
DOUBTFUL_WORDS = frozenset("alert banner discussion form legal overlay promotion rail register replies reply skip tags".split())
# The same for the article.
CONTENT_WORDS = frozenset("article content post entry story body main text prose".split())
HEAD_WORDS = frozenset("header head banner".split())

# The classifier: log-odds that a block is main text.
WEIGHTS = {"bias": 0.3, "article": 2.5, "outside": -3.5, "content_word": 1.2, "side": -12.0, "doubtful": -6.5, "paragraph": 0.8, "heading": 0.3, "item": -0.6, "links": -4.0, "long": 1.5, "short": -0.6, "sentence": 0.4}
# An edge between blocks that follow each other: this over the steps between their elements; one between blocks of one parent.
SMOOTH_NEAR, SMOOTH_PARENT = 1.8, 0.5
# Words that a page's article must hold before standing outside of it counts.
ARTICLE_WORDS = 40


def blocks_of(page: str) -> list[tuple]:
    """(text, score, parent, element) of each text block in page order, and (parent, depth) of each element."""
    found: list[tuple] = []
    # an element on the stack: tag, side evidence (1 doubtful, 2 sure), inside the article, content word, dropped, number
    stack = [("", 0, False, False, False, 0)]
    elements = [(0, 0)]
    opened: dict[str, int] = {}
    text, links, link_depth, owner = [], 0, 0, None  # link_depth: elements on the stack when the open link began

    def flush() -> None:
        nonlocal text, links, owner
        if text:
            words = html_lib.unescape("".join(text)).split()
            if words:
                found.append((" ".join(words), len(words), links, owner))
        text, links, owner = [], 0, None

    def say(piece: str) -> None:
        nonlocal links, owner
        if not piece or stack[-1][4]:
            return
        if owner is None and not piece.isspace():
            owner = tuple(stack[-1]), next((e[0] for e in reversed(stack) if e[0] in BLOCK), ""), next((e[5] for e in reversed(stack[:-1]) if e[0] in BLOCK or e[5] == 0), 0)
        text.append(piece)
        if link_depth:
            links += len(piece)

    def close() -> None:
        nonlocal link_depth
        opened[stack.pop()[0]] -= 1
        if len(stack) < link_depth:
            link_depth = 0

    at, size = 0, len(page)
    while at < size:
        m = _TAG.search(page, at)
        if m is None:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        tag = m.group(2)
        if tag is None:
            if m.group().startswith("<![CDATA["):
                say(m.group()[9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if m.group(1):
            if tag == "a":
                link_depth = 0
            if tag in BLOCK or tag == "br":
                flush() if tag in BLOCK else say(" ")
            if opened.get(tag):
                while stack[-1][0] != tag:
                    close()
                if stack[-1][1] > stack[-2][1] and text:
                    flush()
                close()
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*+(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if tag == "br":
            say(" ")
            continue
        if tag in BLOCK:
            flush()
        if tag in VOID:
            continue
        for shut in (("p",) if tag in BLOCK else ()) + ((tag,) if tag in OPEN_ENDED else ()):  # their end tags may be left out
            if not opened.get(shut):
                continue
            depth = len(stack) - 1
            while stack[depth][0] != shut and (stack[depth][0] not in BLOCK or stack[depth][0] in OPEN_ENDED.get(shut, ())):
                depth -= 1
            if stack[depth][0] == shut:
                while len(stack) > depth:
                    close()
        top = stack[-1]
        side, inside, word = top[1], top[2], top[3]
        if tag in CONTENT_TAGS:
            inside = True
        elif tag in SIDE_TAGS or tag == "header" and not inside:
            side = 2
        attributes = m.group(3) if m.group(3) is not None else m.group(4)
        if attributes and tag not in ("html", "body"):
            for name, value in _ATTR.findall(attributes):
                name = name.lower()
                if name == "hidden" or name == "aria-hidden" and "true" in value.lower() or name == "style" and "display:none" in value.replace(" ", "").lower():
                    side = 2
                elif name == "href":
                    link_depth = len(stack) if tag == "a" else link_depth
                elif name in ("class", "id", "role"):
                    words = {w.lower() for w in _WORDS.findall(value)}
                    if tag not in CONTENT_TAGS:
                        if words & SIDE_WORDS and not (inside and words & HEAD_WORDS) or not inside and words & HEAD_WORDS and tag not in ("h1", "h2", "h3"):
                            side = 2
                        elif words & DOUBTFUL_WORDS and not (inside and words & HEAD_WORDS):
                            side = max(side, 1)
                    word = word or bool(words & CONTENT_WORDS)
        if side > top[1] and text:
            flush()
        opened[tag] = opened.get(tag, 0) + 1
        stack.append((tag, side, inside, word, top[4] or tag in DROPPED, len(elements)))
        elements.append((top[5], len(stack) - 1))
    flush()
    article = sum(n for _, n, _, (element, *_) in found if element[2] and element[1] < 2) >= ARTICLE_WORDS
    return [score_block(*block, article) for block in found], elements


def score_block(text: str, n_words: int, link_chars: int, owner, article: bool) -> tuple:
    (_, side, inside, word, _, number), tag, parent = owner
    w = WEIGHTS
    score = w["bias"] + w["long"] * min(1.0, n_words / 25) + (w["short"] if n_words < 4 else 0)
    score += w["links"] * min(1.0, link_chars / max(1, len(text)))
    score += w["article"] * inside + w["outside"] * (article and not inside) + w["content_word"] * word + (0, w["doubtful"], w["side"])[side]
    score += w["paragraph"] if tag in ("p", "blockquote", "pre") else w["heading"] if tag in ("h1", "h2", "h3", "h4") else w["item"] if tag in ("li", "td", "th") else 0
    score += w["sentence"] if text[-1] in ".!?:…»”\"'" else 0
    return text, score, parent, number


def steps_between(elements: list[tuple[int, int]], a: int, b: int, most: int = 12) -> int:
    """Elements on the way from one to the other through the tree, ``most`` at the most."""
    steps = 0
    while a != b and steps < most:
        if elements[a][1] >= elements[b][1]:
            a = elements[a][0]
        else:
            b = elements[b][0]
        steps += 1
    return steps


TINY = 1e-9


def min_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for the nodes on the source's side of a minimum cut, as few as any minimum cut has there.

    Terminal capacities: a node with score c > 0 has an arc of capacity c from the source,
    one with c < 0 an arc of capacity -c to the sink.  A node whose score outweighs its edges is on that side in every
    minimum cut; then its edges add to the neighbours' scores.  The rest is cut component by component.
    """
    n = len(scores)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, c in edges:
        if a != b:
            near[a][b] = near[a].get(b, 0.0) + c
            near[b][a] = near[b].get(a, 0.0) + c
    cost, side = list(scores), [0] * n
    weight = [sum(x.values()) for x in near]
    todo = list(range(n))
    while todo:
        v = todo.pop()
        if side[v]:
            continue
        if cost[v] > weight[v] + TINY:
            side[v] = 1
        elif -cost[v] >= weight[v] - TINY:
            side[v] = -1
        else:
            continue
        for u, c in near[v].items():
            if not side[u]:
                cost[u] += side[v] * c
                weight[u] -= c
                todo.append(u)
    for start in range(n):
        if side[start]:
            continue
        members, todo, seen = [], [start], {start}
        while todo:
            v = todo.pop()
            members.append(v)
            for u in near[v]:
                if not side[u] and u not in seen:
                    seen.add(u)
                    todo.append(u)
        source = flow_cut(members, cost, {v: {u: c for u, c in near[v].items() if u in seen} for v in members})
        for v in members:
            side[v] = 1 if v in source else -1
    return [x > 0 for x in side]


def sweep_flow(order: list[int], supply: dict[int, float], demand: dict[int, float], left: dict[int, dict[int, float]]) -> None:
    """Flow along the page in one direction: as much as the nodes further on can take passes each arc to the next."""
    takes = {order[-1]: demand[order[-1]]}  # what a node and those behind it can take
    for v, u in zip(order[-2::-1], order[:0:-1]):
        takes[v] = demand[v] + min(left[v].get(u, 0.0), takes[u])
    came = 0.0
    for v, u in zip(order, [*order[1:], None]):
        here = min(demand[v], came)
        demand[v] -= here
        came -= here
        if u is not None and u in left[v]:
            more = max(0.0, min(supply[v], left[v][u] - came, takes[u] - came))
            supply[v] -= more
            came += more
            left[v][u] -= came
            left[u][v] = left[u].get(v, 0.0) + came


def flow_cut(members: list[int], cost: list[float], left: dict[int, dict[int, float]]) -> set[int]:
    """The source's side of a component: blocking flows along shortest paths until the sink is out of reach."""
    supply = {v: max(0.0, cost[v]) for v in members}
    demand = {v: max(0.0, -cost[v]) for v in members}
    for order in (sorted(members), sorted(members, reverse=True)):  # most of it flows along the page
        sweep_flow(order, supply, demand, left)
    while True:
        level = {v: 0 for v in members if supply[v] > TINY}
        front, depth, reached = list(level), 0, False
        while front and not reached:
            reached = any(demand[v] > TINY for v in front)
            depth += 1
            following = []
            if not reached:
                for v in front:
                    for u, c in left[v].items():
                        if c > TINY and u not in level:
                            level[u] = depth
                            following.append(u)
            front = following
        if not reached:
            return set(level)
        turn = {v: iter(list(left[v])) for v in level}
        for start in [v for v in level if level[v] == 0]:
            path = [start]
            while path and supply[start] > TINY:
                v = path[-1]
                if demand[v] > TINY:
                    flow = min([supply[start], demand[v], *(left[a][b] for a, b in zip(path, path[1:]))])
                    supply[start] -= flow
                    demand[v] -= flow
                    full = len(path)
                    for k, (a, b) in enumerate(zip(path, path[1:])):
                        left[a][b] -= flow
                        left[b][a] = left[b].get(a, 0.0) + flow
                        if left[a][b] <= TINY:
                            full = min(full, k + 1)
                    # back to where an arc is full; from there another way is looked for
                    del path[full:]
                    continue
                for u in turn[v]:
                    if left[v][u] > TINY and level.get(u) == level[v] + 1:
                        path.append(u)
                        break
                else:
                    path.pop()


def edges_of(blocks: list[tuple], elements: list[tuple[int, int]]) -> list[tuple[int, int, float]]:
    edges, last = [], {}
    for i, (_, _, parent, element) in enumerate(blocks):
        if i:
            edges.append((i - 1, i, SMOOTH_NEAR / max(1, steps_between(elements, blocks[i - 1][3], element))))
        if parent in last:
            edges.append((last[parent], i, SMOOTH_PARENT))
        last[parent] = i
    return edges


def main_text(page: str | None) -> str:
    blocks, elements = blocks_of(page or "")
    kept = min_cut([b[1] for b in blocks], edges_of(blocks, elements))
    return "\n\n".join(b[0] for b, k in zip(blocks, kept) if k)


def extract_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, url, text, n_chars of every page."""
    rows = pages.select(F.col(key).alias(key), F.col(url).alias(url), F.col(html).cast("string").alias("_html"))
    done = rows.select(key, url).schema.fields
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in done) + ", text string, n_chars long"

    def work(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = [main_text(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[key, url, "text", "n_chars"])

    return rows.mapInArrow(work, schema)


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


QUERIES = {"op3_html_text": op3_html_text}
ORACLE: dict[str, str] = {}
