"""Main text of web pages by minimum cut.

A page is cut into blocks, and blocks that follow one another in the same container form a segment. A classifier
gives every segment a cost of being content and a cost of being boilerplate; these are the capacities of its edges
to the two terminals. Neighbours in page order and segments close in the element tree are tied by smoothness
edges. The minimum cut is the labelling of least total cost.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: HTML's elements without end tags, those whose content is no text of the page, and those that begin a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe object svg math canvas select button xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINER = frozenset("article aside blockquote body center dialog details div dl fieldset figure footer form head header hgroup html li main menu nav ol section table ul".split())
#: Words in class, id and role that tell what a container is for.
AGAINST = frozenset("ad ads adv advert advertisement advertising banner breadcrumb breadcrumbs byline captcha comment comments commentlist consent cookie cookies copyright dialog disqus feedback footer form gdpr header hidden login masthead menu menubar modal nav navbar navigation newsletter notice notification overlay pagination pager paywall popup popular promo promoted promotion recommend recommended related replies reply respond rss search share sharing shop sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar tooltip trending widget".split())
IN_FAVOUR = frozenset("article articlebody body content contentbody entry hentry main maincontent page post postbody prose story text".split())

TAG = re.compile(r"<!--(?s:.*?)(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?>[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
ATTRIBUTE = re.compile(r"([\w:\-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Segment:
    texts: list[str]
    node: int  # number of its container
    depth: int  # containers from the root to it
    shared: int  # of them, those that hold the segment before too
    chars: int = 0
    linked: int = 0
    marks: int = 0  # sentence marks
    heads: int = 0
    items: int = 0
    links: bool = False  # of blocks that are links mostly
    hidden: bool = False  # by attribute or style
    tags: frozenset[str] = frozenset()
    against: bool = False
    in_favour: bool = False


def segments(html: str) -> list[Segment]:
    """Blocks of text in page order, grouped by container.

    End tags that match no open element are ignored, an element that is left open ends with its parent, and a new
    block ends an open paragraph. Comments, declarations and elements in RAW give no text; br is white space.
    """
    stack: list[tuple[str, int, frozenset, bool, bool]] = [("", 0, frozenset(), False, False)]
    containers, open_tags = [0], Counter()
    parents, depths = [-1], [1]  # of each container
    raw_ends: dict[str, dict[int, int]] = {}
    out: list[Segment] = []
    words: list[str] = []
    linked, in_link, head = 0, 0, False

    def flush() -> None:
        nonlocal linked, head
        text = " ".join(unescape("".join(words)).split())
        words.clear()
        if text:
            node, links = containers[-1], linked >= 0.8 * len(text)
            if not out or out[-1].node != node or out[-1].links != links:
                _, _, tags, against, in_favour = stack[-1]
                a, b = (out[-1].node if out else node), node
                while a != b:  # up to the container of both: in all no more steps than containers open and close
                    if depths[a] >= depths[b]:
                        a = parents[a]
                    else:
                        b = parents[b]
                out.append(Segment([], node, depths[node], depths[a], tags=tags, against=against, in_favour=in_favour, links=links, hidden="hidden" in tags))
            s = out[-1]
            s.texts.append(text)
            s.chars += len(text)
            s.linked += min(linked, len(text))
            s.marks += text.count(".") + text.count(",") + text.count("?") + text.count("!")
            s.heads += stack[-1][0] in ("h1", "h2", "h3", "h4", "h5", "h6")
            s.items += stack[-1][0] in ("li", "td", "th", "dt", "dd", "option")
        linked = 0

    def close(depth: int) -> None:
        nonlocal in_link
        while len(stack) > depth:
            tag, node = stack.pop()[:2]
            open_tags[tag] -= 1
            if node != stack[-1][1]:
                containers.pop()
            in_link -= tag == "a"

    at, n = 0, len(html)
    low = None
    while at < n:
        m = TAG.search(html, at)
        piece = html[at : m.start() if m else n]
        if piece:
            words.append(piece)
            if in_link:
                linked += len(piece.strip())
        if not m:
            break
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            depth = next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag) if open_tags[tag] else 0
            if depth:
                if tag in BLOCK:
                    flush()
                close(depth)
            continue
        if tag in RAW:
            if tag in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"):
                low = html.lower() if low is None else low  # as long as html unless it holds letters that grow; then searched anew
                end = low.find(f"</{tag}", at) if len(low) == n else _find_end(html, tag, at)
                at = n if end < 0 else end
            else:
                if tag not in raw_ends:
                    raw_ends[tag] = _raw_ends(html, tag)
                at = max(at, raw_ends[tag].get(m.start(), at))
            words.append(" ")
            continue
        if tag == "br":
            words.append(" ")
            continue
        if tag in BLOCK:
            flush()
            p = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] in ("p", "h1", "h2", "h3", "h4", "h5", "h6") or stack[i][0] in CONTAINER), 0)
            if p and stack[p][0] not in CONTAINER:
                close(p)
        if tag in VOID or m[3].endswith("/"):
            continue
        _, _, tags, against, in_favour = stack[-1]
        if tag in BLOCK:
            names, unseen = set(), set()
            for name, *values in ATTRIBUTE.findall(m[3]):
                if name.lower() in ("class", "id", "role", "aria-label"):
                    names |= {x.lower() for v in values for x in NAME_PART.findall(v)}
                elif name.lower() == "hidden" or name.lower() == "style" and any(HIDING.search(v) for v in values):
                    unseen = {"hidden"}  # among the tags, too
            # what the whole page is called says nothing of its parts, nor does the name of a form that holds them
            names -= AGAINST if tag in ("html", "body") else {"form"} if tag == "form" else set()
            if tag in CONTAINER or names & AGAINST or unseen:
                parents.append(containers[-1])
                depths.append(depths[containers[-1]] + 1)
                containers.append(len(parents) - 1)
                tags = tags | {tag} | unseen
                if tag in ("main", "article") or names & IN_FAVOUR and not names & AGAINST:
                    tags = tags - {"form", "fieldset"}  # a form around the content is none of its parts
                against = against or bool(names & AGAINST)
                in_favour = (in_favour or bool(names & IN_FAVOUR)) and not names & AGAINST
        stack.append((tag, containers[-1], tags, against, in_favour))
        open_tags[tag] += 1
        in_link += tag == "a"
    flush()
    return out


def _find_end(html: str, tag: str, at: int) -> int:
    m = re.compile(f"</{tag}", re.I).search(html, at)
    return m.start() if m else -1


def _raw_ends(html: str, tag: str) -> dict[int, int]:
    """Where each element of this kind begins, and the place behind its end tag; one that is never closed is absent: what follows it counts as text."""
    ends, begun = {}, []
    for m in re.compile(f"<(/?){tag}(?=[\\s/>])[^>]*>", re.I).finditer(html):
        if not m[1]:
            begun.append(m.start())
        elif begun:
            ends[begun.pop()] = m.end()
    return ends


FEATURES = 14
#: The score of what no reader sees, below that of anything else.
UNSEEN = -60.0


def features(s: Segment, place: float) -> list[float]:
    t = s.tags
    return [
        1.0,
        float("article" in t or "main" in t),
        float(bool(t & {"nav", "menu"})),
        float("aside" in t),
        float("footer" in t),
        float("header" in t and not t & {"article", "main"}),
        float(bool(t & {"form", "fieldset", "dialog"})),
        float(s.against),
        float(s.in_favour),
        s.linked / s.chars,
        min(np.log1p(s.chars) / 8, 1.2),
        min(s.marks / s.chars * 20, 2.0),
        s.items / len(s.texts),
        place,
    ]


def labelled_segments(pages: int = 400, seed: int = 23) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels (1 content) of the segments of made-up pages of many layouts: the bounded training set."""
    import random

    rng, rows, labels = random.Random(seed), [], []
    words = lambda n: " ".join("".join(rng.choices("an er on re in ti es en th ou le".split(), k=rng.randint(1, 3))) for _ in range(n))
    prose = lambda n: "".join(f"<p>{words(rng.randint(1, 60))}, {words(rng.randint(1, 9))}.</p>" for _ in range(n))
    links = lambda n: "<ul>" + "".join(f"<li><a href='/x'>{words(rng.randint(1, 3))}</a></li>" for _ in range(n)) + "</ul>"
    for _ in range(pages):
        semantic = rng.random() < 0.6
        box = lambda tag, name, inner: f"<{tag}>{inner}</{tag}>" if semantic else f"<div class='{name}'>{inner}</div>"
        parts = [(0, box("nav", "menu", links(rng.randint(3, 9))))]
        if rng.random() < 0.6:
            parts.append((0, box("header", "header", words(3) + links(2))))
        if rng.random() < 0.5:
            parts.append((0, f"<div class='{rng.choice(['ad', 'banner', 'cookie-notice', 'promo', 'newsletter'])}'>{words(rng.randint(3, 20))}.</div>"))
        notice = lambda: f"<{(t := rng.choice(['p', 'div', 'aside']))} class='{rng.choice(['ad', 'advert', 'promo', 'share', 'newsletter', 'related'])}'>zz {words(rng.randint(1, 12))}.</{t}>"
        cells = lambda: "<table>" + "".join(f"<tr><td>{words(rng.randint(1, 2))}</td><td>{rng.randint(1, 999)}</td></tr>" for _ in range(rng.randint(1, 5))) + "</table>"
        body = [f"<h1>{words(6)}</h1>" + prose(rng.randint(1, 5)) + (cells() if rng.random() < 0.3 else "") + (notice() if rng.random() < 0.4 else "") + prose(rng.randint(1, 4)) for _ in range(rng.randint(1, 2))]
        name = rng.choice(["content", "post", "entry-content", "", ""])
        for i, b in enumerate(body):
            parts.append((1, f"<article>{b}</article>" if semantic else f"<div class='{name}'>{b}</div>"))
            if rng.random() < 0.3:
                parts.append((0, f"<div class='ads'>{words(8)}.</div>"))
        if rng.random() < 0.5:
            parts.append((0, box("aside", "sidebar", rng.choice([links(5), prose(2)]))))
        if rng.random() < 0.5:
            parts.append((0, f"<{rng.choice(['section', 'div', 'ol'])} class='comments'>{prose(rng.randint(1, 6))}</div>"))
        if rng.random() < 0.4:
            parts.append((0, f"<form>{words(4)}<p>{words(3)}</p></form>"))
        parts.append((0, box("footer", "footer", words(rng.randint(3, 14)) + rng.choice([".", links(3)]))))
        found = [(y and not s.texts[0].startswith("zz "), s) for y, p in parts for s in segments(p)]
        for i, (y, s) in enumerate(found):
            rows.append(features(s, i / max(len(found) - 1, 1)))
            labels.append(y)
    return np.array(rows), np.array(labels, float)


def fit(data: tuple[np.ndarray, np.ndarray] | None = None, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights of a logistic classifier by Newton steps."""
    x, y = labelled_segments() if data is None else data
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
    return w


def minimum_cut(content: list[float], boilerplate: list[float], ties: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes are content in the labelling of least cost, by maximum flow (level graphs and blocking paths).

    content[i] and boilerplate[i] are the costs of giving node i that label; a tie (i, j, c) costs c if i and j differ.
    """
    n = len(content)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def edge(a: int, b: int, forth: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        room.append(forth)
        out[b].append(len(to))
        to.append(a)
        room.append(back)

    for i in range(n):
        shared = min(content[i], boilerplate[i])  # flows straight through
        if boilerplate[i] > shared:
            edge(source, i, boilerplate[i] - shared, 0.0)
        elif content[i] > shared:
            edge(i, sink, content[i] - shared, 0.0)
    for i, j, c in ties:
        edge(i, j, c, c)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if room[e] > 1e-12 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        next_edge = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                first = next(k for k, e in enumerate(path) if room[e] <= 1e-12)
                a = to[path[first] ^ 1]
                del path[first:]
                continue
            while next_edge[a] < len(out[a]):
                e = out[a][next_edge[a]]
                if room[e] > 1e-12 and level[to[e]] == level[a] + 1:
                    break
                next_edge[a] += 1
            if next_edge[a] < len(out[a]):
                path.append(out[a][next_edge[a]])
                a = to[path[-1]]
            elif path:
                e = path.pop()
                a = to[e ^ 1]
                next_edge[a] += 1
            else:
                break


def main_text(html: str | None, weights: np.ndarray, next_to: float = 0.3, same_tree: float = 0.8) -> str:
    """Content blocks in page order, one to a line."""
    found = segments(html or "")
    if not found:
        return ""
    x = np.array([features(s, i / max(len(found) - 1, 1)) for i, s in enumerate(found)]) @ weights
    x[[s.hidden for s in found]] = UNSEEN
    against = np.logaddexp(0, -x)  # minus log of the belief that it is content
    favour = np.logaddexp(0, x)
    ties = []
    for i, s in enumerate(found[1:], 1):
        ties.append((i - 1, i, next_to))
        # of all earlier segments, none shares a deeper container with this one than the segment before
        if s.shared > 1:
            ties.append((i - 1, i, same_tree * s.shared / max(s.depth, found[i - 1].depth)))
    keep = minimum_cut(against.tolist(), favour.tolist(), ties)
    return "\n".join(t for s, k in zip(found, keep) if k for t in s.texts)


def extract(pages: DataFrame, weights: np.ndarray | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text and n_chars (code points).

    Character references are decoded, white space within a block becomes one blank, blocks are joined by a line
    end. A null or empty page and one without content have an empty text; repeated rows give the same text each;
    an empty table gives no rows; columns beside the named ones are ignored.
    """
    w = fit() if weights is None else weights
    source = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    schema = ", ".join(f"{n} {t}" for n, t in source.dtypes[:2]) + ", text string"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["text"] = [main_text(h, w) for h in batch.pop("html")]
            yield batch

    return source.mapInPandas(read, schema).withColumn("n_chars", F.length("text").cast("long"))
