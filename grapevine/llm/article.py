"""Main text of web pages by scoring their trees.

Markup is cut into tags and text, and tags into a tree with HTML's implied ends. Parts that name themselves as something else go
first: by element (navigation, footers, forms, scripts ..), role, or words of class and id (menu, cookie, comments ..). Every block of
text then passes points for its length and commas to its ancestors: all to its parent, half to the next, a share that falls with the
distance to those above. An ancestor's points are discounted by the share of its text that is link text. The best container is
kept, or the article or main element around it, with those of its siblings that score a fifth of it or are plain paragraphs.

One page is one row and stays in its task; work is linear in its markup. Null and empty pages have no blocks. Broken markup is read as
far as it goes: what is not closed ends with its page. Each input row is one output row, whatever its other columns and repetitions.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

TOKEN = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))"""  # a comment
    r"""|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attributes>(?:[^>="']++|=\s*+"[^"]*+"|=\s*+'[^']*+'|[="'])*+)(?:>|\Z)"""
    r"""|<[!?/][^>]*+(?:>|\Z)""",  # declarations and what reads as a comment
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
NAME_PART = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
BLOCKS = frozenset(
    "html body main article section div header footer nav aside p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th "
    "blockquote pre figure figcaption address details summary fieldset form hr center menu dialog hgroup search template noscript".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# what a start tag ends, up to the elements that hold such parts
ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])), "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])), "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tbody": (frozenset(["thead", "tbody", "tr", "td", "th"]), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
SCOPE = frozenset("table td th caption button object template html body".split())

# other than text, wherever they are
NEVER = RAW | frozenset(
    "head nav footer aside button select noscript template svg canvas object embed audio video dialog menu search".split())
OTHER_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form status tablist toolbar".split())
# words of class and id; comments may hold most of a page's text, the others are passed over if they do
COMMENTS = frozenset("comment comments disqus respond replies discussion".split())
OTHER = frozenset(
    "ad ads adsbygoogle advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promoted banner cookie cookies consent gdpr notice notices "
    "popup modal overlay newsletter subscribe subscription signup login menu nav navbar navigation breadcrumb breadcrumbs topbar toolbar masthead "
    "footer sidebar sidebars rail related recommended recommendations share sharing social pagination pager tags alert "
    "disclaimer skip paywall survey".split())
TITLES = frozenset(["header"])  # of the page, or of the article: then only its headings are text
GOOD = frozenset("article body content entry main post story text page blog hentry".split())
WEIGHTS = {"article": 25, "main": 15, "div": 5, "section": 5, "pre": 3, "td": 3, "blockquote": 3, "ul": -3, "ol": -3, "dl": -3, "li": -3, "address": -3}
COMMAS = re.compile(r"[,،、，]")
LONG, SENTENCE, FULL = 80, 25, 300  # characters
SHARE, LEAST = 0.2, 10.0
LINKS = 0.8


class Page:
    """The tree of a page: nodes in page order, and events (a node's start, its end as ~node, or text)."""

    def __init__(self, source: str):
        self.tags, self.parents, self.attributes = ["#page"], [-1], [""]
        self.events: list[int | str] = []
        self.open = [0]
        at = 0
        while at < len(source):
            token = TOKEN.search(source, at)
            if token is None:
                self.text(source[at:])
                break
            self.text(source[at:token.start()])
            at = token.end()
            if (name := token["name"]) is None:
                continue
            name = name.lower()
            if token["end"]:
                self.end(name)
            else:
                self.start(name, token["attributes"])
                if name in RAW:  # up to its end tag, whatever stands there
                    close = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(source, at)
                    at = close.end() if close else len(source)
                    self.end(name)
        while len(self.open) > 1:
            self.events.append(~self.open.pop())

    def text(self, raw: str) -> None:
        if raw:
            self.events.append(html.unescape(raw) if "&" in raw else raw)

    def close_to(self, depth: int) -> None:
        while len(self.open) > depth:
            self.events.append(~self.open.pop())

    def start(self, name: str, attributes: str) -> None:
        if name in ENDS:
            which, holders = ENDS[name]
            for depth in range(len(self.open) - 1, 0, -1):
                tag = self.tags[self.open[depth]]
                if tag in which:
                    self.close_to(depth)
                elif tag in holders:
                    break
        if name in BLOCKS:
            for depth in range(len(self.open) - 1, 0, -1):
                tag = self.tags[self.open[depth]]
                if tag == "p" or (tag in HEADINGS and name in HEADINGS):
                    self.close_to(depth)
                    break
                if tag in BLOCKS or tag in SCOPE:
                    break
        node = len(self.tags)
        self.tags.append(name)
        self.parents.append(self.open[-1])
        self.attributes.append(attributes)
        self.events.append(node)
        if name in VOID:
            self.events.append(~node)
        else:
            self.open.append(node)

    def end(self, name: str) -> None:
        if name == "br":
            return self.start("br", "")
        if name in ("html", "body"):  # what follows still belongs to the page
            return None
        for depth in range(len(self.open) - 1, 0, -1):
            tag = self.tags[self.open[depth]]
            if tag == name or (name in HEADINGS and tag in HEADINGS):
                return self.close_to(depth)
            if tag in BLOCKS and (name not in BLOCKS or tag in SCOPE and name != "table"):
                return None
        return None


def words_of_names(attributes: str) -> tuple[set[str], str, bool]:
    """(words of class and id, role, whether hidden)."""
    names, role, hidden = set(), "", False
    for key, *values in ATTRIBUTE.findall(attributes):
        value = next(filter(None, values), "")
        key = key.lower()
        if key in ("class", "id"):
            names.update(part.lower() for part in NAME_PART.findall(value))
        elif key == "role":
            role = value.strip().lower()
        elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            hidden = True
        elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE):
            hidden = True
    return names, role, hidden


def summed_up(values: list[float], parents: list[int]) -> list[float]:
    """Each node's value with those of all nodes in it."""
    total = list(values)
    for node in range(len(total) - 1, 0, -1):
        total[parents[node]] += total[node]
    return total


class Scored:
    """What goes, and the points of what stays."""

    def __init__(self, page: Page):
        self.page = page
        tags, parents, n = page.tags, page.parents, len(page.tags)
        self.names = [words_of_names(a) if a else (set(), "", False) for a in page.attributes]
        in_paragraph, in_link, self.block = [False] * n, [False] * n, [0] * n
        for node in range(1, n):
            parent = parents[node]
            in_paragraph[node] = tags[node] == "p" or in_paragraph[parent]
            in_link[node] = tags[node] == "a" or in_link[parent]
            self.block[node] = node if tags[node] in BLOCKS else self.block[parent]
        self.texts = [  # (node, characters, commas) of each text
            (node, len(flat), len(COMMAS.findall(flat)))
            for node, text in self.placed_texts() if (flat := " ".join(text.split()))
        ]
        paragraphs = [0.0] * n
        for node, size, _ in self.texts:
            paragraphs[node] += size * in_paragraph[node]
        self.paragraphs = summed_up(paragraphs, parents)
        self.holds = summed_up([self.is_article(node) for node in range(n)], parents)
        self.gone, self.titles = [False] * n, [False] * n
        inside = [False] * n  # an article or main element
        for node in range(1, n):
            parent = parents[node]
            inside[node] = inside[parent] or self.is_article(node)
            self.gone[node] = self.gone[parent] or self.is_other(node)
            if not self.gone[node] and self.is_title(node) and not self.is_most(node):
                self.titles[node] = inside[parent]
                self.gone[node] = not inside[parent]
        own, links, points = [0.0] * n, [0.0] * n, [0.0] * n
        chars, commas = [0] * n, [0] * n
        for node, size, marks in self.texts:
            if not self.gone[node]:
                own[node] += size
                links[node] += size * in_link[node]
                chars[self.block[node]] += size
                commas[self.block[node]] += marks
        self.size, self.link_size = summed_up(own, parents), summed_up(links, parents)
        link_count = summed_up([float(tag == "a") for tag in tags], parents)
        for node in range(1, n):
            if not self.gone[node] and tags[node] in ("ul", "ol", "dl", "table", "div", "section") and link_count[node] > 1:
                self.gone[node] = self.link_density(node) >= LINKS
            self.gone[node] = self.gone[node] or self.gone[parents[node]]
        touched = [False] * n
        for node in range(n):
            if chars[node] and not self.gone[node] and tags[node] not in HEADINGS:
                worth = (chars[node] >= SENTENCE) + commas[node] + min(chars[node], FULL) / 100
                up, level = parents[node] if tags[node] in ("p", "li", "dd", "dt") else node, 0
                while up >= 0:
                    points[up] += worth if level == 0 else worth / 2 if level == 1 else worth / (3 * level)
                    touched[up] = True
                    up, level = parents[up], level + 1
        self.score = [
            (points[node] + WEIGHTS.get(tags[node], 0) + (GOOD & self.names[node][0] != set()) * 10) * (1 - self.link_density(node)) if touched[node] else 0.0
            for node in range(n)
        ]
        self.touched = touched

    def placed_texts(self) -> Iterator[tuple[int, str]]:
        """(node, text) of all texts."""
        at = 0
        for event in self.page.events:
            if isinstance(event, str):
                yield at, event
            else:
                at = event if event >= 0 else self.page.parents[~event]

    def link_density(self, node: int) -> float:
        return self.link_size[node] / self.size[node] if self.size[node] else 0.0

    def is_article(self, node: int) -> bool:
        names, role, _ = self.names[node]
        return (self.page.tags[node] in ("article", "main") or role in ("main", "article")) and not names & (COMMENTS | OTHER)

    def is_most(self, node: int) -> bool:
        """Whether a node holds an article or over half of the paragraphs."""
        return self.holds[node] > 0 or 2 * self.paragraphs[node] > max(self.paragraphs[0], 1)

    def is_title(self, node: int) -> bool:
        return self.page.tags[node] in TITLES or (bool(TITLES & self.names[node][0]) and self.page.tags[node] in BLOCKS)

    def is_other(self, node: int) -> bool:
        tag, (names, role, hidden) = self.page.tags[node], self.names[node]
        if tag in NEVER or hidden:
            return True
        if tag in ("html", "body", "main"):
            return False
        if names & COMMENTS and self.holds[node] == 0:
            return True
        named = tag in ("form", "fieldset") or role in OTHER_ROLES or (bool(names & OTHER) and tag not in HEADINGS)
        return named and not self.is_most(node)

    def container(self) -> int:
        """The best node; the article or main element around it, if there is one."""
        some = [node for node, touched in enumerate(self.touched) if touched and not self.gone[node]]
        if not some:
            return 0
        best = max(some, key=lambda node: (self.score[node], -node))
        up = best
        around = []
        while up > 0:
            if self.is_article(up):
                around.append(up)
            up = self.page.parents[up]
        articles = [node for node in around if self.page.tags[node] != "main"]
        return articles[-1] if articles else around[-1] if around else best

    def kept(self) -> tuple[int, set[int]]:
        """(the container, it and its siblings that belong to the text)."""
        best = self.container()
        if best == 0:
            return 0, {0}
        tags, parents, parent = self.page.tags, self.page.parents, self.page.parents[best]
        alike = self.is_article(best)
        kept, enough = {best}, max(LEAST, SHARE * self.score[best])
        for node in range(parent + 1, len(tags)):
            if parents[node] != parent or node == best or self.gone[node]:
                continue
            if alike and self.is_article(node):
                keep = self.score[node] >= enough
            elif alike:
                keep = False
            elif tags[node] == "p":
                keep = self.link_density(node) < (0.25 if self.size[node] > LONG else 1e-9) and self.size[node] > 0
            else:
                keep = self.score[node] >= enough or (tags[node] == "h1" and node < best)
            if keep:
                kept.add(node)
        return best, kept


def main_text(source: str | None) -> tuple[list[str], str, float]:
    """(blocks of the main text, the container's tag with its class and id words, its score)."""
    page = Page(source or "")
    scored = Scored(page)
    best, kept = scored.kept()
    blocks, current = [], []
    within = title = heading = gone = 0  # how many of the open nodes are such

    def flush() -> None:
        if flat := " ".join("".join(current).split()):
            blocks.append(flat)
        current.clear()

    for event in page.events:
        if isinstance(event, str):
            if (within or best == 0) and not gone and (heading or not title):
                current.append(event)
            continue
        node, step = (event, 1) if event >= 0 else (~event, -1)
        tag = page.tags[node]
        if tag in BLOCKS:
            flush()
        elif tag == "br":
            current.append(" ")
        within += step * (node in kept)
        gone += step * scored.gone[node]
        title += step * scored.titles[node]
        heading += step * (tag in HEADINGS)
    flush()
    name = page.tags[best] if best else "body"
    return blocks, " ".join([name, *sorted(scored.names[best][0])]), float(scored.score[best])


def extract(pages: DataFrame, source: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of every page with its ``blocks`` of main text, their ``container`` and its ``score``."""
    schema = StructType([pages.schema[c] for c in keep] + [
        StructField("blocks", ArrayType(StringType())), StructField("container", StringType()), StructField("score", DoubleType())])

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(page.as_py()) for page in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array([f[0] for f in found], pa.list_(pa.string())), pa.array([f[1] for f in found], pa.string()),
                 pa.array([f[2] for f in found], pa.float64())],
                names=[*keep, "blocks", "container", "score"])

    return pages.select(F.col(source).alias("_page"), *keep).mapInArrow(extracted, schema)
