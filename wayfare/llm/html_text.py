"""Main text of web pages by scoring the tree of their markup.

Each page becomes a tree.  Every paragraph (a run of text between block borders) passes
points for its length and its commas to its container, half of them to the next ancestor and
ever less further up; a container's points are discounted by the share of its text that lies in links.
The best container and those of its siblings that read like text are kept, without the parts
that their element, role or class calls menus, headers, footers, sidebars, notices, adverts, forms or
comments, and without lists of bare links.  Pages are single rows, so that nothing is shuffled; a page's tree is
the only thing held, and at most ``LEVELS`` ancestors get points of a paragraph.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfare.llm.storage import bound_batches

#: Ancestors that a paragraph gives points to.
LEVELS = 5
#: A sibling container is kept from this share of the best one's points on.
SIBLING_SHARE = 0.2

# Elements of the HTML standard by what they are.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes noscript script style textarea title xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol "
    "p pre search section summary table tbody tfoot thead tr caption ul".split()
)
CELLS = frozenset({"td", "th"})
#: Blocks that are paragraphs themselves: their points go to what holds them.
LEAVES = frozenset("address blockquote caption dd dt figcaption h1 h2 h3 h4 h5 h6 legend li p pre summary td th tr".split())
HEADINGS = frozenset({"h1", "h2", "h3", "h4", "h5", "h6"})
LISTS = frozenset({"ul", "ol", "dl", "dir", "menu"})
#: What an opening tag closes, up to the given borders.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "dir", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}

# What is not the article, by element, by role, by words of class and id, by item type, by a block's whole text.
DROPPED = frozenset("nav footer aside form button select option datalist template dialog menu search svg math canvas object embed audio video map".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
WORDS = frozenset(
    "ad ads adbox adsense advert adverts advertisement advertising adslot banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus dropdown footer footnav gdpr "
    "header hidden login masthead menu menus modal nav navbar navigation navlinks newsletter notice notices notification overlay pager pagination paywall popup promo promos promotion related "
    "replies respond rail search share sharing sharebar sidebar sidebars sidenav signup skiplink social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
#: After one of these words the next is not what the element is.
LAYOUT = frozenset("has is no not with without".split())
ITEM_TYPES = re.compile(r"schema\.org/(?:Comment|UserComments|WPHeader|WPFooter|WPSideBar|WPAdBlock|SiteNavigationElement)", re.I)
LABELS = re.compile(r"(?:advertisement|advert|sponsored|anzeige|werbung|publicité|publicidad)[.:]?", re.I)
COMMENT_TITLES = re.compile(r"(?:\d+\s+)?(?:reader\s+)?(?:comments?|responses|replies|leave a (?:comment|reply)|kommentare?|commentaires?|comentarios?)(?:\s*\(\d+\))?:?", re.I)
GOOD_WORDS = frozenset("article body content entry main post story text".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?)*+)>")
_ATTRIBUTE = re.compile(r"""([^\s/=>"']+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]*+)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SENTENCE = re.compile(r"[.!?…。！？][\"'»”’)\]]?$")
_RIGHTS = re.compile(r"©|\(c\)|copyright", re.I)
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_RAW_END = {name: re.compile(f"</{name}(?=[\\s/>])", re.I) for name in RAW}


class Node:
    """An element: its parts are texts and elements in page order."""

    #: dropped: not text; named: by role, class or id something else; within: in the article; byline: in its header, but no heading
    __slots__ = ("tag", "parent", "parts", "dropped", "named", "within", "byline", "good", "holds_main", "chars", "linked", "points", "order")

    def __init__(self, tag: str, parent: Node | None, order: int):
        self.tag, self.parent, self.order = tag, parent, order
        self.parts: list[str | Node] = []
        self.dropped = self.named = self.within = self.byline = self.good = self.holds_main = False
        self.chars = self.linked = 0
        self.points = 0.0

    def link_share(self) -> float:
        return self.linked / self.chars if self.chars else 0.0


def _words(names: str) -> tuple[bool, bool]:
    """Whether class and id call an element something else than text, and whether they call it text."""
    bad = good = False
    for name in names.split():
        found = [w.lower() for w in _WORD.findall(name)]
        bad = bad or any(w in WORDS and (i == 0 or found[i - 1] not in LAYOUT) for i, w in enumerate(found)) or ("side" in found and ("bar" in found or "column" in found))
        good = good or any(w in GOOD_WORDS for w in found)
    return bad, good


def _describe(node: Node, attributes: str) -> None:
    values = {name.lower(): a or b or c for name, a, b, c in reversed(_ATTRIBUTE.findall(attributes))}
    role = html.unescape(values.get("role", "")).strip().lower()
    bad, node.good = _words(html.unescape(values.get("class", "") + " " + values.get("id", "")))
    node.named = bad or role in ROLES or bool(ITEM_TYPES.search(values.get("itemtype", ""))) or values.get("itemprop", "").lower() == "comment"
    node.dropped = "hidden" in values or values.get("aria-hidden", "").lower() == "true" or bool(_UNSEEN.search(values.get("style", "")))
    if role in ("main", "article") or "articlebody" in values.get("itemprop", "").lower():
        node.holds_main = True


def parse(page: str) -> tuple[Node, list[Node]]:
    """The tree of a page and its elements in page order; every text is a tree, however broken its markup."""
    root = Node("body", None, 0)
    nodes, stack, opened = [root], [root], Counter({"body": 1})
    at, size, head = 0, len(page), False

    def close(count: int) -> None:
        while len(stack) > count:
            opened[stack.pop().tag] -= 1

    while at < size:
        mark = page.find("<", at)
        text = page[at : mark if mark >= 0 else size]
        if text and not (head and text.isspace()):
            stack[-1].parts.append(html.unescape(text))
        if mark < 0:
            break
        if page.startswith("<!--", mark):
            if page.startswith((">", "->"), mark + 4):
                at = page.index(">", mark) + 1
                continue
            end = page.find("-->", mark + 4)
            at = end + 3 if end >= 0 else size
            continue
        following = page[mark + 1 : mark + 2]
        if following in ("!", "?") or (following == "/" and not page[mark + 2 : mark + 3].isalpha()):
            end = page.find(">", mark)
            at = end + 1 if end >= 0 else size
            continue
        if following != "/" and not (following.isascii() and following.isalpha()):
            stack[-1].parts.append("<")
            at = mark + 1
            continue
        found = _TAG.match(page, mark)
        if not found:  # cut off within a tag
            break
        at, tag = found.end(), found[2].lower()
        if found[1]:
            if opened[tag] and tag not in ("body", "html"):
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                close(k)
            elif tag == "head":
                head = False
            elif tag == "br":
                stack[-1].parts.append(" ")
            continue
        if tag in ("html", "body", "head"):
            head = tag == "head"
            continue
        if tag in RAW:
            end = _RAW_END[tag].search(page, at)
            at = page.find(">", end.end()) + 1 or size if end else size
            continue
        if tag in VOID:
            if tag == "hr":
                nodes.append(Node(tag, stack[-1], len(nodes)))
                stack[-1].parts.append(nodes[-1])
            elif tag == "br":
                stack[-1].parts.append(" ")
            continue
        ends, borders = CLOSES.get(tag, ((), ()))
        if any(opened[e] for e in ends):
            k = len(stack) - 1
            while k and stack[k].tag not in borders:
                if stack[k].tag in ends:
                    close(k)
                k -= 1
        elif tag in BLOCK and opened["p"]:
            k = len(stack) - 1
            while k and stack[k].tag != "p" and stack[k].tag not in CELLS and stack[k].tag not in ("button", "object", "table"):
                k -= 1
            if stack[k].tag == "p":
                close(k)
        node = Node(tag, stack[-1], len(nodes))
        if found[3]:
            _describe(node, found[3])
        if found[3].endswith("/") and tag not in BLOCK and tag != "a" and opened["svg"]:
            continue
        stack[-1].parts.append(node)
        nodes.append(node)
        stack.append(node)
        opened[tag] += 1
    return root, nodes


def _mark(nodes: list[Node]) -> None:
    """Which elements are dropped, and which hold the article; what holds it is not dropped for its name or as a form or header."""
    for node in nodes:
        node.holds_main = (node.holds_main or node.tag in ("article", "main")) and not node.named
        node.within = node.holds_main or bool(node.parent and node.parent.within)
    for node in reversed(nodes):
        if node.parent and node.holds_main and node.tag not in ("nav", "footer", "aside"):
            node.parent.holds_main = True
    for node in nodes:
        if node.parent is None:
            continue
        node.byline = node.within and node.tag not in HEADINGS and (node.tag == "header" or node.parent.byline)
        named = node.named or node.tag in DROPPED or (node.tag == "header" and not node.within)
        node.dropped = node.dropped or node.parent.dropped or (named and not node.holds_main)


def _squeeze(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


def blocks(top: Node) -> Iterator[tuple[Node, str, int]]:
    """Blocks below an element in page order: the element that holds the text, the text, and how much of it lies in links."""
    todo: list[tuple[Node, Iterator, bool]] = [(top, iter(top.parts), False)]
    holder, run, linked = top, [], []
    holders = [top]

    def flush() -> Iterator[tuple[Node, str, int]]:
        text = _squeeze(run)
        if text:
            yield holder, text, len(_squeeze(linked))
        run.clear()
        linked.clear()

    while todo:
        node, rest, link = todo[-1]
        part = next(rest, None)
        if part is None:
            todo.pop()
            if node.tag in BLOCK or node.tag in CELLS:
                if node.tag in BLOCK:
                    yield from flush()
                else:
                    run.append(" ")
                holders.pop()
                holder = holders[-1] if holders else top
        elif isinstance(part, str):
            run.append(part)
            if link:
                linked.append(part)
        elif not part.dropped:
            if part.tag in BLOCK:
                yield from flush()
                holders.append(part)
                holder = part
            elif part.tag in CELLS:
                run.append(" ")
                holders.append(part)
                holder = part
            todo.append((part, iter(part.parts), link or part.tag == "a"))
    yield from flush()


def _drop_link_lists(nodes: list[Node], counts: dict[int, list[int]]) -> None:
    """Lists of three and more short bare links are menus."""
    for node in nodes:
        items, bare, chars = counts.get(node.order, (0, 0, 0))
        if node.tag in LISTS and items >= 3 and bare == items and chars <= 40 * items:
            node.dropped = True


def _drop_comments(found: list[tuple[Node, str, int]], total: int) -> None:
    """A heading that says comments drops the part that it begins, unless that is most of the page."""
    for holder, text, _ in found:
        part = holder.parent
        if holder.tag in HEADINGS and COMMENT_TITLES.fullmatch(text) and part is not None and part.parent is not None and 2 * part.chars < total:
            first = next((p for p in part.parts if not isinstance(p, str) or p.strip()), None)
            if first is holder:
                part.dropped = True


def main_node(root: Node, nodes: list[Node]) -> list[Node]:
    """The best container with its siblings that are text, in page order; none if the page has no text."""
    _mark(nodes)
    found = list(blocks(root))
    counts: dict[int, list[int]] = {}
    for holder, text, linked in found:
        holder.chars += len(text)
        holder.linked += linked
        up = holder
        while up is not None and up.tag not in LISTS and up.tag in ("li", "p", "dt", "dd", "div", "span"):
            up = up.parent
        if up is not None and up.tag in LISTS:
            entry = counts.setdefault(up.order, [0, 0, 0])
            entry[0] += 1
            entry[1] += linked == len(text)
            entry[2] += len(text)
    for node in reversed(nodes):
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.linked += node.linked
    _drop_link_lists(nodes, counts)
    _drop_comments(found, root.chars)
    for node in nodes:
        if node.parent is not None and node.parent.dropped:
            node.dropped = True
    candidates: dict[int, Node] = {}
    for holder, text, linked in found:
        if holder.dropped or holder.byline or LABELS.fullmatch(text):
            continue
        points = (1 + text.count(",") + text.count("，") + len(text) / 100) * (1 - linked / len(text))
        up = holder.parent if _is_paragraph(holder) and holder.parent is not None else holder
        while up.parent is not None and (up.tag in LISTS or up.tag not in BLOCK | CELLS or up.tag in ("tr", "tbody", "thead", "tfoot", "table", "p")):
            up = up.parent
        for level in range(LEVELS):
            if up.order not in candidates:
                candidates[up.order] = up
                up.points = 25.0 * up.good + 25.0 * (up.tag in ("article", "main"))
            up.points += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            if up.parent is None:
                break
            up = up.parent
    if not candidates:
        return []
    best = max(candidates.values(), key=lambda n: (n.points * (1 - n.link_share()), -n.order))
    up = best
    while up is not None:  # the article that the best container lies in
        if up.tag == "article" or (up.tag == "main" and best.tag != "article"):
            best = up
        up = up.parent
    if best.parent is None:
        for part in best.parts:
            if not isinstance(part, str) and part.chars and (part.link_share() > 0.5 or (part.tag == "div" and _RIGHTS.match(_squeeze([t for _, t, _ in blocks(part)])))):
                part.dropped = True
        return [best]
    least = max(10.0, SIBLING_SHARE * best.points)
    kept = []
    for part in best.parent.parts:
        if isinstance(part, str) or part.dropped:
            continue
        if part is best or (part.link_share() < 0.25 and _is_text(part, best, least)):
            kept.append(part)
    return kept


def _is_paragraph(node: Node) -> bool:
    """A paragraph, or a division of one run of text."""
    return node.tag in LEAVES or (node.tag == "div" and not any(not isinstance(p, str) and (p.tag in BLOCK or p.tag in CELLS) for p in node.parts))


def _is_text(part: Node, best: Node, least: float) -> bool:
    if part.tag in HEADINGS:
        return True
    if part.tag in ("p", "blockquote", "pre") or (part.tag == "div" and _is_paragraph(part)):
        text = _squeeze([t + " " for _, t, _ in blocks(part)])
        return len(text) > 80 or (part.linked == 0 and bool(_SENTENCE.search(text)))
    if part.points >= least or (part.tag == best.tag == "article" and part.chars > 0):
        return True
    texts = list(blocks(part)) if part.tag in ("div", "section") else []
    return bool(texts) and part.linked == 0 and all(holder.tag == "p" for holder, _, _ in texts) and bool(_SENTENCE.search(texts[-1][1])) and not _RIGHTS.match(texts[0][1])


def main_text(page: str | None) -> tuple[str, str]:
    """Text of a page's article and the element it was found in; both empty if there is none."""
    if not page:
        return "", ""
    root, nodes = parse(page)
    kept = main_node(root, nodes)
    lines = [text for part in kept for holder, text, _ in blocks(part) if not holder.byline and not LABELS.fullmatch(text)]
    best = max(kept, key=lambda n: n.points, default=None)
    return "\n".join(lines), best.tag if best is not None and lines else ""


def extract_main_text(pages: DataFrame, keep: list[str] | None = None, html_column: str = "html") -> DataFrame:
    """Pages with ``text``, ``n_chars`` (code points) and ``container`` (the element of the best container) of their article.

    One row for each row of ``pages``, repeated and null ids included, with the columns ``keep`` (all but the markup by default).
    A null or empty page and one without an article have an empty text and container.  A page without markup is one block of text.  Of
    equal containers the first is the best.  Pages of any length are read whole.  Columns of ``pages`` called ``text``, ``n_chars`` or
    ``container`` make place for the results.  An empty table gives an empty table.
    """
    bound_batches(pages.sparkSession)
    keep = [c for c in (keep or pages.columns) if c not in (html_column, "text", "n_chars", "container")]
    table = pages.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{html_column}`").cast("string").alias("__html"))
    schema = T.StructType([*[table.schema[c] for c in keep], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("container", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(page.as_py()) for page in batch["__html"]]
            columns = [batch[c] for c in keep] + [pa.array([t for t, _ in found], pa.string()), pa.array([len(t) for t, _ in found], pa.int64()), pa.array([c for _, c in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "text", "n_chars", "container"])

    return table.mapInArrow(run, schema)
