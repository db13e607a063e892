"""Main text of web pages by tag-path ratios (operator 8)."""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from epispark.llm.common import map_batches, text_slices

# Element names of HTML and words that mark page furniture.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
HIDDEN = frozenset("head title script style noscript template svg math iframe object canvas audio video select option textarea datalist dialog".split())
FURNITURE = frozenset("nav header footer aside form menu fieldset".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
            "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}),
            "option": ({"option"}, {"select"})}
MARKS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pagination pager popup promo promoted promotion related replies reply share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
ROOTS = frozenset({"html", "body", "article", "main"})
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CELLS = frozenset("li dt dd td th caption".split())
WHOLE = frozenset("ul ol menu dl table".split())
KEPT = WHOLE | {"pre", "blockquote", "figcaption"}
SITE = frozenset({"site", "global", "top"})
RUNNING = frozenset("p li dd dt td th blockquote figcaption caption".split()) | HEADINGS
DEEPEST = 400  # elements nested deeper become siblings; their text stays

# A comment, a tag (end mark, name, attributes), or another declaration.
_TOKEN = re.compile(r"""<(?:!--(?:-?>|.*?(?:--!?>|\Z))|(/?)([a-zA-Z][^\s/>]*)((?:[^>"'=]|=\s*"[^"]*"|=\s*'[^']*'|["'=])*+)>|[!?/][^>]*>)""", re.DOTALL)
_PLAIN_TOKEN = re.compile(r"<(?:!--(?:-?>|.*?(?:--!?>|\Z))|(/?)([a-zA-Z][^\s/>]*)([^>]*)>|[!?/][^>]*>)", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_TELLING = re.compile(r"class|id|role|hidden", re.IGNORECASE)
_RAW = {t: re.compile(rf"</{t}\b[^>]*>", re.IGNORECASE) for t in ("script", "style", "textarea", "title", "noscript", "iframe")}
_MARK = re.compile(r"[a-z0-9]+")
PUNCTUATION = ".,;:!?…。，！？؟"
_P_SCOPE = frozenset({"td", "th", "li", "div", "article", "section", "body"})


def _marked(attributes: str, inside: bool) -> int:
    """What class, id and role say of an element: 3 it is hidden or has the
    role of page furniture, 2 a whole name is a furniture word, 1 a name's
    last piece is, 0 nothing.  A header ``inside`` an article is its own."""
    if not _TELLING.search(attributes):
        return 0
    given = {m[1].lower(): unescape(m[2] or m[3] or m[4] or "").lower() for m in _ATTRIBUTE.finditer(attributes)}
    if "hidden" in given or given.get("aria-hidden") == "true" or given.get("role") in ROLES:
        return 3
    names = [_MARK.findall(n) for n in f"{given.get('class', '')} {given.get('id', '')}".split() if not n.startswith(("has-", "with-", "no-", "is-"))]
    if inside:
        names = [n for n in names if n[-1:] != ["header"]]
    if any(len(n) == 1 and n[0] in MARKS for n in names):
        return 2
    # ``entry-header`` is a part of the article, ``site-header`` is not.
    return int(any(n and n[-1] in MARKS and (n[-1] != "header" or n[0] in SITE) for n in names))


class _Page:
    """Tree of block elements and the text blocks in it, in page order.

    A node is (parent, tag, dropped, what ``_marked`` says short of dropping
    it); inline elements make no node, so an unclosed one cannot lengthen a
    path."""

    def __init__(self, html: str):
        self.nodes: list[tuple[int, str, bool, int]] = [(-1, "", False, 0)]
        self.open, self.tags = [0], [""]
        self.links = 0  # open links
        self.blocks: list[tuple[int, str, int]] = []  # node, text, characters in links
        self.parts: list[str] = []
        self.linked = 0
        at = read = 0  # text before ``read`` has been handed on
        tokens = _TOKEN
        while (at := html.find("<", at)) >= 0:
            token = tokens.match(html, at)
            if token is None:
                # A tag whose quotes never close: from here on quotes are not
                # minded, so a broken page is still read in one pass.
                if html.find(">", at) < 0:
                    break
                if tokens is _TOKEN and html[at + 1:at + 2].isalpha():
                    tokens = _PLAIN_TOKEN
                else:
                    at += 1
                continue
            if at > read:
                self.data(html[read:at])
            at = read = token.end()
            if token[2] is None:
                continue
            tag = token[2].lower()
            if token[1]:
                self.end(tag)
                continue
            self.start(tag, token[3])
            if tag in _RAW:
                closing = _RAW[tag].search(html, at)
                at = read = closing.end() if closing else len(html)
                self.end(tag)
        self.data(html[read:])
        self.flush()

    def flush(self):
        if self.parts:
            if text := " ".join("".join(self.parts).split()):
                self.blocks.append((self.open[-1], text, min(self.linked, len(text))))
            self.parts, self.linked = [], 0

    def _pop(self, depth: int):
        self.flush()
        del self.open[depth:], self.tags[depth:]

    def _close(self, ends, scope):
        """Close the innermost open element of ``ends`` within ``scope``."""
        for depth in range(len(self.open) - 1, 0, -1):
            if self.tags[depth] in ends:
                self._pop(depth)
                return
            if self.tags[depth] in scope:
                return

    def start(self, tag: str, attributes: str):
        if tag in VOID:
            if tag == "br":
                self.parts.append(" ")
            elif tag == "hr":
                self.flush()
            return
        inside = "article" in self.tags or "main" in self.tags
        marked = _marked(attributes, inside) if attributes else 0
        # A button in running text is a part of it, elsewhere it is a control.
        if (tag in INLINE or tag == "button" and self.tags[-1] in RUNNING) and not marked:
            self.links += tag == "a"
            return
        self.flush()
        self.links = 0
        if tag in CLOSES_P:
            self._close(("p",), _P_SCOPE)
        if tag in SIBLINGS:
            self._close(*SIBLINGS[tag])
        dropped = self.nodes[self.open[-1]][2] or tag in HIDDEN or tag == "button"
        if not dropped and (tag not in ROOTS or tag == "article"):
            dropped = marked == 3 or tag in FURNITURE and not (tag == "header" and inside)
        if len(self.open) > DEEPEST:
            self._pop(DEEPEST)
        if tag in ROOTS or inside and tag in HEADINGS:
            marked = 0
        self.nodes.append((self.open[-1], tag, dropped, marked % 3))
        self.open.append(len(self.nodes) - 1)
        self.tags.append(tag)

    def end(self, tag: str):
        if tag in INLINE and tag != self.tags[-1]:
            if tag == "a" and self.links:
                self.links -= 1
            return
        if tag in self.tags:
            self._pop(len(self.tags) - 1 - self.tags[::-1].index(tag))
            self.links = 0
        elif tag == "p":
            self.flush()

    def data(self, data: str):
        if not self.nodes[self.open[-1]][2]:
            data = unescape(data) if "&" in data else data
            self.parts.append(data)
            if self.links:
                self.linked += len(data.strip())


def _smooth(values: list[float]) -> list[float]:
    """Moving average over neighbouring paths with weights 1, 2, 1."""
    padded = [values[0], *values, values[-1]]
    return [(x + 2 * y + z) / 4 for x, y, z in zip(padded, padded[1:], padded[2:])]


def _scaled(values: list[float]) -> list[float]:
    most = max(values)
    return [v / most for v in values] if most > 0 else values


def path_scores(paths: list[str], units: list[int], texts: list[str], linked: list[int], share: float = 0.2) -> tuple[dict[str, float], float]:
    """Fused score of every tag path, and the threshold of content paths.

    Per path: text length outside links and punctuation, each over the number
    of its nodes (``units``).  Both ratios are smoothed over the nodes in page
    order, averaged with the path's own, scaled to 1 and fused by their
    geometric mean, times the share of the path's text outside links; the
    threshold is ``share`` of the highest fused score.
    """
    sums: dict[str, list[int]] = {}
    order: dict[int, str] = {}
    for path, unit, text, n in zip(paths, units, texts, linked):
        own = sums.setdefault(path, [0, 0, 0, 0])
        own[0] += unit not in order
        order.setdefault(unit, path)
        own[1] += max(len(text) - n, 0)
        own[2] += sum(map(text.count, PUNCTUATION))
        own[3] += len(text)
    if not sums:
        return {}, 0.0
    ratios = []
    for k in (1, 2):
        own = {path: s[k] / s[0] for path, s in sums.items()}
        near = dict.fromkeys(sums, 0.0)
        for path, v in zip(order.values(), _smooth([own[p] for p in order.values()])):
            near[path] += v / sums[path][0]
        ratios.append([(x + y) / 2 for x, y in zip(_scaled([*own.values()]), _scaled([*near.values()]))])
    fused = [(length * (marks + 0.05) / 1.05) ** 0.5 for length, marks in zip(*ratios)]
    return {path: f * (s[1] / s[3]) for (path, s), f in zip(sums.items(), fused)}, share * max(fused)


def _furniture(page: _Page, above: dict[int, tuple[int, ...]]) -> set[int]:
    """Nodes inside an element that its class or id names as furniture: by a
    whole name, or by the last piece of one if it holds under half of the
    page's text.  The longest article and main elements and what holds them
    are none, nor are headings in articles."""
    if not any(n[3] for n in page.nodes):
        return set()
    size = [0] * len(page.nodes)
    for node, text, _ in page.blocks:
        for n in above[node]:
            size[n] += len(text)
    content: set[int] = set()
    for tag in ("article", "main"):
        if own := [n for n, node in enumerate(page.nodes) if node[1] == tag and size[n]]:
            content.update(above[max(own, key=lambda n: (size[n], -n))])
    away: set[int] = set()
    for n, (parent, tag, _, marked) in enumerate(page.nodes):  # parents come first
        if n not in content and (parent in away or marked == 2 or marked and size[n] * 2 < size[0]):
            away.add(n)
    return away


def main_text(html: str | None) -> str:
    """The article's blocks of one page joined by a space; see ``extract``."""
    if not html:
        return ""
    page = _Page(html)
    blocks = page.blocks
    if not blocks:
        return ""
    above: dict[int, tuple[int, ...]] = {-1: ()}  # a node's ancestors from the root, itself included
    names: dict[int, str] = {-1: ""}
    for node, (parent, tag, *_) in enumerate(page.nodes):  # parents come first
        above[node] = (*above[parent], node)
        names[node] = f"{names[parent]}>{tag}"
    line = above.__getitem__
    # A block of a list or table counts for the whole list or table.
    units = [next((n for n in reversed(line(b[0])) if page.nodes[n][1] in WHOLE), b[0]) if page.nodes[b[0]][1] in CELLS else b[0] for b in blocks]
    paths = [names[u] for u in units]
    away = _furniture(page, above)
    tested = [i for i, b in enumerate(blocks) if page.nodes[b[0]][1] not in HEADINGS and b[0] not in away]
    scores, threshold = path_scores([paths[i] for i in tested], [units[i] for i in tested],
                                    [blocks[i][1] for i in tested], [blocks[i][2] for i in tested])
    for path in scores:  # lists, tables and the like in an article
        above_it = path.split(">")
        if above_it[-1] in KEPT and ("article" in above_it or "main" in above_it):
            scores[path] *= 1.5
    weight = [scores[p] * len(b[1]) if b[0] not in away and scores.get(p, -1.0) >= threshold else 0.0 for p, b in zip(paths, blocks)]
    total = sum(weight)
    inside: dict[int, float] = {}
    for block, w in zip(blocks, weight):
        for node in line(block[0]):
            inside[node] = inside.get(node, 0.0) + w
    # The content root: the page's one article (or main), or the best of
    # several; otherwise the deepest element that holds most of the selected
    # paths' weight.
    marked = [n for n in inside if page.nodes[n][1] in ("article", "main") and n not in away]
    articles = [n for n in marked if page.nodes[n][1] == "article"]
    root, own = 0, False
    if len(articles or marked) == 1:
        root, own = (articles or marked)[0], True
    elif marked and max(inside[n] for n in marked) >= 0.3 * total:
        root, own = max(marked, key=lambda n: (inside[n], -n)), True
    else:
        for node in sorted(inside):
            if page.nodes[node][0] == root and inside[node] >= 0.7 * total and page.nodes[node][1] not in ("p", "li", "td", "tr", "pre", "blockquote"):
                root = node
    # Within it the path scores choose; of an article, only paths that are
    # mostly links go for a low score, others are its text however short they
    # are.  A heading goes with what it heads, and stays if that is nothing.
    linked: dict[str, list[int]] = {}
    for i in tested:
        sums = linked.setdefault(paths[i], [0, 0])
        sums[0] += blocks[i][2]
        sums[1] += len(blocks[i][1])
    prose = {path for path, (links, all_) in linked.items() if 2 * links < all_} if own else set()
    kept, any_block, any_kept = [], False, False
    for block, path in zip(reversed(blocks), reversed(paths)):
        if root not in line(block[0]):
            continue
        if page.nodes[block[0]][1] in HEADINGS:
            chosen = any_kept or not any_block
            if block[0] in away:
                chosen = any_kept and any(page.nodes[n][1] in ("article", "main") for n in line(block[0]))
            any_block = any_kept = False
        else:
            chosen = block[0] not in away and (scores[path] >= threshold or path in prose)
            any_block, any_kept = True, any_kept or chosen
        if chosen:
            kept.append(block[1])
    return " ".join(reversed(kept))


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """``keep`` columns, ``text`` and ``n_chars`` (code points) per input row.

    Blocks of menus, page headers, footers, sidebars, notices, adverts,
    forms, comments and hidden elements are left out by their element, role
    or class (a whole name, or the last piece of one on a small part of the
    page; never the article, what holds it or its headings); smoothed, fused
    and thresholded tag-path scores then choose the blocks, within the one or
    the best article or main element of pages that have one.  There a low score
    only drops paths that are mostly links.  A heading stays unless all that it
    heads goes.  Character references
    are decoded, white space within a block is one space, and blocks are
    joined in page order by one space.  A null or empty page gives an empty
    text; broken markup is closed as browsers do; whole pages are read.
    Repeated rows give repeated rows, an empty table none.
    """
    def run(batches):
        for batch in text_slices(batches, "_h"):
            made = [main_text(h) for h in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(made, pa.string()), pa.array([len(m) for m in made], pa.int64())],
                names=[*keep, "text", "n_chars"])

    source = pages.select(*keep, F.col(html_col).alias("_h"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return map_batches(source, run, schema)
