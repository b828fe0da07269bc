"""Main text of web pages by composite text density.

Every DOM node has its characters, tags, link characters and link tags; its density is characters per tag, adjusted by how
much of the text is in links, here and in the whole body. The node with the largest sum of child densities is found, and the
smallest density on its path to the body is the threshold. That node is content, widened to its heading or to the article
element around it; a paragraph takes the bare blocks beside it along. So are, beside it and the nodes that hold it, bare blocks
and headings that reach the threshold, and containers that reach it and of which one node's own blocks sum up to a SHARE of the
largest sum at least: eight short remarks in one wrapper are no second article. All else is dropped: a letter box, a reader's
comment or a footer next to the article goes by its density, whatever it is called. Within the content, containers below the
threshold go if a third of their text or more is links, and so do lists or containers of nothing but links (menus), outside
running text.

Scripts, styles and form fields never count. A form goes with its text, unless half of the page's text is in it. Elements go that
name themselves navigation, header, footer, sidebar, advert or comments in words of the page's layout alone; in a name with
other words ("comment-on-policy"), and within an article for weaker names (WEAK), such a word is a prior: it cuts only what is
short or by a third or more links.

Blocks are joined by line ends; white space within a block, line breaks too, is one space. A null or empty page, or one
without text in its body, gives an empty text. Unclosed and misnested tags are closed as a browser would; unclosed comments,
scripts and tags end with the page. The tokenizer and the tree take time linear in the page, however broken it is. Rows are independent: repeated rows give repeated results, other columns pass through, those
named as the result are replaced, an empty table gives an empty table.
"""

from __future__ import annotations

import collections
import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# HTML element kinds.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe noembed noframes xmp".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - set("body caption dd dt html legend li tbody td tfoot th thead tr".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: A start tag also ends these open elements, up to the elements named second.
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
        "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
        "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
            "thead": ({"tbody", "tr", "td", "th"}, {"table"}),
}
#: Elements that never hold article text, and words of class, id or role that say the same.
NEVER = set("head script style noscript template iframe object embed svg annotation annotation-xml canvas audio video nav aside footer button select textarea input label dialog menu noembed noframes search".split())
SAYS = set(
    "ad ads adbox adsbygoogle advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login comment comments commentlist disqus replies reply respond share sharing social related recommended recommendations widget toolbar pagination pager skip hidden complementary contentinfo search".split()
)
#: Names that an article's own parts may have: there they cut what is links by a third or more.
WEAK = set("alert notice notices related recommended recommendations widget banner overlay search skip menu share social sharing".split())
#: Words that may stand beside those of SAYS in the name of a part of the page's layout ("comment-list"). A name with any other word
#: ("comment-on-policy") may be one of the article's own: it is a prior only, and cuts no running text with few links.
LAYOUT = SAYS | set("area background bar body bottom box btn button block card cell center close col column container content control cta desktop el element entry excerpt fixed float form frame global grid group head header heading holder icon image img in info inline inner item label layer left line link links list main meta middle mobile module nav node outer page panel part pane post posts primary right root row secondary section site slot small sticky text the tile title tools top unit upper view wrap wrapper zone js".split())
#: Characters of text outside links that are running text, and part of the body's text that a form with the page in it holds.
RUN_CHARS, PAGE_SHARE = 80, 1 / 2
KEEPS = {"html", "body", "main"}
#: Names that hold, as a whole class or id, even for an element with an article or a main heading in it.
STRICT = set("comment comments commentlist disqus reply replies respond".split())
#: A class that begins, or for STRICT ends, with such a word tells a state or topic ("no-comments", "comments-open"), not what the element is.
STATES, STATUS = set("no not has with without tag category topic".split()), set("open opened closed enabled disabled allowed on off".split())
#: Of these elements, one with at least so many links and no letter or digit outside them is a menu, but for those in or with running text.
BOXES = set("div section center".split())
MENUS, MENU_LINKS = BOXES | set("ul ol dir".split()), 2
RUNNING = {"p", "td", "th", "li", "dt", "dd", "blockquote", "pre", "caption", "figcaption"} | HEADINGS
#: Part of the largest density sum that a container beside it needs, to be content as well.
SHARE = 1 / 3

_OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)(>?)")
_GAP = re.compile(r"[\s/]*+")
_ATTRIBUTE = re.compile(r"""(=?[^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?+""")
_HIDES = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

Attributes = list[tuple[str, str]]


def tokens(page: str) -> Iterator[tuple[int, int, str, str, Attributes, bool]]:
    """Begin, end, kind ("open", "close" or "other"), name, attributes and whether it closes itself, of each piece of markup.

    Quotes count only where an attribute's value begins; one that is never closed is part of the value. A tag that the page
    ends in is dropped with what follows. Send ("past", k) to go on at k."""
    at, n = 0, len(page)
    while 0 <= (at := page.find("<", at)) < n:
        begin = at
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = n if end < 0 else end + 3
            yield begin, at, "other", "", [], False
            continue
        if page.startswith(("<!", "<?"), at):
            end = page.find(">", at)
            at = n if end < 0 else end + 1
            yield begin, at, "other", "", [], False
            continue
        m = _OPEN.match(page, at)
        if not m:
            at += 1
            continue
        attributes: Attributes = []
        at, done = m.end(), bool(m[3])
        while not done:
            at = _GAP.match(page, at).end()
            if at >= n:
                break
            if page[at] == ">":
                at, done = at + 1, True
                break
            x = _ATTRIBUTE.match(page, at)
            attributes.append((x[1].lower(), x[2] or x[3] or x[4] or ""))
            at = x.end()
        if not done:
            yield begin, n, "other", "", [], False
            return
        past = yield begin, at, "close" if m[1] else "open", m[2].lower(), attributes, page[at - 2] == "/"
        at = past or at


def _says(attributes: Attributes) -> tuple[frozenset[str], bool, bool]:
    """The words of class, id and role, "hidden" for what is not shown, whether a whole name is in STRICT, and whether words of SAYS stand
    only in names with words that are not of LAYOUT."""
    found, strict, plain, loose = set(), False, False, False
    for name, value in attributes:
        if name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true" or name == "style" and _HIDES.search(value):
            found.add("hidden")
            plain = True
        if name in ("class", "id", "role"):
            for token in value.split():
                words = [w.lower() for w in _WORDS.findall(token)]
                strict |= token.lower() in STRICT
                if len(words) > 1 and (words[0] in STATES or words[-1] in STATUS and STRICT.intersection(words)):
                    continue
                words = set(words) if token.lower() == "hidden" else set(words) - {"hidden"}
                if words & SAYS:
                    plain, loose = plain or words <= LAYOUT, loose or not words <= LAYOUT
                found |= words
    return frozenset(found), strict, loose and not plain


class Dom:
    """Nodes in document order, as parallel lists. A node's children are text or node numbers."""

    def __init__(self, page: str):
        self.tag, self.parent, self.children, self.names, self.strict, self.loose = ["#root"], [-1], [[]], [frozenset()], [False], [False]
        self.inside = [False]  # of an article or main element
        self._build(page)

    def _add(self, tag: str, parent: int, attributes: Attributes) -> int:
        k = len(self.tag)
        self.tag.append(tag)
        self.parent.append(parent)
        self.children.append([])
        self.children[parent].append(k)
        found, strict, loose = _says(attributes) if attributes else (frozenset(), False, False)
        self.strict.append(strict)
        self.loose.append(loose)
        self.names.append(found)
        return k

    def _build(self, page: str) -> None:
        tag, stack, at = self.tag, [0], 0
        opened: collections.Counter = collections.Counter()  # so that no search goes through the stack in vain

        def close(k: int) -> None:
            for node in stack[k:]:
                opened[tag[node]] -= 1
            del stack[k:]

        found = tokens(page)
        token = next(found, None)
        while token:
            begin, end, kind, name, attributes, void = token
            if begin > at:
                self.children[stack[-1]].append(html.unescape(page[at:begin]))
            at, past = end, None
            if kind == "close" and opened[name]:
                for k in range(len(stack) - 1, 0, -1):
                    if tag[stack[k]] == name:
                        if name not in ("body", "html"):
                            close(k)
                        break
                    if name not in BLOCK and tag[stack[k]] in BLOCK:
                        break
            elif kind == "open" and not (name in ("html", "body") and opened[name]):
                ends, bar = ({"p"}, {"table", "td", "th", "button", "object"}) if name in CLOSES_P else IMPLIED_END.get(name, ((), ()))
                if any(opened[x] for x in ends):
                    for k in range(len(stack) - 1, 0, -1):
                        if tag[stack[k]] in bar:
                            break
                        if tag[stack[k]] in ends:
                            close(k)
                            if name in CLOSES_P:
                                break
                if name in HEADINGS and tag[stack[-1]] in HEADINGS:
                    close(len(stack) - 1)
                node = self._add(name, stack[-1], attributes)
                if name in RAW:
                    stop = re.compile(f"</{re.escape(name)}[\\s/>]", re.I).search(page, at)
                    if name in ("textarea", "title") or not stop:
                        self.children[node].append(page[at : stop.start() if stop else len(page)])
                    at = past = (page.find(">", stop.start()) + 1 or len(page)) if stop else len(page)
                elif name not in VOID and not void:
                    stack.append(node)
                    opened[name] += 1
            try:
                token = found.send(past)
            except StopIteration:
                token = None
        if at < len(page):
            self.children[stack[-1]].append(html.unescape(page[at:]))

    def kept(self) -> list[bool]:
        """Which nodes may hold article text, by their element and their names and those of all that hold them."""
        out, inside = [True], self.inside
        chars, link_chars = [0] * len(self.tag), [0] * len(self.tag)
        for k in range(len(self.tag) - 1, 0, -1):
            chars[k] += sum(len(x) for x in self.children[k] if isinstance(x, str))
            link_chars[k] = chars[k] if self.tag[k] == "a" else link_chars[k]
            chars[self.parent[k]] += chars[k]
            link_chars[self.parent[k]] += link_chars[k]
        body = max((chars[k] for k in range(len(self.tag)) if self.tag[k] == "body"), default=chars[0])
        has_title, has_link, has_main = [False] * len(self.tag), [False] * len(self.tag), [False] * len(self.tag)
        for k in range(len(self.tag) - 1, 0, -1):
            if not self.names[k] & STRICT:
                has_main[self.parent[k]] |= has_main[k] or self.tag[k] in ("article", "main", "h1")
            has_title[self.parent[k]] |= has_title[k] or self.tag[k] == "h1"
            has_link[self.parent[k]] |= has_link[k] or self.tag[k] == "a"
        for k in range(1, len(self.tag)):
            up, name, says = self.parent[k], self.tag[k], self.names[k]
            inside.append(inside[up] or name in ("article", "main"))
            site = name == "header" or "header" in says and name not in HEADINGS | KEEPS  # of the page, or a title's own
            if site and (inside[k] or has_main[k] and name != "header" or has_title[k] and not has_link[k]
                and self.tag[up] not in ("body", "html", "#root")):
                site = False
            wraps = has_main[k] and name not in ("header", "nav", "aside", "footer")  # names of the page's layout, as in "with-sidebar"
            hint = says & SAYS
            if inside[up] and hint <= WEAK and 3 * link_chars[k] < chars[k]:
                hint = frozenset()
            if self.loose[k] and chars[k] - link_chars[k] >= RUN_CHARS and 3 * link_chars[k] < chars[k]:
                hint = frozenset()
            named = self.strict[k] or hint and not wraps
            # a form goes with its text, but for one around the page
            form = name == "form" and not wraps and chars[k] - link_chars[k] < PAGE_SHARE * body
            out.append(out[up] and not site and name not in NEVER and not form and (name in KEEPS or name in HEADINGS or not named))
        return out


def densities(dom: Dom, kept: list[bool]) -> tuple[list[float], list[float], list[int], list[int], list[int]]:
    """Composite text density, sum of the children's densities, characters, link characters and link tags of each node."""
    n = len(dom.tag)
    chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    density, total = [0.0] * n, [0.0] * n
    for k in range(n - 1, -1, -1):
        if not kept[k]:
            continue
        own = sum(len("".join(x.split())) for x in dom.children[k] if isinstance(x, str))
        chars[k] += own
        if dom.tag[k] == "a":
            link_chars[k], link_tags[k] = chars[k], link_tags[k] + 1
        if k:
            up = dom.parent[k]
            chars[up] += chars[k]
            tags[up] += tags[k] + 1
            link_chars[up] += link_chars[k]
            link_tags[up] += link_tags[k]
    body = next((k for k in range(n) if dom.tag[k] == "body" and kept[k]), 0)
    share = link_chars[body] / max(1, chars[body])
    for k in range(n - 1, 0, -1):
        if kept[k] and chars[k]:
            c, t, lc, lt = chars[k], max(1, tags[k]), link_chars[k], link_tags[k]
            density[k] = c / t
            if share > 0:
                base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
                density[k] *= max(0.0, math.log(max(1.0, c / max(1, lc) * t / max(1, lt))) / math.log(max(base, 1.000001)))
            total[dom.parent[k]] += density[k]
    return density, total, chars, link_chars, link_tags


def content_nodes(dom: Dom, kept: list[bool], density: list[float], total: list[float], chars: list[int],
    link_chars: list[int]) -> tuple[list[int], float]:
    """The subtrees that are content, in page order, and the threshold."""
    n = len(dom.tag)
    body = next((k for k in range(n) if dom.tag[k] == "body" and kept[k]), 0)
    if not chars[body]:
        body = 0
    if not chars[body]:
        return [], 0.0
    best = list(range(n))  # of each subtree, the node with the largest sum
    for k in range(n - 1, 0, -1):
        if kept[k]:
            up = dom.parent[k]
            if total[best[k]] > total[best[up]] or total[best[k]] == total[best[up]] and best[up] != up and best[k] < best[up]:
                best[up] = best[k]
    top = best[body]
    # beside the article a container counts by the largest sum of one node's own bare blocks, however many such nodes it repeats
    solid = [0.0] * n
    for x in range(n - 1, 0, -1):
        if kept[x] and chars[x]:
            own = sum(density[c] for c in dom.children[x] if not isinstance(c, str) and (dom.tag[c] in RUNNING or dom.tag[c] not in BLOCK))
            solid[x] = max(solid[x], own)
            solid[dom.parent[x]] = max(solid[dom.parent[x]], solid[x])
    limit, k = density[top], top
    while k not in (body, 0):
        k = dom.parent[k]
        if k and density[k]:
            limit = min(limit, density[k])
    heading = lambda x: dom.tag[x] in HEADINGS or dom.tag[x] == "header"
    empty = lambda x: not x.strip() if isinstance(x, str) else not kept[x] or not chars[x]
    k = top
    while k not in (body, 0) and dom.tag[k] not in ("article", "main") and (up := dom.parent[k]) not in (body, 0):
        if dom.inside[up] or all(x == k or empty(x) or not isinstance(x, str) and heading(x) for x in dom.children[up]):
            k = up
        else:
            break
    if k == body:  # no container holds the article alone: weak ones go from beside its blocks
        parts = [x for x in dom.children[k] if not empty(x)]
        weak = lambda x: dom.tag[x] in BOXES and density[x] < limit and solid[x] < SHARE * total[top]
        blocks = all(not isinstance(x, str) and dom.tag[x] in BLOCK for x in parts)
        return [x for x in parts if not weak(x)] if blocks else [k], limit
    found = [k]
    below = {k}
    titled = False  # an article with a heading of its own needs no other
    for x in range(k + 1, n):
        if dom.parent[x] in below:
            below.add(x)
            titled |= dom.tag[x] == "h1" and kept[x]
    while k not in (body, 0):  # what stands beside the content and the nodes that hold it
        k, own = dom.parent[k], k
        for x in dom.children[k]:
            if isinstance(x, str) or x == own or empty(x) or titled and dom.tag[x] == "h1":
                continue
            bare = dom.tag[x] in RUNNING or dom.tag[x] not in BLOCK
            # a paragraph is no article: those beside it are of the same one, if they are not mostly links
            same = bare and own == top and dom.tag[top] in RUNNING and 3 * link_chars[x] < chars[x]
            if same or density[x] >= limit and (bare or solid[x] >= SHARE * total[top]) or dom.tag[x] == "h1" or dom.tag[x] == "header" and x < top:
                found.append(x)
    return sorted(found), limit


def menus(dom: Dom, kept: list[bool], link_tags: list[int], low: list[bool]) -> list[bool]:
    """Which nodes are menus: lists or containers of links alone, or of low density."""
    n = len(dom.tag)
    in_link, in_text, words, runs = [False] * n, [False] * n, [False] * n, [False] * n
    for k in range(1, n):
        up = dom.parent[k]
        in_link[k] = in_link[up] or dom.tag[k] == "a"
        in_text[k] = in_text[up] or dom.tag[up] in RUNNING
    for k in range(n - 1, 0, -1):
        if kept[k]:
            up, name = dom.parent[k], dom.tag[k]
            words[k] = words[k] or not in_link[k] and any(c.isalnum() for x in dom.children[k] if isinstance(x, str) for c in x)
            words[up] |= words[k]
            runs[up] |= runs[k] or name in RUNNING and name != "li" or name == "table"
    links = [low[k] and dom.tag[k] in BOXES or link_tags[k] >= MENU_LINKS and not words[k] for k in range(n)]
    return [links[k] and dom.tag[k] in MENUS and not (in_text[k] or runs[k]) for k in range(n)]


def main_text(page: str | None) -> str:
    """The main text of one page."""
    if not page:
        return ""
    dom = Dom(page)
    kept = dom.kept()
    density, total, chars, link_chars, link_tags = densities(dom, kept)
    tops, limit = content_nodes(dom, kept, density, total, chars, link_chars)
    low = [3 * link_chars[k] >= chars[k] > 0 and density[k] < limit for k in range(len(kept))]
    menu = menus(dom, kept, link_tags, low) if any(link_tags[k] for k in tops) else [False] * len(kept)
    blocks: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if block := " ".join("".join(run).split()):
            blocks.append(block)
        run.clear()

    for top in tops:
        todo: list = [(top, True)]
        while todo:  # an explicit stack: nesting may be deep
            x, enter = todo.pop()
            if isinstance(x, str):
                run.append(x)
                continue
            name = dom.tag[x]
            if not enter:
                flush()
            elif x != top and (not kept[x] or menu[x]):
                continue
            elif name == "br":
                run.append(" ")
            else:
                if name in BLOCK:
                    flush()
                    todo.append((x, False))
                todo += [(c, True) for c in reversed(dom.children[x])]
        flush()
    return "\n".join(blocks)


def extract(pages: DataFrame, page: str = "html", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """pages with the main text and its code points. No shuffle."""
    keep = [f for f in pages.schema.fields if f.name not in (text, n_chars)]
    names = [f.name for f in keep]
    out = T.StructType([*keep, T.StructField(text, T.StringType()), T.StructField(n_chars, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                found = [main_text(p) for p in b.column(names.index(page)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())],
                    names=[f.name for f in out.fields])

    return pages.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, out)
