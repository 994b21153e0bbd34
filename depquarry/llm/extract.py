"""Main-text extraction by wrapper induction over the pages of a host.

A page becomes a tree of block elements with text leaves (inline markup is part of a leaf; scripts, styles and the like
are gone). The page with a host's smallest page_id (then smallest html) is its reference; every page of the host is
aligned with it by simple tree matching. A reference leaf whose aligned text is the same on ``SAME`` of the host's pages or more,
with ``LEAST_PAGES`` pages at least, is template; what varies is a slot. Counts cover all pages of all hosts.

A page's text is the leaves of its articles (the outermost ``article`` elements, else ``main``, else the body) that are
neither template nor in a region that is a menu, header, footer, sidebar, notice, advert, form or comment section by
element or role, or by class or id. A class or id alone decides nothing: such a region goes only if it holds no title
and half of the text around it at most, and never where it holds all articles; words of state (``has-sidebar``,
``no-comments``) name no region. Outside an article, lists of mere links count as menus too. Where everything would be
template (a host of copies), the template is ignored. Leaves are joined in page order by ``\\n``.

Null html counts as empty, null urls as one host without a name. Repeated rows are counted and extracted one by one.
An empty table gives no rows. Extra columns are ignored. Broken markup is read as far as it goes; nothing is capped.
References and templates are broadcast if their size allows (``MAX_BROADCAST_BYTES``), else joined by host.
"""

from __future__ import annotations

import html as html_lib
import re
import sys
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import map_batches, struct, table, written

SAME, LEAST_PAGES, MAX_BROADCAST_BYTES = 0.8, 4, 32 << 20

# Elements by how they are read.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark meter nobr picture progress q rp rt ruby s samp small source span strike strong sub sup time tt u var wbr br".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg math object select noframes audio video canvas".split())
BOILERPLATE = frozenset("nav footer aside form button dialog menu head".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
WORDS = frozenset(
    "nav navbar navigation menu menus breadcrumb breadcrumbs header masthead topbar footer sidebar sidebars widget widgets ad ads advert adverts advertisement advertising adsense adslot banner promo promoted sponsor sponsored "
    "cookie cookies consent gdpr notice notices alert popup modal overlay toast paywall newsletter subscribe subscription signup login comment comments commentlist disqus replies respond discussion share sharing social related recommended pagination pager copyright skip".split()
)
STATES = frozenset("has no with without is not hide hidden show open closed disable disabled enable enabled".split())
CLOSES = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option", "p": "p"}

_tag = re.compile(r"""<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>""")
_attr = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_word = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_ends = {name: re.compile(f"</{name}[^>]*>", re.I) for name in RAW}


class Node:
    """An element (``tag``) or a text leaf (``tag`` empty); ``kind`` is what alignment compares."""

    __slots__ = ("tag", "kind", "children", "text", "linked", "boiler", "marked", "number", "size", "shape", "chars", "titled")

    def __init__(self, tag: str, kind: str = "", boiler: bool = False, marked: bool = False):
        self.tag, self.kind, self.boiler, self.marked = tag, kind or tag, boiler, marked
        self.children: list[Node] = []
        self.text, self.linked, self.number = "", 0, -1


def _names(attrs: str) -> tuple[str, set[str], str]:
    role, words, kind = "", set(), ""
    for k, v in _attr.findall(attrs):
        v = v.strip("\"'")
        if k.lower() == "role":
            role = v.lower()
        else:
            for name in v.split():
                parts = [w.lower() for w in _word.findall(name)]
                if parts and parts[0] not in STATES and parts[-1] not in STATES:
                    words.update(parts)
            kind += "." + v if k.lower() == "class" else ""
    return role, words, kind


def parse(page: str) -> Node:
    """The tree of a page. Open elements are a stack; a closing tag ends what is open down to its element, if there is one."""
    root = Node("html")
    stack, run, linked, in_link = [root], [], 0, 0
    open_tags = Counter({"html": 1})

    def flush() -> None:
        nonlocal linked
        if run:
            text = " ".join(html_lib.unescape("".join(run)).split())
            if text:
                leaf = Node("")
                leaf.text, leaf.linked = text, min(linked, len(text))
                stack[-1].children.append(leaf)
            run.clear()
        linked = 0

    def close(name: str) -> None:
        if open_tags[name]:
            while True:
                top = stack.pop()
                open_tags[top.tag] -= 1
                if top.tag == name or len(stack) == 1:
                    break

    at, end = 0, len(page)
    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            lt = end
        if lt > at:
            run.append(page[at:lt])
            linked += (lt - at) if in_link else 0
        if lt == end:
            break
        if page.startswith("<!--", lt):
            to = page.find("-->", lt + 4)
            at = end if to < 0 else to + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            to = page.find(">", lt)
            at = end if to < 0 else to + 1
            continue
        m = _tag.match(page, lt)
        if not m:
            if page.find(">", lt) < 0 and re.match(r"</?[A-Za-z]", page[lt : lt + 3]):
                break  # cut off inside a tag
            run.append("<")
            at = lt + 1
            continue
        at = m.end()
        closing, name, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        name = name.lower()
        if name in INLINE:
            if name == "a":
                in_link = 0 if closing else 1
            elif name == "br":
                run.append(" ")
            continue
        flush()
        if closing:
            if name != "html" and name != "body":
                close(name)
            continue
        if name in RAW:
            stop = _ends[name].search(page, at) if not attrs.endswith("/") else None
            at = stop.end() if stop else at if attrs.endswith("/") or name in ("svg", "math", "object") else end
            continue
        if name in VOID:
            continue
        if name in ("html", "body"):
            continue
        if open_tags["p"] and stack[-1].tag == "p":
            close("p")
        for other in CLOSES.get(name, "").split():
            if stack[-1].tag == other:
                close(other)
        role, words, kind = _names(attrs) if attrs else ("", set(), "")
        boiler = name in BOILERPLATE or role in ROLES or (name == "header" and not open_tags["article"])
        node = Node(name, name + kind, boiler, bool(words & WORDS))
        stack[-1].children.append(node)
        if not attrs.endswith("/"):
            stack.append(node)
            open_tags[name] += 1
    flush()
    return _measured(root)


def _measured(root: Node) -> Node:
    """Numbers leaves in page order and sets every node's size, shape (equal for equal structures), length of text and
    whether it holds a title, without recursion."""
    order, todo, n = [], [root], 0
    while todo:
        node = todo.pop()
        order.append(node)
        if not node.tag:
            node.number, n = n, n + 1
        todo.extend(reversed(node.children))
    for node in reversed(order):
        node.size = 1 + sum(c.size for c in node.children)
        node.shape = hash((node.kind, *[c.shape for c in node.children]))
        node.chars = len(node.text) + sum(c.chars for c in node.children)
        node.titled = node.tag == "h1" or any(c.titled for c in node.children)
    return root


def align(a: Node, b: Node) -> list[tuple[Node, Node]]:
    """Pairs of matched leaves by simple tree matching: equal kinds match, children in order, most nodes in all."""
    known: dict[tuple[int, int], int] = {}
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 1_000_000))  # as deep as the pages are

    def table_of(x: list[Node], y: list[Node]) -> list[list[int]]:
        m = [[0] * (len(y) + 1)]
        for p in x:
            above, row = m[-1], [0]
            for j, q in enumerate(y):
                best = above[j + 1] if above[j + 1] > row[j] else row[j]
                if p.kind == q.kind and (w := above[j] + weight(p, q)) > best:
                    best = w
                row.append(best)
            m.append(row)
        return m

    def trimmed(x: list[Node], y: list[Node]) -> tuple[int, int]:
        """How many equal structures the two lists begin and end with: matching those is always among the best."""
        n, i, j = min(len(x), len(y)), 0, 0
        while i < n and x[i].shape == y[i].shape:
            i += 1
        while j < n - i and x[-1 - j].shape == y[-1 - j].shape:
            j += 1
        return i, j

    def weight(p: Node, q: Node) -> int:
        if p.shape == q.shape:
            return p.size
        key = (id(p), id(q))
        if key not in known:
            i, j = trimmed(p.children, q.children)
            x, y = p.children[i : len(p.children) - j], q.children[i : len(q.children) - j]
            known[key] = 1 + sum(c.size for c in p.children[:i]) + sum(c.size for c in p.children[len(p.children) - j :]) + (table_of(x, y)[-1][-1] if x and y else 0)
        return known[key]

    out, todo = [], [(a, b)]
    while todo:
        p, q = todo.pop()
        if not p.tag:
            out.append((p, q))
            continue
        i, j = trimmed(p.children, q.children)
        todo += zip(p.children[:i], q.children[:i])
        todo += zip(p.children[len(p.children) - j :], q.children[len(q.children) - j :])
        x, y = p.children[i : len(p.children) - j], q.children[i : len(q.children) - j]
        if x and y:
            m = table_of(x, y)
            u, v = len(x), len(y)
            while u and v:
                if m[u][v] == m[u - 1][v]:
                    u -= 1
                elif m[u][v] == m[u][v - 1]:
                    v -= 1
                else:
                    u, v = u - 1, v - 1
                    todo.append((x[u], y[v]))
    return out


def _leaves(node: Node, menus: bool) -> list[Node]:
    """Leaves outside boilerplate regions, in page order."""
    out, todo = [], [node]
    while todo:
        n = todo.pop()
        if not n.tag:
            out.append(n)
            continue
        beside = n is not node and (n.boiler or (n.marked and not n.titled and 2 * n.chars <= node.chars))
        if not beside and not (menus and n.tag in ("ul", "ol") and _mere_links(n)):
            todo.extend(reversed(n.children))
    return out


def _mere_links(node: Node) -> bool:
    total = linked = 0
    todo = [node]
    while todo:
        n = todo.pop()
        total, linked = total + len(n.text), linked + n.linked
        todo.extend(n.children)
    return total > 0 and linked >= 0.8 * total


def content(root: Node) -> list[Node]:
    """Leaves of the outermost articles, else of ``main``, else of the page; articles in regions that class or id mark only if there are no others."""
    for tag in ("article", "main"):
        found: dict[bool, list[Node]] = {False: [], True: []}
        todo = [(root, False)]
        while todo:
            n, marked = todo.pop()
            marked = marked or n.marked
            if n.tag == tag and not n.boiler:
                found[marked].append(n)
            elif not n.boiler:
                todo.extend((c, marked) for c in reversed(n.children))
        leaves = [x for n in found[False] or found[True] for x in _leaves(n, False)]
        if leaves:
            return leaves
    return _leaves(root, True)


def extracted(page: str, reference: str | None, template: set[int]) -> str:
    root = parse(page)
    leaves = content(root)
    if template and reference is not None:
        constant = {id(p) for p, q in align(root, _reference(reference)) if q.number in template and p.text == q.text}
        leaves = [x for x in leaves if id(x) not in constant] or leaves
    return "\n".join(x.text for x in leaves)


_parsed: dict[str, Node] = {}


def _reference(page: str) -> Node:
    """A host's parsed reference; a worker keeps a few."""
    if page not in _parsed:
        if len(_parsed) >= 64:
            _parsed.clear()
        _parsed[page] = parse(page)
    return _parsed[page]


_SEEN = struct(host="string", leaf="long", n="long")


def _joined(pages: DataFrame, hosts: DataFrame, size: int) -> DataFrame:
    return pages.join(F.broadcast(hosts) if size <= MAX_BROADCAST_BYTES else hosts, "host", "left")


def induce(pages: DataFrame) -> DataFrame:
    """(host, reference, template): each host's reference page and the numbers of its constant leaves, from all pages."""
    hosts = written(pages.groupBy("host").agg(F.min(F.struct("page_id", "html"))["html"].alias("reference")), "references")
    size = hosts.agg(F.sum(F.octet_length("reference") + F.octet_length("host"))).first()[0] or 0

    def fn(batch: pa.RecordBatch) -> dict:
        seen: Counter = Counter()
        for host, page, reference in zip(*(batch.column(i) for i in range(3))):
            host, page, reference = host.as_py(), page.as_py() or "", reference.as_py() or ""
            seen[host, -1] += 1
            for p, q in align(parse(page), _reference(reference)):
                if p.text == q.text:
                    seen[host, q.number] += 1
        return {"host": [k[0] for k in seen], "leaf": [k[1] for k in seen], "n": list(seen.values())}

    seen = map_batches(_joined(pages, hosts, size).select("host", "html", "reference"), fn, _SEEN).groupBy("host", "leaf").agg(F.sum("n").alias("n"))
    seen = written(seen, "constant")
    totals = seen.filter("leaf = -1").select("host", F.col("n").alias("pages"))
    constant = seen.filter("leaf >= 0").join(totals, "host").filter((F.col("pages") >= LEAST_PAGES) & (F.col("n") >= SAME * F.col("pages")))
    return hosts.join(constant.groupBy("host").agg(F.collect_list("leaf").alias("template")), "host", "left")


TEXTS = struct(page_id="long", url="string", text="string", n_chars="long")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) -> (page_id, url, text, n_chars)."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    pages = pages.select("page_id", "url", "html", host.alias("host"))
    wrappers = written(induce(pages).filter("template is not null"), "wrappers")  # hosts without a template need none
    size = wrappers.agg(F.sum(F.octet_length("reference") + F.octet_length("host") + 8 * F.size("template"))).first()[0] or 0

    def fn(batch: pa.RecordBatch) -> dict:
        texts = []
        for page, reference, template in zip(*(batch.column(i) for i in (2, 3, 4))):
            texts.append(extracted(page.as_py() or "", reference.as_py(), set(template.as_py() or ())))
        return {"page_id": batch.column(0).cast(pa.int64()), "url": batch.column(1), "text": texts, "n_chars": [len(t) for t in texts]}

    return map_batches(_joined(pages, wrappers, size).select("page_id", "url", "html", "reference", "template"), fn, TEXTS)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
