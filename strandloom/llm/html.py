"""Main text of web pages by site style trees.

The DOMs of a host's pages are merged by element path.  For every path the tree keeps how
often each presentation (the sequence of child elements) and each text occurs.  A node's
presentation importance is the entropy of its presentations to the base of its pages.  Its
content importance is the exponential of the texts' Hartley entropy (the logarithm of how many
there are) less that of their occurrences: 1 where no two pages say the same, near 0 where
many pages choose from few texts.  A branch's importance composes its own presentation
importance and its children's, as far as it has children.  A branch goes if it and everything
below it are of low importance: so one text that is new keeps all branches around it.

What the tree cannot tell is decided by name: elements that never hold text, HTML's sections
beside the article, and classes such as those of reader comments, whose texts are all new.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark import bound_batches, cut
from .textops import CHUNK_BYTES, chunks

# Fixed values of HTML: element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section select summary"
    " table tbody td template textarea tfoot th thead title tr ul".split()
)
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: A start tag of the key ends open elements of the value, up to the boundary elements.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("html body article section div ul ol dl table tbody thead tfoot td th blockquote main aside nav header footer form figure".split())

# Names of what is not the article.
#: Elements that never hold text to read.
NEVER = frozenset("head script style noscript template dialog iframe object svg canvas button select textarea input".split())
#: Sections beside the article, and forms unless they hold the article.
BESIDE = frozenset("nav menu aside header footer form".split())
#: Words of a class, id or role that mark such branches wherever they stand in it.
STRONG = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb"
    " breadcrumbs sidebar comments disqus footer masthead cookie cookies newsletter popup modal pagination pager toolbar".split()
)
#: Words that mark them alone or beside words of COMPANIONS only.
WEAK = frozenset("aside related recommended share sharing social comment reply replies respond header consent notice notices subscribe signup login copyright legal search widget".split())
COMPANIONS = frozenset("site page global top bottom left right posts articles stories links link box bar block button buttons icons list section area form wrapper container items news media thread".split())
#: Words of names that hold the article's text: they outweigh the others in a name, and a name of them the other names.
TEXT = frozenset("article content body story entry text main".split())

#: Elements that hold the article where a page has them.
ARTICLE = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Elements that only go with a branch around them.
PARTS = frozenset("li dt dd tr td th tbody thead tfoot caption figcaption br hr".split()) | HEADINGS
#: Importance below which a branch goes, on hosts of so many pages; the weight of the children of one child.
MIN_IMPORTANCE, MIN_PAGES, DECAY = 0.6, 8, 0.9

_token = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_attr = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_word = re.compile(r"[a-z]+")
_space = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "names", "tokens", "path", "children", "parts")

    def __init__(self, tag: str, names: tuple, path: int, tokens: tuple = ()):
        self.tag, self.names, self.path = tag, names, path
        self.tokens = tokens  # of class, id and role, where a word of them may matter
        self.children: list[Node] = []
        self.parts: list = []  # texts and nodes in page order


def parse(text: str) -> Node:
    """A page's elements with their texts; end tags that are missing are implied, stray ones are dropped."""
    root = Node("", (), 0)
    stack = [root]
    at, size = 0, len(text)

    def open_element(tag: str, attrs: str) -> Node:
        names = tokens = ()
        if attrs:
            found = [v.lower() for m in _attr.finditer(attrs) for v in m.groups()[1:] if v]
            names = tuple(sorted({w for v in found for w in _word.findall(v)}))
            if not (STRONG.isdisjoint(names) and WEAK.isdisjoint(names)):
                tokens = tuple(t for v in found for t in v.split())
        parent = stack[-1]
        node = Node(tag, names, xxhash.xxh64_intdigest(f"{tag}.{'.'.join(names)}", seed=parent.path) >> 1, tokens)
        parent.children.append(node)
        parent.parts.append(node)
        return node

    def close_to(tags, boundary) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                del stack[i:]
                return
            if stack[i].tag in boundary:
                return

    while at < size:
        m = _token.search(text, at)
        if not m:
            stack[-1].parts.append(text[at:])
            break
        if m.start() > at:
            stack[-1].parts.append(text[at : m.start()])
        at = m.end()
        if m[2]:
            tag = m[2].lower()
            if tag in BLOCK:
                close_to(("p",), SCOPE)
            if tag in ENDS:
                close_to(ENDS[tag], SCOPE - ENDS[tag])
            node = open_element(tag, m[3])
            if tag in RAW:
                end = re.compile(rf"</{tag}\s*>", re.I).search(text, at)
                stop = end.start() if end else size
                node.parts.append(text[at:stop])
                at = end.end() if end else size
            elif tag not in VOID and not (m[3] or "").rstrip().endswith("/"):
                stack.append(node)
        elif m[1]:
            tag = m[1].lower()
            if any(n.tag == tag for n in stack[1:]):
                while stack[-1].tag != tag:
                    stack.pop()
                stack.pop()
    return root


def blocks(node: Node, keep) -> list[str]:
    """Text blocks below a node in page order: references decoded, white space made one space, empty ones dropped."""
    out: list[str] = []
    run: list[str] = []

    def end() -> None:
        if run:
            text = _space.sub(" ", entities.unescape("".join(run))).strip()
            run.clear()
            if text:
                out.append(text)

    # an explicit stack: pages may nest deeper than Python calls
    todo: list = [iter(node.parts)]
    leave: list[bool] = [False]
    while todo:
        part = next(todo[-1], None)
        if part is None:
            todo.pop()
            if leave.pop():
                end()
        elif isinstance(part, str):
            run.append(part)
        elif part.tag == "br":
            run.append(" ")
        else:
            block = part.tag in BLOCK
            if block:
                end()
            if keep(part):
                todo.append(iter(part.parts))
                leave.append(block)
    end()
    return out


def named_off(node: Node, in_article: bool) -> bool:
    """Whether a class, id or role says that a branch is not the article; inside an article only a whole token does."""
    if not node.tokens or node.tag in ARTICLE or node.tag in ("html", "body"):
        return False
    off = False
    for token in node.tokens:
        words = _word.findall(token)
        strong, weak = not STRONG.isdisjoint(words), not WEAK.isdisjoint(words)
        if in_article:
            off |= len(words) == 1 and (strong or weak)
        elif strong:
            off = True
        elif not TEXT.isdisjoint(words):
            return False
        elif weak:
            off |= all(w in WEAK or w in COMPANIONS for w in words)
    return off


def holds(node: Node, tags: frozenset) -> bool:
    return any(n.tag in tags for n in walk(node))


def _key(text: str) -> int:
    return xxhash.xxh64_intdigest(text) >> 1


def walk(root: Node):
    todo = [root]
    while todo:
        node = todo.pop()
        yield node
        todo.extend(node.children)


def own_text(node: Node) -> str:
    return "".join(p for p in node.parts if isinstance(p, str)).strip()


def _tree_rows(batches):
    """(host, path, kind, feature, pages) of each batch: kind 0 a presentation, 1 a text block."""
    for batch in batches:
        hosts = batch.column(0).to_pylist()
        for lo, _, data, offs in chunks(batch.column(1), 8 * CHUNK_BYTES):
            raw, rows = data.tobytes(), {}
            for i, (a, b) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist())):
                seen = set()
                for node in walk(parse(raw[a:b].decode("utf-8", "replace"))):
                    seen.add((node.path, 0, _key(" ".join(f"{c.tag}.{'.'.join(c.names)}" for c in node.children))))
                    own = own_text(node)
                    if own:
                        seen.add((node.path, 1, _key(_space.sub(" ", own))))
                for x in seen:
                    key = (hosts[lo + i], *x)
                    rows[key] = rows.get(key, 0) + 1
            cols = list(zip(*((*k, n) for k, n in rows.items()))) or [()] * 5
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(cols, kinds)], names=["host", "path", "kind", "feature", "n"])


def site_style_tree(pages: DataFrame) -> DataFrame:
    """Pages (host, html) -> (host, path, pages, importance of presentation, importance of content or null)."""
    rows = pages.select("host", "html").mapInArrow(_tree_rows, "host string, path long, kind int, feature long, n long")
    counted = rows.groupBy("host", "path", "kind", "feature").agg(F.sum("n").alias("n"))
    by = counted.groupBy("host", "path", "kind").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.ln("n")).alias("nlogn"), F.count(F.lit(1)).alias("features"))
    style, text = F.col("kind") == 0, F.col("kind") == 1
    return by.groupBy("host", "path").agg(
        F.max(F.when(style, F.col("m"))).alias("pages"),
        F.max(F.when(style, F.ln("m") - F.col("nlogn") / F.col("m"))).alias("spread"),
        # one occurrence more, of a text of its own, so that few pages prove little
        F.max(F.when(text, F.exp(F.ln(F.col("features") + 1) - F.ln(F.col("m") + 1)))).alias("content"),
    ).select("host", "path", "pages", F.when(F.col("pages") > 1, F.col("spread") / F.ln("pages")).otherwise(1.0).alias("presentation"), "content")


def noise(root: Node, low: dict[int, tuple[float, float]]) -> set[int]:
    """Nodes (by identity) that are of low importance with everything below them.

    low: path -> (presentation, content; -1 without text) of the host's paths with little content; others are important.
    """
    found: dict[int, float] = {}
    for n in reversed(list(walk(root))):  # children first
        known = low.get(n.path)
        if known is None or any(id(c) not in found for c in n.children):
            continue
        shown, said = known
        below = [found[id(c)] for c in n.children] + ([said] if said >= 0 else [])
        share = DECAY ** len(n.children)
        own = (1 - share) * shown + share * sum(below) / len(below) if below else 0.0
        if own < MIN_IMPORTANCE:
            found[id(n)] = own
    return set(found)


def main_text(page: str, low: dict[int, tuple[float, float]], by_name: bool = True) -> str:
    """A page's main text; low as in noise().  Without by_name the tree alone decides, but for elements without text to read."""
    root = parse(page)
    noisy = noise(root, low) if low else ()
    dropped, tops = set(), []
    todo = [(root, False, False)]
    while todo:
        node, in_article, in_text = todo.pop()
        if by_name and node.tag in ARTICLE and not in_article:
            tops.append(node)
        in_article |= node.tag in ARTICLE
        in_text |= node.tag in PARTS or node.tag == "p"
        for child in reversed(node.children):
            tag = child.tag
            off = tag in NEVER
            if not off and id(child) in noisy:
                loose = tag not in BLOCK or tag == "p"
                off = tag not in ARTICLE and tag not in ("html", "body") and tag not in PARTS and not (loose and (in_article or in_text))
            if not off and by_name:
                if tag in BESIDE:
                    off = not (tag == "header" and in_article and holds(child, HEADINGS) or tag == "form" and holds(child, ARTICLE))
                else:
                    off = named_off(child, in_article)
            if off:
                dropped.add(id(child))
            else:
                todo.append((child, in_article, in_text))
    return "\n".join(t for n in tops or [root] for t in blocks(n, lambda x: id(x) not in dropped))


#: Rows of the trees that are sent to all tasks as they are (60 bytes each); more are joined by shuffle.
BROADCAST_ROWS = 100_000


def low_paths(pages: DataFrame) -> DataFrame:
    """(host, path, presentation, content) of the paths of little content, on hosts of MIN_PAGES pages at least."""
    tree = site_style_tree(pages)
    large = tree.filter((F.col("path") == 0) & (F.col("pages") >= MIN_PAGES)).select("host")  # a page has one root
    low = tree.filter(F.coalesce("content", F.lit(0.0)) < MIN_IMPORTANCE).select("host", "path", "presentation", F.coalesce("content", F.lit(-1.0)).alias("content"))
    return low.join(large, "host", "left_semi")


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", by_name: bool = True) -> DataFrame:
    """One row per input row: (id, url, text, n_chars).

    Whole pages are parsed (null: empty); text is "" where nothing is left.  A null or unparsable
    url is a host of its own name "".  A `br` is white space; a header inside an article stays if it
    holds a heading.  Rows of one id, url and html are extracted alike, each; null ids stay null;
    other columns, whatever their names, are ignored; an empty table gives an empty table.
    """
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1), F.lit("")))
    src = bound_batches(pages, 500).select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"))
    low = cut(low_paths(src))
    known = None
    if low.count() <= BROADCAST_ROWS:
        known = {}
        for r in low.collect():
            known.setdefault(r["host"], {})[r["path"]] = (r["presentation"], r["content"])
        joined = src
    else:
        sites = low.groupBy("host").agg(F.collect_list(F.struct("path", "presentation", "content")).alias("tree"))
        joined = src.join(sites, "host", "left").select("id", "url", "html", "host", "tree")
    shared = pages.sparkSession.sparkContext.broadcast(known) if known is not None else None

    def kernel(batches):
        have, last = {}, None
        for batch in batches:
            hosts = batch.column(3).to_pylist()
            for lo, hi, data, offs in chunks(batch.column(2), 8 * CHUNK_BYTES):
                raw, texts = data.tobytes(), []
                for i, (a, b) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist())):
                    host = hosts[lo + i]
                    if host != last:
                        if shared is not None:
                            have = shared.value.get(host, {})
                        else:
                            have = {t["path"]: (t["presentation"], t["content"]) for t in batch.column(4)[lo + i].as_py() or ()}
                        last = host
                    texts.append(main_text(raw[a:b].decode("utf-8", "replace"), have, by_name))
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, type=pa.string()), pa.array(np.array([len(t) for t in texts], dtype=np.int64))], names=[id_col, url_col, "text", "n_chars"])

    return joined.select("id", "url", "html", "host", *(["tree"] if shared is None else [])).mapInArrow(kernel, f"`{id_col}` long, `{url_col}` string, text string, n_chars long")
