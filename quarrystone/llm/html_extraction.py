"""HTML extraction: site template removal.

Every element of a page is a subtree with a hash of its tag, class, text and children.  Spark counts on how many distinct
pages of a host each subtree stands; a subtree on many of them belongs to the site's template and is deleted.  Pages with
the same article count once, so copies of an article on a host are not taken for its template.  Text blocks inside an
article are not deleted for being on many pages, as texts are quoted; containers inside an article (boxes, lists, tables)
are.

What is boilerplate by its nature is deleted wherever it stands: menus, site headers, footers, sidebars, forms, scripts,
styles, what is hidden, and boxes that are named as adverts, notices, comments and the like.  Only whole names count
(``ad-slot``, ``cookie-notice``), not names that merely hold such a word (``social-science``, ``notice-board``).

* Classes and roles name boxes (divisions, sections, lists, tables), and paragraphs and list items outside an article.
  Headlines, inline elements, and paragraphs and list items inside an article are never judged by their names.
* An id alone names a box only if it is not made of the words of the box's first headline, as generators make ids.
* A header inside an article stays if it holds a headline; outside, if it holds an h1 and no h1 stands outside headers.
* An article whose class says comment or reply is a reader's comment, not the page's article.

The counts are combined before the shuffle, so a host with a third of all pages is counted everywhere.  How many
subtrees can be templates is bounded for each host: on at least a share of the pages, they are at most the elements of a
page over that share.  Their table is broadcast if a count shows that it is small, else joined by host.

Tags are read in one pass, in time linear in the page, with the attribute rules of the HTML standard: a quote inside an
unquoted value is an ordinary character, a tag that never ends is no text.

Defined cases: null or empty html has no text; a page without an article is its main part, or its body, without
boilerplate; a null url, or one without ``://``, has the empty host; unclosed and stray tags are repaired as browsers
do; repeated rows are extracted each and count as one page; null ids stay null; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import re
from hashlib import blake2b
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.llm.common import broadcast_if_small, cut, text_of
from quarrystone.llm.url_reputation import host_and_path

#: A template stands on at least so many distinct pages of a host, and on this share of them.
LEAST_PAGES, SHARE = 3, 0.3

#: Element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BOILERPLATE = frozenset("nav header footer aside form script style noscript template iframe svg math button select textarea dialog head title menu object canvas audio video noembed noframes".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split())
HEADLINES = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre figcaption dt dd td th tr article main body html".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form toolbar status".split())
#: Words of which a boilerplate element's name must have one, and words that may stand beside them.
NAMES = frozenset(
    "ad ads adbox adslot adunit advert adverts advertisement advertisements advertising adsense sponsor sponsors sponsored promo promos promotion promotions banner banners "
    "cookie cookies consent gdpr notice notices notification notifications alert alerts newsletter subscribe subscription signup sidebar sidebars menu menus nav navbar navigation "
    "breadcrumb breadcrumbs comment comments commentlist disqus reply replies respond share sharing social socials related recommended footer header masthead popup modal overlay widget widgets".split()
)
BESIDE = frozenset(
    "a all area article bar block blocks body bottom box btn button buttons center container content cta div element field footer form global google group header holder icons inner inline item items "
    "large law left link links list main media message mid mobile module more modal outer page panel policy popup post posts primary region reader right row secondary section site skyscraper slot small stories story "
    "tag text thread title toolbar tools top unit user view warning web wrap wrapper wp zone".split()
)
HEADERS = frozenset(("header", "masthead"))
COMMENTS = frozenset("comment comments commentlist disqus reply replies respond".split())
#: What is judged by its names inside an article; outside, paragraphs and list items as well.
BOXES = frozenset("div section ul ol dl table menu fieldset details center article".split())
JUDGED = BOXES | {"p", "li", "dd", "dt", "td", "tr", "tbody", "figure", "blockquote", "pre", "address", "summary", "search"}
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_SPACE = "\t\n\f\r "
_TAG = re.compile(f"[^{_SPACE}/>]+")
_ATTRIBUTE = re.compile(f"[{_SPACE}/]*([^{_SPACE}/>][^{_SPACE}/>=]*)(?:[{_SPACE}]*=[{_SPACE}]*(?:\"([^\"]*)(\"|$)|'([^']*)('|$)|([^{_SPACE}>]*)))?")
_SLASHES = re.compile(f"[{_SPACE}/]*")
_COMMENT_END = re.compile("--!?>")
_RAW_END = {tag: re.compile(f"</{tag}(?=[{_SPACE}/>])", re.I) for tag in RAW}
#: What closes an open element of a name, up to an element that bounds it.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_TABLES = frozenset("table td th tr caption tbody thead tfoot".split())
_BOUNDS = frozenset("td th table caption template".split())


class Element:
    __slots__ = ("tag", "classes", "ident", "role", "hidden", "children", "hash", "headline", "titled")

    def __init__(self, tag: str, classes: str = "", ident: str = "", role: str = "", hidden: bool = False):
        self.tag, self.classes, self.ident, self.role, self.hidden, self.children, self.hash = tag, classes, ident, role, hidden, [], b""
        self.headline = None  # the beginning of the first headline's text
        self.titled = False  # whether it is a header that holds the page's title

    @property
    def name(self) -> str:
        return f"{self.classes} {self.ident}".strip()

    def close(self) -> None:
        own = blake2b(f"{self.tag}\0{self.name}".encode("utf-8", "surrogatepass"), digest_size=8)
        for child in self.children:
            if isinstance(child, str):
                own.update(b"\1" + " ".join(child.split()).encode("utf-8", "surrogatepass"))
            else:
                own.update(b"\2" + child.hash)
                if self.headline is None:
                    self.headline = child.headline
        if self.tag in HEADLINES:
            self.headline = beginning(self)
        self.hash = own.digest()


def beginning(element: Element, most: int = 64) -> str:
    """The text of the first of ``element``'s nodes."""
    found, stack = [], [element]
    while stack and most:
        node, most = stack.pop(), most - 1
        if isinstance(node, str):
            found.append(node)
        else:
            stack.extend(reversed(node.children[:most]))
    return "".join(found)


def attributes(html: str, at: int) -> tuple[dict[str, str], bool, int]:
    """The attributes that begin at ``at``, whether the tag closes itself, and where it ends (-1: it never does)."""
    found: dict[str, str] = {}
    while True:
        begin = at
        at = _SLASHES.match(html, at).end()
        if at >= len(html):
            return found, False, -1
        if html[at] == ">":
            return found, html[at - 1] == "/" and at > begin, at + 1
        match = _ATTRIBUTE.match(html, at)
        name, double, _, single, _, plain = match.groups()
        found.setdefault(name.lower(), unescape(double or single or plain or ""))
        at = match.end()


class Tree:
    """The open elements of a page, and where each tag's are in the stack."""

    def __init__(self):
        self.root = Element("#page")
        self.stack, self.places, self.blocks = [self.root], {}, []

    def push(self, element: Element) -> None:
        self.places.setdefault(element.tag, []).append(len(self.stack))
        if element.tag in BLOCKS:
            self.blocks.append(len(self.stack))
        self.stack.append(element)

    def pop(self, upto: int) -> None:
        while len(self.stack) > upto:
            element = self.stack.pop()
            if element.tag in self.places:
                self.places[element.tag].pop()
            if element.tag in BLOCKS:
                self.blocks.pop()
            element.close()

    def last(self, tags) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def close(self, tags, bounds) -> None:
        """Closes the last open element of ``tags`` that no open element of ``bounds`` shields."""
        if (at := self.last(tags)) > self.last(bounds):
            self.pop(at)

    def end(self, tag: str) -> None:
        at = self.last((tag,))
        if not at:
            return
        if tag in _TABLES:
            if tag == "table" or at > self.last(("table",)):
                self.pop(at)
        elif tag in BLOCKS:
            if at > self.last(_BOUNDS):
                self.pop(at)
        elif not self.blocks or self.blocks[-1] < at:  # the end of bold print and the like ends no block
            self.pop(at)


def parse(html: str) -> Element:
    """The tree of a page; texts have their character references decoded."""
    tree, at, size = Tree(), 0, len(html)
    while at < size:
        begin = html.find("<", at)
        while begin >= 0 and not (html[begin + 1 : begin + 2] in ("!", "?", "/") or html[begin + 1 : begin + 2].isascii() and html[begin + 1 : begin + 2].isalpha()):
            begin = html.find("<", begin + 1)  # an ordinary character
        if (text := html[at : begin if begin >= 0 else size]) :
            tree.stack[-1].children.append(unescape(text))
        if begin < 0:
            break
        if html.startswith("<!--", begin):
            if html.startswith((">", "->"), begin + 4):
                at = html.index(">", begin) + 1
            else:
                end = _COMMENT_END.search(html, begin + 4)
                at = end.end() if end else size
            continue
        closing = html[begin + 1] == "/"
        first = html[begin + 1 + closing : begin + 2 + closing]
        if not (first.isascii() and first.isalpha()):
            end = html.find(">", begin)
            at = end + 1 if end >= 0 else size
            continue
        match = _TAG.match(html, begin + 1 + closing)
        tag, at = match[0].lower(), match.end()
        named, closed = {}, False
        if html[at : at + 1] == ">":
            at += 1
        else:
            named, closed, at = attributes(html, at)
            if at < 0:
                break
        if closing and tag != "br":
            tree.end(tag)
            continue
        if tag in BLOCKS:
            tree.close(("p",), ("td", "th", "button", "table"))
        if tag in _CLOSES:
            tree.close(*_CLOSES[tag])
        element = Element(tag)
        if named:
            element.classes, element.ident = named.get("class", "").strip(), named.get("id", "").strip()
            element.role = named.get("role", "").lower()
            element.hidden = "hidden" in named or bool(_HIDDEN.search(named.get("style", "")))
        tree.stack[-1].children.append(element)
        if tag in VOID or closed and tag in ("svg", "path", "circle", "rect", "line", "use", "g"):
            element.close()
        elif tag in RAW:
            end = _RAW_END[tag].search(html, at)
            element.children.append(html[at : end.start() if end else size])
            element.close()
            at = size
            if end:
                at = attributes(html, end.end())[2]
                if at < 0:
                    break
        else:
            tree.push(element)
    tree.pop(0)
    _mark_titles(tree.root)
    return tree.root


def _mark_titles(root: Element) -> None:
    """Marks the headers that hold an h1, unless one stands outside headers and so is the title."""
    headers, stack = {}, [(root, None)]
    while stack:
        element, header = stack.pop()
        for child in element.children:
            if isinstance(child, Element) and child.headline is not None:
                if child.tag == "h1":
                    if header is None:
                        return
                    headers[id(header)] = header
                elif header is None and (child.tag == "header" or child.tag in BOXES and is_named(child.classes, HEADERS)):
                    stack.append((child, child))
                    continue
                stack.append((child, header))
    for header in headers.values():
        header.titled = True


def is_named(name: str, words: frozenset[str] = NAMES) -> bool:
    """Whether one of the names in a class or an id is made of boilerplate's words alone, one of ``words`` among them."""
    for own in name.split():
        parts = [x.lower() for x in _PARTS.findall(own)]
        if any(x in words for x in parts) and all(x in NAMES or x in BESIDE or x.isdigit() for x in parts):
            return True
    return False


def _says(ident: str, headline: str | None) -> bool:
    """Whether an id is made of the words of a headline, but for a number at its end."""
    words = lambda x: [w.lower() for w in re.findall(r"\w+", x.replace("_", " "))]
    own, other = words(ident), words(headline or "")
    return bool(other) and (own == other or own[:-1] == other and own[-1].isdigit())


def is_boilerplate(element: Element, inside: bool = False) -> bool:
    """``inside``: in an article."""
    if element.role in ROLES or element.hidden:
        return True
    if element.tag == "header":
        return not (element.titled or inside and element.headline is not None)
    if element.tag in BOILERPLATE:
        return True
    if element.tag == "article":
        return is_named(element.classes, COMMENTS)
    if element.tag not in (BOXES if inside else JUDGED) or element.titled:
        return False
    words = NAMES - HEADERS if inside else NAMES
    if element.classes and is_named(element.classes, words):
        return True
    return bool(element.ident) and element.tag in BOXES and is_named(element.ident, words) and not _says(element.ident, element.headline)


def _is_article(element: Element, kind: str) -> bool:
    return element.tag == kind or element.role == kind


def main_kind(root: Element) -> str:
    """What holds the main text: the article elements, or else the main ones, or else all of the page."""
    found, stack = "", [root]
    while stack:
        for child in stack.pop().children:
            if isinstance(child, Element) and not is_boilerplate(child):
                if _is_article(child, "article"):
                    return "article"
                if _is_article(child, "main"):
                    found = "main"
                stack.append(child)
    return found


def _may_go(element: Element, inside: bool) -> bool:
    return element.tag in BLOCKS and element.tag not in ("html", "body", "article", "main", "header") and not (inside and element.tag in PROSE)


def subtrees(root: Element) -> tuple[bytes, set[bytes]]:
    """What names the page's article, and hashes of the subtrees that could be a template: all but text blocks inside it."""
    kind = main_kind(root)
    own, found, stack = blake2b(digest_size=8), set(), [(root, False)]
    while stack:
        element, inside = stack.pop()
        for child in element.children:
            if isinstance(child, Element) and child.tag not in RAW and child.tag not in VOID and not is_boilerplate(child, inside):
                within = inside or bool(kind) and _is_article(child, kind)
                if within and not inside or not kind and child.tag == "body":
                    own.update(child.hash)
                if _may_go(child, within):
                    found.add(child.hash)
                stack.append((child, within))
    return own.digest() if kind else root.hash, found


def main_text(root: Element, templates: frozenset[bytes] | set[bytes] = frozenset()) -> str:
    """The blocks of the articles, or of the page where there are none, without boilerplate and templates."""
    blocks, now = [], []
    kind = main_kind(root)

    def end() -> None:
        text = " ".join("".join(now).split())
        now.clear()
        if text:
            blocks.append(text)

    # (element, its children to come, kept)
    stack = [(root, iter(root.children), not kind)]
    while stack:
        element, children, keep = stack[-1]
        for child in children:
            if isinstance(child, str):
                if keep:
                    now.append(child)
                continue
            inside = keep and bool(kind)
            if is_boilerplate(child, inside) or (child.hash in templates and _may_go(child, inside)):
                if child.tag in BLOCKS:
                    end()
                continue
            if child.tag in BLOCKS:
                end()
            elif child.tag in ("br", "td", "th"):
                now.append(" ")
            stack.append((child, iter(child.children), keep or bool(kind) and _is_article(child, kind)))
            break
        else:
            stack.pop()
            if element.tag in BLOCKS:
                end()
    end()
    return "\n\n".join(blocks)


def site_templates(pages: DataFrame, least: int = LEAST_PAGES, share: float = SHARE) -> DataFrame:
    """``host``, ``hash``: subtrees on many distinct pages of a host.  ``pages``: ``host``, ``html``."""

    def hashed(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                hosts, articles, hashes = [], [], []
                for host, html in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                    article, own = subtrees(parse(html))
                    own = [b"", *own]  # the empty hash counts the pages
                    hosts += [host] * len(own)
                    articles += [article] * len(own)
                    hashes += own
                yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(articles, pa.binary()), pa.array(hashes, pa.binary())], ["host", "article", "hash"])

    seen = pages.mapInArrow(hashed, "host string, article binary, hash binary").distinct()
    counts = seen.groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n"))
    counts = cut(counts.filter(F.col("n") >= least))
    total = counts.filter(F.length("hash") == 0).select("host", F.col("n").alias("pages"))
    return counts.filter(F.length("hash") > 0).join(total, "host").filter(F.col("n") >= F.col("pages") * share).select("host", "hash")


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_PAGES, share: float = SHARE) -> DataFrame:
    """One row for each input row: id, url, ``text`` (blocks joined by an empty line), ``n_chars``."""
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("_id"), url.alias("_url"), F.coalesce(host_and_path(url)[0], F.lit("")).alias("host"), text_of(html_col).alias("html"))
    templates = cut(site_templates(rows.select("host", "html"), least, share))
    small = broadcast_if_small(templates)
    by_host = templates.groupBy("host").agg(F.collect_list("hash").alias("templates"))
    joined = rows.join(F.broadcast(by_host) if small is not templates else by_host, "host", "left").select("_id", "_url", "html", "templates")

    def extracted(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(parse(html), set(own or ())) for html, own in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["_id", "_url", "text", "n_chars"])

    kind = rows.schema["_id"].dataType.simpleString()
    found = joined.mapInArrow(extracted, f"_id {kind}, _url string, text string, n_chars long")
    return found.select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), "text", "n_chars")
