"""Main text of web pages by tree scoring.

A tolerant parser builds the element tree. Elements that by tag or role hold menus, headers, footers, sidebars, notices,
adverts, forms, comments or no text go first, and those that by class or id do. A name is taken whole: all its words must be
words of layout ("ad-banner", but not "share-price"; modifiers and a one-letter prefix don't count), or links must hold a good part of
the text, or it says that readers comment there. Inside an article a paragraph or a section with paragraphs isn't a header
or a notice whatever it is called. Each paragraph then passes points for its length and commas to its
parent, half to the next ancestor, a third to the one above, and so on; a container's score is discounted by the share of
its text that stands in links. The best container, widened to an article that encloses it, and those of its siblings that
look like text, or have its tag and class and hold paragraphs, are kept, block by block. Lists of nothing but links are
menus, but not in an article, nor where they follow a heading or a paragraph of the best container.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from scholia.llm.common import map_rows, table

RAW = frozenset("script style title textarea iframe noembed noframes xmp noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre section summary table caption thead tbody tfoot tr td th ul".split()
)
#: Elements that a start tag ends if they are open, up to an element of the second set.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr", "td",
    "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"},
    {"select"})}
GONE_TAGS = frozenset("head script style title textarea iframe noembed noframes xmp noscript nav aside footer form button input "
     "select option label fieldset dialog template svg canvas object embed audio video menu annotation " "annotation-xml".split())
GONE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
GONE_WORDS = frozenset(
    "nav navbar navigation menu menus breadcrumb breadcrumbs header masthead topbar footer foot bottombar sidebar side aside rail widget widgets "
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices "
    "alert popup modal overlay newsletter subscribe signup login form search comment comments commentlist respond disqus discussion replies reply "
    "share sharing social related recommended pagination pager toolbar skip copyright".split()
)
#: What such names have beside these words.
FILLER = frozenset(
    "area bar block body bottom box btn button buttons cell center col column container content div elem "
         "element first full group head heading holder icon icons id inner item items "
    "last left link links list main mobile module nested new node outer page panel part post posts primary "
         "right row sec secondary section site slot small story stories sub text "
    "title top unit wrap wrapper zone article articles a in of on the to us your follow feed sticky fixed global js".split()
)
#: Of the first, what stays gone even where an article stands in it: a comment or a teaser may be an article too.
HARD_WORDS = frozenset("comment comments commentlist respond disqus discussion replies reply sidebar related recommended ad ads advert".split())
#: Of those, what says by itself that readers comment there, whatever stands beside it.
COMMENT_WORDS = frozenset("comment comments commentlist respond disqus replies".split())
#: What a paragraph, or an element that holds some, may be called inside an article.
OWN_WORDS = frozenset("header notice notices alert".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: What comes next inside a tag: its end, or an attribute with a double-quoted, single-quoted or unquoted value, a quoted
#: value that nothing ends, or none. Possessive, so that every character is read once.
_NEXT = re.compile(r"""[ \t\n\f\r/]*+(?:(>)|([^ \t\n\f\r/>][^ \t\n\f\r/>=]*+)(?:[ \t\n\f\r]*+=[ """
     r"""\t\n\f\r]*+(?:"([^"]*+)"|'([^']*+)'|(["'])|([^ \t\n\f\r>"'][^ \t\n\f\r>]*+)|(?=>)))?+)""")
_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("attrs", "chars", "commas", "gone", "kids", "linked", "parent", "score", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.kids = tag, attrs, parent, []
        self.gone, self.score, self.chars, self.linked, self.commas = False, 0.0, 0, 0, 0


def _attributes(source: str, at: int) -> tuple[int, list[tuple[str, str]]]:
    """Where the tag whose name ends at `at` has its >, or -1, and its attributes. A > inside a quoted value doesn't end the
    tag, nor does a quote of the other kind or inside an unquoted value begin one. A quoted value that nothing ends is
    taken as cut off by the next >."""
    found = []
    while m := _NEXT.match(source, at):
        if m[1]:
            return m.end() - 1, found
        if m[5]:
            return source.find(">", m.end()), found
        found.append((m[2], m[3] or m[4] or m[6] or ""))
        at = m.end()
    return -1, found


def parse(source: str) -> tuple[Node, list[Node]]:
    """The root of the element tree, and all elements, parents before children."""
    root = Node("html", {}, None)
    nodes, stack, open_tags, at, size = [root], [root], {"html": 1}, 0, len(source)

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            open_tags[stack.pop().tag] -= 1

    def depth_of(tags: set[str], stop: set[str]) -> int | None:
        """Where the outermost of the tags lies that nothing of stop covers."""
        found = None
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in stop:
                break
            if stack[i].tag in tags:
                found = i
        return found

    while at < size:
        less = source.find("<", at)
        if less < 0:
            less = size
        if less > at:
            stack[-1].kids.append(source[at:less])
        if less == size:
            break
        if source.startswith("<!--", less):
            end = source.find("-->", less + 4)
            at = size if end < 0 else end + 3
            continue
        m = _NAME.match(source, less + 1)
        if not m:
            if source[less + 1 : less + 2] in ("!", "?", "/"):
                end = source.find(">", less)
                at = size if end < 0 else end + 1
            else:  # a plain less-than sign
                stack[-1].kids.append("<")
                at = less + 1
            continue
        end = source.find(">", m.end())
        inner = source[m.end() : size if end < 0 else end]
        found: list[tuple[str, str]] = []
        if "=" in inner or "hidden" in inner:
            end, found = _attributes(source, m.end())
        end = size if end < 0 else end
        tag, inner, at = m[1].lower(), source[m.end() : end], end + 1
        if source[less + 1] == "/":
            if open_tags.get(tag) and tag != "html":
                i = len(stack) - 1
                while stack[i].tag != tag:
                    i -= 1
                pop_to(i)
            continue
        if tag == "html":
            continue
        if tag in BLOCK and open_tags.get("p") and (i := depth_of({"p"}, {"button", "table", "td", "th"})) is not None:
            pop_to(i)
        if tag in ENDS and any(open_tags.get(x) for x in ENDS[tag][0]) and (i := depth_of(*ENDS[tag])) is not None:
            pop_to(i)
        attrs = {k.lower(): html.unescape(v) for k, v in found}
        node = Node(tag, attrs, stack[-1])
        stack[-1].kids.append(node)
        nodes.append(node)
        if tag in RAW:
            close = re.compile(f"</{tag}(?=[\\s/>]|$)", re.I).search(source, at)
            at = close.start() if close else size
            after = source.find(">", at)
            at = size if after < 0 else after + 1
        elif tag not in VOID and not inner.endswith("/"):
            stack.append(node)
            open_tags[tag] = open_tags.get(tag, 0) + 1
        elif tag not in VOID and tag not in ("svg", "path"):  # <p/> is <p> in HTML
            stack.append(node)
            open_tags[tag] = open_tags.get(tag, 0) + 1
    return root, nodes


def _names(node: Node) -> list[set[str]]:
    """The words of each class and id, without modifiers and a prefix of one letter."""
    named = (_TOKEN.findall(name.split("--")[0]) for k in ("class", "id") for name in node.attrs.get(k, "").split())
    return [{w.lower() for w in (words[1:] if len(words) > 1 and len(words[0]) == 1 else words)} for words in named]


def _named(node: Node, words: frozenset[str]) -> bool:
    """Whether a class or id of the node has one of the words and no other than words of layout; of an element that holds
    others, whether it has a word for comments."""
    outer = any(isinstance(k, Node) for k in node.kids) or node.tag in ("div", "section", "ol", "ul")
    return any(x & words and x <= GONE_WORDS | FILLER or outer and node.tag != "p" and x & words & COMMENT_WORDS for x in _names(node))


def _in_article(node: Node) -> bool:
    p = node.parent
    while p is not None and p.tag != "article":
        p = p.parent
    return p is not None


def boilerplate(node: Node) -> bool:
    """Whether a node by itself holds no text of an article; what its links tell is left to `main_text`."""
    if node.tag in GONE_TAGS or node.tag in RAW:
        return True
    if not node.attrs or node.tag in ("html", "body", "main"):
        return False
    if node.tag == "article":
        return _named(node, HARD_WORDS)
    a = node.attrs
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or a.get("role",
        "").lower() in GONE_ROLES or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""), re.I):
        return True
    if not _named(node, GONE_WORDS):
        return False
    own = node.tag == "p" or any(isinstance(k, Node) and k.tag == "p" for k in node.kids)
    return not (own and not _named(node, GONE_WORDS - OWN_WORDS) and _in_article(node))


def _lines(node: Node, only: list | None = None) -> list[str]:
    """The blocks of text in a node (or in some of its children), in page order."""
    out, now, todo = [], [], [(node, False)] if only is None else [(x, False) for x in reversed(only)]

    def end() -> None:
        text = _SPACE.sub(" ", html.unescape("".join(now))).strip()
        if text:
            out.append(text)
        now.clear()

    while todo:
        x, left = todo.pop()
        if left:
            end()
        elif isinstance(x, str):
            now.append(x)
        elif x.tag == "br":
            now.append("\n")
        elif not x.gone:
            if x.tag in BLOCK:
                end()
                todo.append((x, True))
            todo.extend((k, False) for k in reversed(x.kids))
    end()
    return out


def _menu(node: Node) -> bool:
    """Whether it is a list of links and nothing else."""
    return node.tag in ("ul", "ol") and node.chars > 0 and node.linked / node.chars > 0.9 and sum(isinstance(k, Node) for k in node.kids) >= 3


def _within(node: Node, outer: Node) -> bool:
    while node is not None and node is not outer:
        node = node.parent
    return node is outer


def _follows_text(node: Node) -> bool:
    """Whether it comes right after a heading or paragraph of its parent, or lies in an article."""
    if node.parent.tag in ("article", "main"):
        return True
    before = None
    for k in node.parent.kids:
        if k is node:
            break
        if isinstance(k, Node) and not k.gone:
            before = k
    return before is not None and (before.tag in HEADINGS or before.tag == "p")


def _alike(node: Node, best: Node) -> bool:
    """Whether a sibling has the best container's tag and class, and paragraphs of its own."""
    return node.tag == best.tag and node.attrs.get("class") == best.attrs.get("class") and any(isinstance(k, Node) and k.tag == "p" and not k.gone for k in node.kids)


def main_text(source: str | None) -> str:
    """The main text of a page: its blocks, joined by one line feed; empty if there is none."""
    root, nodes = parse(source or "")
    holds = set()  # elements that hold an article, main or top heading are layout, whatever their class says
    leading = set()  # those that hold main or a top heading
    for n in nodes:
        for tags, found in ((("article", "main", "h1"), holds), (("main", "h1"), leading)):
            p = n.parent if n.tag in tags and not (n.tag == "article" and boilerplate(n)) else None
            while p is not None and id(p) not in found:
                found.add(id(p))
                p = p.parent
    for n in nodes:
        if n.tag == "header":
            inside = n.parent
            while inside is not None and inside.tag not in ("article", "main"):
                inside = inside.parent
            if inside is None:
                n.gone = True
            else:  # of an article's header, its headings are text
                for k in n.kids:
                    if isinstance(k, Node) and k.tag not in HEADINGS:
                        k.gone = True
                n.kids = [k for k in n.kids if isinstance(k, Node)]
        elif boilerplate(n) and (n.tag in GONE_TAGS or id(n) not in holds or id(n) not in leading and _named(n, HARD_WORDS)):
            n.gone = True
    blocks: dict[int, tuple[Node, int, int, int]] = {}  # paragraphs: characters, commas, characters in links
    todo: list[tuple] = [(root, root, False)]
    while todo:
        x, block, link = todo.pop()
        if isinstance(x, str):
            n = len(x) - x.count(" ") if x.isspace() else len(x)
            if x.isspace():
                continue
            _, chars, commas, linked = blocks.get(id(block), (block, 0, 0, 0))
            blocks[id(block)] = (block, chars + n, commas + x.count(","), linked + n * link)
        elif not x.gone:
            inner = x if x.tag in BLOCK else block
            todo.extend((k, inner, link or x.tag == "a") for k in reversed(x.kids))
    for block, chars, commas, linked in blocks.values():
        points = (1 + commas + min(chars / 100, 3)) * (1 - linked / chars)
        block.chars += chars
        block.linked += linked
        share, p = 1, block if block.tag in ("div", "section", "article", "main", "body", "html") else block.parent
        while p is not None and share <= 5:
            p.score += points / share
            share, p = share + 1, p.parent
    for n in reversed(nodes):  # children come after their parents
        if n.parent is not None and not n.gone:
            n.parent.chars += n.chars
            n.parent.linked += n.linked
    for n in nodes:  # what a name hints at and links make out
        hinted = n.attrs and n.chars and n.linked / n.chars > 0.3 and id(n) not in holds and any(x & GONE_WORDS for x in _names(n))
        if not n.gone and n.tag not in ("html", "body", "main", "article") and hinted:
            n.gone = True
    live = [n for n in nodes if not n.gone and n.chars and n.tag in BLOCK and n.tag not in HEADINGS | {"p", "li", "html"}]
    if not live:
        return "\n".join(_lines(root))
    rank = lambda n: n.score * (1 - n.linked / n.chars) * (1.5 if n.tag in ("article", "main") or n.attrs.get("role") == "main" else 1)
    best = max(live, key=rank)
    p, whole = best, None
    while p is not None:
        if p.tag == "article" or (p.tag == "main" or p.attrs.get("role") == "main") and (whole is None or whole.tag != "article"):
            whole = p
        p = p.parent
    best = whole or best
    for n in nodes:
        if not n.gone and _menu(n) and not (_follows_text(n) if n.parent is best else whole is not None and _within(n, best)):
            n.gone = True
    if best.parent is None or best.tag == "body":
        return "\n".join(_lines(best))
    least, kept = max(3.0, 0.2 * rank(best)), []
    for k in best.parent.kids:
        if k is best:
            kept.append(k)
        elif isinstance(k, Node) and not k.gone and k.chars:
            plain = k.linked / k.chars < 0.3
            if k.tag in HEADINGS | {"p", "blockquote", "pre", "ul", "ol", "dl", "table",
                "figure"} and plain and whole is None or rank(k) >= least and plain or whole is None and plain and _alike(k, best):
                kept.append(k)
    return "\n".join(_lines(best, kept))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for each row of pages (page_id, url, html); other columns, whatever their names, aren't
    read. A page is read whole, in one pass and time linear in its length; its tree is what bounds the memory."""

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            found = [main_text(h) for h in batch.column("html").to_pylist()]
            return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": found, "n_chars": [len(x) for x in found]}

        return step

    return map_rows(pages.select("page_id", "url", "html"), make, "page_id long, url string, text string, n_chars long")


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text, however long. Further columns of the table aren't read. Null and empty html give an empty text;
    markup without any element gives its text; repeated rows are each extracted; an empty table gives no rows."""
    return extract(table(spark, sf_dir, "pages"))
