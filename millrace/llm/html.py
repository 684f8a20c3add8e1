"""Main text of web pages, with site templates removed by counting element subtrees per host.

1. Each page is parsed where it is read, and the subtrees of all its block elements are hashed before any other
   rule looks at them: tags, classes, ids and text, digits as one.  A subtree outside ``article`` and ``main`` whose text is
   mostly links is hashed a second time without its text, by its path and its shape (repeated children once), since
   menus keep their shape and change their links.  Inside ``article`` and ``main`` a bare paragraph, heading, list item or cell
   isn't hashed by itself: a sentence that an author repeats is no template, the box around it may be one.
2. One row per (host, subtree, page) survives an aggregation.  Pages with equal title and heading (without a heading:
   longest block) count as one, and so edited copies of one article count once, and a title that a whole site shares
   merges nothing.
3. A subtree that recurs on MIN_PAGES of these pages of a host is a template, however large the host is; on a host with
   fewer than twice as many pages, half of them will do, and LEAST_PAGES at least.
4. Pages meet the templates of their host, or where those are many, those of them that the page itself has, and these
   subtrees are deleted.  What no count can tell, as on a host with two pages, is left to tags, roles and whole
   class words.  The text of ``article`` elements is taken, of ``main`` if it has more text outside its articles than in them
   or no article, else what is left of the body.

White space inside a block becomes one space, blocks are joined by one newline, character
references are decoded; nothing else is dropped or cut.

Defined cases: null html counts as empty and gives an empty text; a null or unparsable url
belongs to the host ``''``; unclosed elements end with their parent; an unclosed comment or script
runs to the end; repeated rows get equal results; an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

import hashlib
import html as _html
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import stored, table

MIN_PAGES, LEAST_PAGES = 10, 3
#: Hosts with more templates than this, and all hosts where there are more than that in all, are matched page by page.
MOST_LISTED, MOST_BROADCAST = 500, 2_000_000

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|[^<]+|<""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "xmp")}

# HTML's element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
NOT_TEXT = frozenset("script style textarea title noscript iframe head template nav footer aside form button select svg canvas object audio video dialog menu map datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
WORDS = frozenset("ad ads adv advert adverts advertisement advertisements advertising adslot adbox sponsor sponsors sponsored promo promos sidebar sidebars menu nav navbar navigation footer modal overlay popup popups widget pagination pager login signin signup search toolbar masthead topbar notice alert gdpr consent cookie cookies banner share sharing social breadcrumb breadcrumbs newsletter related recommended recommendations outbrain taboola skip subscribe paywall disqus comment comments respond reply replies".split())
#: A class of one of WORDS and these counts inside an article too, as ``comment-list``.
STRUCTURE = frozenset("list box area section wrapper wrap container block form links link buttons button bar slot unit feed thread posts post items item inner outer holder panel module region".split())
#: An ``article`` inside one of these is not the page's article.
NOT_WRAPPERS = ("comment", "related", "recommend", "respond", "repl")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements of running text.
RUNNING = HEADINGS | frozenset("p li blockquote pre td th dd dt figcaption".split())
DIGITS = re.compile(r"[0-9]+(?:[.,:/-][0-9]+)*")
SAME_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


@dataclass
class Page:
    """Blocks of text (text, element, in article, in main) and, for elements, parents and subtree hashes."""

    title: str = ""
    heading: str = ""
    blocks: list[tuple[str, int, bool, bool]] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    hashes: list[int] = field(default_factory=list)
    shapes: list[int] = field(default_factory=list)


@dataclass(slots=True)
class Open:
    """An open element: its number, why it is left out, where it stands, where its parts begin, and its text so far."""

    tag: str
    element: int = -1
    why: str = ""
    in_article: bool = False
    in_main: bool = False
    named: str = ""
    first: int = 0
    path: str = ""
    shapes: list[str] = field(default_factory=list)
    chars: int = 0
    linked: int = 0


def _words(attributes: dict[str, str], in_text: bool) -> list[str]:
    if in_text:  # ids and parts of class names are words of the article there
        names = [re.split(r"[_-]+", c) for c in attributes.get("class", "").lower().split()]
        return [x[0] for x in names if STRUCTURE.issuperset(x[1:])]
    return re.split(r"[\s_-]+", f"{attributes.get('class', '')} {attributes.get('id', '')}".lower())


def _boilerplate(tag: str, attributes: dict[str, str], in_article: bool, in_main: bool) -> str:
    """Why the element is left out, or an empty string."""
    if tag in NOT_TEXT or tag == "header" and not in_article:
        return "tag"
    if not attributes:
        return ""
    if tag in ("html", "body", "main"):
        return ""
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return "hidden"
    if attributes.get("role", "").lower() in ROLES:
        return "role"
    if (in_article or in_main) and (tag in RUNNING or tag not in BLOCK):
        return ""
    for w in _words(attributes, in_article or in_main):
        if w in WORDS or w == "header" and not in_article:
            return w
    return ""


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def parse(source: str, hashed: bool = True) -> Page:
    page = Page()
    # Parts are tags, marked by a NUL, texts, and digests of closed blocks.
    stack: list[Open] = [Open("")]
    parts: list[str] = []
    buffer: list[str] = []
    at, n = 0, len(source)

    def flush() -> None:
        if buffer:
            text = " ".join("".join(buffer).split())
            buffer.clear()
            if text:
                top = stack[-1]
                if not page.heading and any(x.tag in HEADINGS for x in stack[-3:]):
                    page.heading = text
                page.blocks.append((text, top.element, top.in_article, top.in_main))

    def end(top: Open, outer: Open) -> None:
        """Hash a closed element and hand its shape and counts to its parent."""
        outer.chars += top.chars
        outer.linked += top.chars if top.tag == "a" else top.linked
        shape = top.named
        if top.tag in BLOCK:
            inner = top.shapes
            shape += "(" + ",".join(x for i, x in enumerate(inner) if not i or x != inner[i - 1]) + ")"
            if len(shape) > 64:
                shape = f"{top.tag}~{_digest(shape):x}"
            if top.tag not in ("html", "body", "article", "main") and top.chars:
                inside = parts[top.first :]
                del parts[top.first :]  # the parent's hash is taken over its children's
                digest = _digest(top.named + "\x1f" + DIGITS.sub("0", " ".join("\x1f".join(inside).split())))
                parts.append(f"#{digest:x}")
                in_text = top.in_article or top.in_main
                if not (in_text and top.tag in RUNNING and top.named == top.tag):
                    page.hashes[top.element] = digest
                if not in_text and 2 * top.linked >= top.chars:
                    page.shapes[top.element] = _digest(top.path + ">" + shape)
        outer.shapes.append(shape)

    def close(depth: int) -> None:
        while len(stack) > depth:
            if stack[-1].tag in BLOCK:
                flush()
            top = stack.pop()
            if hashed:
                end(top, stack[-1])

    while at < n:
        m = TOKEN.match(source, at)
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            text = m[0]
            if text.startswith("<![CDATA["):
                text = text[9:-3]
            elif text[0] == "<" and len(text) > 1:
                continue
            text = _html.unescape(text)
            top = stack[-1]
            if not top.why:
                buffer.append(text)
            if hashed and (size := len(text.strip())):
                parts.append(text)
                top.chars += size
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    close(depth)
                    break
            continue
        if tag in BLOCK:
            flush()
            closes = SAME_CLOSES.get(tag)
            for depth in range(len(stack) - 1, 0, -1):
                open_tag = stack[depth].tag
                if closes and open_tag in closes or not closes and open_tag == "p":
                    close(depth)
                    break
                if open_tag in BLOCK and open_tag not in ("p", *(closes or ())):
                    break
        if tag in VOID:
            if not stack[-1].why:
                buffer.append(" ")
            continue
        raw_attributes = m[3] or m[6] or ""
        attributes = {k.lower(): a or b or c or "" for k, a, b, c in ATTRIBUTE.findall(raw_attributes)} if raw_attributes.strip(" /") else {}
        top = stack[-1]
        own = _boilerplate(tag, attributes, top.in_article, top.in_main)
        why = top.why
        if tag in ("article", "main") and why not in ("", "tag", "hidden", "role") and not own and not why.startswith(NOT_WRAPPERS):
            why = ""
        why = why or own
        if tag in RAW:
            stop = RAW[tag].search(source, at)
            if tag == "title" and not page.title:
                page.title = " ".join(_html.unescape(source[at : stop.start() if stop else n]).split())
            at = stop.end() if stop else n
            continue
        page.parents.append(top.element)
        page.hashes.append(0)
        page.shapes.append(0)
        named = tag
        if hashed and attributes:
            named += "".join(f" {k}={attributes[k]}" for k in ("class", "id", "role") if k in attributes)
        if hashed:
            parts.append(f"\0{named}")
        path = f"{top.path}>{top.named}" if len(top.path) < 200 else f"~{_digest(top.path + '>' + top.named):x}"
        in_main = top.in_main or tag == "main" or attributes.get("role") == "main"
        stack.append(Open(tag, len(page.parents) - 1, why, top.in_article or tag == "article", in_main, named, len(parts), path))
    flush()
    close(1)
    return page


def main_text(page: Page, templates: frozenset[int] = frozenset()) -> str:
    blocks = page.blocks
    if templates:
        gone: list[bool] = []
        for parent, h, shape in zip(page.parents, page.hashes, page.shapes, strict=True):  # parents come first
            gone.append(h in templates or shape in templates or parent >= 0 and gone[parent])
        blocks = [b for b in blocks if b[1] < 0 or not gone[b[1]]]
    article = sum(len(b[0]) for b in page.blocks if b[2])
    beside = sum(len(b[0]) for b in page.blocks if b[3] and not b[2])
    if article and article >= beside:
        return "\n".join(b[0] for b in blocks if b[2])
    if article or beside:
        return "\n".join(b[0] for b in blocks if b[3])
    return "\n".join(b[0] for b in blocks)


def _with_host(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"), host.alias("_host"))


PAGE = ["_host", "_k1", "_k2"]


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, least_pages: int = LEAST_PAGES) -> tuple[DataFrame, DataFrame]:
    """``_host, subtree``, the hashes of the subtrees that recur on each host, and ``_host, _k1, _k2, found``, those that
    each page has; both written."""

    def subtrees(batches):
        for batch in batches:
            titles, found = [], []
            for source in batch.column(3):
                page = parse(source.as_py() or "")
                titles.append(_digest(f"{page.title}\x1f{page.heading or max((b[0] for b in page.blocks), key=len, default='')}"))
                found.append(sorted({h for h in (*page.hashes, *page.shapes) if h}))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(titles, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=[*PAGE, "title", "found"])

    seen = stored(pages.select(*PAGE, "html").mapInArrow(subtrees, "_host string, _k1 long, _k2 long, title long, found array<long>"), "subtrees")
    counts = seen.select("_host", "title", F.explode("found").alias("subtree")).distinct().groupBy("_host", "subtree").agg(F.count("*").alias("n"))
    sizes = seen.select("_host", "title").distinct().groupBy("_host").agg(F.count("*").alias("_pages"))
    enough = F.least(F.lit(min_pages), F.greatest(F.lit(least_pages), F.ceil(F.col("_pages") / 2)))
    frequent = counts.filter(F.col("n") >= min(least_pages, min_pages)).join(sizes, "_host").filter(F.col("n") >= enough)
    return stored(frequent.select("_host", "subtree"), "frequent"), seen


def extract(pages: DataFrame, most_listed: int = MOST_LISTED, most_broadcast: int = MOST_BROADCAST, **how) -> DataFrame:
    """``page_id, url, text, n_chars`` of each page."""
    source = F.coalesce("html", F.lit(""))
    pages = _with_host(pages).withColumns({"_k1": F.xxhash64(source), "_k2": F.xxhash64(F.lit(7), source)})

    def texts(batches):
        for batch in batches:
            out = []
            for source, gone in zip(batch.column(2), batch.column(3), strict=True):
                gone = frozenset(gone.as_py() or ())
                out.append(main_text(parse(source.as_py() or "", hashed=bool(gone)), gone))
            columns = [batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    frequent, seen = templates(pages, **how)
    sizes = stored(frequent.groupBy("_host").agg(F.count("*").alias("_n")), "sizes")
    columns = ["page_id", "url", "html", "_templates"]

    def by_page(rows: DataFrame) -> DataFrame:
        """Pages with their own templates, by a key that no host gathers in a task."""
        own = seen.select(*PAGE, F.explode("found").alias("subtree")).distinct()
        own = own.join(frequent, ["_host", "subtree"], "left_semi").groupBy(*PAGE).agg(F.collect_set("subtree").alias("_templates"))
        return rows.join(own, PAGE, "left").select(*columns)

    if frequent.count() > most_broadcast:
        rows = by_page(pages)
    else:
        # Both tables are bounded by MOST_BROADCAST numbers.
        few, many = sizes.filter(F.col("_n") <= most_listed).select("_host"), sizes.filter(F.col("_n") > most_listed).select("_host")
        lists = stored(frequent.join(few, "_host", "left_semi").groupBy("_host").agg(F.collect_set("subtree").alias("_templates")), "templates")
        rows = pages.join(F.broadcast(lists), "_host", "left")
        if not many.isEmpty():
            seen = seen.join(F.broadcast(many), "_host", "left_semi")
            rows = rows.join(F.broadcast(many), "_host", "left_anti").select(*columns).unionByName(by_page(pages.join(F.broadcast(many), "_host", "left_semi")))
    return rows.select(*columns).mapInArrow(texts, "page_id long, url string, text string, n_chars long")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
