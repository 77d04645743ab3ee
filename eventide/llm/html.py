"""Main text of web pages, with removal of site templates.

Every page is read once into a stream of tags and text. Elements that are
boilerplate by their kind or by the words in their class, id or role go at once.
Every other element that could belong to a site's template is hashed with all
below it; Spark counts per host how many different texts stand around each hash, so
that copies of a page count once, and subtrees that recur around many texts of
their host are deleted when the text is taken out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stage

#: A subtree is a template from so many pages of a host on, if that is also this share of the host's pages; pages count once for each text beside it.
LEAST_PAGES, LEAST_SHARE = 5, 0.1
#: Template lists up to so many subtrees are sent to every task; longer ones are joined.
MOST_SENT = 200_000

# Elements without an end tag, elements that break a line of text, elements that end an open paragraph,
# elements that are never text, and words that mark boilerplate.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html "
    "li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
NEVER = frozenset("aside button canvas dialog datalist footer form head iframe input label nav menu noscript object option script select style svg template textarea title".split())
MARKS = frozenset(
    "ad ads adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disclaimer discussion disqus "
    "footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup popular promo promoted promotion "
    "recommended related reply replies respond search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
# A name of several words is marked by its last one, or by its first one before a word for a part of a page, unless it has one of STATES or begins with one of PARTS.
STATES = frozenset("no not with without has have open closed enabled disabled".split())
PARTS = frozenset("content category tag type format status layout template".split())
PLACES = frozenset(
    "area bar block body bottom box button buttons col column container content frame group holder icons inner item items label left link links list main outer panel right row section slot space "
    "strip title top unit wrap wrapper zone".split()
)
#: What a header is of, if it holds a title.
TITLED = frozenset("article entry post story content section".split())
#: Marks of places that hold articles of their own, such as comments and teasers.
LISTS = frozenset("comment comments commentlist discussion disqus popular promo promoted recommended related replies reply respond sidebar sponsored widget widgets".split())
ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CELLS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?:script|style|textarea|template|noscript|iframe|svg)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>|</?[a-zA-Z][^>]*>|<[!?][^>]*>",
    re.S,
)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "template", "noscript", "iframe", "svg")}
_HOST = re.compile(r"://([^/?#]*)")


def host_of(url: str | None) -> str:
    found = _HOST.search(url or "")
    return found[1].lower() if found else ""


def _marks(name: str, inside: bool) -> frozenset[str]:
    """The marks of a class or id."""
    words = [w for w in re.split(r"[^a-z]+", name) if w]
    if not words or len(words) > 1 and (words[0] in PARTS or not STATES.isdisjoint(words)):
        return frozenset()
    if "header" in words and (inside or not TITLED.isdisjoint(words)):
        words = [w for w in words if w != "header"]
    return MARKS.intersection([*words[-1:], *(words[:1] if words[-1] in PLACES else [])])


def _boilerplate(tag: str, markup: str, inside: bool, sheltered: bool = False) -> bool:
    """Whether an element is boilerplate; a sheltered one holds the main text, so that only the marks of lists count."""
    if (tag in NEVER or (tag == "header" and not inside)) and not (sheltered and tag in ("form", "header")):
        return True
    if len(markup) <= len(tag) + 2:
        return False
    for name, *values in _ATTRIBUTE.findall(markup, len(tag) + 1):
        value, name = "".join(values).lower(), name.lower()
        if name == "role" and value in ROLES and not sheltered or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name in ("class", "id") and tag not in ("body", "html", "main") and (tag != "article" or inside):
            marks = frozenset().union(*(_marks(x, inside) for x in value.split()))
            if marks & LISTS if sheltered else marks:
                return True
    return False


def read_page(html: str, templates: frozenset[int] | set[int] = frozenset(), shelter: frozenset[int] | None = None, forms: bool = False) -> tuple[list[str], list[tuple[int, int, int]]]:
    """The blocks of main text, and without ``templates`` the subtrees with text that could be one: hash, first block, block behind the last.

    ``shelter`` has where the elements begin that hold the first article or main; without it they are found, if one of them is marked.
    With ``forms`` forms count as text, as they do in a page that has no other. A subtree is hashed with the hashes of those in it, so that
    time is linear in the page however deep it is.
    """
    blocks: list[tuple[str, bool]] = []
    subtrees: list[tuple[int, int, int]] = []
    text: list[str] = []
    # Open elements: name, start in the page, blocks before it, whether it is dropped, whether it lies in an article, whether it is hashed.
    stack: list[tuple[str, int, int, bool, bool, bool]] = [("", 0, 0, False, False, False)]
    open_tags: Counter[str] = Counter()
    # For each open element that is hashed: its hash so far, and up to where in the page.
    hashes: list[list] = []
    seen_form = found = False

    def flush() -> None:
        nonlocal found
        if text:
            line = " ".join(unescape("".join(text)).split())
            if line and not stack[-1][3]:
                blocks.append((line, stack[-1][4]))
                found = True
            text.clear()

    def close(end: int) -> None:
        name, start, before, dropped, _, hashed = stack[-1]
        if name in BLOCK or dropped:
            flush()
        stack.pop()
        open_tags[name] -= 1
        if hashed:
            whole, since = hashes.pop()
            whole.update(html[since:end].encode("utf-8", "surrogatepass"))
            h = whole.intdigest() >> 1
            if hashes:
                hashes[-1][0].update(whole.digest())
                hashes[-1][1] = end
            if h in templates:
                del blocks[before:]
            if len(blocks) > before:
                subtrees.append((h, before, len(blocks)))

    at, n = 0, len(html)
    while at < n:
        m = _TOKEN.search(html, at)
        if m is None:
            text.append(html[at:])
            break
        if m.start() > at:
            text.append(html[at : m.start()])
        markup, at = m[0], m.end()
        if markup[1] in "!?":
            continue
        tag = _NAME.match(markup)[1].lower()
        if markup[1] == "/":
            if open_tags[tag]:
                while stack[-1][0] != tag:
                    close(m.start())
                close(at)
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in VOID or markup.endswith("/>") and tag not in BLOCK:
            if tag in BLOCK:
                flush()
            continue
        if tag in _RAW:
            end = _RAW[tag].search(html, at)
            at = end.end() if end else n
            continue
        if tag in BLOCK:
            flush()
            if open_tags["p"]:  # a block ends the open paragraph
                low = len(stack) - 1
                while stack[low][0] not in BLOCK:
                    low -= 1
                if stack[low][0] == "p":
                    while len(stack) > low:
                        close(m.start())
            if tag in CELLS:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in SCOPES or not any(open_tags[x] for x in CELLS[tag]):
                        break
                    if stack[i][0] in CELLS[tag]:
                        while len(stack) > i:
                            close(m.start())
                        break
        _, _, _, dropped, inside, _ = stack[-1]
        if tag in ("article", "main") and shelter is None:
            if dropped:
                return read_page(html, templates, frozenset(x[1] for x in stack[1:]), forms)
            shelter = frozenset()
        seen_form = seen_form or tag == "form" and not dropped
        dropped = dropped or _boilerplate(tag, markup, inside, m.start() in (shelter or ()) or forms and tag == "form")
        inside = inside or (tag in ("article", "main") and not dropped)
        # Running text inside an article is its own, however often it is copied; only marked containers there can be a template.
        plain = tag not in BLOCK or tag in ("html", "body", "article", "main") or inside and (tag not in ("div", "section", "ul", "ol", "table", "header") or "=" not in markup)
        if tag not in BLOCK and dropped and not stack[-1][3]:
            flush()
        hashed = not dropped and not plain
        if hashed:
            if hashes:
                hashes[-1][0].update(html[hashes[-1][1] : m.start()].encode("utf-8", "surrogatepass"))
            hashes.append([xxhash.xxh3_64(), m.start()])
        stack.append((tag, m.start(), len(blocks), dropped, inside, hashed))
        open_tags[tag] += 1
    while len(stack) > 1:
        close(n)
    flush()
    if seen_form and not found and not forms:
        return read_page(html, templates, shelter, True)
    whole = any(inside for _, inside in blocks)
    lines = [line for line, inside in blocks if inside or not whole]
    if templates:
        return lines, []
    place = list(accumulate((inside or not whole for _, inside in blocks), initial=0))
    return lines, [(h, place[a], place[b]) for h, a, b in subtrees]


def _rests(html: str) -> dict[int, int]:
    """For every subtree of a page that could be a template a hash of the main text beside it; for 0 that of all."""
    lines, subtrees = read_page(html)
    sums = list(accumulate((xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")) for line in lines), initial=0))
    low = (1 << 63) - 1
    return {h: (sums[-1] - sums[b] + sums[a]) & low for h, a, b in subtrees} | {0: sums[-1] & low}


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, marks, rests = [], [], []
        for url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            hosts.append(host_of(url))
            found = sorted(_rests(html or "").items())
            marks.append([h for h, _ in found])
            rests.append([rest for _, rest in found])
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), *(pa.array(x, pa.list_(pa.int64())) for x in (marks, rests))], names=["host", "marks", "rests"])


def site_templates(pages: DataFrame, url_col: str = "url", html_col: str = "html", least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """(host, mark) of the subtrees that recur on at least ``least_pages`` pages and ``least_share`` of the pages of their host; pages with the same text beside the subtree are one."""
    seen = pages.select(url_col, html_col).mapInArrow(_candidates, "host string, marks array<bigint>, rests array<bigint>").select("host", F.explode(F.arrays_zip("marks", "rests")).alias("x"))
    counted = stage(seen.select("host", F.col("x.marks").alias("mark"), F.col("x.rests").alias("rest")).distinct().groupBy("host", "mark").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_pages))
    total = counted.where(F.col("mark") == 0).select("host", F.col("n").alias("pages"))
    return counted.where(F.col("mark") != 0).join(total, "host").where(F.col("n") >= least_share * F.col("pages")).select("host", "mark")


def extract_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE, most_sent: int = MOST_SENT,
) -> DataFrame:
    """Per page: id, url, text, n_chars (code points).

    The text is the content of the article or main elements if there are any, else
    of the whole body, without boilerplate and site templates: blocks in page
    order, one per line, character references decoded, white space inside a block
    made one blank. A null or empty page, or one of boilerplate only, has an empty
    text; a null url has the empty host. Rows that repeat are each returned; other
    columns are ignored. Templates come from all pages. Their list is sent to the
    tasks if it has at most ``most_sent`` entries; a longer one is joined to the
    pages that hold its subtrees.
    """
    spark = pages.sparkSession
    templates = site_templates(pages, url_col, html_col, least_pages, least_share)
    head = templates.limit(most_sent + 1).toArrow().to_pydict()
    id_kind, url_kind = (pages.schema[c].dataType.simpleString() for c in (id_col, url_col))
    schema = f"`{id_col}` {id_kind}, `{url_col}` {url_kind}, text string, n_chars bigint"

    def texts(batch: pa.RecordBatch, of: list[set[int]]) -> pa.RecordBatch:
        out = ["\n".join(read_page(html or "", marks)[0]) for html, marks in zip(batch.column(2).to_pylist(), of, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=[*batch.schema.names[:2], "text", "n_chars"])

    if len(head["host"]) <= most_sent:
        by_host: dict[str, set[int]] = {}
        for host, mark in zip(head["host"], head["mark"], strict=True):
            by_host.setdefault(host, set()).add(mark)
        sent = spark.sparkContext.broadcast(by_host)

        def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield texts(batch, [sent.value.get(host_of(u), frozenset()) for u in batch.column(1).to_pylist()])

        return pages.select(id_col, url_col, html_col).mapInArrow(extract, schema)

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = next(_candidates(iter([batch.select([1, 2])])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *found.columns[:2]], names=[*batch.schema.names[:2], "host", "marks"])

    def extract_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield texts(batch, [set(x or ()) for x in batch.column(3).to_pylist()])

    held = pages.select(id_col, url_col, html_col).mapInArrow(marks, f"`{id_col}` {id_kind}, `{url_col}` {url_kind}, host string, marks array<bigint>")
    per_page = held.select(id_col, url_col, "host", F.explode("marks").alias("mark")).join(templates, ["host", "mark"]).groupBy(id_col, url_col).agg(F.collect_set("mark").alias("__marks"))
    same = pages[id_col].eqNullSafe(per_page[id_col]) & pages[url_col].eqNullSafe(per_page[url_col])
    return pages.join(per_page, same, "left").select(pages[id_col], pages[url_col], pages[html_col], "__marks").mapInArrow(extract_joined, schema)
