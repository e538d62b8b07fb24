"""Main text of web pages: nearest-URL page differencing, then a check by markup.

A page is read as tags and text by a forgiving lexer. Menus, headers, footers, sidebars, notices, adverts,
forms, scripts, styles and reader comments are left out by their element, role, class or id. What remains
is cut into blocks, the lines of the page. Every page is compared with a page of its host: pages stand in the order of host and path, and of the
REACH pages on each side the one whose path agrees longest comes first, the nearer one at ties. Lines are aligned
by their longest common subsequence, and those that both pages share are the site's template. A page that
shares more than COPY of the lines is a copy of this one (another address of the same article) and, like one that
shares none, tells nothing of the template: the next page is taken instead.

The check that follows: if the article and main elements hold at least as many characters of the page's own lines (those
that are not the template) as stand outside them, their lines are the text, shared ones too, as articles may share some
and menus that are made for each page share no line. Of an article that is printed on another page as well only the
rest is the page's own, so all lines are asked next: an article that holds at least half of them is the text too. A
teaser beside the text is neither, and then the text is the page's own lines. Inside an article or main element only
whole class or id names that mean something else (an advert, the comments) leave a block out; words within longer names
never do.

Null or empty html: empty text. Null url: no neighbour, no line is deleted. Rows that repeat come out once each. Long
pages are read whole. Empty table: no rows. Extra columns are not returned. Each page is read twice: once for the hashes
of its lines, which are ordered and compared, and once for the lines, which then meet what is kept of them in one
shuffle.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import picked, prepare, schema_with, settled, with_rank

# Element names.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr title ul video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg iframe object".split())
LEFT_OUT = RAW | frozenset("nav footer aside form menu button select dialog head".split())
MAIN = frozenset(("article", "main"))
ENDED_BY_MAIN = frozenset(("nav", "aside", "menu"))
#: Pages on each side that are looked at; share of common lines beyond which two pages are copies.
REACH, COPY = 3, 0.8
#: Pages in a row that are compared in one group of a window.
BLOCK = 1024
LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog".split())
#: Class and id names of what is not the article, inside an article and elsewhere.
ASIDE_IN_MAIN = frozenset("ad ads advert adverts advertisement advertisements advertising sponsored sponsor promo comments comment-list commentlist comment-form respond replies share sharing share-buttons social social-share newsletter newsletter-signup related-posts related-articles recommended pagination pager breadcrumb breadcrumbs cookie cookies cookie-banner cookie-notice consent gdpr popup modal sidebar".split())
ASIDE = ASIDE_IN_MAIN | frozenset("side menu nav navbar navigation header site-header page-header masthead banner footer site-footer page-footer comment disqus notice notices notification subscribe signup login related toolbar widget widgets main-menu top-menu".split())

# A quoted value may hold "<" only if its closing quote ends an attribute; an unquoted one ends at white space or ">".
_VALUE = r"=\s*(?:\"[^\"<]*\"|'[^'<]*'|\"[^\"]*\"(?=[\s/>])|'[^']*'(?=[\s/>]))"
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|{_VALUE}|=)*)(?:>|\Z)", re.S)
NAMED = re.compile(r"(?<![^\s/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*)|(?=[\s/]|$))", re.I)
SPACE = re.compile(r"\s+")
RAW_END = {name: re.compile(rf"</{name}[^>]*(?:>|\Z)", re.I) for name in RAW}


def _left_out(name: str, attributes: str, in_main: bool) -> bool:
    if name in LEFT_OUT or name == "header" and not in_main:
        return True
    if name in MAIN or name in ("body", "html") or not attributes:
        return False
    for key, value in NAMED.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True
        if key == "role" and value.lower() in LEFT_OUT_ROLES:
            return True
        if key in ("class", "id") and not (ASIDE_IN_MAIN if in_main else ASIDE).isdisjoint(value.lower().split()):
            return True
    return False


def _unclosed(name: str, page: str, at: int) -> bool:
    """Whether more elements of this name are open at a place than are closed after it."""
    ends = len(re.findall(rf"</{name}[\s>]", page[at:], re.I))
    return ends <= len(re.findall(rf"<{name}[\s>]", page[at:], re.I))


def page_blocks(page: str | None) -> list[tuple[bool, str]]:
    """The blocks of a page that may be its text, each with whether it stands in an article or main element."""
    page = page or ""
    stack: list[tuple[str, bool, bool]] = []  # name, left out, main; the flags hold for what is inside too
    lines: list[tuple[bool, str]] = []
    parts: list[str] = []
    out, main = False, False

    def close_block():
        if parts:
            line = SPACE.sub(" ", html.unescape("".join(parts))).strip()
            parts.clear()
            if line:
                lines.append((main, line))

    at = 0
    while at < len(page):
        m = TOKEN.search(page, at)
        if not out:
            parts.append(page[at : m.start() if m else len(page)])
        if m is None:
            break
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if name == "br" or name not in BLOCKS and name not in LEFT_OUT:
            flow = True
            if name == "br":
                parts.append(" ") if not out else None
        else:
            flow = False
            close_block()
        if m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    out, main = stack[-1][1:] if stack else (False, False)
                    break
        elif name not in VOID:
            if name in RAW:
                end = RAW_END[name].search(page, at)
                at = end.end() if end else len(page)
                continue
            if name in MAIN and out:
                # an article ends what is left open around it
                for i, (around, _, _) in enumerate(stack):
                    if around in ENDED_BY_MAIN and _unclosed(around, page, at):
                        del stack[i:]
                        out, main = stack[-1][1:] if stack else (False, False)
                        break
            leave = _left_out(name, m[3] or "", main)
            if leave and not out and flow:
                close_block()
            if m[3] and m[3].rstrip().endswith("/") and name not in MAIN and not leave:
                continue
            out, main = out or leave, main or name in MAIN or 'role="main"' in (m[3] or "")
            stack.append((name, out, main))
    close_block()
    return lines


def in_article(main: list[bool], sizes: list[int], shared: set[int] = frozenset()) -> bool:
    """Whether article and main elements hold at least as many characters as stand outside them: of the lines that are not
    shared with another page, or else of all."""
    for left_out in ((shared, ()) if shared else ((),)):
        inside, outside = (sum(n for i, n in enumerate(sizes) if main[i] is own and i not in left_out) for own in (True, False))
        if inside and inside >= outside:
            return True
    return False


def page_lines(page: str | None) -> tuple[list[str], bool]:
    """The lines of a page that is compared with no other, and whether they stand in an article or main element."""
    blocks = page_blocks(page)
    sure = in_article([x for x, _ in blocks], [len(line) for _, line in blocks])
    return [line for x, line in blocks if x or not sure], sure


def common_lines(a: list, b: list) -> list[int]:
    """Indices of a in a longest common subsequence of a and b."""
    # only what both have can be common; what they begin and end with is
    both = set(a) & set(b)
    at, b = [i for i, x in enumerate(a) if x in both], [x for x in b if x in both]
    n, head, tail = min(len(at), len(b)), 0, 0
    while head < n and a[at[head]] == b[head]:
        head += 1
    while tail < n - head and a[at[-1 - tail]] == b[-1 - tail]:
        tail += 1
    inner = _aligned([a[i] for i in at[head : len(at) - tail]], b[head : len(b) - tail])
    return at[:head] + [at[head + i] for i in inner] + at[len(at) - tail :]


def _aligned(a: list, b: list) -> list[int]:
    """Indices of a in a longest common subsequence of a and b (bit-parallel rows, walked back)."""
    where: dict = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v, rows = full, [full]
    for x in a:
        u = v & where.get(x, 0)
        v = (v + u | v - u) & full
        rows.append(v)
    out, i, j = [], len(a), len(b)
    while i and j:
        if rows[i] >> (j - 1) & 1:
            j -= 1
        elif not rows[i - 1] >> (j - 1) & 1:
            i -= 1
        else:
            i, j = i - 1, j - 1
            out.append(i)
    return out[::-1]


def _agree(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def kept_lines(path: str, own: list, main: list[bool], sizes: list[int], near: list[dict]) -> list[int]:
    """Indices of the lines of a page that are its text. near: step, path and hashes of the pages beside it."""
    shared: set[int] = set()
    for x in sorted(near, key=lambda x: (-_agree(path, x["path"]), abs(x["step"]), x["step"])):
        both = common_lines(own, x["hashes"])
        if 0 < len(both) <= COPY * len(own):
            shared = set(both)
            break
    if in_article(main, sizes, shared):
        return [i for i, x in enumerate(main) if x]
    return [i for i in range(len(own)) if i not in shared]


def main_text(pages: DataFrame, page: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    prepare(pages.sparkSession)
    rows = picked(pages, page_id=page, url=url, html=body)
    nulls = F.concat(*[F.isnull(c).cast("string") for c in rows.columns])
    # 128 bits of a row's content tell which lines and what is kept of them belong together; equal rows are alike
    rows = rows.withColumns({"_k1": F.xxhash64("page_id", "url", "html", nulls), "_k2": F.xxhash64(nulls, "html", "url", "page_id")})
    address = F.regexp_replace("url", r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    placed = rows.select("page_id", "_k1", "_k2", F.lower(F.coalesce(F.regexp_extract(address, r"^[^/?#:]*", 0), F.lit(""))).alias("host"), F.coalesce(F.regexp_extract(address, r"^[^/?#]*(.*)$", 1), F.lit("")).alias("path"), "html")
    names = ["page_id", "_k1", "_k2", "host", "path"]
    schema = schema_with(placed, names, "hashes array<long>, main array<boolean>, sizes array<int>")

    def read_pages(batches):
        for batch in batches:
            blocks = [page_blocks(h.as_py()) for h in batch.column("html")]
            hashes = [[xxhash.xxh64_intdigest(line.encode()) - (1 << 63) for _, line in b] for b in blocks]
            main, sizes = [[x for x, _ in b] for b in blocks], [[len(line) for _, line in b] for b in blocks]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(hashes, pa.list_(pa.int64())), pa.array(main, pa.list_(pa.bool_())), pa.array(sizes, pa.list_(pa.int32()))], names=schema.names)

    ranked = with_rank(settled(placed.mapInArrow(read_pages, schema)), ["host", "path", "page_id", "_k1"])
    # pages in order are cut into blocks; those at an edge are beside pages of the next block too
    block = lambda k: F.floor((F.col("rank") + k) / BLOCK)
    there = ranked.withColumn("_block", F.explode(F.array_distinct(F.array(*[block(k) for k in (-REACH, 0, REACH)]))))
    order, seen = Window.partitionBy("_block").orderBy("rank"), F.struct("host", "path", "hashes")
    beside = {k: F.lag(seen, -k).over(order) if k < 0 else F.lead(seen, k).over(order) for k in range(-REACH, REACH + 1) if k}
    met = there.select("*", *[x.alias(f"_{k + REACH}") for k, x in beside.items()]).filter(block(0) == F.col("_block"))
    near = F.array(*[F.when((F.col(f"_{k + REACH}.host") == F.col("host")) & (F.col("host") != ""), F.struct(F.lit(k).alias("step"), F.col(f"_{k + REACH}.path").alias("path"), F.col(f"_{k + REACH}.hashes").alias("hashes"))) for k in beside])
    asked = met.select("_k1", "_k2", "rank", "path", "hashes", "main", "sizes", F.array_compact(near).alias("near"))
    verdict = schema_with(asked, ["_k1", "_k2", "rank"], "keep array<int>")

    def differ(batches):
        for batch in batches:
            keep = [kept_lines(*page) for page in zip(*(batch.column(c).to_pylist() for c in ("path", "hashes", "main", "sizes", "near")), strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("_k1", "_k2", "rank")], pa.array(keep, pa.list_(pa.int32()))], names=verdict.names)

    kept = asked.mapInArrow(differ, verdict).groupBy("_k1", "_k2").agg(F.min_by("keep", "rank").alias("keep"))
    whole = schema_with(rows, ["page_id", "url", "_k1", "_k2"], "lines array<string>")

    def read_lines(batches):
        for batch in batches:
            lines = [[line for _, line in page_blocks(h.as_py())] for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("page_id", "url", "_k1", "_k2")], pa.array(lines, pa.list_(pa.string()))], names=whole.names)

    out = rows.mapInArrow(read_lines, whole).join(kept.hint("shuffle_hash"), ["_k1", "_k2"], "left")
    text = F.array_join(F.transform("keep", lambda i: F.get("lines", i)), "\n")
    return out.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))


def op8_main_text(spark, sf_dir: str) -> DataFrame:
    from .common import read

    return main_text(read(spark, sf_dir, "pages"))
