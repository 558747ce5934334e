"""Main text of web pages: element subtrees that recur across a host's pages are its template and go."""

from __future__ import annotations

import html
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loadspan.llm.common import stage
from loadspan.llm.url_automaton import canonical
from loadspan.plans.skew import salted_join

#: A subtree is template if it is on so many pages of the host, and on this share of them.
LEAST_PAGES = 5
LEAST_SHARE = 0.1
#: Share for a subtree inside an article or main element, which must also stand beside ``LEAST_PAGES`` different main texts.
INSIDE_SHARE = 0.5

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s=/]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
TOKENS = re.compile(r"[^a-z0-9]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr math mi mn mo ms mtext mrow mfrac msup msub msubsup msqrt mroot mover munder".split()
)
#: Start tags that end an open paragraph.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hgroup hr main menu nav ol p pre section summary table ul li dd dt".split()
)
#: Start tags that end an open element of the same group, and what an end is not looked for beyond.
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
        "option": {"option"}}
FENCE = frozenset("ul ol dl table select article section div main body html aside nav footer header form".split())
CONTENT = frozenset(("article", "main"))
DROPPED = frozenset(
    "head nav footer aside form script style title noscript iframe textarea template svg button select option dialog menu "
    "object canvas audio video".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu "
    "sidebar footer masthead cookie cookies consent notice popup modal newsletter subscribe subscription "
    "comment comments respond disqus breadcrumb breadcrumbs pagination pager login signup toolbar".split()
)
#: Elements that hold a piece of an article's text; inside one, they are no template by themselves.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 hgroup li dt dd tr td th pre blockquote figcaption summary".split())


def is_boilerplate(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element is no main text by its tag, role or the words of its class and id."""
    if tag in DROPPED or tag == "header" and not inside:
        return True
    if not attributes.strip() or tag in ("html", "body", "article", "main"):
        return False
    found = {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attributes)}
    if found.get("role", "").lower() in ROLES or "hidden" in found or found.get("aria-hidden") == "true":
        return True
    words = TOKENS.split(f"{found.get('class', '')} {found.get('id', '')}".lower())
    return not NAMES.isdisjoint(words)


def blocks(page: str) -> list[tuple[str, bool, bool, list[int], list[int]]]:
    """Text blocks in page order: text, inside article or main, boilerplate by its elements, hashes of its subtrees outside and inside.

    A block is the text between two boundaries of block elements, references decoded, white space as one space, trimmed; empty
    ones are left out. The hashes are those of every block element around it that is neither article nor main nor has one in it;
    inside of these, of elements that are more than a piece of text. Equal hashes mean equal tags, classes and texts below.
    """
    out: list[list] = []
    # frames: tag, boilerplate, inside content, parts of the hash or None, first block
    stack: list[list] = [["", False, False, [], 0]]
    text: list[str] = []

    def flush() -> None:
        line = " ".join(html.unescape("".join(text)).split())
        text.clear()
        if line:
            top = stack[-1]
            out.append([line, top[2], top[1], [], []])
            if top[3] is not None:
                top[3].append(line)

    def pop() -> None:
        tag, _, inside, parts, first = stack.pop()
        above = stack[-1]
        if parts is None:
            above[3] = None
            return
        key = signed(xxhash.xxh64_intdigest("\x1f".join(parts).encode("utf-8", "surrogatepass"), inside))
        if tag not in ("html", "body") and not (inside and tag in PROSE):
            for block in out[first:]:
                block[4 if inside else 3].append(key)
        if above[3] is not None:
            above[3].append(str(key))

    at, n = 0, len(page)
    while at < n:
        match = TOKEN.search(page, at)
        if not match:
            text.append(page[at:])
            break
        text.append(page[at:match.start()])
        at = match.end()
        tag = (match[2] or match[5] or "").lower()
        if not tag:
            if match[0].startswith("<![CDATA["):
                text.append(html.escape(match[0][9:].removesuffix("]]>")))
            continue
        if match[1] or match[4]:
            if tag in INLINE:
                continue
            place = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
            if place:
                flush()
                while len(stack) > place:
                    pop()
            elif tag == "p":
                flush()
            continue
        if tag in INLINE:
            if tag == "br":
                text.append(" ")
            continue
        flush()
        attributes = match[3] or match[6] or ""
        ended = SAME.get(tag) or ({"p"} if tag in ENDS_P else None)
        for group in ((ended, {"p"}) if tag in SAME and tag in ENDS_P else (ended,)):
            for i in range(len(stack) - 1, 0, -1) if group else ():
                if stack[i][0] in group:
                    while len(stack) > i:
                        pop()
                    break
                if stack[i][0] in FENCE:
                    break
        if tag in VOID:
            continue
        top = stack[-1]
        root = tag in CONTENT and not top[1]
        inside = top[2] or root
        boilerplate = top[1] or is_boilerplate(tag, attributes, inside)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else n
            continue
        names = next((m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes) if m[1].lower() == "class"), "")
        stack.append([tag, boilerplate, inside, None if root else [tag, names], len(out)])
    flush()
    while len(stack) > 1:
        pop()
    return [tuple(b) for b in out]


def page_host(url: str | None) -> str:
    return canonical(url)[0]


def signed(key: int) -> int:
    return key - (1 << 64) if key >> 63 else key


def subtrees(pages: DataFrame) -> DataFrame:
    """(host, hashes, inside, body): the distinct subtree hashes of each page, outside and inside its article, and a hash of the article's text."""

    def run(batches):
        for batch in batches:
            hosts = [page_host(u) for u in batch.column(0).to_pylist()]
            parsed = [blocks(p or "") for p in batch.column(1).to_pylist()]
            outer, inner = ([sorted({k for b in found for k in b[at]}) for found in parsed] for at in (3, 4))
            body = [signed(xxhash.xxh64_intdigest("\n".join(b[0] for b in found if b[1]).encode("utf-8", "surrogatepass"))) for found in parsed]
            keys = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), pa.array(outer, keys), pa.array(inner, keys), pa.array(body, pa.int64())],
                names=["host", "hashes", "inside", "body"],
            )

    return pages.select("url", "html").mapInArrow(run, "host string, hashes array<bigint>, inside array<bigint>, body bigint")


def templates(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE, inside_share: float = INSIDE_SHARE) -> DataFrame:
    """(host, hashes): the subtrees that are template of a host.

    One outside articles is on at least ``least_pages`` pages of the host and ``least_share`` of its pages. One inside is on ``inside_share`` of them, beside
    at least ``least_pages`` different texts of articles (told apart in 64 classes), so an article that is copied to many pages keeps all its parts.
    Counts are summed before they move, and only hashes above the share are gathered: at most 1 / ``least_share`` times the subtrees of a
    page. The empty host, of pages without a URL, has no template.
    """
    found = subtrees(pages).where("host != ''")
    # the number of pages of a host is counted as a subtree that every page has
    entry = lambda name, inside: F.transform(name, lambda h: F.struct(h.alias("hash"), F.lit(inside).alias("inner")))
    page = F.array(F.struct(F.lit(None).cast("bigint").alias("hash"), F.lit(False).alias("inner")))
    each = found.select("host", "body", F.explode(F.concat(page, entry("hashes", False), entry("inside", True))).alias("e"))
    counts = stage(each.groupBy("host", "e.hash", "e.inner").agg(
        F.count(F.lit(1)).alias("n"), F.bit_count(F.bit_or(F.expr("shiftleft(1L, cast(body & 63 as int))"))).alias("bodies"),
    ).where(F.col("hash").isNull() | (F.col("n") >= least_pages)), "subtree-counts")
    sizes = counts.where("hash IS NULL").select("host", F.col("n").alias("pages"))
    frequent = salted_join(counts.where("hash IS NOT NULL"), sizes, ["host"], ["hash"])
    beside = (F.col("n") >= F.col("pages") * inside_share) & (F.col("bodies") >= least_pages)
    kept = frequent.where(F.when(F.col("inner"), beside).otherwise(F.col("n") >= F.col("pages") * least_share))
    return kept.groupBy("host").agg(F.collect_set("hash").alias("hashes"))


def extract(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """(page_id, url, text, n_chars) of every page, a row for each row.

    Text blocks go if one of their subtrees is template of the host, or if an element around them is boilerplate by tag, role or
    class. If a page has an article or main element outside boilerplate, only blocks inside count; these themselves are never template, nor
    is a single paragraph in them, as articles may quote or copy each other. Null or empty html gives an empty text and 0. Pages of a null URL lose no
    template. Pages are parsed twice, which costs less than moving them; the templates are written first, so that the planner knows
    their size. Other columns are not read; rows with the same or a null id are kept.
    """
    id_field, url_field = pages.schema["page_id"], pages.schema["url"]
    out = StructType([id_field, url_field, *StructType.fromDDL(
        "host string, blocks array<struct<text:string,inside:boolean,hashes:array<bigint>>>",
    ).fields])
    kind = pa.list_(pa.struct([
        ("text", pa.string()), ("inside", pa.bool_()), ("hashes", pa.list_(pa.int64())),
    ]))

    def run(batches):
        for batch in batches:
            hosts = [page_host(u) for u in batch.column(1).to_pylist()]
            found = [
                [{"text": b[0], "inside": b[1], "hashes": b[3] + b[4]} for b in blocks(p or "") if not b[2]]
                for p in batch.column(2).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(hosts, pa.string()), pa.array(found, kind)], names=out.names,
            )

    parsed = pages.select("page_id", "url", "html").mapInArrow(run, out)
    known = stage(templates(pages, least_pages, least_share).withColumnRenamed("hashes", "template"), "templates")
    joined = salted_join(parsed, known, ["host"], ["page_id", "url"], "left")
    rid = F.filter("blocks", lambda b: F.col("template").isNull() | ~F.arrays_overlap(b["hashes"], F.col("template")))
    main = F.filter("_left", lambda b: b["inside"] | ~F.exists("_left", lambda c: c["inside"]))
    text = F.array_join(F.transform("_main", lambda b: b["text"]), "\n")
    return joined.withColumn("_left", rid).withColumn("_main", main).select("page_id", "url", text.alias("text")).withColumn(
        "n_chars", F.char_length("text").cast("bigint"),
    )
