"""Operator 6, HTML extraction by site template removal.

A page is read into blocks of text. Elements whose tag, role, class or id says
menu, header, footer, sidebar, notice, advert, form or comment are left out;
where the page has an article (or main) element, only blocks inside it stay.
What is left of templates shows by repetition: every element subtree is hashed,
those that the rules leave out too, Spark counts on how many different pages
each hash occurs, and subtrees are deleted that recur on a large share of the
pages of their host, of its pages with or without an article, of a section (the
first directory of the path) or of a template (the containers outside the
article, with their classes and ids).

Pages of a host with equal text count once, so copies of an article do not make
it look like a template.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nodeloom.llm.frames import col, small, with_kernel
from nodeloom.llm.store import Scratch

#: A subtree goes when this share of the pages (distinct texts) of one of its page's groups, and at least so many, have it.
SHARE, PAGES = 0.3, 10
#: Inside an article more is asked for, as articles quote each other.
ARTICLE_SHARE, ARTICLE_PAGES = 0.7, 20

#: Comments, declarations, and tags with well-formed or else any attributes.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.DOTALL)
#: Elements whose content is no markup; without an end tag the first two take the rest of the page, the others nothing.
RAW = {n: re.compile(rf"</{n}\b[^>]*>", re.IGNORECASE) for n in ("script", "style", "textarea", "title", "iframe")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
DROPPED = frozenset("nav footer aside form head menu dialog button label search noscript template svg select object canvas".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
#: Words of class and id names that mark what is no main text; words that such names may hold beside them.
MARKS = frozenset("ad ads adbox advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus disclaimer footer gdpr login menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promotion related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe teaser toolbar widget".split())
BESIDE = frozenset("area articles bar block bottom box button buttons col column container content footer global group header heading icon icons inline inner item items left link links list main module my outer page panel posts primary right row secondary section site stories text the title top wrap wrapper".split())
COMMENTS = frozenset("comment comments reply replies disqus respond".split())
ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
WORD = re.compile(r"[a-z0-9]+")
#: Elements that tell a template by themselves, others by a class or id only; so many levels of either count.
CONTAINERS = frozenset("article aside body div footer form header main nav section".split())
LEVELS = 4
NAMES = re.compile(r"[a-z]+")


def _out(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether an element is no main text."""
    if tag in DROPPED or tag == "header" and not in_article:
        return True
    if not attributes or "=" not in attributes and "hidden" not in attributes.lower():
        return False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return tag not in ("html", "body")
        if name == "role" and value.strip() in ROLES:
            return tag not in ("html", "body", "main", "article")
        if name in ("class", "id"):
            if tag in ("html", "body", "main"):
                continue
            if _marked(value, COMMENTS if tag == "article" else MARKS if in_article or tag == "article" else MARKS | {"header"}):
                return True
    return False


def _marked(names: str, marks: frozenset) -> bool:
    """Whether one of these names is a mark, all its words being marks or such as stand beside them: not share-price."""
    for name in names.split():
        words = {w for w in WORD.findall(name) if not w.isdigit()}
        if words & marks and words <= marks | BESIDE:
            return True
    return False


def _name(tag: str, attributes: str) -> str | None:
    """A container's tag with the words of its class and id, without numbers."""
    words = {w for m in ATTRIBUTE.finditer(attributes) if m[1].lower() in ("class", "id") for w in NAMES.findall((m[2] or m[3] or m[4] or "").lower())}
    return ".".join([tag, *sorted(words)]) if words or tag in CONTAINERS else None


def _hash(parts: list[str]) -> int:
    return xxhash.xxh64_intdigest("\x00".join(parts)) - (1 << 63)


def parse(page: str) -> tuple[list[str], list[tuple[int, int, int]], bool, list[int], int]:
    """The blocks left, their elements as (hash, first block, end), whether they are of an article, hashes of the other elements, and the template's."""
    blocks: list[tuple[str, bool]] = []
    trees: list[tuple[str, int, int, bool]] = []
    stack: list[tuple[str, int, bool, bool, str | None]] = []  # tag, first block, left out, inside article, place in the template
    text: list[str] = []
    lost: list[str] = []  # blocks of elements left out
    lost_text: list[str] = []
    left: list[int] = []
    shape: set[str] = set()
    out = inside = False

    def flush() -> None:
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            if joined:
                blocks.append((joined, inside))
            text.clear()

    def flush_lost() -> None:
        if lost_text:
            joined = " ".join(html.unescape("".join(lost_text)).split())
            if joined:
                lost.append(joined)
            lost_text.clear()

    def close(n: int) -> None:
        nonlocal out, inside
        flush()
        flush_lost()
        while len(stack) > n:
            tag, first, gone, within, _ = stack.pop()
            if gone:
                if len(lost) > first:
                    left.append(_hash([tag, *lost[first:]]))
            elif len(blocks) > first and tag not in ("html", "body", "main", "article"):
                trees.append((tag, first, len(blocks), within))
        out, inside = (stack[-1][2], stack[-1][3]) if stack else (False, False)

    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if not m:
            (lost_text if out else text).append(page[at:])
            break
        if m.start() > at:
            (lost_text if out else text).append(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            if tag in BLOCKS:
                flush_lost() if out else flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if tag in BLOCKS:
                        close(i)
                    else:
                        flush_lost()
                        if len(lost) > stack[i][1]:
                            left.append(_hash([tag, *lost[stack[i][1] :]]))
                        _close_inline(stack, i)
                    out, inside = (stack[-1][2], stack[-1][3]) if stack else (False, False)
                    break
            continue
        attributes = m[3] or m[6] or ""
        if tag in RAW:
            end = None if attributes.endswith("/") and tag not in ("script", "style") else RAW[tag].search(page, at)
            at = end.end() if end else n if tag in ("script", "style") else at
            continue
        if attributes.endswith("/") and tag in DROPPED:
            continue
        if tag in VOID:
            if tag == "br":
                (lost_text if out else text).append(" ")
            elif tag in BLOCKS:
                flush_lost() if out else flush()
            continue
        if tag in BLOCKS:
            flush_lost() if out else flush()
            # a choice or drawing without an end, and a paragraph, end where a block begins; list items and cells where the next one does
            for i in range(len(stack) - 1, -1, -1):
                name = stack[i][0]
                if name == "p" or name in ("select", "svg") and tag not in ("option", "hr") or name == tag and tag in ("li", "td", "th", "tr", "dd", "dt", "option"):
                    close(i)
                    break
                if name in BLOCKS and name != "option":
                    break
        elif not attributes and tag not in DROPPED:
            continue
        within = inside or tag in ("article", "main")
        gone = out or _out(tag, attributes, inside)
        if tag in BLOCKS or gone:
            above = stack[-1][4] if stack else ""
            place = None
            if above is not None and not inside:
                name = _name(tag, attributes)
                place = above if name is None else f"{above}/{name}" if above.count("/") < LEVELS else None
                if name is not None and place is not None:
                    shape.add(place)
            stack.append((tag, len(lost) if gone else len(blocks), gone, within, place))
            out, inside = gone, within
    close(0)
    article = any(x for _, x in blocks)
    kept = [i for i, (_, x) in enumerate(blocks) if x or not article]
    place = {b: i for i, b in enumerate(kept)}
    found = []
    for tag, first, end, within in trees:
        if within == article and first in place:
            i, j = place[first], place[end - 1] + 1
            found.append((_hash([tag, *[b for b, _ in blocks[first:end]]]), i, j))
        else:
            left.append(_hash([tag, *[b for b, _ in blocks[first:end]]]))
    return [blocks[i][0] for i in kept], found, article, left, _hash(sorted(shape))


def _close_inline(stack: list, i: int) -> None:
    """An inline element that was left out ends; blocks opened inside it stay open only if they were not."""
    del stack[i:]


def without(blocks: list[str], spans: list[tuple[int, int]]) -> str:
    gone = {i for a, b in spans for i in range(a, b)}
    return "\n\n".join(b for i, b in enumerate(blocks) if i not in gone)


PAGE = "key long, host string, section string, content long, article boolean, template long, trees array<struct<tree: long, first: int, last: int>>, others array<long>"


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tree = pa.struct([("tree", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])
    kinds = {"content": pa.int64(), "article": pa.bool_(), "template": pa.int64(), "trees": pa.list_(tree), "others": pa.list_(pa.int64())}
    for batch in batches:
        rows: list[tuple] = []
        for page in batch.column("html"):
            blocks, found, article, left, template = parse(page.as_py() or "")
            content = xxhash.xxh64_intdigest("\n\n".join(blocks)) - (1 << 63)
            rows.append((content, article, template, [dict(zip(("tree", "first", "last"), t, strict=True)) for t in found], list(set(left))))
        made = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())]
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("host"), batch.column("section"), *made], names=["key", "host", "section", *kinds])


def _groups() -> Column:
    """The groups that a page is of: its host, its pages with or without an article, of its section and of its template."""
    article = F.col("article").cast("string")
    parts = [F.lit(""), article, F.concat_ws("/", article, "section"), F.concat_ws("/", article, F.col("template").cast("string"))]
    return F.explode(F.array(*[F.struct(F.lit(i).alias("kind"), p.alias("part")) for i, p in enumerate(parts)])).alias("of")


def recurring_trees(scratch: Scratch, pages: DataFrame) -> DataFrame:
    """(host, kind, part, tree, inside): subtrees that recur in a group of pages; inside: often enough to go from articles.

    One page of each text of a host counts. Trees are counted by the finest
    groups first; only those of PAGES pages of a host are counted by each group.
    """
    cell = ["host", "article", "section", "template"]
    every = F.array_distinct(F.concat(F.transform("trees", lambda t: t["tree"]), "others")).alias("every")
    one = pages.select(*cell, "content", "key", every).groupBy("host", "content").agg(F.min_by(F.struct(*cell[1:], "every"), "key").alias("page")).select("host", "page.*")
    one = scratch.keep(one, "texts")
    group = ["host", "of.kind", "of.part"]
    sizes = one.groupBy(*cell).agg(F.count("*").alias("n")).select("host", _groups(), "n").groupBy(*group).agg(F.sum("n").alias("pages"))
    counted = scratch.keep(one.select(*cell, F.explode("every").alias("tree")).groupBy(*cell, "tree").agg(F.count("*").alias("n")), "counted")
    often = counted.groupBy("host", "tree").agg(F.sum("n").alias("n")).where(F.col("n") >= min(PAGES, ARTICLE_PAGES)).select("host", "tree")
    n = counted.join(often, ["host", "tree"], "left_semi").select("host", "tree", _groups(), "n").groupBy(*group, "tree").agg(F.sum("n").alias("n"))
    inside = (F.col("n") >= ARTICLE_PAGES) & (F.col("n") >= F.col("pages") * ARTICLE_SHARE)
    outside = (F.col("n") >= PAGES) & (F.col("n") >= F.col("pages") * SHARE)
    return n.join(sizes, ["host", "kind", "part"]).where(inside | outside).select("host", "kind", "part", "tree", inside.alias("inside"))


def _extract(rows: pa.Array) -> list[pa.Array]:
    rows = rows if isinstance(rows, pa.StructArray) else rows.combine_chunks()
    texts = []
    for page, gone in zip(rows.field("html"), rows.field("gone").to_pylist(), strict=True):
        texts.append(without(parse(page.as_py() or "")[0], [(g["first"], g["last"]) for g in gone or []]))
    return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]


def extract(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages (page_id, url, html).

    Null and empty html, and pages without main text, give an empty text. Pages
    of any length are read whole; elements without an end tag end where their
    parent does, a script or style without one takes the rest of the page. A
    null url is a host of its own; repeated rows are extracted alike and count
    as one page of their host. Subtrees at just the asked share go. Extra
    columns are ignored; empty pages give an empty result.
    """
    scratch = Scratch(spark, "pages")
    host = F.coalesce(F.lower(F.regexp_extract(col("url"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)), F.lit(""))
    section = F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/([^/?#]+)/", 1), F.lit(""))
    keyed = pages.select(col("page_id").alias("page_id"), col("url").alias("url"), col("html").alias("html"), host.alias("host")).withColumn("key", F.xxhash64("page_id", "url", "html"))
    read = scratch.keep(keyed.select("key", "host", section.alias("section"), "html").mapInArrow(_pages, PAGE), "pages")
    recurring = scratch.keep(recurring_trees(scratch, read), "recurring")
    trees = read.select("key", "host", "article", "section", "template", F.explode("trees").alias("t")).select("*", "t.*").drop("t")
    trees = trees.join(recurring.select("host", "tree").distinct(), ["host", "tree"], "left_semi")
    hits = trees.select("key", "host", "article", "tree", "first", "last", _groups()).select("*", "of.*").join(recurring, ["host", "kind", "part", "tree"]).where("inside or not article")
    gone = scratch.keep(hits.groupBy("key").agg(F.collect_set(F.struct("first", "last")).alias("gone")), "gone")
    joined = keyed.join(small(gone, "gone"), "key", "left").select("page_id", "url", F.struct("html", "gone").alias("row"))
    fields = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return with_kernel(joined, _extract, fields, "made", "row", ["page_id", "url"]).select("page_id", "url", "made.*")
