"""Main text of web pages by site template removal.

Pages are parsed into blocks and the hashes of their element subtrees, which are runs of blocks. Spark counts
with how many different remaining contents every subtree occurs on the pages of its host; blocks
below a subtree that recurs so are deleted, inside article and main elements too. Navigation, page headers and footers, forms, adverts,
notices and comments are boilerplate by their element or class wherever they stand.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import ROW, map_arrow
from strandline.session import settled

#: Fixed lists of HTML: elements without text of their own, elements that start a block, elements without end tags.
SILENT = frozenset("script style noscript template iframe svg canvas object head title select button textarea".split())
ASIDE = frozenset("nav header footer aside form dialog menu".split())
BLOCK = frozenset("address article aside blockquote body caption dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Fixed words: parts of a class, id or role that mark boilerplate, and parts that only say what box it is.
MARKS = re.compile(r"ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu|breadcrumbs?|sidebar|footer|masthead|cookies?|consent|notices?|popup|modal|newsletter|subscribe|share|social|related|comments?|disqus|widget|navigation|contentinfo|complementary")
BOXES = frozenset("area articles bar block bottom box buttons container content form global header icons inner item items left links list main message outer overlay panel post posts primary right row secondary section signup site slot stories thread top unit wrap wrapper".split())
#: A quote that is not closed before the end of its tag is an ordinary character.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"(?=[\s/>])|'[^']*+'(?=[\s/>])|[\"'])*+)>", re.S)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*display\s*:\s*none)", re.I)
#: A subtree is a template when it recurs beside so many different remaining contents of a host. Outside the
#: article (or main) of pages that are mostly article, two are enough.
PAGES, OUTSIDE = 5, 2
#: The remaining content is told by its longest blocks, so that copies of a page with small changes are one content.
LONGEST = 3


#: Modulus and base of the running hash over the blocks of a page.
PRIME, BASE = 2**61 - 1, 0x1F3D5B79A2C4E6
Blocks = list[tuple[str, bool]]
Trees = list[tuple[int, int, int]]


def marked(names: str) -> bool:
    """Whether a name is made of marks and words for boxes alone: cookie-notice is, social-science is not."""
    for name in names.lower().split():
        parts = [p for p in re.split(r"[_-]+", name) if p]
        if any(MARKS.fullmatch(p) for p in parts) and all(MARKS.fullmatch(p) or p in BOXES or p.isdigit() for p in parts):
            return True
    return False


def blocks(page: str) -> tuple[Blocks, Trees]:
    """(text, inside an article or h1) of every block that is not boilerplate itself; (hash, first block, block behind the last) of the block subtrees."""
    import xxhash

    out: Blocks = []
    trees: Trees = []
    # Running hash over the blocks: that of any run of blocks follows from two of its values.
    sums, powers = [0], [1]
    stack: list[list] = []  # [tag, drops, in article, first block]
    text: list[str] = []

    def flush():
        words = " ".join(html.unescape("".join(text)).split())
        text.clear()
        if words and not (stack and stack[-1][1]):
            out.append((words, any(s[2] or s[0] == "h1" for s in stack)))
            sums.append((sums[-1] * BASE + xxhash.xxh64_intdigest(words)) % PRIME)
            powers.append(powers[-1] * BASE % PRIME)

    def close():
        tag, drops, _, first = stack.pop()
        if tag in BLOCK and not drops and tag not in ("html", "body") and len(out) > first:
            run = (sums[-1] - sums[first] * powers[len(out) - first]) % PRIME
            trees.append((xxhash.xxh64_intdigest(f"{tag} {len(out) - first} {run}") - 2**63, first, len(out)))

    at, end = 0, len(page)
    tags = page.rfind(">") + 1  # nothing behind it can be a tag, an open comment apart
    while at < end:
        m = TOKEN.search(page, at, tags) or (TOKEN.match(page, page.find("<!--", at)) if page.find("<!--", at) >= 0 else None)
        if m is None:
            text.append(page[at:])
            break
        text.append(page[at : m.start()])
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            if tag in BLOCK:
                flush()
            if any(s[0] == tag for s in stack):
                while True:
                    if stack[-1][0] in BLOCK:
                        flush()
                    last = stack[-1][0]
                    if last in SILENT:
                        text.clear()
                    close()
                    if last == tag:
                        break
        elif m[2]:
            tag = m[2].lower()
            if tag == "br":
                text.append(" ")
            if tag in BLOCK:
                flush()
                if tag in ("p", "li", "dt", "dd", "tr", "td", "th") or tag in BLOCK:
                    # A new block ends an open paragraph; a new item ends the item before it.
                    ends = {"p"} if tag not in ("li", "tr", "td", "th", "dt", "dd") else {"p", tag}
                    i = len(stack) - 1
                    while i >= 0 and (stack[i][0] not in BLOCK):
                        i -= 1
                    if i >= 0 and stack[i][0] in ends:
                        while len(stack) > i:
                            close()
            if tag in VOID or m[3].rstrip().endswith("/") and tag not in BLOCK and tag not in SILENT:
                continue
            if tag in ("script", "style", "noscript", "template", "iframe", "textarea", "title"):
                stop = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                at = stop.end() if stop else end
                continue
            inside = bool(stack) and stack[-1][2]
            drops = bool(stack) and stack[-1][1] or tag in SILENT or tag in ASIDE and not (tag == "header" and inside) or bool(HIDDEN.search(m[3])) or tag not in ("html", "body", "main") and any(marked(a or b or c) for a, b, c in NAMED.findall(m[3]))
            if drops and not (stack and stack[-1][1]):
                flush()
            stack.append([tag, drops, inside or tag in ("article", "main"), len(out)])
    flush()
    while stack:
        close()
    return out, trees


def subtrees(found: Blocks, trees: Trees) -> list[dict]:
    """Every subtree of a page: its hash, its runs of blocks, whether it is outside the article, hashes of the longest blocks that remain without it.

    Where most of the text is in an article, only that remains: a subtree with all of it always leaves
    the same (nothing), so copies of an article amid changing boxes do not make it a template.
    """
    import xxhash

    mostly = 2 * sum(len(t) for t, inside in found if inside) >= sum(len(t) for t, _ in found)
    articles = [0]  # blocks inside an article before each block
    for _, inside in found:
        articles.append(articles[-1] + inside)
    rank = [(-len(t), t, i) for i, (t, inside) in enumerate(found) if inside or not mostly]
    digest = {i: xxhash.xxh64_intdigest(t) - 2**63 for _, t, i in rank}

    def longest(entries):
        return sorted(entries)[:LONGEST]

    by_block = {i: (n, t, i) for n, t, i in rank}
    before: list[list] = [[]]
    for i in range(len(found)):
        before.append(longest([*before[-1], by_block[i]]) if i in by_block else before[-1])
    behind: list[list] = [[]]
    for i in reversed(range(len(found))):
        behind.append(longest([*behind[-1], by_block[i]]) if i in by_block else behind[-1])
    behind.reverse()
    ranked = sorted(rank)
    spans: dict[int, set] = {}
    for h, first, last in trees:
        spans.setdefault(h, set()).add((first, last))
    out = []
    for h, runs in spans.items():
        if len(runs) == 1:
            (first, last), = runs
            rest = longest(before[first] + behind[last])
        else:
            gone = {i for first, last in runs for i in range(first, last)}
            rest = []
            for entry in ranked:
                if entry[2] not in gone:
                    rest.append(entry)
                    if len(rest) == LONGEST:
                        break
        outside = mostly and not any(articles[last] > articles[first] for first, last in runs)
        out.append({"tree": h, "outside": outside, "rest": [digest[i] for _, _, i in rest], "runs": [{"first": x, "last": y} for x, y in sorted(runs)]})
    return out


RUNS = "array<struct<first: int, last: int>>"


def _parse(batches):
    run = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
    tree = pa.list_(pa.struct([("tree", pa.int64()), ("outside", pa.bool_()), ("rest", pa.list_(pa.int64())), ("runs", run)]))
    for batch in batches:
        pages = [blocks(p or "") for p in batch.column("html").to_pylist()]
        texts = [[t for t, _ in found] for found, _ in pages]
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), batch.column("url"), pa.array(texts, pa.list_(pa.string())), pa.array([subtrees(*p) for p in pages], tree)], [ROW, "_id", "_url", "_blocks", "_subtrees"])


def main_text(pages: DataFrame, ident: str = "page_id", url: str = "url", body: str = "html", least: int = PAGES, outside: int = OUTSIDE) -> DataFrame:
    """One row per row of pages: _id, _url, text (blocks joined by newlines; empty if none), n_chars.

    What is left outside templates is kept, whether inside an article or not; an article only says
    where fewer recurrences make a template. The counts are absolute: neither further pages of a
    host nor repeated rows make a template less or more likely. A null url is a host of its own, a
    null html is empty. Empty table: no rows.
    """
    kind = pages.schema[ident].dataType.simpleString()
    parsed = settled(map_arrow(pages.select(F.monotonically_increasing_id().alias("row"), F.col(ident).alias("id"), F.col(url).alias("url"), F.col(body).alias("html")), _parse,
                               f"{ROW} long, _id {kind}, _url string, _blocks array<string>, _subtrees array<struct<tree: bigint, outside: boolean, rest: array<bigint>, runs: {RUNS}>>"), "blocks")
    host = F.lower(F.regexp_extract(F.coalesce("_url", F.lit("")), r"^[a-zA-Z][^:/]*://([^/?#]*)", 1))
    trees = parsed.select(ROW, host.alias("_host"), F.inline("_subtrees")).select(ROW, F.xxhash64("_host", "tree").alias("_key"), "outside", "rest", "runs")
    # Different contents take as many pages: subtrees on fewer are left out before their contents are counted.
    often = settled(trees.groupBy("_key").agg(F.count("*").alias("_n")).where(F.col("_n") >= min(least, outside)).select(F.col("_key").alias("_often")), "often")
    # A subtree with nothing beside it has one remaining content, the empty one.
    some = trees.join(often, F.col("_key") == F.col("_often"), "left_semi")
    rests = some.select("_key", F.posexplode(F.when(F.size("rest") > 0, F.col("rest")).otherwise(F.array(F.lit(0).cast("long")))).alias("_nth", "_rest")).distinct()
    counts = rests.groupBy("_key", "_nth").agg(F.count("*").alias("_n")).groupBy("_key").agg(F.max("_n").alias("_n"))
    recurring = settled(counts.where(F.col("_n") >= min(least, outside)).withColumnRenamed("_key", "_common"), "templates")
    common = trees.drop("rest").join(recurring, F.col("_key") == F.col("_common")).where(F.col("_n") >= F.when(F.col("outside"), outside).otherwise(least))
    templates = settled(common.groupBy(ROW).agg(F.flatten(F.collect_list("runs")).alias("_gone")), "deleted")
    joined = parsed.select(ROW, "_id", "_url", "_blocks").join(templates, ROW, "left")
    gone = F.coalesce("_gone", F.array().cast(RUNS))
    kept = F.filter("_blocks", lambda b, i: ~F.exists(gone, lambda g: (i >= g["first"]) & (i < g["last"])))
    text = F.array_join(kept, "\n")
    return joined.select("_id", "_url", text.alias("text"), F.char_length(text).cast("long").alias("n_chars"))
