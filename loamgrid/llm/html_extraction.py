"""Main text of web pages by nearest-URL page differencing.

Pages are sorted by host and URL path over all tasks, so that the pages nearest to a page by path are its neighbours. Each page is
paired with the neighbour of its host that shares the longer beginning of its path (the one before at a tie), all text lines of
both, menus and adverts among them, are aligned by longest common subsequence, and shared lines are deleted. Markup corrects what
differencing alone gets wrong: lines that it marks as the article (article, main) are kept though a neighbour has them too, and
lines that it marks as something else (menus, adverts, forms, comments and so on) go though they differ from page to page.

Copies of a page that stand together are one page to their neighbours. Where the tasks' ranges meet, the neighbours are looked up
beforehand (two for each range), so the result doesn't depend on the number of ranges.

A null or empty page has an empty text. A page without a path is paired by its host; a null URL counts as empty. Repeated rows are
pages each; ties of host and path are ordered by page_id, null first. Very long pages are parsed whole, and aligned by bit vectors.
No rows give no rows. Only page_id, url and html are read, whatever other columns there are.
"""

from __future__ import annotations

import bisect
import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamgrid.llm.common import load, shuffle_partitions

#: Elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math textarea".split())
DROPPED = frozenset("head title nav footer aside form button select option dialog menu datalist audio video canvas".split()) | RAW
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
ARTICLE = frozenset(("article", "main"))
#: Roles, and words of class or id, of what isn't the article.
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog menu menubar form".split())
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar nav navbar navigation menu breadcrumb breadcrumbs cookie cookies consent gdpr notice notices popup modal overlay"
    " newsletter subscribe subscription comment comments disqus respond replies reply share sharing social related recommended footer masthead login signin signup search widget pagination pager toolbar skip".split()
)
OUTSIDE_ONLY = frozenset(("header",))
NEVER_MARKED = frozenset("html body article main h1 h2 h3 h4 h5 h6 p".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
LOOSE = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none", re.I)
WORD = re.compile(r"[a-z0-9]+")

#: What the markup says of a line.
OPEN, SURE, MARKED = range(3)
#: Ranges of pages for each shuffle partition, so that ranges dealt by hash fill the tasks evenly.
RANGES = 3

KEYS = T.StructType([T.StructField("host", T.StringType()), T.StructField("path", T.StringType()), T.StructField("page_id", T.LongType()), T.StructField("digest", T.LongType())])
#: first and last: rows of a range; after: the first that differs from the first, before: the last that differs from the last.
ENDS = T.StructType([T.StructField(n, KEYS) for n in ("first", "after", "before", "last")])
LINES = T.StructType([T.StructField("digest", T.LongType()), T.StructField("lines", T.ArrayType(T.LongType()))])
#: texts: those of the lines that the markup doesn't mark.
PARSED = T.StructType([T.StructField("part", T.IntegerType()), *KEYS.fields, T.StructField("url", T.StringType()), T.StructField("lines", T.ArrayType(T.LongType())), T.StructField("kinds", T.BinaryType()), T.StructField("texts", T.ArrayType(T.StringType()))])
TEXTS = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), *(T.StructField(n, T.LongType()) for n in ("n_chars", "n_shared_lines", "n_marked_lines"))])


def _marked(name: str, attributes: str, inside: bool) -> bool:
    """Whether the element isn't part of the article. inside: it stands in one."""
    if name in DROPPED or name in OUTSIDE_ONLY and not inside:
        return True
    if not attributes or name in NEVER_MARKED:
        return False
    for key, value in ATTRIBUTE.findall(attributes):
        words = set(WORD.findall(value.lower()))
        if not (ROLES if key.lower() == "role" else MARKS).isdisjoint(words):
            return True
    return bool(HIDDEN.search(attributes))


def blocks(page: str) -> list[tuple[str, int]]:
    """The text blocks of the body, and what the markup says of each."""
    found: list[tuple[str, int]] = []
    parts: list[str] = []
    off: list[str] = []  # of dropped elements
    stack: list[tuple[str, bool, bool]] = []  # name, dropped, in an article: with what holds around it
    opened: Counter[str] = Counter()
    dropped = sure = False
    at, end = 0, len(page)

    def close() -> None:
        for own, kind in ((parts, SURE if sure else OPEN), (off, MARKED)):
            if own:
                if text := " ".join(html.unescape("".join(own)).split()):
                    found.append((text, kind))
                own.clear()

    while at < end:
        here = page.find("<", at)
        if here < 0:
            here = end
        if here > at:
            (off if dropped else parts).append(page[at:here])
        if here == end:
            break
        m = TOKEN.match(page, here) or LOOSE.match(page, here)
        if not m:
            (off if dropped else parts).append("<")
            at = here + 1
            continue
        at = m.end()
        if not (name := (m[2] or "").lower()):
            continue
        if name in INLINE and name not in VOID:
            # an inline element matters only if it is marked
            if not m[1] and not m[3].endswith("/") and (dropped or m[3] and _marked(name, m[3], sure)):
                stack.append((name, dropped, sure))
                opened[name] += 1
                dropped = True
            elif m[1] and opened[name]:
                dropped, sure = _leave(stack, opened, name)
            continue
        if name == "br":
            (off if dropped else parts).append(" ")
            continue
        close()
        if m[1]:
            if opened[name]:
                dropped, sure = _leave(stack, opened, name)
        elif name in RAW:
            shut = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = shut.end() if shut else end
        elif name not in VOID and not m[3].endswith("/"):
            if name == "p" and stack and stack[-1][0] == "p":
                dropped, sure = _leave(stack, opened, "p")
            stack.append((name, dropped, sure))
            opened[name] += 1
            dropped = dropped or _marked(name, m[3], sure)
            sure = sure or name in ARTICLE
    close()
    return found


def _leave(stack: list[tuple[str, bool, bool]], opened: Counter[str], name: str) -> tuple[bool, bool]:
    while stack:
        own, dropped, sure = stack.pop()
        opened[own] -= 1
        if own == name:
            return dropped, sure
    return False, False


def split_url(url: str) -> tuple[str, str]:
    """Host and path, without scheme, port, query, fragment, or a final slash or file suffix."""
    rest = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:", "", url.strip())
    rest = re.split(r"[?#]", rest.removeprefix("//"), maxsplit=1)[0]
    host, _, path = rest.partition("/")
    return host.rpartition("@")[2].partition(":")[0].lower(), re.sub(r"(?:/|\.[A-Za-z]{2,5})$", "", "/" + path)


def _batch(schema: T.StructType, rows: list[tuple]) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, to_arrow_schema(schema), strict=True)], names=schema.names)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From page_id, url, digest."""
    for batch in batches:
        yield _batch(KEYS, [(*split_url(url or ""), page_id, digest) for page_id, url, digest in zip(*(c.to_pylist() for c in batch.columns), strict=True)])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of ENDS for a sorted range of KEYS."""
    first = after = before = last = None
    for batch in batches:
        for row in batch.to_pylist():
            if first is None:
                first = row
            elif _copy(row) != _copy(last):
                after, before = after or row, last
            last = row
    if first is not None:
        yield _batch(ENDS, [(first, after, before, last)])


def _copy(row) -> tuple[str, int]:
    return row["host"], row["digest"]


def _place(row) -> tuple[str, str, int]:
    """Sorts as Spark does."""
    return row["host"], row["path"], -(1 << 63) if row["page_id"] is None else row["page_id"]


def neighbours(ends: list) -> list[tuple]:
    """Of each range the last row before its first page, and the first after its last, that isn't a copy of it; None where there is none."""
    out = []
    for i, own in enumerate(ends):
        j, left = i - 1, None
        while j >= 0 and left is None:
            left = ends[j]["last"] if _copy(ends[j]["last"]) != _copy(own["first"]) else ends[j]["before"]
            j -= 1
        j, right = i + 1, None
        while j < len(ends) and right is None:
            right = ends[j]["first"] if _copy(ends[j]["first"]) != _copy(own["last"]) else ends[j]["after"]
            j += 1
        out.append((left, right))
    return out


def line_hashes(found: list[tuple[str, int]]) -> list[int]:
    return [xxhash.xxh3_64_intdigest(t) - (1 << 63) for t, _ in found]


def _lined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From digest, html."""
    for batch in batches:
        for i in range(0, len(batch), 256):
            yield _batch(LINES, [(d, line_hashes(blocks(page or ""))) for d, page in zip(*(c.to_pylist() for c in batch.slice(i, 256).columns), strict=True)])


def _parsed(starts):
    """From page_id, url, html, digest. starts: places at which the ranges begin."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 256):  # lines leave in small batches
                rows = []
                for page_id, url, page, digest in zip(*(c.to_pylist() for c in batch.slice(i, 256).columns), strict=True):
                    (host, path), found = split_url(url or ""), blocks(page or "")
                    part = max(0, bisect.bisect_right(starts.value, _place({"host": host, "path": path, "page_id": page_id})) - 1)
                    rows.append((part, host, path, page_id, digest, url, line_hashes(found), bytes(k for _, k in found), [t for t, k in found if k != MARKED]))
                yield _batch(PARSED, rows)

    return parse


def common_lines(a: list, b: list) -> set[int]:
    """Places in a of a longest common subsequence of a and b: bit vectors of b, one for each line of a."""
    first, last, least = 0, 0, min(len(a), len(b))
    while first < least and a[first] == b[first]:
        first += 1
    while last < least - first and a[-1 - last] == b[-1 - last]:
        last += 1
    kept = set(range(first)) | set(range(len(a) - last, len(a)))
    own, other = a[first : len(a) - last], b[first : len(b) - last]
    places: dict = {}
    for j, line in enumerate(other):
        places[line] = places.get(line, 0) | 1 << j
    if not own or not other:
        return kept
    whole = state = (1 << len(other)) - 1
    states = []
    for line in own:
        met = state & places.get(line, 0)
        state = ((state + met) | (state - met)) & whole
        states.append(state)
    row, column = len(own), len(other)
    while row and column:
        if states[row - 1] >> (column - 1) & 1:
            column -= 1
        else:
            row -= 1
            if not row or states[row - 1] >> (column - 1) & 1:
                kept.add(first + row)
                column -= 1
    return kept


def _alike(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):  # noqa: B905
        if x != y:
            break
        n += 1
    return n


def _differenced(edges):
    """Rows come sorted by range and place. edges: of each range the neighbours outside, as (host, path, lines) or None."""

    def texts(run: list[dict], page: dict, sides: list) -> Iterator[tuple]:
        """run: the place of each copy of one page."""
        others = [(path, lines) for host, path, lines in (s for s in sides if s) if host == page["host"] and lines != page["lines"]]
        results: dict[int, tuple] = {}
        for own in run:
            best = max(range(len(others)), key=lambda i: _alike(own["path"], others[i][0]), default=-1)
            if best not in results:
                shared = common_lines(page["lines"], others[best][1]) if others else set()
                gone = {i for i in shared if page["kinds"][i] != SURE}
                marked = sum(k == MARKED and i not in gone for i, k in enumerate(page["kinds"]))
                left = (i for i, k in enumerate(page["kinds"]) if k != MARKED)
                whole = "\n\n".join(t for i, t in zip(left, page["texts"], strict=True) if i not in gone)
                results[best] = (whole, len(whole), len(gone), marked)
            yield own["page_id"], own["url"], *results[best]

    def difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        run: list[dict] = []
        page = before = None  # the copies' page, and the neighbour before them
        for batch in batches:
            for i in range(0, len(batch), 256):
                for row in batch.slice(i, 256).to_pylist():
                    place = {n: row[n] for n in ("page_id", "url", "path")}
                    if page and row["part"] == page["part"] and _copy(row) == _copy(page):
                        run.append(place)
                        continue
                    if page:
                        inside = row["part"] == page["part"]
                        out += texts(run, page, [before, (row["host"], row["path"], row["lines"]) if inside else edges.value[page["part"]][1]])
                        before = (page["host"], run[-1]["path"], page["lines"])
                    if not page or not inside:
                        before = edges.value[row["part"]][0]
                    page, run = row, [place]
                if len(out) >= 256:
                    yield _batch(TEXTS, out)
                    out = []
        if page:
            out += texts(run, page, [before, edges.value[page["part"]][1]])
            yield _batch(TEXTS, out)

    return difference


def extract(pages: DataFrame, ranges: int | None = None) -> DataFrame:
    """The columns of TEXTS. Pages are dealt by ranges of host and path, so that a host of any size is dealt over many tasks.
    The driver gets four keys of each range, and the lines of two pages."""
    spark = pages.sparkSession
    n = shuffle_partitions(spark)
    known = pages.select("page_id", "url", "html", F.xxhash64("html").alias("digest"))
    keys = known.select("page_id", "url", "digest").mapInArrow(_keyed, KEYS).repartitionByRange(ranges or RANGES * n, "host", "path", "page_id")
    ends = sorted(keys.sortWithinPartitions("host", "path", "page_id").mapInArrow(_ends, ENDS).collect(), key=lambda r: _place(r["first"]))
    sides = neighbours(ends)
    asked = {r["digest"] for pair in sides for r in pair if r}
    wanted = F.broadcast(spark.createDataFrame([(d,) for d in asked], "digest long"))
    lines = {r["digest"]: r["lines"] for r in known.select("digest", "html").join(wanted, "digest", "left_semi").dropDuplicates(["digest"]).select("digest", "html").mapInArrow(_lined, LINES).toLocalIterator()}
    edges = spark.sparkContext.broadcast([tuple(r and (r["host"], r["path"], lines[r["digest"]]) for r in pair) for pair in sides])
    starts = spark.sparkContext.broadcast([_place(r["first"]) for r in ends])
    parsed = known.mapInArrow(_parsed(starts), PARSED).repartition(n, "part")
    return parsed.sortWithinPartitions("part", "host", "path", "page_id").mapInArrow(_differenced(edges), TEXTS)


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(load(spark, sf_dir, "pages"))
