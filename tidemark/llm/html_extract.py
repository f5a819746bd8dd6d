"""Main text of web pages by nearest-URL page differencing.

A page becomes lines (its blocks of text, in page order, boilerplate included). Pages are sorted by host and
path; each is paired with the neighbour of its host whose path has the longest common prefix with its own,
the two pages' lines are aligned by longest common subsequence, and lines that both have are deleted as template.

Differencing alone would keep what a template fills differently on each page, and would delete an article that
two URLs carry, so structure takes part: lines inside an article (or main) element are never deleted by it, and
if a page has such an element, only lines inside it are text; lines in elements that hold navigation, adverts,
forms, notices or reader comments never are text.

Pages are dealt by ranges of (host, path, key), so a host of any size is spread over tasks, and each task streams
through its range holding three pages; the pages at the ends of a range also go to the range beside it, as neighbours only.
Null or empty pages give an empty text. Repeated rows give a row each. Rows without an id or url sort first. Columns
beyond key, url and page are left out, so their names don't matter.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, worker
from .url_filter import host_of, path_of

#: Cells (lines of one page times lines of the other) that an alignment holds bits for; larger ones are halved.
CELLS = 100_000_000

#: Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe title".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td "
    "tfoot th thead tr ul".split()
)
DROPPED = frozenset("nav footer aside form button select menu dialog head noscript template iframe canvas object embed audio video".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "newsletter subscribe subscription signup popup modal overlay sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs "
    "footer comment comments reply replies disqus share sharing social related recommended pagination pager widget toolbar skip copyright login search".split()
)
#: Of these, the names that also mark what stands within an article and isn't of it.
WITHIN = frozenset(
    "ad ads adbox advert adverts advertisement advertising sponsor sponsored cookie cookies consent gdpr notice notices newsletter subscribe "
    "sidebar sidebars nav navbar navigation breadcrumb breadcrumbs comment comments reply replies disqus share sharing".split()
)
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
WALLS = frozenset("ul ol dl table article main section".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_NAMED = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_PART = re.compile(r"[a-z]+")


class Lines(NamedTuple):
    lines: list[str]
    #: 0: text wherever it stands; 1: inside an article; -1: boilerplate.
    kinds: list[int]


def _unwanted(attributes: str, inside: bool) -> bool:
    """If class, id, role or hiding say that an element isn't text; within an article, fewer names do."""
    names = WITHIN if inside else NAMES
    for name, value in _NAMED.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in ROLES:
            return True
        if name in ("class", "id") and any(part in names for part in _PART.findall(value)):
            return True
    return False


def lines_of(page: str) -> Lines:
    """The blocks of text of a page, in page order, with what they are."""
    out, kinds = [], []
    text: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # name, if it or one around it is unwanted, if inside an article
    open_blocks: Counter[str] = Counter()
    at, n = 0, len(page)
    ends: dict[str, int] = {}

    def end_of(name: str, after: int) -> re.Match[str] | None:
        """The next end tag of name; its last place is looked up once, so that what is never closed is not searched for again."""
        tag = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I)
        if name not in ends:
            ends[name] = max((m.start() for m in tag.finditer(page)), default=-1)
        return tag.search(page, after) if ends[name] >= after else None

    def close(k: int) -> None:
        open_blocks.subtract(x[0] for x in stack[k:])
        del stack[k:]

    def flush() -> None:
        if text and (line := " ".join("".join(text).split())):
            _, bad, inside = stack[-1] if stack else ("", False, False)
            out.append(line)
            kinds.append(-1 if bad else 1 if inside else 0)
        text.clear()

    while at < n:
        tag = _TAG.search(page, at)
        piece = page[at : tag.start() if tag else n]
        if piece:
            text.append(html.unescape(piece) if "&" in piece else piece)
        if not tag:
            break
        at = tag.end()
        name = (tag[2] or tag[5] or "").lower()
        if not name:
            continue
        if tag[1] or tag[4]:
            if name in BLOCK:
                flush()
                if open_blocks[name] > 0:
                    close(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name))
            continue
        attributes = tag[3] or tag[6] or ""
        if name in RAW:
            if not attributes.rstrip().endswith("/"):
                end = end_of(name, at)
                at = end.end() if end else n
            continue
        if name == "br":
            text.append(" ")
            continue
        if name in BLOCK:
            flush()
            if name == "body" or name in ("article", "main") and stack and stack[-1][1] and any(x[1] and not end_of(x[0], at) for x in stack):
                close(0)  # an unwanted element that is never closed doesn't reach into these
            elif (closed := CLOSED_BY.get(name)) and any(open_blocks[c] > 0 for c in closed):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in closed:
                        close(k)
                        break
                    if stack[k][0] in WALLS:
                        break
            if stack and stack[-1][0] == "p":
                close(len(stack) - 1)
        if name in VOID or attributes.rstrip().endswith("/") and name not in BLOCK:
            continue
        _, bad, inside = stack[-1] if stack else ("", False, False)
        bad = bad or name in DROPPED or name == "header" and not inside or name not in ("body", "html") and bool(attributes.strip()) and _unwanted(attributes, inside)
        inside = inside or name in ("article", "main")
        if name in BLOCK:
            stack.append((name, bad, inside))
            open_blocks[name] += 1
        elif bad and not (stack and stack[-1][1]):  # inline elements matter only where they begin something unwanted
            end = end_of(name, at)
            at = end.end() if end else at
    flush()
    return Lines(out, kinds)


def _rows(x: list[str], y: list[str]) -> Iterator[int]:
    """For each line of x, the set of places of y (as bits) where the longest common subsequence with y so far doesn't grow."""
    where: dict[str, int] = {}
    for k, line in enumerate(y):
        where[line] = where.get(line, 0) | 1 << k
    row = full = (1 << len(y)) - 1
    for line in x:
        match = row & where.get(line, 0)
        row = ((row + match) | (row & ~where.get(line, 0))) & full
        yield row


def _lengths(x: list[str], y: list[str]) -> np.ndarray:
    """Lengths of the longest common subsequences of x and every beginning of y."""
    row = (1 << len(y)) - 1
    for row in _rows(x, y):  # noqa: B007
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(y) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(y)]
    return np.concatenate([[0], np.cumsum(bits == 0)])


def common_lines(a: list[str], b: list[str]) -> tuple[set[int], set[int]]:
    """Places of a longest common subsequence of two lists of lines; long lists are halved, so that memory stays bounded."""
    left: set[int] = set()
    right: set[int] = set()
    pending = [(0, len(a), 0, len(b))]
    while pending:
        i, end, j, stop = pending.pop()
        while i < end and j < stop and a[i] == b[j]:
            left.add(i)
            right.add(j)
            i, j = i + 1, j + 1
        while i < end and j < stop and a[end - 1] == b[stop - 1]:
            end, stop = end - 1, stop - 1
            left.add(end)
            right.add(stop)
        x, y = a[i:end], b[j:stop]
        if not x or not y or not set(x) & set(y):
            continue
        if len(x) > 1 and len(x) * len(y) > CELLS:
            half = len(x) // 2
            cut = int((_lengths(x[:half], y) + _lengths(x[half:][::-1], y[::-1])[::-1]).argmax())
            pending += [(i, i + half, j, j + cut), (i + half, end, j + cut, stop)]
            continue
        rows = list(_rows(x, y))
        p, q = len(x) - 1, len(y) - 1
        while p >= 0 and q >= 0:
            if rows[p] >> q & 1:  # place q doesn't count in row p
                q -= 1
            elif p and not rows[p - 1] >> q & 1:
                p -= 1
            else:
                left.add(i + p)
                right.add(j + q)
                p, q = p - 1, q - 1
    return left, right


def _prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((k for k in range(n) if a[k] != b[k]), n)


def difference(pages: list[Lines], paths: list[str], k: int) -> set[int]:
    """Lines of page k that its nearest neighbour among pages[k - 1] and pages[k + 1] has too."""
    near = max((i for i in (k - 1, k + 1) if 0 <= i < len(pages)), key=lambda i: (_prefix(paths[i], paths[k]), -i), default=None)
    return set() if near is None else common_lines(pages[k].lines, pages[near].lines)[0]


def text_of(page: Lines, shared: set[int]) -> str:
    guarded = 1 in page.kinds
    return "\n\n".join(line for k, line in enumerate(page.lines) if page.kinds[k] == 1 or not guarded and page.kinds[k] == 0 and k not in shared)


def dealt(source: DataFrame) -> DataFrame:
    """source (key, host, path and more) by ranges of (host, path, key), sorted, with own: false for rows of a neighbouring range.

    A range also gets the last row of the range before it and the first of the one after it, so that the neighbours of
    every page are there. The ranges are found by the keys alone; their ends are two keys for each range.
    """
    spark = source.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.struct("host", "path", F.col("key").isNotNull().alias("named"), "key").alias("at")]
    spread = source.select(*order).repartitionByRange(parts, "at").groupBy(F.spark_partition_id().alias("part")).agg(F.min("at").alias("low"), F.max("at").alias("high"))
    plain = lambda at: (at["host"], at["path"], at["named"], at["key"] if at["named"] else 0)
    ends = sorted((plain(r["low"]), plain(r["high"])) for r in spread.collect())
    lows, highs = [x for x, _ in ends], [y for _, y in ends]

    @F.pandas_udf("array<int>")
    def places(host: pd.Series, path: pd.Series, key: pd.Series) -> pd.Series:
        """The ranges that get a row: its own comes first."""
        out = []
        for h, p, k in zip(host, path, key, strict=True):
            at = (h, p, not pd.isna(k), 0 if pd.isna(k) else k)
            own = max(bisect_right(lows, at) - 1, 0)
            out.append([own, *([own - 1] if own and at == lows[own] else []), *([own + 1] if own + 1 < len(lows) and at == highs[own] else [])])
        return pd.Series(out)

    placed = source.withColumn("places", places("host", "path", "key")).select("*", F.posexplode("places").alias("n", "part"))
    by_range = placed.withColumn("own", F.col("n") == 0).drop("places", "n").repartitionById(max(len(ends), 1), "part")
    return by_range.sortWithinPartitions("part", "host", "path", F.col("key").isNotNull(), "key")


def extract(df: DataFrame, page: str = "html", url: str = "url", key: str = "page_id") -> DataFrame:
    """Columns key, url, text, n_chars, n_lines and n_shared (lines that the nearest page has too)."""
    address = F.coalesce(F.col(url).cast("string"), F.lit(""))
    source = df.select(F.col(key).alias("key"), F.col(url).alias("url"), host_of(address).alias("host"), path_of(address).alias("path"), F.coalesce(F.col(page).cast("string"), F.lit("")).alias("html"))
    kinds = dict(source.dtypes)
    order = ("key", "url", "host", "path", "html", "part", "own")

    def pair(batches: Batches) -> Batches:
        held: list[tuple] = []  # up to three pages of one host and range: the one before, the one in question, the one after
        done: list[tuple] = []
        types: list[pa.DataType] = []

        def finish(k: int) -> None:
            id_, address_, _, path, lines, own = held[k]
            if own:
                shared = difference([x[4] for x in held], [x[3] for x in held], k)
                text = text_of(lines, shared)
                done.append((id_, address_, text, len(text), len(lines.lines), len(shared)))

        def batch_of() -> pa.RecordBatch:
            columns = [pa.array(x, t) for x, t in zip(zip(*done, strict=True), types, strict=True)]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, names=[key, url, "text", "n_chars", "n_lines", "n_shared"])

        for batch in batches:
            types = [batch.column(c).type for c in ("key", "url")] + [pa.string(), pa.int64(), pa.int64(), pa.int64()]
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                for id_, address_, host, path, page_, place, own in zip(*(part.column(c).to_pylist() for c in order), strict=True):
                    if held and held[-1][2] != (host, place):
                        finish(len(held) - 1)
                        held.clear()
                    held.append((id_, address_, (host, place), path, lines_of(page_), own))
                    if len(held) > 1:
                        finish(len(held) - 2)
                    del held[:-2]
                if done:
                    yield batch_of()
        if held:
            finish(len(held) - 1)
        if done:
            yield batch_of()

    schema = f"`{key}` {kinds['key']}, `{url}` {kinds['url']}, text string, n_chars long, n_lines long, n_shared long"
    return dealt(source).select(*order).mapInArrow(worker(pair), schema)
