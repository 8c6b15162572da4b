"""HTML extraction by nearest-URL page differencing, with markup as tie-breaker."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkstone.functions.markup import tags

from .common import keep, slices

#: Fixed values of HTML: elements without content of their own, elements that break a line, and elements whose content is no text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
RAW = frozenset("script style noscript template iframe object svg textarea select button canvas audio video".split())
#: Elements that are no article wherever they stand (a header only outside of the article, where it heads the page).
ASIDE = frozenset("nav footer aside head title menu dialog".split())
#: Containers that may be menus, adverts and the like by the words of class, id and role; a container counts as such only if pages beside it have it too.
CONTAINER = frozenset("div section ul ol dl table span details figure fieldset center".split())
ASIDE_WORDS = frozenset("ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header login menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion related search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split())

_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Block(NamedTuple):
    """A line of a page: its text, whether an article or main element holds it, whether an element that is no article does, the container
    (0: none) around it that may be a menu, advert or the like, and the number of the form (0: none) that holds it (not one around the whole article element)."""

    text: str
    inside: bool
    aside: bool
    container: int
    form: int


def _container(tag: str, attributes: str) -> int:
    """Hash of a container's name and of its class, id and role, if those name a menu, advert or the like; else 0."""
    import xxhash

    if tag not in CONTAINER or not attributes:
        return 0
    named = [(m[1].lower(), m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)]
    if all(ASIDE_WORDS.isdisjoint(w.lower() for w in _WORDS.findall(v)) for _, v in named):
        return 0
    return xxhash.xxh64_intdigest(repr((tag, sorted(named))).encode("utf-8", "surrogatepass")) >> 1 or 1


def blocks(page: str | None) -> tuple[list[Block], bool]:
    """The lines of a page in order, and whether it marks its article by an article or main element.

    Comments, scripts and styles go; character references are decoded, white space becomes one space.
    """
    found: list[Block] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, int, int]] = []
    opened: Counter[str] = Counter()
    aside = article = at = container = form = forms = 0
    scoped = False
    page = page or ""

    def end_block() -> None:
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                found.append(Block(text, article > 0, aside > 0, container, form))
            parts.clear()

    def close() -> str:
        nonlocal aside, article, container, form
        tag, off, own, form = stack.pop()
        opened[tag] -= 1
        aside -= off
        article -= tag in ("article", "main")
        if own and own == container:
            container = 0
        return tag

    for start, end, tag, closes, attributes in tags(page, RAW):
        parts.append(page[at:start])
        at = end
        if not tag or tag in RAW:
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCK:
            end_block()
        if tag in VOID:
            continue
        if closes:
            while opened[tag] and close() != tag:
                pass
        elif not attributes.endswith("/"):
            if tag in ("p", "li") and stack and stack[-1][0] == tag:  # a new one ends an open one
                close()
            off = tag in ASIDE or tag == "header" and not article
            own = 0 if container else _container(tag, attributes)
            if own and tag not in BLOCK:
                end_block()
            opened[tag] += 1
            stack.append((tag, off, own, form))
            if tag in ("article", "main"):
                article += 1
                scoped = True
                form = 0  # a form around it is the page's frame
            if tag == "form" and not form:
                forms += 1
                form = forms
            aside += off
            container = container or own
    parts.append(page[at:])
    end_block()
    return found, scoped


def shared_lines(lines: list[int], other: list[int]) -> set[int]:
    """Places in `lines` that a longest common subsequence with `other` aligns.

    Bit-parallel over the other page's lines: whole rows of the table are one integer, so pages with thousands of lines align fast.
    """
    n, m = len(lines), len(other)
    start, end = 0, 0
    while start < min(n, m) and lines[start] == other[start]:
        start += 1
    while end < min(n, m) - start and lines[n - 1 - end] == other[m - 1 - end]:
        end += 1
    shared = set(range(start)) | set(range(n - end, n))
    a, b = lines[start : n - end], other[start : m - end]
    if not a or not b:
        return shared
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    rows, row = [], full
    for x in a:
        hit = row & where.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
        rows.append(row)  # zero bits mark where the length grows
    i, j = len(a) - 1, len(b) - 1
    while i >= 0 and j >= 0:
        if a[i] == b[j]:
            shared.add(start + i)
            i, j = i - 1, j - 1
        elif (full ^ (rows[i - 1] if i else full)) & ((2 << j) - 1) and ((full ^ rows[i - 1]) & ((2 << j) - 1)).bit_count() == ((full ^ rows[i]) & ((2 << j) - 1)).bit_count():
            i -= 1
        else:
            j -= 1
    return shared


def _hashes(texts: list[str]) -> list[int]:
    import xxhash

    return [xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) - (1 << 63) for t in texts]


_LINES = "row string, host string, path string, lines array<long>, chars array<int>, containers array<long>"


def _lines(batches: Iterator) -> Iterator:
    """Hashes and lengths of each page's lines, and its containers."""
    import pyarrow as pa

    for batch in slices(batches, "html"):
        pages = [blocks(x)[0] for x in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_pydict({
            "row": batch.column("row"), "host": batch.column("host"), "path": batch.column("path"), "lines": pa.array([_hashes([b.text for b in x]) for x in pages], pa.list_(pa.int64())),
            "chars": pa.array([[len(b.text) for b in x] for x in pages], pa.list_(pa.int32())), "containers": pa.array([sorted({b.container for b in x} - {0}) for x in pages], pa.list_(pa.int64()))})


def _common(x: str, y: str) -> int:
    n = 0
    for a, b in zip(x, y):
        if a != b:
            break
        n += 1
    return n


#: Pages of a block, and pages to each side of a page that it is held against; a neighbour that shares this share of its text is a copy.
_BLOCK, _BESIDE, _COPY = 256, 8, 0.9


def page_difference(page: dict, beside: list[dict]) -> tuple[list[int], list[int]] | None:
    """Lines of a page that its template holds, and its containers that pages beside it have too; None where no page beside it is other than a copy.

    beside: pages near it by URL on its host, the nearest first. Copies of the page say nothing of the template and are left out. The page's lines
    are aligned with those of the nearest page left; a shared line goes if at least half of the pages left hold it, so that an
    article that a few neighbours copy in part stays.
    """
    lines, total = page["lines"], sum(page["chars"])
    others = []
    for x in beside:
        held = set(x["lines"])
        if sum(c for h, c in zip(lines, page["chars"]) if h in held) < _COPY * total:
            others.append((x, held))
    if not others:
        return None
    times = Counter(h for _, held in others for h in held)
    gone = [i for i in sorted(shared_lines(lines, others[0][0]["lines"])) if 2 * times[lines[i]] >= len(others)]
    also = set().union(*(x["containers"] for x, _ in others))
    return gone, [c for c in page["containers"] if c in also]


def _differ(batches: Iterator) -> Iterator:
    """Blocks of pages in URL order, with the pages beside them at both ends."""
    import pyarrow as pa

    names = ("row", "gone", "repeated")

    def flush(held: list[dict]):
        out = []
        for i, page in enumerate(held):
            if page["own"] != page["block"] or not page["lines"]:
                continue
            near = [x for x in held[max(0, i - _BESIDE) : i] + held[i + 1 : i + 1 + _BESIDE] if x["host"] == page["host"]]
            near.sort(key=lambda x: (-_common(x["path"], page["path"]), abs(x["g"] - page["g"]), x["g"]))
            found = page_difference(page, near)
            if found is not None:
                out.append((page["row"], *found))
        types = (pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64()))
        return pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in out], t) for i, (n, t) in enumerate(zip(names, types))})

    held: list[dict] = []
    for batch in batches:
        for page in batch.to_pylist():
            if held and page["block"] != held[0]["block"]:
                yield flush(held)
                held = []
            held.append(page)
    if held:
        yield flush(held)


def _number(batches: Iterator) -> Iterator:
    """Adds each row's partition and place in it; rows arrive in order."""
    import pyarrow as pa
    from pyspark import TaskContext

    part, upto = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(upto, upto + n))], [*batch.schema.names, "part", "place"])
        upto += n


def _differences(lines: DataFrame) -> DataFrame:
    """row, gone, repeated of pages whose neighbours by URL say anything.

    Rows are range-partitioned by (host, path) and numbered across partitions (one count per partition is summed), then cut into blocks of even size, so
    that a hot host is many blocks; each block sees the pages beside it at both ends.
    """
    by = ["host", "path", "row"]
    placed = keep(lines.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(_number, f"{_LINES}, part int, place long"), "url-order")
    before = F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = placed.groupBy("part").count().select("part", F.coalesce(before, F.lit(0)).alias("before"))  # one row per partition
    placed = placed.join(F.broadcast(sizes), "part").withColumn("g", F.col("before") + F.col("place")).drop("part", "place", "before")
    block = lambda g: F.floor(g / _BLOCK)
    seen_by = F.array_distinct(F.array(block(F.col("g") - _BESIDE), block(F.col("g")), block(F.col("g") + _BESIDE)))
    dealt = placed.withColumn("own", block(F.col("g"))).withColumn("block", F.explode(seen_by))
    return dealt.repartition("block").sortWithinPartitions("block", "g").mapInArrow(_differ, "row string, gone array<int>, repeated array<long>")


def _main_part(sizes: list[tuple[int, int]]) -> set[int]:
    """The number under which more than half of the characters lie, if there is one."""
    held: Counter[int] = Counter()
    for number, n in sizes:
        held[number] += n
    return {number for number, n in held.items() if 2 * n > sum(held.values())}


def article(page: str | None, gone: list[int], repeated: list[int] | None) -> str:
    """The main text of a page: first what differencing took goes, then markup breaks the ties.

    Lines of elements that are no article go, and so do those of containers that pages beside it have too; where no page beside it tells (repeated: None), of
    containers that hold half of its text at most. A form goes, unless it frames the article element or, without one, over half of the text. A page with an article or main
    element is left with what that holds, which no difference takes away, since neighbours often copy an article; another page with all that is left.
    """
    found, scoped = blocks(page)
    template = set(gone)
    left = [b for i, b in enumerate(found) if not b.aside and (b.inside if scoped else i not in template)]
    frames = set() if scoped else _main_part([(b.form, len(b.text)) for b in left])
    left = [b for b in left if not b.form or b.form in frames]
    if repeated is None:
        sizes = [(b.container, len(b.text)) for b in left]
        repeated = {c for c, _ in sizes} - _main_part(sizes)
    common = set(repeated) - {0}
    kept = [b.text for b in left if b.container not in common]
    return "\n".join(kept)


def _texts(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in slices(batches, "html"):
        texts = [article(x, g or (), r) for x, g, r in zip(*(batch.column(c).to_pylist() for c in ("html", "gone", "repeated")))]
        yield pa.RecordBatch.from_pydict({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(texts, pa.string())})


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url and the main text of every page of (page_id, url, html).

    1. Every page is parsed into lines, in one pass that is linear in the page.
    2. Pages are ordered by path within their host; each is held against up to eight pages on either side. Its lines are aligned with those
       of the nearest by longest common subsequence, and shared lines that half of its neighbours hold go (page_difference). Containers such as
       `class="comments"` count as such only where a neighbour has them too.
    3. Markup breaks the ties (article): menus, footers and the like by element, and what an article or main element holds stays.

    Null or empty pages give an empty text; pages without URL or with nothing but copies beside them are decided by markup alone. Repeated rows give
    repeated results. Extra columns are ignored; an empty table gives no rows.
    """
    url = F.lower(F.col("url"))
    host, path = F.regexp_extract(url, r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1), F.regexp_extract(url, r"^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    row = F.concat_ws("|", F.col("page_id").cast("string"), F.xxhash64("url", "html").cast("string"))
    rows = pages.select("page_id", "url", "html", row.alias("row"))
    lines = rows.filter("url is not null and html is not null").select("row", host.alias("host"), path.alias("path"), "html")
    differences = _differences(lines.mapInArrow(_lines, _LINES).dropDuplicates(["row"])).withColumnRenamed("row", "_row")
    joined = rows.join(differences, rows["row"] == differences["_row"], "left").select("page_id", "url", "html", "gone", "repeated")
    return joined.mapInArrow(_texts, "page_id long, url string, text string")
