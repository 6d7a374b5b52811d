"""Main text of web pages by differencing with the page of the nearest URL.

All pages are put in the order of host, path and id, and a page is paired with
that neighbour on its host whose path shares the longer beginning. The text
lines of both (one for each block) are aligned by a longest
common subsequence, and lines that the two share are a template's, not the
page's, and are deleted. A neighbour that shares more than ``COPY`` of a page's
characters is a copy of it and tells nothing; the other neighbour is asked then,
and where that is a copy too, nothing is deleted.

Markup decides before that where it is plain: menus, headers, footers, sidebars,
adverts, notices, forms, comments, scripts and styles are no candidates, and the
blocks of an ``article`` element are main text, all of them: articles under
neighbouring URLs may hold the same lines. A page without an article is left
with the lines of its ``main`` element, or with all its lines, that differencing
doesn't delete. So the differencing decides about pages that declare no article.

Adverts, notices and the like are known by their element or by the words of their
class, id or role, whatever block has them, and what is hidden isn't text.

Places in the order are numbered from the keys alone (sorted in ranges), and runs
of ``RUN`` pages go to a task together, each with the page before and the page
behind it. So every page meets its neighbours, however many pages its host has
and however they are partitioned, and a task holds three pages at a time. Pages
without a neighbour lose no line.

A null html counts as empty and gives an empty text; a null url is a host of its
own. Rows that repeat one url are each other's neighbours; rows that repeat id,
url and html are one page, and each has its text. A tag that nothing closes is
text. Markup is read in time that grows with its length alone.
"""

from __future__ import annotations

import html
import re
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.sample import with_row_numbers
from .base import small_side

RUN, COPY, CELLS = 64, 0.6, 1 << 28
NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9-]*)")
STOP = re.compile(r"""[>"']""")
QUOTED = re.compile(r"""=\s*(?:"[^"]*"|'[^']*'|[^\s>]+)""")
HIDDEN = re.compile(r"(?i)(?:^|[\s/])hidden(?=[\s=/]|$)")
UNSEEN = re.compile(r"""(?i)\bstyle\s*=\s*["'][^"']*(?:display\s*:\s*none|visibility\s*:\s*hidden)""")
NAMED = re.compile(r"""(?i)\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
RAW = frozenset({"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg"})
RAW_END = {t: re.compile(rf"(?i)</{t}\s*>") for t in RAW}
#: Elements that hold blocks and are closed by name.
HOLDERS = frozenset("html head body article main section div nav header footer aside form ul ol dl table figure dialog menu fieldset details select button".split())
BREAKS = HOLDERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th thead tbody blockquote pre br hr figcaption summary option address center".split())
APART = frozenset({"head", "nav", "footer", "aside", "form", "dialog", "menu", "select", "button"})
APART_NAMES = frozenset(
    "ad ads advert adverts advertisement banner cookie cookies consent sidebar menu nav navbar navigation footer breadcrumb breadcrumbs comment comments share sharing social promo sponsor sponsored newsletter subscribe subscription popup modal overlay related recommended widget notice notices alert disclaimer login signup toolbar pagination".split()
)
#: Blocks that hold no other ones for certain, and the beginnings of blocks that end them unsaid; a p ends where any block begins.
UNSAID = {t: frozenset(by.split()) for t, by in {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr tbody thead", "td": "td th tr tbody thead", "th": "td th tr tbody thead", "thead": "tbody", "tbody": "tbody thead", "option": "option"}.items()}
OPEN, MAIN, PLAIN, CLOSED = 3, 2, 1, 0  # inside an article; inside main; not known; certainly not main text


def _apart(tag: str, attrs: str, inside: bool) -> bool:
    if tag in APART or tag == "header" and not inside:
        return True
    if not attrs:
        return False
    for m in NAMED.finditer(attrs):
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            if name in APART_NAMES or not APART_NAMES.isdisjoint(re.split("[-_]+", name)):
                return True
    return UNSEEN.search(attrs) is not None or HIDDEN.search(QUOTED.sub("=", attrs)) is not None


class Tags:
    """Finds where tags end. Each place of a quote is looked at once, however many tags that nothing closes stand before it."""

    def __init__(self, page: str) -> None:
        self.page, self.lost = page, set()
        self.last = max(map(page.rfind, ">\"'"))
        self.known = (0, -1)  # from the first to the second place, the second is the next stop

    def end(self, i: int) -> int:
        """Behind the > of a tag whose attributes begin at i, or -1 if there is none outside quotes."""
        page, seen = self.page, []
        while i <= self.last:
            lo, at = self.known
            if not lo <= i <= at:
                at = STOP.search(page, i).start()
                self.known = (i, at)
            if page[at] == ">":
                return at + 1
            if at in self.lost:
                break
            seen.append(at)
            i = page.find(page[at], at + 1) + 1
            if not i:
                break
        self.lost.update(seen)
        return -1


def blocks(page: str | None) -> list[tuple[int, str]]:
    """(zone, line) of each block that has text, in page order."""
    page = page or ""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []
    buf: list[str] = []
    zone, pos, n = PLAIN, 0, len(page)
    tags, last = Tags(page), page.rfind(">")

    def flush() -> None:
        if buf and (line := " ".join(html.unescape("".join(buf)).split())):
            out.append((zone, line))
        buf.clear()

    while pos < n:
        at = page.find("<", pos)
        if at < 0:
            buf.append(page[pos:])
            break
        if at > pos:
            buf.append(page[pos:at])
        if page.startswith("<!--", at):
            pos = page.find("-->", at + 4) + 3
            pos = pos if pos > 2 else n
            continue
        m = NAME.match(page, at)
        if m:
            end = tags.end(m.end())
        else:
            end = page.find(">", at) + 1 if page[at + 1 : at + 2] in ("!", "?") and at < last else 0
        if end <= 0:
            buf.append("<")
            pos = at + 1
            continue
        pos = end
        if m is None:
            continue
        tag, closes, attrs = m[1].lower(), page[at + 1] == "/", page[m.end() : end - 1]
        if tag in RAW and not closes:
            end = RAW_END[tag].search(page, pos)
            pos = end.end() if end else n
            continue
        if tag not in BREAKS:
            continue
        flush()
        if closes:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    zone = stack[i][1]
                    del stack[i:]
                    break
                if tag not in HOLDERS and stack[i][0] in HOLDERS:
                    break  # a block ends inside what holds it
            continue
        while stack and (tag != "br" if stack[-1][0] == "p" else tag in UNSAID.get(stack[-1][0], ())):
            zone = stack.pop()[1]
        if tag == "body":  # ends a head that was left open
            stack, zone = [], PLAIN
        apart = zone != CLOSED and _apart(tag, attrs, zone >= MAIN)
        if tag in HOLDERS:
            stack.append((tag, zone))
            if zone != CLOSED:
                zone = CLOSED if apart else OPEN if tag == "article" else max(zone, MAIN) if tag == "main" else zone
        elif apart and tag not in ("br", "hr"):
            stack.append((tag, zone))
            zone = CLOSED
    flush()
    return out


def _rows(a: list, b: list):
    """After each item of ``b``, a number whose bit i is 0 where a common subsequence grows with a[i] (bit-parallel)."""
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | (1 << i)
    v = ones = (1 << len(a)) - 1
    yield v
    for x in b:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & ones
        yield v


def _lengths(a: list, b: list) -> list[int]:
    """Longest common subsequence of each beginning of ``a`` with ``b``."""
    for v in _rows(a, b):
        pass
    bits = format(v, f"0{len(a)}b")[::-1] if a else ""
    return [0, *accumulate(c == "0" for c in bits)]


def common(a: list, b: list) -> set[int]:
    """Places in ``a`` that a longest common subsequence with ``b`` uses: rows of bits and a walk back through them.

    Where the rows would take more than ``CELLS`` bits, ``b`` is halved, and ``a`` where the two halves have most in common with it.
    """
    if len(a) * len(b) > CELLS and len(b) > 1:
        half = len(b) // 2
        left, right = _lengths(a, b[:half]), _lengths(a[::-1], b[half:][::-1])[::-1]
        cut = max(range(len(a) + 1), key=lambda i: left[i] + right[i])
        return common(a[:cut], b[:half]) | {i + cut for i in common(a[cut:], b[half:])}
    rows = list(_rows(a, b))
    used, i, j = set(), len(a), len(b)
    while i and j:
        if rows[j] >> (i - 1) & 1:
            i -= 1
        elif not rows[j - 1] >> (i - 1) & 1:
            j -= 1
        else:
            i, j = i - 1, j - 1
            used.add(i)
    return used


def candidates(own: list[tuple[int, str]]) -> tuple[int, list[str]]:
    """The zone that may hold the main text, and its lines."""
    best = max((z for z, _ in own), default=CLOSED)
    return best, [x for z, x in own if z == best != CLOSED]


def main_lines(own: list[tuple[int, str]], others: list[list[tuple[int, str]]]) -> list[str]:
    """Lines of a page that are its main text, given those of its neighbours, the nearest first."""
    zone, lines = candidates(own)
    if zone == OPEN:
        return lines
    size = sum(map(len, lines))
    for other in others:
        shared = common(lines, [x for _, x in other])
        if sum(len(lines[i]) for i in shared) <= COPY * size:
            return [x for i, x in enumerate(lines) if i not in shared]
    return lines


def _alike(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", run: int = RUN) -> DataFrame:
    """(page_id, url, text, n_chars) of each page."""
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), F.xxhash64(F.col(html_col)).alias("tie"))
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
    keys = p.select("page_id", "url", "tie").distinct().select("page_id", "url", "tie", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    keys = with_row_numbers(keys, "host", "path", "page_id", "url", "tie").select(F.col("page_id").alias("i"), F.col("url").alias("u"), F.col("tie").alias("t"), "host", "path", "row")
    width = 64 + F.coalesce(F.octet_length("u"), F.lit(0)) + F.octet_length("host") + F.octet_length("path")
    p = p.join(small_side(keys, width)(keys), F.col("page_id").eqNullSafe(F.col("i")) & F.col("url").eqNullSafe(F.col("u")) & (F.col("tie") == F.col("t")))
    own, place = F.floor(F.col("row") / run), F.col("row") % run
    # the first page of a run is also behind the last one of the run before, the last one before the first one of the next
    runs = F.array_compact(F.array(own, F.when(place == 0, own - 1), F.when(place == run - 1, own + 1)))
    p = p.select("page_id", "url", "html", "host", "path", "row", own.alias("own"), F.explode(runs).alias("run"))
    p = p.repartition("run").sortWithinPartitions("run", "row").select("run", "row", "own", "host", "path", "page_id", "url", "html")

    def differ(batches):
        """Rows of a run that are its own, with one page of look-ahead; a page that comes several times is read once."""
        before = now = None
        out: list[tuple] = []
        size = 0

        def done(now, before, after):
            (where, lines, host, path, rows), near = now, []
            for x in (before, after):
                if x and x[0][0] == where[0] and x[2] == host:
                    near.append(x)
            near.sort(key=lambda x: -_alike(path, x[3]))
            text = "\n".join(main_lines(lines, [x[1] for x in near]))
            return [(i, u, text, len(text)) for i, u in rows]

        for b in batches:
            for run_, row, own_, host_, path_, page_id, url_, page in zip(*[c.to_pylist() for c in b.columns]):
                mine = [(page_id, url_)] if own_ == run_ else []
                if now and now[0] == (run_, row):
                    now[4].extend(mine)
                    continue
                after = ((run_, row), blocks(page), host_, path_, mine)
                if now and now[4]:
                    out += done(now, before, after)
                    size += len(out[-1][2])
                before, now = now, after
                if size > 4_000_000 or len(out) >= 2000:
                    yield _batch(out)
                    out, size = [], 0
        if now and now[4]:
            out += done(now, before, None)
        if out:
            yield _batch(out)

    return p.mapInArrow(differ, "page_id long, url string, text string, n_chars long")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["page_id", "url", "text", "n_chars"])
