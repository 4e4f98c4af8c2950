"""Main text of HTML pages by nearest-URL page differencing.

Pages are ordered by host and URL path, so that a page's neighbours are the pages of its host with the
most similar addresses. Each page is cut into lines (the text of its blocks); its lines are aligned
with those of the page before and after it by longest common subsequence, and shared lines are
deleted: what pages of a site have in common is its frame. Lines are compared by what a frame keeps from page to
page: in an element that says it is a frame, by their place (the path of tags and classes), as menus, adverts and
footers say other words on each page; outside of it a line that is all links, in a list, cell or div, by its place too,
and any other by its text. Lines inside an article or main element are deleted only where the pages on both sides
have them at the same place of their content, so that a passage which pages quote stays.

What differencing leaves of a frame, as on a page whose neighbours have no such element or that has none, its
element decides: nav, header outside of the article, footer, aside, form, script, style, hidden ones, and those with
a class, id or role of an advert, menu, notice, comment and the like (FRAME_WORDS). Such a word counts alone or beside words
that only say how it is shown (``comment-list``, not ``notice-of-motion``); words that may be a story's too (WEAK_WORDS) count
outside of an article and alone. Lines outside of an article stay unless a neighbour shares them.

Each page's lines go as hashes, without texts, to their neighbours: pages with equal lines are one content of their
host, contents are dealt by ranges of (host, path, page_id) and streamed in order, and what is shared comes back to
the pages by a digest of their html. So the neighbours of a page are the nearest ones that differ from it, equal pages of a host
have equal texts, and a page's lines outside of frames are shuffled once, packed. The first and last content of a range are also handed to the
ranges beside it, for comparison only: the texts don't depend on how many ranges there are.

Defined cases: null html is empty; a null or unparsable url is a host of its own name; of pages that tie in address
the one with the smaller digest comes first; repeated rows get equal texts; a page without main text gives an empty
string; a very long page is read whole, its lines aligned in parts; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import bounded_batches, deal_ranges, join_groups, range_count

#: Fixed values of HTML: elements that hold no text, that end a block, that are never closed.
SILENT = frozenset("script style noscript template svg math iframe object canvas audio video select option textarea button head title".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FRAME = frozenset("nav footer aside form menu dialog fieldset".split())
CONTENT = frozenset(("article", "main"))
#: Elements that group others, and those that are never a frame by their name.
CONTAINERS = frozenset("center details div dl header ol section table tbody td tr ul".split())
NEVER = frozenset("body article main h1 h2 h3 h4 h5 h6 hgroup".split())
#: Start tags that end an open element: (elements ended, elements that they are not sought beyond).
_CELLS = frozenset("td th caption".split())
ENDS = (
    {"li": (frozenset(["li"]), frozenset("ul ol menu dir".split())), "tr": (frozenset(["tr", "caption"]), frozenset(["table"]))}
    | {t: (frozenset(["dd", "dt"]), frozenset(["dl"])) for t in ("dd", "dt")}
    | {t: (_CELLS, frozenset(["table"])) for t in ("td", "th")}
    | {t: (frozenset("tbody thead tfoot caption".split()), frozenset(["table"])) for t in ("tbody", "thead", "tfoot")}
)
_OPEN_P = (frozenset(["p"]), BLOCKS - {"p"})
#: Words of a class, id or role that say an element is not the article; those of adverts count on inline elements too;
#: those that may name a story's part count outside of an article alone; those that only say how a thing is shown.
ADVERT_WORDS = frozenset("ad ads advert adverts advertisement advertisements advertising adsbygoogle sponsored".split())
FRAME_WORDS = ADVERT_WORDS | frozenset(
    "sponsor promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside footer masthead topbar toolbar cookie cookies consent gdpr notice notices newsletter "
    "subscribe subscription share sharing related recommended recommendations comment comments reply replies disqus respond pagination pager complementary contentinfo".split()
)
WEAK_WORDS = frozenset("banner side foot alert popup modal overlay signup login register search social discussion widget widgets".split())
SHOWN_WORDS = frozenset(
    "list lists section area box block slot unit wrap wrapper container holder reader readers user users post posts article articles story stories item items link links button buttons bar form "
    "thread banner widget top bottom left right site page inner outer content text main primary secondary global mobile desktop".split()
)
#: Blocks in which a line of links alone is a menu's.
LISTED = frozenset("li td th div dd dt ul ol dl tr table".split())
INLINE = frozenset("span ins a b i em strong small font mark".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(!|\?)[^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'=]|=\s*+\"[^\"]*\"|=\s*+'[^']*'|[=\"'])*+)>", re.S)
_MARK = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_SPACE = re.compile(r"\s+")


def _marks(attributes: str) -> list[tuple[str, str]]:
    return [(name.lower(), value.strip("\"'").lower()) for name, value in _MARK.findall(attributes)] if attributes else []


def _names_frame(token: str, alone: bool, in_content: bool) -> bool:
    words = [w for w in re.split(r"[^a-z]+", token) if w]
    if not FRAME_WORDS.isdisjoint(words) and all(w in FRAME_WORDS or w in SHOWN_WORDS or w in WEAK_WORDS for w in words):
        return True
    return not in_content and alone and any(w in WEAK_WORDS for w in words) and all(w in WEAK_WORDS or w in SHOWN_WORDS - {"main"} for w in words)


def _is_frame(tag: str, marks: list[tuple[str, str]], in_content: bool) -> bool:
    """Whether an element is no part of the article: by its tag, a class, id or role, or as it is hidden."""
    if tag in FRAME or (tag == "header" and not in_content):
        return True
    for name, value in marks:
        if name in ("class", "id", "role") and tag not in NEVER:
            tokens = value.split()
            if tag in INLINE and name == "class" and not ADVERT_WORDS.isdisjoint(tokens):
                return True
            if tag in BLOCKS and any(_names_frame(t, len(tokens) == 1 and tag in CONTAINERS - {"section"}, in_content) for t in tokens):
                return True
        if name == "hidden" and value != "until-found":
            return True
        if name == "style" and re.search(r"display\s*:\s*none", value) or name == "aria-hidden" and value == "true":
            return True
    return False


def lines(html: str | None) -> list[tuple[str, int, str]]:
    """(text, kind, key) of each non-empty block in page order; kind is 1 in content, -1 in a frame, else 0; lines of
    two pages are compared by their keys."""
    html = html or ""
    out: list[tuple[str, int, str]] = []
    text: list[str] = []
    stack: list[tuple[str, int, str, int]] = []  # open blocks and elements that matter: (tag, kind around it, path around it, inline frames around it)
    kind, path, muted, links, plain, at, n = 0, "", 0, 0, False, 0, len(html)

    def end() -> None:
        nonlocal plain
        if text:
            line = _SPACE.sub(" ", entities.unescape("".join(text))).strip()
            text.clear()
            if line:
                listed = path.rsplit("/", 1)[-1].split(".", 1)[0] in LISTED
                out.append((line, kind, f"1{line}" if kind == 1 else f"-{path}" if kind == -1 else f"0{path}" if listed and not plain else f"0 {line}"))
        plain = False

    def add(piece: str) -> None:
        nonlocal plain
        if not muted:
            text.append(piece)
            plain = plain or not links and not piece.isspace()

    def close(i: int) -> None:
        nonlocal kind, path, muted
        _, kind, path, muted = stack[i]
        del stack[i:]

    def implied(tags: frozenset[str], scope: frozenset[str]) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in tags:
                close(i)
                return
            if stack[i][0] in scope:
                return

    while at < n:
        m = _TOKEN.search(html, at)
        if m is None:
            add(html[at:])
            break
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag, closing = tag.lower(), m[2] == "/"
        if tag in SILENT and not closing:
            if tag in ("script", "style", "textarea", "title", "iframe", "noscript"):  # their text isn't markup
                shut = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
                at = shut.end() if shut else n
            elif tag != "head" and not m[4].rstrip().endswith("/"):
                end()
                stack.append((tag, kind, path, muted))
                kind = -1
            continue
        if tag == "a":
            links = max(0, links + (-1 if closing else 1))
        if tag in BLOCKS:
            end()
        elif tag == "br":
            add(" ")
            continue
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if tag not in BLOCKS and stack[i][1] != kind:
                        end()
                    close(i)
                    break
            continue
        if tag in BLOCKS:
            implied(*_OPEN_P)
            if tag in ENDS:
                implied(*ENDS[tag])
        if tag in VOID or m[4].endswith("/"):
            continue
        marks = _marks(m[4])
        inside, mute = kind, muted
        if kind != -1:
            if _is_frame(tag, marks, kind == 1):
                if tag in INLINE:  # its words go, the line around it goes on
                    mute += 1
                else:
                    inside = -1
            elif tag in CONTENT:
                inside = 1
        if tag in BLOCKS or inside != kind or mute != muted or any(e[0] == tag for e in stack):
            if tag not in BLOCKS and inside != kind:
                end()
            stack.append((tag, kind, path, muted))
            kind, muted = inside, mute
            if tag in BLOCKS:
                named = " ".join(v for name, v in marks if name in ("class", "role"))
                path = f"{path}/{tag}.{named}" if named else f"{path}/{tag}"
    end()
    return out


#: Bits of the rows that one alignment keeps; longer pages are halved first.
KEPT_BITS = 1 << 27


def _advance(a: list[int], b: list[int]) -> list[int]:
    """Row by row of ``a``: a number whose bit j is 0 where line j of ``b`` makes a longest common
    subsequence of what is before it longer by one."""
    full, at = (1 << len(b)) - 1, {}
    for j, x in enumerate(b):
        at[x] = at.get(x, 0) | 1 << j
    row, rows = full, [full]
    for x in a:
        hit = row & at.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
        rows.append(row)
    return rows


def _lengths(a: list[int], b: list[int]) -> list[int]:
    """Length of a longest common subsequence of ``a`` and each prefix of ``b``."""
    full, at = (1 << len(b)) - 1, {}
    for j, x in enumerate(b):
        at[x] = at.get(x, 0) | 1 << j
    row = full
    for x in a:
        hit = row & at.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    out = [0]
    for bit in reversed(f"{row:0{len(b)}b}" if b else ""):
        out.append(out[-1] + (bit == "0"))
    return out


def _aligned(a: list[int], b: list[int]) -> Iterator[int]:
    """Places of ``a`` in a longest common subsequence with ``b``: bit-parallel rows are walked back where
    they fit in KEPT_BITS; else ``a`` is halved and ``b`` cut where both halves' lengths sum highest."""
    if not a or not b:
        return
    if len(a) > 1 and len(a) * len(b) > KEPT_BITS:
        h = len(a) // 2
        before, after = _lengths(a[:h], b), _lengths(a[h:][::-1], b[::-1])
        cut = max(range(len(b) + 1), key=lambda j: before[j] + after[len(b) - j])
        yield from _aligned(a[:h], b[:cut])
        yield from (h + i for i in _aligned(a[h:], b[cut:]))
        return
    rows = _advance(a, b)
    i, j = len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            yield i
        elif rows[i] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1


def shared(a: list[str], b: list[str]) -> set[int]:
    """Places of ``a`` in a longest common subsequence with ``b``. Lines that the other page doesn't have
    are left out first, and so are equal starts and ends, which belong to some longest one."""
    both = {x: n for n, x in enumerate(set(a) & set(b))}
    where = [i for i, x in enumerate(a) if x in both]
    x, y = [both[a[i]] for i in where], [both[t] for t in b if t in both]
    head = 0
    while head < min(len(x), len(y)) and x[head] == y[head]:
        head += 1
    tail = 0
    while tail < min(len(x), len(y)) - head and x[-1 - tail] == y[-1 - tail]:
        tail += 1
    middle = _aligned(x[head : len(x) - tail], y[head : len(y) - tail])
    return {where[i] for i in [*range(head), *range(len(x) - tail, len(x)), *(head + i for i in middle)]}


def deleted(page: tuple[list, list[int], list[int]], neighbours: list[tuple[list, list[int], list[int]]]) -> list[int]:
    """Places of the lines that differencing deletes. A page: its lines' keys, kinds and lengths.

    Outside of content that is what a neighbour shares. In content it is what the neighbours on both sides have at
    the same place, counted from its start or from its end, unless one with half of the content is a version of the page."""
    keys, kinds, sizes = page
    near = [shared(keys, other[0]) for other in neighbours]
    out = {i for both in near for i in both if kinds[i] != 1}
    places = [i for i, k in enumerate(kinds) if k == 1]
    size = sum(sizes[i] for i in places)
    if len(near) == 2 and not any(2 * sum(sizes[i] for i in places if i in both) > size for both in near):
        content = [[t for t, k in zip(other[0], other[1]) if k == 1] for other in neighbours]
        for n, i in enumerate(places):
            at = (n, n - len(places))
            if all(i in both for both in near) and any(all(-len(c) <= j < len(c) and c[j] == keys[i] for c in content) for j in at):
                out.add(i)
    return sorted(out)


def candidates(page: list[tuple[str, int, str]]) -> list[str]:
    """The lines that no frame element holds: what differencing leaves of the others goes too."""
    return [line for line, kind, _ in page if kind != -1]


def main_text(page: list[str], gone: list[int]) -> str:
    """The candidates less those that differencing deletes (by their places among the candidates)."""
    dropped = set(gone)
    return "\n\n".join([line for i, line in enumerate(page) if i not in dropped] if dropped else page)


def places(gone: list[int], kinds: list[int]) -> list[int]:
    """Of a page's deleted lines those that are candidates, by their places among these."""
    rank = {i: n for n, i in enumerate(i for i, k in enumerate(kinds) if k != -1)}
    return [rank[i] for i in gone if i in rank]


def measured(page: list[tuple[str, int, str]]) -> tuple[list[int], list[int], list[int]]:
    """Keys as signed 64-bit hashes, kinds and lengths of a page's lines."""
    keys = [xxhash.xxh3_64_intdigest(k.encode("utf-8", "replace")) for *_, k in page]
    return [k - (1 << 64) if k >> 63 else k for k in keys], [k for _, k, _ in page], [len(t) for t, *_ in page]


OUT = "page_id long, url string, text string, n_chars long"
LINES = "hk binary, host string, path string, page_id long, same binary, keys array<long>, kinds array<int>, sizes array<int>"
_ARROW = {"binary": pa.binary(), "string": pa.string(), "long": pa.int64(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[kind]) for c, (_, kind) in zip(zip(*rows), fields)], [name for name, _ in fields])


def page_lines(rows: DataFrame) -> DataFrame:
    """LINES of every page (hk, host, path, page_id, html); same: a digest of host and lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for hk, host, path, page, source in zip(*(c.to_pylist() for c in b.columns)):
                keys, kinds, sizes = measured(lines(source))
                same = blake2b(repr((host, keys, kinds, sizes)).encode("utf-8", "replace"), digest_size=16).digest()
                out.append((hk, host, path, page, same, keys, kinds, sizes))
            if out:
                yield _batch(out, LINES)

    return rows.select("hk", "host", "path", "page_id", "html").mapInArrow(run, LINES)


def differenced(contents: DataFrame) -> DataFrame:
    """(same, gone: places among the candidates) of each content (k: host, path and id by which they are ordered; host,
    same, keys, kinds, sizes)."""
    n, parts = range_count(contents, F.size("keys") * 16 + 64)
    ordered = deal_ranges(contents, n, parts, (("first", -1), ("last", 1))).sortWithinPartitions("k")
    schema = "same binary, gone array<int>"

    def put(held: tuple, *beside: tuple | None) -> tuple:
        near = [x[3] for x in beside if x is not None and x[0] == held[0]]
        return held[1], places(deleted(held[3], near), held[3][1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        earlier = held = None  # (host, same, own, page)
        for b in batches:
            out: list[tuple] = []
            for host, same, own, *page in zip(*(c.to_pylist() for c in b.columns)):
                now = (host, same, own, tuple(page))
                if held is not None and held[2]:
                    out.append(put(held, earlier, now))
                earlier, held = held, now
            if out:
                yield _batch(out, schema)
        if held is not None and held[2]:
            yield _batch([put(held, earlier, None)], schema)

    return ordered.select("host", "same", "own", "keys", "kinds", "sizes").mapInArrow(run, schema)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    spark = pages.sparkSession
    bounded_batches(spark, 250)
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    path = F.coalesce(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.lit(""))
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(html, F.lit("")).alias("html"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("hk", F.unhex(F.substring(F.sha2(F.concat_ws(":", F.octet_length("host").cast("string"), "host", "html"), 256), 1, 32)))

    read = materialize(page_lines(rows), "page-lines")
    first = F.min(F.struct("path", F.col("page_id").isNotNull().alias("has"), F.coalesce("page_id", F.lit(0)).alias("id")))
    contents = read.groupBy("same").agg(F.first("host").alias("host"), first.alias("f"), F.first(F.struct("keys", "kinds", "sizes")).alias("p"), F.count("*").alias("n"))
    k = F.struct("host", "f.path", "f.has", "f.id", F.hex("same").alias("same"))
    contents = materialize(contents.select(k.alias("k"), "host", "same", "p.keys", "p.kinds", "p.sizes", "n"), "page-contents")
    total = contents.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    gone = differenced(contents).join(contents.select("same", "n"), "same")
    by_html = read.groupBy("hk").agg(F.first("same").alias("same"), F.count("*").alias("pages"))
    by_html = join_groups(by_html, gone, "same", "n", total).select("hk", "pages", "gone")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for b in batches:
            # a line holds no line end, as its white space is single spaces
            packed = [squeeze.compress("\n".join(candidates(lines(x))).encode("utf-8", "surrogatepass")) for x in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(packed, pa.binary())], ["page_id", "url", "hk", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for page, address, packed, dropped in zip(*(c.to_pylist() for c in b.columns)):
                whole = zstandard.ZstdDecompressor().decompress(packed).decode("utf-8", "surrogatepass")
                text = main_text(whole.split("\n") if whole else [], dropped or [])
                out.append((page, address, text, len(text)))
            if out:
                yield _batch(out, OUT)

    packed = rows.select("page_id", "url", "hk", "html").mapInArrow(pack, "page_id long, url string, hk binary, packed binary")
    joined = join_groups(packed, by_html, "hk", "pages", total)
    return joined.select("page_id", "url", "packed", "gone").mapInArrow(run, OUT)
