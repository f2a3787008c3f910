"""Main text of web pages: element roles, and a suffix array per host over the blocks of all pages.

Markup that names menus, headers, footers, sidebars, notices, adverts, forms or comments drops its text; what only may name them,
in a section of an article, is left to the array. The other blocks of all pages go to their host's suffix array: the word streams of a host's pages are concatenated, and substrings that are long
and stand on several distinct pages of the host are removed; unique runs stay. Roles have the last word: a paragraph, heading
or quotation of a declared article stays whatever repeats it, and where a page declares an article, text outside it goes.

A host is dealt into shards, and each shard has a suffix array of its own. Runs are added up over the host in two steps, so
that little is shuffled: short residues of their hashes, with the pages that they stand on in the shard, tell which can be
repeated at all, and whole hashes are sent for these only. The result is the same for any number of shards.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, cut, mix, utf8, word_hashes, words
from .graph import loose

RAW = frozenset("script style title textarea template svg annotation annotation-xml iframe noscript select button object canvas audio video".split())
TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
STOP = re.compile("[\"'<>]")
ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
CONTAINERS = frozenset("div section article main nav header footer aside form ul ol dl table figure dialog details menu fieldset".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li tr td th blockquote pre figcaption dt dd br hr address summary body html head tbody thead caption center option legend label".split())
VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
DROPPED_TAGS = frozenset("nav footer aside form dialog menu".split())
#: Words of class, id and role that mark what is not the article (fixed values).
DROPPED_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar footer contentinfo sidebar aside complementary widget widgets ad ads adv advert adverts advertisement "
    "advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert newsletter subscribe signup login search share sharing social related recommended "
    "recommendations comment comments commentlist commentform commentbox reply replies respond disqus discussion popup modal overlay toolbar pagination pager copyright skip".split()
)
#: Of these, words that an article's own sections use too, and those that tell that they do not.
WEAK_WORDS = frozenset("related discussion notice notices alert banner header search social reply respond skip copyright promotion complementary widget menu".split())
TELLING = frozenset("post posts article articles story stories link links news reading content list box block item items more comment comments thread forum widget".split())
#: Words that a section of an article may have as its name; as an id they don't tell that it isn't the article.
NAMES = WEAK_WORDS | frozenset("ad ads adv advert adverts advertisement advertising sponsor promo cookie cookies consent gdpr share sharing social subscribe signup login newsletter toolbar overlay modal popup skip".split())
#: Foreign elements that may end themselves.
FOREIGN = frozenset("svg math".split())
#: Elements of prose: in an article, their text is the article's.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption".split())
ROLES = ("main", "loose", "plain")
#: A run of RUN words is repeated if it stands on LEAST distinct pages of its host, whatever the host's size.
PAGES_OF_SHARD, RUN, LEAST = 400, 8, 3
#: Shards whose runs one part of a host's runs has on average, bits of a residue, and large hosts that are broadcast at most.
SHARDS_OF_PART, RESIDUE_BITS, BROADCAST_HOSTS = 16, 25, 200_000


def tags(html: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, whether it ends an element, attributes) of a page's markup; comments and the like have no name.

    An element of RAW is one tag with all that it holds. Every character is looked at a fixed number of times: a search that
    fails is not made again. A < that begins no markup, or has no > after it, is text.
    """
    at, last = 0, {c: html.rfind(c) for c in "\"'>"}
    while (start := html.find("<", at)) >= 0:
        if html.startswith("<!--", start):
            end = html.find("-->", start + 4)
            at = len(html) if end < 0 else end + 3
            yield start, at, "", False, ""
            continue
        if start > last[">"]:
            return
        m = TAG.match(html, start + 1)
        if not m:
            at = start + 1
            if html[at : at + 1] in ("!", "?", "/"):
                at = html.find(">", at) + 1
                yield start, at, "", False, ""
            continue
        end = m.end()
        while stop := STOP.search(html, end):  # quotes may hold >
            c = stop[0]
            if c in "<>" or last[c] == stop.start():
                break
            end = html.find(c, stop.end()) + 1
        end = stop.start() if stop and stop[0] == ">" else html.find(">", m.end())
        name, ends, at = m[2].lower(), bool(m[1]), end + 1
        if name in FOREIGN and html[m.end() : end].rstrip().endswith("/"):
            name = ""
        elif name in RAW and not ends:
            close = re.compile(rf"</{name}\s*>", re.I).search(html, at)
            at = close.end() if close else len(html)
            name = ""
        yield start, at, name, ends, html[m.end() : end]


def _verdict(tag: str, marks: set[str], ids: set[str], within: bool) -> str:
    """What words of class and role, and of id, say of an element: drop, doubt or nothing.

    Within an article an id is a name first: it tells only if all its words mark and none of them could name a section. Weak words
    need others that tell, and a section of the article that has nothing but them, or a doubtful id, is left to the suffix array.
    """
    if not within:
        return "drop" if (marks | ids) & DROPPED_WORDS else ""
    ids = set() if tag in PROSE else ids - {""}
    found = marks & DROPPED_WORDS
    if found and not found <= WEAK_WORDS or ids and ids <= DROPPED_WORDS - NAMES:
        return "drop"
    if found - {"header"}:
        if marks & TELLING:
            return "drop"
        if marks <= DROPPED_WORDS - {"discussion", "header"}:
            return "doubt" if tag == "section" else "drop"
    return "doubt" if ids & DROPPED_WORDS else ""


def blocks(html: str) -> list[tuple[str, str]]:
    """(role, text) of a page's non-empty text blocks outside dropped elements, in page order.

    The role is main for prose of a declared article, loose for its other text and for all text of its doubtful sections, and
    plain for text outside one.
    """
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, str, bool]] = []  # tag, state, whether only markup of its own kind can end it
    state, held, at, prose = "plain", [], 0, False

    def flush() -> None:
        text = " ".join(unescape("".join(held)).split())
        if text:
            out.append(("loose" if state == "doubt" or (state == "main" and not prose) else state, text))
        held.clear()

    open_tags: dict[str, int] = {}

    def pop() -> str:
        tag = stack.pop()[0]
        open_tags[tag] -= 1
        return tag

    for start, end, tag, ends, attributes in tags(html):
        if state != "drop" and start > at:
            held.append(html[at:start])
        at = end
        if not tag:
            continue
        if tag in BLOCKS:
            flush()
            prose = tag in PROSE and not ends if tag not in VOID else prose and tag == "br"
        if ends:
            if open_tags.get(tag):
                if tag not in CONTAINERS:  # a soft element ends within its container only
                    inner = next(k for k in range(len(stack), 0, -1) if stack[k - 1][0] == tag or stack[k - 1][0] in CONTAINERS)
                    if stack[inner - 1][0] != tag:
                        continue
                while pop() != tag:
                    pass
                state = stack[-1][1] if stack else "plain"
            continue
        if tag in BLOCKS and stack and stack[-1][0] == "p":
            pop()
            state = stack[-1][1] if stack else "plain"
        marks, ids, named_main = set(), set(), tag in ("article", "main")
        if "=" in attributes:
            for name, *values in ATTRIBUTE.findall(attributes):
                value = "".join(values)
                named_main |= (name.lower() == "role" and value == "main") or (name.lower() == "itemprop" and value == "articleBody")
                if name.lower() != "aria-label":
                    these = set(re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower()))
                    if name.lower() == "id":
                        ids |= these
                    else:
                        marks |= these
        inside = state in ("main", "doubt")
        verdict = _verdict(tag, marks, ids, inside) if tag not in ("body", "html") else ""
        hard = tag in DROPPED_TAGS or (tag == "header" and not inside)
        if named_main:
            within = state == "drop" and any(s == "drop" and h for _, s, h in stack)
            said = marks | (ids if not inside or ids <= DROPPED_WORDS - NAMES else set())
            new = "drop" if within or said & {"comment", "comments", "related", "reply", "replies", "sponsored", "ad", "ads", "promo"} else "main"
        elif hard or verdict == "drop":
            new = "drop"
        elif verdict == "doubt" and state != "drop":
            new = "doubt"
        else:
            new = state
        if tag not in VOID and (tag in CONTAINERS or new != state):
            stack.append((tag, new, hard))
            open_tags[tag] = open_tags.get(tag, 0) + 1
            state = new
    if state != "drop":
        held.append(html[at:])
    flush()
    return out


def joined(found: list[tuple[str, str]]) -> str:
    main = [text for role, text in found if role != "plain"]
    return "\n".join(main or [text for _, text in found])


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (page_id, url, host, shard, shards, html): the page's blocks and the numbers of their roles in place of html."""
    for batch in batches:
        found = [blocks(h or "") for h in batch.column(5).to_pylist()]
        roles = pa.array([[ROLES.index(role) for role, _ in f] for f in found], pa.list_(pa.int8()))
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], roles, pa.array([[text for _, text in f] for f in found], pa.list_(pa.string()))], ["page_id", "url", "host", "shard", "shards", "roles", "blocks"])


def suffix_array(stream: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of their suffixes, and which share their first `run` words with the one before, by prefix doubling.

    `run` is a power of two. Suffixes that agree in as many words may stand in any order: all repeated substrings of `run` or
    more words are unions of their runs, so that longer common prefixes need not be told apart.
    """
    n = len(stream)
    rank, width = np.unique(stream, return_inverse=True)[1].astype(np.int64), 1
    while True:
        key = rank * (n + 1)
        key[: n - width] += rank[width:] + 1 if width < n else 0
        order = np.argsort(key, kind="stable")
        fresh = np.diff(key[order], prepend=-1) != 0
        width *= 2
        if width >= run:
            return order, ~fresh
        rank[order] = np.cumsum(fresh) - 1


def runs_and_pages(stream: np.ndarray, page: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """By place the number of its run, and by run on how many distinct pages it stands: groups of neighbours in the suffix array."""
    order, same = suffix_array(stream, run)
    group = np.cumsum(~same) - 1
    number = np.empty(len(stream), np.int64)
    number[order] = group
    pairs = np.unique(number * (page.max() + 1) + page)
    return number, np.bincount(pairs // (page.max() + 1), minlength=group[-1] + 1)


def covered(often: np.ndarray, run: int) -> np.ndarray:
    """Which words lie in a run that begins where `often` is true."""
    n = len(often)
    step = np.zeros(n + run + 1, np.int64)
    at = np.flatnonzero(often)
    step[:n] += often
    step[at + run] -= 1
    return np.cumsum(step)[:n] > 0


def repeated(stream: np.ndarray, page: np.ndarray, run: int, least: int) -> np.ndarray:
    """Which words lie in a substring of at least `run` words that stands on at least `least` distinct pages.

    Page ends are symbols that occur once.
    """
    number, pages = runs_and_pages(stream, page, run)
    return covered(pages[number] >= least, run)


class Streams:
    """The word streams of pages, in one: words' hashes, 0 between blocks, an even symbol of its own at each page's end."""

    def __init__(self, blocks: pa.ListArray, names: list | None = None):
        blocks = blocks.combine_chunks() if isinstance(blocks, pa.ChunkedArray) else blocks
        per_page = np.diff(blocks.offsets.to_numpy()).astype(np.int64)
        data, offs = utf8(blocks.flatten())
        s, e, self.first = words(data, offs, np.arange(256) != 32)
        self.hashes = word_hashes(data, s, e) | U64(1)
        self.block_bounds = np.concatenate([[0], np.cumsum(per_page)])
        block = np.repeat(np.arange(len(offs) - 1), np.diff(self.first))  # of each word
        page = np.repeat(np.arange(len(per_page)), per_page)  # of each block
        lengths = np.diff(self.first[self.block_bounds]) + per_page + 1
        self.word = np.full(lengths.sum(), -1)
        self.stream = np.zeros(len(self.word), U64)
        at = np.arange(len(s)) + block + page[block] if len(s) else np.zeros(0, np.int64)
        self.word[at], self.stream[at] = np.arange(len(s)), self.hashes
        self.stream[np.cumsum(lengths) - 1] = np.arange(len(per_page), dtype=U64) * U64(2) + U64(2)  # even: no word's hash
        number: dict = {}  # rows of one name are one page
        self.page = np.repeat(np.array([number.setdefault(x, len(number)) for x in names] if names else np.arange(len(per_page)), np.int64), lengths)

    def keys(self, at: np.ndarray, run: int, host: int) -> np.ndarray:
        """A 64-bit hash of the runs that begin at the places `at`, and of the host; it is the same in each shard."""
        key = np.full(len(at), host & (2**64 - 1), U64)
        for k in range(run):
            key = mix(key * U64(0xD6E8FEB86659FD93) + self.stream[at + k])
        return key

    def whole(self, run: int) -> np.ndarray:
        """The places where a run of `run` words begins that stays on its page."""
        ends = np.concatenate([[0], np.cumsum((self.stream % U64(2) == 0) & (self.stream > 0))])
        at = np.arange(max(0, len(self.stream) - run + 1))
        return at[ends[at + run] == ends[at]]


def shard_runs(text: Streams, host: int, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a shard's distinct runs, and on how many of its pages each stands."""
    at = text.whole(run)
    if not len(at):
        return np.zeros(0, U64), np.zeros(0, np.int64)
    number, pages = runs_and_pages(text.stream, text.page, run)
    own, first = np.unique(number[at], return_index=True)
    return text.keys(at[first], run, host), pages[own]


def unique_runs(blocks: pa.ListArray, run: int = RUN, least: int = LEAST, roles: list[list[int]] | None = None, names: list | None = None, known: tuple[int, np.ndarray] | None = None) -> list[str]:
    """Each page's text without what its host repeats in runs of `run` words and breaks, on at least `least` pages.

    Whole blocks go where such runs cover them; of other blocks only covered runs of `run` words. By `roles`, prose of an
    article stays, and text outside the article where there is one goes. Rows of one name count as one page. Where the pages
    are one shard of several, `known` gives the host and the keys of all its repeated runs.
    """
    text = Streams(blocks, names)
    if known is None:
        off = repeated(text.stream, text.page, run, least) if len(text.stream) else np.zeros(0, bool)
    else:
        at, often = text.whole(run), np.zeros(len(text.stream), bool)
        often[at] = np.isin(text.keys(at, run, known[0]), known[1])
        off = covered(often, run)
    gone = np.zeros(len(text.hashes), bool)
    gone[text.word[off & (text.word >= 0)]] = True
    before = np.concatenate([[0], np.cumsum(gone)])
    n_off, n = np.diff(before[text.first]), np.diff(text.first)
    out = []
    for k, page in enumerate(blocks.to_pylist()):
        role, kept = [ROLES[r] for r in roles[k]] if roles else ["plain"] * len(page), []
        article = any(r != "plain" for r in role)
        for i, (b, r) in enumerate(zip(page, role, strict=True), int(text.block_bounds[k])):
            if r == "main" or (not n_off[i] and not (r == "plain" and article)):
                kept.append(b)
            elif n_off[i] < n[i] and not (r == "plain" and article):  # what a run across a break covers goes with whole blocks only
                off = gone[text.first[i] : text.first[i + 1]].copy()
                edge = np.flatnonzero(np.diff(np.concatenate([[0], off.view(np.int8), [0]])))
                for x, y in zip(edge[::2], edge[1::2], strict=True):
                    off[x:y] = y - x >= run
                kept.append(" ".join(w for w, g in zip(b.split(" "), off, strict=True) if not g))
        out.append("\n".join(kept))
    return out


def _names(table: pa.Table) -> list:
    return list(zip(table["page_id"].to_pylist(), table["url"].to_pylist(), strict=True))


def _zipped(x: np.ndarray) -> bytes:
    """Numbers as planes of bytes, compressed; sorted numbers are best given as differences."""
    planes = x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(planes, asbytes=True)


def _unzipped(x: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(pa.Codec("zstd").decompress(x[8:], int.from_bytes(x[:8], "little"), asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _steps(x: np.ndarray) -> bytes:
    return _zipped(np.diff(x, prepend=0).astype(np.uint32))


def _sums(x: bytes) -> np.ndarray:
    return np.cumsum(_unzipped(x, np.uint32), dtype=np.int64)


def _parts(table: pa.Table) -> int:
    return -(-int(table["shards"][0].as_py()) // SHARDS_OF_PART)


def _dealt(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The part of each key, and its residue there."""
    return (keys >> U64(32)) % U64(parts), (keys & U64((1 << RESIDUE_BITS) - 1)).astype(np.int64)


def _residues(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """A shard's residues by part, and on how many of its pages their runs stand; none of a host that is one shard."""
    host, shard, rows = key[0].as_py(), key[1].as_py(), []
    if table["shards"][0].as_py() > 1:
        keys, n = shard_runs(Streams(table["blocks"], _names(table)), host)
        part, residue = _dealt(keys, _parts(table))
        for k in np.unique(part):
            own, at = np.unique(residue[part == k], return_inverse=True)
            pages = np.minimum(np.bincount(at, n[part == k]), LEAST).astype(np.uint8)
            rows.append((host, int(k), shard, _steps(own), _zipped(pages)))
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    return pa.table({n: pa.array(c, t) for n, c, t in zip(("host", "part", "shard", "residues", "ns"), columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)})


def _possible(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """From all shards' residues of one part: for each shard those of its residues that stand on enough pages of the host."""
    pages = np.zeros(1 << RESIDUE_BITS, np.uint8)
    shards = [_sums(x) for x in table["residues"].to_pylist()]
    for residue, n in zip(shards, table["ns"].to_pylist(), strict=True):
        pages[residue] = np.minimum(pages[residue] + _unzipped(n, np.uint8), LEAST)
    return pa.table({"host": table["host"], "shard": table["shard"], "part": table["part"], "residues": pa.array([_steps(x[pages[x] >= LEAST]) for x in shards], pa.binary())})


def _runs(key: tuple[pa.Scalar, ...], table: pa.Table, possible: pa.Table) -> pa.Table:
    """By part, keys of those runs of a shard whose residues are possible, and on how many of its pages they stand."""
    host, shard, rows = key[0].as_py(), key[1].as_py(), []
    wanted = {p: _sums(x) for p, x in zip(possible["part"].to_pylist(), possible["residues"].to_pylist(), strict=True)}
    if table.num_rows and any(map(len, wanted.values())):
        text = Streams(table["blocks"], _names(table))
        at = text.whole(RUN)
        keys = text.keys(at, RUN, host)
        part, residue = _dealt(keys, _parts(table))
        for p, some in wanted.items():
            mine = np.flatnonzero(part == p)
            mine = mine[np.isin(residue[mine], some)]
            own, which = np.unique(keys[mine], return_inverse=True)
            pairs = np.unique(which * (text.page.max() + 1) + text.page[at[mine]])
            rows.append((host, p, shard, _zipped(own), _zipped(np.minimum(np.bincount(pairs // (text.page.max() + 1), minlength=len(own)), LEAST).astype(np.uint8))))
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    return pa.table({n: pa.array(c, t) for n, c, t in zip(("host", "part", "shard", "keys", "ns"), columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)})


def _known(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """From all shards' runs of one part: for each shard those of its runs that stand on enough pages of the host."""
    keys = [_unzipped(x, U64) for x in table["keys"].to_pylist()]
    u, at = np.unique(np.concatenate(keys), return_inverse=True)
    pages = np.bincount(at, np.concatenate([_unzipped(x, np.uint8) for x in table["ns"].to_pylist()]), minlength=len(u))
    often = u[pages >= LEAST]
    return pa.table({"host": table["host"], "shard": table["shard"], "keys": pa.array([_zipped(np.intersect1d(k, often, True)) for k in keys], pa.binary())})


def _by_host(key: tuple[pa.Scalar, ...], table: pa.Table, known: pa.Table) -> pa.Table:
    if not table.num_rows:
        return pa.table({"page_id": table["page_id"], "url": table["url"], "text": pa.array([], pa.string())})
    keys = None if table["shards"][0].as_py() == 1 else (key[0].as_py(), np.concatenate([np.zeros(0, U64), *[_unzipped(x, U64) for x in known["keys"].to_pylist()]]))
    texts = unique_runs(table["blocks"], roles=table["roles"].to_pylist(), names=_names(table), known=keys)
    return pa.table({"page_id": table["page_id"], "url": table["url"], "text": pa.array(texts, pa.string())})


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: page_id, url, text and n_chars (code points).

    Null and empty pages have an empty text. A null or odd url is a host of its own name (empty). A host's pages are dealt
    into shards of a few hundred by a hash of their ids, so that it is no hot group; hosts of one shard have nothing to add
    up. Rows may repeat, and each gets its text; equal ids and urls are one page. Ids may be of any type; other columns are
    ignored; an empty table gives no rows. A page of any length is read whole, in time proportional to it.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.xxhash64(host_of(F.col(url_col))).alias("host"), F.col(html_col).alias("html"))
    id_type = rows.schema["page_id"].dataType.simpleString()
    large = cut(rows.groupBy("host").agg(F.count("*").alias("n")).filter(F.col("n") > PAGES_OF_SHARD).select("host", F.ceil(F.col("n") / PAGES_OF_SHARD).alias("shards")))
    few = large.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    dealt = rows.join(F.broadcast(large) if few else loose(large, "host"), "host", "left").withColumn("shards", F.coalesce("shards", F.lit(1)))
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("page_id", "url"), F.col("shards"))).select("page_id", "url", "host", "shard", "shards", "html")
    parsed = dealt.mapInArrow(_parsed, f"page_id {id_type}, url string, host long, shard long, shards long, roles array<tinyint>, blocks array<string>")
    shards = parsed.groupBy("host", "shard")
    residues = shards.applyInArrow(_residues, "host long, part long, shard long, residues binary, ns binary")
    possible = residues.groupBy("host", "part").applyInArrow(_possible, "host long, shard long, part long, residues binary")
    runs = shards.cogroup(possible.groupBy("host", "shard")).applyInArrow(_runs, "host long, part long, shard long, keys binary, ns binary")
    known = runs.groupBy("host", "part").applyInArrow(_known, "host long, shard long, keys binary")
    texts = shards.cogroup(known.groupBy("host", "shard")).applyInArrow(_by_host, f"page_id {id_type}, url string, text string")
    return texts.withColumn("n_chars", F.length("text").cast("long"))
