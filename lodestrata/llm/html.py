"""Main text of web pages by a host suffix array, with page structure where the array doesn't decide.

A page becomes a stream of text blocks. For each host the token streams of its pages are concatenated and their suffixes
sorted; substrings of LONG tokens or more that occur on two or more distinct pages are repeated runs. How far a run must be
spread before it goes depends on where it stands. Zones are: content (inside an article or main element), furniture (menus,
headers, footers, sidebars, adverts, forms, comments, what isn't shown) and open (neither).

Open: tokens that repeated runs cover go, and unique runs stay. Content: a sentence that an article shares with some other
article, or with an advert, is still its text; but a run of one or more whole sentences, each of LONG tokens or more, or a whole block of so
many, goes if it stands in the content of SHARE of the host's distinct pages, and of SHARED pages at least: it is the host's.
A page whose content would go altogether keeps it. Furniture goes by itself, as menus and adverts also change from page to
page. It is known by elements, roles and whole names of classes and ids, never by other attributes; inside of content only by
names that are one word of the list, so that no article goes because a part of some name looks like a menu's.

Tables don't gather a host's pages: windows of LONG tokens that hold open text, sentences and blocks are hashed, Spark counts
the distinct pages of a host that have each, and what is found is joined back to the pages that have it. This finds what the suffix array
over the whole host would, for hosts of any size.
"""

from __future__ import annotations

import functools
import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Bloom, bounded, mix64, numbered, parted, stored, text_slices

#: Tokens of a long run; distinct pages of a host, and their part of all, that have a sentence of content which is the host's own.
LONG, SHARED, SHARE = 8, 10, 0.5

# Names of elements, and words in class, id and role that mark furniture.
UNSEEN = frozenset("head title script style noscript template svg canvas iframe object".split())
FURNITURE = frozenset("nav footer aside form button select menu dialog".split())
CONTENT = frozenset("article main".split())
RAW = frozenset("script style textarea title noscript iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
MARKS = frozenset("ad ads advert advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer footer header login masthead menu modal nav navbar navigation newsletter notice pagination popup promo related share sharing sidebar skip social sponsor sponsored subscribe toolbar widget".split())
NEUTRAL = frozenset("area bar block body bottom box button buttons bt col column container content div end fixed form group head holder inner item items layout left link links list main menu outer page panel position row section site slot space text title top right unit wrap wrapper zone".split())
MARKED_ROLES = frozenset("banner navigation complementary contentinfo search form menu menubar dialog alert".split())

_MARKUP = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PARTS = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])|(?<=[A-Za-z])(?=[0-9])")
_ENDS_SENTENCE = re.compile(r"[.!?]['\")\]»”]*$").search

CONTENT_ZONE, OPEN_ZONE, FURNITURE_ZONE = 0, 1, 2


@functools.lru_cache(4096)
def _marked(name: str, within: int) -> bool:
    """Whether a class or id is a name of furniture: one word of MARKS, or outside of content several, besides neutral ones.

    Numbers don't count: sidebar-2 and ad_17 are names, ad-free, has-sidebar and share-price aren't.
    """
    parts = [p.lower() for p in _PARTS.split(name) if p and not p.isdigit()]
    if len(parts) == 1 or within == CONTENT_ZONE:
        return len(parts) == 1 and parts[0] in MARKS
    return any(p in MARKS for p in parts) and all(p in MARKS or p in NEUTRAL for p in parts)


def _zone(name: str, attributes: str, above: int) -> int:
    """The zone inside an element, from its name, its attributes and the zone around it."""
    if above == FURNITURE_ZONE or name in UNSEEN or name in FURNITURE or (name == "header" and above != CONTENT_ZONE):
        return FURNITURE_ZONE
    zone = CONTENT_ZONE if name in CONTENT else above
    for kind, *values in _ATTRIBUTE.findall(attributes) if attributes else ():
        kind, names = kind.lower(), "".join(values).split()
        if kind == "role":
            if MARKED_ROLES.intersection(n.lower() for n in names):
                return FURNITURE_ZONE
            if "main" in (n.lower() for n in names):
                zone = CONTENT_ZONE
        elif kind in ("class", "id") and name not in ("html", "body") and any(_marked(n, zone) for n in names):
            return FURNITURE_ZONE
    return zone


def blocks(page: str | None) -> list[tuple[int, str]]:
    """A page's blocks in order as (zone, text): references decoded, white space made one space, empty blocks left out."""
    out: list[tuple[int, str]] = []
    text: list[str] = []
    stack: list[tuple[str, int]] = []
    zone, at, page = OPEN_ZONE, 0, page or ""

    def close() -> None:
        if text:
            words = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if words:
                out.append((zone, words))

    while m := _MARKUP.search(page, at):
        text.append(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name == "br":
            text.append(" ")
        elif name in INLINE and not (m[3] and _zone("span", m[3], zone) != zone):
            if m[1]:
                # an inline element that was kept on the stack for its mark
                if stack and stack[-1][0] == name:
                    close()
                    stack.pop()
                    zone = stack[-1][1] if stack else OPEN_ZONE
        elif m[1]:
            close()
            if any(n == name for n, _ in stack):
                while stack.pop()[0] != name:
                    pass
                zone = stack[-1][1] if stack else OPEN_ZONE
        else:
            close()
            if name in RAW:
                end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            elif name in ("p", "li", "td", "th", "tr", "dt", "dd", "option", "hr") and not (m[3] and _zone(name, m[3], zone) != zone):
                pass  # their ends may be left out; they only part blocks
            elif name not in VOID and not m[3].endswith("/"):
                zone = _zone(name, m[3], zone)
                stack.append((name, zone))
    text.append(page[at:])
    close()
    return out


def repeated(streams: list[np.ndarray], long: int = LONG) -> list[np.ndarray]:
    """For token streams of distinct pages: which tokens lie in a substring of `long` or more tokens that another page has too.

    The suffixes of the concatenated streams are sorted by doubling until the order holds for `long` tokens; neighbours that
    agree so far and come from different pages mark their windows.
    """
    sizes = [len(s) for s in streams]
    n = sum(sizes) + len(streams)
    token, page = np.empty(n, np.int64), np.repeat(np.arange(len(streams)), [s + 1 for s in sizes])
    at = 0
    for k, s in enumerate(streams):
        token[at : at + len(s)] = s + len(streams)
        token[at + len(s)] = k  # an end of its own, so that no window spans two pages
        at += len(s) + 1
    _, rank = np.unique(token, return_inverse=True)
    have = 1
    while have < long:
        step = min(have, long - have)
        later = np.zeros(n, np.int64)
        later[: n - step] = rank[step:] + 1
        _, rank = np.unique(rank.astype(np.int64) * (n + 1) + later, return_inverse=True)
        have += step
    order = np.argsort(rank, kind="stable")
    ranks, pages = rank[order], page[order]
    starts = np.flatnonzero(np.concatenate(([True], ranks[1:] != ranks[:-1])))
    several = np.minimum.reduceat(pages, starts) != np.maximum.reduceat(pages, starts)
    marked = np.zeros(n + 1, np.int64)
    marked[:n] = several[np.repeat(np.arange(len(starts)), np.diff(np.concatenate((starts, [n]))))][np.argsort(order, kind="stable")]
    count = np.cumsum(marked[:n])
    before = np.concatenate((np.zeros(long, np.int64), count))[:n]
    covered = count - before > 0
    ends = np.cumsum([s + 1 for s in sizes])
    return [covered[e - s - 1 : e - 1] for e, s in zip(ends.tolist(), sizes, strict=True)]


class Page:
    """A page's blocks, the tokens of each, and all tokens as one stream."""

    def __init__(self, page: str | None):
        self.blocks = blocks(page)
        self.words = [b.split(" ") for _, b in self.blocks]
        self.stream = [w for own in self.words for w in own]

    def digest(self) -> bytes:
        """What pages with equal tokens share."""
        return _digest(*self.stream)

    def open(self) -> np.ndarray:
        """Which tokens stand in open blocks."""
        return np.repeat(np.array([z == OPEN_ZONE for z, _ in self.blocks], bool), [len(own) for own in self.words])

    def units(self, host: str, long: int) -> list[tuple[int, int, int, bytes]]:
        """Blocks of content of `long` tokens or more, and sentences of so many in them: block, start and end in it, digest."""
        out = []
        for k, ((zone, text), own) in enumerate(zip(self.blocks, self.words, strict=True)):
            if zone != CONTENT_ZONE or len(own) < long:
                continue
            out.append((k, 0, len(own), _digest("b", host, text)[:12]))
            start = 0
            for i, w in enumerate(own):
                if i == len(own) - 1 or _ENDS_SENTENCE(w):
                    if i + 1 - start >= long and not (start == 0 and i == len(own) - 1):
                        out.append((k, start, i + 1, _digest("b", host, " ".join(own[start : i + 1]))[:12]))
                    start = i + 1
        return out

    def text(self, covered: np.ndarray, gone: list[tuple[int, int, int]]) -> tuple[str, int]:
        """The main text and how many tokens are taken from it: covered ones of open blocks, and the parts of content in `gone`."""
        cut: dict[int, np.ndarray] = {}
        for k, start, end in gone:
            cut.setdefault(k, np.zeros(len(self.words[k]), bool))[start:end] = True
        if all(k in cut and cut[k].all() for k, (zone, _) in enumerate(self.blocks) if zone == CONTENT_ZONE):
            cut = {}
        kept, at, taken = [], 0, 0
        for k, ((zone, text), own) in enumerate(zip(self.blocks, self.words, strict=True)):
            if zone != FURNITURE_ZONE:
                away = covered[at : at + len(own)] if zone == OPEN_ZONE else cut.get(k)
                if away is None or not away.any():
                    kept.append(text)
                else:
                    rest = [w for w, c in zip(own, away.tolist(), strict=True) if not c]
                    taken += len(own) - len(rest)
                    if rest:
                        kept.append(" ".join(rest))
            at += len(own)
        return "\n".join(kept), taken


def main_texts(pages: list[str | None], long: int = LONG) -> list[tuple[str, int]]:
    """The main texts of one host's pages, by its suffix array in memory, and how many tokens runs take from each.

    Pages with equal tokens count as one.
    """
    parsed = [Page(p) for p in pages]
    ids: dict[str, int] = {}
    distinct = {p.digest(): p for p in parsed}
    streams = [np.fromiter((ids.setdefault(w, len(ids)) for w in p.stream), np.int64) for p in distinct.values()]
    covered = repeated(streams, long) if len(streams) > 1 else [np.zeros(len(s), bool) for s in streams]
    of = dict(zip(distinct, covered, strict=True))
    pages_with = Counter(key for p in distinct.values() for key in {key for *_, key in p.units("", long)})
    common = {key for key, n in pages_with.items() if n >= SHARED and n >= SHARE * len(distinct)}
    return [p.text(of[p.digest()], [unit for *unit, key in p.units("", long) if key in common]) for p in parsed]


def _digest(*parts: str) -> bytes:
    return hashlib.blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _short(digest: bytes) -> int:
    """A digest's first 8 bytes as a signed long, by which Bloom filters know it."""
    return int.from_bytes(digest[:8], "big", signed=True)


_SHORT = "cast(conv(hex(substring(key, 1, 8)), 16, -10) AS long)"


def _window(page: Page, host: str, at: int, long: int) -> bytes:
    return _digest("w", host, *page.stream[at : at + long])


def _hashes(page: Page, host: str, long: int, known: dict[str, int]) -> np.ndarray:
    """A hash of each window of `long` tokens of a host's page, as signed longs; `known` remembers tokens' hashes."""
    n = len(page.stream) - long + 1
    if n < 1:
        return np.empty(0, np.int64)
    for w in set(page.stream):
        if w not in known:
            known[w] = _short(_digest(w))
    token = np.fromiter((known[w] for w in page.stream), np.int64, len(page.stream)).view(np.uint64)
    out = np.full(n, _short(_digest("h", host)), np.int64).view(np.uint64)
    for k in range(long):
        out = out * np.uint64(0x9E3779B97F4A7C15) + token[k : k + n]
    return mix64(out).view(np.int64)


def _asking(page: Page, long: int) -> np.ndarray:
    """Starts of the windows that hold a token of an open block."""
    if len(page.stream) < long or all(z != OPEN_ZONE for z, _ in page.blocks):
        return np.empty(0, np.int64)
    count = np.concatenate(([0], np.cumsum(page.open())))
    return np.flatnonzero(count[long:] > count[:-long])


def host_of(url: Column) -> Column:
    """The host in a URL, in lower case; empty for null or none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def extract(df: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", long: int = LONG) -> DataFrame:
    """One row per input row: the id, url, text, n_chars (code points) and n_repeated (tokens that the host's repeated runs take).

    A null html counts as empty and gives an empty text. Pages without a host are taken as of one host. Pages of a host with
    equal tokens are one page to the search for repeats, whatever their ids and urls. Null and repeated ids stay as they are.
    Other columns are not read. An empty table gives an empty result. A page of any length is parsed whole, in one task.
    """
    rows, row = numbered(bounded(df).select(F.col(id_column).alias("id"), F.col(url_column).alias("url"), F.col(html_column).alias("html")))
    pages = rows.withColumn("host", host_of(F.col("url")))

    def parsed(part: pa.RecordBatch) -> Iterator[tuple[str, Page]]:
        for host, text in zip(part.column("host").to_pylist(), part.column("html").to_pylist(), strict=True):
            yield host, Page(text)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "html"):
            known: dict[str, int] = {}
            found = [np.empty(0, np.int64)]
            for host, page in parsed(part):
                at = _asking(page, long)
                if len(at):
                    found.append(_hashes(page, host, long, known)[at])
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(found)))], names=["hash"])

    asked = Bloom.of(stored(pages.select("host", "html").mapInArrow(ask, "hash long")), "hash")
    some_ask = bool(asked.words.any())
    # on a host of fewer pages no sentence of content can be common
    many = Bloom.of(stored(pages.groupBy("host").agg(F.count("*").alias("n")).filter(F.col("n") >= SHARED).select(F.xxhash64("host").alias("hash"))), "hash")

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "html"):
            known: dict[str, int] = {}
            out: set[tuple[str, bytes | None, bytes, bytes]] = set()
            for (host, page), large in zip(parsed(part), many.find(part.column("hash").to_numpy()).tolist(), strict=True):
                own, of = page.digest()[:8], _digest("host", host)
                if large:
                    out.add(("page", of, b"", own))
                    out.update(("unit", of, key, own) for *_, key in page.units(host, long))
                if some_ask:
                    out.update(("window", None, _window(page, host, i, long), own) for i in np.flatnonzero(asked.find(_hashes(page, host, long, known))).tolist())
            kinds = (pa.string(), pa.binary(), pa.binary(), pa.binary())
            columns = [*zip(*out)] if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=["kind", "host", "key", "page"])

    def answered(found: Bloom):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in text_slices(batches, "html"):
                keys, places = [], []
                for k, (host, page) in enumerate(parsed(part)):
                    got = {_window(page, host, i, long) for i in _asking(page, long).tolist()} | {key for *_, key in page.units(host, long)}
                    got = [key for key in got if _short(key) in found]
                    keys += got
                    places += [k] * len(got)
                yield pa.RecordBatch.from_arrays([part.column(row).take(pa.array(places, pa.int64())), pa.array(keys, pa.binary())], names=[row, "key"])

        return run

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "html"):
            out = []
            for (host, page), keys in zip(parsed(part), part.column("keys").to_pylist(), strict=True):
                there = frozenset(keys or ())
                covered = np.zeros(len(page.stream), bool)
                for i in _asking(page, long).tolist() if there else ():
                    if _window(page, host, i, long) in there:
                        covered[i : i + long] = True
                out.append(page.text(covered, [unit for *unit, key in page.units(host, long) if key in there] if there else []))
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("url"), pa.array([t for t, _ in out], pa.string()), pa.array([len(t) for t, _ in out], pa.int64()), pa.array([c for _, c in out], pa.int64())], names=["id", "url", "text", "n_chars", "n_repeated"])

    carried = pages.select("host", "html", F.xxhash64("host").alias("hash")).mapInArrow(carry, "kind string, host binary, key binary, page binary").distinct()
    n, kind = F.col("n"), F.col("kind")
    # pages of a key are told apart before they are counted, so that a key of all pages of a host is no burden to one task
    counts = stored(carried.groupBy("kind", "host", "key").agg(F.count("*").alias("n")).filter(((kind == "window") & (n > 1)) | (n >= SHARED)))
    sizes = counts.filter(kind == "page").select("host", n.alias("total"))
    common = counts.filter(kind == "unit").join(sizes, "host").filter(n >= SHARE * F.col("total")).select("key")
    several = stored(counts.filter(kind == "window").select("key").unionByName(common))
    found = Bloom.of(several.select(F.expr(_SHORT).alias("hash")), "hash")
    nothing = F.lit(None).cast("array<binary>").alias("keys")
    whole = pages
    if found.words.any():
        shape = f"{row} {pages.schema[row].dataType.simpleString()}, key binary"
        flags = stored(pages.select(row, "host", "html").mapInArrow(answered(found), shape).join(several, "key").groupBy(row).agg(F.collect_set("key").alias("keys")))
        # pages without any such run are not shuffled
        whole, flagged = parted(pages, flags.select(row), row)
        flagged = flagged.join(flags, row, "left").select("id", "url", "html", "host", "keys")
    whole = whole.select("id", "url", "html", "host", nothing)
    if found.words.any():
        whole = whole.unionByName(flagged)
    out = whole.mapInArrow(finish, f"id {df.schema[id_column].dataType.simpleString()}, url string, text string, n_chars long, n_repeated long")
    return out.withColumnsRenamed({"id": id_column, "url": url_column} if url_column != id_column else {})
