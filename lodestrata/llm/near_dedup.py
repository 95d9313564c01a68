"""Near-duplicate documents by ProbMinHash, banding and exact verification.

A document is a weighted set: its word shingles with their counts. Each shingle's arrivals are a Poisson process at the rate
of its weight; every arrival picks a register, which keeps the shingle that came first. A shingle is done as soon as its next
arrival is later than all registers' (early termination). Two documents agree in a register with the probability Jaccard
similarity of their weighted sets (for equal weights: the Jaccard similarity).

Documents with the same words are one vertex. Vertices that agree in all registers of a band share a bucket. First every
vertex is verified, exactly, against its buckets' least vertex, and links are joined to components; this settles large groups
of copies with one pair for each vertex and band. Buckets that still hold several components are then searched, block by
block, for any link between different components. So no link that banding finds is lost, and no group emits all its pairs.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bloom, bounded, mix64, numbered, stored, text_slices, without
from .components import components

WORDS, SIMILARITY = 5, 0.8
#: Registers of a signature at most, and the chance at most that banding misses two documents of the least similarity.
REGISTERS, MISSED = 125, 1e-4
#: Weight of a block: each of its vertices counts one, and one more for each so many shingles.
BLOCK, SHINGLES = 256, 512
REMEMBERED = 150_000
#: Component under which a bucket's small components are searched together.
REST = -1

_words = re.compile(r"\w+").findall
_known: dict[str, int] = {}


def _hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode())


def _words_and_key(text: str | None) -> tuple[list[str], bytes]:
    """A text's lower-case words in order, and the key of them."""
    words = _words(text.lower()) if text else []
    return words, hashlib.blake2b("\x1f".join(words).encode(), digest_size=16).digest()


def _shingles(words: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of n words in rising order, and their counts."""
    for w in set(words):
        if w not in _known:
            _known[w] = _hash(w)
    h = np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))
    k = min(n, len(h))
    if not k:
        return h, np.empty(0, np.int64)
    s = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        s = s * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(s)]
    return np.unique(mix64(s), return_counts=True)


def _forget() -> None:
    """Keep the words that a worker remembers bounded."""
    if len(_known) > REMEMBERED:
        _known.clear()


def weighted_shingles(texts: list[str | None], n: int = WORDS) -> list[tuple[bytes, np.ndarray, np.ndarray]]:
    """Each text's key (of its sequence of lower-case words), shingles in rising order, and their counts.

    A text of fewer than n words has one shingle of all of them; one without words has none.
    """
    _forget()
    return [(key, *_shingles(words, n)) for words, key in map(_words_and_key, texts)]


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], registers: int) -> np.ndarray:
    """ProbMinHash of weighted sets (elements, weights): a row of `registers` elements for each; an empty set's are 0."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(e) for e, _ in sets])
    element = np.concatenate([e for e, _ in sets]) if n else np.empty(0, np.uint64)
    weight = np.concatenate([w for _, w in sets]).astype(np.float64) if n else np.empty(0)
    first = np.full(n * registers, np.inf)
    winner = np.zeros(n * registers, np.uint64)
    time = np.zeros(len(element))
    arrival = 0
    while len(element):
        seed = mix64(np.array([2 * arrival + 1, 2 * arrival + 2], np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        uniform = ((mix64(element ^ seed[0]) >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53
        time -= np.log(uniform) / weight
        slot = owner * registers + (mix64(element ^ seed[1]) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(first, slot, time)
        won = first[slot] == time
        winner[slot[won]] = element[won]
        last = first.reshape(n, registers).max(1)
        on = time < last[owner]
        owner, element, weight, time = owner[on], element[on], weight[on], time[on]
        arrival += 1
    return winner.reshape(n, registers)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A signed long for each band of each signature; different bands have different keys."""
    part = signature.reshape(len(signature), bands, rows)
    key = np.broadcast_to(mix64(np.arange(1, bands + 1, dtype=np.uint64)), part.shape[:2]).copy()
    for i in range(rows):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + part[:, :, i])
    return key.view(np.int64)


def probability_jaccard(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """Exact: the sum, over common elements i, of 1 / sum over all j of max(x_j / x_i, y_j / y_i). Elements are sorted."""
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    if x.max() == 1 == y.max():
        return len(i) / (len(a) + len(b) - len(i))
    x, y = x.astype(np.float64), y.astype(np.float64)
    cx, cy = x[i], y[j]
    only_x, only_y = x.sum() - cx.sum(), y.sum() - cy.sum()
    ratios, which = np.unique(cy / cx, return_inverse=True)
    sums = np.array([only_x + only_y / r + np.maximum(cx, cy / r).sum() for r in ratios])
    return float((cx / sums[which]).sum())


def banding(least: float, registers: int = REGISTERS, missed: float = MISSED) -> tuple[int, int]:
    """Bands and rows of a band for a least similarity: the most rows with which two such documents are missed so seldom."""
    fits = [r for r in range(1, registers + 1) if (1 - least**r) ** (registers // r) <= missed]
    return registers // max(fits, default=1), max(fits, default=1)


def _features(carried: list[str], words: int, bands: int, rows: int):
    """For mapInArrow: the carried columns, the key of the words, how many shingles, and the bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            sets = weighted_shingles(part.column("text").to_pylist(), words)
            keys = band_keys(signatures([(e, w) for _, e, w in sets], bands * rows), bands, rows)
            found = [k.tolist() if len(e) else [] for k, (_, e, _) in zip(keys, sets, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in carried), pa.array([k for k, _, _ in sets], pa.binary()), pa.array([len(e) for _, e, _ in sets], pa.int64()), pa.array(found, pa.list_(pa.int64()))],
                names=[*carried, "key", "size", "bands"],
            )

    return run


def _sets_of(wanted: Bloom, words: int):
    """For mapInArrow: the sets of the texts whose keys may be wanted, each once in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for part in text_slices(batches):
            _forget()
            rows = []
            for own, key in map(_words_and_key, part.column("text").to_pylist()):
                if own and key not in seen and int.from_bytes(key[:8], "big") in wanted:
                    seen.add(key)
                    elements, counts = _shingles(own, words)
                    rows.append((key, elements.tobytes(), counts.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.binary()) for i in range(3)], names=["key", "elements", "counts"])

    return run


def _set(elements: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(elements, "<u8"), np.frombuffer(counts, "<u4")


def _verify(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("a_elements", "a_counts", "b_elements", "b_counts")]
            close = [probability_jaccard(*_set(a, x), *_set(b, y)) >= least - 1e-12 for a, x, b, y in zip(*columns, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(close, pa.bool_()))

    return run


def _candidates(sets: list[tuple[np.ndarray, np.ndarray]], left: np.ndarray, right: np.ndarray, least: float) -> Iterator[tuple[int, int]]:
    """Places of the pairs (one of left, one of right) that can reach the similarity, each pair once and the lower place first.

    A similarity is at most either set's share that is common. Order all elements by how many sets have them, the rarest
    first: two sets whose first elements, up to a share of over 1 - least, have none in common are not that similar.
    """
    sizes = np.array([len(e) for e, _ in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, place, times = np.unique(np.concatenate([e for e, _ in sets]), return_inverse=True, return_counts=True)
    share = np.concatenate([c / c.sum() for _, c in sets])
    order = np.lexsort((place, times[place], owner))
    owner, place, share, times = owner[order], place[order], share[order], times[place[order]]
    before = np.cumsum(share) - share
    before -= np.repeat(before[np.concatenate(([0], np.cumsum(sizes)[:-1]))], sizes)
    mine = (before <= 1 - least + 1e-9) & (times > 1)
    owner, place = owner[mine], place[mine]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    seen: set[tuple[int, int]] = set()
    starts = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1]))) if len(place) else []
    for group in np.split(owner, starts[1:]):
        for i in group[left[group]].tolist():
            for j in group[right[group]].tolist():
                pair = (i, j) if i < j else (j, i)
                if i != j and pair not in seen:
                    seen.add(pair)
                    yield pair


def _links_between(least: float):
    """For applyInPandas: verified links that join different components of a pair of blocks, a spanning forest of them."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v, labels = pdf["v"].tolist(), pdf["label"].tolist()
        sets = [_set(e, c) for e, c in zip(pdf["elements"], pdf["counts"], strict=True)]
        left = (pdf["at"] == pdf["i"]).to_numpy()
        right = (pdf["at"] == pdf["j"]).to_numpy()
        root = {x: x for x in labels}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        links = []
        for i, j in _candidates(sets, left, right, least) if left.any() and right.any() else ():
            a, b = find(labels[i]), find(labels[j])
            if a != b and probability_jaccard(*sets[i], *sets[j]) >= least - 1e-12:
                root[max(a, b)] = min(a, b)
                links.append((v[i], v[j]))
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return run


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets of labelled vertices to the shingles of each label, each once in a batch."""
    for batch in batches:
        sets = [np.frombuffer(e, "<i8") for e in batch.column("elements").to_pylist()]
        labels = np.repeat(batch.column("label").to_numpy(), [len(e) for e in sets])
        elements = np.concatenate(sets) if sets else np.empty(0, np.int64)
        order = np.lexsort((labels, elements))
        elements, labels = elements[order], labels[order]
        new = np.ones(len(elements), bool)
        new[1:] = (elements[1:] != elements[:-1]) | (labels[1:] != labels[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(elements[new]), pa.array(labels[new])], names=["element", "label"])


def _shares(common: Bloom):
    """For mapInArrow: how much of each vertex's weight lies in common shingles, at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for e, c in zip(batch.column("elements").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                counts = np.frombuffer(c, "<u4").astype(np.int64)
                out.append(float(counts[common.find(np.frombuffer(e, "<i8"))].sum() / counts.sum()))
            yield pa.RecordBatch.from_arrays([batch.column("v"), pa.array(out, pa.float64())], names=["v", "share"])

    return run


def _open_members(members: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Members (bucket, v, size, label) of buckets with several components that may have a link to another; adds `high`."""
    mixed = members.groupBy("bucket").agg((F.min("label") < F.max("label")).alias("mixed")).filter("mixed").select("bucket")
    members = stored(members.join(mixed, "bucket"))
    vertices = stored(members.select("v", "label").distinct().join(sets, "v"))
    spread = vertices.select("elements", "label").mapInArrow(_spread, "element long, label long").groupBy("element").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    common = Bloom.of(stored(spread.filter("lo < hi").select("element")), "element")
    shares = stored(vertices.select("v", "elements", "counts").mapInArrow(_shares(common), "v long, share double").filter(F.col("share") >= least - 1e-9))
    return stored(members.join(shares, "v").withColumn("high", F.col("share") >= 2 * least / (1 + least) - 1e-9).drop("share"))


def _block_pairs(members: DataFrame, block: int) -> DataFrame:
    """For members (bucket, v, label, size, high): a row (bucket, i, j, at, v, label) for each pair of blocks that a vertex is in.

    Components of more than a block's weight in a bucket have blocks of their own, the others share the bucket's; blocks of
    one component don't meet, nor do two of vertices that aren't high. A block is (part, high, place).
    """
    weight = (1 + F.col("size") / SHINGLES).alias("weight")
    per = members.groupBy("bucket", "label", "high").agg(F.sum(weight).alias("weight"))
    grouped = stored(per.withColumn("part", F.when(F.col("weight") > block, F.col("label")).otherwise(F.lit(REST))))
    parts = grouped.groupBy("bucket", "part", "high").agg(F.ceil(F.sum("weight") / block).cast("int").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    both = parts.groupBy("bucket").agg(((F.min("lo") < F.max("hi")) & F.max("high")).alias("any"), F.collect_list(F.struct("part", "high", "n")).alias("parts"))
    every = stored(both.filter("any").select("bucket", F.explode("parts").alias("p")).select("bucket", "p.*"))
    here = grouped.select("bucket", "label", "part", "high").join(every, ["bucket", "part", "high"])
    own = F.pmod(F.xxhash64("v"), F.col("n")).cast("int").alias("k")
    placed = members.join(stored(here), ["bucket", "label", "high"]).select("bucket", "part", "high", own, "v", "label")
    others = every.select("bucket", "part", "high", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k")).select("bucket", F.struct("part", "high", "k").alias("to"))
    at, to = F.struct("part", "high", "k"), F.col("to")
    meet = placed.join(stored(others), "bucket").filter((F.col("high") | to["high"]) & ((F.col("part") != to["part"]) | (F.col("part") == REST)))
    return meet.select("bucket", F.least(at, to).alias("i"), F.greatest(at, to).alias("j"), at.alias("at"), "v", "label")


def _classes(docs: DataFrame, least: float, block: int, words: int) -> DataFrame:
    """For columns id, text and perhaps row: id, row, class (null for a text without words), first, class_size."""
    carried = [c for c in docs.columns if c != "text"]
    shape = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in carried)
    rows = docs.mapInArrow(_features(carried, words, *banding(least)), f"{shape}, key binary, size long, bands array<long>")
    rows = stored(rows if "row" in carried else rows.withColumn("row", F.monotonically_increasing_id()))
    vertices = stored(rows.filter(F.col("size") > 0).groupBy("key").agg(F.min("bands").alias("bands"), F.min("size").alias("size")).withColumn("v", F.monotonically_increasing_id()))

    inside = vertices.select("v", "size", F.explode("bands").alias("bucket"))
    heads = inside.groupBy("bucket").agg(F.min("v").alias("lead"), F.count("*").alias("n")).filter("n > 1")
    shared = stored(inside.join(stored(heads), "bucket"))

    first = shared.filter("v <> lead").select(F.col("lead").alias("a"), F.col("v").alias("b")).distinct()
    first = stored(first)
    wanted = stored(first.select(F.col("a").alias("v")).unionByName(first.select(F.col("b").alias("v"))).distinct().join(vertices.select("v", "key"), "v"))
    head = F.conv(F.hex(F.substring("key", 1, 8)), 16, -10).cast("long").alias("head")
    sets = docs.select("text").mapInArrow(_sets_of(Bloom.of(wanted.select(head), "head"), words), "key binary, elements binary, counts binary")
    sets = stored(sets.join(wanted, "key").dropDuplicates(["v"]).select("v", "elements", "counts"))

    def side(name: str) -> DataFrame:
        return sets.select(F.col("v").alias(name), F.col("elements").alias(f"{name}_elements"), F.col("counts").alias(f"{name}_counts"))

    links = stored(first.join(side("a"), "a").join(side("b"), "b").mapInArrow(_verify(least), "a long, b long"))
    labels = components(links)

    # a bucket's least vertex has been compared with all others of it
    others = shared.filter("v <> lead and n > 2").select("bucket", "v", "size")
    members = stored(others.join(labels, "v", "left").select("bucket", "v", "size", F.coalesce("label", "v").alias("label")))
    met = _block_pairs(_open_members(members, sets, least), block)
    more = stored(met.join(sets, "v").groupBy("bucket", "i", "j").applyInPandas(_links_between(least), "a long, b long").distinct())
    if not more.isEmpty():
        labels = components(links.unionByName(more))

    classes = vertices.select("key", "v").join(labels, "v", "left").select("key", F.coalesce("label", "v").alias("class"))
    named = stored(rows.select("id", "row", "key").join(stored(classes), "key", "left").select("id", "row", "class"))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    least_of = named.filter(F.col("class").isNotNull()).groupBy("class").agg(F.min(order).alias("first"), F.count("*").alias("class_size"))
    return named.join(stored(least_of), "class", "left")


def near_duplicates(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: float = SIMILARITY, block: int = BLOCK, words: int = WORDS) -> DataFrame:
    """One row per input row: the id, class_id (least id of its class), class_size, kept (true for one row of each class).

    A class is a connected component of documents whose probability Jaccard similarity of shingles of `words` words is
    `least` or more; documents with the same words, whatever their case and punctuation, are in one. A text without words
    (null, empty or signs only) is a class of its own. Null ids come last, and of repeated ids exactly one row is kept. Other
    columns are not read. An empty table gives an empty result. A text of any length is one set, in one task.
    """
    found = _classes(bounded(df).select(F.col(id_column).alias("id"), F.col(text_column).alias("text")), least, block, words)
    alone = F.col("class").isNull()
    return found.select(
        F.col("id").alias(id_column),
        F.when(alone, F.col("id")).otherwise(F.col("first.id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"),
        (alone | (F.col("row") == F.col("first.row"))).alias("kept"),
    )


def keep_first(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: float = SIMILARITY, block: int = BLOCK, words: int = WORDS) -> DataFrame:
    """The rows that near_duplicates() keeps, with all their columns, whatever their names. Texts that stay are not shuffled.

    Nulls, repeated ids and empty tables are as there.
    """
    rows, row = numbered(bounded(df))
    found = _classes(rows.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), F.col(row).alias("row")), least, block, words)
    return without(rows, stored(found.filter(F.col("row") != F.col("first.row")).select(F.col("row").alias(row))), row)
