"""Language identification by rank-order profiles.

A profile is the list of a language's most frequent letter n-grams, of one to three letters within words, in order of
frequency. A document gets a list of its own, from its whole text; its distance to a language is the sum, over its list, of
how far each n-gram is out of place in the language's profile (the profile's length where it is missing). The nearest wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SMALL_SLICE, stored, text_slices

UNDETERMINED = "und"
#: N-grams of a profile.
PROFILE = 300
#: Distinct n-grams from which on a text's distance is judged; documents that a floor of scores is learned from at least.
JUDGED, FLOOR_ROWS = 32, 100

#: Bits of a letter's symbol in an n-gram's code, and texts whose n-grams are sorted together.
BITS, TOGETHER = 18, 256


def _symbol_table() -> np.ndarray:
    """A symbol of its own for each letter of Unicode, in order from 1; 0 for what is no letter."""
    letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    table = np.where(letter, np.cumsum(letter), 0).astype(np.uint32)
    if int(table.max()) >> BITS:
        raise ValueError("more letters than symbols")
    return table


_table: list[np.ndarray] = []


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n-grams of each text as (text's place, n-gram's code, count), ordered by place and code; null is like empty.

    A code holds how many letters the n-gram has and each one's symbol, with 0 for the space beside a word.
    """
    if not _table:
        _table.append(_symbol_table())
    found = []
    for start in range(0, len(texts), TOGETHER):
        place, code, count = _grams(texts[start : start + TOGETHER])
        found.append((place + start, code, count))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 3


def _grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = [(t or "").lower() + " " for t in texts]
    sizes = np.array([len(p) for p in parts])
    codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4")
    symbol = _table[0][codes].astype(np.uint64)
    place = np.repeat(np.arange(len(texts), dtype=np.uint64) << np.uint64(3 * BITS + 2), sizes)
    # one 0 between words
    keep = np.ones(len(symbol), bool)
    keep[1:] = (symbol[1:] != 0) | (symbol[:-1] != 0)
    symbol, place = symbol[keep], place[keep]
    if len(symbol) and symbol[0]:  # the first word, too, has a 0 before it
        symbol, place = np.concatenate(([np.uint64(0)], symbol)), np.concatenate((place[:1], place))
    one = symbol != 0
    a = place[one] | symbol[one]
    two = np.uint64(1 << 3 * BITS) | (symbol[:-1] << np.uint64(BITS)) | symbol[1:]
    # a pair whose second is the 0 before a word belongs to the word before; its text is that of its letter
    b = np.where(symbol[1:] == 0, place[:-1], place[1:]) | two
    mid = symbol[1:-1] != 0
    three = np.uint64(1 << 3 * BITS + 1) | (symbol[:-2] << np.uint64(2 * BITS)) | (symbol[1:-1] << np.uint64(BITS)) | symbol[2:]
    c = (place[1:-1] | three)[mid]
    keys, counts = np.unique(np.concatenate((a, b, c)), return_counts=True)
    return (keys >> np.uint64(3 * BITS + 2)).astype(np.int64), (keys & np.uint64((1 << 3 * BITS + 2) - 1)).astype(np.int64), counts


def ranked(texts: list[str | None], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's most frequent n-grams as (place, code, rank from 0); ties go by code."""
    place, code, count = grams(texts)
    order = np.lexsort((-count, place))
    place, code = place[order], code[order]
    starts = np.searchsorted(place, np.arange(len(texts)))
    rank = np.arange(len(place)) - starts[place]
    few = rank < most
    return place[few], code[few], rank[few]


@dataclass
class Profiles:
    """Languages, and for each its n-grams' codes in rising order with their ranks."""

    languages: list[str]
    codes: list[np.ndarray]
    ranks: list[np.ndarray]
    length: int

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text: 1 less the distance as a part of the greatest possible; `und` and 0 without a letter."""
        return self.measure(texts)[:2]

    def measure(self, texts: list[str | None]) -> tuple[list[str], list[float], list[int]]:
        """Language and score of each text, as predicted, and the n-grams of its list."""
        place, code, rank = ranked(texts, self.length)
        n = np.bincount(place, minlength=len(texts))
        if not self.languages:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts), n.tolist()
        distance = np.zeros((len(self.languages), len(texts)))
        for k, (codes, ranks) in enumerate(zip(self.codes, self.ranks, strict=True)):
            at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            out = np.where(codes[at] == code, np.abs(ranks[at] - rank), self.length)
            distance[k] = np.bincount(place, out, len(texts))
        best = distance.argmin(0)
        score = 1 - distance[best, np.arange(len(texts))] / np.maximum(1, n * self.length)
        return [self.languages[b] if c else UNDETERMINED for b, c in zip(best.tolist(), n.tolist(), strict=True)], np.where(n > 0, score, 0.0).tolist(), n.tolist()


def _drawn(rows: DataFrame, most: int) -> DataFrame:
    """About `most` distinct texts of each language at most, drawn by a hash of the text."""
    hashed = rows.withColumn("hash", F.pmod(F.xxhash64("text", F.lit("profiles")), F.lit(1 << 53)))
    # hashes alone are shuffled: each distinct text counts once, and the least hash of a language is always drawn
    distinct = hashed.select("lang", "hash").distinct()
    there = distinct.groupBy("lang").agg(F.count("*").alias("n"), F.min("hash").alias("least")).collect()
    if not there:
        return rows
    bound = F.create_map(*[x for r in there for x in (F.lit(r["lang"]), F.lit(max(r["least"], int(min(1.0, most / r["n"]) * (1 << 53)))))])
    # at most about `most` texts of a language are shuffled as such; copies are dropped as they are read, then over all tasks
    return hashed.filter(F.col("hash") <= F.element_at(bound, F.col("lang"))).dropDuplicates(["lang", "hash"])


def learn(df: DataFrame, lang_column: str = "lang", text_column: str = "text", length: int = PROFILE, most: int | None = None) -> Profiles:
    """Profiles from all labelled rows; or, if `most` is given, from about so many distinct texts a language at most.

    Copies of a text count once, and every language with a text has a profile. Rows with a null language or text are
    left out. The driver gets `length` n-grams a language. Without rows there are no profiles, and everything is predicted as undetermined.
    """
    rows = df.select(F.col(lang_column).alias("lang"), F.col(text_column).alias("text")).dropna()
    drawn = rows.distinct() if most is None else _drawn(rows, most)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, budget=SMALL_SLICE):
            langs = np.array(part.column("lang").to_pylist(), object)
            for lang in sorted(set(langs)):
                _, code, n = grams([t for t, k in zip(part.column("text").to_pylist(), langs) if k == lang])
                codes, which = np.unique(code, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(np.bincount(which, n, len(codes)).astype(np.int64))], names=["lang", "code", "n"])

    counts = drawn.select("lang", "text").mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    by = (F.desc("n"), F.asc("code"))
    # the best of each 64th first, so that no task gets all n-grams of a language
    salted = Window.partitionBy("lang", F.pmod(F.xxhash64("code"), F.lit(64))).orderBy(*by)
    tops = counts.withColumn("r", F.row_number().over(salted)).filter(F.col("r") <= length).drop("r")
    tops = tops.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by)) - 1).filter(F.col("rank") < length).select("lang", "code", "rank").collect()
    languages, codes, ranks = sorted({r["lang"] for r in tops}), [], []
    for lang in languages:
        own = sorted((r["code"], r["rank"]) for r in tops if r["lang"] == lang)
        codes.append(np.array([c for c, _ in own]))
        ranks.append(np.array([r for _, r in own]))
    return Profiles(languages, codes, ranks, length)


def identify(df: DataFrame, profiles: Profiles, id_column: str = "doc_id", text_column: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: the id, the columns in `keep`, lang_pred and score.

    Ids may be null or repeated; other columns are not read. Null texts and texts without a letter are `und`, with score 0. A
    text of any length is judged by all of it. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, text_column, SMALL_SLICE):
            langs, scores = profiles.predict(part.column(text_column).to_pylist())
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in (id_column, *keep)), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[id_column, *keep, "lang_pred", "score"])

    columns = list(dict.fromkeys([id_column, text_column, *keep]))
    shape = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (id_column, *keep))
    return df.select(*columns).mapInArrow(run, f"{shape}, lang_pred string, score double")


def filter_rows(df: DataFrame, profiles: Profiles, text_column: str = "text", least: float = 0.0) -> DataFrame:
    """The rows whose text is in one of the profiles' languages, at a score of `least` or more; all columns, nothing shuffled.

    Texts of fewer than JUDGED n-grams tell too little for a score to reject them. Null texts and texts without a letter go. Without profiles nothing is known of languages, and only those go.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, text_column, SMALL_SLICE):
            texts = part.column(text_column).to_pylist()
            if profiles.languages:
                keep = [lang != UNDETERMINED and (score >= least or n < JUDGED) for lang, score, n in zip(*profiles.measure(texts), strict=True)]
            else:
                keep = [any(map(str.isalpha, t or "")) for t in texts]
            yield part.filter(pa.array(keep, pa.bool_()))

    return df.mapInArrow(run, df.schema)


def floor(df: DataFrame, profiles: Profiles) -> float:
    """A score below which a text is far outside of every language, from all labelled rows (lang, text).

    It lies as far below the score that all but a thousandth of them reach as that lies below their median; 0, which
    rejects nothing, without profiles or enough rows.
    """
    if not profiles.languages:
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, budget=SMALL_SLICE):
            _, scores, n = profiles.measure(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([x for x, k in zip(scores, n, strict=True) if k >= JUDGED], pa.float64())], names=["score"])

    n, (low, middle) = quantiles(df.select("lang", "text").dropna().select("text").mapInArrow(run, "score double"), (0.001, 0.5))
    return max(0.0, 2 * low - middle) if n >= FLOOR_ROWS else 0.0


def quantiles(scores: DataFrame, parts: tuple[float, ...]) -> tuple[int, list[float]]:
    """The number of scores (one column, from 0 to 1) and the values that these parts of them don't exceed, between two ranks in
    proportion; zeros without any.

    All scores are ranked, in steps of 2**-48, digit by digit: the driver gets at most 2**16 + 1 counts at a time.
    """
    codes = stored(scores.select(F.floor(F.col(scores.columns[0]) * F.lit(float(1 << 48))).alias("code")))
    known: dict[tuple[int, int | None], list[tuple[int, int]]] = {}

    def counts(shift: int, above: int | None) -> list[tuple[int, int]]:
        if (shift, above) not in known:
            rows = codes if above is None else codes.filter(F.shiftright("code", shift + 16) == above)
            known[shift, above] = sorted(map(tuple, rows.groupBy(F.shiftright("code", shift).alias("digits")).count().collect()))
        return known[shift, above]

    def ranked_at(rank: int) -> float:
        digits = None
        for shift in (32, 16, 0):
            for value, n in counts(shift, digits):
                if rank < n:
                    break
                rank -= n
            digits = value
        return digits / (1 << 48)

    total = sum(n for _, n in counts(32, None))
    if not total:
        return 0, [0.0] * len(parts)
    out = []
    for p in parts:
        rank, beyond = divmod(p * (total - 1), 1)
        low = ranked_at(int(rank))
        out.append(low + beyond * (ranked_at(int(rank) + 1) - low) if beyond else low)
    return total, out


def held_out(id_column: str = "doc_id"):
    """Whether a row is kept from training: crc32 of its id as text is divisible by 5; a null id is."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 5 == 0, F.lit(True))
