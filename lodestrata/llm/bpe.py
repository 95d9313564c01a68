"""BPE encoding and decoding with contiguous rank arrays.

A short word is a row of part ids and, beside it, a row of the ranks of adjacent parts. Each step finds the least rank of
every row, deletes that boundary, closes the gap and refreshes the two neighbouring ranks; many words advance together in one
numpy matrix. Words too long for that use a heap over a linked list with the same order of merges. Words that a worker has
met are kept with their ids, up to a bound; texts are encoded whole and in bounded slices.

Composition, lower case and the classes of letters and numbers depend on a version of Unicode. Runs of characters that have
been the same in all versions are cut here; any other run between white space goes through the tokenizers library's own
normaliser and splitter, so that words are the library's whatever Python's tables say.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, pre_tokenizers

from .common import text_slices

NO_RANK = np.int32(2**31 - 1)
#: Bytes of a short word; words remembered by a worker.
SHORT, REMEMBERED = 48, 150_000


# Ranges of characters that no version of Unicode changes: assigned, composed, with one lower case each.
STABLE = "\0-\u0239\u023b-\u023d\u023f-\u02ff\u0386\u0388-\u038a\u038c\u038e-\u03a1\u03a3-\u03ce\u0400-\u045f\u2010-\u2027\u2030-\u203e\u20ac\u3001-\u3003\u3041-\u3093\u30a1-\u30f6\u4e00-\u9fa5\uac00-\ud7a3"
#: White space among these.
_SPACE = r"\t-\r \x85\xa0"
_unstable = re.compile(f"[^{STABLE}]").search
_runs = re.compile(r"[^\t-\r ]+").findall


@functools.cache
def _classes() -> tuple[str, str]:
    """The letters and the numbers among the stable characters, as the inside of a character class."""
    out = []
    for kind in "LN":
        runs: list[list[int]] = []
        for c in range(0x10000):
            if not _unstable(chr(c)) and unicodedata.category(chr(c))[0] == kind:
                if runs and runs[-1][1] == c - 1:
                    runs[-1][1] = c
                else:
                    runs.append([c, c])
        out.append("".join(f"\\u{a:04x}-\\u{b:04x}" if a != b else f"\\u{a:04x}" for a, b in runs))
    return out[0], out[1]


def _byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else the next above 255."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(others)) for b in range(256)]


class WordBpe:
    """Encoder and decoder for a tokenizer file of lower-cased words with a word-end mark and no unknown token."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        end = model["end_of_word_suffix"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens = [""] * (1 + max(max(vocab.values()), *self.special.values()))
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        chars = _byte_characters()
        self.inner = np.array([vocab[c] for c in chars], np.int32)
        self.last = np.array([vocab[c + end] for c in chars], np.int32)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.ranks = {(vocab[a] << 16) | vocab[b]: i for i, (a, b) in reversed([*enumerate(merges)])}
        self._hash_table()
        letters, numbers = _classes()
        self.words_of = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{_SPACE}{letters}{numbers}]+").findall
        library = Tokenizer.from_file(path)
        self.normal = library.normalizer.normalize_str
        (pattern,) = [x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split"]
        self.splits = pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str
        self.special_of = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split
        self.known: dict[str, bytes] = {}

    def _hash_table(self) -> None:
        """An open-addressed table from a pair of ids to its rank, in arrays."""
        self.bits = 18
        self.keys = np.full(1 << self.bits, 0xFFFFFFFF, np.uint32)
        self.values = np.full(1 << self.bits, NO_RANK, np.int32)
        for key, rank in self.ranks.items():
            at = (key * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - self.bits)
            while self.keys[at] != 0xFFFFFFFF:
                at = (at + 1) & ((1 << self.bits) - 1)
            self.keys[at], self.values[at] = key, rank

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids; NO_RANK where they don't merge."""
        key = (left.astype(np.uint32) << np.uint32(16)) | right.astype(np.uint32)
        at = (key * np.uint32(0x9E3779B1)) >> np.uint32(32 - self.bits)
        out = self.values[at]
        found = self.keys[at]
        out[found != key] = NO_RANK
        todo = np.flatnonzero((found != key) & (found != np.uint32(0xFFFFFFFF)))
        mask = np.uint32((1 << self.bits) - 1)
        while len(todo):
            at[todo] = (at[todo] + np.uint32(1)) & mask
            found = self.keys[at[todo]]
            hit = found == key[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (found != np.uint32(0xFFFFFFFF))]
        return out

    def _short(self, words: list[bytes], width: int) -> list[bytes]:
        """Ids of words of at most `width` bytes, all together."""
        n = len(words)
        lengths = np.array([len(w) for w in words])
        flat = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        parts = self.inner[flat]
        parts[np.arange(n), lengths - 1] = self.last[flat[np.arange(n), lengths - 1]]
        out: list[bytes] = [b""] * n
        place = np.arange(n)
        ranks = self._rank(parts[:, :-1].ravel(), parts[:, 1:].ravel()).reshape(n, width - 1)
        ranks[np.arange(width - 1)[None, :] >= (lengths - 1)[:, None]] = NO_RANK
        while True:
            at = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(place), np.int64)
            best = ranks[np.arange(len(place)), at] if ranks.shape[1] else np.full(len(place), NO_RANK)
            more = best != NO_RANK
            if not more.all():
                done = np.flatnonzero(~more)
                for i, size, ids in zip(place[done].tolist(), (4 * lengths[done]).tolist(), parts[done].astype("<u4"), strict=True):
                    out[i] = ids.tobytes()[:size]
                parts, ranks, lengths, place, at, best = parts[more], ranks[more], lengths[more], place[more], at[more], best[more]
            if not len(place):
                return out
            rows = np.arange(len(place))
            parts[rows, at] = new = self.merged[best]
            # each row loses one boundary, so the matrices lose a column
            keep = np.ones(parts.shape, bool)
            keep[rows, at + 1] = False
            parts = parts[keep].reshape(len(rows), -1)
            keep = np.ones(ranks.shape, bool)
            keep[rows, at] = False
            ranks = ranks[keep].reshape(len(rows), -1)
            lengths = lengths - 1
            has = np.flatnonzero(at < lengths - 1)
            ranks[has, at[has]] = self._rank(new[has], parts[has, at[has] + 1])
            has = np.flatnonzero(at > 0)
            ranks[has, at[has] - 1] = self._rank(parts[has, at[has] - 1], new[has])

    def _long(self, word: bytes) -> bytes:
        """Ids of a word of any length, in n log n steps."""
        b = np.frombuffer(word, np.uint8)
        parts = [*self.inner[b[:-1]].tolist(), int(self.last[b[-1]])]
        n = len(parts)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := self.ranks.get((parts[i] << 16) | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i] if parts[i] == left else n
            if j >= n or parts[j] != right:
                continue
            parts[i], parts[j] = int(self.merged[rank]), -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (m := after[k]) < n and (r := self.ranks.get((parts[k] << 16) | parts[m])) is not None:
                    heapq.heappush(heap, (r, k, parts[k], parts[m]))
        return np.array([p for p in parts if p >= 0], "<u4").tobytes()

    def learn(self, words: set[str]) -> None:
        """Put the words' ids among the known."""
        by_width: dict[int, list[str]] = {}
        for w in words:
            size = len(w.encode())
            by_width.setdefault(next((k for k in (4, 8, 12, 16, 20, 24, 32, SHORT) if size <= k), 0), []).append(w)
        for width, group in by_width.items():
            data = [w.encode() for w in group]
            if width:
                for i in range(0, len(data), 8192):
                    self.known.update(zip(group[i : i + 8192], self._short(data[i : i + 8192], width), strict=True))
            else:
                self.known.update(zip(group, map(self._long, data), strict=True))

    def split(self, text: str) -> list[str]:
        """The words of a text without special tokens: composed, lower case, white space dropped."""
        if text.isascii():
            return self.words_of(text.lower())
        if not _unstable(text):
            return self.words_of(text.replace("Σ", "σ").lower())
        # nothing composes over white space, and no word holds any
        out: list[str] = []
        for odd, runs in itertools.groupby(_runs(text), lambda run: _unstable(run) is not None):
            if odd:
                out += [w for run in runs for w, _ in self.splits(self.normal(run))]
            else:
                out += self.words_of(" ".join(runs).replace("Σ", "σ").lower())
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers; a null text counts as empty."""
        pieces = []
        for text in texts:
            if text and "<|" in text:
                pieces.append([[x] if x in self.special else self.split(x) for x in self.special_of(text)])
            else:
                pieces.append([self.split(text)] if text else [])
        if len(self.known) > REMEMBERED:
            self.known.clear()
        for token, i in self.special.items():
            self.known[token] = i.to_bytes(4, "little")
        self.learn({w for text in pieces for words in text for w in words} - self.known.keys())
        ids = self.known.__getitem__
        return [b"".join([b"".join(map(ids, words)) for words in text]) for text in pieces]

    def decode(self, ids: bytes) -> str:
        """The tokens in order with a space between, as a tokenizer without a decoder gives them."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.cache
def tokenizer(path: str) -> WordBpe:
    """One for each worker process."""
    return WordBpe(path)


def encode_decode(df: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: id, n_tokens, ids (binary: little-endian unsigned 32-bit), decoded.

    Null and empty texts have no ids and decode to the empty text. Repeated rows and null ids stay as they are. Strings of
    special tokens in a text become these tokens. Other columns are not read. An empty table gives an empty result. `path` must
    be readable on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for part in text_slices(batches):
            ids = bpe.encode(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(map(bpe.decode, ids), pa.string())], names=["id", "n_tokens", "ids", "decoded"])

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(run, f"id {kind}, n_tokens long, ids binary, decoded string").withColumnRenamed("id", id_column)
