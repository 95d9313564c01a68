"""Toxicity by a weighted finite-state pattern grammar.

Five small transducers read a text's words as classes: an insult counts at its stem's learned weight, and less where its
clause has had one before; a threat counts with a target in its clause; a target raises weights; negation within three words
and reported speech or mention lower them. Their composition is one table of product states, run over the clauses that hold an
insult or a threat. Matched clauses, not words, are counted and weighed: a logistic curve over a few sums over clauses gives
the score. Insult stems and the curve are learned from labelled rows; the other word lists are fixed, as are the ten insults
that have a prior weight where labels say nothing of them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SMALL_SLICE, stored, text_slices
from .langid import held_out

# Word lists of the grammar.
INSULTS = "idiot moron loser stupid pathetic worthless disgusting scum trash clown".split()
THREATS = "kill hurt destroy burn beat stab shoot hang".split()
TARGETS = "you your yours he she him her they them these those people du ihr sie dich euch tu vous toi ils elles tú usted ustedes ellos".split()
NEGATIONS = "not no never neither nor cannot isn aren wasn don nicht kein keine nie ne pas jamais no nunca jamás".split()
REPORTS = "said says say wrote writes called calls quoted quotes reported claims claimed allegedly word words term phrase sagte schrieb wort dit écrit mot dijo escribió palabra".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, CLAUSE, SENTENCE = range(8)
#: Logarithms of what an insult or threat counts where it is negated, reported, or has a target in its clause.
NEGATED, REPORTED, AIMED = -2.0, -1.0, 0.4
#: The same for a further insult in a clause.
FURTHER = -0.5
PRIOR_WEIGHT = 3.0
#: Labelled documents of either class learned from at most; letters of a stem; documents and evidence that a stem needs.
TRAINING, STEM, SUPPORT, CHI_SQUARE, LIFT = 4000, (3, 10), 5, 25.0, 1.4


@dataclass
class Machine:
    """A deterministic transducer: arcs[(state, class)] = (next state, weight); a missing arc stays, at weight 0."""

    states: int
    arcs: dict[tuple[int, int], tuple[int, float]]

    def step(self, state: int, kind: int) -> tuple[int, float]:
        return self.arcs.get((state, kind), (state, 0.0))


def negation(reach: int = 3) -> Machine:
    arcs: dict = {}
    for s in range(reach + 1):
        for kind in range(8):
            if kind == NEGATION:
                arcs[s, kind] = (reach, 0.0)
            elif kind in (CLAUSE, SENTENCE):
                arcs[s, kind] = (0, 0.0)
            else:
                arcs[s, kind] = (max(0, s - 1), NEGATED if s and kind in (INSULT, THREAT, TARGET) else 0.0)
    return Machine(reach + 1, arcs)


def reported() -> Machine:
    return Machine(2, {(0, REPORT): (1, 0.0), (1, SENTENCE): (0, 0.0), (1, INSULT): (1, REPORTED), (1, THREAT): (1, REPORTED), (1, TARGET): (1, REPORTED)})


def target() -> Machine:
    return Machine(2, {(0, TARGET): (1, 0.0), (1, CLAUSE): (0, 0.0), (1, SENTENCE): (0, 0.0), (1, INSULT): (1, AIMED), (1, THREAT): (1, AIMED)})


def insult() -> Machine:
    """An insult counts in full where it is the first of its clause."""
    arcs = {(0, INSULT): (1, 0.0), (1, INSULT): (1, FURTHER)}
    return Machine(2, arcs | {(1, end): (0, 0.0) for end in (CLAUSE, SENTENCE)})


def threat() -> Machine:
    """A threat needs a target in its clause: it counts where the second of the two stands, and alone it is silent."""
    never = -math.inf
    arcs = {(0, TARGET): (1, never), (1, TARGET): (1, never), (0, THREAT): (2, never), (2, THREAT): (2, never), (2, TARGET): (1, 0.0)}
    return Machine(3, arcs | {(s, end): (0, 0.0) for s in (1, 2) for end in (CLAUSE, SENTENCE)})


def compose(*machines: Machine) -> tuple[list[list[int]], list[list[float]]]:
    """The product machine's reachable states: next[state][class] and weight[state][class], the weights summed."""
    start = (0,) * len(machines)
    ids, todo, following, weights = {start: 0}, [start], [], []
    while todo:
        state = todo.pop(0)
        nexts, sums = [], []
        for kind in range(8):
            steps = [m.step(s, kind) for m, s in zip(machines, state, strict=True)]
            after = tuple(s for s, _ in steps)
            if after not in ids:
                ids[after] = len(ids)
                todo.append(after)
            nexts.append(ids[after])
            sums.append(sum(w for _, w in steps))
        following.append(nexts)
        weights.append(sums)
    return following, weights


_NEXT, _WEIGHT = compose(negation(), reported(), target(), threat(), insult())
_TOKEN = re.compile(r"[^\W\d_]+|[.!?\n]|[,;:|]")
_FIXED = {w: kind for words, kind in ((THREATS, THREAT), (TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT)) for w in words}
FEATURES = ("one", "clauses", "weight", "strongest", "density", "threats")


@dataclass
class Grammar:
    """Stems of insults with their weights, and the curve's coefficients in the order of FEATURES."""

    stems: dict[str, float]
    curve: list[float] = field(default_factory=lambda: [-4.0, 1.0, 1.0, 0.0, 1.0, 0.5])

    def __post_init__(self) -> None:
        words = sorted([*self.stems, *THREATS], key=len, reverse=True)
        self._any = re.compile(r"(?<![^\W\d_])(?:" + "|".join(map(re.escape, words)) + ")").search
        self._lengths = sorted({len(s) for s in self.stems}, reverse=True)

    def __getstate__(self):
        return {"stems": self.stems, "curve": self.curve}

    def __setstate__(self, state) -> None:
        self.__init__(state["stems"], state["curve"])

    def _stem(self, word: str) -> str | None:
        return next((word[:n] for n in self._lengths if word[:n] in self.stems), None)

    def clauses(self, text: str) -> list[tuple[int, int, float, int]]:
        """The matched clauses of a lower-case text: start, end, weight and threats."""
        found, state, start, weight, threats, matched, end = [], 0, 0, 0.0, 0, False, 0
        following, weights = _NEXT, _WEIGHT
        for m in _TOKEN.finditer(text):
            word = m[0]
            if not word[0].isalpha():
                kind = CLAUSE if word in ",;:|" else SENTENCE
                if matched:
                    found.append((start, m.start(), weight, threats))
                    weight, threats, matched = 0.0, 0, False
                start = m.end()
            else:
                end = m.end()
                kind = _FIXED.get(word, OTHER)
                if kind in (OTHER, THREAT):
                    stem = self._stem(word)
                    if stem is not None:
                        kind, matched = INSULT, True
                        weight += self.stems[stem] * math.exp(weights[state][INSULT])
                if kind in (THREAT, TARGET) and weights[state][kind] > -math.inf:
                    threats, matched = threats + 1, True
                    weight += PRIOR_WEIGHT * math.exp(weights[state][kind])
            state = following[state][kind]
        if matched:
            found.append((start, end, weight, threats))
        return found

    def match(self, text: str | None) -> tuple[list[tuple], list[float]]:
        """The matched clauses and the features of a whole text."""
        low = (text or "").lower()
        found = self.clauses(low) if self._any(low) else []
        if not found:
            return [], [1.0] + [0.0] * (len(FEATURES) - 1)
        total = sum(c[2] for c in found)
        words = 1 + low.count(" ") + low.count("\n")
        return found, [1.0, math.log1p(len(found)), math.log1p(total), max(c[2] for c in found), math.log1p(100 * total / words), float(sum(c[3] for c in found))]

    def score(self, features: list[float]) -> float:
        z = sum(a * b for a, b in zip(self.curve, features, strict=True))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def _learning_rows(df: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """Texts with labels, of either class at most `most`, drawn by a hash of the id; stored.

    Null labels and ids are left out; a document with several labels has the highest, and a repeated id teaches once.
    """
    known = labels.select(F.col("doc_id"), F.col(label).alias("label")).dropna().filter(~held_out())
    drawn = None
    for k in (0, 1):
        own = known.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        drawn = own if drawn is None else drawn.unionByName(own)
    drawn = stored(drawn.groupBy("doc_id").agg(F.max("label").alias("label")))
    # at most 2 * most rows of two numbers are broadcast; of rows that share an id the one with the least hash teaches
    texts = df.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").withColumn("hash", F.xxhash64("text"))
    return stored(texts.groupBy("doc_id").agg(F.min_by("text", "hash").alias("text"), F.min("label").alias("label")).select("text", "label"))


def learn(df: DataFrame, labels: DataFrame, label: str = "toxic", most: int = TRAINING) -> Grammar:
    """A grammar from labelled documents (doc_id, text; doc_id, 0 or 1) that are not held out.

    At most `most` documents of either class are used. Stems with few documents or little evidence stay out; the fixed
    insults stay in with a prior weight. Without labels of both classes the default curve holds. The driver gets the counts
    of at most as many stems as have support in the toxic documents, and a few numbers of each document.
    """
    rows = _learning_rows(df, labels, label, most)
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    prior = dict.fromkeys(INSULTS, PRIOR_WEIGHT)
    if not toxic or not clean:
        return Grammar(prior)
    low, high = STEM

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, budget=SMALL_SLICE):
            seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for text, k in zip(part.column("text").to_pylist(), part.column("label").to_pylist(), strict=True):
                words = set(re.findall(r"[^\W\d_]+", (text or "").lower()))
                seen[k].update({w[:n] for w in words for n in range(low, min(high, len(w)) + 1)})
            stems = sorted({*seen[0], *seen[1]})
            yield pa.RecordBatch.from_arrays([pa.array(stems, pa.string()), *(pa.array([seen[k][s] for s in stems], pa.int64()) for k in (1, 0))], names=["stem", "toxic", "clean"])

    counts = rows.mapInArrow(count, "stem string, toxic long, clean long").groupBy("stem").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    n = toxic + clean
    a, b = F.col("a"), F.col("b")
    lift = F.log((a + 0.5) / (toxic + 1)) - F.log((b + 0.5) / (clean + 1))
    chi = n * F.pow(a * clean - b * toxic, 2) / (F.lit(float(toxic)) * clean * (a + b) * F.greatest(n - a - b, F.lit(1)))
    told = counts.filter((a >= max(SUPPORT, toxic // 100)) & (lift >= LIFT)).select("stem", lift.alias("lift"), chi.alias("chi")).filter(F.col("chi") >= CHI_SQUARE).collect()
    stems: dict[str, float] = {}
    for r in sorted(told, key=lambda r: (-r["chi"], -len(r["stem"]), r["stem"])):
        # the best of nested stems stands for them
        if not any(r["stem"].startswith(s) or s.startswith(r["stem"]) for s in stems):
            stems[r["stem"]] = round(r["lift"], 6)
    for word, weight in prior.items():
        if not any(word.startswith(s) or s.startswith(word) for s in stems):
            stems[word] = weight
    grammar = Grammar(stems)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, budget=SMALL_SLICE):
            x = [grammar.match(t)[1] for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("label").cast(pa.int32()), pa.array(x, pa.list_(pa.float64()))], names=["label", "x"])

    got = rows.mapInArrow(measure, "label int, x array<double>").toArrow()
    x = np.array(got["x"].to_pylist())
    y = got["label"].to_numpy().astype(float)
    # either class was drawn at a rate of its own; weights restore the share in the labels
    share = {r["k"]: r["n"] for r in labels.dropna(subset=["doc_id", label]).filter(~held_out()).groupBy(F.col(label).alias("k")).agg(F.count("*").alias("n")).collect()}
    weight = np.where(y == 1, share.get(1, 1) / toxic, share.get(0, 1) / clean)
    grammar.curve = fit_logistic(x, y, weight / weight.mean()).tolist()
    return grammar


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05, rounds: int = 60) -> np.ndarray:
    """Coefficients of a weighted logistic regression with a small ridge, by damped Newton steps."""
    order = np.lexsort((*x.T, y))  # sums in one order whatever the partitions
    x, y, weight = x[order], y[order], weight[order]
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
        gradient = x.T @ (weight * (y - p)) - ridge * beta
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta))
        step = np.linalg.solve(hessian, gradient)
        step *= min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def score(df: DataFrame, grammar: Grammar, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: the id, score, predicted (1 from 0.5 on), clauses (start, end, weight of each matched clause).

    A null or empty text matches nothing and gets the score of such texts. Ids may be null or repeated; other columns are
    not read. A text of any length is scored by all of it. An empty table gives an empty result.
    """
    shape = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("weight", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, text_column):
            done = [grammar.match(t) for t in part.column(text_column).to_pylist()]
            scores = [grammar.score(x) for _, x in done]
            spans = [[{"start": c[0], "end": c[1], "weight": c[2]} for c in found] for found, _ in done]
            yield pa.RecordBatch.from_arrays([part.column(id_column), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(spans, shape)], names=[id_column, "score", "predicted", "clauses"])

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, score double, predicted int, clauses array<struct<start:int,end:int,weight:double>>")


def filter_rows(df: DataFrame, grammar: Grammar, text_column: str = "text", least: float = 0.5) -> DataFrame:
    """The rows that score less than `least`, with all columns, whatever their names; nothing is shuffled.

    Null and empty texts have the score of texts that match nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, text_column):
            yield part.filter(pa.array([grammar.score(grammar.match(t)[1]) < least for t in part.column(text_column).to_pylist()], pa.bool_()))

    return df.mapInArrow(run, df.schema)
