"""Immutable results: sealed order, content digest, pages, cursors, reuse and idempotent steps."""

from __future__ import annotations

import contextlib
import hashlib
import json
import re
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import get, names, put, remove, stored

#: Digests that are joined into one.
BLOCK = 4096
#: Rows and UTF-8 bytes of a page, and bytes of a result at most.
PAGE_ROWS, PAGE_BYTES, RESULT_BYTES = 50, 256 * 1024, 64 * 1024 * 1024
#: A run's lifetime in seconds, its accesses and the bytes it delivers at most; open runs, delivered and kept bytes of a workspace.
LIFETIME, ACCESSES, TRANSPORT, OPEN_RUNS, WORKSPACE_TRANSPORT, RETAINED = 1800, 128, 16 << 20, 2, 256 << 20, 512 << 20


class ResultError(Exception):
    """An outcome other than a result: idempotency_conflict, budget_exhausted, invalid_request or unavailable."""

    def __init__(self, outcome: str, detail: str):
        super().__init__(f"{outcome}: {detail}")
        self.outcome = outcome


def with_ordinal(df: DataFrame, order: list[str], path: str) -> DataFrame:
    """The rows at `path` with `row_ref` 1, 2, ... in the given total order, without ever sorting in one task.

    Rows are range-partitioned, sorted in each partition and written with the partition's number; counts of the partitions,
    which are few, give each its first number.
    """
    spark = df.sparkSession
    sorted_ = df.repartitionByRange(*[F.col(c).asc_nulls_last() for c in order]).sortWithinPartitions(*[F.col(c).asc_nulls_last() for c in order])
    sorted_.withColumn("_id", F.monotonically_increasing_id()).write.parquet(f"{path}/staged")
    staged = spark.read.parquet(f"{path}/staged").withColumn("_p", F.shiftright("_id", 33))
    counts = sorted((r["_p"], r["n"]) for r in staged.groupBy("_p").agg(F.count("*").alias("n")).collect())
    base, starts = 0, {}
    for p, n in counts:
        starts[p], base = base, base + n
    if not starts:
        return staged.select(F.lit(0).cast("bigint").alias("row_ref"), *df.columns)
    start = F.element_at(F.create_map(*[x for p, s in starts.items() for x in (F.lit(p), F.lit(s).cast("bigint"))]), F.col("_p"))
    return staged.select((start + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("row_ref"), *df.columns)


def encoded(df: DataFrame, columns: list[str]):
    """A row as canonical JSON: keys in order, nulls written, timestamps in UTC."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


@dataclass
class Result:
    """A sealed result: where its rows are, and what it is pinned by."""

    result_id: str
    path: str
    digest: str
    n_rows: int
    n_bytes: int
    columns: list[str]
    #: The columns of the rows' dependencies, if these were sealed with them, and their time.
    depends: list[str] | None = None
    cutoff: str | None = None


@dataclass
class Page:
    rows: list[dict[str, Any]]
    first: int
    cursor: str | None


class Run:
    """A caller's run: its results, steps and cursors, as small files beside the results' rows under `root`.

    Another process that opens the same root as the same owner goes on with it. Only pages come to the driver.
    """

    def __init__(self, spark: SparkSession, root: str, owner: str = "local", lifetime: float = LIFETIME, accesses: int | None = None, transport: int | None = None):
        self.spark, self.root, self.owner = spark, root, owner
        self.accesses, self.transport = accesses, transport
        self.seen: set[str] = set()
        own = {"owner": owner, "ends": time.time() + lifetime}
        if not put(spark, f"{root}/run.json", json.dumps(own)):
            own = json.loads(get(spark, f"{root}/run.json"))
        if own["owner"] != owner:
            raise ResultError("unavailable", "the run is another owner's")
        self.ends = own["ends"]

    @property
    def closed(self) -> bool:
        """Whether the run is closed or past its lifetime."""
        return time.time() > self.ends or get(self.spark, f"{self.root}/closed") is not None

    def counters(self) -> dict[str, int]:
        """How often results and pages were asked for, and the bytes that pages have delivered, in all processes."""
        sizes = [int(n.split("-")[0]) for n in names(self.spark, f"{self.root}/accesses")]
        kept = [self.result(n.removesuffix(".json")).n_bytes for n in names(self.spark, f"{self.root}/results") if n.endswith(".json")]
        return {"accesses": len(sizes), "transport": sum(sizes), "results": len(kept), "retained": sum(kept)}

    def _spend(self, n_bytes: int) -> None:
        """Count an access; refused where the run's budgets would be passed."""
        if self.accesses is not None or self.transport is not None:
            before = self.counters()
            if self.accesses is not None and before["accesses"] >= self.accesses or self.transport is not None and before["transport"] + n_bytes > self.transport:
                raise ResultError("budget_exhausted", "run")
        put(self.spark, f"{self.root}/accesses/{n_bytes}-{uuid.uuid4().hex}", "")

    def result(self, result_id: str) -> Result:
        """A sealed result of this run, whichever process sealed it."""
        text = get(self.spark, f"{self.root}/results/{result_id}.json")
        if text is None:
            raise ResultError("unavailable", "no such result")
        return Result(**json.loads(text))

    def _step(self, step: str) -> str:
        return f"{self.root}/steps/{hashlib.sha256(step.encode()).hexdigest()}.json"

    def _repeated(self, step: str, fingerprint: str) -> Result | None:
        """The result that a step has given before."""
        text = get(self.spark, self._step(step))
        if text is None:
            return None
        before = json.loads(text)
        if before["fingerprint"] != fingerprint:
            raise ResultError("idempotency_conflict", step)
        return self.result(before["result_id"])

    def commit(self, step: str, fingerprint: str, df: DataFrame, order: list[str], most_bytes: int = RESULT_BYTES, depends: DataFrame | None = None, cutoff: str | None = None) -> Result:
        """Seal the rows in a total order. The same step with the same fingerprint gives the same result again.

        `depends` is the bag of what the rows rest on, as of the time `cutoff`; it is sealed with them.
        """
        if self.closed:
            raise ResultError("unavailable", "the run is closed")
        if (before := self._repeated(step, fingerprint)) is not None:
            return before
        path = f"{self.root}/{uuid.uuid4().hex}"
        rows = with_ordinal(df, order, path)
        body = encoded(rows, df.columns)
        rows.withColumn("_body", body).write.parquet(f"{path}/rows")
        # the digest of a result is that of its rows' digests in order, blocks of rows first, then blocks of blocks
        sums = self.spark.read.parquet(f"{path}/rows").select(F.col("row_ref").alias("at"), F.sha2("_body", 256).alias("h"), F.octet_length("_body").cast("long").alias("b"), F.lit(1).cast("long").alias("n"))
        many = 1 + (sums.agg(F.max("at")).first()[0] or 0)
        while True:
            ordered = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "h"))), lambda x: x["h"]), "")
            sums = sums.groupBy(F.floor(F.col("at") / BLOCK).alias("at")).agg(F.sha2(ordered, 256).alias("h"), F.sum("b").alias("b"), F.sum("n").alias("n"))
            many = -(-many // BLOCK)
            if many <= BLOCK:
                break
            sums = stored(sums)
        sums = sums.orderBy("at").collect()
        n_bytes, n_rows = sum(r["b"] for r in sums), sum(r["n"] for r in sums)
        if n_bytes > most_bytes:
            raise ResultError("budget_exhausted", f"{n_bytes} bytes")
        sealed: dict[str, Any] = {"columns": df.dtypes, "blocks": [r["h"] for r in sums]}
        if depends is not None:
            depends.write.parquet(f"{path}/depends")
            sealed["depends"] = bag_digest(self.spark.read.parquet(f"{path}/depends"))
        digest = hashlib.sha256(json.dumps(sealed, sort_keys=True).encode()).hexdigest()
        result = Result(uuid.uuid4().hex, path, digest, n_rows, n_bytes, df.columns, depends.columns if depends is not None else None, cutoff)
        self._spend(0)
        put(self.spark, f"{self.root}/results/{result.result_id}.json", json.dumps(asdict(result)))
        if not put(self.spark, self._step(step), json.dumps({"result_id": result.result_id, "fingerprint": fingerprint})):
            return self._repeated(step, fingerprint)  # another process has been faster
        return result

    def rows(self, result: Result) -> DataFrame:
        return self.spark.read.parquet(f"{result.path}/rows").drop("_body")

    def recheck(self, result: Result, rebuild: Callable[[str | None], DataFrame]) -> None:
        """Refuse a result as a whole unless what it rests on, built anew at its own cutoff, is the same bag."""
        if result.depends is None:
            raise ResultError("invalid_request", "the result has no dependencies")
        if not same_rows(self.spark.read.parquet(f"{result.path}/depends"), rebuild(result.cutoff).select(*result.depends)):
            raise ResultError("unavailable", "dependency")

    def page(self, result: Result, first: int = 1, n: int = PAGE_ROWS, most_bytes: int = PAGE_BYTES, rebuild: Callable[[str | None], DataFrame] | None = None) -> Page:
        """Rows first to first + n - 1, fewer if they don't fit; never part of a row. The SQL isn't run again.

        With `rebuild` the dependencies are checked before anything is shown.
        """
        if rebuild is not None:
            self.recheck(result, rebuild)
        if not 1 <= n <= PAGE_ROWS:
            raise ResultError("invalid_request", "page size")
        got = self.spark.read.parquet(f"{result.path}/rows").filter(F.col("row_ref").between(first, first + n - 1)).orderBy("row_ref").collect()
        rows, size = [], 0
        for r in got:
            size += len(r["_body"].encode())
            if size > most_bytes:
                break
            rows.append({c: r[c] for c in result.columns})
        if got and not rows:
            raise ResultError("budget_exhausted", f"row {first} doesn't fit a page")
        self._spend(sum(len(r["_body"].encode()) for r in got[: len(rows)]))
        after = first + len(rows)
        cursor = None
        if after <= result.n_rows:
            cursor = hashlib.sha256(f"{self.owner}:{result.digest}:{after}:{uuid.uuid4().hex}".encode()).hexdigest()
            put(self.spark, f"{self.root}/cursors/{cursor}.json", json.dumps([result.result_id, result.digest, after]))
        return Page(rows, first, cursor)

    def next_page(self, cursor: str, n: int = PAGE_ROWS) -> Page:
        """The page behind a cursor, which is bound to its result and digest."""
        text = get(self.spark, f"{self.root}/cursors/{cursor}.json") if re.fullmatch("[0-9a-f]{64}", cursor) else None
        if text is None:
            raise ResultError("invalid_request", "cursor")
        result_id, digest, first = json.loads(text)
        result = self.result(result_id)
        if result.digest != digest:
            raise ResultError("unavailable", "the result has changed")
        return self.page(result, first, n)

    def newly_visible(self, refs: set[str]) -> set[str]:
        """Which of a page's references the run has not shown before."""
        new = refs - self.seen
        self.seen |= refs
        return new

    def close(self) -> None:
        put(self.spark, f"{self.root}/closed", "")

    def purge(self) -> int:
        """Delete the files of a closed run's results; its digests stay known. Returns how many results went."""
        if not self.closed:
            raise ResultError("invalid_request", "the run is open")
        gone = 0
        for name in names(self.spark, f"{self.root}/results"):
            if name.endswith(".json"):
                result = self.result(name.removesuffix(".json"))
                put(self.spark, f"{self.root}/tombstones/{name}", json.dumps({"digest": result.digest, "n_rows": result.n_rows}))
                gone += remove(self.spark, result.path)
        return gone


class Checkpoints:
    """An investigation's checkpoints in a folder: appended by compare-and-swap of the head, pruned to the newest.

    A checkpoint is a file that is named by its number and digest's start; of two processes that append at one head, one fails.
    """

    def __init__(self, spark: SparkSession, root: str, keep: int = 20):
        self.spark, self.root, self.keep = spark, root, keep

    def _log(self) -> list[dict[str, Any]]:
        return [json.loads(get(self.spark, f"{self.root}/{n}")) for n in names(self.spark, self.root) if n.endswith(".json")]

    def head(self) -> str | None:
        last = [n for n in names(self.spark, self.root) if n.endswith(".json")]
        return json.loads(get(self.spark, f"{self.root}/{last[-1]}"))["digest"] if last else None

    def append(self, expected: str | None, body: str) -> str:
        log = [n for n in names(self.spark, self.root) if n.endswith(".json")]
        head = self.head()
        at = int(log[-1].removesuffix(".json")) + 1 if log else 1
        digest = hashlib.sha256(f"{head}:{at}:{body}".encode()).hexdigest()
        if expected != head or not put(self.spark, f"{self.root}/{at:012d}.json", json.dumps({"body": body, "digest": digest})):
            raise ResultError("idempotency_conflict", "the head has moved")
        for name in log[: len(log) + 1 - self.keep]:
            remove(self.spark, f"{self.root}/{name}")
        return digest

    def read(self, digest: str) -> str:
        for entry in self._log():
            if entry["digest"] == digest:
                return entry["body"]
        raise ResultError("unavailable", "no such checkpoint")


class Workspace:
    """A folder of runs, with budgets over all of them."""

    def __init__(self, spark: SparkSession, root: str, open_runs: int = OPEN_RUNS, transport: int = WORKSPACE_TRANSPORT, retained: int = RETAINED):
        self.spark, self.root = spark, root
        self.most = {"open": open_runs, "transport": transport, "retained": retained}

    def runs(self) -> list[Run]:
        found = []
        for name in names(self.spark, self.root):
            own = get(self.spark, f"{self.root}/{name}/run.json")
            if own is not None:
                found.append(Run(self.spark, f"{self.root}/{name}", json.loads(own)["owner"]))
        return found

    def start(self, owner: str = "local", lifetime: float = LIFETIME) -> Run:
        """A new run, refused where too many are open or the budgets of delivered or kept bytes are spent."""
        runs = self.runs()
        sums = {"open": sum(not r.closed for r in runs) + 1, **{k: sum(r.counters()[k] for r in runs) for k in ("transport", "retained")}}
        if over := [k for k, n in sums.items() if n > self.most[k]]:
            raise ResultError("budget_exhausted", f"workspace: {', '.join(over)}")
        return Run(self.spark, f"{self.root}/{uuid.uuid4().hex}", owner, lifetime, ACCESSES, TRANSPORT)

    def expire(self, most: int = 100) -> int:
        """Purge closed runs and those past their lifetime, `most` in one batch; tombstones stay. Returns how many went."""
        due = [r for r in self.runs() if r.closed and get(self.spark, f"{r.root}/purged") is None][:most]
        for r in due:
            r.purge()
            put(self.spark, f"{r.root}/purged", "")
        return len(due)


@contextlib.contextmanager
def deadline(spark: SparkSession, seconds: float) -> Iterator[None]:
    """Cancel the jobs that are started inside if they take longer; the query then fails as a whole."""
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "deadline", interruptOnCancel=True)
    timer = threading.Timer(seconds, spark.sparkContext.cancelJobGroup, [group])
    timer.start()
    try:
        yield
    except Exception as e:
        if not timer.is_alive():
            raise ResultError("cancelled", f"over {seconds} s") from e
        raise
    finally:
        timer.cancel()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def visible(df: DataFrame, grants: DataFrame, scope: str) -> DataFrame:
    """Only rows whose scope is granted: a semi-join that comes before any join or aggregate of the frame."""
    return df.join(grants.select(scope).distinct(), scope, "left_semi")


def bag_digest(df: DataFrame) -> str:
    """One digest of a bag of rows, whatever their order: sums of pieces of each row's digest, which add up in any order."""
    h = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"}), 256)
    pieces = [F.sum(F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).cast("string").alias(f"p{i}") for i in range(8)]
    row = df.agg(F.count("*").cast("string").alias("n"), *pieces).first()
    return hashlib.sha256(",".join(x or "0" for x in row).encode()).hexdigest()


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two manifests hold the same bag of rows."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def text_slice(df: DataFrame, key: str, spans: DataFrame, most: int = 16 * 1024) -> DataFrame:
    """Half-open slices [start, end) of texts by code points, at most `most` long each (key, start, end, slice).

    A longer span comes as several slices.
    """
    return own_slices(spans.join(df, key), key, most)


def own_slices(df: DataFrame, key: str, most: int = 16 * 1024) -> DataFrame:
    """The same for rows that hold their text and span (key, text, start, end); nothing is shuffled.

    A longer span comes as several slices, all but the last `most` long; an empty one gives none.
    """
    cuts = df.filter(F.col("end") > F.col("start")).withColumn("_at", F.explode(F.sequence(F.col("start").cast("long"), F.col("end").cast("long") - 1, F.lit(most).cast("long"))))
    start, end = F.col("_at"), F.least(F.col("_at") + most, F.col("end"))
    return cuts.select(key, start.alias("start"), end.alias("end"), F.substring("text", start + 1, end - start).alias("slice"))
