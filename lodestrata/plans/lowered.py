"""The dialect's own meaning where Spark's differs, as edits of an admitted query's text before Spark plans it.

Spark's parser tells where in the text each expression stands. Expressions are given back as their text, with the parts
replaced that mean something else in Spark: case and ILIKE are those of ASCII, sums and averages are exact, filters of window
aggregates become CASE, casts to integers round, nulls come last in ascending order, and a quotient of integers is an integer.
Only the last needs types: the text is analysed, and edited until no quotient of integers is left.
"""

from __future__ import annotations

import datetime as dt
import re
import string
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal
from typing import Any

from pyspark.sql import DataFrame, SparkSession

_UPPER, _LOWER = string.ascii_uppercase, string.ascii_lowercase
_NULLS = re.compile(r"\bnulls\s+(first|last)\s*$", re.I)
_ANY = re.compile(r"([A-Za-z_][\w.]*)\s*=\s*any\s*\(\s*:([A-Za-z_]\w*)\s*\)", re.I)
_CYCLE = re.compile(r"\)\s*cycle\s+(\w+)\s+set\s+(\w+)\s+using\s+(\w+)", re.I)
_TABLE = re.compile(r"\btable\s+$", re.I)
_INTEGERS = frozenset("ByteType ShortType IntegerType LongType".split())
Span = tuple[int, int]


def seq(x: Any) -> Iterable[Any]:
    return (x.apply(i) for i in range(x.size()))


def name_of(x: Any) -> str:
    return x.getClass().getSimpleName()


#: Predicates whose own place leaves out the operand before them.
_AFTER = frozenset("Like ILike In InSubquery IsNull IsNotNull Not".split())


def _own_span(e: Any) -> Span | None:
    kind = name_of(e)
    if kind.endswith("$") or kind == "Literal" and _kind(e) == "BooleanType":
        return None  # one object for all, whose place is that of some other
    o = e.origin()
    return (o.startIndex().get(), o.stopIndex().get() + 1) if o.startIndex().isDefined() else None


def _subqueries(e: Any) -> list[Any]:
    return [e.plan()] if name_of(e) in ("Exists", "ScalarSubquery", "ListQuery") else []


def _parts(e: Any) -> list[Any]:
    """The expressions inside of an expression, those of its subqueries' plans among them."""
    out = list(seq(e.children()))
    for p in _subqueries(e):
        out += list(_roots(p))
    return out


def _plans(p: Any) -> Iterator[Any]:
    yield p
    if name_of(p) == "UnresolvedWith":
        for c in seq(p.cteRelations()):
            yield from _plans(c._2())
    for c in seq(p.children()):
        yield from _plans(c)


def _roots(p: Any) -> Iterator[Any]:
    """The outermost expressions of a plan and of all plans below it."""
    for q in _plans(p):
        yield from seq(q.expressions())


def parse(spark: SparkSession, sql: str) -> Any:
    return spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)


def any_arrays(sql: str, parameters: dict[str, Any]) -> tuple[str, dict[str, Any]]:
    """`column = ANY(:p)` as Spark can parse it: a membership test, false throughout for an empty array."""
    empty = {m[2] for m in _ANY.finditer(sql) if m[2] in parameters and not parameters[m[2]]}
    sql = _ANY.sub(lambda m: "(NULL IS NOT NULL)" if m[2] in empty else f"array_contains(:{m[2]}, {m[1]})", sql)
    return sql, {k: v for k, v in parameters.items() if k not in empty}


@dataclass
class Cycle:
    """The clause CYCLE node SET flag USING path, taken out of a query's text."""

    node: str
    flag: str
    path: str


def cycle_clause(sql: str) -> tuple[str, Cycle | None]:
    found = _CYCLE.search(sql)
    return (sql, None) if found is None else (sql[: found.start() + 1] + sql[found.end() :], Cycle(*found.groups()))


class _Text:
    def __init__(self, sql: str):
        self.sql = sql

    def span(self, e: Any) -> Span | None:
        """Where an expression stands with all its parts: a predicate's own place leaves its operand out."""
        own = _own_span(e)
        if own is None or name_of(e) not in _AFTER:
            return own
        starts = [s[0] for s in map(self.span, seq(e.children())) if s]
        return min([own[0], *starts]), own[1]

    def render(self, e: Any) -> str:
        return self.special(e) or self.spliced(e, _parts(e))

    def spliced(self, e: Any, parts: Iterable[Any]) -> str:
        if (place := self.span(e)) is None:
            return e.sql()
        start, stop = place
        return self.edited(start, stop, parts)

    def edited(self, start: int, stop: int, parts: Iterable[Any]) -> str:
        """The text between two places, with the parts in it rendered."""
        edits, todo = {}, list(parts)
        while todo:
            p = todo.pop()
            s = self.span(p)
            if s == (start, stop) and self.special(p) is None:
                todo += _parts(p)  # nodes that stand for all of a text, such as those of a chain of ANDs, hold their parts only
            elif s and start <= s[0] and s[1] <= stop and name_of(p) != "Literal":
                edits[s] = p
        out, at = [], start
        for (a, b), p in sorted(edits.items(), key=lambda x: (x[0][0], -x[0][1])):
            if a >= at:
                out += [self.sql[at:a], self.render(p)]
                at = b
        return "".join([*out, self.sql[at:stop]])

    def whole(self, plan: Any) -> str:
        return self.edited(0, len(self.sql), _roots(plan))

    def special(self, e: Any) -> str | None:
        return None


def literal(value: Any) -> str:
    """A bound value as a literal that holds nothing of the value's own text but digits."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return str(value) if -(2**31) < value < 2**31 else f"{value}L"
    if isinstance(value, Decimal):
        return f"{value:f}BD"
    if isinstance(value, float):
        return f"{value!r}D"
    if isinstance(value, str):
        return f"decode(X'{value.encode().hex()}', 'UTF-8')"
    if isinstance(value, dt.datetime):
        return f"TIMESTAMP'{value.isoformat(sep=' ')}'"
    if isinstance(value, dt.date):
        return f"DATE'{value.isoformat()}'"
    if isinstance(value, (list, tuple)):
        return f"array({', '.join(map(literal, value))})"
    raise ValueError(f"a value of {type(value).__name__} can't be bound")


class _Values(_Text):
    def __init__(self, sql: str, values: dict[str, Any]):
        super().__init__(sql)
        self.values = values

    def special(self, e: Any) -> str | None:
        if name_of(e) != "NamedParameter":
            return None
        value = literal(self.values[e.name()])
        return f"({value})" if value.startswith("-") else value


def with_values(spark: SparkSession, sql: str, values: dict[str, Any]) -> str:
    """The text with its values in place: Spark's own binding would shift the places that expressions are found by."""
    return _Values(sql, values).whole(parse(spark, sql)) if values else sql


class _Meaning(_Text):
    """All that needs no types."""

    def arguments(self, f: Any, keep: Any = None) -> str:
        """A function's arguments; where `keep` is given, rows without it count as null."""
        name = list(seq(f.nameParts()))[-1].lower()
        out = []
        for a in seq(f.arguments()):
            text = "*" if name_of(a) == "UnresolvedStar" or name == "count" and name_of(a) == "Literal" else self.render(a)
            if name in ("sum", "avg"):
                # fractional digits that an average of integers keeps
                text = f"({text}) + {'0BD' if name == 'sum' else '0.0000000000BD'}"
            if keep is not None:
                text = f"CASE WHEN {self.render(keep)} THEN {'1' if text == '*' else text} END"
            out.append(text)
        return f"{name}({'DISTINCT ' if f.isDistinct() else ''}{', '.join(out)})"

    def special(self, e: Any) -> str | None:
        kind = name_of(e)
        if kind == "UnresolvedFunction":
            name = list(seq(e.nameParts()))[-1].lower()
            if name in ("lower", "upper"):
                (a,) = seq(e.arguments())
                return self.cased(a, name == "lower")
            if name in ("sum", "avg"):
                given = e.filter()
                return self.arguments(e) + (f" FILTER (WHERE {self.render(given.get())})" if given.isDefined() else "")
        if kind == "WindowExpression":
            f = e.windowFunction()
            given = f.filter()
            spec = self.render(e.windowSpec())
            return f"{self.arguments(f, given.get() if given.isDefined() else None)} OVER {spec if spec.startswith('(') else f'({spec})'}"
        if kind == "ILike":
            return f"({self.cased(e.left(), True)} LIKE {self.cased(e.right(), True)})"
        if kind == "Not" and name_of(e.child()) == "ILike":
            return f"(NOT {self.render(e.child())})"
        if kind == "Cast" and name_of(e.dataType()).startswith("LongType"):
            return f"CAST(round({self.render(e.child())}) AS BIGINT)"
        if kind == "SortOrder":
            text = self.spliced(e, _parts(e))
            return text if _NULLS.search(text) else text + (" NULLS LAST" if name_of(e.direction()) == "Ascending$" else " NULLS FIRST")
        return None

    def cased(self, e: Any, low: bool) -> str:
        return f"translate({self.render(e)}, '{_UPPER if low else _LOWER}', '{_LOWER if low else _UPPER}')"


class _Quotients(_Text):
    def __init__(self, sql: str, whole: set[Span]):
        super().__init__(sql)
        self.integral = whole

    def special(self, e: Any) -> str | None:
        if name_of(e) == "Divide" and _own_span(e) in self.integral:
            return f"({self.render(e.left())} div {self.render(e.right())})"
        return None


def explicit_nulls(sql: str, order: Any) -> bool:
    """Whether a sort key says where nulls go."""
    start, stop = _Text(sql).span(order)
    return _NULLS.search(sql[start:stop]) is not None


def _analysed(plan: Any) -> Iterator[Any]:
    """All expressions of an analysed plan; what views are made of is left out."""

    def inside(e: Any) -> Iterator[Any]:
        yield e
        for c in seq(e.children()):
            yield from inside(c)
        for p in _subqueries(e):
            yield from _analysed(p)

    if name_of(plan) == "View":
        return
    for e in seq(plan.expressions()):
        yield from inside(e)
    for c in seq(plan.children()):
        yield from _analysed(c)


def _bare(e: Any) -> Any:
    """An operand without the casts that the analyser has put around it."""
    while name_of(e) == "Cast" and name_of(e.dataType()).startswith("DoubleType"):
        e = e.child()
    return e


def _kind(e: Any) -> str:
    return name_of(e.dataType()).rstrip("$")


def quotients_of_integers(analysed: Any, sql: str) -> set[Span]:
    """Places of the quotients whose operands are both integers."""
    found = set()
    for e in _analysed(analysed):
        if name_of(e) == "Divide" and e.origin().sqlText().isDefined() and e.origin().sqlText().get() == sql and all(_kind(_bare(x)) in _INTEGERS for x in (e.left(), e.right())):
            found.add(_own_span(e))
    return found


def coerced_arms(plan: Any, sql: str) -> bool:
    """Whether the analyser had to cast a column of a set operation's arm."""
    if name_of(plan) == "View":
        return False
    if name_of(plan) in ("Union", "Intersect", "Except"):
        for arm in seq(plan.children()):
            for e in seq(arm.projectList()) if name_of(arm) == "Project" else ():
                cast = e.child() if name_of(e) == "Alias" else None
                if cast is not None and name_of(cast) == "Cast":
                    s = _own_span(cast)
                    if s is None or not sql[s[0] : s[1]].lower().startswith("cast"):
                        return True
    return any(coerced_arms(c, sql) for c in seq(plan.children()))


def wrong_casts(analysed: Any, sql: str) -> bool:
    """Whether a cast that the query itself asks for has another source than a number."""
    for e in _analysed(analysed):
        s = _own_span(e) if name_of(e) == "Cast" else None
        if s and e.origin().sqlText().isDefined() and e.origin().sqlText().get() == sql and sql[s[0] : s[1]].lower().startswith("cast") and _kind(e.child()) not in _INTEGERS | {"DecimalType"}:
            return True
    return False


def lowered(spark: SparkSession, sql: str) -> str:
    """An admitted query's text with the dialect's meaning, but for quotients."""
    return _Meaning(sql).whole(parse(spark, sql))


def run(spark: SparkSession, sql: str) -> tuple[DataFrame, str]:
    """The rows of a lowered text, after its quotients of integers are made such; and the last text."""
    while True:
        df = spark.sql(sql)
        whole = quotients_of_integers(df._jdf.queryExecution().analyzed(), sql)
        after = _Quotients(sql, whole).whole(parse(spark, sql)) if whole else sql
        if after == sql:
            return df, sql
        sql = after


@dataclass
class Recursion:
    """A bounded recursion as a query declares it: the CTE, its columns of depth and node, and the greatest depth."""

    cte: str
    depth: str
    node: str
    most: int
    #: Predicates that each step must meet, over the names in scope there, such as `e.support_eligible`.
    guards: tuple[str, ...] = ()


def _readers(plan: Any, name: str, own: Any, aliased: bool = False) -> Iterator[tuple[Span, bool]]:
    """Where a plan reads a relation, and whether an alias follows there; the CTE `own` is left out."""
    if name_of(plan) == "UnresolvedRelation" and list(seq(plan.multipartIdentifier())) == [name]:
        yield _own_span(plan), aliased
    ctes = [c._2() for c in seq(plan.cteRelations())] if name_of(plan) == "UnresolvedWith" else []
    for p in [*seq(plan.children()), *(c for c in ctes if not c.equals(own))]:
        yield from _readers(p, name, own, name_of(plan) in ("SubqueryAlias", "UnresolvedSubqueryColumnAliases"))
    todo = list(seq(plan.expressions()))
    while todo:
        e = todo.pop()
        todo += seq(e.children())
        for p in _subqueries(e):
            yield from _readers(p, name, own)


def guarded(sql: str, plan: Any, rule: Recursion, cycle: Cycle | None) -> str:
    """The recursive CTE with its guards put in: the depth bound, the given predicates, and a path that ends at a cycle.

    A row is flagged when its node already stands on its own path; flagged rows are kept and not followed. The shape of the
    CTE has been checked: columns named, a seed and one arm with a WHERE. The depth alone ends the recursion: wherever it is
    read, LIMIT ALL lifts the million rows after which Spark gives up.
    """
    text = _Text(sql)
    (cte,) = [c for c in seq(plan.cteRelations()) if c._1() == rule.cte]
    named = cte._2().child()
    columns = list(seq(named.outputColumnNames()))
    seed, arm = seq(named.child().children())
    at = columns.index(rule.node)
    edits: list[tuple[int, int, str]] = []

    def item(p: Any, k: int) -> tuple[str, int]:
        e = list(seq(p.projectList()))
        inner = e[k].child() if name_of(e[k]) == "Alias" else e[k]
        a, b = text.span(inner)
        return sql[a:b], text.span(e[-1])[1]

    condition = arm.child().condition()
    a, b = text.span(condition)
    guards = [f"({sql[a:b]})", f"{rule.cte}.{rule.depth} < {rule.most}", *rule.guards]
    if cycle is not None:
        node, end = item(seed, at)
        edits.append((end, end, f", false AS {cycle.flag}, array({node}) AS {cycle.path}"))
        node, end = item(arm, at)
        edits.append((end, end, f", array_contains({rule.cte}.{cycle.path}, {node}) AS {cycle.flag}, concat({rule.cte}.{cycle.path}, array({node})) AS {cycle.path}"))
        guards.append(f"NOT {rule.cte}.{cycle.flag}")
        # the column list ends where the text of the CTE has its first closing bracket
        close = sql.index(")", _own_span(cte._2())[0])
        edits.append((close, close, f", {cycle.flag}, {cycle.path}"))
    edits.append((a, b, " AND ".join(guards)))
    for (a, b), aliased in _readers(plan, rule.cte, cte._2()):
        whole, alone = f"(SELECT * FROM {rule.cte} LIMIT ALL)", _TABLE.search(sql, 0, a)
        if alone:  # TABLE p
            edits.append((alone.start(), b, f"SELECT * FROM {whole} AS {rule.cte}"))
        else:
            edits.append((a, b, whole if aliased else f"{whole} AS {rule.cte}"))
    for a, b, new in sorted(edits, reverse=True):
        sql = sql[:a] + new + sql[b:]
    return sql
