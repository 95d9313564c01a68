"""The typed logical relations of the dialect: columns, keys, and which identifiers a column refers to."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names, columns, nullability (? after the type) and keys of the relations.
RELATIONS = """
observations(bead_version_id): bead_id string, bead_version_id string, event_id string, source_unit_id string, bead_type_key string, bead_type_revision_id string, title string?, summary string?, detail string?, render_state string, recorded_at timestamp, effective_at timestamp?, effective_basis string, correction_state string
statements(statement_id): statement_id string, bead_id string, bead_version_id string, sequence bigint, kind string, text string, supersedes_statement_id string?, correction_reason string?, recorded_at timestamp
statement_sources(statement_id, source_unit_id, content_sha256): statement_id string, source_unit_id string, event_id string, content_sha256 string, evidence_ref string
source_units(source_unit_id, content_sha256): source_unit_id string, content_sha256 string, event_id string, source_object_id string, source_kind string, package_revision_id string?, search_text string?, text_state string, source_occurred_at timestamp?, source_time_original string?, source_timezone string?, source_precision string, recorded_at timestamp, actor_ref string?, actor_role string?, trust_label string?, occurrence_ref string?
corrections(predecessor_version_id, successor_version_id): predecessor_version_id string, successor_version_id string, predecessor_bead_id string, successor_bead_id string, reason string, recorded_at timestamp
assessed_relations(relation_id): relation_id string, task_id string, type_key string, type_revision bigint, source_bead_id string, source_bead_version_id string, target_bead_id string, target_bead_version_id string, basis string, rationale string, qualification string?, author_confidence decimal(38,10), author_run_ref string, specialist_run_ref string, acceptance_receipt_id string, recorded_at timestamp, state string, head_token string, support_eligible boolean, support_reason string?, correction_pending boolean, roots_status string, independent_root_count bigint?
relation_statements(relation_id, role, statement_id): relation_id string, role string, statement_id string, bead_id string, bead_version_id string, text string
relation_evidence(relation_id, statement_id, source_unit_id): relation_id string, statement_id string, source_unit_id string, content_sha256 string, evidence_ref string, roots_status string
relation_events(event_id): event_id string, relation_id string, action string, related_relation_id string?, reason string, origin string, authoring_bead_id string?, effective_at timestamp?, recorded_at timestamp, event_number bigint?, previous_event_id string?, recorded_by_principal_id string, recorded_by_user_id string?, idempotency_receipt_id string
relation_event_evidence(event_id, statement_id, source_unit_id): event_id string, statement_id string, source_unit_id string, bead_id string, bead_version_id string, statement_text string, content_sha256 string, evidence_ref string
relation_types(type_key, type_revision): type_key string, type_revision bigint, namespace string, label string, definition string, endpoint_rule string, forward_reading string, inverse_reading string, symmetric boolean, evidence_expectation string?, example string?, counterexample string?, cycle_policy string
relation_pairs(task_id, first_bead_id, second_bead_id): task_id string, first_bead_id string, second_bead_id string, first_bead_version_id string, second_bead_version_id string, disposition string, abstention string?, reason string?
relation_corrections(relation_id, role, correcting_bead_version_id): relation_id string, role string, correcting_bead_id string, correcting_bead_version_id string
relation_replacements(relation_id, replacement_relation_id): relation_id string, replacement_relation_id string
"""
# Ends of column names and the kind of identifier that such a column refers to.
KINDS = {"bead_version_id": "bead_version", "version_id": "bead_version", "bead_id": "bead", "statement_id": "statement", "source_unit_id": "source_unit", "evidence_ref": "evidence", "relation_id": "relation", "event_id": "event", "task_id": "task", "content_sha256": "content", "type_key": "type"}


# Where a relation's rows get their visibility from, as column, relation and column there; all must be visible.
# Relations of captured events have the scope column themselves, and the vocabulary is everyone's.
SCOPED = frozenset("observations source_units statement_sources".split())
OPEN = frozenset(["relation_types"])
VIA = {
    "statements": [("bead_version_id", "observations", "bead_version_id")],
    "corrections": [("predecessor_version_id", "observations", "bead_version_id"), ("successor_version_id", "observations", "bead_version_id")],
    "assessed_relations": [("source_bead_version_id", "observations", "bead_version_id"), ("target_bead_version_id", "observations", "bead_version_id")],
    "relation_statements": [("relation_id", "assessed_relations", "relation_id")],
    "relation_evidence": [("relation_id", "assessed_relations", "relation_id"), ("source_unit_id", "source_units", "source_unit_id")],
    "relation_events": [("relation_id", "assessed_relations", "relation_id")],
    "relation_event_evidence": [("event_id", "relation_events", "event_id"), ("source_unit_id", "source_units", "source_unit_id")],
    "relation_pairs": [("first_bead_version_id", "observations", "bead_version_id"), ("second_bead_version_id", "observations", "bead_version_id")],
    "relation_corrections": [("relation_id", "assessed_relations", "relation_id")],
    "relation_replacements": [("relation_id", "assessed_relations", "relation_id"), ("replacement_relation_id", "assessed_relations", "relation_id")],
}


_TYPES = {"string": T.StringType(), "bigint": T.LongType(), "timestamp": T.TimestampType(), "boolean": T.BooleanType(), "decimal": T.DecimalType(38, 10)}


@dataclass(frozen=True)
class Relation:
    name: str
    schema: T.StructType
    keys: tuple[str, ...]

    def kind(self, column: str) -> str | None:
        """What a column's identifiers refer to, or None for a plain value."""
        return next((kind for end, kind in sorted(KINDS.items(), key=lambda x: -len(x[0])) if column.endswith(end)), None)


def relations() -> dict[str, Relation]:
    out = {}
    for line in RELATIONS.strip().splitlines():
        head, _, columns = line.partition("): ")
        name, _, keys = head.partition("(")
        fields = []
        for column in columns.replace("decimal(38,10)", "decimal").split(", "):
            field, kind = column.split(" ")
            plain = kind.rstrip("?")
            fields.append(T.StructField(field, _TYPES[plain], kind.endswith("?")))
        out[name] = Relation(name, T.StructType(fields), tuple(keys.split(", ")))
    return out


class PopulationError(ValueError):
    """A population breaks its relation's schema, nullability or key."""


def check(df: DataFrame, relation: Relation) -> None:
    """Types, nulls and key uniqueness of a relation's rows (one job); raises PopulationError."""
    for f in relation.schema:
        if f.name not in df.columns or df.schema[f.name].dataType != f.dataType:
            raise PopulationError(f"{relation.name}.{f.name} is not a {f.dataType.simpleString()}")
    nulls = [F.count_if(F.col(f.name).isNull()).alias(f.name) for f in relation.schema if not f.nullable]
    found = df.agg(*nulls).first().asDict()
    if bad := [c for c, n in found.items() if n]:
        raise PopulationError(f"{relation.name} has nulls in {', '.join(bad)}")
    if not df.groupBy(*relation.keys).count().filter("count > 1").isEmpty():
        raise PopulationError(f"{relation.name} repeats a key")


def register(spark: SparkSession, frame: dict[str, DataFrame], known_at: str | None = None, grants: DataFrame | None = None, scope: str = "event_id", checked: bool = True) -> dict[str, DataFrame]:
    """A frame's relations as views that queries can name: recorded by known_at, visible under the grants, checked.

    Visibility comes before anything that a query does: a semi-join with the grants on the relations of captured events, and
    with the visible rows of what they refer to on all others. A relation whose visibility can't be told, as what it refers to
    is not in the frame, is refused.
    """
    known = relations()
    views = {}
    if unknown := sorted(set(frame) - set(known)):
        raise PopulationError(f"unknown relation {unknown[0]}")
    cut = {}

    def visible(name: str) -> DataFrame:
        if name in cut:
            return cut[name]
        if name not in frame:
            raise PopulationError(f"visibility needs the relation {name}")
        df = frame[name]
        if known_at is not None and "recorded_at" in df.columns:
            df = df.filter(F.col("recorded_at") <= F.lit(known_at).cast("timestamp"))
        if grants is not None and name in SCOPED:
            df = df.join(grants.select(scope).distinct(), scope, "left_semi")
        elif grants is not None and name not in OPEN:
            for column, other, key in VIA[name]:
                df = df.join(visible(other).select(F.col(key).alias(column)).distinct(), column, "left_semi")
        cut[name] = df
        return df

    for name in frame:
        df = visible(name)
        df = df.select(*[f.name for f in known[name].schema])
        if checked:
            check(df, known[name])
        df.createOrReplaceTempView(name)
        views[name] = df
    return views
