"""Property graphs in JSON: entities of five tables, edges of five."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Table, entity type, and JSON key by axis.
_COMMON = {"current_status": "currentStatus", "system_type": "type", "ml_task": "MLTask", "civic_use": "civicUse", "purpose": "purpose", "capacity": "capacity", "output": "output", "impact": "impact"}
NODE_TABLES = (
    ("N_Systems", "System", _COMMON | {"military_use": "militaryUse"}),
    ("N_Stakeholders", "Stakeholder", {"stakeholder_type": "type", "airo_type": "airo:type"}),
    ("N_Civic", "Civic", _COMMON),
    ("N_Historical", "Historical", _COMMON | {"military_use": "militaryUse"}),
    ("N_People", "Person", {"person_type": "type", "airo_type": "airo:type"}),
)
EDGE_TABLES = (("E_isDevelopedBy", "Develops"), ("E_isDeployedBy", "Deploys"), ("E_connection", "Connection"), ("E_people", "People"), ("E_place", "Place"))
#: Axis, prefix of its tokens, whether its value is a list between commas; in the order of tokens.
AXES = (
    ("current_status", "status", False),
    ("system_type", "type", True),
    ("ml_task", "ml", False),
    ("military_use", "mil", True),
    ("civic_use", "civic", False),
    ("purpose", "purpose", False),
    ("capacity", "cap", True),
    ("output", "output", False),
    ("impact", "impact", True),
    ("stakeholder_type", "stype", False),
    ("airo_type", "airo", True),
    ("person_type", "ptype", True),
)
#: Strength of an edge by type.
AMPLITUDES = {"Develops": 1.0, "Deploys": 0.9, "Connection": 0.7, "People": 0.8, "Place": 0.6}


def _schema() -> T.StructType:
    text = lambda names: T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in names]))
    nodes = [T.StructField(table, text(["id", "name", *dict.fromkeys(axes.values())])) for table, _, axes in NODE_TABLES]
    return T.StructType([*nodes, *[T.StructField(table, text(["source", "target", "label"])) for table, _ in EDGE_TABLES]])


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """entities(index, id, name, entity_type, axes struct) and edges(seq, source_id, target_id, edge_type, label) of a JSON file.

    A missing id, name or end is "", a missing axis or label null. index counts
    entities by table and place, seq edges likewise. A broken file fails.
    """
    document = spark.read.option("multiLine", True).option("mode", "FAILFAST").schema(_schema()).json(path)
    sizes = document.select(*[F.coalesce(F.size(t), F.lit(0)).alias(t) for t, *_ in (*NODE_TABLES, *EDGE_TABLES)]).first()
    entities, edges, start = [], [], 0
    for table, kind, axes in NODE_TABLES:
        rows = document.select(F.posexplode(table).alias("p", "e"))
        struct = F.struct(*[(F.col("e").getField(axes[a]) if a in axes else F.lit(None).cast("string")).alias(a) for a, _, _ in AXES])
        entities.append(rows.select((F.col("p") + start).cast("long").alias("index"), F.coalesce("e.id", F.lit("")).alias("id"), F.coalesce("e.name", F.lit("")).alias("name"), F.lit(kind).alias("entity_type"), struct.alias("axes")))
        start += max(0, sizes[table])
    start = 0
    for table, kind in EDGE_TABLES:
        rows = document.select(F.posexplode(table).alias("p", "e"))
        edges.append(rows.select((F.col("p") + start).cast("long").alias("seq"), F.coalesce("e.source", F.lit("")).alias("source_id"), F.coalesce("e.target", F.lit("")).alias("target_id"), F.lit(kind).alias("edge_type"), F.col("e.label").alias("label")))
        start += max(0, sizes[table])
    whole = lambda frames: frames[0] if len(frames) == 1 else frames[0].unionByName(whole(frames[1:]))
    return whole(entities), whole(edges)


def axis_tokens(axes: str | Column = "axes") -> Column:
    """array<string> of axis:value tokens in fixed order; lists are split at commas, trimmed, and lose empty parts."""
    struct = F.col(axes) if isinstance(axes, str) else axes
    none = F.array().cast("array<string>")
    parts = []
    for axis, prefix, many in AXES:
        value = struct.getField(axis)
        if many:
            found = F.filter(F.transform(F.split(value, ","), lambda p: F.trim(p)), lambda p: p != "")
            found = F.transform(found, _prefixed(prefix))
        else:
            found = F.array(F.concat(F.lit(f"{prefix}:"), value))
        parts.append(F.when(value.isNull(), none).otherwise(found))
    return F.concat(*parts)


def _prefixed(prefix: str):
    return lambda p: F.concat(F.lit(f"{prefix}:"), p)


def amplitude(edge_type: str | Column = "edge_type") -> Column:
    column = F.col(edge_type) if isinstance(edge_type, str) else edge_type
    return F.element_at(F.create_map(*[x for k, v in AMPLITUDES.items() for x in (F.lit(k), F.lit(v))]), column)
