"""Stack documents: JSON records of operations, decoded by the schema of each operation, with migration of version 1."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stages import STAGES, WHITE

FORMAT, VERSION = "pixelstrata-stack", 2


def encode_stack(records: list[dict]) -> str:
    plain = [
        {
            "id": r["id"], "enabled": r.get("enabled", True), "folded": r.get("folded", False),
            "settings": {k: v for k, v in r.get("settings", {}).items() if k != "model"}
        }
        for r in records
    ]
    return json.dumps({"format": FORMAT, "version": VERSION, "stack": plain}, sort_keys=True)


def _fitting(default, value):
    """The value if it has the kind of the default, else the default."""
    if isinstance(default, bool) or isinstance(value, bool):
        return value if isinstance(default, bool) and isinstance(value, bool) else default
    if isinstance(default, (int, float)):
        return value if isinstance(value, (int, float)) else default
    if isinstance(default, str):
        return value if isinstance(value, str) else default
    if isinstance(default, (list, tuple)):
        return value if isinstance(value, (list, tuple)) else default
    return default


def decode_stack(text: str) -> tuple[list[dict], list[str]]:
    """Records with whole settings, and warnings: unknown operations are left out, wrong kinds keep their default, a newer
    version gives nothing, version 1 is migrated."""
    warnings: list[str] = []
    try:
        doc = json.loads(text)
    except (TypeError, ValueError):
        return [], ["not JSON"]
    if not isinstance(doc, dict) or not isinstance(doc.get("version", 1), int):
        return [], ["no stack document"]
    if doc.get("version", 1) > VERSION:
        return [], ["newer version"]
    stack = doc.get("stack", []) if doc.get("version", 1) == VERSION else migrated(doc)
    out = []
    for record in stack if isinstance(stack, list) else []:
        stage = STAGES.get(record.get("id")) if isinstance(record, dict) else None
        if stage is None:
            warnings.append("unknown operation")
            continue
        given = record.get("settings") if isinstance(record.get("settings"), dict) else {}
        fitting = {k: _fitting(d, given.get(k, d)) for k, d in stage.defaults.items()}
        out.append({"id": record["id"], "enabled": record.get("enabled") is not False, "folded": record.get("folded") is True, "settings": stage.settings(fitting)})
    return out, warnings


#: The fields of a version 1 block, by operation and setting, with their defaults. Operations stand in this order.
V1_FIELDS = {
    "polygon_edit": {"regions": ("polygons", [])},
    "remove_background": {"remove_colors": ("remove_colors", WHITE), "edge_width": ("edge_width", 2), "contiguous": ("contiguous", True), "decontaminate": ("decontaminate", True), "bleed_radius": ("bleed_radius", 16)},
    "island_picker": {"islands": ("islands", []), "edge_width": ("edge_width", 2)},
    "remove_crevice": {"reach": ("crevice_reach", 0), "tolerance": ("crevice_tolerance", 0.5)},
    "refine_edges": {"radius": ("refine_radius", 2), "floor": ("alpha_floor", 0.0), "ceiling": ("alpha_ceiling", 1.0)},
    "edge_cleanup": {"inner": ("inner_stroke_width", 0.5), "outer": ("outer_stroke_width", 0.5), "softness": ("stroke_softness", 0.75), "auto_color": ("auto_stroke_color", False), "stroke_color": ("stroke_color", [0.0, 0.0, 0.0, 1.0])},
}


def _listed(value):
    """A list that version 1 may have kept in a record (entries or regions)."""
    if isinstance(value, dict):
        value = value.get("entries", value.get("regions", []))
    return value if isinstance(value, list) else []


def migrated(doc: dict) -> list[dict]:
    """Version 1 kept everything in one block; it becomes the operations that the block was using: the matte always,
    the others where they had something to do. Missing and misfitting fields have their version 1 default."""
    operations = doc.get("operations", {})
    block = operations.get("remove_background", {}) if isinstance(operations, dict) else None
    if not isinstance(block, dict):
        return []
    lists = ("polygons", "islands", "remove_colors")
    read = {
        id: {
            k: _listed(block[old]) if old in lists and old in block else _fitting(default, block.get(old, default)) for k,
            (old, default) in fields.items()
        } for id,
        fields in V1_FIELDS.items()
    }
    flag = lambda name, default: _fitting(default, block.get(name, default))
    if not flag("refine_edges", False):
        read["refine_edges"]["radius"] = 0
    refine = read["refine_edges"]
    used = {
        "polygon_edit": bool(read["polygon_edit"]["regions"]),
        "remove_background": True,
        "island_picker": bool(read["island_picker"]["islands"]),
        "remove_crevice": read["remove_crevice"]["reach"] > 0,
        "refine_edges": flag("refine_edges", False) or refine["floor"] > 0.0 or refine["ceiling"] < 1.0,
        "edge_cleanup": flag("edge_cleanup", True),
    }
    return [{"id": id, "enabled": True, "settings": settings} for id, settings in read.items() if used[id]]


def decoded(rows: DataFrame, column: str, fields: dict[str, str]) -> DataFrame:
    """rows with the named fields of a JSON column; a missing or wrong value is null (the default at its reader)."""
    schema = T.StructType([T.StructField(k, T._parse_datatype_string(v)) for k, v in fields.items()])
    held = rows.withColumn("_json", F.from_json(column, schema))
    return held.select("*", *(F.col(f"_json.{k}").alias(k) for k in fields)).drop("_json")


def settings_records(stacks: DataFrame) -> DataFrame:
    """(doc, place, id, enabled, settings) of each record of stack documents (doc, text); settings stay JSON."""
    schema = "struct<version:int,stack:array<struct<id:string,enabled:boolean,settings:string>>>"
    held = stacks.withColumn("d", F.from_json("text", schema)).filter(F.col("d.version") == VERSION)
    return held.select("doc", F.posexplode("d.stack").alias("place", "r")).select(
        "doc", "place", "r.id", F.coalesce("r.enabled", F.lit(True)).alias("enabled"), "r.settings"
    )
