"""A JSON schema compiled into column rules over raw documents held as VARIANT.

`compiled` turns a schema (type, const, enum, required, properties, additionalProperties, items, minItems, minimum, maximum, pattern) into one
column that lists a document's violations, each as ``path: rule``; the root's path is ``<root>`` and items are named by their place. A value of
the wrong type breaks that rule only. Nothing is parsed twice and no Python runs: the schema is walked once, while the plan is built."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def _kind(v: Column) -> Column:
    """The JSON type of a variant: object, array, string, boolean, null, integer or number."""
    name = F.schema_of_variant(v)
    whole = F.try_variant_get(v, "$", "double")
    return (F.when(name.startswith("OBJECT"), "object").when(name.startswith("ARRAY"), "array").when(name == "STRING", "string")
            .when(name == "BOOLEAN", "boolean").when(name == "VOID", "null").when(whole == F.floor(whole), "integer").otherwise("number"))


def _is(v: Column, kind: Column, types: list[str]) -> Column:
    return kind.isin(*types, *(["integer"] if "number" in types else []))


def _text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _equals(v: Column, kind: Column, value) -> Column:
    if value is None:
        return kind == "null"
    if isinstance(value, bool):
        return (kind == "boolean") & (F.try_variant_get(v, "$", "boolean") == F.lit(value))
    if isinstance(value, str):
        return (kind == "string") & (_text(v) == F.lit(value))
    return kind.isin("integer", "number") & (F.try_variant_get(v, "$", "double") == F.lit(float(value)))


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once."""
    return F.transform(F.array(value), use)[0]


def compiled(v: Column, schema: dict, path: Column) -> Column:
    """The violations of ``schema`` by the variant ``v`` (never NULL), an array of texts."""

    def told(rule) -> Column:
        return F.concat(F.when(path == "", "<root>").otherwise(path), F.lit(": "), rule if isinstance(rule, Column) else F.lit(rule))

    def inside(name: Column) -> Column:
        return F.concat(path, F.when(path == "", "").otherwise("/"), name)

    def rules(kind: Column) -> Column:
        flat, parts = [], []
        if "type" in schema:
            types = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
            flat.append((~_is(v, kind, types), told("type")))
        if "const" in schema:
            flat.append((~_equals(v, kind, schema["const"]), told("const")))
        if "enum" in schema:
            known = F.lit(False)
            for value in schema["enum"]:
                known = known | F.coalesce(_equals(v, kind, value), F.lit(False))
            flat.append((~known, told("enum")))
        number = F.try_variant_get(v, "$", "double")
        if "minimum" in schema:
            flat.append((_is(v, kind, ["number"]) & (number < schema["minimum"]), told("minimum")))
        if "maximum" in schema:
            flat.append((_is(v, kind, ["number"]) & (number > schema["maximum"]), told("maximum")))
        if "pattern" in schema:
            flat.append(((kind == "string") & ~_text(v).rlike(schema["pattern"]), told("pattern")))
        if flat:
            parts.append(F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), says) for bad, says in flat])))
        none = F.array().cast("array<string>")
        if {"required", "properties", "additionalProperties"} & set(schema):
            fields = F.try_variant_get(v, "$", "map<string,variant>")
            parts.append(F.when(kind == "object", _once(fields, of_fields)).otherwise(none))
        if {"items", "minItems"} & set(schema):
            parts.append(F.when(kind == "array", _once(F.try_variant_get(v, "$", "array<variant>"), of_items)).otherwise(none))
        return F.concat(*parts) if parts else none

    def of_fields(fields: Column) -> Column:
        names, given, parts = F.map_keys(fields), schema.get("properties", {}), []
        lacks = [F.when(~F.array_contains(names, n), told(f"required {n}")) for n in schema.get("required", [])]
        if lacks:
            parts.append(F.array_compact(F.array(*lacks)))
        for n, sub in given.items():
            child = F.try_element_at(fields, F.lit(n))
            parts.append(F.when(F.array_contains(names, n), compiled(child, sub, inside(F.lit(n)))).otherwise(F.array().cast("array<string>")))
        more = schema.get("additionalProperties", True)
        others = F.array_sort(F.filter(names, lambda n: ~n.isin(*given)) if given else names)
        if more is False:
            parts.append(F.transform(others, lambda n: told(F.concat(F.lit("additional "), n))))
        elif isinstance(more, dict):
            parts.append(F.flatten(F.transform(others, lambda n: compiled(F.try_element_at(fields, n), more, inside(n)))))
        return F.concat(*parts) if parts else F.array().cast("array<string>")

    def of_items(items: Column) -> Column:
        parts = []
        if "minItems" in schema:
            parts.append(F.array_compact(F.array(F.when(F.size(items) < schema["minItems"], told("minItems")))))
        if "items" in schema:
            parts.append(F.flatten(F.transform(items, lambda x, i: compiled(x, schema["items"], inside(i.cast("string"))))))
        return F.concat(*parts)

    return _once(_kind(v), rules)


def schema_errors(documents: DataFrame, schema: dict, text: str = "body") -> DataFrame:
    """``documents`` with ``errors``: the violations of each raw document (JSON text) in the order of the schema. A text that is no JSON, or no
    text, has the one error ``<root>: not a document``."""
    parsed = documents.withColumn("_v", F.try_parse_json(text))
    errors = F.when(F.col("_v").isNull(), F.array(F.lit("<root>: not a document"))).otherwise(compiled(F.col("_v"), schema, F.lit("")))
    return parsed.withColumn("errors", errors).drop("_v")


def unknown_slots(documents: DataFrame, text: str = "body") -> DataFrame:
    """``documents`` with ``lost``: the first slot that an input names and no player has; an unknown slot names none."""
    v = F.try_parse_json(text)
    slots = F.try_variant_get(v, "$.players", "array<struct<slot long>>")
    named = F.try_variant_get(v, "$.observations.inputs", "array<struct<slot long>>")
    lost = F.filter(F.transform(named, lambda x: x["slot"]), lambda s: s.isNotNull() & ~F.coalesce(F.array_contains(F.transform(slots, lambda p: p["slot"]), s), F.lit(False)))
    return documents.withColumn("lost", F.get(lost, 0))


def valid(documents: DataFrame, schema: dict, text: str = "body") -> DataFrame:
    """`schema_errors` with the rule a schema can't state: an input of a slot that no player has."""
    told = unknown_slots(schema_errors(documents, schema, text), text)
    says = F.when(F.col("lost").isNotNull(), F.concat(F.lit("input references unknown slot "), F.col("lost").cast("string")))
    return told.withColumn("errors", F.array_compact(F.concat("errors", F.array(says)))).drop("lost")


# The contract of a match document, version 1.1.
_TEXT, _MAYBE_TEXT, _WHOLE, _MAYBE_WHOLE = {"type": "string"}, {"type": ["string", "null"]}, {"type": "integer"}, {"type": ["integer", "null"]}
_FRAME, _MAYBE_BOOL = {"type": "integer", "minimum": 0}, {"type": ["boolean", "null"]}


def _closed(required: list[str], **properties) -> dict:
    return {"type": "object", "required": required, "additionalProperties": False, "properties": properties}


def _list(items: dict, **more) -> dict:
    return {"type": "array", "items": items, **more}


MATCH_DOCUMENT = _closed(
    ["schema_version", "analyzer_version", "match", "players", "observations", "analysis", "provenance"],
    schema_version={"type": "string", "const": "1.1"},
    analyzer_version=_TEXT,
    match=_closed(
        ["id", "game", "fps", "duration_frames"], id=_TEXT, source_file=_MAYBE_TEXT, game=_TEXT, patch=_MAYBE_TEXT, fps={"type": "integer", "minimum": 1},
        duration_frames=_FRAME, playlist=_MAYBE_TEXT, online=_MAYBE_BOOL, level_id=_MAYBE_WHOLE, level_name=_MAYBE_TEXT, has_video={"type": "boolean"},
        video_offset_frames=_MAYBE_WHOLE, outcome={"type": ["object", "null"], "additionalProperties": {"enum": ["win", "loss", "draw"]}},
        outcome_source={"type": ["string", "null"], "enum": ["deaths", "result_field", None]},
        death_counts={"type": ["object", "null"], "additionalProperties": _WHOLE}, video_path=_MAYBE_TEXT),
    players=_list(_closed(
        ["slot"], slot=_FRAME, entity_id=_MAYBE_WHOLE, display_name=_MAYBE_TEXT, identity_id=_MAYBE_TEXT, team=_MAYBE_WHOLE, is_bot=_MAYBE_BOOL,
        character={"type": ["object", "null"], "properties": {"id": _MAYBE_WHOLE, "name": _MAYBE_TEXT}, "additionalProperties": False}), minItems=1),
    observations=_closed(
        ["inputs"], inputs=_list(_closed(["slot", "frame", "action"], slot=_MAYBE_WHOLE, frame=_FRAME, action=_TEXT)),
        kos=_list(_closed(["slot", "frame"], slot=_MAYBE_WHOLE, frame=_FRAME)),
        damage=_list(_closed(["slot", "seconds", "estimate"], slot=_WHOLE, seconds={"type": "number"}, estimate={"type": "number", "minimum": 0, "maximum": 1}))),
    analysis=_closed(
        ["moments"], moments=_list(_closed(
            ["id", "frame", "kind", "severity"], id={"type": "string", "pattern": "^m_[0-9a-f]+$"}, slot=_MAYBE_WHOLE, frame=_FRAME, kind=_TEXT,
            severity={"type": "integer", "minimum": 1, "maximum": 5}, title=_MAYBE_TEXT, detail=_MAYBE_TEXT, evidence={"type": ["object", "null"]},
            feedback={"type": ["object", "null"], "properties": {"verdict": {"enum": ["agree", "disagree", "unsure", None]}, "note": _MAYBE_TEXT}})),
        metrics={"type": ["object", "null"]}),
    provenance=_closed(
        ["parser"], parser=_TEXT, frame_data_patch=_MAYBE_TEXT, confidence={"type": "object", "additionalProperties": {"enum": ["high", "partial", "low", "missing"]}},
        warnings=_list(_TEXT)))
