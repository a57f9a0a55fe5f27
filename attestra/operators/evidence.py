"""What a reader sees of a locator: the facts of its kind, and for a field of a stored JSON
record the value and the record around it, by a path that differs from row to row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STEP = r"\.[A-Za-z_][A-Za-z0-9_]*|\['[^']*'\]|\[[0-9]{1,9}\]"
EXCERPT = 600

# The labels of a locator's facts and the fields that they show.
FACTS = {
    "EXCEL_CELL": (("Hoja", "sheet"), ("Celda", "cell")),
    "HTML_SELECTOR": (("Página capturada", "url"), ("Selector CSS", "selector"), ("Momento de la captura", "captured_at")),
    "API_FIELD": (("Endpoint consultado", "endpoint"), ("Registro", "record_id"), ("Ruta dentro del JSON", "json_path"), ("Versión del contrato", "contract_version")),
    "DERIVED": (("Regla que lo calculó", "rule"),),
}


def facts(locator: Column, fields: list[str]) -> Column:
    """Array of (label, value) of a locator struct with these fields; a missing value is
    empty, and a kind without facts has none."""
    value = lambda f: F.coalesce(locator[f].cast("string"), F.lit("")) if f in fields else F.lit("")
    empty = F.array().cast("array<struct<label:string,value:string>>")
    chosen = F.when(F.lit(False), empty)
    for kind, shown in FACTS.items():
        chosen = chosen.when(locator["kind"] == kind, F.array(*[F.struct(F.lit(label).alias("label"), value(f).alias("value")) for label, f in shown]))
    return chosen.otherwise(empty)


def json_walk(json: Column, path: Column) -> Column:
    """Struct (status, n_steps, n_found, value, excerpt) of a path like ``$.a[0].b`` or
    ``$['a b']`` in a JSON text.  ``status``: NOT_STORED (no text), NOT_JSON, BAD_PATH (null
    or of another form), MISSING (``n_found`` steps lead somewhere), NULL (a JSON null; ``value`` is
    null), FOUND.  ``excerpt``: the JSON of what holds the last step found, cut to 600 characters."""
    good = F.coalesce(path.rlike(rf"\A\$(?:{_STEP})*\z"), F.lit(False))
    parsed = F.struct(F.try_parse_json(json).alias("v"), F.regexp_extract_all(F.when(good, path), F.lit(_STEP), F.lit(0)).alias("steps"))

    def walked(p: Column) -> Column:
        at = lambda n: F.try_variant_get(p["v"], F.concat(F.lit("$"), F.array_join(F.slice(p["steps"], F.lit(1), n), "")), "variant")
        count = F.size(p["steps"])
        # a step is found only behind one that is found, so what is found is a prefix
        found = F.size(F.filter(F.transform(F.sequence(F.lit(0), count), lambda n: at(n)), lambda x: x.isNotNull())) - 1
        value, usable = at(count), good & p["v"].isNotNull()
        void = F.is_variant_null(value)
        status = F.when(json.isNull(), "NOT_STORED").when(p["v"].isNull(), "NOT_JSON").when(~good, "BAD_PATH").when(found < count, "MISSING").when(void, "NULL").otherwise("FOUND")
        return F.struct(
            status.alias("status"),
            F.when(good, count).alias("n_steps"),
            F.when(usable, found).alias("n_found"),
            F.when(usable & (found == count) & ~void, F.coalesce(F.try_variant_get(value, "$", "string"), F.to_json(value))).alias("value"),
            F.when(usable, F.substring(F.to_json(at(F.greatest(F.least(found, count - 1), F.lit(0)))), 1, EXCERPT)).alias("excerpt"),
        )

    return F.transform(F.array(parsed), walked)[0]  # an array of one, so that a text is parsed once


def evidence_views(locators: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """Adds ``facts`` and ``walk`` to rows (key, locator): the record of a locator is the row of
    ``records`` (record_id, json; ids are unique) that it names.  Locators without a stored record, or of another
    kind, keep their facts; ``walk`` is null unless the kind is API_FIELD."""
    fields = locators.schema["locator"].dataType.fieldNames()
    stored = records.select(F.col("record_id").cast("string").alias("_record"), F.col("json").alias("_json"))
    j = locators.select(key, "locator").join(stored, (F.col("locator.kind") == "API_FIELD") & (F.col("locator.record_id").cast("string") == F.col("_record")), "left")
    walk = F.when(F.col("locator.kind") == "API_FIELD", json_walk(F.col("_json"), F.col("locator.json_path")))
    return j.select(key, "locator", facts(F.col("locator"), fields).alias("facts"), walk.alias("walk"))
