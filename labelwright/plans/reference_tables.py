"""The sample rules and their lookup tables as DataFrames (configuration, a few dozen rows)."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RULESET = json.loads((Path(__file__).parent / "sample_ruleset.json").read_text(encoding="utf-8"))

_SCHEMAS = {
    "units_by_magnitude": "basis string, unit_below string, unit_from string",
    "unit_price_units": "ord int, basis string, comparison string, threshold double, unit_price_unit string",
    "permissible_error": "low double, high double, absolute double, percent double",
    "font_height": "low double, high double, normal_mm int, molded_mm int",
    "sampling_plan": "low double, high double, sample_size int, correction double, allowed int",
    "quantity_basis": "entry string, declared_in array<string>",
}
BASIS_WORDS = {"weight": "mass", "volume": "volume", "length": "length", "area": "area", "number": "number"}


def table(spark: SparkSession, name: str) -> DataFrame:
    columns = [c.split()[0] for c in _SCHEMAS[name].split(", ")]
    as_float = lambda v: float(v) if isinstance(v, int) and not isinstance(v, bool) else v
    kinds = dict(c.split(" ", 1) for c in _SCHEMAS[name].split(", "))
    rows = [tuple(as_float(r[c]) if kinds[c] == "double" else r[c] for c in columns) for r in RULESET["lookup_tables"][name]]
    df = spark.createDataFrame(rows, _SCHEMAS[name])
    if name == "quantity_basis":
        words = F.create_map(*[F.lit(x) for kv in BASIS_WORDS.items() for x in kv])
        df = df.select("entry", F.transform("declared_in", lambda w: words[w]).alias("bases"))
    return df


def sql_values(name: str, columns: list[str]) -> str:
    """The same table as a SQL VALUES list."""
    def cell(v):
        if v is None:
            return "null"
        if isinstance(v, list):
            return "[" + ", ".join(f"'{BASIS_WORDS.get(x, x)}'" for x in v) + "]"
        return f"'{v}'" if isinstance(v, str) else str(v)
    rows = RULESET["lookup_tables"][name]
    return "(values " + ", ".join("(" + ", ".join(cell(r[c]) for c in columns) + ")" for r in rows) + ") " + name + "(" + ", ".join(columns) + ")"
