"""JSON documents in string columns: kinds, items, canonical form, shape, merging. What has no built-in runs as an Arrow UDF, batch by batch."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

# Names of kinds by the start of a schema, and keys that a shape leaves out.
KINDS = {"OBJECT": "object", "ARRAY": "array", "STRING": "string", "BOOLEAN": "boolean", "VOID": "null", "BIGINT": "number", "DECIMAL": "number", "DOUBLE": "number"}
UNSHAPED = re.compile(r"^id$|_id$|_ids$|hash|url|uri|object_key|_path$|_ref$|captured_at$|detected_at$|created_at$|updated_at$")
UNSHAPED_NAMES = ["snapshot", "monitoring_policy", "monitoring_policy_bundle"]


def kind(c: Column, path: str = "$") -> Column:
    """What stands at a path: object, array, string, number, boolean or null; null if nothing does or the text is no JSON."""
    schema = F.schema_of_variant(F.try_variant_get(F.try_parse_json(c), path, "variant"))
    out = F.lit(None).cast("string")
    for start, name in KINDS.items():
        out = F.when(schema.startswith(start), F.lit(name)).otherwise(out)
    return out


def parsed_object(c: Column) -> Column:
    """The text if it is a JSON object, else null; never an error."""
    return F.when(kind(c) == "object", c)


def items(c: Column) -> Column:
    """The strings of a JSON array, a JSON string alone as one item, else nothing."""
    return F.when(kind(c) == "array", F.from_json(c, "array<string>")).when(kind(c) == "string", F.array(F.variant_get(F.try_parse_json(c), "$", "string"))).otherwise(F.array().cast("array<string>"))


def entries(c: Column) -> Column:
    """Keys and values (as text) of a JSON object, in the order of keys."""
    return F.array_sort(F.map_entries(F.coalesce(F.from_json(parsed_object(c), "map<string,string>"), F.from_json(F.lit("{}"), "map<string,string>"))))


def merged(c: Column, more: Column) -> Column:
    """Two flat JSON objects of strings and numbers as one, keys in order; the second wins, and nulls drop a key."""
    own, other = F.from_json(c, "map<string,variant>"), F.from_json(more, "map<string,variant>")
    kept = F.map_filter(own, lambda k, _: ~F.map_contains_key(other, k))
    both = F.map_filter(F.map_concat(kept, other), lambda _, v: v.isNotNull() & ~F.is_variant_null(v))
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(both), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))))


def _rewritten(texts: pd.Series, how) -> pd.Series:
    def one(text):
        try:
            return None if text is None else how(json.loads(text))
        except ValueError:
            return None

    return texts.map(one)


def canonical(c: Column | str) -> Column:
    """The JSON with sorted keys and without blanks; null if it is none."""
    return F.to_json(F.try_parse_json(F.col(c) if isinstance(c, str) else c))


def _shape(value: object) -> object:
    if isinstance(value, dict):
        return {k: _shape(v) for k, v in sorted(value.items()) if k not in UNSHAPED_NAMES and not UNSHAPED.search(k)}
    return "array" if isinstance(value, list) else "null" if value is None else "boolean" if isinstance(value, bool) else "string" if isinstance(value, str) else "number"


@pandas_udf(StringType())
def shape(texts: pd.Series) -> pd.Series:
    """Keys and kinds of a JSON object, nested ones too, without ids, hashes, urls and times; {} for other values."""
    return _rewritten(texts, lambda v: json.dumps(_shape(v) if isinstance(v, dict) else {}, separators=(",", ":")))


@pandas_udf(StructType([StructField("common", IntegerType()), StructField("old", StringType()), StructField("new", StringType())]))
def excerpt(old: pd.Series, new: pd.Series) -> pd.DataFrame:
    """How many characters two texts begin with alike, and what of each is left between that and their common end."""

    def one(a: str | None, b: str | None) -> tuple[int, str, str]:
        a, b = a or "", b or ""
        most = min(len(a), len(b))
        start = next((k for k in range(most) if a[k] != b[k]), most)
        end = next((k for k in range(most - start) if a[-1 - k] != b[-1 - k]), most - start)
        return start, a[start : len(a) - end], b[start : len(b) - end]

    return pd.DataFrame([one(a, b) for a, b in zip(old, new)], columns=["common", "old", "new"])
