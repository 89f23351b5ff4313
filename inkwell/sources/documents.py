"""Documents in: JSON files and literals, and any DataFrame, to (doc_id, stored, fields).

``fields`` is map<string, string> of the searchable values (strings); ``stored`` is the whole document as JSON.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = "doc_id string, stored string, fields map<string,string>"


def from_literals(spark: SparkSession, docs: list[tuple[str, dict]]) -> DataFrame:
    """Documents held by the driver."""
    rows = [(i, json.dumps(d, ensure_ascii=False), {k: v for k, v in d.items() if isinstance(v, str)}) for i, d in docs]
    return spark.createDataFrame(rows, SCHEMA)


def from_json(spark: SparkSession, path: str, count: int = 0, lines: bool = False) -> DataFrame:
    """A file of [{"ID": ..., "Fields": {...}}, ...], or of one such object a line, read once; the first ``count`` of them if it is above 0.  Entries without an ID or fields are left out.

    Values keep their types in what is stored; those that are strings in their own document are searchable.
    """
    raw = spark.read.option("multiLine", not lines).schema("ID string, Fields map<string,variant>").json(path)
    raw = raw.limit(count) if count > 0 else raw
    texts = F.map_filter("Fields", lambda k, v: F.schema_of_variant(v) == "STRING")
    return raw.where("ID IS NOT NULL AND Fields IS NOT NULL").select(F.col("ID").alias("doc_id"), F.to_json("Fields").alias("stored"), F.transform_values(texts, lambda k, v: F.variant_get(v, "$", "string")).alias("fields"))


def to_json(docs: DataFrame, path: str) -> None:
    """Writes documents in the form that ``from_json`` reads with ``lines``."""
    docs.select(F.to_json(F.struct(F.col("doc_id").alias("ID"), F.parse_json("stored").alias("Fields")))).write.mode("overwrite").text(path)


def from_table(df: DataFrame, key: str | list[str], fields: list[str] | None = None) -> DataFrame:
    """Rows as documents: the id is the key column, or several joined by '-'.  String columns are searchable, unless ``fields`` names them; all columns are stored.

    Rows with a null in their key have no id and are left out.
    """
    keys = [key] if isinstance(key, str) else key
    if fields is None:
        fields = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in keys]
    entries = [x for f in fields for x in (F.lit(f), F.col(f).cast("string"))]
    own = F.map_filter(F.create_map(*entries), lambda _, v: v.isNotNull()) if entries else F.create_map().cast("map<string,string>")
    return df.where(F.expr(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))).select(F.concat_ws("-", *(F.col(k).cast("string") for k in keys)).alias("doc_id"), F.to_json(F.struct(*df.columns)).alias("stored"), own.alias("fields"))
