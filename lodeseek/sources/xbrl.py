"""XBRL instances and label linkbases, by Spark's XML source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.facts import namespace_prefix


def _read(spark: SparkSession, path: str, tag: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.format("xml").options(rowTag=tag, ignoreNamespace=True).schema(schema).load(path)


def contexts(spark: SparkSession, path: str) -> DataFrame:
    """(context_id, instant, start, end, members); dates stay text."""
    member = "struct<_VALUE: string, _dimension: string>"
    body = f"struct<explicitMember: array<{member}>>"
    raw = _read(spark, path, "context", f"_id string, period struct<instant: string, startDate: string, endDate: string>, entity struct<segment: {body}>, scenario {body}")
    members = F.concat(*[F.coalesce(F.transform(F.col(c), lambda m: F.trim(m["_VALUE"])), F.array().cast("array<string>")) for c in ("entity.segment.explicitMember", "scenario.explicitMember")])
    return raw.select(F.col("_id").alias("context_id"), "period.instant", F.col("period.startDate").alias("start"), F.col("period.endDate").alias("end"), members.alias("members"))


def units(spark: SparkSession, path: str) -> DataFrame:
    """(unit_id, measure): the measure without its prefix."""
    raw = _read(spark, path, "unit", "_id string, measure string, divide struct<unitNumerator: struct<measure: string>, unitDenominator: struct<measure: string>>")
    measure = F.coalesce("measure", F.col("divide.unitNumerator.measure"), F.lit(""))
    return raw.select(F.col("_id").alias("unit_id"), F.element_at(F.split(measure, ":"), -1).alias("measure"))


def facts(spark: SparkSession, path: str, own: dict[str, str] | None = None) -> DataFrame:
    """(pos, prefix, concept, context_id, unit_id, value): elements with a contextRef, found in the files' text.

    An instance has one element name a concept, so that no row tag fits; the elements are cut by a pattern.  Prefixes
    are the short names of the namespaces that the file declares (namespace_prefix, ``own`` adds a filer's): facts of any
    namespace are read.  A file is one row, as its declarations stand at its head."""
    text = spark.read.text(path, wholetext=True).withColumn("file", F.abs(F.hash(F.input_file_name())).cast("long"))
    attribute = r"(?:\s+[\w:\-.]+=\"[^\"]*\")*?"
    element = rf"(?s)<([\w\-.]+):([\w\-.]+)({attribute}\s+contextRef=\"[^\"]*\"{attribute})\s*(?:/>|>(.*?)</\1:\2\s*>)"
    declared = r"xmlns:([\w\-.]+)=\"([^\"]*)\""
    spaces = F.arrays_zip(F.regexp_extract_all("value", F.lit(declared), F.lit(1)).alias("name"), F.regexp_extract_all("value", F.lit(declared), F.lit(2)).alias("uri"))
    rows = text.select("file", spaces.alias("spaces"), F.posexplode(F.regexp_extract_all("value", F.lit(element), F.lit(0))).alias("pos", "e"))
    part = lambda k: F.regexp_extract("e", element, k)
    attr = lambda a: F.nullif(F.regexp_extract(part(3), rf'{a}="([^"]*)"', 1), F.lit(""))
    rows = rows.select((F.col("file") * (1 << 31) + F.col("pos")).alias("pos"), "spaces", part(1).alias("raw"), part(2).alias("concept"), attr("contextRef").alias("context_id"), attr("unitRef").alias("unit_id"), part(4).alias("value"))
    uri = F.get(F.transform(F.filter("spaces", lambda x: x["name"] == F.col("raw")), lambda x: x["uri"]), F.lit(0))
    return rows.select("pos", F.coalesce(namespace_prefix(uri, own), F.col("raw")).alias("prefix"), "concept", "context_id", "unit_id", "value")


def linkbase(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """locs (loc, key), arcs (pos, source, target), label texts (pos, name, role, text)."""
    pos = F.monotonically_increasing_id()
    locs = _read(spark, path, "loc", "_href string, _label string").where(F.contains("_href", F.lit("#")))
    arcs = _read(spark, path, "labelArc", "_from string, _to string")
    texts = _read(spark, path, "label", "_VALUE string, _label string, _role string")
    return (
        locs.select(F.col("_label").alias("loc"), F.substring_index("_href", "#", -1).alias("key")),
        arcs.select(pos.alias("pos"), F.col("_from").alias("source"), F.col("_to").alias("target")),
        texts.select(pos.alias("pos"), F.col("_label").alias("name"), F.col("_role").alias("role"), F.col("_VALUE").alias("text")),
    )
