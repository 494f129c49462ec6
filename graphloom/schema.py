"""Entity and relationship schemas, ids and effective confidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTITY = T.StructType([
    T.StructField("id", T.StringType(), False), T.StructField("name", T.StringType()), T.StructField("qualified_name", T.StringType()),
    T.StructField("kind", T.StringType()), T.StructField("subtype", T.StringType()), T.StructField("source_file", T.StringType()),
    T.StructField("start_line", T.IntegerType()), T.StructField("end_line", T.IntegerType()), T.StructField("language", T.StringType()),
    T.StructField("signature", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("metadata", T.StringType()),
    T.StructField("properties", T.MapType(T.StringType(), T.StringType())), T.StructField("embedding_ref", T.StringType()),
    T.StructField("community_id", T.IntegerType()), T.StructField("centrality", T.DoubleType()), T.StructField("pagerank", T.DoubleType()),
    T.StructField("is_god_node", T.BooleanType()), T.StructField("is_surprise_endpoint", T.BooleanType()),
    T.StructField("is_articulation_point", T.BooleanType()), T.StructField("confidence", T.DoubleType()),
])

RELATIONSHIP = T.StructType([
    T.StructField("id", T.StringType(), False), T.StructField("from_id", T.StringType()), T.StructField("to_id", T.StringType()),
    T.StructField("kind", T.StringType()), T.StructField("properties", T.MapType(T.StringType(), T.StringType())), T.StructField("confidence", T.DoubleType()),
])


def entity_id(repo: Column, kind: Column, name: Column, source_file: Column) -> Column:
    """First 16 hex digits of sha256 over the parts, joined by NUL."""
    return F.substring(F.sha2(F.concat_ws("\0", repo, kind, name, source_file), 256), 1, 16)


def relationship_id(from_id: Column, to_id: Column, kind: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\0", from_id, to_id, kind), 256), 1, 16)


def effective_confidence(c: Column) -> Column:
    """Unset and zero read as 1.0; everything else is clamped to [0, 1]."""
    return F.when(c.isNull() | (c == 0), F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def bare_kind(kind: Column) -> Column:
    return F.lower(F.regexp_replace(kind, r"^SCOPE\.", ""))


def edge_weight(properties: Column) -> Column:
    """properties.count, else properties.weight, else 1; non-positive reads as 1."""
    w = F.coalesce(F.try_element_at(properties, F.lit("count")).try_cast("double"), F.try_element_at(properties, F.lit("weight")).try_cast("double"), F.lit(1.0))
    return F.when(w > 0, w).otherwise(1.0)
