"""REST-shaped rows: request bodies, their validation, responses and errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed texts of the API's errors.
INVALID_JSON, EMPTY_PARAMETER, EMPTY_KEY, NOT_FOUND = "invalid JSON", "empty parametr", "empty key", "Not Found"


def plain_base64(value: Column) -> Column:
    """Base64 without line breaks, whatever the session says about chunks."""
    return F.regexp_replace(F.base64(value.cast("binary")), "[\r\n]", "")


def error(message: str, status: int) -> Column:
    return F.struct(F.lit(message).alias("message"), F.lit(message).alias("error"), F.lit(status).alias("code"))


def parse_puts(bodies: DataFrame, body: str = "body") -> DataFrame:
    """key, value, status and error of each put body: 400 for bad JSON, and for an empty key or value. Field names match in any case, the last counts."""
    parsed = F.from_json(F.col(body), "map<string,string>", {"mode": "PERMISSIVE"})
    field = lambda name: F.get(F.reverse(F.filter(F.map_entries(F.col("m_")), lambda e: F.lower(e["key"]) == name)), 0)["value"]
    rows = bodies.withColumn("m_", parsed).withColumn("r_", F.struct(field("key").alias("key"), field("value").alias("value")))
    bad = F.col("m_").isNull()
    empty = (F.coalesce(F.octet_length("r_.key"), F.lit(0)) == 0) | (F.coalesce(F.octet_length("r_.value"), F.lit(0)) == 0)
    none = F.lit(None).cast("struct<message:string,error:string,code:int>")
    return rows.select(
        *bodies.columns,
        F.when(~bad, F.col("r_.key")).alias("key"),
        F.when(~bad, F.col("r_.value")).alias("value"),
        F.when(bad | empty, 400).otherwise(200).alias("status"),
        F.when(bad, error(INVALID_JSON, 400)).when(empty, error(EMPTY_PARAMETER, 400)).otherwise(none).alias("error"),
    )


def get_responses(live: DataFrame, keys: DataFrame) -> DataFrame:
    """k, status and JSON body of a get of each key: the value in base64, or 404."""
    found = keys.join(live.select("k", "v", F.lit(True).alias("has")), "k", "left")
    body = F.to_json(F.struct(F.col("k").alias("key"), plain_base64(F.col("v")).alias("value")))
    return found.select("k", F.when(F.col("has"), 200).otherwise(404).alias("status"), F.when(F.col("has"), body).otherwise(F.to_json(error(NOT_FOUND, 404))).alias("body"))


def load_rows(spark: SparkSession, first: int = 200, count: int = 200) -> DataFrame:
    """The load generator's puts."""
    return spark.range(first, first + count).select(F.col("id").cast("string").alias("key"), F.concat(F.lit("value_"), F.col("id").cast("string")).alias("value"))
