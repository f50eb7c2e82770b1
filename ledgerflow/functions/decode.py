"""Scalar functions: payload decoding, headers, outcome tags, naming, truncation."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def utf8(value: Column) -> Column:
    """UTF-8 text; malformed bytes become U+FFFD, null stays null."""
    return F.make_valid_utf8(value.cast("string"))


def is_malformed(value: Column) -> Column:
    return F.coalesce(~F.is_valid_utf8(value.cast("string")), F.lit(False))


def json_payload(text: Column, schema: str) -> Column:
    """struct(ok, payload): whether the text is well-formed, and its fields. Legal nulls are ok."""
    read = F.from_json(text, f"{schema}, _malformed string", {"columnNameOfCorruptRecord": "_malformed"})
    return F.struct((read.isNotNull() & read["_malformed"].isNull()).alias("ok"), read.dropFields("_malformed").alias("payload"))


def split_poison(records: DataFrame, decoded: Column) -> tuple[DataFrame, DataFrame]:
    """(rows that decode, with column ``payload``; rejected rows with ``cause``), from a struct(ok, payload). A null value is no poison."""
    tried = records.withColumn("_tried", decoded)
    bad = F.col("value").isNotNull() & ~F.coalesce(F.col("_tried.ok"), F.lit(False))
    good = tried.where(~bad).withColumn("payload", F.col("_tried.payload")).drop("_tried")
    return good, tried.where(bad).drop("_tried").withColumn("outcome", F.lit("reject")).withColumn("cause", F.lit("deserialization"))


def split_corrupt_batches(records: DataFrame, batch: list[str], corrupt: Column) -> tuple[DataFrame, DataFrame]:
    """(records of whole batches, one row per corrupt batch with ``cause``): a batch with one unreadable record is passed over and counted once."""
    marked = records.groupBy(*batch).agg(F.max(F.coalesce(corrupt, F.lit(False))).alias("_corrupt"))
    bad = marked.where("_corrupt").select(*batch)
    return records.join(bad, batch, "left_anti"), bad.withColumn("cause", F.lit("corrupt_batch"))


def decode_by_topic(records: DataFrame, decoders: Mapping[str, Callable[[Column], Column]], error: str = "DecodeError") -> DataFrame:
    """Adds payload and error_class by the topic's decoder (a struct(ok, payload) of the value); what it can't read fails its attempt and so goes to retry."""
    tried = None
    for topic, decoder in decoders.items():
        here = F.col("topic") == topic
        tried = F.when(here, decoder(F.col("value"))) if tried is None else tried.when(here, decoder(F.col("value")))
    rows = records.withColumn("_tried", tried)
    failed = F.col("value").isNotNull() & ~F.coalesce(F.col("_tried.ok"), F.lit(False))
    return rows.withColumn("payload", F.col("_tried.payload")).withColumn("error_class", F.when(failed, error)).drop("_tried")


def header_values(headers: Column, name: str) -> Column:
    """All values of a name in delivery order."""
    return F.transform(F.filter(headers, lambda h: h["key"] == name), lambda h: h["value"])


def header_last(headers: Column, name: str) -> Column:
    return F.try_element_at(header_values(headers, name), F.lit(-1))


def header_names(headers: Column) -> Column:
    """Distinct names as first seen."""
    return F.array_distinct(F.transform(headers, lambda h: h["key"]))


def delivery_count(column: Column) -> Column:
    return F.coalesce(column, F.lit(1))


def outcome_tag(outcome: Column) -> Column:
    """Lower-case tag of a terminal outcome; anything else is an error."""
    tag = F.lower(outcome)
    return F.when(tag.isin("accept", "release", "reject"), tag).otherwise(F.raise_error(F.concat(F.lit("no terminal outcome: "), outcome)))


def dead_letter_topic(topic: Column, suffix: str = ".DLT") -> Column:
    return F.concat(topic, F.lit(suffix))


def truncate_utf8(text: Column, limit: int = 4096) -> Column:
    """The longest prefix of whole characters within ``limit`` bytes."""
    raw = text.cast("binary")
    return F.coalesce(*(F.try_validate_utf8(F.substring(raw, 1, n).cast("string")) for n in range(limit, max(limit - 4, 0), -1)))
