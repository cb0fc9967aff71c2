"""Readers: tables by name, whole text files, raw objects, JSON payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by key, for much work a row: a small table lies in few row groups, each of which one task reads."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): txt, md and csv files, each as one text; nothing in them is parsed."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def objects(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, content): stored objects as bytes."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length", "content")


def file_kind(name: Column, mime: Column) -> Column:
    """pdf, docx, doc, image, text or other, by MIME type or extension."""
    name, mime = F.lower(F.coalesce(name, F.lit(""))), F.lower(F.coalesce(mime, F.lit("")))
    return (
        F.when(name.endswith(".pdf") | mime.contains("pdf"), "pdf")
        .when(name.endswith(".docx") | mime.contains("wordprocessingml"), "docx")
        .when(name.endswith(".doc") | (mime == "application/msword"), "doc")
        .when(mime.startswith("image/") | name.rlike(r"\.(png|jpe?g|webp|gif|heic)$"), "image")
        .when(mime.startswith("text/") | name.rlike(r"\.(txt|md|csv)$"), "text")
        .otherwise("other")
    )


#: A record's field and the names under which payloads have it (fixed values).
ALIASES = {
    "name": ["name"],
    "ingredients": ["ingredients", "recipeIngredient"],
    "method": ["method", "recipeInstructions"],
    "cuisine": ["cuisine", "recipeCuisine"],
    "course": ["course", "recipeCategory"],
    "servings": ["servings", "recipeYield"],
}


def payload_field(payload: Column, *names: str) -> Column:
    """The first non-empty value of the names, in the payload's ``recipe`` if it has one, else at its top."""
    inner = F.get_json_object(payload, "$.recipe")
    root = F.when(inner.startswith("{"), inner).otherwise(payload)
    values = [F.trim(F.get_json_object(root, f"$.{n}")) for n in names]
    found = [F.when(v != "", v) for v in values]
    return F.coalesce(*found) if len(found) > 1 else found[0]


def payload_record(payload: Column) -> list[Column]:
    return [payload_field(payload, *names).alias(field) for field, names in ALIASES.items()]


def holds_many(payload: Column) -> Column:
    """Whether a payload holds a list of records; false for text that isn't JSON."""
    many = (F.get_json_object(payload, "$.multiple") == "true") & F.get_json_object(payload, "$.recipes").startswith("[")
    return F.coalesce(many, F.lit(False))


def plain_ingredients(value: Column) -> Column:
    """array<string> from a JSON list of strings, a JSON list of {quantity, unit, name}, {"html"} or plain text."""
    texts = F.from_json(value, "array<string>")
    rows = F.from_json(value, "array<struct<quantity:string,unit:string,name:string>>")
    joined = F.transform(rows, lambda r: F.concat_ws(" ", *(F.when(r[c] != "", r[c]) for c in ("quantity", "unit", "name"))))
    html = F.regexp_replace(F.regexp_replace(F.get_json_object(value, "$.html"), r"(?i)<(br|/p|/li|/div)[^>]*>", "\n"), "<[^>]*>", "")
    items = F.when(value.rlike(r"^\s*\[\s*\{"), joined).when(value.rlike(r"^\s*\["), texts).when(value.rlike(r"^\s*\{"), F.split(html, "\n")).otherwise(F.split(value, "\n"))
    return F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != "")
