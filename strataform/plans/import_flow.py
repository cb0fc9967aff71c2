"""From texts to reviewed records: lines, sections, a record, its verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataform.functions.noise import blocked_page  # noqa: F401
from strataform.functions.text import file_title, first_filled, language_by_block, letter_share, words
from strataform.operators.quality import Vocabulary, verdict
from strataform.operators.segments import Headings, lines_of, records


def title_quality(title: Column) -> Column:
    """Letters by characters, with a little more for several words and a capital letter."""
    return letter_share(title) + F.when(F.size(words(title)).between(2, 9), 0.1).otherwise(0) + F.when(title.rlike(r"^\p{Lu}"), 0.05).otherwise(0)


def title_for(title: Column, text: Column, file_name: Column, least: float = 0.68) -> Column:
    """The title if it's readable; else the file's name, with the language if that isn't English."""
    language = language_by_block(text)
    base = file_title(file_name)
    named = F.when(language == "English", base).otherwise(F.concat(base, F.lit(" ("), language, F.lit(")")))
    return F.when((title_quality(title) >= least) & (language == "English"), first_filled(title, base)).otherwise(named)


def reviewed(df: DataFrame, key: str, text: str = "text", headings: Headings = Headings(), vocabulary: Vocabulary = Vocabulary(), mode: str = "text") -> DataFrame:
    """A record for each document with its verdict; documents that give none are kept, with all lines unassigned."""
    found = records(lines_of(df, key, text), key, headings)
    rows = df.select(key, F.col(text).alias("raw_text")).join(found, key, "left")
    none = F.array().cast("array<string>")
    rows = rows.withColumns({c: F.coalesce(c, none) for c in ("ingredients", "method", "notes")})
    checked = rows.select("*", *verdict(F.col("title"), F.col("description"), F.col("ingredients"), F.col("method"), F.lit(mode), vocabulary))
    empty = (F.size("ingredients") == 0) & (F.size("method") == 0)
    return checked.withColumn("rescued", empty).withColumn("unassigned", F.when(empty, F.filter(F.split("raw_text", "\n"), lambda x: F.trim(x) != "")).otherwise(none))
