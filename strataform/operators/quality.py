"""A rule-based quality gate: points, reasons and a verdict for each record."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataform.functions.text import letter_share, words


@dataclass(frozen=True)
class Vocabulary:
    """Patterns that the checks look for; the defaults are those of recipes."""

    unit: str = r"(?i)\b(cups?|tsp|tbsp|teaspoons?|tablespoons?|g|kg|ml|l|oz|lb|cloves?|pinch)\b"
    quantity: str = r"[0-9¼½¾⅓⅔⅛⅜⅝⅞]"
    instruction: str = r"(?i)\b(add|bake|boil|chop|combine|cook|cover|fry|grind|heat|mix|peel|pour|roast|serve|simmer|soak|stir|whisk)\b"
    section: str = r"(?i)\b(ingredients|method|instructions|directions)\b"
    promotion: str = r"(?i)\b(restaurant|bar|book|reservation|menu|venue|terrace|cocktails?)\b"
    junk: str = r"[\x{fffd}\x{25a0}\x{25a1}|¦~^]"
    #: A credit is "by" and names: capital letters count, so "By the Sea" is none.
    credit: str = r"^(?:(?:[Rr]ecipe|[Pp]hoto(?:graph)?s?|[Tt]ext|[Ww]ords) )?[Bb]y (?:\p{Lu}[\p{L}.'-]*)(?: \p{Lu}[\p{L}.'-]*){0,3}$"


def count_if(items: Column, test) -> Column:
    return F.size(F.filter(items, test))


def verdict(name: Column, description: Column, ingredients: Column, method: Column, mode: Column, v: Vocabulary = Vocabulary()) -> list[Column]:
    """[score, reasons, good]. Arrays of lines; nulls are empty. Good: no reasons and at least 85 points."""
    name, description = F.coalesce(name, F.lit("")), F.coalesce(description, F.lit(""))
    none = F.array().cast("array<string>")
    ingredients, method = F.coalesce(ingredients, none), F.coalesce(method, none)
    steps, list_text = F.array_join(method, " "), F.array_join(ingredients, " ")
    n = F.size(ingredients)
    like = lambda x: x.rlike(v.quantity) | x.rlike(v.unit) | (F.size(words(x)).between(1, 8) & ~x.rlike(v.instruction))
    has_method = F.length(F.trim(steps)) > 0
    whole = F.concat_ws(" ", name, list_text, steps)
    repeated = lambda a: F.size(a) - F.size(F.array_distinct(F.transform(a, lambda x: F.lower(F.trim(x)))))
    meaningful = lambda x: (F.length(x) >= 8) & (x.rlike(v.quantity) | x.rlike(v.unit))
    checks = [
        ((F.size(words(name)) >= 1) & F.length(name).between(3, 160), 20, "missing_or_implausible_title"),
        (n >= 3, 20, "too_few_ingredients"),
        (~((mode == "scanned_pdf") & (n < 5)), 0, "scanned_pdf_ingredient_list_suspiciously_short"),
        (count_if(ingredients, like) >= F.least(F.lit(3), n), 15, "ingredients_do_not_look_like_recipe_ingredients"),
        (~has_method | (F.size(words(steps)) >= 8) | (F.length(steps) >= 60), 15, "method_too_short"),
        (~has_method | (count_if(method, lambda x: x.rlike(v.instruction)) >= 1), F.when(has_method, 10).otherwise(0), "method_does_not_look_like_instructions"),
        (letter_share(whole) >= 0.45, 10, "low_readable_text_ratio"),
        (~whole.rlike(v.junk), 5, "ocr_garbage_characters"),
        (repeated(ingredients) + repeated(method) == 0, 5, "repeated_lines"),
        ((F.length(name) <= 70) & ~name.rlike(v.section), 0, "title_contains_recipe_content"),
        (~name.rlike(v.credit), 0, "title_looks_like_credit_or_byline"),
        (F.size(F.array_distinct(F.regexp_extract_all(F.lower(description), F.lit(v.promotion), F.lit(1)))) < 2, 0, "description_looks_like_venue_promotion"),
        (~F.exists(ingredients, lambda x: meaningful(x) & F.contains(F.lower(steps), F.lower(x))), 0, "possible_section_contamination"),
    ]
    score = sum((F.when(ok, points).otherwise(0) for ok, points, _ in checks), F.lit(0))
    reasons = F.array_compact(F.array(*(F.when(~ok, F.lit(reason)) for ok, _, reason in checks)))
    return [score.cast("long").alias("score"), reasons.alias("reasons"), ((F.size(reasons) == 0) & (score >= 85)).alias("good")]


def checked(df: DataFrame, v: Vocabulary = Vocabulary()) -> DataFrame:
    """Records (name, description, ingredients, method, mode) with their verdict."""
    return df.select("*", *verdict(F.col("name"), F.col("description"), F.col("ingredients"), F.col("method"), F.col("mode"), v))
