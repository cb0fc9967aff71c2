"""Scores of candidate titles and passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataform.functions.text import words


def title_score(line: Column, distance: Column, nouns: str | None = None, verbs: str | None = None) -> Column:
    """10 - 0.35 * min(distance, 12), +3 for 2 to 9 words, +5 if at least max(2, half) are capitalised, -1 for
    punctuation, +1 for a noun of the subject, -2 for a verb of advertising."""
    parts = words(line)
    n, capital = F.size(parts), F.size(F.filter(parts, lambda w: w.rlike(r"^\p{Lu}")))
    score = 10 - 0.35 * F.least(distance, F.lit(12))
    score += F.when((n >= 2) & (n <= 9), 3).otherwise(0) + F.when(capital >= F.greatest(F.lit(2), F.ceil(n / 2)), 5).otherwise(0) - F.when(line.rlike("[.!?;:]"), 1).otherwise(0)
    for pattern, points in ((nouns, 1), (verbs, -2)):
        if pattern:
            score += F.when(F.lower(line).rlike(pattern), points).otherwise(0)
    return score


def title_candidates(lines: Column) -> Column:
    """array<struct<pos, line, distance, bonus>> of an array of lines: each line, and each with the next one, which gets 1.5 more."""

    def both(x: Column, i: Column) -> Column:
        after = F.get(lines, i + 1)["line"]
        made = lambda line, bonus: F.struct(x["pos"].alias("pos"), line.alias("line"), (F.size(lines) - 1 - i).alias("distance"), F.lit(bonus).alias("bonus"))
        one = F.array(made(x["line"], 0.0))
        return F.when(after.isNull(), one).otherwise(F.concat(one, F.array(made(F.concat_ws(" ", x["line"], after), 1.5))))

    return F.flatten(F.transform(lines, both))


def titles(df: DataFrame, key: str) -> DataFrame:
    """(key, pos, title, score) of line arrays: the best candidate of each; the first, and the single line, win ties."""

    def scored(x: Column, i: Column) -> Column:
        score = F.round((title_score(x["line"], x["distance"]) + x["bonus"]).cast("double"), 6)
        return F.struct(score.alias("score"), (-i).alias("turn"), x["pos"].alias("pos"), x["line"].alias("title"))

    best = F.array_max(F.transform(title_candidates(F.col("lines")), scored))
    return df.select(key, best.alias("best")).select(key, "best.pos", "best.title", "best.score")
