"""Search, facets, lookups, joins by key, paging."""

from __future__ import annotations

import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataform.functions.nested import search_text
from strataform.functions.text import search_term, squeezed, unescaped
from strataform.sources.staging import saved


def matches(term: str | Column, *fields: Column) -> Column:
    """Whether a term, normalised, occurs in one of the fields, whatever the case; an empty term matches all."""
    wanted = F.lower(search_term(F.lit(term) if isinstance(term, str) else term))
    found = wanted == ""
    for field in fields:
        found = found | F.coalesce(F.contains(F.lower(field), wanted), F.lit(False))
    return found


def document_text(fields: list[Column], documents: list[Column]) -> Column:
    """What a search looks at: fields, then the texts of nested documents of any depth (JSON, JSON in texts, markup or plain), in lower case with single blanks."""
    plain = lambda x: unescaped(F.regexp_replace(x, "<[^>]*>", ""))
    parts = F.flatten(F.array(*(search_text(d.cast("string"), plain) for d in documents)))
    return F.lower(squeezed(F.concat_ws(" ", *(F.nullif(f.cast("string"), F.lit("")) for f in fields), parts)))


def filtered(df: DataFrame, allowed: set[str], **wanted: str | None) -> DataFrame:
    """Equality on columns of a fixed list; a null value leaves a column alone."""
    for column, value in wanted.items():
        if column not in allowed:
            raise ValueError(f"{column} can't be filtered on")
        if value is not None:
            df = df.where(F.col(column) == value)
    return df


#: Comparisons of a query string (fixed values).
COMPARISONS = {"eq": operator.eq, "neq": operator.ne, "gt": operator.gt, "gte": operator.ge, "lt": operator.lt, "lte": operator.le}


def from_query_string(df: DataFrame, query: str, allowed: set[str]) -> DataFrame:
    """A query string such as ``select=a,b&a=eq.1&c=is.null&order=b.desc&limit=5`` over columns of a fixed list."""
    from urllib.parse import parse_qsl

    def column(name: str) -> Column:
        if name not in allowed:
            raise ValueError(f"{name} can't be used in a query")
        return F.col(name)

    def typed(name: str, operand: str) -> Column:
        return F.lit(operand).cast(df.schema[name].dataType)  # never a part of SQL text

    wanted, order, limit = None, [], None
    for name, value in parse_qsl(query, strict_parsing=True):
        if name == "select":
            wanted = [column(c) for c in value.split(",")]
        elif name == "order":
            order = [column(c.partition(".")[0]).desc() if c.endswith(".desc") else column(c.partition(".")[0]).asc() for c in value.split(",")]
        elif name == "limit":
            limit = int(value)
        else:
            how, _, operand = value.partition(".")
            if how == "is" and operand == "null":
                df = df.where(column(name).isNull())
            elif how == "in":
                df = df.where(column(name).isin(*(typed(name, x) for x in operand.strip("()").split(","))))
            elif how == "like":
                parts = [F.replace(F.replace(F.replace(F.lit(x), F.lit("\\"), F.lit("\\\\")), F.lit("%"), F.lit("\\%")), F.lit("_"), F.lit("\\_")) for x in operand.split("*")]
                df = df.where(F.like(column(name), F.concat_ws("%", *parts)))
            elif how in COMPARISONS:
                df = df.where(COMPARISONS[how](column(name), typed(name, operand)))
            else:
                raise ValueError(f"{how} is no comparison")
    if order:
        df = df.orderBy(*order)
    if wanted:
        df = df.select(*wanted)
    return df if limit is None else df.limit(limit)


def readable(viewer: Column, role: Column, owner: Column, published: Column) -> Column:
    """Who may read a row: its owner, a member with a role that sees all, or anyone once it's published."""
    return F.coalesce(viewer == owner, F.lit(False)) | role.isin("owner", "admin") | F.coalesce(published, F.lit(False))


def page(df: DataFrame, order: list[Column], offset: int = 0, size: int = 12) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(size)


def pager(total: Column, offset: Column, size: int = 12) -> list[Column]:
    """pages, page and the offsets of the previous, next and last page."""
    pages = F.greatest(F.lit(1), F.ceil(total / size)).cast("long")
    last = (pages - 1) * size
    return [
        pages.alias("pages"),
        (F.floor(offset / size) + 1).cast("long").alias("page"),
        F.greatest(F.lit(0), offset - size).cast("long").alias("prev_offset"),
        F.least(last, offset + size).cast("long").alias("next_offset"),
        last.cast("long").alias("last_offset"),
    ]


def facet(df: DataFrame, column: str, known: list[str] | None = None) -> DataFrame:
    """(value): the distinct values of a column, trimmed and not blank, with those known beforehand."""
    out = df.select(F.trim(F.col(column)).alias("value"))
    if known:
        out = out.union(df.sparkSession.createDataFrame([(k,) for k in known], "value string"))
    return out.where("value <> ''").distinct()


def placed(df: DataFrame, *order: Column, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(df with part, place and position, from 0; (part, n, before) of each range) in an order, without sorting in one task.

    Rows are dealt into ranges of the order and sorted there; a row's position is its
    place plus the rows of all earlier ranges, of which there is one row each. Ranges are
    folders of a saved table, so a page is read from the ranges that hold it. The order
    has to be total, or equal rows share out their positions by chance.
    """
    number = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(number, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    rows = rows.withColumns({"part": F.shiftright("_id", 33).cast("int"), "place": F.col("_id").bitwiseAND((1 << 33) - 1)}).drop("_id")
    rows = saved(rows, "placed", ["part"])
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = saved(rows.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", before), "ranges")  # a row for each range
    return rows.join(F.broadcast(ranges.select("part", "before")), "part").withColumn("position", F.col("before") + F.col("place")).drop("before"), ranges


def placed_page(rows: DataFrame, ranges: DataFrame, number: int, size: int = 12) -> DataFrame:
    """The rows of a page, from 0, of placed(): only the ranges that hold it are read."""
    low, high = number * size, (number + 1) * size
    parts = [r["part"] for r in ranges.where((F.col("before") < high) & (F.col("before") + F.col("n") > low)).collect()]
    return rows.where(F.col("part").isin(parts) & (F.col("position") >= low) & (F.col("position") < high)).orderBy("position")


def after(df: DataFrame, order: list[tuple[str, bool]], last: dict | None, size: int = 12) -> DataFrame:
    """The next page behind the last row of the page before, by its values of the order's columns (name, ascending); the first page without one. Columns without nulls."""
    if last:
        behind, same = F.lit(False), F.lit(True)
        for name, up in order:
            value = F.lit(last[name])
            behind, same = behind | (same & (F.col(name) > value if up else F.col(name) < value)), same & (F.col(name) == value)
        df = df.where(behind)
    return df.orderBy(*(F.col(name).asc() if up else F.col(name).desc() for name, up in order)).limit(size)


def ranked(df: DataFrame, name: str, alias: str) -> DataFrame:
    """df with each name's rank in the order of a language, case aside; equal names share one. Null names come first.

    Names are dealt into ranges of the order, so beginnings that many names share don't
    meet in one task.
    """
    key = F.collate(F.col(name), "UNICODE_CI")
    names = df.groupBy(key.alias("_name")).agg(F.count("*").alias("_n"))
    rows, ranges = placed(names.withColumn("_name", F.col("_name").cast("string")), F.collate("_name", "UNICODE_CI"))
    upto = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_within", F.coalesce(F.sum("_n").over(upto), F.lit(0)))
    of_range = rows.groupBy("part").agg(F.sum("_n").alias("_all"))
    before = F.coalesce(F.sum("_all").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = of_range.select("part", before.alias("_before"))  # a row for each range
    ranks = rows.join(F.broadcast(starts), "part").select(F.collate("_name", "UNICODE_CI").alias("_ranked"), (F.col("_before") + F.col("_within") + 1).alias(alias))
    return df.withColumn("_name", key).join(ranks, F.col("_name").eqNullSafe(F.col("_ranked")), "left").select(*df.columns, alias)


def grams(text: Column, size: int = 3) -> Column:
    """array<string>: the distinct substrings of so many characters of a text in lower case; none of a shorter one."""
    low = F.lower(text)
    return F.when(F.length(low) >= size, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(low) - size + 1), lambda k: F.substring(low, k, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def postings(df: DataFrame, key: str, text: str, size: int = 3) -> tuple[DataFrame, DataFrame]:
    """((gram, key), (gram, n)): where each gram occurs, sorted by gram in a saved table, and in how many rows."""
    each = df.select(F.explode(grams(F.col(text), size)).alias("gram"), key)
    index = saved(each.repartitionByRange("gram", key).sortWithinPartitions("gram"), "postings")
    return index, saved(index.groupBy("gram").agg(F.count("*").alias("n")), "gram-counts")


def found_by_grams(df: DataFrame, key: str, text: str, terms: DataFrame, term: str, index: DataFrame, counts: DataFrame, size: int = 3) -> DataFrame:
    """(term, key): rows whose text contains a term, whatever the case.

    Rows with the term's rarest gram are candidates, confirmed on the text. A term with
    a gram that no row has finds nothing; terms shorter than a gram look at all grams that contain them.
    """
    wanted = terms.select(F.col(term).alias("_term"), F.lower(F.col(term)).alias("_low")).where("_low <> ''").distinct()
    each = wanted.where(F.length("_low") >= size).select("_term", "_low", F.explode(grams(F.col("_low"), size)).alias("gram")).join(counts, "gram", "left")
    rarest = each.groupBy("_term", "_low").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    short = wanted.where(F.length("_low") < size).join(counts.select("gram"), F.contains("gram", F.col("_low"))).select("_term", "_low", "gram")
    pairs = rarest.union(short).join(index, "gram").select("_term", "_low", key).distinct()
    tiny = wanted.where(F.length("_low") < size).join(df.where(F.length(text) < size).select(key, text), F.contains(F.lower(F.col(text)), F.col("_low"))).select(F.col("_term").alias(term), key)  # texts without a gram
    hits = pairs.join(df.select(key, text), key).where(F.contains(F.lower(F.col(text)), F.col("_low"))).select(F.col("_term").alias(term), key)
    return hits.union(tiny)


def null_or(column: Column, value) -> Column:
    return column.isNull() | (column == value)


def looked_up(df: DataFrame, dimension: DataFrame, key: str, name: str, alias: str, default: str = "") -> DataFrame:
    """df with the dimension's name for its key, a default where there's none. Spark broadcasts the dimension if it's small."""
    names = dimension.select(key, F.col(name).alias(alias))
    return df.join(names, key, "left").withColumn(alias, F.coalesce(alias, F.lit(default)))


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_turn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_turn = 1").drop("_turn")


def flagged(df: DataFrame, others: DataFrame, key: Column, flag: str) -> DataFrame:
    """df with a flag: whether others has its key."""
    known = others.select(key.alias("_key"), F.lit(True).alias(flag)).where("_key is not null").distinct()
    return df.withColumn("_key", key).join(known, "_key", "left").withColumn(flag, F.coalesce(flag, F.lit(False))).drop("_key")


def by_priority(df: DataFrame, candidates: DataFrame, tiers: list[tuple[list[str], Column]], value: Column, alias: str) -> DataFrame:
    """df with the value of the first tier that has its keys; a tier is (key columns, rows of it), its largest value counts."""
    names = []
    for k, (keys, rows) in enumerate(tiers):
        name = f"_tier{k}"
        df = df.join(candidates.where(rows).groupBy(*keys).agg(F.max(value).alias(name)), keys, "left")
        names.append(name)
    return df.withColumn(alias, F.coalesce(*names)).drop(*names)


def upper_median(df: DataFrame, keys: list[str], value: str, alias: str) -> DataFrame:
    """sorted[floor(n / 2)] of each group, from counts of values: no group is gathered."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys).orderBy(value)
    upto = counts.withColumn("_upto", F.sum("_n").over(w)).withColumn("_all", F.sum("_n").over(Window.partitionBy(*keys)))
    return upto.where("_upto > floor(_all / 2)").groupBy(*keys).agg(F.min(value).alias(alias))


def similar_names(df: DataFrame, key: str, name: str, least: float = 0.72) -> DataFrame:
    """(a, b, score): pairs of keys whose names share least of the larger token set. Candidates share a token.

    Tokens are read rarest first, and only those that a pair must share at this share are
    joined, so frequent tokens form few candidates.
    """
    tokens = F.array_distinct(F.filter(F.split(F.lower(name), "[^a-z0-9]+"), lambda w: w != ""))
    rows = df.select(F.col(key).alias("id"), tokens.alias("tokens")).where(F.size("tokens") > 0)
    each = rows.select("id", F.explode("tokens").alias("token"))
    rare = each.groupBy("token").agg(F.count("*").alias("n"))
    ordered = each.join(rare, "token").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "token")))["token"].alias("tokens"))
    must = (F.size("tokens") - F.ceil(F.size("tokens") * F.lit(least)) + 1).cast("int")
    probes = ordered.select("id", "tokens", F.explode(F.slice("tokens", F.lit(1), must)).alias("token"))
    left = probes.select(F.col("id").alias("a"), F.col("tokens").alias("x"), "token")
    right = probes.select(F.col("id").alias("b"), F.col("tokens").alias("y"), "token")
    pairs = left.join(right, "token").where("a < b").select("a", "b", "x", "y").dropDuplicates(["a", "b"])
    score = F.size(F.array_intersect("x", "y")) / F.greatest(F.size("x"), F.size("y"))
    return pairs.select("a", "b", score.alias("score")).where(F.col("score") >= least)
