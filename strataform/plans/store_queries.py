"""Registered queries over positions, indexes, saves and chains of records."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strataform.operators import catalogue, inheritance
from strataform.plans.catalogue_queries import query
from strataform.sources.staging import Versions, shared_dir
from strataform.sources.tables import table
from strataform.streaming import status_machine


@query("""WITH p AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS position FROM orders)
  SELECT position // 24 AS page, count(*) AS n, min_by(o_orderkey, position) AS first_key, max_by(o_orderkey, position) AS last_key FROM p GROUP BY 1""")
def deep_pages(spark, d):
    """Every page of 24 of all orders, from positions over ranges."""
    rows, _ = catalogue.placed(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), F.desc("o_totalprice"), F.asc("o_orderkey"))
    page = F.floor(F.col("position") / 24).alias("page")
    return rows.groupBy(page).agg(F.count("*").alias("n"), F.min_by("o_orderkey", "position").alias("first_key"), F.max_by("o_orderkey", "position").alias("last_key"))


@query("""SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 12 OFFSET (SELECT count(*) // 2 // 12 * 12 FROM orders)""")
def middle_page(spark, d):
    """The page in the middle of all orders, read from the ranges that hold it."""
    rows, ranges = catalogue.placed(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), F.desc("o_totalprice"), F.asc("o_orderkey"))
    n = ranges.agg(F.sum("n")).first()[0]
    return catalogue.placed_page(rows, ranges, n // 2 // 12).select("o_orderkey", "o_totalprice")


@query("""WITH p AS (SELECT *, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS k FROM orders) SELECT o_orderkey FROM p WHERE k BETWEEN 37 AND 48""")
def keyset_page(spark, d):
    """The fourth page of the newest orders, each page behind the last row of the one before."""
    rows, order, last = table(spark, d, "orders").select("o_orderkey", "o_orderdate"), [("o_orderdate", False), ("o_orderkey", True)], None
    for _ in range(3):
        last = catalogue.after(rows, order, last).collect()[-1].asDict()  # a page
    return catalogue.after(rows, order, last).select("o_orderkey")


@query("""WITH t AS (SELECT DISTINCT right(s_name, 4) AS term FROM supplier UNION SELECT 'oMER#' UNION SELECT '9' UNION SELECT 'nobody')
  SELECT term, c_custkey FROM t JOIN customer ON contains(lower(c_name), lower(term))""")
def gram_search(spark, d):
    """Rows that contain a term, by the postings of its rarest gram: the ends of all suppliers' names and three others."""
    customers = table(spark, d, "customer").select("c_custkey", "c_name")
    ends = table(spark, d, "supplier").select(F.right("s_name", F.lit(4)).alias("term"))
    terms = ends.union(spark.createDataFrame([("oMER#",), ("9",), ("nobody",)], "term string")).distinct()
    index, counts = catalogue.postings(customers, "c_custkey", "c_name")
    return catalogue.found_by_grams(customers, "c_custkey", "c_name", terms, "term", index, counts)


@query("""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'own ' || c_custkey ELSE coalesce('own ' || last_value(CASE WHEN c_acctbal < 0 THEN c_custkey END IGNORE NULLS) OVER (PARTITION BY c_nationkey ORDER BY c_custkey), '') END AS ingredients,
  lag(c_name) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS base_name FROM customer""")
def inherited_chains(spark, d):
    """Records that refer to the one before them, in chains of any length; a nation is a book, a negative balance has a list of its own."""
    own = F.when(F.col("c_acctbal") < 0, F.array(F.concat(F.lit("own "), "c_custkey"))).otherwise(F.array().cast("array<string>"))
    rows = table(spark, d, "customer").select("c_nationkey", F.col("c_custkey").alias("pos"), F.col("c_name").alias("name"), own.alias("ingredients"), F.array(F.lit("Same dough, baked.")).alias("method"))
    found = inheritance.inherited(rows, "c_nationkey")
    return found.select(F.col("pos").alias("c_custkey"), F.array_join("ingredients", "|").alias("ingredients"), "base_name")


@query("""SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' OR o_orderkey % 2 = 0 AND o_orderstatus = 'O'""")
def partial_save(spark, d):
    """Batches saved until one fails; a replayed one changes nothing, and one that's taken back goes."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    saves = Versions(spark, f"{shared_dir(spark)}/orders-{uuid.uuid4().hex}", "o_orderkey long, o_orderstatus string")
    odd = F.when(F.col("o_orderkey") % 2 == 1, F.col("o_orderkey")).otherwise(F.raise_error(F.lit("an even key")).cast("long"))
    report = saves.save_each([
        ("finished", orders.where("o_orderstatus = 'F'")), ("open", orders.where("o_orderstatus = 'O'")), ("open, even", orders.where("o_orderstatus = 'O' AND o_orderkey % 2 = 0")),
        ("failing", orders.where("o_orderstatus = 'F'").withColumn("o_orderkey", odd)), ("never", orders),
    ])
    saves.save(orders, "finished")  # a replay
    saves.undo_batches([report["saved"][1]])
    return saves.read()


#: What may follow what in the events of a user, and the statuses that time out after six hours.
FOLLOWS = {"": ("signup", "view"), "signup": ("view",), "view": ("click", "error"), "click": ("purchase", "view", "error"), "error": ("view", "signup"), "purchase": ("view",), "timed out": ("view", "signup")}
WAITING, SECONDS = ("view", "click"), 6 * 3600
ALLOWED = "[" + ", ".join(f"'{a}>{b}'" for a, after in FOLLOWS.items() for b in after) + "]"


@query(f"""WITH RECURSIVE e AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
  f AS (SELECT DISTINCT user_id, 0::BIGINT AS i, NULL::BIGINT AS event_id, NULL::VARCHAR AS said, '' AS before, false AS accepted, '' AS status, NULL::TIMESTAMP AS since FROM events
    UNION ALL SELECT user_id, i, event_id, event_type, met, ok, CASE WHEN ok THEN event_type ELSE met END, CASE WHEN ok THEN ts WHEN met = status THEN since ELSE since + INTERVAL {SECONDS} SECOND END FROM (
      SELECT *, list_contains({ALLOWED}, met || '>' || event_type) AS ok FROM (
        SELECT e.*, f.status, f.since, CASE WHEN f.status IN {WAITING} AND e.ts - f.since >= INTERVAL {SECONDS} SECOND THEN 'timed out' ELSE f.status END AS met FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)))
  SELECT user_id, event_id, said AS status, before, accepted FROM f WHERE i > 0""")
def status_transitions(spark, d):
    """The events of each user, judged by what may follow what; waiting statuses time out."""
    events = table(spark, d, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("status"))
    return status_machine.transitions(events, "user_id", FOLLOWS, SECONDS, WAITING).select("user_id", "event_id", "status", "before", "accepted")
