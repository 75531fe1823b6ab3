"""Queries over awards, sources and fact candidates: customer, orders, lineitem, part, supplier, nation, region."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import facts, keyed, rollups
from tidemark.operators.search import ranked_search
from tidemark.sources import tables

from .registry import query

FIELDS = "CASE l_returnflag WHEN 'A' THEN 'deadline' WHEN 'N' THEN 'amount' ELSE 'eligibility' END"


def field_name():
    """Fields by returnflag, as in FIELDS."""
    return F.when(F.col("l_returnflag") == "A", "deadline").when(F.col("l_returnflag") == "N", "amount").otherwise("eligibility")


@query("""SELECT c_custkey, o_orderkey, o_orderdate FROM customer LEFT JOIN (SELECT * FROM orders QUALIFY row_number() OVER (
    PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) ON o_custkey = c_custkey""")
def lateral_latest_child(spark, sf_dir):
    parents = tables.table(spark, sf_dir, "customer", "c_custkey")
    children = tables.table(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_orderdate")
    latest = keyed.latest_per_key(children, ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return parents.join(latest, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey", "o_orderdate")


@query("""SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC)::INTEGER AS place FROM orders
    QUALIFY place > 2""")
def supersede_duplicates(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    order = [F.desc("o_orderdate"), F.desc("o_orderkey")]
    return keyed.occurrences(rows, ["o_custkey", "o_orderstatus"], order, "place").filter("place > 2").select("o_orderkey", "o_custkey", "place")


@query("""SELECT p_partkey, CASE WHEN n = 1 THEN base ELSE base || '-' || n END AS slug FROM (
    SELECT p_partkey, base, row_number() OVER (PARTITION BY base ORDER BY p_partkey) AS n FROM (
    SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g') AS base FROM part))""")
def unique_slugs(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "part", "p_partkey", "p_name").withColumn("base", T.slug(F.col("p_name")))
    numbered = keyed.occurrences(rows, ["base"], [F.asc("p_partkey")], "n")
    return numbered.select("p_partkey", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", F.col("n").cast("string"))).alias("slug"))


@query("SELECT a.s_suppkey, min(b.s_suppkey) AS lead_key, count(*)::BIGINT AS members FROM supplier a JOIN supplier b USING (s_nationkey) GROUP BY a.s_suppkey")
def cohort_members(spark, sf_dir):
    """Members of a cohort with its size and first member; the cohort is aggregated, so members never meet in pairs."""
    rows = tables.table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey")
    cohorts = rows.groupBy("s_nationkey").agg(F.min("s_suppkey").alias("lead_key"), F.count("*").alias("members"))
    return rows.join(cohorts, "s_nationkey").select("s_suppkey", "lead_key", "members")


@query("""SELECT r_name, n_name, count(s_suppkey)::BIGINT AS suppliers, sum(s_acctbal::DECIMAL(18,2))::DOUBLE AS balance FROM region JOIN nation ON n_regionkey = r_regionkey
    LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2""")
def hierarchy_rollup(spark, sf_dir):
    region, nation = tables.table(spark, sf_dir, "region"), tables.table(spark, sf_dir, "nation")
    supplier = tables.table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey", "s_acctbal")
    sums = supplier.groupBy("s_nationkey").agg(F.count("s_suppkey").alias("n"), F.sum(F.col("s_acctbal").cast("decimal(18,2)")).alias("b"))
    rows = region.join(nation, F.col("n_regionkey") == F.col("r_regionkey")).join(sums, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return rows.select("r_name", "n_name", F.coalesce("n", F.lit(0)).cast("long").alias("suppliers"), F.col("b").cast("double").alias("balance"))


@query("""SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS best_order, max(o_totalprice) AS best_price, count(*)::BIGINT AS n FROM orders GROUP BY o_custkey""")
def argmax_per_group(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_totalprice")
    best = F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey")))
    return rows.groupBy("o_custkey").agg(best.alias("best_order"), F.max("o_totalprice").alias("best_price"), F.count("*").alias("n"))


@query("""SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_orderpriority FROM orders ORDER BY o_custkey, o_orderpriority, o_orderdate DESC, o_orderkey""")
def distinct_on_priority(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_orderpriority", "o_orderdate")
    return keyed.first_per_key(rows, ["o_custkey"], [F.asc("o_orderpriority"), F.desc("o_orderdate"), F.asc("o_orderkey")]).drop("o_orderdate")


@query("""SELECT c_custkey, c_name, coalesce(c_mktsegment, 'NONE') AS segment FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')""")
def without_match(spark, sf_dir):
    done = tables.table(spark, sf_dir, "orders", "o_custkey", "o_orderstatus").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    rows = tables.table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment").join(done, "c_custkey", "left_anti")
    return rows.select("c_custkey", "c_name", F.coalesce("c_mktsegment", F.lit("NONE")).alias("segment"))


@query("""SELECT o_custkey, max(o_totalprice) AS top_price, arg_min(o_orderpriority, (o_orderdate, o_orderkey)) AS first_priority, min(o_orderdate) AS first_date FROM orders GROUP BY o_custkey""")
def field_merge(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "orders").selectExpr(
        "o_custkey", "o_orderkey", "o_orderdate", "o_totalprice AS top_price", "o_orderpriority AS first_priority", "o_orderdate AS first_date"
    )
    return keyed.merge_fields(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"], {"top_price": "max", "first_priority": "first", "first_date": "min"})


@query("""SELECT l_orderkey, l_linenumber, count(*) OVER () AS total FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_discount BETWEEN 0.04 AND 0.06
    AND l_extendedprice < 40000 AND l_extendedprice + l_quantity * 100 > 39000""")
def overlap_rectangles(spark, sf_dir):
    """Rows whose open interval of prices overlaps a fixed one; the total is an aggregate of its own, not a window over all rows."""
    rows = tables.table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_extendedprice").filter(
        "l_quantity BETWEEN 10 AND 20 AND l_discount BETWEEN 0.04D AND 0.06D AND l_extendedprice < 40000 AND l_extendedprice + l_quantity * 100 > 39000"
    )
    return rows.join(F.broadcast(rows.agg(F.count("*").alias("total")))).select("l_orderkey", "l_linenumber", "total")


@query("""WITH q AS (SELECT p_partkey, p_name, lower(p_name) AS k, lower(p_type) AS t FROM part),
    r AS (SELECT *, CASE WHEN k = 'red widget' THEN 0 WHEN starts_with(k, 'red widget') THEN 2 WHEN contains(k, 'red widget') THEN 3
      WHEN contains(k, 'red') AND contains(k, 'widget') THEN 4 WHEN contains(t, 'red widget') THEN 6
      WHEN contains(k || ' ' || t, 'red') AND contains(k || ' ' || t, 'widget') THEN 7 END AS rank FROM q)
    SELECT p_partkey, p_name, rank FROM r WHERE rank IS NOT NULL""")
def ranked_name_search(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "part", "p_partkey", "p_name", "p_type")
    return ranked_search(rows, "Red Widget", "p_name", "p_type", ["p_partkey"]).select("p_partkey", "p_name", "rank")


@query("SELECT p_partkey, p_name, p_size FROM part ORDER BY p_size DESC, p_name, p_partkey LIMIT 50 OFFSET 50")
def facet_page(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "part", "p_partkey", "p_name", "p_size")
    return tables.clamped_page(rows, [F.desc_nulls_last("p_size"), F.asc_nulls_last("p_name"), F.asc("p_partkey")], 2, 50)


@query("""SELECT o_orderkey, f.n AS field_name, f.v AS raw_value FROM (SELECT o_orderkey, unnest([{'n': 'status', 'v': o_orderstatus}, {'n': 'priority', 'v': o_orderpriority},
    {'n': 'month', 'v': strftime(o_orderdate, '%Y-%m')}]) AS f FROM orders) WHERE trim(f.v) <> ''""")
def fact_unpivot(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority", "o_orderdate")
    values = {"status": F.col("o_orderstatus"), "priority": F.col("o_orderpriority"), "month": F.date_format("o_orderdate", "yyyy-MM")}
    return facts.unpivot_facts(rows, ["o_orderkey"], values)


RECONCILED = f"""
    WITH c AS (SELECT l_orderkey, {FIELDS} AS field_name, l_linestatus || '-' || (l_quantity::INTEGER % 3) AS value, l_extendedprice AS score,
               l_partkey * 10 + l_linenumber AS tie FROM lineitem),
    s AS (SELECT l_orderkey, field_name, arg_max(value, (score, -tie)) AS value, count(DISTINCT lower(trim(value)))::BIGINT AS n_values, count(*)::BIGINT AS n_candidates
          FROM c GROUP BY 1, 2)"""


def _reconciled(spark, sf_dir):
    lines = tables.table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice")
    value = F.concat_ws("-", "l_linestatus", (F.col("l_quantity").cast("int") % 3).cast("string"))
    candidates = lines.select(
        "l_orderkey", field_name().alias("field_name"), value.alias("raw"), F.col("l_extendedprice").alias("score"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("tie")
    )
    return facts.reconcile(candidates, ["l_orderkey"], "raw", "score", "tie")


@query(RECONCILED + " SELECT *, n_values > 1 AS conflict FROM s")
def fact_reconcile(spark, sf_dir):
    return _reconciled(spark, sf_dir)


@query(RECONCILED + " SELECT field_name, count(*)::BIGINT AS n, count(*) FILTER (WHERE n_values > 1)::BIGINT AS conflicts FROM s GROUP BY field_name")
def fact_conflicts(spark, sf_dir):
    return _reconciled(spark, sf_dir).groupBy("field_name").agg(F.count("*").alias("n"), F.count_if("conflict").alias("conflicts"))


@query(RECONCILED + """ SELECT l_orderkey, max(value) FILTER (WHERE field_name = 'deadline') AS deadline, max(value) FILTER (WHERE field_name = 'amount') AS amount,
    max(value) FILTER (WHERE field_name = 'eligibility') AS eligibility FROM s GROUP BY l_orderkey""")
def fact_public_pivot(spark, sf_dir):
    return facts.pivot_facts(_reconciled(spark, sf_dir), ["l_orderkey"], ["deadline", "amount", "eligibility"])


@query(RECONCILED + """, p AS (SELECT l_orderkey, max(value) FILTER (WHERE field_name = 'deadline') AS deadline, max(value) FILTER (WHERE field_name = 'amount') AS amount FROM s GROUP BY 1)
    SELECT p.l_orderkey, coalesce(deadline, o_orderstatus) AS deadline, coalesce(amount, o_orderpriority) AS amount,
    concat_ws(',', CASE WHEN deadline IS NULL AND o_orderstatus IS NOT NULL THEN 'deadline' END, CASE WHEN amount IS NULL AND o_orderpriority IS NOT NULL THEN 'amount' END) AS preserved
    FROM p LEFT JOIN orders ON o_orderkey = p.l_orderkey""")
def fact_last_known_good(spark, sf_dir):
    new = facts.pivot_facts(_reconciled(spark, sf_dir), ["l_orderkey"], ["deadline", "amount"])
    old = tables.table(spark, sf_dir, "orders").selectExpr("o_orderkey AS l_orderkey", "o_orderstatus AS deadline", "o_orderpriority AS amount")
    return facts.last_known_good(new, old, ["l_orderkey"], ["deadline", "amount"])


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS sum_qty, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS sum_base_price,
    sum((l_extendedprice::DECIMAL(18,2)) * (1 - l_discount::DECIMAL(4,2)))::DOUBLE AS sum_disc_price, count(*)::BIGINT AS count_order
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "lineitem", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate")
    price, discount = F.col("l_extendedprice").cast("decimal(18,2)"), F.col("l_discount").cast("decimal(4,2)")
    return rows.filter("l_shipdate <= TIMESTAMP_NTZ '1998-09-02 00:00:00'").groupBy("l_returnflag", "l_linestatus").agg(
        F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("sum_qty"), F.sum(price).cast("double").alias("sum_base_price"),
        F.sum(price * (F.lit(1) - discount)).cast("double").alias("sum_disc_price"), F.count("*").alias("count_order"),
    )


@query("""SELECT c_mktsegment, to_json(map_from_entries(list((o_orderstatus, n) ORDER BY o_orderstatus)))::VARCHAR AS statuses FROM (
    SELECT c_mktsegment, o_orderstatus, count(*)::BIGINT AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2) GROUP BY 1""")
def json_object_agg(spark, sf_dir):
    customers, orders = tables.table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment"), tables.table(spark, sf_dir, "orders", "o_custkey", "o_orderstatus")
    counted = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment", "o_orderstatus").agg(F.count("*").alias("n"))
    pairs = F.array_sort(F.collect_list(F.struct("o_orderstatus", "n")))  # one entry a status
    return counted.groupBy("c_mktsegment").agg(F.to_json(F.map_from_entries(pairs)).alias("statuses"))


@query("""SELECT count(*)::BIGINT AS total, count(*) FILTER (WHERE o_orderstatus = 'F')::BIGINT AS finished,
    round(count(*) FILTER (WHERE o_orderstatus = 'F') * 100.0 / count(*), 1) AS percent_finished FROM orders""")
def coverage_ratio(spark, sf_dir):
    rows = rollups.measures(tables.table(spark, sf_dir, "orders", "o_orderstatus"), [], {"finished": F.col("o_orderstatus") == "F"})
    return rows.withColumn("percent_finished", rollups.percent(F.col("finished"), F.col("total")))
