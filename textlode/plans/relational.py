"""Listings, joins and aggregates of the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textlode.functions import text as T
from textlode.operators import awareness
from textlode.plans.extraction import TERM_MENTIONS_SQL, held_terms
from textlode.plans.registry import query
from textlode.sources.tables import ATTEMPTS_SQL, attempts, table

MENTIONS_SQL = f"{TERM_MENTIONS_SQL}, mentions AS (SELECT DISTINCT term, doc_id, source FROM held)"


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(term, doc_id, source): which texts name which known terms."""
    return held_terms(spark, sf_dir, "source")


@query("SELECT source AS collection, count(*) AS documents, coalesce(sum(n_chars), 0)::BIGINT AS chars, max(n_chars) AS longest, count(DISTINCT lang) AS langs FROM documents GROUP BY source")
def collection_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("collection"))
    return d.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("chars"), F.max("n_chars").alias("longest"), F.count_distinct("lang").alias("langs"))


@query("SELECT d.doc_id, d.source, count(l.doc_id) AS labels FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY d.doc_id, d.source")
def document_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, counts = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.count("*").alias("labels"))
    return d.select("doc_id", "source").join(counts, "doc_id", "left").withColumn("labels", F.coalesce("labels", F.lit(0)))


@query("""SELECT key, value, count(DISTINCT doc_id) AS documents FROM (SELECT doc_id, 'lang' AS key, lang AS value FROM documents
  UNION ALL SELECT doc_id, 'source', source FROM documents) GROUP BY key, value""")
def facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").unpivot("doc_id", ["lang", "source"], "key", "value")
    return d.groupBy("key", "value").agg(F.count_distinct("doc_id").alias("documents"))


@query("""SELECT p_partkey FROM (SELECT p_partkey, 'brand' AS key, p_brand AS value FROM part UNION ALL SELECT p_partkey, 'even', (p_size % 2 = 0)::VARCHAR FROM part)
  WHERE (key, value) IN (('brand', (SELECT min(p_brand) FROM part)), ('even', 'true')) GROUP BY p_partkey HAVING count(DISTINCT key) = 2""")
def metadata_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that meet every (key, value) filter: one aggregate instead of a join for each filter."""
    p = table(spark, sf_dir, "part")
    brand = F.broadcast(p.agg(F.min("p_brand").alias("value")).withColumn("key", F.lit("brand")))  # one row
    wanted = brand.unionByName(spark.createDataFrame([("even", "true")], "key string, value string"))
    pairs = p.select("p_partkey", F.col("p_brand").alias("brand"), (F.col("p_size") % 2 == 0).cast("string").alias("even")).unpivot("p_partkey", ["brand", "even"], "key", "value")
    return pairs.join(F.broadcast(wanted), ["key", "value"]).groupBy("p_partkey").agg(F.count_distinct("key").alias("n")).filter("n = 2").select("p_partkey")


@query("""SELECT n_name, r_name, count(c_custkey) AS customers, round(coalesce(sum(c_acctbal), 0), 2) AS balance FROM nation
  JOIN region ON r_regionkey = n_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL""")
def nation_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r, c = (table(spark, sf_dir, t) for t in ("nation", "region", "customer"))
    sums = c.groupBy("c_nationkey").agg(F.count("*").alias("customers"), F.sum("c_acctbal").alias("balance"))
    named = n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).join(sums, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return named.select("n_name", "r_name", F.coalesce("customers", F.lit(0)).alias("customers"), F.round(F.coalesce("balance", F.lit(0.0)), 2).alias("balance"))


@query("""SELECT o_orderkey, o_totalprice, c_name FROM orders JOIN customer ON c_custkey = o_custkey
  WHERE o_totalprice >= 1000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 50""")
def ordered_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limit comes before the join, so fifty rows are joined."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    first = o.filter("o_totalprice >= 1000").join(c.select("c_custkey"), F.col("c_custkey") == F.col("o_custkey"), "left_semi")
    first = first.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50)
    return c.join(F.broadcast(first), F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", "o_totalprice", "c_name")


@query("""SELECT o_orderkey, o_orderpriority, total FROM (SELECT o_orderkey, o_orderpriority, count(*) OVER () AS total,
  row_number() OVER (ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END, o_orderkey) AS n FROM orders WHERE o_orderstatus = 'O')
  WHERE n > 20 AND n <= 40""")
def paged_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page by urgency, with the total; the total is a separate aggregate, so no window meets all rows in one task."""
    o = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'")
    order = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(2)
    page = o.orderBy(order, "o_orderkey").offset(20).limit(20).select("o_orderkey", "o_orderpriority")
    return page.crossJoin(F.broadcast(o.agg(F.count("*").alias("total"))))  # one row


@query(f"""WITH {MENTIONS_SQL} SELECT a.term AS a, b.term AS b, count(DISTINCT a.doc_id) AS sources FROM mentions a
  JOIN mentions b ON a.doc_id = b.doc_id AND a.term < b.term GROUP BY 1, 2""")
def cooccurrence_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of terms by texts that name both: pairs are made inside a text's row."""
    m = mentions(spark, sf_dir).select(F.col("term").alias("entity"), F.col("doc_id").alias("source"))
    return awareness.connections(m).select("a", "b", "sources")


@query(f"""WITH {MENTIONS_SQL}, sources AS (SELECT DISTINCT term, source FROM mentions)
SELECT term, count(*) AS sources, count(*) * (count(*) - 1) // 2 AS mismatches FROM sources GROUP BY term HAVING count(*) > 1""")
def mention_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that several sources name, with the number of source pairs: counted, not joined."""
    m = mentions(spark, sf_dir).select("term", "source").distinct().groupBy("term").agg(F.count("*").alias("sources")).filter("sources > 1")
    return m.withColumn("mismatches", F.expr("sources * (sources - 1) div 2"))


@query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)
  AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)""")
def orphan_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links whose object is gone and whose subject is there: an anti join and a semi join."""
    li, p, s = (table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier"))
    left = li.join(p.filter("p_size > 5").select("p_partkey"), F.col("l_partkey") == F.col("p_partkey"), "left_anti")
    return left.join(s.filter("s_acctbal > 0").select("s_suppkey"), F.col("l_suppkey") == F.col("s_suppkey"), "left_semi").select("l_orderkey", "l_linenumber")


@query(f"""WITH {ATTEMPTS_SQL} SELECT tool, count(*) AS total, count(*) FILTER (ok) AS success, count(*) FILTER (NOT ok) AS failure,
  round(count(*) FILTER (ok) / count(*), 6) AS rate FROM attempts WHERE created_at >= TIMESTAMP '2024-01-10' GROUP BY tool""")
def success_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = attempts(spark, sf_dir).filter("created_at >= TIMESTAMP_NTZ '2024-01-10 00:00:00'").groupBy("tool")
    counted = a.agg(F.count("*").alias("total"), F.count_if("ok").alias("success"), F.count_if(~F.col("ok")).alias("failure"))
    return counted.withColumn("rate", F.round(F.col("success") / F.col("total"), 6))


@query("""SELECT user_id, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'error') AS errors,
  count(*) FILTER (event_type = 'purchase') AS purchases, count(*) AS events FROM events GROUP BY user_id""")
def counts_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = lambda k: F.count_if(F.col("event_type") == k)
    e = table(spark, sf_dir, "events").groupBy("user_id")
    return e.agg(kind("click").alias("clicks"), kind("error").alias("errors"), kind("purchase").alias("purchases"), F.count("*").alias("events"))


@query("""SELECT event_type, count(*) AS n, round(list_sort(list(value))[floor(count(*) * 0.5)::BIGINT + 1], 6) AS p50,
  round(list_sort(list(value))[least(floor(count(*) * 0.95)::BIGINT + 1, count(*))], 6) AS p95, round(avg(value), 6) AS mean FROM events GROUP BY event_type""")
def awareness_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank percentiles in two passes: counts of narrow ranges say which range holds a rank, and only that range is ordered."""
    e = table(spark, sf_dir, "events").select("event_type", "value", F.floor(F.col("value") * 4).alias("range"))
    counts = e.groupBy("event_type", "range").agg(F.count("*").alias("n"))
    by = Window.partitionBy("event_type")
    before = F.coalesce(F.sum("n").over(by.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.lit(q).alias("q")) for name, q in (("p50", 0.5), ("p95", 0.95)))))
    placed = counts.withColumns({"before": before, "all": F.sum("n").over(by)}).withColumn("x", ranks)
    rank = F.least(F.floor(F.col("all") * F.col("x.q")), F.col("all") - 1)
    held = placed.withColumn("place", rank - F.col("before")).filter("place >= 0 AND place < n").select("event_type", "range", F.col("x.name").alias("name"), "place")
    inside = e.join(F.broadcast(held), ["event_type", "range"])  # two rows a type
    order = F.row_number().over(Window.partitionBy("event_type", "name").orderBy("value")) - 1
    found = inside.withColumn("at", order).filter(F.col("at") == F.col("place")).groupBy("event_type").pivot("name", ["p50", "p95"]).agg(F.round(F.max("value"), 6))
    means = e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    return means.join(found, "event_type").select("event_type", "n", "p50", "p95", "mean")


@query("""SELECT count(*) AS total, round(count(*) FILTER (value >= 5) / count(*), 6) AS hit_rate, round(avg(value), 6) AS mean,
  count(*) FILTER (value < 1) AS low, count(*) FILTER (value > 60) AS slow FROM events""")
def query_analytics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.agg(
        F.count("*").alias("total"), F.round(F.count_if(F.col("value") >= 5) / F.count("*"), 6).alias("hit_rate"), F.round(F.avg("value"), 6).alias("mean"),
        F.count_if(F.col("value") < 1).alias("low"), F.count_if(F.col("value") > 60).alias("slow"),
    )


@query("""SELECT coalesce(a.event_id, b.event_id) AS event_id, CASE WHEN a.event_id IS NULL THEN 'added' WHEN b.event_id IS NULL THEN 'removed'
  WHEN a.version <> b.version THEN 'modified' ELSE 'same' END AS change
FROM (SELECT event_id, user_id AS version FROM events WHERE event_id % 3 <> 0) a
FULL JOIN (SELECT event_id, user_id + (event_id % 5 = 0)::INT AS version FROM events WHERE event_id % 4 <> 0) b ON a.event_id = b.event_id""")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest without every third event against a listing without every fourth, in which every fifth is newer."""
    from textlode.sources.snapshots import changes

    e = table(spark, sf_dir, "events")
    old = e.filter("event_id % 3 <> 0").select("event_id", F.col("user_id").alias("version"))
    new = e.filter("event_id % 4 <> 0").select("event_id", (F.col("user_id") + (F.col("event_id") % 5 == 0).cast("int")).alias("version"))
    return changes(old, new, "event_id", "version")


@query("""SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS first_id, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) > 1 AS duplicate FROM documents""")
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of a text and the first of them: digests are aggregated before they are joined, so copies are not one task's rows."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    first = d.groupBy(F.col("digest").alias("of")).agg(F.min("doc_id").alias("first_id"))
    return d.join(first, F.col("digest").eqNullSafe(F.col("of"))).select("doc_id", "first_id", (F.col("doc_id") != F.col("first_id")).alias("duplicate"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").filter("l_shipdate <= TIMESTAMP_NTZ '1998-09-02 00:00:00'").groupBy("l_returnflag", "l_linestatus")
    revenue = F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return li.agg(F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(revenue, 2).alias("revenue"), F.count("*").alias("n"))
