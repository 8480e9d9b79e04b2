"""Tables written in a layout of the sources and read back through them, and checks that need no other table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axonlake.functions import arrays, basic
from axonlake.operators import reports, sampling
from axonlake.plans.registry import query, six, table
from axonlake.sources import tables
from axonlake.sources.shared import forget, shared_folder


def place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which goes when the application ends."""
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    forget(spark, folder)
    return f"{folder}/data"


def as_csv(df: DataFrame, name: str) -> str:
    path = place(df.sparkSession, name)
    df.write.option("header", True).option("compression", "gzip").csv(path)
    return path


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, nullif(c_mktsegment, 'BUILDING') AS c_mktsegment FROM customer")
def csv_customers(spark, d):
    c = table(spark, d, "customer").withColumn("c_mktsegment", F.when(F.col("c_mktsegment") != "BUILDING", F.concat(F.lit(" "), "c_mktsegment", F.lit(" "))).otherwise(" "))
    return tables.csv_table(spark, as_csv(c, "customers"), {"c_custkey": "long", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"})


@query("SELECT l_partkey AS pre_root_id, l_suppkey AS post_root_id, CAST(sum(l_linenumber) AS BIGINT) AS synapses, count(*) FILTER (l_returnflag <> 'N') AS known FROM lineitem GROUP BY ALL")
def release_connections(spark, d):
    """Line items as the connections of a release of three tables, converted and read back."""
    li, part = table(spark, d, "lineitem"), table(spark, d, "part")
    paths = {
        "connections": as_csv(li.select(F.col("l_partkey").alias("pre_root_id"), F.col("l_suppkey").alias("post_root_id"), F.col("l_linenumber").alias("syn_count"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("neuropil")), "connections"),
        "classification": as_csv(part.select(F.col("p_partkey").alias("root_id"), *(F.col("p_type").alias(c) for c in ("flow", "super_class", "class", "sub_class", "cell_type", "side"))), "classification"),
        "neurons": as_csv(part.select(F.col("p_partkey").alias("root_id"), F.col("p_brand").alias("nt_type"), (F.col("p_size") / 64).alias("nt_type_score")), "neurons"),
    }
    manifest = tables.convert_release(spark, paths, place(spark, "release"))
    read = spark.read.parquet(manifest["connections"]["path"])
    return read.groupBy("pre_root_id", "post_root_id").agg(F.sum("syn_count").alias("synapses"), F.count("neuropil").alias("known"))


@query("SELECT CAST(doc_id AS VARCHAR) AS request_id, sha256(text) AS input_hash, sha256(text) AS read_back, lang AS output FROM documents WHERE text IS NOT NULL")
def record_round_trip(spark, d):
    """Documents as records of a log, written in two parts and read back."""
    docs = table(spark, d, "documents").where(F.col("text").isNotNull())
    rows = docs.select(F.col("doc_id").cast("string").alias("request_id"), F.sha2(F.col("text").cast("binary"), 256).alias("input_hash"), F.col("text").alias("input"), F.col("lang").alias("output"), F.col("source").alias("created"))
    path = place(spark, "records")
    tables.append_records(rows.where("request_id % 2 = 0"), path)
    tables.append_records(rows.where("request_id % 2 <> 0"), path)
    return tables.record_log(spark, path).select("request_id", "input_hash", F.sha2(F.col("input").cast("binary"), 256).alias("read_back"), "output")


@query("SELECT CAST(doc_id AS VARCHAR) AS id, source, length(text) AS signs, sha256(text) AS digest FROM documents WHERE text IS NOT NULL")
def corpus_manifest(spark, d):
    docs = table(spark, d, "documents").where(F.col("text").isNotNull())
    path = place(spark, "manifest")
    docs.select(F.col("doc_id").cast("string").alias("id"), "source", "text", F.struct(F.lit("h").alias("holder"), F.col("lang").alias("terms"), F.lit("s").alias("source")).alias("license")).write.json(path)
    return tables.corpus(spark, path).select("id", "source", F.length("text").cast("long").alias("signs"), F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


@query("SELECT CAST(user_id AS VARCHAR) AS fly, event_type AS segment, CAST(event_id AS DOUBLE) / 8 AS t, value AS x_cm, -value / 2 AS y_cm FROM events")
def trajectory_points(spark, d):
    e = table(spark, d, "events")
    rows = e.select(F.lit("f").alias("fname"), F.col("user_id").alias("fly"), F.lit("c").alias("condition"), F.col("event_type").alias("segment"), (F.col("event_id") / 8).alias("t"), F.col("value").alias("x_cm"), (-F.col("value") / 2).alias("y_cm"))
    return tables.trajectory(spark, as_csv(rows, "trajectory")).select("fly", "segment", "t", "x_cm", "y_cm")


@query("SELECT 0 AS level, count(*) AS nodes FROM orders UNION ALL SELECT 1, count(*) FROM lineitem SEMI JOIN orders ON l_orderkey = o_orderkey UNION ALL SELECT 2, count(*) FROM lineitem SEMI JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'")
def hierarchy_levels(spark, d):
    """Each order as a hierarchy of its line items; returned ones have a child."""
    leaf = F.when(F.col("l_returnflag") == "R", F.array(F.struct(F.lit("returned").alias("name")))).otherwise(F.array().cast("array<struct<name: string>>"))
    items = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_linenumber").alias("name"), leaf.alias("children"))).alias("children"))  # the items of one order
    rows = table(spark, d, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return tables.hierarchy(rows.select(F.to_json(F.struct(F.col("o_orderkey").alias("name"), "children")).alias("tree")), "tree")


@query("SELECT c_custkey AS id, c_nationkey AS nation FROM customer WHERE c_mktsegment = 'BUILDING'")
def mapped_fields(spark, d):
    mapping = tables.FieldMapping({"id": "c_custkey", "segment": "c_mktsegment", "nation": "c_nationkey", "side": "c_side"}, {"id": "bigint", "segment": "string"}, frozenset({"side"}))
    return mapping.apply(table(spark, d, "customer")).where(basic.equals("segment", "BUILDING")).drop("segment")


@query("""WITH p AS (SELECT r_name, 'any "n_name" [' || string_agg('"' || n_name || '"', ', ' ORDER BY n_name) || ']' AS text FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1) SELECT r_name, text, sha256(text) AS digest FROM p""")
def predicate_digests(spark, d):
    """The canonical text and digest of a predicate on the nations of each region."""
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name").collect()  # the nations of the world
    found = [(r, *basic.canonical_predicate("any", "n_name", [x["n_name"] for x in rows if x["r_name"] == r])) for r in sorted({x["r_name"] for x in rows})]
    return spark.createDataFrame(found, "r_name string, text string, digest string")


@query("SELECT source, count(*) AS n FROM documents WHERE doc_id % 7 <> 0 GROUP BY 1")
def replay_guard(spark, d):
    """Rows of the test split never come out: here they are left out before the guard, which would refuse them."""
    docs = table(spark, d, "documents").withColumn("split", F.when(F.col("doc_id") % 7 == 0, "test").otherwise("train"))
    return sampling.replayable(docs.where("split <> 'test'")).groupBy("source").agg(F.count("*").alias("n"))


@query("""WITH o AS (SELECT l_orderkey, list(l_quantity ORDER BY l_linenumber, l_partkey, l_quantity) AS x FROM lineitem GROUP BY 1), f AS (SELECT l_orderkey, x, unnest(range(0, (len(x) - 3) // 2 + 1)) AS k FROM o WHERE len(x) >= 3)
SELECT l_orderkey, k AS frame, round(list_sum(x[k * 2 + 1 : k * 2 + 3]), 6) AS total FROM f""")
def overlapping_frames(spark, d):
    """Quantities of an order in frames of three, every two."""
    x = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity")))
    orders = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(x, lambda r: r["l_quantity"]).alias("x"))
    each = orders.select("l_orderkey", F.posexplode(arrays.frames(F.col("x"), 3, 2)).alias("frame", "f"))
    return each.select("l_orderkey", F.col("frame").cast("long").alias("frame"), six(F.aggregate("f", F.lit(0.0), lambda a, b: a + b)).alias("total"))


@query("""WITH g AS (SELECT user_id, row_number() OVER (ORDER BY ('0x' || substr(md5('9:' || user_id), 1, 15))::BIGINT, user_id) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT user_id FROM events)) SELECT CASE WHEN k < greatest(1, least(n - 1, floor(0.2 * n + 0.5))) THEN 'validation' ELSE 'train' END AS split, count(*) AS n, count(DISTINCT user_id) AS trials FROM events JOIN g USING (user_id) GROUP BY 1""")
def split_by_trial(spark, d):
    out = sampling.split_by(table(spark, d, "events").select("user_id", "event_id"), "user_id", 0.2, 9)
    return out.groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("trials"))


@query("WITH i AS (SELECT p_brand AS item, count(*) * max(p_size) AS bytes FROM part GROUP BY 1) SELECT item, CAST(bytes AS BIGINT) AS bytes, CAST(sum(bytes) OVER () AS BIGINT) AS total, sum(bytes) OVER () <= 100000 AS fits FROM i")
def memory_items(spark, d):
    items = table(spark, d, "part").groupBy(F.col("p_brand").alias("item")).agg(F.count("*").alias("count"), F.max("p_size").alias("bytes_each"))
    out = reports.memory_estimate(items, 100_000)
    return out.select("item", F.col("bytes").cast("long").alias("bytes"), F.col("total").cast("long").alias("total"), "fits")
