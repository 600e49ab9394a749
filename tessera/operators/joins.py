"""Join shapes that have no operator of their own elsewhere."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..plans import views as V
from ..registry import query
from ..session import table


@query("jn14_asof_prior_user_turn", "WITH c AS (SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS user_turn FROM conversations) SELECT conv_id, turn, user_turn FROM c WHERE role = 'assistant'")
def jn14(spark, d):
    """JN14: the user's turn that each answer follows."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(w)
    return table(spark, d, "conversations").withColumn("user_turn", last).filter("role = 'assistant'").select("conv_id", "turn", "user_turn")


@query("jn01_three_way", "SELECT f.category, p.term, count(*) AS chunks, CAST(sum(p.tf) AS BIGINT) AS tf FROM postings p JOIN chunks c ON c.id = p.id JOIN files f ON f.id = c.file_id WHERE NOT f.deleted AND p.term IN ('the', 'la', 'und') GROUP BY ALL", "files chunks postings")
def jn01(spark, d):
    """JN01: index, chunks and live files."""
    f = V.files(spark, d).filter("not deleted").select(F.col("id").alias("file_id"), "category")
    p = V.postings(spark, d).filter(F.col("term").isin("the", "la", "und")).select("id", "term", "tf")
    return p.join(V.chunks(spark, d).select("id", "file_id"), "id").join(f, "file_id").groupBy("category", "term").agg(F.count("*").alias("chunks"), F.sum("tf").alias("tf"))


@query("jn05_edge_endpoints", "SELECT e.source, a.type AS source_type, e.target, b.type AS target_type, e.weight FROM edges e JOIN entities a ON a.name = e.source JOIN entities b ON b.name = e.target WHERE e.weight >= 4", "chunks postings entities mentions edges")
def jn05(spark, d):
    """JN05: both endpoints of an edge."""
    n = V.entities(spark, d)
    a = n.select(F.col("name").alias("source"), F.col("type").alias("source_type"))
    b = n.select(F.col("name").alias("target"), F.col("type").alias("target_type"))
    return V.edges(spark, d).filter("weight >= 4").join(a, "source").join(b, "target").select("source", "source_type", "target", "target_type", "weight")


@query("jn09_same_chunk", "SELECT DISTINCT a.name AS material, b.name AS standard FROM mentions a JOIN mentions b ON a.chunk_id = b.chunk_id WHERE a.type = 'material' AND b.type = 'standard'", "chunks postings entities mentions")
def jn09(spark, d):
    """JN09: materials and standards of one chunk."""
    m = V.mentions(spark, d)
    a = m.filter("type = 'material'").select("chunk_id", F.col("name").alias("material"))
    b = m.filter("type = 'standard'").select("chunk_id", F.col("name").alias("standard"))
    return a.join(b, "chunk_id").select("material", "standard").distinct()


@query("jn19_pages_by_name", "SELECT e.name, count(*) AS docs FROM entities e JOIN (SELECT DISTINCT file_id, term FROM postings) p ON p.term = e.name GROUP BY e.name", "chunks postings entities")
def jn19(spark, d):
    """JN19: pages linked to entities by exact name."""
    p = V.postings(spark, d).select("file_id", F.col("term").alias("name")).distinct()
    return p.join(V.entities(spark, d), "name").groupBy("name").agg(F.count("*").alias("docs"))


@query("x_pricing_summary", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def pricing(spark, d):
    """Generic aggregation over the relational tables; the filter and columns reach the scan."""
    li = table(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.count("*").alias("n"))
