"""Reading and writing graphs: JSON documents, Parquet, wiki dumps, and projections of relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.schema import COLUMNS, FACT, Graph, complete


def read_json(spark: SparkSession, path: str) -> Graph:
    """JSON documents of triples, alias_map, source_authority and n_articles, one a file; unknown keys are ignored.

    Triples without a triple_id are numbered as they stand in their document.
    """
    fields = ",".join(c.replace(" ", ":", 1) for c in ("triple_id long, " + FACT).split(", "))
    schema = f"n_articles int, alias_map map<string,string>, source_authority map<string,double>, triples array<struct<{fields}>>"
    doc = spark.read.schema(schema).option("multiLine", True).json(path)
    told = doc.select(F.posexplode("triples").alias("place", "t")).select(F.coalesce("t.triple_id", "place").alias("id"), "t.*").drop("triple_id")
    facts = complete(told.withColumnRenamed("id", "triple_id"))
    n = doc.agg(F.max("n_articles")).head()[0]
    return Graph(facts, doc.select(F.explode("alias_map").alias("surface", "canonical")), doc.select(F.explode("source_authority").alias("source", "score")), n or 0)


def write_json(g: Graph, path: str, core_only: bool = False) -> None:
    """Documents that `read_json` reads: each file holds some thousand facts, aliases or authorities.

    core_only: the first five fields of the facts alone, with their ids.
    """
    named = COLUMNS[:5] if core_only else COLUMNS
    pieces = lambda df, key: df.withColumn("_piece", F.pmod(F.xxhash64(*key), F.lit(max(1, df.count() // 20_000)))).groupBy("_piece")
    out = g.spark.range(1).select(F.lit(g.n_articles).alias("n_articles"))
    facts = g.facts.select("triple_id", *named)
    out = out.unionByName(pieces(facts, ["triple_id"]).agg(F.array_sort(F.collect_list(F.struct(*facts.columns))).alias("triples")).drop("_piece"), allowMissingColumns=True)
    if g.alias is not None:
        entries = F.map_from_entries(F.collect_list(F.struct("surface", "canonical")))
        out = out.unionByName(pieces(g.alias.dropDuplicates(["surface"]), ["surface"]).agg(entries.alias("alias_map")).drop("_piece"), allowMissingColumns=True)
    if g.authority is not None:
        entries = F.map_from_entries(F.collect_list(F.struct("source", "score")))
        out = out.unionByName(pieces(g.authority.dropDuplicates(["source"]), ["source"]).agg(entries.alias("source_authority")).drop("_piece"), allowMissingColumns=True)
    out.write.mode("overwrite").option("maxRecordsPerFile", 1).json(path)


def write_parquet(g: Graph, path: str) -> None:
    """Facts by relation, so that a scan of one reads one; aliases, authorities and the number of articles beside them."""
    g.facts.write.mode("overwrite").partitionBy("relation").parquet(f"{path}/facts")
    (g.alias if g.alias is not None else g.spark.createDataFrame([], "surface string, canonical string")).write.mode("overwrite").parquet(f"{path}/alias")
    (g.authority if g.authority is not None else g.spark.createDataFrame([], "source string, score double")).write.mode("overwrite").parquet(f"{path}/authority")
    g.spark.range(1).select(F.lit(g.n_articles).alias("n_articles")).write.mode("overwrite").parquet(f"{path}/about")


def read_parquet(spark: SparkSession, path: str) -> Graph:
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    return Graph(complete(read("facts")), read("alias"), read("authority"), read("about").head()[0])


def read_articles(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    """title, text of the pages of a wiki dump, but redirects and pages of special spaces."""
    pages = spark.read.format("xml").option("rowTag", "page").schema("title string, revision struct<text:string>").load(path)
    kept = pages.select("title", F.col("revision.text").alias("text")).where(~F.lower(F.trim("text")).startswith("#redirect") & ~F.substring_index("title", " ", 1).contains(":"))
    return kept.limit(n) if n else kept


def add(facts: DataFrame, more: DataFrame) -> DataFrame:
    """Both, the first of each (subject, relation, object, scope) by triple_id."""
    key = ["subject", "relation", "object", "scope"]
    both = facts.unionByName(more, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in key]
    return both.groupBy(*key).agg(F.min_by(F.struct(*rest), "triple_id").alias("f")).select(*key, "f.*").select(*both.columns)


def relational(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of the relational tables: where nations lie, customers and suppliers live, who placed orders."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    nation, region = read("nation"), read("region")
    fact = lambda df, s, r, o, block: df.select(
        (F.lit(block * 10**12) + F.col("k")).alias("triple_id"), s.alias("subject"), F.lit(r).alias("relation"), o.alias("object"), F.lit("tables").alias("source_article"), F.col("k").cast("int").alias("source_sentence_idx")
    )
    n = nation.join(region, nation.n_regionkey == region.r_regionkey).withColumn("k", F.col("n_nationkey").cast("long"))
    c = read("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).withColumn("k", F.col("c_custkey"))
    s = read("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).withColumn("k", F.col("s_suppkey"))
    o = read("orders").withColumn("k", F.col("o_orderkey"))
    name = lambda kind, key: F.concat(F.lit(f"{kind}#"), F.col(key).cast("string"))
    out = [
        fact(n, F.col("n_name"), "IN_REGION", F.col("r_name"), 1),
        fact(c, name("customer", "c_custkey"), "IN_NATION", F.col("n_name"), 2),
        fact(s, name("supplier", "s_suppkey"), "IN_NATION", F.col("n_name"), 3),
        fact(o, name("order", "o_orderkey"), "PLACED_BY", name("customer", "o_custkey"), 4),
    ]
    every = out[0]
    for x in out[1:]:
        every = every.unionByName(x)
    return complete(every)
