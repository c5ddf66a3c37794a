"""Building the graph of the story bundle by bundle: chunks, nodes, edges, evidence, names, summaries and markers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.functions import rules
from storyloom.functions import text as X
from storyloom.functions.schema import FACTS, LABELS, PATTERNS
from storyloom.operators.graph import rewire
from storyloom.operators.joins import link_evidence
from storyloom.operators.resolution import KEY, canonical, touched
from storyloom.sources.tables import exists, kept, swept

#: Tables of a graph and their columns; all are partitioned by bundle and tenant.
TABLES = {
    "chunks": "tenant string, chapter int, idx int, chunk_id string, text string, next string",
    "nodes": "tenant string, node_id string, label string, name string, description string, aliases string, chapter int, story_order double, at_chapter int",
    "edges": "tenant string, src string, type string, dst string",
    "evidence": "tenant string, fact_id string, chunk_id string",
    "names": "tenant string, label string, k string, node_id string, canonical string",
    "summaries": "tenant string, chapter int, summary string",
    "pruned": "tenant string, chapter int, reason string, n long",
    "markers": "tenant string, chapter int",
}


def parsed(extractions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and what was pruned of extractions (tenant, chapter, raw), raw being JSON of nodes and relationships.

    A node's id is a digest of tenant, chapter and its own id there. Unknown labels go, properties that a label doesn't
    have, nodes without a property, edges whose ends are not there and those of no allowed pattern; each is counted.
    """
    read = extractions.select("tenant", "chapter", F.from_json("raw", rules.GRAPH).alias("j"))
    own = lambda c: F.sha2(F.concat_ws("#", "tenant", "chapter", c), 256)
    made = read.select("tenant", "chapter", F.explode("j.nodes").alias("n")).where("n.id IS NOT NULL")
    allowed = F.create_map(*[x for label, names in LABELS.items() for x in (F.lit(label), F.array(*map(F.lit, names)))])
    made = made.select("tenant", "chapter", own("n.id").alias("node_id"), F.col("n.label").alias("label"), F.coalesce("n.properties", F.create_map().cast("map<string,string>")).alias("all"), F.coalesce(allowed[F.col("n.label")], F.array().cast("array<string>")).alias("may"))
    made = made.withColumn("p", F.map_filter("all", lambda k, v: F.array_contains(F.col("may"), k) & v.isNotNull())).dropDuplicates(["tenant", "node_id"])
    known = F.col("label").isin(list(LABELS))
    made = kept(made.withColumn("reason", F.when(~F.coalesce(known, F.lit(False)), "label").when(F.size("p") == 0, "no_property")), "made")
    nodes = made.where("reason IS NULL").select(
        "tenant", "node_id", "label", *[F.col("p")[c].alias(c) for c in ("name", "description", "aliases")], F.col("p")["chapter"].try_cast("int").alias("chapter"), F.col("p")["story_order"].try_cast("double").alias("story_order"), F.col("chapter").alias("at_chapter"), F.col("p")["evidence_chunk"].alias("evidence_chunk")
    )
    rel = read.select("tenant", "chapter", F.explode("j.relationships").alias("r")).select("tenant", "chapter", own("r.start_node_id").alias("src"), F.col("r.type").alias("type"), own("r.end_node_id").alias("dst"))
    label = lambda end, c: nodes.select("tenant", F.col("node_id").alias(end), F.col("label").alias(c))
    rel = rel.join(label("src", "a"), ["tenant", "src"], "left").join(label("dst", "b"), ["tenant", "dst"], "left")
    patterns = extractions.sparkSession.createDataFrame(PATTERNS, "a string, type string, b string").withColumn("fits", F.lit(True))
    rel = rel.join(F.broadcast(patterns), ["a", "type", "b"], "left").withColumn("reason", F.when(F.col("a").isNull() | F.col("b").isNull(), "dangling").when(F.col("fits").isNull(), "pattern"))
    rel = kept(rel, "relationships")
    edges = rel.where("reason IS NULL").select("tenant", "src", "type", "dst").distinct()
    counts = made.where("reason IS NOT NULL").select("tenant", "chapter", "reason").union(rel.where("reason IS NOT NULL").select("tenant", "chapter", "reason")).groupBy("tenant", "chapter", "reason").agg(F.count("*").alias("n"))
    lost = made.where("reason IS NULL").groupBy("tenant", "chapter").agg(F.sum(F.size("all") - F.size("p")).alias("n")).where("n > 0").select("tenant", "chapter", F.lit("property").alias("reason"), "n")
    broken = read.where("j IS NULL OR j.nodes IS NULL").groupBy("tenant", "chapter").agg(F.count("*").alias("n")).select("tenant", "chapter", F.lit("no_json").alias("reason"), "n")
    return nodes, edges, counts.unionByName(lost).unionByName(broken)


class Graph:
    """The tables of a graph under a path.

    A bundle of chapters is written under the next number, its markers last. A bundle that failed before has no marker:
    readers don't see it, its number is taken again and its files are replaced. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def last(self) -> int:
        """The number of the last whole bundle, 0 before the first."""
        if not exists(self.spark, f"{self.path}/markers"):
            return 0
        marks = self.spark.read.schema(f"{TABLES['markers']}, bundle int").parquet(f"{self.path}/markers")
        return marks.agg(F.max("bundle")).first()[0] or 0

    def read(self, name: str) -> DataFrame:
        """All rows of the whole bundles, with the number of each."""
        schema = T.StructType.fromDDL(f"{TABLES[name]}, bundle int")
        if not exists(self.spark, f"{self.path}/{name}"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}").where(F.col("bundle") <= self.last())

    def _write(self, df: DataFrame, name: str, bundle: int) -> DataFrame:
        path = f"{self.path}/{name}/bundle={bundle}"
        columns = T.StructType.fromDDL(TABLES[name])
        rows = df.select(*[F.col(c.name).cast(c.dataType) for c in columns])
        with swept(self.spark):
            rows.hint("rebalance", "tenant").write.mode("overwrite").partitionBy("tenant").parquet(path)
        return self.spark.read.schema(columns).parquet(path)

    def add(self, chapters: DataFrame, extractions: DataFrame, summaries: DataFrame | None = None, size: int = 100, similar=None) -> int:
        """Adds the chapters (tenant, chapter, text) that have no marker yet, with what was extracted from them (tenant, chapter, raw) and their summaries; returns the bundle's number.

        Chunks, nodes and edges of known chapters are neither read nor written. Of the names, only those of the bundle's
        tenants are read, and only rows of sets that a new name touches are written again.
        """
        bundle = self.last() + 1
        scope = ["tenant", "chapter"]
        new = kept(chapters.where("tenant IS NOT NULL").dropDuplicates(scope).join(self.read("markers"), scope, "left_anti"), "chapters")
        spans = new.select("tenant", "chapter", "text", F.posexplode(X.chunk_spans(F.col("text"), F.lit(size))).alias("idx", "s"))
        chunks = spans.select("tenant", "chapter", "idx", F.concat_ws("-", "tenant", "chapter", "idx").alias("chunk_id"), F.substring("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("text"))
        chunks = self._write(chunks.withColumn("next", F.lead("chunk_id").over(Window.partitionBy("tenant", "chapter").orderBy("idx"))), "chunks", bundle)
        nodes, edges, pruned = parsed(extractions.join(new.select(*scope), scope, "left_semi"))
        facts = nodes.where(F.col("label").isin(FACTS)).select("tenant", F.col("node_id").alias("fact_id"), F.col("at_chapter").alias("chapter"), F.col("evidence_chunk").alias("evidence"))
        bridge = link_evidence(facts, chunks, scope).join(facts.select("tenant", "fact_id"), "fact_id")
        nodes = self._write(nodes, "nodes", bundle)
        self._write(edges, "edges", bundle)
        self._write(bridge, "evidence", bundle)
        known = self.names()
        self._write(touched(nodes, known) if similar is None else touched(nodes, known, similar), "names", bundle)
        self._write(pruned, "pruned", bundle)
        if summaries is not None:
            self._write(summaries.join(new.select(*scope), scope, "left_semi"), "summaries", bundle)
        self._write(new.select(*scope), "markers", bundle)
        return bundle

    def names(self) -> DataFrame:
        """The last row of each name. A row is written again only when its set changes, so the newest one holds."""
        latest = self.read("names").groupBy(*KEY).agg(F.max(F.struct("bundle", "node_id", "canonical")).alias("r"))
        return latest.select(*KEY, "r.node_id", "r.canonical")

    def canonical(self) -> DataFrame:
        """Every node with its canonical id."""
        return canonical(self.read("nodes"), self.names())

    def entities(self) -> DataFrame:
        """One row for each thing: descriptions and aliases of all its nodes, sorted, the rest of the one with the smallest id."""
        first = lambda c: F.min_by(c, "node_id").alias(c)
        g = self.canonical().groupBy("tenant", "label", F.col("canonical").alias("node_id"))
        return g.agg(F.count("*").alias("n"), F.min_by("name", "node_id").alias("name"), F.array_sort(F.collect_set("description")).alias("description"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(X.alias_flatten(F.array("aliases")))))).alias("aliases"), first("chapter"), first("story_order"))

    def edges(self) -> DataFrame:
        """Edges between things, without loops and repetitions."""
        c = self.canonical().select("node_id", F.col("canonical").alias("component"))
        return rewire(self.read("edges").select("tenant", "src", "type", "dst"), c)

    def facts(self) -> DataFrame:
        """(tenant, fact_id, label, name, text, est_chapter, story_order): what search reads. A fact's chapter is its own, else that of the event that establishes it, else of its first chunk."""
        f = self.read("nodes").where(F.col("label").isin(FACTS))
        event = f.where("label = 'Event'").select(F.col("node_id").alias("dst"), F.col("chapter").alias("event_chapter"), F.col("story_order").alias("event_order"))
        by_event = self.read("edges").where("type = 'ESTABLISHED_IN'").join(event, "dst").groupBy(F.col("src").alias("node_id")).agg(F.min("event_chapter").alias("event_chapter"), F.min_by("event_order", "event_chapter").alias("event_order"))
        by_chunk = self.read("evidence").join(self.read("chunks").select("chunk_id", F.col("chapter").alias("chunk_chapter")), "chunk_id").groupBy(F.col("fact_id").alias("node_id")).agg(F.min("chunk_chapter").alias("chunk_chapter"))
        f = f.join(by_event, "node_id", "left").join(by_chunk, "node_id", "left")
        return f.select("tenant", F.col("node_id").alias("fact_id"), "label", "name", rules.fact_text(F.col("name"), F.col("description")).alias("text"), F.coalesce("chapter", "event_chapter", "chunk_chapter").alias("est_chapter"), F.coalesce("story_order", "event_order").alias("story_order"))

    def stories(self) -> DataFrame:
        """The last chapter's summary of each tenant, and how many chapters it has."""
        return self.read("summaries").groupBy("tenant").agg(F.max("chapter").alias("chapter"), F.max_by("summary", "chapter").alias("summary"), F.count("*").alias("n"))
