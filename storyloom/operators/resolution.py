"""Which nodes are one thing: rules by label, over whole tables or only where new nodes touch what is known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions.ratios import WINDOWS, alike
from storyloom.functions.schema import ALIKE, EXACT, FUZZY
from storyloom.functions.text import name_key
from storyloom.operators.search import merge_components
from storyloom.sources.tables import kept

KEY = ["tenant", "label", "k"]


def keyed(nodes: DataFrame) -> DataFrame:
    """nodes (tenant, node_id, label, name) with k: the name where likeness decides, its key where spelling does, else null: such a node is merged with none."""
    name = F.trim("name")
    return nodes.withColumn("k", F.when(F.col("label").isin(FUZZY) & (name != ""), name).when(F.col("label").isin(EXACT), name_key(F.col("name"))))


def pairs_of(c: Column) -> Column:
    """The two-letter parts of a text; a text of one letter is its own."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(2)))


def marks(names: DataFrame) -> DataFrame:
    """names with a row for each mark: two-letter parts without spaces, and words of one letter. Names that are alike share one, unless all words of one are single letters."""
    single = F.transform(F.filter(F.split("k", r"\s+"), lambda w: F.length(w) == 1), lambda w: F.concat(F.lit(" "), w))
    return names.select("*", F.explode(F.array_distinct(F.concat(pairs_of(F.regexp_replace("k", r"\s+", "")), single))).alias("mark"))


def sorted_words(distinct: bool) -> Column:
    words = F.array_sort(F.split(F.trim("k"), r"\s+"))
    return F.array_join(F.array_distinct(words) if distinct else words, " ")


def alike_pairs(new: DataFrame, all_: DataFrame, threshold: float = ALIKE) -> DataFrame:
    """(tenant, label, x, y): names x of new and other names y of all_ of the same tenant and label that are alike.

    Names meet where they share a mark. Where both are one word, the shorter looks by its rarest marks alone: of n letters, d are
    not common and at most as many of the other name's stand between the rest, which spoils at most 3 d of its marks, or 2 d
    for a window, so one more than can be spoilt find every name. A name all of whose words are single letters
    also meets every name that has its letter, or two-letter parts of its sorted words. Likeness is computed for whole batches of pairs,
    each pair once, whichever of the two is new; x is the smaller. Names and pairs are few bytes but much work, so they are dealt over
    as many tasks as a shuffle has, which Spark would join by their size.
    """
    tasks = int(new.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left, right = new.select(*KEY).distinct(), all_.select(*KEY).distinct()
    names = left.withColumn("fresh", F.lit(True)).union(right.withColumn("fresh", F.lit(False))).groupBy(*KEY).agg(F.max("fresh").alias("fresh"))
    names = names.withColumn("word", ~F.col("k").rlike(r"(?U)[\s\x1c-\x1f]")).withColumn("size", F.length("k"))
    on = ["tenant", "label", "mark"]
    marked = kept(marks(names), "marks")
    seen = marked.groupBy(*on).agg(F.count("*").alias("seen"))
    spoilt = F.floor(F.col("size") * max(3 * (1 - threshold), 4 * (1 - threshold / WINDOWS)) + 1e-9)
    rare = marked.join(seen, on).withColumn("rank", F.row_number().over(Window.partitionBy(*KEY).orderBy("seen", "mark")))
    rare = rare.where(~F.col("word") | (F.col("rank") <= spoilt + 1)).select(*on, *[F.col(c).alias(f"own_{c}") for c in ("k", "fresh", "word", "size")])
    met = rare.repartition(tasks, *on).join(marked.repartition(tasks, *on), on).where("(fresh OR own_fresh) AND (NOT own_word OR word AND own_size <= size)")
    met = met.select("tenant", "label", F.col("own_k").alias("x"), F.col("k").alias("y"))
    parts = lambda c: F.array_union(pairs_of(c), F.split(c, ""))
    loose = ~F.exists(F.split(F.trim("k"), r"\s+"), lambda w: F.length(w) > 1)
    for one, two, a, b in ((left, right, "x", "y"), (right, left, "y", "x")):
        of = lambda own: F.explode(F.array_distinct(F.concat(own(sorted_words(True)), own(sorted_words(False))))).alias("mark")
        few = one.where(loose).select("tenant", "label", F.col("k").alias(a), of(pairs_of))
        met = met.unionByName(few.join(two.select("tenant", "label", F.col("k").alias(b), of(parts)), ["tenant", "label", "mark"]).select("tenant", "label", "x", "y"))
    once = met.where("x <> y").select("tenant", "label", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    return once.repartition(tasks, "x", "y").where(alike("x", "y", F.lit(threshold)))


def edit_pairs(new: DataFrame, all_: DataFrame, similarity, threshold: float) -> DataFrame:
    """As alike_pairs for another likeness of two columns of names, over whole tables; new is not told apart."""
    from storyloom.operators.search import fuzzy_pairs

    names = all_.select("tenant", "label", F.col("k").alias("name"), F.xxhash64(*KEY).alias("node_id"))
    known = names.select("node_id", F.col("name").alias("k"), "tenant", "label")
    p = fuzzy_pairs(names, similarity, threshold, ["tenant", "label"])
    p = p.join(known.select(F.col("node_id").alias("a"), F.col("k").alias("x"), "tenant", "label"), "a")
    return p.join(known.select(F.col("node_id").alias("b"), F.col("k").alias("y")), "b").select("tenant", "label", "x", "y")


def touched(nodes: DataFrame, known: DataFrame, pairs=alike_pairs) -> DataFrame:
    """Rows (tenant, label, k, node_id, canonical) of known that nodes change, and those that they add.

    known has a row for each name: the smallest node_id with that name, and the smallest of all that it is one with. New names
    are compared with each other and with the known ones, known ones never again among themselves; links go between
    new names and the canonical ids of the sets that they touch, so the sets' other members take no part. A set that no
    new node touches has no row here. One call over all nodes and an empty table gives the same as any sequence of calls.
    """
    fresh = kept(keyed(nodes).where("k IS NOT NULL").groupBy(*KEY).agg(F.min("node_id").alias("new_id")), "names")
    known = kept(known.join(fresh.select("tenant").distinct(), "tenant", "left_semi").select(*KEY, "node_id", "canonical"), "known")
    seen = fresh.join(known, KEY, "left")
    new = kept(seen.where("node_id IS NULL").select(*KEY, "new_id"), "fresh")
    lower = seen.where("new_id < node_id").select(*KEY, "new_id", "canonical")
    # A vertex is a set that is known, or a new name, under its smallest id.
    vertex = known.select(*KEY, F.col("canonical").alias("v")).unionByName(new.select(*KEY, F.col("new_id").alias("v")))
    fuzzy = F.col("label").isin(FUZZY)
    links = pairs(new.where(fuzzy), vertex.where(fuzzy))
    ends = links.join(vertex.withColumnRenamed("k", "x").withColumnRenamed("v", "a"), ["tenant", "label", "x"]).join(vertex.withColumnRenamed("k", "y").withColumnRenamed("v", "b"), ["tenant", "label", "y"])
    merged = kept(merge_components(ends.where("a <> b").select("a", "b").distinct()), "merged").withColumnRenamed("node_id", "v")
    moved = merged.select("v").union(lower.select("canonical")).distinct()
    old = known.join(moved, known["canonical"] == moved["v"], "left_semi").join(lower.select(*KEY, "new_id"), KEY, "left")
    members = old.select(*KEY, F.least("node_id", F.coalesce("new_id", "node_id")).alias("node_id"), F.col("canonical").alias("v")).unionByName(new.select(*KEY, F.col("new_id").alias("node_id"), F.col("new_id").alias("v")))
    members = kept(members.join(merged, "v", "left").withColumn("g", F.coalesce("component", "v")).select(*KEY, "node_id", "g"), "members")
    return members.join(members.groupBy("g").agg(F.min("node_id").alias("canonical")), "g").select(*KEY, "node_id", "canonical")


def canonical(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """nodes with the canonical id of each: its own where nothing is known of its name."""
    return keyed(nodes).join(names.select(*KEY, "canonical"), KEY, "left").withColumn("canonical", F.coalesce("canonical", "node_id")).drop("k")


def resolve(nodes: DataFrame, pairs=alike_pairs) -> DataFrame:
    """nodes (tenant, node_id, label, name, ...) with the canonical id of each, by the rules of their labels."""
    none = nodes.limit(0).select("tenant", "label", F.lit("").alias("k"), "node_id", F.col("node_id").alias("canonical"))
    return canonical(nodes, touched(nodes, none, pairs))
