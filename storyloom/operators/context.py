"""What a reader of the story so far is given: the graph as lines of text, summaries, and the sources of claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Headings and words of the rendered graph, of the bundle and of the document of sources.
PEOPLE, EVENTS, THINGS = "## 인물", "## 사건", "## 사물·장소·조직"
STATE, ORPHAN, RELATION = "  · 상태: ", "- (CharacterState, 소유자 미상) ", "  · 관계: "
CHAPTER, SINCE, ABOUT, PLACE, ACTORS, ABOVE = "화", "화 성립", "대상: ", "장소: ", "참여: ", "상위: "
STORY, RECENT, GRAPH = "# 지금까지의 전체 줄거리(압축)\n", "# 최근 회차 요약\n", "# 지금까지의 그래프\n"
CHUNKS, FACTS, ENTITIES, REFS = "[문서고 · 원문 청크]", "[문서고 · 사실]", "[문서고 · 개체]", "[claim별 참조]"
WHO, LINKED, PROOF, OTHER_NAMES, RELATED, LINES = "     참가자: ", "     연관: ", "     근거: ", "별칭: ", "     관련인물: ", "줄 "
SHOWN = ["HAS_STATE", "ESTABLISHED_IN", "ABOUT", "APPEARS_IN", "HOSTS", "LOCATED_IN", "PART_OF"]


def joined(c: Column, by: str = ", ") -> Column:
    return F.array_join(F.array_sort(F.collect_list(c)), by)


def in_brackets(*parts: Column) -> Column:
    """' (a, b)' of the parts that are there; nothing without any."""
    body = F.concat_ws(", ", *parts)
    return F.when(body != "", F.concat(F.lit(" ("), body, F.lit(")"))).otherwise("")


def graph_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(tenant, section, place, line) of nodes (tenant, node_id, label, name, chapter, story_order, extras) and edges (tenant, src, type, dst).

    Characters with their states below them in the order of chapters, and states that nobody has; events with place and
    people in story order; items, places and organisations with what they are part of. A state's chapter is that of
    the event that establishes it, or its own column where there is none. Edges of other kinds stand below their source.
    Every edge is joined with its ends once; each list holds the neighbours of one node.
    """
    end = lambda e, *more: nodes.select("tenant", F.col("node_id").alias(e), F.col("name").alias(f"{e}_name"), F.col("label").alias(f"{e}_label"), *more)
    e = edges.join(end("src"), ["tenant", "src"]).join(end("dst", F.col("chapter").alias("dst_chapter")), ["tenant", "dst"])
    of = lambda kinds, by, c, out: e.where(F.col("type").isin(kinds)).groupBy("tenant", F.col(by).alias("node_id")).agg(joined(F.col(c)).alias(out))
    since = e.where("type = 'ESTABLISHED_IN' AND dst_label = 'Event'").groupBy("tenant", F.col("src").alias("node_id")).agg(F.min("dst_chapter").alias("since"))
    key = ["tenant", "node_id"]
    relation = F.concat(F.lit(RELATION), "type", F.lit(" → "), "dst_label", F.lit(":"), "dst_name")
    others = e.where(~F.col("type").isin(SHOWN)).groupBy("tenant", F.col("src").alias("node_id")).agg(F.concat(F.lit("\n"), joined(relation, "\n")).alias("others"))
    extra = F.when(F.col("extras") != "", F.concat(F.lit(" — "), "extras")).otherwise("")
    tail = F.coalesce("others", F.lit(""))

    states = nodes.where("label = 'CharacterState'").join(since, key, "left").join(of(["ABOUT"], "src", "dst_name", "about"), key, "left").withColumn("at", F.coalesce("since", "chapter"))
    states = states.withColumn("said", F.concat("name", in_brackets(F.concat(F.col("at").cast("string"), F.lit(SINCE)), F.concat(F.lit(ABOUT), "about"))))
    has = e.where("type = 'HAS_STATE'").select("tenant", F.col("src").alias("owner"), F.col("dst").alias("node_id"))
    owned = has.join(states.select(*key, "at", "name", "said"), key).groupBy("tenant", F.col("owner").alias("node_id"))
    nested = F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("at", F.lit(0)).alias("at"), "name", "said"))), lambda x: F.concat(F.lit("\n" + STATE), x["said"]))
    owned = owned.agg(F.array_join(nested, "").alias("states"))
    people = nodes.where("label = 'Character'").join(owned, key, "left").join(others, key, "left")
    place = lambda rank, a, b, name: F.struct(F.lit(rank).alias("rank"), F.coalesce(a, F.lit(0.0)).cast("double").alias("a"), F.coalesce(b, F.lit(0.0)).cast("double").alias("b"), name.alias("name"), F.col("node_id").cast("string").alias("id"))
    none = F.lit(None).cast("double")
    lines = people.select("tenant", F.lit(1).alias("section"), place(1, none, none, F.col("name")).alias("place"), F.concat(F.lit("- (Character) "), "name", extra, F.coalesce("states", F.lit("")), tail).alias("line"))
    orphans = states.join(has, key, "left_anti").join(nodes.where("label = 'Character'").select("tenant").distinct(), "tenant", "left_semi")
    lines = lines.unionByName(orphans.select("tenant", F.lit(1).alias("section"), place(2, none, none, F.col("name")).alias("place"), F.concat(F.lit(ORPHAN), "said").alias("line")))
    events = nodes.where("label = 'Event'").join(of(["HOSTS"], "dst", "src_name", "hosts"), key, "left").join(of(["APPEARS_IN"], "dst", "src_name", "actors"), key, "left").join(others, key, "left")
    when = F.concat(F.col("chapter").cast("string"), F.lit(CHAPTER), F.coalesce(F.concat(F.lit(" #"), F.col("story_order").cast("string")), F.lit("")))
    lines = lines.unionByName(events.select("tenant", F.lit(2).alias("section"), place(1, F.col("chapter"), F.col("story_order"), F.col("name")).alias("place"), F.concat(F.lit("- (Event) "), "name", in_brackets(when, F.concat(F.lit(PLACE), "hosts"), F.concat(F.lit(ACTORS), "actors")), tail).alias("line")))
    things = nodes.where(F.col("label").isin("Item", "Location", "Organization")).join(of(["LOCATED_IN", "PART_OF"], "src", "dst_name", "above"), key, "left").join(others, key, "left")
    lines = lines.unionByName(things.select("tenant", F.lit(3).alias("section"), place(1, none, none, F.concat_ws("\x01", "label", "name")).alias("place"), F.concat(F.lit("- ("), "label", F.lit(") "), "name", in_brackets(F.concat(F.lit(ABOVE), "above")), extra, tail).alias("line")))
    heads = lines.select("tenant", "section").distinct().select("tenant", "section", F.struct(F.lit(0).alias("rank"), F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), F.lit("").alias("name"), F.lit("").alias("id")).alias("place"), F.element_at(F.array(F.lit(PEOPLE), F.lit(EVENTS), F.lit(THINGS)), F.col("section")).alias("line"))
    return lines.unionByName(heads)


def text_of(lines: DataFrame, key: str) -> DataFrame:
    """(key, text): the lines of each key in their order, as one text."""
    g = lines.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("section", "place", "line"))).alias("l"))
    return g.select(key, F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))


def graph_text(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(tenant, text): graph_lines as one text for each tenant."""
    return text_of(graph_lines(nodes, edges), "tenant")


def story_context(stories: DataFrame, summaries: DataFrame, graph: DataFrame, recent: int = 3) -> DataFrame:
    """(tenant, context): the story so far (tenant, summary), the last chapters' summaries (tenant, chapter, summary) in their order, and the graph (tenant, text); what is empty is left out."""
    from storyloom.operators.search import top_k

    last = top_k(summaries.where("summary IS NOT NULL"), "tenant", [F.desc("chapter")], recent)
    said = F.struct("chapter", F.concat(F.lit("["), F.col("chapter").cast("string"), F.lit(CHAPTER + "] "), "summary").alias("line"))
    last = last.groupBy("tenant").agg(F.array_join(F.transform(F.array_sort(F.collect_list(said)), lambda x: x["line"]), "\n").alias("recent"))
    all_ = stories.select("tenant", F.col("summary").alias("story")).join(last, "tenant", "full").join(graph.select("tenant", "text"), "tenant", "full")
    part = lambda head, c: F.when(F.col(c) != "", F.concat(F.lit(head), c))
    return all_.select("tenant", F.concat_ws("\n\n", part(STORY, "story"), part(RECENT, "recent"), part(GRAPH, "text")).alias("context"))


def source_lines(chunks: DataFrame, facts: DataFrame, entities: DataFrame) -> DataFrame:
    """(job, section, place, line): the sources of a job's claims.

    chunks (job, alias, chapter, idx, text); facts (job, alias, label, chapter, story_order, name, description,
    participants, related, evidence), the last three arrays of text, evidence of chunk aliases; entities (job, alias, label,
    name, aliases, description, related, parents). The section of entities is there only if a job has any.
    """
    row = lambda df, section, line: df.select("job", F.lit(section).alias("section"), F.struct(F.lit(1).alias("rank"), F.col("alias").alias("name")).alias("place"), line.alias("line"))
    listed = lambda head, c, by=", ": F.when(F.size(c) > 0, F.concat(F.lit("\n" + head), F.array_join(c, by))).otherwise("")
    detail = F.when(F.col("description") != "", F.concat(F.lit(" — "), "description")).otherwise("")
    lines = row(chunks, 1, F.concat("alias", F.lit(" ("), F.col("chapter").cast("string"), F.lit(CHAPTER + "#"), F.col("idx").cast("string"), F.lit(") "), F.coalesce("text", F.lit(""))))
    order = F.coalesce(F.concat(F.lit(" · 순서 "), F.col("story_order").cast("string")), F.lit(""))
    head = F.concat("alias", F.lit(" ("), "label", F.lit(" · "), F.coalesce(F.col("chapter").cast("string"), F.lit("-")), F.lit(CHAPTER), order, F.lit(") "), F.coalesce("name", F.lit("")))
    lines = lines.unionByName(row(facts, 2, F.concat(head, detail, listed(WHO, "participants"), listed(LINKED, "related"), listed(PROOF, F.array_sort("evidence"), " "))))
    names = F.when(F.size("aliases") > 0, F.concat(F.lit(" [" + OTHER_NAMES), F.array_join("aliases", ", "), F.lit("]"))).otherwise("")
    lines = lines.unionByName(row(entities, 3, F.concat("alias", F.lit(" ("), "label", F.lit(") "), "name", names, detail, listed(RELATED, "related"), listed("     " + ABOVE, "parents"))))
    jobs = lines.select("job").distinct()
    top = lambda df, section, text: df.select("job", F.lit(section).alias("section"), F.struct(F.lit(0).alias("rank"), F.lit("").alias("name")).alias("place"), F.lit(text).alias("line"))
    return lines.unionByName(top(jobs, 1, CHUNKS)).unionByName(top(jobs, 2, "\n" + FACTS)).unionByName(top(entities.select("job").distinct(), 3, "\n" + ENTITIES))


def source_document(chunks: DataFrame, facts: DataFrame, entities: DataFrame) -> DataFrame:
    """(job, text): source_lines as one text for each job."""
    return text_of(source_lines(chunks, facts, entities), "job")


def reference_lines(claims: DataFrame, refs: DataFrame) -> DataFrame:
    """(job, section, place, line): for each claim the aliases to look at.

    claims (job, n, claim_id, quote, described, lines); refs (job, n, kind, alias) with kind C, F or E. Entities have a
    column only in jobs that have any; '-' stands for none.
    """
    jobs = refs.where("kind = 'E'").select("job").distinct().withColumn("with_entities", F.lit(True))
    kinds = refs.distinct().groupBy("job", "n").agg(*[F.array_join(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("alias")))), " ").alias(k) for k in "CFE"])
    shown = lambda k: F.when(F.col(k) != "", F.col(k)).otherwise("-")
    all_ = claims.join(kinds, ["job", "n"], "left").join(jobs, "job", "left")
    lines = F.when(F.size("lines") > 0, F.concat(F.lit(" [" + LINES), F.array_join(F.col("lines").cast("array<string>"), ", "), F.lit("]"))).otherwise("")
    end = F.when(F.col("with_entities"), F.concat(F.lit(" | "), shown("E"))).otherwise("")
    line = F.concat(F.coalesce("claim_id", F.concat(F.lit("#"), F.col("n").cast("string"))), F.lit(' "'), F.coalesce("quote", F.lit("")), F.lit('" ('), F.coalesce("described", F.lit("")), F.lit(")"), lines, F.lit("  → "), shown("C"), F.lit(" | "), shown("F"), end)
    rows = all_.select("job", F.lit(4).alias("section"), F.struct(F.col("n").cast("long").alias("n"), F.lit("").alias("name")).alias("place"), line.alias("line"))
    return rows.unionByName(claims.select("job").distinct().select("job", F.lit(4).alias("section"), F.struct(F.lit(-1).cast("long").alias("n"), F.lit("").alias("name")).alias("place"), F.lit(REFS).alias("line")))
