"""Graphs from records: utterances, items of knowledge, curated rows, results that are written back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.confidence import theme_confidence
from factloom.schema import Graph, complete
from factloom.sources.graphs import add

UTTERANCE = "text string, chapter int, chapter_title string, themes array<string>, addressee string, mood string, speech_act string"
ITEM = "item_id string, topic string, subtopic string, intent string, question_patterns array<string>, commands array<string>, explanation string, cautions array<string>, source string, related_items array<string>"
# Fixed marks of commands that destroy, the first that is found counts.
DESTRUCTIVE = ["--force", "--hard", "filter-branch", "reset --hard", "push --force", "rm -rf"]


def told(df: DataFrame, facts: list[Column]) -> DataFrame:
    """One row for each fact of a record that has an object; numbered by record and place."""
    every = df.select("place", F.posexplode(F.filter(F.flatten(F.array(*facts)), lambda f: f["object"].isNotNull())).alias("n", "f"))
    return every.select((F.col("place") * 10_000 + F.col("n")).alias("triple_id"), "f.*")


def fact(subject: Column, relation: str, obj: Column, confidence: Column | None = None) -> Column:
    return F.struct(subject.alias("subject"), F.lit(relation).alias("relation"), obj.alias("object"), (confidence if confidence is not None else F.lit(1.0)).cast("double").alias("confidence"))


def theme_frequencies(utterances: DataFrame) -> DataFrame:
    """theme, n."""
    return utterances.select(F.explode("themes").alias("theme")).groupBy("theme").agg(F.count("*").alias("n"))


def utterance_graph(utterances: DataFrame, source: str) -> Graph:
    """Utterances (with ``place``, their number from 0) as facts of u00, u01 ..: themes, addressee, speech act, mood.

    A theme is the surer the more utterances have it.
    """
    n = theme_frequencies(utterances)
    top = n.agg(F.max("n")).head()[0]
    sure = n.select("theme", theme_confidence(F.col("n"), F.lit(top or 1)).alias("c"))
    name = F.concat(F.lit("u"), F.lpad(F.col("place").cast("string"), 2, "0"))
    name = F.when(F.col("place") < 100, name).otherwise(F.concat(F.lit("u"), F.col("place").cast("string")))
    themes = utterances.select("place", name.alias("subject"), F.posexplode("themes").alias("n", "theme")).join(sure, "theme")
    themes = themes.select((F.col("place") * 10_000 + F.col("n")).alias("triple_id"), "subject", F.lit("HAS_THEME").alias("relation"), F.col("theme").alias("object"), F.col("c").alias("confidence"), F.col("place").cast("int").alias("source_sentence_idx"))
    rest = [F.array(fact(name, r, F.coalesce(F.col(c), F.lit(d)))) for r, c, d in (("ADDRESSED_TO", "addressee", "crew"), ("IS_SPEECH_ACT", "speech_act", "dialogue"), ("HAS_MOOD", "mood", "oratorical"))]
    rest = told(utterances, rest).select((F.col("triple_id") + 5_000).alias("triple_id"), "subject", "relation", "object", "confidence", F.floor(F.col("triple_id") / 10_000).cast("int").alias("source_sentence_idx"))
    facts = complete(themes.unionByName(rest).withColumn("source_article", F.lit(source)))
    return Graph(facts, None, None, utterances.count())


def item_graph(items: DataFrame, source: str) -> Graph:
    """Items (with ``place``) as facts: topic, subtopic, intent, whether they have commands and cautions, what they relate to."""
    s, joined = F.col("item_id"), F.lower(F.array_join("commands", " "))
    mark = F.coalesce(*(F.when(joined.contains(k), F.lit(k)) for k in DESTRUCTIVE))
    yes = lambda c: F.when(F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0, F.lit("yes"))
    facts = [
        *(F.array(fact(s, r, F.col(c))) for r, c in (("HAS_TOPIC", "topic"), ("HAS_SUBTOPIC", "subtopic"), ("HAS_INTENT", "intent"))),
        F.array(fact(s, "HAS_COMMANDS", yes(F.col("commands")))),
        F.array(fact(s, "USES_DESTRUCTIVE_COMMAND", mark)),
        F.array(fact(s, "HAS_CAUTION", yes(F.col("cautions")))),
        F.transform(F.coalesce("related_items", F.array().cast("array<string>")), lambda x: fact(s, "RELATED_TO", x)),
    ]
    out = complete(told(items, facts).withColumn("source_article", F.lit(source)).withColumn("source_sentence_idx", F.lit(0)))
    return Graph(out, None, None, items.count())


def curated(g: Graph, rows: list[tuple[str, str, str, str]]) -> Graph:
    """The graph with rows (subject, relation, object, source) put in by hand, marked by sentence -1; known facts stay."""
    top = g.facts.agg(F.max("triple_id")).head()[0]
    start = 0 if top is None else top + 1
    more = g.spark.createDataFrame([(start + n, *r, -1) for n, r in enumerate(rows)], "triple_id long, subject string, relation string, object string, source_article string, source_sentence_idx int")
    return g.over(add(g.facts, complete(more)))


def appended(*graphs: Graph) -> Graph:
    """All facts of several sources one after another, unchecked; aliases and authorities together."""
    facts, start = None, 0
    for g in graphs:
        mine = g.facts.withColumn("triple_id", F.col("triple_id") + F.lit(start))
        facts = mine if facts is None else facts.unionByName(mine)
        start += (g.facts.agg(F.max("triple_id")).head()[0] or 0) + 1
    return Graph(facts, _all([g.alias for g in graphs]), _all([g.authority for g in graphs]), sum(g.n_articles for g in graphs))


def _all(tables: list[DataFrame | None]) -> DataFrame | None:
    out = None
    for t in tables:
        if t is not None:
            out = t if out is None else out.unionByName(t)
    return out


def written_back(g: Graph, results: DataFrame, how: str) -> Graph:
    """The graph with computed facts (subject, relation, value) that queries see at once; source `computed:how`."""
    top = g.facts.agg(F.max("triple_id")).head()[0]
    said = results.select("subject", "relation", F.col("value").cast("string").alias("object"), F.lit(f"computed:{how}").alias("source_article"), F.lit(-1).alias("source_sentence_idx"))
    more = said.withColumn("triple_id", F.monotonically_increasing_id() + F.lit(0 if top is None else top + 1))
    return g.over(g.facts.unionByName(complete(more).select(*g.facts.columns)))


def by_topic(items: DataFrame, topic: str) -> DataFrame:
    return items.where(F.col("topic") == topic)


def by_id(items: DataFrame, item_id: str) -> DataFrame:
    return items.where(F.col("item_id") == item_id)


def all_topics(items: DataFrame) -> DataFrame:
    return items.select("topic").distinct()


def by_theme(utterances: DataFrame, theme: str) -> DataFrame:
    return utterances.where(F.array_contains("themes", theme))


def by_addressee(utterances: DataFrame, addressee: str) -> DataFrame:
    return utterances.where(F.col("addressee") == addressee)


def all_themes(utterances: DataFrame) -> DataFrame:
    return utterances.select(F.explode("themes").alias("theme")).distinct()
