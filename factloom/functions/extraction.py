"""Facts from prose: names, sentences with a verb between two names, lifespans, aliases.

Everything per value is a Column expression but the scan for names and verbs, which runs over Arrow batches of
sentences.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from factloom.functions.text import normalize_entity, split_sentences, strip_markup
from factloom.schema import Graph, complete

# Fixed words that begin or break no name: adjectives of peoples and times, pronouns, openers, articles and
# prepositions, months, auxiliaries.
STOPWORDS = (
    "Greek Roman Persian French German English Spanish Italian Egyptian American Russian Chinese Japanese Indian African European "
    "Asian Athenian Spartan Babylonian Macedonian Carthaginian British Irish Christian Jewish Muslim Buddhist Hindu Catholic "
    "Eastern Western Northern Southern Central Ancient Medieval Modern Early Late "
    "He She It They We I You His Her Their Its Our Your My Him Them Us "
    "This That These Those Such However Although Despite When While Since Then Therefore Thus Indeed Most Many Some Few All "
    "Both Either Neither Other Another Several Each First Second Third Last Next After Before During Now Today Tomorrow Yesterday "
    "But And Or Yet So Because If Unless Whether Where Why How What Who Which Whose "
    "A An The In On At To From By For With Of About Around Across Through Over Under "
    "January February March April May June July August September October November December "
    "Was Is Are Were Be Been Being Had Has Have Having Will Would Should Could Can Might Must Also Even Only Just Still Quite"
).split()
# Fixed words that go on with a name before another capitalised word.
CONNECTORS = ("the", "of", "de", "von", "der", "den", "le", "la", "du", "d")
# Fixed verbs: relation and pattern, subject to the left, object to the right.
ANCHORS = [
    ("BORN_IN", r"\bwas\s+born\s+(?:in|at)\b"),
    ("BORN_TO", r"\bwas\s+born\s+to\b"),
    ("DIED_IN", r"\bdied\s+(?:in|at)\b"),
    ("DIED_OF", r"\bdied\s+of\b"),
    ("TUTORED_BY", r"\bwas\s+tutored\s+by\b"),
    ("TUTORED_BY", r"\bstudied\s+(?:under|with|at)\b"),
    ("TUTORED_BY", r"\bwas\s+(?:a\s+)?(?:student|pupil)\s+of\b"),
    ("TUTORED", r"\btutored\b"),
    ("TUTORED", r"\btaught\b"),
    ("TUTORED", r"\bwas\s+(?:the\s+)?teacher\s+of\b"),
    ("CHILD_OF", r"\bwas\s+(?:the\s+)?(?:son|daughter|child)\s+of\b"),
    ("MARRIED", r"\bmarried\b"),
    ("MARRIED", r"\bwas\s+married\s+to\b"),
    ("RULER_OF", r"\bwas\s+(?:a\s+|the\s+)?(?:king|queen|emperor|pharaoh|ruler|tsar|sultan)\s+of\b"),
    ("RULER_OF", r"\breigned\s+(?:over|as)\b"),
    ("SUCCEEDED", r"\bsucceeded\b"),
    ("FOUNDED", r"\bfounded\b"),
    ("FOUNDED", r"\bestablished\b"),
    ("CONQUERED", r"\bconquered\b"),
    ("CONQUERED", r"\binvaded\b"),
    ("DEFEATED", r"\bdefeated\b"),
    ("WROTE", r"\bwrote\b"),
    ("WROTE", r"\bauthored\b"),
    ("WROTE", r"\bcomposed\b"),
    ("DISCOVERED", r"\bdiscovered\b"),
    ("DEVELOPED", r"\bdeveloped\b"),
    ("INVENTED", r"\binvented\b"),
    ("PROVED", r"\bproved\b"),
    ("MEMBER_OF", r"\bwas\s+(?:a\s+)?member\s+of\b"),
    ("PART_OF", r"\bis\s+(?:a\s+)?part\s+of\b"),
]
# Fixed patterns of a name with two years in brackets, with eras and of four digits.
LIFESPANS = (
    r"([A-Z][\w]+(?:\s+[A-Z][\w]+){0,3})\s*\([^)]{0,150}?\b(\d{1,4}\s*(?:BC|AD))\s*[^)]{0,10}?(?:[-–—]|to|ndash)\s*[^)]{0,30}?\b(\d{1,4}\s*(?:BC|AD))\s*\)",
    r"([A-Z][\w]+(?:\s+[A-Z][\w]+){0,3})\s*\([^)]{0,150}?\b(\d{4})\b\s*[^)]{0,10}?(?:[-–—]|to|ndash)\s*[^)]{0,30}?\b(\d{4})\b\s*[^)]{0,5}?\)",
)
# Fixed relations that nothing has to itself.
IRREFLEXIVE = "WROTE FOUNDED DISCOVERED DEVELOPED INVENTED BUILT PROVED TUTORED TUTORED_BY DEFEATED CONQUERED RULER_OF SUCCEEDED CHILD_OF DIED_OF DIED_IN BORN_IN MARRIED".split()
PRONOUNS = r"\b(?:[Hh]e|[Ss]he|[Tt]hey|[Ww]ho|[Ww]hich|[Tt]his|[Tt]hat)\b"
#: Characters between a verb and its names, at most.
REACH = 80


def resolve_pronouns(text: Column, title: Column) -> Column:
    """The title for each pronoun; a title of more than 5 words or 60 characters changes nothing."""
    quoted = F.regexp_replace(title, r"([\\$])", r"\\$1")
    short = (F.size(F.split(F.trim(title), r"\s+")) <= 5) & (F.length(title) <= 60)
    return F.when(short, F.regexp_replace(text, F.lit(PRONOUNS), quoted)).otherwise(text)


def is_meaningful(name: Column) -> Column:
    """Three characters at least, no stopword, and some token of more than two characters."""
    tokens = F.split(F.trim(name), r"\s+")
    return F.coalesce((F.length(name) >= 3) & ~name.isin(STOPWORDS) & F.exists(tokens, lambda t: F.length(t) > 2), F.lit(False))


def valid_triple(subject: Column, relation: Column, obj: Column, irreflexive: list[str] | None = None) -> Column:
    """Both ends are there, and differ (in any case) where the relation is nothing's to itself."""
    there = (F.length(subject) > 0) & (F.length(obj) > 0)
    mine = relation.isin(IRREFLEXIVE if irreflexive is None else irreflexive) & (F.lower(subject) == F.lower(obj))
    return F.coalesce(there & ~mine, F.lit(False))


def strip_trailing_subject(subject: Column, obj: Column) -> Column:
    """The object without the subject's words at its end, if it has more."""
    s, o = (F.filter(F.split(x, r"\s+"), lambda t: t != "") for x in (subject, obj))
    n = F.size(o) - F.size(s)
    tail = F.transform(F.slice(o, F.greatest(n, F.lit(0)) + 1, F.greatest(F.size(s), F.lit(1))), lambda t: F.lower(t))
    return F.when((n > 0) & (tail == F.transform(s, lambda t: F.lower(t))), F.array_join(F.slice(o, 1, F.greatest(n, F.lit(1))), " ")).otherwise(obj)


def names_in(text: str) -> list[tuple[int, int, str]]:
    """(start, end, name): each token becomes a letter for what it can do, and names are a pattern over the letters."""
    found = [(m.start(), m.end(), m[0]) for m in re.finditer(r"\b[A-Za-z][\w]*'?[\w]*\b", text)]
    kinds = "".join(map(_kind, (w for *_, w in found)))
    return [(found[m.start()][0], found[m.end() - 1][1], " ".join(w for *_, w in found[m.start() : m.end()])) for m in _NAME.finditer(kinds)]


#: R and r: numerals (that can begin a name, or not); K and k: connectors (lower, or fit to begin a name); C: a name.
_NAME = re.compile(r"[CRk](?:[Rr]|[Kk][Ck]|C)*")
_STOP, _GOES_ON = frozenset(STOPWORDS), frozenset(CONNECTORS)


def _kind(word: str) -> str:
    begins = word[0].isupper() and word not in _STOP
    if re.fullmatch("[IVX]+", word):
        return "R" if begins else "r"
    if word.lower() in _GOES_ON:
        return "k" if begins else "K"
    return "C" if begins else "."


SPANS = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("entity", StringType())]))
TRIPLES = ArrayType(StructType([StructField(c, StringType()) for c in ("subject", "relation", "object")]))


@F.pandas_udf(SPANS)
def find_entity_spans(text: pd.Series) -> pd.Series:
    """Runs of capitalised words, with connectors and numerals inside: array<struct<start, end, entity>>."""
    return text.map(lambda t: [{"start": s, "end": e, "entity": n} for s, e, n in names_in(t)] if t is not None else None)


def _said(text: str, title: str) -> list[dict]:
    names, out = names_in(text), []
    first = title.split()[0] if title.split() else ""
    about = bool(first) and first in text and _meaningful(title)
    for relation, pattern in _VERBS:
        for m in pattern.finditer(text):
            right = next((n for s, _, n in names if 0 <= s - m.end() <= REACH), None)
            if right is None:
                continue
            left = max(((e, n) for _, e, n in names if 0 <= m.start() - e), default=None, key=lambda x: x[0])
            subject = title if about or left is None or m.start() - left[0] > REACH else left[1]
            if subject != right:
                out.append({"subject": subject, "relation": relation, "object": right})
    for pattern in _LIVES:
        for m in pattern.finditer(text):
            name = title if m[1] == first and _meaningful(title) else m[1]
            out += [{"subject": name, "relation": r, "object": re.sub(r"^(\d+)\s*([A-Z]{2})$", r"\1 \2", y)} for r, y in (("BORN_DATE", m[2]), ("DIED_DATE", m[3]))]
    return out


_VERBS, _LIVES = [(r, re.compile(p)) for r, p in ANCHORS], [re.compile(p) for p in LIFESPANS]


def _meaningful(name: str) -> bool:
    return len(name) >= 3 and name not in _STOP and any(len(t) > 2 for t in name.split())


@F.pandas_udf(TRIPLES)
def said(text: pd.Series, title: pd.Series) -> pd.Series:
    """What a sentence of an article says: array<struct<subject, relation, object>>."""
    return pd.Series([_said(x, t or "") if x is not None else [] for x, t in zip(text, title)])


def extract_facts(articles: DataFrame, markup: bool = True, parser=None) -> DataFrame:
    """Facts of articles (title, text), each once an article by its first sentence; numbered by title and sentence.

    Sentences are read as they are and with the title for their pronouns. Ends that name nothing go. ``parser``: a
    pandas UDF like `said`, from a dependency parser where one is installed, that reads sentences in its place.
    """
    body = strip_markup(F.col("text")) if markup else F.col("text")
    sentences = articles.select("title", F.posexplode(split_sentences(body)).alias("source_sentence_idx", "sentence"))
    both = F.array_distinct(F.array("sentence", resolve_pronouns(F.col("sentence"), F.col("title"))))
    read = sentences.select("title", "source_sentence_idx", F.posexplode(both).alias("variant", "s")).select("title", "source_sentence_idx", "variant", F.posexplode((parser or said)(F.col("s"), F.col("title"))).alias("nth", "t"))
    kept = read.where(is_meaningful(F.col("t.subject")) & is_meaningful(F.col("t.object")))
    place = F.struct("source_sentence_idx", "variant", "nth")
    first = kept.groupBy(F.col("title").alias("source_article"), "t.subject", "t.relation", "t.object").agg(F.min(place).alias("p"))
    first = first.orderBy("source_article", "p").withColumn("triple_id", F.monotonically_increasing_id())
    return complete(first.select("triple_id", "subject", "relation", "object", "source_article", "p.source_sentence_idx"))


def clean_facts(facts: DataFrame, alias: DataFrame | None = None, irreflexive: list[str] | None = None) -> DataFrame:
    """Facts with names in canonical form, without the subject at the object's end, of valid ends only."""
    from factloom.schema import canonical

    for c in ("subject", "object"):
        facts = facts.withColumn(c, normalize_entity(F.col(c)))
    facts = facts.withColumn("object", strip_trailing_subject(F.col("subject"), F.col("object")))
    for c in ("subject", "object"):
        facts = canonical(facts, c, alias, "_name").withColumn(c, F.col("_name")).drop("_name")
    return facts.where(valid_triple(F.col("subject"), F.col("relation"), F.col("object"), irreflexive))


def build_aliases(titles: DataFrame, persons: DataFrame | None = None) -> DataFrame:
    """surface, canonical: each title itself, and a last word that one title only ends in and that is no title.

    persons: titles of people, from a recogniser of names; then only theirs give words, their first ones too.
    """
    t = titles.select("title").where(is_meaningful(F.col("title"))).distinct()
    words = F.filter(F.split("title", r"\s+"), lambda w: w != "")
    base = t if persons is None else t.join(persons.select("title").distinct(), "title", "left_semi")
    ends = F.array(F.element_at(words, -1)) if persons is None else F.array_distinct(F.array(F.element_at(words, 1), F.element_at(words, -1)))
    claims = base.where(F.size(words) > 1).select("title", F.explode(ends).alias("surface")).where(is_meaningful(F.col("surface")))
    alone = claims.groupBy("surface").agg(F.count_distinct("title").alias("n"), F.min("title").alias("canonical")).where("n = 1")
    alone = alone.join(t.select(F.col("title").alias("surface")), "surface", "left_anti").select("surface", "canonical")
    return t.select(F.col("title").alias("surface"), F.col("title").alias("canonical")).unionByName(alone)


def extract_graph(articles: DataFrame, irreflexive: list[str] | None = None) -> Graph:
    """Articles to a graph: facts extracted and cleaned, aliases of the titles."""
    alias = build_aliases(articles)
    facts = clean_facts(extract_facts(articles), alias, irreflexive)
    return Graph(facts, alias, None, articles.count())


def source_confidence(g: Graph) -> DataFrame:
    """Facts with confidence by who says them: curated (sentence -1) 0.95, the subject's own article 1, others 0.7."""
    from factloom.schema import canonical

    named = canonical(g.facts, "subject", g.alias, "_name")
    own = (F.col("source_article") == F.col("subject")) | (F.col("source_article") == F.col("_name"))
    return named.withColumn("confidence", F.when(F.col("source_sentence_idx") == -1, 0.95).when(own, 1.0).otherwise(0.7)).drop("_name")
