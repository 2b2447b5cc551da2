import pytest
from pyspark.sql import functions as F

from factloom.functions import extraction, text
from factloom.operators import conflict, eras, query, reach, rules
from factloom.operators.ontology import Ontology, compile_to_rules, enrich, inconsistencies, memberships
from factloom.plans import domains
from factloom.plans.program import triples_of
from factloom.schema import graph
from factloom.sources import builders


def spo(df):
    return {tuple(r) for r in df.select("subject", "relation", "object").collect()}


def column(df, name=None):
    return sorted(r[0] for r in (df.select(name) if name else df).collect())


def one(spark, value):
    return spark.range(1).select(value.alias("v")).head()[0]


def test_names_and_verbs(spark):
    names = lambda t: [n for *_, n in extraction.names_in(t)]
    assert names("In Paris, Alexander the Great met Henry VIII of England.") == ["Paris Alexander the Great", "Henry VIII of England"]
    assert names("He moved to the city of Rome and O'Brien stayed") == ["Rome", "O'Brien"]
    t = "Aristotle was tutored by Plato."
    df = spark.createDataFrame([(t, "Aristotle"), (None, "x"), ("Nothing here.", None)], "text string, title string")
    got = [[(x["subject"], x["relation"], x["object"]) for x in r[0]] for r in df.select(extraction.said("text", "title")).collect()]
    assert got == [[("Aristotle", "TUTORED_BY", "Plato"), ("Aristotle", "TUTORED", "Plato")], [], []]
    spans = df.select(extraction.find_entity_spans("text").alias("s")).head()["s"]
    assert [(s["start"], s["end"], s["entity"]) for s in spans] == [(0, 9, "Aristotle"), (25, 30, "Plato")]


def test_articles_become_graphs(spark):
    body = "Ada Lovelace (10 December 1815 - 27 November 1852) was an English mathematician. She was tutored by Augustus Morgan. Her notes were studied. Charles Babbage invented the Analytical Engine."
    articles = spark.createDataFrame([("Ada Lovelace", body), ("Plato Academy", "He founded the Academy of Athens in his garden there.")], "title string, text string")
    g = extraction.extract_graph(articles)
    got = spo(g.facts)
    assert {("Ada Lovelace", "BORN_DATE", "1815"), ("Ada Lovelace", "DIED_DATE", "1852"), ("Ada Lovelace", "TUTORED_BY", "Augustus Morgan"), ("Charles Babbage", "INVENTED", "Analytical Engine"), ("Plato Academy", "FOUNDED", "Academy of Athens")} <= got
    assert {tuple(r) for r in g.alias.collect()} == {("Ada Lovelace", "Ada Lovelace"), ("Plato Academy", "Plato Academy"), ("Lovelace", "Ada Lovelace"), ("Academy", "Plato Academy")}
    told = {r["object"]: r["confidence"] for r in extraction.source_confidence(g).where("relation in ('BORN_DATE', 'INVENTED')").collect()}
    assert told == {"1815": 1.0, "Analytical Engine": 0.7}


def test_name_helpers(spark):
    lit = F.lit
    assert one(spark, extraction.resolve_pronouns(lit("Then he and she wrote; this is."), lit("Ann $1 B"))) == "Then Ann $1 B and Ann $1 B wrote; Ann $1 B is."
    assert one(spark, extraction.resolve_pronouns(lit("he"), lit("a b c d e f"))) == "he"
    assert [one(spark, extraction.is_meaningful(lit(x))) for x in ("Bo", "The", "A Bc De", "Rome")] == [False, False, False, True]
    assert one(spark, extraction.strip_trailing_subject(lit("Aristotle"), lit("Nicomachean Ethics aristotle"))) == "Nicomachean Ethics"
    assert one(spark, extraction.strip_trailing_subject(lit("Aristotle"), lit("Aristotle"))) == "Aristotle"
    assert [one(spark, extraction.valid_triple(lit("benzene"), lit("SYNTHESIZES"), lit("Benzene"), x)) for x in (None, ["SYNTHESIZES"])] == [True, False]
    titles = spark.createDataFrame([("Albert Einstein",), ("Max Born",), ("Hedwig Born",), ("Academy Awards",), ("Awards",)], "title string")
    assert {r[0] for r in extraction.build_aliases(titles).where("surface <> canonical").collect()} == {"Einstein"}
    people = titles.where("title like 'A%E%' or title like '%Born'")
    assert {r[0] for r in extraction.build_aliases(titles, people).where("surface <> canonical").collect()} == {"Einstein", "Albert", "Max", "Hedwig"}


def services(spark):
    code = {
        "gateway": [("CALL", "orders"), ("CALL", "notes")],
        "orders": [("CALL", "ledger"), ("OPAQUE", "scorer")],
        "ledger": [("OPAQUE", "mainframe")],
        "notes": [("PUSH", "1")],
        "batch": [("CALL", "batch"), ("MAP", "ledger")],
    }
    g = graph(spark, [t for name, steps in code.items() for t in triples_of(name, steps)] + [("orders", "HANDLES_PII", "customer"), ("gateway", "HANDLES_PII", "customer"), ("ledger", "WRITES_TO", "db")])
    return g, reach.calls(g.facts), reach.calls(g.facts, "OPAQUE")


def test_who_reaches_whom(spark):
    g, calls, held = services(spark)
    start = spark.createDataFrame([("gateway",), ("batch",)], "start string")
    assert {tuple(r) for r in reach.reach(calls, start).collect()} == {("gateway", "orders"), ("gateway", "notes"), ("gateway", "ledger"), ("batch", "batch")}
    assert column(reach.transitive_opaque(g.facts, "gateway")) == ["mainframe", "scorer"] and column(reach.transitive_opaque(g.facts, "batch")) == []
    assert column(reach.boundary(calls, held, "ledger")) == ["mainframe"]
    assert column(reach.blast_radius(calls, held, "mainframe")) == ["gateway", "ledger", "orders"]
    assert column(reach.effects(g.facts, calls, "gateway")) == ["ledger"]
    wide = g.over(g.facts.select("subject", "relation", "object").unionByName(reach.architecture(g.facts)).withColumn("triple_id", F.monotonically_increasing_id()))
    assert {tuple(r) for r in reach.exposed(wide.facts).collect()} == {("orders", "scorer")}
    line = graph(spark, [("a", "R", "b"), ("c", "R", "b"), ("c", "R", "d"), ("d", "R", "e")])
    assert sorted(map(tuple, reach.layer_sizes(line, "a").collect())) == [(0, 1), (1, 1), (2, 1), (3, 1)]
    paths = query.find_paths(line, "a", "d")
    assert reach.format_paths(line, paths).head()["text"] == "a --R--> b <--R-- c --R--> d"
    assert reach.format_paths(line, query.find_paths(line, "a", "a")).head()["text"] == "(empty path)"


def test_orders_groups_and_rings(spark):
    rows = [{"subject": "task", "relation": "STEP", "object": s, "scope": scope, "seq": n} for scope, steps in (("long", "abcd"), ("short", "ad")) for n, s in enumerate(steps)]
    g = graph(spark, [*rows, ("t1", "ACCOUNT", "x"), ("t2", "ACCOUNT", "z"), ("x", "SHARED", "y"), ("p", "IN_DEPARTMENT", "d"), ("q", "IN_DEPARTMENT", "d"), ("v", "BORN_IN", "R"), ("v", "DIED_IN", "R"), ("w", "BORN_IN", "R")])
    assert [tuple(r) for r in reach.precedes(g.facts, "long").select("a", "b").orderBy("a").collect()] == [("a", "b"), ("b", "c"), ("c", "d")]
    assert column(reach.dropped_steps(g.facts, "long", "short"), "object") == ["b", "c"]
    edges = reach.precedes(g.facts, "long").select("a", "b")
    assert reach.without_direct(rules.closure(edges), edges).count() == 3
    assert spo(reach.group_pairs(g.facts, "IN_DEPARTMENT")) == {("p", "COLLEAGUE_OF", "q"), ("q", "COLLEAGUE_OF", "p")}
    flagged = spark.createDataFrame([("t2",)], "subject string")
    assert column(reach.flagged_or_in_ring(flagged, g.facts, "ACCOUNT", "SHARED")) == ["t1", "t2"]
    assert [tuple(r) for r in reach.same_place(g.facts).collect()] == [("v", "R")]
    cycle = graph(spark, [("a", "PRECEDES", "b"), ("b", "PRECEDES", "c"), ("c", "PRECEDES", "a"), ("c", "PRECEDES", "d")])
    closed, _, _ = rules.fixpoint(cycle, [domains.precedence()], propagate_confidence=False)
    assert column(closed.facts.where("subject = object"), "subject") == ["a", "b", "c"]
    closed, _, _ = rules.fixpoint(cycle, [domains.linked("PRECEDES")])
    assert closed.facts.where("subject = object").count() == 0 and ("a", "PRECEDES", "d") in spo(closed.facts)


ERAS = [("old", -400, 1000), ("mid", 1001, 1800), ("new", 1801, 9999)]


def test_eras(spark):
    rows = [("atom", "IS_A", "Idea", "a", 0, None, "1800 AD"), ("atom", "IS_A", "Body", "a", 0, "1700 AD", None), ("atom", "HAS_PROPERTY", "whole", "a", 0, "300 BC", "1500 AD"), ("atom", "REJECTS_PROPERTY", "whole", "a", 0, "1900 AD", None), ("other", "IS_A", "Idea", "a", 0, "1990-01-01", "1991")]
    g = graph(spark, rows)
    e = spark.createDataFrame(ERAS, "name string, from_year int, to_year int")
    p = {r["era"]: r for r in eras.projections(g.facts, e, "atom").collect()}
    assert [p[x]["n_facts"] for x in ("old", "mid", "new")] == [2, 3, 3] and [p[x]["is_a"] for x in ("old", "mid", "new")] == [["Idea"], ["Body", "Idea"], ["Body"]]
    assert p["new"]["rejects_property"] == ["whole"] and p["old"]["vocabulary"] == ["HAS_PROPERTY", "IS_A"]
    shaped = eras.projections(g.facts, e, "atom")
    assert {r["era"]: (r["appeared"], r["retired"]) for r in eras.drift(shaped).collect()} == {"old": (["Idea"], []), "mid": (["Body"], []), "new": ([], ["Idea"])}
    assert [tuple(r) for r in eras.reversals(shaped).collect()] == [("whole", ["old", "mid"], ["new"])]
    held = eras.facts_in_eras(g.facts.where("subject = 'atom'"), e)
    sets = {"old": {"IS_A", "HAS_PROPERTY"}, "mid": {"IS_A", "HAS_PROPERTY"}, "new": {"IS_A", "REJECTS_PROPERTY"}}
    want = {(a, b): 1 - len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    got = {(r["a"], r["b"]): r["distance"] for r in eras.jaccard(held, "era", "relation").collect()}
    assert got == pytest.approx(want) and eras.mean_distance(held, "era", "relation").head()[0] == pytest.approx(sum(want.values()) / 3)
    scoped = graph(spark, [{"subject": "x", "relation": "R", "object": o, "scope": s} for o, s in (("1", "a"), ("2", "b"), ("2", None))])
    assert [tuple(r) for r in eras.positions(scoped.facts).collect()] == [("R", 2, 2)]


def test_utterances(spark):
    rows = [(0, "t0", ["fate", "sea"], "crew", "curse", "bitter"), (1, "t1", ["fate", "whale"], "self", "dialogue", "reflective"), (2, "t2", ["alone"], None, "dialogue", None)]
    u = spark.createDataFrame(rows, "place long, text string, themes array<string>, addressee string, speech_act string, mood string")
    g = builders.utterance_graph(u, "book")
    c = {r["object"]: r["confidence"] for r in g.facts.where("relation = 'HAS_THEME'").collect()}
    assert c == {"fate": 1.0, "sea": 0.5, "whale": 0.5, "alone": 0.5}
    assert {("u02", "ADDRESSED_TO", "crew"), ("u02", "HAS_MOOD", "oratorical"), ("u00", "IS_SPEECH_ACT", "curse")} <= spo(g.facts) and g.n_articles == 3
    closed, _, _ = rules.fixpoint(g, [*domains.utterance_rules(), *compile_to_rules(domains.utterances())])
    got = spo(closed.facts)
    assert {x for x in got if x[1] == "CO_OCCURS_WITH"} == {(a, "CO_OCCURS_WITH", b) for a, b in (("fate", "sea"), ("sea", "fate"), ("fate", "whale"), ("whale", "fate"))}
    assert ("sea", "THEMATICALLY_REACHES", "whale") in got and ("alone", "IS", "ISOLATED_THEME") in got
    assert {x[0] for x in got if x[2] == "PEACEFUL_ADDRESSEE"} == {"self"} and {x[0] for x in got if x[2] == "INTROSPECTIVE_UTTERANCE"} == {"u00", "u01"}
    assert column(builders.all_themes(u)) == ["alone", "fate", "sea", "whale"] and builders.by_theme(u, "fate").count() == 2 and builders.by_addressee(u, "crew").count() == 1
    asked = spark.createDataFrame([("what of the sea",), ("hm",)], "question string")
    said = text.best_utterances(asked, [{"text": "The sea " * 5, "themes": ["sea"], "mood": "calm"}, {"text": "", "themes": [], "mood": "calm"}], {"sea": ["sea", "ocean"]})
    assert {r["question"]: r["answer"] for r in said.collect()}["what of the sea"] == "The sea " * 5


def test_items(spark):
    rows = [(0, "a", "commit", "undo", ["git reset --hard"], [], ["b"]), (1, "b", "log", "show", ["git log"], None, ["c", "a"]), (2, "c", "log", "show", [], ["careful"], None)]
    i = spark.createDataFrame(rows, "place long, item_id string, topic string, subtopic string, commands array<string>, cautions array<string>, related_items array<string>").withColumn("intent", F.lit("how-to"))
    g = builders.item_graph(i, "docs")
    assert ("a", "USES_DESTRUCTIVE_COMMAND", "--hard") in spo(g.facts) and g.facts.where("relation = 'HAS_COMMANDS'").count() == 2
    closed, _, _ = rules.fixpoint(g, [*domains.item_rules(), *compile_to_rules(domains.items())])
    got = spo(closed.facts)
    assert {x[0] for x in got if x[2] == "SAFE_TO_AUTOMATE"} == {"b"} and {x[0] for x in got if x[2] == "RECOVERY_OPERATION"} == {"a"}
    assert {x[2] for x in got if x[:2] == ("a", "REACHABLE_FROM")} == {"b", "c"}
    assert column(reach.reachable_in_class(closed.facts, "b", "REACHABLE_FROM", "IS", "RECOVERY_OPERATION")) == ["a"]
    assert column(builders.all_topics(i)) == ["commit", "log"] and builders.by_topic(i, "log").count() == 2 and builders.by_id(i, "c").count() == 1
    shown = text.format_answer({"item_id": "a", "commands": ["git log"], "explanation": "shows " * 20, "cautions": ["mind"], "related_items": ["b"]}, 3)
    assert shown.startswith("a  (score 3.0)\n  $ git log\n  shows") and max(map(len, shown.split("\n"))) <= 72


def test_written_back_curated_and_appended(spark):
    g = graph(spark, [("a", "R", "b")], {"A": "a"}, {"s": 0.5})
    put = builders.curated(g, [("a", "R", "b", "me"), ("c", "R", "d", "me")])
    assert put.facts.count() == 2 and put.facts.where("source_sentence_idx = -1 AND subject = 'c'").count() == 1
    res = builders.written_back(put, spark.createDataFrame([("x", "TOTAL", 570.0)], "subject string, relation string, value double"), "sum")
    assert [tuple(r) for r in query.out_facts(res, "x").select("object", "source_article").collect()] == [("570.0", "computed:sum")]
    both = builders.appended(g, put)
    assert both.facts.count() == 3 and both.facts.select("triple_id").distinct().count() == 3 and both.alias.count() == 2


def test_import_audit(spark):
    rows = [("P1", "IS_A", "CentrifugalPump", "vendor", 1), ("P1", "IS_A", "PositiveDisplacementPump", "manual", 2), ("P1", "RATED_FLOW_GPM", "500", "vendor", 3), ("P1", "RATED_FLOW_GPM", "650", "sensor", 4), ("P1", "IS_A", "InService", "ops", 5), ("P1", "IS_A", "Decommissioned", "ledger", 6)]
    found, _ = domains.import_audit(graph(spark, rows), domains.pumps())
    assert {tuple(r) for r in domains.conflict_counts(found).collect()} == {("CONFLICT_FUNCTIONAL", 1), ("CONTRADICTION_DETECTED", 2)}
    assert found.where("object = 'RotodynamicMachine'").head()["sources"] == ["vendor#1"]


def test_class_expressions(spark):
    ont = Ontology("o").subclass_of("Dog", "Animal").class_intersection("GuardDog", "Dog", "Guard").class_complement("NonAnimal", "Animal").all_values("DogOwner", "OWNS", "Dog").disjoint_with("Dog", "Cat").cardinality("CHIP", max=1)
    g = graph(spark, [("rex", "IS_A", "Dog"), ("rex", "IS_A", "Guard"), ("tom", "IS_A", "Cat"), ("ann", "IS_A", "DogOwner"), ("ann", "OWNS", "rex")])
    full, info = enrich(g, ont)
    assert info["consistent"] and spo(full.facts.where("source_article = '(owl)'")) == {("rex", "IS_A", "GuardDog"), ("rex", "IS_A", "Animal")}
    for more, why in ((("ann", "OWNS", "tom"), "all:OWNS|Dog"), (("rex", "IS_A", "NonAnimal"), "disjoint:NonAnimal|Animal"), (("rex", "IS_A", "Cat"), "disjoint:Dog|Cat")):
        bad, info = enrich(graph(spark, [("rex", "IS_A", "Dog"), ("tom", "IS_A", "Cat"), ("ann", "IS_A", "DogOwner"), more]), ont)
        assert not info["consistent"] and why in {w for _, w in info["why"]} and ("o", "CONTRADICTION_DETECTED", "OWL_INCONSISTENT") in spo(bad.facts)
    chips = graph(spark, [("rex", "CHIP", "1"), ("rex", "CHIP", "2")])
    assert [tuple(r) for r in inconsistencies(chips.facts, ont).collect()] == [("rex", "cardinality:CHIP")] and memberships(chips.facts, ont).count() == 0


def test_framings(spark):
    g = graph(spark, [{"subject": "light", "relation": "IS", "object": o, "scope": s} for o, s in (("wave", "A"), ("particle", "B"))])
    got = dict(map(tuple, domains.framing_checks(g, Ontology().functional_property("IS"), [("A", "B")]).collect()))
    assert got == {"scoped": 0, "leaked:A": 1, "merged:A+B": 1}


def test_small_queries(spark):
    g = graph(spark, [("s1", "BORN_DATE", "400 BC"), ("s2", "BORN_DATE", "1850"), ("s3", "BORN_DATE", "301 BC"), ("s1", "BORN_DATE", "450 BC"), ("s1", "IS", "X"), ("s2", "IS", "Y"), ("s3", "IS", "X"), ("s3", "IS", "Y")], {"first": "s1"})
    assert column(query.born_between(g.facts, 301, 500, bc=True), "subject") == ["s1", "s3"] and column(query.born_between(g.facts, 301, 400, bc=True, k=1), "object") == ["400 BC"]
    assert column(query.born_between(g.facts, 1800, 1899), "subject") == ["s2"]
    assert query.has(g, "first", "IS") and not query.has(g, "s9", "IS")
    assert {tuple(r) for r in query.overlap(g.facts, "IS", "X", "Y").collect()} == {("s1", "X"), ("s2", "Y"), ("s3", "both")}
    assert column(query.first_distinct(g.facts, "subject", 2)) == ["s1", "s2"] and query.least_sure(g.facts, 2).count() == 2
    settled, _, conflicts, _ = domains.biography_report(g)
    assert conflicts.count() > 0 and settled.facts.count() > 0
    assert conflict.MARKERS
