import math
import pytest
from pyspark.sql import functions as F

from factloom.functions import confidence, temporal, text
from factloom.operators import conflict, query, rules
from factloom.operators.ontology import Ontology, compile_to_rules
from factloom.plans.program import ExecError, call_value, execute, run_program, score_flags, surface, triples_of, validate
from factloom.schema import graph


def spo(df):
    return {tuple(r) for r in df.select("subject", "relation", "object").collect()}


def pairs(df, relation):
    return {(s, o) for s, r, o in spo(df) if r == relation}


def test_lookups_follow_aliases_of_the_argument(spark):
    g = graph(spark, [("Albert Einstein", "BORN_IN", "Ulm"), ("Ulm", "PART_OF", "Germany")], {"Einstein": "Albert Einstein"})
    assert pairs(query.out_facts(g, "Einstein"), "BORN_IN") == {("Albert Einstein", "Ulm")}
    assert {r[0] for r in query.neighbours(g, "Ulm").collect()} == {"Albert Einstein", "Germany"}
    assert query.entities(g).count() == 3


def test_chain_and_paths(spark):
    g = graph(spark, [("a", "R", "b"), ("c", "R", "b"), ("c", "S", "d"), ("a", "S", "d")])
    assert sorted(r["end"] for r in query.chain_query(g, "a", ["R", "R"]).collect()) == ["a", "c"]
    assert [r[0] for r in query.find_paths(g, "b", "d").collect()] == [[0, 3], [1, 2]]
    assert [r[0] for r in query.find_paths(g, "b", "b").collect()] == [[]]
    assert query.find_paths(g, "b", "nowhere").count() == 0


def test_deep_chain_and_cycle(spark):
    chain = [("E", "TUTORED_BY", "F"), ("D", "TUTORED_BY", "E"), ("C", "TUTORED_BY", "D"), ("B", "TUTORED_BY", "C"), ("A", "TUTORED_BY", "B")]
    closed, derivations, stats = rules.fixpoint(graph(spark, chain))
    assert len(pairs(closed.facts, "INTELLECTUAL_DESCENDANT_OF")) == 10
    assert len(pairs(closed.facts, "INFLUENCED_BY")) == 15
    assert derivations.count() >= 25 and stats["total_iters"] >= 3
    cycle, _, _ = rules.fixpoint(graph(spark, [("a", "TUTORED_BY", "b"), ("b", "TUTORED_BY", "c"), ("c", "TUTORED_BY", "a")]))
    found = pairs(cycle.facts, "INTELLECTUAL_DESCENDANT_OF")
    assert len(found) == 6 and all(a != b for a, b in found)


def test_negation_comes_after_its_stratum(spark):
    closed, derivations, _ = rules.fixpoint(graph(spark, [("Child", "CHILD_OF", "Parent"), ("Parent", "CHILD_OF", "Grandparent")]))
    assert pairs(closed.facts, "GRANDCHILD_OF") == {("Child", "Grandparent")}
    assert {s for s, o in pairs(closed.facts, "IS_A")} == {"Grandparent"}
    assert rules.why(derivations, "Child", "GRANDCHILD_OF", "Grandparent").head()["rule_name"] == "grandchild"
    sources = rules.trace_sources(closed.facts, derivations)
    assert sources.count() == derivations.count()


def test_divergence_is_an_error(spark):
    grow = rules.Rule("grow", lambda g: g.facts.where("relation = 'N'").select("subject", "relation", F.concat("object", F.lit("x")).alias("object"), F.array(rules.as_input()).alias("inputs")))
    with pytest.raises(rules.FixpointDivergence):
        rules.fixpoint(graph(spark, [("a", "N", "x")]), [grow], max_iter=3)


def test_confidence_and_time_of_derived_facts(spark):
    rows = [("a", "P", "b", "s", 0, "407 BC", "399 BC", 0.8), ("b", "P", "c", "s", 1, "400 BC", "347 BC", 0.5), ("x", "P", "y", "s", 2, "407 BC", "399 BC"), ("y", "P", "z", "s", 3, "367 BC", "347 BC")]
    closed, _, _ = rules.fixpoint(graph(spark, rows), [rules.transitive("P")])
    made = closed.facts.where("source_article = '(derived)'").collect()
    assert [(r["subject"], r["object"], round(r["confidence"], 6), r["valid_from"], r["valid_to"]) for r in made] == [("a", "c", 0.4, "400 BC", "399 BC")]


def test_ontology_axioms(spark):
    ont = Ontology().transitive_property("T").inverse_properties("P", "Q").subclass_of("Philosopher", "Person").subclass_of("Person", "Living").domain("BORN_IN", "Person").range("BORN_IN", "Place")
    rows = [("A", "T", "B"), ("B", "T", "C"), ("C", "T", "D"), ("x", "P", "y"), ("s", "IS_A", "Philosopher"), ("s", "BORN_IN", "Athens")]
    closed, _, _ = rules.fixpoint(graph(spark, rows), compile_to_rules(ont))
    assert len(pairs(closed.facts, "T")) == 6 and pairs(closed.facts, "Q") == {("y", "x")}
    assert {o for s, o in pairs(closed.facts, "IS_A") if s == "s"} == {"Philosopher", "Person", "Living"}
    assert ("Athens", "Place") in pairs(closed.facts, "IS_A")


@pytest.mark.parametrize(
    ("rows", "policy", "left"),
    [
        ([("Sparta", "LED_BY", "Leonidas", "h", 0, "490 BC", None), ("Sparta", "LED_BY", "Pausanias", "h", 1, "479 BC", None)], conflict.latest_wins, {"Pausanias"}),
        ([("Iliad", "LED_BY", "Homer", "h", 0, None, None, 0.6), ("Iliad", "LED_BY", "bards", "h", 1, None, None, 0.9)], conflict.highest_confidence, {"bards"}),
        ([("Darwin", "LED_BY", "A", "h", 0, "1825", "1827"), ("Darwin", "LED_BY", "B", "h", 1, "1828", "1831")], conflict.highest_confidence, {"A", "B"}),
    ],
)
def test_policies(spark, rows, policy, left):
    settled, _, _, _ = conflict.reason_and_resolve(graph(spark, rows), [], Ontology().functional_property("LED_BY"), [policy])
    assert {o for _, o in pairs(settled.facts, "LED_BY")} == left


def test_authority_keeps_equal_values_of_losing_sources(spark):
    rows = [("C", "N", "6", "good", 0), ("C", "N", "5", "poor", 1), ("C", "N", "6", "poor", 2)]
    g = graph(spark, rows, None, {"good": 1.0, "poor": 0.1})
    settled, _, _, stats = conflict.reason_and_resolve(g, [], Ontology().functional_property("N"), [conflict.authority_wins])
    assert [r["object"] for r in settled.facts.collect()] == ["6", "6"] and stats["n_conflicts"] == 1


def test_review_marks_what_is_open_and_scopes_keep_apart(spark):
    rows = [("P", "IS_A", "Planet"), ("P", "IS_A", "Dwarf")]
    settled, _, _, _ = conflict.reason_and_resolve(graph(spark, rows), [], Ontology().disjoint_with("Planet", "Dwarf"))
    assert len(pairs(settled.facts, "IS_A")) == 2 and len(pairs(settled.facts, "CONFLICT_UNRESOLVED")) == 1
    scoped = [{"subject": "l", "relation": "N", "object": o, "scope": s} for o, s in (("wave", "a"), ("particle", "b"))]
    _, _, found, _ = conflict.reason_and_resolve(graph(spark, scoped), [], Ontology().functional_property("N"))
    assert found.count() == 0


def test_purify_merges_and_prunes(spark):
    rows = [("s", "R", "o", f"src{i}", i, None, None, 0.7) for i in range(3)] + [("s", "R2", "weak", "x", 3, None, None, 0.2)]
    clean, report = conflict.purify(graph(spark, rows), Ontology())
    one = clean.facts.collect()
    assert len(one) == 1 and round(one[0]["confidence"], 3) == 0.973 and one[0]["source_article"] == "src0, src1, src2"
    assert report["groups_merged"] == 1 and report["pruned"] == 1


def test_dates_and_relations(spark):
    df = spark.createDataFrame([("2018-12-31",), ("2019-01-01",), ("356 BC",), ("-450",), ("50 AD",), (" 1999 ",), (None,)], "d string")
    assert [r[0] for r in df.select(temporal.date_ord(F.col("d"))).collect()] == [775294, 775296, -136704, None, 19200, 767616, None]
    say = lambda *d: spark.range(1).select(temporal.relation(*(temporal.date_ord(F.lit(x).cast("string")) for x in d))).head()[0]
    assert say("2018-01-01", "2018-06-30", "2018-06-30", "2018-12-31") == "meets"
    assert say("2018-01-30", "2018-01-31", "2018-02-01", "2018-02-02") == "before"
    assert say("2018", None, "2017", None) == "overlaps"
    assert temporal.compose("equal", "meets") == ["meets"] and len(temporal.compose("meets", "meets")) == 13


def test_confidence_functions(spark):
    a = F.array(F.lit(0.5), F.lit(1.5))
    row = spark.range(1).select(confidence.noisy_and(a), confidence.noisy_or(F.array(F.lit(0.7), F.lit(0.7), F.lit(0.7))), confidence.min_confidence(F.array().cast("array<double>"))).head()
    assert row[0] == 0.5 and round(row[1], 3) == 0.973 and row[2] == 1.0
    with pytest.raises(ValueError):
        confidence.derive_confidence(a, "no such way")


def value(spark, programs, inputs=None, **more):
    df = spark.createDataFrame([tuple(float(v) for v in (inputs or {"_": 0}).values())], list((inputs or {"_": 0}).keys()))
    return run_program(df, programs, "main", list((inputs or {}).keys()), **more).head()["value"]


def test_programs(spark):
    push = lambda *x: [("PUSH", str(v)) for v in x]
    assert value(spark, {"main": [("LOAD", "a"), ("LOAD", "b"), ("MUL", "")]}, {"a": 6, "b": 7}) == 42
    assert value(spark, {"main": [*push(-7, 3), ("MOD", "")]}) == 2 and value(spark, {"main": [*push(7, -3), ("MOD", "")]}) == -2
    assert value(spark, {"main": [*push(12, 10), ("XOR", "")]}) == 6 and value(spark, {"main": [*push(5), ("NOT", "")]}) == -6
    fold = {"main": [*push(0, 6), ("FOLD", "sum")], "sum": [("LOAD", "acc"), ("LOAD", "i"), ("ADD", "")]}
    assert value(spark, fold) == 15
    f = [("STORE", "n"), ("LOAD", "n"), ("JZ", "9"), ("LOAD", "n"), ("LOAD", "n"), ("PUSH", "1"), ("SUB", ""), ("CALL", "f"), ("JMP", "11"), ("PUSH", "1"), ("RET", ""), ("MUL", "")]
    assert value(spark, {"main": [("LOAD", "n"), ("CALL", "f")], "f": f}, {"n": 5}) == 120
    with pytest.raises(Exception, match="division by zero"):
        value(spark, {"main": [*push(1, 0), ("DIV", "")]})
    with pytest.raises(ExecError):
        validate([("LAUNCH", "")])


def test_dispatch_shares_the_stack_and_jumps_go_to_addresses(spark):
    below = {"main": [("PUSH", "1"), ("LOAD", "k"), ("DISPATCH", "0:fifty,1:two"), ("ADD", "")], "fifty": [("POP", ""), ("PUSH", "50"), ("PUSH", "1")], "two": [("PUSH", "2")]}
    assert [value(spark, below, {"k": k}) for k in (0.0, 1.0)] == [51, 3]
    gapped = {"main": [("PUSH", "7", 10), ("JMP", "40", 20), ("PUSH", "1", 30), ("RET", "", 40)]}
    assert value(spark, gapped) == 7
    for bad in ("15", "x"):
        with pytest.raises(ExecError):
            value(spark, {"main": [("PUSH", "7", 10), ("JMP", bad, 20), ("RET", "", 40)]})


def test_branches_meet_again(spark):
    # a sum of forty digits by forty forward branches: one expression, each step once
    code = [("PUSH", "0"), ("STORE", "s")]
    for k in range(40):
        at = len(code)
        code += [("LOAD", "x"), ("PUSH", str(k)), ("GT", ""), ("JZ", str(at + 8)), ("LOAD", "s"), ("PUSH", "1"), ("ADD", ""), ("STORE", "s")]
    code += [("LOAD", "s"), ("RET", "")]
    assert value(spark, {"main": code}, {"x": 7.5}) == 8
    early = [("LOAD", "x"), ("JZ", "4"), ("PUSH", "1"), ("RET", ""), ("PUSH", "2"), ("EMIT", ""), ("RET", "")]
    df = spark.createDataFrame([(0.0,), (3.0,)], "x double")
    rows = run_program(df, {"main": early}, "main", ["x"], emits="e").orderBy("x").collect()
    assert [(r["value"], r["e"]) for r in rows] == [(2, [2]), (1, [])]


LOOPS = {
    "down": [("STORE", "n"), ("LOAD", "n"), ("JZ", "9"), ("LOAD", "n"), ("EMIT", ""), ("PUSH", "1"), ("SUB", ""), ("STORE", "n"), ("JMP", "1"), ("PUSH", "0"), ("RET", "")],
    "even": [("DUP", ""), ("JZ", "6"), ("PUSH", "1"), ("SUB", ""), ("CALL", "odd"), ("RET", ""), ("POP", ""), ("PUSH", "1"), ("RET", "")],
    "odd": [("DUP", ""), ("JZ", "6"), ("PUSH", "1"), ("SUB", ""), ("CALL", "even"), ("RET", ""), ("RET", "")],
    "fib": [("STORE", "n"), ("LOAD", "n"), ("PUSH", "2"), ("LT", ""), ("JZ", "7"), ("LOAD", "n"), ("RET", ""), ("LOAD", "n"), ("PUSH", "1"), ("SUB", ""), ("CALL", "fib"), ("LOAD", "n"), ("PUSH", "2"), ("SUB", ""), ("CALL", "fib"), ("ADD", ""), ("RET", "")],
    "gcd": [("STORE", "b"), ("STORE", "a"), ("LOAD", "b"), ("JZ", "12"), ("LOAD", "b"), ("LOAD", "a"), ("LOAD", "b"), ("MOD", ""), ("STORE", "b"), ("STORE", "a"), ("JMP", "2"), ("RET", ""), ("LOAD", "a"), ("RET", "")],
    "lcm": [("STORE", "q"), ("STORE", "p"), ("LOAD", "p"), ("LOAD", "q"), ("MUL", ""), ("LOAD", "p"), ("LOAD", "q"), ("CALL", "gcd"), ("DIV", ""), ("RET", "")],
    "squares": [("STORE", "n"), ("LOAD", "n"), ("MAP", "square"), ("POP", ""), ("LOAD", "n"), ("CALL", "down"), ("RET", "")],
    "square": [("LOAD", "i"), ("LOAD", "i"), ("MUL", "")],
    "forever": [("PUSH", "1"), ("JMP", "0")],
    "deep": [("CALL", "deep"), ("RET", "")],
}


def test_loops_and_recursion_over_batches(spark):
    df = spark.createDataFrame([(float(i),) for i in range(12)], "n double")
    run = lambda name: [tuple(r) for r in call_value(df, LOOPS, name, ["n"], emits="e").orderBy("n").select("value", "e").collect()]
    assert run("down") == [(0, [float(x) for x in range(i, 0, -1)]) for i in range(12)]
    assert [v for v, _ in run("even")] == [float(i % 2 == 0) for i in range(12)]
    fib = [0, 1]
    while len(fib) < 12:
        fib.append(fib[-1] + fib[-2])
    assert [v for v, _ in run("fib")] == fib
    assert [e for _, e in run("squares")] == [[float(k * k) for k in range(i)] + [float(x) for x in range(i, 0, -1)] for i in range(12)]
    pairs = spark.createDataFrame([(float(a), float(b)) for a in range(1, 9) for b in range(1, 9)], "a double, b double")
    assert all(r["value"] == math.lcm(int(r["a"]), int(r["b"])) for r in call_value(pairs, LOOPS, "lcm", ["a", "b"]).collect())
    for name in ("forever", "deep"):
        with pytest.raises(Exception, match="too many steps|calls too deep"):
            run_program(df, LOOPS, name, []).collect()


def test_a_run_tells_its_provenance(spark):
    steps = [("FETCH", "@who|BALANCE"), ("FETCH", "rate|VALUE"), ("MUL", ""), ("OPAQUE", "model"), ("ADD", ""), ("EMIT", ""), ("RET", "")]
    g = graph(spark, [{"subject": "ann", "relation": "BALANCE", "object": "200", "source_article": "bank"}, {"subject": "rate", "relation": "VALUE", "object": "0.5", "source_article": "policy"}, *triples_of("main", steps)])
    out = execute(g.facts, "main", {"who": "ann"}, {"model": 1})
    assert (out.value, out.steps, out.outputs) == (101, 7, [101]) and out.reads == ["ann BALANCE 200 [bank]", "rate VALUE 0.5 [policy]"]
    assert out.opaque == ["model = 1.0 [OPAQUE, unverified]"] and out.trace[2] == "@2: MUL   stack=[100.0]   [program]" and len(out.trace) == 7
    for bad in ({"who": "bob"}, {"who": "ann"}):
        with pytest.raises(ExecError):
            execute(g.facts, "main", bad, None)
    assert surface({"main": steps}, "OPAQUE") == ["model"]


def test_score_flags_joins_rings(spark):
    rows = [(f"t{i}", r, str(v)) for i, (a, f) in enumerate([(900, 1), (20, 0), (700, 0)]) for r, v in (("AMOUNT", a), ("FOREIGN", f))]
    g = graph(spark, [*rows, ("policy", "LARGE", "500")])
    code = [("LOAD", "amount"), ("FETCH", "policy|LARGE"), ("GT", ""), ("LOAD", "foreign"), ("AND", ""), ("RET", "")]
    assert [r[0] for r in score_flags(g.facts, {"score": code}, "score", {"amount": "AMOUNT", "foreign": "FOREIGN"}).collect()] == ["t0"]


def test_program_reads_facts(spark):
    g = graph(spark, [("alice", "BALANCE", "70"), ("bob", "BALANCE", "-10"), ("rate", "VALUE", "2")])
    df = spark.createDataFrame([("alice",), ("bob",)], "who string")
    out = run_program(df, {"main": [("FETCH", "@who|BALANCE"), ("FETCH", "rate|VALUE"), ("MUL", "")]}, "main", [], facts=g.facts)
    assert {r["who"]: r["value"] for r in out.collect()} == {"alice": 140.0, "bob": -20.0}


def test_text(spark):
    one = lambda c: spark.range(1).select(c).head()[0]
    assert one(text.normalize_entity(F.lit("Aristotle's"))) == "Aristotle" and one(text.normalize_entity(F.lit("Alchemy Alchemy"))) == "Alchemy"
    assert one(text.strip_markup(F.lit("'''Ulm''' is {{in|{{x}}}} [[Germany|the land]].<ref>a</ref> See [[Bern]]."))) == "Ulm is the land. See Bern."
    assert [one(text.stem(F.lit(w))) for w in ("tags", "categories", "branches", "class")] == ["tag", "category", "branche", "class"]
    assert one(text.detect_intent(F.lit("How do I undo my last commit?"))) == "how-to"
    assert one(text.split_sentences(F.lit("This is a first sentence. And this is another one."))) == ["This is a first sentence.", "And this is another one."]


def test_questions_find_topics_moods_and_items(spark):
    q = spark.createDataFrame([("How do I undo my last commit?",), ("why stop",), (None,), ("hello there",)], "question string")
    rows = q.select(text.told(F.col("question")).alias("t"), text.moods(F.col("question")).alias("m")).collect()
    assert [r["t"] for r in rows] == [["commit", "undo"], [], [], []]
    assert rows[1]["m"] == ["philosophical", "reflective", "anguished", "defiant", "oratorical", "commanding"]
    items = [
        {"item_id": "rename", "topic": "branch", "intent": "how-to", "question_patterns": ["rename a branch"]},
        {"item_id": "undo", "topic": "commit", "intent": "how-to", "question_patterns": ["undo last commit", "undo my last commit"]},
        {"item_id": "near", "topic": "commit", "intent": "why", "question_patterns": ["how do i lose it"]},
    ]
    best = text.best_items(q, items, 3).collect()
    # 3 topic + 1 intent + 3 for each of undo, last, commit + 15 verbatim; 3 topic + 5 for three words in a row; 1 intent
    assert [tuple(x) for x in best[0]["items"]] == [(28.0, "undo"), (8.0, "near"), (1.0, "rename")]
    assert [tuple(x) for x in best[3]["items"]] == [(1.0, "rename"), (1.0, "undo")]


def test_utterances_score_by_theme_mood_and_freshness(spark):
    u = spark.createDataFrame([("x" * 100, ["sea", "fate"], "weary"), ("y" * 900, ["sea"], "exalted")], "text string, themes array<string>, mood string")
    words = lambda *w: F.array(*map(F.lit, w)).cast("array<string>")
    s = text.score_utterance(F.col("text"), F.col("themes"), F.col("mood"), words("sea", "fate"), words("weary"), words("y" * 900))
    assert [r[0] for r in u.select(s).collect()] == [8.0, -95.0]


def test_long_paths_keep_their_order(spark):
    g = graph(spark, [(f"n{i}", "NEXT", f"n{i + 1}") for i in range(9)] + [("n2", "ALSO", "n3"), ("n8", "ALSO", "n9")])
    far = query.find_paths(g, "n0", "n9", max_hops=9)
    assert [r[0] for r in far.collect()] == [[*range(9)], [*range(8), 10]]
    assert query.find_paths(g, "n0", "n9", max_hops=8).count() == 0
    wide = graph(spark, [("a", "R", "m1"), ("a", "R", "m2"), ("m2", "R", "z"), ("m1", "R", "z"), ("z", "R", "m1")])
    assert [r[0] for r in query.find_paths(wide, "a", "z").collect()] == [[0, 3], [0, 4], [1, 2]]


def test_graphs_come_back_from_files(spark, tmp_path):
    from factloom.sources.graphs import read_json, read_parquet, write_json, write_parquet

    g = graph(spark, [{"subject": "a", "relation": "R", "object": "b", "confidence": 0.5, "scope": "x", "seq": 3, "valid_from": "50 AD", "source_sentence_idx": 0}, ("c", "S", 'q"uote', "d", 7)], {"A": "a", "B": "b"}, {"src": 0.7})
    g = type(g)(g.facts, g.alias, g.authority, 12)
    for name, write, read in (("j", write_json, read_json), ("p", write_parquet, read_parquet)):
        write(g, f"{tmp_path}/{name}")
        back = read(spark, f"{tmp_path}/{name}")
        for one, other in ((back.facts.select(g.facts.columns), g.facts), (back.alias, g.alias), (back.authority, g.authority)):
            assert sorted(map(tuple, one.collect()), key=str) == sorted(map(tuple, other.collect()), key=str)
        assert back.n_articles == 12
    write_json(g, f"{tmp_path}/core", core_only=True)
    assert spo(read_json(spark, f"{tmp_path}/core").facts) == spo(g.facts)
    (tmp_path / "one.json").write_text('{"n_articles": 2, "alias_map": {"x": "y"},\n "triples": [{"subject": "s", "relation": "r", "object": "o", "source_article": "a", "source_sentence_idx": 4, "other": 1}]}')
    one = read_json(spark, f"{tmp_path}/one.json")
    assert one.facts.select("triple_id", "subject", "source_sentence_idx", "confidence").collect() == [(0, "s", 4, 1.0)] and one.n_articles == 2
