"""Axioms as data, compiled to rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import temporal
from factloom.operators.rules import Rule, as_input, relabel, side, transitive
from factloom.schema import Graph

FUNCTIONAL, INVERSE_FUNCTIONAL, DISJOINT, UNRESOLVED = "CONFLICT_FUNCTIONAL", "CONFLICT_INVERSE_FUNCTIONAL", "CONTRADICTION_DETECTED", "CONFLICT_UNRESOLVED"


class Ontology:
    """Axioms over classes and properties; every method returns the ontology itself."""

    def __init__(self, name: str = "ontology"):
        self.name = name
        self.classes: list[str] = []
        self.properties: list[str] = []
        self.transitive: set[str] = set()
        self.symmetric: set[str] = set()
        self.functional: set[str] = set()
        self.inverse_functional: set[str] = set()
        self.inverses: list[tuple[str, str]] = []
        self.sub_properties: list[tuple[str, str]] = []
        self.equal_properties: list[tuple[str, str]] = []
        self.sub_classes: list[tuple[str, str]] = []
        self.equal_classes: list[tuple[str, str]] = []
        self.disjoint: list[tuple[str, str]] = []
        self.domains: dict[str, str] = {}
        self.ranges: dict[str, str] = {}
        self.cardinalities: list[tuple[str, int | None, int | None, str | None]] = []
        self.expressions: list[tuple] = []

    def _pair(self, store: list, a: str, b: str, ordered: bool = True) -> Ontology:
        if (a, b) not in store and (ordered or (b, a) not in store):
            store.append((a, b))
        return self

    def declare_class(self, *names: str) -> Ontology:
        self.classes += [n for n in names if n not in self.classes]
        return self

    def declare_property(self, *names: str) -> Ontology:
        self.properties += [n for n in names if n not in self.properties]
        return self

    declare_classes, declare_properties = declare_class, declare_property

    def transitive_property(self, p: str) -> Ontology:
        self.transitive.add(p)
        return self

    def symmetric_property(self, p: str) -> Ontology:
        self.symmetric.add(p)
        return self

    def functional_property(self, p: str) -> Ontology:
        self.functional.add(p)
        return self

    def inverse_functional_property(self, p: str) -> Ontology:
        self.inverse_functional.add(p)
        return self

    def inverse_properties(self, p: str, q: str) -> Ontology:
        return self._pair(self.inverses, p, q, False)

    def sub_property_of(self, p: str, q: str) -> Ontology:
        return self._pair(self.sub_properties, p, q)

    def equivalent_properties(self, p: str, q: str) -> Ontology:
        return self._pair(self.equal_properties, p, q, False)

    def subclass_of(self, c: str, d: str) -> Ontology:
        return self._pair(self.sub_classes, c, d)

    def equivalent_classes(self, c: str, d: str) -> Ontology:
        return self._pair(self.equal_classes, c, d, False)

    def disjoint_with(self, c: str, d: str) -> Ontology:
        return self._pair(self.disjoint, c, d, False)

    def domain(self, p: str, c: str) -> Ontology:
        self.domains[p] = c
        return self

    def range(self, p: str, c: str) -> Ontology:
        self.ranges[p] = c
        return self

    def cardinality(self, p: str, min: int | None = None, max: int | None = None, exactly: int | None = None, of: str | None = None) -> Ontology:  # noqa: A002
        if exactly is not None and (min is not None or max is not None):
            raise ValueError("exactly goes with neither min nor max")
        self.cardinalities.append((p, exactly if exactly is not None else min, exactly if exactly is not None else max, of))
        return self

    def class_intersection(self, name: str, *parts: str) -> Ontology:
        self.expressions.append(("intersection", name, parts))
        return self

    def class_union(self, name: str, *parts: str) -> Ontology:
        self.expressions.append(("union", name, parts))
        return self

    def some_values(self, name: str, p: str, c: str) -> Ontology:
        self.expressions.append(("some", name, (p, c)))
        return self

    def class_complement(self, name: str, c: str) -> Ontology:
        self.expressions.append(("complement", name, (c,)))
        return self

    def all_values(self, name: str, p: str, c: str) -> Ontology:
        self.expressions.append(("all", name, (p, c)))
        return self

    def summary(self) -> str:
        return f"{self.name}: {len(self.classes)} classes, {len(self.properties)} properties, {len(compile_to_rules(self))} rules"


#: Ordinals of a span of time. Facts that hold no longer meet within spans; longer and open ones meet all of their key.
SPAN = temporal.YEAR
#: Spans that no date has, in which facts held long on one side meet the other side.
LONG_FIRST, LONG_SECOND = -(10**9), -(10**9) - 1


def functional_markers(g: Graph, p: str, inverse: bool = False, timed: bool = True) -> DataFrame:
    """One marker for each subject (inverse: object) and pair of different values that hold at one time in one scope.

    Pairs are looked for in spans of time, so a subject with many facts over the years is not compared in one task.
    Without facts held long, both sides are dealt alike and Spark shuffles them once. timed: inputs with their interval.
    """
    on, value = ("object", "subject") if inverse else ("subject", "object")
    f = g.facts.where(F.col("relation") == p)
    ends = temporal.date_ord(F.col("valid_from")), temporal.date_ord(F.col("valid_to"))
    any_long = bool(f.select((ends[1] - ends[0]).between(0, SPAN).alias("short")).where("short is not true").take(1))

    def dealt(x: str, short: Column, long: Column) -> DataFrame:
        low, high = F.col(f"{x}low"), F.col(f"{x}high")
        # ordinals are worked out once a fact, not once a pair
        dated = side(f, x).select("*", temporal.date_ord(F.col(f"{x}valid_from")).alias(f"{x}low"), temporal.date_ord(F.col(f"{x}valid_to")).alias(f"{x}high"))
        held = F.array_distinct(F.concat(F.array(F.floor(low / SPAN), F.floor(high / SPAN)), short))
        spans = F.when((high - low).between(0, SPAN), held).otherwise(long) if any_long else held
        return dated.withColumn(f"{x}span", F.explode(spans))

    of = lambda *spans: F.array(*(F.lit(k).cast("long") for k in spans))
    none = F.array().cast("array<bigint>")
    a = dealt("a_", of(LONG_SECOND) if any_long else none, of(LONG_FIRST))
    b = dealt("b_", of(LONG_FIRST) if any_long else none, of(LONG_FIRST, LONG_SECOND))
    near = (F.col("a_triple_id") < F.col("b_triple_id")) & (F.col(f"a_{value}") != F.col(f"b_{value}"))
    near &= F.coalesce(F.col("a_scope") == F.col("b_scope"), F.lit(True))
    near &= F.col("a_span").isin(LONG_FIRST, LONG_SECOND) | (F.col("a_span") == F.floor(F.greatest("a_low", "b_low") / SPAN))  # once a pair
    near &= temporal.strictly_overlaps(*(F.col(c) for c in ("a_low", "a_high", "b_low", "b_high")))
    pairs = a.join(b, (F.col(f"a_{on}") == F.col(f"b_{on}")) & (F.col("a_span") == F.col("b_span"))).where(near)
    text = F.concat(F.lit(f"{p}:"), F.least(f"a_{value}", f"b_{value}"), F.lit("|"), F.greatest(f"a_{value}", f"b_{value}"))
    return pairs.select(F.col(f"a_{on}").alias("subject"), F.lit(INVERSE_FUNCTIONAL if inverse else FUNCTIONAL).alias("relation"), text.alias("object"), F.array(as_input("a_", timed), as_input("b_", timed)).alias("inputs"))


def untimed(df: DataFrame) -> DataFrame:
    """Markers say that facts clash, not when."""
    return df.withColumn("inputs", F.transform("inputs", lambda i: F.struct(i["id"].alias("id"), i["confidence"].alias("confidence"), F.lit(None).cast("string").alias("valid_from"), F.lit(None).cast("string").alias("valid_to"))))


def disjoint_markers(g: Graph, c: str, d: str) -> DataFrame:
    one = lambda k, p: g.facts.where((F.col("relation") == "IS_A") & (F.col("object") == k)).groupBy("subject").agg(F.min_by(as_input(), "triple_id").alias(p))
    both = one(c, "x").join(one(d, "y"), "subject")
    return both.select("subject", F.lit(DISJOINT).alias("relation"), F.lit(f"{c}|{d}").alias("object"), F.array("x", "y").alias("inputs"))


def compile_to_rules(ont: Ontology) -> list[Rule]:
    """Rules in a fixed order, which decides between proofs of one fact."""
    rules = [transitive(p) for p in sorted(ont.transitive)]
    rules += [relabel(f"owl:symmetricProperty({p})", [p], p, swap=True, skip_self=True) for p in sorted(ont.symmetric)]
    rules += [Rule(f"owl:functionalProperty({p})", lambda g, p=p: functional_markers(g, p, timed=False), 0, (p,), rests=(p,), makes=(FUNCTIONAL,)) for p in sorted(ont.functional)]
    rules += [Rule(f"owl:inverseFunctionalProperty({p})", lambda g, p=p: functional_markers(g, p, True, timed=False), 0, (p,), rests=(p,), makes=(INVERSE_FUNCTIONAL,)) for p in sorted(ont.inverse_functional)]
    for p, q in ont.inverses:
        rules += [relabel(f"owl:inverseOf({p},{q})", [p], q, swap=True), relabel(f"owl:inverseOf({q},{p})", [q], p, swap=True)]
    rules += [relabel(f"rdfs:subPropertyOf({p},{q})", [p], q) for p, q in ont.sub_properties]
    for p, q in ont.equal_properties:
        rules += [relabel(f"owl:equivalentProperty({a},{b})", [a], b) for a, b in ((p, q), (q, p))]
    is_a = lambda a, b, kind: relabel(f"{kind}({a},{b})", ["IS_A"], "IS_A", where=lambda: F.col("object") == a, to=b)
    rules += [is_a(c, d, "rdfs:subClassOf") for c, d in ont.sub_classes]
    for c, d in ont.equal_classes:
        rules += [is_a(c, d, "owl:equivalentClass"), is_a(d, c, "owl:equivalentClass")]
    rules += [Rule(f"owl:disjointWith({c},{d})", lambda g, c=c, d=d: untimed(disjoint_markers(g, c, d)), 0, ("IS_A",), rests=("IS_A",), makes=(DISJOINT,)) for c, d in ont.disjoint]
    rules += [relabel(f"rdfs:domain({p},{c})", [p], "IS_A", to=c) for p, c in sorted(ont.domains.items())]
    rules += [relabel(f"rdfs:range({p},{c})", [p], "IS_A", swap=True, to=c) for p, c in sorted(ont.ranges.items())]
    return rules


def cardinality_violations(facts: DataFrame, ont: Ontology) -> DataFrame:
    """subject, property, n of subjects with more, or (having some) fewer, different objects than declared."""
    out = None
    for p, low, high, of in ont.cardinalities:
        f = facts.where(F.col("relation") == p).select("subject", "object")
        if of:
            f = f.join(facts.where((F.col("relation") == "IS_A") & (F.col("object") == of)).select(F.col("subject").alias("object")).distinct(), "object", "left_semi")
        n = f.groupBy("subject").agg(F.count_distinct("object").alias("n"))
        bad = n.where((F.col("n") > F.lit(high if high is not None else 2**31 - 1)) | (F.col("n") < F.lit(low or 0))).select("subject", F.lit(p).alias("property"), "n")
        out = bad if out is None else out.union(bad)
    return out if out is not None else facts.sparkSession.createDataFrame([], "subject string, property string, n long")


def memberships(facts: DataFrame, ont: Ontology) -> DataFrame:
    """subject, class that intersections, unions and existential restrictions add to what IS_A says.

    Complements and universal restrictions add no member, since what is not said may still hold; they are checked
    by `inconsistencies`.
    """
    is_a = facts.where(F.col("relation") == "IS_A").select("subject", F.col("object").alias("class")).distinct()
    out = None
    for kind, name, parts in ont.expressions:
        if kind in ("complement", "all"):
            continue
        if kind == "some":
            p, c = parts
            of = is_a.where(F.col("class") == c).select(F.col("subject").alias("object"))
            found = facts.where(F.col("relation") == p).join(of, "object", "left_semi").select("subject").distinct()
        else:
            hit = is_a.where(F.col("class").isin(list(parts))).groupBy("subject").agg(F.count("*").alias("n"))
            found = hit.where(F.col("n") >= (len(set(parts)) if kind == "intersection" else 1)).select("subject")
        found = found.withColumn("class", F.lit(name))
        out = found if out is None else out.union(found)
    return out.distinct().join(is_a, ["subject", "class"], "left_anti") if out is not None else is_a.limit(0)


def inconsistencies(facts: DataFrame, ont: Ontology) -> DataFrame:
    """subject, why: members of two disjoint classes, of a class and its complement, with a value outside a universal
    restriction's class (one disjoint with it), or with more values than a cardinality allows. Names are unique."""
    spark = facts.sparkSession
    is_a = facts.where(F.col("relation") == "IS_A").select("subject", F.col("object").alias("class")).distinct()
    apart = [*ont.disjoint, *((name, parts[0]) for kind, name, parts in ont.expressions if kind == "complement")]
    of = lambda c: is_a.where(F.col("class") == c).select("subject")
    out = [of(c).join(of(d), "subject", "left_semi").withColumn("why", F.lit(f"disjoint:{c}|{d}")) for c, d in apart]
    for kind, name, parts in ont.expressions:
        if kind == "all":
            p, c = parts
            outside = [d if c == e else e for e, d in [*apart, *((b, a) for a, b in apart)] if c in (e, d)]
            wrong = is_a.where(F.col("class").isin(sorted(set(outside)))).select(F.col("subject").alias("object"))
            bad = facts.where(F.col("relation") == p).join(wrong, "object", "left_semi").select("subject")
            out.append(bad.join(of(name), "subject", "left_semi").withColumn("why", F.lit(f"all:{p}|{c}")))
    more = cardinality_violations(facts, ont)
    highs = [(p, high) for p, _, high, _ in ont.cardinalities if high is not None]
    for p, high in highs:
        out.append(more.where((F.col("property") == p) & (F.col("n") > high)).select("subject", F.lit(f"cardinality:{p}").alias("why")))
    every = spark.createDataFrame([], "subject string, why string")
    for x in out:
        every = every.unionByName(x)
    return every.distinct()


def enrich(g: Graph, ont: Ontology, max_rounds: int = 20) -> tuple[Graph, dict]:
    """The graph with memberships by class expressions and subclasses, source `(owl)`, and what was found.

    An inconsistent graph gains one marker (the ontology, CONTRADICTION_DETECTED, OWL_INCONSISTENT) and nothing else.
    """
    from factloom.operators.rules import fixpoint
    from factloom.plans.storage import written
    from factloom.schema import complete, numbered

    axioms = Ontology(ont.name)
    axioms.sub_classes, axioms.equal_classes, axioms.domains, axioms.ranges = ont.sub_classes, ont.equal_classes, ont.domains, ont.ranges
    facts = written(g.facts)
    known = facts.where("relation = 'IS_A'").select("subject", "object").distinct()
    here = g.over(facts)
    for _ in range(max_rounds):
        here, _, _ = fixpoint(here, compile_to_rules(axioms))
        more = written(memberships(here.facts, ont).select("subject", F.lit("IS_A").alias("relation"), F.col("class").alias("object")))
        if not more.take(1):
            break
        top = here.facts.agg(F.max("triple_id")).head()[0]
        here = here.over(here.facts.unionByName(complete(numbered(more, "subject", "object", start=(top or 0) + 1)).select(*here.facts.columns)))
    wrong = inconsistencies(here.facts, ont)
    top = facts.agg(F.max("triple_id")).head()[0] or 0
    if wrong.take(1):
        marker = g.spark.createDataFrame([(top + 1, ont.name, DISJOINT, "OWL_INCONSISTENT", "(owl)")], "triple_id long, subject string, relation string, object string, source_article string")
        return g.over(facts.unionByName(complete(marker).select(*facts.columns))), {"consistent": False, "n_inferred": 0, "why": [tuple(r) for r in wrong.limit(20).collect()]}
    new = here.facts.where("relation = 'IS_A' AND object <> 'Thing'").select("subject", "relation", "object").distinct().join(known, ["subject", "object"], "left_anti")
    new = written(complete(numbered(new.withColumn("source_article", F.lit("(owl)")), "subject", "object", start=top + 1)))
    return g.over(facts.unionByName(new.select(*facts.columns))), {"consistent": True, "n_inferred": new.count(), "why": []}


def enrich_rule(ont: Ontology, stratum: int = 5) -> Rule:
    """`enrich` as a rule of a late stratum; a graph it cannot read adds nothing."""

    def plan(g: Graph) -> DataFrame:
        return memberships(g.facts, ont).select("subject", F.lit("IS_A").alias("relation"), F.col("class").alias("object"), F.array().alias("inputs"))

    return Rule(f"owl:classExpressions({ont.name})", plan, stratum)
