"""Rules as plan builders, and their stratified fixpoint.

A rule maps the current graph to candidates: subject, relation, object, inputs. All rules of a stratum are one
union; a round is one plan (candidates with an input of the round before, confidence and interval of their inputs,
first candidate of each fact, anti join with what is known), written to the shared folder so that lineage does not grow.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import confidence as conf
from factloom.functions import temporal
from factloom.operators.query import bins
from factloom.plans.storage import parts, written
from factloom.schema import DERIVED, Graph, canonical, numbered

INPUT = "struct<id:bigint,confidence:double,valid_from:string,valid_to:string>"
CANDIDATE = ["subject", "relation", "object", "inputs"]


class FixpointDivergence(RuntimeError):
    """Rules still made facts after the last round allowed."""


@dataclass(frozen=True)
class Round:
    """The facts that the round before made, all facts before those, and the relations of the former."""

    fresh: DataFrame
    old: DataFrame
    relations: frozenset[str]


@dataclass(frozen=True)
class Rule:
    name: str
    plan: Callable[[Graph], DataFrame]
    stratum: int = 0
    #: Relations it reads; a rule none of whose relations exist is not planned. Empty: always planned.
    reads: tuple[str, ...] = field(default=())
    #: The candidates with an input among the facts of the round before, from the graph and those; None: plan all anew.
    delta: Callable[[Graph, Round], DataFrame] | None = None
    #: A new candidate has a new input of one of these relations, or there is none. Empty: not told.
    rests: tuple[str, ...] = field(default=())
    #: All relations of its candidates. Empty: not told.
    makes: tuple[str, ...] = field(default=())


def as_input(prefix: str = "", timed: bool = True) -> Column:
    end = lambda c: (F.col(f"{prefix}{c}") if timed else F.lit(None).cast("string")).alias(c)
    return F.struct(F.col(f"{prefix}triple_id").alias("id"), F.col(f"{prefix}confidence").alias("confidence"), end("valid_from"), end("valid_to"))


def side(facts: DataFrame, prefix: str) -> DataFrame:
    return facts.select(*(F.col(c).alias(prefix + c) for c in ("triple_id", "subject", "object", "scope", "confidence", "valid_from", "valid_to")))


def compose(name: str, first: str, second: str, out: str, guard: bool = True, cite_both: bool = True, stratum: int = 0) -> Rule:
    """x first y, y second z: x out z, the middle by its canonical name; guard: not back to x itself."""

    def pairs(g: Graph, left: DataFrame, right: DataFrame) -> DataFrame:
        a = canonical(side(left.where(F.col("relation") == first), "a_"), "a_object", g.alias, "a_middle")
        b = side(right.where(F.col("relation") == second), "b_")
        both = a.join(b, F.col("a_middle") == F.col("b_subject"))
        both = both.where(F.col("b_object") != F.col("a_subject")) if guard else both
        cited = F.array(as_input("a_"), as_input("b_")) if cite_both else F.array(as_input("a_"))
        return both.select(F.col("a_subject").alias("subject"), F.lit(out).alias("relation"), F.col("b_object").alias("object"), cited.alias("inputs"))

    def delta(g: Graph, last: Round) -> DataFrame:
        """Pairs of two new facts are made once; a side that has nothing new is not planned."""
        if second not in last.relations:
            return pairs(g, last.fresh, g.facts)
        right = pairs(g, last.old, last.fresh)
        return pairs(g, last.fresh, g.facts).unionByName(right) if first in last.relations else right

    return Rule(name, lambda g: pairs(g, g.facts, g.facts), stratum, (first,), delta, (first, second), (out,))


def transitive(prop: str, guard: bool = True, cite_both: bool = True, name: str | None = None) -> Rule:
    return compose(name or f"owl:transitiveProperty({prop})", prop, prop, prop, guard, cite_both)


def relabel(name: str, relations: list[str], out: str, swap: bool = False, skip_self: bool = False, where: Callable[[], Column] | None = None, to: str | None = None, stratum: int = 0) -> Rule:
    """Facts of some relations under another one: swapped, filtered or with a fixed object if asked for."""

    def plan(g: Graph) -> DataFrame:
        f = g.facts.where(F.col("relation").isin(relations))
        f = f.where(where()) if where else f
        f = f.where(F.col("subject") != F.col("object")) if skip_self else f
        s, o = ("object", "subject") if swap else ("subject", "object")
        return f.select(F.col(s).alias("subject"), F.lit(out).alias("relation"), (F.lit(to) if to is not None else F.col(o)).alias("object"), F.array(as_input()).alias("inputs"))

    return Rule(name, plan, stratum, tuple(relations), lambda g, last: plan(g.over(last.fresh)), tuple(relations), (out,))


def disjunctive(name: str, relations: list[str], out: str, stratum: int = 0) -> Rule:
    return relabel(name, relations, out, skip_self=True, stratum=stratum)


def at_least(name: str, relation: str, n: int, out: tuple[str, str]) -> Rule:
    """Subjects with n or more different objects of a relation."""

    def plan(g: Graph) -> DataFrame:
        found = g.facts.where(F.col("relation") == relation).groupBy("subject").agg(F.count_distinct("object").alias("n"), F.sort_array(F.collect_list(as_input())).alias("inputs"))
        return found.where(F.col("n") >= n).select("subject", F.lit(out[0]).alias("relation"), F.lit(out[1]).alias("object"), "inputs")

    return Rule(name, plan, 0, (relation,), rests=(relation,), makes=(out[0],))


def lacking(name: str, relation: str, role: str, without: str, out: tuple[str, str], stratum: int = 1) -> Rule:
    """Entities in a role of a relation that are subject of no fact of ``without`` (negation as failure)."""

    def plan(g: Graph) -> DataFrame:
        f = canonical(g.facts.where(F.col("relation") == relation), role, g.alias, "entity")
        first = f.groupBy("entity").agg(F.min_by(as_input(), "triple_id").alias("input"))
        none = g.facts.where(F.col("relation") == without).select(F.col("subject").alias("entity"))
        return first.join(none, "entity", "left_anti").select(F.col("entity").alias("subject"), F.lit(out[0]).alias("relation"), F.lit(out[1]).alias("object"), F.array("input").alias("inputs"))

    return Rule(name, plan, stratum, (relation,), rests=(relation,), makes=(out[0],))


def year(text: Column) -> Column:
    """A signed year: `N BC`, `N AD`, or the 3 or 4 digits that a text begins with."""
    bc, ad, plain = (F.regexp_extract(text, p, 1) for p in (r"(?i)^(\d+)\s*BC", r"(?i)^(\d+)\s*AD", r"^(\d{3,4})"))
    return F.when(bc != "", -bc.cast("long")).when(ad != "", ad.cast("long")).when(plain != "", plain.cast("long"))


def contemporaries(born: str = "BORN_DATE", within: int = 50, out: str = "CONTEMPORARY_OF") -> Rule:
    """Earlier to later of two births at most some years apart: a band join by bins, as of `query.band_pairs`."""

    def plan(g: Graph) -> DataFrame:
        f = g.facts.where(F.col("relation") == born).withColumn("y", year(F.col("object"))).where("y is not null")
        deal = bins(within)
        dealt = lambda x, on: f.select(F.col("y").alias(f"{x}y"), F.explode(deal(F.col("y"), on)).alias("bin"), *(F.col(c).alias(x + c) for c in ("triple_id", "subject", "confidence", "valid_from", "valid_to")))
        a, b = dealt("a_", within), dealt("b_", 0)
        near = (F.col("b_y") - F.col("a_y")).between(0, within) & ((F.col("b_y") > F.col("a_y")) | (F.col("b_triple_id") > F.col("a_triple_id"))) & (F.col("a_subject") != F.col("b_subject"))
        return a.join(b, "bin").where(near).select(F.col("a_subject").alias("subject"), F.lit(out).alias("relation"), F.col("b_subject").alias("object"), F.array(as_input("a_"), as_input("b_")).alias("inputs"))

    return Rule("contemporary", plan, 0, (born,), rests=(born,), makes=(out,))


def era(text: Column) -> Column:
    y, bc = year(text), text.rlike(r"(?i)^\d+\s*BC")
    # Fixed labels.
    return (
        F.when(bc & (y <= -800), "ancient_archaic_era")
        .when(bc & (y <= -400), "ancient_classical_era")
        .when(bc, "ancient_hellenistic_era")
        .when(y < 500, "late_antiquity")
        .when(y < 1500, "medieval")
        .when(y < 1800, "early_modern")
        .when(y < 1900, "nineteenth_century")
        .when(y < 2000, "twentieth_century")
        .when(y.isNotNull(), "twenty_first_century")
    )


def lived_for(born: str = "BORN_DATE", died: str = "DIED_DATE", out: str = "LIVED_FOR") -> Rule:
    """Years between a subject's last birth and last death on record, 1 to 120."""

    def plan(g: Graph) -> DataFrame:
        last = lambda r, p: g.facts.where(F.col("relation") == r).groupBy("subject").agg(F.max_by(F.struct("object", as_input().alias("i")), "triple_id").alias(p))
        both = last(born, "b").join(last(died, "d"), "subject").withColumn("n", year(F.col("d.object")) - year(F.col("b.object"))).where("n between 1 and 120")
        return both.select("subject", F.lit(out).alias("relation"), F.format_string("%d years", "n").alias("object"), F.array("b.i", "d.i").alias("inputs"))

    return Rule("lived_for", plan, 0, (born,), rests=(born, died), makes=(out,))


def standard_rules() -> list[Rule]:
    return [
        compose("intellectual_descent", "TUTORED_BY", "TUTORED_BY", "INTELLECTUAL_DESCENDANT_OF"),
        compose("taught_conqueror", "TUTORED", "CONQUERED", "TAUGHT_CONQUEROR_OF", guard=False),
        compose("grandchild", "CHILD_OF", "CHILD_OF", "GRANDCHILD_OF"),
        Rule("lived_in", lambda g: g.facts.where(F.col("relation") == "BORN_DATE").select("subject", F.lit("LIVED_IN").alias("relation"), era(F.col("object")).alias("object"), F.array(as_input()).alias("inputs")).where("object is not null"), 0, ("BORN_DATE",), rests=("BORN_DATE",), makes=("LIVED_IN",)),
        lived_for(),
        at_least("multi_conqueror", "CONQUERED", 2, ("IS_A", "MULTI_CONQUEROR")),
        contemporaries(),
        compose("descent_closure", "INTELLECTUAL_DESCENDANT_OF", "INTELLECTUAL_DESCENDANT_OF", "INTELLECTUAL_DESCENDANT_OF"),
        compose("descent_step", "TUTORED_BY", "INTELLECTUAL_DESCENDANT_OF", "INTELLECTUAL_DESCENDANT_OF"),
        disjunctive("influenced_by", ["TUTORED_BY", "INTELLECTUAL_DESCENDANT_OF"], "INFLUENCED_BY"),
        lacking("family_progenitor", "CHILD_OF", "object", "CHILD_OF", ("IS_A", "FAMILY_PROGENITOR")),
    ]


def candidates(g: Graph, rules: list[Rule], mode: str | Callable, with_time: bool, with_confidence: bool, last: Round | None = None) -> DataFrame:
    """All rules' candidates, of rules that can tell only those with an input that the last round made, if one is given."""
    out = None
    for n, rule in enumerate(rules):
        c = (rule.plan(g) if last is None or rule.delta is None else rule.delta(g, last)).select(*CANDIDATE[:3], F.col("inputs").cast(f"array<{INPUT}>").alias("inputs"), F.lit(n).alias("place"))
        out = c if out is None else out.unionByName(c)
    low, high, empty = temporal.intersection(F.transform("inputs", lambda i: i["valid_from"]), F.transform("inputs", lambda i: i["valid_to"]))
    none = F.lit(None).cast("string")
    out = out.withColumn("valid_from", low if with_time else none).withColumn("valid_to", high if with_time else none)
    out = out.where(~empty) if with_time else out
    derived = F.when(F.size("inputs") > 0, F.least(F.lit(1.0), conf.derive_confidence(F.transform("inputs", lambda i: i["confidence"]), mode))).otherwise(1.0)
    return out.withColumn("confidence", derived if with_confidence else F.lit(1.0)).withColumn("ids", F.transform("inputs", lambda i: i["id"])).drop("inputs")


def fixpoint(g: Graph, rules: list[Rule] | None = None, max_iter: int = 20, confidence_mode: str | Callable = "product", propagate_confidence: bool = True, propagate_temporal: bool = True) -> tuple[Graph, DataFrame, dict]:
    """The graph with all derived facts, the derivations, and counts of each stratum's rounds.

    Facts are told apart by (subject, relation, object); the first candidate by rule and inputs gives a fact its
    confidence, interval and proof. Rules see the facts of the round before. Raises FixpointDivergence if a
    stratum still makes facts in its last round.
    """
    rules = standard_rules() if rules is None else rules
    facts, proofs, stats = written(g.facts), [], {"per_stratum": {}, "total_iters": 0}
    known = {r[0] for r in facts.select("relation").distinct().collect()}  # as many as there are relations
    for stratum in sorted({r.stratum for r in rules}):
        mine, made, last = [r for r in rules if r.stratum == stratum], [], None
        while mine:
            live = [r for r in mine if (not r.reads or known & set(r.reads)) and (last is None or not r.rests or last.relations & set(r.rests))]
            if not live:
                break
            # a fact that is new has an input that was new; what rests on older facts alone was made before
            new = candidates(g.over(facts), live, confidence_mode, propagate_temporal, propagate_confidence, last)
            key = ["subject", "relation", "object"]
            first = new.groupBy(*key).agg(F.min(F.struct("place", "ids", "confidence", "valid_from", "valid_to")).alias("c"))
            told = facts if any(not r.makes for r in live) else facts.where(F.col("relation").isin(sorted({m for r in live for m in r.makes})))
            first = first.join(told.select(*key), key, "left_anti").select(*key, "c.*")
            top = facts.agg(F.max("triple_id")).first()[0]
            fresh = written(numbered(first, "place", "ids", *key, start=0 if top is None else top + 1))
            n = fresh.count()
            stats["total_iters"] += n > 0
            if not n:
                break
            made.append(n)
            if len(made) >= max_iter:
                raise FixpointDivergence(f"stratum {stratum} did not converge in {max_iter} rounds")
            shaped = fresh.select("triple_id", *key, F.lit(DERIVED).alias("source_article"), F.lit(-1).alias("source_sentence_idx"), "valid_from", "valid_to", "confidence", F.lit(None).cast("string").alias("scope"), F.lit(None).cast("int").alias("seq"))
            relations = frozenset(r[0] for r in fresh.select("relation").distinct().collect())
            last, known = Round(shaped.select(*facts.columns), facts, relations), known | relations
            facts = facts.unionByName(last.fresh)
            rule_name = F.element_at(F.array(*(F.lit(r.name) for r in live)), F.col("place") + 1)
            proofs.append(fresh.select("triple_id", *key, rule_name.alias("rule_name"), F.col("ids").alias("inputs")))
        stats["per_stratum"][stratum] = made
    derivations = None
    for p in proofs:
        derivations = p if derivations is None else derivations.unionByName(p)
    if derivations is None:
        derivations = g.spark.createDataFrame([], "triple_id long, subject string, relation string, object string, rule_name string, inputs array<bigint>")
    return g.over(facts), derivations, stats


def why(derivations: DataFrame, subject: str, relation: str, object_: str) -> DataFrame:
    return derivations.where((F.col("subject") == subject) & (F.col("relation") == relation) & (F.col("object") == object_))


def trace_sources(facts: DataFrame, derivations: DataFrame, max_depth: int = 50) -> DataFrame:
    """triple_id, sources (`source#sentence`, sorted) of the base facts that each derived fact rests on."""
    proof = written(derivations.select("triple_id", "inputs"))
    at = written(proof.select("triple_id", F.explode("inputs").alias("input")).distinct())
    base = at.join(proof.select(F.col("triple_id").alias("input")), "input", "left_anti")
    for _ in range(max_depth):
        deeper = at.join(proof.select(F.col("triple_id").alias("input"), "inputs"), "input").select("triple_id", F.explode("inputs").alias("input")).distinct()
        at = written(deeper)
        if not at.take(1):
            break
        base = base.union(at.join(proof.select(F.col("triple_id").alias("input")), "input", "left_anti").select("input", "triple_id"))
    told = facts.select(F.col("triple_id").alias("input"), F.concat_ws("#", "source_article", F.col("source_sentence_idx").cast("string")).alias("source"))
    return base.join(told, "input").groupBy("triple_id").agg(F.array_sort(F.collect_set("source")).alias("sources"))


def closure(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Transitive closure of edges (a, b), self pairs of cycles included, by doubling: new pairs join all pairs.

    Pairs are dealt to as many tasks as their number asks for: in bytes they are too small for Spark to tell.
    """
    every = written(edges.select("a", "b").distinct())
    fresh, old = every, None
    for _ in range(max_rounds):
        n = parts(every)
        to = lambda df: df.select("a", F.col("b").alias("m")).repartition(n, "m")
        on = lambda df: df.select(F.col("a").alias("m"), "b").repartition(n, "m")
        found = to(fresh).join(on(every), "m").select("a", "b")
        if old is not None:  # pairs of two new ones are made once
            found = found.union(to(old).join(on(fresh), "m").select("a", "b"))
        fresh = written(found.repartition(2 * n, "a", "b").distinct().join(every.repartition(2 * n, "a", "b"), ["a", "b"], "left_anti"))
        if not fresh.take(1):
            return every
        old, every = every, every.union(fresh)  # tables of one round each, none written again
    raise FixpointDivergence(f"closure did not converge in {max_rounds} rounds")
