"""Ontologies and rules of the domains that the engine is used for: utterances, items, bodies, lives, pumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import conflict
from factloom.operators.ontology import Ontology
from factloom.operators.reach import exposed, group_pairs
from factloom.operators.rules import Rule, as_input, compose, disjunctive, lacking, relabel, standard_rules, trace_sources
from factloom.schema import Graph

# Fixed sets of speech acts, moods and subtopics that classify.
CONFRONTATIONAL = ["oath", "command", "declaration", "curse"]
INTROSPECTIVE = ["melancholy", "anguished", "reflective", "philosophical", "contemplative", "bitter"]
RECOVERY = ["undo", "recover", "revert"]


def utterances() -> Ontology:
    out = Ontology("utterances").symmetric_property("CO_OCCURS_WITH").sub_property_of("CO_OCCURS_WITH", "THEMATICALLY_REACHES").transitive_property("THEMATICALLY_REACHES")
    for p in ("ADDRESSED_TO", "IS_SPEECH_ACT", "HAS_MOOD"):
        out.functional_property(p)
    return out


def items() -> Ontology:
    out = Ontology("items").sub_property_of("RELATED_TO", "REACHABLE_FROM").transitive_property("REACHABLE_FROM")
    for p in ("HAS_TOPIC", "HAS_SUBTOPIC", "HAS_INTENT"):
        out.functional_property(p)
    return out


def astronomy() -> Ontology:
    out = Ontology("astronomical")
    for p in ("MASS_KG", "RADIUS_KM", "ORBITAL_PERIOD_DAYS", "DISTANCE_FROM_SUN_AU", "DISTANCE_LIGHT_YEARS", "DISCOVERY_DATE", "IS_A"):
        out.functional_property(p)
    for c, d in (("Planet", "CelestialBody"), ("DwarfPlanet", "CelestialBody"), ("Star", "CelestialBody"), ("Galaxy", "CelestialBody"), ("InnerPlanet", "Planet"), ("OuterPlanet", "Planet")):
        out.subclass_of(c, d)
    return out


def biography() -> Ontology:
    out = Ontology("biographical")
    for p in ("BORN_DATE", "DIED_DATE", "BORN_IN", "DIED_IN"):
        out.functional_property(p)
    out.inverse_properties("TUTORED", "TUTORED_BY").symmetric_property("CONTEMPORARY_OF").symmetric_property("MARRIED").transitive_property("INTELLECTUAL_DESCENDANT_OF")
    for c, d in (("Philosopher", "Person"), ("Conqueror", "Person"), ("Ruler", "Person"), ("MULTI_CONQUEROR", "Conqueror"), ("FAMILY_PROGENITOR", "Person")):
        out.subclass_of(c, d)
    return out.domain("CONQUERED", "Conqueror").range("CONQUERED", "Place").domain("FOUNDED", "Person")


def lives() -> Ontology:
    """The smaller ontology of lives, without properties that can clash."""
    out = Ontology("biographical").transitive_property("INTELLECTUAL_DESCENDANT_OF").inverse_properties("TUTORED", "TUTORED_BY")
    for c, d in (("MULTI_CONQUEROR", "CONQUEROR"), ("CONQUEROR", "Person"), ("FAMILY_PROGENITOR", "Person")):
        out.subclass_of(c, d)
    return out.domain("CONQUERED", "Person").range("CONQUERED", "Place")


def pumps() -> Ontology:
    out = Ontology().declare_classes("CentrifugalPump", "PositiveDisplacementPump", "RotodynamicMachine", "PositiveDisplacementMachine", "InService", "Decommissioned")
    out.subclass_of("CentrifugalPump", "RotodynamicMachine").subclass_of("PositiveDisplacementPump", "PositiveDisplacementMachine")
    return out.disjoint_with("RotodynamicMachine", "PositiveDisplacementMachine").disjoint_with("InService", "Decommissioned").functional_property("RATED_FLOW_GPM")


def co_occurrence(relation: str = "HAS_THEME", out: str = "CO_OCCURS_WITH") -> Rule:
    """Objects (lesser first) that one subject has by the relation; the first pair of facts is the proof."""

    def plan(g: Graph) -> DataFrame:
        f = g.facts.where(F.col("relation") == relation).select("subject", "object", as_input().alias("i"))
        a, b = f.select("subject", F.col("object").alias("low"), F.col("i").alias("x")), f.select("subject", F.col("object").alias("high"), F.col("i").alias("y"))
        both = a.join(b, "subject").where("low < high")
        return both.select(F.col("low").alias("subject"), F.lit(out).alias("relation"), F.col("high").alias("object"), F.array("x", "y").alias("inputs"))

    return Rule("theme_co_occurrence", plan, 0, (relation,))


def classify(name: str, relation: str, values: list[str], to: str) -> Rule:
    return relabel(name, [relation], "IS", where=lambda: F.col("object").isin(values), to=to)


def isolated_theme() -> Rule:
    """Themes that are the subject of no co-occurrence; nothing is cited."""

    def plan(g: Graph) -> DataFrame:
        themes = g.facts.where("relation = 'HAS_THEME'").select(F.col("object").alias("subject")).distinct()
        found = themes.join(g.facts.where("relation = 'CO_OCCURS_WITH'").select("subject"), "subject", "left_anti")
        return found.select("subject", F.lit("IS").alias("relation"), F.lit("ISOLATED_THEME").alias("object"), F.array().alias("inputs"))

    return Rule("isolated_theme", plan, 1)


def peaceful_addressee() -> Rule:
    """Addressees to whom no confrontational utterance goes."""

    def plan(g: Graph) -> DataFrame:
        to = g.facts.where("relation = 'ADDRESSED_TO'").select("subject", F.col("object").alias("who"))
        harsh = g.facts.where("relation = 'IS' AND object = 'CONFRONTATIONAL_UTTERANCE'").select("subject")
        found = to.select("who").distinct().join(to.join(harsh, "subject", "left_semi").select("who"), "who", "left_anti")
        return found.select(F.col("who").alias("subject"), F.lit("IS").alias("relation"), F.lit("PEACEFUL_ADDRESSEE").alias("object"), F.array().alias("inputs"))

    return Rule("peaceful_addressee", plan, 1)


def utterance_rules() -> list[Rule]:
    return [
        co_occurrence(),
        disjunctive("speech_label", ["IS_SPEECH_ACT", "HAS_MOOD"], "HAS_SPEECH_LABEL"),
        classify("confrontational", "IS_SPEECH_ACT", CONFRONTATIONAL, "CONFRONTATIONAL_UTTERANCE"),
        classify("introspective", "HAS_MOOD", INTROSPECTIVE, "INTROSPECTIVE_UTTERANCE"),
        isolated_theme(),
        peaceful_addressee(),
    ]


def item_rules() -> list[Rule]:
    return [
        disjunctive("needs_care", ["HAS_CAUTION", "USES_DESTRUCTIVE_COMMAND"], "NEEDS_OPERATOR_ATTENTION"),
        classify("recovery_operation", "HAS_SUBTOPIC", RECOVERY, "RECOVERY_OPERATION"),
        lacking("safe_to_automate", "HAS_COMMANDS", "subject", "NEEDS_OPERATOR_ATTENTION", ("IS", "SAFE_TO_AUTOMATE")),
    ]


def precedence(relation: str = "PRECEDES") -> Rule:
    """Transitive without a guard: a fact of something to itself shows a cycle."""
    return compose("precedes_transitive", relation, relation, relation, guard=False, cite_both=False)


def linked(relation: str) -> Rule:
    """Transitive, but not back to itself, citing the first fact."""
    return compose(f"transitive_{relation.lower()}", relation, relation, relation, cite_both=False)


def colleagues(relation: str = "IN_DEPARTMENT", out: str = "COLLEAGUE_OF") -> Rule:
    def plan(g: Graph) -> DataFrame:
        return group_pairs(g.facts, relation, out).withColumn("inputs", F.array())

    return Rule("colleagues", plan, 0, (relation,))


def compliance_risk() -> Rule:
    """A black box that a handler of personal data depends on."""

    def plan(g: Graph) -> DataFrame:
        risk = exposed(g.facts, "HANDLES_PII", "OPAQUE_DEP").withColumnRenamed("object", "box")
        cited = g.facts.where("relation = 'OPAQUE_DEP'").groupBy("subject", F.col("object").alias("box")).agg(F.min_by(as_input(), "triple_id").alias("i"))
        return risk.join(cited, ["subject", "box"]).select("subject", F.lit("COMPLIANCE_RISK").alias("relation"), F.col("box").alias("object"), F.array("i").alias("inputs"))

    return Rule("compliance_risk", plan, 0, ("OPAQUE_DEP",))


def import_audit(g: Graph, ont: Ontology) -> tuple[DataFrame, Graph]:
    """Conflicts of imported facts, each with the base sources that its members rest on; and the closed graph."""
    from factloom.operators.rules import fixpoint
    from factloom.operators.ontology import compile_to_rules
    from factloom.plans.storage import written

    closed, derivations, _ = fixpoint(g, compile_to_rules(ont))
    facts = written(closed.facts)
    found = conflict.detect_conflicts(closed.over(facts))
    traced = trace_sources(facts, derivations)
    own = F.concat_ws("#", "source_article", F.col("source_sentence_idx").cast("string"))
    told = found.join(traced, "triple_id", "left").withColumn("sources", F.coalesce("sources", F.array(own)))
    return told.select("conflict_id", "kind", "detail", "triple_id", "subject", "relation", "object", "sources"), closed.over(facts)


def biography_report(g: Graph, policies=None):
    """From weighted facts over standard rules and the ontology of lives to a graph without conflicts."""
    from factloom.functions.extraction import source_confidence

    weighted = g.over(source_confidence(g))
    return conflict.reason_and_resolve(weighted, standard_rules(), biography(), policies or [conflict.highest_confidence, conflict.surface_for_review])


def conflict_counts(conflicts: DataFrame) -> DataFrame:
    """kind, n of conflicts (not members)."""
    return conflicts.groupBy("kind").agg(F.count_distinct("conflict_id").alias("n"))


def derivation_counts(derivations: DataFrame, ontology_only: bool = False) -> DataFrame:
    """rule_name, n."""
    d = derivations.where(F.col("rule_name").rlike("^(owl|rdfs):")) if ontology_only else derivations
    return d.groupBy("rule_name").agg(F.count("*").alias("n"))


def framing_checks(g: Graph, ont: Ontology, pairs: list[tuple[str, str]]) -> DataFrame:
    """case, n: conflicts as the scopes are, with each scope leaked to all, and with pairs of scopes merged."""
    from factloom.operators.ontology import compile_to_rules
    from factloom.operators.rules import fixpoint

    def count(facts: DataFrame) -> int:
        closed, _, _ = fixpoint(g.over(facts), compile_to_rules(ont))
        return closed.facts.where(F.col("relation").isin(conflict.MARKERS[:3])).count()

    rows = [("scoped", count(g.facts))]
    for a, b in pairs:
        rows.append((f"leaked:{a}", count(g.facts.withColumn("scope", F.when(F.col("scope") != a, F.col("scope"))))))
        rows.append((f"merged:{a}+{b}", count(g.facts.withColumn("scope", F.when(F.col("scope") == b, F.lit(a)).otherwise(F.col("scope"))))))
    return g.spark.createDataFrame(rows, "case string, n int")
