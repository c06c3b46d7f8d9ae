"""Competency questions over entities, mentions, mappings, claims and judgements.

Tables (see :mod:`brindle.graph.tables`): entity(e, key, label, comment), entity_class(e, cls), entity_source(e, pub),
source(pub, doi, title, issued), mention(m, e, surface, start_at, end_at, dv, snapshot, confidence), version(dv, pub),
mapping(e, tier, term), concept(c, iri, curie, label, acronym), resolved(e, c), decision(dec, e, status, confidence,
method, source), candidate(dec, cand, mapping_rank, score_type, score_value), assertion(a, subject, predicate, object,
pub, negated, modality, context, evidence), edge(s, p, o) between entities, causal(rel, cause, effect, pub, v) with v the
current version, causal_version(v, rel, revision, negated, hypothetical, polarity, valid_from, valid_until, evidence),
causal_basis(v, basis), causal_third(rel, role, third), estimate(est, v, measure, value, p, n), chain(chain, label),
chain_relation(chain, rel), next_relation(rel, following), run(run, run_id, started, ended, agent, cfg, cfg_hash),
agent(agent, label, version), snapshot(snapshot, run, label, summary, generated), review(rd, dimension, status,
confidence, comment, agent), entity_review(e, rd), mention_review(m, rd), validation(act, judge, agent, prompt, hash,
mode), change(cr, kind, field, e, old, new, reason, licensed_by), entity_change(e, cr), triple(s, p, o), label(node, label).
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.graph.tables import as_, listed, squeezed
from brindle.operators.graph import closure, stretches
from brindle.sources.shared import tasks, written

# The classes below each class that questions are about.
CELLS = ["Astrocyte", "CellSubtype", "CellType", "EpendymalCell", "ExcitatoryNeuron", "GlialCell", "InhibitoryNeuron", "Interneuron", "Microglia", "MotorNeuron", "NeuralCellType", "NeuralStemCell", "Neuron", "Oligodendrocyte", "ProjectionNeuron", "SensoryNeuron"]
PHENOTYPES = ["BehavioralPhenotype", "CellularPhenotype", "ClinicalPhenotype", "CognitivePhenotype", "ElectrophysiologicalPhenotype", "MolecularPhenotype", "MorphologicalPhenotype", "MorphologyClass", "NeurologicalSign", "Phenotype", "Symptom"]
ORGANISMS = ["DevelopmentalStage", "Genotype", "LifeStage", "Organism", "Species", "Strain"]
LINES = ["Genotype", "Strain", "CellLine"]
METHODS = ["Assay", "ComputationalMethod", "ElectrophysiologyModality", "ExperimentalMethod", "GeneticIntervention", "ImagingModality", "Intervention", "Method", "NeuroimagingModality", "NeuromodulationIntervention", "PharmacologicalIntervention", "StatisticalMethod", "Stimulation", "SurgicalIntervention"]
CHEMICALS = ["AminoAcid", "Carbohydrate", "ChemicalEntity", "Drug", "Hormone", "Ion", "Lipid", "Metabolite", "Neuromodulator", "Neurotransmitter", "NeurotransmitterEntity", "TherapeuticAgent", "Toxin"]
MEASUREMENTS = ["ElectrophysiologicalMeasurement", "ImagingMeasurement", "Measurement", "MolecularMeasurement"]
CHANGES = ["CanonicalFormChangedChange", "CausalConfidenceChangedChange", "CausalContextChangedChange", "CausalDirectionChangedChange", "CausalModalityChangedChange", "CausalPolarityChangedChange", "CausalPredicateMappingChangedChange", "CausalRelationAddedChange", "CausalRelationChange", "CausalRelationRemovedChange", "CausalTypeChangedChange", "ChangeRecord", "ClassificationChangedChange", "CoreferenceChangedChange", "MappingAddedChange", "MappingChangedChange", "MappingDeprecatedChange", "MappingRemovedChange", "MentionAddedChange", "MentionRemovedChange", "OntologyConceptReplacedChange", "ReviewStatusChangedChange", "SpanChangedChange", "SpecificityChangedChange"]
# Predicates of assertions, and how they are printed.
PREDICATES = {"RO_0002292": "expresses", "RO_0001025": "located_in", "RO_0002162": "in_taxon", "RO_0002200": "has_phenotype"}

#: Papers of a side of a cell, and pairs of papers that a task counts.
CELL, COUNTED = 1024, 1 << 22
#: Concepts that stand for terms that no ontology has: their IRIs begin so, and their ontology has this acronym.
PROVISIONAL = "https://graph.example/concept/"
LOCAL = "LOCAL"

T = Mapping[str, DataFrame]


def _keyed(t: T, e: str, key: str) -> DataFrame:
    return as_(t["entity"], e=e, key=key)


def _keyed_of(t: T, rows: DataFrame, e: str, key: str) -> DataFrame:
    """Keys of the entities that rows name: often few, which are then sent to the rows, so that these need no sort."""
    return _keyed(t, e, key).join(rows.select(e).distinct(), e, "left_semi")


def _dois(rows: DataFrame, t: T) -> DataFrame:
    return rows.join(t["source"].select("pub", "doi"), "pub", "left")


def _only(rows: DataFrame, column: str, value: str | None) -> DataFrame:
    return rows if value is None else rows.where(F.col(column) == value)


def _of_class(t: T, classes: list[str], e: str = "e") -> DataFrame:
    """Entities of any of the classes, once each."""
    return t["entity_class"].where(F.col("cls").isin(*classes)).select(F.col("e").alias(e)).distinct()


def _external(t: T) -> DataFrame:
    return t["concept"].where(F.upper("acronym") != LOCAL)


def _dated(t: T) -> DataFrame:
    return t["source"].where("issued is not null").select("pub", F.substring("issued", 1, 4).cast("int").alias("year"))


def _mentioned(t: T) -> DataFrame:
    """(m, e, surface, pub) of mentions by the document that their version is of."""
    return t["mention"].join(t["version"], "dv")


# Entities, mentions, grounding


def of_type(t: T, entity_type: str) -> DataFrame:
    """CQ1: entities of a type, and the papers they are in."""
    found = t["entity_class"].where(F.col("cls") == entity_type).join(t["entity"], "e").join(t["entity_source"], "e")
    return _dois(found, t).select("e", "pub", "label", "doi").distinct()


def surface_forms(t: T, key: str | None = None) -> DataFrame:
    """CQ2: forms under which an entity is mentioned, by paper."""
    found = _mentioned(t).join(_only(t["entity"].select("e", "key"), "key", key), "e")
    return _dois(found.select("pub", "key", "surface").distinct(), t)


def mention_positions(t: T) -> DataFrame:
    """CQ3: where each mention stands in its document."""
    return _dois(_mentioned(t).select("m", "pub", "surface", "start_at", "end_at").distinct(), t)


def inventory(t: T, doi: str | None = None) -> DataFrame:
    """CQ4: what a paper contributes, by class."""
    # Rows of each table are distinct, so those of their join are: it is not shuffled once more.
    classes = t["entity_class"].where("cls != 'NamedEntity'").select("e", "cls").distinct()
    named = t["entity"].select("e", "key").distinct().join(classes, "e")
    found = t["entity_source"].select("e", "pub").distinct().join(named, "e").join(t["source"].select("pub", "doi").distinct(), "pub", "left")
    return _only(found, "doi", doi).select("pub", "doi", "e", "key", "cls")


# Cross-paper structure


def shared_entities(t: T) -> DataFrame:
    """CQ5: entities of more than one paper."""
    counts = t["entity_source"].groupBy("e").agg(F.count_distinct("pub").alias("papers")).where("papers > 1")
    return counts.join(t["entity"].select("e", "key"), "e")


def related_papers(t: T, doi: str | None = None) -> DataFrame:
    """CQ6: papers by the number of entities that they share with a paper.

    Entities are dealt out by the first of their papers, so those of the same papers meet in one task, where each pair of
    papers is counted once for many entities before it is shuffled. An entity of many papers is cut into cells of CELL papers
    a side; tasks are dealt by the pairs that they count.
    """
    lists = t["entity_source"].where("e is not null").groupBy("e").agg(F.sort_array(F.collect_set("pub")).alias("pubs")).where("size(pubs) > 1")
    chunks = lists.select(F.transform(F.sequence(F.lit(0), F.floor((F.size("pubs") - 1) / CELL).cast("int")), lambda k: F.slice("pubs", k * CELL + 1, CELL)).alias("chunks"))
    sides = chunks.select("chunks", F.posexplode("chunks").alias("i", "a")).select("i", "a", F.posexplode(F.slice("chunks", F.col("i") + 1, F.size("chunks"))).alias("apart", "b"))
    cells = written(sides.select("a", "b", (F.col("apart") == 0).alias("one")), "cells")
    pairs = F.size("a").cast("long") * F.size("b")
    n = tasks(cells, cells.agg(F.sum(F.when(F.col("one"), F.floor(pairs / 2)).otherwise(pairs))).first()[0], COUNTED)
    each = cells.repartitionByRange(n, F.get("a", F.lit(0)), F.get("a", F.lit(1)), F.element_at("b", -1)).select("b", "one", F.posexplode("a").alias("at", "x"))
    met = each.select("x", F.explode(F.when(F.col("one"), F.slice("b", F.col("at") + 2, F.size("b"))).otherwise(F.col("b"))).alias("y"))
    once = met.groupBy("x", "y").agg(F.count(F.lit(1)).alias("shared"))
    dois = t["source"].select("pub", "doi").distinct()
    for p in "xy":
        once = once.join(as_(dois, pub=p, doi=f"doi_{p}"), p, "left")
    way = lambda a, b: F.struct(F.col(a).alias("p1"), F.col(b).alias("p2"), F.col(f"doi_{a}").alias("doi"), F.col(f"doi_{b}").alias("other_doi"), "shared")
    return _only(once.select(F.explode(F.array(way("x", "y"), way("y", "x"))).alias("p")).select("p.*"), "doi", doi)


def mapped_across_papers(t: T) -> DataFrame:
    """CQ7: external terms of entities of more than one paper, exact, close or broad."""
    terms = t["mapping"].where(F.col("tier").isin("exact", "close", "broad") & ~F.col("term").startswith(PROVISIONAL))
    return terms.join(t["entity_source"], "e").groupBy("term").agg(F.count_distinct("pub").alias("papers")).where("papers > 1")


# Ontology alignment and its provenance


def mappings(t: T) -> DataFrame:
    """CQ8: external terms of each entity, by tier."""
    return t["mapping"].where(~F.col("term").startswith(PROVISIONAL)).join(t["entity"].select("e", "key"), "e").select("e", "key", "tier", "term").distinct()


def decisions(t: T) -> DataFrame:
    """CQ9: how mappings were decided, a row for each candidate."""
    found = t["decision"].select("dec", "e", "status", "method", "confidence").join(t["entity"].select("e", "key"), "e").join(t["candidate"], "dec", "left")
    return found.select("key", "dec", "status", "method", "confidence", "cand", "mapping_rank", "score_type", "score_value").distinct()


def _unmapped(t: T, entities: DataFrame) -> DataFrame:
    """Rows of entities that no external concept resolves."""
    return entities.join(t["resolved"].join(_external(t), "c").select("e"), "e", "left_anti")


def without_mapping(t: T) -> DataFrame:
    """CQ10: entities without an external term, with the gap that is noted."""
    found = _unmapped(t, t["entity"]).join(t["entity_class"].where("cls != 'NamedEntity'"), "e")
    return found.select("e", "cls", "key", F.col("comment").alias("gap")).distinct()


def tier_distribution(t: T) -> DataFrame:
    """CQ11: mappings by external ontology and tier."""
    terms = _external(t).select(F.col("iri").alias("term"), "acronym").distinct()
    return t["mapping"].select("e", "term", "tier").distinct().join(terms, "term").groupBy("acronym", "tier").agg(F.count(F.lit(1)).alias("n"))


# Causal claims and evidence


def _claims(t: T) -> DataFrame:
    """Claims with their current versions and the keys of cause and effect."""
    versions = t["causal_version"].drop("rel")
    return t["causal"].join(versions, "v").join(_keyed_of(t, t["causal"], "cause", "cause_key"), "cause").join(_keyed_of(t, t["causal"], "effect", "effect_key"), "effect")


def claims_of(t: T, key: str | None = None) -> DataFrame:
    """CQ12: claims that an entity takes part in, by role."""
    claims = _claims(t).select("rel", "cause", "effect", "cause_key", "effect_key", "negated", "hypothetical")
    thirds = t["causal_third"].where("role = 'mediator'").select("rel", F.col("third").alias("e"))
    roles = [claims.withColumn("e", F.col("cause")).withColumn("role", F.lit("cause")), claims.withColumn("e", F.col("effect")).withColumn("role", F.lit("effect")), claims.join(thirds, "rel").withColumn("role", F.lit("mediator"))]
    found = reduce(DataFrame.unionByName, roles).join(t["entity"].select("e", "key"), "e")
    return _only(found, "key", key).select("key", "role", "cause_key", "effect_key", "negated", "hypothetical")


def chains(t: T) -> DataFrame:
    """CQ13, W10: relations of a causal chain, each with the number of the chain's relations before it."""
    told, paths = stretches(as_(t["next_relation"], rel="s", following="o"))
    places = told.select(F.col("v").alias("rel"), "head", "place")
    members = t["chain_relation"].distinct().join(places, "rel", "left").select("chain", "rel", F.coalesce("head", "rel").alias("head"), F.coalesce("place", F.lit(0)).alias("place"))
    first = F.row_number().over(Window.partitionBy("chain", "head").orderBy("place")).cast("long") - 1
    members = members.withColumn("position", first)
    if paths is not None:
        sizes = members.groupBy("chain", "head").agg(F.count(F.lit(1)).alias("n"))
        reached = as_(sizes, chain="chain", head="s", n="n").join(paths, "s").groupBy("chain", F.col("o").alias("head")).agg(F.sum(F.when(F.col("s") != F.col("o"), F.col("n")).otherwise(0)).alias("more"), F.max(F.when(F.col("s") == F.col("o"), F.col("n") - 1)).alias("ring"))
        members = members.join(reached, ["chain", "head"], "left").withColumn("position", F.coalesce("ring", "position") + F.coalesce("more", F.lit(0)))
    ends = t["causal"].join(_keyed(t, "cause", "cause_key"), "cause").join(_keyed(t, "effect", "effect_key"), "effect").select("rel", "cause_key", "effect_key")
    found = members.join(t["chain"], "chain").join(ends, "rel")
    return found.select("chain", F.col("label").alias("chain_label"), "rel", "position", "cause_key", "effect_key")


def estimates(t: T, below: float | None = None) -> DataFrame:
    """CQ14: estimates of each claim's effect; CQ32: those with a p of less than ``below``."""
    found = _claims(t).join(t["estimate"].withColumnRenamed("p", "p_value"), "v").where("measure is not null and value is not null")
    found = found.select("cause_key", "effect_key", "measure", "value", F.col("p_value").alias("p"), "n")
    return found if below is None else found.where(F.col("p") < below)


def opposed(t: T) -> DataFrame:
    """CQ15: claims of two papers over the same pair, one negated and one not."""
    claims = _claims(t).select("rel", "pub", "cause", "effect", "cause_key", "effect_key", "negated").distinct()
    own = ["r1", "pub1", "cause_key", "effect_key"]
    no = as_(claims.where("negated"), rel="r1", pub="pub1", cause="cause", effect="effect", cause_key="cause_key", effect_key="effect_key")
    no = no.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*own)))
    yes = as_(claims.where("not negated"), rel="r2", pub="pub2", cause="cause", effect="effect").distinct()
    met = lambda rows: rows.join(yes, ["cause", "effect"]).where("pub1 != pub2").select("r1", "r2", "pub1", "pub2", "cause_key", "effect_key")
    # A claim over one pair meets another once, so its rows, which are as many as the pairs, need no shuffle to be distinct.
    return met(no.where("n = 1")).unionByName(met(no.where("n > 1")).distinct())


def _edges(t: T, predicate: str, s: str = "s", o: str = "o") -> DataFrame:
    """(s, s_key, o, o_key) of an edge between entities."""
    found = t["edge"].where(F.col("p") == predicate).select(F.col("s").alias(s), F.col("o").alias(o))
    return found.join(_keyed(t, s, f"{s}_key"), s).join(_keyed(t, o, f"{o}_key"), o)


def participants_of(t: T, cls: str = "Drug") -> DataFrame:
    """CQ16: participants recorded for entities of a class."""
    return _edges(t, "participant").join(_of_class(t, [cls], "s"), "s").select(F.col("s_key").alias("entity"), F.col("o_key").alias("participant"))


# Temporal evolution


def first_seen(t: T) -> DataFrame:
    """CQ17: the year in which each entity first appears, and in how many dated papers it is."""
    dated = _dated(t).groupBy("pub").agg(F.min("year").alias("year"))
    found = t["entity_source"].distinct().join(dated, "pub").groupBy("e").agg(F.min("year").alias("first"), F.count(F.lit(1)).alias("papers"))
    return found.join(t["entity"].select("e", "key"), "e")


def term_years(t: T, term: str | None = None) -> DataFrame:
    """CQ18: papers by year that hold an entity mapped exactly or closely to a term."""
    terms = _only(t["mapping"].where("tier in ('exact', 'close')").select("e", "term"), "term", term)
    return terms.join(t["entity_source"], "e").join(_dated(t), "pub").groupBy("term", "year").agg(F.count_distinct("pub").alias("papers"))


def hypotheticality(t: T, key: str | None = None) -> DataFrame:
    """CQ19: whether claims about an effect are hypothetical, by the year of their paper."""
    found = _only(_claims(t), "effect_key", key).join(_dated(t), "pub")
    return _dois(found, t).select("pub", "effect_key", "year", "doi", "cause_key", "hypothetical")


def validity(t: T) -> DataFrame:
    """CQ20, W11: versions of each claim in order, with the time each was held to be current."""
    return t["causal_version"].select("rel", "revision", "valid_from", "valid_until")


# Extraction provenance


def runs(t: T) -> DataFrame:
    """CQ21: runs, by which agent, version and configuration."""
    found = t["run"].join(t["agent"].select("agent", F.col("version").alias("agent_version")), "agent", "left")
    return found.select("run", "agent", "cfg", "run_id", "started", "ended", "agent_version", "cfg_hash").distinct()


def provenance_walk(t: T, key: str | None = None) -> DataFrame:
    """CQ22: mentions of an entity with their document, and run and agent where their snapshot says so."""
    made = t["snapshot"].select("snapshot", "run").join(t["run"].select("run", "run_id", "agent"), "run").join(as_(t["agent"], agent="agent", label="agent_label"), "agent", "left")
    found = _mentioned(t).join(_only(t["entity"].select("e", "key"), "key", key), "e").join(made.select("snapshot", "run_id", "agent_label"), "snapshot", "left")
    return _dois(found, t).select("e", "m", "dv", "pub", "key", "surface", "doi", "run_id", "agent_label").distinct()


def classification_confidence(t: T) -> DataFrame:
    """CQ23: how sure the class of each mention is."""
    return t["mention"].where("confidence is not null").select("surface", "confidence")


def _reviews(t: T) -> DataFrame:
    return t["review"].join(t["agent"].select("agent", F.col("version").alias("agent_version")), "agent", "left")


def mention_reviews(t: T) -> DataFrame:
    """CQ24b: what each judge decided about a mention, on which dimension."""
    found = t["mention_review"].join(t["mention"].select("m", "surface"), "m").join(_reviews(t), "rd")
    return found.select("surface", "dimension", "status", "confidence", "agent_version")


def density(t: T) -> DataFrame:
    """CQ24: entities and mentions of each paper."""
    counts = _mentioned(t).groupBy("pub").agg(F.count_distinct("e").alias("entities"), F.count_distinct("m").alias("mentions"))
    return _dois(counts, t)


def neighbours(t: T, key: str | None = None) -> DataFrame:
    """CQ26r: nodes linked with an entity, in either direction."""
    own = _only(t["entity"].select(F.concat(F.lit("e:"), "e").alias("x"), "key"), "key", key)
    out = as_(t["triple"], s="x", p="predicate", o="other").withColumn("direction", F.lit("out"))
    into = as_(t["triple"], o="x", p="predicate", s="other").withColumn("direction", F.lit("in"))
    found = out.unionByName(into).join(own, "x").join(as_(t["label"], node="other", label="other_label"), "other", "left")
    return found.select("key", "direction", "predicate", "other", "other_label")


# Scientific questions


def _assertions(t: T, predicate: str) -> DataFrame:
    found = t["assertion"].where(F.col("predicate") == predicate).join(_keyed(t, "subject", "subject_key"), "subject").join(_keyed(t, "object", "object_key"), "object")
    return _dois(found, t)


_QUALIFIERS = ["pub", "doi", "negated", "modality", "context", "evidence"]


def cell_locations(t: T) -> DataFrame:
    """CQ25: cell types and the regions that papers assert them to be in."""
    found = _assertions(t, "RO_0001025").join(_of_class(t, CELLS, "subject"), "subject")
    return found.select(F.col("subject_key").alias("cell"), F.col("object_key").alias("region"), *_QUALIFIERS).distinct()


def _curies(t: T, e: str, curie: str) -> DataFrame:
    return t["resolved"].join(t["concept"].select("c", "curie"), "c").select(F.col("e").alias(e), F.col("curie").alias(curie))


def containment(t: T) -> DataFrame:
    """CQ26: structures that are part of others, with their terms."""
    found = _edges(t, "part_of").join(_curies(t, "s", "part_term"), "s", "left").join(_curies(t, "o", "whole_term"), "o", "left")
    return found.select(F.col("s_key").alias("part"), F.col("o_key").alias("whole"), "part_term", "whole_term")


def organisms(t: T) -> DataFrame:
    """CQ27: organisms, strains and life stages of each paper."""
    found = t["entity_class"].where(F.col("cls").isin(*ORGANISMS)).join(t["entity"].select("e", "key"), "e").join(t["entity_source"], "e")
    return _dois(found, t).select("pub", "doi", F.col("cls").alias("kind"), "key").distinct()


def carried(t: T) -> DataFrame:
    """CQ28: what lines and genotypes carry."""
    found = _edges(t, "participant").join(_of_class(t, LINES, "s"), "s").join(t["entity_class"].where("cls != 'NamedEntity'").withColumnRenamed("e", "o"), "o")
    return found.select(F.col("s_key").alias("line"), F.col("o_key").alias("carries"), F.col("cls").alias("carries_class")).distinct()


def method_participants(t: T) -> DataFrame:
    """CQ29: participants of methods."""
    return _edges(t, "participant").join(_of_class(t, METHODS, "s"), "s").select(F.col("s_key").alias("method"), F.col("o_key").alias("participant")).distinct()


def assay_chemicals(t: T) -> DataFrame:
    """CQ30: chemicals of assays, with the broader classes that are recorded."""
    found = _edges(t, "participant").join(_of_class(t, ["Assay"], "s"), "s").join(_of_class(t, CHEMICALS, "o"), "o")
    broader = _edges(t, "broader", "o", "b").select("o", F.col("b_key").alias("broader"))
    return found.join(broader, "o", "left").select(F.col("s_key").alias("assay"), F.col("o_key").alias("stimulus"), "broader").distinct()


def evidence_basis(t: T) -> DataFrame:
    """CQ31: what each claim rests on."""
    return _claims(t).join(t["causal_basis"], "v", "left").select("cause_key", "effect_key", "hypothetical", "basis", "evidence")


def third_variables(t: T) -> DataFrame:
    """CQ33: mediators, moderators and confounders of claims."""
    ends = t["causal"].join(_keyed(t, "cause", "cause_key"), "cause").join(_keyed(t, "effect", "effect_key"), "effect")
    return ends.join(t["causal_third"], "rel").join(_keyed(t, "third", "third_key"), "third").select("cause_key", "effect_key", "role", "third_key")


def cross_references(t: T) -> DataFrame:
    """CQ34: cross-references between entities, and their terms."""
    found = _edges(t, "see_also").join(_curies(t, "s", "a_term"), "s", "left").join(_curies(t, "o", "b_term"), "o", "left")
    return found.select(F.col("s_key").alias("a"), "a_term", F.col("o_key").alias("b"), "b_term")


def derivations(t: T) -> DataFrame:
    """CQ35: what measures are derived from, by any number of steps."""
    paths = closure(t["edge"].where("p = 'derived_from'").select("s", "o"))
    found = paths.join(_of_class(t, MEASUREMENTS, "s"), "s").join(_keyed(t, "s", "measure"), "s").join(_keyed(t, "o", "derived_from"), "o")
    return found.select("measure", "derived_from").distinct()


def dependencies(t: T) -> DataFrame:
    """CQ36: software and algorithms that are used."""
    found = _edges(t, "used").join(t["entity_class"].where("cls != 'NamedEntity'").withColumnRenamed("e", "o"), "o")
    return found.select(F.col("s_key").alias("user_key"), F.col("o_key").alias("uses"), F.col("cls").alias("uses_class"))


def broader(t: T) -> DataFrame:
    """CQ37: direct broader relations."""
    found = _edges(t, "broader").join(_curies(t, "o", "parent_term"), "o", "left")
    return found.select(F.col("s_key").alias("child"), F.col("o_key").alias("parent"), "parent_term")


def unmapped_by_mentions(t: T) -> DataFrame:
    """CQ38: entities without an external term, by mentions."""
    found = _unmapped(t, t["entity"].select("e", "key")).join(t["entity_class"].where("cls != 'NamedEntity'"), "e")
    counts = t["mention"].groupBy("e").agg(F.count_distinct("m").alias("mentions"))
    return found.distinct().join(counts, "e").select("e", "cls", "key", "mentions")


def agreeing_claims(t: T) -> DataFrame:
    """CQ39: pairs that more than one paper claims with the same polarity and negation."""
    counts = _claims(t).groupBy("cause_key", "effect_key", "polarity", "negated").agg(F.count_distinct("pub").alias("papers"), F.max(F.when(~F.col("hypothetical"), 1).otherwise(0)).alias("any_non_hypothetical"))
    return counts.where("papers > 1")


def participations(t: T) -> DataFrame:
    """CQ40: processes that entities take part in."""
    return _edges(t, "participates_in").select(F.col("s_key").alias("entity"), F.col("o_key").alias("process"))


# Judge and mapping provenance


def judges(t: T) -> DataFrame:
    """CQ41: judges that ran, their versions and prompts."""
    found = t["validation"].where("agent is not null").join(t["agent"].select("agent", F.col("version").alias("model")), "agent", "left")
    return found.where(F.col("judge").startswith("judge:")).select("judge", "model", "prompt", "hash", "mode")


def entity_reviews(t: T) -> DataFrame:
    """CQ42: verdicts on entities."""
    found = t["entity_review"].join(t["entity"].select("e", "key"), "e").join(t["review"], "rd")
    return found.select("key", "dimension", "status", "confidence", F.col("comment").alias("reason"))


def changes(t: T) -> DataFrame:
    """CQ43: what judges changed, and on whose authority."""
    found = t["change"].where(F.col("kind").isin(*CHANGES)).join(t["entity"].select("e", "key"), "e", "left")
    return found.select("kind", "key", "field", "old", "new", "reason", "licensed_by")


def removed_mappings(t: T) -> DataFrame:
    """CQ44: mappings that were removed, of the entity that changed or that holds the record of it."""
    gone = t["change"].where("kind = 'MappingRemovedChange' and old is not null and reason is not null")
    holders = gone.where("e is not null").select("cr", "e").unionByName(t["entity_change"].select("cr", "e"))
    found = gone.drop("e").join(holders, "cr").join(t["entity"].select("e", "key"), "e")
    return found.select("key", F.col("old").alias("removed_iri"), "reason")


def mapping_sources(t: T) -> DataFrame:
    """CQ45: accepted mappings by source and method."""
    return t["decision"].where("status = 'accepted'").groupBy("source", "method").agg(F.count_distinct("dec").alias("decisions"))


def snapshot_summaries(t: T) -> DataFrame:
    """CQ46: the quality summary of each snapshot."""
    return t["snapshot"].select("snapshot", "label", "summary", "generated")


def ontology_entities(t: T, acronym: str | None = None) -> DataFrame:
    """CQ47: entities that map to an ontology, by tier."""
    terms = _only(t["concept"], "acronym", acronym).select("c", F.col("iri").alias("term"), "curie", F.col("label").alias("concept_label"), "acronym")
    found = t["mapping"].join(terms, "term").join(t["resolved"], ["e", "c"]).join(t["entity"].select("e", "key"), "e")
    return found.select("e", "key", "acronym", "curie", "concept_label", "tier").distinct()


def term_entities(t: T, acronym: str | None = None) -> DataFrame:
    """CQ48: entities and number of papers of each term."""
    concepts = _only(t["concept"].select("c", "curie", "acronym"), "acronym", acronym)
    found = t["resolved"].join(concepts, "c").join(t["entity"].select("e", "key"), "e").join(t["entity_source"], "e")
    return found.groupBy("acronym", F.col("curie").alias("concept")).agg(listed(F.col("key"), ", ").alias("entities"), F.count_distinct("pub").alias("papers"))


def ontology_coverage(t: T) -> DataFrame:
    """CQ49: entities and concepts of each ontology."""
    return t["resolved"].join(t["concept"].select("c", "acronym"), "c").groupBy("acronym").agg(F.count_distinct("e").alias("entities"), F.count_distinct("c").alias("concepts"))


# Phenotypes


def phenotypes(t: T) -> DataFrame:
    """CQ50: phenotypes by level and paper; of no paper, too."""
    found = t["entity_class"].where(F.col("cls").isin(*PHENOTYPES)).join(t["entity"].select("e", "key"), "e").join(t["entity_source"], "e", "left")
    return _dois(found, t).select("pub", F.col("cls").alias("level"), "key", "doi").distinct()


def phenotype_bearers(t: T) -> DataFrame:
    """CQ51: entities asserted to have a phenotype."""
    return _assertions(t, "RO_0002200").select(F.col("subject_key").alias("bearer"), F.col("object_key").alias("phenotype"), *_QUALIFIERS).distinct()


def phenotype_grounding(t: T) -> DataFrame:
    """CQ52: phenotypes with a term of HP, MP or PATO, by tier."""
    vocabulary = F.regexp_extract("term", "^http://purl.obolibrary.org/obo/(HP|MP|PATO)_", 1)
    found = t["mapping"].join(_of_class(t, PHENOTYPES), "e").withColumn("vocab", vocabulary).where("vocab != ''")
    return found.groupBy("vocab", "tier").agg(F.count_distinct("e").alias("n"))


def phenotype_effects(t: T) -> DataFrame:
    """CQ53: claims whose effect is a phenotype, with the size of the effect."""
    sizes = t["estimate"].where("measure is not null and value is not null").select("v", "measure", "value")
    found = _claims(t).join(_of_class(t, PHENOTYPES, "effect"), "effect").join(sizes, "v", "left")
    return found.select("cause_key", F.col("effect_key").alias("phenotype"), "negated", "hypothetical", "measure", "value").distinct()


# Hierarchies


def leaf_paths(t: T) -> DataFrame:
    """CQ54: ancestors of entities that nothing is narrower than."""
    edges = t["edge"].where("p = 'broader'").select("s", "o")
    leaves = closure(edges).join(edges.select(F.col("o").alias("s")), "s", "left_anti")
    found = leaves.join(_keyed(t, "s", "leaf"), "s").join(_keyed(t, "o", "ancestor"), "o").join(_curies(t, "o", "ancestor_term"), "o", "left")
    return found.select("leaf", "ancestor", "ancestor_term")


def markers(t: T) -> DataFrame:
    """CQ55: assertions that a cell expresses a marker, each with its qualifiers."""
    return _assertions(t, "RO_0002292").select(F.col("subject_key").alias("cell"), F.col("object_key").alias("marker"), *_QUALIFIERS).distinct()


# How papers name and characterise cells


def cell_names(t: T) -> DataFrame:
    """CQ58: how each paper names each cell, its classes, terms and species.

    Names, terms and species are listed side by side, so each comes from an aggregation of its own, not from their product.
    """
    cells = t["entity_class"].where(F.col("cls").isin(*CELLS)).join(t["entity"].select("e", "key", "label"), "e")
    classes = cells.groupBy("e", F.col("key").alias("cell"), "label").agg(listed(F.col("cls"), " | ").alias("classes"))
    named = _mentioned(t).groupBy("e", "pub").agg(listed(squeezed(F.col("surface")), " | ").alias("names"), F.count_distinct("m").alias("mentions"))
    label = F.coalesce("concept_label", F.lit(""))
    terms = t["mapping"].join(t["concept"].select(F.col("iri").alias("term"), "c", "curie", F.col("label").alias("concept_label")), "term").join(t["resolved"], ["e", "c"])
    shown = F.concat("curie", F.lit(' "'), label, F.lit('" ['), "tier", F.lit("]"), F.when(F.col("term").startswith(PROVISIONAL), " (default, no external term)").otherwise(""))
    mapped = terms.groupBy("e").agg(listed(shown, " ; ").alias("mappings"))
    taxa = t["resolved"].join(t["concept"].where(F.col("curie").startswith("NCBITaxon:")), "c").select(F.col("e").alias("object"), "curie", F.col("label").alias("taxon_label"))
    stated = t["assertion"].where("predicate = 'RO_0002162' and not negated").join(_keyed(t, "object", "object_key"), "object").join(taxa, "object", "left")
    species = F.when(F.col("curie").isNotNull(), F.concat(F.coalesce("taxon_label", "object_key"), F.lit(" ("), "curie", F.lit(")"))).otherwise(F.col("object_key"))
    taxon = stated.groupBy(F.col("subject").alias("e"), "pub").agg(listed(species, " ; ").alias("species"))
    found = classes.join(named, "e").join(mapped, "e", "left").join(taxon, ["e", "pub"], "left").join(t["source"].select("pub", "doi", "title"), "pub", "left")
    blank = [F.coalesce(c, F.lit("")).alias(c) for c in ("mappings", "species")]
    return found.select("cell", "label", "classes", "pub", "doi", "title", "names", "mentions", *blank)


def cells_across_papers(t: T) -> DataFrame:
    """CQ59: cells that more than one paper names, and what each calls them."""
    named = _mentioned(t).join(_of_class(t, CELLS), "e")
    counts = named.groupBy("e").agg(F.count_distinct("pub").alias("paper_count")).where("paper_count > 1")
    names = named.groupBy("e", "pub").agg(listed(squeezed(F.col("surface")), " | ").alias("names"))
    return _dois(names.join(counts, "e").join(t["entity"].select("e", F.col("key").alias("cell")), "e"), t).select("cell", "pub", "doi", "names", "paper_count")


def same_concept(t: T) -> DataFrame:
    """CQ60: differently named cells that resolve to one external term in more than one paper."""
    concepts = t["concept"].where(~F.col("iri").startswith(PROVISIONAL)).select("c", F.col("iri").alias("term"), F.col("curie").alias("concept_id"), F.col("label").alias("concept_label"))
    cells = t["mapping"].join(concepts, "term").join(t["resolved"], ["e", "c"]).join(_of_class(t, CELLS), "e").join(t["entity"].select("e", "key"), "e")
    found = cells.join(_mentioned(t).select("e", "pub", squeezed(F.col("surface")).alias("name")).distinct(), "e")
    tiers = listed(F.concat("key", F.lit(" ["), "tier", F.lit("]")), " ; ")
    return found.groupBy("concept_id", "concept_label").agg(tiers.alias("entities"), listed(F.col("name"), " | ").alias("names"), F.count_distinct("pub").alias("papers")).where("papers > 1")


def _cell_assertions(t: T) -> DataFrame:
    return t["assertion"].where("negated is not null").join(_of_class(t, CELLS, "subject"), "subject").join(_keyed(t, "subject", "cell"), "subject").join(_keyed(t, "object", "object_key"), "object")


def characteristics(t: T) -> DataFrame:
    """CQ61: how each paper characterises a cell."""
    shown = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in PREDICATES.items() for x in pair]), F.col("predicate")), F.col("predicate"))
    found = _dois(_cell_assertions(t), t)
    return found.select("cell", "doi", shown.alias("predicate"), F.col("object_key").alias("object"), "negated", squeezed(F.col("evidence")).alias("evidence"))


def agreement(t: T) -> DataFrame:
    """CQ62: how many papers assert and negate each characteristic of a cell that more than one paper names."""
    naming = _mentioned(t).groupBy(F.col("e").alias("subject")).agg(F.count_distinct("pub").alias("papers_naming")).where("papers_naming > 1")
    found = _cell_assertions(t).join(naming, "subject")
    sides = [F.count_distinct(F.when(F.col("negated") == side, F.col("pub"))).alias(name) for side, name in ((False, "papers_asserting"), (True, "papers_negating"))]
    return found.groupBy("cell", "predicate", F.col("object_key").alias("object"), "papers_naming").agg(*sides)


def same_meaning(t: T, least: int = 2) -> DataFrame:
    """CQ63: differently keyed cells of different papers that share characteristics.

    Papers are aggregated first, to the smallest and largest of a cell's characteristic: two cells come from different
    papers unless all four are one.
    """
    held = t["assertion"].where("not negated and predicate != 'RO_0002162'").join(_of_class(t, CELLS, "subject"), "subject")
    held = held.groupBy("predicate", "object", "subject").agg(F.min("pub").alias("low"), F.max("pub").alias("high"))
    sides = [held.select("predicate", "object", *[F.col(c).alias(f"{c}_{s}") for c in ("subject", "low", "high")]) for s in "ab"]
    one = (F.col("low_a") == F.col("high_a")) & (F.col("low_b") == F.col("high_b")) & (F.col("low_a") == F.col("low_b"))
    pairs = sides[0].join(sides[1], ["predicate", "object"]).where((F.col("subject_a") < F.col("subject_b")) & ~one)
    named = pairs.join(_keyed(t, "object", "object_key"), "object").join(_keyed(t, "subject_a", "cell_a"), "subject_a").join(_keyed(t, "subject_b", "cell_b"), "subject_b")
    shared = F.concat_ws(" ", "predicate", "object_key")
    return named.groupBy("cell_a", "cell_b").agg(listed(shared, " | ").alias("shared"), F.count_distinct(shared).alias("n_shared")).where(F.col("n_shared") >= least)
