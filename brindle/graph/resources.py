"""Competency questions over catalogued resources: scope, assumptions, failures, versions, provenance, records.

Tables (see :mod:`brindle.graph.tables`): resource(r, name, parent, version, status, superseded_by, reason, guidance,
generated_by), resource_class(r, cls), scope(scope, r, kind, taxon, evidence, statement) with a null kind for what was
only recovered from text, scope_dimension(scope, dimension, label, concept), assumption(a, r, type, criticality,
statement, consequence, status), violation(a, run), project(project, label), produced(r, project), data_use(r, duc,
permission, modifier), resource_change(change, r, breaking, kind, trigger, reason, moment, agent), record(rec, r,
record_version, review, produced_by, last_verified, due, completeness), record_missing(rec, field), concept_mapping(m,
field, concept, relation, status, method, raw, confidence), activity(act, label), activity_input(act, r),
activity_agent(act, agent), requirement(r, ref), mentions(r, ref), statement(a, r, property, value, agent, machine, quote,
sentence, review), io(spec, r, direction, io_name, format, modality, required), io_constraint(spec, limits),
failure(f, r, statement, condition, symptom, silent, severity, mitigation), referenced_by(r, work), work(work, title,
doi), attested_at(r, loc), locator(loc, work, place), release(r, version, released), observation(o, r, moment, property,
value, source), resolution(a, identifier, status, route, source, moment), verification(v, r, outcome, asserted, actual,
source, moment).

A scope of any kind counts as the resource's scope, which the ontology only entails.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.graph.tables import listed

# Kinds of scope and how they are printed, in order; classes that ought to have one; states of the past.
CLAIMS = {"declared": "declared", "validated": "validated", "observed": "observed in use", "out": "out of scope"}
SCOPED = ["SoftwareApplication", "SoftwareLibrary", "Pipeline", "Workflow", "ComputationalModel", "DeviceResource", "Atlas", "CellTypeTaxonomy"]
PAST = ["deprecated", "superseded", "withdrawn"]

T = Mapping[str, DataFrame]


def names(t: T) -> DataFrame:
    """(r, shown): a resource's name, or its parent's, or its own id, with its version if it has one."""
    parent = t["resource"].select(F.col("r").alias("parent"), F.col("name").alias("parent_name"))
    base = F.coalesce("name", "parent_name", F.concat(F.lit("ex:"), "r"))
    shown = F.when(F.col("version").isNotNull(), F.concat(base, F.lit(" v"), "version")).otherwise(base)
    return t["resource"].select("r", "name", "parent", "version").join(parent, "parent", "left").select("r", shown.alias("shown"))


def _claim(numbered: bool = False) -> F.Column:
    found = F.lit(None).cast("string")
    for k, (kind, text) in enumerate(reversed(CLAIMS.items())):
        found = F.when(F.col("kind") == kind, f"{len(CLAIMS) - k} {text}" if numbered else text).otherwise(found)
    return found


def of_taxon(t: T, taxon: str) -> DataFrame:
    """CQ01: resources that apply to a taxon, by what kind of claim, on what evidence."""
    found = t["scope"].where(F.col("taxon") == taxon).join(names(t), "r")
    return found.select(F.col("shown").alias("name"), F.coalesce(_claim(), F.lit("recovered from text")).alias("claim"), "evidence").distinct()


def taxa(t: T) -> DataFrame:
    """CQ02: taxa of each resource that are declared, validated, seen in use or out of scope."""
    found = t["scope"].where(F.col("kind").isin(*CLAIMS) & F.col("taxon").isNotNull()).join(names(t), "r")
    return found.groupBy(F.col("shown").alias("name"), _claim(numbered=True).alias("claim")).agg(listed(F.col("taxon"), ", ").alias("taxa"))


def beyond_declared(t: T) -> DataFrame:
    """CQ03: resources seen in use for a taxon that they don't declare."""
    seen = t["scope"].where("kind = 'observed' and taxon is not null").select("r", "taxon", "statement")
    declared = t["scope"].where("kind = 'declared'").select("r", "taxon")
    return seen.join(declared, ["r", "taxon"], "left_anti").join(names(t), "r").select(F.col("shown").alias("name"), F.col("taxon").alias("off_taxon"), "statement").distinct()


def _named(t: T) -> DataFrame:
    return t["resource"].where("name is not null").select("r", F.col("name").alias("resource"))


def critical_assumptions(t: T) -> DataFrame:
    """CQ04: critical assumptions of each resource, and what breaks if they fail."""
    found = t["assumption"].where("criticality = 'critical' and statement is not null").join(_named(t), "r")
    return found.select("resource", F.col("type").alias("assumption_type"), "statement", "consequence", "status")


def violated(t: T) -> DataFrame:
    """CQ05: runs that violated an assumption."""
    return t["violation"].join(t["assumption"].where("statement is not null"), "a").select("run", "statement", "consequence", "criticality")


def outputs(t: T) -> DataFrame:
    """CQ06: resources of each project, with the permissions of their use, their own or their parent's."""
    own = t["data_use"].select("r", "duc", "permission", "modifier")
    children = t["resource"].where("parent is not null").select("r", "parent")
    inherited = own.withColumnRenamed("r", "parent").join(children, "parent").select("r", "duc", "permission", "modifier")
    found = t["produced"].join(t["project"].withColumnRenamed("label", "project_label"), "project").join(names(t), "r").join(own.unionByName(inherited), "r", "left")
    joined = [listed(F.coalesce(c, F.lit("")), ", ").alias(f"{c}s") for c in ("permission", "modifier")]
    return found.groupBy(F.col("project_label").alias("project"), F.col("shown").alias("name")).agg(*joined)


def past(t: T) -> DataFrame:
    """CQ07: resources that are deprecated, superseded or withdrawn, and what to use instead."""
    other = t["resource"].select(F.col("r").alias("superseded_by"), F.coalesce("name", F.concat(F.lit("version "), "version"), F.concat(F.lit("ex:"), "r")).alias("replacement"))
    found = t["resource"].where(F.col("status").isin(*PAST)).join(names(t), "r").join(other, "superseded_by", "left")
    return found.select(F.col("shown").alias("name"), "status", "replacement", "reason", "guidance")


def breaking_changes(t: T) -> DataFrame:
    """CQ08: changes that break, of which kind, why, when and by whom."""
    found = t["resource_change"].where("breaking").join(names(t), "r")
    return found.select(F.col("shown").alias("affected"), F.col("kind").alias("change_type"), "trigger", "reason", "moment", "agent")


def record_states(t: T) -> DataFrame:
    """CQ09: the state of each record, who made it, and when its review is due."""
    found = t["record"].join(t["resource"].select("r", F.col("name").alias("resource")), "r", "left")
    return found.select("resource", "record_version", "review", "produced_by", "last_verified", "due")


def mapping_audit(t: T) -> DataFrame:
    """CQ10: concept mappings, published or withheld, and how they were made."""
    return t["concept_mapping"].select("field", "concept", "relation", "status", "method", "raw", "confidence")


def version_provenance(t: T, fragment: str) -> DataFrame:
    """CQ11: what made each version of the resources whose name holds a fragment, from what, by whom."""
    parents = _named(t).where(F.col("resource").contains(fragment)).select(F.col("r").alias("parent"))
    versions = t["resource"].where("version is not null and generated_by is not null").join(parents, "parent").select("version", F.col("generated_by").alias("act"))
    inputs = t["activity_input"].join(t["resource"].select("r", "name"), "r", "left").select("act", F.coalesce("name", F.concat(F.lit("ex:"), "r")).alias("input"))
    return versions.join(inputs, "act", "left").join(t["activity_agent"], "act", "left").select("version", F.concat(F.lit("act:"), "act").alias("activity"), "input", "agent")


def dependents(t: T, version: str, fragment: str) -> DataFrame:
    """CQ12: what depends on a version of the resources whose name holds a fragment."""
    parent = t["resource"].select(F.col("r").alias("parent"), F.col("name").alias("parent_name"))
    reference = t["resource"].where(F.col("version") == version).join(parent, "parent", "left").select(F.col("r").alias("ref"), F.coalesce("name", "parent_name").alias("reference"))
    reference = reference.where(F.lower("reference").contains(fragment.lower()))
    named = _named(t).withColumnRenamed("resource", "dependent")
    needs = reference.join(t["requirement"], "ref").join(named, "r").withColumn("relation", F.lit("requires as reference"))
    used = reference.join(t["activity_input"].withColumnRenamed("r", "ref"), "ref").join(t["activity"], "act", "left").withColumn("dependent", F.coalesce("label", F.concat(F.lit("act:"), "act"))).withColumn("relation", F.lit("used in activity"))
    told = reference.join(t["mentions"], "ref").join(named, "r").withColumn("relation", F.lit("mentions"))
    columns = ["reference", "dependent", "relation"]
    return needs.select(*columns).unionByName(used.select(*columns)).unionByName(told.select(*columns)).distinct()


def scope_gaps(t: T) -> DataFrame:
    """CQ13: resources that ought to have a scope and neither have one nor inherit one."""
    scoped = t["scope"].select("r").distinct()
    found = t["resource_class"].where(F.col("cls").isin(*SCOPED)).join(t["resource"].select("r", "parent"), "r")
    found = found.join(scoped, "r", "left_anti").join(scoped.withColumnRenamed("r", "parent"), "parent", "left_anti")
    return found.join(names(t), "r").select(F.col("shown").alias("name"), F.col("cls").alias("class")).distinct()


def coverage(t: T) -> DataFrame:
    """CQ14: concepts that resources claim to cover, by dimension."""
    found = t["scope_dimension"].join(t["scope"].select("scope", "r"), "scope")
    dimension = F.coalesce("label", F.regexp_replace("dimension", "^.*appliesTo", ""))
    return found.groupBy(dimension.alias("dimension"), F.regexp_replace("concept", "^.*/", "").alias("concept")).agg(F.count_distinct("r").alias("resources"))


def machine_statements(t: T) -> DataFrame:
    """CQ15: statements of machine agents, the text that anchors them, and whether they were reviewed."""
    found = t["statement"].where("machine").join(t["resource"].select("r", "name"), "r", "left")
    return found.select(F.coalesce("name", F.concat(F.lit("ex:"), "r")).alias("subject"), "property", "value", "quote", "sentence", "agent", "review")


def interfaces(t: T) -> DataFrame:
    """CQ16: what resources expect and return."""
    found = t["io"].where("io_name is not null").join(_named(t), "r").join(t["io_constraint"], "spec", "left")
    return found.select("resource", "direction", F.col("io_name").alias("io"), "format", "modality", "required", "limits")


def failure_modes(t: T) -> DataFrame:
    """CQ17: failure modes, how severe and how silent they are."""
    return t["failure"].where("statement is not null").join(_named(t), "r").select("resource", "statement", "condition", "symptom", "silent", "severity", "mitigation")


def completeness(t: T) -> DataFrame:
    """CQ18: how complete each record is, what was not found, and whether it was reviewed."""
    found = t["record"].join(_named(t), "r").join(t["record_missing"], "rec", "left")
    return found.groupBy("resource", "completeness", F.col("review").alias("review_status")).agg(listed(F.coalesce("field", F.lit("")), ", ").alias("not_found"))


def attesting_works(t: T) -> DataFrame:
    """CQ19: works that attest each resource, and where in them."""
    places = t["attested_at"].join(t["locator"].where("place is not null"), "loc").select("r", "work", "place").distinct()
    found = t["referenced_by"].join(_named(t), "r").join(t["work"], "work", "left").join(places, ["r", "work"], "left")
    return found.groupBy("resource", F.coalesce("title", F.concat(F.lit("work:"), "work")).alias("work"), "doi").agg(listed(F.coalesce("place", F.lit("")), ", ").alias("locations"))


def timeline(t: T) -> DataFrame:
    """CQ20: versions, changes and observations of each resource in one table."""
    named, blank = _named(t), F.lit("")
    columns = ["resource", "when", "kind", "what", "source"]
    when = lambda c: F.coalesce(F.col(c).cast("string"), blank).alias("when")
    versions = t["release"].where("version is not null").join(named, "r").select("resource", when("released"), F.lit("version").alias("kind"), F.col("version").alias("what"), blank.alias("source"))
    changed = t["resource_change"].withColumnRenamed("kind", "change_kind").join(named, "r").select("resource", when("moment"), F.lit("change").alias("kind"), F.coalesce("change_kind", F.lit("change")).alias("what"), blank.alias("source"))
    seen = t["observation"].join(named, "r").select("resource", when("moment"), F.lit("observation").alias("kind"), F.concat_ws(" = ", "property", "value").alias("what"), F.coalesce("source", blank).alias("source"))
    return versions.unionByName(changed).unionByName(seen).select(*columns)


def problems(t: T) -> DataFrame:
    """CQ21: identifiers that don't resolve, and verified values that their source contradicts."""
    blank = F.lit("")
    ends = [F.coalesce("source", blank).alias("source"), F.coalesce(F.col("moment").cast("string"), blank).alias("when")]
    lost = t["resolution"].where("status != 'resolved'").select(F.lit("unresolved identifier").alias("problem"), F.col("identifier").alias("subject"), F.concat("status", F.lit(" via "), "route").alias("detail"), *ends)
    wrong = t["verification"].where("outcome = 'mismatch'").join(_named(t), "r").select(F.lit("metadata mismatch").alias("problem"), F.col("resource").alias("subject"), F.concat(F.lit("extracted "), "asserted", F.lit(" but source gives "), "actual").alias("detail"), *ends)
    return lost.unionByName(wrong)
