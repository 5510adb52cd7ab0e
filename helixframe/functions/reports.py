"""Flattening of tool reports: JSON documents, key-value text and typing tables as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVIDENCE = "struct<variants:array<struct<name:string,molecular_profiles:array<struct<evidence_items:array<struct<id:bigint,status:string,level:string,evidence_type:string>>>>>>>"


def first_path(json: Column, *paths: str) -> Column:
    """The first of several places in a JSON text that holds something."""
    return F.coalesce(*(F.get_json_object(json, p) for p in paths))


# Where reports keep their drugs, first place that holds something first.
DRUG_PATHS = ("$.drugs", "$.prescribingGuidanceReports", "$.drugReports")
#: Characters of a recommendation that are kept.
ADVICE_CHARS = 500


def entries_of(json: Column, paths: tuple[str, ...]) -> Column:
    """The entries of the first place that isn't an empty list, each as JSON text."""
    filled = [F.when(F.json_array_length(F.get_json_object(json, p)) > 0, F.get_json_object(json, p)) for p in paths]
    return F.from_json(F.coalesce(*filled), "array<string>")


def diplotype_calls(reports: DataFrame, paths: tuple[str, ...], json: str = "report") -> DataFrame:
    """(own columns, gene, diplotype, activity_score, phenotype) of every called locus of pharmacogenomic reports.

    paths: where reports keep their calls, first place that holds something first; tools and their versions differ in it.

    The diplotype is the first of recommendationDiplotypes; where that is an empty list, the call's own diplotype or
    printDiplotype. Without the list the diplotype is empty. Calls without a name are left out.
    """
    own = [c for c in reports.columns if c != json]
    rows = reports.select(*own, F.explode(entries_of(F.col(json), paths)).alias("g"))
    at = lambda path: F.get_json_object("g", path)
    none = F.json_array_length(at("$.recommendationDiplotypes")) == 0
    diplotype = F.when(none, F.coalesce(at("$.diplotype"), at("$.printDiplotype"))).otherwise(at("$.recommendationDiplotypes[0].label"))
    activity = F.when(none, at("$.activityScore")).otherwise(at("$.recommendationDiplotypes[0].activityScore"))
    gene = F.coalesce(at("$.gene"), at("$.geneSymbol"))
    found = rows.select(*own, gene.alias("gene"), F.coalesce(diplotype, F.lit("")).alias("diplotype"), activity.alias("activity_score"), F.coalesce(at("$.phenotype"), at("$.phenotypes.term"), F.lit("")).alias("phenotype"))
    return found.where(F.col("gene") != "")


def drug_recommendations(reports: DataFrame, json: str = "report") -> DataFrame:
    """(own columns, drug, source, classification, recommendation) of every drug; recommendations are cut to ADVICE_CHARS."""
    own = [c for c in reports.columns if c != json]
    rows = reports.select(*own, F.explode(entries_of(F.col(json), DRUG_PATHS)).alias("d"))
    at = lambda *paths: F.coalesce(*(F.get_json_object("d", p) for p in paths), F.lit(""))
    found = rows.select(*own, at("$.drug", "$.drugName").alias("drug"), at("$.source").alias("source"), at("$.classification").alias("classification"), F.substring(at("$.recommendation", "$.prescribingInfo"), 1, ADVICE_CHARS).alias("recommendation"))
    return found.where(F.col("drug") != "")


def star_alleles(reports: DataFrame, json: str = "report") -> DataFrame:
    """(own columns, sample, diplotype, genotype, activity_score, phenotype, filter) of the first sample of each report;
    a missing diplotype is "No call", a missing filter "PASS", a missing genotype or phenotype empty."""
    own = [c for c in reports.columns if c != json]
    entries = F.map_entries(F.from_json(F.col(json), "map<string,struct<Diplotype:string,Genotype:string,Activity_Score:string,Phenotype:string,Filter:string>>"))
    first = F.try_element_at(entries, F.lit(1))
    rows = reports.select(*own, first.alias("e")).where(F.col("e").isNotNull())
    field = lambda name, default: F.coalesce(F.col(f"e.value.{name}"), F.lit(default))
    return rows.select(
        *own,
        F.col("e.key").alias("sample"),
        field("Diplotype", "No call").alias("diplotype"),
        field("Genotype", "").alias("genotype"),
        F.col("e.value.Activity_Score").alias("activity_score"),
        field("Phenotype", "").alias("phenotype"),
        field("Filter", "PASS").alias("filter"),
    )


def hla_types(lines: DataFrame, by: str, order: str) -> DataFrame:
    """(by, types map from locus to both alleles, n_loci) of rows (locus, allele_1, allele_2); a later row of a locus wins."""
    last = lines.groupBy(by, "locus").agg(F.max_by(F.array("allele_1", "allele_2"), order).alias("alleles"))
    return last.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("locus", "alleles")))).alias("types"), F.count("*").alias("n_loci"))


def two_fields(allele: Column) -> Column:
    return F.substring_index(F.regexp_replace(allele, r"^HLA-", ""), ":", 2)


def hla_concordance(truth: DataFrame, calls: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Share of typed loci whose two alleles agree to two fields, in either order."""
    pair = F.array_sort(F.array(two_fields(F.col("allele_1")), two_fields(F.col("allele_2"))))
    t, c = truth.select(*keys, pair.alias("__t")), calls.select(*keys, pair.alias("__c"))
    return t.join(c, keys, "left").groupBy(*by).agg(F.avg(F.coalesce(F.col("__t") == F.col("__c"), F.lit(False)).cast("double")).alias("concordance"), F.count("*").alias("n"))


def key_values(lines: DataFrame, value: str = "value") -> DataFrame:
    """(own columns, key, text) of lines "key<tab>text" or "key: text"; a tab separates first, a colon after the key is dropped."""
    own = [c for c in lines.columns if c != value]
    part = lambda n: F.trim(F.regexp_extract(value, r"^\s*([^\t:]+?)\s*(?::\s*\t|\t|:)([^\t]*)", n))
    return lines.select(*own, part(1).alias("key"), part(2).alias("text")).where("key <> ''")


def tumour_fractions(lines: DataFrame, by: str) -> DataFrame:
    """(by, tumour_fraction, ploidy, warning): a fraction that is no number is warned of, such a ploidy is left out."""
    pairs = key_values(lines)
    one = lambda k: F.max(F.when(F.col("key") == k, F.col("text")))
    rows = pairs.groupBy(by).agg(one("Tumor Fraction").alias("f"), one("Ploidy").alias("p"))
    number = F.col("f").try_cast("double")
    return rows.select(by, number.alias("tumour_fraction"), F.col("p").try_cast("double").alias("ploidy"), (F.col("f").isNotNull() & number.isNull()).alias("warning"))


def accepted_evidence(reports: DataFrame, json: str = "report") -> DataFrame:
    """(own columns, state, n_accepted, best_level): accepted items of all variants and profiles of a report."""
    own = [c for c in reports.columns if c != json]
    parsed = F.from_json(F.col(json), EVIDENCE)
    profiles = F.flatten(F.transform(parsed["variants"], lambda v: F.coalesce(v["molecular_profiles"], F.array())))
    items = F.flatten(F.transform(profiles, lambda p: F.coalesce(p["evidence_items"], F.array())))
    accepted = F.filter(items, lambda e: F.lower(e["status"]) == "accepted")
    rows = reports.select(*own, F.coalesce(F.size(parsed["variants"]), F.lit(0)).alias("v"), accepted.alias("a"))
    state = F.when(F.col("v") <= 0, "not_found").when(F.size("a") > 0, "found").otherwise("no_accepted_evidence")
    return rows.select(*own, state.alias("state"), F.greatest(F.size("a"), F.lit(0)).alias("n_accepted"), F.array_min("a.level").alias("best_level"))
