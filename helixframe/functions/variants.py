"""Column expressions over variants, their annotations and tool outputs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ("chrom", "pos", "ref", "alt")

# Words that decide a trait's category, first match first.
HEALTH_WORDS = (
    "disease", "disorder", "cancer", "carcinoma", "diabetes", "asthma",
    "obesity", "hypertension", "schizophrenia", "alzheimer", "parkinson",
    "stroke", "arthritis", "lupus", "sclerosis", "epilepsy", "depression",
    "anxiety", "autism", "adhd", "bipolar", "anemia", "fibrosis",
    "cardiovascular", "coronary", "atrial", "heart failure",
)
BIOMARKER_WORDS = (
    "level", "concentration", "count", "ratio", "volume", "pressure",
    "cholesterol", "triglyceride", "glucose", "bmi", "body mass",
    "hemoglobin", "platelet", "creatinine", "urate",
)

# Where a population label may and may not come from.
GOOD_POPULATION_SOURCES = ("pca", "pca_clustering", "genetic_pca")
BAD_POPULATION_SOURCES = ("self_reported", "self-reported", "ehr", "survey")


def with_chr(chrom: Column) -> Column:
    return F.when(chrom.startswith("chr"), chrom).otherwise(F.concat(F.lit("chr"), chrom))


def without_chr(chrom: Column) -> Column:
    return F.regexp_replace(chrom, "^chr", "")


def variant_key(*parts: str) -> Column:
    return F.concat_ws(":", *(F.col(p).cast("string") for p in parts or KEY))


def is_snv(ref: str = "ref", alt: str = "alt") -> Column:
    return (F.length(ref) == 1) & (F.length(alt) == 1)


def is_biallelic_acgt(ref: str = "ref", alt: str = "alt") -> Column:
    return F.col(ref).rlike("^[ACGT]$") & F.col(alt).rlike("^[ACGT]$")


def passes(filters: Column) -> Column:
    """FILTER is empty (null or a dot) or names PASS."""
    return filters.isNull() | filters.isin("", ".") | F.array_contains(F.split(filters, ";"), "PASS")


def splice_impact(score: Column) -> Column:
    return F.when(score.isNull(), "not_found").when(score >= 0.5, "high").when(score >= 0.2, "moderate").otherwise("low")


def llr_class(llr: Column) -> Column:
    return F.when(llr.isNull(), "not_found").when(llr <= -3, "deleterious").when(llr >= 0, "benign").otherwise("uncertain")


def pathogenicity_class(score: Column) -> Column:
    return F.when(score.isNull(), "not_found").when(score < 0.34, "likely_benign").when(score > 0.564, "likely_pathogenic").otherwise("ambiguous")


def msi_status(percent: Column) -> Column:
    return F.when(percent >= 20, "MSI-H").when(percent >= 10, "MSI-L").otherwise("MSS")


def is_interesting(classification: Column) -> Column:
    """Contains "athogenic" as written, or "uncertain" in either case."""
    return classification.contains("athogenic") | F.lower(classification).contains("uncertain")


def trait_category(trait: Column) -> Column:
    low = F.lower(trait)
    return F.when(low.rlike("|".join(HEALTH_WORDS)), "health").when(low.rlike("|".join(BIOMARKER_WORDS)), "biomarker").otherwise("trait")


def is_autosomal_snp(chrom: Column, ref: str = "ref", alt: str = "alt") -> Column:
    """One base for another on chromosomes 1 to 22."""
    return is_biallelic_acgt(ref, alt) & without_chr(chrom).isin(*map(str, range(1, 23)))


def valid_phenotype_term(term: Column) -> Column:
    return term.rlike(r"^HP:\d{7}$")


def require_phenotype_terms(df: DataFrame, term: str) -> DataFrame:
    """df, or an error that names up to ten invalid terms, or that there are none."""
    bad = df.where(~F.coalesce(valid_phenotype_term(F.col(term)), F.lit(False))).select(term).limit(10).collect()
    if bad:
        raise ValueError(f"invalid terms: {', '.join(str(r[0]) for r in bad)}")
    if df.isEmpty():
        raise ValueError("no terms")
    return df


def biallelic_sites(df: DataFrame) -> DataFrame:
    """Autosomal single-base variants at sites with one alternative allele, with their id."""
    sites = df.groupBy("chrom", "pos", "ref").agg(F.count_distinct("alt").alias("__n"), F.min("alt").alias("alt")).where("__n = 1").drop("__n")
    return sites.where(is_autosomal_snp(F.col("chrom"))).withColumn("variant_id", variant_key())


def population_source_passes(source: Column) -> Column:
    low = F.lower(source)
    return F.when(source.isNull(), False).when(low.isin(*GOOD_POPULATION_SOURCES), True).when(low.isin(*BAD_POPULATION_SOURCES), False).otherwise(True)


def shifted_position(pos: Column, offset: int = 1_847_983) -> Column:
    """hg19 to hg38 at the one locus where the offset is constant."""
    return pos + offset


def functional_label(func_class: Column, include_intermediate: bool = True) -> Column:
    """1 for LOF, else 0; null for a missing class, and for classes other than LOF and FUNC unless these are included."""
    name = F.upper(F.trim(func_class))
    label = (name == "LOF").cast("int")
    return label if include_intermediate else F.when(name.isin("LOF", "FUNC"), label)


def sorted_genotype(alleles: Column) -> Column:
    return F.array_join(F.array_sort(alleles), "")


def called_alleles(gt: Column, ref: Column, alts: Column) -> Column:
    """Alleles of a genotype call such as 0/1; null if any is missing."""
    index = F.split(gt, "[/|]")
    pool = F.concat(F.array(ref), alts)
    return F.when(F.exists(index, lambda i: ~i.rlike(r"^\d+$")), None).otherwise(F.transform(index, lambda i: F.try_element_at(pool, F.expr("1") + i.try_cast("int"))))


SPLICE_INFO = r"SpliceAI=([^|;]*)\|([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|([^|;,]*)"


def splice_field(info: Column, n: int) -> Column:
    """Field n, from 1, of the entry after SpliceAI=: allele, symbol, four scores, four places."""
    return F.regexp_extract(info, SPLICE_INFO, n)


def splice_score(info: Column) -> Column:
    """Largest of the four delta scores; a missing one counts as 0; null without an entry."""
    deltas = [F.coalesce(splice_field(info, n).try_cast("double"), F.lit(0.0)) for n in (3, 4, 5, 6)]
    return F.when(splice_field(info, 0) != "", F.greatest(*deltas))


def csq_fields(header: str) -> list[str]:
    """Names of the fields of transcript strings, from the header line that describes CSQ; none without a format."""
    described = re.search(r'\bFormat:\s*([\w|]+)', header)
    return described[1].split("|") if described else []


def csq_entries(info: Column, fields: list[str]) -> Column:
    """Transcripts of an INFO column as an array of maps from field to text; null without any."""
    blob = F.regexp_extract(info, r"(?:^|;)CSQ=([^;]*)", 1)
    names = F.array(*map(F.lit, fields))
    entry = lambda t: F.map_from_arrays(F.slice(names, 1, F.least(F.size(F.split(t, r"\|")), F.lit(len(fields)))), F.slice(F.split(t, r"\|"), 1, len(fields)))
    return F.when(blob != "", F.transform(F.split(blob, ","), entry))


def protein_change(amino_acids: Column, position: Column) -> Column:
    """REF start ALT from "A/B" and "10-12"; null without a change or a position."""
    parts = F.split(amino_acids, "/")
    start = F.split(position, "-")[0]
    usable = amino_acids.contains("/") & (F.size(parts) == 2) & (F.trim(start) != "")
    return F.when(usable, F.concat(parts[0], start, parts[1]))


def mutation_parts(mutation: Column) -> Column:
    """"A1T" as a struct of wild type, position, mutant."""
    part = lambda n: F.regexp_extract(mutation, r"^([A-Z])(\d+)([A-Z*])$", n)
    return F.when(part(0) != "", F.struct(part(1).alias("wild"), part(2).try_cast("int").alias("position"), part(3).alias("mutant")))


def interval_text(estimate: Column, low: Column, high: Column) -> Column:
    return F.format_string("%.3f (%.3f–%.3f)", estimate, low, high)


def task_id(name: Column, config: Column) -> Column:
    return F.when(config == "default", name).otherwise(F.concat_ws("/", name, config))


def logit(p: Column) -> Column:
    clipped = F.least(F.greatest(p, F.lit(1e-10)), F.lit(1 - 1e-10))
    return F.ln(clipped / (1 - clipped))


def component_count(n_pcs: Column, n_snps: Column) -> Column:
    return F.least(n_pcs, F.greatest(F.lit(2), F.floor(n_snps / 10)))


def parsed_date(text: Column, formats: tuple[str, ...] = ("yyyy-MM-dd", "MMM dd, yyyy", "yyyy/MM/dd", "yyyyMMdd")) -> Column:
    """The date by the first format that fits, else null."""
    return F.coalesce(*(F.to_date(F.try_to_timestamp(text, F.lit(f))) for f in formats))


def hash_uniform(*parts: Column) -> Column:
    """A number in [0, 1) from a digest of the parts: the same in every run and engine."""
    digest = F.md5(F.concat_ws(":", *(p.cast("string") for p in parts)))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0


def draw_order(ident: Column, seed: int = 42) -> Column:
    """What a seeded random order sorts by."""
    return F.md5(F.concat(ident.cast("string"), F.lit(f":{seed}")))
