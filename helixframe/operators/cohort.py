"""Jobs over many samples: polygenic scores, spectra, clocks, read coverage, call statistics, actionability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def polygenic_scores(genotypes: DataFrame, weights: DataFrame, by: list[str] | None = None) -> DataFrame:
    """score_sum, score_avg (over alleles) and n_variants of each sample (and trait, if the weights have one).

    Where the weights name an effect allele that is the reference, the dosage counts from the other side.
    """
    joined = genotypes.join(weights, "variant_id")
    dosage = F.when(F.col("flipped"), 2 - F.col("dosage")).otherwise(F.col("dosage")) if "flipped" in weights.columns else F.col("dosage")
    total = F.sum(dosage * F.col("weight"))
    return joined.groupBy("sample_id", *(by or [])).agg(total.alias("score_sum"), (total / (2 * F.count("*"))).alias("score_avg"), F.count("*").alias("n_variants"))


def minor_allele_frequency(genotypes: DataFrame, n_samples: int | Column, least: float = 0.05) -> DataFrame:
    f = F.sum("dosage").cast("double") / (2 * n_samples)
    rows = genotypes.groupBy("variant_id").agg(f.alias("alt_frequency"))
    return rows.withColumn("maf", F.least(F.col("alt_frequency"), 1 - F.col("alt_frequency"))).where(F.col("maf") >= least)


def mutation_spectrum(variants: DataFrame, sample: str, context: str = "context") -> DataFrame:
    """(sample, channel, n): single-base changes with their neighbours, folded to the pyrimidine strand."""
    flip = lambda c: F.translate(c, "ACGT", "TGCA")
    purine = F.col("ref").isin("A", "G")
    ref, alt = F.when(purine, flip(F.col("ref"))).otherwise(F.col("ref")), F.when(purine, flip(F.col("alt"))).otherwise(F.col("alt"))
    around = F.when(purine, F.reverse(flip(F.col(context)))).otherwise(F.col(context))
    channel = F.concat(F.substring(around, 1, 1), F.lit("["), ref, F.lit(">"), alt, F.lit("]"), F.substring(around, 3, 1))
    usable = variants.where(F.col("ref").rlike("^[ACGT]$") & F.col("alt").rlike("^[ACGT]$") & (F.col("ref") != F.col("alt")) & F.col(context).rlike("^[ACGT]{3}$"))
    return usable.groupBy(sample, channel.alias("channel")).agg(F.count("*").alias("n"))


def dinucleotide_spectrum(variants: DataFrame, sample: str) -> DataFrame:
    """(sample, channel, n): changes of two bases at once, each by the smaller of itself and its other strand."""
    flip = lambda c: F.reverse(F.translate(c, "ACGT", "TGCA"))
    usable = variants.where(F.col("ref").rlike("^[ACGT]{2}$") & F.col("alt").rlike("^[ACGT]{2}$") & (F.substring("ref", 1, 1) != F.substring("alt", 1, 1)) & (F.substring("ref", 2, 1) != F.substring("alt", 2, 1)))
    channel = F.least(F.concat("ref", F.lit(">"), "alt"), F.concat(flip(F.col("ref")), F.lit(">"), flip(F.col("alt"))))
    return usable.groupBy(sample, channel.alias("channel")).agg(F.count("*").alias("n"))


def indel_spectrum(variants: DataFrame, sample: str) -> DataFrame:
    """(sample, channel, n): insertions and deletions by their length, 5 and more together, and by the base (C or T) of those of one."""
    size = F.length("alt") - F.length("ref")
    piece = F.when(size > 0, F.substring("alt", 2, 1)).otherwise(F.substring("ref", 2, 1))
    base = F.when(F.abs(size) > 1, "N").when(piece.isin("C", "G"), "C").otherwise("T")
    channel = F.concat_ws(":", F.when(size > 0, "Ins").otherwise("Del"), F.least(F.abs(size), F.lit(5)).cast("string"), base)
    return variants.where(F.col("ref").rlike("^[ACGT]+$") & F.col("alt").rlike("^[ACGT]+$") & (size != 0)).groupBy(sample, channel.alias("channel")).agg(F.count("*").alias("n"))


def scores_with_warnings(scores: DataFrame, wanted: DataFrame) -> DataFrame:
    """scores with a row for each wanted trait that has none: no score, and a warning."""
    known = scores.select("trait").distinct()
    missing = wanted.join(known, "trait", "left_anti").select("trait", F.concat(F.lit("no weights for "), "trait").alias("warning"))
    return scores.withColumn("warning", F.lit(None).cast("string")).unionByName(missing, allowMissingColumns=True)


def structural_summary(df: DataFrame, kind: str, classification: str, gene: str) -> DataFrame:
    """(part, name, n): counts by kind, by class that isn't empty, of pathogenic rows, and of their distinct loci names.
    Pathogenic are pathogenic and likely_pathogenic, or with a space or capital."""
    bad = F.lower(F.replace(F.col(classification), F.lit(" "), F.lit("_"))).isin("pathogenic", "likely_pathogenic")
    mark = lambda part, name, inside: F.struct(F.lit(part).alias("part"), name.alias("name"), inside.alias("in"))
    marks = F.array(
        mark("all", F.lit(""), F.lit(True)),
        mark("type", F.col(kind), F.col(kind).isNotNull()),
        mark("class", F.col(classification), F.coalesce(F.col(classification) != "", F.lit(False))),
        mark("pathogenic", F.lit(""), F.coalesce(bad, F.lit(False))),
    )
    counts = df.select(F.explode(marks).alias("m")).where("m.in").groupBy("m.part", "m.name").agg(F.count("*").alias("n"))
    loci = df.where(bad).agg(F.count_distinct(gene).alias("n")).select(F.lit("pathogenic loci").alias("part"), F.lit("").alias("name"), "n")
    return counts.unionByName(loci)


# Spellings of a pathogenic class in tables of copy-number variants.
PATHOGENIC_SPELLINGS = ("Pathogenic", "Likely pathogenic", "pathogenic", "likely_pathogenic")
#: Columns of these tables by what they hold, in lower case; callers add the names that their files have.
CNV_COLUMNS = {"gene": ("gene", "gene_name"), "type": ("type", "cnv_type", "sv_type")}


def cnv_summary(df: DataFrame, columns: dict[str, tuple[str, ...]] = CNV_COLUMNS) -> DataFrame:
    """(part, name, n) of a table of classified copy-number variants: all, by Classification, pathogenic in four
    spellings, their distinct loci, and by type; columns are found by name in any case, parts without theirs are left out."""
    column = lambda what: next((c for c in df.columns if c.lower() in columns[what]), None)
    parts = [("all", F.lit(""), F.lit(True))]
    if "Classification" in df.columns:
        parts += [("class", F.col("Classification"), F.lit(True)), ("pathogenic", F.lit(""), F.coalesce(F.col("Classification").isin(*PATHOGENIC_SPELLINGS), F.lit(False)))]
    if column("type"):
        parts.append(("type", F.col(column("type")), F.lit(True)))
    marks = F.array(*(F.struct(F.lit(p).alias("part"), n.alias("name"), i.alias("in")) for p, n, i in parts))
    out = df.select(F.explode(marks).alias("m")).where("m.in").groupBy("m.part", "m.name").agg(F.count("*").alias("n"))
    if "Classification" in df.columns and column("gene"):
        loci = df.where(F.col("Classification").isin(*PATHOGENIC_SPELLINGS)).agg(F.count_distinct(column("gene")).alias("n"))
        out = out.unionByName(loci.select(F.lit("pathogenic loci").alias("part"), F.lit("").alias("name"), "n"))
    return out


def clock_scores(betas: DataFrame, coefficients: DataFrame, ages: DataFrame | None = None) -> DataFrame:
    """predicted, n_probes and n_missing of every sample and clock; with ages, acceleration too."""
    size = coefficients.groupBy("clock").agg(F.count("*").alias("__all"))
    sums = betas.join(coefficients, "cpg").groupBy("sample_id", "clock").agg(F.sum(F.col("beta") * F.col("coefficient")).alias("predicted"), F.count("beta").alias("n_probes"))
    out = sums.join(size, "clock").withColumn("n_missing", F.col("__all") - F.col("n_probes")).drop("__all")
    return out if ages is None else out.join(ages, "sample_id", "left").withColumn("acceleration", F.round(F.col("predicted") - F.col("age"), 2))


def read_bins(reads: DataFrame, width: int = 1_000_000, lengths: DataFrame | None = None) -> DataFrame:
    """(chrom, bin, n): reads in fixed bins, with the empty ones. lengths (chrom, length): the chromosomes to count, each to
    its end; without it, every chromosome with reads, up to its last."""
    counts = reads.groupBy("chrom", F.floor(F.col("pos") / width).alias("bin")).agg(F.count("*").alias("n"))
    ends = counts.groupBy("chrom").agg(F.max("bin").alias("last")) if lengths is None else lengths.select("chrom", F.floor((F.col("length") - 1) / width).alias("last"))
    every = ends.select("chrom", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("bin"))
    return every.join(counts, ["chrom", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def site_coverage(covered: DataFrame, sites: DataFrame, by: str, window: int, central: int, read_length: int = 100) -> DataFrame:
    """One row (n_sites, mean_coverage, mean_central): reads a base near the sites and near their centres, in two places;
    sites without reads count. covered: the output of joins.near_sites."""
    each = covered.groupBy(by).agg(F.count("*").alias("__n"), F.count_if(F.abs("offset") <= central).alias("__c"))
    all_sites = sites.select(by).distinct().join(each, by, "left")
    per = lambda n, w: F.round(F.avg(F.coalesce(F.col(n), F.lit(0)) * read_length / F.lit(2 * w + 1)), 2)
    return all_sites.agg(F.count("*").alias("n_sites"), per("__n", window).alias("mean_coverage"), per("__c", central).alias("mean_central"))


def coverage_summary(covered: DataFrame, by: str, central: int) -> DataFrame:
    """n_reads, n_central and the mean distance of reads near each site."""
    return covered.groupBy(by).agg(F.count("*").alias("n_reads"), F.count_if(F.abs("offset") <= central).alias("n_central"), F.avg(F.abs("offset")).alias("mean_distance"))


def call_statistics(variants: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Records, SNVs, indels, passing records, transitions and transversions."""
    snv = (F.length("ref") == 1) & (F.length("alt") == 1) & (F.col("ref") != F.col("alt"))
    change = snv & F.concat("ref", "alt").isin("AG", "GA", "CT", "TC")
    return variants.groupBy(*(by or [])).agg(
        F.count("*").alias("records"),
        F.count_if(snv).alias("snvs"),
        F.count_if((F.length("ref") != 1) | (F.length("alt") != 1)).alias("indels"),
        F.count_if(F.col("filter").isNull() | (F.col("filter") == "PASS")).alias("passing"),
        F.count_if(change).alias("transitions"),
        F.count_if(snv & ~change).alias("transversions"),
    )


def het_hom_ratio(genotypes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, n_het, n_hom, ratio) of genotypes with another allele than the reference; alleles: an array of two. No
    homozygous ones give a null ratio."""
    a, b = F.col("alleles")[0], F.col("alleles")[1]
    other = (F.size("alleles") == 2) & ((a != F.col("ref")) | (b != F.col("ref")))
    counts = genotypes.groupBy(*(by or [])).agg(F.count_if(other & (a != b)).alias("n_het"), F.count_if(other & (a == b)).alias("n_hom"))
    return counts.withColumn("ratio", F.col("n_het").cast("double") / F.nullif(F.col("n_hom"), F.lit(0)))


def unstable_sites(sites: DataFrame, by: list[str], least_coverage: int = 20) -> DataFrame:
    """n_sites, n_unstable and percent over sites with enough coverage."""
    used = sites.where(F.col("coverage") >= least_coverage)
    return used.groupBy(*by).agg(F.count("*").alias("n_sites"), F.count_if("unstable").alias("n_unstable"), F.round(F.lit(100.0) * F.count_if("unstable") / F.count("*"), 2).alias("percent"))


def dominant(fractions: DataFrame, by: str, name: str, value: str) -> DataFrame:
    best = F.max(F.struct(F.col(value), F.col(name)))
    return fractions.groupBy(by).agg(best.alias("b")).select(by, F.col(f"b.{name}").alias("dominant"), F.col(f"b.{value}").alias("fraction"))


def actionability(evidence: DataFrame, by: list[str]) -> DataFrame:
    """Least evidence level, whether anything is therapeutic, and counts."""
    therapeutic = F.col("level").isNotNull() | (F.col("evidence_type") == "PREDICTIVE")
    return evidence.groupBy(*by).agg(F.min("level").alias("best_level"), F.bool_or(therapeutic).alias("therapeutic"), F.count_if(F.col("oncogenic")).alias("n_oncogenic"), F.count_if(therapeutic).alias("n_therapeutic"))


def top_share(df: DataFrame, by: str, name: str, value: str, n: int = 5) -> DataFrame:
    """The n largest of each group with their rank, total and number of those above 0."""
    w = Window.partitionBy(by)
    used = df.where(F.col(value) > 0).withColumns({"total": F.sum(value).over(w), "n_present": F.count("*").over(w), "rank": F.row_number().over(w.orderBy(F.col(value).desc(), name))})
    return used.where(F.col("rank") <= n)


def matched_controls(cases: DataFrame, controls: DataFrame, strata: list[str], ident: str, ratio: int, seed: int = 42) -> DataFrame:
    """Controls in each stratum, at most ratio times its cases, in seeded random order."""
    from helixframe.functions.variants import draw_order
    from helixframe.operators.splits import ranked

    wanted = cases.groupBy(*strata).agg((F.count("*") * ratio).alias("__wanted"))
    return ranked(controls.join(wanted, strata), strata, draw_order(F.col(ident), seed), [ident], F.col("__wanted")).drop("__at", "__n", "__wanted")
