"""Variants against curated genotypes, reference panels and mutational signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from helixframe.operators.joins import first_by_key

#: Effects that say nothing about a gene's product.
DISTANT = ("UPSTREAM", "DOWNSTREAM", "INTERGENIC")
#: Entries (signature, context) that a catalogue may have; it goes to every task.
MOST_ENTRIES = 200_000
#: Counts and weights that a task fits at a time.
BATCH_NUMBERS = 1 << 17


def _letters(genotype: Column) -> Column:
    return F.array_join(F.array_sort(F.split(genotype, "")), "")


def interpret_genotypes(genotypes: DataFrame, curated: DataFrame) -> DataFrame:
    """Own columns and interpretation of the genotypes that are curated, by rsid or else by place.

    genotypes: rsid, chrom, pos, genotype. curated: rsid, chrom, pos, effect, texts (map from genotype to text). The text
    of the genotype counts, its letters in any order; else the entry's effect; else the genotype itself.
    """
    entry = F.struct("effect", "texts")
    by_id = first_by_key(curated.where("rsid IS NOT NULL"), ["rsid"], ["chrom", "pos"]).select("rsid", entry.alias("__id"))
    by_place = first_by_key(curated, ["chrom", "pos"], ["rsid"]).select("chrom", "pos", entry.alias("__place"))
    found = genotypes.join(by_id, "rsid", "left").join(by_place, ["chrom", "pos"], "left").withColumn("__e", F.coalesce("__id", "__place")).where("__e IS NOT NULL")
    same = F.filter(F.map_entries("__e.texts"), lambda e: _letters(e["key"]) == _letters(F.col("genotype")))
    text = F.coalesce(F.try_element_at(same, F.lit(1))["value"], F.col("__e.effect"), F.concat(F.lit("Genotype: "), "genotype"))
    return found.select(*genotypes.columns, text.alias("interpretation"))


def panel_overlap(variants: DataFrame, panel: DataFrame, least: int = 100) -> DataFrame:
    """One row (n_variants, n_panel, n_shared, enough) of distinct positions."""
    own = variants.select("chrom", "pos", F.lit(1).alias("v"), F.lit(0).alias("p"))
    sides = own.unionByName(panel.select("chrom", "pos", F.lit(0).alias("v"), F.lit(1).alias("p"))).groupBy("chrom", "pos").agg(F.max("v").alias("v"), F.max("p").alias("p"))
    counts = sides.agg(F.count_if(F.col("v") == 1).alias("n_variants"), F.count_if(F.col("p") == 1).alias("n_panel"), F.count_if((F.col("v") == 1) & (F.col("p") == 1)).alias("n_shared"))
    return counts.withColumn("enough", F.col("n_shared") >= least)


def require_overlap(variants: DataFrame, panel: DataFrame, least: int = 100) -> DataFrame:
    """The row of panel_overlap, or an error if fewer than `least` positions are shared."""
    found = panel_overlap(variants, panel, least)
    row = found.first()
    if not row["enough"]:
        raise ValueError(f"{row['n_shared']} shared positions; at least {least} are needed")
    return found


def prioritise(df: DataFrame, effect: str, frequencies: list[str], most: float = 0.01) -> DataFrame:
    """Rows of effects near a gene whose largest known frequency is at most `most`; unknown frequencies are rare."""
    largest = F.greatest(*(F.coalesce(F.col(c), F.lit(0.0)) for c in [*frequencies, frequencies[0]]))
    return df.where(~F.coalesce(F.col(effect), F.lit("")).isin(*DISTANT) & (largest <= most))


def fit_signatures(spectra: DataFrame, catalogue: DataFrame, sample: str = "sample", rounds: int = 2000) -> DataFrame:
    """(sample, signature, count): non-negative weights of the signatures whose sum is nearest to a sample's spectrum.

    spectra: sample, context, n (summed by context; contexts not in the catalogue are left out). catalogue: signature,
    context, share. A sample's entries are as many as the contexts, and a task fits some thousand samples at a time, as a
    matrix of BATCH_NUMBERS numbers.
    """
    entries = catalogue.groupBy("signature", "context").agg(F.sum("share").alias("share")).limit(MOST_ENTRIES + 1).collect()
    if len(entries) > MOST_ENTRIES:
        raise ValueError(f"a catalogue may have {MOST_ENTRIES} entries")
    names, contexts = sorted({e["signature"] for e in entries}), sorted({e["context"] for e in entries})
    number = {c: i for i, c in enumerate(contexts)}
    shares = np.zeros((len(contexts), len(names)))
    for e in entries:
        shares[number[e["context"]], names.index(e["signature"])] = e["share"]

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, step):
                batch = whole.slice(first, step)
                lists = batch.column("__e")
                row = np.repeat(np.arange(batch.num_rows), np.asarray(lists.value_lengths()))
                at, n = (lists.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("at", "n"))
                counts = np.zeros((batch.num_rows, len(contexts)))
                counts[row, at] = n.astype(np.float64)
                weights = np.repeat(counts.sum(1, keepdims=True) / max(1, len(names)), len(names), axis=1)
                wanted = counts @ shares
                for _ in range(rounds):
                    weights *= wanted / np.maximum((weights @ shares.T) @ shares, 1e-12)
                owner = pa.array(np.repeat(np.arange(batch.num_rows), len(names)))
                yield pa.RecordBatch.from_arrays([batch.column(sample).take(owner), pa.array(names * batch.num_rows, pa.string()), pa.array(weights.ravel())], [sample, "signature", "count"])

    step = max(1, BATCH_NUMBERS // max(1, len(contexts) + len(names)))
    places = spectra.sparkSession.createDataFrame(list(number.items()), "context string, __at int")  # MOST_ENTRIES rows at most
    summed = spectra.join(F.broadcast(places), "context").groupBy(sample, "__at").agg(F.sum("n").cast("double").alias("n"))
    rows = summed.groupBy(sample).agg(F.collect_list(F.struct(F.col("__at").alias("at"), "n")).alias("__e"))
    schema = StructType([StructField(sample, spectra.schema[sample].dataType), StructField("signature", StringType()), StructField("count", DoubleType())])
    return rows.mapInArrow(fit, schema)
