"""Key joins to score tables and interval joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.variants import KEY, is_snv, protein_change, without_chr

#: Width of the narrowest bins that turn interval joins into key joins; each of LEVELS levels has bins STEP times as wide as
#: the one below, the widest over four thousand million bases.
BIN, STEP, LEVELS = 1 << 14, 8, 7
#: Rows of equal intervals that go to pairs together; and places of a bin of running sums.
CHUNK_ROWS, TOTAL_BIN = 256, 1 << 16
#: Into how many parts a category is dealt before its first rows meet.
PARTS = 64


def first_by_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def lookup(variants: DataFrame, scores: DataFrame, value: str = "score", keys: tuple[str, ...] = KEY) -> DataFrame:
    """Left join to a score table; of several scores for a key the least counts, and a miss is null."""
    one = scores.groupBy(*keys).agg(F.min(value).alias(value))
    return variants.join(one, list(keys), "left")


def annotate(variants: DataFrame, table: DataFrame, columns: list[str], order: list, keys: tuple[str, ...] = KEY) -> DataFrame:
    """Left join that adds several columns and status (found or not_found); of several entries for a key the first by
    `order` counts. A table's columns may be null where it has the key."""
    one = first_by_key(table, list(keys), order).select(*keys, *columns, F.lit("found").alias("status"))
    return variants.join(one, list(keys), "left").withColumn("status", F.coalesce("status", F.lit("not_found")))


def clinical_hits(records: DataFrame, index: DataFrame, columns: list[str], order: list) -> tuple[DataFrame, DataFrame]:
    """(alleles found in the index with its columns; one row n_queried, n_found). records: chrom, pos, ref, alts (an
    array), prefix of chrom or not; n_queried counts records, n_found alleles."""
    alleles = records.select(without_chr(F.col("chrom")).alias("chrom"), "pos", "ref", F.explode("alts").alias("alt"))
    one = first_by_key(index.withColumn("chrom", without_chr(F.col("chrom"))), list(KEY), order).select(*KEY, *columns)
    hits = alleles.join(one, list(KEY)).withColumn("status", F.lit("found"))
    counts = records.agg(F.count("*").alias("n_queried")).withColumn("n_found", hits.agg(F.count("*")).scalar())
    return hits, counts


def splice_scores(variants: DataFrame, snvs: DataFrame, indels: DataFrame, deltas: tuple[str, ...]) -> DataFrame:
    """Left join to the largest of the delta scores; a missing delta is 0. Single bases look in one table, all other
    variants in the other; both tables become one, so a variant moves once."""
    score = lambda t: F.greatest(*(F.coalesce(F.col(d), F.lit(0.0)) if d in t.columns else F.lit(0.0) for d in deltas))
    side = lambda t, snv: t.where(is_snv() if snv else ~is_snv()).select(*KEY, score(t).alias("score"))
    return lookup(variants, side(snvs, True).unionByName(side(indels, False)))


def in_regions(points: DataFrame, regions: DataFrame, chrom: str = "chrom", pos: str = "pos", start: str = "start", end: str = "end") -> DataFrame:
    """Points (1-based) inside some region (1-based, both ends inside)."""
    spans = regions.select(F.col(chrom).alias("__c"), (F.col(start) - 1).alias("bed_start"), F.col(end).alias("bed_end")).withColumnRenamed("__c", chrom)
    return in_intervals(points, spans, chrom, pos)


# Loci of drug response (GRCh38, 1-based, both ends inside).
DRUG_RESPONSE_REGIONS = (
    ("chr1", 97078528, 97110987),
    ("chr7", 99245817, 99277621),
    ("chr7", 99354604, 99464528),
    ("chr10", 94761900, 94853547),
    ("chr10", 94938658, 94990091),
    ("chr10", 94942205, 94989978),
    ("chr13", 48037580, 48070790),
    ("chr16", 31093097, 31110537),
    ("chr19", 38924339, 38947371),
    ("chr19", 15879372, 15884328),
    ("chr22", 42126499, 42130881),
    ("chr6", 18130809, 18232467),
    ("chr22", 42512500, 42551899),
)


def protein_changes(records: DataFrame, entries: Column) -> DataFrame:
    """(gene, change, pos, n): the distinct pairs of name and protein change of transcripts, each with its first position.
    entries: array of maps with SYMBOL, Amino_acids and Protein_position."""
    each = records.select("pos", F.explode(entries).alias("e"))
    rows = each.select("pos", F.col("e")["SYMBOL"].alias("gene"), protein_change(F.col("e")["Amino_acids"], F.col("e")["Protein_position"]).alias("change"))
    return rows.where((F.col("gene") != "") & F.col("change").isNotNull()).groupBy("gene", "change").agg(F.min("pos").alias("pos"), F.count("*").alias("n"))


def evidence_for(changes: DataFrame, *sources: DataFrame) -> DataFrame:
    """changes (gene, change) with a level_<i> and therapeutic_<i> of each evidence table (gene, change, level,
    therapeutic): its least level and whether anything is therapeutic; null where a table says nothing."""
    for i, source in enumerate(sources, 1):
        one = source.groupBy("gene", "change").agg(F.min("level").alias(f"level_{i}"), F.bool_or("therapeutic").alias(f"therapeutic_{i}"))
        changes = changes.join(one, ["gene", "change"], "left")
    return changes


def having_score(variants: DataFrame, scores: DataFrame | None, keys: tuple[str, ...] = KEY) -> DataFrame:
    """Variants that have a score; all of them if there is no table."""
    return variants if scores is None else variants.join(scores.select(*keys), list(keys), "left_semi")


def _level(length: Column) -> Column:
    """The lowest level whose bins are at least as wide as an interval: it touches two bins of it at most."""
    level = F.lit(0)
    for n in range(LEVELS - 1):
        level = level + (length > BIN * STEP**n).cast("int")
    return level


def _width(level: Column) -> Column:
    return F.lit(BIN).cast("long") * F.pow(F.lit(float(STEP)), level).cast("long")


def _bins(start: Column, end: Column, level: Column) -> Column:
    """The bins of a level that a half-open interval touches."""
    return F.sequence(F.floor(start / _width(level)), F.floor((end - 1) / _width(level)))


def in_intervals(points: DataFrame, intervals: DataFrame, chrom: str = "chrom", pos: str = "pos", start: str = "bed_start", end: str = "bed_end") -> DataFrame:
    """Points (1-based) inside some interval (0-based, half open).

    Intervals lie in the one or two bins that they touch at the level of their length, and a place looks in one bin of each
    level that occurs, so the join has a key of many values, and an interval over a whole chromosome costs as much as a
    short one. Each place is looked up once, however many points it has.
    """
    spans = intervals.where(F.col(end) > F.col(start)).select(F.col(chrom).alias("__c"), F.col(start).alias("__start"), F.col(end).alias("__end"), _level(F.col(end) - F.col(start)).alias("__level"))
    spans = spans.withColumn("__bin", F.explode(_bins(F.col("__start"), F.col("__end"), F.col("__level"))))
    places = points.where(F.col(chrom).isNotNull() & F.col(pos).isNotNull()).select(F.col(chrom).alias("__chrom"), F.col(pos).alias("__pos")).distinct()
    levels = spans.agg(F.collect_set("__level")).scalar()  # LEVELS numbers at most
    at = F.col("__pos") - 1
    probes = places.withColumn("__l", F.explode(levels)).withColumn("__b", F.floor(at / _width(F.col("__l"))))
    inside = (F.col("__chrom") == F.col("__c")) & (F.col("__l") == F.col("__level")) & (F.col("__b") == F.col("__bin")) & (at >= F.col("__start")) & (at < F.col("__end"))
    found = probes.join(spans, inside, "left_semi").select("__chrom", "__pos").distinct()
    return points.join(found, (F.col(chrom) == F.col("__chrom")) & (F.col(pos) == F.col("__pos")), "left_semi")


def _chunks(df: DataFrame, keys: list[str], p: str) -> DataFrame:
    """(p__c, p__s, p__e, p__rows): the rows of equal intervals in arrays of about CHUNK_ROWS."""
    names = {k: f"{p}__{short}" for k, short in zip(keys, "cse")}
    hashed = F.xxhash64(*(c for c in df.columns if "map<" not in df.schema[c].dataType.simpleString()))
    rows = df.select(*(F.col(k).alias(n) for k, n in names.items()), hashed.alias("__h"), F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("__r"))
    sizes = rows.groupBy(*names.values()).agg(F.ceil(F.count("*") / CHUNK_ROWS).alias("__k"))
    return rows.join(sizes, list(names.values())).groupBy(*names.values(), F.pmod("__h", "__k").alias(f"{p}__k")).agg(F.collect_list("__r").alias(f"{p}__rows"))


def overlapping(left: DataFrame, right: DataFrame, chrom: str, start: str, end: str, only: Column | None = None) -> DataFrame:
    """Pairs of intervals that overlap (half open), columns prefixed a_ and b_, each pair once; `only`, over the prefixed
    chrom, start and end, leaves out pairs.

    Distinct intervals meet, and their rows follow as chunks: a pair of chunks is dealt to any task, so copies cost what
    they give, in even tasks. A pair meets at the level of its longer interval: each side is stored at its own level, in
    two bins at most, and looks in two bins at most of each higher level, so an interval makes a bounded number of rows
    whatever its length.
    """
    keys = [chrom, start, end]
    proper = lambda df: df.where(F.col(chrom).isNotNull() & (F.col(end) > F.col(start)))
    own = lambda df, p: proper(df).select(*(F.col(c).alias(f"{p}_{c}") for c in keys)).distinct().withColumn(f"{p}__level", _level(F.col(f"{p}_{end}") - F.col(f"{p}_{start}")))
    a, b = own(left, "a"), own(right, "b")

    def at_level(df: DataFrame, p: str, level: Column) -> DataFrame:
        return df.withColumn(f"{p}__at", level).withColumn(f"{p}__bin", F.explode(_bins(F.col(f"{p}_{start}"), F.col(f"{p}_{end}"), F.col(f"{p}__at"))))

    higher = lambda p, least: F.explode(F.filter(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda n: n >= F.col(f"{p}__level") + least))
    low, high = F.greatest(F.col(f"a_{start}"), F.col(f"b_{start}")), F.least(F.col(f"a_{end}"), F.col(f"b_{end}"))

    def met(x: DataFrame, y: DataFrame) -> DataFrame:
        # A pair meets in every bin that both touch; it counts in the one that holds the overlap's start.
        on = (F.col(f"a_{chrom}") == F.col(f"b_{chrom}")) & (F.col("a__at") == F.col("b__at")) & (F.col("a__bin") == F.col("b__bin"))
        found = x.join(y, on & (low < high) & (F.floor(low / _width(F.col("a__at"))) == F.col("a__bin")))
        found = found if only is None else found.where(only)
        return found.select(*(F.col(f"{p}_{k}").alias(f"{p}__{short}") for p in "ab" for k, short in zip(keys, "cse")))

    stored = lambda df, p: at_level(df, p, F.col(f"{p}__level"))
    pairs = met(at_level(a, "a", higher("a", 0)), stored(b, "b")).unionByName(met(stored(a, "a"), at_level(b, "b", higher("b", 1))))
    chunks = pairs.join(_chunks(proper(left), keys, "a"), ["a__c", "a__s", "a__e"]).join(_chunks(proper(right), keys, "b"), ["b__c", "b__s", "b__e"])
    dealt = chunks.repartition("a__c", "a__s", "a__e", "a__k", "b__s", "b__e", "b__k").select(F.explode("a__rows").alias("a"), "b__rows").select("a", F.explode("b__rows").alias("b"))
    return dealt.select(*(F.col(f"a.`{c}`").alias(f"a_{c}") for c in left.columns), *(F.col(f"b.`{c}`").alias(f"b_{c}") for c in right.columns))


def overlap_totals(left: DataFrame, right: DataFrame, a: Column, b: Column, chrom: str, start: str, end: str) -> DataFrame:
    """(a, b, n, shared): number and summed length of the overlaps of all pairs, by a column of each side, without pairs.

    Up to a place x lie S starts and E ends of one side; its intervals cover x S - (their sum) - (x E - their sum) places
    there. What an interval of the other side meets is the difference between its end and its start. Ends are counted by
    distinct place, and running sums go over places inside TOTAL_BIN, then over bins: a window holds 2 x TOTAL_BIN rows of
    each class.
    """
    own = lambda df, kind: df.where(F.col(chrom).isNotNull() & (F.col(end) > F.col(start))).select(F.col(chrom).alias("c"), kind.alias("k"), F.explode(F.array(F.struct(F.col(start).alias("x"), F.lit(True).alias("opens")), F.struct(F.col(end).alias("x"), F.lit(False).alias("opens")))).alias("e")).groupBy("c", "k", F.col("e.x").cast("long").alias("x"), F.col("e.opens").alias("opens")).agg(F.count("*").alias("w"))
    asked, given = own(left, a), own(right, b)
    whole = lambda c: c.cast("decimal(38,0)")
    zero = whole(F.lit(0))
    classes = given.select("c", F.col("k").alias("b")).distinct()
    # Starts (s) and ends (e) of one side at its places, and their sums; places that are asked about add nothing.
    marks = given.groupBy("c", F.col("k").alias("b"), "x").agg(F.sum(F.when(F.col("opens"), F.col("w")).otherwise(0)).alias("s"), F.sum(F.when(F.col("opens"), 0).otherwise(F.col("w"))).alias("e"))
    marks = marks.select("*", (whole(F.col("s")) * whole(F.col("x"))).cast("decimal(38,0)").alias("sx"), (whole(F.col("e")) * whole(F.col("x"))).cast("decimal(38,0)").alias("ex"))
    names = ["s", "e", "sx", "ex"]
    probes = asked.select("c", "x").distinct().join(classes, "c")
    places = marks.unionByName(probes.select("c", "b", "x", *(F.lit(0).cast("long").alias(n) for n in names[:2]), *(zero.alias(n) for n in names[2:])))
    places = places.groupBy("c", "b", "x").agg(*(F.sum(n).alias(n) for n in names)).withColumn("bin", F.floor(F.col("x") / TOTAL_BIN))
    before = Window.partitionBy("c", "b").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = places.groupBy("c", "b", "bin").agg(*(F.sum(n).alias(n) for n in names))
    bins = bins.select("c", "b", "bin", *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{n}0") for n in names))
    inside = Window.partitionBy("c", "b", "bin").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = places.select("c", "b", "bin", "x", F.col("s").alias("here"), *(F.sum(n).over(inside).alias(n) for n in names)).join(bins, ["c", "b", "bin"])
    s, e, sx, ex = (F.col(n) + F.col(f"{n}0") for n in names)
    covered = whole(F.col("x")) * whole(s - e) - whole(sx) + whole(ex)
    at = running.select("c", "b", "x", (s - F.col("here")).alias("s"), e.alias("e"), covered.alias("covered"))
    met = asked.withColumnRenamed("k", "a").join(at, ["c", "x"])
    n = F.when(F.col("opens"), -F.col("e")).otherwise(F.col("s"))
    shared = F.when(F.col("opens"), -F.col("covered")).otherwise(F.col("covered"))
    found = met.groupBy("a", "b").agg(F.sum(whole(F.col("w")) * whole(n)).alias("n"), F.sum(whole(F.col("w")) * whole(shared)).alias("shared"))
    return found.where("n > 0").select("a", "b", F.col("n").cast("long").alias("n"), F.col("shared").cast("long").alias("shared"))


def reciprocal_overlap(left: DataFrame, right: DataFrame, chrom: str = "chrom", start: str = "sv_start", end: str = "sv_end", least: float = 0.7) -> DataFrame:
    """Pairs whose overlap is at least the share `least` of both, with `share`; what copies of an interval share is computed
    once, before their rows follow."""
    shared = F.least(F.col(f"a_{end}"), F.col(f"b_{end}")) - F.greatest(F.col(f"a_{start}"), F.col(f"b_{start}"))
    longest = F.greatest(F.col(f"a_{end}") - F.col(f"a_{start}"), F.col(f"b_{end}") - F.col(f"b_{start}"))
    share = shared.cast("double") / longest
    return overlapping(left, right, chrom, start, end, share >= least).withColumn("share", share)


def near_sites(reads: DataFrame, sites: DataFrame, window: int, chrom: str = "chrom", pos: str = "pos", centre: str = "centre") -> DataFrame:
    """Reads within `window` of a site's centre, with `offset` from it."""
    spread = sites.withColumn("__bin", F.explode(F.array(*(F.floor(F.col(centre) / (2 * window)) + d for d in (-1, 0, 1))))).withColumnRenamed(chrom, "__chrom")
    offset = F.col(pos) - F.col(centre)
    joined = reads.withColumn("__at", F.floor(F.col(pos) / (2 * window))).join(spread, (F.col(chrom) == F.col("__chrom")) & (F.col("__at") == F.col("__bin")) & (F.abs(offset) <= window))
    return joined.withColumn("offset", offset).drop("__at", "__bin", "__chrom")


def catalog_hits(variants: DataFrame, catalog: DataFrame, on: list[str]) -> DataFrame:
    """One-to-many join to associations, one row for each key and trait: that with the least p-value."""
    hits = variants.select(*on).where(F.col(on[0]).isNotNull()).distinct().join(catalog, on)
    return first_by_key(hits, [*on, "trait"], [significance(F.col("pvalue")), "rsid"])


def catalog_hits_both_ways(variants: DataFrame, catalog: DataFrame) -> DataFrame:
    """(matched_by, rsid, chrom, pos, trait, pvalue): hits by position and hits by rsid; one that is found both ways
    is there twice, since its key differs."""
    columns = ["rsid", "chrom", "pos", "trait", "pvalue"]
    placed = catalog_hits(variants, catalog, ["chrom", "pos"]).select(F.lit("position").alias("matched_by"), *columns)
    named = catalog_hits(variants, catalog, ["rsid"]).select(F.lit("rsid").alias("matched_by"), *columns)
    return placed.unionByName(named)


def significance(pvalue: Column) -> Column:
    """What p-values sort by: a missing one and 0 count as 1."""
    return F.coalesce(F.nullif(pvalue, F.lit(0.0)), F.lit(1.0))


def top_by_category(df: DataFrame, category: str, limits: dict[str, int], order: list) -> DataFrame:
    """The first rows of each category up to its limit, with `total`, the category's full count.

    Rows are ranked in many parts of each category first, and only the parts' first rows meet: a task gets a part's rows
    or parts x limit rows, not a category."""
    most = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in limits.items() for x in pair)), F.col(category)), F.lit(0))
    part = F.pmod(F.xxhash64(*df.columns), F.lit(PARTS))
    near = df.withColumn("__p", part)
    near = near.withColumn("__r", F.row_number().over(Window.partitionBy(category, "__p").orderBy(*order))).where(F.col("__r") <= most).drop("__r", "__p")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy(category).orderBy(*order))).where(F.col("rank") <= most)
    totals = df.groupBy(category).agg(F.count("*").alias("total"))
    return ranked.join(totals, category)


def first_interesting(df: DataFrame, interesting: Column, limit: int) -> DataFrame:
    """The first rows that are interesting, by place; each task hands on at most `limit`."""
    return df.where(interesting).orderBy("chrom", "pos", "ref", "alt").limit(limit)


def compare_sets(truth: DataFrame, query: DataFrame, keys: tuple[str, ...] = KEY, by: dict[str, Column] | None = None) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 of distinct keys, in each class of `by`; empty denominators give 0."""
    t, q = truth.select(*keys).distinct().withColumn("__t", F.lit(1)), query.select(*keys).distinct().withColumn("__q", F.lit(1))
    both = t.join(q, list(keys), "full_outer").withColumns(by or {})
    hit, miss, extra = F.col("__t").isNotNull() & F.col("__q").isNotNull(), F.col("__q").isNull(), F.col("__t").isNull()
    counts = both.groupBy(*(by or {})).agg(F.count_if(hit).alias("tp"), F.count_if(extra).alias("fp"), F.count_if(miss).alias("fn"))
    share = lambda a, b: F.when(a + b > 0, a.cast("double") / (a + b)).otherwise(F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns({"precision": share(tp, fp), "recall": share(tp, fn), "f1": F.when(2 * tp + fp + fn > 0, 2.0 * tp / (2 * tp + fp + fn)).otherwise(F.lit(0.0))})
