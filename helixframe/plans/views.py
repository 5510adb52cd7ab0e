"""Genomic-shaped views over the given tables, one SQL text for Spark and DuckDB alike.

Each query names the views that it uses; Spark gets them as DataFrames, the SQL it is held against as common table
expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")

VIEWS = {
    "variants": """SELECT l_orderkey, l_linenumber, l_partkey, concat('chr', CAST(l_partkey % 22 + 1 AS STRING)) AS chrom,
  CAST(l_orderkey % 5000 + 1 AS BIGINT) AS pos, substr('ACGT', CAST(l_suppkey % 4 AS INT) + 1, 1) AS ref,
  substr('ACGT', CAST((l_suppkey + 1 + l_linenumber % 3) % 4 AS INT) + 1, 1) AS alt,
  CASE l_returnflag WHEN 'A' THEN 'LowQual' WHEN 'N' THEN 'PASS' ELSE NULL END AS filter FROM lineitem""",
    "scores": """SELECT DISTINCT chrom, pos, ref, alt,
  CAST((pos * 7919 + ascii(ref) * 31 + ascii(alt) * 17) % 10007 AS DOUBLE) / 10007.0 AS score FROM variants WHERE pos % 3 <> 0""",
    "bed": """SELECT concat('chr', CAST(s_suppkey % 22 + 1 AS STRING)) AS chrom, CAST((s_suppkey * 37) % 4000 AS BIGINT) AS bed_start,
  CAST((s_suppkey * 37) % 4000 + 800 AS BIGINT) AS bed_end FROM supplier""",
    "assertions": """SELECT o_orderkey AS variation_id, concat('G', CAST(o_custkey % 25 AS STRING)) AS gene_symbol,
  CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 ELSE -1 END AS clinsig_simple, o_orderdate AS last_evaluated,
  o_orderpriority AS review_status, CAST((o_orderkey * 7919) % 10007 AS DOUBLE) / 10007.0 AS score FROM orders""",
    "samples": """SELECT c_custkey AS sample_id, CASE r_name WHEN 'EUROPE' THEN 'EUR' WHEN 'AFRICA' THEN 'AFR' WHEN 'ASIA' THEN 'EAS'
  WHEN 'AMERICA' THEN 'AMR' ELSE 'SAS' END AS ancestry, c_acctbal AS phenotype
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "genotypes": """SELECT o_custkey AS sample_id, l_partkey AS variant_id, CAST(least(2, count(*)) AS INT) AS dosage
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_partkey""",
    "kinship": """SELECT a.sample_id AS id_a, b.sample_id AS id_b, CAST((a.sample_id * 31 + b.sample_id * 17) % 1000 AS DOUBLE) / 4000.0 AS kinship
FROM samples a JOIN (SELECT sample_id, ancestry, explode_offset FROM samples CROSS JOIN offsets) s ON s.sample_id = a.sample_id
JOIN samples b ON b.sample_id = a.sample_id + s.explode_offset AND b.ancestry = a.ancestry""",
    "offsets": "SELECT * FROM (VALUES (1), (2), (3), (4), (5), (6), (7), (8), (9), (10), (11), (12)) AS v(explode_offset)",
    "assays": """SELECT concat('A', CAST(o_custkey % 20 AS STRING)) AS assay_id, o_orderkey AS row_id, round(o_totalprice, 0) AS dms_score,
  CAST((o_orderkey * 7919) % 501 AS DOUBLE) / 500.0 AS score FROM orders""",
    "reads": """SELECT event_id AS read_id, concat('chr', CAST(user_id % 22 + 1 AS STRING)) AS chrom, CAST((event_id * 7919) % 5000000 AS BIGINT) AS pos, ts FROM events""",
    "svs": """SELECT s_suppkey AS sv_id, concat('chr', CAST(s_suppkey % 3 + 1 AS STRING)) AS chrom, CAST((s_suppkey % 12) * 40 AS BIGINT) AS sv_start,
  CAST((s_suppkey % 12) * 40 + 40 + (s_suppkey % 7) * 50 AS BIGINT) AS sv_end, CASE s_suppkey % 2 WHEN 0 THEN 'DEL' ELSE 'DUP' END AS sv_type FROM supplier""",
    "catalog": """SELECT concat('rs', CAST(p_partkey AS STRING)) AS rsid, concat('chr', CAST(p_partkey % 22 + 1 AS STRING)) AS chrom,
  CAST(p_partkey % 5000 + 1 AS BIGINT) AS pos, p_type AS trait, 1.0 / CAST(1 + p_partkey * p_partkey AS DOUBLE) AS pvalue FROM part""",
    "tool_results": """SELECT concat('run_', CAST(user_id % 20 AS STRING)) AS run_id, event_id, event_type AS tool_name,
  CASE event_id % 7 WHEN 0 THEN 'failed' WHEN 1 THEN 'partial' WHEN 2 THEN 'skipped' ELSE 'ok' END AS status,
  CASE event_id % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'optional' ELSE 'standard' END AS criticality, ts AS started_at FROM events""",
    "runs": """SELECT event_id AS run_no, concat('clinvar/', CASE user_id % 2 WHEN 0 THEN 'all_snv' ELSE 'balanced' END) AS task_id,
  concat('m', CAST(user_id % 6 AS STRING)) AS model_name, ts, 'auroc' AS metric,
  CAST((event_id * 7919) % 10007 AS DOUBLE) / 10007.0 AS estimate FROM events""",
    "csq": """SELECT o_orderkey AS row_id, concat('GENE', CAST(o_custkey % 9 AS STRING), '|', substr('ARND', CAST(o_orderkey % 4 AS INT) + 1, 1),
  CASE o_orderkey % 3 WHEN 0 THEN '' ELSE '/V' END, '|', CAST(o_orderkey % 300 AS STRING)) AS csq FROM orders""",
    "vcf_lines": """SELECT l_orderkey * 10 + l_linenumber AS line_no, concat(CAST(l_partkey % 22 + 1 AS STRING), chr(9), CAST(l_orderkey % 5000 + 1 AS STRING), chr(9), '.', chr(9),
  substr('ACGT', CAST(l_suppkey % 4 AS INT) + 1, 1), chr(9), CASE l_linenumber % 3 WHEN 0 THEN 'A,*' WHEN 1 THEN 'G,TT' ELSE 'C' END, chr(9), '50', chr(9),
  CASE l_returnflag WHEN 'A' THEN 'LowQual' WHEN 'N' THEN 'PASS' ELSE '.' END, chr(9),
  concat('SpliceAI=', CASE l_linenumber % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'TT' ELSE 'C' END, '|G1|0.', CAST(l_partkey % 9 AS STRING), '|0.1|0.0|0.', CAST(l_suppkey % 7 AS STRING), '|1|2|3|4'), chr(9), 'GT', chr(9),
  CASE l_orderkey % 4 WHEN 0 THEN '0/1' WHEN 1 THEN '1|1' WHEN 2 THEN './.' ELSE '0/0' END) AS value FROM lineitem""",
}

#: Views over other views.
NEEDS = {"scores": ("variants",), "kinship": ("samples", "offsets")}


def _with_needs(names: tuple[str, ...]) -> list[str]:
    out: list[str] = []
    for name in names:
        for n in (*NEEDS.get(name, ()), name):
            if n not in out:
                out.append(n)
    return out


def ctes(*names: str) -> str:
    """The views as the head of a statement in DuckDB."""
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in _with_needs(names))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame; nothing is left behind in the session's catalog."""
    needed = _with_needs((name,))
    head = ", ".join(f"{n} AS ({VIEWS[n]})" for n in needed[:-1])
    body = f"{'WITH ' + head if head else ''} {VIEWS[needed[-1]]}"
    text = head + body
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"FROM {t}" in text or f"JOIN {t}" in text}
    for t in tables:
        body = body.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return spark.sql(body, **tables)
