"""Readers that open files in tasks, and the sinks, stamps and run files that no query reads."""

import hashlib
import json
import os
import random
import time

import pytest

from helixframe.operators import results
from helixframe.sources import ranges, tables


def catalog(seed, n=300):
    r = random.Random(seed)
    odd = ["plain", 'foo],', '"quoted" ]', "back\\slash", '], "k": [', "é😀", "", "a, b", "]", "[{", 'x\\"],\\"y']
    return {f"{r.choice(odd)}{i}": [{"trait": r.choice(odd), "mapped_trait": r.choice([None, *odd]), "rsid": f"rs{i}", "pvalue": r.choice([1e-9, "3e-8", None, "none", 0, True]), "other": 2} for _ in range(r.randrange(4))] for i in range(n)}


def rows_of(found):
    def number(v):
        try:
            return None if v is None or isinstance(v, bool) else float(v)
        except ValueError:
            return None

    return sorted((str(k), str(x["trait"]), str(x["mapped_trait"]), x["rsid"], str(number(x["pvalue"]))) for k, many in found.items() for x in many)


@pytest.mark.parametrize("style", [{}, {"indent": 1}, {"separators": (",", ":")}, {"ensure_ascii": False}])
def test_one_json_object_is_read_in_parts(spark, tmp_path, style):
    made = catalog(3)
    (tmp_path / "c.json").write_text(json.dumps(made, **style), encoding="utf-8")
    size = os.path.getsize(tmp_path / "c.json")
    for part in (97, 1000, 4096, size + 1):
        df = tables.read_catalog(spark, str(tmp_path / "c.json"), "place", part)
        got = sorted((r["place"], str(r["trait"]), str(r["mapped_trait"]), r["rsid"], str(r["pvalue"])) for r in df.collect())
        assert got == rows_of(made)
    assert df.columns == ["place", "trait", "mapped_trait", "rsid", "gene", "risk_allele", "pvalue", "or_beta"]


def test_ranges_share_out_all_records(tmp_path):
    """Every cut of a small object: each record is in exactly one range, also where a cut lies inside a key or separator."""
    made = {"a": [{"t": "x],"}], 'b"c': [], "d": [{"t": 1}, {"t": 2}], "long" * 30: [{"t": "y" * 200}], "e": [{"t": "], \"k\": ["}]}
    path = tmp_path / "c.json"
    path.write_text(" " + json.dumps(made) + "\n")
    n = path.stat().st_size
    for part in range(1, n + 2, 3):
        seen = {}
        for start in range(0, n, part):
            with ranges.opened(str(path)) as f:
                found = json.loads(ranges._records(f, n, start, min(n, start + part)))
            assert not seen.keys() & found.keys()
            seen.update(found)
        assert seen == made


def test_several_tasks_read_one_file_and_empty_objects(spark, tmp_path):
    (tmp_path / "big.json").write_text(json.dumps({f"k{i}": [{"trait": "t", "pvalue": 0.5}] * 3 for i in range(5000)}))
    df = tables.read_catalog(spark, str(tmp_path / "big.json"), "k", 10_000)
    assert df.count() == 15_000 and df.select("k").distinct().count() == 5000
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "wholetext" not in plan and "MapInArrow" in plan
    (tmp_path / "none.json").write_text("{}")
    assert tables.read_catalog(spark, str(tmp_path / "none.json"), "k").count() == 0
    assert ranges.can_open("/a/b") and ranges.can_open("hdfs://x/y") and not ranges.can_open("viewfs://store/x")


def test_fingerprints_by_executors(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name, data in {"a/one.bin": b"\xff\n\x00" * 9000, "two.bin": b"", "a/other.bin": b"x", "one.bin": b"short"}.items():
        (tmp_path / name).write_bytes(data)
    wanted = spark.createDataFrame([("one.bin",), ("two.bin",), ("gone.bin",), (None,)], "file_name string")
    rows = tables.fingerprints(spark, str(tmp_path), wanted).collect()
    digest = lambda data: hashlib.sha256(data[:16384]).hexdigest()[:16]
    got = sorted((str(r["file_name"]), r["state"], r["size"] or 0, r["digest"]) for r in rows)
    assert got == [("None", "missing", 0, None), ("gone.bin", "missing", 0, None), ("one.bin", "present", 5, digest(b"short")), ("one.bin", "present", 27_000, digest(b"\xff\n\x00" * 9000)), ("two.bin", "missing", 0, None)]


def test_stamps_of_files_and_directories(spark, tmp_path):
    (tmp_path / "dir" / "deep").mkdir(parents=True)
    for name, data, when in (("file.tsv", b"abc", 1_600_000_000), ("dir/x", b"12345", 1_500_000_000), ("dir/deep/y", b"1", 1_700_000_000), ("unasked", b"z", 1)):
        (tmp_path / name).write_bytes(data)
        os.utime(tmp_path / name, (when, when))
    wanted = spark.createDataFrame([("f", "file.tsv"), ("d", "dir"), ("m", "nothing"), ("u", None)], "key string, part string")
    got = {r["key"]: r for r in tables.stamps(spark, str(tmp_path), wanted).collect()}
    assert {k: r["state"] for k, r in got.items()} == {"f": "file", "d": "directory", "m": "missing", "u": "unknown_artifact"}
    assert got["f"]["digest"] == hashlib.sha256(b"abc").hexdigest()[:16] and got["f"]["size"] == 3
    # The directory's time is that of its own files, its number of files that of all below.
    assert got["d"]["modified"].timestamp() == 1_500_000_000 and got["d"]["n_files"] == 2 and got["d"]["size"] == 6 and got["d"]["digest"] is None


def test_run_files_predictions_and_scores(spark, tmp_path):
    runs = spark.createDataFrame([(1, "t", "m", {"a": "b"}), (2, "t", "n", None)], "run_no long, task_id string, model_name string, metadata map<string,string>")
    assert tables.with_predictions_path(runs, None) is runs
    got = {r["run_no"]: r["metadata"] for r in tables.with_predictions_path(runs, "/p").collect()}
    assert got == {1: {"a": "b", "predictions_path": "/p"}, 2: {"predictions_path": "/p"}}
    for day, n in (("2024-01-01", 1), ("2024-03-01", 2)):
        runs.where(f"run_no = {n}").select("run_no", "task_id", "model_name").coalesce(1).write.json(f"{tmp_path}/w{n}")
        part = next((tmp_path / f"w{n}").glob("*.json"))
        (tmp_path / "runs").mkdir(exist_ok=True)
        part.rename(tmp_path / "runs" / f"run_{day}.jsonl")
        time.sleep(0.01)
    assert [r["run_no"] for r in tables.read_latest_runs(spark, f"{tmp_path}/runs").collect()] == [2]
    assert tables.read_latest_runs(spark, f"{tmp_path}/runs", "t", "m").count() == 0
    with pytest.raises(Exception):
        tables.read_latest_runs(spark, f"{tmp_path}/w1")
    predictions = spark.createDataFrame([("t", "m", "v1", 0.5), ("t", "n", "v1", 0.25)], "task_id string, model_name string, variant_id string, prediction double")
    tables.save_predictions(predictions, f"{tmp_path}/p")
    tables.save_predictions(predictions, f"{tmp_path}/p")
    assert spark.read.parquet(f"{tmp_path}/p").where("model_name = 'n'").count() == 2
    tables.write_scores(predictions, f"{tmp_path}/s")
    assert tables.read_strings(spark, f"{tmp_path}/s").where("prediction = '0.5'").count() == 1


def test_log_ratio_scores_and_summaries(spark, tmp_path):
    (tmp_path / "llr.tsv").write_text("#chrom\tpos\tref\talt\tllr\nchr1\t5\tA\tC\t-3.5\tmore\nchr1\tx\tA\tC\t1\nchr2\t6\tG\tT\nchr2\t7\tG\tT\t0.25\n")
    assert sorted(map(tuple, tables.read_llr(spark, str(tmp_path / "llr.tsv")).collect())) == [("chr1", 5, "A", "C", -3.5), ("chr2", 7, "G", "T", 0.25)]
    (tmp_path / "summary.txt").write_text("Chromosome\tAssembly\tLastEvaluated\n01\tGRCh38\t2020-01-02\n2\tGRCh37\t-\n")
    found = tables.read_variant_summary(spark, str(tmp_path / "none.gz"), str(tmp_path / "summary.txt"))
    assert [r["Chromosome"] for r in tables.variant_summaries(found).collect()] == ["01"]


def test_statuses(spark):
    df = spark.createDataFrame([(["e"], ["w"]), ([], ["w"]), ([], [])], "e array<string>, w array<string>")
    assert [r[0] for r in df.select(results.tool_status(df["e"], df["w"])).collect()] == ["failed", "partial", "ok"]
