"""The report that reads only what changed."""

import glob
import os
import shutil

import pytest
from pyspark.sql import functions as F

from quizlens import schemas
from quizlens.operators import grading
from quizlens.plans import analyse, keep_up
from quizlens.sources import graded, tables

NAMES = ["Model A", "Model B"]


def enriched(rows):
    return grading.enrich(rows, {"a": "Model A", "b": "Model B"})


def write_file(spark, folder, name, first, n, lang="eng"):
    """One graded file of ``n`` answers, written and then moved under its name."""
    rows = spark.range(first, first + n).select(
        *[(F.col("id") % 9).cast("int").alias("id") if f.name == "id" else
          F.lit(None).cast("string").alias(f.name) for f in schemas.GRADED], F.lit(lang).alias("lang"))
    i = F.col("id")
    rows = rows.withColumns({
        "model": F.concat(F.when(i % 2 == 0, "a").otherwise("b"), F.lit(f"_{lang}")),
        "dataset": F.when(i % 3 == 0, "wiki").otherwise("flore"),
        "city": F.lit("Roma"), "subject": F.concat(F.lit("S"), i % 4),
        "subject_1": F.when(i % 4 < 2, "OK").when(i % 4 == 2, "NO"),
        "city_1": F.when(i % 5 < 3, "OK").otherwise("PAR"), "subject_2": F.when(i % 7 < 3, "OK").otherwise("ERR")})
    draft = f"{folder}-draft"
    tables.write_table(rows.coalesce(1).select(*graded.header_columns()), draft, sep="\t")
    (part,) = glob.glob(f"{draft}/part-*.csv")
    os.makedirs(folder, exist_ok=True)
    shutil.copy(part, f"{folder}/{name}")


def table_rows(tables_by_name):
    return {n: sorted(map(str, t.collect())) for n, t in tables_by_name.items()}


@pytest.fixture(scope="module")
def full(spark):
    def report(folder):
        return table_rows(analyse.report(enriched(graded.read_graded(spark, folder)), names=NAMES))
    return report


def test_only_changed_files_are_read(spark, full, tmp_path, monkeypatch):
    folder, ledger = str(tmp_path / "graded"), str(tmp_path / "ledger")
    read = []
    plain = keep_up.read_graded

    def noted(spark, paths, *args, **kwargs):
        read.append(sorted(os.path.basename(p) for p in paths))
        return plain(spark, paths, *args, **kwargs)
    monkeypatch.setattr(keep_up, "read_graded", noted)

    def kept_up():
        keep_up.update(spark, folder, ledger, enriched=enriched)
        return table_rows(analyse.tables_of(keep_up.current_cubes(spark, folder, ledger), NAMES))

    write_file(spark, folder, "a 1_eng.tsv", 0, 60)
    write_file(spark, folder, "a [2]_ita.tsv", 5, 40, "ita")
    write_file(spark, folder, "none_eng.tsv", 0, 0)
    write_file(spark, folder, "z_ita.tsv", 7, 9, "ita")
    assert kept_up() == full(folder)
    write_file(spark, folder, "b_eng.tsv", 30, 25)                # added
    assert kept_up() == full(folder)
    write_file(spark, folder, "a 1_eng.tsv", 100, 33)             # replaced
    assert kept_up() == full(folder)
    os.remove(f"{folder}/a [2]_ita.tsv")                          # removed
    assert kept_up() == full(folder)
    assert kept_up() == full(folder)                              # nothing changed
    assert read == [["a 1_eng.tsv", "a \\[2\\]_ita.tsv", "none_eng.tsv", "z_ita.tsv"], ["b_eng.tsv"], ["a 1_eng.tsv"]]


def test_a_broken_update_counts_nothing(spark, full, tmp_path):
    folder, ledger = str(tmp_path / "graded"), str(tmp_path / "ledger")
    write_file(spark, folder, "a_eng.tsv", 0, 60)
    write_file(spark, folder, "a_ita.tsv", 0, 9, "ita")

    def broken(rows):
        return enriched(rows).withColumn("city_1", F.when(F.col("id") == 7, F.raise_error(
            F.lit("broken")).cast("string")).otherwise(F.col("city_1")))
    with pytest.raises(Exception, match="broken"):
        keep_up.update(spark, folder, ledger, enriched=broken)
    assert keep_up.counted_files(spark, ledger).count() == 0
    # Counts without a marker do not stand; of two runs at once one stands.
    keep_up.update(spark, folder, ledger, enriched=enriched)
    rows = keep_up.read_ledger(spark, ledger)
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    rows.where("cube <> 'file'").withColumn("run", F.lit("0")).write.mode("append").parquet(ledger)
    rows.withColumn("run", F.lit("~")).write.mode("append").parquet(ledger)
    cubes = keep_up.current_cubes(spark, folder, ledger)
    assert table_rows(analyse.tables_of(cubes, NAMES)) == full(folder)
