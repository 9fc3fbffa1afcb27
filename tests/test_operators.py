"""Operators on small tables, with expected rows worked out by hand or in plain Python."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quizlens import schemas
from quizlens.operators import audit, differences, gallery, grading, lookups, metrics, ordering, tiles
from quizlens.values import DISPLAY_NAMES


def rows(frame, *columns):
    return Counter(tuple(r[c] for c in columns) for r in frame.select(*columns).collect())


LABELS = ["OK", "NO", "ERR", "PAR", None]


@pytest.fixture(scope="module")
def answers(spark):
    data = [
        (f"m{i % 3}", ("flore", "wiki")[i % 2], ("eng", "ita")[i // 2 % 2], f"p{i % 4}",
         LABELS[i % 5], LABELS[(i * 7 + 2) % 5], LABELS[(i * 3 + 1) % 5])
        for i in range(400)
    ]
    columns = "algorithm string, dataset string, lang string, picture string, " \
              "subject_1 string, city_1 string, subject_2 string"
    return grading.add_flags(spark.createDataFrame(data, columns))


# --- metrics -------------------------------------------------------------------

def test_accuracy_is_mean_of_flags(answers):
    local = answers.collect()
    for row in metrics.accuracy(answers).collect():
        group = [r for r in local if (r.algorithm, r.dataset) == (row.algorithm, row.dataset)]
        assert row.subject_accuracy == sum(r.subject_1 == "OK" for r in group) / len(group)
        assert row.city_accuracy == sum(r.city_1 == "OK" for r in group) / len(group)
        assert row.subject_accuracy_2q == sum(
            "OK" in (r.subject_1, r.subject_2) for r in group) / len(group)
        assert 0 <= row.subject_accuracy <= row.subject_accuracy_2q <= 1


def test_outcome_counts_drop_null_keep_par(answers):
    counted = rows(metrics.outcome_counts(answers, ["picture"], "city_1"), "picture", "city_1", "count")
    expected = Counter((r.picture, r.city_1) for r in answers.collect() if r.city_1)
    assert counted == Counter({(*key, n): 1 for key, n in expected.items()})
    assert any(key[1] == "PAR" for key in counted)


def test_weighted_metrics_over_the_cube_equal_direct_ones(answers):
    both = metrics.outcome_cubes(answers)
    cube, pictures = grading.add_flags(both.where("cube = 'model'")), both.where("cube = 'picture'")
    assert cube.count() < answers.count() and pictures.count() < answers.count()
    for direct, summed in (
        (metrics.accuracy(answers), metrics.accuracy(cube, weight="answers")),
        (metrics.outcome_counts(answers, ["picture"], "subject_1"),
         metrics.outcome_counts(pictures, ["picture"], "subject_1", "answers")),
        (metrics.outcome_counts_by_language(answers, "city_1"),
         metrics.outcome_counts_by_language(pictures, "city_1", weight="answers")),
        (differences.language_difference(answers, names=["m0", "m1", "zz"]),
         differences.language_difference(cube, names=["m0", "m1", "zz"], weight="answers")),
    ):
        assert direct.dtypes == summed.dtypes
        assert rows(direct, *direct.columns) == rows(summed, *direct.columns)


def test_language_tables_are_the_two_tables_stacked(answers):
    combo = rows(metrics.outcome_counts_by_language(answers, "subject_1"), "picture", "subject_1", "count")
    expected = Counter()
    for lang, tag in (("eng", " (EN)"), ("ita", " (IT)")):
        one = metrics.outcome_counts(answers.where(F.col("lang") == lang), ["picture"], "subject_1")
        expected += Counter((r.picture, r.subject_1 + tag, r["count"]) for r in one.collect())
    assert combo == expected


# --- differences ---------------------------------------------------------------

def brute_difference(before, after, names):
    result = {}
    for name in names:
        b = Counter(label for algorithm, label in before if algorithm == name)
        a = Counter(label for algorithm, label in after if algorithm == name)
        result[name] = tuple(a[o] - b[o] for o in ("OK", "NO", "ERR"))
    return result


def as_dict(frame):
    return {r.algorithm: (r.OK, r.NO, r.ERR) for r in frame.collect()}


def test_language_difference(answers):
    names, local = ["m2", "m0", "absent"], answers.collect()
    expected = brute_difference(
        [(r.algorithm, r.subject_1) for r in local if r.lang == "ita"],
        [(r.algorithm, r.subject_1) for r in local if r.lang == "eng"], names)
    frame = differences.language_difference(answers, names=names)
    assert as_dict(frame) == expected and expected["absent"] == (0, 0, 0)
    assert [r.algorithm for r in frame.orderBy("display_order").collect()] == names


def test_followup_keeps_rows_without_first_label(answers):
    names, local = ["m0", "m1", "m2"], answers.collect()
    missed = [r for r in local if r.subject_1 != "OK"]
    expected = brute_difference([(r.algorithm, r.subject_1) for r in missed],
                                [(r.algorithm, r.subject_2) for r in missed], names)
    assert as_dict(differences.followup_difference(answers, names=names)) == expected
    assert all(ok >= 0 for ok, _, _ in expected.values())
    for lang in ("eng", "ita"):
        one = differences.followup_difference(answers.where(F.col("lang") == lang), names=names)
        both = differences.followup_difference(answers, names=names, langs=["eng", "ita"])
        assert as_dict(one) == as_dict(both.where(F.col("lang") == lang))


def test_two_frames_and_strict_mode(spark):
    before = spark.createDataFrame([("a", "OK"), ("a", "NO"), ("b", None)], "algorithm string, x string")
    after = spark.createDataFrame([("a", "OK"), ("a", "OK"), ("b", "PAR")], "algorithm string, y string")
    options = {"names": ["a", "b"]}
    loose = differences.frame_difference(before, after, "x", "y", **options)
    assert as_dict(loose) == {"a": (1, -1, 0), "b": (0, 0, 0)}
    with pytest.raises(Exception, match="no labels for: b"):
        differences.frame_difference(before, after, "x", "y", strict=True, **options).collect()
    strict = differences.frame_difference(before, after, "x", "y", strict=True, names=["a"])
    assert as_dict(strict) == {"a": (1, -1, 0)}


# --- grading and audit ---------------------------------------------------------

def test_enrich_and_excluded_paths(spark):
    data = [("./i1.jpg", "Phi3_ENG", "Roma", "Torri/Portici", "OK", None, "NO"),
            (None, "molmo_eng", "Roma", "x", None, "OK", "OK")]
    graded = spark.createDataFrame(
        data, "path string, model string, city string, subject string, "
              "subject_1 string, city_1 string, subject_2 string")
    assert rows(grading.enrich(graded), "algorithm", "picture", "subject_ok", "city_ok", "subject_ok_2q") \
        == Counter([("Phi-3.5", "Roma / Torri", True, False, True), ("Molmo", "Roma / x", False, True, True)])
    assert grading.exclude_paths(graded).count() == 2
    kept = grading.exclude_paths(graded, ["./i1.jpg"]).collect()
    assert [r.path for r in kept] == [None]


def test_audit(answers):
    local, columns = answers.collect(), ["city_1", "subject_2"]
    domains = rows(audit.label_domains(answers, columns), "column", "value", "rows")
    expected = Counter((c, r[c]) for r in local for c in columns)
    assert domains == Counter({(*key, n): 1 for key, n in expected.items()})
    nulls = audit.null_counts(answers, columns).first()
    assert nulls.city_1_nulls == sum(r.city_1 is None for r in local)
    assert audit.null_rows(answers, "subject_2").count() == nulls.subject_2_nulls


# --- lookups -------------------------------------------------------------------

@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_lookup_is_the_same_by_broadcast_and_by_shuffle(spark, threshold):
    facts = spark.range(1000).withColumn("k", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50))
    dim = spark.range(50).select(F.col("id").alias("key"), F.concat(F.lit("v"), "id").alias("v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        found = lookups.lookup(facts, dim, "k", "key", ["v"])
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert ("BroadcastHashJoin" in plan) == (threshold == "10m")
        assert ("SortMergeJoin" in plan) == (threshold == "-1")
        assert all(r.v == f"v{r.k}" for r in found.collect())
        assert found.count() == 1000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_large_lookup_splits_a_hot_key(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k",
        "spark.sql.shuffle.partitions": "64",
    }
    before = {name: spark.conf.get(name, None) for name in settings}
    facts = spark.range(0, 300_000, 1, 8).withColumn(
        "k", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 20_000)
    ).withColumn("answer", F.sha1(F.col("id").cast("string")))
    dim = spark.range(20_000).select(F.col("id").alias("key"), F.concat(F.lit("v"), "id").alias("v"))
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        found = lookups.lookup(facts, dim, "k", "key", ["v"])
        right = found.where("v = concat('v', k)")
        assert right.count() == 300_000
        checked = right.groupBy("v").agg(F.sum(F.hash("answer")))  # the rows differ, as real ones do
        assert len(checked.collect()) == 20_000
        assert "SortMergeJoin(skew=true)" in checked._jdf.queryExecution().executedPlan().toString()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value else spark.conf.unset(name)


def test_lookup_in_a_wide_table_passes_no_rows_to_the_driver(spark):
    wide = spark.range(300).select(
        F.col("id").alias("key"), F.repeat(F.sha1(F.col("id").cast("string")), 2_500).alias("v"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10m")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10k")
    try:
        found = lookups.lookup(spark.range(300).withColumnRenamed("id", "k"), wide, "k", "key", ["v"])
        assert "SortMergeJoin" in found._jdf.queryExecution().executedPlan().toString()
        assert found.where(F.length("v") == 100_000).count() == 300
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "toArrow" not in open(lookups.__file__).read()


def test_lookup_demands_exactly_one_row(spark):
    facts = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    dim = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "z")], "key int, v string")
    loose = lookups.lookup(facts, dim, "k", "key", ["v"], strict=False)
    assert rows(loose, "k", "v") == Counter([(1, "a"), (2, "b"), (3, None)])
    strict = lookups.lookup(facts, dim, "k", "key", ["v"])
    assert strict.where("k = 1").first().v == "a"
    for bad in (2, 3):
        with pytest.raises(Exception, match=f"expected one row for key {bad}"):
            strict.where(f"k = {bad}").collect()


# --- order ---------------------------------------------------------------------

def test_combined_order(spark):
    data = [("b", "m1"), ("a", "m2"), ("a", "m1"), ("i1_x", "m"), ("i10_x", "m")]
    frame = spark.createDataFrame(data, "path string, model string")
    assert [tuple(r) for r in ordering.combined_order(frame).collect()] == sorted(data)


def test_position_over_many_partitions_with_a_hot_key(spark):
    rng = random.Random(3)
    data = [("hot" if rng.random() < 0.4 else rng.choice("abcxyz"), i) for i in range(5000)]
    rng.shuffle(data)
    frame = spark.createDataFrame(data, "k string, i int").repartition(13)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = ordering.with_position(frame, ["k", "i"])
        assert placed.select(F.spark_partition_id()).distinct().count() > 1
        found = sorted((r["index"], r.k, r.i) for r in placed.collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found == [(n, *row) for n, row in enumerate(sorted(data))]


def test_hot_path_is_cut_into_several_partitions(spark):
    frame = spark.range(0, 300_000, 1, 6).select(F.lit("p").alias("path"), F.lit("m").alias("model"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = ordering.combined_order(frame).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r["count"] for r in sizes) == 300_000
    assert max(r["count"] for r in sizes) < 100_000


def test_position_of_empty_frame(spark):
    empty = spark.createDataFrame([], "k string")
    assert ordering.with_position(empty, ["k"]).collect() == []


# --- tiles ---------------------------------------------------------------------

def plain_rule(width, height, grids, size):
    """The rule in one sentence: nearest ratio; of equally near ones the largest
    that is more than half filled, else the smallest."""
    distance = {g: abs(width / height - g[0] / g[1]) for g in grids}
    near = [g for g in grids if distance[g] == min(distance.values())]
    filled = [g for g in near[1:] if width * height > 0.5 * size * size * g[0] * g[1]]
    return filled[-1] if filled else near[0]


@pytest.mark.parametrize("low,high,size", [(1, 12, 448), (1, 6, 336), (2, 9, 448), (1, 1, 448)])
def test_grid_choice(spark, low, high, size):
    rng = random.Random(high)
    sizes = [(448, 448), (896, 896), (1600, 1600), (3000, 300), (300, 3000), (1, 1), (634, 634)]
    sizes += [(rng.randint(1, 4000), rng.randint(1, 4000)) for _ in range(300)]
    sizes += [(100 * rng.randint(1, 30), 100 * rng.randint(1, 30)) for _ in range(300)]
    frame = spark.createDataFrame(sizes, "width int, height int")
    grids = sorted(((c, r) for c in range(1, high + 1) for r in range(1, high + 1)
                    if low <= c * r <= high), key=lambda g: (g[0] * g[1], g[0]))
    for row in tiles.plan_grids(frame, low, high, size).collect():
        expected = plain_rule(row.width, row.height, grids, size)
        assert (row.cols, row["rows"]) == expected, (row.width, row.height)
        assert row.blocks == expected[0] * expected[1]
        assert (row.target_w, row.target_h) == (expected[0] * size, expected[1] * size)


def test_candidates(spark):
    table = tiles.grid_table(spark).collect()
    assert len(table) == 35
    assert [r.grid_rank for r in table] == list(range(35))
    assert [r.area for r in table] == sorted(r.area for r in table)


def test_boxes_cover_the_target_once(spark):
    frame = spark.createDataFrame([(1, 448, 448), (2, 3000, 1000), (3, 300, 1500)],
                                  "image_id int, width int, height int")
    plan = tiles.plan_grids(frame)
    for thumbnail in (True, False):
        boxes = tiles.tile_boxes(plan, thumbnail=thumbnail)
        for row in plan.collect():
            mine = boxes.where(F.col("image_id") == row.image_id).orderBy("tile").collect()
            real = [b for b in mine if not b.is_thumbnail]
            assert len(real) == row.blocks
            assert len(mine) - len(real) == (1 if thumbnail and row.blocks != 1 else 0)
            assert [(b.y0, b.x0) for b in real] == [
                (y * 448, x * 448) for y in range(row["rows"]) for x in range(row.cols)]
            assert all((b.x1 - b.x0, b.y1 - b.y0) == (448, 448) for b in mine)


def test_usage_counts_every_picture_once(spark):
    frame = spark.range(500).select(
        (F.col("id") * 7 % 900 + 1).alias("width"), (F.col("id") * 11 % 700 + 1).alias("height"))
    usage = tiles.grid_usage(frame).collect()
    assert len(usage) == 35 and sum(r.images for r in usage) == 500


# --- gallery -------------------------------------------------------------------

def test_gallery(spark):
    names = ["i10_flore.jpg", "i1_flore.jpg", "i7_wiki.jpeg", "i17_wiki_torri.jpg",
             "i17_wiki_portici.jpg", "i12_other.PNG", "i3_other.txt", "i2_flore_wiki.jpg"]
    listing = spark.createDataFrame([(f"./dataset/{n}",) for n in names], "path string")
    catalogue = spark.createDataFrame([(i, f"s{i}") for i in range(1, 21)], "id int, subject string")
    files = gallery.gallery_files(listing)
    assert files.count() == 7  # i2 belongs to two sources
    placed = gallery.caption_files(gallery.place_in_grid(files, rows=2, cols=3), catalogue)
    assert [(r.position, r.grid_row, r.grid_col, r.file, r.label)
            for r in placed.orderBy("position").collect()] == [
        (0, 0, 0, "i10_flore.jpg", "s10"), (1, 0, 1, "i1_flore.jpg", "s1"),
        (2, 0, 2, "i2_flore_wiki.jpg", "s2"), (3, 1, 0, "i17_wiki_torri.jpg", "Torri"),
        (4, 1, 1, "i2_flore_wiki.jpg", "s2"), (5, 1, 2, "i7_wiki.jpeg", "s7")]
    last = gallery.caption_files(files.where("file like '%other%'"), catalogue)
    assert rows(last, "file", "label") == Counter([("i12_other.PNG", "s12 - Milano")])


def test_fixed_lists_have_the_expected_size():
    assert len(DISPLAY_NAMES) == 10
    assert len(schemas.GRADED_HEADER) == 16
