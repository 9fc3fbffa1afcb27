"""The given tables in the shapes that the operators read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quizlens.values import POLICIES

LANGS = ("eng", "ita")
DISPLAY = {f"Supplier {i}": f"Model {i}" for i in range(10)}
NAMES = [f"Supplier {i}" for i in range(10)] + ["Supplier none"]
GALLERY_EXCLUDED = "widget"


# Columns that the queries read, so that no footer is opened to learn them.
TABLES = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                "l_quantity double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int",
    "documents": "doc_id bigint, text string, lang string, source string",
    "labels": "doc_id bigint, quality int, toxic int",
    "pages": "page_id bigint, url string, html string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def _text(value: Column) -> Column:
    return value.cast("string")


def _before(moment: str) -> Column:
    return F.col("l_shipdate") < F.lit(moment).cast("timestamp_ntz")


def _labels() -> dict[str, Column]:
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    quantity, line = F.col("l_quantity"), F.col("l_linenumber")
    return {
        "dataset": F.when(_before("1996-01-01 00:00:00"), "flore")
        .when(_before("1999-01-01 00:00:00"), "wiki").otherwise("other"),
        "lang": F.when(F.col("l_orderkey") % 2 == 0, "ita").otherwise("eng"),
        "subject_1": F.when(flag == "N", "OK").when(flag == "A", "NO").otherwise("ERR"),
        "city_1": F.when((status == "O") & (quantity > 40), "PAR").when(status == "O", "OK")
        .when(line > 5, "ERR").otherwise("NO"),
        "subject_2": F.when((flag == "N") | (F.col("l_discount") < 0.01), F.lit(None))
        .when(status == "F", "OK").when(quantity > 25, "NO").otherwise("ERR"),
    }


def graded(spark: SparkSession, sf_dir: str, picture: bool = False) -> DataFrame:
    """One graded answer per line item.

    The part only supplies the picture's name, and every line item has exactly
    one part. So the join is made only for queries that read the name.
    """
    lines = table(spark, sf_dir, "lineitem")
    algorithm = F.concat(F.lit("Supplier "), _text(F.col("l_suppkey") % 10))
    columns = ["algorithm", "dataset", "lang", "subject_1", "city_1", "subject_2"]
    if picture:
        parts = table(spark, sf_dir, "part").select(
            "p_partkey", F.concat("p_brand", F.lit(" / "), "p_type").alias("picture"))
        lines = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        columns.append("picture")
    return lines.withColumns({"algorithm": algorithm, **_labels()}).select(*columns)


def graded_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns of a graded file, and ``lang``, one row per line item."""
    labels = _labels()
    number = (F.col("l_partkey") % 25 + 1).cast("int")
    line = F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").withColumns({**labels, "id": number})
    description = F.when(F.col("l_tax") > 0.04, "OK").when(F.col("l_tax") > 0.02, "NO").otherwise("ERR")
    answer = F.concat(F.lit(' It is "'), "l_returnflag", F.lit('" | '),
                      _text(F.col("l_orderkey")), F.lit(" \\ \n\tend\n"))
    return rows.select(
        "id",
        F.concat(F.lit("Supplier "), _text(F.col("l_suppkey") % 10), F.lit("_"), "lang").alias("model"),
        F.concat(F.lit("./dataset/i"), _text(F.col("id")), F.lit("_"), "dataset",
                 F.lit("_"), _text(F.col("l_partkey")), F.lit(".jpg")).alias("path"),
        "dataset",
        F.concat(F.lit("City "), _text(F.col("id") % 7)).alias("city"),
        F.concat(F.lit("Subject "), _text(F.col("id")),
                 F.when(F.col("id") == 17, "/Portici").otherwise("")).alias("subject"),
        answer.alias("answer_1"),
        F.when(line == 1, "0").when(line == 2, "1").when(line == 3, "0,5")
        .when(line == 4, "*0,5").alias("score_1"),
        "city_1", "subject_1",
        description.alias("description_1"),
        F.when(F.col("subject_2").isNotNull(), F.concat(F.lit("No. "), "l_linestatus")).alias("answer_2"),
        F.lit(None).cast("string").alias("score_2"),
        "subject_2",
        F.when(F.col("subject_2").isNotNull(), description).alias("description_2"),
        F.when(line == 7, "check again ").alias("note"),
        "lang",
    )


def docgraded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One graded answer per document; many first labels are missing."""
    quality, toxic = F.col("quality"), F.col("toxic")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id", "left").select(
        F.col("source").alias("algorithm"), F.col("lang").alias("dataset"), "doc_id",
        F.when(quality == 1, "OK").when((quality == 0) & (toxic == 1), "ERR")
        .when(quality == 0, "NO").alias("subject_1"),
        F.when(toxic == 0, "OK").when(toxic == 1, "PAR").alias("city_1"),
    )


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects with padded cells and ``x`` marks, one per part size up to 25."""
    parts = table(spark, sf_dir, "part").where(F.col("p_size") <= 25)
    size = F.col("id")
    return parts.groupBy(F.col("p_size").alias("id")).agg(
        F.concat(F.min("p_name"), F.lit("  ")).alias("subject"),
        F.concat(F.lit(" "), F.min("p_brand"), F.lit(" ")).alias("city"),
    ).withColumns({
        "flore": F.when(size % 3 == 0, "x"),
        "wiki": F.when(size % 3 == 1, "x"),
        "other": F.when(size % 3 == 2, "x"),
    })


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One picture per part, with its size and its path."""
    key, size = F.col("p_partkey"), F.col("p_size")
    source = (
        F.when(size % 3 == 0, "flore")
        .when(size % 3 == 1, F.concat(F.lit("wiki_"), F.replace("p_name", F.lit(" "), F.lit("-"))))
        .otherwise("other")
    )
    suffix = F.when(key % 10 == 0, ".JPEG").when(key % 10 == 1, ".txt").otherwise(".jpg")
    return table(spark, sf_dir, "part").select(
        key.alias("image_id"),
        (200 + (key * 37) % 1800).cast("int").alias("width"),
        (150 + (key * 53) % 1500).cast("int").alias("height"),
        F.concat(F.lit("./dataset/i"), _text(1 + key % 25), F.lit("_"), source, suffix).alias("path"),
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def model_of(number: Column) -> Column:
    """One of the known models for each row, so that every setting occurs."""
    models = F.array(*[F.lit(p.model) for p in POLICIES])
    return F.get(models, (number % len(POLICIES)).cast("int"))
