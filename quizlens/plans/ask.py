"""Ask: pictures and catalogue in, answer rows out."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from quizlens.operators.answering import Responder, answer_two_questions
from quizlens.operators.requests import add_policy, add_subject, pair_requests, parse_listing
from quizlens.session import stored
from quizlens.sources.answers import append_answer_lines, append_answers
from quizlens.sources.catalogue import read_catalogue
from quizlens.sources.listing import list_files
from quizlens.values import DEFAULT_LANG


ROWS_PER_TASK = 2_000
#: Up to so many partitions Spark's shuffle writes rows straight to files
#: (``spark.shuffle.sort.bypassMergeThreshold``).
FEW_TASKS = 200
_NUMBER = "_number"


def ask(spark: SparkSession, pictures: str | DataFrame, catalogue_path: str, model: str,
        make_responder: Callable[[], Responder], langs: Sequence[str] = (DEFAULT_LANG,),
        prefix: str | None = "./dataset/", store: bool = True,
        rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Put both questions about every picture to one model.

    ``pictures`` is a folder, or a table of ``path`` and ``uri``. The driver lists
    a folder by itself, which suits some hundred thousand files; beyond that, give
    a table.
    """
    if isinstance(pictures, str):
        pictures = list_files(spark, pictures, prefix=prefix)
    known = add_subject(parse_listing(pictures), read_catalogue(spark, catalogue_path))
    requests = add_policy(pair_requests(known, langs).withColumn("model", F.lit(model)))
    return answer_two_questions(spread(requests, rows_per_task), make_responder, store=store)


def spread(requests: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Deal the requests out to tasks of bounded size, and to all cores at least.

    A listing has few partitions, and a model call costs far more than a shuffle
    of paths. A lost executor loses no more than the tasks it was at.

    The rows are stored with a number each and dealt by its hash, so a task that runs
    again deals as before and no rows are sorted for that. They go by way of few
    partitions, which Spark writes without gathering rows in memory: one task may read
    a whole listing, and dealt straight to thousands of tasks it would hold all of it.
    """
    numbered = stored(requests.withColumn(_NUMBER, F.monotonically_increasing_id()), "requests")
    cores = requests.sparkSession.sparkContext.defaultParallelism
    tasks = max(cores, -(-numbered.count() // rows_per_task))
    if tasks > FEW_TASKS:
        # The column between both keeps Spark from making one shuffle of them.
        numbered = numbered.repartition(FEW_TASKS, _NUMBER).withColumn(_NUMBER, F.xxhash64(_NUMBER))
    return numbered.repartition(tasks, _NUMBER).drop(_NUMBER)


def save(answers: DataFrame, folder: str, line_folder: str | None = None) -> None:
    """Append the answers as Parquet and then, if asked, in the line format too.

    With both outputs the answers are stored first, so that both hold the same
    answers and no model answers twice. Answers that no line can hold go to
    ``{line_folder}-unsafe`` with their reason.
    """
    if line_folder is not None:
        answers = stored(answers, "answers")
    append_answers(answers, folder)
    if line_folder is not None:
        written = answers.withColumn("id", F.col("id_text"))
        append_answer_lines(written, line_folder, side=f"{line_folder.rstrip('/')}-unsafe")
