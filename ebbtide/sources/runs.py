"""Saved training runs.

A run is a folder below the run store: one ``pyspark.ml`` pipeline for each role it has (``scorer``, and ``linear`` where
reasons can be given), and two tables. ``facts`` has a row for every number or word that is known about the run:
``scope`` (what it is about: the run, the cuts, a model, a campaign scenario ...), ``item`` (which one of these), ``name``
and either ``number`` or ``word``. New facts need no new schema, and runs are compared by filtering and joining rows.
``seal`` is written last and has one row; a folder without it is an unfinished run and is never read.
"""

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide import settings as S
from ebbtide.operators.scoring import score_frame
from ebbtide.session import small_table

FACTS = "scope string, item string, name string, number double, word string"
SEAL = "run string, sealed_ms long, roles array<string>"
SCORER, LINEAR = "scorer", "linear"


class RunNotFoundError(FileNotFoundError):
    """No complete run is saved at the given place."""


def facts_about(scope, values: dict, item="") -> list[tuple]:
    """Fact rows for a dictionary of numbers and words; what is missing gives no row."""
    rows = []
    for name, value in values.items():
        if value is None:
            continue
        if isinstance(value, str):
            rows.append((scope, item, name, None, value))
        else:
            rows.append((scope, item, name, float(value), None))
    return rows


def _store(folder):
    return str(folder).rstrip("/")


def save_run(spark: SparkSession, roles: dict[str, PipelineModel], facts: list[tuple], folder) -> str:
    """Write pipelines, facts and the seal below a fresh name, in that order; the path of the run."""
    name = f"run-{uuid.uuid4().hex}"
    path = f"{_store(folder)}/{name}"
    for role, model in roles.items():
        model.write().save(f"{path}/{role}")
    small_table(spark, facts, FACTS).coalesce(1).write.parquet(f"{path}/facts")
    seal = [(name, time.time_ns() // 1_000_000, sorted(roles))]
    small_table(spark, seal, SEAL).coalesce(1).write.parquet(f"{path}/seal")
    return path


def sealed_runs(spark: SparkSession, folder) -> DataFrame:
    """``run, sealed_ms, roles`` of every complete run of a store."""
    try:
        return spark.read.schema(SEAL).parquet(f"{_store(folder)}/*/seal")
    except AnalysisException as error:
        raise RunNotFoundError(f"no saved run in {folder}") from error


def facts_of_all(spark: SparkSession, folder) -> DataFrame:
    """The facts of every complete run of a store, with the run's name."""
    place = F.regexp_extract(F.input_file_name(), r"/([^/]+)/facts/[^/]*$", 1)
    facts = spark.read.schema(FACTS).parquet(f"{_store(folder)}/*/facts").withColumn("run", place)
    return facts.join(sealed_runs(spark, folder).select("run"), "run", "left_semi")


def newest_run(spark: SparkSession, folder) -> str:
    """Path of the run that was sealed last."""
    name = sealed_runs(spark, folder).agg(F.max_by("run", F.struct("sealed_ms", "run"))).first()[0]
    if name is None:
        raise RunNotFoundError(f"no saved run in {folder}")
    return f"{_store(folder)}/{name}"


class ScoringRun:
    """A pipeline with frozen cut points that scores tables, read from a store or just fitted."""

    def __init__(self, name, scorer: PipelineModel, cuts: dict, linear: PipelineModel | None = None, facts=()):
        self.name = name
        self.scorer = scorer
        self.linear = linear
        self.high_from = cuts["high_from"]
        self.medium_from = cuts["medium_from"]
        self.facts = list(facts)

    def fact(self, scope, name, item=""):
        """The number or word of one fact; None if the run does not know it."""
        for row in self.facts:
            if tuple(row[:3]) == (scope, item, name):
                return row[4] if row[3] is None else row[3]
        return None

    def score(self, df: DataFrame, k=S.REASONS) -> DataFrame:
        return score_frame(df, self.scorer, self.high_from, self.medium_from, self.linear, k)


def open_run(spark: SparkSession, path) -> ScoringRun:
    """The run at a path."""
    try:
        seal = spark.read.schema(SEAL).parquet(f"{path}/seal").first()
    except AnalysisException as error:
        raise RunNotFoundError(f"no saved run at {path}") from error
    # A few dozen rows.
    facts = [tuple(r) for r in spark.read.schema(FACTS).parquet(f"{path}/facts").collect()]
    cuts = {name: number for scope, _, name, number, _ in facts if scope == "cuts"}
    linear = PipelineModel.load(f"{path}/{LINEAR}") if LINEAR in seal["roles"] else None
    return ScoringRun(seal["run"], PipelineModel.load(f"{path}/{SCORER}"), cuts, linear, facts)


def open_newest(spark: SparkSession, folder) -> ScoringRun:
    return open_run(spark, newest_run(spark, folder))
