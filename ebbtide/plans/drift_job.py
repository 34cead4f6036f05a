"""The drift job: compare two customer tables, optionally with a saved run, and write the report tables."""

from pyspark.sql import DataFrame

from ebbtide import settings as S
from ebbtide.operators import baseline
from ebbtide.operators.contracts import check_contract, quality_counts
from ebbtide.operators.drift import drift_report
from ebbtide.operators.models import SCORE
from ebbtide.session import materialized
from ebbtide.sources import runs


def _scorer(run):
    """Scores of the saved model, kept once because several measures read them."""
    return lambda df: materialized(run.score(df).select(S.ID, SCORE), "drift-scores")


def write_drift_report(reference: DataFrame, current: DataFrame, path, run_path=None, runs_folder=None,
                       file_format="parquet") -> dict[str, str]:
    """Write row counts, quality, feature drift and, with a saved run, prediction drift; returns their paths.

    Without a run the report has no prediction part; a missing run is not an error.
    """
    run = None
    if run_path or runs_folder:
        try:
            spark = reference.sparkSession
            run = runs.open_run(spark, run_path) if run_path else runs.open_newest(spark, runs_folder)
        except runs.RunNotFoundError:
            run = None
    return _write_tables(drift_report(reference, current, _scorer(run) if run else None), path, file_format)


def save_baseline(reference: DataFrame, path, mode="errorifexists") -> str:
    """Store the drift profile of a checked table; mode ``append`` adds a later day to it."""
    check_contract(reference, require_label=False)
    return baseline.write_profile(baseline.profile_of(reference), path, mode)


def write_baseline_report(baseline_path, current: DataFrame, path, file_format="parquet") -> dict[str, str]:
    """Row counts, quality and feature drift against a stored profile; the reference table is not read."""
    check_contract(current, require_label=False)
    stored = baseline.read_profile(current.sparkSession, baseline_path)
    arrived = materialized(baseline.profile_of(current), "drift-profile")
    report = {
        "row_counts": baseline.row_counts(stored, arrived),
        "quality": quality_counts(current),
        "feature_drift": baseline.profile_drift(stored, arrived),
    }
    return _write_tables(report, path, file_format)


def _write_tables(report, path, file_format):
    paths = {}
    for name, table in report.items():
        paths[name] = f"{str(path).rstrip('/')}/{name}"
        table.coalesce(1).write.mode("overwrite").format(file_format).save(paths[name])  # a few rows each
    return paths
