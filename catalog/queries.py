"""Every operator and end product as a query over the `trace` view of the test tables.

Results have snake_case key names, and doubles rounded so that both engines' summation
orders give the same digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from cuetrace.operators import averaging, baseline, behaviour, density, exclusion, figures
from cuetrace.operators import permutation, surrogate
from cuetrace.params import TRACE_PARAMS as P
from cuetrace.plans.study import ALL_SIGNALS, Study
from cuetrace.schema import EXPERIMENT, MEASURES, SIGNALS
from cuetrace.sources import recordings
from cuetrace.sources.growing import GrowingRecordings
from cuetrace.sources.trace import trace, trace_in_order, write_recording_files
from cuetrace.workspace import new_path, ship_package

Query = Callable[[SparkSession, str], DataFrame]

RESULT_NAMES = {"SubNr": "sub_nr", "ExpNr": "exp_nr", "cueFrame": "cue_frame"}
COLUMNS = list(SIGNALS.values())
# Doubles are compared by their decimals. A mean of few decimal inputs often lies exactly between
# two roundings, where the last bit of a sum decides; the shift moves such ties upward in both engines.
DIGITS, SHIFT = 6, 1.234567e-9
DENSITY_DIGITS, DENSITY_SHIFT = 12, 1.234567e-15

RESIDUAL_PERMUTATIONS = 1000  # the SQL beside them sorts all cells of each permutation and frame

_STUDIES: dict[tuple[str, str], Study] = {}


def study(spark: SparkSession, sf_dir: str) -> Study:
    """The study over the stored view; its stored intermediates serve all queries of a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STUDIES:
        ship_package(spark)
        _STUDIES[key] = Study(trace_in_order(spark, sf_dir), P, strict=False)
    return _STUDIES[key]


def tidy(df: DataFrame, *, exact: bool = False) -> DataFrame:
    """Result names and, unless the values are those read, comparable decimals."""
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if field.dataType == T.DoubleType() and not exact:
            digits, shift = (DENSITY_DIGITS, DENSITY_SHIFT) if field.name == "density" else (DIGITS, SHIFT)
            column = F.round(column + F.lit(shift), digits)
        columns.append(column.alias(RESULT_NAMES.get(field.name, field.name)))
    return df.select(*columns)


def _of_study(product: Callable[[Study], DataFrame]) -> Query:
    return lambda spark, sf_dir: tidy(product(study(spark, sf_dir)))


def _of_rows(product: Callable[[DataFrame], DataFrame], *, exact: bool = False) -> Query:
    """A query that needs no row order reads the view straight from the scan."""
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return tidy(product(trace(spark, sf_dir)), exact=exact)
    return query


# sources

def ingest_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view written as recording files and ingested from them."""
    folder = write_recording_files(trace_in_order(spark, sf_dir))
    return tidy(recordings.ingest(spark, folder).withColumn("seq", F.col("seq").cast("long")), exact=True)


def ingest_growing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view written as recording files; the table grows by those of experiments 2 and 3, then by the rest."""
    folder = write_recording_files(trace_in_order(spark, sf_dir))
    table = GrowingRecordings(spark, new_path(spark, "growing"))
    table.grow(folder, "Real_*")
    table.grow(folder)
    return tidy(table.rows().withColumn("seq", F.col("seq").cast("long")), exact=True)


def route_experiment(rows: DataFrame) -> DataFrame:
    """File names made from the rows' keys, one in four of no experiment."""
    stems = F.array(*[F.lit(s) for s in [*recordings.ROUTES, "Practice_MEMexperimenttracking"]])
    stem = F.element_at(stems, (F.col("trial") % 4 + 1).cast("int"))
    named = rows.select("SubNr", F.concat(stem, F.lit("_"), F.col("SubNr").cast("string"),
                                          F.lit(".csv")).alias("file_name"))
    routed = recordings.route_experiments(named, "file_name")
    return (routed.groupBy("file_name", EXPERIMENT, (F.col("SubNr") + F.col("offset")).alias("SubNr"))
            .agg(F.count(F.lit(1)).alias("n_rows")))


def union_experiments(rows: DataFrame) -> DataFrame:
    parts = {exp: (rows.filter(F.col(EXPERIMENT) == exp).withColumn("SubNr", F.col("SubNr") - 8 * (exp - 1)),
                   offset) for exp, offset in recordings.ROUTES.values()}
    return (recordings.append_experiments(parts).groupBy(EXPERIMENT, "SubNr")
            .agg(F.count(F.lit(1)).alias("n_rows"), F.avg("Time").alias("mean_time")))


def project_signal(rows: DataFrame) -> DataFrame:
    return baseline.rescale(rows, COLUMNS).select(
        "SubNr", "block", "trial", "item", "cueFrame", "Time", *COLUMNS,
        (F.col("headBiasY") * 100 - F.col("DisplayHeight") * 100).alias("head_height"),
        (F.col("cueFrame").cast("double") * F.lit(P.ms_per_frame)).alias("time_ms"))


# exclusion

KEYS = ["SubNr", "block", "trial", "item", "cueFrame"]


def clean_rows(s: Study) -> DataFrame:
    return s.clean().select("seq", *KEYS, EXPERIMENT)


def sma(scope: str) -> Callable[[Study], DataFrame]:
    return lambda s: s.smoothed(ALL_SIGNALS, scope=scope).select("seq", *COLUMNS)


def baseline_mean(s: Study) -> DataFrame:
    return baseline.baseline_means(s.smoothed(ALL_SIGNALS), COLUMNS, P)


def baseline_correct(s: Study) -> DataFrame:
    return baseline.baseline_correct(s.smoothed(ALL_SIGNALS), COLUMNS, P).select("seq", *COLUMNS)


# tests over time

def _without_signal(df: DataFrame) -> DataFrame:
    return df.drop("signal")


def preview_surrogate(s: Study) -> DataFrame:
    wide = s.tested_rows("head_direction").filter(F.col("phase") == "random")
    return surrogate.preview(wide)


# figures

def fig_toward(name: str, experiment: int | None = None) -> Callable[[Study], DataFrame]:
    limits = (figures.TOWARD_LIMITS if experiment is None else figures.TOWARD_LIMITS_BY_EXPERIMENT)[name]
    return lambda s: figures.censored_ribbon(s.toward_summary(name, experiment), limits)


def fig_marks(s: Study) -> DataFrame:
    """Significant times at each signal's mark height."""
    heights = F.create_map(*[F.lit(v) for pair in figures.MARK_HEIGHT.items() for v in pair])
    found = s.significant_times(list(figures.MARK_HEIGHT))
    return figures.marks(found, heights[F.col("signal")])


def fig_overlay(s: Study) -> DataFrame:
    """Overlay of gaze and head: the two ribbons, and marks at their significant times."""
    lines = figures.ribbon(s.eye_head_overlay().withColumnRenamed("bias", "mean")).select(
        F.lit("line").alias("layer"), "type", "time_ms", F.col("mean").alias("y"), "ymin", "ymax")
    kind = F.when(F.col("signal") == "gaze", F.lit("eye")).otherwise(F.lit("head"))
    height = F.when(F.col("signal") == "gaze", F.lit(figures.OVERLAY_MARK_HEIGHT["eye"])).otherwise(
        F.lit(figures.OVERLAY_MARK_HEIGHT["head"]))
    none = F.lit(None).cast("double")
    points = figures.marks(s.significant_times(["head_direction", "gaze"]), height).select(
        F.lit("mark").alias("layer"), kind.alias("type"), "time_ms", "y",
        none.alias("ymin"), none.alias("ymax"))
    return lines.unionByName(points)


def build() -> dict[str, Query]:
    q: dict[str, Query] = {
        "ingest_csv": ingest_csv,
        "ingest_growing": ingest_growing,
        "route_experiment": _of_rows(route_experiment),
        "union_experiments": _of_rows(union_experiments),
        "project_signal": _of_rows(project_signal),
        "artefact_rows": _of_rows(lambda r: exclusion.artefact_rows(r, P).select(
            *KEYS, "Time", "eyeX", "headBiasX", "headRoll", "headYaw"), exact=True),
        "bad_trials": _of_rows(lambda r: exclusion.bad_trials(r, P)),
        "bad_trials_by_item": _of_rows(lambda r: exclusion.bad_trials_by_item(exclusion.bad_trials(r, P))),
        "excl_per_subject": _of_rows(
            lambda r: exclusion.excluded_per_subject(exclusion.bad_trials(r, P), P)),
        "excl_overall": _of_rows(lambda r: exclusion.exclusion_report(r, P)),
        "excl_overall_all_subjects": _of_rows(
            lambda r: exclusion.exclusion_report(r, P, include_clean_subjects=True)),
        "summary_se": _of_study(lambda s: s.exclusion_summary()),
        "clean_rows": _of_study(clean_rows),
        "sma_stream": _of_study(sma("stream")),
        "sma_experiment": _of_study(sma("experiment")),
        "sma_trial": _of_study(sma("trial")),
        "baseline_mean": _of_study(baseline_mean),
        "baseline_correct": _of_study(baseline_correct),
        "block_mean": _of_study(lambda s: s.block_means(ALL_SIGNALS)),
        "subject_mean": _of_study(lambda s: s.subject_means(ALL_SIGNALS)),
        "subject_mean_exp": _of_study(lambda s: s.subject_means(ALL_SIGNALS, "experiment")),
        "eye_head_overlay": _of_study(lambda s: s.eye_head_overlay()),
        "preview_surrogate": _of_study(preview_surrogate),
        "behav_rows": _of_rows(lambda r: behaviour.cue_rows(r).select(
            EXPERIMENT, *KEYS, "Time", *MEASURES), exact=True),
        "behav_block": _of_study(lambda s: behaviour.behaviour_blocks(s.clean())),
        "behav_subject": _of_study(lambda s: s.behaviour_subjects()),
        "behaviour_summary": _of_study(lambda s: s.behaviour_summary()),
        "behaviour_anova": _of_study(lambda s: s.behaviour_anova()),
        "behaviour_bayes": _of_study(lambda s: s.behaviour_bayes()),
        "density_rows": _of_rows(lambda r: density.density_points(r, P)),
        "density_bandwidth": _of_rows(lambda r: density.bandwidths(density.density_points(r, P))),
        "density_1d": _of_rows(
            lambda r: density.density_1d(density.density_points(r, P), P)),
        "density_1d_binned": _of_rows(
            lambda r: density.density_1d_binned(density.density_points(r, P), P)),
        "density_1d_diff": _of_rows(lambda r: density.density_1d_difference(
            density.density_1d(density.density_points(r, P), P))),
        "kde2d": _of_rows(
            lambda r: density.density_2d(density.density_points(r, P), P)),
        "density_map": _of_rows(lambda r: density.density_map(
            density.density_2d(density.density_points(r, P), P), P)),
        "fig_density": _of_rows(lambda r: figures.density_figure(density.density_map(
            density.density_2d(density.density_points(r, P), P), P))),
        "fig_behaviour": _of_study(lambda s: s.behaviour_figure()),
        "fig_marks": _of_study(fig_marks),
        "fig_overlay": _of_study(fig_overlay),
    }
    for name in ALL_SIGNALS:
        q[f"position_{name}"] = _of_study(lambda s, n=name: s.position_summary(n))
        q[f"toward_{name}"] = _of_study(lambda s, n=name: _without_signal(s.toward([n])))
        q[f"toward_summary_{name}"] = _of_study(lambda s, n=name: s.toward_summary(n))
        q[f"toward_wide_{name}"] = _of_study(lambda s, n=name: s.toward_wide(n))
        q[f"surrogate_{name}"] = _of_study(lambda s, n=name: _without_signal(s.surrogate([n])))
        q[f"tested_rows_{name}"] = _of_study(lambda s, n=name: s.tested_rows(n))
        q[f"frame_f_{name}"] = _of_study(lambda s, n=name: _without_signal(s.frame_f([n])))
        q[f"perm_f_{name}"] = _of_study(lambda s, n=name: _without_signal(s.permutation_f([n])))
        q[f"cluster_depth_{name}"] = _of_study(lambda s, n=name: _without_signal(s.cluster_test([n])))
        q[f"residual_f_{name}"] = _of_study(lambda s, n=name: _without_signal(s.residual_f([n], RESIDUAL_PERMUTATIONS)))
        q[f"cluster_depth_residual_{name}"] = _of_study(
            lambda s, n=name: _without_signal(s.cluster_test([n], RESIDUAL_PERMUTATIONS, "residuals")))
        q[f"sig_times_{name}"] = _of_study(lambda s, n=name: _without_signal(s.significant_times([n])))
        q[f"fig_position_{name}"] = _of_study(lambda s, n=name: figures.ribbon(s.position_summary(n)))
    for name in figures.TOWARD_LIMITS:
        q[f"fig_toward_{name}"] = _of_study(fig_toward(name))
    for exp in (1, 2, 3):
        for name in figures.TOWARD_LIMITS_BY_EXPERIMENT:
            q[f"position_{name}_exp{exp}"] = _of_study(lambda s, n=name, e=exp: s.position_summary(n, e))
            q[f"fig_position_{name}_exp{exp}"] = _of_study(
                lambda s, n=name, e=exp: figures.ribbon(s.position_summary(n, e)))
            q[f"toward_{name}_exp{exp}"] = _of_study(
                lambda s, n=name, e=exp: _without_signal(s.toward([n], e)))
            q[f"toward_summary_{name}_exp{exp}"] = _of_study(lambda s, n=name, e=exp: s.toward_summary(n, e))
            q[f"fig_toward_{name}_exp{exp}"] = _of_study(fig_toward(name, exp))
        for dv in MEASURES:
            short = "rt" if dv == "ResponseTime" else dv
            q[f"summary_within_{short}_exp{exp}"] = _of_study(
                lambda s, d=dv, e=exp: s.behaviour_summary(e, d))
            q[f"anova_{short}_exp{exp}"] = _of_study(lambda s, d=dv, e=exp: s.behaviour_anova(e, d))
            q[f"paired_diff_{short}_exp{exp}"] = _of_study(lambda s, d=dv, e=exp: s.paired_differences(e, d))
            q[f"bf_{short}_exp{exp}"] = _of_study(lambda s, d=dv, e=exp: s.behaviour_bayes(e, d))
    return q
