"""One study: a stored recording table and the end products computed from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cuetrace.operators import averaging, baseline, behaviour, density, exclusion, figures, inference
from cuetrace.operators import permutation, reshape, smoothing, summary, surrogate
from cuetrace.params import Params
from cuetrace.schema import EXPERIMENT, ITEM_LEFT, ITEM_RIGHT, MEASURES, PHASE, SEQ, SIGNALS, TRIAL
from cuetrace.workspace import delete_stored, materialize

ALL_SIGNALS = list(SIGNALS)


class Study:
    """`rows` is the recording table (`store_recordings`); all results are DataFrames.

    Signals go by result name (`head_direction`, `gaze`, `translation`, `roll`, `yaw`).
    `experiment` restricts a result to one experiment, whose rows then form a stream of
    their own. What several results need is stored when first needed: the bad trials (one
    row each), the subject means (subjects x items x frames) of all `signals`, from one pass
    over the rows, and a test's permuted F. Everything after the means works on them.
    """

    def __init__(self, rows: DataFrame, params: Params = Params(), *, signals: list[str] = ALL_SIGNALS,
                 scope: str = "stream", strict: bool = True):
        self.rows, self.params, self.signals, self.scope, self.strict = rows, params, signals, scope, strict
        self._bad: DataFrame | None = None
        self._means: dict[str, DataFrame] = {}
        self._permuted: dict[tuple, DataFrame] = {}

    def close(self) -> None:
        """Delete what this study has stored (not `rows`). Results read from it cannot run afterwards;
        a later call stores anew. `workspace.clear` deletes all tables of the application."""
        for stored in [self._bad, *self._means.values(), *self._permuted.values()]:
            if stored is not None:
                delete_stored(stored)
        self._bad, self._means, self._permuted = None, {}, {}

    # exclusion

    def bad_trials(self) -> DataFrame:
        if self._bad is None:
            self._bad = materialize(exclusion.bad_trials(self.rows, self.params), "bad-trials")
        return self._bad

    def clean(self, experiment: int | None = None) -> DataFrame:
        rows = self.rows if experiment is None else self.rows.filter(F.col(EXPERIMENT) == experiment)
        return exclusion.clean_rows(rows, self.bad_trials())

    def exclusion_report(self, **options) -> DataFrame:
        return exclusion.exclusion_report(self.rows, self.params, **options)

    def exclusion_summary(self) -> DataFrame:
        per_subject = exclusion.excluded_per_subject(self.bad_trials(), self.params)
        return summary.summary_se(per_subject, "prop", [], self.params)

    # signals

    def smoothed(self, names: list[str], scope: str | None = None, *, keep_chunk: bool = False) -> DataFrame:
        """Clean rows with the signals in reported units, smoothed."""
        columns = [SIGNALS[n] for n in names]
        rows = self.clean().select(*TRIAL, "item", "cueFrame", PHASE, EXPERIMENT, SEQ, *columns)
        return smoothing.moving_average(
            baseline.rescale(rows, columns), columns, self.params.smooth_window, scope=scope or self.scope,
            keep_chunk=keep_chunk)

    def block_means(self, names: list[str], scope: str | None = None) -> DataFrame:
        columns = [SIGNALS[n] for n in names]
        cells = averaging.trial_cells(self.smoothed(names, scope, keep_chunk=True), columns, self.params)
        return averaging.block_means(cells, columns, self.params)

    def subject_means(self, names: list[str], scope: str | None = None) -> DataFrame:
        return averaging.subject_means(self.block_means(names, scope), [SIGNALS[n] for n in names])

    def stored_means(self, experiment: int | None = None) -> DataFrame:
        """Stored subject means, pooled or of one experiment.

        One pass with the smoothing confined to experiments serves all of them.
        """
        scope = self.scope if experiment is None or self.scope == "trial" else "experiment"
        if scope not in self._means:
            self._means[scope] = materialize(self.subject_means(self.signals, scope), "subject-means")
        means = self._means[scope]
        return means if experiment is None else means.filter(F.col(EXPERIMENT) == experiment)

    def toward(self, names: list[str], experiment: int | None = None) -> DataFrame:
        """Long form: (signal, SubNr, cueFrame, phase, value)."""
        columns = {n: SIGNALS[n] for n in names}
        wide = averaging.toward(self.stored_means(experiment), list(columns.values()))
        return averaging.long_form(wide, ["SubNr", "cueFrame", PHASE], columns, "signal", "value")

    def _time(self):
        return (F.col("cueFrame").cast("double") * F.lit(self.params.ms_per_frame)).alias("time_ms")

    def position_summary(self, name: str, experiment: int | None = None) -> DataFrame:
        """item, cue_frame, n, mean, sd, se, ci, time_ms over subjects."""
        stats = summary.summary_se(self.stored_means(experiment), SIGNALS[name], ["item", "cueFrame"], self.params)
        return stats.select("item", F.col("cueFrame").alias("cue_frame"), "n", "mean", "sd", "se", "ci",
                            self._time())

    def toward_summary(self, name: str, experiment: int | None = None) -> DataFrame:
        """cue_frame, n, mean, sd, se, ci, time_ms over the subjects that have a value."""
        stats = summary.summary_se(self.toward([name], experiment), "value", ["cueFrame"], self.params,
                                   na_rm=True)
        return stats.select(F.col("cueFrame").alias("cue_frame"), "n", "mean", "sd", "se", "ci", self._time())

    def eye_head_overlay(self) -> DataFrame:
        return figures.overlay({"head": self.toward_summary("head_direction"),
                                "eye": self.toward_summary("gaze")})

    # tests over time

    def toward_wide(self, name: str) -> DataFrame:
        return reshape.spread_frames(self.toward([name]), ["SubNr", PHASE], "value", self.params.frames)

    def _test_inputs(self, names: list[str]) -> tuple[DataFrame, DataFrame]:
        values = self.toward(names)
        stats = summary.summary_se(values, "value", ["signal", "cueFrame"], self.params, na_rm=True)
        return values, surrogate.cohort_scalars(stats, self.params, strict=self.strict)

    def _with_surrogate(self, names: list[str]) -> DataFrame:
        return surrogate.with_surrogate(*self._test_inputs(names), self.params, strict=self.strict)

    def surrogate(self, names: list[str]) -> DataFrame:
        return surrogate.surrogate_rows(self._with_surrogate(names))

    def tested_rows(self, name: str) -> DataFrame:
        """Observed and random subjects under each other, wide, as they enter the test."""
        frames, keys = self.params.frames, ["SubNr", PHASE]
        random = reshape.spread_frames(self.surrogate([name]), keys, "value", frames)
        return self.toward_wide(name).unionByName(random)

    def differences(self, names: list[str]) -> DataFrame:
        return surrogate.cohort_differences(self._with_surrogate(names))

    def frame_f(self, names: list[str]) -> DataFrame:
        return permutation.frame_f(self.differences(names))

    def permutation_f(self, names: list[str], permutations: int | None = None) -> DataFrame:
        return permutation.permutation_f(self.differences(names), permutations or self.params.permutations,
                                         self.params)

    def residual_f(self, names: list[str], permutations: int | None = None) -> DataFrame:
        return permutation.residual_f(self.differences(names), permutations or self.params.permutations, self.params)

    def stored_permutation_f(self, names: list[str], permutations: int, method: str = "signs") -> DataFrame:
        """`permutation_f` (or `residual_f`), stored: signals x permutations x frames rows, read several times by the test."""
        key = (*sorted(names), permutations, method)
        if key not in self._permuted:
            draw = {"signs": self.permutation_f, "residuals": self.residual_f}[method]
            self._permuted[key] = materialize(draw(names, permutations), "permutation-f")
        return self._permuted[key]

    def cluster_test(self, names: list[str], permutations: int | None = None, method: str = "signs") -> DataFrame:
        """signal, cueFrame, f, cluster_id, p, time_ms. `method`: `signs` or `residuals`."""
        count = permutations or self.params.permutations
        _, scalars = self._test_inputs(names)
        drawn = self.stored_permutation_f(names, count, method)
        return permutation.cluster_depth(drawn, scalars, count, self.params).select("*", self._time())

    def significant_times(self, names: list[str], permutations: int | None = None, method: str = "signs") -> DataFrame:
        return permutation.significant_frames(self.cluster_test(names, permutations, method), self.params)

    # behaviour

    def behaviour_subjects(self, experiment: int | None = None) -> DataFrame:
        """(ExpNr, SubNr, item, phase, measure, value), both measures and all experiments at once."""
        blocks = behaviour.behaviour_blocks(self.clean(experiment))
        return behaviour.by_measure(behaviour.behaviour_subjects(blocks))

    def _measures(self, experiment: int | None, measure: str | None) -> DataFrame:
        rows = self.behaviour_subjects(experiment)
        return rows if measure is None else rows.filter(F.col("measure") == measure)

    def behaviour_summary(self, experiment: int | None = None, measure: str | None = None) -> DataFrame:
        return summary.summary_within(self._measures(experiment, measure), "value", "item",
                                      [EXPERIMENT, "measure"], self.params)

    def behaviour_anova(self, experiment: int | None = None, measure: str | None = None) -> DataFrame:
        return inference.rm_anova(self._measures(experiment, measure), "value", "item",
                                  [ITEM_LEFT, ITEM_RIGHT], [EXPERIMENT, "measure"], self.params)

    def paired_differences(self, experiment: int | None = None, measure: str | None = None) -> DataFrame:
        return behaviour.paired_differences(self._measures(experiment, measure))

    def behaviour_bayes(self, experiment: int | None = None, measure: str | None = None) -> DataFrame:
        return inference.bayes_ttest(self.paired_differences(experiment, measure), "diff",
                                     [EXPERIMENT, "measure"], self.params)

    def behaviour_figure(self, experiment: int | None = None) -> DataFrame:
        return figures.behaviour_bars(self.behaviour_summary(experiment), self.behaviour_subjects(experiment))

    # densities: raw rows, bad trials included

    def density_points(self) -> DataFrame:
        return density.density_points(self.rows, self.params)

    def density_2d(self) -> DataFrame:
        return density.density_2d(self.density_points(), self.params)

    def density_map(self) -> DataFrame:
        return density.density_map(self.density_2d(), self.params)

    def density_1d(self) -> DataFrame:
        return density.density_1d(self.density_points(), self.params)

    def density_1d_binned(self) -> DataFrame:
        return density.density_1d_binned(self.density_points(), self.params)

    def density_1d_difference(self) -> DataFrame:
        return density.density_1d_difference(self.density_1d())


__all__ = ["ALL_SIGNALS", "MEASURES", "Study"]
