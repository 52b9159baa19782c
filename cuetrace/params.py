"""Analysis parameters. The defaults are the published study's settings (90 Hz recordings)."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    ms_per_frame: float = 1000 / 90
    baseline: int = 19            # baseline window: -baseline < cueFrame <= 0
    baseline_excl: int = 46       # artefact window starts after -baseline_excl
    posttrigger: int = 180        # every window ends before this frame
    smooth_window: int = 4        # trailing moving average, rows
    position_limit: float = 0.5   # metres, eyeX and headBiasX
    angle_limit: float = 20.0     # degrees, headRoll and headYaw
    trials_per_subject: int = 300
    seed: int = 22
    permutations: int = 5000
    alpha: float = 0.05
    density_from: int = 45        # density window: density_from < cueFrame < posttrigger
    grid_limit: float = 200.0     # density grids span -limit .. limit (cm)
    grid_size: int = 200          # cells per axis of the 2-D grid
    kde_width: float = 40.0       # 2-D bandwidth; the kernel sd is a quarter of it
    line_points: int = 512        # points of the 1-D density grid
    prior_scale: float = 2 ** 0.5 / 2
    confidence: float = 0.95

    @property
    def first_frame(self) -> int:
        return 1 - self.baseline

    @property
    def last_frame(self) -> int:
        return self.posttrigger - 1

    @property
    def frames(self) -> list[int]:
        """All frames of the analysis window, ascending."""
        return list(range(self.first_frame, self.last_frame + 1))


# The `trace` view over the test tables has frames -10..29 and 70 trials per subject.
TRACE_PARAMS = Params(baseline=10, baseline_excl=10, posttrigger=30, density_from=5,
                      trials_per_subject=70)
