"""DuckDB SQL for every query of `catalog.queries`, over the same test tables.

The texts use other means than the Spark plans (one global window, full joins, row-level
baselines, closed t-distribution series) so that agreement says something.
"""

from __future__ import annotations

from cuetrace.operators import figures
from catalog.queries import RESIDUAL_PERMUTATIONS
from cuetrace.params import TRACE_PARAMS as P
from cuetrace.plans.study import ALL_SIGNALS
from cuetrace.schema import MEASURES, SIGNAL_FACTOR, SIGNALS
from cuetrace.sources.recordings import ROUTES
from cuetrace.sources.trace import TRACE_COLUMNS, TRACE_ORDER

COLUMNS = list(SIGNALS.values())
DIGITS, SHIFT = 6, "1.234567e-9::DOUBLE"  # as in catalog.queries
DENSITY_DIGITS, DENSITY_SHIFT = 12, "1.234567e-15::DOUBLE"

ANALYSIS = f"cueFrame > {-P.baseline} AND cueFrame < {P.posttrigger}"
BEFORE = f"cueFrame > {-P.baseline} AND cueFrame <= 0"
ARTEFACT = (f"(abs(eyeX) > {P.position_limit} OR abs(headBiasX) > {P.position_limit} "
            f"OR abs(headRoll) > {P.angle_limit} OR abs(headYaw) > {P.angle_limit}) "
            f"AND cueFrame > {-P.baseline_excl} AND cueFrame < {P.posttrigger}")
TIME = f"CAST(cueFrame AS DOUBLE) * (1000.0::DOUBLE / 90)"


def r(expr: str, name: str) -> str:
    digits, shift = (DENSITY_DIGITS, DENSITY_SHIFT) if name == "density" else (DIGITS, SHIFT)
    return f"round({expr} + {shift}, {digits}) + 0.0 AS {name}"


def rs(names: list[str]) -> str:
    return ", ".join(r(n, n) for n in names)


def strict(x: str) -> str:
    return f"CASE WHEN count({x}) = count(*) THEN avg({x}) END"


TRACE = f"""trace AS MATERIALIZED (
SELECT {TRACE_COLUMNS.rstrip()},
  row_number() OVER (ORDER BY {", ".join(TRACE_ORDER)}) AS seq, 'same' AS phase
FROM lineitem)"""

BAD = f"""bad AS MATERIALIZED (
SELECT DISTINCT SubNr, item, block, trial, phase FROM trace WHERE Time IS NOT NULL AND {ARTEFACT})"""

CLEAN = """clean AS MATERIALIZED (
SELECT t.* FROM trace t LEFT JOIN bad b
  ON t.SubNr = b.SubNr AND t.item = b.item AND t.block = b.block AND t.trial = b.trial AND t.phase = b.phase
WHERE b.SubNr IS NULL)"""

CLEAN_CTES = [TRACE, BAD, CLEAN]


def smooth(columns: list[str], scope: str = "stream", experiment: int | None = None) -> str:
    part = {"stream": "", "experiment": "PARTITION BY ExpNr", "trial": "PARTITION BY SubNr, block, trial"}[scope]
    n = P.smooth_window
    means = ",\n  ".join(
        f"CASE WHEN count({c}) OVER w = {n} THEN avg({c} * {SIGNAL_FACTOR[c]}::DOUBLE) OVER w END AS {c}"
        for c in columns)
    where = "" if experiment is None else f"WHERE ExpNr = {experiment}"
    return f"""smooth AS MATERIALIZED (
SELECT seq, SubNr, ExpNr, block, trial, item, cueFrame, phase,
  {means}
FROM clean {where}
WINDOW w AS ({part} ORDER BY seq ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW))"""


def corrected(columns: list[str]) -> list[str]:
    """Row-level baseline, block means and subject means."""
    bases = ", ".join(f"avg({c}) AS {c}_base" for c in columns)
    minus = ", ".join(f"s.{c} - b.{c}_base AS {c}" for c in columns)
    means = ", ".join(f"{strict(c)} AS {c}" for c in columns)
    return [
        f"base AS (SELECT SubNr, block, trial, {bases} FROM smooth WHERE {BEFORE} GROUP BY SubNr, block, trial)",
        f"""corr AS MATERIALIZED (SELECT s.seq, s.ExpNr, s.SubNr, s.block, s.trial, s.item, s.cueFrame, s.phase, {minus}
FROM smooth s LEFT JOIN base b ON s.SubNr = b.SubNr AND s.block = b.block AND s.trial = b.trial)""",
        f"""blk AS (SELECT ExpNr, SubNr, block, item, cueFrame, phase, {means} FROM corr WHERE {ANALYSIS}
GROUP BY ExpNr, SubNr, block, item, cueFrame, phase)""",
        f"""subj AS MATERIALIZED (SELECT ExpNr, SubNr, item, cueFrame, phase, {means} FROM blk
GROUP BY ExpNr, SubNr, item, cueFrame, phase)"""]


def toward(column: str) -> str:
    return f"""toward AS MATERIALIZED (
SELECT coalesce(r.SubNr, l.SubNr) AS SubNr, coalesce(r.cueFrame, l.cueFrame) AS cueFrame, r.phase AS phase,
  (r.{column} - l.{column}) / 2 AS value
FROM (SELECT * FROM subj WHERE item = 'item R') r
FULL JOIN (SELECT * FROM subj WHERE item = 'item L') l ON r.SubNr = l.SubNr AND r.cueFrame = l.cueFrame)"""


def signal_ctes(name: str, experiment: int | None = None) -> list[str]:
    c = SIGNALS[name]
    return [*CLEAN_CTES, smooth([c], experiment=experiment), *corrected([c]), toward(c)]


# Student's t: P(|T| < t) by the finite trigonometric series; quantiles by bisection.
def t_inside(theta: str, df: str) -> str:
    odd = (f"2 / pi() * ({theta} + sin({theta}) * coalesce(list_sum(list_transform(range(1, ({df} - 1) // 2 + 1), "
           f"lambda k: exp((k - 1) * ln(4.0) + 2 * lgamma(k) - lgamma(2 * k)) * power(cos({theta}), 2 * k - 1))), 0))")
    even = (f"sin({theta}) * (1 + coalesce(list_sum(list_transform(range(1, ({df} - 2) // 2 + 1), "
            f"lambda k: exp(lgamma(2 * k + 1) - k * ln(4.0) - 2 * lgamma(k + 1)) * power(cos({theta}), 2 * k))), 0))")
    return f"(CASE WHEN {df} % 2 = 1 THEN {odd} ELSE {even} END)"


def t_table(source: str) -> str:
    """CTE tq(df, t) for the distinct n - 1 of a CTE with a column n."""
    inside = t_inside("theta", "df")
    return f"""bis AS (
  SELECT DISTINCT n - 1 AS df, 0.0::DOUBLE AS lo, 1000.0::DOUBLE AS hi, 0 AS step FROM {source} WHERE n > 1
  UNION ALL
  SELECT df, CASE WHEN below THEN mid ELSE lo END, CASE WHEN below THEN hi ELSE mid END, step + 1
  FROM (SELECT df, lo, hi, mid, step, {inside} < {P.confidence} AS below
        FROM (SELECT *, (lo + hi) / 2 AS mid, atan((lo + hi) / 2 / sqrt(df)) AS theta FROM bis WHERE step < 100))),
tq AS MATERIALIZED (SELECT df, hi AS t FROM bis WHERE step = 100)"""


def summary(source: str, measure: str, by: list[str], na_rm: bool) -> list[str]:
    keys = "".join(f"{k}, " for k in by)
    group = f"GROUP BY {', '.join(by)}" if by else ""
    if na_rm:
        stats = f"count({measure}) AS n, avg({measure}) AS mean, stddev_samp({measure}) AS sd"
    else:
        ok = f"CASE WHEN count({measure}) = count(*) THEN"
        stats = f"count(*) AS n, {ok} avg({measure}) END AS mean, {ok} stddev_samp({measure}) END AS sd"
    return [f"stats AS MATERIALIZED (SELECT {keys}{stats} FROM {source} {group})", t_table("stats"),
            f"summ AS MATERIALIZED (SELECT stats.*, sd / sqrt(n) AS se, sd / sqrt(n) * t AS ci "
            f"FROM stats LEFT JOIN tq ON df = n - 1)"]


def position_ctes(name: str, experiment: int | None = None) -> list[str]:
    return [*signal_ctes(name, experiment), *summary("subj", SIGNALS[name], ["item", "cueFrame"], False)]


def toward_summary_ctes(name: str, experiment: int | None = None) -> list[str]:
    return [*signal_ctes(name, experiment), *summary("toward", "value", ["cueFrame"], True)]


SUMMARY_COLUMNS = f"n, {rs(['mean', 'sd', 'se', 'ci'])}"


def query(ctes: list[str], select: str) -> str:
    return f"WITH RECURSIVE {', '.join(ctes)} {select}"


# surrogate cohort, permutation test

def uniform(*key: str) -> str:
    return f"CAST(('0x' || substr(md5(concat_ws('|', {', '.join(key)})), 1, 8)) AS UBIGINT)::DOUBLE / 4294967296.0::DOUBLE"


def test_ctes(name: str) -> list[str]:
    key = [f"'{P.seed}'", f"'{name}'", "SubNr", "cueFrame"]
    draw = (f"sqrt(-2.0 * ln({uniform(*key, '1')} + 1.0::DOUBLE / 4294967296.0::DOUBLE)) "
            f"* cos(2.0 * pi() * ({uniform(*key, '2')}))")
    return [
        *toward_summary_ctes(name),
        "scal AS MATERIALIZED (SELECT max(n) AS n_subjects, avg(sd) AS mean_sd FROM stats)",
        f"surr AS MATERIALIZED (SELECT SubNr, cueFrame, 'random' AS phase, ({draw}) * mean_sd AS value FROM toward, scal)",
        "d AS MATERIALIZED (SELECT t.SubNr, t.cueFrame, t.value - s.value AS d FROM toward t JOIN surr s "
        "ON t.SubNr = s.SubNr AND t.cueFrame = s.cueFrame WHERE t.value IS NOT NULL)"]


FRAME_F = """framef AS (SELECT cueFrame, count(d) AS n, count(d) * avg(d) * avg(d) / nullif(var_samp(d), 0) AS f
FROM d GROUP BY cueFrame)"""


def perm_ctes(name: str) -> list[str]:
    return [
        *test_ctes(name),
        f"""flips AS MATERIALIZED (SELECT SubNr, perm,
  CASE WHEN perm = 0 OR (instr('0123456789abcdef', substr(md5(concat_ws('|', '{P.seed}', '{name}', perm // 128, SubNr)),
                                                          1 + perm % 128 // 4, 1)) - 1) >> (3 - perm % 4) & 1 = 0
       THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS flip
FROM (SELECT DISTINCT SubNr FROM d), (SELECT range::INT AS perm FROM range({P.permutations})))""",
        """permf AS MATERIALIZED (SELECT perm, cueFrame, n * (s / n) * (s / n) / nullif((q - n * (s / n) * (s / n)) / nullif(n - 1, 0), 0) AS f
FROM (SELECT perm, cueFrame, count(*)::DOUBLE AS n, sum(flip * d) AS s, sum(d * d) AS q
      FROM d JOIN flips USING (SubNr) GROUP BY perm, cueFrame))"""]


def residual_ctes(name: str) -> list[str]:
    """Cells in the order of their keys within each permutation and frame; two after each other are a subject's."""
    key = f"md5(concat_ws('|', '{P.seed}', '{name}', perm, SubNr))"
    return [
        *test_ctes(name),
        f"""keys AS MATERIALIZED (SELECT SubNr, perm, {key} AS digest
FROM (SELECT DISTINCT SubNr FROM d), (SELECT range::INT AS perm FROM range(1, {RESIDUAL_PERMUTATIONS})))""",
        """cells AS (SELECT perm, cueFrame, e, row_number() OVER (PARTITION BY perm, cueFrame ORDER BY k) - 1 AS place FROM (
  SELECT perm, cueFrame, d / 2 AS e, substr(digest, 1, 16) AS k FROM d JOIN keys USING (SubNr)
  UNION ALL SELECT perm, cueFrame, -d / 2, substr(digest, 17, 16) FROM d JOIN keys USING (SubNr)))""",
        """dealt AS (SELECT perm, cueFrame, sum(CASE WHEN place % 2 = 0 THEN e ELSE -e END) AS d FROM cells GROUP BY perm, cueFrame, place // 2
UNION ALL SELECT 0, cueFrame, d FROM d)""",
        """permf AS MATERIALIZED (SELECT perm, cueFrame, n * (s / n) * (s / n) / nullif((q - n * (s / n) * (s / n)) / nullif(n - 1, 0), 0) AS f
FROM (SELECT perm, cueFrame, count(*)::DOUBLE AS n, sum(d) AS s, sum(d * d) AS q FROM dealt GROUP BY perm, cueFrame))"""]


def depth_ctes(name: str, residual: bool = False) -> list[str]:
    np = RESIDUAL_PERMUTATIONS if residual else P.permutations
    return [
        *(residual_ctes(name) if residual else perm_ctes(name)),
        "thr AS (SELECT t * t AS tau FROM tq, scal WHERE df = n_subjects - 1)",
        """runs AS MATERIALIZED (SELECT *, min(cueFrame) OVER g AS first, max(cueFrame) OVER g AS last FROM (
  SELECT perm, cueFrame, f, cueFrame - row_number() OVER (PARTITION BY perm ORDER BY cueFrame) AS run
  FROM permf, thr WHERE f > tau) WINDOW g AS (PARTITION BY perm, run))""",
        f"""dep AS MATERIALIZED (
  SELECT 'head' AS test, perm, first, cueFrame, f, cueFrame - first + 1 AS depth FROM runs WHERE first > {P.first_frame}
  UNION ALL
  SELECT 'tail', perm, first, cueFrame, f, last - cueFrame + 1 FROM runs WHERE last < {P.last_frame})""",
        "nul AS MATERIALIZED (SELECT test, perm, depth, max(f) AS f FROM dep GROUP BY test, perm, depth)",
        f"""stat AS MATERIALIZED (SELECT o.test, o.first, o.depth, o.cueFrame, p.perm,
  CASE WHEN p.perm = 0 THEN o.f ELSE coalesce(nul.f, 0) END AS stat
FROM (SELECT * FROM dep WHERE perm = 0) o CROSS JOIN (SELECT range::INT AS perm FROM range({np})) p
LEFT JOIN nul ON nul.test = o.test AND nul.perm = p.perm AND nul.depth = o.depth)""",
        f"""pv AS MATERIALIZED (SELECT *, max(CASE WHEN perm = 0 THEN p END) OVER (PARTITION BY test, first, depth) AS p0 FROM (
  SELECT *, count(*) OVER (PARTITION BY test, first, depth ORDER BY stat DESC RANGE UNBOUNDED PRECEDING) / {np}.0::DOUBLE AS p
  FROM stat))""",
        """adj AS (SELECT test, first, depth, cueFrame, any_value(p0) AS p0, avg(CASE WHEN q <= p0 THEN 1.0 ELSE 0.0 END) AS a
FROM (SELECT *, min(p) OVER (PARTITION BY test, first, perm ORDER BY p0, depth
                             ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q FROM pv)
GROUP BY test, first, depth, cueFrame)""",
        """res AS (SELECT cueFrame, max(p) AS p FROM (
  SELECT *, max(a) OVER (PARTITION BY test, first ORDER BY p0, depth ROWS UNBOUNDED PRECEDING) AS p FROM adj)
GROUP BY cueFrame)""",
        f"""tested AS MATERIALIZED (SELECT f.cueFrame, f.f, coalesce(c.cluster_id, 0) AS cluster_id, res.p, {TIME.replace("cueFrame", "f.cueFrame")} AS time_ms
FROM (SELECT * FROM permf WHERE perm = 0) f
LEFT JOIN (SELECT cueFrame, dense_rank() OVER (ORDER BY first)::INT AS cluster_id FROM runs WHERE perm = 0) c
  ON f.cueFrame = c.cueFrame
LEFT JOIN res ON f.cueFrame = res.cueFrame)"""]


def sig_select(extra: str = "") -> str:
    return f"SELECT cueFrame, time_ms, p{extra} FROM tested WHERE p < {P.alpha}"


def frame_columns(value: str) -> str:
    return ", ".join(
        r(f"max(CASE WHEN cueFrame = {f} THEN {value} END)", f"f_m{-f}" if f < 0 else f"f_{f}") for f in P.frames)


# behaviour

BEHAVIOUR = [
    *CLEAN_CTES,
    """bblk AS (SELECT ExpNr, SubNr, block, item, phase, avg(error) AS error, avg(ResponseTime) AS ResponseTime
FROM clean WHERE cueFrame = 0 AND error IS NOT NULL AND ResponseTime IS NOT NULL GROUP BY ExpNr, SubNr, block, item, phase)""",
    """bsub AS (SELECT ExpNr, SubNr, item, phase, avg(error) AS error, avg(ResponseTime) AS ResponseTime
FROM bblk GROUP BY ExpNr, SubNr, item, phase)""",
    """blong AS MATERIALIZED (SELECT ExpNr, SubNr, item, phase, 'error' AS measure, error AS value FROM bsub
UNION ALL SELECT ExpNr, SubNr, item, phase, 'ResponseTime', ResponseTime FROM bsub)"""]

WITHIN = [
    *BEHAVIOUR,
    """gm AS (SELECT ExpNr, measure, avg(value) AS g, count(DISTINCT item) AS k FROM blong GROUP BY ExpNr, measure)""",
    """sm AS (SELECT ExpNr, measure, SubNr, avg(value) AS s FROM blong GROUP BY ExpNr, measure, SubNr)""",
    """stats AS MATERIALIZED (SELECT b.ExpNr, b.measure, b.item, count(*) AS n, avg(value) AS mean, avg(value - s + g) AS mean_norm,
  stddev_samp(value - s + g) * sqrt(any_value(k)::DOUBLE / (any_value(k) - 1)) AS sd
FROM blong b JOIN gm ON b.ExpNr = gm.ExpNr AND b.measure = gm.measure
JOIN sm ON b.ExpNr = sm.ExpNr AND b.measure = sm.measure AND b.SubNr = sm.SubNr
GROUP BY b.ExpNr, b.measure, b.item)""",
    t_table("stats"),
    """summ AS MATERIALIZED (SELECT stats.*, sd / sqrt(n) AS se, sd / sqrt(n) * t AS ci
FROM stats LEFT JOIN tq ON df = n - 1)"""]

DIFF = [*BEHAVIOUR, """diff AS MATERIALIZED (SELECT r.ExpNr, r.measure, r.SubNr, r.value - l.value AS diff
FROM blong r JOIN blong l ON r.ExpNr = l.ExpNr AND r.measure = l.measure AND r.SubNr = l.SubNr
WHERE r.item = 'item R' AND l.item = 'item L')"""]

# Two levels: F is the squared paired t; its sums of squares follow from the differences.
ANOVA = [
    *DIFF,
    """two AS (SELECT b.* FROM blong b JOIN diff d ON b.ExpNr = d.ExpNr AND b.measure = d.measure AND b.SubNr = d.SubNr)""",
    """ss AS (SELECT ExpNr, measure, count(*) AS n, count(*) * avg(diff) * avg(diff) / 2 AS ss_item, var_pop(diff) * count(*) / 2 AS ss_err,
  count(*) * avg(diff) * avg(diff) / nullif(var_samp(diff), 0) AS f FROM diff GROUP BY ExpNr, measure)""",
    """su AS (SELECT ExpNr, measure, 2 * count(*) * var_pop(m) AS ss_subj FROM
  (SELECT ExpNr, measure, SubNr, avg(value) AS m FROM two GROUP BY ExpNr, measure, SubNr) GROUP BY ExpNr, measure)""",
    f"""av AS (SELECT ss.ExpNr, ss.measure, 'item' AS effect, 1.0::DOUBLE AS dfn, (n - 1)::DOUBLE AS dfd, f,
  1 - {t_inside("theta", "(n - 1)")} AS p, ss_item / nullif(ss_item + ss_subj + ss_err, 0) AS ges
FROM (SELECT *, atan(sqrt(f) / sqrt(n - 1)) AS theta FROM ss) ss
JOIN su ON ss.ExpNr = su.ExpNr AND ss.measure = su.measure)"""]

BAYES = [
    *DIFF,
    """tt AS (SELECT ExpNr, measure, count(*) AS n, avg(diff) / nullif(stddev_samp(diff), 0) * sqrt(count(*)) AS t
FROM diff GROUP BY ExpNr, measure)""",
    f"""bf AS (SELECT ExpNr, measure, n, t, sum(w * 0.05
    * power(1 + n * {P.prior_scale * P.prior_scale!r} * g, -0.5)
    * power(1 + t * t / ((1 + n * {P.prior_scale * P.prior_scale!r} * g) * (n - 1)), -n / 2.0)
    * power(2 * pi(), -0.5) * power(g, -1.5) * exp(-1 / (2 * g)) * g)
  / power(1 + t * t / (n - 1), -n / 2.0) AS bf10
FROM tt, (SELECT exp(range * 0.05::DOUBLE) AS g, CASE WHEN abs(range) = 400 THEN 0.5 ELSE 1.0 END AS w FROM range(-400, 401))
GROUP BY ExpNr, measure, n, t)"""]

ANOVA_COLUMNS = ("ExpNr AS exp_nr, measure, effect, dfn, dfd, " + rs(["f", "p"])
                 + f", p < {P.alpha} AS significant, " + r("ges", "ges"))
WITHIN_COLUMNS = "ExpNr AS exp_nr, measure, item, n, " + rs(["mean", "mean_norm", "sd", "se", "ci"])
BAYES_COLUMNS = "ExpNr AS exp_nr, measure, n, " + rs(["t", "bf10"])

# densities

POINTS = f"""points AS MATERIALIZED (
SELECT item, headBiasX * 100 AS x, headBiasY * 100 - DisplayHeight * 100 AS y FROM trace
WHERE cueFrame > {P.density_from} AND cueFrame < {P.posttrigger})"""


def kernel(at: str, x: str, sd: str) -> str:
    return f"exp(-0.5 * (({at}) - {x}) * (({at}) - {x}) / (({sd}) * ({sd}))) / (({sd}) * sqrt(2 * pi()))"


def axis(n: int) -> str:
    return f"(SELECT range + 1 AS i, {-P.grid_limit}::DOUBLE + range * ({2 * P.grid_limit}::DOUBLE / {n - 1}) AS g FROM range({n}))"


BANDWIDTH = """bw AS MATERIALIZED (SELECT item, count(*) AS n,
  0.9::DOUBLE * least(stddev_samp(x), (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) / 1.34) * power(count(*), -0.2::DOUBLE) AS bw
FROM points GROUP BY item)"""

LINE = [TRACE, POINTS, BANDWIDTH,
        f"""d1 AS MATERIALIZED (SELECT p.item, a.i, a.g AS x, any_value(bw) AS bw, sum(w * {kernel("a.g", "p.x", "bw.bw")}) / any_value(n) AS density
FROM (SELECT item, x, count(*) AS w FROM points GROUP BY item, x) p JOIN bw ON p.item = bw.item, {axis(P.line_points)} a
GROUP BY p.item, a.i, a.g)"""]

# Linear binning, then a plain sum over the bins in place of Fourier transforms, then interpolation.
BINS = 512
BINNED = [TRACE, POINTS, BANDWIDTH,
          f"""place AS (SELECT p.item, bw, n, (x + {P.grid_limit} + 4 * bw) / ((2 * {P.grid_limit} + 8 * bw) / {BINS - 1}) AS pos
FROM points p JOIN bw ON p.item = bw.item)""",
          f"""share AS MATERIALIZED (SELECT item, bw, n, bin, sum(w) / any_value(n) AS w FROM (
  SELECT item, bw, n, floor(pos) AS bin, 1 - (pos - floor(pos)) AS w FROM place
  UNION ALL SELECT item, bw, n, floor(pos) + 1, pos - floor(pos) FROM place)
WHERE bin BETWEEN 0 AND {BINS - 1} GROUP BY item, bw, n, bin)""",
          f"""smoothed AS MATERIALIZED (SELECT item, bw, range AS place, (2 * {P.grid_limit} + 8 * bw) / {BINS - 1} AS step,
  sum(w * {kernel("(range - bin) * (2 * " + str(P.grid_limit) + " + 8 * bw) / " + str(BINS - 1), "0", "bw")}) AS y
FROM share, range({BINS}) GROUP BY item, bw, range)""",
          f"""d1b AS (SELECT s.item, a.i, a.g AS x, s.bw, s.y + (t.y - s.y) * ((a.g + {P.grid_limit} + 4 * s.bw) / s.step - s.place) AS density
FROM {axis(P.line_points)} a, smoothed s JOIN smoothed t ON s.item = t.item AND t.place = s.place + 1
WHERE s.place = least({BINS - 2}, floor((a.g + {P.grid_limit} + 4 * s.bw) / s.step)))"""]

# The kernel factorises: sum over y first, then over x. Equal points are counted once.
GRID = [TRACE, POINTS,
        "wp AS MATERIALIZED (SELECT item, x, y, count(*) AS w FROM points GROUP BY item, x, y)",
        f"""gy AS MATERIALIZED (SELECT item, x, a.i AS iy, sum(w * {kernel("a.g", "y", str(P.kde_width / 4) + "::DOUBLE")}) AS s
FROM wp, {axis(P.grid_size)} a GROUP BY item, x, a.i)""",
        f"""d2 AS MATERIALIZED (SELECT item, a.i AS ix, iy, sum(s * {kernel("a.g", "x", str(P.kde_width / 4) + "::DOUBLE")})
  / (SELECT sum(w) FROM wp v WHERE v.item = gy.item) AS density
FROM gy, {axis(P.grid_size)} a GROUP BY item, a.i, iy)""",
        f"""dmap AS MATERIALIZED (SELECT r.ix, r.iy, r.ix - {P.grid_size // 2} AS x, r.iy - {P.grid_size // 2} AS y,
  {-P.grid_limit} + (r.ix - 1) * {2 * P.grid_limit / (P.grid_size - 1)!r}::DOUBLE AS x_cm,
  {-P.grid_limit} + (r.iy - 1) * {2 * P.grid_limit / (P.grid_size - 1)!r}::DOUBLE AS y_cm,
  r.density - l.density AS density
FROM d2 r JOIN d2 l ON r.ix = l.ix AND r.iy = l.iy WHERE r.item = 'item R' AND l.item = 'item L')"""]

# figures


def censor(x: str, limits: tuple[float, float], name: str) -> str:
    return r(f"CASE WHEN {x} BETWEEN {limits[0]} AND {limits[1]} THEN {x} END", name)


def fig_toward(name: str, experiment: int | None = None) -> str:
    limits = (figures.TOWARD_LIMITS if experiment is None else figures.TOWARD_LIMITS_BY_EXPERIMENT)[name]
    return query(
        toward_summary_ctes(name, experiment),
        f"""SELECT cueFrame AS cue_frame, n, {censor("mean", limits, "mean")}, {rs(["sd", "se", "ci"])},
{censor(TIME, figures.TIME_LIMITS, "time_ms")}, {censor("(mean - se)", limits, "ymin")}, {censor("(mean + se)", limits, "ymax")} FROM summ""")


def nested(ctes: list[str], select: str) -> str:
    return f"SELECT * FROM ({query(ctes, select)})"


def build() -> dict[str, str]:
    keys = "SubNr AS sub_nr, block, trial, item, cueFrame AS cue_frame"
    all_smooth = [*CLEAN_CTES, smooth(COLUMNS)]
    all_means = [*all_smooth, *corrected(COLUMNS)]
    offset = "CASE ExpNr WHEN 2 THEN 24 WHEN 3 THEN 48 ELSE 0 END"
    share = f"excl / {float(P.trials_per_subject)}::DOUBLE"
    per_subject = [TRACE, BAD, f"avgexcl AS MATERIALIZED (SELECT SubNr, count(*) AS excl, count(*) / {float(P.trials_per_subject)}::DOUBLE AS prop FROM bad GROUP BY SubNr)"]
    raw = "Time, eyeX, headBiasX, headBiasY, DisplayHeight, headX, headRoll, headYaw, ResponseTime, error"
    routes = " UNION ALL ".join(
        f"SELECT file_name, {exp} AS exp_nr, SubNr + {off} AS sub_nr FROM named WHERE regexp_matches(file_name, '{part}')"
        for part, (exp, off) in ROUTES.items())
    stems = [*ROUTES, "Practice_MEMexperimenttracking"]
    stem = "CASE trial % 4 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(stems)) + " END"
    subjects = f"SELECT ExpNr AS exp_nr, SubNr AS sub_nr, item, cueFrame AS cue_frame, phase, {rs(COLUMNS)} FROM subj"
    q = {
        "ingest_csv": query([TRACE], f"SELECT {keys}, {raw}, ExpNr AS exp_nr, seq, phase FROM trace"),
        "ingest_growing": query([TRACE], f"SELECT {keys}, {raw}, ExpNr AS exp_nr, seq, phase FROM trace"),
        "route_experiment": query(
            [TRACE, f"named AS (SELECT SubNr, {stem} || '_' || SubNr || '.csv' AS file_name FROM trace)"],
            f"SELECT file_name, exp_nr, sub_nr, count(*) AS n_rows FROM ({routes}) GROUP BY file_name, exp_nr, sub_nr"),
        "union_experiments": query([TRACE], f"""SELECT ExpNr AS exp_nr, CAST(SubNr - 8 * (ExpNr - 1) + {offset} AS INT) AS sub_nr, count(*) AS n_rows,
{r("avg(Time)", "mean_time")} FROM trace GROUP BY 1, 2"""),
        "project_signal": query([TRACE], f"""SELECT {keys}, {r("Time", "Time")}, {", ".join(r(f"{c} * {SIGNAL_FACTOR[c]}::DOUBLE", c) for c in COLUMNS)},
{r("headBiasY * 100 - DisplayHeight * 100", "head_height")}, {r(TIME, "time_ms")} FROM trace"""),
        "artefact_rows": query([TRACE], f"SELECT {keys}, Time, eyeX, headBiasX, headRoll, headYaw FROM trace WHERE {ARTEFACT}"),
        "bad_trials": query([TRACE, BAD], "SELECT SubNr AS sub_nr, item, block, trial, phase FROM bad"),
        "bad_trials_by_item": query([TRACE, BAD], "SELECT SubNr AS sub_nr, item, phase, count(*) AS excl FROM bad GROUP BY SubNr, item, phase"),
        "excl_per_subject": query(per_subject, f"SELECT SubNr AS sub_nr, excl, {r('prop', 'prop')} FROM avgexcl"),
        "summary_se": query([*per_subject, *summary("avgexcl", "prop", [], False)], f"SELECT {SUMMARY_COLUMNS} FROM summ"),
        "clean_rows": query(CLEAN_CTES, f"SELECT seq, {keys}, ExpNr AS exp_nr FROM clean"),
        "baseline_mean": query(
            [*all_smooth, corrected(COLUMNS)[0]],
            f"SELECT SubNr AS sub_nr, block, trial, {', '.join(r(f'{c}_base', f'{c}_base') for c in COLUMNS)} FROM base"),
        "baseline_correct": query([*all_smooth, *corrected(COLUMNS)[:2]], f"SELECT seq, {rs(COLUMNS)} FROM corr"),
        "block_mean": query(all_means, f"SELECT ExpNr AS exp_nr, SubNr AS sub_nr, block, item, cueFrame AS cue_frame, phase, {rs(COLUMNS)} FROM blk"),
        "subject_mean": query(all_means, subjects),
        "subject_mean_exp": " UNION ALL ".join(
            nested([*CLEAN_CTES, smooth(COLUMNS, experiment=e), *corrected(COLUMNS)], subjects) for e in (1, 2, 3)),
        "behav_rows": query([TRACE], f"SELECT ExpNr AS exp_nr, {keys}, Time, error, ResponseTime FROM trace WHERE cueFrame = 0"),
        "behav_block": query(BEHAVIOUR, f"SELECT ExpNr AS exp_nr, SubNr AS sub_nr, block, item, phase, {rs(MEASURES)} FROM bblk"),
        "behav_subject": query(BEHAVIOUR, f"SELECT ExpNr AS exp_nr, SubNr AS sub_nr, item, phase, measure, {r('value', 'value')} FROM blong"),
        "behaviour_summary": query(WITHIN, f"SELECT {WITHIN_COLUMNS} FROM summ"),
        "behaviour_anova": query(ANOVA, f"SELECT {ANOVA_COLUMNS} FROM av"),
        "behaviour_bayes": query(BAYES, f"SELECT {BAYES_COLUMNS} FROM bf"),
        "density_rows": query([TRACE, POINTS], f"SELECT item, {rs(['x', 'y'])} FROM points"),
        "density_bandwidth": query([TRACE, POINTS, BANDWIDTH], f"SELECT item, n, {r('bw', 'bw')} FROM bw"),
        "density_1d": query(LINE, f"SELECT item, i::INT AS i, {rs(['x', 'bw', 'density'])} FROM d1"),
        "density_1d_binned": query(BINNED, f"SELECT item, i::INT AS i, {rs(['x', 'bw', 'density'])} FROM d1b"),
        "density_1d_diff": query(LINE, f"""SELECT r.i::INT AS i, {r("r.x", "x")}, {r("r.density - l.density", "density")}
FROM d1 r JOIN d1 l ON r.i = l.i WHERE r.item = 'item R' AND l.item = 'item L'"""),
        "kde2d": query(GRID, f"SELECT item, ix::INT AS ix, iy::INT AS iy, {r('density', 'density')} FROM d2"),
        "density_map": query(GRID, f"SELECT ix::INT AS ix, iy::INT AS iy, x::INT AS x, y::INT AS y, {rs(['x_cm', 'y_cm', 'density'])} FROM dmap"),
        "fig_density": query(GRID, f"""SELECT 'raster' AS layer, x::DOUBLE AS x, y::DOUBLE AS y, {r("density", "density")} FROM dmap
UNION ALL SELECT 'path', {r("c + 25 * cos(range * 2 * pi() / 99)", "x")}, {r("25 * sin(range * 2 * pi() / 99)", "y")}, NULL
FROM range(100), (VALUES (-100.0::DOUBLE), (100.0::DOUBLE)) v(c)
UNION ALL SELECT 'point', c, 0.0, NULL FROM (VALUES (-100.0::DOUBLE), (100.0::DOUBLE)) v(c)
UNION ALL SELECT 'horizontal', c, 0.0, NULL FROM (VALUES (-6.0::DOUBLE), (6.0::DOUBLE)) v(c)
UNION ALL SELECT 'vertical', 0.0, c, NULL FROM (VALUES (-6.0::DOUBLE), (6.0::DOUBLE)) v(c)"""),
        "fig_behaviour": query(WITHIN, f"""SELECT ExpNr AS exp_nr, measure, item, 'bar' AS layer, 'all' AS subject, {r("mean", "y")},
{r("mean - ci", "ymin")}, {r("mean + ci", "ymax")} FROM summ
UNION ALL SELECT ExpNr, measure, item, 'point', SubNr::VARCHAR, {r("value", "y")}, NULL, NULL FROM blong
UNION ALL SELECT DISTINCT ExpNr, measure, NULL, 'chance', 'all', 45.0::DOUBLE, NULL::DOUBLE, NULL::DOUBLE FROM summ WHERE measure = 'error'"""),
    }
    for key, mean in (("excl_overall", f"avg({share})"),
                      ("excl_overall_all_subjects", f"sum({share}) / (SELECT count(DISTINCT SubNr) FROM trace)")):
        q[key] = query([*per_subject, CLEAN], f"""SELECT (SELECT count(*) FROM trace) AS n_rows, (SELECT count(*) FROM clean) AS n_kept,
{r("100 - (SELECT count(*) FROM clean) / (SELECT count(*) FROM trace)::DOUBLE * 100", "row_excl_pct")},
{r(mean + " * 100", "subj_excl_pct")}, count(*) AS n_subjects_with_bad FROM avgexcl""")
    for scope in ("stream", "experiment", "trial"):
        q[f"sma_{scope}"] = query([*CLEAN_CTES, smooth(COLUMNS, scope)], f"SELECT seq, {rs(COLUMNS)} FROM smooth")

    overlay = []
    for level, (tag, name) in enumerate((("eye", "gaze"), ("head", "head_direction")), start=1):
        overlay.append(nested(toward_summary_ctes(name), f"""SELECT cueFrame AS cue_frame, n, mean AS bias, sd, se, ci,
{TIME} AS time_ms, '{tag}' AS type, {level} AS type_level FROM summ"""))
    q["eye_head_overlay"] = (f"SELECT cue_frame, n, {rs(['bias', 'sd', 'se', 'ci', 'time_ms'])}, type, type_level "
                             f"FROM ({' UNION ALL '.join(overlay)})")
    points = [nested(depth_ctes(name), f"SELECT 'mark' AS layer, '{tag}' AS type, time_ms, "
                     f"{r(str(figures.OVERLAY_MARK_HEIGHT[tag]) + '::DOUBLE', 'y')} FROM ({sig_select()})")
              for tag, name in (("eye", "gaze"), ("head", "head_direction"))]
    q["fig_overlay"] = (f"""SELECT 'line' AS layer, type, {rs(['time_ms'])}, {r('bias', 'y')}, {r('bias - se', 'ymin')}, {r('bias + se', 'ymax')}
FROM ({' UNION ALL '.join(overlay)})
UNION ALL SELECT layer, type, {rs(['time_ms'])}, y, NULL, NULL FROM ({' UNION ALL '.join(points)})""")
    q["fig_marks"] = " UNION ALL ".join(
        nested(depth_ctes(name), f"SELECT '{name}' AS signal, {r('time_ms', 'time_ms')}, {r(f'{height}::DOUBLE', 'y')} FROM ({sig_select()})")
        for name, height in figures.MARK_HEIGHT.items())

    position = f"SELECT item, cueFrame AS cue_frame, {SUMMARY_COLUMNS}, {r(TIME, 'time_ms')} FROM summ"
    toward_rows = f"SELECT SubNr AS sub_nr, cueFrame AS cue_frame, phase, {r('value', 'value')} FROM toward"
    toward_stats = f"SELECT cueFrame AS cue_frame, {SUMMARY_COLUMNS}, {r(TIME, 'time_ms')} FROM summ"
    ribbon = f"{r('mean - se', 'ymin')}, {r('mean + se', 'ymax')}"
    for name in ALL_SIGNALS:
        q[f"position_{name}"] = query(position_ctes(name), position)
        q[f"fig_position_{name}"] = query(position_ctes(name), position.replace(" FROM summ", f", {ribbon} FROM summ"))
        q[f"toward_{name}"] = query(signal_ctes(name), toward_rows)
        q[f"toward_summary_{name}"] = query(toward_summary_ctes(name), toward_stats)
        q[f"toward_wide_{name}"] = query(
            signal_ctes(name), f"SELECT SubNr AS sub_nr, phase, {frame_columns('value')} FROM toward GROUP BY SubNr, phase")
        q[f"surrogate_{name}"] = query(
            test_ctes(name), f"SELECT SubNr AS sub_nr, cueFrame AS cue_frame, phase, {r('value', 'value')} FROM surr")
        q[f"tested_rows_{name}"] = query(
            test_ctes(name), f"""SELECT SubNr AS sub_nr, phase, {frame_columns('value')} FROM
(SELECT SubNr, cueFrame, phase, value FROM toward UNION ALL SELECT SubNr, cueFrame, phase, value FROM surr) GROUP BY SubNr, phase""")
        q[f"frame_f_{name}"] = query([*test_ctes(name), FRAME_F], f"SELECT cueFrame AS cue_frame, n, {r('f', 'f')} FROM framef")
        q[f"perm_f_{name}"] = query(perm_ctes(name), f"SELECT perm, cueFrame AS cue_frame, {r('f', 'f')} FROM permf")
        q[f"cluster_depth_{name}"] = query(
            depth_ctes(name), f"SELECT cueFrame AS cue_frame, {r('f', 'f')}, cluster_id, {rs(['p', 'time_ms'])} FROM tested")
        q[f"residual_f_{name}"] = query(residual_ctes(name), f"SELECT perm, cueFrame AS cue_frame, {r('f', 'f')} FROM permf")
        q[f"cluster_depth_residual_{name}"] = query(
            depth_ctes(name, True), f"SELECT cueFrame AS cue_frame, {r('f', 'f')}, cluster_id, {rs(['p', 'time_ms'])} FROM tested")
        q[f"sig_times_{name}"] = query(
            depth_ctes(name), f"SELECT cueFrame AS cue_frame, {rs(['time_ms', 'p'])} FROM ({sig_select()})")
    first_frames = ", ".join(
        r(f"max(CASE WHEN cueFrame = {f} THEN value END)", f"f_m{-f}" if f < 0 else f"f_{f}") for f in P.frames[:3])
    q["preview_surrogate"] = query(
        test_ctes("head_direction"),
        f"SELECT SubNr AS sub_nr, phase, {first_frames} FROM surr GROUP BY SubNr, phase ORDER BY SubNr LIMIT 6")
    for name in figures.TOWARD_LIMITS:
        q[f"fig_toward_{name}"] = fig_toward(name)
    for exp in (1, 2, 3):
        for name in figures.TOWARD_LIMITS_BY_EXPERIMENT:
            q[f"position_{name}_exp{exp}"] = query(position_ctes(name, exp), position)
            q[f"fig_position_{name}_exp{exp}"] = query(
                position_ctes(name, exp), position.replace(" FROM summ", f", {ribbon} FROM summ"))
            q[f"toward_{name}_exp{exp}"] = query(signal_ctes(name, exp), toward_rows)
            q[f"toward_summary_{name}_exp{exp}"] = query(toward_summary_ctes(name, exp), toward_stats)
            q[f"fig_toward_{name}_exp{exp}"] = fig_toward(name, exp)
        for dv in MEASURES:
            short = "rt" if dv == "ResponseTime" else dv
            where = f"WHERE ExpNr = {exp} AND measure = '{dv}'"
            q[f"summary_within_{short}_exp{exp}"] = query(WITHIN, f"SELECT {WITHIN_COLUMNS} FROM summ {where}")
            q[f"anova_{short}_exp{exp}"] = query(ANOVA, f"SELECT {ANOVA_COLUMNS} FROM av {where}")
            q[f"paired_diff_{short}_exp{exp}"] = query(
                DIFF, f"SELECT ExpNr AS exp_nr, measure, SubNr AS sub_nr, {r('diff', 'diff')} FROM diff {where}")
            q[f"bf_{short}_exp{exp}"] = query(BAYES, f"SELECT {BAYES_COLUMNS} FROM bf {where}")
    return q
