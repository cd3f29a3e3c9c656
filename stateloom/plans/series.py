"""Registered queries over session tables: summaries, index algebra, preprocessing, decoding. Each has its SQL beside
it where SQL can express it."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dsp
from ..operators import blocks, hmm, index, preprocess, subspace, summary
from ..sources import timeseries
from . import sqltext as S
from . import views as V

HALF_LOG_2PI = math.log(2 * math.pi) / 2
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _r(*names: str, digits: int = 6):
    return [F.round(n, digits).alias(n) for n in names]


def _soft(spark, sf_dir) -> DataFrame:
    return V.soft_gamma(V.sequence(spark, sf_dir))


# Index algebra


@query("SELECT user_id AS session_id, count(*) AS n FROM events GROUP BY user_id")
def session_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.lengths(V.sequence(spark, sf_dir))


@query("WITH n AS (SELECT user_id AS session_id, count(*) AS n FROM events GROUP BY user_id), u AS (SELECT session_id, n, CAST(sum(n) OVER (ORDER BY session_id) AS BIGINT) AS e FROM n) SELECT session_id, e - n AS start, e AS \"end\" FROM u")
def session_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.bounds(V.sequence(spark, sf_dir))


@query(f"WITH {S.SEQ} SELECT session_id, t, CAST(floor(t / 7) AS INTEGER) AS tile FROM seq")
def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.tiled(V.sequence(spark, sf_dir).select("session_id", "t"), 7)


@query(f"WITH {S.SEQ}, k AS (SELECT * FROM seq WHERE value >= 5) SELECT session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY t) - 1 AS INTEGER) AS t, value FROM k")
def renumbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.renumbered(V.sequence(spark, sf_dir).where("value >= 5").select("session_id", "t", "value"))


@query(f"""WITH {S.SEQ}, {S.soft()}, m AS (SELECT session_id, max(t) + 1 AS n, avg(g0) AS m0, avg(g1) AS m1, avg(g2) AS m2 FROM soft GROUP BY 1),
grid AS (SELECT session_id, m0, m1, m2, CAST(unnest(range(0, n + 3)) AS INTEGER) AS t FROM m)
SELECT grid.session_id, grid.t, round(coalesce(g0, m0), 6) AS g0, round(coalesce(g1, m1), 6) AS g1, round(coalesce(g2, m2), 6) AS g2
FROM grid LEFT JOIN soft ON grid.session_id = soft.session_id AND grid.t = soft.t + 2""")
def pad_gamma(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = index.pad_gamma(_soft(spark, sf_dir), (-1, 0, 2))
    return g.select("session_id", "t", *(F.round(F.col("gamma")[i], 6).alias(f"g{i}") for i in range(3)))


@query(f"""WITH {S.STATES}, s AS (SELECT session_id, max(t) + 1 AS n, arg_min(state, t) AS a, arg_max(state, t) AS b FROM path GROUP BY 1),
grid AS (SELECT session_id, a, b, CAST(unnest(range(0, n + 3)) AS INTEGER) AS t FROM s)
SELECT grid.session_id, grid.t, coalesce(state, CASE WHEN grid.t < 2 THEN a ELSE b END) AS state
FROM grid LEFT JOIN path ON grid.session_id = path.session_id AND grid.t = path.t + 2""")
def pad_vpath(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.pad_path(V.state_sequence(spark, sf_dir), (-1, 0, 2))


@query(f"""WITH {S.SEQ}, e AS (
  SELECT session_id, t, t - lag(t) OVER w AS gap, lead(t) OVER w - t AS nxt FROM seq WHERE event_type = 'purchase' WINDOW w AS (PARTITION BY session_id ORDER BY t)),
k AS (SELECT session_id, t FROM e WHERE CASE WHEN gap IS NULL THEN coalesce(nxt >= 4, true) ELSE gap >= 4 END),
s AS (SELECT session_id, max(t) AS m FROM seq GROUP BY 1)
SELECT k.session_id, k.t AS event_t, seq.t - (k.t - 1) AS tau, seq.t, seq.value
FROM k JOIN s USING (session_id) JOIN seq ON seq.session_id = k.session_id AND seq.t BETWEEN k.t - 1 AND k.t + 2
WHERE k.t - 1 >= 0 AND k.t + 2 <= m""")
def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = V.sequence(spark, sf_dir)
    out = index.event_epochs(seq.select("session_id", "t", "value"), seq.where("event_type = 'purchase'"), -1, 4)
    return out.select("session_id", "event_t", "tau", "t", "value")


@query(f"WITH {S.SEQ}, n AS (SELECT session_id, count(*) AS n FROM seq GROUP BY 1) SELECT session_id, CAST((t + 3) % n AS INTEGER) AS t, value FROM seq JOIN n USING (session_id)")
def rolled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.rolled(V.sequence(spark, sf_dir).select("session_id", "t", "value"), "value", 3)


# Summaries


@query(f"WITH {S.SOFT_LONG} SELECT session_id, state, round(sum(g) / sum(sum(g)) OVER (PARTITION BY session_id), 6) AS fo FROM gl GROUP BY 1, 2")
def fractional_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.occupancy(_soft(spark, sf_dir)).select("session_id", "state", *_r("fo"))


@query(f"WITH {S.SOFT_LONG}, f AS (SELECT session_id, state, sum(g) / sum(sum(g)) OVER (PARTITION BY session_id) AS fo FROM gl GROUP BY 1, 2) SELECT session_id, round(max(fo), 6) AS max_fo FROM f GROUP BY 1")
def max_fo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.max_occupancy(summary.occupancy(_soft(spark, sf_dir))).select("session_id", *_r("max_fo"))


@query(f"WITH {S.SOFT_LONG}, f AS (SELECT session_id, state, sum(g) / sum(sum(g)) OVER (PARTITION BY session_id) AS fo FROM gl GROUP BY 1, 2) SELECT session_id, round(sum(-fo * ln(fo)), 6) AS entropy FROM f WHERE fo > 0 GROUP BY 1")
def fo_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.entropy(summary.occupancy(_soft(spark, sf_dir)), "fo", "session_id").select("session_id", *_r("entropy"))


@query(f"WITH {S.SOFT_LONG}, d AS (SELECT session_id, state, abs(g - lag(g) OVER (PARTITION BY session_id, state ORDER BY t)) AS d FROM gl) SELECT session_id, state, round(avg(d), 6) AS rate FROM d WHERE d IS NOT NULL GROUP BY 1, 2")
def switching_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.switching_rate(_soft(spark, sf_dir)).select("session_id", "state", *_r("rate"))


@query(f"WITH {S.STATES} SELECT t, CAST(s.state AS INTEGER) AS state, round(avg(CASE WHEN path.state = s.state THEN 1.0 ELSE 0.0 END), 6) AS probability FROM path, (SELECT unnest(range(0, 5)) AS state) s GROUP BY 1, 2")
def evoked_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.evoked_response(V.one_hot(V.state_sequence(spark, sf_dir), 5), ragged=True).select("t", "state", *_r("probability"))


@query(f"WITH {S.STATES}, p AS (SELECT t, state, count(*) / sum(count(*)) OVER (PARTITION BY t) AS p FROM path GROUP BY 1, 2) SELECT t, round(sum(-p * ln(p)), 6) AS entropy FROM p GROUP BY 1")
def evoked_response_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = summary.evoked_response(V.one_hot(V.state_sequence(spark, sf_dir), 5), ragged=True)
    return summary.entropy(r, "probability", "t").select("t", *_r("entropy"))


@query(f"WITH {S.RUNS} SELECT * FROM visits")
def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.visits(V.state_sequence(spark, sf_dir))


@query(f"""WITH {S.RUNS}, g AS (SELECT session_id, CAST(k AS INTEGER) AS state FROM (SELECT DISTINCT session_id FROM path), (SELECT unnest(range(0, 5)) AS k))
SELECT g.session_id, g.state, round(coalesce(avg(length), 0), 6) AS mean, coalesce(median(length), 0.0) AS median, CAST(coalesce(max(length), 0) AS DOUBLE) AS max
FROM g LEFT JOIN (SELECT * FROM visits WHERE length > 1) v ON g.session_id = v.session_id AND g.state = v.state GROUP BY 1, 2""")
def life_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.life_times(V.state_sequence(spark, sf_dir), 5, threshold=1).select("session_id", "state", *_r("mean"), "median", "max")


@query(f"WITH {S.RUNS} SELECT session_id, state, array_to_string(list_sort(list(onset)), ',') AS onsets FROM visits GROUP BY 1, 2")
def state_onsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.state_onsets(V.state_sequence(spark, sf_dir)).withColumn("onsets", F.array_join(F.col("onsets").cast("array<string>"), ","))


_STEPS = f"{S.STATES}, s AS (SELECT state AS source, lead(state) OVER (PARTITION BY session_id ORDER BY t) AS target FROM path), c AS (SELECT source, target, count(*) AS n FROM s WHERE target IS NOT NULL GROUP BY 1, 2)"


@query(f"WITH {_STEPS} SELECT source, target, round(n / sum(n) OVER (PARTITION BY source), 6) AS probability FROM c")
def transition_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.transition_matrix(V.state_sequence(spark, sf_dir)).select("source", "target", *_r("probability"))


@query(f"WITH {_STEPS} SELECT source, target, round(n / sum(n) OVER (PARTITION BY source), 6) AS probability FROM c WHERE source <> target")
def no_self_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.transition_matrix(V.state_sequence(spark, sf_dir), with_self=False).select("source", "target", *_r("probability"))


@query(f"WITH {S.SOFT_LONG}, {S.OTHER_LONG} SELECT gl.state AS state_a, gl2.state AS state_b, round(avg(least(gl.g, gl2.g)), 6) AS overlap FROM gl JOIN gl2 ON gl.session_id = gl2.session_id AND gl.t = gl2.t GROUP BY 1, 2")
def gamma_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = V.sequence(spark, sf_dir)
    return summary.overlap(V.soft_gamma(seq), V.soft_gamma(seq, V.SOFT_OTHER)).select("state_a", "state_b", *_r("overlap"))


@query(f"""WITH {S.SEQ}, {S.soft()}, c AS (SELECT s.*, CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE 0 END AS condition FROM soft s JOIN seq USING (session_id, t)),
m AS (SELECT condition, t, round(avg(g0), 3) AS m0, round(avg(g1), 3) AS m1, round(avg(g2), 3) AS m2 FROM c GROUP BY 1, 2),
l AS (SELECT condition, t, unnest([0, 1, 2]) AS state, unnest([m0, m1, m2]) AS m FROM m)
SELECT t, state, max(m) FILTER (condition = 0) AS first, max(m) FILTER (condition = 1) AS second, round(max(m) FILTER (condition = 0) - max(m) FILTER (condition = 1), 6) + 0.0 AS difference FROM l GROUP BY 1, 2""")
def condition_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = V.sequence(spark, sf_dir)
    c = seq.select("session_id", "t", F.col("event_type").isin("click", "view").cast("int").alias("condition"))
    d = summary.condition_difference(V.soft_gamma(seq).join(c, ["session_id", "t"]))
    return d.select("t", "state", "first", "second", F.round("difference", 6).alias("difference"))


# Preprocessing


@query(f"WITH {S.SEQ} SELECT session_id, t, round((value - avg(value) OVER w) / stddev_pop(value) OVER w, 6) AS y FROM seq WINDOW w AS (PARTITION BY session_id)")
def standardise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preprocess.standardise(V.sequence(spark, sf_dir)).select("session_id", "t", F.round(F.col("y")[0], 6).alias("y"))


_DAMP = "(l - ln(l) / ln(5) + ln(abs(v)) / ln(5))"


@query(f"WITH {S.SEQ}, c AS (SELECT session_id, t, value - avg(value) OVER (PARTITION BY session_id) AS v FROM seq), d AS (SELECT *, 2 * stddev_pop(v) OVER () AS l FROM c) SELECT session_id, t, round(CASE WHEN abs(v) > l THEN sign(v) * {_DAMP} ELSE v END, 5) AS y FROM d")
def dampen_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    centred = preprocess.standardise(V.sequence(spark, sf_dir), scale=False)
    return preprocess.dampen_peaks(centred, 5).select("session_id", "t", F.round(F.col("y")[0], 5).alias("y"))


@query(f"WITH {S.SEQ} SELECT session_id, t, round(value - (avg(value) OVER w + regr_slope(value, t) OVER w * (t - avg(t) OVER w)), 5) AS y FROM seq WINDOW w AS (PARTITION BY session_id)")
def detrend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preprocess.detrend(V.sequence(spark, sf_dir)).select("session_id", "t", F.round(F.col("y")[0], 5).alias("y"))


@query(f"WITH {S.SEQ}, e AS (SELECT session_id, t, lead(value) OVER w AS y0, value AS y1, lag(value, 2) OVER w AS y2 FROM seq WINDOW w AS (PARTITION BY session_id ORDER BY t)) SELECT session_id, t - 2 AS t, y0, y1, y2 FROM e WHERE y0 IS NOT NULL AND y2 IS NOT NULL")
def tde_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = preprocess.embed_lags(V.sequence(spark, sf_dir), (-1, 0, 2))
    return e.select("session_id", "t", *(F.col("y")[i].alias(f"y{i}") for i in range(3)))


@query(f"WITH {S.SEQ}, c AS (SELECT session_id, t, value - avg(value) OVER () AS v FROM seq), e AS (SELECT session_id, t, v AS y, lag(v) OVER w AS x1, lag(v, 2) OVER w AS x2 FROM c WINDOW w AS (PARTITION BY session_id ORDER BY t)) SELECT session_id, t - 2 AS t, round(y, 6) AS y, round(x1, 6) AS x1, round(x2, 6) AS x2 FROM e WHERE x2 IS NOT NULL")
def ar_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = preprocess.autoregress(V.sequence(spark, sf_dir), 2)
    return e.select("session_id", "t", F.round(F.col("y")[0], 6).alias("y"), F.round(F.col("x")[0], 6).alias("x1"), F.round(F.col("x")[1], 6).alias("x2"))


_EMB = "v AS (SELECT vec_id, unnest(range(0, 64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS a FROM embeddings)"


def _emb(spark, sf_dir) -> DataFrame:
    e = V.table(spark, sf_dir, "embeddings")
    return e.select(F.lit(0).alias("session_id"), F.col("vec_id").alias("t"), F.col("embedding").cast("array<double>").alias("y"), "label")


@query(f"WITH {_EMB} SELECT CAST(x.i AS INTEGER) AS i, CAST(y.i AS INTEGER) AS j, round(sum(x.a * y.a), 5) + 0.0 AS value FROM v x JOIN v y ON x.vec_id = y.vec_id AND x.i <= y.i GROUP BY 1, 2")
def gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preprocess.gram_table(_emb(spark, sf_dir)).select("i", "j", F.round("value", 5).alias("value"))


def _matrix(spark, m: np.ndarray, upper: bool = True) -> DataFrame:
    rows = [(i, j, float(v)) for (i, j), v in np.ndenumerate(m) if j >= i or not upper]
    return spark.createDataFrame(rows, "i int, j int, value double")


@query(f"WITH {_EMB} SELECT CAST(x.i AS INTEGER) AS i, CAST(y.i AS INTEGER) AS j, round(covar_pop(x.a, y.a), 6) + 0.0 AS value FROM v x JOIN v y ON x.vec_id = y.vec_id AND x.i <= y.i GROUP BY 1, 2")
def covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    cov, _ = preprocess.covariance(_emb(spark, sf_dir))
    return _matrix(spark, cov).select("i", "j", *_r("value"))


@query(f"WITH {_EMB} SELECT CAST(x.i AS INTEGER) AS i, CAST(y.i AS INTEGER) AS j, round(corr(x.a, y.a), 5) + 0.0 AS value FROM v x JOIN v y ON x.vec_id = y.vec_id AND x.i < y.i GROUP BY 1, 2")
def correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    cov, _ = preprocess.covariance(_emb(spark, sf_dir))
    s = np.sqrt(np.diag(cov))
    return _matrix(spark, cov / np.outer(s, s)).where("i < j").select("i", "j", F.round("value", 5).alias("value"))


@query()
def pca_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores, _ = preprocess.apply_pca(_emb(spark, sf_dir), 5)
    return scores.select("t", *(F.round(F.col("y")[i], 5).alias(f"pc{i}") for i in range(5)))


_SQUARES = 12
_POWER = f"""{_EMB}, mu AS (SELECT i, avg(a) AS m FROM v GROUP BY 1), w AS MATERIALIZED (SELECT vec_id, i, a - m AS a FROM v JOIN mu USING (i)),
c AS MATERIALIZED (SELECT x.i, y.i AS j, sum(x.a * y.a) / (SELECT count(*) FROM embeddings) AS v FROM w x JOIN w y USING (vec_id) GROUP BY 1, 2),
m0 AS MATERIALIZED (SELECT i, j, v / (SELECT sum(v) FROM c WHERE i = j) AS v FROM c), """ + ", ".join(
    f"s{k} AS MATERIALIZED (SELECT x.i, y.j, sum(x.v * y.v) AS v FROM m{k - 1} x JOIN m{k - 1} y ON x.j = y.i GROUP BY 1, 2), m{k} AS MATERIALIZED (SELECT i, j, v / (SELECT sum(v) FROM s{k} WHERE i = j) AS v FROM s{k})" for k in range(1, _SQUARES + 1)
) + f""", g AS (SELECT i, v FROM m{_SQUARES} WHERE j = (SELECT arg_max(i, v) FROM m{_SQUARES} WHERE i = j)),
axis AS MATERIALIZED (SELECT i, v / (SELECT sqrt(sum(v * v)) FROM g) * (SELECT sign(arg_max(v, abs(v))) FROM g) AS e FROM g)"""


@query(f"""WITH {_POWER}, l AS (SELECT sum(x.e * c.v * y.e) AS variance FROM c JOIN axis x ON x.i = c.i JOIN axis y ON y.i = c.j)
SELECT vec_id AS t, round(sum(a * e), 4) + 0.0 AS pc0, round(any_value(variance), 6) AS variance FROM w JOIN axis USING (i), l GROUP BY 1""")
def wide_pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores on the leading axis by subspace iteration; the SQL takes a power of the covariance."""
    e = _emb(spark, sf_dir)
    axes, var, mean = subspace.leading_axes(e, 1, extra=55)
    scores = preprocess.project(e, axes, mean)
    return scores.select("t", (F.round(F.col("y")[0], 4) + 0.0).alias("pc0"), F.lit(round(float(var[0]), 6)).alias("variance"))


@query()
def ica_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = preprocess.apply_ica(_emb(spark, sf_dir), 3, steps=20)
    return out.select("t", *(F.col("y")[i].alias(f"s{i}") for i in range(3)))


_Z = "z AS (SELECT session_id, t, (value - avg(value) OVER w) / stddev_pop(value) OVER w AS y FROM seq WINDOW w AS (PARTITION BY session_id))"


def _filter_sql(band: tuple[float, float], fs: float, order: int) -> str:
    """The cascade of sections as a recursion over t, which carries two numbers for each section."""
    sos = dsp.butterworth_sos(order, band, fs)
    k = range(len(sos))
    v, outs = "{v}", []
    for i, (b0, _, _, _, _, _) in enumerate(sos):
        outs.append(f"({b0!r} * {outs[-1] if outs else v} + {{p{i}}})".replace("np.float64", ""))
    v_in = [v, *outs[:-1]]
    first = [f"{sos[i][1]!r} * {v_in[i]} - ({sos[i][4]!r}) * {outs[i]} + {{q{i}}}".replace("np.float64", "") for i in k]
    second = [f"{sos[i][2]!r} * {v_in[i]} - ({sos[i][5]!r}) * {outs[i]}".replace("np.float64", "") for i in k]
    at = {"v": "s.value"} | {f"{x}{i}": f"r.{x}{i}" for x in "pq" for i in k}
    zero = {"v": "s.value"} | {f"{x}{i}": "0.0" for x in "pq" for i in k}
    row = lambda names: ", ".join(x.format(**names) for x in (outs[-1], *first, *second))
    columns = ", ".join([*(f"p{i}" for i in k), *(f"q{i}" for i in k)])
    return f"""WITH RECURSIVE {S.SEQ}, r(session_id, t, y, {columns}) AS (
SELECT s.session_id, s.t, {row(zero)} FROM seq s WHERE s.t = 0
UNION ALL SELECT s.session_id, s.t, {row(at)} FROM r JOIN seq s ON s.session_id = r.session_id AND s.t = r.t + 1)
SELECT session_id, t, round(y, 6) + 0.0 AS y FROM r"""


@query(_filter_sql((0.05, 0.2), 1.0, 3))
def band_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preprocess.filtered(V.sequence(spark, sf_dir), (0.05, 0.2), 1.0, order=3).select("session_id", "t", (F.round(F.col("y")[0], 6) + 0.0).alias("y"))


@query(f"""WITH {S.SEQ}, {_Z}, n AS (SELECT session_id, count(*) AS n FROM z GROUP BY 1),
h AS (SELECT a.session_id, a.t, any_value(a.y) AS re, sum(CASE WHEN a.t = b.t THEN 0 WHEN n % 2 = 0 THEN (a.t - b.t) % 2 * (a.t - b.t) % 2 * 2 * b.y / n / tan(pi() * (a.t - b.t) / n)
  ELSE b.y / n * (1 / tan(pi() * (a.t - b.t) / n) - cos(pi() * (a.t - b.t)) / sin(pi() * (a.t - b.t) / n)) END) AS im
  FROM z a JOIN z b USING (session_id) JOIN n USING (session_id) GROUP BY 1, 2),
p AS (SELECT *, atan2(im, re) AS p FROM h), d AS (SELECT *, coalesce(p - lag(p) OVER (PARTITION BY session_id ORDER BY t), 0) AS d FROM p)
SELECT session_id, t, round(sqrt(re * re + im * im), 6) AS power, round(p - 2 * pi() * sum(round(d / (2 * pi()))) OVER (PARTITION BY session_id ORDER BY t), 6) + 0.0 AS phase FROM d""")
def hilbert_power_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = preprocess.hilbert(preprocess.standardise(V.sequence(spark, sf_dir)), power=True, phase=True)
    return out.select("session_id", "t", F.round(F.col("y")[0], 6).alias("power"), (F.round(F.col("y")[1], 6) + 0.0).alias("phase"))


def _downsample_sql(up: int, down: int) -> str:
    """Each output as a weighted sum of the inputs near it; the weights are a windowed sinc."""
    half = 10 * max(up, down)
    k = np.arange(-half, half + 1)
    taps = np.sinc(k / max(up, down)) * np.kaiser(2 * half + 1, 5.0)
    values = ", ".join(f"({i}, {float(v)!r})" for i, v in zip(k, taps * up / taps.sum()))
    return f"""WITH {S.SEQ}, taps(k, w) AS (VALUES {values}), n AS (SELECT session_id, CAST(ceil(count(*) * {up} / {down}.0) AS BIGINT) AS n FROM seq GROUP BY 1),
o AS (SELECT session_id, CAST(unnest(range(0, n)) AS INTEGER) AS t FROM n)
SELECT o.session_id, o.t, round(sum(s.value * w), 6) + 0.0 AS y FROM o JOIN seq s ON s.session_id = o.session_id JOIN taps ON k = {down} * o.t - {up} * s.t GROUP BY 1, 2"""


@query(_downsample_sql(2, 5))
def downsampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preprocess.downsample(V.sequence(spark, sf_dir), 10, 4).select("session_id", "t", (F.round(F.col("y")[0], 6) + 0.0).alias("y"))


@query(f"WITH {S.SEQ} SELECT CAST(session_id AS VARCHAR) AS session_id, t, value FROM seq")
def sessions_through_mat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each session written as a MAT file and read back."""
    back = timeseries.parse_arrays(timeseries.mat_files(V.sequence(spark, sf_dir)))
    return back.select("session_id", "t", F.col("y")[0].alias("value"))


# Decoding


def fixed_model() -> hmm.Model:
    """Two regimes of the event value with set parameters (identity covariance, so densities are plain normals)."""
    m = hmm.Model(hmm.Spec(2, "identity", "state", "no"))
    m.set_up(0, 1, np.ones(1))
    m.mu, m.mu_cov = np.array([[-0.5], [0.8]]), np.zeros((2, 1))
    m.set_dynamics()
    return m


def _z(spark, sf_dir) -> DataFrame:
    return preprocess.standardise(V.sequence(spark, sf_dir)).select("session_id", "t", "y")


def _fixed_sql() -> str:
    m = fixed_model()
    p, pi = m.moves, m.starts
    lik = lambda mu: f"exp(-0.5 * (y - ({mu})) * (y - ({mu})) - {HALF_LOG_2PI!r})"
    return f"""RECURSIVE {S.SEQ},
z AS (SELECT session_id, t, (value - avg(value) OVER w) / stddev_pop(value) OVER w AS y FROM seq WINDOW w AS (PARTITION BY session_id)),
b AS (SELECT session_id, t, {lik(-0.5)} AS b0, {lik(0.8)} AS b1 FROM z),
f(session_id, t, a0, a1, ll) AS (
  SELECT session_id, 0, {float(pi[0])!r} * b0 / ({float(pi[0])!r} * b0 + {float(pi[1])!r} * b1), {float(pi[1])!r} * b1 / ({float(pi[0])!r} * b0 + {float(pi[1])!r} * b1), ln({float(pi[0])!r} * b0 + {float(pi[1])!r} * b1)
  FROM b WHERE t = 0
  UNION ALL
  SELECT s.session_id, s.t, s.u0 / (s.u0 + s.u1), s.u1 / (s.u0 + s.u1), s.ll + ln(s.u0 + s.u1) FROM (
    SELECT b.session_id, b.t, f.ll, (f.a0 * {float(p[0, 0])!r} + f.a1 * {float(p[1, 0])!r}) * b0 AS u0, (f.a0 * {float(p[0, 1])!r} + f.a1 * {float(p[1, 1])!r}) * b1 AS u1
    FROM f JOIN b ON b.session_id = f.session_id AND b.t = f.t + 1) s)"""


def _smooth_sql() -> str:
    p = fixed_model().moves
    return _fixed_sql() + f""",
back(session_id, t, r0, r1) AS (
  SELECT session_id, max(t), 1.0::DOUBLE, 1.0::DOUBLE FROM b GROUP BY session_id
  UNION ALL
  SELECT s.session_id, s.t, s.v0 / (s.v0 + s.v1), s.v1 / (s.v0 + s.v1) FROM (
    SELECT b.session_id, b.t - 1 AS t, {float(p[0, 0])!r} * b0 * r0 + {float(p[0, 1])!r} * b1 * r1 AS v0, {float(p[1, 0])!r} * b0 * r0 + {float(p[1, 1])!r} * b1 * r1 AS v1
    FROM back JOIN b ON b.session_id = back.session_id AND b.t = back.t WHERE b.t > 0) s)"""


@query(f"WITH {_fixed_sql()} SELECT session_id, round(arg_max(ll, t), 6) AS loglik FROM f GROUP BY 1")
def forward_loglik(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.loglik(_z(spark, sf_dir), fixed_model()).select("session_id", *_r("loglik"))


@query(f"WITH {_smooth_sql()} SELECT f.session_id, f.t, round(a0 * r0 / (a0 * r0 + a1 * r1), 6) AS g0 FROM f JOIN back ON f.session_id = back.session_id AND f.t = back.t")
def posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.decode(_z(spark, sf_dir), fixed_model()).select("session_id", "t", F.round(F.col("gamma")[0], 6).alias("g0"))


@query(f"WITH {_smooth_sql()}, g AS (SELECT f.session_id, f.t, a0 * r0 / (a0 * r0 + a1 * r1) AS g0 FROM f JOIN back ON f.session_id = back.session_id AND f.t = back.t) SELECT session_id, unnest([0, 1]) AS state, unnest([round(avg(g0), 6), round(avg(1 - g0), 6)]) AS fo FROM g GROUP BY 1")
def regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each session is spent in each regime: the flagship query."""
    return summary.occupancy(hmm.decode(_z(spark, sf_dir), fixed_model())).select("session_id", "state", *_r("fo"))


def _entropy_sql() -> str:
    p = [[repr(float(v)) for v in row] for row in fixed_model().moves]
    pair = {(i, j): f"a{i} * {p[i][j]} * h{j} / (a0 * {p[0][j]} + a1 * {p[1][j]})" for i in (0, 1) for j in (0, 1)}
    steps = ", ".join(f"{x} AS x{i}{j}" for (i, j), x in pair.items())
    bits = " - ".join(f"x{i}{j} * ln(x{i}{j} / (x{i}0 + x{i}1))" for i, j in pair)
    return f"""WITH {_smooth_sql()},
g AS (SELECT f.session_id, f.t, a0, a1, a0 * r0 / (a0 * r0 + a1 * r1) AS h0, a1 * r1 / (a0 * r0 + a1 * r1) AS h1 FROM f JOIN back ON f.session_id = back.session_id AND f.t = back.t),
x AS (SELECT session_id, {steps} FROM (SELECT b.session_id, a.a0, a.a1, b.h0, b.h1 FROM g a JOIN g b ON a.session_id = b.session_id AND b.t = a.t + 1)),
e AS (SELECT session_id, - {bits} AS e FROM x UNION ALL SELECT session_id, -h0 * ln(h0) - h1 * ln(h1) FROM g WHERE t = 0)
SELECT session_id, round(sum(e), 6) AS entropy FROM e GROUP BY 1"""


@query(_entropy_sql())
def posterior_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy of each session's states given its data."""
    return hmm.entropy(_z(spark, sf_dir), fixed_model()).select("session_id", *_r("entropy"))


def _viterbi_sql() -> str:
    m = fixed_model()
    p, pi = np.log(m.moves), np.log(m.starts)
    lg = lambda mu: f"(-0.5 * (y - ({mu})) * (y - ({mu})) - {HALF_LOG_2PI!r})"
    v = lambda x: repr(float(x))
    return f"""RECURSIVE {S.SEQ},
z AS (SELECT session_id, t, (value - avg(value) OVER w) / stddev_pop(value) OVER w AS y FROM seq WINDOW w AS (PARTITION BY session_id)),
b AS (SELECT session_id, t, {lg(-0.5)} AS b0, {lg(0.8)} AS b1 FROM z),
d(session_id, t, d0, d1, c0, c1) AS (
  SELECT session_id, 0, {v(pi[0])} + b0, {v(pi[1])} + b1, -1, -1 FROM b WHERE t = 0
  UNION ALL
  SELECT b.session_id, b.t, greatest(d0 + {v(p[0, 0])}, d1 + {v(p[1, 0])}) + b0, greatest(d0 + {v(p[0, 1])}, d1 + {v(p[1, 1])}) + b1,
    CASE WHEN d0 + {v(p[0, 0])} >= d1 + {v(p[1, 0])} THEN 0 ELSE 1 END, CASE WHEN d0 + {v(p[0, 1])} >= d1 + {v(p[1, 1])} THEN 0 ELSE 1 END
  FROM d JOIN b ON b.session_id = d.session_id AND b.t = d.t + 1),
r(session_id, t, state) AS (
  SELECT session_id, max(t), CASE WHEN arg_max(d0, t) >= arg_max(d1, t) THEN 0 ELSE 1 END FROM d GROUP BY session_id
  UNION ALL
  SELECT d.session_id, d.t - 1, CASE WHEN r.state = 0 THEN d.c0 ELSE d.c1 END FROM r JOIN d ON d.session_id = r.session_id AND d.t = r.t WHERE d.t > 0)"""


@query(f"WITH {_viterbi_sql()} SELECT session_id, t, state FROM r")
def viterbi_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.viterbi(_z(spark, sf_dir), fixed_model())


#: Rows of a block in the registered queries: sessions of the events are short.
BLOCK = 16


@query(SQL["posterior"])
def posterior_in_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As posterior, by a scan over blocks of each session."""
    return blocks.decode(_z(spark, sf_dir), fixed_model(), BLOCK).select("session_id", "t", F.round(F.col("gamma")[0], 6).alias("g0"))


@query(SQL["viterbi_path"])
def viterbi_in_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.viterbi(_z(spark, sf_dir), fixed_model(), BLOCK)


@query(SQL["forward_loglik"])
def loglik_in_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.loglik(_z(spark, sf_dir), fixed_model(), BLOCK).select("session_id", *_r("loglik"))


@query(SQL["band_pass"])
def band_pass_in_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = blocks.filtered(V.sequence(spark, sf_dir), (0.05, 0.2), 1.0, order=3, block_rows=BLOCK)
    return out.select("session_id", "t", (F.round(F.col("y")[0], 6) + 0.0).alias("y"))


@query(f"""WITH {_smooth_sql()}, g AS (SELECT f.session_id, f.t, a0 * r0 / (a0 * r0 + a1 * r1) AS g0 FROM f JOIN back ON f.session_id = back.session_id AND f.t = back.t),
w AS (SELECT 0 AS state, g0 AS g, y FROM g JOIN z ON z.session_id = g.session_id AND z.t = g.t UNION ALL SELECT 1, 1 - g0, y FROM g JOIN z ON z.session_id = g.session_id AND z.t = g.t)
SELECT state, round(sum(g), 4) AS n, round(sum(g * y), 4) AS gy, round(sum(g * y * y), 4) AS gyy FROM w GROUP BY 1""")
def suffstats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sufficient statistics of the model's posterior: weighted moments of each state."""
    st = hmm.statistics(hmm.packed(_z(spark, sf_dir)), fixed_model())
    rows = [(k, *(round(float(v), 4) for v in (st["n"][k], st["gy"][k, 0], st["gyy"][k, 0]))) for k in range(2)]
    return spark.createDataFrame(rows, "state int, n double, gy double, gyy double")


# Training


@query()
def em_fit_fe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free energy of each cycle of a two-state fit."""
    m = hmm.train(_z(spark, sf_dir), hmm.Spec(2, "diag", "state", "no"), hmm.Options(cycles=5, starts=1, start_cycles=2))
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(m.trace)], "cycle int, free_energy double")


@query()
def em_fit_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters of an autoregressive fit, as a long table."""
    ar = preprocess.autoregress(_z(spark, sf_dir), 2)
    m = hmm.train(ar, hmm.Spec(2, "full", "state", "state"), hmm.Options(cycles=4, starts=1, start_cycles=1))
    return m.table(spark)


@query()
def mini_batch_fe(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = hmm.train(_z(spark, sf_dir), hmm.Spec(2, "shareddiag", "state", "no"), hmm.Options(cycles=5, batch=20))
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(m.trace)], "cycle int, free_energy double")


@query()
def sampled_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = index.lengths(V.sequence(spark, sf_dir))
    return hmm.sample(spark, sizes, fixed_model(), seed=3).select("session_id", "t", "state", F.col("y")[0].alias("y"))


@query(f"""WITH {S.RUNS}, k AS (SELECT CAST(unnest(range(0, (SELECT max(state) + 1 FROM path))) AS INTEGER) AS state),
h AS (SELECT session_id, t, k.state, CASE WHEN path.state = k.state THEN 1.0 ELSE 0.0 END AS g FROM path, k),
d AS (SELECT *, abs(g - lag(g) OVER (PARTITION BY session_id, state ORDER BY t)) AS d FROM h),
e AS (SELECT DISTINCT session_id, k.state FROM path, k)
SELECT session_id, state AS i, round(avg(g), 6) AS value FROM h GROUP BY 1, 2
UNION ALL SELECT session_id, state + 5, round(avg(d), 6) FROM d WHERE d IS NOT NULL GROUP BY 1, 2
UNION ALL SELECT e.session_id, e.state + 10, round(coalesce(avg(length), 0), 6) FROM e LEFT JOIN visits v ON v.session_id = e.session_id AND v.state = e.state GROUP BY 1, 2""")
def session_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = V.state_sequence(spark, sf_dir)
    f = summary.summary_features(V.one_hot(path, 5), path)
    return f.select("session_id", F.posexplode("features").alias("i", "value")).select("session_id", "i", *_r("value"))
