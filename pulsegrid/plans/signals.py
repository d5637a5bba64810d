"""Queries over arrays, and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pulsegrid.operators import dsp
from pulsegrid.plans.series import fold_sql
from pulsegrid.sources import inputs
from pulsegrid.sources.inputs import ONSETS
from pulsegrid.streaming import windows


def _vectors(spark, d):  # noqa: ANN001, ANN202
    return inputs.table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))


def circular_autocorr(spark, d):  # noqa: ANN001, ANN201
    acf = dsp.circular_autocorrelation(inputs.table(spark, d, "embeddings"), "vec_id", "embedding")
    return acf.select("vec_id", F.posexplode("acf").alias("lag", "r")).select("vec_id", "lag", (F.round("r", 5) + 0.0).alias("r"))


def circular_peaks(spark, d):  # noqa: ANN001, ANN201
    return _vectors(spark, d).select("vec_id", F.array_join(dsp.circular_peaks(F.col("x")), ",").alias("peaks"))


def smoothed_curve(spark, d):  # noqa: ANN001, ANN201
    x = dsp.smoothed(F.col("x"), 2)
    return _vectors(spark, d).select("vec_id", F.round(F.aggregate(x, F.lit(0.0), lambda a, v: a + v), 5).alias("kept"), F.size(F.filter(x, lambda v: v > 0)).cast("long").alias("places"))


def spectral_novelty(spark, d):  # noqa: ANN001, ANN201
    p = _vectors(spark, d).withColumn("p", F.transform("x", lambda v: v * v))
    before = F.lag("p").over(Window.partitionBy("label").orderBy("vec_id"))
    return p.withColumn("b", before).where("b is not null").select("vec_id", F.round(dsp.novelty(F.col("p"), F.col("b")), 4).alias("novelty"))


def onset_gate(spark, d):  # noqa: ANN001, ANN201
    w = F.transform("x", lambda v: F.greatest(v - 0.1, F.lit(0.0)))
    return _vectors(spark, d).select("vec_id", dsp.onset_gate(F.size("x"), w).alias("rejected"))


def segment_evaluate(spark, d):  # noqa: ANN001, ANN201
    return dsp.evaluate_curves(inputs.table(spark, d, "embeddings"), "vec_id", "embedding", 8.0)


def sample_evaluate(spark, d):  # noqa: ANN001, ANN201
    one = F.struct("vec_id", "embedding")
    group = inputs.table(spark, d, "embeddings").groupBy(F.floor(F.col("vec_id") / 32).alias("window")).agg(F.array_sort(F.collect_list(one)).alias("v"))  # 32 vectors at most
    return dsp.evaluate_windows(group.select("window", F.flatten("v.embedding").alias("x")), "window", "x", 256.0)


def stream_sliding(spark, d):  # noqa: ANN001, ANN201
    zero = F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").cast("timestamp"))
    out = windows.run_once(windows.sliding(windows.event_stream(spark, d)), "complete", "sliding")
    return out.select((F.unix_micros("start") - zero).alias("start_us"), "kind", "n", F.round("total", 4).alias("total"))


def stream_session(spark, d):  # noqa: ANN001, ANN201
    zero = F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").cast("timestamp"))
    out = windows.run_once(windows.sessions(windows.event_stream(spark, d)), "complete", "sessions")
    return out.select("track", (F.unix_micros("start") - zero).alias("start_us"), "taps")


def stream_spacing(spark, d):  # noqa: ANN001, ANN201
    zero = F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").cast("timestamp"))
    out = windows.run_once(windows.spaced(windows.event_stream(spark, d), 43_200.0), "append", "spaced")
    return out.select("track", (F.col("us") - zero).alias("us"), "value")


_X = "list_transform(embedding, lambda v: v::DOUBLE)"
_V = f"v AS (SELECT vec_id, label, {_X} AS x FROM embeddings)"
_W = [0.75, 0.75]
_KEPT = fold_sql(f"SELECT track, us AS u, value AS v FROM ({ONSETS})", "u, v", "u AS us, v AS value, TRUE AS kept", "CASE WHEN u - us >= 43200000000 THEN u ELSE us END, CASE WHEN u - us >= 43200000000 THEN v ELSE value END, u - us >= 43200000000")
QUERIES = {f.__name__: f for f in (circular_autocorr, circular_peaks, smoothed_curve, spectral_novelty, onset_gate, segment_evaluate, sample_evaluate, stream_sliding, stream_session, stream_spacing)}
ORACLE = {
    "stream_spacing": f"WITH RECURSIVE {_KEPT} SELECT track, us, value FROM go WHERE kept",
    "smoothed_curve": f"""WITH {_V}, m AS (SELECT vec_id, list_transform(range(0, len(x)), lambda i: greatest(0, x[i + 1] - 1.5::DOUBLE * list_sum(list_transform(range(0, 5), lambda k: x[(i + k - 2 + len(x)) % len(x) + 1] * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * (k + 1) / 6)))) / 3.0::DOUBLE)) AS y FROM v)
      SELECT vec_id, round(list_sum(y), 5) AS kept, len(list_filter(y, lambda v: v > 0)) AS places FROM m""",
    "circular_autocorr": f"""WITH {_V}, e AS (SELECT vec_id, i - 1 AS i, x[i] AS a, len(x) AS n FROM v, (SELECT unnest(range(1, 65)) AS i) WHERE i <= len(x)), k AS (SELECT unnest(range(0, 33)) AS lag),
      r AS (SELECT a.vec_id, lag, sum(a.a * b.a) AS r FROM e a, k JOIN e b ON b.vec_id = a.vec_id AND b.i = (a.i + lag) % a.n GROUP BY 1, 2) SELECT vec_id, lag::INT AS lag, round(CASE WHEN max(CASE WHEN lag = 0 THEN r END) OVER (PARTITION BY vec_id) > 0 THEN r / max(CASE WHEN lag = 0 THEN r END) OVER (PARTITION BY vec_id) ELSE 0 END, 5) + 0.0::DOUBLE AS r FROM r""",
    "circular_peaks": f"WITH {_V} SELECT vec_id, array_to_string(list_filter(range(0, len(x)), lambda i: x[(i - 1 + len(x)) % len(x) + 1] < x[i + 1] AND x[i + 1] > x[(i + 1) % len(x) + 1]), ',') AS peaks FROM v",
    "spectral_novelty": f"""WITH {_V}, b AS (SELECT vec_id, x, lag(x) OVER (PARTITION BY label ORDER BY vec_id) AS y FROM v)
      SELECT vec_id, round(list_sum(list_transform(range(1, len(x) + 1), lambda i: greatest(0, log2(1 + 100 * abs(x[i])) - log2(1 + 100 * abs(y[i]))))), 4) AS novelty FROM b WHERE y IS NOT NULL""",
    "onset_gate": f"""WITH {_V}, w AS (SELECT vec_id, list_filter(list_transform(x, lambda v: greatest(v - 0.1::DOUBLE, 0)), lambda v: v > 0) AS w FROM v), s AS (SELECT vec_id, coalesce(list_sum(w), 0) AS s, coalesce(list_sum(list_transform(w, lambda v: v * v)), 0) AS q FROM w)
      SELECT vec_id, CASE WHEN q <= 0 THEN TRUE ELSE s * s / q < 1.5 END AS rejected FROM s""",
    "stream_sliding": """WITH w AS (SELECT event_type AS kind, value, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) AS us FROM events), k AS (SELECT unnest([0, 1]) AS k)
      SELECT ((us // 21600000000) - k) * 21600000000 AS start_us, kind, count(*) AS n, round(sum(value), 4) AS total FROM w, k GROUP BY 1, 2""",
    "stream_session": """WITH m AS (SELECT user_id AS track, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS us FROM events), g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY track ORDER BY us) < 18000000000 THEN 0 ELSE 1 END AS new FROM m),
      s AS (SELECT *, sum(new) OVER (PARTITION BY track ORDER BY us ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT track, min(us) AS start_us, count(*) AS taps FROM s GROUP BY track, s""",
}
