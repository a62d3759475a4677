"""Queries of windows and running computations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import config as C
from ..functions import score as S
from ..functions import signal as G
from ..operators import windows as O
from ..sources import views as V
from ..streaming import chunks as K
from .registry import query

_LEVEL = V.with_(V.LEVEL_W)


@query(_LEVEL + "SELECT session, window_idx, ts, event_type, level, has_vocals FROM level_w")
def src_windows(spark, sf_dir):
    return V.level_w(spark, sf_dir)


@query(
    _LEVEL
    + f"""SELECT session, CAST((window_idx - 1) // {C.BLOCKS_PER_STEP} AS INTEGER) AS chunk_idx, count(*) AS n_blocks,
    min(ts) AS start_ts, round(sqrt(avg(level * level)), 6) AS rms FROM level_w GROUP BY ALL HAVING count(*) = {C.BLOCKS_PER_STEP}"""
)
def tumble_count(spark, sf_dir):
    return O.tumble(V.level_w(spark, sf_dir), C.BLOCKS_PER_STEP)


def blocks_w(spark, sf_dir):
    """Embeddings as blocks of samples: a session for each label, its blocks in the order of vec_id."""
    order = W.partitionBy("label").orderBy("vec_id")
    e = V.table(spark, sf_dir, "embeddings").withColumn("block_idx", F.row_number().over(order) - 1)
    return e.select(F.col("label").alias("session"), "block_idx", F.col("embedding").alias("samples"))


_SAMPLES = 64


@query(
    f"""WITH b AS (SELECT label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i FROM embeddings),
    c AS (SELECT CAST(label AS BIGINT) AS session, i // {C.BLOCKS_PER_STEP} AS chunk_idx, count(*) AS n, min(i) AS first_block,
      flatten(list(embedding ORDER BY i)) AS x FROM b GROUP BY ALL HAVING count(*) = {C.BLOCKS_PER_STEP})
    SELECT session, chunk_idx, CAST(n AS INTEGER) AS n_blocks, first_block, round(sqrt(list_sum(list_transform(x, lambda v: CAST(v AS DOUBLE) * v)) / len(x)), 6) AS rms,
      list_max(list_transform(x, lambda v: abs(v))) AS peak FROM c"""
)
def block_chunks(spark, sf_dir):
    """The chunks that a live session makes of its blocks, and their levels."""
    made = K.chunks(blocks_w(spark, sf_dir), C.BLOCKS_PER_STEP * _SAMPLES, 0)
    x = F.col("samples")
    rms = F.round(F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double") * v) / F.size(x)), 6)
    return made.select("session", "chunk_idx", "n_blocks", "first_block", rms.alias("rms"), F.array_max(F.transform(x, F.abs)).alias("peak"))


@query(
    _LEVEL
    + f"""SELECT session, window_idx, round(sqrt(sum(level * level) OVER w / {C.BLOCKS_PER_WINDOW}), 6) AS rms,
    max(abs(level)) OVER w AS peak FROM level_w
    WINDOW w AS (PARTITION BY session ORDER BY window_idx ROWS BETWEEN {C.BLOCKS_PER_WINDOW - 1} PRECEDING AND CURRENT ROW)"""
)
def slide_rows(spark, sf_dir):
    return O.slide(V.level_w(spark, sf_dir), C.BLOCKS_PER_WINDOW)


@query(
    """WITH e AS (SELECT user_id AS session, value, epoch_us(ts) AS t FROM events), w AS (
      SELECT session, value, t, (t - 7200000000) // 10800000000 * 10800000000 + 7200000000 - k * 10800000000 AS s
      FROM e, range(0, 4) AS r(k))
    SELECT session, make_timestamp(s + 36000000000) AS window_end, count(*) AS n, round(avg(value), 6) AS level
    FROM w WHERE t < s + 36000000000 GROUP BY ALL"""
)
def slide_time(spark, sf_dir):
    """Ten hours every three, whose ends fall on the multiples of three hours."""
    e = V.table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("ts").cast("timestamp").alias("t"), F.col("value").alias("level"))
    return O.slide_by_time(e, "10 hours", "3 hours", "2 hours").withColumn("window_end", F.col("window_end").cast("timestamp_ntz"))


@query(
    _LEVEL + "SELECT session, round(sqrt(avg(level * level)), 6) AS rms, max(abs(level)) AS peak FROM level_w GROUP BY session"
)
def rms_peak(spark, sf_dir):
    level = V.level_w(spark, sf_dir)
    return level.groupBy("session").agg(
        F.round(F.sqrt(F.avg(F.col("level") * F.col("level"))), 6).alias("rms"), F.max(F.abs("level")).alias("peak")
    )


_DOUBLES = "s AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings)"


@query(
    f"""WITH {_DOUBLES}, l AS (SELECT vec_id, sqrt(list_sum(list_transform(x, lambda v: v * v)) / len(x)) AS rms FROM s)
    SELECT vec_id, round(rms, 6) AS rms, rms > {C.VOICE_RMS} AS has_vocals, rms > 0.125 AS loud FROM l"""
)
def vad_gate(spark, sf_dir):
    x = F.col("embedding")
    rms = F.round(G.rms(x), 6).alias("rms")
    return V.table(spark, sf_dir, "embeddings").select(
        "vec_id", rms, G.has_voice(x).alias("has_vocals"), G.has_voice(x, 0.125).alias("loud")
    )


@query(
    f"""WITH {_DOUBLES}, p AS (SELECT vec_id, x, list_max(list_transform(x, lambda v: abs(v))) AS peak FROM s),
    g AS (SELECT *, least(0.7::DOUBLE / peak, 20.0::DOUBLE) AS gain FROM p), y AS (SELECT vec_id, peak, CASE WHEN peak >= 0.005 AND gain > 1.2
      THEN list_transform(x, lambda v: least(1.0::DOUBLE, greatest(-1.0::DOUBLE, v * gain))) ELSE x END AS y FROM g)
    SELECT vec_id, round(peak, 6) AS peak, round(list_max(list_transform(y, lambda v: abs(v))), 6) AS new_peak, round(y[1], 6) AS head FROM y"""
)
def auto_gain(spark, sf_dir):
    y = V.table(spark, sf_dir, "embeddings").select("vec_id", "embedding", G.auto_gain(F.col("embedding")).alias("y"))
    return y.select(
        "vec_id",
        F.round(G.peak(F.col("embedding")), 6).alias("peak"),
        F.round(G.peak(F.col("y")), 6).alias("new_peak"),
        F.round(F.get("y", F.lit(0)), 6).alias("head"),
    )


@query(
    """SELECT vec_id, n AS asked, CAST(len(y) AS INTEGER) AS n, round(CAST(y[1] AS DOUBLE), 6) AS head FROM (
      SELECT vec_id, n, CASE WHEN n <= 0 OR n >= len(embedding) THEN embedding
        ELSE embedding[len(embedding) - n + 1:len(embedding)] END AS y
      FROM embeddings, (VALUES (16), (64), (100), (0)) AS a(n))"""
)
def tail_slice(spark, sf_dir):
    x = V.table(spark, sf_dir, "embeddings")
    parts = [
        x.select("vec_id", F.lit(n).alias("asked"), G.tail_slice(F.col("embedding"), n).alias("y")) for n in (16, 64, 100, 0)
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.select(
        "vec_id", "asked", F.size("y").alias("n"), F.round(F.get("y", F.lit(0)).cast("double"), 6).alias("head")
    )


@query(
    V.with_(
        V.LEVEL_W,
        "g AS (SELECT *, sum(CASE WHEN has_vocals THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY window_idx) AS island FROM level_w)",
        """r AS (SELECT *, sum(CASE WHEN has_vocals THEN 0 ELSE 1 END) OVER (PARTITION BY session, island ORDER BY window_idx) AS run,
        lag(has_vocals) OVER (PARTITION BY session ORDER BY window_idx) AS before FROM g)""",
    )
    + f"""SELECT session, window_idx, has_vocals, CAST(run AS BIGINT) AS silence_run, has_vocals AND before = false AS break_end,
    CASE WHEN has_vocals AND before = false THEN {C.BOOST_WINDOWS} ELSE 0 END AS boost
    FROM (SELECT * REPLACE (coalesce(before, true) AS before) FROM r)"""
)
def vocal_breaks(spark, sf_dir):
    return O.vocal_breaks(V.level_w(spark, sf_dir))


@query(
    V.with_(V.TRANSCRIPT_W,
        f"""rate AS (
      SELECT session, window_idx, CASE WHEN silent THEN 0.0::DOUBLE ELSE {C.RATE_ALPHA}::DOUBLE * (length(letters) / 10.0::DOUBLE) END AS r
      FROM transcript_w WHERE window_idx = 0
      UNION ALL
      SELECT t.session, t.window_idx, CASE WHEN t.silent THEN rate.r * {C.SILENT_RATE}::DOUBLE
        ELSE (1.0::DOUBLE - {C.RATE_ALPHA}::DOUBLE) * rate.r + {C.RATE_ALPHA}::DOUBLE * (length(t.letters) / 10.0::DOUBLE) END
      FROM rate JOIN transcript_w t ON t.session = rate.session AND t.window_idx = rate.window_idx + 1)""")
    + "SELECT session, window_idx, round(r, 6) AS rate FROM rate"
)
def ema_rate(spark, sf_dir):
    """Letters per second, smoothed; silent windows let it fall."""
    return O.speech_rate(V.transcript_w(spark, sf_dir)).select("session", "window_idx", F.round("rate", 6).alias("rate"))


_STATES = "CASE CAST(window_idx % 4 AS INTEGER) WHEN 0 THEN 'searching' WHEN 1 THEN 'locked' WHEN 2 THEN 'unstable_lock' ELSE 'locked' END"


@query(
    V.with_(V.TRANSCRIPT_W)
    + f""", w AS (SELECT session, window_idx, {_STATES} AS state, CASE WHEN session % 9 = 0 THEN 1 ELSE 0 END AS boost,
      CASE WHEN session % 7 = 0 THEN 1 ELSE 0 END AS weak, length(letters) / 20.0::DOUBLE AS rate FROM transcript_w),
    m AS (SELECT *, CASE WHEN boost > 0 THEN 'start_boost'
      WHEN state IN ('locked', 'unstable_lock') THEN CASE WHEN state = 'unstable_lock' OR weak > 0 THEN 'locked_recover'
        WHEN rate >= {C.FAST_RATE} THEN 'locked_fast' WHEN rate <= {C.SLOW_RATE} THEN 'locked_slow' ELSE 'locked_follow' END
      WHEN rate >= {C.FAST_RATE} THEN 'search_fast' ELSE 'search' END AS mode FROM w)
    SELECT session, window_idx, mode, CAST(CASE mode {' '.join(f"WHEN '{k}' THEN {v}" for k, v in C.SECONDS.items())} END AS DOUBLE) AS seconds FROM m"""
)
def window_mode(spark, sf_dir):
    w = V.transcript_w(spark, sf_dir)
    k = F.col("window_idx") % 4
    state = F.when(k == 0, "searching").when(k == 2, "unstable_lock").otherwise("locked")
    boost = F.when(F.col("session") % 9 == 0, 1).otherwise(0)
    weak = F.when(F.col("session") % 7 == 0, 1).otherwise(0)
    mode = S.window_mode(boost, state, weak, F.char_length("letters") / F.lit(20.0))
    m = w.select("session", "window_idx", mode.alias("mode"))
    return m.withColumn("seconds", S.window_seconds(F.col("mode")))


_PROFILES = "profiles(name, auto, instant, lock_windows, switch_score) AS (VALUES " + ", ".join(
    f"('{p.name}', {p.auto}::DOUBLE, {p.instant}::DOUBLE, {p.lock_windows}, {p.switch_score}::DOUBLE)" for p in C.PROFILES.values()
) + ")"


@query(
    V.with_(V.TRANSCRIPT_W, _PROFILES)
    + """SELECT session, window_idx, p.name AS mode, p.auto, p.instant, CAST(p.lock_windows AS BIGINT) AS lock_windows, p.switch_score FROM transcript_w
    JOIN profiles p ON p.name = CASE CAST(window_idx % 4 AS INTEGER) WHEN 0 THEN 'conservative' WHEN 1 THEN 'fast' ELSE 'balanced' END"""
)
def profile_lookup(spark, sf_dir):
    """Parameters by mode; modes that no profile has fall back to balanced."""
    k = F.col("window_idx") % 4
    asked = F.when(k == 0, "conservative").when(k == 1, "fast").when(k == 2, "balanced").otherwise("odd")
    w = V.transcript_w(spark, sf_dir).select("session", "window_idx", asked.alias("mode"))
    return O.with_profile(w).select("session", "window_idx", "mode", "auto", "instant", "lock_windows", "switch_score")


@query(
    V.with_(
        V.TRANSCRIPT_W,
        "g AS (SELECT *, sum(CASE WHEN silent THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY window_idx) AS part FROM transcript_w)",
    )
    + f"""SELECT session, window_idx, CASE WHEN silent THEN '' ELSE coalesce(last_value(CASE WHEN NOT silent AND length(letters) >= {C.MIN_LETTERS} THEN letters END
      IGNORE NULLS) OVER (PARTITION BY session, part ORDER BY window_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') END AS prev_key FROM g"""
)
def prev_key(spark, sf_dir):
    return O.previous_key(V.transcript_w(spark, sf_dir)).select("session", "window_idx", "prev_key")


