"""X06, ST07, DML10, P18: profile images scored cache first: what is known answers, only misses are scored, once each, and kept.

A request asks for a user's evidence with the photos' fingerprint and a group's threshold. The cache holds a row for each user:
fingerprint, pipeline, screening score, and the verifier's labels once there was reason to verify. It answers a request if its
fingerprint and pipeline are the request's and its labels are there (verified) or its screening score is under the threshold
(screened); everything else is a miss. Misses of one user and fingerprint are one call, for the lowest threshold that missed.

The two models are functions from (user_id, fingerprint) rows to rows with ``fast``, and with ``labels``; null or no row is a
failure, which is never taken for a score of zero and never kept. A second run over the same requests scores nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from vigilake.functions import scores
from vigilake.operators import state

KEYS = ["user_id", "fingerprint"]
CACHE = "user_id long, fingerprint string, pipeline string, fast double, scanned_at timestamp_ntz, labels array<struct<label: string, value: double>>"


def _state(threshold: Column) -> Column:
    return F.when(F.col("labels").isNotNull(), "verified").when(F.col("fast") < threshold, "screened")


def missed(requests: DataFrame, cache: DataFrame, pipeline: str) -> DataFrame:
    """(user_id, fingerprint, bar) of what the cache can't answer; a user without photos is never asked for."""
    mine = cache.filter(F.col("pipeline") == pipeline).select(*KEYS, "fast", "labels")
    open_ = requests.filter(F.col("fingerprint") != "").groupBy(*KEYS).agg(F.min("threshold").alias("bar"))
    return open_.join(mine, KEYS, "left").filter(_state(F.col("bar")).isNull()).select(*KEYS, "bar")


def scored(misses: DataFrame, screen: Callable[[DataFrame], DataFrame], verify: Callable[[DataFrame], DataFrame], pipeline: str, now: Column, write: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Cache rows of the misses: all are screened, and those at or over their bar verified. ``write`` keeps screening results, so that no model runs twice."""
    asked = write(misses)
    fast = write(screen(asked.select(*KEYS)).filter(F.col("fast").isNotNull() & ~F.isnan("fast")).select(*KEYS, "fast"))
    flagged = asked.join(fast, KEYS).filter(F.col("fast") >= F.col("bar")).select(*KEYS)
    labels = write(verify(flagged).filter(F.col("labels").isNotNull()).select(*KEYS, "labels"))
    rows = fast.join(labels, KEYS, "left")
    return rows.select(*KEYS, F.lit(pipeline).alias("pipeline"), "fast", now.cast("timestamp_ntz").alias("scanned_at"), "labels")


def answers(requests: DataFrame, cache: DataFrame, pipeline: str) -> DataFrame:
    """Each request with ``state`` (verified, screened, unknown) and ``score``: of the group's own categories once verified."""
    mine = cache.filter(F.col("pipeline") == pipeline).select(*KEYS, "fast", "labels")
    joined = requests.join(mine, KEYS, "left")
    known = _state(F.col("threshold"))
    own = scores.category_score(F.col("labels"), F.col("categories"))
    score = F.when(known == "verified", own).when(known == "screened", F.col("fast"))
    return joined.select(*requests.columns, F.coalesce(known, F.lit("unknown")).alias("state"), score.alias("score"))


def resolve(requests: DataFrame, cache: DataFrame, screen, verify, pipeline: str, now: Column, write) -> tuple[DataFrame, DataFrame]:
    """(answers of all requests, the new cache): requests are (user_id, fingerprint, threshold, categories, ...), cache rows are of ``CACHE``.

    An entry whose new verification failed keeps its screening score, and its request stays unknown.
    """
    new = scored(missed(requests, cache, pipeline), screen, verify, pipeline, now, write)
    after = write(state.fold_cache(cache, new).select(*cache.columns))
    return answers(requests, after, pipeline), after
