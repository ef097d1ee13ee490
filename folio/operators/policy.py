"""What to do about failures: streaks, pauses and pools, over logged attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.operators.folds import ordered_fold
from folio.operators.islands import islands

TRANSIENT_STREAK = 3
PAUSES = [30, 60, 120]
GROW_AFTER = 20
AUTH_AFTER, LOCKED_AFTER, AGAIN_AFTER = 2, 3, 10
SLOWEST, RATE_LIMIT_MAX, RATE_LIMIT_MS, RETRIES, BACKOFF_MS = 8.0, 8, 600_000, 3, 2000


def failure_streaks(events: DataFrame, by: list[str], order: list[str], failed: Column) -> DataFrame:
    """by, streak, length, first, last: runs of consecutive failures, in order."""
    w = Window.partitionBy(*by).orderBy(*order)
    seen = events.withColumn("_f", failed).withColumn("_p", F.lag("_f").over(w))
    runs = islands(seen, by, order, F.col("_f") & ~F.coalesce("_p", F.lit(False)), "streak").where("_f")
    return runs.groupBy(*by, "streak").agg(F.count("*").alias("length"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"))


def pauses(streaks: DataFrame, by: list[str]) -> DataFrame:
    """by, streak, pauses, seconds, halted: every third failure in a row asks for the next pause; the ladder starts anew
    after a success, and a request beyond its end halts."""
    asked = F.floor(F.col("length") / TRANSIENT_STREAK).cast("int")
    seconds = F.aggregate(F.slice(F.array(*map(F.lit, PAUSES)), F.lit(1), F.least(asked, F.lit(len(PAUSES)))), F.lit(0), lambda a, x: a + x)
    return streaks.select(*by, "streak", F.least(asked, F.lit(len(PAUSES))).alias("pauses"), seconds.alias("seconds"), (asked > len(PAUSES)).alias("halted"))


def pool_limits(outcomes: Column, most: int = 3) -> Column:
    """array<int>: the pool's size after each of array<boolean> outcomes (true: success): 1 after a push-back, one more
    after each GROW_AFTER successes in a row."""

    def step(s: Column, ok: Column) -> Column:
        streak = F.when(ok, s["streak"] + 1).otherwise(0)
        grown = streak >= GROW_AFTER
        limit = F.when(~ok, F.lit(1)).when(grown, F.least(F.lit(most), s["limit"] + 1)).otherwise(s["limit"])
        return F.struct(F.when(grown, 0).otherwise(streak).cast("int").alias("streak"), limit.cast("int").alias("limit"), F.concat(s["out"], F.array(limit.cast("int"))).alias("out"))

    start = F.struct(F.lit(0).alias("streak"), F.lit(most).alias("limit"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(outcomes, start, step, lambda s: s["out"])


def pool_sizes(outcomes: DataFrame, by: list[str], order: list[str], ok: str, most: int = 3) -> DataFrame:
    """outcomes with `limit`, the pool's size after each, as pool_limits has it; a key's rows are never in memory together."""

    def step(state: tuple[int, int], good: bool) -> tuple[tuple[int, int], tuple[int]]:
        streak, limit = (state[0] + 1, state[1]) if good else (0, 1)
        if streak >= GROW_AFTER:
            streak, limit = 0, min(most, limit + 1)
        return (streak, limit), (limit,)

    return ordered_fold(outcomes, by, order, [ok], lambda: (0, most), step, "limit int")


def due_probes(outcomes: DataFrame, by: list[str], order: list[str], outcome: str) -> DataFrame:
    """outcomes with `due`: whether a probe of the login is due after each, as probes has it, and `any_ok`."""

    def step(state: tuple, o: str) -> tuple[tuple, tuple[bool, bool]]:
        any_ok, probed, auth, locked = state
        if o == "ok":
            return (True, probed, 0, 0), (False, True)
        refused = o in ("locked", "missing") and any_ok
        auth, locked = auth + (o == "auth"), locked + refused
        due = (o == "auth" and auth >= (AGAIN_AFTER if probed else AUTH_AFTER)) or (refused and locked >= (AGAIN_AFTER if probed else LOCKED_AFTER))
        return (any_ok, probed or due, 0 if due else auth, 0 if due else locked), (due, any_ok)

    return ordered_fold(outcomes, by, order, [outcome], lambda: (False, False, 0, 0), step, "due boolean, any_ok boolean")


def retryable(status: Column) -> Column:
    return status.isin(408, 429) | (status >= 500)


def classify(status: Column, content_type: Column, error: Column) -> Column:
    """What an API's answer means: ok, auth (asked to log in: HTML with a refusal or in place of JSON), locked (refused in
    JSON), missing, transient (worth a retry), or page (any other refusal: the post's page is tried next)."""
    html = F.coalesce(F.lower(content_type).contains("html"), F.lit(False))
    return (
        F.when(error.isNotNull() | retryable(status), "transient").when(status.isin(401, 403), F.when(html, "auth").otherwise("locked"))
        .when(status == 404, "missing").when(status >= 400, "page").when(html, "auth").otherwise("ok")
    )


def probes(outcomes: Column) -> Column:
    """array<boolean>: whether a probe of the login is due after each of array<string> outcomes, if all probes pass.

    Due after AUTH_AFTER auth answers in a row, or after LOCKED_AFTER locked or missing ones in a row once anything has
    been ok; after the first probe, after AGAIN_AFTER of either. A success ends both rows; a probe ends them too."""

    def step(s: Column, o: Column) -> Column:
        ok = o == "ok"
        any_ok = s["any_ok"] | ok
        auth = F.when(ok, 0).when(o == "auth", s["auth"] + 1).otherwise(s["auth"])
        locked = F.when(ok, 0).when(o.isin("locked", "missing") & any_ok, s["locked"] + 1).otherwise(s["locked"])
        due = ((o == "auth") & (auth >= F.when(s["probed"], AGAIN_AFTER).otherwise(AUTH_AFTER))) | (o.isin("locked", "missing") & any_ok & (locked >= F.when(s["probed"], AGAIN_AFTER).otherwise(LOCKED_AFTER)))
        held = lambda n: F.when(due, 0).otherwise(n).cast("int")
        return F.struct(any_ok.alias("any_ok"), (s["probed"] | due).alias("probed"), held(auth).alias("auth"), held(locked).alias("locked"), F.concat(s["out"], F.array(due)).alias("out"))

    start = F.struct(F.lit(False).alias("any_ok"), F.lit(False).alias("probed"), F.lit(0).alias("auth"), F.lit(0).alias("locked"), F.array().cast("array<boolean>").alias("out"))
    return F.aggregate(outcomes, start, step, lambda s: s["out"])


# Answers to requests of one run, in the order of their starts


def backoff_ms(n: int) -> int:
    return BACKOFF_MS * 2**n


def next_run(slow: float, cooldown: int, at: int, status: int | None, wait: int | None, limited: bool, tried: bool) -> tuple[float, int]:
    """What an answer makes of its run: how slow requests are, and the time (ms) before which none starts. limited: the
    answer is a 429 that doesn't give up; tried: another failure that is tried again."""
    if status is not None and status < 400:
        return max(1.0, slow * 0.9), cooldown
    if limited or (tried and status == 503 and wait is not None):
        return min(slow * 2, SLOWEST), max(cooldown, at + (wait or 0))
    return slow, cooldown


def next_request(hits: int, waited: int, tries: int, status: int | None, wait_ms: int | None) -> tuple[tuple[int, int, int], int, str]:
    """What an answer makes of its request: ((429s in a row, ms waited for them, other failures), ms to wait, outcome).

    Outcomes: ok; retry; gave_up, at the RATE_LIMIT_MAX-th 429 in a row or one that brings the waits over RATE_LIMIT_MS; failed,
    at a refusal that isn't worth a retry or the RETRIES-th retry's failure. A 429 without a wait waits as long as its row
    says. No status is a failure of the network. What the request has waited for stays when its row of 429s ends."""
    if status is not None and status < 400:
        return (0, waited, tries), 0, "ok"
    if status == 429:
        wait = wait_ms if wait_ms is not None else backoff_ms(hits)
        if hits + 1 >= RATE_LIMIT_MAX or waited + wait > RATE_LIMIT_MS:
            return (hits + 1, waited, tries), wait, "gave_up"
        return (hits + 1, waited + wait, tries), wait, "retry"
    if (status is not None and status != 408 and status < 500) or tries >= RETRIES:
        return (0, waited, tries), 0, "failed"
    return (0, waited, tries + 1), wait_ms if wait_ms is not None else backoff_ms(tries), "retry"


def slowdowns(answers: DataFrame, run: str, order: list[str]) -> DataFrame:
    """answers(run, request, at (ms), status, wait_ms) with slow, cooldown (ms), hits, waited (ms), outcome after each.

    A 429, or a 503 that says how long to wait, doubles the pause between a run's requests (SLOWEST times at most) and holds
    them all until its wait is over; a success takes a tenth off (never under 1). Hits, waits and tries are the request's
    own, of which several may be going: they start anew with the next one. See next_request for outcomes."""

    def step(state: tuple, request, at: int, status: int | None, wait_ms: int | None) -> tuple[tuple, tuple]:
        slow, cooldown, going = state
        own, wait, outcome = next_request(*going.pop(request, (0, 0, 0)), status, wait_ms)
        tried = outcome == "retry"
        if tried:
            going[request] = own
        slow, cooldown = next_run(slow, cooldown, at or 0, status, wait if status == 429 else wait_ms, tried and status == 429, tried and status != 429)
        return (slow, cooldown, going), (slow, cooldown, own[0], own[1], outcome)

    return ordered_fold(answers, [run], order, ["request", "at", "status", "wait_ms"], lambda: (1.0, 0, {}), step, "slow double, cooldown long, hits int, waited long, outcome string")
