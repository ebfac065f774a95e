"""Which requests of a batch fit when they are served one after another, without serving them one by one."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depotwise.functions.running import running
from depotwise.session import materialise

LIMIT = ["kind", "warehouse_id", "product_id"]
ROUNDS = 4  # of bounds, before the few requests that they leave are folded
ENTRY = "request_id long, kind int, warehouse_id long, product_id long"


def _state(entries: DataFrame, limits: DataFrame) -> DataFrame:
    """Every entry with the room of its limit."""
    known = limits.select(*[F.col(c).alias(f"_{c}") for c in LIMIT], "room", F.col("reason").alias("why"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in LIMIT]
    return entries.join(known, same, "left").select(
        F.col("request_id").cast("long").alias("request_id"), F.col("kind").cast("int").alias("kind"),
        F.col("warehouse_id").cast("long").alias("warehouse_id"), F.col("product_id").cast("long").alias("product_id"),
        F.col("units").cast("long").alias("units"), F.coalesce("room", F.lit(0)).cast("long").alias("room"),
        F.coalesce("why", F.lit("no limit known")).alias("why"), F.lit(False).alias("granted"),
    )


def _bounded(state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round of bounds over the open limits: what is decided (request_id, now, reason; now is null where it
    isn't) and what is left of the state.

    `room` of an entry counts all that is granted before it, but for the entries that the last round granted,
    which are in the state once more for that. Earlier undecided requests take at least what they give back and
    at most what they take. A request that fits at most is granted; one that doesn't fit at least is refused, with
    the first such limit by kind."""
    units, undecided = F.col("units"), ~F.col("granted")
    parts = state.withColumns(
        {
            "least": F.when(undecided, F.least(units, F.lit(0))).otherwise(0),
            "most": F.when(undecided, F.greatest(units, F.lit(0))).otherwise(0),
            "fixed": F.when(undecided, 0).otherwise(units),
        }
    )
    summed = running(parts, LIMIT, ["request_id"], {"low": ("sum", "least"), "high": ("sum", "most"), "gone": ("sum", "fixed")}, stored=True)
    now_open = summed.where(undecided).withColumn("room", F.col("room") - F.col("gone"))
    now_open = materialise(now_open.select(*state.columns, (F.col("low") - F.col("least")).alias("low"), (F.col("high") - F.col("most")).alias("high")), "open-entries")
    taking = units > 0
    judged = now_open.groupBy("request_id").agg(
        F.min(~taking | (units <= F.col("room") - F.col("high"))).alias("sure"),
        F.min(F.when(taking & (units > F.col("room") - F.col("low")), F.struct("kind", "why"))).alias("failed"),
    )
    now = F.when(F.col("failed").isNotNull(), False).when(F.col("sure"), True)
    news = materialise(judged.select("request_id", now.alias("now"), F.col("failed.why").alias("reason")), "decided")
    kept = now_open.drop("low", "high").join(news.where(F.coalesce("now", F.lit(True))).select("request_id", "now"), "request_id")
    kept = kept.withColumn("granted", F.col("now").isNotNull()).select(state.columns)
    still = kept.where(undecided).select(*[F.col(c).alias(f"_{c}") for c in LIMIT]).distinct()
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in LIMIT]
    return news, materialise(kept.join(still, same, "left_semi"), "entries")


def _in_turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries that don't fit, limit by limit in request order; one that is held back takes nothing."""
    current, taken = None, 0
    for batch in batches:
        failed = []
        for request, kind, hub, product, units, room, granted, held in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if (kind, hub, product) != current:
                current, taken = (kind, hub, product), 0
            if granted:
                taken += units
            elif units > 0 and units > room - taken:
                failed.append((request, *current))
            elif not held:
                taken += units
        if failed:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*failed), (pa.int64(), pa.int32(), pa.int64(), pa.int64()))], ["request_id", *LIMIT]
            )


def _folded(state: DataFrame, held: DataFrame) -> DataFrame:
    """The entries that don't fit if the requests in `held` (request_id and limit) take nothing there."""
    back = held.select(F.col("request_id").alias("_request_id"), *[F.col(c).alias(f"_{c}") for c in LIMIT], F.lit(True).alias("held"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("request_id", *LIMIT)]
    fed = state.join(back, same, "left").select("request_id", *LIMIT, "units", "room", "granted", F.coalesce("held", F.lit(False)).alias("held"))
    return fed.repartition(*LIMIT).sortWithinPartitions(*LIMIT, "request_id").mapInArrow(_in_turn, ENTRY)


def _settled(state: DataFrame) -> DataFrame:
    """(request_id, reason) of the undecided requests of a state. Every limit is folded on the assumption that no
    request fails at another one; limits for which that was wrong are folded again. Decisions depend on earlier
    ones only, so each round settles the first wrong one for good and the last one changes nothing."""
    key = ["request_id", *LIMIT]
    undecided = state.where(~F.col("granted"))
    same = lambda a, b, on: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in on]
    held = undecided.select(*key).limit(0)
    failures = materialise(_folded(state, held), "failures")
    limit = F.struct(*LIMIT)
    while True:
        where = failures.groupBy("request_id").agg(F.min(limit).alias("low"), F.max(limit).alias("high"))
        now = undecided.select(*key).join(where, "request_id").where(~limit.eqNullSafe(F.col("low")) | ~limit.eqNullSafe(F.col("high")))
        now = materialise(now.select(*key).distinct(), "held-back")
        changed = materialise(now.exceptAll(held).unionByName(held.exceptAll(now)).select(*LIMIT).distinct(), "limits-to-redo")
        held = now
        if changed.isEmpty():
            break
        on = same("s", "c", LIMIT)
        only = lambda df, on=on, changed=changed, how="left_semi": df.alias("s").join(changed.alias("c"), on, how)
        failures = materialise(only(failures, how="left_anti").unionByName(_folded(only(state), only(held))), "failures")
    first = (
        failures.alias("f").join(undecided.alias("u"), same("f", "u", key))
        .groupBy("u.request_id").agg(F.min(F.struct("u.kind", "u.why")).alias("first"))
    )
    return undecided.select("request_id").distinct().join(first, "request_id", "left").select("request_id", F.col("first.why").alias("reason"))


def accepted_in_turn(entries: DataFrame, limits: DataFrame) -> DataFrame:
    """(request_id, reason) for every request: reason null if it is granted.

    entries: request_id, kind, warehouse_id, product_id, units; one for a request and limit. A request takes `units` of
    each of its limits, or gives them back where negative, if it is granted; it is granted if at its turn, in
    request_id order, all it takes is there. A refused request changes nothing for later ones.
    limits: kind, warehouse_id, product_id, room, reason. An entry without a limit row finds nothing.

    ``ROUNDS`` rounds of bounds decide most requests, however many a limit has; each reads only limits that still have
    undecided requests, and of these only undecided entries and what the last round granted. The rest
    is folded in turn, limit by limit. Each round is written."""
    state = materialise(_state(entries, limits), "entries")
    decided = []
    for _ in range(ROUNDS):
        if state.isEmpty():
            break
        news, state = _bounded(state)
        decided.append(news.where(F.col("now").isNotNull()).select("request_id", "reason"))
    if not state.isEmpty():
        decided.append(_settled(state))
    if not decided:
        return state.select("request_id", F.col("why").alias("reason"))
    return reduce(DataFrame.unionByName, decided)
