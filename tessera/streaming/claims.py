"""Streams: claim reinforcement, rate windows and daily buckets, each equal to its batch form on the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scoring


def read_events(spark: SparkSession, folder: str, per_trigger: int = 1) -> DataFrame:
    """The Parquet files of a folder as a stream of events, with a zoned event time `at`."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)
    return stream.withColumn("at", F.col("ts").cast("timestamp"))


def reinforcement(events: DataFrame, first: float = 0.5) -> DataFrame:
    """Claims by subject, predicate and object as their sightings come in. Use with output mode update or complete."""
    keyed = events.groupBy(F.col("user_id").cast("string").alias("subject"), F.col("event_type").alias("predicate"), F.floor(F.col("value") / 250).cast("string").alias("object"))
    return keyed.agg(F.count("*").alias("seen"), F.min("at").alias("valid_from"), F.max("at").alias("updated_at")).withColumn("strength", F.round(scoring.reinforced(first, F.col("seen")), 6))


STATE = "candidate_id long, seen long, rank int, confidence string, epistemic_status string, created long, updated long, ids array<bigint>, times array<bigint>"
UPDATES = "dedupe_hash string, actor string, candidate_id long, seen long, strength double, confidence string, epistemic_status string, created_at timestamp, updated_at timestamp, expired boolean"


def reinforcement_state(sightings: DataFrame, first: float = 0.5, late: str = "2 days", idle_days: int = 90) -> DataFrame:
    """Claims as state, in update mode: a row for each claim that a micro-batch touches, with all that is known of it.

    sightings: sighting (long), subject, predicate, object, actor, confidence, epistemic_status, at. The key is the claim's
    hash and its actor, null being one of its own. Sightings count in the order of their batches, and within one by time
    and sighting; the first makes the claim, each other one adds a step. A sighting that comes again counts once: its id
    is held until the watermark has passed it, behind which it is dropped as late. A claim that nothing has touched for
    idle_days of event time expires, with a last row that says so, and would begin anew.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    from tessera.functions.text import claim_hash

    names = ("unknown", "low", "medium", "high")
    who = F.coalesce(F.concat(F.lit("="), "actor"), F.lit(""))
    keyed = sightings.withWatermark("at", late).select(claim_hash(F.col("subject"), F.col("predicate"), F.col("object")).alias("dedupe_hash"), who.alias("who"), "sighting", "confidence", "epistemic_status", "at", F.unix_micros("at").alias("us"))

    def step(key, frames, state):
        import pandas as pd

        def row(s, expired):
            values = (s[0], s[1], round(min(1.0, first + scoring.STEP * (s[1] - 1)), 6), s[3], s[4], pd.Timestamp(s[5], unit="us", tz="UTC"), pd.Timestamp(s[6], unit="us", tz="UTC"), expired)
            return pd.DataFrame([(key[0], key[1][1:] if key[1] else None, *values)], columns=[f.split()[0] for f in UPDATES.split(", ")])

        if state.hasTimedOut:
            old = tuple(state.get)
            state.remove()
            yield row(old, True)
            return
        known = tuple(state.get) if state.exists else (None, 0, -1, None, None, 0, 0, [], [])
        who_, seen, rank, confidence, status, created, updated, ids, times = known
        held = dict(zip(ids, times))
        batch = pd.concat(list(frames)).sort_values(["us", "sighting"], kind="stable")
        for sighting, given, said, us in batch[["sighting", "confidence", "epistemic_status", "us"]].itertuples(index=False):
            if sighting in held:
                continue
            held[int(sighting)] = int(us)
            if not seen:
                who_, created = int(sighting), int(us)
            seen, updated = seen + 1, max(updated, int(us))
            place = names.index(given) if given in names else 0
            if place > rank:
                rank, confidence = place, names[place]
            status = said if isinstance(said, str) else status
        passed = state.getCurrentWatermarkMs() * 1000
        held = {i: t for i, t in held.items() if t >= passed}
        new = (who_, seen, rank, confidence, status, created, updated, list(held), list(held.values()))
        state.update(new)
        state.setTimeoutTimestamp(max(updated // 1000 + idle_days * 86_400_000, state.getCurrentWatermarkMs() + 1))
        yield row(new, False)

    return keyed.groupBy("dedupe_hash", "who").applyInPandasWithState(step, UPDATES, STATE, "update", GroupStateTimeout.EventTimeTimeout)


def daily_buckets(events: DataFrame, late: str = "2 days") -> DataFrame:
    """day, event_type, n by calendar day of event time; days close once the watermark has passed them."""
    day = F.window("at", "1 day")
    return events.withWatermark("at", late).groupBy(day, "event_type").agg(F.count("*").alias("n")).select(F.to_date("window.start").alias("day"), "event_type", "n")


def rate_windows(events: DataFrame, length: str = "60 minutes", slide: str = "10 minutes", most: int = 3, late: str = "1 hour") -> DataFrame:
    """user_id, start, n of sliding windows in which a user exceeds a number of events."""
    counted = events.withWatermark("at", late).groupBy(F.window("at", length, slide), "user_id").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") > most).select("user_id", F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """user_id, start, n of sessions that end when nothing comes for a while."""
    counted = events.withWatermark("at", late).groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return counted.select("user_id", F.col("w.start").alias("start"), "n")


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """All that is there now, in micro-batches, to Parquet; `complete` results go to the folder of their last batch."""
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    else:
        query = stream.writeStream.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()


def over_limit(events: DataFrame, seconds: int = 3600, most: int = 3) -> DataFrame:
    """Batch form of a sliding log: events that come after `most` or more others of their user within the seconds before."""
    from pyspark.sql import Window

    log = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("n", F.count("*").over(log)).filter(F.col("n") > most).select("event_id", "user_id", "n")
