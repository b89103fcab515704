"""Header updates, incremental chunks and the stream of claims, against plain forms and full rebuilds."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tessera.operators import ledger, vectors
from tessera.sources import markdown
from tessera.streaming import claims as streams


def test_headers_survive_a_round_trip(spark):
    dice = random.Random(1)
    value = lambda: dice.choice([None, "plain", "two words", "a: b", '"quoted"', "'single'", "[a, b]", " padded ", "7", "# no comment", "it's", ", comma", "x" * 200])
    fields = [{f"k{dice.randrange(9)}": value() for _ in range(dice.randrange(1, 6))} for _ in range(200)]
    rows = spark.createDataFrame([(k, f) for k, f in enumerate(fields)], "id long, fields map<string,string>")
    empty = F.lit("---\ntitle: t\n---\n# Body\n")
    out = rows.select("id", markdown.header(markdown.update_header(empty, F.col("fields"))).alias("h"), markdown.body(markdown.update_header(empty, F.col("fields"))).alias("b")).collect()
    for r in out:
        assert r["h"] == {"title": "t", **fields[r["id"]]} and r["b"] == "# Body\n"


def test_a_partial_update_leaves_the_rest(spark):
    text = '---\n# a comment\ntitle:  "Old"\ntags:\n  - a\n  - b\nodd line\nkind: x\nkind: y\n---\nbody: no header\n---\n'
    cases = {
        "title": ({"title": "New"}, text.replace('title:  "Old"', "title: New")), "tags": ({"tags": "[c]"}, text.replace("tags:\n  - a\n  - b\nodd line", "tags: [c]")),
        "kind": ({"kind": "z"}, text.replace("kind: y", "kind: z")), "new": ({"b": "2", "a": None}, text.replace("kind: y\n", "kind: y\na: null\nb: 2\n")), "none": ({}, text),
    }
    rows = spark.createDataFrame([(k, c) for k, (c, _) in cases.items()], "name string, changes map<string,string>")
    got = {r["name"]: r["t"] for r in rows.select("name", markdown.update_header(F.lit(text), F.col("changes")).alias("t")).collect()}
    assert got == {k: w for k, (_, w) in cases.items()}
    bare = rows.filter("name = 'title'").select(markdown.update_header(F.lit("just text"), F.col("changes"))).first()[0]
    assert bare == "---\ntitle: New\n---\njust text"


def test_incremental_chunks_equal_a_rebuild(spark):
    page = lambda k, n: (f"p{k}", "\n".join(f"# h{j}\nwords of page {k} and w{j * n} " + "filler " * 30 for j in range(6)))
    old = spark.createDataFrame([page(k, 1) for k in range(30)], "page_id string, body string")
    new = spark.createDataFrame([page(k, 2 if k % 5 == 0 else 1) for k in range(4, 36)] + [("empty", None)], "page_id string, body string")
    before = vectors.hashed_chunks(old)
    count = lambda c: vectors.chunk_postings(c).groupBy("token").agg(F.count("*").alias("df"))
    chunked, counts, changes = vectors.upkeep(before, count(before), new)
    rebuilt = vectors.hashed_chunks(new)
    assert sorted(map(tuple, chunked.collect())) == sorted(map(tuple, rebuilt.select(chunked.columns).collect()))
    assert sorted(map(tuple, counts.select("token", "df").collect())) == sorted(map(tuple, count(rebuilt).collect()))
    got = {}
    for r in changes.collect():
        got.setdefault(r["change"], set()).add(r["page_id"])
    assert got == {"gone": {f"p{k}" for k in range(4)}, "new": {f"p{k}" for k in range(30, 36)} | {"empty"}, "edited": {"p5", "p10", "p15", "p20", "p25"}}


COLUMNS = "sighting long, subject string, predicate string, object string, actor string, confidence string, epistemic_status string, at timestamp"


def test_the_stream_of_claims_is_the_merge_of_its_batches(spark, tmp_path):
    dice, day = random.Random(2), dt.datetime(2024, 1, 1)
    rows = [(k, f"s{dice.randrange(4)}", "uses", dice.choice(["x", " X "]), dice.choice(["ann", None, ""]), dice.choice(["low", "high", None, "medium"]), dice.choice([None, "observed", "inferred"]), day + dt.timedelta(minutes=dice.randrange(2000))) for k in range(120)]
    parts = [rows[0::3], rows[1::3] + rows[0:9:3], rows[2::3] + rows[1:30:3]]  # some sightings come again
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    stream = lambda: streams.reinforcement_state(spark.readStream.schema(COLUMNS).option("maxFilesPerTrigger", 1).parquet(source))

    def follow():
        def keep(df, number):
            df.withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

        stream().writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()

    merged, seen = None, set()
    for part in parts:  # a run for each batch: each begins again from the checkpoint
        dice.shuffle(part)
        spark.createDataFrame(part, COLUMNS).coalesce(1).write.mode("append").parquet(source)
        follow()
        fresh = [r for r in part if r[0] not in seen]
        seen |= {r[0] for r in fresh}
        table = spark.createDataFrame(fresh, COLUMNS).withColumn("observed_at", F.col("at")).withColumn("valid_from", F.lit(None).cast("timestamp")).withColumn("valid_until", F.lit(None).cast("timestamp"))
        merged = ledger.reinforce(table) if merged is None else ledger.merge(merged, table)
    wanted = {(r["dedupe_hash"], r["actor"]): (r["candidate_id"], r["seen"], r["strength"], r["confidence"], r["epistemic_status"]) for r in merged.collect()}
    last = spark.read.parquet(out).groupBy("dedupe_hash", "actor").agg(F.max_by(F.struct("candidate_id", "seen", "strength", "confidence", "epistemic_status"), "batch").alias("x")).collect()
    got = {(r["dedupe_hash"], r["actor"]): tuple(r["x"]) for r in last}
    assert got == wanted and sum(v[1] for v in got.values()) == 120


def test_idle_claims_expire(spark, tmp_path):
    source, out, day = str(tmp_path / "in"), str(tmp_path / "out"), dt.datetime(2024, 1, 1)
    for k, days in enumerate((0, 200, 201)):
        spark.createDataFrame([(k, f"s{min(k, 1)}", "uses", "x", None, "low", None, day + dt.timedelta(days=days))], COLUMNS).coalesce(1).write.mode("append").parquet(source)
        stream = streams.reinforcement_state(spark.readStream.schema(COLUMNS).parquet(source))
        stream.writeStream.outputMode("update").foreachBatch(lambda df, _: df.write.mode("append").parquet(out)).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    rows = [(r["candidate_id"], r["seen"]) for r in spark.read.parquet(out).filter("expired").collect()]
    assert rows == [(0, 1)]
