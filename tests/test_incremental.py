"""Keyed ingest, bucketed state, key tables: against the sequential rule and by the files they touch."""

import datetime
import json
import os
import random
import re
import shutil
import time

import pytest
from pyspark.sql import functions as F

from vocspark.functions.ids import feedback_id
from vocspark.operators import dedup
from vocspark.operators.key_table import KeyTable, insert_by_keys, keys_of_stored
from vocspark.operators.state import upsert_states
from vocspark.schema import FEEDBACK_SCHEMA, STATE_SCHEMA
from vocspark.sinks.state_table import StateTable
from vocspark.sinks.tables import project
from vocspark.streaming import jobs, keyed_state

RAW = "feedback string, title string, created string, source string"


def to_feedback(raw):
    return raw.withColumn("feedback_id", feedback_id(F.lit(""), "feedback", "source"))


def land(folder, name, rows):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/.{name}", "w") as f:
        f.write("\n".join(json.dumps(r) for r in rows))
    os.rename(f"{folder}/.{name}", f"{folder}/{name}")


def greedy(waves, taken=()):
    """The rule one row after the other; a row is (id, sig, order, wave)."""
    ids, sigs, out = {i for i, _ in taken}, {s for _, s in taken}, []
    for i, s, _, w in sorted(waves, key=lambda r: (r[3], r[2])):
        if i not in ids and s not in sigs:
            ids.add(i)
            sigs.add(s)
            out.append((i, s, w))
    return sorted(out)


def keyed_rows(spark, rows, wave):
    """What the stream makes of raw rows, by the batch functions."""
    df = spark.createDataFrame([(r["feedback"], r["title"], r["created"], r["source"]) for r in rows], RAW)
    stored = jobs.stored_form(project(to_feedback(df)))
    return [(r.feedback_id, r.sig, f"{r.created}|{r.feedback_id}|", wave) for r in stored.withColumn("sig", dedup._signature("title", "feedback")).collect()]


def test_waves_follow_the_sequential_rule(spark, tmp_path):
    rnd = random.Random(2)
    texts = ["alpha", "Alpha!", "  alpha", "beta", "beta beta", "漢字", "", "gamma."]

    def some(n):
        return [{"feedback": rnd.choice(texts), "title": rnd.choice(["t", "T ", "u", ""]), "created": f"2024-01-{rnd.randint(10, 28)}",
                 "source": rnd.choice(["Forum", "Mail", "Chat"])} for _ in range(n)]

    first, waves = some(6), [some(25), some(25), some(10)]
    old = to_feedback(spark.createDataFrame([(r["feedback"], r["title"], r["created"], r["source"]) for r in first], RAW))
    taken = [(i, s) for i, s, _, _ in keyed_rows(spark, first, 0)]
    want, found = [], []
    for n, rows in enumerate(waves):
        land(f"{tmp_path}/in", f"{n}.json", rows)
        want += keyed_rows(spark, rows, n)
        jobs.ingest_stream(spark, f"{tmp_path}/in", RAW, to_feedback, f"{tmp_path}/table", f"{tmp_path}/cp", stored=old).awaitTermination(200)
        new = spark.read.schema(FEEDBACK_SCHEMA).parquet(f"{tmp_path}/table/batch={n}")
        found += [(r.feedback_id, r.sig, n) for r in new.withColumn("sig", dedup._signature("title", "feedback")).collect()]
        shutil.rmtree(f"{tmp_path}/table/batch={n}")  # later waves cannot read it
    assert sorted(found) == greedy(want, taken) and len({w for *_, w in found}) > 1


def test_columns_of_one_type_travel_together(spark, tmp_path):
    kinds = "voc_group string, a string, `b.c` string, `d``e` string, voc_0 string, t timestamp, u timestamp, n double, l array<string>, m array<string>, g boolean"
    day = datetime.datetime(2024, 2, 29, 1, 2, 3, 456789)
    rows = [("k", "", None, "x", "\u00e9\n", day, None, 0.1, ["p", None], [], True), ("k",) + (None,) * 10, (None, "1", "2", "3", "4", None, day, float("inf"), None, ["q"], False)]
    df = spark.createDataFrame(rows, kinds)
    narrow, columns, back = keyed_state.packed(df, ["voc_group"])
    assert len(columns) == 5 and narrow.columns == ["voc_group", *columns]
    again = narrow.select("voc_group", *back)
    assert again.dtypes == df.dtypes and [tuple(r) for r in again.collect()] == rows
    landed = project(to_feedback(spark.readStream.schema(RAW).json(str(tmp_path))))
    fresh = keyed_state.only_new(landed, F.lit(""))
    assert fresh.dtypes == landed.dtypes
    sent = re.search(r"transformWithStateUDF\((.*?)\)#", fresh._jdf.queryExecution().analyzed().toString())[1].split(",")
    assert len(landed.columns) > 30 and len(sent) < 12


def test_keys_are_forgotten_after_their_time(spark, tmp_path):
    def wave(n, text):
        land(f"{tmp_path}/in", f"{n}.json", [{"feedback": text, "title": text, "created": "2024-01-01", "source": "Forum"}])
        jobs.ingest_stream(spark, f"{tmp_path}/in", RAW, to_feedback, f"{tmp_path}/table", f"{tmp_path}/cp", keep="2 seconds").awaitTermination(200)
        return sorted(r.feedback for r in spark.read.schema(FEEDBACK_SCHEMA).option("recursiveFileLookup", True).parquet(f"{tmp_path}/table").collect())

    assert wave(0, "first") == ["first"]
    assert wave(1, "first") == ["first"]
    time.sleep(3)
    assert wave(2, "other") == ["first", "other"]  # moves the clock on
    assert wave(3, "first") == ["first", "first", "other"]


CHANGES = "ord bigint, feedback_id string, state string, notes string, domain string, updated_by string, at timestamp"


def states(spark, n):
    return spark.range(n).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("feedback_id"), F.lit("NEW").alias("state"),
                                 *[F.lit(None).cast(f.dataType).alias(f.name) for f in STATE_SCHEMA.fields[2:]])


def files_under(folder):
    return {os.path.join(d, f) for d, _, fs in os.walk(folder) for f in fs if f.endswith(".parquet")}


def test_one_change_rewrites_one_bucket(spark, tmp_path):
    table = StateTable(spark, str(tmp_path / "t"), buckets=16)
    assert table.read().count() == 0
    table.create(states(spark, 400))
    before = files_under(f"{tmp_path}/t/data")
    assert len(before) == 16
    change = spark.createDataFrame([(1, "f7", "CLOSED", "n", None, "ann", None), (2, None, "CLOSED", None, None, None, None), (3, "", "CLOSED", None, None, None, None)], CHANGES)
    assert table.merge(change, token="a") == 2
    new = files_under(f"{tmp_path}/t/data") - before
    assert len(new) == 1 and before <= files_under(f"{tmp_path}/t/data")
    assert {r.feedback_id for r in table.read().filter("state = 'CLOSED'").collect()} == {"f7"}
    assert table.read(1).filter("state = 'CLOSED'").count() == 0
    assert table.merge(change, token="a") == 2 and files_under(f"{tmp_path}/t/data") == before | new
    assert table.vacuum() == 1 and table.read().count() == 400 and len(files_under(f"{tmp_path}/t/data")) == 16
    with pytest.raises(ValueError):
        table.create(states(spark, 1))
    assert StateTable(spark, str(tmp_path / "t"), buckets=5).manifest()[2] == 16  # the table's own number


def test_a_broken_merge_changes_nothing(spark, tmp_path):
    table = StateTable(spark, str(tmp_path / "t"), buckets=4)
    table.create(states(spark, 40))
    # the data of the next version without its manifest
    states(spark, 40).withColumn("state", F.lit("BROKEN")).withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{tmp_path}/t/data/version=2")
    assert table.read().filter("state = 'BROKEN'").count() == 0
    table.merge(spark.createDataFrame([(1, "f3", "CLOSED", None, None, None, None)], CHANGES))
    got = {r.state: r["count"] for r in table.read().groupBy("state").count().collect()}
    assert got == {"NEW": 39, "CLOSED": 1}


def test_merges_equal_one_upsert(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(i, rnd.choice(["", None, *(f"f{k}" for k in range(60))]), rnd.choice([None, "CLOSED", "TRIAGED"]), rnd.choice([None, "n1", "n2"]),
             rnd.choice([None, "", "D"]), rnd.choice([None, "ann", ""]), None) for i in range(200)]
    table = StateTable(spark, str(tmp_path / "t"), buckets=8)
    table.create(states(spark, 30))
    for part in (rows[:70], rows[70:71], rows[71:71], rows[71:]):
        table.merge(spark.createDataFrame(part, CHANGES))
    want = upsert_states(states(spark, 30), spark.createDataFrame(rows, CHANGES))
    assert sorted(map(str, table.read().collect())) == sorted(map(str, want.select(table.read().columns).collect()))


ROWS = "n bigint, feedback_id string, title string, content string, key string, block bigint"


def batch_rows(spark, seed, n):
    rnd = random.Random(seed)
    return spark.createDataFrame([(1000 * seed + i, rnd.choice([None, *(f"i{rnd.randrange(40)}" for _ in range(9))]), rnd.choice(["a", "b", None]),
                                   f"text {rnd.randrange(60)}", "k", 1) for i in range(n)], ROWS)


@pytest.mark.parametrize("blocks", [1 << 17, 1])
def test_inserts_by_keys_equal_inserts_by_text(spark, tmp_path, blocks):
    stored = batch_rows(spark, 1, 40)
    keys = KeyTable(spark, str(tmp_path / "k"), blocks)
    keys_of_stored(keys, stored)
    for seed in (2, 3, 4):
        new = batch_rows(spark, seed, 50)
        want = dedup.rows_to_insert(new, stored, "n").collect()
        got = insert_by_keys(new, keys, "n", token=str(seed))
        assert sorted(r.n for r in got.collect()) == sorted(r.n for r in want)
        stored = stored.unionByName(spark.createDataFrame(want, ROWS)).checkpoint()
    assert keys.versions() == [0, 2, 3, 4]
    other = keys.rebuild(str(tmp_path / "r"), 64)
    asked = spark.createDataFrame([("ii1",), ("inever",), ("s?",)], "key string")
    assert sorted(r.key for r in other.known(asked).collect()) == sorted(r.key for r in keys.known(asked).collect())


def test_filters_stop_unknown_keys_and_no_text_is_read(spark, tmp_path):
    keys = KeyTable(spark, str(tmp_path / "k"))
    keys_of_stored(keys, batch_rows(spark, 1, 500))
    assert keys.possible(spark.range(2000).select(F.concat(F.lit("new"), F.col("id").cast("string")).alias("key"))).count() < 20
    plan = keys.unknown_pairs(dedup.key_rows(batch_rows(spark, 2, 10), "n"))._jdf.queryExecution().optimizedPlan().toString()
    reads = [line for line in plan.splitlines() if "Relation [" in line]
    assert reads and not any("content" in line or "title" in line for line in reads)
    empty = KeyTable(spark, str(tmp_path / "e"))
    assert empty.known(spark.createDataFrame([("x",)], "key string")).count() == 0
