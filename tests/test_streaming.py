"""Streams give what the same rows give at once."""

import random
from datetime import datetime

from rastervec.operators import editing as E
from rastervec.operators import features as O
from rastervec.streaming import edits as S

SCHEMA = "version long, id long, layer string, deleted boolean, ts timestamp"


def ran(stream, mode, name, folder):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{folder}/state-{name}").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return stream.sparkSession.table(name)


def test_edits_as_they_come(spark, tmp_path):
    rows = [(v, i, "AB"[(v + i) % 2], v == 3 and i == 1, datetime(2024, 1, 1, v, 5 * i)) for v in range(5) for i in range(4) if (v + i) % 3]
    log = spark.createDataFrame(rows, SCHEMA)
    for v in range(5):
        log.where(f"version = {v}").write.mode("append").parquet(str(tmp_path / "log"))
    read = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "log"))
    state = ran(S.latest(read()), "complete", "latest_edits", tmp_path)
    assert sorted(map(tuple, state.where("not deleted").select("id", "version", "layer").collect())) == sorted(map(tuple, O.at_version(log, 9).select("id", "version", "layer").collect()))
    counts = ran(S.activity(read(), size="1 hour"), "update", "activity_of_edits", tmp_path)
    last = {}
    for r in counts.collect():
        last[r["start"], r["layer"]] = max(r["edits"], last.get((r["start"], r["layer"]), 0))
    assert sum(last.values()) == len(rows)


def plain_history(ops):
    version = depth = 0
    log, out = {}, []
    for seq, op in ops:
        if op == "push":
            log = {v: s for v, s in log.items() if v <= version} | {version + 1: seq}
            version = depth = version + 1
        elif op == "undo":
            version = max(0, version - 1)
        elif op == "redo":
            version = min(depth, version + 1)
        out.append((seq, version, depth))
    return out, log, version


def test_undo_and_redo_across_batches(spark, tmp_path):
    rng = random.Random(12)
    ops = {d: [(k, rng.choice(["push", "push", "undo", "redo", "?"])) for k in range(60)] for d in ("a", "b", "c")}
    schema = "drawing string, seq long, op string"
    for batch in range(6):
        rows = [(d, s, op) for d, every in ops.items() for s, op in every[10 * batch : 10 * batch + 10]]
        late = [("a", 3, "push")] if batch == 4 else []
        spark.createDataFrame(rows + late, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "ops" / f"{batch}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "ops"))
    table = spark.createDataFrame(ran(S.history(stream), "append", "history_of_edits", tmp_path).collect(), S.HISTORY)
    got = table.collect()
    assert [(r["seq"], r["applied"]) for r in got if not r["applied"]] == [(3, False)]
    shown = S.standing(table).collect()
    log = spark.createDataFrame([(0, "", "", False)], "version long, id string, layer string, deleted boolean").where("false")
    for d, every in ops.items():
        steps, pushes, version = plain_history(every)
        assert sorted((r["seq"], r["version"], r["depth"]) for r in got if r["drawing"] == d and r["applied"]) == sorted(steps)
        assert {r["version"]: r["seq"] for r in shown if r["drawing"] == d} == pushes and {r["version"] for r in shown if r["drawing"] == d and r["shown"]} == set(range(1, version + 1))
    at, log = 0, log
    for seq, op in ops["a"][:14]:  # the batch operators, one edit after another
        before = dict((s, v) for s, v, _ in plain_history(ops["a"])[0]).get(seq - 1, 0)
        if op == "push":
            log = E.pushed(log, spark.createDataFrame([(0, f"f{seq}", str(seq), False)], log.schema), at=before)
        at = dict((s, v) for s, v, _ in plain_history(ops["a"])[0])[seq]
    part = S.standing(table.where("drawing = 'a' AND seq < 14")).where("shown").collect()
    assert {(r["version"], str(r["seq"])) for r in part} == {(r["version"], r["layer"]) for r in O.at_version(log, at).collect()}
