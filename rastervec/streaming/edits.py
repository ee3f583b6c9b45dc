"""Edits that come as a stream: the state of a drawing as it is edited, and how much is edited where."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def latest(edits: DataFrame) -> DataFrame:
    """The last version of each feature of a stream (version, id, deleted, ...); deleted ones stay, marked. For the output modes update and complete; the state is a row for each id."""
    columns = [c for c in edits.columns if c != "id"]
    return edits.groupBy("id").agg(F.max_by(F.struct(*columns), "version").alias("_r")).select("id", "_r.*")


def activity(edits: DataFrame, *, at: str = "ts", size: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(start, layer, edits) of tumbling windows over the time column ``at``; what comes later than ``late`` is not counted, and a window's state goes then."""
    rows = edits.withWatermark(at, late).groupBy(F.window(at, size).alias("w"), "layer").agg(F.count("*").alias("edits"))
    return rows.select(F.col("w.start").alias("start"), "layer", "edits")


#: What is kept of a drawing between batches, and what an edit gives.
STATE = "version long, depth long, last long"
HISTORY = "drawing string, seq long, op string, version long, depth long, applied boolean"


def _history(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    version, depth, last = state.get if state.exists else (0, 0, -(1 << 63))
    rows = pd.concat(batches).sort_values("seq", kind="stable")
    out = []
    for seq, op in zip(rows["seq"].tolist(), rows["op"].tolist()):
        applied = seq > last
        if applied:
            last = seq
            if op == "push":
                version = depth = version + 1
            elif op == "undo":
                version = max(0, version - 1)
            elif op == "redo":
                version = min(depth, version + 1)
        out.append((key[0], seq, op, version, depth, applied))
    state.update((version, depth, last))
    yield pd.DataFrame(out, columns=["drawing", "seq", "op", "version", "depth", "applied"])


def history(edits: DataFrame) -> DataFrame:
    """Undo and redo on a stream (drawing, seq, op): for each edit the version that the drawing is at then, and how many versions there are.

    A push goes to the next version and cuts off what had been undone; undo and redo stay within what there is. Between batches a drawing has three numbers as its state. Edits of a batch are taken in
    the order of seq; one that comes with a seq not above the last (late, or a repeated row) is not applied, and says so. Another op changes nothing. For the output mode append or update."""
    rows = edits.select(F.col("drawing").cast("string").alias("drawing"), F.col("seq").cast("long").alias("seq"), "op")
    return rows.groupBy("drawing").applyInPandasWithState(_history, HISTORY, STATE, "append", GroupStateTimeout.NoTimeout)


def standing(history: DataFrame) -> DataFrame:
    """(drawing, version, seq): the pushes that stand after a history, a table of history()'s rows: of each version up to the last one's depth, the last push. With version up to the drawing's own they are what it shows."""
    applied = history.where("applied")
    now = applied.groupBy("drawing").agg(F.max_by(F.struct("version", "depth"), "seq").alias("_now"))
    pushes = applied.where("op = 'push'").groupBy("drawing", "version").agg(F.max("seq").alias("seq"))
    return pushes.join(now, "drawing").where("version <= _now.depth").select("drawing", "version", "seq", (F.col("version") <= F.col("_now.version")).alias("shown"))
