"""The status machine of nodes as a stream: changes of snapshots and dismissals by clients, applied in order of event time.

Both streams are united, each with its own watermark, and keyed by the bucket of a node's id: a call of the state function costs far more than a change,
so that it takes many nodes. What a node has received waits in its bucket's state until the watermark, the lesser of the two streams', has passed it, and
is then applied in order of time and sequence, however it came in. The rules are those of changes.node_diff
and changes.dismiss, one node at a time. State and output go on from the checkpoint after a restart.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: load: the node is in the first snapshot; put: it is in a new one with this hash; gone: it is no longer there; dismiss: a client has seen its status.
KINDS = ("load", "put", "gone", "dismiss")
STATUS = "id string, ts timestamp, seq long, status string, is_ghost boolean"
#: By id: changes that the watermark has not passed, and what the node is (here, hash, status, ghost, ghost_hash), as JSON.
STATE = "nodes string"
#: Buckets of ids; fixed, as the state of a checkpoint is kept by them.
BUCKETS = 8192


def apply_one(node: tuple, kind: str, new_hash: str | None) -> tuple:
    """(here, hash, status, ghost, ghost_hash) after one change."""
    here, old_hash, status, ghost, ghost_hash = node
    if kind == "load":
        return True, new_hash, status, ghost, ghost_hash
    if kind == "put":
        if ghost:
            status = None if new_hash == ghost_hash else "modified"
        elif not here and status is None:
            status = "added"
        elif here and new_hash != old_hash and status not in ("added", "deleted"):
            status = "modified"
        return True, new_hash, status, False, None
    if kind == "gone":
        return (False, None, "deleted", True, old_hash) if here else node
    return here, old_hash, None, False, None


def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Puts new changes of a bucket's nodes to those that wait, and applies all that the watermark has passed; a row for each that was applied."""
    nodes = json.loads(state.get[0]) if state.exists else {}
    if not state.hasTimedOut:
        for f in frames:
            for i, t, s, k, h in zip(f["id"], f["us"], f["seq"], f["kind"], f["hash"], strict=True):
                nodes.setdefault(i, [[], [False, None, None, False, None]])[0].append([int(t), int(s), k, h if isinstance(h, str) else None])
    passed = state.getCurrentWatermarkMs() * 1000
    out, first = [], None
    for i, own in nodes.items():
        waiting, node = own
        if not waiting:
            continue
        waiting.sort(key=lambda w: (w[0], w[1]))
        n = 0
        for us, seq, kind, new_hash in waiting:
            if us >= passed:
                break
            node = apply_one(tuple(node), kind, new_hash)
            out.append((i, us, seq, node[2], bool(node[3])))
            n += 1
        own[0], own[1] = waiting[n:], list(node)
        if own[0]:
            first = own[0][0][0] if first is None else min(first, own[0][0][0])
    state.update((json.dumps(nodes),))
    if first is not None:
        state.setTimeoutTimestamp(max(first // 1000 + 1, state.getCurrentWatermarkMs() + 1))
    if out:
        done = pd.DataFrame(out, columns=["id", "ts", "seq", "status", "is_ghost"])
        done["ts"] = pd.to_datetime(done["ts"], unit="us")
        yield done


def statuses(changes: DataFrame, controls: DataFrame, late: str = "1 hour") -> DataFrame:
    """(id, ts, seq, status, is_ghost): the status of a node after each change or dismissal, once the watermark has passed it.

    changes: a stream (id, ts, seq, kind, hash) of loads, puts and goings; controls: a stream (id, ts, seq) of dismissals. Rows later than `late` go, and so do
    rows with a null id or time. seq orders what happens at one time. A kind of another name dismisses nothing and raises.
    """
    wanted = changes.where(F.col("kind").isin("load", "put", "gone") | F.raise_error(F.concat(F.lit("unknown kind "), F.coalesce("kind", F.lit("null")))).isNotNull())
    seen = controls.select("id", "ts", "seq", F.lit("dismiss").alias("kind"), F.lit(None).cast("string").alias("hash"))
    both = wanted.select("id", "ts", "seq", "kind", "hash").withWatermark("ts", late).unionByName(seen.withWatermark("ts", late))
    rows = both.where("id is not null and ts is not null").withColumn("us", F.unix_micros("ts"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).cast("int"))
    return rows.groupBy("bucket").applyInPandasWithState(advance, STATUS, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def latest(history: DataFrame) -> DataFrame:
    """(id, status, is_ghost) of the nodes that have a status, from what statuses() gave so far."""
    last = history.groupBy("id").agg(F.max_by(F.struct("status", "is_ghost"), F.struct("ts", "seq")).alias("s"))
    return last.select("id", "s.status", "s.is_ghost").where("status is not null")


def run(changes: DataFrame, controls: DataFrame, folder: str, checkpoint: str, late: str = "1 hour") -> None:
    """Takes all that the sources have now; a later call goes on from the checkpoint."""
    query = statuses(changes, controls, late).writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
