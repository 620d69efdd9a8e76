"""Streaming forms of keyed, time-ordered operators. Their results are those of the batch forms on the same rows, as far as rows aren't late."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def streaming_turns(units: DataFrame, merge_gap: int, watermark: str = "1 hour") -> DataFrame:
    """Turns of a stream of units (source, id, start, end in ms, speaker, ts), as operators.turns.turns makes them of a table.

    A turn is put out when the next one of its source begins, or when the watermark has passed its end by merge_gap. Units within a
    batch are put in order; one that comes in a later batch than its successors counts where it comes.
    """
    kind = units.schema["source"].dataType.simpleString()

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done = []
        current = list(state.get) if state.exists else None
        if state.hasTimedOut:
            if current:
                done.append(current)
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values(["start", "end", "id"])
            for r in rows.itertuples(index=False):
                if current and current[0] == r.speaker and r.start - current[2] <= merge_gap:
                    current = [current[0], current[1], max(current[2], int(r.end)), current[3] + 1]
                else:
                    if current:
                        done.append(current)
                    current = [r.speaker, int(r.start), int(r.end), 1]
            state.update(tuple(current))
            state.setTimeoutTimestamp(max(current[2] + merge_gap + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], *d) for d in done], columns=["source", "speaker", "start", "end", "units"])

    keyed = units.withWatermark("ts", watermark).groupBy("source")
    return keyed.applyInPandasWithState(run, f"source {kind}, speaker string, start long, end long, units long", "speaker string, start long, end long, units long", "append", GroupStateTimeout.EventTimeTimeout)


def streaming_cooldown(rows: DataFrame, least_gap: int, most: int | None = None, watermark: str = "1 hour") -> DataFrame:
    """Rows (source, id, at in ms, ts) that come least_gap or more after the last one taken of their source, `most` of them.

    Without `most` a source is forgotten once the watermark has passed its last taken row by least_gap, as any later row is taken then;
    with it the number taken is kept for good.
    """
    kind, id_kind = (rows.schema[c].dataType.simpleString() for c in ("source", "id"))

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        taken = []
        if state.hasTimedOut:
            state.remove()
        else:
            last, n = state.get if state.exists else (None, 0)
            for r in pd.concat(list(batches)).sort_values(["at", "id"]).itertuples(index=False):
                if (last is None or r.at - last >= least_gap) and (most is None or n < most):
                    taken.append((key[0], r.id, int(r.at)))
                    last, n = int(r.at), n + 1
            state.update((last, n))
            if most is None:
                state.setTimeoutTimestamp(max(last + least_gap, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(taken, columns=["source", "id", "at"])

    keyed = rows.withWatermark("ts", watermark).groupBy("source")
    timeout = GroupStateTimeout.EventTimeTimeout if most is None else GroupStateTimeout.NoTimeout
    return keyed.applyInPandasWithState(run, f"source {kind}, id {id_kind}, at long", "last long, n long", "append", timeout)


def upsert_stream(updates: DataFrame, path: str, keys: list[str], newest: str, checkpoint: str):
    """Starts a query that keeps a Parquet ledger of the newest row of each key. Each batch writes a new version below path; the last is the state.

    A batch that is run again writes its version again, so versions don't depend on how often it ran.
    """
    from chronoweft.operators.catalog import upsert

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = None
        if number > 0:
            before = spark.read.schema(batch.schema).parquet(f"{path}/version={number - 1}")
        only = upsert(batch.limit(0), batch, keys, newest)
        (only if before is None else upsert(before, only, keys, newest)).write.mode("overwrite").parquet(f"{path}/version={number}")

    return updates.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
