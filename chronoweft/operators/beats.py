"""Edit plans bound to beats: where a programme is cut, so that parts end on beats and are neither too short nor too long. Times are whole milliseconds.

Cases: beats outside the programme and repeated ones don't count, null ones neither; a timeline without beats is cut by length alone. Timelines with a null or no
duration have no plan; of several durations the largest holds. Parts are shorter than `least` only where the whole programme is.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Beats of a part, and the least and greatest length of one, if nothing else is said.
BEATS_PER_CUT, LEAST, MOST = 4, 750, 3000


#: Runs of cuts that a worker holds before it hands them on, and cuts of one run.
RUNS_HELD, RUN_CUTS = 20_000, 1 << 16


def beat_runs(duration: int, beats: Sequence[int], beats_per_cut: int = BEATS_PER_CUT, least: int = LEAST, most: int = MOST) -> Iterator[tuple[int, int, int, int | None, str]]:
    """(time before, time, number of cuts, number of the beat or None, selected_by) of each run of cuts: from cut to cut the beat nearest to beats_per_cut beats on, of those that
    leave a part and the rest long enough and the part short enough; without one, a cut as late as may be. Cuts up to the next beat, each `most` after the one before, are one run."""
    grid, at = sorted({b for b in beats if 0 < b < duration}), 0
    while duration - at > most:
        first = bisect_right(grid, at)
        free = min(((grid[first] if first < len(grid) else duration) - at - 1) // most, RUN_CUTS)
        if free > 0:
            time = min(at + free * most, duration - least)
            yield at, time, free, None, "max_segment"
        else:
            low, high = bisect_left(grid, at + least), bisect_right(grid, min(at + most, duration - least))
            low = max(low, first)
            if low < high:
                target = min(first + beats_per_cut - 1, len(grid) - 1)
                chosen = min(range(low, high), key=lambda k: (abs(grid[k] - grid[target]), grid[k])) if not low <= target < high else target
                time = grid[chosen]
                yield at, time, 1, chosen + 1, "beats_per_cut" if chosen == target else "duration_guard"
            else:
                time = min(at + most, duration - least)
                yield at, time, 1, None, "max_segment"
        at = time
    yield at, duration, 1, None, None


def beat_cuts(duration: int, beats: Sequence[int], beats_per_cut: int = BEATS_PER_CUT, least: int = LEAST, most: int = MOST) -> list[tuple[int, int | None, str]]:
    """(time, number of the beat or None, selected_by) of each cut of beat_runs."""
    runs = [r for r in beat_runs(duration, beats, beats_per_cut, least, most) if r[4] is not None]
    return [(before + k * most if k < count else time, beat, how) for before, time, count, beat, how in runs for k in range(1, count + 1)]


def beat_plan(timelines: DataFrame, beats: DataFrame, by: Sequence[str], beats_per_cut: int = BEATS_PER_CUT, least: int = LEAST, most: int = MOST, duration: str = "duration", at: str = "at") -> DataFrame:
    """(by, number, start, end, alignment, beat, selected_by): the parts of each timeline of timelines (by, duration), cut on beats (by, at); the last ends with the programme.

    A timeline's beats are one list for one task: a piece of music has some thousands. They are made distinct before they are gathered. Python makes runs of cuts, as many as
    there are beats and not as the programme is long, and hands them on in pieces; Spark lays the cuts of a run out.
    """
    if beats_per_cut < 1 or least < 1 or most < least:
        raise ValueError("beats_per_cut and least must be positive, most not less than least")
    whole = timelines.groupBy(*by).agg(F.max(duration).cast("long").alias("__duration")).filter("__duration > 0")
    grid = beats.filter(F.col(at).isNotNull()).select(*by, F.col(at).cast("long").alias("__at")).distinct().groupBy(*by).agg(F.collect_list("__at").alias("__beats"))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in by]
    joined = whole.alias("a").join(grid.alias("b"), same, "left").select(*(F.col(f"a.{k}").alias(k) for k in by), "__duration", "__beats")
    # Plans are longer than what they are made from, so the tasks are not to be joined by its size.
    dealt = joined.repartition(int(joined.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)
    n_keys = len(by)
    found = pa.schema([("__duration", pa.int64()), ("__done", pa.int64()), ("__before", pa.int64()), ("__time", pa.int64()), ("__count", pa.int64()), ("__beat", pa.int32()), ("__how", pa.string())])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def piece(batch: pa.RecordBatch, places: list[int], rows: list[tuple]) -> pa.RecordBatch:
            keys = [batch.column(k).take(pa.array(places, pa.int64())) for k in range(n_keys)]
            values = [pa.array(column, field.type) for column, field in zip(zip(*rows, strict=True), found, strict=True)]
            return pa.RecordBatch.from_arrays([*keys, *values], names=[*batch.schema.names[:n_keys], *found.names])

        for batch in batches:
            places, rows = [], []
            for k in range(batch.num_rows):
                length, done = batch.column(n_keys)[k].as_py(), 0
                for before, time, count, beat, how in beat_runs(length, batch.column(n_keys + 1)[k].as_py() or [], beats_per_cut, least, most):
                    places.append(k)
                    rows.append((length, done, before, time, count, beat, how))
                    done += count
                    if len(rows) >= RUNS_HELD:
                        yield piece(batch, places, rows)
                        places, rows = [], []
            if rows:
                yield piece(batch, places, rows)

    keys = "".join(f"`{k}` {joined.schema[k].dataType.simpleString()}, " for k in by)
    each = dealt.mapInArrow(runs, f"{keys}__duration long, __done long, __before long, __time long, __count long, __beat int, __how string")
    each = each.withColumn("__k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__count") - 1)))
    step = F.col("__before") + F.col("__k") * most
    end = F.when(F.col("__count") > 1, F.least(step + most, F.col("__duration") - least)).otherwise(F.col("__time"))
    alignment = F.when(F.col("__how").isNull(), "program_end").when(F.col("__beat").isNull(), "duration_guard").otherwise("beat")
    return each.select(*by, (F.col("__done") + F.col("__k") + 1).cast("int").alias("number"), step.alias("start"), end.alias("end"), alignment.alias("alignment"), F.col("__beat").alias("beat"), F.col("__how").alias("selected_by"))
