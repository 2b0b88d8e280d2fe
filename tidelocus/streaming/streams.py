"""Streaming forms of the pile-up and of islands."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import schemas
from ..operators.coverage import offsets
from ..operators.reads import added

#: Chromosomes share a state by a digest of their names, so very many of them don't cost a call each; a few dozen have one each.
BUCKETS = 4096
_NEVER = np.iinfo(np.int64).min


def streaming_pileup(events: DataFrame, chromosomes: DataFrame, least: int = 2, delay: int = 0) -> DataFrame:
    """``schemas.CLIPS`` of a stream of clip events (chrom, clip_pos, side, mate_in_rep) sorted by chromosome and position.

    Event time is the place in the whole genome: the bases of the chromosomes before (by chrom_id, of the dictionary ``chromosomes``)
    and the position, so it rises from chromosome to chromosome under one watermark.  A position is final, and leaves in append mode, once
    one more than ``delay`` beyond it has come.  Later rows for it are dropped, as are events on unknown chromosomes.
    """
    table = F.broadcast(offsets(chromosomes).select("chrom", "start"))  # a few thousand rows at most
    timed = events.join(table, "chrom").withColumn("at", F.timestamp_seconds(F.col("start") + F.col("clip_pos"))).withWatermark("at", f"{delay} seconds")
    counts = timed.groupBy("chrom", "start", F.window("at", "1 second").alias("w")).agg(
        F.count_if(F.col("side") == "L").alias("left_count"), F.count_if(F.col("side") == "R").alias("right_count"), F.count_if("mate_in_rep").alias("mate_in_rep")
    )
    return counts.where(F.col("left_count") + F.col("right_count") >= least).select("chrom", (F.unix_seconds("w.start") - F.col("start")).alias("pos"), "left_count", "right_count", "mate_in_rep")


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Events of a batch by chromosome and position: counts, the least start and the greatest."""
    for batch in batches:
        table = pa.Table.from_batches([batch]).group_by(["chrom", "pos"], use_threads=False)
        out = table.aggregate([("l", "sum"), ("r", "sum"), ("m", "sum"), ("start", "min"), ("start", "max")])
        yield from out.select(["chrom", "pos", "l_sum", "r_sum", "m_sum", "start_min", "start_max"]).rename_columns(["chrom", "pos", "l", "r", "m", "low", "high"]).to_batches()


def _evicting(least: int):
    """A bucket's rows of a micro-batch and its state: its chromosomes, their furthest starts, and the counts from these on, as bytes."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, raw = state.get if state.exists else ("[[], []]", b"")
        names, reached = json.loads(known)
        number = {n: i for i, n in enumerate(names)}
        held = np.frombuffer(raw, np.int64).reshape(-1, 5)  # chromosome's number, position, counts
        before = far = np.array(reached, np.int64)
        for frame in frames:
            codes, own = pd.factorize(frame["chrom"])
            new = [n for n in own if n not in number]
            number |= {n: len(names) + i for i, n in enumerate(new)}
            names += new
            before, far = (np.append(x, np.full(len(new), _NEVER)) for x in (before, far))
            at = np.array([number[n] for n in own], np.int64)[codes]
            low = frame["low"].to_numpy(np.int64)
            early = np.flatnonzero(low < before[at])
            if len(early):
                k = early[0]
                raise ValueError(f"events aren't sorted: start {low[k]} on chromosome {names[at[k]]} comes after start {before[at[k]]} of an earlier batch")
            np.maximum.at(far, at, frame["high"].to_numpy(np.int64))
            placed = frame["pos"].notna().to_numpy()
            counts = frame.loc[placed, ["pos", "l", "r", "m"]].to_numpy(np.int64)
            held = added(np.concatenate([held, np.column_stack([at[placed], counts])]))
        final = held[:, 1] < far[held[:, 0]]
        gone, held = held[final], held[~final]
        state.update((json.dumps([names, far.tolist()]), held.tobytes()))
        gone = gone[gone[:, 2] + gone[:, 3] >= least]
        out = pd.DataFrame({"chrom": np.array(names, object)[gone[:, 0]]})
        for k, name in enumerate(("pos", "left_count", "right_count", "mate_in_rep"), 1):
            out[name] = gone[:, k]
        yield out

    return run


def ordered_pileup(events: DataFrame, least: int = 2, start: str = "pos", pos: str = "clip_pos") -> DataFrame:
    """``schemas.CLIPS`` of a stream of clip events whose read starts never go back, on a chromosome, from one micro-batch to the next.

    An event doesn't lie before its read's start, so once a batch has come the positions before the chromosome's furthest start are
    final: they leave, each once, and the others stay as its state.  There is no watermark: a start before those of an earlier batch
    is an error that ends the query.  Within a batch rows may come in any order.  A row without a position moves the start alone
    (``closing`` makes those that end chromosomes).  Tasks add up their events first, so what a chromosome's task gets are
    thin rows of counts; its state is as large as the reads around one place.  ``BUCKETS`` states hold all chromosomes.
    """
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("long")
    thin = events.where(F.col("chrom").isNotNull() & F.col(start).isNotNull()).select(
        "chrom", F.col(start).cast("long").alias("start"), F.col(pos).cast("long").alias("pos"), flag(F.col("side") == "L").alias("l"), flag(F.col("side") == "R").alias("r"), flag(F.col("mate_in_rep")).alias("m")
    )
    counted = thin.mapInArrow(_summed, "chrom string, pos long, l long, r long, m long, low long, high long")
    dealt = counted.withColumn("bucket", F.pmod(F.xxhash64("chrom"), F.lit(BUCKETS)))
    return dealt.groupBy("bucket").applyInPandasWithState(_evicting(least), schemas.CLIPS, "known string, held binary", "append", GroupStateTimeout.NoTimeout)


def closing(chromosomes: DataFrame, events: DataFrame, start: str = "pos") -> DataFrame:
    """A row for each chromosome, in the columns of ``events``, that begins beyond it: all its positions are final."""
    own = {"chrom": F.col("chrom"), start: F.col("length") + 2}
    return chromosomes.select(*[own.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema])


def streaming_islands(rows: DataFrame, key: str, time: str, gap: str, delay: str) -> DataFrame:
    """(key, first, last_plus_gap, n): sessions of a stream, closed when the watermark passes their end."""
    sessions = rows.withWatermark(time, delay).groupBy(key, F.session_window(time, gap).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return sessions.select(key, F.col("s.start").alias("first"), F.col("s.end").alias("last_plus_gap"), "n")
