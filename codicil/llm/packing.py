"""Best-fit packing by planning over the length histogram.

Packing decides by lengths alone, so best fit runs over the counts of each length (at most `capacity`
of them) and plans slots: runs of like sequences that take so many pieces of a length at an offset.
The documents' pieces then take the planned slots by joining on their rank within their length.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codicil.llm.common import cut, documents
from codicil.llm.token_files import crc
from codicil.llm.tokens import BYTE_BPE, END_ID, encoder

CAPACITY = 1024
#: A length's ranks are counted in groups of about so many pieces.
GROUP_ROWS = 250_000
#: Beyond so many slot runs the plan is joined by a shuffle instead of a broadcast.
BROADCAST_RUNS = 500_000

_END = np.array([END_ID], "<u4").tobytes()


def token_pieces(docs: DataFrame, tokenizer: str = BYTE_BPE, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of each document's ids with the end id.

    Documents of more than `capacity` tokens are cut into pieces of `capacity`, of which the first takes
    the rest.  Null and empty texts are one piece of the end id alone.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * ids
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * ids

    def cut_up(batches):
        e = encoder(tokenizer)
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                all_ids = e.encode(text.as_py()) + _END
                n = len(all_ids) // 4
                ends = range(n % capacity or capacity, n + 1, capacity)
                for k, end in enumerate(ends):
                    start = max(0, end - capacity)
                    start = 0 if k == 0 else start
                    part = all_ids[4 * start : 4 * end]
                    rows.append((doc_id, k, start, end - start, crc(part)) + ((part,) if ids else ()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types], names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut_up, schema)


def plan_slots(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best fit, longest first, over counts: runs (length, first_rank, n, first_sequence, offset).

    Piece number first_rank + i of a length goes to sequence first_sequence + i at the offset.  Runs are as
    many as the different lengths and fillings need, whatever the counts are.
    """
    open_runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by room: (first sequence, how many)
    runs, sequences = [], 0
    for length in sorted(counts, reverse=True):
        left, room = counts[length], length

        def fill(first: int, many: int, each: int) -> None:
            for k in range(each):
                runs.append((length, counts[length] - left + k * many, many, first, capacity - room + k * length))  # noqa: B023
            open_runs[room - each * length].append((first, many))  # noqa: B023

        while left:
            while room <= capacity and not open_runs[room]:
                room += 1
            if room > capacity:  # none has room: new sequences, as many as the rest needs
                room, need = capacity, -(-left // (capacity // length))
                open_runs[capacity].append((sequences, need))
                sequences += need
            first, many = open_runs[room].pop()
            each = room // length
            if full := min(many, left // each):
                fill(first, full, each)
                first, many, left = first + full, many - full, left - full * each
            if many and left:  # fewer than one sequence holds
                fill(first, 1, left)
                first, many, left = first + 1, many - 1, 0
            if many:
                open_runs[room].append((first, many))
    return runs


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """pieces (doc_id, piece, length, ...) with sequence_id and offset.

    Lengths must be 1 to capacity; empty texts have come as pieces of their end id, very long ones as several.
    Equal rows, and others with one doc_id or none, take different slots.  An empty table gives no rows.  Rows are
    held in a struct meanwhile, so column names may be any; columns sequence_id and offset are replaced.
    A length's ranks are counted in groups by a hash of the row, and the groups' counts are summed up
    before, so that no task has to hold a length that very many pieces share.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    plan = plan_slots(counts, capacity)
    runs = spark.createDataFrame(plan, "of_length long, rank long, n long, sequence long, place long")
    if len(plan) <= BROADCAST_RUNS:
        runs = F.broadcast(runs)
    groups = max(8, math.ceil(max(counts.values(), default=0) / group_rows))
    dealt = pieces.select(F.struct(*pieces.columns).alias("row"), F.col("length").cast("long").alias("length"), "doc_id", "piece").withColumn("part", F.pmod(F.xxhash64("row"), F.lit(groups)))
    of_part = dealt.groupBy("length", "part").agg(F.count("*").alias("count"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    of_part = of_part.select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "part").orderBy("doc_id", "piece")
    ranked = dealt.withColumn("at", F.row_number().over(within) - 1).join(of_part, ["length", "part"]).withColumn("at", F.col("at") + F.col("before"))
    slots = ranked.join(runs, (F.col("length") == F.col("of_length")) & (F.col("at") >= F.col("rank")) & (F.col("at") < F.col("rank") + F.col("n")))
    columns = [F.col("row")[c].alias(c) for c in pieces.columns if c not in ("sequence_id", "offset")]
    return slots.select(*columns, (F.col("sequence") + F.col("at") - F.col("rank")).alias("sequence_id"), F.col("place").alias("offset"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(cut(token_pieces(documents(spark, sf_dir)), "pieces"))
