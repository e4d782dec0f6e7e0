"""Mixture-controlled packing: deficit round-robin over source queues.

Every source is a queue of documents.  In each window of tokens a queue's credit grows by its share of the window; while it
has credit it sends whole documents, and a document that goes beyond the credit leaves a debt that later windows pay.  So the
document whose queue has sent ``c`` tokens before it leaves in window ``floor(c / quantum)``: the debts carried over all
windows are in ``c`` itself, and those carried over partitions are the sums of what earlier partitions hold of the queue.
That makes the round-robin a sum over a small table of partition totals instead of one long loop.  Within a window the
queues alternate as well: documents stand in the order of ``c / quantum``, the round in which a queue's turn comes.

Windows follow each other without gaps in blocks; a block is cut into sequences, so only its last sequence is padded.

Defined results: a null text is an empty one (its only id is the separator); null sources are one queue, apart from empty
ones; repeated rows are packed each; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import written
from ._words import slices
from .tokens import encoder

LENGTH = 1024
#: Tokens in a window of the mixture, and windows in a block.
WINDOW = 64 * LENGTH
WINDOWS = 16
#: Blocks that a task packs, about 2 to 4 MB each.
TASK_BLOCKS = 2
SEPARATOR = 0


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def tokenized(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, queue, part, row, before (ids of the queue earlier in this part), n_ids and ids (little-endian, 2 or 4 bytes)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = vocabulary or default_vocabulary()
        code = encoder(path)
        part_id, row, sent = TaskContext.get().partitionId(), 0, {}
        for batch in batches:
            for part, data, at in slices(batch, "text"):
                ids, offsets = code.encode(data, at)
                queues = part.column(part.schema.get_field_index("queue")).to_pylist()
                before, blobs = [], []
                raw, size = np.ascontiguousarray(ids).tobytes(), code.dtype.itemsize
                end = SEPARATOR.to_bytes(size, "little")
                for i, queue in enumerate(queues):
                    before.append(sent.get(queue, 0))
                    sent[queue] = before[-1] + int(offsets[i + 1] - offsets[i]) + 1
                    blobs.append(raw[offsets[i] * size : offsets[i + 1] * size] + end)
                n = part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [part.column(part.schema.get_field_index("doc_id")), part.column(part.schema.get_field_index("queue")), pa.array(np.full(n, part_id), pa.int32()), pa.array(np.arange(row, row + n), pa.int64()), pa.array(before, pa.int64()), pa.array(np.diff(offsets) + 1, pa.int64()), pa.array(np.full(n, size), pa.int32()), pa.array(blobs, pa.binary())],
                    ["doc_id", "queue", "part", "row", "before", "n_ids", "id_bytes", "ids"],
                )
                row += n

    kind = documents.schema["doc_id"].dataType.simpleString()
    queued = documents.select("doc_id", "text", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("queue"))
    return queued.mapInArrow(encode, f"doc_id {kind}, queue string, part int, row bigint, before bigint, n_ids bigint, id_bytes int, ids binary")


def schedule(tokens: DataFrame, shares: dict[str, float] | None = None, window: int = WINDOW) -> DataFrame:
    """``tokens`` plus ``round``, where in the rounds each document's turn comes, and ``window``, its whole part.

    ``shares``: the target proportion of each source (of those not named: none is held back, they share what the named
    leave by size).  By default every source has its share of the corpus, so that all queues run dry together.
    """
    totals = tokens.groupBy("queue", "part").agg(F.sum("n_ids").alias("n"))
    sums = totals.groupBy("queue").agg(F.sum("n").alias("all"))
    whole = sums.agg(F.sum("all").alias("corpus"))
    if shares:
        named = F.create_map(*[F.lit(x) for source, share in shares.items() for x in ("=" + source, share)])
        left = max(0.0, 1.0 - sum(shares.values()))
        share = F.coalesce(named[F.col("queue")], F.col("all") / F.col("corpus") * left)
    else:
        share = F.col("all") / F.col("corpus")
    quanta = sums.join(F.broadcast(whole)).select("queue", F.greatest(share * window, F.lit(1.0)).alias("quantum"))
    earlier = totals.withColumn("earlier", F.expr("sum(n) over (partition by queue order by part rows between unbounded preceding and current row) - n"))
    credit = written(earlier.join(quanta, "queue").select("queue", "part", "earlier", "quantum"), "credit")
    placed = tokens.join(credit, ["queue", "part"])
    turn = (F.col("earlier") + F.col("before")) / F.col("quantum")
    return placed.withColumns({"round": turn, "window": F.floor(turn).cast("long")}).drop("earlier", "quantum")


def pack(scheduled: DataFrame, blocks: int, length: int = LENGTH, windows: int = WINDOWS, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and queue, window; the ids if asked).

    ``blocks``: about how many blocks there are, from which follows the number of tasks.
    """

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, used = None, 0
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "queue", "window", "ids"]
        for batch in batches:
            get = {n: batch.column(batch.schema.get_field_index(n)) for n in batch.schema.names}
            of_block, sizes, counts = (get[n].to_pylist() for n in ("block", "id_bytes", "n_ids"))
            row, start, size, crc, sequence, offset, ids = [], [], [], [], [], [], []
            for i in range(batch.num_rows):
                if of_block[i] != block:
                    block, used = of_block[i], 0
                own = np.frombuffer(get["ids"][i].as_buffer(), dtype=f"<u{sizes[i]}").astype("<u4")
                done, raw = 0, own.tobytes()
                while done < counts[i]:
                    n = min(counts[i] - done, length - used % length)
                    row.append(i)
                    start.append(done)
                    size.append(n)
                    bits = raw[4 * done : 4 * (done + n)]
                    crc.append(zlib.crc32(bits))
                    sequence.append((block << 24) + used // length)
                    offset.append(used % length)
                    ids.append(bits if keep_ids else None)
                    done += n
                    used += n
            of = pa.array(row, pa.int64())
            long = lambda x: pa.array(x, pa.int64())
            columns = [get["doc_id"].take(of), long(start), long(size), long(crc), get["n_ids"].take(of), long(sequence), long(offset), get["queue"].take(of), get["window"].take(of), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns[: None if keep_ids else -1], names[: None if keep_ids else -1])

    kind = scheduled.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, queue string, window bigint" + ", ids binary" * keep_ids
    dealt = scheduled.withColumn("block", F.floor(F.col("window") / windows).cast("long")).repartition(max(1, -(-blocks // TASK_BLOCKS)), "block")
    packed_ = dealt.sortWithinPartitions("block", "round", "queue", "part", "row").mapInArrow(fill, schema)
    return packed_.withColumn("queue", F.expr("if(queue = '', null, substring(queue, 2))"))


def packed(documents: DataFrame, shares: dict[str, float] | None = None, vocabulary: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Tokenize, schedule and pack whole documents.  The tokenized table is written once; its ids are shuffled once."""
    tokens = written(tokenized(documents, vocabulary), "tokens")
    size = tokens.agg(F.sum("n_ids")).first()[0] or 0
    return pack(schedule(tokens, shares), -(-size // (WINDOW * WINDOWS)), keep_ids=keep_ids)


def op8(documents: DataFrame) -> DataFrame:
    """The contract's columns, then the queue and the window of the mixture."""
    return packed(documents)
