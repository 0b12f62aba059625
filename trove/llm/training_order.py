"""Training-order materialisation: a keyed permutation gives every sequence a slot, and shards of fixed stride hold the slots in order.

Documents are tokenised and cut into sequences of ``stride`` ids, numbered through by block counts.  A Feistel network with
cycle-walking permutes these numbers; its inverse leads from a slot back to its sequence.  Range partitions of the slots
write one file per shard, every row of the same size, so a reader finds slot n at byte (n mod rows) * row size and can
resume anywhere.  Files become final by a rename; a repeated attempt rewrites the same bytes.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trove.llm.vocabularies import ids as encode
from trove.llm.vocabularies import width
from trove.plans.scratch import discard, materialise, scratch_path

STRIDE = 2048
END_ID = 50256
SHARD_ROWS = 2048
ROUNDS = 6
#: Compression of a sequence on its way to its shard.
EXCHANGE_LEVEL = 6
#: Partitions that write shards at most; each then writes a run of neighbouring shards.
MOST_WRITERS = 16_384


def id_type(size: int) -> np.dtype:
    """Little-endian ids of 2 or 4 bytes; the largest number fills the last sequence of a block and is no id."""
    return np.dtype(f"<u{size}")


def fill(size: int) -> int:
    return 256**size - 1


def _round(half: np.ndarray, key: int, number: int, mask: np.uint64) -> np.ndarray:
    h = half + np.uint64((key * 0x9E3779B97F4A7C15 + number * 0xD1B54A32D192ED03) % 2**64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (h ^ (h >> np.uint64(31))) & mask


def permute(numbers: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """Keyed permutation of 0..n-1 (or its inverse): Feistel rounds on two halves, walked until the value is below n."""
    half = max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    out = numbers.astype(np.uint64)
    todo = np.arange(len(out))
    order = range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS)
    while len(todo):
        left, right = out[todo] >> shift, out[todo] & mask
        for r in order:
            if inverse:
                left, right = right ^ _round(left, key, r, mask), left
            else:
                left, right = right, left ^ _round(right, key, r, mask)
        out[todo] = left << shift | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def sequences(docs: DataFrame, json_file: str, rank_file: str, id_col: str = "doc_id", text_col: str = "text", stride: int = STRIDE) -> DataFrame:
    """(block, place, n_tokens, doc_ids, ids): all documents of each block end to end, each closed by ``END_ID``.

    ids is ``stride`` little-endian unsigned numbers, of two bytes each if the vocabulary allows, else four.  Null texts are
    empty; null ids stand as null in doc_ids.
    """
    size_of = width(json_file, END_ID)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, place = TaskContext.get().partitionId(), 0
        tail = np.array([END_ID], dtype="<u4")
        held: list[tuple[object, np.ndarray]] = []
        size = 0

        def cut(last: bool) -> pa.RecordBatch | None:
            nonlocal held, size, place
            if not held:
                return None
            ids = np.concatenate([h[1] for h in held])
            bounds = np.concatenate(([0], np.cumsum([len(h[1]) for h in held])))
            rows = -(-size // stride) if last else size // stride
            if not rows:
                return None
            used = min(rows * stride, size)
            grid = np.full(rows * stride, fill(size_of), dtype=id_type(size_of))
            grid[:used] = ids[:used]
            first = np.searchsorted(bounds, np.arange(rows) * stride, side="right") - 1
            final = np.searchsorted(bounds, np.minimum(np.arange(1, rows + 1) * stride, size) - 1, side="right") - 1
            lists = [[held[k][0] for k in range(i, j + 1)] for i, j in zip(first.tolist(), final.tolist(), strict=True)]
            counts = np.minimum(stride, size - np.arange(rows) * stride)
            out = pa.RecordBatch.from_pydict({
                "block": pa.array(np.full(rows, block), pa.int64()), "place": pa.array(np.arange(place, place + rows), pa.int64()), "n_tokens": pa.array(counts, pa.int64()),
                "doc_ids": pa.array(lists, pa.list_(pa.int64())), "ids": pa.array([r.tobytes() for r in grid.reshape(rows, stride)], pa.binary()),
            })
            keep = int(np.searchsorted(bounds, used, side="right") - 1)
            held = [(held[k][0], ids[max(used, bounds[k]) : bounds[k + 1]]) for k in range(keep, len(held)) if bounds[k + 1] > used]
            size -= used
            place += rows
            return out

        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                held.append((key.as_py(), np.concatenate((encode(text.as_py(), json_file, rank_file), tail))))
                size += len(held[-1][1])
                if size >= 64 * stride and (rows := cut(last=False)) is not None:
                    yield rows
        if (rows := cut(last=True)) is not None:
            yield rows

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(work, "block long, place long, n_tokens long, doc_ids array<long>, ids binary")


def numbered(cut: DataFrame) -> tuple[DataFrame, int]:
    """Add ``sequence``, a number from 0 on without gaps (blocks in order), and give the count.

    One count a block reaches the driver; blocks are tasks, so their number is bounded by the plan and not by the rows.
    """
    counts = cut.groupBy("block").agg(F.count(F.lit(1)).alias("n")).orderBy("block").collect()
    starts = np.concatenate(([0], np.cumsum([r.n for r in counts]))).tolist()
    offsets = cut.sparkSession.createDataFrame([(r.block, s) for r, s in zip(counts, starts, strict=False)], "block long, before long")
    return cut.join(F.broadcast(offsets), "block").withColumn("sequence", F.col("before") + F.col("place")), starts[-1]


def with_slots(rows: DataFrame, n: int, key: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Add slot and shard to numbered rows and compress their ids for the exchange."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=EXCHANGE_LEVEL)
        for batch in batches:
            slots = permute(batch.column(0).to_numpy(zero_copy_only=False), n, key)
            ids = pa.array([pack.compress(row.as_buffer()) for row in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(slots), pa.array(slots // shard_rows), ids], ["sequence", "slot", "shard", "ids"])

    return rows.select("sequence", "ids").mapInArrow(work, "sequence long, slot long, shard long, ids binary")


def write_shards(slotted: DataFrame, n: int, folder: str, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Write the shards; one row each: shard, path, first_slot, rows, crc32.  A missing or repeated slot fails the job.

    The ranges of slots are known, so rows go straight to their partition and nothing is sampled for bounds.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        files, place = FileSystem.from_uri(folder)
        files.create_dir(place, recursive=True)
        unpack = zstandard.ZstdDecompressor()
        out, shard, rows, crc, draft = None, -1, 0, 0, ""

        def close() -> pa.RecordBatch:
            out.close()
            path = f"/shard-{shard:08d}.bin"
            files.move(draft, place + path)
            if rows != min(shard_rows, n - shard * shard_rows):
                raise ValueError(f"shard {shard} has {rows} rows")
            return pa.RecordBatch.from_pydict({"shard": [shard], "path": [path], "first_slot": [shard * shard_rows], "rows": [rows], "crc32": [crc]})

        for batch in batches:
            for slot, number, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if number != shard:
                    if out is not None:
                        yield close()
                    shard, rows, crc, draft = number, 0, 0, f"{place}/.{uuid.uuid4().hex}"
                    out = files.open_output_stream(draft, compression=None)
                if slot != shard * shard_rows + rows:
                    raise ValueError(f"slot {slot} stands at place {rows} of shard {shard}")
                data = unpack.decompress(ids.as_buffer())
                out.write(data)
                rows, crc = rows + 1, zlib.crc32(data, crc)
        if out is not None:
            yield close()

    shards = max(1, -(-n // shard_rows))
    writers = min(shards, MOST_WRITERS)
    ordered = slotted.select("slot", "shard", "ids").repartitionById(writers, F.expr(f"int(shard * {writers} div {shards})")).sortWithinPartitions("slot")
    return materialise(ordered.mapInArrow(work, "shard long, path string, first_slot long, rows long, crc32 long"), "shards")


def read_shards(manifest: DataFrame, folder: str, n: int, key: int, from_slot: int = 0, stride: int = STRIDE, with_ids: bool = False, size_of: int = 2) -> DataFrame:
    """Rows from a slot on: slot, sequence, shard, place, n_tokens, ids_crc32 (and ids); each shard is read sequentially.

    size_of: bytes of an id.  A resumed read starts at the byte of its first slot; a shard that is read whole must have the
    manifest's checksum.
    """
    names = ["slot", "sequence", "shard", "place", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    size = stride * size_of

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        files, place = FileSystem.from_uri(folder)
        for batch in batches:
            for shard, path, first, rows, crc in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                skip, seen = max(0, from_slot - first), 0
                with files.open_input_file(place + path) as file:
                    file.seek(skip * size)
                    at = skip
                    while at < rows:
                        take = min(512, rows - at)
                        data = file.read(take * size)
                        if len(data) != take * size:
                            raise ValueError(f"{path} ends early")
                        seen = zlib.crc32(data, seen)
                        grid = np.frombuffer(data, dtype=id_type(size_of)).reshape(take, stride)
                        slots = np.arange(first + at, first + at + take)
                        columns = [pa.array(slots), pa.array(permute(slots, n, key, inverse=True)), pa.array(np.full(take, shard)), pa.array(np.arange(at, at + take)), pa.array((grid != fill(size_of)).sum(axis=1)), pa.array([zlib.crc32(data[i * size : (i + 1) * size]) for i in range(take)], pa.int64())]
                        if with_ids:
                            columns.append(pa.array([r.tobytes() for r in grid], pa.binary()))
                        yield pa.RecordBatch.from_arrays(columns, names)
                        at += take
                if not skip and seen != crc:
                    raise ValueError(f"checksum of {path}")

    wanted = manifest.where(F.col("first_slot") + F.col("rows") > from_slot).select("shard", "path", "first_slot", "rows", "crc32")
    spread = wanted.repartition(max(1, min(manifest.count(), 10_000)), "shard")
    return spread.mapInArrow(work, "slot long, sequence long, shard long, place long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def training_order(docs: DataFrame, json_file: str, rank_file: str, key: int = 1, folder: str | None = None, stride: int = STRIDE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Materialise and read back: slot, sequence, shard, place, n_tokens, ids_crc32, doc_ids (the documents in the sequence).

    Null or empty texts add the end id alone; long texts span sequences; repeated rows count as often as they stand; no
    rows give no shard and no result; other columns are ignored.
    """
    folder = folder or scratch_path(docs.sparkSession, "shards")
    cut = materialise(sequences(docs, json_file, rank_file, stride=stride), "sequences")
    rows, n = numbered(cut)
    manifest = write_shards(with_slots(rows, n, key, shard_rows), n, folder, shard_rows)
    members = materialise(rows.select("sequence", "doc_ids"), "sequence-docs")
    discard(cut)
    back = read_shards(manifest, folder, n, key, stride=stride, size_of=width(json_file, END_ID))
    # the planner takes what is read back for as small as the manifest; both sides grow with the input and are merged
    return back.join(members.hint("merge"), "sequence")
