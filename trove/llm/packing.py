"""Order-preserving packing by dynamic programming over cut positions.

Documents are range-partitioned and sorted by id, tokenised, and laid end to end.  Sequences are the stretches between
chosen cuts, at most ``capacity`` tokens apart.  A cut costs nothing between documents, a little at a sentence end, and
more inside a sentence; a sequence costs its padding.  The least total cost is found in one pass: the best previous cut
of every position is the head of a monotone queue over the window of reachable ones.  The pass runs over a rolling buffer
of ``HORIZON`` sequences, of which all but the last few are fixed each time, so memory does not grow with the partition.
A sequence whose length is a power of two needs no padding: the remainder at a partition's end is cut into such.
"""

from __future__ import annotations

import functools
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trove.llm.vocabularies import ids, rank_encoding

CAPACITY = 2048
END_ID = 1
#: Costs in tokens of padding.
SENTENCE_CUT, HARD_CUT = 2, 24
#: Every so many tokens a cut inside a sentence is allowed.
GRID = 64
HORIZON, UNFIXED = 256, 8
#: Pieces handed back at a time.
BATCH_PIECES = 1000
#: Sequence ids: the partition above, its running number below.
LOCAL_BITS = 40


@functools.cache
def sentence_ends(rank_file: str) -> np.ndarray:
    """Whether a token ends a sentence or a line, by id."""
    ranks = rank_encoding(rank_file)
    out = np.zeros(ranks.n_vocab + 1, dtype=bool)
    for i in range(ranks.n_vocab):
        token = ranks.decode_single_token_bytes(i)
        out[i] = token.rstrip(b"\"')").endswith((b".", b"!", b"?")) or b"\n" in token
    return out


def best_cuts(places: list[int], costs: list[int], capacity: int) -> list[int]:
    """Indexes of the chosen places, first and last included, at most ``capacity`` apart, at least total cost.

    places ascend from 0, no two neighbours further apart than ``capacity``; costs[j] is that of a cut at places[j].
    """
    total = [0] * len(places)
    back = [0] * len(places)
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # (total + place, index), ascending in both
    for j in range(1, len(places)):
        at = places[j]
        while places[queue[0][1]] < at - capacity:
            queue.popleft()
        key, i = queue[0]
        back[j] = i
        total[j] = cost = key + capacity - at + costs[j]
        key = cost + at
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    chain = [len(places) - 1]
    while chain[-1]:
        chain.append(back[chain[-1]])
    return chain[::-1]


def powers(length: int) -> list[int]:
    """The powers of two that make up a length, largest first."""
    return [1 << k for k in range(length.bit_length() - 1, -1, -1) if length >> k & 1]


class Packer:
    """Packs a stream of documents; pieces come out as soon as their sequence is fixed."""

    def __init__(self, capacity: int, ends: np.ndarray, base: int):
        self.capacity, self.ends, self.next_id = capacity, ends, base
        self.ids: list[np.ndarray] = []  # of buffered documents, what is left of them
        self.docs: list[list] = []  # [key, start of what is left, tokens in all]
        self.size = 0
        self.out: list[tuple] = []

    def add(self, key: object, ids: np.ndarray) -> None:
        self.ids.append(ids)
        self.docs.append([key, 0, len(ids)])
        self.size += len(ids)
        if self.size >= HORIZON * self.capacity:
            self.fix(last=False)

    def fix(self, last: bool) -> None:
        """Choose cuts for the buffer and emit the sequences up to the last few (or all)."""
        if not self.size:
            return
        ids = np.concatenate(self.ids)
        bounds = np.cumsum([len(a) for a in self.ids])
        cost = np.full(len(ids) + 1, -1, dtype=np.int64)
        cost[:: min(GRID, self.capacity)] = HARD_CUT
        cost[1:][self.ends[np.minimum(ids, len(self.ends) - 1)]] = SENTENCE_CUT
        cost[bounds] = 0
        cost[0] = 0
        places = np.flatnonzero(cost >= 0)
        chosen = places[best_cuts(places.tolist(), cost[places].tolist(), self.capacity)].tolist()
        if last:
            begin = chosen[-2] if len(chosen) > 1 else 0
            rest = powers(chosen[-1] - begin)
            if (len(rest) - 1) * HARD_CUT < self.capacity - sum(rest) and len(rest) > 1:
                chosen = chosen[:-1] + (begin + np.cumsum(rest)).tolist()
        else:
            chosen = chosen[: max(2, len(chosen) - UNFIXED)]
        self.emit(ids, bounds, chosen)

    def emit(self, ids: np.ndarray, bounds: np.ndarray, chosen: list[int]) -> None:
        doc, begin = 0, 0  # the document at the place reached, and where its rest begins
        for low, high in zip(chosen[:-1], chosen[1:], strict=True):
            at = low
            while at < high:
                end = int(bounds[doc])
                stop = min(end, high)
                key, start, tokens = self.docs[doc]
                self.out.append((key, start + at - begin, stop - at, ids[at:stop], tokens, self.next_id, at - low))
                at = stop
                if stop == end:
                    doc, begin = doc + 1, end
            self.next_id += 1
        done = chosen[-1]
        self.ids, self.docs = self.ids[doc:], self.docs[doc:]
        if self.ids and done > begin:
            self.ids[0] = self.ids[0][done - begin :]
            self.docs[0][1] += done - begin
        self.size = len(ids) - done

    def take(self) -> list[tuple]:
        found, self.out = self.out, []
        return found


def pack(docs: DataFrame, json_file: str, rank_file: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if asked for.

    A document is its ids and ``end_id``; a null or empty text is that id alone.  Each id of a document lies in one
    piece; pieces and sequences follow the order of the document ids, and of a hash of the texts where many rows share an
    id (or have none).  Long texts are cut as often as needed.  Repeated rows are packed as often as they stand; other columns are ignored; no rows give none.
    """
    field = docs.schema[id_col]
    kind = field.dataType.simpleString()
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def batch_of(pieces: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
        key, start, length, parts, tokens, sequence, offset = zip(*pieces, strict=True)
        crc = [zlib.crc32(a.astype("<u4", copy=False).tobytes()) for a in parts]
        columns = [pa.array(key, id_type), *[pa.array(c, pa.int64()) for c in (start, length, crc, tokens, sequence, offset)]]
        if with_ids:
            ends = np.concatenate(([0], np.cumsum(length))).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(ends, np.concatenate(parts).astype(np.int32)))
        return pa.RecordBatch.from_arrays(columns, names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(capacity, sentence_ends(rank_file), TaskContext.get().partitionId() << LOCAL_BITS)
        tail, id_type = np.array([end_id], dtype="<u4"), None
        for batch in batches:
            id_type = batch.schema.field(0).type
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                packer.add(key.as_py(), np.concatenate((ids(text.as_py(), json_file, rank_file), tail)))
                if len(packer.out) >= BATCH_PIECES:
                    yield batch_of(packer.take(), id_type)
        packer.fix(last=True)
        if packer.out:
            yield batch_of(packer.take(), id_type)

    tie = F.xxhash64(text_col).alias("tie")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), tie).repartitionByRange("id", "tie").sortWithinPartitions("id", "tie", "text").drop("tie")
    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return rows.mapInArrow(work, schema).withColumnRenamed("id", id_col)
