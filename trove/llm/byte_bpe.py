"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Texts of a batch become one array of code points.  Class arrays give every code point a symbol: letter, number, blank,
other white space, other, and an apostrophe that a contraction follows; the last character of a white-space run is told
from the others.  The pattern is then a finite automaton over eight states.  Its transition functions compose
associatively, so the scan runs over all rows of a block matrix at once: columns compose the functions of each row, the
row totals are scanned the same way, and a last pass over the columns turns incoming states into token starts.  The
slices between starts feed pair merging, whose results are cached; their offsets are kept, and decoding gathers the
bytes of all ids through an offset table.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trove.llm.codepoints import LETTER, NUMBER, SPACE, classes, decode
from trove.llm.vocabularies import by_size

#: Distinct pre-tokens that a task holds (about 10 MB); frequent ones return at once after it was emptied.
CACHED_TOKENS = 50_000

# Symbols.  BLANK and WHITE are the last of their white-space run before other text; INNER is any other white space.
L, N, O, BLANK, WHITE, INNER, QUOTE2, QUOTE3 = range(8)
# States: what the token that holds the last character is.
FRESH, IN_L, IN_N, IN_O, IN_WHITE, AFTER_BLANK, LEFT1, LEFT2 = range(8)
SYMBOLS, STATES = 8, 8
#: Added to a symbol at the first character of a text: the automaton starts anew.
RESTART = 8
#: No pair: above every rank.
NONE = 1 << 40
#: Bytes from which a pre-token is merged by itself.
LONG_PIECE = 64
#: Second characters of two-letter contractions, and the three-letter ones.
SHORT = "stmd"
LONG = ("re", "ve", "ll")


@functools.cache
def automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, starts a token) by symbol and state."""
    to = np.zeros((2 * RESTART, STATES), dtype=np.uint8)
    start = np.zeros((2 * RESTART, STATES), dtype=bool)
    run = {L: IN_L, N: IN_N, O: IN_O}
    for state in range(STATES):
        for symbol in range(SYMBOLS):
            if state in (LEFT1, LEFT2):  # the next one or two characters belong to a contraction
                to[symbol, state] = LEFT1 if state == LEFT2 else FRESH
            elif symbol in (QUOTE2, QUOTE3):
                if state in (IN_O, AFTER_BLANK):  # inside a run of others, or joined to a blank: no contraction
                    to[symbol, state], start[symbol, state] = IN_O, False
                else:
                    to[symbol, state], start[symbol, state] = (LEFT1 if symbol == QUOTE2 else LEFT2), True
            elif symbol in run:
                to[symbol, state] = run[symbol]
                start[symbol, state] = state not in (run[symbol], AFTER_BLANK)
            elif symbol == INNER:
                to[symbol, state], start[symbol, state] = IN_WHITE, state != IN_WHITE
            elif symbol == BLANK:  # joins what follows
                to[symbol, state], start[symbol, state] = AFTER_BLANK, True
            else:  # the last white space of a run, not a blank: alone
                to[symbol, state], start[symbol, state] = FRESH, True
    to[RESTART:] = to[:RESTART, FRESH][:, None]
    start[RESTART:] = True
    return to, start


def symbols(cps: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Symbol of every code point of texts laid end to end; ``starts`` are the places where texts begin."""
    kind = classes()[cps]
    first = np.zeros(len(cps) + 1, dtype=bool)
    first[starts] = True
    first[len(cps)] = True
    out = np.full(len(cps), O, dtype=np.uint8)
    out[kind == LETTER] = L
    out[kind == NUMBER] = N
    white = kind == SPACE
    joined = np.append(white[1:], False)  # the next character is white space too
    last = white & ~joined & ~first[1:]
    out[white] = INNER
    out[last] = WHITE
    out[last & (cps == 32)] = BLANK
    quotes = np.flatnonzero(cps == 39)
    if len(quotes):
        padded = np.append(cps, [0, 0])
        ends = np.append(first, True)
        one, two = padded[quotes + 1], padded[quotes + 2]
        in_text1 = ~ends[quotes + 1]
        in_text2 = in_text1 & ~ends[np.minimum(quotes + 2, len(ends) - 1)]
        short = in_text1 & np.isin(one, [ord(c) for c in SHORT])
        long_ = np.zeros(len(quotes), dtype=bool)
        for pair in LONG:
            long_ |= in_text2 & (one == ord(pair[0])) & (two == ord(pair[1]))
        out[quotes[short]] = QUOTE2
        out[quotes[long_]] = QUOTE3
    out[starts[starts < len(cps)]] += RESTART
    return out


def _scan(functions: np.ndarray) -> np.ndarray:
    """States before each of a sequence of transition functions (rows of next states), from FRESH on, by doubling."""
    composed, step = functions.copy(), 1
    while step < len(composed):
        later = composed.copy()
        later[step:] = np.take_along_axis(composed[step:], composed[:-step], axis=1)
        composed, step = later, step * 2
    return np.concatenate(([FRESH], composed[:-1, FRESH])).astype(np.uint8)


def token_starts(sym: np.ndarray) -> np.ndarray:
    """Places where pre-tokens begin, by an associative scan over blocks."""
    n = len(sym)
    if not n:
        return np.zeros(0, dtype=np.int64)
    to, start = automaton()
    width = 64 if n > 4096 else 8
    rows = -(-n // width)
    grid = np.full(rows * width, O, dtype=np.uint8)
    grid[:n] = sym
    columns = np.ascontiguousarray(grid.reshape(rows, width).T)
    flat = to.ravel()
    composed = np.tile(np.arange(STATES, dtype=np.uint8), (rows, 1))
    for c in columns:
        composed = flat[(c.astype(np.int16) * STATES)[:, None] + composed]
    state = _scan(composed)
    found = np.empty((width, rows), dtype=bool)
    flags = start.ravel()
    for k, c in enumerate(columns):
        at = c.astype(np.int16) * STATES + state
        found[k] = flags[at]
        state = flat[at]
    return np.flatnonzero(found.T.ravel()[:n])


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one long pre-token, with a heap of pairs over a linked list: n log n."""
    n = len(piece)
    end, back, ahead = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(ranks[piece[i : i + 2]], i, i + 1, i + 2) for i in range(n - 1) if piece[i : i + 2] in ranks]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, mid, stop = heapq.heappop(heap)
        if not alive[i] or end[i] != mid or mid >= n or not alive[mid] or end[mid] != stop:
            continue
        alive[mid], end[i], ahead[i] = False, stop, ahead[mid]
        if ahead[i] < n:
            back[ahead[i]] = i
            if (r := ranks.get(piece[i : end[ahead[i]]])) is not None:
                heapq.heappush(heap, (r, i, stop, end[ahead[i]]))
        if back[i] >= 0 and (r := ranks.get(piece[back[i] : stop])) is not None:
            heapq.heappush(heap, (r, back[i], i, stop))
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


class Vocabulary:
    """Ranks, cached merges, and an offset table of all tokens' bytes for decoding."""

    def __init__(self, path: str):
        import base64

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        by_id = dict(sorted((i, t) for t, i in self.ranks.items()))
        size = max(by_id, default=-1) + 1
        lengths = np.zeros(size, dtype=np.int64)
        for i, t in by_id.items():
            lengths[i] = len(t)
        self.offsets = np.concatenate(([0], np.cumsum(lengths)))
        self.bytes = np.frombuffer(b"".join(by_id.values()), dtype=np.uint8)
        self.size = size
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = {self.ranks[t[:k]] * size + self.ranks[t[k:]]: i for i, t in by_id.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks}
        self.pairs = np.array(sorted(pairs), dtype=np.int64)
        self.merged = np.array([pairs[k] for k in self.pairs.tolist()], dtype=np.int64)

    def _pair_ranks(self, ids: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Rank of each id joined with the next one; NONE where no token results or the piece ends."""
        keys = ids * self.size + np.append(ids[1:], 0)
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        return np.where((self.pairs[at] == keys) & ~last, self.merged[at], NONE)

    def merge_many(self, raw: list[bytes]) -> list[bytes]:
        """Ids of many pre-tokens as uint32 bytes; every round merges the lowest pair of all unfinished ones."""
        done: list[bytes | None] = [None] * len(raw)
        short = [i for i, r in enumerate(raw) if 0 < len(r) <= LONG_PIECE]
        for i, r in enumerate(raw):
            if len(r) > LONG_PIECE or not r:
                done[i] = np.array(merge_long(r, self.ranks), dtype="<u4").tobytes()
        ids = self.single[np.frombuffer(b"".join(raw[i] for i in short), dtype=np.uint8)]
        owner = np.array(short, dtype=np.int64)
        lengths = np.array([len(raw[i]) for i in short], dtype=np.int64)
        while len(owner):
            begins = np.cumsum(lengths) - lengths
            last = np.zeros(len(ids), dtype=bool)
            last[begins + lengths - 1] = True
            ranks = self._pair_ranks(ids, last)
            low = np.minimum.reduceat(ranks, begins)
            finished = low == NONE
            if finished.any():
                packed = ids.astype("<u4").tobytes()
                for i, b, n in zip(owner[finished].tolist(), begins[finished].tolist(), lengths[finished].tolist(), strict=True):
                    done[i] = packed[4 * b : 4 * (b + n)]
            per_id = np.repeat(np.arange(len(owner)), lengths)
            hits = np.flatnonzero((ranks == low[per_id]) & ~finished[per_id])
            segment = per_id[hits]
            hits = hits[np.append(True, segment[1:] != segment[:-1])] if len(hits) else hits  # the leftmost of each piece
            ids[hits] = ranks[hits]
            keep = ~finished[per_id]
            keep[hits + 1] = False
            ids, owner, lengths = ids[keep], owner[~finished], lengths[~finished] - 1
        return done

    def encode(self, texts: list[str], known: dict[str, bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, offsets): the ids of each text, and where each pre-token's ids begin among them (one more: the end).

        known: pre-tokens already merged, with their ids; the task owns it and new ones are added.
        """
        joined = "".join(texts)
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        begins = np.concatenate(([0], np.cumsum(lengths)))
        cuts = token_starts(symbols(decode(joined), begins[:-1][lengths > 0]))
        bounds = [*cuts.tolist(), len(joined)]
        slices = [joined[i:j] for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
        if len(known) > CACHED_TOKENS:
            known.clear()
        fresh = list(set(slices).difference(known))
        known.update(zip(fresh, self.merge_many([p.encode("utf-8", "surrogatepass") for p in fresh]), strict=True))
        coded = list(map(known.__getitem__, slices))
        sizes = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded)) // 4
        ends = np.concatenate(([0], np.cumsum(sizes)))
        every = np.frombuffer(b"".join(coded), dtype="<u4")
        at = np.searchsorted(cuts, begins)  # pre-tokens before each text
        return [(every[ends[i] : ends[j]], ends[i : j + 1] - ends[i]) for i, j in zip(at[:-1], at[1:], strict=True)]

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the ids, gathered through the offset table."""
        begin, size = self.offsets[ids], self.offsets[ids.astype(np.int64) + 1] - self.offsets[ids]
        ends = np.cumsum(size)
        if not len(ids):
            return b""
        shift = np.repeat(begin - (ends - size), size)
        return self.bytes[shift + np.arange(ends[-1])].tobytes()


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    """One vocabulary per worker and rank file, kept across tasks; merged pre-tokens are not."""
    return Vocabulary(path)


@functools.cache
def _decimal(size: int) -> list[str]:
    return [str(i) for i in range(size)]


def encode_table(docs: DataFrame, rank_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ids (array of int), offsets (array of int, one per pre-token and the end).

    rank_file: a .tiktoken file that every executor can read.  Null texts count as empty; no special tokens; texts of
    any length are encoded whole.  Repeated rows return as often as they stand; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def lists(arrays: list[np.ndarray]) -> pa.ListArray:
        ends = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
        return pa.ListArray.from_arrays(ends, np.concatenate([*arrays, np.zeros(0, np.int32)]).astype(np.int32))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bytes] = {}
        for batch in batches:
            at = 0
            for group in by_size(t.as_py() for t in batch.column(1)):
                coded = vocabulary(rank_file).encode(group, known)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(group)), lists([c[0] for c in coded]), lists([c[1] for c in coded])], ["id", "ids", "offsets"])
                at += len(group)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(work, f"id {kind}, ids array<int>, offsets array<int>").withColumnRenamed("id", id_col)


def decode_table(coded: DataFrame, rank_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: id, decoded (binary).  Null id lists decode to nothing."""
    kind = coded.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [vocabulary(rank_file).decode(np.asarray(ids or [], dtype=np.int64)) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], ["id", "decoded"])

    rows = coded.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(work, f"id {kind}, decoded binary").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, rank_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_tokens, ids_sha256, decoded_sha256; encodes, then decodes what it encoded."""
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bytes] = {}
        for batch in batches:
            vocab = vocabulary(rank_file)
            decimal = _decimal(len(vocab.offsets) - 1)
            counts, of_ids, of_text = [], [], []
            for group in by_size(t.as_py() for t in batch.column(1)):
                for ids, _ in vocab.encode(group, known):
                    counts.append(len(ids))
                    of_ids.append(hashlib.sha256(" ".join(map(decimal.__getitem__, ids.tolist())).encode()).hexdigest())
                    of_text.append(hashlib.sha256(vocab.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(work, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
