"""Near duplicates by Order MinHash, verified by banded alignment.

A text is its sequence of five-word shingles, each labelled with its occurrence number.  Every hash function keeps the
``TUPLE`` smallest labelled shingles in text order; ``ROWS`` such tuples make a band.  A text with repeats has a second
set of bands, over the first occurrences alone, so that it meets texts that repeat them more or less often.  A third set
is over labelled single words, ``WORD_TUPLE`` a band, so that texts meet whose edits lie in every shingle; texts of up to
``SHORT`` words meet exactly, by all that is left of them without as many words as a link may lack.  Texts of equal words
fold into one representative first.  Texts that share a band are candidates.  Each band's bucket compares its members with
one centre, the member that shares most bands overall; similar texts share many buckets, each with a centre of its own.
With that all pairs of the centre are done, and it leaves its bucket; a bucket of two is done with its only pair.  In buckets
of over ``MANY`` one member of each class that is not the centre's then meets a second member, by chance, from another class.
These two steps join nearly all of a family; last, every pair without the centre whose ends are still in different classes is
compared.
Components of all links are the classes; those of the first two steps are only joined further by the links of the last.

Words are read for pairs only that may be linked: a text's marks, the parities of its hashes of words and of shingles that
fall to a bit each, differ in no more bits than two texts have hashes alone.  Pairs whose marks or lengths rule a link out
are left there.

Two texts are similar if an alignment holds 0.8 or more: of their words (matched words over those of the longer text), or
of their distinct shingles (collinear matched ones over all of both).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trove.llm.components import components, extended
from trove.llm.words import words as words_of
from trove.plans.scratch import discard, materialise, sized

SHINGLE = 5
SIMILARITY = 0.8
TUPLE, ROWS, BANDS = 2, 2, 64
#: Words in a band and bands over words: a link of 0.8 of the words shares at least two thirds of all, thus a band but for 2e-5 or less.
WORD_TUPLE, WORD_BANDS = 4, 64
#: Texts of up to so many words meet by what is left without one or two of them.
SHORT = 14
#: Texts in a bucket from which on chance meetings spare more pairs than they cost.
MANY = 16
#: Places of an alignment handled at a time.
LCS_BLOCK = 8192
#: Words of the texts on one side of a cell of a bucket.
CELL_WORDS = 500_000
#: Least bits of marks for a word and for a shingle.
WORD_BITS, SHINGLE_BITS = 1.5, 0.5
#: Pairs of a cell, and bytes of marks, handled at a time.
PAIRS, MARKS_BLOCK = 1 << 18, 1 << 22
#: Columns of a text's sizes and marks.
SIZES = "id long, n_words int, n_shingles int, word_marks binary, shingle_marks binary"
MARKS = ["n_words", "n_shingles", "word_marks", "shingle_marks"]
#: In a cell a text may be one of those that meet all, one of all, or both.
EVERY, FEW, BOTH = 0, 1, 2
#: Columns of the hash matrix handled at a time.
BLOCK = 4096

_rng = np.random.default_rng(20)
_MULT = _rng.integers(1, 2**31, size=BANDS * ROWS, dtype=np.uint32) << np.uint32(1) | np.uint32(1)
_XOR = _rng.integers(0, 2**32, size=BANDS * ROWS, dtype=np.uint32)
_WORD_MULT = _rng.integers(1, 2**31, size=WORD_BANDS, dtype=np.uint32) << np.uint32(1) | np.uint32(1)
_WORD_XOR = _rng.integers(0, 2**32, size=WORD_BANDS, dtype=np.uint32)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of all five-word windows; a shorter text has one, of all its words."""
    w = words.astype(np.int64).astype(np.uint64)
    n = max(len(w) - SHINGLE + 1, 1)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(min(SHINGLE, len(w))):
        h = _mix(h + _GOLD + w[k : k + n])
    return h


def labelled(h: np.ndarray) -> np.ndarray:
    """Hashes with the occurrence number mixed in, so that all differ."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    run = np.arange(len(s))
    first = np.concatenate(([True], s[1:] != s[:-1]))
    nth = run - np.maximum.accumulate(np.where(first, run, 0))
    out = np.empty_like(h)
    out[order] = _mix(s + nth.astype(np.uint64) * _GOLD)
    return out


def sketch(words: np.ndarray) -> np.ndarray:
    """Hashes of a text's buckets, each once.

    Bands of all shingles, for a text with repeats also of first occurrences, and of words; for a short text its remains.
    """
    plain = shingles(words)
    h = labelled(plain)
    first = np.sort(np.unique(plain, return_index=True)[1])
    found = [_bands(h)]
    if len(first) < len(h):
        found.append(_bands(h[first]))
    single = words.astype(np.int64).astype(np.uint64)
    if len(words) > SIMILARITY * SHORT:  # may link to a text that is not short
        found.append(_word_bands(labelled(_mix(single + _GOLD))))
    if len(words) <= SHORT:
        found.append(_remains(single))
    # 48 bits: two that fall together by chance add a comparison
    return np.unique(np.concatenate(found).view(np.uint64) >> np.uint64(16)).view(np.int64)


def _smallest(h: np.ndarray, mult: np.ndarray, xor: np.ndarray, size: int) -> np.ndarray:
    """One hash per function of the ``size`` smallest of a sequence of different hashes, in text order.

    The functions order by the upper halves of the hashes, of equal ones by place.
    """
    rows, upper = np.arange(len(mult)), (h >> np.uint64(32)).astype(np.uint32)
    best: list[tuple[np.ndarray, np.ndarray]] = []  # values and places of the smallest found so far
    for at in range(0, len(h), BLOCK):
        v = (upper[None, at : at + BLOCK] ^ xor[:, None]) * mult[:, None]
        for _ in range(min(size, v.shape[1])):
            i = v.argmin(axis=1)
            best.append((v[rows, i], i + at))
            v[rows, i] = np.uint32(2**32 - 1)
        if len(best) > size:
            values, places = np.stack([b[0] for b in best], 1), np.stack([b[1] for b in best], 1)
            order = np.argsort(values, axis=1, kind="stable")[:, :size]
            best = [(np.take_along_axis(values, order[:, k : k + 1], 1)[:, 0], np.take_along_axis(places, order[:, k : k + 1], 1)[:, 0]) for k in range(size)]
    places = np.sort(np.stack([b[1] for b in best], 1), axis=1)  # text order
    tuples = np.zeros(len(mult), dtype=np.uint64)
    for k in range(places.shape[1]):
        tuples = _mix(tuples + _GOLD + h[places[:, k]])
    return tuples


def _bands(h: np.ndarray) -> np.ndarray:
    """One hash per band of a sequence of different hashes."""
    tuples = _smallest(h, _MULT, _XOR, TUPLE)
    bands = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        bands = _mix(bands * _GOLD + tuples.reshape(BANDS, ROWS)[:, k])
    return bands.view(np.int64)


def _word_bands(h: np.ndarray) -> np.ndarray:
    """One hash per band of labelled words."""
    return _mix(np.arange(BANDS, BANDS + WORD_BANDS, dtype=np.uint64) * _GOLD + _smallest(h, _WORD_MULT, _WORD_XOR, WORD_TUPLE)).view(np.int64)


@lru_cache(maxsize=64)
def _kept(n: int, without: int) -> np.ndarray:
    """The places left without ``without`` of ``n``, a row for each choice."""
    return np.array(list(combinations(range(n), n - without)), dtype=np.int64)


def _remains(words: np.ndarray) -> np.ndarray:
    """Hashes of a short text without any words that a link of it may lack; two linked short texts have one in common."""
    n, found = len(words), []
    for without in range(n - _needed(n) + 1):
        left = words[_kept(n, without)]
        h = np.full(len(left), BANDS + WORD_BANDS, dtype=np.uint64)
        for k in range(n - without):
            h = _mix(h + _GOLD + left[:, k])
        found.append(h)
    return np.concatenate(found).view(np.int64)


def _needed(longer: int, least: float = SIMILARITY) -> int:
    """Words that a link of a text of ``longer`` words with one no longer has to match."""
    return int(np.ceil(least * longer - 1e-9))


def _longest_increasing(values: np.ndarray) -> np.ndarray:
    """Indexes of a longest increasing subsequence of different values."""
    import bisect

    if len(values) < 2 or (values[1:] > values[:-1]).all():
        return np.arange(len(values))
    tails: list[int] = []
    ends: list[int] = []  # index of each tail
    back = []
    for k, v in enumerate(values.tolist()):
        i = bisect.bisect_left(tails, v)
        tails[i : i + 1] = [v]
        ends[i : i + 1] = [k]
        back.append(ends[i - 1] if i else -1)
    chain = [ends[-1]]
    while back[chain[-1]] >= 0:
        chain.append(back[chain[-1]])
    return np.array(chain[::-1])


def _banded_lcs(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Longest common subsequence of two sequences within ``band`` of the diagonal; a bit a place of ``b``, a step a word of ``a``.

    ``b`` is taken in blocks, so that the places of its words stay small; carries pass from a block to the next.
    """
    words, rows = a.tolist(), len(a)
    carries = [0] * rows  # of each step, from the block before
    found, wide = 0, (1 << 2 * band + 1) - 1
    for at in range(0, len(b), LCS_BLOCK):
        block = b[at : at + LCS_BLOCK].tolist()
        places: dict[int, int] = {}
        for k, w in enumerate(block):
            places[w] = places.get(w, 0) | 1 << k
        size = len(block)
        every = free = (1 << size) - 1
        for i in range(rows):
            left = i - band - at
            m = places.get(words[i], 0)
            if m:
                m &= wide << left if left >= 0 else wide >> -left
            if m or carries[i]:
                u = free & m
                total = free + u + carries[i]
                carries[i] = total >> size
                free = (total | (free & ~m)) & every
        found += size - free.bit_count()
    return found


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection with repeats."""
    ua, na = np.unique(a, return_counts=True)
    ub, nb = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    return int(np.minimum(na[ia], nb[ib]).sum())


def _aligned_words(a: np.ndarray, b: np.ndarray, places: np.ndarray, least: float) -> int:
    """Words matched by an alignment of two texts, or 0 where no alignment holds ``least`` of the longer one's.

    places: of collinear shared shingles, whose words alone often suffice.  Else counts of shared words and of shared
    neighbours rule most pairs out: a word without a match parts at most two pairs of neighbours on its own side and one on the
    other.  The rest is aligned in the band that a long enough alignment cannot leave.
    """
    longer, shorter = max(len(a), len(b)), min(len(a), len(b))
    needed = _needed(longer, least)
    if shorter < needed:
        return 0
    if places.shape[1]:
        covered = SHINGLE + int(np.minimum(np.diff(places, axis=1).min(axis=0, initial=SHINGLE), SHINGLE).sum())
        if covered >= needed and shorter >= SHINGLE:
            return covered
    if _shared(a, b) < needed:
        return 0
    pair = [x[:-1].astype(np.int64) << 32 ^ (x[1:].astype(np.int64) & 0xFFFFFFFF) for x in (a, b)]
    if _shared(*pair) < 3 * needed - len(a) - len(b) - 1:
        return 0
    return _banded_lcs(a, b, longer - needed)


def compare(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Similarity of two texts by alignment: that of their shingles, or if it is below ``least`` that of their words.

    Shingles: distinct ones of both whose first places ascend together, over all distinct ones.  Words: matched ones over
    those of the longer text, by a lower bound where that is enough, and 0 where ``least`` cannot be reached.
    """
    ua, fa = np.unique(shingles(a), return_index=True)
    ub, fb = np.unique(shingles(b), return_index=True)
    _, ia, ib = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    places = np.stack((fa[ia], fb[ib]))
    places = places[:, places[0].argsort()]
    places = places[:, _longest_increasing(places[1])]
    aligned = places.shape[1]
    similarity = aligned / (len(ua) + len(ub) - aligned)
    if similarity < least:
        similarity = max(similarity, _aligned_words(a, b, places, least) / max(len(a), len(b), 1))
    return similarity


def _lists(column: pa.Array) -> list[np.ndarray]:
    flat, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[i:j] for i, j in zip(offsets[:-1], offsets[1:], strict=True)]


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            bands = [sketch(w) for w in _lists(batch.column(1))]
            ends = np.cumsum([0] + [len(b) for b in bands], dtype=np.int32)
            lists = pa.ListArray.from_arrays(ends, np.concatenate(bands))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["id", "bands"])


def _marks(h: np.ndarray, each: float) -> bytes:
    """Parities of the numbers of hashes that fall to each of at least ``each`` bits a hash; the bits are a power of two."""
    size = 64
    while size < each * len(h):
        size *= 2
    return np.packbits(np.bincount((h & np.uint64(size - 1)).astype(np.int64), minlength=size).astype(np.uint8) & 1).tobytes()


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = _lists(batch.column(1))
        distinct = [np.unique(shingles(w)) for w in lists]
        counts = [pa.array([len(x) for x in of], pa.int32()) for of in (lists, distinct)]
        of_words = [_marks(labelled(_mix(w.astype(np.int64).astype(np.uint64) + _GOLD)), WORD_BITS) for w in lists]
        of_shingles = [_marks(x, SHINGLE_BITS) for x in distinct]
        yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(of_words, pa.binary()), pa.array(of_shingles, pa.binary())], ["id", *MARKS])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [compare(x, y) for x, y in zip(_lists(batch.column(2)), _lists(batch.column(3)), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64())], ["a", "b", "similarity"])


def _share(marks: list[bytes], sizes: np.ndarray, x: np.ndarray, y: np.ndarray, needed: np.ndarray) -> np.ndarray:
    """Whether the sets numbered x and y may share as much as is needed: each bit that differs stands for a hash or more of one alone."""
    length = np.array([len(m or b"") for m in marks], dtype=np.int64)
    low, found = np.minimum(length[x], length[y]), np.zeros(len(x), dtype=bool)
    for size in np.unique(low):
        of = np.flatnonzero(low == size)
        ends, at = np.unique(np.concatenate((x[of], y[of])), return_inverse=True)
        # the parts of a longer one fall onto each other
        bits = np.stack([np.bitwise_xor.reduce(np.frombuffer(marks[e], dtype=np.uint64).reshape(-1, size // 8), axis=0) for e in ends])
        for k in range(0, len(of), step := max(MARKS_BLOCK // int(size), 1)):
            part = of[k : k + step]
            p, q = at[k : k + len(part)], at[len(of) + k : len(of) + k + len(part)]
            alone = np.bitwise_count(bits[p] ^ bits[q]).sum(axis=1, dtype=np.int64)
            found[part] = sizes[x[part]] + sizes[y[part]] - alone >= 2 * needed[part]
    return found


def _possible(docs: dict[str, list | np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the texts numbered x and y may share words or shingles enough for a link.

    Of two texts without repeated shingles a link by these is one by words too, and their marks of shingles may be null.
    """
    words, distinct = docs["n_words"].astype(np.int64), docs["n_shingles"].astype(np.int64)
    repeats = distinct < words - SHINGLE + 1
    needed = np.ceil(SIMILARITY * np.maximum(words[x], words[y]) - 1e-9)
    found = np.minimum(words[x], words[y]) >= needed
    k = np.flatnonzero(found)
    found[k] = _share(docs["word_marks"], words, x[k], y[k], needed[k])
    needed = SIMILARITY / (1 + SIMILARITY) * (distinct[x] + distinct[y]) - 1e-6
    k = np.flatnonzero(~found & (repeats[x] | repeats[y]) & (np.minimum(distinct[x], distinct[y]) >= needed))
    found[k] = _share(docs["shingle_marks"], distinct, x[k], y[k], needed[k])
    return found


def _first_meetings(bucket: np.ndarray, buckets: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the texts numbered x and y, which meet in the bucket of x, share none that comes before it.

    buckets: of each text, in ascending order; those before that of its row are enough.
    """
    found = np.ones(len(x), dtype=bool)
    order = np.argsort(x, kind="stable")
    for of in np.split(order, np.flatnonzero(np.diff(x[order])) + 1) if len(x) else ():
        k = x[of[0]]
        before = buckets[k][: np.searchsorted(buckets[k], bucket[k])]
        if len(before):
            theirs = [buckets[i] for i in y[of]]
            owner = np.repeat(np.arange(len(of)), [len(t) for t in theirs])
            found[of[owner[np.isin(np.concatenate(theirs), before)]]] = False
    return found


def _meetings(cell: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of the texts that meet, some ``PAIRS`` at a time; each text stands with its cell, in the order of these."""
    rows, columns = np.flatnonzero(side != EVERY), np.flatnonzero(side != FEW)
    start, end = (np.searchsorted(cell[columns], cell[rows], side=s) for s in ("left", "right"))
    ends = np.cumsum(end - start)
    at = 0
    while at < len(rows):
        to = max(int(np.searchsorted(ends, ends[at] + PAIRS)), at + 1)
        times = end[at:to] - start[at:to]
        nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        x, y = np.repeat(rows[at:to], times), columns[np.repeat(start[at:to], times) + nth]
        once = (x < y) | (side[x] != BOTH) | (side[y] != BOTH)
        yield x[once], y[once]
        at = to


def _open_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of the pairs of a cell that may be linked, their ends in different classes and in no common bucket before."""
    for batch in batches:
        lists = batch.column(1)
        times = np.diff(lists.offsets.to_numpy())
        cell, bucket = np.repeat(np.arange(len(lists)), times), np.repeat(batch.column(0).to_numpy(), times)
        fields = lists.flatten().flatten()
        id_, root, side = (f.to_numpy() for f in fields[:3])
        buckets = _lists(fields[3])
        docs = {name: f.to_pylist() if name.endswith("marks") else f.to_numpy() for name, f in zip(MARKS, fields[4:], strict=True)}
        for x, y in _meetings(cell, side):
            apart = root[x] != root[y]
            x, y = x[apart], y[apart]
            kept = _possible(docs, x, y)
            x, y = x[kept], y[kept]
            kept = _first_meetings(bucket, buckets, x, y)
            ends = id_[x[kept]], id_[y[kept]]
            yield pa.RecordBatch.from_arrays([pa.array(f(*ends), pa.int64()) for f in (np.minimum, np.maximum)], ["a", "b"])


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs that may be linked."""
    for batch in batches:
        n = np.arange(batch.num_rows)
        both = {name: (batch.column(2 + i), batch.column(2 + len(MARKS) + i)) for i, name in enumerate(MARKS)}
        docs = {name: a.to_pylist() + b.to_pylist() if name.endswith("marks") else np.concatenate((a.to_numpy(), b.to_numpy())) for name, (a, b) in both.items()}
        kept = pa.array(_possible(docs, n, n + batch.num_rows))
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(kept) for c in (0, 1)], ["a", "b"])


def _near(a: str, b: str) -> Column:
    """Whether two lengths allow a link."""
    return F.least(a, b) >= F.greatest(a, b) * SIMILARITY - 1e-6


def _fitting(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """The pairs whose numbers of words or of shingles, and whose marks, allow a link."""
    of = lambda name, columns: sizes.select(F.col("id").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in columns])
    near = _near("a_n_words", "b_n_words") | _near("a_n_shingles", "b_n_shingles")
    repeats = F.expr(" OR ".join(f"{x}_n_shingles < {x}_n_words - {SHINGLE - 1}" for x in "ab")).alias("repeats")
    pairs = pairs.join(of("a", MARKS[:2]), "a").join(of("b", MARKS[:2]), "b").where(near).select("a", "b", repeats)
    marked = pairs.join(of("b", MARKS), "b").withColumn("b_shingle_marks", F.when(F.col("repeats"), F.col("b_shingle_marks")))
    joined = marked.join(of("a", MARKS), "a").select("a", "b", *[f"{x}_{c}" for x in "ab" for c in MARKS])
    return materialise(joined.mapInArrow(_likely, "a long, b long"), "omh-pairs")


def _compared(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """(a, b, similarity) for each pair of ids of a scratch table, which is discarded."""
    ends = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    words = words.join(sized(ends), "id", "left_semi")
    left, right = words.select(F.col("id").alias("a"), F.col("words").alias("wa")), words.select(F.col("id").alias("b"), F.col("words").alias("wb"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "wa", "wb")
    found = materialise(joined.mapInArrow(_verify, "a long, b long, similarity double"), "omh-compared")
    discard(pairs)
    return found


def _starred(members: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(bucket, id, centre, size) of buckets of three or more; (a, b) of all centres and members, a < b; (id) of all that share a bucket.

    The member that shares most rows with others, over all buckets, is the centre of a bucket of ``size``.
    """
    bucket = Window.partitionBy("bucket")
    counted = members.select("bucket", "id", F.count(F.lit(1)).over(bucket).alias("size"), F.min("id").over(bucket).alias("least"))
    mate = F.when(F.expr("size = 2 AND id <> least"), F.col("least")).alias("mate")
    shared = materialise(counted.where("size > 1").select("bucket", "id", "size", mate), "omh-buckets")
    weight = materialise(shared.groupBy("id").agg(F.sum("size").alias("weight")), "omh-weights")
    several = shared.where("size > 2").select("bucket", "id", "size")
    most = F.max(F.struct("weight", (-F.col("id")).alias("minus"))).alias("c")
    centre = several.select("bucket", "id").join(weight, "id").groupBy("bucket").agg(most).select("bucket", (-F.col("c.minus")).alias("centre"))
    found = materialise(several.join(centre, "bucket").select("bucket", "id", "centre", "size"), "omh-stars")
    met = found.where("id <> centre").select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b"))
    pairs = materialise(met.union(shared.where("mate IS NOT NULL").select("mate", "id")).distinct(), "omh-met")
    discard(shared)
    return found, pairs, weight.select("id")


def _second(starred: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b), a < b: one member of each class of a large bucket but the centre's, with a member of another class, both by chance.

    roots: (node, root) of the components so far.
    """
    of = lambda name: roots.select(F.col("node").alias(name), F.col("root").alias(f"{name}_root"))
    root, centre = F.coalesce("id_root", "id"), F.coalesce("centre_root", "centre")
    placed = starred.where((F.col("size") > MANY) & (F.col("id") != F.col("centre"))).join(of("id"), "id", "left").join(of("centre"), "centre", "left").select("bucket", "id", root.alias("root"), (root != centre).alias("apart"))
    by_chance = F.min(F.struct(F.xxhash64("bucket", "id").alias("chance"), "id")).alias("m")
    held = materialise(placed.groupBy("bucket", "root").agg(by_chance, F.max("apart").alias("apart")).select("bucket", "root", "m.chance", "m.id", "apart"), "omh-held")
    first = held.groupBy("bucket").agg(F.min(F.struct("chance", "id", "root")).alias("m"), F.count(F.lit(1)).alias("classes")).where("classes > 1")
    first = materialise(first.select("bucket", F.col("m.id").alias("one"), F.col("m.root").alias("one_root")), "omh-first")
    met = held.join(first, "bucket")
    other = met.where("root <> one_root").groupBy("bucket").agg(F.min(F.struct("chance", "id")).alias("m")).select("bucket", F.col("m.id").alias("two"))
    partner = F.when(F.col("root") != F.col("one_root"), F.col("one")).otherwise(F.col("two"))
    pairs = materialise(met.where("apart").join(other, "bucket").select(F.least(partner, "id").alias("a"), F.greatest(partner, "id").alias("b")).distinct(), "omh-second")
    for spent in (held, first):
        discard(spent)
    return pairs


def _cells(mixed: DataFrame) -> DataFrame:
    """(bucket, cell, id, root, side): a bucket's texts dealt to cells in which its few meet all.

    mixed: (bucket, id, root, few, n_words), few being all but a bucket's largest class.

    Nearly all buckets are one cell.  A larger one has its few and its every text in blocks of some ``CELL_WORDS`` words, and
    a cell for each two blocks.
    """
    blocks = lambda n: F.greatest(F.ceil(n / CELL_WORDS), F.lit(1)).cast("int")
    of = mixed.groupBy("bucket").agg(blocks(F.sum("n_words")).alias("every"), blocks(F.sum(F.when(F.col("few"), F.col("n_words")))).alias("fews")).where("every > 1")
    placed = mixed.join(of, "bucket", "left")
    at = lambda i, j, side: F.struct(F.struct(i.cast("int").alias("i"), j.cast("int").alias("j")).alias("cell"), F.lit(side).alias("side"))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    one = F.array(F.when(F.col("few"), at(F.lit(0), F.lit(0), BOTH)).otherwise(at(F.lit(0), F.lit(0), EVERY)))
    as_every = F.transform(F.sequence(F.lit(0), F.col("fews") - 1), lambda i: at(i, own("every"), EVERY))
    as_few = F.transform(F.sequence(F.lit(0), F.col("every") - 1), lambda j: at(own("fews"), j, FEW))
    cells = F.when(F.col("every").isNull(), one).when(F.col("few"), F.concat(as_every, as_few)).otherwise(as_every)
    return placed.select("bucket", "id", "root", F.explode(cells).alias("at")).select("bucket", F.col("at.cell").alias("cell"), "id", "root", F.col("at.side").alias("side"))


def _rest(starred: DataFrame, roots: DataFrame, met: DataFrame, words: DataFrame, sizes: DataFrame) -> DataFrame:
    """(a, b, similarity) for every pair of a bucket without its centre whose ends are in different components, but those that cannot be linked.

    met: (a, b, similarity) of the pairs compared before, a < b; roots: (node, root) of the components of their links.

    All members but those of a bucket's largest class meet all of it; buckets of one class have none.
    """
    placed = starred.where("id <> centre").select("bucket", "id").join(roots.withColumnRenamed("node", "id"), "id", "left").select("bucket", "id", F.coalesce("root", "id").alias("root"))
    placed = materialise(placed, "omh-placed")
    held = placed.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
    most = held.groupBy("bucket").agg(F.count(F.lit(1)).alias("classes"), F.max(F.struct("n", "root")).alias("m")).where("classes > 1")
    mixed = placed.join(most.select("bucket", F.col("m.root").alias("largest")), "bucket").select("bucket", "id", "root", (F.col("root") != F.col("largest")).alias("few"))
    mixed = materialise(mixed.join(sizes.select("id", "n_words"), "id"), "omh-mixed")
    celled = materialise(_cells(mixed), "omh-cells")
    of = mixed.groupBy("id").agg(F.sort_array(F.collect_list("bucket")).alias("buckets")).join(sizes, "id")
    before = F.filter("buckets", lambda b: b < F.col("bucket")).alias("buckets")
    listed = celled.join(of, "id").groupBy("bucket", "cell").agg(F.collect_list(F.struct("id", "root", "side", before, *MARKS)).alias("docs"))
    pairs = listed.select("bucket", "docs").mapInArrow(_open_pairs, "a long, b long").distinct().join(met.select("a", "b"), ["a", "b"], "left_anti")
    found = _compared(materialise(pairs, "omh-rest"), words)
    for spent in (placed, mixed, celled):
        discard(spent)
    return found


def _one_each(texts: DataFrame) -> tuple[DataFrame, tuple[DataFrame, ...]]:
    """One text for each id, and the scratch tables that it reads besides; nothing is dealt anew where no id stands twice."""
    several = materialise(texts.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"), "omh-repeated")
    if several.isEmpty():
        return texts, (several,)
    once = materialise(texts.join(sized(several), "id", "left_semi").dropDuplicates(["id"]), "omh-once")
    return texts.join(sized(several), "id", "left_anti").union(once), (several, once)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, class_id (the smallest id of its class), class_size.

    Links: texts of equal word sequences, and texts whose alignment holds 0.8 or more (see above); classes are the
    connected components.  Texts of under four words link to equal ones only; runs of over ``LONGEST_WORD`` code points
    without white space count as a word a code point.  A null id or text takes no part: its class_id is its own id and its
    class_size 1.  Texts without a word are equal to each other.  Repeated rows belong to one class and count as often as
    they stand.  Ids are integers; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    usable = base.where("id IS NOT NULL AND text IS NOT NULL").select("id", words_of(F.col("text")).alias("words"))
    key = F.unhex(F.sha2(F.array_join("words", " "), 256)).alias("key")
    texts = materialise(usable.select("id", key, F.transform("words", lambda w: F.hash(w)).alias("words")), "omh-words")
    keyed, hashed = texts.select("id", "key"), texts.select("id", "words")
    exact = keyed.groupBy("key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
    # only keys of several rows are joined back; all other rows stand for themselves
    several = materialise(exact.where("n > 1"), "omh-copies")
    copies = materialise(keyed.join(sized(several), "key").select("id", "rep").distinct(), "omh-members")
    folded = copies.where("id <> rep").select("id")

    reps = hashed.join(sized(folded), "id", "left_anti")
    starred, pairs, ids = _starred(reps.mapInArrow(_sketches, "id long, bands array<long>").select("id", F.explode("bands").alias("bucket")))
    involved, repeated = _one_each(hashed)
    lengths = materialise(involved.join(sized(ids), "id", "left_semi").mapInArrow(_sizes, SIZES), "omh-lengths")
    first = _compared(_fitting(pairs, lengths), involved)
    enough = F.col("similarity") >= SIMILARITY
    linked = materialise(components(first.where(enough).select("a", "b")), "omh-roots")
    again = _second(starred, linked)
    second = _compared(_fitting(again.join(first.select("a", "b"), ["a", "b"], "left_anti"), lengths), involved)
    met = first.union(second)
    roots = extended(linked, second.where(enough).select("a", "b"))
    third = _rest(starred, roots, met, involved, lengths)
    # an id of several rows may have a class by each of them; every other copy takes the class of the text it equals
    of_several = sized(repeated[0])
    late = third.where(enough).select("a", "b").union(copies.join(of_several, "id", "left_semi").select("id", "rep"))
    joined = extended(roots, late)
    once = copies.join(of_several, "id", "left_anti").join(joined.select(F.col("node").alias("rep"), "root"), "rep", "left")
    once = once.select(F.col("id").alias("node"), F.coalesce("root", "rep").alias("root")).join(joined.select("node"), "node", "left_anti")
    classes = materialise(joined.union(once), "omh-classes")
    for spent in (texts, several, copies, *repeated, lengths, starred, pairs, ids, again, first, second, third, linked, roots, joined):
        discard(spent)
    sizes = base.where("id IS NOT NULL AND text IS NOT NULL").join(classes, F.col("id") == F.col("node")).groupBy("root").agg(F.count(F.lit(1)).alias("class_size"))
    sizes = materialise(sizes, "omh-sizes")
    of = classes.join(sizes, "root").select("node", F.col("root").alias("class_root"), "class_size")
    found = base.select("id", F.col("text").isNotNull().alias("has_text")).join(of, (F.col("id") == F.col("node")) & F.col("has_text"), "left")
    return found.select(F.col("id").cast(kind).alias(id_col), F.coalesce("class_root", "id").cast(kind).alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"))
