"""Language identification by rank-order profiles and out-of-place distance.

Training counts letter n-grams (orders 1 to 3, words bounded by a blank) of all labelled training texts per language:
every task folds its share into one count per language and n-gram (within texts, so that it does not matter how they are
dealt), Spark sums those, and a window keeps the most
frequent ``PROFILE`` n-grams of each language.  Only these few ranks reach the driver (languages x PROFILE rows).
Prediction ranks a text's own n-grams the same way; the distance to a language is the sum of rank differences, an
n-gram that the profile lacks counting PROFILE places.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trove.llm.codepoints import LETTER, MARK, classes, decode

ORDERS = (1, 2, 3)
PROFILE = 400
MAX_LANGUAGES = 2000
UNDETERMINED = "und"
#: Code points handled at a time; a longer text is counted in slices that overlap by two.
SLICE = 1 << 17
#: Distinct n-grams a task holds before it hands its counts on.
FLUSH = 1_000_000


def letters(text: str) -> np.ndarray:
    """Lower-cased letters and marks, each run of anything else as one blank; a blank at both ends."""
    cps = decode(text.lower())
    kind = classes()[cps]
    keep = (kind == LETTER) | (kind == MARK)
    line = np.where(keep, cps, np.uint32(32))
    starts = keep.copy()
    starts[1:] |= keep[:-1]  # a blank stays if a letter stands before it
    if len(starts):
        starts[0] = keep[0]
    blank, line = np.full(1, 32, dtype=np.uint32), line[starts]
    return np.concatenate((blank, line, blank[: 0 if len(line) and line[-1] == 32 else 1]))


def grams(line: np.ndarray, seen: int = 0) -> np.ndarray:
    """All n-grams of the line as one array of packed code points (21 bits each).

    The first ``seen`` elements, and what they make among themselves, were counted before.  Two blanks in a row stand only
    where one text ends and another begins; no n-gram spans them.
    """
    blank = line == 32
    whole = ~(blank[:-1] & blank[1:])
    pairs, at = line[:-1] << 21 | line[1:], max(seen - 1, 0)
    found = [line[seen:][~blank[seen:]], pairs[at:][whole[at:]]]
    if len(line) > 2:
        found.append((pairs[:-1] << 21 | line[2:])[whole[:-1] & whole[1:]])
    return np.concatenate(found)


def add(a: tuple[np.ndarray, np.ndarray] | None, b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sum of two (sorted codes, counts) pairs."""
    if a is None or not len(a[0]):
        return b
    if not len(b[0]):
        return a
    codes = np.concatenate((a[0], b[0]))
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], np.concatenate((a[1], b[1]))[order]
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    return codes[first], np.add.reduceat(counts, first)


def count(line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a line, ascending, with their counts."""
    total = None
    for at in range(0, max(len(line) - 2, 1), SLICE):
        part = line[at : at + SLICE + 2].astype(np.int64)
        codes = np.sort(grams(part, 2 if at else 0))
        first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if len(codes) else np.zeros(0, np.int64)
        total = add(total, (codes[first], np.diff(np.append(first, len(codes)))))
    return total


def ranked(codes: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent codes; ties by ascending code."""
    return codes[np.argsort(-counts, kind="stable")[:size]]


def _count_languages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    waiting: dict[str, list[str]] = {}
    size = 0

    def fold(lang: str) -> None:
        texts = waiting.pop(lang)
        held[lang] = add(held.get(lang), count(np.concatenate([letters(t) for t in texts])))

    def out() -> Iterator[pa.RecordBatch]:
        for lang, (codes, counts) in held.items():
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(codes), pa.string()), "gram": codes, "n": counts.astype(np.int64)})
        held.clear()

    pending: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            lang, text = lang.as_py(), text.as_py()
            waiting.setdefault(lang, []).append(text)
            pending[lang] = pending.get(lang, 0) + len(text)
            if pending[lang] >= SLICE:
                fold(lang)
                pending[lang] = 0
        size = sum(len(c) for c, _ in held.values())
        if size > FLUSH:
            yield from out()
    for lang in list(waiting):
        fold(lang)
    yield from out()


def train_profiles(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = PROFILE) -> DataFrame:
    """(lang, gram, place): the ``size`` most frequent n-grams of each language, over all rows with text and language."""
    labelled = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    counts = labelled.mapInArrow(_count_languages, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    by_count = [F.desc("n"), F.col("gram")]
    # the first window works on pieces of a language, so that none gathers all its n-grams
    piece = Window.partitionBy("lang", F.pmod(F.xxhash64("gram"), F.lit(32))).orderBy(*by_count)
    few = counts.withColumn("r", F.row_number().over(piece)).where(F.col("r") <= size).drop("r")
    return few.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(*by_count))).where(F.col("place") <= size).select("lang", "gram", "place")


class Profiles:
    """Ranks of all languages as one dense array; picklable, a few hundred entries a language."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int = PROFILE):
        self.size = size
        self.langs = sorted({r[0] for r in rows})
        self.codes = np.unique(np.array([r[1] for r in rows], dtype=np.int64))
        self.places = np.full((len(self.langs), len(self.codes) + 1), -1, dtype=np.int32)
        at = {lang: i for i, lang in enumerate(self.langs)}
        for lang, code, place in rows:
            self.places[at[lang], np.searchsorted(self.codes, code)] = place - 1

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score (1: every place agrees, 0: no n-gram is known)."""
        if not text or not self.langs:
            return UNDETERMINED, 0.0
        line = letters(text)
        if not (classes()[line] == LETTER).any():
            return UNDETERMINED, 0.0
        top = ranked(*count(line), self.size)
        at = np.searchsorted(self.codes, top)
        at[at == len(self.codes)] = len(self.codes) - 1
        at = np.where(self.codes[at] == top, at, len(self.codes))
        places = self.places[:, at]
        apart = np.where(places < 0, self.size, np.abs(places - np.arange(len(top), dtype=np.int32)))
        total = apart.sum(axis=1)
        best = int(total.argmin())
        return self.langs[best], 1.0 - float(total[best]) / (self.size * len(top))


def collect_profiles(profiles: DataFrame, size: int = PROFILE) -> Profiles:
    """Bring the ranks to the driver; refused above MAX_LANGUAGES languages."""
    rows = profiles.select("lang", "gram", "place").limit(MAX_LANGUAGES * size + 1).collect()
    if len(rows) > MAX_LANGUAGES * size:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return Profiles([tuple(r) for r in rows], size)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """The rows kept from training: CRC-32 of the id as text divisible by ``folds``."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def identify(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per input row: id, lang_pred, score (0 to 1), and the columns named in ``keep``, prefixed ``in_``.

    Only the text is read.  ``und`` with score 0 stands for a null or empty text, one without a letter, or no profile;
    ties between languages go to the first by name.  Texts of any length are ranked whole; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    rows = docs.select(F.col(id_col).alias("id"), *[F.col(c).alias(f"in_{c}") for c in keep or []], F.col(text_col).alias("text"))
    carried = rows.columns[:-1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            results = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *results], [*carried, "lang_pred", "score"])

    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in rows.schema.fields[:-1]], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(work, schema).withColumnRenamed("id", id_col)
