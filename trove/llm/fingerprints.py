"""Document fingerprints by closed syncmers over words, in DataFrame functions only.

A window of ``K`` words is an anchor if the smallest hash among its runs of ``S`` words stands at either edge.  The
choice looks at the window alone, so an edit changes only anchors that overlap it.  An anchor is one long, its 32-bit
hash above and its place (the number of its first word) below.  A fingerprint is the anchors' hashes in text order, eight
hex digits each.  Likeness matches anchors by position: equal hashes count where a neighbouring match lies at the same
shift, so that chance repeats of a passage's words elsewhere do not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trove.llm.words import words

#: Words of a window, and of the runs inside it: four runs, of which the outer two are edges.
K, S = 5, 2
#: Pieces of the id range per shuffle partition, and at most in all; sampled keys per piece, of which one is a bound.
PIECES_PER_PARTITION, MAX_PIECES, SAMPLED = 8, 100_000, 8
LOW = 0xFFFFFFFF


def _hash(anchor: Column) -> Column:
    return F.shiftright(anchor, 32)


def _place(anchor: Column) -> Column:
    return anchor.bitwiseAND(F.lit(LOW))


def _anchor(h: Column, place: Column) -> Column:
    return h.bitwiseAND(F.lit(~LOW)).bitwiseOR(place.cast("long"))


def with_anchors(rows: DataFrame, text_col: str, name: str = "anchors") -> DataFrame:
    """Add the anchors of a text (array of long, in text order); a text of one to four words has one, of all its words."""
    out = rows.withColumn("_w", words(F.col(text_col)))
    n_runs = F.greatest(F.size("_w") - 1, F.lit(0))
    out = out.withColumn("_r", F.zip_with(F.slice("_w", F.lit(1), n_runs), F.slice("_w", F.lit(2), n_runs), lambda v, w: F.xxhash64(v, w)))

    def anchor(a: Column, i: Column) -> Column:
        b, c, d = F.get("_r", i + 1), F.get("_r", i + 2), F.get("_r", i + 3)
        return F.when(F.least(a, d) <= F.least(b, c), _anchor(F.xxhash64(a, c, d), i))

    windows = F.filter(F.transform(F.slice("_r", F.lit(1), F.greatest(F.size("_w") - (K - 1), F.lit(0))), anchor), lambda x: x.isNotNull())
    whole = F.array(_anchor(F.xxhash64(F.array_join("_w", " ")), F.lit(0)))
    few = F.when(F.size("_w") > 0, whole).otherwise(F.array().cast("array<long>"))
    return out.withColumn(name, F.when(F.size("_w") >= K, windows).otherwise(few)).drop("_w", "_r")


def as_text(anchors: Column) -> Column:
    """The fingerprint as a string."""
    return F.array_join(F.transform(anchors, lambda x: F.lpad(F.hex(_hash(x).bitwiseAND(F.lit(LOW))), 8, "0")), "")


def with_firsts(rows: DataFrame, anchors: str, name: str) -> DataFrame:
    """Add the first anchor of each hash, sorted by hash."""
    first = lambda x, i: F.coalesce(_hash(F.get("_sorted", i - 1)) != _hash(x), F.lit(True))
    return rows.withColumn("_sorted", F.sort_array(anchors)).withColumn(name, F.filter("_sorted", first)).drop("_sorted")


def with_likeness(rows: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """Add the likeness (0 to 1) of two columns of ``with_firsts``: twice the matched anchors over those of both.

    A match counts if the match before or after it, in text order, lies at the same shift between the texts, or if either
    text has one anchor only.  Two empty fingerprints have likeness 1.  Texts without a common hash are not merged.
    """

    def sided(side: int):
        return lambda x: _anchor(x, F.shiftleft(_place(x), 1).bitwiseOR(F.lit(side).cast("long")))

    def pair(x: Column, i: Column) -> Column:
        y = F.get("_both", i + 1)
        here, there = F.shiftright(_place(x), 1), F.shiftright(_place(y), 1)
        from_a = x.bitwiseAND(F.lit(1).cast("long")) == 0
        return F.when(_hash(x) == _hash(y), F.shiftleft(F.when(from_a, here).otherwise(there), 32).bitwiseOR(F.when(from_a, there).otherwise(here)))

    def shift(p: Column) -> Column:
        return _place(p) - F.shiftright(p, 32)

    def in_place(p: Column, i: Column) -> Column:
        return F.coalesce(shift(p) == shift(F.get("_pairs", i - 1)), F.lit(False)) | F.coalesce(shift(p) == shift(F.get("_pairs", i + 1)), F.lit(False))

    merged = F.sort_array(F.concat(F.transform(a, sided(0)), F.transform(b, sided(1))))
    out = rows.withColumn("_meet", F.arrays_overlap(F.transform(a, _hash), F.transform(b, _hash)))
    out = out.withColumn("_both", F.when(F.col("_meet"), merged).otherwise(F.array().cast("array<long>")))
    out = out.withColumn("_pairs", F.sort_array(F.filter(F.transform("_both", pair), lambda p: p.isNotNull())))
    matched = F.when(F.least(F.size(a), F.size(b)) == 1, F.size("_pairs")).otherwise(F.size(F.filter("_pairs", in_place)))
    sizes = F.size(a) + F.size(b)
    out = out.withColumn(name, F.when(sizes == 0, F.lit(1.0)).otherwise(matched * F.lit(2.0) / sizes))
    return out.drop("_meet", "_both", "_pairs")


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, fingerprint.  A null text counts as empty and has an empty fingerprint."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    return with_anchors(rows, "text").select(F.col("id").alias(id_col), as_text(F.col("anchors")).alias("fingerprint"))


def anchor_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per anchor: id, place (number of its first word), anchor (its 32-bit hash); for positional joins.

    The explode keeps texts without an anchor and they are left out after it: a filter for them before it would repeat
    every step of the anchors inside the next one.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    each = with_anchors(rows, "text").select("id", F.explode_outer("anchors").alias("one")).where("one IS NOT NULL")
    return each.select(F.col("id").alias(id_col), _place(F.col("one")).cast("int").alias("place"), _hash(F.col("one")).cast("int").alias("anchor"))


def order_key(number: Column, text: Column) -> Column:
    """A string that sorts like (number, a hash of the text), null numbers first."""
    hexed = lambda x: F.lpad(F.hex(x.bitwiseXOR(F.lit(-(2**63)))), 16, "0")
    return F.concat(F.coalesce(hexed(number.cast("long")), F.lit("")), hexed(F.xxhash64(text)))


def _piece(key: Column, bounds: list[str]) -> tuple[Column, Column]:
    """(number of the last bound not above key, that bound), looked up in two levels of literal arrays."""
    width = max(1, int(len(bounds) ** 0.5))
    literal = lambda keys: F.split(F.lit(",".join(keys)), ",")
    coarse = F.size(F.filter(literal(bounds[::width]), lambda x: x <= key)) - 1
    below = F.filter(F.slice(literal(bounds), coarse * width + 1, F.lit(width)), lambda x: x <= key)
    return coarse * width + F.size(below) - 1, F.get(below, F.size(below) - 1)


def in_pieces(rows: DataFrame, key_col: str) -> DataFrame:
    """Rows hash-partitioned by piece of the key range, with columns _piece and _tail.

    Bounds are keys of rows, taken in order from a sample of the distinct keys (some ``SAMPLED`` a piece, whatever the number
    of rows), and the least key.  A row at a bound is also copied, with _tail 1, to the piece before it (the first of all to
    the last piece), so each piece finds its successors by itself and no window spans the table.
    """
    pieces = min(MAX_PIECES, PIECES_PER_PARTITION * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = rows.select(F.col(key_col).alias("k"))
    least, n = keys.agg(F.min("k"), F.count("k")).first()
    if least is None:
        return rows.withColumn("_piece", F.lit(0)).withColumn("_tail", F.lit(0))
    every = max(1, n // (pieces * SAMPLED))
    sample = keys.where(F.pmod(F.xxhash64("k"), F.lit(every)) == 0).distinct().collect()
    bounds = sorted({least, *sorted(r.k for r in sample)[::SAMPLED]})
    number, bound = _piece(F.col(key_col), bounds)
    before = (F.col("_own") + len(bounds) - 1) % len(bounds)
    own = F.struct(F.col("_own").alias("piece"), F.lit(0).alias("tail"))
    tail = F.struct(before.alias("piece"), F.lit(1).alias("tail"))
    placed = rows.withColumn("_own", number).withColumn("_bound", bound)
    placed = placed.withColumn("_at", F.explode_outer(F.when(F.col("_bound") == F.col(key_col), F.array(own, tail)).otherwise(F.array(own))))
    return placed.withColumn("_piece", F.col("_at.piece")).withColumn("_tail", F.col("_at.tail")).drop("_own", "_bound", "_at").repartition("_piece")


def with_next(placed: DataFrame, key_col: str, carried: list[str]) -> DataFrame:
    """Add next_<c> for each carried column: its value in the next row by ascending key (after the last: the first).

    placed: the result of ``in_pieces``.  Rows of equal keys follow the order of the carried columns.
    """
    order = Window.partitionBy("_piece").orderBy("_tail", key_col, *carried)
    return placed.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in carried]).where("_tail = 0").drop("_piece", "_tail")


def compare_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last quarter of its code points (rounded down) replaced by as many from the start of the
    next document by ascending id, or all of it if it is shorter.  Null texts count as empty; null ids come first; rows
    of equal ids follow a hash of their texts, so that many of them spread over tasks; a single row is its own next.
    Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = rows.withColumn("key", order_key(F.col("id"), F.col("text")))
    # anchors are made after the shuffle, which moves the texts alone; beside the text a row takes a string and one array
    # through the sort
    placed = with_anchors(in_pieces(rows, "key"), "text")
    placed = with_firsts(placed.withColumn("fingerprint", as_text(F.col("anchors"))), "anchors", "firsts").drop("anchors")
    pairs = with_next(placed, "key", ["text", "firsts"])
    size = F.length("text")
    quarter = F.floor(size / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), size - quarter), F.substring("next_text", F.lit(1), quarter))
    pairs = with_firsts(with_anchors(pairs.withColumn("edited", edited), "edited", "edited_anchors"), "edited_anchors", "edited_firsts")
    pairs = with_likeness(with_likeness(pairs, "firsts", "edited_firsts", "near_edited"), "firsts", "next_firsts", "near_next")
    return pairs.select(
        F.col("id").alias(id_col),
        size.cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint",
        as_text(F.col("edited_anchors")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )
