"""Vocabulary tests, failure patterns, fixed-width lines, tokens and phonetic search."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds of lexical tokens, in order of their codes.
KINDS = ["identifier", "number", "string", "comment", "space", "punctuation"]
#: Tokens handed back at a time.
BATCH_TOKENS = 20_000
_TOKEN = re.compile(r"(?P<identifier>[A-Za-z_]\w*)|(?P<number>\d[\w.]*)|(?P<string>\"(?:\\.|[^\"\\])*\"?)|(?P<comment>//[^\n]*)|(?P<space>\s+)|(?P<punctuation>.)", re.DOTALL)


def words_of(text: Column) -> Column:
    """Lower-cased letter runs."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), F.lit(1))


def in_vocabulary(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Tokens (column word) that a closed vocabulary holds, whatever their case."""
    small = vocabulary.select(F.lower("word").alias("_word")).distinct()
    small = F.broadcast(small) if small.limit(500_001).count() <= 500_000 else small
    return tokens.join(small, F.lower("word") == F.col("_word"), "left_semi")


def vocabulary_index(vocabulary: DataFrame) -> DataFrame:
    """(word, place): a dense number for each distinct word, ascending; counted in two steps, without one global window."""
    distinct = vocabulary.select("word").where("word IS NOT NULL").distinct()
    keyed = distinct.withColumn("_head", F.substring("word", 1, 2))
    heads = keyed.groupBy("_head").agg(F.count(F.lit(1)).alias("n"))
    before = heads.withColumn("before", F.sum("n").over(Window.orderBy("_head").rowsBetween(Window.unboundedPreceding, -1)))
    place = F.row_number().over(Window.partitionBy("_head").orderBy("word"))
    return keyed.join(before.select("_head", "before"), "_head").select("word", (place - 1 + F.coalesce("before", F.lit(0))).alias("place"))


def match_patterns(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """Rows (subject, predicate) with the first registered pattern that fits, or null; patterns are folded before the join."""
    first = patterns.groupBy("subject", "predicate").agg(F.min_by(F.struct("pattern_id", "severity"), "pattern_id").alias("p"))
    return rows.join(F.broadcast(first) if patterns.limit(2049).count() <= 2048 else first, ["subject", "predicate"], "left").select(*[rows[c] for c in rows.columns], F.col("p.pattern_id").alias("pattern_id"), F.col("p.severity").alias("severity"))


def escalate(incidents: DataFrame, start: int = 1, systemic: int = 3) -> DataFrame:
    """(pattern_id, frequency, level): the count of each pattern on top of ``start``; from ``systemic`` on it is systemic."""
    counts = incidents.where("pattern_id IS NOT NULL").groupBy("pattern_id").agg((F.count(F.lit(1)) + start).alias("frequency"))
    return counts.withColumn("level", F.when(F.col("frequency") >= systemic, "systemic").otherwise("incident"))


def fixed_width(line: Column, fields: int | None = None) -> Column:
    """Fields of a line that runs of two or more blanks part."""
    parts = F.split(F.trim(line), " {2,}")
    return parts if fields is None else F.slice(parts, 1, fields)


def census_line(line: Column) -> Column:
    """(subject, target, age) of a census line of twelve or more fields that starts with a number; else null."""
    f = fixed_width(line)
    subject = F.concat_ws(" ", F.substring(F.get(f, F.lit(3)), 1, 14), F.substring(F.get(f, F.lit(4)), 1, 1))
    good = (F.size(f) >= 12) & F.get(f, F.lit(0)).rlike(r"^\d+$")
    return F.when(good, F.struct(subject.alias("subject"), F.get(f, F.lit(11)).alias("target"), F.get(f, F.lit(5)).alias("age")))


def tokenise(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, place, kind, lexeme): lexical tokens of code-like text.  Strings and comments need one left-to-right scan, done in Arrow batches."""
    kind_of_id = rows.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            id_type, found = batch.schema.field(0).type, []

            def out() -> pa.RecordBatch:
                keys, at, kind, lexeme = zip(*found, strict=True)
                return pa.RecordBatch.from_arrays([pa.array(keys, id_type), pa.array(at, pa.int64()), pa.array(kind), pa.array(lexeme)], ["id", "place", "kind", "lexeme"])

            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                key = key.as_py()
                for m in _TOKEN.finditer(text.as_py() or ""):
                    found.append((key, m.start(), m.lastgroup, m.group()))
                    if len(found) == BATCH_TOKENS:
                        yield out()
                        found.clear()
            if found:
                yield out()

    return rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(work, f"id {kind_of_id}, place long, kind string, lexeme string").withColumnRenamed("id", id_col)


def triple(subject: Column, verb: Column, target: Column, verbs: dict[str, int], most: int = 16) -> Column:
    """(opcode, subject, predicate, target) with names cut to ``most`` bytes of ASCII; unknown verbs have a null opcode."""
    code = F.element_at(F.create_map(*[F.lit(x) for kv in verbs.items() for x in kv]), verb)
    return F.struct(code.cast("long").alias("opcode"), F.substring(subject, 1, most).alias("subject"), F.substring(verb, 1, most).alias("predicate"), F.substring(target, 1, most).alias("target"))


def soundex_precision(names: DataFrame, group: str, name: str, wanted: str) -> DataFrame:
    """(grp, hits, exact, precision) of a phonetic search for ``wanted`` in each group of names."""
    hits = names.where(F.soundex(name) == F.soundex(F.lit(wanted)))
    return hits.groupBy(F.col(group).alias("grp")).agg(F.count(F.lit(1)).alias("hits"), F.count_if(F.lower(name) == wanted.lower()).alias("exact")).withColumn("precision", F.round(F.col("exact") / F.col("hits"), 6))


def token_header(kind: Column, lexeme: Column) -> Column:
    """(opcode, subject, predicate) of a token: the code of its kind, its first sixteen bytes, and ``lex_token``."""
    code = F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind)
    return F.struct(code.alias("opcode"), F.substring(F.encode(lexeme, "UTF-8"), 1, 16).alias("subject"), F.lit("lex_token").alias("predicate"))


def note_cell(notes: DataFrame, room: int = 952) -> DataFrame:
    """Notes (title, body) as cells: a title that does not fit is refused, a body is cut to the rest; its true length stays."""
    left = F.lit(room) - F.octet_length(F.encode("title", "UTF-8"))
    body = F.encode("body", "UTF-8")
    rest = [c for c in notes.columns if c not in ("title", "body")]
    return notes.where(left >= 0).select(*rest, "title", F.substring(body, F.lit(1), left).alias("body"), F.octet_length(body).cast("long").alias("body_bytes"), (F.octet_length(body) > left).alias("truncated"))


def id128(name: Column) -> Column:
    """A 128-bit id of a name, in hex."""
    return F.md5(F.encode(name, "UTF-8"))


def hex_payload(data: Column, size: int) -> Column:
    """The first ``size`` bytes as lower-case hex, filled up with zeros."""
    return F.rpad(F.lower(F.hex(F.substring(data, 1, size))), 2 * size, "0")
