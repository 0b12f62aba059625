"""Admission gates, provenance bits, routing cascades and pointer geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trove.functions.hashing import token_hash16

#: Bits of a record's flags.
CAPABLE, IMMUTABLE, FORBIDDEN = 1, 2, 8
FORBIDDEN_OPCODE = 0x200000
#: Provenance fields as (shift, bits); bits 4 to 7 belong to chains.
FIELDS = {"source": (0, 4), "outcome": (8, 4), "hop": (12, 4), "embedder": (16, 16), "session": (32, 16), "ticket": (48, 16)}


def gate_code(subject: Column, predicate: Column, target: Column, opcode: Column, flags: Column, epoch: Column, denied: list[str], tokens: list[str], current: int, compat: bool = False) -> Column:
    """First failing gate: 1 denied subject, 4 forbidden token, 2 no capability, 3 immutable, 5 old epoch (2 if ``compat``); else 0."""
    forbidden = (flags.bitwiseAND(FORBIDDEN) != 0) | (opcode == FORBIDDEN_OPCODE)
    for token in tokens:
        forbidden = forbidden | F.contains(predicate, F.lit(token)) | F.contains(F.coalesce(target, F.lit("")), F.lit(token))
    return (
        F.when(subject.isin(denied), 1)
        .when(forbidden, 4)
        .when(flags.bitwiseAND(CAPABLE) == 0, 2)
        .when(flags.bitwiseAND(IMMUTABLE) != 0, 3)
        .when(epoch < current, 2 if compat else 5)
        .otherwise(0)
        .cast("long")
    )


def load_target(busy_a: Column, locked_a: Column, busy_b: Column, priority: Column, size: Column) -> Column:
    """0 elsewhere, 1 the second machine, 2 the first; unknown priorities count as the lowest.

    Fixed values: 80 and 85 per cent for normal work, 90 per cent and 8192 bytes for heavy work.
    """
    p = F.when(priority.isin(0, 1, 2, 3), priority).otherwise(0)
    return (
        F.when(p == 3, 2)
        .when(locked_a, F.when(p == 2, 1).otherwise(0))
        .when(p == 0, 0)
        .when(p == 1, F.when((busy_a > 80) | (busy_b > 85), 0).otherwise(1))
        .otherwise(F.when((size > 8192) & (busy_a < 90), 2).otherwise(1))
        .cast("long")
    )


def liveness(alive: Column, idle: Column, advanced: Column) -> Column:
    """dead, active, idle or hung from three observations."""
    return F.when(~alive, "dead").when(~idle, "active").when(~advanced, "idle").otherwise("hung")


def pack_bits(**fields: Column) -> Column:
    """Provenance fields packed into one long; each is held to its width."""
    total = F.lit(0).cast("long")
    for name, value in fields.items():
        shift, bits = FIELDS[name]
        total = total.bitwiseOR(F.shiftleft(value.cast("long").bitwiseAND(F.lit((1 << bits) - 1)), shift))
    return total


def unpack_bits(packed: Column, name: str) -> Column:
    """One provenance field of a packed long."""
    shift, bits = FIELDS[name]
    return F.shiftrightunsigned(packed, shift).bitwiseAND(F.lit((1 << bits) - 1))


def provenance(source: Column, outcome: Column, hop: Column, embedder: Column, session: Column, ticket: Column) -> Column:
    """Pack with the three names folded to 16-bit hashes."""
    return pack_bits(source=source, outcome=outcome, hop=hop, embedder=token_hash16(embedder), session=token_hash16(session), ticket=token_hash16(ticket))


def descriptor_error(embedder: Column, session: Column, hop: Column, source: Column, expected: str, most: int = 64) -> Column:
    """Name of the first fault of a provenance descriptor, or null."""
    return (
        F.when(F.octet_length(embedder) > most, "embedder_too_long")
        .when(F.octet_length(session) > most, "session_too_long")
        .when(hop > 4, "hop")
        .when(embedder != expected, "embedder")
        .when((source == 0) | (session == ""), "incomplete")
    )


def majority_bits(rows: DataFrame, group: str, value: str, bits: int) -> DataFrame:
    """(group, folded): bits that more than half of a group's values have set."""
    sums = [F.sum(F.shiftright(value, b).bitwiseAND(F.lit(1))).alias(f"b{b}") for b in range(bits)]
    totals = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), *sums)
    folded = sum((F.when(F.col(f"b{b}") * 2 > F.col("n"), F.lit(1 << b)).otherwise(0) for b in range(bits)), F.lit(0))
    return totals.select(group, folded.cast("long").alias("folded"))


def triple_intake(line: Column, verbs: list[str], most: int = 16) -> Column:
    """(subject, verb, target, refusal) of a ``subject verb target`` line from a closed grammar."""
    parts = F.split(F.trim(line), r"\s+")
    a, v, t = F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.get(parts, F.lit(2))
    refusal = F.when(F.size(parts) != 3, "shape").when(~v.isin(verbs), "verb").when((F.octet_length(a) > most) | (F.octet_length(t) > most), "length")
    return F.struct(a.alias("subject"), v.alias("verb"), t.alias("target"), refusal.alias("refusal"))


def joint_energy(e1: Column, e2: Column, e3: Column, gap: Column, hop: Column) -> Column:
    """(energy, verdict): the third term counts unless the gap is below 0.01; 500 and more is vetoed, hops above 4 refused."""
    energy = e1 + e2 + F.when(gap < 0.01, 0.0).otherwise(e3)
    return F.struct(energy.alias("energy"), F.when(hop > 4, "refused").when(energy >= 500, "vetoed").otherwise("accepted").alias("verdict"))


def device_coordinates(x: Column, y: Column, width: Column, height: Column) -> Column:
    """(nx, ny, dx, dy): position in [0, 1] and in [-1, 1] with y up; 0 for an empty viewport."""
    nx = F.when(width > 0, x / F.nullif(width, F.lit(0.0))).otherwise(0.0)
    ny = F.when(height > 0, y / F.nullif(height, F.lit(0.0))).otherwise(0.0)
    dx = F.when(width > 0, nx * 2.0 - 1.0).otherwise(0.0)
    dy = F.when(height > 0, 1.0 - ny * 2.0).otherwise(0.0)
    return F.struct(nx.alias("nx"), ny.alias("ny"), dx.alias("dx"), dy.alias("dy"))


def inside(x: Column, y: Column, x1: float, y1: float, x2: float, y2: float) -> Column:
    """Whether a point lies in a box, edges included."""
    return x.between(x1, x2) & y.between(y1, y2)
