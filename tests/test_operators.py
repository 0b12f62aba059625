"""Known values of single operators and their refusals."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trove.functions import vectors as V
from trove.functions.hashing import fnv1a32
from trove.operators import chunks, gates, graph, ranking, record_ops
from trove.plans.scratch import scratch_path
from trove.sources import sealed


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_signals(spark):
    at = F.lit(1_000_000_000)
    ages = [0, -5_000_000, 60_000_000, 120_000_000]
    assert one(spark, *[ranking.recency(at - a, at) for a in ages]) == (1.0, 1.0, 0.5, pytest.approx(1 / 3))
    assert one(spark, *[ranking.frequency(F.lit(n)) for n in (0, 10, 90)]) == (0.0, 0.5, 0.9)
    assert one(spark, ranking.frequency(F.lit(3), half=0), ranking.recency(at - 1, at, half_life=0)) == (1.0, 0.0)
    assert one(spark, *[ranking.structural(F.lit(h)) for h in range(6)]) == (1.0, 0.8, 0.6, 0.4, 0.2, None)
    a, b, z = F.array(F.lit(1), F.lit(0)), F.array(F.lit(0), F.lit(1)), F.array(F.lit(0), F.lit(0))
    neg = F.array(F.lit(-1), F.lit(0))
    assert one(spark, *[ranking.semantic(a, x) for x in (a, neg, b)]) == (1.0, 0.0, 0.5)
    assert one(spark, *[V.cosine_distance(x, y) for x, y in ((a, a), (a, neg), (a, b), (z, z), (a, z))]) == (0.0, 2.0, 1.0, 0.0, 1.0)
    assert one(spark, V.l2(F.array(F.lit(0), F.lit(0)), F.array(F.lit(3), F.lit(4)))) == (5.0,)


def test_four_candidates(spark):
    rows = [(100, 0, 100, 0, 10), (200, 300, 1, 2, 10), (300, 10, 5, 1, -10), (400, 0, 50, 5, 0)]
    now = 10**9
    df = spark.createDataFrame([(k, 1, now - age * 10**6, n, hop, [v] * 48) for k, age, n, hop, v in rows], "key long, class_key long, last_us long, access_count long, hop long, embedding array<int>")
    query = ranking.Query(now, F.array(*[F.lit(10)] * 48), weights=ranking.Weights(0.25, 0.25, 0.25, 0.25))
    assert [r.key for r in ranking.rank_all(df, query).collect()] == [100, 300, 200]
    assert tuple(ranking.dispatch_stats(df, query).first()) == (4, 3, 1, 0)
    assert not ranking.Weights(0.5, 0.5, 0.5, 0.5).valid() and ranking.Query(0, F.lit(0), weights=ranking.Weights(2, 0, 0, 0)).effective() == ranking.Weights()
    assert ranking.top_k(df.limit(0), query, 4).count() == 0


def test_cascade_and_gates(spark):
    target = lambda a, lock, b, p, z: gates.load_target(F.lit(a), F.lit(lock), F.lit(b), F.lit(p), F.lit(z))
    assert one(spark, *[target(10, True, 10, p, 10) for p in (2, 1, 0, 3)]) == (1, 0, 0, 2)
    assert one(spark, target(81, False, 0, 1, 0), target(80, False, 85, 1, 0), target(89, False, 0, 2, 8193), target(0, False, 0, 9, 0)) == (0, 1, 2, 0)
    code = lambda s, f, e=9: gates.gate_code(F.lit(s), F.lit("p"), F.lit("t"), F.lit(1), F.lit(f), F.lit(e), ["bad"], ["tok"], 5)
    assert one(spark, code("ok", 1), code("bad", 1), code("ok", 0), code("ok", 3), code("ok", 9), code("ok", 1, 4)) == (0, 1, 2, 3, 4, 5)
    packed = gates.pack_bits(source=F.lit(3), outcome=F.lit(2), hop=F.lit(4), ticket=F.lit(65535))
    assert one(spark, *[gates.unpack_bits(packed, n) for n in ("source", "outcome", "hop", "ticket", "session")]) == (3, 2, 4, 65535, 0)
    assert one(spark, gates.liveness(F.lit(True), F.lit(True), F.lit(True))) == ("hung",)


def test_chains(spark):
    sizes = [0, 500, 960, 961, 1872, 1873, 2500, 4680, 4681]
    df = spark.createDataFrame([(n, "é" * (n // 2) + "x" * (n % 2)) for n in sizes], "n long, text string")
    parts = chunks.split_payloads(df, "n", "text")
    assert {r.key: r["count"] for r in parts.groupBy("key").count().collect()} == {0: 1, 500: 1, 960: 1, 961: 2, 1872: 2, 1873: 3, 2500: 3, 4680: 5}
    assert [r.parts for r in chunks.refused(df, "n", "text").collect()] == [6]
    back = chunks.join_payloads(parts).join(df, F.col("key") == F.col("n")).collect()
    assert all(bytes(r.data).decode() == r.text and r.fault is None for r in back)
    assert {r.fault for r in chunks.join_payloads(parts.where("seq <> 1 OR parts = 1")).where("fault IS NOT NULL").collect()} == {"parts"}


def test_notes_and_hops(spark):
    notes = [
        ("a", "---\nid: n1\ntitle: 'T'\ntags:\n- x\n- \"y\"\nscore: oops\n---\n[[b]] [[c|see c]] [[ ]] [[d]] [[open"),
        ("b", "no front matter [[n1]]"),
        ("c", "---\nid: never closed"),
        ("d", "---\ntags: [1,2,3,4,5,6,7,8,9]\n---\n"),
    ]
    got = {r.stem: r for r in graph.parse_notes(spark.createDataFrame(notes, "stem string, source_text string")).collect()}
    assert (got["a"].id, got["a"].title, got["a"].tags, got["a"].score) == ("n1", "T", ["x", "y"], 0.0)
    assert got["b"].id == "b" and got["b"].body == notes[1][1] and got["c"].body == notes[2][1] and len(got["d"].tags) == 8
    links = graph.note_edges(graph.parse_notes(spark.createDataFrame(notes[:1], "stem string, source_text string"))).collect()
    assert [(r.dst, r.alias) for r in sorted(links, key=lambda r: r.place)] == [("b", None), ("c", "see c"), ("d", None)]
    edges = spark.createDataFrame([("A", "B"), ("B", "A"), *[(f"n{i}", f"n{i + 1}") for i in range(5)]], "src string, dst string")
    assert graph.shortest_hop(edges, "A", "B") == 1 and graph.shortest_hop(edges, "n0", "n4") == 4 and graph.shortest_hop(edges, "n0", "n5") is None
    with pytest.raises(KeyError):
        graph.shortest_hop(edges, "A", "nobody")


def test_sealed_records_recover(spark):
    records = sealed.seal_all([sealed.build(0x2000 + i, b"s%d" % (i + 1), b"p", b"t", 1, i) for i in range(4)])
    plain = [14695981039346656037, 1099511628211099511]
    for i, b in enumerate(records[0][16:]):
        plain[0] = ((plain[0] ^ b) * 1099511628211) % 2**64
        plain[1] = (((plain[1] ^ b) + (b << (i % 7 * 8))) * 14695981039346656037) % 2**64
    assert records[0][:16] == b"".join(x.to_bytes(8, "little") for x in plain)
    sealed.register(spark)
    folder = scratch_path(spark, "sealed-test")
    damaged = records[:2] + [records[2][:9000] + b"!" + records[2][9001:]] + records[3:]
    spark.createDataFrame([(r,) for r in damaged], "record binary").coalesce(1).write.format("sealed").mode("append").save(folder)
    from pyarrow.fs import FileSelector, FileSystem

    files, place = FileSystem.from_uri(folder)
    (info,) = files.get_file_info(FileSelector(place))
    with files.open_append_stream(info.path, compression=None) as out:
        out.write(b"\1" * 8192)
    found = spark.read.format("sealed").load(folder)
    health = [(r.slot, r.health) for r in sorted(sealed.recover(found, 4).collect(), key=lambda r: r.slot)]
    assert health == [(0, "healthy"), (1, "healthy"), (2, "corrupt"), (3, "healthy"), (4, "torn")]
    assert [r.slot for r in sealed.recover(found, 1).orderBy("slot").collect()] == [0, 1, 2]
    assert sealed.readable(found, "dropcorrupt").count() == 3
    with pytest.raises(Exception, match="corrupt slot"):
        sealed.readable(found, "failfast").collect()
    assert sealed.faults(np.zeros((1, sealed.RECORD), np.uint8)) == ["unwritten"]


def test_kernels(spark):
    ones = F.unhex(F.repeat(F.lit("01"), 17_408))
    folded = one(spark, V.fold48(ones))[0]
    assert folded[:32] == [107] * 32 and folded[32:] == [106] * 16
    tile = F.unhex(F.repeat(F.lit("78"), 1024))
    assert one(spark, F.aggregate(V.nibbles(tile), F.lit(0), lambda t, x: t + x) * 0.5) == (-512.0,)
    assert one(spark, fnv1a32(F.lit("abc")), fnv1a32(F.lit(""))) == (0x1A47E90B, 0x811C9DC5)
    df = spark.createDataFrame([("s_0042_000123",), ("other",)], "s string")
    assert df.select(record_ops.spoke_of("s")).first()[0] == 42
