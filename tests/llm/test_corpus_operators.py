"""URL filters, near duplicates, packing, archives, shards and the pipeline."""

import io
import random
import zlib
from itertools import pairwise

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trove.llm import components as components_of
from trove.llm import order_minhash as omh
from trove.llm import packing, warc
from trove.llm.catalog import URL_RULES, tokenizer_file
from trove.llm.components import components, extended
from trove.llm.training_order import END_ID, numbered, permute, read_shards, sequences, training_order, with_slots, write_shards
from trove.llm.url_filters import filter_urls, rule_table
from trove.plans.scratch import materialise, scratch_path

JSON, RANKS = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("byte_bpe_50k.tiktoken")


# ---- URL filters

URLS = [
    "http://a.example.com/en/7", "https://EXAMPLE.com/en/75?x#y", "http://example.com/en", "http://notexample.com/en/1", "http://x.net/de/8", "http://example.net/de/81",
    "http://m.example.net/de/8/", "ftp://org/es/", "http://b.org/es", "no scheme", "", None, "http://", "http://com/en/", "http://a..com/en/x", "http://h.com?/en/", "x://y.com://z/en/", "http://a.net/de/#en",
]


def plain_verdict(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    best = None
    for rule, verdict in rules:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = rule, verdict
    return host, path, *(best or (None, "allow"))


def test_urls_match_plain_rules(spark, monkeypatch):
    rules = [*URL_RULES, ("example.com/", "block"), ("no-slash", "block")]
    df = spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(URLS)], "page_id long, url string, host string, digest string")
    want = {i: plain_verdict(u, rules[:-1]) for i, u in enumerate(URLS)}
    for most in (100_000, 0):  # broadcast, then the salted shuffle
        monkeypatch.setattr("trove.llm.url_filters.BROADCAST_RULES", most)
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in filter_urls(df, rule_table(spark, rules)).collect()}
        assert got == want


def test_url_edge_cases(spark):
    df = spark.createDataFrame([(1, "http://a.com/en/"), (1, "http://a.com/en/"), (None, None)], "page_id long, url string")
    got = sorted((str(r.page_id), r.verdict) for r in filter_urls(df, rule_table(spark, URL_RULES)).collect())
    assert got == [("1", "block"), ("1", "block"), ("None", "allow")]
    none = spark.createDataFrame([], "rule string, verdict string")
    assert {r.verdict for r in filter_urls(df, none).collect()} == {"allow"} and filter_urls(df.limit(0), none).count() == 0
    twice = spark.createDataFrame([("com/en/", "allow"), ("com/en/", "block"), (None, "block")], "rule string, verdict string")
    assert {r.verdict for r in filter_urls(df.where("page_id = 1"), twice).collect()} == {"block"}


# ---- near duplicates


def edited(words, rng, edits):
    w = list(words)
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return w


def lcs(a, b):
    number = {w: i for i, w in enumerate(dict.fromkeys([*a, *b]))}
    x, y = (np.array([number[w] for w in t], int) for t in (a, b))
    row = np.zeros(len(y) + 1, int)
    for w in x:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (y == w)))
    return int(row[-1])


def similarity(a, b):
    """By plain alignments of the words, and of the distinct shingles in the order of their first places."""
    x, y = (list(dict.fromkeys(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))) for w in (a, b))
    common = set(x) & set(y)
    n = lcs([g for g in x if g in common], [g for g in y if g in common])
    return max(n / (len(x) + len(y) - n), lcs(a, b) / max(len(a), len(b)))


def classes_of(links, nodes):
    root = {i: i for i in nodes}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    return {i: find(i) for i in nodes}


def brute_classes(texts):
    """({id: class} by all links, the same by those that a band is nearly sure to hold: shingle Jaccard 0.6 and more)."""
    every, plain = [], []
    ids = sorted(texts)
    split = {i: texts[i].split() for i in ids}
    grams = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in split.items()}
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = split[i], split[j]
            shared = len(grams[i] & grams[j])
            near = shared / max(1, len(grams[i]) + len(grams[j]) - shared)
            if a == b:
                every.append((i, j))
                plain.append((i, j))
            elif min(len(a), len(b)) >= 5 and near > 0.03 and similarity(a, b) >= 0.8:
                every.append((i, j))
                plain += [(i, j)] * (near >= 0.6)
    return classes_of(every, ids), classes_of(plain, ids)


def between(found, most, least):
    """Whether classes join nothing beyond ``most`` and all that ``least`` joins."""
    return all(most[found[i]] == most[i] and found[least[i]] == found[i] for i in found)


def test_classes_match_all_pairs(spark):
    rng = random.Random(8)
    texts = []
    for family in range(12):
        base = [f"f{family}w{rng.randrange(500)}" for _ in range(120)]
        texts += [" ".join(edited(base, rng, rng.choice([0, 0, 1, 2, 3, 5, 9, 20]))) for _ in range(10)]
    texts += [" ".join(f"s{rng.randrange(9000)}" for _ in range(80)) for _ in range(30)] + ["a b c", "a  b c", "a b", "", " "]
    rng.shuffle(texts)
    got = {r.doc_id: r.class_id for r in omh.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    most, least = brute_classes(dict(enumerate(texts)))
    assert between(got, most, least) and len(set(got.values())) - len(set(most.values())) < 12


def test_texts_without_blanks_have_near_duplicates(spark):
    rng = random.Random(13)
    texts = []
    for _ in range(6):
        base = rng.choices("天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏闰余成岁律吕调阳云腾致雨露结为霜", k=300)
        other = list(base)
        for _ in range(9):
            other[rng.randrange(300)] = "新"
        texts += ["".join(base), "".join(other)]
    got = {r.doc_id: r.class_id for r in omh.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i in range(12)}


def test_near_duplicate_edge_cases(odd_docs, no_docs):
    got = omh.near_duplicates(odd_docs).collect()
    assert len(got) == 9 and omh.near_duplicates(no_docs).count() == 0
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].class_id == 1 and by[1][0].class_size == 1
    assert by[2][0].class_id == by[6][0].class_id == 2
    assert len(by[4]) == 2 and by[4][0].class_id == 4 and by[4][0].class_size == 2
    assert by[None][0].class_id is None and by[None][0].class_size == 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=25), st.lists(st.integers(0, 5), min_size=1, max_size=25))
def test_banded_alignment_is_the_longest_common_subsequence(a, b):
    assert omh._banded_lcs(np.array(a, np.uint64), np.array(b, np.uint64), 50) == lcs(a, b)


def moved(words, at, size, to):
    rest = [*words[:at], *words[at + size :]]
    return [*rest[:to], *words[at : at + size], *rest[to:]]


def test_a_moved_paragraph_keeps_its_link(spark):
    base = list(range(1004))
    assert omh.compare(np.array(base, np.int32), np.array(moved(base, 0, 50, 954), np.int32)) == pytest.approx(950 / 1050)
    rng = random.Random(11)
    pairs = []
    for k in range(12):
        base = [f"p{k}w{i}" for i in range(rng.randrange(150, 260))]
        size = rng.choice([8, 12, 20, 40, 60])
        pairs.append((base, moved(base, 0, size, len(base) - size)))
    rows = [(2 * k + i, " ".join(t)) for k, pair in enumerate(pairs) for i, t in enumerate(pair)]
    got = {r.doc_id: r.class_id for r in omh.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = [similarity(*pair) >= 0.8 for pair in pairs]
    assert len(set(want)) == 2 and [got[2 * k] == got[2 * k + 1] for k in range(12)] == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=5, max_size=40), st.integers(0, 12), st.integers(1, 12), st.lists(st.tuples(st.integers(0, 39), st.integers(0, 9)), max_size=6))
def test_a_link_is_an_alignment_of_enough_words_or_shingles(a, at, size, edits):
    b = moved(a, at, size, len(a))
    for place, word in edits:
        b[place % len(b)] = word
    got, want = omh.compare(np.array(a, np.int32), np.array(b, np.int32)), similarity(a, b)
    assert (got >= 0.8) == (want >= 0.8) and got <= want + 1e-9


def test_repeated_passages_meet_texts_without_them(spark):
    rng = random.Random(12)
    texts = []
    for k in range(20):
        base = [f"r{k}w{i}" for i in range(rng.randrange(100, 300))]
        at = rng.randrange(len(base) // 2)
        texts += [base, base * rng.randrange(2, 5), [*base, *base[at:] * 3]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = {r.doc_id: r.class_id for r in omh.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(omh.compare(*(np.array([int(w.split("w")[1]) for w in t], np.int32) for t in (texts[i - i % 3], texts[i]))) >= 0.8 for i in got)
    assert got == {i: i - i % 3 for i in got}


def all_links(texts):
    """Classes by all pairs of texts that an alignment links."""
    links = [(i, j) for i in range(len(texts)) for j in range(i) if texts[i] == texts[j] or (min(len(texts[i]), len(texts[j])) > 3 and similarity(texts[i], texts[j]) >= 0.8)]
    return classes_of(links, range(len(texts)))


def found_classes(spark, texts):
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    return {r.doc_id: r.class_id for r in omh.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_texts_without_a_common_shingle_meet(spark):
    rng = random.Random(21)
    texts = []
    for k in range(12):
        base = [f"e{k}w{rng.randrange(90)}" for _ in range(rng.randrange(15, 240))]
        other = [f"x{k}y{i}" if i % 5 == 4 else w for i, w in enumerate(base)]
        texts += [base, other]
    texts += [["a", "b", "c", "d", "y"] * 40, [w for i in range(40) for w in ("a", "b", "c", "d", f"z{i}")]]
    want = all_links(texts)
    assert want == {i: i - i % 2 for i in want} and found_classes(spark, texts) == want


def test_short_texts_meet_exactly(spark):
    rng = random.Random(22)
    texts = []
    for k in range(60):
        base = [f"q{k}w{rng.randrange(30)}" for _ in range(rng.randrange(3, 17))]
        other = list(base)
        for _ in range(rng.randrange(1, 4)):
            at = rng.randrange(len(other))
            other[at : at + rng.randrange(2)] = [f"n{rng.randrange(10**6)}"] * rng.randrange(2)
        texts += [base, other or ["only"]]
    want = all_links(texts)
    assert 30 < len(set(want.values())) < 110 and found_classes(spark, texts) == want


def test_links_of_a_bucket_do_not_need_its_centre(spark):
    """Forty pairs about one template: a pair's own words just make the link, others' texts share no more than the template."""
    rng = random.Random(23)
    template = [f"t{i}" for i in range(150)]
    texts = []
    for k in range(40):
        own = [f"o{k}w{i}" for i in range(10)]
        texts += [[*template, *own, *[f"m{k}s{side}w{i}" for i in range(rng.randrange(36, 40))]] for side in (0, 1)]
    want = all_links(texts)
    assert want == {i: i - i % 2 for i in want} and found_classes(spark, texts) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=25), st.lists(st.integers(0, 4), min_size=1, max_size=25), st.integers(0, 8), st.sampled_from([1, 3, 8192]))
def test_a_narrow_band_in_blocks(a, b, band, block):
    row = [0] * (len(b) + 1)
    for i, w in enumerate(a):
        last = list(row)
        for j, v in enumerate(b):
            row[j + 1] = max(last[j + 1], row[j], last[j] + (w == v and abs(i - j) <= band))
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(omh, "LCS_BLOCK", block)
        assert omh._banded_lcs(np.array(a), np.array(b), band) == row[-1]


def test_sketches_do_not_depend_on_blocks(monkeypatch):
    words = np.random.default_rng(1).integers(-(2**31), 2**31, size=700).astype(np.int32)
    whole = omh.sketch(words)
    monkeypatch.setattr(omh, "BLOCK", 33)
    assert (omh.sketch(words) == whole).all()


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 130)] + [(200, 200), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 130)} == {100} and got[200] == 200


def test_components_grow_as_at_once(spark):
    before, after = [(5, 6), (6, 9), (20, 21), (30, 31)], [(9, 21), (40, 41), (50, 50), (41, 2)]
    frame = lambda links: spark.createDataFrame(links, "a long, b long")
    grown = extended(materialise(components(frame(before)), "roots"), frame(after))
    assert sorted(map(tuple, grown.collect())) == sorted(map(tuple, components(frame(before + after)).collect()))


def test_buckets_of_two_are_done_with_their_pair(spark):
    members = spark.createDataFrame([(2, 10), (1, 10), (3, 20), (4, 20), (5, 20), (6, 30), (6, 40), (6, 40)], "id long, bucket long")
    starred, pairs, ids = omh._starred(members)
    assert {tuple(r) for r in starred.select("bucket", "id", "centre", "size").collect()} == {(20, i, 3, 3) for i in (3, 4, 5)}
    assert sorted(map(tuple, pairs.collect())) == [(1, 2), (3, 4), (3, 5)] and {r.id for r in ids.collect()} == {1, 2, 3, 4, 5, 6}


def test_copies_are_no_links(spark, monkeypatch):
    """Equal texts take the class of the one that stands for them, without a part in the rounds of the components."""
    written = []
    monkeypatch.setattr(components_of, "materialise", lambda df, tag: written.append((tag, (found := materialise(df, tag)).count())) or found)
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(i, text) for i in range(30)] + [(40, f"{text} end"), (50, "something else altogether"), (51, "something else altogether")]
    got = {r.doc_id: (r.class_id, r.class_size) for r in omh.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (0, 31) for i in (*range(30), 40)} | {50: (50, 2), 51: (50, 2)}
    assert max(n for tag, n in written if tag == "links") == 1


# ---- packing


def brute_cuts(places, costs, capacity):
    total = [0] + [10**9] * (len(places) - 1)
    for j in range(1, len(places)):
        total[j] = min(total[i] + capacity - (places[j] - places[i]) + costs[j] for i in range(j) if places[j] - places[i] <= capacity)
    return total[-1]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.integers(0, 30)), min_size=1, max_size=40))
def test_cuts_cost_the_least(steps):
    places, costs = [0, *np.cumsum([s for s, _ in steps]).tolist()], [0, *[c for _, c in steps]]
    chain = packing.best_cuts(places, costs, 20)
    cost = sum(20 - (places[j] - places[i]) + costs[j] for i, j in pairwise(chain))
    assert chain[0] == 0 and chain[-1] == len(places) - 1 and all(places[j] - places[i] <= 20 for i, j in pairwise(chain))
    assert cost == brute_cuts(places, costs, 20)


def check_pieces(pieces, ids):
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
    for key, want in ids.items():
        at = 0
        for p in sorted(by_doc.pop(key), key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(want) and p.ids_crc32 == zlib.crc32(want[at : at + p.length].tobytes())
            at += p.length
        assert at == len(want)
    assert not by_doc
    sizes = [sum(p.length for p in parts) for parts in by_sequence.values()]
    return sum(0 if n & (n - 1) == 0 else 2048 - n for n in sizes) / sum(sizes)


def encoded(texts):
    from trove.llm.vocabularies import tokenizer

    return {i: np.array(tokenizer(JSON).encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4") for i, t in texts.items()}


def test_the_buffer_costs_little_more_than_the_best_cuts(monkeypatch):
    """Whole-stream cost of the packer with a small rolling buffer against one dynamic programme over all places."""
    rng = np.random.default_rng(3)
    ends = np.zeros(10, bool)
    ends[7] = True
    monkeypatch.setattr(packing, "HORIZON", 12)
    monkeypatch.setattr(packing, "UNFIXED", 4)
    for _ in range(15):
        docs = [rng.integers(0, 10, size=rng.integers(1, 200)).astype(np.uint32) for _ in range(60)]
        packer = packing.Packer(64, ends, 0)
        for k, d in enumerate(docs):
            packer.add(k, d)
        packer.fix(last=True)
        ids = np.concatenate(docs)
        cost = np.full(len(ids) + 1, 10**6)
        cost[::64] = packing.HARD_CUT
        cost[1:][ends[ids]] = packing.SENTENCE_CUT
        cost[np.cumsum([len(d) for d in docs])] = cost[0] = 0
        sizes: dict[int, int] = {}
        for piece in packer.out:
            sizes[piece[5]] = sizes.get(piece[5], 0) + piece[2]
        at, paid, last = 0, 0, len(sizes)
        places = np.flatnonzero(cost < 10**6).tolist()
        best = brute_cuts(places, cost[places].tolist(), 64)
        for number, n in sorted(sizes.items()):
            at += n
            paid += (64 - n if n & (n - 1) else 0) + (0 if at == len(ids) else min(int(cost[at]), packing.HARD_CUT))
        assert at == len(ids) and last and paid <= 1.1 * best + 64


def test_rows_of_one_id_spread_over_partitions(spark):
    rows = [(5 if i % 3 else None, f"row {i} " * 20) for i in range(300)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), JSON, RANKS).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({p.sequence_id >> packing.LOCAL_BITS for p in pieces}) == 4
    assert sum(p.length for p in pieces) == sum(len(x) for x in encoded(dict(enumerate(t for _, t in rows))).values())


def test_packing_covers_every_id_once(spark, odd_docs, no_docs):
    rng = random.Random(2)
    texts = {i: " ".join(f"w{rng.randrange(99)}." for _ in range(rng.choice([0, 3, 50, 4000]))) for i in range(60)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert check_pieces(packing.pack(df, JSON, RANKS).collect(), encoded(texts)) < 0.02
    odd = odd_docs.where("doc_id <> 4 OR doc_id IS NULL")
    assert check_pieces(packing.pack(odd, JSON, RANKS).collect(), encoded({r.doc_id: r.text for r in odd.collect()})) < 0.5
    assert packing.pack(odd_docs.where("doc_id = 4"), JSON, RANKS).count() >= 2 and packing.pack(no_docs, JSON, RANKS).count() == 0
    with_ids = packing.pack(df, JSON, RANKS, with_ids=True).first()
    assert len(with_ids.ids) == with_ids.length


# ---- archives


def test_archives_round_trip(spark):
    html = ["<p>é</p>", "", None, "x" * 300_000, "<p>é</p>", "a\r\n\r\nb", "<p>é</p>"]
    df = spark.createDataFrame([(i, f"http://h/{i} \n", h, "clash") for i, h in enumerate(html)] + [(None, None, "<p>é</p>", None), (5, "u", "a\r\n\r\nb", None)], "page_id long, url string, html string, digest string").repartition(3)
    folder = scratch_path(spark, "warc-test")
    manifest = warc.write_archives(warc.roles(df), folder)
    got = {}
    for r in warc.read_archives(manifest, folder, payloads=True).collect():
        got.setdefault(r.page_id, []).append(r)
    for i, h in enumerate(html):
        raw = (h or "").encode()
        last = max(j for j, o in enumerate(html) if (o or "") == (h or ""))
        r = got[i][0]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), warc.base32_sha1(raw))
        assert (r.record_type, r.refers_to) == (("response", None) if i == last else ("revisit", last))
        assert r.payload is None if i != last else bytes(r.payload) == raw
    assert len(got[5]) == 2 and got[None][0].record_type == "response"
    assert warc.archive_round_trip(df.limit(0)).count() == 0
    assert {r.record_type for r in warc.archive_round_trip(df.where("page_id IS NOT NULL"), least_bytes=10**6).collect()} == {"response"}


def test_archives_take_any_url_and_have_bounded_size(spark, monkeypatch):
    long_url = "data:text/html," + "x" * 3_000_000
    df = spark.createDataFrame([(1, long_url, "<p>"), (2, None, "y" * 50), *[(i, f"http://h/{i}", str(i)) for i in range(3, 40)]], "page_id long, url string, html string").coalesce(1)
    folder = scratch_path(spark, "warc-long")
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2000)
    manifest = warc.write_archives(warc.roles(df), folder)
    assert manifest.count() > 5 and sum(r.records for r in manifest.collect()) == 39
    got = {r.page_id: r.url for r in warc.read_archives(manifest, folder).collect()}
    assert len(got) == 39 and got[1] == long_url


def test_reader_refuses_damage():
    good = warc.record(1, "http://a", b"payload" * 100, None) + warc.record(2, None, b"", 1)
    assert [warc.parse(x)["page_id"] for x in warc.read_records(io.BytesIO(good))] == [1, 2]
    with pytest.raises(warc.Damaged):
        list(warc.read_records(io.BytesIO(good[:-3])))
    wrong = zlib.compressobj(6, zlib.DEFLATED, 31)
    text = zlib.decompress(warc.record(1, "http://a", b"abc", None), 31).replace(b"abc", b"abd")
    with pytest.raises(warc.Damaged):
        list(warc.read_records(io.BytesIO(wrong.compress(text) + wrong.flush())))


# ---- training order


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 2**63))
def test_permutation_and_inverse(n, key):
    slots = permute(np.arange(n), n, key)
    assert sorted(slots) == list(range(n)) and (permute(slots, n, key, inverse=True) == np.arange(n)).all()


def test_shards_hold_every_sequence(spark, odd_docs, no_docs):
    docs = odd_docs.repartition(3)
    folder, stride = scratch_path(spark, "shards-test"), 64
    cut = sequences(docs, JSON, RANKS, stride=stride).cache()
    rows, n = numbered(cut)
    manifest = write_shards(with_slots(rows, n, 9, 16), n, folder, 16)
    back = read_shards(manifest, folder, n, 9, stride=stride, with_ids=True).collect()
    want = {r.sequence: bytes(r.ids) for r in rows.collect()}
    assert sorted(r.slot for r in back) == list(range(n)) and {r.sequence: bytes(r.ids) for r in back} == want
    assert sum(r.n_tokens for r in back) == sum(len(x) for t in odd_docs.collect() for x in encoded({0: t.text}).values())
    later = read_shards(manifest, folder, n, 9, from_slot=21, stride=stride).collect()
    assert sorted(r.slot for r in later) == list(range(21, n))
    assert training_order(no_docs, JSON, RANKS).count() == 0 and END_ID < 65535


def test_sequences_name_their_documents(spark, odd_docs):
    """Against a replay of the permutation over plainly concatenated documents of one block."""
    docs = odd_docs.coalesce(1)
    held = [(r.doc_id, i) for r in docs.collect() for i in [*encoded({0: r.text})[0][:-1].tolist(), END_ID]]
    n = -(-len(held) // 64)
    slots = permute(np.arange(n), n, 3)
    got = {r.sequence: r for r in training_order(docs, JSON, RANKS, key=3, stride=64, shard_rows=16).collect()}
    assert len(got) == n
    for k in range(n):
        part = held[64 * k : 64 * (k + 1)]
        row = np.full(64, 65535, "<u2")
        row[: len(part)] = [i for _, i in part]
        assert (got[k].slot, got[k].n_tokens, got[k].ids_crc32) == (slots[k], len(part), zlib.crc32(row.tobytes()))
        assert list(dict.fromkeys(got[k].doc_ids)) == list(dict.fromkeys(d for d, _ in part))


def test_large_vocabularies_take_four_bytes(spark, odd_docs, monkeypatch):
    from trove.llm import training_order as module

    monkeypatch.setattr(module, "width", lambda *a: 4)
    got = training_order(odd_docs.coalesce(2), JSON, RANKS, key=3, stride=64, shard_rows=16).collect()
    assert sum(r.n_tokens for r in got) == sum(len(x) for t in odd_docs.collect() for x in encoded({0: t.text}).values())


def _families(rng):
    """Texts of one small vocabulary, all of about a length; every third one an edit of the one before it."""
    texts = []
    for i in range(60):
        n = rng.randrange(150, 200)
        words = [f"w{min(int(rng.expovariate(0.02)), 300)}" for _ in range(n)]
        if i % 3 == 2:
            words = [f"x{k}" if k % 7 == 3 else w for k, w in enumerate(texts[-1])]
        texts.append(words)
    return texts


def test_words_are_read_for_possible_links_only(spark, monkeypatch):
    texts = _families(random.Random(31))
    written = {}

    def counted(df, tag, write=omh.materialise):
        table = write(df, tag)
        written[tag] = written.get(tag, 0) + table.count()
        return table

    monkeypatch.setattr(omh, "materialise", counted)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    for cell_words in (omh.CELL_WORDS, 500):  # one cell a bucket, and several
        monkeypatch.setattr(omh, "CELL_WORDS", cell_words)
        written.clear()
        got = {r.doc_id: r.class_id for r in omh.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == {i: i - (i % 3 == 2) for i in range(60)}
        # 1,770 pairs of texts share words; 20 are links
        assert 20 <= written["omh-compared"] <= 60


def test_marks_never_rule_a_link_out():
    rng = np.random.default_rng(32)
    texts = [rng.zipf(1.3, size=n).astype(np.int32) % 500 for n in rng.integers(5, 400, size=60)]
    for t in texts[:30]:  # edits around the threshold, and repeats
        kept = t[rng.random(len(t)) > 0.2]
        texts += [kept if len(kept) else t, np.concatenate((t, t[: len(t) // 4])), np.tile(t, 2)]
    unequal = [(i, j) for i in range(len(texts)) for j in range(i) if not np.array_equal(texts[i], texts[j])]
    x, y = np.array(unequal).T
    labelled = [omh.labelled(omh._mix(t.astype(np.int64).astype(np.uint64))) for t in texts]
    distinct = [np.unique(omh.shingles(t)) for t in texts]
    docs = {
        "n_words": np.array([len(t) for t in texts]), "n_shingles": np.array([len(d) for d in distinct]),
        "word_marks": [omh._marks(h, omh.WORD_BITS) for h in labelled], "shingle_marks": [omh._marks(d, omh.SHINGLE_BITS) for d in distinct],
    }
    possible = omh._possible(docs, x, y)
    linked = np.array([omh.compare(texts[i], texts[j]) >= omh.SIMILARITY for i, j in unequal])
    assert linked.sum() > 30 and not (linked & ~possible).any()
    assert possible.sum() < len(unequal) / 4


def test_meetings_hold_each_pair_of_a_cell_once(monkeypatch):
    monkeypatch.setattr(omh, "PAIRS", 5)
    cell = np.array([0, 0, 0, 0, 1, 1, 2, 2, 2])
    side = np.array([omh.BOTH, omh.BOTH, omh.EVERY, omh.EVERY, omh.EVERY, omh.EVERY, omh.FEW, omh.EVERY, omh.EVERY])
    met = [(int(i), int(j)) for x, y in omh._meetings(cell, side) for i, j in zip(x, y, strict=True)]
    assert sorted(tuple(sorted(p)) for p in met) == [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (6, 7), (6, 8)]
    ours = [np.array(b) for b in ([3, 5], [3, 5], [5], [5])]
    first = omh._first_meetings(np.array([5, 5, 5, 5]), ours, np.array([0, 0, 1]), np.array([1, 2, 3]))
    assert first.tolist() == [False, True, True]
