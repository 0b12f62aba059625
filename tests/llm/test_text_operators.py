"""Quality rules, language ID, token counts, encoding and fingerprints."""

import hashlib
import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest

from trove.llm import byte_bpe, language_id, token_counts, vocabularies
from trove.llm.catalog import tokenizer_file
from trove.llm.fingerprints import anchor_table, compare_edits, fingerprint
from trove.llm.quality_rules import CONSISTENCY, CUTOFF, FLOORS, SUPPORT, robust_outliers, text_statistics
from trove.llm.words import LONGEST_WORD

JSON, RANKS = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("byte_bpe_50k.tiktoken")
PARTS = ["a", "b", " ", "  ", "\n", "\t", "'", "'s", "'re", "'ve", "l", "1", "9", "é", "#", "<|endoftext|>", "\xa0", "\u3000", "word", " the", "😀", "!", "\r\n", "²", "α", "\x1c", "\x85", "\u0301"]


def mixed(n, size, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choices(PARTS, k=rng.randint(0, size))) for _ in range(n)]


# ---- quality rules


def base_stats(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {p for k in range(len(w) - 2) if windows[w[k], w[k + 1], w[k + 2]] > 1 for p in (k, k + 1, k + 2)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_base_statistics_match_brute_force(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choices(["a", "b", "c#", "d\nd", "\u3000e", "$"], k=rng.randint(0, 60))) for _ in range(200)] + mixed(100, 40) + [None, "", " "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in text_statistics(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base_stats(texts[r.doc_id]), texts[r.doc_id]


def true_mcd(x):
    """(log determinant, distances): concentration on sorted half-samples until they stay the same, from many random starts."""
    floors, h, best = np.diag(np.array(FLOORS) ** 2), int(np.ceil(SUPPORT * len(x))), None
    rng = np.random.default_rng(1)
    for k in range(60):
        half = np.arange(len(x)) if k == 0 else rng.choice(len(x), 6, replace=False)
        for _ in range(100):
            mean = x[half].mean(0)
            cov = np.cov(x[half].T, bias=True) * CONSISTENCY + floors
            d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            following = np.sort(np.argsort(d, kind="stable")[:h])
            if len(following) == len(half) and (following == half).all():
                break
            half = following
        logdet = np.linalg.slogdet(cov)[1]
        if best is None or logdet < best[0]:
            best = logdet, d
    return best


def test_distances_match_a_plain_mcd_and_reject_the_odd_ones(spark):
    rng = random.Random(5)
    clean = [" ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(rng.randint(60, 200))) for _ in range(150)]
    odd = [re.sub(" ", "*** ", t) for t in clean[:12]]
    rows = [(i, t, "en", "s") for i, t in enumerate(clean + odd)]
    got = {r.doc_id: r for r in robust_outliers(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i].kept for i in range(150)) and not any(got[i].kept for i in range(150, 162))
    s = np.array([base_stats(t) for t in clean + odd], float)
    lines = np.ones(len(s))
    x = np.stack([np.log(s[:, 1] / s[:, 0]), np.log1p(100 * s[:, 2] / s[:, 0]), np.arcsin(np.sqrt(s[:, 3] / lines)), np.arcsin(np.sqrt(s[:, 4] / s[:, 0]))], 1)
    want = true_mcd(x)[1]
    found = np.array([got[i].d2 for i in range(len(s))])
    assert np.allclose(found, want, rtol=0.25, atol=0.25)  # binned half-samples and three starts, against sorted ones and sixty starts
    assert (want[:150] <= CUTOFF).all() and (want[150:] > CUTOFF).all()


def test_no_two_pairs_share_a_group(spark):
    from trove.llm.quality_rules import group_of

    pairs = [(None, "a"), ("\x00", "a"), ("", "a"), ("a", None), ("a\x1fb", "c"), ("a", "b\x1fc"), ("lang", "a"), (None, None)]
    stats = spark.createDataFrame([(*p, True) for p in pairs for _ in range(70)], "lang string, source string, usable boolean")
    groups = group_of(stats).collect()
    assert len(groups) == len(pairs) == len({g.grp for g in groups})


def test_a_third_of_identical_junk_does_not_hide_itself(spark):
    rng = random.Random(7)
    clean = [" ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(rng.randint(60, 200))) for _ in range(100)]
    junk = " ".join(f"w{i}$$$" for i in range(70))
    for n in (50, 75):  # a third and three sevenths of the group
        rows = [(i, t, "en", "s") for i, t in enumerate(clean + [junk] * n)]
        got = {r.doc_id: r.kept for r in robust_outliers(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
        assert all(got[i] for i in range(100)) and not any(got[i] for i in range(100, 100 + n))


def test_small_groups_are_pooled(spark):
    rng = random.Random(6)
    rows = [(i, " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(60)), "en" if i < 100 else "de", f"s{i % 7}") for i in range(130)]
    rows.append((999, " ".join("x$$$$" for _ in range(30)) + " " + " ".join(f"w{i}$$$" for i in range(40)), "de", "s1"))
    got = {r.doc_id: r for r in robust_outliers(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert len(got) == 131 and got[120].d2 is not None and not got[999].kept


def test_quality_edge_cases(odd_docs, no_docs):
    got = robust_outliers(odd_docs).collect()
    assert len(got) == 9 and robust_outliers(no_docs).count() == 0
    for r in got:
        assert r.kept is not None and r.base_failed is not None and (not r.kept or not r.base_failed)
    assert [r for r in got if r.doc_id == 3][0].kept


# ---- language


def test_profiles_match_a_counter(spark):
    texts = [("en", "The cat. the cat 12 the"), ("de", "Der Hund, der hund"), ("en", "cat")]
    df = spark.createDataFrame(texts, "lang string, text string")
    got = {(r.lang, r.gram): r.place for r in language_id.train_profiles(df, size=8).collect()}
    for lang in ("en", "de"):
        counts = Counter()
        for la, t in texts:
            if la == lang:
                line = " " + " ".join(re.findall(r"[a-z]+", t.lower())) + " "
                counts.update(g for n in (1, 2, 3) for g in (line[i : i + n] for i in range(len(line) - n + 1)) if g != " ")
        pack = lambda g: sum(ord(c) << 21 * k for k, c in enumerate(reversed(g)))
        best = sorted(counts, key=lambda g: (-counts[g], pack(g)))[:8]
        assert [got[lang, pack(g)] for g in best] == list(range(1, 9))


def test_profiles_do_not_depend_on_how_texts_are_dealt(spark):
    texts = [("en", t) for t in ["ab", "cd", "12", "", "ab e", "--", "fg ab"]] * 5 + [("de", "3"), ("de", "4")]
    df = spark.createDataFrame(texts, "lang string, text string")
    found = [sorted(map(tuple, language_id.train_profiles(df.repartition(n)).collect())) for n in (1, 3, 16)]
    assert found[0] == found[1] == found[2]
    code = lambda g: sum(ord(c) << 21 * k for k, c in enumerate(reversed(g)))
    seen = {r[1] for r in found[0]}
    assert code("b e") in seen and code("b c") not in seen and code("  ") not in seen and {r[0] for r in found[0]} == {"en"}


def test_long_texts_count_like_short_ones(monkeypatch):
    line = language_id.letters(" ".join(mixed(400, 30)))
    whole = language_id.count(line)
    monkeypatch.setattr(language_id, "SLICE", 50)
    parts = language_id.count(line)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def plain_prediction(text, profiles, size=language_id.PROFILE):
    """Rank-order distance by dictionaries."""
    line = " " + " ".join("".join(c if unicodedata.category(c)[0] in "LM" else " " for c in (text or "").lower()).split(" ")) + " "
    line = re.sub(" +", " ", line)
    counts = Counter(g for n in (1, 2, 3) for g in (line[i : i + n] for i in range(len(line) - n + 1)) if g != " ")
    if not any(unicodedata.category(c)[0] == "L" for c in line):
        return "und", 0.0
    pack = lambda g: sum(ord(c) << 21 * k for k, c in enumerate(reversed(g)))
    top = [pack(g) for g in sorted(counts, key=lambda g: (-counts[g], pack(g)))[:size]]
    totals = {lang: sum(abs(ranks[g] - 1 - k) if g in ranks else size for k, g in enumerate(top)) for lang, ranks in sorted(profiles.items())}
    best = min(totals, key=totals.get)
    return best, 1 - totals[best] / (size * len(top))


def test_predictions_match_dictionaries(spark):
    from trove.llm.catalog import op3_language_id
    from trove.plans.tables import table

    d = "/root/testdata/sf0.001"
    docs = table(spark, d, "documents")
    profiles = {}
    for r in language_id.train_profiles(docs.where(~language_id.held_out(docs["doc_id"]))).collect():
        profiles.setdefault(r.lang, {})[r.gram] = r.place
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in op3_language_id(spark, d).collect():
        lang, score = plain_prediction(texts[r.doc_id], profiles)
        assert r.lang_pred == lang and r.score == pytest.approx(score)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_language_accuracy_on_held_out(spark):
    from trove.llm.catalog import op3_language_id
    from trove.plans.tables import table

    d = "/root/testdata/sf0.001"
    found = op3_language_id(spark, d).join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(found) > 20 and np.mean([r.lang == r.lang_pred for r in found]) > 0.95
    assert all(0 <= r.score <= 1 for r in found)


def test_language_edge_cases(odd_docs, no_docs):
    profiles = language_id.collect_profiles(language_id.train_profiles(odd_docs))
    got = {}
    for r in language_id.identify(odd_docs, profiles, keep=["rule", "id"]).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert len(got[4]) == 2 and len(got[None]) == 1 and got[4][0].in_rule == "x"
    for key in (1, 2, 6, 7):
        assert got[key][0].lang_pred == "und" and got[key][0].score == 0
    none = language_id.collect_profiles(language_id.train_profiles(no_docs))
    assert {r.lang_pred for r in language_id.identify(odd_docs, none).collect()} == {"und"}
    assert language_id.identify(no_docs, profiles).count() == 0


# ---- tokens


def test_ids_and_counts_are_those_of_the_library():
    library = vocabularies.tokenizer(JSON)
    texts = mixed(3000, 40)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [vocabularies.ids(t, JSON, RANKS).tolist() for t in texts] == want
    assert token_counts.lengths(texts, JSON).tolist() == [len(w) for w in want]
    for t, w in zip(texts[:500], want, strict=False):
        assert "".join(vocabularies.pieces(t, 7)) == t
        assert sum(vocabularies.count(list(vocabularies.pieces(t, 7)), JSON)) == len(w)


def test_long_texts_without_blanks_are_cut_at_punctuation():
    rng = random.Random(9)
    for letters in ("abcXYZ", "一二三龥", "ぁんァヺ", "가힣", "กฮ"):
        text = "".join(rng.choices([*letters, ",", "。", "、", ".", "'", "1", "<|endoftext|>"], k=2000))
        parts = list(vocabularies.pieces(text, 100))
        assert len(parts) > 10 and "".join(parts) == text
        assert sum(vocabularies.count(parts, JSON)) == len(vocabularies.tokenizer(JSON).encode(text, add_special_tokens=False).ids)
    assert list(vocabularies.pieces("a" * 1000, 100)) == ["a" * 1000]


def test_vectorised_encoding_matches_the_library(monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHED_TOKENS", 500)
    library, vocab = vocabularies.rank_encoding(RANKS), byte_bpe.vocabulary(RANKS)
    texts, known = mixed(3000, 30, seed=2) + ["x" * 300, "ab" * 100, ""], {}
    for at in range(0, len(texts), 700):
        for t, (ids, offsets) in zip(texts[at : at + 700], vocab.encode(texts[at : at + 700], known), strict=True):
            assert ids.tolist() == library.encode_ordinary(t), t
            assert vocab.decode(ids) == t.encode() and offsets[-1] == len(ids)


def test_every_code_point_has_the_class_of_the_library():
    """One text a code point between letters and digits: a wrong class would move a boundary."""
    library, vocab = vocabularies.rank_encoding(RANKS), byte_bpe.vocabulary(RANKS)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3400 or c % 17 == 0)]
    texts = [f"a{chr(c)}b {chr(c)}1" for c in points]
    for at in range(0, len(texts), 20_000):
        for t, (ids, _) in zip(texts[at : at + 20_000], vocab.encode(texts[at : at + 20_000], {}), strict=True):
            assert ids.tolist() == library.encode_ordinary(t), (t, hex(ord(t[1])))


def test_token_edge_cases(odd_docs, no_docs):
    got = {}
    for r in token_counts.count_tokens(odd_docs, JSON).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert got[1][0].n_tokens == got[1][0].n_bytes == 0 and got[3][0].over_limit and len(got[4]) == 2
    assert token_counts.count_tokens(no_docs, JSON).count() == 0
    trip = {r.doc_id: r for r in byte_bpe.round_trip(odd_docs, RANKS).collect()}
    assert trip[2].decoded_sha256 == hashlib.sha256(b"").hexdigest() == trip[1].ids_sha256 and byte_bpe.round_trip(no_docs, RANKS).count() == 0
    coded = byte_bpe.encode_table(odd_docs, RANKS)
    back = {r.doc_id: bytes(r.decoded).decode() for r in byte_bpe.decode_table(coded, RANKS).collect()}
    texts = {r.doc_id: r.text or "" for r in odd_docs.collect()}
    assert back == texts


# ---- fingerprints


def spark_hash(parts):
    import xxhash

    h = 42
    for p in parts:
        h = xxhash.xxh64_intdigest(p.encode() if isinstance(p, str) else p.to_bytes(8, "little", signed=True), seed=h)
    return h - 2**64 if h >= 2**63 else h


def words(text):
    return [p for w in re.split(r"[ \t\n\x0b\f\r]+", text) if w for p in ([w] if len(w) <= LONGEST_WORD else w)]


def anchors(text):
    """(place, hash) of each anchor."""
    w = words(text)
    if len(w) < 5:
        return [(0, spark_hash([" ".join(w)]) >> 32)] if w else []
    r = [spark_hash(p) for p in zip(w, w[1:], strict=False)]
    return [(j, spark_hash((r[j], r[j + 2], r[j + 3])) >> 32) for j in range(len(w) - 4) if min(r[j], r[j + 3]) <= min(r[j + 1], r[j + 2])]


def plain_likeness(a, b):
    x, y = ({h: p for p, h in reversed(k)} for k in (a, b))
    if not x and not y:
        return 1.0
    shifts = [y[h] - p for p, h in sorted((p, h) for h, p in x.items()) if h in y]
    near = lambda k: any(0 <= i < len(shifts) and shifts[i] == shifts[k] for i in (k - 1, k + 1))
    matched = len(shifts) if min(len(x), len(y)) == 1 else sum(map(near, range(len(shifts))))
    return 2 * matched / (len(x) + len(y))


@pytest.mark.parametrize("first_id", [0, 2**62])
def test_fingerprints_match_brute_force(spark, first_id):
    rng = random.Random(4)
    texts = [" ".join(rng.choices(["aa", "bb", "cc", "dd", "é", "ff", "gg"], k=rng.randint(0, 50))) for _ in range(60)]
    texts += [texts[0], "", *["".join(rng.choices("一二三四五六七八九十", k=200)) for _ in range(4)], "x" * 60 + " aa bb cc"]
    ids = [first_id + i * 3 % 67 - (2**63 if first_id and i % 2 else 0) for i in range(len(texts))]
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(5)
    order = sorted(zip(ids, texts, strict=True))
    got = {r.doc_id: r for r in compare_edits(df).collect()}
    assert len(got) == len(texts)
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        q = len(t) // 4
        e = t[: len(t) - q] + following[:q]
        hexed = lambda text: "".join(f"{h & 0xFFFFFFFF:08X}" for _, h in anchors(text))
        assert got[i].edited_sha256 == hashlib.sha256(e.encode()).hexdigest() and got[i].n_chars == len(t)
        assert got[i].fingerprint == hexed(t) and got[i].edited_fingerprint == hexed(e)
        assert got[i].near_edited == pytest.approx(plain_likeness(anchors(t), anchors(e)))
        assert got[i].near_next == pytest.approx(plain_likeness(anchors(t), anchors(following)))
        if len(t) == 200:  # a text without blanks
            assert 0.4 < got[i].near_edited < 1


def test_many_rows_of_one_id_spread_over_pieces(spark):
    from pyspark.sql import functions as F

    from trove.llm.fingerprints import in_pieces, order_key

    rows = [(None if i % 3 else i, f"text {i} of many") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    keyed = df.withColumn("key", order_key(F.col("doc_id"), F.col("text")))
    sizes = [r["count"] for r in in_pieces(keyed, "key").where("_tail = 0").groupBy("_piece").count().collect()]
    assert sum(sizes) == 3000 and max(sizes) < 600
    got = compare_edits(df).collect()
    assert len(got) == 3000 and all(r.edited_sha256 is not None and r.near_next is not None for r in got)


def test_fingerprint_edge_cases(spark, odd_docs, no_docs):
    got = compare_edits(odd_docs).collect()
    assert len(got) == 9 and compare_edits(no_docs).count() == 0
    same = [r.fingerprint for r in got if r.doc_id == 4 or r.doc_id is None]
    assert len(set(same)) == 1 and [r for r in got if r.doc_id == 1][0].fingerprint == ""
    one = compare_edits(spark.createDataFrame([(5, "a b c d e f g h")], "doc_id long, text string")).first()
    assert one.near_next == 1.0
    prints = {r.doc_id: r.fingerprint for r in fingerprint(odd_docs).collect()}
    texts = {r.doc_id: r.text or "" for r in odd_docs.collect()}
    table = anchor_table(odd_docs)
    assert len(prints[3]) == 8 * table.where("doc_id = 3").count()
    assert sorted((r.place, r.anchor) for r in table.where("doc_id = 8").collect()) == anchors(texts[8])
