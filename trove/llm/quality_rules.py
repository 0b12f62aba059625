"""Quality rules: base text statistics and robust multivariate outliers, in DataFrame functions only.

Every text gives a vector of transformed statistics.  For each language and source the minimum covariance determinant
(MCD) location and scatter are found by concentration steps from three deterministic starts, and a document goes if
its squared Mahalanobis distance exceeds a cutoff.  One concentration step is one grouped aggregation: distances fall
into narrow logarithmic bins, each bin carries count, sums and products (pre-aggregated before the shuffle, so a hot
source moves as few rows as a small one), and a running total over the bins of a group picks the half-sample, the bin on its
edge counting in part.  Steps go on until no group's determinant moves.  Small groups are pooled by language, and then
over all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trove.plans.scratch import discard, materialise

SPACES = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
STATS = ("x_word", "x_symbol", "x_lines", "x_repeat")
#: Smallest standard deviations taken for real, in units of the transformed statistics: clean text has hardly any
#: symbols, repeated lines or repeated words, and without a floor its scatter is singular.
FLOORS = (0.08, 0.15, 0.15, 0.12)
#: 1 - 1e-8 quantile of chi-square with four degrees of freedom.
CUTOFF = 42.70
#: Share of a group that the determinant is minimised over.
SUPPORT = 0.5
#: Consistency factor of the covariance of that central share under normality, four dimensions:
#: SUPPORT / P(chi2_6 <= q) with q the SUPPORT quantile of chi2_4.
CONSISTENCY = 2.1091
MIN_GROUP = 60
#: Steps end when no log determinant moves by more than this; they settle well before the bound on their number.
SETTLED, MOST_STEPS = 0.005, 20
BINS_PER_OCTAVE = 8
SALTS = 16
MIN_WORDS = 50
P = len(STATS)


def text_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words (long) to every row.

    A window of three words becomes one long, its hash above and its position below; sorted, equal windows are
    neighbours, and the words themselves confirm them (64 bits less log2 of the word count are left for the hash).
    Null texts count as empty.  Each step is a column of its own, used several times by the next, so that Spark
    evaluates it once a row.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    long0, three = F.lit(0).cast("long"), F.lit(3).cast("long")
    low = F.col("_low")
    high = F.bitwise_not(low)

    def key(w: Column, i: Column) -> Column:
        mixed = F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2))
        return F.coalesce(mixed.bitwiseAND(high).bitwiseOR(i.cast("long")), long0)

    def same(a: Column, b: Column) -> Column:
        x, y = a.bitwiseAND(low).cast("int"), b.bitwiseAND(low).cast("int")
        equal = a.bitwiseAND(high) == b.bitwiseAND(high)
        for k in range(3):
            equal = equal & (F.get("_words", x + k) == F.get("_words", y + k))
        return F.coalesce(equal, F.lit(False))

    out = docs.withColumn("_words", F.filter(F.split(text, SPACES + "+"), lambda w: w != ""))
    out = out.withColumn("_lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    out = (
        out.withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
        .withColumn("n_symbols", (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long"))
        .withColumn("n_lines", F.size("_lines").cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("_low", (F.pow(F.lit(2.0), F.ceil(F.log2(F.size("_words") + F.lit(1.0)))) - 1).cast("long"))
        .withColumn("_keys", F.sort_array(F.transform(F.slice("_words", F.lit(1), F.greatest(F.size("_words") - 2, F.lit(0))), key)))
        .withColumn("_twice", F.filter("_keys", lambda k, i: same(k, F.get("_keys", i + 1)) | same(k, F.get("_keys", i - 1))))
        .withColumn("_at", F.sort_array(F.transform("_twice", lambda k: F.coalesce(k.bitwiseAND(low), long0))))
        .withColumn("n_repeat_words", F.aggregate(F.transform("_at", lambda x, i: F.least(F.coalesce(F.get("_at", i + 1) - x, three), three)), long0, lambda t, x: t + x))
    )
    return out.drop("_words", "_lines", "_low", "_keys", "_twice", "_at")


def statistic_vector(stats: DataFrame) -> DataFrame:
    """Add the transformed statistics: log mean word length, log symbol rate, and angles of the two repeated shares."""
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    return (
        stats.withColumn("x_word", F.log(F.greatest(F.col("word_chars") / words, F.lit(0.5))))
        .withColumn("x_symbol", F.log1p(F.lit(100.0) * F.col("n_symbols") / words))
        .withColumn("x_lines", F.asin(F.sqrt(F.col("n_dup_lines") / lines)))
        .withColumn("x_repeat", F.asin(F.sqrt(F.col("n_repeat_words") / words)))
    )


def _fit() -> list[tuple[str, Column]]:
    """Cholesky factor of the covariance columns ``c_ij`` as columns ``l_ij``, in order of evaluation."""
    steps = []
    for i in range(P):
        for j in range(i + 1):
            rest = F.col(f"c_{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l_{i}{k}") * F.col(f"l_{j}{k}")
            steps.append((f"l_{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l_{j}{j}")))
    return steps


def with_factor(fits: DataFrame) -> DataFrame:
    """Add the Cholesky factor and the log determinant to one row per fit (m_i, c_ij)."""
    for name, value in _fit():
        fits = fits.withColumn(name, value)
    logdet = sum((F.log(F.col(f"l_{i}{i}")) for i in range(1, P)), F.log(F.col("l_00")))
    return fits.withColumn("logdet", logdet * 2)


FIT_COLUMNS = [f"m_{i}" for i in range(P)] + [f"l_{i}{j}" for i in range(P) for j in range(i + 1)]


def distance(rows: DataFrame) -> DataFrame:
    """Add d2, the squared Mahalanobis distance, by forward substitution."""
    for i, x in enumerate(STATS):
        rest = F.col(x) - F.col(f"m_{i}")
        for k in range(i):
            rest = rest - F.col(f"l_{i}{k}") * F.col(f"y_{k}")
        rows = rows.withColumn(f"y_{i}", rest / F.col(f"l_{i}{i}"))
    total = sum((F.col(f"y_{i}") * F.col(f"y_{i}") for i in range(1, P)), F.col("y_0") * F.col("y_0"))
    return rows.withColumn("d2", total).drop(*[f"y_{i}" for i in range(P)])


def _moments() -> list[Column]:
    """Count, sums and products as aggregates of the statistics."""
    found = [F.count(F.lit(1)).cast("double").alias("n")]
    found += [F.sum(x).alias(f"s_{i}") for i, x in enumerate(STATS)]
    return found + [F.sum(F.col(STATS[i]) * F.col(STATS[j])).alias(f"p_{i}{j}") for i in range(P) for j in range(i + 1)]


MOMENTS = ["n"] + [f"s_{i}" for i in range(P)] + [f"p_{i}{j}" for i in range(P) for j in range(i + 1)]


def _from_moments(sums: DataFrame, scale: float) -> DataFrame:
    """Mean and floored covariance columns from weighted moments."""
    out = sums
    for i in range(P):
        out = out.withColumn(f"m_{i}", F.col(f"s_{i}") / F.col("n"))
    for i in range(P):
        for j in range(i + 1):
            cov = (F.col(f"p_{i}{j}") / F.col("n") - F.col(f"m_{i}") * F.col(f"m_{j}")) * scale
            out = out.withColumn(f"c_{i}{j}", F.greatest(cov, F.lit(0.0)) + FLOORS[i] ** 2 if i == j else cov)
    return with_factor(out)


def _starts(points: DataFrame) -> DataFrame:
    """Three fits a group: medians with quartile spreads, the floors around the medians, classical mean and covariance."""
    q = [F.percentile_approx(x, [0.25, 0.5, 0.75], 1000).alias(f"q_{i}") for i, x in enumerate(STATS)]
    base = points.groupBy("grp").agg(*q, *_moments())
    classical = _from_moments(base, 1.0).select("grp", F.lit(0).alias("start"), "logdet", *FIT_COLUMNS)
    found = classical
    for start in (1, 2):
        out = base
        for i in range(P):
            out = out.withColumn(f"m_{i}", F.col(f"q_{i}")[1].cast("double"))
            for j in range(i + 1):
                spread = (F.col(f"q_{i}")[2] - F.col(f"q_{i}")[0]) / 1.349 if start == 1 else F.lit(0.0)
                out = out.withColumn(f"c_{i}{j}", spread * spread + FLOORS[i] ** 2 if i == j else F.lit(0.0))
        found = found.unionByName(with_factor(out).select("grp", F.lit(start).alias("start"), "logdet", *FIT_COLUMNS))
    return found


def _attach(points: DataFrame, fits: DataFrame) -> DataFrame:
    """Join every point with its group's fits; the group is salted, so a hot one spreads over many tasks."""
    spread = fits.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return points.join(spread, ["grp", "salt"])


def _concentrate(points: DataFrame, fits: DataFrame) -> DataFrame:
    """One concentration step for every group and start."""
    near = distance(_attach(points, fits))
    bins = near.withColumn("bin", F.floor(F.log2(F.col("d2") + 1e-6) * BINS_PER_OCTAVE)).groupBy("grp", "start", "bin").agg(*_moments())
    running = Window.partitionBy("grp", "start").orderBy("bin")
    whole = Window.partitionBy("grp", "start")
    before = F.sum("n").over(running) - F.col("n")
    share = F.least(F.greatest((F.sum("n").over(whole) * SUPPORT - before) / F.col("n"), F.lit(0.0)), F.lit(1.0))
    part = bins.withColumn("share", share).where("share > 0")
    sums = part.groupBy("grp", "start").agg(*[F.sum(F.col(c) * F.col("share")).alias(c) for c in MOMENTS])
    return _from_moments(sums, CONSISTENCY)


def group_of(stats: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """(lang, source, grp, feeds): the group that judges each pair, and the groups whose estimates its rows enter.

    A pair with enough usable rows is judged by its own group, else by its language's, else by that of all rows.  The
    wider groups are estimated from all their rows, and only where some pair needs them.
    """
    pairs = materialise(stats.groupBy("lang", "source").agg(F.count_if("usable").alias("n")), "quality-groups")
    by_lang = pairs.groupBy(F.col("lang").alias("of_lang")).agg(F.sum("n").alias("in_lang"), F.min("n").alias("least"))
    least_lang = by_lang.agg(F.min("in_lang")).first()[0]
    # as JSON, in which a null is left out, so that no two pairs share a name
    own, pooled = F.to_json(F.struct("lang", "source")), F.concat(F.lit("lang "), F.to_json(F.struct("lang")))
    counts = pairs.join(by_lang, F.col("lang").eqNullSafe(F.col("of_lang"))).withColumn("least_lang", F.lit(least_lang).cast("long"))
    grp = F.when(F.col("n") >= min_group, own).when(F.col("in_lang") >= min_group, pooled).otherwise(F.lit("all"))
    feeds = F.array_compact(F.array(F.when(F.col("n") >= min_group, own), F.when((F.col("least") < min_group) & (F.col("in_lang") >= min_group), pooled), F.when(F.col("least_lang") < min_group, F.lit("all"))))
    return counts.select("lang", "source", grp.alias("grp"), feeds.alias("feeds"))


def robust_outliers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", cutoff: float = CUTOFF, keep: list[str] | None = None) -> DataFrame:
    """One row per input row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, d2, kept.

    base_failed: under 50 words, or more than half the words in repeated three-word windows.  Such rows take no part
    in the estimates, and are not kept.  Other rows are kept unless their squared distance exceeds ``cutoff``.  Null
    texts count as empty (base_failed); null languages or sources form groups of their own; repeated rows and ties
    count and return as often as they stand; groups below ``MIN_GROUP`` rows are pooled, and if even all rows together
    hold fewer, nothing is rejected by distance (d2 null).  ``keep`` names columns to carry along, prefixed ``in_``.
    """
    base = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), *[F.col(c).alias(f"in_{c}") for c in keep or []]
    )
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    stats = statistic_vector(text_statistics(base).drop("text")).withColumn("base_failed", failed).withColumn("usable", ~failed)
    stats = stats.withColumn("salt", F.pmod(F.xxhash64("id", "n_words", "word_chars"), F.lit(SALTS)).cast("int"))
    stats = materialise(stats, "quality-stats")
    groups = group_of(stats).withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    g = groups.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), "grp", "feeds", F.col("salt").alias("g_salt"))
    on = F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")) & (F.col("salt") == F.col("g_salt"))
    points = materialise(stats.where("usable").join(g, on).select(F.explode("feeds").alias("grp"), "salt", *STATS), "quality-points")
    fits = materialise(_starts(points), "quality-fits")
    for _ in range(MOST_STEPS):
        before = fits
        fits = materialise(_concentrate(points, before).select("grp", "start", "logdet", "n", *FIT_COLUMNS), "quality-fits")
        earlier = before.select("grp", "start", F.col("logdet").alias("earlier"))
        moved = fits.join(earlier, ["grp", "start"]).agg(F.max(F.abs(F.col("logdet") - F.col("earlier")))).first()[0]
        discard(before)
        if moved is None or moved <= SETTLED:
            break
    discard(points)
    best = fits.groupBy("grp").agg(F.min(F.struct("logdet", "start", "n", *FIT_COLUMNS)).alias("b")).select("grp", "b.*")
    enough = best.where(F.col("n") >= MIN_GROUP * SUPPORT - 0.25).drop("logdet", "start", "n")
    rows = stats.join(g.drop("feeds").join(enough, "grp", "left"), on, "left")
    judged = distance(rows)
    kept = ~F.col("base_failed") & (F.col("d2").isNull() | (F.col("d2") <= cutoff))
    return judged.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "d2", kept.alias("kept"), *[f"in_{c}" for c in keep or []]
    )
