"""Operator 2: quality rules and robust multivariate outliers, with DataFrame functions alone.

One scan turns each text into base statistics; they are kept, and all that follows works on numbers.  Per language and
source a minimum-covariance-determinant estimate is found by concentration steps: from each of four deterministic starts
(quantiles; the covariances of the spatial signs, of the squashed values, and of all rows) take the share of rows that is
nearest to the centre, recompute mean and covariance, and repeat.  After WARM steps the start with the smallest determinant
goes on alone, until no group's determinant falls any more.  A last step reweights.  A row is rejected if its squared
Mahalanobis distance by that estimate passes the chi-squared quantile for one in ALPHA.

A step is one pass: rows are summed by group, start and a narrow bin of their distance, and the nearest share is the bins up
to it, the last of them in part.  Sums are additive, so a source with a third of all rows is a few numbers a task before
anything is shuffled.

Regular estimates.  A standard deviation under its floor (FLOORS) is raised to it, those above are left alone: without floors
a statistic that is zero nearly everywhere would make any other value an outlier.  Small groups borrow: a group's estimate is
drawn toward its language's as if by OVERALL rows of that, and the language's toward the one over all; these are sums of what
the groups' own estimates kept, so no row is read for them.  Nothing turns at a size: a group's own centre and scatter take
part with weight n / (n + OVERALL) whether it has two rows or a million.

Defined results: a null or wordless text has zeros everywhere and fails the base rules; null languages or sources form
groups of their own; repeated rows count each time; a null doc_id is kept as it is; a group without rows that pass the base
rules has no estimate, and its rows no distance; an empty table gives no rows.  Other columns are not read, so clashing names
do no harm.  A text's words, lines and windows are held in memory while it is read, some 200 bytes a word, so the longest
text bounds a task's need.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import WHITE, saved, whole

#: Transformed statistics and the least standard deviations of them that count.  With those of f_lines and f_repeats,
#: either alone passes the limit from about 29 % of lines or words that repeat, where a group has none.
FLOORS = {"f_length": 0.5, "f_word": 0.12, "f_symbols": 0.08, "f_lines": 0.15, "f_repeats": 0.15}
ALPHA = 40.0
SHARE = 0.75  #: of a group's rows that a concentration step takes
WARM, MOST_STEPS = 2, 30  #: steps of all starts, and of the best one at most (it ends long before)
BINS = 16  #: of a doubling of the squared distance
SMALL = 20_000  #: groups whose table is broadcast, at most
SALTS = 32  #: parts of a group's rows where it isn't
_SPACE = " \t\n\x0b\f\r"


def _window_hash(*words: Column) -> Column:
    return F.xxhash64(*words)


def base_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines."""
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "source", whole().alias("x"), F.trim(whole(), F.lit(_SPACE)).alias("t"))
    df = df.withColumn("w", F.when(F.col("t") == "", F.array().cast("array<string>")).otherwise(F.split("t", WHITE + "+")))
    df = df.withColumn("l", F.filter(F.split("x", "\n"), lambda x: F.trim(x, F.lit(_SPACE)) != ""))
    n = F.size("w")
    windows = F.transform(F.slice("w", 1, F.greatest(n - 2, F.lit(0))), lambda x, i: _window_hash(x, F.get("w", i + 1), F.get("w", i + 2)))
    df = df.select(
        "doc_id", "lang", "source", n.cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"), F.size("l").cast("long").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"), windows.alias("h"), "w",
    )
    twice = F.size(F.array_distinct("h")) < F.size("h")
    # Only where hashes repeat are windows put side by side, by hash first and then by their words, which decide.
    placed = F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), F.get("w", i).alias("a"), F.get("w", i + 1).alias("b"), F.get("w", i + 2).alias("c"), i.alias("i"))))
    df = df.withColumn("s", F.when(twice, placed)).drop("w")

    def same(x: Column, k: Column) -> Column:
        y = F.get("s", k)
        return F.coalesce((y["h"] == x["h"]) & (y["a"] == x["a"]) & (y["b"] == x["b"]) & (y["c"] == x["c"]), F.lit(False))

    again = F.filter("s", lambda x, k: same(x, k - 1) | same(x, k + 1))
    covered = F.size(F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))
    return df.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.when(F.col("s").isNull(), 0).otherwise(covered).cast("long").alias("n_repeat_words"), "n_lines")


def with_features(stats: DataFrame) -> DataFrame:
    rate = lambda a, b: F.sqrt(F.col(a) / F.greatest(F.col(b), F.lit(1)))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return stats.withColumns(
        {
            "base_failed": failed,
            "grp": F.to_json(F.struct("lang", "source"), {"ignoreNullFields": "false"}),
            "f_length": F.log1p(F.col("n_words").cast("double")),
            "f_word": F.log1p(F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1))),
            "f_symbols": rate("n_symbols", "word_chars"),
            "f_lines": rate("n_dup_lines", "n_lines"),
            "f_repeats": rate("n_repeat_words", "n_words"),
        }
    )


def chi2_cdf(x: float, k: int) -> float:
    """By the series of the lower incomplete gamma function."""
    a, z = k / 2, x / 2
    term = total = 1 / a
    n = 0
    while term > total * 1e-15:
        n += 1
        term *= z / (a + n)
        total += term
    return total * math.exp(-z + a * math.log(z) - math.lgamma(a)) if z > 0 else 0.0


def chi2_quantile(p: float, k: int) -> float:
    low, high = 0.0, 1.0
    while chi2_cdf(high, k) < p and high < 1e4:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < p else (low, mid)
    return high


_P = len(FLOORS)
OVERALL = _P + 1.0
_NAMES = list(FLOORS)
_PAIRS = [(i, j) for i in range(_P) for j in range(i + 1)]
STARTS = ("quantiles", "signs", "squashed", "all")


def consistency(share: float) -> float:
    """What the covariance of the nearest share of normal rows is multiplied by to be that of all."""
    return share / chi2_cdf(chi2_quantile(share, _P), _P + 2)


def _distance() -> Column:
    """Squared length of L^-1 (x - mu), by forward substitution."""
    y: list[str] = []
    for i, f in enumerate(_NAMES):
        y.append(f"(({f} - mu{i}{''.join(f' - l{i}{j} * {y[j]}' for j in range(i))}) / l{i}{i})")
    return F.expr(" + ".join(f"{v} * {v}" for v in y))


def _factor(df: DataFrame, scale: float = 1.0) -> DataFrame:
    """df's mu_i and c_ij -> mu_i, the Cholesky factor l_ij of the scaled covariance, and logdet; other columns stay.

    A variance under its floor's square is raised to that.  What is left of one beside the others (a pivot) counts as a
    sixteenth of that at least, which only near-collinear statistics reach."""
    floor = [FLOORS[f] ** 2 for f in _NAMES]
    columns = [c for c in df.columns if not c.startswith("c")]
    columns += [f"greatest(c{i}{i} * {scale}D, {floor[i]}D) as k{i}{i}" if i == j else f"c{i}{j} * {scale}D as k{i}{j}" for i, j in _PAIRS]
    for i, j in _PAIRS:
        rest = f"k{i}{j}" + "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
        columns.append(f"sqrt(greatest({rest}, {floor[i] / 16}D)) as l{i}{i}" if i == j else f"({rest}) / l{j}{j} as l{i}{j}")
    columns.append(" + ".join(f"ln(l{i}{i})" for i in range(_P)) + " as logdet")
    return df.selectExpr(*columns).drop(*(f"k{i}{j}" for i, j in _PAIRS))


def _sums() -> list[Column]:
    out = [F.expr("count(*) as n"), *(F.expr(f"sum({f}) as s{i}") for i, f in enumerate(_NAMES))]
    return out + [F.expr(f"sum({_NAMES[i]} * {_NAMES[j]}) as q{i}{j}") for i, j in _PAIRS]


_SUMMED = ["n", *(f"s{i}" for i in range(_P)), *(f"q{i}{j}" for i, j in _PAIRS)]


def _moments(df: DataFrame) -> DataFrame:
    """Sums -> mu_i and c_ij beside n; other columns stay."""
    columns = [c for c in df.columns if c not in _SUMMED[1:]]
    columns += [f"s{i} / n as mu{i}" for i in range(_P)] + [f"q{i}{j} / n - mu{i} * mu{j} as c{i}{j}" for i, j in _PAIRS]
    return df.selectExpr(*columns)


def _beside(rows: DataFrame, groups: DataFrame, n_groups: int) -> DataFrame:
    """rows beside what their grp has in a small table.  Up to SMALL groups it is broadcast, a few MB; beyond, the rows of a
    group are dealt to SALTS tasks."""
    if n_groups <= SMALL:
        return rows.join(F.broadcast(groups), "grp")
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", *_NAMES), F.lit(SALTS)).cast("int")).join(salted, ["grp", "salt"]).drop("salt")


def _starts(rows: DataFrame, n_groups: int) -> DataFrame:
    """grp, start, mu_i, l_ij, logdet of the four starts."""
    quantiles = [F.percentile_approx(f, [0.25, 0.5, 0.75], 1000).alias(f"p{i}") for i, f in enumerate(_NAMES)]
    per = rows.groupBy("grp").agg(*quantiles)
    centre = {f"m{i}": F.col(f"p{i}")[1] for i in range(_P)}
    spread = {f"d{i}": F.greatest((F.col(f"p{i}")[2] - F.col(f"p{i}")[0]) / 1.349, F.lit(FLOORS[f])) for i, f in enumerate(_NAMES)}
    per = saved(per.withColumns(centre | spread).drop(*(f"p{i}" for i in range(_P))), "mcd-quantiles")
    z = [(F.col(f) - F.col(f"m{i}")) / F.col(f"d{i}") for i, f in enumerate(_NAMES)]
    length = F.greatest(F.sqrt(sum((v * v for v in z[1:]), z[0] * z[0])), F.lit(1e-9))
    kinds = {"signs": [v / length for v in z], "squashed": [F.tanh(v) for v in z], "all": z}
    kinds = F.array(*(F.struct(F.lit(k).alias("start"), *(v.alias(f) for v, f in zip(vs, _NAMES, strict=True))) for k, vs in kinds.items()))
    shaped = _beside(rows, per, n_groups).select("grp", F.explode(kinds).alias("k")).select("grp", "k.*").groupBy("grp", "start").agg(*_sums())
    shaped = _moments(shaped).drop("n").join(per, "grp")
    # Signs and squashed values have a shape but no size: the quantiles give it, about the medians.
    own = F.col("start") == "all"
    scaled = {f"c{i}{j}": F.col(f"c{i}{j}") * F.when(own, 1.0).otherwise(1 / F.sqrt(F.greatest(F.col(f"c{i}{i}"), F.lit(1e-9)) * F.greatest(F.col(f"c{j}{j}"), F.lit(1e-9)))) * F.col(f"d{i}") * F.col(f"d{j}") for i, j in _PAIRS}
    shaped = shaped.withColumns(scaled | {f"mu{i}": F.col(f"m{i}") + F.when(own, F.col(f"mu{i}") * F.col(f"d{i}")).otherwise(0.0) for i in range(_P)})
    plain = per.withColumns({"start": F.lit("quantiles")} | {f"mu{i}": F.col(f"m{i}") for i in range(_P)} | {f"c{i}{j}": F.col(f"d{i}") ** 2 if i == j else F.lit(0.0) for i, j in _PAIRS})
    columns = ["grp", "start", *(f"mu{i}" for i in range(_P)), *(f"c{i}{j}" for i, j in _PAIRS)]
    return saved(_factor(shaped.select(*columns).unionByName(plain.select(*columns))), "mcd-starts")


def _nearest(rows: DataFrame, now: DataFrame, n_groups: int, share: float) -> DataFrame:
    """Sums over the nearest share of each group's rows, by start: the bins of their distance up to it, the last in part."""
    near = _beside(rows, now.drop("logdet"), n_groups).withColumn("bin", F.floor(F.log2(_distance() + 1e-12) * BINS))
    binned = near.groupBy("grp", "start", "bin").agg(*_sums())
    order = Window.partitionBy("grp", "start").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    binned = binned.withColumns({"before": F.coalesce(F.sum("n").over(order), F.lit(0)), "of": F.sum("n").over(Window.partitionBy("grp", "start"))})
    part = F.least(F.lit(1.0), (F.greatest(F.ceil(F.col("of") * share), F.lit(1)) - F.col("before")) / F.col("n"))
    return binned.withColumn("part", part).where("part > 0").groupBy("grp", "start").agg(*(F.sum(F.col(c) * F.col("part")).alias(c) for c in _SUMMED))


def estimates(features: DataFrame, share: float = SHARE) -> DataFrame:
    """grp, mu_i, l_ij: centre and factored covariance of each group of the features' rows that pass the base rules."""
    rows = saved(features.where(~F.col("base_failed")).select("doc_id", "grp", "lang", *_NAMES), "mcd-rows")
    n_groups = rows.select("grp").distinct().count()
    now, scale = _starts(rows, n_groups), consistency(share)
    for _ in range(WARM):
        now = saved(_factor(_moments(_nearest(rows, now, n_groups, share)).drop("n"), scale), "mcd-step")
    best = F.min_by(F.struct(*(c for c in now.columns if c != "grp")), F.struct("logdet", "start")).alias("b")
    now = saved(now.groupBy("grp").agg(best).select("grp", "b.*"), "mcd-best")
    for _ in range(MOST_STEPS):
        new = saved(_factor(_moments(_nearest(rows, now, n_groups, share)).drop("n"), scale), "mcd-step")
        # A group whose determinant has stopped falling keeps the estimate that it had.
        both = new.alias("a").join(now.alias("b"), "grp").select("grp", F.when(F.col("a.logdet") < F.col("b.logdet") - 1e-4, F.struct("a.*")).otherwise(F.struct("b.*")).alias("x"), (F.col("a.logdet") < F.col("b.logdet") - 1e-4).alias("fell"))
        both = saved(both.select("x.*", "fell"), "mcd-kept")
        now = both.drop("fell")
        if both.where("fell").isEmpty():
            break
    near = _beside(rows, now.drop("logdet"), n_groups).where(_distance() <= chi2_quantile(0.975, _P))
    kept = _moments(near.groupBy("grp", "lang").agg(*_sums()))
    return saved(_factor(_drawn(kept), consistency(0.975)).select("grp", *(f"mu{i}" for i in range(_P)), *(f"l{i}{j}" for i, j in _PAIRS)), "mcd-estimates")


def _drawn(groups: DataFrame) -> DataFrame:
    """groups: grp, lang, n, mu_i, c_ij, a row a group.  Each drawn toward its language's estimate, and that toward all's."""

    def pooled(name: str, by: str) -> list[str]:
        """Moments of the n rows of all groups of the same `by`: name + n, mu_i, c_ij."""
        over = f"over ({by})"
        out = [f"sum(n) {over} as {name}n", *(f"sum(n * mu{i}) {over} / {name}n as {name}mu{i}" for i in range(_P))]
        return out + [f"sum(n * (c{i}{j} + mu{i} * mu{j})) {over} / {name}n - {name}mu{i} * {name}mu{j} as {name}c{i}{j}" for i, j in _PAIRS]

    def toward(new: str, own: str, other: str) -> list[str]:
        """Mean and covariance of own's n rows and OVERALL rows of the other's."""
        w = f"({own}n / ({own}n + {OVERALL}D))"
        off = [f"({other}mu{i} - {own}mu{i})" for i in range(_P)]
        out = [f"{own}mu{i} + (1 - {w}) * {off[i]} as {new}mu{i}" for i in range(_P)]
        return out + [f"{w} * {own}c{i}{j} + (1 - {w}) * {other}c{i}{j} + {w} * (1 - {w}) * {off[i]} * {off[j]} as {new}c{i}{j}" for i, j in _PAIRS]

    df = groups.selectExpr("*", *pooled("l_", "partition by lang")).selectExpr("*", *pooled("a_", ""))
    df = df.selectExpr("*", *toward("d_", "l_", "a_")).selectExpr("grp", *toward("e_", "", "d_"))
    return df.toDF(*(c.removeprefix("e_") for c in df.columns))


def judged(docs: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """doc_id, n_words, the base statistics, base_failed, kept, distance (squared; null without an estimate)."""
    features = saved(with_features(base_statistics(docs)), "quality-features")
    found = estimates(features)
    n_groups = found.count()
    usable = _beside(features.where(~F.col("base_failed")), found, n_groups).withColumn("distance", _distance())
    failed = features.where("base_failed").withColumn("distance", F.lit(None).cast("double"))
    df = usable.select(*failed.columns).unionByName(failed)
    limit = chi2_quantile(1 - 1 / alpha, _P)
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= limit, F.lit(False))
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance")
