"""Quality rules: fixed limits, then robust multivariate outliers per language and source.

All of it is DataFrame functions.  Each text gives a vector of transformed
statistics.  For each language and source, a minimum-covariance-determinant
estimate of location and scatter is found by concentration steps, in which the
``core`` share of rows nearest by Mahalanobis distance gives the next mean and
covariance.  There are three deterministic starts about the coordinate-wise median
(diagonal spread, spatial signs, squashed scores); after two steps the start of
least determinant goes on until no group's determinant falls any more.  The
scatter is widened so that the median squared distance is that of the normal law;
rows beyond the chi-squared law's ``tail`` quantile are rejected.

Groups of fewer than ``least_rows`` rows that pass the fixed limits take their
language's estimate, and small languages that of all rows; those two levels are
estimated only where a group needs them.  Every step is one aggregation of
fixed-size states over the vectors, so a group may hold any share of the rows;
quantiles are sketches.

Edge cases: a null or empty text has no words and fails the fixed limits; vectors
of failed rows are not estimated from; a null language or source is a group of its
own; repeated rows count again; with no rows that pass, nothing is kept; only the
columns named by ``keep`` pass through, but for those with the name of a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, saved, work_dir

FEATURES = ("log_words", "word_length", "line_words", "symbols", "variety", "marks")
#: Least standard deviation of each feature: below it, differences are no evidence.
FLOOR = (0.35, 0.25, 0.35, 0.5, 0.06, 0.25)
SPLIT = "[ \\t\\n\\x0B\\f\\r]+"
BLANK = " \t\n\x0b\x0c\r"
#: Medians of the chi-squared law of 1 to 8 degrees of freedom.
_CHI_MEDIAN = (0.4549, 1.3863, 2.3660, 3.3567, 4.3515, 5.3481, 6.3458, 7.3441)
#: Quantiles of the chi-squared law of 6 degrees of freedom, by tail.
_CHI_TAIL = {0.01: 16.8119, 0.001: 22.4577, 0.0001: 27.8563}
RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _repeated(words: Column, window: int = 8) -> Column:
    """Words inside windows that occur at least twice: sorted window hashes give the repeats, a fold their cover."""
    n = F.size(words)

    def windows(h: Column) -> Column:
        one = lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(window)])
        return F.transform(F.sequence(F.lit(0), F.size(h) - window), one)

    def cover(ws: Column) -> Column:
        pairs = F.array_sort(F.transform(ws, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def repeated(s: Column) -> Column:
            no = F.lit(False)
            twice = lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], no) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], no)
            return F.array_sort(F.transform(F.filter(s, twice), lambda x: x["i"]))

        at = _let(pairs, repeated)
        start = F.struct(F.lit(-window).alias("last"), F.lit(0).cast("long").alias("n"))
        add = lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(window), i - a["last"])).alias("n"))
        return F.aggregate(at, start, add)["n"]

    def counted(ws: Column) -> Column:
        return F.when(F.size(F.array_distinct(ws)) == F.size(ws), F.lit(0).cast("long")).otherwise(cover(ws))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(n <= window, F.lit(0).cast("long")).otherwise(_let(_let(hashes, windows), counted))


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and the features."""
    t = F.coalesce(F.col(text), F.lit(""))
    full = docs.withColumn("_w", F.array_remove(F.split(t, SPLIT), ""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(BLANK)) != "")
    full = full.withColumns({
        "n_words": F.size("_w").cast("long"), "word_chars": F.length(F.array_join("_w", "")).cast("long"), "n_symbols": F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long"),
        "_l": _let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d"))), "n_repeat_words": _repeated(F.col("_w")),
        "_d": F.size(F.array_distinct("_w")), "_m": F.regexp_count(t, F.lit("[.,;:!?]")),
    })
    n = F.greatest(F.col("n_words"), F.lit(1))
    return full.withColumn("n_dup_lines", (F.col("_l.n") - F.col("_l.d")).cast("long")).withColumns({
        "base_failed": (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
        "log_words": F.log1p("n_words"), "word_length": F.col("word_chars") / n, "line_words": F.log1p(F.col("n_words") / F.greatest(F.col("_l.n"), F.lit(1))),
        "symbols": F.log1p(100 * F.col("n_symbols") / n), "variety": F.log(F.greatest(F.col("_d"), F.lit(1))) / F.greatest(F.log(n), F.lit(0.5)), "marks": F.log1p(20 * F.col("_m") / n),
    }).drop("_w", "_l", "_d", "_m")


def _whitened(df: DataFrame, by: list[str], *also: str) -> DataFrame:
    """``by``, ``mean`` and ``white``: the inverse Cholesky factor of each group's scatter, lower triangle by rows.

    Both are folds over the cells of the triangle, so that expressions stay small.
    """
    p = len(FEATURES)
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(p) for j in range(i + 1)])
    at = lambda a, i, j: F.get(a, (i * (i + 1) / 2).cast("int") + j)
    total = lambda terms: F.aggregate(terms, F.lit(0.0), lambda s, v: s + v)
    upto = lambda lo, hi: F.filter(F.sequence(F.lit(0), F.lit(p - 1)), lambda q: (q >= lo) & (q < hi))

    def factor(l: Column, c: Column) -> Column:
        rest = at(F.col("_c"), c["i"], c["j"]) - total(F.transform(upto(F.lit(0), c["j"]), lambda q: at(l, c["i"], q) * at(l, c["j"], q)))
        return F.concat(l, F.array(F.when(c["i"] == c["j"], F.sqrt(F.greatest(rest, F.lit(1e-9)))).otherwise(rest / at(l, c["j"], c["j"]))))

    def inverse(w: Column, c: Column) -> Column:
        rest = total(F.transform(upto(c["j"], c["i"]), lambda q: at(F.col("_l"), c["i"], q) * at(w, q, c["j"])))
        return F.concat(w, F.array(F.when(c["i"] == c["j"], 1.0).otherwise(-rest) / at(F.col("_l"), c["i"], c["i"])))

    none = F.array().cast("array<double>")
    out = df.withColumn("_c", F.array(*[f"c{i}_{j}" for i in range(p) for j in range(i + 1)])).withColumn("_l", F.aggregate(cells, none, factor))
    out = out.select(*by, *also, F.array(*[f"m{i}" for i in range(p)]).alias("mean"), F.aggregate(cells, none, inverse).alias("white"))
    return out.withColumn("logdet", sum((-2.0 * F.log(F.get("white", F.lit(i * (i + 3) // 2))) for i in range(1, p)), -2.0 * F.log(F.get("white", F.lit(0)))))


def _squared(mean: Column, white: Column) -> Column:
    """Squared Mahalanobis distance of the features."""
    p = len(FEATURES)
    gap = [F.col(f) - F.get(mean, F.lit(i)) for i, f in enumerate(FEATURES)]
    d2 = F.lit(0.0)
    for i in range(p):
        z = gap[0] * F.get(white, F.lit(i * (i + 1) // 2))
        for j in range(1, i + 1):
            z = z + gap[j] * F.get(white, F.lit(i * (i + 1) // 2 + j))
        d2 = d2 + F.pow(z, 2.0)
    return d2


def _moments(df: DataFrame, by: list[str]) -> DataFrame:
    """Mean and scatter (floored on the diagonal) of the features by group."""
    p = len(FEATURES)
    means = [F.avg(f).alias(f"m{i}") for i, f in enumerate(FEATURES)]
    covs = [F.covar_pop(FEATURES[i], FEATURES[j]).alias(f"c{i}_{j}") for i in range(p) for j in range(i + 1)]
    out = df.groupBy(*by).agg(*means, *covs)
    return out.withColumns({f"c{i}_{i}": F.col(f"c{i}_{i}") + FLOOR[i] ** 2 for i in range(p)})


def _with_distance(df: DataFrame, estimate: DataFrame, by: list[str], few: bool, *also: str) -> DataFrame:
    """Adds ``d2`` of each row under its group's estimate (``mean`` and ``white``), once for each estimate of the group."""
    right = _renamed(estimate.select(*by, *also, "mean", "white"), by)
    out = df.join(F.broadcast(right) if few else right, _same(by), "inner")
    return out.withColumn("d2", _squared(F.col("mean"), F.col("white"))).select(*df.columns, *also, "d2")


def _started(df: DataFrame, by: list[str], folder: str) -> DataFrame:
    """The starts of each group: ``start``, ``n``, ``mean`` (the median), ``white``, ``logdet``."""
    p = len(FEATURES)
    cells = [(i, j) for i in range(p) for j in range(i + 1)]
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.percentile_approx(f, [0.25, 0.5, 0.75], 2000).alias(f"q{i}") for i, f in enumerate(FEATURES)])
    sizes = sizes.select(*by, "n", F.array(*[F.col(f"q{i}")[1] for i in range(p)]).alias("mid"),
                         F.array(*[F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, F.lit(FLOOR[i])) for i in range(p)]).alias("sd"))
    sizes = saved(sizes, f"{folder}/sizes")
    right = _renamed(sizes.drop("n"), by)
    few = sizes.count() <= BROADCAST_ROWS
    z = df.join(F.broadcast(right) if few else right, _same(by)).select(*by, *[((F.col(f) - F.get("mid", F.lit(i))) / F.get("sd", F.lit(i))).alias(f"z{i}") for i, f in enumerate(FEATURES)])
    z = z.withColumns({"_r": F.greatest(sum((F.col(f"z{i}") ** 2 for i in range(1, p)), F.col("z0") ** 2), F.lit(1e-9)), **{f"t{i}": F.tanh(f"z{i}") for i in range(p)}})
    signs = F.array(*[p * F.avg(F.col(f"z{i}") * F.col(f"z{j}") / F.col("_r")) for i, j in cells])
    squashed = F.array(*[F.covar_pop(f"t{i}", f"t{j}") for i, j in cells])
    plain = F.array(*[F.lit(1.0 if i == j else 0.0) for i, j in cells])
    shapes = _renamed(z.groupBy(*by).agg(F.array(plain, signs, squashed).alias("shapes")), by)
    out = sizes.join(F.broadcast(shapes) if few else shapes, _same(by)).select(*by, "n", "mid", "sd", F.posexplode("shapes").alias("start", "c"))
    scatter = {f"c{i}_{j}": F.get("c", F.lit(k)) * F.get("sd", F.lit(i)) * F.get("sd", F.lit(j)) + (FLOOR[i] ** 2 if i == j else 0.0) for k, (i, j) in enumerate(cells)}
    out = out.select(*by, "start", "n", *[F.get("mid", F.lit(i)).alias(f"m{i}") for i in range(p)], *[v.alias(k) for k, v in scatter.items()])
    return _whitened(out, [*by, "start"], "n")


def _concentrated(df: DataFrame, now: DataFrame, by: list[str], core: float, few: bool, folder: str) -> DataFrame:
    """One concentration step of each estimate."""
    each = [*by, "start"]
    near = _with_distance(df, now, by, few, "start")
    limit = _renamed(saved(near.groupBy(*each).agg(F.percentile_approx("d2", core, 2000).alias("lim")), f"{folder}-limits"), each)
    inside = near.join(F.broadcast(limit) if few else limit, _same(each)).filter("d2 <= lim")
    counts = _renamed(now.select(*each, "n"), each)
    moments = _moments(inside, each).join(F.broadcast(counts) if few else counts, _same(each))
    return saved(_whitened(moments, each, "n"), folder)


def estimates(df: DataFrame, by: list[str], folder: str, core: float = 0.75, most_steps: int = 20, tolerance: float = 1e-3) -> DataFrame:
    """A minimum-covariance-determinant estimate of each group: ``n``, ``mean``, ``white`` (scaled), one row a group.

    Steps end when no group's log determinant falls by over ``tolerance``.
    """
    p = len(FEATURES)
    now = saved(_started(df, by, folder), f"{folder}/s0")
    few = now.count() <= BROADCAST_ROWS
    for k in (1, 2):
        now = _concentrated(df, now, by, core, few, f"{folder}/s{k}")
    now = saved(now.groupBy(*by).agg(F.min_by(F.struct(*[c for c in now.columns if c not in by]), "logdet").alias("e")).select(*by, "e.*"), f"{folder}/best2")
    for k in range(3, most_steps + 1):
        new = _renamed(_concentrated(df, now, by, core, few, f"{folder}/s{k}"), by)
        fields = [c for c in now.columns if c not in by]
        own = F.struct(*[now[c] for c in fields])
        both = now.select(*by, own.alias("old")).join(new.select(*[f"_{b}" for b in by], F.struct(*fields).alias("new")), _same(by))
        falls = F.col("new.logdet") < F.col("old.logdet")
        both = saved(both.select(*by, F.when(falls, F.col("new")).otherwise(F.col("old")).alias("e"), (F.col("new.logdet") < F.col("old.logdet") - tolerance).alias("more")), f"{folder}/best{k}")
        now = both.select(*by, "e.*")
        if not both.filter("more").limit(1).count():
            break
    # scale the scatter so that the median squared distance is at least the normal law's
    mid = _renamed(_with_distance(df, now, by, few).groupBy(*by).agg(F.percentile_approx("d2", 0.5, 2000).alias("mid")), by)
    out = now.join(F.broadcast(mid) if few else mid, _same(by)).drop(*[f"_{b}" for b in by])
    shrink = F.sqrt(F.greatest(F.col("mid") / _CHI_MEDIAN[p - 1], F.lit(1.0)))
    return saved(out.withColumn("white", F.transform("white", lambda x: x / shrink)).select(*by, "n", "mean", "white"), f"{folder}/final")


def _renamed(df: DataFrame, by: list[str]) -> DataFrame:
    return df.withColumnsRenamed({b: f"_{b}" for b in by})


def _same(by: list[str]) -> Column:
    on = F.lit(True)
    for b in by:
        on = on & F.col(b).eqNullSafe(F.col(f"_{b}"))
    return on


def judged(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", keep: tuple[str, ...] = (), least_rows: int = 200,
           tail: float = 0.001, core: float = 0.75) -> DataFrame:
    """``keep`` columns, the statistics, base_failed, kept and ``distance`` (squared; null where failed) of every row."""
    spark = docs.sparkSession
    folder = work_dir(spark, "quality")
    keep = tuple(c for c in keep if c not in RESULTS)
    base = docs.select(*[F.col(f"`{c}`").alias(f"k_{i}") for i, c in enumerate(keep)], F.col(lang).alias("g_lang"), F.col(source).alias("g_source"), F.col(text).alias("g_text"))
    rows = saved(statistics(base, "g_text").drop("g_text"), f"{folder}/rows")
    # one estimate of each level's groups, in one go: (2, lang, source), (1, lang), (0); the last two only where groups are small
    both = ["g_lang", "g_source"]
    groups = saved(rows.groupBy(*both).agg(F.count_if(~F.col("base_failed")).alias("n")), f"{folder}/groups")
    small = saved(groups.groupBy("g_lang").agg((F.min("n") < least_rows).alias("need1"), ((F.min("n") < least_rows) & (F.sum("n") < least_rows)).alias("need0")), f"{folder}/small")
    need0 = bool(small.filter("need0").limit(1).count())
    nothing = F.lit(None).cast("string")
    group = lambda level, *of: F.struct(F.lit(level).alias("level"), *[c.cast("string").alias(n) for c, n in zip(of, ("a", "b"))])
    levels = [group(2, F.col("g_lang"), F.col("g_source")), F.when(F.col("need1"), group(1, F.col("g_lang"), nothing))] + ([group(0, nothing, nothing)] if need0 else [])
    right = _renamed(small.select("g_lang", "need1"), ["g_lang"])
    few = right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    good = rows.filter(~F.col("base_failed")).join(F.broadcast(right) if few else right, _same(["g_lang"]))
    good = good.select(F.explode(F.array_compact(F.array(*levels))).alias("g"), *FEATURES).select("g.*", *FEATURES)
    est = estimates(good, ["level", "a", "b"], folder, core)
    chosen = groups.select(*both)
    for level, of in ((2, ("g_lang", "g_source")), (1, ("g_lang",)), (0, ())):
        e = est.filter((F.col("level") == level) & (F.col("n") >= (least_rows if level else 1)))
        e = e.select(F.col("a").alias("_a"), F.col("b").alias("_b"), F.struct("mean", "white").alias(f"e{level}"))
        on = F.lit(True)
        for c, x in zip(of, ("_a", "_b")):
            on = on & F.col(c).cast("string").eqNullSafe(F.col(x))
        if not of:
            on = F.col("g_lang").eqNullSafe(F.col("g_lang"))
        few = not of or e.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        chosen = chosen.join(F.broadcast(e) if few else e, on, "left").drop("_a", "_b")
    chosen = saved(chosen.select(*both, F.coalesce("e2", "e1", "e0").alias("e")).select(*both, "e.*"), f"{folder}/chosen")
    ok = _with_distance(rows, chosen, both, chosen.count() <= BROADCAST_ROWS)
    d2 = F.when(~F.col("base_failed"), F.col("d2"))
    kept = ~F.col("base_failed") & F.coalesce(d2 <= _CHI_TAIL[tail], F.lit(False))
    return ok.select(*[F.col(f"k_{i}").alias(c) for i, c in enumerate(keep)], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), d2.alias("distance"))
