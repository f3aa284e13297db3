"""Linear models over all keys at once: least squares, mediation with the bootstrap, mixed models with a random intercept.

Rows are folded into sums of products by Spark; what is solved in numpy is one small system for each key, from a row of
sums. Rows with a null or NaN in a variable of the model have no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavecohort.functions import special
from wavecohort.functions.pvalues import normal_p
from wavecohort.functions.scratch import written
from wavecohort.operators.groupstats import fdr_bh, ols_simple, over
from wavecohort.operators.permute import add_resampled, blocks, digests, parts
from wavecohort.operators.placed import join_keys, quantiles


def complete(df: DataFrame, columns: list[str]) -> DataFrame:
    cond = F.lit(True)
    for c in columns:
        v = F.col(c).cast("double")
        cond = cond & v.isNotNull() & ~F.isnan(v)
    return df.filter(cond)


def _sums(columns: list[str]) -> list[Column]:
    """Sums of the products of every pair of columns."""
    return [F.sum(F.col(a).cast("double") * F.col(b).cast("double")).alias(f"s_{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if i <= j]


def ols_multi(df: DataFrame, keys: list[str], y: str, xs: list[str]) -> DataFrame:
    """``term, beta, se, t, p, n`` of the least-squares fit of y on an intercept and ``xs``; a singular system gives no
    row. Variables are centred by their means within keys before they are multiplied; rows with a null key have no part."""
    names = ["__one", *xs, y]
    rows = complete(df, [*xs, y]).select(*keys, *[F.col(c).cast("double").alias(c) for c in (*xs, y)])
    mean = rows.groupBy(*keys).agg(*[F.avg(c).alias(f"__m_{c}") for c in (*xs, y)])
    rows = rows.join(mean, keys) if keys else rows.crossJoin(F.broadcast(mean))  # one row
    rows = rows.withColumns({c: F.col(c) - F.col(f"__m_{c}") for c in (*xs, y)}).withColumn("__one", F.lit(1.0))
    sums = rows.groupBy(*keys).agg(F.count("*").alias("n"), *_sums(names), *[F.first(f"__m_{c}").alias(f"__m_{c}") for c in (*xs, y)])
    types = dict(df.dtypes)
    terms = ["intercept", *xs]

    def solve(frames):
        for f in frames:
            out = []
            for _, r in f.iterrows():
                k = len(names)
                s = np.zeros((k, k))
                for i in range(k):
                    for j in range(i, k):
                        s[i, j] = s[j, i] = r[f"s_{i}_{j}"]
                a, b, n = s[:-1, :-1], s[:-1, -1], int(r["n"])
                if n <= k - 1 or np.linalg.matrix_rank(a) < k - 1:
                    continue
                inv = np.linalg.inv(a)
                beta = inv @ b
                rss = max(s[-1, -1] - beta @ b, 0.0)
                cov = inv * rss / (n - k + 1)
                shift = np.array([1.0, *[-r[f"__m_{c}"] for c in xs]])  # back from centred variables
                var0 = float(shift @ cov @ shift)
                beta0 = float(shift @ beta) + r[f"__m_{y}"]
                for i, term in enumerate(terms):
                    b_i, se = (beta0, var0**0.5) if i == 0 else (float(beta[i]), float(cov[i, i]) ** 0.5)
                    t = b_i / se if se > 0 else None
                    p = float(special.t_two_sided(t, n - k + 1)) if t is not None else None
                    out.append([*[r[q] for q in keys], term, b_i, se, t, p, n])
            yield pd.DataFrame(out, columns=[*keys, "term", "beta", "se", "t", "p", "n"])

    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "term string, beta double, se double, t double, p double, n long"])
    return sums.mapInPandas(solve, schema)


# --- mediation ------------------------------------------------------------------------------------------------------------

#: P(X <= k) of a Poisson variable with mean 1, up to where 52 bits tell it from 1: a row's number of draws in a resample.
_POISSON = [float(x) for x in np.cumsum([np.exp(-1.0) / np.prod(range(1, k + 1), dtype=float) for k in range(20)])]


def _paths(w: Column, prefix: str = "") -> list[Column]:
    x, m, y = F.col("__x"), F.col("__m"), F.col("__y")
    pairs = {"w": F.lit(1.0), "x": x, "m": m, "y": y, "xx": x * x, "xm": x * m, "xy": x * y, "mm": m * m, "my": m * y}
    return [F.sum(w * v).alias(f"{prefix}{k}") for k, v in pairs.items()]


def _effects(df: DataFrame) -> DataFrame:
    """a (M on X), b and c' (Y on X and M), c (Y on X) from weighted sums; null where a variable has no spread."""
    c = lambda p, q, pq: F.col(pq) - F.col(p) * F.col(q) / F.col("w")
    df = df.withColumns({"sxx": c("x", "x", "xx"), "sxm": c("x", "m", "xm"), "sxy": c("x", "y", "xy"), "smm": c("m", "m", "mm"), "smy": c("m", "y", "my")})
    det = F.col("sxx") * F.col("smm") - F.col("sxm") * F.col("sxm")
    df = df.withColumns(
        {
            "a": over(F.col("sxm"), F.col("sxx")),
            "b": F.when(det > 1e-12, (F.col("smy") * F.col("sxx") - F.col("sxy") * F.col("sxm")) / det),
            "direct": F.when(det > 1e-12, (F.col("sxy") * F.col("smm") - F.col("smy") * F.col("sxm")) / det),
            "total": over(F.col("sxy"), F.col("sxx")),
        }
    )
    return df.withColumn("indirect", F.col("a") * F.col("b"))


def _centred(df: DataFrame, keys: list[str], x: str, m: str, y: str, row: str, covariates: list[str] | None = None) -> DataFrame:
    names = {"__x": x, "__m": m, "__y": y} | {f"__c{i}": c for i, c in enumerate(covariates or [])}
    rows = complete(df, list(names.values())).select(*keys, F.col(row).alias("__row"), *[F.col(c).cast("double").alias(n) for n, c in names.items()])
    mean = rows.groupBy(*keys).agg(*[F.avg(c).alias(f"{c}0") for c in names])
    rows = rows.join(mean, keys) if keys else rows.crossJoin(F.broadcast(mean))
    return rows.withColumns({c: F.col(c) - F.col(f"{c}0") for c in names}).drop(*[f"{c}0" for c in names])


def _adjusted(sums: DataFrame, keys: list[str], q: int) -> DataFrame:
    """``keys, rep, indirect`` from the sums of products of 1, x, m, y and covariates; a singular fit gives null."""
    types = dict(sums.dtypes)
    at = [(i, j) for i in range(q) for j in range(i, q)]

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            s = np.zeros((len(f), q, q))
            for i, j in at:
                s[:, i, j] = s[:, j, i] = f[f"s{i}_{j}"].to_numpy(float)
            out = []
            for z in s:
                one, two = [0, 1, *range(4, q)], [0, 1, 2, *range(4, q)]
                try:
                    a = np.linalg.solve(z[np.ix_(one, one)], z[one, 2])[1]
                    out.append(a * np.linalg.solve(z[np.ix_(two, two)], z[two, 3])[2])
                except np.linalg.LinAlgError:
                    out.append(None)
            yield f[[*keys, "rep"]].assign(indirect=pd.Series(out, index=f.index, dtype=float))

    return sums.mapInPandas(solve, ", ".join([*(f"`{k}` {types[k]}" for k in keys), "rep int, indirect double"]))


def _resampled_sums(rows: DataFrame, keys: list[str], names: list[str], reps: int, seed: int, whole: bool = False, draws: str = "md5") -> DataFrame:
    """``keys, rep, s0_0, s0_1, ...``: the weighted sums of products of 1 and ``names`` for each resample, and, if ``whole``,
    of all rows once, as rep -1. A row's weight in a resample is a Poisson number with mean 1 from the md5 of (seed,
    resample, row): no draws sent about, and sums that tasks add up where the rows are, a matrix product of resamples by
    rows at a time. Rows of a key that share ``__row`` share its hashes. With ``draws="stream"`` the numbers come from a
    stream of bits that starts at a 64-bit hash of (seed, row), which ``__row`` then is: a few operations on vectors for a
    row and resample, where md5 is a call."""
    q = 1 + len(names)
    types, sums = dict(rows.dtypes), [f"s{i}_{j}" for i in range(q) for j in range(i, q)]
    numbers = np.arange(-1 if whole else 0, reps)

    def flush(total: dict) -> pd.DataFrame:
        out = pd.DataFrame(np.concatenate(list(total.values())), columns=[f"__{c}" for c in sums])
        out["rep"] = np.tile(numbers, len(total))
        for i, c in enumerate(keys):
            out[c] = [v for k in total for v in [k[i]] * len(numbers)]
        return out[[*keys, "rep", *[f"__{c}" for c in sums]]]

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple, np.ndarray] = {}
        for f in frames:
            if draws == "stream":
                seeds = f["__row"].to_numpy(np.int64).view(np.uint64)
                for k, i in parts(f, keys):
                    z = [np.ones(len(i)), *(np.nan_to_num(f[n].to_numpy(float)[i]) for n in names)]
                    v = np.stack([z[a] * z[b] for a in range(q) for b in range(a, q)])
                    t = total.setdefault(k, np.zeros((len(numbers), len(sums))))
                    add_resampled(t[whole:], seeds[i], v)
                    if whole:
                        t[0] += v.sum(axis=1)
                if len(total) > 50:
                    yield flush(total)
                    total = {}
                continue
            at, found = pd.factorize(f["__row"], use_na_sentinel=False)
            ids = [("" if pd.isna(r) else f"{r}").encode() for r in found]
            split = []
            for k, i in parts(f, keys):
                z = [np.ones(len(i)), *(np.nan_to_num(f[n].to_numpy(float)[i]) for n in names)]
                split.append((k, at[i], np.stack([z[a] * z[b] for a in range(q) for b in range(a, q)], axis=1)))
                total.setdefault(k, np.zeros((len(numbers), len(sums))))
            for turn in blocks(reps):
                u = (digests(seed, turn, ids)[0] >> np.uint64(12)).astype(float) / 2.0**52
                w = np.searchsorted(_POISSON, u, side="right").astype(float)
                for k, i, v in split:
                    total[k][turn.start + whole : turn.stop + whole] += w[:, i] @ v
            if whole:
                for k, _, v in split:
                    total[k][0] += v.sum(axis=0)
            if len(total) > 50:  # many keys are sent on now and then, so that a task holds a few
                yield flush(total)
                total = {}
        if total:
            yield flush(total)

    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "rep int", *(f"__{c} double" for c in sums)])
    got = rows.select(*keys, F.col("__row").cast("long" if draws == "stream" else "string").alias("__row"), *names).mapInPandas(draw, schema)
    return got.groupBy(*keys, "rep").agg(*[F.sum(f"__{c}").alias(c) for c in sums]).filter("s0_0 > 0")


def _dealt(rows: DataFrame, by_row: bool, draws: str = "md5", seed: int = 42) -> DataFrame:
    """A row costs a hash for each resample, so few bytes are much work: rows go to as many tasks as run at a time, a number
    that is not made smaller where they are small. ``by_row``: rows that share ``__row`` come together. For a stream
    ``__row`` becomes its start, and rows that share it need not meet."""
    n = rows.sparkSession.sparkContext.defaultParallelism
    if draws == "stream":
        return rows.withColumn("__row", F.xxhash64(F.lit(seed), F.col("__row").cast("string"))).repartition(n, "__row")
    rows = rows.withColumn("__row", F.col("__row").cast("string")).repartition(n, "__row")
    return rows.sortWithinPartitions("__row") if by_row else rows


def bootstrap_effects(df: DataFrame, keys: list[str], x: str, m: str | list[str], y: str | list[str], row: str, reps: int, seed: int = 42, covariates: list[str] | None = None, shared_rows: bool = True, draws: str = "md5") -> DataFrame:
    """``keys, rep, indirect``: the indirect effect of each resample, with ``covariates`` in both equations; see
    :func:`_resampled_sums`, ``draws`` as there. ``row``: a column that tells rows apart. ``shared_rows``: keys have rows in common, which are
    brought together so that they are hashed once; without it no row is moved. If ``m`` and ``y`` are lists, all their pairs
    from one draw: ``keys, mediator, outcome, rep, n, a, b, direct, total, indirect``, the sample itself as rep -1."""
    if not isinstance(m, str):
        return _pair_effects(df, keys, x, m, y, row, reps, seed, covariates, draws)
    rows = _centred(df, keys, x, m, y, row, covariates)
    if shared_rows or draws == "stream":
        rows = _dealt(rows, True, draws, seed)
    more = [f"__c{i}" for i in range(len(covariates or []))]
    got = _resampled_sums(rows, keys, ["__x", "__m", "__y", *more], reps, seed, draws=draws)
    if more:
        return _adjusted(got, keys, 4 + len(more))
    plain = dict(zip([f"s{i}_{j}" for i in range(4) for j in range(i, 4)], ["w", "x", "m", "y", "xx", "xm", "xy", "mm", "my", "yy"], strict=True))
    return _effects(got.withColumnsRenamed(plain)).select(*keys, "rep", "indirect")


def mediation_paths(df: DataFrame, keys: list[str], x: str, m: str, y: str, covariates: list[str] | None = None) -> DataFrame:
    """``n`` and, for the paths a (m on x), b and c' (y on x and m) and c (y on x), the effect, its standard error and
    p-value, covariates in every equation: ``a, a_se, a_p, b, ..., direct, ..., total, ...``. A singular fit gives no row."""
    cov = covariates or []
    rows = complete(df, [x, m, y, *cov])

    def part(fit: DataFrame, term: str, name: str) -> DataFrame:
        return fit.filter(F.col("term") == term).select(*keys, F.col("beta").alias(name), F.col("se").alias(f"{name}_se"), F.col("p").alias(f"{name}_p"))

    one, two, three = ols_multi(rows, keys, m, [x, *cov]), ols_multi(rows, keys, y, [x, m, *cov]), ols_multi(rows, keys, y, [x, *cov])
    got = part(one, x, "a").join(one.filter("term = 'intercept'").select(*keys, "n"), keys)
    for fit, term, name in ((two, m, "b"), (two, x, "direct"), (three, x, "total")):
        got = got.join(part(fit, term, name), keys)
    return got


def bootstrap_mediation(df: DataFrame, keys: list[str], x: str, m: str, y: str, row: str, reps: int = 1000, level: float = 0.95, seed: int = 42, covariates: list[str] | None = None, draws: str = "md5") -> DataFrame:
    """``a, b, direct, total, indirect, low, high, p, proportion, n`` of every key: the effects on the sample, the
    percentile interval of the resamples, p = 2 * the share of resamples at or beyond 0 against the sign of the indirect
    effect (1 at most) and |indirect / total|."""
    if covariates:
        point = mediation_paths(df, keys, x, m, y, covariates).withColumn("indirect", F.col("a") * F.col("b"))
    else:
        point = _effects(_centred(df, keys, x, m, y, row).groupBy(*keys).agg(*_paths(F.lit(1.0)), F.count("*").alias("n")))
    point = point.select(*keys, "n", "a", "b", "direct", "total", "indirect")
    tail = (1 - level) / 2
    boot = bootstrap_effects(df, keys, x, m, y, row, reps, seed, covariates, draws=draws).filter(F.col("indirect").isNotNull()).groupBy(*keys).agg(
        F.percentile("indirect", F.array(F.lit(tail), F.lit(1 - tail))).alias("ci"), F.avg((F.col("indirect") <= 0).cast("double")).alias("below"), F.avg((F.col("indirect") >= 0).cast("double")).alias("above")
    )
    return _with_interval(point.join(boot, keys, "left") if keys else point.crossJoin(F.broadcast(boot)), keys)


def _with_interval(got: DataFrame, keys: list[str]) -> DataFrame:
    return got.select(
        *keys, "n", "a", "b", "direct", "total", "indirect", F.col("ci")[0].alias("low"), F.col("ci")[1].alias("high"),
        F.least(F.lit(1.0), 2 * F.when(F.col("indirect") >= 0, F.col("below")).otherwise(F.col("above"))).alias("p"),
        F.when(F.abs("total") > 1e-10, F.abs(F.col("indirect") / F.col("total"))).alias("proportion"),
    )


def mediation_table(df: DataFrame, keys: list[str], x: str, m: str, y: str, row: str, reps: int = 1000, seed: int = 42, covariates: list[str] | None = None, draws: str = "md5") -> DataFrame:
    """A tidy row for each model: the four paths with their p-values, the indirect effect with its interval, p and
    share, and the false discovery rate over all models."""
    paths = mediation_paths(df, keys, x, m, y, covariates).select(*keys, "n", *[f"{c}{s}" for c in ("a", "b", "total", "direct") for s in ("", "_p")])
    boot = bootstrap_mediation(df, keys, x, m, y, row, reps, seed=seed, covariates=covariates, draws=draws).select(*keys, "indirect", "low", "high", "p", "proportion")
    return fdr_bh(paths.join(boot, keys), [], "p", order=keys)


def percentile_ci(df: DataFrame, keys: list[str], value: str, level: float = 0.95) -> DataFrame:
    tail = (1 - level) / 2
    got = df.groupBy(*keys).agg(F.percentile(value, F.array(F.lit(tail), F.lit(1 - tail))).alias("ci"))
    return got.select(*keys, F.col("ci")[0].alias("low"), F.col("ci")[1].alias("high"))


def sobel_mediation(df: DataFrame, keys: list[str], x: str, m: str, y: str) -> DataFrame:
    """The simple form: a from M on X, b from Y on M alone; ``indirect, se, z, p, percent`` by Sobel's formula."""
    one = ols_simple(complete(df, [x, m, y]), keys, x, m).select(*keys, F.col("slope").alias("a"), F.col("se").alias("se_a"))
    two = ols_simple(complete(df, [x, m, y]), keys, m, y).select(*keys, F.col("slope").alias("b"), F.col("se").alias("se_b"))
    three = ols_simple(complete(df, [x, m, y]), keys, x, y).select(*keys, F.col("slope").alias("c"))
    got = one.join(two, keys).join(three, keys) if keys else one.crossJoin(F.broadcast(two)).crossJoin(F.broadcast(three))
    got = got.withColumn("indirect", F.col("a") * F.col("b")).withColumn("se", F.sqrt(F.pow(F.col("a") * F.col("se_b"), 2) + F.pow(F.col("b") * F.col("se_a"), 2)))
    got = got.withColumn("z", over(F.col("indirect"), F.col("se")))
    return got.select(*keys, "a", "b", "c", "indirect", "se", "z", over(F.col("indirect") * 100, F.col("c")).alias("percent")).withColumn("p", normal_p("z"))


def _pair_effects(df: DataFrame, keys: list[str], x: str, mediators: list[str], outcomes: list[str], row: str, reps: int, seed: int, covariates: list[str] | None, draws: str) -> DataFrame:
    """The list form of :func:`bootstrap_effects`.

    Every resample is drawn once for all pairs. Rows are keyed by which mediators and outcomes they lack; one matrix of sums
    of products over all variables for each such pattern and resample holds what every pair needs, covariates included, and
    a pair's system is the part of it over the patterns that lack neither."""
    cov = covariates or []
    several = [*dict.fromkeys([*mediators, *outcomes])]
    there = lambda c: F.col(c).cast("double").isNotNull() & ~F.isnan(F.col(c).cast("double"))
    base = complete(df, [x, *cov])
    cols = [x, *several, *cov]
    mean = base.groupBy(*keys).agg(*[F.avg(F.when(there(c), F.col(c).cast("double"))).alias(f"__m{i}") for i, c in enumerate(cols)])
    rows = (base.join(mean, keys) if keys else base.crossJoin(F.broadcast(mean))).select(  # one row
        *keys, F.concat_ws("", *[there(c).cast("int").cast("string") for c in several]).alias("__has"), F.col(row).alias("__row"), *[(F.when(there(c), F.col(c).cast("double")) - F.col(f"__m{i}")).alias(f"__v{i}") for i, c in enumerate(cols)]
    )
    sums = _resampled_sums(_dealt(rows, bool(keys), draws, seed), [*keys, "__has"], [f"__v{i}" for i in range(len(cols))], reps, seed, whole=True, draws=draws)
    q, at = 1 + len(cols), {c: 1 + i for i, c in enumerate(cols)}
    fixed = [0, 1, *range(1 + 1 + len(several), q)]  # 1, x, covariates
    pairs = [(m, y) for m in mediators for y in outcomes if m != y]
    names = ["mediator", "outcome", "rep", "n", "a", "b", "direct", "total", "indirect"]

    def solve(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        has, reps_of = f["__has"].to_numpy(), f["rep"].to_numpy()
        s = np.zeros((len(f), q, q))
        for i in range(q):
            for j in range(i, q):
                s[:, i, j] = s[:, j, i] = f[f"s{i}_{j}"].to_numpy(float)
        out = []
        for m, y in pairs:
            own = np.array([h[several.index(m)] == "1" and h[several.index(y)] == "1" for h in has])
            for rep in np.unique(reps_of[own]):
                z = s[own & (reps_of == rep)].sum(axis=0)
                two = [*fixed, at[m]]
                try:
                    a = np.linalg.solve(z[np.ix_(fixed, fixed)], z[fixed, at[m]])[1]
                    c = np.linalg.solve(z[np.ix_(fixed, fixed)], z[fixed, at[y]])[1]
                    b = np.linalg.solve(z[np.ix_(two, two)], z[two, at[y]])
                    out.append([*key[:-1], m, y, int(rep), int(z[0, 0]), a, b[-1], b[1], c, a * b[-1]])
                except np.linalg.LinAlgError:
                    continue
        return pd.DataFrame(out, columns=[*keys, *names])

    types = dict(df.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "mediator string, outcome string, rep int, n long, a double, b double, direct double, total double, indirect double"])
    return sums.withColumn("__block", F.expr("(rep + 1) div 100")).groupBy(*keys, "__block").applyInPandas(solve, schema)


def batch_mediation(df: DataFrame, x: str, mediators: list[str], outcomes: list[str], row: str, reps: int = 1000, level: float = 0.95, seed: int = 42, covariates: list[str] | None = None, draws: str = "md5") -> DataFrame:
    """All mediators by all outcomes, with ``covariates`` in every equation: a row for each pair as of
    :func:`bootstrap_mediation` on the rows that are complete for it, with the false discovery rate over the pairs. Every
    resample is drawn once for all pairs; see :func:`_pair_effects`. ``x`` and covariates must be there."""
    got = written(bootstrap_effects(df, [], x, mediators, outcomes, row, reps, seed, covariates, draws=draws), "effects")
    point = got.filter("rep = -1").drop("rep")
    tail = (1 - level) / 2
    by = ["mediator", "outcome"]
    boot = got.filter("rep >= 0").groupBy(*by).agg(
        F.percentile("indirect", F.array(F.lit(tail), F.lit(1 - tail))).alias("ci"), F.avg((F.col("indirect") <= 0).cast("double")).alias("below"), F.avg((F.col("indirect") >= 0).cast("double")).alias("above")
    )
    return fdr_bh(_with_interval(point.join(boot, by, "left"), by), [], "p", order=by)


def component_mediation(means: DataFrame, outcomes: DataFrame, subject: str, keys: list[str], groups: DataFrame, first: str | Column, names: list[str], reps: int = 1000, seed: int = 42, covariates: list[str] | None = None) -> DataFrame:
    """Each component's mean edge as the mediator between the group (1 for ``first``, a name or the column that has it
    for each component, else 0) and each outcome, with ``covariates`` (columns of ``outcomes``) in every equation."""
    rows = means.join(groups, subject).join(outcomes, subject).withColumn("x", (F.col("grp") == first).cast("double"))
    cells = F.array(*[F.struct(F.lit(y).alias("outcome"), F.col(y).cast("double").alias("y")) for y in names])
    cov = covariates or []
    long = rows.select(subject, *keys, "x", F.col("weight").alias("m"), *cov, F.explode(cells).alias("c")).select(subject, *keys, "x", "m", *cov, "c.*")
    return fdr_bh(bootstrap_mediation(long, [*keys, "outcome"], "x", "m", "y", subject, reps, seed=seed, covariates=cov or None), [], "p", order=[*keys, "outcome"])


# --- mixed models -----------------------------------------------------------------------------------------------------------


def _fitted(stats: list[tuple[int, np.ndarray, np.ndarray, float, float, np.ndarray]], p: int, restricted: bool = True) -> dict:
    """Restricted or full maximum likelihood with a random intercept, from each subject's (n, X'X, X'y, y'y, 1'y, X'1). The
    likelihood is profiled to the ratio of variances: a log grid, then golden section."""
    n_all = sum(s[0] for s in stats)
    ns = np.array([s[0] for s in stats], float)
    xx, xy, yy = np.array([s[1] for s in stats]), np.array([s[2] for s in stats]), np.array([s[3] for s in stats])
    sy, sx = np.array([s[4] for s in stats]), np.array([s[5] for s in stats])

    def fit(lam: float):
        d = lam / (1 + lam * ns)
        a = xx.sum(axis=0) - np.einsum("i,ij,ik->jk", d, sx, sx)
        b = xy.sum(axis=0) - np.einsum("i,ij,i->j", d, sx, sy)
        inv = np.linalg.pinv(a)
        beta = inv @ b
        rss = max(float(yy.sum() - (d * sy**2).sum() - beta @ b), 1e-300)
        free = n_all - p if restricted else n_all
        s2 = rss / free
        sign, logdet = np.linalg.slogdet(a)
        cost = free * np.log(s2) + np.log1p(lam * ns).sum() + (logdet if sign > 0 and restricted else 0.0)
        return cost, beta, inv * s2, s2

    grid = np.concatenate([[0.0], np.logspace(-6, 5, 56)])
    costs = [fit(g)[0] for g in grid]
    i = int(np.argmin(costs))
    lo, hi = np.log(max(grid[max(i - 1, 0)], 1e-9)), np.log(max(grid[min(i + 1, len(grid) - 1)], 1e-9))
    g = (5**0.5 - 1) / 2
    for _ in range(60):
        u, v = hi - g * (hi - lo), lo + g * (hi - lo)
        if fit(np.exp(u))[0] < fit(np.exp(v))[0]:
            hi = v
        else:
            lo = u
    lam = float(np.exp((lo + hi) / 2))
    if fit(0.0)[0] <= fit(lam)[0]:
        lam = 0.0
    cost, beta, cov, s2 = fit(lam)
    return {"lambda": lam, "beta": beta, "se": np.sqrt(np.maximum(np.diag(cov), 0)), "within": s2, "between": lam * s2, "cost": cost, "n": n_all, "cov": cov}


def _subject_sums(f: pd.DataFrame, p: int) -> list[tuple]:
    """What :func:`_fitted` takes, from a row of sums of products for each subject."""
    s = np.zeros((len(f), p + 1, p + 1))
    for i in range(p + 1):
        for j in range(i, p + 1):
            s[:, i, j] = s[:, j, i] = f[f"s_{i}_{j}"].to_numpy(float)
    return [(int(n), z[:p, :p], z[:p, p], z[p, p], z[0, p], z[:p, 0]) for n, z in zip(f["n"], s, strict=True)]


def adjusted_contrasts(df: DataFrame, keys: list[str], subject: str, y: str, group: str, levels: list[str], covariates: list[str], by_group: list[str] | None = None, level: float = 0.95) -> DataFrame:
    """Estimated marginal means of the groups at the covariates' means and all their differences, from the mixed model
    ``y ~ group + covariates + group : by_group + (1 | subject)``: ``g1, g2, mean1, mean2, diff, se, z, p, p_adjusted, low,
    high`` of every pair and key.

    A mean is l'b with l the design row of its group at the covariates' means (over all rows of the key), a difference
    (l1 - l2)'b with variance (l1 - l2)' V (l1 - l2), V the covariance of the estimates. p is normal, ``p_adjusted`` that
    times the number of pairs (1 at most). A key in which a level has no rows, or a covariate no spread, gives no row."""
    crossed = by_group or []
    others = levels[1:]
    rows = complete(df, [y, *covariates]).filter(F.col(group).isin(levels) & F.col(subject).isNotNull())
    mean = rows.groupBy(*keys).agg(F.avg(y).alias("__mean"), *[F.avg(c).alias(f"__a{i}") for i, c in enumerate(covariates)])
    names = ["__one", *[f"__g{i}" for i in range(len(others))], *[f"__c{i}" for i in range(len(covariates))], *[f"__x{i}_{j}" for i in range(len(others)) for j in range(len(crossed))], "__y"]
    cols = {"__one": F.lit(1.0), "__y": F.col(y) - F.col("__mean")} | {f"__g{i}": (F.col(group) == g).cast("double") for i, g in enumerate(others)}
    cols |= {f"__c{i}": F.col(c) - F.col(f"__a{i}") for i, c in enumerate(covariates)}  # so that a mean's row has 0 there
    cols |= {f"__x{i}_{j}": (F.col(group) == g).cast("double") * (F.col(c) - F.col(f"__a{covariates.index(c)}")) for i, g in enumerate(others) for j, c in enumerate(crossed)}
    sums = join_keys(rows, mean, keys).withColumns(cols).groupBy(*keys, subject).agg(F.count("*").alias("n"), F.first("__mean").alias("__mean"), *_sums(names))
    types, p = dict(df.dtypes), len(names) - 1
    columns = [*keys, "g1", "g2", "mean1", "mean2", "diff", "se", "z", "p", "p_adjusted", "low", "high"]
    width = NormalDist().inv_cdf((1 + level) / 2)
    pairs = [(i, j) for i in range(len(levels)) for j in range(i + 1, len(levels))]

    def run(key, f: pd.DataFrame) -> pd.DataFrame:
        stats = _subject_sums(f, p)
        design = sum(s[1] for s in stats)
        if sum(s[0] for s in stats) <= p or np.linalg.matrix_rank(design) < p:
            return pd.DataFrame(columns=columns)
        m = _fitted(stats, p)
        at = np.zeros((len(levels), p))
        at[:, 0] = 1
        at[np.arange(1, len(levels)), np.arange(1, len(levels))] = 1
        means = at @ m["beta"] + f["__mean"].iloc[0]
        out = []
        for i, j in pairs:
            l_ = at[i] - at[j]
            diff, se = float(means[i] - means[j]), float(max(l_ @ m["cov"] @ l_, 0)) ** 0.5
            z = diff / se if se > 0 else np.nan
            one = float(2 * special.normal_sf(abs(z)))
            out.append([*key, levels[i], levels[j], means[i], means[j], diff, se, z, one, min(1.0, one * len(pairs)), diff - width * se, diff + width * se])
        return pd.DataFrame(out, columns=columns)

    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "g1 string, g2 string", *(f"{c} double" for c in columns[len(keys) + 2 :])])
    return sums.groupBy(*keys).applyInPandas(run, schema)


def mixed_model(df: DataFrame, keys: list[str], subject: str, y: str, group: str, reference: str, levels: list[str], covariates: list[str] | None = None) -> DataFrame:
    """``y ~ group + covariates + (1 | subject)`` by REML for every key: ``term, beta, se, z, p, low, high`` with
    ``var_between, var_within, icc, aic, bic, n, n_subjects``; the last criteria from full maximum likelihood, so that models of
    other fixed effects compare. Terms: the intercept, each level against ``reference``, each
    covariate. Only sums for each (key, subject) reach the fit. y is centred by its mean within the key first."""
    covariates = covariates or []
    others = [x for x in levels if x != reference]
    rows = complete(df, [y, *covariates]).filter(F.col(group).isin(levels) & F.col(subject).isNotNull())
    mean = rows.groupBy(*keys).agg(F.avg(y).alias("__mean"))
    names = ["__one", *[f"__g{i}" for i in range(len(others))], *covariates, "__y"]
    cols = {f"__g{i}": (F.col(group) == g).cast("double") for i, g in enumerate(others)} | {"__one": F.lit(1.0), "__y": F.col(y) - F.col("__mean")}
    rows = join_keys(rows, mean, keys).withColumns(cols)
    sums = rows.groupBy(*keys, subject).agg(F.count("*").alias("n"), F.first("__mean").alias("__mean"), *_sums(names))
    types = dict(df.dtypes)
    terms = ["Intercept", *[f"{g} vs {reference}" for g in others], *covariates]
    p = len(names) - 1

    def run(key, f: pd.DataFrame) -> pd.DataFrame:
        stats = _subject_sums(f, p)
        if sum(x[0] for x in stats) <= p:
            return pd.DataFrame(columns=columns)
        m, full = _fitted(stats, p), _fitted(stats, p, restricted=False)
        loss = full["cost"] + full["n"] * (1 + np.log(2 * np.pi))  # -2 log likelihood
        beta = m["beta"].copy()
        beta[0] += f["__mean"].iloc[0]
        total = m["between"] + m["within"]
        out = []
        for i, term in enumerate(terms):
            z = beta[i] / m["se"][i] if m["se"][i] > 0 else np.nan
            out.append([*key, term, beta[i], m["se"][i], z, float(2 * special.normal_sf(abs(z))), beta[i] - 1.96 * m["se"][i], beta[i] + 1.96 * m["se"][i], m["between"], m["within"], m["between"] / total if total > 0 else 0.0, loss + 2 * (p + 2), loss + np.log(full["n"]) * (p + 2), m["n"], len(f)])
        return pd.DataFrame(out, columns=columns)

    columns = [*keys, "term", "beta", "se", "z", "p", "low", "high", "var_between", "var_within", "icc", "aic", "bic", "n", "n_subjects"]
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "term string, beta double, se double, z double, p double, low double, high double, var_between double, var_within double, icc double, aic double, bic double, n long, n_subjects long"])
    return sums.groupBy(*keys).applyInPandas(run, schema)


def _subject_moments(df: DataFrame, keys: list[str], subject: str, y: str) -> DataFrame:
    return complete(df, [y]).groupBy(*keys, subject).agg(F.count("*").alias("n"), F.avg(y).alias("m"), F.var_samp(y).alias("v"))


def _variances(per: DataFrame, keys: list[str]) -> DataFrame:
    """``grand, var_between, var_within`` of every key from the moments of its subjects."""
    s = per.groupBy(*keys).agg(
        F.count("*").alias("k"), F.sum("n").alias("total"), F.sum(F.col("n") * F.col("n")).alias("n2"), F.sum((F.col("n") - 1) * F.coalesce("v", F.lit(0.0))).alias("ssw"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand")
    )
    joined = per.join(s.select(*keys, "grand"), keys) if keys else per.crossJoin(F.broadcast(s.select("grand")))
    ssb = joined.groupBy(*keys).agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("grand"), 2)).alias("ssb"))
    s = s.join(ssb, keys) if keys else s.crossJoin(F.broadcast(ssb))
    msw, msb = F.col("ssw") / (F.col("total") - F.col("k")), F.col("ssb") / (F.col("k") - 1)
    n0 = (F.col("total") - F.col("n2") / F.col("total")) / (F.col("k") - 1)
    return s.select(*keys, "grand", F.greatest(F.lit(0.0), (msb - msw) / n0).alias("var_between"), msw.alias("var_within"))


def icc_anova(df: DataFrame, keys: list[str], subject: str, y: str) -> DataFrame:
    """``icc, var_between, var_within`` by the estimator of one-way analysis of variance (equal to REML for balanced
    data that has a positive estimate)."""
    s = _variances(_subject_moments(df, keys, subject, y), keys)
    return s.select(*keys, "var_between", "var_within", over(F.col("var_between"), F.col("var_between") + F.col("var_within")).alias("icc"))


def residuals(df: DataFrame, keys: list[str], subject: str, y: str) -> DataFrame:
    """Every row with ``fitted`` (the shrunken mean of its subject) and ``residual`` of the model of the mean and a
    random intercept, variances by analysis of variance. Rows are folded into subjects once, and meet what their subject is
    fitted to once."""
    per = written(_subject_moments(df, keys, subject, y), "subjects")
    v = _variances(per, keys)
    per = per.join(v, keys) if keys else per.crossJoin(F.broadcast(v))
    shrink = F.when(F.col("var_between") > 0, F.col("var_between") / (F.col("var_between") + F.col("var_within") / F.col("n"))).otherwise(0.0)
    fitted = per.select(*keys, subject, (F.col("grand") + shrink * (F.col("m") - F.col("grand"))).alias("fitted"))
    rows = complete(df, [y]).join(fitted, [*keys, subject])
    return rows.withColumn("residual", F.col(y) - F.col("fitted")).select(*df.columns, "fitted", "residual")


def residual_summary(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """``keys``, a quantile for each of ``probs``, ``n``, ``mean`` and ``sd`` of a column that lies about 0, from its distinct
    values by ranges over all tasks, so that a key may be of any size."""
    x, t = F.col(value), F.col("t")
    got = quantiles(df.filter(~F.isnan(x.cast("double"))), keys, value, probs, {"__n": F.sum(t), "__s": F.sum(t * x), "__ss": F.sum(t * x * x)})
    n, mean = F.col("__n"), F.col("__s") / F.col("__n")
    sd = F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), F.col("__ss") - mean * F.col("__s")) / (n - 1)))
    return got.select(*keys, *probs, n.alias("n"), mean.alias("mean"), sd.alias("sd"))


def qq_points(df: DataFrame, keys: list[str], value: str, points: int = 19) -> DataFrame:
    """``keys, p, normal, sample``: the quantiles of a column against the normal scores of a fixed grid of probabilities
    i / (points + 1), by ranges of values over all tasks, so that a key may be of any size."""
    grid = [i / (points + 1) for i in range(1, points + 1)]
    q = quantiles(df.filter(~F.isnan(F.col(value).cast("double"))), keys, value, {f"__q{i}": p for i, p in enumerate(grid)})
    cells = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(NormalDist().inv_cdf(p)).alias("normal"), F.col(f"__q{i}").alias("sample")) for i, p in enumerate(grid)])
    return q.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.*")


def within_subject_sd(df: DataFrame, keys: list[str], subject: str, group: str, y: str) -> DataFrame:
    """``keys, subject, group, sd``: the deviation over a subject's rows, at least two."""
    return complete(df, [y]).groupBy(*keys, subject, group).agg(F.stddev_samp(y).alias("sd"), F.count("*").alias("__n")).filter("__n > 1").drop("__n")
