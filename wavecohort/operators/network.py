"""Edge tables of networks: tests on edges, components, permutation tests, regions and graph metrics.

An edge table has ``ch1 < ch2`` and a ``weight``; networks of many subjects, bands and pairs of groups are one table with
key columns. Shortest paths run in numpy on the matrix of a (subject, band); permutations add up sums of (permutation,
edge) over tasks and find components in tables of edges; everything else is joins and aggregations on edges.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavecohort.functions.scratch import forget, written
from wavecohort.operators.components import connected_components
from wavecohort.operators.groupstats import group_moments, group_pairs
from wavecohort.operators.permute import add_up, blocks, digests, label_cuts, labels
from wavecohort.operators.select import small_side


def welch_t(m1: Column, m2: Column, v1: Column, v2: Column, n1: Column, n2: Column) -> Column:
    se = F.sqrt(F.coalesce(v1, F.lit(0.0)) / n1 + F.coalesce(v2, F.lit(0.0)) / n2)
    return F.when(se > 0, (m1 - m2) / se).otherwise(0.0)


def welch_t_edges(edges: DataFrame, keys: list[str], group: str = "grp") -> DataFrame:
    """``keys, ch1, ch2, g1, g2, t`` for every pair of groups; a zero denominator gives t = 0."""
    by = [*keys, "ch1", "ch2"]
    p = group_pairs(group_moments(edges, by, group, "weight"), by)
    return p.select(*by, "g1", "g2", welch_t(*[F.col(c) for c in ("mean1", "mean2", "var1", "var2", "n1", "n2")]).alias("t"))


def threshold_edges(t: DataFrame, thr: float | Column, tail: str = "both") -> DataFrame:
    """Edges beyond the threshold (strictly), with their ``direction``."""
    thr = F.lit(float(thr)) if isinstance(thr, (int, float)) else thr
    keep = {"both": F.abs("t") > thr, "positive": F.col("t") > thr, "negative": F.col("t") < -thr}[tail]
    return t.filter(keep).withColumn("direction", F.when(F.col("t") > 0, "positive").otherwise("negative"))


def edge_components(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Every edge with its ``component``, the smallest node of it, within the keys. All keys' graphs are one graph of
    (key, node) names, so their number costs no extra job."""
    name = lambda c: F.concat_ws("␟", *[F.col(k).cast("string") for k in keys], F.col(c))
    nodes = edges.withColumns({"__u": name("ch1"), "__v": name("ch2")})
    comp = connected_components(nodes.select("__u", "__v"), "__u", "__v").withColumnRenamed("node", "__u")
    got = nodes.join(comp, "__u")
    return got.withColumn("component", F.element_at(F.split("component", "␟"), -1)).drop("__u", "__v")


def component_stats(edges: DataFrame, keys: list[str]) -> DataFrame:
    """``n_edges, n_nodes, intensity`` of every component of :func:`edge_components`."""
    by = [*keys, "component"]
    ends = edges.select(*by, F.explode(F.array("ch1", "ch2")).alias("node")).groupBy(*by).agg(F.countDistinct("node").alias("n_nodes"))
    return edges.groupBy(*by).agg(F.count("*").alias("n_edges"), F.sum(F.abs("t")).alias("intensity")).join(ends, by)


def component_numbers(stats: DataFrame, keys: list[str]) -> DataFrame:
    """``component_id`` from 1 within the keys, positive components first, then by smallest node."""
    w = Window.partitionBy(*keys).orderBy(F.desc("direction"), "component")
    return stats.withColumn("component_id", F.row_number().over(w))


def _largest(ch1: list, ch2: list, t: np.ndarray, intensity: bool) -> float:
    """The largest component statistic of a set of edges (union-find over their ends)."""
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in zip(ch1, ch2, strict=True):
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    total: dict = {}
    for a, v in zip(ch1, np.abs(t) if intensity else np.ones(len(t)), strict=True):
        r = find(a)
        total[r] = total.get(r, 0.0) + v
    return max(total.values(), default=0.0)


#: Subjects of one network, and permutations, of a group of the job at most.
SUBJECTS_AT_ONCE, PERMS_AT_ONCE = 2000, 500


def permuted_maxima(values: DataFrame, keys: list[str], pairs: list[tuple[str, str]], items: list[str], value: str, statistic: Callable[[list[tuple], np.ndarray, np.ndarray], float], thr: float, n_perms: int, seed: int = 42, group: str = "grp", subject: str = "subject_id") -> DataFrame:
    """``keys, g1, g2, perm, direction, max_stat``: the largest ``statistic`` (of the names of the items, their t-values and
    which of these are beyond the threshold) of every permutation of the group labels.

    A permutation gives the first group's number of labels to the subjects of the smallest md5 of (seed, permutation,
    subject): the same in every engine and partitioning. ``values`` has a row for each key, subject and item (an edge, a
    channel). A group of the job holds ``SUBJECTS_AT_ONCE`` subjects of one network at most and ``PERMS_AT_ONCE``
    permutations, ``BLOCK`` of them at a time: its memory depends on neither the number of networks nor that of
    permutations. A network of more subjects lies in several groups, whose sums are added up for each block before
    t-values are made. Subjects need every item of their network; a pair without subjects of both groups has no rows.
    """
    spark = values.sparkSession
    table = spark.createDataFrame(pairs, "g1 string, g2 string")
    both = values.join(F.broadcast(table), (F.col(group) == F.col("g1")) | (F.col(group) == F.col("g2")))
    by = [*keys, "g1", "g2"]
    e = F.array_sort(F.collect_list(F.struct(*items, F.col(value).cast("double").alias("v")))).alias("e")
    rows = written(both.groupBy(*by, subject, group).agg(e), "networks")
    cells = rows.select(*by, F.col(group).alias("__g"), F.explode("e").alias("c")).select(*by, "__g", "c.*").groupBy(*by, *items)
    per = cells.agg(F.count("*").alias("n"), F.count_if(F.col("__g") == F.col("g1")).alias("n1"), F.avg("v").alias("mean"), F.var_pop("v").alias("var"))
    nets: dict[tuple, list] = {}
    for r in per.sort(*by, *items).collect():  # a row for each key and item
        nets.setdefault(tuple(r[k] for k in by), []).append(r)
    if any(len({(r["n"], r["n1"]) for r in v}) > 1 for v in nets.values()):
        raise ValueError("a subject lacks an item of its network")
    nets = {k: v for k, v in nets.items() if 0 < v[0]["n1"] < v[0]["n"]}
    sizes = {k: (v[0]["n"], v[0]["n1"]) for k, v in nets.items()}
    mean = {k: np.array([r["mean"] for r in v]) for k, v in nets.items()}
    square = {k: np.array([r["var"] * r["n"] for r in v]) for k, v in nets.items()}
    names = {k: [tuple(r[c] for c in items) for r in v] for k, v in nets.items()}
    cuts = label_cuts(rows, by, subject, sizes, n_perms, seed)
    types = dict(rows.dtypes)
    head = "".join(f"`{k}` {types[k]}, " for k in by)
    n_parts = max([1, *(-(-n // SUBJECTS_AT_ONCE) for n, _ in sizes.values())])
    columns = [*by, "perm", "direction", "max_stat"]

    def judged(k: tuple, perms: range, s1: np.ndarray, q1: np.ndarray) -> list[list]:
        n, n1 = sizes[k]
        n2 = n - n1
        m1, m2 = s1 / n1, -s1 / n2  # values are less their means, so all sums are 0
        v1, v2 = (q1 - n1 * m1**2) / max(n1 - 1, 1), (square[k] - q1 - n2 * m2**2) / max(n2 - 1, 1)
        se = np.sqrt(np.maximum(v1, 0) / n1 + np.maximum(v2, 0) / n2)
        t = np.where(se > 1e-12, (m1 - m2) / np.where(se > 1e-12, se, 1), 0.0)
        return [[*k, p, d, float(statistic(names[k], x, hit))] for p, x in zip(perms, t, strict=True) for d, hit in (("positive", x > thr), ("negative", x < -thr))]

    def sums(key: tuple, f: pd.DataFrame) -> Iterator[tuple[range, np.ndarray, np.ndarray]]:
        k, turn = tuple(key[:-2]), key[-1]
        ids, w = [x.encode() for x in f["__id"]], np.array(f["w"].tolist(), float) - mean[k]
        at_once = range(turn * PERMS_AT_ONCE, min(n_perms, (turn + 1) * PERMS_AT_ONCE))
        for some in blocks(len(at_once)):
            perms = at_once[some.start : some.stop]
            hi, lo = digests(seed, perms, ids)
            one = labels(hi, lo, cuts[k], perms)
            yield perms, one @ w, one @ w**2

    def whole(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        out = [r for s in sums(key, f) for r in judged(tuple(key[:-2]), *s)] if tuple(key[:-2]) in sizes else []
        return pd.DataFrame(out, columns=columns)

    def some(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        got = list(sums(key, f)) if tuple(key[:-2]) in sizes else []
        out = pd.DataFrame({"first": [p.start for p, _, _ in got], "s": [s.tobytes() for _, s, _ in got], "q": [q.tobytes() for _, _, q in got]})
        return out.assign(**dict(zip(by, key[:-2], strict=True)))[[*by, "first", "s", "q"]]

    def joined(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        k = tuple(key[:-1])
        s, q = (np.frombuffer(f[c].iloc[0], float).reshape(-1, len(names[k])) for c in ("s", "q"))
        return pd.DataFrame(judged(k, range(key[-1], key[-1] + len(s)), s, q), columns=columns)

    turns = F.explode(F.sequence(F.lit(0), F.lit(max(0, (n_perms - 1) // PERMS_AT_ONCE)))).alias("__turn")
    dealt = rows.select(*by, F.col(subject).cast("string").alias("__id"), F.transform("e", lambda x: x["v"]).alias("w"), turns)
    dealt = dealt.withColumn("__part", F.pmod(F.xxhash64("__id"), F.lit(n_parts))).groupBy(*by, "__part", "__turn")
    schema = f"{head}perm int, direction string, max_stat double"
    if n_parts == 1:
        return dealt.applyInPandas(whole, schema)
    parts_of = dealt.applyInPandas(some, f"{head}first int, s binary, q binary")
    return add_up(parts_of, [*by, "first"], ["s", "q"]).groupBy(*by, "first").applyInPandas(joined, schema)


def null_distribution(edges: DataFrame, keys: list[str], pairs: list[tuple[str, str]], thr: float, n_perms: int, seed: int = 42, statistic: str = "size", group: str = "grp", subject: str = "subject_id") -> DataFrame:
    """``keys, g1, g2, perm, direction, max_stat``: the largest component of every permutation of the group labels, by its
    number of edges (``size``) or the sum of their absolute t-values; see :func:`permuted_maxima`."""
    intensity = statistic == "intensity"

    def largest(names: list[tuple], t: np.ndarray, hit: np.ndarray) -> float:
        at = np.flatnonzero(hit)
        return _largest([names[i][0] for i in at], [names[i][1] for i in at], t[at], intensity)

    return permuted_maxima(edges, keys, pairs, ["ch1", "ch2"], "weight", largest, thr, n_perms, seed, group, subject)


def channel_clusters(t: DataFrame, keys: list[str], near: DataFrame, thr: float) -> DataFrame:
    """``keys, direction, channel, t, cluster``: channels beyond the threshold, gathered with their neighbours of the same
    direction; a cluster has the name of its smallest channel. ``near``: ``a, b``, the neighbours of the montage."""
    hit = threshold_edges(t, thr)
    by = [*keys, "direction"]
    one = hit.select(*by, F.col("channel").alias("ch1"))
    two = hit.select(*by, F.col("channel").alias("ch2"))
    links = one.join(near.select(F.col("a").alias("ch1"), F.col("b").alias("ch2")), "ch1").join(two, [*by, "ch2"])
    comp = edge_components(links.select(*by, "ch1", "ch2"), by)
    ends = comp.select(*by, F.explode(F.array("ch1", "ch2")).alias("channel"), F.col("component").alias("cluster")).distinct()
    got = hit.join(ends, [*by, "channel"], "left").withColumn("cluster", F.coalesce("cluster", "channel"))  # one without such neighbours is a cluster
    return got.select(*by, "channel", "t", "cluster")


def cluster_permutation(values: DataFrame, keys: list[str], pairs: list[tuple[str, str]], near: list[tuple[str, str]], thr: float, n_perms: int, seed: int = 42, alpha: float = 0.05, group: str = "grp", subject: str = "subject_id", channel: str = "channel", value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Cluster-based permutation test over channels, for all keys and pairs of groups in one job: the clusters, with
    ``n_channels``, ``mass`` (the sum of absolute t-values), ``p_value`` and ``significant``, and the channels of each.

    p = (#{null >= mass} + 1) / (n_perms + 1); the null is the largest mass of each permutation, each direction against its
    own. ``near``: pairs of neighbouring channels, a setting of the montage."""
    spark = values.sparkSession
    by = [*keys, "g1", "g2", "direction"]
    rows = values.select(*keys, subject, group, F.col(channel).alias("channel"), F.col(value).alias("weight"))
    pair = group_pairs(group_moments(rows, [*keys, "channel"], group, "weight"), [*keys, "channel"])
    t = pair.select(*keys, "g1", "g2", "channel", welch_t(*[F.col(c) for c in ("mean1", "mean2", "var1", "var2", "n1", "n2")]).alias("t"))
    t = t.join(F.broadcast(spark.createDataFrame(pairs, "g1 string, g2 string")), ["g1", "g2"], "left_semi")
    members = channel_clusters(t, [*keys, "g1", "g2"], spark.createDataFrame(near, "a string, b string"), thr)
    stats = members.groupBy(*by, "cluster").agg(F.count("*").alias("n_channels"), F.sum(F.abs("t")).alias("mass"))

    def largest(names: list[tuple], x: np.ndarray, hit: np.ndarray) -> float:
        at = {names[i][0]: i for i in np.flatnonzero(hit)}
        links = [(a, b) for a, b in near if a in at and b in at]
        ends = [*links, *((a, a) for a in at)]
        mass = [abs(x[at[a]]) if a == b else 0.0 for a, b in ends]
        return _largest([a for a, _ in ends], [b for _, b in ends], np.array(mass), True)

    null = permuted_maxima(rows, keys, pairs, ["channel"], "weight", largest, thr, n_perms, seed, group, subject)
    over = stats.join(null, by).groupBy(*by, "cluster").agg(F.sum((F.col("max_stat") >= F.col("mass") - 1e-9).cast("long")).alias("__over"))
    got = stats.join(over, [*by, "cluster"]).withColumn("p_value", (F.col("__over") + 1) / F.lit(n_perms + 1.0)).drop("__over")
    return got.withColumn("significant", F.col("p_value") < alpha), members


def nbs(edges: DataFrame, keys: list[str], pairs: list[tuple[str, str]], thr: float, n_perms: int, seed: int = 42, statistic: str = "size", alpha: float = 0.05, group: str = "grp", subject: str = "subject_id") -> tuple[DataFrame, DataFrame]:
    """The network-based statistic for all keys and pairs of groups in one job: the summary of components, and the
    supra-threshold edges with their component's p-value. p = (#{null >= statistic} + 1) / (n_perms + 1), each direction
    against its own null."""
    table = F.broadcast(edges.sparkSession.createDataFrame(pairs, "g1 string, g2 string"))
    t = welch_t_edges(edges, keys, group).join(table, ["g1", "g2"], "left_semi")
    by = [*keys, "g1", "g2", "direction"]
    supra = edge_components(threshold_edges(t, thr), by)
    stats = component_stats(supra, by).withColumn("stat", F.col("n_edges").cast("double") if statistic == "size" else F.col("intensity"))
    null = null_distribution(edges, keys, pairs, thr, n_perms, seed, statistic, group=group, subject=subject)
    over = stats.join(null, by).groupBy(*by, "component").agg(F.sum((F.col("max_stat") >= F.col("stat")).cast("long")).alias("__over"))
    got = stats.join(over, [*by, "component"]).withColumn("p_value", (F.col("__over") + 1) / F.lit(n_perms + 1.0)).drop("__over")
    got = got.withColumn("significant", F.col("p_value") < alpha)
    return component_numbers(got, [*keys, "g1", "g2"]), supra.join(got.select(*by, "component", F.col("p_value").alias("component_p")), [*by, "component"])


def summary_with_empty(summary: DataFrame, grid: DataFrame, keys: list[str]) -> DataFrame:
    """Every row of ``grid`` (keys and pairs of groups), with a row of zeros and p = 1 where it has no component."""
    got = grid.join(summary, keys, "left")
    fill = {"component_id": 0, "n_edges": 0, "n_nodes": 0, "stat": 0.0, "p_value": 1.0, "significant": False, "direction": "none"}
    return got.withColumns({c: F.coalesce(F.col(c), F.lit(v).cast(dict(summary.dtypes)[c])) for c, v in fill.items()})


def symmetric(edges: DataFrame, value: str) -> DataFrame:
    """Both directions of every edge: the cells of the symmetric matrix."""
    other = [F.col("ch2").alias("ch1"), F.col("ch1").alias("ch2")]
    rest = [c for c in edges.columns if c not in ("ch1", "ch2")]
    return edges.select("ch1", "ch2", *rest).unionByName(edges.select(*other, *rest)).select("ch1", "ch2", *[c for c in rest if c != value], value)


def explore_thresholds(t: DataFrame, keys: list[str], thresholds: list[float]) -> DataFrame:
    """``keys, threshold, direction, n_supra, n_components, largest`` (edges of the largest component) of both directions
    at every threshold, with a row of zeros where nothing passes.

    Each direction's edges are joined once, from the largest absolute t-value down, into a merge forest; a threshold is the
    state of the forest when the last edge beyond it has been joined. One network's table of edges is a group."""
    types = dict(t.dtypes)
    cuts = sorted({float(x) for x in thresholds}, reverse=True)

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        out = []
        for direction, sign in (("positive", 1.0), ("negative", -1.0)):
            g = f.assign(a=f["t"] * sign)
            g = g[g["a"] > 0].sort_values("a", ascending=False, kind="stable")
            parent: dict = {}
            size: dict = {}  # edges of each root
            joined, most = 0, 0

            def find(x):
                while parent.setdefault(x, x) != x:
                    parent[x] = x = parent[parent[x]]  # noqa: B023
                return x

            edges = list(zip(g["a"], g["ch1"], g["ch2"], strict=True))
            for cut in cuts:
                while joined < len(edges) and edges[joined][0] > cut:
                    a, b = find(edges[joined][1]), find(edges[joined][2])
                    n = size.pop(a, 0) + (size.pop(b, 0) if a != b else 0) + 1
                    parent[b] = a
                    size[a] = n
                    most, joined = max(most, n), joined + 1
                out.append([*key, cut, direction, joined, len(size), most])
        return pd.DataFrame(out, columns=[*keys, "threshold", "direction", "n_supra", "n_components", "largest"])

    head = "".join(f"`{k}` {types[k]}, " for k in keys)
    return t.select(*keys, "ch1", "ch2", "t").groupBy(*keys).applyInPandas(run, f"{head}threshold double, direction string, n_supra long, n_components long, largest long")


def _at_thresholds(t: DataFrame, thresholds: list[float]) -> DataFrame:
    """Every edge once for each threshold that it is beyond."""
    rows = t.withColumn("threshold", F.explode(F.array(*[F.lit(float(x)) for x in sorted(set(thresholds))])))
    return threshold_edges(rows, F.col("threshold"))


def threshold_top_edges(t: DataFrame, keys: list[str], thresholds: list[float], n: int = 20) -> DataFrame:
    """``keys, threshold, direction, place, ch1, ch2, t``: the ``n`` edges of the largest absolute t-values at each
    threshold and direction."""
    rank = F.row_number().over(Window.partitionBy(*keys, "threshold", "direction").orderBy(F.abs("t").desc(), "ch1", "ch2"))
    return _at_thresholds(t, thresholds).withColumn("place", rank).filter(F.col("place") <= n).select(*keys, "threshold", "direction", "place", "ch1", "ch2", "t")


def threshold_regions(t: DataFrame, keys: list[str], thresholds: list[float], regions: DataFrame) -> DataFrame:
    """``keys, threshold, direction, region, n_edges, pct``: edge ends in each region at each threshold and direction."""
    return region_involvement(_at_thresholds(t, thresholds), [*keys, "threshold", "direction"], regions)


# --- regions ------------------------------------------------------------------------------------------------------------


def roi_within(edges: DataFrame, keys: list[str], rois: DataFrame) -> DataFrame:
    """``keys, roi, weight``: the mean weight inside a region. ``rois``: ``roi, channel``, small, may overlap."""
    a, b = (small_side(rois.select("roi", F.col("channel").alias(c))) for c in ("ch1", "ch2"))
    return edges.join(a, "ch1").join(b, ["roi", "ch2"]).groupBy(*keys, "roi").agg(F.avg("weight").alias("weight"))


def roi_between(edges: DataFrame, keys: list[str], rois: DataFrame) -> DataFrame:
    """``keys, roi1, roi2, weight``: the mean over the block of two regions, roi1 < roi2, edges taken in both directions;
    a channel of both regions has no edge with itself."""
    both = symmetric(edges.select(*keys, "ch1", "ch2", "weight"), "weight")
    a, b = (small_side(rois.select(F.col("roi").alias(r), F.col("channel").alias(c))) for r, c in (("roi1", "ch1"), ("roi2", "ch2")))
    return both.join(a, "ch1").join(b, "ch2").filter("roi1 < roi2").groupBy(*keys, "roi1", "roi2").agg(F.avg("weight").alias("weight"))


def node_degree(edges: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, node, degree``: every edge counts for both ends."""
    return edges.select(*keys, F.explode(F.array("ch1", "ch2")).alias("node")).groupBy(*keys, "node").agg(F.count("*").alias("degree"))


def region_involvement(edges: DataFrame, keys: list[str], regions: DataFrame) -> DataFrame:
    """``keys, region, n_edges, pct``: edge ends in each region ('Other' if unknown) and their share of all ends."""
    ends = edges.select(*keys, F.explode(F.array("ch1", "ch2")).alias("channel")).join(small_side(regions), "channel", "left")
    got = ends.groupBy(*keys, F.coalesce("region", F.lit("Other")).alias("region")).agg(F.count("*").alias("n_edges"))
    return got.withColumn("pct", F.col("n_edges") / F.sum("n_edges").over(Window.partitionBy(*keys)) * 100)


def region_pair_counts(edges: DataFrame, keys: list[str], regions: DataFrame) -> DataFrame:
    a, b = (small_side(regions.select(F.col("channel").alias(c), F.col("region").alias(r))) for c, r in (("ch1", "r1"), ("ch2", "r2")))
    got = edges.join(a, "ch1", "left").join(b, "ch2", "left").na.fill("Other", ["r1", "r2"])
    return got.groupBy(*keys, F.least("r1", "r2").alias("region1"), F.greatest("r1", "r2").alias("region2")).agg(F.count("*").alias("n"))


def lookup_edges(edges: DataFrame, listed: DataFrame, subject: str = "subject_id", missing: float | None = 0.0, block: int = 1000) -> DataFrame:
    """``subject, ch1, ch2, weight`` of the listed edges, in whichever order their ends are given. An edge that a subject
    does not have is ``missing``, or left out if that is None. The list may be of any size: Spark sizes its joins, and
    subjects meet it in blocks of about ``block`` edges."""
    want = listed.select(F.least("ch1", "ch2").alias("ch1"), F.greatest("ch1", "ch2").alias("ch2")).distinct()
    got = edges.join(want, ["ch1", "ch2"]).select(subject, "ch1", "ch2", "weight")
    if missing is None:
        return got
    blocks_of = -(-want.count() // block) or 1
    asked = want.withColumn("__b", F.pmod(F.xxhash64("ch1", "ch2"), F.lit(blocks_of)))
    every = edges.select(subject).distinct().withColumn("__b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks_of - 1).cast("long"))))
    grid = every.join(asked, "__b").drop("__b")
    return grid.join(got, [subject, "ch1", "ch2"], "left").na.fill(missing, ["weight"])


def component_mean(edges: DataFrame, members: DataFrame, keys: list[str], subject: str = "subject_id") -> DataFrame:
    """``subject, keys, component, weight``: each subject's mean weight over the edges of each component."""
    by = [k for k in keys if k in edges.columns]
    return edges.join(members.select(*keys, "component", "ch1", "ch2"), [*by, "ch1", "ch2"]).groupBy(subject, *keys, "component").agg(F.avg("weight").alias("weight"))


def edge_features(edges: DataFrame, subject: str, names: list[str], fill: float = 0.0) -> DataFrame:
    """One row for each subject, a column for each edge named ``ch1-ch2``."""
    rows = edges.withColumn("__e", F.concat_ws("-", "ch1", "ch2"))
    return rows.groupBy(subject).pivot("__e", names).agg(F.first("weight")).na.fill(fill)


# --- graph metrics --------------------------------------------------------------------------------------------------------


def clustering_coefficient(edges: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, clustering``: the mean over nodes of 2 * sum of cube roots of triangles' weight products (weights over
    the network's largest) / (k * (k - 1)); nodes with fewer than two edges count 0. Zero weights are no edges.

    Triangles come from two joins on the oriented edges ch1 < ch2, each found once.
    """
    e = edges.filter("weight > 0")
    top = e.groupBy(*keys).agg(F.max("weight").alias("__m"))
    e = e.join(top, keys).select(*keys, "ch1", "ch2", F.cbrt(F.col("weight") / F.col("__m")).alias("w"))
    a = e.select(*keys, F.col("ch1").alias("x"), F.col("ch2").alias("y"), F.col("w").alias("w1"))
    b = e.select(*keys, F.col("ch1").alias("y"), F.col("ch2").alias("z"), F.col("w").alias("w2"))
    c = e.select(*keys, F.col("ch1").alias("x"), F.col("ch2").alias("z"), F.col("w").alias("w3"))
    tri = a.join(b, [*keys, "y"]).join(c, [*keys, "x", "z"]).withColumn("w", F.col("w1") * F.col("w2") * F.col("w3"))
    at = tri.select(*keys, F.explode(F.array("x", "y", "z")).alias("node"), "w").groupBy(*keys, "node").agg(F.sum("w").alias("s"))
    nodes = node_degree(e, keys)
    every = edges.select(*keys, F.explode(F.array("ch1", "ch2")).alias("node")).distinct().join(nodes, [*keys, "node"], "left").join(at, [*keys, "node"], "left")
    k = F.coalesce(F.col("degree"), F.lit(0))
    one = F.when(k >= 2, 2 * F.coalesce("s", F.lit(0.0)) / (k * (k - 1))).otherwise(0.0)
    return every.groupBy(*keys).agg(F.avg(one).alias("clustering"))


def _paths(w: np.ndarray) -> float:
    """Mean shortest path over the largest component of a distance matrix (infinite where there is no edge)."""
    d = w.copy()
    np.fill_diagonal(d, 0)
    for k in range(len(d)):
        d = np.minimum(d, d[:, k, None] + d[None, k, :])
    near = np.isfinite(d)
    at = np.flatnonzero(near[near.sum(axis=1).argmax()])
    n = len(at)
    return float(d[np.ix_(at, at)].sum() / (n * (n - 1))) if n > 1 else float("nan")


def path_length(edges: DataFrame, keys: list[str], distance: str = "weight") -> DataFrame:
    """``keys, path_length``: the mean shortest path over the largest connected component, with weights as distances or
    (``inverse``) 1 / weight. One network's matrix is a group; zero weights are no edges."""
    types = dict(edges.dtypes)

    def run(key, f: pd.DataFrame) -> pd.DataFrame:
        f = f[f["weight"] > 0]
        names = sorted({*f["ch1"], *f["ch2"]})
        if not names:
            return pd.DataFrame([[*key, None]], columns=[*keys, "path_length"])
        at = {n: i for i, n in enumerate(names)}
        w = np.full((len(names), len(names)), np.inf)
        i, j = f["ch1"].map(at).to_numpy(), f["ch2"].map(at).to_numpy()
        v = f["weight"].to_numpy() if distance == "weight" else 1 / f["weight"].to_numpy()
        w[i, j] = w[j, i] = v
        return pd.DataFrame([[*key, _paths(w)]], columns=[*keys, "path_length"])

    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "path_length double"])
    return edges.select(*keys, "ch1", "ch2", "weight").groupBy(*keys).applyInPandas(run, schema)


def shortest_paths(edges: DataFrame, keys: list[str], distance: str = "weight") -> DataFrame:
    """``keys, src, node, d``: the shortest distance between all nodes that are connected, each with itself included, by
    rounds of a min-plus join: what became shorter in a round meets the edges in the next. A round's table is written, so
    that the plan does not grow with the rounds, and no task holds a network. Zero weights are no edges."""
    spark = edges.sparkSession
    length = F.col("weight") if distance == "weight" else 1 / F.col("weight")
    both = symmetric(edges.filter("weight > 0").select(*keys, "ch1", "ch2", length.cast("double").alias("w")), "w")
    hop = written(both.select(*keys, F.col("ch1").alias("node"), F.col("ch2").alias("to"), "w"), "hops")
    best = written(hop.select(*keys, F.col("node").alias("src"), "node").distinct().withColumn("d", F.lit(0.0)), "paths")
    new, held = best, [best]
    while True:
        tried = new.join(hop, [*keys, "node"]).groupBy(*keys, "src", F.col("to").alias("node")).agg(F.min(F.col("d") + F.col("w")).alias("e"))
        both_sides = best.join(tried, [*keys, "src", "node"], "full").select(*keys, "src", "node", F.least("d", "e").alias("d"), (F.col("e") < F.coalesce("d", F.lit(float("inf")))).alias("shorter"))
        step = written(both_sides.withColumn("shorter", F.coalesce("shorter", F.lit(False))), "paths")
        if not step.filter("shorter").limit(1).count():
            forget(spark, step)
            return best
        best, new = step.drop("shorter"), step.filter("shorter").drop("shorter")
        held.append(best)
        if len(held) > 1:
            forget(spark, held.pop(0))


def path_length_joined(edges: DataFrame, keys: list[str], distance: str = "weight") -> DataFrame:
    """:func:`path_length` for networks that no task can hold: the mean of :func:`shortest_paths` over the largest
    component, the one with the smallest node among those of the same size."""
    d = shortest_paths(edges, keys, distance)
    per = d.groupBy(*keys, "src").agg(F.count("*").alias("n"), F.sum("d").alias("s"), F.min("node").alias("c"))  # c names the component
    of = per.groupBy(*keys, "c").agg(F.max("n").alias("n"), F.sum("s").alias("s"))
    top = of.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("m"), "c", "s")).alias("x"))
    n = -F.col("x.m")
    got = top.select(*keys, F.when(n > 1, F.col("x.s") / (n * (n - 1))).alias("path_length"))
    return edges.select(*keys).distinct().join(got, keys, "left")


def random_edges(spark, n_graphs: int, n_nodes: int, n_edges: int, seed: int = 42, first: int = 0) -> DataFrame:
    """``graph, ch1, ch2, weight``: random graphs of a number of edges with uniform weights, all from md5 hashes; the first
    has the number ``first``."""
    pairs = F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(n_nodes - 2)), lambda i: F.transform(F.sequence(i + 1, F.lit(n_nodes - 1)), lambda j: F.struct(i.alias("i"), j.alias("j"))))))
    rows = spark.range(first, first + n_graphs).select(F.col("id").alias("graph"), pairs.alias("p")).select("graph", "p.i", "p.j")
    u = lambda tag: F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(f"{seed}|{tag}"), "graph", "i", "j")), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))
    rows = rows.withColumns({"weight": u("w"), "__o": u("o")})
    rank = F.row_number().over(Window.partitionBy("graph").orderBy("__o", "i", "j"))
    name = lambda c: F.concat(F.lit("n"), F.lpad(F.col(c).cast("string"), 6, "0"))
    return rows.withColumn("__r", rank).filter(F.col("__r") <= n_edges).select("graph", name("i").alias("ch1"), name("j").alias("ch2"), "weight")


def connected(edges: DataFrame, keys: list[str], n_nodes: int) -> DataFrame:
    """The keys whose graph is one component of ``n_nodes`` nodes."""
    comp = edge_components(edges, keys)
    ends = comp.select(*keys, "component", F.explode(F.array("ch1", "ch2")).alias("node"))
    one = ends.groupBy(*keys).agg(F.countDistinct("component").alias("__c"), F.countDistinct("node").alias("__n"))
    return one.filter((F.col("__c") == 1) & (F.col("__n") == n_nodes)).select(*keys)


def random_graphs(spark, n_graphs: int, n_nodes: int, n_edges: int, seed: int = 42, redraw: bool = False, most: int = 40) -> DataFrame:
    """The connected ones of ``n_graphs`` random graphs; with ``redraw`` others are drawn for those left out, until there
    are ``n_graphs`` or ``most`` rounds are over (an error: so few edges hardly ever connect so many nodes)."""
    if n_edges < n_nodes - 1:
        raise ValueError(f"{n_edges} edges cannot connect {n_nodes} nodes")
    out, have, first = None, 0, 0
    for _ in range(most):
        drawn = random_edges(spark, n_graphs, n_nodes, n_edges, seed, first)
        good = connected(drawn, ["graph"], n_nodes)
        got = written(drawn.join(good, "graph", "left_semi"), "graphs")
        out, first = got if out is None else out.unionByName(got), first + n_graphs
        have += got.select("graph").distinct().count()
        if not redraw:
            return out
        if have >= n_graphs:
            rank = F.dense_rank().over(Window.orderBy("graph"))  # a few graphs' edges
            return out.withColumn("__r", rank).filter(F.col("__r") <= n_graphs).drop("__r")
    raise ValueError(f"{have} of {n_graphs} graphs are connected after {first} draws")


def random_baseline(spark, n_graphs: int, n_nodes: int, n_edges: int, seed: int = 42, redraw: bool = False) -> DataFrame:
    """``c_rand, l_rand, n_graphs``: means of clustering and path length over connected random graphs with both above 0.
    Disconnected graphs are skipped, or redrawn."""
    g = random_graphs(spark, n_graphs, n_nodes, n_edges, seed, redraw)
    both = clustering_coefficient(g, ["graph"]).join(path_length(g, ["graph"]), "graph").filter("clustering > 0 AND path_length > 0")
    return both.agg(F.avg("clustering").alias("c_rand"), F.avg("path_length").alias("l_rand"), F.count("*").alias("n_graphs"))


def small_world(edges: DataFrame, keys: list[str], baseline: DataFrame) -> DataFrame:
    """``keys, clustering, path_length, avg_connectivity, sigma``, all keys against one baseline."""
    avg = edges.groupBy(*keys).agg(F.avg("weight").alias("avg_connectivity"))
    got = clustering_coefficient(edges, keys).join(path_length(edges, keys), keys).join(avg, keys).crossJoin(F.broadcast(baseline))  # one row
    return got.withColumn("sigma", (F.col("clustering") / F.col("c_rand")) / (F.col("path_length") / F.col("l_rand"))).drop("c_rand", "l_rand", "n_graphs")
