"""URL filters: listed rules first, then gradient-boosted trees on lexical features."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.decontaminate import LOWER, UPPER
from docloom.session import table

#: (verdict, host, path) of the query's rules. Fixed values.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)

#: At most so many labelled rows are brought to the driver to fit the trees.
SAMPLE = 8_000
#: A row's suffix statistics come from the other folds; a suffix counts as having PRIOR rows of the mean label besides.
FOLDS, PRIOR = 5, 10.0

FEATURES = (
    "url_length", "host_length", "path_length", "depth", "host_parts", "digit_ratio", "entropy", "n_params", "n_hyphens",
    "has_fragment", "suffix_share", "suffix_blocked",
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host (A-Z lower-cased) and the path of a url; both empty if it is null or has no `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(url, "://", 1))
    tail = F.coalesce(F.expr("substring({0}, length({1}) + 4)".format("url", "substring_index(url, '://', 1)")), F.lit(""))
    tail = F.when(rest.isNotNull(), tail).otherwise(F.lit(""))
    host = F.regexp_extract(tail, r"^[^/?#]*", 0)
    path = F.regexp_extract(tail, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def with_rule(pages: DataFrame, rules: tuple[tuple[str, str, str], ...]) -> DataFrame:
    """pages with host, path, rule (host and path of the longest rule that fits, else null) and rule_verdict.

    A rule fits its host and all subdomains if the path starts with the rule's. Of two of one length the first in
    order of text is taken. The rules are a literal of the plan; give at most a few hundred.
    """
    host, path = host_and_path(F.col("url"))
    df = pages.withColumns({"host": host, "path": path})
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]), reverse=True):
        fits = ((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return df.withColumns({"rule": rule, "rule_verdict": verdict})


def with_features(df: DataFrame) -> DataFrame:
    """df with lexical features of url, host and path; a null url counts as empty."""
    url = F.coalesce(F.col("url"), F.lit(""))
    n = F.length("_u")
    share = lambda c: (F.length("_u") - F.length(F.replace(F.col("_u"), c))) / F.length("_u")
    entropy = F.aggregate(F.array_distinct(F.split("_u", "")), F.lit(0.0), lambda a, c: F.when(F.length(c) > 0, a - share(c) * F.log2(share(c))).otherwise(a))
    df = df.withColumn("_u", url)
    return df.withColumns(
        {
            "url_length": n.cast("double"),
            "host_length": F.length("host").cast("double"),
            "path_length": F.length("path").cast("double"),
            "depth": F.regexp_count("path", F.lit("/")).cast("double"),
            "host_parts": F.regexp_count("host", F.lit("[.]")).cast("double"),
            "digit_ratio": F.when(n > 0, F.regexp_count("_u", F.lit("[0-9]")) / n).otherwise(0.0),
            "entropy": F.when(n > 0, entropy).otherwise(0.0),
            "n_params": F.when(F.instr("_u", "?") > 0, F.regexp_count("_u", F.lit("[?&]"))).otherwise(0).cast("double"),
            "n_hyphens": F.regexp_count("_u", F.lit("-")).cast("double"),
            "has_fragment": (F.instr("_u", "#") > 0).cast("double"),
            "suffix": F.substring_index("host", ".", -1),
        }
    ).drop("_u")


@dataclass
class Trees:
    """Boosted trees: each node is (feature, threshold, left, right) or a leaf's value."""

    start: float
    nodes: list = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for tree in self.nodes:
            total += np.array([self._walk(tree, row) for row in x])
        return total

    def _walk(self, node, row) -> float:
        while isinstance(node, tuple):
            node = node[2] if row[node[0]] <= node[1] else node[3]
        return node

    def column(self) -> Column:
        """The log-odds as an expression over the feature columns."""

        def expr(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(float(node))
            return F.when(F.col(FEATURES[node[0]]) <= F.lit(float(node[1])), expr(node[2])).otherwise(expr(node[3]))

        total = F.lit(self.start)
        for tree in self.nodes:
            total = total + expr(tree)
        return total


def boost(x: np.ndarray, y: np.ndarray, trees: int = 20, depth: int = 3, rate: float = 0.3, bins: int = 32) -> Trees:
    """Gradient boosting of the logistic loss: each tree splits histograms of gradients, leaves take Newton steps."""
    if not len(y) or y.min() == y.max():
        return Trees(0.0 if not len(y) else (6.0 if y[0] else -6.0))
    p = y.mean()
    model = Trees(math.log(p / (1 - p)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    score = np.full(len(y), model.start)

    def leaf(rows: np.ndarray, g: np.ndarray, h: np.ndarray) -> float:
        value = rate * g[rows].sum() / (h[rows].sum() + 1.0)
        score[rows] += value
        return float(value)

    def grow(rows: np.ndarray, left: int, g: np.ndarray, h: np.ndarray):
        best = (1e-6, None, None)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        for f in range(x.shape[1]) if left and len(rows) >= 20 else ():
            gs = np.cumsum(np.bincount(binned[rows, f], weights=g[rows], minlength=len(edges[f]) + 1))[:-1]
            hs = np.cumsum(np.bincount(binned[rows, f], weights=h[rows], minlength=len(edges[f]) + 1))[:-1]
            gain = gs**2 / (hs + 1) + (total_g - gs) ** 2 / (total_h - hs + 1) - total_g**2 / (total_h + 1)
            if len(gain) and gain.max() > best[0] + 1e-12:
                best = (float(gain.max()), f, int(gain.argmax()))
        if best[1] is None:
            return leaf(rows, g, h)
        below = binned[rows, best[1]] <= best[2]
        return best[1], float(edges[best[1]][best[2]]), grow(rows[below], left - 1, g, h), grow(rows[~below], left - 1, g, h)

    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        model.nodes.append(grow(np.arange(len(y)), depth, y - p, p * (1 - p)))
    return model


def suffix_statistics(rows: pd.DataFrame) -> pd.DataFrame:
    """(share, blocked) by suffix: the share of rows, and the smoothed share of blocked ones."""
    by = rows.groupby("suffix").y.agg(["size", "sum"])
    mean = rows.y.mean() if len(rows) else 0.0
    return pd.DataFrame({"share": by["size"] / max(len(rows), 1), "blocked": (by["sum"] + PRIOR * mean) / (by["size"] + PRIOR)})


def fit(rows: pd.DataFrame) -> tuple[Trees, pd.DataFrame, float]:
    """Trees for rows (y, suffix, fold, features), the statistics of suffixes, and the mean label.

    For the fit a row's suffix is described by the other folds' rows, so that its own label is not among its features.
    """
    names = [f for f in FEATURES if not f.startswith("suffix_")]
    share, blocked = np.zeros(len(rows)), np.zeros(len(rows))
    for fold in range(FOLDS):
        own, others = (rows.fold == fold).to_numpy(), rows[rows.fold != fold]
        known = suffix_statistics(others)
        share[own] = rows.suffix[own].map(known["share"]).fillna(0.0)
        blocked[own] = rows.suffix[own].map(known["blocked"]).fillna(others.y.mean() if len(others) else 0.0)
    x = np.column_stack([rows[names].to_numpy(dtype=float).reshape(len(rows), len(names)), share, blocked])
    return boost(x, rows.y.to_numpy(dtype=float)), suffix_statistics(rows), float(rows.y.mean()) if len(rows) else 0.0


def labelled_sample(ruled: DataFrame, sample: int, sets: tuple[int, ...] = tuple(range(FOLDS))) -> pd.DataFrame:
    """A sample of at most `sample` urls under rules, the same for the same rows: y, suffix, fold and features."""
    labelled = ruled.where("rule is not null").select("page_id", "url", "host", "path", (F.col("rule_verdict") == "block").cast("int").alias("y"))
    labelled = labelled.withColumns({"_at": F.xxhash64("url", "page_id"), "fold": F.pmod(F.crc32(F.coalesce("url", F.lit(""))), F.lit(FOLDS))})
    labelled = labelled.where(F.col("fold").isin(*sets))
    share = min(1.0, 1.2 * sample / max(labelled.count(), 1))
    chosen = labelled.where(F.col("_at") <= F.lit(int(-(2**63) + share * (2**64 - 1)))) if share < 1 else labelled
    chosen = chosen.orderBy("_at", "page_id").limit(sample)
    return with_features(chosen).select("y", "suffix", "fold", *[f for f in FEATURES if not f.startswith("suffix_")]).toPandas()


def judged(ruled: DataFrame, rows: pd.DataFrame) -> DataFrame:
    """ruled with `tree_verdict`, learnt from rows."""
    model, stats, mean = fit(rows)
    known = [(s, float(r["share"]), float(r["blocked"])) for s, r in stats.iterrows()]
    suffixes = ruled.sparkSession.createDataFrame(known, "suffix string, suffix_share double, suffix_blocked double")
    # At most SAMPLE rows.
    df = with_features(ruled).join(F.broadcast(suffixes), "suffix", "left").fillna({"suffix_share": 0.0, "suffix_blocked": mean})
    return df.withColumn("tree_verdict", F.when(model.column() > 0, "block").otherwise("allow"))


def filter_urls(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, sample: int = SAMPLE) -> DataFrame:
    """pages (page_id, url) with host, path, rule and verdict.

    The verdict is that of the longest rule that fits. Urls under a rule are the labelled ones: a sample of at
    most `sample` of them, the same for the same rows, is brought to the driver, where boosted trees learn block from
    allow on length, depth, digit ratio, entropy, parameter counts and statistics of the host's suffix. All other
    urls are judged by the trees, as one expression of the plan. No labelled url: everything else is allowed; labels
    of one kind only: everything else gets that verdict. Null urls and ones without `://` have empty host and path
    and are judged by the trees like others. Repeated rows are judged alike; an empty table gives no rows; other columns
    are ignored.
    """
    ruled = with_rule(pages.select("page_id", F.col("url").cast("string").alias("url")), rules)
    out = judged(ruled, labelled_sample(ruled, sample))
    return out.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", "tree_verdict").alias("verdict"))


def held_out_verdicts(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, sample: int = SAMPLE) -> DataFrame:
    """(page_id, rule_verdict, tree_verdict) of the urls under rules in fold 0, by trees learnt from the other folds.

    Folds are by a hash of the url, so a url that was learnt from is never judged here.
    """
    ruled = with_rule(pages.select("page_id", F.col("url").cast("string").alias("url")), rules)
    rows = labelled_sample(ruled, sample, tuple(range(1, FOLDS)))
    held = ruled.where(F.col("rule").isNotNull() & (F.pmod(F.crc32(F.coalesce("url", F.lit(""))), F.lit(FOLDS)) == 0))
    return judged(held, rows).select("page_id", "rule_verdict", "tree_verdict")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
