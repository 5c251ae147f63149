"""URL filters: rules on host and path, then a logistic regression on hashed character n-grams.

Native: features, training sample, and scores are DataFrame expressions; the model
is fitted by gradient descent on a bounded table of labelled URLs, with each
gradient an aggregate over it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hash slots of the n-gram features; the weights are one literal array of this size.
SLOTS = 1024
#: Lengths of the character n-grams.
GRAMS = (3, 4)
#: At most so many labelled URLs are used.
MAX_LABELLED = 2000
ROUNDS, STEP, RIDGE = 60, 4.0, 1e-4


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty for null or no ``://``."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty for null or no ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest of the (verdict, host/path) rules that fits, else null. A rule fits its host and all subdomains."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):
        domain, _, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def features(host: Column, path: Column) -> Column:
    """Hash slots of the distinct character n-grams of host and path, ends marked; slot 0 is the bias."""
    parts = []
    for mark, part in (("h", host), ("p", F.regexp_replace(path, "[0-9]+", "0"))):
        s = F.concat(F.lit("^"), part, F.lit("$"))
        parts += [F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - (n - 1), F.lit(1))), _slot(mark, s, n)) for n in GRAMS]
    return F.array_distinct(F.concat(F.array(F.lit(0)), *parts))


def _slot(mark: str, s: Column, n: int):
    return lambda i: (1 + F.pmod(F.xxhash64(F.lit(mark), F.substring(s, i, n)), F.lit(SLOTS - 1))).cast("int")


def _logit(slots: Column, weights: list[float]) -> Column:
    w = F.array(*[F.lit(float(x)) for x in weights])
    total = F.aggregate(slots, F.lit(0.0), lambda a, i: a + F.element_at(w, i + 1))
    return total / F.sqrt(F.size(slots))


def sample(labelled: DataFrame, host: str, path: str, label: str, limit: int) -> list[tuple[list[int], int]]:
    """(slots, label) of at most limit / 2 distinct URLs of each label, those of the smallest hash of host and path.

    A URL counts once, however often it occurs. A share of the smallest hashes that
    holds enough of them is taken before anything is ordered or made distinct.
    """
    own = labelled.select(F.col(host).alias("a"), F.col(path).alias("b"), F.col(label).cast("int").alias("y"), F.xxhash64(host, path).alias("h"))
    sizes = own.filter("y is not null").groupBy("y").agg(F.approx_count_distinct("h").alias("n")).collect()  # two rows at most
    half, out = limit // 2, []
    for y, n in sorted((r["y"], r["n"]) for r in sizes):
        part = own.filter(F.col("y") == y)
        found: list = []
        if n > 4 * half:
            found = _smallest(part.filter(F.col("h") < int(-(1 << 63) + (1 << 64) * 2 * half / n)), half)
        if len(found) < half:
            found = _smallest(part, half)
        out += [(r["x"], y) for r in found]
    return out


def _smallest(part: DataFrame, n: int) -> list:
    return part.distinct().orderBy("h", "a", "b").limit(n).select(features(F.col("a"), F.col("b")).alias("x")).collect()


def fit(labelled: DataFrame, host: str = "host", path: str = "path", label: str = "blocked", limit: int = MAX_LABELLED) -> list[float]:
    """Weights by gradient descent over at most ``limit`` distinct labelled URLs, in which both labels weigh the same.

    The URLs' slots, at most ``limit`` times a URL's length, are collected once and
    the descent runs over them. An empty table gives weights of 0, one label only a
    constant on its side. Null labels are left out.
    """
    return descent(sample(labelled, host, path, label, limit))


def descent(rows: list[tuple[list[int], int]]) -> list[float]:
    w = [0.0] * SLOTS
    count = {y: sum(1 for _, z in rows if z == y) for _, y in rows}
    if len(count) < 2:
        w[0] = 0.0 if not count else 1.0 if 1 in count else -1.0
        return w
    data = [(x, y, 1 / math.sqrt(len(x)), 0.5 / count[y]) for x, y in rows]
    for _ in range(ROUNDS):
        g = [RIDGE * x for x in w]
        for x, y, scale, weight in data:
            z = scale * sum(w[i] for i in x)
            d = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - y) * scale * weight
            for i in x:
                g[i] += d
        w = [a - STEP * b for a, b in zip(w, g, strict=True)]
    return w


def judge(urls: DataFrame, rules: list[tuple[str, str]], labelled: DataFrame | None = None, url: str = "url") -> DataFrame:
    """urls with ``host``, ``path``, ``rule``, ``verdict`` and ``p_block`` added.

    Where no rule fits, the model decides: block from a probability of 0.5.
    ``labelled`` has host, path and blocked; by default the rules label the urls
    themselves and a bounded sample of distinct ones is learned from. Null urls and
    urls without ``://`` have empty host and path. Rows repeat as they come; an empty
    table gives an empty one. Columns of the five names are replaced by these.
    """
    verdicts = {rule: verdict for verdict, rule in rules}
    h, p = host_of(F.col(url)), path_of(F.col(url))
    base = urls.withColumns({"host": h, "path": p}).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    by_rule = F.lit(None).cast("string")
    for rule, verdict in verdicts.items():
        by_rule = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(by_rule)
    if labelled is None:
        labelled = base.filter(F.col("rule").isNotNull()).select("host", "path", (by_rule == "block").alias("blocked"))
    w = fit(labelled)
    z = _logit(features(F.col("host"), F.col("path")), w)
    out = base.withColumn("p_block", F.round(1 / (1 + F.exp(-z)), 9))
    return out.withColumn("verdict", F.coalesce(by_rule, F.when(F.col("p_block") >= 0.5, "block").otherwise("allow")))
