"""URL filter: host and path rules, and gradient-boosted trees on lexical features.

Everything runs as DataFrame functions.  URLs that a rule decides are the
labelled ones; a bounded sample of them (``sample_rows``, those of lowest hash)
trains the trees, and a tree is a nested CASE expression.  Every suffix of the
sample has its rate in a table of at most four rows a sampled URL, which is
broadcast, so judging all URLs is one map-only pass.  Features are binned once;
training then grows one level of a tree per aggregation: gradients are summed by
(node, feature, bin), and those sums, of which there are never more than nodes
times features times bins, come to the driver, which takes the best splits.

Features: lengths, path depth, digit ratio, character entropy, number of query
parameters, host labels, hyphens, and how often URLs with the same suffix are
blocked: the host's last label, its last two labels, the path's last folder and
the file's suffix.  A sampled URL gets its rates from the other folds of the
sample, so that the trees do not trust a suffix for what they see of it here.

Defined results: a null url, or one without ``://``, has an empty host and path
and is judged by the trees; without labelled URLs everything is allowed, and
with one class only everything gets that class; rows that repeat a page_id are
judged each; an empty table gives an empty table; other columns are never read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerline.sources.scratch import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = (
    "f_length",
    "f_host_length",
    "f_path_length",
    "f_depth",
    "f_labels",
    "f_digits",
    "f_entropy",
    "f_parameters",
    "f_hyphens",
    "f_host_suffix",
    "f_domain",
    "f_folder",
    "f_file_suffix",
)
SUFFIXES = FEATURES[-4:]
FOLDS = 5


@dataclass(frozen=True)
class Rule:
    """``verdict`` for a host, its subdomains and the paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path; both empty for a null url or one without ``://``."""
    at = F.locate("://", url) if isinstance(url, str) else F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else null."""
    name = verdict = None
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        name = F.when(fits, rule.name) if name is None else F.when(fits, rule.name).otherwise(name)
        verdict = F.when(fits, rule.verdict) if verdict is None else F.when(fits, rule.verdict).otherwise(verdict)
    none = F.lit(None).cast("string")
    return (none, none) if name is None else (name, verdict)


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """The features that need no training."""
    text = F.coalesce(url, F.lit(""))
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    share = lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / n
    distinct = F.filter(F.array_distinct(F.split(text, "")), lambda c: c != "")
    entropy = F.aggregate(distinct, F.lit(0.0), lambda total, c: total - share(c) * F.log2(share(c)))
    count = lambda value, pattern: F.regexp_count(value, F.lit(pattern)).cast("double")
    query = F.regexp_extract(text, r"\?([^#]*)", 1)
    return {
        "f_length": F.length(text).cast("double"),
        "f_host_length": F.length(host).cast("double"),
        "f_path_length": F.length(path).cast("double"),
        "f_depth": count(path, r"/[^/]"),
        "f_labels": count(host, r"[^.]+"),
        "f_digits": count(text, r"[0-9]") / n,
        "f_entropy": F.round(entropy, 9),
        "f_parameters": count(query, r"[^&]+"),
        "f_hyphens": count(host, r"-"),
    }


def suffixes(host: Column, path: Column) -> dict[str, Column]:
    """The suffixes whose rates are features, by feature; empty where there is none."""
    return {
        "f_host_suffix": F.substring_index(host, ".", -1),
        "f_domain": F.substring_index(host, ".", -2),
        "f_folder": F.regexp_extract(path, r"(?s)([^/]+)/[^/]*$", 1),
        "f_file_suffix": F.regexp_extract(path, r"(?s)\.([^./]+)$", 1),
    }


@dataclass
class Trees:
    """Boosted trees as one expression over the features, and the rates (kind, key, rate) of suffixes."""

    prior: float
    rates: DataFrame
    trees: list[dict]

    def with_features(self, parts: DataFrame) -> DataFrame:
        """``parts`` (url, host, path, ...) and all features; a suffix without a rate has that of all URLs."""
        url, host, path = F.col("url"), F.col("host"), F.col("path")
        rest = 1 / (1 + math.exp(-self.prior))
        found = parts.select("*", *[c.alias(k) for k, c in lexical(url, host, path).items()])
        for kind, suffix in suffixes(host, path).items():
            own = self.rates.filter(F.col("kind") == kind).select(F.col("key").alias(f"__{kind}"), F.col("rate").alias(kind))
            found = found.join(F.broadcast(own), suffix == F.col(f"__{kind}"), "left").drop(f"__{kind}")
            found = found.withColumn(kind, F.coalesce(kind, F.lit(rest)))
        return found

    def margin(self) -> Column:
        """Log-odds of block, over columns that carry the features."""
        total = F.lit(self.prior)
        for tree in self.trees:
            total = total + tree_value(tree)
        return total


def tree_value(tree: dict) -> Column:
    if "value" in tree:
        return F.lit(float(tree["value"]))
    return F.when(F.col(tree["feature"]) <= tree["cut"], tree_value(tree["low"])).otherwise(tree_value(tree["high"]))


def _binned(tree: dict, leaf, number: int = 1) -> Column:
    """``leaf`` (leaf, number) of the leaf that a row's bins fall into; children of node k are 2k and 2k + 1."""
    if "value" in tree:
        return leaf(tree, number)
    goes_low = F.get("bins", F.lit(FEATURES.index(tree["feature"]))) <= tree["bin"]
    return F.when(goes_low, _binned(tree["low"], leaf, 2 * number)).otherwise(_binned(tree["high"], leaf, 2 * number + 1))


def _leaf(tree: dict, number: int) -> dict:
    for bit in bin(number)[3:]:
        tree = tree["high" if bit == "1" else "low"]
    return tree


def _rate(blocked: Column, n: Column, share: float) -> Column:
    return (blocked + 10 * share) / (n + 10)


def best_split(sums: dict[tuple[int, int], tuple[float, float]], cuts: dict[str, list[float]], smoothing: float) -> tuple | None:
    """(feature, bin, sums below, sums of all) of the largest gain; ``sums`` (g, h) are by (feature, bin).

    Gains are compared to six digits; ties go to the first feature and the lowest bin.
    """
    gain = lambda g, h: g * g / (h + smoothing)
    found = None
    for k, feature in enumerate(FEATURES):
        total_g = sum(g for (f, _), (g, _) in sums.items() if f == k)
        total_h = sum(h for (f, _), (_, h) in sums.items() if f == k)
        low_g = low_h = 0.0
        for at in range(len(cuts[feature])):
            g, h = sums.get((k, at), (0.0, 0.0))
            low_g, low_h = low_g + g, low_h + h
            won = round(gain(low_g, low_h) + gain(total_g - low_g, total_h - low_h) - gain(total_g, total_h), 6)
            if won > (found[0] if found else 0.0):
                found = (won, feature, at, (low_g, low_h), (total_g, total_h))
    return found[1:] if found else None


def train(
    spark: SparkSession,
    labelled: DataFrame,
    sample_rows: int = 20_000,
    rounds: int = 12,
    depth: int = 2,
    bins: int = 16,
    rate: float = 0.3,
    smoothing: float = 1.0,
) -> Trees | None:
    """Trees from ``labelled`` (url, host, path, y: 1 for block); None without rows."""
    scratch = Scratch(spark, "urls")
    chosen = labelled.orderBy(F.xxhash64("url", "host", "y"), "url", "y").limit(sample_rows)
    fold = F.pmod(F.xxhash64("url", "host", F.lit("fold")), F.lit(FOLDS)).cast("int")
    sample = scratch.save(chosen.select("url", "host", "path", "y", fold.alias("fold")), "sample")
    n, ones = sample.agg(F.count("*"), F.sum("y")).first()
    if not n:
        return None
    share = min(max(ones / n, 1e-4), 1 - 1e-4)
    keys = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("key")) for k, c in suffixes(F.col("host"), F.col("path")).items()]))
    by_fold = scratch.save(
        sample.select("y", "fold", keys.alias("s")).groupBy("s.kind", "s.key", "fold").agg(F.sum("y").alias("b"), F.count("*").alias("n")), "folds"
    )
    whole = by_fold.groupBy("kind", "key").agg(F.sum("b").alias("b"), F.sum("n").alias("n"))
    rates = scratch.save(whole.select("kind", "key", _rate(F.col("b"), F.col("n"), share).alias("rate")), "rates")
    model = Trees(math.log(share / (1 - share)), rates, [])
    if ones in (0, n):
        return model

    # a sampled URL's own rates: of the other folds
    apart = by_fold.alias("f").join(whole.alias("w"), (F.col("f.kind") == F.col("w.kind")) & (F.col("f.key") == F.col("w.key")))
    others = scratch.save(
        apart.select("f.kind", "f.key", "f.fold", _rate(F.col("w.b") - F.col("f.b"), F.col("w.n") - F.col("f.n"), share).alias("rate")), "others"
    )
    url, host, path = F.col("url"), F.col("host"), F.col("path")
    featured = sample.select("y", "fold", "host", "path", *[c.alias(k) for k, c in lexical(url, host, path).items()])
    for kind, suffix in suffixes(host, path).items():
        own = others.filter(F.col("kind") == kind).select(F.col("key").alias("__key"), F.col("fold").alias("__fold"), F.col("rate").alias(kind))
        featured = featured.join(F.broadcast(own), (suffix == F.col("__key")) & (F.col("fold") == F.col("__fold"))).drop("__key", "__fold")
    featured = scratch.save(featured.select("y", *FEATURES), "features")
    at = [k / bins for k in range(1, bins)]
    found = featured.agg(*[F.percentile_approx(f, at, 10_000).alias(f) for f in FEATURES]).first()
    cuts = {f: sorted(set(found[f])) for f in FEATURES}
    # a bin's number is how many cuts lie below the value
    number = lambda f: sum((F.when(F.col(f) > c, 1).otherwise(0) for c in cuts[f]), F.lit(0))
    rows = scratch.save(featured.select("y", F.array(*[number(f) for f in FEATURES]).alias("bins")), "bins")
    for _ in range(rounds):
        tree: dict = {"value": 0.0}
        margin = F.lit(model.prior)
        for earlier in model.trees:
            margin = margin + _binned(earlier, lambda leaf, _: F.lit(float(leaf["value"])))
        p = 1 / (1 + F.exp(-margin))
        for level in range(depth):
            graded = rows.select(_binned(tree, lambda _, number: F.lit(number)).alias("node"), (F.col("y") - p).alias("g"), (p * (1 - p)).alias("h"), "bins")
            each = graded.filter(F.col("node") >= 1 << level).select("node", "g", "h", F.posexplode("bins").alias("k", "bin"))
            sums: dict[int, dict] = {}
            for r in each.groupBy("node", "k", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).orderBy("node", "k", "bin").collect():
                sums.setdefault(r["node"], {})[r["k"], r["bin"]] = (r["g"], r["h"])
            for node, own in sorted(sums.items()):
                leaf, split = _leaf(tree, node), best_split(own, cuts, smoothing)
                if split is None:
                    g, h = (sum(x[i] for (k, _), x in own.items() if k == 0) for i in (0, 1))
                    leaf["value"] = rate * g / (h + smoothing)
                    continue
                feature, cut, (gl, hl), (gt, ht) = split
                leaf.clear()
                leaf |= {"feature": feature, "bin": cut, "cut": cuts[feature][cut]}
                leaf["low"] = {"value": rate * gl / (hl + smoothing)}
                leaf["high"] = {"value": rate * (gt - gl) / (ht - hl + smoothing)}
        model.trees.append(tree)
    return model


def judge(spark: SparkSession, pages: DataFrame, rules: list[Rule], **training) -> DataFrame:
    """``pages`` (page_id, url) to (page_id, host, path, rule, verdict, block_score)."""
    host, path = host_and_path(F.col("url"))
    parts = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = parts.withColumn("rule", name).withColumn("given", verdict)
    labelled = ruled.filter("given is not null").select("url", "host", "path", (F.col("given") == "block").cast("int").alias("y"))
    model = train(spark, labelled, **training)
    if model is None:
        margin, featured = F.lit(-1.0), ruled
    else:
        featured, margin = model.with_features(ruled), model.margin()
    return featured.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("given", F.when(margin > 0, "block").otherwise("allow")).alias("verdict"),
        (1 / (1 + F.exp(-margin))).alias("block_score"),
    )
