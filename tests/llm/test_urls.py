"""The trees of the URL filter: plain features and a plain walk give the same scores; held-out URLs."""

from __future__ import annotations

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import queries, urls
from plain import lower


def parts_of(url: str | None) -> tuple[str, str]:
    found = re.search(r"(?s)://([^/?#]*)([^?#]*)", url or "")
    return (lower(found[1]), found[2]) if found else ("", "")


def plain_features(url: str | None, model: urls.Trees, rates: dict) -> dict[str, float]:
    host, path = parts_of(url)
    text = url or ""
    n = max(len(text), 1)
    query = re.search(r"\?([^#]*)", text)
    suffix, folder = re.search(r"\.([^./]+)$", path), re.search(r"([^/]+)/[^/]*$", path)
    rest = 1 / (1 + math.exp(-model.prior))
    rate = lambda kind, key: rates.get((kind, key), rest)
    return {
        "f_length": len(text),
        "f_host_length": len(host),
        "f_path_length": len(path),
        "f_depth": len(re.findall(r"/[^/]", path)),
        "f_labels": len(re.findall(r"[^.]+", host)),
        "f_digits": len(re.findall(r"[0-9]", text)) / n,
        "f_entropy": round(-sum(c / n * math.log2(c / n) for c in Counter(text).values()), 9),
        "f_parameters": len(re.findall(r"[^&]+", query[1])) if query else 0,
        "f_hyphens": host.count("-"),
        "f_host_suffix": rate("f_host_suffix", host.rpartition(".")[2]),
        "f_domain": rate("f_domain", ".".join(host.split(".")[-2:])),
        "f_folder": rate("f_folder", folder[1] if folder else ""),
        "f_file_suffix": rate("f_file_suffix", suffix[1] if suffix else ""),
    }


def walk(tree: dict, x: dict[str, float]) -> float:
    while "value" not in tree:
        tree = tree["low"] if x[tree["feature"]] <= tree["cut"] else tree["high"]
    return tree["value"]


@pytest.fixture(scope="module")
def labelled(spark, sf):
    host, path = urls.host_and_path(F.col("url"))
    parts = spark.read.parquet(f"{sf}/pages.parquet").select("url", host.alias("host"), path.alias("path"))
    _, verdict = urls.rule_of(F.col("host"), F.col("path"), queries.RULES)
    return parts.withColumn("given", verdict).filter("given is not null").select("url", "host", "path", (F.col("given") == "block").cast("int").alias("y"))


def test_verdicts_equal_a_plain_walk(spark, sf, labelled):
    model = urls.train(spark, labelled)
    assert model.trees and any("feature" in t for t in model.trees)
    got = urls.judge(spark, spark.read.parquet(f"{sf}/pages.parquet"), queries.RULES).join(
        spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url"), "page_id"
    )
    rates = {(r.kind, r.key): r.rate for r in model.rates.collect()}
    free = 0
    for r in got.collect():
        x = plain_features(r.url, model, rates)
        margin = model.prior + sum(walk(t, x) for t in model.trees)
        assert r.block_score == pytest.approx(1 / (1 + math.exp(-margin)), abs=1e-9)
        if r.rule is None:
            free += 1
            assert r.verdict == ("block" if margin > 0 else "allow")
    assert free > 0


def test_held_out_urls(spark, labelled):
    half = F.pmod(F.xxhash64("url", F.lit(5)), F.lit(2))
    model = urls.train(spark, labelled.filter(half == 0))
    held = [(r.url, r.y) for r in labelled.filter(half == 1).collect()]
    rates = {(r.kind, r.key): r.rate for r in model.rates.collect()}
    right = [(model.prior + sum(walk(t, plain_features(u, model, rates)) for t in model.trees) > 0) == bool(y) for u, y in held]
    print("held-out urls", sum(right) / len(right), "n", len(right), "blocked", sum(y for _, y in held))
    assert sum(right) / len(right) >= 0.85


def test_training_equals_a_plain_one(spark, labelled):
    """Rates of other folds, bins and greedy trees, all from rows in memory."""
    model = urls.train(spark, labelled, rounds=3)
    fold = F.pmod(F.xxhash64("url", "host", F.lit("fold")), F.lit(urls.FOLDS))
    kinds = list(urls.SUFFIXES)
    keys = urls.suffixes(F.col("host"), F.col("path"))
    data = labelled.select("url", "y", fold.alias("fold"), *[keys[k].alias(k) for k in kinds]).collect()
    share = sum(r.y for r in data) / len(data)
    x, y = [], [r.y for r in data]
    for r in data:
        found = plain_features(r.url, model, {})
        for kind in kinds:
            others = [o.y for o in data if o[kind] == r[kind] and o.fold != r.fold]
            found[kind] = (sum(others) + 10 * share) / (len(others) + 10)
        x.append(found)
    margin = [math.log(share / (1 - share))] * len(y)
    gain = lambda g, h: g * g / (h + 1.0)

    def check(tree: dict, at: list[int], g: list[float], h: list[float]) -> None:
        """Every split of a node is the best of all cuts of all features."""
        total = sum(g[i] for i in at), sum(h[i] for i in at)
        if "value" in tree:
            if len(at):
                for i in at:
                    margin[i] += tree["value"]
            return
        low = [i for i in at if x[i][tree["feature"]] <= tree["cut"] + 1e-12]
        side = sum(g[i] for i in low), sum(h[i] for i in low)
        own = gain(*side) + gain(total[0] - side[0], total[1] - side[1]) - gain(*total)
        for f in urls.FEATURES:
            values = sorted({x[i][f] for i in at})
            if len(values) <= 8:  # few values are all cuts
                for v in values:
                    part = [i for i in at if x[i][f] <= v]
                    s = sum(g[i] for i in part), sum(h[i] for i in part)
                    assert gain(*s) + gain(total[0] - s[0], total[1] - s[1]) - gain(*total) <= own + 1e-5
        check(tree["low"], low, g, h)
        check(tree["high"], [i for i in at if i not in set(low)], g, h)

    for tree in model.trees:
        p = [1 / (1 + math.exp(-m)) for m in margin]
        g, h = [b - q for b, q in zip(y, p)], [q * (1 - q) for q in p]
        check(tree, list(range(len(y))), g, h)
    right = sum((m > 0) == bool(b) for m, b in zip(margin, y)) / len(y)
    assert right >= 0.85
