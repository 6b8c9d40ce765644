"""Free names against a walk that tries one name after the other; numbering in groups; chains."""

from __future__ import annotations

import os
import random
from collections import defaultdict

from pyspark.sql import functions as F

from ledgerline.operators.ranking import numbered
from ledgerline.plans import history, organize
from ledgerline.sources.scratch import Scratch


def first_free(name: str, taken: set) -> str:
    stem, suffix = os.path.splitext(name)
    tried, n = name, 0
    while tried in taken:
        n += 1
        tried = f"{stem} ({n}){suffix}"
    return tried


def names_of(spark, moves, taken):
    made = organize.unique_names(spark.createDataFrame(moves, "folder string, name string, source string, label int"), spark.createDataFrame(taken, "folder string, name string"))
    assert made.columns == ["folder", "name", "source", "label", "new_name"]
    return {r.source: (r.folder, r.new_name) for r in made.collect()}


def test_free_names_equal_a_walk(spark):
    rng = random.Random(3)
    moves, taken, want = [], [], {}
    for case in range(300):
        folder = f"/d{case}"
        there = {f"{s}{n}{x}" for s in ("a", "b", "a.b") for x in (".txt", "", ".T") for n in ("", " (1)", " (2)", " (3)", " (01)", " (7)") if rng.random() < 0.35}
        taken += [(folder, n) for n in there]
        busy = set(there)
        for k in range(rng.randint(0, 9)):
            name = rng.choice(["a.txt", "b.txt", "a", "a.b.txt", "b.T"])
            source = f"/s{case:03d}/{k}"
            moves.append((folder, name, source, k))
            want[source] = (folder, first_free(name, busy))
            busy.add(want[source][1])
    assert names_of(spark, moves, taken) == want


def test_numbered_arrivals_never_clash(spark):
    rng = random.Random(4)
    moves, taken = [], []
    for case in range(200):
        folder = f"/d{case}"
        taken += [(folder, n) for n in ("a.txt", "a (1).txt", "a (3).txt", "a (1) (1).txt") if rng.random() < 0.5]
        moves += [(folder, rng.choice(["a.txt", "a (1).txt", "a (2).txt"]), f"/s{case}/{k}", k) for k in range(rng.randint(1, 8))]
    got = list(names_of(spark, moves, taken).values())
    assert len(got) == len(moves) == len(set(got)) and not set(got) & set(taken)


def test_numbers_in_groups_of_any_size(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["hot"] * 5 + ["cold", None]), i * 7919 % 100_003) for i in range(5000)]
    frame = spark.createDataFrame(rows, "g string, v long")
    got = defaultdict(list)
    for r in numbered(Scratch(spark, "n"), frame, ["g"], [F.desc("v")], "nth").collect():
        got[r.g].append((r.nth, r.v))
    for g, found in got.items():
        assert [v for _, v in sorted(found)] == sorted((v for h, v in rows if h == g), reverse=True)
        assert sorted(n for n, _ in found) == list(range(1, len(found) + 1))
    assert numbered(Scratch(spark, "n"), frame.limit(0), [], ["v"], "nth").count() == 0


def test_chains_follow_the_moves(spark):
    moves = [
        ("r", 1, "/a", "/b"), ("r", 2, "/x", "/y"), ("r", 3, "/b", "/c"), ("r", 4, "/c", "/d"), ("r", 5, "/e", "/b"), ("r", 6, "/d", "/a"),
        ("s", 1, "/a", "/b"), ("s", 2, "/a", "/c"), ("t", 1, "/b", "/c"), ("t", 2, "/a", "/b"),
    ]
    got = {tuple(r) for r in history.chains(Scratch(spark, "c"), spark.createDataFrame(moves, "run_id string, seq int, source string, destination string")).collect()}
    assert got == {("r", "/a", "/a", 4), ("r", "/x", "/y", 1), ("r", "/e", "/b", 1), ("s", "/a", "/b", 1), ("s", "/a", "/c", 1), ("t", "/b", "/c", 1), ("t", "/a", "/b", 1)}
