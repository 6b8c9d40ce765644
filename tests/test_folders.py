"""Real folders: what is listed, what is read, and plans carried out on them."""

from __future__ import annotations

import json
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import names, rules
from ledgerline.operators import duplicates
from ledgerline.plans import apply, organize
from ledgerline.sources import catalog, folders


@pytest.fixture
def tree(tmp_path):
    """Two roots with dot files, empty files, links, internal folders and copies."""
    files = {
        "a/one.jpg": b"x" * 9000, "a/.hidden": b"h", "a/empty.txt": b"", "a/sub/deep/two.JPG": b"x" * 9000, "a/sub/three.pdf": b"y" * 9000,
        f"a/sub/{catalog.INTERNAL[1]}/b1/gone.txt": b"t", f"a/{catalog.INTERNAL[0]}/run_1.json": b"[]", "b/one.jpg": b"x" * 8999 + b"z", "a/self.py": b"me",
    }
    for name, content in files.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    os.symlink(tmp_path / "a/one.jpg", tmp_path / "a/link.jpg")
    os.symlink(tmp_path / "b", tmp_path / "a/linked")
    return tmp_path


def listed(frame) -> dict:
    return {r.path: r for r in frame.collect()}


def test_what_is_listed(spark, tree):
    a = str(tree / "a")
    got = listed(folders.scan(spark, [a], skip=[f"{a}/self.py"]))
    assert set(got) == {f"{a}/{x}" for x in ("one.jpg", ".hidden", "empty.txt", "sub/deep/two.JPG", "sub/three.pdf")}
    r = got[f"{a}/sub/deep/two.JPG"]
    assert (r.root, r.parent, r.name, r.size, r.content) == (a, f"{a}/sub/deep", "two.JPG", 9000, None)
    assert r.mtime == pytest.approx(os.path.getmtime(r.path))
    assert set(listed(folders.scan(spark, [a], recursive=False))) == {f"{a}/{x}" for x in ("one.jpg", ".hidden", "empty.txt", "self.py")}


def test_several_roots(spark, tree):
    a, b = str(tree / "a"), str(tree / "b")
    got = folders.scan(spark, [a, f"{a}/sub", b, b, str(tree / "none")])
    assert got.count() == len(listed(got)) == 7
    assert folders.workspace([b, a, f"{a}/../b", str(tree / "none")]) == [b, a]
    assert folders.joined([a], b) == [a, b]
    with pytest.raises(ValueError):
        folders.joined([a], f"{a}/sub/..")


def test_contents(spark, tree):
    a = str(tree / "a")
    prefix = listed(folders.scan(spark, [a], content="prefix"))
    assert len(prefix[f"{a}/one.jpg"].content) == 8192 and prefix[f"{a}/empty.txt"].content == b""
    found = duplicates.exact_duplicates(folders.scan(spark, [a, str(tree / "b")], content="full"))
    assert sorted(r.path for r in found.collect()) == [f"{a}/one.jpg", f"{a}/sub/deep/two.JPG"]
    by_prefix = duplicates.prefix_candidates(folders.scan(spark, [a, str(tree / "b")], content="full")).collect()
    assert [(r["size"], r["n"]) for r in by_prefix] == [(9000, 3)]


def test_plan_apply_log_undo(spark, tree):
    a = str(tree / "a")
    files = catalog.with_names(folders.scan(spark, [a], recursive=False, content="full")).filter("not is_excluded")
    plan = organize.resolve(organize.category_plan(files, F.col("root")), files.limit(0).select(F.col("parent").alias("folder"), "name", "size", "content"))
    moves = [(r.source, r.destination) for r in plan.orderBy("source").collect()]
    assert apply.apply_moves(moves) == [] and os.path.exists(f"{a}/one.jpg")
    skipped = []
    log = apply.apply_moves([*moves, (f"{a}/none", f"{a}/x"), (f"{a}/sub/three.pdf", moves[-1][1])], dry_run=False, workers=4, on_skip=lambda *m: skipped.append(m))
    assert [(e["source"], e["destination"]) for e in log] == moves and len(skipped) == 2
    assert os.path.exists(f"{a}/Images/one.jpg") and not os.path.exists(f"{a}/one.jpg")

    logs, now = f"{a}/logs", datetime(2024, 1, 31, 12, 0, 0, 5)
    assert apply.write_run_log(logs, [], now) is None
    path = apply.write_run_log(logs, log, now)
    again = apply.write_run_log(logs, log[:1], now)
    assert os.path.basename(path) == "run_20240131_120000_000005.json" and again.endswith("_000005_1.json")
    with open(f"{logs}/run_20240201_000000_000000.json", "w") as handle:
        handle.write("{no json")
    restored = []
    assert apply.undo_run(path, on_restore=lambda *m: restored.append(m)) == (len(moves), len(moves))
    assert [d for _, d in restored] == [s for s, _ in reversed(moves)] and os.path.exists(f"{a}/one.jpg")
    runs, ledger = apply.read_run_logs(spark, logs)
    assert {(r.run_id, r.n_entries, r.is_undone) for r in runs.collect()} == {
        ("run_20240131_120000_000005", len(moves), True), ("run_20240131_120000_000005_1", 1, False), ("run_20240201_000000_000000", 0, False),
    }
    assert [(r.source, r.destination) for r in ledger.filter("run_id = 'run_20240131_120000_000005'").orderBy("seq").collect()] == moves


def test_deleting(tree):
    trash = tree / "trash"
    for name in ("b1/x", "b1/y", "b2/deep/z", "b3/w"):
        (trash / name).parent.mkdir(parents=True, exist_ok=True)
        (trash / name).write_text("t")
    assert apply.empty_trash(str(trash)) == 3 and sorted(os.listdir(trash)) == ["b2"]
    assert apply.empty_trash(str(tree / "none")) == 0
    (tree / "e/f/g").mkdir(parents=True)
    paths = [str(tree / "e"), str(tree / "e/f"), str(tree / "e/f/g"), str(tree / "b")]
    assert apply.delete_empty_folders(paths) == {"deleted": paths[2::-1], "failed": [paths[3]]}
    assert apply.delete_files([str(tree / "b/one.jpg"), str(tree / "none")]) == {"deleted": [str(tree / "b/one.jpg")], "failed": [str(tree / "none")]}


def test_configuration(tmp_path):
    path = tmp_path / "own.json"
    assert rules.load_config(str(path)) == (rules.DEFAULT_CATEGORIES, ["config.json", "own.json"])
    path.write_text(json.dumps({"categories": {"Audio": ["MP3", ".Wav"], "Raw": [".cr2"]}, "exclude": ["*.bak", "own.json"], "admin_pin": "1"}))
    found, patterns = rules.load_config(str(path))
    assert found["Audio"] == [".mp3", ".wav"] and list(found)[-1] == "Raw" and found["Images"] == rules.DEFAULT_CATEGORIES["Images"]
    assert patterns == ["config.json", "*.bak", "own.json"]
    rules.save_config(str(path), {"exclude": []})
    assert json.loads(path.read_text()) == {"categories": {"Audio": ["MP3", ".Wav"], "Raw": [".cr2"]}, "exclude": [], "admin_pin": "1"}
    path.write_text("[1]")
    assert rules.load_config(str(path))[0] == rules.DEFAULT_CATEGORIES
    assert rules.lookup({"A": [".x", ".y"], "B": [".y"]}) == {".y": "B", ".x": "A"}


def test_patterns(spark):
    import fnmatch

    patterns = ["*.tmp", "a?c", "[ab]x", "[!ab]y", "x[^]z", "a.b", "*[0-9].t", "[]]q"]
    words = ["x.tmp", "x.tmp\n", "abc", "ac", "ax", "cx", "cy", "ay", "x^z", "xyz", "a.b", "axb", "f7.t", "f.t", "]q", "A.B", "abC"]
    frame = spark.createDataFrame([(w,) for w in words], "name string")
    for p in patterns:
        got = {r.name for r in frame.filter(names.is_excluded(F.col("name"), [p])).collect()}
        assert got == {w for w in words if fnmatch.fnmatchcase(w.lower(), p.lower())}, p
