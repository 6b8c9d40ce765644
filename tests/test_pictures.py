"""Picture hashes, decoding and thumbnails; caches."""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline import schemas
from ledgerline.operators import cache, pictures, similar


def pgm(pixels: np.ndarray) -> bytes:
    return b"P5 # grey\n%d %d\n255\n" % (pixels.shape[1], pixels.shape[0]) + pixels.astype(np.uint8).tobytes()


def ppm(pixels: np.ndarray) -> bytes:
    return b"P6\n%d %d 255\n" % (pixels.shape[1], pixels.shape[0]) + pixels.astype(np.uint8).tobytes()


@pytest.fixture(scope="module")
def files(spark):
    ramp = np.tile(np.arange(90) * 2, (80, 1))
    rows = [("/flat.pgm", pgm(np.full((40, 50), 7))), ("/up.pgm", pgm(ramp)), ("/down.ppm", ppm(np.repeat(ramp[:, ::-1, None], 3, axis=2)))]
    rows += [("/cut.pgm", pgm(ramp)[:500]), ("/text.jpg", b"no picture"), ("/none.jpg", None), ("/small.pgm", pgm(ramp[:9, :8]))]
    return spark.createDataFrame([(p, float(i), len(c or b""), c) for i, (p, c) in enumerate(rows)], "path string, mtime double, size long, content binary")


def test_hashes(files):
    got = {r.path: (r.b0, r.b1, r.b2, r.b3, r.is_unreadable) for r in pictures.signatures(files).collect()}
    assert got["/flat.pgm"] == (65535, 65535, 65535, 65535, False)  # every pixel is at least its neighbour
    assert got["/up.pgm"] == (0, 0, 0, 0, False) and got["/down.ppm"] == got["/flat.pgm"]
    assert all(got[p][4] for p in ("/cut.pgm", "/text.jpg", "/none.jpg")) and not got["/small.pgm"][4]


def test_bits_in_place(spark):
    pixels = [0] * 72
    pixels[9 * 3 + 5] = 9  # row 3, column 5: not less than its right neighbour; its left one is less than it
    for row in range(8):
        for column in range(9):
            if (row, column) != (3, 5):
                pixels[9 * row + column] = column
    frame = spark.createDataFrame([(pixels,)], "pixels array<int>")
    got = frame.select(*pictures.difference_hash(F.col("pixels"))).first()
    bit = 3 * 8 + 5
    assert tuple(got) == tuple(1 << (bit - 16 * k) if 16 * k <= bit < 16 * k + 16 else 0 for k in range(4))


def test_resize_keeps_means():
    x = np.random.default_rng(0).integers(0, 256, (120, 90, 3))
    small = pictures.resize(x, 30, 40)
    assert small.shape == (40, 30, 3) and abs(small.mean() - x.mean()) < 3
    assert (pictures.resize(np.full((7, 5, 3), 9), 60, 60) == 9).all()


def test_thumbnails_and_their_cache(spark, files):
    empty = spark.createDataFrame([], schemas.TABLES["thumbnail_cache"])
    shown, held = pictures.page_thumbnails(files, empty)
    got = {r.path: r.b64 for r in shown.collect()}
    assert set(got) == {"/flat.pgm", "/up.pgm", "/down.ppm", "/small.pgm"}
    raw = base64.b64decode(got["/up.pgm"])
    assert raw[:8] == b"\x89PNG\r\n\x1a\n" and raw[16:24] == (60).to_bytes(4, "big") + (53).to_bytes(4, "big")
    body = raw[raw.index(b"IDAT") + 4 :]
    assert len(zlib.decompress(body[: int.from_bytes(raw[raw.index(b"IDAT") - 4 : raw.index(b"IDAT")], "big")])) == 53 * (1 + 3 * 60)
    marked = held.withColumn("b64", F.lit("kept"))
    again, _ = pictures.page_thumbnails(files.filter("path <> '/small.pgm'"), marked)
    assert {(r.path, r.b64) for r in again.collect()} == {(p, "kept") for p in got if p != "/small.pgm"}


def test_presets(spark):
    """Pairs at 5, 10 and 16 bits: the exact search finds them all, whatever their bands."""
    rng = np.random.default_rng(4)
    base = [int(x) for x in rng.integers(0, 2**63, 30)]
    values = list(base)
    for i, b in enumerate(base):
        for n in (3, 5, 6, 10, 11, 16, 17):
            values.append(b ^ sum(1 << int(k) for k in rng.choice(64, n, replace=False)))
    rows = [(i, *[(v >> 16 * k) & 65535 for k in range(4)]) for i, v in enumerate(values)]
    frame = spark.createDataFrame(rows, "id long, b0 int, b1 int, b2 int, b3 int")
    for most in similar.PRESETS.values():
        want = {(i, j, (values[i] ^ values[j]).bit_count()) for j in range(len(values)) for i in range(j) if (values[i] ^ values[j]).bit_count() <= most}
        assert {tuple(r) for r in similar.pairs_exact(frame, most).collect()} == want and want
        banded = {tuple(r) for r in similar.pairs(frame, most).collect()}
        assert banded <= want and {p for p in want if p[2] <= 3} <= banded


def test_upsert_takes_rows_whole(spark):
    schema = "path string, kind string, mtime double, size long, value string, note string"
    held = spark.createDataFrame([("/a", "full", 1.0, 1, "old", "old"), ("/b", "full", 1.0, 1, "b", None)], schema)
    fresh = spark.createDataFrame([("/a", "full", 1.0, 1, "x", "1"), ("/a", "full", 1.0, 1, "w", "2"), ("/c", "full", None, None, None, "n")], schema)
    got = {tuple(r) for r in cache.upsert(held, fresh).collect()}
    assert got == {("/a", "full", 1.0, 1, "x", "1"), ("/b", "full", 1.0, 1, "b", None), ("/c", "full", None, None, None, "n")}


def test_stored_tables(spark, tmp_path):
    paths = schemas.bootstrap(spark, str(tmp_path))
    assert set(paths) == set(schemas.TABLES)
    row = spark.createDataFrame([("/a", "full", 1.0, 1, "v")], schemas.TABLES["hash_cache"])
    row.write.mode("append").parquet(paths["hash_cache"])
    schemas.bootstrap(spark, str(tmp_path))
    assert cache.load(spark, paths["hash_cache"], schemas.TABLES["hash_cache"]).count() == 1


def test_results_are_kept_until_they_change(spark):
    results, made = cache.Results(), []

    def make(name):
        made.append(name)
        return spark.range(3)

    for _ in range(2):
        for name in ("duplicates", "overview"):
            results.get(name, lambda: make(name), 10)
    assert made == ["duplicates", "overview"]
    results.files_moved()
    for name in ("duplicates", "overview"):
        results.get(name, lambda: make(name), 10)
    results.content_changed()
    results.get("duplicates", lambda: make("duplicates"), 10)
    assert made == ["duplicates", "overview", "overview", "duplicates"]
