"""Near-duplicate pictures by 64-bit signatures held as four 16-bit bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerline.operators.components import connected_components
from ledgerline.sources.scratch import Scratch

#: Largest differing bits of the strict, normal and loose searches.
PRESETS = {"strict": 5, "normal": 10, "loose": 16}
BANDS = ["b0", "b1", "b2", "b3"]


def distance(left: str, right: str) -> Column:
    """Differing bits of two rows of bands."""
    return sum((F.bit_count(F.col(f"{left}.{b}").bitwiseXOR(F.col(f"{right}.{b}"))) for b in BANDS[1:]),
               F.bit_count(F.col(f"{left}.b0").bitwiseXOR(F.col(f"{right}.b0"))))


def _meet(keyed: DataFrame, keys: list[str], most: int = 1000) -> DataFrame:
    """Rows l and r, l.id < r.id, of equal keys; a key of more than ``most`` rows is dealt out in parts of its pairs."""
    counts = keyed.groupBy(*keys).agg(F.count("*").alias("__n")).filter(F.col("__n") > most)
    sized = keyed.join(counts, keys, "left").withColumn("__parts", F.coalesce(F.ceil(F.col("__n") / most), F.lit(1)).cast("long"))
    left = sized.withColumn("__part", F.pmod(F.xxhash64("id"), F.col("__parts")))
    right = sized.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__parts") - 1)))
    return left.alias("l").join(right.alias("r"), [*keys, "__part"]).filter("l.id < r.id")


def pairs(signatures: DataFrame, threshold: int = PRESETS["normal"]) -> DataFrame:
    """(i, j, distance), i < j, of distinct signatures that share a whole band and differ in few bits.

    Ids of equal signatures are folded into their smallest first, so copies cost
    one row; ``groups`` joins them again.  Every pair up to three bits is found,
    since three flips leave one of four bands whole.
    """
    each = signatures.groupBy(*BANDS).agg(F.min("id").alias("id"))
    keyed = each.select("id", *BANDS, F.posexplode(F.array(*BANDS)).alias("band", "value"))
    found = _meet(keyed, ["band", "value"])
    found = found.withColumn("distance", distance("l", "r")).filter(F.col("distance") <= threshold)
    return found.select(F.col("l.id").alias("i"), F.col("r.id").alias("j"), "distance").distinct()


def pairs_exact(signatures: DataFrame, threshold: int = PRESETS["normal"]) -> DataFrame:
    """(i, j, distance), i < j, of all distinct signatures that differ in at most ``threshold`` bits.

    The 64 bits are cut into threshold // 2 + 1 segments; two signatures within
    the threshold differ by at most one bit in some segment, so an equality join
    on the segment with one bit deleted, for each of its bits, finds them all.
    Segments shorten as the threshold grows and more pairs meet: 21 bits at the
    strict preset, 10 at the normal and 7 at the loose one.
    """
    each = signatures.groupBy(*BANDS).agg(F.min("id").alias("id"))
    bits = sum((F.shiftleft(F.col(b).cast("long"), 16 * k) for k, b in enumerate(BANDS[1:], 1)), F.col("b0").cast("long"))
    n = min(threshold // 2 + 1, 32)
    ends = [64 * k // n for k in range(n + 1)]
    variants = []
    for s, (low, high) in enumerate(zip(ends, ends[1:])):
        segment = F.shiftrightunsigned("bits", low).bitwiseAND(F.lit((1 << (high - low)) - 1))
        for bit in range(high - low):
            variants.append(F.struct(F.lit(s * 64 + bit).alias("place"), segment.bitwiseAND(F.lit(~(1 << bit))).alias("rest")))
    keyed = each.withColumn("bits", bits).select("id", "bits", F.explode(F.array(*variants)).alias("v")).select("id", "bits", "v.place", "v.rest")
    found = _meet(keyed, ["place", "rest"])
    found = found.withColumn("distance", F.bit_count(F.col("l.bits").bitwiseXOR(F.col("r.bits")))).filter(F.col("distance") <= threshold)
    return found.select(F.col("l.id").alias("i"), F.col("r.id").alias("j"), "distance").distinct()


def search_facts(signatures: DataFrame, threshold: int = PRESETS["normal"]) -> DataFrame:
    """One row: signatures, distinct ones, and pairs that the banded search found."""
    counts = signatures.agg(F.count("*").alias("n_signatures"), F.countDistinct(*BANDS).alias("n_distinct"))
    return counts.join(pairs(signatures, threshold).agg(F.count("*").alias("n_pairs")))


def groups(scratch: Scratch, signatures: DataFrame, threshold: int = PRESETS["normal"], exact: bool = False) -> DataFrame:
    """(id, group_id) of every signature that is close to another, transitively; ``group_id`` is the smallest id."""
    first = signatures.groupBy(*BANDS).agg(F.min("id").alias("__first"))
    copies = signatures.join(first, BANDS).filter("id <> __first").select(F.col("__first").alias("a"), F.col("id").alias("b"))
    edges = (pairs_exact if exact else pairs)(signatures, threshold).select(F.col("i").alias("a"), F.col("j").alias("b")).unionByName(copies)
    return connected_components(scratch, edges).select(F.col("node").alias("id"), F.col("component").alias("group_id"))
