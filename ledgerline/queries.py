"""The registered queries over the driver's tables, each with DuckDB SQL of its own.

"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerline.functions import names, rules
from ledgerline.operators import cache, duplicates, pictures, similar, storage
from ledgerline.plans import history, organize, rename, vacuum
from ledgerline.sources import catalog
from ledgerline.sources.scratch import Scratch

#: Thresholds of the separation rules: 8192 bytes and 180 days.
LARGE_MB, OLD_DAYS = 0.0078125, 180.0
#: Differing bits of the signature search; the tables' signatures are random, so presets would find nothing.
SIGNATURE_BITS = 28
EXACT_BITS = 18
RULE = ("replace", "1", "")
CHOSEN, SELECTED = ["Images", "Documents"], {"Documents": [".pdf"]}
KNOWN = [*rules.categories(), rules.OTHERS]


def _loose(files: DataFrame) -> DataFrame:
    return files.filter(F.col("parent") == F.col("root"))


def _nothing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "folder string, name string, size long, content string")


# Storage: S2-S4, P1-P5, P11, F-1, J1, A1-A7, A13, A20, A25, W8, F1, F13.
def storage_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.by_category(catalog.scanned(spark, sf_dir))


def storage_by_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.by(catalog.scanned(spark, sf_dir), "ext")


def storage_by_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.by(catalog.scanned(spark, sf_dir), "root", "category")


def storage_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.telemetry(catalog.files(spark, sf_dir))


def loose_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _loose(catalog.scanned(spark, sf_dir)).groupBy("category", "root").agg(F.count("*").alias("n_files"))


def excluded_by_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.files(spark, sf_dir).groupBy("root").agg(F.count_if("is_excluded").alias("n_excluded"))


def separation_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.rule_preview(catalog.scanned(spark, sf_dir), catalog.AS_OF, LARGE_MB, OLD_DAYS)


def file_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = catalog.files(spark, sf_dir)
    days = names.age_days(F.col("mtime"), catalog.AS_OF)
    return found.select("path", "ext", "category", names.size_label(F.col("size")).alias("size_label"), days.alias("age_days"), names.stem(F.col("name")).alias("stem"))


def storage_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O1."""
    return storage.ranked(storage.by(catalog.scanned(spark, sf_dir), "category"), "category")


def extension_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O2."""
    return storage.ranked(storage.by(catalog.scanned(spark, sf_dir), "ext"), "ext")


def storage_share_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W7."""
    return storage.cumulative(storage.by(catalog.scanned(spark, sf_dir), "category"), "category")


def storage_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F13, K14."""
    return storage.bar_chart(storage.by_category(catalog.scanned(spark, sf_dir)))


def loose_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per folder, and each category's total."""
    return storage.with_totals(loose_by_category(spark, sf_dir), "category", "root", "n_files")


def overview_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B18, O7."""
    return storage.overview(catalog.files(spark, sf_dir), _duplicates(spark, sf_dir))


def unreadable_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of the files that cannot be read; here every 97th is damaged."""
    content = F.when(F.col("doc_id") % 97 != 5, F.col("content"))
    return duplicates.unreadable(catalog.files(spark, sf_dir).withColumn("content", content))


def picture_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P6, F-10, P10, P16."""
    found = catalog.files(spark, sf_dir).filter(names.is_image(F.col("ext")))
    key = names.cache_key(F.col("path"), F.col("mtime"), F.col("size"))
    return found.select("path", names.relative(F.col("path"), F.col("root")).alias("below_root"), key.alias("key"))


def multi_root_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scans that overlap in one root; a file that both list is one."""
    files = catalog.scanned(spark, sf_dir).select("root", "path", "size")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(
        F.lit("/ws/pages").alias("root"), F.concat(F.lit("/ws/pages/p_"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.octet_length("html").cast("long").alias("size")
    )
    again = files.filter("root = '/ws/src0'")
    return files.unionByName(pages).unionByName(again).dropDuplicates(["path"])


def workspace_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The storage record with what lies in the trash."""
    ledger = catalog.ledger(spark, sf_dir).filter("destination_exists")
    trashed = ledger.agg(F.count_if(history.in_trash(F.col("destination"))).alias("n_trashed"))
    return storage.telemetry(catalog.files(spark, sf_dir)).join(trashed)


def parsed_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F20."""
    key = F.col("c_custkey")
    text = F.when(key % 4 == 0, key.cast("string")).when(key % 4 == 1, F.concat(F.lit("-"), key.cast("string"))).when(key % 4 == 2, " 3.5 ").otherwise("abc")
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", names.positive_number(text).alias("value"))


def index_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F21."""
    key = F.col("p_partkey")
    text = F.concat((key % 7).cast("string"), F.lit(", "), (key % 4 + 1).cast("string"), F.lit(",x,99"))
    chosen = names.index_list(text, F.lit(5))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.array_join(chosen.cast("array<string>"), ",").alias("chosen"))


# Exact duplicates: A8-A11, B12, B14, W1, W5, W6, O7, O10.
def _duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.exact_duplicates(catalog.scanned(spark, sf_dir))


def duplicate_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _duplicates(spark, sf_dir)


def duplicate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.summary(_duplicates(spark, sf_dir))


def duplicate_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.page(_duplicates(spark, sf_dir), 1)


def top_duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = duplicates.groups_of(_duplicates(spark, sf_dir)).withColumn("wasted", (F.col("n_copies") - 1) * F.col("size"))
    return ranked.orderBy(F.desc("wasted"), "group_path").limit(5)


def dup_size_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8, F-8, F-9."""
    return duplicates.size_candidates(catalog.scanned(spark, sf_dir))


def dup_prefix_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9, F5, S12."""
    return duplicates.prefix_candidates(catalog.scanned(spark, sf_dir))


def _purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    selected = catalog.files(spark, sf_dir).filter("doc_id % 3 <> 0").select("path")
    return duplicates.purge_plan(_duplicates(spark, sf_dir), selected, "/ws/trash", "20240131_000000")


def purge_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies selected for the trash; a group of which all are selected keeps one."""
    return _purge(spark, sf_dir)


def selection_reclaim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A12."""
    return duplicates.reclaimed(_purge(spark, sf_dir))


# Similar pictures: F7, F8, F-11, J7, J8, R2, A22, B13.
def similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.pairs(catalog.signatures(spark, sf_dir), SIGNATURE_BITS)


def similar_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.groups(Scratch(spark, "similar"), catalog.signatures(spark, sf_dir), SIGNATURE_BITS)


def similar_pairs_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J8, F-11: every pair, whatever its bands."""
    return similar.pairs_exact(catalog.signatures(spark, sf_dir), EXACT_BITS)


def similar_groups_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.groups(Scratch(spark, "similar"), catalog.signatures(spark, sf_dir), EXACT_BITS, exact=True)


def similar_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A21."""
    return similar.search_facts(catalog.signatures(spark, sf_dir), SIGNATURE_BITS)


def picture_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the hash's bits from 72 pixels, here the elements of a vector and its first eight again."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return vectors.select(F.col("vec_id").alias("id"), *pictures.difference_hash(F.concat("embedding", F.slice("embedding", 1, 8))))


# Plans: B1-B4, B6-B10, F-6, F-7, J11, J13, J14, W3, W9, A14, X3, X4.
def pre_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = organize.pre_plan(_loose(catalog.scanned(spark, sf_dir)), catalog.AS_OF, LARGE_MB, OLD_DAYS)
    return organize.resolve(plan, _nothing(spark))


def merged_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = organize.category_plan(_loose(catalog.scanned(spark, sf_dir)), F.lit("/out"))
    return organize.resolve(plan, _nothing(spark))


def separate_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = catalog.scanned(spark, sf_dir)
    existing = files.filter("parent <> root").select(F.col("parent").alias("folder"), "name", "size", "content")
    return organize.resolve(organize.category_plan(_loose(files), F.col("root")), existing)


def post_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = catalog.scanned(spark, sf_dir)
    folder = names.base_name(F.col("parent"))
    present = files.filter((F.col("parent") != F.col("root")) & folder.isin(KNOWN)).withColumn("category", folder).withColumn("folder", F.col("parent"))
    planned = organize.category_plan(_loose(files), F.col("root"))
    return organize.post_plan(present, planned, catalog.AS_OF, LARGE_MB, OLD_DAYS)


def mismatched_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return organize.mismatches(catalog.scanned(spark, sf_dir), KNOWN).select("path", "name", "current", "correct")


def mismatch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = organize.mismatches(catalog.scanned(spark, sf_dir), KNOWN)
    return found.groupBy("current", "correct").agg(F.count("*").alias("n_files"))


def rename_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rename.rename_plan(catalog.files(spark, sf_dir), RULE)


def available_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-14, B21, A16."""
    return organize.available(catalog.scanned(spark, sf_dir), KNOWN)


def category_subset_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-13, F-15: two categories; into a folder that exists only the selected extensions go."""
    files = catalog.scanned(spark, sf_dir)
    present = files.filter("parent <> root").select(F.col("parent").alias("folder"))
    return organize.resolve(organize.category_plan(_loose(files), F.col("root"), CHOSEN, SELECTED, present), _nothing(spark))


def organize_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B11, O9."""
    return organize.preview(_loose(catalog.scanned(spark, sf_dir)), [*CHOSEN, "Code"])


def stage_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B5, X2, B10."""
    files = catalog.scanned(spark, sf_dir)
    existing = files.filter("parent <> root").select(F.col("parent").alias("folder"), "name", "size", "content")
    return organize.run_stages(_loose(files), existing, catalog.AS_OF, LARGE_MB, OLD_DAYS)


def stage_plan_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Separation after placing, from where the category stage has put the files."""
    files = _loose(catalog.scanned(spark, sf_dir))
    return organize.run_stages(files, _nothing(spark), catalog.AS_OF, LARGE_MB, OLD_DAYS, ("category", "post"))


def collision_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals meet files of their names, of equal bytes and of others, and numbered ones."""
    loose = _loose(catalog.scanned(spark, sf_dir))
    k = F.floor(F.col("doc_id") / 20)
    folder = F.concat(F.lit("/out/"), F.col("category"))
    there = loose.filter("doc_id % 20 = 0").select(folder.alias("folder"), "name", "size", F.when(k % 2 == 0, F.col("content")).otherwise(F.concat("content", F.lit("x"))).alias("content"))
    first = F.concat(names.stem(F.col("name")), F.lit(" (1)"), names.suffix(F.col("name")))
    numbered = loose.filter((F.col("doc_id") % 20 == 0) & (k % 3 == 0)).select(folder.alias("folder"), first.alias("name"), "size", "content")
    return organize.resolve(organize.category_plan(loose, F.lit("/out")), there.unionByName(numbered))


def mismatch_fix_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B6."""
    return organize.mismatch_fix_plan(catalog.scanned(spark, sf_dir), KNOWN)


def rename_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B7, P7, F11."""
    return rename.rename_plan(catalog.files(spark, sf_dir), ("remove", "f_1"))


def rename_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rename.rename_plan(catalog.files(spark, sf_dir), ("prefix", "  New "))


def rename_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rename.rename_plan(catalog.files(spark, sf_dir), ("suffix", "_v2 "))


def rename_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O8, F-12."""
    return rename.preview(rename_plan(spark, sf_dir))


# History, undo, trash: K9, K11, K12, A17, A19, J9, J10, O3, W2, W4, R4, P12, B17.
def run_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.history(catalog.ledger(spark, sf_dir))


def latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.latest_run(catalog.ledger(spark, sf_dir))


def undo_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.undo_plan(catalog.ledger(spark, sf_dir))


def trash_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = catalog.ledger(spark, sf_dir)
    return history.trash_items(ledger.filter("destination_exists").select(F.col("destination").alias("path")), ledger)


def restore_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = catalog.ledger(spark, sf_dir)
    path = F.when(F.col("is_undone"), F.concat("destination", F.lit(".bak"))).otherwise(F.col("destination"))
    items = ledger.filter(history.in_trash(F.col("destination"))).select(path.alias("path"), F.col("destination_exists").alias("is_present"))
    return history.restore_plan(items, ledger, ledger.filter("source_occupied").select(F.col("source").alias("path")))


def ledger_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.chains(Scratch(spark, "chains"), catalog.ledger(spark, sf_dir))


def trash_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O4."""
    return history.ordered_trash(trash_items(spark, sf_dir))


def restore_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K10, J15."""
    ledger = catalog.ledger(spark, sf_dir)
    items = ledger.filter(history.in_trash(F.col("destination"))).select(F.col("destination").alias("path"), F.col("destination_exists").alias("is_present"))
    selected = ledger.filter("event_id % 3 = 0").select(F.col("destination").alias("path"))
    return history.restore_selected(items, selected, ledger, ledger.filter("source_occupied").select(F.col("source").alias("path")))


def undo_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P14, O9; the first three moves of each run."""
    return history.undo_details(catalog.ledger(spark, sf_dir), 3)


def history_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U2, U3, F-17."""
    ledger = catalog.ledger(spark, sf_dir)
    undone = history.mark_undone(ledger.filter("is_undone").select("run_id"), "run_19700101_000000")
    return history.rebuilt(ledger, undone)


def stage_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moves that are continued once or twice in their run."""
    ledger = catalog.ledger(spark, sf_dir)
    hops = ledger.withColumn("hop", F.explode(F.sequence(F.lit(0), (F.col("event_id") % 3).cast("int"))))
    via = lambda n: F.when(n == 0, F.col("source")).otherwise(F.concat("destination", F.lit("_"), n.cast("string")))
    moves = hops.select(
        "run_id", (F.col("hop") * 100000 + F.col("seq")).alias("seq"), via(F.col("hop")).alias("source"), via(F.col("hop") + 1).alias("destination")
    )
    return history.chains(Scratch(spark, "chains"), moves)


# Folders: R1, K5, O5.
def empty_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vacuum.empty_folders(catalog.folders(spark, sf_dir))


def vacuum_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vacuum.vacuum_plan(vacuum.empty_folders(catalog.folders(spark, sf_dir)))


def vacuum_to_trash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5, O5."""
    return vacuum.to_trash(vacuum_plan(spark, sf_dir), "/ws/trash", "batch_vacuum_20240131_000000")


# Cache: J3-J6, U1, U4, F-18, X5.
def _cache(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(cache, keys): a third of the files have changed since they were cached."""
    files = catalog.files(spark, sf_dir).filter("size is not null")
    keys = files.select("path", F.lit("full").alias("kind"), "mtime", "size", F.md5("content").alias("value"), "doc_id")
    stale = keys.withColumn("mtime", F.when(F.col("doc_id") % 3 == 1, F.col("mtime") - 1).otherwise(F.col("mtime")))
    return stale.drop("doc_id"), keys.drop("doc_id")


def cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.hits(*_cache(spark, sf_dir))


def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.misses(*_cache(spark, sf_dir))


def cache_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, keys = _cache(spark, sf_dir)
    return cache.upsert(held, keys.withColumn("value", F.upper("value")))


def cache_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.prune(*_cache(spark, sf_dir))


def thumbnail_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache without kinds."""
    held, keys = _cache(spark, sf_dir)
    return cache.hits(held.drop("kind").withColumnRenamed("value", "b64"), keys.select("path", "mtime", "size"))


# Dictionary: S7, A18, P15, F10, O6, X6.
def category_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.categories()
    rows = [(name, ", ".join(exts), name not in rules.DEFAULT_CATEGORIES or exts != rules.DEFAULT_CATEGORIES[name]) for name, exts in found.items()]
    table = spark.createDataFrame(rows, "category string, listed string, is_custom boolean")
    return table.select("category", F.explode(names.normalized_extensions(F.col("listed"))).alias("ext"), "is_custom")


def extension_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A18, J1."""
    return rules.owners(rules.dictionary(spark))


def category_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O6."""
    return rules.listing(rules.dictionary(spark))


def category_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One category replaced, one removed, one built-in reverted."""
    table = rules.put_category(rules.dictionary(spark), "Audio", ".MP3, wav , , mp3")
    table = rules.drop_category(rules.put_category(table, "Code", "py"), "Code")
    return rules.drop_category(table, "Screenshots").select("category", "ext", "is_custom")


_DICTIONARY = ", ".join(f"('{ext}', '{name}')" for ext, name in rules.lookup(rules.categories()).items())
_LISTED = ", ".join(
    f"('{name}', '{ext}', {str(name not in rules.DEFAULT_CATEGORIES).lower()})" for name, exts in rules.categories().items() for ext in exts
)
_KNOWN = ", ".join(f"'{name}'" for name in KNOWN)

FILES = f"""WITH dictionary(ext, category) AS (VALUES {_DICTIONARY}),
f0 AS (SELECT doc_id, doc_id // 20 AS k, '/ws/' || coalesce(source, 'unknown') AS root, strlen(text) AS size,
              CAST({catalog.AS_OF} - (doc_id * 7 % 400) * 86400 AS DOUBLE) AS mtime, text AS content FROM documents),
f1 AS (SELECT *, (['', 'Images', 'Documents', 'Code', 'misc'])[k % 5 + 1] AS dir,
              'f_' || k || (['.jpg', '.PNG', '.mp4', '.pdf', '.csv', '.zip', '.py', '', '.tmp', '.tif', '.md', '.xyz'])[k % 12 + 1] AS name FROM f0),
f2 AS (SELECT *, CASE WHEN dir = '' THEN root ELSE root || '/' || dir END AS parent,
              CASE WHEN contains(name, '.') THEN '.' || lower(split_part(name, '.', 2)) ELSE '(no extension)' END AS ext FROM f1),
files AS (SELECT f2.*, parent || '/' || name AS path, coalesce(category, 'Others') AS category,
                 split_part(name, '.', 1) AS stem,
                 (lower(name) GLOB '*.tmp' OR lower(name) IN ('thumbs.db', 'desktop.ini', 'config.json')) AS is_excluded
          FROM f2 LEFT JOIN dictionary USING (ext)),
scanned AS (SELECT * FROM files WHERE NOT is_excluded),
loose AS (SELECT * FROM scanned WHERE parent = root)"""

_DUPLICATES = f"""{FILES},
dup AS (SELECT min(path) OVER g AS group_path, path, size, sha256(content) AS digest, count(*) OVER g AS n_copies
        FROM scanned WHERE size > 0 WINDOW g AS (PARTITION BY size, content)),
d AS (SELECT *, path <> group_path AS is_extra FROM dup WHERE n_copies > 1),
grp AS (SELECT group_path, n_copies, size FROM d WHERE NOT is_extra)"""

_LEDGER = f"""WITH l0 AS (SELECT *, strftime(ts, '%Y%m%d') AS run_day, '/ws/src' || (user_id % 20) AS root FROM events),
ledger AS (SELECT 'run_' || run_day || '_' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS run_id, run_day, event_id, root,
       root || '/f_' || event_id || '.dat' AS source,
       CASE WHEN event_type = 'error' THEN root || '{catalog.TRASH}' || run_day || '/f_' || event_id || '.dat'
            ELSE root || '/' || event_type || '/f_' || event_id || '.dat' END AS destination,
       event_type = 'error' AS trashed, user_id % 7 = 0 AS is_undone,
       event_id % 10 <> 0 AS destination_exists, event_id % 13 = 0 AS source_occupied FROM l0),
runs AS (SELECT run_id, max(run_day) AS run_day, count(*) AS n_entries, bool_or(is_undone) AS is_undone FROM ledger GROUP BY run_id)"""

_FOLDERS = r"""WITH u AS (SELECT page_id, string_split(regexp_replace(regexp_replace(url, '^[^:]*://', ''), '[?#].*$', ''), '/') AS p
       FROM pages WHERE url IS NOT NULL),
v AS (SELECT '/ws/' || p[1] AS host, CASE WHEN len(p) > 1 AND p[2] <> '' THEN '/ws/' || p[1] || '/' || p[2] ELSE '/ws/' || p[1] END AS leaf,
             page_id % 3 = 0 AS f FROM u),
folders AS (SELECT path, bool_or(f) AS has_file FROM (SELECT leaf AS path, f FROM v UNION ALL SELECT host, false FROM v) GROUP BY path),
empty AS (SELECT path, CAST(len(string_split(path, '/')) - 1 AS INTEGER) AS depth FROM folders a
          WHERE NOT EXISTS (SELECT 1 FROM folders b WHERE b.has_file AND (b.path = a.path OR starts_with(b.path, a.path || '/'))))"""

_BITS = ", ".join(
    "CAST(" + " + ".join(f"CASE WHEN embedding[{16 * b + i + 1}] >= 0 THEN {2**i} ELSE 0 END" for i in range(16)) + f" AS INTEGER) AS b{b}" for b in range(4)
)
_DISTANCE = " + ".join(f"bit_count(xor(l.b{b}, r.b{b}))" for b in range(4))
_PAIRS = f"""sig AS (SELECT vec_id AS id, {_BITS} FROM embeddings),
first_of AS (SELECT min(id) AS id, b0, b1, b2, b3 FROM sig GROUP BY b0, b1, b2, b3),
close AS (SELECT l.id AS i, r.id AS j, CAST({_DISTANCE} AS INTEGER) AS distance FROM first_of l JOIN first_of r
          ON l.id < r.id AND (l.b0 = r.b0 OR l.b1 = r.b1 OR l.b2 = r.b2 OR l.b3 = r.b3) WHERE {_DISTANCE} <= {SIGNATURE_BITS})"""

_EXACT = f"""sig AS (SELECT vec_id AS id, {_BITS} FROM embeddings),
first_of AS (SELECT min(id) AS id, b0, b1, b2, b3 FROM sig GROUP BY b0, b1, b2, b3),
close AS (SELECT l.id AS i, r.id AS j, CAST({_DISTANCE} AS INTEGER) AS distance FROM first_of l JOIN first_of r ON l.id < r.id WHERE {_DISTANCE} <= {EXACT_BITS})"""
_HASH = ", ".join(
    "CAST(" + " + ".join(f"CASE WHEN x[{9 * r + c + 1}] >= x[{9 * r + c + 2}] THEN {2**i} ELSE 0 END" for i in range(16) for r, c in [divmod(16 * b + i, 8)]) + f" AS INTEGER) AS b{b}"
    for b in range(4)
)

_CACHE = f"""{FILES},
keys AS (SELECT path, 'full' AS kind, mtime, size, md5(content) AS value, doc_id FROM files WHERE size IS NOT NULL),
held AS (SELECT path, kind, CASE WHEN doc_id % 3 = 1 THEN mtime - 1 ELSE mtime END AS mtime, size, value FROM keys)"""

_CLAIMS = ", ".join(
    f"('{name}', '{ext}', {i})" for i, (name, ext) in enumerate((name, ext) for name, exts in rules.categories().items() for ext in exts)
)
_EDITED = ", ".join(
    f"('{name}', '{ext}', {str(name == 'Audio').lower()})"
    for name, exts in (rules.DEFAULT_CATEGORIES | {"Audio": [".mp3", ".wav"]}).items()
    for ext in exts
)
_PURGE = f"""{_DUPLICATES},
chosen AS (SELECT d.*, count(*) OVER g AS n_chosen, min(d.path) OVER g AS first_chosen FROM d JOIN files f USING (path)
           WHERE f.doc_id % 3 <> 0 WINDOW g AS (PARTITION BY group_path)),
judged AS (SELECT path, size, regexp_extract(path, '[^/]*$') AS name, CASE WHEN n_chosen = n_copies AND path = first_chosen THEN 'kept' ELSE 'trash' END AS outcome FROM chosen),
purge AS (SELECT path AS source, size, outcome, name, row_number() OVER (PARTITION BY name, outcome ORDER BY path) - 1 AS r FROM judged)"""

_BYTES = "CAST(coalesce(sum(coalesce(size, 0)), 0) AS BIGINT) AS bytes"


def _resolved(moves: str, existing: str = "") -> str:
    """SQL that numbers clashing arrivals of ``moves`` (label, source, folder, name, stem)."""
    return f"""{FILES}, moves AS ({moves}), n AS (SELECT *, row_number() OVER (PARTITION BY folder, name ORDER BY source) - 1 AS r FROM moves)
SELECT label, source, folder || '/' || CASE WHEN r = 0 THEN name ELSE stem || ' (' || r || ')' || substr(name, length(stem) + 1) END AS destination,
       'move' AS status FROM n"""


def _renamed(stem: str) -> str:
    """SQL of a rename whose new stem, before trimming, is ``stem``; old names stay taken."""
    return f"""{FILES}, v AS (SELECT *, trim({stem}) AS t FROM files),
        w AS (SELECT path, parent, name, CASE WHEN t = '' THEN stem ELSE t END AS ns, substr(name, length(stem) + 1) AS sx FROM v),
        t AS (SELECT w.*, ns || sx AS nn, EXISTS (SELECT 1 FROM files f WHERE f.parent = w.parent AND f.name = w.ns || w.sx) AS busy FROM w),
        r AS (SELECT *, row_number() OVER (PARTITION BY parent, nn, name = nn ORDER BY path) - CASE WHEN busy THEN 0 ELSE 1 END AS k FROM t),
        plan AS (SELECT path AS source, parent || '/' || CASE WHEN name = nn OR k = 0 THEN nn ELSE ns || ' (' || k || ')' || sx END AS destination, name <> nn AS changed FROM r)"""


ORACLES = {
    "storage_ranked": f"""{FILES}, g AS (SELECT category, count(*) AS n_files, {_BYTES} FROM scanned GROUP BY category)
        SELECT *, CAST(row_number() OVER (ORDER BY bytes DESC, category) AS INTEGER) AS position FROM g""",
    "extension_ranked": f"""{FILES}, g AS (SELECT ext, count(*) AS n_files, {_BYTES} FROM scanned GROUP BY ext)
        SELECT *, CAST(row_number() OVER (ORDER BY bytes DESC, ext) AS INTEGER) AS position FROM g""",
    "storage_share_cumulative": f"""{FILES}, g AS (SELECT category, {_BYTES} FROM scanned GROUP BY category),
        h AS (SELECT *, CAST(sum(bytes) OVER (ORDER BY bytes DESC, category ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto, CAST(sum(bytes) OVER () AS BIGINT) AS total FROM g)
        SELECT category, bytes, CAST(floor((upto - bytes) * CAST(1000000 AS DOUBLE) / total) AS BIGINT) AS start_ppm, CAST(floor(upto * CAST(1000000 AS DOUBLE) / total) AS BIGINT) AS end_ppm FROM h""",
    "storage_bars": f"""{FILES}, g AS (SELECT category, {_BYTES} FROM scanned GROUP BY category)
        SELECT CAST(row_number() OVER (ORDER BY bytes DESC, category) AS INTEGER) AS position, rpad(category, 16, ' ') || ' ' ||
               repeat('█', CAST(greatest(1, round_even(bytes / max(bytes) OVER () * 30, 0)) AS INTEGER)) || ' ' ||
               CASE WHEN bytes < 1024 THEN bytes || ' B' WHEN bytes < 1048576 THEN printf('%.1f KB', bytes / 1024)
                    WHEN bytes < 1073741824 THEN printf('%.1f MB', bytes / 1048576) ELSE printf('%.1f GB', bytes / 1073741824) END AS line FROM g WHERE bytes > 0""",
    "loose_totals": f"{FILES} SELECT category, root, count(*) AS n_files FROM loose GROUP BY GROUPING SETS ((category, root), (category))",
    "overview_report": f"""{_DUPLICATES}, c AS (SELECT category AS label, count(*) AS n, {_BYTES} FROM scanned GROUP BY category),
        e AS (SELECT ext AS label, count(*) AS n, {_BYTES} FROM scanned GROUP BY ext),
        x AS (SELECT group_path AS label, n_copies AS n, (n_copies - 1) * size AS bytes FROM grp ORDER BY bytes DESC, label LIMIT 5),
        o AS (SELECT 'category' AS section, CAST(row_number() OVER (ORDER BY bytes DESC, label) AS INTEGER) AS position, label, n, bytes FROM c
              UNION ALL SELECT 'extension', CAST(row_number() OVER (ORDER BY bytes DESC, label) AS INTEGER), label, n, bytes FROM e
              UNION ALL SELECT 'duplicates', CAST(row_number() OVER (ORDER BY bytes DESC, label) AS INTEGER), label, n, bytes FROM x
              UNION ALL SELECT 'total', 1, 'files', count(*), CAST(coalesce(sum(size), 0) AS BIGINT) FROM scanned
              UNION ALL SELECT 'total', 2, 'excluded', count(*), NULL FROM files WHERE is_excluded
              UNION ALL SELECT 'total', 3, 'unreadable', count(*), NULL FROM scanned WHERE size IS NULL) SELECT * FROM o""",
    "unreadable_files": f"""{FILES} SELECT path, CAST(row_number() OVER (ORDER BY path) AS INTEGER) AS position FROM files
        WHERE size IS NULL OR content IS NULL OR doc_id % 97 = 5 ORDER BY path LIMIT 10""",
    "picture_files": f"""{FILES} SELECT path, CASE WHEN dir = '' THEN name ELSE dir || '/' || name END AS below_root, concat_ws('|', path, printf('%.6f', mtime), size) AS key
        FROM files WHERE ext IN ('.jpg', '.jpeg', '.png', '.bmp', '.gif', '.webp', '.tiff', '.tif', '.heic')""",
    "multi_root_union": f"""{FILES} SELECT root, path, size FROM scanned UNION ALL
        SELECT '/ws/pages', '/ws/pages/p_' || page_id || '.html', strlen(html) FROM pages""",
    "parsed_numbers": """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN CAST(c_custkey AS DOUBLE) WHEN 2 THEN CAST(3.5 AS DOUBLE) END AS value FROM customer""",
    "index_lists": """SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN '1,2,3,4,5' WHEN p_partkey % 7 = 6 OR p_partkey % 7 = p_partkey % 4 + 1 THEN CAST(p_partkey % 4 + 1 AS VARCHAR)
        ELSE least(p_partkey % 7, p_partkey % 4 + 1) || ',' || greatest(p_partkey % 7, p_partkey % 4 + 1) END AS chosen FROM part""",
    "dup_size_candidates": f"{FILES} SELECT size, count(*) AS n FROM scanned WHERE size > 0 GROUP BY size HAVING count(*) > 1",
    "dup_prefix_candidates": f"{FILES} SELECT size, md5(encode(content)[1:8192]) AS prefix, count(*) AS n FROM scanned WHERE size > 0 GROUP BY ALL HAVING count(*) > 1",
    "purge_plan": f"""{_PURGE} SELECT source, size, outcome, CASE WHEN outcome = 'trash' THEN '/ws/trash/20240131_000000/' || split_part(name, '.', 1) ||
        CASE WHEN r > 0 THEN ' (' || r || ')' ELSE '' END || CASE WHEN contains(name, '.') THEN '.' || split_part(name, '.', 2) ELSE '' END END AS destination FROM purge""",
    "selection_reclaim": f"""{_PURGE} SELECT count(*) AS n_files, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM purge WHERE outcome = 'trash'""",
    "similar_pairs_exact": f"WITH {_EXACT} SELECT * FROM close",
    "similar_groups_exact": f"""WITH RECURSIVE {_EXACT},
        copies AS (SELECT f.id AS i, s.id AS j FROM sig s JOIN first_of f USING (b0, b1, b2, b3) WHERE s.id <> f.id),
        e AS (SELECT i, j FROM close UNION SELECT j, i FROM close UNION SELECT i, j FROM copies UNION SELECT j, i FROM copies),
        reach AS (SELECT i, j FROM e UNION SELECT r.i, e.j FROM reach r JOIN e ON r.j = e.i)
        SELECT i AS id, least(i, min(j)) AS group_id FROM reach GROUP BY i""",
    "similar_facts": f"""WITH {_PAIRS} SELECT (SELECT count(*) FROM sig) AS n_signatures, (SELECT count(*) FROM first_of) AS n_distinct, (SELECT count(*) FROM close) AS n_pairs""",
    "picture_hashes": f"WITH p AS (SELECT vec_id AS id, list_concat(embedding, embedding[1:8]) AS x FROM embeddings) SELECT id, {_HASH} FROM p",
    "available_categories": f"{FILES} SELECT category, count(*) AS n_files FROM scanned GROUP BY category",
    "category_subset_plan": f"""{FILES} SELECT category AS label, path AS source, root || '/' || category || '/' || name AS destination, 'move' AS status FROM loose l
        WHERE category IN ('Images', 'Documents') AND (category <> 'Documents' OR ext = '.pdf'
              OR NOT EXISTS (SELECT 1 FROM scanned s WHERE s.parent = l.root || '/Documents'))""",
    "organize_preview": f"""{FILES} SELECT CAST(row_number() OVER (ORDER BY path) AS INTEGER) AS position, path, name, category,
        coalesce(CASE WHEN size < 1024 THEN size || ' B' WHEN size < 1048576 THEN printf('%.1f KB', size / 1024) ELSE printf('%.1f MB', size / 1048576) END, 'N/A') AS size_label
        FROM loose WHERE category IN ('Images', 'Documents', 'Code') ORDER BY path LIMIT 150""",
    "stage_plan": f"""{FILES}, m AS (SELECT *, CASE WHEN size >= 8192 THEN 'Large' WHEN ({catalog.AS_OF} - mtime) / 86400 >= 180 THEN 'Old' END AS kind FROM loose)
        SELECT 1 AS stage_ord, 'pre' AS stage, CASE kind WHEN 'Large' THEN 'Large Files' ELSE 'General Old' END AS label, path AS source,
               root || '/' || CASE kind WHEN 'Large' THEN 'Large Files' ELSE 'General Old' END || '/' || name AS destination, 'move' AS status FROM m WHERE kind IS NOT NULL
        UNION ALL SELECT 2, 'category', category, path, root || '/' || category || '/' || name, 'move' FROM m WHERE kind IS NULL""",
    "stage_plan_late": f"""{FILES}, m AS (SELECT *, CASE WHEN size >= 8192 THEN 'Large' WHEN ({catalog.AS_OF} - mtime) / 86400 >= 180 THEN 'Old' END AS kind,
            root || '/' || category AS folder FROM loose)
        SELECT 2 AS stage_ord, 'category' AS stage, category AS label, path AS source, folder || '/' || name AS destination, 'move' AS status FROM m
        UNION ALL SELECT 3, 'post', kind || ' ' || category, folder || '/' || name, folder || '/' || kind || ' ' || category || '/' || name, 'move' FROM m WHERE kind IS NOT NULL""",
    "collision_resolve": f"""{FILES}, m AS (SELECT category AS label, path AS source, '/out/' || category AS folder, name, stem, k, content FROM loose),
        ex AS (SELECT '/out/' || category AS folder, name, CASE WHEN k % 2 = 0 THEN content ELSE content || 'x' END AS there FROM loose WHERE doc_id % 20 = 0),
        j AS (SELECT m.*, e.name IS NOT NULL AS busy, coalesce(there = content, false) AS same FROM m LEFT JOIN ex e USING (folder, name)),
        n AS (SELECT *, row_number() OVER (PARTITION BY folder, name ORDER BY source) - CASE WHEN busy THEN 0 ELSE 1 END AS r FROM j WHERE NOT same)
        SELECT label, source, folder || '/' || CASE WHEN r = 0 THEN name ELSE stem || ' (' || (r + CASE WHEN busy AND k % 3 = 0 THEN 1 ELSE 0 END) || ')' || substr(name, length(stem) + 1) END
               AS destination, 'move' AS status FROM n UNION ALL SELECT label, source, NULL, 'skipped' FROM j WHERE same""",
    "mismatch_fix_plan": f"""{FILES} SELECT category AS label, path AS source, root || '/' || category || '/' || name AS destination, 'move' AS status
        FROM scanned WHERE dir IN ({_KNOWN}) AND dir <> category""",
    "rename_remove": _renamed("replace(stem, 'f_1', '')") + " SELECT * FROM plan",
    "rename_prefix": _renamed("'  New ' || stem") + " SELECT * FROM plan",
    "rename_suffix": _renamed("stem || '_v2 '") + " SELECT * FROM plan",
    "rename_preview": _renamed("replace(stem, '1', '')") + " SELECT CAST(row_number() OVER (ORDER BY source) AS INTEGER) AS position, source, destination FROM plan WHERE changed ORDER BY source LIMIT 50",
    "trash_listing": f"""{_LEDGER}, t AS (SELECT destination AS path, run_day AS batch, 'f_' || event_id || '.dat' AS name, source AS origin FROM ledger WHERE trashed AND destination_exists)
        SELECT *, CAST(dense_rank() OVER (ORDER BY batch DESC) AS INTEGER) AS batch_position, CAST(row_number() OVER (PARTITION BY batch ORDER BY name, path) AS INTEGER) AS position FROM t""",
    "restore_selected": f"""{_LEDGER} SELECT destination AS path, source AS origin,
        CASE WHEN NOT destination_exists THEN 'missing' WHEN source_occupied THEN 'occupied' ELSE 'restore' END AS outcome FROM ledger WHERE trashed AND event_id % 3 = 0""",
    "undo_details": f"""{_LEDGER}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY run_id ORDER BY event_id) AS INTEGER) AS position FROM ledger)
        SELECT run_id, position, 'f_' || event_id || '.dat' AS file_name, root AS source_dir, regexp_replace(destination, '/[^/]*$', '') AS destination_dir,
               'f_' || event_id || '.dat' AS destination_name FROM r WHERE position <= 3""",
    "history_rebuilt": f"{_LEDGER} SELECT * FROM runs",
    "stage_chains": f"""{_LEDGER} SELECT run_id, source AS first_source, destination || '_' || (event_id % 3 + 1) AS last_destination, event_id % 3 + 1 AS n_moves FROM ledger""",
    "vacuum_to_trash": f"""{_FOLDERS}, top AS (SELECT * FROM empty a WHERE NOT EXISTS (SELECT 1 FROM empty b WHERE regexp_replace(a.path, '/[^/]*$', '') = b.path)),
        n AS (SELECT *, regexp_extract(path, '[^/]*$') AS name FROM top),
        o AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY depth, path) - 1 AS r FROM n)
        SELECT depth, CAST(row_number() OVER (PARTITION BY depth ORDER BY path) AS INTEGER) AS step, path AS source,
               '/ws/trash/batch_vacuum_20240131_000000/' || name || CASE WHEN r > 0 THEN '_' || r ELSE '' END AS destination FROM o""",
    "thumbnail_hits": f"{_CACHE} SELECT path, mtime, size, value AS b64 FROM held h WHERE EXISTS (SELECT 1 FROM keys k WHERE (k.path, k.mtime, k.size) = (h.path, h.mtime, h.size))",
    "extension_owner": f"SELECT ext, max_by(category, ord) AS category FROM (VALUES {_CLAIMS}) t(category, ext, ord) GROUP BY ext",
    "category_names": f"""SELECT category, count(*) AS n_extensions, CAST(row_number() OVER (ORDER BY category) AS INTEGER) AS position
        FROM (VALUES {_CLAIMS}) t(category, ext, ord) GROUP BY category""",
    "workspace_telemetry": f"""{FILES}, t AS (SELECT count(*) AS n_trashed FROM events WHERE event_type = 'error' AND event_id % 10 <> 0)
        SELECT count(*) FILTER (NOT is_excluded) AS n_files, CAST(coalesce(sum(size) FILTER (NOT is_excluded), 0) AS BIGINT) AS bytes,
               count(*) FILTER (is_excluded) AS n_excluded, count(*) FILTER (NOT is_excluded AND size IS NULL) AS n_unreadable, any_value(n_trashed) AS n_trashed FROM files, t""",
    "category_edit": f"SELECT * FROM (VALUES {_EDITED}) t(category, ext, is_custom)",
    "storage_by_category": f"""{FILES}, g AS (SELECT category, count(*) AS n_files, {_BYTES} FROM scanned GROUP BY category)
        SELECT *, CAST(coalesce(floor(bytes / nullif(sum(bytes) OVER (), 0) * 100), 0) AS BIGINT) AS pct,
               CAST(CASE WHEN bytes = 0 THEN 0 ELSE greatest(1, round_even(bytes / max(bytes) OVER () * 30, 0)) END AS INTEGER) AS bar,
               CASE WHEN bytes < 1024 THEN bytes || ' B' WHEN bytes < 1048576 THEN printf('%.1f KB', bytes / 1024)
                    WHEN bytes < 1073741824 THEN printf('%.1f MB', bytes / 1048576) ELSE printf('%.1f GB', bytes / 1073741824) END AS size_label FROM g""",
    "storage_by_extension": f"{FILES} SELECT ext, count(*) AS n_files, {_BYTES} FROM scanned GROUP BY ext",
    "storage_by_root": f"{FILES} SELECT root, category, count(*) AS n_files, {_BYTES} FROM scanned GROUP BY root, category",
    "storage_telemetry": f"""{FILES} SELECT count(*) FILTER (NOT is_excluded) AS n_files,
        CAST(coalesce(sum(size) FILTER (NOT is_excluded), 0) AS BIGINT) AS bytes, count(*) FILTER (is_excluded) AS n_excluded,
        count(*) FILTER (NOT is_excluded AND size IS NULL) AS n_unreadable FROM files""",
    "loose_by_category": f"{FILES} SELECT category, root, count(*) AS n_files FROM loose GROUP BY category, root",
    "excluded_by_root": f"{FILES} SELECT root, count(*) FILTER (is_excluded) AS n_excluded FROM files GROUP BY root",
    "separation_preview": f"""{FILES} SELECT count(*) AS n_files, {_BYTES} FROM scanned
        WHERE size >= 8192 OR ({catalog.AS_OF} - mtime) / 86400 >= 180""",
    "file_labels": f"""{FILES} SELECT path, ext, category, CASE WHEN size < 1024 THEN size || ' B' WHEN size < 1048576 THEN printf('%.1f KB', size / 1024)
        ELSE printf('%.1f MB', size / 1048576) END AS size_label, ({catalog.AS_OF} - mtime) / 86400 AS age_days, stem FROM files""",
    "duplicate_files": f"{_DUPLICATES} SELECT * FROM d",
    "duplicate_summary": f"""{_DUPLICATES} SELECT count(*) AS n_groups, CAST(coalesce(sum(n_copies - 1), 0) AS BIGINT) AS n_extra,
        CAST(coalesce(sum((n_copies - 1) * size), 0) AS BIGINT) AS reclaimable FROM grp""",
    "duplicate_page": f"""{_DUPLICATES}, o AS (SELECT group_path, row_number() OVER (ORDER BY group_path) - 1 AS i, count(*) OVER () AS total FROM grp),
        c AS (SELECT group_path, CAST(i AS INTEGER) AS group_index FROM o WHERE i // 25 = greatest(0, least(1, (total + 24) // 25 - 1))),
        m AS (SELECT group_index, group_path, path, CAST(row_number() OVER (PARTITION BY group_path ORDER BY path) AS INTEGER) AS ordinal, n_copies
              FROM d JOIN c USING (group_path)) SELECT * FROM m WHERE ordinal <= 10""",
    "top_duplicate_groups": f"{_DUPLICATES} SELECT *, (n_copies - 1) * size AS wasted FROM grp ORDER BY wasted DESC, group_path LIMIT 5",
    "similar_pairs": f"WITH {_PAIRS} SELECT * FROM close",
    "similar_groups": f"""WITH RECURSIVE {_PAIRS},
        copies AS (SELECT f.id AS i, s.id AS j FROM sig s JOIN first_of f USING (b0, b1, b2, b3) WHERE s.id <> f.id),
        e AS (SELECT i, j FROM close UNION SELECT j, i FROM close UNION SELECT i, j FROM copies UNION SELECT j, i FROM copies),
        reach AS (SELECT i, j FROM e UNION SELECT r.i, e.j FROM reach r JOIN e ON r.j = e.i)
        SELECT i AS id, least(i, min(j)) AS group_id FROM reach GROUP BY i""",
    "pre_plan": _resolved(f"""SELECT label, path AS source, root || '/' || label AS folder, name, stem FROM (SELECT *, CASE WHEN size >= 8192 THEN 'Large Files'
        WHEN ({catalog.AS_OF} - mtime) / 86400 >= 180 THEN 'General Old' END AS label FROM loose) WHERE label IS NOT NULL"""),
    "merged_plan": _resolved("SELECT category AS label, path AS source, '/out/' || category AS folder, name, stem FROM loose"),
    "separate_plan": _resolved("SELECT category AS label, path AS source, root || '/' || category AS folder, name, stem FROM loose"),
    "post_plan": f"""{FILES}, c AS (SELECT parent AS folder, dir AS category, name, size, mtime FROM scanned WHERE parent <> root AND dir IN ({_KNOWN})
        UNION ALL SELECT root || '/' || category, category, name, size, mtime FROM loose),
        k AS (SELECT *, CASE WHEN size >= 8192 THEN 'Large' WHEN ({catalog.AS_OF} - mtime) / 86400 >= 180 THEN 'Old' END AS kind FROM c)
        SELECT kind || ' ' || category AS label, folder || '/' || name AS source, folder || '/' || kind || ' ' || category || '/' || name AS destination
        FROM k WHERE kind IS NOT NULL""",
    "mismatched_files": f"{FILES} SELECT path, name, dir AS current, category AS correct FROM scanned WHERE dir IN ({_KNOWN}) AND dir <> category",
    "mismatch_counts": f"""{FILES} SELECT dir AS current, category AS correct, count(*) AS n_files FROM scanned
        WHERE dir IN ({_KNOWN}) AND dir <> category GROUP BY ALL""",
    "rename_plan": f"""{FILES}, w AS (SELECT path, parent, name, replace(stem, '1', '') AS ns, substr(name, length(stem) + 1) AS sx FROM files),
        t AS (SELECT w.*, ns || sx AS nn, EXISTS (SELECT 1 FROM files f WHERE f.parent = w.parent AND f.name = w.ns || w.sx) AS busy FROM w),
        r AS (SELECT *, row_number() OVER (PARTITION BY parent, nn, name = nn ORDER BY path) - CASE WHEN busy THEN 0 ELSE 1 END AS k FROM t)
        SELECT path AS source, parent || '/' || CASE WHEN name = nn OR k = 0 THEN nn ELSE ns || ' (' || k || ')' || sx END AS destination,
               name <> nn AS changed FROM r""",
    "run_history": f"""{_LEDGER} SELECT *, strftime(strptime(run_day, '%Y%m%d'), '%Y-%m-%d') AS label,
        CAST(row_number() OVER (ORDER BY run_day DESC, run_id DESC) AS INTEGER) AS index FROM runs""",
    "latest_run": f"{_LEDGER} SELECT * FROM runs WHERE NOT is_undone ORDER BY run_day DESC, run_id DESC LIMIT 1",
    "undo_plan": f"""{_LEDGER} SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY event_id DESC) AS INTEGER) AS step,
        destination AS source, source AS destination,
        CASE WHEN NOT destination_exists THEN 'missing' WHEN source_occupied THEN 'occupied' ELSE 'restore' END AS outcome FROM ledger""",
    "trash_items": f"""{_LEDGER} SELECT destination AS path, run_day AS batch, 'f_' || event_id || '.dat' AS name, source AS origin
        FROM ledger WHERE trashed AND destination_exists""",
    "restore_plan": f"""{_LEDGER} SELECT CASE WHEN is_undone THEN destination || '.bak' ELSE destination END AS path,
        CASE WHEN NOT is_undone THEN source END AS origin,
        CASE WHEN NOT destination_exists THEN 'missing' WHEN is_undone THEN 'unknown origin' WHEN source_occupied THEN 'occupied' ELSE 'restore' END AS outcome
        FROM ledger WHERE trashed""",
    "ledger_chains": f"{_LEDGER} SELECT run_id, source AS first_source, destination AS last_destination, CAST(1 AS BIGINT) AS n_moves FROM ledger",
    "empty_folders": f"{_FOLDERS} SELECT * FROM empty",
    "vacuum_plan": f"{_FOLDERS} SELECT * FROM empty a WHERE NOT EXISTS (SELECT 1 FROM empty b WHERE regexp_replace(a.path, '/[^/]*$', '') = b.path)",
    "cache_hits": f"{_CACHE} SELECT * FROM held h WHERE EXISTS (SELECT 1 FROM keys k WHERE (k.path, k.mtime, k.size) = (h.path, h.mtime, h.size))",
    "cache_misses": f"""{_CACHE} SELECT path, kind, mtime, size, value FROM keys k
        WHERE NOT EXISTS (SELECT 1 FROM held h WHERE (k.path, k.mtime, k.size) = (h.path, h.mtime, h.size))""",
    "cache_upsert": f"""{_CACHE} SELECT path, kind, mtime, size, upper(value) AS value FROM keys UNION ALL
        SELECT * FROM held h WHERE NOT EXISTS (SELECT 1 FROM keys k WHERE (k.path, k.mtime, k.size) = (h.path, h.mtime, h.size))""",
    "cache_prune": f"{_CACHE} SELECT * FROM held h WHERE EXISTS (SELECT 1 FROM keys k WHERE (k.path, k.mtime, k.size) = (h.path, h.mtime, h.size))",
    "category_extensions": f"SELECT * FROM (VALUES {_LISTED}) t(category, ext, is_custom)",
}

_QUERIES = [
    storage_by_category, storage_by_extension, storage_by_root, storage_telemetry, loose_by_category, excluded_by_root,
    separation_preview, file_labels, duplicate_files, duplicate_summary, duplicate_page, top_duplicate_groups,
    similar_pairs, similar_groups, pre_plan, merged_plan, separate_plan, post_plan, mismatched_files, mismatch_counts,
    rename_plan, run_history, latest_run, undo_plan, trash_items, restore_plan, ledger_chains, empty_folders,
    vacuum_plan, cache_hits, cache_misses, cache_upsert, cache_prune, category_extensions,
    storage_ranked, extension_ranked, storage_share_cumulative, storage_bars, loose_totals, overview_report, unreadable_files,
    picture_files, multi_root_union, parsed_numbers, index_lists, dup_size_candidates, dup_prefix_candidates, purge_plan,
    selection_reclaim, similar_pairs_exact, similar_groups_exact, similar_facts, picture_hashes, available_categories,
    category_subset_plan, organize_preview, stage_plan, stage_plan_late, collision_resolve, mismatch_fix_plan, rename_remove, rename_prefix,
    rename_suffix, rename_preview, trash_listing, restore_selected, undo_details, history_rebuilt, stage_chains,
    vacuum_to_trash, thumbnail_hits, extension_owner, category_edit,
    category_names, workspace_telemetry,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {query.__name__: query for query in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
