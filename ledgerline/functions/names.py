"""File names, sizes and ages as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

NO_EXTENSION = "(no extension)"
# Fixed values.
PICTURES = [".jpg", ".jpeg", ".png", ".bmp", ".gif", ".webp", ".tiff", ".tif", ".heic"]


def suffix(name: Column) -> Column:
    """The last dotted part with its dot; empty for dot files, trailing dots and bare names."""
    return F.regexp_extract(name, r"(?s)^.*[^/](\.[^./]+)$", 1)


def extension(name: Column) -> Column:
    """Lower-cased suffix, or a label where there is none."""
    found = F.lower(suffix(name))
    return F.when(found == "", NO_EXTENSION).otherwise(found)


def stem(name: Column) -> Column:
    """The name without its suffix."""
    return F.substring(name, F.lit(1), F.length(name) - F.length(suffix(name)))


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)([^/]*)$", 1)


def is_image(ext: Column) -> Column:
    return F.coalesce(ext.isin(PICTURES), F.lit(False))


def relative(path: Column, root: Column) -> Column:
    """The path below ``root``; null for a path outside it."""
    return F.when(path.startswith(F.concat(root, F.lit("/"))), F.substring(path, F.length(root) + 2, F.length(path)))


def cache_key(path: Column, mtime: Column, size: Column) -> Column:
    return F.concat_ws("|", path, F.format_string("%.6f", mtime), size.cast("string"))


def positive_number(text: Column) -> Column:
    """The number that a text states, null where it states none or a negative one."""
    value = F.trim(text).try_cast("double")
    return F.when((value >= 0) & (value < float("inf")), value)


def index_list(text: Column, n: Column) -> Column:
    """``1,3,4`` as an ascending array of indices up to ``n``; 0 stands for all, anything else is passed over."""
    numbers = F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("int"))
    every = F.filter(F.sequence(F.lit(0), n.cast("int")), lambda x: x > 0)
    chosen = F.array_sort(F.array_distinct(F.filter(numbers, lambda x: x.between(1, n))))
    return F.when(F.coalesce(F.exists(numbers, lambda x: F.coalesce(x == 0, F.lit(False))), F.lit(False)), every).otherwise(chosen)


def size_mb(size: Column) -> Column:
    return size / F.lit(1048576.0)


def age_days(mtime: Column, as_of: float) -> Column:
    return (F.lit(float(as_of)) - mtime) / F.lit(86400.0)


def size_label(size: Column) -> Column:
    """``512 B``, ``1.2 KB`` up to TB: divided by 1024 while at least that, ties to even."""
    label = F.format_string("%d B", size)
    units = ["KB", "MB", "GB", "TB"]
    for power, unit in enumerate(units, start=1):
        scaled = F.bround(size / F.lit(float(1024**power)), 1)
        label = F.when(size >= 1024**power, F.format_string("%.1f " + unit, scaled)).otherwise(label)
    return label


def glob_regex(pattern: str) -> str:
    """An anchored regular expression for a shell pattern of ``* ? [seq] [!seq]``."""
    out, i = [], 0
    while i < len(pattern):
        char = pattern[i]
        i += 1
        if char == "*":
            out.append(".*")
        elif char == "?":
            out.append(".")
        elif char == "[" and (end := pattern.find("]", i + 2 if pattern[i : i + 1] == "!" else i + 1)) > 0:
            inside = pattern[i:end].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
            if inside.startswith("!"):
                inside = "^" + inside[1:]
            elif inside.startswith("^"):
                inside = "\\" + inside
            out.append(f"[{inside}]")
            i = end + 1
        else:
            out.append(char if char.isalnum() or char == "_" else "\\" + char)
    return r"(?s)\A" + "".join(out) + r"\z"


def is_excluded(name: Column, patterns: list[str]) -> Column:
    """Whether any shell pattern fits the lower-cased name."""
    return F.lower(name).rlike("|".join(glob_regex(p.lower()) for p in patterns)) if patterns else F.lit(False)


def renamed(name: Column, rule: tuple) -> Column:
    """The new file name under ("remove", x), ("replace", x, y), ("prefix", x) or ("suffix", x).

    The rule works on the stem; a blank result keeps the old stem, and the suffix keeps its case.
    """
    old = stem(name)
    kind, args = rule[0], [F.lit(a) for a in rule[1:]]
    new = {
        "remove": lambda: F.replace(old, args[0], F.lit("")),
        "replace": lambda: F.replace(old, args[0], args[1]),
        "prefix": lambda: F.concat(args[0], old),
        "suffix": lambda: F.concat(old, args[0]),
    }[kind]()
    new = F.regexp_replace(F.regexp_replace(new, r"^\s+", ""), r"\s+$", "")
    return F.concat(F.when(new == "", old).otherwise(new), suffix(name))


def normalized_extensions(text: Column) -> Column:
    """``.jpg, png ,.GIF, , jpg`` to ``[.jpg, .png, .gif]``: distinct, in order of appearance."""
    parts = F.transform(F.split(text, ","), lambda x: F.lower(F.trim(x)))
    parts = F.filter(parts, lambda x: x != "")
    return F.array_distinct(F.transform(parts, lambda x: F.when(x.startswith("."), x).otherwise(F.concat(F.lit("."), x))))
