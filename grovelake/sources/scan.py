"""Reading files of a workspace: which paths count, and their bytes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# File extensions that are read, and folders that are never entered (besides hidden ones).
EXTENSIONS = [".md", ".markdown", ".html", ".htm", ".yaml", ".yml", ".json", ".jsonl", ".ndjson", ".toon"]
PRUNED = ["Pods", "__pycache__", "bower_components", "dist", "node_modules", "target", "vendor", "venv"]


def wanted_path(relative) -> Column:
    """A path with an extension that is read and no pruned or hidden folder on the way. Extensions count without case."""
    folders = F.slice(F.split(relative, "/"), F.lit(1), F.size(F.split(relative, "/")) - 1)
    pruned = F.exists(folders, lambda x: F.startswith(x, F.lit(".")) | x.isin(PRUNED))
    return F.lower(F.regexp_extract(relative, r"\.[^./]+$", 0)).isin(EXTENSIONS) & ~pruned


def ignore_rules(lines: list[str]) -> list[tuple[bool, bool, str]]:
    """(ignored, folders only, Java pattern) of each line of an ignore file.

    ``#`` begins a comment, ``!`` takes paths back in, ``\\`` before either is literal; a trailing ``/`` means folders
    only; ``[...]`` is one of some characters; a pattern without another ``/`` matches a name anywhere, otherwise it is anchored; ``**`` spans folders.
    """
    rules = []
    for raw in lines:
        s = raw.strip()
        if not s or s.startswith("#"):
            continue
        back = s.startswith("!")
        s = s[1:] if back or s[:2] in ("\\!", "\\#") else s
        folder, s = s.endswith("/"), s.rstrip("/")
        anchored = "/" in s
        parts = [p for p in s.split("/") if p]
        if not parts:
            raise ValueError(f"no pattern: {raw!r}")
        out = "" if anchored else "(?:.*/)?"
        for i, p in enumerate(parts):
            last = i == len(parts) - 1
            if p == "**":
                out += ".*" if last else "(?:.*/)?"
            else:
                out += _name_pattern(p) + ("" if last else "/")
        rules.append((not back, folder, out))
    return rules


def _name_pattern(name: str) -> str:
    """``*``, ``?`` and ``[...]`` (``!`` or ``^`` negates) within one name."""
    out = ""
    for piece in re.findall(r"\[[!^]?\]?[^\]]*\]|.", name, re.S):
        if piece == "*":
            out += "[^/]*"
        elif piece == "?":
            out += "[^/]"
        elif len(piece) > 2 and piece[0] == "[":
            negated = piece[1] in "!^"
            inner = re.sub(r"([\\\[\]&^])", r"\\\1", piece[2 if negated else 1 : -1])
            out += f"[{'^/' if negated else ''}{inner}]"
        else:
            out += re.escape(piece)
    return out


def ignored(relative, lines: list[str]) -> Column:
    """Is the path, or a folder on its way, ignored? The last rule that matches decides. Few rules, folded into one expression."""
    result = F.lit(False)
    for ignore, folder, pattern in ignore_rules(lines):
        hit = relative.rlike(f"^{pattern}/.*$") if folder else relative.rlike(f"^{pattern}(?:/.*)?$")
        result = F.when(hit, F.lit(ignore)).otherwise(result)
    return result


def scan_files(spark: SparkSession, root: str, ignore: list[str] | None = None, most_bytes: int | None = None) -> DataFrame:
    """(source_file, relative, modified_at, size, text, error) of the files below ``root``.

    Files larger than ``most_bytes`` are left out before their content is read. A file that is no UTF-8 has an error and
    no text.
    """
    root = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace("path", r"^file:/+", "/")
    below = F.substring(path, F.lit(len(root.removeprefix("file://")) + 2), F.length(path))
    if most_bytes is not None:
        files = files.where(F.col("length") <= most_bytes)
    rows = files.select(path.alias("source_file"), below.alias("relative"), F.col("modificationTime").alias("modified_at"), F.col("length").alias("size"), F.col("content"))
    rows = rows.where(wanted_path(F.col("relative")))
    if ignore:
        rows = rows.where(~ignored(F.col("relative"), ignore))
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    return rows.select("source_file", "relative", "modified_at", "size", text.alias("text"), F.when(text.isNull() & (F.col("size") > 0), "no UTF-8").alias("error"))


def deleted_paths(known: DataFrame, seen: DataFrame) -> DataFrame:
    """(source_file) that were known and are not seen any more."""
    return known.select("source_file").distinct().join(seen.select("source_file").distinct(), "source_file", "left_anti")


def changed_paths(known: DataFrame, seen: DataFrame, settle_seconds: int, now) -> DataFrame:
    """Files (source_file, modified_at) that are new or newer than known, and untouched for ``settle_seconds``."""
    old = known.groupBy("source_file").agg(F.max("modified_at").alias("_old"))
    quiet = F.col("modified_at") <= F.lit(now).cast(seen.schema["modified_at"].dataType) - F.make_dt_interval(secs=F.lit(settle_seconds))
    return seen.join(old, "source_file", "left").where((F.col("_old").isNull() | (F.col("modified_at") > F.col("_old"))) & quiet).drop("_old")


def json_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of an append-only JSON log; lines that do not parse are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def last_per_session(records: DataFrame) -> DataFrame:
    """The last record of each session_id of a ledger, by last_seen."""
    rest = [c for c in records.columns if c not in ("session_id", "last_seen")]
    return records.groupBy("session_id").agg(F.max(F.struct("last_seen", *rest)).alias("r")).select("session_id", "r.*")


def seed_temperatures(files: DataFrame, rules: dict[str, float]) -> DataFrame:
    """files (source_file) with the temperature of their rule: the exact path, else the ``folder/*`` rule nearest to it, else null."""
    for path, t in rules.items():
        if not 0 <= t <= 1:
            raise ValueError(f"{path}: {t} is not between 0 and 1")
    spark = files.sparkSession
    table = spark.createDataFrame([(k, float(v)) for k, v in rules.items()], "rule string, temperature double")
    parts = F.split("source_file", "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), F.size(parts) - i), "/"), F.lit("/*")))
    keys = files.select("source_file", F.posexplode(F.concat(F.array("source_file"), folders)).alias("far", "rule"))
    # the rules are a file written by hand
    near = keys.join(F.broadcast(table), "rule").groupBy("source_file").agg(F.min_by("temperature", "far").alias("temperature"))
    return files.join(near, "source_file", "left")
