"""Text functions as Spark columns: size estimates, normal form, wiki-links, labels, display forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A text of so many bytes counts as one token in budgets.
BYTES_PER_TOKEN = 4
#: Labels are cut to this many bytes.
LABEL_BYTES = 80


def token_estimate(content) -> Column:
    """Bytes / 4, rounded up; 0 for null and empty."""
    return F.ceil(F.coalesce(F.octet_length(content), F.lit(0)) * F.lit(1.0 / BYTES_PER_TOKEN)).cast("int")


def normalize_text(content) -> Column:
    """Line feeds only, no spaces or tabs at line ends, at most one empty line in a row, none at the edges."""
    t = F.regexp_replace(content, r"\r\n?", "\n")
    t = F.regexp_replace(t, r"[ \t]+(\n|\z)", "$1")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return F.regexp_replace(t, r"\A\n+|\n+\z", "")


def wiki_links(content) -> Column:
    """The inner texts of ``[[...]]``."""
    return F.regexp_extract_all(content, F.lit(r"\[\[([^\[\]]+)\]\]"), F.lit(1))


def link_parts(inner) -> Column:
    """struct(label, weight, source, id_hint) of a link's inner text.

    ``w``, ``source`` and ``id`` are read only where some segment after ``;`` is an assignment, otherwise the whole is
    the label. A label of eleven base-62 characters is an id hint. A weight that is no number is 1.
    """
    has = inner.rlike(r";\s*\w+\s*=")
    value = lambda key: F.nullif(F.trim(F.regexp_extract(inner, rf";\s*{key}\s*=\s*([^;]*)", 1)), F.lit(""))
    label = F.trim(F.when(has, F.regexp_extract(inner, r"^([^;]*)", 1)).otherwise(inner))
    hint = F.coalesce(F.when(has, value("id")), F.when(label.rlike(r"^[0-9A-Za-z]{11}$"), label))
    weight = F.coalesce(F.when(has, value("w").try_cast("double")), F.lit(1.0))
    return F.struct(label.alias("label"), weight.alias("weight"), F.when(has, value("source")).alias("source"), hint.alias("id_hint"))


def first_sentence(content) -> Column:
    """Up to the first ``.``, ``!`` or ``?`` that a space, a line end or the end follows; the whole text without one."""
    found = F.regexp_extract(content, r"(?s)^(.*?[.!?])(?=[ \n]|\z)", 1)
    return F.when(found == "", content).otherwise(found)


def first_line(content) -> Column:
    return F.regexp_extract(content, r"^([^\n]*)", 1)


def truncate_label(text, limit: int = LABEL_BYTES) -> Column:
    """At most ``limit`` bytes, ``...`` included, never within a character: the longest prefix of characters that fits."""
    room = limit - 3
    # a character has one to four bytes, so the prefix has between room / 4 and room characters
    fits = F.filter(F.sequence(F.lit(room // 4), F.lit(room)), lambda n: F.octet_length(F.substring(text, F.lit(1), n)) <= room)
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.concat(F.substring(text, F.lit(1), F.array_max(fits)), F.lit("...")))


def top_keys(content, most: int = 0) -> Column:
    """The names before ``:`` of the lines that are not indented; the first ``most`` of them, all for 0."""
    keyed = F.filter(F.split(content, "\n"), lambda line: line.rlike(r"^[^ \t:][^:]*:"))
    keys = F.transform(keyed, lambda line: F.regexp_extract(line, r"^([^:]*):", 1))
    return F.slice(keys, 1, most) if most else keys


def node_label(node_type, content, fmt=None) -> Column:
    """The label of a node by its type.

    A heading's text; of a list how many items and the first; of a table its columns and rows; of code its language and
    first line; of key-value text its first three keys; of a preamble all of them; of an embed its kind with the
    alternative text or the address; else the first sentence. At most ``LABEL_BYTES`` bytes.
    """
    fmt = F.lit("plain") if fmt is None else fmt
    lines = F.split(content, "\n")
    items = F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: F.startswith(x, F.lit("- ")))
    listed = F.concat(F.size(items).cast("string"), F.lit("-item list: "), F.regexp_replace(F.get(items, 0), r"^- ", ""))
    list_label = F.when((fmt == "toon") & F.contains(content, F.lit(":")), F.regexp_extract(content, r"^([^:]*):", 1)).when(F.size(items) > 0, listed).otherwise(content)
    rows = (F.size(lines) - 1).cast("string")
    table = F.concat(F.lit("Table: "), F.regexp_replace(F.get(lines, 0), "\t", ", "), F.lit(" ("), rows, F.lit(" rows)"))
    first = F.trim(F.get(lines, 0))
    is_language = (first != "") & (F.octet_length(first) < LABEL_BYTES) & ~F.contains(first, F.lit(" ")) & (F.size(lines) > 1)
    code = F.when(is_language, F.concat(F.lit("Code ("), first, F.lit("): "), F.trim(F.get(lines, 1)))).otherwise(F.concat(F.lit("Code: "), first))
    keys = top_keys(content, 3)
    kv = F.when(F.size(keys) > 0, F.array_join(keys, ", ")).otherwise(content)
    front = F.when(F.size(top_keys(content)) > 0, F.concat(F.lit("Preamble: "), F.array_join(top_keys(content), ", "))).otherwise("Preamble")
    kind = F.when(F.coalesce(fmt, F.lit("")) == "", "embed").otherwise(fmt)
    alt = F.regexp_extract(content, r"^!?\[?([^\]]*)\]", 1)
    shown = F.when(alt != "", alt).otherwise(F.regexp_extract(content, r"\]\(?([^)]*)\)", 1))
    title = F.concat(F.upper(F.substring(kind, 1, 1)), F.substring(kind, F.lit(2), F.length(kind)))
    embed = F.when(shown != "", F.concat(title, F.lit(": "), shown)).otherwise(title)
    by_type = (
        F.when(node_type == "list", list_label)
        .when(node_type == "table", table)
        .when(node_type == "code", code)
        .when(node_type == "kv", kv)
        .when(node_type == "preamble", front)
        .when(node_type == "embed", embed)
        .when(node_type == "text", first_sentence(content))
        .otherwise(content)
    )
    return truncate_label(by_type)


def human_bytes(n) -> Column:
    """1 KB = 1024 bytes; one decimal from KB on."""
    return (
        F.when(n < 1024, F.format_string("%d B", n.cast("long")))
        .when(n < 1024**2, F.format_string("%.1f KB", n / 1024.0))
        .when(n < 1024**3, F.format_string("%.1f MB", n / float(1024**2)))
        .otherwise(F.format_string("%.1f GB", n / float(1024**3)))
    )


def human_age(seconds) -> Column:
    """Whole seconds, minutes, hours or days."""
    s = F.greatest(seconds.cast("long"), F.lit(0))
    return (
        F.when(s < 60, F.concat(s, F.lit("s")))
        .when(s < 3600, F.concat(F.floor(s / 60), F.lit("m")))
        .when(s < 86400, F.concat(F.floor(s / 3600), F.lit("h")))
        .otherwise(F.concat(F.floor(s / 86400), F.lit("d")))
    )


def slug(text, most: int = 40) -> Column:
    """Lower-case letters and digits with single dashes, at most ``most`` characters."""
    s = F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-")
    return F.regexp_replace(F.substring(F.regexp_replace(s, r"^-+|-+$", ""), 1, most), r"-+$", "")


def strip_root(path, root) -> Column:
    """A path below ``root`` without it; other paths as they are."""
    below = F.concat(F.regexp_replace(root, r"/+$", ""), F.lit("/"))
    return F.when((root != "") & F.startswith(path, below), F.substring(path, F.length(below) + 1, F.length(path))).otherwise(path)


def common_folder(files: DataFrame, column: str) -> str:
    """The longest folder that all paths share, ``""`` if none: what the least and the greatest list of folders share (one row)."""
    steps = F.split(column, "/")
    folders = F.slice(steps, F.lit(1), F.size(steps) - 1)
    ends = files.where(F.col(column).isNotNull()).agg(F.min(folders), F.max(folders)).first()
    shared = []
    for a, b in zip(ends[0] or [], ends[1] or []):
        if a != b:
            break
        shared.append(a)
    return "/".join(shared)


def short_hash(column, most: int = 8) -> Column:
    return F.substring(column, 1, most)


def pad(column, width: int) -> Column:
    """Text filled up with spaces to ``width`` characters; longer ones stay whole, null is empty."""
    text = F.coalesce(column, F.lit(""))
    return F.rpad(text, F.greatest(F.lit(width), F.length(text)), F.lit(" "))


def heat_color(temperature) -> Column:
    """``#rrggbb`` from cold blue over white to hot red."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), temperature))
    red = F.when(t < 0.5, F.floor(t * 2 * 255)).otherwise(255)
    blue = F.when(t < 0.5, 255).otherwise(F.floor((1 - t) * 2 * 255))
    green = F.when(t < 0.5, F.floor(t * 2 * 255)).otherwise(F.floor((1 - t) * 2 * 255))
    return F.format_string("#%02x%02x%02x", red.cast("int"), green.cast("int"), blue.cast("int"))
