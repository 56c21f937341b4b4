"""Files to typed node rows: Markdown, HTML, YAML, JSON, JSON lines and TOON.

The Python part only cuts a text into blocks; ids, labels, sizes and hashes of all blocks are columns.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.ids import content_hash, positional_id
from ..session import ship
from .mathml import math_to_latex

#: A map or list with this many entries becomes a node of its own.
PROMOTE = 5
#: A shorter form is kept if it saves this part of the bytes.
SAVING = 0.15
BLOCKS = "source_file string, node_id string, parent_id string, position int, depth int, node_type string, format string, content string, error string"

Block = tuple[int, str, str, str]  # level (headings: their level, other blocks: 0), type, format, content


def saves(plain: str, other: str) -> bool:
    """Does ``other`` save enough bytes?"""
    n = len(plain.encode())
    return n > 0 and (n - len(other.encode())) / n >= SAVING


# --- nested values -----------------------------------------------------------------------------------------------


def _scalar(v) -> str:
    return "null" if v is None else v if isinstance(v, str) else "true" if v is True else "false" if v is False else str(v)


def _lines(v, indent: str) -> list[str]:
    """Lines of a map or list, keys sorted."""
    pairs = [(f"{k}:", v[k]) for k in sorted(v)] if isinstance(v, dict) else [("-", x) for x in v]
    out = []
    for head, x in pairs:
        if isinstance(x, (dict, list)) and x:
            out.append(indent + head)
            out += _lines(x, indent + "  " if isinstance(x, dict) else indent)
        else:
            out.append(f"{indent}{head} " + ("{}" if x == {} and isinstance(x, dict) else "[]" if isinstance(x, list) else _scalar(x)))
    return out


def toon_list(key: str, items: list) -> str | None:
    """A list of scalars, or of maps with the same scalar fields, in the tabular form; None for other lists."""
    plain = lambda x: not isinstance(x, (dict, list))

    def cell(x) -> str:
        s = _scalar(x)
        quote = isinstance(x, str) and (s == "" or s != s.strip() or re.search(r'[,:"\\\n\t\[\]{}]', s) or s in ("true", "false", "null") or re.fullmatch(r"-?[\d.]+(?:e[+-]?\d+)?", s))
        return json.dumps(s, ensure_ascii=False) if quote else s

    if not items:
        return None
    if all(plain(x) for x in items):
        return f"{key}[{len(items)}]: " + ",".join(map(cell, items))
    first = items[0]
    if not isinstance(first, dict) or not all(isinstance(x, dict) and x.keys() == first.keys() and all(map(plain, x.values())) for x in items):
        return None
    names = sorted(first)
    return "\n".join([f"{key}[{len(items)}]{{{','.join(names)}}}:", *("  " + ",".join(cell(x[n]) for n in names) for x in items)])


def value_blocks(value, key: str = "", depth: int = 1) -> list[tuple[int, str, str, str]]:
    """(depth, type, format, content) of a value and its promoted parts, parents first."""
    if isinstance(value, dict):
        big = {k: v for k, v in value.items() if isinstance(v, (dict, list)) and len(v) >= PROMOTE}
        rest = {k: v for k, v in value.items() if k not in big}
        body = _lines(rest, "  " if key else "")
        out = [(depth, "kv", "plain", "\n".join([f"{key}:", *body] if key else body))]
        for k in sorted(big):
            out += value_blocks(big[k], k, depth + 1)
        return out
    if isinstance(value, list):
        plain = "\n".join([f"{key}:", *_lines(value, "")] if key and value else [f"{key}: []"] if key else _lines(value, ""))
        short = toon_list(key, value)
        return [(depth, "list", "toon", short)] if short and saves(plain, short) else [(depth, "list", "plain", plain)]
    return [(depth, "kv", "plain", f"{key}: {_scalar(value)}" if key else _scalar(value))]


def _toon_cells(line: str) -> list:
    out = []
    for m in re.finditer(r'\s*("(?:[^"\\]|\\.)*"|[^,]*)(?:,|$)', line):
        if m.start() == len(line) and out:
            break
        raw = m[1].strip()
        out.append(json.loads(raw) if raw.startswith('"') else {"true": True, "false": False, "null": None}.get(raw, raw))
    return out


def parse_toon(text: str):
    """A value of the indented form: keys, nested maps, inline lists, tables and dashed lists."""
    lines = [(len(x) - len(x.lstrip(" ")), x.strip()) for x in text.split("\n") if x.strip()]
    header = re.compile(r'^("(?:[^"\\]|\\.)*"|[^\[:]*)\[(\d+)[^\]]*\](?:\{([^}]*)\})?:\s*(.*)$')

    def block(i: int, indent: int):
        out, dashed = {}, []
        while i < len(lines) and lines[i][0] >= indent:
            at, line = lines[i]
            if line == "-" or line.startswith("- "):
                dashed.append(_toon_cells(line[2:])[0] if line[2:] else None)
                i += 1
                continue
            m = header.match(line)
            if m:
                key, fields, rest = m[1].strip().strip('"'), m[3], m[4]
                i += 1
                if fields is not None:
                    rows = []
                    while i < len(lines) and lines[i][0] > at:
                        rows.append(dict(zip([f.strip() for f in fields.split(",")], _toon_cells(lines[i][1]))))
                        i += 1
                    out[key] = rows
                elif rest or m[2] == "0":
                    out[key] = _toon_cells(rest) if rest else []
                else:
                    out[key], i = block(i, at + 1)
                continue
            key, colon, rest = line.partition(":")
            if not colon:
                raise ValueError(f"no key: {line[:60]}")
            i += 1
            if rest.strip():
                out[key.strip().strip('"')] = _toon_cells(rest.strip())[0] if rest.strip().startswith('"') else {"true": True, "false": False, "null": None}.get(rest.strip(), rest.strip())
            else:
                out[key.strip().strip('"')], i = block(i, at + 1) if i < len(lines) and lines[i][0] > at else ({}, i)
        return (dashed if dashed and not out else out), i

    value = block(0, 0)[0]
    return value[""] if isinstance(value, dict) and set(value) == {""} else value


def _yaml(text: str):
    import yaml  # optional: without it YAML files have an error

    def keys(v):
        if isinstance(v, dict):
            return {str(k): keys(x) for k, x in v.items()}
        return [keys(x) for x in v] if isinstance(v, list) else v

    return keys(yaml.load(text, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader)))


# --- Markdown ----------------------------------------------------------------------------------------------------

_FRONT = re.compile(r"\A(---|\+\+\+)\r?\n(.*?)\r?\n\1(?:\r?\n|\Z)", re.S)
_ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_FENCE = re.compile(r"^ {0,3}(```+|~~~+)[ \t]*([^`]*)$")
_LI = re.compile(r"^( *)(?:[-*+]|\d{1,9}[.)])[ \t]+(.*)$")
_HR = re.compile(r"^ {0,3}(?:(?:-[ \t]*){3,}|(?:\*[ \t]*){3,}|(?:_[ \t]*){3,})$")


def inline(s: str) -> str:
    """Inline text: emphasis and code marks dropped, images and links kept as written, a hard break is a line end."""
    s = re.sub(r"(?: {2,}|\\)\n", "\0", s)
    s = re.sub(r"\s*\n\s*", " ", s)
    s = re.sub(r"(\*\*|__)(?=\S)(.+?)(?<=\S)\1", r"\2", s)
    s = re.sub(r"(?<![\w*])([*_])(?=\S)(.+?)(?<=\S)\1(?![\w*])", r"\2", s)
    return re.sub(r"`([^`]+)`", r"\1", s).replace("\0", "\n").strip()


def markdown_blocks(text: str) -> list[Block]:
    """Blocks of a Markdown body."""
    lines, out, i = text.replace("\r\n", "\n").split("\n"), [], 0
    para: list[str] = []

    def flush():
        if para:
            body = inline("\n".join(para))
            if body:
                out.append((0, "text", "plain", body))
            para.clear()

    while i < len(lines):
        line = lines[i]
        fence, head, item = _FENCE.match(line), _ATX.match(line), _LI.match(line)
        if fence:
            flush()
            end = i + 1
            while end < len(lines) and not re.match(rf"^ {{0,3}}{re.escape(fence[1][0])}{{{len(fence[1])},}}[ \t]*$", lines[end]):
                end += 1
            code = "\n".join(x for x in [fence[2].strip(), "\n".join(lines[i + 1 : end])] if x).rstrip("\n")
            if code:
                out.append((0, "code", "plain", code))
            i = end + 1
        elif head:
            flush()
            out.append((len(head[1]), "heading", "plain", inline(head[2] or "")))
            i += 1
        elif para and re.match(r"^ {0,3}(=+|-+)[ \t]*$", line):
            level, body = (1 if "=" in line else 2), inline("\n".join(para))
            para.clear()
            out.append((level, "heading", "plain", body))
            i += 1
        elif _HR.match(line):
            flush()
            i += 1
        elif item:
            flush()
            items, base = [], len(item[1])
            while i < len(lines):
                m = _LI.match(lines[i])
                if m and len(m[1]) <= base + 1:
                    items.append(m[2])
                elif lines[i].strip() and (m or lines[i].startswith(" ") or items and not _ATX.match(lines[i]) and not _FENCE.match(lines[i]) and lines[i - 1].strip()):
                    items[-1] += "\n" + (m[2] if m else lines[i].strip())
                elif not lines[i].strip() and i + 1 < len(lines) and (_LI.match(lines[i + 1]) or lines[i + 1].startswith("  ")):
                    pass
                else:
                    break
                i += 1
            out.append((0, "list", "plain", "\n".join("- " + inline(x) for x in items)))
        elif "|" in line and i + 1 < len(lines) and re.match(r"^ *\|?(?: *:?-+:? *\|)+(?: *:?-+:? *)?\|? *$", lines[i + 1]):
            flush()
            rows = []
            while i < len(lines) and "|" in lines[i]:
                if not re.match(r"^ *\|?(?: *:?-+:? *\|)+(?: *:?-+:? *)?\|? *$", lines[i]):
                    rows.append("\t".join(inline(c) for c in re.split(r"(?<!\\)\|", lines[i].strip().strip("|"))))
                i += 1
            out.append((0, "table", "plain", "\n".join(rows)))
        elif not para and re.match(r"^ {0,3}<(?:[a-zA-Z!/])", line):
            block = []
            while i < len(lines) and lines[i].strip():
                block.append(lines[i])
                i += 1
            out.append((0, "text", "plain", "\n".join(block).strip()))
        else:
            if line.strip():
                para.append(line)
            else:
                flush()
            i += 1
    flush()
    return out


# --- HTML --------------------------------------------------------------------------------------------------------


class _HtmlBlocks(HTMLParser):
    """Blocks of an HTML text: text outside of block elements is dropped; open p, li, dt, dd, td and tr end where they must."""

    VOID = {"br", "img", "hr", "meta", "link", "input", "source", "embed", "wbr", "area", "base", "col", "track"}
    TEXT, LISTS = {"p", "blockquote", "figcaption"}, {"ul", "ol", "dl"}
    EMBEDS = {"img", "video", "audio", "iframe", "embed", "object"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[Block] = []
        self.skip: list[str] = []
        self.mode: str | None = None  # the element that is being collected
        self.buf: list[str] = []
        self.rows: list[list[str]] = []
        self.depth = 0
        self.items: list[tuple[int, list[str]]] = []
        self.raw: list[str] = []
        self.tree: list = []
        self.media: list | None = None

    def emit(self, kind: str, content: str, level: int = 0, fmt: str = "plain"):
        if content:
            self.out.append((level, kind, fmt, content))

    @staticmethod
    def squeeze(parts: list[str]) -> str:
        s = re.sub(r"[ \t\r\n\f]+", " ", "".join(parts))
        return re.sub(r" *\0 *", "\n", s).strip()

    def close_mode(self):
        mode, self.mode = self.mode, None
        if mode in ("svg", "canvas"):
            self.emit("code", "\n".join(x for x in [self.raw[0], "".join(self.raw[1:]).strip()] if x), fmt=mode)
        elif mode == "math":
            xml = "".join(self.raw)
            latex = math_to_latex(self.tree[0]) if self.tree else None
            fits = latex is not None and saves(xml, latex)
            self.emit("code", latex if fits else xml, fmt="latex" if fits else "mathml")
        elif mode == "pre":
            self.emit("code", "".join(self.buf).rstrip("\n").removeprefix("\n"))
        elif mode in self.LISTS:
            self.emit("list", "\n".join("\t" * d + "- " + t for d, p in self.items if (t := self.squeeze(p))))
        elif mode == "table":
            self.emit("table", "\n".join("\t".join(self.squeeze([c]) for c in r) for r in self.rows if any(c.strip() for c in r)))
        elif mode and re.fullmatch(r"h[1-6]", mode):
            self.emit("heading", self.squeeze(self.buf), int(mode[1]))
        elif mode in self.TEXT:
            self.emit("text", self.squeeze(self.buf))
        self.buf, self.rows, self.items, self.raw, self.tree, self.depth = [], [], [], [], [], 0

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if self.skip or tag in ("script", "style", "head"):
            if tag not in self.VOID:
                self.skip.append(tag)
            return
        if self.mode in ("svg", "canvas", "math"):
            self.depth += tag == self.mode
            self.raw.append(self.get_starttag_text())
            if self.mode == "math":
                node = (tag, a, [])
                self.tree[-1][2].append(node)
                self.tree.append(node)
            return
        if tag in self.EMBEDS and not (self.mode and self.media):
            if tag in self.VOID:
                self.embed(tag, a, a.get("src", ""))
            else:
                self.media = [tag, a, a.get("src") or a.get("data", "")]
            return
        if tag == "source" and self.media:
            self.media[2] = self.media[2] or a.get("src", "")
            return
        if tag == "knowledge":
            params = "".join(f";{p}={a[k]}" for k, p in (("weight", "w"), ("source", "source"), ("id", "id")) if a.get(k))
            self.add("[[")
            self.raw = [params]
            return
        if tag == "br":
            self.add("\0")
            return
        if self.mode in self.LISTS and tag in self.LISTS:
            self.depth += 1
            return
        if self.mode in self.LISTS and tag in ("li", "dt", "dd"):
            self.items.append((self.depth, []))
            return
        if self.mode == "table" and tag in ("tr", "td", "th", "table"):
            if tag == "tr":
                self.rows.append([])
            elif tag in ("td", "th"):
                if not self.rows:
                    self.rows.append([])
                self.rows[-1].append("")
            else:
                self.depth += 1
            return
        opens = tag in self.LISTS or tag in ("table", "pre", "svg", "canvas", "math") or tag in self.TEXT or re.fullmatch(r"h[1-6]", tag)
        if opens:
            if self.mode in self.TEXT or self.mode is None:
                if self.mode:
                    self.close_mode()
                self.mode = tag
                if tag in ("svg", "canvas"):
                    self.raw = [" ".join(f'{k}="{v}"' for k, v in a.items())]
                elif tag == "math":
                    self.raw, self.tree = [self.get_starttag_text()], [(tag, a, [])]

    def handle_startendtag(self, tag, attrs):
        if self.mode in ("svg", "canvas", "math"):
            self.raw.append(self.get_starttag_text())
            if self.mode == "math":
                self.tree[-1][2].append((tag, dict(attrs), []))
            return
        self.handle_starttag(tag, attrs)
        if tag not in self.VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.skip:
            if tag in self.skip:
                while self.skip.pop() != tag:
                    pass
            return
        if self.media and tag == self.media[0]:
            kind, a, src = self.media
            self.media = None
            self.embed(kind, a, src)
            return
        if tag == "knowledge":
            self.add("".join(self.raw) + "]]")
            self.raw = []
            return
        if self.mode in ("svg", "canvas", "math") and (tag != self.mode or self.depth):
            self.depth -= tag == self.mode
            self.raw.append(f"</{tag}>")
            if self.mode == "math" and len(self.tree) > 1:
                self.tree.pop()
            return
        if tag == self.mode:
            if self.depth:
                self.depth -= 1
                return
            if tag == "math":
                self.raw.append("</math>")
            self.close_mode()
        elif self.mode in self.LISTS and tag in self.LISTS and self.depth:
            self.depth -= 1

    def embed(self, tag, a, src):
        if not src:
            return
        alt = a.get("alt") or a.get("title") or ""
        kind = {"img": "image", "object": "embed"}.get(tag, tag)
        if self.mode and self.mode != "pre":
            self.add(f"![{alt}]({src})" if kind == "image" else f"[{alt}]({src})")
        else:
            self.emit("embed", f"![{alt}]({src})" if kind == "image" else f"[{alt}]({src})", fmt=kind)

    def add(self, s: str):
        if self.mode in self.LISTS:
            if self.items:
                self.items[-1][1].append(s)
        elif self.mode == "table":
            if self.rows and self.rows[-1]:
                self.rows[-1][-1] += s
        elif self.mode:
            self.buf.append(s)

    def handle_data(self, data):
        if self.skip or self.media:
            return
        if self.mode in ("svg", "canvas", "math"):
            self.raw.append(data)
            if self.mode == "math" and data.strip():
                self.tree[-1][2].append(data.strip())
        else:
            self.add(data)


def html_blocks(text: str) -> list[Block]:
    """Blocks of an HTML text."""
    p = _HtmlBlocks()
    p.feed(text)
    p.close()
    p.close_mode()
    return p.out


# --- rows --------------------------------------------------------------------------------------------------------


def file_blocks(path: str, text: str) -> list[tuple[int, str, str, str]]:
    """(depth, type, format, content) of a file, parents before their children. Raises ValueError where it does not parse."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind in ("json", "jsonl", "ndjson"):
        if kind == "json":
            value = json.JSONDecoder().raw_decode(text.lstrip())[0] if text.strip() else None
        else:
            value = [json.loads(line) for line in text.split("\n") if line.strip()]
        return [] if value is None else value_blocks(value)
    if kind in ("yaml", "yml"):
        value = _yaml(text)
        return [] if value is None else value_blocks(value)
    if kind == "toon":
        return value_blocks(parse_toon(text)) if text.strip() else []
    out: list[tuple[int, str, str, str]] = []
    if kind in ("html", "htm"):
        blocks = html_blocks(text)
    else:
        front = _FRONT.match(text)
        if front:
            if front[1] == "+++":
                out = [(1, "preamble", "plain", front[2].strip())]
            else:
                value = _yaml(front[2])
                out = [] if value is None else [(d, "preamble" if i == 0 else t, f, c) for i, (d, t, f, c) in enumerate(value_blocks(value))]
            text = text[front.end() :]
        blocks = markdown_blocks(text)
    open_: list[int] = []  # levels of the headings a block is under
    for level, kind_, fmt, content in blocks:
        if kind_ == "heading":
            while open_ and open_[-1] >= level:
                open_.pop()
            out.append((len(open_) + 1, kind_, fmt, content))
            open_.append(level)
        else:
            out.append((len(open_) + 1, kind_, fmt, content))
    return out


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for path, text in zip(b["source_file"], b["text"]):
            if text is None:
                continue
            try:
                blocks = file_blocks(path, text)
            except (ValueError, ImportError, RecursionError) as e:
                out.append((path, None, None, None, None, None, None, None, f"{type(e).__name__}: {str(e)[:200]}"))
                continue
            except Exception as e:  # the YAML library's errors are of its own kind
                out.append((path, None, None, None, None, None, None, None, f"{type(e).__name__}: {str(e)[:200]}"))
                continue
            # the ids of the nodes above; how many children each has had
            above: list[str] = []
            counts = [0]
            for depth, kind, fmt, content in blocks:
                del above[depth - 1 :], counts[depth:]
                parent = above[-1] if above else ""
                node = positional_id(path, parent, counts[-1])
                out.append((path, node, parent or None, counts[-1], depth, kind, fmt, content, None))
                counts[-1] += 1
                above.append(node)
                counts.append(0)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in BLOCKS.split(", ")]).astype({"position": "Int32", "depth": "Int32"})


def parse_files(files: DataFrame) -> DataFrame:
    """Node rows of files (source_file, text): id, parent, position among siblings, depth, type, format, content, label, tokens, hash.

    Contents are in normal form before they are hashed. A file that does not parse has one row with ``error`` and no
    node; a null text has none, an empty one has no nodes. Ids depend on source, parent and position, not on content.
    """
    ship(files.sparkSession)
    blocks = files.select("source_file", "text").mapInPandas(_rows, BLOCKS)
    blocks = blocks.withColumn("content", T.normalize_text(F.col("content")))
    return blocks.select(
        "source_file", "node_id", "parent_id", "position", "depth", "node_type", "format", T.node_label(F.col("node_type"), F.col("content"), F.col("format")).alias("label"),
        "content", T.token_estimate(F.col("content")).alias("token_count"), content_hash(F.col("content")).alias("content_hash"), "error",
    )
