"""Sentences and items of a note: what is left without front matter, headings, code and encoded blocks."""

from __future__ import annotations

import html
import json
import re
import unicodedata
from html.parser import HTMLParser

_BREAKS = re.compile(r"\r\n?|[\x0b\x0c\x85  ]")
_INVISIBLE = re.compile(r"[​-‏⁠﻿­]")
_FRONT = re.compile(r"\A\s*(---|\+\+\+)[ \t]*\n.*?\n(?:\1|\.\.\.)[ \t]*(?:\n|\Z)", re.S)
_FENCE = re.compile(r"^[ \t]*(```+|~~~+).*?(?:^[ \t]*\1[`~]*[ \t]*$|\Z)", re.S | re.M)
_ENCODED = re.compile(r"(?:data:[\w/+.;=-]+,)?(?:[A-Za-z0-9+/_-]{40,}={0,2}|(?:[0-9a-fA-F]{2}[ :]?){20,})")
# the same in three passes, which is several times as fast within running text
_DATA_URL = re.compile(r"data:[\w/+.;=-]+,[A-Za-z0-9+/_-]{40,}={0,2}")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}")
_PAIRS = re.compile(r"[0-9a-fA-F]{2}[ :]?[0-9a-fA-F]{2}[ :]?(?:[0-9a-fA-F]{2}[ :]?){18,}")
_RULE = re.compile(r"^\s*(?:[-*_=]\s*){3,}$")
_HEADING = re.compile(r"^\s{0,3}#{1,6}\s")
_ITEM = re.compile(r"^\s*(?:[-*+•–]|\d{1,3}[.)])\s+(?:\[[ xX]\]\s+)?")
_LINKS_ONLY = re.compile(r"^(?:[^\[\]]{0,12})\[\[[^\]]*\]\](?:[^\[\]]{0,8}\[\[[^\]]*\]\])*[\s.]*$")
_SENTENCE = re.compile(r"(?<=[.!?…。！？])[\"'”»’)\]]*\s+(?=\S)")
_KEY = re.compile(r"^\s*(?:-\s+)?([\w-]+):\s*(.*)$")
_LETTERS = re.compile(r"[^\W\d_]")
# Names under which structured notes keep running text.
TEXT_KEYS = {"text", "content", "note", "notes", "body", "message", "entries", "items", "messages", "summary", "value"}


def clean(text: str) -> str:
    """One form of line ends, letters and spaces; invisible characters are dropped."""
    return _INVISIBLE.sub("", unicodedata.normalize("NFKC", _BREAKS.sub("\n", text)))


def _without_encoded(text: str) -> str:
    if "data:" in text:
        text = _DATA_URL.sub(" ", text)
    return _PAIRS.sub(" ", _RUN.sub(" ", text))


def _keep(unit: str) -> bool:
    return bool(_LETTERS.search(unit)) and not _LINKS_ONLY.match(unit)


def _sentences(paragraph: str) -> list[str]:
    return [s.strip() for s in _SENTENCE.split(_without_encoded(paragraph)) if _keep(s)]


def _prose(text: str) -> tuple[list[str], list[str]]:
    """(units, headings) of Markdown or plain text."""
    units, heads, paragraph = [], [], []
    lines = _FENCE.sub("\n", _FRONT.sub("", text)).split("\n")
    for line in [*lines, ""]:
        item = _ITEM.match(line)
        plain = not (item or not line.strip() or _HEADING.match(line) or _RULE.match(line) or _ENCODED.fullmatch(line.strip()))
        if plain:
            paragraph.append(line)
            continue
        if paragraph:
            units += _sentences(" ".join(paragraph))
            paragraph = []
        if _HEADING.match(line):
            heads.append(line.strip().strip("#").strip())
        elif item and not _RULE.match(line):
            rest = _without_encoded(line[item.end() :]).strip()
            if _keep(rest):
                units.append(rest)
    return units, heads


class _Html(HTMLParser):
    """Text of block elements; headings apart; code, scripts and styles left out."""

    SKIP = {"pre", "code", "script", "style", "head", "svg", "math"}
    BLOCKS = {"p", "li", "td", "th", "dd", "dt", "blockquote", "figcaption", "div", "section", "article", "br", "tr", "ul", "ol"}
    HEADS = {"h1", "h2", "h3", "h4", "h5", "h6", "title"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.heads, self.part, self.skip, self.head = [], [], [], 0, False

    def flush(self):
        text = " ".join("".join(self.part).split())
        if text:
            (self.heads if self.head else self.blocks).append(text)
        self.part = []

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIP:
            self.skip += 1
        elif tag in self.BLOCKS or tag in self.HEADS:
            self.flush()
            self.head = tag in self.HEADS

    def handle_endtag(self, tag):
        if tag in self.SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag in self.BLOCKS or tag in self.HEADS:
            self.flush()
            self.head = False

    def handle_data(self, data):
        if not self.skip:
            self.part.append(data)


def _html(text: str) -> tuple[list[str], list[str]]:
    p = _Html()
    p.feed(text)
    p.close()
    p.flush()
    return [s for b in p.blocks for s in _sentences(b)], p.heads


def _leaves(value, key: str | None, in_list: bool):
    if isinstance(value, dict):
        for k, v in value.items():
            yield from _leaves(v, k, False)
    elif isinstance(value, list):
        for v in value:
            yield from _leaves(v, key, True)
    elif isinstance(value, str) and (in_list or (key or "").lower() in TEXT_KEYS or len(value.split()) > 3):
        yield value


_DECODER = json.JSONDecoder()


def _json(text: str, by_line: bool) -> tuple[list[str], list[str]]:
    units, heads = [], []
    for chunk in text.split("\n") if by_line else [text]:
        chunk = chunk.strip()
        if not chunk:
            continue
        try:
            value, end = _DECODER.raw_decode(chunk)
        except (ValueError, RecursionError):
            value, end = None, 0
        for leaf in _leaves(value, None, False):
            units += _sentences(" ".join(leaf.split("\n")))
        rest = chunk[end:]
        quoted = [] if end else re.findall(r'"((?:[^"\\\n]|\\.)*)"(?!\s*:)', rest)
        if quoted:  # cut short or otherwise broken: its quoted texts
            units += [s for q in quoted if len(q.split()) > 2 for s in _sentences(q.replace("\\n", " ").replace('\\"', '"'))]
        elif rest.strip():  # what follows the value
            units += _prose(rest)[0]
    return units, heads


def _yaml(text: str) -> tuple[list[str], list[str]]:
    units = []
    for line in text.split("\n"):
        m = _KEY.match(line)
        if m:
            key, value = m[1].lower(), m[2]
        else:
            item = _ITEM.match(line)
            key, value = ("items", line[item.end() :]) if item else ("", line.strip())
        value = value.strip()
        if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'":
            value = value[1:-1]
        if value and (key in TEXT_KEYS or len(value.split()) > 3 or not m and value):
            units += _sentences(value)
    return units, []


def _toon(text: str) -> tuple[list[str], list[str]]:
    units = []
    for line in text.split("\n"):
        if re.match(r"^\s*[\w.-]*\[\d+[^\]]*\](?:\{[^}]*\})?:\s*$", line):
            continue
        quoted = re.findall(r'"((?:[^"\\]|\\.)*)"', line)
        if quoted:
            for q in quoted:
                units += _sentences(q.replace('\\"', '"').replace("\\n", " "))
        else:
            m = _KEY.match(line)
            value = m[2] if m else line.split(",", 1)[-1]
            if value.strip() and (not m or m[1].lower() in TEXT_KEYS or len(value.split()) > 3):
                units += _sentences(value.strip())
    return units, []


def text_units(text: str | None, doc_format: str | None = "txt") -> tuple[list[str], list[str]]:
    """(sentences and items, headings) of a note. Null, empty and blank texts have none.

    A line of links alone is navigation, no sentence. A note that does not parse in its format is read by its lines.
    """
    if not text or not text.strip():
        return [], []
    text, kind = clean(text), (doc_format or "txt").strip().lower()
    if kind == "html":
        return _html(text)
    if kind in ("json", "jsonl", "ndjson"):
        return _json(_FRONT.sub("", text), kind != "json")
    if kind in ("yaml", "yml"):
        return _yaml(_FENCE.sub("\n", text))
    if kind == "toon":
        return _toon(text)
    return _prose(text)
