"""Literal credentials in texts: one automaton of formats, armor and connection strings, chunked scans, spliced placeholders."""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..durable import Scratch
from ..functions.redaction import PATTERNS
from ..session import ship
from ..tables import exact
from .automaton import Automaton, heads, parse

#: Texts longer than a chunk are scanned in overlapping chunks that several tasks share.
CHUNK_CHARS = 262_144
#: Overlap of two chunks: what is seen on either side of an anchor; one that needs more is read again in its whole text.
OVERLAP_CHARS = 4_096

#: Kinds of ``redaction.PATTERNS`` that are no bare tokens: connection strings, headers, armor and assignments have grammars of their own here.
CONTEXTS = {"db_connection_string", "bearer_auth_header", "basic_auth_url", "private_key_block", "env_secret_assignment"}
# Own additions, of vendors that redaction.PATTERNS does not name.
MORE_FORMATS = {"slack_app_token": r"xapp-[A-Za-z0-9-]{10}", "digitalocean_token": r"dop_v1_[a-f0-9]{40}"}
# Own looser lengths: shorter tokens of these vendors are as secret, and test data and older keys have them.
SHORTER_FORMATS = {
    "openai_api_key": r"sk-[A-Za-z0-9][A-Za-z0-9_-]{18}",
    "github_fine_grained_pat": r"github_pat_[A-Za-z0-9_]{30}",
    "pypi_token": r"pypi-[A-Za-z0-9_-]{50}",
    "stripe_secret_key": r"(?:sk|rk)_(?:live|test)_[0-9a-zA-Z]{16}",
}


def _open_ended(pattern: str) -> str:
    """The pattern with its counts as lower bounds: a token is blanked out to its end, however long it is."""
    return re.sub(r"\{(\d+)(?:,\d+)?\}", r"{\1,}", pattern)


def token_formats() -> dict[str, list[str]]:
    """Patterns of bare tokens by kind: those of ``redaction.PATTERNS`` with open ends, and the own additions."""
    formats = {kind: [_open_ended(p)] for kind, p in PATTERNS.items() if kind not in CONTEXTS}
    for kind, p in [*MORE_FORMATS.items(), *SHORTER_FORMATS.items()]:
        formats.setdefault(kind, []).append(_open_ended(p))
    return formats


# the parts of the automaton that are no token formats
ARMOR = r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----"
CONNECTION = r"""(?:://|:\\/\\/|:\\//|:/\\/)[^\s:@/"'`\\<>]*:[^\s@/"'`<>\\]+(?:\\u0040[^\s@/"'`<>\\]+)*(?:@|\\u0040)"""

# Last words of the names under which credentials are kept; "key" counts after one of KEY_KINDS only.
SECRET_WORDS = ["password", "passwd", "passphrase", "passcode", "pwd", "pass", "pw", "pgpassword", "secret", "token", "auth", "credential", "credentials", "apikey", "accesskey", "secretkey", "authtoken"]
KEY_KINDS = ["api", "access", "secret", "private", "signing", "webhook", "auth", "encryption", "service", "master", "account", "shared", "client", "app", "deploy", "license", "hmac", "session", "admin", "storage", "subscription"]
# Words that stand for "no value" or for another kind of value.
NO_VALUES = ["true", "false", "null", "none", "nil", "undefined", "yes", "no", "on", "off", "string", "str", "bearer", "basic", "digest", "oauth", "required", "optional", "enabled", "disabled", "env", "vault", "prompt", "ask", "auto", "default", "redacted", "masked", "hidden", "removed", "changed", "rotated", "tbd", "todo", "n/a", "na", "example", "placeholder", "dummy"]
PLACEHOLDER = re.compile(r"(?i)^(?:your[_-]?|my[_-]?|insert|replace|put|enter|add|paste|change[_-]?this|to[_-]?be)[\w-]*(?:here|key|token|secret|password|me|this)|^(?:redacted|masked|hidden|removed|example|placeholder)\b|<[^<>]*>|^\[[^\]]*\]$|«|»")
REFERENCE = re.compile(r"(?i)^%[-+.0-9]*[a-z]$|^\{[\w.]*\}$|\$\{|\$\(|\{\{|^%\w+%$|^\$\w|^%\(|^(?:op|vault|ssm|secret|secrets|env|ref|kms|file|keyring|aws-sm|gcp-sm|azurekeyvault)[:+]|^arn:|^projects/[^/]+/secrets/|^!\w|^@\w+\.|^(?:os\.|process\.env|ENV\[|getenv|System\.|config\.|settings\.|self\.|this\.|secrets?\.|vars?\.|env\.)")
# the last name in a run of its letters: it begins with a letter
_LAST_NAME = re.compile(r"[A-Za-z][A-Za-z0-9]*(?:[_.-][A-Za-z0-9]+)*\Z", re.ASCII)
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_MASKED = re.compile(r"^(?:(.)\1{3,}|[x*•.#_-]+)$", re.IGNORECASE)
# the value of an assignment: separator, then a quoted or a bare text
_SEPARATOR = re.compile(r"\\?[\"'`]?[ \t]*(?:\r?\n[ \t]*)?(?::=|=>|==?|:)[ \t]*(?:dict\(|str\()?", re.ASCII)
_OPEN = re.compile(r"\\*[\"'`]", re.ASCII)
_BARE = re.compile(r"[^\s\"'`,;)}\]&<>\\]+", re.ASCII)
_AFTER_NAME = re.compile(r"[A-Za-z0-9]*", re.ASCII)
# what may follow an anchor within a name that ends in a word for a credential (a longer word is an anchor of its own)
_NAME_END = re.compile(r"(?:s|id)?\d*", re.ASCII | re.IGNORECASE)
_ARMOR_EDGE = re.compile(r"-----(?:BEGIN |END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----)")
# what is left of a key that was cut: header lines and lines of base64, the last one of any length
_ARMOR_BODY = re.compile(r"(?:(?:\\[rn]|\s)+[A-Za-z][A-Za-z-]*: [^\\\n]*)*(?:(?:\\[rn]|\s)+[A-Za-z0-9+/=]{16,})+(?:(?:\\r)?(?:\\n|\n)[A-Za-z0-9+/=]{1,15}(?=\\[rn]|[\n\r\"'`]|\Z))?", re.ASCII)
_SCHEME_TOKEN = re.compile(r"[ \t]+([A-Za-z0-9._~+/=-]{8,})", re.ASCII)
_LOGIN_OPTION = re.compile(r"(?:-u|--user|--proxy-user)(?:[ \t]+|=)[\"']?([^\s:\"'$<>]+):([^\s\"']+)", re.ASCII)
_SPOKEN = re.compile(r"[ \t]+(?:is|was|of|to|ist|war|es|est)[ \t]*:?[ \t]+[\"'`]?([^\s\"'`,;]+)", re.ASCII)
_NETRC = re.compile(r"[ \t]+\S+[ \t]+password[ \t]+([^\s\"']+)", re.ASCII)
_SQL = re.compile(r"(?i)(?:[ \t]+(?:by|as))?[ \t]+'([^'\n]*)'", re.ASCII)

# anchors: words (lower case) at which a grammar reads on; the automaton's patterns bring their own heads
_NAME_ANCHORS = ["password", "passwd", "passphrase", "passcode", "pwd", "pass", "pw", "secret", "token", "auth", "credential", "key"]
ANCHORS: list[tuple[str, str]] = (
    [(a, "name") for a in _NAME_ANCHORS]
    + [("bearer", "scheme"), ("basic", "basic"), ("-u", "login"), ("--user", "login"), ("--proxy-user", "login"), ("identified by", "sql"), ("login", "netrc")]
)
#: Patterns without a fixed head of so many letters are tried at each word that begins as they do, capitals told apart.
LEAST_HEAD = 3
_NAME_LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_.-")
_ALNUM = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")


class Unfinished(Exception):
    """What a grammar reads goes on beyond the chunk."""


def _looks_random(v: str) -> bool:
    """Digits, mixed case within the word, or symbols: no plain word or path."""
    return bool(re.search(r"\d", v)) or bool(re.search(r"[a-z][A-Z]|[A-Z]{2}[a-z]", v)) or bool(re.search(r"[!@#%^*+?]", v))


def is_secret_name(name: str) -> bool:
    """Does a name (snake, kebab or camel case) end in a word for a credential?"""
    words = [w.lower() for w in _WORDS.findall(name)]
    while words and words[-1].isdigit():
        words.pop()
    if not words:
        return False
    last = words[-1]
    if last in ("key", "keys"):
        return len(words) > 1 and words[-2] in KEY_KINDS
    if last == "id" and len(words) > 2 and words[-2] == "key":
        return words[-3] in ("access", "secret")
    return last in SECRET_WORDS or any(last == k + "key" for k in KEY_KINDS)


def is_literal(value: str, name: str, quoted: bool) -> bool:
    """Is this the credential itself, no variable, reference, placeholder, masked or empty value?"""
    v = value.strip()
    if not v or v != value or v.lower() in NO_VALUES or _MASKED.match(v) or REFERENCE.search(v) or PLACEHOLDER.search(v):
        return False
    if v.startswith("$") or v.startswith("-----BEGIN"):
        return False
    words = [w.lower() for w in _WORDS.findall(name)]
    vague = bool(words) and words[-1] in ("auth", "credential", "credentials", "secret", "token", "key", "pass", "pw")
    # left out on purpose: plain words and phrases beside a vague name ("auth": "basic", token: refresh)
    if quoted:
        if vague and (" " in v or not (_looks_random(v) or len(v) >= 20)):
            return False
        return len(v) >= 3 or words[-1:] == ["password"]
    if re.search(r"[(\[{|]", v) or is_secret_name(v) and not re.search(r"\d", v):
        return False  # code: a call, an index, another variable
    if vague and not _looks_random(v):
        return False
    if v.isdigit() and (vague or len(v) < 4):
        return False
    if "/" in v and vague and re.fullmatch(r"[a-z0-9_-]+(?:/[a-z0-9_-]+)+", v):
        return False  # a path in a secret store
    return len(v) >= 3


def _is_login(encoded: str) -> bool:
    """Base64 of ``user:password``?"""
    try:
        plain = base64.b64decode(encoded + "=" * (-len(encoded) % 4), validate=True).decode("utf-8")
    except (binascii.Error, ValueError):
        return False
    user, colon, secret = plain.partition(":")
    return bool(colon and secret) and plain.isprintable() and not REFERENCE.search(secret) and not _MASKED.match(secret)


class Scanner:
    """The automaton of all token formats, key armor and connection strings, and the grammars that read named values.

    One Aho-Corasick pass finds the heads of the automaton's patterns and the words for names; from a head the automaton
    walks on, from a word its grammar. Nothing that is read has a greatest length. In a chunk of a longer text
    (``whole`` false) an anchor whose reading reaches an edge of the chunk is unfinished.
    """

    def __init__(self):
        import ahocorasick

        formats = [(kind, p) for kind, ps in token_formats().items() for p in ps]
        self.machine = Automaton([*formats, ("private_key", ARMOR), ("connection_string", CONNECTION)])
        anchors: dict[str, set[str]] = {}
        self.headless = []
        for _, p in [*formats, ("", ARMOR), ("", CONNECTION)]:
            starts = {h.lower() for h, _ in heads(parse(p)[0])}
            if min(map(len, starts)) < LEAST_HEAD:
                self.headless.append(re.compile("(?<![A-Za-z0-9])(?:" + "|".join(map(re.escape, sorted(h for h, _ in heads(parse(p)[0])))) + ")"))
                continue
            for start in starts:
                anchors.setdefault(start, set()).add("machine")
        for text, grammar in ANCHORS:
            anchors.setdefault(text, set()).add(grammar)
        self.words = ahocorasick.Automaton()
        for text, readers in anchors.items():
            self.words.add_word(text, (len(text), sorted(readers)))
        self.words.make_automaton()

    def anchors(self, text: str) -> Iterator[tuple[int, int, str]]:
        """(start, end, grammar) of each place where a credential may be read."""
        low = text.lower()
        if len(low) != len(text):  # a few letters change their length in lower case
            low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
        for last, (size, readers) in self.words.iter(low):
            for grammar in readers:
                yield last + 1 - size, last + 1, grammar
        for pattern in self.headless:
            for m in pattern.finditer(text):
                yield m.start(), m.start(), "machine"

    def read(self, text: str, start: int, end: int, grammar: str, whole: bool = True) -> tuple[int, int, str] | None:
        """(start, end, kind) of the credential at an anchor, or None; ``Unfinished`` where the chunk does not tell."""
        return getattr(self, "_" + grammar)(text, start, end, whole)

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, kind) of each credential of a whole text, in order, from 0. Of spans that overlap the earliest counts, then the longest."""
        found = {span for a in self.anchors(text) if (span := self.read(text, *a))}
        return first_of_overlapping(sorted(found, key=lambda s: (s[0], -s[1], s[2])))

    def _match(self, pattern: re.Pattern, text: str, at: int, whole: bool):
        m = pattern.match(text, at)
        if not whole:
            import regex

            part = regex.compile(pattern.pattern, regex.ASCII).match(text, at, partial=True)
            if m and m.end() == len(text) or part and part.partial:
                raise Unfinished
        return m

    def _machine(self, text, start, end, whole):
        if text[start] not in ":-" and start and text[start - 1] in _ALNUM:
            return None
        kind, end, cut = self.machine.longest(text, start)
        if cut and not whole:
            raise Unfinished
        if kind == "connection_string":
            at = text.index(":", start + 1) + 1
            end -= 1 if text[end - 1] == "@" else len("\\u0040")
            return (at, end, kind) if is_literal(text[at:end], "password", True) else None
        if kind == "private_key":
            return self._armor(text, start, end, whole)
        return (start, end, kind) if kind and not _MASKED.match(text[start + 4 : end]) else None

    def _armor(self, text, start, end, whole):
        """From BEGIN to END, whatever lies between; without an END the lines of base64 that follow."""
        edge = _ARMOR_EDGE.search(text, end)
        if edge is None and not whole:
            raise Unfinished
        if edge and edge[0].startswith("-----END"):
            body, close = text[end : edge.start()], edge.end()
        else:
            lines = _ARMOR_BODY.match(text, end)
            close = lines.end() if lines else end
            body = text[end:close]
        if len(re.findall(r"[A-Za-z0-9+/=]", body)) < 16 or _MASKED.match(re.sub(r"\\n|\s", "", body)) or PLACEHOLDER.search(body) or REFERENCE.search(body):
            return None
        return start, close, "private_key"

    def _scheme(self, text, start, end, whole):
        m = self._match(_SCHEME_TOKEN, text, end, whole)
        if not m or start and text[start - 1].isalnum() or not _looks_random(m[1]) or not is_literal(m[1], "token", True):
            return None
        return m.start(1), m.end(1), "bearer_token"

    def _basic(self, text, start, end, whole):
        m = self._match(_SCHEME_TOKEN, text, end, whole)
        if not m or start and text[start - 1].isalnum() or not _is_login(m[1]):
            return None
        return m.start(1), m.end(1), "basic_login"

    def _login(self, text, start, end, whole):
        if start and not text[start - 1].isspace() and text[start - 1] not in "\"'[,":
            return None
        m = self._match(_LOGIN_OPTION, text, start, whole)
        if not m or not is_literal(m[2], "password", True):
            return None
        return m.start(2), m.end(2), "login_option"

    def _sql(self, text, start, end, whole):
        m = self._match(_SQL, text, end, whole)
        return (m.start(1), m.end(1), "password") if m and is_literal(m[1], "password", True) else None

    def _netrc(self, text, start, end, whole):
        m = self._match(_NETRC, text, end, whole)
        return (m.start(1), m.end(1), "password") if m and is_literal(m[1], "password", False) else None

    def _name(self, text, start, end, whole):
        """A name that ends in a word for a credential, and the value given to it."""
        anchor, end = end, self._match(_AFTER_NAME, text, end, whole).end()
        if not _NAME_END.fullmatch(text, anchor, end):
            return None
        first = start
        while first and text[first - 1] in _NAME_LETTERS:
            first -= 1
        if not first and not whole:
            raise Unfinished  # the name begins before the chunk
        name = _LAST_NAME.search(text, first, end)[0]
        first = end - len(name)
        if not is_secret_name(name) or text[max(0, first - 2) : first].endswith(("${", "$")):
            return None  # no such name, or the expansion of a variable
        if text[end : end + 1] == "_":
            return None
        m = self._match(_SEPARATOR, text, end, whole)
        if m:
            return self._value(text, m, name, whole)
        if text[end : end + 1] == ">" and text[first - 1 : first] == "<":
            close = text.find("<", end + 1)
            if close < 0 and not whole:
                raise Unfinished
            return (end + 1, close, "element") if close > 0 and is_literal(text[end + 1 : close], name, True) else None
        m = self._match(_SPOKEN, text, end, whole)
        if m and _looks_random(m[1].rstrip(".")) and is_literal(m[1].rstrip("."), name, False):
            return m.start(1), m.start(1) + len(m[1].rstrip(".")), "spoken"
        m = self._match(_SQL, text, end, whole)
        return (m.start(1), m.end(1), "password") if m and is_literal(m[1], name, True) else None

    def _value(self, text, separator, name, whole):
        """The quoted or bare text after a name and its separator."""
        at = separator.end()
        quote = _OPEN.match(text, at)
        if quote:
            a, b = quote.end(), _closing(text, quote[0], quote.end())
            if b is None:
                if whole:
                    return None
                raise Unfinished
            value = text[a:b]
            if "\n" in value or value.lower().startswith(("bearer ", "basic ")) or "://" in value or ":\\/" in value:
                return None  # no value; or read by the grammar of that word or of connection strings
            return (a, b, "named_value") if is_literal(value, name, True) else None
        v = self._match(_BARE, text, at, whole)
        after = text[v.end() : v.end() + 1] if v else ""
        if not v or after in ("(", "[") or "://" in v[0]:
            return None
        if after in ("\"", "'", "`") and not separator[0].strip().startswith((":=", "=", ":")):
            return None
        return (v.start(), v.end(), "named_value") if is_literal(v[0], name, False) else None


def _closing(text: str, quote: str, at: int) -> int | None:
    """Where the quoted text ends: at the same quote, not escaped, or at a line end (then it is no value)."""
    line = text.find("\n", at)
    while True:
        b = text.find(quote, at, line if line >= 0 else len(text))
        if b < 0:
            return line + 1 if line >= 0 else None
        back = b
        while len(quote) == 1 and text[back - 1] == "\\":
            back -= 1
        if (b - back) % 2 == 0:
            return b
        at = b + 1


def first_of_overlapping(spans):
    """Of spans in order of (start, -end) those that begin after the last kept one ended."""
    out = []
    for s in spans:
        if not out or s[0] >= out[-1][1]:
            out.append(s)
    return out


_scanner: Scanner | None = None


def scanner() -> Scanner:
    """The automaton, built once per Python worker."""
    global _scanner
    if _scanner is None:
        _scanner = Scanner()
    return _scanner


def redact_text(text: str | None, spans) -> str | None:
    """Splice ``«redacted:kind»`` over the spans and leave everything else as it is."""
    if text is None:
        return None
    out, at = [], 0
    for start, end, kind in spans:
        out += [text[at:start], f"«redacted:{kind}»"]
        at = end
    return "".join([*out, text[at:]])


_KEY = ["table_name", "record_id", "content_id"]
_SPAN = "table_name string, record_id string, content_id long, start_at long, end_at long, kind string"


def _rows(b: pa.RecordBatch, found: list[tuple]) -> pa.RecordBatch:
    """(row of ``b``, start, end, kind) as spans with the row's key; positions from 1."""
    rows, starts, ends, kinds = zip(*found) if found else ((), (), (), ())
    take = pa.array(rows, pa.int32())
    columns = [*[b.column(i).take(take) for i in range(3)], pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(kinds, pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=[*_KEY, "start_at", "end_at", "kind"])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole texts."""
    for b in batches:
        yield _rows(b, [(i, s + 1, e, k) for i, text in enumerate(b.column(3).to_pylist()) for s, e, k in scanner().spans(text)])


def _scan_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks: each anchor belongs to one of them. An unfinished one comes as a span without end, at the anchor."""
    for b in batches:
        found = []
        for i, (offset, low, high, text) in enumerate(zip(*[b.column(c).to_pylist() for c in (3, 4, 5, 6)])):
            for start, end, grammar in scanner().anchors(text):
                if low <= offset + start < high:
                    try:
                        span = scanner().read(text, start, end, grammar, whole=False)
                    except Unfinished:
                        span = (start, None, grammar)
                    if span:
                        s, e, k = span
                        found.append((i, offset + s + 1, e and offset + e, k))
        yield _rows(b, found)


def _read_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unfinished anchors in their whole texts."""
    for b in batches:
        found = []
        for i, (places, text) in enumerate(zip(b.column(3).to_pylist(), b.column(4).to_pylist())):
            for place in sorted(set(places)):
                # the anchor's own words are short
                for start, end, grammar in scanner().anchors(text[place - 1 : place + 63]):
                    if not start:
                        span = scanner().read(text, place - 1, place - 1 + end, grammar)
                        if span:
                            found.append((i, span[0] + 1, span[1], span[2]))
        yield _rows(b, found)


def _drop_overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans sorted by text, start and end (the longest first): the first of those that overlap, remembering one end."""
    text, end = None, 0
    for b in batches:
        keep = []
        for i, (*key, s, e) in enumerate(zip(*[b.column(n).to_pylist() for n in (*_KEY, "start_at", "end_at")])):
            if key != text or s > end:
                keep.append(i)
                text, end = key, e
        yield b.take(pa.array(keep, pa.int32()))


def _keyed(texts: DataFrame) -> DataFrame:
    """(table_name, record_id, content_id, content): a text goes by its record and its hash, as a record may have several."""
    texts = exact(texts, "table_name", "record_id", "content")
    return texts.select(F.col("table_name").cast("string"), F.col("record_id").cast("string"), F.xxhash64("content").alias("content_id"), "content")


def find_credentials(texts: DataFrame, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """(table_name, record_id, content_id, start_at, end_at, kind) of each literal credential; positions in characters from 1.

    ``texts`` has table_name, record_id (strings) and content; content_id is the hash of the content, so that versions of
    one record keep their own spans. Equal rows give their spans once, null and empty contents none. A content longer
    than ``chunk_chars`` is scanned in chunks that overlap by ``overlap_chars`` (even) and go to different tasks; each
    anchor is read in the chunk that shows at least half the overlap on either side of it. An anchor whose reading does
    not end there (a long key, value or name) is read again in its whole text, so nothing is cut. Absolute spans are
    deduplicated; of overlapping ones the earliest counts, then the longest.

    Left out on purpose: values under three characters, plain words (or phrases) of letters alone beside the vague names
    auth, credential, secret, token, key, pass and pw, and unquoted names of variables.
    """
    ship(texts.sparkSession)
    rows = _keyed(texts).where(F.length("content") > 0)
    whole = rows.where(F.length("content") <= chunk_chars).mapInArrow(_scan, _SPAN)
    _, found = Scratch(texts.sparkSession, "credentials").write(_chunk_spans(rows.where(F.length("content") > chunk_chars), chunk_chars, overlap_chars))
    open_ = found.where(F.col("end_at").isNull()).groupBy(*_KEY).agg(F.collect_set("start_at").alias("_places"))
    long = rows.where(F.length("content") > chunk_chars).dropDuplicates(_KEY)
    same = F.lit(True)
    for k in _KEY:
        same = same & F.col(f"o.{k}").eqNullSafe(F.col(f"t.{k}"))
    again = open_.alias("o").join(long.alias("t"), same).select(*[f"o.{k}" for k in _KEY], "_places", "content").mapInArrow(_read_again, _SPAN)
    spans = found.where(F.col("end_at").isNotNull()).unionByName(again)
    apart = spans.repartition(*_KEY).sortWithinPartitions(*_KEY, "start_at", F.col("end_at").desc(), "kind").mapInArrow(_drop_overlaps, _SPAN)
    return whole.unionByName(apart).dropDuplicates([*_KEY, "start_at"])


def _chunk_spans(long: DataFrame, chunk_chars: int, overlap_chars: int) -> DataFrame:
    """Spans of the chunks of long contents, and unfinished anchors."""
    zero, size = F.lit(0).cast("long"), F.length("content").cast("long")
    step = chunk_chars - overlap_chars
    offsets = F.sequence(zero, F.greatest(F.lit(0), F.length("content") - overlap_chars - 1).cast("long"), F.lit(step).cast("long"))
    cut = long.select(*_KEY, "content", F.explode(offsets).alias("offset"))
    low = F.when(F.col("offset") == 0, zero).otherwise(F.col("offset") + overlap_chars // 2)
    high = F.when(F.col("offset") + chunk_chars >= size, size).otherwise(F.col("offset") + chunk_chars - overlap_chars // 2)
    part = F.substring("content", F.col("offset").cast("int") + 1, F.lit(chunk_chars))
    return cut.select(*_KEY, "offset", low.alias("low"), high.alias("high"), part.alias("content")).repartition(*_KEY, "offset").mapInArrow(_scan_chunks, _SPAN)


def _redact(text, spans):
    import pandas as pd

    out = []
    for t, found in zip(text, spans):
        found = sorted((s["start_at"] - 1, s["end_at"], s["kind"]) for s in found) if found is not None else []
        out.append(redact_text(t, found))
    return pd.Series(out, dtype="object")


def redact(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """(table_name, record_id, content, n_redacted): each text with only its credentials blanked out.

    ``spans`` is ``find_credentials`` of the texts. They are grouped per text: as many as one text holds. Null keys are
    equal here, so no text stays in clear for want of one.
    """
    ship(texts.sparkSession)
    found = spans.groupBy(*_KEY).agg(F.collect_list(F.struct("start_at", "end_at", "kind")).alias("_spans"))
    t, f = _keyed(texts).alias("t"), found.alias("f")
    same = F.col("t.content_id") == F.col("f.content_id")
    for k in _KEY[:2]:
        same = same & F.col(f"t.{k}").eqNullSafe(F.col(f"f.{k}"))
    both = t.join(f, same, "left").select("t.table_name", "t.record_id", "t.content", "_spans")
    n = F.coalesce(F.size("_spans"), F.lit(0))
    clean = F.pandas_udf(_redact, "string")
    return both.select("table_name", "record_id", F.when(F.col("_spans").isNull(), F.col("content")).otherwise(clean("content", "_spans")).alias("content"), n.alias("n_redacted"))
