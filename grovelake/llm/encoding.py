"""Encoding a corpus with a public byte-level BPE tokenizer, cut at boundaries no token can cross."""

from __future__ import annotations

import base64
import importlib.util
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship, ship_file
from ..tables import exact

#: Texts of more characters than this are cut into pieces that several tasks encode.
PIECE_CHARS = 200_000
#: Fragments of at most so many characters are remembered by the worker, so many of them.
REMEMBERED_CHARS, REMEMBERED = 32, 400_000
#: Pre-split pattern of the 50k byte-level vocabulary (a fixed value of the public tokenizer).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_vocabulary() -> str:
    """The rank file of byte_bpe_50k, of the installed public_tokenizers or in /opt/tokenizers."""
    spec = importlib.util.find_spec("public_tokenizers")
    folder = os.path.dirname(spec.origin) if spec and spec.origin else "/opt/tokenizers"
    return os.path.join(folder, "byte_bpe_50k.tiktoken")


class Encoder:
    """byte_bpe over the fragments between certain cuts.

    A cut between two characters is certain if the pair of bytes around it occurs inside no vocabulary token (then no
    merge crosses it), the character before is no white space (a run of white space is split by what follows it) and
    the one after is no apostrophe (it may begin a contraction only where a match begins). Every text is split at all of
    its certain cuts; the fragments, a few letters each, are encoded on their own and concatenated, and the ids equal
    those of the whole text. Short fragments come again and again, so their ids are remembered.
    """

    def __init__(self, vocabulary: str):
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("grovelake", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.inside = np.zeros((256, 256), dtype=bool)
        for token in ranks:
            b = np.frombuffer(token, dtype=np.uint8)
            self.inside[b[:-1], b[1:]] = True
        self.known: dict[str, list[int]] = {}

    def cuts(self, text: str) -> np.ndarray:
        """All certain cuts, as numbers of the characters before them."""
        if text.isascii():
            code = first = last = np.frombuffer(text.encode(), dtype=np.uint8)
        else:
            code = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
            first, last = _edge_bytes(code)
        never = ~self.inside[last[:-1], first[1:]]
        at = np.nonzero(never)[0]
        return at[~_SPACES[np.minimum(code[at].astype(np.int64), len(_SPACES) - 1)] & (code[at + 1] != ord("'"))] + 1

    def fragments(self, text: str) -> list[str]:
        edges = [0, *self.cuts(text).tolist(), len(text)]
        return [text[a:b] for a, b in zip(edges, edges[1:])]

    def pieces(self, text: str, size: int) -> list[str]:
        """The text in pieces that end at certain cuts, the first at or after every ``size`` characters."""
        cuts = self.cuts(text)
        at, edges = size, [0]
        while at < len(text):
            i = np.searchsorted(cuts, at)
            if i == len(cuts):
                break
            edges.append(int(cuts[i]))
            at = edges[-1] + size
        edges.append(len(text))
        return [text[a:b] for a, b in zip(edges, edges[1:])]

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a text; of an empty or null text none."""
        if not text:
            return np.zeros(0, dtype=np.int32)
        known, out = self.known, []
        for f in self.fragments(text):
            ids = known.get(f)
            if ids is None:
                ids = self.encoding.encode_ordinary(f)
                if len(f) <= REMEMBERED_CHARS:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[f] = ids
            out += ids
        return np.array(out, dtype=np.int32)


_SPACES = np.array([chr(c).isspace() for c in range(0x3002)])


def _edge_bytes(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last byte of each character in UTF-8."""
    lead = [(0x80, lambda c: 0xC0 | c >> 6), (0x800, lambda c: 0xE0 | c >> 12), (0x10000, lambda c: 0xF0 | c >> 18)]
    first, last = code.copy(), code.copy()
    for least, byte in lead:
        at = np.nonzero(code >= least)[0]
        first[at], last[at] = byte(code[at]), 0x80 | code[at] & 0x3F
    return first, last


_encoders: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    """The encoder of a vocabulary that was shipped under this name, kept for the life of the Python worker."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(SparkFiles.get(vocabulary))
    return _encoders[vocabulary]


def _split(vocabulary: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, text in enumerate(b.column(2).to_pylist()):
                parts = encoder(vocabulary).pieces(text, size)
                same = pa.array([i] * len(parts), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(same), b.column(1).take(same), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.string())],
                    names=["_key", "_row", "_piece", "_text"],
                )

    return run


def _encode(vocabulary: str, count_only: bool):
    """Encode the last column of each batch, pass the others on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e, last = encoder(vocabulary), b.num_columns - 1
            ids = [e.encode(t) for t in b.column(last).to_pylist()]
            sizes = np.fromiter((len(x) for x in ids), dtype=np.int64, count=len(ids))
            if count_only:
                out = pa.array(sizes)
            else:
                edges = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                values = np.concatenate([*ids, np.zeros(0, dtype=np.int32)])
                out = pa.ListArray.from_arrays(pa.array(edges), pa.array(values, pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns[:last], out], names=[*b.schema.names[:last], "_ids"])

    return run


def _encoded(documents: DataFrame, id_col: str, text_col: str, vocabulary: str | None, count_only: bool, piece_chars: int) -> DataFrame:
    ship(documents.sparkSession)
    vocabulary = ship_file(documents.sparkSession, vocabulary or default_vocabulary())
    kind = "long" if count_only else "array<int>"
    key = documents.schema[id_col].dataType.simpleString()
    rows = exact(documents, id_col, text_col).select(F.col(id_col).alias("_key"), F.col(text_col).cast("string").alias("_text"))
    is_long = F.coalesce(F.length("_text") > piece_chars, F.lit(False))
    short = rows.where(~is_long).mapInArrow(_encode(vocabulary, count_only), f"_key {key}, _ids {kind}")
    # the row number keeps the pieces of repeated rows apart
    pieces = rows.where(is_long).select("_key", F.monotonically_increasing_id().alias("_row"), "_text")
    pieces = pieces.mapInArrow(_split(vocabulary, piece_chars), f"_key {key}, _row long, _piece int, _text string")
    pieces = pieces.repartition("_row", "_piece").mapInArrow(_encode(vocabulary, count_only), f"_key {key}, _row long, _piece int, _ids {kind}")
    if count_only:
        joined = pieces.groupBy("_key", "_row").agg(F.sum("_ids").alias("_ids"))
    else:
        parts = F.array_sort(F.collect_list(F.struct("_piece", "_ids")))
        joined = pieces.groupBy("_key", "_row").agg(F.flatten(F.transform(parts, lambda p: p["_ids"])).alias("_ids"))
    joined = joined.drop("_row")
    return short.unionByName(joined).select(F.col("_key").alias(id_col), F.col("_ids").alias("ids" if not count_only else "n_tokens"))


def encode_corpus(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """(id, ids): the token ids of each document's text, without special tokens (their strings are ordinary text).

    ``id_col`` is unique. Null and empty texts have the empty list. ``vocabulary`` is a rank file on the driver's machine,
    which is shipped to the executors. Every text is encoded by its fragments between certain cuts. Texts longer than ``piece_chars`` are cut at certain
    boundaries into pieces that are encoded in different tasks and put together by piece number; all others are encoded
    where they are read, without a shuffle.
    """
    return _encoded(documents, id_col, text_col, vocabulary, False, piece_chars)


def token_counts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """(id, n_tokens): sizes of the same encoding; only numbers leave the tasks."""
    return _encoded(documents, id_col, text_col, vocabulary, True, piece_chars)
