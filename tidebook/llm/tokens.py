"""Token ids of whole texts by a public byte-level BPE vocabulary, given as a rank file.

Texts longer than LONG are first cut where the vocabulary's own splitting pattern is sure to end a
piece: between a letter, digit or punctuation mark and a following space or line feed. Each part then
has the ids it has in the whole, and no part's merges need the whole text. A part that has no such
place for long, as a run of millions of spaces or a text in a script without spaces, never meets the
encoder's own splitter, whose stack a run of a million blanks overflows: its pieces are found here and
each is merged from its bytes. Decoding joins the tokens' raw bytes before it reads them as UTF-8,
since a token may end inside a character.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the public vocabulary: its splitting pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Code points from which a text is encoded in parts.
LONG = 100_000
#: Code points from which a part is split into pieces here.
OVERLONG = 2 * LONG
_PIECE = regex.compile(PATTERN)
_CUT = regex.compile(r"(?<=[\p{L}\p{N}\p{P}])(?=[ \n])")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.lru_cache(maxsize=4)
def encoding(path: str) -> tiktoken.Encoding:
    """One encoder a worker process and file."""
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})


@functools.lru_cache(maxsize=4)
def _bytes_of(path: str) -> dict[int, bytes]:
    return {v: k for k, v in read_ranks(path).items()}


def parts(text: str, size: int = LONG) -> Iterator[str]:
    """``text`` in parts of about ``size`` code points, cut only where a piece is sure to end."""
    start = 0
    while len(text) - start > size:
        m = _CUT.search(text, start + size)
        if m is None:
            break
        yield text[start : m.start()]
        start = m.start()
    yield text[start:]


def encode(text: str | None, path: str = DEFAULT_RANKS) -> list[int]:
    """Ids of ``text``; [] for an empty or null text. Special tokens' strings are ordinary text."""
    if not text:
        return []
    enc = encoding(path)
    if len(text) <= LONG:
        return enc.encode_ordinary(text)
    return [i for p in parts(text) for i in (enc.encode_ordinary(p) if len(p) <= OVERLONG else by_pieces(p, path))]


def by_pieces(text: str, path: str = DEFAULT_RANKS) -> list[int]:
    """As ``encode``, a piece of the splitting pattern at a time, in time linear in the text. Lone
    surrogates, which no UTF-8 holds, are U+FFFD, as the encoder takes them."""
    enc = encoding(path)
    if not text.isprintable():
        text = text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return [i for m in _PIECE.finditer(text) for i in enc._encode_single_piece(m.group().encode())]


def decode(ids: list[int], path: str = DEFAULT_RANKS) -> str:
    """The text of ``ids``; bytes that are no UTF-8, as in a cut-off sequence, become U+FFFD."""
    b = _bytes_of(path)
    return b"".join(b[i] for i in ids).decode("utf-8", errors="replace")


def _mapper(path: str, counts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, offsets = [], [0]
            for text in b.column(b.num_columns - 1).to_pylist():
                got = encode(text, path)
                if counts:
                    offsets.append(len(got))
                else:
                    ids.append(np.array(got, np.int32))
                    offsets.append(offsets[-1] + len(got))
            if counts:
                last: pa.Array = pa.array(np.array(offsets[1:], np.int64))
            else:
                last = pa.ListArray.from_arrays(pa.array(np.array(offsets, np.int32)), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], last], names=[*b.schema.names[:-1], "__out"])

    return run


def _with(df: DataFrame, text: str, name: str, path: str, counts: bool, keep: list[str]) -> DataFrame:
    narrow = df.select(*keep, F.col(text).alias("__out"))
    types = dict(narrow.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), f"__out {'long' if counts else 'array<int>'}"])
    return narrow.mapInArrow(_mapper(path, counts), schema).withColumnRenamed("__out", name)


def with_ids(df: DataFrame, keep: list[str], text: str = "text", name: str = "ids", path: str = DEFAULT_RANKS) -> DataFrame:
    """``keep`` and the list of ids of each row's text. One row out per row in, repeated rows too; an
    empty or null text gives an empty list. ``path`` must be readable on every executor."""
    return _with(df, text, name, path, False, keep)


def with_counts(df: DataFrame, keep: list[str], text: str = "text", name: str = "n_tokens", path: str = DEFAULT_RANKS) -> DataFrame:
    """``keep`` and the number of tokens of each row's text, 0 for an empty or null one."""
    return _with(df, text, name, path, True, keep)


def with_texts(df: DataFrame, keep: list[str], ids: str = "ids", name: str = "text", path: str = DEFAULT_RANKS) -> DataFrame:
    """``keep`` and the text of each row's list of ids, "" for an empty or null one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [decode(x or [], path) for x in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], names=[*b.schema.names[:-1], "__out"])

    narrow = df.select(*keep, F.col(ids).alias("__out"))
    types = dict(narrow.dtypes)
    return narrow.mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in keep), "__out string"])).withColumnRenamed("__out", name)
