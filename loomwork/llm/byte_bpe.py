"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Texts longer than SEGMENT characters are cut where no match of the split pattern can cross, so the
ids are those of the whole text while the regex engine sees bounded input. Ids are decoded by
joining the tokens' raw bytes, never through text, so any id list decodes.

Defined cases: a null text counts as empty; an empty text has no ids; a null doc_id stays null;
repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from loomwork.llm.common import keep_id, map_batches, bounded_batches

SEGMENT = 1 << 16
#: A match never runs from a character that is not white space into a space or line feed.
_CUT = re.compile(r"(?<=\S)(?=[ \n])")
#: White space runs so long that the library's regex engine would run out of stack.
_LONG_SPACE = re.compile(r"\s{20000,}")
_ENCODINGS: dict = {}


def encoding(rank_file: str, pattern: str):
    """The tiktoken encoding of a rank file, built once per Python process."""
    key = (rank_file, pattern)
    if key not in _ENCODINGS:
        import tiktoken

        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
        _ENCODINGS[key] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[key]


def segments(text: str, size: int = SEGMENT) -> Iterator[str]:
    """Cut a text at safe boundaries into pieces of about size characters; a stretch without a
    boundary stays whole."""
    at = 0
    while len(text) - at > size:
        m = _CUT.search(text, at + size)
        if m is None:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def _encode_long_space(enc, text: str, m: re.Match) -> list[np.ndarray]:
    """A long run of white space is one match of the pattern, without its last character if more
    text follows; that character belongs to the text that follows."""
    if re.search(r"[\x1c-\x1f]", m[0]):  # white space for re, not for the library
        return [np.asarray(enc.encode_ordinary(text), dtype=np.uint32)]
    end = m.end() if m.end() == len(text) else m.end() - 1
    parts = _encode_segment(enc, text[: m.start()]) if m.start() else []
    parts.append(np.asarray(enc._encode_single_piece(text[m.start() : end].encode()), dtype=np.uint32))
    return parts + (_encode_segment(enc, text[end:]) if end < len(text) else [])


def _encode_segment(enc, text: str) -> list[np.ndarray]:
    if len(text) >= 20000 and (m := _LONG_SPACE.search(text)):
        return _encode_long_space(enc, text, m)
    return [np.asarray(enc.encode_ordinary(text), dtype=np.uint32)]


def encode(text: str, rank_file: str, pattern: str = public_tokenizers.PATTERN) -> np.ndarray:
    enc = encoding(rank_file, pattern)
    if len(text) <= SEGMENT:
        return np.concatenate(_encode_segment(enc, text))
    return np.concatenate([ids for part in segments(text) for ids in _encode_segment(enc, part)])


def decode(ids, rank_file: str, pattern: str = public_tokenizers.PATTERN) -> bytes:
    return encoding(rank_file, pattern).decode_bytes(ids.tolist() if isinstance(ids, np.ndarray) else ids)


def encode_texts(df: DataFrame, rank_file: str, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) for every row; ids stay below 2**31."""
    bounded_batches(df.sparkSession)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        ids = [encode(t or "", rank_file, pattern) for t in b.column(1).to_pylist()]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        values = pa.array(np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32))
        return pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), values)], [id_col, "ids"])

    return map_batches(keep_id(df, id_col, text_col), run, f"`{id_col}` long, ids array<int>")


def decode_ids(df: DataFrame, rank_file: str, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id") -> DataFrame:
    """(id, bytes binary) for every row of (id, ids); null ids decode to null."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        out = [None if x is None else decode(x, rank_file, pattern) for x in b.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], [id_col, "bytes"])

    return map_batches(keep_id(df, id_col, "ids"), run, f"`{id_col}` long, bytes binary")


def round_trip_digest(df: DataFrame, rank_file: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Encode every text, decode its ids, and return digests of both. The round trip of one text
    stays in one task, so ids and bytes are never shuffled."""
    bounded_batches(df.sparkSession)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        n, a, d = [], [], []
        for text in b.column(1).to_pylist():
            ids = encode(text or "", rank_file, pattern)
            n.append(len(ids))
            a.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
            d.append(hashlib.sha256(decode(ids, rank_file, pattern)).hexdigest())
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(d)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(keep_id(df, "doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
