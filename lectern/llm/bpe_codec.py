"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are cut before encoding, only where the pre-splitting pattern always ends a match: between a
non-space and a white-space character, or between a letter and a digit. Decoding joins the raw bytes of
the tokens, so any sequence of ids, cut anywhere, decodes.

Nulls: a null text is encoded as the empty text (no ids); a null doc_id stays null. Repeated rows give
repeated results, an empty table an empty one, other columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lectern.llm.common import arrow_map, null_as_empty

#: Texts longer than this many characters are cut into pieces of about this length.
LONG_TEXT = 16_384

#: No pattern of the byte-level vocabularies matches across these places.
SAFE = regex.compile(
    "(?<=[^\\s\x1c-\x1f\x85])(?=[ \t\n\r])|(?<=\\p{L})(?=\\p{N})|(?<=\\p{N})(?=\\p{L})"
)

SCHEMA = "doc_id long, n_tokens long, ids binary, decoded binary"


def safe_pieces(text: str, size: int = LONG_TEXT) -> Iterator[str]:
    """Cuts text into pieces of at least size characters whose encodings join to that of the whole."""
    at = 0
    while len(text) - at > size and (m := SAFE.search(text, at + size)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


class Codec:
    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if len(text) <= LONG_TEXT:
            return self.encoding.encode_ordinary(text)
        return [i for piece in safe_pieces(text) for i in self.encoding.encode_ordinary(piece)]

    def decode(self, ids: list[int]) -> bytes:
        return self.encoding.decode_bytes(ids)


_codecs: dict[tuple[str, str], Codec] = {}


def codec(ranks_path: str, pattern: str) -> Codec:
    key = (ranks_path, pattern)
    if key not in _codecs:
        _codecs[key] = Codec(*key)
    return _codecs[key]


def default_ranks() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encode_decode(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (unsigned 32-bit little-endian), decoded (raw bytes) of each whole text."""
    path, pat = ranks_path or default_ranks()[0], pattern or default_ranks()[1]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path, pat)
        ids = [c.encode(t) for t in null_as_empty(batch.column(1))]
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0).cast(pa.int64()),
                pa.array([len(x) for x in ids], pa.int64()),
                pa.array([np.asarray(x, "<u4").tobytes() for x in ids], pa.binary()),
                pa.array([c.decode(x) for x in ids], pa.binary()),
            ],
            names=["doc_id", "n_tokens", "ids", "decoded"],
        )

    return arrow_map(docs.select("doc_id", "text"), run, SCHEMA)
