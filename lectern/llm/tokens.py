"""Exact byte-level BPE for many short words: texts are cut where no token can cross, pieces are remembered.

The pre-splitting pattern never lets a match run from a non-space into a following space, so a text may be
cut there and the pieces encoded one by one with the same ids as the whole. What lies between two such cuts is cut further where letters and
signs meet, if it holds nothing but letters and signs of KIND, with one white character in front at most: there the pattern's matches are plain to see.
The cuts of a whole batch are found on its bytes, and equal pieces are looked up once. Most pieces are words that
come again, and a look-up replaces the merge loop; of new ones, those that are one match of the pattern need no further splitting, so that the
library's model gets them as they are. Added tokens of the vocabulary (`<|endoftext|>`) are taken wherever a text
holds them, as the library does by default: such a text goes to it whole.
"""

from __future__ import annotations

import codecs
import json
import os
import re
from array import array
from collections.abc import Callable
from itertools import compress

import numpy as np
import pyarrow as pa

#: Unicode white space beyond blank, tab, line feed and carriage return, and the separators that
#: Python alone counts as white space. A text that holds one is encoded whole.
UNUSUAL_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")

#: Pieces remembered by one Python worker (some 250 bytes each), in two generations, and the longest that is remembered, in bytes.
CACHE_ENTRIES = 1_000_000
CACHE_PIECE = 48
#: Pieces that are encoded as one text.
JOINED = 64

WHITE = b" \t\n\r"
#: Kinds of bytes: of a letter (ASCII, Latin-1, Latin Extended-A), an ASCII sign except the apostrophe, with which the pattern begins matches of its own, white, any other.
OTHER, LETTER, SIGN, SPACE = range(4)
#: First bytes of letters of two bytes.
LEADS = (0xC3, 0xC4, 0xC5)
KIND = np.zeros(256, np.uint8)
KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), *LEADS]] = LETTER
KIND[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) != "'"]] = SIGN
KIND[list(WHITE)] = SPACE
LEAD = np.isin(np.arange(256), LEADS)
#: Second bytes of × and ÷, which lie among the letters of two bytes.
NO_LETTERS = (0x97, 0xB7)
#: First bytes of what UNUSUAL_SPACE finds.
MAYBE_UNUSUAL = np.isin(np.arange(256), [0x0B, 0x0C, *range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3])

#: The pre-tokenizer whose pattern is meant here.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def contents(values: pa.LargeBinaryArray) -> list[bytes]:
    """The values of an array that is no slice and has no nulls, without a scalar for each."""
    at = np.frombuffer(values.buffers()[1], np.int64, len(values) + 1).tolist()
    data = values.buffers()[2].to_pybytes()
    return [data[x:y] for x, y in zip(at, at[1:], strict=False)]


def byte_alphabet() -> str:
    """The character that the byte-level alphabet writes for each byte; a line feed, here between pieces, becomes a blank, which isn't one of them."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    found = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)} | {0x0A: " "}
    return "".join(found[b] for b in range(256))


class Remembered:
    """Ids of pieces by encode, of late ones from memory: a full generation becomes the old one, what is used again moves to the new."""

    def __init__(self, encode: Callable[[list[bytes]], list[bytes]], most: int | None = None):
        self.encode = encode
        self.most = CACHE_ENTRIES if most is None else most
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def ids(self, wanted: list[bytes]) -> list[bytes]:
        new, old = self.new, self.old
        out = list(map(new.get, wanted))
        unknown = []
        for i in [i for i, ids in enumerate(out) if ids is None]:
            w = wanted[i]
            if (ids := old.get(w)) is not None:
                out[i] = new[w] = ids
            else:
                unknown.append(i)
        for at in range(0, len(unknown), 4096):
            part = unknown[at : at + 4096]
            words = [wanted[i] for i in part]
            for i, w, ids in zip(part, words, self.encode(words), strict=True):
                out[i] = ids
                if len(w) <= CACHE_PIECE:
                    new[w] = ids
        if len(new) > self.most // 2:
            self.new, self.old = {}, new
        return out


class PieceEncoder:
    """Ids of whole texts, by the tokenizers library, as little-endian unsigned 16-bit integers. remember: pieces of each kind that are remembered; ids don't depend on it."""

    def __init__(self, path: str, remember: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of this vocabulary don't fit 16 bits")
        # no text that holds one is cut
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # bytes of each token: the byte-level alphabet writes every byte as one character
        self.lengths = np.zeros(1 << 16, np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.lengths[i] = len(token)
        # the same model for matches of the pattern, written in the byte-level alphabet with blanks between them
        with open(path, encoding="utf-8") as f:
            plan = json.load(f)
        self.plain_pattern = BYTE_LEVEL.items() <= (plan.get("pre_tokenizer") or {}).items() and not plan.get("normalizer")
        self.alphabet = byte_alphabet()
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = CharDelimiterSplit(" ")
        # ids of pieces that are one match of the pattern, mostly a word after a blank, and of all others
        self.after, self.plain = Remembered(self._matches, remember), Remembered(self._others, remember)

    def _joined(self, tokenizer, texts: list[str], sizes: list[int]) -> list[bytes]:  # noqa: ANN001
        """The ids of pieces of these sizes in bytes, from texts of JOINED of them: no token spans two, and the tokens' lengths tell where each ends."""
        ids = np.asarray([x for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False) for x in e.ids], "<u2")
        cuts = (2 * (np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum(sizes)) + 1)).tolist()
        raw = ids.tobytes()
        return [raw[x:y] for x, y in zip([0, *cuts], cuts, strict=False)]

    def _matches(self, pieces: list[bytes]) -> list[bytes]:
        written = [codecs.charmap_decode(b"\n".join(pieces[i : i + JOINED]), "strict", self.alphabet)[0] for i in range(0, len(pieces), JOINED)]
        return self._joined(self.model, written, list(map(len, pieces)))

    def _others(self, pieces: list[bytes]) -> list[bytes]:
        texts = [p.decode() for p in pieces]
        # a blank in front and no white at the end: texts of several may be cut again
        even = [p[0] == 0x20 and p[-1] not in WHITE and not self.whole(t) for p, t in zip(pieces, texts, strict=True)]
        some = list(compress(texts, even))
        joined = iter(self._joined(self.tokenizer, ["".join(some[i : i + JOINED]) for i in range(0, len(some), JOINED)], [len(p) for p in compress(pieces, even)])) if some else iter(())
        apart = iter(self.tokenizer.encode_batch_fast([t for t, e in zip(texts, even, strict=True) if not e], add_special_tokens=False))
        return [next(joined) if e else array("H", next(apart).ids).tobytes() for e in even]

    def whole(self, text: str) -> bool:
        """Whether a text can't be cut."""
        return UNUSUAL_SPACE.search(text) is not None or any(a in text for a in self.added)

    def _cuts(self, texts: list[str], data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where pieces start in the bytes of all texts, and whether a piece is one match of the pattern. at: where texts start and the last one ends."""
        kind = KIND[data]
        two = np.flatnonzero(LEAD[data])
        no_letter = (data[two] == LEADS[0]) & np.isin(data[two + 1], NO_LETTERS)
        kind[two + 1] = np.where(no_letter, OTHER, LETTER)
        kind[two[no_letter]] = OTHER
        white = kind == SPACE
        twice = np.zeros(len(data), bool)
        np.logical_and(white[1:], white[:-1], out=twice[1:])
        first = at[:-1][at[:-1] < len(data)]
        starts = white & ~twice
        starts[first] = True
        odd = (kind == OTHER) | (twice & ~starts)
        suspects = set((np.searchsorted(at, np.flatnonzero(MAYBE_UNUSUAL[data]), "right") - 1).tolist())
        for i, t in enumerate(texts):
            if (i in suspects and UNUSUAL_SPACE.search(t)) or any(a in t for a in self.added):
                starts[at[i] + 1 : at[i + 1]] = False
                odd[at[i] : at[i + 1]] = True
        chunks = np.flatnonzero(starts)
        if not self.plain_pattern:
            return chunks, np.zeros(len(chunks), bool)
        even = np.repeat(~np.logical_or.reduceat(odd, chunks), np.diff(chunks, append=len(data)))
        starts[1:] |= even[1:] & (kind[1:] != kind[:-1]) & (data[:-1] != 0x20)
        pieces = np.flatnonzero(starts)
        return pieces, even[pieces] & (~white[pieces] | (data[pieces] == 0x20))

    def encode(self, texts: list[str]) -> list[bytes]:
        raw = [t.encode() for t in texts]
        at = np.zeros(len(raw) + 1, np.int64)
        np.cumsum([len(r) for r in raw], out=at[1:])
        if not at[-1]:
            return [b""] * len(raw)
        joined = b"".join(raw)
        pieces, match = self._cuts(texts, np.frombuffer(joined, np.uint8), at)
        ends = np.append(pieces, at[-1])
        found = pa.Array.from_buffers(pa.large_binary(), len(pieces), [None, pa.py_buffer(ends), pa.py_buffer(joined)]).dictionary_encode()
        codes, different = found.indices.to_numpy(), contents(found.dictionary)
        # equal pieces are of one kind
        matches = np.zeros(len(different), bool)
        matches[codes] = match
        ids = self.after.ids(list(compress(different, matches.tolist())))
        ids += self.plain.ids(list(compress(different, (~matches).tolist())))
        place = np.where(matches, np.cumsum(matches) - 1, np.cumsum(~matches) - 1 + np.count_nonzero(matches))
        taken = pa.array(ids, pa.large_binary()).take(pa.array(place[codes]))
        cuts = np.frombuffer(taken.buffers()[1], np.int64)[np.searchsorted(pieces, at)].tolist()
        out = taken.buffers()[2].to_pybytes()
        return [out[x:y] for x, y in zip(cuts, cuts[1:], strict=False)]


_encoders: dict[tuple[str, int | None], PieceEncoder] = {}


def encoder(path: str, remember: int | None = None) -> PieceEncoder:
    """One encoder for each vocabulary, size of memory and Python worker."""
    if (path, remember) not in _encoders:
        _encoders[path, remember] = PieceEncoder(path, remember)
    return _encoders[path, remember]
