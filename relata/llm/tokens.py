"""Byte-level BPE ids for whole Arrow columns: each distinct piece of a chunk is encoded once."""

from __future__ import annotations

import base64
import json
import re

import numpy as np
import pyarrow as pa

from .words import _bytes, _hash

_NOT_CUT = np.zeros(256, dtype=bool)
#: A space before white space is no cut. The bytes from 0xC2 on may begin white space outside ASCII.
_NOT_CUT[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True

#: Ids of so many pieces are kept from chunk to chunk; then the table starts anew.
KEPT_PIECES = 200_000


class Encoder:
    """ids(texts): uint32 ids of each text, and where each text's begin.

    The vocabulary's pattern ends a match before every space that a character other than white space follows. So the texts
    can be cut there, and a piece's ids don't depend on what stands around it. Added tokens of the vocabulary's JSON
    are found in the texts first, the longest at a place, and are one id each; what is between them is encoded alone.
    """

    def __init__(self, ranks_path: str | None = None) -> None:
        import public_tokenizers
        import tiktoken

        with open(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encode = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as vocabulary:
            self.added = {t["content"].encode(): np.array([t["id"]], dtype="<u4").tobytes() for t in json.load(vocabulary)["added_tokens"]}
        self.literal = re.compile(b"|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) or b"(?!)")
        self.known: dict[bytes, bytes] = {}

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = _bytes(texts)
        n = len(data)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        cut = data == 0x20
        cut[:-1] &= ~_NOT_CUT[data[1:]]
        cut[offsets[1:][np.diff(offsets) > 0] - 1] = False
        cut[offsets[:-1][np.diff(offsets) > 0]] = True
        raw, found = data.tobytes(), []
        if self.literal.search(raw):
            for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                done = lo
                for a, b in (m.span() for m in self.literal.finditer(raw, lo, hi)):
                    if a - 1 > done:
                        cut[a - 1] = False  # a space there ends its part of the text
                    cut[a:b] = False
                    cut[a] = True
                    if b < hi:
                        cut[b] = True
                    done = b
        first = np.flatnonzero(cut)
        last = np.append(first[1:], n)
        _, where, inverse = np.unique(_hash(data, first, last, 7), return_index=True, return_inverse=True)
        if len(self.known) > KEPT_PIECES:
            self.known = {}
        for a, b in zip(first[where].tolist(), last[where].tolist()):
            piece = raw[a:b]
            ids = self.added.get(piece) or self.known.get(piece)
            if ids is None:
                ids = np.array(self.encode(piece.decode()), dtype="<u4").tobytes()
                if b - a <= 64:
                    self.known[piece] = ids
            found.append(ids)
        size = np.array([len(x) >> 2 for x in found], dtype=np.int64)
        flat = np.frombuffer(b"".join(found), dtype="<u4")
        begin = np.cumsum(size) - size
        sizes = size[inverse]
        ends = np.cumsum(sizes)
        take = np.arange(int(ends[-1])) + np.repeat(begin[inverse] - (ends - sizes), sizes)
        piece_at = np.searchsorted(first, offsets)
        return flat[take], np.append(0, ends)[piece_at]
