"""Whole-text encoding with the ``tokenizers`` library, with each distinct chunk encoded once.

Both vocabularies split a text into pre-tokens before any merge, and a blank that does not
stand inside a longer run of white space always is such a border.  A text is therefore the
concatenation of its blank-separated chunks, and chunks recur: a worker keeps the ids of
those it has seen.  New chunks of a batch are encoded in one call as one text, whose ids
show where a chunk begins; texts and chunks for which that isn't certain are encoded alone.
So are texts that hold the string of one of the vocabulary's added tokens, which the library
reads as that token wherever it stands.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

from .common import quiet_tokenizers

quiet_tokenizers()

#: Chunks whose ids a worker keeps; beyond it the store starts anew (about 150 bytes each).
CACHE_CHUNKS = 1_000_000
#: Longer chunks are not kept.
CACHE_CHUNK_CHARS = 64
#: Texts encoded together.
BATCH_CHARS = 2_000_000


_INSIDE = re.compile(r"\s \s")
#: Marks a text's first chunk, before which there is no blank.
_FIRST = "\0"


class ChunkEncoder:
    """ids of whole texts; equal to ``encode(text, add_special_tokens=False)``.

    ``leading_blank``: the vocabulary is byte-level, words carry the blank before them.
    Otherwise white space is dropped and a word ends with its last token.
    """

    def __init__(self, path: str, leading_blank: bool, cache_chunks: int = CACHE_CHUNKS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [t.content for t in added]
        # a normaliser may change a text before such tokens are looked for, so no string tells where they are
        self.hidden = any(t.normalized for t in added) and self.tokenizer.normalizer is not None
        self.leading_blank = leading_blank
        self.cache_chunks = cache_chunks
        self.known: dict[str, bytes] = {}
        self.heads: set[str] = set()
        if leading_blank:
            self.begins = np.zeros(self.tokenizer.get_vocab_size() + 1, dtype=bool)
            self.begins[[i for t, i in self.tokenizer.get_vocab().items() if t[0] == "\u0120"]] = True
        else:
            (self.bar,) = self.tokenizer.encode("|", add_special_tokens=False).ids

    def _chunks(self, text: str) -> list[str] | None:
        """The text's chunks, the blanks between them left out; None if it must be encoded as a whole."""
        if not self.leading_blank:
            return text.replace("\n", " ").split(" ")
        if _FIRST in text:
            return None
        chunks = text.split(" ")
        chunks[0] = _FIRST + chunks[0]
        return chunks

    def _odd(self, new: list[str]) -> list[str]:
        """Chunks that can't be told from their neighbours in a joined text."""
        if self.leading_blank:
            return [c for c in new if not c or c[0] == _FIRST or c[-1].isspace() or c[0].isspace()]
        return [c for c in new if "|" in c]

    def _text(self, chunk: str) -> str:
        """The part of the text that a chunk stands for."""
        if not self.leading_blank:
            return chunk
        return chunk[1:] if chunk[:1] == _FIRST else " " + chunk

    def _learn(self, new: list[str]) -> None:
        if odd := self._odd(new):
            texts = [self._text(c) for c in odd]
            for c, e in zip(odd, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                self.known[c] = np.asarray(e.ids, dtype=np.uint32).tobytes()
            hard = set(odd)
            new = [c for c in new if c not in hard]
        for at in range(0, len(new), 1024):
            part = new[at : at + 1024]
            whole = " " + " ".join(part) if self.leading_blank else " | ".join(part)
            ids = np.asarray(self.tokenizer.encode_batch_fast([whole], add_special_tokens=False)[0].ids, dtype=np.uint32)
            if self.leading_blank:
                begins = np.flatnonzero(self.begins[ids])
                ends = np.append(begins[1:], len(ids))
            else:
                bars = np.flatnonzero(ids == self.bar)
                begins, ends = np.append(0, bars + 1), np.append(bars, len(ids))
            if len(begins) != len(part):
                raise AssertionError("a border between chunks was lost in encoding")
            raw = ids.tobytes()
            self.known.update(zip(part, [raw[b:e] for b, e in zip((begins * 4).tolist(), (ends * 4).tolist(), strict=True)], strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers; null counts as empty."""
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            size, to = 0, at
            while to < len(texts) and (to == at or size < BATCH_CHARS):
                size += len(texts[to] or "")
                to += 1
            out += self._encode(texts[at:to])
            at = to
        return out

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32).tobytes()

    def _encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.known) > self.cache_chunks:
            self.known.clear()
            self.heads.clear()
        split = [(None if self.hidden or any(a in t for a in self.added) else self._chunks(t)) if t else [] for t in texts]
        need: set[str] = set()
        for chunks in split:
            if chunks:
                need.update(chunks)
        known = self.known
        if not self.leading_blank:
            known[""] = b""
        new = list(need.difference(known))  # looks up each of need, with the hashes it has
        if self.leading_blank:
            # only before such a chunk can a blank stand inside a longer run of white space; most batches have none
            self.heads.update(c for c in new if not c or c[0].isspace())
            if not self.heads.isdisjoint(need):
                split = [None if t and _INSIDE.search(t) else c for t, c in zip(texts, split, strict=True)]
        self._learn([c for c in new if len(c) <= CACHE_CHUNK_CHARS])
        extra = {c: self._whole(self._text(c)) for c in new if len(c) > CACHE_CHUNK_CHARS}
        out, get = [], known.__getitem__
        for text, chunks in zip(texts, split, strict=True):
            if chunks is None:
                out.append(self._whole(text))
            elif extra:
                out.append(b"".join([extra[c] if c in extra else known[c] for c in chunks]))
            else:
                out.append(b"".join(map(get, chunks)))
        return out


@lru_cache(maxsize=4)
def byte_encoder(path: str) -> ChunkEncoder:
    """For byte-level BPE, whose words carry the blank before them."""
    return ChunkEncoder(path, leading_blank=True)


@lru_cache(maxsize=4)
def word_encoder(path: str) -> ChunkEncoder:
    """For BPE with word ends, which drops white space."""
    return ChunkEncoder(path, leading_blank=False)
