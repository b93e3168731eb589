"""Encoding with a public tokenizer file, word by word with a bounded memory of words."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks that a Python worker remembers at most, some 200 bytes each.
REMEMBERED_CHUNKS = 600_000
DEFAULT_VOCABULARY = "word_bpe_49k.json"
ID_BYTES = 4


def default_path() -> str:
    """The vocabulary's place where the public tokenizer files are installed."""
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_VOCABULARY)


#: A comma or full stop between a letter of Latin text and a blank: always a token of its own.
_STOP = r"([A-Za-zÀ-ÖØ-öø-ÿ])([,.])([ \n]|$)"
#: Where letters may be joined with marks, or special tokens may stand, case is left to the tokenizer.
_DELICATE = "[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]"
_SPECIAL = "<|"
#: A character that is a token by itself, put between chunks that are encoded together, and how many are.
_BETWEEN, _TOGETHER = "\x01", 1024
#: Bytes of texts that are cut into chunks at a time; a longer text is by itself.
_GROUP_BYTES = 1 << 22
#: What a tokenizer must give the same ids for, whole and chunk by chunk, in capitals and not.
_PROBES = ("Some words, and a STOP. It's 12 o'clock\n\nnow", "Été à la ÎLE — «Ça va?» 3,5", "x  y \t z\u3000漢字 かな!?")


class ChunkEncoder:
    """Ids of whole texts for a tokenizer that lowers case and drops white space (the word-level BPE file).

    Such a tokenizer never joins across white space, and its normaliser looks at no character beyond it, so the
    ids of a text are those of its chunks between ASCII white space, in order.  Chunks met before are looked up;
    capitals of ASCII and stops after words are evened out first, so that fewer differ.  The memory is emptied
    when it is full.  Any other tokenizer is refused.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        between = self._plain(_BETWEEN)
        self.between = between[0] if len(between) == 1 else None
        for text in _PROBES:
            whole = self._plain(text)
            if not whole == self._plain(text.upper()) == np.frombuffer(self.ids(text), "<u4").tolist():
                raise ValueError(f"{path}: the tokenizer must lower case and drop white space")

    def _plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _learn(self, chunks: set[str]) -> None:
        """Encodes chunks, many at once with a token between them that no other text gives."""
        alone = [c for c in chunks if self.between is None or _BETWEEN in c or _SPECIAL in c]
        for chunk in alone:
            self.known[chunk] = np.array(self._plain(chunk), "<u4").tobytes()
        rest = list(chunks.difference(alone) if alone else chunks)
        parts = [rest[at : at + _TOGETHER] for at in range(0, len(rest), _TOGETHER)]
        joined = [f" {_BETWEEN} ".join(part) + f" {_BETWEEN}" for part in parts]
        for part, code in zip(parts, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False), strict=True):
            ids = np.array(code.ids, "<u4")
            raw, ends = ids.tobytes(), (np.flatnonzero(ids == self.between) * ID_BYTES).tolist()
            starts = [0, *(e + ID_BYTES for e in ends)]
            self.known.update(zip(part, map(raw.__getitem__, map(slice, starts, ends)), strict=True))

    def all_ids(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text, each id as four little-endian bytes.

        Some texts at a time are cut into chunks and their distinct chunks numbered by Arrow, so that Python looks
        up each of them once, and Arrow puts the ids in their places.
        """
        size, first = 0, 0
        for i, length in enumerate(pc.binary_length(texts).to_pylist()):
            size += length
            if size >= _GROUP_BYTES:
                yield from self._looked_up(texts.slice(first, i + 1 - first))
                size, first = 0, i + 1
        if first < len(texts):
            yield from self._looked_up(texts.slice(first))
        pa.default_memory_pool().release_unused()

    def _looked_up(self, texts: pa.Array) -> Iterator[bytes]:
        as_is = pc.or_(pc.match_substring(texts, _SPECIAL), pc.match_substring_regex(texts, _DELICATE))
        even = pc.replace_substring_regex(pc.if_else(as_is, texts, pc.ascii_lower(texts)), _STOP, r"\1 \2\3")
        lists = pc.ascii_split_whitespace(even)
        coded = lists.flatten().dictionary_encode()
        chunks = coded.dictionary.to_pylist()
        fresh = set(chunks).difference(self.known)
        if fresh:
            if len(self.known) + len(fresh) > REMEMBERED_CHUNKS:
                self.known.clear()
                fresh = set(chunks)
            self._learn(fresh)
        found = list(map(self.known.__getitem__, chunks))
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // ID_BYTES
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), "<u4")))
        placed = ids.take(coded.indices)
        raw = placed.flatten().to_numpy().tobytes()
        at = np.concatenate([[0], np.cumsum(sizes[coded.indices.to_numpy()])]) * ID_BYTES
        bounds = at[np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])].tolist()
        for i in range(len(texts)):
            yield raw[bounds[i] : bounds[i + 1]]

    def ids(self, text: str) -> bytes:
        """The ids of one text."""
        return next(self.all_ids(pa.array([text], pa.string())))


def encoder(path: str) -> ChunkEncoder:
    """One encoder for each file and Python worker, so that later tasks find the words of earlier ones."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


_ENCODERS: dict[str, ChunkEncoder] = {}


def forget() -> None:
    """Drop the encoders of this worker; operators that need its memory for other words call it first."""
    _ENCODERS.clear()


def crc32(ids: bytes) -> int:
    return zlib.crc32(ids)
