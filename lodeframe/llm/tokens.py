"""Token ids of whole Arrow batches, by a public tokenizer, each distinct word encoded once where that is the same."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .bytewords import words
from .storage import kept

#: Slots of the word table and ids it may hold, which bound it at 64 MB in each worker.
SLOTS, POOL = 1 << 21, 1 << 23


#: Normalisers that leave words apart.
_PLAIN = {"Lowercase", "NFC", "Replace"}
_PROBES = ["One  two\tTWO\n one", " it's  3.14\x0b(x) ", "É é\u0301 \u0301a ß İ\r\ffin"]


def treats_words_apart(tokenizer) -> bool:
    """Whether a tokenizer's ids of any text are those of its words, split at ASCII white space, A-Z in lower case.

    So it is if text is lower-cased and only pieces that a pattern finds are kept,
    none with white space; probes confirm it.
    """
    made = json.loads(tokenizer.to_str())
    normalizer, split = made["normalizer"] or {}, made["pre_tokenizer"] or {}
    steps = normalizer.get("normalizers", [normalizer])
    first = split.get("pretokenizers", [split])[0]
    kinds = {x.get("type") for x in steps}
    spaces = all(x.get("pattern") == {"Regex": r"\s+"} and x.get("content") == " " for x in steps if x.get("type") == "Replace")
    if not ("Lowercase" in kinds and kinds <= _PLAIN and spaces and first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert")):
        return False
    ids = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    return all(ids(p) == [i for w in p.encode().lower().split() for i in ids(w.decode())] for p in _PROBES)


class WordEncoder:
    """Ids of texts by a tokenizer, each distinct word encoded once if it treats words apart.

    Then the ids of a text are those of its words, one after another.  Every word
    still goes through the tokenizer; a table keeps the ids of words seen before,
    which are told apart by 64-bit names.  Chunks with a special token, and all
    texts of other tokenizers, are encoded as they are.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.apart = treats_words_apart(self.tokenizer)
        self.special = [t.content.encode().lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Ids lie below this.
        self.vocabulary = 1 + max(self.tokenizer.get_vocab(with_added_tokens=True).values())
        self.name = np.zeros(SLOTS, np.uint64)
        self.start = np.zeros(SLOTS, np.int32)
        self.size = np.zeros(SLOTS, np.int32)
        self.pool = np.empty(1 << 16, np.uint32)
        self.used = 0

    def _store(self, ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        size = np.fromiter(map(len, ids), np.int32, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.uint32, int(size.sum()))
        start = self.used + np.cumsum(size) - size
        while self.used + flat.size > self.pool.size:
            self.pool = np.concatenate((self.pool, np.empty(self.pool.size, np.uint32)))
        self.pool[self.used : self.used + flat.size] = flat
        self.used += flat.size
        return start, size

    def encode(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids, number of ids of each text) of a string column without nulls, by chunks."""
        for w in words(column):
            raw = w.data.tobytes()
            low = raw.lower() if self.special else b""
            if not self.apart or any(t in low for t in self.special):
                found = self.tokenizer.encode_batch_fast([raw[s:e].decode() for s, e in zip(w.offsets[:-1].tolist(), w.offsets[1:].tolist(), strict=True)], add_special_tokens=False)
                each = [np.array(e.ids, np.uint32) for e in found]
                yield w.first, np.concatenate(each), np.array([x.size for x in each], np.int64)
                continue
            if self.used > POOL:
                self.used = 0
                self.size[:] = 0
                self.name[:] = 0
            # Names are scrambled, so none is 0 but by a chance of 2**-64.
            unique, at, inverse = np.unique(w.name, return_index=True, return_inverse=True)
            slot = (unique & np.uint64(SLOTS - 1)).astype(np.int64)
            start, size = self.start[slot], self.size[slot]
            new = np.flatnonzero(self.name[slot] != unique)
            if new.size:
                spans = zip(w.start[at[new]].tolist(), w.end[at[new]].tolist(), strict=True)
                found = self.tokenizer.encode_batch_fast([raw[s:e].decode() for s, e in spans], add_special_tokens=False)
                start[new], size[new] = self._store([e.ids for e in found])
                self.name[slot[new]], self.start[slot[new]], self.size[slot[new]] = unique[new], start[new], size[new]
            each = size[inverse].astype(np.int64)
            total = int(each.sum())
            index = np.arange(total) + np.repeat(start[inverse].astype(np.int64) - (np.cumsum(each) - each), each)
            texts = w.offsets.size - 1
            yield w.first, self.pool[index], np.bincount(w.text, each, minlength=texts).astype(np.int64)


def encoder(path: str) -> WordEncoder:
    """One for each worker process, as long as its tasks encode."""
    return kept(("encoder", path), lambda: WordEncoder(path))


def closed_documents(column: pa.Array, path: str, end_id: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, ids, number of ids of each document) with ``end_id`` after each document."""
    for first, ids, size in encoder(path).encode(column):
        yield first, np.insert(ids, np.cumsum(size), end_id), size + 1


def binary_array(ids: np.ndarray, size: np.ndarray, dtype: str) -> pa.Array:
    """Consecutive runs of ``ids`` as binary values of little-endian integers."""
    data = np.ascontiguousarray(ids.astype(dtype))
    offsets = np.concatenate(([0], np.cumsum(size * data.itemsize))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), size.size, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
