"""Token ids of whole texts with a public tokenizer file, encoding each distinct white-space chunk once.

White space never joins two tokens of these tokenizers, so a text's ids are its chunks' ids in order. A worker
finds the distinct chunks of a batch in numpy, encodes only those it has not met, and gathers the rest from its
bounded store. Chunks are told apart by a 64-bit hash of their bytes.
"""

from __future__ import annotations

import os
import re

import numpy as np

from gleaner.llm.bytetools import groups_of, joined, word_hashes, word_spans

WORD_BPE = "word_bpe_49k.json"
BATCH_BYTES = 1 << 20
STORE_LIMIT = 1_200_000

_ASCII = re.compile(r"([A-Za-z]+)([.,;:!?|*%&$#()]*)\Z")
_LATIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?|*%&$#()]*)\Z")
_loaded: dict[str, ChunkTokenizer] = {}


def vocabulary_path(vocabulary: str) -> str:
    """A path as it is, or the place of a public tokenizer file named without one."""
    if os.path.sep in vocabulary:
        return vocabulary
    import public_tokenizers

    return public_tokenizers.path(vocabulary)


class ChunkTokenizer:
    def __init__(self, path: str, store_limit: int = STORE_LIMIT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        self.model = self.full.model
        self.spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.fast = os.path.basename(path) == WORD_BPE  # the short cuts below hold for this file's splitting rule
        self.limit = store_limit
        self.marks: dict[str, list[int]] = {"": []}
        self.forget()

    def forget(self) -> None:
        self.keys = np.empty(0, dtype=np.uint64)
        self.first = np.empty(0, dtype=np.int64)
        self.count = np.empty(0, dtype=np.int64)
        self.flat = np.empty(0, dtype=np.uint32)

    def _letters(self, word: str) -> list[int]:
        return [t.id for t in self.model.tokenize(word)]

    def chunk_ids(self, chunks: list[str]) -> list[list[int]]:
        """Ids of chunks without white space, the same as the full tokenizer's."""
        out: list[list[int] | None] = [None] * len(chunks)
        rest = []
        for i, chunk in enumerate(chunks):
            if self.fast and (m := _ASCII.match(chunk)):
                ids = self._letters(m[1].lower())
            elif self.fast and (m := _LATIN.match(chunk)):
                ids = self._letters(self.spell(m[1].lower())[0][0])
            else:
                rest.append(i)
                continue
            if m[2] not in self.marks:
                self.marks[m[2]] = self.full.encode(m[2], add_special_tokens=False).ids
            out[i] = ids + self.marks[m[2]]
        for i, e in zip(rest, self.full.encode_batch_fast([chunks[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    def _learn(self, keys: np.ndarray, chunks: list[str]) -> None:
        ids = self.chunk_ids(chunks)
        count = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        flat = np.fromiter((x for one in ids for x in one), dtype=np.uint32, count=int(count.sum()))
        first = len(self.flat) + np.cumsum(count) - count
        at = np.searchsorted(self.keys, keys)
        self.keys, self.first, self.count = (np.insert(a, at, b) for a, b in ((self.keys, keys), (self.first, first), (self.count, count)))
        self.flat = np.concatenate([self.flat, flat])

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """uint32 ids of each UTF-8 text."""
        out: list[np.ndarray] = []
        for lo, hi in groups_of(map(len, texts), BATCH_BYTES):
            out += self._encode(texts[lo:hi])
        return out

    def _encode(self, texts: list[bytes]) -> list[np.ndarray]:
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        data = np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8)
        starts, ends = word_spans(data)
        if not len(starts):
            return [np.empty(0, dtype=np.uint32)] * len(texts)
        keys, example, which = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) > self.limit:
            self.forget()
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        new = np.flatnonzero(self.keys[at] != keys) if len(self.keys) else np.arange(len(keys))
        if len(new):
            raw = data.tobytes()
            spans = example[new]
            self._learn(keys[new], [raw[a:b].decode("utf-8") for a, b in zip(starts[spans].tolist(), ends[spans].tolist(), strict=True)])
        at = np.searchsorted(self.keys, keys)[which]
        first, count = self.first[at], self.count[at]
        upto = np.cumsum(count)
        ids = np.empty(int(upto[-1]), dtype=np.uint32)
        for lo in range(0, len(at), BATCH_BYTES):
            hi = min(len(at), lo + BATCH_BYTES)
            a, b = int(upto[lo] - count[lo]), int(upto[hi - 1])
            ids[a:b] = self.flat[np.repeat(first[lo:hi] - (upto[lo:hi] - count[lo:hi]), count[lo:hi]) + np.arange(a, b)]
        words = np.searchsorted(starts, np.cumsum(sizes + 1))
        cuts = np.concatenate([[0], upto])[words]
        return np.split(ids, cuts[:-1])


def tokenizer(vocabulary: str) -> ChunkTokenizer:
    """This worker's tokenizer of a vocabulary file; it keeps its store from task to task."""
    path = vocabulary_path(vocabulary)
    if path not in _loaded:
        _loaded[path] = ChunkTokenizer(path)
    return _loaded[path]
