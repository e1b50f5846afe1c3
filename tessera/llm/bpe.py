"""Token ids from a public tokenizer file, with a bounded cache of words per Python worker.

The tokenizer drops white space and never lets a token span it, so the ids of a text are those
of its space-separated words in turn.  A word is encoded once and then looked up.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tessera.llm.text import split

_SPACE, _LETTER, _DIGIT, _SIGN, _ODD = range(5)
_KIND = np.full(256, _ODD, np.uint8)
_KIND[0x21:0x7F] = _SIGN
_KIND[0x30:0x3A] = _DIGIT
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = _LETTER
_KIND[[0x20, *range(0x09, 0x0E)]] = _SPACE
_KIND[[0x27, 0x7C]] = _ODD
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[0x41:0x5B] += 0x20
_PIECE = re.compile(r"[a-z]+|[0-9]|[!-&(-/:-@\[-`{}~]+").fullmatch

_ENCODERS: dict[str, Encoder] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Encoder:
    """Words with their ids, kept side by side; when there are too many, the half used last stays."""

    def __init__(self, path: str, cached_words: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.limit = cached_words
        self.words = pa.array([], pa.string())
        self.begins = self.sizes = self.flat = np.zeros(0, np.int32)
        self.used, self.turn = np.zeros(0, np.int64), 0

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts as int32, and how many each text has."""
        words = split(texts)
        if not len(words.starts):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        kind = _KIND[words.buf]
        # A word of printable ASCII without an apostrophe or bar falls into runs of letters, single
        # digits and runs of other signs, as the tokenizer would cut it; any other word stays whole.
        odd = np.concatenate(([0], np.cumsum(kind == _ODD, dtype=np.int32)))
        whole = odd[words.ends] != odd[words.starts]
        if whole.any():
            delta = np.zeros(len(kind) + 1, np.int8)
            delta[words.starts[whole]] += 1
            delta[words.ends[whole]] -= 1
            kind = np.where(np.cumsum(delta[:-1], dtype=np.int8) > 0, np.uint8(_ODD), kind)
        begins = np.zeros(len(kind), bool)
        begins[1:] = kind[1:] != kind[:-1]
        begins |= kind == _DIGIT
        begins[words.starts] = True
        begins &= kind != _SPACE
        starts = np.flatnonzero(begins)
        inside = kind != _SPACE
        data = _LOWERED[words.buf] if not whole.any() else np.where(kind == _ODD, words.buf, _LOWERED[words.buf])
        data = data[inside]
        place = np.cumsum(inside, dtype=np.int32)
        offsets = np.empty(len(starts) + 1, np.int32)
        offsets[:-1] = place[starts] - 1
        offsets[-1] = len(data)
        pieces = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data))
        codes = self._codes(pieces)
        each = self.sizes[codes]
        ends = np.cumsum(each, dtype=np.int32)
        at = np.repeat(self.begins[codes] - (ends - each), each)
        at += np.arange(len(at), dtype=np.int32)
        total = np.concatenate(([0], ends))
        return self.flat[at], np.diff(total[np.searchsorted(starts, words.offsets)]).astype(np.int64)

    def _codes(self, pieces: pa.StringArray) -> np.ndarray:
        """Places of the pieces in the cache, which first gets those it lacks."""
        if len(self.words) > self.limit:
            self._keep(np.argsort(self.used)[-self.limit // 2 :])
        self.turn += 1
        codes = pc.index_in(pieces, value_set=self.words)
        if codes.null_count:
            lacking = np.flatnonzero(codes.is_null().to_numpy(zero_copy_only=False))
            new = pieces.take(pa.array(lacking)).dictionary_encode()
            ids = self._encode_words(new.dictionary.to_pylist())
            sizes = np.fromiter(map(len, ids), np.int32, len(ids)) >> 2
            known = len(self.words)
            self.begins = np.concatenate((self.begins, len(self.flat) + np.cumsum(sizes, dtype=np.int32) - sizes))
            self.sizes = np.concatenate((self.sizes, sizes))
            self.flat = np.concatenate((self.flat, np.frombuffer(b"".join(ids), np.int32)))
            self.used = np.concatenate((self.used, np.zeros(len(ids), np.int64)))
            self.words = pa.concat_arrays([self.words, new.dictionary])
            out = codes.fill_null(0).to_numpy().copy()
            out[lacking] = new.indices.to_numpy() + known
        else:
            out = codes.to_numpy()
        self.used[out] = self.turn
        return out

    def _keep(self, rows: np.ndarray) -> None:
        """Forget all words but these."""
        sizes = self.sizes[rows]
        ends = np.cumsum(sizes, dtype=np.int32)
        self.flat = self.flat[np.repeat(self.begins[rows] - (ends - sizes), sizes) + np.arange(sizes.sum(), dtype=np.int32)]
        self.begins, self.sizes, self.used = ends - sizes, sizes, self.used[rows]
        self.words = self.words.take(pa.array(rows))

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Pieces of one kind go straight to the model; the rest through the whole tokenizer."""
        model = self.tokenizer.model
        out: list = [None] * len(words)
        rest = []
        for i, w in enumerate(words):
            if _PIECE(w):
                out[i] = array("i", [t.id for t in model.tokenize(w)]).tobytes()
            else:
                rest.append(i)
        for i, x in zip(rest, self._encode_whole([words[i] for i in rest]), strict=True):
            out[i] = x
        return out

    def _encode_whole(self, words: list[str]) -> list[bytes]:
        """Encode many words in a few calls; token offsets say which word a token is of."""
        out: list[bytes] = []
        groups = [words[i : i + 1000] for i in range(0, len(words), 1000)]
        for group, got in zip(groups, self.tokenizer.encode_batch([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            begin = np.cumsum([0] + [len(w) + 1 for w in group])
            of = np.searchsorted(begin, np.fromiter((o[0] for o in got.offsets), np.int64, len(got.ids)), "right") - 1
            cut = np.searchsorted(of, np.arange(len(group) + 1))
            ids = np.array(got.ids, np.int32)
            out += [ids[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
        return out
