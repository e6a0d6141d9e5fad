"""Token ids of whole texts by the tokenizers library, one chunk between white space at a time.

The tokenizer's own rules never join characters across white space, so the ids of a text are the ids of its chunks in
order.  Of each bounded batch of texts only the distinct chunks are encoded.  Words of Latin-1 letters go to the file's
BPE model in lower case, without the normaliser and the regex, which leave such words as they are but for their case;
all other chunks go through the whole tokenizer as they stand, since special tokens are told apart by case.

Defined cases: null and empty texts have no ids; a text of any length is one batch if it is longer than BATCH_BYTES, so
a worker holds some multiples of its longest text; texts are taken in their order, and repeated ones get equal ids.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BATCH_BYTES = 18 << 20
ODD = 120_000
WORDS = 1_000_000  # words whose ids a worker keeps from one batch to the next, some 40 MB
LETTERS = "[A-Za-zÀ-ÖØ-öø-ÿ]+"  # the tokenizer takes all of them for letters and puts them in lower case
_BYTES = str.maketrans({c: "".join(map(chr, chr(c).encode())) for c in range(0xC0, 0x100)})  # letters beyond ASCII as their bytes
_SHIFT = str.maketrans({b: 289 + b - 0x7F for b in range(0x7F, 0xA1)} | {0xAD: 323})  # byte-level alphabet: bytes that do not print


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Encodes arrays of texts to little-endian 32-bit ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)  # ids that end a word
        self.ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self.odd: dict[str, np.ndarray] = {}
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.string())
        self.flat, self.starts, self.sizes = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """flat ids, and the start and number of ids of each distinct word of letters; only new words are encoded."""
        place = pc.index_in(words, value_set=self.known)
        if len(self.known) + place.null_count > WORDS:
            self._forget()
            place = pc.index_in(words, value_set=self.known)
        at = place.fill_null(-1).to_numpy().astype(np.int64)
        new = at < 0
        if new.any():
            at[new] = len(self.known) + np.arange(int(new.sum()))
            fresh = words.filter(pa.array(new))
            flat, starts, sizes = self._new_words(fresh)
            self.starts, self.sizes = np.r_[self.starts, starts + len(self.flat)], np.r_[self.sizes, sizes]
            self.flat, self.known = np.r_[self.flat, flat], pa.concat_arrays([self.known, fresh])
        return self.flat, self.starts[at], self.sizes[at]

    def _new_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        plain = pc.string_is_ascii(words).to_numpy(zero_copy_only=False)
        order = np.r_[np.flatnonzero(plain), np.flatnonzero(~plain)]
        ids, split = [np.empty(0, np.uint32)], int(plain.sum())
        for cut in [*range(0, split, 4000), *range(split, len(order), 4000)]:
            stop = min(cut + 4000, split if cut < split else len(order))
            joined = " ".join(words.take(pa.array(order[cut:stop])).to_pylist())
            if cut >= split:
                joined = joined.translate(_BYTES).translate(_SHIFT)
            ids.append(np.array(self.words.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32))
        flat = np.concatenate(ids)
        ends = np.flatnonzero(self.ends[flat]) + 1
        starts, sizes = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        sizes[order] = np.diff(np.r_[0, ends])
        starts[order] = np.r_[0, ends[:-1]] if len(ends) else ends
        return flat, starts, sizes

    def _others(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for any chunks, by the whole tokenizer."""
        if len(self.odd) > ODD:
            self.odd.clear()
        new = [c for c in chunks if c not in self.odd]
        for c, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
            self.odd[c] = np.array(e.ids, np.uint32)
        got = [self.odd[c] for c in chunks]
        return np.concatenate([np.empty(0, np.uint32), *got]), np.fromiter(map(len, got), np.int64, len(got))

    def _chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """flat ids, and the start and number of ids of each distinct chunk."""
        word = pc.match_substring_regex(chunks, f"^{LETTERS}$")
        marked = pc.match_substring_regex(chunks, f"^{LETTERS}[,.]$")  # two pieces to the tokenizer as well
        is_marked = np.flatnonzero(marked.to_numpy(zero_copy_only=False))
        is_word = np.flatnonzero(word.to_numpy(zero_copy_only=False))
        is_other = np.flatnonzero(pc.invert(pc.or_(word, marked)).to_numpy(zero_copy_only=False))
        both = chunks.take(pa.array(is_marked))
        stems = pa.concat_arrays([chunks.take(pa.array(is_word)), pc.utf8_slice_codeunits(both, 0, -1)])
        coded = pc.utf8_lower(stems).dictionary_encode()
        flat, starts, sizes = self._words(coded.dictionary)
        stem = coded.indices.to_numpy()
        # a marked word is its stem's ids and the mark's id
        comma, point = self._others([",", "."])[0].tolist()
        own, base = stem[: len(is_word)], stem[len(is_word) :]
        size = sizes[base] + 1
        ends = np.cumsum(size)
        extra = flat[np.minimum(np.repeat(starts[base] - ends + size, size) + np.arange(size.sum()), len(flat) - 1)] if len(base) else np.empty(0, np.uint32)
        extra[ends - 1] = np.where(pc.ends_with(both, ",").to_numpy(zero_copy_only=False), comma, point)
        rest, counts = self._others(chunks.take(pa.array(is_other)).to_pylist())
        start, count = np.empty(len(chunks), np.int64), np.empty(len(chunks), np.int64)
        start[is_word], count[is_word] = starts[own], sizes[own]
        start[is_marked], count[is_marked] = len(flat) + ends - size, size
        start[is_other], count[is_other] = len(flat) + len(extra) + np.cumsum(counts) - counts, counts
        return np.concatenate([flat, extra, rest]), start, count

    def __call__(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text; Arrow tells the chunks apart, and only distinct ones of a batch are encoded."""
        out: list[bytes] = []
        texts = pc.fill_null(texts, "")
        filled = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(texts):
            before = filled[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(filled, before + BATCH_BYTES, side="right")))
            out += self._batch(texts.slice(at, stop - at))
            pa.default_memory_pool().release_unused()
            at = stop
        return out

    def _batch(self, texts: pa.Array) -> list[bytes]:
        part = texts  # in their own case: special tokens are told apart by it
        for mark in "\n\t\r":
            part = pc.replace_substring(part, mark, " ")
        rows = pc.split_pattern(part, " ")
        counts = pc.list_value_length(rows).to_numpy(zero_copy_only=False)
        coded = rows.flatten().dictionary_encode()
        del part, rows
        flat, starts, sizes = self._chunks(coded.dictionary)
        word = coded.indices.to_numpy()
        size = sizes.astype(np.int32)[word]  # a batch has far fewer ids than 2**31
        ends = np.cumsum(size, dtype=np.int32)
        bounds = np.r_[0, ends][np.r_[0, np.cumsum(counts)]]
        place = starts.astype(np.int32)[word]
        place -= ends
        place += size
        place = np.repeat(place, size)
        del word, size, ends, coded
        place += np.arange(len(place), dtype=np.int32)
        ids = flat.astype("<u4")[place]
        return [ids[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
