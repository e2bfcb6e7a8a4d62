"""Exact token ids of whitespace-delimited words, each distinct word encoded once.

No match of the tokenizer's split pattern holds white space and NFC never
composes across a space, so the ids of a text are the concatenation of the ids
of its ASCII-whitespace-delimited words. Words go to the tokenizer many at a
time, joined by spaces. The last token of each pre-token carries the end-of-word
mark, so the ids are dealt back to the words by their number of pre-tokens; if
the numbers do not agree, the words are sent again with a special token between
them as a fence.
"""

from __future__ import annotations

import os
from collections.abc import Iterable
from unicodedata import normalize

import numpy as np

FENCE = "<|startoftext|>"
PER_LINE, PER_CALL = 128, 8192
#: Fixed value: the split pattern of the file, without its white space part.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"


class WordIds:
    """``ids[word]``: the word's ids as little-endian unsigned 32-bit bytes or,
    if ``shown``, a pair of them and the tokens joined by spaces. Two generations of at most ``limit`` words and one slice are
    kept; a word that is used moves to the young one."""

    def __init__(self, path: str, limit: int = 300_000, shown: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.fence = self.tok.token_to_id(FENCE)
        if self.fence is None:
            raise ValueError(f"{path} has no special token {FENCE}")
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.token = [""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            self.token[i] = t
        mark = self.tok.model.end_of_word_suffix
        self.last = np.array([bool(mark) and t.endswith(mark) for t in self.token])
        self.pieces = regex.compile(SPLIT).findall
        self.limit, self.shown = limit, shown
        self.ids: dict[bytes, object] = {}
        self.old: dict[bytes, object] = {}

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, "<u4") for x in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _dealt(self, words: list[str]) -> list:
        """The ids of each word, PER_LINE words to a text."""
        lines = [words[k:k + PER_LINE] for k in range(0, len(words), PER_LINE)]
        got = self._encode([" ".join(x) for x in lines])
        count = np.array([1 if w.isalpha() else len(self.pieces((w if w.isascii() else normalize("NFC", w)).lower())) for w in words])
        flat = np.concatenate(got)
        ends = np.concatenate([[0], np.flatnonzero(self.last[flat]) + 1])
        upto = np.cumsum(count)
        border = upto[np.cumsum([len(x) for x in lines]) - 1]
        if border[-1] + 1 == len(ends) and (ends[border] == np.cumsum([len(g) for g in got])).all():
            hi = ends[upto].tolist()
            return self._cut(flat, [0, *hi[:-1]], hi)
        return [x for line in lines for x in self._fenced(line)]

    def _fenced(self, words: list[str]) -> list:
        got = self._encode([FENCE.join(words)])[0]
        at = np.flatnonzero(got == self.fence)
        return self._cut(got, [0, *(at + 1).tolist()], [*at.tolist(), len(got)])

    def _cut(self, ids: np.ndarray, lo: list[int], hi: list[int]) -> list:
        raw = ids.tobytes()
        out = [raw[4 * a:4 * b] for a, b in zip(lo, hi, strict=True)]
        if not self.shown:
            return out
        token = list(map(self.token.__getitem__, ids.tolist()))
        return list(zip(out, [" ".join(token[a:b]).encode() for a, b in zip(lo, hi, strict=True)], strict=True))

    def learn(self, words: Iterable[bytes]) -> None:
        """Put the words into the table."""
        plain = []
        for w in set(words):
            if w in self.ids:
                continue
            if (known := self.old.get(w)) is not None:
                self.ids[w] = known
            elif b"<|" in w:  # may hold a special token
                got = self._encode([w.decode()])[0]
                self.ids[w] = self._cut(got, [0], [len(got)])[0]
            else:
                plain.append(w)
        for k in range(0, len(plain), PER_CALL):
            part = plain[k:k + PER_CALL]
            self.ids.update(zip(part, self._dealt([w.decode() for w in part]), strict=True))

    def of(self, words: list[bytes]) -> list:
        """What the table holds for each word, learning those it lacks."""
        got = list(map(self.ids.get, words))
        lacking = [k for k, x in enumerate(got) if x is None]
        self.learn([words[k] for k in lacking])
        for k in lacking:
            got[k] = self.ids[words[k]]
        return got

    def trim(self) -> None:
        """Between slices: start a new generation if the young one is full."""
        if len(self.ids) > self.limit:
            self.old, self.ids = self.ids, {}
