"""Exact word-wise encoding with a memo: shared by the operators that run a BPE vocabulary over whole texts.

A byte-level BPE vocabulary never merges across pre-tokens, and no pre-token runs from a non-space character into a
space. So a text without two white-space characters in a row can be cut before each single space, each piece be
encoded on its own, and the ids be put together again. Other texts are encoded in one go.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries of a worker's memo before it starts afresh, keeping those before as an older one whose entries come back
#: when they are asked for (bounds its memory, never the result).
MEMO_ENTRIES = 600_000
#: Pieces longer than this are not kept in the memo.
MEMO_CHARS = 48
#: Characters of texts that are cut into pieces at once.
GROUP_CHARS = 1 << 23
#: Words that are encoded as one text (more take more memory, and more time a word).
AT_ONCE = 8192

_RUN = re.compile(r"\s\s")


class PieceEncoder:
    """Texts -> bytes of their ids.

    ``whole`` encodes texts as they are. ``spaced`` encodes words that all follow a single space, none of which holds
    a space or has white space at an end.
    """

    def __init__(self, whole: Callable[[list[str]], list[bytes]], spaced: Callable[[list[str]], list[bytes]],
                 entries: int = MEMO_ENTRIES, group_chars: int = GROUP_CHARS, at_once: int = AT_ONCE):
        self._whole, self._spaced, self._entries, self._group_chars = whole, spaced, entries, group_chars
        self._at_once = at_once
        self._memo: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def __call__(self, texts: list[str]) -> list[bytes]:
        out, at = [], 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) <= self._group_chars):
                size += len(texts[to])
                to += 1
            out += self._group(texts[at:to])
            at = to
        return out

    def forget(self) -> None:
        """Give the memo's memory back."""
        self._memo, self._old = {}, {}

    def _group(self, texts: list[str]) -> list[bytes]:
        cut = [bool(t) and not (t[-1].isspace() or t[0] == " " or _RUN.search(t)) for t in texts]
        words = pc.split_pattern(pa.array([t if c else "" for t, c in zip(texts, cut)], pa.large_string()), " ")
        at = words.offsets.to_numpy()
        words = words.flatten().dictionary_encode()
        # The first word of a text has no space before it: it is encoded by itself, as are texts that can't be cut.
        firsts = [t[:t.find(" ")] if c and " " in t else t for t, c in zip(texts, cut)]
        distinct = words.dictionary.to_pylist()
        pieces = self._pieces(distinct) + self._whole(firsts)
        index = words.indices.to_numpy().astype(np.int64)
        index[at[:-1]] = len(distinct) + np.arange(len(texts))
        found = pa.array(pieces, pa.large_binary()).take(pa.array(index))
        _, offsets, data = found.buffers()
        ends = np.frombuffer(offsets, np.int64, len(found) + 1)[at].tolist()
        data = memoryview(data)
        return [bytes(data[a:b]) for a, b in zip(ends, ends[1:])]

    def _pieces(self, words: list[str]) -> list[bytes]:
        if len(self._memo) > self._entries:
            self._old, self._memo = self._memo, {}
        memo, old, extra, missing = self._memo, self._old, {}, []
        for w in words:
            if w not in memo:
                if w in old:
                    memo[w] = old[w]
                elif w:
                    missing.append(w)
        for at in range(0, len(missing), self._at_once):
            some = missing[at:at + self._at_once]
            for word, ids in zip(some, self._spaced(some)):
                (memo if len(word) <= MEMO_CHARS else extra)[word] = ids
        memo[""] = b""  # stands for texts without words only
        if extra:
            return [extra[w] if w in extra else memo[w] for w in words]
        return list(map(memo.__getitem__, words))
