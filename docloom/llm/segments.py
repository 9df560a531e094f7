"""Texts cut into segments that public tokenizers encode one by one.

A segment is a space with what follows up to the next cut.  A text is cut before a space that
follows a character other than white space: the byte-level tokenizer's pattern never lets a
token cross such a place, and no piece of the other vocabulary has its space mark behind
another character, so no merge crosses it either.  The tokens of a text are therefore those of
its segments in a row, and a segment that occurs again needs not be encoded again.
"""

from __future__ import annotations

import base64
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc

from .bytevec import as_bytes

#: A worker forgets its segments beyond so many, or beyond so many bytes of them.
KEPT_SEGMENTS, KEPT_BYTES = 1 << 19, 24 << 20
#: Texts below this character are encoded from the rank file, which is the same vocabulary.
LATIN_END = "ɐ"
#: White space that some versions of the pattern count and str.isspace does not.
ODD_SPACE = frozenset("᠎​﻿")


def byte_bpe_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def byte_ranks_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def piece_bpe_path() -> str:
    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=2)
def byte_bpe(path: str, ranks_path: str | None) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
    """A function that gives the ids of segments, one after the other, and how many each has.

    ``path`` is the tokenizer file.  ``ranks_path`` names a rank file of the same vocabulary,
    which is quicker on Latin letters; without it all segments go one way."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True

    def one_by_one(texts: list[str]) -> list[list[int]]:
        return [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]

    if ranks_path is None:
        return lambda texts: flattened(one_by_one(texts))
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    width = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, number in ranks.items():
        width[number] = len(token)

    def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = "".join(texts)
        if joined and max(joined) < LATIN_END:
            # segments are cut where tokens end, so all are encoded as one text; where the
            # ends do not meet (a segment closes with white space), one by one
            ids = np.array(quick.encode_ordinary(joined), np.int64)
            sizes = byte_lengths(texts)
            ends, want = np.cumsum(width[ids]), np.cumsum(sizes)
            at = np.searchsorted(ends, want)
            if at[-1] < len(ends) and (ends[at] == want).all():
                return ids, np.diff(at + 1, prepend=0)
        return flattened([quick.encode_ordinary(t) if t and max(t) < LATIN_END else whole.encode(t, add_special_tokens=False).ids for t in texts])

    return encode


def byte_lengths(texts: list[str]) -> np.ndarray:
    return np.asarray(pc.binary_length(pa.array(texts, pa.large_string())), dtype=np.int64)


def flattened(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter((i for x in lists for i in x), np.int64, int(sizes.sum())), sizes


def grown(array: np.ndarray, more: np.ndarray, used: int) -> np.ndarray:
    """``array`` with ``more`` written from ``used`` on; its room doubles when it is full."""
    need = used + len(more)
    if need > len(array):
        wider = np.zeros(max(need, 2 * len(array), 1024), array.dtype)
        wider[:used] = array[:used]
        array = wider
    array[used:need] = more
    return array


class Lists:
    """Numbered lists of numbers in one flat array."""

    def __init__(self, dtype) -> None:
        self.flat, self.start, self.n = np.zeros(0, dtype), np.zeros(1, np.int64), 0

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        used = int(self.start[self.n])
        self.flat = grown(self.flat, flat, used)
        self.start = grown(self.start, used + np.cumsum(sizes), self.n + 1)
        self.n += len(sizes)

    def sizes(self, codes: np.ndarray) -> np.ndarray:
        return self.start[codes + 1] - self.start[codes]

    def gather(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists of ``codes`` one after the other, and where each begins (one more)."""
        sizes = self.sizes(codes)
        begin = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
        at = np.arange(begin[-1]) + np.repeat(self.start[codes] - begin[:-1], sizes)
        return self.flat[at], begin


class Segments:
    """Numbers the segments of texts.

    ``learn(strings)`` is called with new ones in the order of their numbers.  Those of the
    first call kind close with a character that lets the next one follow directly.
    ``lead``: every text counts as having a space before it.  Without it a text's first segment
    is learnt as it stands.  ``forget()`` is called before the numbering starts anew.
    """

    def __init__(self, learn: Callable[[list[str]], None], forget: Callable[[], None], lead: bool) -> None:
        self.learn, self.forget, self.lead = learn, forget, lead
        self.clear()

    def clear(self) -> None:
        self.inner: dict[str, int] = {}
        self.first: dict[str, int] = {}
        self.n = self.bytes = 0
        self.forget()

    def _numbers(self, strings: list[str], table: dict[str, int], prefix: str) -> np.ndarray:
        found = list(map(table.get, strings))
        new = list({s: None for s, n in zip(strings, found, strict=True) if n is None})
        if new:
            fits = closing(pa.array(new, pa.large_string()), new)
            if not fits.all():
                split = [s for s, ok in zip(new, fits, strict=True) if ok], [s for s, ok in zip(new, fits, strict=True) if not ok]
            else:
                split = new, []
            for some in split:
                if some:
                    self.learn([prefix + s for s in some])
                    table.update(zip(some, range(self.n, self.n + len(some)), strict=True))
                    self.n += len(some)
            self.bytes += sum(map(len, new))
            found = list(map(table.__getitem__, strings))
        return np.array(found, np.int64)

    def codes(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Segment numbers of all ``texts`` in a row, and where each text's begin (one more).

        Null counts as empty; a text has one segment at least."""
        if self.n > KEPT_SEGMENTS or self.bytes > KEPT_BYTES:
            self.clear()
        parts = pc.split_pattern(texts.fill_null("").cast(pa.large_string()), " ")
        offsets = np.asarray(parts.offsets, dtype=np.int64)
        offsets = offsets - offsets[0]
        coded = parts.flatten().dictionary_encode()
        words, at = coded.dictionary.to_pylist(), np.asarray(coded.indices, dtype=np.int64)
        closed = closing(coded.dictionary, words)
        starts = np.ones(len(at), bool)
        starts[1:] = closed[at[:-1]]
        starts[offsets[:-1]] = True
        head = np.flatnonzero(starts)
        tail = np.append(head[1:], len(at))
        begin = np.searchsorted(head, offsets)
        own = tail - head == 1
        if not self.lead:
            own[begin[:-1]] = False
        code = self._numbers(words, self.inner, " ")[at[head]]
        rest = np.flatnonzero(~own)
        strings = [" ".join(words[w] for w in at[head[i] : tail[i]]) for i in rest]
        if self.lead:
            code[rest] = self._numbers(strings, self.inner, " ")
        else:
            is_first = np.zeros(len(head), bool)
            is_first[begin[:-1]] = True
            for table, prefix, mine in ((self.first, "", is_first[rest]), (self.inner, " ", ~is_first[rest])):
                code[rest[mine]] = self._numbers([s for s, m in zip(strings, mine, strict=True) if m], table, prefix)
        return code, begin


def closes(word: str) -> bool:
    """Whether a cut may follow ``word``."""
    return bool(word) and not word[-1].isspace() and word[-1] not in ODD_SPACE


def closing(column: pa.Array, words: list[str]) -> np.ndarray:
    """``closes`` of each word; only those with an uncommon last byte are looked at one by one."""
    buf, offsets = as_bytes(column)
    some = np.diff(offsets) > 0
    last = np.zeros(len(words), np.uint8)
    last[some] = buf[offsets[1:][some] - 1]
    out = (last > 0x20) & (last < 0x7F)
    for i in np.flatnonzero(~out & some):
        out[i] = closes(words[i])
    return out


def text_runs(column: pa.Array, limit: int) -> list[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes of text together."""
    sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64))
    out, lo = [], 0
    while lo < len(sizes):
        before = sizes[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(sizes, before + limit, side="right")))
        out.append((lo, hi))
        lo = hi
    return out
