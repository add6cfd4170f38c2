"""Exact tokenization by white-space chunks.

``word_bpe_49k`` never lets a token cross white space: its normalizer maps each
white-space run to one blank and its pre-tokenizer drops blanks.  The ids of a
text are therefore the ids of its white-space chunks in order, so a batch of
texts is split once, its *distinct* chunks are encoded, and the ids of the texts
are gathered with numpy.  Splitting uses ASCII white space only, a subset of
what the tokenizer treats as white space.  Words of Latin letters, with or
without one closing mark, have their merges applied by numpy, all at a time;
every other chunk (digits, marks, other scripts, other white space, special
strings) goes to the library as it stands.

Only one batch's distinct chunks are held at a time; nothing grows with the
corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts of one numpy pass take at most so many UTF-8 bytes (or are one text).
BATCH_BYTES = 16 << 20

_loaded: dict[str, object] = {}


def tokenizer(path: str):
    """The library's tokenizer for *path*, loaded once per Python worker."""
    if path not in _loaded:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


def slices(texts: pa.Array, limit: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts take at most *limit* bytes, one row at least."""
    size = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
    ends, start = np.cumsum(size), 0
    while start < len(size):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield start, stop
        start = stop


def _letter_class() -> str:
    """The letters below U+0250, which NFC leaves alone and which lower-case one by one (but U+0130)."""
    import unicodedata

    spans: list[list[int]] = []
    for c in range(0x250):
        if unicodedata.category(chr(c))[0] == "L" and c != 0x130:
            if spans and spans[-1][1] == c - 1:
                spans[-1][1] = c
            else:
                spans.append([c, c])
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in spans)


#: A chunk of letters, then ASCII marks or none: the tokenizer always parts the two.
_WORD = rf"^(?P<stem>[{_letter_class()}]+)(?P<marks>[!-/:-@\[-`{{-~]*)$"
#: Longer words than this (in bytes) are left to the library.
_WIDEST = 40


class _Merges:
    """The merge table of a byte-level BPE with word ends, for many words at a time.

    Each step merges, in every word that still has a mergeable pair, the pair of
    lowest rank (the leftmost of equals), as the library does one word at a time.
    """

    def __init__(self, path: str):
        import json

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        shown = {b: chr(b) for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
        hidden = (b for b in range(256) if b not in shown)
        shown |= {b: chr(256 + n) for n, b in enumerate(hidden)}
        self.inner = np.array([vocab[shown[b]] for b in range(256)], np.int32)
        self.final = np.array([vocab[shown[b] + end] for b in range(256)], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        key = (left << 17) | right
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.made = key[order], order.astype(np.int32), made
        self.none = np.int32(len(pairs))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.int64) << 17) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], self.none)

    def encode(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols (one row a word, -1 past its end) and their number; all words have one byte at least."""
        wide = int(lengths.max())
        at = np.arange(wide)
        byte = data[np.minimum(starts[:, None] + at, len(data) - 1)]
        symbols = np.where(at < lengths[:, None] - 1, self.inner[byte], np.where(at == lengths[:, None] - 1, self.final[byte], -1)).astype(np.int32)
        n = lengths.copy()
        out = np.full((len(n), wide), -1, np.int32)
        rows = np.arange(len(n))
        ranks = self.rank(symbols[:, :-1], symbols[:, 1:]) if wide > 1 else np.zeros((len(n), 0), np.int32)
        ranks = np.concatenate([ranks, np.full((len(n), 1), self.none)], 1)
        while len(rows):
            best = ranks.argmin(1)
            lowest = ranks[np.arange(len(rows)), best]
            more = lowest < self.none
            if not more.all():
                out[rows[~more], : symbols.shape[1]] = symbols[~more]
                rows, symbols, ranks, best, lowest = rows[more], symbols[more], ranks[more], best[more], lowest[more]
                if not len(rows):
                    break
            line, w = np.arange(len(rows)), symbols.shape[1]
            take = np.arange(w - 1)
            take = take + (take > best[:, None])
            symbols = np.take_along_axis(symbols, take, 1)
            symbols[line, best] = self.made[lowest]
            ranks = np.take_along_axis(ranks, np.minimum(take, w - 1), 1)
            n[rows] -= 1
            before = np.maximum(best - 1, 0)
            after = np.minimum(best + 1, w - 2)
            ranks[line, best] = np.where(best < w - 2, self.rank(symbols[line, best], symbols[line, after]), self.none)
            ranks[line, before] = np.where(best > 0, self.rank(symbols[line, before], symbols[line, best]), ranks[line, before])
        return out, n


def _merges(path: str) -> _Merges:
    if ("merges", path) not in _loaded:
        _loaded["merges", path] = _Merges(path)
    return _loaded["merges", path]


def _buffers(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a large_string array."""
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = words.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8), offsets


def _encode_letters(path: str, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids and their numbers of lower-case words of letters of at most _WIDEST bytes."""
    data, offsets = _buffers(words)
    lengths = np.diff(offsets)
    counts = np.zeros(len(words), np.int64)
    done = []
    low = 0
    for high in (8, 12, 18, _WIDEST):
        own = np.flatnonzero((lengths > low) & (lengths <= high))
        low = high
        if len(own):
            symbols, n = _merges(path).encode(data, offsets[:-1][own], lengths[own])
            counts[own] = n
            done.append((own, symbols, n))
    ids = np.empty(int(counts.sum()), np.uint32)
    starts = np.cumsum(counts) - counts
    for own, symbols, n in done:
        ids[spread(starts[own], n)] = symbols[symbols >= 0]
    return ids, counts


def encode_chunks(path: str, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all *chunks* in order, and how many each has."""
    short = np.asarray(pc.binary_length(chunks)) <= _WIDEST
    parts = pc.extract_regex(chunks, _WORD)
    word = np.asarray(parts.is_valid()) & short
    others = chunks.filter(pa.array(~word)).to_pylist()
    parts = parts.filter(pa.array(word))
    stems = pc.utf8_lower(parts.field("stem")).dictionary_encode()
    marks = parts.field("marks").dictionary_encode()
    ids, n_stem = _encode_letters(path, stems.dictionary)
    tok = tokenizer(path)
    names = [*marks.dictionary.to_pylist(), *others]
    extra = [np.array(tok.encode(x, add_special_tokens=False).ids, np.uint32) for x in names]
    pool = np.concatenate([ids, *extra])
    n = np.concatenate([n_stem, np.array([len(x) for x in extra], np.int64)])
    starts = np.cumsum(n) - n
    base = len(n_stem)
    first = np.empty(len(chunks), np.int64)
    second = np.full(len(chunks), -1, np.int64)
    first[word] = np.asarray(stems.indices)
    first[~word] = base + len(marks.dictionary) + np.arange(len(others))
    second[word] = base + np.asarray(marks.indices)
    both = np.stack([first, second], 1).ravel()
    has = both >= 0
    unit = both[has]
    n_unit = n[unit]
    out = pool[spread(starts[unit], n_unit)]
    per = np.zeros(len(both), np.int64)
    per[has] = n_unit
    return out, per.reshape(-1, 2).sum(1)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[i] .. starts[i]+lengths[i]-1 of all i, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct ASCII-white-space chunks of all texts, the number of each chunk in order, and where each text begins and ends."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(texts)
    words = lists.values if lists.offset == 0 else lists.flatten()
    coded = words.dictionary_encode()
    bounds = np.asarray(lists.offsets, dtype=np.int64)
    return coded.dictionary, np.asarray(coded.indices), bounds - bounds[0]


def count_tokens(path: str, texts: pa.Array) -> np.ndarray:
    """How many tokens each text has; null counts as empty."""
    chunks, index, bounds = split(texts)
    _, per = encode_chunks(path, chunks)
    ends = np.concatenate(([0], np.cumsum(per[index])))
    return ends[bounds[1:]] - ends[bounds[:-1]]


def encode_texts(path: str, texts: pa.Array, closing: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in order (uint32), with *closing* after each, and where each text ends."""
    chunks, index, bounds = split(texts)
    pool, per = encode_chunks(path, chunks)
    starts = np.cumsum(per) - per
    n = per[index]
    ids = pool[spread(starts[index], n)]
    ends = np.concatenate(([0], np.cumsum(n)))[bounds[1:]]
    if closing is not None:
        ids = np.insert(ids, ends, closing)
        ends = ends + np.arange(1, len(ends) + 1)
    return ids, ends
