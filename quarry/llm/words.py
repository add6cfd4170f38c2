"""What the text models share: labelled samples of a bounded size, and words looked up once per batch."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import chunk_tokens
from quarry.runtime import forget, stored


#: Texts of one pass of a model take at most so many UTF-8 bytes (or are one text): values per word are held for a pass.
PASS_BYTES = 8 << 20


def remainder(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo *n*; a null id counts as the text ''."""
    return F.pmod(F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")), F.lit(n))


def sample(labelled: DataFrame, rows: int, key: str, size: int | None = None, text: str | None = None) -> DataFrame:
    """About *rows* rows of *labelled*, with about *size* bytes in *text* if given, the same at each run: those whose hash of *key* is low enough; all if there are no more."""
    nbytes = F.sum(F.octet_length(text).cast("long")) if size is not None else F.lit(0)
    total, whole = labelled.agg(F.count("*"), F.coalesce(nbytes, F.lit(0))).first()
    share = min(rows / max(total, 1), size / max(whole, 1) if size is not None else 1)
    if share >= 1:
        return labelled
    return labelled.where(F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30)))


def within(rows: DataFrame, size: int) -> DataFrame:
    """As many of *rows* (text, place and more) as take *size* UTF-8 bytes in all: whole texts in order of place; the driver sees one number a row."""
    total, last = 0, None
    for place, n in sorted((r.place, r.n) for r in rows.select("place", F.octet_length("text").alias("n")).collect()):
        total += n
        if total > size:
            break
        last = place
    return rows.where(F.col("place") <= last) if last is not None else rows.limit(0)


def collected(rows: DataFrame, size: int) -> pa.Table:
    """The sampled *rows* (id, text and more) on the driver, in an order of their own that is the same at each run.

    Only as many as take *size* UTF-8 bytes in all: whole texts, by a hash of the
    id; the driver sees one number a row before it gets a text.
    """
    rows = stored(rows.withColumn("place", F.xxhash64("id", F.lit("place"))), "sample")
    table = within(rows, size).orderBy("place", F.xxhash64("text"), *(c for c in rows.columns if c not in ("id", "text", "place"))).toArrow()
    forget(rows)
    return table


def one_array(table: pa.Table, column: str) -> pa.Array:
    found = table[column].combine_chunks()
    return pa.concat_arrays(found.chunks) if isinstance(found, pa.ChunkedArray) and found.num_chunks else found


def batches_of_words(texts: pa.Array, limit: int = PASS_BYTES) -> Iterator[tuple[int, int, list[str], np.ndarray, np.ndarray]]:
    """(first row, end row, distinct chunks, chunk number of each word, where each text's words begin and end) in passes of at most *limit* bytes."""
    for a, b in chunk_tokens.slices(texts, limit):
        names, index, bounds = chunk_tokens.split(texts.slice(a, b - a))
        yield a, b, names.to_pylist(), index, bounds


#: Characters below this one, but for U+0130, are told and lower-cased one by one.
PLAIN = 0x250
_LETTER, _ALNUM = (np.array([f(chr(c)) for c in range(PLAIN)]) for f in (str.isalpha, str.isalnum))
_LOWER = np.array([ord(chr(c).lower()[0]) for c in range(PLAIN)], np.uint32)


def _strings(codes: np.ndarray, length: np.ndarray) -> pa.Array:
    """The strings of the given numbers of characters below U+0800, from all their code points."""
    wide = np.concatenate(([0], np.cumsum(codes >= 0x80)))
    ends = np.cumsum(length)
    offsets = np.concatenate(([0], ends + wide[ends]))
    return pa.Array.from_buffers(pa.large_string(), len(length), [None, pa.py_buffer(offsets), pa.py_buffer(codes.tobytes().decode("utf-32-le").encode())])


def _points(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all strings of a large_string array one after another, and where each begins (and the end)."""
    data, bounds = chunk_tokens._buffers(strings)
    data, bounds = data[bounds[0] : bounds[-1]], bounds - bounds[0]
    if not (data >= 128).any():
        return data.astype(np.uint32), bounds
    first = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32), first[bounds]


def _plain(names: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The code points of all chunks, with zeros for those of chunks that are not of plain characters alone; where each begins (and the end); which are plain."""
    codes, bounds = _points(names)
    odd = np.concatenate(([0], np.cumsum((codes >= PLAIN) | (codes == 0x130))))
    plain = odd[bounds[1:]] == odd[bounds[:-1]]
    if not plain.all():
        codes = np.where(np.repeat(plain, np.diff(bounds)), codes, np.uint32(0))
    return codes, bounds, plain


def letter_runs(names: pa.Array, split) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of all chunks: the distinct ones, the number of each word chunk by chunk, and how many each chunk has.

    A plain chunk's words are its runs of letters in lower case, found for all
    at once; *split* gives those of any other chunk.
    """
    codes, bounds, plain = _plain(names)
    letter = _LETTER[codes]
    begins = letter.copy()
    begins[1:] &= ~letter[:-1]
    inner = bounds[:-1][bounds[:-1] < len(codes)]
    begins[inner] = letter[inner]
    before = np.concatenate(([0], np.cumsum(begins)))
    number = before[bounds[1:]] - before[bounds[:-1]]
    size = np.add.reduceat(letter, np.flatnonzero(begins), dtype=np.int64) if begins.any() else np.zeros(0, np.int64)
    found = _strings(_LOWER[codes[letter]], size)
    if not plain.all():
        others = [split(x) for x in names.filter(pa.array(~plain)).to_pylist()]
        more = pa.array([w for x in others for w in x], pa.large_string())
        number[~plain] = [len(x) for x in others]
        own = np.repeat(plain, number)
        at = np.empty(len(own), np.int64)
        at[own], at[~own] = np.arange(len(found)), len(found) + np.arange(len(more))
        found = pa.concat_arrays([found, more]).take(pa.array(at))
    coded = found.dictionary_encode()
    return coded.dictionary, np.asarray(coded.indices), number


def letters_and_digits(names: pa.Array) -> pa.Array:
    """Each chunk's letters and digits in lower case, or the whole chunk if it has none."""
    codes, bounds, plain = _plain(names)
    kept = _ALNUM[codes]
    before = np.concatenate(([0], np.cumsum(kept)))
    length = np.diff(bounds)
    number = before[bounds[1:]] - before[bounds[:-1]]
    number = np.where(plain, np.where(number == 0, length, number), 0)
    kept |= np.repeat(number == length, length)
    shown = _strings(_LOWER[codes[kept]], number)
    if not plain.all():
        others = np.flatnonzero(~plain)
        more = [((x if x.isalnum() else "".join(filter(str.isalnum, x))) or x).lower() for x in names.take(pa.array(others)).to_pylist()]
        at = np.arange(len(names))
        at[others] = len(names) + np.arange(len(others))
        shown = pa.concat_arrays([shown, pa.array(more, pa.large_string())]).take(pa.array(at))
    return shown


def digests(strings: pa.Array, digest) -> np.ndarray:
    """*digest* of the UTF-8 bytes of each string."""
    data, bounds = chunk_tokens._buffers(strings)
    whole, at = data[bounds[0] : bounds[-1]].tobytes(), (bounds - bounds[0]).tolist()
    return np.array(list(map(digest, map(whole.__getitem__, map(slice, at, at[1:])))), np.uint64)


def codes(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all strings one after another, and how many each has."""
    points, bounds = _points(strings)
    return points.astype(np.uint64), np.diff(bounds)


def marked(codes: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all strings with a mark before and after each, and how many each has then."""
    ends = np.cumsum(length + 2)
    out = np.empty(len(codes) + 2 * len(length), np.uint64)
    out[ends - length - 2], out[ends - 1] = ord("^"), ord("$")
    out[chunk_tokens.spread(ends - length - 1, length)] = codes
    return out, length + 2


def sums(values: np.ndarray, index: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each text, the sum over its words of values[chunk number]; zero for a text without words."""
    out = np.zeros((len(bounds) - 1, values.shape[1]))
    some = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(some):
        out[some] = np.add.reduceat(values[index], bounds[some], axis=0)
    return out


def prefix_keys(codes: np.ndarray, length: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit keys of the first *size* characters of each word that is longer, from all code points, and which words those are."""
    longer = np.flatnonzero(length > size)
    starts = (np.cumsum(length) - length)[longer]
    h = np.full(len(longer), size, np.uint64)
    for k in range(size):
        h = (h ^ (h >> np.uint64(29))) * _MIX + codes[starts + k]
    return h * _MIX, longer


def hash32(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass"))


_MIX = np.uint64(0x9E3779B97F4A7C15)


def gram_keys(shown: list[str], size: int, inner: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit keys of the *size*-grams of all words one after another, and how many each word has.

    Worked out for all words at once from their code points; with *inner* the
    first and last character of each word, its marks, are left out.
    """
    codes = np.frombuffer("".join(shown).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return code_keys(codes, np.fromiter(map(len, shown), np.int64, len(shown)), size, inner)


def code_keys(codes: np.ndarray, length: np.ndarray, size: int, inner: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """As gram_keys(), from all words' code points and how many each word has."""
    starts = np.cumsum(length) - length
    if inner:
        starts, length = starts + 1, length - 2
    number = np.maximum(length - size + 1, 0)
    h = np.zeros(max(len(codes) - size + 1, 0), np.uint64)
    for k in range(size):
        h = (h ^ (h >> np.uint64(29))) * _MIX + codes[k : k + len(h)]
    return (h * _MIX)[chunk_tokens.spread(starts, number)], number
