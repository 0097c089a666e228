"""Where texts may hold one of very many terms: hashes of a text's substrings, looked up in a filter of the terms' hashes.

A substring's hash comes from running sums over the text's bytes, at the same cost for any length. Every place of a text is tried with the first bytes
of the terms (as many as the shortest has); what passes is tried with twice as many, and so on, and between two of these with each length that terms have.
Equal bytes have equal hashes, so the filter misses nothing; what it passes by chance is told from the terms by the join that follows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of a text that are looked at together: their sums stay in a core's cache.
PIECE = 1 << 17
_FACTOR, _MIX, _WHOLE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
_RNG = np.random.default_rng(1)
_VALUES = _RNG.integers(1, 1 << 64, 256, dtype=np.uint64)
_MASKS = np.bitwise_or.reduce(np.uint64(1) << _RNG.integers(0, 64, (3, 4096), dtype=np.uint64))


def starts_of(lengths: list[int]) -> list[int]:
    """The shortest length, twice that and so on, up to the longest."""
    out = [min(lengths)]
    while out[-1] * 2 <= max(lengths):
        out.append(out[-1] * 2)
    return out


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The factor's powers and their inverses, modulo 2 ** 64."""
    up, back = np.full(n, _FACTOR, dtype=np.uint64), np.full(n, pow(_FACTOR, -1, 1 << 64), dtype=np.uint64)
    up[:1], back[:1] = 1, 1
    return np.cumprod(up), np.cumprod(back)


def _sums(data: np.ndarray, up: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_VALUES[data] * up[: len(data)], out=out[1:])
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> 32
    h *= _MIX
    h ^= h >> 29
    return h


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A column's bytes in one run, and where each row begins in it, with the end."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    at = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def filter_words(batches: Iterator[pa.RecordBatch], starts: list[int], words: int) -> Iterator[pa.RecordBatch]:
    """Terms -> ``word, ones``: the bits that they and their first bytes set in a filter of so many words (a power of two)."""
    shift = 65 - words.bit_length()
    for batch in batches:
        for i in range(0, batch.num_rows, 1000):
            data, at = _bytes(batch.column(0).slice(i, 1000))
            up, back = _powers(len(data) + 1)
            sums, begin, size = _sums(data, up), at[:-1], np.diff(at)
            hashes = [_mixed((sums[at[1:]] - sums[begin]) * back[begin] + _WHOLE)]
            for n in starts:
                b = begin[size >= n]
                hashes.append(_mixed((sums[b + n] - sums[b]) * back[b]))
            h = np.unique(np.concatenate(hashes))
            yield pa.RecordBatch.from_arrays([pa.array((h >> shift).view(np.int64)), pa.array(_MASKS[h & 4095].view(np.int64))], ["word", "ones"])


def _places(data: np.ndarray, starts: list[int], lengths: list[int], known: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """Places of the bytes, and a length: what begins there and is as long passes the filter."""
    shift, longest = 65 - len(known).bit_length(), max(lengths)
    piece = max(PIECE, longest)
    up, back = _powers(min(len(data), piece + longest) + 1)

    def passes(h: np.ndarray) -> np.ndarray:
        mask = _MASKS[h & 4095]
        return known[h >> shift] & mask == mask

    for lo in range(0, len(data), piece):
        sums = _sums(data[lo : lo + piece + longest - 1], up)
        end, at = len(sums) - 1, None
        for start in starts:
            if at is None:
                n = max(0, min(piece, end - start + 1))
                at = np.flatnonzero(passes(_mixed((sums[start : start + n] - sums[:n]) * back[:n])))
            else:
                at = at[at + start <= end]
                at = at[passes(_mixed((sums[at + start] - sums[at]) * back[at]))]
            if not len(at):
                break
            for size in lengths:
                if start <= size < 2 * start:
                    own = at[at + size <= end]
                    yield lo + own[passes(_mixed((sums[own + size] - sums[own]) * back[own] + _WHOLE))], size


def may_hold(batches: Iterator[pa.RecordBatch], starts: list[int], lengths: list[int], known) -> Iterator[pa.RecordBatch]:
    """Texts (``_text``) -> the other columns and ``_term``: each distinct substring of a text that passes the filter, with all terms that it holds among them."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, at = _bytes(batch.column("_text"))
        raw, found = data.tobytes(), set()
        for place, size in _places(data, starts, lengths, known.value):
            row = np.searchsorted(at, place, side="right") - 1
            # within the row, from the first byte of a character to the last of another
            whole = (place + size <= at[row + 1]) & (data[place] & 0xC0 != 0x80)
            row, place = row[whole], place[whole]
            cut = (place + size < at[row + 1]) & (data[np.minimum(place + size, len(data) - 1)] & 0xC0 == 0x80)
            found.update((r, raw[p : p + size]) for r, p in zip(row[~cut].tolist(), place[~cut].tolist()))
        hits = sorted(found)
        rows = batch.take(pa.array([r for r, _ in hits], type=pa.int64())).drop_columns(["_text"])
        yield rows.append_column("_term", pa.array([t for _, t in hits], type=pa.binary()).cast(pa.string()))
