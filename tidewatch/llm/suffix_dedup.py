"""Suffix-array deduplication by prefix-free parsing.

A byte goes if it is covered by a string of `WINDOW` = 50 bytes that also starts in a document with a smaller id; strings are judged on the
input. Texts are parsed into phrases by triggers of a rolling hash: a string of `SEED` bytes triggers if its hash is the smallest of those of
some 50 bytes around it. So every 50 bytes hold a trigger, what follows from the bytes alone, and equal 50-byte strings have
a trigger at the same place. Phrases run from trigger to trigger and overlap in the trigger, as prefix-free parsing wants.

1. The parse: each row's triggers (hashes) are dealt out by hash, packed per batch of rows; a batch asks with the first and the last row
   of a trigger. A trigger that only one row has can't lie in a repeated string.
2. The dictionary: for each repeated trigger the distinct phrases around it (the bytes that 50-byte strings reach in which this trigger
   is the smallest, so that each string is looked at once) go to one place, once per batch, with their smallest id.
3. The suffix arrays: at that place the dictionary's phrases, read from the trigger towards the front, are put in order with their longest
   common parts, and so is what follows the trigger in the parse, towards the end. For each place where a string may begin, the
   interval of the first array names the suffix of the phrase, that of the second the strings that continue it; both together are the order of the
   corpus's suffixes behind that trigger, to a depth of 50 bytes. Neighbours of one interval pair hold the same bytes (no hash decides), and the
   smallest id among them keeps the string.
4. Every row takes back the stretches it loses and cuts them from its text.

The order is kept trigger by trigger and isn't joined into one array of the whole corpus: only neighbours that agree on 50 bytes matter, and
they share a trigger. A place that gets more than `HOLD` phrases (a trigger in very many surroundings) passes them on; they are dealt
out again by the 46 bytes that strings from five neighbouring beginnings share, and where that is still too many, string by string to a Spark aggregate.

Defined results: null and empty texts have no bytes and lose none; rows without an id neither lose nor claim anything; rows that
repeat an id don't lose bytes to each other (no smaller id), whether their texts agree or not; ids that aren't integers count in their
sort order; a cut may split a character, `kept_text` then leaves the broken one out, digests are of the exact bytes; kept columns that are
named like a result give way to it. Memory is about 100 bytes for each byte of the longest text of a task, 4 MB at least.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tidewatch.llm.common import STEP_BYTES, cut_by, flat, keepable, mapped, mixed, partitions, release, settled, stored, text_steps

WINDOW, SEED = 50, 16
REACH = WINDOW - SEED  # bytes on either side of a trigger that a window with it can reach
SPAN = WINDOW + REACH  # a trigger with its reach
#: Triggers and phrases that are gathered before they are dealt out (each is asked for once).
PARSE_TRIGGERS, PHRASES = 600_000, 150_000
#: Text bytes that a bucket of triggers stands for, phrases that one task holds, phrases that are put in order at once.
BUCKET, HOLD, SORT = 32 << 20, 1_500_000, 100_000
#: Neighbouring beginnings that are judged together where a trigger is too frequent.
STARTS = 5
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_BYTES = mixed(np.arange(7, 263, dtype=np.uint64))
_BASE = np.uint64(0xC2B2AE3D27D4EB4F)


def _slide(x: np.ndarray, n: int, best: np.ufunc) -> np.ndarray:
    """best over x[i : i + n] for every full window."""
    done, out = 1, x
    while 2 * done <= n:
        out = best(out[:-done], out[done:])
        done *= 2
    return best(out[: len(x) - n + 1], out[n - done : n - done + len(x) - n + 1]) if done < n else out


def _spread(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return np.minimum(x, _NONE - np.uint64(1))


def seed_hashes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The hash of the SEED bytes at every place; the largest number where they would leave the text."""
    n = len(data)
    out = np.full(n, _NONE, np.uint64)
    if n >= SEED:
        own, size, base = _BYTES[data], 1, np.array([_BASE])
        while size < SEED:
            own = own[:-size] * base + own[size:]
            base = base * base
            size *= 2
        out[: len(own)] = _spread(own)
    for k in range(1, SEED):
        at = offsets[1:] - k
        out[at[at >= offsets[:-1]]] = _NONE
    return out


def triggers(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the triggers in concatenated texts, in order: each is the smallest of some window inside its text."""
    if len(data) < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = seed_hashes(data, offsets)
    low = np.zeros(len(data) + REACH, np.uint64)  # of the window that begins at a place; 0 where it would leave the text
    inner = _slide(h, REACH + 1, np.minimum)
    low[REACH : REACH + len(inner)] = inner
    for k in range(1, WINDOW):
        at = offsets[1:] - k
        low[REACH + at[at >= offsets[:-1]]] = 0
    top = _slide(low, REACH + 1, np.maximum)  # of the windows that hold the place
    at = np.nonzero(top == h)[0]
    return at, h[at]


def _text_of(at: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.searchsorted(offsets, at, "right") - 1


#: what the parse sends: 32 bits of the hash beside its bucket (which stands for a bounded number of triggers), row, number of the trigger
#: in it; what it knows already: row, number
_PARSE = [("h", "<u4", 1), ("row", "<i8", 0), ("k", "<i4", 0)]
_KNOWN = [("row", "<i8", 0), ("k", "<i4", 0)]
#: what the dictionary gets: document, row, place of the trigger, room in front and behind, the trigger with the bytes around
_PHRASE = [("doc", "<i8", 0), ("row", "<i8", 0), ("at", "<i4", 1), ("front", "u1", 1), ("behind", "u1", 1), ("seen", "u1", SPAN)]
_LOST = [("row", "<i8", 0), ("lo", "<i4", 1), ("hi", "<i4", 1)]
_BLOB, _FOUND = "bucket int, data binary, n long", "row long, lo long, hi long, data binary, n long"
Arrays = dict[str, np.ndarray]


def _planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte: first the lowest byte of each, then the next; high bytes, mostly zero, then take no room when compressed."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _packed(arrays: Arrays, kinds: list[tuple[str, str, int]], pack: zstandard.ZstdCompressor) -> bytes:
    """Arrays behind each other, compressed; those of width 0 as differences."""
    own = [(np.diff(arrays[k], prepend=0) if width == 0 else np.ascontiguousarray(arrays[k])).astype(t, copy=False) for k, t, width in kinds]
    return pack.compress(b"".join([x.tobytes() if width > 1 else _planes(x) for x, (*_, width) in zip(own, kinds)]))


def _unpacked(blobs: list[tuple[bytes, int]], kinds: list[tuple[str, str, int]]) -> Arrays:
    """The arrays of all rows of a bucket, joined."""
    parts: dict[str, list[np.ndarray]] = {name: [] for name, *_ in kinds}
    for data, n in blobs:
        raw, at = zstandard.ZstdDecompressor().decompress(data), 0
        for name, kind, width in kinds:
            size = np.dtype(kind).itemsize * max(1, width) * n
            own = np.frombuffer(raw, np.uint8, size, at)
            own = own.reshape(n, width) if width > 1 else np.ascontiguousarray(own.reshape(-1, n).T).view(kind).ravel() if n else np.zeros(0, kind)
            parts[name].append(np.cumsum(own, dtype=kind) if width == 0 else own)
            at += size
    return {name: np.concatenate(parts[name]) if parts[name] else np.zeros((0, width) if width > 1 else 0, kind) for name, kind, width in kinds}


def _rows(blobs: list[tuple[int, bytes, int]]) -> pa.RecordBatch:
    bucket, data, n = zip(*blobs)
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(data, pa.binary()), pa.array(n, pa.int64())], ["bucket", "data", "n"])


def _dealt(arrays: Arrays, h: np.ndarray, buckets: int, kinds: list[tuple[str, str, int]], pack: zstandard.ZstdCompressor) -> Iterator[pa.RecordBatch]:
    """One row for each bucket, which the hashes name."""
    bucket = (h % np.uint64(buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[by], np.arange(buckets + 1))
    found = [(b, _packed({k: v[by[cuts[b] : cuts[b + 1]]] for k, v in arrays.items()}, kinds, pack), int(cuts[b + 1] - cuts[b])) for b in np.nonzero(np.diff(cuts))[0].tolist()]
    if found:
        yield _rows(found)


def _first_of(order: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted rows: where each group of equal keys begins, and every row's group."""
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return np.nonzero(new)[0], np.cumsum(new) - 1


def _zip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts compressed, with the distances of their triggers (a byte each: at most REACH + 1)."""
    pack = zstandard.ZstdCompressor(level=9)
    for rows, col in text_steps(batches):
        data, offsets = flat(col)
        at, _ = triggers(data, offsets)
        text = _text_of(at, offsets)
        counts = np.bincount(text, minlength=len(col))
        place = at - offsets[text]
        gaps = np.diff(place, prepend=0)
        first = np.searchsorted(text, np.arange(len(col)))[counts > 0]
        gaps[first] = place[first]
        ends = pa.py_buffer(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
        gaps = pa.Array.from_buffers(pa.binary(), len(col), [None, ends, pa.py_buffer(gaps.astype(np.uint8))])
        null = rows.column("text").is_null().to_pylist()
        zipped = pa.array([None if none else pack.compress(t) for t, none in zip(col.to_pylist(), null)], pa.binary())
        names = [x for x in rows.schema.names if x != "text"]
        yield pa.RecordBatch.from_arrays([zipped, gaps, *(rows.column(x) for x in names)], ["zip", "gaps", *names])


def _places(gaps: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The text and the place in it of every trigger."""
    data, offsets = flat(gaps)
    size = np.diff(offsets)
    run = np.concatenate([[0], np.cumsum(data, dtype=np.int64)])
    return np.repeat(np.arange(len(size)), size), run[1:] - np.repeat(run[offsets[:-1]], size)


def _unzipped(batches: Iterator[pa.RecordBatch], limit: int = STEP_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Slices of the batches with about `limit` bytes of text, and the texts."""
    release()
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        texts, size, lo = [], 0, 0
        for k, data in enumerate(batch.column("zip").to_pylist()):
            texts.append(b"" if data is None else unpack.decompress(data))
            size += len(texts[-1])
            if size >= limit or k == batch.num_rows - 1:
                yield batch.slice(lo, k + 1 - lo), pa.array(texts, pa.binary())
                texts, size, lo = [], 0, k + 1
        release()


def _hashes_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The hashes of the SEED bytes at some places, as seed_hashes has them."""
    seen = np.lib.stride_tricks.sliding_window_view(data, SEED)[at]
    out = np.zeros(len(at), np.uint64)
    for c in range(SEED):
        out = out * _BASE + _BYTES[seen[:, c]]
    return _spread(out)


def _room(at: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far strings reach in front of and behind each trigger that hold no smaller one (of equal ones, the first counts)."""
    n = len(at)
    front, behind = np.full(n, REACH), np.full(n, REACH)
    for k in range(1, REACH + 1):  # triggers are at most REACH + 1 bytes apart, and at least one
        far = at[k:] - at[:-k]
        near = far <= REACH
        if not near.any():
            break
        left, right = near & (h[:-k] <= h[k:]), near & (h[k:] < h[:-k])
        front[k:][left] = np.minimum(front[k:][left], far[left] - 1)
        behind[:-k][right] = np.minimum(behind[:-k][right], far[right] - 1)
    return front, behind


def _parse(buckets: int):
    """Each batch's triggers. Where several rows of the batch have one, they are told at once (bucket -1), and the first and
    the last of these rows ask for it, so that others learn that there are two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        held: list[tuple[np.ndarray, ...]] = []

        def told() -> Iterator[pa.RecordBatch]:
            h, row, number = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.argsort(h, kind="stable")  # rows come in the order of the batch
            if not len(order):
                return
            start, group = _first_of(order, h)
            last = np.append(start[1:], len(order)) - 1
            differ = row[order[start]] != row[order[last]]
            several = np.zeros(len(order), bool)
            several[order] = differ[group]
            ask = ~several
            ask[order[start]] = ask[order[last]] = True
            short = (h // np.uint64(buckets)).astype(np.uint32)
            yield from _dealt({"h": short[ask], "row": row[ask], "k": number[ask]}, h[ask], buckets, _PARSE, pack)
            if several.any():
                yield _rows([(-1, _packed({"row": row[several], "k": number[several]}, _KNOWN, pack), int(several.sum()))])

        for rows, col in _unzipped(batches):
            data, offsets = flat(col)
            text, place = _places(rows.column("gaps"))
            if len(text):
                number = np.arange(len(text)) - np.searchsorted(text, text)
                held.append((_hashes_at(data, offsets[text] + place), np.asarray(rows.column("_row"))[text], number.astype(np.int32)))
            if sum(len(x[0]) for x in held) >= PARSE_TRIGGERS:
                yield from told()
        if held:
            yield from told()

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, number) of all triggers that several rows have, for the bucket of one partition; what is known goes through."""
    release()

    def out(row: np.ndarray, number: np.ndarray) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(row), 200_000):
            yield pa.RecordBatch.from_arrays([pa.array(row[lo : lo + 200_000]), pa.array(number[lo : lo + 200_000])], ["row", "number"])

    asked: list[tuple[bytes, int]] = []
    for batch in batches:
        for bucket, data, n in zip(*(batch.column(k).to_pylist() for k in ("bucket", "data", "n"))):
            if bucket < 0:
                x = _unpacked([(data, n)], _KNOWN)
                yield from out(x["row"], x["k"])
            else:
                asked.append((data, n))
    x = _unpacked(asked, _PARSE)
    del asked
    if len(x["row"]):
        order = np.argsort(x["h"], kind="stable")
        start, group = _first_of(order, x["h"])
        row = x["row"][order]
        found = order[(np.minimum.reduceat(row, start) != np.maximum.reduceat(row, start))[group]]
        yield from out(x["row"][found], x["k"][found])


def _hash_rows(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of bytes."""
    out = np.zeros(len(x), np.uint64)
    for c in range(x.shape[1]):
        out = out * _BASE + _BYTES[x[:, c]]
    return mixed(out)


def _merged(row: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Arrays:
    """Stretches of rows, those that touch joined."""
    order = np.lexsort((hi, lo, row))
    row, lo, hi = row[order], lo[order].astype(np.int64), hi[order].astype(np.int64)
    new = np.ones(len(row), bool)
    if len(row):
        high = np.maximum.accumulate(hi + (_first_of(np.arange(len(row)), row)[1] << 36)) & ((1 << 36) - 1)
        new[1:] = (row[1:] != row[:-1]) | (lo[1:] > high[:-1])
        start = np.nonzero(new)[0]
        return {"row": row[start], "lo": lo[start], "hi": high[np.append(start[1:], len(row)) - 1]}
    return {"row": row, "lo": lo, "hi": hi}


def _covered(x: Arrays) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the first window begins and the last one ends that the phrases can hold, and whether they hold any."""
    first, last = np.maximum(0, REACH - x["behind"].astype(np.int64)), x["front"].astype(np.int64)
    return x["at"] - last, x["at"] - first + WINDOW, first <= last


def _distinct(x: Arrays, buckets: int, core: np.ndarray, pack: zstandard.ZstdCompressor) -> Iterator[pa.RecordBatch]:
    """Deals a batch's phrases out by the bytes of `core`, each once, with the smallest id. Other documents of the batch lose all strings
    of it: what they lose is told at once (bucket -1)."""
    whole = _hash_rows(np.column_stack([x["seen"], x["front"], x["behind"]]))
    h = _hash_rows(core)
    order = np.lexsort((x["at"], x["row"], x["doc"], whole, h))
    seen = x["seen"][order]
    new = np.ones(len(order), bool)
    new[1:] = (seen[1:] != seen[:-1]).any(axis=1)
    for k in ("front", "behind"):
        new[1:] |= np.diff(x[k][order].astype(np.int64)) != 0
    start = np.nonzero(new)[0]
    later = x["doc"][order] > x["doc"][order[start]][np.cumsum(new) - 1]
    ask, lost = order[~later], order[later]
    yield from _dealt({k: v[ask] for k, v in x.items()}, h[ask], buckets, _PHRASE, pack)
    lo, hi, any_ = _covered({k: x[k][lost] for k in ("at", "front", "behind")})
    if any_.any():
        told = _merged(x["row"][lost][any_], lo[any_], hi[any_])
        yield _rows([(-1, _packed(told, _LOST, pack), len(told["row"]))])


def _phrases(buckets: int):
    """The bytes around each repeated trigger that strings reach in which it is the smallest: a string is looked at by that trigger only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=6)
        held: list[Arrays] = []

        def dealt() -> Iterator[pa.RecordBatch]:
            x = {k: np.concatenate([own[k] for own in held]) for k in held[0]}
            held.clear()
            if len(x["at"]):
                yield from _distinct(x, buckets, x["seen"][:, REACH:WINDOW], pack)

        for rows, col in _unzipped(batches):
            data, offsets = flat(col)
            text, place = _places(rows.column("gaps"))
            at, named = offsets[text] + place, rows.column("numbers")
            of = np.repeat(np.arange(len(col)), np.diff(np.asarray(named.offsets)))
            use = np.zeros(len(at), bool)
            use[np.searchsorted(text, of) + np.asarray(named.flatten())] = True
            if not use.any():
                continue
            front, behind = _room(at, _hashes_at(data, at))
            text, place, at, front, behind = (v[use] for v in (text, place, at, front, behind))
            front, behind = np.minimum(front, place), np.minimum(behind, offsets[text + 1] - at - SEED)
            padded = np.concatenate([np.zeros(REACH, np.uint8), data, np.zeros(WINDOW, np.uint8)])
            seen = np.lib.stride_tricks.sliding_window_view(padded, SPAN)[at]
            column = np.arange(SPAN)
            seen[(column < REACH - front[:, None]) | (column >= WINDOW + behind[:, None])] = 0
            held.append({"doc": np.asarray(rows.column("_id"))[text], "row": np.asarray(rows.column("_row"))[text], "at": place.astype(np.int32), "front": front.astype(np.uint8), "behind": behind.astype(np.uint8), "seen": seen})
            if sum(len(x["at"]) for x in held) >= PHRASES:
                yield from dealt()
        if held:
            yield from dealt()

    return run


def _finer(buckets: int):
    """Phrases that were too many for their bucket, by the bytes that strings from `STARTS` neighbouring beginnings share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for data, n in zip(batch.column("data").to_pylist(), batch.column("n").to_pylist()):
                x = _unpacked([(data, n)], _PHRASE)
                column = np.arange(SPAN)
                for low in range(0, REACH + 1, STARTS):  # strings that begin low to high bytes in front of the trigger
                    high = min(low + STARTS - 1, REACH)
                    own = x | {"front": np.minimum(x["front"], high), "behind": np.minimum(x["behind"], REACH - low)}
                    fits = _covered(own)[2]
                    own = {k: v[fits] for k, v in own.items()}
                    if len(own["at"]):
                        own["seen"] = np.where((column >= REACH - high) & (column < WINDOW + REACH - low), own["seen"], 0).astype(np.uint8)
                        core = np.column_stack([np.full(len(own["at"]), low, np.uint8), own["seen"][:, REACH - low : WINDOW + REACH - high]])
                        yield from _distinct(own, buckets, core, pack)

    return run


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every string of the phrases as a row: the string, its document, row and place."""
    for batch in batches:
        for data, n in zip(batch.column("data").to_pylist(), batch.column("n").to_pylist()):
            x = _unpacked([(data, n)], _PHRASE)
            for a in range(REACH + 1):
                fits = np.nonzero((x["front"] >= a) & (x["behind"].astype(np.int64) >= REACH - a))[0]
                if len(fits):
                    own = np.ascontiguousarray(x["seen"][fits, REACH - a : SPAN - a])
                    strings = pa.Array.from_buffers(pa.binary(), len(fits), [None, pa.py_buffer((np.arange(len(fits) + 1) * WINDOW).astype(np.int32)), pa.py_buffer(own)])
                    yield pa.RecordBatch.from_arrays([strings, *(pa.array(x[k][fits]) for k in ("doc", "row")), pa.array(x["at"][fits].astype(np.int64) - a)], ["string", "doc", "row", "lo"])


def _common(x: np.ndarray) -> np.ndarray:
    """Bytes that each sorted row shares with the one before it (the first: none)."""
    out = np.zeros(len(x), np.int64)
    if len(x) > 1:
        differ = x[1:] != x[:-1]
        out[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), x.shape[1])
    return out


def _ordered(x: np.ndarray) -> np.ndarray:
    """The lexicographic order of rows of bytes."""
    return np.argsort(np.ascontiguousarray(x).view(f"S{x.shape[1]}").ravel(), kind="stable")


def _with_neighbours(common: np.ndarray) -> np.ndarray:
    return np.maximum(common, np.append(common[1:], 0))


def lost_strings(x: Arrays) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the stretches that the occurrences of phrases lose to documents with a smaller id."""
    front, behind, doc = x["front"].astype(np.int64), x["behind"].astype(np.int64), x["doc"]
    # the dictionary: trigger, what is in front of it read towards the front, what is behind it
    key = np.column_stack([x["seen"][:, REACH:WINDOW], x["seen"][:, :REACH][:, ::-1], x["seen"][:, WINDOW:], x["front"], x["behind"]])
    order = _ordered(key)
    common = _common(key[order])
    start = np.nonzero(common < key.shape[1])[0]
    phrase = np.empty(len(order), np.int64)
    phrase[order] = np.cumsum(common < key.shape[1]) - 1
    low = np.minimum.reduceat(doc[order], start)
    later = doc > low[phrase]
    lo, hi, some = _covered({k: x[k][later] for k in ("at", "front", "behind")})
    rows, los, his = [x["row"][later][some]], [lo[some]], [hi[some]]
    # the suffix array of the dictionary (by trigger and front), and that of what continues it (by trigger and behind)
    key, common, front, behind = key[order[start]], common[start], front[order[start]], behind[order[start]]
    n, trigger = len(start), np.cumsum(common < SEED)
    after = np.column_stack([trigger.astype(">u4").view(np.uint8).reshape(-1, 4), key[:, WINDOW : WINDOW + REACH]])
    follow = _ordered(after)
    common_after = _common(after[follow])
    deep, deep_after = _with_neighbours(common) - SEED, np.empty(n, np.int64)
    deep_after[follow] = _with_neighbours(common_after) - 4
    lost = np.zeros((n, REACH + 1), bool)  # by the place of the phrase where the string begins
    interval = np.empty(n, np.int64)
    for a in range(REACH + 1):  # the string begins a bytes in front of the trigger, REACH - a bytes follow it
        own = np.nonzero((deep >= a) & (deep_after >= REACH - a) & (front >= a) & (behind >= REACH - a))[0]
        if len(own) > 1:
            interval[follow] = np.cumsum(common_after < 4 + REACH - a)
            place = np.cumsum(common < SEED + a)[own] * (n + 1) + interval[own]
            by = np.argsort(place, kind="stable")
            first, group = _first_of(by, place)
            own = own[by]
            lost[own, REACH - a] = low[own] > np.minimum.reduceat(low[own], first)[group]
    # occurrences in the document that has the phrase first
    at = np.nonzero(~later)[0]
    at = at[lost.any(axis=1)[phrase[at]]]
    own = lost[phrase[at]]
    row, begin = np.nonzero(own & ~np.pad(own, ((0, 0), (1, 0)))[:, :-1])
    _, end = np.nonzero(own & ~np.pad(own, ((0, 0), (0, 1)))[:, 1:])
    origin = x["at"][at][row].astype(np.int64) - REACH
    return np.concatenate([*rows, x["row"][at][row]]), np.concatenate([*los, origin + begin]), np.concatenate([*his, origin + end + WINDOW])


def _judge(hold: int):
    """(row, lo, hi) of stretches that rows lose, for the bucket of one partition; if it has more than `hold` phrases, they are passed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        names = ["row", "lo", "hi", "data", "n"]

        def spans(x: Arrays) -> Iterator[pa.RecordBatch]:
            for k in range(0, len(x["row"]), 200_000):
                own = [pa.array(np.asarray(x[c][k : k + 200_000], np.int64)) for c in ("row", "lo", "hi")]
                yield pa.RecordBatch.from_arrays([*own, pa.nulls(len(own[0]), pa.binary()), pa.nulls(len(own[0]), pa.int64())], names)

        def on(blobs: list[tuple[bytes, int]]) -> pa.RecordBatch:
            none = pa.nulls(len(blobs), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, pa.array([d for d, _ in blobs], pa.binary()), pa.array([n for _, n in blobs], pa.int64())], names)

        mine: list[tuple[bytes, int]] = []
        size = 0
        for batch in batches:
            for bucket, data, n in zip(*(batch.column(k).to_pylist() for k in ("bucket", "data", "n"))):
                if bucket < 0:
                    yield from spans(_unpacked([(data, n)], _LOST))
                    continue
                size += n
                mine.append((data, n))
            if size > hold and mine:
                yield on(mine)
                mine = []
        if mine:
            x = _unpacked(mine, _PHRASE)
            del mine
            parts = -(-len(x["at"]) // SORT)
            share = (_hash_rows(x["seen"][:, REACH:WINDOW]) >> np.uint64(20)) % np.uint64(parts)
            by = np.argsort(share, kind="stable")
            cuts = np.searchsorted(share[by], np.arange(parts + 1, dtype=np.uint64))
            found = [lost_strings({k: v[by[a:b]] for k, v in x.items()}) for a, b in zip(cuts, cuts[1:]) if a < b]
            del x
            yield from spans(_merged(*(np.concatenate(v) for v in zip(*found))))

    return run


def _cut(with_text: bool, kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, col in _unzipped(batches):
            out: list[list] = [[], [], [], [], [], []]
            spans, null = rows.column("spans").to_pylist(), rows.column("zip").is_null().to_pylist()
            for data, own, none in zip(col.to_pylist(), spans, null):
                runs: list[list[int]] = []
                for lo, hi in sorted((s["lo"], s["hi"]) for s in own or ()):
                    if runs and lo <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], hi)
                    else:
                        runs.append([lo, hi])
                at, parts = 0, []
                for lo, hi in runs:
                    parts.append(data[at:lo])
                    at = hi
                rest = b"".join([*parts, data[at:]]) if runs else data
                values = (len(data), len(data) - len(rest), len(runs), hashlib.sha256(rest).hexdigest(), [{"start": a, "end": b} for a, b in runs], None if none or not with_text else rest.decode(errors="ignore"))
                for o, v in zip(out, values):
                    o.append(v)
            kinds = [pa.int64()] * 3 + [pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string()]
            arrays = [*(rows.column(k) for k in kept), *(pa.array(o, t) for o, t in zip(out, kinds))]
            yield pa.RecordBatch.from_arrays(arrays, [*kept, "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept_text"])

    return run


_RESULTS = "doc_id n_bytes n_removed n_spans kept_sha256 spans kept_text"


def _ranked(docs: DataFrame) -> DataFrame:
    """docs with `_id`: the id itself, or its place in the order of all ids where it isn't an integer."""
    kind = docs.schema["doc_id"].dataType
    if isinstance(kind, IntegralType):
        return docs.withColumn("_id", F.col("doc_id").cast("long"))
    ids = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("_of")).distinct().orderBy("_of")
    return docs.join(stored(ids.withColumn("_id", F.monotonically_increasing_id())), F.col("doc_id") == F.col("_of"), "left").drop("_of")


def deduplicated(docs: DataFrame, with_text: bool = True, keep: list[str] | None = None, hold: int = HOLD) -> DataFrame:
    """Each document's id (and the columns `keep`) with n_bytes, n_removed, n_spans, kept_sha256, spans and, if wanted, kept_text."""
    own = keepable(keep, _RESULTS)
    names = [f"_k{i}" for i in range(len(own))]
    spark = docs.sparkSession
    rows = _ranked(docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), *(docs[f"`{c}`"].alias(k) for c, k in zip(own, names))))
    rows = settled(rows)
    n = max(partitions(spark), int((rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BUCKET) + 1)
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    fields = {f.name: f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema}
    # a row's number is its name from here on, so the texts are kept with it; they lie by it, for both joins
    texts = cut_by(mapped(rows, _zip, ", ".join(["zip binary, gaps binary", *(v for k, v in fields.items() if k != "text")])), n, "_row")
    place = F.when(F.col("bucket") < 0, F.pmod(F.xxhash64("data"), F.lit(n))).otherwise(F.col("bucket")).cast("int")
    parse = mapped(texts.filter("_id IS NOT NULL").select("zip", "gaps", "_row"), _parse(n), _BLOB)
    repeated = mapped(parse.repartitionById(n, place), _repeated, "row long, number int")
    named = repeated.groupBy(F.col("row").alias("_of")).agg(F.collect_set("number").alias("numbers"))
    found = mapped(texts.join(named.hint("merge"), F.col("_row") == F.col("_of")), _phrases(n), _BLOB)
    judged = stored(mapped(found.repartitionById(n, place), _judge(hold), _FOUND))
    lost = judged.filter("row IS NOT NULL").select("row", "lo", "hi")
    if not judged.filter("row IS NULL").isEmpty():
        finer = mapped(judged.filter("row IS NULL").select("data", "n"), _finer(n), _BLOB)
        again = stored(mapped(finer.repartitionById(n, place), _judge(hold), _FOUND))
        lost = lost.unionByName(again.filter("row IS NOT NULL").select("row", "lo", "hi"))
        if not again.filter("row IS NULL").isEmpty():
            strings = mapped(again.filter("row IS NULL").select("data", "n"), _windows, "string binary, doc long, row long, lo long")
            low = strings.groupBy("string").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).filter("low < high").drop("high")
            lost = lost.unionByName(strings.join(low, "string").filter("doc > low").select("row", "lo", (F.col("lo") + WINDOW).alias("hi")))
    spans = lost.groupBy(F.col("row").alias("_of")).agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    every = texts.join(spans.hint("merge"), F.col("_row") == F.col("_of"), "left")
    result = ", ".join([*(fields[k] for k in ("doc_id", *names)), "n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, end: long>>, kept_text string"])
    return mapped(every, _cut(with_text, ["doc_id", *names]), result).withColumnsRenamed(dict(zip(names, own)))
