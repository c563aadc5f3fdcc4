"""Quality rules on repetition: suffix arrays over the words of each text.

Every text is a sequence of words (runs of characters other than space and TAB..CR). A suffix array of the words is built by
prefix doubling for many texts at once: words of different texts never compare equal, so a common prefix stays inside its text.
Adjacent suffixes give the longest-common-prefix intervals; the longest repeat that starts at a word is the larger of its two
neighbours' values. The spans of all maximal repeats of at least `min_repeat` words are united. A text is rejected if the united
spans cover more than `max_covered` of its words, or if one repeat is longer than `max_repeat` words.

Defined results: null and empty texts have no words and fail the base rules; repeated rows give repeated results; columns other
than the named ones are ignored. A text is handled whole, in memory of about 100 bytes a word of that text; no row depends on another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewatch.llm.common import keepable, flat, mapped, mixed, text_steps

#: Fixed values of the contract: the characters counted as symbols.
SYMBOLS = b"#*$%&|<>"

MIN_WORDS, MAX_REPEATED_PERCENT, WINDOW = 10, 20, 5
MIN_REPEAT, MAX_COVERED, MAX_REPEAT = 8, 0.15, 200

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_STARTS_POINT = (np.arange(256) & 0xC0) != 0x80
_BYTE_KEYS = mixed(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word in concatenated texts."""
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]])
    after = np.concatenate([inside[1:], [False]])
    starts = np.nonzero(inside & (~before | edge[:-1]))[0]
    ends = np.nonzero(inside & (~after | edge[1:]))[0] + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, from one running sum."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    power = np.full(len(data), _BASE, np.uint64)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE_KEYS[data] * power, dtype=np.uint64)])
    back = np.full(len(data), _INVERSE, np.uint64)
    back[0] = 1
    np.multiply.accumulate(back, out=back)
    return mixed((sums[ends] - sums[starts]) * back[starts]) + (ends - starts).astype(np.uint64)


def _group_starts(sorted_keys: np.ndarray) -> np.ndarray:
    new = np.ones(len(sorted_keys), bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    return new


def longest_repeats(keys: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For every word the length of the longest sequence that starts there and also starts elsewhere in its text.

    keys: equal for equal words; text: the text's number, ascending.
    """
    n = len(keys)
    if not n:
        return np.zeros(0, np.int64)
    end = np.searchsorted(text, text, "right")  # behind the last word of the text
    order = np.argsort(mixed(keys + mixed(text.astype(np.uint64) + np.uint64(1))), kind="stable")
    own = mixed(keys + mixed(text.astype(np.uint64) + np.uint64(1)))[order]
    new = _group_starts(own)
    first = np.nonzero(new)[0]
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(first, np.diff(np.append(first, n)))
    levels, active, h = [rank.astype(np.int32)], order[~new | ~np.append(new[1:], True)], 1
    while len(active):
        ahead = active + h
        second = np.where(ahead < end[active], rank[np.minimum(ahead, n - 1)], -1)
        by = np.lexsort((second, rank[active]))
        active, second = active[by], second[by]
        lead = rank[active]
        group = _group_starts(lead)
        new = group | _group_starts(second)
        at = np.arange(len(active))
        within = at - at[group][np.cumsum(group) - 1]
        rank = rank.copy()
        rank[active] = lead + within[new][np.cumsum(new) - 1]
        levels.append(rank.astype(np.int32))
        active = active[~new | ~np.append(new[1:], True)]
        h *= 2
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    a, b = suffixes[:-1].copy(), suffixes[1:].copy()
    common = np.zeros(n - 1, np.int64)
    live = np.nonzero(levels[0][a] == levels[0][b])[0]
    a, b, length = a[live], b[live], np.zeros(len(live), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = (a < end[suffixes[live]]) & (b < end[suffixes[live + 1]])
        same = inside & (levels[k][np.minimum(a, n - 1)] == levels[k][np.minimum(b, n - 1)])
        step = same * (1 << k)
        a, b, length = a + step, b + step, length + step
    common[live] = length
    longest = np.zeros(n, np.int64)
    longest[suffixes[:-1]] = common
    longest[suffixes[1:]] = np.maximum(longest[suffixes[1:]], common)
    return longest


def covered(longest: np.ndarray, at_least: int) -> np.ndarray:
    """Whether each word lies in a repeat of at least so many words."""
    edge = np.zeros(len(longest) + 1, np.int64)
    start = np.nonzero(longest >= at_least)[0]
    edge[start] += 1
    np.subtract.at(edge, start + longest[start], 1)
    return np.cumsum(edge[:-1]) > 0


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def measure(col: pa.Array, min_repeat: int) -> dict[str, np.ndarray]:
    """The counts of every text of a binary array."""
    data, offsets = flat(col)
    n = len(col)
    starts, ends, text = words_of(data, offsets)
    longest = longest_repeats(span_hashes(data, starts, ends), text)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, text, longest)
    lines = []
    for value in col.to_pylist():
        full = [x for x in value.split(b"\n") if x and not x.isspace()]
        lines.append(len(full) - len(set(full)))
    count = lambda mask: np.bincount(text[mask], minlength=n).astype(np.int64)
    return {
        "n_words": np.bincount(text, minlength=n).astype(np.int64),
        "word_chars": _sums(_STARTS_POINT[data] & ~_SPACE[data], offsets),
        "n_symbols": _sums(_SYMBOL[data], offsets),
        "n_dup_lines": np.array(lines, np.int64),
        "n_repeat_words": count(covered(longest, WINDOW)),
        "n_covered": count(covered(longest, min_repeat)),
        "longest_repeat": top,
    }


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_repeat: int = MAX_REPEAT, keep: list[str] | None = None) -> DataFrame:
    """One row per document with its counts, the base rules' verdict and the final one.

    keep: further columns to hand through; those that are named like a result give way to it.
    """
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat")
    kept = [c for c in keepable(keep, " ".join([id_col, *counts, "base_failed", "kept"])) if c != text_col]
    own = text_col if text_col in (keep or []) else "_text"
    given_text = [text_col] if own == text_col else []
    schema = docs.select(id_col, *kept, *given_text).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, col in text_steps(batches, name=own):
            m = measure(col, min_repeat)
            bad = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEATED_PERCENT * m["n_words"])
            good = ~bad & (m["n_covered"] <= max_covered * m["n_words"]) & (m["longest_repeat"] <= max_repeat)
            given = [*(rows.column(k + 1) for k in range(1 + len(kept))), *([rows.column(0)] if given_text else [])]
            yield pa.RecordBatch.from_arrays([*given, *(pa.array(m[c]) for c in counts), pa.array(bad), pa.array(good)], [id_col, *kept, *given_text, *counts, "base_failed", "kept"])

    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), *(f"{c} long" for c in counts), "base_failed boolean", "kept boolean"])
    return mapped(docs.selectExpr(f"`{text_col}` AS `{own}`", f"`{id_col}`", *(f"`{c}`" for c in kept)), run, fields)
