"""Packing by power-of-two decomposition.

A document's token ids (and the id that ends it) are cut into pieces whose lengths are powers of two: as many of the longest length
as fit, then the binary digits of the rest, the largest first. Every piece is a sequence of its own; sequences are
numbered so that those of one length are consecutive. No sequence crosses documents and none is padded.

Encoding runs part by part with a bounded table of the parts that the vocabulary splits words into: it drops white space and joins nothing
across it, or across parts.

Defined results: null and empty texts are the end id alone; repeated rows give repeated pieces; very long texts are encoded whole; ids may
have any type and be null; pieces that agree in id, start and checksum are numbered in any order; only doc_id and text are read, so other
columns may have any name.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import cut, mapped, only, text_steps
from tidewatch.llm.numbering import numbered
from tidewatch.llm.words import WordTable

LONGEST, END = 4096, 2
#: Parts of words that are encoded in one call, and that a worker keeps with their ids.
CALL, PARTS = 500, 600_000

# The vocabulary splits words itself: runs of letters, single digits, runs of anything else, and the English contractions where a run would
# begin. For characters up to U+00FF that is done here, on Latin-1 bytes; words with others are left to the library whole.
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)
_CLASS = np.array([_SPACE if c in b"\t\n\x0b\x0c\r \x85\xa0" else _LETTER if chr(c).isalpha() else _DIGIT if chr(c).isnumeric() else _OTHER for c in range(256)], np.uint8)
_LOWER = bytes(32 if _CLASS[c] == _SPACE else ord(chr(c).lower()) for c in range(256))
_ODD = re.compile("[^ \t-\r]*(?:<\\||[^\x00-\xff])[^ \t-\r]*")


def _parts(data: np.ndarray) -> np.ndarray:
    """Where parts begin, as a mask of lower-case Latin-1 bytes."""
    kind = _CLASS[data]
    before = np.concatenate([[np.uint8(_SPACE)], kind[:-1]])
    begins = (kind != _SPACE) & ((kind != before) | (kind == _DIGIT))
    quotes = np.nonzero((data == 39) & begins)[0]
    if len(quotes):
        near = np.concatenate([data, np.zeros(3, np.uint8)])
        one, two = near[quotes + 1], near[quotes + 2]
        short = np.isin(one, list(b"stmd"))
        long = np.isin(one, list(b"rv")) & (two == 101) | (one == 108) & (two == 108)
        ends = np.concatenate([quotes[short] + 2, quotes[long] + 3])
        begins[np.concatenate([quotes[short], quotes[long]]) + 1] = False
        ends = ends[ends < len(data)]
        begins[ends[kind[ends] != _SPACE]] = True
    return begins


def split(texts: list[bytes]) -> tuple[list[bytes | str], np.ndarray]:
    """The parts of all texts (bytes: Latin-1; text: words for the library), and where each text's parts begin."""
    pieces: list[tuple[int, str | None, bytes]] = []
    for i, text in enumerate(texts):
        own = text.decode()
        try:
            if "<|" in own:
                raise UnicodeEncodeError("latin-1", own, 0, 1, "left to the library")
            pieces.append((i, None, own.encode("latin-1")))
        except UnicodeEncodeError:
            at = 0
            for m in _ODD.finditer(own):
                pieces += [(i, None, own[at : m.start()].encode("latin-1")), (i, m[0], b"")]
                at = m.end()
            pieces.append((i, None, own[at:].encode("latin-1")))
    data = np.frombuffer(b" ".join([x for *_, x in pieces]).translate(_LOWER), np.uint8)
    if not len(data):
        data = np.full(1, 32, np.uint8)
    begins = _parts(data)
    joint = begins & np.concatenate([[False], data[:-1] != 32])
    wide = np.full(len(data) + int(joint.sum()), 32, np.uint8)
    wide[np.arange(len(data)) + np.cumsum(joint)] = data
    parts: list[bytes | str] = wide.tobytes().split()
    ahead = np.concatenate([[0], np.cumsum(begins)])
    starts = ahead[np.minimum(np.cumsum([0] + [len(x) + 1 for *_, x in pieces]), len(data))]
    text_of = np.array([i for i, *_ in pieces], np.int64)
    odd = [(int(starts[k]), word) for k, (_, word, _) in enumerate(pieces) if word is not None]
    counts = np.diff(starts) + np.array([word is not None for _, word, _ in pieces], np.int64)
    if odd:
        whole, at = [], 0
        for k, word in odd:
            whole += parts[at:k]
            whole.append(word)
            at = k
        parts = whole + parts[at:]
    return parts, np.concatenate([[0], np.cumsum(np.bincount(text_of, weights=counts, minlength=len(texts)).astype(np.int64))])


def word_table(path: str) -> WordTable:
    """The process's table of parts for a vocabulary file of the library `tokenizers`."""
    return only(("words", path), lambda: _word_table(path))


def _word_table(path: str) -> WordTable:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    names = {i: name for name, i in whole.get_vocab().items()}
    closes = np.array([names.get(i, "").endswith("</w>") for i in range(max(names) + 1)])
    library = lambda texts: [np.array(e.ids, np.int32) for e in whole.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(parts: list[bytes | str]) -> list[bytes]:
        """The ids of new parts. Those of Latin-1 go many to a call: each part's last token closes a word."""
        plain = [x.decode("latin-1") for x in parts if isinstance(x, bytes)]
        out: list[bytes] = []
        for lo in range(0, len(plain), CALL):
            own = plain[lo : lo + CALL]
            ids = library([" ".join(own)])[0]
            ends = (np.nonzero(closes[ids])[0] + 1).tolist()
            if len(ends) == len(own) and ends[-1] == len(ids):
                data = ids.tobytes()
                out += [data[4 * a : 4 * b] for a, b in zip([0, *ends], ends)]
            else:
                out += [x.tobytes() for x in library(own)]
        if len(plain) == len(parts):
            return out
        latin, others = iter(out), iter(library([x for x in parts if isinstance(x, str)]))
        return [next(latin) if isinstance(x, bytes) else next(others).tobytes() for x in parts]

    return WordTable(encode, PARTS)


def tokens(table: WordTable, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, and where each text's begin."""
    return table.joined(*split(texts))


def cut_up(totals: np.ndarray, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pieces of documents with so many tokens: document, start and length, in order."""
    sizes = np.append(np.full(1, longest), 1 << np.arange(longest.bit_length() - 2, -1, -1))
    often = np.column_stack([totals // longest, (totals[:, None] & sizes[1:]) > 0]).astype(np.int64)
    length = np.repeat(np.tile(sizes, len(totals)), often.ravel())
    row = np.repeat(np.arange(len(totals)), often.sum(axis=1))
    ahead = np.cumsum(length) - length
    first = np.concatenate([[0], np.cumsum(totals)])[:-1]
    return row, ahead - first[row], length


def pieces(docs: DataFrame, path: str, longest: int = LONGEST, end: int = END, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens and (with_ids) the ids themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_table(path)
        for rows, col in text_steps(batches, 1 << 20, keep=True):
            ids, cuts = tokens(table, col.to_pylist())
            row, start, length = cut_up(np.diff(cuts) + 1, longest)
            every = np.insert(ids, cuts[1:], end).astype("<u4")
            at = (cuts[:-1] + np.arange(len(cuts) - 1))[row] + start
            data = memoryview(every.tobytes())
            crc = [zlib.crc32(data[a:b]) for a, b in zip((4 * at).tolist(), (4 * (at + length)).tolist())]
            arrays = [rows.column(1).take(pa.array(row)), *(pa.array(np.asarray(x, np.int64)) for x in (start, length, crc, (np.diff(cuts) + 1)[row]))]
            if with_ids:
                arrays.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(every)).astype(np.int32)), pa.array(every.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: len(arrays)])

    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    return mapped(docs.select("text", "doc_id"), run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids)


def packed(docs: DataFrame, path: str, longest: int = LONGEST, end: int = END, with_ids: bool = True) -> DataFrame:
    """The pieces with their sequence: sequence_id, and offset 0 in it. Texts are encoded once and the pieces kept."""
    kept = cut(pieces(docs, path, longest, end, with_ids))
    lead = F.round(F.log2(F.col("length").cast("double")))
    return numbered(kept, ["doc_id", "start", "ids_crc32"], "sequence_id", lead, longest.bit_length()).withColumn("offset", F.lit(0).cast("long"))
