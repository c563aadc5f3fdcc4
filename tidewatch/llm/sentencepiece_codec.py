"""SentencePiece encoding and decoding by shared-prefix Viterbi.

Texts are marked (each space becomes the mark, one stands in front) and split where no piece can cross: in front of a run of marks,
and around line ends if no piece holds one. The distinct words of a step are sorted, which walks their trie depth-first: the forward state of a
prefix is computed once and reused by all words that begin with it.

The forward state of a prefix follows from the model's kind:
* unigram: the best sum of scores and the last piece of the best path (an unknown character costs the smallest score less 10);
* BPE: the last piece of the one path on which each neighbouring pair of pieces stays as it is when merged by itself. Every prefix has one
  such path, and that of the word is what merging by rank gives, so a score isn't needed to tell the paths apart.

Characters outside the vocabulary become byte pieces. Decoding joins the pieces' bytes and turns marks back to spaces.

Defined results: null and empty texts have no ids and decode to the empty text; a text that holds the mark itself decodes to a space
there (the model can't tell them apart); repeated rows give repeated results; very long texts and words are coded whole; ids may be null and of any type; only doc_id and text are read,
whatever other columns are called.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewatch.llm.common import mapped, only, text_steps
from tidewatch.llm.words import WordTable

MARK, UNKNOWN_COST = "▁", 10.0

def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a serialised message (varints and byte strings)."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            out |= (data[at] & 127) << shift
            at += 1
            shift += 7
            if not data[at - 1] & 128:
                return out

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        elif key & 7 == 2:
            n = varint()
            yield key >> 3, data[at : at + n]
            at += n
        else:
            at += 8 if key & 7 == 1 else 4


def is_unigram(model: bytes) -> bool:
    """Whether a model file names the unigram kind (which it also does by silence)."""
    kind = 1
    for number, value in _fields(model):
        if number == 2 and isinstance(value, bytes):
            kind = next((v for k, v in _fields(value) if k == 3), kind)
    return kind == 1


class Codec:
    """One model: words to ids, ids to bytes."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = lib.get_piece_size()
        self.names = [lib.id_to_piece(i) for i in range(n)]
        special = [lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i) for i in range(n)]
        self.unigram = is_unigram(model)
        self.ids = {p: i for i, p in enumerate(self.names) if not special[i]}
        self.score = {p: lib.get_score(i) for p, i in self.ids.items()}
        sizes: dict[str, set[int]] = {}
        for p in self.ids:
            if len(p) > 1:
                sizes.setdefault(p[-2:], set()).add(len(p))
        #: sizes of the pieces that end with two characters, the largest first, and of one character
        self.sizes = {tail: (*sorted(own, reverse=True), 1) for tail, own in sizes.items()}
        self.byte_ids = {int(self.names[i][3:5], 16): i for i in range(n) if lib.is_byte(i)}
        self.unknown, self.unknown_score = lib.unk_id(), min(self.score.values(), default=0.0) - UNKNOWN_COST
        lines_apart = not any("\n" in p for p in self.ids)
        self._split = re.compile(rb" *[^ \n]+|\n| +" if lines_apart else rb" *[^ ]+| +")
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece goes on behind a mark: words can't be told apart")
        self._stays: dict[tuple[str, str], bool] = {}
        own = [b"" if lib.is_control(i) else b" \xe2\x81\x87 " if lib.is_unknown(i) else bytes([int(p[3:5], 16)]) if lib.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(self.names)]
        self.piece_bytes, self.piece_ends = np.frombuffer(b"".join(own), np.uint8), np.cumsum([0, *map(len, own)])
        self.table = WordTable(lambda words: [np.array(ids, np.int32).tobytes() for ids in self.encode_words(words)], 1_000_000)

    def words(self, text: bytes) -> list[bytes]:
        """The words of a marked text, with spaces for marks."""
        return self._split.findall(b" " + text.replace(b"\xe2\x96\x81", b" ")) if text else []

    def merged(self, text: str) -> list[str]:
        """What merging by rank makes of a short text."""
        parts = list(text)
        while len(parts) > 1:
            pairs = [(self.score[a + b], -k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.ids]
            if not pairs:
                break
            k = -max(pairs)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def stays(self, a: str, b: str) -> bool:
        """Whether two neighbouring pieces are still those two when their text is merged by itself."""
        known = self._stays.get((a, b))
        if known is None:
            if len(self._stays) > 1_000_000:
                self._stays.clear()
            known = self._stays[a, b] = self.merged(a + b) == ([a, b] if a else [b])
        return known

    def _forward_merged(self, word: str, first: int, sizes: list[int], ends: list[str]) -> None:
        """For the prefixes from `first` characters on: the size of their last piece, and that piece."""
        ids, known_pairs, sizes_of, single = self.ids, self._stays.get, self.sizes.get, (1,)
        for i in range(first, len(word) + 1):
            for size in sizes_of(word[i - 2 : i], single) if i > 1 else single:
                if size <= i:
                    piece = word[i - size : i]
                    if size == 1 or piece in ids:
                        pair = (ends[i - size], piece)
                        known = known_pairs(pair)
                        if known or known is None and self.stays(*pair):
                            sizes.append(size)
                            ends.append(piece)
                            break
            else:
                raise AssertionError(f"no path for {word[:i]!r}")

    def _forward_scored(self, word: str, first: int, sizes: list[int], best: list[float]) -> None:
        score, single = self.score, (1,)
        for i in range(first, len(word) + 1):
            top, found = -np.inf, 1
            for size in self.sizes.get(word[i - 2 : i], single) if i > 1 else single:  # the longest of equally good last pieces
                if size <= i:
                    own = score.get(word[i - size : i], self.unknown_score if size == 1 else None)
                    if own is not None and best[i - size] + own > top:
                        top, found = best[i - size] + own, size
            sizes.append(found)
            best.append(top)

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word: the sorted words share the forward states of their common prefixes."""
        texts = [w.decode().replace(" ", MARK) for w in words]
        out: list[list[int]] = [[]] * len(words)
        forward, start = (self._forward_scored, 0.0) if self.unigram else (self._forward_merged, "")
        sizes, state, before = [0], [start], ""
        for k in sorted(range(len(texts)), key=texts.__getitem__):
            word = texts[k]
            same, most = 0, min(len(word), len(before))
            while same < most and word[same] == before[same]:
                same += 1
            del sizes[same + 1 :], state[same + 1 :]
            forward(word, same + 1, sizes, state)
            before, at, ids = word, len(word), []
            while at:
                piece = word[at - sizes[at] : at]
                known = self.ids.get(piece)
                if known is not None:
                    ids.append(known)
                else:
                    ids += [self.byte_ids.get(x, self.unknown) for x in reversed(piece.encode())] if self.byte_ids else [self.unknown]
                at -= sizes[at]
            ids.reverse()
            out[k] = ids
        return out

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        return self.table.tokens([self.words(t) for t in texts])

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        if not ids:
            return []
        every = np.concatenate(ids)
        first = self.piece_ends[every]
        size = self.piece_ends[every + 1] - first
        behind = np.cumsum(size)
        data = self.piece_bytes[np.repeat(first - (behind - size), size) + np.arange(behind[-1] if len(behind) else 0)].tobytes()
        at = np.concatenate([[0], behind])[np.cumsum([0, *map(len, ids)])]
        return [data[a + 1 : b] if b > a and data[a] == 32 else data[a:b] for a, b in zip(at, at[1:])]


def codec(model: bytes) -> Codec:
    """The process's codec for a model."""
    return only(("pieces", len(model), zlib.crc32(model)), lambda: Codec(model))


def _model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(_model(path))
        for rows, col in text_steps(batches, 8 << 20, keep=True):
            yield pa.RecordBatch.from_arrays([rows.column(1), pa.array(own.encode(col.to_pylist()), pa.list_(pa.int32()))], ["doc_id", "ids"])

    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    return mapped(docs.select("text", "doc_id"), run, f"doc_id {kind}, ids array<int>")


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(_model(path))
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                ids = [np.zeros(0, np.int64) if x is None else np.array(x, np.int64) for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([t.decode(errors="replace") for t in own.decode(ids)], pa.string())], ["doc_id", "text"])

    kind = rows.select("doc_id").schema[0].dataType.simpleString()
    return mapped(rows.select("ids", "doc_id"), run, f"doc_id {kind}, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, n_bytes and text_crc32 of what the ids decode to, and whether that is the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(_model(path))
        for rows, col in text_steps(batches, 8 << 20, keep=True):
            texts = col.to_pylist()
            ids = own.encode(texts)
            back = own.decode(ids)
            numbers = [[len(x) for x in ids], [zlib.crc32(x.astype("<u4").tobytes()) for x in ids], [len(x) for x in back], [zlib.crc32(x) for x in back]]
            same = pa.array([a == b for a, b in zip(texts, back)], pa.bool_())
            yield pa.RecordBatch.from_arrays([rows.column(1), *(pa.array(x, pa.int64()) for x in numbers), same], ["doc_id", "n_tokens", "ids_crc32", "n_bytes", "text_crc32", "round_trip"])

    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    return mapped(docs.select("text", "doc_id"), run, f"doc_id {kind}, n_tokens long, ids_crc32 long, n_bytes long, text_crc32 long, round_trip boolean")
