"""Language identification by cross-parsing entropy.

For each language a suffix automaton holds a bounded sample of labelled text. A text is parsed against it greedily: each phrase is
the longest match from where the last one ended; a byte that a language lacks ends the phrase before it and goes with the next one. The language
that needs the fewest phrases, each weighed by the bits that name a place in its sample, wins.

A parse is a walk through an automaton, one byte after the other. So that many bytes advance together, texts are walked in blocks of `BLOCK`
bytes, each as if a phrase began with it; then each block is walked again from where the block before it really ended, until both walks
meet (they stay together from there on), and phrases are corrected. Where they don't meet, the next block is walked once more. So phrases are
those of the whole text, and don't depend on blocks. States with one way out keep it beside the table of the others: about 10 MB a language.

Learning: only text and lang of the given labelled rows, by distinct text. Of the `ROWS` texts of a language with the smallest hashes
(of those of at most `SAMPLE` bytes) as many are put in as `SAMPLE` bytes hold; a language whose texts are all longer is learnt
from the beginnings of at most `LONG` of them. Every text is parsed whole. Letters A-Z count as a-z, every other byte counts as itself.

Defined results: null texts and texts without a letter are `und` with score 0; rows without lang teach nothing; if no row teaches,
all are `und`; ties go to the language that sorts first; ids may repeat, be null and have any type; columns other than the named ones are not
read; kept columns that are named like a result give way to it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.automaton import SuffixAutomaton
from tidewatch.llm.common import flat, keepable, mapped, only, stored, text_steps

ROWS, SAMPLE, BLOCK, UNDETERMINED = 300, 40_000, 512, "und"
LONG = 8  # texts over SAMPLE bytes that a language without shorter ones is learnt from
MEET = 8  # steps between looks at which walks have met


def byte_classes(sample: dict[str, list[bytes]]) -> np.ndarray:
    """A class for each byte: its own for every byte of the sample (A-Z as a-z), and 0 for those that no language has."""
    lower = np.arange(256)
    lower[65:91] += 32
    seen = np.zeros(256, bool)
    for own in sample.values():
        for text in own:
            seen[lower[np.frombuffer(text, np.uint8)]] = True
    return np.where(seen, np.cumsum(seen), 0)[lower].astype(np.uint8)


class Model:
    """The automata of all languages, as one table of states and classes."""

    def __init__(self, sample: dict[str, list[bytes]]) -> None:
        self.names = sorted(sample)
        self.kind = byte_classes(sample)
        classes = int(self.kind.max()) + 1
        ways, only_class, only_to, row, roots, bits, base, rows = [], [], [], [], [], [], 0, 0
        for name in self.names:
            auto = SuffixAutomaton()
            for text in sample[name]:
                auto.add(self.kind[np.frombuffer(text, np.uint8)].tolist())
            # where a byte leads if no match goes on with it, inverted: it ends the phrase
            fresh = np.full(classes, ~base, np.int32)
            fresh[list(auto.step[0])] = [~(base + x) for x in auto.step[0].values()]
            several = [k for k, steps in enumerate(auto.step) if k == 0 or len(steps) > 1]
            own = np.tile(fresh, (len(several), 1))
            for at, k in enumerate(several):
                own[at, list(auto.step[k])] = [base + x for x in auto.step[k].values()]
            place = np.full(len(auto.step), rows + len(several), np.int64)  # the others: a row of misses, beside their only way
            place[several] = np.arange(rows, rows + len(several))
            ways += [own, fresh[None, :]]
            one = [next(iter(steps.items())) if k and len(steps) == 1 else (255, -1) for k, steps in enumerate(auto.step)]
            only_class.append(np.array([c for c, _ in one], np.uint8))
            only_to.append(np.array([base + x for _, x in one], np.int32))
            row.append(place * classes)
            roots.append(base)
            bits.append(math.log2(sum(map(len, sample[name])) + 2))
            base += len(auto.step)
            rows += len(several) + 1
        self.ways = np.concatenate(ways).ravel()
        self.row = np.concatenate(row).astype(np.int32)
        self.only_class, self.only_to = np.concatenate(only_class), np.concatenate(only_to)
        self.roots, self.bits = np.array(roots, np.int32)[:, None], np.array(bits)

    def _step(self, state: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states behind the next bytes, and -1 where they end a phrase."""
        to = self.ways.take(self.row.take(state) + code)
        to = np.where(self.only_class.take(state) == code, self.only_to.take(state), to)
        miss = to >> 31
        return to ^ miss, miss

    def phrases(self, data: np.ndarray, offsets: np.ndarray, block: int = BLOCK) -> np.ndarray:
        """Phrases that each text needs in each language, (texts, languages)."""
        sizes = np.diff(offsets)
        blocks = -(-sizes // block)
        text = np.repeat(np.arange(len(sizes)), blocks)
        start = np.repeat(offsets[:-1], blocks) + block * (np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks))
        size = np.minimum(block, offsets[text + 1] - start)
        codes = self.kind[data]
        by = np.argsort(-size, kind="stable")  # the longest first: ever fewer walks go on
        first, lanes = start[by], np.searchsorted(-size[by], -np.arange(block), "left")
        state = np.repeat(self.roots, len(text), axis=1)
        count = np.zeros((len(self.names), len(text)), np.int32)
        for t in range(block):
            n = int(lanes[t])
            if not n:
                break
            state[:, :n], miss = self._step(state[:, :n], codes.take(first[:n] + t))
            count[:, :n] -= miss
        ends, count_of = np.empty_like(state), np.empty_like(count)
        ends[:, by], count_of[:, by] = state, count
        self._join(codes, text, start, size, ends, count_of)
        total = np.stack([np.bincount(text, weights=c, minlength=len(sizes)) for c in count_of], axis=1)
        return total + (sizes > 0)[:, None]

    def _join(self, codes: np.ndarray, text: np.ndarray, start: np.ndarray, size: np.ndarray, ends: np.ndarray, count: np.ndarray) -> None:
        """Correct the phrases of blocks, walked from the root, for the state in which the block before each ended."""
        alone, extra = ends.copy(), np.zeros_like(count)  # ends of the walks from the root
        todo = np.nonzero(text[1:] == text[:-1])[0] + 1
        while len(todo):
            a, b = np.repeat(self.roots, len(todo), axis=1), ends[:, todo - 1]
            more, found = np.zeros_like(b), alone[:, todo]
            live, t = np.arange(len(todo)), 0
            while len(live):
                code = codes.take(start[todo[live]] + t)
                a, one = self._step(a, code)
                b, two = self._step(b, code)
                more[:, live] += one - two
                t += 1
                if t % MEET == 0 or t >= size[todo[live]].min():
                    over = size[todo[live]] <= t
                    found[:, live[over]] = b[:, over]
                    on = ~over & (a != b).any(axis=0)
                    live, a, b = live[on], a[:, on], b[:, on]
            extra[:, todo] = more
            changed = todo[(found != ends[:, todo]).any(axis=0)]
            ends[:, todo] = found
            todo = changed[changed < len(text) - 1] + 1
            todo = todo[text[todo] == text[todo - 1]]
        count += extra


def _model(sample: dict[str, list[bytes]]) -> Model:
    return only(("languages", hash(tuple((k, *v) for k, v in sorted(sample.items())))), lambda: Model(sample))


def _near(known: DataFrame, rows: int, size: int) -> DataFrame:
    """The distinct texts (lang, long, pick, text) with the smallest hashes: `rows` of the short ones of each language, or `LONG` of the long ones, at least.

    Hashes are evenly spread, so a bound that the language's rows suggest lets few more through. Where copies made it let too few
    through, it is raised until they are enough or all have come.
    """
    counts = known.groupBy("lang").count().collect()  # reads no text
    reach = {(r.lang, long): 2 * rows / r["count"] for r in counts for long in (False, True)}
    texts = known.filter("text IS NOT NULL").filter(F.octet_length("text") > 0)
    texts = texts.select("lang", "text", F.xxhash64("text").alias("pick"), (F.octet_length("text") > size).alias("long"))
    while True:
        bounds = [(lang, long, min(2**63 - 1, int(-(2**63) + 2.0**64 * share))) for (lang, long), share in reach.items()]
        limits = F.broadcast(known.sparkSession.createDataFrame(bounds, "of string, is_long boolean, reach long"))  # two rows a language
        near = texts.join(limits, (F.col("lang") == F.col("of")) & (F.col("long") == F.col("is_long"))).filter(F.col("pick") <= F.col("reach"))
        near = stored(near.groupBy("lang", "long", "pick").agg(F.min(F.substring("text", 1, size)).alias("text")))
        found = {(r.lang, r.long): r["count"] for r in near.groupBy("lang", "long").count().collect()}
        few = [k for k, share in reach.items() if share < 1 and found.get(k, 0) < (LONG if k[1] else rows) and not (k[1] and found.get((k[0], False)))]
        if not few:
            return near
        reach |= {k: 16 * reach[k] for k in few}


def sampled(labelled: DataFrame, rows: int = ROWS, size: int = SAMPLE) -> dict[str, list[bytes]]:
    """The bounded sample (at most `size` bytes a language) of rows (text, lang): those with the smallest hashes among distinct texts.

    What comes to the driver are counts, at most `rows` hashes a language and the sample, whatever the table and however often rows repeat.
    """
    known = labelled.filter("lang IS NOT NULL")
    if known.isEmpty():
        return {}
    near = _near(known, rows, size)
    order = Window.partitionBy("lang").orderBy("long", "pick")
    first = near.select("lang", "long", "pick", F.octet_length("text").alias("size")).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= rows)
    chosen: dict[str, list] = {}
    for r in sorted(first.collect(), key=lambda r: (r.lang, r.place)):
        own = chosen.setdefault(r.lang, [])
        if own and r.long != own[0].long:
            continue
        if len(own) < LONG if r.long else sum(x.size for x in own) + r.size <= size:
            own.append(r)
    picks = {(r.lang, r.long, r.pick) for own in chosen.values() for r in own}
    texts = {(r.lang, r.long, r.pick): r.text.encode() for r in near.filter(F.col("pick").isin([p for *_, p in picks])).collect() if (r.lang, r.long, r.pick) in picks}
    out: dict[str, list[bytes]] = {}
    for lang, own in chosen.items():
        share = size // len(own) if own[0].long else size
        out[lang] = [texts[r.lang, r.long, r.pick][:share].decode(errors="ignore").encode() for r in own]
    return out


def identify(docs: DataFrame, sample: dict[str, list[bytes]], id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(doc_id, further kept columns, lang_pred, score): score is how much cheaper the winner is than the next language."""
    kept = [c for c in keepable(keep, f"{id_col} lang_pred score") if c != text_col]
    own = text_col if text_col in (keep or []) else "_text"
    shared = docs.sparkSession.sparkContext.broadcast(sample)  # at most SAMPLE bytes a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared.value) if shared.value else None
        for rows, col in text_steps(batches, name=own, keep=True):
            data, offsets = flat(col)
            n, ids = len(col), rows.column(1)
            pred, score = [UNDETERMINED] * n, np.zeros(n)
            if model is not None:
                plain = np.zeros(256, bool)
                plain[[*range(65, 91), *range(97, 123)]] = True
                letters, some = np.zeros(n, bool), np.nonzero(np.diff(offsets))[0]
                if len(some):
                    letters[some] = np.logical_or.reduceat(plain[data], offsets[some])
                for i in np.nonzero(~letters & (np.diff(offsets) > 0))[0]:
                    letters[i] = any(map(str.isalpha, col[int(i)].as_py().decode()))
                cost = model.phrases(data, offsets) * model.bits
                best = np.argmin(cost, axis=1)
                if len(model.names) > 1:
                    two = np.partition(cost, 1, axis=1)
                    score = np.where(letters, 1 - two[:, 0] / np.maximum(two[:, 1], 1e-9), 0.0)
                else:
                    score = letters.astype(float)
                pred = [model.names[b] if ok else UNDETERMINED for b, ok in zip(best, letters)]
            yield pa.RecordBatch.from_arrays([ids, *(rows.column(k + 2) for k in range(len(kept))), *([rows.column(0)] if own == text_col else []), pa.array(pred, pa.string()), pa.array(score)], [id_col, *kept, *([text_col] if own == text_col else []), "lang_pred", "score"])

    schema = docs.select(id_col, *kept, *([text_col] if own == text_col else [])).schema
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), "lang_pred string", "score double"])
    return mapped(docs.selectExpr(f"`{text_col}` AS `{own}`", f"`{id_col}`", *(f"`{c}`" for c in kept)), run, fields)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3 (an id that is null: false)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learned(docs: DataFrame, id_col: str = "doc_id") -> dict[str, list[bytes]]:
    """The sample of the documents that aren't held out (those without an id teach nothing)."""
    return sampled(docs.filter(~held_out(id_col)).filter(F.col(id_col).isNotNull()).select("text", "lang"))
