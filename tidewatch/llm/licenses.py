"""License scans: a generalised suffix automaton of licence tokens.

All templates are sequences of words in one automaton. A text is streamed through it word by word, which gives at each word the
longest match that ends there (matching statistics). Matches of at least `MIN_MATCH` words are places of one template or
several; places of one template in order, with gaps of at most `MAX_GAP` words, are chained into spans. A template counts
as found if a chain covers at least `COVER` of its words. Base phrases are templates that must match whole; their places are counted.

Templates are whole short licences, notices, and the passages of long ones that files carry (`license_texts`), over 30 licences. Passages that several
licences share name each of them.

Defined results: null and empty texts have no words and no labels (score 0); repeated rows give repeated results; a text of any length is
handled whole; only the named columns are read, whatever others are called; ids may be null and of any type.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewatch.llm.automaton import SuffixAutomaton
from tidewatch.llm.common import mapped, only, text_steps
from tidewatch.llm.license_texts import TEMPLATES

#: Fixed values of the contract: phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

MIN_MATCH, MAX_GAP, COVER = 3, 4, 0.8
_WORD_BYTES = bytes(x if 48 <= x <= 57 or 97 <= x <= 122 or x >= 128 else x + 32 if 65 <= x <= 90 else 32 for x in range(256))


def words(text: bytes) -> list[bytes]:
    """Runs of digits, letters and characters beyond ASCII, A-Z in lower case."""
    return text.translate(_WORD_BYTES).split()


class Scanner:
    """The automaton of all templates and base phrases."""

    def __init__(self, base: dict[str, str], templates: dict[str, list[str]]) -> None:
        self.ids: dict[bytes, int] = {}
        number = lambda text: [self.ids.setdefault(w, len(self.ids) + 1) for w in words(text.encode())]
        self.base = [(number(text), label) for text, label in base.items()]
        self.templates = [(number(text), label) for label, own in templates.items() for text in own]
        auto = SuffixAutomaton()
        for seq, _ in [*self.base, *self.templates]:
            auto.add(seq)
        self.auto = auto
        #: words in a row that can be a match or a base phrase
        self.shortest = min([MIN_MATCH, *(len(seq) for seq, _ in self.base)])
        #: for each state the base phrases that end in its strings, and places (template, end) of the strings
        self.ending: list[list[int]] = [[] for _ in auto.step]
        self.places: list[list[tuple[int, int]]] = [[] for _ in auto.step]
        for k, (seq, _) in enumerate(self.templates):
            self._visit(seq, lambda state, end, k=k: self.places[state].append((k, end)))
        whole = [self._end(seq) for seq, _ in self.base]
        for state in range(len(auto.step)):
            at = state
            while at > 0:
                self.ending[state] += [k for k, s in enumerate(whole) if s == at]
                at = auto.link[at]

    def _end(self, seq: list[int]) -> int:
        at = 0
        for x in seq:
            at = self.auto.step[at][x]
        return at

    def _visit(self, seq: list[int], note) -> None:
        at = 0
        for end, x in enumerate(seq, 1):
            at = self.auto.step[at][x]
            state = at
            while state > 0:
                note(state, end)
                state = self.auto.link[state]

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], list[tuple[int, int, int, float]]]:
        """Words; base places (start, phrase); spans (template, first word, end word, covered share)."""
        found = words(text)
        get = self.ids.get
        ids = np.fromiter((get(w, 0) for w in found), np.int32, len(found))
        known = np.concatenate([[False], ids > 0, [False]])
        edges = np.nonzero(known[1:] != known[:-1])[0]
        base: list[tuple[int, int]] = []
        matches: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        step, link, length = self.auto.step, self.auto.link, self.auto.length
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b - a < self.shortest:
                continue
            state = size = 0
            run = ids[a:b].tolist()
            for i, x in enumerate([*run, 0], a):
                if x in step[state]:
                    state, size = step[state][x], size + 1
                else:
                    if size >= MIN_MATCH:  # the match can't grow: note where it lies in the templates
                        for k, end in self.places[state]:
                            matches[k].append((i - size, i, end))
                    while state > 0 and x not in step[state]:
                        state = link[state]
                        size = length[state] if state > 0 else 0
                    if x in step[state]:
                        state, size = step[state][x], size + 1
                    else:
                        state = size = 0
                for k in self.ending[state]:
                    if size >= len(self.base[k][0]):
                        base.append((i + 1 - len(self.base[k][0]), k))
        return len(found), base, self._chains(matches)

    def _chains(self, matches: dict[int, list[tuple[int, int, int]]]) -> list[tuple[int, int, int, float]]:
        spans = []
        for k, own in sorted(matches.items()):
            need = len(self.templates[k][0])
            first = last = reached = covered = 0
            open_ = False
            for a, b, end in sorted(set(own)):
                start = end - (b - a)
                new = min(b - a, end - reached, b - last) if open_ else 0
                if open_ and a <= last + MAX_GAP and end > reached and new > 0 and start >= reached - (b - a):
                    last, reached, covered = max(last, b), end, covered + new
                else:
                    if open_ and covered >= COVER * need:
                        spans.append((k, first, last, covered / need))
                    first, last, reached, covered, open_ = a, b, end, b - a, True
            if open_ and covered >= COVER * need:
                spans.append((k, first, last, covered / need))
        return spans


def scanner(base: dict[str, str], templates: dict[str, list[str]]) -> Scanner:
    return only(("licences", repr((base, templates))), lambda: Scanner(base, templates))


FIELDS = "doc_id {id}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, first: long, last: long, covered: double>>"
_SPANS = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("covered", pa.float64())]))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] = BASE, templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """One row per document: base places and labels, all labels, the best covered share, and the template spans (words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(base, templates)
        for rows, col in text_steps(batches, 16 << 20, keep=True):
            out: list[list] = [[] for _ in range(8)]
            for text in col.to_pylist():
                n, places, spans = scan.scan(text)
                starts = [a for a, _ in places]
                own = {scan.base[k][1] for _, k in places}
                every = own | {scan.templates[k][1] for k, *_ in spans}
                score = 1.0 if own else max((min(1.0, c) for *_, c in spans), default=0.0)
                spans = [{"label": scan.templates[k][1], "first": a, "last": b - 1, "covered": min(1.0, c)} for k, a, b, c in spans]
                for x, v in zip(out, (n, len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)), ",".join(sorted(every)), score, spans)):
                    x.append(v)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), _SPANS]
            yield pa.RecordBatch.from_arrays([rows.column(1), *(pa.array(x, k) for x, k in zip(out, kinds))], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return mapped(docs.selectExpr(f"`{text_col}` AS text", f"`{id_col}` AS doc_id"), run, FIELDS.format(id=kind))
