"""Operators on single texts, against brute force."""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF, plain
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewatch.llm import chat, language, licenses, packing, quality, sentencepiece_codec, simhash
from tidewatch.llm.queries import ORACLE_SQL, QUERIES, vocabulary

EDGE = [None, "", " ", "\n", "a", "Über Öl. " * 4, "x" * 200_000, "one two three four five six seven eight nine ten eleven", "the mit license under the MIT License!", "1 2 3", "été — 中文 🙂", "a b c d e " * 30, "\x00 nul \x1f"]
SCHEMA = "doc_id long, text string, lang string, n_words int, score string, fingerprint int, spans string"


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(i, t, "en" if i % 2 else None, 1, "s", 2, "t") for i, t in enumerate(EDGE)]
    return spark.createDataFrame([*rows, *rows[:6], (None, "no id at all", "de", 1, "s", 2, "t")], SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(name, spark, database):
    got, expected = QUERIES[name](spark, SF).toPandas(), database.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert plain(got) == plain(expected)


# ---- quality


def brute_quality(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)

    def cover(m):
        c, s = Counter(tuple(w[i : i + m]) for i in range(n - m + 1)), set()
        for i in range(n - m + 1):
            if c[tuple(w[i : i + m])] > 1:
                s.update(range(i, i + m))
        return len(s)

    longest = 0
    while longest < n and any(v > 1 for v in Counter(tuple(w[i : i + longest + 1]) for i in range(n - longest)).values()):
        longest += 1
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), cover(5), cover(8), longest


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\té#", max_size=60), min_size=1, max_size=5))
def test_quality_counts(texts):
    m = quality.measure(pa.array([t.encode() for t in texts], pa.binary()), 8)
    got = list(zip(*(m[k].tolist() for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat"))))
    assert got == [brute_quality(t) for t in texts]


def test_quality_edges(edge, nothing):
    rows = quality.quality(edge, keep=["lang", "score"]).collect()
    assert len(rows) == len(EDGE) + 7
    assert all(not r.kept for r in rows if r.n_words < 10)
    assert quality.quality(nothing).count() == 0


def test_kept_columns_that_are_named_like_results(spark):
    rows = spark.createDataFrame([(1, "one two three four", 5, 6, "x")], "doc_id long, text string, n_words int, lang_pred int, other string")
    for out, name in ((quality.quality(rows, keep=["n_words", "other", "text"]), "n_words"), (language.identify(rows, {"en": [b"one two"]}, keep=["lang_pred", "other"]), "lang_pred")):
        assert len(set(out.columns)) == len(out.columns)
        assert (out.first()[name], out.first().other) == ({"n_words": 4, "lang_pred": "en"}[name], "x")


# ---- licences


def brute_places(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    out = [i for p in licenses.BASE for q in [p.split()] for i in range(len(w)) if w[i : i + len(q)] == q]
    return len(w), sorted(out)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from("under the mit license apache version 2 cc by nc word licensed".split()), max_size=40))
def test_license_places(words):
    text = " ".join(words)
    n, places, _ = licenses.Scanner(licenses.BASE, licenses.TEMPLATES).scan(text.encode())
    assert (n, sorted(a for a, _ in places)) == brute_places(text)


def brute_spans(words, templates):
    """Matches that can't grow to the right, by comparing words; then chains of places of one template."""
    own = [t.split() for t in templates]
    ends = {}  # by end in the text: the longest string of any template that ends there
    for i in range(1, len(words) + 1):
        ends[i] = max((n for t in own for e in range(1, len(t) + 1) for n in [next((k for k in range(min(i, e)) if words[i - 1 - k] != t[e - 1 - k]), min(i, e))]), default=0)
    spans = []
    for k, t in enumerate(own):
        places = []
        for i, n in ends.items():
            if n >= licenses.MIN_MATCH and ends.get(i + 1, 0) != n + 1:
                places += [(i - n, i, e) for e in range(n, len(t) + 1) if t[e - n : e] == words[i - n : i]]
        chain = None  # first word, last word, words of the template reached, words covered
        done = []
        for a, b, e in sorted(places):
            if chain:
                first, last, reached, covered = chain
                new = min(b - a, e - reached, b - last)
                if a <= last + licenses.MAX_GAP and new > 0 and e - (b - a) >= reached - (b - a):
                    chain = first, max(last, b), e, covered + new
                    continue
                done.append(chain)
            chain = a, b, e, b - a
        spans += [(k, first, last, covered / len(t)) for first, last, _, covered in [*done, *([chain] if chain else [])] if covered >= licenses.COVER * len(t)]
    return spans


@settings(max_examples=120, deadline=None)
@given(st.data())
def test_license_spans(data):
    templates = ["a b c d e f g h i j", "c d e x y z a b c", "u v w", "a b c d e"]
    pieces = st.sampled_from(["a b c d e f g h i j", "a b c d e", "f g h i j", "c d e x y z", "a b c", "u v w", "q", "c", "x y", "d e f g h"])
    words = " ".join(data.draw(st.lists(pieces, max_size=8))).split()
    scan = licenses.Scanner({"u": "one", "x y": "two"}, {str(k): [t] for k, t in enumerate(templates)})
    n, places, spans = scan.scan(" ".join(words).encode())
    assert n == len(words)
    assert sorted(places) == sorted([(i, 0) for i, w in enumerate(words) if w == "u"] + [(i, 1) for i in range(len(words)) if words[i : i + 2] == ["x", "y"]])
    assert [(k, a, b, pytest.approx(c)) for k, a, b, c in spans] == brute_spans(words, templates)


def test_license_texts_are_found():
    scan = licenses.scanner(licenses.BASE, licenses.TEMPLATES)
    assert len(licenses.TEMPLATES) >= 30
    for label, own in licenses.TEMPLATES.items():
        for text in own:
            spans = scan.scan(f"some words before {text} and some behind".encode())[2]
            assert any(scan.templates[k][1] == label and c == 1 for k, *_, c in spans), (label, text)
    assert scan.scan(b"a novel about the sea and the software of a ship that any person may use free of charge")[2] == []


def test_license_base_fields_equal_sql(spark, database):
    """Base columns of the query over the whole table; labels hold the base ones, and agree with the spans of the operator."""
    like = "CASE " + " ".join(f"WHEN array_to_string(w[i : i + {len(p.split()) - 1}], ' ') = '{p}' THEN '{label}'" for p, label in licenses.BASE.items()) + " END"
    sql = f"""
    WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
    p AS (SELECT doc_id, i, {like} AS label FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d))
    SELECT d.doc_id, CAST(len(any_value(w)) AS BIGINT) AS n_words, count(label) AS n_base, min(CASE WHEN label IS NOT NULL THEN i - 1 END) AS first_word,
      max(CASE WHEN label IS NOT NULL THEN i - 1 END) AS last_word, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS base_labels
    FROM d LEFT JOIN p USING (doc_id) GROUP BY d.doc_id"""
    got = QUERIES["op3_license_scans"](spark, SF).toPandas()
    expected = database.sql(sql).df()
    assert plain(got[expected.columns]) == plain(expected)
    spans = {r.doc_id: r for r in licenses.scan_licenses(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    for r in got.itertuples():
        labels = sorted({*filter(None, r.base_labels.split(",")), *(s.label for s in spans[r.doc_id].spans)})
        assert r.labels == ",".join(labels)
        assert r.score == (1.0 if r.base_labels else max((s.covered for s in spans[r.doc_id].spans), default=0.0))


def test_license_edges(edge, nothing):
    rows = {r.doc_id: r for r in licenses.scan_licenses(edge).collect()}
    assert (rows[8].n_base, rows[8].first_word, rows[8].base_labels, rows[8].labels, rows[8].score) == (1, 3, "mit", "mit", 1.0)
    assert (rows[0].n_words, rows[0].n_base, rows[0].first_word, rows[0].labels, rows[0].score) == (0, 0, None, "", 0.0)
    assert licenses.scan_licenses(nothing).count() == 0
    long = licenses.TEMPLATES["bsd"][0]
    n = len(licenses.words(long.encode()))
    found = licenses.scanner(licenses.BASE, licenses.TEMPLATES).scan(f"intro {long} outro".encode())[2]
    assert [(licenses.scanner(licenses.BASE, licenses.TEMPLATES).templates[k][1], a, b) for k, a, b, _ in found] == [("bsd", 1, 1 + n)]
    broken = long.split()
    broken[5] = "xyz"
    assert licenses.scanner(licenses.BASE, licenses.TEMPLATES).scan(" ".join(broken).encode())[2]


# ---- language


def brute_phrases(text, sample):
    """Cross-parsing as it is described, with string search."""
    low = lambda x: re.sub(b"[A-Z]", lambda m: m[0].lower(), x)
    text, sample, count, now = low(text), [low(x) for x in sample], bool(text), b""
    for k in range(len(text)):
        c = text[k : k + 1]
        if any(now + c in x for x in sample):
            now += c
        else:
            count, now = count + 1, c if any(c in x for x in sample) else b""
    return count


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abAB é1.", max_size=90), min_size=1, max_size=4), st.lists(st.text(alphabet="aab é.", min_size=1, max_size=40), min_size=1, max_size=3), st.sampled_from([1, 2, 7, 16]))
def test_language_phrases_are_exact(texts, sample, block):
    sample = {"x": [t.encode() for t in sample], "y": [b"abab ba"]}
    model = language.Model(sample)
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    got = model.phrases(data, offsets, block)
    assert got.tolist() == [[brute_phrases(t, sample[name]) for name in model.names] for t in raw]


def test_language_phrases_of_long_texts():
    """Lengths around the blocks, and texts whose walks don't meet."""
    rng = np.random.default_rng(2)
    prose = lambda n: bytes(rng.choice(list(b"etaoin shrdlu.,0"), n).tolist())
    sample = {"x": [prose(300), b"a" * 5], "y": [prose(200), b"ab" * 9], "z": ["жзик".encode()]}
    model = language.Model(sample)
    texts = [prose(n) for n in (0, 1, 511, 512, 513, 1023, 1024, 1025, 3000)] + [b"a" * 1600, b"ab" * 900, "жзи ".encode() * 300, b"#" * 700]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    assert model.phrases(data, offsets).tolist() == [[brute_phrases(t, sample[name]) for name in model.names] for t in texts]


def test_language_sample_of_repeated_rows(spark):
    """Copies of a row, or of an id, are one text of the sample, and only the sample comes to the driver."""
    rows = [(7, "the same text again and again", "en")] * 3000 + [(7, f"another text number {k} of one id", "en") for k in range(40)] + [(9, "ein satz", "de"), (9, None, "de"), (9, "", "de"), (9, "x", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(6)
    sample = language.sampled(frame)
    assert sorted(sample) == ["de", "en"] and sample["de"] == [b"ein satz"]
    assert len(sample["en"]) == len(set(sample["en"])) == 41
    few = language.sampled(frame, rows=10)
    assert len(few["en"]) == 10 and few == language.sampled(frame.repartition(3), rows=10)
    assert sum(map(len, language.sampled(frame, size=100)["en"])) <= 100


def test_language_edges(edge, nothing, spark):
    rows = language.identify(edge, language.learned(edge)).collect()
    assert len(rows) == len(EDGE) + 7
    by = {r.doc_id: r for r in rows}
    assert [by[k].lang_pred for k in (0, 1, 2, 3, 9)] == ["und"] * 5
    assert all(0 <= r.score <= 1 for r in rows)
    assert language.identify(nothing, language.learned(nothing)).count() == 0
    unlabelled = edge.selectExpr("doc_id", "text", "cast(null AS string) AS lang")
    assert {r.lang_pred for r in language.identify(unlabelled, language.learned(unlabelled)).collect()} == {"und"}


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = QUERIES["op5_language_id"](spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97


# ---- chat


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["\\", "-", "<", "|", "</s>", "[INST]", "<|turn|>", "<|end|>", "\\-", "a", "\n"]), max_size=12))
def test_escape_is_reversible(parts):
    text = "".join(parts)
    marked = text.replace("\\", "\\\\")
    for c in chat.CONTROLS:
        marked = marked.replace(c, f"{c[0]}\\-{c[1:]}")
    assert chat.unescape(marked) == text
    assert not any(c in marked for c in chat.CONTROLS)
    assert chat.read_segment(f"{chat.TURN}user{chat.TEXT}{marked}{chat.END}") == ("user", text)


def test_layouts_become_turns():
    cases = [
        ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, [("user", "q"), ("assistant", "a")]),
        ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, [("user", "q"), ("assistant", "a")]),
        ({"prompt": "q", "response": "a"}, [("user", "q"), ("assistant", "a")]),
        ({"instruction": "s", "input": "q", "output": None}, [("system", "s"), ("user", "q"), ("assistant", "")]),
        ({"role": "user", "text": None}, [("user", "")]),
    ]
    for record, turns in cases:
        assert chat.turns_of(json.dumps(record)) == turns
    assert chat.turns_of('{"other": 1}') == [("unknown", '{"other": 1}')]
    assert chat.turns_of("not json") == [("unknown", "not json")]
    assert chat.turns_of(None) == []


def test_roles_stay_as_they_are(spark, tmp_path):
    """The query on roles that other layouts rename, against its SQL."""
    import duckdb

    rows = [(1, 0, "human", "hi"), (1, 1, "gpt", "there"), (2, 0, "user", "q"), (2, 1, "model", "m"), (2, 2, "assistant", "a"), (3, 0, "bot", None), (3, 1, None, "x<|text|>"), (3, 2, "Assistant", "\\-")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    frame.coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got = QUERIES["op1_chat_formatting"](spark, str(tmp_path)).toPandas()
    assert plain(got) == plain(con.sql(ORACLE_SQL["op1_chat_formatting"]).df())
    assert got.set_index("conv_id").loss_chars.to_dict() == {-1: 21, 1: 0, 2: 1, 3: 0}


def test_chat_edges(spark):
    rows = [(1, 0, None, None), (1, 1, "assistant", "b\n"), (1, 1, "assistant", "a"), (None, None, "user", "z"), (2, 5, "assistant", "<|end|>\\"), (2, 5, "assistant", "<|end|>\\")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    digest = lambda t: chat.read_back(chat.formatted(chat.canonical_turns(chat.turn_records(t))))
    got = {r.conv_id: r for r in digest(table).collect()}
    assert got[1].turns_sha256 == hashlib.sha256(b"\n\nassistant\na\nassistant\nb\n\n").hexdigest()
    assert (got[1].n_turns, got[1].loss_chars, got[1].loss_sha256) == (3, 3, hashlib.sha256(b"ab\n").hexdigest())
    assert got[2].loss_chars == 16 and got[None].n_turns == 1
    assert digest(table.limit(0)).count() == 0


# ---- packing and coding


def test_piece_lengths():
    for n in (1, 2, 4095, 4096, 4097, 10_000):
        row, start, lengths = packing.cut_up(np.array([7, n]))
        sizes = lengths[row == 1].tolist()
        assert start[row == 1].tolist() == np.cumsum([0, *sizes[:-1]]).tolist() and lengths[row == 0].tolist() == [4, 2, 1]
        assert sum(sizes) == n and all(s & (s - 1) == 0 and s <= 4096 for s in sizes) and sizes == sorted(sizes, reverse=True)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab'stmdrevl 1²½!?\n\t\x85\xa0\x1cÀéßµªº×É—бİ<|>", max_size=30), max_size=4))
def test_split_equals_library(texts):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    whole = _CACHE.setdefault(path, Tokenizer.from_file(path))
    ids, cuts = packing.tokens(packing.word_table(path), [t.encode() for t in texts])
    assert [ids[a:b].tolist() for a, b in zip(cuts, cuts[1:])] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


_CACHE: dict = {}


def test_a_full_table_keeps_its_first_half():
    from tidewatch.llm.words import WordTable

    asked = []
    table = WordTable(lambda words: [asked.append(w) or np.array([len(w), 7], np.int32).tobytes() for w in words], limit=6)
    for texts in ([[b"a", b"bb", b"ccc"], [b"a"]], [[b"dddd", b"a", b"eeeee", b"ff", b"gg"]], [[b"hhhhhh", b"gg", b"ccc"]], [[b"bb", b"ff"]]):
        assert [x.tolist() for x in table.tokens(texts)] == [[v for w in words for v in (len(w), 7)] for words in texts]
    assert asked.count(b"a") == asked.count(b"ccc") == asked.count(b"bb") == 1 and asked.count(b"gg") == 2


def test_packing_equals_library(edge, nothing, spark):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(edge.filter("doc_id IS NOT NULL").selectExpr("doc_id + 100000 AS doc_id", "text").distinct()).unionByName(spark.createDataFrame([(900000, "a<|endoftext|>b ŒUVRE İx don't '' ''s")], "doc_id long, text string"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = packing.packed(docs, path).toPandas().sort_values(["doc_id", "start"])
    assert sorted(got["sequence_id"]) == list(range(len(got)))
    assert set(got["offset"]) == {0}
    for i, own in got.groupby("doc_id"):
        expected = [*whole.encode(texts[i], add_special_tokens=False).ids, 2]
        assert [x for ids in own["ids"] for x in ids] == expected
        assert own["start"].tolist() == np.cumsum([0, *own["length"][:-1]]).tolist()
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.doc_tokens == len(expected) for r in own.itertuples())
    assert set(got["doc_id"]) == set(texts)
    assert packing.packed(nothing, path).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abcdeéß ▁\n'.,0123🙂中ABTHEthe", max_size=50))
def test_sentencepiece_equals_library(text):
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    own = sentencepiece_codec.codec(sentencepiece_codec._model(path))
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = own.encode([text.encode()])[0]
    assert ids.tolist() == lib.encode(text)
    assert own.decode([ids])[0].decode() == lib.decode(ids.tolist()) == text.replace("▁", " ")


def test_unigram_path_is_best():
    own = sentencepiece_codec.codec(sentencepiece_codec._model(vocabulary("piece_bpe_32k.model")))

    def best(word):
        if not word:
            return 0.0
        ends = [own.score.get(word[-k:], own.unknown_score if k == 1 else None) for k in range(1, len(word) + 1)]
        return max(best(word[:-k]) + s for k, s in enumerate(ends, 1) if s is not None)

    words = ["▁the", "▁then", "▁theta", "▁a", "▁中x", "▁tion"]
    own.unigram = True
    try:
        for word, ids in zip(words, own.encode_words([w.replace("▁", " ").encode() for w in words])):
            got = sum(own.score.get(own.names[i], own.unknown_score / 3 if own.names[i].startswith("<0x") else 0) for i in ids)
            assert got == pytest.approx(best(word))
    finally:
        own.unigram = False


def test_sentencepiece_whole_table(spark):
    """Every column of the query against the library."""
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in QUERIES["op10_sentencepiece"](spark, SF).collect()}
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert set(got) == set(docs)
    for i, text in docs.items():
        ids = lib.encode(text)
        back = lib.decode(ids).encode()
        assert (got[i].n_tokens, got[i].ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert (got[i].n_bytes, got[i].text_crc32, got[i].round_trip) == (len(back), zlib.crc32(back), back == text.encode())


def test_sentencepiece_frames(edge, nothing, spark):
    path = vocabulary("piece_bpe_32k.model")
    docs = edge.filter("doc_id < 6 OR doc_id > 6").distinct()
    back = {r.doc_id: r.text for r in sentencepiece_codec.decoded(sentencepiece_codec.encoded(docs, path), path).collect()}
    assert all(back[i] == (EDGE[i] or "") for i in back)
    assert all(r.round_trip for r in sentencepiece_codec.digests(edge, path).collect())
    assert sentencepiece_codec.digests(nothing, path).count() == 0


# ---- fingerprints


def brute_fingerprint(text):
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_fingerprints():
    texts = [t or "" for t in EDGE if t is None or len(t) < 1000] + ["w " * 30_000]
    got = simhash.fingerprints(pa.array([t.encode() for t in texts], pa.binary()))
    assert got.tolist() == [brute_fingerprint(t) for t in texts]
