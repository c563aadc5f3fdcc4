"""What language ID learns: every byte of the sample, and languages that have long rows only."""

from __future__ import annotations

import numpy as np

from tidewatch.llm.language import byte_classes, identify, sampled


def test_each_byte_of_the_sample_has_a_class():
    sample = {"ru": ["съешь же ещё этих мягких французских булок да выпей чаю".encode()], "zh": ["天地玄黃宇宙洪荒日月盈昃辰宿列張".encode()]}
    kind = byte_classes(sample)
    own = {b for texts in sample.values() for t in texts for b in t}
    assert len(own) > 40
    assert len({int(kind[b]) for b in own}) == len(own) and min(int(kind[b]) for b in own) >= 1
    assert set(kind[[b for b in range(256) if b not in own]].tolist()) == {0}


def test_languages_with_long_rows_only(spark):
    rng = np.random.default_rng(5)
    prose = lambda letters, n: " ".join("".join(rng.choice(list(letters), 5)) for _ in range(n))
    rows = [(k, prose("abcdefg", 50), "aa") for k in range(4)] + [(10 + k, prose("жзикл", 5000), "bb") for k in range(3)]
    docs = spark.createDataFrame(rows, "id long, text string, lang string")
    sample = sampled(docs)
    assert sorted(sample) == ["aa", "bb"]
    assert 0 < sum(map(len, sample["bb"])) <= 40_000 and len(sample["bb"]) == 3
    asked = spark.createDataFrame([(1, prose("жзикл", 30)), (2, prose("abcdefg", 30))], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in identify(asked, sample).collect()} == {1: "bb", 2: "aa"}
