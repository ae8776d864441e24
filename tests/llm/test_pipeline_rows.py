import random

import corpus_pipeline
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
QUESTION = "a train leaves the old town at noon and meets another train near the wide river"


def _text(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))


def _rows(found):
    return sorted((tuple(r) for r in found.collect()), key=repr)


def _first_of_class(rows):
    """near_copies over rows whose copies differ in case only."""
    best, left = {}, [r for r in rows if r[0] is None]
    for r in (r for r in rows if r[0] is not None):
        key = r[1].lower()
        best[key] = min(best.get(key, r), r)
    return sorted(left + list(best.values()), key=repr)


def test_stages_decide_by_row(spark, tmp_path):
    rng = random.Random(5)
    texts = [_text(rng, 30) for _ in range(12)]
    rows = [(7, t, "en", "hot", len(t)) for t in texts] + [(1, texts[0].upper(), "en", "s", len(texts[0])), (7, texts[3].upper(), "en", "hot", 1), (9, texts[5], "de", "s", 2)]
    rows += [(None, texts[1], "en", "s", 5), (None, _text(rng, 30), "en", "s", 5), (20, texts[8], "en", "s", 5), (20, _text(rng, 30), "en", "s", 5)]
    kept = corpus_pipeline.near_copies(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert _rows(kept) == _first_of_class(rows)

    passage = _text(rng, 50)
    rows = [(i, f"{_text(rng, 9)} {passage} {_text(rng, 9)}", "en", "s", 1) for i in (None, 7)] + [(7, _text(rng, 20), "en", "s", 1), (None, _text(rng, 20), "en", "s", 1)]
    left = _rows(corpus_pipeline.repeats(spark, spark.createDataFrame(rows, SCHEMA), ""))
    assert len(left) == 4 and not [r for r in left if passage in r[1]]
    assert {r for r in left if r in rows} == set(rows[2:])

    spark.createDataFrame([(1, QUESTION)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, QUESTION, "en", "s", 1), (7, QUESTION, "en", "s", 1), (7, texts[0], "en", "s", 1), (None, texts[1], "en", "s", 1)]
    clean = corpus_pipeline.benchmark_leaks(spark, spark.createDataFrame(rows, SCHEMA), str(tmp_path))
    assert _rows(clean) == sorted(rows[2:], key=repr)
    assert clean.where(F.col("doc_id").isNull()).count() == 1
