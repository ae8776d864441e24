import math

from gleaner.llm import lmscore


def test_scores_do_not_depend_on_the_blocks(spark):
    rows = [(i, f"the river {'bends ' * (i % 3)}slowly past town{i % 7} and unseen{i}") for i in range(40)]
    docs, found, before = spark.createDataFrame(rows, "doc_id long, text string"), [], spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("4", "32"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append({r["doc_id"]: r["score"] for r in lmscore.score_texts(docs).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0].keys() == found[1].keys() and len(found[0]) == 40
    assert all(math.isclose(found[0][i], found[1][i], rel_tol=1e-9) for i in found[0])


def test_long_words_have_their_own_scores(spark):
    words = ["q" * n for n in (150, 300, 600, 60_000)]
    docs = spark.createDataFrame([(i, w) for i, w in enumerate(words)] + [(9, "plain words for training")], "doc_id long, text string")
    fold = lmscore.Fold(modulus=1 << 40, remainder=-1)
    score = {r["doc_id"]: r["score"] for r in lmscore.score_texts(docs.where("doc_id <> 3"), fold).unionByName(lmscore.score_texts(docs.where("doc_id in (3, 9)"), fold)).collect()}
    assert all(math.isfinite(x) for x in score.values())
    model = lmscore.Lattice(*lmscore.read_pieces())
    spelled = model.log_likelihood([w.encode() for w in words])
    assert len({round(x, 3) for x in spelled}) == 4 and spelled[3] < 50 * spelled[2] < 0


def test_counts_are_kept_in_64_bits():
    import numpy as np

    totals = lmscore.Totals(tokens=1 << 40, distinct=3, once=1, twice=1, ends=1)
    p = np.exp(totals.log_word(np.array([float(1 << 39)]), np.array([-2000.0])))
    assert abs(p[0] - 0.5) < 1e-9
    rare = totals.log_word(np.zeros(2), np.array([-2000.0, -3000.0]))
    assert rare[0] - rare[1] == 1000.0


def test_a_very_long_word_is_scored_in_stretches(monkeypatch):
    import numpy as np

    from gleaner.llm import lattice

    model = lmscore.Lattice(*lmscore.read_pieces())
    words = [(b"the" * 60)[:n] for n in (65, 99, 100, 101, 180)]
    whole, uses = model.log_likelihood(words), model.expected_counts(words, np.ones(5))
    monkeypatch.setattr(lattice, "STRETCH", 7)
    assert np.allclose(model.log_likelihood(words), whole, rtol=1e-12) and np.allclose(model.expected_counts(words, np.ones(5)), uses, atol=1e-9)
    monkeypatch.setattr(lattice, "LONG", 1000)
    assert np.allclose(model.log_likelihood(words), whole, rtol=1e-9)
