"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

from gleaner.llm import ann, chat, decontam, langid, lmscore, neardup, packing, quality, suffixdedup, tokenfile
from gleaner.llm.common import cut

WORDS = "the quick brown fox jumps over the lazy dog and then some more words follow here"
TEXTS = [None, "", "   \n", WORDS, WORDS, (WORDS + " ") * 300, "1234 5678 !!", "\u0000 nul", "😀 éèê ü", "x" * 5000]


@pytest.fixture(scope="module")
def documents(spark):
    """Repeated rows and columns whose names clash with the operators' own."""
    rows = [(i, t, "en", 1, 2, 3, 4) for i, t in enumerate(TEXTS)] + [(3, WORDS, None, 1, 2, 3, 4), (None, "null id", "en", 1, 2, 3, 4)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, block int, key int, score int, bin int")


@pytest.fixture(scope="module")
def nothing(documents):
    return documents.where("false")


def test_chat(spark):
    rows = [(1, 0, "user", "a</s>\\"), (1, 1, "assistant", None), (1, 2, None, "[/ROLE]<s>"), (1, 1, "assistant", "tie"), (2, None, "assistant", "x\\<y"), (None, 0, "user", "z")]
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit(9))
    formatted = chat.format_conversations(given)
    parsed = {r["conv_id"]: r for r in chat.read_back(formatted).collect()}
    targets = {}
    for r in chat.expand_targets(formatted).select("conv_id", "seq", chat.unescape(F.col("target")).alias("text")).orderBy("seq").collect():
        targets.setdefault(r["conv_id"], []).append(r["text"])
    assert [(t["role"], t["text"]) for t in parsed[1]["turns"]] == [("user", "a</s>\\"), ("assistant", ""), ("assistant", "tie"), ("", "[/ROLE]<s>")]
    assert targets == {1: ["", "tie"], 2: ["x\\<y"]}
    digests = {r["conv_id"]: r for r in chat.digests(formatted).collect()}
    assert {k: (r["n_turns"], r["loss_chars"]) for k, r in digests.items()} == {1: (4, 3), 2: (1, 4), None: (1, 0)}
    assert chat.digests(chat.format_conversations(given.where("false"))).count() == 0


def test_chat_spans_point_at_the_targets(spark):
    given = spark.createDataFrame([(1, 0, "user", "q<s>"), (1, 1, "assistant", "a[INST]"), (1, 2, "user", "more"), (1, 3, "assistant", "b")], "conv_id long, turn long, role string, text string")
    formatted = chat.format_conversations(given)
    whole = formatted.first()["formatted"]
    rows = chat.expand_targets(formatted, materialize=True).orderBy("seq").collect()
    assert [r["target"] for r in rows] == ["a[\\INST]", "b"]
    for r in rows:
        assert whole.startswith(r["context"]) and len(r["context"]) == r["context_chars"]
        assert whole[r["loss_start"] : r["loss_end"]] == r["target"]


def test_language(documents, nothing):
    net = langid.fit(documents.select("text", "lang"), docs_per_language=5)
    found = langid.identify(documents.select("doc_id", "text", "lang"), net).collect()
    by = {r["doc_id"]: r for r in found}
    assert len(found) == documents.count()
    for i in (0, 1, 2, 6):
        assert (by[i]["lang_pred"], by[i]["score"]) == ("und", 0.0)
    assert by[3]["lang_pred"] == "en" and 0 <= by[3]["score"] <= 1
    assert langid.fit(nothing.select("text", "lang")) is None
    assert {r["lang_pred"] for r in langid.identify(documents.select("doc_id", "text"), None).collect()} == {"und"}
    assert langid.identify(nothing.select("doc_id", "text"), net).count() == 0
    clash = documents.where("doc_id in (3, 7)").select("doc_id", "text", F.lit("x").alias("lang_pred"), F.lit("y").alias("score"))
    again = {r["doc_id"]: r for r in langid.identify(clash, net).collect()}
    assert again[3]["score"] == by[3]["score"] and again[7]["lang_pred"] == "en"


def test_packing(documents, nothing):
    rows = packing.pack_documents(documents, capacity=64).collect()
    assert {r["doc_id"] for r in rows} == {*range(len(TEXTS)), None}
    fill = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fill.get(r["sequence_id"], 0)
        fill[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(fill.values()) <= 64
    assert [r["length"] for r in rows if r["doc_id"] == 0] == [1]
    assert packing.pack_documents(nothing).count() == 0
    few = packing.pack_documents(documents, capacity=64, part_pieces=4, max_rounds=2).collect()  # ends in several parts
    assert sum(r["length"] for r in few) == sum(r["length"] for r in rows)


def test_suffix_dedup(documents, nothing):
    rows = {r["doc_id"]: r for r in suffixdedup.removal_digests(documents, 40).collect()}
    assert rows[0]["n_bytes"] == 0 and rows[0]["n_removed"] == 0
    assert rows[3]["n_removed"] == rows[3]["n_bytes"] and rows[3]["n_spans"] == 1
    assert rows[9]["n_removed"] == 5000
    assert rows[8]["n_removed"] == 0
    assert suffixdedup.removal_digests(nothing).count() == 0


def test_kept_text_has_no_broken_characters(spark):
    shared = "é" * 30
    given = spark.createDataFrame([(1, "ab" + shared + "cd"), (2, "xy" + shared + "z")], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in suffixdedup.without_repeats(given, 20).collect()} == {1: "abcd", 2: "xyz"}


def test_token_file(spark, documents, nothing, tmp_path):
    path = str(tmp_path / "tokens")
    tokenfile.write(documents, path)
    rows = tokenfile.read_index(spark, path).collect()
    assert len(rows) == documents.count()
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (0, 1, 2)} == {1}
    total = 0
    for r in sorted(rows, key=lambda r: r["start"]):
        assert r["start"] == total
        total += r["n_tokens"]
    wanted = spark.createDataFrame([(3,), (8,), (99,)], "doc_id long")
    assert sorted(r["doc_id"] for r in tokenfile.read_documents(spark, path, wanted).collect()) == [3, 3, 8]
    with pytest.raises(ValueError):
        tokenfile.SegmentReader(bytes(spark.read.parquet(f"{path}/segments").first()["data"]), b"other")
    empty = str(tmp_path / "empty")
    tokenfile.write(nothing, empty)
    assert tokenfile.read_index(spark, empty).count() == 0


def test_nearest_vectors(spark):
    bad = [(90, None), (91, [0.0, 0.0]), (92, [float("nan"), 1.0]), (93, [1.0, None]), (94, [float("inf"), 0.0]), (95, [1.0]), (None, [1.0, 1.0])]
    rows = [(i, [float(i % 3), 1.0]) for i in range(12)] + bad
    given = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1))
    found = ann.search(given, F.col("vec_id") % 5 == 0, k=4).orderBy("query_id", "rank").collect()
    assert {r["query_id"] for r in found} == {0, 5, 10}
    assert [r["vec_id"] for r in found if r["query_id"] == 5] == [2, 8, 11, 1]
    assert [r["score"] for r in found if r["query_id"] == 5] == [5.0, 5.0, 5.0, 3.0]
    assert ann.search(given.where("false"), F.lit(True)).count() == 0
    assert len(ann.search(given.where("vec_id in (0, 1)"), F.lit(True)).collect()) == 2


def test_near_duplicates(documents, nothing):
    found = neardup.near_duplicate_classes(documents).collect()
    assert len(found) == documents.count() and [r["class_id"] for r in found if r["doc_id"] is None] == [None]
    rows = {r["doc_id"]: r["class_id"] for r in found if r["doc_id"] is not None}
    assert rows[0] == rows[1] == rows[2] == 0
    assert rows[3] == rows[4] == 3
    assert sorted(i for i in rows if rows[i] == i) == [i for i in range(len(TEXTS)) if i not in (1, 2, 4)]
    assert neardup.near_duplicate_classes(nothing).count() == 0


def test_lm_scores(documents, nothing):
    rows = lmscore.score_texts(documents).collect()
    assert len(rows) == documents.count()
    for r in rows:
        assert r["n_known"] <= r["n_tokens"] and r["score"] < 0 and r["base_score"] < 0
    by = {r["doc_id"]: r for r in rows}
    assert by[0]["n_tokens"] == 1 and by[0]["score"] == by[1]["score"]
    assert by[4]["score"] == by[3]["score"]
    assert lmscore.score_texts(nothing).count() == 0


def test_quality(spark, documents, nothing):
    labels = spark.createDataFrame([(3, 2), (4, 2), (4, 0), (5, 1), (None, 2), (6, None), (99, 1)], "doc_id long, grade int")
    grades = quality.graded(labels, F.col("grade"))
    assert {(r["doc_id"], r["grade"]) for r in grades.collect()} == {(3, 2), (4, 0), (5, 1), (99, 1)}
    rows = quality.rate(documents, quality.fit(documents, grades, 3)).collect()
    assert len(rows) == documents.count()
    for r in rows:
        assert 0 <= r["p_at_least_2"] <= r["p_at_least_1"] <= 1
        assert abs(r["expected_grade"] - r["p_at_least_1"] - r["p_at_least_2"]) < 1e-9
    flat = quality.rate(documents, quality.fit(documents, grades.where("false"), 3)).first()
    assert abs(flat["p_at_least_1"] - 2 / 3) < 1e-6
    assert quality.rate(nothing, quality.fit(documents, grades, 3)).count() == 0


def test_decontamination(spark, documents, nothing):
    items = spark.createDataFrame([(1, "How far does Anna walk if Anna goes 5 km in 2 hours and then rests with Bob again today?"), (2, None), (3, "tiny"), (4, "over the lazy dog and then some more words follow")], "item_id long, text string")
    items = items.withColumn("pos", F.lit(0))
    asked = spark.createDataFrame(
        [
            (20, "so how far does Maria walk if Maria goes 7 km in 9 hours and then rests with Tom again today? more"),
            (21, "so how far does Maria walk if Peter goes 7 km in 9 hours and then rests with Tom again today? more"),
            (22, "HOW FAR DOES ANNA WALK IF ANNA GOES 5 KM IN 2 HOURS AND THEN RESTS"),
        ],
        "doc_id long, text string",
    )
    found = {(r["doc_id"], r["item_id"]): r["reparameterised"] for r in decontam.leaks(documents.select("doc_id", "text").unionByName(asked), items).collect()}
    assert found == {(20, 1): True, (22, 1): False, (3, 4): False, (4, 4): False, (5, 4): False}
    assert decontam.leaks(nothing, items).count() == 0
    assert decontam.leaks(documents, items.where("false")).count() == 0


def test_cut_keeps_rows(documents):
    assert cut(documents).count() == documents.count()
