import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from gleaner.llm import decontam

TRAIN = "A train travels 60 km in 2 hours and 90 km in 3 hours how far does it go"


def _leaks(spark, documents, items):
    docs = spark.createDataFrame(documents, "doc_id long, text string")
    found = decontam.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    return {(r["doc_id"], r["item_id"]): (r["n_windows"], r["reparameterised"]) for r in found}


def test_questions_dense_in_numbers(spark):
    documents = [
        (1, "well a train travels 75 km in 4 hours and 20 km in 9 hours how far does it go"),
        (2, "he ran 5 km in 1 hours and 8 km in 7 hours but nobody saw it"),
        (3, "what is 4 plus 9 today"),
    ]
    items = [(1, TRAIN), (2, "what is 12 plus 13 today"), (3, "12 and 13 km")]
    assert _leaks(spark, documents, items) == {(1, 1): (12, True), (3, 2): (1, True)}


PENS = "the shop sells 5 red pens to the first child and later sells 5 blue pens to the second child"


def test_conflicts_leave_other_windows(spark):
    documents = [
        (1, PENS.replace("5 blue", "7 blue")),
        (2, PENS.replace("5 red", "9 red").replace("5 blue", "7 blue")),
        (3, TRAIN.replace("60", "75").replace("90", "20")),
        (3, TRAIN.replace("60", "11").replace("90", "12")),
    ]
    found = _leaks(spark, documents, [(1, PENS), (2, TRAIN)])
    assert {k: v[1] for k, v in found.items()} == {(1, 1): True, (2, 1): True, (3, 2): True}
    assert found[3, 2] == (12, True)


def _brute_force(documents, items, least=3):
    """leaks over lists of (id, words, template), every document row against every item row."""
    placeholders, best = {"<name>", "<num>", "<unit>"}, {}
    for item_id, item, item_template in items:
        n = min(len(item), decontam.WORDS)
        if n < decontam.SHORTEST:
            best |= {(doc_id, item_id): (1.0, 1, 1, False) for doc_id, doc, _ in documents if n and doc == item}
            continue
        total = len(item) - n + 1
        literal = {i for i in range(len(item)) if item_template[i] not in placeholders}
        seen = defaultdict(set)
        for doc_id, doc, doc_template in documents:
            for align in range(-len(item), len(doc)):
                at = [i for i in range(total) if 0 <= i + align <= len(doc) - n]
                seen[doc_id] |= {(i, 0, False) for i in at if item[i : i + n] == doc[i + align : i + align + n]}
                alike = [i for i in at if item_template[i : i + n] == doc_template[i + align : i + align + n] and 0 < len(literal & set(range(i, i + n))) < n]
                uses = defaultdict(Counter)
                slots = {i: [p for p in range(i, i + n) if p not in literal] for i in alike}
                for p in (p for i in alike for p in slots[i]):
                    uses[item_template[p], item[p]][doc[p + align]] += 1
                if any(kind == "<name>" and len(values) > 1 for (kind, _), values in uses.items()):
                    continue
                usual = {k: min(v, key=lambda x, v=v: (-v[x], x)) for k, v in uses.items()}
                kept = [i for i in alike if all(usual[item_template[p], item[p]] == doc[p + align] for p in slots[i])]
                seen[doc_id] |= {(i, 1, any(item[p] != doc[p + align] for p in slots[i])) for i in kept}
        for doc_id, windows in seen.items():
            count = len({i for i, _, _ in windows})
            words = {p for i, form, _ in windows for p in range(i, i + n) if form == 0 or p in literal}
            if count >= min(least, total) and len(words) >= max(decontam.FEWEST, min(decontam.LITERAL, len(literal))):
                found = (count / total, count, total, any(other for _, _, other in windows))
                best[doc_id, item_id] = max(best.get((doc_id, item_id), found), found)
    return {k: v[1:] for k, v in best.items()}


def test_leaks_are_those_of_a_brute_force_search(spark):
    rng = random.Random(3)
    word = lambda: rng.choice("the shop sells red pens to Anna Bob Carl in 2 3 5 7 km hours and later % 12.5".split())
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i % 9, text(rng.choice([3, 4, 5, 6, 7, 8, 9, 12, 16]))) for i in range(14)] + [(20, TRAIN), (21, PENS), (22, None), (None, text(11))]

    def changed(t):
        return " ".join(word() if rng.random() < 0.04 else rng.choice("235789") if w.isdigit() and rng.random() < 0.6 else w for w in t.split())

    documents = [(i % 50, text(rng.randint(0, 5)) + " " + changed(rng.choice(items)[1] or "") + " " + text(rng.randint(0, 20))) for i in range(70)]
    documents += [(70, f"The  {word()}!"), (71, "-- Tiny item."), (72, "tiny item more"), (None, "tiny ITEM")]
    items += [(30, "tiny item"), (31, "12.5"), (32, "%")]
    documents += [(73, " 12.5 "), (74, "% %")]
    documents += [(None, changed(TRAIN)), (None, None), (60, documents[0][1]), (60, documents[0][1])]
    docs, asked = spark.createDataFrame(documents, "id long, text string"), spark.createDataFrame(items, "id long, text string")
    sides = []
    for side in (docs, asked):
        words = decontam._prepared(side, "id").select("id", decontam.plain("words").alias("words"), F.coalesce("template", decontam.plain("words")).alias("template"))
        sides.append([tuple(r) for r in words.collect()])
    found = decontam.leaks(docs.withColumnRenamed("id", "doc_id"), asked.withColumnRenamed("id", "item_id")).collect()
    expected = _brute_force(*sides)
    assert {(r["doc_id"], r["item_id"]): (r["n_windows"], r["item_windows"], r["reparameterised"]) for r in found} == expected
    assert len(found) == len(expected) > 20


def test_documents_without_wanted_windows_are_passed_over(spark, monkeypatch):
    docs = [(1, "it was told that Anna bought 12 red apples at the old market in May"), (2, "nothing of that kind is in here at all, nor is it there"), (3, None), (4, "told that Peter bought 7 red apples at the old market in May")]
    items = [(1, "told that Maria bought 5 red apples at the old market in June"), (2, "short words of five here")]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    told = decontam.windows(table, 8, "doc_id").collect()
    wanted = [r["hash"] for r in told if r["doc_id"] == 4][:2]
    assert {r["doc_id"] for r in told} == {1, 2, 4}
    assert {r["doc_id"] for r in decontam.windows(table, 8, "doc_id", wanted=wanted).collect()} == {4}
    assert decontam.windows(table, 8, "doc_id", wanted=[]).count() == 0
    listed = _leaks(spark, docs, items)
    assert set(listed) == {(1, 1), (4, 1)}
    monkeypatch.setattr(decontam, "LISTED_WINDOWS", 0)
    assert _leaks(spark, docs, items) == listed


def test_words_of_odd_texts(spark):
    texts = {
        "12 % of A, 5%x %": ["12", "%", "of", "a", "5", "x"], "3 %x and 4%)": ["3", "x", "and", "4", "%"], "1,5mm Éa\nBéla x2": ["1,5", "mm", "éa", "béla", "x2"],
        "a Bc;\tDe: Fg É": ["a", "bc", "de", "fg", "é"], "%%": [], "": [],
    }
    said = decontam.plain(decontam.marked_words(F.col("text")))
    table = spark.createDataFrame([(t,) for t in texts], "text string")
    found = {r["text"]: [w.replace(decontam.POINT, ",") for w in r["w"]] for r in table.select("text", said.alias("w")).collect()}
    assert found == texts
