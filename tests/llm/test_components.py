import random

import pytest

from gleaner.llm import components


def _expected(links):
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {x: top(x) for x in root}


def _shuffled_chain(n, rng):
    ids = rng.sample(range(10 * n), n)
    return list(zip(ids, ids[1:]))


@pytest.mark.parametrize("part", [7, 60, 20_000])
def test_components_are_those_of_union_find(spark, part):
    rng = random.Random(part)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(140)]
    links += [(1000, 1001 + i) for i in range(90)] + [(a + 2000, b + 2000) for a, b in _shuffled_chain(60, rng)] + [(-5, 7), (3, 3)]
    found = components.components(spark.createDataFrame(links, "a long, b long"), part).collect()
    assert {r["id"]: r["component"] for r in found} == _expected([x for x in links if x[0] != x[1]])
    assert len(found) == len({r["id"] for r in found})


def test_stars_reach_the_fixed_point(spark):
    links = _shuffled_chain(200, random.Random(1))
    table = spark.createDataFrame([(min(x), max(x)) for x in links], "a long, b long")
    assert {r["id"]: r["component"] for r in components._stars(table).collect()} == _expected(links)


def test_no_links(spark):
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_equal_rows_of_files_spread_over_blocks(spark, tmp_path):
    """A row that stands a third of a table is no block's alone, nor is it any part's in packing."""
    import statistics

    from pyspark.sql import functions as F

    from gleaner.llm import exchange, packing
    from gleaner.llm.common import cut

    rows = spark.range(20_000).select(F.lit(7).alias("doc_id"), F.lit("the same words").alias("text"))
    rows = rows.unionByName(spark.range(40_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("other words "), F.col("id").cast("string")).alias("text")))
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").select("text", "doc_id")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        blocks, n = exchange.blocked(docs)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    sizes = [r["count"] for r in blocks.groupBy("block").count().collect()]
    assert n == len(sizes) == 16 and max(sizes) < 1.2 * statistics.median(sizes)
    where = lambda: sorted((r.block, r.doc_id) for r in blocks.where("doc_id = 7").collect())
    assert where() == where()
    pieces = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(1500).cast("long").alias("length"), F.lit(5).cast("long").alias("ids_crc32"))
    packed = packing.pack(cut(pieces), part_pieces=300)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0
    assert packed.select("sequence_id").distinct().count() == 1500


def test_long_texts_are_read_in_stretches(spark, monkeypatch):
    """Cutting texts into stretches changes no hash, no shingle and no removed byte."""
    import numpy as np
    import pyarrow as pa

    from gleaner.llm import bytetools, exchange, suffixdedup

    text = " ".join(["ab", "c" * 90, "d"] * 40 + [f"w{i}" for i in range(300)]).encode()
    data = np.frombuffer(text, dtype=np.uint8)
    starts, ends = bytetools.word_spans(data)
    whole = bytetools.span_hash(bytetools.prefix(data), starts, ends)
    for stretch in (1, 64, 1000, 1 << 20):
        monkeypatch.setattr(bytetools, "STRETCH", stretch)
        assert (bytetools.word_hashes(data, starts, ends) == whole).all()
    assert len(bytetools.word_hashes(data[:0], starts[:0], ends[:0])) == 0

    def found(block):
        answers = exchange.to_table([], exchange.ANSWER)
        return suffixdedup._apply(block, answers, 50, suffixdedup._digest, suffixdedup.OUT, ["more"]).to_pylist()

    block = pa.table({"doc_id": [1, 2, 3], "text": [text.decode(), "", "x" * 49], "block": pa.array([0] * 3, pa.int32()), "more": [5, 6, 7]})
    one = found(block)
    marked = np.random.default_rng(1).random(len(text) + 1) < 0.01
    cover = suffixdedup.covered(marked, 50)
    assert cover.tolist() == [bool(marked[max(0, i - 49) : i + 1].any()) for i in range(len(text))]
    monkeypatch.setattr(suffixdedup, "STRETCH", 128)
    monkeypatch.setattr(suffixdedup, "BATCH", 256)
    assert found(block) == one and (suffixdedup.covered(marked, 50) == cover).all()
    rng = np.random.default_rng(2)
    same = "".join(map(chr, rng.integers(97, 123, 700)))
    rows = [(1, same[:400] + "?" + same[100:700]), (2, "".join(map(chr, rng.integers(97, 123, 900))) + same[50:350]), (3, same[300:380])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.text) for r in suffixdedup.removal_digests(docs, 60).collect()}
    places = {}
    for d, t in rows:
        for i in range(len(t) - 59):
            places.setdefault(t[i : i + 60], []).append((d, i))
    gone = {(d, j) for at in places.values() if len(at) > 1 for d, i in at for j in range(i, i + 60)}
    assert got == {d: (sum((d, j) in gone for j in range(len(t))), "".join(c for j, c in enumerate(t) if (d, j) not in gone)) for d, t in rows}
