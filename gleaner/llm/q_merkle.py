"""op12: the manifest of all documents, checked against copies some of which lost their line ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import merkle
from gleaner.llm.common import crc_mod, table

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*FIELDS, F.replace("text", F.lit("\n"), F.lit("")).alias("_bare"))
    head = [merkle.field(name) for name in FIELDS[:-1]]
    changes = (crc_mod("doc_id", 2) == 0) & F.contains("text", F.lit("\n"))
    altered = F.when(changes, merkle.leaf_of(*head, merkle.field("_bare")))
    return merkle.manifest(docs, "source", "doc_id", merkle.leaf_of(*head, merkle.field("text")), altered)


def _leaf(text: str) -> str:
    sizes = [f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen({x}::VARCHAR) || ':' || {x} END" for x in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(sizes)})"


_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], [ascii(c)::BIGINT FOR c IN string_split(doc_id::VARCHAR, '')]),
  lambda c, b: list_reduce(list_concat([xor(c, b)], [0::BIGINT FOR k IN range(8)]), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""

ORACLE = f"""WITH RECURSIVE d AS (SELECT doc_id, source, {_leaf('text')} AS leaf, CASE WHEN {_CRC} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} END AS altered,
    row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM documents),
  own(source, level, pos, n, digest) AS (SELECT source, 0, pos, n, leaf FROM d UNION ALL
    SELECT source, level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM own WHERE n > 1 GROUP BY source, level, pos // 3, n),
  subroots AS (SELECT source, digest, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM own WHERE n = 1),
  every(level, pos, n, digest) AS (SELECT 0, pos, n, digest FROM subroots UNION ALL
    SELECT level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM every WHERE n > 1 GROUP BY level, pos // 3, n),
  tree AS (SELECT 's' || coalesce('+' || source, '-') AS g, level, pos, n, digest FROM own UNION ALL SELECT 'all', level, pos, n, digest FROM every),
  siblings AS (SELECT a.g, a.level, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
    FROM tree a JOIN tree b ON a.g = b.g AND a.level = b.level AND a.pos // 3 = b.pos // 3 AND a.n > 1 GROUP BY ALL),
  climb(doc_id, leaf, own_g, g, level, pos, h, proof) AS (SELECT doc_id, leaf, 's' || coalesce('+' || source, '-'), 's' || coalesce('+' || source, '-'), 0, pos, coalesce(altered, leaf), '' FROM d
    UNION ALL SELECT c.doc_id, c.leaf, c.own_g, c.g, c.level + 1, c.pos // 3, sha256(s.l || c.h || s.r), c.proof || s.l || s.r FROM climb c JOIN siblings s ON s.g = c.g AND s.level = c.level AND s.pos = c.pos),
  low AS (SELECT * FROM climb QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY level DESC) = 1),
  high(doc_id, leaf, own_g, level, pos, h, proof) AS (SELECT doc_id, leaf, own_g, 0, s.pos, h, proof FROM low JOIN subroots s ON own_g = 's' || coalesce('+' || s.source, '-')
    UNION ALL SELECT c.doc_id, c.leaf, c.own_g, c.level + 1, c.pos // 3, sha256(s.l || c.h || s.r), c.proof || s.l || s.r FROM high c JOIN siblings s ON s.g = 'all' AND s.level = c.level AND s.pos = c.pos),
  last AS (SELECT * FROM high QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY level DESC) = 1), root AS (SELECT digest FROM every WHERE n = 1)
  SELECT doc_id, leaf, s.digest AS subroot, root.digest AS root, sha256(proof) AS proof_sha256, h AS folded_root, h = root.digest AS verified FROM last JOIN subroots s ON own_g = 's' || coalesce('+' || s.source, '-'), root"""
