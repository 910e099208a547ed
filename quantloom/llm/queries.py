"""The corpus operators as queries over (spark, sf_dir), with DuckDB twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import licences, lmscore, lzprint, merkle, pagetext, quality, secretscan, tokencounts, whiten
from .decontaminate import contamination
from .licence_sql import oracle as licence_oracle
from .linededup import dedup_lines
from .mix import mix
from .simhash import near_duplicates


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return contamination(docs, _table(spark, sf_dir, "benchmark")).drop("text_hash")


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.pseudo_likelihood(_table(spark, sf_dir, "documents"))


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents")).drop("source")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents")).drop("text_hash")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.digest(secretscan.secrets(_table(spark, sf_dir, "documents")))


def op6_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagetext.extract(_table(spark, sf_dir, "pages"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, _table(spark, sf_dir, "labels"))
    return quality.grade(docs, model)


def op9_lz_print(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lzprint.edit_likeness(_table(spark, sf_dir, "documents"))


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_table(spark, sf_dir, "documents"))


def op11_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whiten(_table(spark, sf_dir, "embeddings"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts with an empty cache, so every distinct content is encoded."""
    import public_tokenizers

    words = tokencounts.Vocabulary.load(public_tokenizers.path("word_bpe_49k.json"), spaces_drop=True, case_drops=True)
    return tokencounts.count_tokens(_table(spark, sf_dir, "documents"), words, tokencounts.new_cache(spark))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tamper_check(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_lm_score": op2_lm_score,
    "op3_mix": op3_mix,
    "op4_simhash": op4_simhash,
    "op5_secrets": op5_secrets,
    "op6_page_text": op6_page_text,
    "op7_line_dedup": op7_line_dedup,
    "op8_quality": op8_quality,
    "op9_lz_print": op9_lz_print,
    "op10_licences": op10_licences,
    "op11_whiten": op11_whiten,
    "op12_token_counts": op12_token_counts,
    "op13_merkle": op13_merkle,
}

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: CRC-32 of a decimal id, bit by bit.
_CRC = (
    "xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), "
    "lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1))), 4294967295::BIGINT), 4294967295)"
)


def _leaf(chars: str) -> str:
    return " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", chars, "text"))


ORACLES = {
    "op1_decontaminate": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, '{_WORD}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOW}, '{_WORD}') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, list_slice(w, s, s + least(13, len(w)) - 1) AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS s FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, s, list_slice(w, s, s + n - 1) AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT doc_id, s, dw.n, item_id FROM dw JOIN win USING (n, win)),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM hit GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op3_mix": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS name FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3] AS w, 2.0::DOUBLE * source_size AS cap FROM s),
f AS (SELECT *, cap / w AS fill FROM w),
l AS (SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ()) - coalesce(sum(cap) OVER o, 0.0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0.0)) AS level
  FROM f WINDOW o AS (ORDER BY fill, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap, w * coalesce((SELECT arg_min(level, fill) FROM l WHERE level <= fill), 'inf'::DOUBLE)) AS target FROM l),
r AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS copies,
  row_number() OVER (PARTITION BY d.source ORDER BY class, ('0x' || substr(name, 1, 8))::BIGINT % ceil(c_rows / 5000)::BIGINT, name, size) AS rank,
  ('0x' || substr(md5(coalesce('7:' || d.source, '7/')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM (SELECT *, floor(log2(size + 1) * 4 + 1e-9) AS class, count(*) OVER (PARTITION BY source, floor(log2(size + 1) * 4 + 1e-9)) AS c_rows FROM d) AS d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (floor(rank * copies + u) - floor((rank - 1) * copies + u))::BIGINT AS copies,
  (floor(rank * copies + u) - floor((rank - 1) * copies + u))::BIGINT * size AS taken FROM r""",
    "op7_line_dedup": r"""
WITH l AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)),
rep AS (SELECT key, max(doc_id) AS keeper FROM l WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT l.*, rep.key IS NULL OR doc_id = keeper AS stays FROM l LEFT JOIN rep USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (stays), '')) AS kept_sha256
FROM m GROUP BY doc_id""",
    "op10_licences": licence_oracle(),
    "op13_merkle": rf"""
WITH RECURSIVE d AS (SELECT doc_id, lang, source, n_chars, text, n_chars + CASE WHEN {_CRC} % 7 = 0 THEN 1 ELSE 0 END AS shown_chars FROM documents),
l AS (SELECT doc_id, lang, sha256({_leaf("n_chars")}) AS leaf, sha256({_leaf("shown_chars")}) AS shown FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM l),
t AS (SELECT lang, 0 AS lvl, pos, leaf AS node, n FROM p
  UNION ALL SELECT lang, lvl + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), (n + 1) // 2 FROM t WHERE n > 1 GROUP BY lang, lvl, pos // 2, n),
s AS (SELECT lang, node AS subroot, lvl AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS lvl, pos, subroot AS node, n FROM s
  UNION ALL SELECT lvl + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), (n + 1) // 2 FROM u WHERE n > 1 GROUP BY lvl, pos // 2, n),
low AS (SELECT p.doc_id, p.lang, p.pos AS id, t.lvl, (p.pos >> t.lvl) & 1 AS side, (SELECT node FROM t AS x WHERE x.lang IS NOT DISTINCT FROM t.lang AND x.lvl = t.lvl AND x.pos = xor(t.pos, 1)) AS sibling
  FROM p JOIN t ON p.lang IS NOT DISTINCT FROM t.lang AND t.pos = p.pos >> t.lvl WHERE t.n > 1),
high AS (SELECT p.doc_id, p.lang, p.pos AS id, s.height + u.lvl AS lvl, (s.pos >> u.lvl) & 1 AS side, (SELECT node FROM u AS x WHERE x.lvl = u.lvl AND x.pos = xor(u.pos, 1)) AS sibling
  FROM p JOIN s ON p.lang IS NOT DISTINCT FROM s.lang JOIN u ON u.pos = s.pos >> u.lvl WHERE u.n > 1),
way AS (SELECT * FROM low UNION ALL SELECT * FROM high),
proof AS (SELECT lang, id, sha256(coalesce(string_agg(sibling, '' ORDER BY lvl), '')) AS proof_sha256 FROM way GROUP BY lang, id),
f AS (SELECT lang, pos AS id, 0 AS lvl, shown AS node FROM p
  UNION ALL SELECT f.lang, f.id, f.lvl + 1, sha256(CASE WHEN w.sibling IS NULL THEN f.node WHEN w.side = 1 THEN w.sibling || f.node ELSE f.node || w.sibling END)
  FROM f JOIN way AS w ON w.lang IS NOT DISTINCT FROM f.lang AND w.id = f.id AND w.lvl = f.lvl),
top AS (SELECT lang, id, arg_max(node, lvl) AS folded_root FROM f GROUP BY lang, id)
SELECT p.doc_id, p.leaf, s.subroot, r.node AS root, coalesce(proof.proof_sha256, sha256('')) AS proof_sha256, top.folded_root, top.folded_root = r.node AS verified
FROM p JOIN s ON p.lang IS NOT DISTINCT FROM s.lang JOIN (SELECT node FROM u WHERE n = 1) AS r ON true
  LEFT JOIN proof ON proof.lang IS NOT DISTINCT FROM p.lang AND proof.id = p.pos JOIN top ON top.lang IS NOT DISTINCT FROM p.lang AND top.id = p.pos""",
}
