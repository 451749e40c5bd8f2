"""The registered queries: each applies one operator, with production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kernelloom.llm import ann, conversations, decontam, mixing, neardup, notices, pseudonyms, quality, ransfile, resample, setjoin, urlfilter, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of documents: doc_id, n_shingles, component_id, kept."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN ws IS NULL OR len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
         ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(node, low) AS (SELECT a, a FROM u UNION SELECT u.b, r.low FROM r JOIN u ON u.a = r.node WHERE r.low < u.b),
c AS (SELECT node, min(low) AS low FROM r GROUP BY node)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.low, d.doc_id) AS component_id,
       coalesce(c.low, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.node = d.doc_id
"""


def op2_anisotropic_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors by cosine of every vector whose id is divisible by 50."""
    return ann.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document a mix of sources by weights 1, 2, 3 takes."""
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"))
    each = plan.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    each = each.withColumn("copies", F.col("copies") + (F.col("i") <= F.col("more")).cast("long"))
    return each.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def op4_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, as it is or with other parameters."""
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """A public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_rans_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, written and read back: doc_id, start, n_tokens, ids_crc32."""
    return ransfile.token_file_index(table(spark, sf_dir, "documents"), tokenizer_path())


#: The key of the registered query; a real run keeps its own secret.
PSEUDONYM_KEY = "kernelloom-example-key"


def op6_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced: doc_id, text, n_private, private_kinds."""
    made = pseudonyms.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PSEUDONYM_KEY)
    return made.select("doc_id", "text", "n_private", "private_kinds")


def op7_fuzzy_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in every document."""
    return notices.digest(notices.scan_notices(table(spark, sf_dir, "documents")))


def op8_random_indexing_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score: doc_id, held_out, score, predicted."""
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), ~quality.held_out())
    scored = quality.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", quality.held_out().alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.3).cast("int").alias("predicted"))


def op9_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on every page's url."""
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"))


def op10_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to WARC archives and read back by the salvaging reader."""
    back = warc.verified_round_trip(table(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_size_aware_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents by an exact Jaccard join: doc_id, n_shingles, component_id."""
    return setjoin.jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest repair of every conversation after the test damage."""
    turns = table(spark, sf_dir, "conversations")
    return conversations.repair(turns, conversations.damaged(turns))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn by their likeness to the benchmark: doc_id, n_features, weight, score, rank."""
    made = resample.importance(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return made.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_neardup": op1_minhash_neardup,
    "op2_anisotropic_ann": op2_anisotropic_ann,
    "op3_entropy_mixing": op3_entropy_mixing,
    "op4_template_decontamination": op4_template_decontamination,
    "op5_rans_token_files": op5_rans_token_files,
    "op6_feistel_pseudonyms": op6_feistel_pseudonyms,
    "op7_fuzzy_notices": op7_fuzzy_notices,
    "op8_random_indexing_quality": op8_random_indexing_quality,
    "op9_url_verdicts": op9_url_verdicts,
    "op10_warc_round_trip": op10_warc_round_trip,
    "op11_size_aware_join": op11_size_aware_join,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_importance_resampling": op13_importance_resampling,
}

OP10_SQL = r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
t AS (SELECT payload_digest, max(page_id) AS top FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
       CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < top THEN top END AS refers_to
FROM p LEFT JOIN t ON t.payload_digest = p.payload_digest AND payload_bytes >= 1000
"""


OP11_SQL = OP1_SQL.replace("len(ws) < 5", "len(ws) < 4").replace("len(ws) - 3", "len(ws) - 2").replace("i + 4", "i + 3").replace("75 *", "85 *")
OP11_SQL = OP11_SQL.replace(""" AS component_id,
       coalesce(c.low, d.doc_id) = d.doc_id AS kept""", " AS component_id")

#: The CRC-32 of each byte, and of a text's bytes as a function of their list.
_CRC_TABLE = """t AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k:
  CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i)))"""


def _crc(bytes_: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bytes_}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


OP12_SQL = rf"""
WITH RECURSIVE {_CRC_TABLE},
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS r, coalesce(text, ' ') AS x, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS s FROM conversations),
h AS (SELECT k.*, {_crc("list_transform(string_split(s, ''), lambda ch: CAST(ascii(ch) AS BIGINT))")} % 20 AS code FROM k, t),
d AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE r END AS r,
        CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(x, '[.!?]', '', 'g') ELSE x END AS x FROM h, range(2) c(i) WHERE code <> 0 AND (i = 0 OR code = 3)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, sha256(x)) AS n FROM d),
f AS (SELECT *, left(r, 1) AS a, lag(left(r, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS b,
        CASE WHEN NOT regexp_matches(x, '[^ 	-
]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, r, x ORDER BY n) > 1 THEN 'duplicate'
             WHEN NOT regexp_matches(x, '[.!?][ 	-
]*$') THEN 'truncated' ELSE '' END AS fault FROM o),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
        count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
        count(*) FILTER (b IS NOT NULL AND b || a NOT IN ('su', 'ua', 'au')) AS illegal, max(n) AS n FROM f GROUP BY conv_id),
e AS (SELECT conv_id, n, a, fault IN ('', 'truncated') AS may, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS more FROM f),
p(conv_id, n, s0, s1, s2, s3) AS (
  SELECT conv_id, CAST(0 AS BIGINT), {{'c': 0, 'w': ''}}, {{'c': 1000000000, 'w': ''}}, {{'c': 3, 'w': 'I'}}, {{'c': 6, 'w': 'II'}} FROM g
  UNION ALL
  SELECT conv_id, n, z0, z1, least(z2, {{'c': z0.c + 3, 'w': z0.w || 'I'}}, {{'c': z1.c + 3, 'w': z1.w || 'I'}}, {{'c': z3.c + 3, 'w': z3.w || 'I'}}),
         least(z3, {{'c': z2.c + 3, 'w': z2.w || 'I'}}, {{'c': z0.c + 6, 'w': z0.w || 'II'}}, {{'c': z1.c + 6, 'w': z1.w || 'II'}})
  FROM (SELECT e.conv_id, e.n, {{'c': s0.c + 4, 'w': s0.w || 'D'}} AS z0,
          least({{'c': s1.c + 4, 'w': s1.w || 'D'}}, {{'c': s0.c + CASE WHEN may AND a = 's' THEN more ELSE 1000000000 END, 'w': s0.w || 'K'}}) AS z1,
          least({{'c': s2.c + 4, 'w': s2.w || 'D'}}, {{'c': u.c + CASE WHEN may AND a = 'u' THEN more ELSE 1000000000 END, 'w': u.w || 'K'}},
                {{'c': u.c + CASE WHEN may THEN more + 3 ELSE 1000000000 END, 'w': u.w || 'R'}}) AS z2,
          least({{'c': s3.c + 4, 'w': s3.w || 'D'}}, {{'c': s2.c + CASE WHEN may AND a = 'a' THEN more ELSE 1000000000 END, 'w': s2.w || 'K'}},
                {{'c': s2.c + CASE WHEN may THEN more + 3 ELSE 1000000000 END, 'w': s2.w || 'R'}}) AS z3
        FROM (SELECT *, least(s0, s1, s3) AS u FROM p) p JOIN e ON e.conv_id IS NOT DISTINCT FROM p.conv_id AND e.n = p.n + 1)),
z AS (SELECT g.*, least(s0, s3).c AS cost, least(s0, s3).w AS audit FROM p JOIN g ON g.conv_id IS NOT DISTINCT FROM p.conv_id AND g.n = p.n),
l AS (SELECT conv_id, audit[i] AS w, i, sum(CASE WHEN audit[i] <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY i) AS n
      FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS i FROM z)),
q AS (SELECT l.conv_id, l.w, f.r, CASE WHEN l.w = 'I' THEN '' ELSE f.x END AS x, row_number() OVER (PARTITION BY l.conv_id ORDER BY l.i) AS m
      FROM l LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.n = l.n WHERE l.w <> 'D'),
v AS (SELECT *, max(CASE WHEN m = 1 AND w = 'K' AND left(r, 1) = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS s FROM q),
y AS (SELECT conv_id, sha256(string_agg((CASE WHEN w = 'K' THEN r WHEN (m - s) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || x, chr(10) ORDER BY m)) AS h FROM v GROUP BY conv_id)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, coalesce(y.h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN y ON y.conv_id IS NOT DISTINCT FROM i.conv_id
"""

_FEATURES = r"""SELECT doc_id, unnest(ws) AS f FROM {w} UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM {w}
  UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) FROM {w}"""
_LETTERS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP13_SQL = rf"""
WITH {_CRC_TABLE},
wd AS (SELECT doc_id, {_LETTERS} AS ws FROM documents),
wt AS (SELECT 0 AS doc_id, {_LETTERS} AS ws FROM benchmark),
fd AS (SELECT doc_id, f, count(*) AS n FROM ({_FEATURES.format(w="wd")}) GROUP BY 1, 2),
ft AS (SELECT f, count(*) AS n FROM ({_FEATURES.format(w="wt")}) GROUP BY 1),
hx AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM fd UNION SELECT f FROM ft)),
b AS (SELECT f, {_crc("list_transform(range(1, length(h), 2), lambda i: CAST(16 * (strpos('0123456789ABCDEF', h[i]) - 1) + strpos('0123456789ABCDEF', h[i + 1]) - 1 AS BIGINT))")} % 10000 AS b FROM hx, t),
s AS (SELECT b, sum(n) AS n FROM fd JOIN b USING (f) GROUP BY b),
tt AS (SELECT b, sum(n) AS n FROM ft JOIN b USING (f) GROUP BY b),
g AS (SELECT b.b, CAST(floor(1000 * ln((CAST(coalesce(tt.n, 0) AS DOUBLE) + 1) * (CAST((SELECT coalesce(sum(n), 0) FROM s) AS DOUBLE) + 10000) / ((CAST(coalesce(s.n, 0) AS DOUBLE) + 1) * (CAST((SELECT coalesce(sum(n), 0) FROM tt) AS DOUBLE) + 10000)))) AS BIGINT) AS g
      FROM (SELECT DISTINCT b FROM b) b LEFT JOIN s USING (b) LEFT JOIN tt USING (b)),
w AS (SELECT fd.doc_id, sum(fd.n) AS n, sum(fd.n * g.g) AS weight FROM fd JOIN b USING (f) JOIN g USING (b) GROUP BY fd.doc_id),
a AS (SELECT wd.doc_id, len(ws) >= 20 AS fit, CAST(coalesce(w.n, 0) AS BIGINT) AS n_features, CAST(coalesce(w.weight, 0) AS BIGINT) AS weight,
        CAST('0x' || left(sha256('42:' || wd.doc_id), 8) AS BIGINT) AS h FROM wd LEFT JOIN w ON w.doc_id = wd.doc_id),
c AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM a),
r AS (SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY fit) AS n FROM c)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= 5 * n // 100 THEN place END AS rank FROM r
"""


ORACLES: dict[str, str] = {
    "op11_size_aware_join": OP11_SQL,
    "op12_conversation_repair": OP12_SQL,
    "op13_importance_resampling": OP13_SQL,
    "op10_warc_round_trip": OP10_SQL,
    "op1_minhash_neardup": OP1_SQL,
}
