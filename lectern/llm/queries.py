"""The registered queries of this subpackage, with SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from lectern.llm.common import scratch_path
from lectern.llm.conversations import damaged, repaired_report
from lectern.llm.exact_dedup import exact_duplicates
from lectern.llm.html_main import main_texts
from lectern.llm.langid import held_out_of, label_languages, learn
from lectern.llm.mixing import mix
from lectern.llm.near_vectors import near_duplicates
from lectern.llm.negatives import mine_negatives
from lectern.llm.ngram_join import Join, jaccard_components
from lectern.llm.telephony import encode_media, media_features
from lectern.llm.token_store import verified_documents, write_store
from lectern.llm.toxicity import score_toxicity
from lectern.llm.url_filter import judge_urls
from lectern.llm.word_bpe import bpe_round_trip


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-store")
    write_store(_table(spark, sf_dir, "documents"), path, _tokenizer("byte_bpe_50k.json"), end_id=0)
    return verified_documents(spark, path)


def op2_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "media")
    encode_media(_table(spark, sf_dir, "documents")).write.option("compression", "zstd").parquet(path)
    stored = spark.read.schema("doc_id long, n_bytes long, media binary").parquet(path)
    return media_features(stored)


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"), Join(words=4, percent=85))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = learn(docs.filter(F.col("lang").isNotNull() & ~held_out_of(F.col("doc_id"), 3, 1)))
    return label_languages(docs, model).select("doc_id", held_out_of(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_table(spark, sf_dir, "documents"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op7_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(_table(spark, sf_dir, "pages"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels").filter(~held_out_of(F.col("doc_id"), 5, 0))
    scored = score_toxicity(_table(spark, sf_dir, "documents"), labels)
    evidence = F.concat_ws(",", F.transform("evidence", lambda e: F.concat_ws(":", e["doc_id"].cast("string"), e["toxic"].cast("string"))))
    return scored.select("doc_id", held_out_of(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted", evidence.alias("evidence"))


def op10_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe_round_trip(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))
    ids = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_negatives(rows.select("vec_id", "embedding", label.alias("label")), F.col("vec_id") % 50 == 0)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations")
    return repaired_report(rows, damaged(rows))


def op13_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_store, op2_telephony, op3_ngram_join, op4_language_id, op5_exact_dedup, op6_source_mix, op7_html_main_text, op8_url_filter, op9_toxicity, op10_word_bpe, op11_hard_negatives, op12_conversation_repair, op13_near_vectors)}


_OP5 = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
g AS (SELECT doc_id, sha256(norm) AS text_sha256, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM g
"""

_OP6 = r"""
WITH q AS (SELECT doc_id, max(quality) AS q FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (SELECT d.doc_id, d.source, len(regexp_extract_all(coalesce(d.text, ''), '[^\x20\x09-\x0D]+')) :: BIGINT AS size,
  CASE WHEN q.q >= 1 THEN 2.0 :: DOUBLE WHEN q.q <= 0 THEN 0.5 :: DOUBLE ELSE 1.0 :: DOUBLE END AS weight FROM documents d LEFT JOIN q ON d.doc_id = q.doc_id),
k AS (SELECT *, -ln((('0x' || substr(md5('mix' || coalesce(doc_id :: VARCHAR, '')), 1, 12)) :: BIGINT + 0.5 :: DOUBLE) / 281474976710656.0 :: DOUBLE) / weight AS key FROM d),
s AS (SELECT source, sum(size) :: BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, list_extract([5, 2, 1], ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1) :: INT) :: BIGINT AS w, source_size * 2 AS fullsize FROM s),
l AS (SELECT *, fullsize :: DOUBLE / w AS ratio, (1.5 :: DOUBLE * sum(source_size) OVER () :: BIGINT - coalesce(sum(fullsize) OVER b, 0) :: BIGINT) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) :: BIGINT AS lev
  FROM w WINDOW b AS (ORDER BY fullsize :: DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
o AS (SELECT lev AS water FROM l WHERE lev < ratio ORDER BY ratio, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN lev < ratio THEN (SELECT water FROM o) * w ELSE fullsize :: DOUBLE END AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2) :: BIGINT ELSE 0 END AS epochs FROM t),
p AS (SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
  coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) :: BIGINT AS before
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source),
c AS (SELECT *, CASE WHEN size > 0 THEN epochs + CASE WHEN rest > 0 AND before + size / 2.0 :: DOUBLE <= rest THEN 1 ELSE 0 END ELSE 0 END :: BIGINT AS copies FROM p)
SELECT doc_id, size, source_size, target, (copies * size) :: BIGINT AS taken, copies FROM c
"""


_OP3 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, CASE WHEN len(ws) >= 4 THEN list_distinct(list_transform(range(1, len(ws) - 2), lambda i: concat_ws(' ', ws[i], ws[i + 1], ws[i + 2], ws[i + 3]))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS shs FROM w),
m AS (SELECT doc_id, shs, len(shs) :: BIGINT AS n, md5(array_to_string(list_sort(shs), chr(10))) AS sig FROM l),
one AS (SELECT sig, min(doc_id) AS rep, any_value(n) AS n, any_value(shs) AS shs FROM m WHERE n > 0 GROUP BY sig),
s AS (SELECT rep, n, unnest(shs) AS sh FROM one),
p AS (SELECT a.rep AS x, b.rep AS y, count(*) AS o, any_value(a.n) AS nx, any_value(b.n) AS ny FROM s a JOIN s b ON a.sh = b.sh AND a.rep <> b.rep GROUP BY a.rep, b.rep),
e AS (SELECT x, y FROM p WHERE 100 * o >= 85 * (nx + ny - o)),
r AS (SELECT rep AS x, rep AS root FROM one UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.x),
c AS (SELECT x, min(root) AS component_id FROM r GROUP BY x),
k AS (SELECT x, count(*) AS links FROM e GROUP BY x)
SELECT m.doc_id, m.n AS n_shingles, coalesce(c.component_id, m.doc_id) AS component_id, coalesce(k.links, 0) :: BIGINT AS links
FROM m LEFT JOIN one ON m.sig = one.sig AND m.n > 0 LEFT JOIN c ON c.x = one.rep LEFT JOIN k ON k.x = one.rep
"""


_OP11 = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x :: DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same, list_dot_product(a.q, c.q) :: BIGINT AS score FROM r a JOIN r c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score, (row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id)) :: INT AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""


_OP13 = """
WITH RECURSIVE v AS (SELECT vec_id, embedding :: DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS x, vec_id AS root FROM v UNION SELECT l.y, r.root FROM r JOIN l ON l.x = r.x),
c AS (SELECT x, min(root) AS component_id FROM r GROUP BY x),
k AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT e.vec_id, coalesce(k.n, 0) :: BIGINT AS n_links, coalesce(c.component_id, e.vec_id) AS component_id, coalesce(c.component_id, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN c ON c.x = e.vec_id LEFT JOIN k ON k.x = e.vec_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_ngram_join": _OP3, "op5_exact_dedup": _OP5, "op6_source_mix": _OP6, "op11_hard_negatives": _OP11, "op13_near_vectors": _OP13}
