"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remainder, table, text_of
from .exact_dedup import exact_duplicates
from .hard_negatives import mine
from .language_id import identify_languages, language_samples, learnable
from .line_dedup import dedup_lines
from .mixing import mix_sources
from .ngram_join import jaccard_components
from .packing import pack
from .sharding import hilbert_shards
from .substring_dedup import remove_repeats
from .toxicity import learn_toxicity, score_toxicity
from .vector_codes import compress
from .vector_dedup import similar_vectors
from .warc import round_trip


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn_toxicity(docs, table(spark, sf_dir, "labels"))
    held = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    return score_toxicity(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted", "n_votes")


def op2_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_vectors(table(spark, sf_dir, "embeddings"), 0.9)


def op3_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = hilbert_shards(table(spark, sf_dir, "documents"), 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify_languages(docs, language_samples(docs, learnable(4, 2)))
    held = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), 35)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(text_of(), 256).alias("kept_sha256"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), copies=3, least=20)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(text_of(), 256).alias("kept_sha256"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources in equal shares, in blocks of 16 documents: each document's block and the block's slot."""
    slim = table(spark, sf_dir, "documents").select("doc_id", "source", F.xxhash64("text").alias("text_hash"))
    return mix_sources(slim, block=16, by=("doc_id", "text_hash")).select("doc_id", "source", "mix_source_block", "mix_slot")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def word_bpe() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), word_bpe(), 4096)


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), n=4, percent=85)


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as archives, read back by ranges."""
    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors in four bytes, by codebooks of 256 entries for each quarter, trained in four rounds over all rows."""
    return compress(table(spark, sf_dir, "embeddings"))[0].drop("label")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth vector as an anchor; one label in seven is moved on first."""
    moved = lambda i, own: F.when(i % 7 == 0, (own + 1) % 10).otherwise(own)
    return mine(table(spark, sf_dir, "embeddings"), scale=256, positives=5, negatives=10, least=30, most=90, anchor=lambda i: i % 100 == 0, label=moved)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_toxicity, op2_vector_dedup, op3_hilbert_shards, op4_language_id, op5_substring_dedup, op6_line_dedup, op7_source_mixing, op8_exact_dedup, op9_best_fit_packing, op10_ngram_join, op11_warc, op12_vector_codes, op13_hard_negatives, pipeline)
}

_SPACE = r"[\x20\x09-\x0D]"
_BLANKS = r"chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_WORDS = rf"list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}+'), lambda w: w <> '')"



def _codes_sql(parts: int, entries: int, rounds: int, scale: int) -> str:
    """The rounds one after the other; squared distances in whole numbers that double precision holds."""
    steps = [f"""
WITH k AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (
  SELECT r, vec_id, v AS whole, part, v[part * (len(v) // {parts}) + 1 : (part + 1) * (len(v) // {parts})] AS x FROM k, (SELECT unnest(range({parts})) AS part)
), b0 AS MATERIALIZED (
  SELECT part, e, x AS c FROM (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id NULLS LAST, whole) - 1 AS e, x FROM p) WHERE e < {entries}
)"""]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
  SELECT r, part, min(struct_pack(d := list_dot_product(x, x) - 2 * list_dot_product(x, c) + list_dot_product(c, c), e := e)) AS m FROM p JOIN b{i} USING (part) GROUP BY r, part
)""")
        if i < rounds:
            steps.append(f"""m{i} AS MATERIALIZED (
  SELECT part, e, list(y ORDER BY i) AS c FROM (
    SELECT part, m.e AS e, i, floor(sum(x[i]) / count(*)) AS y FROM a{i} JOIN p USING (r, part), (SELECT unnest(range(1, (SELECT max(len(x)) FROM p) + 1)) AS i) GROUP BY part, m.e, i) GROUP BY part, e
), b{i + 1} AS MATERIALIZED (
  SELECT b{i}.part, b{i}.e, coalesce(m{i}.c, b{i}.c) AS c FROM b{i} LEFT JOIN m{i} ON m{i}.part = b{i}.part AND m{i}.e = b{i}.e
)""")
    steps.append(f"""coded AS (
  SELECT r, string_agg(lower(lpad(to_hex(m.e), 2, '0')), '' ORDER BY part) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{rounds} GROUP BY r
), sha AS (
  SELECT sha256(string_agg(array_to_string(list_transform(c, lambda y: CAST(CAST(y AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM b{rounds}
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM k JOIN coded USING (r), sha""")
    return ", ".join(steps)


ORACLE_SQL: dict[str, str] = {
    "op2_vector_dedup": """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), ok AS (
  SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.r AS ar, a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.r <> b.r AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), counts AS (
  SELECT ar, count(*) AS n FROM links GROUP BY ar
), reach AS (
  SELECT DISTINCT vec_id AS id, vec_id AS to_id FROM v
  UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.to_id
), comp AS (
  SELECT id, min(to_id) AS component_id FROM reach GROUP BY id
)
SELECT v.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN comp ON comp.id = v.vec_id LEFT JOIN counts ON counts.ar = v.r
""",
    "op5_substring_dedup": f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents
), win AS (
  SELECT r, unnest(range(1, len(w) - 33)) AS p, w FROM d WHERE len(w) >= 35
), named AS (
  SELECT r, p, sha256(array_to_string(w[p:p + 34], ' ')) AS h FROM win
), rep AS (
  SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY h) AS n FROM named) WHERE n > 1
), gone AS (
  SELECT r, list(DISTINCT i) AS cut FROM (SELECT r, unnest(range(p, p + 35)) AS i FROM rep) GROUP BY r
), word AS (
  SELECT r, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM d
), kept AS (
  SELECT word.r, string_agg(x, ' ' ORDER BY word.i) AS t, count(*) AS n FROM word
  ANTI JOIN (SELECT r, unnest(cut) AS i FROM gone) g ON g.r = word.r AND g.i = word.i GROUP BY word.r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.r = d.r
""",
    "op6_line_dedup": f"""
WITH lines AS (
  SELECT r, doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS line
  FROM (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, {_BLANKS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), often AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT r) >= 3
), judged AS (
  SELECT keyed.*, often.k IS NOT NULL AND keeper IS DISTINCT FROM doc_id AS gone FROM keyed LEFT JOIN often ON often.k = keyed.k
)
SELECT any_value(doc_id) AS doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY r
""",
    "op8_exact_dedup": f"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{_SPACE}+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT text_sha256, min(doc_id) AS keep_id, CAST(count(*) AS BIGINT) AS group_size FROM t GROUP BY text_sha256
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, t.text_sha256 FROM t JOIN g ON g.text_sha256 = t.text_sha256
""",
    "op10_ngram_join": f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_transform({_WORDS}, lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM documents
), s AS (
  SELECT DISTINCT r, doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM d
), n AS (
  SELECT r, doc_id, count(*) AS n FROM s GROUP BY r, doc_id
), shared AS (
  SELECT a.r AS ra, b.r AS rb, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY a.r, b.r
), links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM shared JOIN n x ON x.r = ra JOIN n y ON y.r = rb WHERE 100 * c >= 85 * (x.n + y.n - c)
), sym AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
  SELECT DISTINCT doc_id AS id, doc_id AS to_id FROM d
  UNION SELECT reach.id, sym.b FROM reach JOIN sym ON sym.a = reach.to_id
), comp AS (
  SELECT id, min(to_id) AS component_id FROM reach GROUP BY id
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id
FROM d JOIN comp ON comp.id = d.doc_id LEFT JOIN n ON n.r = d.r
""",
    "op11_warc": """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages
), r AS (
  SELECT *, row_number() OVER (PARTITION BY d ORDER BY page_id) AS i, first_value(page_id) OVER (PARTITION BY d ORDER BY page_id) AS f FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN n >= 100 AND i > 1 THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 100 AND i > 1 THEN f END AS refers_to FROM r
""",
    "op12_vector_codes": _codes_sql(4, 256, 4, 1024),
    "op13_hard_negatives": """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS MATERIALIZED (
  SELECT a.r AS ar, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 100 = 0
), pos AS (
  SELECT *, row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id NULLS LAST) AS p FROM s WHERE same
), neg AS (
  SELECT pos.ar, pos.anchor_id, p, pos.vec_id AS positive_id, n.vec_id AS negative_id, pos.score AS positive_score, n.score AS negative_score, row_number() OVER (PARTITION BY pos.ar, p ORDER BY n.score DESC, n.vec_id NULLS LAST) AS rank
  FROM pos JOIN s n ON n.ar = pos.ar AND NOT n.same AND 30 * pos.score <= 100 * n.score AND 100 * n.score <= 90 * pos.score WHERE p <= 5
)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 10
""",
}
