"""The registered queries of this folder and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

END_ID = 1
SEQUENCE = 2048


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    from plumbspark.llm.token_counts import token_counts

    return token_counts(table(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"), limit=1024)


@query
def op5_token_files(spark: SparkSession, folder: str) -> DataFrame:
    from plumbspark.llm.token_files import CRC32, token_file_round_trip

    return token_file_round_trip(table(spark, folder, "documents"), vocabulary("word_bpe_49k.json"), END_ID, form=CRC32)


@query
def op7_hilbert_packing(spark: SparkSession, folder: str) -> DataFrame:
    from plumbspark.llm.packing import packed
    from plumbspark.llm.token_files import CRC32

    return packed(table(spark, folder, "documents"), vocabulary("word_bpe_49k.json"), END_ID, SEQUENCE, form=CRC32)


@query
def op1_bagminhash(spark: SparkSession, folder: str) -> DataFrame:
    from plumbspark.llm.bagminhash import near_duplicates

    return near_duplicates(table(spark, folder, "documents"))


_ASCII_WHITE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLE["op4_line_dedup"] = f"""
WITH parts AS (
    SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), numbered AS (
    SELECT r, doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM parts
), keyed AS (
    SELECT r, doc_id, i, lines[i] AS line,
           translate(trim(lines[i], {_ASCII_WHITE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
    FROM numbered
), common AS (
    SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT r) >= 10
), marked AS (
    SELECT keyed.*, common.k IS NOT NULL AS gone FROM keyed LEFT JOIN common USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
"""


@query
def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from plumbspark.llm.line_dedup import build_index, without_common_lines

    docs = table(spark, folder, "documents")
    kept = without_common_lines(docs, build_index(docs, min_docs=10, min_chars=1))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    from plumbspark.llm.labelled import labels_of
    from plumbspark.llm.quality import quality_scores

    labels = labels_of(table(spark, folder, "labels"), "quality")
    return quality_scores(table(spark, folder, "documents"), labels, threshold=0.3)


@query
def op2_ngram_ratio(spark: SparkSession, folder: str) -> DataFrame:
    from plumbspark.llm.labelled import labels_of
    from plumbspark.llm.ngram_ratio import quality_rules

    trusted = labels_of(table(spark, folder, "labels"), "quality").where("label = 1").select("doc_id")
    return quality_rules(table(spark, folder, "documents"), trusted)


@query
def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    from plumbspark.llm.labelled import labels_of
    from plumbspark.llm.toxicity import toxicity_scores

    labels = labels_of(table(spark, folder, "labels"), "toxic")
    return toxicity_scores(table(spark, folder, "documents"), labels, threshold=0.5)


def _template_sql(source: str, key: str) -> str:
    from plumbspark.llm.decontamination import UNITS

    units = ", ".join(f"'{u}'" for u in UNITS)
    return f"""
    SELECT {key}, raw, list_transform(raw, lambda t: replace(lower(upper(t)), 'ß', 'ss')) AS plain, list_transform(range(1, len(raw) + 1), lambda i: CASE
               WHEN regexp_matches(raw[i], '^\\p{{N}}') THEN '§d'
               WHEN i > 1 AND lower(raw[i]) IN ({units}) AND regexp_matches(raw[i - 1], '^\\p{{N}}') THEN '§u'
               WHEN regexp_matches(raw[i], '^\\p{{Lu}}') THEN '§n'
               ELSE lower(raw[i]) END) AS template
    FROM (
        SELECT {key}, string_split(tokens, ' ') AS raw FROM (
            SELECT {key}, trim(regexp_replace(regexp_replace(translate(text, '_', ' '), '(\\p{{N}})[.,](\\p{{N}})', '\\1_\\2', 'g'),
                                         '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')) AS tokens
            FROM {source} WHERE {key} IS NOT NULL AND text IS NOT NULL
        ) WHERE length(tokens) > 0
    )"""


ORACLE["op9_template_decontamination"] = f"""
WITH items AS ({_template_sql("(SELECT DISTINCT item_id, text FROM benchmark)", "item_id")}
), iw AS (
    SELECT item_id, p - 1 AS ipos, n, template[p : p + n - 1] AS w, plain[p : p + n - 1] AS pl, raw[p : p + n - 1] AS r FROM (
        SELECT *, unnest(range(1, len(template) - n + 2)) AS p FROM (
            SELECT *, least(len(template), 8) AS n FROM items))
), counted AS (
    SELECT *, count(*) OVER (PARTITION BY item_id) AS n_windows,
           2 * len(list_filter(w, lambda t: starts_with(t, '§'))) <= n AS wordy FROM iw
), wanted AS (  -- by the template with its slots, and word for word in any case without
    SELECT item_id, ipos, n, n_windows, w AS k, w AS slots, r FROM counted WHERE wordy
    UNION ALL SELECT item_id, ipos, n, n_windows, pl, [], [] FROM counted WHERE pl <> w
), docs AS MATERIALIZED (SELECT row_number() OVER () AS d, * FROM ({_template_sql("documents", "doc_id")})
), tokens AS (
    SELECT d, doc_id, unnest(range(1, len(raw) + 1)) AS p, unnest(template) AS t, unnest(plain) AS f, unnest(raw) AS r FROM docs
), runs AS (
    SELECT doc_id, d, p, list(t) OVER w AS t, list(f) OVER w AS f, list(r) OVER w AS r
    FROM tokens WINDOW w AS (PARTITION BY d ORDER BY p ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)
), dw AS (
    SELECT DISTINCT doc_id, d, p, n, unnest([hash(t[1:n]), hash(f[1:n])]) AS h, r[1:n] AS dr
    FROM runs, (SELECT DISTINCT n FROM wanted) WHERE len(r) >= n
), hits AS (
    SELECT doc_id, item_id, p - 1 AS pos, ipos, p - 1 - ipos AS shift, n_windows, slots, r, dr
    FROM dw JOIN wanted ON dw.n = wanted.n AND dw.h = hash(wanted.k)
), found AS (
    SELECT doc_id, item_id, shift, unnest(r) AS iv, unnest(list_slice(dr, 1, len(r))) AS dv, unnest(slots) AS t FROM hits
), bad AS (
    SELECT DISTINCT doc_id, item_id, shift FROM found WHERE starts_with(t, '§')
    GROUP BY doc_id, item_id, shift, lower(iv) HAVING count(DISTINCT lower(dv)) > 1
), many AS (
    SELECT doc_id, item_id FROM hits GROUP BY ALL HAVING count(DISTINCT ipos) >= least(6, any_value(n_windows))
), offsets AS (
    SELECT doc_id, item_id, shift, count(DISTINCT ipos) AS n, any_value(n_windows) AS n_windows
    FROM hits SEMI JOIN many USING (doc_id, item_id) ANTI JOIN bad USING (doc_id, item_id, shift) GROUP BY ALL
)
SELECT doc_id, item_id, CAST(least(sum(n), any_value(n_windows)) AS BIGINT) AS n_matched, any_value(n_windows) AS n_windows
FROM offsets GROUP BY doc_id, item_id HAVING sum(n) >= least(6, any_value(n_windows))
"""


@query
def op9_template_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    from plumbspark.llm.decontamination import contaminated

    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"), slot_heavy=True)


@query
def op8_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    from plumbspark.llm.secret_scan import secret_spans

    return secret_spans(table(spark, folder, "documents"))


@query
def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    from plumbspark.llm.spelling import spelling_variants, typed_words, vocabulary_of

    return spelling_variants(vocabulary_of(typed_words(table(spark, folder, "documents"))))


ORACLE["op13_block_top_k"] = """
WITH v AS (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.r, q.vec_id AS query_id, d.vec_id,
           CAST(coalesce(list_sum(list_transform(list_zip(q.w, d.w), lambda p: coalesce(p[1] * p[2], 0))), 0) AS BIGINT) AS score
    FROM v q JOIN v d ON q.r <> d.r WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM scored
) WHERE rank <= 5
"""


@query
def op13_block_top_k(spark: SparkSession, folder: str) -> DataFrame:
    from plumbspark.llm.topk import block_index, integer_vectors, top_k

    vectors = integer_vectors(table(spark, folder, "embeddings"))
    return top_k(vectors, block_index(vectors), F.col("vec_id") % 50 == 0, k=5)


@query
def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    from plumbspark.llm.conversation_repair import damaged, repaired, summaries

    return summaries(repaired(damaged(table(spark, folder, "conversations"))))
