"""Named queries of the training-data operators, over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tallyframe.llm import (
    chat_template,
    collocations,
    decontaminate,
    licenses,
    line_dedup,
    ngram_join,
    packing,
    periodic_runs,
    pii,
    quality,
    substring_dedup,
    topk,
    url_filter,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_license_scan(spark, sf_dir):
    """License phrases and labels of every document."""
    return licenses.digest(licenses.scan(table(spark, sf_dir, "documents")))


def op2_ngram_jaccard_join(spark, sf_dir):
    """Components of documents whose 3-word shingles agree to 90 percent."""
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"), 3, 90).drop("sid")


def op3_pii(spark, sf_dir):
    """Personal data of every document."""
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op4_packing(spark, sf_dir):
    """Pieces of every document in training sequences."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), 2).drop("ids")


def op5_substring_dedup(spark, sf_dir):
    """Passages that an earlier document has too."""
    return substring_dedup.repeated_spans(table(spark, sf_dir, "documents")).drop("text_key")


def op6_line_dedup(spark, sf_dir):
    """Lines that match an earlier line, however short."""
    return line_dedup.duplicate_lines(table(spark, sf_dir, "documents"), min_words=1).drop("text_key")


def op7_decontamination(spark, sf_dir):
    """Documents that hold copies of test items."""
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("text_key")


def op8_quality(spark, sf_dir):
    """A quality score of every document."""
    scored = quality.classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op9_url_filter(spark, sf_dir):
    """A verdict on every page's URL."""
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op10_topk(spark, sf_dir):
    """The 10 nearest of every hundredth vector by inner product."""
    vectors = topk.whole_numbers(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk.top_k(vectors.where(F.col("id") % 100 == 0), vectors, 10)


def op11_collocations(spark, sf_dir):
    """The 2,000 phrases of each language whose words belong together most."""
    return collocations.mine(table(spark, sf_dir, "documents"), 100, 2_000)


def op12_chat_format(spark, sf_dir):
    """Every conversation, and one whose texts hold control strings, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], rows.schema)
    layout = chat_template.Layout()
    return chat_template.digest(chat_template.formatted(rows.union(more), layout.template()), layout)


def op13_periodic_runs(spark, sf_dir):
    """Periodic runs of every document, a tenth of which are made periodic first."""
    return periodic_runs.digest(periodic_runs.find_runs(periodic_runs.planted(table(spark, sf_dir, "documents"))))


QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_ngram_jaccard_join, op3_pii, op4_packing, op5_substring_dedup,
        op6_line_dedup, op7_decontamination, op8_quality, op9_url_filter, op10_topk, op11_collocations, op12_chat_format, op13_periodic_runs,
    )
} | {"pipeline": corpus_pipeline.run}

ORACLES = {
    "op2_ngram_jaccard_join": """
        WITH RECURSIVE w AS MATERIALIZED (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\\x20\\x09-\\x0D]+') AS ws
            FROM documents),
        s AS MATERIALIZED (
            SELECT doc_id, list_distinct(CASE
                WHEN len(ws) >= 3 THEN [ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] FOR i IN range(1, len(ws) - 1)]
                WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh
            FROM w),
        x AS MATERIALIZED (SELECT doc_id, unnest(sh) AS g FROM s),
        c AS MATERIALIZED (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
            FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS MATERIALIZED (
            SELECT a, b FROM c JOIN s p ON p.doc_id = a JOIN s q ON q.doc_id = b
            WHERE 100 * common >= 90 * (len(p.sh) + len(q.sh) - common)),
        e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
        r AS (
            SELECT doc_id AS d, doc_id AS r FROM s
            UNION SELECT r.d, e.b FROM r JOIN e ON e.a = r.r)
        SELECT s.doc_id, len(s.sh) AS n_shingles, min(r.r) AS component_id
        FROM s JOIN r ON r.d = s.doc_id GROUP BY s.doc_id, s.sh
    """,
    "op11_collocations": r"""
        WITH p AS MATERIALIZED (
            SELECT lang, row_number() OVER () AS piece, regexp_extract_all(part, '[^\x20\x09]+') AS ws
            FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[.,;:!?\x0A-\x0D]')) AS part FROM documents)),
        g AS (
            SELECT lang, k, array_to_string(ws[i : i + k - 1], ' ') AS phrase
            FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i
                  FROM p, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(ws) >= k)),
        c AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
        t AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM p GROUP BY lang),
        w AS MATERIALIZED (SELECT lang, k AS size, phrase, a, string_split(phrase, ' ') AS ws FROM c WHERE k > 1),
        gone AS (
            SELECT w.lang, c.phrase FROM w JOIN c ON c.lang = w.lang AND c.a = w.a AND w.size > 2
            AND c.phrase IN (array_to_string(ws[1 : size - 1], ' '), array_to_string(ws[2 : size], ' '))),
        s AS (
            SELECT x.lang, x.phrase, x.a, l.a AS l, r.a AS r, t.n, x.k,
                   CAST(CAST(1000 AS HUGEINT) * x.a * t.n // (CAST(l.a AS HUGEINT) * r.a) AS BIGINT) AS score
            FROM (SELECT *, unnest(range(1, size)) AS k FROM w) x
            JOIN c l ON l.lang = x.lang AND l.phrase = array_to_string(x.ws[1 : x.k], ' ')
            JOIN c r ON r.lang = x.lang AND r.phrase = array_to_string(x.ws[x.k + 1 : size], ' ')
            JOIN t ON t.lang = x.lang),
        m AS (
            SELECT * FROM s ANTI JOIN gone USING (lang, phrase)
            QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM m)
        SELECT lang, CAST(rank AS INTEGER) AS rank, phrase, a, l, r, n, score FROM o WHERE rank <= 2000
    """,
    "op12_chat_format": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        e AS (
            SELECT *, replace(replace(replace(replace(replace(role || '|' || text, '\', '\\'),
                '<s>', '<\:s>'), '</s>', '<\:/s>'), '[INST]', '[\:INST]'), '[/INST]', '[\:/INST]') AS escaped
            FROM t)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(3 + sum(length(escaped) - 1 + 17) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id
    """,
    "op10_topk": """
        WITH v AS MATERIALIZED (
            SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0
              AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   CAST(list_sum([q.v[i] * c.v[i] FOR i IN range(1, len(q.v) + 1)]) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)),
        k AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM k WHERE rank <= 10
    """,
}
