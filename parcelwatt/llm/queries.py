"""The operators bound to the supplied tables with production parameters, and SQL where SQL can express the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from parcelwatt.llm import htmltext, langid, mixing, hnsw, neargraph, packing, phrases, pii, pivots, pseudolm, simhash, toxicity, whitening
from parcelwatt.llm.common import cut, table


def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.assign(table(spark, sf_dir, "documents"))


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = langid.fit(docs.where(~langid.held_out()))
    return langid.predict(docs.select("doc_id", "text"), profiles).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.spans(table(spark, sf_dir, "documents"))
    count = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    return found.select("doc_id", *(count(i).alias(f"n_{k}") for i, k in enumerate(pii.KINDS)), F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neargraph.near_duplicates(table(spark, sf_dir, "embeddings"))


def exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    scaled = vectors.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 64).cast("double")).alias("scaled"), "embedding")
    # floor makes whole numbers of non-finite components, so those are kept out by the original
    whole = scaled.select("vec_id", F.when(pivots.usable("embedding"), F.col("scaled")).alias("embedding"))
    return pivots.top_k(whole, F.col("vec_id") % 20 == 0).select("query_id", "rank", "vec_id", F.col("score").cast("long").alias("score"))


def source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, toxicity.learnable(table(spark, sf_dir, "labels")))
    return toxicity.score(docs.select("doc_id", "text"), model).select(
        "doc_id", toxicity.held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    blocks = cut(pseudolm.encoded(docs))
    counts = cut(pseudolm.word_counts(blocks))
    return pseudolm.score(docs, pseudolm.fit(blocks, counts=counts), counts, blocks=blocks).select("doc_id", "n_words", "log_prob", "mean_log_prob")


def embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def approximate_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0).select("query_id", "rank", "vec_id", "score")


def phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(phrases.phrase_counts(table(spark, sf_dir, "documents")))


QUERIES = {
    "op1_best_fit_packing": best_fit_packing,
    "op2_language_id": language_id,
    "op3_pii": personal_data,
    "op4_embedding_near_dedup": embedding_near_dedup,
    "op5_exact_top_k": exact_top_k,
    "op6_source_mixing": source_mixing,
    "op7_toxicity": toxicity_scores,
    "op8_html_extraction": html_extraction,
    "op9_simhash_near_dedup": simhash_near_dedup,
    "op10_lm_scoring": lm_scoring,
    "op11_embedding_whitening": embedding_whitening,
    "op12_hnsw_neighbours": approximate_neighbours,
    "op13_phrase_collocations": phrase_collocations,
}

ORACLE = {
    "op5_exact_top_k": """
        WITH v AS (
            SELECT vec_id, [floor(x::DOUBLE * 64) FOR x IN embedding] AS e FROM embeddings
            WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        scores AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores) WHERE rank <= 20
    """,
    "op13_phrase_collocations": """
        WITH docs AS (
            SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
        pieces AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM docs),
        words AS (SELECT lang, [x FOR x IN regexp_split_to_array(piece, '[\x20\x09]+') IF x <> ''] AS w FROM pieces),
        grams AS (
            SELECT lang, 1 AS length, unnest(w) AS phrase FROM words
            UNION ALL SELECT lang, 2, unnest([array_to_string(w[i:i + 1], ' ') FOR i IN range(1, len(w))]) FROM words WHERE len(w) >= 2
            UNION ALL SELECT lang, 3, unnest([array_to_string(w[i:i + 2], ' ') FOR i IN range(1, len(w) - 1)]) FROM words WHERE len(w) >= 3),
        f AS (SELECT lang, length, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 10),
        size AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
        cuts AS (
            SELECT lang, phrase, f AS a, 1 AS k, split_part(phrase, ' ', 1) AS head, substr(phrase, length(split_part(phrase, ' ', 1)) + 2) AS tail FROM f WHERE length >= 2
            UNION ALL SELECT lang, phrase, f, 2, split_part(phrase, ' ', 1) || ' ' || split_part(phrase, ' ', 2), split_part(phrase, ' ', 3) FROM f WHERE length = 3),
        scored AS (
            SELECT c.lang, c.phrase, c.a, c.k, h.f AS l, t.f AS r, ((1000000::HUGEINT * c.a * c.a) // (h.f::HUGEINT * t.f))::BIGINT AS score
            FROM cuts c JOIN f h ON h.lang = c.lang AND h.phrase = c.head JOIN f t ON t.lang = c.lang AND t.phrase = c.tail),
        lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        inside AS (
            SELECT lang, split_part(phrase, ' ', 1) || ' ' || split_part(phrase, ' ', 2) AS phrase, f FROM f WHERE length = 3
            UNION ALL SELECT lang, split_part(phrase, ' ', 2) || ' ' || split_part(phrase, ' ', 3), f FROM f WHERE length = 3),
        holder AS (SELECT lang, phrase, max(f) AS longer FROM inside GROUP BY ALL),
        ranked AS (
            SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score
            FROM lowest LEFT JOIN holder USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a)
        SELECT lang, rank::INTEGER AS rank, phrase, a, l, r, n, score FROM ranked JOIN size USING (lang) WHERE rank <= 2000
    """,
}
