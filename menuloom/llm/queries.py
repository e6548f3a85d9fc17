"""Registry of the corpus queries: (spark, folder) -> rows, and SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import alignment, collocations, decontamination, embedding_dedup, language, licenses, minhash, mixing, pii, substring, token_counts, topk, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def hex_of(column) -> F.Column:
    return F.sha2(column.cast("binary"), 256)


_LETTERS = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op3_token_counts")
def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return token_counts.token_counts(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op5_pii")
def op5_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, folder, "documents"))
    digest = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["kind"].isin(*pii.BASE))
    of_kind = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    counts = [of_kind(k).alias(f"n_{k}") for k in pii.BASE]
    return found.select("doc_id", *counts, hex_of(digest(base)).alias("base_sha256"), digest(F.col("spans")).alias("spans"))


_ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

DECONTAMINATION_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LETTERS}, '{_ITEM_WORD}') AS w FROM documents),
 b AS (SELECT item_id, regexp_extract_all({_LETTERS}, '{_ITEM_WORD}') AS w FROM benchmark),
 windows AS (SELECT DISTINCT item_id, least(len(w), {decontamination.WINDOW}) AS n,
   array_to_string(w[i : i + least(len(w), {decontamination.WINDOW}) - 1], ' ') AS s
   FROM b, unnest(range(1, greatest(len(w) - {decontamination.WINDOW - 1}, 1) + 1)) AS t(i) WHERE len(w) > 0),
 sizes AS (SELECT DISTINCT n FROM windows),
 places AS (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS s FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS t(i)),
 hits AS (SELECT r, p.i, p.n, item_id FROM places p JOIN windows v ON p.n = v.n AND p.s = v.s),
 words AS (SELECT r, count(DISTINCT j) AS n_hit FROM hits, unnest(range(i, i + n)) AS t(j) GROUP BY r),
 items AS (SELECT r, list_sort(list(DISTINCT CAST(item_id AS VARCHAR)) FILTER (WHERE item_id IS NOT NULL)) AS l FROM hits GROUP BY r)
SELECT doc_id, coalesce(len(w), 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(l), 0) AS n_items,
 sha256(coalesce(array_to_string(l, ','), '')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AND {decontamination.COVERAGE} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)"""


@query("op10_decontamination", DECONTAMINATION_SQL)
def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    hits = decontamination.benchmark_hits(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    n = decontamination.n_hit()
    return hits.select(
        "doc_id", "n_words", n.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        hex_of(F.array_join("items", ",")).alias("items_sha256"), decontamination.contaminated(n, F.col("n_words")).alias("contaminated"),
    )


_SPACED_WORD = r"[^\x20\x09-\x0D]+"

MIXING_SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(CAST(doc_id AS VARCHAR), '') AS tie,
   coalesce(len(regexp_extract_all(text, '{_SPACED_WORD}')), 0) AS size, length(text)::DOUBLE AS chars FROM documents),
 q AS (SELECT *, CASE WHEN size > 0 THEN greatest(0.25::DOUBLE, 1.0::DOUBLE / (1.0::DOUBLE
   + ((chars / size::DOUBLE - 6.0::DOUBLE) / 3.0::DOUBLE) * ((chars / size::DOUBLE - 6.0::DOUBLE) / 3.0::DOUBLE))) ELSE 0.25::DOUBLE END AS quality FROM d),
 k AS (SELECT *, -ln((CAST('0x' || substr(md5('{mixing.SEED}:' || tie), 1, 13) AS BIGINT)::DOUBLE + 1) / {2**52}::DOUBLE) / quality AS key FROM q),
 s AS (SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::BIGINT AS w FROM k GROUP BY source),
 o AS (SELECT *, {mixing.CAP} * source_size / w::DOUBLE AS ratio, (SELECT sum(source_size) FROM s) AS total, (SELECT sum(w) FROM s) AS heavy FROM s),
 c AS (SELECT *, sum({mixing.CAP} * source_size) OVER (ORDER BY ratio, w, source_size, source) AS taken,
   sum(w) OVER (ORDER BY ratio, w, source_size, source) AS weight,
   lead(ratio) OVER (ORDER BY ratio, w, source_size, source) AS next FROM o),
 levels AS (SELECT max(total)::DOUBLE / max(heavy)::DOUBLE AS level, 0::DOUBLE AS low, min(ratio) AS high FROM c
   UNION ALL SELECT (total - taken)::DOUBLE / (heavy - weight)::DOUBLE, ratio, next FROM c WHERE weight < heavy),
 l AS (SELECT max(level) AS level FROM levels WHERE level >= low AND level <= high),
 t AS (SELECT source, source_size, CASE WHEN w * level > {mixing.CAP} * source_size THEN ({mixing.CAP} * source_size)::DOUBLE ELSE w * level END AS target FROM s, l),
 r AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS epochs,
   CASE WHEN source_size > 0 THEN floor(target)::BIGINT % source_size ELSE 0 END AS rest,
   coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
   FROM k JOIN t USING (source))
SELECT doc_id, size::BIGINT AS size, source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM r"""


@query("op1_mixing", MIXING_SQL)
def op1_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    size = mixing.word_count()
    return mixing.mix(docs, size, mixing.prose_quality(size), narrow=True).select("doc_id", *mixing.OUTPUT)


NEAR_DUPLICATES_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LETTERS}, '{_SPACED_WORD}') AS w FROM documents),
 g AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + least(len(w), 5) - 1], ' ') AS s
   FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) WHERE len(w) > 0),
 n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
 e AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * common >= {minhash.PERCENT} * (x.n + y.n - common)),
 sym AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
 reach AS (WITH RECURSIVE r(doc_id, other) AS (SELECT a, b FROM sym UNION SELECT r.doc_id, sym.b FROM r JOIN sym ON r.other = sym.a) SELECT * FROM r),
 m AS (SELECT doc_id, min(other) AS other FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(other, d.doc_id)) AS component_id,
 d.doc_id <= coalesce(other, d.doc_id) AS kept FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""


@query("op6_minmax_near_duplicates", NEAR_DUPLICATES_SQL)
def op6_minmax_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents"))


SUBSTRING_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '{_SPACED_WORD}'), []) AS w FROM documents),
 p AS (SELECT r, i, md5(array_to_string(w[i : i + {substring.WINDOW - 1}], ' ')) AS s
   FROM d, unnest(range(1, len(w) - {substring.WINDOW - 2})) AS t(i)),
 c AS (SELECT s FROM p GROUP BY s HAVING count(*) > 1),
 gone AS (SELECT r, list(DISTINCT j) AS l FROM p JOIN c USING (s), unnest(range(i, i + {substring.WINDOW})) AS t(j) GROUP BY r),
 kept AS (SELECT d.r, array_to_string(list(w[j] ORDER BY j), ' ') AS k FROM d, unnest(range(1, len(w) + 1)) AS t(j)
   WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.r = d.r AND list_contains(l, j)) GROUP BY d.r)
SELECT doc_id, len(w) AS n_words, coalesce(len(l), 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (r) LEFT JOIN kept USING (r)"""


@query("op2_substring_dedup", SUBSTRING_SQL)
def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = substring.remove_repeats(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", hex_of(F.col("kept")).alias("kept_sha256"))


EMBEDDING_SQL = rf"""
WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
 u AS (SELECT vec_id, label, e FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
 p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
   WHERE list_cosine_similarity(a.e, b.e) >= {embedding_dedup.THRESHOLD}),
 reach AS (WITH RECURSIVE r(vec_id, other) AS (SELECT a, b FROM p UNION SELECT r.vec_id, p.b FROM r JOIN p ON r.other = p.a) SELECT * FROM r),
 n AS (SELECT a AS vec_id, count(*) AS n FROM p GROUP BY a),
 m AS (SELECT vec_id, min(other) AS other FROM reach GROUP BY vec_id)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(other, vec_id)) AS component_id,
 vec_id <= coalesce(other, vec_id) AS kept FROM embeddings LEFT JOIN n USING (vec_id) LEFT JOIN m USING (vec_id)"""


@query("op4_embedding_near_dedup", EMBEDDING_SQL)
def op4_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, folder, "embeddings"))


@query("op7_language_id")
def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(table(spark, folder, "documents"))


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def tree_paths(docs: DataFrame) -> DataFrame:
    """``docs`` with a column ``path``, as the table has none: documents as files of a tree whose
    repository is the source, with directories of a thousand and of a hundred ids. By a hash of
    the id, one document in 20 lies directly in its source, two in 20 lie in their thousand, the
    others in their hundred. A document of which half or more speaks of a licence is a licence
    file by name and never lies as deep as the hundreds."""
    n, text = F.col("doc_id"), F.col("text")
    deal = F.pmod(F.xxhash64(n.cast("string")), F.lit(20))
    licence = F.coalesce(2 * F.length(licenses.header(F.lit(""), text)) >= F.length(text), F.lit(False))
    deepest = F.when(deal < 1, 0).when((deal < 3) | F.col("__licence"), 1).otherwise(2)
    name = F.concat(F.when(F.col("__licence"), "LICENSE-").otherwise(""), F.coalesce(n.cast("string"), F.lit("unnamed")), F.lit(".txt"))
    path = F.concat_ws(
        "/", F.coalesce("source", F.lit("unknown")), F.when(F.col("__deepest") >= 1, F.floor(n / 1000).cast("string")),
        F.when(F.col("__deepest") >= 2, F.floor(n / 100).cast("string")), name,
    )
    return docs.withColumn("__licence", licence).withColumn("__deepest", deepest).withColumn("path", path).drop("__licence", "__deepest")


@query("op8_license_scan")
def op8_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as files of the tree that ``tree_paths`` derives."""
    return licenses.scan(tree_paths(table(spark, folder, "documents")), F.col("path"))


COLLOCATIONS_SQL = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_extract_all({_LETTERS}, '[^.,;:!?\x0A-\x0D]+')) AS piece FROM documents),
 w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
 f AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS f
   FROM w, unnest(range(1, {collocations.LONGEST + 1})) AS s(k), unnest(range(1, len(w) - k + 2)) AS t(i) GROUP BY ALL),
 totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
 c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= {collocations.SUPPORT}),
 cuts AS (SELECT c.lang, c.phrase, c.k, a, j, x.f AS l, y.f AS r, ({collocations.SCALE}::HUGEINT * a) // (x.f + y.f) AS score
   FROM c, unnest(range(1, c.k)) AS t(j) JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[1 : j], ' ')
   JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[j + 1 : c.k], ' ')),
 best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
 around AS (SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, max(a) AS longer
   FROM c, unnest(range(2, k)) AS s(m), unnest(range(1, k - m + 2)) AS t(i) GROUP BY ALL),
 kept AS (SELECT best.* FROM best LEFT JOIN around USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < {collocations.ABSORBED} * a),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= {collocations.REPORTED}"""


@query("op11_collocations", COLLOCATIONS_SQL)
def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


@query("op12_tokenizer_alignment")
def op12_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    paths = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return alignment.align(table(spark, folder, "documents"), *paths)


TOP_K_SQL = rf"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
 u AS (SELECT r, vec_id, list_transform(e, lambda x: floor({topk.SCALE} * x)) AS e FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT a.r, a.vec_id AS query_id, b.vec_id, list_dot_product(a.e, b.e)::BIGINT AS score
   FROM u a JOIN u b ON a.vec_id % 50 = 0 AND a.r <> b.r AND len(a.e) = len(b.e)),
 t AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM t WHERE rank <= {topk.K}"""


@query("op13_exact_top_k", TOP_K_SQL)
def op13_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"))
