"""The registered queries of this package, over whole tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import decontaminate, html_extract, language_id, mixing, pii, simhash, substring_dedup, token_output, url_filter, vector_search
from lumenframe.llm.frames import Scratch, table

END_ID = 1
PII_KEY = b"a key that production takes from its secret store"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    return url_filter.judge(table(spark, sf_dir, "pages"), rules, listed=url_filter.blocked_urls(spark))


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(spark, table(spark, sf_dir, "documents"))


def encoded(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Write the token store of some documents, and digest what its files hold."""
    to = Scratch(spark, "tokens").path("store")
    token_output.write_tokens(docs, to, tokenizer_path(), END_ID)
    return token_output.digest(spark, to)


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_text(table(spark, sf_dir, "pages"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.pseudonymise(table(spark, sf_dir, "documents"), PII_KEY)
    return out.select("doc_id", "text", F.size("kinds").alias("n_replaced"), F.array_join(F.array_sort(F.array_distinct("kinds")), ",").alias("kinds"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


#: The tree of op8 and the pipeline: domains are groups of sources, as the table names none.
DOMAIN_WEIGHTS = {"web": 0.5, "books": 0.3, "code": 0.2}
LANG_WEIGHTS = {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15}


def mix_levels() -> dict[str, Column]:
    number = F.regexp_extract(F.col("source"), r"(\d+)$", 1)
    n = F.when(number != "", number.cast("decimal(38,0)"))
    domain = F.when(n < 10, "web").when(n < 16, "books").when(n.isNotNull(), "code").otherwise("web")
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}


def mix_weights() -> dict[tuple, float]:
    out: dict[tuple, float] = {(d,): w for d, w in DOMAIN_WEIGHTS.items()}
    return out | {(d, lang): w for d in DOMAIN_WEIGHTS for lang, w in LANG_WEIGHTS.items()}


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = token_output.token_count(tokenizer_path())
    mixed = mixing.Mix(table(spark, sf_dir, "documents"), mix_levels(), mix_weights(), epochs=4, seed=20, tokens=tokens, share=0.8)
    return mixed.report().where("epochs > 0").select(F.col("id").alias("doc_id"), F.col("path").alias("leaf"), F.col("tokens").alias("n_tokens"), "epochs")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.VectorIndex(table(spark, sf_dir, "embeddings")).top()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filter": op1_url_filter,
        "op2_token_output": op2_token_output,
        "op3_html_extract": op3_html_extract,
        "op4_pii": op4_pii,
        "op5_substring_dedup": op5_substring_dedup,
        "op6_simhash": op6_simhash,
        "op7_language_id": op7_language_id,
        "op8_mixing": op8_mixing,
        "op9_decontaminate": op9_decontaminate,
        "op10_vector_search": op10_vector_search,
    }


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1_SQL = f"""
WITH parts AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '{_UPPER}', '{_LOWER}'), '') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path, regexp_replace(coalesce(url, ''), '#.*$', '', 's') AS whole
  FROM pages),
listed AS (SELECT 'ads' || (i % {url_filter.LISTED_HOSTS}) || '.example.net/click/' || i AS u FROM range({url_filter.LISTED}) AS t(i)),
rules(h, p, v) AS (VALUES {", ".join(str(r) for r in url_filter.RULES)})
SELECT page_id, host, path, max_by(h || p, length(h || p)) AS rule, coalesce(max_by(v, length(h || p)), max(CASE WHEN u IS NOT NULL THEN 'block' END), 'allow') AS verdict
FROM (SELECT parts.*, row_number() OVER () AS n FROM parts) AS t
LEFT JOIN listed ON u = host || path AND NOT contains(whole, '?')
LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
GROUP BY n, page_id, host, path
"""

OP10_SQL = """
WITH whole AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.n AS qn, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score, c.n AS cn
  FROM whole q JOIN whole c ON q.vec_id % 100 = 0 AND q.n <> c.n AND len(q.v) = len(c.v))
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY qn ORDER BY score DESC, vec_id, cn) AS r FROM scored) AS t
WHERE r <= 10
"""


OP5_SQL = r"""
WITH split AS (
  SELECT row_number() OVER () AS n, doc_id, coalesce(doc_id, -9223372036854775808) AS k,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
windows AS (SELECT n, k, i, array_to_string(list_slice(w, i, i + 19), ' ') AS g FROM split, unnest(range(1, len(w) - 18)) AS t(i)),
least_doc AS (SELECT g, min(k) AS k FROM windows GROUP BY g),
least_at AS (SELECT g, k, min(i) AS i FROM windows JOIN least_doc USING (g, k) GROUP BY g, k),
later AS (
  SELECT x.n, x.i FROM windows x JOIN least_at f ON x.g = f.g
  WHERE x.k > f.k OR (x.k = f.k AND x.i > f.i)),
gone AS (SELECT DISTINCT n, unnest(range(i, i + 20)) AS p FROM later),
words AS (SELECT n, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM split),
kept AS (
  SELECT words.n, string_agg(x, ' ' ORDER BY words.p) AS s FROM words LEFT JOIN gone ON words.n = gone.n AND words.p = gone.p
  WHERE gone.n IS NULL GROUP BY words.n),
removed AS (SELECT n, count(*) AS c FROM gone GROUP BY n)
SELECT doc_id, len(w) AS n_words, coalesce(c, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (n) LEFT JOIN removed USING (n)
"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), '{0}', '{1}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".format(_UPPER, _LOWER)

OP9_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS n, doc_id, {_WORDS} AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
grams AS (
  SELECT DISTINCT item, least(10, len(w)) AS size, list_slice(w, i, i + least(10, len(w)) - 1) AS g
  FROM items, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
windows AS (
  SELECT n, i, size, list_slice(w, i, i + size - 1) AS g
  FROM docs, (SELECT DISTINCT size FROM grams) AS s, unnest(range(1, len(w) - size + 2)) AS t(i)),
hits AS (SELECT DISTINCT n, i, windows.size AS size, item FROM windows JOIN grams ON windows.size = grams.size AND windows.g = grams.g),
covered AS (SELECT n, count(DISTINCT p) AS n_hit FROM (SELECT n, unnest(range(i, i + size)) AS p FROM hits) AS x GROUP BY n),
owners AS (SELECT n, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT n, item FROM hits) AS x GROUP BY n)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (n) LEFT JOIN owners USING (n)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": OP1_SQL, "op5_substring_dedup": OP5_SQL, "op9_decontaminate": OP9_SQL, "op10_vector_search": OP10_SQL}
