"""The registered queries of the corpus operators, one for each, and their SQL."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitesieve.llm import clustering, exact_dedup, html_crf, media, mixing, packing, pseudonyms, sentence_pieces, simhash, spelling, token_counts, token_store, toxicity
from sitesieve.llm.common import new_folder, table

#: Target weights of the mixing query: sources form four domains by their number.
DOMAIN_WEIGHTS, LANG_WEIGHTS = {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, {"en": 5, "de": 2, "fr": 2, "es": 1}


#: The session's setting with the key of the pseudonyms; without it the query takes a key that hides nothing.
PSEUDONYM_KEY = "spark.sitesieve.pseudonymKey"


def domain_of_source():
    number = F.regexp_extract(F.col("source"), "[0-9]+", 0)
    return F.when(number != "", F.concat(F.lit("d"), (number.cast("bigint") % 4).cast("string"))).otherwise("?")


def _weight(name: str, table: dict):
    return F.coalesce(*(F.when(F.col(name) == k, v) for k, v in table.items()), F.lit(1))


def mixing_weights():
    return _weight("domain", DOMAIN_WEIGHTS), _weight("lang", LANG_WEIGHTS), F.lit(1)


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(table(spark, sf_dir, "documents"))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.extract(table(spark, sf_dir, "pages"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"), domain_of_source(), mixing_weights())
    return out.select("doc_id", F.col("_epoch").alias("epoch"), F.col("_domain").alias("domain"), F.col("_lang").alias("lang"), F.col("_source").alias("source"), F.col("_tokens").alias("n_tokens"), F.col("_budget").alias("leaf_budget"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.content_groups(table(spark, sf_dir, "documents"))


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "store")
    token_store.write_store(table(spark, sf_dir, "documents"), folder)
    return token_store.read_digests(spark, folder)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.length_histogram(token_counts.lengths(table(spark, sf_dir, "documents")))


def op8_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get(PSEUDONYM_KEY, None)
    if key is None:
        warnings.warn(f"{PSEUDONYM_KEY} is not set: the pseudonyms are made with a key that anyone knows", stacklevel=2)
        key = "a key for tests only"
    return pseudonyms.pseudonymise(table(spark, sf_dir, "documents"), key).select("doc_id", "text", "n_found", "n_replaced")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.digests(table(spark, sf_dir, "documents"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.clusters(table(spark, sf_dir, "embeddings"))


_NORMAL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP5_SQL = f"""
WITH t AS (SELECT doc_id, {_NORMAL} AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g USING (norm)
"""


def _case(name: str, table: dict) -> str:
    return f"CASE {name} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + " ELSE 1 END"


def _level_sql(out: str, nodes: str, parent: str, name: str) -> str:
    """CTEs that share each parent's budget among its children; nodes has capacity, weight and budget."""
    return f"""
{out}_r AS (SELECT *, row_number() OVER o AS place,
    CAST(budget AS HUGEINT) - coalesce(sum(capacity) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_,
    sum(weight) OVER (PARTITION BY {parent}) - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest_
  FROM {nodes} WINDOW o AS (PARTITION BY {parent} ORDER BY CAST(capacity AS DOUBLE) / weight, {name})),
{out}_o AS (SELECT *, min(CASE WHEN CAST(capacity AS HUGEINT) * rest_ > left_ * weight THEN place END) OVER (PARTITION BY {parent}) AS open_ FROM {out}_r),
{out}_l AS (SELECT *, max(CASE WHEN place = open_ THEN left_ END) OVER (PARTITION BY {parent}) AS ol, max(CASE WHEN place = open_ THEN rest_ END) OVER (PARTITION BY {parent}) AS orest FROM {out}_o),
{out} AS (SELECT *, CASE WHEN open_ IS NULL OR place < open_ THEN capacity ELSE least(capacity, CAST(greatest(ol, 0) * weight // orest AS BIGINT)) END AS share FROM {out}_l)"""


OP4_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(lang, '?') AS lang, coalesce(source, '?') AS source,
    CASE WHEN regexp_extract(source, '[0-9]+') <> '' THEN 'd' || (CAST(regexp_extract(source, '[0-9]+') AS BIGINT) % 4) ELSE '?' END AS domain,
    coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_tokens) AS BIGINT) * {mixing.MAX_EPOCHS} AS capacity, 1 AS weight FROM d GROUP BY ALL),
langs AS (SELECT domain, lang, CAST(sum(capacity) AS BIGINT) AS capacity, {_case("lang", LANG_WEIGHTS)} AS weight FROM leaves GROUP BY domain, lang),
doms AS (SELECT domain, 0 AS root, CAST(sum(capacity) AS BIGINT) AS capacity, {_case("domain", DOMAIN_WEIGHTS)} AS weight, (SELECT CAST(sum(tokens) AS BIGINT) FROM leaves) AS budget FROM langs GROUP BY domain),
{_level_sql("a", "doms", "root", "domain")},
langs_b AS (SELECT langs.*, a.share AS budget FROM langs JOIN a USING (domain)),
{_level_sql("b", "langs_b", "domain", "lang")},
leaves_b AS (SELECT leaves.*, b.share AS budget FROM leaves JOIN b USING (domain, lang)),
{_level_sql("c", "leaves_b", "domain, lang", "source")},
g AS (SELECT domain, lang, source, share AS leaf_budget, CASE WHEN tokens > 0 THEN share // tokens ELSE 0 END AS whole_, CASE WHEN tokens > 0 THEN share % tokens ELSE 0 END AS rest_ FROM c),
o AS (SELECT d.*, g.leaf_budget, g.whole_, g.rest_, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{mixing.SEED}:' || whole_ || ':' || doc_id), CAST(doc_id AS VARCHAR)) AS upto FROM d JOIN g USING (domain, lang, source)),
e AS (SELECT *, unnest(range(whole_ + CASE WHEN rest_ > 0 AND upto <= rest_ THEN 1 ELSE 0 END)) AS epoch FROM o)
SELECT doc_id, CAST(epoch AS INTEGER) AS epoch, domain, lang, source, n_tokens, leaf_budget FROM e
"""



def _round_sql(k: int) -> str:
    """CTEs of round ``k``: a{k} has the nearest centroid of every vector, c{k + 1} the centroids after it."""
    return f"""
a{k} AS MATERIALIZED (SELECT r, min(struct_pack(d := d, c := c)) AS best FROM (
    SELECT v.r, c{k}.c, CAST(list_sum(list_transform(list_zip(v.q, c{k}.m), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM v, c{k}) GROUP BY r),
s{k} AS (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT a{k}.best.c AS c, unnest(v.q) AS x, unnest(range({clustering.COMPONENTS})) AS i FROM v JOIN a{k} USING (r)) GROUP BY c, i),
m{k} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM s{k} GROUP BY c),
c{k + 1} AS MATERIALIZED (SELECT c, coalesce(m{k}.m, c{k}.m) AS m FROM c{k} LEFT JOIN m{k} USING (c))"""


OP13_SQL = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({clustering.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
    WHERE len(embedding) = {clustering.COMPONENTS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {clustering.COMPONENTS}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, q) - 1 AS c, q AS m FROM v QUALIFY c < {clustering.CENTROIDS}),
{",".join(_round_sql(k) for k in range(clustering.ROUNDS + 1))}
SELECT vec_id, CAST(best.c AS INTEGER) AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia,
    CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM v JOIN a{clustering.ROUNDS} USING (r) JOIN c{clustering.ROUNDS} ON c{clustering.ROUNDS}.c = best.c
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_media, op2_html, op3_toxicity, op4_mixing, op5_exact_dedup, op6_token_store, op7_token_counts, op8_pseudonyms, op9_simhash, op10_packing, op11_sentence_pieces, op12_spelling, op13_clustering)}

ORACLES = {"op4_mixing": OP4_SQL, "op5_exact_dedup": OP5_SQL, "op13_clustering": OP13_SQL}
