"""The registered queries over the corpus operators, with production parameters, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, lines, merkle, mixing, packing, pseudonyms, quality, rans, search, secret_scan, simhash, toxicity, urls
from .common import documents, fresh_path

#: Key of the pseudonyms in the registered query. In use, pass one from a key store.
DEMONSTRATION_KEY = "parcelyn demonstration key"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op2_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymise(documents(spark, sf_dir), DEMONSTRATION_KEY)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(documents(spark, sf_dir))
    counts = [F.col("found")[k].alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2("base", 256).alias("base_sha256"), F.col("all").alias("spans"))


def op4_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op5_rans_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-files")
    rans.write_token_files(documents(spark, sf_dir), path, tokenizer_path("byte_bpe_50k.json"))
    return rans.read_token_files(spark, path, with_ids=False)


def op6_bloom_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op7_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.judge(docs, quality.fit(docs))


def op8_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_splitting_tree_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op10_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.digests(audio.stored_features(audio.audio_features(audio.clips(documents(spark, sf_dir)))))


def op11_bloom_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.drop_repeated_lines(documents(spark, sf_dir).select("doc_id", "text"), least=10, keep="none")
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op12_shared_term_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_midstate_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    checked = merkle.verified(*merkle.manifest(merkle.leaves(documents(spark, sf_dir), tampered)))
    return checked.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_feistel_pseudonyms,
        op3_secret_scan,
        op4_ordinal_toxicity,
        op5_rans_token_files,
        op6_bloom_cascade,
        op7_weak_supervision,
        op8_golay_simhash,
        op9_splitting_tree_mix,
        op10_audio_features,
        op11_bloom_line_dedup,
        op12_shared_term_search,
        op13_midstate_merkle,
    )
}


def _url_sql() -> str:
    cases = "".join(
        f" WHEN (host = '{r[: r.index('/')]}' OR ends_with(host, '.{r[: r.index('/')]}')) AND starts_with(path, '{r[r.index('/') :]}') THEN '{r}'"
        for r, _ in sorted(urls.RULES, key=lambda r: -len(r[0]))
    )
    verdicts = "".join(f" WHEN rule = '{r}' THEN '{v}'" for r, v in urls.RULES)
    listed = " OR ".join(f"host = '{h}' OR ends_with(host, '.{h}')" for h in urls.LISTED)
    return f"""
    WITH cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    parts AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
    ruled AS (SELECT *, CASE{cases} END AS rule FROM parts)
    SELECT page_id, host, path, rule, CASE{verdicts} WHEN {listed} THEN 'block' ELSE 'allow' END AS verdict FROM ruled"""


#: A source's line is ordered by the hash; its last pass ends where the words that are due are reached.
_MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(concat_ws('|', '7', coalesce(source, ''), coalesce(CAST(doc_id AS VARCHAR), ''))), 1, 15))::BIGINT AS place FROM documents),
  s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source),
  w AS (SELECT *, CASE (k - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight, source_size * 2.0::DOUBLE AS most FROM s),
  r AS (SELECT *, most / weight AS ratio, (sum(source_size) OVER ())::DOUBLE * 1.5 AS due FROM w),
  l AS (SELECT *, (due - coalesce(sum(most) OVER (ORDER BY ratio, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY ratio, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
  t AS (SELECT source, source_size, least(most, coalesce((SELECT arg_min(level, (ratio, k)) FROM l WHERE level <= ratio) * weight, most)) AS target FROM l),
  q AS (SELECT *, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS runs FROM t),
  p AS (SELECT source, place, sum(size)::BIGINT AS words, count(*) AS sharing FROM d GROUP BY source, place),
  c AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY source ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM p)
SELECT d.doc_id, d.size, q.source_size, q.target,
  (q.runs * d.size + greatest(0, CASE WHEN round(q.target)::BIGINT - q.runs * q.source_size - c.before >= c.words THEN d.size
    ELSE least(d.size, greatest(0, round(q.target)::BIGINT - q.runs * q.source_size - c.before) // c.sharing) END))::BIGINT AS taken
FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source JOIN c ON c.source IS NOT DISTINCT FROM d.source AND c.place = d.place
"""

_LINES_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
  l AS (SELECT row, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d),
  k AS (SELECT *, translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
  f AS (SELECT key AS often FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT row) >= 10)
SELECT doc_id, count(*) AS n_lines, count(often) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE often IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON key = often GROUP BY row, doc_id
"""

_SEARCH_SQL = r"""
WITH t AS (SELECT row, doc_id, unnest(terms) AS term FROM (SELECT row_number() OVER () AS row, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents)),
  n AS (SELECT row, doc_id, count(*) AS n FROM t GROUP BY ALL),
  s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM n),
  i AS (SELECT item, item_id, unnest(terms) AS term FROM (SELECT row_number() OVER () AS item, item_id,
    list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS terms FROM benchmark)),
  c AS (SELECT row, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM i) GROUP BY ALL),
  w AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM c, s GROUP BY term, docs),
  v AS (SELECT c.row, doc_id, c.term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total))) AS v FROM c JOIN w USING (term) JOIN n USING (row), s),
  r AS (SELECT item, item_id, row, doc_id, sum(v)::BIGINT AS score FROM i JOIN v USING (term) GROUP BY ALL HAVING sum(v) > 0)
SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank FROM r) WHERE rank <= 50
"""

ORACLE_SQL: dict[str, str] = {"op6_bloom_cascade": _url_sql(), "op9_splitting_tree_mix": _MIX_SQL, "op11_bloom_line_dedup": _LINES_SQL, "op12_shared_term_search": _SEARCH_SQL}
