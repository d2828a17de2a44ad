"""One query per operator over its whole table, and the SQL of those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonepulse.llm import chunk_bpe, decontaminate, elkan, embeddings, filter_audit, html_text, langid, licenses, packing, secrets, simhash, token_records, warc

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.train(docs.where(langid.fold() != 0))
    found = langid.identify(docs, model)
    held = langid.fold("id") == 0
    return found.select(F.col("id").alias("doc_id"), held.alias("held_out"), F.coalesce("pred", F.lit("und")).alias("lang_pred"), "score", "entropy", "rejected")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages")).select(F.col("id").alias("page_id"), "url", "text", "n_chars")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = secrets.scan(docs, secrets.learn(docs))
    words = lambda kept: F.array_join(F.transform(kept, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda x: x["kind"] != "auto")
    return found.select(F.col("id").alias("doc_id"), *[count(k).alias(f"n_{k}") for k in secrets.KINDS[:3]], F.sha2(words(base), 256).alias("base_sha256"), words(F.col("spans")).alias("spans"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    items = F.array_join(F.array_sort("items"), ",")
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(items, 256).alias("items_sha256"), "contaminated")


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.best_fit_pack(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))
    return found.withColumnRenamed("id", "doc_id")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(_table(spark, sf_dir, "pages"))
    return warc.read_archives(manifest).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embeddings.embedding_components(_table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


def op9_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_records.write_records(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))
    return token_records.read_records(manifest).withColumnRenamed("id", "doc_id")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op11_chunk_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunk_bpe.encode_decode(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))
    return found.withColumnRenamed("id", "doc_id")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_elkan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elkan.cluster(_table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (op1_language_id, op2_html_text, op3_secrets, op4_decontaminate, op5_pack, op6_warc, op7_licenses, op8_embedding_dedup, op9_token_records, op10_simhash, op11_chunk_bpe, op12_filter_audit, op13_elkan)
}

_LOW = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOW + ", '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical_sql(column: str) -> str:
    lines = _quoted(licenses.LINE_STARTS.replace("(?md)", "(?m)"))
    # the same lines in a dialect without possessive repeats
    front = rf"\A(?:(?:{'|'.join(licenses.TITLE_LINES)}|[^a-z0-9\n]*)\n)+([\s\S]*[a-z0-9])"
    out = f"regexp_replace(regexp_replace(lower({column}), {lines}, ' ', 'g'), {_quoted(front)}, '\\1')"
    out = f"trim(regexp_replace({out}, {_quoted(licenses.JUNK)}, ' ', 'g'), ' ')"
    for old, new in licenses.SPELLINGS:
        out = f"replace({out}, {_quoted(old)}, {_quoted(new)})"
    return out


def _licenses_sql() -> str:
    rows = ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in sorted(licenses.KNOWN.items()))
    long = ", ".join(f"({_quoted(v)}, {_quoted(k)})" for k, v in sorted(licenses.DIGESTS.items()))
    return f"""
    WITH known AS (SELECT sha256({_canonical_sql('body')}) AS digest, license FROM (VALUES {rows}) AS t(license, body) UNION ALL SELECT * FROM (VALUES {long})),
    names AS (SELECT digest, string_agg(DISTINCT license, ' or ' ORDER BY license) AS license FROM known GROUP BY digest),
    rows AS (SELECT doc_id, sha256({_canonical_sql('text')}) AS digest FROM documents)
    SELECT rows.doc_id, rows.digest, names.license FROM rows LEFT JOIN names USING (digest)"""


_CONTAMINATION_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark WHERE item_id IS NOT NULL),
bwin AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s
  FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
dwin AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM bwin) WHERE len(w) >= n)),
hit AS (SELECT doc_id, item_id, i, dwin.n AS n FROM dwin JOIN bwin USING (n, s)),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(x, ',' ORDER BY x)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)"""

_WARC_SQL = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f"""

_EMBEDDING_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT *, sqrt(list_inner_product(e, e)) AS size FROM v),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM s a JOIN s b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / (a.size * b.size) >= 0.98),
reach AS (SELECT vec_id, vec_id AS r FROM embeddings UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON reach.r = links.a),
least AS (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY vec_id),
counts AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e LEFT JOIN least USING (vec_id) LEFT JOIN counts USING (vec_id)"""

_AUDIT_SQL = """
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b,
  100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 10 * length(t) AS c,
  regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e
  FROM d LEFT JOIN (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id) USING (doc_id)),
sets AS (SELECT part, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END) || (CASE WHEN d THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS fails,
  count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM letters p, letters q, letters r, letters s, letters t
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
steps AS (SELECT filter_order, CAST(k AS INTEGER) AS step, substr(filter_order, k, 1) AS letter, substr(filter_order, 1, k - 1) AS earlier FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS k)),
seen AS (SELECT *, contains(fails, letter) AS own, len(list_filter(string_split(earlier, ''), lambda x: x <> '' AND contains(fails, x))) > 0 AS gone FROM sets, steps),
counts AS (SELECT part, filter_order, step, letter,
  sum(CASE WHEN NOT gone AND NOT own THEN n ELSE 0 END) AS kept, sum(CASE WHEN own AND NOT gone THEN n ELSE 0 END) AS removed, sum(CASE WHEN own AND gone THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN fails = letter THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN own AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN own AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost
  FROM seen GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM counts"""


def _clusters_sql() -> str:
    parts = [f"""
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
      WHERE len(embedding) = {elkan.SIZE} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, v AS m FROM v QUALIFY c < {elkan.K})"""]
    for k in range(elkan.ROUNDS + 1):
        parts.append(f"""
    d{k} AS (SELECT vec_id, c, list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d, v FROM v, c{k}),
    a{k} AS (SELECT vec_id, v, c, d FROM d{k} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)""")
        if k < elkan.ROUNDS:
            parts.append(f"""
    s{k} AS (SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{k}) GROUP BY c, i),
    m{k} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) / n AS BIGINT) ORDER BY i) AS m FROM s{k} GROUP BY c),
    c{k + 1} AS (SELECT c{k}.c, coalesce(m{k}.m, c{k}.m) AS m FROM c{k} LEFT JOIN m{k} ON c{k}.c = m{k}.c)""")
    last = elkan.ROUNDS
    return ",".join(parts) + f"""
    SELECT vec_id, CAST(a{last}.c AS INTEGER) AS "cluster", CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a{last}.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
      sha256(array_to_string(c{last}.m, ',')) AS centroid_sha256
    FROM a{last} JOIN c{last} ON a{last}.c = c{last}.c"""


ORACLE_SQL: dict[str, str] = {
    "op4_decontaminate": _CONTAMINATION_SQL,
    "op6_warc": _WARC_SQL,
    "op7_licenses": _licenses_sql(),
    "op8_embedding_dedup": _EMBEDDING_SQL,
    "op12_filter_audit": _AUDIT_SQL,
    "op13_elkan": _clusters_sql(),
}
