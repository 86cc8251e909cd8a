"""Queries of the training-data operators and their SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldroute.llm import gam, toxicity, warc
from fieldroute.llm.bpe import decode, encode
from fieldroute.llm.clustering import clusters
from fieldroute.llm.exact_dedup import exact_groups
from fieldroute.llm.filter_audit import audit
from fieldroute.llm.huffman import read_tokens, write_tokens
from fieldroute.llm.minhash import near_groups
from fieldroute.llm.packing import pack
from fieldroute.llm.quality_rules import quality
from fieldroute.llm.suffix_dedup import remove_repeats
from fieldroute.llm.url_filter import judge_urls, rules_frame
from fieldroute.session import shared_dir, table

#: Ends every document in the queries that use the word tokenizer.
END_ID = 1

#: Rules of the url query: action, host, path.
URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    both = decode(encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, space_starts_match=True), path)
    spelt = F.array_join(F.col("ids").cast("array<string>"), " ")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(spelt.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules_frame(spark, URL_RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), columns=["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), with_sentences=True)
    found = F.transform("sentences", lambda s: s["first_word"])
    return scored.select("doc_id", "held_out", "score", "predicted", F.size("sentences").cast("long").alias("n_offending"), F.array_join(found.cast("array<string>"), ",").alias("offending_at"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), END_ID)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/fieldroute/tokens-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), END_ID)
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return gam.score(docs, gam.train(docs, table(spark, sf_dir, "labels")))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sound vector with its cluster after three rounds of 16 centroids, exact in integers."""
    return clusters(table(spark, sf_dir, "embeddings"), k=16, rounds=3, dims=64)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of the five filters removes, for every source, order of the filters and step."""
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as read back from the archives that were written for it."""
    back = warc.round_trip(table(spark, sf_dir, "pages"), f"{shared_dir(spark)}/fieldroute/warc-{uuid.uuid4().hex}")
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_exact_dedup, op2_byte_bpe, op3_url_filter, op4_quality_rules, op5_toxicity, op6_packing, op7_token_files, op8_minhash, op9_quality_classifier, op10_suffix_dedup, op11_centroids, op12_filter_audit, op13_warc)}


def _clusters_sql(k: int = 16, rounds: int = 3, dims: int = 64) -> str:
    """Plain k-means: every distance is computed, and means are floored as whole numbers."""
    nearest = "SELECT v.n, v.vec_id, v.i, arg_min(c.j, (list_sum(list_transform(range(1, {d}), lambda x: (v.i[x] - c.c[x]) * (v.i[x] - c.c[x]))), c.j)) AS j FROM v, {c} c GROUP BY ALL"
    parts = [
        f"v AS (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS i FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})",
        f"c0 AS (SELECT row_number() OVER (ORDER BY h, i) - 1 AS j, i AS c FROM (SELECT i, sha256('1:' || vec_id) AS h FROM v ORDER BY h, i LIMIT {k}))",
    ]
    for r in range(rounds + 1):
        parts.append(f"a{r} AS MATERIALIZED ({nearest.format(d=dims + 1, c=f'c{r}')})")
        if r < rounds:
            parts.append(f"s{r} AS (SELECT j, x, CAST((sum(y) - ((sum(y) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS m FROM (SELECT j, unnest(range(1, {dims + 1})) AS x, unnest(i) AS y FROM a{r}) GROUP BY j, x)")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c{r}.j, coalesce(m.c, c{r}.c) AS c FROM c{r} LEFT JOIN (SELECT j, list(m ORDER BY x) AS c FROM s{r} GROUP BY j) m ON c{r}.j = m.j)")
    last = f"SELECT a.vec_id, a.j, CAST(list_sum(list_transform(range(1, {dims + 1}), lambda x: (a.i[x] - c.c[x]) * (a.i[x] - c.c[x]))) AS BIGINT) AS distance, sha256(array_to_string(c.c, ',')) AS sha FROM a{rounds} a JOIN c{rounds} c ON a.j = c.j"
    return f"WITH {', '.join(parts)} SELECT vec_id, CAST(j AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY j) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha AS centroid_sha256 FROM ({last})"


#: DuckDB SQL; the LLR verdict of op4 and the trained or tokenised operators have none. That of op8 pairs off shared shingles and that of op10 spells every window: for small tables.
ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)""",
    "op3_url_filter": r"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(action, rhost, rpath) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
m AS (SELECT p.page_id, r.rhost || r.rpath AS rule, r.action, row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rhost || r.rpath) DESC, length(r.rhost) DESC) AS k
FROM p JOIN r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath))
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.action, 'allow') AS verdict
FROM p LEFT JOIN m ON p.page_id = m.page_id AND m.k = 1""",
    "op8_minhash": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
sh AS (SELECT doc_id, len(s) AS n, unnest(s) AS s FROM sets),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k, any_value(a.n) + any_value(b.n) AS n FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM common WHERE 100 * k >= 75 * (n - k) UNION ALL SELECT y, x FROM common WHERE 100 * k >= 75 * (n - k)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON r.other = l.x),
roots AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN roots USING (doc_id)""",
    "op10_suffix_dedup": """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, unnest(range(0, len(h) // 2 - 49)) AS p, unnest(list_transform(range(0, len(h) // 2 - 49), lambda i: substr(h, 2 * i + 1, 100))) AS s FROM h),
gone AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY s) AS first FROM w) WHERE first < doc_id),
steps AS (SELECT doc_id, p, coalesce(p > lag(p) OVER d + 50, true) AS opens FROM gone WINDOW d AS (PARTITION BY doc_id ORDER BY p)),
numbered AS (SELECT doc_id, p, sum(CAST(opens AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM steps),
spans AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM numbered GROUP BY doc_id, run),
edges AS (SELECT doc_id, a, b FROM spans UNION ALL SELECT doc_id, len(h) // 2, len(h) // 2 FROM h),
heads AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a, b), 0) AS since FROM edges)
SELECT doc_id, CAST(any_value(len(h) // 2) AS BIGINT) AS n_bytes, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) - 1 AS n_spans,
 sha256(unhex(string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a, b))) AS kept_sha256
FROM heads JOIN h USING (doc_id) GROUP BY doc_id""",
    "op11_centroids": _clusters_sql(),
    "op12_filter_audit": r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
 (CASE WHEN len(w) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END)
 || (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 'C' ELSE '' END) || (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END)
 || (CASE WHEN min(t.doc_id) OVER (PARTITION BY text) < t.doc_id THEN 'E' ELSE '' END) AS fails FROM t LEFT JOIN l ON t.doc_id = l.doc_id),
x(c) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT a.c || b.c || d.c || e.c || g.c AS filter_order FROM x a, x b, x d, x e, x g WHERE len(list_distinct([a.c, b.c, d.c, e.c, g.c])) = 5),
s AS (SELECT filter_order, CAST(k AS INTEGER) AS step, substr(filter_order, k, 1) AS own, substr(filter_order, 1, k - 1) AS before FROM o, range(1, 6) r(k)),
g AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
e AS (SELECT part, filter_order, step, own, contains(fails, own) AS hit, length(translate(fails, before, '')) < length(fails) AS gone, fails = own AS alone, n, good, toxic FROM g, s),
c AS (SELECT part, filter_order, step, own, CAST(sum(CASE WHEN NOT hit AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS removed,
 CAST(sum(CASE WHEN hit AND gone THEN n ELSE 0 END) AS BIGINT) AS redundant, CAST(sum(CASE WHEN alone THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
 CAST(sum(CASE WHEN hit AND NOT gone THEN good ELSE 0 END) AS BIGINT) AS good_lost, CAST(sum(CASE WHEN hit AND NOT gone THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost FROM e GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM c""",
    "op13_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
f AS (SELECT page_id, n, html, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY html) ELSE page_id END AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM f""",
}
