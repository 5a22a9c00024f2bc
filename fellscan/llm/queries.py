"""The registered queries of the training-data operators, with the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fellscan.llm import binary_packing, cotraining, cover_tree, exact_dedup, license_scan, mixing, ngram_join, piece_dropout, quality_rules, secret_scan, stratified_search, token_count, token_store
from fellscan.llm.common import LOWER, UPPER, shared_folder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
END_ID = 2


def _register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@_register
def op1_piece_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_dropout.encode(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), keep_ids=False)


@_register
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_spans(table(spark, sf_dir, "documents"))


@_register
def op3_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return cotraining.train(docs, table(spark, sf_dir, "labels")).score(docs)


@_register
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


@_register
def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_components(table(spark, sf_dir, "documents"))


@_register
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = exact_dedup.arrivals(exact_dedup.document_stream(spark, f"{sf_dir}/documents.parquet"))
    state = exact_dedup.keyed_state(stream, shared_folder(spark, "dedup-state"))
    return exact_dedup.verdicts(table(spark, sf_dir, "documents"), state).withColumnRenamed("digest", "text_sha256")


@_register
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


@_register
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.measure(table(spark, sf_dir, "documents"))


@_register
def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "token-store")
    token_store.write_store(table(spark, sf_dir, "documents"), folder, tokenizer_file("word_bpe_49k.json"), END_ID)
    return token_store.read_documents(spark, folder)


@_register
def op10_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


@_register
def op11_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "packed")
    binary_packing.write_sequences(table(spark, sf_dir, "documents"), folder, tokenizer_file("word_bpe_49k.json"))
    return binary_packing.described(binary_packing.read_sequences(spark, folder))


@_register
def op12_stratified_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = stratified_search.build(table(spark, sf_dir, "documents"))
    return stratified_search.search(index, table(spark, sf_dir, "benchmark"))


@_register
def op13_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return cover_tree.hard_negatives(cover_tree.usable(table(spark, sf_dir, "embeddings"), label=shifted), F.col("id") % 100 == 0)


def _text(sql: str) -> str:
    return "'" + sql.replace("'", "''") + "'"


_LOW = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"

ORACLES["op6_exact_dedup"] = f"""
WITH d AS (SELECT doc_id, sha256({_LOW}) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM d"""


def _spelled(expr: str) -> str:
    for a, b in license_scan.SPELLINGS:
        expr = f"replace({expr}, '{a}', '{b}')"
    return expr


def _canonical_lines(text: str) -> str:
    """Lambda-free per-line form is not possible, so lists it is."""
    line = f"CASE WHEN regexp_matches(x, {_text(license_scan.COPYRIGHT_LINE)}) THEN '' ELSE trim(regexp_replace(x, {_text(license_scan.NOT_ALNUM)}, ' ', 'g')) END"
    return f"list_filter(list_transform(string_split({text}, chr(10)), lambda x: {line}), lambda x: x <> '')"


ORACLES["op7_license_scan"] = f"""
WITH known_texts AS (SELECT * FROM (VALUES {", ".join(f"({_text(i)}, {_text(t)})" for i, t in license_scan.KNOWN)}) k(license_id, text)),
known AS (SELECT sha256({_spelled(f"array_to_string({_canonical_lines(_LOW)}, ' ')")}) AS digest, min(license_id) AS license_id FROM known_texts GROUP BY 1),
d AS (SELECT doc_id, {_canonical_lines(_LOW)} AS lines FROM documents),
l AS (SELECT doc_id, k.license_id FROM (SELECT doc_id, unnest(lines) AS line FROM d) JOIN known k ON k.digest = sha256({_spelled("line")})),
c AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS found FROM l GROUP BY doc_id),
w AS (SELECT doc_id, sha256({_spelled("array_to_string(lines, ' ')")}) AS canonical_sha256 FROM d)
SELECT w.doc_id, canonical_sha256, k.license_id, coalesce(n, 0) AS n_license_lines, coalesce(found, '') AS line_licenses
FROM w LEFT JOIN known k ON k.digest = w.canonical_sha256 LEFT JOIN c ON c.doc_id = w.doc_id"""

_WS, _SYM = r"[\x20\x09-\x0D]+", r"[^#*$%&|<>]+"
_WORDS = "list_filter(string_split_regex({0}, '" + _WS + "'), lambda w: w <> '')"
_SHARE = "len(list_filter(ws, lambda w: {0}))"
ORACLES["op8_quality_rules"] = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, {_WORDS.format("t")} AS words FROM d),
g AS (SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) >= 3),
s AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS s FROM g),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM s),
p AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS place FROM r WHERE c > 1) GROUP BY doc_id),
l0 AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
l AS (SELECT doc_id, line, {_WORDS.format("line")} AS ws FROM l0),
v AS (SELECT doc_id, line, length(array_to_string(ws, '')) AS chars, len(ws) AS n,
        length(regexp_replace(line, '{_SYM}', '', 'g')) > {quality_rules.MAX_SYMBOLS_PER_WORD} * len(ws)
        OR (len(ws) >= 3 AND {_SHARE.format("w IN ('|', '>', '»', '•')")} >= {quality_rules.NAVIGATION_SHARE} * len(ws))
        OR (len(ws) >= 3 AND {_SHARE.format("w LIKE '%!!'")} >= {quality_rules.SHOUTING_SHARE} * len(ws))
        OR (len(ws) < {quality_rules.SHORT_LINE} AND NOT regexp_matches(line, '[.!?:;…]'))
        OR (len(ws) <= {quality_rules.NOTICE_WORDS} AND regexp_matches(line, '{quality_rules.BOILERPLATE}')) AS failed
      FROM l WHERE len(ws) > 0),
a AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines, coalesce(sum(chars) FILTER (NOT failed), 0) AS kept_chars, count(*) FILTER (failed) AS n_failed_lines FROM v GROUP BY doc_id),
m AS (SELECT w.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, length(regexp_replace(t, '{_SYM}', '', 'g')) AS n_symbols,
        coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words, CAST(coalesce(kept_chars, 0) AS BIGINT) AS kept_chars, coalesce(n_failed_lines, 0) AS n_failed_lines
      FROM w LEFT JOIN a ON a.doc_id = w.doc_id LEFT JOIN p ON p.doc_id = w.doc_id),
b AS (SELECT *, n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND kept_chars >= {quality_rules.MIN_KEPT_SHARE} * word_chars AS kept FROM b"""

ORACLES["op5_ngram_join"] = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOW)} AS ws FROM documents),
g AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS gs FROM w),
n AS (SELECT doc_id, len(gs) AS n FROM g),
s AS (SELECT doc_id, unnest(gs) AS s FROM g),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM i JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 90 * (p.n + q.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.y FROM r JOIN e ON e.x = r.b)
SELECT n.doc_id, n.n AS n_shingles, m.b AS component_id FROM n JOIN (SELECT a, min(b) AS b FROM r GROUP BY a) m ON m.a = n.doc_id"""


_TERMS = "regexp_extract_all(" + _LOW + ", '" + stratified_search.TERM + "')"
ORACLES["op12_stratified_search"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ts FROM documents),
g AS (SELECT count(*) AS docs, CAST(sum(len(ts)) AS BIGINT) AS words FROM d WHERE len(ts) > 0),
i AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS t FROM benchmark),
p AS (SELECT r, doc_id, len(ts) AS n, unnest(ts) AS t FROM d),
f AS (SELECT r, doc_id, n, t, count(*) AS tf FROM p WHERE t IN (SELECT t FROM i) GROUP BY ALL),
w AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM f, g GROUP BY t),
s AS (SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // words)))) AS BIGINT) AS score
      FROM i JOIN f USING (t) JOIN w USING (t), g GROUP BY item_id, r, doc_id),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM k WHERE rank <= 50"""

ORACLES["op13_cover_tree"] = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda v: floor(256 * CAST(v AS DOUBLE))) AS x
      FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5),
n AS (SELECT p.a, p.b AS p, s.b AS n, p.score AS ps, s.score AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS k
      FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT a AS anchor_id, p AS positive_id, CAST(k AS INTEGER) AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE k <= 5"""
