"""The registered queries of this subpackage, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, edit_prints, fixity, hard_negatives, language_id, mixing, near_dup, period_runs, quality_rules, suffix_tree, token_counts, token_files, toxicity
from .staging import documents, new_path, remainder


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score_texts(documents(spark, sf_dir).withColumn("train", remainder(5) != 1))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), tokenizer_path())


def op3_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits a replica of `pages` in which some records were altered and some lost."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    replica = pages.where("page_id % 101 <> 7").withColumn("html", F.when(F.col("page_id") % 97 == 5, F.concat("html", F.lit(" "))).otherwise(F.col("html")))
    return fixity.audit(pages, replica, "page_id", ["url", "html"])


def op4_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), remainder(3) != 1)
    rows = toxicity.score(docs, model)
    return rows.select("doc_id", (remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rows = language_id.identify(docs, language_id.learn(docs, remainder(3) != 1))
    return rows.select("doc_id", (remainder(3) == 1).alias("held_out"), "lang_pred", "score", "phrase_rate")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_files.write_token_files(documents(spark, sf_dir), new_path(spark, "token-files"), tokenizer_path())
    return token_files.read_digests(spark, out)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.apply_rules(documents(spark, sf_dir))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_super_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(documents(spark, sf_dir), width=3, percent=85)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "first_slot", "last_slot")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest(decontamination.find_overlaps(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("label", label)
    return hard_negatives.mine(hard_negatives.quantised(rows), F.col("vec_id") % 100 == 0)


def op12_period_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return period_runs.collapse_runs(documents(spark, sf_dir), plant=True, texts=False)


def op13_edit_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = edit_prints.fingerprints(documents(spark, sf_dir))
    rows = prints.join(edit_prints.near_groups(prints), "fingerprint", "left")
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "group_id")


def queries() -> dict:
    return {f.__name__: f for f in (op1_suffix_tree, op2_token_counts, op3_merkle_fixity, op4_toxic_segments, op5_language_id, op6_token_files, op7_quality_rules, op8_super_minhash, op9_mixing, op10_decontamination, op11_hard_negatives, op12_period_runs, op13_edit_prints)}


_OP3 = """
    WITH p AS (SELECT page_id, html, coalesce(strlen(url), 0) + coalesce(strlen(html), 0) AS bytes FROM pages),
    o AS (SELECT *, coalesce(sum(bytes) OVER (ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM p)
    SELECT page_id, CASE WHEN page_id % 101 = 7 THEN 'missing' ELSE 'corrupt' END AS status, "offset", bytes::BIGINT AS bytes
    FROM o WHERE page_id % 101 = 7 OR (page_id % 97 = 5 AND html IS NOT NULL)"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"'[^\x20\x09-\x0D]+'"


def _op7_sql() -> str:
    stop = ", ".join(f"'{w}'" for w in [*quality_rules.STOP_WORDS, *map(str.capitalize, quality_rules.STOP_WORDS)])
    tests = []
    for r in quality_rules.RULES:
        top, bottom = ("1" if x == "one" else x for x in (r.top, r.bottom))
        if r.low is not None:
            tests.append(f"({bottom} = 0 OR {top} >= {r.low}::DOUBLE * {bottom})")
        if r.high is not None:
            tests.append(f"({bottom} = 0 OR {top} <= {r.high}::DOUBLE * {bottom})")
    return rf"""
    WITH d AS (
        SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w,
               list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
        FROM documents),
    windows AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS x FROM d, unnest(range(1, len(w) - 6)) u(i)),
    twice AS (SELECT doc_id, x FROM windows GROUP BY ALL HAVING count(*) > 1),
    covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM windows JOIN twice USING (doc_id, x), unnest(range(i, i + 8)) u(p) GROUP BY doc_id),
    m AS (
        SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
               len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
               coalesce(c.n, 0) AS n_repeat_words, len(l) AS n_lines, len(list_filter(w, lambda x: x IN ({stop}))) AS n_stop_words,
               len(list_filter(w, lambda x: lower(x) <> upper(x))) AS n_alpha_words
        FROM d LEFT JOIN covered c ON c.doc_id = d.doc_id),
    b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
    SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
           n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
           NOT base_failed AND {" AND ".join(tests)} AS kept
    FROM b"""


_OP8 = rf"""
    WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_WORDS}) AS w FROM documents),
    s AS (
        SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
            ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END)) AS x
        FROM d),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
    link AS (SELECT a, b FROM both_ JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 85 * (na.n + nb.n - k)),
    reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
    c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
    SELECT c.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, c.doc_id = component_id AS kept
    FROM c LEFT JOIN n ON n.doc_id = c.doc_id"""

_OP9 = rf"""
    WITH d AS (
        SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {_WORDS}))::BIGINT AS size,
               md5(concat(doc_id::VARCHAR, ':', coalesce(md5(text), ''))) AS key
        FROM documents),
    s AS (
        SELECT source, sum(size)::BIGINT AS source_size,
               [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER]::BIGINT AS weight
        FROM d GROUP BY source),
    r AS (
        SELECT *, 2 * source_size AS cap, (2 * source_size)::DOUBLE / weight AS ratio, sum(source_size) OVER ()::BIGINT AS total,
               sum(weight) OVER ()::BIGINT AS weights FROM s),
    l AS (
        SELECT *, (total * 150 / 100.0::DOUBLE - coalesce(sum(cap) OVER w, 0)::DOUBLE) / (weights - coalesce(sum(weight) OVER w, 0))::DOUBLE AS level
        FROM r WINDOW w AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    free AS (SELECT arg_min(level, ratio) AS level FROM l WHERE ratio > level),
    t AS (SELECT source, source_size, CASE WHEN ratio <= level THEN cap::DOUBLE ELSE weight * (SELECT level FROM free) END AS target FROM l),
    p AS (
        SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
        FROM d),
    size_ AS (SELECT greatest({mixing.LEAST_BLOCK}, floor(sum(target))::BIGINT // {mixing.SLOTS} + 1)::BIGINT AS block, sum(target) AS goal FROM t),
    parts AS (SELECT source, lo, coalesce(lead(lo) OVER (ORDER BY source NULLS LAST), 2) AS hi FROM
        (SELECT source, coalesce(sum(target) OVER (ORDER BY source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / goal AS lo FROM t, size_ WHERE target > 0)),
    points AS (SELECT slot, list_sum(list_transform(range(40), lambda i: ((slot >> i) & 1) * power(2.0::DOUBLE, -(i + 1)))) AS u FROM size_, unnest(range(floor(goal)::BIGINT // block + 1)) x(slot)),
    ranked AS (SELECT source, slot, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS nth FROM points JOIN parts ON u >= lo AND u < hi),
    goes AS (
        SELECT p.source, pos, min(slot) AS first_slot, max(slot) AS last_slot
        FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source, size_, (VALUES (0), (1)) again(n), ranked r
        WHERE size > 0 AND r.source IS NOT DISTINCT FROM p.source AND nth * block < floor(target)
          AND nth BETWEEN (pos + n * source_size) // block AND (pos + n * source_size + size - 1) // block AND pos + n * source_size < least((nth + 1) * block, floor(target))
        GROUP BY ALL)
    SELECT doc_id, size, t.source_size, target, first_slot, last_slot,
           (greatest(0, least(p.pos + size, floor(target)::BIGINT) - p.pos)
            + greatest(0, least(t.source_size + p.pos + size, floor(target)::BIGINT) - t.source_size - p.pos))::BIGINT AS taken
    FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source LEFT JOIN goes g ON g.source IS NOT DISTINCT FROM p.source AND g.pos = p.pos AND p.size > 0"""

_OP10 = rf"""
    WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    win AS (
        SELECT DISTINCT item_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 10 THEN [w]
            ELSE list_transform(range(1, len(w) - 8), lambda i: w[i:i + 9]) END) AS x
        FROM b),
    sizes AS (SELECT DISTINCT len(x) AS l FROM win),
    dw AS (SELECT doc_id, l, i, w[i:i + l - 1] AS x FROM d, sizes, unnest(range(1, len(w) - l + 2)) u(i)),
    hit AS (SELECT doc_id, i, l, item_id FROM dw JOIN win USING (x)),
    words AS (SELECT doc_id, count(DISTINCT p) AS n FROM hit, unnest(range(i, i + l)) u(p) GROUP BY doc_id),
    items AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM hit GROUP BY doc_id)
    SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items,
           sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
    FROM d LEFT JOIN words ON words.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id"""


_OP11 = """
    WITH v AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
        FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
        SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
               coalesce(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])), 0)::BIGINT AS score
        FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
    p AS (
        SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
    SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id)::INTEGER AS rank,
           other_id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
    QUALIFY rank <= 5"""


def oracle_sql() -> dict[str, str]:
    return {"op3_merkle_fixity": _OP3, "op7_quality_rules": _op7_sql(), "op8_super_minhash": _OP8, "op9_mixing": _OP9, "op10_decontamination": _OP10, "op11_hard_negatives": _OP11}
