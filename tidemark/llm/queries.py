"""The registered queries of the numbered operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import byte_bpe, exact_dedup, lm_scoring, merkle, packing, periodic_runs, quality_rules, secret_scans, sentence_piece, token_counts, toxicity, url_filters
from tidemark.llm.jaccard_join import JaccardJoin


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _fold(of: int) -> F.Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(of))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, _fold(4) != 2)
    rows = toxicity.scored(docs, model)
    return rows.select("doc_id", (_fold(4) == 2).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lm_scoring.scored(_documents(spark, sf_dir), _fold(5) != 1)
    return rows.select("doc_id", (_fold(5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judged(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_documents(spark, sf_dir))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return JaccardJoin(size=3, percent=90).joined(_documents(spark, sf_dir))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicated(_documents(spark, sf_dir))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(_documents(spark, sf_dir)).drop("host_rate")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counted(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.coded(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    forest = secret_scans.fit(secret_scans.labelled_findings(spark))
    return secret_scans.scanned(_documents(spark, sf_dir), forest)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_documents(spark, sf_dir))


def op12_sentence_piece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_piece.coded(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.detected(_documents(spark, sf_dir), loop=True)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_lm_scoring, op3_url_filters, op4_packing, op5_jaccard_join, op6_exact_dedup,
        op7_quality_rules, op8_token_counts, op9_byte_bpe, op10_secret_scans,
        op11_merkle_manifest, op12_sentence_piece, op13_periodic_runs, pipeline,
    )
}

#: SQL of the same rows, written plainly. The others learn, draw or follow a vocabulary: tests hold them against brute force or the public libraries.
ORACLE_SQL: dict[str, str] = {
    "op3_url_filters": r"""
        WITH RECURSIVE cut AS (SELECT page_id, CASE WHEN coalesce(strpos(url, '://'), 0) > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        parsed AS (
            SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
        ),
        ruled AS (
            SELECT *, CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
                WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
                WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
                WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule,
                array_to_string(list_transform(string_split(path, '/'), lambda s, i: CASE WHEN i > 1 AND regexp_full_match(s, '[^/]*[0-9]{2,}[^/]*|[0-9]|[0-9a-fA-F-]{16,}') THEN '*' ELSE s END), '/') AS form
            FROM parsed
        ),
        urls AS (SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS ruled FROM ruled),
        seen AS (SELECT host, form, count(*) AS n, count(ruled) AS labelled, count(*) FILTER (WHERE ruled = 'block') AS blocked FROM urls GROUP BY host, form),
        parts AS (SELECT host, n, unnest(string_split(form, '/')) AS segment, generate_subscripts(string_split(form, '/'), 1) AS place FROM seen),
        places AS (SELECT host, place FROM (SELECT host, place, segment, sum(n) AS n FROM parts GROUP BY host, place, segment) GROUP BY host, place HAVING sum(n) >= 20 AND count(*) > 0.5 * sum(n)),
        varied AS (SELECT host, list(place) AS places FROM places GROUP BY host),
        tree AS (
            SELECT s.*, CASE WHEN v.places IS NULL THEN form ELSE array_to_string(list_transform(string_split(form, '/'), lambda x, i: CASE WHEN i > 1 AND list_contains(v.places, i) THEN '*' ELSE x END), '/') END AS template
            FROM seen s LEFT JOIN varied v ON s.host = v.host
        ),
        leaves AS (SELECT host, template, sum(labelled) AS labelled, sum(blocked) AS blocked FROM tree GROUP BY host, template),
        named AS (SELECT *, regexp_replace(host, ':[0-9]*$', '') AS bare, string_split(template, '/')[2:9] AS segments FROM leaves),
        split AS (SELECT *, string_split(bare, '.')[-8:] AS names FROM named),
        hung AS (
            SELECT host, template, labelled, blocked,
                list_filter(list_transform(list_reverse(range(1, len(names) + 1)), lambda i: '?' || array_to_string(names[i:], '.')), lambda x: contains(x, '.') AND NOT regexp_matches(bare, '^[0-9.]*$|\[')) || [host]
                || flatten(list_transform(range(1, len(segments) + 1), lambda i: [
                    host || '/' || array_to_string(segments[1:i - 1], '/') || '?' || regexp_replace(regexp_replace(segments[i], '\p{L}+', 'a', 'g'), '[0-9]+', '0', 'g'), host || '/' || array_to_string(segments[1:i], '/')]))
                || [host || template] AS nodes
            FROM split
        ),
        chains AS (SELECT host, template, any_value(labelled) AS labelled, any_value(blocked) AS blocked, node, min(pos) AS pos FROM (SELECT *, unnest(nodes) AS node, generate_subscripts(nodes, 1) AS pos FROM hung) GROUP BY host, template, node),
        nodes AS (SELECT node, sum(labelled) AS labelled, sum(blocked) AS blocked FROM chains WHERE labelled > 0 GROUP BY node),
        steps AS (SELECT c.host, c.template, c.node, n.labelled, n.blocked, row_number() OVER (PARTITION BY c.host, c.template ORDER BY c.pos) AS k FROM chains c JOIN nodes n ON c.node = n.node),
        total AS (SELECT sum(labelled) AS labelled, sum(blocked) AS blocked FROM leaves),
        fold AS (
            SELECT host, template, 0::BIGINT AS k, t.labelled::DOUBLE AS labelled, t.blocked::DOUBLE AS blocked, coalesce(t.blocked / nullif(t.labelled, 0), 0)::DOUBLE AS purity FROM leaves, total t
            UNION ALL
            SELECT host, template, k, CASE WHEN own THEN nl ELSE labelled END, CASE WHEN own THEN nb ELSE blocked END, CASE WHEN own THEN (nb + 4.0 * purity) / (nl + 4.0) ELSE purity END FROM (
                SELECT f.host, f.template, s.k, f.labelled, f.blocked, f.purity, s.labelled::DOUBLE AS nl, s.blocked::DOUBLE AS nb, coalesce(f.labelled > s.labelled
                    AND abs(s.blocked / s.labelled - (f.blocked - s.blocked) / nullif(f.labelled - s.labelled, 0)) > 1.96 * sqrt(f.blocked / f.labelled * (1 - f.blocked / f.labelled) * (1 / s.labelled + 1 / nullif(f.labelled - s.labelled, 0))), false) AS own
                FROM fold f JOIN steps s ON f.host = s.host AND f.template = s.template AND s.k = f.k + 1)
        ),
        verdicts AS (SELECT host, template, arg_max(purity, k) AS purity, max(k) > 0 AND arg_max(purity, k) >= 0.8 AS rejected FROM fold GROUP BY host, template)
        SELECT u.page_id, u.host, u.path, u.rule, coalesce(u.ruled, CASE WHEN v.rejected THEN 'block' ELSE 'allow' END) AS verdict, t.template, v.purity
        FROM urls u JOIN tree t ON u.host = t.host AND u.form = t.form JOIN verdicts v ON t.host = v.host AND t.template = v.template
    """,
    "op5_jaccard_join": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
        ),
        sets AS (
            SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) > 2 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS held FROM d
        ),
        classes AS (SELECT held, row_number() OVER () AS class, min(doc_id) AS least FROM sets WHERE len(held) > 0 GROUP BY held),
        shingles AS (SELECT class, len(held) AS n, unnest(held) AS shingle FROM classes),
        pairs AS (
            SELECT a.class AS one, b.class AS other FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.class < b.class
            WHERE 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY a.class, b.class, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
        ),
        links AS (SELECT one, other FROM pairs UNION ALL SELECT other, one FROM pairs),
        reach AS (SELECT class, class AS met FROM classes UNION SELECT r.class, l.other FROM reach r JOIN links l ON r.met = l.one),
        components AS (SELECT r.class, min(c.least) AS component_id FROM reach r JOIN classes c ON r.met = c.class GROUP BY r.class)
        SELECT s.doc_id, CAST(len(s.held) AS BIGINT) AS n_shingles, coalesce(p.component_id, s.doc_id) AS component_id
        FROM sets s LEFT JOIN classes c ON s.held = c.held LEFT JOIN components p ON c.class = p.class
    """,
    "op6_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT d.doc_id, g.keep_id, g.group_size, coalesce(d.doc_id = g.keep_id, false) AS kept, sha256(d.t) AS text_sha256
        FROM d JOIN g ON d.t = g.t
    """,
    "op7_quality_rules": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
        t AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
        words AS (SELECT r, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM t),
        windows AS (SELECT r, i, a, lead(a) OVER p AS b, lead(a, 2) OVER p AS c FROM words WINDOW p AS (PARTITION BY r ORDER BY i)),
        twice AS (SELECT r, i FROM windows WHERE c IS NOT NULL QUALIFY count(*) OVER (PARTITION BY r, a, b, c) > 1),
        inside AS (SELECT r, count(DISTINCT i + j) AS n FROM twice, (VALUES (0), (1), (2)) AS v(j) GROUP BY r),
        counts AS (
            SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
                CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
                CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
            FROM t LEFT JOIN inside ON t.r = inside.r
        ),
        failing AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts),
        hosts AS (SELECT source, count(*) AS docs, sum(CAST(base_failed AS BIGINT)) AS failures FROM failing GROUP BY source),
        moments AS (SELECT avg(failures / docs) AS m, var_pop(failures / docs) AS v, avg(1 / docs) AS each FROM hosts),
        prior AS (SELECT m, CASE WHEN v - m * (1 - m) * each > 1e-12 THEN least(greatest(m * (1 - m) / (v - m * (1 - m) * each) - 1, 1.0), 1e6) ELSE 1e6 END AS s FROM moments),
        shrunk AS (SELECT source, docs, failures, m, s, (failures + m * s) / (docs + s) AS rate FROM hosts, prior),
        verdicts AS (SELECT source, failures > 0 AND rate - 1.645 * sqrt(rate * (1 - rate) / (docs + s + 1)) >= 2.0 * m AS rejected FROM shrunk)
        SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(rejected, false) AS kept
        FROM failing f LEFT JOIN verdicts h ON f.source IS NOT DISTINCT FROM h.source
    """,
    "op11_merkle_manifest": r"""
        WITH RECURSIVE d AS (
            SELECT row_number() OVER () AS r, doc_id, source, concat_ws('',
                    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
                    coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head, text, replace(text, chr(10), '') AS cut,
                list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda crc, b:
                    list_reduce([xor(crc, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda x, step: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS crc
            FROM documents
        ),
        hashed AS (
            SELECT r, doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
                CASE WHEN xor(crc, 4294967295) % 2 = 0 THEN sha256(head || coalesce(strlen(cut) || ':' || cut, '-')) END AS changed FROM d
        ),
        places AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM hashed),
        up AS (
            SELECT source, 0 AS level, list(leaf ORDER BY idx) AS nodes FROM places GROUP BY source
            UNION ALL
            SELECT source, level + 1, list_transform(range(0, len(nodes), 3), lambda i: sha256(array_to_string(nodes[i + 1:i + 3], ''))) FROM up WHERE len(nodes) > 1
        ),
        tops AS (SELECT source, nodes[1] AS top, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place FROM up WHERE len(nodes) = 1),
        crown AS (
            SELECT 0 AS level, list(top ORDER BY place) AS nodes FROM tops
            UNION ALL
            SELECT level + 1, list_transform(range(0, len(nodes), 3), lambda i: sha256(array_to_string(nodes[i + 1:i + 3], ''))) FROM crown WHERE len(nodes) > 1
        ),
        steps AS (
            SELECT p.r, u.level, u.nodes, (p.idx // (3 ** u.level)::BIGINT) AS pos FROM places p JOIN up u ON p.source IS NOT DISTINCT FROM u.source WHERE len(u.nodes) > 1
            UNION ALL
            SELECT p.r, 1000 + o.level, o.nodes, (t.place // (3 ** o.level)::BIGINT) FROM places p JOIN tops t ON p.source IS NOT DISTINCT FROM t.source, crown o WHERE len(o.nodes) > 1
        ),
        sides AS (SELECT r, level, array_to_string(nodes[pos - pos % 3 + 1:pos], '') AS before, array_to_string(nodes[pos + 2:pos - pos % 3 + 3], '') AS behind FROM steps),
        proofs AS (SELECT r, list(before ORDER BY level) AS lefts, list(behind ORDER BY level) AS rights FROM sides GROUP BY r),
        done AS (
            SELECT p.doc_id, p.leaf, t.top AS subroot, (SELECT nodes[1] FROM crown WHERE len(nodes) = 1) AS root,
                sha256(coalesce(array_to_string(list_transform(range(1, len(lefts) + 1), lambda i: lefts[i] || rights[i]), ''), '')) AS proof_sha256,
                list_reduce([coalesce(changed, leaf)] || coalesce(list_transform(range(1, len(lefts) + 1), lambda i: lefts[i] || ' ' || rights[i]), []), lambda node, sibs: sha256(split_part(sibs, ' ', 1) || node || split_part(sibs, ' ', 2))) AS folded_root
            FROM places p JOIN tops t ON p.source IS NOT DISTINCT FROM t.source LEFT JOIN proofs f ON p.r = f.r
        )
        SELECT *, folded_root = root AS verified FROM done
    """,
}
