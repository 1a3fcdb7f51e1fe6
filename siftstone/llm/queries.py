"""Queries on the training corpus, one per operator, and SQL that DuckDB can run for them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.session import ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftstone.llm.substring_dedup import dedup_substrings

    return dedup_substrings(_table(spark, sf_dir, "documents")).drop("kept_text")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftstone.llm.decontaminate import contamination

    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("items")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftstone.llm.licenses import scan_licenses

    return scan_licenses(_table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftstone.llm import quality

    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit_from(docs, quality.grade_of(_table(spark, sf_dir, "labels"))))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftstone.llm.langid import identify

    return identify(_table(spark, sf_dir, "documents"))


def op6_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftstone.llm.neardup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=4)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftstone.llm.sharding import shard

    return shard(_table(spark, sf_dir, "documents"))


def op8_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftstone.llm.hostrules import host_rules

    return host_rules(_table(spark, sf_dir, "documents")).withColumn("host_rate", F.round("host_rate", 6))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftstone.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents")).withColumn("shard_words", F.array_join("shard_words", ","))


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of the mix SQL can say: sizes and targets."""
    from siftstone.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftstone.llm.pii import find_personal

    return find_personal(_table(spark, sf_dir, "documents"))


def personal_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of personal data SQL can say: spans by pattern."""
    from siftstone.llm.pii import find_personal

    return find_personal(_table(spark, sf_dir, "documents")).drop("spans")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_QUERIES = (op1_substring_dedup, op2_decontaminate, op3_licenses, op4_quality, op5_language, op6_minhash_neardup, op7_sharding, op8_host_rules, op9_mixing, op10_personal_data, pipeline, mixing_targets, personal_base)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return ORACLES | {"op3_licenses": _licenses_sql(), "personal_base": _personal_sql()}


#: Words of a text in order; separators are space and TAB..CR.
_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_ALNUM = _WORDS.replace("coalesce(text, '')", _LOWER).replace(r"[\x20\x09-\x0D]+", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")

ORACLES = {
    "op1_substring_dedup": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
        v AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k FROM p WHERE i + 49 <= len(w)),
        m AS (SELECT k, min(doc_id) AS least FROM v GROUP BY k),
        b AS (SELECT v.doc_id, v.i FROM v JOIN m USING (k) WHERE v.doc_id > m.least),
        g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM b),
        r AS (SELECT p.doc_id, count(*) FILTER (g.i IS NULL) AS n_kept, string_agg(p.w[p.i], ' ' ORDER BY p.i) FILTER (g.i IS NULL) AS kept
              FROM p LEFT JOIN g ON g.doc_id = p.doc_id AND g.i = p.i GROUP BY p.doc_id)
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(r.n_kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(r.kept, '')) AS kept_sha256
        FROM d LEFT JOIN r USING (doc_id)""",
    "op6_minhash_neardup": f"""
        WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.replace("coalesce(text, '')", _LOWER)} AS w FROM documents),
        i AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM i),
        c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y USING (g) WHERE x.doc_id < y.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN c ca ON ca.doc_id = a JOIN c cb ON cb.doc_id = b WHERE 100 * k >= 80 * (ca.n + cb.n - k)),
        e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
        r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
        SELECT d.doc_id, coalesce(any_value(c.n), 0) AS n_shingles, min(r.b) AS component_id, d.doc_id = min(r.b) AS kept
        FROM d JOIN r ON r.a = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id GROUP BY d.doc_id""",
    "op2_decontaminate": f"""
        WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents), b AS (SELECT item_id, {_ALNUM} AS w FROM benchmark),
        v AS (SELECT DISTINCT item_id, least(len(w), 13) AS m, array_to_string(w[i:i + 12], ' ') AS k
              FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
        l AS (SELECT DISTINCT m FROM v),
        p AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS k FROM (SELECT doc_id, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM d, l)),
        h AS (SELECT doc_id, i, m, item_id FROM p JOIN v USING (m, k)),
        n AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS j FROM h) GROUP BY doc_id),
        t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op8_host_rules": f"""
        WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
        v AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 4], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
        g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM v),
        r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM g WHERE n > 1) GROUP BY doc_id),
        l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
        f AS (SELECT d.doc_id, d.source, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(regexp_replace(d.t, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars, len(l.l) AS n_lines,
              CAST(len(d.t) - len(regexp_replace(d.t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l.l) - len(list_distinct(l.l)) AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
              FROM d JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
        b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f),
        h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed OR 100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 30 * n_lines) AS failed FROM b GROUP BY source),
        s AS (SELECT avg(failed / n) AS m, var_samp(failed / n) AS v, avg(1 / n) AS c FROM h),
        q AS (SELECT m, least(greatest(2 * m, 0.2), 0.6) AS top, CASE WHEN v > 0 AND c < 1 AND v - m * (1 - m) * c > 0 THEN least(greatest(m * (1 - m) * (1 - c) / (v - m * (1 - m) * c) - 1, 1), 1000) ELSE 1000 END AS c FROM s),
        x AS (SELECT source, n, top, c, (failed + m * c) / (n + c) AS rate FROM h, q)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(rate, 6) AS host_rate, NOT base_failed AND rate - 1.645 * sqrt(rate * (1 - rate) / (x.n + c + 1)) <= top AS kept
        FROM b JOIN x ON b.source IS NOT DISTINCT FROM x.source""",
    "op7_sharding": """
        WITH c AS (SELECT list(r ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(3988292384, x // 2) ELSE x // 2 END) AS r FROM range(256) q(i))),
        b AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS o FROM documents),
        d AS (SELECT doc_id, CAST(len(o) + 1 AS BIGINT) AS size, xor(4294967295, list_reduce(list_prepend(4294967295, o), lambda x, y: xor(x // 256, t[(xor(x % 256, y) + 1)::INT]))) AS text_crc32 FROM b, c),
        p AS (SELECT *, sum(size) OVER w - size AS before, sum(size) OVER () AS total FROM d WINDOW w AS (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING)),
        s AS (SELECT *, CAST(least((2 * before + size) * 8 // (2 * total), 7) AS INTEGER) AS shard FROM p)
        SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY before) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s""",
    "mixing_targets": f"""
        WITH d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size FROM documents),
        n AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
        w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM n),
        -- sources in order of their limit per weight: up to some place all stop at it
        r AS (SELECT *, 2 * source_size / weight AS most, sum(2.0 * source_size) OVER o - 2.0 * source_size AS held, sum(weight) OVER () - sum(weight) OVER o + weight AS open, 1.5 * sum(source_size) OVER () AS whole
              FROM w WINDOW o AS (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
        c AS (SELECT arg_min((whole - held) / open, most) FILTER (most > (whole - held) / open) AS level FROM r)
        SELECT doc_id, size, source_size, round(CASE WHEN most <= level OR level IS NULL THEN 2.0 * source_size ELSE level * weight END, 3) AS target FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source, c""",
    "personal_base": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        m AS ({matches}),
        s AS (SELECT doc_id, k, kind, m[i] AS v, CAST(coalesce(list_sum(list_transform(g[1:i], lambda x: len(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0) AS BIGINT) AS low, regexp_replace(m[i], '[^0-9]', '', 'g') AS n
              FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM m)),
        f AS (SELECT * FROM s WHERE CASE kind WHEN 'email' THEN true WHEN 'ip' THEN list_bool_and(list_transform(string_split(v, '.'), lambda p: len(ltrim(p, '0')) <= 3 AND CAST(concat('0', left(ltrim(p, '0'), 3)) AS INTEGER) <= 255))
              WHEN 'card' THEN len(n) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, len(n) + 1), lambda i: CASE WHEN (len(n) - i) % 2 = 0 THEN CAST(n[i] AS INTEGER) ELSE (2 * CAST(n[i] AS INTEGER)) // 10 + (2 * CAST(n[i] AS INTEGER)) % 10 END)) % 10 = 0
              ELSE len(n) BETWEEN 9 AND 15 END),
        a AS (SELECT doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
              string_agg(concat(kind, ':', low, ':', low + len(v)), ',' ORDER BY low, k) AS listed FROM f GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(listed, '')) AS base_sha256 FROM d LEFT JOIN a USING (doc_id)""",
    "op3_licenses": """
        WITH k AS (SELECT digest, min(license) AS license FROM (SELECT sha256({known}) AS digest, license FROM (VALUES {texts}) t(license, body) UNION ALL SELECT * FROM (VALUES {digests}) u(digest, license)) GROUP BY digest),
        l AS (SELECT doc_id, unnest(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '(?i)licen[cs]e|cc0|mozilla public'))) AS body FROM documents),
        n AS (SELECT doc_id, count(*) AS n_notices, string_agg(DISTINCT k.license, ',' ORDER BY k.license) AS notices FROM (SELECT doc_id, sha256({known}) AS digest FROM l) JOIN k USING (digest) GROUP BY doc_id),
        d AS (SELECT doc_id, sha256({whole}) AS digest FROM documents)
        SELECT d.doc_id, d.digest, k.license, coalesce(n_notices, 0) AS n_notices, coalesce(notices, '') AS notices FROM d LEFT JOIN k USING (digest) LEFT JOIN n ON n.doc_id = d.doc_id""",
}


def _personal_sql() -> str:
    from siftstone.llm.pii import KINDS

    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    parts = [f"SELECT doc_id, {k} AS k, '{kind}' AS kind, regexp_extract_all(t, '{plain[kind]}') AS m, string_split_regex(t, '{plain[kind]}') AS g FROM d" for k, kind in enumerate(KINDS, 1)]
    return ORACLES["personal_base"].replace("{matches}", " UNION ALL ".join(parts))


def _licenses_sql() -> str:
    from siftstone.llm.licenses import COPYRIGHT, DIGESTS, KNOWN, RIGHTS, SPELLINGS, notices

    def canonical(text: str) -> str:
        out = f"regexp_replace({text}, '(?m){COPYRIGHT}', ' \\1', 'g')"
        out = f"lower(regexp_replace({out}, '(?m){RIGHTS}', ' ', 'g'))"
        out = f"concat(' ', regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' ')"
        for said, meant in SPELLINGS:
            out = f"replace({out}, ' {said} ', ' {meant} ')"
        out = f"trim(regexp_replace({out}, ' +', ' ', 'g'))"
        return f"CASE WHEN {text} IS NOT NULL THEN {out} END"

    quote = lambda v: "'" + v.replace("'", "''") + "'"
    texts = ", ".join(f"({quote(name)}, {quote(body)})" for name, body in [*KNOWN, *notices()])
    digests = ", ".join(f"({quote(digest)}, {quote(name)})" for name, digest in DIGESTS)
    return ORACLES["op3_licenses"].replace("{known}", canonical("body")).replace("{whole}", canonical("text")).replace("{texts}", texts).replace("{digests}", digests)
