"""Registered queries of this subpackage. SQL can express none of the ten whole; their tests hold them against brute force. What SQL
can say of them (base columns, rules, counts) stands as queries of its own, with the SQL."""

from loomspan.llm.decontaminate import op2_template_decontamination
from loomspan.llm.html_extract import op10_html_extract
from loomspan.llm.lang_id import op5_lang_id
from loomspan.llm.ordinal_quality import op1_ordinal_quality
from loomspan.llm.packing import op3_best_fit_packing
from loomspan.llm.pii import op6_pii
from loomspan.llm.quality_rules import op9_quality_rules
from loomspan.llm.simhash import op8_simhash
from loomspan.llm.suffix_dedup import op4_suffix_dedup
from loomspan.llm.url_filter import op7_url_filter

QUERIES = {
    f.__name__: f
    for f in (
        op1_ordinal_quality,
        op2_template_decontamination,
        op3_best_fit_packing,
        op4_suffix_dedup,
        op5_lang_id,
        op6_pii,
        op7_url_filter,
        op8_simhash,
        op9_quality_rules,
        op10_html_extract,
    )
}



def quality_base(spark, sf_dir: str):
    """The columns of op9 that need no model."""
    return op9_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def url_rules(spark, sf_dir: str):
    """Host, path and rule of op7, with the verdicts that rules give."""
    return op7_url_filter(spark, sf_dir).selectExpr("page_id", "host", "path", "rule", "CASE WHEN rule IS NOT NULL THEN verdict END AS rule_verdict")


def pii_counts(spark, sf_dir: str):
    """The counts of op6."""
    return op6_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


QUERIES |= {f.__name__: f for f in (quality_base, url_rules, pii_counts)}

ORACLES: dict[str, str] = {
    "quality_base": r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        one AS (SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS x FROM d),
        win AS (SELECT doc_id, i, concat_ws(' ', x, lead(x, 1) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o, lead(x, 4) OVER o) AS k, lead(x, 4) OVER o AS e FROM one WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
        twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM win WHERE e IS NOT NULL) y WHERE n > 1),
        rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM twice) z GROUP BY doc_id),
        m AS (SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
            [l FOR l IN string_split(t, chr(10)) IF regexp_matches(l, '[^\x20\x09-\x0D]')] AS lines, coalesce(rep.n, 0) AS n_repeat_words FROM d LEFT JOIN rep USING (doc_id))
        SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
            CAST(n_repeat_words AS BIGINT) AS n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m""",
    "url_rules": r"""WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS x FROM pages),
        p AS (SELECT page_id, translate(regexp_extract(x, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, CASE WHEN strpos(x, '/') > 0 THEN substr(x, strpos(x, '/')) ELSE '' END AS path FROM r),
        q AS (SELECT *, CASE WHEN regexp_matches(host, '(^|\.)example\.com$') AND starts_with(path, '/en/7') THEN 'example.com/en/7' WHEN regexp_matches(host, '(^|\.)example\.net$') AND starts_with(path, '/de/8') THEN 'example.net/de/8'
            WHEN regexp_matches(host, '(^|\.)com$') AND starts_with(path, '/en/') THEN 'com/en/' WHEN regexp_matches(host, '(^|\.)net$') AND starts_with(path, '/de/') THEN 'net/de/' WHEN regexp_matches(host, '(^|\.)org$') AND starts_with(path, '/es/') THEN 'org/es/' END AS rule FROM p)
        SELECT page_id, host, path, rule, CASE WHEN rule = 'example.com/en/7' THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS rule_verdict FROM q""",
    "pii_counts": r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        c AS (SELECT doc_id, [regexp_replace(x, '[^0-9]', '', 'g') FOR x IN regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+')] AS cards FROM d),
        u AS (SELECT doc_id, generate_subscripts(cards, 1) AS k, unnest(cards) AS x FROM c),
        v AS (SELECT doc_id, k, length(x) AS n, unnest(range(1, length(x) + 1)) AS i, x FROM u WHERE length(x) BETWEEN 13 AND 19),
        w AS (SELECT doc_id, k, sum(CASE WHEN (n - i) % 2 = 0 THEN CAST(substr(x, i, 1) AS INT) ELSE (2 * CAST(substr(x, i, 1) AS INT)) // 10 + (2 * CAST(substr(x, i, 1) AS INT)) % 10 END) AS s FROM v GROUP BY doc_id, k),
        l AS (SELECT doc_id, count(*) AS n FROM w WHERE s % 10 = 0 GROUP BY doc_id)
        SELECT doc_id, CAST(len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) AS BIGINT) AS n_email,
            CAST(len([x FOR x IN regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') IF NOT regexp_matches(x, '(^|\.)0*([3-9][0-9][0-9]|2[6-9][0-9]|25[6-9]|[1-9][0-9]{3,})(\.|$)')]) AS BIGINT) AS n_ip,
            CAST(coalesce(l.n, 0) AS BIGINT) AS n_card,
            CAST(len([x FOR x IN regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]') IF length(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 9 AND 15]) AS BIGINT) AS n_phone FROM d LEFT JOIN l USING (doc_id)""",
}
