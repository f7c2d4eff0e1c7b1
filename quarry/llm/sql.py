"""DuckDB SQL of the registered queries that SQL can express.

Language ID, BPE, fuzzy lines, compression scores, vector bin packing, and bin completion have none: they are tested against
the library, brute force and held-out labels.
"""

from __future__ import annotations

from quarry.llm import rules, urls

LINKED = """, edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links), reach AS (SELECT DISTINCT a AS node, a AS root FROM edges UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.node),
 parts AS (SELECT node, min(root) AS component FROM reach GROUP BY 1)"""

NEAR = r"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
 shingles AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(2, len(w) - 3)), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) AS s FROM words WHERE len(w) > 0),
 size AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
 links AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2)
  JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k))""" + LINKED + """
 SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component, d.doc_id) AS component_id, coalesce(component, d.doc_id) = d.doc_id AS kept
 FROM documents d LEFT JOIN size z ON z.doc_id = d.doc_id LEFT JOIN parts ON node = d.doc_id"""

VECTORS = """WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
 links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id < y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= 0.98)""" + LINKED + """,
 n AS (SELECT a, count(*) AS n FROM edges GROUP BY 1)
 SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component, vec_id) AS component_id, coalesce(component, vec_id) = vec_id AS kept
 FROM embeddings LEFT JOIN n ON a = vec_id LEFT JOIN parts ON node = vec_id"""


def _distance(p: str, q: str) -> str:
    """Jensen-Shannon distance of two lists of shares."""
    part = "CASE WHEN {x} > 0 THEN {x} * log2({x} / ((z[1] + z[2]) / 2)) ELSE 0 END"
    return f"sqrt(greatest(0, list_sum(list_transform(list_zip({p}, {q}), lambda z: {part.format(x='z[1]')} + {part.format(x='z[2]')})) / 2))"


def _rules() -> str:
    classes = [f"(length(t) - length(regexp_replace(t, '{c}', '', 'g')))" for c in rules.CLASSES]
    rest = "length(t) - " + " - ".join(classes)
    n = len(classes) + 1
    shares = ", ".join(f"sum(c[{i}]) / sum(list_sum(c))" for i in range(1, n + 1))
    return rf"""WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents), w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, [{', '.join(classes)}, {rest}] AS c FROM d),
 g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2])) AS s FROM w WHERE len(w) >= 3),
 r AS (SELECT doc_id, i FROM g JOIN (SELECT doc_id, s FROM g GROUP BY 1, 2 HAVING count(*) > 1) USING (doc_id, s)),
 rep AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM r, range(3) q(o) GROUP BY 1),
 l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d), dup AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM l WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY 1),
 base AS (SELECT w.doc_id, lang, w, c, length(t) AS len, CAST(len(w) AS BIGINT) AS n_words, CAST(list_sum(list_transform(w, lambda x: length(x))) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id)),
 lw AS (SELECT lang, unnest(w) AS word FROM base WHERE lang IS NOT NULL), lc AS (SELECT lang, word, count(*) AS n FROM lw GROUP BY 1, 2), la AS (SELECT lang, sum(n) AS al FROM lc GROUP BY 1),
 top AS (SELECT lang, list(word ORDER BY n DESC, word) AS common, list(n ORDER BY n DESC, word) AS ns FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS k FROM lc) WHERE k <= {rules.COMMON} GROUP BY 1),
 ref AS (SELECT lang, common, list_concat([(al - list_sum(ns)) / al], list_transform(ns, lambda x: x / al)) AS share FROM top JOIN la USING (lang)),
 cls AS (SELECT lang, [{shares}] AS class_share FROM base WHERE lang IS NOT NULL GROUP BY 1),
 j AS (SELECT b.*, share, class_share, list_transform(common, lambda x: len(list_filter(w, lambda y: y = x)) / n_words) AS mine FROM base b LEFT JOIN ref USING (lang) LEFT JOIN cls USING (lang)),
 far AS (SELECT *, CASE WHEN n_words >= {rules.LEAST_WORDS} AND share IS NOT NULL THEN {_distance('list_concat([1 - list_sum(mine)], mine)', 'share')} ELSE 0 END AS wd,
  CASE WHEN len >= {rules.LEAST_CHARACTERS} AND class_share IS NOT NULL THEN {_distance('list_transform(c, lambda x: x / len)', 'class_share')} ELSE 0 END AS cd, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM j)
 SELECT doc_id, n_words, coalesce(word_chars, 0) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 NOT base_failed AND wd <= {rules.MOST_WORD_DISTANCE} AND cd <= {rules.MOST_CLASS_DISTANCE} AS kept FROM far"""


def _urls() -> str:
    def weight(level: str) -> str:
        low, high = urls.WEIGHTS
        return f"""(SELECT coalesce(CASE WHEN x <= 0 THEN {high} ELSE least(greatest((1 - x) / x, {low}), {high}) END, {high}) FROM (SELECT
 (sum(n * (bad / n - prior) * (bad / n - prior)) - sum(prior * (1 - prior))) / nullif(sum(n * prior * (1 - prior)), 0) AS x FROM {level} WHERE n > 0))"""

    second = "|".join(urls.SECOND)
    rule = " ".join(
        f"WHEN (host = '{on}' OR ends_with(host, '.{on}')) AND starts_with(path, '{start}') THEN '{verdict} {on}{start}'"
        for verdict, on, start in sorted(urls.RULES, key=lambda r: -len(r[1] + r[2]))
    )
    return rf"""WITH p AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{urls.UPPER}', '{urls.LOWER}'), '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
 q AS (SELECT *, TRY_CAST(nullif(regexp_extract(path, '{urls.NUMBER}', 1), '') AS BIGINT) AS doc_id FROM p),
 marked AS (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY 1), trials AS (SELECT host, CASE WHEN quality IN (0, 1) THEN 1 - quality END AS bad FROM q LEFT JOIN marked USING (doc_id)),
 h0 AS (SELECT host, CAST(count(bad) AS DOUBLE) AS n, coalesce(sum(bad), 0) AS bad, CASE WHEN regexp_extract(host, '((?:[^.]*\.)?(?:{second})\.[a-z]{{2}})$', 1) <> '' THEN regexp_extract(host, '((?:[^.]*\.)?(?:{second})\.[a-z]{{2}})$', 1)
  ELSE regexp_extract(host, '((?:[^.]*\.)?[^.]*)$', 1) END AS domain, CASE WHEN regexp_extract(host, '(?:^|\.)((?:{second})\.[a-z]{{2}})$', 1) <> '' THEN regexp_extract(host, '(?:^|\.)((?:{second})\.[a-z]{{2}})$', 1)
  ELSE regexp_extract(host, '([^.]*)$', 1) END AS suffix FROM trials GROUP BY 1),
 d0 AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h0 GROUP BY 1, 2), s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d0 GROUP BY 1),
 s1 AS (SELECT *, (SELECT (sum(bad) + {urls.PRIOR * urls.PRIOR_WEIGHT}) / (sum(n) + {urls.PRIOR_WEIGHT}) FROM s0) AS prior FROM s0), s AS (SELECT *, {weight('s1')} AS w FROM s1),
 d1 AS (SELECT d0.*, (s.bad - d0.bad + s.w * s.prior) / (s.n - d0.n + s.w) AS prior FROM d0 JOIN s USING (suffix)), d AS (SELECT *, {weight('d1')} AS w FROM d1),
 h1 AS (SELECT h0.*, (d.bad - h0.bad + d.w * d.prior) / (d.n - h0.n + d.w) AS prior FROM h0 JOIN d USING (domain)), h AS (SELECT *, {weight('h1')} AS w FROM h1),
 m AS (SELECT host, n, w, (bad + w * prior) / (n + w) AS mean FROM h), b AS (SELECT host, mean - {urls.Z} * sqrt(mean * (1 - mean) / (n + w + 1)) AS bound FROM m),
 r AS (SELECT *, CASE {rule} END AS r FROM p)
 SELECT page_id, host, path, split_part(r, ' ', 2) AS rule, coalesce(split_part(r, ' ', 1), CASE WHEN bound > {urls.BLOCK_ABOVE} THEN 'block' ELSE 'allow' END) AS verdict, round(bound, 6) AS bound FROM r LEFT JOIN b USING (host)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_multi_index_minhash": NEAR,
        "op6_divergence_rules": _rules(),
        "op7_url_reputation": _urls(),
        "op10_pruned_graph": VECTORS,
    }
