"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from .bpe_tree import op6_bpe_round_trip
from .embedding_dedup import op8_embedding_dedup
from .exchange import read
from .interpolation import op10_lm_scoring, score_texts
from .language_id import op5_language_id
from .licenses import PHRASES, TEMPLATES, op7_license_scan
from .order_minhash import op1_order_minhash
from .string_tiling import op4_string_tiling
from .suffix_array import op9_suffix_array_dedup
from .suffix_tree import op3_substring_dedup
from .url_filter import RULES, op2_url_filter

_FUNCTIONS = (op1_order_minhash, op2_url_filter, op3_substring_dedup, op4_string_tiling, op5_language_id, op6_bpe_round_trip, op7_license_scan, op8_embedding_dedup, op9_suffix_array_dedup, op10_lm_scoring)


def url_rules(spark, sf_dir):
    """What op2 decides without its models."""
    return op2_url_filter(spark, sf_dir).select("page_id", "host", "path", "rule")


def lm_base(spark, sf_dir):
    """The exact columns of LM scoring, learned from six documents of seven by id."""
    found = score_texts(read(spark, sf_dir, "documents").select("doc_id", "text"), F.col("doc_id") % 7 != 2)
    return found.select("doc_id", *[F.col(f"lm_{c}").alias(c) for c in ("n_tokens", "n_known", "train_tokens")], F.round("lm_base_score", 4).alias("base_score"))


QUERIES = {f.__name__: f for f in (*_FUNCTIONS, url_rules, lm_base)}


def _template_expression(markup: str) -> str:
    """A template as a regular expression over words that are each followed by a space."""
    out = " "
    for token in re.findall(r"\[\[|\]\]|<<\w+:\d+-\d+>>|[^\s\[\]<>]+", markup):
        if token == "[[":
            out += "("
        elif token == "]]":
            out += ")?"
        elif token.startswith("<<"):
            least, most = re.findall(r"\d+", token)[-2:]
            out += f"([^ ]+ ){{{least},{most}}}"
        else:
            out += token.lower() + " "
    return out


def _license_sql() -> str:
    places = " || ".join(f"list_filter(range(len(w)), lambda i: {' AND '.join(f'w[i + {k + 1}] = {word!r}' for k, word in enumerate(p.split()))})" for p, _ in PHRASES)
    base = ", ".join(f"CASE WHEN contains(s, ' {p} ') THEN '{label}' END" for p, label in PHRASES)
    own = ", ".join(f"CASE WHEN regexp_matches(s, '{_template_expression(t)}') THEN '{label}' END" for label, t in TEMPLATES)
    said = lambda x: f"array_to_string(list_sort(list_distinct(list_filter({x}, lambda l: l IS NOT NULL))), ',')"
    return f"""WITH a AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
    b AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS s FROM a),
    c AS (SELECT doc_id, w, {places} AS p, [{base}] AS b, [{own}] AS o FROM b)
    SELECT doc_id, len(w) AS n_words, len(p) AS n_base, list_min(p) AS first_word, list_max(p) AS last_word, {said('b')} AS base_labels, {said('b || o')} AS labels,
    CASE WHEN len(list_filter(o, lambda l: l IS NOT NULL)) > 0 THEN 1.0 WHEN len(p) > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score FROM c"""


def _rules_sql() -> str:
    tests = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}') THEN '{h}/{p}'" for h, _, p in sorted((r.partition("/") for r, _ in RULES), key=lambda x: -len("".join(x))))
    return f"""WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r)
    SELECT page_id, host, path, CASE {tests} END AS rule FROM h"""


ORACLE_SQL: dict[str, str] = {
    "url_rules": _rules_sql(),
    "lm_base": r"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    t AS (SELECT doc_id, unnest(list_append(w, '')) AS t FROM d),
    c AS (SELECT t, count(*) AS c FROM t WHERE doc_id % 7 <> 2 GROUP BY t),
    n AS (SELECT sum(c) AS n, count(*) AS v FROM c)
    SELECT doc_id, count(*) AS n_tokens, count(c) AS n_known, max(n)::BIGINT AS train_tokens, round(sum(log10((coalesce(c, 0) + 1) / (n + v + 1))), 4) AS base_score FROM t LEFT JOIN c USING (t) CROSS JOIN n GROUP BY doc_id""",
    "op3_substring_dedup": r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS i, w FROM d WHERE len(w) >= 35),
    k AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS k FROM s),
    r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM k WHERE k IN (SELECT k FROM k GROUP BY k HAVING count(*) > 1)),
    t AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
    o AS (SELECT t.doc_id, coalesce(string_agg(word, ' ' ORDER BY t.p), '') AS kept FROM t ANTI JOIN r ON r.doc_id = t.doc_id AND r.p = t.p GROUP BY t.doc_id)
    SELECT d.doc_id, len(w)::BIGINT AS n_words, (SELECT count(*) FROM r WHERE r.doc_id = d.doc_id) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN o ON o.doc_id = d.doc_id""",
    "op7_license_scan": _license_sql(),
    "op8_embedding_dedup": """WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
    l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM e a JOIN e b ON a.vec_id <> b.vec_id AND list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.95),
    r AS (SELECT vec_id AS x, vec_id AS y FROM e UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
    SELECT vec_id, (SELECT count(*) FROM l WHERE l.x = vec_id) AS n_links, m AS component_id, m = vec_id AS kept FROM e JOIN (SELECT x, min(y) AS m FROM r GROUP BY x) ON x = vec_id""",
    "op9_suffix_array_dedup": """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    s AS (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d WHERE length(h) >= 100),
    k AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS k FROM s),
    f AS (SELECT k, min(doc_id) AS m FROM k GROUP BY k HAVING min(doc_id) < max(doc_id)),
    r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM k JOIN f USING (k) WHERE m < doc_id),
    n AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (WHERE before IS DISTINCT FROM p - 1) AS n_spans FROM (SELECT *, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM r) GROUP BY doc_id),
    t AS (SELECT doc_id, h, unnest(range(0, length(h) // 2)) AS p FROM d WHERE doc_id IN (SELECT doc_id FROM n)),
    o AS (SELECT t.doc_id, coalesce(string_agg(substr(h, 2 * t.p + 1, 2), '' ORDER BY t.p), '') AS kept FROM t ANTI JOIN r ON r.doc_id = t.doc_id AND r.p = t.p GROUP BY t.doc_id)
    SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(CASE WHEN n_removed IS NULL THEN h ELSE coalesce(kept, '') END)) AS kept_sha256
    FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN o ON o.doc_id = d.doc_id""",
}
