"""DuckDB SQL that says what an operator returns, where SQL can."""

from .url_reputation import LEAST, LIMIT, MOST, RULES, TWO_LABELS, Z

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

EXACT_DEDUP = f"""
WITH t AS (SELECT doc_id, sha256({_LOWER.format("coalesce(text, '')")}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""

_TWO = ", ".join(f"'{x}'" for x in TWO_LABELS)
_RULES = ", ".join(
    f"('{text}', '{text.partition('/')[0]}', '/{text.partition('/')[2]}', '{said}')" for text, said in RULES
)
_HOST = _LOWER.format(r"regexp_extract(url, '://([^/?#]*)', 1)")


def _prior(level: str, counts: str) -> str:
    return f"""
{level} AS (
  SELECT CASE WHEN g = 0 THEN 0.5 ELSE k / n END AS mean,
         CASE WHEN g = 0 OR k = 0 OR k = n THEN 1.0
              ELSE 1 / least({MOST}, greatest({LEAST}, CASE WHEN n - nn / n - (g - 1) > 0
                   THEN ((kk - n * (k / n) * (k / n)) / ((k / n) * (1 - k / n)) - (g - 1)) / (n - nn / n - (g - 1))
                   ELSE {LEAST} END)) - 1 END AS strength
  FROM (SELECT count(*)::DOUBLE AS g, sum(n)::DOUBLE AS n, sum(k)::DOUBLE AS k, sum(n * n)::DOUBLE AS nn,
               sum(k::DOUBLE * k::DOUBLE / n::DOUBLE) AS kk FROM {counts} WHERE n > 0))"""


URL_REPUTATION = rf"""
WITH rules(rule, of, start, said) AS (VALUES {_RULES}),
parsed AS (
  SELECT page_id, coalesce({_HOST}, '') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path,
         regexp_extract(url, '://[^/?#]*/[a-z]+/([0-9]{{1,18}})', 1) AS number
  FROM pages),
seen AS (
  SELECT host, (quality = 0 OR toxic = 1)::BIGINT AS k FROM parsed
  JOIN labels ON number <> '' AND doc_id = try_cast(number AS BIGINT)
  WHERE quality IS NOT NULL AND toxic IS NOT NULL),
hosts AS (
  SELECT *, CASE WHEN two IN ({_TWO}) THEN two ELSE last END AS suffix,
         CASE WHEN two IN ({_TWO}) AND length(array_to_string(labels3, '.')) > 0 THEN array_to_string(labels3, '.') ELSE two END AS domain
  FROM (SELECT *, array_to_string(parts[-2:], '.') AS two, parts[-1] AS last, parts[-3:] AS labels3
        FROM (SELECT host, coalesce(n, 0)::BIGINT AS n, coalesce(k, 0)::BIGINT AS k, string_split(host, '.') AS parts
              FROM (SELECT DISTINCT host FROM parsed)
              LEFT JOIN (SELECT host, count(*) AS n, sum(k) AS k FROM seen GROUP BY host) USING (host)))),
domains AS (SELECT suffix, domain, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM domains GROUP BY ALL),
{_prior("ps", "suffixes")}, {_prior("pd", "domains")}, {_prior("ph", "hosts")},
by_suffix AS (SELECT suffix, (k + strength * mean) / (n + strength) AS up FROM suffixes, ps),
by_domain AS (SELECT suffix, domain, (k + strength * up) / (n + strength) AS up
              FROM domains JOIN by_suffix USING (suffix), pd),
bounds AS (
  SELECT host, round(m - {Z} * sqrt(m * (1 - m) / (n + strength + 1)), 9) AS bound
  FROM (SELECT host, n, strength, (k + strength * up) / (n + strength) AS m
        FROM hosts JOIN by_domain USING (suffix, domain), ph))
SELECT page_id, host, path, fit.rule AS rule,
       coalesce(fit.said, CASE WHEN bound > {LIMIT} THEN 'block' ELSE 'allow' END) AS verdict
FROM parsed JOIN bounds USING (host)
LEFT JOIN LATERAL (
  SELECT rule, said FROM rules
  WHERE (parsed.host = of OR ends_with(parsed.host, '.' || of)) AND starts_with(parsed.path, start)
  ORDER BY length(rule) DESC, rule LIMIT 1) fit ON true
"""

PREFERENCE = """
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
firsts AS (SELECT conv_id, md5(role || chr(10) || text) AS code FROM turns WHERE place = 1),
dealt AS (
  SELECT *, count(*) OVER g % 2 = 1 AND conv_id = max(conv_id) OVER g AS alone FROM firsts WINDOW g AS (PARTITION BY code)),
ranks AS (SELECT conv_id, row_number() OVER (ORDER BY alone, code, conv_id) AS n FROM dealt),
pairs AS (
  SELECT conv_id, (n - 1) // 2 AS pair_id, CASE WHEN n % 2 = 1 THEN 'chosen' ELSE 'rejected' END AS side
  FROM ranks WHERE (n - 1) // 2 < (SELECT count(*) // 2 FROM ranks)),
held AS (SELECT pair_id, side, place, role, text FROM turns JOIN pairs USING (conv_id)),
breaks AS (
  SELECT pair_id, min(CASE WHEN NOT same THEN place END) AS cut
  FROM (SELECT pair_id, place, count(*) = 2 AND count(DISTINCT (role, text)) = 1 AS same FROM held GROUP BY ALL) GROUP BY ALL),
placed AS (
  SELECT pair_id, CASE WHEN coalesce(place < cut, true) THEN 'prompt' ELSE side END AS part, place AS segment, role,
         '<|' || role || '|>' || chr(10) AS head, text || '<|end|>' || chr(10) AS body
  FROM held JOIN breaks USING (pair_id) WHERE NOT coalesce(place < cut, true) OR side = 'chosen'),
laid AS (
  SELECT *, coalesce(sum(length(head) + length(body)) OVER (
    PARTITION BY pair_id, part ORDER BY segment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM placed)
SELECT pair_id, part, segment, role, head || body AS rendered, start,
       CASE WHEN part <> 'prompt' AND role = 'assistant' THEN start + length(head) END AS mask_from,
       CASE WHEN part <> 'prompt' AND role = 'assistant' THEN start + length(head) + length(body) END AS mask_to
FROM laid
"""

_FAILS = {"A": 1, "B": 2, "C": 4, "D": 8, "E": 16}
_ORDER = " || ".join(f"f{i}.f" for i in range(1, 6))

#: Masks of failed filters a document, then every order walked step by step.
FILTER_AUDIT = rf"""
WITH letters AS (SELECT * FROM (VALUES {", ".join(f"('{f}', {b})" for f, b in _FAILS.items())}) v(f, bit)),
orders AS (
  SELECT {_ORDER} AS filter_order, [{", ".join(f"f{i}.bit" for i in range(1, 6))}] AS bits
  FROM letters f1, letters f2, letters f3, letters f4, letters f5
  WHERE f1.bit + f2.bit + f3.bit + f4.bit + f5.bit = 31 AND len(list_distinct([f1.bit, f2.bit, f3.bit, f4.bit, f5.bit])) = 5
),
steps AS (
  SELECT filter_order, step, bits[step] AS bit, list_sum(bits[1:step])::INT - bits[step] AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
),
texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least
  FROM documents
),
marked AS (
  SELECT part,
    CASE WHEN len(words) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * len(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > least THEN 16 ELSE 0 END AS mask,
    doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS toxic
  FROM texts
),
counted AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS t FROM marked GROUP BY ALL),
walked AS (
  SELECT part, filter_order, step, bit,
    coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before <> 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(g) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS good_lost,
    coalesce(sum(t) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost
  FROM counted, steps GROUP BY ALL
)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM walked
"""
