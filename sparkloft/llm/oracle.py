"""DuckDB SQL for the queries of this folder that SQL can express."""

from __future__ import annotations

from sparkloft.llm import decontaminate
from sparkloft.llm.secret_scans import BASE_KINDS, RULES
from sparkloft.llm.url_filters import RULES as URL_RULES, TWO_LABEL_SUFFIXES


def url_filters_sql(max_bad: float = 0.5, z: float = 1.645) -> str:
    """Rules by length, then posterior bounds from host to domain to suffix to the whole."""
    two = ", ".join(f"'{s}'" for s in TWO_LABEL_SUFFIXES)
    fits = [
        (f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v)
        for h, p, v in sorted(URL_RULES, key=lambda r: (-len(r[0] + r[1]), r))
    ]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{n}'" for f, n, _ in fits) + " END"
    verdict = "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for f, _, v in fits) + " END"

    def labels(n: int) -> str:
        return f"array_to_string(list_reverse(list_slice(list_reverse(string_split(plain, '.')), 1, {n})), '.')"

    def strength(rows: str, key: str, mean: str) -> str:
        return f"""(SELECT {key}, least(greatest(m * (1 - m) / greatest(spread - m * (1 - m) * k / n, 1e-6) - 1, 2), 1000) AS strength FROM (
            SELECT {key}, any_value({mean}) AS m, sum(pages * (bad / pages - {mean}) ** 2) / sum(pages) AS spread, count(*) AS k, sum(pages) AS n
            FROM {rows} WHERE pages > 0 GROUP BY {key}))"""

    return f"""
    WITH cut AS (SELECT page_id, html, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, regexp_replace(html, '<[^<>]*>', ' ', 'g') AS shown FROM pages),
      judged AS (SELECT *, CAST(coalesce(length(shown) - length(translate(shown, '*$%&#!|', '')) > length(shown) / 50, FALSE) AS INT) AS outcome FROM cut),
      hosts0 AS (SELECT host, count(outcome) AS pages, coalesce(sum(CAST(outcome AS DOUBLE)), 0) AS bad, regexp_replace(host, '(:[0-9]*|\\.)$', '') AS plain FROM judged GROUP BY host),
      hosts1 AS (SELECT host, pages, bad, CASE WHEN {labels(2)} IN ({two}) THEN {labels(3)} ELSE {labels(2)} END AS domain,
        CASE WHEN {labels(2)} IN ({two}) THEN {labels(2)} ELSE {labels(1)} END AS suffix FROM hosts0),
      domains0 AS (SELECT domain, suffix, sum(pages) AS pages, sum(bad) AS bad FROM hosts1 GROUP BY ALL),
      suffixes0 AS (SELECT suffix, 1 AS every, sum(pages) AS pages, sum(bad) AS bad FROM domains0 GROUP BY ALL),
      suffixes1 AS (SELECT *, (SELECT (sum(bad) + 1) / (sum(pages) + 2) FROM suffixes0) AS up FROM suffixes0),
      suffixes2 AS (SELECT suffix, (bad + coalesce(strength, 2) * up) / (pages + coalesce(strength, 2)) AS up FROM suffixes1 LEFT JOIN {strength("suffixes1", "every", "up")} USING (every)),
      domains1 AS (SELECT * FROM domains0 JOIN suffixes2 USING (suffix)),
      domains2 AS (SELECT domain, suffix, (bad + coalesce(strength, 2) * up) / (pages + coalesce(strength, 2)) AS up FROM domains1 LEFT JOIN {strength("domains1", "suffix", "up")} USING (suffix)),
      hosts2 AS (SELECT * FROM hosts1 JOIN domains2 USING (domain, suffix)),
      hosts3 AS (SELECT host, bad + coalesce(strength, 2) * up AS a, pages + coalesce(strength, 2) AS n FROM hosts2 LEFT JOIN {strength("hosts2", "domain", "up")} USING (domain)),
      known AS (SELECT host, a / n AS rate, sqrt((a / n) * (1 - a / n) / (n + 1)) AS sd FROM hosts3)
    SELECT page_id, host, path, {rule} AS rule, coalesce({verdict}, CASE WHEN greatest(rate - {z} * sd, 0) > {max_bad} THEN 'block' ELSE 'allow' END) AS verdict,
      round(rate, 6) AS bad_rate, round(greatest(rate - {z} * sd, 0), 6) AS lower, round(least(rate + {z} * sd, 1), 6) AS upper
    FROM judged JOIN known USING (host)"""


def secret_scans_sql() -> str:
    """Spans from the gaps between matches, as lists by kind, put in order."""

    def either_case(pattern: str) -> str:
        if "(?i:" not in pattern:
            return pattern
        head, rest = pattern.split("(?i:", 1)
        words, tail = rest.split(")", 1)
        return head + "(?:" + "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in words) + ")" + tail

    parts = []
    for no, (kind, pattern, group, least) in enumerate(RULES):
        begin = "(?<![A-Za-z0-9_-])"  # no such thing here: what stands before is matched too, and left out of the span
        lead = "length(found[i]) - length(kept[i])" if pattern.startswith(begin) else "0"
        pattern, group = (f"(?:^|[^A-Za-z0-9_-])({pattern.removeprefix(begin)})", 1) if lead != "0" else (pattern, group)
        p = either_case(pattern).replace("'", "''")
        parts.append(f"""
          SELECT doc_id, {no} AS no, '{kind}' AS kind, start, start + size AS stop FROM (SELECT doc_id,
            list_sum(list_transform(list_slice(gaps, 1, i), lambda g: length(g))) + coalesce(list_sum(list_transform(list_slice(found, 1, i - 1), lambda m: length(m))), 0) + {lead} AS start,
            length(found[i]) - ({lead}) AS size, length(kept[i]) AS counts
            FROM (SELECT doc_id, gaps, found, kept, unnest(range(1, len(found) + 1)) AS i FROM (SELECT doc_id, string_split_regex(body, '{p}') AS gaps,
              regexp_extract_all(body, '{p}', 0) AS found, regexp_extract_all(body, '{p}', {group}) AS kept FROM texts WHERE regexp_matches(body, '{p}')))) WHERE counts >= {least}""")
    base = ", ".join(f"'{k}'" for k in BASE_KINDS)
    written = "string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, no)"
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in BASE_KINDS)
    return f"""
    WITH texts AS (SELECT doc_id, coalesce(text, '') AS body FROM documents), found AS ({" UNION ALL ".join(parts)}),
      summed AS (SELECT doc_id, {counts}, {written} AS spans, {written.replace(" ORDER BY start, no)", f" ORDER BY start, no) FILTER (WHERE kind IN ({base}))")} AS base FROM found GROUP BY doc_id)
    SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
      sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, sha256(body) AS blob
    FROM texts t LEFT JOIN summed s ON t.doc_id = s.doc_id"""


def decontamination_sql() -> str:
    """Windows of templates as text, joined; pairs of slot values by alignment."""
    d = decontaminate
    end, token, units = d.SENTENCE_END.replace("'", "''"), d.TOKEN.replace(d.BEGIN, "\\x02"), ", ".join(f"'{u}'" for u in d.UNITS)
    words = ", ".join(f"'{w}'" for w in d.NUMBER_WORDS)
    digit = "(substring(ltrim({0}, chr(2)), 1, 1) BETWEEN '0' AND '9' OR lower(ltrim({0}, chr(2))) IN (" + words + "))"
    name = f"NOT {digit.format('theirs')} AND theirs NOT IN ({units})"
    slot = f"IN ('{d.NUMBER}', '{d.UNIT}', '{d.NAME}')"
    return f"""
    WITH texts AS (SELECT 'd' AS side, doc_id AS id, text FROM documents WHERE text IS NOT NULL UNION ALL SELECT 'b', item_id, text FROM benchmark),
      raws AS (SELECT side, id, regexp_extract_all(chr(2) || regexp_replace(coalesce(text, ''), '{end}', ' ' || chr(2), 'g'), '{token}') AS raw FROM texts WHERE id IS NOT NULL),
      lists AS (SELECT side, id, raw, list_transform(raw, lambda t, i: CASE WHEN {digit.format("t")} THEN '{d.NUMBER}'
          WHEN i > 1 AND {digit.format("raw[i - 1]")} AND lower(ltrim(t, chr(2))) IN ({units}) THEN '{d.UNIT}'
          WHEN NOT starts_with(t, chr(2)) AND t <> lower(t) AND length(t) > 1 AND substring(t, 2) = substring(lower(t), 2) THEN '{d.NAME}'
          ELSE lower(ltrim(t, chr(2))) END) AS words FROM raws),
      starts AS (SELECT side, id, words, raw, unnest(range(1, len(words) - {d.WORDS - 2})) AS p FROM lists),
      cut AS (SELECT side, id, p - 1 AS pos, words[p : p + {d.WORDS - 1}] AS part, CASE WHEN side = 'b' THEN lower(replace(array_to_string(raw[p : p + {d.WORDS - 1}], ' '), chr(2), '')) END AS low FROM starts),
      windows AS (SELECT side, id, pos, low, array_to_string(part, ' ') AS body, len(list_filter(part, lambda w: w {slot})) AS slots FROM cut),
      every AS (SELECT DISTINCT id AS item_id, pos AS item_pos, body, slots, CASE WHEN slots <= {d.MOST_SLOTS} THEN body ELSE low END AS base FROM windows WHERE side = 'b'),
      shared AS (SELECT base, count(DISTINCT item_id) > {d.SHARED_ITEMS} AS common FROM every GROUP BY base),
      marked AS (SELECT every.*, common, bool_and(common) OVER (PARTITION BY item_id) AS whole FROM every JOIN shared USING (base)),
      items0 AS (SELECT item_id, item_pos, body, slots, whole FROM marked WHERE slots <= {d.MOST_SLOTS} AND (whole OR NOT common)),
      items AS (SELECT * FROM items0 JOIN (SELECT item_id, count(DISTINCT item_pos) AS item_windows, max(slots) > 0 AS slotted FROM items0 GROUP BY 1) USING (item_id)),
      found AS (SELECT w.id AS doc_id, item_id, pos - item_pos AS shift, count(DISTINCT item_pos) AS windows, min(pos) AS first_pos, max(pos) AS last_pos,
          any_value(item_windows) AS item_windows, any_value(slotted) AS slotted, any_value(whole) AS whole FROM windows w JOIN items USING (body) WHERE side = 'd' GROUP BY ALL),
      places AS (SELECT doc_id, item_id, shift, unnest(range(first_pos - shift + 1, last_pos - shift + {d.WORDS + 1})) AS i FROM found WHERE slotted),
      pairs AS (SELECT DISTINCT doc_id, item_id, shift, lower(ltrim(b.raw[i], chr(2))) AS theirs, lower(ltrim(o.raw[i + shift], chr(2))) AS ours
          FROM places JOIN lists b ON b.side = 'b' AND b.id = item_id JOIN lists o ON o.side = 'd' AND o.id = doc_id WHERE b.words[i] {slot}),
      values_ AS (SELECT doc_id, item_id, shift, count(*) AS slots, count(*) FILTER (WHERE theirs IS DISTINCT FROM ours) AS varied,
          count(DISTINCT theirs) = count(*) AND count(DISTINCT ours) FILTER (WHERE {name}) = count(*) FILTER (WHERE {name}) AS consistent FROM pairs GROUP BY ALL),
      judged AS (SELECT f.*, coalesce(v.slots, 0) AS slots, coalesce(v.varied, 0) AS varied, coalesce(v.consistent, TRUE) AS consistent
          FROM found f LEFT JOIN values_ v USING (doc_id, item_id, shift)),
      best AS (SELECT * FROM judged QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY consistent DESC, windows DESC, varied, shift) = 1)
    SELECT doc_id, item_id, windows, item_windows, windows / item_windows AS share, slots, varied,
      CASE WHEN NOT consistent THEN 'inconsistent' WHEN varied > 0 THEN 'reparameterised' ELSE 'verbatim' END AS kind,
      consistent AND CASE WHEN whole THEN windows >= item_windows ELSE windows >= {d.LEAK_WINDOWS} OR windows / item_windows >= {d.LEAK_SHARE} END AS contaminated FROM best"""


def exact_dedup_sql() -> str:
    """Texts without white space, as the key of windows."""
    return """
    WITH texts AS (SELECT doc_id, length(coalesce(text, '')) AS size, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g') AS body FROM documents),
      judged AS (SELECT doc_id, body, first_value(doc_id) OVER (PARTITION BY body ORDER BY size DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size FROM texts)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM judged"""


def hard_negatives_sql(positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> str:
    """All products of anchors and rows, as doubles, in which they are exact."""
    return f"""
    WITH rows AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x
        FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
      scores AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS other, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score
        FROM rows a JOIN rows b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
      near AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM scores WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= {positives})
    SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank, other AS negative_id,
      positive_score, score AS negative_score FROM near JOIN scores USING (anchor_id)
    WHERE NOT same AND {low} * positive_score <= 100 * score AND 100 * score <= {high} * positive_score
    QUALIFY rank <= {negatives}"""


ORACLE_SQL = {"op11_exact_dedup": exact_dedup_sql(), "op12_hard_negatives": hard_negatives_sql(), "op2_decontamination": decontamination_sql(), "op3_url_filters": url_filters_sql(), "op5_secret_scans": secret_scans_sql()}
