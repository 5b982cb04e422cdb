"""SQL for the queries of this package that SQL can express."""

from __future__ import annotations

from tidewatch.llm import licenses, mixing, phrases, quality, rollup
from tidewatch.llm.license_rules import CONFIDENCE, rules

SPACE = "\\x20\\x09-\\x0D"

_QUALITY = rf"""
d AS (
  SELECT row_number() OVER () AS rid, *, coalesce(text, '') AS t FROM {{docs}}
), s AS (
  SELECT *, regexp_extract_all(t, '[^{SPACE}]+') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{SPACE}]')) AS ls
  FROM d
), win AS (
  SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS w
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM s WHERE len(ws) >= 8)
), rep AS (
  SELECT rid, count(DISTINCT i + k) AS n_repeat_words
  FROM (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, w) > 1),
       (SELECT unnest(range(0, 8)) AS k)
  GROUP BY rid
), st AS (
  SELECT s.rid, doc_id, text, lang, source, n_chars, len(ws)::BIGINT AS n_words,
         length(array_to_string(ws, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM s LEFT JOIN rep USING (rid)
), ra AS (
  SELECT *, n_symbols * 1000 // greatest(word_chars, 1) AS symbol_ratio,
         n_dup_lines * 1000 // (n_lines + {quality.SMOOTH}) AS dup_line_ratio,
         word_chars * 100 // greatest(n_words, 1) AS word_length
  FROM st
), lng AS (
  UNPIVOT (SELECT lang, source, symbol_ratio, dup_line_ratio, word_length FROM ra WHERE n_words > 0)
  ON symbol_ratio, dup_line_ratio, word_length INTO NAME ratio VALUE v
), bk AS (
  SELECT lang, source, ratio, (v >> greatest(length(bin(v)) - 6, 0)) << greatest(length(bin(v)) - 6, 0) AS low FROM lng
), own AS (
  SELECT lang, source, ratio, quantile_disc(low, 0.25) AS q25, quantile_disc(low, 0.75) AS q75, count(*) AS m
  FROM bk GROUP BY ALL
), la AS (
  SELECT lang, ratio, quantile_disc(low, 0.25) AS q25, quantile_disc(low, 0.75) AS q75, count(*) AS m FROM bk GROUP BY ALL
), al AS (
  SELECT ratio, quantile_disc(low, 0.25) AS q25, quantile_disc(low, 0.75) AS q75 FROM bk GROUP BY ALL
), pick AS (
  SELECT own.lang, own.source, own.ratio,
         CASE WHEN own.m >= {quality.MIN_GROUP} THEN own.q25 WHEN la.m >= {quality.MIN_GROUP} THEN la.q25 ELSE al.q25 END AS q25,
         CASE WHEN own.m >= {quality.MIN_GROUP} THEN own.q75 WHEN la.m >= {quality.MIN_GROUP} THEN la.q75 ELSE al.q75 END AS q75
  FROM own JOIN la ON own.lang IS NOT DISTINCT FROM la.lang AND own.ratio = la.ratio JOIN al ON own.ratio = al.ratio
), fence AS (
  SELECT lang, source,
         max(q75 + {quality.SPREAD} * (q75 - q25) + {quality.SLACK['symbol_ratio']}) FILTER (ratio = 'symbol_ratio') AS max_s,
         max(q75 + {quality.SPREAD} * (q75 - q25) + {quality.SLACK['dup_line_ratio']}) FILTER (ratio = 'dup_line_ratio') AS max_d,
         max(q75 + {quality.SPREAD} * (q75 - q25) + {quality.SLACK['word_length']}) FILTER (ratio = 'word_length') AS max_w,
         max(q25 - {quality.SPREAD} * (q75 - q25) - {quality.SLACK['word_length']}) FILTER (ratio = 'word_length') AS min_w
  FROM pick GROUP BY ALL
), verdict AS (
  SELECT ra.*, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
         coalesce(symbol_ratio <= max_s AND dup_line_ratio <= max_d AND word_length BETWEEN min_w AND max_w, false) AS fits
  FROM ra LEFT JOIN fence ON ra.lang IS NOT DISTINCT FROM fence.lang AND ra.source IS NOT DISTINCT FROM fence.source
)"""

OP7 = (
    f"WITH {_QUALITY.format(docs='documents')} "
    "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, "
    "NOT base_failed AND fits AS kept FROM verdict"
)


OP3 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v AS q, v AS c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""

OP6 = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes,
         sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS f FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes < 100 OR page_id = f THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN payload_bytes < 100 OR page_id = f THEN NULL ELSE f END AS refers_to
FROM f
"""


def _case(column: str, weights: dict[str, int]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1 END"


def _level(name: str, keys: list[str], above: list[str], parent: str, weight: str) -> str:
    """Shares of one tree level; ``parent`` has the budget of the level above."""
    over = f"PARTITION BY {', '.join(above)}" if above else ""
    on = " AND ".join(f"c.{k} IS NOT DISTINCT FROM p.{k}" for k in above) or "true"
    return f"""
{name}_c AS (
  SELECT {', '.join('c.' + k for k in keys)}, c.cap, c.w, p.quota AS have
  FROM (SELECT {', '.join(keys)}, sum(capacity)::BIGINT AS cap, {weight} AS w FROM leaf GROUP BY {', '.join(keys)}) c
  JOIN {parent} p ON {on}
), {name}_f AS (
  SELECT *, cap * (sum(w) OVER ({over}) - coalesce(sum(w) OVER b, 0)) <= w * (have - coalesce(sum(cap) OVER b, 0)) AS "full"
  FROM {name}_c WINDOW b AS ({over} ORDER BY cap / w, {keys[-1]} NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), {name}_s AS (
  SELECT *, have - coalesce(sum(cap) FILTER ("full") OVER ({over}), 0) AS rest,
         sum(w) FILTER (NOT "full") OVER ({over}) AS open_w FROM {name}_f
), {name}_r AS (
  SELECT *, CASE WHEN "full" THEN cap ELSE (w * rest) // open_w END AS share FROM {name}_s
), {name} AS (
  SELECT {', '.join(keys)}, (share + CASE WHEN NOT "full" AND row_number() OVER ({over} ORDER BY "full", {keys[-1]} NULLS FIRST)
         <= rest - sum(share) FILTER (NOT "full") OVER ({over}) THEN 1 ELSE 0 END)::BIGINT AS quota FROM {name}_r
)"""


def _mixing(docs: str) -> str:
    """Common tables of the mixture over ``docs``; the last one is ``taken``."""
    number = "try_cast(regexp_extract(source, '([0-9]{1,9})$', 1) AS INTEGER)"
    places = " ".join(f"WHEN {number} < {limit} THEN '{name}'" for limit, name in mixing.DOMAINS)
    md5 = f"('0x' || substr(md5('{mixing.SEED}:' || epochs || ':' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT"
    levels = ", ".join(
        [
            _level("dom", ["domain"], [], "root", _case("domain", mixing.WEIGHTS["_m_domain"])),
            _level("lng2", ["domain", "lang"], ["domain"], "dom", _case("lang", mixing.WEIGHTS["_m_lang"])),
            _level("src", ["domain", "lang", "source"], ["domain", "lang"], "lng2", "1"),
        ]
    )
    same = " AND ".join(f"a.{k} IS NOT DISTINCT FROM b.{k}" for k in ("domain", "lang", "source"))
    return rf"""
m AS (
  SELECT *, CASE {places} ELSE 'other' END AS domain,
         len(regexp_extract_all(coalesce(text, ''), '[^{SPACE}]+'))::BIGINT AS n_tokens FROM {docs}
), leaf AS (
  SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, sum(n_tokens)::BIGINT * {mixing.MAX_EPOCHS} AS capacity
  FROM m GROUP BY domain, lang, source
), root AS (SELECT sum(tokens)::BIGINT AS quota FROM leaf), {levels},
q AS (
  SELECT a.*, b.quota // a.tokens AS epochs, b.quota % a.tokens AS rest FROM leaf a JOIN src b ON {same} WHERE a.tokens > 0
), o AS (
  SELECT a.*, b.epochs, b.rest, {md5.replace('doc_id', 'a.doc_id').replace('epochs', 'b.epochs')} AS o FROM m a JOIN q b ON {same}
), run AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY o RANGE UNBOUNDED PRECEDING) AS upto FROM o
), lim AS (
  SELECT *, min(CASE WHEN upto > rest THEN o END) OVER (PARTITION BY domain, lang, source) AS stop FROM run
), taken AS (
  SELECT *, unnest(range(0, epochs + CASE WHEN o < coalesce(stop, 1 << 61) THEN 1 ELSE 0 END)) AS epoch FROM lim
)"""


OP4 = f"WITH {_mixing('documents')} SELECT doc_id, domain, lang, source, n_tokens, epoch::BIGINT AS epoch FROM taken"


OP9 = rf"""
WITH d AS (
  SELECT source, lang, len(regexp_extract_all(coalesce(text, ''), '[^{SPACE}]+'))::BIGINT AS a,
         len(regexp_extract_all(coalesce(text, ''), '{rollup.PIECES}'))::BIGINT AS b
  FROM documents
)
SELECT source, lang, CASE WHEN lang = 'en' THEN 'words-1' ELSE 'words-2' END AS tokenizer_version,
       count(*)::BIGINT AS n_docs, sum(CASE WHEN lang = 'en' THEN a ELSE b END)::BIGINT AS n_tokens
FROM d WHERE a >= 20 GROUP BY ALL
"""


def _licenses() -> str:
    rows = ", ".join(f"({r.rule}, {r.tier}, '{r.label}', '{r.keyword}', '{licenses.pattern(r.signature)}')" for r in rules())
    wanted = ", ".join(f"'{k}'" for k in licenses.keywords())
    base = " UNION ALL ".join(
        f"SELECT rid, '{label}' AS label, unnest(regexp_extract_all(num, '{licenses.pattern(phrase, group=True)}', 1))::BIGINT AS place FROM g"
        for phrase, label in licenses.BASE
    )
    confidence = " ".join(f"WHEN {t} THEN {c}::DOUBLE" for t, c in CONFIDENCE.items())
    return rf"""
WITH r(rule, tier, label, keyword, pattern) AS (VALUES {rows}),
d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         list_filter(string_split_regex(translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}'), '{licenses.GAP}'), lambda x: x <> '') AS ws
  FROM documents
), g AS (
  SELECT rid, ws, ' ' || array_to_string(list_transform(ws, lambda w, i: (i - 1) || ':' || w), '  ') || ' ' AS num
  FROM d WHERE list_has_any(ws, [{wanted}])
), b AS ({base}), bs AS (
  SELECT rid, count(*)::BIGINT AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS ls FROM b GROUP BY rid
), m AS (
  SELECT rid, rule, tier, label, unnest(regexp_extract_all(num, pattern)) AS hit FROM g JOIN r ON list_contains(ws, keyword)
), x AS (
  SELECT rid, rule, tier, label, regexp_extract(hit, '^ ([0-9]+):', 1)::BIGINT AS a, regexp_extract(hit, '([0-9]+):[^ ]* $', 1)::BIGINT AS z FROM m
), s AS (
  SELECT * FROM x WHERE NOT EXISTS (
    SELECT 1 FROM x AS y WHERE y.rid = x.rid AND y.tier <= x.tier AND y.a <= x.a AND y.z >= x.z
      AND (y.a < x.a OR y.z > x.z OR y.tier < x.tier OR y.rule < x.rule))
), v AS (
  SELECT rid, list(DISTINCT label) AS ms, max(CASE tier {confidence} END) AS score FROM s GROUP BY rid
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word,
       array_to_string(list_sort(coalesce(ls, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(ls, []), coalesce(ms, [])))), ',') AS labels,
       coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN bs USING (rid) LEFT JOIN v USING (rid)
"""


OP11 = rf"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p
), g AS (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, range(1, {phrases.MAX_WORDS} + 1) AS t(k) WHERE len(ws) >= k)
), tot AS (SELECT lang, count(*) AS n FROM g WHERE k = 1 GROUP BY lang),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= {phrases.MIN_COUNT}),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
cut AS (SELECT *, unnest(range(1, k)) AS at_word FROM c),
sc AS (
  SELECT cut.lang, cut.phrase, cut.k, cut.a, at_word, x.a AS l, y.a AS r, {phrases.SCALE}::HUGEINT * cut.a // (x.a + y.a) AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = array_to_string(cut.ws[:at_word], ' ')
           JOIN f y ON y.lang = cut.lang AND y.phrase = array_to_string(cut.ws[at_word + 1:], ' ')
), best AS (
  SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, at_word) = 1
), inn AS (
  SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, max(a) AS longest
  FROM (SELECT lang, ws, a, m, unnest(range(1, k - m + 2)) AS i FROM c, range(2, {phrases.MAX_WORDS}) AS t(m) WHERE m < k) GROUP BY ALL
), kept AS (
  SELECT best.* FROM best LEFT JOIN inn USING (lang, phrase) WHERE longest IS NULL OR 100 * longest < {phrases.CONTAINED_PERCENT} * a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase,
       a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM kept JOIN tot USING (lang) QUALIFY rank <= {phrases.TOP}
"""


def oracle_sql() -> dict[str, str]:
    return {"op9_token_counts": OP9, "op3_top_k": OP3, "op4_mixing": OP4, "op6_warc": OP6, "op7_quality": OP7, "op11_phrases": OP11, "op12_licenses": _licenses()}
