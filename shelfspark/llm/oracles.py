"""The operators' queries in SQL, for DuckDB on the same tables, where SQL can say them."""

from __future__ import annotations

from . import lm_score, quality

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"
_LOWER = f'translate("text", \'{_UPPER}\', \'{_UPPER.lower()}\')'


def _islands(window: int) -> str:
    """Common tables f (doc_id, i, rn) to g: merged spans [a, b) of repeated windows, 1-based."""
    return f"""g0 AS (SELECT doc_id, i, CASE WHEN i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000000) + {window} THEN 1 ELSE 0 END n FROM f WHERE rn > 1),
 g1 AS (SELECT doc_id, i, sum(n) OVER (PARTITION BY doc_id ORDER BY i) s FROM g0),
 g AS (SELECT doc_id, min(i) a, max(i) + {window} b FROM g1 GROUP BY doc_id, s),
 t AS (SELECT doc_id, sum(b - a) removed, count(*) spans FROM g GROUP BY 1),
 e AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 1) c FROM g)"""


OP9 = f"""WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS.format('"text"')} w FROM documents),
 s AS (SELECT doc_id, unnest(range(1, greatest(1, len(w) - 18))) i, w FROM d),
 f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i:i + 19], ' ') ORDER BY doc_id, i) rn FROM s),
 {_islands(20)},
 p AS (SELECT e.doc_id, c o, array_to_string(w[c:a - 1], ' ') x FROM e JOIN d USING (doc_id) WHERE a > c
   UNION ALL SELECT d.doc_id, coalesce(m, 1), array_to_string(w[coalesce(m, 1):len(w)], ' ') FROM d LEFT JOIN (SELECT doc_id, max(b) m FROM g GROUP BY 1) USING (doc_id) WHERE len(w) >= coalesce(m, 1)),
 k AS (SELECT doc_id, string_agg(x, ' ' ORDER BY o) x FROM p GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(coalesce(x, '')) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id) LEFT JOIN k USING (doc_id)"""


OP6 = f"""WITH d AS MATERIALIZED (SELECT doc_id, encode(coalesce("text", '')) w FROM documents),
 s AS (SELECT doc_id, unnest(range(1, greatest(1, octet_length(w) - 98))) i, w FROM d),
 f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY md5(w[i:i + 99]) ORDER BY doc_id, i) rn FROM s),
 {_islands(100)},
 p AS (SELECT e.doc_id, c o, hex(w[c:a - 1]) x FROM e JOIN d USING (doc_id) WHERE a > c
   UNION ALL SELECT d.doc_id, coalesce(m, 1), hex(w[coalesce(m, 1):octet_length(w)]) FROM d LEFT JOIN (SELECT doc_id, max(b) m FROM g GROUP BY 1) USING (doc_id) WHERE octet_length(w) >= coalesce(m, 1)),
 k AS (SELECT doc_id, string_agg(x, '' ORDER BY o) x FROM p GROUP BY 1)
SELECT d.doc_id, CAST(octet_length(w) AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(x, ''))) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id) LEFT JOIN k USING (doc_id)"""


OP3 = f"""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, {_WORDS.format(_LOWER)} w FROM documents),
 s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') k FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) i FROM d WHERE len(w) > 0)),
 n AS (SELECT doc_id, count(*) n FROM s GROUP BY 1),
 c AS (SELECT a.doc_id x, b.doc_id y, count(*) c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
 l AS MATERIALIZED (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
 b AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
 r(x, y) AS (SELECT x, y FROM b UNION SELECT r.x, b.y FROM r JOIN b ON r.y = b.x),
 m AS (SELECT x doc_id, least(x, min(y)) m FROM r GROUP BY x)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(m, d.doc_id) AS component_id, coalesce(m, d.doc_id) = d.doc_id AS kept FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""


_TERMS = r"regexp_extract_all(coalesce({}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".format(_LOWER)

OP4 = f"""WITH d AS MATERIALIZED (SELECT doc_id, {_TERMS} w FROM documents),
 b AS (SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') item, {_TERMS} w FROM benchmark),
 q AS MATERIALIZED (SELECT DISTINCT item, least(13, len(w)) n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') k FROM (SELECT item, w, unnest(range(1, greatest(2, len(w) - 11))) i FROM b WHERE len(w) > 0)),
 z AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') k FROM (SELECT doc_id, w, n, unnest(range(1, greatest(1, len(w) - n + 2))) i FROM d, (SELECT DISTINCT n FROM q))),
 h AS MATERIALIZED (SELECT doc_id, item, i, z.n FROM z JOIN q USING (n, k)),
 u AS (SELECT doc_id, count(*) n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) p FROM h) GROUP BY 1),
 v AS (SELECT doc_id, count(*) n_items, string_agg(item, ',' ORDER BY item) x FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(x, '')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN u USING (doc_id) LEFT JOIN v USING (doc_id)"""


def _quality() -> str:
    """Sketches, quantiles and fences of three levels, as in ``quality``; a level's q has total, q50, up and dn of each measure k."""
    gamma = repr(quality.GAMMA)
    names = list(quality.MEASURES)
    end = " ".join(f"WHEN '{k}' THEN {quality.TAIL[k]}::DOUBLE" for k in names)
    outside = " OR ".join([f"(k = '{k}' AND x > hi)" for k in names] + ["(k = 'word_length' AND x < lo)"])
    least = " ".join(f"WHEN '{k}' THEN {n}::DOUBLE / s.{of}" for k, (n, of) in quality.UNIT.items())
    sizes = ", ".join(f"max(q50) FILTER (k = '{c}') {c}" for c in quality.SIZES)
    place = lambda q: f"min(u / {gamma} + (u - u / {gamma}) * greatest(0, (ceil({q} * total) - (upto - n)) / n::DOUBLE)) FILTER (upto >= ceil({q} * total))"
    tables = []
    for name, by in {"own": ["lang", "source"], "lng": ["lang"], "every": []}.items():
        cols = "".join(f"{c}, " for c in by)
        part = f"PARTITION BY {cols}k"
        same = lambda a, b: " AND ".join(f"{a}.{c} IS NOT DISTINCT FROM {b}.{c}" for c in by) or "true"  # noqa: B023, E731
        tables.append(
            f"{name}_q AS MATERIALIZED (SELECT {cols}k, max(total) total, {place('0.5::DOUBLE')} q50, {place('e')} up, {place('(1 - e)')} dn FROM "
            f"(SELECT {cols}k, v * (({gamma}::DOUBLE + 1) / 2) u, n, sum(n) OVER ({part} ORDER BY v) upto, sum(n) OVER ({part}) total, CASE k {end} ELSE 0.5::DOUBLE END e FROM (SELECT {cols}k, v, sum(n) n FROM sketch GROUP BY ALL)) GROUP BY {cols}k)"
        )
        if name == "own":
            tables.append("usual AS (SELECT k, quantile_disc(8.0::DOUBLE * (q50 - dn), 0.5) dn, quantile_disc(8.0::DOUBLE * (up - q50), 0.5) up FROM own_q WHERE total >= 50 GROUP BY k)")
        tables.append(
            f"{name}_s AS (SELECT {cols}{sizes} FROM {name}_q {'GROUP BY ' + ', '.join(by) if by else ''}),\n "
            f"{name}_l AS (SELECT {''.join(f'q.{c}, ' for c in by)}q.k, q.total, q.q50, 8.0::DOUBLE * (q.q50 - q.dn) down, 8.0::DOUBLE * (q.up - q.q50) rise, CASE q.k {least} ELSE {quality.WORD_PART}::DOUBLE * q.q50 END least, usual.dn udn, usual.up uup FROM {name}_q q JOIN {name}_s s ON {same('q', 's')} LEFT JOIN usual USING (k)),\n "
            f"{name} AS (SELECT {cols}k, total, q50 - greatest(least(down, {quality.LIFT}::DOUBLE * greatest(coalesce(udn, down), least)), least) lo, q50 + greatest(least(rise, {quality.LIFT}::DOUBLE * greatest(coalesce(uup, rise), least)), least) hi FROM {name}_l)"
        )
    judged = " UNION ALL ".join(f"SELECT doc_id, lang, source, n_words, bf, '{k}' k, {k}::DOUBLE x FROM m" for k in (*names, *quality.SIZES))
    return (
        rf"""WITH d AS MATERIALIZED (SELECT doc_id, lang, source, coalesce("text", '') t, {_WORDS.format('"text"')} w,
   list_filter(string_split(coalesce("text", ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) ln FROM documents),
 tri AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 1))) i FROM d)),
 rep AS (SELECT doc_id, i FROM tri QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
 rw AS (SELECT doc_id, count(*) r FROM (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) p FROM rep) GROUP BY 1),
 m AS MATERIALIZED (SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) n_words, CAST(length(array_to_string(w, '')) AS BIGINT) word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) n_symbols, CAST(len(ln) AS BIGINT) n_lines,
   CAST(len(ln) - len(list_distinct(ln)) AS BIGINT) n_dup_lines, CAST(coalesce(r, 0) AS BIGINT) n_repeat_words, (len(w) < 50 OR 100 * coalesce(r, 0) > 50 * len(w)) bf,
   CASE WHEN word_chars > 0 THEN n_symbols::DOUBLE / word_chars ELSE 0 END symbol_share, CASE WHEN len(ln) > 0 THEN n_dup_lines::DOUBLE / len(ln) ELSE 0 END dup_line_share,
   CASE WHEN len(w) > 0 THEN n_repeat_words::DOUBLE / len(w) ELSE 0 END repeat_share, CASE WHEN len(w) > 0 THEN word_chars::DOUBLE / len(w) ELSE 0 END word_length FROM d LEFT JOIN rw USING (doc_id)),
 x AS MATERIALIZED ({judged}),
 sketch AS MATERIALIZED (SELECT lang, source, k, CASE WHEN x > 1e-9::DOUBLE THEN 2 * pow({gamma}::DOUBLE, ceil(ln(x) / ln({gamma}::DOUBLE))) / ({gamma}::DOUBLE + 1) ELSE 0 END v, count(*) n FROM x WHERE NOT bf GROUP BY ALL),
 """
        + ",\n ".join(tables)
        + f""",
 lim AS (SELECT x.doc_id, x.k, x.x, CASE WHEN own.total >= 50 THEN own.lo WHEN lng.total >= 50 THEN lng.lo ELSE every.lo END lo, CASE WHEN own.total >= 50 THEN own.hi WHEN lng.total >= 50 THEN lng.hi ELSE every.hi END hi
   FROM x LEFT JOIN own ON x.lang IS NOT DISTINCT FROM own.lang AND x.source IS NOT DISTINCT FROM own.source AND x.k = own.k LEFT JOIN lng ON x.lang IS NOT DISTINCT FROM lng.lang AND x.k = lng.k LEFT JOIN every ON x.k = every.k),
 bad AS (SELECT doc_id, bool_or({outside}) o FROM lim GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, bf AS base_failed, NOT bf AND NOT coalesce(o, false) AS kept FROM m LEFT JOIN bad USING (doc_id)"""
    )


OP8 = _quality()


OP1 = f"""WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS.format(_LOWER)} w FROM documents),
 g AS MATERIALIZED (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
 t0 AS MATERIALIZED (SELECT doc_id, i, w[i] x FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) i FROM d)),
 v AS (SELECT x FROM t0 GROUP BY 1 HAVING count(*) >= {lm_score.MIN_COUNT}),
 t AS MATERIALIZED (SELECT doc_id, i, coalesce(v.x, '') x, coalesce(lag(coalesce(v.x, '')) OVER (PARTITION BY doc_id ORDER BY i), ' ') b, CASE WHEN g.doc_id IS NULL THEN 0 ELSE 1 END g FROM t0 LEFT JOIN v USING (x) LEFT JOIN g USING (doc_id)),
 u AS (SELECT x, count(*) a, sum(g) g FROM t GROUP BY 1), p AS (SELECT b, x, count(*) a, sum(g) g FROM t GROUP BY 1, 2),
 ou AS (SELECT doc_id, x, count(*) o FROM t GROUP BY 1, 2), op AS (SELECT doc_id, b, x, count(*) o FROM t GROUP BY 1, 2, 3), dn AS (SELECT doc_id, count(*) n FROM t GROUP BY 1),
 c AS (SELECT (SELECT count(*) + 1 FROM v) vs, (SELECT count(*) FROM t) na, (SELECT coalesce(sum(g), 0) FROM t) ng),
 j AS (SELECT t.doc_id, t.i, t.b, t.g, u.a ua, u.g ug, ou.o uo, p.a pa, p.g pg, op.o po, ub.a ba, ub.g bg, obo.o bo, dn.n
   FROM t JOIN u ON u.x = t.x JOIN ou ON ou.doc_id = t.doc_id AND ou.x = t.x JOIN p ON p.x = t.x AND p.b = t.b JOIN op ON op.doc_id = t.doc_id AND op.x = t.x AND op.b = t.b
   JOIN dn ON dn.doc_id = t.doc_id LEFT JOIN u ub ON ub.x = t.b LEFT JOIN ou obo ON obo.doc_id = t.doc_id AND obo.x = t.b),
 k AS (SELECT doc_id, i, b, (ua - uo + 1)::DOUBLE / (na - n + vs) qa, (ug - uo * g + 1)::DOUBLE / (ng - n * g + vs) qg, pa - po xa, pg - po * g xg, ba - bo ya, bg - bo * g yg FROM j, c),
 l AS (SELECT doc_id, -log2(CASE WHEN b = ' ' THEN qa ELSE (xa + {lm_score.MU}::DOUBLE * qa) / (ya + {lm_score.MU}::DOUBLE) END) la, -log2(CASE WHEN b = ' ' THEN qg ELSE (xg + {lm_score.MU}::DOUBLE * qg) / (yg + {lm_score.MU}::DOUBLE) END) lg FROM k)
SELECT d.doc_id, CAST(len(any_value(w)) AS BIGINT) AS n_tokens, round(avg(lg), 6) AS target_loss, round(avg(la), 6) AS background_loss, round(avg(lg) - avg(la), 6) AS score FROM d LEFT JOIN l USING (doc_id) GROUP BY d.doc_id"""


OP11 = rf"""WITH p AS (SELECT coalesce(lang, 'und') lang, unnest(string_split_regex({_LOWER.replace('"text"', """coalesce("text", '')""")}, '[.,;:!?\x0A-\x0D]')) piece FROM documents),
 w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') w FROM p),
 f AS MATERIALIZED (SELECT lang, m, k, count(*) f FROM (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') k FROM (SELECT lang, w, m, unnest(range(1, greatest(1, len(w) - m + 2))) i FROM w, (SELECT unnest([1, 2, 3]) m))) GROUP BY ALL),
 t AS (SELECT lang, CAST(sum(f) AS BIGINT) n FROM f WHERE m = 1 GROUP BY 1),
 c AS MATERIALIZED (SELECT lang, m, k, f a, string_split(k, ' ') s FROM f WHERE m > 1 AND f >= 10),
 b AS (SELECT c.lang, c.m, c.k, a, l.f l, r.f r, j, CAST((1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f) AS BIGINT) score FROM (SELECT *, unnest(range(1, m)) j FROM c) c
   JOIN f l ON l.lang = c.lang AND l.k = array_to_string(s[1:j], ' ') AND l.m = j JOIN f r ON r.lang = c.lang AND r.k = array_to_string(s[j + 1:c.m], ' ') AND r.m = c.m - j),
 x AS (SELECT lang, m, k, a, l, r, score FROM b QUALIFY row_number() OVER (PARTITION BY lang, m, k ORDER BY score, j) = 1),
 h AS (SELECT DISTINCT c.lang, q.k FROM (SELECT lang, a, unnest([array_to_string(s[1:2], ' '), array_to_string(s[2:3], ' ')]) k FROM c WHERE m = 3) c JOIN f q ON q.lang = c.lang AND q.k = c.k AND q.m = 2 WHERE 100 * c.a >= 50 * q.f),
 y AS (SELECT x.lang, row_number() OVER (PARTITION BY x.lang ORDER BY score DESC, a DESC, x.k) rank, x.k phrase, a, l, r, score FROM x LEFT JOIN h ON x.m = 2 AND h.lang = x.lang AND h.k = x.k WHERE h.k IS NULL)
SELECT y.lang, rank, phrase, a, l, r, n, score FROM y JOIN t USING (lang) WHERE rank <= 2000"""


OP12 = rf"""WITH l0 AS (SELECT doc_id, string_split(coalesce("text", ''), chr(10)) ln FROM documents),
 l AS MATERIALIZED (SELECT doc_id, unnest(range(1, len(ln) + 1)) i, unnest(ln) line FROM l0),
 k AS MATERIALIZED (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '{_UPPER}', '{_UPPER.lower()}') k FROM l),
 r AS (SELECT k, min(doc_id) first FROM k WHERE length(k) >= 10 GROUP BY 1 HAVING count(DISTINCT doc_id) > 1)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (doc_id > first) AS BIGINT) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT coalesce(doc_id > first, false)), '')) AS kept_sha256
FROM k LEFT JOIN r USING (k) GROUP BY doc_id"""


OP13 = """WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END lb, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) q
   FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS MATERIALIZED (SELECT a.vec_id a, b.vec_id b, a.lb = b.lb same, CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) s FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
 p AS (SELECT a, b, s FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b) AS INTEGER) AS rank, s.b AS negative_id, p.s AS positive_score, s.s AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.same AND 30 * p.s <= 100 * s.s AND 100 * s.s <= 90 * p.s QUALIFY row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b) <= 10"""


ORACLES = {"op1_lm_score": OP1, "op3_near_dedup": OP3, "op4_decontamination": OP4, "op6_suffix_dedup": OP6, "op8_quality_rules": OP8, "op9_block_dedup": OP9, "op11_collocations": OP11, "op12_line_dedup": OP12, "op13_hard_negatives": OP13}
