"""SQL for the queries: the same results on the same tables, written on its own from the rules."""

from __future__ import annotations

from leafspark.functions.text import COMMON_WORDS, SFX_WORDS
from leafspark.operators.state import EDGES, STAGES

TICKS = "`" * 3

BOXES = """boxes AS (SELECT l_orderkey AS page_id,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS bubble_id,
  CAST((l_partkey*37) % 700 AS INT) AS x1, CAST((l_suppkey*53 + l_partkey) % 900 AS INT) AS y1,
  CAST((l_partkey*37) % 700 + 40 + l_quantity*6 AS INT) AS x2, CAST((l_suppkey*53 + l_partkey) % 900 + 30 + (l_partkey % 40)*6 AS INT) AS y2,
  CAST(1000 - (l_partkey*7 + l_suppkey*13 + l_linenumber) % 900 AS DOUBLE)/1000 AS conf, l_partkey AS part FROM lineitem)"""

PAIRS = BOXES + """, near AS (SELECT a.page_id, a.bubble_id AS i, b.bubble_id AS j,
  greatest(least(a.x2,b.x2)-greatest(a.x1,b.x1),0)::BIGINT * greatest(least(a.y2,b.y2)-greatest(a.y1,b.y1),0) AS inter,
  (a.x2-a.x1)::BIGINT*(a.y2-a.y1) AS aa, (b.x2-b.x1)::BIGINT*(b.y2-b.y1) AS ba,
  greatest(0, greatest(a.x1,b.x1)-least(a.x2,b.x2)) AS hg, greatest(0, greatest(a.y1,b.y1)-least(a.y2,b.y2)) AS vg,
  least(a.x2,b.x2)-greatest(a.x1,b.x1) > 0 AS xo, least(a.y2,b.y2)-greatest(a.y1,b.y1) > 0 AS yo
  FROM boxes a JOIN boxes b ON a.page_id = b.page_id AND a.bubble_id < b.bubble_id),
 pairs AS (SELECT page_id, i, j, inter::DOUBLE/greatest(aa+ba-inter,1) AS iou, inter::DOUBLE/greatest(least(aa,ba),1) AS ratio FROM near WHERE inter > 0)"""

_RATIO = "(greatest(least({a}.x2,{b}.x2)-greatest({a}.x1,{b}.x1),0)::DOUBLE*greatest(least({a}.y2,{b}.y2)-greatest({a}.y1,{b}.y1),0))/greatest(least(({a}.x2-{a}.x1)*({a}.y2-{a}.y1),({b}.x2-{b}.x1)*({b}.y2-{b}.y1)),1)"
_INTER = "(greatest(least({a}.x2,{b}.x2)-greatest({a}.x1,{b}.x1),0)::DOUBLE*greatest(least({a}.y2,{b}.y2)-greatest({a}.y1,{b}.y1),0))"


def ratio(a: str, b: str) -> str:
    return _RATIO.format(a=a, b=b)


def iou(a: str, b: str) -> str:
    i = _INTER.format(a=a, b=b)
    return f"{i}/greatest(({a}.x2-{a}.x1)*({a}.y2-{a}.y1)+({b}.x2-{b}.x1)*({b}.y2-{b}.y1)-{i},1)"


def nms(standard: bool) -> str:
    older = "true" if standard else "k.id < x[1].id"
    return f"""WITH {BOXES}, p AS (SELECT page_id, list({{'c': -conf, 'id': bubble_id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} ORDER BY -conf, bubble_id) AS bs FROM boxes GROUP BY page_id),
 k AS (SELECT page_id, list_reduce(list_transform(bs, lambda b: [b]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: {older} AND {iou('k', 'x[1]')} > 0.40)) > 0 THEN acc ELSE list_concat(acc, x) END) AS kept FROM p)
SELECT page_id, u.id AS bubble_id FROM (SELECT page_id, unnest(kept) AS u FROM k)"""


COMPONENTS = PAIRS + """, e AS (SELECT page_id, i, j FROM near WHERE inter::DOUBLE/greatest(least(aa,ba),1) > 0.05 OR (xo AND vg <= 40) OR (yo AND hg <= 40) OR (hg <= 40 AND vg <= 40)),
 s AS (SELECT page_id, i, j FROM e UNION ALL SELECT page_id, j, i FROM e),
 reach AS (SELECT page_id, bubble_id, bubble_id AS dst FROM boxes UNION SELECT r.page_id, r.bubble_id, s.j FROM reach r JOIN s ON s.page_id = r.page_id AND s.i = r.dst),
 panel AS (SELECT page_id, bubble_id, min(dst) AS panel FROM reach GROUP BY ALL)"""

#: Groups of overlapping boxes around leaders; `id` lists in order, of structs id, x1, y1, x2, y2 (column bs).
GROUPS = f"""list_reduce(list_concat([[]::STRUCT(l BIGINT, id BIGINT, x1 INT, y1 INT, x2 INT, y2 INT)[]], list_transform(bs, lambda b: [{{'l': b.id, 'id': b.id, 'x1': b.x1, 'y1': b.y1, 'x2': b.x2, 'y2': b.y2}}])),
  lambda acc, x: CASE WHEN list_contains(list_transform(acc, lambda m: m.id), x[1].id) OR len(list_filter(bs, lambda o: o.id > x[1].id AND NOT list_contains(list_transform(acc, lambda m: m.id), o.id) AND {ratio('o', 'x[1]')} > 0.1)) = 0 THEN acc
  ELSE list_concat(list_concat(acc, x), list_transform(list_filter(bs, lambda o: o.id > x[1].id AND NOT list_contains(list_transform(acc, lambda m: m.id), o.id) AND {ratio('o', 'x[1]')} > 0.1), lambda o: {{'l': x[1].id, 'id': o.id, 'x1': o.x1, 'y1': o.y1, 'x2': o.x2, 'y2': o.y2}})) END)"""


def rows_of(items: str, tolerance: str) -> str:
    """Rows of items (structs with cy): a list of structs n, t, items; the tolerance may use it."""
    return f"""list_reduce(list_transform({items}, lambda b: [{{'n': 1, 't': b.cy, 'items': [b]}}]), lambda acc, q: CASE WHEN coalesce(list_position(list_transform(acc, lambda r: abs(q[1].t - r.t / r.n) <= {tolerance}), true), 0) = 0 THEN list_concat(acc, q)
  ELSE list_transform(acc, lambda r, i: CASE WHEN i = list_position(list_transform(acc, lambda z: abs(q[1].t - z.t / z.n) <= {tolerance}), true) THEN {{'n': r.n + 1, 't': r.t + q[1].t, 'items': list_concat(r.items, q[1].items)}} ELSE r END) END)"""


def reading_order(source: str, name: str) -> str:
    """Panels, overlap groups, rows and splice over the boxes of CTE `name`, given the CTEs in source."""
    return f"""WITH RECURSIVE {source},
 it AS (SELECT b.page_id, p.panel, list({{'id': b.bubble_id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} ORDER BY b.bubble_id) AS bs, (min(x1)+max(x2))/2.0::DOUBLE AS px, (min(y1)+max(y2))/2.0::DOUBLE AS py FROM {name} b JOIN panel p ON p.page_id = b.page_id AND p.bubble_id = b.bubble_id GROUP BY ALL),
 g AS (SELECT *, {GROUPS} AS m FROM it),
 member AS (SELECT page_id, panel, u.l AS l, u.id AS id, u.x1 AS x1, u.y1 AS y1, u.x2 AS x2, u.y2 AS y2 FROM (SELECT page_id, panel, unnest(m) AS u FROM g)),
 block AS (SELECT page_id, panel, id, row_number() OVER (PARTITION BY page_id, panel ORDER BY l, (x2-x1)*(y2-y1), (y1+y2)/2.0, (x1+x2)/2.0, id) AS pos, (y1+y2)/2.0::DOUBLE AS cy FROM member),
 rest AS (SELECT page_id, panel, list_transform(list_filter(bs, lambda b: NOT list_contains(list_transform(m, lambda z: z.id), b.id)), lambda b: {{'id': b.id, 'cy': (b.y1+b.y2)/2.0::DOUBLE, 'x': (b.x1+b.x2)/2.0::DOUBLE}}) AS items FROM g),
 rws AS (SELECT page_id, panel, {rows_of('items', '50')} AS rs FROM rest WHERE len(items) > 0),
 r1 AS (SELECT page_id, panel, generate_subscripts(rs, 1) AS ri, unnest(rs) AS r FROM rws),
 r2 AS (SELECT page_id, panel, ri, r.t / r.n AS y, generate_subscripts(r.items, 1) AS k, unnest(r.items) AS o FROM r1),
 r3 AS (SELECT page_id, panel, o.id AS id, o.cy AS cy, row_number() OVER (PARTITION BY page_id, panel ORDER BY y, ri, o.x, k) AS pos FROM r2),
 cut AS (SELECT r3.page_id, r3.panel, max(CASE WHEN r3.cy <= b.cy THEN r3.pos ELSE 0 END) AS at FROM r3 JOIN block b ON b.page_id = r3.page_id AND b.panel = r3.panel AND b.pos = 1 GROUP BY ALL),
 loc AS (SELECT r3.page_id, r3.panel, r3.id, CASE WHEN cut.at IS NULL OR r3.pos <= cut.at THEN 0 ELSE 2 END AS part, r3.pos FROM r3 LEFT JOIN cut ON cut.page_id = r3.page_id AND cut.panel = r3.panel
   UNION ALL SELECT page_id, panel, id, 1, pos FROM block)
SELECT loc.page_id, loc.id AS bubble_id, loc.panel, row_number() OVER (PARTITION BY loc.page_id ORDER BY it.py, it.px, loc.panel, loc.part, loc.pos) - 1 AS reading_order
FROM loc JOIN it ON it.page_id = loc.page_id AND it.panel = loc.panel"""


SUPPRESSED = BOXES + f""", pn AS (SELECT page_id, list({{'c': -conf, 'id': bubble_id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} ORDER BY -conf, bubble_id) AS bs FROM boxes GROUP BY page_id),
 kn AS (SELECT page_id, unnest(list_reduce(list_transform(bs, lambda b: [b]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: k.id < x[1].id AND {iou('k', 'x[1]')} > 0.40)) > 0 THEN acc ELSE list_concat(acc, x) END)) AS u FROM pn),
 kept AS (SELECT b.* FROM boxes b JOIN kn ON kn.page_id = b.page_id AND kn.u.id = b.bubble_id)"""
KEPT_PANELS = SUPPRESSED + """, near AS (SELECT a.page_id, a.bubble_id AS i, b.bubble_id AS j,
  greatest(least(a.x2,b.x2)-greatest(a.x1,b.x1),0)::BIGINT * greatest(least(a.y2,b.y2)-greatest(a.y1,b.y1),0) AS inter, (a.x2-a.x1)::BIGINT*(a.y2-a.y1) AS aa, (b.x2-b.x1)::BIGINT*(b.y2-b.y1) AS ba,
  greatest(0, greatest(a.x1,b.x1)-least(a.x2,b.x2)) AS hg, greatest(0, greatest(a.y1,b.y1)-least(a.y2,b.y2)) AS vg, least(a.x2,b.x2)-greatest(a.x1,b.x1) > 0 AS xo, least(a.y2,b.y2)-greatest(a.y1,b.y1) > 0 AS yo
  FROM kept a JOIN kept b ON a.page_id = b.page_id AND a.bubble_id < b.bubble_id),
 e AS (SELECT page_id, i, j FROM near WHERE inter::DOUBLE/greatest(least(aa,ba),1) > 0.05 OR (xo AND vg <= 40) OR (yo AND hg <= 40) OR (hg <= 40 AND vg <= 40)),
 s AS (SELECT page_id, i, j FROM e UNION ALL SELECT page_id, j, i FROM e),
 reach AS (SELECT page_id, bubble_id, bubble_id AS dst FROM kept UNION SELECT r.page_id, r.bubble_id, s.j FROM reach r JOIN s ON s.page_id = r.page_id AND s.i = r.dst),
 panel AS (SELECT page_id, bubble_id, min(dst) AS panel FROM reach GROUP BY ALL)"""


def clip(low: str, high: str, size: int) -> tuple[str, str]:
    a, b = f"greatest(0, floor({low})::INT)", f"least({size}, ceil({high})::INT)"
    start = f"CASE WHEN {b}-{a} >= 8 THEN {a} WHEN {a}+8 <= {size} THEN {a} WHEN {b}-8 >= 0 THEN {b}-8 ELSE 0 END"
    end = f"CASE WHEN {b}-{a} >= 8 THEN {b} WHEN {a}+8 <= {size} THEN {a}+8 WHEN {b}-8 >= 0 THEN {b} ELSE least({size}, 8) END"
    return start, end


_CX, _CY = clip("(x1-60.5::DOUBLE)*1.25::DOUBLE", "(x1+bubble_id*40-59.25::DOUBLE)*1.25::DOUBLE", 700), clip("(y1*1.5::DOUBLE)*0.75::DOUBLE", "(y2*1.5::DOUBLE)*0.75::DOUBLE", 1000)

GATED = """gated AS (SELECT doc_id, lang, source, text, (CASE WHEN quality IS NULL THEN NULL ELSE 30 + 40*quality - 25*toxic + doc_id % 20 END)::DOUBLE/100 AS confidence, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))"""
TALK = "talk AS (SELECT conv_id AS page_id, turn AS reading_order, role, text FROM conversations)"
LEDGER = "ledger AS (SELECT user_id AS page_id, event_id, ts, event_type AS stage, floor(value*100)::BIGINT AS ms, event_id % 7 < 4 AS usable FROM events)"
SHOUTS = TALK + """, shouts AS (SELECT page_id, reading_order, CASE (page_id+reading_order) % 8 WHEN 0 THEN upper(w)||'!' WHEN 1 THEN '*'||w||'*' WHEN 2 THEN ' boom!? ' WHEN 3 THEN upper(w) WHEN 4 THEN 'WAIT!' WHEN 5 THEN upper(w)||'!!?' WHEN 6 THEN '?!' ELSE w||' '||upper(w)||chr(10)||'OH' END AS t
  FROM (SELECT *, regexp_extract(text, '([A-Za-z]+)', 1) AS w FROM talk) WHERE w <> '')"""


def quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def sfx(t: str) -> str:
    u = f"upper(trim({t}, ' ' || chr(10)))"
    bare = f"trim(regexp_replace({u}, '[!?]+$', ''))"
    return f"({u} <> '' AND ({bare} IN ({quoted(SFX_WORDS)}) OR regexp_full_match({u}, '[*~][A-Z\\s]+[*~]') OR (regexp_full_match({u}, '[A-Z]{{2,}}!+[?]?') AND {bare} NOT IN ({quoted(COMMON_WORDS)}))))"


ROUTED = SHOUTS + f""", routed AS (SELECT page_id, reading_order, t, CASE WHEN page_id % 5 = 0 AND reading_order % 2 = 0 THEN 'context' WHEN reading_order = 3 THEN 'blank' WHEN {sfx('t')} THEN 'sfx' ELSE 'translate' END AS route FROM shouts)"""

STYLE = "CASE p_partkey % 8 WHEN 0 THEN '-Bold' WHEN 1 THEN 'Italic' WHEN 2 THEN '-Light' WHEN 3 THEN '' WHEN 4 THEN '-Regular' WHEN 5 THEN 'ExtraBold' WHEN 6 THEN '-Thin' ELSE 'Black-' END"
FONTS = f"""fonts AS (SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN b WHEN 1 THEN b WHEN 2 THEN b WHEN 3 THEN b WHEN 4 THEN b WHEN 5 THEN b||'Extra' WHEN 6 THEN b ELSE b||'Black-' END AS family,
  CASE p_partkey % 8 WHEN 0 THEN 'Bold' WHEN 1 THEN 'Italic' WHEN 2 THEN 'Light' WHEN 4 THEN 'Regular' WHEN 5 THEN 'Bold' WHEN 6 THEN 'Thin' ELSE 'Regular' END AS style FROM (SELECT p_partkey, replace(p_brand, '#', '') AS b FROM part))"""


def wrapped(text: str, width: str) -> str:
    """Lines of a greedy wrap by characters."""
    return f"""list_reduce(list_transform(list_filter(regexp_split_to_array({text}, '\\s+'), lambda w: w <> ''), lambda w: [w]), lambda acc, w: CASE WHEN len(acc[-1]) + 1 + len(w[1]) <= {width} THEN list_concat(acc[:-2], [acc[-1] || ' ' || w[1]]) ELSE list_concat(acc, w) END)"""


ENTRIES = LEDGER + """, entries AS (SELECT page_id, event_id AS pos, CASE event_id % 4 WHEN 0 THEN 'success' WHEN 1 THEN 'failed' WHEN 2 THEN 'skipped' ELSE 'partial' END AS status, ms % 10 AS bubbles, stage, CASE WHEN event_id % 2 = 0 THEN 'fill' ELSE 'lama' END AS inpaint, event_id*37 % 9973 % 9001 / 10000::DOUBLE AS avg_ocr_conf, event_id*91 % 7 * 1357 / 10000::DOUBLE AS avg_render_score FROM ledger)"""


BUBBLES = BOXES + """, bubbles AS (SELECT page_id, bubble_id, CASE WHEN part % 3 = 0 THEN '' ELSE 'x' END AS t, CASE WHEN part % 5 = 0 THEN 'sfx' ELSE '' END AS s,
  CASE WHEN part % 7 = 0 THEN 0 ELSE conf + (part*31 % 10)/10000::DOUBLE END AS o, CASE WHEN part % 2 = 0 THEN conf + (part*31 % 10)/10000::DOUBLE ELSE 0 END AS r FROM boxes)"""


def mean4(value: str) -> str:
    """Average of the values above 0, halves up; 0 where there are none."""
    return f"coalesce(floor(sum({value}::DECIMAL(30,12)) FILTER ({value} > 0)::DOUBLE / count(*) FILTER ({value} > 0) * 10000 + 0.500000001::DOUBLE) / 10000::DOUBLE, 0)"


STATS = f"total_bubbles, count(*) FILTER (t <> '') AS translated_count, count(*) FILTER (s <> '') AS skipped_count, {mean4('o')} AS avg_ocr_conf, {mean4('r')} AS avg_render_score"
OUTCOMES = LEDGER + """, outcomes AS (SELECT event_id // 4 AS page_id, event_id % 4 AS place, stage, event_id % 7 <> 0 AS success, event_id*5 % 11 < 5 AS skipped, event_id % 5 = 0 AS fallback, ms % 5000 AS ms, 'e'||event_id AS error FROM ledger),
 said AS (SELECT *, stage || CASE WHEN skipped THEN ':SKIP' ELSE CASE WHEN success THEN ':OK' ELSE ':ERR' END || CASE WHEN fallback THEN '+fallback' ELSE '' END || ' ' || ms || 'ms' END AS outcome FROM outcomes)"""
ENTRY_ROWS = OUTCOMES + ", " + BUBBLES + f""", o AS (SELECT page_id, count(*) FILTER (NOT skipped AND success) AS n_ok, count(*) FILTER (NOT skipped AND NOT success) AS n_failed, sum(ms) FILTER (NOT skipped) AS ms,
   arg_min(error, place) FILTER (NOT skipped AND NOT success) AS error, string_agg(outcome, ', ' ORDER BY place) AS stages FROM said GROUP BY page_id),
 b AS (SELECT page_id, count(*) AS {STATS} FROM bubbles WHERE page_id % 5 <> 0 GROUP BY page_id),
 page_rows AS (SELECT page_id, 'in/'||page_id||'.png' AS source_path, CASE WHEN n_failed > 0 AND n_ok > 0 THEN 'partial' WHEN n_failed > 0 THEN 'failed' WHEN coalesce(n_ok, 0) = 0 THEN 'skipped' ELSE 'success' END AS status,
   coalesce(total_bubbles, 0) AS total_bubbles, coalesce(translated_count, 0) AS translated_count, coalesce(avg_ocr_conf, 0) AS avg_ocr_conf, coalesce(avg_render_score, 0) AS avg_render_score,
   floor((coalesce(ms, 0) + 5) / 10) / 100::DOUBLE AS elapsed_sec, error, coalesce(stages, '') AS stages FROM (SELECT DISTINCT page_id FROM boxes) LEFT JOIN o USING (page_id) LEFT JOIN b USING (page_id))"""
TRACES = BOXES + """, tr AS (SELECT *, part % 8 AS k, CASE WHEN part % 8 > 2 THEN 't'||part ELSE '' END AS shown, '['||x1||', '||y1||', '||x2||', '||y2||']' AS box, CASE WHEN part % 8 = 0 THEN '(0, 0)' ELSE '('||(y2-y1)||', '||(x2-x1)||')' END AS crop,
   CASE WHEN part % 3 = 0 THEN '()' ELSE '(1, 3, 48)' END AS rec, '('||part % 40||',)' AS logits, ['', '12 !?', 'ÉÉ', '?'][part % 4 + 1] AS decoded FROM boxes)"""


def lines(k: int) -> str:
    return f"""SELECT page_id, reading_order, CASE WHEN (page_id+reading_order+{k}) % 4 = 0 THEN ' ' ELSE text END AS text, ((page_id*13+reading_order*7)*{k} % 100)::DOUBLE/100 AS confidence, (page_id+reading_order) % 5 + 1 AS points FROM talk"""


def scores(k: int) -> str:
    return f"""SELECT page_id, count(*) AS n_lines, count(*) FILTER (v) AS n_valid, coalesce(sum(confidence::DECIMAL(30,12)) FILTER (v), 0) AS total, coalesce(sum(confidence::DECIMAL(30,12)) FILTER (v)::DOUBLE / count(*) FILTER (v), 0) AS avg_conf FROM (SELECT *, len(trim(text)) >= 2 AND confidence >= 0.3 AS v FROM ({lines(k)})) GROUP BY page_id"""


LOGITS = "logits AS (SELECT vec_id, t, list_transform(embedding[t*8+1:t*8+8], lambda x: x::DOUBLE) AS r FROM embeddings, range(0, 8) AS g(t))"
BODY = """'{"translation": "' || p_name || '", "tone": "Sad", "confidence": 0.5}'"""
REPLIES = f"""replies AS (SELECT p_partkey, p_name, p_brand, CASE p_partkey % 8 WHEN 0 THEN {BODY} WHEN 1 THEN 'x' WHEN 2 THEN 'x' WHEN 3 THEN 'cut' WHEN 4 THEN '' WHEN 5 THEN {BODY} WHEN 6 THEN p_name ELSE '' END AS reply FROM part)"""
LAYOUTS = TALK + f""", c AS (SELECT page_id, reading_order, width, {wrapped('text', 'width')} AS lines FROM talk, (VALUES (12), (20), (32)) AS v(width) WHERE regexp_matches(text, '\\S')),
 m AS (SELECT *, list_max(list_transform(lines, lambda x: len(x)))*7 AS w, len(lines)*15 AS h, 42 - width AS font, list_transform(lines, lambda x: len(x)::DOUBLE/list_max(list_transform(lines, lambda y: len(y)))) AS nm, trim(lines[-1]) AS last,
   list_sum(list_transform(lines[:-2], lambda x: len(x)))::DOUBLE/greatest(len(lines)-1, 1) AS mean FROM c),
 q AS (SELECT *, nm[(len(nm)//2)::INT+1] AS mid, (w*h)/96000::DOUBLE AS share, greatest(w/240::DOUBLE, h/400::DOUBLE) AS worst FROM m),
 parts AS (SELECT *, CASE WHEN len(lines) <= 1 THEN 0.85::DOUBLE WHEN len(lines) >= 3 THEN greatest(0, least(1, (CASE WHEN mid = list_max(nm) THEN mid ELSE mid*0.8::DOUBLE END)*(CASE WHEN nm[1] < mid AND nm[-1] < mid THEN 1.1::DOUBLE ELSE 0.85::DOUBLE END))) ELSE greatest(0, least(1, (nm[1]+nm[2])/2)) END AS balance,
   CASE WHEN share < 0.25 THEN share/0.25::DOUBLE*0.6::DOUBLE WHEN share <= 0.78 THEN 0.8::DOUBLE+(share-0.25::DOUBLE)/0.53::DOUBLE*0.2::DOUBLE ELSE greatest(0, 1-(share-0.78::DOUBLE)*3) END AS coverage, (font-9)/33::DOUBLE AS fs,
   CASE WHEN worst <= 0.85 THEN 1::DOUBLE WHEN worst <= 1 THEN 1-(worst-0.85::DOUBLE)*6 ELSE 0 END AS edge,
   CASE WHEN len(lines) = 1 THEN 0.9::DOUBLE WHEN last = '' THEN 0.5 WHEN NOT contains(last, ' ') AND len(lines) > 2 THEN 0.3 WHEN mean > 0 AND len(last)/mean < 0.25 THEN 0.5 ELSE 1 END AS orphan FROM q),
 sc AS (SELECT page_id, reading_order, width, floor(greatest(0, least(1, 0.25::DOUBLE*balance + 0.2::DOUBLE*coverage + 0.2::DOUBLE*fs + 0.2::DOUBLE*edge + 0.15::DOUBLE*orphan))*1e6 + 0.5)::BIGINT AS score_u FROM parts)"""

_EDGE_ROWS = ", ".join(f"('{a}', '{b}')" for a, b in EDGES)
CLOSURE = f"""edges(src, dst) AS (VALUES {_EDGE_ROWS}), reach(stage, downstream) AS (SELECT src, dst FROM edges UNION SELECT r.stage, e.dst FROM reach r JOIN edges e ON e.src = r.downstream)"""
_STAGE_LIST = f"[{quoted(STAGES)}]"

ORACLES: dict[str, str] = {
    "page_overlap_stats": f"""WITH {PAIRS}, o AS (SELECT page_id, i, j FROM pairs WHERE ratio > 0.08),
 t AS (SELECT page_id, count(DISTINCT k) AS n FROM (SELECT page_id, i AS k FROM o UNION ALL SELECT page_id, j FROM o) GROUP BY page_id), c AS (SELECT page_id, count(*) AS n FROM o GROUP BY page_id)
SELECT b.page_id, count(*) AS n_boxes, coalesce(max(c.n), 0) AS n_pairs, coalesce(max(t.n), 0) AS n_touching, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, sum(round(conf*1000)::BIGINT)::BIGINT AS conf_milli
FROM boxes b LEFT JOIN c USING (page_id) LEFT JOIN t USING (page_id) GROUP BY b.page_id""",
    "overlap_neighbours": f"""WITH {PAIRS}, o AS (SELECT page_id, i, j FROM pairs WHERE ratio > 0.08), s AS (SELECT page_id, i, j FROM o UNION ALL SELECT page_id, j, i FROM o)
SELECT b.page_id, b.bubble_id, coalesce(string_agg(s.j::VARCHAR, ',' ORDER BY s.j), '') AS overlap_ids FROM boxes b LEFT JOIN s ON s.page_id = b.page_id AND s.i = b.bubble_id GROUP BY b.page_id, b.bubble_id""",
    "pair_measures": f"WITH {PAIRS} SELECT page_id, i, j, iou, ratio FROM pairs",
    "nms_faithful": nms(False),
    "nms_standard": nms(True),
    "panel_components": f"WITH RECURSIVE {COMPONENTS} SELECT page_id, panel, count(*) AS n, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM panel JOIN boxes USING (page_id, bubble_id) GROUP BY page_id, panel",
    "overlap_groups": f"""WITH {BOXES}, p AS (SELECT page_id, list({{'id': bubble_id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} ORDER BY bubble_id) AS bs FROM boxes GROUP BY page_id),
 g AS (SELECT page_id, unnest({GROUPS}) AS u FROM p) SELECT page_id, u.l AS leader, string_agg(u.id::VARCHAR, ',' ORDER BY u.id) AS members FROM g GROUP BY page_id, u.l""",
    "reading_order": reading_order(COMPONENTS, "boxes"),
    "ordered_pages": reading_order(KEPT_PANELS, "kept"),
    "reading_order_fallback": f"WITH {BOXES} SELECT page_id, bubble_id, row_number() OVER (PARTITION BY page_id ORDER BY y1+y2, x1+x2, bubble_id) - 1 AS reading_order FROM boxes",
    "line_groups": f"""WITH {BOXES}, p AS (SELECT page_id, list({{'id': bubble_id, 'cy': (y1+y2)/2.0::DOUBLE, 'x': x1, 'h': (y2-y1)::DOUBLE}} ORDER BY bubble_id) AS items FROM boxes GROUP BY page_id),
 w AS (SELECT page_id, {rows_of('items', 'greatest(q[1].items[1].h*0.6::DOUBLE, 8)')} AS rs FROM p), r1 AS (SELECT page_id, generate_subscripts(rs, 1) AS ri, unnest(rs) AS r FROM w),
 r2 AS (SELECT page_id, dense_rank() OVER (PARTITION BY page_id ORDER BY r.t/r.n, ri) - 1 AS g, r.items AS items FROM r1), r3 AS (SELECT page_id, g, generate_subscripts(items, 1) AS k, unnest(items) AS o FROM r2)
SELECT page_id, o.id AS bubble_id, g AS line_group_id, row_number() OVER (PARTITION BY page_id ORDER BY g, o.x, k) - 1 AS reading_order FROM r3""",
    "clip_boxes": f"WITH {BOXES} SELECT page_id, bubble_id, {_CX[0]} AS x1, {_CY[0]} AS y1, {_CX[1]} AS x2, {_CY[1]} AS y2 FROM boxes",
    "classify_and_threshold": f"""WITH {BOXES}, n AS (SELECT *, part % 9 AS cls, lower(['text_free','Panel','caption box','SFX','sound_effect','bubble','narration','background','text'][part % 9 + 1]) AS name FROM boxes),
 k AS (SELECT *, CASE WHEN regexp_matches(name, 'narr|box|caption') THEN 'narration' WHEN regexp_matches(name, 'sfx|sound|effect') THEN 'sfx' ELSE 'bubble' END AS kind FROM n WHERE NOT regexp_matches(name, 'text_free|free|panel|background') AND cls < 8)
SELECT page_id, bubble_id, kind FROM k WHERE conf >= CASE kind WHEN 'narration' THEN 0.40 WHEN 'sfx' THEN 0.18 ELSE 0.25 END AND x2-x1 >= 20 AND y2-y1 >= 15 AND (x2-x1)*(y2-y1) <= 0.70*1400000""",
    "bbox_validity": f"""WITH {BOXES}, c AS (SELECT page_id, bubble_id, greatest(0, least(x1+bubble_id-2, 680)) - greatest(0, least(x1, 680)) AS w, greatest(0, least(y1+part % 9, 880)) - greatest(0, least(y1, 880)) AS h FROM boxes)
SELECT page_id, bubble_id, CASE WHEN w <= 0 OR h <= 0 THEN 'INVALID' WHEN w < 4 OR h < 4 THEN 'TINY' ELSE 'OK' END AS status FROM c""",
    "geometry_scalars": f"""WITH {BOXES}, q AS (SELECT *, [[x1, y1+bubble_id], [x2, y1], [x2-bubble_id, y2], [x1, y2]] AS p FROM boxes),
 u AS (SELECT *, [p[3], p[1], p[4], p[2]] AS s FROM q),
 o AS (SELECT *, (SELECT arg_min(z.v[1], z.v[1]+z.v[2]) FROM (SELECT unnest(s) AS v) z) AS tl_x, (SELECT arg_max(z.v[2], z.v[1]+z.v[2]) FROM (SELECT unnest(s) AS v) z) AS br_y FROM u)
SELECT page_id, bubble_id, x1, least(y1+bubble_id, y1)::INT AS y1, x2, y2, floor(degrees(atan2((-bubble_id)::DOUBLE, (x2-x1)::DOUBLE))*1e6)::BIGINT AS rotation_u,
 floor((sqrt(((y2-y1-bubble_id)::DOUBLE)**2) + sqrt((bubble_id::DOUBLE)**2 + ((y2-y1)::DOUBLE)**2))/2*1e6)::BIGINT AS height_u, tl_x::DOUBLE AS tl_x, br_y::DOUBLE AS br_y,
 floor(((x2-x1)+2*((x2-x1)::DOUBLE*(y2-y1)*1.6::DOUBLE/(2*((x2-x1)+(y2-y1)))))*1000+0.5)::BIGINT AS grown_w, floor(((y2-y1)+2*((x2-x1)::DOUBLE*(y2-y1)*1.6::DOUBLE/(2*((x2-x1)+(y2-y1)))))*1000+0.5)::BIGINT AS grown_h,
 trunc((x1/1000::DOUBLE)*777)::INT AS px FROM o""",
    "shape_class": f"""WITH {BOXES}, a AS (SELECT *, (x2-x1)::DOUBLE/(y2-y1) AS aspect, (part % 50 + 50)::DOUBLE/100 AS fill, part % 17 AS corners FROM boxes),
 s AS (SELECT *, CASE WHEN aspect < 0.55 THEN 'TALL' WHEN aspect > 2.2 THEN 'WIDE' WHEN fill > 0.90 AND aspect > 0.8 AND corners <= 6 THEN 'RECTANGLE' WHEN fill < 0.65 THEN 'IRREGULAR' WHEN corners > 12 THEN 'IRREGULAR' ELSE 'ELLIPSE' END AS shape FROM a),
 m AS (SELECT *, greatest(6, trunc((x2-x1)*(CASE shape WHEN 'ELLIPSE' THEN 0.18::DOUBLE WHEN 'TALL' THEN 0.12::DOUBLE+0.05::DOUBLE ELSE 0.12::DOUBLE END))::INT) AS px, greatest(6, trunc((y2-y1)*(CASE shape WHEN 'ELLIPSE' THEN 0.15::DOUBLE ELSE 0.12::DOUBLE END))::INT) AS py FROM s)
SELECT page_id, bubble_id, shape, x1+px AS sx1, y1+py AS sy1, x2-px AS sx2, y2-py AS sy2 FROM m""",
    "confidence_gate": f"""WITH {GATED} SELECT doc_id, trim(text) <> '' AND confidence >= 0.5 AND doc_id % 5 + 1 >= 3 AS valid, confidence < 0.7 AS below, confidence >= 0.75 AS above, true AS always, doc_id % 3 = 0 AND confidence >= 0.98 AS preserve FROM gated""",
    "effective_text": """WITH t AS (SELECT doc_id, doc_id % 4 = 0 AS manual, CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'refined-'||source END AS refined, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'translated-'||source END AS translated, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'corrected-'||source END AS corrected, lang AS raw FROM documents)
SELECT doc_id, CASE WHEN manual AND coalesce(translated, '') <> '' THEN translated ELSE coalesce(nullif(refined, ''), nullif(translated, ''), nullif(corrected, ''), nullif(raw, ''), '') END AS effective, coalesce(nullif(corrected, ''), nullif(raw, ''), '') AS ocr FROM t""",
    "render_hash": """WITH h AS (SELECT doc_id, source, left(md5(text||'|bubble|neutral|['||(doc_id % 97)||', '||(doc_id*2 % 97)||', '||(doc_id*3 % 97)||', '||(doc_id*5 % 97)||']|'), 12) AS render_hash FROM documents)
SELECT doc_id, render_hash, doc_id % 9 = 0 OR render_hash <> left(md5(source), 12) AS dirty FROM h""",
    "source_hash": "SELECT page_id, left(md5(html), 16) AS hash FROM pages",
    "sfx_flags": f"WITH {SHOUTS} SELECT page_id, reading_order, {sfx('t')} AS sfx, len(t) > 1 AND NOT regexp_matches(t, '\\p{{L}}') AS garbage, left(translate(t, '/ ', '__'), 30) AS label FROM shouts",
    "style_hints": f"""WITH {SHOUTS}, w AS (SELECT *, list_filter(regexp_split_to_array(t, '\\s+'), lambda x: x <> '') AS ws FROM shouts), c AS (SELECT *, len(list_filter(ws, lambda x: len(x) > 1 AND x = upper(x) AND x <> lower(x))) AS caps FROM w)
SELECT page_id, reading_order, len(ws) AS n_words, caps AS n_caps, caps*2 > len(ws) AS dominant_caps, len(t) - len(replace(t, chr(10), '')) + 1 AS n_lines FROM c""",
    "catalogue_names": f"WITH {FONTS} SELECT p_partkey, family, style, CASE p_partkey % 3 WHEN 1 THEN 'left' ELSE 'center' END AS align FROM fonts",
    "font_families": f"WITH {FONTS} SELECT string_agg(DISTINCT family, ',' ORDER BY family) AS families FROM fonts",
    "wrap_text": f"""WITH {TALK}, l AS (SELECT page_id, reading_order, {wrapped('text', '(CASE WHEN page_id % 2 = 0 THEN trunc((page_id % 30 + 12)*0.82::DOUBLE)::INT ELSE page_id % 30 + 12 END)')} AS ls FROM talk),
 s AS (SELECT *, string_split(ls[-2], ' ') AS b FROM l)
SELECT page_id, reading_order, coalesce(array_to_string(CASE WHEN len(ls) >= 2 AND NOT contains(ls[-1], ' ') AND len(b) > 1 THEN list_concat(ls[:-3], [array_to_string(b[:-2], ' '), b[-1]||' '||ls[-1]]) ELSE ls END, '|'), '') AS lines FROM s""",
    "prompts": f"""WITH {TALK}, c AS (SELECT *, list(text) OVER (PARTITION BY page_id ORDER BY reading_order ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS ctx, CASE WHEN page_id % 3 = 0 THEN 'angry' ELSE 'neutral' END AS tone FROM talk),
 p AS (SELECT *, CASE WHEN coalesce(len(ctx), 0) > 0 THEN 'Earlier:'||chr(10)||array_to_string(list_transform(ctx, lambda x: '- '||x), chr(10))||chr(10) ELSE '' END AS head, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS n FROM c)
SELECT page_id, reading_order, md5(head || CASE WHEN n = 1 THEN 'Translate this word ('||tone||'): '||text ELSE 'Scene: Panel; tone: '||tone||'; kind: '||role||chr(10)||'Translate: '||text END) AS prompt_md5 FROM p""",
    "adaptive_type": """WITH s AS (SELECT p_partkey, p_size % 34 + 6 AS f FROM part)
SELECT p_partkey, CASE WHEN f <= 12 THEN 3 WHEN f >= 28 THEN 1 ELSE greatest(1, round_even(3-(f-12)/16.0::DOUBLE*2, 0)::INT) END AS outline, CASE WHEN f <= 12 THEN 2 WHEN f >= 28 THEN 1 ELSE greatest(1, round_even(2-(f-12)/16.0::DOUBLE*1, 0)::INT) END AS outline_box,
 CASE WHEN f <= 12 THEN 1.22::DOUBLE*1.15::DOUBLE WHEN f >= 28 THEN 1.22::DOUBLE*0.95::DOUBLE ELSE 1.22::DOUBLE END AS spacing FROM s""",
    "resize_plan": """WITH s AS (SELECT p_partkey, p_size, (p_size*97+13)::INT AS w, (p_partkey % 4000 + 1)::INT AS h FROM part), f AS (SELECT *, CASE WHEN greatest(w, h) > 2560 THEN 2560::DOUBLE/greatest(w, h) ELSE 1 END AS factor FROM s)
SELECT p_partkey, factor, trunc(w/factor)::INT AS w2, ((8 - w % 8) % 8)::INT AS pad, greatest(32, (round_even(trunc(w*factor)::INT/32::DOUBLE, 0)*32)::INT) AS grid,
 greatest(10, least(10+floor((w-10-p_size)/2::DOUBLE)::INT, greatest(10, w-p_size))) AS at FROM f""",
    "gamma_blend": """WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings), v AS (SELECT vec_id, pos, abs(x)/(1+abs(x)) AS v FROM e),
 l AS (SELECT vec_id, pos, (CASE WHEN v <= 0.04045 THEN v/12.92::DOUBLE ELSE pow((v+0.055::DOUBLE)/1.055::DOUBLE, 2.4::DOUBLE) END)*0.5 + pow((0.25::DOUBLE+0.055::DOUBLE)/1.055::DOUBLE, 2.4::DOUBLE)*0.5 AS m FROM v)
SELECT vec_id, pos, round((CASE WHEN m <= 0.0031308 THEN m*12.92::DOUBLE ELSE 1.055::DOUBLE*pow(m, (1/2.4::DOUBLE)) - 0.055::DOUBLE END)*1e6)::BIGINT AS blend_u FROM l""",
    "layout_score": f"WITH {LAYOUTS} SELECT page_id, reading_order, width, score_u FROM sc",
    "best_candidate": f"WITH {LAYOUTS}, r AS (SELECT *, row_number() OVER (PARTITION BY page_id, reading_order ORDER BY score_u DESC, width) AS n FROM sc) SELECT page_id, reading_order, width FROM r WHERE n = 1",
    "largest_font": f"WITH {TALK} SELECT page_id, reading_order, coalesce((SELECT max(s) FROM range(9, 43) AS g(s) WHERE len(text)*s*s <= 60000), 9)::INT AS size FROM talk",
    "page_stats": f"WITH {BUBBLES} SELECT page_id, count(*) AS {STATS}, count(*) FILTER (o > 0) AS n_conf, count(*) FILTER (r > 0) AS n_score FROM bubbles GROUP BY page_id",
    "manifest_rollup": f"""WITH {ENTRIES}, m AS (SELECT page_id, count(*) AS total, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'partial') AS partial, sum(bubbles)::BIGINT AS bubbles, {mean4('avg_ocr_conf')} AS avg_ocr_conf, {mean4('avg_render_score')} AS avg_render_score FROM entries GROUP BY page_id)
SELECT *, (CASE WHEN failed = 0 THEN 0 WHEN failed = total THEN 2 ELSE 1 END)::BIGINT AS exit_code FROM m""",
    "providers_summary_corrected": f"WITH {ENTRIES}, x AS (SELECT 'ocr:'||stage AS provider FROM entries UNION ALL SELECT 'inpaint:'||inpaint FROM entries) SELECT provider, count(*) AS n FROM x GROUP BY provider",
    "providers_summary_faithful": f"""WITH {ENTRIES}, k AS (SELECT *, count(*) OVER () - row_number() OVER (ORDER BY pos) + 1 AS w FROM entries), x AS (SELECT 'ocr:'||stage AS provider, w FROM k UNION ALL SELECT 'inpaint:'||inpaint, w FROM k) SELECT provider, sum(w)::BIGINT AS n FROM x GROUP BY provider""",
    "stage_timings": f"WITH {LEDGER} SELECT page_id, stage, arg_max(ms, (ts, event_id)) AS ms, count(*) AS runs FROM ledger GROUP BY page_id, stage",
    "audit_counts": f"WITH {GATED} SELECT lang, count(*) AS total, count(*) FILTER (confidence >= 0.4) AS usable, count(*) FILTER (toxic = 1) AS fallback, count(*) FILTER (doc_id % 2 = 0) AS translated, count(*) FILTER (doc_id % 6 = 0) AS inpainted FROM gated GROUP BY lang",
    "status_counts": f"WITH {GATED} SELECT CASE WHEN trim(text) = '' THEN 'empty' WHEN confidence IS NULL THEN 'invalid_crop' ELSE 'ok' END AS status, count(*) AS n FROM gated GROUP BY 1",
    "budget_report": "WITH n AS (SELECT p_brand, (p_size*7-100)/16::DOUBLE AS need FROM part), r AS (SELECT p_brand, coalesce(sum(need) FILTER (need > 0), 0) AS s FROM n GROUP BY p_brand) SELECT p_brand, floor(s*10+0.5)/10::DOUBLE AS need, 470.5-s >= 0 AS safe, 470.5-s < 40.25 AS suggest FROM r",
    "preflight": """WITH i AS (SELECT p_type AS label, CASE WHEN p_partkey % 40 = 0 THEN 3 ELSE p_size % 3 END AS s FROM part) SELECT label, ['ok','info','warn','error'][max(s)+1] AS worst, max(s) = 3 AS failed FROM i GROUP BY label""",
    "median_background": "SELECT l_suppkey, median(l_quantity) AS median, count(l_quantity) AS n FROM lineitem GROUP BY l_suppkey",
    "homogeneity": "WITH s AS (SELECT l_suppkey, count(*) AS n, count(*) FILTER (l_quantity > 2) AS n_white, stddev_pop(l_quantity) AS sd FROM lineitem GROUP BY l_suppkey) SELECT l_suppkey, n, n_white, floor(sd*1e6)::BIGINT AS sd_u, n_white >= n*0.97 OR sd < 14.3 AS simple FROM s",
    "patch_similarity": """WITH p AS (SELECT a.vec_id, generate_subscripts(a.embedding, 1) AS k, unnest(a.embedding)::DOUBLE AS x, unnest(b.embedding)::DOUBLE AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
 s AS (SELECT vec_id, 1/(1+100*(list_reduce(list_concat([0::DOUBLE], list((x-y)*(x-y) ORDER BY k)), lambda u, v: u+v)/count(*))) AS s FROM p GROUP BY vec_id) SELECT vec_id, floor(s*1e9+0.5)::BIGINT AS similarity_n, s >= 0.98 AS preserve FROM s""",
    "ctc_decode": f"""WITH {LOGITS}, b AS (SELECT vec_id, t, list_position(r, list_max(r)) - 1 AS x, 1/(list_reduce(list_concat([0::DOUBLE], list_transform(r, lambda v: exp(v-list_max(r)))), lambda u, v: u+v)+1e-9::DOUBLE) AS p FROM logits),
 l AS (SELECT *, coalesce(lag(x) OVER (PARTITION BY vec_id ORDER BY t), -1) AS prev FROM b), k AS (SELECT * FROM l WHERE x > 0 AND x <> prev AND x < 7)
SELECT e.vec_id, coalesce(string_agg(substr('abcdef', k.x::INT, 1), '' ORDER BY k.t), '') AS text, coalesce(floor(list_reduce(list_concat([0::DOUBLE], list(k.p ORDER BY k.t) FILTER (k.p IS NOT NULL)), lambda u, v: u+v)/count(k.p)*1e9+0.5), 0)::BIGINT AS confidence_n FROM embeddings e LEFT JOIN k USING (vec_id) GROUP BY e.vec_id""",
    "ctc_orientation": """WITH a AS (SELECT vec_id, t, s, embedding[t*8+s+1] AS v FROM embeddings, range(0, 8) AS g(t), range(0, 8) AS h(s)), c AS (SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN t ELSE s END AS step, CASE WHEN vec_id % 2 = 0 THEN s ELSE t END AS sym, v FROM a WHERE CASE WHEN vec_id % 2 = 0 THEN t < 5 ELSE s < 5 END),
 b AS (SELECT vec_id, step, arg_min(sym, (-v, sym)) AS x FROM c GROUP BY vec_id, step) SELECT vec_id, vec_id % 2 = 1 AS turned, string_agg(x::VARCHAR, ',' ORDER BY step) AS path FROM b GROUP BY vec_id""",
    "top_symbols": """WITH a AS (SELECT vec_id, s, row_number() OVER (PARTITION BY vec_id ORDER BY embedding[s+1] DESC, s) AS n FROM embeddings, range(0, 8) AS h(s)) SELECT vec_id, string_agg(s::VARCHAR, ',' ORDER BY n) AS top FROM a WHERE n <= 5 GROUP BY vec_id""",
    "ocr_scores": f"""WITH {TALK}, s AS ({scores(1)}) SELECT page_id, n_lines, n_valid, avg_conf, CASE WHEN n_valid < 1 THEN 'none valid' WHEN total < n_valid*0.4 THEN 'low confidence' ELSE 'ok' END AS reason, n_valid >= 1 AND total >= n_valid*0.4 AS usable FROM s""",
    "ocr_page_text": f"""WITH {TALK}, l AS (SELECT *, trim(text) <> '' AND confidence >= 0.5 AND points >= 3 AS v FROM ({lines(1)})), m AS (SELECT page_id, CASE WHEN v THEN confidence ELSE 0 END AS c, text, v, reading_order FROM l)
SELECT page_id, trim(coalesce(string_agg(text, ' ' ORDER BY reading_order, text) FILTER (v), '')) AS text, count(*) FILTER (v) AS n, {mean4('c')} AS confidence FROM m GROUP BY page_id""",
    "backend_choice": f"""WITH {TALK}, p AS ({scores(1)}), s AS ({scores(3)}) SELECT page_id, CASE WHEN p.n_valid >= 1 AND p.total >= p.n_valid*0.4 THEN 'primary' WHEN s.n_valid > p.n_valid OR (s.n_valid = p.n_valid AND s.avg_conf > p.avg_conf) THEN 'secondary' ELSE 'primary' END AS chosen FROM p JOIN s USING (page_id)""",
    "circuit_breaker": f"""WITH {LEDGER}, f AS (SELECT page_id, event_id, usable, lag(usable, 1) OVER w AS u1, lag(usable, 2) OVER w AS u2 FROM ledger WINDOW w AS (PARTITION BY page_id ORDER BY event_id)),
 d AS (SELECT page_id, min(event_id) AS off FROM f WHERE NOT usable AND NOT u1 AND NOT u2 GROUP BY page_id) SELECT l.page_id, l.event_id, coalesce(l.event_id > d.off, false) AS primary_disabled FROM ledger l LEFT JOIN d USING (page_id)""",
    "translation_routing": f"WITH {ROUTED} SELECT page_id, reading_order, route FROM routed",
    "context_window": f"WITH {ROUTED}, e AS (SELECT page_id, reading_order, list(upper(t)) OVER (PARTITION BY page_id ORDER BY reading_order ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS c FROM routed WHERE route IN ('context', 'translate')) SELECT page_id, reading_order, coalesce(array_to_string(c, '|'), '') AS context FROM e",
    "json_salvage_translation": """WITH s AS (SELECT p_partkey, p_partkey % 8 AS k, trim(p_name) AS name, trim(upper(p_brand)) AS brand, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_brand END AS source FROM part),
 f AS (SELECT *, CASE WHEN k IN (0, 1, 2, 5) THEN name WHEN k = 7 THEN brand ELSE '' END AS found FROM s) SELECT p_partkey, CASE WHEN lower(found) = lower(trim(source)) THEN '' ELSE found END AS translation FROM f""",
    "json_salvage_visual": """SELECT p_partkey, CASE WHEN p_partkey % 8 IN (0, 1, 2, 5) THEN 'sad' ELSE 'neutral' END AS tone, CASE WHEN p_partkey % 8 IN (0, 1, 2, 5, 7) THEN 'Comic panel.' ELSE '' END AS scene, CASE WHEN p_partkey % 8 IN (0, 1, 2, 5, 7) THEN 0.85::DOUBLE ELSE 0 END AS confidence,
 CASE WHEN p_partkey % 8 IN (0, 1, 2, 5) THEN 53 + len(p_name) WHEN p_partkey % 8 = 7 THEN 21 + len(p_brand) END AS flat_length FROM part""",
    "json_salvage_cloud": """WITH p AS (SELECT p_partkey, p_brand, p_name FROM part WHERE p_partkey % 5 <> 0) SELECT p_partkey, p_partkey AS bubble_id, p_brand AS source_text, '' AS translated_text, '' AS speaker, 0.25::DOUBLE AS confidence FROM p UNION ALL SELECT p_partkey, 2, '', p_name, '', 0 FROM p""",
    "json_salvage_grounding": """WITH p AS (SELECT p_partkey, p_brand, p_size FROM part WHERE p_partkey % 5 <> 0) SELECT p_partkey, 0::BIGINT AS reading_order, trunc(p_size/1000::DOUBLE*777)::INT AS x1, 11 AS y1, trunc(900.5::DOUBLE/1000*777)::INT AS x2, 555 AS y2, p_brand AS text, 0.9::DOUBLE AS confidence FROM p
 UNION ALL SELECT p_partkey, 2, 0, 0, 777, 1111, '', 0.9 FROM p""",
    "dag_closure": f"WITH RECURSIVE {CLOSURE} SELECT DISTINCT stage, downstream FROM reach",
    "dirty_after_change": f"""WITH RECURSIVE {CLOSURE}, e AS (SELECT event_id // 3 AS page_id, event_id, {_STAGE_LIST}[(event_id*7 % 9)::INT + 1] AS stage FROM events), c AS (SELECT DISTINCT page_id, stage FROM e WHERE event_id % 3 < 2), done AS (SELECT page_id, stage FROM e WHERE event_id % 3 = 2),
 d AS (SELECT page_id, stage FROM c UNION SELECT c.page_id, r.downstream FROM c JOIN reach r USING (stage)) SELECT page_id, stage FROM d EXCEPT SELECT page_id, stage FROM done""",
    "change_detection": """WITH s AS (SELECT doc_id AS page_id FROM documents WHERE doc_id % 3 <> 0), o AS (SELECT doc_id AS page_id, doc_id % 5 = 0 AS other FROM documents WHERE doc_id % 7 <> 0)
SELECT coalesce(s.page_id, o.page_id) AS page_id, CASE WHEN o.page_id IS NULL THEN 'new' WHEN s.page_id IS NULL THEN 'gone' WHEN o.other THEN 'changed' ELSE 'same' END AS status FROM s FULL JOIN o ON s.page_id = o.page_id""",
    "carry_over": f"WITH {BOXES} SELECT page_id, bubble_id, CASE WHEN part % 6 = 0 AND part % 4 <> 1 THEN 'old' ELSE 'new' END || part AS text, part % 6 = 0 AND part % 4 <> 1 AS manually_edited FROM boxes",
    "cloud_merge": f"""WITH {BOXES}, r AS (SELECT page_id, bubble_id % 3 AS bubble_id, arg_max('r'||part, bubble_id) AS t FROM boxes GROUP BY page_id, bubble_id % 3), j AS (SELECT b.*, r.t, r.t IS NOT NULL AND part % 6 <> 0 AS use FROM boxes b LEFT JOIN r USING (page_id, bubble_id))
SELECT page_id, bubble_id, part % 6 = 0 AS manually_edited, CASE WHEN use THEN t ELSE 'raw' END AS text, CASE WHEN use THEN 0 ELSE conf END AS confidence, use AS replaced FROM j""",
    "positional_enrich": f"""WITH {BOXES}, r AS (SELECT page_id, part, row_number() OVER (PARTITION BY page_id ORDER BY bubble_id) - 1 AS bubble_id FROM boxes WHERE part % 3 <> 0) SELECT b.page_id, b.bubble_id, r.part FROM boxes b JOIN r USING (page_id, bubble_id) WHERE b.part % 6 <> 0""",
    "cache_hits": f"WITH {BOXES} SELECT page_id, bubble_id, part % 3 <> 0 AND part % 4 <> 0 AS hit FROM boxes",
    "dirty_bubbles": f"WITH {BOXES} SELECT page_id, bubble_id FROM boxes WHERE part % 10 = 0 OR NOT (part % 3 <> 0 AND part % 4 <> 0 AND page_id % 4 <> 0)",
    "model_match": """WITH i AS (SELECT 'Brand#'||(r_regionkey+21)||':13b' AS n FROM region), c AS (SELECT DISTINCT p_brand||':7b' AS name, p_brand AS base FROM part) SELECT name, EXISTS (SELECT 1 FROM i WHERE contains(i.n, base) OR i.n = name) AS found FROM c""",
    "model_pick": """SELECT coalesce((SELECT n_name FROM nation WHERE n_name IN ('none', 'NATION_7', 'FRANCE', 'PERU') ORDER BY list_position(['none', 'NATION_7', 'FRANCE', 'PERU'], n_name) LIMIT 1), (SELECT n_name FROM nation ORDER BY n_nationkey LIMIT 1)) AS model""",
    "page_documents": f"WITH {BOXES} SELECT page_id, bubble_id, x2, CASE WHEN bubble_id % 2 = 0 THEN conf ELSE 0 END AS detection_conf, 'neutral' AS tone, -1 AS reading_order, false AS manually_edited FROM boxes",
    "stream_ledger": "SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n, sum(floor(value*100)::BIGINT)::BIGINT AS cents FROM events GROUP BY 1, 2",
    "stream_sessions_batch": """WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""",
    "stage_cube": f"WITH {LEDGER} SELECT stage, page_id % 10 AS page_bucket, count(*) AS n, sum(ms)::BIGINT AS ms FROM ledger GROUP BY CUBE (stage, page_id % 10)",
    "audit_frame": f"""WITH {TRACES} SELECT page_id, bubble_id AS layout_id, box AS bbox, crop AS crop_shape, part % 4 AS det_boxes_count, part % 4 = 0 AS det_failed, rec AS rec_input_shape, logits AS logits_shape, part % 5 = 0 AS needs_transpose, shown AS decoded_own, '' AS decoded_transposed,
 shown AS final_text, k > 2 AS usable, k = 3 AS fallback_used, k > 4 AS translated, CASE WHEN k > 4 THEN 'x' ELSE '' END AS translated_text, k = 7 AS inpainted FROM tr""",
    "audit_summary": f"""WITH {TRACES} SELECT page_id, count(*) AS total, count(*) FILTER (k > 2) AS usable, count(*) FILTER (k = 3) AS fallback, count(*) FILTER (part % 5 = 0) AS turned, count(*) FILTER (k > 4) AS translated, count(*) FILTER (k = 7) AS inpainted,
 round_even(count(*) FILTER (k > 2) / count(*) * 100, 0)::BIGINT AS usable_pct FROM tr GROUP BY page_id""",
    "diagnosis_frame": f"""WITH {TRACES} SELECT page_id, bubble_id AS idx, box AS bbox, '['||x1||', '||y1||', '||least(x2, 700)||', '||least(y2, 900)||']' AS bbox_clamped, crop AS crop_shape, CASE WHEN k = 0 AND part % 3 = 0 THEN 'empty crop' ELSE '' END AS skip_reason, '(64, 64)' AS det_input_hw, part % 3 AS polygon_count,
 '()' AS persp_size, '(0, 0)' AS persp_crop_hw, rec AS rec_input_shape, logits AS logits_shape, part % 5 = 0 AS needs_transpose, decoded AS decoded_text, floor((conf + part % 7 / 10000::DOUBLE)*10000 + 0.5)::BIGINT AS conf, k = 3 AS fallback_used FROM tr""",
    "diagnosis_counts": f"""WITH {TRACES} SELECT page_id, count(*) FILTER (k <> 0) AS crop_valid, count(*) FILTER (k = 0) AS crop_zero, count(*) FILTER (k = 0 AND part % 3 <> 0) AS untraced, count(*) FILTER (k <> 0 AND part % 3 = 0) AS poly_zero, count(*) FILTER (decoded = '12 !?') AS garbage FROM tr GROUP BY page_id""",
    "trace_match": f"""WITH {BOXES}, f AS (SELECT page_id, x1, y1, x2, y2, min(bubble_id) AS idx FROM boxes GROUP BY ALL), c AS (SELECT b.page_id, b.bubble_id, CASE WHEN b.part % 3 <> 0 THEN f.idx END AS idx FROM boxes b JOIN f USING (page_id, x1, y1, x2, y2))
SELECT page_id, bubble_id AS call, last_value(idx IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY bubble_id) AS idx FROM c""",
    "normalisation_verdict": "SELECT p_partkey, CASE WHEN p_size > p_partkey % 47 * 1.5 THEN 'first' WHEN p_partkey % 47 > p_size * 1.5 THEN 'second' ELSE 'similar' END AS verdict FROM part",
    "stage_outcomes": f"WITH {OUTCOMES} SELECT page_id, place, outcome FROM said",
    "page_entries": f"WITH {ENTRY_ROWS} SELECT * FROM page_rows",
    "batch_manifest": f"""WITH {ENTRY_ROWS}, m AS (SELECT page_id % 10 AS bucket, count(*) AS total, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'partial') AS partial, sum(total_bubbles)::BIGINT AS bubbles,
 {mean4('avg_ocr_conf')} AS avg_ocr_conf, {mean4('avg_render_score')} AS avg_render_score FROM page_rows GROUP BY 1) SELECT *, (CASE WHEN failed = 0 THEN 0 WHEN failed = total THEN 2 ELSE 1 END)::BIGINT AS exit_code FROM m""",
    "page_save": f"""WITH {BUBBLES} SELECT page_id, count(*) AS {STATS}, '2024-05-06T07:08:09' AS processed_at FROM bubbles GROUP BY page_id""",
    "cache_put": f"""WITH {BOXES}, h AS (SELECT page_id, bubble_id, part, left(md5(part::VARCHAR), 12) AS render_hash FROM boxes), c AS (SELECT page_id, bubble_id, CASE WHEN part % 4 = 0 THEN 'stale' ELSE render_hash END AS render_hash, part FROM h WHERE part % 3 <> 0)
SELECT page_id, bubble_id, render_hash, 'old' AS layer FROM c WHERE page_id <> 3 AND NOT (part % 5 = 0 AND part % 4 <> 0) UNION ALL SELECT page_id, bubble_id, render_hash, 'new' FROM h WHERE page_id <> 3 AND part % 5 = 0""",
    "json_salvage_leading": """SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN '{"a": "'||p_name||'}"}' WHEN 1 THEN '{"a": {"b": [1, {"c": "'||p_name||'"}]}}' WHEN 4 THEN '{"a": "\\"}'||p_name||'"}' WHEN 6 THEN '{}' END AS object FROM part""",
}
