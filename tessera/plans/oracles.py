"""The registered queries as SQL for a second engine, on the same tables."""

from __future__ import annotations

from tessera.functions import vocabulary as V

SQL: dict[str, str] = {}

_FEATURE_GROUPS = [g for g in V.PROMPTS if g != "baseline"]


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _words(column: str, words: dict[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN {column} = {_quote(k)} THEN {_quote(w)}" for k, w in words.items()) + f" ELSE {column} END"


def _filled(template: str, **values: str) -> str:
    out = _quote(template)
    for name, sql in values.items():
        out = f"replace({out}, '{{{name}}}', {sql})"
    return out


def _level(value: str, names=("low", "mid", "high")) -> str:
    return f"([{', '.join(map(_quote, names))}])[1 + {value} % {len(names)}]"


def _bin(value: str, size: str) -> str:
    return f"CAST(round_even(greatest(0.0::DOUBLE, least(1023.0::DOUBLE, {value} / {size} * 1024)), 0) AS INTEGER)"


def _tokens(x0="x0", y0="y0", x1="x1", y1="y1") -> str:
    return f"printf('<loc%04d><loc%04d><loc%04d><loc%04d>', {_bin(y0, 'h')}, {_bin(x0, 'w')}, {_bin(y1, 'h')}, {_bin(x1, 'w')})"


def _decoded(text: str, nth: int = 1) -> str:
    """The boxes of a text as a list of structs."""
    part = lambda k: f"regexp_extract_all({text}, '<loc(\\d{{4}})><loc(\\d{{4}})><loc(\\d{{4}})><loc(\\d{{4}})>', {k})"
    return f"list_transform(list_zip({part(2)}, {part(1)}, {part(4)}, {part(3)}), lambda z: {{'x0': CAST(z[1] AS DOUBLE) / 1024 * w, 'y0': CAST(z[2] AS DOUBLE) / 1024 * h, 'x1': CAST(z[3] AS DOUBLE) / 1024 * w, 'y1': CAST(z[4] AS DOUBLE) / 1024 * h}})"


def _iou(a: str, b: str = "") -> str:
    """a, b: prefixes of the corners."""
    inter = f"(greatest(0.0::DOUBLE, least({a}x1, {b}x1) - greatest({a}x0, {b}x0)) * greatest(0.0::DOUBLE, least({a}y1, {b}y1) - greatest({a}y0, {b}y0)))"
    union = f"(({a}x1 - {a}x0) * ({a}y1 - {a}y0) + ({b}x1 - {b}x0) * ({b}y1 - {b}y0) - {inter})"
    return f"coalesce(CASE WHEN {a}x0 IS NOT NULL AND {b}x0 IS NOT NULL AND {union} > 0 THEN {inter} / {union} END, 0.0::DOUBLE)"


def _mill(x: str) -> str:
    return f"CAST(floor({x} * 1e6::DOUBLE + 0.5::DOUBLE) AS BIGINT)"


def _mean(x: str) -> str:
    return f"(CAST(sum({_mill(x)}) AS BIGINT) / (count({x}) * 1e6::DOUBLE))"


def _third(x: str, names) -> str:
    return f"CASE WHEN {x} < 1.0::DOUBLE / 3 THEN '{names[0]}' WHEN {x} < 2.0::DOUBLE / 3 THEN '{names[1]}' ELSE '{names[2]}' END"


def _hash(key: str, salt: str = "") -> str:
    return f"CAST('0x' || substr(sha1({_quote(salt) + ' || ' if salt else ''}{key}), 1, 8) AS BIGINT)"


_H, _Vv, _SH = ("left", "center", "right"), ("upper", "middle", "lower"), "CASE WHEN aspect_ratio > 1.5::DOUBLE THEN 'wide' WHEN aspect_ratio < 0.67::DOUBLE THEN 'tall' ELSE 'compact' END"
IMAGES = """images AS (SELECT o_orderkey AS image, o_custkey || '_' || o_orderkey || '.png' AS name, CAST(o_custkey AS VARCHAR) AS patient,
  CASE WHEN o_custkey % 79 < 55 THEN 'train' WHEN o_custkey % 79 < 62 THEN 'valid' ELSE 'test' END AS split,
  512.0::DOUBLE AS w, ([512.0::DOUBLE, 555.0::DOUBLE, 588.0::DOUBLE])[1 + o_orderkey % 3] AS h FROM orders)"""
LESIONS = (
    IMAGES
    + f""",
ann AS (SELECT l_orderkey AS image, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS INTEGER) AS ord,
  l_partkey AS pk, l_suppkey AS sk, CAST(l_linenumber AS BIGINT) AS ln, CAST(l_quantity AS BIGINT) AS q FROM lineitem),
xywh AS (SELECT *, CAST((pk * 37 + ln * 91) % 380 AS DOUBLE) AS x0, CAST((sk * 53 + pk * 17 + ln * 29) % 380 AS DOUBLE) AS y0,
  CAST(6 + (q * 7 + pk) % 110 AS DOUBLE) AS bbox_width, CAST(6 + (q * 3 + ln * 13 + pk * 5) % 110 AS DOUBLE) AS bbox_height FROM ann),
les AS (SELECT image, ord, pk, sk, ln, q, x0, y0, x0 + bbox_width AS x1, y0 + bbox_height AS y1, bbox_width, bbox_height, name, patient, split, w, h, name || printf('_box%02d', ord) AS lesion_id,
  bbox_width * bbox_height AS bbox_area, bbox_width * bbox_height / (w * h) AS bbox_area_ratio, bbox_width / bbox_height AS aspect_ratio, bbox_width / w AS bbox_width_norm, bbox_height / h AS bbox_height_norm,
  (x0 + (x0 + bbox_width)) / 2 / w AS center_x_norm, (y0 + (y0 + bbox_height)) / 2 / h AS center_y_norm FROM xywh JOIN images USING (image))"""
)
LABELLED = (
    LESIONS
    + f""",
thr AS (SELECT quantile_cont(bbox_area_ratio, 0.33) AS small_max, quantile_cont(bbox_area_ratio, 0.67) AS medium_max FROM les WHERE split = 'train'),
lab AS (SELECT *, CASE WHEN bbox_area_ratio <= small_max THEN 'small' WHEN bbox_area_ratio <= medium_max THEN 'medium' ELSE 'large' END AS size, {_SH} AS shape,
  {_third("center_x_norm", _H)} AS horizontal, {_third("center_y_norm", _Vv)} AS vertical, {_tokens()} AS loc FROM les, thr),
labelled AS (SELECT *, vertical || '-' || horizontal AS region FROM lab)"""
)


def _prompt(group: str, size="size", horizontal="horizontal", vertical="vertical", region="region", shape="shape") -> str:
    values = {"cls": _quote(V.CLS), "size": _words(size, V.SIZE_WORD), "horizontal": horizontal, "vertical": vertical, "region": region, "shape": shape}
    sql = _filled(V.PROMPTS[group], **values)
    if group == "horizontal":
        return f"CASE WHEN {horizontal} = 'center' THEN {_filled(V.HORIZONTAL_CENTER, **values)} ELSE {sql} END"
    return sql


def _prompts(groups) -> str:
    each = " UNION ALL ".join(f"SELECT *, '{g}' AS prompt_group, {_prompt(g)} AS prompt FROM labelled" for g in groups)
    return f"prompted AS ({each}), prompts AS (SELECT *, count(*) OVER (PARTITION BY image, prompt_group, prompt) AS n_same FROM prompted)"


def _with(prelude: str, *more: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([prelude, *more])


SQL["p03_features"] = f"{_with(LESIONS)} SELECT lesion_id, bbox_width, bbox_height, bbox_area, bbox_area_ratio, aspect_ratio, bbox_width_norm, bbox_height_norm, center_x_norm, center_y_norm FROM les"
SQL["p04_region"] = f"{_with(LABELLED)} SELECT lesion_id, horizontal, vertical, region FROM labelled"
SQL["p06_shape"] = f"{_with(LABELLED)} SELECT split, size, shape, count(*) AS n FROM labelled GROUP BY ALL"
SQL["p02_bbox_errors"] = f"""{_with(LESIONS)}, moved AS (SELECT split, name, lesion_id, w, h, y0, y1, x0 + sk % 5 * 40.0::DOUBLE AS a, CASE WHEN pk % 17 = 0 THEN x0 ELSE x1 END + sk % 5 * 40.0::DOUBLE AS b FROM les),
e AS (SELECT split, name, lesion_id, CASE WHEN NOT (a < b AND y0 < y1) THEN 'zero_area_or_inverted_bbox' WHEN a < -1 OR y0 < -1 OR b > w + 1 OR y1 > h + 1 OR a >= w OR y0 >= h THEN 'bbox_outside_image' END AS error FROM moved)
SELECT * FROM e WHERE error IS NOT NULL"""
SQL["p07_loc_tokens"] = f"{_with(LABELLED)} SELECT lesion_id, loc FROM labelled"
_claim = lambda p: f"nullif(regexp_extract(prompt, '{p}', 1), '')"
_said = {
    "size": f"CASE WHEN {_claim(V.CLAIMS['size'])} = 'medium-sized' THEN 'medium' ELSE {_claim(V.CLAIMS['size'])} END",
    "h": f"CASE WHEN contains(prompt, 'in the center of the image') THEN 'center' ELSE {_claim(V.CLAIMS['side'])} END",
    "v": _claim(V.CLAIMS["v"]),
    "shape": _claim(V.CLAIMS["shape"]),
    "region": _claim(V.CLAIMS["region"]),
}
SQL["p10_claims"] = f"{_with(LABELLED, _prompts(_FEATURE_GROUPS))} SELECT prompt_group, {', '.join(f'{c} AS said_{k}' for k, c in _said.items())}, count(*) AS n FROM prompts GROUP BY ALL"
_CLUES = "clues(prompt_group, " + ", ".join(f"contains_{k}_clue" for k in ("size", "horizontal", "vertical", "shape", "intensity", "texture")) + ") AS (VALUES " + ", ".join("('" + g + "', " + ", ".join(str(k in c).lower() for k in ("size", "horizontal", "vertical", "shape", "intensity", "texture")) + ")" for g, c in V.CLUES.items()) + ")"
_ALL = f"""allgroups AS (SELECT split, name, 'baseline' AS prompt_group, 'detect {V.CLS}' AS prompt, coalesce(string_agg(loc || ' lesion', ' ; ' ORDER BY ord), '') || '<eos>' AS suffix FROM images LEFT JOIN labelled USING (image, name, split) GROUP BY split, name
  UNION ALL SELECT split, name, prompt_group, prompt, loc || ' lesion<eos>' FROM prompts WHERE n_same = 1)"""
SQL["p12_prompt_groups_all"] = f"{_with(LABELLED, _prompts(_FEATURE_GROUPS), _ALL, _CLUES)} SELECT * FROM allgroups JOIN clues USING (prompt_group)"
SQL["p14_clip_box"] = f"""{_with(LESIONS)}, c AS (SELECT lesion_id, w, h, least(greatest(CAST(floor(x0 - 30.25) AS BIGINT), 0), CAST(w AS BIGINT) - 1) AS a, least(greatest(CAST(floor(y0 - 30.25) AS BIGINT), 0), CAST(h AS BIGINT) - 1) AS b,
  least(CAST(ceil(x1 + 200.5) AS BIGINT), CAST(w AS BIGINT)) AS c, least(CAST(ceil(y1 + 200.5) AS BIGINT), CAST(h AS BIGINT)) AS d FROM les) SELECT lesion_id, a AS x0, b AS y0, greatest(c, a + 1) AS x1, greatest(d, b + 1) AS y1 FROM c"""
_SLICE = f"slice AS (SELECT lesion_id, size, {_level('pk')} AS shape, region, {_level('sk', ('darker', 'similar', 'brighter'))} AS brightness, {_level('ln')} AS variation, {_level('q')} AS texture FROM labelled)"
_captions = lambda templates, values: "CASE template " + " ".join(f"WHEN '{k}' THEN {_filled(t, **values)}" for k, t in templates.items()) + " END"
_SLICE_WORDS = {"size": _words("size", V.SIZE_WORD), "shape": _words("shape", V.ELONGATION_WORD), "region": "region", "bright": _words("brightness", V.BRIGHT_WORD), "variation": _words("variation", V.LEVEL_WORD), "texture": _words("texture", V.LEVEL_WORD)}
_CAPTIONED = f"chosen AS (SELECT *, (['A', 'B', 'C', 'D'])[1 + {_hash('lesion_id')} % 4] AS template FROM slice), captioned AS (SELECT *, {_captions(V.CAPTIONS, _SLICE_WORDS)} AS caption FROM chosen)"
SQL["p17_template_choice"] = f"{_with(LABELLED, _SLICE, _CAPTIONED)} SELECT lesion_id, template, caption FROM captioned"
FACTS = LESIONS + f", facts AS (SELECT lesion_id, patient, split, pk, sk, q, {_level('pk')} AS shape, {_level('sk', ('vertical', 'diagonal', 'horizontal', 'none'))} AS orientation, {_level('(pk + sk)')} AS outline, {_level('ln')} AS intensity, {_level('q')} AS variation FROM les)"
_fact_array = "[" + ", ".join(_quote(f) for f in V.FACTS) + "]"
_SUBSET = f"""sub AS (SELECT *, CASE WHEN {_hash("lesion_id", "all:")} % 4 = 0 THEN 5 ELSE {_hash("lesion_id", "k:")} % 4 + 1 END AS size_k FROM facts),
picked AS (SELECT * EXCLUDE (size_k), list_filter({_fact_array}, lambda f: list_contains((list_transform(list_sort([{", ".join("{'h': sha1('fact:" + f + ":' || lesion_id), 'f': '" + f + "'}" for f in V.FACTS)}]), lambda e: e.f))[1:size_k], f)) AS facts FROM sub)"""


def _list_text(parts: str) -> str:
    return f"CASE WHEN len({parts}) <= 1 THEN array_to_string({parts}, '') ELSE array_to_string(({parts})[1:-2], ', ') || ' and ' || ({parts})[-1] END"


def _question(facts: str) -> str:
    asked = f"list_transform({facts}, lambda f: {_words('f', V.ASK)})"
    return f"CASE WHEN len({facts}) = 5 THEN {_quote(V.GENERIC_PROMPT)} ELSE 'Describe the ' || {_list_text(asked)} || ' of this epidural hemorrhage.' END"


def _answer(facts: str, **said: str) -> str:
    clause = lambda f: f"{_quote(V.CLAUSES[f][0])} || {_words(said.get(f, f), V.CLAUSES[f][1])} || {_quote(V.CLAUSES[f][2])}"
    parts = f"list_filter([{', '.join(f'CASE WHEN list_contains({facts}, {_quote(f)}) THEN {clause(f)} END' for f in V.FACTS)}], lambda c: c IS NOT NULL)"
    return f"'The lesion region ' || {_list_text(parts)} || '.'"


SQL["p18_compose"] = f"{_with(FACTS, _SUBSET)} SELECT lesion_id, CAST(len(facts) AS INTEGER) AS n_facts, {_question('facts')} AS prompt, {_answer('facts')} AS caption FROM picked"


def _read(field: str, text: str) -> str:
    pattern, words = V.READ[field]
    got = f"nullif(regexp_extract({text}, '{pattern}', 1), '')"
    if field == "orientation":
        got = f"coalesce({got}, CASE WHEN contains({text}, '{V.NO_AXIS}') THEN 'none' END)"
    return _words(got, words) if words else got


_ALONE_WORDS = {"a": f"CASE WHEN substr({_words('shape', V.SHAPE_WORD)}, 1, 1) IN ('a', 'e', 'i', 'o', 'u') THEN 'An' ELSE 'A' END", "shape": _words("shape", V.SHAPE_WORD), "orient": _words("orientation", V.AXIS_WORD), **{f: _words(f, V.LEVEL_WORD) for f in ("outline", "intensity", "variation")}}
_ALONE = f"chosen AS (SELECT *, (['F1', 'F2', 'F3', 'F4'])[1 + {_hash('lesion_id', 'lo5:')} % 4] AS template FROM facts), captioned AS (SELECT *, {_captions(V.LESION_CAPTIONS, _ALONE_WORDS)} AS caption FROM chosen)"
SQL["p19_parse_roundtrip"] = f"""{_with(FACTS, _ALONE)} SELECT template, shape, orientation, count(*) AS n, CAST(sum({" + ".join(f"CAST({_read(f, 'caption')} IS DISTINCT FROM {f} AS INTEGER)" for f in V.FACTS)}) AS BIGINT) AS wrong,
CAST(sum({" + ".join(f"CAST({_read(f, 'caption')} IS NOT NULL AS INTEGER)" for f in ("region", "texture", "edge", "brightness"))}) AS BIGINT) AS extra FROM captioned GROUP BY template, shape, orientation"""
_stated = "list_filter([" + ", ".join(f"CASE WHEN {_read(f, 'caption')} IS NOT NULL THEN '{f}' END" for f in V.READ) + "], lambda k: k IS NOT NULL)"
_listed = "CASE template " + " ".join(f"WHEN '{t}' THEN {list(f)}" for t, f in V.CAPTION_FIELDS.items()) + " END"
_values = " AND ".join(f"coalesce({_read(k, 'caption')} = {k}, true)" for k in ("size", "shape", "region", "brightness", "variation", "texture"))
_banned = " OR ".join(f"contains(' ' || lower(caption) || ' ', {_quote(b)})" for b in V.BANNED)
SQL["p20_consistency"] = f"""{_with(LABELLED, _SLICE, _CAPTIONED)} SELECT template, count(*) AS n, count_if(list_sort({_stated}) <> list_sort({_listed}))::BIGINT AS wrong_fields, count_if(NOT ({_values}))::BIGINT AS wrong_values,
count_if(len(string_split(caption, ' ')) NOT BETWEEN 20 AND 60)::BIGINT AS wrong_length, count_if({_banned})::BIGINT AS banned FROM captioned GROUP BY template"""
SQL["p22_brightness"] = f"{_with(LESIONS)}, e AS (SELECT CASE WHEN sk % 11 = 0 THEN 'nan'::DOUBLE ELSE (pk % 9 - 4) * 0.5::DOUBLE END AS z FROM les) SELECT CASE WHEN NOT isfinite(z) OR abs(z) <= 1 THEN 'similar' WHEN z > 0 THEN 'brighter' ELSE 'darker' END AS brightness, count(*) AS n FROM e GROUP BY 1"
_regions = [f"{v}-{h}" for v in _Vv for h in _H]
_far = {r: max(_regions, key=lambda o, r=r: abs(_regions.index(o) // 3 - _regions.index(r) // 3) + abs(_regions.index(o) % 3 - _regions.index(r) % 3)) for r in _regions}
_ws, _wsh, _wr = "CASE size WHEN 'small' THEN 'large' ELSE 'small' END", "CASE shape WHEN 'tall' THEN 'wide' ELSE 'tall' END", _words("region", _far)
_variants = [("no hint", _prompt("baseline")), ("size only", _prompt("size")), ("shape only", _prompt("shape")), ("region only", _prompt("region")), ("size + region", _prompt("size_region")), ("all three true", _prompt("size_shape_region"))]
_variants += [(n, _prompt("size_shape_region", size=a, shape=b, region=c)) for n, a, b, c in (("wrong size", f"({_ws})", "shape", "region"), ("wrong shape", "size", f"({_wsh})", "region"), ("wrong region", "size", "shape", f"({_wr})"), ("all three wrong", f"({_ws})", f"({_wsh})", f"({_wr})"))]
_variants += [(f"sweep {r}", _prompt("size_shape_region", region=_quote(r))) for r in _regions]
SQL["p23_prompt_variants"] = f"{_with(LABELLED)} " + " UNION ALL ".join(f"SELECT lesion_id, size, shape, region, {_quote(n)} AS variant, {p} AS prompt FROM labelled" for n, p in _variants)
_TYPES = [("generic", V.FACTS, V.GENERIC_PROMPT), ("explicit_full", V.FACTS, V.explicit_question())] + [(f"single_{f}", [f], f"Describe the {V.ASK[f]} of this epidural hemorrhage.") for f in V.FACTS]
_TYPED = "types(prompt_type, asked, prompt) AS (VALUES " + ", ".join(f"({_quote(n)}, {list(f)}, {_quote(p)})" for n, f, p in _TYPES) + ")"
SQL["p24_prompt_types"] = f"{_with(FACTS, _TYPED)} SELECT prompt_type, prompt, count(*) AS n FROM facts, types GROUP BY ALL"
SQL["p25_anonymise"] = f"{_with(IMAGES)}, p AS (SELECT patient, min(name) AS name FROM images GROUP BY patient), c AS (SELECT *, printf('P%04d', row_number() OVER (ORDER BY CAST(patient AS BIGINT))) AS code FROM p) SELECT patient, code, code || substr(name, length(patient) + 1) AS public_name FROM c"
SQL["p26_limit"] = f"{_with(IMAGES)} SELECT split, name FROM images QUALIFY row_number() OVER (PARTITION BY split ORDER BY name) <= 20"
_INDEXED = "indexed AS (SELECT *, row_number() OVER (ORDER BY image) - 1 AS idx FROM images)"
SQL["p27_stride"] = f"{_with(IMAGES, _INDEXED)} SELECT image, idx FROM indexed WHERE idx % 7 = 0"
SQL["p28_shards"] = f"{_with(IMAGES, _INDEXED)} SELECT CAST(idx % 8 AS INTEGER) AS shard, count(*) AS n, min(image) AS first, max(image) AS last FROM indexed GROUP BY 1"

SQL["j01_images_with_annotations"] = f"{_with(LESIONS)} SELECT image, split, count(ord) AS n, min(ord) AS first_ord, max(ord) AS last_ord FROM images LEFT JOIN ann USING (image) GROUP BY image, split"
SQL["j02_orphans"] = f"{_with(LESIONS)} SELECT image, ord FROM ann WHERE image NOT IN (SELECT image FROM images WHERE split <> 'valid')"
SQL["j03_reconcile"] = f"{_with(IMAGES)}, a AS (SELECT name FROM images WHERE image % 3 <> 0), b AS (SELECT name FROM images WHERE image % 5 <> 0) SELECT name, 'left_only' AS side FROM (SELECT name FROM a EXCEPT SELECT name FROM b) UNION ALL SELECT name, 'right_only' FROM (SELECT name FROM b EXCEPT SELECT name FROM a)"
SQL["j04_best_blob"] = f"""{_with(LESIONS)}, blobs AS (SELECT image, ord AS blob, x0 + sk % 3 * 4.0::DOUBLE AS b_x0, y0 + sk % 3 * 4.0::DOUBLE AS b_y0, x1 + sk % 3 * 4.0::DOUBLE AS b_x1, y1 + sk % 3 * 4.0::DOUBLE AS b_y1 FROM les WHERE pk % 6 <> 0),
pairs AS (SELECT les.image, ord, blob, {_iou("", "b_")} AS overlap FROM les LEFT JOIN blobs USING (image)),
best AS (SELECT image, ord, overlap, CASE WHEN overlap > 0 THEN blob END AS blob FROM pairs QUALIFY row_number() OVER (PARTITION BY image, ord ORDER BY overlap DESC, blob) = 1),
claims AS (SELECT *, row_number() OVER (PARTITION BY image, blob ORDER BY ord) AS claim FROM best)
SELECT image, ord, blob, {_mill("overlap")} AS overlap_millionths, CASE WHEN blob IS NULL THEN 'no_overlap' WHEN claim > 1 THEN 'already_claimed' WHEN overlap < 0.9::DOUBLE THEN 'weak_overlap' ELSE 'ok' END AS status FROM claims"""
SQL["j05_exact_box"] = f"{_with(LESIONS)} SELECT a.image, count(*) AS pairs FROM les a JOIN les b ON a.image = b.image AND a.x0 = b.x0 AND a.y0 = b.y0 AND a.x1 = b.x1 AND a.y1 = b.y1 WHERE b.sk % 4 = 0 GROUP BY a.image"
_HINT = f"""test AS (SELECT lesion_id, size, region, {_hash("lesion_id", "part:")} % 16 AS part FROM labelled WHERE split = 'test'),
seqs AS (SELECT *, row_number() OVER (PARTITION BY region, size ORDER BY part, lesion_id) AS r FROM test),
cells AS (SELECT size, region, count(*) AS n FROM test GROUP BY ALL),
opt AS (SELECT a.size, a.region, b.size AS o_size, b.region AS o_region, b.n, a.size <> b.size AS strict FROM cells a JOIN cells b ON a.region <> b.region),
opts AS (SELECT * FROM opt QUALIFY strict OR NOT bool_or(strict) OVER (PARTITION BY size, region)),
cum AS (SELECT *, sum(n) OVER (PARTITION BY size, region ORDER BY o_size, o_region) AS upto, sum(n) OVER (PARTITION BY size, region) AS total FROM opts),
hints AS (SELECT s.lesion_id, s.size, s.region, t.lesion_id AS hint_from, t.size AS hint_size, t.region AS hint_region FROM seqs s JOIN cum c ON s.size = c.size AND s.region = c.region
  AND {_hash("s.lesion_id", "hint:")} % total < upto AND {_hash("s.lesion_id", "hint:")} % total >= upto - n JOIN seqs t ON t.size = c.o_size AND t.region = c.o_region AND t.r = {_hash("s.lesion_id", "hint:")} % total - (upto - n) + 1)"""
SQL["j07_mismatched_hint"] = f"{_with(LABELLED, _HINT)} SELECT * FROM hints"
_means = ", ".join(f"{_mean(c)} AS p_{c}" for c in ("x0", "y0", "x1", "y1"))
_PRIOR = f"""priors AS (SELECT size, shape, region, CAST(3 - (grouping(size) + grouping(shape) + grouping(region)) AS INTEGER) AS level, count(*) AS n, {_means} FROM labelled WHERE split = 'train'
  GROUP BY GROUPING SETS ((size, shape, region), (shape, region), (region), ())),
withprior AS (SELECT l.*, p.* EXCLUDE (size, shape, region, level, n) FROM labelled l JOIN priors p ON (p.level = 0 OR p.region = l.region) AND (p.level < 2 OR p.shape = l.shape) AND (p.level < 3 OR p.size = l.size)
  WHERE l.split = 'test' QUALIFY row_number() OVER (PARTITION BY lesion_id ORDER BY level DESC) = 1)"""
SQL["g06_prior_boxes"] = f"{_with(LABELLED, _PRIOR)} SELECT * FROM priors"
SQL["j08_prior_iou"] = f"{_with(LABELLED, _PRIOR)} SELECT lesion_id, {_mill(_iou('p_', ''))} AS prior_iou_millionths FROM withprior"
SQL["j09_combinations"] = f"{_with(LABELLED)} SELECT size, shape, region, (size, shape, region) IN (SELECT (size, shape, region) FROM labelled WHERE split = 'train') AS seen, count(*) AS n FROM labelled WHERE split = 'test' GROUP BY ALL"
SQL["u01_set_ops"] = f"""{_with(IMAGES)}, a AS (SELECT patient FROM images WHERE split <> 'valid'), b AS (SELECT patient FROM images WHERE CAST(patient AS BIGINT) % 2 = 0),
u AS (SELECT 'union_all' AS op, patient FROM (SELECT * FROM a UNION ALL SELECT * FROM b) UNION ALL SELECT 'intersect', patient FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'except', patient FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'union', patient FROM (SELECT * FROM a UNION SELECT * FROM b))
SELECT op, count(*) AS n, count(DISTINCT patient) AS patients FROM u GROUP BY op"""
SQL["w06_last_wins"] = f"{_with(LABELLED)} SELECT condition, lesion_id, CAST(pk % 3 AS INTEGER) AS shard FROM labelled, (VALUES ('matched'), ('baseline'), ('oracle')) AS c(condition) WHERE split = 'test'"

SQL["w02_unambiguous_prompts"] = f"{_with(LABELLED, _prompts(['size_region']))} SELECT lesion_id, split, size, shape, region, prompt, loc || ' lesion<eos>' AS suffix FROM prompts WHERE n_same = 1"
SQL["w02_ambiguous_errors"] = f"{_with(LABELLED, _prompts(_FEATURE_GROUPS))} SELECT prompt_group, lesion_id, prompt, n_same FROM prompts WHERE n_same > 1"
SQL["r01_mixed"] = f"""{_with(LABELLED, _prompts(_FEATURE_GROUPS), _ALL)} SELECT split, name, prompt_group, prompt, suffix FROM allgroups WHERE prompt_group <> 'size_shape_region'
QUALIFY row_number() OVER (PARTITION BY split, name ORDER BY sha1('42:' || split || ':' || name || ':group:' || prompt_group), sha1('42:' || split || ':' || name || ':row:' || suffix || ':' || prompt)) = 1"""
_derived = {"size": "CASE WHEN (b.x1 - b.x0) * (b.y1 - b.y0) / (w * h) <= small_max THEN 'small' WHEN (b.x1 - b.x0) * (b.y1 - b.y0) / (w * h) <= medium_max THEN 'medium' ELSE 'large' END", "h": _third("(b.x0 + b.x1) / 2 / w", _H), "v": _third("(b.y0 + b.y1) / 2 / h", _Vv), "shape": _SH.replace("aspect_ratio", "((b.x1 - b.x0) / (b.y1 - b.y0))"), "region": f"{_third('(b.y0 + b.y1) / 2 / h', _Vv)} || '-' || {_third('(b.x0 + b.x1) / 2 / w', _H)}"}
_AUDIT = f"boxed AS (SELECT *, ({_decoded('loc')})[1] AS b FROM prompts WHERE n_same = 1), claimed AS (" + " UNION ALL ".join(f"SELECT prompt_group, '{k}' AS kind, {c} AS claimed, {_derived[k]} AS derived FROM boxed" for k, c in _said.items()) + ")"
SQL["g23_audit"] = f"{_with(LABELLED, _prompts(_FEATURE_GROUPS), _AUDIT)} SELECT prompt_group, kind, count(*) AS checked, count_if(claimed <> derived)::BIGINT AS wrong FROM claimed WHERE claimed IS NOT NULL GROUP BY ALL"
SQL["j10_targets_in_baseline"] = f"{_with(LABELLED, _prompts(['region']))} SELECT name, lesion_id, loc FROM prompts p WHERE n_same = 1 AND NOT EXISTS (SELECT 1 FROM labelled b WHERE b.name = p.name AND b.loc = p.loc AND b.pk % 9 <> 0)"
SQL["g30_roundtrip"] = f"""{_with(LABELLED)}, d AS (SELECT *, ({_decoded("loc")})[1] AS b FROM labelled), g AS (SELECT w, h, greatest(abs(b.x0 - x0), abs(b.y0 - y0), abs(b.x1 - x1), abs(b.y1 - y1)) AS gap FROM d)
SELECT h, count(*) AS n, max(gap) AS max_error, count_if(gap > 0.51::DOUBLE * greatest(w, h) / 512 + 0.01::DOUBLE)::BIGINT AS over FROM g GROUP BY h"""

SQL["g01_thresholds"] = f"{_with(LESIONS)} SELECT {', '.join(f'quantile_cont({c}, {q}) AS {c}_{n}' for c in ('bbox_area_ratio', 'aspect_ratio', 'bbox_width_norm') for n, q in (('lo', 0.33), ('hi', 0.67)))} FROM les WHERE split = 'train'"
SQL["g02_distribution"] = f"{_with(LESIONS)}, v AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS v FROM les" for c in ("bbox_area_ratio", "aspect_ratio", "bbox_width", "center_x_norm")) + f") SELECT feature, count(*) AS n, min(v) AS min, quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS p75, max(v) AS max, {_mean('v')} AS mean FROM v GROUP BY feature"
SQL["g03_counts"] = f"{_with(LABELLED)} SELECT region, {', '.join(f'''count_if(split = '{s}')::BIGINT AS {s}''' for s in ('train', 'valid', 'test'))} FROM labelled GROUP BY region"
SQL["g04_distinct"] = f"{_with(LABELLED, _prompts(_FEATURE_GROUPS))} SELECT prompt_group, count(DISTINCT prompt) AS prompts, count(DISTINCT patient) AS patients FROM prompts GROUP BY prompt_group"


def _shift(dx: str, dy: str, keep: str) -> str:
    x = lambda c, size: f"greatest(0.0::DOUBLE, {c} + {dx})" if size is None else f"least({size}, {c} + {dx})"
    y = lambda c, size: f"greatest(0.0::DOUBLE, {c} + {dy})" if size is None else f"least({size}, {c} + {dy})"
    return f"CASE WHEN {keep} THEN {_tokens(x('x0', None), y('y0', None), x('x1', 'w'), y('y1', 'h'))} END"


_SCORED = f"""test AS (SELECT *, {_shift("((pk % 7) - 3) * 4.0::DOUBLE", "0.0::DOUBLE", "sk % 13 <> 0")} AS one, {_shift("((pk % 9) - 4) * 5.0::DOUBLE", "((pk % 5) - 2) * 6.0::DOUBLE", "sk % 7 <> 0")} AS other FROM labelled WHERE split = 'test'),
answers AS (SELECT *, 'matched' AS condition, CASE WHEN one IS NULL THEN [] WHEN pk % 11 = 0 THEN [one, loc] ELSE [one] END AS locs FROM test
  UNION ALL SELECT *, 'baseline', CASE WHEN other IS NULL THEN [] ELSE [other] END FROM test UNION ALL SELECT *, 'oracle', [loc] FROM test),
decoded AS (SELECT *, {_decoded("array_to_string(locs, '')")} AS boxes FROM answers),
scored AS (SELECT *, boxes[1].x0 AS f_x0, boxes[1].y0 AS f_y0, boxes[1].x1 AS f_x1, boxes[1].y1 AS f_y1, {_iou("f_", "")} AS iou FROM decoded)"""
_stats = f"count(*) AS n, {_mean('iou')} AS mean_iou, quantile_cont(CAST({_mill('iou')} AS DOUBLE), 0.5) AS median_iou_millionths, count_if(iou >= 0.5)::BIGINT / count(*)::DOUBLE AS at_50, count_if(iou >= 0.3)::BIGINT / count(*)::DOUBLE AS at_30, count_if(iou = 0)::BIGINT / count(*)::DOUBLE AS missed"
SQL["g05_iou_summary"] = f"{_with(LABELLED, _SCORED)} SELECT condition, {_stats} FROM scored GROUP BY condition"
SQL["g13_patient_iou"] = f"{_with(LABELLED, _SCORED)} SELECT patient, {_stats} FROM scored WHERE condition = 'matched' GROUP BY patient"
_PAIRED = "paired AS (SELECT lesion_id, any_value(size) AS size, any_value(shape) AS shape, max(iou) FILTER (condition = 'matched') AS matched, max(iou) FILTER (condition = 'baseline') AS baseline FROM scored GROUP BY lesion_id)"
SQL["g16_win_rates"] = f"{_with(LABELLED, _SCORED, _PAIRED)} SELECT count(*) AS n, count_if(matched > baseline)::BIGINT / count(*)::DOUBLE AS better, count_if(matched < baseline)::BIGINT / count(*)::DOUBLE AS worse FROM paired"
SQL["g17_obedience"] = f"""{_with(LABELLED, _SCORED, _HINT.replace("test AS", "hinted AS").replace("FROM test", "FROM hinted"))}, d AS (SELECT s.size, s.region, hint_size, hint_region, {_derived["size"].replace("b.", "f_")} AS gs, {_derived["region"].replace("b.", "f_")} AS gr FROM scored s JOIN hints USING (lesion_id) WHERE condition = 'matched' AND f_x0 IS NOT NULL)
SELECT count(*) AS n, count_if(gr = hint_region)::BIGINT / count(*)::DOUBLE AS region_as_hint, count_if(gr = region)::BIGINT / count(*)::DOUBLE AS region_as_image, count_if(gs = hint_size)::BIGINT / count(*)::DOUBLE AS size_as_hint, count_if(gs = size)::BIGINT / count(*)::DOUBLE AS size_as_image FROM d"""
SQL["g18_strata"] = f"{_with(LABELLED, _SCORED, _PAIRED)} " + " UNION ALL ".join(f"SELECT '{k}' AS stratum, {k} AS value, count(*) AS n, {_mean('matched')} AS mean_matched, {_mean('baseline')} AS mean_baseline FROM paired GROUP BY {k}" for k in ("size", "shape"))
SQL["g19_seen_unseen"] = f"{_with(LABELLED, _SCORED)} SELECT condition, (size, shape, region) IN (SELECT (size, shape, region) FROM labelled WHERE split = 'train' AND pk % 5 = 0 AND sk % 3 = 0 AND ord = 1) AS seen, {_stats} FROM scored GROUP BY ALL"
SQL["w05_best_target"] = f"{_with(LABELLED, _SCORED)}, m AS (SELECT * FROM scored WHERE condition = 'matched'), p AS (SELECT a.lesion_id, {_iou('a.f_', 'b.')} AS i FROM m a JOIN m b USING (image)) SELECT lesion_id, {_mill('max(i)')} AS best_iou_millionths FROM p GROUP BY lesion_id"


def _map(first: bool) -> str:
    tag = "first" if first else "all"
    return f"""each_{tag} AS (SELECT condition, image, ord, x0, y0, x1, y1, unnest({"boxes[1:1]" if first else "boxes"}) AS u, generate_subscripts({"boxes[1:1]" if first else "boxes"}, 1) AS place FROM scored),
over_{tag} AS (SELECT condition, image, ord, place, {_iou("u.", "")} AS o FROM each_{tag}),
lev_{tag} AS (SELECT o.*, level, o >= level / 100.0::DOUBLE AND coalesce(max(o) OVER (PARTITION BY condition, image, ord, level ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) < level / 100.0::DOUBLE AS hit FROM over_{tag} o, (SELECT unnest(range(50, 100, 5)) AS level)),
run_{tag} AS (SELECT condition, level, sum(hit::INTEGER) OVER w AS tp, count(*) OVER w AS seen FROM lev_{tag} WINDOW w AS (PARTITION BY condition, level ORDER BY image, ord, place ROWS UNBOUNDED PRECEDING)),
grid_{tag} AS (SELECT condition, level, r, coalesce(max(tp / seen::DOUBLE) FILTER (floor(tp * 100 / targets::DOUBLE) >= r), 0) AS p FROM run_{tag} JOIN (SELECT condition, count(*) AS targets FROM scored GROUP BY condition) USING (condition), (SELECT unnest(range(101)) AS r) GROUP BY ALL),
ap_{tag} AS (SELECT condition, level, CAST(sum({_mill("p")}) AS BIGINT) / (101 * 1e6::DOUBLE) AS ap FROM grid_{tag} GROUP BY ALL),
map_{tag} AS (SELECT '{tag}' AS boxes, condition, max(ap) FILTER (level = 50) AS map50, max(ap) FILTER (level = 75) AS map75, CAST(sum({_mill("ap")}) AS BIGINT) / (10 * 1e6::DOUBLE) AS map50_95 FROM ap_{tag} GROUP BY condition)"""


SQL["g15_map"] = f"{_with(LABELLED, _SCORED, _map(False), _map(True))} SELECT * FROM map_all UNION ALL SELECT * FROM map_first"

_bump = lambda f, names, when: f"CASE WHEN {when} THEN {_level(f'list_position([{chr(44).join(map(_quote, names))}], {f})', names)} ELSE {f} END"
_L, _AX = ("low", "mid", "high"), ("vertical", "diagonal", "horizontal", "none")
_ANSWERS = f"""asked AS (SELECT f.*, prompt_type, asked, CASE WHEN pk % 7 = 0 AND len(asked) > 1 THEN list_filter(asked, lambda x: x <> 'variation') ELSE asked END AS told,
  {_bump("shape", _L, "pk % 5 = 0")} AS s_shape, {_bump("orientation", _AX, "sk % 9 = 0")} AS s_orientation, {_bump("intensity", _L, "sk % 6 = 0")} AS s_intensity FROM facts f, types WHERE split = 'test'),
answered AS (SELECT *, {_answer("told", shape="s_shape", orientation="s_orientation", intensity="s_intensity")} AS pred FROM asked),
long AS ({" UNION ALL ".join(f"SELECT lesion_id, patient, prompt_type, '{f}' AS fact, {f} AS truth, {_read(f, 'pred')} AS got, coalesce({_read(f, 'pred')} = {f}, false) AS ok FROM answered WHERE list_contains(asked, '{f}')" for f in V.FACTS)})"""
_EVAL = (FACTS, _TYPED, _ANSWERS)
_MAJOR = "tl AS (" + " UNION ALL ".join(f"SELECT lesion_id, '{f}' AS fact, {f} AS label FROM facts WHERE split = 'train'" for f in V.FACTS) + "), major AS (SELECT fact, label, count(*) AS n FROM tl GROUP BY fact, label QUALIFY row_number() OVER (PARTITION BY fact ORDER BY count(*) DESC, min(lesion_id)) = 1), classes AS (SELECT fact, count(DISTINCT label) AS classes FROM tl GROUP BY fact)"
SQL["g07_majority"] = f"{_with(FACTS, _MAJOR)} SELECT fact, label, n FROM major"
SQL["g08_fact_accuracy"] = f"""{_with(*_EVAL, _MAJOR)} SELECT prompt_type, fact, count(*) AS n, count_if(ok)::BIGINT / count(*)::DOUBLE AS accuracy, count_if(got IS NOT NULL)::BIGINT / count(*)::DOUBLE AS stated,
count_if(truth = label)::BIGINT / count(*)::DOUBLE AS baseline, 1.0::DOUBLE / max(classes) AS chance FROM long JOIN major USING (fact) JOIN classes USING (fact) GROUP BY prompt_type, fact"""
SQL["g09_balanced"] = f"{_with(*_EVAL)}, r AS (SELECT prompt_type, fact, truth, count_if(ok)::BIGINT / count(*)::DOUBLE AS recall FROM long GROUP BY ALL) SELECT prompt_type, fact, CAST(sum({_mill('recall')}) AS BIGINT) / (count(*) * 1e6::DOUBLE) AS balanced FROM r GROUP BY prompt_type, fact"
_place = lambda c: f"CASE WHEN fact = 'orientation' THEN list_position(['vertical', 'diagonal', 'horizontal'], {c}) ELSE list_position(['low', 'mid', 'high'], {c}) END"
SQL["g10_ordinal"] = f"{_with(*_EVAL)}, d AS (SELECT prompt_type, fact, abs({_place('truth')} - {_place('got')}) AS gap FROM long) SELECT prompt_type, fact, count(*) AS n, count_if(gap <= 1)::BIGINT / count(*)::DOUBLE AS within_one, CAST(sum(gap) AS BIGINT) / count(*)::DOUBLE AS level_error FROM d WHERE gap IS NOT NULL GROUP BY ALL"
SQL["g11_bootstrap_ci"] = f"""{_with(*_EVAL)}, per AS (SELECT patient, fact, count_if(ok)::BIGINT AS ok_n, count(*) AS n FROM long WHERE prompt_type = 'generic' GROUP BY ALL), pats AS (SELECT patient, row_number() OVER (ORDER BY patient) - 1 AS number FROM (SELECT DISTINCT patient FROM per)),
draws AS (SELECT r, {_hash("r || ':' || i", "boot:")} % (SELECT count(*) FROM pats) AS number FROM (SELECT unnest(range(500)) AS r), (SELECT unnest(range(1, (SELECT count(*) FROM pats) + 1)) AS i)),
means AS (SELECT r, fact, CAST(sum(ok_n) AS BIGINT) / CAST(sum(n) AS DOUBLE) AS m FROM draws JOIN pats USING (number) JOIN per USING (patient) GROUP BY r, fact) SELECT fact, {_mill('quantile_cont(m, 0.025)')} AS lo_millionths, {_mill('quantile_cont(m, 0.975)')} AS hi_millionths FROM means GROUP BY fact"""
_cells = [("low", "low"), ("mid", "mid"), ("high", "high"), ("vertical", "vertical"), ("diagonal", "diagonal"), ("horizontal", "horizontal"), ("none", "no_axis")]
SQL["g12_confusion"] = f"{_with(*_EVAL)} SELECT fact, truth, {', '.join(f'''count_if(got = '{v}')::BIGINT AS {c}''' for v, c in _cells)}, count_if(got IS NULL)::BIGINT AS none_stated FROM long WHERE prompt_type LIKE 'single%' GROUP BY fact, truth"
SQL["g14_hist"] = f"{_with(*_EVAL)}, p AS (SELECT lesion_id, count_if(ok)::BIGINT AS k FROM long WHERE prompt_type = 'generic' GROUP BY lesion_id) SELECT x AS facts_right, count(k) AS n FROM (SELECT unnest(range(6)) AS x) LEFT JOIN p ON k = x GROUP BY x"
SQL["g28_exact"] = f"""{_with(*_EVAL)} SELECT count(*) AS n, count_if(pred = {_answer("asked")})::BIGINT / count(*)::DOUBLE AS same_text,
count_if({" AND ".join(f"{_read(k, 'pred')} IS NOT DISTINCT FROM {k}" if k in V.FACTS else f"{_read(k, 'pred')} IS NULL" for k in V.READ)})::BIGINT / count(*)::DOUBLE AS same_facts FROM answered WHERE prompt_type = 'generic'"""
SQL["g29_top_errors"] = f"{_with(*_EVAL)} SELECT fact, truth, coalesce(got, 'none stated') AS answered, count(*) AS n, CAST(row_number() OVER (PARTITION BY fact ORDER BY count(*) DESC, truth, coalesce(got, 'none stated')) AS INTEGER) AS place FROM long WHERE prompt_type = 'generic' AND NOT ok GROUP BY fact, truth, coalesce(got, 'none stated') QUALIFY place <= 4"

PIXELS = "px AS (SELECT vec_id AS id, label, CAST((p - 1) % 8 AS BIGINT) AS x, CAST((p - 1) // 8 AS BIGINT) AS y, CAST(floor(CAST(embedding[p] AS DOUBLE) * 400 + 128) AS BIGINT) AS g, floor(CAST(embedding[p] AS DOUBLE) * 400 + 128) > 128 AS fg FROM embeddings, (SELECT unnest(range(1, 65)) AS p))"
_I01 = """m AS (SELECT id, count(*) AS n, CAST(sum(g) AS BIGINT) AS s1, CAST(sum(g * g) AS BIGINT) AS s2, min(g) AS min, max(g) AS max, quantile_cont(g::DOUBLE, 0.25) AS q25, quantile_cont(g::DOUBLE, 0.5) AS median, quantile_cont(g::DOUBLE, 0.75) AS q75 FROM px WHERE fg GROUP BY id),
r AS (SELECT id, count(*) AS rn, CAST(sum(g) AS BIGINT) AS rs FROM px WHERE NOT fg GROUP BY id), i01 AS (SELECT id, n, s1 / n::DOUBLE AS mean, sqrt((n * s2 - s1 * s1) / (n * n)::DOUBLE) AS std, min, max, q25, median, q75,
coalesce(s1 / n::DOUBLE - rs / rn::DOUBLE, 'nan'::DOUBLE) AS difference, CASE WHEN rn IS NOT NULL AND rs <> 0 THEN (s1 / n::DOUBLE) / (rs / rn::DOUBLE) ELSE 'nan'::DOUBLE END AS ratio FROM m LEFT JOIN r USING (id))"""
SQL["i01_intensity"] = f"{_with(PIXELS, _I01)} SELECT * FROM i01"
SQL["i02_gradients"] = f"""{_with(PIXELS)}, k AS (SELECT a.id, a.x, a.y, CAST(sum(dx * CASE dy WHEN 0 THEN 2 ELSE 1 END * b.g) AS BIGINT) AS gx, CAST(sum(dy * CASE dx WHEN 0 THEN 2 ELSE 1 END * b.g) AS BIGINT) AS gy FROM px a, (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dy) JOIN px b ON b.id = a.id AND b.x = least(7, greatest(0, a.x + dx)) AND b.y = least(7, greatest(0, a.y + dy)) GROUP BY ALL)
SELECT id, count(*) AS n, CAST(sum(gx * gx + gy * gy) AS BIGINT) AS energy, max(gx * gx + gy * gy) AS strongest FROM k GROUP BY id"""
SQL["i03_entropy"] = f"{_with(PIXELS)}, c AS (SELECT id, g, count(*) AS c FROM px GROUP BY id, g), l AS (SELECT id, CAST(sum(c) AS BIGINT) AS n, count(*) AS levels, list(c ORDER BY c) AS cs FROM c GROUP BY id) SELECT id, n, levels, {_mill('list_reduce(list_transform(cs, lambda v: -(v / n::DOUBLE) * log2(v / n::DOUBLE)), lambda a, b: a + b, 0.0::DOUBLE)')} AS entropy_millionths FROM l"
SQL["i04_components"] = f"""{_with(PIXELS)}, f AS (SELECT id, x, y, y * 1048576 + x AS k FROM px WHERE fg), reach AS (SELECT id, x, y, k FROM f UNION SELECT f.id, f.x, f.y, reach.k FROM reach JOIN f ON f.id = reach.id AND abs(f.x - reach.x) <= 1 AND abs(f.y - reach.y) <= 1 AND reach.k < f.k),
b AS (SELECT id, x, y, min(k) AS blob FROM reach GROUP BY id, x, y) SELECT id, blob, count(*) AS area, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1 FROM b GROUP BY id, blob"""
_I05 = """s AS (SELECT id, count(*) AS n, CAST(sum(x) AS BIGINT) AS sx, CAST(sum(y) AS BIGINT) AS sy, CAST(sum(x * x) AS BIGINT) AS sxx, CAST(sum(y * y) AS BIGINT) AS syy, CAST(sum(x * y) AS BIGINT) AS sxy, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1 FROM px WHERE fg GROUP BY id),
i05 AS (SELECT id, n AS area, sx / n::DOUBLE AS cx, sy / n::DOUBLE AS cy, x0, y0, x1, y1, n / ((x1 - x0) * (y1 - y0))::DOUBLE AS extent, (n * sxx - sx * sx) / (n * n)::DOUBLE + 1.0::DOUBLE / 12 AS cxx, (n * syy - sy * sy) / (n * n)::DOUBLE + 1.0::DOUBLE / 12 AS cyy, (n * sxy - sx * sy) / (n * n)::DOUBLE AS cxy FROM s)"""
SQL["i05_moments"] = f"{_with(PIXELS, _I05)} SELECT * FROM i05"
SQL["i08_skew_kurt"] = f"""{_with(PIXELS)}, m AS (SELECT id, count(*) AS n, CAST(sum(g) AS BIGINT) AS s1, CAST(sum(g * g) AS BIGINT) AS s2 FROM px WHERE fg GROUP BY id), d AS (SELECT id, n, s1, s2, g, CAST(n * g - s1 AS HUGEINT) AS d FROM px JOIN m USING (id) WHERE fg),
t AS (SELECT id, n, s1, s2, sum(d * d * d) AS d3, sum(d * d * d * d) AS d4, quantile_cont(g::DOUBLE, 0.1) AS p10, quantile_cont(g::DOUBLE, 0.9) AS p90, CAST(sum(CASE WHEN d > 0 AND d * d > n * s2 - s1 * s1 THEN 1 ELSE 0 END) AS BIGINT) AS above, sqrt((n * s2 - s1 * s1) / (n * n)::DOUBLE) AS sd, n::DOUBLE AS nd FROM d GROUP BY id, n, s1, s2)
SELECT id, n, {_mill("(d3::DOUBLE / (nd * nd * nd * nd) / (sd * sd * sd + 1e-8::DOUBLE))")} AS skew_millionths, {_mill("(d4::DOUBLE / (nd * nd * nd * nd * nd) / (sd * sd * sd * sd + 1e-8::DOUBLE) - 3)")} AS kurtosis_millionths, {_mill('p10')} AS p10_millionths, {_mill('p90')} AS p90_millionths, {_mill("(sd / (s1 / n::DOUBLE + 1e-8::DOUBLE))")} AS cv_millionths, above / n::DOUBLE AS bright FROM t"""
SQL["g20_reliability"] = f"""{_with(PIXELS)}, a AS (SELECT id, sum(g) AS grey_sum, max(g) AS grey_max, count_if(fg) AS fg_count FROM px GROUP BY id), b AS (SELECT id, sum(g) AS grey_sum, max(g) AS grey_max, count_if(fg) AS fg_count FROM px WHERE x % 2 = 0 AND y % 2 = 0 GROUP BY id),
p AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, a.{c}::DOUBLE AS a, b.{c}::DOUBLE AS b FROM a JOIN b USING (id)" for c in ("grey_sum", "grey_max", "fg_count"))}), r AS (SELECT feature, count(*) AS n, corr(a, b) AS r FROM p GROUP BY feature)
SELECT feature, n, CASE WHEN r >= 0.9 THEN 'RELIABLE' WHEN r >= 0.7 THEN 'use with caution' ELSE 'NOT reliable' END AS verdict FROM r"""
SQL["g21_scale"] = f"{_with(LESIONS)}, s AS (SELECT 448.0::DOUBLE / greatest(bbox_width, bbox_height) AS s FROM les) SELECT count(*) AS n, quantile_cont(s, 0.5) AS median, quantile_cont(s, 0.9) AS p90, max(s) AS max, count_if(s > 20)::BIGINT AS over_20, count_if(s > 40)::BIGINT AS over_40 FROM s"
SQL["w10_deciles"] = f"{_with(PIXELS)}, e AS (SELECT id, min(y) AS lo, max(y) AS hi FROM px WHERE fg GROUP BY id) SELECT id, CAST(least(9, floor((y - lo) * 10.0::DOUBLE / (hi - lo + 1e-9::DOUBLE))) AS INTEGER) AS tenth, max(x) - min(x) AS width, count(*) AS n FROM px JOIN e USING (id) WHERE fg GROUP BY ALL"

SQL["r02_weighted_resample"] = f"""{_with(LESIONS)}, z AS (SELECT greatest(64, count(*) // 50000) AS parts, count(*) AS n FROM les WHERE split = 'train'),
t AS (SELECT lesion_id, {_hash("lesion_id", "part:")} % parts AS p, CAST(floor(1e6::DOUBLE * pow(count(*) OVER (PARTITION BY patient), -0.5::DOUBLE) + 0.5::DOUBLE) AS BIGINT) AS w FROM les, z WHERE split = 'train'),
c AS (SELECT lesion_id, w, CAST(sum(w) OVER (ORDER BY p, lesion_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS hi FROM t), d AS (SELECT draw, ({_hash("draw", "a:")} * 1073741824 + {_hash("draw", "b:")} % 1073741824) % (SELECT max(hi) FROM c) AS v FROM (SELECT unnest(range((SELECT n FROM z))) AS draw))
SELECT draw, lesion_id FROM d ASOF JOIN c ON d.v < c.hi"""
_per_patient = "pow(count(*) OVER (PARTITION BY patient)::DOUBLE, -0.5::DOUBLE)"
_per_class = " + ".join(f"n / (k_{f} * count(*) OVER (PARTITION BY {f}))::DOUBLE" for f in V.FACTS)
SQL["r02_class_weights"] = f"""{_with(FACTS)}, t AS (SELECT * FROM facts WHERE split = 'train'), k AS (SELECT count(*) AS n, {", ".join(f"count(DISTINCT {f}) AS k_{f}" for f in V.FACTS)} FROM t)
SELECT lesion_id, 'class' AS scheme, {_mill(f"({_per_patient} * (0.0::DOUBLE + {_per_class}) / 5)")} AS weight FROM t, k
UNION ALL SELECT lesion_id, 'combo', {_mill(f"({_per_patient} * pow(count(*) OVER (PARTITION BY {', '.join(V.FACTS)})::DOUBLE, -0.5::DOUBLE))")} FROM t"""
SQL["p13_patients"] = f"{_with(IMAGES)} SELECT string_split(name, '_')[1] AS patient, split, count(*) AS images FROM images GROUP BY ALL"
SQL["w08_natural_order"] = f"{_with(IMAGES)} SELECT split, name, row_number() OVER (ORDER BY CAST(string_split(name, '_')[1] AS BIGINT), CAST(regexp_extract(name, '_(\\d+)', 1) AS BIGINT)) - 1 AS idx FROM images ORDER BY idx"
SQL["r03_fact_subset"] = f"{_with(FACTS, _SUBSET)} SELECT array_to_string(facts, '+') AS facts, count(*) AS n FROM picked GROUP BY 1"
SQL["r04_hash_sample"] = f"{_with(IMAGES)} SELECT name, split FROM images ORDER BY sha1('sample:' || name), name LIMIT 60"
SQL["w07_one_per_patient"] = f"{_with(IMAGES)} SELECT patient, name FROM images QUALIFY row_number() OVER (PARTITION BY patient ORDER BY sha1('pick:' || name)) = 1"
_BLEU_WORDS = f"pairs AS (SELECT lesion_id, string_split(lower({_answer('asked')}), ' ') AS r, string_split(lower(pred), ' ') AS h FROM answered WHERE prompt_type = 'generic')"
SQL["g26_bleu4"] = f"""{_with(*_EVAL, _BLEU_WORDS)}, grams AS (SELECT lesion_id, n, side, unnest(list_transform(range(1, len(ws) - n + 2), lambda i: array_to_string(ws[i:i + n - 1], ' '))) AS gram FROM (SELECT lesion_id, 'r' AS side, r AS ws FROM pairs UNION ALL SELECT lesion_id, 'h', h FROM pairs), (SELECT unnest([1, 2, 3, 4]) AS n)),
k AS (SELECT lesion_id, n, gram, count_if(side = 'r') AS a, count_if(side = 'h') AS b FROM grams GROUP BY ALL), s AS (SELECT n, CAST(sum(least(a, b)) AS BIGINT) AS m, CAST(sum(b) AS BIGINT) AS t FROM k GROUP BY n),
w AS (SELECT {", ".join(f"max(m) FILTER (n = {n}) AS m{n}, max(t) FILTER (n = {n}) AS t{n}" for n in (1, 2, 3, 4))} FROM s), l AS (SELECT CAST(sum(len(r)) AS BIGINT) AS ref_words, CAST(sum(len(h)) AS BIGINT) AS hyp_words FROM pairs)
SELECT *, {_mill("pow(" + " * ".join(f"(greatest(m{n}::DOUBLE, 0.1::DOUBLE) / greatest(t{n}, 1))" for n in (1, 2, 3, 4)) + ", 0.25::DOUBLE) * CASE WHEN hyp_words >= ref_words THEN 1.0::DOUBLE ELSE exp(1 - ref_words / hyp_words::DOUBLE) END")} AS bleu_millionths FROM w, l"""
SQL["g25_rouge_l"] = f"""{_with(*_EVAL, _BLEU_WORDS)}, lcs AS (SELECT lesion_id, len(r) AS nr, len(h) AS nh, list_reduce(r, lambda row, x: list_reduce(range(1, len(h) + 1), lambda acc, j: acc || [CASE WHEN h[j] = x THEN row[j] + 1 ELSE greatest(row[j + 1], acc[-1]) END], [0::BIGINT]), list_transform(range(len(h) + 1), lambda i: 0::BIGINT)) AS d FROM pairs)
SELECT lesion_id, CAST(d[-1] AS BIGINT) AS lcs, coalesce(2.0::DOUBLE * d[-1] / (nr + nh), 0) AS rouge_l FROM lcs"""
_cross = "(b.x - a.x) * ({p}.y - a.y) - (b.y - a.y) * ({p}.x - a.x)"
SQL["i09_measure"] = f"""{_with(PIXELS, _I01, _I05)}, f AS (SELECT id, x, y FROM px WHERE fg),
edges AS (SELECT a.id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by FROM f a JOIN f b ON a.id = b.id AND (a.x, a.y) <> (b.x, b.y) JOIN f c ON c.id = a.id GROUP BY a.id, a.x, a.y, b.x, b.y HAVING min({_cross.format(p="c")}) >= 0),
hull AS (SELECT p.id, count(*) AS hull FROM px p JOIN i05 USING (id) WHERE p.x >= x0 AND p.x < x1 AND p.y >= y0 AND p.y < y1
  AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.id = p.id AND (e.bx - e.ax) * (p.y - e.ay) - (e.by - e.ay) * (p.x - e.ax) < 0) GROUP BY p.id),
e AS (SELECT *, (cxx + cyy) / 2 AS half, sqrt((cxx - cyy) * (cxx - cyy) / 4 + cxy * cxy) AS gap, abs(degrees(0.5::DOUBLE * atan2(2 * cxy, cxx - cyy))) AS turn FROM i05)
SELECT id, area, hull, mean, std, CASE WHEN sqrt((half + gap) / (half - gap)) < 1.5::DOUBLE THEN 'none' WHEN turn <= 22.5 THEN 'horizontal' WHEN turn <= 67.5 THEN 'diagonal' ELSE 'vertical' END AS orientation
FROM e JOIN hull USING (id) JOIN i01 USING (id)"""
_LCS = "list_reduce(r, lambda row, x: list_reduce(range(1, len(h) + 1), lambda acc, j: acc || [CASE WHEN h[j] = x THEN row[j] + 1 ELSE greatest(row[j + 1], acc[-1]) END], [0::BIGINT]), list_transform(range(len(h) + 1), lambda i: 0::BIGINT))[-1]"
_right = " + ".join(f"CAST(list_contains(asked, '{f}') AND coalesce({_read(f, 'pred')} = {f}, false) AS INTEGER)" for f in V.FACTS)
SQL["g22_batch_means"] = f"""{_with(*_EVAL)}, p AS (SELECT prompt_type, ({_right}) / len(asked)::DOUBLE AS accuracy, string_split(lower({_answer("asked")}), ' ') AS r, string_split(lower(pred), ' ') AS h FROM answered),
s AS (SELECT prompt_type, accuracy, 2.0::DOUBLE * {_LCS} / (len(r) + len(h)) AS rouge FROM p) SELECT prompt_type, count(*) AS n, {_mean("accuracy")} AS feat_acc, {_mean("rouge")} AS rouge_l FROM s GROUP BY prompt_type"""
SQL["g24_integrity"] = f"WITH m AS ({SQL['j04_best_blob']}) SELECT status, count(*) AS n, min(overlap_millionths) AS least, CAST(sum(overlap_millionths) AS BIGINT) / (count(*) * 1e6::DOUBLE) AS mean_overlap FROM m GROUP BY status"
SQL["n02_predictors"] = f"""{_with(*_EVAL, _MAJOR)} SELECT 'oracle' AS predictor, fact, count(*) AS n, count(*) AS "right" FROM long GROUP BY fact
UNION ALL SELECT 'majority', fact, count(*), count_if(truth = label)::BIGINT FROM long JOIN major USING (fact) GROUP BY fact"""
_clause = lambda f, v: f"{_quote(V.CLAUSES[f][0])} || {_words(v, V.CLAUSES[f][1])} || {_quote(V.CLAUSES[f][2])}"
_shown = " || '; ' || ".join(f"CASE WHEN {_read(f, 'pred')} IS NULL THEN '{f} (not stated)' WHEN {_read(f, 'pred')} <> {f} THEN '[[' || {_clause(f, _read(f, 'pred'))} || ']]' ELSE {_clause(f, _read(f, 'pred'))} END" for f in V.FACTS)
SQL["p32_marked_clauses"] = f"{_with(*_EVAL)} SELECT lesion_id, {_shown} AS marked FROM answered WHERE prompt_type = 'generic'"
SQL["w03_lesions_per_image"] = f"{_with(LESIONS)}, c AS (SELECT image, count(*) AS lesions FROM ann GROUP BY image) SELECT lesions, count(*) AS images, CAST(sum(lesions) AS BIGINT) AS n FROM c GROUP BY lesions"
SQL["i11_slice_filter"] = f"""{_with(PIXELS)}, s AS (SELECT id, count_if(x BETWEEN 2 AND 5 AND y BETWEEN 2 AND 5 AND g BETWEEN 60 AND 170)::BIGINT / count_if(x BETWEEN 2 AND 5 AND y BETWEEN 2 AND 5)::DOUBLE AS mid,
count_if(x BETWEEN 2 AND 5 AND y >= 4 AND g >= 230)::BIGINT / count_if(x BETWEEN 2 AND 5 AND y >= 4)::DOUBLE AS white FROM px GROUP BY id) SELECT * FROM s WHERE mid >= 0.55 AND white <= 0.03"""
_u = lambda salt: f"({_hash('lesion_id', salt + ':')} / 4294967296.0::DOUBLE)"
_mv = lambda c, axis, size: f"({c} - {size} / 2) * (0.9::DOUBLE + 0.2::DOUBLE * {_u('scale')}) + {size} / 2 + (2 * {_u('shift-' + axis)} - 1) * 0.05::DOUBLE * {size}"
SQL["r05_moved_boxes"] = f"""{_with(LESIONS)}, m AS (SELECT lesion_id, w, h, {", ".join(f"{_mv(a + e, a, s)} AS m_{a}{e}" for a, s in (("x", "w"), ("y", "h")) for e in "01")} FROM les),
n AS (SELECT *, {", ".join(f"least(greatest(m_{a}{e}, 0.0::DOUBLE), {s}) AS {a}{e}" for a, s in (("x", "w"), ("y", "h")) for e in "01")} FROM m), t AS (SELECT *, {_tokens()} AS loc FROM n), d AS (SELECT *, ({_decoded("loc")})[1] AS b FROM t)
SELECT lesion_id, x1 - x0 >= 4 AND y1 - y0 >= 4 AND (x1 - x0) * (y1 - y0) >= 0.8::DOUBLE * ((m_x1 - m_x0) * (m_y1 - m_y0)) AS kept, loc, {_third("(b.y0 + b.y1) / 2 / h", _Vv)} || '-' || {_third("(b.x0 + b.x1) / 2 / w", _H)} AS region FROM d"""
_ORIENT = "CASE WHEN sqrt((half + gap) / (half - gap)) < 1.5::DOUBLE THEN 'none' WHEN turn <= 22.5 THEN 'horizontal' WHEN turn <= 67.5 THEN 'diagonal' ELSE 'vertical' END"
_flip = lambda name, source: f"{name} AS (SELECT id, {_ORIENT} AS o FROM (SELECT id, (cxx + cyy) / 2 AS half, sqrt((cxx - cyy) * (cxx - cyy) / 4 + cxy * cxy) AS gap, abs(degrees(0.5::DOUBLE * atan2(2 * cxy, cxx - cyy))) AS turn FROM (SELECT id, (count(*) * sum(x * x)::BIGINT - sum(x)::BIGINT * sum(x)::BIGINT) / (count(*) * count(*))::DOUBLE + 1.0::DOUBLE / 12 AS cxx, (count(*) * sum(y * y)::BIGINT - sum(y)::BIGINT * sum(y)::BIGINT) / (count(*) * count(*))::DOUBLE + 1.0::DOUBLE / 12 AS cyy, (count(*) * sum(x * y)::BIGINT - sum(x)::BIGINT * sum(y)::BIGINT) / (count(*) * count(*))::DOUBLE AS cxy FROM {source} WHERE fg GROUP BY id)))"
SQL["r06_flips"] = f"""{_with(PIXELS)}, w AS (SELECT *, CAST({_hash("id", "flip:")} % 8 AS INTEGER) AS way FROM px), m AS (SELECT id, way, fg, CASE WHEN way >= 4 THEN 7 - x ELSE x END AS x, y FROM w),
t AS (SELECT id, way, fg, CASE way % 4 WHEN 0 THEN x WHEN 1 THEN y WHEN 2 THEN 7 - x ELSE 7 - y END AS x, CASE way % 4 WHEN 0 THEN y WHEN 1 THEN 7 - x WHEN 2 THEN 7 - y ELSE x END AS y FROM m),
{_flip("before_t", "px")}, {_flip("after_t", "t")} SELECT way % 2 AS odd_turn, b.o AS before, a.o AS after, count(*) AS n FROM before_t b JOIN after_t a USING (id) JOIN (SELECT DISTINCT id, way FROM w) USING (id) GROUP BY ALL"""

_BOXED = "im AS (SELECT id, x, y, least(255, greatest(0, g)) AS g, fg, id % 3 AS x0, id % 2 AS y0, id % 3 + 3 + id % 4 AS x1, id % 2 + 4 + id % 3 AS y1 FROM px), bx AS (SELECT *, x >= x0 AND x < x1 AND y >= y0 AND y < y1 AS inside FROM im)"
SQL["i01_box_intensity"] = f"""{_with(PIXELS, _BOXED)}, a AS (SELECT id, count(*) AS n, CAST(sum(g) AS BIGINT) AS s1, CAST(sum(g * g) AS BIGINT) AS s2, min(g)::DOUBLE AS min, max(g)::DOUBLE AS max, quantile_cont(g::DOUBLE, 0.25) AS q25, quantile_cont(g::DOUBLE, 0.5) AS median, quantile_cont(g::DOUBLE, 0.75) AS q75 FROM bx WHERE inside GROUP BY id),
r AS (SELECT id, CAST(sum(g) AS BIGINT) / count(*)::DOUBLE AS ring FROM bx WHERE NOT inside AND x >= x0 - 2 AND x < x1 + 2 AND y >= y0 - 2 AND y < y1 + 2 GROUP BY id)
SELECT id, s1 / n::DOUBLE AS mean, median, {_mill("sqrt((n * s2 - s1 * s1) / (n * n)::DOUBLE)")} AS std_millionths, min, max, q25, q75, ring AS surround, s1 / n::DOUBLE - ring AS difference, CASE WHEN ring > 0 THEN s1 / n::DOUBLE / ring ELSE 'nan'::DOUBLE END AS ratio FROM a JOIN r USING (id)"""
SQL["i04_blob_boxes"] = f"WITH b AS ({SQL['i04_components']}) SELECT id, area, x0, y0, x1, y1, area < 20 AS unannotated FROM b"
_hex = lambda g, where, order="y, x": f"coalesce(string_agg(printf('%02X', {g}), '' ORDER BY {order}) FILTER ({where}), '')"
SQL["i06_crops"] = f"""{_with(PIXELS, _BOXED)}, w AS (SELECT *, greatest(0, CAST(floor(x0 - (x1 - x0) * 0.25::DOUBLE) AS BIGINT)) AS a0, greatest(0, CAST(floor(y0 - (y1 - y0) * 0.25::DOUBLE) AS BIGINT)) AS b0, least(8, CAST(ceil(x1 + (x1 - x0) * 0.25::DOUBLE) AS BIGINT)) AS a1, least(8, CAST(ceil(y1 + (y1 - y0) * 0.25::DOUBLE) AS BIGINT)) AS b1 FROM bx),
p AS (SELECT *, x >= a0 AND x < a1 AND y >= b0 AND y < b1 AS wide FROM w),
f AS (SELECT c.id, c.i, c.j, coalesce(im.g, 0) AS g FROM (SELECT DISTINCT id, (x0 + x1) // 2 - 5 AS l, (y0 + y1) // 2 - 5 AS t, i, j FROM im, (SELECT unnest(range(10)) AS i), (SELECT unnest(range(10)) AS j)) c LEFT JOIN im ON im.id = c.id AND im.x = c.l + c.i AND im.y = c.t + c.j),
fw AS (SELECT id, string_agg(printf('%02X', g), '' ORDER BY j, i) AS "window" FROM f GROUP BY id)
SELECT p.id, any_value(x1 - x0) AS exact_w, any_value(y1 - y0) AS exact_h, any_value(a1 - a0) AS padded_w, any_value(b1 - b0) AS padded_h, {_hex("g", "inside")} AS exact, {_hex("g", "wide")} AS padded,
{_hex("CASE WHEN fg THEN g ELSE CAST(floor(g::FLOAT * 0.35::FLOAT) AS BIGINT) END", "wide")} AS highlighted, any_value(fw."window") AS "window" FROM p JOIN fw ON fw.id = p.id GROUP BY p.id"""
SQL["i10_letterbox"] = f"{_with(PIXELS)} SELECT id, x + 1 AS x, y, g FROM px WHERE x < 5"
SQL["s07_shards_last_wins"] = SQL["w06_last_wins"]
SQL["s08_config"] = SQL["g01_thresholds"]
SQL["s10_features_csv"] = f"{_with(LESIONS)} SELECT lesion_id, split, bbox_width, center_x_norm FROM les"
SQL["s15_datasets"] = f"WITH w AS ({SQL['w02_unambiguous_prompts']}) SELECT 'size_region' AS prompt_group, split, count_if(shape <> 'tall')::BIGINT AS written, count_if(shape = 'tall')::BIGINT AS skipped, count_if(shape <> 'tall')::BIGINT AS read, count(DISTINCT prompt) FILTER (shape <> 'tall') AS prompts FROM w GROUP BY split"
SQL["s02_negatives"] = f"{_with(IMAGES)} SELECT split, count(*) AS images, count_if(image NOT IN (SELECT l_orderkey FROM lineitem))::BIGINT AS negatives FROM images GROUP BY split"
SQL["s01_coco"] = f"{_with(LESIONS)} SELECT split, CASE WHEN image % 11 <> 0 THEN name END AS name, image * 1000 + ord AS ann_id, ord, x0, y0, x1, y1 FROM les"
SQL["s03_listing"] = f"{_with(IMAGES)} SELECT DISTINCT split, true AS filled FROM images"
SQL["s11_report"] = SQL["p06_shape"]
SQL["s13_records"] = f"{_with(LESIONS)} SELECT split, lesion_id, bbox_area_ratio, aspect_ratio, center_x_norm FROM les"
SQL["s14_error_report"] = SQL["p02_bbox_errors"]
SQL["s18_markdown"] = f"WITH c AS ({SQL['g03_counts']}) SELECT printf('| %s | %d | %d | %d |', region, train, valid, test) AS line FROM c"
SQL["s20_resumed_answers"] = f"{_with(LABELLED, _SCORED)} SELECT condition, lesion_id, CASE WHEN len(locs) = 0 THEN 'none' ELSE array_to_string(list_transform(locs, lambda l: l || ' lesion'), ' ; ') END AS pred FROM answers"
SQL["s22_epoch_metrics"] = f"{_with(FACTS)} SELECT CAST(pk % 3 AS INTEGER) AS epoch, shape, count(*) AS n FROM facts GROUP BY ALL"
SQL["p30_rate"] = f"{_with(IMAGES)} SELECT image, {_mill('CASE WHEN image < 200 THEN (image + 1) / 200.0::DOUBLE ELSE 0.01::DOUBLE + (1.0::DOUBLE - 0.01::DOUBLE) / 2 * (1.0::DOUBLE + cos(least(1.0::DOUBLE, (image - 200) / 39800.0::DOUBLE) * pi())) END')} AS rate_millionths FROM images"
SQL["p31_wrapped"] = f"""{_with(LABELLED, _prompts(['size_shape_region']))}, p AS (SELECT prompt, count(*) AS n FROM prompts GROUP BY prompt)
SELECT prompt, n, list_reduce(string_split(prompt, ' '), lambda ls, w: ls || CASE WHEN length(string_split(ls, chr(10))[-1]) + 1 + length(w) <= 24 THEN ' ' ELSE chr(10) END || w) AS lines FROM p"""
SQL["j03_three_lists"] = f"""{_with(IMAGES)}, f AS (SELECT name, image % 3 <> 0 AS p, image % 5 <> 0 AS m, image % 7 <> 0 AS l FROM images)
SELECT name, 'png_without_mask' AS kind FROM f WHERE p AND NOT m UNION ALL SELECT name, 'mask_without_png' FROM f WHERE m AND NOT p
UNION ALL SELECT name, 'coco_entry_without_file' FROM f WHERE l AND NOT (p AND m) UNION ALL SELECT name, 'png_not_in_any_coco_split' FROM f WHERE p AND NOT l"""
_PLAIN = _quote(V.PROMPTS["baseline"].format(cls=V.CLS))
_PROBLEMS = f"""feat AS (SELECT * EXCLUDE (prompt, loc), CASE WHEN pk % 43 = 0 AND prompt_group = 'size_shape_region' THEN {_PLAIN} ELSE prompt END AS prompt, CASE WHEN pk % 41 = 0 THEN '<loc0000><loc0000><loc0300><loc0300>' ELSE loc END AS loc FROM prompts WHERE n_same = 1),
tgt AS (SELECT *, CASE WHEN pk % 23 = 0 THEN loc || ' lesion' WHEN pk % 31 = 0 THEN loc || ' lesion ; ' || loc || ' lesion<eos>' WHEN pk % 37 = 0 THEN '<eos>' ELSE loc || ' lesion<eos>' END AS suffix FROM feat),
{_AUDIT.replace("FROM prompts WHERE n_same = 1", "FROM tgt WHERE len(regexp_extract_all(suffix, '<loc[0-9]+>')) = 4").replace("SELECT prompt_group,", "SELECT prompt_group, split, name,")},
base AS (SELECT split, name, any_value(image) AS image, coalesce(string_agg(loc || ' lesion', ' ; ' ORDER BY ord) FILTER (pk % 9 <> 0), '') || CASE WHEN any_value(image) % 19 = 0 THEN '' ELSE '<eos>' END AS suffix FROM images LEFT JOIN labelled USING (image, name, split) GROUP BY split, name),
problems AS (SELECT prompt_group, split, name, 'box_count' AS problem, suffix AS detail FROM tgt WHERE len(regexp_extract_all(suffix, '<loc[0-9]+>')) <> 4
UNION ALL SELECT prompt_group, split, name, 'no_end', suffix FROM tgt WHERE len(regexp_extract_all(suffix, '<loc[0-9]+>')) = 4 AND NOT suffix LIKE '%<eos>'
UNION ALL SELECT prompt_group, split, name, 'not_in_baseline', loc FROM tgt t WHERE len(regexp_extract_all(suffix, '<loc[0-9]+>')) = 4 AND NOT EXISTS (SELECT 1 FROM labelled b WHERE b.name = t.name AND b.split = t.split AND b.loc = t.loc AND b.pk % 9 <> 0)
UNION ALL SELECT prompt_group, split, name, 'negative', suffix FROM tgt WHERE NOT contains(suffix, '<loc')
UNION ALL SELECT prompt_group, split, name, 'features', prompt FROM tgt WHERE prompt_group = 'size_shape_region' AND pk % 43 = 0
UNION ALL SELECT prompt_group, split, name, 'claim_' || kind, claimed || ' / ' || derived FROM claimed WHERE claimed <> derived
UNION ALL SELECT 'baseline', split, name, 'negative_target', suffix FROM base WHERE NOT contains(suffix, '<loc') AND suffix <> '<eos>'
UNION ALL SELECT 'baseline', split, name, 'prompt_text', 'detect a lesion' FROM base WHERE image % 27 = 0
UNION ALL SELECT 'baseline', split, name, 'no_end', suffix FROM base WHERE NOT suffix LIKE '%<eos>')"""
SQL["g23_problems"] = f"{_with(LABELLED, _prompts(_FEATURE_GROUPS), _PROBLEMS)} SELECT prompt_group, problem, count(*) AS n FROM problems GROUP BY ALL"
SQL["g23_first_problems"] = f"{_with(LABELLED, _prompts(_FEATURE_GROUPS), _PROBLEMS)} SELECT * FROM problems ORDER BY prompt_group, split, name, problem, detail LIMIT 15"
SQL["g24_crops"] = f"WITH c AS ({SQL['i06_crops']}) SELECT count(*) AS n, count_if(least(exact_w, exact_h) < 4)::BIGINT AS exact_small, count_if(least(padded_w, padded_h) < 6)::BIGINT AS padded_small, count_if(greatest(exact_w, exact_h) > 4)::BIGINT AS over_window FROM c"
SQL["n01_predict"] = f"{_with(LABELLED, _prompts(['size_region']))} SELECT lesion_id, replace(prompt, 'detect', 'found') AS pred FROM prompts WHERE n_same = 1 AND split = 'test'"
SQL["n02_prior_box"] = f"{_with(LABELLED, _PRIOR)} SELECT lesion_id, {_tokens('p_x0', 'p_y0', 'p_x1', 'p_y1')} || ' lesion' AS pred FROM withprior"
SQL["n05_metric"] = f"{_with(LABELLED)} SELECT size, count(*) AS n, 'lesions by size' AS description FROM labelled GROUP BY size"
