"""For every query, SQL over the given tables that must return the same rows."""

from __future__ import annotations

from quizlens.contract.inputs import DISPLAY, LANGS, NAMES
from quizlens.values import (
    MAX_TILES,
    POLICIES,
    PROMPTS,
    TILE_SIZE,
    WHITESPACE_CHARS,
    WHITESPACE_CLASS,
)

# --- the inputs as common table expressions ------------------------------------

GRADED = """graded as (
select concat('Supplier ', cast(l_suppkey % 10 as string)) as algorithm,
  case when l_shipdate < timestamp '1996-01-01 00:00:00' then 'flore'
       when l_shipdate < timestamp '1999-01-01 00:00:00' then 'wiki' else 'other' end as dataset,
  case when l_orderkey % 2 = 0 then 'ita' else 'eng' end as lang,
  concat(p_brand, ' / ', p_type) as picture,
  case l_returnflag when 'N' then 'OK' when 'A' then 'NO' else 'ERR' end as subject_1,
  case when l_linestatus='O' and l_quantity > 40 then 'PAR' when l_linestatus='O' then 'OK'
       when l_linenumber > 5 then 'ERR' else 'NO' end as city_1,
  case when l_returnflag='N' or l_discount < 0.01 then null when l_linestatus='F' then 'OK'
       when l_quantity > 25 then 'NO' else 'ERR' end as subject_2
from lineitem join part on l_partkey = p_partkey)"""

# One row per line item, without the picture's name.
LABELLED = GRADED.replace("  concat(p_brand, ' / ', p_type) as picture,\n", "").replace(
    " join part on l_partkey = p_partkey", "")

DOCGRADED = """docgraded as (
select d.source as algorithm, d.lang as dataset, d.doc_id,
  case when l.quality = 1 then 'OK' when l.quality = 0 and l.toxic = 1 then 'ERR'
       when l.quality = 0 then 'NO' end as subject_1,
  case when l.toxic = 0 then 'OK' when l.toxic = 1 then 'PAR' end as city_1
from documents d left join labels l on d.doc_id = l.doc_id)"""

CATALOGUE = """catalogue as (
select p_size as id, concat(min(p_name), '  ') as subject, concat(' ', min(p_brand), ' ') as city
from part where p_size <= 25 group by p_size)"""

IMAGES = """img as (
select p_partkey as image_id, cast(200 + (p_partkey * 37) % 1800 as int) as width,
  cast(150 + (p_partkey * 53) % 1500 as int) as height,
  concat('./dataset/i', cast(1 + p_partkey % 25 as string), '_',
    case when p_size % 3 = 0 then 'flore'
         when p_size % 3 = 1 then concat('wiki_', replace(p_name, ' ', '-')) else 'other' end,
    case when p_partkey % 10 = 0 then '.JPEG' when p_partkey % 10 = 1 then '.txt' else '.jpg' end) as path
from part)"""

FILES = LABELLED.replace("graded as (", "labels_of as (", 1).replace(
    "select concat", "select l_partkey, l_orderkey, l_linenumber, l_linestatus, l_returnflag, l_tax, "
    "concat", 1) + """, graded_file as (
select cast(l_partkey % 25 + 1 as int) as id,
  concat(algorithm, '_', lang) as model,
  concat('./dataset/i', l_partkey % 25 + 1, '_', dataset, '_', l_partkey, '.jpg') as path,
  dataset,
  concat('City ', (l_partkey % 25 + 1) % 7) as city,
  concat('Subject ', l_partkey % 25 + 1,
    case when l_partkey % 25 + 1 = 17 then '/Portici' else '' end) as subject,
  concat(' It is "', l_returnflag, '" | ', l_orderkey, ' \\ ', chr(10), chr(9), 'end', chr(10)) as answer_1,
  case l_linenumber when 1 then '0' when 2 then '1' when 3 then '0,5' when 4 then '*0,5' end as score_1,
  city_1, subject_1,
  case when l_tax > 0.04 then 'OK' when l_tax > 0.02 then 'NO' else 'ERR' end as description_1,
  case when subject_2 is not null then concat('No. ', l_linestatus) end as answer_2,
  cast(null as varchar) as score_2,
  subject_2,
  case when subject_2 is not null then
    case when l_tax > 0.04 then 'OK' when l_tax > 0.02 then 'NO' else 'ERR' end end as description_2,
  case when l_linenumber = 7 then 'check again ' end as note,
  lang
from labels_of)"""

_W = WHITESPACE_CLASS
_CHARS = WHITESPACE_CHARS

PICTURES = f"""{CATALOGUE}, {IMAGES}, parsed as (
select *, string_split(path, '/')[-1] as file,
  cast(replace(string_split(string_split(path, '/')[-1], '_')[1], 'i', '') as int) as id
from img), pictures as (
select p.*, trim(c.city, '{_CHARS}') as city, trim(c.subject, '{_CHARS}') as subject
from parsed p join catalogue c on p.id = c.id)"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _values(rows) -> str:
    cells = ("(" + ", ".join(
        str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else _quoted(v)
        for v in row) + ")" for row in rows)
    return "(values " + ", ".join(cells) + ")"


REQUESTS = PICTURES + f""", prompts as (
select * from {_values((lang, n, t) for lang in LANGS for n, t in PROMPTS[lang].items())}
  as t(lang, question_no, template)), requests as (
select image_id, path, lang, question_no, replace(template, 'CITY', city) as question, subject
from pictures cross join prompts)"""

_POLICY_ROWS = _values(
    (i, p.model, p.history, p.image_in_turn_2, p.image_first, p.blank_turn, p.raw_history)
    for i, p in enumerate(POLICIES))
MODEL_REQUESTS = REQUESTS + f""", policies as (
select * from {_POLICY_ROWS} as t(no, model, history, image_in_turn_2, image_first, blank_turn, raw_history)),
asked as (
select a.image_id, a.path, a.lang, a.subject, a.question as q1, b.question as q2, policies.* exclude (no)
from requests a join requests b on a.image_id = b.image_id and a.lang = b.lang
join policies on no = a.image_id % {len(POLICIES)}
where a.question_no = 1 and b.question_no = 2)"""

_SCORES = """avg(case when subject_1 = 'OK' then 1 else 0 end) as subject_accuracy,
  avg(case when city_1 = 'OK' then 1 else 0 end) as city_accuracy,
  avg(case when subject_1 = 'OK' or coalesce(subject_2, '') = 'OK' then 1 else 0 end)
    as subject_accuracy_2q"""

_NAMES = f"names as (select * from {_values((n, i) for i, n in enumerate(NAMES))} as t(algorithm, display_order))"


_MISSED = "".join(
    f", {lang} as (select * from graded where lang = '{lang}' and subject_1 is distinct from 'OK')"
    for lang in LANGS)


def _difference(before: str, after: str, source: str = "graded") -> str:
    columns = ", ".join(
        f"cast(coalesce(count(*) filter (where {after} = '{o}'), 0)"
        f" - coalesce(count(*) filter (where {before} = '{o}'), 0) as bigint) as \"{o}\""
        for o in ("OK", "NO", "ERR"))
    return (f"select n.algorithm, {columns}, n.display_order from names n"
            f" left join {source} g on n.algorithm = g.algorithm group by n.algorithm, n.display_order")


def _combo(outcome: str) -> str:
    return f"""select picture, concat({outcome}, case lang when 'eng' then ' (EN)' else ' (IT)' end)
        as {outcome}, count(*) as count, case lang when 'eng' then 0 else 1 end as lang_order,
        case concat(graded.{outcome}, lang) when 'OKita' then 0 when 'OKeng' then 1 when 'NOita' then 2
          when 'NOeng' then 3 when 'ERRita' then 4 when 'ERReng' then 5
          when 'PARita' then 6 when 'PAReng' then 7 end as display_order
      from graded where {outcome} is not null group by picture, lang, graded.{outcome}"""


def _long(table: str, select: str, labels: list[str], numbers: list[str]) -> str:
    key = " || ' | ' || ".join(labels)
    values = ", ".join(f'"{n}"::double as "{n}"' for n in numbers)
    names = ", ".join(f'"{n}"' for n in numbers)
    return (f"select * from (unpivot (select '{table}' as \"table\", {key} as key, {values}"
            f" from ({select})) on {names} into name measure value value)")


def _report() -> str:
    shares = ["subject_accuracy", "city_accuracy", "subject_accuracy_2q"]
    changes = ["OK", "NO", "ERR", "display_order"]
    parts = []
    for lang in LANGS:
        rows = f"(select * from graded where lang = '{lang}')"
        parts.append(_long(f"accuracy_{lang}", "select algorithm, dataset, " + _SCORES
                           + f" from {rows} group by all", ["algorithm", "dataset"], shares))
        for name, outcome in (("subject1", "subject_1"), ("city1", "city_1")):
            counts = (f"select picture, {outcome}, count(*) as count from {rows}"
                      f" where {outcome} is not null group by all")
            parts.append(_long(f"picture_{name}_{lang}", counts, ["picture", outcome], ["count"]))
        parts.append(_long(f"{lang}_subject_diff", _difference("subject_1", "subject_2", lang),
                           ["algorithm"], changes))
    for name, outcome in (("subject1", "subject_1"), ("city1", "city_1")):
        parts.append(_long(f"picture_{name}_combo", _combo(outcome), ["picture", outcome],
                           ["count", "lang_order", "display_order"]))
    parts.append(_long("ita_eng_diff", _difference(
        "case when lang = 'ita' then subject_1 end", "case when lang = 'eng' then subject_1 end"),
        ["algorithm"], changes))
    return f"with {GRADED}, {_NAMES}{_MISSED} " + " union all ".join(parts)


def _picture_counts(outcome: str) -> str:
    return (f"with {GRADED} select lang, picture, {outcome}, count(*) as count from graded"
            f" where {outcome} is not null group by all")


# --- tile plans: brute force over all grids ---------------------------------------

TILES = f"""{IMAGES}, grids as (
select cast(i as int) as cols, cast(j as int) as rows, cast(i * j as int) as area,
  row_number() over (order by i * j, i) as grid_rank
from range(1, {MAX_TILES + 1}) a(i) cross join range(1, {MAX_TILES + 1}) b(j)
where i * j <= {MAX_TILES}), distances as (
select img.*, cols, rows, area, grid_rank,
  abs(width::double / height - cols::double / rows) as distance,
  width::bigint * height > 0.5::double * {TILE_SIZE * TILE_SIZE} * area as large_enough
from img cross join grids), nearest as (
select *, min(distance) over (partition by image_id) as best from distances), ties as (
select *, min(grid_rank) over (partition by image_id) as first_rank from nearest where distance = best
), chosen as (
select image_id, width, height, cols, rows, area as blocks from ties
where large_enough or grid_rank = first_rank
qualify grid_rank = max(grid_rank) over (partition by image_id))"""

GALLERY = f"""{CATALOGUE}, {IMAGES}, files as (
select image_id, string_split(path, '/')[-1] as file from img), gallery as (
select image_id, file, source, source_order from files
join (values ('flore', 0), ('wiki', 1), ('other', 2)) s(source, source_order)
  on contains(file, source)
where regexp_matches(lower(file), '(png|jpg|jpeg)$') and not contains(file, 'widget')), labelled as (
select g.*, case when contains(file, 'i17') then 'Torri'
  when contains(file, 'i12') then concat(subject, ' - Milano') else subject end as label
from gallery g join catalogue c
  on c.id = cast(substr(string_split(file, '_')[1], 2) as int))"""

# --- the plain responder and the models' cleaning, spelled out -------------------

_ANSWER_2 = """case model
    when 'phi3' then raw_2
    when 'cogvlm2' then regexp_replace(string_split(raw_2, '<|end_of_text|>')[1], '{w}+', ' ', 'g')
    when 'pixtral' then regexp_replace(
      replace(replace(replace(raw_2, q1, ''), q2, ''), chr(10), ''), '{w}+', ' ', 'g')
    when 'llava1.6' then substr(
      regexp_replace(raw_2, '{w}+', ' ', 'g'), 1 + length(answer_1) % 5)
    else regexp_replace(raw_2, '{w}+', ' ', 'g') end""".replace("{w}", _W)
_ANSWER_1 = """case model
    when 'phi3' then raw_1
    when 'cogvlm2' then regexp_replace(string_split(raw_1, '<|end_of_text|>')[1], '{w}+', ' ', 'g')
    when 'pixtral' then regexp_replace(replace(raw_1, q1, ''), '{w}+', ' ', 'g')
    when 'llava1.6' then replace(
      regexp_replace(raw_1, '{w}+', ' ', 'g'), concat('[INST] ', q1, ' [/INST] '), '')
    else regexp_replace(raw_1, '{w}+', ' ', 'g') end""".replace("{w}", _W)
STUB = f"""{MODEL_REQUESTS}, raw_first as (
select *, concat(q1, ' turns ', 1 + blank_turn::int, ';  parts ', 2 + blank_turn::int, ';', chr(10),
  'told 0<|end_of_text|>x') as raw_1
from asked), first as (select *, {_ANSWER_1} as answer_1 from raw_first), raw_second as (
select *, concat(q2,
  ' turns ', case when history then 3 + 2 * blank_turn::int else 1 + blank_turn::int end,
  ';  parts ', case when history then 3 + 2 * blank_turn::int else 1 + blank_turn::int end
    + image_in_turn_2::int, ';', chr(10),
  'told ', case when not history then 0 when raw_history then length(raw_1) else length(answer_1) end,
  '<|end_of_text|>x') as raw_2
from first)"""

TURN_1 = f"""{MODEL_REQUESTS}
select image_id, model, lang, 0 as turn_no, 'user' as role, image_first::int as part_no,
  'text' as type, q1 as text, cast(null as varchar) as image from asked
union all select image_id, model, lang, 0, 'user', 1 - image_first::int, 'image', null, path
  from asked
union all select image_id, model, lang, 1, 'assistant', 0, 'text', '', null from asked where blank_turn"""

TURN_2 = f"""{MODEL_REQUESTS}, a as (select *, blank_turn::int as b from asked)
select image_id, model, lang, 0 as turn_no, 'user' as role,
  (image_first and image_in_turn_2)::int as part_no, 'text' as type,
  case when history then q1 else q2 end as text, cast(null as varchar) as image from a
union all select image_id, model, lang, 0, 'user', 1 - image_first::int, 'image', null, path
  from a where image_in_turn_2
union all select image_id, model, lang, 1, 'assistant', 0, 'text', '', null from a where blank_turn
union all select image_id, model, lang, 1 + b, 'assistant', 0, 'text', concat('It is ', subject), null
  from a where history
union all select image_id, model, lang, 2 + b, 'user', 0, 'text', q2, null from a where history
union all select image_id, model, lang, 4, 'assistant', 0, 'text', '', null from a
  where history and blank_turn"""

ANSWERS = f"""{PICTURES}, answers as (
select image_id, cast(id as varchar) as id, path,
  case when contains(file, 'wiki') then 'wiki'
    else string_split(string_split(file, '_')[2], '.')[1] end as dataset,
  city, subject,
  concat(' "A ', subject, '", \\n ') as answer_1,
  case when image_id % 3 > 0 then concat('In ', city, ' ') end as answer_2
from pictures)"""
_SEVEN = "id, path, dataset, city, subject, answer_1"

ORACLES = {
    "accuracy_by_dataset":
        f"with {LABELLED} select algorithm, dataset, {_SCORES} from graded group by all",
    "picture_outcomes_subject": _picture_counts("subject_1"),
    "picture_outcomes_city": _picture_counts("city_1"),
    "picture_outcomes_combo": f"with {GRADED} {_combo('city_1')}",
    "outcome_counts":
        f"""with {LABELLED} select algorithm, subject_2, count(*) as count
        from graded where subject_2 is not null group by all""",
    "diff_language": f"with {LABELLED}, {_NAMES} " + _difference(
        "case when lang = 'ita' then subject_1 end", "case when lang = 'eng' then subject_1 end"),
    "diff_followup": f"with {LABELLED}, {_NAMES}{_MISSED} " + " union all ".join(
        f"select *, '{lang}' as lang from ({_difference('subject_1', 'subject_2', lang)})"
        for lang in LANGS),
    "report_tables": _report(),
    "flag_ok":
        f"""with {DOCGRADED} select doc_id, subject_1, city_1,
          coalesce(subject_1 = 'OK', false) as subject_ok,
          coalesce(city_1 = 'OK', false) as city_ok from docgraded""",
    "flag_ok_2q":
        f"""with {LABELLED} select algorithm, dataset, lang, subject_1, subject_2,
          coalesce(subject_1 = 'OK', false) or (subject_1 is distinct from 'OK'
            and coalesce(subject_2 = 'OK', false)) as subject_ok_2q from graded""",
    "filter_not_ok":
        f"""with {DOCGRADED} select doc_id, algorithm, subject_1 from docgraded
        where subject_1 is distinct from 'OK'""",
    "exclude_paths":
        f"""with {IMAGES} select image_id, path from img where path not in (
          './dataset/i2_flore.jpg', './dataset/i3_other.jpg', './dataset/i6_wiki_hot-gear.jpg')""",
    "map_display_name":
        f"""with {FILES}, names as (select * from {_values(DISPLAY.items())} as t(raw, algorithm))
        select model, names.algorithm, count(*) as rows from graded_file
        join names on raw = left(model, length(model) - 4) group by all""",
    "picture_key":
        f"""with {FILES} select path, dataset,
          case when city <> 'City 3' then city || ' / ' || replace(subject, '/Portici', '') end as picture
        from graded_file""",
    "audit_domains":
        f"with {LABELLED} " + " union all ".join(
            f"select lang, '{c}' as \"column\", {c} as value, count(*) as rows from graded"
            f" group by lang, {c}" for c in ("city_1", "subject_1", "subject_2")),
    "audit_nulls":
        f"""with {DOCGRADED} select dataset, count(*) - count(city_1) as city_1_nulls,
          count(*) - count(subject_1) as subject_1_nulls from docgraded group by dataset""",
    "audit_null_rows": f"with {DOCGRADED} select * from docgraded where subject_1 is null",
    "parse_path":
        f"""with {IMAGES}, f as (select image_id, string_split(path, '/')[-1] as file from img)
        select image_id, file, cast(replace(string_split(file, '_')[1], 'i', '') as int) as id,
          case when contains(file, 'wiki') then 'wiki'
            else string_split(string_split(file, '_')[2], '.')[1] end as dataset from f""",
    "strip_text":
        f"""select conv_id, turn, trim(concat(chr(160), chr(8195), ' ', text, ' ', chr(12288),
          chr(28), chr(10)), '{_CHARS}') as text from conversations""",
    "collapse_ws":
        f"""select doc_id, regexp_replace(replace(text, ' a', concat(chr(8195), chr(160), chr(30), 'a')),
          '{_W}+', ' ', 'g') as text from documents""",
    "drop_newlines":
        f"""select conv_id, turn, regexp_replace(replace(text, chr(10), ''), '{_W}+', ' ', 'g') as text
        from conversations""",
    "cut_at_marker":
        """select page_id, string_split(url, '?')[1] as address,
          string_split(string_split(string_split(url, '#')[1], '?')[1], '/')[-1] as file,
          string_split(concat(html, '<|end_of_text|>', url), '<|end_of_text|>')[1] as html from pages""",
    "remove_echo":
        """with echoed as (select *, concat('[INST] ', role, ' [/INST] ', text, ' ', role) as e
          from conversations)
        select conv_id, turn, replace(e, role, '') as no_echo,
          replace(e, concat('[INST] ', role, ' [/INST] '), '') as no_wrapped_echo from echoed""",
    "drop_prefix":
        """with n as (select *, length(text) % 20 - 7 as start from conversations)
        select conv_id, turn, case when start < 0 then right(text, -start)
          else substr(text, start + 1) end as text from n""",
    "lookup_catalogue": f"with {PICTURES} select image_id, id, city, subject from pictures",
    "build_requests":
        f"with {REQUESTS} select image_id, path, lang, question_no, question from requests",
    "dialogue_turn1": f"with {TURN_1}",
    "dialogue_turn2": f"with {TURN_2}",
    "answer_stub":
        f"with {STUB} select image_id, model, lang, answer_1, {_ANSWER_2} as answer_2 from raw_second",
    "answer_rows":
        f"""with {ANSWERS} select {_SEVEN}, answer_2,
          concat(id, '|', path, '|', dataset, '|', city, '|', subject, '|', answer_1, '|',
            coalesce(answer_2, '')) as line from answers""",
    "two_turn_pivot":
        """with spoken as (select *, row_number() over (partition by conv_id, role order by turn) as nth
          from conversations where role in ('user', 'assistant'))
        select conv_id,
          min(case when role = 'user' and nth = 1 then text end) as question_1,
          min(case when role = 'assistant' and nth = 1 then text end) as answer_1,
          min(case when role = 'user' and nth = 2 then text end) as question_2,
          min(case when role = 'assistant' and nth = 2 then text end) as answer_2
        from spoken group by conv_id""",
    "tile_candidates":
        f"""with {TILES} select g.cols, g.rows, g.area, count(image_id) as images
        from grids g left join chosen c on g.cols = c.cols and g.rows = c.rows group by all""",
    "tile_grid":
        f"""with {TILES} select image_id, width, height, cols, rows, blocks,
          {TILE_SIZE} * cols as target_w, {TILE_SIZE} * rows as target_h from chosen""",
    "tile_boxes":
        f"""with {TILES}, boxes as (
          select image_id, cast(n as int) as tile, n % cols * {TILE_SIZE} as x0,
            n // cols * {TILE_SIZE} as y0, false as is_thumbnail
          from chosen, range(0, {MAX_TILES}) r(n) where n < blocks
          union all select image_id, blocks, 0, 0, true from chosen where blocks <> 1)
        select image_id, tile, cast(x0 as int) as x0, cast(y0 as int) as y0,
          cast(x0 + {TILE_SIZE} as int) as x1, cast(y0 + {TILE_SIZE} as int) as y1, is_thumbnail
        from boxes""",
    "gallery_filter": f"with {GALLERY} select image_id, file, source, source_order from gallery",
    "gallery_labels": f"with {GALLERY} select image_id, file, source, label from labelled",
    "gallery_grid":
        f"""with {GALLERY}, placed as (select *, cast(row_number() over (
            order by source_order, file, image_id) - 1 as int) as position from labelled)
        select position, position // 5 as grid_row, position % 5 as grid_col, source, file, label
        from placed where position < 40""",
    "combined_sorted":
        f"""with {FILES} select path, model, lang, answer_1, subject_1,
          row_number() over (order by path, model, answer_1) - 1 as place from graded_file""",
    "indexed_table":
        f"""with {GRADED}, counts as (select picture, subject_1, count(*) as count from graded
          group by all)
        select picture, subject_1, count, row_number() over (order by picture, subject_1) - 1 as index
        from counts""",
    "scan_catalogue":
        f"""with {CATALOGUE} select id, subject, city, id % 3 = 0 as flore, id % 3 = 1 as wiki,
          id % 3 = 2 as other from catalogue""",
    "scan_listing":
        """select lang, cast(sum(strlen(text) + 1) as bigint) as bytes from documents group by lang""",
    "scan_bytes":
        """select lang, cast(sum(strlen(text) + 1) as bigint) as bytes,
          cast(sum(length(text) - length(replace(text, chr(10), '')) + 1) as bigint) as lines
        from documents group by lang""",
    "scan_graded":
        f"""with {FILES} select *, case score_1 when '0' then 0.0 when '1' then 1.0
          when '0,5' then 0.5 when '*0,5' then 0.5 end::double as score from graded_file""",
    "combine_graded":
        f"""with {FILES} select path, model, subject_1,
          case when lang = 'ita' then score_1 end as score_1,
          case when lang = 'ita' then note end as note from graded_file""",
    "roundtrip_combined": f"with {FILES} select * exclude (lang) from graded_file",
    "roundtrip_answers":
        f"""with {ANSWERS}, policies as (
          select * from {_POLICY_ROWS} as t(no, model, a, b, c, d, e)), given as (
          select * replace (concat(answer_1, case when image_id % 11 = 0 then '|'
              when image_id % 13 = 0 then chr(10) else '' end) as answer_1,
            case when image_id % 11 = 0 or image_id % 13 = 0 then answer_2
              else coalesce(answer_2, '') end as answer_2)
          from answers), lines as (
          select {_SEVEN}, answer_2, model, case when image_id % 2 = 0 then 'ita' else 'eng' end as lang,
            case when image_id % 11 = 0 then 'separator' when image_id % 13 = 0 then 'newline' end
              as reason
          from given join policies on no = image_id % {len(POLICIES)})
        select * from lines union all select * from lines""",
    "append_answers":
        f"""with {ANSWERS}, policies as (select * from {_POLICY_ROWS} as t(no, model, a, b, c, d, e)),
        stored as (select model, 'ita' as lang, image_id, path, answer_1, answer_2
          from answers join policies on no = image_id % {len(POLICIES)})
        select * from stored union all select * from stored""",
    "roundtrip_table":
        f"""with {LABELLED}, t as (select algorithm, dataset, {_SCORES} from graded group by all)
        select *, row_number() over (order by algorithm, dataset) - 1 as index from t""",
}
ORACLES["append_once"] = ORACLES["roundtrip_answers"]
ORACLES["answer_resumed"] = ORACLES["answer_stub"]
ORACLES["predict_shapes"] = f"""with {IMAGES}, layer as (
  select image_id, greatest(3 * width - 3 * height, 0)::double as wide,
    greatest(4 * height - 4 * width, 0)::double as tall,
    greatest(width + height - 1500, 0)::double as large from img)
select image_id, case when image_id % 17 > 0 then wide end as wide,
  case when image_id % 17 > 0 then tall end as tall,
  case when image_id % 17 > 0 then large end as large,
  case when image_id % 17 > 0 then wide + tall + large end as total from layer"""
ORACLES["scan_ranges"] = ORACLES["scan_graded"]
ORACLES["combine_unlike"] = f"""with {FILES} select * exclude (lang) replace (
    case when id % 3 <> 1 then note end as note,
    case when id % 3 <> 1 then score_1 end as score_1,
    case when id % 3 <> 2 then description_2 end as description_2) from graded_file"""
ORACLES["report_kept_up"] = ORACLES["accuracy_by_dataset"]
ORACLES["scan_tree"] = ORACLES["scan_listing"]
