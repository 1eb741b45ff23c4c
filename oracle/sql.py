"""DuckDB SQL for the registered queries, written independently of the Spark plans.

Sections are rebuilt with exploded lines and window functions, TF-IDF with
exploded terms, ranks with a plain window per session.
"""

from __future__ import annotations

import re

from hiresift.functions.contact import EMAIL, PHONE
from hiresift.functions.fixed_values import (
    AI_CATEGORIES,
    CHAT_APOLOGY,
    CHAT_SYSTEM_HEAD,
    CHAT_SYSTEM_TAIL,
    EMAIL_PROMPTS,
    INTERVIEW_PROMPT,
    QUICK_QUESTIONS,
    RELEVANCE_SYSTEM,
    RELEVANCE_USER,
    SECTION_ALIASES,
    SKILL_CATEGORIES,
    STOP_WORDS,
    WEIGHTS,
)
from hiresift.functions.sections import ALIAS_PATTERN, SECTIONS
from hiresift.functions.similarity import RARE_WEIGHT_SQUARED
from hiresift.functions.skills import ALL_SKILLS
from hiresift.functions.text import WHITESPACE, WS_CLASS
from hiresift.operators.relevance import COMBINE_HEAD
from hiresift.sources.fixtures import _REPLY, VIEW_SQL

CATEGORIES = list(WEIGHTS)
W = r"\p{L}\p{N}_"


def q(text: str) -> str:
    """SQL string literal; control characters by code."""
    out, run = [], ""
    for ch in text:
        if ord(ch) < 32:
            out += [f"'{run}'"] if run else []
            out.append(f"chr({ord(ch)})")
            run = ""
        else:
            run += "''" if ch == "'" else ch
    out += [f"'{run}'"] if run or not out else []
    return out[0] if len(out) == 1 else "(" + " || ".join(out) + ")"


def strip(e: str) -> str:
    return f"trim({e}, {q(WHITESPACE)})"


def blank(e: str) -> str:
    return f"coalesce({strip(e)}, '') = ''"


def fill(template: str, **values: str) -> str:
    """A template as a concatenation, its places taken by SQL expressions."""
    e = q(template)
    for name, value in values.items():
        e = f"replace({e}, '{{{name}}}', {value})"
    return e


def pct(e: str) -> str:
    return f"(cast({e} as varchar) || '%')"


def listed(e: str, empty: str) -> str:
    return f"case when len({e}) > 0 then array_to_string({e}, ', ') else {q(empty)} end"


def joined(e: str) -> str:
    return f"array_to_string({e}, ' | ')"


def bullets(e: str) -> str:
    return f"array_to_string(list_transform({e}, lambda x: '- ' || x), chr(10))"


def _skill_list(text: str) -> str:
    cases = []
    for s in ALL_SKILLS:
        pattern = "".join("\\" + ch if not ch.isalnum() and ch != " " else ch for ch in s)
        end = f"($|[^{W}])" if s[-1].isalnum() else f"[{W}]"
        cases.append(f"case when regexp_matches({text}, '(^|[^{W}]){pattern}{end}') then '{s}' end")
    return f"list_filter([{', '.join(cases)}], lambda x: x is not null)"


_ALIASES = ", ".join(f"({q(a)}, '{s}')" for s, al in SECTION_ALIASES.items() for a in al)
_MERGED = f"(?:(?:{ALIAS_PATTERN})[{WS_CLASS}]*){{2,}}"
_SKILLS = "[" + ", ".join(q(s) for s in ALL_SKILLS) + "]"
_STOP = ", ".join(q(w) for w in STOP_WORDS)
_TOKEN = f"[{W}]{{2,}}"


def _sections_from(lines: str) -> str:
    """Items of all sections from a table of numbered, stripped lines."""
    lists = ", ".join(
        f"coalesce(max(items) filter (section = '{s}'), []::varchar[]) as {s}" for s in SECTIONS
    )
    return f"""
    select r.candidate_id, {lists}
    from resumes r left join (
      select candidate_id, section, list(item order by item_no) as items from (
        select candidate_id, section, item_no, string_agg(txt, ' ' order by pos) as item from (
          select candidate_id, section, pos,
            case when bullet then substr(s, 3) else s end as txt,
            sum(case when bullet or rn = 1 then 1 else 0 end) over (
              partition by candidate_id, section order by pos rows unbounded preceding) as item_no
          from (
            select b.candidate_id, b.section, l.pos, l.s, (l.s like '- %' or l.s like '• %') as bullet,
              row_number() over (partition by b.candidate_id, b.section order by l.pos) as rn
            from (
              select st.candidate_id, st.section, st.start_pos, min(o.pos) as stop_pos
              from (select candidate_id, hs as section, min(pos) as start_pos from {lines} where hs is not null group by 1, 2) st
              left join {lines} o
                on o.candidate_id = st.candidate_id and o.hs <> st.section and o.pos > st.start_pos
              group by 1, 2, 3
            ) b join {lines} l on l.candidate_id = b.candidate_id
              and l.pos > b.start_pos and (b.stop_pos is null or l.pos < b.stop_pos)
              and l.hs is null and l.s <> ''
          )
        ) group by 1, 2, 3
      ) group by 1, 2
    ) i on i.candidate_id = r.candidate_id
    group by r.candidate_id"""


def _tagged(source: str) -> str:
    return f"""
    select candidate_id, pos, s, a.section as hs
    from (select candidate_id, pos, {strip('raw')} as s from {source}) x
    left join (values {_ALIASES}) a(alias, section) on a.alias = lower(x.s)"""


def _terms(source: str, key: str, text: str) -> str:
    return f"""
    select {key}, term, count(*) as tf
    from (select {key}, unnest(regexp_extract_all(lower({text}), '{_TOKEN}')) as term from {source})
    where term not in ({_STOP}) group by {key}, term"""


def _pairwise(own: str, job: str, link: str, key: str) -> str:
    """Similarity per ``key`` of own terms to the job terms of ``link``."""
    c = repr(RARE_WEIGHT_SQUARED) + "::double"
    return f"""
    select o.{key}, o.{link},
      round_even(100 * (o.dot / sqrt((o.own_shared + {c} * (o.own_all - o.own_shared))
        * (o.job_shared + {c} * (j.job_all - o.job_shared)))), 1) as similarity
    from (
      select a.{key}, a.{link}, sum(a.tf * b.tf)::double as dot, sum(a.tf * a.tf) filter (b.tf is not null)::double as own_shared,
        sum(a.tf * a.tf)::double as own_all, sum(b.tf * b.tf)::double as job_shared
      from {own} a left join {job} b on a.{link} = b.{link} and a.term = b.term group by 1, 2
    ) o join (select {link}, sum(tf * tf)::double as job_all from {job} group by 1) j on j.{link} = o.{link}
    where o.dot is not null"""


def _overall(prefix: str = "score_") -> str:
    total = " + ".join(
        f"cast({prefix}{c} as decimal(5,1)) * cast({w} as decimal(3,2))" for c, w in WEIGHTS.items()
    )
    return f"cast(round_even({total}, 1) as double)"


_EDU = "lower(array_to_string(education, ' '))"
_SCORE = {
    "skills": "case when len(required) = 0 then 0.0 else round_even(100.0::double * len(list_intersect(skills, required)) / len(required), 1) end",
    "experience": "coalesce(similarity, 0.0)",
    "education": f"""case when len(education) = 0 then 0.0
      when contains({_EDU}, 'phd') or contains({_EDU}, 'ph.d') or contains({_EDU}, 'doctorate') then 100.0
      when contains({_EDU}, 'm.s.') or contains({_EDU}, 'master') or contains({_EDU}, 'm.tech') then 85.0
      when contains({_EDU}, 'b.s.') or contains({_EDU}, 'bachelor') or contains({_EDU}, 'b.tech') then 60.0
      else 30.0 end""",
    "certifications": "least(len(certifications) * 25.0, 100.0)",
    "projects": "least(len(projects) * 33.0, 100.0)",
}


def _view(name: str) -> str:
    source, columns = VIEW_SQL[name]
    return f"select {', '.join(columns)} from {source}"


_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _reply_score(reply: str) -> str:
    bare = strip(f"replace(replace({strip(reply)}, '```json', ''), '```', '')")
    value = f"case when json_valid({bare}) and json_type({bare}) = 'OBJECT' then json_extract_string({bare}, '$.score') end"
    number = f"case when regexp_matches({strip(value)}, '{_NUMBER}') then try_cast({strip(value)} as double) end"
    return f"case when ({number}) < 0 then 0.0 when ({number}) > 100 then 100.0 else {number} end"


def _context(per_piece: int) -> str:
    return f"""
    select session_id, (rank - 1) // {per_piece} as piece_no, string_agg(
      'Rank ' || rank || ': ' || name || ' — Overall Score: ' || {pct('overall')} || chr(10)
      || {" || ".join(f"'  {c.capitalize()} Match: ' || {pct(c)} || chr(10)" for c in CATEGORIES)}
      || '  Matched Skills: ' || {listed('matched_skills', 'None')} || chr(10)
      || '  Missing Skills: ' || {listed('missing_skills', 'None')} || chr(10),
      chr(10) order by rank) as context
    from ranked group by 1, 2"""


# name -> SQL; a name may use those before it
CTES = {name: _view(name) for name in VIEW_SQL}
CTES |= {
    "replies": f"""
    select c_custkey as candidate_id, category, {_REPLY} as raw_reply
    from customer, (values (0, 'skills'), (1, 'experience'), (2, 'certifications'), (3, 'projects')) c(i, category)
    where {_REPLY} is not null""",
    "ai": f"select candidate_id, category, {_reply_score('raw_reply')} as score from replies",
    "raw_lines": """
    select candidate_id, unnest(generate_series(1, len(ls))) as pos, unnest(ls) as raw
    from (select candidate_id, string_split(raw_text, chr(10)) as ls from resumes)""",
    "split_lines": f"""
    select candidate_id, row_number() over (partition by candidate_id order by pos, sub) as pos, raw
    from (
      select candidate_id, pos, unnest(generate_series(1, len(parts))) as sub, unnest(parts) as raw
      from (
        select candidate_id, pos,
          case when regexp_full_match(lower({strip('raw')}), '{_MERGED}')
            then regexp_extract_all(lower({strip('raw')}), '(?:{ALIAS_PATTERN})') else [raw] end as parts
        from raw_lines))""",
    "plain_tagged": _tagged("raw_lines"),
    "plain_sections": _sections_from("plain_tagged"),
    "tagged": _tagged("split_lines"),
    "sections": _sections_from("tagged"),
    "contact": f"""
    select r.candidate_id, coalesce(n.name, 'Unknown') as name,
      coalesce(nullif(regexp_extract(raw_text, '{EMAIL}'), ''), 'Not found') as email,
      coalesce(nullif({strip(f"regexp_extract(raw_text, '{PHONE}')")}, ''), 'Not found') as phone
    from resumes r left join (
      select candidate_id, arg_min({strip('raw')}, pos) filter ({strip('raw')} <> '') as name from raw_lines group by 1
    ) n on n.candidate_id = r.candidate_id""",
    "own_skills": f"select candidate_id, {_skill_list('t')} as skills from (select candidate_id, lower(raw_text) as t from resumes)",
    "parsed": f"""
    select r.candidate_id, r.session_id, r.filename, c.name, c.email, c.phone, k.skills,
      s.experience, s.education, s.certifications, s.projects,
      case when {blank('r.raw_text')} then '' else r.raw_text end as raw_text
    from resumes r join contact c using (candidate_id) join own_skills k using (candidate_id)
      join sections s using (candidate_id)""",
    "jobs": f"""
    select id as session_id, job_title, job_description, created_at,
      list_filter({_SKILLS}, lambda s: contains(lower(job_description), s)) as required from sessions""",
    "own_terms": _terms("resumes", "candidate_id, session_id", "raw_text"),
    "job_terms": _terms("jobs", "session_id", "job_description"),
    "jd_match": _pairwise("own_terms", "job_terms", "session_id", "candidate_id"),
    "sub": f"""
    select p.*, j.required, j.job_description, {', '.join(f'{e} as score_{c}' for c, e in _SCORE.items())}
    from parsed p join jobs j using (session_id) left join jd_match s on s.candidate_id = p.candidate_id""",
    "scored": f"""
    select candidate_id, session_id, name, email, {_overall()} as overall,
      {', '.join(f'score_{c}::double as {c}' for c in CATEGORIES)},
      list_sort(list_intersect(skills, required)) as matched_skills,
      list_sort(list_filter(required, lambda x: not list_contains(skills, x))) as missing_skills,
      education as education_details, experience as experience_details,
      certifications as certifications_details, projects as projects_details, skills as all_skills
    from sub""",
    "ranked": "select *, row_number() over (partition by session_id order by overall desc, candidate_id) as rank from scored",
    "ranked_status": "select r.*, c.status from ranked r join candidates c on c.id = r.candidate_id",
    "stored_ranked": "select *, row_number() over (partition by session_id order by overall_score desc, id) as rank from candidates",
    "prompt_rows": f"""
    select s.candidate_id, c.category,
      {fill(RELEVANCE_SYSTEM, item_type='c.item_type')} as system_prompt,
      {fill(RELEVANCE_USER, item_type='c.item_type', items=bullets('c.items'), job_description='s.job_description')} as user_prompt
    from sub s, lateral (
      {' union all '.join(f"select '{c}' as category, '{t}' as item_type, s.{c} as items" for c, t in AI_CATEGORIES.items())}
    ) c
    where len(c.items) > 0 and (c.category <> 'skills' or length(s.job_description) > 0)""",
    "context": _context(200),
    "system_prompts": f"""
    select session_id, piece_no, {q(CHAT_SYSTEM_HEAD)} || context || {q(CHAT_SYSTEM_TAIL)} as system_prompt from context""",
    "messages": f"""
    with asked as (select conv_id, max(turn) as q, from chat where role = 'user' group by 1),
         conv as (select conv_id, min(session_id) as session_id from chat group by 1)
    select a.conv_id, 0 as part, coalesce(p.piece_no, 0)::bigint as piece_no, -1::bigint as turn, 'system' as role,
      coalesce(p.system_prompt, {q(CHAT_SYSTEM_HEAD + CHAT_SYSTEM_TAIL)}) as content
    from asked a join conv using (conv_id) left join system_prompts p using (session_id)
    union all
    select conv_id, case when turn = q then 2 else 1 end, null, turn, role, text
    from chat join asked using (conv_id) where role <> 'system' and turn <= q""",
    "mails": f"""
    select session_id, id as candidate_id, status,
      case status {' '.join(f"when '{s}' then {fill(t, name='name')}" for s, t in EMAIL_PROMPTS.items() if s)}
        else {fill(EMAIL_PROMPTS[None], name='name')} end as prompt
    from candidates""",
    "interviews": f"""select session_id, candidate_id,
      {fill(INTERVIEW_PROMPT, name='name', matched=listed('matched_skills', 'none'), missing=listed('missing_skills', 'none'))} as prompt from scored""",
    "checked": f"""
    select r.*, coalesce(n, 0) as n_resumes,
      case when coalesce(n, 0) = 0 then 'no resume'
        when {blank('jd_text')} and jd_doc is null then 'no job description'
        when {blank('job_title')} then 'no job title' end as reject_reason
    from requests r left join (select session_id, count(*) as n from resumes group by 1) c on c.session_id = r.id""",
    "closed": "select s_suppkey as id from supplier where s_acctbal < 0",
    "pair": """
    select a.session_id, a as a, b as b from
      (select session_id, x as a from (select session_id, rank, ranked as x from ranked) where rank = 1) a
      join (select session_id, arg_max(x, rank) as b from (select session_id, rank, ranked as x from ranked where rank <= 2) group by 1) b
      using (session_id)""",
    "report": f"""
    select s.id as session_id, 'hiring_report_' || replace(job_title, ' ', '_') as file_name, 0::bigint as rank, n as line_no,
      case n when 1 then 'Candidate Ranking Report' when 2 then 'Job: ' || job_title
        else 'Generated: ' || substr(created_at, 1, 10) end as line
    from sessions s, (values (1), (2), (3)) v(n) where id in (select session_id from ranked)
    union all
    select r.session_id, 'hiring_report_' || replace(job_title, ' ', '_'), rank, n,
      case n when 1 then replace(translate(rank || '. ' || name || ' - ' || {pct('overall')} || ' (' || status || ')',
          '—–‘’“”', {q('--' + "''" + '""')}), '…', '...')
        when 2 then {" || '  ' || ".join(f"'{h}: ' || {pct(c)}" for h, c in zip(['Skills', 'Experience', 'Education', 'Certs', 'Projects'], CATEGORIES))}
        when 3 then 'Matched skills: ' || {listed('matched_skills', 'None')}
        else 'Missing skills: ' || {listed('missing_skills', 'None')} end
    from ranked_status r join sessions s on s.id = r.session_id, (values (1), (2), (3), (4)) v(n)""",
}
_REUSED = {
    "resumes", "raw_lines", "tagged", "plain_tagged", "own_skills", "sections", "own_terms", "job_terms",
    "jd_match", "parsed", "sub", "scored", "ranked", "ranked_status", "messages", "replies", "context",
}


def _needs(text: str, seen: set[str]) -> set[str]:
    for name in CTES:
        if name not in seen and re.search(rf"\b(from|join)\s+{name}\b", text):
            seen.add(name)
            _needs(CTES[name], seen)
    return seen


def _statement(select: str) -> str:
    needed = _needs(select, set())
    ctes = [
        f"{name} as {'materialized ' if name in _REUSED else ''}({CTES[name]})" for name in CTES if name in needed
    ]
    return (f"with {', '.join(ctes)} " if ctes else "") + f"select * from ({select})"


_CORPUS = """
select r.candidate_id, r.session_id,
  coalesce(case when dot > 0 then round_even(100 * (dot / sqrt(norm2 * job_norm2)), 1) end, 0.0) as similarity
from resumes r left join (
  with docs as (select session_id, count(*) + 1 as n from resumes group by 1),
  df as (
    select session_id, term, count(*) as df, sum(job_tf) as job_tf from (
      select session_id, term, 0 as job_tf from own_terms union all select session_id, term, tf from job_terms)
    group by 1, 2),
  vocab as (select session_id, term, job_tf, power(ln((1 + n) / (1 + df)) + 1, 2) as w2 from df join docs using (session_id)),
  norms as (select session_id, sum(job_tf * job_tf * w2) as job_norm2 from vocab group by 1)
  select o.candidate_id, sum(tf * job_tf * w2) as dot, sum(tf * tf * w2) as norm2, any_value(job_norm2) as job_norm2
  from own_terms o join vocab v on v.session_id = o.session_id and v.term = o.term
    join norms m on m.session_id = o.session_id group by 1
) s on s.candidate_id = r.candidate_id"""


def _columns_joined(table: str, lists: list[str], others: list[str]) -> str:
    return f"select {', '.join(others + [f'{joined(c)} as {c}' for c in lists])} from {table}"


_DETAILS = ["education_details", "experience_details", "certifications_details", "projects_details"]
_SCORED_LISTS = ["matched_skills", "missing_skills", *_DETAILS, "all_skills"]
_ALL_SCORES = ["overall", *CATEGORIES]
_AI_PIVOT = "select candidate_id, " + ", ".join(
    f"round_even(max(score) filter (category = '{c}'), 1) as ai_{c}" for c in AI_CATEGORIES
) + " from ai group by 1"


def _ai(category: str, condition: str) -> str:
    return f"coalesce(case when {condition} then ai_{category} end, score_{category})::double as score_{category}"


_CATEGORY_CASE = "case " + " ".join(
    f"when skill in ({', '.join(q(s) for s in members)}) then {q(c)}" for c, members in SKILL_CATEGORIES.items()
) + " end"

_LAYOUT_TEXT = f"""
with laid as (
  select candidate_id, s, row_number() over (partition by candidate_id order by pos) as n
  from (select candidate_id, pos, {strip('raw')} as s from raw_lines) where s <> '')
select r.candidate_id as doc_id, coalesce(string_agg(s, chr(10) order by
  case when n = 1 then 0 when n % 2 = 0 then 1 else 2 end, n), '') as text
from resumes r left join laid l using (candidate_id) group by 1"""

_SCORED_PROMPTS = """select candidate_id, category, least((length(user_prompt) % 130)::double, 100.0) as score
      from prompt_rows where length(user_prompt) % 5 <> 0"""
_NEW_IDS = """select id, (select max(id) from sessions) + row_number() over (order by id) as session_id
      from checked where reject_reason is null"""


def _told(first: str, last: str, n: str = "2") -> str:
    """What the stand-in model says to n messages with these first and last ones."""
    return f"""({n}) || ' messages, first of ' || length({first}) || ' characters, last: ' || {last}"""


def _combined(parts: str, *keys: str) -> str:
    """One answer a key from parts (keys, part_no, question, answer): 20 at a time, in three rounds, which 8,000 pieces take at most."""
    for _ in range(3):
        parts = f"""select {', '.join(keys)}, part_no, question, case when n = 1 then answer else {_told('text', 'text', '1')} end as answer
          from (select {', '.join(keys)}, part_no // 20 as part_no, any_value(question) as question, count(*) as n, any_value(answer) as answer,
            {q(COMBINE_HEAD)} || any_value(question) || chr(10) || chr(10) || string_agg(answer, chr(10) || chr(10) order by part_no) as text
            from ({parts}) group by {', '.join(keys)}, part_no // 20)"""
    return f"select {', '.join(keys)}, answer from ({parts})"


def _answered(asked: str) -> str:
    """One answer a candidate, combined from those to its prompt with every piece."""
    told = _told("coalesce(t.system_prompt, " + q(CHAT_SYSTEM_HEAD + CHAT_SYSTEM_TAIL) + ")", "a.prompt")
    parts = f"""select a.session_id, a.candidate_id, a.rn, coalesce(t.piece_no, 0) as part_no, a.prompt as question, {told} as answer
      from (select *, row_number() over () as rn from {asked}) a left join system_prompts t using (session_id)"""
    return f"select session_id, candidate_id, answer from ({_combined(parts, 'session_id', 'candidate_id', 'rn')})"


# Documents 1, 2 and 4 of seven can't be read by layout; a tenth has no plain text.
_FALLBACK = f"""case when candidate_id % 7 not in (1, 2, 4) and not ({blank('text')}) then text
  when candidate_id % 10 = 0 then '' else raw_text end"""


def _over_documents(statement: str) -> str:
    """A statement over the texts that pages give, instead of the given ones."""
    given = f"resumes as {'materialized ' if 'resumes' in _REUSED else ''}({CTES['resumes']})"
    assert given in statement
    lines = _LAYOUT_TEXT.replace("raw_lines", "given_lines").replace("resumes", "given_resumes")
    return statement.replace(
        given,
        f"""given_resumes as ({CTES['resumes']}),
        given_lines as ({CTES['raw_lines'].replace('from resumes', 'from given_resumes')}),
        resumes as (select candidate_id, session_id, filename, {_FALLBACK} as raw_text
          from given_resumes join ({lines}) on doc_id = candidate_id)""",
    )


_SELECTS = {
    "scan_resumes": "select * from resumes",
    "ingest_rejects": f"select candidate_id, filename, 'no text could be extracted' as reject_reason from resumes where {blank('raw_text')}",
    "parsed_empty": f"""select candidate_id, session_id, filename, 'Unknown' as name, 'Not found' as email, 'Not found' as phone,
      '' as skills, '' as experience, '' as education, '' as certifications, '' as projects, '' as raw_text
      from resumes where {blank('raw_text')}""",
    "final_jd": "select id, case when jd_doc is not null then jd_doc else jd_text end as job_description from requests",
    "session_validation": "select id, n_resumes, reject_reason from checked",
    "schema_evolve": """select id, job_title, job_description, created_at, null::varchar as browser_id from sessions
      union all select id, job_title, jd_text, created_at, browser_id from requests""",
    "append_sessions": """select id, job_title, job_description, created_at, browser_id from sessions
      union all select (select max(id) from sessions) + row_number() over (order by id), job_title,
        coalesce(jd_doc, jd_text), created_at, browser_id from checked where reject_reason is null""",
    "append_notes": f"""with old as (select conv_id * 100 + turn as id, conv_id as candidate_id, text as note_text,
        '2023-12-31T08:00:00.000000' as created_at from conversations)
      select * from old union all
      select (select max(id) from old) + row_number() over (order by id), candidate_id, {strip('note_text')}, created_at
      from notes where not ({blank('note_text')})""",
    "persist_candidates": f"""select candidate_id as id, session_id, name, email, overall as overall_score,
      to_json(struct_pack(name := name, email := email, {', '.join(f'{c} := {c}' for c in _ALL_SCORES + _SCORED_LISTS)}))::varchar as data_json,
      'New' as status from scored""",
    "candidate_json_roundtrip": _columns_joined(
        "scored", _SCORED_LISTS, ["candidate_id", "session_id", "'New' as status", "name", "email", *_ALL_SCORES]
    ),
    "apply_status_updates": """select id, session_id, coalesce(new_status, status) as status,
        coalesce(new_status <> status, false) as changed
      from candidates left join (
        select id, arg_max(new_status, seq) as new_status from status_updates where new_status <> 'Hired' group by 1
      ) u using (id)""",
    "delete_cascade_sessions": "select * from sessions where id not in (select id from closed)",
    "delete_cascade_candidates": "select * from candidates where session_id not in (select id from closed)",
    "delete_cascade_notes": """select * from notes where candidate_id not in (
      select id from candidates where session_id in (select id from closed))""",
    "session_by_id": """select request_id, wanted_session_id, job_title, job_description, created_at, browser_id
      from lookups left join sessions on id = wanted_session_id""",
    "visible_sessions": "select * from sessions where browser_id = 'b2' or browser_id is null",
    "session_candidates": "select * from candidates",
    "candidates_of_session": "select * from candidates where session_id = 0",
    "notes_of_candidate": "select *, substr(created_at, 1, 16) || ' — ' || note_text as line from notes where candidate_id = 1",
    "process_sessions": f"select id, reject_reason, session_id from checked left join ({_NEW_IDS}) using (id)",
    "process_candidates": f"""select candidate_id as id, n.session_id, name, email, overall as overall_score, 'New' as status
      from scored s join ({_NEW_IDS}) n on s.session_id = n.id""",
    "compare_chosen": " union all ".join(
        f"""select session_id, a.name as a_name, b.name as b_name, '{c.capitalize()}' as category, a.{c} as a_value, b.{c} as b_value,
        case when a.{c} > b.{c} then '←' when b.{c} > a.{c} then '→' else '−' end as arrow from (
          select session_id, arg_min(scored, candidate_id) as a, arg_max(scored, candidate_id) as b from scored group by 1)"""
        for c in _ALL_SCORES
    ),
    "rank_candidates_ai": f"""select session_id, row_number() over (partition by session_id order by overall desc, candidate_id) as rank,
      candidate_id, name, email, {', '.join(_ALL_SCORES)} from (
        select candidate_id, session_id, name, email, {_overall()} as overall, {', '.join(f'score_{c} as {c}' for c in CATEGORIES)}
        from (select candidate_id, session_id, name, email, {_ai('skills', "length(job_description) > 0 and len(skills) > 0")},
          {_ai('experience', 'len(experience) > 0')}, score_education::double as score_education,
          {_ai('certifications', 'len(certifications) > 0')}, {_ai('projects', 'len(projects) > 0')}
          from sub left join ({_AI_PIVOT.replace('from ai', f'from ({_SCORED_PROMPTS})')}) a using (candidate_id)))""",
    "candidate_notes": "select *, substr(created_at, 1, 16) || ' — ' || note_text as line from notes",
    "session_options": """select label, id from (
      select job_title || ' — ' || substr(created_at, 1, 10) as label, id,
        row_number() over (partition by job_title || ' — ' || substr(created_at, 1, 10) order by created_at, id) as rn
      from sessions) where rn = 1""",
    "dashboard": """select s.id as session_id, job_title, substr(created_at, 1, 10) as created,
        count(c.id) as candidates, count(*) filter (status = 'Shortlisted') as shortlisted,
        count(*) filter (status = 'Interview') as interview, count(*) filter (status = 'Rejected') as rejected,
        coalesce(cast(max(overall_score) as varchar), '0') || '%' as top_score
      from sessions s left join candidates c on c.session_id = s.id group by all""",
    "processed_count": """select s.id as session_id, count(*) as processed,
      'Processed ' || count(*) || ' candidate(s) and saved session ''' || job_title || '''!' as message
      from sessions s join candidates c on c.session_id = s.id group by s.id, job_title""",
    "candidates_with_notes": """select c.id as candidate_id, session_id, name, n.id as note_id,
      substr(created_at, 1, 16) || ' — ' || note_text as line from candidates c left join notes n on n.candidate_id = c.id""",
    "status_by_name": """select id, session_id, name, status,
      last_value(status) over (partition by session_id, name order by overall_score desc, id
        rows between unbounded preceding and unbounded following) as name_status from candidates""",
    "first_by_name": """select session_id, name, id, overall_score from (
      select *, row_number() over (partition by session_id, name order by overall_score desc, id) as rn from candidates) where rn = 1""",
    "contact_info": "select candidate_id, name, email, phone from contact",
    "contact_info_documents": f"""select doc_id,
        coalesce(list_filter(list_transform(string_split(text, chr(10)), lambda x: {strip('x')}), lambda x: x <> '')[1], 'Unknown') as name,
        coalesce(nullif(regexp_extract(text, '{EMAIL}'), ''), 'Not found') as email,
        coalesce(nullif({strip(f"regexp_extract(text, '{PHONE}')")}, ''), 'Not found') as phone
      from documents""",
    "extract_skills": "select candidate_id, array_to_string(skills, ', ') as skills from own_skills",
    "required_skills": "select session_id, array_to_string(required, ', ') as required_skills from jobs",
    "lexicon_skills": "select candidate_id, array_to_string(skills, ', ') as skills from own_skills where len(skills) > 0",
    "lexicon_required": "select session_id, array_to_string(required, ', ') as required_skills from jobs where len(required) > 0",
    "lexicon_documents": f"""with pairs as (
        select distinct a || ' ' || b as term from (
          select unnest(list_zip(w[:-2], w[2:])) as p, p[1] as a, p[2] as b
          from (select regexp_extract_all(lower(text), '[{W}]+') as w from benchmark))
        where a is not null and b is not null),
      pieces as (
        select doc_id, unnest(p) as x, unnest(range(1, len(p) + 1)) as i
        from (select doc_id, regexp_extract_all(lower(text), '[{W}]+|[^{W}]') as p from documents)),
      runs as (
        select doc_id, x || lead(x) over w || lead(x, 2) over w as term, lead(x) over w as middle from pieces window w as (partition by doc_id order by i))
      select distinct doc_id, term from runs join pairs using (term) where middle = ' '""",
    "skills_by_category": f"select {_CATEGORY_CASE} as category, skill, count(*) as candidates from (select unnest(skills) as skill from own_skills) group by all",
    "section_items": _columns_joined("plain_sections", SECTIONS, ["candidate_id"]),
    "split_headers": "select candidate_id, string_agg(raw, chr(10) order by pos) as text from split_lines group by 1",
    "sections_all": _columns_joined("sections", SECTIONS, ["candidate_id"]),
    "parse_resumes": _columns_joined(
        "parsed", ["skills", *SECTIONS], ["candidate_id", "session_id", "filename", "name", "email", "phone", "raw_text"]
    ),
    "sanitize_text": f"""select candidate_id, replace(translate(raw_text, '—–‘’“”', {q('--' + "''" + '""')}), '…', '...') as text from resumes""",
    "parse_ai_reply": "select candidate_id, category, score from ai",
    "reading_order": _LAYOUT_TEXT,
    "reading_order_words": _LAYOUT_TEXT,
    "text_fallback": f"""select candidate_id, {_FALLBACK} as text
      from resumes join ({_LAYOUT_TEXT}) on doc_id = candidate_id""",
    "tfidf_pairwise": "select r.candidate_id, r.session_id, coalesce(similarity, 0.0) as similarity from resumes r left join jd_match s using (candidate_id)",
    "tfidf_pairwise_documents": f"""with d_terms as ({_terms('(select doc_id, doc_id % (select count(*) from benchmark) as item_id, text from documents)', 'doc_id, item_id', 'text')}),
      b_terms as ({_terms('benchmark', 'item_id', 'text')}),
      sims as ({_pairwise('d_terms', 'b_terms', 'item_id', 'doc_id')})
      select d.doc_id, d.doc_id % (select count(*) from benchmark) as item_id, coalesce(similarity, 0.0) as similarity from documents d left join sims using (doc_id)""",
    "tfidf_corpus": _CORPUS,
    "overall_score": f"select candidate_id, session_id, {', '.join(_ALL_SCORES)} from scored",
    "matched_skills": "select candidate_id, array_to_string(matched_skills, ', ') as matched_skills from scored",
    "missing_skills": "select candidate_id, array_to_string(missing_skills, ', ') as missing_skills from scored",
    "ai_score_fallback": f"""select candidate_id, {_ai('skills', "length(job_description) > 0 and len(skills) > 0")},
      {_ai('experience', 'len(experience) > 0')}, score_education::double as score_education,
      {_ai('certifications', 'len(certifications) > 0')}, {_ai('projects', 'len(projects) > 0')}
      from sub left join ({_AI_PIVOT}) a using (candidate_id)""",
    "relevance_prompts": "select candidate_id, category, system_prompt, user_prompt from prompt_rows",
    "relevance_with_scorer": _SCORED_PROMPTS,
    "rank_candidates": f"select session_id, rank, candidate_id, name, email, {', '.join(_ALL_SCORES)} from ranked",
    "rank_min_score": "select session_id, rank, id, overall_score from stored_ranked where overall_score >= 60",
    "score_band": "select id, overall_score, case when overall_score >= 80 then 'high' when overall_score >= 60 then 'mid' else 'low' end as band from candidates",
    "top_k_per_session": "select session_id, rank, id, name, overall_score from stored_ranked where rank <= 3",
    "rankings_table": f"""select session_id, candidate_id, rank, name as candidate,
      {', '.join(f"printf('%.1f%%', {c}) as {c}" for c in _ALL_SCORES)}, status from ranked_status""",
    "column_widths": " union all ".join(
        f"select session_id, '{h}' as column_name, greatest(max(length(cast({c} as varchar))), {len(h)}) + 2 as width from ranked_status group by 1"
        for h, c in {"Rank": "rank", "Candidate": "name", **{c.capitalize(): c for c in _ALL_SCORES}, "Status": "status"}.items()
    ),
    "score_unpivot": " union all ".join(
        f"select session_id, candidate_id, name, '{c}' as category, {c} as score from scored" for c in CATEGORIES
    ),
    "profile_cards": f"""select session_id, candidate_id, name || ' - Score: ' || {pct('overall')} || ' | Status: ' || status as heading,
      email, {listed('all_skills', 'None listed')} as skills, {', '.join(f"{bullets(c)} as {c.removesuffix('_details')}" for c in _DETAILS)}
      from ranked_status""",
    "compare_scores": " union all ".join(
        f"""select session_id, a.name as a_name, b.name as b_name, '{c.capitalize()}' as category, a.{c} as a_value, b.{c} as b_value,
        case when a.{c} > b.{c} then '←' when b.{c} > a.{c} then '→' else '−' end as arrow from pair"""
        for c in _ALL_SCORES
    ),
    "compare_skills": "select session_id, a.name as a_name, b.name as b_name, "
    + ", ".join(
        f"coalesce(nullif(array_to_string(list_sort({e}), ', '), ''), 'None') as {n}"
        for n, e in {
            "only_a": "list_filter(a.all_skills, lambda x: not list_contains(b.all_skills, x))",
            "both": "list_intersect(a.all_skills, b.all_skills)",
            "only_b": "list_filter(b.all_skills, lambda x: not list_contains(a.all_skills, x))",
        }.items()
    )
    + " from pair",
    "report_lines": "select * from report",
    "candidate_context": "select session_id, piece_no, context from context",
    "interview_prompts": "select * from interviews",
    "email_prompts": "select * from mails",
    "quick_questions": "select id as session_id, label, prompt from sessions, (values "
    + ", ".join(f"({q(k)}, {q(v)})" for k, v in QUICK_QUESTIONS.items())
    + ") v(label, prompt)",
    "chat_messages": "select * from messages",
    "chat_answers": _combined(
        f"""select conv_id, piece_no as part_no, question, case when (n + 2) % 4 = 0 then {q(CHAT_APOLOGY)} || 'busy'
          else {_told('content', 'question', 'n + 2')} end as answer
        from messages join (
          select conv_id, count(*) filter (where part = 1) as n, max(content) filter (where part = 2) as question
          from messages group by 1) using (conv_id)
        where part = 0""", "conv_id",
    ),
    "email_answers": _answered("mails"),
    "interview_answers": _answered("interviews"),
    "stored_replies": _SCORED_PROMPTS,
}
# Requests come in two batches, even ids first; ids of sessions begin at 1.
_STORED_IDS = """select id, row_number() over (order by id % 2, id) as session_id from checked where reject_reason is null"""
_SELECTS |= {
    "stored_sessions": f"""select n.session_id as id, job_title, coalesce(jd_doc, jd_text) as job_description, created_at, browser_id
      from checked join ({_STORED_IDS}) n using (id)""",
    "stored_candidates": f"""select candidate_id as id, n.session_id, name, email, overall as overall_score, 'New' as status
      from scored s join ({_STORED_IDS}) n on s.session_id = n.id""",
    "stored_notes": f"""select row_number() over (order by id % 2, id) as id, candidate_id, {strip('note_text')} as note_text, created_at
      from notes where not ({blank('note_text')})""",
    "stored_status_updates": """select id, session_id, name, email, overall_score, coalesce(new_status, status) as status
      from candidates left join (
        select id, arg_max(new_status, (seq % 2) * 1000000000000 + seq) as new_status from status_updates
        where new_status <> 'Hired' group by 1) u using (id)""",
    "stored_delete_sessions": _SELECTS["delete_cascade_sessions"],
    "stored_delete_candidates": _SELECTS["delete_cascade_candidates"],
    "stored_delete_notes": _SELECTS["delete_cascade_notes"],
    "stored_session_by_id": "select * from sessions where id = 7",
    "stored_candidates_of_session": "select * from candidates where session_id = 0",
    "stored_notes_of_candidate": "select * from notes where candidate_id = 1",
    "stored_schema_evolve": _SELECTS["schema_evolve"],
    "candidate_json_variant": """select candidate_id as id, session_id, name as record_name, overall, all_skills[1] as first_skill,
      'T' || (candidate_id % 5) as team, (candidate_id % 3)::int as level, null::varchar as absent from scored""",
    "scan_files": f"""select id, case when id % 7 <> 1 then jd_text || chr(10) end as raw_text,
      case when id % 7 = 1 then 'the file is not UTF-8 text' when {blank('jd_text')} then 'no text could be extracted' end as reject_reason
      from requests""",
    "tfidf_corpus_stored": _CORPUS,
}
_SELECTS |= {
    f"score_{c}": f"select candidate_id, session_id, score_{c}::double as score_{c} from sub" for c in CATEGORIES
}


def statements() -> dict[str, str]:
    found = {name: _statement(select) for name, select in _SELECTS.items()}
    return found | {"parse_documents": _over_documents(found["parse_resumes"])}
