"""The English stemmer written a second time, as SQL over a vocabulary.

It checks the steps of the algorithm; the tables of endings and exceptions are
the library's own, so a wrong entry there would pass both.  Those are checked
against written-out stems in the tests.
"""

from pactframe.functions.stemmer import IRREGULAR, SETTLED, STEP_2, STEP_3, STEP_4
from pactframe.functions.text import STOP_WORDS

STOPPED = "(" + ", ".join(f"'{w}'" for w in STOP_WORDS) + ")"
SHORT_END = "(?:^|[^aeiouy])[aeiouy][^aeiouywxY]$|^[aeiouy][^aeiouy]$"


def _one_of(words) -> str:
    return "(" + "|".join(sorted(words)) + ")"


def _replacements(table: dict[str, str]) -> str:
    return "case s " + " ".join(f"when '{k}' then '{v}'" for k, v in table.items()) + " end"


def stems_cte(vocabulary: str) -> str:
    """CTEs ending in stems(token, term), for a query giving distinct column token."""
    listed = ", ".join(f"('{a}', '{b}')" for a, b in IRREGULAR.items())
    settled = ", ".join(f"'{w}'" for w in sorted(SETTLED))
    return f"""vocabulary as ({vocabulary}),
  marked as (select token, regexp_replace(regexp_replace(token, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g') as w from vocabulary
    where length(token) > 2 and token not in (select a from (values {listed}) i(a, b))),
  first_region as (select *, case when regexp_matches(w, '^(gener|commun|arsen)') then length(regexp_extract(w, '^(gener|commun|arsen)'))
      when regexp_matches(w, '[aeiouy][^aeiouy]') then length(regexp_extract(w, '^.*?[aeiouy][^aeiouy]')) else length(w) end as r1 from marked),
  regions as (select *, case when regexp_matches(substr(w, r1 + 1), '[aeiouy][^aeiouy]')
      then r1 + length(regexp_extract(substr(w, r1 + 1), '^.*?[aeiouy][^aeiouy]')) else length(w) end as r2 from first_region),
  plural as (select token, r1, r2, case when w like '%sses' then w[:-3]
      when regexp_matches(w, '^..+(ied|ies)$') then w[:-3] when regexp_matches(w, '(ied|ies)$') then w[:-2]
      when regexp_matches(w, '(us|ss)$') then w
      when regexp_matches(w, '[aeiouy].+s$') then w[:-2] else w end as w from regions),
  past_suffix as (select *, regexp_extract(w, '(eedly|eed|edly|ed|ingly|ing)$') as s, w in ({settled}) as settled from plural),
  past_base as (select *, left(w, length(w) - length(s)) as b from past_suffix),
  past as (select token, r1, r2, settled, case when settled or s = '' then w
      when s in ('eed', 'eedly') then case when length(b) >= r1 then b || 'ee' else w end
      when not regexp_matches(b, '[aeiouy]') then w
      when regexp_matches(b, '(at|bl|iz)$') then b || 'e'
      when regexp_matches(b, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') then left(b, length(b) - 1)
      when regexp_matches(b, '{SHORT_END}') and r1 >= length(b) then b || 'e' else b end as w from past_base),
  last_y as (select token, r1, r2, settled, case when settled then w when regexp_matches(w, '^.+[^aeiouy][yY]$') then left(w, length(w) - 1) || 'i' else w end as w from past),
  suffix_2 as (select *, regexp_extract(w, '{_one_of(STEP_2)}$') as s, left(w, length(w) - length(regexp_extract(w, '{_one_of(STEP_2)}$'))) as b from last_y),
  step_2 as (select token, r1, r2, settled, case when settled or s = '' or length(b) < r1 then w
      when s = 'ogi' and right(b, 1) <> 'l' then w
      when s = 'li' and not regexp_matches(b, '[cdeghkmnrt]$') then w
      else b || {_replacements(STEP_2)} end as w from suffix_2),
  suffix_3 as (select *, regexp_extract(w, '{_one_of(STEP_3)}$') as s, left(w, length(w) - length(regexp_extract(w, '{_one_of(STEP_3)}$'))) as b from step_2),
  step_3 as (select token, r1, r2, settled, case when settled or s = '' or length(b) < r1 or (s = 'ative' and length(b) < r2) then w
      else b || {_replacements(STEP_3)} end as w from suffix_3),
  suffix_4 as (select *, regexp_extract(w, '{_one_of(STEP_4)}$') as s, left(w, length(w) - length(regexp_extract(w, '{_one_of(STEP_4)}$'))) as b from step_3),
  step_4 as (select token, r1, r2, settled, case when settled or s = '' or length(b) < r2 then w
      when s = 'ion' and not regexp_matches(b, '[st]$') then w else b end as w from suffix_4),
  step_5 as (select token, case when settled then w
      when w like '%e' and (length(w) - 1 >= r2 or (length(w) - 1 >= r1 and not regexp_matches(left(w, length(w) - 1), '{SHORT_END}'))) then left(w, length(w) - 1)
      when w like '%ll' and length(w) - 1 >= r2 then left(w, length(w) - 1) else w end as w from step_4),
  stems as (select token, lower(w) as term from step_5
    union all select token, token from vocabulary where length(token) <= 2
    union all select i.a, i.b from (values {listed}) i(a, b) join vocabulary v on v.token = i.a)"""


def postings_cte(rows: str, more_words: str = "select null as token where false") -> str:
    """CTEs ending in postings(id, field, term, pos), for a query giving id, name, content.

    The stems cover the tokens of ``more_words`` too.
    """
    return f"""fields as (select id, 'A' as field, coalesce(name, '') as content from ({rows}) f
    union all select id, 'B', coalesce(content, '') from ({rows}) f),
  words as (select id, field, regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}]+') as ws from fields),
  placed as (select id, field, unnest(ws) as token, unnest(range(1, len(ws) + 1)) as pos from words),
  {stems_cte(f"select token from (select token from placed union {more_words}) x where token not in {STOPPED}")},
  postings as (select p.id, p.field, s.term, p.pos from placed p join stems s using (token))"""
