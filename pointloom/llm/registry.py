"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from importlib import import_module

_QUERIES = {
    "op1_brown": "brown",
    "op2_decontaminate": "decontaminate",
    "op3_personal_data": "pii",
    "op4_near_duplicates": "neardup",
    "op5_language": "language",
    "op6_media": "media",
    "op7_main_text": "html",
    "op8_line_dedup": "lines",
    "op9_token_counts": "tokens",
    "op10_pack": "packing",
}


def queries() -> dict:
    return {name: getattr(import_module(f"pointloom.llm.{module}"), name) for name, module in _QUERIES.items()}


_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_ORACLE = {
    "op2_decontaminate": f"""with d as (select doc_id, coalesce({_WORDS.format("text")}, []) as w from documents),
      i as (select item_id, w, least(10, len(w)) as n from (select item_id, {_WORDS.format("text")} as w from benchmark) where len(w) > 0),
      wins as (select distinct item_id, n, w[s : s + n - 1] as win from (select *, unnest(range(1, len(w) - n + 2)) as s from i)),
      dw as (select doc_id, n, s, w[s : s + n - 1] as win from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as s from d, (select distinct n from i))),
      h as (select dw.doc_id, dw.s, dw.n, wins.item_id from dw join wins on dw.n = wins.n and dw.win = wins.win),
      hits as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + n)) as p from h) group by 1),
      items as (select doc_id, count(*) as n_items, sha256(string_agg(x, ',' order by x)) as digest from (select distinct doc_id, item_id::varchar as x from h) group by 1)
      select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, coalesce(digest, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
      from d left join hits using (doc_id) left join items using (doc_id)""",
}


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)
