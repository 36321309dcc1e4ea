"""SQL that checks the text operators: texts are read sign by sign by a fixed table of shapes, written out as values, with
neither the automaton nor the index; phrases and windows are all compared."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from spotloom.llm.canonical import fold_signs, read_signs


def _table(name: str, read: Callable[[str], str]) -> str:
    """(code, reading) of every composed character that does not read as itself."""
    rows = []
    for o in (*range(1, 0xD800), *range(0xE000, 0x20000), *range(0xE0000, 0xE1000)):
        c = chr(o)
        if unicodedata.normalize("NFC", c) == c and (r := read(c)) != c:
            rows.append(f"({o}, '" + r.replace("'", "''") + "')")
    return f"{name}(code, r) as (values {', '.join(rows)})"


def _readings(name: str, table: str, source: str, key: str) -> str:
    """(key, reading) of the texts of a table, composed before and after."""
    return f"""{name}_c as (select {key} as k, unnest(string_split(t, '')) as c, unnest(range(len(string_split(t, '')))) as i from (select {key}, nfc_normalize(text) as t from {source} where text is not null)),
{name} as (select {name}_c.k, nfc_normalize(string_agg(coalesce({table}.r, c), '' order by i)) as r from {name}_c left join {table} on {table}.code = unicode(c) group by {name}_c.k)"""


def _words(name: str, reading: str) -> str:
    return f"{name} as (select k, regexp_extract_all(r, '[\\p{{L}}\\p{{N}}][\\p{{L}}\\p{{N}}\\p{{M}}]*') as w from {reading})"


def oracle() -> dict[str, str]:
    read = f"with {_table('shape', read_signs)}, {_readings('form', 'shape', 'documents', 'doc_id')}, seen as (select k, r, text from form join documents on doc_id = k where trim(r) <> '')"
    fold = f"with {_table('shape', fold_signs)}, {_readings('doc', 'shape', 'documents', 'doc_id')}, {_readings('item', 'shape', 'eval_items', 'item_id')}, {_words('dw', 'doc')}, {_words('iw', 'item')}"
    return {
        "p9_found": f"{read} select a.k as doc_a, b.k as doc_b from seen a join seen b on a.r = b.r and a.k < b.k and a.text <> b.text",
        "p9_classes": f"{read}, linked as (select a.k as doc_id, count(*) as n_links from seen a join seen b on a.r = b.r and a.text <> b.text group by a.k) select doc_id, (select min(k) from seen s where s.r = o.r) as first_doc, n_links from linked join seen o on o.k = doc_id",
        "p8_found": f"""{fold}, dp as (select distinct k, array_to_string(w[i:i + 9], ' ') as p from (select k, w, unnest(range(1, len(w) - 8)) as i from dw)),
ip as (select distinct k, array_to_string(w[i:i + 9], ' ') as p from (select k, w, unnest(range(1, len(w) - 8)) as i from iw))
select distinct dp.k as doc_id, ip.k as item_id from dp join ip using (p)""",
        "p8_proximity": f"""{fold}, spots as (select k, unnest(w) as t, unnest(range(len(w))) as i from dw),
need as (select k, len(w) as n, len(list_distinct(w)) as m, w from iw where len(list_distinct(w)) >= 5),
terms as (select k, m, n, unnest(list_distinct(w)) as t from need),
hits as (select s.k as doc_id, e.k as item_id, s.i, s.t, e.m, cast(ceil(1.5 * e.n - 1e-9) as int) as span, cast(ceil(0.8 * e.m - 1e-9) as int) as least from spots s join terms e using (t)),
enough as (select doc_id, item_id from hits group by doc_id, item_id having count(distinct t) >= max(least)),
near as (select * from hits semi join enough using (doc_id, item_id))
select distinct a.doc_id, a.item_id from (
  select a.doc_id, a.item_id, a.i, any_value(a.least) as least, count(distinct b.t) as have from near a join near b on a.doc_id = b.doc_id and a.item_id = b.item_id and b.i >= a.i and b.i < a.i + a.span group by all) a where have >= least""",
    }
