"""DuckDB SQL that gives the same rows as queries of this package, where SQL can."""

from __future__ import annotations

from . import decontaminate, licences, mixing, ranked, secrets, spelling

WARC = """
with p as (select page_id, coalesce(html, '') as html from pages),
g as (select *, strlen(html) as n, min(page_id) over (partition by html) as first, count(*) over (partition by html) as copies from p)
select page_id, n as payload_bytes, sha256(html) as payload_digest,
  case when n >= 100 and copies > 1 and page_id is distinct from first and first is not null then 'revisit' else 'response' end as record_type,
  case when n >= 100 and copies > 1 and page_id is distinct from first then first end as refers_to
from g
"""

NGRAM_JOIN = r"""
with recursive words as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
starts as (select doc_id, w, unnest(range(0, greatest(len(w) - 3, 1))) as i from words where len(w) > 0),
shingles as (select distinct doc_id, array_to_string(w[i + 1 : i + 4], ' ') as s from starts),
sizes as (select doc_id, count(*) as n from shingles group by 1),
common as (select a.doc_id as a, b.doc_id as b, count(*) as c from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
edges as (select a, b from links union select b, a from links),
reach as (select doc_id as node, doc_id as comp from sizes union select e.b, r.comp from reach r join edges e on e.a = r.node)
select w.doc_id, cast(coalesce(n, 0) as bigint) as n_shingles, cast(coalesce(c.comp, w.doc_id) as bigint) as component_id
from words w left join sizes using (doc_id) left join (select node, min(comp) as comp from reach group by 1) c on c.node = w.doc_id
"""

MIXING = rf"""
with d as (select doc_id, case when source is null then '1' else concat('0', source) end as src,
  cast(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) as bigint) as size from documents),
k as (select *, md5(concat('42:', cast(doc_id as varchar), ':', cast(size as varchar))) as key from d),
s as (select src, cast(sum(size) as bigint) as source_size from k group by 1),
w as (select *, cast(case (row_number() over (order by src) - 1) % 3 when 0 then {mixing.WEIGHTS[0]} when 1 then {mixing.WEIGHTS[1]} else {mixing.WEIGHTS[2]} end as double) as weight,
  cast(source_size * {mixing.MOST_EPOCHS} as double) as cap, cast(sum(source_size) over () as double) as total from s),
r as (select *, cap / weight as ratio from w),
l as (select *, ratio <= (total - coalesce(sum(cap) over o, cast(0 as double))) / (sum(weight) over () - coalesce(sum(weight) over o, cast(0 as double))) as capped
  from r window o as (order by ratio, src rows between unbounded preceding and 1 preceding)),
t as (select src, source_size, case when capped then cap else weight * (total - sum(case when capped then cap else 0 end) over ()) / sum(case when capped then 0 else weight end) over () end as target from l),
o as (select k.*, source_size, target, cast(sum(size) over (partition by k.src order by key, doc_id rows unbounded preceding) as bigint) - size as start from k join t using (src)),
b as (select *, cast(floor(target) as bigint) as budget from o),
e as (select *, case when source_size > 0 then budget // source_size else 0 end as epochs from b)
select doc_id, size, source_size, target, cast(epochs * size + greatest(0, least(size, budget - epochs * source_size - start)) as bigint) as taken from e
"""

def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_TEMPLATES = ", ".join(f"({i}, {_quoted(t.name)}, {_quoted(t.family)}, {_quoted(t.text)}, [{', '.join(map(_quoted, t.telling))}]::varchar[], {_quoted(licences.FAMILY.get(t.family, ''))})" for i, t in enumerate(licences.TEMPLATES))
LICENCES = rf"""
with tpl as (select * from (values {_TEMPLATES}) as v(t, name, family, text, telling, evidence)),
lower_of as (select t, name, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from tpl),
tw as (select t, name, unnest(regexp_extract_all(text, '[a-z0-9]+')) as word from lower_of),
ttf as (select t, name, word, count(*) as n from tw group by all),
size_of as (select t, count(*) as m from tw group by 1),
listed as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+') as ws from documents),
pos as (select doc_id, len(ws) as len, unnest(ws) as word, unnest(range(0, len(ws))) as p from listed),
total as (select count(*) as n from documents),
df as (select word, count(distinct doc_id) as df from pos where word in (select word from ttf) group by 1),
idf as (select word, ln((1 + total.n) / cast(1 + coalesce(df, 0) as double)) + 1 as idf from (select distinct word from ttf) left join df using (word), total),
tnorm as (select t, sqrt(sum((n * idf) ** 2)) as norm from ttf join idf using (word) group by 1),
weight as (select t, word, n * idf * idf / norm as w, (n * idf / norm) ** 2 as share from ttf join idf using (word) join tnorm using (t)),
held as (select distinct doc_id, word from pos where word in (select word from ttf)),
looked as (select doc_id, t from held join weight using (word) group by 1, 2 having sum(share) >= 0.63),
valued as (select pos.*, size_of.t, m, coalesce(idf, ln(cast(1 + total.n as double)) + 1) as idf, coalesce(w, 0) as w
  from pos join looked using (doc_id) join size_of using (t) cross join total left join idf using (word) left join weight on weight.t = size_of.t and weight.word = pos.word),
running as (select *, sum(w) over r as upto_w, sum(idf * idf) over r as upto_i from valued window r as (partition by doc_id, t order by p rows unbounded preceding)),
ended as (select a.doc_id, a.t, a.p, least(a.m, a.len) as m, b.upto_w - a.upto_w + a.w as dot, b.upto_i - a.upto_i + a.idf * a.idf as squares
  from running a join running b on b.doc_id = a.doc_id and b.t = a.t and b.p = a.p + least(a.m, a.len) - 1),
near as (select * from ended where dot >= (cast(0.8 as double) - cast(0.000001 as double)) * sqrt(greatest(squares, 0))),
wtf as (select n.doc_id, n.t, n.p, any_value(n.m) as m, v.word, any_value(idf) as idf, any_value(w) as w, count(*) as n
  from near n join valued v on v.doc_id = n.doc_id and v.t = n.t and v.p between n.p and n.p + n.m - 1 group by all),
windows as (select doc_id, t, p, any_value(m) as m, sum(n * w) / sqrt(sum((n * idf) ** 2)) as c from wtf group by all),
seen as (select w.doc_id, t, p, p + windows_m as stop, round(c, 9) as c, c as exact, name, family, telling, evidence, size_of.m as size,
    array_to_string(list_concat(case when p = 0 then ['^', '^'] when p = 1 then ['^', ws[1]] else ws[p - 1 : p] end, ['|'], ws[p + 1 : p + windows_m]), ' ') as words
  from (select *, m as windows_m from windows) w join tpl using (t) join size_of using (t) join listed on listed.doc_id = w.doc_id where c >= 0.8 - 1e-9),
ranked as (select *, row_number() over (partition by doc_id order by c desc, name, p, t) as r, coalesce(list_bool_and(list_transform(telling, lambda x: regexp_matches(words, x))), true) as told,
  regexp_matches(words, '{licences.NEGATED}') as negated from seen),
shown as (select * from ranked where size >= {licences.TITLE} or told),
counting as (select * from shown a where not negated and regexp_matches(words, evidence)
  and not exists (select 1 from shown b where b.doc_id = a.doc_id and b.negated and b.r < a.r and a.p < b.stop and b.p < a.stop)),
firsts as (select * from (select *, row_number() over (partition by doc_id order by r) as k from counting) where k = 1),
named as (select f.doc_id, min_by(x.name, x.r) as name, min_by(x.c, x.r) as c from firsts f join ranked x on x.doc_id = f.doc_id and x.family = f.family and x.told and x.p < f.stop and f.p < x.stop group by 1),
own as (select f.doc_id, coalesce(n.name, f.family) as own_licence, coalesce(n.c, f.c) as c from firsts f left join named n using (doc_id)),
files as (select doc_id, concat_ws('/', source, doc_id // 512, case when doc_id % 64 <> 0 then doc_id // 64 end, case when doc_id % 8 = 0 then 'LICENSE' else concat('doc', doc_id, '.txt') end) as path,
  concat_ws('/', source, doc_id // 512, case when doc_id % 64 <> 0 then doc_id // 64 end) as dir, concat_ws('/', source, doc_id // 512) as parent, doc_id % 8 = 0 as licence_file from documents),
known as (select f.*, own_licence, c from files f left join own using (doc_id)),
dirs as (select dir, min_by(own_licence, concat(path, own_licence)) as dir_licence from known where licence_file and own_licence is not null group by 1)
select doc_id, path, own_licence, round(c, 6) as similarity, coalesce(own_licence, l.dir_licence, u.dir_licence) as licence,
  case when own_licence is not null then null when l.dir_licence is not null then k.dir when u.dir_licence is not null then parent end as licence_dir
from known k left join dirs l on l.dir = k.dir left join dirs u on u.dir = k.parent
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc_dictionary": WARC, "op2_decontaminate": decontaminate.ORACLE_SQL, "op4_licences": LICENCES, "op9_ngram_jaccard": NGRAM_JOIN, "op10_mix_sources": MIXING,
        "op11_spelling_variants": spelling.ORACLE_SQL, "op12_ranked_search": ranked.ORACLE_SQL, "op13_secret_scan": secrets.ORACLE_SQL,
    }
