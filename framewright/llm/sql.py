"""DuckDB SQL that gives the rows of those queries that SQL can express."""

WARC = """
with p as (
  select page_id, coalesce(html, '') as html, cast(strlen(coalesce(html, '')) as bigint) as payload_bytes, sha256(coalesce(html, '')) as payload_digest
  from pages
), m as (select *, min(page_id) over (partition by payload_digest) as least from p)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 100 and page_id <> least then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 100 and page_id <> least then least end as refers_to
from m
"""

DECONTAMINATE = r"""
with dw as (
  select doc_id, unnest(w) as word, generate_subscripts(w, 1) as pos from (
    select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents)
), iw as (
  select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), windows as (
  select distinct item_id, n, w[s : s + n - 1] as run from (
    select item_id, w, least(10, len(w)) as n, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) as s from iw where len(w) > 0)
), lists as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents where text is not null
), starts as (
  select d.doc_id, d.pos, x.n, x.item_id
  from dw d join windows x on d.word = x.run[1] join lists l on l.doc_id = d.doc_id
  where l.w[d.pos : d.pos + x.n - 1] = x.run
), hits as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(generate_series(pos, pos + n - 1)) as p from starts) group by doc_id),
found as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, cast(item_id as varchar) as item from starts) group by doc_id
), words as (select doc_id, count(*) as n_words from dw group by doc_id)
select doc_id, coalesce(n_words, 0) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from documents left join words using (doc_id) left join hits using (doc_id) left join found using (doc_id)
"""

def _tree(levels: int) -> str:
    """The splitting tree's levels: each node's blocks by a hash, the first of them to its left child."""
    out = ""
    for k in range(levels):
        out += f"""l{k} as (select *, row_number() over (partition by low, high order by md5('7:{k}:' || coalesce(source, '') || ':' || block), source nulls first, block) as r, count(*) over (partition by low, high) as n, (low + high) // 2 as middle from b{k}),
b{k + 1} as (select source, block, case when high - low > 1 and r * (high - low) > n * (middle - low) then middle else low end as low, case when high - low > 1 and r * (high - low) <= n * (middle - low) then middle else high end as high from l{k}),
"""
    return out


MIX = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size, md5(coalesce(cast(doc_id as varchar), '')) as o from documents
), s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
w as (select *, [5, 2, 1][cast((row_number() over (order by source asc nulls last) - 1) % 3 as integer) + 1] as w, source_size * 3 as cap from s),
r as (
  select *, cap / w as ratio, sum(source_size) over () as all_words,
    coalesce(sum(cap) over (order by cap / w, source asc nulls last rows between unbounded preceding and 1 preceding), 0) as capped,
    sum(w) over () - coalesce(sum(w) over (order by cap / w, source asc nulls last rows between unbounded preceding and 1 preceding), 0) as w_left
  from w
), f as (select *, (all_words - capped) * w <= cap * w_left as fits from r),
one as (select all_words - capped as words, w_left from f where fits order by ratio, source asc nulls last limit 1),
t as (
  select source, source_size,
    case when bool_or(fits) over (order by ratio, source asc nulls last rows between unbounded preceding and current row)
      then cast((select words from one) as double) * w / (select w_left from one) else cast(cap as double) end as target
  from f
), p as (
  select d.*, t.source_size, t.target, sum(d.size) over (partition by d.source order by d.o, d.doc_id rows between unbounded preceding and current row) - d.size as place,
    case when t.source_size > 0 then least(cast(floor(t.target / t.source_size) as bigint), 3) else 0 end as turns
  from d join t on d.source is not distinct from t.source
)
, q as (select *, cast(case when size = 0 then 0 else turns + case when turns < 3 and place + size / 2 <= target - turns * source_size then 1 else 0 end end as bigint) as times from p),
g as (select source, any_value(target) as target from q where times > 0 group by source), u as (select source, cast(ceil(case when sum(target) over () > 0 then target * 1024 / sum(target) over () else 0 end) as integer) as quota, sum(target) over () as whole from g),
b0 as (select source, unnest(range(0, quota)) as block, 0 as low, 16 as high from u),
""" + _tree(4) + r"""c as (
  select doc_id, pass, least(cast(floor((place + (pass - 1) * source_size) * 1024 / whole) as integer), quota - 1) as block, u.source from (select *, unnest(range(1, times + 1)) as pass from q where times > 0) q join u on u.source is not distinct from q.source
), e as (select doc_id, string_agg(cast(low as varchar), ',' order by pass) as shards from c join b4 on b4.source is not distinct from c.source and b4.block = c.block group by doc_id)
select q.doc_id, cast(size as bigint) as size, source_size, target, times * cast(size as bigint) as taken, coalesce(shards, '') as shards
from q left join e on e.doc_id is not distinct from q.doc_id
"""


def _level(name: str, units: str, prior: str, rate: str) -> str:
    """CTEs of one level: `name`_w with the prior's weight by moments, `name` with the posterior mean of each unit."""
    return f"""{name}_j as (select u.*, {rate} as rate from {units} u {prior}),
{name}_m as (select sum(n * pow(good / n - rate, 2) - rate * (1 - rate)) as extra, sum(n - 1) as freedom, sum((n - 1) * rate * (1 - rate)) as most from {name}_j where n >= 2),
{name}_w as (select greatest(1.0::double, least(1000.0::double, coalesce(case when freedom > 0 and extra > 0 then most / extra - 1 else 1000.0::double end, 1000.0::double))) as weight from {name}_m),
{name} as (select j.*, weight, (good + weight * rate) / (n + weight) as mean from {name}_j j, {name}_w)"""


URL_FILTER = f"""
with p as (select page_id, coalesce(case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) end, '') as rest from pages),
h as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from p),
ruled as (
  select *, case when (host = 'example.net' or ends_with(host, '.example.net')) and starts_with(path, '/en/') then 'example.net/en/'
    when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/de/') then 'example.com/de/'
    when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/fr/') then 'org/fr/'
    when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/') then 'net/' end as rule from h
), outcomes as (select doc_id as page_id, cast(quality = 1 and coalesce(toxic, 0) <> 1 as bigint) as good from labels where quality is not null and doc_id is not null),
counted as (select host, cast(coalesce(sum(good), 0) as bigint) as good, count(good) as n from h left join outcomes using (page_id) group by host),
labels_of as (select *, regexp_replace(host, ':[0-9]*$', '') as bare from counted),
parts as (select *, string_split(bare, '.') as l, regexp_matches(bare, '^[0-9.]+$') as address from labels_of),
ends as (select *, array_to_string(l[greatest(1, len(l)) : len(l)], '.') as one, array_to_string(l[greatest(1, len(l) - 1) : len(l)], '.') as two, array_to_string(l[greatest(1, len(l) - 2) : len(l)], '.') as three from parts),
hosts as (
  select host, good, n, case when address then '' when known then two else one end as suffix, case when address then bare when known then three else two end as domain
  from (select *, two in ('co.uk', 'org.uk', 'ac.uk', 'gov.uk', 'com.au', 'net.au', 'org.au', 'co.nz', 'co.jp', 'or.jp', 'com.br', 'co.in', 'com.cn') as known from ends)
), overall as (select (coalesce(sum(good), 0) + 1) / (coalesce(sum(n), 0) + 2) as overall from hosts),
by_suffix as (select suffix, sum(good) as good, sum(n) as n from hosts group by suffix),
by_domain as (select suffix, domain, sum(good) as good, sum(n) as n from hosts group by suffix, domain),
{_level("suffixes", "by_suffix", ", overall", "overall")},
{_level("domains", "by_domain", "join suffixes s on s.suffix = u.suffix", "s.mean")},
{_level("own", "hosts", "join domains d on d.suffix = u.suffix and d.domain = u.domain", "d.mean")},
known as (select host, mean - 1.645::double * sqrt(mean * (1 - mean) / (n + weight + 1)) as bound from own)
select page_id, host, path, rule, case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow'
  when bound >= 0.5::double * overall then 'allow' else 'block' end as verdict, round(bound, 6) as bound
from ruled join known using (host), overall
"""
