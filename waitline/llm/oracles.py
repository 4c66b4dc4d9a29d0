"""SQL that must give the rows of the operators that SQL can state."""

from __future__ import annotations

#: Byte-wise CRC-32 with a table of 256 remainders from their rule, over the UTF-8 bytes of the text.
SHARDING = """
with recursive
step(i, k, c) as (
  select i, 0, i from (select unnest(range(256)) as i)
  union all select i, k + 1, xor(c >> 1, 3988292384 * (c & 1)) from step where k < 8),
remainders as (select list(c order by i) as t from step where k = 8),
docs as (
  select doc_id, octet_length(encode(coalesce(text, ''))) + 1 as size,
    xor(list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'), lambda x: ('0x' || x)::bigint)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)::bigint as text_crc32,
    ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 8))::bigint % 4096 as virtual_slot
  from documents, remainders),
slots as (select unnest(range(4096)) as virtual_slot),
map as (
  select virtual_slot, virtual_slot % 8 as shard,
    case when row_number() over (partition by virtual_slot % 8 order by md5(virtual_slot::varchar)) <= 512 // 9 then 8 else virtual_slot % 8 end as grown
  from slots),
loads as (select virtual_slot, sum(size)::bigint as slot_bytes from docs group by virtual_slot)
select doc_id, size::bigint as size, text_crc32, 'key' as law, shard::int as shard,
  row_number() over (partition by shard order by virtual_slot, text_crc32 % 16, doc_id, text_crc32) - 1 as slot,
  grown::int as grown_shard, virtual_slot, slot_bytes
from docs join map using (virtual_slot) join loads using (virtual_slot)"""

SUBSTRING_DEDUP = r"""
with texts as (
  select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
windows as (
  select doc_id, i, array_to_string(ws[i:i + 12], ' ') as w from (select doc_id, ws, unnest(range(1, len(ws) - 11)) as i from texts)),
firsts as (select w, min(doc_id) as first from windows group by w),
gone as (
  select distinct doc_id, unnest(range(i, i + 13)) as p from windows join firsts using (w) where first < doc_id),
places as (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as p from texts),
kept as (
  select doc_id, count(g.p) as n_removed, coalesce(string_agg(word, ' ' order by p) filter (g.p is null), '') as text
  from places left join gone g using (doc_id, p) group by doc_id)
select doc_id, len(ws)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256
from texts left join kept using (doc_id)"""

EXACT_DEDUP = """
with docs as (select doc_id, sha256(coalesce(text, '')) as text_sha256 from documents),
groups as (select text_sha256, max(doc_id) as keep_id, count(*) as group_size from docs group by text_sha256)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from docs join groups using (text_sha256)"""

#: Words of all texts, the CRC-32 of each distinct one, gains of the buckets, noise from the id.
RESAMPLING = r"""
with recursive
step(i, k, c) as (
  select i, 0, i from (select unnest(range(256)) as i)
  union all select i, k + 1, xor(c >> 1, 3988292384 * (c & 1)) from step where k < 8),
remainders as (select list(c order by i) as t from step where k = 8),
texts as (
  select 'd' as side, doc_id as id, text from documents union all select 't', null, text from benchmark),
words as (
  select side, id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as w from texts),
vocabulary as (
  select w, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(w), '..'), lambda x: ('0x' || x)::bigint)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)::bigint % 10000 as bucket
  from (select distinct w from words), remainders),
placed as (select side, id, bucket from words join vocabulary using (w)),
counts as (
  select bucket, count(*) filter (side = 'd')::double as s, count(*) filter (side = 't')::double as t,
    sum(count(*) filter (side = 'd')) over ()::double as all_s, sum(count(*) filter (side = 't')) over ()::double as all_t
  from placed group by bucket),
gains as (select bucket, floor(1000 * ln((t + 1) * (all_s + 10000) / ((s + 1) * (all_t + 10000))))::bigint as gain from counts),
sums as (select id as doc_id, count(*) as n_features, sum(gain)::bigint as weight from placed join gains using (bucket) where side = 'd' group by id),
scored as (
  select doc_id, coalesce(n_features, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight, coalesce(weight, 0)::bigint
    + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint as score
  from documents left join sums using (doc_id)),
ranked as (
  select doc_id, row_number() over (order by score desc, doc_id) as rank, count(*) over () as n from scored where n_features >= 20)
select doc_id, n_features, weight, score, case when rank <= 10 * n // 100 then rank end as rank from scored left join ranked using (doc_id)"""

EMBEDDING_DEDUP = """
with recursive
able as (
  select vec_id, label, embedding::double[] as v from embeddings
  where label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (
  select a.vec_id as a, b.vec_id as b from able a join able b on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v)
  where list_cosine_similarity(a.v, b.v) >= 0.98),
reach as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a)
select vec_id, (select count(*) from links where a = vec_id) as n_links, component_id, component_id = vec_id as kept
from (select vec_id, least(vec_id, (select min(b) from reach where a = vec_id)) as component_id from embeddings)"""


def _rounds(n: int) -> str:
    """Assignment and new entries of each round, one pair of tables after the other, and the last assignment."""
    near = """a{r} as materialized (
  select vec_id, label, m, v, min(list_sum(list_transform(range(1, len(v) + 1), lambda i: (v[i] - e[i]) * (v[i] - e[i])))::bigint * 16 + k) as best
  from parts join e{r} using (m) group by vec_id, label, m, v),"""
    move = """u{r} as (
  select m, best % 16 as k, i, sum(v[i])::bigint as s, count(*) as n from (select m, best, v, unnest(range(1, len(v) + 1)) as i from a{r}) group by all),
c{r} as (select m, k, list((s - ((s % n) + n) % n) // n order by i) as e from u{r} group by m, k),
e{n} as materialized (select m, k, coalesce(c{r}.e, e{r}.e) as e from e{r} left join c{r} using (m, k)),"""
    return "\n".join(near.format(r=r) + "\n" + (move.format(r=r, n=r + 1) if r < n else "") for r in range(n + 1))


VECTOR_CODES = f"""
with kept as (
  select vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::double)::bigint) as s from embeddings
  where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
parts as materialized (
  select vec_id, label, m, s[m * (len(s) // 8) + 1:(m + 1) * (len(s) // 8)] as v from kept, (select unnest(range(8)) as m)),
e0 as materialized (
  select m, row_number() over (partition by m order by vec_id) - 1 as k, v as e from parts qualify k < 16),
{_rounds(6)}
books as (select sha256(string_agg(x, ',' order by m, k, i)) as codebooks_sha256 from (
  select m, k, unnest(range(1, len(e) + 1)) as i, unnest(e)::varchar as x from e6)),
codes as (
  select vec_id, label, string_agg(printf('%02x', (best % 16)::int), '' order by m) as code, sum(best // 16)::bigint as error
  from a6 group by vec_id, label)
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, codebooks_sha256 from codes, books"""
