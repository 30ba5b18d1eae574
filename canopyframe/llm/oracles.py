"""DuckDB SQL of the corpus queries that SQL can express."""

#: crc32 of the bytes whose hexadecimal digits are in x, before its last inversion.
_CRC32 = """list_reduce(
  list_prepend(4294967295::bigint, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::bigint)),
  lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1]))"""

OP11 = rf"""
with recursive bits as (
  select list(list_reduce(list_prepend(k, range(8)), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by k) steps
  from (select unnest(range(256)) k)),
runs as (
  select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') run
  from documents),
distinct_runs as (select doc_id, run, count(*) n from runs where length(run) >= 7 group by all),
summed as (
  select run, n, xor({_CRC32}, 4294967295) h
  from (select *, lower(hex(encode(coalesce(doc_id::varchar, '') || ':' || run))) x from distinct_runs), bits),
cut as (select case when h % 31 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end word, n from summed),
words as materialized (select word, sum(n)::bigint n from cut where length(word) >= 7 group by word having sum(n) >= 2),
gaps as materialized (
  select word, substr(word, 1, i - 1) || '$' || substr(word, i + 1) gap, substr(word, 1, i - 1) || substr(word, i + 1) short
  from (select word, unnest(range(1, length(word) + 1)) i from words)),
pairs as materialized (
  select a.word, b.word other from gaps a join gaps b on a.gap = b.gap and a.word <> b.word
  union select g.word, w.word from gaps g join words w on g.short = w.word
  union select w.word, g.word from gaps g join words w on g.short = w.word),
near as (
  select p.word, count(*) n_near, first(o.word order by o.n desc, o.word) best, max(o.n) best_n
  from pairs p join words o on o.word = p.other group by p.word),
forms as materialized (select word, best, best_n from near join words using (word) where best_n >= 10 * n),
chain as (
  select word, word last, 0 hop from words
  union all select c.word, f.best, hop + 1 from chain c join forms f on f.word = c.last)
select w.word, f.best form, c.last root, w.n, coalesce(r.n_near, 0) n_near, f.best_n form_n
from words w left join near r using (word) left join forms f using (word)
join (select word, arg_max(last, hop) last from chain group by word) c using (word)
"""

OP12 = r"""
with texts as (
  select doc_id, coalesce(lang, '') part, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') words from documents),
marks as (select doc_id, max((quality = 1)::int) good, max((toxic = 1)::int) toxic from labels group by doc_id),
failing as materialized (
  select t.doc_id, part, coalesce(good, 0) good, coalesce(toxic, 0) toxic, [
    len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t),
    regexp_matches(t, '[#$%&*|]'), coalesce(t.doc_id > min(t.doc_id) over (partition by t), false)] fails
  from texts t left join marks m on m.doc_id = t.doc_id),
letters as (select unnest(range(1, 6)) f),
orders as (
  select [a.f, b.f, c.f, d.f, e.f] o from letters a, letters b, letters c, letters d, letters e
  where len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
removal as (
  select part, o, good, toxic, n, fails, list_position(list_transform(o, lambda f: fails[f]), true) gone
  from (select part, fails, sum(good) good, sum(toxic) toxic, count(*) n from failing group by all), orders),
steps as (
  select part, o, step, o[step] f,
    sum(n) - coalesce(sum(n) filter (gone <= step), 0) kept, coalesce(sum(n) filter (gone = step), 0) removed,
    coalesce(sum(n) filter (fails[o[step]] and gone < step), 0) redundant,
    coalesce(sum(n) filter (fails[o[step]] and len(list_filter(fails, lambda x: x)) = 1), 0) unique_fails,
    coalesce(sum(good) filter (gone = step), 0) good_lost, coalesce(sum(toxic) filter (gone = step), 0) toxic_lost
  from removal, (select unnest(range(1, 6)) step) group by part, o, step)
select part, array_to_string(list_transform(o, lambda f: substr('ABCDE', f::int, 1)), '') filter_order, step::int step, kept::bigint kept, removed::bigint removed,
  redundant::bigint redundant, unique_fails::bigint unique_fails, good_lost::bigint good_lost, toxic_lost::bigint toxic_lost,
  (sum(removed) over (partition by part, f))::bigint shapley
from steps
"""
