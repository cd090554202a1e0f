"""The corpus operators' queries on the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, divergence, langid, licenses, linededup, lm, mixing, pii, quality, simhash, topk, urlfilter, whitening
from .common import documents

#: Fixed values of the URL query: when which pattern was listed (days after 2024-01-01), and how.
LISTED = (
    ("casino-win.example.com", "block", 30), ("casino-win.example.com", "remove", 200), ("casino-win.example.com", "block", 260),
    ("free-bets.example.com", "block", 0), ("free-bets.example.com", "allow", 120), ("free-bets.example.com/en", "block", 180),
    ("cheap-pills.example.com", "block", 90), ("www.cheap-pills.example.com", "allow", 150),
    ("example.org", "block", 300), ("blog.tionsh.example.com", "block", 45), ("blog.tionsh.example.com/fr", "allow", 60),
)
FIRST_DAY = "timestamp '2024-01-01 00:00:00'"


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.train(docs.filter(~langid.held_out()))
    return langid.predict(docs, model, keep=["doc_id"]).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return pii.replace(docs, key="a key of the corpus").withColumnRenamed("entities replaced", "n_replaced")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(documents(spark, sf_dir))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.drop_repeated_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.withColumnRenamed("lines removed", "n_removed")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = lambda n: F.expr(f"{FIRST_DAY} + make_interval(0, 0, 0, cast({n} as int))")
    captures = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", day("page_id * 37 % 366").alias("fetched"))
    entries = spark.createDataFrame(LISTED, "pattern string, action string, day int")
    out = urlfilter.judge(captures, entries.select("pattern", "action", day("day").alias("at")))
    return out.withColumn("fetched", F.date_format("fetched", "yyyy-MM-dd"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(documents(spark, sf_dir))


def paths(docs: DataFrame) -> DataFrame:
    """A place in a tree for each document; one in twenty is a licence file."""
    name = F.when(F.col("doc_id") % 20 == 0, F.lit("LICENSE")).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    depth = F.slice(F.array(*[F.concat(F.lit(c), F.expr(f"cast(doc_id div {n} % {m} as string)")) for c, n, m in (("a", 1, 7), ("b", 7, 5), ("c", 35, 3))]), 1, (F.col("doc_id") % 4).cast("int"))
    return docs.withColumn("path", F.concat_ws("/", F.col("source"), depth, name))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan(paths(documents(spark, sf_dir).select("doc_id", "source", "text")))
    return out.select("doc_id", "path", "licence", F.round("cosine", 6).alias("cosine"), "licence_from")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {
    "op1_simhash_pivots": op1,
    "op2_language_id": op2,
    "op3_pii_surrogates": op3,
    "op4_mix_sources": op4,
    "op5_lm_interpolation": op5,
    "op6_line_windows": op6,
    "op7_url_lists": op7,
    "op8_quality_fences": op8,
    "op9_license_scan": op9,
    "op10_spaced_seeds": op10,
    "op11_pivot_search": op11,
    "op12_divergence_audit": op12,
    "op13_whitening": op13,
}

TEMPLATES = ", ".join(f"({i}, '{k}', '{t}', {licenses.tells(t)})" for i, (k, t) in enumerate(licenses.all_templates()))
SQL = {
    "op6_line_windows": r"""
with l as (select doc_id, string_split(text, chr(10)) as ls from documents where text is not null),
p as (select doc_id, ls, unnest(range(0, len(ls) - 2)) as pos from l where len(ls) >= 3),
w as (select doc_id, pos, ls[pos + 1] || chr(10) || ls[pos + 2] || chr(10) || ls[pos + 3] as k from p
  where regexp_matches(ls[pos + 1] || ls[pos + 2] || ls[pos + 3], '[^\x20\x09-\x0D]')),
r as (select doc_id, pos, first_value(doc_id) over o as fd, first_value(pos) over o as fp, row_number() over o as n
  from w window o as (partition by k order by doc_id, pos)),
g as (select distinct doc_id, unnest(range(case when doc_id = fd then greatest(pos, fp + 3) else pos end, pos + 3)) as gone from r where n > 1),
e as (select doc_id, unnest(ls) as line, unnest(range(0, len(ls))) as i from l),
k as (select e.doc_id, string_agg(e.line, chr(10) order by e.i) filter (where g.gone is null) as text, count(g.gone) as n_removed
  from e left join g on e.doc_id = g.doc_id and e.i = g.gone group by e.doc_id)
select d.doc_id, case when d.text is null then null else coalesce(k.text, '') end as text, coalesce(k.n_removed, 0) as n_removed
from documents d left join k on d.doc_id = k.doc_id""",
    "op7_url_lists": f"""
with listed as (select * from (values {", ".join(f"('{p}', '{a}', {d})" for p, a, d in LISTED)}) as t(pattern, action, since)),
i as (select pattern, action as verdict, since, lead(since) over (partition by pattern order by since) as until from listed),
c as (select page_id, url, page_id * 37 % 366 as day, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)) as host,
  regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1) as path from pages),
b as (select c.page_id, i.verdict, i.pattern, row_number() over (partition by c.page_id order by length(i.pattern) desc) as n
  from c join i on (c.host = i.pattern or ends_with(c.host, '.' || i.pattern) or c.host || c.path = i.pattern or starts_with(c.host || c.path, i.pattern || '/'))
  and c.day >= i.since and (i.until is null or c.day < i.until) and i.verdict <> 'remove')
select c.page_id, c.url, strftime(date '2024-01-01' + cast(c.day as integer), '%Y-%m-%d') as fetched,
  coalesce(b.verdict, 'allow') as verdict, b.pattern from c left join b on c.page_id = b.page_id and b.n = 1""",
    "op8_quality_fences": r"""
with d as (select row_number() over () as rid, doc_id, lang, source, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d),
p as (select rid, unnest(words) as word, unnest(range(0, len(words))) as i from w where len(words) > 5),
q as (select rid, i, word || ' ' || lead(word, 1) over o || ' ' || lead(word, 2) over o || ' ' || lead(word, 3) over o || ' ' || lead(word, 4) over o as gram
  from p window o as (partition by rid order by i)),
t as (select rid, i from (select rid, i, count(*) over (partition by rid, gram) as c from q where gram is not null) where c > 1),
n as (select rid, count(distinct place) as n_repeat_words from (select rid, unnest(range(i, i + 5)) as place from t) group by rid),
b as (select w.rid, doc_id, lang, source, len(words) as n_words, length(array_to_string(words, '')) as word_chars,
  length(text) - length(translate(text, '#*$%&|<>', '')) as n_symbols, len(lines) - len(list_distinct(lines)) as n_dup_lines,
  len(lines) as n_lines, coalesce(n_repeat_words, 0) as n_repeat_words from w left join n on w.rid = n.rid),
r as (select *, case when word_chars > 0 then n_symbols * 1000 // word_chars end as symbol_rate,
  case when n_lines > 0 then n_dup_lines * 1000 // n_lines end as dup_line_rate,
  case when n_words > 0 then word_chars * 100 // n_words end as word_length,
  n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from b),
m as (select lang, source, 'symbol_rate' as rule, 40 as spread, symbol_rate as v from r
  union all select lang, source, 'dup_line_rate', 100, dup_line_rate from r
  union all select lang, source, 'word_length', 80, word_length from r),
e as (select 'source' as level, lang, source, rule, spread, v from m where v is not null
  union all select 'lang', lang, null, rule, spread, v from m where v is not null
  union all select 'all', null, null, rule, spread, v from m where v is not null),
s as (select level, lang, source, rule, spread, (v >> greatest(length(bin(v)) - 5, 0)) << greatest(length(bin(v)) - 5, 0) as value, count(*) as n from e group by all),
c as (select *, sum(n) over (partition by level, lang, source, rule order by value) as upto, sum(n) over (partition by level, lang, source, rule) as total from s),
f as (select level, lang, source, rule, spread, min(case when upto * 4 >= total then value end) as q1, min(case when upto * 4 >= total * 3 then value end) as q3, max(total) as total from c group by all),
g as (select level, lang, source, max(total) as size, max(case when rule = 'symbol_rate' then q3 + 3 * greatest(q3 - q1, spread) end) as symbol_high,
  max(case when rule = 'dup_line_rate' then q3 + 3 * greatest(q3 - q1, spread) end) as dup_high,
  max(case when rule = 'word_length' then q3 + 3 * greatest(q3 - q1, spread) end) as length_high,
  max(case when rule = 'word_length' then q1 - 3 * greatest(q3 - q1, spread) end) as length_low from f group by all),
l as (select r.*, case when x.size >= 100 then 'source' when y.size >= 100 then 'lang' else 'all' end as level from r
  left join g x on x.level = 'source' and x.lang is not distinct from r.lang and x.source is not distinct from r.source
  left join g y on y.level = 'lang' and y.lang is not distinct from r.lang)
select l.doc_id, l.lang, l.source, n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words, symbol_rate, dup_line_rate, word_length, base_failed, l.level,
  not base_failed and coalesce(symbol_rate <= symbol_high, true) and coalesce(dup_line_rate <= dup_high, true)
  and coalesce(word_length <= length_high, true) and coalesce(word_length >= length_low, true) as kept
from l left join g on g.level = l.level and (l.level = 'all' or g.lang is not distinct from l.lang) and (l.level <> 'source' or g.source is not distinct from l.source)""",
    "op9_license_scan": rf"""
with templates as (select * from (values {TEMPLATES}) as t(tid, licence, body, tells)),
tw as (select tid, licence, unnest(regexp_extract_all(lower(body), '[\p{{L}}\p{{N}}]+')) as term from templates),
tt as (select tid, licence, term, count(*) as tf from tw group by all),
d as (select row_number() over () as rid, doc_id, text, array_to_string(list_concat([source],
  ['a' || doc_id % 7, 'b' || doc_id // 7 % 5, 'c' || doc_id // 35 % 3][1:doc_id % 4], [case when doc_id % 20 = 0 then 'LICENSE' else doc_id || '.txt' end]), '/') as path from documents),
f as (select *, regexp_replace(path, '/?[^/]*$', '') as dir from d),
n as (select count(*) as n from d),
dw as (select rid, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+'))) as term from d),
i as (select v.term, ln((n + 1) / (count(dw.rid) + 1)) + 1 as idf from (select distinct term from tt) v left join dw on v.term = dw.term, n group by v.term, n),
tn as (select tid, sqrt(sum(tf * idf * tf * idf)) as norm from tt join i using (term) group by tid),
s as (select rid, string_split(regexp_replace(text, '([.!?])[ \t\n\x0B\f\r]+', '\1' || chr(10), 'g'), chr(10)) as segments from d where text is not null),
e as (select rid, segments, unnest(range(1, len(segments) + 1)) as j from s),
x as (select rid, array_to_string(segments[j:j + k - 1], ' ') as unit from e, range(1, {licenses.RUN + 1}) as r(k) where j + k - 1 <= len(segments)
  union all select rid, unnest(regexp_split_to_array(text, '{licenses.BLANK}')) from d
  union all select rid, text from f where regexp_matches(path, '{licenses.LICENCE_FILE}')),
u as (select row_number() over () as uid, rid, unit from (select distinct rid, unit from x) where not regexp_matches(unit, '{licenses.DENIED}') or length(unit) > {licenses.LONG_UNIT}),
sw as (select uid, unnest(regexp_extract_all(lower(unit), '[\p{{L}}\p{{N}}]+')) as term from u),
st as (select uid, term, count(*) as tf from sw group by all),
sn as (select uid, sqrt(sum(pow(tf * coalesce(idf, ln(n + 1) + 1), 2))) as norm from st left join i using (term), n group by uid),
c as (select uid, tid, licence, sum(st.tf * idf * tt.tf * idf) as dot from st join i using (term) join tt using (term) group by uid, tid, licence),
r0 as (select u.rid, c.licence, tells, round(dot / sn.norm / tn.norm, 9) as cosine from c join sn using (uid) join tn using (tid) join u using (uid) join templates using (tid)),
b as (select rid, licence, cosine, row_number() over (partition by rid order by tells desc, cosine desc, licence desc) as k from r0 where cosine >= {licenses.COSINE}),
t0 as (select rid, regexp_replace(regexp_extract(text, '{licenses.SPDX}', 1), '[ \t]+', ' ', 'g') as tag from d),
tags as (select rid, case when length(replace(tag, '(', '')) = length(replace(tag, ')', '')) then tag else translate(tag, '()', '') end as tag from t0),
own as (select rid, case when tag <> '' then tag else licence end as licence, case when tag <> '' then 1.0 else cosine end as cosine
  from tags left join (select * from b where k = 1) using (rid) where tag <> '' or licence is not null),
g as (select dir as holder, path as file, licence, row_number() over (partition by dir order by cosine desc, path, licence) as k
  from f join own using (rid) where regexp_matches(path, '{licenses.LICENCE_FILE}')),
r as (select f.dir, file, licence, row_number() over (partition by f.dir order by length(holder) desc) as k
  from (select distinct dir from f) f join g on g.k = 1 and (holder = '' or f.dir = holder or starts_with(f.dir, holder || '/')))
select doc_id, path, coalesce(own.licence, r.licence) as licence, round(cosine, 6) as cosine, case when own.rid is not null then path else r.file end as licence_from
from f left join own on f.rid = own.rid left join r on r.k = 1 and r.dir = f.dir""",
    "op11_pivot_search": r"""
with e as (select row_number() over () as no, vec_id, list_transform(embedding, lambda c: cast(floor(1024 * cast(c as double)) as double)) as x from embeddings
  where embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
s as (select q.no, q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.x, c.x) as bigint) as score from e q join e c on q.no <> c.no where q.vec_id % 100 = 0)
select query_id, row_number() over (partition by no order by score desc, vec_id) as rank, vec_id, score from s qualify rank <= 10""",
    "op10_spaced_seeds": r"""
with d as (select row_number() over () as rid, doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as words from documents),
b as (select item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as words from benchmark),
dt as (select rid, unnest(words) as word, unnest(range(0, len(words))) as i from d),
bt as (select item_id, unnest(words) as word, unnest(range(0, len(words))) as j, least(len(words), 13) as width, case when len(words) >= 9 then 2 else 0 end as wrong from b where len(words) >= 5),
m as (select rid, item_id, i - j as diagonal, j, width, wrong, count(*) over (partition by rid, item_id, i - j) as matched from dt join bt using (word)),
n as (select *, count(*) over (partition by rid, item_id, diagonal order by j range between current row and 12 following) as near from m where matched >= width - wrong),
g as (select rid, item_id, diagonal, any_value(matched) as matched, any_value(width) as width from n group by rid, item_id, diagonal having max(near) >= any_value(width - wrong)),
a as (select d.doc_id, g.item_id, g.matched, g.width, least(len(b.words), len(d.words) - diagonal) - greatest(0, -diagonal) as aligned
  from g join d on d.rid = g.rid join b on b.item_id = g.item_id)
select doc_id, item_id, max(matched) as matched, max(aligned) as aligned from a where aligned >= width group by doc_id, item_id""",
    "op12_divergence_audit": r"""
with d as (select row_number() over () as rid, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
w as (select rid, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
k as (select lang, term from w group by all having count(distinct rid) >= 10),
v as (select lang, count(*) as v from k group by lang),
g as (select distinct lang, source from d),
c as (select lang, source, term, count(*) as n from w semi join k using (lang, term) group by all),
m as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, v.v from g join k using (lang) join v using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
p as (select *, 1 + cast(1000000000::hugeint * (n + 2) // (sum(n) over (partition by lang, source) + 2 * v) as bigint) as p, sum(n) over (partition by lang, term) as ln from m),
q as (select *, 1 + cast(1000000000::hugeint * (ln + 2) // (sum(n) over (partition by lang) + 2 * v) as bigint) as q from p),
s as (select a.lang, a.source, b.source as item, cast(sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as bigint) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
o as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.value, 0) as value from g a join g b on a.lang = b.lang and a.source <> b.source left join s on s.lang = a.lang and s.source = a.source and s.item = b.source
  union all select lang, source, 'term', term, (p - q) * (p - q) // (p + q) from q where n > 0 and p > q)
select lang, source, part, item, value, row_number() over (partition by lang, source, part order by value desc, item) as rank from o qualify part = 'pair' or rank <= 10""",
}
