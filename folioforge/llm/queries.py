"""The thin queries of this subpackage, each over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.common import fold, small_batches, table
from folioforge.llm.decontam import find_contamination
from folioforge.llm.exact_dedup import exact_groups
from folioforge.llm.language import fit_languages, identify_languages
from folioforge.llm.lexical_search import search
from folioforge.llm.line_dedup import drop_frequent_lines
from folioforge.llm.mixing import mix_sources
from folioforge.llm.near_dup import near_duplicates
from folioforge.llm.pii import replace_pii
from folioforge.llm.quality import fit_neighbours, score_quality
from folioforge.llm.secrets import find_secrets, written
from folioforge.llm.substring_dedup import repeated_passages
from folioforge.llm.url_filter import Rule, filter_urls
from folioforge.llm.vector_codes import codebooks_digest, encode, fit_codebooks, hex_code, with_label_errors

#: Draws the surrogates of op3; an installation passes its own to ``replace_pii``.
PII_KEY = "folioforge-demo-key"

#: Fixed by the contract of op13.
URL_RULES = (Rule("allow", "org"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_frequent_lines(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    out = find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_pii(table(spark, sf_dir, "documents"), PII_KEY)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_neighbours(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model).select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark, 128)  # a batch holds pairs of shingle sets, too
    return near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.length("text").alias("size"))
    return mix_sources(docs, size_col="size").select("doc_id", "mix_source", "block", "slot", "release", "deadline", "mix_start", "in_mix")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_passages(table(spark, sf_dir, "documents"), min_words=50)
    spans = F.transform("removed", lambda r: F.concat_ws(":", r["start"].cast("string"), r["end"].cast("string"), r["words"].cast("string")))
    return out.select("doc_id", "text", "n_units", "n_removed", F.array_join(spans, ",").alias("removed"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    count = lambda k: F.size(F.filter(spans, lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter(spans, lambda x: x["kind"].isin("assign", "access", "hex"))
    return find_secrets(table(spark, sf_dir, "documents")).select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(written(base), 256).alias("base_sha256"), written(spans).alias("spans"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    out = identify_languages(docs.select("doc_id", "text"), fit_languages(docs))
    return out.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    books = fit_codebooks(vectors, parts=8, entries=16, rounds=6)
    out = with_label_errors(encode(vectors, books))
    return out.select("vec_id", hex_code(F.col("codes")).alias("code"), "error", "label_error", F.lit(None if books is None else codebooks_digest(books)).cast("string").alias("codebooks_sha256"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

SQL = {
    "op1_line_dedup": f"""
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents),
k as (select doc_id, pos, line, trim(translate(line, {_AZ}), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as key from l),
f as (select key from k where key <> '' group by key having count(distinct doc_id) >= 10),
m as (select k.*, f.key is not null as gone from k left join f using (key))
select doc_id, count(*)::bigint as n_lines, count(*) filter (where gone)::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from m group by doc_id""",
    "op2_decontamination": f"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
b as (select item_id::varchar as item_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark),
x as (select distinct item_id, least(13, len(w)) as n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') as win
  from b, lateral (select unnest(range(1, len(w) - least(13, len(w)) + 2)) as i) where len(w) > 0),
s as (select distinct n from x),
o as (select doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') as win from d, s, lateral (select unnest(range(1, len(w) - n + 2)) as i) where len(w) >= n),
h as (select o.doc_id, o.i, o.n, x.item_id from o join x using (n, win)),
c as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from h) group by doc_id),
t as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as items from (select distinct doc_id, item_id from h) group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join c using (doc_id) left join t using (doc_id)""",
    "op5_near_dup": f"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select distinct doc_id, array_to_string(w[i : i + greatest(0, least(3, len(w)) - 1)], ' ') as s from w, lateral (select unnest(range(1, greatest(1, len(w) - 2) + 1)) as i) where len(w) > 0),
n as (select doc_id, count(*) as n from s group by doc_id),
c as (select x.doc_id as a, y.doc_id as b, count(*) as m from s x join s y on x.s = y.s and x.doc_id < y.doc_id group by all),
e as (select a, b from c join n p on p.doc_id = a join n q on q.doc_id = b where 100 * m >= 85 * (p.n + q.n - m)),
r as (select doc_id as node, doc_id as seen from documents union select r.node, case when e.a = r.seen then e.b else e.a end from r join e on r.seen = e.a or r.seen = e.b)
select d.doc_id, coalesce(any_value(n.n), 0)::bigint as n_shingles, min(r.seen) as component_id, min(r.seen) = d.doc_id as kept
from documents d join r on r.node = d.doc_id left join n on n.doc_id = d.doc_id group by d.doc_id""",
    "op6_mixing": """
with recursive d as (select doc_id, coalesce(source, '') as source, greatest(coalesce(length(text), 0), 1) as size from documents),
t as (select source, sum(size) as n, sqrt(sum(size)) as w from d group by source),
x as (select source, n, w / sum(w) over () * 1000 as exact from t),
f as (select source, n, exact, greatest(1, floor(exact))::bigint as a0, row_number() over (order by floor(exact) - exact, source) as r from x),
a as (select source, n, a0 + (r <= 1000 - sum(a0) over ())::bigint as a, row_number() over (order by source) as i from f),
p as (select list(a order by i) as a from a),
s(t, slot, done) as (select 0, 0, list_transform(a, lambda y: 0) from p
  union all select t + 1, pick, list_transform(done, lambda y, i: y + (i = pick)::int) from (
    select s.t, s.done, list_sort(list_filter(list_transform(p.a, lambda y, i: case when s.done[i] < y and s.done[i] * 1000 // y <= s.t then ((s.done[i] + 1) * 1000 + y - 1) // y * 100000 + i end), lambda z: z is not null))[1] % 100000 as pick
    from s, p where s.t < 1000)),
k as (select a.source, a.a, a.n, s.t - 1 as slot, row_number() over (partition by a.source order by s.t) as k from s join a on s.slot = a.i where s.t > 0),
e as (select min((n + 131071) // 131072 // a * 1000 + slot) as e from k where k = (n + 131071) // 131072 % a + 1),
m as (select doc_id, source, coalesce(sum(size) over (partition by source order by md5(doc_id::varchar) rows between unbounded preceding and 1 preceding), 0)::bigint as mix_start from d)
select doc_id, m.source as mix_source, mix_start // 131072 as block, mix_start // 131072 // a * 1000 + slot as slot, mix_start // 131072 * 1000 // a as release,
  ((mix_start // 131072 + 1) * 1000 + a - 1) // a as deadline, mix_start, mix_start // 131072 // a * 1000 + slot < e.e as in_mix
from m join k on k.source = m.source and k.k = mix_start // 131072 % k.a + 1, e""",
    "op7_substring_dedup": f"""
with d as (select doc_id, coalesce(text, '') as text, translate(coalesce(text, ''), {_AZ}) as low from documents),
x as (select doc_id, text, regexp_extract_all(low, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w, string_split_regex(low, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as g from d),
e as (select doc_id, unnest(range(1, len(w) + 1)) as i, unnest(w) as v, unnest(g[: len(w)]) as gap from x),
p as (select doc_id, i, (sum(len(gap) + len(v)) over (partition by doc_id order by i) - len(v))::bigint as start from e),
n as (select x.doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) as h from x, lateral (select unnest(range(1, len(w) - 48)) as i) where len(w) >= 50),
o as (select h, min(doc_id) as keep from n group by h having count(*) > 1),
f as (select doc_id, i, keep, case when doc_id = keep then i - min(i) over (partition by doc_id, h) else 50 end as since from n join o using (h)),
j as (select doc_id, i, (i - coalesce(lag(i) over (partition by doc_id order by i), -100) > 50)::int as new from f where since >= 50),
k as (select doc_id, i, sum(new) over (partition by doc_id order by i) as island from j),
r as (select doc_id, min(i) as a, max(i) + 50 as z from k group by doc_id, island),
s as (select r.doc_id, p.start as a, coalesce(q.start, len(x.text)) as z, r.z - r.a as words from r join x using (doc_id) join p on p.doc_id = r.doc_id and p.i = r.a left join p q on q.doc_id = r.doc_id and q.i = r.z),
l0 as (select doc_id, list_filter(regexp_extract_all(text, '[^\\n]*[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]*'), lambda y: y <> '') as u from d),
l1 as (select doc_id, unnest(u) as line, unnest(range(len(u))) as pos from l0),
l as (select doc_id, pos, len(line) as size, sum(len(line)) over (partition by doc_id order by pos) as upto from l1),
c as (select l.doc_id, count(*) as n_units, count(*) filter (where exists (select 1 from s where s.doc_id = l.doc_id and s.a < l.upto and s.z > l.upto - l.size)) as n_removed from l group by l.doc_id),
t as (select doc_id, list(struct_pack(a := a, z := z) order by a) as m, string_agg(a || ':' || z || ':' || words, ',' order by a) as removed from s group by doc_id)
select d.doc_id, case when m is null then text else list_reduce(list_prepend('', list_transform(range(len(m) + 1), lambda b: text[case when b = 0 then 0 else m[b].z end + 1 : case when b = len(m) then len(text) else m[b + 1].a end])), lambda u, v: u || v) end as text,
  coalesce(n_units, 0)::bigint as n_units, coalesce(n_removed, 0)::bigint as n_removed, coalesce(removed, '') as removed
from d left join t using (doc_id) left join c using (doc_id)""",
    "op8_exact_dedup": f"""
with n as (select doc_id, translate(coalesce(text, ''), {_AZ}) as t from documents)
select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size, doc_id = max(doc_id) over (partition by t) as kept, sha256(t) as text_sha256 from n""",
}


def _secrets_sql() -> str:
    # written out here, so that the SQL doesn't follow the operator's own patterns
    keys = "[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]"
    users = "[uU][sS][eE][rR](?:[nN][aA][mM][eE])?|[lL][oO][gG][iI][nN]|[cC][lL][iI][eE][nN][tT]_?[iI][dD]|[aA][cC][cC][oO][uU][nN][tT]"
    given = "[\"'']?\\x20*[:=]\\x20*[\"'']?"
    patterns = (
        (f"(?:{keys}){given}([A-Za-z0-9+/_.=-]+)", 1, "len(v) >= 6"),
        ("AKIA[A-Z0-9]+", 0, "len(v) >= 20"),
        ("[0-9a-f]+", 0, "len(v) >= 24"),
        (f"(?:{users}){given}[A-Za-z0-9@_.-]+", 0, "true"),
        ("[A-Za-z0-9+/]+", 0, "len(v) >= 40 and regexp_matches(m, '[A-Z]') and regexp_matches(m, '[a-z]') and regexp_matches(m, '[0-9]')"),
        ("[a-z][a-z0-9+]*://[A-Za-z0-9._~:/?#@%&=+-]+|[hH][oO][sS][tT][\"'']?\\x20*[:=]\\x20*[\"'']?[A-Za-z0-9_.:-]+|[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}", 0, "true"),
    )
    each = []
    for i, (re, group, ok) in enumerate(patterns):
        each.append(f"""select doc_id, {i} as kind, s + len(m) as "end", s as start from (
  select doc_id, m, sum(len(g) + len(m)) over (partition by doc_id order by o) - len(m) as s, v from (
    select doc_id, unnest(string_split_regex(text, '{re}')[: len(m)]) as g, unnest(m) as m, unnest(v) as v, unnest(range(len(m))) as o from (
      select doc_id, text, regexp_extract_all(text, '{re}') as m, regexp_extract_all(text, '{re}', {group}) as v from documents where regexp_matches(text, '{re}'))))
where {ok}""")
    return f"""
with p0 as ({' union all '.join(each)}),
p as (select * from p0 where kind < 3 or not exists (select 1 from p0 b where b.doc_id = p0.doc_id and b.kind < 3 and b.start < p0."end" and p0.start < b."end")),
near as (select a.doc_id, a.kind, a.start, a."end", bool_or(b.kind in (1, 3)) as ident, bool_or(b.kind in (0, 2, 4)) as secret, bool_or(b.kind = 5) as endpoint
  from p a left join p b on a.doc_id = b.doc_id and (a.kind, a.start, a."end") <> (b.kind, b.start, b."end") and b.start - a."end" <= 300 and a.start - b."end" <= 300 group by all),
k as (select doc_id, kind, start, ['assign', 'access', 'hex', 'login', 'blob', 'endpoint'][kind + 1] || ':' || start || ':' || "end" as s from near
  where kind < 3 or (kind = 3 and secret) or (kind = 4 and (ident or endpoint)) or (kind = 5 and ident and secret)),
g as (select doc_id, count(*) filter (where kind = 0) as a, count(*) filter (where kind = 1) as b, count(*) filter (where kind = 2) as c,
  string_agg(s, ',' order by start, kind) filter (where kind < 3) as base, string_agg(s, ',' order by start, kind) as spans from k group by doc_id)
select d.doc_id, coalesce(a, 0)::bigint as n_assign, coalesce(b, 0)::bigint as n_access, coalesce(c, 0)::bigint as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from documents d left join g using (doc_id)"""


SQL["op9_secret_scan"] = _secrets_sql()


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    steps = [
        f"""v as materialized (select vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::double)::bigint) as x from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)""",
        f"x as materialized (select vec_id, p, x[p * len(x) // {parts} + 1 : (p + 1) * len(x) // {parts}] as x from v, (select unnest(range({parts})) as p))",
        f"""c0 as materialized (select p, x as c, row_number() over (partition by p order by vec_id) - 1 as e from x
  where vec_id in (select vec_id from v order by vec_id limit {entries}))""",
    ]
    for r in range(rounds + 1):
        steps.append(f"""a{r} as materialized (select vec_id, p, min(struct_pack(d := d, e := e)) as b from (
  select vec_id, x.p, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d from x join c{r} on x.p = c{r}.p) group by all)""")
        if r < rounds:
            steps.append(f"""m{r} as materialized (select p, e, list(m order by j) as c from (
  select p, e, j, floor(sum(y) // count(*) - case when sum(y) % count(*) < 0 then 1 else 0 end)::bigint as m from (
    select x.p, a.b.e as e, unnest(x.x) as y, unnest(range(len(x.x))) as j from a{r} a join x using (vec_id, p)) group by all) group by all)""")
            steps.append(f"c{r + 1} as materialized (select p, e, coalesce(m{r}.c, c{r}.c) as c from c{r} left join m{r} using (p, e))")
    return f"""
with {', '.join(steps)},
k as (select sha256(string_agg(array_to_string(c, ','), ',' order by p, e)) as codebooks_sha256 from c{rounds}),
o as (select vec_id, string_agg(lpad(lower(hex(b.e)), 2, '0'), '' order by p) as code, sum(b.d)::bigint as error from a{rounds} group by vec_id)
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, codebooks_sha256 from o join v using (vec_id), k"""


SQL["op11_vector_codes"] = _codes_sql()

SQL["op12_lexical_search"] = f"""
with q0 as (select item_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as w from benchmark),
q as (select item_id, t, count(*) as times from (select item_id, unnest(w) as t from q0) group by all),
d as materialized (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as w from documents),
s as (select count(*) filter (where len(w) > 0) as n, sum(len(w))::bigint as l from d),
p as materialized (select r, t, count(*) as tf from (select r, unnest(w) as t from d) where t in (select t from q) group by all),
f as (select t, floor(1000 * ln((2 * any_value(s.n) + 2) / (2 * count(*) + 1)))::bigint as w from p, s group by t),
m as (select r, doc_id, 100 - 25 + (25 * len(w) * n) // l as m from d, s where len(w) > 0),
g as (select item_id, r, sum(times * f.w * ((1000000000 * tf) // (1000 * tf + 12 * m.m)))::bigint as score from q join p using (t) join f using (t) join m using (r) group by all),
k as (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id)::int as rank from g join m using (r) where score > 0)
select item_id, rank, doc_id, score from k where rank <= 20"""


def _urls_sql() -> str:
    url = "(?s)^.*?://([^/?#]*)([^?#]*)(?:\\?([^#]*))?"
    part = lambda c, k: f"coalesce(regexp_extract({c}, '{url}', {k}), '')"
    host = lambda c: f"translate({part(c, 1)}, {_AZ})"

    def node(c: str) -> str:
        kept = f"list_filter(string_split({part(c, 3)}, '&'), lambda y: y <> '' and not regexp_matches(y, '^(?:utm_[a-z]+|gclid|fbclid)='))"
        bare = f"regexp_replace({host(c)}, ':(?:80|443)$', '')"
        bare = f"case when regexp_matches({bare}, '^www\\.[^.]+\\.') then substr({bare}, 5) else {bare} end"
        path = f"rtrim(regexp_replace({part(c, 2)}, '/index\\.(?:html?|php)$', '/'), '/')"
        return f"case when contains({c}, '://') then {bare} || {path} || case when len({kept}) > 0 then '?' || array_to_string({kept}, '&') else '' end end"

    def attr(name: str) -> str:
        found = f"(?is)\\s{name}\\s*=\\s*(?:\"([^\"]*)\"|''([^'']*)''|([^\\s\"''>]+))"
        return "trim(replace(" + " || ".join(f"regexp_extract(tag, '{found}', {k})" for k in (1, 2, 3)) + ", '&amp;', '&'))"

    rule = " ".join(f"when ({{h}} = '{r.host}' or ends_with({{h}}, '.{r.host}')) and starts_with({{p}}, '{r.path}') then '{r.name}'" for r in sorted(URL_RULES, key=lambda r: -len(r.name)))
    ruled = lambda h, p: "case " + rule.format(h=h, p=p) + " end"
    blocks = ", ".join(f"'{r.name}'" for r in URL_RULES if r.verdict == "block")
    return f"""
with recursive j as (select page_id, url, {host('url')} as host, {part('url', 2)} as path, {node('url')} as node from pages),
r as (select *, {ruled('host', 'path')} as rule from j),
g as (select url, unnest(regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script\\b.*?</script>', ' ', 'g'), '(?is)<(?:link|meta)\\s[^>]*>')) as tag from pages),
t as (select url, case when regexp_matches(tag, '(?i)^<link\\s') and list_contains(string_split_regex(lower({attr('rel')}), '\\s+'), 'canonical') then {attr('href')}
  when regexp_matches(tag, '(?i)^<meta\\s') and lower({attr('http-equiv')}) = 'refresh' then regexp_extract({attr('content')}, '(?is)^\\s*[0-9.]+\\s*[;,]\\s*(?:url\\s*=\\s*)?["'']?(.*?)["'']?\\s*$', 1) end as t from g),
l as (select url, case when regexp_matches(t, '(?i)^[a-z][a-z0-9+.-]*://') then t when starts_with(t, '//') then regexp_extract(url, '(?s)^(.*?:)//', 1) || t
  when starts_with(t, '#') or regexp_matches(t, '(?i)^[a-z][a-z0-9+.-]*:') then null when starts_with(t, '/') then regexp_extract(url, '(?s)^.*?://[^/?#]*') || t
  when starts_with(t, '?') then regexp_extract(url, '(?s)^.*?://[^/?#]*') || {part('url', 2)} || t
  else regexp_extract(url, '(?s)^.*?://[^/?#]*') || coalesce(nullif(regexp_replace({part('url', 2)}, '[^/]*$', ''), ''), '/') || regexp_replace(t, '^(?:\\./)+', '') end as target from t where t <> ''),
e as (select distinct {node('url')} as a, {node('target')} as b, url, target from l),
way as (select a, b from e where a <> b union select b, a from e where a <> b),
blocked as (select node from r where rule in ({blocks}) union select {node('u')} from (select unnest([url, target]) as u from e where a <> b) where {ruled(host('u'), part('u', 2))} in ({blocks})),
reach as (select node from blocked union select b from reach join way on a = node)
select page_id, host, path, rule, case when rule in ({blocks}) or (rule is null and node in (select node from reach where node is not null)) then 'block' else 'allow' end as verdict from r"""


SQL["op13_url_filter"] = _urls_sql()

QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_decontamination, op3_pii, op4_quality, op5_near_dup, op6_mixing, op7_substring_dedup, op8_exact_dedup, op9_secret_scan, op10_language_id, op11_vector_codes, op12_lexical_search, op13_url_filter)}
