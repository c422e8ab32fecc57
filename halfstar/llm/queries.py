"""One query per operator over its whole table, with the settings meant for production."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from halfstar.llm import (
    collocations, exact_dedup, jaccard, kneser_ney, language_id, mixing, pieces, pii, projections, quality_rules, secrets, url_filter, vector_codes,
)
from halfstar.llm.registry import ORACLES, QUERIES, query, table

__all__ = ["ORACLES", "QUERIES"]

EXACT_SQL = r"""
with t as (select doc_id, length(coalesce(text, '')) as chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm from documents),
r as (select *, row_number() over (partition by norm order by chars desc, doc_id nulls last) as place,
             count(*) over (partition by norm) as group_size,
             first_value(doc_id) over (partition by norm order by chars desc, doc_id nulls last) as keep_id from t)
select doc_id, keep_id, group_size, place = 1 as kept, sha256(norm) as text_sha256 from r
"""


@query("op7_exact_dedup", EXACT_SQL)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, folder, "documents"))


MIX_SQL = rf"""
with t as (select row_number() over () as row, doc_id, source, md5(coalesce('=' || doc_id::varchar, 'null')) as h,
       len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size, row_number() over (order by source is null, encode(source)) - 1 as place from t group by source),
w as (select *, place % 3 + 1 as weight from s),
n as (select *, sum(source_size) over () - 3 * coalesce(sum(source_size) over (o rows between unbounded preceding and 1 preceding), 0) as rest,
             sum(weight) over (o rows between current row and unbounded following) as weights
      from w window o as (order by source_size / weight, place)),
h as (select *, weight * rest > 3 * source_size * weights as held from n),
l as (select rest as rest0, weights as weights0 from h where not held order by source_size / weight, place limit 1),
g as (select source, place, source_size, case when held then (3 * source_size)::double else (weight * rest0)::double / weights0::double end as target
      from h left join l on true),
c as (select *, sum(target) over (order by place rows unbounded preceding) / sum(target) over () as hi, ceil(source_size / {{b}})::bigint as blocks from g where target > 0),
p as (select *, coalesce(lag(hi) over (order by place), 0.0) as lo from c),
k as (select k, (k % {mixing.PERIOD} * {mixing.STEP} % {mixing.PERIOD} + 0.5::double) / {mixing.PERIOD}::double as x
      from range((select ceil(sum(size) / {{b}})::bigint from t)) r(k)),
q as (select place, blocks, row_number() over (partition by place order by k) - 1 as rank from k join p on x >= lo and x < hi),
u as (select place, rank % blocks as block, count(*) as uses from q where rank < 3 * blocks group by 1, 2),
d as (select t.row, t.doc_id, t.size, g.source_size, g.target, g.place,
             coalesce(sum(size) over (partition by g.place order by h, doc_id, size, row rows between unbounded preceding and 1 preceding), 0) as start
      from t join g on t.source is not distinct from g.source),
e as (select row, start, start + size as fin, place, unnest(range((start // {{b}})::bigint, ((start + size - 1) // {{b}})::bigint + 1)) as block from d where size > 0),
m as (select row, sum((least(fin, (block + 1) * {{b}}) - greatest(start, block * {{b}})) * uses)::bigint as taken from e join u using (place, block) group by row)
select doc_id, size, source_size, round(target, 6) as target, coalesce(taken, 0) as taken from d left join m using (row)
""".replace("{b}", "64")


@query("op4_mix_sources", MIX_SQL)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_report(mixing.mix_sources(table(spark, folder, "documents")))


PIECE_MODEL = "piece_bpe_32k.model"


@query("op8_pieces")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers  # the other queries work without it

    model = public_tokenizers.path(PIECE_MODEL)
    encoded = pieces.encode_texts(table(spark, folder, "documents").select("doc_id", "text"), model)
    return pieces.decode_texts(encoded, model).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op9_quality_rules")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, folder, "documents"))


def joined(spans: Column | str) -> Column:
    """kind:start:end of an array of spans, in its order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


@query("op3_personal_data")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, folder, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    place = {kind: F.lit(i) for i, kind in enumerate(pii.KINDS)}
    ranked = F.transform(
        F.concat("base", "added"),
        lambda s: F.struct(F.element_at(F.create_map(*[x for k, i in place.items() for x in (F.lit(k), i)]), s.kind), s.start, s.end, s.kind),
    )
    every = F.transform(F.array_sort(ranked), lambda s: F.concat_ws(":", s.kind, s.start, s.end))
    return found.select(
        "doc_id", *map(count, pii.KINDS), F.sha2(joined("base"), 256).alias("base_sha256"),
        F.array_join(every, ",").alias("spans"), F.size("added").cast("long").alias("n_added"),
    )


SECRETS_SQL = r"""
with t as (select doc_id, row_number() over () as row, coalesce(text, '') as text from documents),
p(kind, rank, pattern) as (values
  ('assign', 1, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'),
  ('access', 2, 'AKIA[A-Z0-9]+'), ('hex', 3, '[0-9a-f]+'), ('candidate', 4, '[A-Za-z0-9+/_=-]{20,}')),
f as (select row, kind, rank, unnest(found) as found, unnest(range(1, len(found) + 1)) as i, gaps, found as every
      from (select row, kind, rank, regexp_extract_all(text, pattern, 0) as found,
                   list_transform(string_split_regex(text, pattern), lambda g: length(g)) as gaps from t, p)),
s as (select row, kind, rank, found, (coalesce(list_sum(gaps[1:i]), 0) + coalesce(list_sum(list_transform(every[1:i - 1], lambda m: length(m))), 0))::bigint as a from f
      where length(found) >= case kind when 'assign' then 12 when 'access' then 18 when 'hex' then 16 else 20 end),
base as (select row, kind, rank, a, a + length(found) as z from s
         where kind in ('access', 'hex') or kind = 'assign' and length(regexp_extract(found, '^((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2)) >= 12),
c as (select row, a, found, case when regexp_matches(found, '^[0-9a-fA-F]+$') then 2.8 else 3.5 end as least from s
      where kind = 'candidate' and regexp_matches(found, '[0-9]') and regexp_matches(found, '[A-Za-z]')),
q(pattern) as (values ('^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$'),
  ('(?i)example|sample|dummy|placeholder|changeme|x{8}'), ('(?i)0123456789|123456789|abcdefghij')),
o as (select row, a, unnest(found) as found, unnest(range(1, len(found) + 1)) as i, gaps, found as every
      from (select row, a, regexp_extract_all(found, pattern, 0) as found,
                   list_transform(string_split_regex(found, pattern), lambda g: length(g)) as gaps from c, q)),
allowed as (select row, a, (coalesce(list_sum(gaps[1:i]), 0) + coalesce(list_sum(list_transform(every[1:i - 1], lambda m: length(m))), 0))::bigint as x, length(found) as size from o),
w as (select row, a, found, least, unnest(range(0, length(found) - 15)) as i from c),
h as (select row, a, i from w where list_aggregate(string_split(found, '')[i + 1:i + 16], 'entropy') >= least - 1e-9
        and not exists (select 1 from allowed x where x.row = w.row and x.a = w.a and x.x < w.i + 16 and w.i < x.x + x.size)),
place as (select distinct row, a + i + unnest(range(0, 16)) as spot from h),
clear as (select row, spot from place where not exists (select 1 from base b where b.row = place.row and b.a <= place.spot and place.spot < b.z)),
run as (select row, spot, spot - row_number() over (partition by row order by spot) as island from clear),
added as (select row, 'entropy' as kind, 4 as rank, min(spot) as a, max(spot) + 1 as z from run group by row, island having count(*) >= 16),
g as (select row, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
             string_agg(kind || ':' || a || ':' || z, ',' order by a, rank) as spans from base group by row),
e as (select row, string_agg(kind || ':' || a || ':' || z, ',' order by a, rank) as spans, count(*) filter (kind = 'entropy') as n_entropy
      from (select * from base union all select * from added) group by row)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
       sha256(coalesce(g.spans, '')) as base_sha256, coalesce(e.spans, '') as spans, coalesce(n_entropy, 0) as n_entropy
from t left join g using (row) left join e using (row)
"""


@query("op1_secrets", SECRETS_SQL)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, folder, "documents"))
    ranks = F.create_map(*[F.lit(x) for i, k in enumerate((*secrets.KINDS, "entropy")) for x in (k, i)])
    by_start = lambda spans: F.array_sort(
        F.transform(spans, lambda s: F.struct(s.start.alias("start"), F.element_at(ranks, s.kind), s.end.alias("end"), s.kind.alias("kind")))
    )
    count = lambda kind: F.size(F.filter("base", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *map(count, secrets.KINDS), F.sha2(joined(by_start(F.col("base"))), 256).alias("base_sha256"),
        joined(by_start(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_entropy"),
    )


URL_RULES = [
    ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"),
]


def _strength_sql(rows: str) -> str:
    """SQL for (mean, strength) of the beta prior over the counts (bad, n) in ``rows``."""
    return f"""
(select mean, case when n is null then 2 else least(greatest(case when rho > 0 then 1 / rho - 1 else 1000 end, 2), 1000) end as strength
 from (select *, case when scale > 0 then (bb - bad * bad / n - (k - 1) * mean * (1 - mean)) / (mean * (1 - mean) * scale) else 0 end as rho
       from (select *, coalesce(least(greatest(bad / n, 1e-4), 1 - 1e-4), 0.5) as mean, n - nn / n as scale
             from (select sum(bad)::double as bad, sum(n)::double as n, sum(n::double * n) as nn, sum(bad::double * bad / n) as bb, count(*) as k
                   from {rows} where n > 0))))"""


URL_SQL = rf"""
with u as (select page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), '{url_filter.UPPER}', '{url_filter.LOWER}') as host,
                  coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') as path,
                  try_cast(nullif(regexp_extract(url, '(?:^|[^/]|[^:]/)/([0-9]{{1,18}})(?:\.[A-Za-z0-9]+)?/?(?:[?#].*)?$', 1), '') as bigint) as doc_id from pages),
o as (select u.*, 1 - quality as bad from u left join labels using (doc_id)),
h as (select host, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') as domain, string_split(host, '.')[-1] as suffix,
             count(bad) as n, coalesce(sum(bad), 0)::bigint as bad from o group by all),
d as (select domain, suffix, sum(n) as n, sum(bad) as bad from h group by all),
s as (select suffix, sum(n) as n, sum(bad) as bad from d group by all),
s1 as (select suffix, (bad + mean * strength) / (n + strength) as rate from s, {_strength_sql("s")}),
d1 as (select domain, (bad + rate * strength) / (n + strength) as rate from d join s1 using (suffix), {_strength_sql("d")}),
h1 as (select host, bad + rate * strength as p, n - bad + (1 - rate) * strength as q from h join d1 using (domain), {_strength_sql("h")}),
h2 as (select host, p / (p + q) as rate, greatest(p / (p + q) - 2 * sqrt(p * q / ((p + q) * (p + q) * (p + q + 1))), 0) as bound from h1),
r(verdict, rule, name, start) as (select verdict, rule, split_part(rule, '/', 1), substr(rule, instr(rule, '/')) from (values {", ".join(map(str, URL_RULES))}) v(verdict, rule)),
f as (select page_id, arg_max(rule, length(rule)) as rule, arg_max(verdict, length(rule)) as verdict
      from u join r on (host = name or ends_with(host, '.' || name)) and starts_with(path, start) group by page_id)
select page_id, u.host, u.path, f.rule, coalesce(f.verdict, case when bound > 0.5 then 'block' else 'allow' end) as verdict,
       round(rate, 6) as host_rate, round(bound, 6) as host_bound
from u left join f using (page_id) join h2 on u.host = h2.host
"""


@query("op5_url_filter", URL_SQL)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """A page's outcome is the quality label of the document whose number ends its address."""
    pages = table(spark, folder, "pages")
    # The number can have a file ending; a host after :// is no document.
    number = F.regexp_extract("url", r"(?:^|[^/]|[^:]/)/([0-9]{1,18})(?:\.[A-Za-z0-9]+)?/?(?:[?#].*)?$", 1)
    shown = pages.select("page_id", F.when(number != "", number.cast("long")).alias("doc_id"))
    labels = table(spark, folder, "labels").select("doc_id", (1 - F.col("quality")).alias("bad"))
    outcomes = shown.join(labels, "doc_id").select(F.col("page_id").alias("_row"), "bad")
    return url_filter.filter_urls(pages, outcomes, URL_RULES)


@query("op10_jaccard_join")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.similar_classes(table(spark, folder, "documents"))


@query("op2_quality_classifier")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return kneser_ney.quality(table(spark, folder, "documents"), table(spark, folder, "labels")).drop("_key")


@query("op6_language_id")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.identify(table(spark, folder, "pages"), table(spark, folder, "documents"))


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Plain rounds over all parts and entries, one after the other."""
    gap = "list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = [f"""
k as materialized (select row_number() over (order by vec_id nulls last, embedding) as row, vec_id, label,
       list_transform(embedding, lambda x: floor(4096 * x::double)::bigint) as v from embeddings
     where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as materialized (select row, part, v[part * (len(v) // {parts}) + 1:(part + 1) * (len(v) // {parts})] as v from k, range({parts}) t(part)),
c0 as materialized (select part, row - 1 as entry, v from p where row <= {entries})"""]
    for i in range(rounds + 1):
        steps.append(f"""
a{i} as materialized (select row, part, any_value(p.v) as v, min({gap}::hugeint * {entries} + entry) as best from p join c{i} c using (part) group by row, part)""")
        if i < rounds:
            steps.append(f"""
s{i} as (select part, (best % {entries})::bigint as entry, d, sum(v[d]) as total, count(*)::hugeint as n from a{i}, range(1, (select max(len(v)) + 1 from p)) t(d) group by all),
c{i + 1} as materialized (select c.part, c.entry, coalesce(f.v, c.v) as v from c{i} c
       left join (select part, entry, list(((total - ((total % n) + n) % n) // n)::bigint order by d) as v from s{i} group by part, entry) f using (part, entry))""")
    return "with " + ",".join(steps) + f""",
e as (select row, string_agg(printf('%02x', (best % {entries})::bigint), '' order by part) as code, sum(best // {entries})::bigint as error from a{rounds} group by row),
b as (select sha256(coalesce(string_agg(x::varchar, ',' order by part, entry, d), '')) as codebooks_sha256
      from (select part, entry, unnest(v) as x, unnest(range(1, len(v) + 1)) as d from c{rounds}))
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from k join e using (row), b
"""


@query("op11_vector_codes", _codes_sql())
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return vector_codes.compress(table(spark, folder, "embeddings"))


@query("op12_near_vectors")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return projections.near_duplicates(table(spark, folder, "embeddings"))


COLLOCATIONS_SQL = r"""
with t as (select coalesce(lang, 'und') as lang, row_number() over () as row,
                  unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as words from t),
g as (select lang, words, k, unnest(range(1, len(words) - k + 2)) as i from w, range(1, 6) s(k) where len(words) >= k),
f as materialized (select lang, k::bigint as k, array_to_string(words[i:i + k - 1], ' ') as phrase, count(*)::hugeint as f from g group by all),
n as (select lang, sum(f)::hugeint as n from f where k = 1 group by lang),
c as materialized (select lang, k, phrase, f as a, string_split(phrase, ' ') as words from f where k > 1 and f >= 100),
inner_ as (select lang, array_to_string(words[i:i + m - 1], ' ') as phrase, max(a) as longer
           from (select *, unnest(range(1, k - m + 2)) as i from (select *, unnest(range(2, k)) as m from c where k > 2)) group by all),
d as (select c.* from c left join inner_ x using (lang, phrase) where longer is null or 100 * longer < 100 * a),
u as (select *, array_to_string(words[1:cut], ' ') as one, array_to_string(words[cut + 1:], ' ') as two from (select *, unnest(range(1, k)) as cut from d)),
s as (select u.lang, u.phrase, a, l.f as l, r.f as r, n, cut, 1000 * a * n // (l.f * r.f) as score
      from u join f l on l.lang = u.lang and l.phrase = one and l.k = cut join f r on r.lang = u.lang and r.phrase = two and r.k = u.k - cut join n on n.lang = u.lang),
b as (select * from s qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
o as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from b)
select lang, rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score from o where rank <= 2000
"""


@query("op13_collocations", COLLOCATIONS_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))
