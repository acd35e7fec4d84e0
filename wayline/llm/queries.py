"""The registered queries of the text operators, with their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, jaccard_join, line_dedup, lm_score, mixing, periodic_runs, pieces, pii, quality_rules, token_counts, url_filter, warc, whitening
from .shared import table, words_of

#: (host, path, verdict) of op6.
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(table(spark, sf_dir, "pages"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    judged = quality_rules.judge(docs, table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the text that is left, and how many of its lines went."""
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", "text")


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.train_and_score(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    judged = url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per window of a document that repeats a benchmark item."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids as the library gives them, with begin and end, and what they decode to; spans_sha256 is of the packed ends of the source spans."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    encoded = pieces.encode(table(spark, sf_dir, "documents"), model, packed=True, decoded=True)
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), F.sha2("ends", 256).alias("spans_sha256"))


def repeated(docs: DataFrame) -> DataFrame:
    """documents, a tenth of them by hash with the words from some place on repeated periodically."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def edit(w):
        n = F.size(w).cast("long")
        a = g % F.greatest(n, F.lit(1))
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + (i - a) % p).cast("int"))))

    made = F.array_join(F.transform(F.array(words_of()), edit)[0], " ")
    return docs.select("doc_id", F.when(h % 10 == 0, made).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(repeated(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    d = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    d = d.withColumns({"start": -F.col("b.start"), "length": F.col("b.length"), "period": -F.col("b.period")})
    return d.select("doc_id", "n_runs", "start", "length", "period", F.expr("1000 * length div period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return whitening.whiten(vectors, whitening.fit(vectors))


QUERIES = {f.__name__: f for f in (op1_warc, op2_token_counts, op3_quality_rules, op4_line_dedup, op5_lm_score, op6_url_filter, op7_mixing, op8_decontamination, op9_pii, op10_jaccard_join, op11_sentencepiece, op12_periodic_runs, op13_whitening)}

_W = r"'[\x20\x09-\x0D]+'"
_CUT = {r: (a, b) for r, (a, b) in quality_rules.RULES.items()}


def _over(rule: str, value: str, level: str) -> str:
    """Whether a statistic is above a rule's cutoff at a level."""
    mild, strict = _CUT[rule]
    return f"coalesce({value} > {mild}::double + ({strict}::double - {mild}::double) * {level} / {quality_rules.LEVELS}, false)"


_VALUES = {"symbols": "n_symbols / nullif(n_words, 0)::double", "dup_lines": "n_dup_lines / nullif(n_lines, 0)::double", "repeats": "n_repeat_words / nullif(n_words, 0)::double", "long_words": "word_chars / nullif(n_words, 0)::double", "short_words": "-(word_chars / nullif(n_words, 0)::double)"}
_BROKEN = lambda level: " or ".join(_over(r, v, level) for r, v in _VALUES.items())
_SPLIT_WORDS = rf"list_filter(string_split_regex(coalesce(text, ''), {_W}), lambda w: w <> '')"
_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
SQL = {
    "op10_jaccard_join": rf"""
with recursive d as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_W}), lambda w: w <> '') as w from documents),
x as (select doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) as i from d where len(w) > 0),
sh as (select distinct doc_id, array_to_string(w[i:i + 3], ' ') as s from x),
n as (select doc_id, count(*) as n from sh group by doc_id),
pr as (select a.doc_id as p, b.doc_id as q, count(*) as both_in from sh a join sh b on a.s = b.s and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id),
li as (select p, q from pr join n a on a.doc_id = p join n b on b.doc_id = q where 100 * both_in >= 85 * (a.n + b.n - both_in)),
re(doc_id, other) as (select doc_id, doc_id from d union select re.doc_id, li.q from re join li on li.p = re.other),
co as (select doc_id, min(other) as component_id from re group by doc_id)
select d.doc_id, coalesce(n.n, 0) as n_shingles, co.component_id from d join co on co.doc_id = d.doc_id left join n on n.doc_id = d.doc_id""",
    "op3_quality_rules": rf"""
with d as (select row_number() over () as r, doc_id, lang, coalesce(text, '') as t, {_SPLIT_WORDS} as w from documents),
x as (select r, unnest(range(1, len(w) - 1)) as i, w from d where len(w) >= 3),
tri as (select r, i, w[i] as a, w[i + 1] as b, w[i + 2] as c from x),
twice as (select r, i from (select r, i, count(*) over (partition by r, a, b, c) as n from tri) z where n > 1),
cov as (select r, count(distinct p) as n_repeat_words from (select r, i as p from twice union all select r, i + 1 from twice union all select r, i + 2 from twice) z group by r),
s as (select d.r, doc_id, lang, cast(len(w) as bigint) as n_words, cast(length(regexp_replace(t, '[ 	-
]', '', 'g')) as bigint) as word_chars, cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
 cast(len(list_filter(string_split(t, chr(10)), lambda y: regexp_matches(y, '[^ 	-
]'))) as bigint) as n_lines, cast(len(list_filter(string_split(t, chr(10)), lambda y: regexp_matches(y, '[^ 	-
]'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda y: regexp_matches(y, '[^ 	-
]')))) as bigint) as n_dup_lines,
 coalesce(n_repeat_words, 0) as n_repeat_words from d left join cov on cov.r = d.r),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from s),
l as (select doc_id, min(quality) as q from labels where quality is not null group by doc_id),
h as (select b.*, q from b join l on l.doc_id = b.doc_id where not base_failed),
lv as (select lang, k.level, count(case when q = 1 then 1 end) as n, count(case when q = 1 and ({_BROKEN('k.level')}) then 1 end) as g, count(case when q <> 1 and ({_BROKEN('k.level')}) then 1 end) as bad from h cross join (select unnest(range(0, {quality_rules.LEVELS + 1})) as level) k group by lang, k.level),
ta as (select *, list_sum(list_transform(range(0, g + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({quality_rules.ALPHA}) + (n - i) * ln({1 - quality_rules.ALPHA})))) <= {quality_rules.DELTA} / (select count(distinct coalesce(lang, '?')) from h) as fine from lv),
ok as (select *, bool_and(fine) over (partition by lang order by level) as certified from ta),
pick as (select lang, level from (select *, row_number() over (partition by lang order by bad desc, level) as rk from ok where certified) z where rk = 1)
select b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not (pick.level is not null and ({_BROKEN('pick.level')})) as kept
from b left join pick on pick.lang is not distinct from b.lang""",
    "op7_mixing": rf"""
with d as (select doc_id, source, case when doc_id is null then md5(coalesce(text, '')) end as tie, cast(len({_SPLIT_WORDS}) as bigint) as size from documents),
p as (select source, sum(size) as source_size, 3 * sum(size) as cap, row_number() over (order by source is null, source) - 1 as k from d group by source),
w as (select *, case k % 3 when 0 then 5 when 1 then 2 else 1 end as weight from p),
c as (select *, sum(source_size) over () - coalesce(sum(cap) over (order by cap / weight::double, k rows between unbounded preceding and 1 preceding), 0) as rest, sum(weight) over () - coalesce(sum(weight) over (order by cap / weight::double, k rows between unbounded preceding and 1 preceding), 0) as open from w),
v as (select *, rest / open::double as lev from c),
f as (select *, first_value(case when weight * lev <= cap then lev end ignore nulls) over (order by cap / weight::double, k rows between unbounded preceding and current row) as level from v),
t as (select source, source_size, coalesce(weight * level, cap::double) as target, cast(floor(cast(('0x' || substr(md5('7/' || coalesce('=' || source, 'null')), 1, 8)) as bigint) * {mixing.UNIT / 2**32!r}::double) as bigint) as off from f),
e as (select d.*, cast(('0x' || substr(md5('7:' || coalesce(cast(doc_id as varchar), tie)), 1, 8)) as bigint) % {mixing.BUCKETS} as bucket, (length(bin(size + 1)) - 1) * 8 + (((size + 1) * 8 >> (length(bin(size + 1)) - 1)) & 7) as class, t.source_size, t.target, off, cast(coalesce(round(target / nullif(t.source_size, 0) * {mixing.UNIT}), 0) as bigint) as x from d join t on t.source is not distinct from d.source),
s as (select *, off + sum(x) over (partition by source order by class, bucket, size, doc_id nulls first, tie rows between unbounded preceding and current row) as fin from e)
select doc_id, size, cast(source_size as bigint) as source_size, target, cast((fin // {mixing.UNIT} - (fin - x) // {mixing.UNIT}) * size as bigint) as taken from s""",
    "op1_warc": """
with p as (select page_id, encode(coalesce(html, '')) as b from pages),
q as (select page_id, octet_length(b) as n, sha256(b) as d from p),
f as (select *, min(page_id) over (partition by d) as m from q)
select page_id, cast(n as bigint) as payload_bytes, d as payload_digest,
  case when n >= 100 and page_id <> m then 'revisit' else 'response' end as record_type,
  case when n >= 100 and page_id <> m then m end as refers_to
from f""",
    "op6_url_filter": rf"""
with p as (select page_id, coalesce(url, '') u from pages),
h as (select page_id, lower(regexp_extract(u, '^.*?://([^/?#]*)', 1)) as host, regexp_extract(u, '^.*?://[^/?#]*([^?#]*)', 1) as path from p),
r(rh, rp, rv) as (values {_RULE_ROWS}),
m as (select page_id, host, path, rh || rp as rule, rv, row_number() over (partition by page_id, host, path order by length(rh || rp) desc, length(rh) desc) as k
      from h join r on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp))
select h.page_id, h.host, h.path, m.rule, coalesce(m.rv, 'allow') as verdict
from h left join (select * from m where k = 1) m on m.page_id = h.page_id and m.host = h.host and m.path = h.path""",
}
