"""The library's operators applied to whole tables, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.rules import first_match, keyword_hits, keyword_score, signals
from tessera.operators import burdens, evidence, families, joins, metrics, provenance, risk, sampling, scoring, segment
from tessera.plans.registry import query
from tessera.sources.files import cut, dealt

#: Stand-ins for a domain's keywords, common in the tables' prose.
KEYWORDS = ("the", "that", "which", "und", "nicht", "les", "pour", "los", "para", "token")
STRONG = ("which", "nicht", "pour", "para", "token")

_LINES = """lines as (select doc_id, unnest(range(1, len(ls) + 1))::bigint as line_no, unnest(ls) as line, ls from (select doc_id, str_split(text, chr(10)) as ls from documents where text is not null))"""


def _has(k: str) -> str:
    """A whole word, where letters of all scripts count as letters."""
    return rf"regexp_matches(line, '(^|[^\p{{L}}\p{{N}}_]){k}($|[^\p{{L}}\p{{N}}_])', 'i')"


_HITS = ", ".join(f"case when {_has(k)} then '{k}' end" for k in KEYWORDS)
_SCORE = " + ".join(f"(case when {_has(k)} then {2 if k in STRONG else 1} else 0 end)" for k in KEYWORDS)
_TOP = f"""{_LINES}, scored as (select doc_id, line_no, line, {_SCORE} as score, [x for x in [{_HITS}] if x is not null] as hits from lines),
top as (select *, row_number() over (partition by doc_id order by score desc, line_no) as place from scored where score > 0 qualify place <= 3)"""


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _top_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = segment.lines(dealt(_t(spark, sf_dir, "documents").select("doc_id", "text")))
    scored = lines.withColumn("score", keyword_score(F.col("line"), KEYWORDS, STRONG)).where("score > 0")
    return sampling.top_by_group(scored, ["doc_id"], [F.desc("score"), F.col("line_no")], 3).withColumn("hits", keyword_hits(F.col("line"), KEYWORDS))


def _ledger() -> list:
    score, hits = F.col("score"), F.size("hits")
    return [("performance", (score >= 6) & (hits >= 4)), ("protocol", score >= 4), ("secondary", score >= 2)]


_LEDGER = "case when score >= 6 and len(hits) >= 4 then 'performance' when score >= 4 then 'protocol' when score >= 2 then 'secondary' else 'context' end"


@query(f"with {_TOP} select doc_id, line_no, score::bigint as score, place::bigint as place, array_to_string(hits, ',') as hits, {_LEDGER} as ledger, length(line)::bigint as chars from top")
def document_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to lines, scored by keywords, the three best of each routed to a ledger."""
    found = _top_lines(spark, sf_dir)
    return found.select("doc_id", F.col("line_no").cast("long"), F.col("score").cast("long"), F.col("place").cast("long"), F.array_join("hits", ",").alias("hits"), first_match(_ledger(), "context").alias("ledger"), F.length("line").cast("long").alias("chars"))


@query(f"with {_TOP} select {_LEDGER} as ledger, count(*)::bigint as n, count(distinct doc_id)::bigint as documents from top group by 1")
def ledger_route_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _top_lines(spark, sf_dir).withColumn("ledger", first_match(_ledger(), "context"))
    return found.groupBy("ledger").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("documents"))


_FLAGS = "length(text) < 200 as short, regexp_matches(text, '[0-9]') as digits, regexp_matches(text, '[%$&*#]{3}') as symbols, regexp_matches(text, '[A-Z]{4}') as capitals"


@query(f"""with f as (select lang, {_FLAGS} from documents)
select case when symbols then 'junk' when capitals then 'shouting' when short then 'fragment' when digits then 'data' else 'prose' end as class, lang, count(*)::bigint as n,
  sum((symbols::int) + (capitals::int) + (short::int) + (digits::int))::bigint as signals from f group by 1, 2""")
def rule_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ordered cascade of rules and the signals behind it, counted by class."""
    text = F.col("text")
    flags = {"junk": text.rlike("[%$&*#]{3}"), "shouting": text.rlike("[A-Z]{4}"), "fragment": F.length("text") < 200, "data": text.rlike("[0-9]")}
    found = _t(spark, sf_dir, "documents").select("lang", first_match(list(flags.items()), "prose").alias("class"), F.size(signals(flags)).alias("k"))
    return found.groupBy("class", "lang").agg(F.count("*").alias("n"), F.sum("k").cast("long").alias("signals"))


@query(f"with {_LINES} select doc_id, line_no, length(line)::bigint as chars, coalesce(lag(length(line)) over w, 0)::bigint as before_chars, coalesce(lead(length(line)) over w, 0)::bigint as after_chars, coalesce(sum(length(line) + 1) over (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding), 0)::bigint as start from lines window w as (partition by doc_id order by line_no)")
def line_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = segment.neighbours(segment.lines(_t(spark, sf_dir, "documents")), ["doc_id"], ["line_no"], "line")
    length_of = lambda c: F.coalesce(F.length(F.get(c, F.lit(0))), F.lit(0)).cast("long")
    return found.select("doc_id", F.col("line_no").cast("long"), F.length("line").cast("long").alias("chars"), length_of("before").alias("before_chars"), length_of("after").alias("after_chars"), "start")


@query("select doc_id, (row_number() over (partition by doc_id order by k))::bigint as paragraph_no, length(p)::bigint as chars from (select doc_id, generate_subscripts(ps, 1) as k, unnest(ps) as p from (select doc_id, [y for y in [regexp_replace(x, '^\\s+|\\s+$', '', 'g') for x in regexp_split_to_array(text, '\\n\\s*\\n+')] if y <> ''] as ps from documents)) ")
def document_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.paragraphs(_t(spark, sf_dir, "documents")).select("doc_id", F.col("paragraph_no").cast("long"), F.length("text").cast("long").alias("chars"))


def _wins(order: str) -> str:
    return f"""with o as (select o_custkey, o_orderkey, o_orderstatus, o_orderpriority from orders qualify row_number() over (partition by o_custkey order by o_orderkey {order}) = 1)
select c_custkey, o_orderkey, o_orderstatus, o_orderpriority from customer left join o on c_custkey = o_custkey"""


@query(_wins("desc"))
def last_wins_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = joins.last_wins(_t(spark, sf_dir, "orders"), "o_custkey", "o_orderkey")
    return joins.lookup(_t(spark, sf_dir, "customer").select("c_custkey"), side, [("c_custkey", "o_custkey")], ["o_orderkey", "o_orderstatus", "o_orderpriority"])


@query(_wins("asc"))
def first_wins_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = joins.first_wins(_t(spark, sf_dir, "orders"), "o_custkey", "o_orderkey")
    return joins.lookup(_t(spark, sf_dir, "customer").select("c_custkey"), side, [("c_custkey", "o_custkey")], ["o_orderkey", "o_orderstatus", "o_orderpriority"])


@query("""with o as (select doc_id, quality, toxic from labels), d as (select doc_id, source, lang from documents)
select p.page_id, coalesce(a.quality, b.quality)::bigint as quality, coalesce(a.toxic, b.toxic)::bigint as toxic from pages p left join o a on p.page_id = a.doc_id left join o b on p.page_id // 2 = b.doc_id""")
def fallback_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lookup by one key, and where it finds nothing by another."""
    pages = _t(spark, sf_dir, "pages").select("page_id", F.floor(F.col("page_id") / 2).alias("half"))
    side = _t(spark, sf_dir, "labels").select("doc_id", F.col("doc_id").alias("second_id"), F.col("quality").cast("long"), F.col("toxic").cast("long"))
    return joins.lookup(pages, side, [("page_id", "doc_id"), ("half", "second_id")], ["quality", "toxic"]).drop("half")


@query("""select d.doc_id, case when trim(lang) <> '' then lang end as lang, coalesce(l.quality, p.page_id % 2)::bigint as quality, l.toxic::bigint as toxic, p.url
from documents d left join labels l using (doc_id) left join pages p on d.doc_id = p.page_id""")
def precedence_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One wide row a document; a column that several tables have comes from the first that fills it."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", "lang")
    labels = _t(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("long"), F.col("toxic").cast("long"))
    pages = _t(spark, sf_dir, "pages").select("page_id", (F.col("page_id") % 2).alias("quality"), "url")
    return joins.by_precedence(docs, [(labels, "doc_id"), (pages, "page_id")], "doc_id")


_EVENTS = "e as (select event_id, user_id, event_type, floor(epoch(ts))::bigint as at from events)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"))


_LINKED = f"""{_EVENTS}, linked as (select a.event_id, b.event_id as other_event_id, a.user_id, b.event_type as other_event_type, abs(a.at - b.at)::bigint as distance,
  greatest(0.1::double, 1 - abs(a.at - b.at) / 43200.0::double) as score
  from e a join e b on a.user_id = b.user_id and abs(a.at - b.at) <= 43200 and a.event_id <> b.event_id where a.event_type = 'purchase')"""


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    found = joins.within_range(events.where("event_type = 'purchase'"), events, ["user_id"], "at", 43200).where("event_id != other_event_id")
    found = found.withColumn("distance", F.abs(F.col("at") - F.col("other_at")))
    return found.select("event_id", "other_event_id", "user_id", "other_event_type", "distance", scoring.link_by_reach(43200, None).alias("score"))


@query(f"with {_LINKED} select * from linked")
def range_link_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between rows of one key whose positions are near."""
    return _linked(spark, sf_dir)


@query(f"""with {_LINKED}, r as (select * from linked where score >= 0.6 qualify row_number() over (partition by event_id, other_event_type order by score desc, other_event_id) <= 2),
m as (select event_id, other_event_id, max(score) as score, array_to_string(list_sort(list(distinct other_event_type)), ',') as roles from r group by 1, 2)
select *, row_number() over (partition by event_id order by score desc, other_event_id)::bigint as place from m qualify place <= 12""")
def evidence_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best links: some of each role, some in all, roles merged."""
    found = scoring.best_links(_linked(spark, sf_dir), "event_id", "other_event_type", "other_event_id", "score")
    return found.select("event_id", "other_event_id", "score", F.array_join("roles", ",").alias("roles"), F.col("place").cast("long"))


@query(f"""with {_EVENTS} select a.event_id, a.user_id, arg_max(b.event_id, (b.at, b.event_id)) as last_view from e a left join e b on a.user_id = b.user_id and b.event_type = 'view' and b.at <= a.at
where a.event_type = 'purchase' group by 1, 2""")
def nearest_preceding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each row the latest row of another kind at or before it."""
    events = _events(spark, sf_dir)
    views = joins.keep_one(events.where("event_type = 'view'").select("user_id", "at", F.col("event_id").alias("last_view")), ["user_id", "at"], [F.desc("last_view")])
    found = joins.nearest_before(events.where("event_type = 'purchase'").select("event_id", "user_id", "at"), views, ["user_id"], "at", ["last_view"], width=86_400)
    return found.select("event_id", "user_id", "last_view")


@query("select coalesce(a.doc_id, b.page_id) as id, case when b.page_id is null then 'left' else 'right' end as side from (select distinct doc_id from labels) a full join (select distinct page_id from pages) b on a.doc_id = b.page_id where a.doc_id is null or b.page_id is null")
def symmetric_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.difference(_t(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")), _t(spark, sf_dir, "pages").select(F.col("page_id").alias("id")), ["id"])


@query("select p.page_id from pages p where not exists (select 1 from labels l where l.doc_id = p.page_id)")
def foreign_key_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.orphans(_t(spark, sf_dir, "pages"), _t(spark, sf_dir, "labels"), "page_id", "doc_id").select("page_id")


_PREDICTED = "case when regexp_matches(d.text, '[%$&*#]{3}|[A-Z]{4}') then 0 when length(d.text) < 60 then null else 1 end"
_PAIRS = f"p as (select d.doc_id, d.lang, l.quality::varchar as gold, ({_PREDICTED})::varchar as predicted from labels l join documents d using (doc_id))"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    predicted = F.when(text.rlike("[%$&*#]{3}|[A-Z]{4}"), "0").when(F.length(text) < 60, None).otherwise("1")
    docs = _t(spark, sf_dir, "documents").select("doc_id", "lang", predicted.alias("predicted"))
    return docs.join(_t(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("gold")), "doc_id")


@query(f"with {_PAIRS} select lang, count(*)::bigint as total, count(*) filter (gold = predicted)::bigint as correct, count(*) filter (predicted is null)::bigint as missing, count(*) filter (gold = predicted) / count(*)::double as accuracy from p group by lang")
def categorical_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.categorical(_pairs(spark, sf_dir), "gold", "predicted", by=["lang"])


@query("""with p as (select l_returnflag, l_extendedprice as gold, case when l_linenumber < 7 then l_quantity * p_retailprice end as predicted from lineitem join part on l_partkey = p_partkey)
select l_returnflag, count(*)::bigint as support, count(*) filter (abs(gold - predicted) <= greatest(0.25 * greatest(abs(gold), abs(predicted)), 0.01))::bigint as within, count(*) filter (predicted is null)::bigint as missing, round(max(abs(gold - predicted)), 4) as max_error from p group by 1""")
def numeric_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, parts = _t(spark, sf_dir, "lineitem"), _t(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    pairs = items.join(parts, F.col("l_partkey") == F.col("p_partkey")).select("l_returnflag", F.col("l_extendedprice").alias("gold"), F.when(F.col("l_linenumber") < 7, F.col("l_quantity") * F.col("p_retailprice")).alias("predicted"))
    return metrics.numeric(pairs, "gold", "predicted", 0.01, 0.25, ["l_returnflag"]).drop("mean_error").withColumn("max_error", F.round("max_error", 4))


@query(f"with {_PAIRS}, q as (select doc_id, predicted, case when gold = '1' then gold end as gold from p) select count(predicted)::bigint as predicted, count(*) filter (predicted is not null and gold is null)::bigint as unsupported, count(*) filter (predicted is not null and gold is null) / count(predicted)::double as rate from q")
def hallucination_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _pairs(spark, sf_dir).withColumn("gold", F.when(F.col("gold") == "1", F.col("gold")))
    return metrics.unsupported_rate(pairs, [("gold", "predicted")])


@query(f"with {_PAIRS} select count(gold)::bigint as expected, count(*) filter (gold is not null and predicted is null)::bigint as missing, count(*) filter (gold is not null and predicted is null) / count(gold)::double as rate from p")
def missing_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.missing_rate(_pairs(spark, sf_dir), [("gold", "predicted")])


@query(f"with {_PAIRS} select lang, coalesce(gold, '<missing>') as gold, coalesce(predicted, '<missing>') as predicted, count(*)::bigint as n from p group by all")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(_pairs(spark, sf_dir), "gold", "predicted", ["lang"])


_PER_LABEL = f"""{_PAIRS}, c as (select label, count(*) filter (gold = label and predicted = label)::bigint as tp, count(*) filter (predicted = label and gold is distinct from label)::bigint as fp,
  count(*) filter (gold = label and predicted is distinct from label)::bigint as fn from p, (select unnest(['0', '1', '2']) as label) group by label),
m as (select *, coalesce(tp / nullif(tp + fp, 0)::double, 0) as precision, coalesce(tp / nullif(tp + fn, 0)::double, 0) as recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::double, 0) as f1 from c)"""


@query(f"with {_PER_LABEL} select * from m")
def label_precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.per_label(_pairs(spark, sf_dir), "gold", "predicted", ["0", "1", "2"])


@query(f"with {_PER_LABEL} select round(avg(f1), 12) as macro_f1, count(*)::bigint as labels from m")
def macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.macro_f1(_pairs(spark, sf_dir), "gold", "predicted", ["0", "1", "2"]).withColumn("macro_f1", F.round("macro_f1", 12))


_SETS = "s as (select lang, list_distinct(list_filter(w, lambda x, i: i % 2 = 1)) as a, list_distinct(list_filter(w, lambda x, i: i % 2 = 0)) as b from (select lang, [x for x in str_split(replace(text, chr(10), ' '), ' ') if x <> ''] as w from documents))"


@query(f"""with {_SETS}, j as (select lang, case when len(a) + len(b) = 0 then 1.0::double else len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::double end as j from s)
select lang, count(*)::bigint as n, round(avg(case when j = 1 then 1.0::double else 0 end), 9) as exact_rate, round(avg(j), 9) as mean_jaccard from j group by lang""")
def multilabel_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other word of each whole text, against the words between."""
    words = F.filter(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " "), lambda w: w != "")
    sets = _t(spark, sf_dir, "documents").select("lang", words.alias("w")).select("lang", F.array_distinct(F.filter("w", lambda _, i: i % 2 == 0)).alias("a"), F.array_distinct(F.filter("w", lambda _, i: i % 2 == 1)).alias("b"))
    return metrics.multilabel(sets, "a", "b", ["lang"]).withColumns({c: F.round(c, 9) for c in ("exact_rate", "mean_jaccard")})


_RANKS = {"1-URGENT": 5, "2-HIGH": 4, "3-MEDIUM": 3, "4-NOT SPECIFIED": 2, "5-LOW": 1}
_RANK_SQL = "case {} " + " ".join(f"when '{k}' then {v}" for k, v in _RANKS.items()) + " else 0 end"
_GUESS = "case when o_totalprice > 200000 then '1-URGENT' when o_totalprice > 100000 then '3-MEDIUM' else '5-LOW' end"


@query(f"""with p as (select o_orderstatus, {_RANK_SQL.format('o_orderpriority')} as g, {_RANK_SQL.format('(' + _GUESS + ')')} as p from orders)
select o_orderstatus, count(*)::bigint as n, count(*) filter (p > g)::bigint as over, count(*) filter (p < g)::bigint as under, count(*) filter (p > g) / count(*)::double as over_rate, count(*) filter (p < g) / count(*)::double as under_rate from p group by 1""")
def ordinal_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice")
    pairs = _t(spark, sf_dir, "orders").withColumn("guess", first_match([("1-URGENT", price > 200000), ("3-MEDIUM", price > 100000)], "5-LOW"))
    return metrics.ordinal_errors(pairs, "o_orderpriority", "guess", _RANKS, ["o_orderstatus"])


@query(f"""with {_PAIRS}, t as (select lang, count(*) as pairs, avg(case when gold is not distinct from predicted then 1.0::double else 0 end) as observed from p group by lang),
c as (select lang, sum(n1 * n2) as chance from (select lang, label, count(*) filter (gold is not distinct from label) as n1, count(*) filter (predicted is not distinct from label) as n2 from p, (select unnest(['0', '1', null]) as label) group by 1, 2) group by lang)
select lang, pairs::bigint as pairs, round(observed, 9) as observed, round(chance / (pairs * pairs)::double, 9) as expected, round((observed - chance / (pairs * pairs)::double) / (1 - chance / (pairs * pairs)::double), 9) as kappa from t join c using (lang)""")
def cohen_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _pairs(spark, sf_dir)
    ratings = pairs.select("lang", "doc_id", F.inline(F.array(F.struct(F.lit("a").alias("rater"), F.col("gold").alias("value")), F.struct(F.lit("b").alias("rater"), F.col("predicted").alias("value")))))
    return metrics.kappa(ratings, ["doc_id"], "rater", "value", ["lang"]).withColumns({c: F.round(c, 9) for c in ("observed", "expected", "kappa")})


@query("select l_returnflag, count(*)::bigint as n, round(avg(l_quantity), 6) as mean, round(stddev_samp(l_quantity), 6) as sd, round(stddev_samp(l_quantity) / abs(avg(l_quantity)), 6) as cv, min(l_quantity) as low, max(l_quantity) as high from lineitem group by 1")
def describe_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.describe(_t(spark, sf_dir, "lineitem"), "l_quantity", ["l_returnflag"]).withColumns({c: F.round(c, 6) for c in ("mean", "sd", "cv")})


@query("select lang, quantile_cont(n_chars, 0.25)::double as p25, quantile_cont(n_chars, 0.5)::double as p50, quantile_cont(n_chars, 0.9)::double as p90 from documents group by lang")
def interpolated_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.percentiles(_t(spark, sf_dir, "documents"), "n_chars", (0.25, 0.5, 0.9), ["lang"])


@query("select field, value, count(*)::bigint as n from (select 'lang' as field, coalesce(nullif(trim(lang), ''), '<missing>') as value from documents union all select 'source', coalesce(nullif(trim(source), ''), '<missing>') from documents) group by all")
def field_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.distribution(_t(spark, sf_dir, "documents"), ["lang", "source"])


@query("select doc_id, case when (('0x' || right(sha256(doc_id::varchar), 1))::int % 4) = 3 then 'holdout' else 'development' end as split from documents")
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.hash_split(_t(spark, sf_dir, "documents"), "doc_id").select("doc_id", "split")


@query("""with g as (select source, row_number() over (order by sha256('13' || chr(10) || source), source) - 1 as place, count(*) over () as n from (select distinct source from documents)),
c as (select *, greatest(1, round_even(n * 0.7::double, 0))::int as a from g), d as (select *, greatest(0, least(round_even(n * 0.15::double, 0)::int, n - a - 1)) as b from c)
select doc_id, case when place < a then 'train' when place < a + b then 'dev' else 'test' end as split from documents join d using (source)""")
def group_split_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.group_split(_t(spark, sf_dir, "documents"), "source").select("doc_id", "split")


@query("select doc_id, source from (select doc_id, source, sha256('13' || chr(0) || doc_id::varchar) as h from documents) where ('0x' || substr(h, 1, 13))::bigint / 4503599627370496.0::double < 0.1 qualify row_number() over (partition by source order by h, doc_id) <= 3")
def rate_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.rate_sample(_t(spark, sf_dir, "documents"), "doc_id", 0.10, "source", 3).select("doc_id", "source")


@query("""with h as (select doc_id, lang, n_chars, sha256('13' || chr(10) || doc_id::varchar) as h from documents), q as (select *, row_number() over (partition by lang order by h, doc_id) as place, case lang when 'en' then 20 when 'de' then 10 when 'fr' then 10 when 'it' then 10 else 0 end as quota from h),
f as (select * from q where place <= quota), r as (select doc_id, lang, row_number() over (order by n_chars::double desc, h, doc_id) as k from q where place > quota)
select doc_id, lang, 'quota' as selected_by from f union all select doc_id, lang, 'fill' from r where k <= 50 - (select count(*) from f)""")
def quota_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotas by stratum; what a stratum lacks is made up by the rows of most risk."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return sampling.quota_sample(docs, "lang", "doc_id", {"en": 20, "de": 10, "fr": 10, "it": 10}, F.col("n_chars")).select("doc_id", "lang", "selected_by")


@query("with s as (select source, count(*) as n from documents group by 1) select doc_id, source from documents join s using (source) order by n, source, n_chars desc, doc_id limit 25")
def rarest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.rarest_first(_t(spark, sf_dir, "documents"), "source", [F.desc("n_chars"), F.col("doc_id")], 25).select("doc_id", "source")


@query("select doc_id, 'D_' || upper(substr(sha256(to_json([coalesce(source, ''), doc_id::varchar])::varchar), 1, 20)) as stable_id, sha256('{\"doc_id\":' || doc_id || ',\"lang\":' || to_json(lang)::varchar || ',\"source\":' || to_json(source)::varchar || '}') as content_hash from documents")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents")
    content = T.canonical_json(doc_id=F.col("doc_id"), source=F.col("source"), lang=F.col("lang"))
    return docs.select("doc_id", T.stable_id("D_", F.col("source"), F.col("doc_id")).alias("stable_id"), F.sha2(content, 256).alias("content_hash"))


@query("select doc_id, sha256(trim(regexp_replace(replace(text, chr(160), ' '), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))) as squeezed, case when length(text) <= 80 then text else substr(text, 1, 68) || chr(10) || '[truncated]' end as excerpt from documents")
def text_normalization(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", F.sha2(T.squeeze(F.col("text")), 256).alias("squeezed"), T.excerpt(F.col("text"), 80).alias("excerpt"))


@query("""with r as (select doc_id, (case when n_chars < 200 then 25 else 0 end)::double as a, (case when regexp_matches(text, '[%$&*#]{3}') then 40 else 0 end)::double as b, (case when regexp_matches(text, '[A-Z]{4}') then 30 else 0 end)::double as c, (case when regexp_matches(text, '[0-9]') then 15 else 0 end)::double as d from documents),
s as (select doc_id, least(100, least(50, b + c) + least(30, a) + d) as score from r) select doc_id, score::double as score, case when score >= 70 then 'T3' when score >= 40 then 'T2' when score >= 20 then 'T1' else 'T0' end as tier from s""")
def capped_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted reasons whose groups are capped, and the tier of their sum."""
    text = F.col("text")
    reasons = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(n).alias("code"), F.lit(float(w)).alias("weight"))) for n, c, w in (("short", F.col("n_chars") < 200, 25), ("symbols", text.rlike("[%$&*#]{3}"), 40), ("capitals", text.rlike("[A-Z]{4}"), 30), ("digits", text.rlike("[0-9]"), 15)))))
    found = _t(spark, sf_dir, "documents").select("doc_id", reasons.alias("reasons"))
    found = found.select("doc_id", scoring.capped_total(F.col("reasons"), {"symbols": "form", "capitals": "form", "short": "size"}, {"form": 50, "size": 30}).alias("score"))
    return found.withColumn("tier", scoring.risk_tier(F.col("score")))


@query(r"""with d as (select doc_id, regexp_matches(text, '[0-9]') as g, regexp_matches(text, '[A-Z]{4}') as f, n_chars > 2000 as weak, lang, length(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')) < 80 as short from documents),
w as (select doc_id, case when g then 24 else 0 end as w1, case when not f then 0 when g then 6 else 24 end as w2, case when weak then 15 else 0 end as w3,
case when lang = 'de' then (case when weak then 10 else 20 end) when lang = 'fr' then (case when weak then 10 else 15 end) else 0 end as w4, case when short then 15 else 0 end as w5, lang from d),
r as (select doc_id, w1 + w2 + w3 + w4 + w5 as score, concat_ws(' ', case when w1 > 0 then 'document_genre_conflict:' || w1 end, case when w2 > 0 then 'document_family_conflict:' || w2 end, case when w3 > 0 then 'document_non_primary_or_unclear_genre:' || w3 end,
case when w4 > 0 and lang = 'de' then 'document_unclear_or_mixed_family:' || w4 when w4 > 0 then 'document_off_target_family:' || w4 end, case when w5 > 0 then 'document_front_matter_scope_insufficient:' || w5 end) as reasons from w)
select doc_id, score::int as risk_score, case when score >= 70 then 'T3' when score >= 40 then 'T2' when score >= 20 then 'T1' else 'T0' end as risk_tier, reasons from r""")
def document_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' risk by rules on conflicts, genre, family and length, with what each reason adds under its group's cap."""
    docs = _t(spark, sf_dir, "documents")
    conflicts = F.array_compact(F.array(F.when(F.col("text").rlike("[0-9]"), "genre"), F.when(F.col("text").rlike("[A-Z]{4}"), "family")))
    family = F.when(F.col("lang") == "de", "mixed").when(F.col("lang") == "fr", "norr")
    rows = docs.select("doc_id", conflicts.alias("document_conflicts"), F.when(F.col("n_chars") > 2000, "review").alias("document_genre"), family.alias("document_reaction_family"), F.col("text").alias("front_matter_excerpt"))
    reasons = F.array_join(F.transform("risk_reasons", lambda r: F.concat_ws(":", r["code"], r["weight"].cast("string"))), " ")
    return risk.with_risk(rows, "document").select("doc_id", "risk_score", "risk_tier", reasons.alias("reasons"))


def _burdens_sql() -> str:
    """The burdens of trusted texts of no family, by the same fixed values."""
    def any_of(parts: Sequence[str]) -> str:
        return "(" + " or ".join(f"contains(t, '{p}')" for p in parts) + ")"

    hints = ", ".join(f"case when {any_of(parts)} then '{name}' end" for name, parts in burdens.HINTS.items())
    lacking = " or ".join(f"not {any_of(parts)}" for parts in burdens.METRICS.values())
    matrix = rf"case when regexp_matches(t, '\b(?:faradaic efficiency|fe)\b') and (contains(t, '%') or contains(t, 'percent')) and ({lacking}) then '{burdens.MATRIX}' end"
    return rf"""with d as (select doc_id, lower(trim(regexp_replace(replace(coalesce(text, ''), chr(160), ' '), '\s+', ' ', 'g'))) as t from documents),
b as (select doc_id, concat_ws(' ', {hints}, {matrix}) as b from d)
select doc_id, b as burdens, case when b = '' then 'low' when len(string_split(b, ' ')) >= 3 or (contains(b, '{burdens.CONTAMINATION}') and contains(b, '{burdens.MATRIX}')) then 'high' else 'medium' end as severity from b"""


@query(_burdens_sql())
def document_burdens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The burdens that documents' whole texts hint at, and how grave they are."""
    found = burdens.with_burdens(dealt(_t(spark, sf_dir, "documents").select("doc_id", "text")), "text")
    return found.select("doc_id", F.array_join("burdens", " ").alias("burdens"), "severity")


@query("""with p as (select lang, source, case when n_chars > 4000 then 6 when n_chars > 500 then 4 else 1 end as points from documents), t as (select source, lang, sum(points) as points from p group by 1, 2),
r as (select source, lang, points, row_number() over (partition by source order by points desc, lang) as k from t), w as (select source, max(points) filter (k = 1) as top, coalesce(max(points) filter (k = 2), 0) as second, max(lang) filter (k = 1) as lang from r group by 1),
c as (select source, top, second, case when top < 6 then 'unclear' when second >= 6 and top - second <= 3 then 'mixed' else lang end as consensus from w)
select source, consensus, case when consensus in ('unclear', 'mixed') then 'low' when top >= 10 and top - second >= 4 then 'high' else 'medium' end as confidence, top::bigint as top, second::bigint as second from c""")
def weighted_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = F.when(F.col("n_chars") > 4000, 6).when(F.col("n_chars") > 500, 4).otherwise(1)
    found = scoring.weighted_consensus(_t(spark, sf_dir, "documents").select("source", "lang", "n_chars"), "source", "lang", points)
    return found.select("source", "consensus", "confidence", F.col("top").cast("long"), F.col("second").cast("long"))


@query("""with v as (select l_suppkey, case when l_returnflag <> 'X' and l_linenumber < 8 and l_linestatus <> 'Z' then l_quantity end as v from lineitem),
g as (select l_suppkey, count(v) as valid, avg(v) as mean, case when count(v) > 1 then stddev_samp(v) end as sd from v group by 1)
select l_suppkey, valid::bigint as valid, round(mean, 6) as mean, round(sd, 6) as sd, round(sd / abs(mean), 6) as cv, case when valid < 3 then 'insufficient' when round(sd / abs(mean), 9) > 0.57 then 'above_cv' when mean < 25 then 'below_mean' else 'passed' end as gate from g""")
def replicate_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated results by group, their spread, and the first reason for which they do not count."""
    items = _t(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", F.when(F.col("l_linestatus") == "Z", "failed").otherwise("success").alias("status"), (F.col("l_returnflag") != "X").alias("controls"), (F.col("l_linenumber") < 8).alias("whole"))
    found = scoring.replicate_gate(items, "l_suppkey", "l_quantity", "status", "controls", "whole", least=25.0, most_cv=0.57)
    return found.withColumns({c: F.round(c, 6) for c in ("mean", "sd", "cv")})


@query("""with f as (select doc_id, case when n_chars > 300 then 1 else 0 end as fe, case when n_chars > 800 then 1 else 0 end as y, case when n_chars > 1500 then 1 else 0 end as pot, case when n_chars > 3000 then 1 else 0 end as cur, case when n_chars > 6000 then 1 else 0 end as stab, regexp_matches(text, '[%$&*#]{3}') as bad from documents),
s as (select doc_id, greatest(0, least(1, 0.0::double + 0.25::double * fe + 0.25::double * y + 0.2::double * pot + 0.2::double * cur + 0.1::double * stab)) as metric, case when bad then 0.4::double else 0.0::double end as penalty from f),
t as (select *, greatest(0, least(1, 0.25::double * metric + 0.3::double * 0.7::double + 0.2::double * 0.8::double + 0.25::double * 0.6::double - penalty)) as total from s)
select doc_id, round(metric, 6) as metric, round(total, 6) as total, case when penalty >= 0.35 then 'deprioritize' when round(metric, 9) < 0.3 then 'insufficient_evidence' when round(total, 9) >= 0.72 and round(metric, 9) >= 0.65 then 'priority' when round(total, 9) >= 0.42 then 'conditional' else 'insufficient_evidence' end as recommendation from t""")
def triage_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completeness of fields, the weighted total and what it recommends."""
    n = F.col("n_chars")
    fields = {name: F.when(n > least, n) for name, least in (("fe", 300), ("yield", 800), ("potential", 1500), ("current", 3000), ("stability", 6000))}
    found = _t(spark, sf_dir, "documents").select("doc_id", scoring.metric_completeness(fields).alias("metric"), F.when(F.col("text").rlike("[%$&*#]{3}"), 0.4).otherwise(0.0).alias("penalty"))
    rest = F.lit(0.7), F.lit(0.8), F.lit(0.6)
    found = found.withColumn("total", F.round(scoring.triage_total(F.col("metric"), *rest, F.col("penalty")), 9)).withColumn("metric", F.round("metric", 9))
    advice = scoring.recommendation(F.col("metric"), rest[0], rest[1], F.col("total"), F.col("penalty"), F.lit(False))
    return found.select("doc_id", F.round("metric", 6).alias("metric"), F.round("total", 6).alias("total"), advice.alias("recommendation"))


@query("""select coalesce(lang, '<all>') as lang, coalesce(source, '<all>') as source, count(*)::bigint as n, sum(n_chars)::bigint as chars, count(distinct source)::bigint as sources from documents group by grouping sets ((lang), (source), ())""")
def domain_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by several dimensions at once, from one pass."""
    docs = _t(spark, sf_dir, "documents")
    found = docs.groupingSets([[docs["lang"]], [docs["source"]], []], docs["lang"], docs["source"]).agg(F.count("*").alias("n"), F.sum("n_chars").cast("long").alias("chars"), F.countDistinct(docs["source"]).alias("sources"))
    return found.select(F.coalesce("lang", F.lit("<all>")).alias("lang"), F.coalesce("source", F.lit("<all>")).alias("source"), "n", "chars", "sources")


@query(f"""with {_TOP}, l as (select t.*, {_LEDGER} as ledger, d.source from top t join documents d using (doc_id)), s as (select distinct source from documents),
g as (select s.source, count(l.doc_id)::bigint as spans, count(distinct l.doc_id)::bigint as documents, count(*) filter (ledger = 'performance')::bigint as performance, count(*) filter (ledger = 'protocol')::bigint as protocol from s left join l using (source) group by 1)
select *, case when performance = 0 then 'insufficient' when protocol < 2 then 'partial' else 'supported_with_limitations' end as status from g""")
def source_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record for each group, also without spans: counts by ledger and a status ladder."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", "source")
    spans = _top_lines(spark, sf_dir).withColumn("ledger", first_match(_ledger(), "context")).join(docs, "doc_id")
    found = docs.select("source").distinct().join(spans, "source", "left").groupBy("source")
    count_of = lambda name: F.count(F.when(F.col("ledger") == name, 1)).alias(name)
    found = found.agg(F.count("doc_id").alias("spans"), F.countDistinct("doc_id").alias("documents"), count_of("performance"), count_of("protocol"))
    return found.withColumn("status", first_match([("insufficient", F.col("performance") == 0), ("partial", F.col("protocol") < 2)], "supported_with_limitations"))


@query("select conv_id, turn, role, coalesce(lag(role) over w, '') as before, coalesce(lead(role) over w, '') as after, (row_number() over w)::bigint as place from conversations window w as (partition by conv_id order by turn)")
def turn_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = segment.neighbours(_t(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "role")
    w = Window.partitionBy("conv_id").orderBy("turn")
    return found.select("conv_id", "turn", "role", F.array_join("before", "").alias("before"), F.array_join("after", "").alias("after"), F.row_number().over(w).cast("long").alias("place"))


@query()
def span_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document classified by the evidence cascade, with its fields."""
    found = evidence.extract(evidence.classify(dealt(_t(spark, sf_dir, "documents").select("doc_id", "text")), "text"), "text")
    return found.drop("text")


@query("""with x as (select page_id, regexp_extract(url, '://[^/]*/([a-z]+)/', 1) as lang, case when html is null then '' else html end as html from pages)
select page_id, case when lang = 'en' then 'introduction' when lang = 'de' then 'results' when lang = 'fr' then 'methods' else 'unknown' end as label from x""")
def section_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings to section labels, on headings made from the pages' languages."""
    lang = F.regexp_extract("url", r"://[^/]*/([a-z]+)/", 1)
    made = F.when(lang == "en", "## 1. Introduction").when(lang == "de", "**Results of runs**").when(lang == "fr", "IV. Experimental Section").otherwise("Thoughts")
    return _t(spark, sf_dir, "pages").select("page_id", provenance.section_label(made).alias("label"))


@query()
def span_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The provenance of every document's text."""
    return provenance.infer(dealt(_t(spark, sf_dir, "documents").select("doc_id", "text")), "text").drop("text")


#: Neutral stand-ins for families: common words of four languages, with points.
_FAMILIES = ("english", "german", "french", "spanish")
_WORDS = (("english", 4, "which"), ("english", 3, "that"), ("german", 4, "nicht"), ("german", 3, "und"), ("french", 4, "pour"), ("french", 3, "les"), ("spanish", 4, "para"), ("spanish", 3, "los"))

def _whole(word: str) -> str:
    """A whole word in Java's patterns and in SQL's alike: their \\b differ beside letters with accents."""
    return rf"(^|[^\p{{L}}\p{{N}}_]){word}($|[^\p{{L}}\p{{N}}_])"


# The bare word first: it is looked for far faster than the pattern, and most texts lack it.
_EVIDENCE = tuple(families.Evidence(f, points, word, (word, _whole(word))) for f, points, word in _WORDS)
_POINTS = ", ".join(" + ".join(f"(case when regexp_matches(x, '{_whole(w)}') then {p} else 0 end)" for g, p, w in _WORDS if g == f) + f" as {f}" for f in _FAMILIES)
_RANKED = f"""texts as (select doc_id, source, n_chars, coalesce(text, '') as x from documents), points as (select doc_id, source, n_chars, {_POINTS} from texts),
long as (unpivot points on {", ".join(_FAMILIES)} into name family value p), places as (select *, case family when 'english' then 1 when 'german' then 2 when 'french' then 3 else 4 end as o from long),
ranked as (select doc_id, any_value(source) as source, any_value(n_chars) as n_chars, max(p) as top, list(family order by p desc, o)[1] as best, list(p order by p desc, o)[2] as second, sum(p) as evidence from places group by doc_id),
decided as (select *, case when second >= 6 and top - second <= 3 then 'mixed' when top >= 4 then best else 'unclear' end as family, case when second >= 6 and top - second <= 3 then 'medium' when top >= 6 then 'high' when top >= 4 then 'medium' else 'unclear' end as confidence from ranked)"""


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dealt(_t(spark, sf_dir, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("x")))
    scores = families.family_scores([(F.col("x"), 1)], _EVIDENCE, _FAMILIES)
    scored = docs.select("doc_id", "source", scores.alias("scores"))
    return scored.withColumn("top", F.array_max(F.transform("scores", lambda s: s["points"]))).select("*", families.decide_family(F.col("scores")).alias("d")).select("doc_id", "source", "top", "d.*")


@query(f"with {_RANKED} select doc_id, top::bigint as top, family, confidence, family = 'mixed' as conflict from decided")
def family_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's family by weighted evidence: clear, likely, mixed or unclear."""
    return _decided(spark, sf_dir).select("doc_id", F.col("top").cast("long"), "family", "confidence", "conflict")


_TOTALS = f"""{_RANKED}, votes as (select source, family, sum(greatest(top, 4) + case when confidence = 'high' then 2 else 0 end) as p, count(*) as n from decided where confidence in ('high', 'medium') and family not in ('mixed', 'unclear') group by all),
lists as (select source, list(family order by p desc, case family when 'english' then 1 when 'german' then 2 when 'french' then 3 else 4 end) as fs, list(p order by p desc) as ps, sum(n) as votes from votes group by source),
consensus as (select source, votes, case when ps[1] < 6 then 'unclear' when coalesce(ps[2], 0) >= 6 and ps[1] - ps[2] <= 3 then 'mixed' else fs[1] end as consensus, case when ps[1] < 6 then 'unclear' when coalesce(ps[2], 0) >= 6 and ps[1] - ps[2] <= 3 then 'medium' when ps[1] >= 10 and ps[1] - coalesce(ps[2], 0) >= 4 then 'high' else 'medium' end as consensus_confidence from lists)"""


def _source_consensus(decided: DataFrame) -> DataFrame:
    weight = families.vote_weight(F.lit(""), F.lit(False), F.col("confidence"))
    return families.family_consensus(decided, "source", "family", "confidence", F.col("top"), weight, _FAMILIES)


@query(f"with {_TOTALS} select source, consensus, consensus_confidence, votes::bigint as votes from consensus")
def family_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The families of each source's documents, weighed against each other."""
    return _source_consensus(_decided(spark, sf_dir))


@query(f"""with {_TOTALS}, j as (select d.*, c.consensus, c.consensus_confidence, coalesce(c.consensus not in ('mixed', 'unclear'), false) as agreed from decided d left join consensus c on d.source = c.source)
select doc_id, case when agreed and family = 'unclear' and top < 4 then consensus else family end as final_family, case when agreed and family = 'unclear' and top < 4 then case when consensus_confidence = 'high' then 'medium' else 'low' end else confidence end as final_confidence,
agreed and family = 'unclear' and top < 4 as filled, agreed and family not in ('mixed', 'unclear') and family <> consensus and confidence in ('high', 'medium') as against from j""")
def family_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source's consensus fills its unclear documents and marks those that disagree."""
    # Written out, without texts: both sides of the join need it, and it takes a pass over all texts.
    decided = cut(_decided(spark, sf_dir))
    found = families.with_consensus(decided, _source_consensus(decided), "source", "family", "confidence", F.col("top") < families.LIKELY)
    return found.select("doc_id", "final_family", "final_confidence", "filled", "against")


@query("""with t as (select doc_id, lang, source, coalesce(text, '') as x from documents), g as (select doc_id, coalesce(lower(trim(lang)) = 'yes' or lang = 'en', false) as said, regexp_matches(x, '\\bthe\\b') as shown, regexp_matches(x, '\\b(not|nicht|pas) ') as denied from t)
select doc_id, (said or shown) and not denied as satisfied, case when said then 'stated' when shown and not denied then 'text' else '' end as source, said and denied as conflict from g""")
def validation_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a check is stated or shown, and not denied, by each document."""
    stated = F.when(F.col("lang") == "en", "yes").otherwise(F.col("lang"))
    found = families.gate(F.coalesce("text", F.lit("")), r"\bthe\b", r"\b(not|nicht|pas) ", stated)
    return _t(spark, sf_dir, "documents").select("doc_id", found.alias("g")).select("doc_id", "g.*")


@query("""with s as (select doc_id, coalesce(text, '') as x, lang, coalesce(n_chars, 0) as n from documents), t as (select doc_id,
least(1, (case when n % 2 = 0 then 0.35 when lang <> 'en' then 0.2 else 0 end + case when n % 3 = 0 then 0.2 else 0 end + case when n % 5 = 0 then 0.2 else 0 end + case when n % 7 = 0 then 0.15 else 0 end + case when lang is not null then 0.1 else 0 end)::double) as validation,
case when n >= 20 then greatest(0, (case lang when 'en' then 1 when 'de' then 0.75 when 'fr' then 0.5 else 0.65 end - case when length(trim(x, ' ')) < 30 then 0.15 else 0 end - case when length(trim(x, ' ')) = 0 then 0.35 else 0 end)::double) else 0 end as grounding,
least(1, (case when contains(x, 'the') then 0.2 else 0 end + case when n >= 1000 then 0.15 when n > 0 then 0.08 else 0 end + case when n > 2000 then 0.2 else 0 end)::double) as engineering,
least(0.6, (case when regexp_matches(x, '[%$&*#]{3}') then 0.4 else 0 end + case when contains(x, 'not') then 0.35 else 0 end + case when n % 2 = 1 then 0.12 else 0 end)::double) as penalty from s)
select doc_id, round(validation, 6) as validation, round(grounding, 6) as grounding, round(engineering, 6) as engineering, round(penalty, 6) as penalty from t""")
def triage_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of a triage score that come from checks, source, practical use and signs of contamination."""
    text, n, lang = F.coalesce("text", F.lit("")), F.coalesce("n_chars", F.lit(0)), F.col("lang")

    def yes(k: int):
        return F.when(n % k == 0, "yes").otherwise("no")

    isotope = F.when(n % 2 == 0, "yes").otherwise("not applicable")
    parts = {
        "validation": scoring.validation_completeness(isotope, yes(3), yes(5), yes(7), lang, ~F.coalesce(lang != "en", F.lit(False))),
        "grounding": scoring.source_grounding(text, F.create_map(*map(F.lit, ("en", "high", "de", "medium", "fr", "low")))[F.coalesce(lang, F.lit(""))], n >= 20),
        "engineering": scoring.engineering_relevance(scoring.engineering_flags({"flow_or_GDE_reactor": F.contains(text, F.lit("the")), "current_density_reported": n > 2000}, n / 100)),
        "penalty": scoring.contamination_penalty({"class": text.rlike("[%$&*#]{3}"), "reassigned": F.contains(text, F.lit("not")), "no_control": n % 2 == 1}),
    }
    return _t(spark, sf_dir, "documents").select("doc_id", *(F.round(c, 6).alias(name) for name, c in parts.items()))
