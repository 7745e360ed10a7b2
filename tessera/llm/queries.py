"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import chat, fingerprints, jaccard_join, minhash, mixing, packing, perplexity, pii, quality_rules, structure_repair, toxicity, url_reputation, whitening
from tessera.llm.shared import surrogate_key, table

RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op1_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.replace(table(spark, sf_dir, "documents").select("doc_id", "text"), surrogate_key(spark))
    return found.select("doc_id", "text", F.size("pii_entities").cast("long").alias("n_entities"), F.array_join(F.transform("pii_entities", lambda e: e["kind"]), ",").alias("kinds"))


def op2_cutting_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents")))


def op3_source_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(mixing.sized(table(spark, sf_dir, "documents")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.get("slots", F.lit(0)).alias("first_slot"))


def op4_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes are the pages' own: what their markup leaves of them is judged by the quality rules."""
    pages = table(spark, sf_dir, "pages")
    host, _ = url_reputation.host_and_path(F.col("url"))
    texts = pages.select(host.alias("host"), url_reputation.page_text(F.col("html")).alias("text"))
    labelled = quality_rules.ledger(texts, id_col="host").select("host", quality_rules.rejects("web-v1").cast("int").alias("bad"))
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    return url_reputation.judge(pages, rules, labelled)


def op5_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.groups(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_partners")


def op6_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.against_edits(table(spark, sf_dir, "documents"))


def op7_classifier_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two categories have labels: low quality, then toxic."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    marks = labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    chain = toxicity.fit(documents, marks, ("low_quality", "toxic"))
    return toxicity.judge(documents, chain)


def op8_typed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    own = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.posexplode(F.array(F.lit("user"), F.lit("assistant")))).select("conv_id", F.col("pos").cast("long").alias("turn"), F.col("col").alias("role"), F.lit(said).alias("text"))
    turns = rows.unionByName(own).select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("content"))
    done = chat.format_turns(turns).select("conv_id", "formatted", chat.read_back(F.col("formatted")).alias("turns"), chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), chat.unescape(t["body"]), F.lit("\n"))), "")
    return done.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op9_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.apply_policy(quality_rules.ledger(table(spark, sf_dir, "documents")), "web-v1")
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", quality_rules.rejects("base-v1").alias("base_failed"), "kept", "failed")


def op10_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trusted are the documents that are labelled as of good quality."""
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    found = perplexity.judge(table(spark, sf_dir, "documents"), trusted)
    return found.select("doc_id", "lang", "chars", "perplexity", "threshold", "kept")


def damaged(rows: DataFrame) -> DataFrame:
    """`rows` of conversations, of which one in 20 each are dropped, emptied, stripped of sentence ends, repeated or given to the user."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(said("text"), ".!?", "")).otherwise(said("text"))
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.where(kind != 0).select("conv_id", "turn", F.when(kind == 4, "user").otherwise(said("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def op11_tight_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    summary, _ = structure_repair.repair(damaged(rows))
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    found = rows.select(F.col("conv_id").alias("_id")).distinct().join(summary, F.col("_id").eqNullSafe(F.col("conv_id")), "left")
    return found.select(F.col("_id").alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_densified_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.groups(table(spark, sf_dir, "documents"))


def op13_tiled_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_surrogates, op2_cutting_stock, op3_source_schedule, op4_host_reputation, op5_chosen_path, op6_scaled_sketch, op7_classifier_chain, op8_typed_parts, op9_rule_ledger, op10_kneser_ney, op11_tight_arcs, op12_densified_minhash, op13_tiled_whitening)}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_OP3 = rf"""
with d as (select doc_id, source, len({_WORDS})::bigint as size, md5(concat('mix', coalesce(cast(doc_id as varchar), ''))) as key from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight from s),
o as (select *, sum(source_size) over ()::bigint as total,
        coalesce(sum(3 * source_size) over (order by (3 * source_size)::double / weight, source nulls last rows between unbounded preceding and 1 preceding), 0)::bigint as capped,
        sum(weight) over () - coalesce(sum(weight) over (order by (3 * source_size)::double / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as weights from w),
l as (select *, max((total - capped)::double / weights) over () as level from o),
t as (select source, source_size, least((3 * source_size)::double, weight * level) as target from l),
n as (select *, row_number() over (order by source nulls last) as source_id, (select greatest(1, least(1024, max(total) // 65536)) from l) as block, (select max(total) from l) as words from t),
g as (select *, sum(target) over (order by source_id rows unbounded preceding) / sum(target) over () as high from n where target > 0),
e as (select source_id, block, words, coalesce(lag(high) over (order by source_id), 0) as low, case when source_id = max(source_id) over () then 2 else high end as high from g),
c as (select unnest(range((select max(words + block - 1) // max(block) from n)::bigint)) as slot),
v as (select slot, sum(((slot >> i) & 1) * pow(2.0, -1 - i)) as point from c, (select unnest(range(48)) as i) group by slot),
q as (select slot, source_id, row_number() over (partition by source_id order by slot) - 1 as k from v join e on point >= low and point < high),
m as (select source_id, count(*) as drawn from q group by source_id),
p as (select d.*, n.source_id, n.source_size, n.target, n.block, coalesce(sum(size) over (partition by d.source order by substr(key, 1, 3), key, size rows between unbounded preceding and 1 preceding), 0)::bigint as before
      from d join n on d.source is not distinct from n.source),
f as (select doc_id, size, source_size, target, source_id, block, before,
  (greatest(0, least(round(target)::bigint, before + size) - before)
   + greatest(0, least(round(target)::bigint, source_size + before + size) - source_size - before)
   + greatest(0, least(round(target)::bigint, 2 * source_size + before + size) - 2 * source_size - before))::bigint as taken
from p)
select doc_id, size, source_size, target, taken,
  case when taken > 0 then coalesce(q.slot, (select count(*) from c) + before // block) end::bigint as first_slot
from f left join q on q.source_id = f.source_id and q.k = f.before // f.block
"""

_OP9 = rf"""
with d as (select doc_id, coalesce(text, '') as text, row_number() over () as r from documents),
w as (select *, {_WORDS} as ws from d),
x as (select r, i, ws[i] as a, ws[i + 1] as b, ws[i + 2] as c from (select r, ws, unnest(range(1, greatest(len(ws) - 1, 1))) as i from w)),
y as (select r, i, count(*) over (partition by r, a, b, c) as n from x),
z as (select r, count(distinct i + k)::bigint as n_repeat_words from y, (select unnest([0, 1, 2]) as k) where n > 1 group by r),
ln as (select r, unnest(str_split(text, chr(10))) as line from d),
lc as (select r, count(*)::bigint as n_lines, (count(*) - count(distinct line))::bigint as n_dup_lines from ln where regexp_matches(line, '[^\x20\x09-\x0D]') group by r),
m as (select doc_id, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
        coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(n_lines, 0) as n_lines,
        length(regexp_replace(text, '[^A-Z]', '', 'g')) as n_upper, length(regexp_replace(text, '[^a-z]', '', 'g')) as n_lower
      from w left join z using (r) left join lc using (r)),
f as (select *, (case when n_words < 50 then 1 else 0 end + case when 100 * n_repeat_words > 50 * n_words then 2 else 0 end + case when 10 * n_symbols > 3 * n_words then 4 else 0 end
        + case when n_lines >= 4 and 2 * n_dup_lines > n_lines then 8 else 0 end + case when word_chars > 25 * n_words then 16 else 0 end
        + case when word_chars < 2 * n_words then 32 else 0 end + case when n_upper > n_lower and n_upper >= 20 then 64 else 0 end)::bigint as failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed, failed = 0 as kept, failed from f
"""

_SAID = "</s>[INST] ok [/INST]"
_CONTROLS = "".join(f", '{c}', '{c[0]}\\{c[1:]}')" for c in chat.CONTROLS)
_ESCAPED = "replace(" * len(chat.CONTROLS) + r"replace(text, '\', '\\')" + _CONTROLS
_OP8 = rf"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           union all select -1, 0, 'user', '{_SAID}' union all select -1, 1, 'assistant', '{_SAID}'),
e as (select *, {_ESCAPED} as escaped from c),
g as (select conv_id, count(*)::bigint as n_turns, string_agg(concat(role, chr(10), text, chr(10)), '' order by turn, role, escaped) as told,
        coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role, escaped), '') as loss,
        sum(length(escaped) + length(role) + {len(chat.BEGIN + chat.MIDDLE + chat.END)})::bigint as formatted_chars from e group by conv_id)
select conv_id, n_turns, sha256(told) as turns_sha256, length(loss)::bigint as loss_chars, sha256(loss) as loss_sha256, formatted_chars from g
"""

_OP12 = r"""
with recursive d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select distinct r, case when len(ws) > 1 then ws[i] || ' ' || ws[i + 1] else ws[i] end as shingle
      from (select r, ws, unnest(range(1, greatest(len(ws), 2))) as i from d where len(ws) > 0)),
n as (select r, count(*) as n from s group by r),
c as (select a.r as r, b.r as q, count(*) as common from s a join s b on a.shingle = b.shingle and a.r < b.r group by all),
l as (select c.r, c.q from c join n x on x.r = c.r join n y on y.r = c.q where 100 * common >= 80 * (x.n + y.n - common)),
e as (select r, q from l union all select q, r from l),
m as (select r, r as q from d union select m.r, e.q from m join e on e.r = m.q),
k as (select m.r, min(d.doc_id) as component_id from m join d on d.r = m.q group by m.r)
select doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, doc_id is not distinct from component_id as kept from d join k using (r) left join n using (r)
"""

_TRIM = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
# From the last row to the first, the cheapest edits from each state on, and of these the first by their letters.
_OP11 = f"""
with recursive table_crc as (select list(list_reduce(range(8), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)), i) order by i) as t from (select unnest(range(256)) as i)),
k as (select *, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key, coalesce(role, ' ') as r0, coalesce(text, ' ') as t0 from conversations),
c as (select *, xor(list_reduce(list_transform(range(1, length(key) + 1), lambda i: ascii(key[i])::bigint), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 20 as kind from k, table_crc),
g as (select conv_id, turn, case when kind = 4 then 'user' else r0 end as role, case kind when 1 then '' when 2 then translate(t0, '.!?', '') else t0 end as text, unnest(range(case when kind = 3 then 2 else 1 end)) from c where kind != 0),
o as (select conv_id, turn, role, text, row_number() over (partition by conv_id order by turn nulls first, role, text) as i, count(*) over (partition by conv_id) as n, row_number() over () as id from g),
f as (select *, rtrim(text, {_TRIM}) as bare, row_number() over (partition by conv_id, role, text order by i) > 1 as seen, left(role, 1) as initial, lag(left(role, 1)) over (partition by conv_id order by i) as last_initial from o),
h as (select *, case when bare = '' then 'blank' when seen then 'duplicate' when right(bare, 1) not in ('.', '!', '?') then 'truncated' end as fault from f),
z as (select conv_id, max(n) as n from h group by conv_id),
v as (select conv_id, n as i, {{'c': 0, 's': ''}} as v0, {{'c': 4, 's': 'II'}} as v1, {{'c': 2, 's': 'I'}} as v2, {{'c': 0, 's': ''}} as v3 from z
      union all
      select conv_id, i, least(w0, {{'c': w2.c + 2, 's': 'I' || w2.s}}, {{'c': w3.c + 4, 's': 'II' || w3.s}}), least(w1, {{'c': w2.c + 2, 's': 'I' || w2.s}}, {{'c': w3.c + 4, 's': 'II' || w3.s}}),
        least(w2, {{'c': w3.c + 2, 's': 'I' || w3.s}}), least(w3, {{'c': w2.c + 2, 's': 'I' || w2.s}})
      from (select v.conv_id, v.i - 1 as i,
              least({{'c': v0.c + 3, 's': 'D' || v0.s}}, {{'c': case when stays and initial in ('s', 'u') then case initial when 's' then v1.c else v2.c end + late else 99999999 end, 's': 'K' || case initial when 's' then v1.s else v2.s end}}, {{'c': case when stays then v2.c + 2 + late else 99999999 end, 's': 'R' || v2.s}}) as w0,
              least({{'c': v1.c + 3, 's': 'D' || v1.s}}, {{'c': case when stays and initial = 'u' then v2.c + late else 99999999 end, 's': 'K' || v2.s}}, {{'c': case when stays then v2.c + 2 + late else 99999999 end, 's': 'R' || v2.s}}) as w1,
              least({{'c': v2.c + 3, 's': 'D' || v2.s}}, {{'c': case when stays and initial = 'a' then v3.c + late else 99999999 end, 's': 'K' || v3.s}}, {{'c': case when stays then v3.c + 2 + late else 99999999 end, 's': 'R' || v3.s}}) as w2,
              least({{'c': v3.c + 3, 's': 'D' || v3.s}}, {{'c': case when stays and initial = 'u' then v2.c + late else 99999999 end, 's': 'K' || v2.s}}, {{'c': case when stays then v2.c + 2 + late else 99999999 end, 's': 'R' || v2.s}}) as w3
            from v join (select *, coalesce(fault, '') not in ('blank', 'duplicate') as stays, case when fault = 'truncated' then 1 else 0 end as late from h) h
              on v.conv_id is not distinct from h.conv_id and v.i = h.i)),
b as (select conv_id, v0.c::bigint as cost, v0.s as audit from v where i = 0),
e as (select conv_id, audit, p, audit[p] as edit, length(replace(audit[:p], 'I', '')) as i, length(replace(audit[:p], 'D', '')) as k from (select *, unnest(range(1, length(audit) + 1)) as p from b)),
x as (select e.*, h.role, h.text, h.initial, bool_or(e.k = 1 and e.edit = 'K' and h.initial = 's') over (partition by e.conv_id) as has_system from e left join h on e.conv_id is not distinct from h.conv_id and e.i = h.i),
y as (select conv_id, string_agg(case when edit = 'K' then role when (k % 2 = 1) = has_system then 'assistant' else 'user' end || ':' || case when edit = 'I' then '' else text end, chr(10) order by p) as told from x where edit != 'D' group by conv_id),
s as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
        count(*) filter (i > 1 and last_initial || initial not in ('su', 'ua', 'au')) as illegal from h group by conv_id)
select a.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal,
  coalesce(cost, 0)::bigint as cost, coalesce(audit, '') as audit, sha256(coalesce(told, '')) as repaired_sha256
from (select distinct conv_id from conversations) a left join s on a.conv_id is not distinct from s.conv_id left join b on a.conv_id is not distinct from b.conv_id left join y on a.conv_id is not distinct from y.conv_id
"""

ORACLES = {"op3_source_schedule": _OP3, "op9_rule_ledger": _OP9, "op8_typed_parts": _OP8, "op11_tight_arcs": _OP11, "op12_densified_minhash": _OP12}
