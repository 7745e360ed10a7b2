"""The library's operators on claims and their sources, applied to whole tables, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import candidates, coordinates, freeze, hierarchy, identity, linking, outline, packets, review, rights, sampling, segment
from tessera.operators.rights import Check, Lexicon, Shows
from tessera.plans.registry import query
from tessera.sources.files import dealt


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _choice(number: Column, *values: str | None) -> Column:
    """The value at the place that the number, modulo their count, names."""
    return F.get(F.array(*map(F.lit, values)), F.pmod(number, F.lit(len(values))).cast("int"))


#: Runs of letters that the tables' prose has, in place of a domain's words.
STAND_IN = Lexicon(
    checks={"isotope_15N": Check(("note",), ("that",), denied="thor"), "blank_control": Check((), ("eren",)), "nox_control": Check((), ("tion",)), "contamination_control": Check((), ("dble",)), "quantification_method": Check((), ("ring",))},
    levels={
        "product_admissibility": {"ammonia_quantification": Shows(check="quantification_method"), "isotope_15N": Shows(check="isotope_15N"), "blank_control": Shows(check="blank_control"), "nox_control": Shows(check="nox_control"), "contamination_control": Shows(check="contamination_control")},
        "cell_metric": {"faradaic_efficiency": Shows(("thhe",)), "nh3_yield": Shows(("erer", "hest")), "current_density": Shows(pattern="onou|onor"), "potential_or_voltage": Shows(("thea",)), "charge_or_runtime": Shows(("enen",)), "electrode_area": Shows(("heti",), numbers=("note",))},
        "reactor_legibility": {"reactor_type": Shows(("anon",), values=("reactor_type",)), "flow_rate": Shows(("tble",)), "active_area": Shows(("hati",)), "GDE_or_SSC": Shows(("iont",)), "HOR_or_anode_reaction": Shows(("reth",)), "runtime_or_stability": Shows(("ntti",)), "outlet_product_state": Shows(("annd",)), "wetting_or_failure_disclosure": Shows(("reor",))},
        "process_partial": {"gas_liquid_product_split": Shows(("onst",)), "capture_route": Shows(("erth",)), "solvent_inventory": Shows(("oner",)), "electrolyte_replacement_or_recycle": Shows(("ndbl",)), "hydrogen_source_boundary": Shows(("thsh",)), "auxiliary_loads": Shows(("enan",)), "voltage_basis": Shows(("thti",)), "first_failure_signal": Shows(("inly",))},
    },
    topics={"hydrogen": Shows(("eron",)), "flow": Shows(("heou",)), "gas_phase": Shows(("blein",)), "plant": Shows(("edat",)), "source": Shows(("orth",)), "own_table": Shows(("leti",)), "others_table": Shows(("nter",))},
    given=rights.DOMAIN.given,
    dinitrogen=rights.DOMAIN.dinitrogen,
    hints={"product_admissibility": Shows(("atio",)), "cell_metric": Shows(("blet",)), "reactor_legibility": Shows(("rely",)), "process_partial": Shows(("edan",))},
    controls=rights.DOMAIN.controls,
)


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records: class, provenance, family and stated values go by id and language."""
    k = F.col("doc_id")
    family = F.when(F.col("lang") == "en", F.when(k % 5 == 0, "unclear").when(k % 5 == 1, "other").otherwise("eNRR")).when(F.col("lang") == "de", "NO3RR").when(F.col("lang") == "fr", "NORR").when(F.col("lang") == "es", "mixed")
    return dealt(_t(spark, sf_dir, "documents")).select(
        "doc_id", "source", F.col("text").alias("source_text"), family.alias("reaction_family"),
        _choice(k, *["primary_performance_with_validation"] * 4, *["primary_performance"] * 2, "reference_list", "review_table", "protocol_guideline", "contamination_detection_evidence", "computational_screening").alias("text_class"),
        _choice(F.floor(k / 11), *["body"] * 5, "results", "table", "Table ", "figure_caption", "reference", "review_table", "supplementary", "Front Matter").alias("provenance_type"),
        _choice(k, "yes", None, "not reported", "12").alias("note"), _choice(k, None, "unknown", "Flow cell").alias("reactor_type"), _choice(F.floor(k / 2), "yes", "no").alias("paired_body_evidence"),
    )


_CLAIMS = r"""with d as (select doc_id, source, coalesce(lower(trim(regexp_replace(replace(text, chr(160), ' '), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ')), '') as t,
  case lang when 'en' then case doc_id % 5 when 0 then 'unclear' when 1 then 'unclear' else 'eNRR' end when 'de' then 'NO3RR' when 'fr' then 'NORR' when 'es' then 'mixed' else 'unclear' end as fam,
  ['primary_performance_with_validation', 'primary_performance_with_validation', 'primary_performance_with_validation', 'primary_performance_with_validation', 'primary_performance', 'primary_performance', 'reference_list', 'review_table', 'protocol_guideline', 'contamination_detection_evidence', 'computational_screening'][doc_id % 11 + 1] as cls,
  ['body', 'body', 'body', 'body', 'body', 'results', 'table', 'table', 'figure_caption', 'reference', 'review_table', 'supplementary', 'front_matter'][doc_id // 11 % 13 + 1] as prov,
  [true, null, false, null][doc_id % 4 + 1] as note_yes, doc_id % 4 = 3 as note_number, doc_id % 3 = 2 as flow_cell, doc_id // 2 % 2 = 0 as paired from documents),
g as (select *, case when coalesce(note_yes, false) or note_number or contains(t, 'that') then 'yes' when coalesce(not note_yes, false) or contains(t, 'thor') then 'no' else 'missing' end as iso, contains(t, 'eren') as blank, contains(t, 'tion') as nox, contains(t, 'dble') as cont, contains(t, 'ring') as quant from d),
f as (select *, iso = 'yes' as i15, contains(t, 'thhe') as fe, contains(t, 'erer') or contains(t, 'hest') as yield, regexp_matches(t, 'onou|onor') as cur, contains(t, 'thea') as pot, contains(t, 'enen') as chg, contains(t, 'heti') or note_number as area,
  contains(t, 'anon') or flow_cell as rt, contains(t, 'tble') as fr, contains(t, 'hati') as aa, contains(t, 'iont') as gde, contains(t, 'reth') as hor, contains(t, 'ntti') as run, contains(t, 'annd') as outl, contains(t, 'reor') as wet,
  contains(t, 'onst') as split, contains(t, 'erth') as cap, contains(t, 'oner') as solv, contains(t, 'ndbl') as rec, contains(t, 'thsh') as hs, contains(t, 'enan') as aux, contains(t, 'thti') as vb, contains(t, 'inly') as ffs,
  contains(t, 'eron') as is_h, contains(t, 'heou') or flow_cell as is_flow, contains(t, 'blein') as is_gas, contains(t, 'edat') as is_plant, contains(t, 'leti') as own_t, contains(t, 'nter') as other_t from g),
m as (select *, [x for x in [case when not quant then 'ammonia_quantification' end, case when not i15 then 'isotope_15N' end, case when not blank then 'blank_control' end, case when not nox then 'nox_control' end, case when not cont then 'contamination_control' end] if x is not null] as m1,
  [x for x in [case when not fe then 'faradaic_efficiency' end, case when not yield then 'nh3_yield' end, case when not cur then 'current_density' end, case when not pot then 'potential_or_voltage' end, case when not chg then 'charge_or_runtime' end, case when not area then 'electrode_area' end] if x is not null] as m2,
  [x for x in [case when not rt then 'reactor_type' end, case when not fr then 'flow_rate' end, case when not aa then 'active_area' end, case when not gde then 'GDE_or_SSC' end, case when not hor then 'HOR_or_anode_reaction' end, case when not run then 'runtime_or_stability' end, case when not outl then 'outlet_product_state' end, case when not wet then 'wetting_or_failure_disclosure' end] if x is not null] as m3,
  [x for x in [case when not split then 'gas_liquid_product_split' end, case when not cap then 'capture_route' end, case when not solv then 'solvent_inventory' end, case when not rec then 'electrolyte_replacement_or_recycle' end, case when not hs then 'hydrogen_source_boundary' end, case when not aux then 'auxiliary_loads' end, case when not vb then 'voltage_basis' end, case when not ffs then 'first_failure_signal' end] if x is not null] as m4,
  fam in ('NO3RR', 'NORR') as given, fam in ('mixed', 'unclear') as unsure from f),
s as (select *, len(m2) < 6 as metric, len(m4) < 8 as proc, case when given then blank and cont and quant when unsure then false else i15 and blank and (nox or cont) end as settled, fam = 'eNRR' and not i15 as l1, fe and not (yield and chg and pot) as l2, is_h and not hs as l3,
  is_flow and not (outl and wet) as l4, is_gas and not cap as l5, is_plant and not (split and cap and solv and hs and vb) as l6, rt and (fr or gde or hor) and outl and (rt::int + fr::int + gde::int + hor::int + run::int + outl::int + wet::int) >= 4 as reactor, cls = 'primary_performance_with_validation' as validated from m),
r as (select *, least(greatest(case when len(m1) < 5 then 1 else 0 end, case when metric then 2 else 0 end, case when validated and reactor and metric and settled then 3 else 0 end, case when validated and split and cap and solv and hs and vb and fe and yield and (pot or cur) and settled then 4 else 0 end), case when l3 or l4 or l5 then 3 else 5 end) as capped,
  len(regexp_extract_all(t, '\b(?:19|20)\d{2}\b|\bet al\.?')) as years from s),
b as (select *, case when t = '' then 0 when l6 and (capped >= 3 or proc) then 5 else capped end as reached, cls != 'review_table' and not other_t and not (contains(t, 'reference') and years >= 3) and (own_t or (metric and years < 3)) as own_table,
  case when metric then 2 else 1 end as table_rank, [x for x in [case when l1 then '15N2 isotope validation' end] if x is not null] || case fam when 'NO3RR' then ['nitrate/nitrite source accounting', 'nitrogen mass balance'] when 'NORR' then ['NO source purity', 'NOx balance', 'gas handling blank'] when 'mixed' then ['clarify nitrogen source', 'nitrogen-source accounting'] when 'unclear' then ['clarify nitrogen source'] else [] end
  || [x for x in [case when not blank then 'Ar/N2-free blank' end, case when not nox then 'NOx/nitrate/nitrite screening' end, case when not cont then 'contamination-source accounting' end, case when is_h then 'H2-off/HOR-off control' end, case when is_flow then 'gas/liquid product accounting and wetting/flooding diagnosis' end, case when fe and not yield then 'NH3 yield paired with FE' end] if x is not null] as ctl,
  case fam when 'NO3RR' then ['nitrogen_balance'] when 'NORR' then ['NOx_balance'] when 'eNRR' then [] else ['nitrogen_source_disambiguation'] end as owed,
  [x for x in [case when (cls like 'primary%' and prov in ('reference', 'front_matter', 'review_table', 'figure_caption')) or (cls in ('reference_list', 'review_table') and prov in ('body', 'results')) then 'text_class_provenance_conflict' end] if x is not null] as conflict from r),
n as (select *, conflict || case when prov = 'supplementary' then ['supplementary_requires_crosscheck'] else [] end as sup, [x for x in [case when not nox then 'NOx/nitrate/nitrite screening' end, case when not cont then 'contamination-source accounting' end, case when not blank then 'Ar/N2-free blank' end] if x is not null] as neg,
  case when prov in ('reference', 'front_matter') then 'provenance that is not trusted' when prov = 'review_table' then 'table of a review' when prov = 'table' and own_table then 'table of own results' when prov = 'table' then 'table of others' when prov = 'figure_caption' and not paired then 'caption alone' when cls = 'reference_list' then 'list of references' when cls = 'review_table' then 'review table'
    when cls = 'protocol_guideline' then 'protocol' when cls like 'contamination%' then 'evidence of contamination' when cls = 'computational_screening' then 'computation' else 'primary' end as reason from b),
v as (select *, case reason when 'table of own results' then table_rank when 'protocol' then 1 when 'evidence of contamination' then 1 when 'primary' then reached else 0 end as k from n),
w as (select *, case when reason in ('table of own results', 'primary') then case when k = 0 then m1 else m1 || case when k >= 2 then m2 else [] end || case when k >= 3 then m3 else [] end || case when k >= 4 then m4 else [] end || case when is_plant or proc then m4 else [] end end
    when reason = 'protocol' then m1 when reason = 'evidence of contamination' then neg when reason in ('provenance that is not trusted', 'table of others') then ['primary body text'] when reason = 'table of a review' then ['primary body text', 'source-specific validation evidence'] when reason = 'caption alone' then ['primary body text pairing']
    when reason = 'list of references' then ['all primary boundary fields require source text outside the reference list'] when reason = 'review table' then ['primary source span', 'source-specific validation evidence'] else ['experimental NH3 quantification', 'validation controls'] end || owed as missing,
  case reason when 'provenance that is not trusted' then conflict || ['low_trust_provenance'] when 'table of a review' then conflict || ['review_table_not_primary'] when 'table of own results' then conflict || ['table_requires_primary_body_pairing'] when 'table of others' then conflict || ['table_not_primary_body_text'] when 'caption alone' then conflict || ['caption_not_primary_evidence', 'pair_with_primary_body_text_required']
    when 'review table' then sup || ['secondary_source_overclaim'] when 'evidence of contamination' then ['negative_evidence_blocks_positive_claim'] when 'primary' then sup || [x for x in [case when l1 then 'n2_claim_without_15n' end, case when l2 then 'fe_without_complete_measurement_matrix' end, case when l3 then 'hor_claim_missing_hydrogen_source' end, case when l4 then 'flow_claim_missing_outlet_or_wetting' end, case when l5 then 'gas_phase_nh3_without_capture_route' end, case when l6 then 'plant_facing_without_process_closure' end, case when t = '' then 'weak_source_grounding' end] if x is not null] else sup end as flags,
  case when reason in ('provenance that is not trusted', 'list of references') then [] when reason in ('table of a review', 'review table') then ['pair_with_primary_body_text'] when reason in ('table of own results', 'table of others') then ctl || ['pair_with_primary_body_text'] when reason = 'caption alone' then ctl || ['primary body text pairing', 'pair_with_primary_body_text'] when reason = 'evidence of contamination' then ctl || [x for x in neg if not list_contains(ctl, x)] else ctl end as controls from v)
select doc_id, source, reason, k::int as boundary_rank, ['unsupported_or_secondary', 'product_admissibility', 'cell_metric', 'reactor_legibility', 'process_partial', 'plant_facing_insufficient'][k + 1] as maximum_supported_boundary,
  case reason when 'provenance that is not trusted' then 'reject_or_low_trust_provenance' when 'table of a review' then 'secondary_only' when 'table of own results' then 'table_metric_only_requires_body_pairing' when 'table of others' then 'secondary_only' when 'caption alone' then 'context_only_caption' when 'list of references' then 'reject' when 'review table' then 'secondary_only' when 'protocol' then 'protocol_only' when 'evidence of contamination' then 'negative_evidence'
    when 'computation' then 'computational_only' else case when t = '' then 'weak_grounding' when k = 2 and not (settled and not l2) then 'metric_only_or_validation_incomplete' else ['insufficient_primary_support', 'product_admissible', 'cell_metric_admissible', 'reactor_legible', 'process_partial', 'plant_facing_incomplete'][k + 1] end end as admissibility_status,
  case when reason in ('provenance that is not trusted', 'list of references', 'computation') then 'unsupported_claim' when reason in ('table of a review', 'table of others', 'review table') then 'secondary_summary_claim' when reason = 'table of own results' then 'performance_claim' when reason = 'caption alone' then case cls when 'protocol_guideline' then 'protocol_claim' when 'contamination_detection_evidence' then 'negative_evidence_claim' when 'review_table' then 'secondary_summary_claim' else 'unsupported_claim' end
    when reason = 'protocol' then 'protocol_claim' when reason = 'evidence of contamination' then 'negative_evidence_claim' when is_plant or proc then 'process_claim' when is_flow or is_h or len(m3) < 8 then 'reactor_claim' when len(m1) < 5 and not metric then 'validation_claim' else 'performance_claim' end as claim_type,
  case when reason = 'caption alone' then case when contains(t, 'edan') then 'process_partial' when contains(t, 'rely') then 'reactor_legibility' when contains(t, 'blet') then 'cell_metric' when contains(t, 'atio') then 'product_admissibility' else 'unsupported_or_secondary' end else 'unsupported_or_secondary' end as support_hint_boundary,
  array_to_string(list_distinct_in_order(missing), ' ') as missing, array_to_string(flags, ' ') as flags, array_to_string(controls, '; ') as controls, iso as isotope_state from w"""
# DuckDB's list_distinct keeps no order: an element stays where it comes first.
_CLAIMS = _CLAIMS.replace("list_distinct_in_order(missing)", "[x for x, i in missing if list_position(missing, x) = i]")


@query(_CLAIMS)
def claim_rights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document may claim at most, by which case, and what it lacks for more."""
    found = rights.adjudicate(_claims(spark, sf_dir), STAND_IN)
    lists = [F.array_join(c, s).alias(n) for n, c, s in (("missing", "missing_boundary_fields", " "), ("flags", "overclaim_risk_flags", " "), ("controls", "required_controls", "; "))]
    # Where a case does not look at the record's own checks, they are still told here, from the facts.
    state = rights.check_state(found, F.lower(F.coalesce("source_text", F.lit(""))), STAND_IN.checks["isotope_15N"])
    return found.select("doc_id", "source", "reason", "boundary_rank", "maximum_supported_boundary", "admissibility_status", "claim_type", "support_hint_boundary", *lists, state.alias("isotope_state"))


@query(f"""with c as ({_CLAIMS}), r as (select source, boundary_rank, maximum_supported_boundary, count(*) as n from c group by all)
select source, arg_max(maximum_supported_boundary, boundary_rank) as maximum_supported_boundary, arg_max(n, boundary_rank) as n from r group by source""")
def best_supported_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest boundary of each source's documents, and how many of them reach it."""
    found = rights.adjudicate(_claims(spark, sf_dir), STAND_IN)
    return rights.best_supported(found, ["source"], "maximum_supported_boundary")


_PLACES = r"""d as (select doc_id, text, regexp_extract_all(text, '[^\s\x0B\x{A0}]+') as ws, regexp_extract_all(text, '[\s\x0B\x{A0}]*[^\s\x0B\x{A0}]+') as ps from documents where text is not null),
un as (select doc_id, unnest(range(1, len(ws) + 1)) as i, unnest(ws) as w, unnest(ps) as p from d),
tok as (select doc_id, i, w, lead(w) over o as w2, lead(w, 2) over o as w3, sum(length(p)) over (o rows between unbounded preceding and current row)::bigint as upto from un window o as (partition by doc_id order by i)),
ln as (select doc_id, unnest(range(1, len(ls) + 1)) as line_no, unnest(ls) as line from (select doc_id, str_split(text, chr(10)) as ls from d)),
bl as (select *, regexp_full_match(line, '[\s\x0B]*') as blank from ln),
pa as (select doc_id, line_no, line, blank, sum(case when not blank and (before is null or before) then 1 else 0 end) over (partition by doc_id order by line_no)::int as paragraph_no from (select *, lag(blank) over (partition by doc_id order by line_no) as before from bl)),
sp as (select *, regexp_extract_all(line, '[^\s\x0B\x{A0}]+') as w from pa where regexp_matches(line, '[^\s\x0B\x{A0}]')),
di as (select distinct doc_id, w from sp),
may as (select di.doc_id, di.w, tok.i, tok.upto - length(tok.w) as start from di join tok on tok.doc_id = di.doc_id and tok.w = di.w[1] where (len(di.w) < 2 or tok.w2 = di.w[2]) and (len(di.w) < 3 or tok.w3 = di.w[3])),
ats as (select may.*, e.upto as "end" from may join tok e on e.doc_id = may.doc_id and e.i = may.i + len(may.w) - 1 join d on d.doc_id = may.doc_id where regexp_extract_all(substr(d.text, may.start + 1, e.upto - may.start), '[^\s\x0B\x{A0}]+') = may.w),
pl as (select doc_id, w, count(*) as n, min(start) as start, min("end") as "end" from ats group by 1, 2)"""


@query(f"""with {_PLACES} select sp.doc_id, sp.line_no, case when n = 1 then 'document_exact' else 'unresolved' end as mapping_method, case when n > 1 then 'multiple_exact_matches' else '' end as warnings, n::bigint as candidates,
case when n = 1 then start end::bigint as verified_start, case when n = 1 then "end" end::bigint as verified_end, case when n = 1 then paragraph_no end as paragraph_no from sp join pl on sp.doc_id = pl.doc_id and sp.w = pl.w""")
def span_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line with words, looked for in its document, and the paragraph in which it stands."""
    docs = dealt(_t(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = segment.lines(docs).where(F.size(coordinates.words(F.col("line"))) > 0)
    found = coordinates.locate(spans.select("doc_id", "line_no", "line"), docs, "doc_id", "line")
    found = found.select("doc_id", "line_no", "mapping_method", F.array_join("mapping_warnings", " ").alias("warnings"), F.size("candidates").cast("long").alias("candidates"), "verified_start", "verified_end")
    return coordinates.within(found, coordinates.paragraphs(docs, "doc_id"), "doc_id", "verified_start", ["paragraph_no"])


_MARKS = (("A-F", "#"), ("G-L", "##"), ("M-R", "###"), ("S-V", "####"))
_MARKED_TEXT = "text"
for _letters, _mark in _MARKS:
    _MARKED_TEXT = rf"regexp_replace({_MARKED_TEXT}, '(^|\n)([{_letters}])', '\1{_mark} \2', 'g')"


@query(rf"""with recursive d as (select doc_id, {_MARKED_TEXT} as t from documents where text is not null),
l as (select doc_id, i, ls[i] as line, coalesce(ls[i + 1], '') as next, coalesce(sum(length(ls[i]) + 1) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0)::bigint as start from (select doc_id, ls, unnest(range(1, len(ls) + 1)) as i from (select doc_id, str_split(t, chr(10)) as ls from d))),
p as (select *, regexp_extract(rtrim(line, chr(13)), '^\s{{0,3}}(#{{1,6}})\s+(.+?)\s*#*\s*$', 1) as marks, regexp_extract(rtrim(line, chr(13)), '^\s{{0,3}}(#{{1,6}})\s+(.+?)\s*#*\s*$', 2) as said, regexp_replace(line, '^[\s\x0B]+|[\s\x0B]+$', '', 'g') as bare from l),
q as (select *, case when marks != '' then said else bare end as heading, marks != '' or (bare != '' and length(bare) <= 140 and not contains(bare, '|') and bare[1] not in ('>', '-', '*', '+') and len(regexp_split_to_array(bare, '[\s\x0B]+')) <= 12) as may from p),
k as (select *, ['results', 'unknown', 'unknown', 'abstract', 'methods'][length(str_split(heading, ' ')[1]) % 5 + 1] as kind from q where may),
h0 as (select doc_id, start, heading, kind, case when marks != '' then 'marked' when regexp_matches(next, '^[\s\x0B]*(=+|-+)[\s\x0B]*$') then 'underlined' else 'plain' end as form, case when marks != '' then length(marks) when regexp_matches(next, '^[\s\x0B]*=+[\s\x0B]*$') then 1 else 2 end::int as level from k where marks != '' or (kind != 'unknown' and not ends_with(bare, '.'))),
h1 as (select *, row_number() over (partition by doc_id order by start) as no from h0),
h2 as (select doc_id, start, heading, form, level, case when no = 1 and level = 1 and kind = 'unknown' then 'title' else kind end as kind, lead(start) over (partition by doc_id order by start) as next_start from h1),
lasts as (select *, max(start) filter (level = 1) over w as l1, max(start) filter (level = 2) over w as l2, max(start) filter (level = 3) over w as l3, max(start) filter (level = 4) over w as l4, max(start) filter (level = 5) over w as l5 from h2 window w as (partition by doc_id order by start rows between unbounded preceding and 1 preceding)),
h3 as (select * exclude (l1, l2, l3, l4, l5), nullif(greatest(case when level > 1 then coalesce(l1, -1) else -1 end, case when level > 2 then coalesce(l2, -1) else -1 end, case when level > 3 then coalesce(l3, -1) else -1 end, case when level > 4 then coalesce(l4, -1) else -1 end, case when level > 5 then coalesce(l5, -1) else -1 end), -1) as parent from lasts),
h4 as (select *, row_number() over (partition by doc_id, parent order by start) as place from h3),
r as (select doc_id, start, heading, form, level, kind, next_start, parent, place::varchar as outline, kind as type, 0 as distance, false as broken from h4 where parent is null
      union all select h.doc_id, h.start, h.heading, h.form, h.level, h.kind, h.next_start, h.parent, r.outline || '.' || h.place, case when h.kind = 'unknown' and h.level = r.level + 1 and r.type not in ('title', 'abstract') then r.type else h.kind end,
        case when h.kind = 'unknown' and h.level = r.level + 1 and r.type not in ('title', 'abstract', 'unknown') then r.distance + 1 else 0 end, h.kind = 'unknown' and h.level != r.level + 1 from h4 h join r on h.doc_id = r.doc_id and h.parent = r.start),
a as (select doc_id, start, coalesce(next_start, (select length(t) from d where d.doc_id = r.doc_id)) as "end", level, form, outline, parent, kind, type, distance, broken from r
      union all select doc_id, 0, coalesce(first, length(t)), 0, null, '', null, 'unknown', 'unknown', 0, false from d left join (select doc_id, min(start) as first from h2 group by 1) using (doc_id) where first is null or first > 0)
select doc_id, row_number() over (partition by doc_id order by start)::int as section_no, start, "end"::bigint as "end", level, form, outline, parent as parent_start, kind as direct_type, type, case when kind = 'unknown' and type != 'unknown' then distance end::int as distance, broken from a""")
def section_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of documents whose lines are marked as headings by their first letters; short lines are headings by themselves."""

    def marked(line: Column) -> Column:
        mark = F.lit("")
        for letters, own in _MARKS:
            mark = F.when(F.left(line, F.lit(1)).between(*letters.split("-")), f"{own} ").otherwise(mark)
        return F.concat(mark, line)

    docs = dealt(_t(spark, sf_dir, "documents")).select("doc_id", F.array_join(F.transform(F.split("text", "\n", -1), marked), "\n").alias("text"))
    found = outline.sections(docs, "doc_id", label=lambda h: _choice(F.length(F.substring_index(h, " ", 1)), "results", "unknown", "unknown", "abstract", "methods"))
    return found.select("doc_id", "section_no", "start", "end", "level", "form", F.array_join("outline", ".").alias("outline"), "parent_start", "direct_type", "type", "distance", "broken")


#: Runs of letters in place of a domain's triggers, strongest first.
TRIGGERS = (("first", "thhe|nicht"), ("second", "onou"), ("third", "[0-9]{2}"))


@query(r"""with d as (select doc_id, text, regexp_extract_all(text, '[^.!?\n]+[.!?]*|[.!?\n]+') as ps from documents where regexp_matches(text, '[^\s\x0B]')),
e as (select doc_id, text, list_transform(ps, lambda p, i: {'at': length(p)::bigint, 'st': case when regexp_matches(p, '^[^.!?\n]') and (regexp_matches(p, '[.!?]$') or i = len(ps)) then 1 else 0 end::bigint, 'en': 0::bigint, 'done': []::struct(a bigint, b bigint)[]}) as es from d),
f as (select doc_id, text, list_reduce(es, lambda a, x: {'at': a.at + x.at, 'st': case when x.st = 0 then a.st when a.st < 0 or (a.at + x.at - a.st > 600 and a.en > a.st) then a.at else a.st end, 'en': case when x.st = 0 then a.en else a.at + x.at end,
  'done': case when x.st = 1 and a.st >= 0 and a.at + x.at - a.st > 600 and a.en > a.st then list_append(a.done, {'a': a.st, 'b': a.en}) else a.done end}, {'at': 0::bigint, 'st': -1::bigint, 'en': -1::bigint, 'done': []::struct(a bigint, b bigint)[]}) as r from e),
w as (select doc_id, text, unnest(case when length(text) <= 600 then [{'a': 0::bigint, 'b': length(text)::bigint}] when r.st >= 0 then list_append(r.done, {'a': r.st, 'b': r.en}) else list_transform(range((length(text) - 1) // 600 + 1), lambda k: {'a': k * 600, 'b': least(length(text), (k + 1) * 600)::bigint}) end) as w, length(text) <= 600 as whole, r.st >= 0 as sentences from f),
t as (select doc_id, w.a as candidate_start, w.b as candidate_end, substr(text, w.a + 1, w.b - w.a) as said, case when whole then 'whole_source_node' when sentences then 'bounded_sentence_window' else 'bounded_character_window' end as generation_method from w),
k as (select *, regexp_matches(said, 'thhe|nicht', 'i') as k1, regexp_matches(said, 'onou', 'i') as k2, regexp_matches(said, '[0-9]{2}', 'i') as k3 from t)
select doc_id, candidate_start, candidate_end, generation_method, md5(said) as digest, case when k1 then 'first' when k2 then 'second' else 'third' end as candidate_kind, case when k1 then 1 when k2 then 2 else 3 end as candidate_priority, concat_ws(' ', case when k1 then 'first' end, case when k2 then 'second' end, case when k3 then 'third' end) as trigger_signals,
round((0.35 + 0.1 * (k1::int + k2::int + k3::int))::double, 3) as candidate_score from k where k1 or k2 or k3""")
def candidate_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of whole sentences with a trigger, of whole texts."""
    nodes = dealt(_t(spark, sf_dir, "documents")).select("doc_id", F.lit(0).cast("long").alias("start"), "text")
    found = candidates.candidates(nodes, "doc_id", triggers=TRIGGERS, most=600)
    return found.select("doc_id", "candidate_start", "candidate_end", "generation_method", F.md5("candidate_text").alias("digest"), "candidate_kind", "candidate_priority", F.array_join("trigger_signals", " ").alias("trigger_signals"), "candidate_score")


@query(r"""with d as (select doc_id, text, string_split_regex(text, 'onou|[0-9]{2}|thhe') as gs, regexp_extract_all(text, 'onou|[0-9]{2}|thhe') as hs from documents where text is not null),
h as (select doc_id, length(text) as n, unnest(range(1, len(hs) + 1)) as k, unnest(hs) as hit, unnest(gs[:len(hs)]) as gap from d),
p as (select doc_id, n, hit, sum(length(gap) + length(hit)) over (partition by doc_id order by k) as upto from h),
v as (select doc_id, greatest(upto - length(hit) - 40, 0)::bigint as a, least(upto + 40, n)::bigint as b from p),
m as (select *, case when a <= max(b) over (partition by doc_id order by a, b rows between unbounded preceding and 1 preceding) + 10 then 0 else 1 end as fresh from v),
g as (select *, sum(fresh) over (partition by doc_id order by a, b rows unbounded preceding) as island from m)
select doc_id, min(a) as start, max(b) as "end", count(*) as n from g group by doc_id, island""")
def merged_trigger_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 40 characters around each hit, merged where they are 10 apart at most."""
    nodes = dealt(_t(spark, sf_dir, "documents")).select("doc_id", F.lit(0).cast("long").alias("start"), F.length("text").alias("length"), "text")
    return candidates.around(candidates.hits(nodes, "onou|[0-9]{2}|thhe"), ["doc_id"], 40, "length", 10)


def _linkable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as spans of their source: order, paragraph and section go by id, roles by runs of letters."""
    text, k = F.coalesce("text", F.lit("")), F.col("doc_id")
    has = lambda part: F.contains(text, F.lit(part))
    context = k % 9 == 0

    def role(name: str, when: Column, structured: Column, phrase: Column, specific: Column, relation: Column) -> Column:
        return F.when(when, F.struct(F.lit(name).alias("role"), structured.alias("structured"), phrase.alias("phrase"), specific.alias("specific"), relation.alias("relation")))

    no, yes = F.lit(False), F.lit(True)
    roles = F.array_compact(F.array(role("performance", ~context & has("thhe"), has("onou"), has("thea"), has("enen"), k % 17 == 0), role("validation", ~context & has("heti"), has("erer"), has("anon"), has("tble"), no), role("context_hint", context, no, yes, no, no)))
    family = F.when(F.col("lang") == "en", "a").when(F.col("lang") == "de", "b").when(F.col("lang") == "fr", "mixed")
    return _t(spark, sf_dir, "documents").select(F.col("source").alias("paper_id"), k.alias("span_id"), k.alias("span_order"), F.floor(k / 4).alias("paragraph"), F.floor(k / 16).alias("section"), family.alias("family"), (has("tion") & ~context).alias("primary"), context.alias("context_only"), (k % 13 == 0).alias("family_conflict"), roles.alias("roles"))


@query("""with d as (select source, doc_id as k, doc_id // 4 as par, doc_id // 16 as sec, case lang when 'en' then 'a' when 'de' then 'b' end as fam, coalesce(text, '') as t, doc_id % 9 = 0 as ctx, doc_id % 13 = 0 as conf from documents where source is not null),
s as (select source, k, par, sec, fam, ctx, conf, contains(t, 'tion') and not ctx as prim, 'performance' as role, contains(t, 'onou') as st, contains(t, 'thea') as ph, contains(t, 'enen') as sp, k % 17 = 0 as rel from d where not ctx and contains(t, 'thhe')
  union all select source, k, par, sec, fam, ctx, conf, contains(t, 'tion'), 'validation', contains(t, 'erer'), contains(t, 'anon'), contains(t, 'tble'), false from d where not ctx and contains(t, 'heti')
  union all select source, k, par, sec, fam, ctx, conf, false, 'context_hint', false, true, false, false from d where ctx),
p as (select a.source, a.k as target_id, s.k as span_id, s.role, abs(a.k - s.k) as distance, abs(a.par - s.par) <= 1 as beside, a.sec = s.sec as near, a.fam is not null and s.fam is not null and a.fam <> s.fam as other, a.fam is not null and s.fam is not null and a.fam = s.fam as same, s.ctx, s.conf, s.prim, s.st, s.ph, s.sp, s.rel from d a join s on a.source = s.source and a.k <> s.k),
c as (select *, (case when st then 0.35 else 0 end + case when ph and not ctx then 0.25 else 0 end + case when beside then 0.15 else 0 end + case when near then 0.08 else 0 end + case when prim then 0.10 else -0.30 end + case when same then 0.07 else 0 end + case when conf then -0.25 else 0 end + case when (ctx or ph) and not sp and not st then -0.25 else 0 end)::double as raw from p where not other),
q as (select *, round(case when ctx and beside then greatest(0.65, least(1, greatest(0, raw))) when ctx and near then greatest(0.60, least(1, greatest(0, raw))) else least(1, greatest(0, raw)) end, 4) as score from c where ctx or st or rel or (beside and ph) or (ph and role = 'validation')),
r as (select *, row_number() over (partition by source, target_id, role order by score desc, distance, span_id) as n from q where score >= 0.6),
u as (select source, target_id, span_id, max(score) as score, min(distance) as distance, string_agg(role, ',' order by role) as roles from r where n <= 2 group by all),
w as (select *, row_number() over (partition by source, target_id order by score desc, distance, span_id) as place from u)
select source as paper_id, target_id, span_id, score, distance, roles, place from w where place <= 12""")
def linked_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document the best evidence of its source by role, by all ten weights."""
    spans = _linkable(spark, sf_dir)
    found = linking.links(spans, spans, width=1000)
    return found.select("paper_id", "target_id", "span_id", "score", "distance", F.array_join("roles", ",").alias("roles"), F.col("place").cast("long").alias("place"))


@query("""with recursive o as (select o_custkey, o_orderkey, lag(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as before, last_value(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey rows between unbounded preceding and unbounded following) as last from orders),
e as (select o_orderkey as node, before as needs from o where before is not null union select o_orderkey, last from o where before is null and o_custkey % 13 = 0),
c as (select node, needs from e union select c.node, e.needs from c join e on c.needs = e.node),
y as (select distinct node from c where node = needs)
select c.node as o_orderkey, count(*) as needed, bool_or(c.node = c.needs) as in_cycle, bool_or(y.node is not null) as never_ready from c left join y on c.needs = y.node group by c.node""")
def prerequisite_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that wait for their customer's earlier ones: how many each rests on, and which a cycle keeps waiting for ever."""
    by_date = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.lag("o_orderkey").over(by_date).alias("before"), F.last("o_orderkey").over(by_date.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("last"))
    edges = rows.select(F.col("o_orderkey").alias("node"), F.when(F.col("before").isNotNull(), F.col("before")).when(F.col("o_custkey") % 13 == 0, F.col("last")).alias("needs"))
    reached = hierarchy.closure(edges)
    waiting = hierarchy.cycles(reached)
    counts = reached.groupBy("node").agg(F.count("*").alias("needed")).join(waiting, "node", "left")
    return counts.select(F.col("node").alias("o_orderkey"), "needed", F.coalesce("in_cycle", F.lit(False)).alias("in_cycle"), F.coalesce(F.col("in_cycle") | F.col("behind_cycle"), F.lit(False)).alias("never_ready"))


_TYPES = ("baseline_repeatability", "validation_gap_closure", "contamination_control", "electrolyte_window", "water_content_window", "operating_field_matrix", "product_state_accounting", "stability_failure", "HOR_proton_economy", "postmortem_failure_analysis")


@query("""with r as (select o_orderkey::varchar as id, o_custkey as scope, ['baseline_repeatability', 'validation_gap_closure', 'contamination_control', 'electrolyte_window', 'water_content_window', 'operating_field_matrix', 'product_state_accounting', 'stability_failure', 'HOR_proton_economy', 'postmortem_failure_analysis'][o_orderkey % 10 + 1] as t, [0, 1, 1, 2, 2, 2, 3, 3, 4, 5][o_orderkey % 10 + 1] as s, o_orderstatus = 'F' as done, o_orderpriority = '1-URGENT' as deferred from orders),
w(s, want) as (values (1, 'baseline_repeatability'), (2, 'baseline_repeatability'), (2, 'validation_gap_closure'), (2, 'contamination_control'), (3, 'baseline_repeatability'), (3, ''), (4, 'baseline_repeatability'), (4, 'product_state_accounting'), (5, 'stability_failure')),
n as (select a.id, coalesce(b.id, case when w.want != '' then a.scope || '::' || w.want end) as needs, coalesce(b.done, false) as met from r a join w on a.s = w.s left join r b on a.scope = b.scope and case when w.want = '' then b.s = 2 and b.t != 'electrolyte_window' else b.t = w.want end),
g as (select id, string_agg(needs, ' ' order by needs) as needs, coalesce(string_agg(case when not met then needs end, ' ' order by needs), '') as open from n where needs is not null group by id),
k as (select r.*, coalesce(g.needs, '') as needs, coalesce(open, '') as open from r left join g on r.id = g.id),
x as (select *, case when t = 'electrolyte_window' then 'non_executable' when done then 'completed' when deferred then 'blocked' when s = 5 then 'blocked' when open != '' and s = 4 then 'waived' when open != '' then 'blocked' else 'actionable' end as status from k)
select id as route_id, s::int as stage_rank, needs as prerequisites, status as stage_gate_status, case when status = 'blocked' then open else '' end as blocked_by from x""")
def route_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as routes of their customer: what each waits for by its stage, and whether it can be run."""
    k = F.col("o_orderkey")
    rows = _t(spark, sf_dir, "orders").select(k.cast("string").alias("route_id"), F.col("o_custkey").alias("scope"), _choice(k, *_TYPES).alias("route_type"), F.when(F.col("o_orderpriority") == "1-URGENT", hierarchy.DEFERRED).alias("priority_label"), F.col("o_orderstatus"))
    needs = hierarchy.prerequisites(rows, ["scope"])
    found = hierarchy.gates(rows, needs, rows.where("o_orderstatus = 'F'").select("route_id"), waived=[4])
    return found.select("route_id", "stage_rank", F.array_join("prerequisite_route_ids", " ").alias("prerequisites"), "stage_gate_status", F.array_join("blocked_by_route_ids", " ").alias("blocked_by"))


_GATES = ("first", "second", "third", "fourth")


@query(r"""with l as (select doc_id, unnest(range(1, len(ls) + 1)) as i, unnest(ls) as line from (select doc_id, str_split(text, chr(10)) as ls from documents where text is not null)),
s as (select doc_id, i, length(line) as n, contains(line, 'tion') as a, contains(line, 'thhe') as b, contains(line, 'onou') as c, contains(line, 'nicht') as d, contains(line, 'that') as na, contains(line, 'erer') as nb, sum(length(line)) over (partition by doc_id order by i) as upto from l),
p as (select x.doc_id, x.i, y.i as j, y.n, y.a, y.b, y.c, y.d, 2 * abs(x.i - y.i) - case when y.i < x.i then 1 else 0 end as key from s x join s y on x.doc_id = y.doc_id and x.i <> y.i and case when y.i < x.i then x.upto - x.n - y.upto else y.upto - y.n - x.upto end <= 400),
u as (select *, sum(n) over (partition by doc_id, i order by key) as used from p),
t as (select doc_id, i, count(*) as neighbours, max(used) as used, min(j) as lo, max(j) as hi, bool_or(a) as a, bool_or(b) as b, bool_or(c) as c, bool_or(d) as d from u where used <= 400 group by 1, 2),
k as (select s.doc_id, s.i, coalesce(neighbours, 0) as neighbours, coalesce(used, 0) as used, least(s.i, coalesce(lo, s.i)) as first, greatest(s.i, coalesce(hi, s.i)) as last,
  case when s.na then 'conflict_in_target' when s.a then 'observed_in_target' when t.a then 'observed_in_local_context' else 'missing' end as g1, case when s.nb then 'conflict_in_target' when s.b then 'observed_in_target' when t.b then 'observed_in_local_context' else 'missing' end as g2,
  case when s.c then 'observed_in_target' when t.c then 'observed_in_local_context' else 'missing' end as g3, case when s.d then 'observed_in_target' when t.d then 'observed_in_local_context' else 'missing' end as g4 from s left join t on s.doc_id = t.doc_id and s.i = t.i)
select doc_id, i::bigint as line_no, neighbours::bigint as neighbours, used::bigint as used, first::bigint as first, last::bigint as last, concat_ws(' ', g1, g2, g3, g4) as gates,
case when g1 like 'obs%' and g2 like 'obs%' and g3 like 'obs%' and g4 like 'obs%' then 'complete' when g1 like 'obs%' or g2 like 'obs%' or g3 like 'obs%' or g4 like 'obs%' then 'partial' else 'none' end as gate_status from k""")
def context_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every line the neighbours that fit 400 characters, and how they and the line cover four gates."""
    lines = segment.lines(dealt(_t(spark, sf_dir, "documents").select("doc_id", "text")))
    has = lambda part: F.contains(F.col("line"), F.lit(part))
    shows, denies = packets.mask(dict(zip(_GATES, map(has, ("tion", "thhe", "onou", "nicht"))))), packets.mask({"first": has("that"), "second": has("erer")})
    spans = lines.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.length("line").alias("length"), shows.alias("shows"), denies.alias("denies"))
    found = packets.neighbourhoods(spans, 400, "doc_id", "line_no").withColumns({"linked": F.lit(0).cast("long"), "against": F.lit(0).cast("long")})
    found = packets.coverage(found, _GATES)
    return found.select("doc_id", "line_no", F.size("neighbours").cast("long").alias("neighbours"), "used", "first", "last", F.concat_ws(" ", *(F.element_at("gates_covered", F.lit(g)) for g in _GATES)).alias("gates"), "gate_status")


@query(r"""with l as (select doc_id, unnest(range(1, len(ls) + 1)) as i, unnest(ls) as line from (select doc_id, str_split(text, chr(10)) as ls from documents where text is not null)),
s as (select doc_id, i, (coalesce(sum(length(line) + 1) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0))::bigint as start, length(line) as n, sha256(trim(regexp_replace(replace(line, chr(160), ' '), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ')) as sha from l),
r as (select *, row_number() over (partition by doc_id, sha order by start) as occurrence from s)
select doc_id, i::bigint as line_no, occurrence, case when i % 3 = 0 or n = 0 then 'legacy_order_anchored' else 'offset_anchored' end as method,
'SPAN_' || sha256(case when i % 3 = 0 or n = 0 then '{"document_id":"' || doc_id || '","legacy_span_order":' || i || ',"paper_id":"' || doc_id || '","section_path":"lines","source_text_sha256":"' || sha || '"}'
  else '{"document_id":"' || doc_id || '","paper_id":"' || doc_id || '","source_end_offset":' || (start + n) || ',"source_start_offset":' || start || ',"source_text_sha256":"' || sha || '"}' end) as stable_span_uid,
'CONTENT_' || sha256('["' || doc_id || '","' || sha || '","' || occurrence || '"]') as content_id from r""")
def span_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all lines, by their offsets or, for a third of them, their number, and by their content."""
    lines = segment.lines(dealt(_t(spark, sf_dir, "documents").select("doc_id", "text")))
    doc, by_number, none = F.col("doc_id").cast("string"), F.col("line_no") % 3 == 0, F.lit(None)
    spans = lines.select(
        "doc_id", F.col("line_no").cast("long").alias("line_no"), F.col("start").alias("at"), doc.alias("paper_id"), doc.alias("document_id"), none.cast("string").alias("document_body_sha256"), F.array(F.lit("Lines ")).alias("section_path"), F.col("line").alias("source_text"), F.concat(doc, F.lit("_S"), F.col("line_no").cast("string")).alias("source_span_id"),
        F.when(~by_number, F.col("start")).alias("source_start_offset"), F.when(~by_number, F.col("start") + F.length("line")).alias("source_end_offset"), none.cast("string").alias("mapping_method"), none.cast("long").alias("verified_start"), none.cast("long").alias("verified_end"),
    )
    found = identity.with_content_id(identity.with_uid(spans), ("doc_id",), order="at")
    return found.select("doc_id", "line_no", "occurrence", F.col("stable_span_uid_method").alias("method"), "stable_span_uid", "content_id")


@query("""with n as (select case when doc_id % 43 = 0 then doc_id + 10000000 else doc_id end as doc_id, case when doc_id % 37 = 0 then coalesce(text, '') || '!' else text end as text, lang, source from documents where doc_id % 41 <> 0)
select coalesce(o.source, n.source) as folder, coalesce(o.doc_id, n.doc_id)::varchar as key, case when o.doc_id is null then 'added' when n.doc_id is null then 'removed' else 'changed' end as change from documents o full join n on o.doc_id = n.doc_id and o.source is not distinct from n.source
where o.doc_id is null or n.doc_id is null or o.text is distinct from n.text""")
def run_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a second run of the documents changed, by source: some texts differ, some are gone, some have new ids."""
    k = F.col("doc_id")
    old = dealt(_t(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    new = old.where(k % 41 != 0).select(F.when(k % 43 == 0, k + 10000000).otherwise(k).alias("doc_id"), F.when(k % 37 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit("!"))).otherwise(F.col("text")).alias("text"), "lang", "source")
    return freeze.changes(old, new, "doc_id", "source")


@query("""select b.item_id, min(case when d.doc_id = b.item_id then 'same_id' else 'same_text' end) as leak from benchmark b join documents d on d.doc_id = b.item_id or d.text = b.text group by b.item_id, case when d.doc_id = b.item_id then 1 else 0 end""")
def held_out_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the benchmark whose id or whole text the documents have."""
    docs = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "text")
    return freeze.leaks(_t(spark, sf_dir, "benchmark").select("item_id", "text"), docs, "item_id", "text")


@query("""with d as (select doc_id, source, lang, concat_ws('|', coalesce(lang, '?'), case when n_chars > 2000 then 'long' when n_chars > 400 then 'middle' else 'short' end, case when doc_id % 7 = 0 then 'review' else 'clear' end) as stratum, sha256('16' || chr(10) || doc_id) as h from documents),
z as (select *, count(*) over (partition by stratum) as size, row_number() over (partition by stratum order by h, doc_id) as r, row_number() over (partition by lang order by (select count(*) from d e where e.stratum = d.stratum), h, doc_id) as l, row_number() over (partition by source order by h, doc_id) as s, count(*) over (partition by source) as ns from d),
t as (select doc_id, h, 2 as phase, r as a, size as b, stratum as c from z union all select doc_id, h, 0, 0, 0, coalesce(lang, '') from z where l = 1 union all select doc_id, h, 1, 0, ns, coalesce(source, '') from z where s = 1),
m as (select doc_id, h, min({'phase': phase, 'a': a, 'b': b, 'c': c}) as turn from t group by 1, 2)
select doc_id, case turn.phase when 0 then 'cover:lang' when 1 then 'cover:source' else 'turn' end as selected_by, case when turn.phase = 2 then turn.a end as sampling_rank from m order by turn, h, doc_id limit 60""")
def strata_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixty documents in turns of strata, rare ones first, once every language and source has one."""
    n, k = F.col("n_chars"), F.col("doc_id")
    stratum = F.concat_ws("|", F.coalesce("lang", F.lit("?")), F.when(n > 2000, "long").when(n > 400, "middle").otherwise("short"), F.when(k % 7 == 0, "review").otherwise("clear"))
    docs = _t(spark, sf_dir, "documents").select("doc_id", "source", "lang", stratum.alias("stratum"))
    found = sampling.round_robin_sample(docs, "doc_id", "stratum", 60, ("lang", "source"))
    return found.select("doc_id", "selected_by", F.col("sampling_rank").cast("long").alias("sampling_rank"))


@query("""with d as (select doc_id, coalesce(text, '') as t, coalesce(n_chars, 0) as n, lang, doc_id % 5 = 0 as asked from documents),
f as (select *, contains(t, 'onou') and lang = 'en' as c1, n < 60 as h1, contains(t, 'nicht') as h2, n > 4000 as m1, contains(t, 'thhe') as l1, contains(t, 'heti') as p1, contains(t, 'erer') as p2 from d),
s as (select *, case when c1 then 10 when h1 or h2 then 8 when m1 then 4 when l1 then 1 else 0 end as rule_score, case when p1 then 5 when p2 then 2 when asked then 4 else 0 end as model_score, (case when p1 then 3 else 0 end + case when n > 9000 then 6 else 0 end) as audit from f),
b as (select *, greatest(audit, rule_score + model_score) as score from s)
select doc_id, rule_score, model_score, score as review_score, case when c1 then 'critical' when h1 or h2 or score >= 8 then 'high' when m1 or score >= 4 then 'medium' when l1 or score >= 1 then 'low' else 'none' end as review_band,
(c1 or h1 or h2 or m1 or score >= 4 or p1 or p2 or asked) as needs_review, concat_ws(' ', case when c1 then 'c1' end, case when h1 then 'h1' end, case when h2 then 'h2' end, case when m1 then 'm1' end, case when l1 then 'l1' end, case when p1 then 'llm_more_permissive_than_rule' end, case when p2 then 'text_class_disagreement' end) as flags from b""")
def review_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How soon people have to look at each document, by rules, a model's flags and an audit's points."""
    docs, n = dealt(_t(spark, sf_dir, "documents")), F.coalesce("n_chars", F.lit(0))
    has = lambda part: F.contains(F.coalesce("text", F.lit("")), F.lit(part))
    rules = [("c1", "critical", has("onou") & (F.col("lang") == "en")), ("h1", "high", n < 60), ("h2", "high", has("nicht")), ("m1", "medium", n > 4000), ("l1", "low", has("thhe"))]
    found = review.priority(review.requirements(docs, rules), [(3, "heti", has("heti")), (6, "long", n > 9000), (3, "heti", n < 0)])
    found = review.model_requirements(found, F.array().cast("array<string>"), F.col("doc_id") % 5 == 0, {"llm_more_permissive_than_rule": has("heti"), "text_class_disagreement": has("erer")})
    return review.merged(found, "audit_score").select("doc_id", "rule_score", "model_score", "review_score", "review_band", "needs_review", F.array_join("review_flags", " ").alias("flags"))
