"""SQL that computes the same result as each registered query."""

from __future__ import annotations

from posrecon.functions.text import WHITESPACE

_BAU = """
bau as (
  select 'S' || lpad(cast(l_suppkey as varchar), 10, '0') as store,
         lpad(cast(l_partkey as varchar), 12, '0') as upc,
         'ITEM ' || l_partkey || ' ' || l_returnflag as descr,
         l_quantity as units, l_extendedprice as price,
         strftime(l_shipdate, '%Y-%m') as month, l_linenumber as line, l_orderkey as order_key
  from lineitem)"""

_TEST = """
test as (
  select case when l_suppkey % 7 = 5 then 'N' else 'S' end || lpad(cast(l_suppkey as varchar), 10, '0') as store,
         case when l_partkey % 11 = 0 then '9' || lpad(cast(l_partkey as varchar), 11, '0')
              else lpad(cast(l_partkey as varchar), 12, '0') end as upc,
         'ITEM ' || l_partkey || ' ' || l_returnflag ||
           case when l_partkey % 50 = 0 or (l_partkey % 7 = 0 and l_returnflag = 'R') then ' NEW' else '' end as descr,
         l_quantity + case when l_partkey % 9 = 0 then 1 else 0 end as units,
         l_extendedprice as price, strftime(l_shipdate, '%Y-%m') as month,
         l_linenumber as line, l_linestatus as status
  from lineitem)"""


def _sum(expr: str, scale: int = 4) -> str:
    return f"cast(sum(cast({expr} as decimal(18,{scale}))) as double)"


def _pct(b: str, t: str) -> str:
    return (
        f"case when {b} = 0 and {t} = 0 then 0.0 when {b} = 0 then -100.0 "
        f"when {t} = 0 then 100.0 else ({b} - {t}) / {b} * 100 end"
    )


def _grouped(keys: str, source: str = "bau") -> str:
    return f"select {keys}, {_sum('units')} as units, {_sum('price')} as dollars from {source} group by all"


_STORE = f"with {_BAU} {_grouped('store')}"
_ITEM = f"with {_BAU} {_grouped('upc, descr')}"

_STORE_DIFFS = f"""
with {_BAU}, {_TEST},
p as ({_grouped('store', 'bau')}), t as ({_grouped('store', 'test')}),
j as (select store, coalesce(p.units, 0) as units_prod, coalesce(p.dollars, 0) as dollars_prod,
             coalesce(t.units, 0) as units_test, coalesce(t.dollars, 0) as dollars_test
      from p full join t using (store)),
d as (select *, units_prod - units_test as units_diff, dollars_prod - dollars_test as sales_diff,
             {_pct('units_prod', 'units_test')} as units_pct,
             {_pct('dollars_prod', 'dollars_test')} as sales_pct from j)
"""

_STORE_VIEW = f"""{_STORE_DIFFS}
select store, units_prod, dollars_prod, units_test, dollars_test,
  round(units_diff, 4) as units_diff, round(sales_diff, 4) as sales_diff,
  round(units_pct, 6) as units_diff_pct, round(sales_pct, 6) as sales_diff_pct from d"""

_PRESENT = (
    "case when b.units is null then 'Present only in TEST' "
    "when t.units is null then 'Present only in BAU' else 'Present in Both' end"
)


def _item_diffs(bau: str, test: str, ctes: str) -> str:
    return f"""
with {ctes}, b as ({bau}), t as ({test}),
j as (select upc, descr, coalesce(b.units, 0) as bau_units, coalesce(b.dollars, 0) as bau_dollars,
             coalesce(t.units, 0) as test_units, coalesce(t.dollars, 0) as test_dollars,
             {_PRESENT} as present_in
      from b full join t using (upc, descr)),
d as (select *, bau_units - test_units as units_diff, bau_dollars - test_dollars as dollar_diff,
             {_pct('bau_units', 'test_units')} as unit_pct,
             {_pct('bau_dollars', 'test_dollars')} as dollar_pct from j)
"""


_ITEM_DIFFS = _item_diffs(
    _grouped("upc, descr", "bau"), _grouped("upc, descr", "test"), f"{_BAU}, {_TEST}"
)
_ITEM_VIEW = """
select upc, descr, bau_units, bau_dollars, test_units, test_dollars, present_in,
       round(units_diff, 4) as units_diff, round(dollar_diff, 4) as dollar_diff,
       round(unit_pct, 6) as unit_pct, round(dollar_pct, 6) as dollar_pct from d"""


def _named(extra: str) -> str:
    return f"""
select lpad(cast(l_partkey as varchar), 12, '0') as upc, p_name as descr,
       {_sum('l_quantity + ' + extra)} as units, {_sum('l_extendedprice')} as dollars
from lineitem join part on l_partkey = p_partkey group by l_partkey, p_name"""


_KEYS = f"""
with {_BAU}, {_TEST}, b as ({_grouped('upc, descr', 'bau')}), t as ({_grouped('upc, descr', 'test')})"""

_AGREEMENT = f"""{_KEYS},
nb as (select upc, count(*) as bau_descriptions from b group by upc),
nt as (select upc, count(*) as test_descriptions from t group by upc),
ns as (select upc, count(*) as shared_descriptions from b join t using (upc, descr) group by upc),
np as (select upc, count(*) as mismatched_pairs from b join t using (upc) where b.descr <> t.descr group by upc),
a as (select upc, bau_descriptions, test_descriptions,
             coalesce(shared_descriptions, 0) as shared_descriptions,
             coalesce(mismatched_pairs, 0) as mismatched_pairs
      from nb join nt using (upc) left join ns using (upc) left join np using (upc))
"""

ORACLE: dict[str, str] = {
    "store_summary": _STORE,
    "item_summary_rows": _ITEM,
    "upc_summary": f"with {_BAU} {_grouped('upc')}",
    "store_unit_price_implied": f"""
with {_BAU} select store, {_sum('units / 100', 6)} as units,
  {_sum('units / 100 * (price / 100)', 6)} as dollars from bau group by store""",
    "measure_parsing": f"""
with x as (
  select l_returnflag, l_linenumber,
    case l_linenumber % 5 when 2 then 0 when 3 then 0 else l_extendedprice end as price,
    l_linenumber % 5 in (2, 3) as bad from lineitem)
select l_returnflag, l_linenumber, {_sum('price')} as price,
  count(*) filter (where bad) as bad_measures, count(*) as n from x group by all""",
    "delimiter_counts": r"""
with x as (select conv_id, turn, regexp_replace(text, '"[^"]*("|$)', '', 'g') as bare from conversations)
select conv_id, turn, length(bare) - length(replace(bare, ',', '')) as commas,
  length(bare) - length(replace(bare, '|', '')) as pipes,
  length(bare) - length(replace(bare, chr(9), '')) as tabs,
  length(bare) - length(replace(bare, ';', '')) as semicolons from x""",
    "document_text": f"""
select doc_id, length(text) as n, length(trim(text, '{WHITESPACE}')) as n_stripped from documents""",
    "merge_summaries": _STORE,
    "rule_aggregate": f"with {_BAU} select store, month, {_sum('units')} as units from bau group by all",
    "store_validation": _STORE_VIEW,
    "item_validation": _ITEM_DIFFS + _ITEM_VIEW,
    "item_validation_named": _item_diffs(
        _named("0"), _named("case when l_partkey % 9 = 0 then 1 else 0 end"), "one as (select 1)"
    ) + _ITEM_VIEW,
    "item_presence_summary": f"""{_ITEM_DIFFS}
select present_in, round(sum(units_diff), 2) as units_diff, round(sum(dollar_diff), 2) as dollar_diff
from d group by present_in""",
    "store_tolerance": f"""{_STORE_DIFFS}
select store, round(units_pct, 6) as units_diff_pct,
  case when abs(units_pct) <= 1.0 then 'Pass' else 'Fail' end as status from d""",
    "store_ranked": f"""{_STORE_DIFFS}
select store, units_diff, cast(floor(rank() over (order by units_diff desc)
  + (count(*) over (partition by units_diff) - 1) / 2.0) as integer) as rank from d""",
    "item_ranked": f"""{_ITEM_DIFFS}
select upc, descr, units_diff, cast(floor(rank() over (order by units_diff)
  + (count(*) over (partition by units_diff) - 1) / 2.0) as integer) as rank from d""",
    "store_top_k": f"{_STORE_DIFFS} select store, units_diff from d order by units_diff desc, store limit 10",
    "store_sorted": f"{_STORE_DIFFS} select store, units_diff from d order by units_diff desc",
    "store_list_compare": f"""
with {_BAU}, {_TEST}, p as (select distinct lower(trim(store)) as store from bau),
t as (select distinct lower(trim(store)) as store from test)
select 'missing_in_test' as side, store from (select store from p except select store from t)
union all select 'missing_in_prod', store from (select store from t except select store from p)""",
    "store_list_text": f"""
with {_BAU}, {_TEST}, p as (select distinct lower(trim(store)) as store from bau),
t as (select distinct lower(trim(store)) as store from test),
m as (select 'missing_in_test' as side, store from (select store from p except select store from t)
union all select 'missing_in_prod', store from (select store from t except select store from p))
select side, store, count(*) over (partition by side) as n_stores from m""",
    "read_delimited_store": _STORE,
    "read_delimited_item": _ITEM,
    "read_fixed_width_item": _ITEM,
    "read_records_store": _STORE,
    "read_transactions_store": _STORE,
    "read_transactions_trailer": f"""
with {_BAU} select store, month, {_sum('units')} as trailer_units, {_sum('price')} as trailer_dollars,
  count(*) as details, {_sum('units')} as units, {_sum('price')} as dollars
from bau group by store, month""",
    "file_review": f"""
with {_BAU} select month as filename, count(distinct store) as store_count,
  count(distinct upc) as upc_count, {_sum('units')} as total_units,
  round({_sum('price')}, 2) as total_dollars from bau group by month""",
    "file_review_consolidated": f"""
with {_BAU} select '2 files (aggregated)' as filename, count(distinct store) as store_count,
  count(distinct upc) as upc_count, round({_sum('units')}, 2) as total_units,
  round({_sum('price')}, 2) as total_dollars from bau""",
    "audit_inner_diff": f"""{_KEYS}
select upc, descr, round(t.units - b.units, 4) as units_diff, round(t.dollars - b.dollars, 4) as dollar_diff,
  round(case when b.units = 0 then 0 else (t.units - b.units) / b.units end, 6) as unit_change,
  round(case when b.dollars = 0 then 0 else (t.dollars - b.dollars) / b.dollars end, 6) as dollar_change
from b join t using (upc, descr)""",
    "audit_outer_presence": f"""{_KEYS}
select upc, descr, b.units as bau_units, b.dollars as bau_dollars, t.units as test_units,
  t.dollars as test_dollars, {_PRESENT} as present_in from b full join t using (upc, descr)""",
    "audit_key_counts": f"""{_KEYS}
select count(*) filter (where t.units is null) as bau_only,
  count(*) filter (where b.units is null) as test_only,
  count(*) filter (where b.units is not null and t.units is not null) as both
from b full join t using (upc, descr)""",
    "audit_upc_agreement": f"{_AGREEMENT} select * from a",
    "audit_disjoint_desc": f"{_AGREEMENT} select * from a where shared_descriptions = 0",
    "audit_desc_mismatch": f"""{_KEYS}
select upc, b.descr as descr, 'BAU' as side, any_value(b.units) as units, any_value(b.dollars) as dollars,
  count(*) as partners from b join t using (upc) where b.descr <> t.descr group by upc, b.descr
union all
select upc, t.descr, 'TEST', any_value(t.units), any_value(t.dollars), count(*)
from b join t using (upc) where b.descr <> t.descr group by upc, t.descr""",
    "audit_mismatch_report": f"""{_AGREEMENT},
bs as (select upc, sum(units) as u, sum(dollars) as p from b group by upc),
ts as (select upc, sum(units) as u, sum(dollars) as p from t group by upc),
d as (select upc, 'BAU' as side, descr from b union all select upc, 'TEST', descr from t)
select d.upc, d.side, d.descr, round(bs.u, 2) as bau_units, round(ts.u, 2) as test_units,
  round(bs.p, 2) as bau_dollars, round(ts.p, 2) as test_dollars
from d join a using (upc) join bs using (upc) join ts using (upc) where a.shared_descriptions = 0""",
    "audit_one_store": f"""
select 3.0::double as store, count(*) as n, {_sum('l_quantity')} as units
from lineitem where lpad(cast(l_suppkey as varchar), 5, '0') = '00003' having count(*) > 0""",
    "read_mixed_headers_store": _STORE,
    "read_start_line_store": _STORE,
    "line_numbering": """
select 0::bigint as odd, 'H' as kind, count(*) as n from lineitem
union all select 1, 'D', count(*) from lineitem""",
    "two_level_summary": f"""
with {_BAU}
select 'store' as level, store as key, '' as descr, {_sum('units')} as units, {_sum('price')} as dollars
from bau group by store
union all select 'item', upc, descr, {_sum('units')}, {_sum('price')} from bau group by upc, descr""",
    "reconcile_two_formats": _STORE_VIEW,
    "onboard_store_list": f"""
with {_TEST}, p as (select distinct lower(store) as store from test),
t as (select distinct 's' || lpad(cast(s_suppkey as varchar), 10, '0') as store from supplier)
select 'missing_in_test' as side, store from (select store from p except select store from t)
union all select 'missing_in_prod', store from (select store from t except select store from p)""",
    "report_round_trip": _STORE_VIEW,
    "landing_stream_store": _STORE,
    "profile_formats": """
select * from (values
  ('delimited', 'delimited', ',', true, 'cp1252', null, null, 'Store,UPC,Description,Units,Price', 'Store', 'Price'),
  ('fixed', 'fixed', null, true, 'cp1252', null, null, null, null, null),
  ('records', 'multiline', '|', false, 'cp1252', null, 'D,H',
   'Column_0,Column_1,Column_2,Column_3,Column_4', 'Column_0', 'Column_0'),
  ('transactions', 'multiline', '|', false, 'cp1252', 'HDRS', null, null, null, null)
) as t(kind, file_type, delimiter, has_header, encoding, header_prefix, record_types, columns, store_col, price_col)""",
    "config_check": """
with c as (
  select s_suppkey,
    case s_suppkey % 4 when 0 then 'delimited' when 1 then 'fixed' when 2 then 'multiline' end as ft,
    s_nationkey % 2 = 0 as lay, s_nationkey % 3 = 0 as hdr, s_nationkey % 5 = 0 as hl,
    s_suppkey % 3 = 0 as rt, s_suppkey % 7 <> 0 as sch, s_suppkey % 5 <> 0 as st,
    s_suppkey % 6 = 0 as ds, s_nationkey % 4 <> 0 as un, s_nationkey % 4 <> 1 as pr from supplier)
select s_suppkey, array_to_string(list_filter([
  case when ft is null then 'File type is not set (required: delimited, fixed, or multiline).' end,
  case when ft = 'fixed' and not lay then 'Fixed-width files require a layout CSV file path.' end,
  case when ft = 'multiline' and hdr and not hl then 'HDR files require a header layout CSV.' end,
  case when ft = 'multiline' and hdr and hl then 'HDR files require a detail layout CSV.' end,
  case when ft = 'multiline' and not hdr and not rt then 'Multiline files require record type prefixes (e.g. H,D).' end,
  case when not sch then 'No schema or detected columns — cannot determine data structure.' end,
  case when not st then 'Store column mapping is required.' end,
  case when not un then 'Units column mapping is required.' end,
  case when not pr then 'Price column mapping is required.' end,
  case when sch and ds then 'Mapped columns not found in schema: Text' end], lambda x: x is not null), '; ') as errors
from c""",
    "mapping_check": """
with c as (select s_suppkey, 'c' || (s_nationkey % 3) as a, 'c' || (s_suppkey % 3) as b,
    case when s_suppkey % 2 = 0 then 'c9' end as d, case when s_nationkey % 2 = 0 then 'c9' else '' end as u
  from supplier),
m as (select s_suppkey, list_filter([
  case when d is null then 'Description column is not selected.' end,
  case when u = '' then 'Units column is not selected.' end,
  case when a = b then 'Duplicate column: ''' || a || ''' is selected for both ''Store'' and ''UPC''. Each column must be unique.' end,
  case when d = u then 'Duplicate column: ''c9'' is selected for both ''Description'' and ''Units''. Each column must be unique.' end,
  case when b = 'c1' then 'Duplicate column: ''c1'' is selected for both ''UPC'' and ''Price''. Each column must be unique.'
       when a = 'c1' then 'Duplicate column: ''c1'' is selected for both ''Store'' and ''Price''. Each column must be unique.' end
  ], lambda x: x is not null) as e from c)
select s_suppkey, cast(len(e) as integer) as n_errors, array_to_string(e, '; ') as errors from m""",
}
ORACLE["line_numbers"] = """
select cast(l_orderkey as bigint) as order_key, cast(l_linenumber as bigint) as line_number,
  row_number() over (partition by l_orderkey % 5 order by l_orderkey, l_linenumber) - 1 as line_no from lineitem"""
ORACLE["read_quoted_item"] = f"""
with {_BAU}, q as (select upc, units, price,
  descr || case when right(upc, 1) in ('0', '3', '6', '9') then chr(10) || 'second "line", with a comma' else '' end as descr
  from bau) {_grouped('upc, descr', 'q')}"""
_FIRST = f"""
with {_BAU}, f as (select *, row_number() over (order by order_key, line) as n, printf('%.2f', price) as money,
  cast(cast(units as bigint) as varchar) as whole from bau where order_key % 5 = 0)"""
ORACLE["preview_fixed"] = f"""{_FIRST}
select store as "Store", upc as "UPC", descr as "Description", whole as "Units", money as "Price" from f where n <= 20"""
ORACLE["preview_delimited"] = ORACLE["preview_fixed"].replace("n <= 20", "n <= 19")
ORACLE["preview_record_rows"] = f"""{_FIRST}
select store as "Column_0", upc as "Column_1", descr as "Column_2", whole as "Column_3", money as "Column_4" from f where n <= 10
union all select store, month, '', '', '' from f where n <= 10"""
ORACLE["preview_transaction_rows"] = f"""{_FIRST},
o as (select order_key, cast(cast(sum(units) as bigint) as varchar) as total_units,
  cast(sum(cast(price as decimal(18,2))) as varchar) as total_price from f group by order_key)
select cast(order_key as varchar) as order_key, upc, descr, whole as units, money as price, total_units, total_price
from f join o using (order_key) where n <= 20"""
ORACLE["landing_table_store"] = _STORE
_HARD = f"""
with {_BAU}, h as (select case when line = 3 then null else store end as store, upc, 'CAFÉ € ' || descr as descr, units,
  case when line = 1 then 0 else price end as price from bau)"""
ORACLE["read_hard_item"] = f"{_HARD} {_grouped('upc, descr', 'h')}"
ORACLE["read_hard_store"] = f"{_HARD} {_grouped('store', 'h')}"
ORACLE["read_fixed_dates"] = """
select '20' || strftime(l_shipdate, '%y-%m-%d') as day, cast(l_linenumber as varchar) as line, count(*) as n
from lineitem group by all
union all select '', '0', count(*) from lineitem where l_linenumber = 7 having count(*) > 0"""
ORACLE["run_history"] = """
select '2024-01-0' || l_linenumber as day, 1::bigint as files_processed, count(*) as rows_processed,
  round(count(*) / 8, 2) as execution_time, count(*) filter (where l_returnflag = 'R') as rows_failed
from lineitem group by l_linenumber order by l_linenumber desc limit 5"""
ORACLE["profile_roles"] = f"""
with {_BAU}, t as (select order_key % 5 as part, store, upc, descr, cast(cast(units as bigint) as varchar) as units,
  printf('%.2f', price) as price from bau),
k as (select part, {', '.join(f"case when bool_and(regexp_full_match({c}, '-?[0-9]+')) then 'Int64' when bool_and(regexp_full_match({c}, '-?[0-9]*[.]?[0-9]+')) then 'Float64' else 'String' end as {c}" for c in ('store', 'upc', 'descr', 'units', 'price'))}
  from t group by part)
select part, 'delimited' as file_type, ',' as delimiter, true as has_header, 'Store,UPC,Description,Units,Price' as columns,
  store || ',' || upc || ',' || descr || ',' || units || ',' || price as data_types, 'Store' as store_col, 'UPC' as upc_col,
  'Description' as desc_col, 'Units' as units_col, 'Price' as price_col from k"""
ORACLE["profile_transactions"] = """
select 'multiline' as file_type, 'HDR' as header_prefix, false as has_header, count(distinct l_orderkey % 5) as files from lineitem"""
ORACLE["read_layouts_item"] = f"""
with {_BAU} select case line % 3 when 0 then 'plain' when 1 then 'implied' else 'marked' end as layout, upc, descr,
  {_sum('units')} as units, {_sum('price')} as dollars from bau group by all"""
ORACLE["rules_aggregate"] = f"""
with {_BAU}
select 'store_month' as rule, store, month, null::varchar as upc, {_sum('units')} as units, null::double as dollars
from bau group by store, month
union all select 'upc', null, null, upc, null, {_sum('price')} from bau group by upc
union all select 'month', null, month, null, {_sum('units')}, {_sum('price')} from bau group by month"""
ORACLE["audit_from_parquet"] = ORACLE["audit_key_counts"]
ORACLE["reconcile_item_comparison"] = ORACLE["item_validation"]
ORACLE["reconcile_item_summary"] = ORACLE["item_presence_summary"]
ORACLE["reconcile_store_list"] = ORACLE["store_list_compare"]
ORACLE["onboard_upc_summary"] = f"with {_TEST} {_grouped('upc, descr', 'test')}"
ORACLE["item_audit_comparison"] = ORACLE["audit_inner_diff"]


def _review(side: str, name: str) -> str:
    return f"""
select '{name}' as filename, count(distinct store) as store_count, count(distinct (upc, descr)) as upc_count,
  round({_sum('units')}, 2) as total_units, round({_sum('price')}, 2) as total_dollars from {side}"""


def _review_by_file(side: str, source: str, name: str) -> str:
    return f"""
select {name} as filename, '{side}' as side, count(distinct store) as store_count, count(distinct upc) as upc_count,
  round({_sum('units')}, 2) as total_units, round({_sum('price')}, 2) as total_dollars from {source} group by {name}"""


ORACLE["reconcile_file_reviews"] = f"""
with {_BAU}, {_TEST} {_review_by_file('bau', 'bau', 'month')}
union all {_review_by_file('test', "(select *, 'state-' || status as f from test)", 'f')}"""
ORACLE["read_transactions_orphans"] = f"""
with {_BAU}, k as (select * from bau where line <> 7)
select store, {_sum('units')} as trailer_units, {_sum('price')} as trailer_dollars, count(*) as details,
  count(distinct month) as months, {_sum('units')} as units, {_sum('price')} as dollars from k group by store"""
ORACLE["transaction_orphans"] = """
select count(*) as details, cast(count(*) filter (where l_linenumber = 7) as bigint) as orphans from lineitem"""
ORACLE["reconcile_counts"] = f"""
with {_BAU}, {_TEST}, k as (select * from bau where line <> 7)
select 'bau' as side, count(*) as n_rows, 0::bigint as bad_measures, 0::bigint as no_store,
  (select count(*) from bau) as details, (select count(*) from bau where line = 7) as orphan_details,
  count(distinct store) as stores, count(distinct upc) as upcs, count(distinct cast(substr(store, 2) as bigint) % 4) as files from k
union all
select 'test', count(*), count(*) filter (where line = 5), count(*) filter (where line = 6), null, null,
  count(distinct case when line <> 6 then store end), count(distinct upc), count(distinct month) from test"""
ORACLE["reconcile_reviews"] = f"with {_BAU}, {_TEST} {_review('bau', 'BAU')} union all {_review('test', 'TEST')}"
ORACLE["onboard_file_review"] = f"with {_TEST} {_review('test', 'retailer')}"
ORACLE["reconcile_metrics"] = """
select side, (select count(*) from lineitem) as n_rows, 0::bigint as bad_measures, 0::bigint as no_store
from (values ('bau'), ('test')) as s(side)"""
ORACLE["item_audit_counts"] = f"""{_AGREEMENT}
select (select count(*) from b anti join t using (upc, descr)) as bau_only,
  (select count(*) from t anti join b using (upc, descr)) as test_only,
  (select count(*) from b join t using (upc, descr)) as both,
  (select cast(coalesce(sum(mismatched_pairs), 0) as bigint) from a) as mismatched_pairs,
  (select count(*) from a) as common_upcs, (select count(*) from a where shared_descriptions = 0) as disjoint_upcs"""
