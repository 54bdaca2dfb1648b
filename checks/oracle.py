"""DuckDB SQL that states what each query returns, over the same tables."""

from __future__ import annotations

from itertools import combinations

from tabulyse.functions import vocabulary as v

ORACLE: dict[str, str] = {}

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
WS = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

GAPPY = """gappy as (
  select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
         nullif(l_discount, 0) as l_discount, nullif(l_tax, 0) as l_tax,
         l_returnflag, l_linestatus, l_shipdate
  from lineitem)"""
CUBED = "spread as (select *, value * value * value as cubed from events)"


def union(parts: list[str]) -> str:
    return "\nunion all\n".join(parts)


def stat(x: str, digits: int = 3) -> str:
    return f"round(case when isfinite({x}) then {x} end, {digits}) + 0.0"


def choose(key: str, choices: list[str]) -> str:
    """One of several values per row, by a key."""
    whens = " ".join(f"when {i} then {c}" for i, c in enumerate(choices))
    return f"case {key} % {len(choices)} {whens} end"


def size_label(x: str) -> str:
    units = ["B", "KB", "MB", "GB"]
    whens = " ".join(f"when {x} < {1024 ** (i + 1)} then printf('%.1f {u}', {x} / {1024.0**i})" for i, u in enumerate(units))
    return f"case {whens} else printf('%.1f TB', {x} / {1024.0**4}) end"


# Profile

_WIDTHS = {
    "l_orderkey": 8, "l_partkey": 8, "l_suppkey": 8, "l_linenumber": 4, "l_quantity": 8, "l_extendedprice": 8,
    "l_discount": 8, "l_tax": 8, "l_shipdate": 8,
}
_LINEITEM = list(_WIDTHS)[:8] + ["l_returnflag", "l_linestatus", "l_shipdate"]
# In Spark the missing taxes are NaN, not NULL; both hold no value but NaN takes its eight bytes.
_bytes = " + ".join(f"count({'*' if c == 'l_tax' else c}) * {w}" for c, w in _WIDTHS.items())
ORACLE["dataset_summary"] = f"""
with {GAPPY}, counted as (
  select count(*) as rows, {' + '.join(f'count(*) - count({c})' for c in _LINEITEM)} as missing_values,
         {_bytes} + sum(strlen(l_returnflag)) + sum(strlen(l_linestatus)) as data_bytes
  from gappy)
select rows, cast(11 as bigint) as columns, cast(8 as bigint) as numeric_columns, cast(2 as bigint) as categorical_columns,
       missing_values, round(100.0 * missing_values / (rows * 11), 2) as missing_pct,
       rows - (select count(*) from (select distinct * from gappy)) as duplicates,
       cast(data_bytes as bigint) as data_bytes, {size_label('data_bytes')} as size_label
from counted"""

ORACLE["duplicate_rows"] = """
select count(*) as rows, count(*) - (select count(*) from (select distinct text, lang from documents)) as duplicates
from documents"""

_ORDER_BYTES = {
    "o_orderkey": "8 * count(*)", "o_custkey": "8 * count(*)", "o_orderstatus": "sum(strlen(o_orderstatus))",
    "o_totalprice": "8 * count(*)", "o_orderdate": "8 * count(*)", "o_orderpriority": "sum(strlen(o_orderpriority))",
}
ORACLE["data_bytes"] = (
    "with sized as ("
    + union([f"select '{c}' as column_name, cast({b} as bigint) as bytes from orders" for c, b in _ORDER_BYTES.items()])
    + f') select column_name as "column", bytes, {size_label("bytes")} as label from sized'
)


def profile_sql(source: str, columns: dict[str, tuple[str, str]]) -> str:
    return union(
        [
            f"""select cast({i} as integer) as position, '{c}' as "column", '{t}' as type, '{r}' as role,
            count(*) - count({c}) as missing, round(100.0 * (count(*) - count({c})) / count(*), 2) as missing_pct,
            count(distinct {c}) as "distinct" from {source}"""
            for i, (c, (t, r)) in enumerate(columns.items())
        ]
    )


_types = {c: ("bigint", "numeric") for c in _LINEITEM[:3]} | {"l_linenumber": ("int", "numeric")}
_types |= {c: ("double", "numeric") for c in MEASURES}
_types |= {"l_returnflag": ("string", "categorical"), "l_linestatus": ("string", "categorical"), "l_shipdate": ("timestamp_ntz", "datetime")}
ORACLE["column_profile"] = f"with {GAPPY} " + profile_sql("gappy", _types)
ORACLE["column_profile_text"] = profile_sql(
    "documents",
    {
        "doc_id": ("bigint", "numeric"),
        "text": ("string", "categorical"),
        "lang": ("string", "categorical"),
        "source": ("string", "categorical"),
        "n_chars": ("bigint", "numeric"),
    },
)

ORACLE["column_profile_approx"] = f"with {GAPPY} " + union(
    [
        f"""select '{c}' as "column", count(*) as n, count(*) - count({c}) as missing, true as near from gappy"""
        for c in MEASURES + ["l_orderkey", "l_returnflag"]
    ]
)
ORACLE["quantiles_approx"] = union(
    [f"""select 'o_totalprice' as "column", cast({p} as double) as p, count(*) as n, true as near from orders""" for p in (0.1, 0.5, 0.9)]
)

_stats = [
    f"""select '{c}' as "column", count({c}) as n, {stat(f'avg({c})')} as mean, {stat(f'median({c})')} as median,
    {stat(f'stddev_samp({c})')} as std, {stat(f'min({c})')} as min, {stat(f'max({c})')} as max,
    {stat(f'quantile_cont({c}, 0.25)')} as q25, {stat(f'quantile_cont({c}, 0.75)')} as q75,
    case when min({c}) = max({c}) then 0.0 else {stat(f'skewness({c})')} end as skew, 'ok' as status from measured"""
    for c in MEASURES + ["l_orderkey", "flat"]
]
ORACLE["numeric_stats"] = (
    f"with {GAPPY}, measured as (select {', '.join(MEASURES)}, cast(l_orderkey as double) as l_orderkey, cast(7.5 as double) as flat from gappy) "
    + union(_stats)
)

ORACLE["deciles"] = union(
    [
        f"""select '{c}' as "column", cast({i / 10} as double) as p, round(quantile_cont(cast({c} as double), {i / 10}), 3) as value, count({c}) as n from orders"""
        for c in ("o_totalprice", "o_custkey")
        for i in range(11)
    ]
)

ORACLE["datetime_stats"] = union(
    [
        f"""select '{c}' as "column", count(*) as n, min(o_orderdate) as min, max(o_orderdate) as max,
        cast(floor(epoch(max(o_orderdate) - min(o_orderdate)) / 86400) as bigint) as range_days,
        cast({failures} as bigint) as parse_failures from orders {where}"""
        for c, where, failures in (
            ("o_orderdate", "", "0"),
            ("written", "where o_orderstatus <> 'P'", "(select count(*) from orders where o_orderstatus = 'P')"),
        )
    ]
)


def top_sql(source: str, columns: list[str], k: int = 10) -> str:
    ranked = union(
        [
            f"""select '{c}' as col, cast({c} as varchar) as value, count(*) as n,
            cast(row_number() over (order by count(*) desc, {c}) as integer) as rank from {source} where {c} is not null group by {c}"""
            for c in columns
        ]
    )
    return f'with ranked as ({ranked}) select col as "column", rank, value, n from ranked where rank <= {k}'


ORACLE["top_values"] = top_sql("part", ["p_name", "p_brand", "p_type", "p_size"])
ORACLE["top_values_frequent"] = top_sql("lineitem", ["l_suppkey", "l_quantity", "l_returnflag", "l_orderkey", "l_shipdate"], 8)
# Ties among long texts go by their digest.
ORACLE["top_values_text"] = """
with counted as (
  select 'text' as col, text as value, count(*) as n, case when strlen(text) > 63 then sha256(text) else text end as key
  from documents group by text
  union all
  select 'lang', lang, count(*), lang from documents group by lang),
ranked as (select *, cast(row_number() over (partition by col order by n desc, key) as integer) as rank from counted)
select col as "column", rank, value, n from ranked where rank <= 10"""

# Distribution

_bins = 20
_hist = [
    f"select '{c}' as col, {'7.5' if c == 'flat' else c} as x from gappy where {'true' if c == 'flat' else f'{c} is not null'}"
    for c in MEASURES + ["flat"]
]
ORACLE["histogram"] = f"""
with {GAPPY}, vals as ({union(_hist)}),
extent as (select col, case when min(x) = max(x) then min(x) - 0.5 else min(x) end as start,
                  case when min(x) = max(x) then max(x) + 0.5 else max(x) end as stop from vals group by col),
bounds as (select *, (stop - start) / {_bins} as step from extent),
edges as (select col, i as bin, i * step + start as lo, case when i = {_bins - 1} then stop else (i + 1) * step + start end as hi
          from bounds, range({_bins}) r(i))
select e.col as "column", e.bin, e.lo, e.hi, count(v.x) as n
from edges e left join vals v on v.col = e.col and v.x >= e.lo and (v.x < e.hi or e.bin = {_bins - 1})
group by all"""

ORACLE["category_distribution"] = """
with ranked as (select p_brand as value, count(*) as n,
                       cast(row_number() over (order by count(*) desc, p_brand) as integer) as rank from part group by p_brand)
select rank, value, n from ranked where rank <= 15"""

_fenced = f"""{CUBED}, vals as (
  select 'value' as col, event_id, value as x from spread union all select 'cubed', event_id, cubed from spread),
quart as (select col, count(*) as n, quantile_cont(x, 0.25) as q1, median(x) as med, quantile_cont(x, 0.75) as q3 from vals group by col),
bounds as (select *, q1 - 1.5 * (q3 - q1) as lower_f, q3 + 1.5 * (q3 - q1) as upper_f from quart)"""
ORACLE["box_plot"] = f"""
with {_fenced}
select b.col as "column", {stat('min(x)')} as min, round(any_value(q1), 3) as q1, round(any_value(med), 3) as median,
       round(any_value(q3), 3) as q3, {stat('max(x)')} as max,
       round(min(x) filter (x >= lower_f), 3) as lower_whisker, round(max(x) filter (x <= upper_f), 3) as upper_whisker,
       count(*) filter (x < lower_f or x > upper_f) as outlier_count, 'ok' as status
from bounds b join vals v on v.col = b.col group by b.col"""
ORACLE["outliers_iqr"] = f"""
with {_fenced}
select b.col as "column", round(any_value(q1), 3) as q1, round(any_value(q3), 3) as q3, round(any_value(q3 - q1), 3) as iqr,
       round(any_value(lower_f), 3) as lower_fence, round(any_value(upper_f), 3) as upper_fence,
       count(*) filter (x < lower_f or x > upper_f) as outlier_count,
       round(100.0 * count(*) filter (x < lower_f or x > upper_f) / count(*), 2) as outlier_pct,
       {stat('min(x)')} as min, {stat('max(x)')} as max, round(any_value(med), 3) as median, 'ok' as status
from bounds b join vals v on v.col = b.col group by b.col"""
ORACLE["outlier_rows"] = f"""
with {_fenced}, outside as (
  select b.col, event_id, x, greatest(lower_f - x, x - upper_f) as distance
  from bounds b join vals v on v.col = b.col where x < lower_f or x > upper_f),
ranked as (select *, cast(row_number() over (partition by col order by distance desc, event_id) as integer) as rank from outside)
select col as "column", rank, event_id, round(x, 3) as x, round(distance, 3) as distance from ranked where rank <= 50"""

ORACLE["daily_counts"] = """
with days as (
  select 'l_shipdate' as col, cast(l_shipdate as date) as day from lineitem
  union all select 'l_month', cast(date_trunc('month', l_shipdate) as date) from lineitem),
counted as (select col, day, count(*) as n, row_number() over (partition by col order by day desc) as back from days group by col, day)
select col as "column", day, n from counted where back <= 200"""

# Relations


def r_sql(a: str, b: str) -> str:
    r = f"corr({a}, {b})"
    return f"coalesce(round(case when isfinite({r}) then {r} end, 3), 0.0)"


def matrix_sql(source: str, columns: list[str]) -> str:
    cells = []
    for i, a in enumerate(columns):
        own = f"case when min({a}) < max({a}) then 1.0 else 0.0 end"
        cells.append((i, i, a, a, f"cast({own} as double)"))
    for (i, a), (j, b) in combinations(enumerate(columns), 2):
        cells += [(i, j, a, b, r_sql(a, b)), (j, i, b, a, r_sql(a, b))]
    return union(
        [
            f"""select cast({i} as integer) as "row", cast({j} as integer) as "col", '{a}' as column_a, '{b}' as column_b, {r} as r from {source}"""
            for i, j, a, b, r in cells
        ]
    )


ORACLE["correlation_matrix"] = f"with {GAPPY}, m as (select *, cast(7.5 as double) as flat from gappy) " + matrix_sql("m", MEASURES + ["flat"])

_wide = [f"m{i}" for i in range(1, 18)]
_powers = ", ".join(f"l_quantity * {i} + l_tax * {i * i} as m{i}" for i in range(1, 18))
# The variance grows with the factor, so the widest 15 are m17 down to m3.
ORACLE["correlation_widest"] = f"with m as (select {_powers} from lineitem) " + matrix_sql("m", _wide[:1:-1])

_pairs = union(
    [
        f"select '{a}' as column_a, '{b}' as column_b, {r_sql(a, b)} as r from gappy"
        for a, b in combinations(MEASURES + ["l_orderkey", "l_partkey", "l_linenumber"], 2)
    ]
)
ORACLE["top_correlations"] = f"""
with {GAPPY}, pairs as ({_pairs})
select column_a, column_b, abs(r) as strength, r from pairs order by strength desc, column_a, column_b limit 10"""

_w = [f"l_quantity * {i % 7} + l_extendedprice * {i % 11} / 1000 + l_discount * {i % 5} * 100 + l_tax * {i % 3} * 100 + l_orderkey * {i + 1} % {97 + i} as w{i}" for i in range(200)]
_corrs = ", ".join(f"{{'a': 'w{i}', 'b': 'w{j}', 'r': corr(w{i}, w{j})}}" for i, j in combinations(range(200), 2))
ORACLE["top_correlations_wide"] = f"""
with {GAPPY}, wide as (select {', '.join(_w)} from gappy), listed as (select unnest([{_corrs}]) as p from wide),
pairs as (select p.a as column_a, p.b as column_b, coalesce(round(case when isfinite(p.r) then p.r end, 3), 0.0) as r from listed)
select column_a, column_b, abs(r) as strength, r from pairs order by strength desc, column_a, column_b limit 40"""

ORACLE["scatter_sample"] = """
select o_orderkey, round(o_totalprice, 3) as x, cast(o_custkey as double) as y from orders
order by md5('42:' || o_orderkey), o_orderkey limit 500"""

ORACLE["what_if"] = f"""
with {GAPPY}, complete as (select l_discount as x, l_extendedprice as y from gappy where l_discount is not null),
fit as (select count(*) as n, avg(x) as mx, regr_slope(y, x) as slope, regr_intercept(y, x) as intercept, corr(y, x) as r from complete),
swept as (select *, mx * (1 + change / 100) as moved, intercept + slope * mx as base from fit,
          (select unnest([-90.0, -10.0, 0.0, 25.0, 200.0]::double[]) as change)),
moved as (select *, intercept + slope * moved as after_v, intercept + slope * moved - base as delta from swept)
select 'l_extendedprice' as target, 'l_discount' as driver, change as change_pct,
       round(mx, 3) as baseline_driver, round(base, 3) as baseline_target, round(moved, 3) as simulated_driver,
       round(after_v, 3) as simulated_target, round(delta, 3) as target_delta, round(delta / base * 100, 3) as target_delta_pct,
       round(slope, 3) as slope, round(intercept, 3) as intercept, round(r, 3) as correlation, round(least(abs(r), 1), 3) as confidence,
       case when delta >= 0 then 'increase' else 'decrease' end as direction, n as sample_size, 'ok' as status
from moved"""

# Preview

ORACLE["preview_page"] = """
select cast(o_orderkey as varchar) as o_orderkey, cast(o_custkey as varchar) as o_custkey, o_orderstatus,
       cast(o_totalprice as varchar) as o_totalprice, cast(o_orderdate as varchar) as o_orderdate, o_orderpriority
from orders order by orders.o_orderkey limit 50 offset 100"""
ORACLE["preview_deep"] = """
with placed as (
  select *, row_number() over (order by l_quantity, l_extendedprice, l_orderkey, l_partkey) as place,
         count(*) over () as total from lineitem)
select cast(l_quantity as varchar) as l_quantity, cast(l_extendedprice as varchar) as l_extendedprice,
       cast(l_orderkey as varchar) as l_orderkey, cast(l_partkey as varchar) as l_partkey
from placed
where place > ((total + 49) // 50 // 2) * 50 and place <= ((total + 49) // 50 // 2) * 50 + 50"""
ORACLE["preview_deep_text"] = """
with placed as (select *, row_number() over (order by c_mktsegment, c_name) as place, count(*) over () as total from customer)
select cast(c_custkey as varchar) as c_custkey, c_name, cast(c_nationkey as varchar) as c_nationkey,
       cast(c_acctbal as varchar) as c_acctbal, c_mktsegment
from placed
where place > ((total + 49) // 50 // 2) * 50 and place <= ((total + 49) // 50 // 2) * 50 + 50"""
_SPELLED = " || ".join(f"length(cast({c} as varchar)) || ':' || {c}" for c in ("l_orderkey", "l_linenumber", "l_returnflag"))
ORACLE["preview_deep_ties"] = f"""
with placed as (
  select *, row_number() over (order by l_returnflag, sha256({_SPELLED})) as place, count(*) over () as total from lineitem)
select cast(l_orderkey as varchar) as l_orderkey, cast(l_linenumber as varchar) as l_linenumber, l_returnflag
from placed
where place > ((total + 49) // 50 // 2) * 50 and place <= ((total + 49) // 50 // 2) * 50 + 50"""
ORACLE["preview_indexed"] = """
with placed as (
  select *, row_number() over (order by l_returnflag, l_extendedprice, l_orderkey, l_linenumber) as place, count(*) over () as total from lineitem)
select cast(l_orderkey as varchar) as l_orderkey, cast(l_linenumber as varchar) as l_linenumber, l_returnflag, cast(l_extendedprice as varchar) as l_extendedprice
from placed
where place > ((total + 49) // 50 // 2) * 50 and place <= ((total + 49) // 50 // 2) * 50 + 50"""
ORACLE["preview_pages"] = """
select count(*) as total_rows, cast(50 as bigint) as page_size,
       cast(greatest(ceil(count(*) / 50.0), 1) as bigint) as total_pages from lineitem"""

# Normalization

ORACLE["null_tokens"] = "select o_orderkey, o_orderkey % 9 in (0, 1, 2, 3, 4, 8) as is_null from orders"

_PRICE = choose("o_orderkey", ["o_totalprice"] * 4 + ["-o_totalprice"] + ["o_totalprice"] * 2 + ["null", "null"])
ORACLE["parse_numbers"] = f"""
select o_orderkey, round({_PRICE}, 6) as as_double, cast(trunc({_PRICE}) as bigint) as as_long from orders"""
ORACLE["parse_booleans"] = """
select o_orderkey, case when o_orderkey % 13 = 12 then null else o_orderkey % 13 < 6 end as flag from orders"""
_DAY = "case when o_orderkey % 17 = 16 then null else cast(o_orderdate as date) end"
ORACLE["parse_dates"] = f"select o_orderkey, {_DAY} as day, o_orderkey % 17 = 16 as unparsed from orders"
ORACLE["parse_times"] = "select event_id, strftime(ts, '%H:%M:%S') as clock from events"

_TRIM = rf"'^{WS}+|{WS}+$', '', 'g'"
_COLLAPSE = rf"'{WS}+', ' ', 'g'"
ORACLE["clean_strings"] = rf"""
with stripped as (
  select doc_id, doc_id % 3 as v, regexp_replace(text, {_TRIM}) as bare, text from documents),
cleaned as (
  select doc_id, case when v > 0 then regexp_replace(text, {_TRIM})
                      when length(bare) >= 2 and bare[1] = bare[-1] and bare[1] in ('''', '"')
                      then regexp_replace(bare[2:-2], {_TRIM}) else bare end as inside from stripped)
select doc_id, regexp_replace(inside, {_COLLAPSE}) as text from cleaned"""

_CLEAN_DATE = "case when o_orderkey % 17 = 16 then null else o_orderdate end"
_NORMAL = f"""
select o_orderkey, o_custkey, o_orderstatus, {{price}} as o_totalprice, {_CLEAN_DATE} as o_orderdate,
       {{priority}} as o_orderpriority{{more}}
from orders"""
_LOW = "case when o_orderpriority = '5-LOW' then {low} else o_orderpriority end"
ORACLE["normalize_table_default"] = _NORMAL.format(
    price=f"coalesce(round({_PRICE}, 6), 0.0)", priority=_LOW.format(low="''"), more=", cast(0 as double) as absent"
)
ORACLE["normalize_table_null"] = _NORMAL.format(price=f"round({_PRICE}, 6)", priority=_LOW.format(low="null"), more="")

ORACLE["normalize_stream"] = ORACLE["normalize_table_null"]

# Text dates make a date column when at least 60 % of the values look like one.
_SEEN = "case when count(*) filter (o_orderstatus <> 'P') >= 0.6 * count(*) then 'Date' else 'String' end"
_TYPES = ["max('Number')", "max('Float')", "max('Date')", _SEEN, "max('Boolean')", "max('Number')", "max('Float')", "max('String')"]
_NAMES = ["order_id", "unit_price", "due_date", "seen", "verified", "holder", "paid", "priority"]
ORACLE["infer_types"] = union(
    [f"""select cast({i} as integer) as position, '{c}' as "column", {t} as type from orders""" for i, (c, t) in enumerate(zip(_NAMES, _TYPES))]
)
ORACLE["normalize_inferred"] = """
select o_orderkey as order_id, round(o_totalprice, 6) as unit_price, cast(o_orderdate as date) as due_date,
       case when o_orderstatus = 'P' then null else cast(o_orderdate as date) end as seen,
       o_orderstatus = 'P' as verified, o_custkey as holder, o_totalprice as paid, o_orderpriority as priority
from orders"""

# Sources and sinks

ORACLE["csv_roundtrip"] = r"""
select page_id, replace(replace(html, chr(10), ' '), chr(13), ' ') as html, nullif(page_id * 0.5::double, 0) as score from pages"""
ORACLE["json_roundtrip"] = "select c_custkey, c_name, cast(c_nationkey as bigint) as c_nationkey, c_acctbal, c_mktsegment from customer"
ORACLE["json_flatten"] = """
select event_id, user_id as "who.user_id", event_type as "who.type.name", cast(json_extract(props, '$.k') as bigint) as "props.k" from events"""
ORACLE["json_documents"] = 'select l_partkey, l_quantity from lineitem'
ORACLE["parquet_roundtrip"] = "select * from orders"
ORACLE["sql_dump_roundtrip"] = "select doc_id, text, lang, source, n_chars from documents"
ORACLE["insert_statements_orders"] = r"""
select 'INSERT INTO "order_data" ("o_orderkey", "note", "done", "o_custkey") VALUES (' || o_orderkey || ', '''
       || o_orderpriority || '\n''''\\' || o_orderstatus || ''', ' || case when o_orderstatus = 'F' then 'TRUE' else 'FALSE' end
       || ', ' || coalesce(cast(nullif(o_custkey, 0) as varchar), 'NULL') || ');' as value
from orders"""
ORACLE["insert_statements_named"] = """
select 'INSERT INTO "product_data" ("s_suppkey", "s_name") VALUES (' || s_suppkey || ', ''' || s_name || ''');' as value from supplier"""
ORACLE["sql_dump_grouped"] = """
select o_orderkey as id, cast('123456789012' || lpad(cast(o_custkey as varchar), 9, '0') || '.25' as decimal(30, 2)) as amount,
       o_orderpriority || '''s' as note from orders"""
ORACLE["json_mixed_documents"] = "select cast(s_suppkey as bigint) as s_suppkey, s_name from supplier"
ORACLE["json_array_ranges"] = """
select o_orderkey, o_orderpriority || ' "}], {' || o_orderstatus as note, o_totalprice as "price.o_totalprice" from orders"""
ORACLE["json_by_column"] = "select cast(c_custkey as bigint) as key, c_name as name from customer"
ORACLE["csv_ragged"] = """
select o_orderkey as id, o_orderpriority as note, case when o_orderkey % 7 != 0 then o_orderstatus end as more, cast(null as varchar) as aside
from orders where o_orderkey % 10 != 0
union all
select null, null, null, o_orderkey || ',' || o_orderpriority || ',' || o_orderstatus || ',"a,b",' from orders where o_orderkey % 10 = 0"""
ORACLE["sql_dump_crlf"] = """
select cast(c_custkey as bigint) as id, c_name || ';' || chr(13) || chr(10) || ' it''s' as name, cast(null as varchar) as aside from customer where c_custkey % 9 != 0
union all
select null, null, 'INSERT INTO c VALUES (now(), ' || c_custkey || ');' from customer where c_custkey % 9 = 0"""
_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
_counts = union([f"select '{t}' as name, cast({i} as integer) as position, count(*) as n from {t}" for i, t in enumerate(_TABLES)])
ORACLE["largest_table_of_all"] = f"select * from ({_counts}) order by n desc, position limit 1"
ORACLE["dataset_registry"] = """
select 'owner-1' as owner, 'orders' as name, 'synthetic' as mode, 'unknown' as model, 'parquet' as format,
       count(*) as rows, cast(6 as bigint) as columns, true as has_bytes from orders
union all
select 'owner-1', 'customers', 'realistic', 'unknown', 'csv', count(*), cast(5 as bigint), true from customer"""

# Records from text

ORACLE["json_repair"] = f"""
select o_orderkey as reply_id, {choose('o_orderkey', ["'records'"] * 8 + ["'empty'", "'empty'", "'malformed'"])} as status,
       cast({choose('o_orderkey', ['1', '1', '1', '1', '2', '1', '2', '2', '0', '0', '0'])} as bigint) as members
from orders"""
_MEMBERS = """members as (
  select o_orderkey as reply_id, cast(0 as integer) as position, o_orderkey, o_orderkey % 11 as v,
         case when o_orderkey % 11 <> 5 then o_orderstatus end as o_orderstatus,
         case when o_orderkey % 11 <> 5 then o_totalprice end as o_totalprice,
         case when o_orderkey % 11 = 5 then 'cut [o' else o_orderpriority end as note,
         case when o_orderkey % 11 = 5 then 'http://x.example.com/a' end as u
  from orders where o_orderkey % 11 < 8
  union all
  select o_orderkey, cast(1 as integer), o_orderkey, o_orderkey % 11, o_orderstatus, null, null, null from orders where o_orderkey % 11 in (4, 6))"""
ORACLE["extract_records"] = f"""
with {_MEMBERS}
select reply_id, position, cast(o_orderkey as varchar) as o_orderkey, o_orderstatus, note, u from members"""
ORACLE["skipped_members"] = """
select o_orderkey as reply_id, cast(0 as integer) as position, '1' as member from orders where o_orderkey % 11 = 7"""
ORACLE["reply_to_rows"] = f"""
with {_MEMBERS}
select reply_id, position, note, cast(o_orderkey as bigint) as o_orderkey, o_orderstatus, o_totalprice, u from members"""

# Synthesis


def word(name: str, i: int = 0) -> str:
    digest = f"md5('42:{name}:' || o_orderkey)"
    return f"cast('0x' || substr({digest}, {8 * i + 1}, 8) as bigint)"


def whole(name: str, lo: int, hi: int) -> str:
    return f"{lo} + {word(name)} % {hi - lo + 1}"


def real(name: str, lo: float, hi: float, digits: int) -> str:
    return f"round({float(lo)}::double + {word(name)} / 4294967295.0::double * ({float(hi - lo)}::double), {digits})"


_UID = "md5('42:uid:' || o_orderkey)"
ORACLE["synth_orders_like"] = f"""
select o_orderkey, o_orderkey + 1 as order_id, {whole('customer_age', 18, 99)} as customer_age, {whole('stock', 0, 500)} as stock,
       {real('total_price', 10, 10000, 2)} as total_price, {whole('points', 1, 1000)} as points, {real('weight', 0, 100, 2)} as weight,
       {word('is_gift')} % 2 = 0 as is_gift, date '1970-01-01' + cast({word('ordered')} % 20453 as integer) as ordered,
       {real('lat', -90, 90, 6)} as lat, {real('lon', -180, 180, 6)} as lon,
       substr({_UID}, 1, 8) || '-' || substr({_UID}, 9, 4) || '-4' || substr({_UID}, 14, 3) || '-'
         || substr('89ab', cast(cast('0x' || substr({_UID}, 17, 2) as bigint) % 4 + 1 as integer), 1)
         || substr({_UID}, 18, 3) || '-' || substr({_UID}, 21, 12) as uid,
       lpad(cast({word('zip')} % 100000 as varchar), 5, '0') as zip,
       case when o_orderkey < 9999 then 'EMP-' || lpad(cast(o_orderkey + 1 as varchar), 4, '0') else 'EMP-' || (o_orderkey + 1) end as badge
from orders"""

class People:
    """SQL for one synthetic column, drawn from md5 of seed, column name and customer key."""

    def __init__(self, type_name: str):
        self.name = type_name.replace(" ", "_")

    def digest(self, block: int = 0) -> str:
        return f"md5('7:{self.name}:' || c_custkey{f" || ':{block}'" if block else ''})"

    def word(self, i: int = 0) -> str:
        return f"cast('0x' || substr({self.digest(i // 4)}, {8 * (i % 4) + 1}, 8) as bigint)"

    def whole(self, lo: int, hi: int, i: int = 0) -> str:
        return f"({lo} + {self.word(i)} % {hi - lo + 1})"

    def real(self, lo: float, hi: float, digits: int) -> str:
        return f"round({float(lo)}::double + {self.word()} / 4294967295.0::double * ({float(hi - lo)}::double), {digits})"

    def pick(self, options: list[str], i: int = 0) -> str:
        return f"list_extract([{', '.join(repr(o) for o in options)}], {self.word(i)} % {len(options)} + 1)"

    def digits(self, size: int, i: int = 0) -> str:
        return f"lpad(cast({self.word(i)} % {10**size} as varchar), {size}, '0')"

    def letters(self, alphabet: str, size: int) -> str:
        both = f"({self.digest()} || {self.digest(1)})"
        at = f"cast('0x' || substr({both}, i * 2 + 1, 2) as bigint) % {len(alphabet)} + 1"
        return f"array_to_string(list_transform(range({size}), lambda i: substr('{alphabet}', cast({at} as integer), 1)), '')"

    def sentence(self, first: int = 0) -> str:
        text = " || ' ' || ".join(self.pick(v.WORDS, first + i) for i in range(6))
        return f"(upper(substr({text}, 1, 1)) || substr({text}, 2) || '.')"


def joined(*parts: str, by: str = " ") -> str:
    return f" || '{by}' || ".join(parts)


def people_sql() -> dict[str, str]:
    def at(type_name: str) -> People:
        return People(type_name)

    def handle(p: People) -> str:
        return f"lower({p.pick(v.FIRST_NAMES)} || '.' || {p.pick(v.LAST_NAMES, 1)} || c_custkey)"

    def domain(p: People) -> str:
        return f"{joined(p.pick(v.WORDS), p.pick(v.NOUNS, 1), by='-')} || '.' || {p.pick(v.DOMAINS, 2)}"

    def street(p: People) -> str:
        return joined(f"cast({p.whole(1, 999)} as varchar)", p.pick(v.STREETS, 1), p.pick(v.STREET_KINDS, 2))

    def moment(p: People) -> str:
        return f"(timestamp '1970-01-01' + to_seconds({p.word()} % {20453 * 86400}))"

    full = {t: joined(at(t).pick(v.FIRST_NAMES), at(t).pick(v.LAST_NAMES, 1)) for t in ("name", "full name")}
    card, iban, uid, mac = at("credit card"), at("iban"), at("uuid"), at("mac address")
    number = f"('400000' || {card.digits(9)})"
    digit = f"cast(substr({number}, cast(i as integer), 1) as bigint)"
    luhn = f"list_sum(list_transform(range(1, 16), lambda i: case when (15 - i) % 2 = 0 then case when {digit} * 2 > 9 then {digit} * 2 - 9 else {digit} * 2 end else {digit} end))"
    account = f"({iban.digits(9)} || {iban.digits(9, 1)})"
    simple = {
        "string": at("string").pick(v.WORDS),
        "word": at("word").pick(v.WORDS),
        "number": at("number").whole(1, 1000),
        "integer": at("integer").whole(1, 1000),
        "int": at("int").whole(1, 1000),
        "boolean": f"{at('boolean').word()} % 2 = 0",
        "date": f"date '1970-01-01' + cast({at('date').word()} % 20453 as integer)",
        "date of birth": f"date '2007-12-31' - cast({at('date of birth').word()} % (date '2007-12-31' - date '1934-12-31') as integer)",
        "first name": at("first name").pick(v.FIRST_NAMES),
        "last name": at("last name").pick(v.LAST_NAMES),
        "gender": at("gender").pick(v.GENDERS),
        "city": at("city").pick(v.CITIES),
        "country": at("country").pick(v.COUNTRIES),
        "state": at("state").pick(v.STATES),
        "color": at("color").pick(v.COLORS),
        "department": at("department").pick(v.DEPARTMENTS),
        "job title": at("job title").pick(v.JOBS),
        "company name": joined(at("company name").pick(v.LAST_NAMES), at("company name").pick(v.COMPANY_ENDINGS, 1)),
        "postal code": at("postal code").digits(5),
        "zip code": at("zip code").digits(5),
        "latitude": at("latitude").real(-90, 90, 6),
        "longitude": at("longitude").real(-180, 180, 6),
        "float": at("float").real(0, 100, 2),
        "decimal": at("decimal").real(0, 100, 2),
        "price": at("price").real(1, 1000, 2),
        "currency": f"cast({at('currency').real(1, 10000, 2)} as decimal(15,2))",
        "employee id": "case when c_custkey < 9999 then 'EMP-' || lpad(cast(c_custkey + 1 as varchar), 4, '0') else 'EMP-' || (c_custkey + 1) end",
        "email": f"{handle(at('email'))} || '@' || {at('email').pick(v.DOMAINS, 2)}",
        "username": handle(at("username")),
        "domain": domain(at("domain")),
        "url": f"'https://' || {domain(at('url'))} || '/'",
        "image url": f"'https://images.example.com/' || {at('image url').whole(200, 800)} || '/' || {at('image url').whole(200, 800, 1)}",
        "phone number": f"'(' || {at('phone number').whole(200, 999)} || ') 555-01' || {at('phone number').digits(2, 1)}",
        "ssn": f"{at('ssn').whole(900, 999)} || '-' || {at('ssn').digits(2, 1)} || '-' || {at('ssn').digits(4, 2)}",
        "street": street(at("street")),
        "address": f"{street(at('address'))} || ', ' || {at('address').pick(v.CITIES, 3)} || ', ' || {at('address').pick(v.STATES, 4)} || ' ' || {at('address').digits(5, 5)}",
        "ip address": f"{at('ip address').pick(['192.0.2.', '198.51.100.', '203.0.113.'])} || {at('ip address').whole(1, 254, 1)}",
        "mac address": "'02:' || " + joined(*[f"substr({mac.digest()}, {2 * i + 1}, 2)" for i in range(5)], by=":"),
        "sentence": at("sentence").sentence(),
        "description": at("description").sentence(),
        "paragraph": joined(*[at("paragraph").sentence(6 * i) for i in range(3)]),
        "slug": joined(*[at("slug").pick(v.WORDS, i) for i in range(3)], by="-"),
        "password": at("password").letters("abcdefghjkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789!#%+-=?@", 12),
        "bitcoin address": "'1' || " + at("bitcoin address").letters("123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz", 32),
        "datetime": moment(at("datetime")),
        "timestamp": moment(at("timestamp")),
        "time": f"strftime({moment(at('time'))}, '%H:%M:%S')",
        "credit card": f"{number} || cast((10 - {luhn} % 10) % 10 as varchar)",
        "iban": f"'DE' || lpad(cast(98 - cast({account} || '131400' as hugeint) % 97 as varchar), 2, '0') || {account}",
        "uuid": f"substr({uid.digest()}, 1, 8) || '-' || substr({uid.digest()}, 9, 4) || '-4' || substr({uid.digest()}, 14, 3) || '-' || "
        f"substr('89ab', cast(cast('0x' || substr({uid.digest()}, 17, 2) as bigint) % 4 + 1 as integer), 1) || "
        f"substr({uid.digest()}, 18, 3) || '-' || substr({uid.digest()}, 21, 12)",
    }
    return simple | full


ORACLE["synth_people"] = (
    "select c_custkey, " + ",\n".join(f'{sql} as "{t.replace(" ", "_")}"' for t, sql in sorted(people_sql().items())) + " from customer"
)

_CONTACT = People("reply_to")
_HANDLE = f"lower({_CONTACT.pick(v.FIRST_NAMES)} || '.' || {_CONTACT.pick(v.LAST_NAMES, 1)} || c_custkey)"
ORACLE["synth_preset"] = f"""
select c_custkey, {_HANDLE} || '@' || {_CONTACT.pick(v.DOMAINS, 2)} as reply_to, {People("delivery_city").pick(v.CITIES)} as delivery_city from customer"""

_SHOWN = {"s_suppkey": People("s_suppkey").whole(1, 1000), "s_nationkey": People("s_nationkey").whole(1, 1000), "s_acctbal": People("s_acctbal").real(0, 100, 2)}
ORACLE["synth_preview"] = f"select {', '.join(f'{sql} as {c}' for c, sql in _SHOWN.items())} from (select unnest(range(5)) as c_custkey) where exists (select 1 from supplier)"

# Conversations

ORACLE["has_table"] = r"select doc_id, regexp_matches(text, '\|.*\|.*\|') as has_table from documents"
_LAST4 = "last4 as (select * from conversations qualify row_number() over (partition by conv_id order by turn desc) <= 4)"
ORACLE["recent_history"] = f"with {_LAST4} select * from last4"
ORACLE["conversation_title"] = rf"""
select conv_id, coalesce(nullif(regexp_replace(substr(text, 1, 50), {_TRIM}), ''), 'New Chat') as title
from conversations qualify row_number() over (partition by conv_id order by turn) = 1"""
ORACLE["conversation_archive"] = """
select conv_id, cast(0 as bigint) as part, count(*) as n, arg_min(role, turn) as first_role, arg_min(text, turn) as first_text,
       arg_max(role, turn) as last_role, arg_max(text, turn) as last_text,
       string_agg(cast(turn as varchar), ',' order by turn) as turns
from conversations group by conv_id"""
ORACLE["archive_long_conversation"] = """
with placed as (
  select conv_id % 7 as conv_id, turn * 1000000 as turn, role, text,
         row_number() over (partition by conv_id % 7 order by turn, role, text) - 1 as place from conversations)
select conv_id, place // 100 as part, count(*) as n,
       sha256(string_agg(turn || ':' || role || ':' || text, chr(10) order by place)) as digest
from placed group by conv_id, place // 100"""
ORACLE["message_lists"] = f"""
with {_LAST4}, numbered as (
  select conv_id, row_number() over (partition by conv_id order by turn) as position, role, text,
         count(*) over (partition by conv_id) as n from last4)
select conv_id, cast(position as integer) as position, role, text as content from numbered
union all select distinct conv_id, cast(0 as integer), 'system', 'Answer with tables.' from numbered
union all select distinct conv_id, cast(n + 1 as integer), 'user', 'Now the rows.' from numbered"""
ORACLE["full_message_rows"] = """
select conv_id, cast(1 as integer) as section, turn, role, text as content from conversations
union all select distinct conv_id, cast(0 as integer), cast(0 as bigint), 'system', 'Answer with tables.' from conversations
union all select distinct conv_id, cast(2 as integer), cast(0 as bigint), 'user', 'Now the rows.' from conversations"""


def by_mode(values: list[str]) -> str:
    return choose("conv_id", values)


ORACLE["mode_params"] = f"""
select conv_id, turn, {by_mode(["'Synthetic'", "'real-time'", "'HYBRID'", "'live-data'", "'realistic'", "'odd'"])} as data_mode,
       {by_mode(["'synthetic'", "'realistic'", "'hybrid'", "'live_data'", "'realistic'", "'odd'"])} as normal_mode,
       {by_mode(["'creative'", "'balanced'", "'balanced'", "'precise'", "'balanced'", "'balanced'"])} as behavior,
       cast({by_mode(['0.9', '0.55', '0.55', '0.3', '0.55', '0.55'])} as double) as temperature,
       cast({by_mode(['0.95', '0.9', '0.9', '0.85', '0.9', '0.9'])} as double) as top_p
from conversations"""

# Usage

ORACLE["usage_minute"] = """
with counted as (select event_type, date_trunc('minute', ts) as window_start, count(*) as used,
                 cast(case event_type when 'view' then 2 else 1 end as bigint) as "limit" from events group by 1, 2)
select event_type, window_start, used, "limit", used > "limit" as over, greatest(used - "limit", 0) as rejected from counted"""


def first_hit(key: str, hours: int, limit: str) -> str:
    return f"""
with recursive chain as (
  select {key}, min(ts) as start from events group by {key}
  union all
  select c.{key}, min(e.ts) from chain c join events e on e.{key} = c.{key} and e.ts >= c.start + interval {hours} hours group by c.{key}, c.start),
counted as (
  select c.{key}, c.start as window_start, count(*) as used, cast({limit} as bigint) as "limit"
  from chain c join events e on e.{key} = c.{key} and e.ts >= c.start and e.ts < c.start + interval {hours} hours group by 1, 2)
select {key}, window_start, used, "limit", used > "limit" as over, greatest(used - "limit", 0) as rejected from counted"""


ORACLE["usage_first_hit"] = first_hit("user_id", 24, "2")
ORACLE["usage_first_hit_kinds"] = first_hit("event_type", 6, "case c.event_type when 'click' then 4 else 9 end")
ORACLE["usage_daily"] = """
with counted as (select user_id, event_type, cast(ts as date) as day, count(*) as used,
                 cast(case event_type when 'click' then 1 when 'view' then 2 else 3 end as bigint) as "limit" from events group by 1, 2, 3)
select user_id, event_type, day, used, "limit", used > "limit" as over, greatest(used - "limit", 0) as rejected from counted"""
ORACLE["usage_status"] = """
with grid as (select u.user_id, k.event_type from (select distinct user_id from events) u, (select unnest(['click', 'view', 'report']) as event_type) k)
select g.user_id, g.event_type, count(e.event_id) as used, cast(case g.event_type when 'report' then 20 else 120 end as bigint) as "limit"
from grid g left join events e on e.user_id = g.user_id and e.event_type = g.event_type and cast(e.ts as date) = date '2024-01-02'
group by g.user_id, g.event_type"""
ORACLE["sessions"] = """
with gaps as (
  select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) <= interval 30 minutes then 0 else 1 end as opens from events),
numbered as (select user_id, ts, sum(opens) over (partition by user_id order by ts rows unbounded preceding) as session from gaps)
select user_id, cast(session as bigint) as session, min(ts) as start, max(ts) as "end", count(*) as n,
       case when timestamp '2024-01-30 23:58:00' - max(ts) > interval 30 minutes then 'expired' else 'active' end as state
from numbered group by user_id, session"""
ORACLE["newest_per_owner"] = """
select *, cast(row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as integer) as rank
from orders qualify rank <= 3"""
ORACLE["newest_of_owner"] = """
select * from orders where o_custkey = (select o_custkey from orders group by o_custkey order by count(*) desc, o_custkey limit 1)
order by o_orderdate desc, o_orderkey desc limit 20"""
ORACLE["quota_count"] = """
select o_custkey, count(*) as n, cast(10 as bigint) as "limit", count(*) >= 10 as "full" from orders group by o_custkey"""
ORACLE["owned_runs"] = """
select * from orders where o_custkey in (select c_custkey from customer where c_acctbal > 0)"""
_IDENTITY = """signed as (
  select distinct o_orderstatus as provider, cast(o_custkey as varchar) as provider_id, 'customer' || o_custkey || '@example.com' as email,
         o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING') as known,
         o_orderstatus = 'F' and o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING' and c_acctbal > 0) as linked
  from orders),
placed as (select *, case when known then 'user-' || provider_id else 'u-' || substr(sha256(email), 1, 32) end as user_id from signed)"""
ORACLE["identity_link"] = f"with {_IDENTITY} select provider, provider_id, email, user_id, not known as is_new from placed"
ORACLE["identity_new_links"] = f"with {_IDENTITY} select user_id, provider, provider_id from placed where not linked"

# Wide rows, exact values

_WIDE = f"""base as (select ts, user_id, event_type, value, {', '.join(f'user_id + {i} as c{i}' for i in range(16))} from events),
wide as (select * from base union all select * replace (ts + interval 1 microsecond as ts) from base union all select * from base)"""
ORACLE["duplicate_rows_wide"] = f"""
with {_WIDE}, per as (select count(*) as n from wide group by ts, user_id, event_type, value, {', '.join(f'c{i}' for i in range(16))})
select cast(sum(n) as bigint) as rows, cast(sum(n) - count(*) as bigint) as duplicates from per"""
ORACLE["distinct_nested"] = f"""
with {_WIDE}
select 'at' as "column", count(*) as n, cast(0 as bigint) as missing, count(distinct (ts, user_id)) as "distinct" from wide
union all select 'zoned', count(*), cast(0 as bigint), count(distinct ts) from wide
union all select 'zero', count(*), cast(0 as bigint), count(distinct user_id) from wide
union all select 'map', count(*), cast(0 as bigint), count(distinct user_id) from wide"""
ORACLE["duplicate_rows_approx"] = f"""
with {_WIDE} select count(*) as rows, true as near, true as narrow from wide"""
ORACLE["parse_large_numbers"] = f"""
select o_orderkey, {choose("o_orderkey", ["o_orderkey + 9007199254740993", "o_orderkey + 9007199254740993", "-(o_orderkey + 9007199254740993)", "null", "o_orderkey + 9007199254740993", "o_orderkey + 9007199254740993"])} as as_long from orders"""
ORACLE["iso_texts"] = """
select event_id, strftime(ts, '%Y-%m-%d') as day, strftime(ts, '%Y-%m-%dT%H:%M:%S') as moment from events"""
ORACLE["csv_quoted_breaks"] = """
select event_id + 1234567890123456789 as id, (event_id + 1234567890123456789) || '5' as longer,
       event_type || chr(10) || 'said "' || event_id || '"' as note from events"""
_EXACT = """
with shifted as (select event_id, strftime(ts + to_microseconds(event_id % 1000), '%Y-%m-%dT%H:%M:%S.%f') as ts, value from events)
select event_id, ts, ts as zoned, case when event_id % 7 != 0 and event_id % 11 != 0 then value end as value from shifted"""
ORACLE["json_roundtrip_exact"] = ORACLE["csv_roundtrip_exact"] = ORACLE["sql_dump_roundtrip_exact"] = _EXACT

# Report


def melt(section: str, item: str, metrics: list[str], base: str) -> str:
    return union(
        [f"""select '{section}' as section, {item} as item, '{m}' as metric, cast({m} as varchar) as value from ({base}) b""" for m in metrics]
    )


def report_sql() -> str:
    numerics, texts = ["c_custkey", "c_nationkey", "c_acctbal"], ["c_name", "c_mktsegment"]
    percent = "cast(round(100.0 * {0}, 2) as double)"
    types = {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"}
    counted = """
      select count(*) as rows, 5 as columns, 3 as numeric_columns, 2 as categorical_columns, 0 as missing_values, 0.0::double as missing_pct,
             count(*) - (select count(*) from (select distinct * from customer)) as duplicates,
             cast(sum(20 + strlen(c_name) + strlen(c_mktsegment)) as bigint) as data_bytes from customer"""
    summary = f"select *, {size_label('data_bytes')} as size_label from ({counted})"
    columns = union(
        [
            f"""select {i} as position, '{c}' as col, '{t}' as type, '{'numeric' if c in numerics else 'categorical'}' as role, 0 as missing,
            0.0::double as missing_pct, count(distinct {c}) as "distinct" from customer"""
            for i, (c, t) in enumerate(types.items())
        ]
    )
    stats = union(
        [
            f"""select '{c}' as col, count(*) as n, {stat(f'avg({c})')} as mean, {stat(f'median({c})')} as median,
            {stat(f'stddev_samp({c})')} as std, {stat(f'min({c})')} as min, {stat(f'max({c})')} as max, {stat(f'quantile_cont({c}, 0.25)')} as q25,
            {stat(f'quantile_cont({c}, 0.75)')} as q75, {stat(f'skewness({c})')} as skew, 'ok' as status from doubles"""
            for c in numerics
        ]
    )
    bins = union(
        [
            f"""select '{c}' as col, i as bin, round(i * step + start, 3) as lo, round(case when i = 24 then stop else (i + 1) * step + start end, 3) as hi,
            (select count(*) from doubles where {c} >= i * step + start and ({c} < (i + 1) * step + start or i = 24)) as n
            from (select min({c}) as start, max({c}) as stop, (max({c}) - min({c})) / 25 as step from doubles) e, range(25) r(i)"""
            for c in numerics
        ]
    )
    tops = top_sql("customer", texts, 8)
    pie = f"""select * from ({tops}) where "column" = (
        select c from (select 0 as i, 'c_name' as c, count(distinct c_name) as n from customer
                       union all select 1, 'c_mktsegment', count(distinct c_mktsegment) from customer) where n <= 8 order by i limit 1)"""
    pairs = union([f"select '{a}' as column_a, '{b}' as column_b, {r_sql(a, b)} as r from doubles" for a, b in combinations(numerics, 2)])
    sample = "select c_custkey as key, * from doubles order by md5('42:' || cast(c_custkey as bigint)), c_custkey limit 500"
    scatters = union(
        [
            f"""select '{a}' as column_a, '{b}' as column_b, cast(key as bigint) as key, round({a}, 3) as x, round({b}, 3) as y from ({sample})"""
            for a, b in combinations(numerics, 2)
        ]
    )
    fenced = union(
        [
            f"""select '{c}' as col, q1, med as median, q3, q3 - q1 as iqr, q1 - 1.5 * (q3 - q1) as lower_fence, q3 + 1.5 * (q3 - q1) as upper_fence,
            (select min({c}) from doubles) as min, (select max({c}) from doubles) as max,
            (select min({c}) from doubles where {c} >= q1 - 1.5 * (q3 - q1)) as lower_whisker,
            (select max({c}) from doubles where {c} <= q3 + 1.5 * (q3 - q1)) as upper_whisker,
            (select count(*) from doubles where {c} < q1 - 1.5 * (q3 - q1) or {c} > q3 + 1.5 * (q3 - q1)) as outlier_count, n
            from (select quantile_cont({c}, 0.25) as q1, median({c}) as med, quantile_cont({c}, 0.75) as q3, count(*) as n from doubles)"""
            for c in numerics
        ]
    )
    measures = ["q1", "median", "q3", "iqr", "lower_fence", "upper_fence", "min", "max", "lower_whisker", "upper_whisker"]
    rounded = ", ".join(f"round({c}, 3) as {c}" for c in measures)
    boxes = f"select col, {rounded}, outlier_count, {percent.format('outlier_count / n')} as outlier_pct, 'ok' as status from ({fenced})"
    ranked = "\"column\" || '/' || rank"
    parts = [
        melt("summary", "'table'", "rows columns numeric_columns categorical_columns missing_values missing_pct duplicates data_bytes size_label".split(), summary),
        melt("columns", "col", ["position", "type", "role", "missing", "missing_pct", '"distinct"'], columns).replace("'\"distinct\"'", "'distinct'"),
        melt("numeric_stats", "col", "n mean median std min max q25 q75 skew status".split(), stats),
        melt("histograms", "col || '/' || bin", ["lo", "hi", "n"], bins),
        melt("bar_charts", ranked, ["value", "n"], tops),
        melt("pie_chart", ranked, ["value", "n"], pie),
        melt("correlation", "column_a || '/' || column_b", ["\"row\"", "\"col\"", "r"], matrix_sql("doubles", numerics)).replace("'\"row\"'", "'row'").replace("'\"col\"'", "'col'"),
        melt("top_correlations", "column_a || '/' || column_b", ["strength", "r"], f"select *, abs(r) as strength from ({pairs})"),
        melt("scatters", "column_a || '/' || column_b || '/' || key", ["x", "y"], scatters),
        melt("box_plots", "col", "min q1 median q3 max lower_whisker upper_whisker outlier_count status".split(), boxes),
        melt("outliers", "col", "q1 q3 iqr lower_fence upper_fence outlier_count outlier_pct min max median status".split(), boxes),
        melt("categoricals", ranked, ["value", "n"], f"select * from ({tops}) where rank <= 5"),
    ]
    doubles = ", ".join(f"cast({c} as double) as {c}" for c in numerics)
    return f"with doubles as (select {doubles} from customer) " + union(parts)


ORACLE["report"] = report_sql()
