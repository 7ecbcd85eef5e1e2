"""Relational queries: one text for Spark and for the SQL that checks it."""

from __future__ import annotations

#: name -> (tables, text). The text is ANSI SQL that both engines read.
SHARED: dict[str, tuple[str, str]] = {
    "inner_join": ("orders customer", """
        select c.c_mktsegment, count(*) as n_orders, round(sum(o.o_totalprice), 2) as total
        from orders o join customer c on o.o_custkey = c.c_custkey group by c.c_mktsegment"""),
    "left_join": ("customer orders", """
        select c.c_custkey, count(o.o_orderkey) as n_orders from customer c left join orders o on o.o_custkey = c.c_custkey and o.o_orderstatus = 'F'
        group by c.c_custkey"""),
    "right_join": ("customer orders", """
        select c.c_custkey, count(o.o_orderkey) as n_orders from orders o right join customer c on o.o_custkey = c.c_custkey and o.o_totalprice > 200000
        group by c.c_custkey"""),
    "full_join": ("supplier customer", """
        select coalesce(s.k, c.k) as nation, s.n as suppliers, c.n as customers
        from (select s_nationkey as k, count(*) as n from supplier where s_acctbal > 0 group by s_nationkey) s
        full join (select c_nationkey as k, count(*) as n from customer where c_acctbal < 0 group by c_nationkey) c on s.k = c.k"""),
    "semi_join": ("customer orders", """
        select c_custkey, c_name from customer c where exists (select 1 from orders o where o.o_custkey = c.c_custkey and o.o_orderpriority = '1-URGENT')"""),
    "anti_join": ("customer orders", """
        select c_custkey, c_name from customer c where not exists (select 1 from orders o where o.o_custkey = c.c_custkey and o.o_orderstatus = 'F')"""),
    "cross_join": ("region nation", """
        select r.r_name, n.n_name from region r cross join nation n"""),
    "multi_join": ("lineitem orders customer nation region", """
        select r.r_name, n.n_name, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) as revenue, count(*) as n
        from lineitem l join orders o on l.l_orderkey = o.o_orderkey join customer c on o.o_custkey = c.c_custkey
        join nation n on c.c_nationkey = n.n_nationkey join region r on n.n_regionkey = r.r_regionkey group by r.r_name, n.n_name"""),
    "group_by_having": ("lineitem", """
        select l_suppkey, count(*) as n, round(sum(l_quantity), 2) as qty from lineitem group by l_suppkey having count(*) > 590"""),
    "pricing_summary": ("lineitem", """
        select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice), 2) as sum_base,
          round(sum(l_extendedprice * (1 - l_discount)), 2) as sum_disc, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) as sum_charge,
          round(avg(l_quantity), 4) as avg_qty, round(avg(l_discount), 4) as avg_disc, count(*) as n
        from lineitem where l_shipdate <= timestamp '1998-09-02 00:00:00' group by l_returnflag, l_linestatus"""),
    "cube": ("lineitem", """
        select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 2) as qty from lineitem group by cube(l_returnflag, l_linestatus)"""),
    "rollup": ("lineitem", """
        select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 2) as qty from lineitem group by rollup(l_returnflag, l_linestatus)"""),
    "grouping_sets": ("orders", """
        select o_orderstatus, o_orderpriority, count(*) as n from orders group by grouping sets ((o_orderstatus), (o_orderpriority), ())"""),
    "count_distinct": ("lineitem", """
        select l_returnflag, count(distinct l_suppkey) as suppliers, count(distinct l_partkey) as parts from lineitem group by l_returnflag"""),
    "distinct_rows": ("lineitem", "select distinct l_returnflag, l_linestatus, l_linenumber from lineitem"),
    "filtered_aggregates": ("orders", """
        select o_orderpriority, count(*) filter (where o_orderstatus = 'F') as f, count(*) filter (where o_orderstatus <> 'F') as other from orders group by o_orderpriority"""),
    "row_number_rank": ("orders", """
        select o_orderkey, cast(row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as bigint) as rn,
          cast(rank() over (partition by o_custkey order by o_orderstatus) as bigint) as rk, cast(dense_rank() over (partition by o_custkey order by o_orderstatus) as bigint) as dr from orders"""),
    "lag_lead": ("events", """
        select event_id, lag(event_id) over (partition by user_id order by ts, event_id) as before, lead(event_id) over (partition by user_id order by ts, event_id) as after from events"""),
    "running_sum": ("orders", """
        select o_orderkey, round(sum(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey rows between unbounded preceding and current row), 2) as running from orders"""),
    "moving_average": ("events", """
        select event_id, round(avg(value) over (partition by user_id order by ts, event_id rows between 3 preceding and 1 following), 4) as smooth from events"""),
    "range_frame": ("lineitem", """
        select l_orderkey, l_linenumber, l_partkey, count(*) over (partition by l_suppkey order by l_quantity range between 2 preceding and 2 following) as near from lineitem"""),
    "ntile_percent": ("customer", """
        select c_custkey, cast(ntile(4) over (partition by c_mktsegment order by c_acctbal, c_custkey) as bigint) as quarter,
          round(percent_rank() over (partition by c_mktsegment order by c_acctbal), 6) as pr, round(cume_dist() over (partition by c_mktsegment order by c_acctbal), 6) as cd from customer"""),
    "first_last_value": ("orders", """
        select o_orderkey, first_value(o_orderkey) over w as first_key, last_value(o_orderkey) over w as last_key from orders
        window w as (partition by o_custkey order by o_orderdate, o_orderkey rows between unbounded preceding and unbounded following)"""),
    "topk_per_group": ("orders", """
        select * from (select o_custkey, o_orderkey, o_totalprice, cast(row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as bigint) as rn from orders) x where rn <= 3"""),
    "order_limit": ("lineitem", """
        select l_orderkey, l_linenumber, l_partkey, l_extendedprice from lineitem order by l_extendedprice desc, l_orderkey, l_linenumber, l_partkey limit 25"""),
    "union_all": ("customer supplier", """
        select c_nationkey as k, 'customer' as kind from customer union all select s_nationkey, 'supplier' from supplier"""),
    "union_distinct": ("customer supplier", "select c_nationkey as k from customer union select s_nationkey from supplier"),
    "intersect": ("lineitem", "select l_partkey from lineitem where l_returnflag = 'R' intersect select l_partkey from lineitem where l_linestatus = 'O'"),
    "except": ("part lineitem", "select p_partkey as k from part except select l_partkey from lineitem where l_quantity > 45"),
    "except_all": ("lineitem", "select l_returnflag, l_linestatus from lineitem except all select l_returnflag, l_linestatus from lineitem where l_quantity < 25"),
    "intersect_all": ("lineitem", "select l_suppkey from lineitem where l_quantity > 25 intersect all select l_suppkey from lineitem where l_returnflag = 'A'"),
    "correlated_subquery": ("part lineitem", """
        select p_partkey, (select max(l_quantity) from lineitem l where l.l_partkey = p.p_partkey) as most from part p"""),
    "scalar_subquery": ("customer", "select c_custkey from customer where c_acctbal > (select avg(c_acctbal) from customer)"),
    "in_subquery": ("orders customer", "select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')"),
    "cte": ("orders", """
        with spend as (select o_custkey, sum(o_totalprice) as s from orders group by o_custkey), big as (select * from spend where s > (select avg(s) from spend))
        select o_custkey, round(s, 2) as s from big"""),
    "case_when": ("part", """
        select case when p_size < 10 then 'small' when p_size < 30 then 'middle' else 'large' end as kind, count(*) as n, min(p_retailprice) as lo from part
        group by case when p_size < 10 then 'small' when p_size < 30 then 'middle' else 'large' end"""),
    "null_logic": ("lineitem", """
        select l_linenumber, count(nullif(l_discount, 0)) as discounted, cast(sum(case when nullif(l_discount, 0) is null then 1 else 0 end) as bigint) as plain,
          round(sum(coalesce(nullif(l_tax, 0), 1)), 4) as tax from lineitem group by l_linenumber"""),
    "string_functions": ("customer", """
        select c_custkey, upper(c_name) as up, lower(c_mktsegment) as low, cast(length(c_name) as bigint) as n, substring(c_name, 1, 8) as head, trim(concat('  ', c_name, ' ')) as t,
          replace(c_name, '#', '-') as r, lpad(cast(c_custkey as varchar(20)), 8, '0') as padded, concat_ws('/', c_name, c_mktsegment) as both, reverse(c_mktsegment) as back from customer"""),
    "math_functions": ("lineitem", """
        select l_orderkey, l_linenumber, l_partkey, round(sqrt(l_quantity), 6) as r, cast(floor(l_extendedprice / 100) as bigint) as f, abs(l_discount - l_tax) > 0.02 as far,
          round(ln(l_extendedprice), 6) as g, round(power(l_discount, 2), 6) as p, l_partkey % 7 as m from lineitem"""),
    "date_functions": ("orders", """
        select o_orderkey, cast(extract(year from o_orderdate) as bigint) as y, cast(extract(month from o_orderdate) as bigint) as m, cast(extract(day from o_orderdate) as bigint) as d, cast(date_trunc('month', o_orderdate) as date) as first,
          cast(o_orderdate as date) as day from orders"""),
    "range_join": ("events", """
        select b.k, count(*) as n from (select 0.0 as lo, 100.0 as hi, 'a' as k union all select 100.0, 300.0, 'b' union all select 300.0, 500.0, 'c') b
        join events e on e.value >= b.lo and e.value < b.hi group by b.k"""),
    "event_types_by_user": ("events", """
        select user_id, count(*) as n, count(distinct event_type) as kinds, round(max(value), 2) as top, min(ts) as first_ts from events group by user_id"""),
    "assert_condition": ("orders", """
        select o_orderkey from orders where not coalesce(nullif(o_orderstatus, 'P') <> 'F', false)"""),
}

#: name -> (tables, Spark text, other text) where the two texts differ.
SPELLED: dict[str, tuple[str, str, str]] = {
    "asof_join": ("lineitem orders", """
        select l.l_orderkey, l.l_linenumber, l.l_partkey, max_by(o.o_orderkey, struct(o.o_orderdate, o.o_orderkey)) as next_order
        from (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate from lineitem) l
        join (select o_orderkey, o_custkey, o_orderdate from orders) o on l.l_suppkey = o.o_custkey and o.o_orderdate <= l.l_shipdate
        group by l.l_orderkey, l.l_linenumber, l.l_partkey""", """
        select l_orderkey, l_linenumber, l_partkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as next_order
        from lineitem join orders on l_suppkey = o_custkey and o_orderdate <= l_shipdate group by l_orderkey, l_linenumber, l_partkey"""),
    "tumbling_window": ("events", """
        select window(ts, '1 hour').start as start, event_type, count(*) as n, round(sum(value), 2) as total from events group by window(ts, '1 hour'), event_type""", """
        select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n, round(sum(value), 2) as total from events group by 1, 2"""),
    "sliding_window": ("events", """
        select window(ts, '2 hours', '1 hour').start as start, count(*) as n from events group by window(ts, '2 hours', '1 hour')""", """
        select s as start, count(*) as n from (select unnest([time_bucket(interval '1 hour', ts), time_bucket(interval '1 hour', ts) - interval '1 hour']) as s from events) group by s"""),
    "session_window": ("events", """
        select user_id, session_window(ts, '6 hours').start as start, count(*) as n from events group by user_id, session_window(ts, '6 hours')""", """
        select user_id, min(ts) as start, count(*) as n from (
          select *, sum(new) over (partition by user_id order by ts, event_id) as s from (
            select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval '6 hours' then 0 else 1 end as new from events))
        group by user_id, s"""),
    "props_json": ("events", """
        select cast(get_json_object(props, '$.k') as bigint) as k, count(*) as n from events group by 1""", """
        select cast(json_extract_string(props, '$.k') as bigint) as k, count(*) as n from events group by 1"""),
    "array_functions": ("documents", """
        select doc_id, cast(size(split(text, ' ')) as bigint) as n, element_at(split(text, ' '), 1) as head, array_join(slice(split(text, ' '), 1, 3), '_') as three,
          array_contains(split(text, ' '), 'the') as has_the, cast(size(array_distinct(split(text, ' '))) as bigint) as kinds from documents""", """
        select doc_id, len(string_split(text, ' ')) as n, string_split(text, ' ')[1] as head, array_to_string(string_split(text, ' ')[1:3], '_') as three,
          list_contains(string_split(text, ' '), 'the') as has_the, len(list_distinct(string_split(text, ' '))) as kinds from documents"""),
    "text_lengths": ("documents", """
        select lang, count(*) as n, sum(length(text)) as chars, cast(max(size(split(text, '\\n'))) as bigint) as most_lines from documents group by lang""", """
        select lang, count(*) as n, cast(sum(length(text)) as bigint) as chars, max(len(string_split(text, chr(10)))) as most_lines from documents group by lang"""),
    "map_functions": ("orders", """
        select o_custkey, map_from_entries(array_sort(collect_list(struct(cast(o_orderkey as string), o_orderstatus))))[cast(max(o_orderkey) as string)] as last_status from orders group by o_custkey""", """
        select o_custkey, arg_max(o_orderstatus, o_orderkey) as last_status from orders group by o_custkey"""),
    "date_arithmetic": ("orders", """
        select o_orderkey, date_add(cast(o_orderdate as date), 30) as due, cast(datediff(date '1999-01-01', cast(o_orderdate as date)) as bigint) as age from orders""", """
        select o_orderkey, cast(o_orderdate as date) + 30 as due, date_diff('day', cast(o_orderdate as date), date '1999-01-01') as age from orders"""),
}
