"""SQL that gives the same rows as the registered query of the same name."""

from __future__ import annotations

from batchloom import fixed_values as fixed

_EVENTS = """
    select 'b1' as batch_id, l_orderkey as event_id, l_returnflag as category,
           cast(l_quantity as integer) as quantity, l_extendedprice as unit_price
    from lineitem
"""

_ORDERS = """
    select 'b2' as batch_id, o_orderkey as event_id, o_orderpriority as category,
           1 as quantity, o_totalprice as unit_price
    from orders
"""


def _enriched(rows: str) -> str:
    return f"""
        select *, cast(quantity as double) * unit_price as line_total,
               case when quantity >= 6 then 'bulk' else 'standard' end as quantity_band
        from ({rows})
    """


_B = _enriched(_EVENTS)
_BOTH = f"{_EVENTS} union all {_ORDERS}"

_MEASURES = """
    count(*) as event_count, cast(sum(quantity) as bigint) as total_quantity,
    round(sum(line_total), 2) as revenue
"""

_WITH_SALES = f"""
    {_EVENTS} union all select * from (values
        ('b2', 101, 'electronics', 2, 2499.00::double),
        ('b2', 102, 'electronics', 1, 4999.00::double),
        ('b2', 201, 'grocery', 5, 120.00::double),
        ('b2', 202, 'grocery', 3, 250.00::double),
        ('b2', 301, 'household', 4, 450.00::double))
"""

# Sums and averages in whole cents: no tie can round differently.
_CENTS = "cast(round({0} * 100) as hugeint)"
_EXACT_REVENUE = f"cast(sum({_CENTS.format('line_total')}) as double) / 100 as revenue"
_EXACT_AVERAGE = (
    f"cast((2 * sum({_CENTS.format('unit_price')}) + count(*)) // (2 * count(*)) as double)"
    " / 100 as average_price"
)


def _exact(count: str) -> str:
    return (
        f"count(*) as {count}, cast(sum(quantity) as bigint) as total_quantity, "
        f"{_EXACT_REVENUE}, {_EXACT_AVERAGE}"
    )


def _generated(id_: str) -> str:
    cases = " ".join(f"when {i} then '{name}'" for i, name in enumerate(fixed.CATEGORIES))
    return f"""
        {id_} as event_id, case {id_} % 4 {cases} end as category,
        cast(1 + {id_} % 10 as integer) as quantity,
        cast(50 + (({id_} * 37) % 10000) / 10.0 as double) as unit_price
    """


_RANGE = f"select {_generated('o_orderkey')} from (select distinct o_orderkey from orders)"

_PHASE = """
    case event_type when 'error' then 'Failed' when 'signup' then 'Pending'
         else 'Running' end
"""

_HOURLY = f"""
    select 'y' || year(ts) as run_id, date_trunc('hour', ts) as poll_ts,
           cast(user_id as varchar) as worker, {_PHASE} as phase
    from events
"""

_LOG = "select cast(user_id as varchar) as source, ts, event_id, props as line from events"

_OBJECT_EVENTS = """
    select cast(user_id as varchar) as object, event_type as reason, props as message,
           case when event_type = 'error' then 'Warning' else 'Normal' end as type
    from events
"""

_FAILED_WORKERS = "select cast(user_id as varchar) from events where event_type = 'error'"


def _streak(run: str, limit: int) -> str:
    return f"""
        with polls as (
            select {run} as run_id, ts as poll_ts,
                   bool_and(event_type = 'error') as bad
            from events group by 1, 2
        ), islands as (
            select *, sum(case when bad then 0 else 1 end)
                      over (partition by run_id order by poll_ts) as island
            from polls
        ), streaks as (
            select *, row_number() over (partition by run_id, island order by poll_ts) as length
            from islands where bad
        )
        select run_id, min(poll_ts) as fired from streaks where length = {limit} group by 1
    """


def _tail(rows: str, n: int) -> str:
    return f"""
        select source, ts, event_id, line from (
            select *, row_number() over (partition by source order by ts desc, event_id desc) as rn
            from ({rows})
        ) where rn <= {n}
    """


_RUN_SUMMARY = f"select batch_id, category, {_MEASURES} from ({_B}) group by 1, 2"

_CATEGORY_SUMMARY = f"""
    select category, count(*) as product_count,
           cast(sum(quantity) as bigint) as total_quantity,
           round(sum(line_total), 2) as revenue,
           round(avg(unit_price), 2) as average_price
    from ({_B}) group by 1
"""

_ROLLUP = f"""
    select run_id, poll_ts, count(*) as total,
           count(*) filter (where phase = 'Running') as running,
           count(*) filter (where phase = 'Pending') as pending,
           count(*) filter (where phase = 'Failed') as failed
    from ({_HOURLY}) group by 1, 2
"""

ORACLES: dict[str, str] = {
    "external_table_scan": "select * from lineitem",
    "sql_table_scan": f"select event_id, category, line_total, quantity_band from ({_B})",
    "zero_row_probe": "select * from lineitem limit 0",
    "generate_rows": _RANGE,
    "generate_summary": (
        f"select 'b1' as batch_id, category, {_exact('event_count')} "
        f"from ({_enriched(_RANGE)}) group by 1, 2"
    ),
    "events_from_keys": f"select 'b1' as batch_id, {_generated('o_orderkey')} from orders",
    "literal_rows_append": f"""
        select batch_id, category, {_exact('product_count')}
        from ({_enriched(_WITH_SALES)}) group by 1, 2
    """,
    "append_readback": _RUN_SUMMARY,
    "append_two_batches": (
        f"select batch_id, category, {_MEASURES} from ({_enriched(_BOTH)}) group by 1, 2"
    ),
    "partitioned_readback": _ORDERS,
    "replaced_batch_readback": (
        f"select batch_id, category, {_MEASURES} from ({_enriched(_BOTH)}) group by 1, 2"
    ),
    "mixed_files_readback": """
        select 'c' || o_custkey as batch_id, o_orderkey as event_id,
               o_orderpriority as category, 1 as quantity, o_totalprice as unit_price
        from orders where o_custkey = 77
    """,
    "insert_select": f"select 'b1' as batch_id, {_generated('o_orderkey')} from orders",
    "select_columns": """
        select 'b1' as batch_id, l_orderkey as event_id, l_linenumber,
               l_quantity * l_extendedprice as line_total
        from lineitem
    """,
    "enrich_batch": _B,
    "filter_line_total": (
        f"select event_id, line_total from ({_B}) where line_total >= 1000000"
    ),
    "filter_large_sales": f"""
        select event_id, category, quantity, unit_price, line_total
        from ({_B}) where line_total >= 1000
    """,
    "filter_batch": """
        select l_linestatus as batch_id, l_orderkey as event_id
        from lineitem where l_linestatus = 'F'
        union all
        select o_orderstatus, o_orderkey from orders where o_orderstatus = 'F'
    """,
    "summary_by_category": f"""
        select batch_id, category, {_MEASURES}, round(avg(unit_price), 2) as average_price
        from ({_B}) group by 1, 2
    """,
    "category_summary": _CATEGORY_SUMMARY,
    "sales_category_summary": _CATEGORY_SUMMARY,
    "sales_all_rows": f"""
        select batch_id, event_id as product_id, category, quantity, unit_price
        from ({_WITH_SALES})
    """,
    "summary_by_band": f"""
        select batch_id, category, quantity_band, {_exact('event_count')}
        from ({_B}) group by 1, 2, 3
    """,
    "summary_by_part": f"""
        select batch_id, category, {_exact('event_count')} from ({_enriched('''
            select 'b1' as batch_id, cast(l_partkey as varchar) as category,
                   cast(l_quantity as integer) as quantity, l_extendedprice as unit_price
            from lineitem
        ''')}) group by 1, 2
    """,
    "row_count": "select count(*) as n from lineitem",
    "audit_counts": f"""
        select count(*) as input_rows, count(distinct category) as group_count from ({_B})
    """,
    "sort_asc": _B,
    "sort_desc": _B,
    "top_k": f"""
        select event_id, line_total from ({_B}) order by line_total desc, event_id limit 20
    """,
    "top_k_large": """
        select l_orderkey, l_linenumber, unit_price, unit::int as unit from (
            select l_orderkey, l_linenumber,
                   cast(round(l_extendedprice / l_quantity) as bigint) as unit_price,
                   unnest(range(1, cast(l_quantity as integer) + 1)) as unit
            from lineitem
        ) order by unit_price desc, l_orderkey, l_linenumber, unit limit 100000
    """,
    "top_k_large_text": f"""
        select event_id, category || '-' || quantity as label from ({_EVENTS})
        order by label, event_id limit 20000
    """,
    "repartition_rows": _B,
    "repartition_summary": _RUN_SUMMARY,
    "pmod_case_round": f"""
        select l_orderkey, l_orderkey % 4 as bucket, (7 - l_orderkey % 7) % 7 as negative_bucket,
               case l_orderkey % 4 when 0 then 'electronics' when 1 then 'grocery'
                    when 2 then 'household' else 'farm' end as label,
               cast((2 * {_CENTS.format('l_extendedprice')} + cast(l_quantity as bigint))
                    // (2 * cast(l_quantity as bigint)) as double) / 100 as price_per_unit
        from lineitem
    """,
    "casts_and_arithmetic": """
        select l_orderkey, l_orderkey * 37 + 50 as scaled,
               cast(((l_orderkey * 37) % 10000) / 10.0 as double) as tenths,
               cast(l_quantity as integer) as as_int, cast(l_quantity as bigint) as as_long,
               cast(l_linenumber as double) as as_double,
               l_linenumber * l_extendedprice as promoted,
               l_quantity >= 25 as at_least, l_returnflag = 'R' as equal, 'constant' as text
        from lineitem
    """,
    "batch_run_summary": _RUN_SUMMARY,
    "batch_run_partitioned": _RUN_SUMMARY,
    "batch_run_report": f"""
        select count(*) as input_rows, count(distinct category) as group_count from ({_B})
    """,
    "sales_report": f"""
        select event_id as product_id, category, quantity, unit_price, line_total
        from ({_B}) where line_total >= 1000000
    """,
    "status_rollup": _ROLLUP,
    "status_rollup_stream": _ROLLUP,
    "failed_workers_stream": f"""
        select distinct run_id, worker from ({_HOURLY}) where phase = 'Failed'
    """,
    "distinct_workers": f"""
        select run_id, count(distinct worker) as distinct_workers from ({_HOURLY}) group by 1
    """,
    "resource_summary": f"""
        with polls as (
            select run_id, poll_ts, count(*) filter (where phase = 'Running') as running
            from ({_HOURLY}) group by 1, 2
        ), peaks as (
            select run_id, max(running) as peak_running from polls group by 1
        ), workers as (
            select run_id, count(distinct worker) as distinct_workers from ({_HOURLY}) group by 1
        )
        select run_id, distinct_workers, peak_running, 2 * peak_running as peak_slots
        from peaks join workers using (run_id)
    """,
    "first_failure": """
        select run_id, worker, first_failed from (
            select cast(user_id as varchar) as run_id, cast(user_id as varchar) as worker,
                   ts as first_failed,
                   row_number() over (partition by user_id order by ts, event_id) as rn
            from events where event_type = 'error'
        ) where rn = 1
    """,
    "streak_guard": _streak("cast(user_id as varchar)", 3),
    "streak_guard_one_run": _streak("'y' || year(ts)", 4),
    "tail_n": _tail(_LOG, 3),
    "latest_line": _tail(_LOG, 1),
    "tail_one_source": _tail(
        "select 'y' || year(ts) as source, ts, event_id, props as line from events", 80
    ),
    "object_events": f"select object, type, reason, message from ({_OBJECT_EVENTS})",
    "one_object_events": f"""
        select type, reason, message from ({_OBJECT_EVENTS})
        where object = (select min(object) from ({_OBJECT_EVENTS}))
    """,
    "failed_object_events": f"""
        select object, type, reason, message from ({_OBJECT_EVENTS})
        where object in ({_FAILED_WORKERS})
    """,
    "failed_worker_tail": _tail(f"select * from ({_LOG}) where source in ({_FAILED_WORKERS})", 80),
    "phase_default": """
        select o_orderkey,
               case o_orderstatus when 'F' then 'Succeeded' else 'Pending' end as phase,
               o_orderstatus = 'F' as terminal, o_orderstatus = 'F' as success
        from orders
    """,
}

# What a stream keeps is what the same operator gives on all rows.
ORACLES |= {
    f"{name}_stream": ORACLES[name]
    for name in (
        "distinct_workers", "resource_summary", "streak_guard", "streak_guard_one_run", "tail_n",
    )
}
