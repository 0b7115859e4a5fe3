"""DuckDB statements equal to the registered queries (the correctness oracle).

The derived views of FIXTURES.md part B are written once here as CTEs and
prefixed to each statement that needs them.  The as-of join is DuckDB's own
``ASOF LEFT JOIN`` (an independent formulation from the Spark plan).
"""

from __future__ import annotations

VIEWS: dict[str, str] = {
    "commerce_txn": """
select event_id as txn_id, user_id,
  min(ts) over (partition by user_id) as signup_time, ts as purchase_time, value as purchase_value,
  case when event_id % 23 = 0 then null else concat('dev_', json_extract_string(props, '$.k')) end as device_id,
  case event_id % 3 when 0 then 'Ads' when 1 then 'SEO' else 'Direct' end as source,
  case event_id % 5 when 0 then 'Chrome' when 1 then 'Firefox' when 2 then 'Safari' when 3 then 'IE' else null end as browser,
  case when user_id % 2 = 0 then 'M' else 'F' end as sex,
  cast(event_id % 105 as int) as age,
  case when event_id % 17 = 0 then null
       else cast((event_id * 2654435761) % 4294967296 as double) + 0.5 end as ip_address,
  case when event_type = 'error' then 1 else 0 end as class
from events""",
    "ip_ranges": """
select cast(n_nationkey as bigint) * 171798691 as lower_bound_ip_address,
       cast(n_nationkey as bigint) * 171798691 + 120000000 as upper_bound_ip_address, n_name as country
from nation
union all
select cast(r_regionkey as bigint) * 858993459 + 50000000,
       cast(r_regionkey as bigint) * 858993459 + 60000000, concat('X_', r_name)
from region""",
    "card_txn": """
select concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) as txn_id,
  cast((l_orderkey * 37 + l_linenumber * 11) % 172800 as double) as "Time", l_extendedprice / 100.0 as "Amount",
  l_quantity as V1, l_discount as V2, l_tax as V3, cast(l_partkey % 97 as double) as V4,
  cast(l_suppkey % 13 as double) as V5, cast(l_linenumber as double) as V6,
  case when l_returnflag = 'R' then 1 else 0 end as class
from lineitem""",
    "scores": """
select concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) as txn_id,
  case when l_returnflag = 'R' then 1 else 0 end as label,
  cast((l_orderkey * 31 + l_linenumber * 17) % 700
       + case when l_returnflag = 'R' then 300 else 0 end as double) / 1000.0 as fraud_probability
from lineitem""",
    "scores2": """
select concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) as txn_id,
  case when l_returnflag = 'R' then 1 else 0 end as label,
  cast((l_orderkey * 53 + l_linenumber * 17) % 700
       + case when l_returnflag = 'R' then 300 else 0 end as double) / 1000.0 as fraud_probability
from lineitem""",
    "commerce_geo": """
select t.*, case when t.ip_as_int <= r.upper_bound_ip_address then r.country end as ip_country
from (select *, coalesce(cast(floor(ip_address) as bigint), 0) as ip_as_int from commerce_txn) t
asof left join ip_ranges r on t.ip_as_int >= r.lower_bound_ip_address""",
}

# dependency order of the views above
_DEPS = {
    "commerce_geo": ["commerce_txn", "ip_ranges"],
}
_ORDER = list(VIEWS)

SQL: dict[str, str] = {}


def _needed(names) -> list[str]:
    out = set()

    def add(n):
        if n in out:
            return
        for d in _DEPS.get(n, []):
            add(d)
        out.add(n)
    for n in names:
        add(n)
    return [n for n in _ORDER if n in out]


def with_views(body: str, *views: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with the CTEs it needs (views first, then ``extra``)."""
    parts = [f"{n} as ({VIEWS[n]})" for n in _needed(views)]
    for n, s in (extra or {}).items():
        parts.append(f"{n} as ({s})")
    return ("with " + ",\n".join(parts) + "\n" + body) if parts else body


def sql(name: str, body: str, *views: str, extra: dict[str, str] | None = None) -> None:
    SQL[name] = with_views(body, *views, extra=extra)
