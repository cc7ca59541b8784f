"""SQL twins of the training-data queries that SQL can express."""

from __future__ import annotations

import math

from .percentiles import RELATIVE_ERROR, SHIFT

_G = (1 + RELATIVE_ERROR) / (1 - RELATIVE_ERROR)
_LOG_G = repr(math.log(_G))

_SKETCH = f"""
with versions as (
  select usage_id, model, role, cast(ts as date) as day, latency_ms,
         row_number() over (partition by usage_id, case when usage_id is null then hash(usage_records) end
                            order by received_at desc nulls last, ts desc nulls last, latency_ms desc nulls last, model desc nulls last, role desc nulls last) as version
  from usage_records
), measured as (select model, role, day, latency_ms from versions where version = 1 and latency_ms >= 0),
sketch as (
  select model, role, day, cast(case when latency_ms = 0 then 0 else ceil(round(ln(latency_ms) / {_LOG_G}, 9)) + {SHIFT} end as integer) as bucket, count(*) as n
  from measured group by all
)"""


def _percentiles(groups: str) -> str:
    value = f"case when bucket = 0 then 0.0 else {2 / (_G + 1)!r} * pow({_G!r}, bucket - {SHIFT}) end"
    columns = ", ".join(f"min(case when seen > floor({q} * (n_values - 1)) then value end) as {name}" for name, q in (("p50", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99)))
    return f"""{_SKETCH}, merged as (select {groups}, bucket, sum(n) as n from sketch group by all),
running as (select *, {value} as value, sum(n) over (partition by {groups} order by bucket) as seen, sum(n) over (partition by {groups}) as n_values from merged)
select {groups}, cast(n_values as bigint) as n_values, {columns}, cast({RELATIVE_ERROR} as double) as relative_error from running group by {groups}, n_values"""


ORACLE: dict[str, str] = {
    "p1_sketches": _SKETCH + " select * from sketch",
    "p1_daily": _percentiles("model, role, day"),
    "p1_percentiles": _percentiles("model, role"),
}
