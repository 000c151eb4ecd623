"""Telemetry queries."""

from pactframe.operators import ops
from pactframe.plans.registry import register
from pactframe.plans.times import AS_OF

# From the definitions: the mean rounded half up once, the 95th percentile as the value at place
# ceil(0.95 n) of the sorted durations, whole tenths of a percent from integer counts.
HEALTH = """count(*) as ops, floor((2 * sum(duration_ms) + count(duration_ms)) / (2.0 * count(duration_ms))) as avg_ms,
      list_sort(list(duration_ms) filter (where duration_ms is not null))[(19 * count(duration_ms) + 19) // 20] as p95_ms,
      ((2000 * sum(case when ok then 1 else 0 end) + count(*)) // (2 * count(*))) / 10.0 as success_pct,
      cast(sum(tokens_in + tokens_out) as bigint) as tokens"""


@register(
    "ops_health",
    f"""select date_trunc('minute', created_at) as minute, op, {HEALTH} from dom_telemetry
    where created_at > timestamp '{AS_OF}' - interval 24 hour and created_at <= timestamp '{AS_OF}' group by 1, 2""",
)
def ops_health(t):
    return ops.ops_health(t("dom_telemetry"), AS_OF)


@register(
    "worker_summary",
    """select worker, cast(created_at as date) as day, count(*) filter (where ok) as processed,
      count(*) filter (where not ok) as failed from dom_telemetry group by 1, 2""",
)
def worker_summary(t):
    return ops.worker_summary(t("dom_telemetry"))


@register(
    "error_classes",
    "select op, worker, error_class, count(*) as failures from dom_telemetry where not ok group by all",
)
def error_classes(t):
    return ops.error_classes(t("dom_telemetry"))
