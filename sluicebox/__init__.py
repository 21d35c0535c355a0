"""Profile, split, publish and read back big stored datasets with Spark."""

from sluicebox.operators.batch import batch_records
from sluicebox.operators.catalog import dataset_catalog
from sluicebox.operators.collect import between_offsets, collect_messages
from sluicebox.operators.keyindex import KeyIndex, build_index, with_ordinal
from sluicebox.operators.offsets import (
    delivery_audit,
    high_watermarks,
    offset_summary,
    with_offsets,
)
from sluicebox.operators.profile import (
    count_detail,
    dataset_detail,
    first_last_records,
    per_series_profile,
    record_count,
    time_range,
)
from sluicebox.operators.split import (
    assign_jobs,
    every_nth,
    ordinal_slice,
    ordinal_split_plan,
    plan_by_ordinal,
    plan_by_time,
    round_robin,
    time_split_plan,
)
from sluicebox.plans.export import export, plan_export, query_by_time
from sluicebox.session import get_session, scratch_dir
from sluicebox.sources.dataset import Dataset, long_form, read_collection, read_series
from sluicebox.sources.log import KafkaLog, MessageLog

__all__ = [
    "Dataset",
    "KafkaLog",
    "KeyIndex",
    "MessageLog",
    "assign_jobs",
    "batch_records",
    "between_offsets",
    "build_index",
    "collect_messages",
    "count_detail",
    "dataset_catalog",
    "dataset_detail",
    "delivery_audit",
    "every_nth",
    "export",
    "first_last_records",
    "get_session",
    "high_watermarks",
    "long_form",
    "offset_summary",
    "ordinal_slice",
    "ordinal_split_plan",
    "per_series_profile",
    "plan_by_ordinal",
    "plan_by_time",
    "plan_export",
    "query_by_time",
    "read_collection",
    "read_series",
    "record_count",
    "round_robin",
    "scratch_dir",
    "time_range",
    "time_split_plan",
    "with_offsets",
    "with_ordinal",
]
