"""Decisions over streams: rules that read the row alone are stateless, and tables join statically."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..api import Policy
from ..lang.errors import UnsupportedPlan
from ..sources.catalog import Catalog


def decide_stream(policy: Policy, stream: DataFrame, rule: str, *, keys: list[str], catalog: Catalog | None = None) -> DataFrame:
    """The streaming decisions of ``rule``; see :meth:`Policy.decide`.

    A rule that would group the stream's rows keeps state without bound, so it is refused; sets and aggregates of
    static tables are not.
    """
    if not stream.isStreaming:
        raise ValueError("not a stream")
    out = policy.decide(stream, rule, keys=keys, catalog=catalog)
    if _groups_stream(out._jdf.queryExecution().analyzed()):
        raise UnsupportedPlan(f"rule {rule} groups the rows of a stream")
    return out


def _groups_stream(plan) -> bool:
    """Whether a streaming plan groups or deduplicates somewhere above its streaming source."""
    if not plan.isStreaming():
        return False
    if plan.nodeName() in ("Aggregate", "Deduplicate", "DeduplicateWithinWatermark", "Distinct"):
        return True
    children = plan.children()
    return any(_groups_stream(children.apply(i)) for i in range(children.size()))


def write_decisions(decisions: DataFrame, path: str, checkpoint: str, *, available_now: bool = True) -> StreamingQuery:
    """Append the decisions to Parquet files under ``path``."""
    writer = decisions.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
