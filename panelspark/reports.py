"""Report pages: tables that the engine computed, rendered on the driver."""

from __future__ import annotations

import html
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_STYLE = "body{font-family:sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:4px 8px;text-align:right}th:first-child,td:first-child{text-align:left}"
#: Behaviour labels of clusters and of hidden states.
CLUSTER_LABELS = ("撤单压力/试探窗口", "大单集中成交窗口", "高活跃冲击窗口", "常规流动性背景")
STATE_LABELS = ("高撤单压力状态", "大单成交集中状态", "高活跃冲击状态", "持续流动性背景状态", "短促切换状态")


def cell(value: object) -> str:
    if value is None or (isinstance(value, float) and value != value):
        return "–"
    return f"{value:.4f}" if isinstance(value, float) else html.escape(str(value))


def table(frame: pd.DataFrame, most: int = 50) -> str:
    """An HTML table of the first ``most`` rows."""
    if frame.empty:
        return "<p>–</p>"
    head = "".join(f"<th>{html.escape(str(c))}</th>" for c in frame.columns)
    body = "".join("<tr>" + "".join(f"<td>{cell(v)}</td>" for v in row) + "</tr>" for row in frame.head(most).itertuples(index=False))
    return f"<table><tr>{head}</tr>{body}</table>"


def bars_chart(frame: pd.DataFrame, label: str, value: str, most: int = 20) -> str:
    """Horizontal bars as SVG."""
    rows = frame[[label, value]].dropna().head(most)
    if rows.empty:
        return ""
    top = max(abs(rows[value]).max(), 1e-12)
    lines = []
    for i, (name, x) in enumerate(rows.itertuples(index=False)):
        lines.append(f'<text x="0" y="{18 * i + 13}" font-size="11">{html.escape(str(name))}</text><rect x="260" y="{18 * i + 3}" width="{abs(x) / top * 300:.1f}" height="12" fill="{"#2a7" if x >= 0 else "#c44"}"/><text x="570" y="{18 * i + 13}" font-size="11">{x:.4f}</text>')
    return f'<svg width="640" height="{18 * len(rows) + 6}">{"".join(lines)}</svg>'


def line_chart(frame: pd.DataFrame, value: str, width: int = 640, height: int = 160) -> str:
    """One line over the frame's rows as SVG."""
    y = frame[value].dropna().to_numpy(float)
    if len(y) < 2:
        return ""
    low, high = y.min(), y.max()
    points = " ".join(f"{i / (len(y) - 1) * width:.1f},{height - (v - low) / max(high - low, 1e-12) * height:.1f}" for i, v in enumerate(y))
    return f'<svg width="{width}" height="{height}"><polyline fill="none" stroke="#27a" points="{points}"/></svg>'


def page(title: str, sections: dict[str, str], links: dict[str, str] | None = None) -> str:
    menu = " · ".join(f'<a href="{html.escape(u)}">{html.escape(t)}</a>' for t, u in (links or {}).items())
    body = "".join(f"<h2>{html.escape(k)}</h2>{v}" for k, v in sections.items())
    return f'<!doctype html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title><style>{_STYLE}</style></head><body><h1>{html.escape(title)}</h1><p>{menu}</p>{body}</body></html>'


def write(path: str, text: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(text, encoding="utf-8")


def coverage_summary(coverage: DataFrame) -> DataFrame:
    """Daily coverage as one row: days, sums, ranges, least hit rates."""
    return coverage.agg(
        F.count_distinct("date").alias("days"),
        F.sum("order_rows").alias("order_rows"),
        F.sum("trade_rows").alias("trade_rows"),
        F.concat_ws("–", F.min("order_stocks"), F.max("order_stocks")).alias("order_stocks"),
        *[F.min(f"{c}_hit_rate").alias(f"min_{c}_hit_rate") for c in ("ask_fill", "bid_fill", "cancel")],
    )


def quality_summary(quality: DataFrame) -> DataFrame:
    """Gates by status: how many, and the worst differences."""
    worst = [c for c in quality.columns if c.endswith("_diff_abs")]
    return quality.groupBy("gate_status").agg(F.count("*").alias("stock_days"), *[F.max(c).alias(f"max_{c}") for c in worst])


def label_clusters(profile: DataFrame) -> DataFrame:
    top = F.col("mean_submit_volume") == F.max("mean_submit_volume").over(Window.partitionBy())
    a, b, c, d = CLUSTER_LABELS
    dense = (F.col("mean_submit_order_hhi") >= 0.20) & (F.col("mean_submit_fill_ratio") >= 0.70)
    return profile.withColumn("behavior_label", F.when(F.col("mean_submit_cancel_ratio") >= 0.45, a).when(dense, b).when(top, c).otherwise(d)).orderBy(F.col("share").desc())


def label_states(profile: DataFrame) -> DataFrame:
    top = F.col("mean_submit_volume") == F.max("mean_submit_volume").over(Window.partitionBy())
    a, b, c, d, e = STATE_LABELS
    dense = (F.col("mean_submit_order_hhi") >= 0.20) & (F.col("mean_submit_fill_ratio") >= 0.75)
    label = F.when(F.col("mean_submit_cancel_ratio") >= 0.50, a).when(dense, b).when(top, c).when(F.col("mean_duration_minutes") >= 8.0, d).otherwise(e)
    return profile.withColumn("behavior_label", label).orderBy(F.col("share").desc())


def likely_next(transitions: DataFrame) -> DataFrame:
    """Of each state the likeliest next one; ties to the smaller."""
    return transitions.groupBy("from_state").agg(F.min_by("to_state", F.struct(-F.col("probability"), "to_state")).alias("to_state"), F.max("probability").alias("probability"))
