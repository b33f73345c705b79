"""Readers and writers of bars, experiments and order streams."""

from __future__ import annotations

import json
import re
import time
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the streams, and the names of their files.
STREAM_FILES = {"orders": "逐笔委托.parquet", "trades": "逐笔成交.parquet", "quotes": "行情.parquet"}
STREAM_COLUMNS = {
    "orders": ("wind_code", "ex_code", "date", "time", "order_id", "ex_order_id", "order_type", "order_code", "price", "volume"),
    "trades": ("wind_code", "ex_code", "date", "time", "trade_id", "trade_code", "order_code", "bs_flag", "price", "volume", "ask_order_id", "bid_order_id"),
    "quotes": ("wind_code", "ex_code", "date", "time", "price", "volume", "amount", "cum_volume", "cum_amount"),
}
BARS = "ticker string, date date, open double, high double, low double, close double, volume double, vwap double"


@dataclass(frozen=True)
class Config:
    tickers: tuple[str, ...] = ()
    start: str = ""
    end: str = ""
    raw_path: str = "data/raw/daily_bars.parquet"
    factors_path: str = "data/processed/factors.parquet"
    model_path: str = "data/models/latest_model.joblib"
    timespan: str = "day"
    multiplier: int = 1
    request_pause_seconds: float = 13.0
    extra: dict = field(default_factory=dict)


def load_config(path: str) -> Config:
    """A Config from JSON, or from YAML where that library is there; tickers in upper case."""
    text = Path(path).read_text()
    if path.endswith(".json"):
        raw = json.loads(text)
    else:
        import yaml

        raw = yaml.safe_load(text)
    known = {k: v for k, v in raw.items() if k in Config.__dataclass_fields__ and k not in {"tickers", "extra"}}
    return Config(tickers=tuple(str(t).strip().upper() for t in raw.get("tickers", ())), extra={k: v for k, v in raw.items() if k not in Config.__dataclass_fields__}, **known)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """CSV by suffix (any case), else Parquet."""
    if path.lower().endswith(".csv"):
        return spark.read.csv(path, header=True, inferSchema=True)
    return spark.read.parquet(path)


def read_optional(spark: SparkSession, path: str | None) -> DataFrame | None:
    """None where nothing is there."""
    if not path:
        return None
    try:
        return read_table(spark, path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def _children(spark: SparkSession, path: str) -> list[str]:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(hadoop)] if fs.exists(hadoop) else []


def available_days(spark: SparkSession, raw_dir: str) -> list[str]:
    """Numeric folders that hold all three streams, sorted."""
    days = [d for d in _children(spark, raw_dir) if d.isdigit()]
    return sorted(d for d in days if set(STREAM_FILES.values()) <= set(_children(spark, f"{raw_dir}/{d}")))


def read_stream(spark: SparkSession, raw_dir: str, stream: str, days: list[str] | None = None, codes: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """One stream of some days; the filter on stocks and the columns reach the scan.  Unsigned ids become longs."""
    chosen = days if days is not None else available_days(spark, raw_dir)
    there = set(available_days(spark, raw_dir))
    if missing := [d for d in chosen if d not in there] or ([] if chosen else [raw_dir]):
        raise FileNotFoundError(f"no data for {missing}")
    df = spark.read.parquet(*[f"{raw_dir}/{d}/{STREAM_FILES[stream]}" for d in chosen])
    df = df.select(*(columns or [c for c in STREAM_COLUMNS[stream] if c in df.columns]))
    df = df.withColumns({c: F.col(c).cast("long") for c in df.columns if c.endswith("order_id") or c == "trade_id"})
    return df.where(F.col("wind_code").isin(*codes)) if codes else df


def make_run_dir(name: str, root: str = "runs") -> Path:
    """A new folder named by time and ``name``; fails if it exists."""
    path = Path(root) / f"{time.strftime('%Y%m%d_%H%M%S')}_{re.sub(r'[^A-Za-z0-9._-]+', '_', name).strip('_') or 'run'}"
    path.mkdir(parents=True, exist_ok=False)
    return path


def write_json(path: str | Path, data: dict) -> None:
    Path(path).write_text(json.dumps(data, sort_keys=True, indent=2, default=str, ensure_ascii=False))


def write_report(df: DataFrame, path: str) -> None:
    """A folder of CSV files with headers, or of Parquet, by suffix; Spark writes it, whatever its size."""
    if path.lower().endswith(".csv"):
        df.write.mode("overwrite").option("header", True).csv(path)
    else:
        df.write.mode("overwrite").parquet(path)
