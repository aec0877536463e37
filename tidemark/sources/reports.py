"""Reports of backtests: best runs, Markdown, HTML, JSON. They render a few rows of metrics, one a run."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def best_run(report: DataFrame) -> DataFrame:
    """The run with the highest Sharpe ratio of each symbol."""
    return report.groupBy("symbol").agg(F.max_by(F.struct("strategy", "sharpe", "total_return"), F.struct("sharpe", "strategy")).alias("b")).select("symbol", "b.*")


def split_errors(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Results without and with an error."""
    return results.where("error IS NULL"), results.where("error IS NOT NULL")


def markdown(report: DataFrame, columns: list[str], most: int = 200) -> str:
    """A Markdown table of at most `most` runs, best Sharpe ratio first (a report: the limit is its purpose)."""
    rows = report.orderBy(F.desc("sharpe")).select(*columns).limit(most).collect()
    show = lambda v: f"{v:.4f}" if isinstance(v, float) else str(v)
    return "\n".join(["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns), *("| " + " | ".join(map(show, r)) + " |" for r in rows)])


def html_page(report: DataFrame, columns: list[str], title: str, most: int = 200) -> str:
    """The same as a page; every value is escaped."""
    rows = report.orderBy(F.desc("sharpe")).select(*columns).limit(most).collect()
    cells = lambda tag, values: "<tr>" + "".join(f"<{tag}>{html.escape(f'{v:.4f}' if isinstance(v, float) else str(v))}</{tag}>" for v in values) + "</tr>"
    return f"<!doctype html><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><table>{cells('th', columns)}{''.join(cells('td', r) for r in rows)}</table>"


def write_json(report: DataFrame, curve: DataFrame, path: str, most: int = 5000) -> None:
    """Metrics, and equity curves thinned to about `most` points, as JSON below a path."""
    from tidemark.operators.backtest import downsample

    report.write.mode("overwrite").json(f"{path}/metrics")
    downsample(curve, most).write.mode("overwrite").json(f"{path}/curves")


def write_transcripts(cues: DataFrame, made: DataFrame, path: str) -> None:
    """Cues as JSON lines, a folder for each transcript's path; beside them an index of the transcripts (path, cues, duration_s, words)."""
    cues.write.mode("overwrite").json(f"{path}/cues")
    made.write.mode("overwrite").option("header", True).csv(f"{path}/index")


def counts_table(counted: DataFrame, title: str, most: int = 50) -> str:
    """A Markdown section of counted values (value, count), the most frequent first (a report: the limit is its purpose)."""
    rows = counted.orderBy(F.desc("count"), "value").limit(most).collect()
    return "\n".join([f"## {title}", "", "| value | count |", "|---|---|", *(f"| {r['value']} | {r['count']} |" for r in rows)])


def catalog_report(catalog: DataFrame, columns: list[str], path: str) -> str:
    """Writes a catalog as JSON below a path and returns a Markdown report: its size and a table of counts for each column."""
    from tidemark.operators.text import value_counts

    catalog.write.mode("overwrite").json(path)
    counted = value_counts(catalog, columns)
    parts = [counts_table(counted.where(F.col("column") == c), c) for c in columns]
    return "\n\n".join([f"# Catalog\n\n{catalog.count()} rows", *parts])
