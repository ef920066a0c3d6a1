"""Reports as files: one JSON object a table, and a Markdown summary of small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows of one table in a summary; a report's tables are aggregates.
MOST_ROWS = 1000


def write_json(report: DataFrame, path: str) -> None:
    """A small table as JSON lines in one file."""
    report.coalesce(1).write.mode("overwrite").json(path)


def cell(value: object) -> str:
    if value is None:
        return "-"
    if isinstance(value, bool):
        return "yes" if value else "no"
    return f"{value:.4f}" if isinstance(value, float) else str(value).replace("|", "\\|").replace("\n", " ")


def markdown(title: str, tables: dict[str, DataFrame]) -> str:
    """A heading, and a table for each aggregate, its rows in order of their first column. A longer one says how many rows it leaves to the JSON."""
    out = [f"# {title}"]
    for name, df in tables.items():
        rows = df.orderBy(df.columns[0]).limit(MOST_ROWS + 1).collect()
        out += ["", f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + " - |" * len(df.columns)]
        out += ["| " + " | ".join(map(cell, r)) + " |" for r in rows[:MOST_ROWS]]
        if len(rows) > MOST_ROWS:
            out.append(f"| {df.count() - MOST_ROWS} further rows |")
    return "\n".join(out) + "\n"


def write_report(title: str, tables: dict[str, DataFrame], path: str) -> None:
    """Each table as JSON, then the summary, which makes the report complete."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        write_json(df, f"{path}/{name}.json")
    spark.createDataFrame([(markdown(title, tables),)], "value string").coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(f"{path}/summary.md")
