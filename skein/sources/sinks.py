"""Writers of chunks and reports."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame


def write_chunks(chunks: DataFrame, path: str, fmt: str = "json") -> None:
    chunks.write.mode("overwrite").format(fmt).save(path)


def report_rows(summary: DataFrame, limit: int = 10_000) -> list[dict]:
    """An aggregated table as dicts; a table of more than `limit` rows is no report and raises."""
    rows = summary.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows; aggregate before reporting")
    return [r.asDict(recursive=True) for r in rows]


def markdown_table(rows: list[dict]) -> str:
    if not rows:
        return "(no rows)\n"
    names = list(rows[0])
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(names) + " |", "|" + "---|" * len(names)] + ["| " + " | ".join(cell(r[n]) for n in names) + " |" for r in rows]
    return "\n".join(lines) + "\n"


def suite_matrix(suites: dict[str, DataFrame], metrics: list[str]) -> list[dict]:
    """One row per suite, from its one-row summary, and the unweighted mean of the suites' metrics."""
    rows = [{"suite": name} | {m: row.get(m) for m in metrics} for name, df in suites.items() for row in report_rows(df, 1)]
    mean = lambda m: round(sum(v) / len(v), 4) if (v := [r[m] for r in rows if r[m] is not None]) else None
    return [*rows, {"suite": "macro average"} | {m: mean(m) for m in metrics}]


def write_report(title: str, sections: dict[str, DataFrame], folder: str) -> dict[str, str]:
    """<folder>/report.json and report.md of small aggregated tables; the paths written."""
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    data = {name: report_rows(df) for name, df in sections.items()}
    (out / "report.json").write_text(json.dumps(data, indent=1, default=str), encoding="utf-8")
    (out / "report.md").write_text(f"# {title}\n\n" + "\n".join(f"## {n}\n\n{markdown_table(rows)}" for n, rows in data.items()), encoding="utf-8")
    return {"json": str(out / "report.json"), "markdown": str(out / "report.md")}
