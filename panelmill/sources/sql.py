"""SQL reports from files over the panel's views."""

from __future__ import annotations

from importlib.resources import files as resources

from pyspark.sql import DataFrame, SparkSession

from panelmill.sources.panel import Panel, register

REPORTS = ("daily_profile", "hourly_profile", "zone_ranking", "peak_windows", "checks")


def read_sql(name: str) -> str:
    """The text of a report's file; an unknown name raises."""
    path = resources("panelmill") / "sql" / f"{name}.sql"
    if not path.is_file():
        raise FileNotFoundError(f"there's no report {name}")
    return path.read_text(encoding="utf-8")


def statements(script: str) -> list[str]:
    """The statements of a script: cut at semicolons outside quotes and comments; what holds nothing but comments goes."""
    out, now, code, quote, at = [], [], False, "", 0
    while at < len(script):
        c = script[at]
        if not quote and script.startswith("--", at):
            end = script.find("\n", at)
            end = len(script) if end < 0 else end
            now.append(script[at:end])
            at = end
            continue
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        if c == ";" and not quote:
            if code:
                out.append("".join(now).strip())
            now, code = [], False
        else:
            now.append(c)
            code = code or not c.isspace()
        at += 1
    if code:
        out.append("".join(now).strip())
    return out


def run_report(spark: SparkSession, name: str, args: dict | None = None) -> DataFrame:
    """The last statement of a report's file over the registered views."""
    *first, last = statements(read_sql(name))
    for statement in first:
        spark.sql(statement, args or {})
    return spark.sql(last, args or {})


def run_reports(panel: Panel) -> dict[str, DataFrame]:
    """Every report by name, lazily; the views are registered first."""
    register(panel)
    spark = panel.observations.sparkSession
    sizes = {"n_hours": panel.settings.hours, "n_zones": panel.settings.zones}
    return {name: run_report(spark, name, sizes if name == "checks" else None) for name in REPORTS}
