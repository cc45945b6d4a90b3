"""Runs, reports, leaderboards."""

from __future__ import annotations

import json
import math
import shutil
from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice import config as settings
from skylattice.operators import metrics
from skylattice.operators.metrics import horizon_summary, worst_cases
from skylattice.operators.quality import split_summary
from skylattice.sources import store
from skylattice.sources.tables import write_json, write_table

#: Fixed: the columns of a leaderboard row, in order.
LEADERBOARD = [
    "experiment_name", "version", "target_name", "model_name", "model_type", "encoder_length", "prediction_length", "train_start", "train_end",
    "val_start", "val_end", "test_start", "test_end", "rmse", "mae", "bias", "rmse_raw", "rmse_corrected", "mae_raw", "mae_corrected",
    "bias_raw", "bias_corrected", "mape", "notes", "experiment_dir",
]


def leaderboard(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """Rows of both, columns of both, by target, corrected rmse and mae, missing ones last."""
    both = new if old is None else old.unionByName(new, allowMissingColumns=True)
    return both.orderBy(*[F.col(c).asc_nulls_last() for c in ("target_name", "rmse_corrected", "mae_corrected")])


def for_target(board: DataFrame, target: str) -> DataFrame:
    return board.where(F.col("target_name") == target)


def _finite(x: object) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x)


def better(now: Mapping, before: Mapping | None, version: int = 2) -> bool:
    """A lower finite validation loss; without two, a lower finite rmse. Version 1 also prefers a finite loss to one that isn't."""
    if before is None:
        return True
    a, b = now.get("best_val_loss"), before.get("best_val_loss")
    if _finite(a) and _finite(b):
        return a < b
    if version == 1 and _finite(a) != _finite(b):
        return _finite(a)
    a, b = now.get("rmse"), before.get("rmse")
    return _finite(a) and _finite(b) and a < b


def best_epoch(history: Sequence[Mapping]) -> Mapping | None:
    """A21."""
    scored = [h for h in history if _finite(h.get("val_loss"))]
    return min(scored, key=lambda h: h["val_loss"]) if scored else None


def run_directory(root: str | Path, name: str, config: Mapping, summary: Mapping) -> Path:
    """K8: a folder with the config as it was and the summary as JSON and text."""
    place = Path(root) / name
    place.mkdir(parents=True, exist_ok=True)
    settings.dump(dict(config), place / "config_snapshot.yaml")
    write_json(summary, place / "experiment_summary.json")
    lines = [f"# {name}", "", *(f"- {k}: {v:.4f}" if _finite(v) else f"- {k}: {'n/a' if v is None else v}" for k, v in summary.items())]
    (place / "experiment_summary.md").write_text("\n".join(lines) + "\n", encoding="utf-8")
    return place


def refresh_aliases(place: Path, version: int = 2) -> list[str]:
    """K9: `latest` always becomes this run, `best` if it is better."""
    made = []
    for alias in ("latest", "best"):
        to = place.parent / alias
        if alias == "best":
            old = to / "experiment_summary.json"
            before = json.loads(old.read_text()) if old.exists() else None
            if not better(json.loads((place / "experiment_summary.json").read_text()), before, version):
                continue
        shutil.rmtree(to, ignore_errors=True)
        shutil.copytree(place, to)
        made.append(alias)
    return made


def edges(df: DataFrame, n: int = 36, order: Sequence[str] = ("station_id", "prediction_start", "horizon_step")) -> tuple[DataFrame, DataFrame]:
    """L4: first and last rows by an explicit order."""
    return df.orderBy(*order).limit(n), df.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def plot_data(df: DataFrame) -> dict[str, DataFrame]:
    """What the plots show, as tables."""
    first = edges(df, 200)[0]
    return {
        "forecast_vs_actual": first.select("valid_time", "target_name", "prediction", "actual"),
        "horizon_error": horizon_summary(df),
        "scatter": edges(df, 1000)[0].select("actual", "prediction"),
        "raw_vs_corrected": first.select("valid_time", *[c for c in ("prediction_raw", "prediction", "actual") if c in df.columns]),
    }


def report(table: DataFrame, predictions: DataFrame, place: str | Path) -> dict[str, str]:
    """Split and horizon summaries, worst twenty, first and last rows, as CSV folders."""
    head, tail = edges(predictions)
    parts = {"split_summary": split_summary(table), "horizon_summary": horizon_summary(predictions), "worst_cases": worst_cases(predictions, 20), "head": head, "tail": tail}
    return {k: write_table(df, f"{place}/{k}.csv") for k, df in parts.items()}


def markdown(name: str, summary: Mapping, tables: Mapping[str, DataFrame], most: int = 50) -> str:
    """A run as text: its summary, then the first `most` rows of each table."""
    shown = lambda v: "n/a" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    lines = [f"# {name}", "", *(f"- {k}: {shown(v)}" for k, v in summary.items())]
    for title, df in tables.items():
        rows = df.limit(most).collect()
        lines += ["", f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns), *("| " + " | ".join(map(shown, r)) + " |" for r in rows)]
    return "\n".join(lines) + "\n"


def metric_tables(table: DataFrame, predictions: DataFrame) -> dict[str, DataFrame]:
    """K5: what a run reports: metrics in all and by target, station, step and season, splits, worst cases, first and last rows."""
    by = {"by_target": ["target_name"], "by_station": ["target_name", "station_id"], "by_horizon": ["target_name", "horizon_step"], "by_season": ["target_name", "season"]}
    head, tail = edges(predictions)
    found = {k: metrics.grouped_metrics(predictions, keys).orderBy(*keys) for k, keys in by.items() if set(keys) <= set(predictions.columns)}
    return {"metrics": metrics.metrics(predictions), **found, "split_summary": split_summary(table), "worst_cases": worst_cases(predictions, 20), "head": head, "tail": tail}


def publish_run(spark: SparkSession, root: str, name: str, config: Mapping, summary: Mapping, table: DataFrame, predictions: DataFrame, version: int = 2) -> str:
    """Config snapshot, summary, report and metric tables of a run, its rows on the leaderboard, and the aliases.

    All goes to the session's file system. The run appears whole; then its rows are appended, which no other run's replace;
    `latest` names it, and `best` if it is better than what `best` names.
    """
    tables = metric_tables(table, predictions)
    texts = {"config_snapshot.json": json.dumps(config, indent=2, default=str), "experiment_summary.json": json.dumps(summary, indent=2, default=str), "report.md": markdown(name, summary, tables)}
    place = store.publish(spark, root, name, texts, tables)
    row = {c: summary.get(c) for c in LEADERBOARD} | {"experiment_name": name, "experiment_dir": place}
    kinds = {c: "double" for c in LEADERBOARD if c.startswith(("rmse", "mae", "bias", "mape"))} | {"version": "int", "encoder_length": "int", "prediction_length": "int"}
    scores = {r.target_name: r for r in tables["by_target"].collect()} if "by_target" in tables else {}
    rows = [{**row, "target_name": t, **{c: getattr(r, c) for c in ("rmse", "mae", "bias", "mape")}} for t, r in scores.items()] or [row]
    cast = {"double": lambda v: None if v is None else float(v), "int": lambda v: None if v is None else int(v), "string": lambda v: None if v is None else str(v)}
    values = [tuple(cast[kinds.get(c, "string")](r[c]) for c in LEADERBOARD) for r in rows]
    store.append(spark.createDataFrame(values, ", ".join(f"{c} {kinds.get(c, 'string')}" for c in LEADERBOARD)), f"{root}/leaderboard")
    before = store.pointed(spark, root, "best")
    old = store.get_text(spark, f"{root}/{before}/experiment_summary.json") if before else None
    store.point(spark, root, "latest", name)
    if better(summary, json.loads(old) if old else None, version):
        store.point(spark, root, "best", name)
    return place


def boards(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """K7: the leaderboard of all runs under a root, `all`, and one for each target, each in order."""
    rows = store.appended(spark, f"{root}/leaderboard")
    if rows is None:
        return {}
    board = leaderboard(None, rows)
    targets = [r[0] for r in rows.select("target_name").where("target_name is not null").distinct().orderBy("target_name").collect()]
    return {"all": board, **{t: for_target(board, t) for t in targets}}
