"""Cycles of a champion and its challengers, for each symbol by itself.

Models are a table (symbol, version, role, created_at, accuracy, weights), cycles a table of what happened. A cycle joins
each symbol's models with its training rows in one task: a challenger is trained, held against the champion on rows that
neither is trained on now, and takes its place, or goes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import meta
from .network import loaded

#: By how much a challenger has to be better, and how many cycles are kept.
MARGIN, CYCLES = 0.01, 20
MODELS = "symbol string, version string, role string, created_at long, accuracy double, weights string"
RECORD = "kind string, reason string, rows long, champion string, champion_accuracy double, challenger string, challenger_accuracy double, retired string, retired_accuracy double"


def champion_of(models: pd.DataFrame) -> pd.Series | None:
    """The newest model that is a champion, or has no role."""
    own = models[models["role"].isna() | (models["role"] == "champion")]
    return None if own.empty else own.sort_values("created_at", kind="stable").iloc[-1]


def cycle(models: DataFrame, pool: DataFrame, at: int, least: int = meta.LEAST, margin: float = MARGIN) -> DataFrame:
    """One row for each model after the cycle at time ``at`` (MODELS), with ``record`` of what the cycle did to its symbol;
    a symbol that has no model after it has one row of nulls beside the record."""

    def each(key: tuple, models: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        symbol, record = key[0], dict.fromkeys(x.split()[0] for x in RECORD.split(", "))
        record["rows"] = len(rows)
        models = models[["symbol", "version", "role", "created_at", "accuracy", "weights"]].copy()
        if len(rows) < least:
            record["kind"] = "no-train"
        else:
            net, _, _, x, y = meta.taught(rows)
            own, version = meta.sign_accuracy(net.predict(x)[:, 0], y), f"mb-{at}"
            made = {"symbol": symbol, "version": version, "role": "champion", "created_at": at, "accuracy": round(own, 4), "weights": net.saved()}
            before = champion_of(models)
            if before is None:
                record |= {"kind": "promoted", "reason": "no-incumbent", "champion": version, "champion_accuracy": own}
                models.loc[len(models)] = made
            else:
                held = meta.sign_accuracy(loaded(before["weights"]).predict(x)[:, 0], y)
                better = own >= held + margin
                record |= {"reason": f"{'+' if better else ''}{own - held:.3f}", "challenger": version, "challenger_accuracy": round(own, 4)}
                if better:
                    models.loc[before.name, "role"] = "retired"
                    models.loc[models.index.max() + 1] = made
                    record |= {"kind": "promoted", "champion": version, "champion_accuracy": round(own, 4), "retired": before["version"], "retired_accuracy": round(held, 4)}
                else:
                    record |= {"kind": "rejected", "champion": before["version"], "champion_accuracy": round(held, 4)}
        left = models.astype(object).where(models.notna(), None).to_dict("records") or [dict.fromkeys(models.columns)]
        out = [{**m, "symbol": symbol, **{f"r_{k}": v for k, v in record.items()}} for m in left]
        return pd.DataFrame(out, columns=[x.split()[0] for x in made_of.split(", ")], dtype=object)

    made_of = f"{MODELS}, {', '.join(f'r_{x}' for x in RECORD.split(', '))}"
    rows = meta.training_rows(pool).select("symbol", "place", "vector", "label")
    fields = [x.split()[0] for x in RECORD.split(", ")]
    made = models.groupBy("symbol").cogroup(rows.groupBy("symbol")).applyInPandas(each, made_of)
    return made.select(*(x.split()[0] for x in MODELS.split(", ")), F.struct(*(F.col(f"r_{x}").alias(x) for x in fields)).alias("record"))


def models_after(cycled: DataFrame) -> DataFrame:
    return cycled.where("version IS NOT NULL").drop("record")


def recorded(cycled: DataFrame, at: int) -> DataFrame:
    """(symbol, at, and the fields of RECORD): what the cycle did to each symbol."""
    return cycled.groupBy("symbol").agg(F.first("record").alias("r")).select("symbol", F.lit(at).cast("long").alias("at"), "r.*")


def recovered(models: DataFrame, drifted: DataFrame) -> DataFrame:
    """models after symbols in ``drifted`` (symbol, drifted) went back: where there is a retired model, the newest of them is the champion
    again, and the champion is rolled back."""
    w = Window.partitionBy("symbol")
    back = F.coalesce(F.col("drifted"), F.lit(False))
    role = F.coalesce("role", F.lit("champion"))
    rows = models.join(drifted.select("symbol", "drifted"), "symbol", "left").withColumn("_role", role)
    newest = lambda name: F.max(F.when(F.col("_role") == name, F.col("created_at"))).over(w)
    rows = rows.withColumns({"_retired": newest("retired"), "_champion": newest("champion")})
    acts = back & F.col("_retired").isNotNull()
    comes = acts & (F.col("_role") == "retired") & (F.col("created_at") == F.col("_retired"))
    goes = acts & (F.col("_role") == "champion") & (F.col("created_at") == F.col("_champion"))
    return rows.select(*(c for c in models.columns if c != "role"), F.when(comes, "champion").when(goes, "rolled-back").otherwise(F.col("role")).alias("role"))


def with_role(models: DataFrame, chosen: DataFrame) -> DataFrame:
    """models with the roles of ``chosen`` (symbol, version, role) in place of their own."""
    new = chosen.select("symbol", "version", F.col("role").alias("_role"))
    return models.join(new, ["symbol", "version"], "left").withColumn("role", F.coalesce("_role", "role")).drop("_role")


def recent(cycles: DataFrame, most: int = CYCLES) -> DataFrame:
    """The newest ``most`` cycles of each symbol, newest first by ``place``."""
    order = Window.partitionBy("symbol").orderBy(F.desc("at"))
    return cycles.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
