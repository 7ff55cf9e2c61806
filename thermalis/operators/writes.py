"""What a run leaves behind: the next version of the registry, of routed detections, events, scores and labels.

Every function takes tables and gives tables; thermalis.sources.versions commits those that belong
together. Rows are merged by key, so a rerun gives the same version again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import written
from . import registry


def numbered(rows: DataFrame, order: list[str], name: str, after: int = 0) -> DataFrame:
    """rows with `name`: after + 1, after + 2, ... in the given order, by ranges, so that no task numbers all rows."""
    placed = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    out = placed.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return out.withColumn(name, (F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1 + after).cast("long")).drop("_part", "_before", "_at")


def merged(target: DataFrame, staged: DataFrame, key: str, columns: list[str], where: Column | None = None) -> DataFrame:
    """target with `columns` taken from the staged row of its key (null values too), where there is one and `where` holds, and `changed`.

    Keys of `staged` are unique. A row counts as changed only if a value is distinct from what it had.
    """
    new = staged.select(key, F.struct(*columns).alias("_new"))
    out = target.join(new, key, "left")
    use = F.col("_new").isNotNull() if where is None else F.col("_new").isNotNull() & F.coalesce(where, F.lit(False))
    distinct = ~F.col(columns[0]).eqNullSafe(F.col(f"_new.{columns[0]}"))
    for c in columns[1:]:
        distinct = distinct | ~F.col(c).eqNullSafe(F.col(f"_new.{c}"))
    out = out.withColumn("changed", use & distinct)
    return out.withColumns({c: F.when(use, F.col(f"_new.{c}")).otherwise(F.col(c)) for c in columns}).drop("_new").select(*target.columns, "changed")


def next_registry(old_sources: DataFrame, old_cells: DataFrame, det: DataFrame, sources: DataFrame, cells: DataFrame, assigned: DataFrame) -> dict[str, DataFrame]:
    """The registry after a build: tables sources, cells, detections, ids (label, source_id).

    old_sources: source_id, provisional, ...; old_cells: cell, source_id, ...; det: detection_id, source_id, ...; sources:
    label, ...; cells: cell, label, ...; assigned: detection_id, label. A label keeps the id of the old source with
    which it shares most cells (registry.match_ids), others get ids after the last one. Old sources that are
    not matched go, unless they are provisional; a matched one stays provisional. Detections point to what they are assigned to; the others keep a
    provisional source that stays and lose any other.
    """
    matched = registry.match_ids(registry.overlaps(cells.select(F.col("label"), "cell"), old_cells.select("cell", F.col("source_id").alias("old_id"))))
    matched = written(matched.select("label", F.col("old_id").alias("source_id")))
    last = old_sources.agg(F.max("source_id")).first()[0] or 0
    new = numbered(sources.select("label").join(matched, "label", "left_anti"), ["label"], "source_id", last)
    ids = written(matched.select("label", F.col("source_id").cast("long").alias("source_id")).unionByName(new))
    flags = old_sources.select("source_id", "provisional")
    kept = sources.join(ids, "label").drop("label").join(flags, "source_id", "left").withColumn("provisional", F.coalesce("provisional", F.lit(False)))
    spared = old_sources.filter("provisional").join(ids, "source_id", "left_anti")
    spared_cells = old_cells.join(spared.select("source_id"), "source_id", "left_semi")
    pointed = merged(det, assigned.join(ids, "label").select("detection_id", "source_id"), "detection_id", ["source_id"])
    own = assigned.select("detection_id", F.lit(True).alias("_own"))
    stays = spared.select("source_id", F.lit(True).alias("_stays"))
    clean = pointed.drop("changed").join(own, "detection_id", "left").join(stays, "source_id", "left")
    clean = clean.withColumn("source_id", F.when(F.col("_own") | F.col("_stays"), F.col("source_id"))).select(*det.columns)
    return {
        "sources": kept.unionByName(spared, allowMissingColumns=True),
        "cells": cells.join(ids, "label").drop("label").unionByName(spared_cells, allowMissingColumns=True),
        "detections": clean,
        "ids": ids,
    }


def without_window(sources: DataFrame, cells: DataFrame, passes: DataFrame, det: DataFrame, start: str, end: str) -> dict[str, DataFrame]:
    """The tables as if no run had been over [start, end): its promotions, their cells and passes are gone, its retirements undone, and what pointed to its promotions points nowhere."""
    within = lambda c: F.col(c).isNotNull() & (F.col(c) >= F.lit(start).cast("timestamp_ntz")) & (F.col(c) < F.lit(end).cast("timestamp_ntz"))
    stale = sources.filter((F.col("origin") == "promotion") & within("promoted_at")).select("source_id")
    left = sources.join(stale, "source_id", "left_anti").withColumn("retired_at", F.when(~within("retired_at"), F.col("retired_at")))
    marked = det.join(stale.withColumn("_stale", F.lit(True)), "source_id", "left")
    return {
        "sources": left.select(*sources.columns),
        "cells": cells.join(stale, "source_id", "left_anti").select(*cells.columns),
        "passes": passes.filter(~within("acq_datetime")),
        "detections": marked.withColumn("source_id", F.when(F.col("_stale").isNull(), F.col("source_id"))).select(*det.columns),
    }


def after_inference(tables: dict[str, DataFrame], promoted: DataFrame, promoted_cells: DataFrame, retired: DataFrame, passes: DataFrame, routed: DataFrame, start: str, end: str) -> dict[str, DataFrame]:
    """The tables of without_window() with a run over the window: its promotions as provisional sources, its retirements, passes, and the roads of its detections.

    promoted: source_id, promoted_at, ...; retired: source_id, retired_at; routed: detection_id and the columns that a run sets.
    """
    sources = tables["sources"].unionByName(promoted.withColumns({"provisional": F.lit(True), "origin": F.lit("promotion")}), allowMissingColumns=True)
    sources = merged(sources, retired, "source_id", ["retired_at"]).drop("changed")
    at = F.col("acq_datetime")
    inside = (at >= F.lit(start).cast("timestamp_ntz")) & (at < F.lit(end).cast("timestamp_ntz"))
    columns = [c for c in routed.columns if c != "detection_id"]
    return {
        "sources": sources,
        "cells": tables["cells"].unionByName(promoted_cells, allowMissingColumns=True),
        "passes": tables["passes"].unionByName(passes, allowMissingColumns=True),
        "detections": merged(tables["detections"], routed, "detection_id", columns, inside).drop("changed"),
    }


def after_events(events: DataFrame, det: DataFrame, found: DataFrame, links: DataFrame, start: str, end: str) -> dict[str, DataFrame]:
    """events and detections after a window's events were assembled: they replace those first seen in it, with ids after the last one.

    found: event (any key), first_seen, ...; links: detection_id, event. Detections of the window point to their new events or nowhere.
    """
    inside = lambda c: (F.col(c) >= F.lit(start).cast("timestamp_ntz")) & (F.col(c) < F.lit(end).cast("timestamp_ntz"))
    last = events.agg(F.max("event_id")).first()[0] or 0
    named = written(numbered(found, ["first_seen", "event"], "event_id", last))
    link = links.join(named.select("event", "event_id"), "event").select("detection_id", F.col("event_id").alias("_event"))
    out = det.join(link, "detection_id", "left")
    out = out.withColumn("event_id", F.when(inside("acq_datetime"), F.col("_event")).otherwise(F.col("event_id"))).select(*det.columns)
    return {"events": events.filter(~F.coalesce(inside("first_seen"), F.lit(False))).unionByName(named.drop("event"), allowMissingColumns=True), "detections": out}


def after_scores(events: DataFrame, scored: DataFrame) -> DataFrame:
    """events with risk and breakdown from the scored rows of their event_id; the others keep what they have."""
    return merged(events, scored, "event_id", ["risk", "breakdown"]).drop("changed")


def after_labels(sources: DataFrame, labels: DataFrame) -> dict[str, DataFrame]:
    """labels as they are, and sources with label and evidence from them: null where a source has none any more."""
    bare = sources.drop("label", "evidence").join(labels.select("source_id", "label", "evidence"), "source_id", "left")
    return {"labels": labels, "sources": bare.select(*sources.columns)}
