"""Edit logs over cells: the latest value of each cell wins, and applying a log twice changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import catalog as C
from . import sequence


def latest(edits: DataFrame, key: list[str], order: str = "seq") -> DataFrame:
    """The last edit of each cell, reduced before it is exchanged."""
    others = [c for c in edits.columns if c not in key]
    return edits.groupBy(*key).agg(F.max_by(F.struct(*others), F.col(order)).alias("e")).select(*key, "e.*")


def apply(cells: DataFrame, edits: DataFrame, key: list[str]) -> DataFrame:
    """``cells`` (key, text, score, is_manual_edit) after ``edits`` (key, value, seq).

    A value that differs after trimming is stored as a manual edit at score 100; edits of cells that do
    not exist are ignored.
    """
    last = latest(edits, key).select(*key, T.clean(F.col("value")).alias("__new"))
    met = cells.join(last, key, "left")
    changed = F.col("__new").isNotNull() & (F.col("__new") != T.clean(F.col("text")))
    same = [c for c in cells.columns if c not in ("text", "score", "is_manual_edit")]
    return met.select(
        *same,
        F.when(changed, F.col("__new")).otherwise(F.col("text")).alias("text"),
        F.when(changed, 100).otherwise(F.col("score")).cast("int").alias("score"),
        (F.coalesce(F.col("is_manual_edit"), F.lit(False)) | changed).alias("is_manual_edit"),
    )


def apply_with_anchor(cells: DataFrame, edits: DataFrame, key: tuple[str, ...] = sequence.KEY) -> DataFrame:
    """``apply`` to ``cells`` (key, row, role, text, score, is_anchor, is_manual_edit) with number columns rebuilt.

    A changed anchor of a number column (role batch) renumbers its column from the new value and is no
    manual edit; the column's other edits are manual and survive that. Header rows (0) take no edits.
    """
    own = [*key, "row"]
    first = F.min(F.when(F.col("is_anchor"), F.col("row"))).over(Window.partitionBy(*key))
    marked = cells.withColumn("__anchor", (F.coalesce("role", F.lit("")) == "batch") & F.coalesce(F.col("row") == first, F.lit(False)))
    last = latest(edits.where("row > 0"), own).select(*own, T.clean(F.col("value")).alias("__new"))
    met = marked.join(last, own, "left")
    changed = F.col("__new").isNotNull() & (F.col("__new") != T.clean(F.col("text")))
    manual = changed & ~F.col("__anchor")
    same = [c for c in cells.columns if c not in ("text", "score", "is_manual_edit")]
    edited = met.select(
        *same,
        F.when(changed, F.col("__new")).otherwise(F.col("text")).alias("text"),
        F.when(manual, 100).otherwise(F.col("score")).cast("int").alias("score"),
        (F.coalesce(F.col("is_manual_edit"), F.lit(False)) | manual).alias("is_manual_edit"),
        F.max(changed & F.col("__anchor")).over(Window.partitionBy(*key)).alias("__rebuild"),
    )
    columns = [*same, "text", "score", "is_manual_edit"]
    done = sequence.rebuild(edited.where("__rebuild").drop("__rebuild"), key=key)
    return edited.where("not __rebuild").select(*columns).union(done.select(*columns))


def pending_species(edits: DataFrame, species: DataFrame) -> DataFrame:
    """What is offered for saving: each unknown name once a page, with ``nth`` 1 where it is shown (names once in all)."""
    unknown = unknown_species(edits, species)
    return unknown.withColumn("nth", F.row_number().over(Window.partitionBy("name").orderBy("page")))


def save_species(pending: DataFrame, species: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``species`` with the saved ``names`` added, and ``pending`` without any row of those names."""
    return C.append(species, names), pending.join(names.select("name").distinct(), "name", "left_anti")


def positions_to_rows(deltas: DataFrame, displayed: DataFrame, labels: DataFrame) -> DataFrame:
    """Deltas (display_pos, label, value, seq) as cell edits, by the shown rows (display_pos, row) and columns (label, col)."""
    return deltas.join(displayed, "display_pos").join(labels, "label").select("row", "col", "value", "seq")


def unknown_species(edits: DataFrame, species: DataFrame) -> DataFrame:
    """Distinct (page, name) that the catalogue lacks; the ditto mark is never unknown."""
    names = edits.select("page", T.clean(F.col("value")).alias("name")).where((F.col("name") != "") & (F.col("name") != T.DITTO))
    return C.unknown(names.dropDuplicates(), species)


def accept_alternative(cells: DataFrame, chosen) -> DataFrame:
    """Swap the text with its first alternative where ``chosen``; the score rises to 60 at least."""
    hit = chosen & (F.size("alternatives") > 0)
    swapped = F.concat(F.array("text"), F.slice("alternatives", 2, F.greatest(F.size("alternatives") - 1, F.lit(0))))
    same = [c for c in cells.columns if c not in ("text", "score", "alternatives", "is_manual_edit")]
    return cells.select(
        *same,
        F.when(hit, F.get("alternatives", F.lit(0))).otherwise(F.col("text")).alias("text"),
        F.when(hit, F.greatest("score", F.lit(60))).otherwise(F.col("score")).alias("score"),
        F.when(hit, swapped).otherwise(F.col("alternatives")).alias("alternatives"),
        (F.coalesce(F.col("is_manual_edit"), F.lit(False)) | hit).alias("is_manual_edit"),
    )
