"""From files to a saved batch: stage, map, convert, save."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators import convert as C
from tallyloom.operators import mapping as M
from tallyloom.sources.staging import Staged, stage_files


@dataclass(frozen=True)
class Preview:
    """Everything known about a batch of exports before anything is saved; frames keyed by `file`."""

    mapping: DataFrame
    drafts: C.Drafts
    unmapped: DataFrame
    warnings: DataFrame
    summary: DataFrame
    rejects: DataFrame | None


def preview_staged(staged: Staged, supplied: DataFrame | None = None, as_of: date | None = None) -> Preview:
    mapping = M.choose_mapping(staged.cells, staged.headers, supplied)
    rows = C.rows_from_cells(staged.cells, mapping)
    drafts = C.convert(rows, as_of)
    return Preview(
        mapping,
        drafts,
        M.unmapped_columns(mapping, staged.headers),
        C.file_warnings(rows, as_of),
        C.preview_summary(rows, drafts.headers),
        staged.rejects,
    )


def preview_files(files: DataFrame, supplied: DataFrame | None = None, as_of: date | None = None) -> Preview:
    """Preview rows of (path, content). Files are decoded once, into the shared checkpoint folder."""
    return preview_staged(stage_files(files), supplied, as_of)


def long_lines(preview: Preview, drafts: DataFrame) -> DataFrame:
    """Numbered lines of the drafts that were too long to nest, under their invoice number."""
    wide = drafts.where(F.col("line_items").isNull()).select("file", "draft_key", "invoice_number")
    return preview.drafts.numbered_lines().join(wide, ["file", "draft_key"])
