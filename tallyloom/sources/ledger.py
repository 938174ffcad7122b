"""The stored ledger: a Parquet table of invoices, and one of lines for invoices too long to nest.

Each save writes Parquet into a folder of its own below `data/`. What the ledger consists of is said by manifests, `manifest/<version>`, one folder
name a line: a save is seen, whole, once the next version stands, and a crash before that leaves the ledger as it was. A manifest
is written aside and renamed to the version that follows the one the save started from; where another writer has
taken that version meanwhile, the save fails with `ConcurrentSave` and nothing of it is seen. Older versions stay readable until `vacuum`.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators.dedup import DuplicateInvoice, bulk_outcome
from tallyloom.operators.numbering import ensure_checkpoint_dir, ordered_positions, written
from tallyloom.operators.validate import derive_status, round_money, with_review
from tallyloom.schema import INVOICE, LEDGER_LINE, REJECT


class ConcurrentSave(RuntimeError):
    """Another writer changed the ledger between the beginning of a save and its end."""


@dataclass(frozen=True)
class SaveReport:
    """`rows` has one row per batch row with outcome and reason, fixed before anything was written."""

    rows: DataFrame

    @property
    def created(self) -> DataFrame:
        return self.rows.where(F.col("outcome") == "created")

    @property
    def skipped(self) -> DataFrame:
        return self.rows.where(F.col("outcome") == "skipped").select("invoice_number", "reason")


@dataclass(frozen=True)
class LoadReport:
    inserted: int
    skipped: bool
    existing: int


def to_ledger_rows(
    invoices: DataFrame,
    source: str,
    as_of: date,
    created_at: datetime,
    require_lines: bool = True,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Rounded, validated and stamped, in ledger columns without an id; `keep` columns ride along."""
    reviewed = with_review(round_money(invoices), require_lines)
    defaults = {
        "raw_text": F.lit(None).cast("string"),
        "source": F.lit(source),
        "created_at": F.lit(created_at).cast("timestamp"),
    }
    present = {name: F.col(name) for name in ("raw_text",) if name in invoices.columns}
    stamped = reviewed.withColumn("status", derive_status(as_of)).withColumns({**defaults, **present})
    names = [f for f in INVOICE.fields if f.name != "id"]
    return stamped.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in names], *keep)


def _fixed(df: DataFrame, label: str) -> DataFrame:
    """The frame as Parquet, of which later readers take the columns they need; a checkpoint where Parquet cannot hold it."""
    schema = df.schema.json()
    names = {name.lower() for name in df.columns}
    if len(names) < len(df.columns) or any(part in schema for part in ('"void"', '"interval"', '"udt"', '"fields":[]')):
        return df.checkpoint()
    return written(df, label)


class Ledger:
    """Reads and writes one ledger folder; of two writers at once, one succeeds and the other gets an error."""

    def __init__(self, spark: SparkSession, path: str, version: int | None = None):
        """`version` pins what is read to an older state of the ledger."""
        self.spark = spark
        self.path = path.rstrip("/")
        self.version = version

    # -------------------------------------------------------------- manifests

    def _path(self, part: str):
        """(file system, path) of a part."""
        context = self.spark.sparkContext
        place = context._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}")
        return place.getFileSystem(context._jsc.hadoopConfiguration()), place

    def versions(self) -> list[int]:
        files, folder = self._path("manifest")
        if not files.exists(folder):
            return []
        return sorted(int(x.getPath().getName()) for x in files.listStatus(folder) if x.getPath().getName().isdigit())

    def current(self) -> tuple[int, list[str]]:
        """The version that is read, 0 for an empty ledger, and its data folders."""
        found = [v for v in self.versions() if self.version is None or v <= self.version]
        if not found:
            return 0, []
        files, place = self._path(f"manifest/{found[-1]:012d}")
        stream = files.open(place)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return found[-1], text.split()

    def _commit(self, started_from: int, folders: Sequence[str]) -> None:
        """Make `folders` the ledger, if it is still what it was at version `started_from`."""
        files, aside = self._path(f"manifest/_{uuid.uuid4().hex}")
        _, place = self._path(f"manifest/{started_from + 1:012d}")
        stream = files.create(aside)
        try:
            stream.write(bytearray("\n".join(folders).encode()))
        finally:
            stream.close()
        # A rename does not replace what another writer has put there.
        if files.exists(place) or not files.rename(aside, place):
            files.delete(aside, False)
            raise ConcurrentSave(f"version {started_from + 1} of {self.path} was written by another save")

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete versions but the last `keep`, and data folders that none of those names; says which folders went.

        Run it while nothing is being saved: the folder of a save under way is not named yet.
        """
        kept = self.versions()[-keep:]
        named = {name for v in kept for name in Ledger(self.spark, self.path, v).current()[1]}
        files, data = self._path("data")
        gone = [x.getPath() for x in files.listStatus(data) if x.getPath().getName() not in named] if files.exists(data) else []
        for v in self.versions():
            if v not in kept:
                files.delete(self._path(f"manifest/{v:012d}")[1], False)
        for place in gone:
            files.delete(place, True)
        return sorted(x.getName() for x in gone)

    # -------------------------------------------------------------- reading

    def _read(self, part: str, schema, folders: Sequence[str]) -> DataFrame:
        """A folder without that part adds nothing; any other trouble in reading is an error."""
        places = [f"data/{name}/{part}" for name in folders]
        held = [f"{self.path}/{p}" for p in places if self._path(p)[0].exists(self._path(p)[1])]
        if not held:
            # An empty range, not an empty list: no Python worker is started for it.
            return self.spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])
        return self.spark.read.schema(schema).parquet(*held)

    def invoices(self) -> DataFrame:
        return self._read("invoices", INVOICE, self.current()[1])

    def long_lines(self) -> DataFrame:
        """Lines of the invoices whose `line_items` is null."""
        return self._read("lines", LEDGER_LINE, self.current()[1])

    def rejects(self) -> DataFrame:
        """Files that gave no rows, with the reason."""
        return self._read("rejects", REJECT, self.current()[1])

    def count(self) -> int:
        return self.invoices().count()

    # -------------------------------------------------------------- writing

    def _write_rows(self, rows: DataFrame, order: Sequence[str], folder: str, after: int) -> None:
        """Only numbers and order columns are sorted; the ids then join the rows, whose numbers are unique."""
        keys = rows.select("invoice_number", *order)
        ids = ordered_positions(keys, [F.col(c) for c in order], "id", start=after + 1)
        numbered = rows.join(ids.select("invoice_number", "id"), "invoice_number")
        numbered.select(*INVOICE.fieldNames()).write.parquet(f"{self.path}/data/{folder}/invoices")

    def _put_rejects(self, rejects: DataFrame | None, folder: str) -> None:
        if rejects is not None:
            rejects.select("file", "reason").write.parquet(f"{self.path}/data/{folder}/rejects")

    def save(
        self,
        batch: DataFrame,
        order: Sequence[str],
        source: str = "imported",
        as_of: date | None = None,
        created_at: datetime | None = None,
        on_duplicate: str = "skip",
        long_lines: DataFrame | None = None,
        rejects: DataFrame | None = None,
        batch_id: str | None = None,
    ) -> SaveReport:
        """Save a batch of drafts; numbers already stored or repeated are skipped, or refused.

        `long_lines` (invoice_number, line_no and the line columns) feeds invoices whose `line_items`
        is null; `rejects` (file, reason) are kept beside them. All of it is seen at once. `batch_id` names the batch: what an
        earlier attempt under this name has stored is not stored again, rejects included.
        """
        ensure_checkpoint_dir(self.spark)
        as_of = as_of or date.today()
        created_at = created_at or datetime.now(timezone.utc)
        version, folders = self.current()
        stored = self._read("invoices", INVOICE, folders)
        # Fixed before anything is written: afterwards every number of the batch would count as stored.
        judged = _fixed(bulk_outcome(batch, stored.select("invoice_number"), order, on_duplicate == "error", _fixed), "judged")
        report = SaveReport(judged)
        created = report.created
        name = batch_id or "batch"
        again = any(f.rsplit(".", 1)[0] == name for f in folders) if batch_id else False
        folder = f"{name}.{uuid.uuid4().hex}"
        if long_lines is not None:
            # Where lines name their draft, those of a skipped draft with the same number stay out.
            keys = [c for c in ("file", "draft_key") if c in long_lines.columns and c in created.columns]
            wanted = created.where(F.col("line_items").isNull()).select("invoice_number", *keys)
            if not wanted.isEmpty():
                long_lines.join(wanted, ["invoice_number", *keys], "left_semi").select(
                    *[F.col(f.name).cast(f.dataType).alias(f.name) for f in LEDGER_LINE.fields]
                ).write.parquet(f"{self.path}/data/{folder}/lines")
        marks = {f"_order_{i}": F.col(c) for i, c in enumerate(order)}
        rows = to_ledger_rows(
            created.withColumns(marks), source, as_of, created_at, source == "uploaded", keep=list(marks)
        )
        self._write_rows(rows, list(marks), folder, stored.agg(F.max("id")).first()[0] or 0)
        if not again:
            self._put_rejects(rejects, folder)
        self._commit(version, [*folders, folder])
        return report

    def create(self, draft: DataFrame, order: Sequence[str], **options) -> SaveReport:
        """Strict save of confirmed documents: a duplicate number is an error."""
        return self.save(draft, order, source="uploaded", on_duplicate="error", **options)

    def replace(self, rows: DataFrame, order: Sequence[str]) -> None:
        """Replace the whole ledger, lines and rejects included, with rows in ledger columns; ids are given anew."""
        self._replace(self.current()[0], rows, order)

    def _replace(self, version: int, rows: DataFrame, order: Sequence[str]) -> int:
        folder = f"batch.{uuid.uuid4().hex}"
        numbered = ordered_positions(rows, [F.col(c) for c in order], "id")
        numbered.select(*INVOICE.fieldNames()).write.parquet(f"{self.path}/data/{folder}/invoices")
        self._commit(version, [folder])
        return self._read("invoices", INVOICE, [folder]).count()

    def load_if_empty(self, rows: DataFrame, order: Sequence[str], force: bool = False) -> LoadReport:
        """Load only into an empty ledger, unless forced; says what was there. Two loads at once cannot both succeed."""
        version, folders = self.current()
        existing = self._read("invoices", INVOICE, folders).count()
        if existing and not force:
            return LoadReport(0, True, existing)
        return LoadReport(self._replace(version, rows, order), False, existing)
