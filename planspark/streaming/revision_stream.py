"""Revisions of sheets as a stream: each incoming page is held against what its sheet has had, which is the stream's state.

State of a sheet: the revisions by content and by label, and the current one. A page is answered from the state alone, so a batch
costs what it brings, and a stream that starts again from its checkpoint goes on where it stopped. It needs the RocksDB state
store (``spark.sql.streaming.stateStore.providerClass``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What a page is to its sheet, its revision's label and status, the revision it repeats or supersedes, and whether the label was printed.
EVENT = "sheet_number string, upload string, uploaded_at timestamp, kind string, rev_label string, rev_assumed boolean, status string, of_upload string"
COLUMNS = ["sheet_number", "upload", "uploaded_at", "kind", "rev_label", "rev_assumed", "status", "of_upload"]
#: Labels of revisions that print none, or one that another page has.
FIRST, UNLABELLED, ALTERNATIVE = "Rev.0", "Unlabelled {upload}", "{label} (alt {upload})"


class SheetRevisions(StatefulProcessor):
    """One sheet's pages in the order of their upload.

    The first page of a sheet is accepted and current; a page whose content a revision has is a duplicate of it; other pages are
    new revisions that wait, in conflict if their label is taken. Pages without a sheet number are told as such and keep no state.
    With ``forget_ms`` revisions that no page has repeated for so long are forgotten, and with the last of them the sheet.
    """

    def __init__(self, forget_ms: int | None = None) -> None:
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.contents = handle.getMapState("contents", "content_hash string", "upload string", self.forget_ms)
        self.labels = handle.getMapState("labels", "rev_label string", "upload string", self.forget_ms)
        self.current = handle.getValueState("current", "upload string", self.forget_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        pages = pd.concat(list(rows)).sort_values(["uploaded_at", "upload"], kind="stable")
        out = [self._event(key[0], *p) for p in zip(pages["upload"], pages["uploaded_at"], pages["rev_label"], pages["content_hash"], strict=True)]
        yield pd.DataFrame(out, columns=COLUMNS)

    def _event(self, sheet: str | None, upload: str, at, label: str | None, content: str | None) -> tuple:
        if not sheet:
            return sheet, upload, at, "unnumbered", None, None, None, None
        if content is not None and self.contents.containsKey((content,)):
            (of,) = self.contents.getValue((content,))
            self.contents.updateValue((content,), (of,))  # seen again: it lives on
            return sheet, upload, at, "duplicate", None, None, None, of
        before = self.current.get()[0] if self.current.exists() else None
        kind, status = ("new_sheet", "accepted") if before is None else ("new_revision", "pending")
        named, assumed = label or (FIRST if before is None else UNLABELLED.format(upload=upload)), not label
        if before is not None and label and self.labels.containsKey((label,)):
            kind, named = "conflict", ALTERNATIVE.format(label=label, upload=upload)
        if content is not None:
            self.contents.updateValue((content,), (upload,))
        self.labels.updateValue((named,), (upload,))
        if before is None:
            self.current.update((upload,))
        return sheet, upload, at, kind, named, assumed, status, before

    def close(self) -> None:
        pass


def revisions(pages: DataFrame, forget_ms: int | None = None) -> DataFrame:
    """EVENT of every page of a stream: sheet_number, upload, uploaded_at, rev_label (null if none is printed), content_hash.

    of_upload is the revision that a duplicate repeats, or the current one that a new revision would supersede.
    """
    kept = pages.select("sheet_number", "upload", "uploaded_at", "rev_label", "content_hash")
    return kept.groupBy("sheet_number").transformWithStateInPandas(SheetRevisions(forget_ms), EVENT, "Append", "ProcessingTime" if forget_ms else "None")
