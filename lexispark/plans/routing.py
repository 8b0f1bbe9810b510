"""How an update is carried out: a pure decision over counts."""

from __future__ import annotations

from dataclasses import dataclass

COMPACT_BLOCKS = 8


@dataclass(frozen=True)
class Route:
    route: str
    code: str
    then: str | None = None
    detail: str = ""

    @property
    def folds(self) -> bool:
        return self.route == "fold_first"


def route_update(*, n_added: int = 0, n_changed: int = 0, n_removed: int = 0, n_oov: int = 0, n_tomb_rows: int = 0, n_tomb_seg_rows: int = 0, n_segments: int = 0, n_blocks: int = 1, dense_on: bool = False, batch_nnz: int = 0, total_nnz: int = 0, compact_blocks: int = COMPACT_BLOCKS, rebuild_batch_nnz: int | None = None) -> Route:
    """The first row of the table whose condition holds; negative counts and compact_blocks below 2 are errors."""
    counts = {"n_added": n_added, "n_changed": n_changed, "n_removed": n_removed, "n_oov": n_oov, "n_tomb_rows": n_tomb_rows, "n_tomb_seg_rows": n_tomb_seg_rows, "n_segments": n_segments, "n_blocks": n_blocks, "batch_nnz": batch_nnz, "total_nnz": total_nnz}
    if bad := [k for k, v in counts.items() if v < 0]:
        raise ValueError(f"negative: {', '.join(bad)}")
    if compact_blocks < 2:
        raise ValueError("compact_blocks must be 2 or more")
    held = n_segments > 0
    table = (
        (not (n_added or n_changed or n_removed), Route("noop", "noop", None, "nothing changed")),
        (held and n_tomb_seg_rows > 0, Route("fold_first", "fold_then_tomb_segment", "staged" if n_oov else "incremental", "rows inside a mounted segment go")),
        (held and not n_oov, Route("fold_first", "fold_then_incremental", "incremental", "rows can't be appended under mounted segments")),
        (held and dense_on, Route("fold_first", "fold_then_rebuild_dense", "rebuild", "new terms while dense vectors are kept")),
        (held and n_blocks >= compact_blocks, Route("fold_first", "fold_then_staged_blocks", "staged", "too many blocks")),
        (not n_oov, Route("incremental", "incremental", None, "all terms are known")),
        (dense_on, Route("rebuild", "rebuild_dense", None, "new terms while dense vectors are kept")),
        (rebuild_batch_nnz is not None and batch_nnz > rebuild_batch_nnz, Route("rebuild", "rebuild_batch_too_big", None, "the batch is larger than a rebuild is worth")),
        (True, Route("staged", "staged", None, "new terms enter as a segment")),
    )
    return next(r for holds, r in table if holds)
