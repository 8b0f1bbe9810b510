"""The update routes, a case for each row of the table and its borders."""

import pytest

from lexispark.plans.routing import route_update

CASES = [
    ({}, ("noop", None, "noop")), ({"n_oov": 3, "n_segments": 1}, ("noop", None, "noop")),
    ({"n_added": 1}, ("incremental", None, "incremental")), ({"n_removed": 1}, ("incremental", None, "incremental")), ({"n_changed": 1, "dense_on": True}, ("incremental", None, "incremental")),
    ({"n_added": 1, "n_oov": 1}, ("staged", None, "staged")), ({"n_added": 1, "n_oov": 1, "n_blocks": 20}, ("staged", None, "staged")),
    ({"n_added": 1, "n_oov": 1, "dense_on": True}, ("rebuild", None, "rebuild_dense")),
    ({"n_added": 1, "n_oov": 1, "batch_nnz": 11, "rebuild_batch_nnz": 10}, ("rebuild", None, "rebuild_batch_too_big")), ({"n_added": 1, "n_oov": 1, "batch_nnz": 10, "rebuild_batch_nnz": 10}, ("staged", None, "staged")),
    ({"n_added": 1, "batch_nnz": 11, "rebuild_batch_nnz": 10}, ("incremental", None, "incremental")),
    ({"n_added": 1, "n_segments": 1}, ("fold_first", "incremental", "fold_then_incremental")), ({"n_added": 1, "n_oov": 1, "n_segments": 1}, ("staged", None, "staged")),
    ({"n_added": 1, "n_oov": 1, "n_segments": 1, "n_blocks": 7}, ("staged", None, "staged")), ({"n_added": 1, "n_oov": 1, "n_segments": 1, "n_blocks": 8}, ("fold_first", "staged", "fold_then_staged_blocks")),
    ({"n_added": 1, "n_oov": 1, "n_segments": 1, "n_blocks": 3, "compact_blocks": 3}, ("fold_first", "staged", "fold_then_staged_blocks")),
    ({"n_added": 1, "n_oov": 1, "n_segments": 1, "dense_on": True, "n_blocks": 9}, ("fold_first", "rebuild", "fold_then_rebuild_dense")),
    ({"n_removed": 1, "n_segments": 1, "n_tomb_rows": 2, "n_tomb_seg_rows": 1}, ("fold_first", "incremental", "fold_then_tomb_segment")),
    ({"n_changed": 1, "n_oov": 2, "n_segments": 1, "n_tomb_rows": 2, "n_tomb_seg_rows": 1, "dense_on": True}, ("fold_first", "staged", "fold_then_tomb_segment")),
    ({"n_removed": 1, "n_tomb_rows": 2, "n_tomb_seg_rows": 1}, ("incremental", None, "incremental")),
]


@pytest.mark.parametrize(("counts", "wanted"), CASES)
def test_route(counts, wanted):
    r = route_update(**counts)
    assert (r.route, r.then, r.code) == wanted and r.folds == (wanted[0] == "fold_first")


@pytest.mark.parametrize("counts", [{"n_added": -1}, {"n_blocks": -2}, {"compact_blocks": 1}])
def test_bad_counts(counts):
    with pytest.raises(ValueError):
        route_update(**counts)
