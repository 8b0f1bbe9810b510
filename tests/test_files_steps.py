"""Files are found by their folder and cut without a join."""

from lexispark.index import index as steps
from lexispark.sources import files


def test_files_are_found_by_their_folder_and_cut_without_a_join(spark, tmp_path):
    (tmp_path / "root").mkdir()
    for i in range(3):
        (tmp_path / "root" / f"f{i}.txt").write_text(f"a text that is long enough, number {i}\n")
    scanned = files.scan(spark, f"file://{tmp_path}/root")
    assert "InMemoryFileIndex(1 paths)" in scanned._jdf.queryExecution().toString()
    assert "Join" not in steps._chunk(scanned.localCheckpoint())._jdf.queryExecution().executedPlan().toString()
    assert scanned.select("rel").orderBy("rel").collect() == [(f"f{i}.txt",) for i in range(3)]
    (tmp_path / "root" / "x.png").write_bytes(b"not to be read")  # what is left out isn't read
    assert "InMemoryFileIndex(3 paths)" in files.scan(spark, f"file://{tmp_path}/root")._jdf.queryExecution().toString()
