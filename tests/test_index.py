"""The persistent index: ways that must agree do agree, and what is refused."""

import json
import math
import os
import re
import shutil
import time
from collections import Counter

import pytest

from lexispark import ConflictError, Index, ViewError, open_index
from lexispark.operators.bm25 import approximate_top_k, top_k_single
from lexispark.sources.local import local_rows

CHUNK = "docid string, file string, line int, text string"
TEXTS = ["the cat sat on the mat", "a dog sat on a log", "the dog chased the cat", "birds sing in the morning light", "cat cat cat and one dog", "zebra crossing near the river bank", "", "morning light on the river"]
QUERIES = ["cat", "dog river", "the morning", "zzz", "cat zzz dog dog", ""]


def rows(spark, texts, first=0):
    return local_rows(spark, [(f"d{first + i:03d}", f"f{(first + i) % 3}.txt", first + i + 1, t) for i, t in enumerate(texts)], CHUNK)


def create(spark, path, texts=TEXTS):
    """An index whose row numbers are the texts' places."""
    return Index.create(spark, str(path), local_rows(spark, [(f"d{i:03d}", "f.txt", i + 1, t) for i, t in enumerate(texts)], CHUNK))


def plain(texts, queries=QUERIES, k1=1.5, b=0.75, dead=(), vocabulary=None):
    """Scores by the formula, a document at a time."""
    toks = [re.findall(r"\w+", t.lower()) for t in texts]
    alive = [i for i in range(len(texts)) if i not in dead]
    known = vocabulary if vocabulary is not None else {t for x in toks for t in x}
    df = Counter(t for i in alive for t in set(toks[i]) if t in known)
    n, avg = len(alive), sum(len(toks[i]) for i in alive) / max(len(alive), 1) or 1.0
    out = []
    for q in queries:
        scores = {}
        for i in alive:
            tf = Counter(toks[i])
            s = sum(math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1) * tf[t] * (k1 + 1) / (tf[t] + k1 * (1 - b + b * len(toks[i]) / avg)) for t in set(re.findall(r"\w+", q.lower())) if tf[t] and t in known)
            if s > 0:
                scores[i] = s
        out.append(sorted(((round(s, 9), i) for i, s in scores.items()), key=lambda x: (-x[0], x[1])))
    return out


def found(index, queries=QUERIES, k=100):
    """(score, number in docid) of each query's hits."""
    return [[(round(h["score"], 9), int(h["docid"][1:])) for h in hits] for hits in index.search_batch(list(queries), k)]


def exact(index):
    return sorted(map(tuple, index.scores([q for q in QUERIES if q]).collect()))


def test_scores_by_the_formula_and_after_reopening(spark, tmp_path):
    index = create(spark, tmp_path)
    assert found(index) == plain(TEXTS)
    assert exact(open_index(spark, str(tmp_path))) == exact(index)
    hit = index.search("zebra")[0]
    assert hit["rank"] == 1 and hit["file"] == "f.txt" and hit["line"] == 6 and hit["text"] == TEXTS[5]
    assert "text" not in index.search("zebra", with_text=False)[0]
    assert index.search("cat", 0) == [] and index.search_batch([], 3) == []
    assert [index.search(q, 4) for q in QUERIES] == index.search_batch(QUERIES, 4)
    with pytest.raises(FileNotFoundError):
        open_index(spark, str(tmp_path / "none"))


def test_tune_touches_no_table(spark, tmp_path):
    index = create(spark, tmp_path)
    before = sorted(os.listdir(tmp_path / "data"))
    index.tune(0.6, 0.3)
    assert found(index) == plain(TEXTS, k1=0.6, b=0.3) and sorted(os.listdir(tmp_path / "data")) == before
    assert found(open_index(spark, str(tmp_path))) == plain(TEXTS)
    index.tune(k1=0.6, persist=True)
    again = open_index(spark, str(tmp_path))
    assert found(again) == plain(TEXTS, k1=0.6, b=0.3) and again.tune()["after"] == {"k1": 0.6, "b": 0.3}


def test_more_of_a_term_scores_more(spark, tmp_path):
    index = create(spark, tmp_path, ["alpha beta gamma delta", "alpha alpha gamma delta", "beta gamma delta eps"])
    assert [i for _, i in found(index, ["alpha"])[0]] == [1, 0]


def test_topk_is_zero_filled(spark, tmp_path):
    index = create(spark, tmp_path)
    top = index.topk("cat", 100)
    assert len(top) == len(TEXTS) and [s for _, s in top] == sorted((s for _, s in top), reverse=True) and [r for r, s in top if s == 0] == [1, 3, 5, 6, 7]
    assert len(index.topk("cat", 2)) == 2 and index.topk("zzz", 5) == [] and index.topk("cat", 0) == []


def test_append_delete_upsert(spark, tmp_path):
    index = create(spark, tmp_path)
    words = {t for x in TEXTS for t in x.split()}
    new = ["cat river newword", "", "allnew words2"]
    assert index.append(rows(spark, new, 8)) == 3
    assert found(index) == plain(TEXTS + new, vocabulary=words)
    index.delete(local_rows(spark, [(0,), (0,), (4,), (999,), (-1,)], "row long"))
    index.delete(local_rows(spark, [(0,)], "row long"))
    assert found(index) == plain(TEXTS + new, dead={0, 4}, vocabulary=words)
    index.upsert(local_rows(spark, [(2,)], "row long"), rows(spark, ["dog cat dog"], 11))
    final = TEXTS + new + ["dog cat dog"]
    assert found(index) == plain(final, dead={0, 2, 4}, vocabulary=words)
    assert exact(open_index(spark, str(tmp_path))) == exact(index)
    assert index.reconcile().count() == 0
    index.compact()
    assert found(open_index(spark, str(tmp_path))) == plain(final, dead={0, 2, 4}, vocabulary=words)
    assert index.stats()["rows"] == 12 and index.stats()["live"] == 9


def test_segments_equal_a_rebuild(spark, tmp_path):
    index = create(spark, tmp_path / "a", TEXTS[:4])
    base = exact(index)
    one, two = rows(spark, TEXTS[4:6], 4), rows(spark, TEXTS[6:], 6)
    info = index.publish(one, tag="one")
    assert info["row_base"] == 4 and info["rows"] == 2 and info["new_terms"] == len({t for x in TEXTS[4:6] for t in x.split()} - {t for x in TEXTS[:4] for t in x.split()})
    index.publish(two, tag="two")
    whole = plain(TEXTS)
    assert found(index) == whole and exact(open_index(spark, str(tmp_path / "a"))) == exact(index)
    for refused in (lambda: index.append(one), index.save, index.weights, lambda: index.unmount("one"), index.rebuild):
        with pytest.raises(RuntimeError):
            refused()
    with pytest.raises(KeyError):
        index.unmount("none")
    with pytest.raises(ValueError):
        index.publish(one, tag="one")
    index.unmount("two")
    index.unmount("one")
    assert exact(index) == base and index.segments() == []
    index.publish(one, tag="three")
    index.publish(two)
    mounted = exact(index)
    index.fold("three")
    assert exact(index) == mounted
    with pytest.raises(RuntimeError):
        index.unmount("three")
    assert index.fold_all() == ["seg-000007"] or len(index.segments()) == 0
    assert exact(index) == mounted and found(open_index(spark, str(tmp_path / "a"))) == whole
    assert {r["status"] for r in index.remount()} == {"folded"}
    index.compact()
    assert exact(index) == mounted


def test_mounting_a_written_folder(spark, tmp_path):
    index = create(spark, tmp_path, TEXTS[:4])
    folder = index.write_segment(rows(spark, TEXTS[4:], 4))
    assert found(index) == plain(TEXTS[:4])
    index.mount(folder, "late")
    assert found(index) == plain(TEXTS)
    with pytest.raises(RuntimeError):
        index.mount(folder, "twice")
    with pytest.raises(FileNotFoundError):
        index.mount(folder + "-none", "x")


def test_missing_segment_is_reported(spark, tmp_path):
    index = create(spark, tmp_path, TEXTS[:4])
    folder = index.publish(rows(spark, TEXTS[4:], 4), tag="gone")["dir"]
    shutil.rmtree(folder.removeprefix("file:"))
    again = open_index(spark, str(tmp_path))
    assert again.remount() == [{"tag": "gone", "status": "stale", "reason": f"{folder} is incomplete"}]
    assert found(again) == plain(TEXTS[:4])
    with pytest.raises(RuntimeError):
        again.fold("gone")


def test_stage(spark, tmp_path):
    index = create(spark, tmp_path, TEXTS[:4])
    stage = index.stage_begin("batch")
    with pytest.raises(RuntimeError):
        stage.publish()
    stage.add("d004", TEXTS[4], "f.txt", 5)
    stage.add_many([(f"d{i:03d}", "f.txt", i + 1, TEXTS[i]) for i in (5, 6)])
    stage.add_many(rows(spark, TEXTS[7:], 7))
    assert stage.pending() == 4 and stage.report()["open"]
    assert stage.publish(fold=True)["rows"] == 4
    assert found(index) == plain(TEXTS)
    with pytest.raises(RuntimeError):
        stage.add("x", "y")
    other = index.stage_begin()
    other.add("x", "y")
    other.abort()
    with pytest.raises(RuntimeError):
        other.publish()


def test_log(spark, tmp_path):
    index = create(spark, tmp_path)
    twin = open_index(spark, str(tmp_path))
    for i in range(3):
        index.append(rows(spark, [f"cat number{i}"], 8 + i))
    assert open_index(spark, str(tmp_path)).load_report == {"applied": 4, "stopped": False, "error": None}
    with pytest.raises(ConflictError):
        twin.append(rows(spark, ["cat"], 8))
    with pytest.raises(RuntimeError):
        twin.publish(rows(spark, ["cat"], 8))
    words = {t for x in TEXTS for t in x.split()}
    assert found(open_index(spark, str(tmp_path), upto=1)) == plain([*TEXTS, "cat number0"], vocabulary=words)
    assert index.history() == [0, 1, 2, 3]
    log = tmp_path / "_log"
    (log / "0000000004.json.abc.tmp").write_text("{half")
    assert open_index(spark, str(tmp_path)).load_report["applied"] == 4
    (log / "0000000004.json").write_text("{half")
    report = open_index(spark, str(tmp_path)).load_report
    assert report["applied"] == 4 and report["stopped"]
    (log / "0000000004.json").write_text(json.dumps({"seq": 4, "kind": "append", "base_rows": 5, "rows_after": 6}))
    report = open_index(spark, str(tmp_path)).load_report
    assert report["stopped"] and "continues 5" in report["error"]
    (log / "0000000004.json").unlink()
    (log / "0000000002.json").unlink()
    later = open_index(spark, str(tmp_path))
    assert later.load_report["applied"] == 2 and later.load_report["stopped"]
    assert found(later) == plain([*TEXTS, "cat number0"], vocabulary=words)


def test_compaction_after_many_commits(spark, tmp_path):
    index = create(spark, tmp_path)
    with pytest.raises(KeyError):
        index.config(none=1)
    with pytest.raises(ValueError):
        index.config(persist="x")
    index.config(compact_commits=2)
    for i in range(3):
        index.append(rows(spark, ["cat dog"], 8 + i))
    assert any(json.loads(p.read_text())["kind"] == "compact" for p in (tmp_path / "_log").glob("*.json"))
    assert found(open_index(spark, str(tmp_path))) == plain(TEXTS + ["cat dog"] * 3)


def kinds(path):
    return [(c["kind"], c.get("tier")) for c in (json.loads(p.read_text()) for p in sorted((path / "_log").glob("*.json")))]


def test_tiers_of_compaction(spark, tmp_path):
    """Deltas are merged beside the base; once they hold a share of its postings, all is rewritten."""
    index = create(spark, tmp_path / "a")
    index.config(compact_commits=2, compact_ratio=100.0)
    base = index.state.parts[0]
    for i in range(4):
        index.append(rows(spark, ["cat dog"], 8 + i), local_rows(spark, [(i,)], "row long"))
    assert kinds(tmp_path / "a").count(("compact", 1)) >= 2 and index.state.parts[0] == base and len(index.state.parts) <= 3 and len(index.state.dead) <= 2
    again = open_index(spark, str(tmp_path / "a"))
    assert found(again) == plain(TEXTS + ["cat dog"] * 4, dead={0, 1, 2, 3}, vocabulary={t for x in TEXTS for t in x.split()}) and again.reconcile().count() == 0
    index = create(spark, tmp_path / "b")
    index.config(compact_ratio=0.3)
    for i in range(2):
        index.append(rows(spark, ["the cat sat on the mat and the dog chased birds in the morning"], 8 + i))
    assert ("compact", 2) in kinds(tmp_path / "b") and ("compact", 1) not in kinds(tmp_path / "b") and index.reconcile().count() == 0


def test_compact_without_a_rewrite(spark, tmp_path):
    index = create(spark, tmp_path, TEXTS[:4])
    index.publish(rows(spark, TEXTS[4:], 4), tag="one", generation=3)
    assert index.segments()[0]["generation"] == 3
    log = index.history()
    assert index.compact(persist=False)["folded"] == ["one"] and index.history() == log and index.segments() == [] and found(index) == plain(TEXTS)
    again = open_index(spark, str(tmp_path))
    assert [s["tag"] for s in again.segments()] == ["one"]
    parts = again.state.parts[:]
    assert again.compact(persist="delta")["folded"] == ["one"] and again.state.parts[: len(parts)] == parts and len(again.state.parts) == 2
    with pytest.raises(ValueError):
        again.compact(persist="x")


def test_appends_and_searches_read_no_old_postings(spark, tmp_path):
    """Everything but the postings of the query's terms comes from lexicons and commits: with the postings' folder gone an append and a publish still work."""
    index = create(spark, tmp_path)
    base = index.state.parts[0].removeprefix("file:")
    shutil.move(f"{base}/postings", f"{base}/away")
    index.append(rows(spark, ["cat unheard"], 8), local_rows(spark, [(0,)], "row long"))
    assert index.publish(rows(spark, ["more unheard words"], 9), tag="s")["new_terms"] == 3
    assert index.numbers().n_live == 9 and {r["term"]: r["df"] for r in index.lexicon(["cat", "mat", "unheard"]).collect()} == {"cat": 3, "mat": 0, "unheard": 1}
    shutil.move(f"{base}/away", f"{base}/postings")
    assert index.reconcile().count() == 0
    lexicon = index.lexicon(["cat"])
    assert all("/lexicon" in f for f in lexicon.inputFiles()) and "EqualTo(term,cat)" in lexicon._jdf.queryExecution().executedPlan().toString()


def test_tombstones_of_a_word_that_was_unknown(spark, tmp_path):
    """A word without a posting when its row came, known later: deleting the row takes nothing from the word's df."""
    index = create(spark, tmp_path, TEXTS[:4])
    index.append(rows(spark, ["cat zebra"], 4))
    index.fold(index.publish(rows(spark, ["zebra zebra"], 5))["tag"])
    assert {r["term"]: r["df"] for r in index.lexicon(["zebra"]).collect()} == {"zebra": 1}
    index.delete(local_rows(spark, [(4,)], "row long"))
    assert {r["term"]: r["df"] for r in index.lexicon(["zebra"]).collect()} == {"zebra": 1} and index.reconcile().count() == 0


def test_unmount_takes_its_tombstones_along(spark, tmp_path):
    index = create(spark, tmp_path, TEXTS[:4])
    before = exact(index)
    index.publish(rows(spark, TEXTS[4:6], 4), tag="a")
    index.delete(local_rows(spark, [(4,)], "row long"))
    index.unmount("a")
    assert exact(index) == before
    index.publish(rows(spark, TEXTS[4:], 4), tag="b")
    assert found(index) == plain(TEXTS) and index.reconcile().count() == 0


def test_stored_weights_and_upsert_rows(spark, tmp_path):
    index = create(spark, tmp_path)
    assert index.save(w_cache=True)["w_cache"]
    again = open_index(spark, str(tmp_path))
    folders = set(os.listdir(tmp_path / "data"))
    again.config(materialised=True)
    assert exact(again) == exact(index) and set(os.listdir(tmp_path / "data")) == folders
    assert again.upsert(local_rows(spark, [(0,)], "row long"), rows(spark, ["cat", "dog"], 8)) == range(8, 10)
    assert found(again) == plain(TEXTS + ["cat", "dog"], dead={0}) and set(os.listdir(tmp_path / "data")) > folders
    assert [r["row"] for r in again.rows(0, 3).orderBy("row").collect()] == [1, 2]
    copy = again.save(str(tmp_path / "copy"), w_cache=True)
    assert copy["scope"] == "copy" and open_index(spark, copy["path"]).state.weights is not None


def test_a_chunk_without_postings_is_unavailable(spark, tmp_path):
    index = create(spark, tmp_path, TEXTS[:4])
    folder = index.publish(local_rows(spark, [("d9", "lost.txt", 1, "the cat ran")], CHUNK), tag="gone")["dir"].removeprefix("file:")
    shutil.rmtree(f"{folder}/postings")
    again = open_index(spark, str(tmp_path))
    assert {r["term"]: (r["status"], r["tf"]) for r in again.explain("cat zzz", docid="lost")} == {"cat": ("unavailable", None), "zzz": ("oov", 0)}
    with pytest.raises(KeyError):
        again.explain("cat", docid="none")


def test_weights(spark, tmp_path):
    index = create(spark, tmp_path)
    before = exact(index)
    index.config(materialised=True)
    assert exact(index) == before
    index.tune(0.5)
    assert found(index) == plain(TEXTS, k1=0.5)
    index.append(rows(spark, ["cat"], 8))
    assert found(index) == plain([*TEXTS, "cat"], k1=0.5)


def test_approximate_top_k_is_exact_here(spark):
    scored = local_rows(spark, [(i, float((i * 7919) % 5000) / 7 if i % 16 == 0 else 0.0) for i in range(5000)], "row long, score double")
    for k in (1, 10, 100, 400):
        assert approximate_top_k(scored, k).collect() == top_k_single(scored, k).collect()


def test_explain_and_diagnose(spark, tmp_path):
    index = create(spark, tmp_path)
    index.delete(local_rows(spark, [(0,)], "row long"))
    for k, q in ((1, "cat dog zzz zebra"), (2, "dog dog cat")):
        hit = index.search(q, k)[k - 1]
        parts = index.explain(q, k=k)
        assert abs(sum(p["contribution"] for p in parts) - hit["score"]) < 1e-9
    parts = {p["term"]: p for p in index.explain("cat dog dog zzz zebra", top=1)}
    assert sorted(p["status"] for p in parts.values()) == ["no_tf", "ok", "oov"] and parts["zzz"]["contribution"] == 0 and not parts["zzz"]["in_vocab"]
    assert index.explain("zzz") == [] and index.explain("zzz", diagnose=True)["diagnosis"]["status"] == "all_oov"
    assert index.explain("the", docid="f.t")[0]["status"] == "ok"
    with pytest.raises(KeyError):
        index.explain("cat", docid="none")
    wanted = {"": "no_tokens", "zzz": "all_oov", "mat": "no_positive", "cat zzz": "partial_oov", "cat": "ok"}
    assert {q: index.diagnose(q)["status"] for q in wanted} == wanted
    report = index.diagnose("the cat cat zzz", k=1)
    assert report["vocab"]["missing"] == ["zzz"] and {m["what"] for m in report["messages"]} >= {"out_of_vocabulary", "more_hits"}
    assert [t["q_count"] for t in report["terms"]] == [2, 1, 1]


def test_browse_and_stats(spark, tmp_path):
    index = Index.create(spark, str(tmp_path), rows(spark, TEXTS))
    page, total = index.browse(1, 3)
    assert total == 8 and [r["row"] for r in page] == [3, 4, 5]
    assert {r["file"] for r in index.browse(file="f1.txt")[0]} == {"f1.txt"} and index.files() == ["f0.txt", "f1.txt", "f2.txt"]
    s = index.stats()
    assert (s["rows"], s["live"], s["files"], s["segments"]) == (8, 8, 3, 0) and s["terms"] == len({t for x in TEXTS for t in x.split()})


def test_empty_index(spark, tmp_path):
    index = create(spark, tmp_path, [])
    assert index.search("cat") == [] and index.stats()["rows"] == 0 and index.diagnose("cat")["status"] == "all_oov"
    index.publish(rows(spark, TEXTS))
    assert found(index) == plain(TEXTS)


def test_views(spark, tmp_path):
    index = create(spark, tmp_path)
    vectors = [(0, [1.0, 0.0]), (1, [-2.0, 0.0]), (4, [3.0, 3.0]), (6, [0.0, 0.0])]
    view = index.attach_view("v", local_rows(spark, vectors, "row long, vec array<float>"), {"model": "m"})
    assert (view["n_live"], view["covered_live"], view["covered_total"], view["meta"]) == (8, 4, 4, {"model": "m"})
    base = {h["docid"]: h["score"] for h in index.search("cat", 100)}
    span = max(base.values())
    cos = {0: 1.0, 1: 0.0, 4: 2**-0.5, 6: 0.0}
    fused = {h["text"]: h["score"] for h in index.fuse("cat", "v", [2.0, 0.0], 100)}
    for i, t in enumerate(TEXTS):
        assert abs(fused[t] - base.get(f"d{i:03d}", 0) - 0.35 * cos.get(i, 0) * span) < 1e-9
    no_hits = {h["text"]: h["score"] for h in index.fuse("zzz", "v", [2.0, 0.0], 100)}
    assert abs(no_hits[TEXTS[0]] - 0.35) < 1e-9
    dense = index.search_dense("cat dog", "v", [2.0, 0.0], 3)
    assert len(dense) == 3 and dense[0]["fused"] >= dense[1]["fused"]
    index.set_view_available("v", False)
    assert {h["score"] for h in index.fuse("zzz", "v", [2.0, 0.0], 100)} == {0.0}
    index.set_view_available("v", True)
    for bad in ([], [(0, [1.0]), (1, [1.0, 2.0])], [(0, [1.0]), (0, [2.0])], [(99, [1.0])], [(0, [])]):
        with pytest.raises(ViewError):
            index.attach_view("bad", local_rows(spark, bad, "row long, vec array<float>"))
    with pytest.raises(ViewError):
        index.attach_view("v", local_rows(spark, vectors, "row long, vec array<float>"))
    with pytest.raises(ViewError):
        index.fuse("cat", "v", [1.0, 2.0, 3.0])
    index.save_view("v")
    index.delete(local_rows(spark, [(4,)], "row long"))
    with pytest.raises(ViewError):
        index.attach_view("dead", local_rows(spark, [(4, [1.0])], "row long, vec array<float>"))
    again = open_index(spark, str(tmp_path))
    assert again.load_views() == [{"name": "v", "attached": True, "unmatched": 1}] and again.views()[0]["covered_live"] == 3
    assert again.detach_view("v") and not again.detach_view("v")
    made = again.encode_view("lengths", lambda texts: [[len(t), 1.0] for t in texts])
    assert made["covered_live"] == made["n_live"] == 7


# directories

FILES = {"one.txt": "apple banana cherry apple " * 3, "two.txt": "banana date elder fig grape " * 3, "sub/three.md": "cherry date apple honey " * 3}


@pytest.fixture
def corpus(tmp_path):
    root = tmp_path / "corpus"
    for name, text in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return root


def same_as_rebuilt(spark, index, root, tmp_path, queries=("apple", "fig date", "newterm", "zulu")):
    fresh = Index.build(spark, str(root), str(tmp_path / f"fresh-{time.monotonic_ns()}"))
    key = lambda hits: [sorted((round(h["score"], 9), h["file"], h["line"], h["text"]) for h in x) for x in hits]
    return key(index.search_batch(list(queries), 100)) == key(fresh.search_batch(list(queries), 100))


def test_directory_updates(spark, corpus, tmp_path):
    index = Index.build(spark, str(corpus), str(tmp_path / "ix"))
    assert index.files() == ["one.txt", "sub/three.md", "two.txt"] and index.update()["kind"] == "noop"
    (corpus / "one.txt").write_text("apple cherry cherry banana " * 3)
    got = index.update(verify="full")
    assert (got["kind"], got["verify"]) == ("incremental", "full") and same_as_rebuilt(spark, index, corpus, tmp_path)
    (corpus / "four.txt").write_text("apple newterm banana zulu " * 3)
    assert index.update()["kind"] == "staged" and len(index.segments()) == 1 and same_as_rebuilt(spark, index, corpus, tmp_path)
    (corpus / "two.txt").unlink()
    got = index.update()
    assert got["kind"] == "incremental" and got["folded"] and not index.segments()
    assert index.files() == ["four.txt", "one.txt", "sub/three.md"]
    again = open_index(spark, str(tmp_path / "ix"))
    assert exact(again) == exact(index) and again.update()["kind"] == "noop"
    assert sorted(r["rel"] for r in again.ledger().collect()) == ["four.txt", "one.txt", "sub/three.md"]
    now = time.time_ns() + 10**9
    os.utime(corpus / "one.txt", ns=(now, now))
    assert again.update(verify="stat")["kind"] == "noop"
    (corpus / "one.txt").write_text("cherry cherry cherry apple " * 3)
    assert again.update(verify="stat")["kind"] == "incremental"
    with pytest.raises(ValueError):
        again.update(verify="none")
    assert again.rebuild()["kind"] == "rebuild" and same_as_rebuilt(spark, again, corpus, tmp_path)


def test_directories_by_a_path_of_hadoop(spark, corpus, tmp_path):
    (corpus / "_under").mkdir()
    (corpus / "_under" / "x.txt").write_text("elder fig apple grape " * 3)
    (corpus / ".dot.txt").write_text("honey fig apple grape " * 3)
    (corpus / "__init__.py").write_text("banana = 'cherry banana apple'\n" * 3)
    (corpus / "node_modules").mkdir()
    (corpus / "node_modules" / "y.txt").write_text("never read at all, never " * 3)
    (corpus / "sub" / "bad.txt").write_bytes(b"caf\xff apple fig banana cherry date")
    index = Index.build(spark, corpus.as_uri(), str(tmp_path / "ix"))
    assert index.files() == [".dot.txt", "__init__.py", "_under/x.txt", "one.txt", "sub/bad.txt", "sub/three.md", "two.txt"] and same_as_rebuilt(spark, index, corpus, tmp_path)
    assert index.update()["kind"] == "noop"
    (corpus / "two.txt").write_text("apple cherry newterm " * 3)
    assert index.update(verify="full")["kind"] == "staged" and same_as_rebuilt(spark, index, corpus, tmp_path)
    with pytest.raises(FileNotFoundError):
        Index.build(spark, (corpus / "none").as_uri(), str(tmp_path / "iy"))


def test_large_batches_are_rebuilt_if_asked(spark, corpus, tmp_path):
    index = Index.build(spark, str(corpus), str(tmp_path / "ix"))
    (corpus / "four.txt").write_text("many words that nobody knew before now " * 3)
    index.config(rebuild_batch_nnz=3)
    assert index.update()["code"] == "rebuild_batch_too_big" and same_as_rebuilt(spark, index, corpus, tmp_path)


def test_files_too_short_to_index(spark, corpus, tmp_path):
    (corpus / "short.txt").write_text("too short")
    index = Index.build(spark, str(corpus), str(tmp_path / "ix"))
    assert index.update()["kind"] == "noop"
    (corpus / "one.txt").write_text("short now")
    assert index.update()["kind"] == "incremental" and "one.txt" not in index.files()


def test_stream(spark, tmp_path):
    from lexispark.streaming.ingest import ingest

    index = create(spark, tmp_path / "ix", TEXTS[:4])
    source = str(tmp_path / "in")
    for part, first in ((TEXTS[4:6], 4), (TEXTS[6:], 6)):
        rows(spark, part, first).coalesce(1).write.mode("append").parquet(source)
        ingest(spark.readStream.schema(CHUNK).parquet(source), index, str(tmp_path / "check")).awaitTermination()
    assert found(index) == plain(TEXTS)
    assert sorted(open_index(spark, str(tmp_path / "ix")).state.batches) == [0, 1]
