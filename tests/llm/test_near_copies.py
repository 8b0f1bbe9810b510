"""Near copies against the similarity of all pairs."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from cases import clashing, documents, odd_rows, sentence

from lexispark.llm import near_copies, simhash_dedup


def shingles(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def kept_by_hand(rows):
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    best = {}
    for i, (d, _) in enumerate(rows):
        best[find(i)] = min(d, best.get(find(i), d))
    return sorted(best.values())


def edited(rng, text, edits):
    words = text.split()
    for i in rng.sample(range(len(words)), edits):
        words[i] = "edit" + str(rng.randrange(10**6))
    return " ".join(words)


def planted(rng):
    rows, common = [], sentence(rng, 60)
    for i in range(30):
        text = sentence(rng, rng.choice([30, 120, 400]))
        rows.append((1000 - i, text))
        for k in range(rng.randrange(4)):
            rows.append((2000 + 10 * i + k, edited(rng, text, rng.randrange(0, len(text.split()) // 25 + 1))))
    rows += [(5000 + i, common + " " + sentence(rng, 60)) for i in range(40)]
    hub = sentence(rng, 200)
    return rows + [(7000 + i, edited(rng, hub, 2)) for i in range(150)]


@pytest.mark.parametrize("seed", range(2))
def test_as_all_pairs_would_have_it(spark, seed):
    rows = planted(random.Random(seed))
    docs = clashing(documents(spark, rows))
    gone = near_copies.copies_among(docs, docs.select("doc_id")).collect()
    assert len(gone) == len(set(gone)) and sorted({d for d, _ in rows} - {r["doc_id"] for r in gone}) == kept_by_hand(rows)


def test_only_the_given_ids_count(spark):
    rows = planted(random.Random(5))
    some = [r for r in rows if r[0] % 3]
    docs = documents(spark, rows)
    gone = near_copies.copies_among(docs, docs.select("doc_id").where("doc_id % 3 <> 0")).collect()
    assert sorted({d for d, _ in some} - {r["doc_id"] for r in gone}) == kept_by_hand(some)


def test_with_simhash(spark):
    rows = planted(random.Random(6))
    docs = clashing(documents(spark, rows + odd_rows(random.Random(7))))
    out = simhash_dedup.deduplicate(docs, further=near_copies.links)
    assert out.columns == docs.columns
    left = [r["doc_id"] for r in out.collect()]
    assert set(left) >= {1, 4, 5, 7, 9, 10, None} and left.count(9) == 1 and left.count(10) == 2 and 8 not in left
    assert sorted(d for d in left if d is not None and d > 500) == kept_by_hand(rows)


def test_similar_sets_meet_in_their_prefixes():
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randrange(1, 60)
        a = rng.sample(range(1000), n)
        b = [x for x in a if rng.random() < 0.93] + rng.sample(range(1000, 2000), rng.randrange(0, 3))
        a, b = set(a), set(b)
        if len(a & b) >= 0.8 * len(a | b):
            assert set(sorted(a)[: near_copies.prefix(len(a), 0.8)]) & set(sorted(b)[: near_copies.prefix(len(b), 0.8)])


def test_sketches_differ_in_no_more_bits_than_sets_do():
    rng = np.random.default_rng(5)
    for _ in range(200):
        both, one, other = (rng.integers(0, 2**63, int(rng.integers(0, k)), dtype=np.uint64) for k in (900, 300, 300))
        a, b = np.unique(np.concatenate([both, one])), np.unique(np.concatenate([both, other]))
        x, y = (np.frombuffer(near_copies.fine_sketch(s), np.uint8) for s in (a, b))
        assert near_copies.sketches_differ(x, y) <= len(np.setxor1d(a, b)) and near_copies.sketches_differ(x, x) == 0


def test_sets_of_short_texts():
    sets = [s.tolist() for s in near_copies.shingle_sets(pa.array(["", None, "one two", "One, two!", "two one", "a b c d e", "a b c d e f"]))]
    assert sets[0] == sets[1] == [] and sets[2] == sets[3] != sets[4] and len(sets[5]) == 1 and len(sets[6]) == 2


def test_odd_rows(spark):
    docs = documents(spark, odd_rows(random.Random(4)))
    ids = docs.groupBy("doc_id").count().where("count = 1").select("doc_id")
    assert [r["doc_id"] for r in near_copies.copies_among(docs, ids).collect()] == [8]
    none = documents(spark, [])
    assert near_copies.copies_among(none, none.select("doc_id")).collect() == [] == near_copies.copies_among(docs, none.select("doc_id")).collect()


@pytest.mark.parametrize("seed", range(3))
def test_outliers_at_both_ends_do_not_hide_the_rest(spark, seed):
    """Smallest and largest doc_id are variants too far from the rest, which are alike: the rest is one group all the same, with and without rounds of stars."""
    rng = random.Random(seed)
    rows = []
    for g, (size, words, far) in enumerate([(8, 400, 13), (60, 200, 7)]):
        text = sentence(rng, words)
        edits = [far, *[2] * (size - 2), far]
        rows += [(1000 * g + i, edited(rng, text, e)) for i, e in enumerate(edits)]
    docs = documents(spark, rows)
    gone = {r["doc_id"] for r in near_copies.copies_among(docs, docs.select("doc_id")).collect()}
    assert sorted({d for d, _ in rows} - gone) == kept_by_hand(rows)


def test_many_holders_of_one_passage(spark):
    """Documents that share a common passage and nothing else stay; pairs of copies among them go."""
    rng = random.Random(12)
    common = sentence(rng, 30)
    rows = [(i, f"{common} {sentence(rng, 40)}") for i in range(300)]
    rows += [(1000 + i, edited(rng, rows[i][1], 1)) for i in range(0, 300, 10)]
    docs = documents(spark, rows)
    gone = {r["doc_id"] for r in near_copies.copies_among(docs, docs.select("doc_id")).collect()}
    assert sorted({d for d, _ in rows} - gone) == kept_by_hand(rows)


def test_signs_are_made_once(spark, tmp_path):
    """Both the count of a hash's holders and their rows come of one pass; hashes of one document go."""
    folder = str(tmp_path)

    def work(batches):
        import uuid

        for batch in batches:
            with open(f"{folder}/{uuid.uuid4()}", "w") as f:
                f.write("x" * batch.num_rows)
            yield batch

    docs = documents(spark, [(i, "one two three four five six") for i in range(4)])
    held = [(1, 0, 2, 0), (1, 1, 2, 0), (2, 1, 2, 1), (3, 2, 2, 0), (3, 3, 2, 0), (3, 0, 2, 1), (4, 2, 2, 1)]
    found = spark.createDataFrame(held, "hash long, doc_id long, n int, at int")
    out = near_copies.shared_signs(found.mapInArrow(work, found.schema), docs.select("doc_id", "text")).select("hash", "doc_id", "n", "at", "c").collect()
    assert sorted(map(tuple, out)) == [(*h, h[1]) for h in sorted(held) if h[0] in (1, 3)]
    assert sum(f.stat().st_size for f in tmp_path.iterdir()) == len(held)


def test_hashes_of_the_same_holders_are_one(spark):
    docs = documents(spark, [(i, "one two three four five six") for i in range(4)])
    passage = [(h, d, 40, d + at) for at, h in enumerate([5, 6, 9]) for d in range(3)]
    found = spark.createDataFrame([*passage, (7, 0, 40, 8), (7, 1, 40, 8), (8, 3, 40, 0)], "hash long, doc_id long, n int, at int")
    out = near_copies.shared_signs(found, docs.select("doc_id", "text")).select("hash", "doc_id", "n", "at", "c").collect()
    assert sorted(map(tuple, out)) == [(5, 0, 40, 0, 0), (5, 1, 40, 1, 1), (5, 2, 40, 2, 2), (7, 0, 40, 8, 0), (7, 1, 40, 8, 1)]


def join_rows(df):
    """Rows that came out of the joins of a DataFrame that has run."""

    def walk(node):
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            return walk(node.executedPlan())
        if "QueryStage" in name:
            return walk(node.plan())
        children = node.children()
        own = node.metrics().apply("numOutputRows").value() if "Join" in name else 0
        return own + sum(walk(children.apply(i)) for i in range(children.size()))

    return walk(df._jdf.queryExecution().executedPlan())


def test_a_pair_comes_out_of_the_join_at_its_first_hash(spark):
    """Documents of one passage share many hashes, but are one candidate; a pair whose only common hash comes late is one too."""
    held = [(h, d, 1000, h) for d in range(20) for h in range(30)] + [(1000 + d // 2, d, 1000, 30 + d % 2) for d in range(20)]
    held += [(2000 + 100 * d + k, d, 1000, k) for d in (50, 60) for k in range(40)] + [(9000, d, 1000, 40) for d in (50, 60)]
    zero = ", ".join(f"{c} long" for c in near_copies.SKETCHED)
    found = spark.createDataFrame([(*x, x[1], *[0] * near_copies.SKETCH) for x in held], f"hash long, doc_id long, n int, at int, c long, {zero}")
    pairs = near_copies.all_pairs(found, 0.8, len(held))
    got = sorted(map(tuple, pairs.collect()))
    assert got == [*((a, b) for a in range(20) for b in range(a + 1, 20)), (50, 60)]
    # 30 hashes of 190 pairs; a hash that two share right after the passage adds nothing
    assert len(got) <= join_rows(pairs) < 2 * len(got)
