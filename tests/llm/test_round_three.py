import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from coordspark.llm import ball_kmeans, hard_negatives, long_repeats
from coordspark.llm.queries import QUERIES
from coordspark.llm.run_index import build, joined, longest_matches, repeated

SMALL = "/root/testdata/sf0.001"


def rows(name):
    return pq.read_table(f"{SMALL}/{name}.parquet").to_pylist()


# ball k-means


def kept(values, dim):
    return [(i, [int(np.floor(float(x) * 1024)) for x in v]) for i, v in values if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]


def test_balls_equal_lloyd(spark):
    want = ball_kmeans.brute_force(kept([(r["vec_id"], r["embedding"]) for r in rows("embeddings")], 64))
    got = QUERIES["op12_ball_kmeans"](spark, SMALL).collect()
    assert sorted((r.vec_id, r.cluster, r.distance) for r in got) == sorted(want)
    assert {r.inertia for r in got} == {sum(d for _, _, d in want)}
    assert {(r.cluster, r.cluster_inertia) for r in got} == {(c, sum(d for _, k, d in want if k == c)) for c in {k for _, k, _ in want}}


@pytest.mark.parametrize("scale", [1, 1 << 16])
def test_balls_ties_repeats_and_edges(spark, scale):
    rng = random.Random(4)
    # a coarse lattice: many ties and repeated vectors, and whole numbers too wide for doubles
    values = [(rng.choice([None, 7, *range(40)]), [float(rng.randrange(3) * scale), float(rng.randrange(2) * scale)]) for _ in range(60)]
    bad = [(1, None), (2, []), (3, [1.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0])]
    df = spark.createDataFrame([(i, v, "x", 3.5) for i, v in values + bad], "vec_id long, embedding array<double>, cluster string, distance double")
    got = sorted((r.vec_id is None, r.vec_id or 0, r.cluster, r.distance) for r in ball_kmeans.cluster(df, k=5, rounds=4, dim=2).collect())
    assert got == sorted((i is None, i or 0, c, d) for i, c, d in ball_kmeans.brute_force(kept(values, 2), 5, 4))
    assert ball_kmeans.cluster(df.where("false"), dim=2).count() == 0
    few = ball_kmeans.cluster(df.where("vec_id = 7").limit(2), k=5, rounds=2, dim=2).collect()
    assert 0 < len(few) <= 2 and all(r.distance == 0 or r.cluster == 0 for r in few)


def test_ball_reaches_hold_all_members():
    rng = np.random.default_rng(3)
    v = rng.integers(-50, 50, (400, 3)).astype(float)
    at = ball_kmeans.balls([tuple(map(int, x)) for x in v[:9]], [None] * 9)
    cluster, d = ball_kmeans.assign(v, np.zeros(400, np.int32), at)
    full = ((v[:, None] - v[:9]) ** 2).sum(2)
    assert (cluster == full.argmin(1)).all() and (d == full.min(1)).all()
    # the next round, with reaches: the same as comparing all
    centres = [tuple(int(x) for x in v[cluster == i].sum(0) // max(1, (cluster == i).sum())) for i in range(9)]
    reach = [ball_kmeans._moved(int(d[cluster == i].max()), ball_kmeans._squared(tuple(map(int, v[i])), centres[i])) for i in range(9)]
    moved = ball_kmeans.balls(centres, reach)
    again, d2 = ball_kmeans.assign(v, cluster, moved)
    full = ((v[:, None] - np.array(centres)) ** 2).sum(2)
    assert (again == full.argmin(1)).all() and (d2 == full.min(1)).all()


def test_too_large_components_are_an_error(spark):
    df = spark.createDataFrame([(1, [1e30, 0.0]), (2, [0.0, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        ball_kmeans.cluster(df, dim=2).collect()


# hard negatives


def brute_negatives(values, positives=5, negatives=3, anchors=lambda i: i % 50 == 0):
    good = [(i, label, [int(np.floor(float(x) * 256)) for x in v]) for i, label, v in values if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (i, label, v) in enumerate(good):
        if not anchors(i):
            continue
        score = [(-sum(x * y for x, y in zip(v, w)), j, b, other == label) for b, (j, other, w) in enumerate(good) if b != a and len(w) == len(v)]
        for s, j, _, _ in sorted(x for x in score if x[3])[:positives]:
            far = sorted(x for x in score if not x[3] and -50 * s <= -100 * x[0] <= -95 * s)[:negatives]
            out += [(i, j, k + 1, n, -s, -t) for k, (t, n, _, _) in enumerate(far)]
    return sorted(out)


def test_negatives_against_brute_force(spark):
    values = [(r["vec_id"], None if r["label"] is None else (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"], r["embedding"]) for r in rows("embeddings")]
    assert sorted(map(tuple, QUERIES["op11_hard_negatives"](spark, SMALL).collect())) == brute_negatives(values)


def test_negatives_in_many_strips_and_packs(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "STRIP", 8)
    monkeypatch.setattr(hard_negatives, "PART", 1)
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 4)
    monkeypatch.setattr(hard_negatives, "PACK_ROWS", 3)
    monkeypatch.setattr(hard_negatives, "SHARE", 2)
    monkeypatch.setattr(hard_negatives, "FIRST", 1)
    rng = np.random.default_rng(6)
    values = [(int(k), int(rng.integers(3)), [float(x) for x in rng.normal(1, 1, 5)]) for k in range(150)]
    values += [(200 + k, k % 3, [2.0, 2.0, 2.0, 2.0, 2.0]) for k in range(60)]  # one vector many times
    df = spark.createDataFrame(values, "vec_id long, label int, embedding array<double>")
    got = sorted(map(tuple, hard_negatives.mine(df, F.col("vec_id") % 10 == 0).collect()))
    assert got == brute_negatives(values, anchors=lambda i: i % 10 == 0)


def test_packs_are_not_sent_along_with_blocks(spark, monkeypatch):
    """Rows of blocks are read many at a time, so files are small; no join multiplies packs by strips."""
    for name, value in (("STRIP", 8), ("PART", 8), ("BLOCK_ROWS", 4), ("PACK_ROWS", 3), ("SHARE", 2)):
        monkeypatch.setattr(hard_negatives, name, value)
    values = [(k, k % 3, [float(x) for x in np.random.default_rng(k).normal(0, 1, 5)]) for k in range(400)]
    index = hard_negatives.Index(spark.createDataFrame(values, "vec_id long, label int, embedding array<double>"), F.col("vec_id") % 10 == 0)
    for table, most in ((index.blocks, 8), (index.packs, 2)):
        files = [r["count"] for r in table.groupBy(F.input_file_name()).count().collect()]
        assert len(files) > 1 and max(files) <= 4 * most, files
    met = []
    monkeypatch.setattr(hard_negatives, "written", lambda df, what, real=hard_negatives.written: (met.append((what, df._jdf.queryExecution().optimizedPlan().toString())), real(df, what))[1])
    index.search(hard_negatives.written(index.packs.mapInArrow(hard_negatives._unbounded, f"{hard_negatives.PACK}, low binary, high binary"), "first"), 2, 1, True)
    assert [what for what, plan in met if what == "negatives-found" and "Join" in plan] == []


def test_negatives_edges(spark):
    wide = [(k, k % 2, [float(2**27 + k), float(2**26)]) for k in (0, 1, 2, 50)]  # products of more than 53 bits
    odd = [(None, 1, [1.0, 1.0]), (51, None, [1.0, 1.0]), (52, 1, None), (53, 1, []), (54, 1, [None, 1.0]), (55, 1, [float("nan"), 1.0]), (100, 1, [1.0, 0.5, 0.25])]
    three = [(150, 0, [1.0, 0.5, 0.25]), (151, 0, [1.0, 0.5, 0.25]), (152, 1, [0.7, 0.5, 0.25]), (152, 1, [0.7, 0.5, 0.25]), (153, 1, [-1.0, 0.0, 0.0])]
    values = wide + odd + three + three[:2]
    df = spark.createDataFrame([(*v, 9, "p") for v in values], "vec_id long, label int, embedding array<double>, row int, pack string")
    assert sorted(map(tuple, hard_negatives.mine(df, F.col("vec_id") % 50 == 0).collect())) == brute_negatives(values)
    assert hard_negatives.mine(df.where("false"), F.lit(True)).count() == 0
    assert hard_negatives.mine(df, F.lit(False)).count() == 0


# long repeats


def spans_of(found):
    return [(s.start, s.end) for s in found.spans]


def test_repeats_against_brute_force(spark):
    docs = rows("documents")
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs}
    want = dict(zip(texts, long_repeats.brute_force(list(texts.values()))))
    got = {r.doc_id: r for r in QUERIES["op13_long_repeats"](spark, SMALL).collect()}
    assert len(got) == len(docs) and any(r.n_removed for r in got.values())
    for i, t in texts.items():
        left, at = b"", 0
        for a, b in want[i]:
            left, at = left + t[at:a], b
        left += t[at:]
        assert tuple(got[i]) == (i, len(t), len(t) - len(left), len(want[i]), hashlib.sha256(left).hexdigest())


@pytest.mark.parametrize("group, block", [(1 << 18, 1 << 20), (60, 200)])
def test_repeats_of_hot_groups(spark, group, block):
    """A passage that all texts share between words of their own, near copies, periods: also where groups are dealt out down to single strings."""
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    passage, base = word(60), word(150)
    texts = [f"{word(30)}{passage}{word(rng.randrange(40))}" for _ in range(25)]
    texts += [base[:k] + "Z" + base[k:] for k in range(0, 150, 11)] + [base] * 6
    texts += ["a" * 90, "a" * 20, "ab" * 40, word(11), "ção " * 20, "", None, "x"]
    df = spark.createDataFrame([(k % 20 if k % 9 else None, t, "s", 1) for k, t in enumerate(texts)], "doc_id long, text string, seg string, key int")
    found = long_repeats.remove(df, length=20, gram=6, group=group, block=block)
    want = Counter((t, tuple(w)) for t, w in zip(texts, long_repeats.brute_force([(t or "").encode() for t in texts], 20)))
    got = found.collect()
    assert Counter((r.text, tuple(spans_of(r.repeats))) for r in got) == want
    assert all(r.seg == "s" and r.key == 1 and r.repeats.n_bytes == len((r.text or "").encode()) for r in got)
    assert long_repeats.remove(df.where("false")).count() == 0


@pytest.mark.parametrize("shared, group, of", [(20, 1 << 18, ("repeats-near", 0)), (32, 60, ("repeats-pieces", 1))])
def test_repeats_of_one_key_are_several_tasks(spark, monkeypatch, shared, group, of):
    """A passage that all texts share gives one key very many segments, which Spark can deal to several tasks; where they are cut again, too."""
    small = {f"adaptive.{k}": v for k, v in (("advisoryPartitionSizeInBytes", "2k"), ("skewJoin.skewedPartitionThresholdInBytes", "2k"), ("skewJoin.skewedPartitionFactor", "1.5"), ("coalescePartitions.enabled", "false"))}
    small |= {"autoBroadcastJoinThreshold": "-1", "shuffle.partitions": "16"}
    before = {k: spark.conf.get(f"spark.sql.{k}") for k in small}
    made = {}
    monkeypatch.setattr(long_repeats, "written", lambda df, what, real=long_repeats.written: made.setdefault(what, []).append(real(df, what)) or made[what][-1])
    monkeypatch.setattr(long_repeats, "discard", lambda *tables: None)
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    passage = word(shared)
    texts = [f"{word(30)}{passage}{word(20)}" for _ in range(1500)]
    for k, v in small.items():
        spark.conf.set(f"spark.sql.{k}", v)
    try:
        df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(8)
        found = long_repeats.remove(df, length=20, gram=6, group=group).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(f"spark.sql.{k}", v)
    want = Counter((t, tuple(w)) for t, w in zip(texts, long_repeats.brute_force([t.encode() for t in texts], 20)))
    assert Counter((r.text, tuple(spans_of(r.repeats))) for r in found) == want
    held = made[of[0]][of[1]]
    hot = held.groupBy("key").count().orderBy(F.desc("count")).first()
    assert hot["count"] >= len(texts)
    tasks = [r["count"] for r in held.where(F.col("key") == hot["key"]).groupBy(F.input_file_name()).count().collect()]
    assert len(tasks) > 1 and max(tasks) < hot["count"] / 2, tasks


def test_long_texts_are_taken_in_parts(monkeypatch):
    monkeypatch.setattr(long_repeats, "CHUNK", 50)
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcd") for _ in range(n)).encode() for n in (400, 3, 77, 20, 0, 250)]
    cover, keys = Counter(), {}
    for text, start, n, key, met in long_repeats.segments(texts, 20, 6):
        for t, s, k, x, m in zip(text.tolist(), start.tolist(), n.tolist(), key.tolist(), met.tolist()):
            assert m >= 1
            for j in range(s, s + k):
                cover[t, j] += 1
                assert keys.setdefault(texts[t][j : j + 20], x) == x
    assert cover == Counter((t, j) for t, x in enumerate(texts) for j in range(len(x) - 19))


def test_run_index():
    rng = random.Random(5)
    for _ in range(60):
        sign = rng.choice(["a", "ab", "abcd", "abcdefghijklmnop"])
        texts = ["".join(rng.choice(sign) for _ in range(rng.randint(1, 60))).encode() for _ in range(rng.randint(1, 8))]
        texts += [t[rng.randint(0, 5) :] + b"q" for t in texts[:3]]
        n = rng.choice([1, 2, 5, 9, 20])
        seen = Counter(t[k : k + n] for t in texts for k in range(len(t) - n + 1))
        for t, spans in zip(texts, repeated(texts, n)):
            assert [k for a, b in spans for k in range(a, b)] == [k for k in range(len(t) - n + 1) if seen[t[k : k + n]] > 1]


def test_run_index_grows_with_what_is_new():
    rng = random.Random(5)
    base = "".join(rng.choice("abcdefgh") for _ in range(500)).encode()
    runs = [len(build(joined([base] * n)).signs) for n in (1, 40)]
    assert runs[1] < 2 * runs[0]  # 40 copies, hardly more runs but for their ends
    text = joined([base, base])
    index = build(text)
    assert index.lengths.sum() == len(text.signs) and longest_matches(text, index)[0] == 500
    assert re.fullmatch(rb"[a-h]+", base)
