import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from arealis.llm import images
from arealis.llm.images import consensus, copies, decode, descriptors, encode_pgm, encode_png, rendered, resized


def picture(seed, side=110):
    rng = np.random.default_rng(seed)
    return np.clip(resized(rng.uniform(0, 255, (14, 14)), side / 14), 0, 255)


def test_formats_round_trip():
    p = np.rint(picture(1, 40))[:, :33]
    assert np.array_equal(decode(encode_pgm(p)), p) and np.array_equal(decode(encode_png(p)), p)
    assert [decode(x) for x in (None, b"", b"P5", b"\x89PNG\r\n\x1a\nxxxx", b"GIF89a")] == [None] * 5


def turned(p):
    return np.rot90(p).copy()


EDITS = {
    "crop": lambda p: p[15:, 10:95],
    "brighter": lambda p: np.clip(p * 0.7 + 50, 0, 255),
    "noise": lambda p: np.clip(p + np.random.default_rng(0).normal(0, 3, p.shape), 0, 255),
    "turned": turned,
    "smaller": lambda p: resized(p, 1 / 1.4),
}


@pytest.fixture(scope="module")
def answers(spark):
    images = [(i, encode_png(picture(i))) for i in range(20)] + [(50, encode_png(picture(3))), (60, None), (61, b"junk"), (62, encode_pgm(np.full((80, 80), 7.0))), (63, encode_pgm(np.zeros((3, 3))))]
    queries = [(100 + n, encode_pgm(edit(np.rint(picture(3))))) for n, edit in enumerate(EDITS.values())] + [(200, encode_png(picture(3))), (201, encode_png(picture(3))), (300, encode_pgm(picture(999))), (301, None)]
    frame = lambda rows: spark.createDataFrame([(i, bytearray(d) if d is not None else None, 1) for i, d in rows], "image_id long, image binary, x int")
    index = frame(images).repartition(3)
    assert copies(index.where("image_id < 0"), frame(queries)).count() == 0
    return copies(index, frame(queries)).collect()


def test_copies_crops_and_edits_are_found_and_nothing_else(answers):
    found = {}
    for r in answers:
        found.setdefault(r.query_id, set()).add((r.image_id, r.class_size))
    assert found == {q: {(3, 2)} for q in [*range(100, 100 + len(EDITS)), 200, 201]}


def test_recall_on_rendered_vectors(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    asked = vectors.where("vec_id % 20 = 0")
    rows = copies(rendered(vectors), rendered(asked, edited=True)).collect()
    n = asked.count()
    assert len({r.query_id for r in rows if r.query_id == r.image_id}) / n >= 0.95
    assert sum(r.query_id != r.image_id for r in rows) <= 0.02 * n


def test_consensus_rejects_scattered_matches():
    rng = np.random.default_rng(1)
    a, b = (np.concatenate([rng.uniform(0, 100, (30, 2)), np.ones((30, 1)), rng.uniform(-3, 3, (30, 1))], 1) for _ in range(2))
    assert consensus(a, b) <= 3
    assert consensus(a, a + [5, -7, 0, 0]) == 30
    assert len(descriptors(None)[0]) == 0


def test_small_crops_of_large_pictures_at_scales_between(spark):
    def large(seed):
        p = np.clip(resized(np.random.default_rng(seed).uniform(0, 255, (40, 40)), 420 / 40), 0, 255)
        p[200:, 200:] = 128 + (p[200:, 200:] - 128) * 0.2  # a part of little contrast
        return np.rint(p)

    frame = lambda rows: spark.createDataFrame([(i, bytearray(encode_png(np.rint(p)))) for i, p in rows], "image_id long, image binary")
    asked = [(100 + k, resized(large(1)[240:370, 250:380], scale)) for k, scale in enumerate([1.0, 1 / 1.1, 1 / 1.2, 1 / 1.3, 1 / 1.6])]
    found = {(r.query_id, r.image_id) for r in copies(frame([(i, large(i)) for i in range(3)]), frame(asked)).collect()}
    assert found == {(q, q // 100) for q, _ in asked}


def test_same_bytes_are_found_whatever_they_show(spark):
    odd = [(1, encode_pgm(np.zeros((3, 3)))), (2, encode_pgm(np.full((80, 80), 7.0))), (3, b"\xff\xd8\xff\xe0 no format that is read"), (4, b""), (5, None), (6, encode_png(np.rint(picture(6))))]
    frame = lambda rows: spark.createDataFrame([(i, bytearray(d) if d is not None else None) for i, d in rows], "image_id long, image binary")
    rows = copies(frame([*odd, (7, odd[2][1])]), frame([(100 + i, d) for i, d in odd])).collect()
    assert sorted((r.query_id, r.image_id, r.class_size) for r in rows) == [(101, 1, 1), (102, 2, 1), (103, 3, 2), (104, 4, 1), (106, 6, 1)]
    assert {r.query_id: r.inliers >= 6 for r in rows} == {101: False, 102: False, 103: False, 104: False, 106: True}


def test_against_all_pairs_of_descriptors(spark):
    """Every corner of every query with every corner of every image, in plain code."""
    rng = np.random.default_rng(12)
    pictures = [np.clip(128 + 50 * images._blurred(rng.normal(0, 4, (70, 80))), 0, 255) for _ in range(6)]
    have = [(i, images.encode_pgm(p)) for i, p in enumerate(pictures)] + [(6, images.encode_pgm(pictures[0][8:, 10:])), (7, images.encode_png(pictures[1] * 0.7 + 20)), (8, images.encode_pgm(pictures[2])), (9, None)]
    want = have[:3] + have[6:8]
    key = {i: hashlib.sha256(d).hexdigest() for i, d in have if d}
    rep = {i: min(j for j in key if key[j] == key[i]) for i in key}
    found = {i: images.descriptors(images.decode(d)) for i, d in have if d}
    expected = set()
    for q, _ in want:
        for i in set(rep.values()):
            (a, x), (b, y) = found[q], found[i]
            pairs = [(s, t) for s in range(len(x)) for t in range(len(y)) if (x[s] == y[t]).any() and sum(int(u ^ v).bit_count() for u, v in zip(x[s].tolist(), y[t].tolist())) <= images.APART]
            inliers = images.consensus(a[[s for s, _ in pairs]], b[[t for _, t in pairs]]) if len(pairs) >= 6 else 0
            if inliers >= 6 or rep[q] == i:
                expected.add((q, i))
    frame = lambda rows: spark.createDataFrame(rows, "image_id long, image binary")
    got = {(r.query_id, r.image_id) for r in images.copies(frame(have), frame(want)).collect()}
    assert got == expected and {(6, 0), (7, 1), (0, 6)} <= got


def written(spark):
    """MB of shuffle files of all stages so far."""
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size())) / 1e6


def test_pairs_of_corners_stay_in_their_tasks(spark):
    """What is shuffled are descriptors, once for each block, and not corners by word nor pairs that share one by chance."""
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").where("vec_id < 200")
    have, want = (images.rendered(vectors, edited=edited) for edited in (False, True))
    size = sum(48 * len(descriptors(decode(r.image))[0]) for df in (have, want) for r in df.collect()) / 1e6
    before = written(spark)
    assert len({r.query_id for r in copies(have, want).collect() if r.query_id == r.image_id}) >= 190
    assert 0 < written(spark) - before <= 1.5 * size


@pytest.mark.parametrize("at_once", [1, 500, 1 << 21])
def test_agreements_of_blocks_do_not_hang_on_how_many_pairs_are_looked_at_at_once(monkeypatch, at_once):
    pictures = [images._blurred(np.random.default_rng(k).normal(0, 4, (60, 64))) * 50 + 128 for k in range(3)]
    pictures = [*pictures, np.tile(pictures[0][:32, :32], (2, 2)), pictures[1][5:, 9:], np.zeros((50, 50))]

    def block(rows):
        found = [descriptors(np.clip(p, 0, 255)) for p in rows]
        return images._Block(images.pa.table({"rep": range(len(rows)), "key": [str(k % 6) for k in range(len(rows))], "size": [1] * len(rows), "places": [w.astype("<f4").T.tobytes() for w, _ in found], "words": [w.astype("<u4").tobytes() for _, w in found]}))

    have = block([*pictures, pictures[0]])  # the last is of the first one's class
    monkeypatch.setattr(images, "AT_ONCE", at_once)
    got = sorted(tuple(map(int, r)) for r in images._agreements(have, have, 6))
    expected = []
    for q in range(6):
        for v in range(6):
            a, b = (slice(*have.starts[[k, k + 1]]) for k in (q, v))
            x, y = have.words[a], have.words[b]
            near = (np.bitwise_count(x[:, None] ^ y[None]).sum(2, dtype=int) <= images.APART) & (x[:, None] == y[None]).any(2)
            i, j = np.nonzero(near)
            if len(i) >= 6 and (inliers := consensus(have.places[a][i].astype(float), have.places[b][j].astype(float))) >= 6:
                expected.append((q, v, 1, len(i), inliers))
    assert got == expected and {(0, 0), (3, 3), (1, 4), (4, 1)} <= {r[:2] for r in got} and len(have.reps) == 6


def test_chance_matches_are_not_compared_with_each_other(monkeypatch):
    """Groups whose turns are spread are out before their matches meet; those that agree, round the circle too, stay."""
    rng = np.random.default_rng(3)
    groups, looked = [], []
    for k in range(400):
        m = int(rng.integers(6, 14))
        a, b = (np.column_stack([rng.uniform(0, 96, (m, 2)), rng.choice(images.SCALES, m), rng.uniform(-np.pi, np.pi, m)]) for _ in "ab")
        if k % 10 == 0:  # a copy turned by 3.1 with noise, so that some turns are above pi and some below
            t, n = 3.1 + k / 4000, int(rng.integers(4, m + 1))
            x, y = a[:n, 0] - 48, a[:n, 1] - 48
            b[:n, 0], b[:n, 1] = np.cos(t) * x - np.sin(t) * y + 48, np.sin(t) * x + np.cos(t) * y + 48
            b[:n, 2], b[:n, 3] = a[:n, 2], a[:n, 3] + t + rng.uniform(-0.15, 0.15, n)
        groups.append((a, b))
    edges = np.concatenate([[0], np.cumsum([len(a) for a, _ in groups])])
    plain, real = [], images.slices
    for a, b in groups:
        turn, size = b[:, 3] - a[:, 3], a[:, 2] / b[:, 2]
        best = 0
        for h in range(len(a)):
            dx, dy = a[:, 0] - a[h, 0], a[:, 1] - a[h, 1]
            c, s = size[h] * np.cos(turn[h]), size[h] * np.sin(turn[h])
            good = np.hypot(b[h, 0] + c * dx - s * dy - b[:, 0], b[h, 1] + s * dx + c * dy - b[:, 1]) <= 3
            good &= (np.abs((turn - turn[h] + np.pi) % (2 * np.pi) - np.pi) <= 0.4) & (np.abs(np.log(size / size[h])) <= 0.4)
            best = max(best, good.sum())
        plain.append(best >= 6)
    monkeypatch.setattr(images, "slices", lambda sizes, most: looked.extend(sizes) or real(sizes, most))
    a, b = (np.concatenate(x) for x in zip(*groups))
    assert images._hopeful(a, b, edges, 6).tolist() == plain and sum(plain) >= 20
    assert sum(looked) < 0.5 * (np.diff(edges) ** 2).sum()


def test_a_query_has_one_row_however_many_copies_it_has(spark):
    found = [(1, i, 1 + i % 2, 10 + i, 7 + i % 3) for i in range(40, 0, -1)] + [(2, 9, 1, 8, 6)]
    rows = spark.createDataFrame(found, "query_id long, image_id long, class_size long, matches long, inliers int").repartition(4)
    ids = spark.createDataFrame([(q,) for q in (1, 2, 3)], "query_id long")
    got = {r.query_id: tuple(r)[1:-1] for r in images.answers_by_query(rows, ids).collect()}
    assert got == {1: (1, 40, 60, 2, 9), 2: (9, 1, 1, 9, 6), 3: (None, 0, 0, None, 0)}
    links = lambda kept: {r.query_id: r.links_xor for r in images.answers_by_query(kept, ids).collect()}
    whole, less = links(rows), links(rows.where("image_id <> 17"))
    assert whole[1] != less[1] and (whole[2], whole[3]) == (less[2], 0)


def test_the_query_counts_all_answers(spark):
    from arealis.llm.queries import op10_image_copies

    rows = op10_image_copies(spark, "/root/testdata/sf0.01").collect()
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    found = copies(rendered(vectors), rendered(vectors.where("vec_id % 20 = 0"), edited=True)).collect()
    assert len(rows) == vectors.where("vec_id % 20 = 0").count()
    assert {r.query_id: (r.n_links, r.n_images, r.class_id) for r in rows if r.n_links} == {q: (len(own), sum(r.class_size for r in own), min(r.image_id for r in own)) for q in {r.query_id for r in found} for own in [[r for r in found if r.query_id == q]]}


def test_answers_do_not_hang_on_the_size_of_blocks(spark, monkeypatch):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").where("vec_id < 60")
    again = vectors.where("vec_id % 7 = 0").withColumn("vec_id", F.col("vec_id") + 1000)  # the same bytes as others
    have, want = rendered(vectors.union(again)), rendered(vectors.union(again), edited=True)
    plain = sorted(tuple(r) for r in copies(have, want).collect())
    monkeypatch.setattr(images, "IMAGE_BLOCK", 1500)
    monkeypatch.setattr(images, "QUERY_BLOCK", 900)
    assert sorted(tuple(r) for r in copies(have, want).collect()) == plain and {(q, q) for q in range(60)} <= {r[:2] for r in plain}
    assert {r[:3] for r in plain if r[0] == 1007} == {(1007, 7, 2)}
