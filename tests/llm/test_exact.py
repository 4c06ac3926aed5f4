import hashlib

from pyspark.sql import functions as F

from arealis.llm import exact
from arealis.llm.exact import drop_exact_copies, exact_groups, state_of, update_state

SCHEMA = "doc_id long, text string, digest int, n string"
ROWS = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b" * 50_000), (6, "b" * 50_000), (7, "c"), (7, "c"), (8, "A"), (9, "a "), (10, "a")]


def frame(spark):
    return spark.createDataFrame([(i, t, 0, "n") for i, t in ROWS], SCHEMA)


def wanted():
    ids = {}
    for i, t in ROWS:
        ids.setdefault(t or "", []).append(i)
    return ids


def check(rows):
    ids, text = wanted(), dict(ROWS)
    assert sorted(r.id for r in rows) == sorted(i for i, _ in ROWS)
    for r in rows:
        group = ids[text[r.id] or ""]
        assert r.keep_id == max(group) and r.group_size == len(group)
    kept = [r.id for r in rows if r.kept]
    assert sorted(kept) == sorted({max(g) for g in ids.values()})


def test_groups(spark):
    rows = exact_groups(frame(spark)).collect()
    check(rows)
    assert {bytes(r.digest) for r in rows} == {hashlib.sha256(t.encode()).digest() for t in wanted()}


def test_bytes_are_checked_when_digests_clash(spark):
    check(exact_groups(frame(spark), digest=lambda text: F.unhex(F.hex(F.length(text) % 2))).collect())


def test_files_and_all_columns(spark, tmp_path):
    frame(spark).repartition(3).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    left = drop_exact_copies(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == [4, 6, 7, 8, 9, 10]
    assert sorted(r.doc_id for r in drop_exact_copies(docs.where("doc_id < 7")).collect()) == [2, 4, 6]


def test_empty(spark):
    assert exact_groups(frame(spark).where("doc_id < 0")).count() == 0
    assert drop_exact_copies(frame(spark).where("doc_id < 0")).count() == 0


def test_state_over_micro_batches_and_a_restart(spark, tmp_path):
    arrivals, state, groups = (str(tmp_path / n) for n in ("arrivals", "state", "groups"))
    slim = lambda rows: spark.createDataFrame([(i, ("f", i), hashlib.sha256((t or "").encode()).digest()) for i, t in rows], "id long, loc struct<file:string,row:long>, digest binary")
    for rows in (ROWS[:4], ROWS[4:8], ROWS[8:]):
        slim(rows).coalesce(1).write.mode("append").parquet(arrivals)
    update_state(spark, arrivals, slim(ROWS).schema, state, groups, files_at_once=1)
    held = {bytes(r.digest): (r.keep.id, r.n) for r in state_of(spark, groups).collect()}
    assert held == {hashlib.sha256(t.encode()).digest(): (max(g), len(g)) for t, g in wanted().items()}
    slim([(11, "a"), (12, "new")]).coalesce(1).write.mode("append").parquet(arrivals)
    update_state(spark, arrivals, slim(ROWS).schema, state, groups)
    held = {bytes(r.digest): (r.keep.id, r.keep.loc.row, r.n) for r in state_of(spark, groups).collect()}
    assert held[hashlib.sha256(b"a").digest()] == (11, 11, 4) and held[hashlib.sha256(b"new").digest()] == (12, 12, 1)


def test_columns_of_any_name(spark):
    names = ["doc_id", "text", "loc", "_metadata", "c0", "keep", "_row_locator", "a.b"]
    docs = spark.createDataFrame([(i, t, 1, 2, 3, 4, 5, 6) for i, t in ROWS], ", ".join(f"`{n}` {'string' if n == 'text' else 'long'}" for n in names))
    check(exact_groups(docs).collect())
    left = drop_exact_copies(docs)
    assert left.columns == names and sorted(r[0] for r in left.collect()) == [4, 6, 7, 8, 9, 10]


def test_rows_without_an_id_and_large_groups(spark, monkeypatch):
    monkeypatch.setattr(exact, "BESIDE", 3)
    docs = spark.createDataFrame([(None, "x")] * 5 + [(i, "x") for i in range(20)] + [(None, "y"), (None, "y")], "doc_id long, text string").repartition(3)
    rows = exact_groups(docs).collect()
    assert len(rows) == 27 and {(r.keep_id, r.group_size) for r in rows} == {(19, 25), (None, 2)}
    assert sum(r.kept for r in rows) == 2 and drop_exact_copies(docs).count() == 2
