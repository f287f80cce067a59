"""Batches, pointer, upsert and the streaming ingest."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from shoplens.operators import validate as V
from shoplens.session import work_dir
from shoplens.sources import batches as B
from shoplens.sources.clean_store import read_clean, write_clean
from shoplens.sources.upsert import upsert
from shoplens.streaming.loader import batch_progress, compact, ingest, log_stream, next_batch
from tests.frames import clean_frame, left_after, row, shuffle_files


def three_rows(spark):
    return clean_frame(spark, [row("o1", "c", "p1", "2024-01-01", 10), row("o2", "c", "p2", "2024-01-02", 20),
                               row("o3", "c", "p3", "2024-01-03", 30)])


def test_row_batches_size_two(spark):
    b = B.split_row_batches(three_rows(spark), 2)
    sizes = {r.batch_id: r["count"] for r in b.groupBy("batch_id").count().collect()}
    assert sizes == {0: 2, 1: 1}
    assert [r.order_id for r in b.where("batch_id = 0").orderBy("order_id").collect()] == ["o1", "o2"]
    check = V.check_batches(b, three_rows(spark), 2).first()
    assert check.passed and check.total_batches == 2 and check.last_batch_size == 1
    assert not V.check_batches(b, three_rows(spark), 1).first().passed


def test_daily_batches_dense(spark):
    b = B.split_daily_batches(three_rows(spark).union(three_rows(spark).where("order_id = 'o3'")))
    assert {(r.order_id, r.batch_id) for r in b.collect()} == {("o1", 0), ("o2", 1), ("o3", 2)}


def test_global_numbering_is_a_permutation(spark):
    from shoplens.functions.numbering import global_row_number
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5000).alias("v"))
    out = global_row_number(df.repartition(7), ["v"], "rn")
    assert out.where("rn != v + 1").count() == 0 and out.count() == 5000


def test_exact_percentiles_match_numpy(spark):
    import numpy as np
    from shoplens.functions.numbering import exact_percentiles
    vals = [float((i * 37) % 101) for i in range(203)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    r = exact_percentiles(df, "x", {"p25": 0.25, "p75": 0.75, "p50": 0.5}).first()
    assert r.p25 == np.percentile(vals, 25) and r.p75 == np.percentile(vals, 75) and r.p50 == np.median(vals)


def test_pointer_default_zero(spark):
    batch_dir = work_dir(spark, "t-pointer")
    B.write_batches(B.split_row_batches(three_rows(spark), 1), batch_dir)
    assert next_batch(spark, batch_dir, work_dir(spark, "t-no-checkpoint")) == 0


def test_recut_leaves_no_old_batch(spark):
    batch_dir = work_dir(spark, "t-recut")
    B.write_batches(B.split_row_batches(three_rows(spark), 1), batch_dir)
    B.write_batches(B.split_row_batches(three_rows(spark), 2), batch_dir)
    got = sorted((r.batch_id, r.order_id) for r in B.read_batches(spark, batch_dir).collect())
    assert got == [(0, "o1"), (0, "o2"), (1, "o3")]
    assert [r.order_id for r in B.read_batch(spark, batch_dir, 1).collect()] == ["o3"]
    target = work_dir(spark, "t-rewrite")
    write_clean(three_rows(spark), target)
    write_clean(clean_frame(spark, [row("o9", "c", "p", "2024-05-01", 1)]), target)
    assert [r.order_id for r in read_clean(spark, target).collect()] == ["o9"]


def test_upsert_idempotent_and_updates(spark):
    target = work_dir(spark, "t-upsert")
    write_clean(three_rows(spark), target)
    batch = clean_frame(spark, [row("o1", "c", "p1", "2024-01-01", 99), row("o9", "c", "p9", "2024-02-01", 5)])
    stats = upsert(spark, target, batch)
    assert stats["rows_upserted"] == 2
    first = sorted((r.order_id, str(r.payment_value)) for r in read_clean(spark, target).collect())
    upsert(spark, target, batch)
    again = sorted((r.order_id, str(r.payment_value)) for r in read_clean(spark, target).collect())
    assert first == again == [("o1", "99.00"), ("o2", "20.00"), ("o3", "30.00"), ("o9", "5.00")]
    assert V.check_table(read_clean(spark, target)).first().duplicate_pk_groups == 0


def test_upsert_batch_hitting_a_key_twice(spark):
    target = work_dir(spark, "t-dup")
    batch = clean_frame(spark, [row("o1", "c", "p1", "2024-01-01", 1), row("o1", "c", "p1", "2024-01-01", 2)])
    stats = upsert(spark, target, batch)
    assert stats["duplicate_keys_dropped"] == 1
    assert read_clean(spark, target).count() == 1


def test_stream_ingest_end_to_end(spark):
    fact = three_rows(spark)
    batch_dir = work_dir(spark, "t-batches")
    B.write_batches(B.split_row_batches(fact, 1), batch_dir)
    assert B.load_batch(spark, batch_dir, 0, dry_run=True) == 1
    with pytest.raises(ValueError):
        B.load_batch(spark, batch_dir, 7, dry_run=True)
    target, ckpt = work_dir(spark, "t-target"), work_dir(spark, "t-ckpt")
    seen, merged = [], []
    pointer = ingest(spark, batch_dir, target, ckpt, on_batch=lambda s, t, e, st: seen.append(st["rows_in"]),
                     on_compact=lambda s, t, p, st: merged.append((p, st["rows_upserted"])))
    assert pointer == 3 and sum(seen) == 3 and merged == [(3, 3)]
    assert sorted(r.order_id for r in read_clean(spark, target).collect()) == ["o1", "o2", "o3"]
    # restart from the same checkpoint: nothing new to do, table unchanged
    assert ingest(spark, batch_dir, target, ckpt) == 3
    assert read_clean(spark, target).count() == 3


def test_ingest_leaves_its_tables_only(spark):
    """Shuffle files go with the step that made them, the upsert's copy of the batch with the upsert."""
    batch_dir, target, ckpt = (work_dir(spark, f"t-left-{x}") for x in ("batches", "target", "ckpt"))
    work = os.path.dirname(target.removeprefix("file:"))
    copies = lambda: {x for x in os.listdir(work) if x.startswith("upsert_batch-")}
    os.makedirs(work, exist_ok=True)
    there, before = copies(), shuffle_files(spark)
    numbered = B.number_rows(three_rows(spark))
    B.write_batches(B.split_row_batches(numbered, 1), batch_dir)
    log_stream(spark, batch_dir, ckpt).awaitTermination()
    assert not left_after(spark, before)
    compact(spark, target, ckpt)
    assert copies() <= there and os.path.isdir(numbered.written_at.removeprefix("file:"))
    assert sorted(r.order_id for r in read_clean(spark, target).collect()) == ["o1", "o2", "o3"]


@pytest.mark.parametrize("files", [1, 4])
def test_pointer_names_the_next_batch(spark, files):
    fact = clean_frame(spark, [row(f"o{i}", "c", "p", f"2024-01-{i + 1:02d}", i) for i in range(12)])
    batch_dir, ckpt = work_dir(spark, "t-files"), work_dir(spark, "t-files-ckpt")
    cut = B.split_row_batches(fact, 2)
    # several files, each with parts of several batches
    (cut.withColumn("batch_range", F.lit(0)).repartition(6).write.partitionBy("batch_range").parquet(batch_dir))
    assert ingest(spark, batch_dir, work_dir(spark, "t-files-target"), ckpt, files_per_trigger=files) == 6
    assert batch_progress(spark, batch_dir, ckpt).where("rows <> consumed").count() == 0


def test_stopped_half_way(spark):
    """The stream dies in its second micro-batch; the next run takes up there."""
    batch_dir, target, ckpt = work_dir(spark, "t-half"), work_dir(spark, "t-half-target"), work_dir(spark, "t-half-ckpt")
    for k in range(3):
        one = clean_frame(spark, [row(f"o{k}", "c", "p", "2024-01-01", k + 1)]).withColumn("batch_id", F.lit(k))
        one.withColumn("batch_range", F.lit(0)).coalesce(1).write.mode("append").partitionBy("batch_range").parquet(batch_dir)

    def die(s, t, epoch, st):
        if epoch == 1:
            raise RuntimeError("stop here")

    with pytest.raises(Exception, match="stop here"):
        log_stream(spark, batch_dir, ckpt, on_batch=die).awaitTermination()
    assert next_batch(spark, batch_dir, ckpt) < 3
    assert ingest(spark, batch_dir, target, ckpt) == 3
    assert sorted(r.order_id for r in read_clean(spark, target).collect()) == ["o0", "o1", "o2"]
    assert batch_progress(spark, batch_dir, ckpt).where("rows <> consumed").count() == 0


def files_of(spark, target):
    from shoplens.sources import upsert as U
    return set(U._data_files(spark, target))


def shown(spark, target):
    return sorted((r.order_id, str(r.payment_value)) for r in read_clean(spark, target).collect())


@pytest.mark.parametrize("step", range(7))
def test_upsert_dies_at_any_step(spark, monkeypatch, step):
    """Journal, data, each move, each delete: no row is lost, and the next upsert finishes."""
    from shoplens.sources import upsert as U
    target = work_dir(spark, "t-crash")
    write_clean(three_rows(spark), target)
    write_clean(clean_frame(spark, [row("o4", "c", "p4", "2024-03-01", 40)]), target, mode="append")
    batch = clean_frame(spark, [row("o1", "c", "p1", "2024-01-01", 99), row("o4", "c", "p4", "2024-03-01", 41), row("o7", "c", "p7", "2024-02-01", 7)])
    done = []

    def dying(real):
        def run(*args, **kw):
            if len(done) == step:
                raise RuntimeError("died")
            done.append(args)
            return real(*args, **kw)
        return run

    with monkeypatch.context() as m:
        for name in ("_write_months", "_move", "remove_path"):
            m.setattr(U, name, dying(getattr(U, name)))
        with pytest.raises(RuntimeError, match="died"):
            upsert(spark, target, batch)
    there = dict(shown(spark, target))
    assert {"o2", "o3"} <= set(there) and {"o1", "o4"} <= set(there)  # old or new, never gone
    upsert(spark, target, batch)
    assert shown(spark, target) == [("o1", "99.00"), ("o2", "20.00"), ("o3", "30.00"), ("o4", "41.00"), ("o7", "7.00")]
    assert not U.path_exists(spark, U._stage_path(target))


def test_a_reader_may_finish_the_stage(spark, monkeypatch):
    from shoplens.sources import upsert as U
    target = work_dir(spark, "t-reader")
    write_clean(three_rows(spark), target)
    with monkeypatch.context() as m:
        m.setattr(U, "_move", lambda *a: (_ for _ in ()).throw(RuntimeError("died")))
        with pytest.raises(RuntimeError):
            upsert(spark, target, clean_frame(spark, [row("o1", "c", "p1", "2024-01-01", 99)]))
    assert dict(shown(spark, target))["o1"] == "10.00"
    assert U.finish_stage(spark, target) and not U.finish_stage(spark, target)
    assert dict(shown(spark, target))["o1"] == "99.00" and len(shown(spark, target)) == 3


def test_upsert_rewrites_touched_files_only(spark):
    target = work_dir(spark, "t-files of") + "/a b%20c"  # names that a URI writes otherwise
    rows = [row(f"o{k}", "c", "p", f"2024-0{1 + k % 2}-1{k}", k) for k in range(8)]
    for r in rows:
        write_clean(clean_frame(spark, [r]), target, mode="append")
    before = files_of(spark, target)
    assert len(before) == 8
    stats = upsert(spark, target, clean_frame(spark, [row("o3", "c", "p", "2024-02-13", 99), row("new", "c", "p", "2024-01-05", 1)]))
    after = files_of(spark, target)
    assert (stats["files_rewritten"], stats["files_kept"], stats["months_touched"]) == (1, 7, 2)
    assert len(before - after) == 1 and len(after - before) == 2
    fresh = upsert(spark, target, clean_frame(spark, [row("only-new", "c", "p", "2024-01-06", 1)]))
    assert fresh["files_rewritten"] == 0 and after < files_of(spark, target)
    assert dict(shown(spark, target)) == {**{f"o{k}": f"{k}.00" for k in range(8)}, "o3": "99.00", "new": "1.00", "only-new": "1.00"}
    # a month of many small files is merged by an upsert that touches it
    for k in range(12):
        write_clean(clean_frame(spark, [row(f"s{k}", "c", "p", "2024-01-20", 1)]), target, mode="append")
    merged = upsert(spark, target, clean_frame(spark, [row("one-more", "c", "p", "2024-01-06", 1)]))
    assert merged["files_rewritten"] > 16
    assert len([f for f in files_of(spark, target) if f.startswith("order_month=2024-01-01")]) <= 2
    assert len(shown(spark, target)) == 8 + 2 + 12 + 1


def test_batch_without_a_valid_row(spark):
    batch_dir = work_dir(spark, "t-invalid")
    bad = three_rows(spark).withColumn("order_date", F.lit(None).cast("timestamp_ntz")).withColumn("batch_id", F.lit(0))
    B.write_batches(bad, batch_dir)
    with pytest.raises(ValueError, match="no valid rows"):
        B.load_batch(spark, batch_dir, 0, work_dir(spark, "t-invalid-target"))


def test_empty_batch_file_is_found(spark, tmp_dir):
    for i, text in enumerate(["order_id\no1\no2\n", "order_id\n", ""]):
        with open(os.path.join(tmp_dir, f"batch_{i}.csv"), "w") as f:
            f.write(text)
    fact = clean_frame(spark, [row("o1", "c", "p", "2024-01-01", 1), row("o2", "c", "p", "2024-01-01", 1)])
    r = V.check_batch_files(spark, tmp_dir, fact, 2).first()
    assert (r.total_batches, r.empty_batches, r.total_rows, r.passed) == (3, 2, 2, False)


def test_table_over_a_filled_folder(spark):
    from shoplens.sources.clean_store import create_table
    loc = work_dir(spark, "t-filled")
    write_clean(three_rows(spark), loc)
    assert create_table(spark, "oc_filled_tbl", loc).count() == 3
    spark.sql("DROP TABLE oc_filled_tbl")


def test_check_clean_flags_duplicates(spark):
    df = three_rows(spark).union(three_rows(spark).where("order_id = 'o1'"))
    r = V.check_clean(df).first()
    assert r.duplicate_rows == 1 and not r.passed
    with pytest.raises(ValueError):
        V.raise_if_failed(V.check_clean(df), "clean")


def test_batch_csv_files_and_create_table(spark, tmp_dir):
    import os
    from shoplens.sources.clean_store import create_table
    for i, rows in enumerate([["o1", "o2"], ["o3"]]):
        with open(os.path.join(tmp_dir, f"batch_{i}.csv"), "w") as f:
            f.write("order_id,payment_value\n" + "".join(f"{r},1\n" for r in rows))
    with open(os.path.join(tmp_dir, "batch_x.csv"), "w") as f:
        f.write("order_id,payment_value\nz,1\n")
    got = sorted((r.order_id, r.batch_id) for r in B.read_batch_files(spark, tmp_dir).collect())
    assert got == [("o1", 0), ("o2", 0), ("o3", 1), ("z", None)]
    loc = os.path.join(tmp_dir, "tbl")
    t1 = create_table(spark, "oc_test_tbl", loc)
    t2 = create_table(spark, "oc_test_tbl", loc)  # idempotent
    assert t1.columns == t2.columns and "order_month" in t1.columns
    spark.sql("DROP TABLE IF EXISTS oc_test_tbl")


def test_run_local_pipeline_dry_and_real(spark):
    from shoplens.plans.ingest import run_ingest
    from shoplens.sources.testdata import raw_from_testdata
    from tests.conftest import SF_SMALL
    work = work_dir(spark, "t-local")
    raw = raw_from_testdata(spark, SF_SMALL)
    dry = run_ingest(spark, raw, work, dry_run=True, batch_size=2000)
    assert dry["pointer"] == 0 and dry["dry_run_rows"] == 2000 and dry["clean"]["passed"]
    real = run_ingest(spark, raw, work, dry_run=False, batch_size=2000, retrain=False, marts=True)
    n = dry["clean"]["rows"]
    assert real["pointer"] == -(-n // 2000)
    assert real["table"] == {"row_count": n, "duplicate_pk_groups": 0}
    assert spark.read.parquet(f"{work}/marts/metrics").first().total_orders == n
    again = run_ingest(spark, raw, work, dry_run=False, batch_size=2000, retrain=False)
    assert again["status"] == "up to date" and again["pointer"] == real["pointer"] and again["table"] == real["table"]
    assert run_ingest(spark, raw, work, dry_run=True, batch_size=2000)["dry_run_rows"] == 0
    daily = run_ingest(spark, raw, work, dry_run=True, mode="daily")
    assert daily["pointer"] == 0 and daily["status"] == "pending" and daily["batches"]["passed"]


def test_check_batches_detects_gap_and_bad_names(spark):
    fact = clean_frame(spark, [row(f"o{i}", "c", "p", "2024-01-01", 1) for i in range(5)])
    b = B.split_row_batches(fact, 2)
    gap = b.withColumn("batch_id", F.when(F.col("batch_id") == 2, 5).otherwise(F.col("batch_id")))
    r = V.check_batches(gap, fact, 2).first()
    assert r.gaps == 3 and not r.passed  # ids 2, 3, 4 missing
    bad = b.withColumn("batch_id", F.when(F.col("batch_id") == 2, F.lit(None)).otherwise(F.col("batch_id")))
    r2 = V.check_batches(bad, fact, 2).first()
    assert r2.invalid_names == 1 and not r2.passed
    assert V.check_batches(b, fact, 2).first().passed


@pytest.mark.parametrize("files", [1, 10])
def test_later_batch_wins(spark, files):
    batch_dir = work_dir(spark, "t-overlap")
    first = clean_frame(spark, [row("o1", "c", "p1", "2024-01-01", 10)]).withColumn("batch_id", F.lit(0))
    second = clean_frame(spark, [row("o1", "c", "p1", "2024-01-01", 5)]).withColumn("batch_id", F.lit(1))
    B.write_batches(first.unionByName(second), batch_dir)
    target, ckpt = work_dir(spark, "t-overlap-target"), work_dir(spark, "t-overlap-ckpt")
    ingest(spark, batch_dir, target, ckpt, files_per_trigger=files)
    assert compact(spark, target, ckpt) is None
    assert [str(r.payment_value) for r in read_clean(spark, target).collect()] == ["5.00"]


def test_translation_null_key_is_rejected(spark):
    tr = spark.createDataFrame([("casa", "home"), (None, "misc")],
                               "product_category_name string, product_category_name_english string")
    r = V.check_translations(tr).first()
    assert r.null_keys == 1 and not r.passed
    assert V.check_translations(tr.where("product_category_name IS NOT NULL")).first().passed


def test_review_files_hold_whole_texts_in_little_room(spark):
    """Every review row of the CSV files has its whole text; what the repeats take is compressed away."""
    import glob
    import os

    from shoplens import queries as Q
    from shoplens.session import ensure_checkpoint_dir

    sf = "/root/testdata/sf0.001"
    base = ensure_checkpoint_dir(spark).removeprefix("file:")
    old = set(glob.glob(f"{base}/shoplens/raw_csv-*"))
    Q.q_orders_clean_from_csv(spark, sf)
    path, = set(glob.glob(f"{base}/shoplens/raw_csv-*")) - old
    at = f"{path}/{Q.RAW_FILES['reviews']}"
    got = Q.read_raw(spark, path)["reviews"]
    docs, lines = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/lineitem.parquet").where("l_returnflag = 'R'")
    n = docs.count()
    want = lines.join(docs, lines.l_orderkey % n == docs.doc_id, "left").selectExpr("string(l_orderkey) k", "concat('a \"quoted\" word, and:\n', text) c")
    have = got.selectExpr("order_id k", "review_comment_message c")
    assert have.exceptAll(want).count() == 0 and want.exceptAll(have).count() == 0
    text = want.selectExpr("sum(octet_length(c))").first()[0]
    assert sum(os.path.getsize(f) for f in glob.glob(f"{at}/part-*")) < text / 4


def test_a_file_of_a_cut_can_be_read_by_several_tasks(spark, tmp_dir, monkeypatch):
    import glob

    import pyarrow.parquet as pq
    from pyspark.sql import functions as F

    from shoplens.sources import batches as B

    monkeypatch.setattr(B, "ROW_GROUP_BYTES", 64 << 10)
    cut = spark.range(60000).select((F.col("id") / 1000).cast("int").alias("batch_id"), F.sha2(F.col("id").cast("string"), 256).alias("x"))
    B.write_batches(cut, f"{tmp_dir}/cut")
    files = [pq.ParquetFile(f) for f in glob.glob(f"{tmp_dir}/cut/*/*.parquet")]
    assert sum(f.metadata.num_rows for f in files) == 60000 and all(f.metadata.num_row_groups > 3 for f in files)
    assert B.read_batches(spark, f"{tmp_dir}/cut").exceptAll(cut).count() == 0


def test_two_cuts_share_the_order(spark, monkeypatch):
    """The rows are sorted once, and a cut of sorted files isn't shuffled again."""
    from pyspark.sql import DataFrame

    fact = clean_frame(spark, [row(f"o{i:02}", "c", "p", f"2024-01-{1 + i % 9:02}", i) for i in range(40)])
    want = {n: sorted((r.batch_id, r.order_id) for r in B.split_row_batches(fact, n).collect()) for n in (3, 7)}
    asked, sorts = [], []
    real, number = DataFrame.hint, B.global_row_number
    monkeypatch.setattr(DataFrame, "hint", lambda df, name, *a: asked.append(name) or real(df, name, *a))
    monkeypatch.setattr(B, "global_row_number", lambda *a: sorts.append(a) or number(*a))
    path, numbered = work_dir(spark, "t-shared"), B.number_rows(fact)
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    for n in (3, 7):
        B.write_batches(B.split_row_batches(numbered, n), path, in_order=True)
        assert sorted((r.batch_id, r.order_id) for r in B.read_batches(spark, path).collect()) == want[n]
    assert len(sorts) == 1 and asked == []
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before


def test_replayed_months_are_left(spark):
    """Months whose rows of the batch stand already keep their files; any other value, also a null
    in another column or a key that stands twice, is written."""
    target = work_dir(spark, "t-replay")
    write_clean(three_rows(spark), target)
    batch = clean_frame(spark, [row("o1", "c", "p1", "2024-01-01", 99), row("o9", "c", "p9", "2024-02-01", 5), row("n", "c", "p", "2024-05-01", 5)])
    upsert(spark, target, batch)
    files = files_of(spark, target)
    stats = upsert(spark, target, batch)
    assert files_of(spark, target) == files and stats["files_rewritten"] == 0 and stats["rows_upserted"] == 3
    one = batch.withColumn("payment_value", F.when(F.col("order_id") == "n", F.lit(6)).otherwise(F.col("payment_value")).cast("decimal(18,2)"))
    upsert(spark, target, one)
    assert {f.split("/")[0] for f in files_of(spark, target) ^ files} == {"order_month=2024-05-01"}
    for city, state in ((None, "x"), ("x", None)):  # a hash passes over nulls
        odd = clean_frame(spark, [row("n", "c", "p", "2024-05-01", 6)]).withColumns(
            {"customer_city": F.lit(city).cast("string"), "customer_state": F.lit(state).cast("string")})
        upsert(spark, target, odd)
        got = read_clean(spark, target).where("order_id = 'n'").collect()
        assert [(r.customer_city, r.customer_state) for r in got] == [(city, state)]
    write_clean(odd, target, mode="append")
    upsert(spark, target, odd)
    assert read_clean(spark, target).where("order_id = 'n'").count() == 1


@pytest.mark.parametrize("probe_rows", [1, 10**9])
def test_upsert_equals_plain_merge(spark, monkeypatch, probe_rows):
    from shoplens.sources import upsert as U

    monkeypatch.setattr(U, "PROBE", 3)
    monkeypatch.setattr(U, "PROBE_ROWS", probe_rows)
    rows = [row(f"o{i % 40}", "c", f"p{i % 7}", f"2024-0{1 + i % 4}-1{i % 8}", i) for i in range(90)]
    rows += rows[:4]  # a target may repeat keys
    target = work_dir(spark, "t-plain")
    for part in (rows[:50], rows[50:]):
        write_clean(clean_frame(spark, part), target, mode="append")
    old = [(r.order_id, r.product_id, r.order_date) for r in clean_frame(spark, rows).collect()]
    batch = clean_frame(spark, [row(f"o{i % 40}", "c", f"p{i % 7}", f"2024-0{1 + i % 4}-1{i % 8}", i + (i % 5 == 0)) for i in range(0, 60, 2) if i % 4]
                        + [row(f"new{i}", "c", "p", "2024-02-02", i) for i in range(5)])
    batch = batch.dropDuplicates(["order_id", "product_id", "order_date"]).cache()
    want = U.merge_frames(clean_frame(spark, rows), batch)
    upsert(spark, target, batch)
    got = read_clean(spark, target, keep_partition=False)
    assert len(old) == 94 and got.exceptAll(want.select(*got.columns)).count() == want.select(*got.columns).exceptAll(got).count() == 0


def test_merge_by_month_is_one_shuffle_and_one_sort(spark):
    import re
    from datetime import date

    from shoplens.sources import upsert as U
    from shoplens.sources.clean_store import with_partition

    def frame(rows):
        return with_partition(clean_frame(spark, rows)).withColumn("order_id", F.expr("nullif(order_id, 'null')"))

    target = frame([row(f"o{i % 9}", "c", "p", f"2024-0{1 + i % 2}-01", i) for i in range(30)] + [row("null", "c", "p", "2024-01-01", 1)] * 2)
    batch = frame([row("o1", "c", "p", "2024-02-01", 7), row("null", "c", "p", "2024-01-01", 2)])
    got = U.merge_months(target, batch, U.PK_COLUMNS, {date(2024, 1, 1): 2, date(2024, 2, 1): 1})
    want = U.merge_frames(target, batch).select(*got.columns)
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    plan = got.sortWithinPartitions("order_month", "order_date", "order_id", "product_id")._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning|Exchange rangepartitioning", plan)) == 1 and len(re.findall(r"\bSort \[", plan)) == 1
