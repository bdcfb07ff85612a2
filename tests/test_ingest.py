from datetime import date

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from feedbackmill import schemas
from feedbackmill.plans import adhoc, bundles, ingest
from feedbackmill.sinks.csv_export import export_csv
from feedbackmill.sinks.store import ReviewStore
from feedbackmill.sources.csv_files import read_review_csv
from feedbackmill.streaming import drop_folder
from feedbackmill.streaming.drop_folder import ingest_new_files, stream_new_files

AS_OF = date(2025, 1, 31)
OPTIONS = ingest.IngestOptions(as_of=AS_OF)

SHOP = (
    '﻿NAME, Text ,Stars,Review Date,title\n'
    'Ann,"He said ""hi""\nand   left. Great food",5,2 weeks ago,Shop A\n'
    "\n"
    "Bob,short\n"
    ',"x, y",5d,,Shop B\n'
    "Cy,terrible service,4e0,2024-01-02,\n"
    "Di,,nan,unknown,\n"
)


def write(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(folder / name)


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_csv_quirks(spark, tmp_path):
    path = write(tmp_path, "a b.csv", SHOP)
    reviews, datasets = read_review_csv(spark, [path])
    got = rows(reviews.orderBy("pos"), "user_name", "rating", "date", "review_text")
    assert got == [
        ("Ann", 5.0, "2 weeks ago", 'He said "hi"\nand   left. Great food'),
        ("Bob", 0.0, "Unknown", "short"),
        ("Unknown", 0.0, "Unknown", "x, y"),
        ("Cy", 4.0, "2024-01-02", "terrible service"),
        ("Di", 0.0, "unknown", ""),
    ]
    assert rows(datasets, "business_url") == [("Shop B",)]
    assert [r[0] for r in rows(reviews.orderBy("pos"), "pos")] == [0, 1, 2, 3, 4]


def test_csv_names_bytes_and_caps(spark, tmp_path):
    lines = [b"text,TEXT ,when date,time", b"first,second,d1,t1", b"b\xffd,z\xff,,t2", b""]
    plain = write(tmp_path, "plain file.csv", b"\n".join(lines))
    empty = write(tmp_path, "empty.csv", "text,stars\n")
    blank = write(tmp_path, "blank.csv", "")
    reviews, datasets = read_review_csv(spark, [plain, empty, blank], max_rows=1)
    assert rows(reviews, "business_url", "review_text", "date") == [
        ("plain file.csv", "second", "d1")
    ]
    assert sorted(rows(datasets, "business_url")) == [("empty.csv",), ("plain file.csv",)]
    whole, _ = read_review_csv(spark, [plain])
    assert rows(whole.orderBy("pos"), "review_text")[1] == ("z�",)


def test_csv_split_over_tasks(spark, tmp_path):
    lines = [f"user{i},text {i},{i % 5}" for i in range(5000)]
    path = write(tmp_path, "big.csv", "name,text,stars\n" + "\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        reviews, _ = read_review_csv(spark, [path], multi_line=False)
        got = rows(reviews.orderBy("pos"), "pos", "review_text")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [(i, f"text {i}") for i in range(5000)]
    assert reviews.select("line_no").distinct().count() == 5000


def test_files_of_a_dataset_are_parts_of_one_upload(spark, tmp_path):
    import os

    old = write(tmp_path, "z.csv", "text,title\nold,Shop\nold2,Shop\n")
    new = write(tmp_path, "a.csv", "text,title\nnew,Shop\n")
    os.utime(old, (1_600_000_000, 1_600_000_000))
    os.utime(new, (1_700_000_000, 1_700_000_000))
    reviews, datasets = read_review_csv(spark, [old, new])
    assert rows(reviews.orderBy("pos"), "pos", "review_text") == [(0, "old"), (1, "old2"), (2, "new")]
    assert datasets.select("business_url").distinct().count() == 1
    capped, _ = read_review_csv(spark, [old, new], max_rows=2)
    assert sorted(rows(capped, "review_text")) == [("old",), ("old2",)]
    store = ReviewStore(spark, str(tmp_path / "store"))
    ingest.ingest_csv(store, [old, new], OPTIONS)
    assert store.read("reviews", "Shop").count() == 3


def test_upload_job_and_replacement(spark, tmp_path):
    store = ReviewStore(spark, str(tmp_path / "store"))
    assert store.status("Shop B") == "not_found"
    assert store.read("reviews").count() == 0
    run = ingest.ingest_csv(store, [write(tmp_path, "a.csv", SHOP)], OPTIONS)
    assert (run.status, run.warnings) == ("completed", [])
    assert store.status("Shop B") == "completed"
    other = "text,title\n" + "\n".join(f"pizza number {i} was good,Other" for i in range(6))
    ingest.ingest_csv(store, [write(tmp_path, "o.csv", other)], OPTIONS)

    got = rows(store.read("reviews", "Shop B").orderBy("id"), "date", "review_text", "sentiment")
    assert got == [
        ("2025-01-17", 'He said "hi" and left. Great food', "Positive"),
        ("2025-01-30", "short", "Neutral"),
        ("2025-01-29", "x, y", "Neutral"),
        ("2024-01-02", "terrible service", "Negative"),
        ("2025-01-27", "", "Neutral"),
    ]
    ids = store.read("reviews").select("id")
    assert ids.distinct().count() == ids.count() == 11
    aspects = rows(store.read("aspect_sentiments", "Shop B").orderBy("review_id"), "aspect")
    assert [a[0] for a in aspects] == [
        "Food", "Overall Experience", "Overall Experience", "Service"
    ]
    assert set(rows(store.read("review_clusters", "Shop B"), "cluster_label")) == {
        ("General Feedback",)
    }
    others = store.read("review_clusters", "Other")
    assert others.count() == 6 and others.select("cluster_id").distinct().count() <= 3

    # A second upload leaves nothing of the first, and nothing derived from it.
    again = "text,title\nservice was good,Shop B\n"
    ingest.ingest_csv(store, [write(tmp_path, "again.csv", again)], OPTIONS)
    assert store.read("reviews", "Shop B").count() == 1
    ids = {r["id"] for r in store.read("reviews", "Shop B").collect()}
    for table in ("aspect_sentiments", "review_clusters"):
        assert {r["review_id"] for r in store.read(table, "Shop B").collect()} == ids
    assert store.read("reviews", "Other").count() == 6

    # An upload without rows empties its dataset.
    nothing = write(tmp_path, "Other", "text,title\n")
    ingest.ingest_csv(store, [nothing], OPTIONS)
    for table in ("reviews", "aspect_sentiments", "review_clusters", "term_frequencies"):
        assert store.read(table, "Other").count() == 0
    assert store.read("reviews", "Shop B").count() == 1

    bundle = bundles.advanced_bundle(store, "Shop B")
    assert rows(bundle["aspect_sentiment"], "aspect", "positive") == [("Service", 1)]
    assert bundle["negative_terms"].count() == 0
    with pytest.raises(bundles.DatasetNotFound):
        bundles.advanced_bundle(store, "nowhere")
    context = bundles.insight_bundle(store, "Shop B").first()
    assert (context["n"], context["pos_samples"]) == (1, ["service was good"])
    with pytest.raises(bundles.DatasetNotFound):
        bundles.insight_bundle(store, "Other")
    charts = bundles.dashboard_bundle(store.read("reviews"))
    assert charts["sentiment_breakdown"].agg(F.sum("n")).first()[0] == 1

    session = adhoc.store_session(store, "Shop B")
    got = adhoc.run_query(
        session,
        "select a.aspect, count(*) n from reviews r join aspect_sentiments a on a.review_id = r.id"
        " group by 1",
    )
    assert rows(got, "aspect", "n") == [("Service", 1)]


def test_store_keys_of_any_length_and_script(spark, tmp_path):
    store = ReviewStore(spark, str(tmp_path / "store"))
    keys = ["https://maps.example.com/é店/" + "x" * 300, "a=b/c d%20", "'; --"]
    reviews = spark.createDataFrame(
        [(i, k, "n", 1.0, "d", "t", None) for i, k in enumerate(keys)], schemas.REVIEWS
    )
    store.append(reviews)
    store.append(reviews.withColumn("id", F.col("id") + 10))
    for i, key in enumerate(keys):
        assert sorted(rows(store.read("reviews", key), "id")) == [(i,), (i + 10,)]
    store.replace("reviews", reviews.limit(0), reviews.where("id = 1"))
    assert store.read("reviews", keys[1]).count() == 0
    assert store.read("reviews").count() == 4


def test_failed_derivation_is_a_warning(spark, tmp_path, monkeypatch):
    store = ReviewStore(spark, str(tmp_path / "store"))

    def broken(*args, **kwargs):
        raise RuntimeError("no model")

    monkeypatch.setattr(ingest, "cluster_reviews", broken)
    run = ingest.ingest_csv(store, [write(tmp_path, "a.csv", SHOP)], OPTIONS)
    assert (run.status, run.warnings) == ("completed", ["review_clusters: RuntimeError"])
    assert store.read("aspect_sentiments").count() == 4


def test_failed_derivation_leaves_nothing_of_the_last_run(spark, tmp_path, monkeypatch):
    store = ReviewStore(spark, str(tmp_path / "store"))
    ingest.ingest_csv(store, [write(tmp_path, "a.csv", SHOP)], OPTIONS)
    assert store.read("review_clusters", "Shop B").count() > 0

    def broken(*args, **kwargs):
        raise RuntimeError("no model")

    monkeypatch.setattr(ingest, "cluster_reviews", broken)
    again = write(tmp_path, "b.csv", "text,title\nservice was good,Shop B\n")
    assert ingest.ingest_csv(store, [again], OPTIONS).warnings == ["review_clusters: RuntimeError"]
    assert store.read("review_clusters", "Shop B").count() == 0
    assert store.read("aspect_sentiments", "Shop B").count() == 1


def test_generations_and_compaction(spark, tmp_path):
    store = ReviewStore(spark, str(tmp_path / "store"))
    reviews = spark.createDataFrame(
        [(i, f"k{i % 5}", "n", 1.0, "d", "t", None) for i in range(50)], schemas.REVIEWS
    )
    store.append(reviews)
    store.append(reviews.where("business_url = 'k1'"))
    store.replace("reviews", reviews.where("id < 10"), reviews.where("business_url in ('k2', 'k3')"))
    store._add("reviews", reviews)  # a write that never came to its commits
    store.clear("reviews", reviews.where("business_url = 'k4'"))
    want = {"k0": 10, "k1": 20, "k2": 2, "k3": 2}

    def counts():
        return {r[0]: r[1] for r in store.read("reviews").groupBy("business_url").count().collect()}

    assert counts() == want
    before = len(list((tmp_path / "store" / "reviews").glob("generation=*")))
    store.compact("reviews")
    assert counts() == want and store.read("reviews", "k1").count() == 20
    assert (before, len(list((tmp_path / "store" / "reviews").glob("generation=*")))) == (4, 1)
    plan = store.read("reviews", "k1")._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_failed_run(spark, tmp_path, monkeypatch):
    store = ReviewStore(spark, str(tmp_path / "store"))
    path = write(tmp_path, "a.csv", SHOP)
    ingest.ingest_csv(store, [path], OPTIONS)

    def broken(*args, **kwargs):
        raise RuntimeError("no disk")

    monkeypatch.setattr(ingest, "prepare", broken)
    with pytest.raises(RuntimeError):
        ingest.ingest_csv(store, [path], OPTIONS)
    assert store.status("Shop B") == "failed"


def test_page_job(spark, tmp_path):
    item = (
        '<div class="jftiEf x"><div class="d4r55">{}</div><span class="kvMYJc" aria-label='
        '"{} stars"></span><span class="rsqaWe">{}</span><span class="wiI7pd">{}</span></div>'
    )
    html = "".join([
        item.format("Ann &amp; Co", "4.0", "a month ago", "Nice <b>pizza</b> here<br>really"),
        '<div class="jftiEf"><p>no fields<script>var a = "<b>";</script></div>',
        item.format("Cy", "five", "yesterday", "third"),
    ])
    pages = spark.createDataFrame(
        [(1, "u1", html), (2, "u2", html), (3, "u3", None), (4, None, html)],
        "page_id long, url string, html string",
    )
    records = spark.createDataFrame(
        [("u2", 9, 0, "Zed", 1.0, "2020-01-01", "record")],
        "business_url string, page_id long, item_pos int, user_name string, rating double,"
        " date string, review_text string",
    )
    store = ReviewStore(spark, str(tmp_path / "store"))
    ingest.ingest_pages(store, pages, records, OPTIONS, max_items=2)
    got = rows(store.read("reviews", "u1").orderBy("id"), "user_name", "rating", "date", "review_text")
    assert got == [
        ("Ann & Co", 4.0, "2025-01-01", "Nice pizza here really"),
        ("Unknown", 0.0, "2025-01-30", ""),
    ]
    assert rows(store.read("reviews", "u2"), "user_name") == [("Zed",)]
    assert store.read("reviews", "Unknown").count() == 2
    assert store.status("u3") == "completed" and store.read("reviews", "u3").count() == 0


def test_drop_folder_takes_each_file_once(spark, tmp_path):
    folder, store = tmp_path / "drop", ReviewStore(spark, str(tmp_path / "store"))
    write(folder, "one.csv", "text\na\n")
    write(folder, "skipped.txt", "text\nb\n")

    def run():
        return len(list(ingest_new_files(store, str(folder), str(tmp_path / "seen"), OPTIONS)))

    assert run() == 1
    write(folder, "two.csv", "text,title\nc,Two\n")
    write(folder, "THREE.CSV", "text\nd\n")
    assert (run(), run()) == (1, 0)
    assert sorted(rows(store.read("reviews"), "business_url", "review_text")) == [
        ("THREE.CSV", "d"), ("Two", "c"), ("one.csv", "a")
    ]
    runs = store.read("dataset_runs").where("status = 'completed'")
    assert sorted(rows(runs, "business_url")) == [("THREE.CSV",), ("Two",), ("one.csv",)]
    write(folder, "one.csv", "text\nrewritten text\n")
    assert (run(), run()) == (1, 0)
    assert rows(store.read("reviews", "one.csv"), "review_text") == [("rewritten text",)]


def test_drop_folder_keeps_all_parts_of_a_dataset(spark, tmp_path):
    folder, store = tmp_path / "drop", ReviewStore(spark, str(tmp_path / "store"))
    options = ingest.IngestOptions(as_of=AS_OF, derived=())

    def run():
        return len(list(ingest_new_files(store, str(folder), str(tmp_path / "seen"), options, files_per_batch=1)))

    def texts(dataset):
        return sorted(t for (t,) in rows(store.read("reviews", dataset), "review_text"))

    for part in "abc":
        write(folder, f"part {part}+.csv", f"text,title\nfirst {part},Shop\n")
    write(folder, "other.csv", "text\nalone\n")
    write(folder, "empty.csv", "")
    assert (run(), run()) == (2, 0)
    assert texts("Shop") == ["first a", "first b", "first c"] and texts("other.csv") == ["alone"]
    # A rewritten part comes with the other ones, and with a part that is new.
    write(folder, "part b+.csv", "text,title\nsecond version b,Shop\n")
    write(folder, "part d+.csv", "text,title\nfirst d,Shop\n")
    assert (run(), run()) == (1, 0)
    assert texts("Shop") == ["first a", "first c", "first d", "second version b"]
    # A part that moves to another dataset leaves its former one.
    write(folder, "part a+.csv", "text,title\nmoved away,Second shop\n")
    assert (run(), run()) == (2, 0)
    assert texts("Shop") == ["first c", "first d", "second version b"] and texts("Second shop") == ["moved away"]
    # Only new files: a later upload, which replaces the earlier one with all its parts.
    write(folder, "part e+.csv", "text,title\nlater upload,Shop\n")
    assert (run(), run()) == (1, 0)
    assert texts("Shop") == ["later upload"]
    write(folder, "part e+.csv", "text,title\nlater upload rewritten,Shop\n")
    assert (run(), run()) == (1, 0)
    assert texts("Shop") == ["later upload rewritten"]


def test_stream_takes_new_and_rewritten_files(spark, tmp_path):
    folder, store = tmp_path / "drop", ReviewStore(spark, str(tmp_path / "store"))
    options = ingest.IngestOptions(as_of=AS_OF, derived=())

    def run():
        stream_new_files(store, str(folder), str(tmp_path / "state"), options, files_per_batch=2).awaitTermination()
        return sorted(rows(store.read("reviews"), "business_url", "review_text"))

    assert run() == []
    for part in "ab":
        write(folder, f"part {part}+.csv", f"text,title\nfirst {part},Shop\n")
    write(folder / "below", "ONE.CSV", "text\nalone\n")
    write(folder, "other.txt", "text\nnot taken\n")
    want = [("ONE.CSV", "alone"), ("Shop", "first a"), ("Shop", "first b")]
    assert run() == want
    version = store.log.version()
    assert run() == want and store.log.version() == version
    write(folder, "part b+.csv", "text,title\nsecond version b,Shop\n")
    assert run() == [("ONE.CSV", "alone"), ("Shop", "first a"), ("Shop", "second version b")]
    assert len(list((tmp_path / "state" / "snapshots").glob("*.json"))) <= 2


@pytest.mark.parametrize("dies_at", ["before the store", "after the store"])
def test_stream_that_dies_repeats_its_batch(spark, tmp_path, monkeypatch, dies_at):
    folder, store = tmp_path / "drop", ReviewStore(spark, str(tmp_path / "store"))
    options = ingest.IngestOptions(as_of=AS_OF, derived=())
    for name in ("one", "two"):
        write(folder, f"{name}.csv", f"text,title\nof {name},{name}\n")
    real = drop_folder.ingest_csv
    calls = []

    def dying(*args, **kwargs):
        calls.append(1)
        if len(calls) == 2 and dies_at == "before the store":
            raise RuntimeError("lost")
        run = real(*args, **kwargs)
        if len(calls) == 2:
            raise RuntimeError("lost")  # the commit is in the store, but neither ledger nor checkpoint know
        return run

    def run():
        stream_new_files(store, str(folder), str(tmp_path / "state"), options, files_per_batch=1).awaitTermination()

    monkeypatch.setattr(drop_folder, "ingest_csv", dying)
    with pytest.raises(StreamingQueryException):
        run()
    done, version = store.read("reviews").count(), store.log.version()
    assert done == (1 if dies_at == "before the store" else 2)
    ids = rows(store.read("reviews").orderBy("id"), "id", "business_url")
    run()
    assert len(calls) == 3  # of the two groups only the one that died comes again
    assert sorted(rows(store.read("reviews"), "business_url", "review_text")) == [("one", "of one"), ("two", "of two")]
    if dies_at == "after the store":
        assert store.log.version() == version and rows(store.read("reviews").orderBy("id"), "id", "business_url") == ids
    version = store.log.version()
    run()
    assert len(calls) == 3 and store.log.version() == version


def test_export(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, 4.0, ' say "hi"\nthere ', None), (2, 2.5, "", "x,y")],
        "id int, rating double, t string, u string",
    )
    out = str(tmp_path / "out")
    assert export_csv(df.coalesce(1), out)
    text = b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("*.csv"))).decode()
    assert text == (
        '"id","rating","t","u"\n"1","4"," say ""hi""\nthere ","null"\n"2","2.5","","x,y"\n'
    )
    assert not export_csv(df.limit(0), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()
