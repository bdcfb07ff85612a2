"""The log of a store: writers at the same time, checkpoints and vacuum."""

from concurrent.futures import ThreadPoolExecutor

import pytest

from feedbackmill import schemas
from feedbackmill.operators import dashboard
from feedbackmill.plans import bundles, ingest
from feedbackmill.sinks import commit_log
from feedbackmill.sinks.commit_log import ConflictingWrite, put_if_absent
from feedbackmill.sinks.store import ReviewStore


def reviews(spark, keys, text="t"):
    rows = [(i, k, "n", 1.0, "d", text, None) for i, k in enumerate(keys)]
    return spark.createDataFrame(rows, schemas.REVIEWS)


def texts(store):
    return sorted((r["business_url"], r["review_text"]) for r in store.read("reviews").collect())


def test_a_name_is_taken_once(spark, tmp_path):
    name = str(tmp_path / "new" / "1.json")
    with ThreadPoolExecutor(8) as pool:
        took = list(pool.map(lambda i: put_if_absent(spark, name, f"text {i} " * 1000), range(16)))
    assert took.count(True) == 1
    content = (tmp_path / "new" / "1.json").read_text()
    assert content == f"text {took.index(True)} " * 1000
    assert [p.name for p in (tmp_path / "new").iterdir() if not p.name.startswith(".")] == ["1.json"]


def test_two_writers(spark, tmp_path):
    one, two = (ReviewStore(spark, str(tmp_path / "store")) for _ in range(2))
    since = two.log.version()
    one.replace("reviews", reviews(spark, ["a", "b"], "one"), reviews(spark, ["a", "b"]))
    # The second writer began before: other datasets are kept, and so is what only adds; a replacement is refused.
    two.replace("reviews", reviews(spark, ["c"], "two"), reviews(spark, ["c"]), since)
    with pytest.raises(ConflictingWrite):
        two.replace("reviews", reviews(spark, ["b"], "two"), reviews(spark, ["b", "d"]), since)
    two.replace("aspect_sentiments", spark.createDataFrame([], schemas.ASPECT_SENTIMENTS), reviews(spark, ["b"]), since)
    two.append(reviews(spark, ["b"], "added"))
    assert texts(one) == [("a", "one"), ("b", "added"), ("b", "one"), ("c", "two")]
    # A writer that has seen the other's work, or has done it itself, replaces.
    two.replace("reviews", reviews(spark, ["b"], "later"), reviews(spark, ["b"]))
    since = one.log.version()
    for text in ("mine", "mine again"):
        one.replace("reviews", reviews(spark, ["a"], text), reviews(spark, ["a"]), since, "me")
    assert texts(two) == [("a", "mine again"), ("b", "later"), ("c", "two")]


def test_many_writers_at_once(spark, tmp_path):
    store = ReviewStore(spark, str(tmp_path / "store"))

    def write(i):
        ids = store.take_ids(10)
        store.replace("reviews", reviews(spark, [f"k{i}"], f"text {i}"), reviews(spark, [f"k{i}"]))
        return ids

    with ThreadPoolExecutor(6) as pool:
        ids = sorted(pool.map(write, range(6)))
    assert ids == [0, 10, 20, 30, 40, 50] and store.next_id() == 60
    assert texts(store) == [(f"k{i}", f"text {i}") for i in range(6)]


def test_runs_of_one_dataset_at_once(spark, tmp_path, monkeypatch):
    """A run whose dataset another run replaces meanwhile is refused, and leaves the other's tables as they are."""
    store, path = ReviewStore(spark, str(tmp_path / "store")), tmp_path / "a.csv"
    path.write_text("text,title\nfirst,Shop\n")
    options = ingest.IngestOptions(derived=("aspect_sentiments",))
    real, inner = ingest.prepare, []

    def prepare(*args):
        if not inner:
            inner.append(1)
            inner.append(ingest.ingest_csv(store, [str(path)], options).status)
        return real(*args)

    monkeypatch.setattr(ingest, "prepare", prepare)
    with pytest.raises(ConflictingWrite):
        ingest.ingest_csv(store, [str(path)], options)
    assert inner[1] == "completed" and store.status("Shop") == "failed"
    assert store.read("reviews").count() == store.read("aspect_sentiments").count() == 1


def test_checkpoints_and_vacuum(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(commit_log, "CHECKPOINT_EVERY", 5)
    store = ReviewStore(spark, str(tmp_path / "store"))
    assert (store.log.version(), store.next_id(), store.status("k0")) == (-1, 0, "not_found")
    for i in range(4):
        store.take_ids(7)
        store.log_run(reviews(spark, ["k0", f"r{i}"]), f"run {i}", "completed" if i % 2 else "pending", 0)
        store.replace("reviews", reviews(spark, ["k0"], f"text {i}"), reviews(spark, ["k0"]), batch=f"batch {i}")
    store.append(reviews(spark, ["k1"], "added"))
    want = [("k0", "text 3"), ("k1", "added")]

    def state():
        return texts(store), store.next_id(), store.status("k0"), store.status("r2"), [store.log.has_batch(f"batch {i}") for i in (0, 3, 4)]

    assert store.log.last_checkpoint()[0] == 9 and store.log.version() == 12
    assert state() == (want, 28, "completed", "pending", [True, True, False])
    store.log.vacuum()
    assert state() == (want, 28, "completed", "pending", [True, True, False])
    root = tmp_path / "store" / "commits"
    assert not list(root.glob("entries/*.json")) and not list(root.glob("rows/*")) and len(list(root.glob("checkpoints/*.json"))) == 1
    # The log goes on after it, and only reads what came since.
    assert store.take_ids(1) == 28 and store.log.version() == 13
    store.replace("reviews", reviews(spark, ["k1"], "replaced"), reviews(spark, ["k1"]))
    assert texts(store) == [("k0", "text 3"), ("k1", "replaced")]
    assert len(store.log.entries(store.log.last_checkpoint()[0])) <= 5
    # A checkpoint that a lost writer left half done is not seen.
    (root / "checkpoints" / "00000000000000000099-lost" / "commits").mkdir(parents=True)
    assert texts(store) == [("k0", "text 3"), ("k1", "replaced")]


def test_compaction_and_other_writers(spark, tmp_path, monkeypatch):
    store = ReviewStore(spark, str(tmp_path / "store"))
    store.append(reviews(spark, ["a", "b"]))
    real = ReviewStore._add

    def add(self, table, rows):
        monkeypatch.setattr(ReviewStore, "_add", real)
        store.append(reviews(spark, ["a"], "meanwhile"))
        return real(self, table, rows)

    monkeypatch.setattr(ReviewStore, "_add", add)
    with pytest.raises(ConflictingWrite):
        store.compact("reviews")
    assert texts(store) == [("a", "meanwhile"), ("a", "t"), ("b", "t")]


def test_dashboards_are_kept_up_to_date(spark, tmp_path):
    store = ReviewStore(spark, str(tmp_path / "store"))
    labels = ("Positive", "Negative", None, "odd")
    rows = [
        (i, f"k{i % 4}", "n", (None, 0.0, 2.5, 5.0, 7.0)[i % 5], ("2024-01-05", "2024-02-01", "Unknown")[i % 3], "t" * (i % 9), labels[i % 4])
        for i in range(120)
    ]
    whole = spark.createDataFrame(rows, schemas.REVIEWS)

    def check():
        reviews, kept = store.read("reviews"), bundles.stored_dashboard(store)
        again = bundles.dashboard_bundle(reviews) | {
            "monthly_volume_rating": dashboard.monthly_volume_rating(reviews), "dataset_counts": dashboard.dataset_counts(reviews),
            "overall_average": dashboard.overall_average(reviews),
        }
        assert kept.keys() == again.keys()
        for name, chart in kept.items():
            assert sorted(map(tuple, chart.collect()), key=str) == sorted(map(tuple, again[name].collect()), key=str), name
            if name != "top_words":
                assert f"{store.root}/reviews" not in chart._jdf.queryExecution().executedPlan().toString()

    store.append(whole.where("id < 50"))
    store.append(whole.where("id >= 50"))
    check()
    store.replace("reviews", whole.where("id % 8 = 1"), whole.where("business_url in ('k1', 'k2')"))
    check()
    store.clear("reviews", whole.where("business_url = 'k3'"))
    store.compact("reviews")
    check()
    one = bundles.stored_dashboard(store, "k0")["dataset_counts"].collect()
    assert [(r["business_url"], r["n"]) for r in one] == [("k0", 30)]
