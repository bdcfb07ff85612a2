import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from feedbackmill.functions.text import feature_tokens
from feedbackmill.operators import lookup, sentiment, terms, tfidf, topics, word_lists
from feedbackmill.operators.positions import with_line_number, with_position
from feedbackmill.operators.ranking import top_per_group
from feedbackmill.plans import adhoc
from feedbackmill.session import stage

# One group holds a third of the rows or more in all of these.


def skewed(n, seed=1):
    rng = random.Random(seed)
    return [(i, "hot" if rng.random() < 0.5 else f"g{rng.randrange(7)}", rng.randrange(50))
            for i in range(n)]


@pytest.fixture()
def frame(spark):
    return spark.createDataFrame(skewed(3000), "id int, g string, v int").repartition(7)


def test_position_matches_a_plain_count(frame):
    got = {(r["g"], r["pos"]): r["id"] for r in with_position(frame, "g", ["v", "id"]).collect()}
    want = {}
    for group in {g for _, g, _ in skewed(3000)}:
        rows = sorted((v, i) for i, g, v in skewed(3000) if g == group)
        want.update({(group, pos): i for pos, (_, i) in enumerate(rows)})
    assert got == want


def test_position_keeps_rows_without_a_group(spark):
    df = spark.createDataFrame([(1, None), (2, "a"), (3, None)], "id int, g string")
    got = sorted((r["id"], r["pos"]) for r in with_position(df, "g", ["id"]).collect())
    assert got == [(1, 0), (2, 0), (3, 1)]


def test_line_number_rises_with_group_and_position(frame):
    rows = with_line_number(frame, "g", ["v", "id"]).orderBy("g", "pos").collect()
    lines = [r["line_no"] for r in rows]
    assert lines == sorted(set(lines)) and len(lines) == 3000


@pytest.mark.parametrize("n", [1, 5, 2000])
def test_top_per_group(frame, n):
    order = [F.desc("v"), F.asc("id")]
    got = top_per_group(frame, ["g"], order, n, ["id"], rank="rank").collect()
    want = set()
    for group in {g for _, g, _ in skewed(3000)}:
        rows = sorted((-v, i) for i, g, v in skewed(3000) if g == group)[:n]
        want |= {(group, rank + 1, i) for rank, (_, i) in enumerate(rows)}
    assert {(r["g"], r["rank"], r["id"]) for r in got} == want


@pytest.mark.parametrize("limit", [0, lookup.BROADCAST_BYTES])
@pytest.mark.parametrize("how", ["inner", "left", "left_anti", "left_semi"])
def test_attach_with_and_without_broadcast(spark, frame, monkeypatch, limit, how):
    monkeypatch.setattr(lookup, "BROADCAST_BYTES", limit)
    small = spark.createDataFrame([("hot", 1), ("g1", 2)], "g string, w int")
    joined = lookup.attach(frame, small, ["g"], ["id"], how)
    plan = joined._jdf.queryExecution().toString()
    assert ("BroadcastHashJoin" in plan) == (limit > 0)
    got, want = joined.collect(), frame.join(small, "g", how).collect()
    assert sorted(str(sorted(r.asDict().items())) for r in got) == sorted(
        str(sorted(r.asDict().items())) for r in want
    )


def test_scorer_batches():
    def echo(texts):
        return ["Positive" for _ in texts]

    def fails(texts):
        raise RuntimeError

    assert sentiment.score_batch(echo, []) == []
    assert sentiment.score_batch(echo, ["a"] * 50) == ["Positive"] * 50
    assert sentiment.score_batch(fails, ["a", "b"]) == ["Neutral"] * 2
    assert sentiment.score_batch(lambda t: None, ["a"]) == ["Neutral"]
    assert sentiment.score_batch(lambda t: ["Negative"], ["a", "b"]) == ["Negative", "Neutral"]
    assert sentiment.score_batch(lambda t: ["Negative"] * 9, ["a"]) == ["Negative"]
    assert sentiment.score_batch(lambda t: ["angry"], ["a"]) == ["Neutral"]


@pytest.mark.parametrize("n", [0, 1, 50, 51, 120])
def test_scorer_keeps_rows_and_labels_together(spark, n):
    def scorer(texts):
        assert 0 < len(texts) <= 50
        if "bad" in texts:
            raise RuntimeError
        return ["Positive" if t.endswith("0") else "Negative" for t in texts][:49]

    rows = [(i, f"text {i}") for i in range(n)]
    df = spark.createDataFrame(rows, "id int, review_text string").coalesce(1)
    got = {r["id"]: r["sentiment"] for r in sentiment.classify_sentiment(df, scorer).collect()}
    want = {
        i: "Neutral" if i % 50 == 49 else "Positive" if i % 10 == 0 else "Negative"
        for i in range(n)
    }
    assert got == want


@pytest.mark.parametrize("calls", [1, 3])
def test_scorer_sees_full_batches_of_different_texts(spark, tmp_path, calls):
    """Batches go on over Arrow batches, equal texts of a task are sent once, and failing calls again."""
    def scorer(texts):
        batch = f"{len(texts)} {len(set(texts))} {hash(tuple(texts))}"
        tries = tmp_path / f"{abs(hash(batch))}"
        with open(tries, "a") as file:
            file.write(batch + "\n")
        if "text 7" in texts and len(tries.read_text().splitlines()) < 3:
            raise RuntimeError("busy")
        return [("Positive", "Negative", "Neutral")[int(t.split()[1]) % 3] for t in texts]

    rows = [(i, f"text {i % 230}") for i in range(1000)]
    df = spark.createDataFrame(rows, "id int, review_text string").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "33")
    try:
        got = sentiment.classify_sentiment(df, scorer, calls=calls, attempts=3).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [(r["id"], r["sentiment"]) for r in got] == [(i, ("Positive", "Negative", "Neutral")[i % 230 % 3]) for i in range(1000)]
    made = [p.read_text().splitlines() for p in tmp_path.iterdir()]
    assert sorted(int(m[0].split()[0]) for m in made) == [30, 50, 50, 50, 50]
    assert all(m[0].split()[0] == m[0].split()[1] for m in made)
    assert sorted(len(m) for m in made) == [1, 1, 1, 1, 3]


def test_every_text_is_scored_once(spark, tmp_path):
    def scorer(texts):
        for text in texts:
            with open(tmp_path / text.replace(" ", "_"), "a") as file:
                file.write("x")
        return ["Positive" if t.endswith("1") else "Negative" for t in texts]

    rows = [(i, None if i % 50 == 0 else f"text {i % 4}", "x") for i in range(400)]
    df = spark.createDataFrame(rows, "id int, review_text string, other string").repartition(4)
    got = {r["id"]: r for r in sentiment.classify_once(df.where("review_text is not null"), scorer).collect()}
    assert len(got) == 392 and {p.read_text() for p in tmp_path.iterdir()} == {"x"}
    assert all(r["sentiment"] == ("Positive" if i % 4 == 1 else "Negative") and r["other"] == "x" for i, r in got.items())
    empty = sentiment.classify_once(df.where("review_text is null"), lambda texts: ["Negative"] * len(texts))
    assert [r["sentiment"] for r in empty.collect()] == ["Negative"] * 8


def test_lexicon(spark):
    texts = ["Great food, GREAT staff", "awful", "great but awful", "greatly", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, review_text string")
    got = [r["sentiment"] for r in sentiment.lexicon_sentiment(df).orderBy("id").collect()]
    assert got == ["Positive", "Negative", "Neutral", "Neutral", "Neutral"]


def topic_frame(spark, counts):
    words = ["pizza crust cheese", "staff service waiter", "parking garage street"]
    rows = [
        (f"b{n}", 1000 * n + i, f"{words[i % 3]} {words[i % 3]} visit{i}")
        for n in counts for i in range(n)
    ]
    return spark.createDataFrame(rows, "business_url string, id long, review_text string")


def test_cluster_rules(spark, monkeypatch):
    monkeypatch.setattr(topics, "CHUNK_ROWS", 4)  # several chunks per business
    monkeypatch.setattr(topics, "DENSE_ROWS", 2)
    rows = topic_frame(spark, [1, 4, 5, 9, 30])
    extra = spark.createDataFrame(
        [("stop", 90000 + i, "the and of") for i in range(6)]
        + [("blank", 91000, ""), ("blank", 91001, None)],
        rows.schema,
    )
    got = topics.cluster_reviews(rows.union(extra), n_starts=3).collect()
    by_business = {}
    for r in got:
        by_business.setdefault(r["business_url"], []).append(r)
    assert {b: len(v) for b, v in by_business.items()} == {
        "b1": 1, "b4": 4, "b5": 5, "b9": 9, "b30": 30
    }
    assert len({r["review_id"] for r in got}) == len(got)
    for small in ("b1", "b4"):
        assert {(r["cluster_id"], r["cluster_label"]) for r in by_business[small]} == {
            (0, "General Feedback")
        }
    for name, k in (("b5", 2), ("b9", 4), ("b30", 5)):
        assert {r["cluster_id"] for r in by_business[name]} <= set(range(k))
        labels = {(r["cluster_id"], r["cluster_label"]) for r in by_business[name]}
        assert len({c for c, _ in labels}) == len(labels)
    # Texts of different subjects never share a cluster when there are clusters enough.
    subjects = {}
    for r in by_business["b30"]:
        subjects.setdefault(r["cluster_id"], set()).add(r["review_id"] % 3)
    assert all(len(s) == 1 for s in subjects.values())


def test_small_businesses_are_clustered_in_one_pass(spark, monkeypatch):
    """A business of one chunk takes no step of the common loop, and gets the clusters that the loop gives."""
    rng = random.Random(5)
    words = ["pizza", "crust", "staff", "waiter", "parking", "garage", "music", "price", "table", "window"]
    texts = [
        (f"b{n}", 1000 * n + i, " ".join(rng.choices(words, range(1, 11), k=rng.randint(4, 15)))) for n in (5, 9, 30, 41) for i in range(n)
    ]
    rows = spark.createDataFrame(texts + texts[-41:], "business_url string, id long, review_text string")  # ids that come twice

    def groups(chunk_rows):
        monkeypatch.setattr(topics, "CHUNK_ROWS", chunk_rows)
        # Starts that end alike are told apart by the last digits of their costs, so numbers may differ.
        members = {}
        for r in topics.cluster_reviews(rows, n_starts=4).collect():
            members.setdefault((r["business_url"], r["cluster_id"], r["cluster_label"]), []).append(r["review_id"])
        return sorted((url, label, sorted(ids)) for (url, _, label), ids in members.items())

    together = groups(4)
    monkeypatch.setattr(topics, "settle", lambda *args, **options: pytest.fail("a step over all tasks"))
    assert groups(1000) == together and sum(len(ids) for *_, ids in together) == 5 + 9 + 30 + 82
    # Of the many draws, some business stops early when only one step is allowed.
    notes = []
    topics.cluster_reviews(rows, max_iter=1, warnings=notes).collect()
    assert notes == ["k-means stopped after 1 steps, with centres still moving"]


def test_terms_are_counted_where_the_review_lies(spark):
    """Counts, ids that come twice and null ids; the plan sends no row per term to make the weights."""
    rows = spark.createDataFrame(
        [("a", 1, "Red red blue x"), ("a", 1, "Red red blue x"), ("a", 2, "blue the"), ("a", 3, "... !"),
         ("a", None, "red"), (None, 4, "red"), ("b", 5, None)],
        "business_url string, id long, review_text string",
    )
    found = stage(tfidf.review_terms(rows), "terms")
    counts = {(r["business_url"], r["id"]): dict(zip(r["terms"], r["counts"])) for r in found.collect()}
    assert counts == {
        ("a", 1): {"red": 2, "blue": 1}, ("a", 2): {"blue": 1, "the": 1}, ("a", 3): {}, ("a", None): {"red": 1},
        (None, 4): {"red": 1},
    }
    vocab = stage(tfidf.vocabulary(found, ["the"]), "vocabulary")
    assert {(r["term"], r["total"], r["df"]) for r in vocab.where("business_url = 'a'").collect()} == {("red", 5, 3), ("blue", 3, 3)}
    weights = tfidf.tfidf_weights(found, vocab)
    got = {(r["business_url"], r["id"], r["term"]): r["weight"] for r in weights.collect()}
    assert got == pytest.approx({
        ("a", 1, "red"): 2 / 5**0.5, ("a", 1, "blue"): 1 / 5**0.5, ("a", 2, "blue"): 1.0, ("a", None, "red"): 1.0,
    })
    plan = weights._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan and "CoGroup" in plan


def topic_vectors(spark, dense, k, n_chunks=3):
    """Vectors of a business "u" as the operators keep them, and their chunks."""
    rows = [
        ("u", i % n_chunks, i, k, np.flatnonzero(v).tolist(), v[v != 0].tolist()) for i, v in enumerate(dense)
    ]
    schema = "business_url string, chunk int, id long, k int, slots array<int>, weights array<double>"
    vectors = spark.createDataFrame(rows, schema)
    return vectors, stage(vectors.select("business_url", "chunk").distinct(), "chunks")


def test_distances_are_taken_in_slices_of_a_cache():
    """Slices at the full width hold 2 MB at most; empty vectors lie at their distance from the origin."""
    rng = np.random.default_rng(11)
    dense = rng.random((300, 7)) * (rng.random((300, 7)) > 0.6)
    dense[[0, 150, 299]] = 0
    lists = {"slots": [np.flatnonzero(v).tolist() for v in dense], "weights": [v[v != 0].tolist() for v in dense]}
    schema = pa.schema({"slots": pa.list_(pa.int32()), "weights": pa.list_(pa.float64())})
    points = np.vstack([dense[[4, 9]], np.full(7, 3.0), np.zeros(7)])
    found = list(topics.Rows(pa.table(lists, schema)).squares(points))
    assert (np.concatenate([part for part, _ in found]) == dense).all()
    assert np.allclose(np.concatenate([squares for _, squares in found]), ((dense[:, None] - points) ** 2).sum(axis=2))
    assert max(len(part) for part, _ in found) * tfidf.MAX_FEATURES * 8 <= 2 * 1024 * 1024


def topic_centres(spark, starts):
    rows = [("u", i, np.asarray(p).ravel().tolist(), float("inf"), True) for i, p in enumerate(starts)]
    return spark.createDataFrame(rows, "business_url string, start int, points array<double>, cost double, moving boolean")


def plain_step(dense, points):
    squares = ((dense[:, None] - points) ** 2).sum(axis=2)
    best = squares.argmin(axis=1)
    after = [dense[best == j].mean(axis=0) if (best == j).any() else points[j] for j in range(len(points))]
    return np.array(after), squares.min(axis=1).sum()


def test_steps_match_plain_ones(spark):
    rng = np.random.default_rng(3)
    dense = rng.random((40, 6)) * (rng.random((40, 6)) > 0.5)
    vectors, chunks = topic_vectors(spark, dense, 3)
    starts = [dense[[0, 1, 2]], dense[[5, 9]], np.array([dense[7], np.full(6, 50.0)])]
    centres = topic_centres(spark, starts)
    for _ in range(3):
        centres = stage(topics.next_centres(vectors, chunks, centres, 6, 1e-9), "centres")
        plain = [plain_step(dense, p) for p in starts]
        starts = [p for p, _ in plain]
        for r in centres.collect():
            assert np.allclose(r["points"], starts[r["start"]].ravel()) and np.isclose(r["cost"], plain[r["start"]][1])
    settled, moving = topics.settle(vectors, chunks, centres, 6, 100, 1e-9)
    assert moving == 0 and settled.count() == 3
    for r in settled.collect():
        points = np.reshape(r["points"], (-1, 6))
        assert np.allclose(plain_step(dense, points)[0], points)
    assert topics.settle(vectors, chunks, topic_centres(spark, starts[:1]), 6, 1, 0.0)[1] in (0, 1)


def cost_of(dense, points):
    return ((dense[:, None] - points) ** 2).sum(axis=2).min(axis=1).sum()


@pytest.mark.parametrize("kind", ["blobs", "skewed", "sparse"])
def test_starts_are_spread(spark, kind):
    """Starts cost no more than vectors picked at random, on average, and no two centres of one are equal."""
    rng = np.random.default_rng(7)
    width, k = 8, 5
    if kind == "blobs":
        dense = np.eye(width)[rng.integers(0, k, 300)] + rng.normal(size=(300, width)) * 0.01
    elif kind == "skewed":  # nearly all in one place
        dense = np.r_[np.tile(np.eye(width)[:1], (290, 1)), np.eye(width)[rng.integers(1, width, 10)]]
    else:
        dense = rng.random((300, width)) * (rng.random((300, width)) > 0.7)
    vectors, chunks = topic_vectors(spark, dense, k)
    rows = topics.first_centres(vectors, chunks, k, 10, width).collect()
    starts = [np.reshape(r["points"], (-1, width)) for r in rows]
    assert sorted(r["start"] for r in rows) == list(range(10))
    for points in starts:
        assert len(np.unique(points, axis=0)) == len(points) == min(k, len(np.unique(dense, axis=0)))
        assert all((dense == p).all(axis=1).any() for p in points)
    random = [cost_of(dense, dense[rng.choice(len(dense), k, replace=False)]) for _ in range(50)]
    assert np.mean([cost_of(dense, p) for p in starts]) <= np.mean(random)
    if kind != "sparse":
        assert min(cost_of(dense, p) for p in starts) < 0.5 * np.mean(random)
    few, some = topic_vectors(spark, dense[:1].repeat(6, axis=0), 3)  # fewer different vectors than clusters
    assert [len(r["points"]) for r in topics.first_centres(few, some, 3, 2, width).collect()] == [width, width]


def test_draws_follow_the_distance(spark):
    """Far vectors are drawn in proportion to their squared distance, equal ones never."""
    dense = np.array([[1.0, 0.0]] * 5 + [[2.0, 0.0]] + [[4.0, 0.0]])  # squared distances 0, 1 and 9
    vectors, chunks = topic_vectors(spark, dense, 2)
    before = vectors.where("id = 0").crossJoin(spark.range(2000).selectExpr("cast(id as int) as start"))
    drawn = stage(before.select("business_url", "start", "id", "slots", "weights"), "drawn")
    got = [r["id"] for r in topics.draw_distant(vectors, chunks, drawn, 1, 1, 2).select("id").collect()]
    assert len(got) == 2000 and set(got) == {5, 6}
    assert 0.87 < got.count(6) / 2000 < 0.93
    both = topics.draw_distant(vectors, chunks, drawn.where("start = 3"), 1, 5, 2)
    assert sorted(r["id"] for r in both.collect()) == [5, 6]


@pytest.fixture()
def scope(spark):
    def load(session):
        reviews = session.createDataFrame(
            [(i, "u1" if i % 2 else "u2", float(i)) for i in range(120)],
            "id long, business_url string, rating double",
        )
        aspects = reviews.selectExpr(
            "business_url", "id as review_id", "'Food' as aspect", "'Neutral' as sentiment_score"
        )
        return {"reviews": reviews, "aspect_sentiments": aspects}

    return adhoc.scoped_session(spark, load, "u1")


def test_scope_and_chart(spark, scope):
    assert adhoc.run_query(scope, "select * from reviews;").count() == 60
    assert adhoc.run_query(scope, "with a as (select 1 x) select x from a").count() == 1
    named = adhoc.run_query(scope, "select 1 from reviews where business_url = :k", {"k": "o'b"})
    assert named.count() == 0
    joined = "select * from reviews r join aspect_sentiments a on a.review_id = r.id"
    assert adhoc.run_query(scope, joined).count() == 60
    result = adhoc.answer(
        scope, "select id, rating, 1 as id from reviews order by rating desc", True, "bar", "a", "b"
    )
    assert result.data.count() == 60 and result.context.count() == 50
    assert result.context.first()["rating"] == 119.0
    assert result.chart.points.columns == ["x", "y"] and result.chart.kind == "bar"
    assert result.chart.points.first()["x"] == 119
    assert adhoc.answer(scope, "select id from reviews", True).chart is None
    assert adhoc.answer(scope, "select id, rating from reviews where id < 0", True).chart is None
    assert adhoc.answer(scope, "select id, rating from reviews", False).chart is None
    assert not spark.catalog.tableExists("reviews")
    windowed = "select id, row_number() over (order by rating) from reviews where id in (select review_id from aspect_sentiments)"
    assert adhoc.run_query(scope, windowed).count() == 60
    ctes = "with a as (select * from reviews), b as (select id from a union all values (1)) select * from b, range(1)"
    assert adhoc.run_query(scope, ctes).count() == 61


@pytest.mark.parametrize("graph", [True, False])
def test_failures_at_run_time(scope, graph):
    with pytest.raises(adhoc.QueryError):
        adhoc.answer(scope, "select id, raise_error('no') from reviews", graph).context_rows()


@pytest.mark.parametrize("sql", ["", "  ", None, ";"])
def test_empty_sql(scope, sql):
    with pytest.raises(ValueError):
        adhoc.run_query(scope, sql)


@pytest.mark.parametrize(
    "sql",
    [
        "select nothing from reviews",
        "select * from reviews) as x, (select 1 y",
        "select 1) as result union all (select 2",
        "drop view reviews",
        "create table t as select 1",
        "insert into reviews select * from reviews",
        "set spark.sql.runSQLOnFiles=true",
        "select 1; drop view reviews",
        "select 1) as a; drop view reviews --",
        "select * from parquet.`/root/testdata/sf0.001/orders.parquet`",
        "select java_method('java.lang.System', 'getenv', 'HOME')",
        "with a as (select 1) insert into reviews select * from a",
        "select `java_method`('java.lang.System', 'getenv', 'HOME')",
        "select reflect/* */('java.lang.System', 'getenv', 'HOME')",
        "select try_reflect -- x\n('java.lang.System', 'getenv', 'HOME')",
        "select * from identifier('reviews')",
        "select IDENTIFIER/**/('java_method')('java.lang.System', 'getenv', 'HOME')",
        "select * from global_temp.other",
        "select count(*) from default.elsewhere",
        "select (select max(x) from global_temp.other) from reviews",
        "with a as (select x from global_temp.other) select * from a",
        "select id from reviews where exists (select 1 from spark_catalog.default.elsewhere)",
    ],
)
def test_refused_sql(spark, scope, sql):
    spark.range(3).toDF("x").createOrReplaceGlobalTempView("other")
    spark.sql("create table if not exists default.elsewhere using parquet as select 1 as x")
    with pytest.raises(adhoc.QueryError):
        adhoc.run_query(scope, sql)
    assert scope.catalog.tableExists("reviews")


WORD_TEXTS = [
    "It's a Café_1 'tis ÉTÉ é x1", "naïve ÀÇ Š ŸÆ ß½ ²³ 2024 2024's", "bob's BOB'S 's ''quote'' a' s's __ _", "", None, "ab\ncd\u00a0ef", "İstanbul ἈΡΧΗ it's's 12 ٣٤",
    "日本語 ok's", "ﬀ x", "á", "a", "ŉa ſt Ĳ", "don't can't rock'n'roll'", "x" * 300 + "é" * 300,
]


@pytest.mark.parametrize("cloud", [False, True])
def test_words_are_those_of_the_patterns(spark, cloud):
    """Words cut from bytes are those that Spark's patterns find, for plain texts and others, and in a slice of a batch."""
    signs = "abzAZ019_' -.\u00e9\u00c9\u00d7\u00df\u00aa\u00bd\u0178\u017f\u0130\u0391\u0663"
    rng = random.Random(1)
    texts = WORD_TEXTS + ["".join(rng.choices(signs[:rng.choice([12, 21, len(signs)])], k=rng.randint(0, 40))) for _ in range(400)]
    texts += [chr(i) + "b" + chr(i).upper() + "c" for i in range(1, 0x180)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string").coalesce(1)
    found = terms._cloud_words(F.col("t")) if cloud else feature_tokens(F.col("t"))
    table = rows.select("id", found.alias("found"), *word_lists.plain_or_words(F.col("t"), found)).toArrow()
    for some in (table, table.slice(3)):
        owner, words = word_lists.row_words(some, cloud)
        got = {i: [] for i in range(len(some))}
        for i, word in zip(owner.tolist(), words.to_pylist()):
            got[i].append(word)
        assert list(got.values()) == [r or [] for r in some["found"].to_pylist()]


def test_word_pairs_take_no_row_each(spark, monkeypatch):
    """Groups counted by lot give the terms that rows per pair give; no row per word or pair is made for them."""
    rng = random.Random(2)
    words = "pizza pizzas crust the boss bosses staff it's bob's bobs été 12 glass glasses s is" .split()
    texts = [
        (rng.choice(["a", "b", "c", None]), rng.choice(["Positive", "Negative", "Neutral"]), " ".join(["new york's", *rng.choices(words, k=rng.randint(0, 12))]))
        for _ in range(600)
    ] + [("d", "Positive", None), ("e", "Positive", "!"), ("f", "Negative", "日本 日本")]
    rows = spark.createDataFrame(texts + texts[:50], "business_url string, sentiment string, review_text string")
    for options in ({"stop_words": ("pizza",)}, {"merge_plurals": True, "n": 5}):
        clouds = terms.term_frequencies(rows, collocations=True, **options)
        assert "explode" not in clouds._jdf.queryExecution().optimizedPlan().toString()
        with monkeypatch.context() as patch:
            patch.setattr(terms, "CLOUD_BYTES", -1)
            plain = terms.term_frequencies(rows, collocations=True, **options).collect()
        with monkeypatch.context() as patch:  # some groups by lot, some not
            patch.setattr(terms, "CLOUD_BYTES", 3000)
            both = terms.term_frequencies(rows, collocations=True, **options).collect()
        assert sorted(clouds.collect(), key=str) == sorted(plain, key=str) == sorted(both, key=str)
        assert any(" " in r["term"] for r in plain)


def test_large_vocabularies_are_added_by_share(spark, monkeypatch):
    """A business of many reviews spreads its terms over shares; ties at the end of a vocabulary go by the term."""
    rng = random.Random(3)
    texts = [(rng.choice(["a", "b", None]), i, " ".join(rng.choices([f"w{j:02}" for j in range(40)] + ["the", "été"], k=12))) for i in range(80)]
    found = stage(tfidf.review_terms(spark.createDataFrame(texts, "business_url string, id long, review_text string").repartition(5)), "terms")
    plan = tfidf.vocabulary(found, ["the"])._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan and "inline" not in plan
    totals, dfs = {}, {}
    for url, _, text in texts:
        for word in text.split():
            totals.setdefault(url, {}).setdefault(word, []).append(word)
        for word in set(text.split()):
            dfs[url, word] = dfs.get((url, word), 0) + 1
    for rows in (10_000, 10):
        monkeypatch.setattr(tfidf, "CHUNK_ROWS", rows)
        got = {(r["business_url"], r["slot"]): (r["term"], r["total"], r["df"]) for r in tfidf.vocabulary(found, ["the"], 7).collect()}
        for url in ("a", "b"):
            best = sorted((-len(v), w) for w, v in totals[url].items() if w != "the")[:7]
            assert [got[url, i] for i in range(7)] == [(w, -n, dfs[url, w]) for n, w in best]
        assert len(got) == 14
