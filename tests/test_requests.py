"""Questions, answers and newest scores that runs keep up."""

import datetime as dt
import random

from rentlake import criteria
from rentlake.operators.requests import Requests
from rentlake.operators.scoring import SCORE_SCHEMA, LatestScores, latest_scores
from rentlake.operators.upsert import LISTING_SCHEMA
from rentlake.plans import daily
from rentlake.sources.store import Store
from tests.test_operators import messages

AT = dt.datetime(2024, 3, 1)
FACTS = "id string, title string, rent_eur int, condo_fee_eur int, area_sqm double, rooms double, location_hint string, raw_snippet string"
ANSWERS = "request_id string, response string, replied_at timestamp"


def test_unchanged_listings_are_asked_once(spark, tmp_path):
    c, store = criteria.load(), Store(spark, str(tmp_path))
    requests = Requests(store, buckets=2, fold_every=2)
    listing = lambda i, rent: (i, "Trilocale", rent, None, 70.0, 3.0, None, None)
    rows = lambda *values: spark.createDataFrame(list(values), FACTS)
    prompts = lambda v: spark.read.parquet(store.path("prompts", v)).collect()
    first = requests.questions(rows(listing("a", 700), listing("b", 700), listing("c", 800)), c)
    requests.ask(1, first, "2024-03-01 00:00:00")
    of = {r["listing_id"]: r["request_id"] for r in first.collect()}
    assert of["a"] == of["b"] != of["c"] and {r["request_id"] for r in prompts(1)} == set(of.values()) and len(prompts(1)) == 2
    # two answers to one question: the newest counts; nothing comes of an unknown or a null one
    given = spark.createDataFrame([(of["a"], "old", AT), (of["a"], "new", AT + dt.timedelta(1)), ("?", "x", AT), (None, "x", AT), (of["c"], None, AT)], ANSWERS)
    requests.answer(2, given)
    assert sorted(r["listing_id"] for r in requests.answered(2, given.where("response = 'new'")).collect()) == ["a", "b"]
    second = requests.questions(rows(listing("a", 700), listing("b", 750), listing("c", 800), listing("d", 700)), c)
    assert sorted((r["listing_id"], r["response"]) for r in requests.replies(second).collect()) == [("a", "new"), ("d", "new")]
    for _ in range(2):  # a run that is repeated asks the same
        requests.ask(2, second, "2024-03-01 03:00:00")
        assert [r["request_id"] for r in prompts(2)] == [r["request_id"] for r in second.where("listing_id = 'b'").collect()]
    # an older answer that comes late changes nothing
    requests.answer(3, given.where("response = 'old'"))
    assert sorted(r["response"] for r in requests.replies(first).collect()) == ["new", "new"]
    requests.ask(3, second.limit(0), "2024-03-01 06:00:00")
    assert prompts(3) == []


def test_newest_scores_equal_those_of_the_history(spark, tmp_path):
    rng, latest, history = random.Random(4), LatestScores(Store(spark, str(tmp_path)), buckets=3, fold_every=2), None
    for version in range(1, 6):
        rows = [(f"s{version}-{i}", rng.choice(["a", "b", "c", "d"]), rng.randrange(100), ["r"], None, "none", [], "none", None, AT + dt.timedelta(hours=rng.randrange(6))) for i in range(5)]
        scores = spark.createDataFrame(rows, SCORE_SCHEMA)
        history = scores if history is None else history.unionByName(scores)
        latest.write(version, scores)
        if version == 4:
            latest.write(version, scores)  # a run that is repeated
        if version > 2:
            assert sorted(map(tuple, latest.read().select("listing_id", "id", "score").collect())) == sorted(map(tuple, latest_scores(history).select("listing_id", "id", "score").collect()))


def test_run_asks_and_takes_the_answer(spark, tmp_path):
    c, store = criteria.load(), Store(spark, str(tmp_path))
    mails = messages(spark).selectExpr("*", "timestamp'2024-03-01 10:00:00' as received_at")
    posts = spark.createDataFrame([], "post_id string, group_id string, permalink string, message string, posted_at timestamp")
    none, unanswered = spark.createDataFrame([], "query_key string, lat double, lng double"), spark.createDataFrame([], ANSWERS)
    first = daily.run(spark, store.root, 1, mails, posts, c, "2024-03-01 12:00:00", none, none, answers=unanswered)
    asked = spark.read.parquet(store.path("prompts", 1)).orderBy("request_id").collect()
    assert 0 < len(asked) <= first["listings_scored"] == store.read("listings", LISTING_SCHEMA).count()
    given = spark.createDataFrame([(asked[0]["request_id"], '{"budgetFit":9,"summary":"good"}', dt.datetime(2024, 3, 1, 13))], ANSWERS)
    second = daily.run(spark, store.root, 2, mails, posts, c, "2024-03-01 15:00:00", none, none, answers=given)
    scored = store.read("listing_scores", SCORE_SCHEMA).collect()
    assert second["listings_scored"] == len(scored) >= 1 and all(r["model"] == "model" and r["summary"] == "good" for r in scored)
    assert spark.read.parquet(store.path("prompts", 2)).count() == 0
    assert daily.duplicate_skips_since(store, "2024-02-01 00:00:00").first()["n"] == first["duplicates_skipped"]
