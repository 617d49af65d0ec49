"""Questions to the rating model and their answers, as tables.

A question is addressed by a hash of its whole text, which holds the criteria and the facts of the listing.  So
an unchanged listing is asked about once, listings with the same facts share an answer, and an answer that arrives late is
not given to a listing that has changed since.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentlake.criteria import Criteria
from rentlake.operators.scoring import prompts
from rentlake.session import cut_lineage
from rentlake.sources.keyed import Keyed
from rentlake.sources.store import Store


class Requests:
    def __init__(self, store: Store, buckets: int = 64, fold_every: int = 16):
        size = {"buckets": buckets, "fold_every": fold_every}
        self.store = store
        self.asked = Keyed(store, "requests", "request_id string, listing_id string, asked_at timestamp", ["request_id", "listing_id"], **size)
        self.answers = Keyed(store, "answers", "request_id string, response string, replied_at timestamp", ["request_id"], **size)

    def answer(self, version: int, answers: DataFrame) -> None:
        """Take in (request_id, response, replied_at); the newest answer counts, of equally new ones the largest text."""
        given = cut_lineage(answers.where("request_id is not null and response is not null").select(*self.answers.columns))
        both = given.unionByName(self.answers.lookup(given, version))
        newest = F.max(F.struct("replied_at", "response")).alias("_a")
        self.answers.write(version, both.groupBy("request_id").agg(newest).select("request_id", "_a.response", "_a.replied_at"))

    def answered(self, version: int, answers: DataFrame) -> DataFrame:
        """Listings (listing_id) that were asked about, by versions before, with one of these answers."""
        return self.asked.lookup(answers, version).select("listing_id").distinct()

    def questions(self, listings: DataFrame, c: Criteria) -> DataFrame:
        """(listing_id, request_id, prompt), written once."""
        return cut_lineage(prompts(listings, c).withColumn("request_id", F.sha2("prompt", 256)))

    def replies(self, questions: DataFrame, before: int | None = None) -> DataFrame:
        """(listing_id, response, replied_at) for the questions that have an answer."""
        known = self.answers.lookup(questions, before)
        return questions.select("listing_id", "request_id").join(known, "request_id").select("listing_id", "response", "replied_at")

    def ask(self, version: int, questions: DataFrame, as_of: str) -> None:
        """Enter questions that no version before asked, and write their prompts, each text once, as ``prompts``."""
        pair = ["request_id", "listing_id"]
        asked = questions.select(*pair)
        known = cut_lineage(self.asked.lookup(asked, version).select(*pair))
        # Prompts travel once, to the row of their text; all else is done on the two keys.
        unasked = questions.select("request_id", "prompt").join(known.select("request_id").distinct(), "request_id", "left_anti")
        self.store.write("prompts", version, unasked.dropDuplicates(["request_id"]))
        new = asked.join(known, pair, "left_anti").dropDuplicates(pair)
        self.asked.write(version, new.withColumn("asked_at", F.lit(as_of).cast("timestamp")))
