import random
from datetime import datetime, timedelta

from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from trailmark.streaming import results

SCHEMA = "session_id int, call_id string, kind string, at timestamp, seq long"
PATIENCE, LATE = timedelta(hours=2), timedelta(hours=1)


def rows(seed, n):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        at = datetime(2024, 1, 1) + timedelta(minutes=3 * i)
        out.append((rnd.randrange(3), rnd.choice("abc"), rnd.choice(["call", "result", "result", "other"]), at, i))
    return out


def got(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def test_stream_equals_batch_with_restarts(spark, tmp_path):
    """Files come in several runs, each from the checkpoint of the one before, rows out of order within what is allowed."""
    every = rows(1, 240)
    every[5] = (None, "a", "call", every[5][3], 5)
    every[6] = (1, "a", "call", None, 6)
    source, to = str(tmp_path / "in"), str(tmp_path / "out")
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(SCHEMA).parquet(source)
    for k in range(4):
        some = every[k * 60 : k * 60 + 60]
        if k < 3:  # twenty rows, an hour, come with the next file's
            every[k * 60 + 50 : k * 60 + 70] = every[k * 60 + 50 : k * 60 + 70][::-1]
            some = every[k * 60 : k * 60 + 60]
        spark.createDataFrame(some, SCHEMA).write.mode("append").parquet(source)
        results.run_through(stream, to, PATIENCE, "1 hour")
    table = spark.read.schema(SCHEMA).parquet(source)
    made = spark.read.parquet(f"{to}/rows")
    assert got(made) == got(results.in_batch(table, PATIENCE, LATE))
    assert {r.outcome for r in made.select("outcome").distinct().collect()} == {"answered", "unanswered", "superseded", "orphan"}


def test_outcomes_by_hand(spark):
    at = lambda h, m=0: datetime(2024, 1, 1, h, m)
    said = [(1, "late", "call", at(0), 1), (1, "late", "result", at(2), 2), (1, "too late", "call", at(0), 3), (1, "too late", "result", at(2, 1), 4),
            (1, "twice", "call", at(1), 5), (1, "twice", "call", at(1), 6), (1, "twice", "result", at(1, 30), 7), (1, "twice", "result", at(1, 31), 8),
            (1, "open", "call", at(8), 9), (1, "ended", "call", at(6), 10), (2, "x", "noise", at(10), 11), (2, "x", "result", at(10), 12)]
    made = results.in_batch(spark.createDataFrame(said, SCHEMA), PATIENCE, LATE)
    assert sorted((r.call_id, r.outcome) for r in made.collect()) == [
        ("ended", "unanswered"), ("late", "answered"), ("too late", "orphan"), ("too late", "unanswered"), ("twice", "answered"), ("twice", "orphan"), ("twice", "superseded"),
    ]
    answered = made.where("call_id = 'twice' and outcome = 'answered'").select("call_at", "result_at").first()
    assert (answered.call_at, answered.result_at) == (at(1), at(1, 30))


def test_nothing(spark):
    assert results.in_batch(spark.createDataFrame([], SCHEMA), PATIENCE, LATE).count() == 0
    assert results.in_batch(spark.createDataFrame([(1, "a", "call", None, 1)], SCHEMA).where(F.lit(True)), PATIENCE, LATE).count() == 0


def test_calls_of_a_session_share_state():
    """A session's rows go to its state at once, and one timer settles all its calls."""
    done = []

    class State:
        def __init__(self, name):
            self.name, self.held = name, []

        def appendList(self, rows):
            done.append(("append", self.name, len(rows)))
            self.held += rows

        def get(self):
            return iter(self.held)

        def put(self, rows):
            done.append(("put", self.name, len(rows)))
            self.held = rows

        def clear(self):
            done.append(("clear", self.name))
            self.held = []

    class Handle:
        def getListState(self, name, schema):
            return State(name)

        def registerTimer(self, at):
            done.append(("timer", at))

    class Times:
        def getCurrentWatermarkInMs(self):
            return 1 + 3600_000 * 3 // 2

    hour = 3600_000_000
    settler = results.Settler(PATIENCE, StringType())
    settler.init(Handle())
    said = [Row(call_id=c, at_us=i, seq=i, kind="call") for i, c in enumerate("abcdefghij")] + [Row(call_id="a", at_us=hour, seq=10, kind="result"), Row(call_id="b", at_us=4 * hour, seq=11, kind="result")]
    assert list(settler.handleInputRows((7,), iter(said), Times())) == []
    out = list(settler.handleExpiredTimer((7,), Times(), None))
    assert [(r.session_id, r.call_id, r.outcome) for r in out] == [(7, "a", "answered")]
    assert done == [("append", "rows", 12), ("timer", 1), ("put", "rows", 1), ("put", "open", 9), ("timer", 2 * 3600_000 + 1)]
