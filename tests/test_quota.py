"""One quota for all tasks: a fake service that counts what it is sent, in which minute."""

import glob
import json
import os
import time
import uuid

import pytest

from quillspark.operators import index, quota


class Service:
    """Writes down each call; may refuse some."""

    def __init__(self, folder, refuse=0, kind="rate-limit", after_ms=None):
        self.folder, self.refuse, self.kind, self.after_ms = folder, refuse, kind, after_ms

    def __call__(self, texts):
        if self.refuse and not os.path.exists(f"{self.folder}/refused-{self.refuse}") and any("odd" in t for t in texts):
            done = len(glob.glob(f"{self.folder}/refused-*"))
            open(f"{self.folder}/refused-{done + 1}", "w").close()
            raise index.EmbedError(self.kind, "429", self.after_ms)
        with open(f"{self.folder}/call-{uuid.uuid4().hex}.json", "w") as f:
            json.dump([time.time(), len(texts)], f)
        return [[float(len(t))] for t in texts]


def calls(folder):
    return sorted(json.load(open(f)) for f in glob.glob(f"{folder}/call-*.json"))


def contents(spark, n, odd=()):
    return spark.createDataFrame([(f"h{k}", f"odd {k}" if k in odd else f"text {k}") for k in range(n)], "content_hash string, embed_text string")


def test_no_minute_sees_more_than_the_quota(spark, tmp_path):
    made = index.embed_contents(contents(spark, 130), Service(str(tmp_path)), 1, tasks=3, per_minute=50, minute=1.5)
    assert {r["content_hash"]: r["vector"] for r in made.collect()} == {f"h{k}": [float(len(f"text {k}"))] for k in range(130)}
    seen = calls(tmp_path)
    assert sum(n for _, n in seen) == 130 and max(n for _, n in seen) <= 20
    for begun, _ in seen:
        assert sum(n for t, n in seen if begun <= t < begun + 1.5) <= 50


def test_refused_batches_come_again_after_the_time_asked_for(spark, tmp_path):
    service = Service(str(tmp_path), refuse=2, after_ms=1200)
    made = index.embed_contents(contents(spark, 30, odd=[7]), service, 1, tasks=2, per_minute=40, minute=0.2)
    begun = time.time()
    assert made.count() == 30 and time.time() - begun >= 2.4
    assert sum(n for _, n in calls(tmp_path)) == 30


@pytest.mark.parametrize("kind", ["daily-quota", "other"])
def test_other_errors_end_all_tasks(spark, tmp_path, kind):
    made = index.embed_contents(contents(spark, 60, odd=[3]), Service(str(tmp_path), refuse=99, kind=kind), 1, tasks=3, per_minute=1000, minute=0.1)
    with pytest.raises(Exception, match="429"):
        made.collect()


def test_wrong_number_of_vectors_and_no_rows(spark, tmp_path):
    with pytest.raises(Exception, match="expected"):
        index.embed_contents(contents(spark, 3), lambda texts: [[1.0]], 1, tasks=1, per_minute=10, minute=0.1).collect()
    assert index.embed_contents(contents(spark, 3).filter("false"), Service(str(tmp_path)), 1, tasks=2, per_minute=10, minute=0.1).collect() == []
    with pytest.raises(ValueError):
        index.embed_contents(contents(spark, 3), Service(str(tmp_path)), 1, per_minute=0)


def test_shares_are_whole_and_take_turns():
    for n in range(1, 6):
        for batches in range(8):
            for turn in range(6):
                asking = [k % 2 == 0 for k in range(n)]
                got = quota.shares(asking, batches, turn)
                assert sum(got) == batches and all(g == 0 for g, a in zip(got, asking) if not a)
                assert max(got) - min(g for g, a in zip(got, asking) if a) <= 1
    assert quota.shares([False, False], 3, 1) == [0, 0]
    assert [quota.shares([True, True, True], 1, t).index(1) for t in range(4)] == [0, 1, 2, 0]
