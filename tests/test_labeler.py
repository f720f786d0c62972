"""Labelers plugged in: set up once a worker, tried again, quarantined."""
import os
import tempfile

from clickloom.operators.labels import label_with

GOOD = '{"intent": "i", "target_description": null, "expected_outcome": "o", "confidence": "low"}'


def flaky(folder, name):
    """Defined here, so that it travels to the workers as it is."""
    class Flaky:
        def __init__(self):
            self.name = name

        def setup(self):
            with open(f"{folder}/setup-{os.getpid()}", "a") as f:
                f.write("x")
            tried = set()

            def answer(request):
                if request == "raises":
                    raise RuntimeError("down")
                if request == "second time" and request not in tried:
                    tried.add(request)
                    raise TimeoutError("slow")
                return {"none": None, "extra": GOOD[:-1] + ', "more": 1}', "torn": GOOD[:-1]}.get(request, GOOD)
            return answer
    return Flaky()


def test_answers_are_checked_and_failures_kept(spark):
    folder = tempfile.mkdtemp(prefix="labeler-")
    rows = [(i, 0, r) for i, r in enumerate(["fine", "raises", "second time", "none", "extra", "torn"] + ["fine"] * 40)]
    requests = spark.createDataFrame(rows, "rec_id bigint, seg bigint, request_json string").repartition(6)
    labels, bad = label_with(requests, flaky(folder, folder), tries=2)
    got = {r["rec_id"]: r["error"] for r in bad.collect()}
    assert got == {1: "RuntimeError: down", 3: "no answer", 4: "not a label: extra more", 5: "not a label: invalid JSON"}
    assert {r["rec_id"] for r in labels.collect()} == {0, 2, *range(6, 46)}
    first = labels.filter("rec_id = 0").first()
    assert (first["intent"], first["target_description"], first["expected_outcome"], first["confidence"]) == ("i", None, "o", "low")
    # once a worker, however many tasks and reads
    assert all(open(f"{folder}/{f}").read() == "x" for f in os.listdir(folder)) and 1 <= len(os.listdir(folder)) <= 6
    once, bad = label_with(requests, flaky(folder, folder + "2"))
    assert "TimeoutError: slow" in {r["error"] for r in bad.collect()}
