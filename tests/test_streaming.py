import json

from sparkgauge.streaming import runlog


def test_breaker_and_availability(spark, tmp_path):
    what = ["completed", "contract_failure", "contract_failure", "contract_failure", "completed"]
    for i in range(0, 5, 2):
        rows = [{"kind": "prediction", "arm": "a", "doc": str(k), "docClass": "c", "repeat": 1, "availability": what[k], "seq": k} for k in range(i, min(5, i + 2))]
        (tmp_path / f"{i}.json").write_text("\n".join(map(json.dumps, rows)))
    log = runlog.read_log(spark, str(tmp_path))
    for name, frame, mode in (("trips", runlog.breaker(log, 3), "append"), ("seen", runlog.availability(log), "complete")):
        q = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert [tuple(r) for r in spark.table("trips").collect()] == [("a", 3, 3)]
    assert tuple(spark.table("seen").first()) == ("a", 5, 2, 0, 3)
