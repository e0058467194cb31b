"""Ingest as a stream gives what one batch gives."""

import json
import os

from fieldcast.session import scratch_path
from fieldcast.sources import documents, tables
from fieldcast.streaming import ingest


def doc(i, day=1, n=2):
    return json.dumps({"subId": f"s{i}", "locId": "L", "obsDt": f"2024-01-{day:02d} 08:00",
                       "allObsReported": True,
                       "obs": [{"speciesCode": f"x{j}", "howManyAtleast": j} for j in range(n)]})


def land(spark, path, docs):
    spark.createDataFrame([(d,) for d in docs], "value string").coalesce(1).write.mode(
        "append").text(path)


def run(spark, root):
    ingest.ingest(spark, f"{root}/in", f"{root}/store", f"{root}/cp", "R", 1).awaitTermination()
    c = tables.read_table(spark, f"{root}/store/checklists", tables.CHECKLISTS)
    o = tables.read_table(spark, f"{root}/store/observations", tables.OBSERVATIONS)
    return sorted(r["sub_id"] for r in c.collect()), sorted(map(tuple, o.collect()))


def test_stream_equals_batch_and_resumes(spark):
    root = scratch_path(spark, "s")
    land(spark, f"{root}/in", [doc(i) for i in range(5)])
    land(spark, f"{root}/in", [doc(i) for i in range(3, 8)])
    subs, seen = run(spark, root)
    raw = spark.createDataFrame([(doc(i),) for i in range(8)], "json string")
    docs = documents.parse(raw, "json", documents.CHECKLIST_DOC)
    assert subs == [f"s{i}" for i in range(8)]
    assert seen == sorted(map(tuple, documents.observation_rows(docs).collect()))
    # nothing new, then one new outing in an overlapping file
    assert run(spark, root) == (subs, seen)
    land(spark, f"{root}/in", [doc(7), doc(9)])
    more, _ = run(spark, root)
    assert more == [*subs, "s9"]
    # a lost checkpoint replays every file and still adds nothing
    ingest.ingest(spark, f"{root}/in", f"{root}/store", f"{root}/cp2", "R").awaitTermination()
    assert run(spark, root)[0] == more


def test_settled_days_come_out_once_the_watermark_passes(spark):
    root = scratch_path(spark, "w")
    land(spark, f"{root}/in", [doc(i, day) for i, day in enumerate([1, 1, 2, 20])])
    stream = ingest.settled_stream(ingest.document_stream(spark, f"{root}/in"), "R")
    (stream.writeStream.format("parquet").outputMode("append").option("path", f"{root}/out")
     .option("checkpointLocation", f"{root}/cp").trigger(availableNow=True).start()
     .awaitTermination())
    got = {str(r["obs_date"]): r["n"] for r in spark.read.parquet(f"{root}/out").collect()}
    assert got == {"2024-01-01": 2, "2024-01-02": 1}


def test_settled_days_over_several_waves(spark):
    root = scratch_path(spark, "w")
    waves = [[doc(1, 1), doc(2, 1), doc(3, 9)],           # watermark: the 2nd
             [doc(2, 1), doc(4, 2), doc(5, 3), doc(3, 9)],  # too late, too late, in time, again
             ["{broken", doc(6, 20)],                        # the 13th
             [doc(7, 9), doc(8, 13), doc(9, 14)]]            # settled, reached, in time
    seen = []
    for wave in waves:
        land(spark, f"{root}/in", wave)
        ingest.settle(spark, f"{root}/in", f"{root}/out", f"{root}/cp", "R").awaitTermination()
        out = spark.read.schema("obs_date date, n bigint").parquet(f"{root}/out").collect()
        seen.append({r["obs_date"].day: r["n"] for r in out})
        assert len(seen[-1]) == len(out)
    assert seen == [{1: 2}, {1: 2}, {1: 2, 3: 1, 9: 1}, {1: 2, 3: 1, 9: 1}]


def test_refiled_and_broken_documents(spark, tmp_path):
    root = str(tmp_path)
    os.makedirs(f"{root}/in")

    def land(name, *lines):
        with open(f"{root}/in/{name}", "w") as f:
            f.write("\n".join(lines) + "\n")
        ingest.ingest(spark, f"{root}/in", f"{root}/store", f"{root}/cp", "R", 1).awaitTermination()

    doc = '{{"subId": {0}, "obsDt": "2024-01-05 07:00", "obs": [{1}]}}'
    seen = lambda *codes: ", ".join('{"speciesCode": "%s"}' % c for c in codes)
    land("a.json", doc.format('"s1"', seen("a")))
    land("b.json", doc.format('"s1"', seen("a", "b")), doc.format('"s2"', seen("c")),
         doc.format("null", seen("d")), "{broken")
    land("c.json", "{broken", doc.format('"s2"', seen("x")))
    rows = lambda t: spark.read.parquet(f"{root}/store/{t}")
    assert {(r.sub_id, r.richness) for r in rows("checklists").collect()} == {("s1", 1), ("s2", 1)}
    assert {(r.sub_id, r.species_code) for r in rows("observations").collect()} == {
        ("s1", "a"), ("s2", "c")}
    assert rows("rejects").count() == 3


def test_known_outings_go_before_documents_are_compared(spark):
    rows = [(doc(1, n=1), "2024-01-02"), (doc(1, n=2), "2024-01-01"), (doc(2), "2024-01-01"),
            (doc(2, n=1), "2024-01-03"), ('{"locId":"L"}', "2024-01-01")]
    raw = spark.createDataFrame(rows, "json string, at string").selectExpr(
        "json", "timestamp(at) as landed", "'f' as file", "cast(null as string) as raw")
    batch = documents.parse(raw, "json", documents.CHECKLIST_DOC)
    known = spark.createDataFrame([("s2",)], "sub_id string")
    assert [(r["sub_id"], len(r["doc"]["obs"])) for r in ingest.usable(batch, known).collect()] == [("s1", 2)]
    assert sorted(r["sub_id"] for r in ingest.usable(batch).collect()) == ["s1", "s2"]
