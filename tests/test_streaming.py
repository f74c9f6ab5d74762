import random

from tesserae.streaming.tracks import running_scores, step, track_status, windowed_counts
from tests.conftest import SF


def batch_twin(rows):
    out = {}
    for v in {r[0] for r in rows}:
        state = 0, 0, False
        for _, f, hit in sorted(r for r in rows if r[0] == v and r[1] >= 0):
            state = step(*state, hit, -4, 8, 3)
            out[v, f] = state[0], state[2]
    return out


def test_status_equals_its_batch_twin(spark, tmp_path):
    r = random.Random(1)
    rows = [(v, f, r.random() < 0.7) for v in range(4) for f in range(25)]
    files = []
    for k in range(5):  # in frame order, a few frames swapped
        part = [x for x in rows if x[1] // 5 == k]
        r.shuffle(part)
        files.append(part)
    files.append([(v, -1, False) for v in range(4)])
    for k, part in enumerate(files):
        spark.createDataFrame(part, "video long, frame long, hit boolean").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema("video long, frame long, hit boolean").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = track_status(stream).writeStream.format("memory").queryName("status").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {(x.video, x.frame): (x.counter, x.confirmed) for x in spark.table("status").collect()}
    assert got == batch_twin(rows)


def test_streaming_aggregates_equal_batch(spark, tmp_path):
    batch = spark.read.parquet(f"{SF}/events.parquet")
    batch.repartition(3).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "e"))
    for name, f in (("scores", running_scores), ("windows", windowed_counts)):
        q = f(stream).writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        rounded = lambda d: sorted(tuple(str(round(x, 6) if isinstance(x, float) else x) for x in r) for r in d.collect())
        assert rounded(spark.table(name)) == rounded(f(batch))
