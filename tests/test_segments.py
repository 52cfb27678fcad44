import random

from pyspark.sql import functions as F

from pressloom.functions import segments
from pressloom.sources.landed import cues_of


def plainly(cues):
    out, buffer, start, size = [], [], None, 0
    for t, text in cues:
        if buffer and size + len(text) + 1 > segments.MOST:
            out.append([start, " ".join(buffer)])
            buffer, start, size = [], None, 0
        start = t if start is None else start
        buffer.append(text)
        size += len(text) + 1
        if size >= segments.TARGET and text.rstrip().rstrip("'\"»)")[-1:] in ".!?…":
            out.append([start, " ".join(buffer)])
            buffer, start, size = [], None, 0
    if buffer:
        out.append([start, " ".join(buffer)])
    if len(out) > 1 and len(out[-1][1]) < segments.TAIL:
        tail = out.pop()
        out[-1][1] += " " + tail[1]
    return out


def cases():
    rng = random.Random(1)
    yield []
    yield [(0.0, "short")]
    yield [(0.0, "x" * 3000), (1.0, "y.")]
    yield [(0.0, "x" * 2050 + "."), (1.0, "y" * 298)]
    yield [(0.0, "x" * 2050 + "."), (1.0, "y" * 299)]
    yield [(0.0, "x" * 2050 + "."), (1.0, "y" * 300)]
    for _ in range(30):
        yield [(float(i), "w" * rng.randrange(1, 280) + rng.choice(["", ".", "!", '?"', ","])) for i in range(rng.randrange(1, 60))]


def test_segments_equal_a_plain_loop(spark):
    rows = [(i, [{"t": t, "text": x} for t, x in c]) for i, c in enumerate(cases())]
    df = spark.createDataFrame(rows, "i int, cues array<struct<t: double, text: string>>")
    got = {r["i"]: [[s["start"], s["text"]] for s in r["s"]] for r in df.select("i", segments.segments(F.col("cues")).alias("s")).collect()}
    for i, c in enumerate(cases()):
        assert got[i] == plainly(c), i


def test_rows_of_segments(spark):
    df = spark.createDataFrame([("https://x.org/watch?v=1", " A title ", [{"t": 3.7, "text": "a" * 2100 + "."}, {"t": 9.2, "text": "b" * 400}])], "url string, title string, cues array<struct<t: double, text: string>>")
    rows = segments.segment_rows(df).orderBy("segment").collect()
    assert [(r["url"], r["title"], len(r["content"])) for r in rows] == [("https://x.org/watch?v=1&t=3s", "A title [1/2]", 2101), ("https://x.org/watch?v=1&t=9s", "A title [2/2]", 400)]


def test_cues(spark):
    rows = [("v", 0, 0.0, "a"), ("v", 1, 1.0, "a"), ("v", 2, 2.0, " "), ("v", 3, 3.0, "b\nc"), ("v", 4, 4.0, "a")]
    clean = segments.clean_cues(spark.createDataFrame(rows, "video string, pos int, t double, text string"))
    assert [x["text"] for x in cues_of(clean).first()["cues"]] == ["a", "b c", "a"]
