import ast

from pyspark.sql import functions as F

from tessera.functions.flow import BUDGET, charts_of, flowcharts, in_words, said
from tessera.operators.sequence import accepted
from tessera.streaming.limits import accepted_stream, daily_counts, upsert

CODE = '''
def f(xs):
    """Doc."""
    total = 0
    for x in xs:
        if x == 0:
            continue
        elif x < 0:
            break
        total += x
    while True:
        if total > 9:
            return total
        total = g(total)
    print("never")
class A:
    def m(self, k):
        match k:
            case 1: a()
            case _: b()
        try:
            c()
        except ValueError:
            raise
        finally:
            d()
'''


def chart(name):
    return dict(charts_of(CODE))[name]


def test_chart_of_loops():
    c = chart("f")
    kinds = [b["kind"] for b in c.boxes]
    assert kinds == ["start", "action", "loop", "decision", "decision", "action", "loop", "decision", "return", "action", "end"]
    edges = {(e["source"], e["target"], e["label"]) for e in c.edges}
    assert {(2, 3, "yes"), (3, 2, "yes"), (3, 4, "no"), (4, 6, "yes"), (5, 2, ""), (2, 6, "no more"), (7, 8, "yes"), (9, 6, ""), (8, 10, "")} <= edges
    assert not any("never" in b["label"] for b in c.boxes)
    assert c.mermaid().startswith("flowchart TD\n  n0([")


def test_chart_of_match_and_try():
    c = chart("A.m")
    labels = [e["label"] for e in c.edges]
    assert "1" in labels and "other" in labels and "if error" in labels and "error" in labels
    assert [b["kind"] for b in c.boxes].count("stop") == 1


def test_budget():
    text = "def f(a):\n" + "".join(f"    if a == {i}:\n        g({i})\n" for i in range(100))
    c = dict(charts_of(text))["f"]
    assert len(c.boxes) <= BUDGET + 2 and c.boxes[-2]["kind"] == "folded"


def test_words():
    e = lambda s: ast.parse(s, mode="eval").body
    assert in_words(e("b == 0")) == "b equals 0" and in_words(e("a < 1 and not x")) == "a is less than 1 and not (x)"
    one = lambda s: said(ast.parse(s).body[0])
    assert one("n += 1") == "Add 1 to n." and one("x = input()") == "Ask the user and keep the answer in x." and one("print(a)") == "Show a." and one("go(1)") == "Run go() with 1."


def test_charts_in_spark(spark):
    got = flowcharts(spark.createDataFrame([("a.py", "python", CODE.encode()), ("b.py", "python", b"def (:"), ("c.c", "c", b"")], "path string, language string, content binary")).collect()
    assert sorted(r.function for r in got) == ["A.m", "f"]


def requests(spark):
    return spark.range(200).select((F.col("id") % 7).cast("string").alias("key"), (F.col("id") * 13 % 400).alias("s"), "id")


def test_accepted_in_batch_and_stream(spark, tmp_path):
    rows = requests(spark)
    want = {(r.id, r.ok) for r in accepted(rows, "key", ["s", "id"], "s", 3, 60).collect()}
    for k in range(4):  # in order of time, as a stream brings them
        rows.where((F.col("s") >= 100 * k) & (F.col("s") < 100 * k + 100)).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = accepted_stream(stream, 3, 60).writeStream.format("memory").queryName("accepted").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.id, r.ok) for r in spark.table("accepted").collect()}
    assert got == want


def test_daily_counts(spark, tmp_path):
    rows = spark.sql("SELECT timestamp'2024-01-01' + make_interval(0,0,0,0,cast(id AS int)) AS ts, concat('p', id % 2) AS provider FROM range(60)")
    rows.write.parquet(f"{tmp_path}/in")
    q = daily_counts(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")).writeStream.outputMode("complete").format("memory").queryName("daily").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.day, r.provider): r.n for r in spark.table("daily").collect()} == {("2024-01-01", "p0"): 12, ("2024-01-01", "p1"): 12, ("2024-01-02", "p0"): 12, ("2024-01-02", "p1"): 12, ("2024-01-03", "p0"): 6, ("2024-01-03", "p1"): 6}


def test_upsert(spark, tmp_path):
    run = upsert(str(tmp_path), "k", "v")
    run(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), 0)
    for _ in range(2):  # a batch may be run again
        run(spark.createDataFrame([(2, "c"), (3, "d"), (1, "a")], "k int, v string"), 1)
    assert {(r.k, r.v) for r in spark.read.parquet(f"{tmp_path}/1").collect()} == {(1, "a"), (2, "c"), (3, "d")}
