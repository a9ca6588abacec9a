"""Odd inputs and sizes of the third round's findings."""

import os

import pytest
from pyspark.sql import functions as F

from tessera.functions import answers as A


def test_code_language_as_sql_on_letters_of_all_scripts(spark):
    """A keyword beside a letter outside ASCII, a vertical tab, and lines that end in other signs than \\n."""
    import duckdb

    odd = ["éfunction a", "functioné x", "x: numberé", "x:\x0bnumber", "public\x0bclass", "int\x0bmain(", "éint main (", "const\u0301 x", "日本const 本", "function a\rdef f", "function\u2028import x", "let a\u0085 class B:", "a\ndef f", "", None]
    sql = f"""SELECT i, CASE WHEN regexp_matches(c, '{A.CODE_LANGUAGES[0][1]}') OR (regexp_matches(c, '{A.C_MAIN}') AND NOT contains(c, 'public')) THEN 'c'
{' '.join(f"WHEN regexp_matches(c, '{x}') THEN '{n}'" for n, x in A.CODE_LANGUAGES[1:])} ELSE 'python' END AS l FROM t ORDER BY i"""
    con = duckdb.connect()
    con.execute("CREATE TABLE t (i INT, c VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(odd)))
    got = spark.createDataFrame(list(enumerate(odd)), "i int, c string").select("i", A.code_language(F.col("c")).alias("l")).orderBy("i").collect()
    assert [tuple(r) for r in got] == con.execute(sql).fetchall()


SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_tasks_grow_with_the_files_read(spark):
    """What a task groups is set by the files' size, not by the number of cores; a walk knows the size of what it wrote."""
    from tessera.plans import graphs
    from tessera.session import cut, dealt, drop, read_mb, table

    item = table(spark, SF, "lineitem").select("l_orderkey")
    cores = spark.sparkContext.defaultParallelism
    mb = read_mb(item)
    assert dealt(item, "l_orderkey").rdd.getNumPartitions() == cores and dealt(item, "l_orderkey", mb=mb / (3 * cores)).rdd.getNumPartitions() in (3 * cores, 3 * cores + 1)
    assert "REPARTITION_BY_NUM" in graphs.QUERIES["graph_edges_merged"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    written = cut(item)
    assert 0 < read_mb(written) < 10 and written.count() == item.count()
    folder = written.inputFiles()[0].rpartition("/")[0].removeprefix("file://")
    drop(written)
    assert not os.path.exists(folder)


def test_columnar_pack_in_blocks(spark):
    from tessera.operators.report import columnar_pack

    ids = [f"n{i:02}" for i in range(11)]
    ends = sorted({(i * 7 % 11, i * 5 % 11) for i in range(40)} | {(3, j) for j in range(11)})
    nodes = spark.createDataFrame([(i,) for i in ids], "id string")
    edges = spark.createDataFrame([(ids[a], ids[b], "calls") for a, b in ends] + [(ids[0], ids[1], "contains")], "source string, target string, type string")
    got = columnar_pack(nodes, edges, 4).orderBy("block").collect()
    assert all(len(r.ids) <= 4 and len(r.calls) <= 8 for r in got)
    assert [x for r in got for x in r.ids] == ids and [x for r in got for x in r.calls] == [x for pair in ends for x in pair]
    (one,) = columnar_pack(nodes, edges).collect()
    assert one.ids == ids and one.calls == [x for pair in ends for x in pair]
    (none,) = columnar_pack(nodes, edges.limit(0)).collect()
    assert none.calls == []


def test_charts_of_copies_and_tasks_of_one_split(spark):
    """Copies have the chart of their text, over more files than become rows at once, and a file of one split is dealt to all cores."""
    from tessera.functions.flow import SLICE, flowcharts
    from tessera.session import spread, table

    texts = ["int f(int a) {" + "\n if (a) { g(a); }" * k + "\n return a;\n}" for k in range(5)] + ["no function"]
    rows = [(str(i), "c", texts[i % 6].encode()) for i in range(2 * SLICE + 7)]
    got = flowcharts(spark.createDataFrame(rows, "path string, language string, content binary").coalesce(1)).select("path", F.size("boxes").alias("n"), F.col("boxes")[0]["label"].alias("label")).collect()
    want = {p: 3 + 2 * (int(p) % 6) for p, _, _ in rows if int(p) % 6 < 5}
    assert {r.path: r.n for r in got} == want and len(got) == len(want) and {r.label for r in got} == {"start: f(a)"}
    part = table(spark, SF, "part").select("p_partkey")
    assert part.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism == spread(part, "p_partkey").rdd.getNumPartitions()


def test_walks_from_tests_against_brute_force(spark):
    """A cyclic graph in which tests call tests: the walk from all tests says of each node what the walks from each node do."""
    import random

    from tessera.operators import graph as G

    r = random.Random(5)
    ids = [f"n{i:02}" for i in range(40)]
    pairs = sorted({(r.choice(ids), r.choice(ids)) for _ in range(70)})
    tests, origins = set(ids[::6]), [i for k, i in enumerate(ids) if k % 6]
    up: dict[str, set] = {}
    for a, b in pairs:
        up.setdefault(b, set()).add(a)

    def reaching(origin, depth):
        seen, front, found = {origin}, {origin}, set()
        for _ in range(depth):
            step = {a for b in front for a in up.get(b, ())} - seen
            found |= step & tests
            front, seen = step - tests, seen | step
        return found

    edges = spark.createDataFrame([(a, b, "calls", "high" if len(a + b) % 2 else "medium") for a, b in pairs], "source string, target string, type string, confidence string")
    of = lambda names: spark.createDataFrame([(n,) for n in names], "id string")
    for depth in (2, 6):
        got = {(x.origin, x.test) for x in G.tests_reaching(edges, of(origins), of(tests), depth, 3).collect()}
        assert got == {(o, t) for o in origins for t in sorted(reaching(o, depth))[:3]}
        affected, tested = G.ripple_and_tested(edges, of(origins[:2]), of(tests), 3, depth)
        assert {x.id for x in tested.collect()} & set(origins) == {o for o in origins if reaching(o, depth)}
        assert sorted(affected.collect()) == sorted(G.ripple(edges, of(origins[:2]), 3, of(tests)).collect())


def test_greedy_batches_of_one_long_key(spark):
    """60,000 rows of one key take time in proportion; a null weight takes no part until the next batch."""
    import time

    from tessera.operators.sequence import greedy_batches

    rows = spark.range(60_000).select(F.lit("k").alias("k"), F.col("id"), F.when(F.col("id") % 10 != 3, F.col("id") * 7919 % 900).alias("w"))
    began = time.time()
    got = [r.batch for r in greedy_batches(rows, "k", "id", "w", 2000, 10).orderBy("id").collect()]
    assert time.time() - began < 40
    want, batch, w, n = [], 0, 0, 0
    for i in range(60_000):
        x = i * 7919 % 900 if i % 10 != 3 else None
        if n and (n >= 10 or (w is not None and x is not None and w + x > 2000)):
            batch, w, n = batch + 1, x, 1
        else:
            w, n = None if w is None or x is None else w + x, n + 1
        want.append(batch)
    assert got == want


@pytest.mark.parametrize("raw", [False, True])
def test_terms_counted_in_one_pass(spark, raw):
    """Of chunks that share an id, are null or hold odd letters: frequencies of all, counts of those that the question meets, as the text functions say; and nothing else leaves."""
    from collections import Counter

    from tessera.functions.text import tokens, tokens_raw
    from tessera.operators.search import counted

    rows = [(1, "loadedOrders order_items HTTPServer KKelvin"), (1, "orders loaded again"), (2, None), (3, ""), (4, "İstanbul straße x_y__z the classes"), (5, "one oneTwo ONE_two 12ab buses"), (None, "orders"), (None, "order")]
    chunks = spark.createDataFrame(rows, "id long, text string")
    each = chunks.select("id", F.explode((tokens_raw if raw else tokens)(F.col("text"))).alias("t")).collect()
    of: dict = {}
    for r in each:
        of.setdefault(r.id, Counter())[r.t] += 1
    df, docs = counted(chunks, raw, lambda t: t == "order")
    assert {r.term: r.df for r in df.collect()} == Counter(t for c in of.values() for t in c)
    assert {r.id: dict(zip(r.terms, r.tfs, strict=True)) for r in docs.collect()} == {k: dict(c) for k, c in of.items() if "order" in c}
