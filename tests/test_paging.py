"""Paging by the last row and by stored ranges, with NULLs, ties and pages behind the end."""

import random

from portolan.operators import search


def sort_key(order):
    def part(value, up):
        low = (value is not None, value if value is not None else 0)
        return low if up else (value is None, -value if value is not None else 0)

    return lambda r: tuple(part(r[c], up) for c, up in order)


def rows_of(n):
    draw = random.Random(n)
    return [{"a": draw.choice([None, 1, 2, 3]), "b": draw.choice([None, 5, 6]), "id": i} for i in draw.sample(range(1000), n)]


def test_walking_by_the_last_row(spark):
    rows = rows_of(120)
    df = spark.createDataFrame(rows, "a int, b int, id int").repartition(3)
    for order in ([("a", False), ("b", True), ("id", False)], [("a", True), ("id", True)], [("id", False)]):
        want = sorted(rows, key=sort_key(order))
        at, seen = want[0], want[:1]
        while page := [r.asDict() for r in search.rows_after(df, order, at, 37).collect()]:
            seen += page
            at = page[-1]
        assert seen == want


def test_pages_of_a_stored_order(spark, tmp_path):
    rows, order = rows_of(500), [("a", False), ("b", True), ("id", True)]
    path = str(tmp_path / "index")
    search.write_page_index(spark.createDataFrame(rows, "a int, b int, id int").repartition(4), order, path)
    want = sorted(rows, key=sort_key(order))
    for page in (1, 2, 13, 25, 26, 999):
        first = (min(page, 25) - 1) * 20
        assert [r.asDict() for r in search.page_of_index(spark, path, page, 20).collect()] == want[first : first + 20]
    plan = search.page_of_index(spark, path, 25, 20)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(_range," in plan.split("PushedFilters")[1]
    none = str(tmp_path / "none")
    search.write_page_index(spark.createDataFrame([], "a int, b int, id int"), order, none)
    assert search.page_of_index(spark, none, 1, 20).count() == 0


def test_a_page_reads_its_rows_once(spark, tmp_path):
    from pyspark.sql import functions as F

    from portolan.operators.search import paginate

    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.range(60).repartition(4).mapInArrow(count, "id long")
    assert [r.id for r in paginate(rows, [F.asc("id")], 2, 25).collect()] == list(range(25, 50))
    assert seen.value == 60
    assert [r.id for r in paginate(rows, [F.asc("id")], 9, 25).collect()] == list(range(50, 60))
    assert paginate(rows.filter("id < 0"), [F.asc("id")], 3, 25).collect() == []
