from graphloom.sources.star_schema import load

SF = "/root/testdata/sf0.001"


def test_pages_of_a_written_table_run_the_query_once(spark):
    q = load(spark, SF).query().from_("Supplier", "s").traverse("supplies", "e").to("Part", "p").select({"supplier": ("s", "id"), "part": ("p", "id")}).order_by("s", "id")
    table = q.written()
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan
    a = b = None
    for _ in range(3):
        a, b = q.paginate(first=7, after=a and a.end_cursor), q.paginate(first=7, after=b and b.end_cursor, of=table)
        assert a == b and len(b.data) == 7
    assert q.paginate(last=7, before=a.start_cursor).data == q.paginate(last=7, before=b.start_cursor, of=table).data
