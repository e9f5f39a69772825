from pyspark.sql import functions as F

from tallyspark.functions.text import like_term
from tallyspark.operators.search import candidates, search, term_grams, write_index


def test_search_by_postings_equals_a_scan(spark, tmp_path):
    words = ["Café Market", "UBER *TRIP 22", "a_b%c", "", None, "xx", "Monoprix\\Tunis", "Straße", "market", "İzmir market"]
    rows = spark.createDataFrame([(i % 3, i, words[i % 10], words[(i * 7 + 3) % 10]) for i in range(300)], "org long, id long, name string, note string")
    columns = {"name": F.col("name"), "note": F.col("note")}
    path = str(tmp_path / "index")
    write_index(rows, columns, path)
    for term in ("market", "MARK", "uber *trip", "a_b", "k_t", "ma%et", "%", "xx", "é m", "x\\t", "straße", "nothing here", "ber", "trip_22"):
        for org in (0, 1, 7):
            want = rows.where(F.col("org") == org).where(like_term(F.coalesce("name", F.lit("")), term) | like_term(F.coalesce("note", F.lit("")), term))
            assert sorted(r.id for r in search(rows, columns, path, org, term).collect()) == sorted(r.id for r in want.collect()), (term, org)
    assert term_grams("ma%ket") == ["ket"] and term_grams("a_b") == [] and candidates(spark, path, 1, "ab") is None
    plan = candidates(spark, path, 1, "market")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(org" in plan and "PushedFilters: [In(gram" in plan
