from tandemlake.streaming import hits


def test_new_files_are_appended_once(spark, tmp_path):
    source, table, state = (str(tmp_path / x) for x in ("in", "table", "state"))
    (tmp_path / "in").mkdir()
    line = "q\tchr1\t98.5\t10\t12\t1\t10\t{}\t{}\t1e-12\t50\n"
    (tmp_path / "in" / "a.tsv").write_text(line.format(30, 21) + line.format(1, 5))
    hits.append(spark, source, table, state).awaitTermination()
    (tmp_path / "in" / "b.tsv").write_text(line.format(50, 60) + "short\n")
    for _ in range(2):
        hits.append(spark, source, table, state).awaitTermination()
    found = sorted((r.Start, r.End, r.Strand) for r in spark.read.parquet(table).collect())
    assert found == [(1, 5, "+"), (21, 30, "-"), (50, 60, "+")]
    query = hits.running_totals(spark, source).writeStream.format("memory").queryName("totals").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert [tuple(r) for r in spark.sql("select * from totals").collect()] == [("q", 3, 26)]
