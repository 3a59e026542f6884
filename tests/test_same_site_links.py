import __spark_entry__ as entry


def test_same_site_links_after_many_others_count(spark, tmp_path):
    other = " ".join(f"[x](https://other.example/{i})" for i in range(35))
    own = " ".join(f"[y](https://h.example/{i})" for i in range(33))
    rows = [(1, "https://h.example/a", f"{other} {own} [y](https://h.example/0)"), (2, "https://h.example/b", other), (3, None, own)]
    spark.createDataFrame(rows, "item_id int, url string, markdown string").write.parquet(f"{tmp_path}/article_items.parquet")
    assert [tuple(r) for r in entry.queries()["same_site_links"](spark, str(tmp_path)).collect()] == [(1, 33)]
