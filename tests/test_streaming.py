from stowline.streaming.arrivals import classify_arrivals


def test_arriving_manifests_are_scoped_and_classified(spark, inventory, tmp_path):
    folder = str(tmp_path / "in")
    inventory([("a.jpg", ""), (".h", ""), ("logs/x", "")]).write.parquet(folder)
    stream = classify_arrivals(spark, folder, "path string, rel_path string, size bigint")
    query = (stream.writeStream.format("memory").queryName("arrived").outputMode("append")
             .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start())
    query.awaitTermination()
    assert [(r.name, r.category) for r in spark.table("arrived").collect()] == [("a.jpg", "Images")]
