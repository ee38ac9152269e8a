import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from storyloom.streaming.stories import ARTICLE, EDGE, StoryFeed

T0 = datetime(2024, 1, 1)


def corpus():
    rng = random.Random(3)
    rows = [(f"x{i:02}", T0 + timedelta(hours=rng.randrange(80)), rng.choice("abcdef"), rng.choice(("rumor", "rumor", "injury")), rng.choice(("football", "unknown"))) for i in range(60)]
    edges = list({tuple(sorted(rng.sample([r[0] for r in rows[k : k + 6]], 2))) for k in range(0, 60, 6) for _ in range(7)})
    return rows, [(a, b, rng.random() < 0.3) for a, b in edges]


def matcher(spark, edges):
    every = spark.createDataFrame(edges, EDGE)

    def match(new, known):
        known = known.select("article_id")
        both = every.join(known.withColumnRenamed("article_id", "a_id"), "a_id", "left_semi").join(known.withColumnRenamed("article_id", "b_id"), "b_id", "left_semi")
        fresh = new.select("article_id", F.lit(True).alias("new"))
        one = fresh.select(F.col("article_id").alias("a_id"), F.col("new").alias("new_a"))
        two = fresh.select(F.col("article_id").alias("b_id"), F.col("new").alias("new_b"))
        return both.join(one, "a_id", "left").join(two, "b_id", "left").filter("new_a OR new_b").select("a_id", "b_id", "intra")

    return match


def told(feed):
    out, ids = {}, {}
    for r in feed.stories().collect():
        out.setdefault(r.story, set()).add(r.article_id)
        ids[r.story] = r.cluster_id
    return out, ids


def run(spark, tmp_path, name, batches, edges):
    feed = StoryFeed(spark, f"file://{tmp_path}/{name}", matcher(spark, edges))
    for n, rows in enumerate(batches):
        feed.add(spark.createDataFrame(rows, ARTICLE), n)
    return feed


def test_any_cut_in_any_order_gives_the_result_of_one_batch(spark, tmp_path):
    rows, edges = corpus()
    want, _ = told(run(spark, tmp_path, "one", [rows], edges))
    assert len(want) > 4
    mixed = random.Random(1).sample(rows, len(rows))
    feed = run(spark, tmp_path, "three", [mixed[:25], mixed[25:50], mixed[50:] + mixed[:5]], edges)
    before = told(feed)
    assert before[0] == want
    # A batch that runs again changes nothing, not even an id.
    feed.add(spark.createDataFrame(mixed[50:] + mixed[:5], ARTICLE), 2)
    assert told(feed) == before


def test_late_member_joins_its_cluster_and_the_id_stays(spark, tmp_path):
    row = lambda i, h, s: (i, T0 + timedelta(hours=h), s, "rumor", "unknown")
    edges = [("b", "c", False), ("a", "b", False), ("y", "z", False)]
    feed = run(spark, tmp_path, "late", [[row("b", 5, "p"), row("c", 6, "q")], [row("y", 1, "p"), row("z", 2, "q")]], edges)
    first, ids = told(feed)
    assert first == {"b": {"b", "c"}, "y": {"y", "z"}}
    feed.add(spark.createDataFrame([row("a", 1, "r")], ARTICLE), 2)
    now, after = told(feed)
    # The late article is the earliest, so the story starts at it; its first edge leaves c out unless c matches it, too.
    assert now == {"a": {"a", "b"}, "y": {"y", "z"}} and after["a"] == ids["b"] and after["y"] == ids["y"]


def test_follows_a_stream(spark, tmp_path):
    rows, edges = corpus()
    want, _ = told(run(spark, tmp_path, "all", [rows], edges))
    for k in range(2):
        spark.createDataFrame(rows[k::2], ARTICLE).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/landed")
    feed = StoryFeed(spark, f"file://{tmp_path}/stream", matcher(spark, edges))
    stream = spark.readStream.schema(ARTICLE).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/landed")
    feed.follow(stream, f"file://{tmp_path}/checkpoint").awaitTermination()
    assert told(feed)[0] == want
