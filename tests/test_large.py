"""What only larger tables show: keys beyond the small tables', joins that must not gather in
few tasks, results that must not be shuffled pair by pair."""

import duckdb
import pytest
from pyspark.sql import functions as F

from wayfold.functions import ids, seasonal
from wayfold.operators import objects, places
from wayfold.plans import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def many_parts(spark, tmp_path_factory):
    """A folder with the parts of the smallest tables and some whose change numbers have ten digits."""
    path = str(tmp_path_factory.mktemp("large"))
    part = spark.read.parquet(f"{FOLDER}/part.parquet")
    more = part.limit(20).withColumn("p_partkey", (part["p_partkey"] + 1_100_000).cast(part.schema["p_partkey"].dataType))
    part.unionByName(more).write.parquet(f"{path}/part.parquet")
    return path


@pytest.mark.parametrize("name", ["change_urls", "sequence_path"])
def test_numbers_of_ten_digits_are_as_in_the_twin(spark, many_parts, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{many_parts}/part.parquet/*.parquet'")
    got = catalog.QUERIES[name](spark, many_parts)
    columns = ", ".join(got.columns)
    want = con.execute(f"SELECT {columns} FROM ({catalog.ORACLE_SQL[name]})").fetchall()
    assert len(want) == 220 and sorted(map(tuple, got.collect())) == sorted(want)


def test_the_operator_still_refuses_such_numbers(spark):
    with pytest.raises(Exception, match="not a replication sequence number"):
        spark.range(1).select(ids.sequence_path(F.col("id") + 1_000_000_000)).collect()


def test_joins_by_distance_are_dealt_by_their_pairs(spark):
    """27 million pairs from few bytes: Spark would gather them in one task."""
    some = spark.range(3000).select(F.concat(F.lit("node/"), "id").alias("id"), (59.3 + F.col("id") / 1e6).alias("lat"), F.lit(18.0).alias("lon"))
    points = spark.range(2000).select(F.col("id").alias("query_id"), F.lit(59.3).alias("at_lat"), (18.0 + F.col("id") / 1e7).alias("at_lon"))
    assert 10 <= places.near_points(some, points, 5_000).rdd.getNumPartitions() <= 20


def clusters(spark, n):
    """Places in clusters of four, some silent, with names that agree or not."""
    k = F.col("id")
    flag = lambda m: F.when(k % m == 1, True).when(k % m == 2, False)
    tags = F.struct(flag(4).alias("leash_required"), flag(6).alias("fenced"), flag(7).alias("lit"), F.when(k % 3 == 0, "gravel").alias("surface"))
    name = F.when(k % 5 == 1, "Park A").when(k % 5 == 2, " park a ").when(k % 5 == 3, "Beach")
    season = F.when(k % 11 < 3, F.struct(F.lit("unparsed").alias("kind"), F.lit(None).alias("from"), F.lit(None).alias("to")).cast(seasonal.RULE_TYPE))
    rows = spark.range(n).select(
        F.concat(F.element_at(F.array(F.lit("node/"), F.lit("way/"), F.lit("relation/")), (k % 3 + 1).cast("int")), k).alias("id"), F.lit("dog_park").alias("kind"), name.alias("name"),
        (59 + (F.floor(k / 4) * 7919 % 1000) / 2e5 + (k % 4) * 0.00015).alias("lat"), (18 + (F.floor(k / 4) * 104729 % 1000) / 1e5).alias("lon"),
        tags.alias("tags"), F.lit("designated").alias("provenance"), season.alias("seasonal"))
    return rows.select(*places.COLUMNS)


def test_expanding_is_collapse_of_each_result_set(spark):
    """Areas just outside a circle, beside nodes just inside, decide who stays and who adopts."""
    some = clusters(spark, 400)
    points = spark.range(60).select(F.col("id").alias("query_id"), (59 + (F.col("id") * 613 % 1000) / 2e5).alias("at_lat"), (18 + (F.col("id") * 331 % 1000) / 1e5).alias("at_lon"))
    got = places.expanding(some, points, "dog_park", [60, 150], 3)
    found = {(r.query_id, r.searched_radius_m): r.n for r in places.expanding_counts(some, points, "dog_park", [60, 150], 3).collect()}
    want = []
    for radius in (60, 150):
        asked = points.where(F.col("query_id").isin([q for q, r in found if r == radius]))
        near = places.near_points(some, asked, float(radius)).withColumn("searched_radius_m", F.lit(radius))
        want += places.collapse(near.select(*got.columns), ["query_id"]).collect()
    rows = got.collect()
    assert sorted(rows, key=repr) == sorted(want, key=repr) and len(rows) > 60
    assert sum(found.values()) == len(rows) and {r for _, r in found} == {60, 150}


def test_rows_of_expanding_are_not_moved(spark):
    points = spark.createDataFrame([(1, 59.0, 18.0)], "query_id long, at_lat double, at_lon double")
    rows = places.expanding(clusters(spark, 400), points, "dog_park", [60, 150], 3).select("query_id", "searched_radius_m", "id")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Join Inner") <= 2


def broken_state(spark):
    """Ways over nodes of which every fifth is missing."""
    none = lambda t: F.lit(None).cast(t).alias
    rest = [F.lit(1).alias("version"), none("timestamp")("ts"), F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon")]
    tail = [none("array<struct<type:string,ref:bigint,role:string>>")("members"), none("map<string,string>")("tags")]
    ways = spark.range(40).select(F.lit("way").alias("type"), "id", *rest, F.array(F.col("id"), F.col("id"), F.col("id") + 1).alias("refs"), *tail)
    return ways.unionByName(spark.range(41).where("id % 5 <> 0").select(F.lit("node").alias("type"), "id", *rest, none("array<bigint>")("refs"), *tail))


def test_only_missing_references_are_made_distinct(spark):
    gone = objects.missing_references(broken_state(spark))
    plan = gone._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and plan.index("Aggregate") < plan.index("Join LeftAnti")
    assert sorted((r.child_id, r.parent_id) for r in gone.collect()) == sorted({(c, w) for w in range(40) for c in (w, w + 1) if c % 5 == 0})


def test_a_repair_looks_for_broken_parents_once_a_pass(spark):
    """A source without any of them leaves the state unwritten; known parents aren't looked for again."""
    state, cuts = broken_state(spark), []
    cut = lambda df: cuts.append(df.columns) or df
    same, report = objects.repair(state, state.limit(0), F.lit(True), budget=16, cut=cut)
    assert report == {"passes": 1, "fetched": 0, "gone": 16} and cuts == [["type", "id"]] and same is state
    broken = objects.incomplete_parents(objects.missing_references(state))
    cuts.clear()
    assert objects.repair(state, state.limit(0), F.lit(True), budget=16, cut=cut, broken=broken)[1] == report and not cuts
    with pytest.raises(ValueError, match="more than 15"):
        objects.repair(state, state.limit(0), F.lit(True), budget=15, broken=broken)
    whole = spark.range(41).select(F.lit("node").alias("type"), "id").join(state.where("type = 'node'").limit(1).drop("type", "id"))
    fixed, report = objects.repair(state, state.where("type = 'way'").unionByName(whole), F.lit(True), budget=16)
    assert report == {"passes": 1, "fetched": 16, "gone": 0} and objects.missing_references(fixed).count() == 0
