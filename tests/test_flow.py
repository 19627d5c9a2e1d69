"""Files, streams and the registered queries."""

import struct
from decimal import Decimal

import pytest
from graphs import DEMO
from pyspark.sql import functions as F

from linktide.operators.dynamics import dwell, excitability_gain, velocity
from linktide.operators.focus import FocusParams, focus
from linktide.operators.graph import adjacency
from linktide.operators.truth import accumulate
from linktide.operators.weights import Context, effective_links
from linktide.sources.link_records import Wanted, commits, file_ranges, register
from linktide.sources.tables import (
    read_context,
    read_focus,
    read_links,
    read_tensors,
    tensor_shapes,
    write_focus,
    write_tensors,
)
from linktide.streaming import epochs
from linktide.streaming.epochs import (
    author_totals,
    finish_epochs,
    focus_state_stream,
    karma_stream,
    merged_adjacency,
    pair_totals,
    read_karma,
    run_epochs,
)


def record(neuron, src, dst, amount, valence, block):
    def hashed(x):
        return bytes([x]) * 32

    return (
        hashed(neuron) + hashed(src) + hashed(dst) + struct.pack("<I", 7)
        + amount.to_bytes(16, "little") + struct.pack("<bQ", valence, block) + b"\0\0\0"
    )


@pytest.fixture
def record_file(tmp_path):
    body = b"".join(record(1, 2, 3, 10**25 + i, (i % 3) - 1, i) for i in range(1000)) + b"partial"
    header = (
        '[file]\ntypes = ["graph"]\nname = "t"\n[[files]]\nname = "readme"\nformat = "md"\n'
        f'[[files]]\nname = "links"\nformat = "records"\nsize = {len(body)}\n'
    )
    path = tmp_path / "links.bin"
    path.write_bytes(header.encode() + b"~~~readme\nhello\n~~~links\n" + body)
    return str(path)


def test_link_records_are_read_in_ranges(spark, record_file):
    register(spark)
    df = spark.read.format("link_records").option("recordsPerTask", 300).load(record_file)
    assert df.rdd.getNumPartitions() == 4
    rows = df.orderBy("block").collect()
    assert len(rows) == 1000
    assert (int(rows[5]["amount"]), rows[5]["valence"], rows[5]["token"]) == (10**25 + 5, 1, 7)
    assert rows[0]["src"] == "02" * 32


def hashed_links(spark, n):
    ids = [F.expr(f"sha2(cast({e} as string), 256)").alias(a) for e, a in (("id % 7", "neuron"), ("id", "src"), ("id % 11", "dst"))]
    return spark.range(0, n, 1, 4).select(
        *ids, (F.col("id") % 3).alias("token"), F.expr("cast(id as decimal(38,0)) * 10000000000000000000000").cast("decimal(38,0)").alias("amount"),
        F.expr("cast(id % 3 - 1 as tinyint)").alias("valence"), F.col("id").alias("block"),
    )


def test_link_records_are_written_and_filtered(spark, tmp_path):
    register(spark)
    folder = f"{tmp_path}/records"
    links = hashed_links(spark, 2000)
    links.write.format("link_records").option("recordsPerFile", 150).mode("append").save(folder)
    read = spark.read.format("link_records").load(folder)
    assert sorted(read.collect()) == sorted(links.collect())
    for rule, options in {
        "block between 700 and 719": {"minBlock": 700, "maxBlock": 719}, "token = 1 and block > 1990": {"tokens": "1", "minBlock": 1991},
        "token in (0, 2) and valence < 1": {"tokens": "0,2", "valences": "-1,0"}, "block > 5000": {"minBlock": 5001},
        "block between 9 and 8": {"minBlock": 9, "maxBlock": 8}, "token = 9": {"tokens": "9"},
    }.items():
        part = spark.read.format("link_records").options(**options).load(folder)
        assert sorted(part.collect()) == sorted(links.where(rule).collect()), rule
    one = spark.read.format("link_records").options(minBlock=700, maxBlock=719).load(folder)
    assert one.rdd.getNumPartitions() == 1
    again = one.where("token = 1").unionByName(one.where("token = 2")).unionByName(one.where("token = 0"))
    assert sorted(again.collect()) == sorted(one.collect())
    entry = commits(folder)[0]["files"][0]
    assert entry["sorted"] and entry["rows"] == 150
    first = entry["min_block"]
    (part,) = file_ranges(f"{folder}/{entry['name']}", Wanted(first + 10, first + 20), 1000, None, True)
    assert part.count == 11
    links.limit(5).write.format("link_records").mode("append").save(folder)
    assert spark.read.format("link_records").load(folder).count() == 2005
    links.limit(0).write.format("link_records").mode("overwrite").save(folder)
    assert spark.read.format("link_records").load(folder).count() == 0
    for bad in ("'x' as src", "cast(null as bigint) as block", "cast(-1 as bigint) as token", "cast(-1 as decimal(38,0)) as amount"):
        name = bad.split()[-1]
        wrong = links.limit(3).drop(name).selectExpr("*", bad)
        with pytest.raises(Exception, match=name):
            wrong.write.format("link_records").mode("append").save(folder)
    assert spark.read.format("link_records").load(folder).count() == 0


def test_link_records_stream_reads_each_commit_once(spark, tmp_path):
    register(spark)
    folder, out = f"{tmp_path}/records", f"{tmp_path}/out"
    links = hashed_links(spark, 300)
    for part, so_far in ((links.where("block < 100"), 100), (links.where("block >= 100"), 300)):
        part.write.format("link_records").mode("append").save(folder)
        stream = spark.readStream.format("link_records").load(folder)
        stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(out).awaitTermination()
        assert spark.read.parquet(out).count() == so_far
    assert sorted(spark.read.parquet(out).collect()) == sorted(links.collect())


def test_link_records_after_a_long_header(spark, tmp_path):
    from linktide.sources.link_records import section_range

    body = record(1, 2, 3, 5, 1, 9)
    header = (
        "# " + "x" * (3 << 20) + '\n[file]\ntypes = ["graph"]\n[[files]]\nname = "links"\nformat = "records"\n'
        f"size = {len(body)}\n"
    )
    path = tmp_path / "long.bin"
    path.write_bytes(header.encode() + b"~~~links\n" + body)
    start, end = section_range(str(path))
    assert end - start == len(body)
    (tmp_path / "none.bin").write_bytes(b"no mark at all")
    with pytest.raises(ValueError, match="no section mark"):
        section_range(str(tmp_path / "none.bin"))


def test_tables_round_trip(spark, tmp_path):
    links = spark.createDataFrame([("a", "x", "y", "T", Decimal(5), 1, 9)], "neuron string, src string, dst string, token string, amount decimal(38,0), valence byte, block long")
    links.write.parquet(f"{tmp_path}/links")
    assert read_links(spark, f"{tmp_path}/links").first()["amount"] == 5
    for name, column in (("karma", "kappa"), ("will", "will")):
        spark.createDataFrame([(1, 2, 0), (1, 3, 1)], f"neuron int, {column} int, epoch int").write.partitionBy("epoch").parquet(f"{tmp_path}/{name}")
    assert read_context(spark, str(tmp_path), 1).karma.first()["kappa"] == 3
    phi = spark.createDataFrame([(1, 0.5)], "id int, focus double")
    for epoch, n in ((0, 1), (1, 1), (1, 2)):
        write_focus(phi.withColumn("n", F.lit(n)), f"{tmp_path}/focus", epoch)
    assert sorted((r["epoch"], r["n"]) for r in read_focus(spark, f"{tmp_path}/focus").collect()) == [(0, 1), (1, 2)]
    rows = spark.createDataFrame(
        [(0, "t", 0, [1.5, -300.0], "u16"), (0, "t", 1, [0.25, 0.1], "u16"), (1, "s", 0, [3.0], "u32")],
        "tensor_no int, tensor string, row bigint, values array<double>, encoding string",
    )
    write_tensors(rows, f"{tmp_path}/tensors")
    back = read_tensors(spark, f"{tmp_path}/tensors").orderBy("tensor_no", "row").collect()
    assert back[0]["values"] == [1.5, -128.0] and back[1]["values"] == [0.25, 26 / 256]
    assert tensor_shapes(rows).count() == 2


def test_epochs_close_and_late_links_move_on(spark, tmp_path):
    schema = "neuron bigint, src bigint, dst bigint, amount bigint, block bigint"

    def put(name, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        q = run_epochs(stream, f"{tmp_path}/out", 10, params=params, steps=2, checkpoint=f"{tmp_path}/cp")
        q.awaitTermination(300)

    params = FocusParams(tau=0.2, krylov_steps=4)
    demo = [(i, a, b, w, 3) for i, (a, b, w) in enumerate(DEMO)]
    put("a", [*demo, (9, 4, 2, 50, 12)])
    run()
    put("b", [(10, 2, 4, 70, 5), (11, 3, 4, 10, 25)])
    run()
    out = spark.read.parquet(f"{tmp_path}/out/focus")
    want = focus(adjacency(effective_links(spark.createDataFrame(demo, schema))), params, steps=2).nodes
    got = {r["id"]: r["focus"] for r in out.where("epoch = 0").collect()}
    assert all(abs(got[r["id"]] - r["focus"]) < 1e-12 for r in want.collect())
    later = spark.createDataFrame([*demo, (9, 4, 2, 50, 12), (10, 2, 4, 70, 5)], schema)
    want = focus(adjacency(effective_links(later)), params, steps=2).nodes
    got = {r["id"]: r["focus"] for r in out.where("epoch = 1").collect()}
    assert all(abs(got[r["id"]] - r["focus"]) < 1e-12 for r in want.collect())
    assert spark.read.parquet(f"{tmp_path}/out/progress").agg(F.sum("late")).first()[0] == 1
    assert out.where("epoch = 2").isEmpty()
    finish_epochs(spark, f"{tmp_path}/out", params=params, steps=2)
    everything = spark.createDataFrame([*demo, (9, 4, 2, 50, 12), (10, 2, 4, 70, 5), (11, 3, 4, 10, 25)], schema)
    want = {r["id"]: r["focus"] for r in focus(adjacency(effective_links(everything)), params, steps=2).nodes.collect()}
    got = {r["id"]: r["focus"] for r in spark.read.parquet(f"{tmp_path}/out/focus").where("epoch = 2").collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-12 for i in want)


def test_merged_totals_give_the_adjacency(spark):
    """Whatever arrives in which epoch, with will shares, karma and prices."""
    rows = [(i % 5, i % 7, i * 3 % 7, 10 + i * i % 90, [0.0, 0.5, 1.0, 1.7][i % 4], i) for i in range(80)]
    links = spark.createDataFrame(rows, "neuron bigint, src bigint, dst bigint, amount bigint, price double, ord int")
    karma = spark.createDataFrame([(0, 0.0), (1, 2.5)], "neuron bigint, kappa double")
    will = spark.createDataFrame([(1, 1000), (2, 50), (9, 7)], "neuron bigint, will bigint")
    pairs = authors = None
    for part in ("ord < 10", "ord >= 10 AND ord < 50", "ord >= 50"):
        p, a = pair_totals(links.where(part)), author_totals(links.where(part))
        pairs, authors = (p, a) if pairs is None else (
            pairs.unionByName(p).groupBy("neuron", "src", "dst").agg(F.sum("weighted").alias("weighted"), F.sum("priced").alias("priced")),
            authors.unionByName(a).groupBy("neuron").agg(F.sum("links").alias("links"), F.max("top").alias("top")))
    for ctx in (Context(), Context(karma=karma, will=will)):
        want = {(r.src, r.dst): r.w for r in adjacency(effective_links(links, ctx)).collect()}
        got = {(r.src, r.dst): r.w for r in merged_adjacency(pairs, authors, ctx).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_token_weights_and_prices_of_a_context(spark, tmp_path):
    rows = [(1, 1, 2, 100, "A"), (1, 2, 3, 100, "B"), (2, 3, 1, 40, "B")]
    links = spark.createDataFrame(rows, "neuron bigint, src bigint, dst bigint, amount bigint, token string")
    for name, table in (
        ("tokens", spark.createDataFrame([("A", 0.5, 1), ("B", 2.0, 1), ("B", 9.0, 2)], "token string, rho double, epoch int")),
        ("prices", spark.createDataFrame([(3, 1, 0.25, 1)], "src bigint, dst bigint, price double, epoch int")),
    ):
        table.write.partitionBy("epoch").parquet(f"{tmp_path}/{name}")
    ctx = read_context(spark, str(tmp_path), 1)
    assert ctx.karma is None and ctx.will is None
    got = {(r.src, r.dst): r.w for r in effective_links(links, ctx).collect()}
    assert got == {(1, 2): 50 / 200, (2, 3): 1.0, (3, 1): 80 / 200 * 0.25}
    with pytest.raises(Exception, match="no weight for token C"):
        effective_links(links.withColumn("token", F.lit("C")), ctx).collect()


def test_streamed_karma_equals_batch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(epochs, "COMPACTED", 2)
    rows = [(i, 9 if i < 9 else i % 3 if i % 2 else 0, ((i * 37) % 19 - 9) / 7) for i in range(120)]
    schema = "ord int, neuron int, score double"
    for part in range(3):
        spark.createDataFrame(rows[part * 40 : part * 40 + 40], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        q = karma_stream(stream, f"{tmp_path}/out", 0.5, checkpoint=f"{tmp_path}/cp")
        q.processAllAvailable()
        q.stop()
    held = lambda name: {(r["batch"], r["neuron"]) for r in spark.read.parquet(f"{tmp_path}/out/{name}").collect()}
    assert (0, 9) in held("ledger") and (2, 9) not in held("ledger") and (1, 9) in held("snapshot")
    want = {r["neuron"]: r["kappa"] for r in accumulate(spark.createDataFrame(rows, schema), 0.5).collect()}
    got = {r["neuron"]: r["kappa"] for r in read_karma(spark, f"{tmp_path}/out").collect()}
    assert set(want) == set(got) and all(abs(want[k] - got[k]) < 1e-9 for k in want)


def test_streamed_focus_state_equals_batch(spark, tmp_path):
    rows = [(e, i, round(((e * 7 + i * 3) % 11) / 40, 3)) for e in range(5) for i in range(6) if (e + i) % 4]
    history = spark.createDataFrame(rows, "epoch int, id bigint, focus double")
    top = dwell(history, 2)
    marked = history.join(top.select("epoch", "id", F.lit(True).alias("in_top")), ["epoch", "id"], "left").fillna(False)
    marked = marked.select("epoch", "id", "focus", F.coalesce("in_top", F.lit(False)).alias("in_top"))
    schema = "epoch int, id bigint, focus double, in_top boolean"
    for e in range(5):
        marked.where(F.col("epoch") == e).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        out = focus_state_stream(stream, 0.3, 0.1, 0.9, 0.2)
        q = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").start()
        q.processAllAvailable()
        q.stop()
    got = {(r["epoch"], r["id"]): r for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert len(got) == len(rows)
    for r in excitability_gain(history, 0.3, 0.1, 0.9, 0.2).join(history.select("epoch", "id"), ["epoch", "id"]).collect():
        mine = got[(r["epoch"], r["id"])]
        assert abs(mine["gain"] - r["gain"]) < 1e-9 and abs(mine["trailing"] - r["trailing"]) < 1e-9
    for r in velocity(history).join(history.select("epoch", "id"), ["epoch", "id"]).collect():
        assert abs(got[(r["epoch"], r["id"])]["velocity"] - r["velocity"]) < 1e-9
    for r in top.collect():
        assert got[(r["epoch"], r["id"])]["dwell"] == r["dwell"]


def test_every_oracle_has_a_query():
    from __spark_entry__ import oracle_sql, queries

    assert set(oracle_sql()) <= set(queries())
    assert len(queries()) > 90
