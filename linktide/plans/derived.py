"""Link, author, report, trade and dictionary views over the given tables.

The statements run unchanged in Spark SQL and in DuckDB. A line item links its
part to the flagship part of its supplier, or the other way round, which needs
no window over an order and therefore no task that holds a whole order.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linktide.session import settle

TABLES = ("lineitem", "orders", "customer", "part", "supplier", "events", "documents", "labels")
ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]

VIEWS = {
    "links": """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate,
       CAST(year(l_shipdate) AS INT) AS epoch, o_custkey AS neuron,
       CASE WHEN l_linestatus = 'F' THEN l_partkey ELSE l_suppkey * 20 + l_linenumber END AS src,
       CASE WHEN l_linestatus = 'F' THEN l_suppkey * 20 + l_linenumber ELSE l_partkey END AS dst,
       l_linestatus AS token, CAST(round(l_extendedprice * 100) AS BIGINT) AS amount,
       CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN -1 ELSE 0 END AS valence,
       round(1 - l_discount * 10, 1) AS price
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "karma": """
SELECT c_custkey AS neuron, CAST(c_custkey % 7 AS DOUBLE) / 2 AS kappa
FROM customer WHERE c_custkey % 2 = 0""",
    "will": """
SELECT c_custkey AS neuron, c_custkey * 1000 AS will FROM customer WHERE c_custkey % 3 = 0""",
    "token_weights": """
SELECT 'F' AS token, CAST(1 AS DOUBLE) AS rho UNION ALL SELECT 'O', CAST(2 AS DOUBLE)""",
    "node_values": """
SELECT p_partkey AS id, p_retailprice AS value, p_size AS size FROM part""",
    "reports": """
SELECT l_suppkey AS question_id, o_custkey AS neuron,
       0.05 + 9 * min(l_discount) AS belief, 0.05 + 11.25 * min(l_tax) AS prediction,
       max(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN -1 ELSE 0 END) AS valence,
       sum(l_quantity) AS stake
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_suppkey, o_custkey""",
    "trades": """
SELECT user_id AS market, event_id AS ord,
       CASE WHEN event_type IN ('click', 'purchase') THEN 'YES' ELSE 'NO' END AS side, value AS qty
FROM events""",
    "phi": """
SELECT id, CAST(sum(amount) AS DOUBLE) / CAST(max(total) AS DOUBLE) AS focus
FROM (SELECT src AS id, amount FROM links UNION ALL SELECT dst, amount FROM links) ends,
     (SELECT 2 * sum(amount) AS total FROM links) totals
GROUP BY id""",
    "phi_before": """
SELECT id, CAST(sum(amount) AS DOUBLE) / CAST(max(total) AS DOUBLE) AS focus
FROM (SELECT src AS id, amount FROM links WHERE epoch < 2001
      UNION ALL SELECT dst, amount FROM links WHERE epoch < 2001) ends,
     (SELECT 2 * sum(amount) AS total FROM links WHERE epoch < 2001) totals
GROUP BY id""",
    "history": """
SELECT ends.epoch AS epoch, id, CAST(sum(amount) AS DOUBLE) / CAST(max(total) AS DOUBLE) AS focus
FROM (SELECT epoch, src AS id, amount FROM links UNION ALL SELECT epoch, dst, amount FROM links) ends
JOIN (SELECT epoch, 2 * sum(amount) AS total FROM links GROUP BY epoch) totals
  ON ends.epoch = totals.epoch
GROUP BY ends.epoch, id""",
    "adjacency": """
SELECT src, dst, CAST(sum(amount) AS DOUBLE) / 10000000 AS w
FROM links WHERE src <> dst GROUP BY src, dst""",
    "edges": """
SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM links WHERE src <> dst""",
    "dictionary": """
SELECT doc_id AS pos, text AS data FROM documents""",
}


NEEDS = {
    "phi": ("links",), "phi_before": ("links",), "history": ("links",), "adjacency": ("links",),
    "edges": ("links",),
}


LINK_COLUMNS = [
    *ORDER,
    "CAST(year(l_shipdate) AS INT) AS epoch",
    "CASE WHEN l_linestatus = 'F' THEN l_partkey ELSE l_suppkey * 20 + l_linenumber END AS src",
    "CASE WHEN l_linestatus = 'F' THEN l_suppkey * 20 + l_linenumber ELSE l_partkey END AS dst",
    "l_linestatus AS token",
    "CAST(round(l_extendedprice * 100) AS BIGINT) AS amount",
    "CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN -1 ELSE 0 END AS valence",
    "round(1 - l_discount * 10, 1) AS price",
]


def _links(made: Made) -> DataFrame:
    lines = made.table("lineitem").selectExpr(*LINK_COLUMNS)
    orders = made.table("orders").selectExpr("o_orderkey", "o_custkey AS neuron")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        *ORDER, "epoch", "neuron", "src", "dst", "token", "amount", "valence", "price")


def _ends(made: Made) -> DataFrame:
    return made["links"].select(F.explode(F.array("src", "dst")).alias("id"), "epoch", "amount")


def _node_sums(made: Made) -> DataFrame:
    """(id, now, before, old): amounts at a node, those before 2001, and their number."""
    early = F.col("epoch") < 2001
    return settle(_ends(made).groupBy("id").agg(
        F.sum("amount").alias("now"), F.sum(F.when(early, F.col("amount"))).alias("before"), F.count_if(early).alias("old")))


def _shares(sums: DataFrame, amount: str) -> DataFrame:
    total = sums.agg(F.sum(amount).alias("__total"))  # both ends of every link
    return sums.join(F.broadcast(total)).select(
        "id", (F.col(amount).cast("double") / F.col("__total").cast("double")).alias("focus"))


def _history(made: Made) -> DataFrame:
    sums = settle(_ends(made).where("epoch IS NOT NULL").groupBy("epoch", "id").agg(F.sum("amount").alias("now")))
    totals = sums.groupBy("epoch").agg(F.sum("now").alias("__total"))  # a row per year
    return sums.join(F.broadcast(totals), "epoch").select(
        "epoch", "id", (F.col("now").cast("double") / F.col("__total").cast("double")).alias("focus"))


def _adjacency(made: Made) -> DataFrame:
    sums = made["links"].where("src <> dst").groupBy("src", "dst").agg(F.sum("amount").alias("__sum"))
    return sums.select("src", "dst", (F.col("__sum").cast("double") / 10000000).alias("w"))


BUILT = {
    "links": _links,
    "node_sums": _node_sums,
    "phi": lambda made: _shares(made["node_sums"], "now"),
    "phi_before": lambda made: _shares(made["node_sums"].where("old > 0"), "before"),
    "history": _history,
    "adjacency": _adjacency,
    "edges": lambda made: made["links"].where("src <> dst").select(
        F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct(),
}


class Made(dict):
    """The views of one folder, each made anew but for the sums that several of them share."""

    def __init__(self, spark: SparkSession, folder: str):
        super().__init__()
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __missing__(self, name: str) -> DataFrame:
        found = BUILT[name](self) if name in BUILT else self.stated(name)
        if name == "node_sums":
            self[name] = found
        return found

    def stated(self, name: str) -> DataFrame:
        """A view by its statement; the tables it reads are registered for the session."""
        sql = VIEWS[name].strip()
        for table in TABLES:
            if re.search(rf"\b{table}\b", sql):
                self.table(table).createOrReplaceTempView(table)
        return self.spark.sql(sql)


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A derived view over ``folder``."""
    return Made(spark, folder)[name]


def with_views(*names: str) -> str:
    """The definitions of a WITH clause, each view once and after what it reads."""
    listed: list[str] = []
    for name in names:
        listed += [n for n in (*NEEDS.get(name, ()), name) if n not in listed]
    names = tuple(listed)
    return ", ".join(f"{n} AS ({VIEWS[n].strip()})" for n in names)
