"""Tables of the data model derived from the given tables, as DataFrames and as the same SQL for the oracle."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import CLASSES

QUERIES: dict = {}
ORACLES: dict = {}

_ALL = "ok, ln, pk, agbd, price, disc, tax, rf, ls, ship"

#: Common table expressions of the oracle; a query's SQL gets those that it names, and those that they name.
TABLES = {
    "fp": f"""SELECT l_suppkey AS tile, year(l_shipdate) AS year, l_orderkey % 20 AS shard, l_quantity * 10 AS agbd, l_quantity AS rh98,
        n_regionkey + 1 AS region_cla, n_nationkey AS nation, ({CLASSES})[l_partkey % 14 + 1] AS cls,
        CASE WHEN l_orderkey % 2 = 0 THEN 1 ELSE -1 END * ((l_orderkey % 1000) + 1) / 1001e0 AS lat_dec, l_partkey % 80 AS lat_off,
        CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE -1 END * ((l_partkey % 1000) + 1) / 1001e0 AS lon_dec, l_partkey % 170 AS lon_off,
        CASE WHEN l_suppkey % 10 < 6 THEN 'train' WHEN l_suppkey % 10 < 8 THEN 'val' ELSE 'test' END AS split,
        l_orderkey AS ok, l_linenumber AS ln, l_partkey AS pk, l_extendedprice AS price, l_discount AS disc, l_tax AS tax,
        l_returnflag AS rf, l_linestatus AS ls, CAST(l_shipdate AS DATE) AS ship
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""",
    "fpx": f"SELECT *, row_number() OVER (PARTITION BY tile, year ORDER BY {_ALL}) - 1 AS idx FROM fp",
    "members": "SELECT * FROM (VALUES (1), (2), (3)) m(member)",
    "preds": "SELECT *, CASE WHEN ok % 100 = 7 THEN NULL ELSE agbd + (disc - 0.05e0) * member * 500 + (tax - 0.04e0) * 500 END AS pred FROM fp CROSS JOIN members",
    "pix": """SELECT p_partkey % 4 AS raster_id, (p_partkey // 4) // 32 AS row, (p_partkey // 4) % 32 AS col,
        CASE WHEN p_partkey % 37 = 5 THEN -9999 ELSE round(p_retailprice - 900, 2) END AS value, p_size AS aux, p_partkey AS pk FROM part""",
    "valid": "SELECT * FROM pix WHERE value <> -9999",
    "rasters": """SELECT raster_id, 32632 + CASE WHEN raster_id = 2 THEN 1 ELSE 0 END AS epsg, 10e0 AS a, CASE WHEN raster_id = 3 THEN 10e0 ELSE -10e0 END AS e,
        500000e0 + 160 * raster_id AS c, CASE WHEN raster_id = 3 THEN 5000000e0 - 10 * (max(row) + 1) ELSE 5000000e0 END AS f,
        CAST(32 AS BIGINT) AS width, max(row) + 1 AS height FROM pix GROUP BY raster_id""",
    "plots": """SELECT c_custkey AS plot, (c_custkey * 37 % 3600) / 10e0 - 179.95e0 AS lon, (c_custkey * 53 % 1600) / 10e0 - 79.95e0 AS lat,
        abs(c_acctbal) / 20 AS agb, c_custkey % 12 AS n, 2015 + c_custkey % 6 AS year, c_nationkey AS nation,
        CASE WHEN c_custkey % 9 = 4 THEN NULL ELSE abs(c_acctbal) / 20 + c_custkey % 100 - 50 END AS est_a,
        CASE WHEN c_custkey % 11 = 3 THEN NULL ELSE abs(c_acctbal) / 20 * 0.9e0 + c_custkey % 70 - 30 END AS est_b,
        (c_custkey % 101) / 100e0 AS cov_a, (c_custkey * 7 % 101) / 100e0 AS cov_b FROM customer""",
    "emb": """SELECT vec_id, label, CASE WHEN vec_id % 50 = 0 THEN list_prepend(-128e0, q[2:]) ELSE q END AS q,
        CASE WHEN label = 9 THEN NULL ELSE 1e0 / (label + 1) END AS scale
        FROM (SELECT vec_id, label, [CAST(greatest(-127, least(127, round_even(127 * x, 0))) AS DOUBLE) FOR x IN CAST(embedding AS DOUBLE[])] AS q FROM embeddings)""",
    "dims": "SELECT vec_id, label, scale, unnest(generate_series(0, len(q) - 1)) AS dim, unnest(q) AS v FROM emb",
    "chunked": "SELECT CAST(ts AS DATE) AS day, event_type, value, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS pos FROM events",
}


def oracle(sql: str) -> str:
    used: list[str] = []

    def add(text: str) -> None:
        for name in TABLES:
            if name not in used and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                add(TABLES[name])
                used.append(name)

    add(sql)
    body = sql.strip()
    ctes = ", ".join(f"{n} AS ({TABLES[n]})" for n in used)
    if not ctes:
        return body
    return f"WITH {ctes}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {ctes} {body}"


def query(name: str, sql: str | None = None):
    """Register a query under its name, with its SQL over the tables above where SQL expresses it."""

    def add(f):
        if name in QUERIES:
            raise ValueError(name)
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return f

    return add


class Tables:
    """The bound tables of a folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def fp(self) -> DataFrame:
        nation = self.raw("supplier").join(self.raw("nation"), F.expr("s_nationkey = n_nationkey")).select("s_suppkey", "n_nationkey", "n_regionkey")
        return self.raw("lineitem").join(nation, F.expr("l_suppkey = s_suppkey")).selectExpr(
            "l_suppkey AS tile", "year(l_shipdate) AS year", "l_orderkey % 20 AS shard", "l_quantity * 10 AS agbd", "l_quantity AS rh98",
            "n_regionkey + 1 AS region_cla", "n_nationkey AS nation", f"element_at(array{tuple(CLASSES)}, CAST(l_partkey % 14 + 1 AS INT)) AS cls",
            "CASE WHEN l_orderkey % 2 = 0 THEN 1 ELSE -1 END * ((l_orderkey % 1000) + 1) / 1001D AS lat_dec", "l_partkey % 80 AS lat_off",
            "CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE -1 END * ((l_partkey % 1000) + 1) / 1001D AS lon_dec", "l_partkey % 170 AS lon_off",
            "CASE WHEN l_suppkey % 10 < 6 THEN 'train' WHEN l_suppkey % 10 < 8 THEN 'val' ELSE 'test' END AS split",
            "l_orderkey AS ok", "l_linenumber AS ln", "l_partkey AS pk", "l_extendedprice AS price", "l_discount AS disc", "l_tax AS tax",
            "l_returnflag AS rf", "l_linestatus AS ls", "CAST(l_shipdate AS DATE) AS ship",
        )

    @property
    def fpx(self) -> DataFrame:
        """Footprints with their place in (tile, year)."""
        return self.fp.withColumn("idx", F.expr(f"CAST(row_number() OVER (PARTITION BY tile, year ORDER BY {_ALL}) - 1 AS BIGINT)"))

    @property
    def preds(self) -> DataFrame:
        members = F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("member")
        return self.fp.select("*", members).withColumn(
            "pred", F.expr("CASE WHEN ok % 100 = 7 THEN NULL ELSE agbd + (disc - 0.05D) * member * 500 + (tax - 0.04D) * 500 END")
        )

    @property
    def pix(self) -> DataFrame:
        return self.raw("part").selectExpr(
            "p_partkey % 4 AS raster_id", "(p_partkey div 4) div 32 AS row", "(p_partkey div 4) % 32 AS col",
            "CASE WHEN p_partkey % 37 = 5 THEN -9999D ELSE round(p_retailprice - 900, 2) END AS value", "p_size AS aux", "p_partkey AS pk",
        )

    @property
    def valid(self) -> DataFrame:
        return self.pix.where("value <> -9999")

    @property
    def rasters(self) -> DataFrame:
        return self.pix.groupBy("raster_id").agg((F.max("row") + 1).alias("height")).selectExpr(
            "raster_id", "32632 + CASE WHEN raster_id = 2 THEN 1 ELSE 0 END AS epsg", "10D AS a", "CASE WHEN raster_id = 3 THEN 10D ELSE -10D END AS e",
            "500000D + 160 * raster_id AS c", "CASE WHEN raster_id = 3 THEN 5000000D - 10 * height ELSE 5000000D END AS f", "32L AS width", "height",
        )

    @property
    def plots(self) -> DataFrame:
        return self.raw("customer").selectExpr(
            "c_custkey AS plot", "(c_custkey * 37 % 3600) / 10D - 179.95D AS lon", "(c_custkey * 53 % 1600) / 10D - 79.95D AS lat",
            "abs(c_acctbal) / 20 AS agb", "c_custkey % 12 AS n", "2015 + c_custkey % 6 AS year", "c_nationkey AS nation",
            "CASE WHEN c_custkey % 9 = 4 THEN NULL ELSE abs(c_acctbal) / 20 + c_custkey % 100 - 50 END AS est_a",
            "CASE WHEN c_custkey % 11 = 3 THEN NULL ELSE abs(c_acctbal) / 20 * 0.9D + c_custkey % 70 - 30 END AS est_b",
            "(c_custkey % 101) / 100D AS cov_a", "(c_custkey * 7 % 101) / 100D AS cov_b",
        )

    @property
    def emb(self) -> DataFrame:
        q = "transform(embedding, x -> CAST(greatest(-127, least(127, rint(127 * CAST(x AS DOUBLE)))) AS DOUBLE))"
        return self.raw("embeddings").selectExpr("vec_id", "label", f"{q} AS q").selectExpr(
            "vec_id", "label", "CASE WHEN vec_id % 50 = 0 THEN concat(array(-128D), slice(q, 2, size(q) - 1)) ELSE q END AS q",
            "CASE WHEN label = 9 THEN NULL ELSE 1D / (label + 1) END AS scale",
        )

    @property
    def chunked(self) -> DataFrame:
        return self.raw("events").selectExpr(
            "CAST(ts AS DATE) AS day", "event_type", "value", "event_id", "CAST(row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS BIGINT) AS pos"
        )
