"""Columns, files and publication: what is written is read back."""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import contracts
from .. import functions as X
from ..held import shared_dir
from ..operators import joins
from ..sources import archive, digests, publish, read_config, read_csv, read_csv_text, table
from .base import Registry

query = Registry()


def _folder(spark) -> str:
    return posixpath.join(shared_dir(spark), f"files-{uuid.uuid4().hex}")


@query("SELECT n_nationkey AS key, n_name AS name, 2 AS n_prefixed FROM nation")
def renamed_columns(spark, d):
    named = X.rename_checked(X.drop_matching(table(spark, d, "nation"), pattern="region"), {"n_nationkey": "key", "n_name": "name"})
    return named.withColumn("n_prefixed", F.lit(len(X.names_with_prefix(table(spark, d, "nation"), "n_n"))))


@query("SELECT c_custkey, CAST(NULL AS DOUBLE) AS c_acctbal FROM customer")
def suppressed_columns(spark, d):
    return X.suppress(table(spark, d, "customer"), ["c_acctbal"]).select("c_custkey", "c_acctbal")


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o_date FROM orders", dates=("o_date",))
def midnight_dates(spark, d):
    return table(spark, d, "orders").select("o_orderkey", X.midnight_date(F.date_trunc("day", "o_orderdate")).alias("o_date"))


@query("SELECT p_partkey, CAST(p_size AS DOUBLE) AS size, p_retailprice AS price FROM part")
def strict_numbers(spark, d):
    text = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("string").alias("s"), F.col("p_retailprice").cast("string").alias("p"))
    return text.select("p_partkey", X.strict_number(F.col("s"), whole=True).alias("size"), X.strict_number(F.col("p")).alias("price"))


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def csv_round_trip(spark, d):
    """Written with 17 significant digits, packed, and read with declared types."""
    rows, at = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal"), _folder(spark)
    publish.formatted(rows, {"s_acctbal": "%.17g"}).write.option("compression", "gzip").csv(at, header=True)
    return read_csv(spark, at, T.StructType([T.StructField("s_suppkey", T.LongType()), T.StructField("s_name", T.StringType()), T.StructField("s_acctbal", T.DoubleType())]))


@query("SELECT o_orderkey, o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders", dates=("o_orderdate",))
def csv_dates_pruned(spark, d):
    """Three of five columns, dates among them, with declared types; the scan reads no others."""
    rows, at = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", F.to_date("o_orderdate").alias("o_orderdate"), "o_orderpriority"), _folder(spark)
    publish.formatted(rows, {"o_totalprice": "%.17g"}).write.csv(at, header=True)
    kinds = {"o_orderkey": T.LongType(), "o_orderstatus": T.StringType(), "o_totalprice": T.DoubleType(), "o_orderdate": T.DateType(), "o_orderpriority": T.StringType()}
    return read_csv(spark, at, T.StructType([T.StructField(c, k) for c, k in kinds.items()]), ["o_orderkey", "o_totalprice", "o_orderdate"])


@query("SELECT n_name, CAST(row_number() OVER (ORDER BY n_nationkey) + 1 AS INT) AS source_row FROM nation")
def csv_provenance(spark, d):
    """Each row's place in its file; the header is row 1."""
    at = _folder(spark)
    table(spark, d, "nation").coalesce(1).sortWithinPartitions("n_nationkey").write.csv(at, header=True)
    return read_csv_text(spark, at).select("n_name", "source_row")


@query("""SELECT o_orderkey, 'by ' || CAST(o_custkey AS VARCHAR) || chr(10) || '"' || o_orderpriority || '", ' || o_orderstatus AS note,
  CAST(row_number() OVER (PARTITION BY o_orderkey // 3000 ORDER BY o_orderkey) + 1 AS INT) AS source_row FROM orders""")
def csv_places(spark, d):
    """Places in files that are cut into splits, with quotes and line ends in fields; a file has the orders of 3,000 keys."""
    note = F.concat(F.lit("by "), F.col("o_custkey").cast("string"), F.lit('\n"'), "o_orderpriority", F.lit('", '), "o_orderstatus")
    rows, at = table(spark, d, "orders").select("o_orderkey", note.alias("note"), F.expr("o_orderkey div 3000").alias("part")), _folder(spark)
    rows.repartition("part").sortWithinPartitions("part", "o_orderkey").write.partitionBy("part").csv(at, header=True, escape='"')
    back = read_csv_text(spark, f"{at}/*", split_bytes=65536)
    return back.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "note", "source_row")


@query("SELECT o_orderpriority AS name, CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY 1")
def json_round_trip(spark, d):
    """Counts of a few classes, written as JSON and read again as parameters."""
    at = _folder(spark) + ".json"
    counts = table(spark, d, "orders").groupBy("o_orderpriority").count().limit(1000).collect()  # a handful of classes
    publish.write_json(spark, at, {r.o_orderpriority: r["count"] for r in counts})
    return spark.createDataFrame([(k, float(v)) for k, v in read_config(spark, at).items()], "name string, value double")


@query("SELECT 'nation' AS name, count(*) AS n_rows FROM nation UNION ALL SELECT 'region', count(*) FROM region")
def published_tables(spark, d):
    """Published in one step, and taken up again only as the manifest says."""
    at = _folder(spark)
    publish.publish(spark, {n: table(spark, d, n) for n in ("nation", "region")}, at)
    tables = publish.require_bundle(spark, at, ["nation", "region"])
    counted = [df.agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("name"), "n_rows") for n, df in tables.items()]
    return counted[0].unionByName(counted[1])


@query("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def checkpointed(spark, d):
    """What a store has is read, not worked out again."""
    store, asked = publish.CheckpointStore(spark, _folder(spark)), {"table": "nation", "version": 1}
    store.get("counts", asked, lambda: table(spark, d, "nation").groupBy("n_regionkey").agg(F.count("*").alias("n")))
    return store.get("counts", asked, lambda: None)


@query("SELECT 'nation' AS record_type, count(*) AS n_rows FROM nation UNION ALL SELECT 'region', count(*) FROM region")
def bundle_counts(spark, d):
    bundle = publish.bundle_rows({n: table(spark, d, n) for n in ("nation", "region")})
    return publish.bundle_manifest(bundle).select("record_type", "n_rows")


@query("SELECT r_regionkey AS region, r_name AS name FROM region")
def bundle_view(spark, d):
    bundle = publish.bundle_rows({n: table(spark, d, n) for n in ("nation", "region")})
    return publish.view(bundle, "region", {"r_regionkey": "region", "r_name": "name"})


@query("""WITH o AS (SELECT o_orderkey || ',' || o_custkey || ',' || o_orderpriority || chr(10) AS line, o_orderkey AS k FROM orders), n AS (SELECT n_nationkey || ',' || n_name || chr(10) AS line, n_nationkey AS k FROM nation),
t AS (SELECT 'orders' AS t, 'o_orderkey,o_custkey,o_orderpriority' || chr(10) AS head, * FROM o UNION ALL SELECT 'nation', 'n_nationkey,n_name' || chr(10), * FROM n),
m AS (SELECT 'Data/' || t || '.csv' AS name, count(*) AS n_rows, head || string_agg(line, '' ORDER BY k) AS data FROM t GROUP BY t, head) SELECT name, n_rows, CAST(strlen(data) AS BIGINT) AS n_bytes, sha256(data) AS sha256 FROM m""")
def archived(spark, d):
    """Two tables in one archive; its manifest holds for what a plain reader finds in it."""
    tables = {"orders": table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), "nation": table(spark, d, "nation").select("n_nationkey", "n_name")}
    at = _folder(spark) + ".zip"
    manifest = archive.write_archive(spark, tables, at, {"orders": ["o_orderkey"], "nation": ["n_nationkey"]}, "Data")
    archive.require_archive(at, manifest)
    return manifest.select("name", "n_rows", "n_bytes", "sha256")


_CHANGED = "SELECT c_custkey, c_acctbal + CASE WHEN c_custkey % 7 = 0 THEN (c_custkey % 3) / 4.0::DOUBLE ELSE 0 END AS c_acctbal, CASE WHEN c_custkey % 11 <> 0 THEN c_nationkey END AS c_nationkey FROM customer"


@query(f"""WITH b AS ({_CHANGED}), j AS (SELECT a.c_acctbal AS x, b.c_acctbal AS y, a.c_nationkey AS m, b.c_nationkey AS n FROM customer a JOIN b USING (c_custkey))
SELECT 'c_acctbal' AS "column", count(*) AS n_rows, CAST(count(*) FILTER (WHERE abs(x - y) > 0.3) AS BIGINT) AS n_different, round(max(abs(x - y)), 6) AS max_gap FROM j
UNION ALL SELECT 'c_nationkey', count(*), CAST(count(*) FILTER (WHERE m IS DISTINCT FROM n) AS BIGINT), round(max(abs(m - n)), 6) FROM j""")
def recomputed(spark, d):
    """A table worked out again, of which some values moved and some are gone: where it differs is reported, and the strict form refuses it."""
    rows = table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    k = F.col("c_custkey")
    again = rows.select(k, (F.col("c_acctbal") + F.when(k % 7 == 0, (k % 3) / 4).otherwise(0.0)).alias("c_acctbal"), F.when(k % 11 != 0, F.col("c_nationkey")).alias("c_nationkey"))
    try:
        publish.require_recomputed(rows, again, ["c_custkey"], ["c_acctbal", "c_nationkey"], 0.3)
    except contracts.ContractError:
        report = joins.equality_report(rows, again, ["c_custkey"], ["c_acctbal", "c_nationkey"], 0.3)
        return report.withColumn("max_gap", F.round("max_gap", 6))
    raise contracts.ContractError("differences were not found")


@query(f"""WITH b AS (SELECT * FROM ({_CHANGED}) WHERE c_custkey % 13 <> 0 UNION ALL SELECT -c_custkey, c_acctbal, c_nationkey FROM customer WHERE c_custkey % 100 = 1)
SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, CASE WHEN b.c_custkey IS NULL THEN 'only_left' WHEN a.c_custkey IS NULL THEN 'only_right' ELSE 'changed' END AS status,
  CASE WHEN a.c_custkey IS NULL OR b.c_custkey IS NULL THEN '' ELSE concat_ws(',', CASE WHEN a.c_acctbal IS DISTINCT FROM b.c_acctbal THEN 'c_acctbal' END, CASE WHEN a.c_nationkey IS DISTINCT FROM b.c_nationkey THEN 'c_nationkey' END) END AS columns
FROM customer a FULL JOIN b ON a.c_custkey = b.c_custkey WHERE a.c_custkey IS NULL OR b.c_custkey IS NULL OR a.c_acctbal IS DISTINCT FROM b.c_acctbal OR a.c_nationkey IS DISTINCT FROM b.c_nationkey""")
def table_differences(spark, d):
    """Two tables written with digests of key ranges, of which some rows changed, went or came."""
    rows = table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    k = F.col("c_custkey")
    moved = rows.select(k, (F.col("c_acctbal") + F.when(k % 7 == 0, (k % 3) / 4).otherwise(0.0)).alias("c_acctbal"), F.when(k % 11 != 0, F.col("c_nationkey")).alias("c_nationkey"))
    other = moved.filter(k % 13 != 0).unionByName(rows.filter(k % 100 == 1).withColumn("c_custkey", -k))
    left, right = _folder(spark), _folder(spark)
    digests.write_digested(rows, ["c_custkey"], left)
    digests.write_digested(other, ["c_custkey"], right)
    return digests.differences(spark, left, right, ["c_custkey"])


@query("SELECT count(*) AS n FROM customer")
def contracts_hold(spark, d):
    rows = contracts.require_numeric(contracts.require_columns(table(spark, d, "customer"), ["c_custkey", "c_acctbal"]), ["c_acctbal"])
    rows = contracts.require_all(contracts.require_unique(rows, ["c_custkey"]), {"no negative key": F.col("c_custkey") >= 0})
    contracts.require_same_rows(rows.select("c_custkey"), rows.repartition(2).select("c_custkey"))
    return contracts.require_counts(rows, rows.count()).agg(F.count("*").alias("n"))


QUERIES, ORACLE_SQL = query.queries, query.sql
