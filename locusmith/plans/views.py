"""Domain views over the test tables, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: View name to SQL; names in braces are tables or earlier views.
VIEWS: dict[str, str] = {
    "truth": """SELECT cast(o_custkey % 22 + 1 AS string) AS chrom, (o_orderkey * 7919) % 990000 AS start,
        (o_orderkey * 7919) % 990000 + 50 + (o_orderkey * 31) % 4000 AS stop,
        CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END AS geno
        FROM {orders} WHERE o_orderkey % 10 = 0""",
    "candidates": """SELECT DISTINCT cast(o_custkey % 22 + 1 AS string) AS chrom,
        (o_orderkey * 7919) % 990000 + l_linenumber * 40 AS start,
        (o_orderkey * 7919) % 990000 + l_linenumber * 40 + 50 + (o_orderkey * 31) % 4000 + cast(l_quantity AS bigint) * 10 AS stop
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey WHERE l_linenumber <= 2 AND o_orderkey % 5 = 0""",
    "confident_raw": """SELECT cast(c_custkey % 22 + 1 AS string) AS chrom, (c_custkey * 15013) % 900000 AS start,
        (c_custkey * 15013) % 900000 + 60000 + (c_custkey * 97) % 40000 AS stop FROM {customer}""",
    "exclude_raw": """SELECT cast(l_suppkey % 22 + 1 AS string) AS chrom, (l_orderkey * 104729) % 990000 AS start,
        (l_orderkey * 104729) % 990000 + 200 + l_partkey % 800 AS stop
        FROM {lineitem} WHERE l_returnflag = 'R' AND l_linenumber = 3""",
    "reads": """SELECT concat_ws(':', cast(l_orderkey AS string), cast(l_linenumber AS string), cast(l_partkey AS string), cast(l_suppkey AS string), cast(cast(round(l_extendedprice * 100) AS bigint) AS string)) AS read_id,
        cast(l_orderkey % 22 + 1 AS string) AS chrom,
        (l_orderkey * 7919 + l_linenumber * 104729) % 990000 AS start,
        (l_orderkey * 7919 + l_linenumber * 104729) % 990000 + 100 + cast(l_quantity AS bigint) * 20 AS stop,
        least(cast(round(l_discount * 700) AS bigint), 60) AS mapq, l_linestatus = 'F' AS is_reverse, l_returnflag <> 'R' AS is_proper,
        cast(floor(l_extendedprice) AS bigint) % 1000 AS tlen, l_tax > 0.06 AS is_clipped, l_quantity AS qty
        FROM {lineitem}""",
    "short_reads": """SELECT concat_ws(':', cast(l_orderkey AS string), cast(l_linenumber AS string), cast(l_partkey AS string), cast(l_suppkey AS string), cast(cast(round(l_extendedprice * 100) AS bigint) AS string)) AS read_id,
        cast(l_orderkey % 22 + 1 AS string) AS chrom, (l_orderkey * 7919 + l_linenumber * 104729) % 990000 AS start,
        CASE WHEN l_tax > 0.06 THEN 5 ELSE 0 END AS n_clip, 20 + cast(l_quantity AS bigint) AS n_first, l_partkey % 4 AS n_insert, 15 + l_suppkey % 20 AS n_second,
        (l_orderkey * 7919 + l_linenumber * 104729) % 990000 + 20 + cast(l_quantity AS bigint) + 15 + l_suppkey % 20 AS stop,
        least(cast(round(l_discount * 700) AS bigint), 60) AS mapq, l_linestatus = 'F' AS is_reverse, l_returnflag <> 'R' AS is_proper,
        cast(floor(l_extendedprice) AS bigint) % 1000 AS tlen, l_orderkey AS base_seed, l_partkey AS qual_seed
        FROM {lineitem}""",
    "contigs": "SELECT chrom, max(stop) + 1000 AS length FROM {reads} GROUP BY chrom",
    "predictions": """SELECT l_linestatus AS arm, l_suppkey % 5 AS seed, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
        round((l_discount * 5 + l_quantity / 50 + 0.6 * CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) / 2.1, 4) AS score,
        CASE WHEN l_orderkey % 4 = 0 THEN 'val' ELSE 'test' END AS part,
        50 + (l_orderkey * 31) % 6000 AS del_len, l_orderkey % 22 + 1 AS chrom_int
        FROM {lineitem}""",
    "runs": """SELECT l_linestatus AS benchmark, l_returnflag AS arm, l_suppkey % 10 AS seed,
        CASE l_linenumber WHEN 1 THEN 0.01 WHEN 2 THEN 0.05 WHEN 3 THEN 0.1 WHEN 4 THEN 0.25 WHEN 5 THEN 0.5 ELSE 1.0 END AS frac,
        CASE WHEN l_partkey % 2 = 0 THEN 'auprc' ELSE 'f1_at_tau' END AS metric, round(avg(l_discount) * 10, 6) AS value, count(*) AS n
        FROM {lineitem} GROUP BY 1, 2, 3, 4, 5""",
    "tests": """SELECT l_returnflag AS family, concat(l_linestatus, ':', cast(l_suppkey AS string)) AS test,
        CASE WHEN count(*) % 17 = 0 THEN NULL ELSE round((sum(l_partkey) % 1000) / 10000.0 * (1 + sum(l_orderkey) % 7), 6) END AS p
        FROM {lineitem} GROUP BY 1, 2""",
    "quotes": "SELECT item_id, text AS quote FROM {benchmark}",
    "codes": """SELECT l.doc_id, source, CASE quality WHEN 1 THEN 'yes' ELSE 'no' END AS axis_a,
        CASE WHEN toxic = 1 THEN 'yes' WHEN l.doc_id % 7 = 0 THEN 'unclear' ELSE 'no' END AS axis_b,
        CASE WHEN l.doc_id % 3 = 0 THEN 'missing' ELSE 'reported' END AS axis_c, CASE WHEN l.doc_id % 5 < 2 THEN 'missing' ELSE 'reported' END AS axis_d
        FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id""",
    "axes": """SELECT doc_id, 'a' AS axis, axis_a AS code FROM {codes} UNION ALL SELECT doc_id, 'b', axis_b FROM {codes}
        UNION ALL SELECT doc_id, 'c', axis_c FROM {codes} UNION ALL SELECT doc_id, 'd', axis_d FROM {codes}""",
    "audit_quotes": """SELECT doc_id, axis, doc_id % 40 AS item_id, CASE WHEN doc_id % 11 = 0 THEN 'other' ELSE code END AS code
        FROM {axes} WHERE doc_id % 13 <> 0 UNION ALL SELECT doc_id, axis, (doc_id + 1) % 40, code FROM {axes} WHERE axis = 'b' AND doc_id % 17 = 0""",
    "benchmark_vectors": """SELECT vec_id, CASE vec_id % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'H' ELSE 'O' END AS benchmark,
        CASE WHEN label < 3 THEN 1 ELSE 0 END AS label, embedding FROM {embeddings}""",
    "provenance": """SELECT DISTINCT l_linestatus AS benchmark, l_returnflag AS arm, l_suppkey % 10 AS seed,
        CASE WHEN l_returnflag = 'N' THEN l_suppkey % 20 ELSE l_suppkey % 10 END AS encoder, CASE WHEN l_returnflag = 'A' THEN 64 + 32 * (l_suppkey % 2) ELSE 96 END AS batch
        FROM {lineitem}""",
}


def _needs(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table or view ``name`` over the tables in ``sf_dir``."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name]
    return spark.sql(sql, **{n: view(spark, sf_dir, n) for n in _needs(sql)})


def sql_over(sql: str) -> str:
    """DuckDB SQL for a query that names views in braces: the views it needs become common table expressions."""
    found: dict[str, str] = {}

    def add(text: str) -> None:
        for n in _needs(text):
            if n in VIEWS and n not in found:
                add(VIEWS[n])
                found[n] = VIEWS[n]

    add(sql)
    bare = re.sub(r"\{(\w+)\}", r"\1", sql).strip()
    heads = ",\n".join(f"{n} AS ({re.sub(r'[{}]', '', body)})" for n, body in found.items())
    if not heads:
        return bare
    if bare[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {heads},\n{bare[15:]}"
    return f"WITH {heads},\n{bare[5:]}" if bare[:5].upper() == "WITH " else f"WITH {heads}\n{bare}"
