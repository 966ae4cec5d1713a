"""The sample declarations in DuckDB SQL, as common table expressions."""

from __future__ import annotations

from portolan.sources.sample_tables import SAMPLE_HS_CODES

_CODES = "[" + ", ".join(f"'{c}'" for c in SAMPLE_HS_CODES) + "]"

DISPATCHES = """
dispatches AS (
  SELECT o_orderkey AS id,
    printf('%02dZA%09d', year(o_orderdate) % 100, o_orderkey) AS number,
    CASE WHEN o_orderkey % 97 <> 5 THEN CAST(o_orderdate AS DATE) END AS date,
    CASE WHEN o_orderkey % 53 = 7 THEN '' WHEN o_orderkey % 59 <> 3 THEN c_mktsegment END AS owner,
    c_name AS importer,
    printf('%08d-%d', c_custkey + 80000000, c_custkey % 10) AS importer_doc,
    printf('Customer#%09d', (c_custkey * 7) % 500) AS exporter,
    printf('BROKER %02d', o_orderkey % 20) AS broker,
    CASE WHEN o_orderkey % 71 = 9 THEN '' ELSE n_name END AS origin,
    printf('%03d - ADUANA', o_orderkey % 7) AS customs_office,
    'ZF2I - IMPORTACION' AS regime,
    CASE WHEN o_orderkey % 10 < 7 THEN 'VERDE' WHEN o_orderkey % 10 < 9 THEN 'NARANJA' ELSE 'ROJO' END AS channel,
    CASE WHEN o_orderkey % 5 <> 0 THEN printf('BL%08d', o_orderkey) END AS bl,
    CASE WHEN o_orderkey % 5 = 0 THEN printf('AWB%06d', o_orderkey) END AS awb,
    printf('MSCU%07d', o_orderkey % 10000000) AS container,
    o_totalprice AS fob,
    CAST(CAST(round(o_totalprice * 100) AS BIGINT) // 20 AS DOUBLE) / 100 AS freight,
    CAST(CAST(round(o_totalprice * 100) AS BIGINT) // 100 AS DOUBLE) / 100 AS insurance,
    CASE WHEN o_orderkey % 31 = 4 THEN CAST(0 AS DOUBLE)
      ELSE CAST(CAST(round(o_totalprice * 100) AS BIGINT) + CAST(round(o_totalprice * 100) AS BIGINT) // 20
        + CAST(round(o_totalprice * 100) AS BIGINT) // 100 AS DOUBLE) / 100 END AS cif,
    'USD' AS currency,
    CAST(7000 + o_orderkey % 500 AS DOUBLE) AS exchange_rate,
    CAST(CAST(round(o_totalprice * 100) AS BIGINT) * 10 AS DOUBLE) AS total,
    CAST(o_orderkey % 9000 AS DOUBLE) + CAST(0.5 AS DOUBLE) AS net_weight,
    CAST(1 + o_orderkey % 100 AS DOUBLE) AS packages,
    'uploads/' || strftime(o_orderdate, '%Y/%m/') || printf('%02dZA%09d', year(o_orderdate) % 100, o_orderkey) || '.pdf'
      AS stored_path,
    printf('%02dZA%09d', year(o_orderdate) % 100, o_orderkey) || '.pdf' AS file_name,
    sha256(printf('%02dZA%09d', year(o_orderdate) % 100, o_orderkey)) AS file_hash,
    CASE o_orderstatus WHEN 'F' THEN 'CONFIRMADO' WHEN 'O' THEN 'PROCESADO' ELSE 'REVISAR' END AS status,
    CAST(70 + o_orderkey % 30 AS DOUBLE) / 100 AS confidence,
    CAST(o_orderdate AS TIMESTAMP) AS created_at,
    CAST(o_orderdate AS TIMESTAMP) AS updated_at
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
)"""

ITEMS = f"""
items AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS id,
    l_orderkey AS dispatch_id,
    l_linenumber AS item_no,
    CASE WHEN l_linenumber % 3 <> 0 THEN CAST(l_suppkey % 4 + 1 AS INTEGER) END AS subitem_no,
    CASE WHEN l_partkey % 101 = 1 THEN NULL
      WHEN l_partkey % 13 = 0 THEN replace({_CODES}[l_partkey % 12 + 1] || printf('.%03dL', l_partkey % 10 * 100), '.', '')
      ELSE {_CODES}[l_partkey % 12 + 1] || printf('.%03dL', l_partkey % 10 * 100) END AS hs_code,
    CASE WHEN l_suppkey % 6 <> 0 THEN CAST(l_partkey + 7840000000000 AS VARCHAR) END AS product_code,
    upper(p_name) || ' ' || p_size || 'ML' AS description,
    CASE WHEN l_returnflag = 'A' AND l_quantity = 1 THEN '' WHEN l_linenumber <> 7 THEN p_brand END AS brand,
    l_quantity AS quantity,
    'UNIDAD' AS unit,
    CASE WHEN l_linenumber % 4 = 0 THEN CAST(0 AS DOUBLE) WHEN l_linenumber % 4 <> 1 THEN l_extendedprice / l_quantity END
      AS unit_value,
    l_extendedprice AS total_value,
    abs(l_tax) AS vat_rate,
    CASE WHEN l_discount <> 0 THEN l_discount END AS duty_rate,
    CASE WHEN l_suppkey % 11 = 0 THEN '' ELSE 'NATION_' || (l_suppkey % 25) END AS origin,
    CAST(l_linenumber + 1 AS INTEGER) AS page
  FROM lineitem JOIN part ON l_partkey = p_partkey
)"""


def with_tables(body: str) -> str:
    """A query over the sample declarations.

    The body is a SELECT, or further table expressions (after a comma) and a SELECT.
    """
    return "WITH " + ",".join([DISPATCHES, ITEMS]) + "\n" + body.strip()
