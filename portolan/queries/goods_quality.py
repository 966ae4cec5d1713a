"""Diagnosis, repair, brands and families over the sample goods lines."""

from pyspark.sql import functions as F

from portolan import fixed_values as fv
from portolan.functions import goods, hs, text
from portolan.operators import aggregates as agg
from portolan.operators import brands as br
from portolan.operators import quality as qa
from portolan.operators import search
from portolan.queries.oracle_tables import with_tables
from portolan.queries.registry import query
from portolan.sources import sample_tables as st

_FLAWED = """
, base AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS id,
    l_orderkey AS dispatch_id, l_linenumber AS item_no,
    CASE WHEN l_linenumber % 3 <> 0 THEN CAST(l_suppkey % 4 + 1 AS INTEGER) END AS subitem_no,
    CASE WHEN l_returnflag = 'A' AND l_quantity = 1 THEN '' WHEN l_linenumber <> 7 THEN p_brand END AS brand,
    CASE WHEN l_suppkey % 2 = 0 THEN 'K' || l_partkey END AS product_code,
    upper(p_name) AS true_name, (l_partkey + l_suppkey) % 9 AS flaw, l_partkey
  FROM lineitem JOIN part ON l_partkey = p_partkey),
flawed AS (
  SELECT *, CASE flaw
      WHEN 1 THEN true_name || ' - REF. SM-S' || l_partkey || 'B'
      WHEN 2 THEN 'HOJA 4 de 12 FECHA OFIC: 10/08/2026 ' || true_name
      WHEN 3 THEN 'LOS DEMAS EN: 7.000 UNIDADES ' || true_name
      WHEN 4 THEN true_name || ' - .'
      WHEN 5 THEN 'Subítem ' || item_no || ' - Posición 8517'
      WHEN 6 THEN 'COD: X' || l_partkey || '7 - ' || true_name
      WHEN 7 THEN true_name || ' ' || (l_partkey + 7840000000000)
      WHEN 8 THEN coalesce(nullif(brand, ''), 'XX') || ' - ' || true_name
      ELSE true_name END AS description,
    flaw = 5 AS needs_source,
    flaw = 8 AND coalesce(brand, '') = '' AS no_brand
  FROM base),
diagnosed AS (
  SELECT *,
    CASE WHEN flaw = 5 OR no_brand THEN description ELSE true_name END AS suggested_description,
    CASE flaw WHEN 1 THEN 'SM-S' || l_partkey || 'B' WHEN 6 THEN 'X' || l_partkey || '7'
      WHEN 7 THEN CAST(l_partkey + 7840000000000 AS VARCHAR) ELSE coalesce(product_code, '') END AS suggested_code,
    CASE WHEN flaw = 5 THEN 'cutoff' WHEN flaw = 0 OR no_brand THEN 'none' WHEN flaw IN (1, 2, 3, 6) THEN 'high' ELSE 'medium' END
      AS audit_confidence,
    flaw = 0 OR no_brand AS is_clean,
    CASE WHEN flaw = 5 THEN 'Corte por salto de página en PDF' WHEN flaw IN (1, 6) THEN 'Código/SKU incrustado en la descripción'
      WHEN flaw = 2 THEN 'Texto de encabezado administrativo pegado' WHEN flaw = 3 THEN 'Prefijo arancelario o de unidades'
      WHEN flaw = 4 THEN 'Residuos de puntuación o corte' WHEN flaw = 7 OR (flaw = 8 AND NOT no_brand)
      THEN 'Normalización y limpieza de formato' ELSE '' END AS issue_text
  FROM flawed)
"""

_SPELLED = """
, spelled AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS id,
    CASE l_linenumber % 3 WHEN 0 THEN p_brand WHEN 1 THEN replace(p_brand, '#', ' #')
      ELSE 'BRAND-' || substr(p_brand, 7) || ' Inc.' END AS brand,
    'BRAND' || substr(p_brand, 7) AS skeleton
  FROM lineitem JOIN part ON l_partkey = p_partkey),
summary AS (SELECT brand, skeleton, count(*) AS items FROM spelled GROUP BY ALL)
"""


@query("observation_parse", with_tables(_FLAWED + """
SELECT id, CASE WHEN flaw = 5 OR no_brand THEN description ELSE true_name END AS clean_description,
  CASE flaw WHEN 1 THEN 'SM-S' || l_partkey || 'B' WHEN 6 THEN 'X' || l_partkey || '7'
    WHEN 7 THEN CAST(l_partkey + 7840000000000 AS VARCHAR) ELSE '' END AS code
FROM flawed"""))
def observation_parse(spark, sf):
    df = st.flawed_items(spark, sf)
    return goods.split_observation(df, "description", "brand", "code", "clean_description").select("id", "clean_description", "code")


@query("diagnose_items", with_tables(_FLAWED + """
SELECT id, description, suggested_description, suggested_code, audit_confidence, is_clean, needs_source, issue_text FROM diagnosed"""))
def diagnose_items(spark, sf):
    df = goods.diagnose(st.flawed_items(spark, sf))
    return df.select("id", "description", "suggested_description", "suggested_code", "audit_confidence", "is_clean",
                     "needs_source", F.array_join("issues", "; ").alias("issue_text"))


@query("audit_summary", with_tables(_FLAWED + """
SELECT count(*) AS items, count(*) FILTER (is_clean) AS clean, count(*) FILTER (NOT is_clean) AS flawed,
  count(*) FILTER (needs_source) AS cutoffs, count(*) FILTER (flaw = 2) AS headers, count(*) FILTER (flaw IN (1, 6)) AS codes,
  count(*) FILTER (flaw = 3) AS prefixes,
  round(CAST(count(*) FILTER (is_clean) * 100.0 AS DOUBLE) / count(*), 1) AS clean_pct FROM diagnosed"""))
def audit_summary(spark, sf):
    return qa.audit_summary(st.flawed_items(spark, sf))


def _audit_sql(condition):
    return with_tables(_FLAWED + f"""
SELECT g.id, dispatch_id, number, suggested_description, suggested_code, issue_text
FROM diagnosed g JOIN dispatches d ON d.id = g.dispatch_id WHERE NOT is_clean AND {condition}""")


def _audit(kind):
    def run(spark, sf):
        df = qa.audit_items(st.flawed_items(spark, sf), st.dispatches(spark, sf), kind)
        return df.select("id", "dispatch_id", "number", "suggested_description", "suggested_code",
                         F.array_join("issues", "; ").alias("issue_text"))

    return run


query("audit_items_all", _audit_sql("true"))(_audit("all"))
query("audit_items_cutoffs", _audit_sql("needs_source"))(_audit("cutoffs"))
query("audit_items_headers", _audit_sql("flaw = 2"))(_audit("headers"))
query("audit_items_skus", _audit_sql("flaw = 1"))(_audit("skus"))


@query("audit_items_page", with_tables(_FLAWED + """
SELECT g.id, dispatch_id, number, suggested_description FROM diagnosed g JOIN dispatches d ON d.id = g.dispatch_id
WHERE NOT is_clean ORDER BY g.id LIMIT 25 OFFSET 50"""))
def audit_items_page(spark, sf):
    df = qa.audit_items(st.flawed_items(spark, sf), st.dispatches(spark, sf))
    return search.paginate(df.select("id", "dispatch_id", "number", "suggested_description"), [F.asc("id")], 3, 25)


@query("apply_corrections", with_tables(_FLAWED + """
SELECT id, CASE WHEN flaw = 4 THEN 'FIXED ' || true_name ELSE description END AS description,
  CASE WHEN flaw = 4 AND item_no % 3 = 0 THEN NULL WHEN flaw = 4 AND item_no % 3 = 1 THEN 'N1' ELSE product_code END AS product_code,
  CASE WHEN flaw = 4 AND item_no % 2 = 0 THEN 'Sin Marca' ELSE brand END AS brand FROM flawed"""))
def apply_corrections(spark, sf):
    items = st.flawed_items(spark, sf)
    edits = items.filter("flaw = 4").select(
        F.col("id").alias("item_id"), F.concat(F.lit(" FIXED "), "true_name").alias("new_description"),
        F.when(F.col("item_no") % 3 == 0, " ").when(F.col("item_no") % 3 == 1, "N1").alias("new_code"),
        F.when(F.col("item_no") % 2 == 0, " ").alias("new_brand"))
    return qa.apply_corrections(items, edits)[0].select("id", "description", "product_code", "brand")


@query("unknown_corrections", with_tables(_FLAWED + """
SELECT 'no-' || id AS item_id, 'Ítem ID no-' || id || ' no encontrado' AS error FROM flawed WHERE flaw = 4"""))
def unknown_corrections(spark, sf):
    items = st.flawed_items(spark, sf)
    edits = items.filter("flaw = 4").select(
        F.concat(F.lit("no-"), "id").alias("item_id"), F.col("true_name").alias("new_description"),
        F.lit(None).cast("string").alias("new_code"), F.lit(None).cast("string").alias("new_brand"))
    return qa.apply_corrections(items, edits)[1].select("item_id", "error")


@query("high_confidence_fixes", with_tables(_FLAWED + """
SELECT id, CASE WHEN audit_confidence = 'high' THEN suggested_description ELSE description END AS description,
  CASE WHEN audit_confidence = 'high' AND suggested_code <> '' THEN suggested_code ELSE product_code END AS product_code,
  audit_confidence = 'high' AS fixed FROM diagnosed"""))
def high_confidence_fixes(spark, sf):
    return qa.apply_high_confidence_fixes(st.flawed_items(spark, sf)).select("id", "description", "product_code", "fixed")


@query("fix_counts", with_tables(_FLAWED + """
SELECT count(*) AS items, count(DISTINCT dispatch_id) AS dispatches FROM diagnosed WHERE audit_confidence = 'high'"""))
def fix_counts(spark, sf):
    return qa.fix_counts(qa.apply_high_confidence_fixes(st.flawed_items(spark, sf)))


@query("hs_enrich", with_tables("""
, codes AS (SELECT DISTINCT hs_code, substr(regexp_replace(hs_code, '[^0-9]', '', 'g'), 1, 8) AS d FROM items)
SELECT hs_code, CASE WHEN hs_code IS NULL THEN '' ELSE substr(d, 1, 4) || '.' || substr(d, 5, 2) || '.' || substr(d, 7, 2) END AS hs_short,
  CASE substr(d, 1, 6) WHEN '330300' THEN 'Perfumes y aguas de tocador' WHEN '330499' THEN 'Cremas, maquillaje y cuidado de piel'
    WHEN '330510' THEN 'Champús / Shampoos' WHEN '851713' THEN 'Smartphones / Teléfonos móviles'
    WHEN '847130' THEN 'Laptops y computadoras portátiles' WHEN '852872' THEN 'Televisores y Smart TVs'
    WHEN '420212' THEN 'Bolsos, mochilas, carteras y valijas' WHEN '610910' THEN 'T-shirts y camisetas de punto'
    WHEN '950300' THEN 'Juguetes y modelos reducidos' WHEN '240412' THEN 'Dispositivos para vapear / e-líquidos'
    WHEN '090121' THEN 'Café, té, yerba mate y especias' WHEN '999900' THEN 'Mercancías diversas'
    ELSE 'Sin Clasificar' END AS hs_label,
  CASE substr(d, 1, 2) WHEN '33' THEN 'Aceites esenciales, perfumería y cosmética'
    WHEN '85' THEN 'Máquinas, aparatos y material eléctrico, audio, TV y electrónica'
    WHEN '84' THEN 'Reactores nucleares, calderas, máquinas y computación' WHEN '42' THEN 'Manufacturas de cuero, marroquinería y bolsos'
    WHEN '61' THEN 'Prendas y complementos de vestir, de punto' WHEN '95' THEN 'Juguetes y artículos para recreo o deporte'
    WHEN '24' THEN 'Tabaco y sucedáneos (incluye vapeadores)' WHEN '09' THEN 'Café, té, yerba mate y especias'
    WHEN '99' THEN 'Mercancías diversas' ELSE 'Sin Clasificar' END AS hs_chapter_label FROM codes""".replace(
    "'Juguetes y artículos para", "'Juguetes, juegos y artículos para")))
def hs_enrich(spark, sf):
    codes = st.items(spark, sf).select("hs_code").distinct()
    return hs.enrich_hs(codes).select("hs_code", "hs_short", "hs_label", "hs_chapter_label")


@query("top_hs", with_tables("""
SELECT hs_code, count(*) AS items FROM items WHERE hs_code <> '' GROUP BY 1 ORDER BY items DESC, hs_code LIMIT 12"""))
def top_hs(spark, sf):
    return agg.top_hs(st.items(spark, sf)).select("hs_code", "items")


@query("facets", with_tables("""
SELECT DISTINCT facet, value FROM (
  SELECT 'brand' AS facet, brand AS value FROM items UNION ALL SELECT 'hs_code', hs_code FROM items
  UNION ALL SELECT 'owner', owner FROM dispatches UNION ALL SELECT 'importer', importer FROM dispatches
  UNION ALL SELECT 'origin', origin FROM dispatches UNION ALL SELECT 'year', CAST(year(date) AS VARCHAR) FROM dispatches)
WHERE value IS NOT NULL AND value <> ''"""))
def facets(spark, sf):
    return agg.distinct_facets(st.items(spark, sf), st.dispatches(spark, sf)).select("facet", "value")


@query("hs_option_labels", with_tables("""
SELECT DISTINCT hs_code AS value, CASE WHEN hs_code LIKE '9999%' THEN hs_code
  ELSE substr(regexp_replace(hs_code, '[^0-9]', '', 'g'), 1, 4) || '.' || substr(regexp_replace(hs_code, '[^0-9]', '', 'g'), 5, 2)
    || '.' || substr(regexp_replace(hs_code, '[^0-9]', '', 'g'), 7, 2) || ' - Perfumes y aguas de tocador' END AS label
FROM items WHERE hs_code LIKE '9999%' OR hs_code LIKE '3303%'"""))
def hs_option_labels(spark, sf):
    facets = agg.distinct_facets(st.items(spark, sf), st.dispatches(spark, sf))
    return facets.filter("facet = 'hs_code' AND (value LIKE '9999%' OR value LIKE '3303%')").select("value", "label")


@query("apply_brand_rules", with_tables("""
, rules AS (SELECT DISTINCT upper(p_brand) AS pattern, 'HOUSE ' || (CAST(substr(p_brand, 7) AS INTEGER) % 5) AS target
  FROM part WHERE CAST(substr(p_brand, 7) AS INTEGER) % 2 = 0)
SELECT id, CASE WHEN coalesce(brand, '') = '' THEN 'Sin Marca' ELSE coalesce(target, brand) END AS brand
FROM items LEFT JOIN rules ON upper(trim(brand)) = pattern"""))
def apply_brand_rules(spark, sf):
    number = F.regexp_extract("p_brand", r"#(\d+)", 1).cast("int")
    rules = st.read_table(spark, sf, "part").filter(number % 2 == 0).select(
        F.concat(F.lit(" "), F.lower("p_brand")).alias("pattern"), F.concat(F.lit("HOUSE "), (number % 5).cast("string")).alias("target")).distinct()
    return br.apply_brand_rules(st.items(spark, sf), rules).select("id", "brand")


@query("brand_skeleton_clusters", with_tables(_SPELLED + """
, groups AS (
  SELECT skeleton, count(*) AS variants, sum(items) AS all_items, min(struct_pack(n := -items, brand := brand)) AS best
  FROM summary GROUP BY skeleton HAVING count(*) > 1)
SELECT best.brand AS suggested, variants, CAST(all_items + best.n AS BIGINT) AS affected_items, summary.brand, items
FROM groups JOIN summary USING (skeleton)"""))
def brand_skeleton_clusters(spark, sf):
    summary = st.items_with_brand_spellings(spark, sf).groupBy("brand").agg(F.count("*").alias("items"))
    return br.same_name_clusters(summary).select("suggested", "variants", "affected_items", "brand", "items")


@query("cluster_totals", with_tables(_SPELLED + """
, groups AS (
  SELECT skeleton, count(*) AS variants, sum(items) AS all_items, min(struct_pack(n := -items, brand := brand)) AS best
  FROM summary GROUP BY skeleton HAVING count(*) > 1)
SELECT best.brand AS suggested, variants, CAST(all_items + best.n AS BIGINT) AS affected_items FROM groups"""))
def cluster_totals(spark, sf):
    summary = st.items_with_brand_spellings(spark, sf).groupBy("brand").agg(F.count("*").alias("items"))
    return br.cluster_totals(br.same_name_clusters(summary)).select("suggested", "variants", "affected_items")


_NAMES = """
, names AS (
  SELECT upper(p_name) AS brand, replace(upper(p_name), ' ', '') AS skeleton, count(*) AS items
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
"""


def _names_as_brands(spark, sf):
    """Part names in the role of brands: enough of them are a letter or two apart."""
    parts = st.read_table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.upper("p_name").alias("brand"))
    lines = st.read_table(spark, sf, "lineitem").select("l_partkey")
    return lines.join(parts, "l_partkey").groupBy("brand").agg(F.count("*").alias("items"))


@query("brand_fuzzy_pairs", with_tables(_NAMES + """
SELECT a.skeleton, b.skeleton AS other, CAST(levenshtein(a.skeleton, b.skeleton) AS INTEGER) AS distance
FROM names a JOIN names b ON a.skeleton < b.skeleton AND levenshtein(a.skeleton, b.skeleton) <= 2"""))
def brand_fuzzy_pairs(spark, sf):
    return br.brand_pairs(br.comparable_brands(_names_as_brands(spark, sf)))


_TYPO_SQL = with_tables(_NAMES + """
, ranked AS (SELECT *, row_number() OVER (ORDER BY items DESC, brand) AS rank FROM names),
near AS (
  SELECT a.rank, list(b.rank) AS later FROM ranked a JOIN ranked b
    ON a.rank < b.rank AND levenshtein(a.skeleton, b.skeleton) BETWEEN 1 AND 2 GROUP BY a.rank),
walk AS (
  WITH RECURSIVE g(i, used, links) AS (
    SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS STRUCT(seed BIGINT, member BIGINT)[])
    UNION ALL
    SELECT i + 1, CASE WHEN list_contains(used, i + 1) THEN used ELSE list_concat(used, coalesce(later, [])) END,
      CASE WHEN list_contains(used, i + 1) THEN links ELSE list_concat(links, list_transform(
        list_filter(coalesce(later, []), lambda x: NOT list_contains(used, x)), lambda x: {'seed': i + 1, 'member': x})) END
    FROM g LEFT JOIN near ON near.rank = i + 1 WHERE i < (SELECT count(*) FROM ranked))
  SELECT unnest(links, recursive := true) FROM g WHERE i = (SELECT count(*) FROM ranked)),
members AS (SELECT seed, member FROM walk UNION SELECT seed, seed FROM walk)
SELECT s.brand AS suggested, m.brand, m.items FROM members JOIN ranked s ON s.rank = seed JOIN ranked m ON m.rank = member""")


@query("brand_typo_clusters", _TYPO_SQL)
def brand_typo_clusters(spark, sf):
    return br.typo_clusters(_names_as_brands(spark, sf)).select("suggested", "brand", "items")


@query("brand_clusters", _TYPO_SQL.replace("SELECT s.brand AS suggested, m.brand, m.items FROM", "SELECT seed, s.brand AS suggested, m.brand, m.items FROM", 1).replace(
    "SELECT seed, s.brand", ", typos AS (SELECT seed, s.brand", 1) + f""")
{_SPELLED}
, groups AS (
  SELECT skeleton, count(*) AS variants, sum(items) AS all_items, min(struct_pack(n := -items, brand := brand)) AS best
  FROM summary GROUP BY skeleton HAVING count(*) > 1)
SELECT '{fv.CLUSTER_REASON_SAME}' AS reason, best.brand AS suggested, variants, CAST(all_items + best.n AS BIGINT) AS affected_items, summary.brand, items
FROM groups JOIN summary USING (skeleton)
UNION ALL
SELECT '{fv.CLUSTER_REASON_TYPO}', suggested, count(*) OVER (PARTITION BY seed), CAST(sum(CASE WHEN brand <> suggested THEN items ELSE 0 END) OVER (PARTITION BY seed) AS BIGINT), brand, items
FROM typos""")
def brand_clusters(spark, sf):
    spelled = st.items_with_brand_spellings(spark, sf).groupBy("brand").agg(F.count("*").alias("items"))
    return br.brand_clusters(spelled.unionByName(_names_as_brands(spark, sf)))


def _sheet_lines(spark, sf):
    return st.items(spark, sf).select(F.col("id").alias("catalog_item_id"), "dispatch_id", "brand", "quantity")


def _labels(spark, sf):
    parts = st.read_table(spark, sf, "part")
    first = F.initcap(F.split("p_name", " ")[0])
    return parts.select("p_brand", "p_name").distinct().filter(F.col("p_name").startswith("red ")).select(
        F.concat_ws("|", "p_brand", "p_name").alias("id"), F.upper("p_brand").alias("brand"), first.alias("family"),
        F.initcap(F.split("p_name", " ")[1]).alias("clean_name"), F.upper("p_name").alias("search_pattern"))


def _tables(spark, sf):
    rules = st.read_table(spark, sf, "part").select(F.upper("p_brand").alias("pattern"), F.lit("OLD").alias("target")).distinct()
    return {"items": st.items(spark, sf), "sheet_items": _sheet_lines(spark, sf), "brand_labels": _labels(spark, sf),
            "brand_rules": rules}


@query("unify_brands", with_tables("""
SELECT id, CASE WHEN upper(trim(brand)) IN ('BRAND#1', 'BRAND#2', 'BRAND#3') THEN 'HOUSE' ELSE brand END AS brand FROM items"""))
def unify_brands(spark, sf):
    return br.unify_brands(_tables(spark, sf), ["Brand#1", " brand#2", "BRAND#3", "House"], " house ")["items"].select("id", "brand")


@query("unify_brands_counts", with_tables("""
SELECT 'items' AS "table", count(*) FILTER (upper(brand) IN ('BRAND#1', 'BRAND#2')) AS changed FROM items
UNION ALL SELECT 'sheet_items', count(*) FILTER (upper(brand) IN ('BRAND#1', 'BRAND#2')) FROM items
UNION ALL SELECT 'brand_labels', count(*) FILTER (upper(p_brand) IN ('BRAND#1', 'BRAND#2'))
  FROM (SELECT DISTINCT p_brand, p_name FROM part WHERE p_name LIKE 'red %')"""))
def unify_brands_counts(spark, sf):
    return br.unify_brands(_tables(spark, sf), ["Brand#1", "Brand#2"], "HOUSE")["counts"]


@query("unify_brands_rules", with_tables("""
SELECT DISTINCT upper(p_brand) AS pattern, CASE WHEN upper(p_brand) IN ('BRAND#1', 'BRAND#2') THEN 'HOUSE' ELSE 'OLD' END AS target FROM part"""))
def unify_brands_rules(spark, sf):
    return br.list_rules(br.unify_brands(_tables(spark, sf), ["Brand#1", "Brand#2"], "HOUSE")["brand_rules"])


@query("rename_brand", with_tables("""
SELECT id, CASE WHEN brand = 'Brand#4' THEN 'OTHER' ELSE brand END AS brand FROM items"""))
def rename_brand(spark, sf):
    return br.rename_brand(_tables(spark, sf), "Brand#4", "other")["items"].select("id", "brand")


@query("upsert_and_delete_rules", with_tables("""
SELECT DISTINCT upper(p_brand) AS pattern,
  CASE WHEN CAST(substr(p_brand, 7) AS INTEGER) % 2 = 0 THEN 'EVEN' ELSE 'OLD' END AS target
FROM part WHERE p_brand NOT IN ('Brand#7', 'Brand#8')"""))
def upsert_and_delete_rules(spark, sf):
    rules = _tables(spark, sf)["brand_rules"]
    even = F.regexp_extract("pattern", r"#(\d+)", 1).cast("int") % 2 == 0
    changes = rules.filter(even).select(F.lower("pattern").alias("pattern"), F.lit("even").alias("target"))
    return br.delete_rules(br.upsert_rules(rules, changes), ["brand#7", "Brand#8 "])


@query("replace_labels", with_tables("""
SELECT upper(p_brand) AS brand, 'Red' AS family, upper(p_name) AS search_pattern
FROM (SELECT DISTINCT p_brand, p_name FROM part WHERE p_name LIKE 'red %') WHERE p_brand <> 'Brand#5'
UNION ALL SELECT 'brand#5', NULL, 'PAT A' UNION ALL SELECT 'brand#5', 'F', 'PAT C'"""))
def replace_labels(spark, sf):
    entries = [{"family": " ", "clean_name": "A", "search_pattern": "PAT A "}, {"family": "x", "clean_name": "", "search_pattern": "P"},
               {"family": "F", "clean_name": "C", "search_pattern": "PAT C"}]
    return br.replace_labels(_labels(spark, sf), " brand#5 ", entries).select("brand", "family", "search_pattern")


@query("delete_label", with_tables("""
SELECT p_brand || '|' || p_name AS id FROM (SELECT DISTINCT p_brand, p_name FROM part WHERE p_name LIKE 'red %')
WHERE NOT (p_brand = 'Brand#5' AND p_name = 'red rod')"""))
def delete_label(spark, sf):
    return br.delete_label(_labels(spark, sf), "Brand#5|red rod").select("id")


_TREE = """
, words AS (
  SELECT brand, upper(substr(w1, 1, 1)) || lower(substr(w1, 2)) AS family, upper(substr(w2, 1, 1)) || lower(substr(w2, 2)) AS variant
  FROM (SELECT brand, split_part(description, ' ', 1) AS w1, split_part(description, ' ', 2) AS w2 FROM items WHERE brand <> ''))
"""


@query("family_variant_counts", with_tables(_TREE + """
SELECT brand, family, variant, count(*) AS items, upper(family || ' ' || variant) AS search_pattern FROM words GROUP BY ALL"""))
def family_variant_counts(spark, sf):
    return br.family_variant_counts(st.items(spark, sf))


@query("facet_hierarchy", with_tables(_TREE + """
, labels AS (SELECT DISTINCT p_brand AS brand, 'Red' AS family, upper(substr(p_name, 5, 1)) || substr(p_name, 6) AS variant
  FROM part WHERE p_name LIKE 'red %'),
used AS (SELECT DISTINCT brand FROM words),
merged AS (
  SELECT brand, family, variant, CAST(sum(n) AS BIGINT) AS items, max(c) AS is_custom FROM (
    SELECT brand, family, variant, count(*) AS n, false AS c FROM words GROUP BY ALL
    UNION ALL SELECT CASE WHEN used.brand IS NULL THEN upper(labels.brand) ELSE labels.brand END, family, variant, 0, true
      FROM labels LEFT JOIN used USING (brand)) GROUP BY ALL)
SELECT brand, family, variant, items, is_custom, CAST(sum(items) OVER (PARTITION BY brand, family) AS BIGINT) AS family_items FROM merged"""))
def facet_hierarchy(spark, sf):
    tree = br.facet_hierarchy(st.items(spark, sf), _labels(spark, sf))
    return tree.select("brand", "family", "variant", "items", "is_custom", "family_items")


@query("facet_hierarchy_of_brand", with_tables(_TREE + """
SELECT CASE WHEN variant = 'Ring' THEN family || ' - Ring' ELSE family || ' - ' || variant END AS name, count(*) AS items
FROM words WHERE brand = 'Brand#9' GROUP BY ALL ORDER BY lower(any_value(family)), lower(any_value(variant)) LIMIT 100"""))
def facet_hierarchy_of_brand(spark, sf):
    no_labels = _labels(spark, sf).filter("false")
    tree = br.facet_hierarchy(st.items(spark, sf), no_labels, "Brand#9").orderBy(*br.variant_order())
    return tree.select(goods.display_variant("family", "variant").alias("name"), "items").limit(100)


@query("top_brand_hierarchy", with_tables(_TREE + """
, best AS (SELECT brand FROM items WHERE brand <> '' GROUP BY 1 ORDER BY count(*) DESC, brand LIMIT 15)
SELECT brand, family, variant, count(*) AS items FROM words WHERE brand IN (SELECT brand FROM best) GROUP BY ALL"""))
def top_brand_hierarchy(spark, sf):
    return br.top_brand_hierarchy(st.items(spark, sf), _labels(spark, sf).filter("false")).select("brand", "family", "variant", "items")


@query("detect_brand", with_tables("""
, texts AS (
  SELECT id, CASE WHEN item_no % 2 = 0 THEN description ELSE description || ' (' || coalesce(brand, '') || ')' END AS text,
    CASE WHEN item_no % 2 = 1 AND coalesce(brand, '') <> '' THEN brand ELSE '' END AS detected_brand FROM items)
SELECT id, text, detected_brand FROM texts"""))
def detect_brand(spark, sf):
    items = st.items(spark, sf)
    texts = items.select("id", F.when(F.col("item_no") % 2 == 0, F.col("description")).otherwise(
        F.concat("description", F.lit(" ("), F.coalesce("brand", F.lit("")), F.lit(")"))).alias("text"))
    return br.detect_brand(texts, br.registered_brands(items), "text").select("id", "text", "detected_brand")


@query("brand_skeleton", with_tables("""
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(strip_accents(upper(replace(text, 'ß', 'ss'))), '[^\\x00-\\x7F]', '', 'g'),
  '[^A-Z0-9]+', ' ', 'g'),
  '\\b(INC|CORP|LLC|SA|SRL|LTDA|COMPANY|CO|PERFUME|PERFUMES|ELECTRONICS|OFFICIAL|GLOBAL|PARFUMS|PARFUM|BEAUTY|COSMETICS)\\b', ' ', 'g'),
  ' +', '', 'g') AS skeleton FROM documents"""))
def brand_skeleton(spark, sf):
    return st.read_table(spark, sf, "documents").select("doc_id", text.brand_skeleton("text").alias("skeleton"))
