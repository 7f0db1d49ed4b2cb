"""Product names: cleaning, spelling, lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import growers, keys, text
from ..operators import index, lines, review, settling, strains
from .tables import listings, shops, table


def _titles(spark, sf_dir):
    """Titles as a menu would print them: brand, name, size and lineage."""
    rows = table(spark, sf_dir, "part")
    title = F.concat_ws(" ", "p_brand", "p_name", F.concat(F.col("p_size").cast("string"), F.lit("g")), F.when(F.col("p_partkey") % 3 == 0, "Indica").otherwise("Flower"))
    return rows.select("p_partkey", "p_brand", "p_name", title.alias("title"))


def reviewed_names(spark, sf_dir):
    out = review.reviewed(_titles(spark, sf_dir), "title", "p_brand")
    return out.select("p_partkey", F.col("reviewed.name").alias("name"), F.array_join("reviewed.why", ",").alias("why"))


def review_reasons(spark, sf_dir):
    return review.reasons(review.reviewed(_titles(spark, sf_dir), "title", "p_brand"))


def settled_names(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name")
    return review.settled(rows, "p_brand", "p_name").select("p_partkey", "settled")


def settled_listings(spark, sf_dir):
    """Line items as listings of a brand; every seventh has its words turned about, every eleventh
    packaging beside it, every thirteenth a plural."""
    number = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    swapped = F.array_join(F.reverse(F.split("p_name", " ")), " ")
    name = F.when(number % 7 == 0, swapped).when(number % 11 == 0, F.concat("p_name", F.lit(" - Flower"))).when(number % 13 == 0, F.concat("p_name", F.lit("s"))).otherwise(F.col("p_name"))
    rows = listings(spark, sf_dir).select((number * 10_000_000 + F.col("l_partkey")).alias("id"), F.col("p_brand").alias("grower"), F.col("l_suppkey").alias("shop"), F.col("p_brand").alias("brand"), name.alias("name"))
    return settling.settle(rows).groupBy("grower", "name", F.array_join("why", ",").alias("why")).agg(F.count("*").alias("n"), F.countDistinct("shop").alias("shops"))


def grower_pools(spark, sf_dir):
    """Brand keys as they are signed: as they stand, with a tail of a known kind, and with one of none."""
    brand = F.regexp_replace(F.lower("p_brand"), "[^a-z0-9]", "")
    signed = F.concat(F.regexp_replace(brand, "^brand", F.lit("b")), F.get(F.array(F.lit(""), F.lit("og"), F.lit("micro"), F.lit("x")), (F.col("p_partkey") % 4).cast("int")))
    return growers.pools(table(spark, sf_dir, "part").select(signed.alias("key")), "key")


def trimmed_names(spark, sf_dir):
    rows = listings(spark, sf_dir).select("p_name", "l_suppkey").distinct()
    return review.trimmed_to_shelf(rows, "p_name", "l_suppkey").select("p_name", "trimmed").distinct()


def product_lines(spark, sf_dir):
    return review.line_candidates(table(spark, sf_dir, "part"), "p_brand", "p_name", 2)


#: Names of two pieces or three, in SQL of both engines: a brand's line and a cultivar, every third the
#: other way round, every fifth with packaging, every seventh with a cultivar of another part beside it.
_LINED = """SELECT (l_orderkey * 8 + l_linenumber) * 10000000 + l_partkey AS id, p_brand AS brand, concat(split_part(p_name, ' ', 1), ' Cut') AS lined, concat(split_part(p_name, ' ', 2), ' Kush ', CAST(p_size AS VARCHAR(9))) AS cultivar,
    CASE WHEN l_orderkey % 7 = 0 THEN concat(split_part(p_name, ' ', 2), ' Haze ', CAST(l_orderkey % 10 AS VARCHAR(9))) END AS third, l_orderkey % 3 AS turn, l_orderkey % 5 AS packed FROM {0} JOIN {1} ON l_partkey = p_partkey"""
_NAMED = "concat(CASE WHEN turn = 0 THEN concat(cultivar, ' - ', lined) ELSE concat(lined, ' - ', cultivar) END, coalesce(' - ' || third, ''), CASE WHEN packed = 0 THEN ' | Small Jars' ELSE '' END)"


def line_graph(spark, sf_dir):
    rows = spark.sql(_LINED.format("{items}", "{parts}"), items=table(spark, sf_dir, "lineitem"), parts=table(spark, sf_dir, "part")).selectExpr("id", "brand", _NAMED + " AS name")
    return lines.candidates(rows).withColumn("examples", F.array_join("examples", "; "))


def spelling_mode(spark, sf_dir):
    rows = listings(spark, sf_dir)
    return index.tied_mode(rows, ["p_brand"], "p_type", "spelling").select("p_brand", "spelling", F.col("spelling_count").alias("n"))


def loose_keys(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(keys.loose_key(F.col("p_name")).alias("k"), "p_name")
    return rows.groupBy("k").agg(F.countDistinct("p_name").alias("names"))


def canonical_names(spark, sf_dir):
    """Names out of titles in every form: as segments, run together, with grade in front and behind."""
    rows = table(spark, sf_dir, "part").selectExpr(
        "p_partkey", "p_brand",
        """CASE p_partkey % 8 WHEN 0 THEN concat(p_brand, ' - ', p_name, ' - Premium Flower') WHEN 1 THEN concat(p_name, ' | 3.5g | Indica') WHEN 2 THEN concat(p_brand, ' ', p_name, ' Flower')
        WHEN 3 THEN concat('Premium Indoor ', p_name, ' Sativa') WHEN 4 THEN concat(p_name, ': Small Buds') WHEN 5 THEN 'Flower 3.5g' WHEN 6 THEN concat(p_brand, ' Flower- ', p_name, '™ (Hybrid)') ELSE concat('GG4 - ', p_brand) END AS title""",
    )
    return strains.canonical_strains(rows, "p_partkey", "title", "p_brand")


def flower_reasons(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(text.flower_reason(F.col("p_name"), F.when(F.col("p_size") % 2 == 0, "Flower").when(F.col("p_size") % 3 == 0, "Edible")).alias("reason"))
    return rows.groupBy("reason").agg(F.count("*").alias("n"))


def shop_addresses(spark, sf_dir):
    rows = shops(spark, sf_dir).select("s_suppkey", text.canonical_address(F.concat(F.col("s_suppkey").cast("string"), F.lit(" West "), F.initcap("n_name"), F.lit(" Street, Suite 4B"))).alias("address"))
    return rows


_PACKAGE = "(?i)" + review.PACKAGE

ALL = {
    "reviewed_names": (
        reviewed_names,
        f"WITH t AS (SELECT p_partkey, p_name, p_partkey % 3 = 0 AS i, trim(regexp_replace(regexp_replace(p_name, '{_PACKAGE}', ' ', 'g'), '\\s+', ' ', 'g')) AS bare FROM part) SELECT p_partkey, bare AS name, 'brand,weight' || CASE WHEN i THEN ',lineage' ELSE '' END || CASE WHEN NOT i OR bare <> p_name THEN ',package' ELSE '' END AS why FROM t",
    ),
    "review_reasons": (
        review_reasons,
        f"SELECT why, count(*) AS n FROM (SELECT unnest(['brand', 'weight', CASE WHEN p_partkey % 3 = 0 THEN 'lineage' END, CASE WHEN p_partkey % 3 <> 0 OR regexp_matches(p_name, '{_PACKAGE}') THEN 'package' END]) AS why FROM part) WHERE why IS NOT NULL GROUP BY why",
    ),
    "settled_names": (settled_names, None),
    "settled_listings": (
        settled_listings,
        """WITH l AS (SELECT p_brand AS grower, l_suppkey AS shop, l_orderkey * 8 + l_linenumber AS k, p_name FROM lineitem JOIN part ON l_partkey = p_partkey),
        a AS (SELECT *, CASE WHEN k % 7 = 0 THEN array_to_string(list_reverse(string_split(p_name, ' ')), ' ') WHEN k % 11 = 0 THEN p_name || ' - Flower' WHEN k % 13 = 0 THEN p_name || 's' ELSE p_name END AS name FROM l),
        n1 AS (SELECT grower, name, count(DISTINCT shop) AS shops FROM a GROUP BY ALL),
        b AS (SELECT a.*, coalesce(n1.name, a.name) AS name1 FROM a LEFT JOIN n1 ON n1.grower = a.grower AND a.name LIKE '% - Flower' AND n1.name = replace(a.name, ' - Flower', '')),
        n2 AS (SELECT grower, name1, array_to_string(list_sort(string_split(name1, ' ')), ' ') AS words, count(DISTINCT shop) AS shops FROM b GROUP BY ALL),
        t2 AS (SELECT grower, words, arg_max(name1, shops) AS top, list(shops ORDER BY shops DESC) AS s FROM n2 GROUP BY ALL),
        c AS (SELECT b.*, CASE WHEN len(s) > 1 AND s[1] > s[2] THEN top ELSE name1 END AS name2 FROM b JOIN n2 USING (grower, name1) JOIN t2 USING (grower, words)),
        n3 AS (SELECT grower, name2, count(DISTINCT shop) AS shops FROM c GROUP BY ALL),
        m3 AS (SELECT x.grower, x.name2, y.name2 AS major FROM n3 x JOIN n3 y ON x.grower = y.grower AND (x.name2 = y.name2 || 's' OR y.name2 = x.name2 || 's') AND y.shops > x.shops AND len(replace(x.name2, ' ', '')) >= 6),
        d AS (SELECT c.*, coalesce(major, name2) AS name3 FROM c LEFT JOIN m3 USING (grower, name2))
        SELECT grower, name3 AS name, CASE WHEN name1 <> name THEN 'beside the cultivar' ELSE '' END || CASE WHEN name1 <> name AND name3 <> name1 THEN ',' ELSE '' END || CASE WHEN name3 <> name1 THEN 'same strain, other spelling' ELSE '' END AS why,
          count(*) AS n, count(DISTINCT shop) AS shops FROM d GROUP BY ALL""",
    ),
    "grower_pools": (
        grower_pools,
        """WITH k AS (SELECT DISTINCT 'b' || regexp_replace(lower(p_brand), '[^0-9]', '', 'g') || ['', 'og', 'micro', 'x'][p_partkey % 4 + 1] AS k FROM part),
        p AS (SELECT s.k AS short, l.k AS long, substr(l.k, len(s.k) + 1) AS rest FROM k s JOIN k l ON l.k <> s.k AND starts_with(l.k, s.k))
        SELECT least(short, long) AS key, greatest(short, long) AS other FROM p WHERE rest IN ('micro', 'smallbatch') OR len(short) >= 6 OR (len(short) >= 4 AND (rest = 'og' OR regexp_matches(rest, '^[0-9]+$')))""",
    ),
    "trimmed_names": (trimmed_names, None),
    "product_lines": (
        product_lines,
        "WITH w AS (SELECT p_brand, string_split_regex(p_name, '\\s+') AS a FROM part) SELECT p_brand, a[1] AS line, count(DISTINCT array_to_string(a[2:], ' ')) AS partners FROM w WHERE len(a) > 1 GROUP BY ALL HAVING partners >= 2",
    ),
    "line_graph": (
        line_graph,
        f"""WITH l AS ({_LINED.format("lineitem", "part")}), w AS (SELECT row_number() OVER () AS n, id, brand, {_NAMED} AS name, CASE WHEN turn = 0 THEN [cultivar, lined] ELSE [lined, cultivar] END || CASE WHEN third IS NULL THEN [] ELSE [third] END AS p FROM l),
        e AS (SELECT n, id, brand, name, unnest(p) AS piece, unnest(range(len(p))) AS place FROM w),
        k AS (SELECT *, regexp_replace(regexp_replace(lower(piece), '^(small|large) |[^a-z0-9]', '', 'g'), 's$', '') AS k FROM e),
        d AS (SELECT DISTINCT n, brand, k FROM k), pairs AS (SELECT x.brand, x.n, x.k AS a, y.k AS c FROM d x JOIN d y ON x.n = y.n AND x.k <> y.k),
        deg AS (SELECT brand, a AS k, count(DISTINCT c) AS partners FROM pairs GROUP BY ALL),
        j AS (SELECT pairs.brand, a, u.partners AS pa, v.partners AS pc FROM pairs JOIN deg u ON u.brand = pairs.brand AND u.k = a JOIN deg v ON v.brand = pairs.brand AND v.k = c),
        f AS (SELECT brand, a AS k, max(pa) AS partners, count(*) FILTER (pa >= 3 AND pa >= 2 * pc) AS as_line, count(*) FILTER (pc >= 3 AND pc >= 2 * pa) AS as_name FROM j GROUP BY ALL HAVING as_line > as_name),
        v AS (SELECT brand, k, name, min(id) AS first FROM k GROUP BY ALL), x AS (SELECT brand, k, array_to_string(list(name ORDER BY first)[1:4], '; ') AS examples FROM v GROUP BY ALL),
        s AS (SELECT brand, k, arg_min(piece, id * 10 + place) AS line FROM k GROUP BY ALL)
        SELECT * FROM f JOIN x USING (brand, k) JOIN s USING (brand, k)""",
    ),
    "spelling_mode": (
        spelling_mode,
        "SELECT p_brand, p_type AS spelling, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand, p_type QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, (p_type = upper(p_type) AND regexp_matches(p_type, '[A-Z]')) ASC, p_type) = 1",
    ),
    "loose_keys": (
        loose_keys,
        r"""WITH w AS (SELECT DISTINCT p_name, unnest(string_split_regex(lower(p_name), '[^a-z0-9]+')) AS w, generate_subscripts(string_split_regex(lower(p_name), '[^a-z0-9]+'), 1) AS i FROM part),
        a AS (SELECT p_name, i, CASE WHEN regexp_matches(w, '^.{2,}ies$') THEN regexp_replace(w, 'ies$', 'i') WHEN regexp_matches(w, '^.{3,}[sz]$') THEN regexp_replace(w, '[sz]$', '') ELSE w END AS w FROM w WHERE w <> ''),
        b AS (SELECT p_name, i, CASE WHEN regexp_matches(w, '^.{2,}ie$') THEN regexp_replace(w, 'e$', '') WHEN regexp_matches(w, '^.{3,}y$') THEN regexp_replace(w, 'y$', 'i') ELSE w END AS w FROM a),
        c AS (SELECT p_name, i, unnest(range(1, len(w) + 1)) AS j, w FROM b),
        k AS (SELECT p_name, string_agg(w[j], '' ORDER BY i, j) FILTER (WHERE j = 1 OR w[j] <> w[j - 1]) AS k FROM c GROUP BY p_name)
        SELECT k, count(DISTINCT p_name) AS names FROM k GROUP BY k""",
    ),
    "canonical_names": (canonical_names, "SELECT p_partkey, CASE p_partkey % 8 WHEN 5 THEN NULL WHEN 7 THEN 'GG4' WHEN 2 THEN regexp_replace(p_name, '^(small|large|new) ', '') WHEN 3 THEN regexp_replace(p_name, '^(small|large|new) ', '') ELSE p_name END AS strain FROM part"),
    "flower_reasons": (
        flower_reasons,
        "SELECT CASE WHEN p_size % 2 = 0 THEN 'flower' WHEN p_size % 3 = 0 THEN 'category-not-flower' ELSE 'no-category' END AS reason, count(*) AS n FROM part GROUP BY 1",
    ),
    "shop_addresses": (
        shop_addresses,
        "SELECT s_suppkey, s_suppkey || ' w ' || array_to_string(list_filter(string_split_regex(lower(n_name), '[^a-z0-9]+'), lambda x: x <> ''), ' ') || ' st' AS address FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    ),
}
