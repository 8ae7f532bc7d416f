"""Registered queries on filters, constraints, titles, profiles and the catalogue, each with its DuckDB counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlake.functions import text as T
from cairnlake.operators import filters, fuzzy, profiles
from cairnlake.session import table

ASOF = "2001-08-01"


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("category"), F.col("p_size").alias("year"))


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user, item, rating, ts, order, line) from order lines."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    both = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return both.select(F.col("o_custkey").alias("user"), F.col("l_partkey").alias("item"), (1 + F.pmod(F.col("l_quantity").cast("long"), F.lit(5))).alias("rating"), F.col("o_orderdate").alias("ts"), F.col("l_orderkey").alias("ord"), F.col("l_linenumber").alias("line"))


def _strings(*values: str):
    return F.array(*map(F.lit, values))


def filter_exclude_ids(spark, sf_dir):
    items = parts(spark, sf_dir)
    return items.where(filters.admitted(items, excluded=_strings("0", "17", "123", "1999", ""))).select("item_id")


def filter_exclude_tokens(spark, sf_dir):
    items = parts(spark, sf_dir)
    return items.where(filters.admitted(items, genres=_strings("red Bolt", "gizmo", "!"))).select("item_id", "category")


def filter_require_phrase(spark, sf_dir):
    items = parts(spark, sf_dir)
    return items.where(filters.admitted(items, required=_strings("Small ring", "ring small", "blue", "?"))).select("item_id", "category")


def filter_year_range(spark, sf_dir):
    items = parts(spark, sf_dir).withColumn("year", F.when(F.col("item_id") % 7 != 0, F.col("year")))
    cases = [("both", 10, 20), ("low", 40, None), ("high", None, 5), ("open", None, None)]
    found = [items.where(filters.admitted(items, low=F.lit(a).cast("int"), high=F.lit(b).cast("int"))).select(F.lit(name).alias("bounds"), "item_id") for name, a, b in cases]
    return found[0].unionAll(found[1]).unionAll(found[2]).unionAll(found[3])


def filter_empty_reasons(spark, sf_dir):
    return filters.empty_reasons(parts(spark, sf_dir), 900, 999, ["small ring"])


def fuzzy_title_match(spark, sf_dir):
    """The name of every fiftieth part, spelt wrongly by rule, looked up among all names."""
    part = table(spark, sf_dir, "part")
    key, name = F.floor(F.col("p_partkey") / 50) % 4, F.col("p_name")
    spoilt = F.when(key == 0, F.concat(F.substring(name, 2, 100), F.lit("e"))).when(key == 1, F.regexp_replace(name, "[aeo]", "")).when(key == 2, F.concat(F.upper(name), F.lit("!"))).otherwise(F.reverse(name))
    lookups = part.where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("lookup_id"), spoilt.alias("title"))
    titles = part.groupBy("p_name").agg(F.min("p_partkey").alias("item_id")).select("item_id", F.col("p_name").alias("title"))
    return fuzzy.best_titles(lookups, titles).withColumn("ratio", F.round("ratio", 6))


def profile_top_categories(spark, sf_dir):
    rows = filters.liked(ratings(spark, sf_dir)).join(table(spark, sf_dir, "part"), F.col("item") == F.col("p_partkey"))
    return profiles.top_values(rows.withColumn("categories", F.concat_ws(" , ", "p_type", F.lit(" "), "p_brand", F.get(F.split("p_name", " "), 0))), "user", "categories", ["ord", "line", "item"])


def profile_top_languages(spark, sf_dir):
    """The five commonest brands of each user, as languages are counted: unsplit, nulls left out."""
    rows = filters.liked(ratings(spark, sf_dir)).join(table(spark, sf_dir, "part"), F.col("item") == F.col("p_partkey"))
    return profiles.top_values(rows.withColumn("language", F.when(F.col("item") % 5 != 0, F.col("p_brand"))), "user", "language", ["ord", "line", "item"], k=5, separator=None)


def profile_sample_titles(spark, sf_dir):
    rows = filters.liked(ratings(spark, sf_dir)).join(table(spark, sf_dir, "part"), F.col("item") == F.col("p_partkey"))
    return profiles.sample_titles(rows, "user", "p_name", "item")


def profile_long_short(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("value"))
    out = profiles.taste_windows(rows, "user", "ts", "value", F.lit(ASOF).cast("timestamp"), 365)
    return out.withColumns({"mean_long": F.round("mean_long", 8), "mean_short": F.round("mean_short", 8)})


def profile_demographics(spark, sf_dir):
    """A demographic line of each customer, with parts missing by rule."""
    nation = table(spark, sf_dir, "nation")
    rows = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    year = F.when(F.col("c_custkey") % 3 != 0, 1950 + F.col("c_custkey") % 50)
    line = T.demographic_text(year, F.when(F.col("c_custkey") % 2 == 0, "female"), F.col("c_mktsegment"), F.col("n_name"), F.lit(ASOF).cast("timestamp"))
    return rows.select("c_custkey", line.alias("demographic"))


def liked_semi_join(spark, sf_dir):
    """Each liked part once, however often it was liked."""
    liked = filters.liked(ratings(spark, sf_dir)).select(F.col("item").alias("p_partkey"))
    return table(spark, sf_dir, "part").join(liked, "p_partkey", "left_semi").select("p_partkey", "p_name")


def rated_exclusions(spark, sf_dir):
    own = ratings(spark, sf_dir)
    return profiles.rated_exclusions(own, own.groupBy("user").agg(F.min("item").alias("target")))


def catalog_dedupe(spark, sf_dir):
    return profiles.merged_products(table(spark, sf_dir, "part"), "p_name", "p_brand", "p_partkey", ["p_type", "p_retailprice"])


def catalog_category_parse(spark, sf_dir):
    code = F.concat(F.element_at(F.array(*map(F.lit, ["Men", "ladies", "divided", "newborn", "home-ware", ""])), (F.col("p_partkey") % 6 + 1).cast("int")), F.lit("_"), F.regexp_replace("p_name", " ", "_"), F.lit("_t-shirts"))
    wearer, kind = T.category_parts(code)
    return table(spark, sf_dir, "part").select("p_partkey", wearer.alias("wearer"), kind.alias("kind"))


def catalog_description(spark, sf_dir):
    line = T.labelled({"Brand": F.col("p_brand"), "Type": F.when(F.col("p_partkey") % 5 != 0, F.col("p_type")).otherwise(" "), "Price": T.price_text(F.col("p_retailprice"))}, F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", line.alias("description"))


def field_texts(spark, sf_dir):
    """The text that an index embeds: nulls keep their place."""
    gap = F.when(F.col("p_partkey") % 4 != 0, F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", T.field_text([F.col("p_name"), gap, F.col("p_type")]).alias("text"))


def rating_rescale(spark, sf_dir):
    raw = table(spark, sf_dir, "lineitem").select((1 + F.pmod(F.col("l_orderkey") + F.col("l_linenumber"), F.lit(10))).alias("raw"))
    return raw.groupBy("raw", profiles.rescaled_rating(F.col("raw")).alias("rating")).agg(F.count("*").alias("n"))


def rating_dates(spark, sf_dir):
    """Order dates spelt out and parsed back; every fifth is spoilt and becomes null."""
    spelt = F.when(F.col("o_orderkey") % 5 != 0, F.date_format("o_orderdate", "d MMMM yyyy")).otherwise("soon")
    return table(spark, sf_dir, "orders").select("o_orderkey", profiles.iso_date(spelt).alias("day"))


def active_users(spark, sf_dir):
    return profiles.active(table(spark, sf_dir, "orders"), "o_custkey")


def interaction_import(spark, sf_dir):
    """Ratings of active users with known items, their rank by time: the interaction table that simulations start from."""
    own = ratings(spark, sf_dir)
    users = profiles.active(own.join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user")), "user", "left_semi"), "user")
    kept = own.join(users.select("user"), "user", "left_semi")
    return kept.groupBy("user").agg(F.count("*").alias("n"), F.min_by("item", F.struct("ts", "ord", "line", "item")).alias("first_item"), F.max_by("item", F.struct("ts", "ord", "line", "item")).alias("last_item"))


RATINGS = "r AS (SELECT o_custkey AS \"user\", l_partkey AS item, 1 + l_quantity::BIGINT % 5 AS rating, o_orderdate AS ts, l_orderkey AS ord, l_linenumber AS line FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
WORDS = "list_transform({}, lambda g: regexp_extract_all(lower(g), '\\w+'))"
LCS = "list_reduce(list_prepend(list_transform(range(len(b) + 1), lambda z: 0), list_transform(range(len(a)), lambda z: [z::INT])), lambda prev, x: list_reduce(list_prepend([0], list_transform(range(len(b)), lambda z: [z::INT])), lambda cur, y: list_append(cur, greatest(cur[len(cur)], prev[y[1] + 2], prev[y[1] + 1] + CASE WHEN a[x[1] + 1] = b[y[1] + 1] THEN 1 ELSE 0 END))))"

QUERIES = {
    "filter_exclude_ids": (filter_exclude_ids, "SELECT p_partkey AS item_id FROM part WHERE p_partkey::VARCHAR NOT IN ('0', '17', '123', '1999', '')"),
    "filter_exclude_tokens": (filter_exclude_tokens, "SELECT p_partkey AS item_id, p_name AS category FROM part WHERE NOT list_has_any(regexp_extract_all(lower(p_name), '\\w+'), ['red', 'bolt', 'gizmo'])"),
    "filter_require_phrase": (filter_require_phrase, "SELECT p_partkey AS item_id, p_name AS category FROM part WHERE (' ' || array_to_string(regexp_extract_all(lower(p_name), '\\w+'), ' ') || ' ') SIMILAR TO '.*( small ring | ring small | blue ).*'"),
    "filter_year_range": (filter_year_range, "WITH p AS (SELECT p_partkey AS item_id, CASE WHEN p_partkey % 7 <> 0 THEN p_size END AS year FROM part) SELECT 'both' AS bounds, item_id FROM p WHERE year BETWEEN 10 AND 20 UNION ALL SELECT 'low', item_id FROM p WHERE year >= 40 UNION ALL SELECT 'high', item_id FROM p WHERE year <= 5 UNION ALL SELECT 'open', item_id FROM p"),
    "filter_empty_reasons": (filter_empty_reasons, "SELECT 'year_range' AS reason, count_if(p_size BETWEEN 900 AND 999)::BIGINT AS hits FROM part UNION ALL SELECT 'require_any_genre', count_if(' ' || p_name || ' ' LIKE '% small ring %')::BIGINT FROM part"),
    "fuzzy_title_match": (fuzzy_title_match, rf"WITH l AS (SELECT p_partkey AS lookup_id, CASE (p_partkey // 50) % 4 WHEN 0 THEN substr(p_name, 2) || 'e' WHEN 1 THEN regexp_replace(p_name, '[aeo]', '', 'g') WHEN 2 THEN upper(p_name) || '!' ELSE reverse(p_name) END AS title FROM part WHERE p_partkey % 50 = 0), t AS (SELECT min(p_partkey) AS item_id, p_name FROM part GROUP BY p_name), p AS (SELECT lookup_id, item_id, trim(regexp_replace(lower(title), '[^\p{{L}}\p{{N}}]', ' ', 'g')) AS a, trim(regexp_replace(lower(p_name), '[^\p{{L}}\p{{N}}]', ' ', 'g')) AS b FROM l, t), c AS (SELECT lookup_id, item_id, 200.0::DOUBLE * list_last({LCS}) / (len(a) + len(b)) AS ratio FROM p WHERE a <> '') SELECT lookup_id::BIGINT AS lookup_id, item_id, round(ratio, 6) AS ratio FROM c WHERE ratio >= 80 QUALIFY row_number() OVER (PARTITION BY lookup_id ORDER BY ratio DESC, item_id) = 1"),
    "profile_top_categories": (profile_top_categories, f"WITH {RATINGS}, s AS (SELECT \"user\", ord, line, item, unnest([p_type, p_brand, string_split(p_name, ' ')[1]]) AS value, generate_subscripts([1, 2, 3], 1) AS k FROM r JOIN part ON item = p_partkey WHERE rating > 3), g AS (SELECT \"user\", value, count(*) AS n, min((ord, line, item, k)) AS f FROM s GROUP BY ALL) SELECT \"user\", row_number() OVER (PARTITION BY \"user\" ORDER BY n DESC, f)::INT AS rank, value, n FROM g QUALIFY rank <= 8"),
    "profile_top_languages": (profile_top_languages, f"WITH {RATINGS}, g AS (SELECT \"user\", p_brand AS value, count(*) AS n, min((ord, line, item)) AS f FROM r JOIN part ON item = p_partkey WHERE rating > 3 AND item % 5 <> 0 GROUP BY ALL) SELECT \"user\", row_number() OVER (PARTITION BY \"user\" ORDER BY n DESC, f)::INT AS rank, value, n FROM g QUALIFY rank <= 5"),
    "profile_sample_titles": (profile_sample_titles, f"WITH {RATINGS}, d AS (SELECT DISTINCT \"user\", item, p_name FROM r JOIN part ON item = p_partkey WHERE rating > 3), o AS (SELECT *, row_number() OVER (PARTITION BY \"user\" ORDER BY item) AS n FROM d QUALIFY n <= 8) SELECT \"user\", string_agg(p_name, '|' ORDER BY n) AS titles FROM o GROUP BY \"user\""),
    "profile_long_short": (profile_long_short, f"WITH g AS (SELECT o_custkey AS \"user\", count(*) AS n_long, count_if(o_orderdate >= TIMESTAMP '{ASOF}' - INTERVAL 365 DAY)::BIGINT AS n_short, avg(o_totalprice) AS l, avg(CASE WHEN o_orderdate >= TIMESTAMP '{ASOF}' - INTERVAL 365 DAY THEN o_totalprice END) AS s FROM orders GROUP BY ALL) SELECT \"user\", n_long, n_short, round(l, 8) AS mean_long, round(coalesce(s, l), 8) AS mean_short, n_short = 0 AS fallback FROM g"),
    "profile_demographics": (profile_demographics, "SELECT c_custkey, concat_ws(', ', CASE WHEN c_custkey % 3 <> 0 THEN (2001 - (1950 + c_custkey % 50))::VARCHAR || ' years old' END, CASE WHEN c_custkey % 2 = 0 THEN 'female' END, c_mktsegment, 'from ' || n_name) AS demographic FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey"),
    "liked_semi_join": (liked_semi_join, f"WITH {RATINGS} SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT item FROM r WHERE rating > 3)"),
    "rated_exclusions": (rated_exclusions, f"WITH {RATINGS} SELECT \"user\", min(item) AS target, count(DISTINCT item) - 1 AS n_excluded FROM r GROUP BY \"user\""),
    "catalog_dedupe": (catalog_dedupe, "SELECT p_name, string_agg(DISTINCT p_brand, ', ' ORDER BY p_brand) AS variants, count(*) AS n, min(p_partkey) AS p_partkey, min_by(p_type, p_partkey) AS p_type, min_by(p_retailprice, p_partkey) AS p_retailprice FROM part GROUP BY p_name"),
    "catalog_category_parse": (catalog_category_parse, "SELECT p_partkey, ['Men', 'Women', 'Divided', 'Newborn', 'Home-Ware', ''][p_partkey % 6 + 1] AS wearer, array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') || ' T-Shirts' AS kind FROM part"),
    "catalog_description": (catalog_description, "SELECT p_partkey, concat_ws(' | ', 'Brand: ' || p_brand, CASE WHEN p_partkey % 5 <> 0 THEN 'Type: ' || p_type END, 'Price: ' || printf('$%.2f', p_retailprice), p_name) AS description FROM part"),
    "field_texts": (field_texts, "SELECT p_partkey, p_name || ' ' || CASE WHEN p_partkey % 4 <> 0 THEN p_brand ELSE '' END || ' ' || p_type AS text FROM part"),
    "rating_rescale": (rating_rescale, "SELECT raw, greatest(1, round_even(raw / 2, 0)::INT)::INT AS rating, count(*) AS n FROM (SELECT 1 + (l_orderkey + l_linenumber) % 10 AS raw FROM lineitem) GROUP BY ALL"),
    "rating_dates": (rating_dates, "SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders"),
    "active_users": (active_users, "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 3"),
    "interaction_import": (interaction_import, f"WITH {RATINGS} SELECT \"user\", count(*) AS n, min_by(item, (ts, ord, line, item)) AS first_item, max_by(item, (ts, ord, line, item)) AS last_item FROM r WHERE \"user\" IN (SELECT c_custkey FROM customer) GROUP BY \"user\" HAVING count(*) >= 3"),
}
