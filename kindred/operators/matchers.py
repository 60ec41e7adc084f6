"""The six matchers. Each gives pairs of entities with a confidence and the values that matched.

Result columns: entity_id_1 < entity_id_2, method_type, confidence_score,
pre_rl_confidence_score, match_values (tagged JSON). ``tune`` may replace the
first score by what the tuner chose for the method.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions import address as adr
from kindred.functions import constants as K
from kindred.functions import contact, geo, names, urls
from kindred.functions.similarity import jaro_winkler
from kindred.functions.vectors import cosine
from kindred.operators.blocking import best_blocked_pairs, exclude_existing, flagged_rows, one_payload, packed_join, packed_members, present
from kindred.sources.io import tagged
from kindred.sources.storage import materialize, spread_join

RESULT = ["entity_id_1", "entity_id_2", "method_type", "confidence_score", "pre_rl_confidence_score", "match_values"]
Tune = Callable[[DataFrame], DataFrame]

NAME_FUZZY, NAME_SEMANTIC, NAME_KEEP, NAME_DROP = 0.92, 0.94, 0.93, 0.92 * 0.9
NAME_WEIGHTS = (0.3, 0.7)
TOP_TOKENS, MIN_SHARED, COMMON_SHARE, COMMON_LEAST = 10, 2, 0.05, 10


def _result(pairs: DataFrame, method: str, tag: str, values: Column, score: str, existing: DataFrame | None, tune: Tune | None) -> DataFrame:
    if existing is not None:
        pairs = exclude_existing(pairs, existing, method)
    out = pairs.select("entity_id_1", "entity_id_2", F.lit(method).alias("method_type"), F.col(score).alias("confidence_score"), F.col(score).alias("pre_rl_confidence_score"), tagged(tag, values).alias("match_values"))
    return tune(out).select(RESULT) if tune else out


def email_keys(rows: DataFrame) -> DataFrame:
    """Rows (entity_id, email) as one row a key and entity: normalised, the smallest spelling kept."""
    keyed = rows.where(present(F.col("email"))).select("entity_id", F.col("email").alias("original"), contact.normalize_email(F.col("email")).alias("key"))
    return one_payload(keyed.where("key != ''"), ["key", "entity_id"], ["original"])


def email_scored(rows: DataFrame) -> DataFrame:
    """Pairs that share an address: both ends, key, both originals, score."""
    keyed = materialize(email_keys(rows), "emails")
    often = spread_join(keyed, keyed.groupBy("key").agg(F.count("*").alias("frequency")), ["key"])
    own = often.withColumn("own", contact.email_confidence(F.col("key"), F.col("frequency")))
    return best_blocked_pairs(own.select("key", "entity_id", "original", "own"), "key", "entity_id", ["original"], lambda p: p.withColumnRenamed("own_1", "score").drop("own_2"), ["own"])


def match_emails(rows: DataFrame, existing: DataFrame | None = None, tune: Tune | None = None) -> DataFrame:
    values = F.struct(F.col("original_1").alias("original_email1"), F.col("original_2").alias("original_email2"), F.col("key").alias("normalized_shared_email"))
    return _result(email_scored(rows), "email", "Email", values, "score", existing, tune)


def phone_keys(rows: DataFrame) -> DataFrame:
    keyed = rows.where(present(F.col("number"))).select("entity_id", F.col("number").alias("original"), F.when(F.trim("extension") != "", F.trim("extension")).alias("extension"), contact.normalize_phone(F.col("number")).alias("key"))
    return one_payload(keyed.where("key != ''"), ["key", "entity_id"], ["original", "extension"])


def phone_scored(rows: DataFrame) -> DataFrame:
    """Pairs that share a number: both ends, key, both originals and extensions, score."""
    return best_blocked_pairs(phone_keys(rows), "key", "entity_id", ["original", "extension"], lambda p: p.withColumn("score", contact.phone_confidence(F.col("extension_1"), F.col("extension_2"))))


def match_phones(rows: DataFrame, existing: DataFrame | None = None, tune: Tune | None = None) -> DataFrame:
    values = F.struct(F.col("original_1").alias("original_phone1"), F.col("original_2").alias("original_phone2"), F.col("key").alias("normalized_shared_phone"), F.col("extension_1").alias("extension1"), F.col("extension_2").alias("extension2"))
    return _result(phone_scored(rows), "phone", "Phone", values, "score", existing, tune)


def url_keys(rows: DataFrame) -> DataFrame:
    keyed = rows.where(F.col("url").isNotNull()).select("entity_id", F.col("url").alias("original"), urls.url_domain(F.col("url")).alias("key"), urls.url_slugs(F.col("url")).alias("slugs"))
    keyed = keyed.where(F.col("key").isNotNull() & ~urls.is_ignored_domain(F.col("key")))
    return one_payload(keyed, ["key", "entity_id"], ["original", "slugs"])


def url_scored(rows: DataFrame, originals: bool = True) -> DataFrame:
    """Pairs that share a domain: both ends, key, slug_count, score, and both originals if wanted."""
    keyed = url_keys(rows).withColumn("prefixes", urls.slug_prefixes(F.col("slugs"))).drop("slugs")
    payload = ["original"] if originals else []
    return best_blocked_pairs(keyed.select("key", "entity_id", "prefixes", *payload), "key", "entity_id", payload, _url_scores, ["prefixes"])


def url_totals(rows: DataFrame) -> DataFrame:
    """One row, if there are pairs: how many :func:`url_scored` gives (``n``), the sum ``s`` of their ``k`` scores, and entities_matched.

    Pairs are counted by the prefixes that entities of a domain share, and so
    are not made; only those of two entities that both have several domains are.
    """
    keyed = url_keys(rows).where("entity_id is not null").select("key", "entity_id", urls.slug_prefixes(F.col("slugs")).alias("prefixes"))
    kept = flagged_rows(keyed, "key", "entity_id")
    m = F.sum(F.col("_many").cast("long"))
    # of n rows with m of the several, the pairs that aren't two of these
    pairs = (F.count("*") * (F.count("*") - 1) - m * (m - 1)).alias("twice")
    at = kept.select("key", "_many", F.posexplode(F.concat(F.array(F.lit("")), "prefixes")).alias("d", "p")).groupBy("key", "d", "p").agg(pairs)
    same = kept.select("key", "_many", F.size("prefixes").alias("d"), F.coalesce(F.try_element_at("prefixes", F.lit(-1)), F.lit("")).alias("p")).groupBy("key", "d", "p").agg(pairs)
    half = lambda x, name: x.groupBy("d").agg((F.sum("twice") / 2).alias(name))
    deep = half(at, "least").join(half(at, "more").withColumn("d", F.col("d") - 1), "d", "left").join(half(same, "equal"), "d", "left").fillna(0.0)
    n, s = F.col("least") - F.col("more"), K.URL_FULL_CONFIDENCE * F.col("equal")
    counted = deep.select(n.alias("n"), (s + (n - F.col("equal")) * urls.segment_confidence(F.col("d"))).alias("s"))
    if not kept.where("_many").isEmpty():
        again = best_blocked_pairs(kept.where("_many").drop("_many"), "key", "entity_id", [], _url_scores, ["prefixes"])
        counted = counted.unionByName(again.agg(F.count("*").cast("double").alias("n"), F.sum("score").alias("s")))
    total = counted.agg(F.sum("n").cast("long").alias("n"), F.sum("s").alias("s")).where("n > 0")
    return total.crossJoin(kept.agg(F.count_distinct("entity_id").alias("entities_matched"))).withColumn("k", F.col("n"))  # one row each


def _url_scores(pairs: DataFrame) -> DataFrame:
    a, b = F.col("prefixes_1"), F.col("prefixes_2")
    return pairs.withColumn("slug_count", urls.shared_prefixes(a, b)).withColumn("score", urls.prefix_confidence(a, b, F.col("slug_count"))).drop("prefixes_1", "prefixes_2")


def match_urls(rows: DataFrame, existing: DataFrame | None = None, tune: Tune | None = None) -> DataFrame:
    values = F.struct(F.col("original_1").alias("original_url1"), F.col("original_2").alias("original_url2"), F.col("key").alias("normalized_shared_domain"), F.col("slug_count").alias("matching_slug_count"))
    return _result(url_scored(rows), "url", "Url", values, "score", existing, tune)


def match_addresses(rows: DataFrame, existing: DataFrame | None = None, tune: Tune | None = None, glue: bool = False) -> DataFrame:
    """Rows (entity_id, address_1, address_2, city, state_province, postal_code, country)."""
    c = F.col
    rows = rows.where(present(c("address_1")) & present(c("city"))).withColumn("original", adr.full_address(c("address_1"), c("address_2"), c("city"), c("state_province"), c("postal_code"), c("country")))
    keyed = rows.select("entity_id", "original", adr.normalize_address(c("original"), glue).alias("key"), adr.extract_unit(c("original"), glue).alias("unit")).where("key != ''")
    pairs = best_blocked_pairs(one_payload(keyed, ["key", "entity_id"], ["original", "unit"]), "key", "entity_id", ["original", "unit"], lambda p: p.withColumn("score", adr.address_confidence(c("unit_1"), c("unit_2"))))
    values = F.struct(c("original_1").alias("original_address1"), c("original_2").alias("original_address2"), c("key").alias("normalized_shared_address"), c("score").cast("float").alias("pairwise_match_score"))
    return _result(pairs, "address", "Address", values, "score", existing, tune)


def name_index(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities (entity_id, original, name, kind), their tokens, and each token's frequency and idf."""
    named = rows.where(present(F.col("name"))).select("entity_id", F.col("name").alias("original"), names.normalize_name(F.col("name")).alias("n")).select("entity_id", "original", "n.name", "n.kind").where("name != ''")
    tokens = named.select("entity_id", F.explode(names.name_tokens(F.col("name"), F.col("kind"))).alias("token"))
    total = named.agg(F.count("*").alias("total"))
    stats = tokens.groupBy("token").agg(F.count("*").alias("frequency")).crossJoin(F.broadcast(total)).withColumn("idf", F.log(F.col("total") / (F.col("frequency") + 1)))  # the total is one row
    return named, tokens, stats


def top_tokens(tokens: DataFrame, stats: DataFrame, n: int = TOP_TOKENS) -> DataFrame:
    """The rarest tokens of each entity, none that more than a twentieth of all entities have (ten may always)."""
    rare = stats.where((F.col("frequency") <= F.greatest(F.floor(F.col("total") * COMMON_SHARE), F.lit(COMMON_LEAST))) & (F.octet_length("token") >= 2))
    w = Window.partitionBy("entity_id").orderBy(F.col("idf").desc(), "token")
    return tokens.join(rare.select("token", "idf"), "token").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("entity_id", "token", "idf", "rank")


def token_candidates(tokens: DataFrame, top: DataFrame, shared: int = MIN_SHARED) -> DataFrame:
    """Pairs of which the larger entity's top tokens hold at least ``shared`` of the smaller one's tokens.

    Only tokens that are somebody's top token can meet, and these are bounded in frequency.
    """
    a = tokens.select("token", F.col("entity_id").alias("entity_id_1"))
    b = top.select("token", F.col("entity_id").alias("entity_id_2"))
    return a.join(b, "token").where("entity_id_1 < entity_id_2").groupBy("entity_id_1", "entity_id_2").agg(F.count("*").alias("overlap")).where(F.col("overlap") >= shared)


def score_names(pairs: DataFrame) -> DataFrame:
    """Candidate pairs with name, kind and embedding of both sides, scored and cut at the thresholds."""
    c = F.col
    pairs = pairs.where(names.compatible_types(c("kind_1"), c("kind_2"))).withColumn("fuzzy", jaro_winkler(c("name_1"), c("name_2")).cast("float")).where(c("fuzzy") >= NAME_DROP)
    pairs = pairs.withColumn("semantic", F.coalesce(cosine(c("embedding_1"), c("embedding_2")), F.lit(0.0)).cast("float"))
    combined = c("semantic") >= F.lit(NAME_SEMANTIC).cast("float")
    fuzzy = c("fuzzy") >= F.lit(NAME_FUZZY).cast("float")
    pairs = pairs.withColumn("match_type", F.when(combined, "combined").when(fuzzy, "fuzzy")).where("match_type is not null")
    base = F.when(combined, NAME_WEIGHTS[0] * c("fuzzy") + NAME_WEIGHTS[1] * c("semantic")).otherwise(c("fuzzy"))
    factor = names.domain_factor(c("name_1"), c("name_2"), c("kind_1"), c("kind_2"))
    return pairs.withColumn("score", (base * factor).cast("float").cast("double")).where(c("score") >= F.lit(NAME_KEEP).cast("float").cast("double"))


def match_names(rows: DataFrame, embeddings: DataFrame | None = None, existing: DataFrame | None = None, tune: Tune | None = None) -> DataFrame:
    """Rows (entity_id, name); ``embeddings`` (entity_id, embedding) may lack entities."""
    named, tokens, stats = name_index(rows)
    found = token_candidates(tokens, top_tokens(tokens, stats)).drop("overlap")
    if existing is not None:
        found = exclude_existing(found, existing, "name")
    side = named.join(embeddings, "entity_id", "left") if embeddings is not None else named.withColumn("embedding", F.lit(None).cast("array<float>"))
    for i in "12":
        found = found.join(side.select(*[F.col(x).alias(f"{x}_{i}") for x in ("entity_id", "original", "name", "kind", "embedding")]), f"entity_id_{i}")
    scored = score_names(found)
    values = F.struct(F.col("original_1").alias("original_name1"), F.col("original_2").alias("original_name2"), F.col("name_1").alias("normalized_name1"), F.col("name_2").alias("normalized_name2"), F.col("match_type").alias("pre_rl_match_type"))
    return _result(scored, "name", "Name", values, "score", None, tune)


def near_pairs(points: DataFrame, metres: float, most_latitude: float = 85.0) -> DataFrame:
    """Pairs of points (entity_id, lat, lon) at most ``metres`` apart, with the distance.

    Points fall into grid cells at least as wide as the distance up to
    ``most_latitude``; one side is sent to the nine cells around it, around the
    globe too. Rows of cells that reach beyond that latitude are one cell each.
    Every pair meets in one cell. Latitudes beyond 90 degrees are no points.
    Further columns are given of both sides (``_1``, ``_2``). The distance is
    taken once for two places, whatever entities are there, and a cell with very
    many entities is dealt to many tasks.
    """
    sides = geo.cell_degrees(metres, most_latitude)
    points = points.where(F.col("lat").isNotNull() & F.col("lon").isNotNull() & (F.abs("lat") <= 90))
    # the longitudes that two points so near can differ by, at the last latitude of the grid
    reach = math.sin(min(metres / geo.EARTH_METRES, math.pi) / 2) / math.cos(math.radians(most_latitude))
    columns = max(int(360 // max(math.degrees(2 * math.asin(min(reach, 1.0))) * 1.0001, sides[1])), 1)
    y = geo.cell(F.col("lat"), F.col("lon"), sides)[0]
    x = F.least(F.floor(F.pmod(F.col("lon") + 180, F.lit(360.0)) * (columns / 360)).cast("long"), F.lit(columns - 1))
    polar = lambda row: (row * sides[0] - 90 < -most_latitude) | ((row + 1) * sides[0] - 90 > most_latitude)
    placed = lambda dy, dx: F.struct((F.col("y") + dy).alias("y"), F.when(polar(F.col("y") + dy), F.lit(0)).otherwise(F.pmod(F.col("x") + dx, F.lit(columns))).cast("long").alias("x"))
    extra = [x for x in points.columns if x not in ("entity_id", "lat", "lon")]
    # entities at one place are one row, or one for so many of them
    home = packed_members(points, ["lat", "lon", *extra], "entity_id").withColumn("y", y).withColumn("x", x)
    around = F.explode(F.array_distinct(F.array(*[placed(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)])))
    side = lambda i, cell: home.select(F.col("members").alias(f"_m{i}"), F.size("members").alias(f"_weight_{i}"), *[F.col(x).alias(f"{x}_{i}") for x in ("lat", "lon", *extra, "pack")], cell.alias("c")).select("*", "c.y", "c.x").drop("c")
    met = packed_join(side(1, around), side(2, placed(0, 0)), ["y", "x"], "_weight", ["lat", "lon", *extra, "pack"])
    met = met.withColumn("metres", geo.haversine(F.col("lat_1"), F.col("lon_1"), F.col("lat_2"), F.col("lon_2"))).where(F.col("metres") <= metres)
    rest = ["lat_1", "lon_1", "lat_2", "lon_2", "metres", *[f"{x}_{i}" for x in extra for i in "12"]]
    one = met.select(*rest, F.explode("_m1").alias("entity_id_1"), "_m2")
    return one.select("entity_id_1", *rest, F.explode("_m2").alias("entity_id_2")).where("entity_id_1 < entity_id_2")


def match_locations(points: DataFrame, existing: DataFrame | None = None, tune: Tune | None = None, metres: float = K.GEO_METRES, limit: int | None = None) -> DataFrame:
    """Entities with locations near each other; ``limit`` keeps the nearest new pairs of a run."""
    places = points.where("lat is not null and lon is not null").select("entity_id", "lat", "lon").distinct()
    flagged = spread_join(places, places.groupBy("entity_id").agg((F.count("*") > 1).alias("many")), ["entity_id"])
    near = near_pairs(flagged, metres)
    # only two entities that both have several places can meet twice
    w = Window.partitionBy("entity_id_1", "entity_id_2").orderBy("metres", "lat_1", "lon_1", "lat_2", "lon_2")
    again = near_pairs(flagged.where("many"), metres).withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")
    pairs = near.where(~(F.col("many_1") & F.col("many_2"))).unionByName(again).drop("many_1", "many_2").withColumn("score", F.lit(0.85))
    if existing is not None:
        pairs = exclude_existing(pairs, existing, "geospatial")
    if limit is not None:
        pairs = pairs.orderBy("metres", "entity_id_1", "entity_id_2").limit(limit)
    values = F.struct(F.col("lat_1").alias("latitude1"), F.col("lon_1").alias("longitude1"), F.col("lat_2").alias("latitude2"), F.col("lon_2").alias("longitude2"), F.col("metres").alias("distance"))
    return _result(pairs, "geospatial", "Geospatial", values, "score", None, tune)
