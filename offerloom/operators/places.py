"""Places: city keys, metropolitan areas, distances, and what a location label proves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.functions.scalars import haversine_km
from offerloom.functions.text import fold, let, location_key, slug, squeeze, without_country
from offerloom.functions.values import CITIES, COUNTRIES, DEPARTMENTS, NOT_A_PLACE, REGIONS, REMOTE_MARKERS, REMOTE_QUALIFIERS, REMOTE_WORDS
from offerloom.session import shared_table

#: How many districts a city has, and its own department.
DISTRICTS = {"paris": (20, 75), "lyon": (9, 69), "marseille": (16, 13)}
ORDINAL = "^([0-9]{1,2})(er|e|eme)?$"


def _of_city(city: Column, at: int) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for c, v in DISTRICTS.items() for x in (c, v[at])]), city)


def _literals(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def district(plain: Column) -> Column:
    """(city, number, bare) of a squeezed label "city number [arrondissement] [department]" of a city with districts, else null."""

    def of(words: Column) -> Column:
        second = F.try_element_at(words, F.lit(2))
        rest = F.slice(words, F.when(F.try_element_at(words, F.lit(3)) == "arrondissement", 4).otherwise(3), F.lit(9))
        fits = words[0].isin(*DISTRICTS) & F.coalesce(second.rlike(ORDINAL), F.lit(False)) & (F.size(rest) <= 1) & F.forall(rest, lambda w: w.isin(*DEPARTMENTS))
        number_ = F.regexp_extract(second, ORDINAL, 1).try_cast("int")
        return F.when(fits, F.struct(words[0].alias("city"), number_.alias("number"), ((F.size(words) == 2) & second.rlike("^[0-9]+$")).alias("bare")))

    return let(F.split(plain, " "), of)


def city_key(c: Column) -> Column:
    """Districts of Paris, Lyon and Marseille keep their number; a bare own department is the city; else T6."""

    def key(c: Column) -> Column:
        shown = lambda d: F.when(d["bare"] & (d["number"] == _of_city(d["city"], 1)), d["city"]).otherwise(F.concat_ws(" ", d["city"], d["number"].cast("string")))
        return let(district(squeeze(without_country(fold(c)))), lambda d: F.when(d.isNull(), location_key(c)).otherwise(shown(d)))

    return let(c, key)


def municipality(key: Column) -> Column:
    """A district that exists is its city."""
    own = lambda key: let(district(key), lambda d: F.when(d["number"].between(1, _of_city(d["city"], 0)), d["city"]).otherwise(key))
    return let(key, own)


def clauses(c: Column) -> Column:
    """The clauses of a label: cut at commas, bars, semicolons, parentheses, spaced dashes, and slashes other than in "jours/semaine"."""
    parts = F.split(c, r"[,|;()]|(?<=\s)[-–—](?=\s)|(?<!(?i:\bjours?)\s{0,9})/|/(?!\s*(?i:semaine\b))")
    return F.filter(F.transform(parts, lambda x: F.btrim(x)), lambda x: F.length(x) > 0)


def _typed(kind: str, key: Column | None = None) -> Column:
    return F.struct(F.lit(kind).alias("kind"), (F.lit("") if key is None else key).alias("key"))


#: What a word or glued phrase of a clause says about remote work; any other word may name a place.
SAYS = {
    **dict.fromkeys((*REMOTE_MARKERS, "a_distance"), "mode"),
    **dict.fromkeys((*REMOTE_QUALIFIERS, "selon_accord", "selon_accords", "a_convenir", "jours_"), "manner"),
    **dict.fromkeys(("full", "share_"), "amount"),
    "a": "at",
    "en": "in",
}
#: Phrases that count as one word.
GLUED = {r"a distance": "a_distance", r"(?:[0-9]{1,2} pourcent|100(?: pourcent)?)": "share_", r"selon accord": "selon_accord", r"selon accords": "selon_accords", r"a convenir": "a_convenir", r"[0-9]+ jours?(?: par)?(?: semaine)?": "jours_"}


def remote_words(clause: Column) -> Column:
    """The words of a clause's key, with GLUED phrases as one word each."""
    key = location_key(F.replace(clause, F.lit("%"), F.lit(" pourcent ")))
    for phrase, word in GLUED.items():
        key = F.regexp_replace(key, rf"\b{phrase}\b", word)
    return F.split(key, " ")


def _is_remote(key: Column) -> Column:
    return F.arrays_overlap(F.split(key, " "), _literals(REMOTE_MARKERS)) | F.concat(F.lit(" "), key, F.lit(" ")).contains(" a distance ")


def _run(says: Column, *kinds: str) -> Column:
    """How many entries at the beginning are of some kinds."""
    stop = F.array_position(F.transform(says, lambda k: k.isin(*kinds)), F.lit(False))
    return F.when(stop == 0, F.size(says)).otherwise(stop - 1).cast("int")


def span_beside_mode(words: Column) -> Column:
    """(stands, span): the words of a clause that may name a place, and where they stand to its remote mode, in one scan from either end:
    at or in (after the mode and that preposition), after, before, or apart (the mode is in the middle of other words)."""
    told = F.create_map(*[F.lit(x) for pair in SAYS.items() for x in pair])

    def scan(says: Column) -> Column:
        start = _run(says, "amount", "in")
        manner = _run(F.slice(says, start + 2, F.size(says)), "manner", "amount")
        opens = F.try_element_at(says, start + 1) == "mode"
        link = start + manner + 2  # the place after the mode and what it is said to be like
        back = F.reverse(says)
        end = _run(back, "manner", "amount")
        closes = F.try_element_at(back, end + 1) == "mode"
        lead = F.size(says) - end - 1 - _run(F.slice(back, end + 2, F.size(says)), "amount", "in")
        found = lambda stands, span: F.struct(stands.alias("stands"), span.alias("span"))
        linked = opens & F.try_element_at(says, link).isin("at", "in") & (link < F.size(says))
        return (
            F.when(linked, found(F.try_element_at(says, link), F.slice(words, link + 1, F.size(words))))
            .when(opens, found(F.lit("after"), F.slice(words, start + 2, F.size(words))))
            .when(closes, found(F.lit("before"), F.slice(words, F.lit(1), lead)))
            .otherwise(found(F.lit("apart"), F.array().cast("array<string>")))
        )

    return let(F.transform(words, lambda w: F.coalesce(F.element_at(told, w), F.lit("name"))), scan)


def _clause(key: Column, beside: Column, remote_context: Column) -> Column:
    """What one clause proves, by its T6 key and, with a remote mode in it, the span beside that. A clause without a key, or a bare
    department, proves nothing. How a span is tied to the rest decides what it may prove:

    | tied                     | region or country | descriptor of remote work, placeholder | other    |
    | nothing else             | non_city          | unknown                                | place    |
    | "a", or before the mode  | non_city          | descriptor                             | place    |
    | "en"                     | non_city          | descriptor (unknown without a mode)    | as left  |
    | after the mode           | non_city          | descriptor                             | as left  |
    | apart                    | unknown           | unknown                                | unknown  |
    """
    own = F.split(key, " ")
    mode = _is_remote(key)
    first = F.when((F.size(own) > 1) & own[0].isin("a", "en"), F.when(own[0] == "a", "at").otherwise("in"))
    # "a" and "en" at the beginning tie what follows before any mode does
    tied = F.when(first.isNotNull(), first).when(mode, beside["stands"]).otherwise("alone")
    words = F.when(first.isNotNull(), F.slice(own, 2, F.size(own))).when(mode, beside["span"]).otherwise(own)
    said = F.struct(tied.alias("tied"), words.alias("words"), (mode & first.isNull()).alias("by_mode"))

    def proves(x: Column) -> Column:
        name = F.array_join(x["words"], " ")
        wide = name.isin(*COUNTRIES, *REGIONS)
        empty = F.forall(x["words"], lambda w: w.rlike("^[0-9]*$") | w.isin("a", "en"))
        about = name.isin("", *NOT_A_PLACE) | name.contains("_") | F.arrays_overlap(x["words"], _literals(REMOTE_WORDS)) | _is_remote(name)
        descriptor = F.when(x["by_mode"] | (x["tied"] != "in"), _typed("remote_descriptor")).otherwise(_typed("unknown"))
        return (
            F.when(x["tied"] == "apart", _typed("unknown"))
            .when((x["tied"] == "alone") & remote_context & F.arrays_overlap(x["words"], _literals(REMOTE_WORDS)), _typed("remote_descriptor"))
            .when(wide, _typed("non_city", name))
            .when(x["tied"] == "alone", _typed("place", name))
            .when(x["tied"].isin("in", "after") | about | (x["by_mode"] & (x["tied"] == "at") & empty), descriptor)
            .otherwise(_typed("place", name))
        )

    return F.when(key.isin("", *DEPARTMENTS), _typed("skip")).when(key.isin(*NOT_A_PLACE), _typed("unknown")).otherwise(let(said, proves))


def evidence(labels: DataFrame, column: str = "location") -> DataFrame:
    """(label, kind, key) of the distinct labels of a column; kind is place, non_city, unknown or conflict.

    A null label is unknown. Labels are few against rows, so callers join this back; they are written first, as a filter on kind or key
    would else be worked out on every row before the distinct ones are found.
    """
    rows = shared_table(labels.select(F.col(column).alias("label")).distinct(), "labels")
    # One clause before a last ", France" is typed as it is, dashes at its ends apart
    rows = rows.withColumn("bare", without_country_as_is(F.btrim(F.coalesce("label", F.lit("")))))
    bare = F.col("bare")
    one = (F.length(bare) < F.length(F.btrim("label"))) & (F.size(clauses(bare)) == 1) & (clauses(bare)[0] == bare) & ~bare.rlike("^[-–—]|[-–—]$")
    rows = rows.withColumn("one", F.coalesce(one, F.lit(False)))
    rows = rows.withColumn("parts", F.when(F.col("one"), F.array(bare)).otherwise(clauses(F.coalesce("label", F.lit("")))))
    # used often below, so that they stay columns of their own
    rows = rows.withColumn("keys", F.transform("parts", location_key)).withColumn("words", F.transform("parts", remote_words))
    rows = rows.withColumn("beside", F.transform("words", span_beside_mode)).withColumn("remote", F.transform("keys", _is_remote))
    rows = rows.withColumn("in_remote", F.exists("remote", lambda r: r) & ~F.col("one"))
    each = F.arrays_zip("keys", "beside")
    rows = rows.withColumn("typed", F.transform(each, lambda x: _clause(x["keys"], x["beside"], F.col("in_remote"))))
    of = lambda kind: F.array_distinct(F.filter("typed", lambda t: t["kind"] == kind))
    rows = rows.select("label", "typed", "remote", of("place").alias("places"), of("non_city").alias("scopes"), of("unknown").alias("unknown"))
    bearing = F.exists(F.arrays_zip("typed", "remote"), lambda x: (x["typed"]["kind"] == "place") & x["remote"])
    concrete = F.size("places") + F.size("scopes")
    kind = (
        F.when((F.size(F.filter("remote", lambda r: r)) > 1) & bearing, _typed("unknown"))
        .when((F.size("places") > 0) & (F.size("scopes") > 0), _typed("conflict"))
        .when(F.size("places") > 1, _typed("unknown"))
        .when((F.size("scopes") > 1) | ((concrete > 0) & (F.size("unknown") > 0)), _typed("conflict"))
        .when(F.size("places") > 0, F.try_element_at("places", F.lit(1)))
        .when(F.size("scopes") > 0, F.try_element_at("scopes", F.lit(1)))
        .otherwise(_typed("unknown"))
    )
    return rows.select("label", kind["kind"].alias("kind"), kind["key"].alias("key"))


def without_country_as_is(label: Column) -> Column:
    """A label without its last ", France", "(France)" or spaced "- France", in its own spelling."""
    part = lambda i: F.regexp_extract(label, r"^(.*?)\s*(,|\(|\s[-–—]\s)\s*(?i:france)\s*(\)?)$", i)
    return F.when((part(2) != "") & ((part(2) == "(") == (part(3) == ")")), part(1)).otherwise(label)


def city_coordinates(spark: SparkSession) -> DataFrame:
    """(ord, city, slug, lat, lon), the table that distances are looked up in."""
    rows = [(i, c, lat, lon) for i, (c, (lat, lon)) in enumerate(CITIES.items())]
    return spark.createDataFrame(rows, "ord int, city string, lat double, lon double").withColumn("slug", slug(F.col("city")))


def located(labels: DataFrame, column: str = "location") -> DataFrame:
    """B6's lookup: (label, lat, lon) of the distinct labels; the first city of the table that stands in the label as words."""
    rows = labels.select(F.col(column).alias("label")).distinct().withColumn("label_slug", slug(F.col("label")))
    cities = F.broadcast(city_coordinates(labels.sparkSession))  # a fixed table
    found = rows.join(cities, F.concat(F.lit("-"), F.col("label_slug"), F.lit("-")).contains(F.concat(F.lit("-"), F.col("slug"), F.lit("-"))))
    return found.groupBy("label").agg(F.min(F.struct("ord", "lat", "lon")).alias("c")).select("label", "c.lat", "c.lon")


def geocoded(labels: DataFrame, column: str = "location") -> DataFrame:
    """(label, lat, lon) of the distinct labels; the first city of the table that holds the label, or that the label holds.

    Case and outer blanks do not count, accents do; an empty label finds nothing.
    """
    rows = labels.select(F.col(column).alias("label")).distinct().withColumn("name", F.lower(F.btrim("label"))).where("name <> ''")
    cities = F.broadcast(city_coordinates(labels.sparkSession))  # a fixed table
    found = rows.join(cities, F.contains("name", "city") | F.contains("city", "name"))
    return found.groupBy("label").agg(F.min(F.struct("ord", "lat", "lon")).alias("c")).select("label", "c.lat", "c.lon")


def within_radius(rows: DataFrame, centre: str, km: float, column: str = "location") -> DataFrame:
    """Rows whose label is a known city within a distance of a known city; others do not match."""
    lat, lon = CITIES[centre]
    near = located(rows, column).withColumn("km", haversine_km(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon"))).where(F.col("km") <= km)
    return rows.join(near, rows[column] == near["label"]).drop("label", "lat", "lon")


def near(rows: DataFrame, centre: str, km: float, column: str = "location") -> DataFrame:
    """Rows whose label is found within a distance of a place, both by B6's lookup; a place that is not found has none."""
    start = located(rows.sparkSession.createDataFrame([(centre,)], "label string"), "label").select(F.col("lat").alias("lat0"), F.col("lon").alias("lon0"))
    found = located(rows, column).join(F.broadcast(start), F.lit(True))  # one row at most
    found = found.where(haversine_km(F.col("lat0"), F.col("lon0"), F.col("lat"), F.col("lon")) <= km).select("label")
    return rows.join(found, rows[column] == found["label"], "left_semi")


def _labels(rows: DataFrame, column: str) -> DataFrame:
    """(label, own): the distinct labels and their keys, written, as a filter on the key would else be worked out on every row."""
    return shared_table(rows.select(F.col(column).alias("label")).distinct().withColumn("own", city_key(F.col("label"))), "labels")


def in_places(rows: DataFrame, keys: list[str], column: str = "location", labels: DataFrame | None = None) -> DataFrame:
    """Rows whose municipality is one of `keys`, worked out once for each distinct label: of rows, or of `labels`, which may be cheaper to read."""
    labels = _labels(rows if labels is None else labels, column).where(municipality(F.col("own")).isin(*keys))
    return rows.join(labels, rows[column] == labels["label"], "left_semi")


def metropole_match(rows: DataFrame, requests: list[str], areas: DataFrame, column: str = "location", labels: DataFrame | None = None) -> DataFrame:
    """Rows in any requested place; `areas` has (alias, commune) keys. A request that is no alias matches its own key.

    Labels are matched once each: those of rows, or of `labels`, which may be cheaper to read.
    """
    spark = rows.sparkSession
    asked = spark.createDataFrame([(r,) for r in requests], "request string").select(city_key(F.col("request")).alias("key")).distinct()
    wide = asked.join(areas, asked["key"] == areas["alias"]).select(F.col("commune").alias("place"), F.lit(True).alias("wide"))
    plain = asked.join(areas, asked["key"] == areas["alias"], "left_anti").select(F.col("key").alias("place"), F.lit(False).alias("wide"))
    labels = _labels(rows if labels is None else labels, column)
    labels = labels.join(wide.unionByName(plain), F.when(F.col("wide"), municipality(F.col("own"))).otherwise(F.col("own")) == F.col("place"), "left_semi")
    return rows.join(labels, rows[column] == labels["label"], "left_semi")


#: A file of metropolitan areas: one object with a reference date and its groups.
AREA_FILE = "reference_date string, groups array<struct<key string, official_name string, city_center string, epci_code string, source_url string, machine_readable_source_url string, activation_aliases array<string>, communes array<struct<insee_code string, name string>>>>"


def read_areas(spark: SparkSession, path: str) -> DataFrame:
    """The groups of an area file, with keys for its names."""
    return area_keys(spark.read.option("multiLine", True).schema(AREA_FILE).json(path).select("reference_date", F.explode("groups").alias("g")))


def area_keys(groups: DataFrame) -> DataFrame:
    """Groups (reference_date, g) as the rules of operators/quality.py take them: a row for each, with the keys of its centre, aliases and communes."""
    keys = lambda c: F.transform(c, location_key)
    return groups.select(
        "reference_date",
        F.col("g.key").alias("area"),
        "g.official_name",
        location_key(F.col("g.city_center")).alias("center"),
        "g.epci_code",
        "g.source_url",
        "g.machine_readable_source_url",
        keys(F.col("g.activation_aliases")).alias("alias_list"),
        F.transform("g.communes", lambda c: F.upper(c["insee_code"])).alias("commune_codes"),
        keys(F.transform("g.communes", lambda c: c["name"])).alias("commune_names"),
    )


def alias_communes(groups: DataFrame) -> DataFrame:
    """(alias, commune) pairs of the groups of `read_areas`, as metropole_match takes them."""
    return groups.select(F.explode("alias_list").alias("alias"), "commune_names").select("alias", F.explode("commune_names").alias("commune")).distinct()


#: Members of metropolitan areas that tests name. Full tables are read by read_areas.
AREAS = {"paris": ("paris", "boulogne billancourt"), "lyon": ("lyon", "villeurbanne"), "marseille": ("marseille",)}


def areas(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, c) for a, members in AREAS.items() for c in members], "alias string, commune string")
