"""Column functions: ages, distances, heights, bands, normalisers and three-valued matches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
_EDGES = "^[\\s]+|[\\s]+$"


def age_years(asof: Column, born: Column) -> Column:
    """Completed years; a birthday counts from its month and day on."""
    early = (F.date_format(asof, "MMdd") < F.date_format(born, "MMdd")).cast("int")
    return F.year(asof) - F.year(born) - early


def account_age_days(asof: Column, created: Column) -> Column:
    return F.greatest(F.lit(0.0), F.timestamp_diff("MICROSECOND", created, asof) / 86400e6)


def distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance; null if any coordinate is."""
    a, b = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.pow(F.sin(a), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(b), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, _EDGES, "")


def height_inches(text: Column) -> Column:
    """Feet and inches (0 to 11) or a plain number of inches from 36 to 96."""
    t = strip(text)
    shape = "^(\\d+)\\s*'\\s*(\\d{1,2})\\s*\"?$"
    feet, inches = F.regexp_extract(t, shape, 1).try_cast("double"), F.regexp_extract(t, shape, 2).try_cast("int")
    plain = t.try_cast("double")
    return F.when(feet.isNotNull() & (inches <= 11), (feet * 12 + inches).cast("double")).when(plain.between(36, 96), plain)


def height_inches_search(text: Column) -> Column:
    """The search form: inches may be left out, whole inches from 48 to 90."""
    t = strip(text)
    shape = "^(\\d+)\\s*'\\s*(\\d{0,2})\\s*\"?$"
    feet, inches = F.regexp_extract(t, shape, 1).try_cast("double"), F.coalesce(F.regexp_extract(t, shape, 2).try_cast("int"), F.lit(0))
    plain = F.when(t.try_cast("double").between(-1e6, 1e6), F.floor(t.try_cast("double")))
    value = F.when(feet.isNotNull(), F.when(inches <= 11, feet * 12 + inches)).otherwise(plain)
    return F.when(value.between(48, 90), value).cast("int")


def band(value: Column, bands: list[tuple[float | None, str]]) -> Column:
    """The label of the half-open band that holds a value."""
    out = None
    for top, label in bands[:-1]:
        out = F.when(value < top, label) if out is None else out.when(value < top, label)
    return F.when(value.isNotNull(), out.otherwise(bands[-1][1]))


def in_range(value: Column, ranges: list[tuple[int, int]]) -> Column:
    """"lo-hi" of the inclusive range that holds a value, null outside."""
    out = F.when(value.between(*ranges[0]), f"{ranges[0][0]}-{ranges[0][1]}")
    for lo, hi in ranges[1:]:
        out = out.when(value.between(lo, hi), f"{lo}-{hi}")
    return out


def token(text: Column) -> Column:
    """Lower case without outer white space; blank is null."""
    t = F.lower(strip(text))
    return F.when(t != "", t)


def tokens(values: Column) -> Column:
    """Sorted distinct tokens; a null array is empty."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), token), lambda x: x.isNotNull())))


ANYTHING = ["any", "none", "open to any", "prefer not to say", "prefer not to say."]


def search_values(values: Column) -> Column:
    """Stripped values in order, each once, without blanks and words for anything."""
    kept = F.filter(F.transform(values, strip), lambda x: (x != "") & ~F.lower(x).isin(ANYTHING))
    return F.array_distinct(kept)


def proximity_mode(text: Column) -> Column:
    """any, city or radius; unknown text restricts nothing."""
    t = F.lower(strip(F.coalesce(text, F.lit(""))))
    return F.when(t == "same city", "city").when((t == "same neighborhood") | F.rlike(t, F.lit("^within\\s+\\d+(\\.\\d+)?\\s+miles?$")), "radius").otherwise("any")


def proximity_metres(text: Column) -> Column:
    t = F.lower(strip(F.coalesce(text, F.lit(""))))
    miles = F.when(t == "same neighborhood", 5).otherwise(F.regexp_extract(t, "^within\\s+(\\d+(\\.\\d+)?)\\s+miles?$", 1).try_cast("double"))
    return miles * 1609.344


def range_accepts(value: Column, lo: Column, hi: Column) -> Column:
    return F.when(value.isNotNull() & lo.isNotNull() & hi.isNotNull(), value.between(lo, hi).cast("double"))


def distance_accepts(distance: Column, most: Column) -> Column:
    return (distance <= most).cast("double")


def exact_match(a: Column, b: Column) -> Column:
    return (token(a) == token(b)).cast("double")


def combine_both(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), ((a == 1) & (b == 1)).cast("double"))


def overlap_count(preferred: Column, actual: Column) -> Column:
    p, a = tokens(preferred), tokens(actual)
    return F.when((F.size(p) > 0) & (F.size(a) > 0), F.size(F.array_intersect(p, a)).cast("double"))


def overlap_ratio(preferred: Column, actual: Column) -> Column:
    """Shared values as a part of the preferred ones."""
    return overlap_count(preferred, actual) / F.size(tokens(preferred))


def mean_available(values: list[Column]) -> Column:
    """The mean of the values that are there; null without any."""
    n = sum((v.isNotNull().cast("int") for v in values[1:]), values[0].isNotNull().cast("int"))
    total = sum((F.coalesce(v, F.lit(0.0)) for v in values[1:]), F.coalesce(values[0], F.lit(0.0)))
    return F.when(n > 0, total / n)


def compatibility() -> list[Column]:
    """The 25 compatibility columns of pairs with viewer_ and candidate_ columns."""
    c = F.col
    out: dict[str, Column] = {}
    sides = [("viewer", "candidate"), ("candidate", "viewer")]
    for me, you in sides:
        out[f"{me}_accepts_{you}_age"] = range_accepts(c(f"{you}_age"), c(f"{me}_min_age"), c(f"{me}_max_age"))
        out[f"{me}_accepts_{you}_distance"] = distance_accepts(c("distance_km"), c(f"{me}_max_distance_km"))
        out[f"{me}_position_match"] = exact_match(c(f"{me}_into_position"), c(f"{you}_position"))
        out[f"{me}_relationship_status_match"] = exact_match(c(f"{me}_into_relationship_status"), c(f"{you}_relationship_status"))
        out[f"{me}_body_type_match"] = overlap_ratio(c(f"{me}_into_body_types"), F.array(c(f"{you}_body_type")))
        for stem, want, have in (("body_hair", "into_body_hair", "body_hair"), ("type", "into_types", "my_types"), ("fetish", "into_fetishes", "my_fetishes")):
            out[f"{me}_{stem}_match_count"] = overlap_count(c(f"{me}_{want}"), c(f"{you}_{have}"))
            out[f"{me}_{stem}_match_ratio"] = overlap_ratio(c(f"{me}_{want}"), c(f"{you}_{have}"))
    scored = [v for k, v in out.items() if not k.endswith("_count")]
    out["mutual_position_match"] = combine_both(out["viewer_position_match"], out["candidate_position_match"])
    out["mutual_type_match"] = mean_available([out["viewer_type_match_ratio"], out["candidate_type_match_ratio"]])
    out["mutual_preference_score"] = mean_available(scored)
    return [v.alias(k) for k, v in out.items()]


def evidence(score: Column, rank: Column) -> Column:
    """Rank-weighted evidence: max(score, 0) / sqrt(rank); 0 for scores that aren't finite and ranks under 1."""
    finite = score.isNotNull() & ~F.isnan(score) & (F.abs(score) != float("inf"))
    return F.when(finite & (rank > 0), F.greatest(score, F.lit(0.0)) / F.sqrt(rank)).otherwise(0.0)
