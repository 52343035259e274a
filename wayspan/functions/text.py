"""Cleaning and classifying text columns. Everything but `text_key` is a Catalyst expression."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Spellings that count as true, and words of access texts.
TRUE_TEXTS = ("true", "1", "yes")
ACCESSIBLE = ("true", "yes", "1", "accessible")
INACCESSIBLE = ("false", "no", "0", "inaccessible")
# Street types and directions as addresses abbreviate them.
STREET_TYPES = {
    "street": "st", "road": "rd", "avenue": "ave", "boulevard": "blvd", "drive": "dr",
    "east": "e", "west": "w", "north": "n", "south": "s",
}
# Words that stay in lower case inside titles.
SMALL_WORDS = ("of", "the")
# Closure reasons by the words that name them, first rule first.
CLOSURE_RULES = (("seasonal", ("closed for the season",)), ("construction", ("under construction",)), ("temporary", ("maintenance", "repair", "technical", "planned closure", "planned work")))
# Categories of genera in their order; every other genus is the last one.
GENERA = (
    ("maple", ("Acer",)), ("locust", ("Gleditsia",)), ("oak", ("Quercus",)), ("linden", ("Tilia",)),
    ("conifer", ("Picea", "Pinus", "Abies", "Thuja", "Tsuga", "Larix", "Juniperus", "Taxodium", "Metasequoia", "Chamaecyparis", "Pseudotsuga", "Cedrus", "Taxus", "Cupressus")),
    ("elm", ("Ulmus",)), ("coffeetree", ("Gymnocladus",)),
    ("flowering", ("Malus", "Syringa", "Prunus", "Amelanchier", "Pyrus", "Crataegus", "Cornus", "Magnolia", "Cercis", "Hibiscus", "Viburnum", "Hamamelis", "Maackia")),
    ("ginkgo", ("Ginkgo",)), ("ash", ("Fraxinus",)), ("other", ()),
)
# Reader-facing names of sources and of actions.
SOURCE_LABELS = {
    "automated": "Automated Public Washrooms", "crem": "CREM Portfolio Washrooms", "library": "Library Branch General Information",
    "museum": "Museums and Cultural Centres", "parks": "Park Washroom Facilities", "ttc": "TTC station washrooms",
}
ACTION_LABELS = {"open": "Open at selected time", "extend": "Extend hours", "new": "New facility zone", "retrofit": "Accessibility retrofit"}
VERIFY_LABELS = {"hours": "Verify hours", "accessibility": "Verify accessibility"}
# Ids that may be published as they are, and their namespaces.
PUBLIC_ID = r"^[A-Za-z0-9][A-Za-z0-9._:-]{0,127}$"
NAMESPACE = r"^[A-Za-z0-9][A-Za-z0-9._-]{0,31}$"


def literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def first_nonblank(*columns: Column) -> Column:
    """First column whose trimmed text isn't empty, trimmed; else the empty string."""
    return F.coalesce(*[blank_to_null(c) for c in columns], F.lit(""))


def truthy(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).isin(*TRUE_TEXTS), F.lit(False))


def accessibility(c: Column) -> Column:
    """accessible, inaccessible or unknown; unknown is neither."""
    word = F.lower(F.trim(c))
    return F.when(word.isin(*ACCESSIBLE), "accessible").when(word.isin(*INACCESSIBLE), "inaccessible").otherwise("unknown")


def first_rule(c: Column, rules: tuple[tuple[str, tuple[str, ...]], ...], otherwise: str | None) -> Column:
    """Name of the first rule one of whose words the lower-case text contains."""
    word = F.lower(F.coalesce(c, F.lit("")))
    out = F.lit(otherwise)
    for name, parts in reversed(rules):
        out = F.when(reduce(Column.__or__, [word.contains(p) for p in parts]), name).otherwise(out)
    return out


def closure_category(reason: Column) -> Column:
    """seasonal, construction, temporary or none, the first rule whose words the reason holds."""
    return first_rule(reason, CLOSURE_RULES, "none")


def access_condition(source: Column, fare_paid: tuple[str, ...] = ("ttc",)) -> Column:
    """fare_paid for the sources behind a fare gate, else unrestricted."""
    return F.when(F.coalesce(source.isin(*fare_paid), F.lit(False)), "fare_paid").otherwise("unrestricted")


def genus_category(genus: Column) -> Column:
    """Number of the genus' category in the order of GENERA."""
    pairs = {g: str(i) for i, (_, names) in enumerate(GENERA) for g in names}
    return F.coalesce(F.try_element_at(literal_map(pairs), genus).cast("int"), F.lit(len(GENERA) - 1))


def species_key(botanical: Column) -> Column:
    """Genus and, if it is a plain lower-case word, the second word: cultivar names fold into their species. A
    cross sign counts as the letter x; texts without any word are "?"."""
    parts = F.split(F.trim(F.replace(botanical, F.lit("\u00d7"), F.lit("x"))), r"\s+")
    first, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    return F.when(F.coalesce(first, F.lit("")) == "", F.lit("?")).when(second.rlike(r"^[a-z\-]+$"), F.concat_ws(" ", first, second)).otherwise(first)


def capitalised(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substr(c, F.lit(2)))


def title_address(number: Column, street: Column) -> Column:
    """A positive house number and the street in title case: small words low, Mc before a capital."""
    words = F.split(F.lower(F.trim(street)), r"\s+")

    def cased(word: Column) -> Column:
        return F.when(word.isin(*SMALL_WORDS), word).when(word.rlike(r"^mc\w+$"), F.concat(F.lit("Mc"), capitalised(F.substr(word, F.lit(3))))).otherwise(capitalised(word))

    plain = F.trim(number)
    n = F.when(plain.rlike(r"^[+-]?\d+$"), plain.try_cast("bigint"))
    return F.concat_ws(" ", F.when(n > 0, n.cast("string")), F.array_join(F.transform(words, cased), " "))


def canonical_address(c: Column) -> Column:
    """Lower-case address before the first comma, punctuation gone, spaces single, street types abbreviated."""
    bare = F.regexp_replace(F.lower(F.substring_index(c, ",", 1)), r"[^a-z0-9 ]+", " ")
    words = F.filter(F.split(bare, r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(literal_map(STREET_TYPES), w), w)), " ")


def plausible_int(c: Column, low: float, high: float) -> Column:
    """Whole part of values in (low, high], else null."""
    return F.when((c > low) & (c <= high), c.cast("int"))


@F.pandas_udf(T.StringType())
def _folded(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).casefold().split()))


def text_key(c: Column) -> Column:
    """Compatibility-normalised, case-folded text with single spaces; the one Arrow UDF, as Spark has no normaliser."""
    return _folded(c)


@F.pandas_udf(T.StringType())
def _composed(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).split()))


def composed(c: Column) -> Column:
    """Compatibility-normalised text with single spaces, case as it is."""
    return _composed(c)


def ascii_key(c: Column) -> Column:
    """Like text_key for texts known to be ASCII, as an expression."""
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


@F.pandas_udf(T.StringType())
def _decomposed(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t))


def decomposed(c: Column) -> Column:
    """Compatibility-decomposed text; an Arrow UDF, as Spark has no normaliser."""
    return _decomposed(c)


def search_key(c: Column) -> Column:
    """Lower-case words of a-z and 0-9 with single spaces, accents dropped."""
    plain = F.lower(F.regexp_replace(decomposed(F.coalesce(c, F.lit(""))), r"\p{M}", ""))
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


def slug(c: Column) -> Column:
    """Lower-case words of a-z and 0-9 joined by hyphens, accents dropped; texts without any get a hash."""
    text = decomposed(text_key(c))
    plain = F.trim(F.regexp_replace(F.regexp_replace(text, r"[^\x00-\x7F]", ""), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(plain == "", F.concat(F.lit("street-"), F.substring(F.sha1(text.cast("binary")), 1, 10))).otherwise(plain)


def public_id(c: Column, pattern: str = PUBLIC_ID) -> Column:
    """The id itself where it is safe to publish, else its SHA-256 under the id's own namespace (or "place")."""
    space = F.when(F.contains(c, F.lit(":")), F.substring_index(c, ":", 1))
    space = F.when(F.coalesce(space.rlike(NAMESPACE), F.lit(False)), space).otherwise("place")
    return F.when(c.rlike(pattern), c).otherwise(F.concat(space, F.lit(":"), F.sha2(c, 256)))


def reach_id(place: Column, walk: Column) -> Column:
    """Id of a place's reach at a walking distance."""
    plain = F.concat(F.lit("reach:"), place, F.lit(":"), walk.cast("string"))
    return F.when(plain.rlike(PUBLIC_ID), plain).otherwise(F.concat(F.lit("reach:"), F.sha2(place, 256), F.lit(":"), walk.cast("string")))


def display_name(c: Column) -> Column:
    """'Family, qualifier' as 'Qualifier family'; without a qualifier the family."""
    parts = F.split(c, ",")
    family, rest = F.trim(F.get(parts, F.lit(0))), F.trim(F.get(parts, F.lit(1)))
    flipped = F.concat(capitalised(rest), F.lit(" "), F.lower(family))
    return F.when(~F.contains(c, F.lit(",")), c).when(rest == "", family).otherwise(flipped)


def labelled(key: Column, labels: dict[str, str], fallback: Column) -> Column:
    """Label of a key, else the fallback."""
    return F.coalesce(F.try_element_at(literal_map(labels), key), fallback) if labels else fallback


def source_label(label: Column, source: Column, facility: Column, url: Column) -> Column:
    """The label that is given, else that of the source, of the namespace of the facility id, or of a transit
    agency's address; unknown sources have an empty one."""
    named = F.coalesce(source, F.substring_index(facility, ":", 1), F.when(F.lower(url).rlike(r"^https://(?:www\.)?ttc\.ca(?:/|$)"), "ttc"))
    return F.coalesce(label, labelled(named, SOURCE_LABELS, F.lit("")))


def action_label(action: Column, subtype: Column) -> Column:
    """Label of an action (none is "open"); verifications go by their subtype."""
    verify = labelled(subtype, VERIFY_LABELS, F.lit("Verify information"))
    return F.when(action == "verify", verify).otherwise(labelled(F.coalesce(action, F.lit("open")), ACTION_LABELS, F.lit("")))


def safe_link(c: Column) -> Column:
    """Local data paths without parent steps, or https links without credentials."""
    local = c.rlike(r"^/data/[A-Za-z0-9._~!$&'()*+,;=:@%/?#-]+$") & ~c.contains("..")
    host = F.try_parse_url(c, F.lit("AUTHORITY"))
    remote = F.lower(F.substring(c, 1, 8)).eqNullSafe("https://") & host.isNotNull() & ~host.contains("@")
    return F.coalesce(local | remote, F.lit(False))


def half_even(c: Column, digits: int) -> Column:
    """Published rounding: half to even."""
    return F.bround(c, digits)
