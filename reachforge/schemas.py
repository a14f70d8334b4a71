"""Column names and types of every table shape the engine reads or writes."""

from __future__ import annotations

from pyspark.sql import types as T

# Column names and their order, labels and levels are those of the files that the engine reads and writes.
CREATIVE = ["ad_creative_bodies", "ad_creative_link_titles", "ad_creative_link_captions", "ad_creative_link_descriptions"]
TARGETING = ["target_ages", "target_gender"]
START, STOP, PLATFORMS = "ad_delivery_start_date_time", "ad_delivery_stop_date_time", "publisher_platforms"
GENDERS = ["de_male", "de_female", "de_unknown"]
ADULT_AGES = ["de_age_18_24", "de_age_25_34", "de_age_35_44", "de_age_45_54", "de_age_55_64", "de_age_65_plus"]
AGES = ["de_age_13_17", *ADULT_AGES, "de_age_unknown"]
REACH = [*GENDERS, *AGES]
AGE_LABELS = {"13-17": "de_age_13_17", "18-24": "de_age_18_24", "25-34": "de_age_25_34", "35-44": "de_age_35_44", "45-54": "de_age_45_54", "55-64": "de_age_55_64", "65+": "de_age_65_plus", "unknown": "de_age_unknown"}

RAW = ["search_brand", "sector", "meta_ad_id", *CREATIVE, PLATFORMS, *TARGETING, START, STOP, "collection_timestamp", *REACH]
CLASSIFIED = [*RAW, "commercial_eligibility", "eligibility_reason", "matched_rule", "matched_field", "matched_text"]
CONFLICT = ["search_brand", "meta_ad_id", "difference_tier", "differing_field", "earlier_value", "later_value", "earlier_collection_timestamp", "later_collection_timestamp", "earlier_query_date_min", "earlier_query_date_max", "later_query_date_min", "later_query_date_max"]
DELIVERY = ["query_date_min", "query_date_max", *RAW]
LEDGER = ["meta_ad_id", "search_brand", "sector", "exclusion_stage", "exclusion_reason", "exclusion_rule", "manual_category"]
DERIVED = ["female_delivery_share", "adult_18_34_share", "age_scope", "platform_category", "month", "known_gender_reach", "known_adult_reach", "gender_data_usable", "age_data_usable", "has_unknown_gender", "has_unknown_age", "creative_signature_hash"]
CONFIG_KEY = ["creative_signature_hash", "target_gender", "target_ages", "platform_category"]
STRUCTURAL = [PLATFORMS, *TARGETING]

GENDER_LEVELS = ["All", "Women", "Men"]
SECTOR_LEVELS = ["grocery", "fashion", "health_beauty", "home"]
PLATFORM_LEVELS = ["Both", "Facebook-only", "Instagram-only", "Other"]


def strings(names: list[str]) -> T.StructType:
    """A bronze schema: every value is text, blank is missing."""
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


#: A retailer dimension is data of the user: brand, sector, page id.
RETAILERS = T.StructType([T.StructField(n, T.StringType(), False) for n in ("search_brand", "sector", "page_id")])

PAYLOAD = """id string, ad_creative_bodies array<string>, ad_creative_link_titles array<string>, ad_creative_link_captions array<string>, ad_creative_link_descriptions array<string>,
publisher_platforms array<string>, target_ages array<string>, target_gender string, ad_delivery_start_time string, ad_delivery_stop_time string,
age_country_gender_reach_breakdown array<struct<country: string, age_gender_breakdowns: array<struct<age_range: string, male: bigint, female: bigint, unknown: bigint>>>>"""
