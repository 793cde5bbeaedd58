"""Labels of schools, relations, areas and records, as ordered conditional expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestrata.functions.classify import is_official_area, rank_of
from lodestrata.functions.text import host_below

# Fixed values of the data: words and patterns by which places, stages and sources are told apart.
PLACE_IN_AREA = r"(街道|镇|乡).*(社区|苑|园|里|弄|村|居委|委会)"
COMMITTEE_END = r"(居委|村委会)$"
RESIDENTIAL_WORD = r"(弄|村|苑|园|里|坊|府|邸|庭|城|湾|花园|新村|公寓|小区)"
POI_ROOTS, POI_DETAILS = ("商务住宅", "房产小区"), ("住宅区", "住宅小区")
OFFICIAL_PREFIX, OFFICIAL_NAMES = "official_school_community_candidates:", ("official_pudong_junior_2025", "official_baoshan_boundary_text")
TIERS = ("一", "二", "三", "四")
STATUS_ORDER = ("missing", "source-found", "boundary-text", "partially-linked", "linked")
REASONS = (
    "school/community district mismatch", "non-official source", "community name is not an explicit official enrollment-area entity",
    "official quote does not contain complete community name", "official quote explicitly contains complete official enrollment-area name",
)


def tier_label(tier: Column, kind: Column) -> Column:
    named = F.concat(F.element_at(F.array(*map(F.lit, TIERS)), F.greatest(F.least(tier, F.lit(4)), F.lit(1)).cast("int")), F.lit("梯队"))
    return F.when(F.coalesce(tier, F.lit(0)) == 0, F.when(kind == "middle", "未分级").otherwise("待补")).otherwise(F.when(tier.between(1, 3), named).otherwise("四梯队"))


def known_tier(tier: Column, tiers: tuple[str, ...], other: str) -> Column:
    """A tier of the list; any other value, null included, is ``other``."""
    return F.when(tier.isin(*tiers), tier).otherwise(other)


def relation_kind(level: Column, residential: Column) -> Column:
    return F.when(level == "administrative_or_enrollment_area", "官方招生区域").when(residential, "住宅小区关系").otherwise("来源收录关系")


def relation_status(level: Column, verified: Column, catalogued: Column) -> Column:
    return F.when(level == "administrative_or_enrollment_area", "待核验").when(verified, "已审核").when(catalogued, "部分匹配").otherwise("来源收录")


def entity_kind(name: Column) -> Column:
    """What an official source's name stands for: an enrolment area, or a housing estate."""
    area = name.rlike(PLACE_IN_AREA) | name.rlike(COMMITTEE_END) | ~name.rlike(RESIDENTIAL_WORD)
    return F.when(area, "official_area").otherwise("community")


def is_official_source(source: Column, url: Column, suffix: str = "gov.cn") -> Column:
    return F.coalesce(source.startswith(OFFICIAL_PREFIX) | source.isin(*OFFICIAL_NAMES), F.lit(False)) & host_below(url, suffix)


def eligibility(same_district: Column, official: Column, name: Column, quote: Column) -> Column:
    """Why a link is or is not proven by its source, the first reason that holds."""
    flat = F.regexp_replace(quote, r"(?U)\s+", "").contains(F.regexp_replace(name, r"(?U)\s+", ""))
    return (
        F.when(~F.coalesce(same_district, F.lit(False)), REASONS[0]).when(~official, REASONS[1]).when(~F.coalesce(is_official_area(name), F.lit(False)), REASONS[2])
        .when(~F.coalesce(flat, F.lit(False)), REASONS[3]).otherwise(REASONS[4])
    )


def is_residential_poi(kinds: Column) -> Column:
    """Whether a type such as ``root;detail;…`` has a residential root and a residential detail."""
    parts = F.filter(F.transform(F.split(kinds, "[;:]"), F.trim), lambda x: x != "")
    return F.coalesce(F.get(parts, F.lit(0)).isin(*POI_ROOTS) & F.exists(F.slice(parts, F.lit(2), F.greatest(F.size(parts), F.lit(1))), lambda x: x.isin(*POI_DETAILS)), F.lit(False))


def stage_in(text: Column) -> Column:
    return F.when(text.rlike("小学|一年级"), "primary").when(text.rlike("初中|六年级|中学"), "middle").otherwise("unknown")


def looks_like_address(text: Column) -> Column:
    return text.rlike("[路街道弄号村镇巷]") & (F.length(text) >= 3) & ~text.rlike("学校名称|学校地址|办学规模")


def run_name(stamp: Column, provider: Column, report: Column) -> Column:
    found = F.regexp_extract(report, r"community-location-backfill/(\d{8}-\d{6})/", 1)
    return F.concat_ws("-", stamp, provider, F.when(found == "", "unknown-source").otherwise(found))


def status_rank(status: Column) -> Column:
    return rank_of(status, STATUS_ORDER)


def metric_text(complete: Column, total: Column, percent: Column) -> Column:
    """``complete/total (percent%)``, whole percentages without a decimal."""
    shown = F.when(percent == F.floor(percent), F.floor(percent).cast("string")).otherwise(percent.cast("string"))
    return F.concat(complete.cast("string"), F.lit("/"), total.cast("string"), F.lit(" ("), shown, F.lit("%)"))
